import json

from conftest import rows
from pyspark.sql import functions as F

from quern.functions import mentions
from quern.operators import question_plans as Q


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*[F.col(n) for n in names]).alias("y")).first().y


def test_mention_hits(spark):
    m = one(spark, mentions.mention_hits, "theo điều 5 Khoản 2 và Điều 7, luat-dat-dai-2024", "Điều 5. Khoản 3 (luat-dat-dai-2024) Điều 70")
    assert (m.n, m.hits, m.rate) == (4, 2, 0.5)
    assert one(spark, mentions.mention_hits, "không", "Điều 5").rate is None and one(spark, mentions.mention_hits, None, None).n == 0


def test_terms(spark):
    a = "Áp dụng nguyên tắc cắt ngang được nêu, “thửa đất lấn biển”, “thửa đất lấn biển”, (200 m), **Lưu ý**, (theo quy định), **vùng đệm**, “điều khoản lạ”"
    assert [(t.term_norm, t.pattern) for t in one(spark, mentions.term_candidates, a)] == [("cắt ngang", "named_principle"), ("thửa đất lấn biển", "quoted"), ("vùng đệm", "bold")]
    assert one(spark, mentions.term_candidates, None) == []


def test_labels_headings_and_chunks(spark):
    df = spark.createDataFrame([(["n", "Điều 3. Hạn mức", "Khoản 1"],), (["n"],)], "p array<string>")
    assert [r[0] for r in df.select(mentions.short_label(F.col("p"))).collect()] == ["Điều 3, Khoản 1 (n)", "n"]
    assert one(spark, mentions.case_headings, "## Vấn đề\nx\n### kết luận\n") == 2
    c = lambda k, m: F.struct(F.lit("n").alias("van_ban"), F.lit("3").alias("dieu"), F.lit(k).alias("khoan"), F.lit(m).alias("diem"))
    ctx = "--- Điều 3. A, Khoản 1. (n) ---\nx\n\n--- Điều 3. A, Khoản 1. Điểm b. (n) ---\ny"
    assert one(spark, lambda x: mentions.chunk_for_citation(c("1", "b"), x), ctx).body == "y"
    assert one(spark, lambda x: mentions.chunk_for_citation(c("1", "c"), x), ctx).body == "x"
    assert one(spark, lambda x: mentions.chunk_for_citation(c("2", None), x), ctx) is None


def test_clauses_and_inferred_citations(spark):
    df = spark.createDataFrame([("d", "Điều 1. X\n1. một\na) ý a\nb) ý b\ntiếp\n2. hai"), ("e", None), ("f", "")], "k string, t string")
    assert rows(mentions.clauses(df, "k", "t")) == [("d", "1", "a,b", "một\na) ý a\nb) ý b\ntiếp"), ("d", "2", "", "hai"), ("d", None, "", "Điều 1. X")]
    cite = lambda a: one(spark, lambda x: mentions.inferred_citations(x, F.lit("1"), F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.lit("s")), a)
    assert [c.khoan for c in cite("Theo khoản 2, khoản 9, khoản 1 và khoản 3 Điều 1")] == ["2", "1"] and cite("Điều 4") is None and [c.khoan for c in cite("x")] == [None]


def test_plans(spark):
    raw = "```json\n" + json.dumps({"theme": "dat-dai", "jurisdiction": "mars", "response_mode": "x", "temporal_intent": {"temporal_anchor": "2020-05"}}) + "\n```"
    p = one(spark, Q.cleaned_plan, raw)
    assert (p.theme, p.jurisdiction, p.response_mode, p.temporal) == ("dat-dai", None, "general", "2020-05-15")
    assert one(spark, Q.cleaned_plan, "no json").theme is None and one(spark, lambda c: Q.forced(c, "tp-hcm"), None) == "tp-hcm"
    assert Q.ABLATIONS["full"].relations == ["IMPLEMENTS", "AMENDS"] and Q.ABLATIONS["no-amends"].relations == ["IMPLEMENTS"] and Q.ABLATIONS["dense-only"].relations == []
    q = spark.createDataFrame([("q", ["lệ", "phí", "đất"])], "q string, tokens array<string>")
    u = spark.createDataFrame([(i, "n", ["lệ", "phí"]) for i in range(5)] + [(9, "m", ["phí"]), (8, "n", ["lệ", "phí", "đất"])], "item int, norm string, tokens array<string>")
    assert rows(Q.label_candidates(q, u), "item") == [(0,), (1,), (8,)]
    assert Q.over_budget(spark.createDataFrame([(90,), (10,)], "t int"), "t", 20, 100).count() == 1


LEAVES = [
    ("n", ["n", "Điều 1. A", "Khoản 2", "Điểm đ"], "t1"),
    ("n", ["n", "Điều 1. A", "Khoản 2", "Điểm a"], "t2"),
    ("n", ["n", "Phu\u0323 lu\u0323c không", "Khoản 9"], "t3"),
    ("n", ["n", "Phụ lục I. Mẫu  đơn", "Khoản 3"], "t4"),
    ("m", ["m", "Điều 1"], "t5"),
    ("m", None, "t6"),
]


def test_citations_resolve_by_point_and_appendix(spark):
    from quern.operators import validate

    u = spark.createDataFrame(LEAVES, "norm string, path array<string>, text string")
    u = u.select("norm", validate.leaf_place(F.col("path")).alias("p")).select("norm", "p.*").distinct()
    cites = {
        "good": ("n", None, "1", "2", "đ"), "point": ("n", "dieu", "1", "2", "b"), "clause": ("n", "dieu", "1", "7", "a"), "article": ("n", "dieu", "8", None, None), "no clause": ("n", "dieu", "1", None, "b"),
        "null": ("n", "dieu", None, "1", None), "blank": ("n", "phu_luc", " ", None, None), "norm": ("x", "dieu", None, None, None), "no norm": (None, "dieu", "1", None, None),
        "app": ("n", "phu_luc", "I", None, None), "app 3": ("n", None, "Phụ lục I.  Mẫu đơn kèm theo", "3", None), "app any": ("n", "phu_luc", "_default", "3", None),
        "app clause": ("n", "phu_luc", "I", "4", None), "app no": ("n", "phu_luc", "V", None, None), "app none": ("m", "phu_luc", "_default", None, None),
    }
    c = spark.createDataFrame([(k, *v) for k, v in cites.items()], "cite_id string, norm string, loai string, dieu string, khoan string, diem string")
    assert dict(rows(validate.unresolved_levels(c, u), "cite_id", "level")) == {
        "point": "diem", "clause": "khoan", "article": "dieu", "null": "dieu_missing", "blank": "dieu_missing", "norm": "van_ban", "no norm": "van_ban", "app clause": "phu_luc_khoan", "app no": "phu_luc", "app none": "phu_luc",
    }


def test_gold_texts_of_points_and_appendices(spark):
    import hashlib

    from quern.plans.mention_queries import gold_texts

    u = spark.createDataFrame([(str(i), *x) for i, x in enumerate(LEAVES)] + [("8", "N ", ["n", "Phụ lục II"], "t8"), ("9", "n", ["n", "Phụ lục"], None)], "id string, norm_id string, context_path array<string>, text string")
    cites = {
        "point": [("n", None, "1", "2", "đ")], "clause": [("n", "dieu", "1", "2", None)], "no point": [("n", "dieu", "1", "2", "x")], "app": [("n", "phu_luc", "II", None, None)], "prefix": [("n", "phu_luc", "I", None, None)],
        "longer": [("n", None, "Phụ lục II: Mẫu", None, None)], "any": [("n", "phu_luc", "_default", None, None)], "app clause": [("n", "phu_luc", "_default", "3", None)], "null": [("n", "phu_luc", None, None, None), ("n", None, None, None, None)],
        "both": [("n", "dieu", "1", "2", "a"), ("n", "phu_luc", "II", None, None), ("n", "phu_luc", "_default", None, None)],
    }
    q = spark.createDataFrame(list(cites.items()), "id string, ground_truth_citations array<struct<van_ban:string,loai:string,dieu:string,khoan:string,diem:string>>")
    want = {"point": ["t1"], "clause": ["t1", "t2"], "app": ["t8"], "prefix": ["t4", "t8"], "longer": ["t8"], "any": ["t4", "t8"], "app clause": ["t4"], "both": ["t2", "t4", "t8"]}
    assert rows(gold_texts(q, u)) == sorted([(k, len(v), hashlib.md5("\n\n".join(v).encode()).hexdigest()) for k, v in want.items()], key=repr)
