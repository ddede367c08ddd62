import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quern.functions import citations, text
from quern.sources import documents, sinks
from quern.streaming import traces


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert sorted(one(spark, text.slug_tokens, "Nghị định 102/2024/NĐ-CP")) == sorted(["nghi", "dinh", "102", "2024", "nd", "cp"])
    assert one(spark, text.slug_tokens, None) == [] and one(spark, text.word_tokens, "Điều 1, ĐIỀU_2") == ["điều", "1", "điều_2"]
    assert one(spark, lambda c: text.ngrams(text.word_tokens(c), 2), "a b c") == ["a b", "b c"] and one(spark, lambda c: text.ngrams(text.word_tokens(c), 5), "a b") == []
    assert one(spark, text.estimate_tokens, "") == 1 and one(spark, text.estimate_tokens, "x" * 10500) == 3000
    assert one(spark, text.number_to_hex, 255, "long") == "00000000000000ff" and int(one(spark, text.hex_to_number, "f" * 16)) == 2**64 - 1
    assert one(spark, text.html_escape, "<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;" and one(spark, text.flip_first, "Điều") == "điều"
    assert one(spark, lambda c: text.truncate_text(c, 4), "abcdef") == "abc…" and one(spark, text.thousands, 1234567, "long") == "1.234.567"
    assert json.loads(one(spark, text.fenced_json, 'x ```json\n{"a": 1}\n``` y')) == {"a": 1} and json.loads(one(spark, text.fenced_json, 'so {"a": 2}.')) == {"a": 2}
    assert one(spark, lambda c: text.snippet(c, F.lit("X"), 2, 2), "aaaXbbb") == "aaXbb" and one(spark, lambda c: text.snippet(c, F.lit("Z"), 2, 2, 3), "aaaXbbb") == "aaa"
    assert one(spark, text.document_slug, "Nghị định 102/2024/NĐ-CP") == "nghi-dinh-102-2024-nd-cp" and one(spark, text.document_slug, "Thư riêng") is None


NAMES = {
    "Luật Địa chất và Khoáng sản của Quốc hội, số 54/2024/QH15": "luat-dia-chat-va-khoang-san-2024",
    "Luật Bảo hiểm y tế số 25/2008/QH12 của Quốc hội": "luat-bao-hiem-y-te-2008",
    "Luật của Quốc hội số 26/2001/QH10 về Giao thông đường bộ": "luat-giao-thong-duong-bo-2001",
    "Luật các tổ chức tín dụng số 02/1997/QH10": "luat-cac-to-chuc-tin-dung-1997",
    "Luật Giao thông đường thủy nội địa, số 23/2004/QH11": "luat-giao-thong-duong-thuy-noi-dia-2004",
    "Luật Đường sắt của Quốc hội, số 06/2017/QH14": "luat-duong-sat-2017",
    "Luật Ngân sách Nhà nước của Quốc hội, số 83/2015/QH13 ": "luat-ngan-sach-nha-nuoc-2015",
    "Nghị định 102/2024/NĐ-CP": "nghi-dinh-102-2024-nd-cp",
    "Thông tư 04/2020/TT-BTP": "thong-tu-04-2020-tt-btp",
    "Dự thảo Luật Công nghiệp trọng điểm": None,
    "Dự thảo Luật Bảo hiểm xã hội": None,
    "Luật Quy định quyền lập hội": None,
    "": None,
    "   ": None,
    # beyond the golden cases
    "Luật Đất đai số 31/2024/QH15": "luat-dat-dai-2024",
    "Luật Nuôi con nuôi": None,
    "Bộ luật Dân sự số 91/2015/QH13": "bo-luat-dan-su-2015",
    "Thông tư liên tịch 01/2014/TTLT-BTP-BCA": "thong-tu-lien-tich-01-2014-ttlt-btp-bca",
    "Luật sửa đổi, bổ sung một số điều của Luật A, Luật B, Luật C, Luật D số 1/2020/QH14": "luat-sua-doi-bo-sung-mot-dieu-cua-luat-a-luat-b-luat-2020",
    "Luật số 12/2020/QH14": None,
}


def test_document_slugs(spark):
    df = spark.createDataFrame([*NAMES.items(), (None, None)], "x string, want string")
    assert [tuple(r) for r in df.select("x", text.document_slug(F.col("x")).alias("y"), "want").where("not y <=> want").collect()] == []
    from plain_sql import run

    names = [n for n in NAMES if n]
    assert run(names) == [NAMES[n] for n in names]


def test_citations_round_trip(spark):
    a = "x [Điểm đ, Khoản 2, Phụ lục, Văn bản Z] [Điều 3, Văn bản a] [điều 3, văn bản a] [Điều, Văn bản b] [Khoản 1] [Phụ lục II, Văn  bản c]"
    got = [tuple(c) for c in one(spark, citations.parse_citations, a)]
    assert got == [("_default", "2", "đ", None, "Z", "phu_luc"), ("3", None, None, None, "a", "dieu"), ("II", None, None, None, "c", "phu_luc")]
    again = one(spark, lambda c: citations.parse_citations(F.array_join(F.transform(citations.parse_citations(c), citations.format_citation), " ")), a)
    assert [tuple(c) for c in again] == got and one(spark, citations.parse_citations, None) == []


def test_structured_cites(spark):
    got = [tuple(c) for c in one(spark, citations.structured_cites, "Khoản 2 của Điều 5, khoản 2 Điều 5, Điều 5, Điều 7 và điều 8")]
    assert got == [("5", "2"), ("7", None)]
    assert ("8", None) in [tuple(c) for c in one(spark, lambda c: citations.structured_cites(c, strict=False), "điều 8")]


def test_labels_blocks_and_sections(spark):
    df = spark.createDataFrame([(["n", "Điều 3", "Khoản 1"], 4, "2014-07-01", "2025-01-01"), (["n"], None, None, None)], "p array<string>, t int, f string, v string")
    a, b = [r[0] for r in df.select(citations.citation_label(F.col("p"), F.col("t"), F.col("f"), F.col("v"))).collect()]
    assert a == "[Tier 4 | Hiệu lực: 2014-07-01 → 2025-01-01 (HẾT HIỆU LỰC)] Điều 3, Khoản 1 (n)" and b == "n"
    p = one(spark, citations.parse_label, a)
    assert (p.tier, p.valid_from, p.valid_to, p.expired, p.dieu, p.khoan, p.norm_id) == ("4", "2014-07-01", "2025-01-01", True, "3", "1", "n")
    ctx = f"--- {a} ---\nthân\n\n--- [Tier 1] Điều 30 (m) ---\nb"
    assert [tuple(x) for x in one(spark, citations.context_blocks, ctx)] == [(a, "thân"), ("[Tier 1] Điều 30 (m)", "b")]
    c = lambda d, k, v: F.struct(F.lit(d).alias("dieu"), F.lit(k).alias("khoan"), F.lit(v).alias("van_ban"))
    seen = [one(spark, lambda x, c=c_: citations.cited_in_context(c, x), ctx) for c_ in (c("3", "1", "n"), c("3", None, "n"), c("3", "2", "n"), c("3", None, "m"), c("30", None, "M"))]
    assert seen == [True, True, False, False, True]
    s = one(spark, citations.answer_sections, "## PHẠM VI\np\n## TRẢ LỜI\n a \nb\n## CẢNH BÁO LEX\n")
    assert (s.tra_loi, s.canh_bao_lex, s.pham_vi) == ("a \nb", "", "p")


DOC = """---
id: luat-a
title: "Luật: A"
tier: 1
theme: dat-dai
implements: luat-b
amended_by_norms: [x, 'y']
valid_to: null
---
# Tên
## Điều 1. Một
### Khoản 1
dòng a

  dòng b
#### Điểm a
sâu <!-- amended_by: 49/2026, khoản 1 Điều 13, hiệu lực: 31/01/2026, nội dung: Sửa đổi, bổ sung x -->
### Khoản 2
hai
## Điều 2
"""


def test_documents(spark, tmp_path):
    (tmp_path / "luat-a.md").write_text(DOC, encoding="utf-8")
    (tmp_path / "README.md").write_text("x")
    raw = documents.read_texts(spark, str(tmp_path), exclude=["README.md"])
    front, body = documents.split_front_matter(F.col("content"))
    docs = raw.select("file", front.alias("front"), body.alias("body"))
    m = documents.front_matter_fields(docs).first()
    assert (m.id, m.title, m.tier, m.implements, m.amended_by_norms, m.valid_to) == ("luat-a", "Luật: A", 1, ["luat-b"], ["x", "y"], None)
    units = documents.leaf_units(docs.withColumn("norm_id", F.lit("luat-a"))).orderBy("ord").collect()
    assert [(u.context_path[1:], u.text) for u in units] == [(["Điều 1. Một", "Khoản 1"], "dòng a\ndòng b"), (["Điều 1. Một", "Khoản 1", "Điểm a"], "sâu"), (["Điều 1. Một", "Khoản 2"], "hai")]
    import hashlib

    assert units[0].unit_id == hashlib.sha256(">".join(units[0].context_path).encode()).hexdigest()[:16]
    a = docs.select(documents.amendments(F.col("body")).alias("a")).first().a
    assert [(x.amending_norm, x.effective_date, x.change_type) for x in a] == [("49/2026", "2026-01-31", "sua-doi-bo-sung")]
    v = one(spark, documents.original_version, "<!-- original_v_2024-08-01:\n cũ \n-->")
    assert (v.date_label, v.text) == ("2024-08-01", "cũ") and one(spark, documents.original_version, "x") is None
    assert sinks.manifest(spark, str(tmp_path), "*.md").count() == 2


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"system": "s", "results": [{"id": "1"}, {"id": "2"}]}')
    (tmp_path / "b.json").write_text('[{"id": "3"}]')
    assert rows(documents.read_envelopes(spark, str(tmp_path), "id string"), "id") == [("1",), ("2",), ("3",)]
    (tmp_path / "l.jsonl").write_text('{"id": "1"}\nnot json\n')
    good, bad = documents.read_json_lenient(spark, str(tmp_path / "l.jsonl"), "id string")
    assert good.count() == 1 and bad.count() == 1
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["# G1", "q1", "", "> note", "q2", "# G2", "q3"])], "file string, pos int, line string")
    assert [tuple(r)[2:] for r in documents.grouped_questions(lines).orderBy("pos").collect()] == [("G1", None, "q1"), ("G1", "note", "q2"), ("G2", None, "q3")]
    runs = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 1), ("r2", 1)], "run string, id int")
    assert rows(documents.latest_complete_run(runs, "run", "id", 2)) == [("r1", 1), ("r1", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), (None, None)], "k string, v double")
    assert sinks.markdown_table(df) == "| k | v |\n|---|---|\n| a | 1.500 |\n|  |  |\n"
    assert "<td>a</td>" in sinks.html_table(df)
    sinks.write_overwrite(df, str(tmp_path / "t"))
    sinks.write_overwrite(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    req = spark.createDataFrame([("k1",), ("k2",)], "key string")
    hit, miss = sinks.cache_lookup(req, spark.createDataFrame([("k1", "p"), ("k2", None)], "key string, payload string"))
    assert rows(hit) == [("k1", "p")] and rows(miss) == [("k2",)]


def test_traces(spark, tmp_path):
    e = spark.createDataFrame([("t", 1, 0.0, "a"), ("t", 2, 1.0, None), ("t", 3, 100.0, "b"), ("u", 1, 5.0, None)], "trace string, seq int, t double, step string")
    assert [r.wait for r in traces.replay_waits(e, "trace", "seq", "t", 2.0).orderBy("trace", "seq").collect()] == [0, 0.5, 5.0, 0]
    batch = rows(traces.carry_forward(e, "trace", "seq", "step"), "trace", "seq", "step")
    e.write.parquet(str(tmp_path / "in"))
    stream = traces.carry_forward_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "trace", "seq", "step")
    assert rows(traces.run_available(stream, spark, "carried", str(tmp_path / "ck")), "trace", "seq", "step") == batch


def test_stream_windows_and_sessions(spark, tmp_path):
    rows_ = [(i, f"2024-01-01 0{i % 3}:{10 * (i % 6):02}:00", i % 2, 1.0) for i in range(12)] + [(99, "2024-01-03 00:00:00", 0, 1.0)]
    e = spark.createDataFrame(rows_, "id int, at string, k int, v double").withColumn("at", F.col("at").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    out = traces.run_available(traces.windowed_counts(s, "at", "k", "v", "1 hour", "1 hour"), spark, "wins", str(tmp_path / "c1"))
    want = traces.windowed_counts(e.where("id < 99"), "at", "k", "v", "1 hour")
    assert rows(out) == rows(want)
    out = traces.run_available(traces.deduplicated(s.union(s), "id", "at"), spark, "dedup", str(tmp_path / "c2"))
    assert out.count() == 13
    assert traces.sessions(e, "at", "k", "30 minutes").agg(F.sum("n")).first()[0] == 13


def test_strict_parsing_can_fail_or_report(spark):
    texts = [("ok", "\n## Điều 1\na\n### Khoản 1\nb"), ("early", "x\n## Điều 1\na"), ("kind", "## Điều 1\na\n### Điều 2\nb"), ("level", "# Điều 1\n## Phụ lục I\na"), ("deep", "## Điều 1\n###### x\nb"), ("none", None), ("empty", "")]
    df = spark.createDataFrame(texts, "norm_id string, body string").withColumn("problem", F.lit(1))
    assert rows(documents.heading_problems(df)) == [("deep", 1, "level"), ("early", 0, "text before a heading"), ("kind", 2, "kind"), ("level", 0, "level")]
    sound = df.where("norm_id in ('ok', 'none', 'empty')")
    assert rows(documents.leaf_units(sound, raising=True), "norm_id", "text") == [("ok", "a"), ("ok", "b")]
    for bad in ("early", "kind", "level", "deep"):
        with pytest.raises(Exception, match=f"of {bad}"):
            documents.leaf_units(df.where(F.col("norm_id") == bad), raising=True).collect()
