import random
import unicodedata

from conftest import rows
from pyspark.sql import functions as F

from quern.llm import lookalikes as L

PLAIN = "Điều 5: diện tích ½ thửa № 7 rộng 30 m² – “đất ở” ‘x’ § 3… café naïve, größer."
CASES = {
    unicodedata.normalize("NFD", "Người nộp"): "Người nộp",
    "thửa\u00a0đất\u3000nào\u202fđó": "thửa đất nào đó",
    "k\u200bết\ufeff qu\u00adả\u2060": "kết quả",
    "ｎｇày ３２ trên": "ngày 32 trên",
    "quуền tіếp cận": "quyền tiếp cận",
    "khοản \u039ahi": "khoản Khi",
    "\u00d0iều 9, \u0189ơn": "Điều 9, Đơn",
    "\u0391 neighbouring owner": "A neighbouring owner",
    "o\u0340": "ò",
}
KEPT = [PLAIN, "", "thuật ngữ “реестр жилья” và кадастр", "Tên gọi gốc: δήμος.", "Опекун хранит копию акта о рождении и с ним.", "申请人，应在81天内：提交。", "户籍　登记", "μ là muy, 5 µm"]


def test_canonical():
    assert {a: L.canonical(a) for a in CASES} == CASES
    assert [L.canonical(k) for k in KEPT] == KEPT and L.canonical(None) is None


def test_canonical_is_idempotent_and_skeletons_agree():
    rng = random.Random(1)
    base = "Người nộp hồ sơ phải ký nhận biên bản tại Đồng Nai"
    swaps = {v: k for k, v in L.FOREIGN.items()}
    for _ in range(300):
        t = "".join(swaps[c] if c in swaps and rng.random() < 0.1 else c + "\u200b" if rng.random() < 0.05 else "\u00a0" if c == " " and rng.random() < 0.2 else c for c in base)
        t = unicodedata.normalize(rng.choice(["NFC", "NFD"]), t)
        assert L.canonical(L.canonical(t)) == L.canonical(t)
        assert L.skeleton(t) == L.skeleton(base)


def test_plain_texts_are_their_own_canonical_form(spark):
    texts = [PLAIN, *KEPT, *CASES, *(chr(c) + "a" for c in range(1, 0x2500)), *(chr(c) for c in range(0x2500, 0x10000, 7) if not 0xD800 <= c < 0xE000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [r.t for r in df.where(L.is_plain(F.col("t"))).collect()]
    assert PLAIN in plain and [t for t in plain if L.canonical(t) != t] == []


def test_frames(spark):
    df = spark.createDataFrame([("t", str(i), k) for i, k in enumerate(CASES)] + [("t", "n", None), ("t", "p", PLAIN), ("t", "long", "x" * 200000 + "\u200b")], "table_name string, row_key string, text string")
    got = {r.row_key: r.canonical for r in L.canonical_rows(df, "text").collect()}
    assert got == {str(i): v for i, v in enumerate(CASES.values())} | {"long": "x" * 200000}
    assert L.canonical_rows(df.limit(0), "text").count() == 0
    g = spark.createDataFrame([("có",), ("сó",), ("có",), ("khác",), (None,)], "t string")
    assert rows(L.skeleton_groups(g, "t"), "n_forms", "n_rows") == [(2, 3)]


def test_found_rows_are_candidates_grouped_by_skeleton(spark):
    # nothing that canonical changes is lost on the way, whatever the character and what stands beside it
    odd = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for t in [*CASES, *KEPT, *(f(c) for c in odd for f in (str, lambda c: f"a{c}b"))]:
        assert L.canonical(t) == t or L.look(t) is not None, repr(t)
    assert L.look(None) is None and L.look(PLAIN) is None and L.look("") is None
    df = spark.createDataFrame([("t", "1", "сó"), ("u", "2", "có\u200b"), ("u", "3", "có"), ("t", "4", "ó с"), ("t", "5", None)], "table_name string, row_key string, text string")
    got = {r.row_key: r.look for r in L.candidates(df, "text").collect()}
    assert set(got) == {"1", "2", "4"} and got["1"] == got["2"] != got["4"]
    assert "hashpartitioning(look" in L.canonical_rows(df, "text")._jdf.queryExecution().toString()
    assert rows(L.canonical_rows(df, "text")) == [("t", "1", "có"), ("t", "4", "ó c"), ("u", "2", "có")]


def test_groups_span_all_three_tables(spark, tmp_path):
    from quern.llm.queries import QUERIES

    long = "Điều " * 50000
    for name, key, col, texts in [("eval_result", "result_id", "answer", ["có", long + "сó", None, "x"]), ("text_unit", "id", "text", ["сó", long + "có", "y"]), ("candidate", "cand_id", "term_norm", ["c\u200bó", "có", "z", "ｚ", "x"])]:
        spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], f"{key} string, {col} string").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted((r.n_forms, r.n_rows, r.skeleton) for r in QUERIES["p6_groups"](spark, str(tmp_path)).collect())
    assert got == sorted([(3, 4, L.skeleton("có")), (2, 2, L.skeleton(long + "có")), (2, 2, "z")])


def test_other_alphabets_and_variants_of_letters():
    same = {"h\u0585 sơ": "ho sơ", "\U0001d407ồ sơ": "Hồ sơ", "\u217fột": "một", "\ua4e2ố": "Số", "\u13a0iều": "Diều", "hồ s\u2c9f": "hồ so", "Điều \u2163": "Điều IV", "v\u1d0f": "vo", "\u01c6 x": "dž x"}
    assert {a: L.canonical(a) for a in same} == same
    assert all(L.skeleton(a) == L.skeleton(b) and L.look(a) is not None for a, b in same.items())
    kept = ["\u0540\u0561\u0575\u0561\u057d\u057f\u0561\u0576", "\u13e3\u13b3\u13a9", "\u2115 \u211d \u2460 \u2103"]
    assert [L.canonical(k) for k in kept] == kept
