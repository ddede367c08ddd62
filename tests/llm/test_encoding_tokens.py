import random

import pytest
from pyspark.sql import functions as F

from quern.llm import encoding as E
from quern.llm import tokens as T

CLEAN = (
    "Người nộp hồ sơ phải ký nhận biên bản bàn giao trong thời hạn {n} ngày làm việc kể từ ngày nhận đủ hồ sơ theo quy định tại Điều {n}.",
    "Diện tích được công nhận tại vùng bãi bồi không vượt quá {n} m², trừ phần đất làm muối đã ghi trong giấy chứng nhận đã cấp.",
    "Ghi chú: § {n}, sai số ± 5 %, ký hiệu ® và © của biểu mẫu «Giao trẻ cho người nhận nuôi».",
    "ĐIỀU KHOẢN CHUYỂN TIẾP; ĐÃ THẨM TRA VÀ CÂN NHẮC “ĐÔ THỊ Ô CŨ” Ấ",
    "Le voisin immédiat doit déposer l’extrait de naissance à l’issue de {n} jours d’affichage « reçu ».",
    "The survey crew must keep the corrected entry “a copy of the receipt” within {n} working days – see the café.",
    "Đối với đất trồng lúa một vụ, cơ quan thuế địa phương cần đính chính thông báo thuế; mức thu là {n}.000 đồng cho mỗi hồ sơ.",
)


def garble(text: str, codec: str) -> str | None:
    """UTF-8 read as another encoding; None where bytes would be lost. Undefined bytes pass as the characters of their number."""
    if codec == "tcvn3":
        return text.translate(str.maketrans(E.TCVN3_AS, E.TCVN3))
    out = ""
    for b in text.encode():
        c = bytes([b]).decode(codec, "ignore")
        out += c if len(c) == 1 else chr(b)
    return out


def documents(n=400):
    rng = random.Random(1)
    return [(i, " \n".join(rng.choice(CLEAN).format(n=rng.randrange(1, 400)) for _ in range(6))) for i in range(n)]


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string")
    return E.train(df, "doc_id", "text")


def test_tables_fit():
    assert len(E.TCVN3) == len(E.TCVN3_AS) == len(set(E.TCVN3))


def test_clean_texts_stay(trained):
    model, margin = trained
    scorer = E.Scorer(model)
    assert all(E.restored(t, scorer, margin) == ([], t) for _, t in documents(60))


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1250", "cp1251", "cp1258", "mac_roman", "cp437", "tcvn3"])
def test_round_trip(trained, codec):
    """Held-out accuracy: whole texts and single words come back."""
    model, margin = trained
    scorer = E.Scorer(model)
    rng = random.Random(2)
    whole = hit = right = n = 0
    for _, t in documents(40):
        bad = garble(t, codec)
        used, back = E.restored(bad, scorer, margin)
        whole += bool(used) and (back == t or codec == "tcvn3")
        w = rng.choice([x for x in t.split(" ") if len(x.strip()) > 2 and not x.isascii() and x.islower() and garble(x, codec) != x])
        one = t.replace(w, garble(w, codec), 1)
        used, back = E.restored(one, scorer, margin)
        n += 1
        hit += bool(used)
        right += back == t
    assert whole >= 0.95 * n and hit >= 0.9 * n and right >= 0.85 * n


def test_frame(spark):
    docs = documents()
    bad = [(1000, docs[0][1].replace("Điều", garble("Điều", "cp1252")) + " niêm yáº¿t"), (1001, garble(garble(docs[1][1], "latin-1"), "latin-1")), (1002, "Di\ufffd\ufffdn tích"), (1003, None), (1004, ""), (1005, "đơn " * 30000 + garble("được", "cp1252"))]
    df = spark.createDataFrame(docs + bad, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("chains", F.lit(1))
    got = {r.key: r for r in E.garbled(df).collect()}
    assert set(got) == {1000, 1001, 1002, 1005}
    assert "niêm yết" in got[1000].restored and got[1001].restored == docs[1][1] and got[1005].restored.endswith("được") and got[1002].chains == []
    assert E.garbled(df.limit(0)).count() == 0


TEXTS = ["it's", "it's we'll 'tis", "'street 's  x\n\n y\t\tz ", "a  b   ", "\n\n\n", "x'lly don't''s", "½ m² 12ab ٣", "😀 hi", None, "", " ", "\t", "Đất đai  \u00a0 x\u3000y", "a\x1cb \x85c", "…''re 'S", "l'l'll"]


def test_counts_equal_the_tokenizer():
    c = T.TokenCounter(f"{T.TOKENIZER_DIR}/{T.TOKENIZER_FILE}")
    rng = random.Random(3)
    texts = TEXTS + [t for _, t in documents(50)] + ["".join(rng.choice("ab 'sldtmrev1²Đ\n\t .,\u00a0é") for _ in range(rng.randrange(40))) for _ in range(2000)]
    assert c.count(texts).tolist() == [len(c.encoding.encode_ordinary(t)) if t else 0 for t in texts]
    old, T.KNOWN_WORDS = T.KNOWN_WORDS, 50
    try:
        assert c.count(texts).tolist() == [len(c.encoding.encode_ordinary(t)) if t else 0 for t in texts]
    finally:
        T.KNOWN_WORDS = old


def test_sizes_of_a_frame(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r.n_tokens for r in T.token_sizes(df, "text", ["doc_id"]).collect()}
    assert got[8] == got[9] == 0 and got[0] == 2


def test_words_without_odd_signs_are_found(trained):
    """Garbled words that are made of ordinary letters only, as single-byte codes give them."""
    model, margins = trained
    scorer = E.Scorer(model)
    for good in ("được công nhận", "giấy chứng nhận", "trong thời hạn"):
        bad = garble(good, "tcvn3")
        assert E.restored(f"Theo biên bản {bad} mới.", scorer, margins) == (["tcvn3"], f"Theo biên bản {good} mới.")


def test_all_passages_of_a_text_are_restored(trained):
    model, margins = trained
    scorer = E.Scorer(model)
    clean = ["công nhận", "hồ sơ", "tại vùng", "địa phương"] * 1250
    text = " ngày mới ký ngay ".join(garble(p, ("cp1252", "cp437", "mac_roman")[i % 3]) for i, p in enumerate(clean))
    used, back = E.restored(text, scorer, margins)
    assert back == " ngày mới ký ngay ".join(clean) and len(used) >= 3


def test_margins_tell_clean_from_garbled():
    from collections import Counter

    # one garbled passage among the clean records doesn't move the margin over the planted ones
    assert 8 <= E._margin(Counter({0: 990, 6: 9, 43: 1}), Counter({g: 50 for g in range(20, 60)}), 1000) <= 20
    assert E._margin(Counter({0: 900, 30: 100}), Counter({g: 50 for g in range(20, 60)}), 1000) > 30
    assert E._margin(Counter(), Counter(), 0) == E.LEAST_MARGIN


def test_model_and_margins_come_from_all_clean_records(spark, monkeypatch):
    """Each of more records than a sample would hold has a word of its own; workers hand counts on in between."""
    from collections import Counter

    monkeypatch.setattr(E, "KNOWN_WORDS", 1000, raising=False)
    n, told = 13_000, []
    real = E._margin
    monkeypatch.setattr(E, "_margin", lambda *a: told.append(a) or real(*a))
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("hồ\tsơ số "), "id", F.lit("  được ghi\n"), "id").alias("text"))
    df = df.unionByName(spark.createDataFrame([(n, garble("giấy tờ", "cp1252")), (n + 1, None), (n + 2, "")], "doc_id long, text string"))
    model, margins = E.train(df, "doc_id", "text")
    every = E.grams(Counter(w for i in range(n) for w in f"hồ sơ số {i} được ghi {i}".split()))
    assert sum(model.n, Counter()) == every and model.total == sum(c for g, c in every.items() if len(g) == 1)
    assert {a[2] for a in told} == {n} and len(told) == len(margins) == len(E.CHAINS)
    planted = dict(zip(E.CHAINS, (sum(a[1].values()) for a in told)))
    assert planted["utf-8 as cp1252"] == planted["utf-8 as koi8_r"] == 4 * n


def test_clean_records_are_told_by_their_words():
    clean = E.Clean()
    texts = [t for _, t in documents(40)]
    texts += [garble(t, c) for t in texts for c in ("cp1252", "cp1251", "tcvn3")] + ["a\u00a0b", "é É", "éÉ", "x\u2028y", "x ¡ y", "x¡ y", "Ã\n¡", "Ã¡", "", "日本"]
    assert [clean(set(E._words(t))) for t in texts] == [not E.SUSPICIOUS.search(t) for t in texts]
    assert not any(clean({w}) for w in ("QUYá»€N", "â€œthe", "THá»œI", "Ä‘ang", "há»“i"))
    assert all(clean({w}) for w in ("QUYỀN”", "XÃ”", "ĐÃ–", "Ô…", "là…”", "quá…”", "É”", "“Ă”", "“the"))


def test_frequent_garbled_words_are_not_learnt(spark):
    """As in a large table, where even rare ones are many: the model must not take them for clean text."""
    docs = [(i, t + f"\nsee the entry â€œthe receipt” {i}; THá»œI HẠN" * (i % 4 == 0)) for i, t in documents()]
    assert {r.key for r in E.garbled(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {i for i, _ in docs if i % 4 == 0}
