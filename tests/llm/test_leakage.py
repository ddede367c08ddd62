import os
import random

import numpy as np
import pytest
from conftest import rows

from quern.llm import leakage
from quern.llm.words import words

VOCAB = ["đất", "Điều", "luật", "khoản", "hồ", "sơ", "người", "nộp", "thuế", "biên", "bản", "Đồng", "Nai", "2024", "số", "cấp", "xã", "ký", "tên", "ranh"]


def test_words_look_through_what_cannot_be_seen():
    assert words("Đ\u200bIỀU **1**: «khoa\u0309n» <b>x</b>\u00ady na**y** ｗｉｄｅ") == ["dieu", "1", "khoan", "xy", "nay", "wide"]
    assert words(None) == [] and words("") == [] and words("—…") == []


def dirty(rng, ws):
    return " ".join(w.upper() if rng.random() < 0.2 else f"**{w}**," if rng.random() < 0.2 else w for w in ws)


def brute(texts, items, window, most=0):
    """(sample, item) pairs by comparing every window with every window."""
    out = set()
    for s, t in texts:
        w = words(t)
        for i, q in items:
            v = words(q)
            if any(leakage.edits(w[a : a + window], v[b : b + window], most) <= most for a in range(len(w) - window + 1) for b in range(len(v) - window + 1)):
                out.add((s, i))
    return out


def data(seed, window, n=30):
    rng = random.Random(seed)
    items = [(f"q{i}", " ".join(rng.choice(VOCAB) for _ in range(rng.randrange(0, 14)))) for i in range(10)] + [("q0", None), (None, "x"), ("none", None)]
    texts = []
    for i in range(n):
        w = [rng.choice(VOCAB) for _ in range(rng.randrange(0, 30))]
        q = (rng.choice(items)[1] or "").split()
        k = rng.randrange(0, 12)
        at = rng.randrange(0, max(1, len(q)))
        w[len(w) // 2 : len(w) // 2] = q[at : at + k]
        texts.append((f"s{i}", dirty(rng, w)))
    return texts + [("s0", texts[0][1]), ("e", ""), ("n", None)], items


def frames(spark, texts, items):
    return spark.createDataFrame(texts, "sample_id string, text string"), spark.createDataFrame(items, "item_id string, text string")


def test_exact_leaks_against_brute_force(spark):
    texts, items = data(1, 5)
    t, i = frames(spark, texts, items)
    want = brute(texts, [x for x in items if x[0]], 5)
    assert {r[:2] for r in rows(leakage.leaks(t, i, window=5), "sample_id", "item_id")} == want and want
    # in blocks of few items it's the same
    assert {r[:2] for r in rows(leakage.leaks(t, i, window=5, shared_windows=30), "sample_id", "item_id")} == want
    assert leakage.leaks(t.limit(0), i, window=5).count() == 0 and leakage.leaks(t, i.limit(0), window=5).count() == 0


def test_near_leaks_reach_the_recall(spark):
    texts, items = data(2, 6, 60)
    t, i = frames(spark, texts, items)
    want = brute(texts, [x for x in items if x[0]], 6, 1)
    got = {r[:2] for r in rows(leakage.leaks(t, i, max_edits=1, window=6), "sample_id", "item_id")}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_equal_windows_have_equal_keys_and_others_do_not():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 63, 40, np.uint64)
    codes = np.r_[a, a[:20]]
    for w in leakage.walks(3):
        k = w.keys(codes, np.arange(0, 51))
        # neighbours are few edits apart and may share keys; windows without common words don't
        assert k[0] == k[40] and k[10] == k[50] and len({int(k[i]) for i in (0, 10, 20, 30)}) == 4
    assert leakage.tables_needed(0) == 1 and 1 < leakage.tables_needed(1) <= leakage.tables_needed(2)


def test_report_lists_items_without_leaks(spark):
    t, i = frames(spark, [("s", "a b c d e f")], [("x", "b c d e"), ("y", "z z z z")])
    assert rows(leakage.leak_report(leakage.leaks(t, i, window=4), i)) == [("x", 1, 1), ("y", 0, 0)]


def brute_lengths(texts, items, window, most):
    """(sample, item) pairs by comparing text windows of every length that edits can leave with every window of the items."""
    out = set()
    for s, t in texts:
        w = words(t)
        for i, q in items:
            v = words(q)
            if any(leakage.edits(w[a : a + n], v[b : b + window], most) <= most for n in range(window - most, window + most + 1) for a in range(len(w) - n + 1) for b in range(len(v) - window + 1)):
                out.add((s, i))
    return out


def test_inserted_and_deleted_words_are_near_leaks(spark):
    rng = random.Random(3)
    items = [(f"q{i}", " ".join(f"w{rng.randrange(4000)}" for _ in range(10))) for i in range(60)]
    texts = []
    for i, (_, q) in enumerate(items):
        w = q.split()
        for at in range(10):
            texts += [(f"i{i}.{at}", " ".join(["x", *w[:at], "y", *w[at:], "z"])), (f"d{i}.{at}", " ".join(w[:at] + w[at + 1 :]))]
            texts += [(f"c{i}.{at}", " ".join(["x", *w[:at], "y", *w[at + 1 :], "z"])), (f"n{i}.{at}", " ".join([*w[:at][:-1], "y", "y", *w[at:][1:]]))]
    t, i = frames(spark, texts, items)
    want = brute_lengths(texts, items, 10, 1)
    got = {r[:2] for r in rows(leakage.leaks(t, i, max_edits=1), "sample_id", "item_id")}
    assert got <= want
    for kind in "idc":
        for at in range(10):
            some = {x for x in want if x[0].startswith(kind) and x[0].endswith(f".{at}")}
            assert len(some) == 60 and len(got & some) >= 0.85 * 60, (kind, at, len(got & some))


def test_candidates_with_edits_lose_no_exact_leak(spark):
    texts, items = data(4, 5)
    t, i = frames(spark, texts, items)
    want = rows(leakage.leaks(t, i, window=5), "sample_id", "item_id", "n_windows")
    assert want and rows(leakage.leaks(t, i, max_edits=1, window=5, within=0), "sample_id", "item_id", "n_windows") == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_recall_on_edits_planted_into_the_samples(spark):
    """One word of 10 of a real question is inserted, deleted or changed, and stands inside a real context."""
    rng = random.Random(6)
    items = [(r.id, r.question) for r in spark.read.parquet("/root/testdata/sf0.1/eval_question.parquet").select("id", "question").distinct().collect()]
    contexts = [r.context for r in spark.read.parquet("/root/testdata/sf0.1/train_sample.parquet").where("context is not null").select("context").limit(500).collect()]
    texts, want = [], set()
    for n in range(1500):
        i, q = rng.choice([x for x in items if len(words(x[1])) >= 10])
        w = words(q)
        at, k = rng.randrange(len(w) - 9), rng.randrange(10)
        part, kind = w[at : at + 10], n % 3
        part[k : k + (kind != 0)] = [] if kind == 1 else [f"khac{n}"]
        c = rng.choice(contexts).split()
        m = rng.randrange(len(c) + 1)
        texts.append((f"t{n}", " ".join([*c[:m], *part, *c[m:]])))
        want.add((f"t{n}", i))
    t, i = frames(spark, texts, items)
    got = {r[:2] for r in rows(leakage.leaks(t, i, max_edits=1), "sample_id", "item_id")}
    assert len(got & want) >= 0.9 * len(want)
    print(f"recall {len(got & want) / len(want):.3f}")
