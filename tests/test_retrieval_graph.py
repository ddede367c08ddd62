import random
from collections import defaultdict

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from quern.operators import corpus, graph, providers, retrieval, validate


def test_dense_top_k_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0])], "item int, vec array<double>").repartition(5)
    queries = items.where("item < 10").select(F.col("item").alias("q"), "vec")
    for block in (2048, 3):
        got = defaultdict(list)
        for r in retrieval.dense_top_k(queries, items, 4, block).orderBy("q", "rank").collect():
            got[r.q].append(r.item)
        assert all(got[q] == sorted(range(200), key=lambda i: (-round(float(v[q] @ v[i]), 6), i))[:4] for q in range(10))
    assert retrieval.dense_top_k(queries.limit(0), items, 4).count() == 0


def fold(c, k, per_norm, caps):
    """The allocation one unit after the other."""
    norm_of, tier_of = {x["item"]: x["norm"] for x in c}, {x["item"]: x["tier"] for x in c}
    by_score = sorted(c, key=lambda x: (-x["score"], x["item"]))
    dense = sorted((x for x in c if x["dense_rank"] is not None), key=lambda x: (x["dense_rank"], x["item"]))
    seen, order = set(), [x["item"] for x in by_score if x["cited"]]
    for x in dense:
        if x["norm"] not in seen:
            seen.add(x["norm"])
            order.append(x["item"])
    only = {x["norm"] for x in c} - {x["norm"] for x in dense}
    for x in by_score:
        if x["norm"] in only:
            only.discard(x["norm"])
            order.append(x["item"])
    order += [x["item"] for x in by_score]
    out, n_norm, n_tier = [], defaultdict(int), defaultdict(int)
    for i in order:
        if i in out or n_norm[norm_of[i]] >= per_norm or n_tier[tier_of[i]] >= caps.get(tier_of[i], 25) or len(out) >= k:
            continue
        out.append(i)
        n_norm[norm_of[i]] += 1
        n_tier[tier_of[i]] += 1
    return set(out)


def test_capped_allocation_against_fold(spark):
    rng = random.Random(5)
    data = []
    for q in range(40):
        ranks = list(range(30))
        rng.shuffle(ranks)
        for i in range(rng.randrange(1, 25)):
            n = rng.randrange(6)
            data.append(dict(q=q, item=q * 100 + i, norm=f"n{n}", tier=n % 4 + 1, score=rng.randrange(1000) / 1000, dense_rank=ranks[i] if rng.random() < 0.5 else None, cited=rng.random() < 0.1))
    df = spark.createDataFrame([tuple(x.values()) for x in data], "q int, item int, norm string, tier int, score double, dense_rank int, cited boolean")
    caps = {1: 3, 2: 2, 3: 2, 4: 3}
    got = defaultdict(set)
    for r in retrieval.capped_allocation(df, 7, 2, caps).collect():
        got[r.q].add(r.item)
    assert all(got[q] == fold([x for x in data if x["q"] == q], 7, 2, caps) for q in range(40))


def test_budget_and_first_fit_differ(spark):
    df = spark.createDataFrame([("q", 1, 3.0, "x" * 70, False), ("q", 2, 2.0, "x" * 700, False), ("q", 3, 1.0, "x" * 70, False), ("q", 4, 0.5, "x" * 7000, True)], "q string, item long, score double, text string, gold boolean")
    assert rows(retrieval.budget_prune(df, 50), "item") == [(1,)]
    assert rows(retrieval.first_fit(df, 2050), "item") == [(1,), (3,), (4,)]  # 2000 of gold, then 20, not 200, then 20
    assert rows(retrieval.first_fit(df.where("item < 4"), 50), "item") == [(1,), (3,)]


def test_bm25_counts_repeated_query_words(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, None), (4, "")], "item int, text string")
    one = {r.item: r.score for r in retrieval.bm25_top_k(spark.createDataFrame([(1, "c")], "q int, text string"), docs, 5).collect()}
    two = {r.item: r.score for r in retrieval.bm25_top_k(spark.createDataFrame([(1, "c C")], "q int, text string"), docs, 5).collect()}
    assert set(one) == {2} and abs(two[2] - 2 * one[2]) < 1e-5
    postings, terms = retrieval.bm25_index(docs)
    assert postings.count() == 4 and terms.count() == 3


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, ""), (2, "abc"), (3, "x" * 800), (4, None), (5, "  ")], "d int, t string")
    got = rows(retrieval.fixed_chunks(df, "d", "t", 200, 20))
    assert [len(r[2]) for r in got if r[0] == 3] == [200, 200, 200, 200, 80] and [r for r in got if r[0] != 3] == [(2, 0, "abc")]


def test_closure_walks_both_ways_within_hops(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1), "R") for i in range(8)] + [("0", "x", "OTHER")], "src string, dst string, rel string")
    seeds = spark.createDataFrame([("q", "4"), ("q", "4"), ("p", "0")], "q string, node string")
    got = rows(graph.closure(seeds, edges, 2, ["R"]))
    assert got == sorted([("q", "4", 0), ("q", "3", 1), ("q", "5", 1), ("q", "2", 2), ("q", "6", 2), ("p", "0", 0), ("p", "1", 1), ("p", "2", 2)], key=repr)
    assert graph.closure(seeds, edges, 2, []).count() == 2


def test_edges_versions_and_upsert(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    links = spark.createDataFrame([("a", "b", "R"), ("a", "b", "R"), ("a", "z", "R")], "src string, dst string, rel string")
    assert rows(graph.gated_edges(links, nodes)) == [("a", "b", "R")] and rows(graph.dangling_edges(links, nodes)) == [("a", "z", "R")]
    comp = spark.createDataFrame([("c", "new", "2020-01-01", "old", ["2022-03-01", "2021-01-01"]), ("d", "t", "2020-01-01", None, ["2021-01-01"]), ("e", "t", None, "old", [])], "component_id string, text string, valid_from string, original_text string, effective_dates array<string>")
    assert rows(graph.split_versions(comp), "ctv_id", "valid_to", "status", "text") == [("c-v0", "2020-12-31", "superseded", "old"), ("c-v1", "9999-12-31", "active", "new"), ("d-v0", "9999-12-31", "active", "t"), ("e-v0", "9999-12-31", "active", "t")]
    up = spark.createDataFrame([("k", 1, "x"), ("k", 3, "y"), ("k", 2, "z"), ("m", 1, None)], "id string, pos int, v string")
    assert rows(graph.upsert_latest(up, "id", "pos")) == [("k", 3, "y"), ("m", 1, None)]


def test_jurisdictions_and_validity(spark):
    df = spark.createDataFrame([("tp-hcm",), ("multi-juris",), (None,), ("mars",)], "j string")
    assert [r[0] for r in df.select(graph.allowed_jurisdictions(F.col("j"))).collect()] == [["toan-quoc", "tp-hcm"], None, None, ["toan-quoc"]]
    v = spark.createDataFrame([("2020-01-01", None), ("2020-01-01", "2020-02-01"), (None, None)], "a string, b string")
    ok = lambda t: [bool(r[0]) for r in v.select(graph.valid_at(F.lit(t), F.col("a"), F.col("b"))).collect()]
    assert ok("2020-03-01") == [True, False, False] and ok(None) == [True, True, True]


def test_similar_questions_against_all_pairs(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))
    a, b = [(i, text()) for i in range(60)], [(i, text()) for i in range(60)]
    jac = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    want = {(i, j) for i, x in a for j, y in b if jac(x, y) >= 0.6}
    got = {(r.item, r.q) for r in corpus.similar_questions(spark.createDataFrame(a, "item int, text string"), spark.createDataFrame(b, "q int, text string")).collect()}
    assert got == want


def test_slugs_names_and_orphans(spark):
    s = corpus.unique_slugs(spark.createDataFrame([("Điều A",), ("dieu a",), ("Điều A",), (None,)], "name string"))
    assert rows(s) == [("dieu a", "dieu-a"), ("Điều A", "dieu-a-b2")]
    n = corpus.leaking_names(spark.createDataFrame([("Luật Đất đai 2024 sửa đổi",), ("Luật khác",)], "name string"), spark.createDataFrame([("đất đai 2024",), ("",), (None,)], "name string"))
    assert rows(n) == [("Luật Đất đai 2024 sửa đổi", "đất đai 2024")]
    c = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert rows(validate.orphans(c, "k", spark.createDataFrame([("b",)], "p string"), "p")) == [("a", 2)]


def test_providers(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "item int, text string")
    assert [round(sum(x * x for x in r.vec), 5) for r in providers.embed(docs, "text", providers.hash_encoder(16)).orderBy("item").collect()] == [1.0, 0.0]
    pairs = spark.createDataFrame([("q", 1, "x", "aa", 1), ("q", 2, "x", "bbb", 2), ("q", 3, "x", "cc", 3)], "q string, item int, question string, text string, rank int")
    best = providers.rerank(pairs, lambda: lambda ps: np.array([len(t) for _, t in ps]), 2).orderBy("rank").collect()
    assert [r.item for r in best] == [2, 1]
    cache = spark.createDataFrame([], "key string, payload string")
    out = providers.generate(docs, "text", "m", lambda: lambda ps: [f"<{p}>" for p in ps], cache).collect()
    assert {r.payload for r in out} == {"<a b>", "<None>"}
