import math
import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from quern.operators import metrics, stats

CITE = "struct<dieu:string,khoan:string,diem:string,tiet:string,van_ban:string,loai:string>"


def cite(d, k=None, v="l", m=None):
    return (d, k, m, None, v, "dieu")


def score(spark, pred, gt, level="khoan"):
    df = spark.createDataFrame([(pred, gt)], f"pred_citations array<{CITE}>, ground_truth_citations array<{CITE}>")
    s = df.select(metrics.citation_score(F.col("pred_citations"), F.col("ground_truth_citations"), level).alias("s")).first().s
    return s.precision, s.recall, s.f1, s.match_count


def test_citation_score_cases(spark):
    assert score(spark, [cite("3", "1"), cite("3", "2")], [cite("3", "1"), cite("3", "2"), cite("3", "3")]) == (1, 2 / 3, 0.8, 2)
    assert score(spark, [cite("6", "1"), cite("6", "2")], [cite("6")])[:3] == (0.5, 1, 2 / 3)
    assert score(spark, [cite("5", "1"), cite("7")], [cite("6")])[3] == 0
    assert score(spark, [cite("3", "1", "Luat-DD ")], [cite("3", "1", "luat-dd")])[2] == 1
    assert score(spark, [], [])[:3] == (1, 1, 1) and score(spark, None, None)[:3] == (1, 1, 1)
    assert score(spark, [cite("1")], [])[:3] == (0, 1, 0) and score(spark, [], [cite("1")])[:3] == (0, 0, 0)
    assert score(spark, [cite("1", v="a"), cite("2", v="a")], [cite("9", v="a"), cite("9", v="b")], "van_ban")[3] == 1


def brute(pred, gt):
    used, n = [False] * len(gt), 0
    for p in pred:
        for i, g in enumerate(gt):
            if not used[i] and p[4] == g[4] and p[0] == g[0] and (g[1] is None or p[1] == g[1]):
                used[i], n = True, n + 1
                break
    return n


def test_greedy_match_against_brute_force(spark):
    rng = random.Random(3)
    one = lambda: cite(rng.choice("12"), rng.choice(["1", "2", None]), rng.choice("ab"))
    data = [([one() for _ in range(rng.randrange(5))], [one() for _ in range(rng.randrange(5))]) for _ in range(300)]
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(data)], f"i int, p array<{CITE}>, g array<{CITE}>")
    got = {r.i: r.m for r in df.select("i", metrics.citation_score(F.col("p"), F.col("g"))["match_count"].alias("m")).collect()}
    assert got == {i: brute(p, g) for i, (p, g) in enumerate(data)}


def test_norm_recall_and_errors(spark):
    schema = f"result_id long, gap_type string, pred_citations array<{CITE}>, ground_truth_citations array<{CITE}>"
    df = spark.createDataFrame(
        [
            (1, "gap1", [cite("1", v="a"), cite("2", v="b")], [cite("1", v="a"), cite("3", v="b"), cite("1", v="c")]),
            (2, "negative", [cite("1")], []),
            (3, "negative", [], []),
            (4, None, None, None),
        ],
        schema,
    )
    r = {x.result_id: x.r for x in df.select("result_id", metrics.norm_recall(F.col("pred_citations"), F.col("ground_truth_citations")).alias("r")).collect()}
    assert r == {1: 2 / 3, 2: 0.0, 3: 1.0, 4: 1.0}
    e = rows(metrics.error_taxonomy(df), "result_id", "error", "van_ban")
    assert e == sorted([(1, "generation_fail", "b"), (1, "retrieval_fail", "c"), (1, "over_cite", "b"), (2, "negative_fail", None)], key=repr)


def test_partial_credit(spark):
    df = spark.createDataFrame([([cite("1", "1", "a")], [cite("1", "1", "a"), cite("1", "2", "a"), cite("9", "9", "a"), cite("1", "1", "z")])], f"p array<{CITE}>, g array<{CITE}>")
    assert math.isclose(df.select(metrics.partial_credit(F.col("p"), F.col("g")).alias("x")).first().x, (1 + 0.6 + 0.3) / 4)


def test_quantile_rules(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "v double")
    a = df.agg(F.collect_list("v").alias("v"))
    assert a.select(metrics.lower_quantile(F.col("v"), 0.95).alias("x"), metrics.clipped_quantile(F.col("v"), 0.95).alias("y")).first()[:] == (9.0, 10.0)
    assert metrics.ranked_quantile(df, [], "v", 0.95).first()[0] == 9.0
    assert metrics.ranked_quantile(df.where("v is null"), [], "v", 0.95).count() == 0


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("p", "z", 1)], "q string, item string, rank int")
    truth = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("p", "y")], "q string, item string")
    got = {r.q: (r.recall_1, r.recall_5, r.mrr) for r in metrics.ranking_metrics(ranked, truth, (1, 5)).collect()}
    assert got == {"q": (0.0, 0.5, 0.5), "p": (0.0, 0.0, 0.0)}


def test_bootstrap_and_wilcoxon():
    assert stats.bootstrap(np.array([]), 100, 1) == (0.0, 0.0, 0.0)
    v = np.array([0.1, 0.4, -0.2, 0.3, 0.0])
    a, b = stats.bootstrap(v, 1000, 42), stats.bootstrap(v, 1000, 42)
    assert a == b and a[1] <= a[0] <= a[2]
    assert math.isnan(stats.wilcoxon_p(np.zeros(4)))
    assert math.isclose(stats.wilcoxon_p(np.array([0.3, 0.4, 0.5, 0.2, 0.6, 0.35, 0.45])), 2 / 2**7)
    assert stats.wilcoxon_p(np.array([1.0, -1, 1, -1, 1, -1] * 20)) > 0.5


def test_win_loss_tie_and_kappa(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate([0.1, -0.2, 0.0, 0.3, 0.0])], "id int, delta double")
    assert stats.win_loss_tie(d).first()[:3] == (2, 1, 2)
    k = lambda pairs, f=stats.cohen_kappa: f(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first().kappa
    assert k([(1, 1), (2, 2), (3, 3)]) == 1 and math.isclose(k([(0, 1), (1, 0)]), -1) and math.isnan(k([])) and k([(1, 1)]) == 1
    assert k([(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)], stats.weighted_kappa) < -0.5 and math.isnan(k([], stats.weighted_kappa))


def test_pairwise_kappa_equals_plain_kappa(spark):
    rng = random.Random(4)
    data = [(r, i, rng.randrange(3)) for r in "abc" for i in range(40) if rng.random() < 0.9]
    by = {(r, i): s for r, i, s in data}
    got = {(x.r1, x.r2): x.kappa for x in stats.pairwise_kappa(spark.createDataFrame(data, "rater string, iid int, score int")).collect()}
    for (p, q), k in got.items():
        both = [(by[p, i], by[q, i]) for i in range(40) if (p, i) in by and (q, i) in by]
        n = len(both)
        po = sum(x == y for x, y in both) / n
        pe = sum(sum(x == s for x, _ in both) * sum(y == s for _, y in both) for s in range(3)) / n**2
        assert math.isclose(k, (po - pe) / (1 - pe))


def test_split_and_sample(spark):
    df = spark.createDataFrame([(i, f"d{i % 7}" if i % 7 else None) for i in range(70)], "i int, doc string")
    out = stats.split_by_group(df, "doc", 0.2).collect()
    assert len(out) == 70 and len({(r.doc, r.split) for r in out}) == 7 and 14 <= sum(r.split == "val" for r in out) <= 30
    s = stats.stratified_sample(df, "doc", "i", 14, 7)
    assert s.count() == 14 and s.groupBy("doc").count().agg(F.max("count")).first()[0] == 2
