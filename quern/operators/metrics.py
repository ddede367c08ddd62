"""Scores of cited answers and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("van_ban", "dieu", "khoan", "diem")


def _key(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def matches(pred: Column, gt: Column, level: str = "khoan") -> Column:
    """True if a prediction meets a ground truth: same document and article, deeper fields where the ground truth has them."""
    ok = _key(pred["van_ban"]).eqNullSafe(_key(gt["van_ban"])) & _key(pred["dieu"]).eqNullSafe(_key(gt["dieu"]))
    for field in {"khoan": ["khoan"], "diem": ["khoan", "diem"]}.get(level, []):
        ok &= _key(gt[field]).isNull() | _key(pred[field]).eqNullSafe(_key(gt[field]))
    return ok


def greedy_match(pred: Column, gt: Column, level: str = "khoan") -> Column:
    """One-to-one greedy matching in the order of predictions: struct of ``used`` (per ground truth), ``hit`` (per prediction).

    Each prediction takes the first free ground truth it meets. A fold over the array, so nothing leaves the row.
    """
    init = F.struct(F.array_repeat(F.lit(False), F.size(gt)).alias("used"), F.array().cast("array<boolean>").alias("hit"))

    def step(acc: Column, p: Column) -> Column:
        free = F.filter(F.transform(gt, lambda g, i: F.when(~F.get(acc["used"], i) & matches(p, g, level), i)), lambda i: i.isNotNull())
        at = F.try_element_at(free, F.lit(1))
        return F.struct(F.transform(acc["used"], lambda u, i: u | i.eqNullSafe(at)).alias("used"), F.concat(acc["hit"], F.array(at.isNotNull())).alias("hit"))

    return F.aggregate(pred, init, step)


def _count(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y.eqNullSafe(x))), F.size(F.filter(b, lambda y: y.eqNullSafe(x)))))


def citation_score(pred: Column, gt: Column, level: str = "khoan") -> Column:
    """Precision, recall, F1 and counts at a level: 'van_ban' (multiset), 'dieu', 'khoan' or 'diem' (greedy one-to-one).

    Both empty: 1, 1, 1. No ground truth but predictions: 0, 1, 0. No predictions but ground truth: 0, 0, 0. Null
    lists count as empty.
    """
    empty = F.array().cast("array<struct<dieu:string,khoan:string,diem:string,tiet:string,van_ban:string,loai:string>>")
    p, g = F.coalesce(pred, empty), F.coalesce(gt, empty)
    if level == "van_ban":
        m = multiset_overlap(F.transform(p, lambda c: _key(c["van_ban"])), F.transform(g, lambda c: _key(c["van_ban"])))
    else:
        m = _count(greedy_match(p, g, level)["hit"])
    np_, ng = F.size(p), F.size(g)
    prec = F.when(np_ > 0, m / np_).when(ng == 0, 1.0).otherwise(0.0)
    rec = F.when(ng > 0, m / ng).otherwise(1.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return F.struct(prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), np_.alias("pred_count"), ng.alias("gt_count"), m.alias("match_count"))


def partial_credit(pred: Column, gt: Column, right: float = 1.0, article: float = 0.6, norm: float = 0.3) -> Column:
    """Mean credit per ground truth: full for the clause, less for the article or only the document."""
    best = lambda g: (
        F.when(F.exists(pred, lambda p: matches(p, g, "khoan")), right)
        .when(F.exists(pred, lambda p: matches(p, g, "dieu")), article)
        .when(F.exists(pred, lambda p: _key(p["van_ban"]).eqNullSafe(_key(g["van_ban"]))), norm)
        .otherwise(0.0)
    )
    return F.when(F.size(gt) > 0, F.aggregate(F.transform(gt, best), F.lit(0.0), lambda a, x: a + x) / F.size(gt))


def norms_of(citations: Column) -> Column:
    """Distinct documents of a list of citations."""
    keys = F.transform(citations, lambda c: _key(c["van_ban"]))
    return F.array_distinct(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.isNotNull()))


def norm_recall(pred: Column, gt: Column) -> Column:
    """Share of the ground truth's documents that are predicted; without any, 1 if none is predicted, else 0."""
    p, g = norms_of(pred), norms_of(gt)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, p)) / F.size(g)).when(F.size(p) == 0, 1.0).otherwise(0.0)


def negative_correct(pred: Column, gap_type: Column) -> Column:
    """For negative questions, whether nothing was cited; null for others."""
    return F.when(gap_type == "negative", F.coalesce(F.size(pred), F.lit(0)) <= 0)


def lower_quantile(values: Column, q: float) -> Column:
    """The element at index ``int(q * (n - 1))`` of the sorted values; null without any. The values are one group's."""
    clean = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    return F.try_element_at(clean, (F.floor(F.lit(q) * (F.size(clean) - 1)) + 1).cast("int"))


def clipped_quantile(values: Column, q: float) -> Column:
    """The element at index ``min(n - 1, int(q * n))`` of the sorted values; null without any."""
    clean = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    return F.try_element_at(clean, (F.least(F.size(clean) - 1, F.floor(F.lit(q) * F.size(clean))) + 1).cast("int"))


#: Ranges of values that are counted to find a quantile.
RANGES = 64


def ranked_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str = "q") -> DataFrame:
    """The index rule of ``lower_quantile`` for groups of any size: distinct values are counted first, then a running count finds it.

    Groups with nothing but nulls give no row. Values are numbers; they are cut into ranges that are counted first, so
    neither a group nor the whole, where there are no keys, goes through one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    splits = sorted(set(df.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)))
    ranged = counts.withColumn("__r", F.size(F.filter(F.array(*[F.lit(x) for x in splits]), lambda x: x < F.col("__v"))) if splits else F.lit(0))
    sums = ranged.groupBy(*keys, "__r").agg(F.sum("__n").alias("__in"))
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = sums.select(*keys, "__r", (F.sum("__in").over(every.orderBy("__r")) - F.col("__in")).alias("__from"), F.col("__in"), F.sum("__in").over(every).alias("__all"))
    at = F.floor(F.lit(q) * (F.col("__all") - 1))
    hit = offsets.where((F.col("__from") <= at) & (F.col("__from") + F.col("__in") > at)).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__r").alias("__hit"), (at - F.col("__from")).alias("__at"))
    same = F.col("__r") == F.col("__hit")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = ranged.join(hit, same)
    run = inside.withColumn("__to", F.sum("__n").over((Window.partitionBy(*keys) if keys else Window.partitionBy("__r")).orderBy("__v")))
    return run.where((F.col("__to") > F.col("__at")) & (F.col("__to") - F.col("__n") <= F.col("__at"))).select(*keys, F.col("__v").alias(name))


def scored(results: DataFrame) -> DataFrame:
    """Results with the scores that are recomputed from their citation lists."""
    p, g = F.col("pred_citations"), F.col("ground_truth_citations")
    s, d = citation_score(p, g, "khoan"), citation_score(p, g, "dieu")
    return results.withColumns({"score": s, "score_dieu": d, "recall_norm": norm_recall(p, g), "neg_ok": negative_correct(p, F.col("gap_type"))})


def error_taxonomy(results: DataFrame, context: str | None = None) -> DataFrame:
    """One row per error of a result: ``result_id, gap_type, error, van_ban``.

    Errors: 'negative_fail' (a negative question with citations); for ground truths nobody met 'generation_fail' if the
    document stands in the context, else 'retrieval_fail'; 'over_cite' for each prediction that met nothing. Without
    a context column a document counts as retrieved if any prediction names it.
    """
    p, g = F.col("pred_citations"), F.col("ground_truth_citations")
    m = greedy_match(p, g, "khoan")
    base = results.where("pred_citations is not null and ground_truth_citations is not null").withColumn("m", m)
    held = (lambda v: F.coalesce(F.contains(F.col(context), v), F.lit(False))) if context else (lambda v: F.array_contains(norms_of(p), _key(v)))
    lost = F.transform(
        F.filter(F.arrays_zip(g.alias("c"), F.col("m.used").alias("u")), lambda x: ~x["u"]),
        lambda x: F.struct(F.when(F.coalesce(held(x["c"]["van_ban"]), F.lit(False)), F.lit("generation_fail")).otherwise(F.lit("retrieval_fail")).alias("error"), x["c"]["van_ban"].alias("van_ban")),
    )
    over = F.transform(F.filter(F.arrays_zip(p.alias("c"), F.col("m.hit").alias("u")), lambda x: ~x["u"]), lambda x: F.struct(F.lit("over_cite").alias("error"), x["c"]["van_ban"].alias("van_ban")))
    neg = F.when(F.size(p) > 0, F.array(F.struct(F.lit("negative_fail").alias("error"), F.lit(None).cast("string").alias("van_ban"))))
    kinds = F.when(F.col("gap_type") == "negative", neg).otherwise(F.concat(lost, over))
    return base.select("result_id", "gap_type", F.explode(kinds).alias("e")).select("result_id", "gap_type", "e.error", "e.van_ban")


def ranking_metrics(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Recall at k and reciprocal rank per query: ``ranked(q, item, rank)`` (1-based), ``truth(q, item)``.

    Queries without truth are left out; a query whose truth never appears has 0 everywhere.
    """
    t = truth.select("q", "item").distinct()
    best = ranked.join(t, ["q", "item"], "left_semi").groupBy("q", "item").agg(F.min("rank").alias("rank"))
    joined = t.join(best, ["q", "item"], "left")
    recalls = [(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_{k}") for k in ks]
    return joined.groupBy("q").agg(*recalls, F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"))


def verdict(grounded: Column, supported: Column | None = None, drop_unsupported: bool = False) -> Column:
    """What becomes of a citation: 'drop' where the context doesn't hold it, 'flag' (or 'drop') where a judge found its text doesn't support it, else 'keep'."""
    out = F.when(~F.coalesce(grounded, F.lit(False)), F.lit("drop"))
    if supported is not None:
        out = out.when(~F.coalesce(supported, F.lit(True)), F.lit("drop" if drop_unsupported else "flag"))
    return out.otherwise(F.lit("keep"))
