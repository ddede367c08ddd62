"""Inferential statistics over evaluation results."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def paired_deltas(a: DataFrame, b: DataFrame, key: str = "id", value: str = "f1") -> DataFrame:
    """Differences b - a over common keys: ``key, delta``. Both sides hold one row per key; null values pair with nothing."""
    x, y = a.select(F.col(key).alias("id"), F.col(value).alias("va")), b.select(F.col(key).alias("id"), F.col(value).alias("vb"))
    return x.join(y, "id").where("va is not null and vb is not null").select("id", (F.col("vb") - F.col("va")).alias("delta"))


def win_loss_tie(deltas: DataFrame, eps: float = EPS) -> DataFrame:
    """Counts of differences above, below and within eps: one row."""
    d = F.col("delta")
    return deltas.agg(F.count_if(d > eps).alias("wins"), F.count_if(d < -eps).alias("losses"), F.count_if(F.abs(d) <= eps).alias("ties"), F.avg(d).alias("mean_delta"))


def bootstrap(values: np.ndarray, resamples: int, seed: int) -> tuple[float, float, float]:
    """Mean and 95 % percentile interval of resampled means; (0, 0, 0) without values."""
    if not len(values):
        return 0.0, 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = np.concatenate([values[rng.integers(0, len(values), (min(500, resamples - i), len(values)))].mean(axis=1) for i in range(0, resamples, 500)])
    lo, hi = np.percentile(means, [2.5, 97.5])
    return float(values.mean()), float(lo), float(hi)


def wilcoxon_p(deltas: np.ndarray) -> float:
    """Two-sided signed-rank p without zero differences; NaN if all are zero.

    Exact by counting rank sums up to 50 differences without ties, else the normal approximation with tie correction.
    """
    d = deltas[deltas != 0]
    n = len(d)
    if not n:
        return float("nan")
    order = np.abs(d)
    uniq, inverse, counts = np.unique(order, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    if n <= 50 and len(uniq) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(var) if var > 0 else 0.0
    return float(min(1.0, math.erfc(abs(z) / math.sqrt(2))))


def stars(p: Column) -> Column:
    """Significance stars."""
    return F.when(p.isNull() | F.isnan(p), F.lit("n/a")).when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def per_group(deltas: DataFrame, group: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Bootstrap interval and Wilcoxon p of each group's differences: ``group, n, mean, lo, hi, p``.

    A group's differences (one per question of a test set) are resampled in one task, as the exact generator asks for.
    """

    def run(b: pd.DataFrame) -> pd.DataFrame:
        v = b.sort_values("id")["delta"].to_numpy(float)
        mean, lo, hi = bootstrap(v, resamples, seed)
        return pd.DataFrame({"g": [b["g"].iloc[0]], "n": [len(v)], "mean": [mean], "lo": [lo], "hi": [hi], "p": [wilcoxon_p(v)]})

    return deltas.select(F.col(group).cast("string").alias("g"), F.col("id").cast("string").alias("id"), "delta").groupBy("g").applyInPandas(run, "g string, n bigint, mean double, lo double, hi double, p double")


def cohen_kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """Nominal agreement of two columns: ``n, po, pe, kappa``; 1 where chance agreement is certain, NaN without rows.

    Works on the confusion counts, which have one row per pair of labels.
    """
    cells = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    part = lambda label, r, c, d: F.struct(label.alias("label"), r.alias("r"), c.alias("c"), d.alias("d"))
    same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(zero)
    long = cells.select(F.explode(F.array(part(F.col("a"), F.col("n"), zero, same), part(F.col("b"), zero, F.col("n"), zero))).alias("x")).select("x.*")
    labels = long.groupBy("label").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("d").alias("d"))
    sums = labels.agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(name) for name, e in (("n", F.col("r")), ("po", F.col("d")), ("pe", F.col("r") * F.col("c")))])
    n = F.col("n")
    out = sums.select(n, F.try_divide("po", n).alias("po"), F.try_divide("pe", n * n).alias("pe"))
    k = F.when(F.col("n") == 0, F.lit(float("nan"))).when(F.col("pe") >= 1 - 1e-12, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return out.withColumn("kappa", k)


def weighted_kappa(ratings: DataFrame, a: str, b: str, lo: int = 1, hi: int = 5) -> DataFrame:
    """Quadratic weighted agreement of two integer columns: one row ``n, kappa``; 1 where expected disagreement is 0, NaN without rows.

    From moments: both disagreements are sums of squared differences, so no grid is needed. Values outside the scale don't count.
    """
    x, y = F.bround(F.col(a)).cast("double"), F.bround(F.col(b)).cast("double")
    m = ratings.select(x.alias("x"), y.alias("y")).where(F.col("x").between(lo, hi) & F.col("y").between(lo, hi)).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(F.col("x") * F.col("x")).alias("xx"), F.avg(F.col("y") * F.col("y")).alias("yy"), F.avg(F.col("x") * F.col("y")).alias("xy")
    )
    seen = F.col("xx") + F.col("yy") - 2 * F.col("xy")
    chance = F.col("xx") + F.col("yy") - 2 * F.col("mx") * F.col("my")
    return m.select("n", F.when(F.col("n") == 0, F.lit(float("nan"))).when(chance <= 1e-12, 1.0).otherwise(1 - seen / chance).alias("kappa"))


def pairwise_kappa(scores: DataFrame) -> DataFrame:
    """Nominal agreement of each pair of raters on common items: ``r1, r2, n, kappa``. ``scores(rater, iid, score)``, one row each."""
    l, r = scores.select("iid", F.col("rater").alias("r1"), F.col("score").alias("s1")), scores.select("iid", F.col("rater").alias("r2"), F.col("score").alias("s2"))
    cells = l.join(r, "iid").where("r1 < r2 and s1 is not null and s2 is not null").groupBy("r1", "r2", "s1", "s2").agg(F.count(F.lit(1)).alias("n"))
    w, wa, wb = Window.partitionBy("r1", "r2"), Window.partitionBy("r1", "r2", "s1"), Window.partitionBy("r1", "r2", "s2")
    t = cells.withColumns({"t": F.sum("n").over(w), "ra": F.sum("n").over(wa)}).withColumn("cb", F.sum("n").over(wb))
    # chance agreement: for each label, its row total times its column total
    rows, cols = t.select("r1", "r2", "t", F.col("s1").alias("s"), "ra").distinct(), t.select("r1", "r2", F.col("s2").alias("s"), "cb").distinct()
    pe = rows.join(cols, ["r1", "r2", "s"], "left").groupBy("r1", "r2").agg(F.sum(F.coalesce(F.col("ra") * F.col("cb"), F.lit(0))).alias("e"), F.max("t").alias("n"))
    po = t.groupBy("r1", "r2").agg(F.sum(F.when(F.col("s1") == F.col("s2"), F.col("n")).otherwise(0)).alias("o"))
    k = pe.join(po, ["r1", "r2"]).withColumns({"pe": F.col("e") / (F.col("n") * F.col("n")), "po": F.col("o") / F.col("n")})
    return k.select("r1", "r2", "n", F.when(F.col("pe") >= 1 - 1e-12, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def agreement_label(k: Column) -> Column:
    """Landis-Koch words for a kappa."""
    return (
        F.when(k.isNull() | F.isnan(k), F.lit("n/a")).when(k < 0, "poor").when(k <= 0.2, "slight").when(k <= 0.4, "fair").when(k <= 0.6, "moderate").when(k <= 0.8, "substantial").otherwise("almost perfect")
    )


def hash_order(*cols: str, seed: int = 42) -> Column:
    """A shuffled but repeatable order, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def blinded(results: DataFrame, question: str = "id", system: str = "system", seed: int = 42) -> DataFrame:
    """Answers under names that don't tell their system: adds ``slot`` and ``iid`` ('question#slot'); ``iid, system`` is the key to keep apart.

    Within a question systems are in a shuffled, repeatable order; ``results`` has one row for each question and system.
    """
    w = Window.partitionBy(question).orderBy(hash_order(question, system, seed=seed), system)
    return results.withColumn("slot", F.row_number().over(w)).withColumn("iid", F.concat_ws("#", F.col(question).cast("string"), F.col("slot").cast("string")))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, strata: int, order: Callable[[], Column] | None = None) -> DataFrame:
    """``n // strata`` rows of each stratum by a repeatable shuffle, ``n`` in all at most."""
    o = order() if order else hash_order(key)
    w = Window.partitionBy(stratum).orderBy(o, key)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max(1, n // max(1, strata))).drop("__rn").orderBy(o, key).limit(n)


def split_by_group(df: DataFrame, group: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``split``: groups in shuffled order go to 'val' until it holds at least the share of all rows; the rest is 'train'."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__o", hash_order(group, seed=seed)).withColumn("__range", F.substring("__o", 1, 3))
    # ranges of the order are counted first, of which there are 4096; the running sum over groups stays within a range
    ranges = sizes.groupBy("__range").agg(F.sum("__n").alias("__in"))
    every = Window.partitionBy(F.lit(0))
    offsets = ranges.select("__range", (F.sum("__in").over(every.orderBy("__range")) - F.col("__in")).alias("__from"), F.sum("__in").over(every).alias("__all"))
    w = Window.partitionBy("__range").orderBy("__o", group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sizes.withColumn("__to", F.sum("__n").over(w)).join(F.broadcast(offsets), "__range")
    side = cut.select(group, F.when(F.col("__from") + F.col("__to") - F.col("__n") < F.col("__all") * share, "val").otherwise("train").alias("split"))
    return df.join(side, df[group].eqNullSafe(side[group])).drop(side[group])


def run_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one run) and half-width of the 95 % interval per key."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), (F.coalesce(F.stddev_samp(value), F.lit(0.0)) * 1.96 / F.sqrt(F.count(value))).alias("ci95")
    )


def compare_buckets(deltas: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Each difference as 'better', 'worse' or 'same'."""
    d = F.col("delta")
    return deltas.withColumn("bucket", F.when(d > threshold, "better").when(d < -threshold, "worse").otherwise("same"))


def ablation_table(means: DataFrame, order: str, value: str) -> DataFrame:
    """Adds the difference to the first row in percent and to the row before. One row per configuration."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    base = F.first(value).over(w)
    return means.withColumns({"vs_base_pct": F.try_divide((F.col(value) - base) * 100, base), "vs_prev": F.col(value) - F.lag(value).over(w)})
