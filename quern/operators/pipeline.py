"""The whole way from questions to their contexts, for all questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import graph, retrieval
from quern.operators.question_plans import ABLATIONS
from quern.session import cut

#: Documents a search begins from, and hops from there.
SEEDS, HOPS = 5, 2


def searched_norms(questions: DataFrame, seeds: DataFrame, edges: DataFrame, norms: DataFrame, ablation: str = "full", hops: int = HOPS) -> DataFrame:
    """Documents each question is searched in: ``q, norm``.

    ``questions(q, jurisdiction, temporal)``, ``seeds(q, node)``, ``edges(src, dst, rel)``, ``norms(norm, jurisdiction,
    valid_from, valid_to)``. Seeds are widened over the relations the ablation leaves in, then filtered by place and time;
    without the graph they stay as they are.
    """
    left_out = ABLATIONS[ablation]
    if left_out.graph:
        return seeds.select("q", F.col("node").alias("norm")).distinct()
    near = graph.closure(seeds, edges, hops, left_out.relations).select("q", F.col("node").alias("norm"))
    allowed = F.lit(None).cast("array<string>") if left_out.jurisdiction else graph.allowed_jurisdictions(F.col("jurisdiction"))
    day = F.lit(None).cast("string") if left_out.temporal else F.col("temporal")
    asked = questions.select("q", allowed.alias("allowed"), day.alias("day"))
    there = norms.select("norm", F.col("jurisdiction").alias("place"), "valid_from", "valid_to")
    ok = (F.col("allowed").isNull() | F.array_contains("allowed", F.col("place"))) & graph.valid_at(F.col("day"), F.col("valid_from"), F.col("valid_to"))
    return near.join(asked, "q").join(there, "norm").where(ok).select("q", "norm").distinct()


def _ranked_within(ranked: DataFrame, units: DataFrame, within: DataFrame, most: int) -> DataFrame:
    """A list of scored units, those of the searched documents alone, with ranks from 0."""
    own = ranked.select("q", "item", "score").join(units.select("item", "norm"), "item").join(within, ["q", "norm"], "left_semi")
    return retrieval.top_k(own, most).select("q", "item", F.col("rank"))


def search(within: DataFrame, units: DataFrame, dense: DataFrame, lexical: DataFrame, boosted: DataFrame, cited: DataFrame, rarity: DataFrame, procedures: DataFrame, k: int = 25) -> DataFrame:
    """Units of the searched documents, ranked and allocated: ``q, item, norm, tier, score, rank``.

    ``within(q, norm)``; ``units(item, norm, component, tier)``; ``dense`` and ``lexical(q, item, score)`` are fused by their
    ranks; ``boosted(q, component)`` and ``cited(q, item)`` bring in units of their own, the first multiplied, the second
    allocated before all others; ``rarity(procedure, component, rarity)`` counts for questions of that procedure,
    ``procedures(q, procedure)`` with one row each. Everything is joined by keys; what is joined to the units of a
    question is bounded by its lists and its searched documents.
    """
    pool = retrieval.pool_size(k)
    d, l = cut(_ranked_within(dense, units, within, pool)), cut(_ranked_within(lexical, units, within, pool))
    sizes = F.count(F.lit(1)).alias("n")
    fused = d.select("q", "item", (F.col("rank") - 1).alias("dr")).join(l.select("q", "item", (F.col("rank") - 1).alias("kr")), ["q", "item"], "full_outer")
    place = units.select("item", "norm", "component", "tier")
    graphed = boosted.select("q", "component").distinct().join(place, "component").join(within, ["q", "norm"], "left_semi").select("q", "item")
    named = cited.select("q", "item").distinct().join(place, "item").join(within, ["q", "norm"], "left_semi").select("q", "item")
    extra = graphed.union(named).distinct().join(fused.select("q", "item"), ["q", "item"], "left_anti")
    every = fused.unionByName(extra.select("q", "item", F.lit(None).cast("int").alias("dr"), F.lit(None).cast("int").alias("kr")))
    every = every.join(d.groupBy("q").agg(sizes.alias("nd")), "q", "left").join(l.groupBy("q").agg(sizes.alias("nk")), "q", "left").join(place, "item")
    every = every.join(boosted.select("q", "component").distinct().withColumn("boosted", F.lit(True)), ["q", "component"], "left")
    every = every.join(named.withColumn("cited", F.lit(True)), ["q", "item"], "left")
    every = every.join(procedures, "q", "left").join(rarity, ["procedure", "component"], "left")
    none = F.lit(0).cast("bigint")
    score = retrieval.rrf_score(F.coalesce("dr", "nd", none), F.coalesce("kr", "nk", none), F.col("tier"), F.coalesce("boosted", F.lit(False)), F.col("rarity"))
    scored = every.select("q", "item", "norm", "tier", F.round(score, 9).alias("score"), F.col("dr").alias("dense_rank"), F.coalesce("cited", F.lit(False)).alias("cited"))
    return retrieval.capped_allocation(cut(scored), k)


def seed_norms(scored: DataFrame, most: int = SEEDS) -> DataFrame:
    """The documents with the best units of each question: ``q, node``. ``scored(q, norm, score)``."""
    best = scored.groupBy("q", "norm").agg(F.max("score").alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "norm")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("q", F.col("norm").alias("node"))
