"""References to records that do not exist, are deleted or arrive later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.intervals import current_rows
from quern.session import cut

#: A key with more than this share of all references is joined by broadcast; there are at most 1 / share such keys.
HOT_SHARE = 1 / 1000


def long_form(children: DataFrame, parents: DataFrame, parent_table: str) -> DataFrame:
    """Tagged keys of both sides under each other: ``parent_table, key, is_parent, arrival, deleted_at, at``."""
    p = parents.select(F.lit(parent_table).alias("parent_table"), "key", F.lit(True).alias("is_parent"), "arrival", "deleted_at", F.lit(None).cast("timestamp_ntz").alias("at"))
    none = F.lit(None).cast("timestamp_ntz")
    c = children.select(F.lit(parent_table).alias("parent_table"), "key", F.lit(False).alias("is_parent"), none.alias("arrival"), none.alias("deleted_at"), "at")
    return p.unionByName(c)


def key_states(long: DataFrame) -> DataFrame:
    """Groups the long form by parent table and key; ``suspect`` are groups that some reference may dangle in.

    Suspect are groups without a parent row, and those whose references reach before the parent's arrival or to its
    deletion. Groups without references are left out. The aggregation is partial before the shuffle, so a hot key costs
    one row per task.
    """
    return (
        long.groupBy("parent_table", "key")
        .agg(
            F.max("is_parent").alias("has_parent"),
            F.max("arrival").alias("arrival"),
            F.max("deleted_at").alias("deleted_at"),
            F.sum(F.when(F.col("is_parent"), 0).otherwise(1)).alias("n_refs"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
        )
        .where("n_refs > 0")
        .withColumn("suspect", F.expr("coalesce(not has_parent or first_at < arrival or last_at >= deleted_at, false)"))
    )


def orphan_references(children: DataFrame, parents: DataFrame, parent_table: str = "norm") -> DataFrame:
    """Every reference that dangles, with its reason: ``src_table, src_key, ref_id, reason, period_ym``.

    ``children``: src_table, src_key, key, at (time of the reference). ``parents``: key (unique), arrival,
    deleted_at. Reasons: 'missing' (no parent row), 'late' (arrival after the reference), 'deleted' (deleted at
    or before it); a reference can be late and deleted at once. A reference without a time can only be missing,
    its period is null. References whose key is null or blank aren't references. Rows are distinct.

    The states of suspect keys are joined back to the references. Keys with more than ``HOT_SHARE`` of all references,
    suspect or not, are at most 1000 by that bound and joined by broadcast: references to a healthy one end there,
    those to a suspect one carry its state and are spread. The rest goes through an ordinary join in which no key is hot.
    """
    refs = children.select("src_table", "src_key", F.lower(F.trim("key")).alias("key"), F.col("at").cast("timestamp_ntz").alias("at")).where(F.length("key") > 0)
    p = parents.select("key", F.col("arrival").cast("timestamp_ntz").alias("arrival"), F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))
    states = cut(key_states(long_form(refs, p, parent_table)).select("key", "has_parent", "arrival", "deleted_at", "n_refs", "suspect"))
    total = states.agg(F.coalesce(F.sum("n_refs"), F.lit(0))).first()[0]
    state = F.struct("has_parent", "arrival", "deleted_at")
    hot = states.where(F.col("n_refs") > total * HOT_SHARE).select("key", "suspect", state.alias("hot"))
    cold = states.where(F.col("suspect") & (F.col("n_refs") <= total * HOT_SHARE)).select(F.col("key").alias("cold_key"), state.alias("cold"))
    spread = F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.concat(F.lit("\u0000"), F.xxhash64("src_table", "src_key").cast("string")))
    known = (
        refs.join(F.broadcast(hot), "key", "left")
        .where("suspect is null or suspect")
        .withColumn("cold_key", spread)
        .join(cold, "cold_key", "left")
        .withColumn("s", F.coalesce("hot", "cold"))
        .where("s is not null")
    )
    reasons = F.filter(
        F.array(
            F.when(~F.col("s.has_parent"), F.lit("missing")),
            F.when(F.col("s.has_parent") & (F.col("s.arrival") > F.col("at")), F.lit("late")),
            F.when(F.col("s.has_parent") & (F.col("s.deleted_at") <= F.col("at")), F.lit("deleted")),
        ),
        lambda r: r.isNotNull(),
    )
    return known.select("src_table", "src_key", F.col("key").alias("ref_id"), F.explode(reasons).alias("reason"), F.date_format("at", "yyyy-MM").alias("period_ym")).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of dangling references per table, reason and period, with the number of different keys."""
    per_key = orphans.groupBy("src_table", "reason", "period_ym", "ref_id").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("src_table", "reason", "period_ym").agg(F.sum("n").alias("n_refs"), F.count("ref_id").alias("n_keys"))


def norm_references(eval_result: DataFrame, norm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References to norms from result citations and from norms' ``implements``, and the norms they may meet."""
    cur = current_rows(norm.select("id", "ingested_at", "implements", "deleted_at"))
    cited = eval_result.select(
        F.lit("eval_result").alias("src_table"),
        F.col("result_id").cast("string").alias("src_key"),
        F.explode(F.array_distinct(F.transform("pred_citations", lambda c: c["van_ban"]))).alias("key"),
        F.col("run_ts").alias("at"),
    )
    implements = cur.select(F.lit("norm").alias("src_table"), F.col("key").alias("src_key"), F.explode("cur.implements").alias("ref"), F.col("cur.ingested_at").alias("at")).withColumnRenamed("ref", "key")
    return cited.unionByName(implements), cur.select("key", "arrival", "cur.deleted_at")
