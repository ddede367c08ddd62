"""Overlapping and gapped time intervals: continuous periods per key and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.dates import OPEN_END, is_blank, parse_day


def continuous_periods(intervals: DataFrame, key: str = "key", start: str = "start", end: str = "end") -> DataFrame:
    """Joins the closed day intervals of each key that overlap, nest or touch.

    Columns out: ``key, start, end, n_intervals``, where n_intervals counts the *different* intervals joined.
    An end of null or 9999-12-31 is open and comes out as 9999-12-31. Rows with a null key or start, or with a
    start after the end, give nothing. Repeated rows count once; an empty table gives an empty one; further
    columns are ignored.

    Plan: repeats are dropped, then intervals that begin on the same day become one (both with partial
    aggregation), so that even a key with a third of all rows reaches its session aggregation with at most one row
    per calendar day. ``session_window`` with each row's own duration merges what overlaps; what merely touches
    is joined afterwards over the few sessions left.
    """
    open_end = F.lit(OPEN_END).cast("date")
    clean = (
        intervals.select(F.col(key).alias("key"), F.col(start).cast("date").alias("start"), F.coalesce(F.col(end).cast("date"), open_end).alias("end"))
        .where("key is not null and start is not null and start <= end")
        .groupBy("key", "start", "end")
        .agg(F.lit(1).alias("one"))
    )
    by_start = clean.groupBy("key", "start").agg(F.max("end").alias("end"), F.count("one").alias("n"))
    days = F.make_interval(days=(F.datediff("end", "start") + 1).cast("int"))
    sessions = (
        by_start.withColumn("at", F.col("start").cast("timestamp_ntz"))
        .groupBy("key", F.session_window("at", days).alias("w"))
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
        .select("key", "start", "end", "n")
    )
    order = Window.partitionBy("key").orderBy("start")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    # the comparison is by difference of days, for there is no day after an open end
    islands = sessions.withColumn("new", (F.datediff("start", F.max("end").over(so_far)) > 1).cast("int")).withColumn(
        "island", F.sum(F.coalesce("new", F.lit(1))).over(order)
    )
    return islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_intervals")).drop("island")


def period_gaps(periods: DataFrame) -> DataFrame:
    """The free days between neighbouring periods of a key, both ends included: ``key, start, end``."""
    order = Window.partitionBy("key").orderBy("start")
    after = periods.withColumn("next", F.lead("start").over(order)).where("next is not null")
    return after.select("key", F.date_add("end", 1).alias("start"), F.date_sub("next", 1).alias("end"))


def periods_and_gaps(periods: DataFrame) -> DataFrame:
    """Periods joined from at least two different intervals, and gaps: ``key, kind, start, end``, in one pass."""
    order = Window.partitionBy("key").orderBy("start")
    rows = F.array(
        F.when(F.col("n_intervals") >= 2, F.struct(F.lit("merged").alias("kind"), F.col("start").alias("a"), F.col("end").alias("b"))),
        F.when(F.col("next").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.date_add("end", 1).alias("a"), F.date_sub("next", 1).alias("b"))),
    )
    return (
        periods.withColumn("next", F.lead("start").over(order))
        .select("key", F.explode(rows).alias("r"))
        .where("r is not null")
        .select("key", "r.kind", F.col("r.a").alias("start"), F.col("r.b").alias("end"))
    )


def current_rows(norm: DataFrame, id_col: str = "id", at: str = "ingested_at") -> DataFrame:
    """One row per trimmed lower-case id: ``key``, ``arrival`` (earliest time) and ``cur``, the latest row as a struct.

    Equal times are settled by the greater row content, so the outcome doesn't depend on row order. Rows whose
    id is null or blank are left out.
    """
    key = F.lower(F.trim(F.col(id_col)))
    row = F.struct(F.col(at).alias("at"), F.struct(*[F.col(c) for c in norm.columns]).alias("row"))
    return (
        norm.where(F.length(key) > 0)
        .groupBy(key.alias("key"))
        .agg(F.min(at).alias("arrival"), F.max(row).alias("m"))
        .select("key", "arrival", F.col("m.row").alias("cur"))
    )


def validity_intervals(scored: DataFrame, norm: DataFrame) -> DataFrame:
    """The interval each retrieval row gives its component: ``key, start, end``.

    Rows whose dates are both missing or blank take the dates of the current row of their norm (ids compared
    trimmed and in lower case), read alike. A blank, null or 9999-12-31 end is open; an end that is written but
    can't be read is no end, and its row gives nothing.
    """
    own = scored.select(
        F.col("component_id").alias("key"),
        F.lower(F.trim("norm_id")).alias("norm_key"),
        "valid_from",
        "valid_to",
        (is_blank(F.col("valid_from")) & is_blank(F.col("valid_to"))).alias("lent"),
    ).where("key is not null")
    direct = own.where("not lent").select("key", "valid_from", "valid_to")
    # few rows lend, and of those only different pairs matter, so a norm with a third of all rows shrinks first
    pairs = own.where("lent").select("key", "norm_key").where("norm_key is not null").distinct()
    dated = current_rows(norm.select("id", "ingested_at", "valid_from", "valid_to")).select(F.col("key").alias("norm_key"), "cur.valid_from", "cur.valid_to")
    lent = pairs.join(dated, "norm_key").select("key", "valid_from", "valid_to")
    every = direct.unionByName(lent).select(
        "key",
        parse_day(F.col("valid_from")).alias("start"),
        F.when(is_blank(F.col("valid_to")), F.lit(OPEN_END).cast("date")).otherwise(parse_day(F.col("valid_to"))).alias("end"),
    )
    return every.where("start is not null and end is not null and start <= end")
