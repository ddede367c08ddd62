"""Event traces: replay pacing, carry-forward of steps, and windows over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay_waits(events: DataFrame, trace: str, seq: str, t: str, speed: float = 1.0, most: float = 5.0, per_second: float = 1.0) -> DataFrame:
    """Adds ``wait``: seconds before an event in a replay, the gap over the speed (0.1 at least), at most ``most``, never negative.

    ``per_second`` is how many units of t a second has; gaps of whole microseconds stay exact that way.
    """
    gap = (F.col(t) - F.lag(t).over(Window.partitionBy(trace).orderBy(seq))) / per_second
    return events.withColumn("wait", F.greatest(F.lit(0.0), F.least(F.coalesce(gap, F.lit(0.0)) / max(speed, 0.1), F.lit(most))))


def carry_forward(events: DataFrame, trace: str, seq: str, step: str) -> DataFrame:
    """Events without a step take the last one before them."""
    w = Window.partitionBy(trace).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(step, F.last(step, True).over(w))


def carry_forward_stream(events: DataFrame, trace: str, seq: str, step: str) -> DataFrame:
    """The same over a stream: the last step of each trace is its state. Events of one micro-batch are taken in order of seq."""
    cols = events.select(trace, seq, step)
    kinds = dict(cols.dtypes)
    out = f"{trace} {kinds[trace]}, {seq} {kinds[seq]}, {step} string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        b = pd.concat(list(batches)).sort_values(seq)
        filled = []
        for s in b[step]:
            last = s if s is not None and s == s else last
            filled.append(last)
        state.update((last,))
        yield b.assign(**{step: filled})[[trace, seq, step]]

    return cols.groupBy(trace).applyInPandasWithState(run, out, "last string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, key: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling windows per key: ``window_start, key, n, total``. On a stream, rows later than the watermark are dropped."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    g = marked.groupBy(F.window(at, window).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "key", "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per key, ended by a gap: ``key, session_start, session_end, n``."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    g = marked.groupBy(F.col(key).alias("key"), F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: str, at: str, within: str = "1 hour") -> DataFrame:
    """First delivery of each event; on a stream, repeats within the watermark are dropped."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_available(stream: DataFrame, spark: SparkSession, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Works off all that is there and gives the result as a table; for tests and small backfills."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def frames(events: DataFrame, *columns: str) -> DataFrame:
    """Events as frames of a server's event stream: adds ``frame``, ``data:`` and the named columns as JSON, then a blank line."""
    return events.withColumn("frame", F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n")))


def drain(stream: DataFrame, path: str, checkpoint: str, every: str | None = "50 milliseconds") -> StreamingQuery:
    """Starts to write what has arrived, again and again, without waiting for more; ``every`` of None works off what is there and ends.

    Each batch goes to a folder of its own number, which is overwritten if the batch is run again after a loss, so
    every event is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)).start()


def single_flight(requests: DataFrame, key: str, at: str, order: str, seconds: float) -> DataFrame:
    """Requests with ``admitted``: whether its key was idle, each admitted one keeping it busy for so many seconds.

    A request depends on all before it, so a key's requests pass one task in order of time, then ``order``; nothing but
    the end of the last admitted one is kept. Requests without a key or time are never admitted.
    """
    kinds = dict(requests.dtypes)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.select(key, order, micros.alias("__at")).where(F.col(key).isNotNull() & F.col("__at").isNotNull())
    busy = int(seconds * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, free = None, 0
        for b in batches:
            flags = []
            for k, t in zip(b[key], b["__at"]):
                if k != last:
                    last, free = k, t
                flags.append(t >= free)
                free = t + busy if t >= free else free
            yield pd.DataFrame({key: b[key], order: b[order], "admitted": flags})

    known = rows.repartition(key).sortWithinPartitions(key, "__at", order).mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean")
    others = requests.where(F.col(key).isNull() | micros.isNull()).select(key, order, F.lit(False).alias("admitted"))
    return known.unionByName(others)
