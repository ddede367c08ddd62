"""Mixing sources to target weights, with capped repeats and exact shares."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks each source is cut into, and parts of the one block that is used in part.
BLOCKS = 2048
#: Tokens an output shard is to have.
SHARD_TOKENS = 2_000_000
#: Leaves of the splitting tree; a leaf with more than a shard's tokens is cut into shards by the hash of its records.
LEAVES = 512
#: Rows of the plan that are broadcast at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def source_key(c: Column) -> Column:
    """Sources compare trimmed and in lower case."""
    return F.lower(F.trim(c))


def _at(seed: int) -> tuple[Column, Column]:
    """Block and part of a record, both by hash."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return F.pmod(h, F.lit(BLOCKS)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(BLOCKS)).cast("int")


@dataclass
class Colour:
    """One copy of a source in the mix: its blocks in drawing order, the last perhaps only in part."""

    source: str
    copy: int
    blocks: np.ndarray
    part_below: int  # of the last block; BLOCKS means all


def splitting_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Splits block counts per colour among shards, halving the shards and drawing each half from a multivariate hypergeometric."""
    out = np.zeros((shards, len(counts)), np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(have, int(have.sum()) * (mid - lo) // (hi - lo), method="marginals")
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, shards, np.asarray(counts, np.int64))
    return out


def water_filled(caps: dict[str, float], weights: dict[str, float], total: float) -> dict[str, float]:
    """The total divided by weights; a source over its cap gives all it may, and the others share the rest by their weights."""
    given: dict[str, float] = {}
    free = dict(weights)
    while free:
        level = (total - sum(given.values())) / sum(free.values())
        over = {s: caps[s] for s, w in free.items() if w * level > caps[s]}
        if not over:
            return given | {s: w * level for s, w in free.items()}
        given |= over
        free = {s: w for s, w in free.items() if s not in over}
    return given


def quotas(tokens: dict[str, int], target: dict[str, tuple[float, int]], total: float | None = None, max_deviation: float = 0.0) -> dict[str, float]:
    """Tokens each source gives, by water-filling the greatest total, or ``total`` if less, that keeps every share within ``max_deviation`` of its target.

    With 0 the scarcest source decides the total and shares are exact. Targets are taken in proportion among the sources
    that have tokens and may be used.
    """
    live = {s: (w, r) for s, (w, r) in target.items() if w > 0 and r > 0 and tokens.get(s, 0) > 0}
    if not live:
        return {}
    weight = sum(w for w, _ in live.values())
    weights = {s: w / weight for s, (w, _) in live.items()}
    caps = {s: float(r * tokens[s]) for s, (_, r) in live.items()}

    def near(t: float) -> bool:
        return all(abs(q / t - weights[s]) <= max_deviation + 1e-12 for s, q in water_filled(caps, weights, t).items())

    low, high = min(caps[s] / w for s, w in weights.items()), sum(caps.values())
    if near(high):
        low = high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if near(mid) else (low, mid)
    return water_filled(caps, weights, low if total is None else min(total, low))


def mixture(sizes: DataFrame, target: DataFrame, total: float | None = None, seed: int = 7, max_deviation: float = 0.0) -> DataFrame:
    """Records chosen for the mix: ``doc_id, source, copy, shard, pos, n_tokens``.

    ``sizes(doc_id, source, n_tokens)`` is read several times and should be materialised; ``target(source, target_share,
    max_repeats)``. The mix is as large as the caps on repeats allow while no source's share is further than
    ``max_deviation`` from its target, beside the rounding to whole records, or has ``total`` tokens if that is less: a
    source at its cap gives all it may, repeats included, and the others share what it lacks. Copies are numbered from 0. Shares of sources without tokens
    fall to the others in proportion; sources no target names, and records without tokens, aren't used. Every number is
    a function of the seed.

    Blocks are hash buckets of records, so a source with a third of all rows is spread like any other. On the driver there are
    only token counts of blocks, BLOCKS for each source the target names, from which whole blocks are chosen up to each
    quota; one last block is used up to a part of it. The plan has a row for each block of each copy in use. Shards
    follow the tokens: leaves of the tree with more than a shard's are cut by hash, so no task orders more than a shard.
    """
    rows = target.groupBy(source_key(F.col("source")).alias("s")).agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r")).where("s is not null").collect()
    wanted = {r["s"]: (float(r["w"] or 0), int(r["r"] or 0)) for r in rows}
    names = sorted(wanted)
    block, part = _at(seed)
    # a source and a block as one number, on which the join is cheapest
    at = {s: i * BLOCKS for i, s in enumerate(names)}
    number = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for s, i in at.items()]) if names else F.lit(0)
    marked = sizes.select("doc_id", source_key(F.col("source")).alias("source"), "n_tokens").where(F.col("source").isin(names) & (F.col("n_tokens") > 0))
    marked = marked.withColumn("slot", (number + block).cast("bigint")).withColumn("part", part)
    held: dict[str, np.ndarray] = {s: np.zeros(BLOCKS, np.int64) for s in wanted}
    for r in marked.groupBy("slot").agg(F.sum("n_tokens").alias("t")).collect():
        held[names[r["slot"] // BLOCKS]][r["slot"] % BLOCKS] = r["t"]
    want = quotas({s: int(t.sum()) for s, t in held.items()}, wanted, total, max_deviation)

    rng = np.random.default_rng(seed)
    colours: list[Colour] = []
    ends: dict[str, tuple[int, int, float]] = {}  # source -> colour, block used in part, tokens to take of it
    for s in sorted(want):
        size = int(held[s].sum())
        filled = np.flatnonzero(held[s])
        whole = int(want[s] / size + 1e-9)
        colours += [Colour(s, c, rng.permutation(filled), BLOCKS) for c in range(whole)]
        rest = want[s] - whole * size
        if rest > 0.5:
            order = rng.permutation(filled)
            n = int(np.searchsorted(np.cumsum(held[s][order]), rest + 1e-6, "right"))
            taken, left = order[:n].tolist(), rest - float(held[s][order[:n]].sum())
            for b in order[n:].tolist():  # later blocks that still fit
                if held[s][b] <= left:
                    taken.append(b)
                    left -= float(held[s][b])
            spare = np.setdiff1d(order[n:], taken)
            if len(spare):
                end = int(spare[np.argmin(held[s][spare])])
                ends[s] = (len(colours), end, left)
                taken.append(end)
            colours.append(Colour(s, whole, np.array(taken, np.int64), BLOCKS))
    if ends:
        parts: dict[str, np.ndarray] = {s: np.zeros(BLOCKS, np.int64) for s in ends}
        own = marked.where(F.col("slot").isin([at[s] + b for s, (_, b, _) in ends.items()]))
        for r in own.groupBy("source", "part").agg(F.sum("n_tokens").alias("t")).collect():
            parts[r["source"]][r["part"]] = r["t"]
        for s, (c, _, left) in ends.items():
            sums = np.cumsum(parts[s])
            cut_at = int(np.searchsorted(sums, left, "right"))
            # the part in which the quota is reached is used if that comes nearer to it
            if cut_at < BLOCKS and sums[cut_at] - left < left - (sums[cut_at - 1] if cut_at else 0):
                cut_at += 1
            colours[c].part_below = cut_at

    size = sum(want.values())
    leaves = int(min(LEAVES, max(1, round(size / SHARD_TOKENS))))
    shards_of_leaf = max(1, round(size / leaves / SHARD_TOKENS))
    drawn = splitting_tree(np.array([len(c.blocks) for c in colours], np.int64), leaves, rng) if colours else np.zeros((1, 0), np.int64)
    plan: dict[str, list[np.ndarray]] = {"slot": [], "copy": [], "leaf": [], "part_below": []}
    for j, c in enumerate(colours):
        n = len(c.blocks)
        below = np.full(n, BLOCKS, np.int32)
        below[n - 1 :] = c.part_below
        for name, values in (("slot", at[c.source] + c.blocks), ("copy", np.full(n, c.copy)), ("leaf", rng.permutation(np.repeat(np.arange(leaves), drawn[:, j]))), ("part_below", below)):
            plan[name].append(values)
    fields = pa.schema([("slot", pa.int64()), *((n, pa.int32()) for n in ("copy", "leaf", "part_below"))])
    columns = [pa.array(np.concatenate(plan[f.name]) if colours else [], f.type) for f in fields]
    placed = sizes.sparkSession.createDataFrame(pa.Table.from_arrays(columns, schema=fields))
    small = sum(len(c.blocks) for c in colours) <= BROADCAST_ROWS
    chosen = marked.join(F.broadcast(placed) if small else placed, "slot").where("part < part_below")
    shard = F.col("leaf") * shards_of_leaf + F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "doc_id", "copy"), F.lit(shards_of_leaf)).cast("int")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "doc_id", "copy"), "doc_id", "copy")
    return chosen.withColumn("shard", shard).select("doc_id", "source", "copy", "shard", F.row_number().over(order).alias("pos"), "n_tokens")


def share_report(mix: DataFrame, target: DataFrame) -> DataFrame:
    """Target and actual shares: ``source, target_share, n_records, most_copies, n_tokens, actual_share``; unused sources show 0."""
    each = mix.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), (F.max("copy") + 1).alias("most_copies"), F.sum("n_tokens").alias("n_tokens"))
    named = target.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share")).join(each, "source", "left")
    every = Window.partitionBy(F.lit(0))
    return named.na.fill(0, ["n_records", "most_copies", "n_tokens"]).select("*", F.coalesce(F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(every), F.lit(0)), F.lit(0.0)).alias("actual_share"))
