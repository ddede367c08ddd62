"""Filling fixed-capacity containers with items of varying length."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that are partitioned together; more give fuller containers and cost more.
ITEMS_PER_BLOCK = 1024
#: Part of the capacity from which on a window that differencing made is kept.
FULL = 0.98


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: items by index in k windows of near-equal sums.

    A partial partition is its non-empty windows in ascending order. The two with the greatest spread are merged,
    the large windows of one with the small of the other, until one is left.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n, first = len(sizes), itemgetter(0)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        down = b[::-1]
        over = max(0, len(b) - free)
        both = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[:over], down[free:])]
        merged = a[over:] + down[:free] + both
        merged.sort(key=first)
        n += 1
        heapq.heappush(heap, (-(merged[-1][0] - (merged[0][0] if len(merged) == k else 0)), n, merged))
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            t = todo.pop()
            if isinstance(t, tuple):
                todo += t
            else:
                items.append(t)
        out.append(items)
    return out


def _best_fit(sizes: list[int], k: int, capacity: int) -> list[list[int]] | None:
    """Items by index, largest first, each into the fullest of k windows it fits; None where one fits nowhere."""
    out: list[list[int]] = [[] for _ in range(k)]
    room = [(capacity, w) for w in range(k)]
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            return None
        free, w = room.pop(at)
        out[w].append(i)
        insort(room, (free - sizes[i], w))
    return out


def pack(sizes: list[int], capacity: int, full: float = FULL) -> list[list[int]]:
    """Items by index in few windows within capacity. No item may be larger than capacity.

    Differencing is applied to all items, then again and again to those of windows it left over capacity or less than
    ``full``; windows in between are kept. Few large items to a window can't be made nearly equal, so in the end
    differencing fills no window any more; the items left are placed by best fit, the window count rising until they fit.
    """
    out: list[list[int]] = []
    rest = list(range(len(sizes)))
    while rest:
        left = [sizes[i] for i in rest]
        windows = [w for w in differencing(left, max(1, -(-sum(left) // capacity))) if w]
        sums = [sum(left[j] for j in w) for w in windows]
        if max(sums) > capacity:
            windows = [w for w, s in zip(windows, sums) if full * capacity <= s <= capacity]
        if not windows:
            break
        out += [[rest[j] for j in w] for w in windows]
        gone = {j for w in windows for j in w}
        rest = [i for j, i in enumerate(rest) if j not in gone]
    if rest:
        left = [sizes[i] for i in rest]
        k = -(-sum(left) // capacity)
        while (found := _best_fit(left, k, capacity)) is None:
            k += 1
        out += [[rest[j] for j in w] for w in found if w]
    return out


SCHEMA = "spec_id int, container_id string, doc_id bigint, piece int, n_tokens bigint"


def _kinds(specs: DataFrame) -> DataFrame:
    return specs.where("capacity_tokens > 0").groupBy("spec_id").agg(F.min("capacity_tokens").alias("capacity_tokens"))


def containers(sizes: DataFrame, specs: DataFrame, n_items: int, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """An assignment of items to containers: ``spec_id, container_id, doc_id, piece, n_tokens``.

    ``sizes(doc_id, n_tokens)``; ``specs(spec_id, capacity_tokens)``, each kind of container is filled with all
    items. An item within capacity is one piece, 0. A larger one is split into full pieces, each a container of its
    own, and a last piece that is packed like an item. Items of size 0 or null take no room and give no row; kinds
    with a null or non-positive capacity have no containers, one that is listed with several has the least of them. ``n_items`` sets the number of blocks: a hash spreads items over
    blocks of about ``items_per_block``, and each is partitioned by itself, so no group grows with the data.
    """
    rows = _kinds(specs).collect()
    kinds = F.array(*[F.struct(F.lit(r[0]).cast("int").alias("spec_id"), F.lit(r[1]).cast("bigint").alias("capacity")) for r in rows])
    blocks = max(1, -(-n_items // items_per_block))
    items = sizes.where("n_tokens > 0").select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_tokens")
    if not rows:
        return items.where("false").selectExpr("0 as spec_id", "'' as container_id", "doc_id", "0 as piece", "n_tokens")
    each = items.select("doc_id", "n_tokens", F.explode(kinds).alias("k")).select("doc_id", "n_tokens", "k.spec_id", "k.capacity", F.expr("n_tokens div k.capacity").cast("int").alias("full"))
    whole = (
        each.where("full > 0")
        .select("spec_id", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
        .select("spec_id", F.concat_ws("-", F.lit("d"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", F.col("capacity").alias("n_tokens"))
    )
    rest = each.withColumn("left", F.col("n_tokens") - F.col("full") * F.col("capacity")).where("left > 0")
    rest = rest.select("spec_id", "capacity", "doc_id", F.col("full").alias("piece"), "left", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"))

    def fill(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["left", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        name = [""] * len(b)
        for w, items_ in enumerate(pack(b["left"].tolist(), int(b["capacity"].iloc[0]))):
            for i in items_:
                name[i] = f"b-{b['block'].iloc[0]}-{w}"
        return pd.DataFrame({"spec_id": b["spec_id"], "container_id": name, "doc_id": b["doc_id"], "piece": b["piece"], "n_tokens": b["left"]})

    return whole.unionByName(rest.groupBy("spec_id", "block").applyInPandas(fill, SCHEMA))


def fill_report(assignment: DataFrame, specs: DataFrame) -> DataFrame:
    """How well each kind is filled: ``spec_id, n_containers, n_tokens, least_containers, fill_share``."""
    each = assignment.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"))
    total = each.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"))
    named = total.join(_kinds(specs), "spec_id")
    return named.select(
        "spec_id",
        "n_containers",
        "n_tokens",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill_share"),
    )
