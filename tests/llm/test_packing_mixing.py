import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quern.llm import mixing, packing


@pytest.mark.parametrize("seed", range(6))
def test_pack_keeps_items_whole_and_fills_windows(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 100, 512])
    sizes = [rng.randrange(1, cap + 1) if seed % 2 else min(cap, int(rng.expovariate(4 / cap)) + 1) for _ in range(rng.randrange(1, 300))]
    out = packing.pack(sizes, cap)
    assert sorted(i for w in out for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= cap for w in out)
    # never worse than opening a window whenever the next item doesn't fit, largest first
    room: list[int] = []
    for s in sorted(sizes, reverse=True):
        j = next((j for j, r in enumerate(room) if r >= s), None)
        if j is None:
            room.append(cap - s)
        else:
            room[j] -= s
    assert len(out) <= len(room) * 1.05 + 1
    assert packing.pack([], 5) == []


def test_differencing_gives_near_equal_sums():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 100) for _ in range(200)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 10)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 2


def test_containers(spark):
    docs = [(i, (i * 37) % 130) for i in range(300)] + [(1000, 512), (1001, 1500), (1002, None), (1003, 0)]
    sizes = spark.createDataFrame(docs, "doc_id long, n_tokens long").withColumn("piece", F.lit("x"))
    specs = spark.createDataFrame([(1, "a", 100), (2, "b", 512), (2, "b", 512), (3, "c", None), (4, "d", 0)], "spec_id int, spec_name string, capacity_tokens int")
    out = packing.containers(sizes, specs, len(docs), items_per_block=64)
    got = out.collect()
    by: dict = {}
    for r in got:
        by.setdefault((r.spec_id, r.container_id), []).append(r)
    assert {s for s, _ in by} == {1, 2}
    for s, cap in ((1, 100), (2, 512)):
        total = {i: n for i, n in docs if n}
        mine = [r for r in got if r.spec_id == s]
        sums: dict = {}
        for r in mine:
            sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
        assert sums == total and len({(r.doc_id, r.piece) for r in mine}) == len(mine)
        assert all(sum(r.n_tokens for r in b) <= cap for (k, _), b in by.items() if k == s)
        # only items over the capacity are split
        assert all(total[r.doc_id] > cap for r in mine if r.piece > 0)
    report = {r.spec_id: r for r in packing.fill_report(out, specs).collect()}
    assert report[1].n_containers >= report[1].least_containers and 0.85 < report[1].fill_share <= 1
    assert packing.containers(sizes.limit(0), specs, 0).count() == 0 and packing.containers(sizes, specs.limit(0), 5).count() == 0


def test_splitting_tree_keeps_totals():
    rng = np.random.default_rng(1)
    counts = np.array([7, 0, 100, 33])
    out = mixing.splitting_tree(counts, 7, rng)
    assert (out.sum(0) == counts).all() and out.sum(1).max() - out.sum(1).min() <= 3 and (out >= 0).all()


def mix_data(spark, n=4000):
    rng = random.Random(1)
    docs = [(i, rng.choice(["big"] * 8 + [" Mid ", "small"]), int(rng.expovariate(1 / 200)) + 1) for i in range(n)] + [(n, None, 5), (n + 1, "other", 5), (n + 2, "big", None), (n + 3, "big", 0)]
    return spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("block", F.lit(1)), docs


def test_mixture_meets_shares_and_caps(spark):
    sizes, docs = mix_data(spark)
    target = spark.createDataFrame([("BIG", 0.5, 1), ("mid", 0.3, 3), ("small ", 0.2, 2), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(sizes, target).cache()
    got = mix.collect()
    size = {i: n for i, _, n in docs}
    assert all(r.n_tokens == size[r.doc_id] for r in got) and len({(r.doc_id, r.copy) for r in got}) == len(got)
    tokens = {s: sum(r.n_tokens for r in got if r.source == s) for s in ("big", "mid", "small")}
    total = sum(tokens.values())
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(tokens[s] / total - w) < 0.002
    most = {s: max(r.copy for r in got if r.source == s) + 1 for s in tokens}
    assert most["big"] == 1 and most["mid"] <= 3 and most["small"] <= 2 and (most["mid"] == 3 or most["small"] == 2 or tokens["big"] > 0.99 * sum(n or 0 for _, s, n in docs if s == "big"))
    assert {tuple(r) for r in mixing.mixture(sizes, target).collect()} == {tuple(r) for r in got}
    assert all(sorted(r.pos for r in got if r.shard == s) == list(range(1, sum(r.shard == s for r in got) + 1)) for s in {r.shard for r in got})
    report = {r.source: r for r in mixing.share_report(mix, target).collect()}
    assert abs(report["mid"].actual_share - tokens["mid"] / total) < 1e-12 and report["absent"].n_tokens == 0


def test_mixture_to_a_total_and_of_nothing(spark):
    sizes, _ = mix_data(spark)
    target = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 2)], "source string, target_share double, max_repeats int")
    small = mixing.mixture(sizes, target, total=20_000)
    assert abs(small.agg(F.sum("n_tokens")).first()[0] - 20_000) < 300
    assert mixing.mixture(sizes.limit(0), target).count() == 0 and mixing.mixture(sizes, target.limit(0)).count() == 0
    assert rows(mixing.share_report(mixing.mixture(sizes.limit(0), target), target), "source", "actual_share") == [("big", 0.0), ("mid", 0.0)]


def test_water_filling_keeps_shares_near_their_targets():
    target = {"scarce": (0.05, 4), "big": (0.6, 1), "mid": (0.35, 2), "absent": (0.2, 3)}
    tokens = {"scarce": 10, "big": 6000, "mid": 900}
    exact = mixing.quotas(tokens, target)
    assert abs(exact["scarce"] - 40) < 1e-6 and abs(sum(exact.values()) - 800) < 1e-3
    last = 0.0
    for deviation in (0.01, 0.03, 0.05, 0.1, 0.3, 1.0):
        got = mixing.quotas(tokens, target, max_deviation=deviation)
        total = sum(got.values())
        assert all(got[s] <= target[s][1] * n + 1e-6 for s, n in tokens.items()) and total >= last
        assert all(abs(got[s] / total - target[s][0]) <= deviation + 1e-9 for s in got)
        last = total
    assert abs(last - (40 + 6000 + 1800)) < 1e-3
    assert abs(sum(mixing.quotas(tokens, target, total=500, max_deviation=0.1).values()) - 500) < 1e-6


def test_mixture_lets_scarce_sources_give_all(spark, monkeypatch):
    sizes, docs = mix_data(spark)
    target = spark.createDataFrame([("big", 0.2, 1), ("mid", 0.4, 1), ("small", 0.4, 2)], "source string, target_share double, max_repeats int")
    exact = mixing.mixture(sizes, target).agg(F.sum("n_tokens")).first()[0]
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 4000)
    monkeypatch.setattr(mixing, "LEAVES", 4)
    got = mixing.mixture(sizes, target, max_deviation=0.1).collect()
    tokens = {s: sum(r.n_tokens for r in got if r.source == s) for s in ("big", "mid", "small")}
    total = sum(tokens.values())
    assert total > 1.2 * exact and all(abs(tokens[s] / total - w) <= 0.103 for s, w in (("big", 0.2), ("mid", 0.4), ("small", 0.4)))
    assert tokens["mid"] == sum(n or 0 for _, s, n in docs if s == " Mid ")
    sums: dict = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_tokens
    assert len(sums) > 30 and max(sums.values()) < 3 * 4000
    assert all(sorted(r.pos for r in got if r.shard == s) == list(range(1, sum(r.shard == s for r in got) + 1)) for s in sums)


def test_most_windows_come_from_differencing_where_items_are_small():
    rng = random.Random(4)
    sizes = [min(1000, int(rng.expovariate(1 / 60)) + 1) for _ in range(1024)]
    out = packing.pack(sizes, 1000)
    assert sorted(i for w in out for i in w) == list(range(1024)) and len(out) <= 1.02 * -(-sum(sizes) // 1000)
    # large items beside each other can't be made equal; best fit takes over
    large = [rng.randrange(400, 700) for _ in range(400)]
    got = packing.pack(large, 1000)
    assert all(sum(large[i] for i in w) <= 1000 for w in got) and sorted(i for w in got for i in w) == list(range(400))
    bare = next(k for k in range(-(-sum(large) // 1000), 401) if all(sum(large[i] for i in w) <= 1000 for w in packing.differencing(large, k)))
    assert len(got) <= bare


def test_a_kind_with_several_capacities_has_the_least(spark):
    sizes = spark.createDataFrame([(i, 40) for i in range(10)], "doc_id long, n_tokens long")
    specs = spark.createDataFrame([(1, 100), (1, 80), (2, 100)], "spec_id int, capacity_tokens int")
    report = rows(packing.fill_report(packing.containers(sizes, specs, 10), specs), "spec_id", "n_containers", "least_containers")
    assert report == [(1, 5, 5), (2, 5, 4)]
