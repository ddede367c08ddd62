"""Evaluation passages leaking into training text.

Items and texts are cut into windows of as many words as count as a leak. A CGK random walk embeds each window so
that few edits of words change few places; bit-sampling LSH over the embedding proposes pairs, and exact edit
distance to all lengths a window can have after the edits decides. Repetitions reach the target recall for the edits
that are hardest to see; windows without edits are always proposed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import words
from quern.session import spread

#: Consecutive words of an item that count as a leak.
WINDOW = 10
#: Places of the embedding a key samples.
SAMPLED = 12
#: Most item windows shared with every task at once; more items are worked off in blocks.
SHARED_WINDOWS = 1_000_000
#: Windows embedded at once.
CHUNK = 400_000


def word_code(word: str) -> int:
    """64 bits of a word; equal on every machine."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


@dataclass(frozen=True)
class Walk:
    """One repetition: a random walk over windows, and the places of its output that make the key."""

    seed: int
    window: int
    places: tuple[int, ...]

    def keys(self, codes: np.ndarray, starts: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
        """Keys of the windows that begin at ``starts``; ``room`` is how many words each text still has there.

        Step j writes the word the walk stands on and goes on by one word or none, as a random bit of (j, word) says;
        beyond the window it writes nothing. Only the sampled places are kept, mixed into the key.
        """
        rng = np.random.default_rng(self.seed)
        mix = rng.integers(1, 1 << 63, 3 * self.window + 2, np.uint64) | np.uint64(1)
        keep = set(self.places)
        stand = np.zeros(len(starts), np.int64)
        width = self.window if room is None else np.minimum(room, self.window)
        key = np.zeros(len(starts), np.uint64)
        top = np.uint64(63)
        with np.errstate(over="ignore"):
            for j in range(max(keep) + 1):
                inside = stand < width
                word = codes[np.minimum(starts + stand, len(codes) - 1)] * inside
                hashed = (word + mix[j]) * mix[j + 1]
                hashed ^= hashed >> np.uint64(29)
                hashed *= mix[0]
                if j in keep:
                    key = (key ^ hashed) * mix[-1]
                    key ^= key >> np.uint64(31)
                stand += ((hashed >> top).astype(np.int64)) & inside
        return key


def edited(base: np.ndarray, kinds: tuple[int, ...], places: tuple[int, ...], rng: np.random.Generator) -> np.ndarray:
    """Rows of words with one word changed (kind 0), inserted (1) or deleted (2) at each of the places."""
    out = base.copy()
    for kind, at in zip(kinds, places):
        new = rng.integers(1, 1 << 63, len(out), np.uint64)
        if kind == 1:
            out[:, at + 1 :] = out[:, at:-1].copy()
        if kind == 2:
            out[:, at:-1] = out[:, at + 1 :].copy()
        else:
            out[:, at] = new
    return out


@cache
def tables_needed(max_edits: int, recall: float = 0.95, window: int = WINDOW, sampled: int = SAMPLED, trials: int = 200) -> int:
    """Repetitions after which a pair within ``max_edits`` edits of words is proposed with the target recall.

    The chance of one repetition is measured on random windows for every kind and place of an edit, the least of them
    counts; of several edits, for the worst kind and place of each of them. Without edits it is 1.
    """
    if max_edits <= 0:
        return 1
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 63, (trials, 2 * window + max_edits), np.uint64)
    starts = np.arange(trials) * base.shape[1]
    tried = walks(32, window, sampled)
    plain = [w.keys(base.ravel(), starts) for w in tried]

    def chance(kinds: tuple[int, ...], places: tuple[int, ...]) -> float:
        other = edited(base, kinds, places, rng).ravel()
        return float(np.mean([np.mean(k == w.keys(other, starts)) for w, k in zip(tried, plain)]))

    kinds, places, p = (), (), 1.0
    for _ in range(max_edits):
        p, kinds, places = min((chance((*kinds, k), (*places, at)), (*kinds, k), (*places, at)) for k in range(3) for at in range(window))
    p = max(p, 0.5 / (trials * len(tried)))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(p, 0.999))))


def walks(n: int, window: int = WINDOW, sampled: int = SAMPLED) -> list[Walk]:
    """Repetitions with their own walk and sample each."""
    out = []
    for s in range(n):
        rng = np.random.default_rng(1000 + s)
        out.append(Walk(s + 1, window, tuple(sorted(rng.choice(3 * window, sampled, replace=False).tolist()))))
    return out


def edits(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences of words, or most + 1 where it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def prefix_edits(a: np.ndarray, b: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
    """Per row, the least edit distance of the words ``b`` to the first n words of ``a``, n within ``most`` of b's length and ``room``."""
    row = [np.full(len(a), j) for j in range(a.shape[1] + 1)]
    for i in range(b.shape[1]):
        last, row[0] = row[0], np.full(len(a), i + 1)
        for j in range(1, len(row)):
            last, row[j] = row[j], np.minimum(np.minimum(row[j], row[j - 1]) + 1, last + (a[:, j - 1] != b[:, i]))
    least = np.full(len(a), most + 1)
    for n in range(max(1, b.shape[1] - most), len(row)):
        least = np.where(n <= room, np.minimum(least, row[n]), least)
    return least


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, as far as there are n."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = (out ^ codes[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Items:
    """Windows of the items with their keys per repetition, sorted for probing."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int, reps: list[Walk]):
        codes, starts, owner = [], [], []
        at = 0
        for i, t in enumerate(texts):
            w = [word_code(x) for x in words(t)]
            n = len(w) - window + 1
            if n > 0:
                starts += range(at, at + n)
                owner += [i] * n
            codes += w
            at += len(w)
        self.ids, self.window, self.reps = ids, window, reps
        self.codes = np.array(codes + [0], np.uint64)
        self.starts, self.owner = np.array(starts, np.int64), np.array(owner, np.int64)
        self.tables = []
        for r in reps:
            keys = r.keys(self.codes, self.starts)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order, pd.Index(np.unique(keys))))
        self.known_grams: dict[int, pd.Index] = {}

    def near(self, codes: np.ndarray, starts: np.ndarray, max_edits: int) -> np.ndarray:
        """True for windows that hold a run of words of an item as long as ``max_edits`` edits must leave; others can't be within them."""
        n = -(-(self.window - max_edits) // (max_edits + 1))
        if n < 1 or len(codes) < n:
            return np.ones(len(starts), bool)
        if n not in self.known_grams:
            self.known_grams[n] = pd.Index(np.unique(grams(self.codes, n)))
        seen = np.r_[0, np.cumsum(self.known_grams[n].get_indexer(grams(codes, n)) >= 0)]
        top = len(seen) - 1
        return seen[np.minimum(starts + self.window + max_edits - n + 1, top)] > seen[np.minimum(starts, top)]

    def found(self, codes: np.ndarray, starts: np.ndarray, max_edits: int, room: np.ndarray | None = None, within: int | None = None) -> set[tuple[int, int]]:
        """(start, item) of windows proposed by any repetition and verified ``within`` so many edits, else ``max_edits``; ``room`` as in ``Walk.keys``."""
        within = max_edits if within is None else within
        out: set[tuple[int, int]] = set()
        if not len(self.starts) or not len(starts):
            return out
        room = np.full(len(starts), self.window) if room is None else room
        if max_edits:
            keep = self.near(codes, starts, max_edits)
            starts, room = starts[keep], room[keep]
        for lo in range(0, len(starts), CHUNK):
            part, left_over = starts[lo : lo + CHUNK], room[lo : lo + CHUNK]
            pairs = np.empty(0, np.int64)
            for r, (keys, order, known) in zip(self.reps, self.tables):
                probe = r.keys(codes, part, left_over)
                hit = np.flatnonzero(known.get_indexer(probe) >= 0)
                if not len(hit):
                    continue
                left = np.searchsorted(keys, probe[hit], "left")
                n = np.searchsorted(keys, probe[hit], "right") - left
                theirs = order[np.repeat(left - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                pairs = np.union1d(pairs, np.repeat(hit, n) * len(self.starts) + theirs)
            for at in range(0, len(pairs), CHUNK):
                mine, theirs = np.divmod(pairs[at : at + CHUNK], len(self.starts))
                a = codes[np.minimum(part[mine][:, None] + np.arange(self.window + within), len(codes) - 1)]
                b = self.codes[self.starts[theirs][:, None] + np.arange(self.window)]
                same = (a[:, : self.window] == b).all(1) & (left_over[mine] >= self.window)
                if within:
                    rest = np.flatnonzero(~same)
                    same[rest] = prefix_edits(a[rest], b[rest], left_over[mine][rest], within) <= within
                out.update(zip(part[mine[same]].tolist(), self.owner[theirs[same]].tolist()))
        return out


def leaks(texts: DataFrame, items: DataFrame, max_edits: int = 0, recall: float = 0.95, window: int = WINDOW, shared_windows: int = SHARED_WINDOWS, within: int | None = None) -> DataFrame:
    """Texts that hold a window of an item: ``sample_id, item_id, n_windows``.

    ``texts(sample_id, text)``, several rows of a sample being texts by themselves; ``items(item_id, text)``. A leak is
    a window of ``window`` consecutive words of the item that stands in the text with at most ``max_edits`` words
    inserted, deleted or changed, so up to as many words longer or shorter there; n_windows counts the words of the
    sample's texts from which on such a window stands. ``within`` asks the exact check for fewer edits than the
    candidates allow for. Words are compared without case, accents, punctuation, markup and invisible characters. Null, empty and short texts and items have no windows.

    Items are the query set: their windows go to every task, at most ``shared_windows`` at a time, which is counted
    first; a larger set is worked off in blocks of items, each against all texts. Every text is read whole.
    """
    spark = texts.sparkSession
    reps = walks(tables_needed(max_edits, recall, window), window)
    distinct = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0] * len(reps)
    blocks = max(1, -(-int(size) // shared_windows))
    kind = dict(texts.dtypes)["sample_id"]

    def one(block: int) -> DataFrame:
        rows = distinct.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        # the index is made once and read by every task
        shared = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], window, reps))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known: dict[str, int] = {}
            index = shared.value
            for b in batches:
                codes: list[int] = []
                starts, rooms, owner_at = [], [], []
                for t in b["text"]:
                    w = words(t)
                    owner_at.append(len(codes))
                    n = len(w) - max(1, window - max_edits) + 1
                    if n > 0:
                        starts.append(np.arange(len(codes), len(codes) + n))
                        rooms.append(np.arange(len(w), len(w) - n, -1))
                    for x in w:
                        c = known.get(x)
                        if c is None:
                            if len(known) > 500_000:
                                known.clear()
                            c = known[x] = word_code(x)
                        codes.append(c)
                hits = index.found(np.array(codes, np.uint64), np.concatenate(starts), max_edits, np.concatenate(rooms), within) if starts else None
                if hits:
                    at = np.array([h[0] for h in hits])
                    rows = np.searchsorted(np.array(owner_at), at, "right") - 1
                    yield pd.DataFrame({"sample_id": b["sample_id"].to_numpy()[rows], "item_id": [index.ids[h[1]] for h in hits]})

        return spread(texts.where("text is not null").select("sample_id", "text")).mapInPandas(run, f"sample_id {kind}, item_id string")

    found = one(0)
    for k in range(1, blocks):
        found = found.unionByName(one(k))
    return found.groupBy("sample_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"))


def sample_texts(samples: DataFrame) -> DataFrame:
    """A sample's question and context as texts by themselves: ``sample_id, text``."""
    return samples.select("sample_id", F.explode(F.array("question", "context")).alias("text"))


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: in how many samples and windows it leaked, items that didn't leak with 0: ``item_id, n_samples, n_windows``."""
    per = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("n_windows").alias("n_windows"))
    every = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id")).distinct()
    return every.join(per, "item_id", "left").na.fill(0, ["n_samples", "n_windows"])
