"""Retrieval and ranking for whole sets of questions in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import estimate_tokens, slug_tokens, word_tokens
from quern.session import cut, spread

RRF_K = 60
RARITY_WEIGHT = 1.5
GRAPH_BOOST = 100.0
TIER_STEP = 0.1
# Most units of one document, and of each tier, in an allocation.
MAX_PER_NORM = 3
MAX_PER_TIER = {1: 8, 2: 8, 3: 6, 4: 8}
MAX_OTHER_TIER = 25
#: Most query vectors held by every task at once.
QUERY_BLOCK = 2048
#: Documents scored at once by a task, and pairs of a document's term and a query that asks for it.
SCORED_AT_ONCE = 500
PAIRS_AT_ONCE = 4_000_000


def pool_size(k: int) -> int:
    """Candidates fetched for a top k."""
    return max(2 * k, 50)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision; on unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def top_k(scored: DataFrame, k: int, query: str = "q", score: str = "score", tie: str = "item") -> DataFrame:
    """The k best rows per query with their 1-based ``rank``; ties go to the lesser item.

    The limit above the window lets every task keep only its own k best per query before the shuffle.
    """
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _keep_best(best: pd.DataFrame | None, ids: list, items: np.ndarray, scores: np.ndarray, k: int, least: float = -np.inf) -> pd.DataFrame | None:
    """A task's k best rows per query so far, with those of a batch that score above ``least``; ties go to the lesser item."""
    if not len(ids) or not len(items):
        return best
    take = min(k, scores.shape[1])
    # all that tie with the k-th stay in, the ranking settles them
    kth = np.partition(scores, -take, axis=1)[:, -take]
    r, c = np.nonzero((scores >= kth[:, None]) & (scores > least))
    part = pd.DataFrame({"q": np.array(ids, dtype=object)[r], "item": items[c], "score": scores[r, c]})
    best = part if best is None else pd.concat([best, part])
    return best.sort_values(["q", "score", "item"], ascending=[True, False, True]).groupby("q").head(k)


def dense_top_k(queries: DataFrame, items: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top k of unit vectors: ``q, item, score, rank``. ``queries(q, vec)``, ``items(item, vec)``.

    Queries are the stated set: they are worked off in blocks of at most ``block``, each held by every task, against all items. A task
    multiplies its batches with the block and emits k candidates per query, so what is shuffled is bounded by tasks and queries. Null vectors and
    items of another dimension match nothing.
    """
    q = queries.where("q is not null and vec is not null").select("q", "vec")
    n = q.count()
    blocks = max(1, -(-n // block))
    kq, ki = dict(queries.dtypes)["q"], dict(items.dtypes)["item"]

    def one(i: int) -> DataFrame:
        rows = q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()
        ids = [r["q"] for r in rows]
        width = len(rows[0]["vec"]) if rows else 0
        mat = np.array([r["vec"] for r in rows if len(r["vec"]) == width], float).reshape(-1, max(width, 1))
        ids = [r["q"] for r in rows if len(r["vec"]) == width]
        shared = queries.sparkSession.sparkContext.broadcast((ids, mat))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qs, m = shared.value
            best: pd.DataFrame | None = None
            for b in batches:
                b = b[b["vec"].map(lambda v: v is not None and len(v) == m.shape[1])]
                if not len(b) or not len(qs):
                    continue
                s = np.round(m @ np.stack(b["vec"].to_numpy()).astype(float).T, 6)
                best = _keep_best(best, qs, b["item"].to_numpy(), s, k)
            if best is not None:
                yield best

        return spread(items.where("item is not null and vec is not null").select("item", "vec")).mapInPandas(run, f"q {kq}, item {ki}, score double")

    out = one(0)
    for i in range(1, blocks):
        out = out.unionByName(one(i))
    return top_k(out, k)


def threshold_or_best(ranked: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows at or above a score; a query with none keeps its best."""
    return ranked.where((F.col("score") >= least) | (F.col("rank") == 1))


def bm25_index(docs: DataFrame, item: str = "item", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings ``term, item, tf, dl`` and term statistics ``term, idf`` with ``avgdl``.

    One shuffle by (item, term) counts frequencies where the text is; document frequencies aggregate partially, so a
    frequent term costs one row per task. Null texts are documents without terms.
    """
    toks = docs.select(F.col(item).alias("item"), word_tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    total = toks.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    postings = toks.select("item", "dl", F.explode("t").alias("term")).groupBy("item", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return postings, df.select("term", F.log1p((total["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.lit(total["avgdl"]).alias("avgdl"))


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, block: int = QUERY_BLOCK) -> DataFrame:
    """BM25 top k: ``q, item, score, rank``. ``queries(q, text)``, ``docs(item, text)``; repeated query words count repeatedly.

    Two passes over the texts. The first counts in how many documents each query term stands, and with them the documents
    and their words (aggregated partially, one row per term and task). In the second every task scores its documents
    against a block of the stated queries and emits k candidates per query, so pairs of queries and documents are never
    shuffled; only terms that a document has and a query asks for are worked on. Scores of 0 don't count.
    """
    q = queries.where("q is not null").select("q", word_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    blocks = max(1, -(-q.count() // block))
    texts = spread(docs.where("item is not null").select("item", F.lower(F.coalesce("text", F.lit(""))).alias("text")))
    every = F.lit("")  # no word is empty: counted under it are all documents
    terms = q.select(F.explode("t").alias("term")).distinct().union(queries.sparkSession.range(1).select(every))
    toks = texts.select(word_tokens(F.col("text")).alias("t"))
    seen = toks.select(F.size("t").cast("bigint").alias("dl"), F.explode(F.concat(F.array(every), F.array_distinct("t"))).alias("term"))
    found = cut(seen.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("words")))
    total = found.where(F.col("term") == every).first()
    n_docs = total["df"] if total else 0
    avgdl = (total["words"] / n_docs if n_docs else 0) or 1.0
    kq, ki = dict(queries.dtypes)["q"], dict(docs.dtypes)["item"]

    def one(i: int) -> DataFrame:
        own = q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)
        rows = own.collect()
        asked = found.join(own.select(F.explode("t").alias("term")).distinct(), "term", "left_semi")
        shared = queries.sparkSession.sparkContext.broadcast(([r["q"] for r in rows], [r["t"] for r in rows], {r["term"]: r["df"] for r in asked.collect()}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, asked_terms, dfs = shared.value
            place = {t: j for j, t in enumerate(dfs)}
            idf = np.array([np.log1p((n_docs - f + 0.5) / (f + 0.5)) for f in dfs.values()])
            # per term the queries that ask for it, one after the other, with their weights
            asks = np.array(sorted((place[t], j) for j, ts in enumerate(asked_terms) for t in ts if t in place), np.int64).reshape(-1, 2)
            cells, times = np.unique(asks[:, 0] * max(len(ids), 1) + asks[:, 1], return_counts=True)
            term_of, query_of = np.divmod(cells, max(len(ids), 1))
            weight = times * idf[term_of] if len(idf) else times
            begin = np.searchsorted(term_of, np.arange(len(place) + 1))
            word = regex.compile(r"[\p{L}\p{N}_]+")
            best: pd.DataFrame | None = None
            for whole in batches:
                for lo in range(0, len(whole), SCORED_AT_ONCE):
                    part = whole.iloc[lo : lo + SCORED_AT_ONCE]
                    if not len(place):
                        continue
                    dl, held = np.zeros(len(part)), []
                    for d, text in enumerate(part["text"]):
                        w = word.findall(text)
                        dl[d] = len(w)
                        held.append(np.array([p for p in map(place.get, w) if p is not None], np.int64) + d * len(place))
                    posts, tf = np.unique(np.concatenate(held), return_counts=True)
                    doc, term = np.divmod(posts, len(place))
                    sat = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl))
                    n_asks = begin[term + 1] - begin[term]
                    s = np.zeros(len(ids) * len(part))
                    bounds = np.searchsorted(np.cumsum(n_asks), np.arange(PAIRS_AT_ONCE, n_asks.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE), "right")
                    for x, y in zip(np.r_[0, bounds[:-1]], np.r_[bounds[:-1], len(posts)]):
                        n = n_asks[x:y]
                        at = np.repeat(begin[term[x:y]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                        s += np.bincount(query_of[at] * len(part) + np.repeat(doc[x:y], n), weight[at] * np.repeat(sat[x:y], n), len(s))
                    best = _keep_best(best, ids, part["item"].to_numpy(), np.round(s.reshape(len(ids), len(part)), 6), k, 0.0)
            if best is not None and len(best):
                yield best

        return texts.mapInPandas(run, f"q {kq}, item {ki}, score double")

    out = one(0)
    for i in range(1, blocks):
        out = out.unionByName(one(i))
    return top_k(out, k)


def keyword_overlap(queries: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """Share of a query's slug tokens that an item's name has: ``q, item, score``. ``queries(q, text)``, ``items(item, name)``.

    An item that has the share of a query's tokens has one of the rarest of them, as many as may be missing and one more.
    Tokens are counted over the items first, only those rarest are joined, and the share is worked out on the pair.
    """
    tok = lambda df, key, text: df.select(key, slug_tokens(F.col(text)).alias("t"))
    q, i = tok(queries, "q", "text").where(F.size("t") > 0), tok(items, "item", "name")
    often = i.select(F.explode("t").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("often"))
    ranked = q.select("q", "t", F.explode("t").alias("tok")).join(often, "tok").groupBy("q", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("often", "tok"))), lambda x: x["tok"]).alias("known"))
    # tokens that no item has are missing everywhere
    missing = F.size("t") - F.ceil(F.lit(least) * F.size("t") - 1e-9) - (F.size("t") - F.size("known"))
    rare = ranked.where(missing >= 0).select("q", "t", F.slice("known", F.lit(1), F.least(missing + 1, F.size("known")).cast("int")).alias("rare"))
    pairs = rare.withColumn("tok", F.explode("rare")).join(i.select("item", F.col("t").alias("has"), F.explode("t").alias("tok")), "tok")
    once = pairs.where(F.col("tok") == F.array_intersect("rare", "has")[0])
    return once.select("q", "item", (F.size(F.array_intersect("t", "has")) / F.size("t")).alias("score")).where(F.col("score") >= least)


def rrf_score(dense_rank: Column, keyword_rank: Column, tier: Column, boosted: Column, rarity: Column) -> Column:
    """Reciprocal rank fusion (0-based ranks) with multipliers; a tier of null or 0 counts as 1."""
    base = 1 / (RRF_K + dense_rank) + 1 / (RRF_K + keyword_rank)
    t = F.coalesce(F.nullif(tier, F.lit(0)), F.lit(1))
    return base * (1 + t * TIER_STEP) * F.when(boosted, GRAPH_BOOST).otherwise(1.0) * (1 + RARITY_WEIGHT * F.coalesce(rarity, F.lit(0.0)))


def fuse(dense: DataFrame, keyword: DataFrame) -> DataFrame:
    """Full outer union of two ranked lists: ``q, item, dr, kr`` (0-based), a missing rank being the length of that list."""
    d, k = dense.select("q", "item", (F.col("rank") - 1).alias("dr")), keyword.select("q", "item", (F.col("rank") - 1).alias("kr"))
    both = d.join(k, ["q", "item"], "full_outer")
    w = Window.partitionBy("q")
    nd, nk = F.count("dr").over(w), F.count("kr").over(w)
    return both.select("q", "item", F.coalesce("dr", nd).alias("dr"), F.coalesce("kr", nk).alias("kr"))


def capped_allocation(candidates: DataFrame, k: int = 25, per_norm: int = MAX_PER_NORM, per_tier: dict[int, int] | None = None, other_tier: int = MAX_OTHER_TIER) -> DataFrame:
    """Multi-pass allocation under caps as windows: ``candidates(q, item, norm, tier, score, dense_rank, cited)``.

    Passes: -1 cited units by score; 0 the first dense row of each document; 1 the best row of documents without a dense
    one; 2 all others by score. In that order rows are kept up to ``per_norm`` of a document, then up to the tier's cap, then k
    in all; out come ``q, item, norm, tier, score, rank`` ordered by score. A unit enters once. dense_rank is null for units without one.
    """
    caps = MAX_PER_TIER if per_tier is None else per_tier
    norm = Window.partitionBy("q", "norm")
    first_dense = F.row_number().over(norm.orderBy(F.asc_nulls_last("dense_rank"), "item"))
    first_any = F.row_number().over(norm.orderBy(F.desc("score"), "item"))
    c = candidates.withColumns({"fd": first_dense, "fa": first_any, "has_dense": F.max(F.col("dense_rank").isNotNull()).over(norm)})
    step = F.when(F.col("cited"), -1).when((F.col("fd") == 1) & F.col("dense_rank").isNotNull(), 0).when(~F.col("has_dense") & (F.col("fa") == 1), 1).otherwise(2)
    by = F.when(F.col("step") == 0, -F.col("dense_rank").cast("double")).otherwise(F.col("score"))
    c = c.withColumn("step", step).withColumn("by", by)
    order = ["step", F.desc("by"), "item"]
    c = c.withColumn("n_norm", F.row_number().over(norm.orderBy(*order))).where(F.col("n_norm") <= per_norm)
    cap = F.lit(other_tier)
    for t, m in caps.items():
        cap = F.when(F.col("tier") == t, m).otherwise(cap)
    c = c.withColumn("n_tier", F.row_number().over(Window.partitionBy("q", "tier").orderBy(*order))).where(F.col("n_tier") <= cap)
    c = c.withColumn("n_all", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("n_all") <= k)
    return c.select("q", "item", "norm", "tier", "score", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "item")).alias("rank"))


def budget_prune(units: DataFrame, budget: int = 6000, text: str = "text") -> DataFrame:
    """Units in order of score until the first that would exceed the token budget; adds ``tokens`` and ``used``."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "item").rowsBetween(Window.unboundedPreceding, 0)
    sized = units.withColumn("tokens", estimate_tokens(F.col(text)))
    return sized.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def first_fit(units: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """Units in order of score, each taken if it still fits; gold units are always kept. ``units(q, item, score, gold)``.

    A fold over one query's candidate list, which the retrieval before it bounds.
    """
    sized = units.select("q", "item", "score", "gold", estimate_tokens(F.col(text)).alias("tokens"))
    lists = sized.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((~F.col("gold")).alias("late"), (-F.col("score")).alias("o"), "item", "tokens", "gold"))).alias("l"))
    init = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<item:bigint,tokens:int>>").alias("kept"))

    def step(acc: Column, u: Column) -> Column:
        fits = u["gold"] | (acc["used"] + u["tokens"] <= budget)
        return F.struct(
            F.when(fits, acc["used"] + u["tokens"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(F.struct(u["item"].cast("bigint").alias("item"), u["tokens"].alias("tokens"))))).otherwise(acc["kept"]).alias("kept"),
        )

    return lists.select("q", F.explode(F.aggregate("l", init, step)["kept"]).alias("k")).select("q", "k.item", "k.tokens")


def assemble_context(units: DataFrame, label: str = "label", text: str = "text", order: str = "rank") -> DataFrame:
    """Blocks ``--- label ---`` and text joined by blank lines, in order: ``q, context``. A query's units are few after pruning."""
    block = F.concat(F.lit("--- "), F.col(label), F.lit(" ---\n"), F.coalesce(F.col(text), F.lit("")))
    lists = units.groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("l"))
    return lists.select("q", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("context"))


def fixed_chunks(docs: DataFrame, item: str, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks of so many characters with an overlap: ``item, chunk_idx, chunk``; each trimmed, blank ones left out.

    Rows are emitted where the text is, without a shuffle and in time linear in its length. The last chunk is the first
    that reaches the end.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap less than it")
    step = size - overlap
    t = spread(docs.select(F.col(item).alias("item"), F.col(text).alias("t"))).select("item", F.regexp_replace("t", r"^\s+|\s+$", "").alias("t")).where(F.length("t") > 0)
    n = F.greatest(F.lit(0), F.ceil((F.length("t") - size) / step)).cast("int") + 1
    # every match takes a step and looks ahead over a chunk
    whole = F.slice(F.regexp_extract_all("t", F.lit(rf"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)), F.lit(1), n)
    kept = F.filter(F.transform(whole, lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: F.length(c) > 0)
    return t.select("item", F.posexplode(kept).alias("chunk_idx", "chunk"))


def greedy_diverse(df: DataFrame, group: str, key: str, a: str, b: str, k: int = 3) -> DataFrame:
    """k rows per group, one after the other, each with the least (times a was seen, times b was seen, key).

    Rows are first cut to the k least keys of each (group, a, b), which no pick can go beyond, so a group's task holds k rows per combination.
    """
    w = Window.partitionBy(group, a, b).orderBy(key)
    few = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows, seen_a, seen_b, out = p.sort_values(key).to_dict("records"), {}, {}, []
        while rows and len(out) < k:
            best = min(rows, key=lambda r: (seen_a.get(r[a], 0), seen_b.get(r[b], 0), r[key]))
            rows.remove(best)
            seen_a[best[a]] = seen_a.get(best[a], 0) + 1
            seen_b[best[b]] = seen_b.get(best[b], 0) + 1
            out.append(best | {"pick": len(out) + 1})
        return pd.DataFrame(out, columns=[*p.columns, "pick"])


    return few.groupBy(group).applyInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema.fields) + ", pick int")
