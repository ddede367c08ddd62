"""The document graph: node tables, edges, closures and concept statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.dates import OPEN_END, day_before
from quern.session import cut

RELATIONS = ("INCLUDES", "IMPLEMENTS", "AMENDS", "HAS_COMPONENT", "HAS_CTV", "HAS_TEXT_UNIT", "APPLIES_TO", "AMENDED_BY", "MAPS_TO_CONCEPT", "REQUIRES_CONCEPT")
# Each jurisdiction with those that apply in it.
NATIONAL = "toan-quoc"
ALLOWED = {"toan-quoc": ["toan-quoc"], "tp-hcm": ["toan-quoc", "tp-hcm"], "dong-nai": ["toan-quoc", "dong-nai"], "multi-juris": None}


def upsert_latest(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """One row per key, the last by the order column: what writing the rows one by one would leave.

    Equal order values are settled by the row's other columns, so the outcome doesn't depend on partitioning.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("__o"), F.xxhash64(*rest).alias("__h"), F.struct(*rest).alias("__r"))).alias("m"))
    return best.select(*keys, "m.__r.*").select(*rows.columns)


def gated_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges ``src, dst, rel`` both of whose ends are nodes ``id``."""
    n = nodes.select("id").distinct()
    return links.select("src", "dst", "rel").distinct().join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "rel")


def dangling_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with an end that is no node."""
    return links.select("src", "dst", "rel").distinct().exceptAll(gated_edges(links, nodes))


def norm_edges(norms: DataFrame) -> DataFrame:
    """IMPLEMENTS and AMENDS links of norms (``id, implements, amended_by_norms``), ids trimmed and in lower case."""
    k = lambda c: F.lower(F.trim(c))
    up = norms.select(k(F.col("id")).alias("src"), F.explode("implements").alias("x")).select("src", k(F.col("x")).alias("dst"), F.lit("IMPLEMENTS").alias("rel"))
    down = norms.select(k(F.col("id")).alias("dst"), F.explode("amended_by_norms").alias("x")).select(k(F.col("x")).alias("src"), "dst", F.lit("AMENDS").alias("rel"))
    return up.unionByName(down).where("length(src) > 0 and length(dst) > 0")


def split_versions(components: DataFrame) -> DataFrame:
    """Versions of components: ``ctv_id, component_id, valid_from, valid_to, status, text``.

    ``components(component_id, text, valid_from, original_text, effective_dates)``. With an original text *and* dated
    amendments there are two: the original until the day before the first amendment ('superseded'), and the text from it on
    ('active'); otherwise one. Dates are ISO text and compared as text.
    """
    c = components.withColumn("first", F.array_min("effective_dates"))
    two = F.col("original_text").isNotNull() & F.col("first").isNotNull()
    v = lambda n, a, b, s, t: F.struct(F.concat_ws("-v", "component_id", F.lit(str(n))).alias("ctv_id"), a.alias("valid_from"), b.alias("valid_to"), F.lit(s).alias("status"), t.alias("text"))
    end = F.lit(OPEN_END)
    old = v(0, F.col("valid_from"), day_before(F.col("first")), "superseded", F.col("original_text"))
    new = v(1, F.col("first"), end, "active", F.col("text"))
    only = v(0, F.col("valid_from"), end, "active", F.col("text"))
    return c.select("component_id", F.explode(F.when(two, F.array(old, new)).otherwise(F.array(only))).alias("v")).select("v.ctv_id", "component_id", "v.valid_from", "v.valid_to", "v.status", "v.text")


def close_open_ends(df: DataFrame, column: str = "valid_to") -> DataFrame:
    """Null ends as the open sentinel; a second run changes nothing."""
    return df.withColumn(column, F.coalesce(column, F.lit(OPEN_END)))


def undirected(edges: DataFrame, rels: list[str] | None = None) -> DataFrame:
    """Both directions of edges of the given relations: ``a, b``."""
    e = edges if rels is None else edges.where(F.col("rel").isin(rels))
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def closure(seeds: DataFrame, edges: DataFrame, hops: int = 4, rels: list[str] | None = None) -> DataFrame:
    """Nodes within so many hops of a query's seeds, in any direction: ``q, node, hop`` with the least hop, seeds at 0.

    ``seeds(q, node)``. Frontier by frontier, each only with nodes not met before; each frontier is cut off, so plans
    stay small. An empty relation list keeps the seeds alone.
    """
    both = undirected(edges, rels).withColumnRenamed("a", "node")
    met = cut(seeds.select("q", "node").distinct().withColumn("hop", F.lit(0)))
    front, parts = met, [met]
    for hop in range(1, hops + 1):
        reached = front.select("q", "node").join(both, "node").select("q", F.col("b").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, parts)
        front = cut(reached.join(known.select("q", "node"), ["q", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        parts.append(front)
    return reduce(DataFrame.unionByName, parts)


def allowed_jurisdictions(j: Column) -> Column:
    """Jurisdictions that apply where one is asked for; null (all) for null and 'multi-juris', the national one for unknown ones."""
    out = F.array(F.lit(NATIONAL))
    for name, allowed in ALLOWED.items():
        out = F.when(j == name, F.array(*map(F.lit, allowed)) if allowed else F.lit(None)).otherwise(out)
    return F.when(j.isNotNull(), out)


def valid_at(t: Column, valid_from: Column, valid_to: Column) -> Column:
    """ISO text t lies in the closed interval; a null t filters nothing, a null start matches no t."""
    return t.isNull() | ((valid_from <= t) & (valid_to.isNull() | (valid_to >= t)))


def per_group_cap(df: DataFrame, group: list[str], order: str, cap: int) -> DataFrame:
    """The first rows of each group."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("__rn") <= cap).drop("__rn")


def procedure_components(maps: DataFrame, requires: DataFrame) -> DataFrame:
    """Components a procedure needs: ``procedure, component``, distinct. ``maps(component, concept)``, ``requires(procedure, concept)``."""
    return requires.select("procedure", "concept").distinct().join(maps.select("component", "concept").distinct(), "concept").select("procedure", "component").distinct()


def concept_rarity(maps: DataFrame) -> DataFrame:
    """How rare a concept is in its document: ``norm, concept, rarity`` = 1 - its components / components with a concept. ``maps(norm, component, concept)``."""
    m = maps.where("concept is not null").select("norm", "component", "concept").distinct()
    per = m.groupBy("norm", "concept").agg(F.count(F.lit(1)).alias("n"))
    total = m.select("norm", "component").distinct().groupBy("norm").agg(F.count(F.lit(1)).alias("total"))
    return per.join(total, "norm").select("norm", "concept", (1 - F.col("n") / F.col("total")).alias("rarity"))


def rarity_score(maps: DataFrame, requires: DataFrame) -> DataFrame:
    """Greatest rarity of a component among a procedure's concepts: ``procedure, norm, component, score``."""
    r = concept_rarity(maps)
    m = maps.where("concept is not null").select("norm", "component", "concept").distinct()
    return m.join(r, ["norm", "concept"]).join(requires.select("procedure", "concept").distinct(), "concept").groupBy("procedure", "norm", "component").agg(F.max("rarity").alias("score"))


def census(edges: DataFrame) -> DataFrame:
    """Edges per relation: ``rel, n_edges, n_src, n_dst``."""
    return edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


def path_scan(norms: DataFrame, units: DataFrame) -> DataFrame:
    """The chain theme, norm, component, version, text with its jurisdiction, as one row per unit. ``norms`` has one row per id."""
    n = norms.select(F.lower(F.trim("id")).alias("norm_key"), "theme", "jurisdiction", F.coalesce("tier", F.lit(1)).alias("tier"), "valid_from", "valid_to").where("theme is not null")
    u = units.select(F.col("id").alias("unit_id"), "ctv_id", "component_id", F.lower(F.trim("norm_id")).alias("norm_key"), "context_path", "text")
    return u.join(n, "norm_key").where("length(trim(text)) > 0")


def amendments_of(units: DataFrame, amendments: DataFrame) -> DataFrame:
    """Units with the distinct amendments of their component, an empty list for none: ``unit_id, component_id, amendments``.

    ``amendments(component_id, amending_norm, effective_date)``; they are gathered per component before the join.
    """
    a = amendments.where("amending_norm is not null").groupBy("component_id").agg(F.sort_array(F.collect_set(F.struct("effective_date", "amending_norm"))).alias("amendments"))
    empty = F.array().cast("array<struct<effective_date:string,amending_norm:string>>")
    return units.select("unit_id", "component_id").join(a, "component_id", "left").select("unit_id", "component_id", F.coalesce("amendments", empty).alias("amendments"))


def best_link(cites: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each citation with the context block that fits best, or none: ``cite_id, block_id, n_match, n_extra``.

    ``cites(cite_id, q, norm, dieu, khoan, diem)``, ``blocks(block_id, q, norm, dieu, khoan, diem)``. Blocks of the same
    question and document count whose named levels don't contradict the citation; most equal levels win, then
    fewest levels the citation lacks, then the first block.
    """
    c, b = cites.alias("c"), blocks.alias("b")
    levels = ("dieu", "khoan", "diem")
    one = lambda x: F.when(x, 1).otherwise(0)
    n_match = sum((one(F.col(f"c.{f}") == F.col(f"b.{f}")) for f in levels), F.lit(0))
    n_extra = sum((one(F.col(f"b.{f}").isNotNull() & F.col(f"c.{f}").isNull()) for f in levels), F.lit(0))
    clash = reduce(lambda x, y: x | y, [F.coalesce(F.col(f"c.{f}") != F.col(f"b.{f}"), F.lit(False)) for f in levels])
    pairs = c.join(b, ["q", "norm"]).where(~clash).select("cite_id", "block_id", n_match.alias("n_match"), n_extra.alias("n_extra")).where("n_match > 0")
    best = pairs.groupBy("cite_id").agg(F.min(F.struct((-F.col("n_match")).alias("m"), "n_extra", "block_id")).alias("x"))
    return cites.select("cite_id").join(best, "cite_id", "left").select("cite_id", "x.block_id", (-F.col("x.m")).alias("n_match"), "x.n_extra")
