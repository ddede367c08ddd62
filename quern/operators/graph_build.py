"""The whole document graph from its tables: all kinds of nodes, all kinds of edges between nodes there are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.graph import norm_edges


def nodes(norms: DataFrame, units: DataFrame, maps: DataFrame, requires: DataFrame) -> DataFrame:
    """Every node once: ``kind, id``; null and empty ids are none.

    ``norms(key, theme, jurisdiction, ...)`` has a row for each document, ``units(id, ctv_id, component_id, norm)`` for each
    text, ``maps(component, concept)`` and ``requires(procedure, concept)`` hold the concepts. The order in which a
    graph store would need them doesn't matter, as edges are joined to nodes afterwards.
    """
    kinds = ((norms, "key", "Norm"), (norms, "theme", "Theme"), (norms, "jurisdiction", "Jurisdiction"), (units, "component_id", "Component"), (units, "ctv_id", "CTV"), (units, "id", "TextUnit"), (maps, "concept", "Concept"), (requires, "concept", "Concept"), (requires, "procedure", "Procedure"))
    parts = [df.select(F.lit(kind).alias("kind"), F.col(c).alias("id")).where("length(id) > 0") for df, c, kind in kinds]
    return reduce(DataFrame.unionByName, parts).distinct()


def edges(known: DataFrame, norms: DataFrame, units: DataFrame, maps: DataFrame, requires: DataFrame) -> DataFrame:
    """Every edge once whose two nodes are known: ``rel, src, dst``. ``known`` as of ``nodes``, the tables as there.

    Ends are joined by kind and id, so an edge that names what isn't there is left out, whatever names it.
    """
    part = lambda df, rel, sk, src, dk, dst: df.select(F.lit(rel).alias("rel"), F.lit(sk).alias("sk"), F.col(src).alias("src"), F.lit(dk).alias("dk"), F.col(dst).alias("dst"))
    norm = norm_edges(norms.withColumn("id", F.col("key"))).select("rel", F.lit("Norm").alias("sk"), "src", F.lit("Norm").alias("dk"), "dst")
    parts = [
        norm,
        part(norms, "INCLUDES", "Theme", "theme", "Norm", "key"),
        part(norms, "APPLIES_IN", "Norm", "key", "Jurisdiction", "jurisdiction"),
        part(units, "HAS_COMPONENT", "Norm", "norm", "Component", "component_id"),
        part(units, "HAS_VERSION", "Component", "component_id", "CTV", "ctv_id"),
        part(units, "HAS_TEXT", "CTV", "ctv_id", "TextUnit", "id"),
        part(maps, "MAPS_TO_CONCEPT", "Component", "component", "Concept", "concept"),
        part(requires, "REQUIRES_CONCEPT", "Procedure", "procedure", "Concept", "concept"),
    ]
    every = reduce(DataFrame.unionByName, parts).distinct()
    for end, kind in (("src", "sk"), ("dst", "dk")):
        every = every.join(known.select(F.col("kind").alias(kind), F.col("id").alias(end)), [kind, end], "left_semi")
    return every.select("rel", "src", "dst")
