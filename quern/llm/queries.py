"""Queries of the language-model data operators (problems 2, 4, 6, 8, 9 and 10) and their SQL.

SQL can't express these; they are tested against brute force, exact round trips and held-out accuracy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import encoding, leakage, lookalikes, mixing, packing, pairs, tokens
from quern.session import cut
from quern.tables import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_question").select(F.col("id").alias("item_id"), F.col("question").alias("text"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates allow for an edit; the exact check asks for the words as they are."""
    return leakage.leaks(leakage.sample_texts(table(spark, sf_dir, "train_sample")), _items(spark, sf_dir), max_edits=1, within=0)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _leaks(spark, sf_dir)
    return found.select("sample_id", F.col("item_id").alias("question_id"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, sf_dir), _items(spark, sf_dir))


def p2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks in which one word of the passage was inserted, deleted or changed count as well."""
    return leakage.leaks(leakage.sample_texts(table(spark, sf_dir, "train_sample")), _items(spark, sf_dir), max_edits=1)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "eval_result")).withColumnRenamed("key", "result_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, key, text: table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))
    return of("eval_result", "result_id", "answer").unionByName(of("text_unit", "id", "text")).unionByName(of("candidate", "cand_id", "term_norm"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_canonical(spark, sf_dir).select("table_name", "row_key")


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.canonical_rows(_texts(spark, sf_dir), "text")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.skeleton_groups(_texts(spark, sf_dir), "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sizes = tokens.token_sizes(documents, "text", ["doc_id"])
    return packing.containers(sizes, table(spark, sf_dir, "container_spec"), documents.count())


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir), table(spark, sf_dir, "container_spec"))


#: Most a source's share of the mix of P9 may differ from its target, in parts of the whole. Exact shares would let the
#: few records of one source decide the total and leave most of the corpus unused.
MIX_DEVIATION = 0.05


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(tokens.token_sizes(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"]))
    return mixing.mixture(sizes, table(spark, sf_dir, "mix_target"), max_deviation=MIX_DEVIATION)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_restored(spark, sf_dir).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_report, p2_near, p4_found, p6_found, p6_canonical, p6_groups, p8_containers, p8_fill, p9_mixture, p9_shares, p10_found, p10_restored)
}
ORACLE: dict[str, str] = {}
