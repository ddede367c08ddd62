"""Building blocks of training sets: leakage filters by name and question, packing order, record shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import ngrams, normalize_space, slug, word_tokens


def shared_ngrams(texts: DataFrame, questions: DataFrame, n: int = 5) -> DataFrame:
    """Texts that share a run of n words with a question: ``item, n_shared`` (different runs).

    Runs of both sides are made distinct before the semi join, so a formula that stands everywhere is joined once per text.
    """
    q = questions.select(F.explode(F.array_distinct(ngrams(word_tokens(F.col("text")), n))).alias("g")).distinct()
    t = texts.select("item", F.explode(F.array_distinct(ngrams(word_tokens(F.col("text")), n))).alias("g"))
    return t.join(q, "g", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n_shared"))


def similar_questions(texts: DataFrame, questions: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of a text and a question whose word sets have at least that Jaccard similarity: ``item, q, jaccard``.

    Prefix filter: ordered from rare to frequent, two sets that similar share a word among the first
    ``size - ceil(least * size) + 1`` of each, so only those words are joined.
    """
    sets = lambda df, key: df.select(F.col(key).alias(key), F.array_distinct(word_tokens(F.col("text"))).alias("w")).where(F.size("w") > 0)
    a, b = sets(texts.dropDuplicates(["item"]), "item"), sets(questions.dropDuplicates(["q"]), "q")
    freq = a.select(F.explode("w").alias("word")).union(b.select(F.explode("w").alias("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("f"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        r = df.select(key, F.size("w").alias("n"), F.explode("w").alias("word")).join(freq, "word").groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("f", "word"))).alias("o"))
        return r.select(key, F.explode(F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("x")).select(key, "x.word")

    pairs = prefix(a, "item").join(prefix(b, "q"), "word").select("item", "q").distinct()
    full = pairs.join(a.withColumnRenamed("w", "wa"), "item").join(b.withColumnRenamed("w", "wb"), "q")
    common = F.size(F.array_intersect("wa", "wb"))
    return full.select("item", "q", (common / (F.size("wa") + F.size("wb") - common)).alias("jaccard")).where(F.col("jaccard") >= least)


def leaking_names(docs: DataFrame, held_out: DataFrame) -> DataFrame:
    """Documents whose name equals or contains a held-out name, after normalising: ``name, held_out``.

    A held-out name of m words can only be contained at one of the name's runs of m words, so runs are joined by equality.
    The different numbers of words, at most as many as the longest held-out name has words, are known to the plan.
    """
    h = held_out.select(F.col("name").alias("held_out"), word_tokens(F.col("name")).alias("w")).where(F.size("w") > 0).select("held_out", F.size("w").alias("m"), F.array_join("w", " ").alias("k")).distinct()
    sizes = sorted(r["m"] for r in h.select("m").distinct().collect())
    each = F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"))
    d = docs.select("name", word_tokens(F.col("name")).alias("w"), each.alias("m")).where(F.size("w") >= F.col("m"))
    runs = d.select("name", "m", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1), lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))).alias("k"))
    return runs.join(h, ["m", "k"]).select("name", "held_out").distinct()


def unique_slugs(names: DataFrame) -> DataFrame:
    """A slug per name, later ones of equal slug with '-b2', '-b3' in order of name: ``name, slug``. Null names have none."""
    s = names.where("name is not null").select("name").distinct().withColumn("base", slug(F.col("name")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("name"))
    return s.withColumn("n", n).select("name", F.when(F.col("n") > 1, F.concat(F.col("base"), F.lit("-b"), F.col("n").cast("string"))).otherwise(F.col("base")).alias("slug"))


def chat_records(samples: DataFrame, system: str) -> DataFrame:
    """Samples as chat messages: ``sample_id, messages`` with system, user and assistant turns. Null answers give no record."""
    user = F.concat_ws("\n\n", F.col("context"), F.concat(F.lit("Câu hỏi: "), F.col("question")))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return samples.where("answer is not null and question is not null").select("sample_id", F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", F.col("answer"))).alias("messages"))


def distinct_questions(samples: DataFrame) -> DataFrame:
    """One sample per normalised question, the one with the least id: ``sample_id, question``."""
    best = samples.where("question is not null").groupBy(normalize_space(F.col("question")).alias("k")).agg(F.min(F.struct("sample_id", "question")).alias("m"))
    return best.select("m.sample_id", "m.question")
