"""Data-quality rules, duplicate and foreign-key checks, and resolution of citations."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.dates import is_blank, parse_day


def messages(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules that are broken (their condition is true), in order."""
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]), lambda m: m.isNotNull())


def lint_norms(norms: DataFrame) -> DataFrame:
    """Rows of norms with what is wrong with them: ``id, problems``; rows without problems are left out."""
    i = F.col("id")
    frm, to = parse_day(F.col("valid_from")), parse_day(F.col("valid_to"))
    rules = messages(
        (is_blank(i), "id missing"),
        (~i.rlike(r"^[a-z0-9][a-z0-9-]*[a-z0-9]$"), "id malformed"),
        (is_blank(F.col("title")), "title missing"),
        (F.col("tier").isNull() | ~F.col("tier").between(1, 4), "tier out of range"),
        (F.col("theme").isNull(), "theme missing"),
        (F.col("jurisdiction").isNull(), "jurisdiction missing"),
        (~is_blank(F.col("valid_from")) & frm.isNull(), "valid_from unreadable"),
        (is_blank(F.col("valid_from")), "valid_from missing"),
        (~is_blank(F.col("valid_to")) & to.isNull(), "valid_to unreadable"),
        (frm > to, "validity reversed"),
        (F.exists(F.coalesce("implements", F.array().cast("array<string>")), lambda x: is_blank(x)), "implements has a blank"),
        (F.col("file").isNotNull() & (F.col("file") != F.concat(i, F.lit(".md"))), "file differs from id"),
    )
    return norms.select("id", F.array_join(rules, "; ").alias("problems")).where("length(problems) > 0")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: ``key, n``."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Distinct child keys without a parent, with their count: ``key, n``. Counted before the join, so hot keys shrink first."""
    c = children.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(parents.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti")


def lint_questions(questions: DataFrame) -> DataFrame:
    """Test items with what is wrong with them: ``id, problems``, distinct."""
    neg = F.col("gap_type") == "negative"
    n = F.coalesce(F.size("ground_truth_citations"), F.lit(0))
    rules = messages(
        (is_blank(F.col("question")), "question missing"),
        (F.col("theme").isNull() & ~neg, "theme missing"),
        (F.col("gap_type").isNull() | ~F.col("gap_type").isin("gap1", "gap2", "gap3", "gap4", "negative"), "gap_type unknown"),
        (neg & (n > 0), "negative with citations"),
        (~neg & (n <= 0), "no citations"),
        (is_blank(F.col("ground_truth_answer")), "answer missing"),
    )
    return questions.select("id", F.array_join(rules, "; ").alias("problems")).where("length(problems) > 0").distinct()


def register_pairs(questions: DataFrame) -> DataFrame:
    """Pairs of questions whose ground truths differ or that have no partner: ``pair_id, n_ids, same``."""
    q = questions.where("pair_id is not null").select("pair_id", "id", F.sort_array(F.transform("ground_truth_citations", lambda c: F.concat_ws("|", c["van_ban"], c["dieu"], c["khoan"]))).alias("gt")).distinct()
    g = q.groupBy("pair_id").agg(F.countDistinct("id").alias("n_ids"), (F.countDistinct("gt") == 1).alias("same"))
    return g.where((F.col("n_ids") != 2) | ~F.col("same"))


def not_finite(*cols: Column) -> Column:
    """True if any of the numbers is NaN or infinite."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    return bad


def unresolved(citations: DataFrame, leaves: DataFrame) -> DataFrame:
    """Citations that don't resolve, with the first level that fails: ``cite_id, level``.

    ``citations(cite_id, norm, dieu, khoan)``, ``leaves(norm, dieu, khoan)``. Levels are anti-joined one after the other.
    """
    norm = leaves.select("norm").distinct()
    article = leaves.select("norm", "dieu").distinct()
    clause = leaves.where("khoan is not null").select("norm", "dieu", "khoan").distinct()
    no_norm = citations.join(norm, "norm", "left_anti").select("cite_id", F.lit("van_ban").alias("level"))
    known = citations.join(norm, "norm", "left_semi")
    no_article = known.where("dieu is not null").join(article, ["norm", "dieu"], "left_anti").select("cite_id", F.lit("dieu").alias("level"))
    deep = known.where("khoan is not null").join(article, ["norm", "dieu"], "left_semi")
    no_clause = deep.join(clause, ["norm", "dieu", "khoan"], "left_anti").select("cite_id", F.lit("khoan").alias("level"))
    return no_norm.unionByName(no_article).unionByName(no_clause)


def leaf_place(path: Column) -> Column:
    """Where a leaf stands, by the headings of its path: a struct of ``dieu, khoan, diem, pl``, null where there is none.

    ``pl`` is the whole heading of an appendix.
    """

    def last(rx: str) -> Column:
        below = F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0)))
        return F.try_element_at(F.filter(F.transform(below, lambda x: F.regexp_extract(x, rx, 1)), lambda x: x != ""), F.lit(-1))

    part = r"^%s\s+([\p{L}\p{N}_]+)"
    return F.struct(last(part % "Điều").alias("dieu"), last(part % "Khoản").alias("khoan"), last(part % "Điểm").alias("diem"), last(r"^(Phụ lục[\s\S]*)").alias("pl"))


@F.pandas_udf(T.StringType())
def appendix_label(c: pd.Series) -> pd.Series:
    """Headings of appendices in the form they are compared in: composed, lower case, single spaces."""
    return c.map(lambda t: " ".join(unicodedata.normalize("NFC", t).lower().split()), na_action="ignore")


def is_appendix(loai: Column, dieu: Column) -> Column:
    """True for citations of an appendix."""
    return F.coalesce(loai == "phu_luc", F.lit(False)) | F.coalesce(F.lower(F.trim(dieu)).startswith("phụ lục"), F.lit(False))


def appendix_target(dieu: Column) -> Column:
    """What a citation of an appendix names, as a label: 'I' is 'phụ lục i'."""
    return appendix_label(F.when(F.lower(F.trim(dieu)).startswith("phụ lục"), dieu).otherwise(F.concat(F.lit("phụ lục "), dieu)))


def labels_match(label: Column, target: Column, dieu: Column) -> Column:
    """True where one label begins with the other, or the citation names no sign ('_default')."""
    return (F.trim(dieu) == "_default") | label.startswith(target) | target.startswith(label)


def unresolved_levels(citations: DataFrame, leaves: DataFrame) -> DataFrame:
    """Citations that don't resolve, with the first level that fails: ``cite_id, level``.

    ``citations(cite_id, norm, loai, dieu, khoan, diem)``, ``leaves(norm, dieu, khoan, diem, pl)`` as of ``leaf_place``.
    Levels: van_ban (also without one), dieu_missing, then dieu, khoan and diem, or phu_luc and phu_luc_khoan of an
    appendix. A point counts only under a clause. The appendices of one norm are gathered in a list.
    """
    yes = F.lit(True)
    c = citations.select("cite_id", "norm", "loai", *[F.trim(x).alias(x) for x in ("dieu", "khoan", "diem")])
    marks = [(["norm"], "has_norm"), (["norm", "dieu"], "has_dieu"), (["norm", "dieu", "khoan"], "has_khoan"), (["norm", "dieu", "khoan", "diem"], "has_diem")]
    appendix = is_appendix(F.col("loai"), F.col("dieu"))
    known = c.join(leaves.select("norm").distinct().withColumn("has_norm", yes), "norm", "left")
    first = F.when(F.col("has_norm").isNull(), "van_ban").when(is_blank(F.col("dieu")), "dieu_missing")
    articles = known.where(~appendix | is_blank(F.col("dieu")))
    for keys, name in marks[1:]:
        articles = articles.join(leaves.dropna(subset=keys).select(*keys).distinct().withColumn(name, yes), keys, "left")
    clause = F.col("khoan").isNotNull()
    level = first.when(F.col("has_dieu").isNull(), "dieu").when(clause & F.col("has_khoan").isNull(), "khoan").when(clause & F.col("diem").isNotNull() & F.col("has_diem").isNull(), "diem")
    labels = leaves.where("pl is not null").select("norm", "pl", "khoan").distinct().select("norm", F.struct(appendix_label("pl").alias("pl"), "khoan").alias("l")).groupBy("norm").agg(F.collect_set("l").alias("labels"))
    others = known.where(appendix & ~is_blank(F.col("dieu"))).withColumn("target", appendix_target(F.col("dieu"))).join(labels, "norm", "left")
    fits = F.filter(F.coalesce("labels", F.array().cast("array<struct<pl:string,khoan:string>>")), lambda l: labels_match(l["pl"], F.col("target"), F.col("dieu")))
    others = others.withColumn("fits", fits)
    of = first.when(F.size("fits") == 0, "phu_luc").when(clause & ~F.coalesce(F.exists("fits", lambda l: l["khoan"].eqNullSafe(F.col("khoan"))), F.lit(False)), "phu_luc_khoan")
    return articles.select("cite_id", level.alias("level")).unionByName(others.select("cite_id", of.alias("level"))).where("level is not null")


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    """Counts and shares of all combinations of keys."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def spacing_problems(lines: DataFrame) -> DataFrame:
    """Headings not followed by a blank line: ``doc, pos``. ``lines(doc, pos, line)``."""
    w = Window.partitionBy("doc").orderBy("pos")
    return lines.withColumn("next", F.lead("line").over(w)).where(F.col("line").startswith("#") & F.col("next").isNotNull() & (F.length(F.trim("next")) > 0)).select("doc", "pos")
