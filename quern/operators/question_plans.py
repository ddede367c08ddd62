"""Structured question plans: validation of what a planner returns, defaults, and named variants of the retrieval plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.dates import temporal_anchor
from quern.functions.text import document_number, fenced_json, strip_marks

PLAN_SCHEMA = (
    "theme string, procedure string, jurisdiction string, temporal string, response_mode string,"
    " temporal_intent struct<has_temporal_context: boolean, temporal_anchor: string, case_status: string, reasoning: string>"
)
# What a plan's fields may hold.
THEMES = ("dat-dai", "ho-tich", "nuoi-con-nuoi")
JURISDICTIONS = ("toan-quoc", "tp-hcm", "dong-nai", "multi-juris")
MODES = ("general", "irac")


def cleaned_plan(raw: Column) -> Column:
    """A planner's answer, fenced or not, as a plan struct; values outside the enumerations are null, the mode falls back to general.

    Text that is no JSON gives a plan of nulls.
    """
    p = F.from_json(fenced_json(raw), PLAN_SCHEMA)
    one_of = lambda c, allowed: F.when(c.isin(*allowed), c)
    return F.struct(
        one_of(p["theme"], THEMES).alias("theme"),
        p["procedure"].alias("procedure"),
        one_of(p["jurisdiction"], JURISDICTIONS).alias("jurisdiction"),
        F.coalesce(one_of(p["response_mode"], MODES), F.lit("general")).alias("response_mode"),
        F.coalesce(temporal_anchor(p["temporal_intent"]["temporal_anchor"]), temporal_anchor(p["temporal"])).alias("temporal"),
    )


# Themes that are national where no place is named, and stages of a case that may fall under two laws.
NATIONAL_THEMES = ("ho-tich", "nuoi-con-nuoi")
SPANNING = ("do-dang", "moi")


def settled_plan(raw: Column, force_jurisdiction: str | None = None) -> Column:
    """A planner's answer as the plan that is carried out: values checked, defaults filled in.

    Themes that are national take that jurisdiction where none is named, then ``force_jurisdiction`` stands in. Where
    the question has a time, a case that is open or new filters by none, as it may fall under two laws, another by its
    anchor; vague anchors filter nothing.
    """
    p, clean = F.from_json(fenced_json(raw), PLAN_SCHEMA), cleaned_plan(raw)
    intent = p["temporal_intent"]
    national = F.when(clean["theme"].isin(*NATIONAL_THEMES), F.lit("toan-quoc"))
    dated = F.when(~F.coalesce(intent["case_status"].isin(*SPANNING), F.lit(False)), temporal_anchor(intent["temporal_anchor"]))
    return F.struct(
        clean["theme"].alias("theme"),
        clean["procedure"].alias("procedure"),
        forced(F.coalesce(clean["jurisdiction"], national), force_jurisdiction).alias("jurisdiction"),
        clean["response_mode"].alias("response_mode"),
        F.when(F.coalesce(intent["has_temporal_context"], F.lit(False)), dated).otherwise(temporal_anchor(p["temporal"])).alias("temporal"),
    )


# Document numbers and identifiers as texts name them.
NUMBER_IN_TEXT = r"(?iu)(?<![\p{L}\p{N}_])\d{1,4}/\d{4}/(?:nđ-cp|nd-cp|nq-hđnd|nq-hdnd|qđ-ubnd|qd-ubnd|qh\d+|tt-[a-zđ-]+)(?![\p{L}\p{N}_])"
ID_IN_TEXT = r"(?<![\p{L}\p{N}_])(?:luat|nghi-dinh|thong-tu|quyet-dinh|nghi-quyet)-[a-z0-9-]+(?![\p{L}\p{N}_])"


def theme_from_references(texts: DataFrame, norms: DataFrame) -> DataFrame:
    """The theme of the documents a text names, by number or identifier: ``key, theme``; texts whose documents have several, or none, are left out.

    ``texts(key, text)``, ``norms(id, title, theme)``. References are joined by equality, so a document many texts name
    meets one row.
    """
    number = lambda c: F.lower(strip_marks(c))
    named = F.concat(F.transform(F.regexp_extract_all("text", F.lit(NUMBER_IN_TEXT), F.lit(0)), number), F.regexp_extract_all("text", F.lit(ID_IN_TEXT), F.lit(0)))
    refs = texts.select("key", F.explode(F.array_distinct(named)).alias("ref"))
    known = norms.where(F.col("theme").isin(*THEMES)).select("theme", F.explode(F.array(F.lower("id"), document_number(F.col("title")))).alias("ref")).where("ref is not null").distinct()
    found = refs.join(known, "ref").select("key", "theme").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("theme").alias("theme"))
    return found.where("n = 1").select("key", "theme")


def forced(column: Column, value: str | None) -> Column:
    """A value that stands in where the plan has none."""
    return column if value is None else F.coalesce(column, F.lit(value))


@dataclass(frozen=True)
class Ablation:
    """Parts of the retrieval plan that are left out."""

    theme: bool = False
    jurisdiction: bool = False
    implements: bool = False
    amends: bool = False
    temporal: bool = False
    traversal: bool = False
    graph: bool = False

    @property
    def relations(self) -> list[str]:
        """Relations the closure walks."""
        off = self.traversal or self.graph
        return [] if off else [r for r, left_out in (("IMPLEMENTS", self.implements), ("AMENDS", self.amends)) if not left_out]


# Named variants.
ABLATIONS = {
    "full": Ablation(),
    "no-theme": Ablation(theme=True),
    "no-jurisdiction": Ablation(jurisdiction=True),
    "no-implements": Ablation(implements=True),
    "no-amends": Ablation(amends=True),
    "no-temporal": Ablation(temporal=True),
    "no-traversal": Ablation(traversal=True),
    "dense-only": Ablation(graph=True),
    "graphrag-basic": Ablation(theme=True, jurisdiction=True, temporal=True),
}


def label_candidates(questions: DataFrame, labels: DataFrame, least: int = 2, per_norm: int = 3) -> DataFrame:
    """Units whose label holds at least so many tokens of a question, the best few per document: ``q, item, norm, overlap``.

    ``questions(q, tokens)``, ``labels(item, norm, tokens)``; tokens are joined by equality.
    """
    from quern.operators.graph import per_group_cap

    a = questions.select("q", F.explode(F.array_distinct("tokens")).alias("t"))
    b = labels.select("item", "norm", F.explode(F.array_distinct("tokens")).alias("t"))
    hits = a.join(b, "t").groupBy("q", "item", "norm").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= least)
    return per_group_cap(hits.withColumn("o", F.struct(-F.col("overlap"), "item")), ["q", "norm"], "o", per_norm).drop("o")


def over_budget(df: DataFrame, prompt_tokens: str, new_tokens: int, window: int) -> DataFrame:
    """Rows whose prompt leaves no room for the answer in a model's window."""
    return df.where(F.col(prompt_tokens) + F.lit(new_tokens) > window)
