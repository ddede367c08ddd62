"""Sinks: tables, caches, manifests and reports."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def create_if_absent(spark: SparkSession, name: str, ddl: str) -> None:
    """A table that exists after the call, whether or not it did before."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")


def cache_key(model: Column, prompt: Column) -> Column:
    """Content address of a model call."""
    return F.substring(F.sha2(F.concat_ws("|", model, prompt), 256), 1, 16)


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a readable cached payload, and those without. ``requests(key, ...)``, ``cache(key, payload)``; null payloads are misses."""
    good = cache.where("payload is not null").groupBy("key").agg(F.max("payload").alias("payload"))
    return requests.join(good, "key"), requests.join(good, "key", "left_anti")


def unmapped(components: DataFrame, done: DataFrame, key: str = "component_id") -> DataFrame:
    """What a resumed run still has to do."""
    return components.join(done.select(key).distinct(), key, "left_anti")


def write_overwrite(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Full rebuild of a table, optionally in partitions."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls left out; one file per task."""
    df.write.mode("overwrite").json(path)


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 of files: ``file, sha256, n_bytes``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def markdown_table(df: DataFrame, most: int = 1000, digits: int = 3) -> str:
    """An aggregate as a Markdown table; more than ``most`` rows are refused, as a report isn't for them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    body = ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *body]) + "\n"


def html_table(df: DataFrame, most: int = 1000) -> str:
    """An aggregate as an HTML table, escaped."""
    import html

    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    return "<table><tr>" + head + "</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows) + "</table>"


def write_text(text: str, path: str) -> None:
    """A report on the driver's disk."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
