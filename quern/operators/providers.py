"""Replaceable column providers for what models compute: embeddings, scores and texts.

A provider is built once per worker and called with batches. The ones here are deterministic stand-ins, so that plans
run and repeat without a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.retrieval import top_k
from quern.sources.sinks import cache_key, cache_lookup

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[tuple[str, str]]], np.ndarray]
Generator = Callable[[list[str]], list[str | None]]


def hash_encoder(width: int = 64) -> Callable[[], Encoder]:
    """Unit vectors from hashed words."""

    def build() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for i, t in enumerate(texts):
                for w in (t or "").lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                    out[i, h % width] += 1 if h >> 63 else -1
            n = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(n == 0, 1, n)

        return encode

    return build


def embed(df: DataFrame, text: str, build: Callable[[], Encoder], batch: int = 256, out: str = "vec") -> DataFrame:
    """Adds a vector column; the encoder is built once per worker. Null texts are encoded as ''."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = build()
        for b in batches:
            vectors = [v for i in range(0, len(b), batch) for v in encode([t or "" for t in b[text].iloc[i : i + batch]])]
            yield b.assign(**{out: [v.astype(np.float32) for v in vectors]})

    return df.mapInPandas(run, f"{fields}, `{out}` array<float>")


def rerank(pairs: DataFrame, build: Callable[[], Scorer], k: int) -> DataFrame:
    """The k best items per query by a pair scorer: ``pairs(q, item, question, text, rank)``; ties keep their earlier rank."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name not in ("score", "rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = build()
        for b in batches:
            yield b.assign(score=score(list(zip(b["question"], b["text"]))).astype(float))

    kept = pairs.select(*[f.name for f in pairs.schema.fields if f.name not in ("score", "rank")], F.col("rank").cast("int").alias("before"))
    return top_k(kept.mapInPandas(run, f"{fields}, before int, score double"), k, tie="before")


def generate(df: DataFrame, prompt: str, model: str, build: Callable[[], Generator], cache: DataFrame) -> DataFrame:
    """Adds ``key`` and ``payload``: from the cache where it has the prompt, else from the generator, once per different prompt."""
    keyed = df.withColumn("key", cache_key(F.lit(model), F.col(prompt)))
    _, missing = cache_lookup(keyed.select("key", prompt).dropDuplicates(["key"]), cache)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = build()
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "payload": make(b[prompt].tolist())})

    fresh = missing.select("key", prompt).mapInPandas(run, "key string, payload string")
    known = cache.select("key", "payload").where("payload is not null").unionByName(fresh).groupBy("key").agg(F.max("payload").alias("payload"))
    return keyed.join(known, "key", "left")
