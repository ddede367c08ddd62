"""Token counts of whole texts by a public byte-level tokenizer, without encoding every text.

Texts of a batch are cut into the tokenizer's words with arrays over their characters, each different word is
encoded once, and counts are summed. The result equals the length of the tokenizer's own encoding.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder with the vocabulary files of public tokenizers, and the file used.
TOKENIZER_DIR = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_BASE = 0x9E3779B97F4A7C15
#: Characters worked on at once, and words remembered, by one worker.
CHUNK_CHARS = 1_000_000
KNOWN_WORDS = 400_000


def _kinds() -> np.ndarray:
    kinds = np.full(1 << 16, _OTHER, np.uint8)
    for c in range(1 << 16):
        cat = unicodedata.category(chr(c))
        kinds[c] = _LETTER if cat[0] == "L" else _NUMBER if cat[0] == "N" else _SPACE if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F) else _OTHER
    return kinds


def load(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Counts tokens of many texts; keeps what it learnt about words."""

    def __init__(self, path: str):
        self.encoding = load(path)
        self.kinds = _kinds()
        self.code = np.random.default_rng(1).integers(1, 1 << 63, 1 << 16, np.uint64) | np.uint64(1)
        self.known = pd.Index(np.empty(0, np.uint64))
        self.sizes = np.empty(0, np.int64)
        n = CHUNK_CHARS + 1
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)], dtype=np.uint64)

    def _learn(self, keys: np.ndarray, where: np.ndarray, begin: np.ndarray, end: np.ndarray, text: str) -> None:
        fresh, first = np.unique(keys[where], return_index=True)
        if len(self.known) + len(fresh) > KNOWN_WORDS:
            self.known, self.sizes = self.known[:0], self.sizes[:0]
            fresh, first = np.unique(keys, return_index=True)
            at = first
        else:
            at = where[first]
        sizes = [len(self.encoding.encode_ordinary(text[begin[i] : end[i]])) for i in at]
        self.known = self.known.append(pd.Index(fresh))
        self.sizes = np.r_[self.sizes, np.array(sizes, np.int64)]

    def _chunk(self, texts: Sequence[str]) -> np.ndarray:
        """Counts of non-empty texts without characters beyond the basic plane."""
        whole = "".join(texts)
        c = np.frombuffer(whole.encode("utf-16-le", "surrogatepass"), np.uint16)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        kind = self.kinds[c]
        edge = np.empty(len(c), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge[ends[:-1]] = True
        at = np.flatnonzero(edge)  # first characters of runs
        stop = np.r_[at[1:], len(c)]
        k = kind[at]
        last = np.isin(stop, ends)  # runs that end their text
        space = k == _SPACE
        plain = c[stop - 1] == 32
        # a run of white space gives its last character to what follows, unless it ends the text
        head = space & ~last & (stop - at > 1)
        own = space & ~last & ~plain
        starts_with_space = np.r_[False, (space & ~last & plain)[:-1]] & ~space
        word = ~space
        begin, end = [at[word] - starts_with_space[word], at[space & last], at[head], stop[own] - 1], [stop[word], stop[space & last], stop[head] - 1, stop[own]]
        # an apostrophe alone before letters takes some endings with it
        quote = np.flatnonzero((k == _OTHER) & (c[at] == 39) & (stop - at == 1) & ~last & ~starts_with_space)
        quote = quote[quote + 1 < len(at)]
        quote = quote[k[quote + 1] == _LETTER]
        if len(quote):
            b, e = begin[0], end[0]
            of = np.cumsum(word) - 1
            for q in quote:
                i = stop[q]
                n = 2 if whole[i : i + 2] in ("ll", "ve", "re") and i + 2 <= stop[q + 1] else 1 if whole[i] in "sdmt" else 0
                if n:
                    e[of[q]] += n
                    b[of[q + 1]] += n
        b, e = np.concatenate(begin), np.concatenate(end)
        some = e > b
        b, e = b[some], e[some]
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum(self.code[c] * self.power[: len(c)], dtype=np.uint64)]
            keys = (sums[e] - sums[b]) * self.inverse[b]
        found = self.known.get_indexer(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            self._learn(keys, missing, b, e, whole)
            found = self.known.get_indexer(keys)
        return np.bincount(np.searchsorted(ends, b, "right"), self.sizes[found], len(texts)).astype(np.int64)

    def count(self, texts: Sequence[str]) -> np.ndarray:
        """Token counts of texts; null and '' count 0."""
        out = np.zeros(len(texts), np.int64)
        batch, at, size = [], [], 0

        def flush() -> None:
            if batch:
                out[at] = self._chunk(batch)

        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > CHUNK_CHARS or max(t) > "￿":
                out[i] = sum(map(len, self.encoding.encode_ordinary_batch([t], num_threads=1)))
                continue
            if size + len(t) > CHUNK_CHARS:
                flush()
                batch, at, size = [], [], 0
            batch.append(t)
            at.append(i)
            size += len(t)
        flush()
        return out


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The counter of this process."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_sizes(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns to keep and ``n_tokens``, the tokens of the whole text; null and '' have 0. No shuffle."""
    file = path or os.path.join(TOKENIZER_DIR, TOKENIZER_FILE)
    fields = {f.name: f for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            out["n_tokens"] = counter(file).count(b["__text"].tolist())
            yield out

    return df.select(*keep, F.col(text).alias("__text")).mapInPandas(run, schema)
