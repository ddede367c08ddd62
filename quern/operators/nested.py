"""Deeply nested semi-structured records turned into flat tables that keep their parent-child links.

JSON texts of a whole Arrow batch are indexed at once: bitmaps of quotes, brackets and delimiters over the
joined bytes, nesting depth by prefix sums, spans by sorting within each depth. No parser walks the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.session import spread

#: Codes of tokens: brackets, delimiters, strings, other scalars, and the edge of a text.
OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, STRING, SCALAR, EDGE = range(9)
_PUNCT = np.full(256, -1, np.int8)
for _code, _ch in enumerate(b"{}[]:,"):
    _PUNCT[_ch] = _code
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_LITERAL = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")


class JsonIndex:
    """Structural index over many JSON texts.

    Arrays over tokens (in the order written): ``code, start, end`` (byte span, end exclusive, of containers the
    whole), ``doc``, ``depth`` (containers around it), ``parent`` (token of the container around it, -1 at the
    top), ``key`` (token of its name, -1 where it has none), ``pos`` (place in its array, -1 outside arrays),
    ``is_value``. ``valid`` tells for each text whether it is complete JSON; NaN and Infinity pass as numbers.
    """

    def __init__(self, texts: list[bytes]):
        self.n_docs = len(texts)
        self.raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, self.n_docs)
        seps = np.cumsum(sizes + 1) - 1  # the newline after each text
        self.valid = np.ones(self.n_docs, bool)
        doc_of = lambda at: np.searchsorted(seps, at)

        # bitmap of quotes that open or close strings: those after an odd run of backslashes don't
        quote = buf == 0x22
        back = np.flatnonzero(buf == 0x5C)
        if len(back):
            first = np.r_[True, np.diff(back) != 1]
            run_start = back[first]
            run_len = np.diff(np.r_[np.flatnonzero(first), len(back)])
            hit = (run_start + run_len)[run_len % 2 == 1]  # the byte that is escaped
            quote[hit] = False
        else:
            hit = back
        quote_docs = doc_of(np.flatnonzero(quote))
        odd = np.bincount(quote_docs, minlength=self.n_docs) % 2 == 1
        self.valid &= ~odd
        quote[seps[odd]] = True  # so that an unended string ends with its text
        in_string = np.bitwise_xor.accumulate(quote.view(np.uint8)).view(bool)  # from the opening quote on, without the closing
        if len(hit):
            bad = ~in_string[hit] | ~_ESCAPED[buf[hit]]
            u = hit[buf[hit] == 0x75]
            tail = np.minimum(u[:, None] + np.arange(1, 5), len(buf) - 1)
            self.valid[doc_of(u[~_HEX[buf[tail]].all(1)])] = False
            self.valid[doc_of(hit[bad])] = False
        control = np.flatnonzero(buf < 0x20)
        self.valid[doc_of(control[in_string[control]])] = False

        # bitmaps of tokens
        punct = _PUNCT[buf]
        punct[in_string] = -1
        ends = quote & ~in_string
        scalar = ~(in_string | quote | _SPACE[buf] | (punct >= 0))
        scalar_start = scalar & ~np.r_[False, scalar[:-1]]
        start = np.flatnonzero((punct >= 0) | (quote & in_string) | scalar_start)
        code = punct[start].astype(np.int8)
        code[quote[start]] = STRING
        code[scalar_start[start]] = SCALAR
        end = start + 1
        end[code == STRING] = np.flatnonzero(ends) + 1
        end[code == SCALAR] = np.flatnonzero(scalar & ~np.r_[scalar[1:], False]) + 1
        doc = doc_of(start)
        n = len(start)

        # depth by prefix sums, each text from 0
        opens, closes = (code == OPEN_OBJ) | (code == OPEN_ARR), (code == CLOSE_OBJ) | (code == CLOSE_ARR)
        step = opens.astype(np.int32) - closes
        after = np.cumsum(step, dtype=np.int32)
        doc_first = np.searchsorted(doc, np.arange(self.n_docs))
        doc_last = np.searchsorted(doc, np.arange(self.n_docs), "right") - 1
        filled = doc_last >= doc_first
        self.valid &= filled
        base = np.where(doc_first > 0, after[np.maximum(doc_first, 1) - 1] if n else 0, 0)
        after = after - base[doc] if n else after
        before = after - step
        if n:
            self.valid[doc[after < 0]] = False
            self.valid[filled] &= after[doc_last[filled]] == 0

        # the container around each token: sorted by (depth, place), the last opening bracket before it
        level = np.where(closes, before, before)  # a closing bracket lies in the container it closes
        rows = np.r_[np.arange(n), np.flatnonzero(opens)]
        lvl = np.r_[level, after[opens]]
        is_head = np.r_[np.zeros(n, bool), np.ones(int(opens.sum()), bool)]
        order = np.lexsort((is_head, rows, lvl))
        rows, head, lv = rows[order], is_head[order], lvl[order]
        at = np.maximum.accumulate(np.where(head, np.arange(len(rows)), -1))
        same = (at >= 0) & (lv[np.maximum(at, 0)] == lv)
        parent = np.full(n, -1, np.int64)
        members = ~head
        owner = np.where(same, rows[np.maximum(at, 0)], -1)
        parent[rows[members]] = owner[members]
        parent[(level < 1) | ((parent >= 0) & (doc[np.maximum(parent, 0)] != doc))] = -1
        ctx = np.where(parent >= 0, code[np.maximum(parent, 0)], EDGE)
        match_end = np.flatnonzero(closes & (parent >= 0))
        end[parent[match_end]] = end[match_end]

        # grammar: each token against the one before it and its container
        prev = np.r_[np.int8(EDGE), code[:-1]] if n else code
        if n:
            prev[doc_first[filled]] = EDGE
        prev2 = np.r_[np.int8(EDGE), prev[:-1]] if n else code
        text = code == STRING
        value = opens | text | (code == SCALAR)
        ended = np.isin(prev, (CLOSE_OBJ, CLOSE_ARR, SCALAR, STRING))
        in_obj, in_arr, top = ctx == OPEN_OBJ, ctx == OPEN_ARR, ctx == EDGE
        self.is_key = text & in_obj & ((prev == OPEN_OBJ) | (prev == COMMA))
        key_before = np.r_[False, self.is_key[:-1]] if n else self.is_key
        done = ended & ~key_before
        ok = top & value & (prev == EDGE)
        ok |= in_obj & ((value & (prev == COLON)) | self.is_key | ((code == COLON) & key_before) | ((code == COMMA) & done) | ((code == CLOSE_OBJ) & ((prev == OPEN_OBJ) | done)))
        ok |= in_arr & ((value & ((prev == OPEN_ARR) | (prev == COMMA))) | ((code == COMMA) & ended) | ((code == CLOSE_ARR) & ((prev == OPEN_ARR) | ended)))
        self.valid[doc[~ok]] = False
        words: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(code == SCALAR):
            words.setdefault(self.raw[start[i] : end[i]], []).append(i)
        for word, places in words.items():
            if not _LITERAL.fullmatch(word):
                self.valid[doc[places]] = False
        del prev2

        self.code, self.start, self.end, self.doc, self.depth, self.parent = code, start, end, doc, before, parent
        self.is_value = value & ~self.is_key & self.valid[doc] if n else value
        self.key = np.where(self.is_value & in_obj, np.arange(n) - 2, -1)
        # place in the array: values before it under the same parent
        self.pos = np.full(n, -1, np.int64)
        elements = np.flatnonzero(self.is_value & in_arr)
        by_parent = elements[np.argsort(parent[elements], kind="stable")]
        if len(by_parent):
            new = np.r_[True, np.diff(parent[by_parent]) != 0]
            first_at = np.flatnonzero(new)
            self.pos[by_parent] = np.arange(len(by_parent)) - np.repeat(first_at, np.diff(np.r_[first_at, len(by_parent)]))

    def text(self, i: int) -> str | None:
        """A value as text: strings without quotes, null as None, all else as written."""
        span = self.raw[self.start[i] : self.end[i]]
        if self.code[i] == STRING:
            return json.loads(span) if b"\\" in span else span[1:-1].decode()
        return None if span == b"null" else span.decode()

    def named(self, *names: str) -> np.ndarray:
        """Values whose name is one of these; of a name given twice in an object, the last."""
        held = np.flatnonzero(self.key >= 0)
        key = self.key[held]
        size = self.end[key] - self.start[key]
        found = np.zeros(len(held), bool)
        buf = np.frombuffer(self.raw, np.uint8)
        for name in names:
            want = np.frombuffer(b'"' + name.encode() + b'"', np.uint8)
            fit = np.flatnonzero(size == len(want))
            found[fit[(buf[self.start[key[fit]][:, None] + np.arange(len(want))] == want).all(1)]] = True
        # names written with escapes are few; they are read one by one
        for k in np.flatnonzero(size > 2 + min(map(len, names))):
            span = self.raw[self.start[key[k]] : self.end[key[k]]]
            if b"\\" in span:
                found[k] = json.loads(span) in names
        return held[found]

    def last_named(self, name: str) -> dict[int, int]:
        """Container token -> its value of that name."""
        at = self.named(name)
        return dict(zip(self.parent[at].tolist(), at.tolist()))


def unwrapped(texts: list[bytes]) -> tuple[JsonIndex, list[bytes]]:
    """The index of texts after taking off JSON strings that wrap JSON, however often."""
    index = JsonIndex(texts)
    while True:
        whole = np.flatnonzero(index.is_value & (index.parent < 0) & (index.code == STRING))
        inner = {int(index.doc[i]): index.text(i).encode("utf-8", "surrogatepass") for i in whole}
        # a plain string isn't a record; only what may hold one is read again
        inner = {d: t for d, t in inner.items() if t.lstrip()[:1] in (b"{", b"[", b'"')}
        if not inner:
            return index, texts
        texts = [inner.get(d, t) for d, t in enumerate(texts)]
        index = JsonIndex(texts)


def _bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


NODE_SCHEMA = "row_key string, node_id int, parent_id int, depth int, name string, pos int, kind string, value string"


def json_nodes(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Every value of every valid JSON text as a row that names its parent row.

    Columns: row_key (as text), node_id (unique within the text), parent_id (-1 at the top), depth, name (in an object),
    pos (in an array, else null), kind ('object', 'array', 'string', 'scalar'), value (null for containers and
    for JSON null). Texts that are null, blank or not complete JSON give no row. No shuffle.
    """
    kinds = {OPEN_OBJ: "object", OPEN_ARR: "array", STRING: "string", SCALAR: "scalar"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            x, _ = unwrapped(_bytes(batch.column(1)))
            at = np.flatnonzero(x.is_value)
            simple = (x.code[at] == STRING) | (x.code[at] == SCALAR)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[d] for d in x.doc[at]], pa.string()),
                    pa.array(at, pa.int32()),
                    pa.array(x.parent[at], pa.int32()),
                    pa.array(x.depth[at], pa.int32()),
                    pa.array([x.text(k) if k >= 0 else None for k in x.key[at]], pa.string()),
                    pa.array([p if p >= 0 else None for p in x.pos[at].tolist()], pa.int32()),
                    pa.array([kinds[c] for c in x.code[at].tolist()], pa.string()),
                    pa.array([x.text(i) if s else None for i, s in zip(at, simple)], pa.string()),
                ],
                names=["row_key", "node_id", "parent_id", "depth", "name", "pos", "kind", "value"],
            )

    return spread(df.selectExpr(f"cast(`{key}` as string) as k", f"`{payload}` as p")).mapInArrow(run, NODE_SCHEMA)


def _f1_bp(text: str | None) -> int:
    try:
        value = float(text)
        return int(round(value * 10000))
    except (TypeError, ValueError, OverflowError):
        return -1


CITATION_SCHEMA = "raw_id bigint, result_pos int, side string, cite_pos int, van_ban string, khoan string, f1_bp int"


def citation_rows(df: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """Flat citations of nested result envelopes, linked to their result by (raw_id, result_pos).

    A result is the outermost object that has pred_citations, ground_truth_citations or question, whatever wraps
    it; result_pos is its place in the array around it, 0 where there is none. A citation list may be one object.
    khoan is text, '' where absent, null or blank. f1_bp is citation_score.f1 * 10000, rounded, -1 where there is
    none or it is NaN. Elements of a list that aren't objects give no row but keep their place. Texts that are null,
    blank or not complete JSON give none. Whole texts are indexed in batches, there is no shuffle.
    """
    sides = {"pred_citations": "pred", "ground_truth_citations": "gt"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            x, _ = unwrapped(_bytes(batch.column(1)))
            n = len(x.code)
            marks = x.named("question", *sides)
            record = np.zeros(n, bool)
            record[x.parent[marks]] = True
            inside = np.zeros(n, bool)  # is there a record above it?
            up = x.parent.copy()
            while (up >= 0).any():
                inside |= np.where(up >= 0, record[np.maximum(up, 0)], False)
                up = np.where(up >= 0, x.parent[np.maximum(up, 0)], -1)
            record &= ~inside
            scores, f1 = x.last_named("citation_score"), x.last_named("f1")
            out: list[tuple] = []
            lists = [(side, r, c) for name, side in sides.items() for r, c in x.last_named(name).items() if record[r]]
            holds = {c: (side, r) for side, r, c in lists}
            objects = np.flatnonzero(x.is_value & (x.code == OPEN_OBJ))
            cited = [(int(c), *holds[p], int(x.pos[c])) for c, p in zip(objects.tolist(), x.parent[objects].tolist()) if p in holds and x.code[p] == OPEN_ARR]
            cited += [(c, side, r, 0) for side, r, c in lists if x.code[c] == OPEN_OBJ]
            van_ban, khoan = x.last_named("van_ban"), x.last_named("khoan")
            for c, side, r, pos in cited:
                s = scores.get(r)
                f = f1.get(s) if s is not None else None
                k = khoan.get(c)
                v = van_ban.get(c)
                text = x.text(k) if k is not None else None
                out.append((keys[x.doc[c]], int(max(x.pos[r], 0)), side, pos, x.text(v) if v is not None else None, (text or "").strip() and text, _f1_bp(x.text(f)) if f is not None else -1))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["raw_id", "result_pos", "side", "cite_pos", "van_ban", "khoan", "f1_bp"])

    return spread(df.selectExpr(f"cast(`{key}` as bigint) as k", f"`{payload}` as p")).mapInArrow(run, CITATION_SCHEMA)
