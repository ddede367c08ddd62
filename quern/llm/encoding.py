"""Garbled text from wrong character encoding: finding it and restoring the original.

A character n-gram model is trained on clean records. Each encode-decode chain that changes a text is scored, word by
word, by how much likelier the model finds what it gives; runs of words that gain more than the chain's margin are
garbled passages. Margins are validated on all clean records, as they are and with words garbled on purpose, each by a
model that wasn't trained on it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut, spread

#: Least margin in nats; the validated ones may be higher.
LEAST_MARGIN = 8.0
#: A clean record taken for garbled counts as much as so many garbled words missed, when margins are validated.
FALSE_ALARM = 10
#: Words that a worker remembers at most, or counts before it hands the counts on; no word is left out for it.
KNOWN_WORDS = 200_000
#: A word that a chain leaves alone costs a passage so many nats.
GAP_COST = 0.5

# The single-byte Vietnamese code TCVN 5712 (VN3), as characters of Latin-1, and what they stand for.
TCVN3 = "¡¢£¤¥¦§¨©ª«¬­®µ¶·¸¹»¼½¾ÆÇÈÉÊËÌÎÏÐÑÒÓÔÕÖ×ØÜÝÞßáâãäåæçèéêëìíîïñòóôõö÷øùúûüýþ"
TCVN3_AS = "ĂÂÊÔƠƯĐăâêôơưđàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ"
#: Encodings that UTF-8 is mistaken for.
MISREAD_AS = ("cp1252", "cp1250", "cp1251", "cp1258", "mac_roman", "cp437", "cp850", "iso8859-2", "iso8859-9", "koi8_r")

#: What decoders put in place of bytes that are lost.
REPLACEMENT = "\ufffd"

_TCVN3 = str.maketrans(TCVN3, TCVN3_AS)
_TO_TCVN3 = str.maketrans(TCVN3_AS, TCVN3)
_SPLIT = re.compile(r"[^ \t\r\n]+")

# Letters of Vietnamese with their marks, lower case.
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"


class Misread:
    """UTF-8 read as a single-byte encoding; bytes it leaves undefined count as the characters of equal number."""

    def __init__(self, codec: str):
        to_byte = {chr(b): b for b in range(0x80, 0x100)} if codec == "cp1252" else {}
        for b in range(0x80, 0x100):
            c = bytes([b]).decode(codec, "ignore")
            to_byte[c if len(c) == 1 else chr(b)] = b
        cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in to_byte.items() if lo <= b <= hi) + "]"
        tail = cls(0x80, 0xBF)
        self.pattern = re.compile(f"{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}}")
        self._to_byte = to_byte
        self._to_char = {b: c for c, b in to_byte.items()}

    def _decoded(self, m: re.Match) -> str:
        try:
            return bytes(map(self._to_byte.__getitem__, m[0])).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    def __call__(self, text: str) -> str:
        return self.pattern.sub(self._decoded, text)

    def garble(self, text: str) -> str:
        """The wrong decoding itself."""
        return "".join(self._to_char.get(b, chr(b)) for b in text.encode("utf-8", "surrogatepass"))


def _from_tcvn3(text: str) -> str:
    """Words that lost bytes stay as they are: what is left of them no longer tells its code."""
    return _SPLIT.sub(lambda m: m[0] if REPLACEMENT in m[0] else m[0].translate(_TCVN3), text)


def _chains() -> dict[str, Callable[[str], str]]:
    """All chains by name; those that begin alike come with the shorter one first."""
    once = {f"utf-8 as {c}": Misread(c) for c in MISREAD_AS}
    first = once["utf-8 as cp1252"]
    twice = {f"{n}, twice": (lambda t, f=f: f(f(t))) for n, f in list(once.items())[:4]}
    mixed = {f"{n} in cp1252": (lambda t, f=f: f(first(t))) for n, f in list(once.items())[1:4]}
    return once | twice | mixed | {"tcvn3": _from_tcvn3}


CHAINS = _chains()


def garbled_by(chain: str, text: str) -> str:
    """The text as the chain would have to undo it."""
    if chain == "tcvn3":
        return text.translate(_TO_TCVN3)
    name = chain.removesuffix(", twice").removesuffix(" in cp1252")
    once = CHAINS[name].garble(text)
    return once if name == chain else CHAINS[name].garble(once) if chain.endswith("twice") else CHAINS["utf-8 as cp1252"].garble(once)


def _words(text: str) -> list[str]:
    """What _SPLIT finds, and empty strings."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class CharModel:
    """Character trigrams, smoothed by interpolation with bigrams and single characters."""

    def __init__(self, grams: dict[str, int]):
        self.n = [Counter(), Counter(), Counter()]
        for g, c in grams.items():
            self.n[len(g) - 1][g] += c
        self.total = sum(self.n[0].values())
        self.kinds = len(self.n[0]) + 1
        self.seen: dict[str, float] = {}

    def _one(self, gram: str) -> float:
        """log P(last character | the two before)."""
        if (known := self.seen.get(gram)) is None:
            a, ab, abc = self.n
            p = (a.get(gram[2], 0) + 0.1) / (self.total + 0.1 * self.kinds * 1000)
            p = (ab.get(gram[1:], 0) + 5 * p) / (a.get(gram[1], 0) + 5)
            p = (abc.get(gram, 0) + 5 * p) / (ab.get(gram[:2], 0) + 5)
            known = math.log(p)
            if len(self.seen) < 500_000:
                self.seen[gram] = known
        return known

    def score(self, word: str) -> float:
        """log P of a word between spaces."""
        t = f"  {word} "
        one = self._one
        return sum(one(t[i : i + 3]) for i in range(len(t) - 2))


def grams(words: Counter) -> Counter:
    """Counts of one, two and three characters over words with their counts, padded as in scoring."""
    out: Counter = Counter()
    for w, n in words.items():
        t = f"  {w} "
        for size in (1, 2, 3):
            for i in range(len(t) - size + 1):
                out[t[i : i + size]] += n
    return out


class Scorer:
    """What chains make of words and how many nats each gains; words are scored once per chain."""

    def __init__(self, model: CharModel):
        self.model = model
        self.memo: dict[str, dict[str, tuple[str, float]]] = {n: {} for n in CHAINS}
        self.dull: set[str] = set()
        self.good: dict[str, dict[str, float]] = {}

    def gain(self, chain: str, word: str) -> tuple[str, float]:
        """The word as the chain gives it, and its gain."""
        memo = self.memo[chain]
        if (known := memo.get(word)) is None:
            if len(memo) > 200_000:
                memo.clear()
            new = CHAINS[chain](word)
            memo[word] = known = (new, -GAP_COST if new == word else self.model.score(new) - self.model.score(word))
        return known

    def _gains(self, word: str) -> dict[str, float]:
        """Chains by which the word gains, and how much."""
        if (known := self.good.get(word)) is None:
            known = {} if word.isascii() else {n: g for n in _usable(word) if (g := self.gain(n, word)[1]) > 0}
            of = self.good if known else self.dull
            if len(of) > KNOWN_WORDS:
                of.clear()
            if known:
                self.good[word] = known
            else:
                self.dull.add(word)
        return known

    def gaining(self, text: str, words: set[str] | None = None) -> dict[str, float]:
        """Chains by which some word of the text gains, with the most any passage can: the gains of all such words together.

        Where there is none, no run of words can gain; nearly all texts end here, at the cost of splitting them.
        """
        most: dict[str, float] = {}
        if text.isascii():
            return most
        for w in (set(_words(text)) if words is None else words) - self.dull:
            for n, g in self._gains(w).items():
                most[n] = most.get(n, 0.0) + g * text.count(w)
        return most

    def passages(self, text: str, margins: dict[str, float]) -> list[tuple[float, int, int, str]]:
        """The passages, each undone by one chain, that together gain most beyond their chains' margins: (gain, begin, end, chain).

        One pass from left to right: a word is either left as it is or goes on with, or opens, a passage of a chain.
        """
        chains = [n for n, most in self.gaining(text).items() if most > margins[n]]
        if not chains:
            return []
        state = [(n, self.memo[n], margins[n]) for n in chains]
        sums, begins, before = [-math.inf] * len(chains), [0] * len(chains), [None] * len(chains)
        top, link = 0.0, None
        for m in _SPLIT.finditer(text):
            w = m[0]
            if w.isascii():
                for c in range(len(sums)):
                    sums[c] -= GAP_COST
                continue
            new_top, new_link = top, link
            for c, (n, memo, margin) in enumerate(state):
                known = memo.get(w)
                if known is None:
                    known = self.gain(n, w)
                if sums[c] < top - margin:
                    sums[c], begins[c], before[c] = top - margin, m.start(), link
                sums[c] += known[1]
                if sums[c] > new_top:
                    new_top, new_link = sums[c], (before[c], begins[c], m.end(), c, sums[c])
            top, link = new_top, new_link
        out = []
        while link:
            earlier, begin, end, c, total = link
            out.append((total - (earlier[4] if earlier else 0.0) + margins[chains[c]], begin, end, chains[c]))
            link = earlier
        return out[::-1]


def _usable(text: str) -> list[str]:
    """Names of chains that change the text; those of two steps where their first step does."""
    names = [n for n, f in CHAINS.items() if isinstance(f, Misread) and f.pattern.search(text)]
    more = [n for n in CHAINS if n.removesuffix(", twice") in names and n.endswith("twice") or n.endswith("in cp1252") and "utf-8 as cp1252" in names]
    return names + more + ["tcvn3"]


def restored(text: str, scorer: Scorer, margins: dict[str, float]) -> tuple[list[str], str]:
    """Chains accepted, those that gain most first, and the text with all their passages restored.

    What a chain leaves may be garbled still, so passages are looked for again until there are none; every round makes
    the text likelier, so it ends.
    """
    gains: dict[str, float] = {}
    while found := scorer.passages(text, margins):
        out, last = [], 0
        for gain, begin, end, name in found:
            gains[name] = gains.get(name, 0.0) + gain
            out += [text[last:begin], _SPLIT.sub(lambda m: scorer.gain(name, m[0])[0], text[begin:end])]  # noqa: B023
            last = end
        text = "".join(out) + text[last:]
    return sorted(gains, key=lambda n: (-gains[n], n)), text


#: Letters and signs that clean text is made of, as the body of a character class.
_SAFE = "\\n\\r\\t -~À-ÏÑ-Öà-ïñ-öùúûüýÙÚÛÜÝŒœ" + VIETNAMESE + VIETNAMESE.upper() + "«»“”‘’–—…°º²³§±©®№½•·×€ "
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ" + VIETNAMESE + VIETNAMESE.upper()


def _suspicious() -> re.Pattern:
    lower = "a-zà-öø-ÿ" + VIETNAMESE
    signs = "¡¢£¤¥¦¨ª¬®µ¶·¸¹¼½¾×÷©§"
    return re.compile(f"[^{_SAFE}]|[{lower}][À-Þ]|[Â-ß][\u0080-¿]|[à-ô][\u0080-¿]{{2}}|[{_LETTER}][{signs}«]|[{signs}»][{_LETTER}]")


#: Finds records that aren't taken for clean ones to train on: with a character clean text doesn't have, a capital with
#: an accent after a small letter, a lead byte with what follows it, or a sign of the single-byte codes inside a word.
#: It decides nothing else: every text is scored.
SUSPICIOUS = _suspicious()


_UNSAFE = re.compile(f"[^{_SAFE}]")


def undoable(word: str) -> bool:
    """Whether bytes of UTF-8 that were read as signs and letters of clean text, as in QUYá»€N, give letters of clean text.

    Capitals that quotes and dashes follow in clean text, as in “ĐÔ THỊ XÃ”, don't count.
    """
    of = (m for f in CHAINS.values() if isinstance(f, Misread) for m in f.pattern.finditer(word) if m[0][0] not in "ÃĂ" and f(m[0]) != m[0] and not _UNSAFE.search(f(m[0])))
    return not word.isascii() and any(of)


class Clean:
    """Tells records without anything suspicious or undoable by their words, each looked at once: neither goes across a space."""

    def __init__(self):
        self.safe: set[str] = set()

    def __call__(self, words: set[str]) -> bool:
        new = words - self.safe
        if any(map(SUSPICIOUS.search, new)) or any(map(undoable, new)):
            return False
        if len(self.safe) > KNOWN_WORDS:
            self.safe.clear()
        self.safe |= new
        return True


def _margin(clean: Counter, planted: Counter, n_clean: int) -> float:
    """The margin with the fewest errors, from counts of gains in whole nats: of clean records, and of words garbled on purpose.

    Garbled passages that got among the clean records weigh little, as they are few. Of equally good margins in a row the
    middle one is taken.
    """
    n_planted = sum(planted.values())
    tried = range(int(LEAST_MARGIN), max([*clean, *planted, int(LEAST_MARGIN)]) + 2)
    cost = [FALSE_ALARM * sum(n for g, n in clean.items() if g >= m) / max(n_clean, 1) + sum(n for g, n in planted.items() if g < m) / max(n_planted, 1) for m in tried]
    first = cost.index(min(cost))
    last = first
    while last + 1 < len(cost) and cost[last + 1] == cost[first]:
        last += 1
    return float(tried[(first + last) // 2] if n_planted else tried[first])


def train(documents: DataFrame, key: str, text: str) -> tuple[CharModel, dict[str, float]]:
    """The model of clean text and the validated margin of each chain, both from all clean records.

    Clean records are those without anything suspicious or undoable: of very many records even rare garbled ones would
    teach the model their signs. Their words are counted on the executors, by halves that a hash
    of the key tells; the model is that of both halves. To validate, every clean record is judged by the model of the half
    it isn't in: what a chain gains on the record is told against what it gains on words garbled for it, every clean
    word as often as it occurs, and the margin between both makes the fewest errors. Without clean records the model is
    empty.
    """
    half = F.pmod(F.xxhash64(F.lit("model"), F.col(key).cast("string")), F.lit(2)).cast("int")
    texts = spread(documents.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(text).alias("t"), half.alias("half")))

    def by_half(seen: tuple[Counter, Counter], what: str) -> pd.DataFrame:
        rows = [(i, x, n) for i, c in enumerate(seen) for x, n in c.items() if x]
        return pd.DataFrame(rows, columns=["half", what, "n"]).astype({"half": "int32", what: "object", "n": "int64"})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, clean = (Counter(), Counter()), Clean()
        for b in batches:
            for t, i in zip(b["t"], b["half"]):
                words = _words(t)
                if clean(set(words)):
                    seen[i].update(words)
            if sum(map(len, seen)) > KNOWN_WORDS:
                yield by_half(seen, "word")
                seen = (Counter(), Counter())
        yield by_half(seen, "word")

    words = cut(texts.mapInPandas(count, "half int, word string, n bigint").groupBy("half", "word").agg(F.sum("n").alias("n")))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for b in batches:
            for i in (0, 1):
                of = b[b["half"] == i]
                seen[i].update(grams(Counter(dict(zip(of["word"], of["n"].tolist())))))
        yield by_half(seen, "gram")

    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for r in words.mapInPandas(spell, "half int, gram string, n bigint").groupBy("half", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["half"]][r["gram"]] = r["n"]
    others = documents.sparkSession.sparkContext.broadcast((CharModel(counts[1]), CharModel(counts[0])))

    def by_gain(seen: Counter) -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["chain", "planted", "gain", "n"]).astype({"chain": "object", "planted": "bool", "gain": "int32", "n": "int64"})

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, clean = Counter(), Clean()
        scorers, free = [Scorer(m) for m in others.value], dict.fromkeys(CHAINS, 0.0)
        for b in batches:
            for t, i in zip(b["t"], b["half"]):
                if not clean(words := set(_words(t))):
                    continue
                seen["", False, 0] += 1
                for n in scorers[i].gaining(t, words):
                    seen[n, False, math.floor(max((g for g, *_ in scorers[i].passages(t, free | {o: math.inf for o in CHAINS if o != n})), default=0.0))] += 1
        yield by_gain(seen)

    def planted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for i, w, times in zip(b["half"], b["word"], b["n"].tolist()):
                model = others.value[i]
                for n in () if w.isascii() else CHAINS:
                    bad = garbled_by(n, w)
                    if bad != w and CHAINS[n](bad) == w:
                        seen[n, True, math.floor(max(0.0, model.score(w) - model.score(bad)))] += times
        yield by_gain(seen)

    kind = "chain string, planted boolean, gain int, n bigint"
    rows = texts.mapInPandas(kept, kind).union(words.mapInPandas(planted, kind)).groupBy("chain", "planted", "gain").agg(F.sum("n").alias("n")).collect()
    of = lambda chain, planted: Counter({r["gain"]: r["n"] for r in rows if r["chain"] == chain and r["planted"] == planted})
    return CharModel(counts[0] + counts[1]), {n: _margin(of(n, False), of(n, True), sum(of("", False).values())) for n in CHAINS}


def garbled(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Records with a garbled passage: ``key, chains, restored``.

    ``chains`` names what was undone, what gained most first; a record with replacement characters is garbled beyond
    restoring and may have none. ``restored`` is the text with all restorable passages restored. Null, empty and clean
    texts give no row. Whole texts are scored, of any length and with any number of passages, in time linear in their
    length; there is no shuffle of texts.
    """
    model, margins = train(documents, key, text)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"]):
                used, new = restored(t, scorer, margins)
                if used or REPLACEMENT in t:
                    rows.append((k, used, new))
            yield pd.DataFrame(rows, columns=["key", "chains", "restored"])

    kind = dict(documents.dtypes)[key]
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return spread(rows).mapInPandas(run, f"key {kind}, chains array<string>, restored string")
