"""Visually identical text with different characters: skeletons, canonical text, and the records that need it."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets that look like a Latin letter, each with the letter.
CYRILLIC = "аАВсСԁеЕһҺНіІјЈКӏӀМоОрРԛԚѕЅТѵѴԝԜхХуҮүԌ"
CYRILLIC_AS = "aABcCdeEhhHiIjJKlIMoOpPqQsSTvVwWxXyYyG"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳϹͿ"
GREEK_AS = "ABEZHIKMNOPTYXovcjCJ"
ARMENIAN = "օՕհոսՍցքզլյՏ"
ARMENIAN_AS = "oOhnuUgpqljS"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏔᏙᏚᏞᏟᏢᏦᏧᏭᏴᏒᏎᏊ"
CHEROKEE_AS = "DRTAJEWMHYGZWVSLCPKdGBR4b"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPDTGKJCZFMNLSRVHWXYAEIOU"
COPTIC = "ⲟⲞⲢⲣⲥⲤⲎⲒⲔⲘⲚⲦⲬⲂ"
COPTIC_AS = "oOPpcCHIKMNTXB"
# Latin letters that copy another.
LATIN = "ÐƉɡɑᴄᴏᴠᴡᴢ"
LATIN_AS = "ĐĐgacovwz"


def _by_rule() -> dict[str, str]:
    """Variants of letters and digits that read like them: bold, slanted and sans-serif letters of formulas, Roman numerals, ligatures and digraphs.

    Taken from the character database. Script, black-letter and double-struck forms, raised, lowered, circled and
    squared ones, fractions and signs look different and aren't among them.
    """
    out = {"ℎ": "h"}
    for c in map(chr, [*range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), 0x132, 0x133, *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0x1D400, 0x1D800)]):
        kind = unicodedata.decomposition(c).partition(" ")[0]
        plain_ = unicodedata.normalize("NFKC", c)
        differs = re.search("SCRIPT|FRAKTUR|DOUBLE-STRUCK", unicodedata.name(c, ""))
        if kind == "<font>" and re.fullmatch("[A-Za-z0-9]", plain_) and not differs or kind == "<compat>":
            out[c] = plain_
    return out


LETTER_VARIANTS = _by_rule()
# Characters that can't be seen, and spaces other than the ordinary one, as bodies of character classes.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯ㅤ︀-️﻿ﾠ"
SPACES = "\u0085   -     　"

FOREIGN = dict(zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE + LISU + COPTIC, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS + LISU_AS + COPTIC_AS))
PROTOTYPE = FOREIGN | dict(zip(LATIN, LATIN_AS)) | LETTER_VARIANTS | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_PROTO = str.maketrans(PROTOTYPE)
_ALWAYS = str.maketrans(dict(zip(LATIN, LATIN_AS)) | LETTER_VARIANTS)
#: Finds texts that may hold one of them.
_ODD = re.compile(f"[{LATIN}ℎ\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u2160-\u217f\ufb00-\ufb06\U0001d400-\U0001d7ff]")
_INVISIBLE = re.compile(f"[{INVISIBLE}\U000e0000-\U000e0fff]")
_SPACE = re.compile(f"[{SPACES}]")
_WIDE = re.compile("[\uff01-\uff5e]+")
_CJK = "⺀-⿟、-ヿ㐀-鿿가-힣豈-﫿"
_CJK_END, _CJK_START = re.compile(f"[{_CJK}]$"), re.compile(f"^[{_CJK}]")
_WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
_LATIN_LETTER = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
#: Letters of the alphabets above: Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu.
_OTHER_LETTER = re.compile("[\u0370-\u03ff\u0400-\u052f\u0531-\u0588\u13a0-\u13ff\u2c80-\u2cff\ua4d0-\ua4fd]")

#: Characters that are their own canonical form: ASCII, precomposed Latin letters (without those that copy
#: another letter) and signs that look like nothing else. A text made of these alone needs no closer look.
PLAIN = "\\u0001-\\u007E\\u00A1-\\u00AC\\u00AE-\\u00CF\\u00D1-\\u0131\\u0134-\\u0188\\u018A-\\u01C3\\u01CD-\\u01F0\\u01F4-\\u024F\\u1E00-\\u1EFF\\u2010-\\u2027\\u2030-\\u205E\\u20AC\\u2116\\u2150-\\u215E"
_NOT_PLAIN = re.compile(f"[^{PLAIN}]")


def skeleton(text: str | None) -> str | None:
    """Confusables skeleton: decompose, replace each character by its prototype, decompose again.

    Invisible characters vanish and every kind of space is the ordinary one. Texts that look the same have equal
    skeletons; a skeleton is for comparing, not for reading. Null stays null, '' stays ''.
    """
    if text is None:
        return None
    t = _SPACE.sub(" ", _INVISIBLE.sub("", unicodedata.normalize("NFD", text)))
    return unicodedata.normalize("NFD", t.translate(_PROTO))


def _narrow(m: re.Match) -> str:
    """Wide forms as ASCII, but not punctuation that belongs to Chinese or Japanese text beside it."""
    if not re.search("[\uff10-\uff19\uff21-\uff3a\uff41-\uff5a]", m[0]) and (_CJK_END.search(m.string[: m.start()][-1:]) or _CJK_START.search(m.string[m.end() : m.end() + 1])):
        return m[0]
    return m[0].translate(_PROTO)


def _space(m: re.Match) -> str:
    """An ordinary space, but an ideographic one between ideographs belongs there."""
    if m[0] == "\u3000" and _CJK_END.search(m.string[: m.start()][-1:]) and _CJK_START.search(m.string[m.end() : m.end() + 1]):
        return m[0]
    return " "


def _latinised(text: str) -> str:
    """Letters of other alphabets replaced inside Latin words; real foreign words stay as they are.

    A word with Latin letters is Latin if its other letters all have a Latin look-alike. A word without any is
    taken for Latin if all its letters have one, a neighbouring word is Latin and none is of another alphabet; or if
    the text has no other word.
    """
    words = list(_WORD.finditer(text))
    kinds = []
    for m in words:
        w = m[0]
        other = _OTHER_LETTER.findall(w)
        latin = bool(_LATIN_LETTER.search(w))
        copies = bool(other) and all(c in FOREIGN for c in other)
        kinds.append("latin" if latin and not other else "mixed" if latin and copies else "copy" if copies and not latin else "other" if other else "")
    out, last = [], 0
    for i, m in enumerate(words):
        near = [kinds[j] for j in (i - 1, i + 1) if 0 <= j < len(words)]
        if kinds[i] == "mixed" or kinds[i] == "copy" and "other" not in near and (not near or any(k in ("latin", "mixed") for k in near)):
            out += [text[last : m.start()], "".join(FOREIGN.get(c, c) for c in m[0])]
            last = m.end()
    return "".join(out) + text[last:] if out else text


def canonical(text: str | None) -> str | None:
    """One consistent form of what a text shows. Null stays null, '' stays ''; signs that look different stay.

    Invisible characters go, other spaces and wide forms become the ordinary ones, look-alike letters inside Latin
    words become Latin, accents are composed.
    """
    if text is None or not _NOT_PLAIN.search(text):
        return text
    t = _INVISIBLE.sub("", text)
    t = _WIDE.sub(_narrow, _SPACE.sub(_space, t))
    t = unicodedata.normalize("NFC", t.translate(_ALWAYS) if _ODD.search(t) else t)
    return unicodedata.normalize("NFC", _latinised(t)) if _OTHER_LETTER.search(t) else t


def is_plain(text: Column) -> Column:
    """True for texts that are surely their own canonical form; decided in the JVM."""
    return ~text.rlike(f"[^{PLAIN}]")


def look(text: str | None) -> str | None:
    """The composed skeleton of a text that differs from its own plain decomposition or isn't composed; null for others.

    Where it is null nothing but the text itself has its skeleton in this form, and the text is its own canonical form.
    """
    if text is None:
        return None
    s = skeleton(text)
    return unicodedata.normalize("NFC", s) if s != unicodedata.normalize("NFD", text) or not unicodedata.is_normalized("NFC", text) else None


def candidates(df: DataFrame, text: str) -> DataFrame:
    """Rows of (table_name, row_key, text) whose skeleton differs from what they are made of: ``table_name, row_key, text, look``.

    ``look`` is the hash of the skeleton: texts that look the same have the same. Plain texts are passed over in the
    JVM, as their skeleton is their plain decomposition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            looks = b["text"].map(look)
            hit = looks.notna()
            yield b[hit].assign(look=[hashlib.md5(x.encode("utf-8", "surrogatepass")).hexdigest() for x in looks[hit]])

    rows = df.select("table_name", "row_key", F.col(text).alias("text")).where(F.col("text").isNotNull() & ~is_plain(F.col("text")))
    return rows.mapInPandas(run, "table_name string, row_key string, text string, look string")


def canonical_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows of (table_name, row_key, text) whose text changes, with the new text: ``table_name, row_key, canonical``.

    Candidates come from the skeleton and are grouped by it; ``canonical`` is the exact check, made once per form of a
    group. A frequent group is spread over 16 tasks and read in order, so neither its rows nor a text's length have a
    bound. Null and empty texts never change.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, form = None, None
        for b in batches:
            new = []
            for t in b["text"]:
                if t != last:
                    last, form = t, canonical(t)
                new.append(form)
            new = pd.Series(new, b.index, dtype=object)
            hit = new != b["text"]
            yield pd.DataFrame({"table_name": b["table_name"][hit], "row_key": b["row_key"][hit], "canonical": new[hit]})

    grouped = candidates(df, text).repartition("look", F.pmod(F.xxhash64("row_key"), F.lit(16))).sortWithinPartitions("look", "text")
    return grouped.mapInPandas(run, "table_name string, row_key string, canonical string")


def skeleton_groups(df: DataFrame, text: str) -> DataFrame:
    """Originals grouped by equal skeleton: ``skeleton, n_forms, n_rows``, for groups with more than one form.

    Forms and skeletons are compared by their hashes, so long texts are no longer on the way than short ones. Plain
    texts, whose composed skeleton they are themselves, are hashed in the JVM; of two forms of a group one is no plain
    text and brings the skeleton along. Repeats are counted first, so frequent texts cost one row per task, and groups
    are only counted, never collected. Null texts have no group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = lambda t: hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            looks = b["t"].map(look)
            yield pd.DataFrame({"form": b["t"].map(digest), "look": looks.where(looks.notna(), b["t"]).map(digest), "s": looks.map(lambda s: unicodedata.normalize("NFD", s), na_action="ignore")})

    every = df.select(F.col(text).alias("t")).where("t is not null")
    plain = every.where(is_plain(F.col("t"))).select(F.md5("t").alias("form"))
    known = plain.groupBy("form").agg(F.count(F.lit(1)).alias("n")).select("form", F.col("form").alias("look"), F.lit(None).cast("string").alias("s"), "n")
    others = every.where(~is_plain(F.col("t"))).mapInPandas(run, "form string, look string, s string").groupBy("form", "look").agg(F.first("s").alias("s"), F.count(F.lit(1)).alias("n"))
    groups = known.unionByName(others.select("form", "look", "s", "n")).groupBy("look").agg(F.first("s", ignorenulls=True).alias("skeleton"), F.count("form").alias("n_forms"), F.sum("n").alias("n_rows"))
    return groups.where("n_forms > 1").select("skeleton", "n_forms", "n_rows")
