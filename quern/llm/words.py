"""Words of a text, compared without case, accents, punctuation, markup and characters that can't be seen."""

from __future__ import annotations

import re
import unicodedata

from quern.llm.lookalikes import INVISIBLE

_HIDDEN = re.compile(f"[{INVISIBLE}]|</?[A-Za-z][^<>]{{0,80}}>|(?<=\\w)[*_~`]+(?=\\w)")
_MARKS = re.compile("[̀-ͯ]+")
_WORDS = re.compile(r"[^\W_]+")
_SPLIT = {ord(a): " " for a in "_"}


def plain(text: str) -> str:
    """Lower case, without marks (d for the crossed d), invisible characters and markup inside words."""
    t = _HIDDEN.sub("", text)
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t)).replace("đ", "d").replace("Đ", "d")
    return t.lower()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the plain text; none for null."""
    return _WORDS.findall(plain(text)) if text else []
