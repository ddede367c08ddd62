"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vietnamese letters by base letter, for engines without Unicode decomposition.
MARKED = {
    "a": "àáảãạăằắẳẵặâầấẩẫậ",
    "e": "èéẻẽẹêềếểễệ",
    "i": "ìíỉĩị",
    "o": "òóỏõọôồốổỗộơờớởỡợ",
    "u": "ùúủũụưừứửữự",
    "y": "ỳýỷỹỵ",
    "d": "đ",
}
_FROM = "".join(MARKED.values())
_TO = "".join(k * len(v) for k, v in MARKED.items())

#: Characters per token in the cheap estimate.
CHARS_PER_TOKEN = 3.5


def strip_marks(c: Column) -> Column:
    """Vietnamese letters without their marks, case kept; d for the crossed d."""
    return F.translate(c, _FROM + _FROM.upper(), _TO + _TO.upper())


def normalize_space(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def slug_tokens(c: Column) -> Column:
    """Distinct ASCII tokens of more than one character; null text gives an empty array."""
    parts = F.split(strip_marks(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 1))


def slug(c: Column, most: int | None = None) -> Column:
    """ASCII words joined by dashes, cut after ``most`` characters."""
    s = F.regexp_replace(F.regexp_replace(strip_marks(F.lower(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return s if most is None else F.regexp_replace(F.substring(s, 1, most), "-+$", "")


def word_tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, repeats kept; null text gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def content_tokens(c: Column, stop: list[str], least: int = 3) -> Column:
    """Distinct lower-case words of letters only, at least so long and not in the stop list."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return F.array_except(F.filter(found, lambda t: F.length(t) >= least), F.array(*[F.lit(s) for s in stop]))


def ngrams(tokens: Column, n: int = 5) -> Column:
    """Runs of n tokens joined by spaces, in order; empty where there are fewer."""
    at = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1)))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 where both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def estimate_tokens(c: Column, per_token: float = CHARS_PER_TOKEN) -> Column:
    """Cheap token estimate of a text, at least 1; null counts as ''."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / per_token).cast("int"))


def path_id(path: Column) -> Column:
    """Deterministic 16-digit hexadecimal id of a path of names."""
    return F.substring(F.sha2(F.array_join(path, ">"), 256), 1, 16)


def hex_to_number(c: Column) -> Column:
    """A 16-digit hexadecimal id as a number; Spark has no unsigned 64-bit type."""
    return F.conv(c, 16, 10).cast("decimal(20,0)")


def number_to_hex(c: Column) -> Column:
    """A number as a 16-digit hexadecimal id."""
    return F.lpad(F.lower(F.conv(c.cast("string"), 10, 16)), 16, "0")


def truncate_text(c: Column, most: int) -> Column:
    """Text cut to ``most`` characters with an ellipsis where it was longer."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def thousands(c: Column) -> Column:
    """A whole number with dots between thousands."""
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit("."))


def flip_first(c: Column) -> Column:
    """The first character in the other case."""
    a = F.substring(c, 1, 1)
    return F.concat(F.when(a == F.upper(a), F.lower(a)).otherwise(F.upper(a)), F.substr(c, F.lit(2)))


def html_escape(c: Column) -> Column:
    """Characters that mean something in HTML as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fenced_json(c: Column) -> Column:
    """The body of a fenced code block, or the text between the first opening and the last closing brace."""
    body = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(F.trim(body), F.lit("")), F.nullif(braces, F.lit("")), F.trim(c))


# First words of an amendment's content, longest first, and the change they name.
CHANGE_TYPES = (
    ("sửa đổi, bổ sung", "sua-doi-bo-sung"),
    ("thay cụm từ", "thay-cum-tu"),
    ("bổ sung", "bo-sung"),
    ("thay thế", "thay-the"),
    ("bãi bỏ", "bai-bo"),
    ("sửa đổi", "sua-doi"),
    ("thay", "thay-the"),
)


def change_type(c: Column) -> Column:
    """Kind of change an amendment's content begins with; 'khac' for all else."""
    t = F.lower(F.trim(c))
    out = F.lit("khac")
    for words, kind in reversed(CHANGE_TYPES):
        out = F.when(t.startswith(words), F.lit(kind)).otherwise(out)
    return out


def snippet(text: Column, needle: Column, before: int = 200, after: int = 50, else_first: int = 400) -> Column:
    """Characters around the first place of a needle, or the first characters of the text."""
    at = F.position(needle, text)
    begin = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, begin, at - begin + F.length(needle) + after)).otherwise(F.substring(text, 1, else_first))


# The kinds of documents their names begin with.
DOCUMENT_KINDS = (
    ("nghi dinh", "nghi-dinh"), ("thong tu lien tich", "thong-tu-lien-tich"), ("thong tu", "thong-tu"), ("quyet dinh", "quyet-dinh"),
    ("nghi quyet", "nghi-quyet"), ("phap lenh", "phap-lenh"), ("bo luat", "bo-luat"), ("luat", "luat"),
)
# Words of a name that aren't part of what the document is called.
ISSUERS = (
    "của Quốc hội", "của Hội đồng nhân dân và Uỷ ban nhân dân", "của Hội đồng nhân dân", "của Uỷ ban nhân dân", "của Ủy ban nhân dân", "của Chính phủ",
)
#: Words of a name that go into an identifier.
NAME_WORDS = 12
#: Number, year and sign of a document, with a mark before them that isn't part of a word.
NUMBER = r"(^|[^\p{L}\p{N}_])(\d{1,4})\s*/\s*(\d{4})\s*/\s*([A-Za-zĐđ]{2,}\d*(?:-[A-Za-zĐđ]+)*)"


def document_number(c: Column) -> Column:
    """The official number in a document's name, lower case and without marks: '102/2024/nd-cp'; null where there is none."""
    part = lambda i: F.regexp_extract(c, NUMBER, i)
    return F.when(part(2) != "", F.concat_ws("/", part(2), part(3), F.lower(strip_marks(part(4)))))


def document_year(c: Column) -> Column:
    """The year of a document: that of its number, else the one its name gives as 'năm YYYY'; null without either."""
    year = lambda rx, i: F.nullif(F.regexp_extract(c, rx, i), F.lit(""))
    return F.coalesce(year(NUMBER, 3), year(r"(?iu)(?:^|[^\p{L}\p{N}_])năm\s+(\d{4})(?![\p{L}\p{N}_])", 1)).cast("int")


def document_kind(c: Column) -> Column:
    """Kind of document its name begins with, the longest that fits; null for others."""
    kinds = "|".join(k for _, k in DOCUMENT_KINDS)
    return F.nullif(F.regexp_extract(F.concat(slug(c), F.lit("-")), f"^({kinds})-", 1), F.lit(""))


def document_slug(c: Column) -> Column:
    """Identifier of a document from its name; null without a kind or a year, nothing is guessed.

    Kind, number, year and sign for a document below the laws that has a number; else kind, name and year. The name is
    what is left of the words without number and issuer after the kind, or after 'về' where at most two words come
    before that; of a long name the first words.
    """
    kind, number, year = document_kind(c), document_number(c), document_year(c)
    bare = F.regexp_replace(c, NUMBER, "$1 ")
    for words in (*(w.replace(" ", r"\s+") for w in ISSUERS), r"(?<![\p{L}\p{N}_])số(?![\p{L}\p{N}_])"):
        bare = F.regexp_replace(bare, f"(?iu){words}", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^[ ,.-]+|[ ,.-]+$", "")
    about = r"(?iu)^([^ ]+(?: [^ ]+)?) về (.+)$"

    def named(t: Column) -> Column:
        before, after = F.regexp_extract(t, about, 1), F.regexp_extract(t, about, 2)
        own = document_kind(F.when(before != "", before).otherwise(t))
        words = F.split(t, " ")
        rest = F.when(before != "", after).otherwise(F.array_join(F.slice(words, F.size(F.split(own, "-")) + 1, F.size(words)), " "))
        name = F.array_join(F.slice(F.split(slug(rest), "-"), 1, NAME_WORDS), "-")
        return F.when(own.isNotNull() & (F.length(name) > 0), F.concat_ws("-", own, name, year.cast("string")))

    # by way of an array, so that the words are worked out once
    called = F.transform(F.array(bare), named)[0]
    below = kind.isNotNull() & ~kind.isin("luat", "bo-luat") & number.isNotNull()
    return F.when(year.isNotNull(), F.when(below, F.concat_ws("-", kind, slug(number))).otherwise(called))
