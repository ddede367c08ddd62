"""Citations in text: grammar, formatting, positions and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("dieu", "khoan", "diem", "tiet", "van_ban", "loai")
CITATION_TYPE = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"
OPEN_END = "9999-12-31"


def _strip(c: Column) -> Column:
    """Trimmed of every kind of white space."""
    return F.regexp_replace(c, r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")


def _part(block: Column, word: str) -> Column:
    """What follows a word at the start of the last comma-separated part that begins with it; null where none does."""
    hits = F.filter(F.transform(F.split(block, ","), lambda p: _strip(p)), lambda p: p.rlike(f"(?iu)^{word}"))
    return _strip(F.regexp_replace(F.try_element_at(hits, F.lit(-1)), f"(?iu)^{word}", ""))


def parse_citations(text: Column) -> Column:
    """Citations in square brackets, whatever the order of their parts: array of ``CITATION_TYPE``.

    A block needs a document and an article or appendix; an article needs a number, an appendix without one is
    '_default'. If a block names both, the later wins. Repeats keep their first place; null text has none.
    """

    def parse(block: Column) -> Column:
        parts = F.transform(F.split(block, ","), lambda p: _strip(p))
        heads = F.filter(parts, lambda p: p.rlike(r"(?iu)^(?:Điều|Phụ\s*lục)"))
        head = F.try_element_at(heads, F.lit(-1))
        article = head.rlike(r"(?iu)^Điều")
        number = F.nullif(_strip(F.regexp_replace(head, r"(?iu)^(?:Điều|Phụ\s*lục)", "")), F.lit(""))
        get = lambda w: F.nullif(_part(block, w), F.lit(""))
        return F.struct(
            F.when(article, number).otherwise(F.coalesce(number, F.when(head.isNotNull(), F.lit("_default")))).alias("dieu"),
            get("Khoản").alias("khoan"),
            get("Điểm").alias("diem"),
            get("Tiết").alias("tiet"),
            get(r"Văn\s*bản").alias("van_ban"),
            F.when(head.isNull(), F.lit(None)).when(article, F.lit("dieu")).otherwise(F.lit("phu_luc")).alias("loai"),
        )

    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    found = F.transform(blocks, parse)
    return F.array_distinct(F.filter(found, lambda c: c["van_ban"].isNotNull() & c["loai"].isNotNull() & c["dieu"].isNotNull()))


def format_citation(c: Column) -> Column:
    """A citation as text in square brackets, the inverse of ``parse_citations``."""
    head = F.when(c["loai"] == "phu_luc", F.when(c["dieu"] == "_default", F.lit("Phụ lục")).otherwise(F.concat(F.lit("Phụ lục "), c["dieu"]))).otherwise(F.concat(F.lit("Điều "), c["dieu"]))
    pre = lambda word, v: F.when(v.isNotNull(), F.concat(F.lit(word + " "), v))
    return F.concat(F.lit("["), F.concat_ws(", ", head, pre("Khoản", c["khoan"]), pre("Điểm", c["diem"]), pre("Tiết", c["tiet"]), pre("Văn bản", c["van_ban"])), F.lit("]"))


# The word for an article as questions spell it; the strict class doesn't know the small crossed d.
ARTICLE, ARTICLE_STRICT = "[ĐđDd]i[ềê]u", "[ĐDd]i[ềê]u"


# A clause of an article as questions write it, and the number after a word.
CLAUSE_OF_ARTICLE = r"[Kk]ho[ảà]n\s+(\d+[\p{{L}}\p{{N}}_]*)\s+(?:c[ủù]a\s+)?{article}\s+(\d+[\p{{L}}\p{{N}}_]*)"


def structured_cites(question: Column, strict: bool = True) -> Column:
    """(dieu, khoan) pairs a question names: array of structs, pairs with a clause first.

    An article named alone is left out if it also comes with a clause. ``strict`` keeps to capital or plain d.
    """
    article = ARTICLE_STRICT if strict else ARTICLE
    with_clause = CLAUSE_OF_ARTICLE.format(article=article)
    q = F.coalesce(question, F.lit(""))
    khoan, dieu = F.regexp_extract_all(q, F.lit(with_clause), F.lit(1)), F.regexp_extract_all(q, F.lit(with_clause), F.lit(2))
    pairs = F.zip_with(dieu, khoan, lambda d, k: F.struct(d.alias("dieu"), k.alias("khoan")))
    alone = F.array_except(F.regexp_extract_all(q, F.lit(rf"{article}\s+(\d+[\p{{L}}\p{{N}}_]*)"), F.lit(1)), dieu)
    bare = F.transform(alone, lambda d: F.struct(d.alias("dieu"), F.lit(None).cast("string").alias("khoan")))
    return F.concat(F.array_distinct(pairs), bare)


def citation_label(path: Column, tier: Column, valid_from: Column, valid_to: Column) -> Column:
    """Label of a unit: tier and validity in square brackets, then its place and document.

    A unit whose validity has ended is marked as expired; without tier and start there is no bracket.
    """
    place = F.array_join(F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), ", ")
    base = F.when(F.length(place) > 0, F.concat(place, F.lit(" ("), path[0], F.lit(")"))).otherwise(path[0])
    ended = valid_to.isNotNull() & (valid_to != "") & (valid_to != OPEN_END)
    validity = F.when(
        F.length(valid_from) > 0,
        F.when(ended, F.concat(F.lit("Hiệu lực: "), valid_from, F.lit(" → "), valid_to, F.lit(" (HẾT HIỆU LỰC)"))).otherwise(F.concat(F.lit("Hiệu lực: "), valid_from)),
    )
    meta = F.concat_ws(" | ", F.when(tier.isNotNull(), F.concat(F.lit("Tier "), tier.cast("string"))), validity)
    return F.when(F.length(meta) > 0, F.concat(F.lit("["), meta, F.lit("] "), base)).otherwise(base)


def amendments_warning(amendments: Column) -> Column:
    """Block that warns of amendments, oldest first (no date sorts first); '' without amendments."""
    keyed = F.array_sort(F.transform(amendments, lambda a: F.struct(F.coalesce(a["effective_date"], F.lit("0000-00-00")).alias("d"), a["amending_norm"].alias("n"), a["amending_loc"].alias("l"), F.trim(F.coalesce(a["content_summary"], F.lit(""))).alias("c"))))
    dash = lambda c: F.coalesce(c, F.lit("?"))
    date = lambda a: F.when(a["d"] == "0000-00-00", F.lit("?")).otherwise(a["d"])
    lines = F.transform(keyed, lambda a: F.concat(F.lit("  - "), dash(a["n"]), F.lit(" ("), dash(a["l"]), F.lit(", hiệu lực "), date(a), F.lit("): "), a["c"]))
    head = F.lit("[AMENDMENT WARNING — nội dung Component này đã/sắp bị sửa đổi:]")
    return F.when(F.coalesce(F.size(amendments), F.lit(0)) > 0, F.concat_ws("\n", head, F.array_join(lines, "\n"))).otherwise(F.lit(""))


def parse_label(label: Column) -> Column:
    """Tier, validity, place and document of a label: struct of strings, null where absent.

    Of an article the first mention counts, of deeper levels the last.
    """
    one = lambda rx: F.nullif(F.regexp_extract(label, rx, 1), F.lit(""))
    last = lambda rx: F.try_element_at(F.regexp_extract_all(label, F.lit(rx), F.lit(1)), F.lit(-1))
    return F.struct(
        one(r"Tier (\d+)").alias("tier"),
        one(r"Hiệu lực: (\d{4}-\d{2}-\d{2})").alias("valid_from"),
        one(r"→ (\d{4}-\d{2}-\d{2})").alias("valid_to"),
        label.contains("HẾT HIỆU LỰC").alias("expired"),
        one(r"Điều\s+([\p{L}\p{N}]+)").alias("dieu"),
        last(r"Khoản\s+([\p{L}\p{N}]+)").alias("khoan"),
        last(r"Điểm\s+([\p{L}\p{N}]+)").alias("diem"),
        one(r"\(([a-z0-9-]+)\)\s*$").alias("norm_id"),
    )


def context_blocks(context: Column) -> Column:
    """Blocks of a context text, in order: array of (label, body). Text before the first label is left out."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(context, F.lit(""))), r"\n(?=--- )"), lambda p: p.startswith("--- "))
    label = lambda p: F.regexp_replace(F.regexp_extract(p, r"^--- ([^\n]*)", 1), r"\s*---\s*$", "")
    return F.transform(parts, lambda p: F.struct(label(p).alias("label"), _strip(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))


def cited_in_context(c: Column, context: Column) -> Column:
    """True if a header of the context names the document, the article and, where there is one, the clause."""
    return cited_in_blocks(c, context_blocks(context))


def cited_in_blocks(c: Column, blocks: Column) -> Column:
    """The same for a context already taken apart by ``context_blocks``, which is worth while where many citations meet one."""
    header = lambda b: F.lower(b["label"])
    article = F.concat(F.lit("điều "), F.lower(c["dieu"]))
    names = lambda b: F.contains(F.concat(F.regexp_replace(header(b), r"[.,(]", " "), F.lit(" ")), F.concat(article, F.lit(" ")))
    clause = lambda b: c["khoan"].isNull() | F.contains(F.concat(F.regexp_replace(header(b), r"[.,(]", " "), F.lit(" ")), F.concat(F.lit("khoản "), F.lower(c["khoan"]), F.lit(" ")))
    return F.exists(blocks, lambda b: F.contains(header(b), F.lower(c["van_ban"])) & names(b) & clause(b))


def answer_sections(answer: Column) -> Column:
    """The three sections of a structured answer, in whatever order their headers stand; '' where one is missing."""

    def body(name: str) -> Column:
        rx = rf"(?imsu)^##\s+{name}\s*$(.*?)(?=^##\s+(?:TRẢ\s*LỜI|CẢNH\s*BÁO\s*LEX|PHẠM\s*VI)\s*$|\z)"
        return F.regexp_replace(F.regexp_extract(F.coalesce(answer, F.lit("")), rx, 1), r"^\s+|\s+$", "")

    return F.struct(body(r"TRẢ\s*LỜI").alias("tra_loi"), body(r"CẢNH\s*BÁO\s*LEX").alias("canh_bao_lex"), body(r"PHẠM\s*VI").alias("pham_vi"))
