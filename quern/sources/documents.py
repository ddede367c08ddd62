"""Sources of structured documents: front matter, headings, annotations, JSON and lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.dates import iso_of_dmy
from quern.functions.text import change_type, path_id

# Fields of a document's front matter.
FRONT_MATTER = (
    "id string, title string, tier int, theme string, jurisdiction string, implements array<string>, valid_from string, valid_to string,"
    " source_url string, source_vbhn string, amended_by_norms array<string>, so_hieu string, summary string"
)
# Annotations of amendments and original versions inside comments.
AMENDMENT = r"(?s)<!--\s*amended_by:\s*([^,]+),\s*([^,]+),\s*hiệu lực:\s*([\d/]+),\s*nội dung:\s*(.+?)\s*-->"
ORIGINAL = r"(?s)<!--\s*original_v_(\d{4}-\d{2}-\d{2}):\s*(.+?)\s*-->"


def read_texts(spark: SparkSession, path: str, glob: str = "*.md", exclude: list[str] | None = None) -> DataFrame:
    """Whole files as ``file, content``, without those excluded by name."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("content"))
    return named.where(~F.col("file").isin(exclude)) if exclude else named


def split_front_matter(content: Column) -> tuple[Column, Column]:
    """Front matter and body of a text; '' and the whole text where there is no front matter."""
    rx = r"(?s)^\uFEFF?---\r?\n(.*?)\r?\n---[ \t]*\r?\n?(.*)$"
    has = content.rlike(r"(?s)^\uFEFF?---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|$)")
    return F.when(has, F.regexp_extract(content, rx, 1)).otherwise(F.lit("")), F.when(has, F.regexp_extract(content, rx, 2)).otherwise(content)


def front_matter_fields(docs: DataFrame, text: str = "front") -> DataFrame:
    """Front matter as columns of ``FRONT_MATTER`` beside the others; values that can't be read are null.

    Scalars, quoted or not, inline lists and dash lists are read. ``implements`` may be one value,
    ``amended_by_norms`` only a list. Arrow batches, as Spark has no reader for this format.
    """
    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    names = [x.strip().split(" ")[0] for x in FRONT_MATTER.split(",")]

    def scalar(v: str) -> str | None:
        v = v.strip()
        if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"":
            return v[1:-1]
        return None if v in ("", "null", "~", "Null", "NULL") else v

    def parse(t: str | None) -> dict:
        out: dict = {}
        last = None
        for line in (t or "").split("\n"):
            if line.strip().startswith("- ") and last is not None:
                out[last] = (out[last] if isinstance(out.get(last), list) else []) + [scalar(line.strip()[2:])]
            elif ":" in line and not line.startswith((" ", "#")):
                last, v = line.split(":", 1)
                v = v.strip()
                out[last] = [scalar(x) for x in v[1:-1].split(",") if x.strip()] if v.startswith("[") and v.endswith("]") else scalar(v)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b[text]:
                r = parse(t)
                imp, am = r.get("implements"), r.get("amended_by_norms")
                tier = str(r.get("tier") or "")
                row = {n: r.get(n) if not isinstance(r.get(n), list) else None for n in names}
                row |= {"tier": int(tier) if tier.isdigit() else None, "implements": [imp] if isinstance(imp, str) else imp, "amended_by_norms": am if isinstance(am, list) else None}
                rows.append(row)
            extra = pd.DataFrame(rows, columns=names)
            extra["tier"] = extra["tier"].astype("Int32")
            yield pd.concat([b.reset_index(drop=True), extra], axis=1)

    return docs.mapInPandas(run, ", ".join(keep) + ", " + FRONT_MATTER)


def amendments(text: Column) -> Column:
    """Amendment annotations in order: array of structs; dates as ISO where they can be read."""
    get = lambda i: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AMENDMENT), F.lit(i))
    return F.transform(
        F.arrays_zip(get(1).alias("n"), get(2).alias("l"), get(3).alias("d"), get(4).alias("c"), get(0).alias("r")),
        lambda a: F.struct(
            F.trim(a["n"]).alias("amending_norm"), F.trim(a["l"]).alias("amending_loc"), iso_of_dmy(a["d"]).alias("effective_date"), change_type(a["c"]).alias("change_type"),
            F.trim(a["c"]).alias("content_summary"), a["r"].alias("raw_match"),
        ),
    )


def original_version(text: Column) -> Column:
    """The original version annotated in a text: struct of date_label and text, or null."""
    label = F.nullif(F.regexp_extract(text, ORIGINAL, 1), F.lit(""))
    return F.when(label.isNotNull(), F.struct(label.alias("date_label"), F.trim(F.regexp_extract(text, ORIGINAL, 2)).alias("text")))


# What headings of each level begin with.
HEADINGS = {2: ("Điều", "Phụ lục"), 3: ("Khoản",), 4: ("Điểm",), 5: ("Tiết",)}


def _lines(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Lines of texts with their place, heading level (null for text), heading and what is wrong with them."""
    line = docs.select(F.col(key).alias("norm_id"), F.posexplode(F.split(F.regexp_replace(F.col(body), r"(?s)<!--.*?-->", ""), "\n")).alias("pos", "raw"))
    signs = F.length(F.regexp_extract("raw", r"^(#+) \S", 1))
    head = F.when(signs > 0, F.trim(F.regexp_replace("raw", r"^#+ ", "")))
    wrong = F.when((signs == 1) | (signs > 5), F.lit("level"))
    for level, kinds in HEADINGS.items():
        wrong = wrong.when((signs == level) & ~head.rlike(rf"^(?:{'|'.join(kinds)})(?![\p{{L}}\p{{N}}_])"), F.lit("kind"))
    seen = F.max(signs > 0).over(Window.partitionBy("norm_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    wrong = wrong.when((signs == 0) & (F.length(F.trim("raw")) > 0) & ~seen, F.lit("text before a heading"))
    usual = signs.between(2, 5)
    return line.select("norm_id", "pos", F.trim("raw").alias("line"), F.when(usual, signs).alias("level"), F.when(usual, head).alias("head"), wrong.alias("problem"))


def heading_problems(docs: DataFrame, key: str = "norm_id", body: str = "body") -> DataFrame:
    """What strict parsing objects to: ``norm_id, pos, problem``; 'level' (1 or above 5), 'kind' (a heading that doesn't begin like its level's) or 'text before a heading'."""
    return _lines(docs, key, body).where("problem is not null").select("norm_id", "pos", "problem")


def leaf_units(docs: DataFrame, key: str = "norm_id", body: str = "body", strict: bool = True, raising: bool = False) -> DataFrame:
    """Leaf units of documents with headings of levels 2 to 5: ``norm_id, unit_id, context_path, text, ord``.

    Text belongs to the last heading; its path is the document's id and the headings above, a shallower heading ending
    deeper ones. Headings without text give no unit. ``strict`` drops text before any heading and units under headings of
    other kinds; else such headings are kept. ``raising`` lets the query fail at the first of ``heading_problems``, naming
    it, where nothing may be dropped. Each level's heading is filled forward within a document.
    """
    lines = _lines(docs, key, body)
    w = Window.partitionBy("norm_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cols = {f"p{n}": F.last(F.when(F.col("level") == n, F.col("pos")), True).over(w) for n in range(2, 6)}
    cols |= {f"h{n}": F.last(F.when(F.col("level") == n, F.col("head")), True).over(w) for n in range(2, 6)}
    filled = lines.withColumns(cols).withColumn("at", F.last(F.when(F.col("level").isNotNull(), F.col("pos")), True).over(w))
    names = [F.col("norm_id")]
    for n in range(2, 6):
        shallower = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"p{m}"), F.lit(-1)) for m in range(2, n)])
        names.append(F.when(F.col(f"p{n}") > shallower, F.col(f"h{n}")))
    path = F.filter(F.array(*names), lambda x: x.isNotNull())
    is_text = F.col("level").isNull() & (F.length("line") > 0)
    if raising:
        said = F.concat(F.lit("line "), (F.col("pos") + 1).cast("string"), F.lit(" of "), F.col("norm_id"), F.lit(": "), F.col("problem"))
        is_text = F.when(F.col("problem").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(is_text)
    texts = filled.withColumn("path", path).where(is_text)
    if strict:
        texts = texts.where(F.col("at").isNotNull() & F.get(F.col("path"), F.lit(1)).rlike(r"(?iu)^(?:Điều|Phụ\s*lục)\b"))
    units = texts.groupBy("norm_id", F.coalesce("at", F.lit(-1)).alias("ord")).agg(F.first("path").alias("context_path"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return units.select("norm_id", path_id(F.col("context_path")).alias("unit_id"), "context_path", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), "ord")


def read_envelopes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files that hold ``{..., results: [...]}``, a bare list or one record, as rows of the record schema with ``file``."""
    texts = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    wrapped = F.from_json("value", f"results array<struct<{schema}>>")["results"]
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{schema}>>"))
    single = F.array(F.from_json("value", f"struct<{schema}>"))
    return texts.select("file", F.explode(F.coalesce(bare, wrapped, single)).alias("r")).select("file", "r.*")


def read_json_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON lines that can be read, and the lines that can't."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    read = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", options).alias("r"))
    return read.where("r._corrupt is null").select("r.*").drop("_corrupt"), read.where("r._corrupt is not null").select(F.col("value").alias("_corrupt"))


def grouped_questions(lines: DataFrame) -> DataFrame:
    """A list of questions with group headers and notes: ``file, pos, group_name, note, question``.

    ``lines(file, pos, line)``. ``# name`` begins a group, ``> text`` is a note for the next question, blank lines don't count.
    """
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("pos")
    t = F.trim("line")
    rows = lines.where(F.length(t) > 0).select("file", "pos", t.alias("t"))
    kinds = rows.withColumns({"is_head": F.col("t").startswith("#"), "is_note": F.col("t").startswith(">")})
    filled = kinds.withColumns({"group_name": F.last(F.when(F.col("is_head"), F.trim(F.regexp_replace("t", "^#+", ""))), True).over(w), "prev_note": F.lag(F.when(F.col("is_note"), F.trim(F.regexp_replace("t", "^>+", "")))).over(before)})
    return filled.where("not is_head and not is_note").select("file", "pos", "group_name", F.col("prev_note").alias("note"), F.col("t").alias("question"))


def latest_complete_run(rows: DataFrame, run: str, key: str, expected: int) -> DataFrame:
    """Rows of the last run (by name) with exactly so many rows, all different by key."""
    runs = rows.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d")).where((F.col("n") == expected) & (F.col("d") == expected))
    last = runs.agg(F.max(run).alias(run)).where(F.col(run).isNotNull())
    return rows.join(F.broadcast(last), run, "left_semi")
