"""Queries of text functions, citations and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import citations, dates, text
from quern.operators import corpus, retrieval, validate
from quern.operators.intervals import current_rows
from quern.plans.data_queries import _CURRENT, _day
from quern.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows of norms, with the trimmed lower-case id as ``key``."""
    return current_rows(table(spark, sf_dir, "norm")).select("key", "arrival", "cur.*")


WORDS = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"


@query(f"SELECT doc_id, len(w)::int AS n_words, len(list_distinct(w))::int AS n_distinct FROM (SELECT doc_id, {WORDS.format(c='text')} AS w FROM documents)")
def word_counts(spark, sf_dir):
    w = text.word_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"))


_SLUG = "regexp_replace(regexp_replace(replace(strip_accents(lower({c})), 'đ', 'd'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT doc_id, {_SLUG.format(c='title')} AS slug FROM documents WHERE title IS NOT NULL")
def slug_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("title is not null").select("doc_id", text.slug(F.col("title")).alias("slug"))


@query(f"""SELECT id, gram, count(*) AS n FROM (
  SELECT id, unnest([list_aggregate(w[i:i+4], 'string_agg', ' ') FOR i IN range(1, greatest(len(w) - 3, 1))]) AS gram
  FROM (SELECT id, {WORDS.format(c='question')} AS w FROM eval_question)) GROUP BY ALL""")
def question_ngrams(spark, sf_dir):
    grams = table(spark, sf_dir, "eval_question").select("id", F.explode(text.ngrams(text.word_tokens(F.col("question")))).alias("gram"))
    return grams.groupBy("id", "gram").agg(F.count(F.lit(1)).alias("n"))


_CITE = r"'[Kk]ho[ảà]n\s+(\d+[\p{L}\p{N}_]*)\s+(?:c[ủù]a\s+)?[ĐDd]i[ềê]u\s+(\d+[\p{L}\p{N}_]*)'"


@query(rf"""WITH x AS (SELECT sample_id, regexp_extract_all(question, {_CITE}, 1) AS k, regexp_extract_all(question, {_CITE}, 2) AS d,
  regexp_extract_all(question, '[ĐDd]i[ềê]u\s+(\d+[\p{{L}}\p{{N}}_]*)', 1) AS a FROM train_sample WHERE question IS NOT NULL)
SELECT DISTINCT sample_id, unnest(d) AS dieu, unnest(k) AS khoan FROM x
UNION ALL SELECT sample_id, a1, NULL FROM (SELECT DISTINCT sample_id, d, unnest(a) AS a1 FROM x) WHERE NOT list_contains(d, a1)""")
def struct_cites(spark, sf_dir):
    return table(spark, sf_dir, "train_sample").select("sample_id", F.explode(citations.structured_cites(F.col("question"))).alias("c")).select("sample_id", "c.dieu", "c.khoan")


_STRIP = r"regexp_replace({c}, '^[\p{{Z}}\s]+|[\p{{Z}}\s]+$', '', 'g')"


def _field(word: str) -> str:
    return "nullif(" + _STRIP.format(c=rf"regexp_replace(list_filter(p, lambda x: regexp_matches(x, '(?i)^{word}'))[-1], '(?i)^{word}', '')") + ", '')"


@query(rf"""WITH b AS (SELECT result_id, unnest(regexp_extract_all(answer, '\[([^\[\]]+)\]', 1)) AS block FROM eval_result),
s AS (SELECT result_id, list_transform(string_split(block, ','), lambda x: {_STRIP.format(c='x')}) AS p FROM b),
h AS (SELECT *, list_filter(p, lambda x: regexp_matches(x, '(?i)^(Điều|Phụ\s*lục)'))[-1] AS head FROM s),
c AS (SELECT result_id, head, nullif({_STRIP.format(c="regexp_replace(head, '(?i)^(Điều|Phụ *lục)', '')")}, '') AS num,
  {_field('Khoản')} AS khoan, {_field('Điểm')} AS diem, {_field('Tiết')} AS tiet, {_field(r'Văn\s*bản')} AS van_ban FROM h)
SELECT DISTINCT result_id, CASE WHEN regexp_matches(head, '(?i)^Điều') THEN num ELSE coalesce(num, '_default') END AS dieu, khoan, diem, tiet, van_ban,
  CASE WHEN regexp_matches(head, '(?i)^Điều') THEN 'dieu' ELSE 'phu_luc' END AS loai
FROM c WHERE head IS NOT NULL AND van_ban IS NOT NULL AND (num IS NOT NULL OR NOT regexp_matches(head, '(?i)^Điều'))""")
def answer_citations(spark, sf_dir):
    return table(spark, sf_dir, "eval_result").select("result_id", F.explode(citations.parse_citations(F.col("answer"))).alias("c")).select("result_id", "c.*")


@query(f"""WITH {_CURRENT}, u AS (SELECT t.id, t.context_path AS p, c.tier, c.valid_from AS f, c.valid_to AS v FROM text_unit t JOIN cur c ON lower(trim(t.norm_id)) = c.key),
x AS (SELECT *, array_to_string(p[2:], ', ') AS place FROM u),
y AS (SELECT id, CASE WHEN length(place) > 0 THEN place || ' (' || p[1] || ')' ELSE p[1] END AS base,
  concat_ws(' | ', CASE WHEN tier IS NOT NULL THEN 'Tier ' || tier END, CASE WHEN length(f) > 0 THEN 'Hiệu lực: ' || f ||
    CASE WHEN v IS NOT NULL AND v <> '' AND v <> '9999-12-31' THEN ' → ' || v || ' (HẾT HIỆU LỰC)' ELSE '' END END) AS meta FROM x)
SELECT id, CASE WHEN length(meta) > 0 THEN '[' || meta || '] ' || base ELSE base END AS label FROM y""")
def unit_labels(spark, sf_dir):
    u = table(spark, sf_dir, "text_unit").select("id", "context_path", F.lower(F.trim("norm_id")).alias("key"))
    j = u.join(norms(spark, sf_dir).select("key", "tier", "valid_from", "valid_to"), "key")
    return j.select("id", citations.citation_label(F.col("context_path"), F.col("tier"), F.col("valid_from"), F.col("valid_to")).alias("label"))


@query("""WITH a AS (SELECT id, unnest(amendments) AS a FROM text_unit)
SELECT id, '[AMENDMENT WARNING — nội dung Component này đã/sắp bị sửa đổi:]' || chr(10) || string_agg('  - ' || coalesce(a.amending_norm, '?') || ' (' || coalesce(a.amending_loc, '?') || ', hiệu lực ' ||
  coalesce(a.effective_date, '?') || '): ' || trim(coalesce(a.content_summary, '')), chr(10)
  ORDER BY coalesce(a.effective_date, '0000-00-00'), a.amending_norm NULLS FIRST, a.amending_loc NULLS FIRST, trim(coalesce(a.content_summary, ''))) AS warning FROM a GROUP BY id""")
def amendment_warnings(spark, sf_dir):
    return table(spark, sf_dir, "text_unit").select("id", citations.amendments_warning(F.col("amendments")).alias("warning")).where("warning <> ''")


@query("""WITH a AS (SELECT lower(trim(a.content_summary)) AS t FROM (SELECT unnest(amendments) AS a FROM text_unit))
SELECT CASE WHEN starts_with(t, 'sửa đổi, bổ sung') THEN 'sua-doi-bo-sung' WHEN starts_with(t, 'thay cụm từ') THEN 'thay-cum-tu' WHEN starts_with(t, 'bổ sung') THEN 'bo-sung'
  WHEN starts_with(t, 'thay thế') THEN 'thay-the' WHEN starts_with(t, 'bãi bỏ') THEN 'bai-bo' WHEN starts_with(t, 'sửa đổi') THEN 'sua-doi' WHEN starts_with(t, 'thay') THEN 'thay-the'
  ELSE 'khac' END AS change_type, count(*) AS n FROM a GROUP BY ALL""")
def change_types(spark, sf_dir):
    a = table(spark, sf_dir, "text_unit").select(F.explode("amendments").alias("a"))
    return a.select(text.change_type(F.col("a.content_summary")).alias("change_type")).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH l AS (SELECT sample_id, unnest(x) AS label, generate_subscripts(x, 1) - 1 AS ord FROM (SELECT sample_id, regexp_extract_all(context, '(?m)^--- ([^\n]*)', 1) AS x FROM train_sample)),
t AS (SELECT sample_id, ord, regexp_replace(label, '\s*---\s*$', '') AS label FROM l)
SELECT sample_id, ord::int AS ord, label, nullif(regexp_extract(label, 'Tier (\d+)', 1), '') AS tier, nullif(regexp_extract(label, 'Hiệu lực: (\d{4}-\d{2}-\d{2})', 1), '') AS valid_from,
  nullif(regexp_extract(label, 'Điều\s+([\p{L}\p{N}]+)', 1), '') AS dieu, regexp_extract_all(label, 'Khoản\s+([\p{L}\p{N}]+)', 1)[-1] AS khoan, nullif(regexp_extract(label, '\(([a-z0-9-]+)\)\s*$', 1), '') AS norm_id FROM t""")
def context_labels(spark, sf_dir):
    b = table(spark, sf_dir, "train_sample").select("sample_id", F.posexplode(citations.context_blocks(F.col("context"))).alias("ord", "b"))
    p = b.select("sample_id", "ord", F.col("b.label").alias("label"), citations.parse_label(F.col("b.label")).alias("p"))
    return p.select("sample_id", "ord", "label", "p.tier", "p.valid_from", "p.dieu", "p.khoan", "p.norm_id")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 512) / 462.0))::int + 1)) AS i FROM t WHERE length(t) > 0),
c AS (SELECT doc_id, i, regexp_replace(substring(t, i * 462 + 1, 512), '^\s+|\s+$', '', 'g') AS c FROM s)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS chunk_idx, md5(c) AS chunk_md5 FROM c WHERE length(c) > 0""")
def fixed_chunks(spark, sf_dir):
    c = retrieval.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.select(F.col("item").alias("doc_id"), "chunk_idx", F.md5("chunk").alias("chunk_md5"))


@query("SELECT doc_id, greatest(1, floor(length(coalesce(text, '')) / 3.5)::int) AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


_NUM = "(^|[^\\p{L}\\p{N}_])(\\d{1,4})\\s*/\\s*(\\d{4})\\s*/\\s*([A-Za-zĐđ]{2,}\\d*(?:-[A-Za-zĐđ]+)*)"


def _kind_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({_SLUG.format(c=c)} || '-', '{k}-') THEN '{k}'" for _, k in text.DOCUMENT_KINDS) + " END"


_BARE = f"regexp_replace(title, '{_NUM}', '\\1 ', 'g')"
for _words in (*text.ISSUERS, ""):
    _BARE = f"regexp_replace({_BARE}, '{_words.replace(' ', chr(92) + 's+')}', ' ', 'gi')" if _words else f"regexp_replace(' ' || regexp_replace({_BARE}, '\\s+', '  ', 'g') || ' ', '([^\\p{{L}}\\p{{N}}_])số([^\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'gi')"
_BARE = f"regexp_replace(regexp_replace({_BARE}, '\\s+', ' ', 'g'), '^[ ,.-]+|[ ,.-]+$', '', 'g')"


@query(f"""WITH {_CURRENT}, a AS (SELECT key, title, {_BARE} AS bare, regexp_extract(title, '{_NUM}', 2) AS num, regexp_extract(title, '{_NUM}', 3) AS num_year,
  {_SLUG.format(c=f"regexp_extract(title, '{_NUM}', 4)")} AS sign FROM cur),
b AS (SELECT *, {_kind_sql('title')} AS kind, nullif(regexp_extract(bare, '^([^ ]+( [^ ]+)?) về .+$', 1, 'i'), '') AS before,
  coalesce(nullif(num_year, ''), nullif(regexp_extract(title, '(^|[^\\p{{L}}\\p{{N}}_])năm\\s+(\\d{{4}})([^\\p{{L}}\\p{{N}}_]|$)', 2, 'i'), '')) AS y FROM a),
c AS (SELECT *, {_kind_sql('coalesce(before, bare)')} AS own FROM b),
d AS (SELECT *, CASE WHEN before IS NULL THEN array_to_string(list_slice(string_split(bare, ' '), len(string_split(own, '-')) + 1, len(string_split(bare, ' '))), ' ') ELSE substr(bare, length(before) + 5) END AS rest FROM c),
e AS (SELECT *, array_to_string(list_slice(string_split({_SLUG.format(c='rest')}, '-'), 1, {text.NAME_WORDS}), '-') AS name FROM d)
SELECT key, kind, CASE WHEN num <> '' THEN num || '/' || num_year || '/' || sign END AS number, y::int AS year,
  CASE WHEN y IS NULL THEN NULL WHEN kind NOT IN ('luat', 'bo-luat') AND num <> '' THEN kind || '-' || num || '-' || num_year || '-' || sign
    WHEN own IS NOT NULL AND length(name) > 0 THEN own || '-' || name || '-' || y END AS slug FROM e""")
def document_names(spark, sf_dir):
    t = F.col("title")
    return norms(spark, sf_dir).select("key", text.document_kind(t).alias("kind"), text.document_number(t).alias("number"), text.document_year(t).alias("year"), text.document_slug(t).alias("slug"))


@query("""SELECT row_id, CASE WHEN regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}$') THEN t WHEN regexp_matches(t, '^\\d{4}-\\d{2}$') THEN t || '-15' WHEN regexp_matches(t, '^\\d{4}$') THEN t || '-12-31' END AS anchor
FROM (SELECT row_id, trim(valid_from) AS t FROM scored_text_unit)""")
def temporal_anchors(spark, sf_dir):
    return table(spark, sf_dir, "scored_text_unit").select("row_id", dates.temporal_anchor(F.col("valid_from")).alias("anchor"))


@query("""SELECT id, substr(sha256(array_to_string(context_path, '>')), 1, 16) AS path_id FROM text_unit""")
def path_ids(spark, sf_dir):
    return table(spark, sf_dir, "text_unit").select("id", text.path_id(F.col("context_path")).alias("path_id"))


@query(f"""WITH {_CURRENT}, n AS (SELECT id, title, tier, theme, jurisdiction, valid_from AS vf, valid_to AS vt, implements, file, {_day('valid_from')} AS f, {_day('valid_to')} AS t FROM norm),
m AS (SELECT id, list_filter([CASE WHEN length(trim(coalesce(id, ''))) = 0 THEN 'id missing' END, CASE WHEN NOT regexp_matches(id, '^[a-z0-9][a-z0-9-]*[a-z0-9]$') THEN 'id malformed' END,
  CASE WHEN length(trim(coalesce(title, ''))) = 0 THEN 'title missing' END, CASE WHEN tier IS NULL OR tier NOT BETWEEN 1 AND 4 THEN 'tier out of range' END, CASE WHEN theme IS NULL THEN 'theme missing' END,
  CASE WHEN jurisdiction IS NULL THEN 'jurisdiction missing' END, CASE WHEN length(trim(coalesce(vf, ''))) > 0 AND f IS NULL THEN 'valid_from unreadable' END,
  CASE WHEN length(trim(coalesce(vf, ''))) = 0 THEN 'valid_from missing' END, CASE WHEN length(trim(coalesce(vt, ''))) > 0 AND t IS NULL THEN 'valid_to unreadable' END, CASE WHEN f > t THEN 'validity reversed' END,
  CASE WHEN len(list_filter(coalesce(implements, []), lambda x: length(trim(coalesce(x, ''))) = 0)) > 0 THEN 'implements has a blank' END, CASE WHEN file IS NOT NULL AND file <> id || '.md' THEN 'file differs from id' END],
  lambda x: x IS NOT NULL) AS p FROM n)
SELECT id, array_to_string(p, '; ') AS problems FROM m WHERE len(p) > 0""")
def lint_norms(spark, sf_dir):
    return validate.lint_norms(table(spark, sf_dir, "norm"))


@query("""WITH m AS (SELECT id, list_filter([CASE WHEN length(trim(coalesce(question, ''))) = 0 THEN 'question missing' END, CASE WHEN theme IS NULL AND gap_type <> 'negative' THEN 'theme missing' END,
  CASE WHEN gap_type IS NULL OR gap_type NOT IN ('gap1', 'gap2', 'gap3', 'gap4', 'negative') THEN 'gap_type unknown' END, CASE WHEN gap_type = 'negative' AND len(coalesce(ground_truth_citations, [])) > 0 THEN 'negative with citations' END,
  CASE WHEN gap_type <> 'negative' AND len(coalesce(ground_truth_citations, [])) = 0 THEN 'no citations' END, CASE WHEN length(trim(coalesce(ground_truth_answer, ''))) = 0 THEN 'answer missing' END], lambda x: x IS NOT NULL) AS p FROM eval_question)
SELECT DISTINCT id, array_to_string(p, '; ') AS problems FROM m WHERE len(p) > 0""")
def lint_questions(spark, sf_dir):
    return validate.lint_questions(table(spark, sf_dir, "eval_question"))


@query("SELECT lower(trim(id)) AS key, count(*) AS n FROM norm WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return validate.duplicate_keys(table(spark, sf_dir, "norm").select(F.lower(F.trim("id")).alias("id")), "id")


@query("SELECT text_unit_id AS key, count(*) AS n FROM scored_text_unit WHERE text_unit_id IS NOT NULL AND text_unit_id NOT IN (SELECT id FROM text_unit WHERE id IS NOT NULL) GROUP BY 1")
def unit_orphans(spark, sf_dir):
    return validate.orphans(table(spark, sf_dir, "scored_text_unit"), "text_unit_id", table(spark, sf_dir, "text_unit"), "id")


@query("""WITH q AS (SELECT DISTINCT pair_id, id, list_sort([concat_ws('|', c.van_ban, c.dieu, c.khoan) FOR c IN ground_truth_citations]) AS gt FROM eval_question WHERE pair_id IS NOT NULL)
SELECT pair_id, count(DISTINCT id) AS n_ids, count(DISTINCT gt) = 1 AS same FROM q GROUP BY 1 HAVING count(DISTINCT id) <> 2 OR count(DISTINCT gt) <> 1""")
def question_pairs(spark, sf_dir):
    return validate.register_pairs(table(spark, sf_dir, "eval_question"))


@query("SELECT theme, jurisdiction, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM eval_question GROUP BY ALL")
def question_distribution(spark, sf_dir):
    return validate.distribution(table(spark, sf_dir, "eval_question"), "theme", "jurisdiction")


@query("""SELECT result_id FROM eval_result WHERE isnan(faithfulness.existence_rate) OR isnan(faithfulness.support_rate) OR isnan(faithfulness.faithful_rate) OR isinf(faithfulness.existence_rate) OR isinf(faithfulness.support_rate) OR isinf(faithfulness.faithful_rate)""")
def non_finite_rates(spark, sf_dir):
    f = [F.col(f"faithfulness.{n}") for n in ("existence_rate", "support_rate", "faithful_rate")]
    return table(spark, sf_dir, "eval_result").where(validate.not_finite(*f)).select("result_id")


_LEAVES = r"""leaves AS (SELECT DISTINCT lower(trim(norm_id)) AS norm, regexp_extract(context_path[2], '^Điều (\w+)', 1) AS dieu, nullif(regexp_extract(context_path[3], '^Khoản (\w+)', 1), '') AS khoan FROM text_unit WHERE regexp_matches(context_path[2], '^Điều \w+'))"""


@query(f"""WITH {_LEAVES}, c AS (SELECT result_id, unnest(pred_citations) AS c FROM eval_result),
k AS (SELECT DISTINCT result_id || '|' || concat_ws('|', lower(trim(c.van_ban)), c.dieu, c.khoan) AS cite_id, lower(trim(c.van_ban)) AS norm, c.dieu AS dieu, c.khoan AS khoan FROM c WHERE c.van_ban IS NOT NULL)
SELECT cite_id, 'van_ban' AS level FROM k WHERE norm NOT IN (SELECT norm FROM leaves)
UNION ALL SELECT cite_id, 'dieu' FROM k WHERE norm IN (SELECT norm FROM leaves) AND dieu IS NOT NULL AND NOT EXISTS (FROM leaves l WHERE l.norm = k.norm AND l.dieu = k.dieu)
UNION ALL SELECT cite_id, 'khoan' FROM k WHERE khoan IS NOT NULL AND EXISTS (FROM leaves l WHERE l.norm = k.norm AND l.dieu = k.dieu) AND NOT EXISTS (FROM leaves l WHERE l.norm = k.norm AND l.dieu = k.dieu AND l.khoan = k.khoan)""")
def unresolved_citations(spark, sf_dir):
    u = table(spark, sf_dir, "text_unit")
    head, clause = F.get("context_path", F.lit(1)), F.get("context_path", F.lit(2))
    leaves = u.where(head.rlike(r"^Điều \w+")).select(
        F.lower(F.trim("norm_id")).alias("norm"), F.regexp_extract(head, r"^Điều (\w+)", 1).alias("dieu"), F.nullif(F.regexp_extract(clause, r"^Khoản (\w+)", 1), F.lit("")).alias("khoan")
    )
    c = table(spark, sf_dir, "eval_result").select("result_id", F.explode("pred_citations").alias("c")).where("c.van_ban is not null")
    norm = F.lower(F.trim("c.van_ban"))
    cites = c.select(F.concat_ws("|", F.col("result_id").cast("string"), norm, "c.dieu", "c.khoan").alias("cite_id"), norm.alias("norm"), "c.dieu", "c.khoan").distinct()
    return validate.unresolved(cites, leaves.distinct())


def _last(rx: str) -> str:
    return f"list_filter(list_transform(context_path[2:], lambda x: regexp_extract(x, '{rx}', 1)), lambda x: x <> '')[-1]"


def label_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower(nfc_normalize({c})), '\s+', ' ', 'g'))"


#: Where a leaf stands, in SQL; columns dieu, khoan, diem and pl.
PLACE_SQL = ", ".join(rf"{_last(rf'^{h}\s+([\p{{L}}\p{{N}}_]+)')} AS {n}" for h, n in (("Điều", "dieu"), ("Khoản", "khoan"), ("Điểm", "diem"))) + rf", {label_sql(_last(r'^(Phụ lục[\s\S]*)'))} AS pl"
APPENDIX_SQL = "(coalesce(loai, '') = 'phu_luc' OR starts_with(lower(coalesce(dieu, '')), 'phụ lục'))"
TARGET_SQL = label_sql("CASE WHEN starts_with(lower(dieu), 'phụ lục') THEN dieu ELSE 'phụ lục ' || dieu END")


@query(f"""WITH l AS (SELECT DISTINCT lower(trim(norm_id)) AS norm, {PLACE_SQL} FROM text_unit), c AS (SELECT result_id, unnest(pred_citations) AS c FROM eval_result),
k0 AS (SELECT DISTINCT result_id, lower(trim(c.van_ban)) AS norm, c.loai AS loai, trim(c.dieu) AS dieu, trim(c.khoan) AS khoan, trim(c.diem) AS diem FROM c),
k AS (SELECT *, result_id || '|' || coalesce(norm, '') || '|' || coalesce(loai, '') || '|' || coalesce(dieu, '') || '|' || coalesce(khoan, '') || '|' || coalesce(diem, '') AS cite_id, {APPENDIX_SQL} AS app, {TARGET_SQL} AS target FROM k0),
m AS (SELECT k.cite_id, k.app, k.dieu, k.khoan, k.diem, bool_or(l.norm IS NOT NULL) AS n, coalesce(bool_or(l.dieu = k.dieu), false) AS a, coalesce(bool_or(l.dieu = k.dieu AND l.khoan = k.khoan), false) AS b, coalesce(bool_or(l.dieu = k.dieu AND l.khoan = k.khoan AND l.diem = k.diem), false) AS p,
coalesce(bool_or(l.pl IS NOT NULL AND (k.dieu = '_default' OR starts_with(l.pl, k.target) OR starts_with(k.target, l.pl))), false) AS f,
coalesce(bool_or(l.pl IS NOT NULL AND (k.dieu = '_default' OR starts_with(l.pl, k.target) OR starts_with(k.target, l.pl)) AND l.khoan = k.khoan), false) AS fk FROM k LEFT JOIN l ON k.norm = l.norm GROUP BY ALL),
v AS (SELECT cite_id, CASE WHEN NOT n THEN 'van_ban' WHEN coalesce(dieu, '') = '' THEN 'dieu_missing' WHEN app AND NOT f THEN 'phu_luc' WHEN app AND khoan IS NOT NULL AND NOT fk THEN 'phu_luc_khoan' WHEN app THEN NULL
WHEN NOT a THEN 'dieu' WHEN khoan IS NOT NULL AND NOT b THEN 'khoan' WHEN khoan IS NOT NULL AND diem IS NOT NULL AND NOT p THEN 'diem' END AS level FROM m)
SELECT cite_id, level FROM v WHERE level IS NOT NULL""")
def unresolved_levels(spark, sf_dir):
    """Citations that don't resolve at any of the levels, points and appendices too."""
    u = table(spark, sf_dir, "text_unit").select(F.lower(F.trim("norm_id")).alias("norm"), validate.leaf_place(F.col("context_path")).alias("p")).select("norm", "p.*").distinct()
    c = table(spark, sf_dir, "eval_result").select("result_id", F.explode("pred_citations").alias("c"))
    c = c.select("result_id", F.lower(F.trim("c.van_ban")).alias("norm"), "c.loai", *[F.trim(f"c.{x}").alias(x) for x in ("dieu", "khoan", "diem")]).distinct()
    parts = [F.coalesce(F.col(x), F.lit("")) for x in ("norm", "loai", "dieu", "khoan", "diem")]
    return validate.unresolved_levels(c.withColumn("cite_id", F.concat_ws("|", F.col("result_id").cast("string"), *parts)), u)


def _grams(t: str, key: str, c: str) -> str:
    return f"SELECT DISTINCT {key}, unnest([list_aggregate(w[i:i+4], 'string_agg', ' ') FOR i IN range(1, greatest(len(w) - 3, 1))]) AS g FROM (SELECT {key}, {WORDS.format(c=c)} AS w FROM {t})"


@query(f"SELECT sample_id AS item, count(*) AS n_shared FROM ({_grams('train_sample', 'sample_id', 'question')}) WHERE g IN (SELECT g FROM ({_grams('eval_question', 'id', 'question')})) GROUP BY 1")
def ngram_leakage(spark, sf_dir):
    q = table(spark, sf_dir, "eval_question").select(F.col("question").alias("text"))
    return corpus.shared_ngrams(table(spark, sf_dir, "train_sample").select(F.col("sample_id").alias("item"), F.col("question").alias("text")), q)


@query(f"""WITH a AS (SELECT sample_id AS item, list_distinct({WORDS.format(c='question')}) AS w FROM train_sample),
b AS (SELECT DISTINCT id AS q, list_distinct({WORDS.format(c='question')}) AS w FROM eval_question),
p AS (SELECT x.item, y.q, count(*) AS m FROM (SELECT item, unnest(w) AS t FROM a) x JOIN (SELECT q, unnest(w) AS t FROM b) y USING (t) GROUP BY ALL)
SELECT p.item, p.q, p.m / (len(a.w) + len(b.w) - p.m) AS jaccard FROM p JOIN a USING (item) JOIN b USING (q) WHERE p.m / (len(a.w) + len(b.w) - p.m) >= 0.6""")
def jaccard_leakage(spark, sf_dir):
    q = table(spark, sf_dir, "eval_question").select(F.col("id").alias("q"), F.col("question").alias("text"))
    return corpus.similar_questions(table(spark, sf_dir, "train_sample").select(F.col("sample_id").alias("item"), F.col("question").alias("text")), q)


@query(f"""WITH h AS (SELECT DISTINCT so_hieu AS held_out, array_to_string({WORDS.format(c='so_hieu')}, ' ') AS k FROM norm WHERE so_hieu IS NOT NULL),
d AS (SELECT DISTINCT title AS name, array_to_string({WORDS.format(c='title')}, ' ') AS k FROM norm WHERE title IS NOT NULL)
SELECT d.name, h.held_out FROM d JOIN h ON contains(' ' || d.k || ' ', ' ' || h.k || ' ') WHERE h.k <> ''""")
def name_leakage(spark, sf_dir):
    n = table(spark, sf_dir, "norm")
    held = n.where("so_hieu is not null").select(F.col("so_hieu").alias("name"))
    return corpus.leaking_names(n.where("title is not null").select(F.col("title").alias("name")).distinct(), held)


@query(f"""WITH s AS (SELECT DISTINCT title AS name, {_SLUG.format(c='title')} AS base FROM documents WHERE title IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY name) AS n FROM s) SELECT name, CASE WHEN n > 1 THEN base || '-b' || n ELSE base END AS slug FROM r""")
def unique_slugs(spark, sf_dir):
    return corpus.unique_slugs(table(spark, sf_dir, "documents").select(F.col("title").alias("name")))


@query(r"""SELECT arg_min(question, sample_id) AS question, min(sample_id) AS sample_id FROM train_sample WHERE question IS NOT NULL GROUP BY trim(regexp_replace(lower(question), '[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+', ' ', 'g'))""")
def distinct_questions(spark, sf_dir):
    return corpus.distinct_questions(table(spark, sf_dir, "train_sample"))


@query("""WITH t AS (SELECT sample_id, unnest(['system', 'user', 'assistant']) AS role, unnest(['Trả lời theo văn bản.', concat_ws(chr(10) || chr(10), context, 'Câu hỏi: ' || question), answer]) AS content
  FROM train_sample WHERE answer IS NOT NULL AND question IS NOT NULL) SELECT sample_id, role, md5(content) AS content_md5 FROM t""")
def chat_records(spark, sf_dir):
    m = corpus.chat_records(table(spark, sf_dir, "train_sample"), "Trả lời theo văn bản.").select("sample_id", F.explode("messages").alias("m"))
    return m.select("sample_id", "m.role", F.md5("m.content").alias("content_md5"))


@query("""SELECT cand_id, contains(lower(snippet), lower(term)) AS grounded FROM candidate WHERE term IS NOT NULL AND snippet IS NOT NULL""")
def grounded_terms(spark, sf_dir):
    return table(spark, sf_dir, "candidate").where("term is not null and snippet is not null").select("cand_id", F.contains(F.lower("snippet"), F.lower("term")).alias("grounded"))


@query("""SELECT r.result_id, coalesce(avg(contains(lower(snippet), lower(term))::int), 1.0) AS grounding_rate, count(c.cand_id) AS n_terms
FROM eval_result r LEFT JOIN (FROM candidate WHERE term IS NOT NULL AND snippet IS NOT NULL) c USING (result_id) GROUP BY 1""")
def grounding_rate(spark, sf_dir):
    g = grounded_terms_by(table(spark, sf_dir, "candidate"))
    return table(spark, sf_dir, "eval_result").select("result_id").join(g, "result_id", "left").select("result_id", F.coalesce("rate", F.lit(1.0)).alias("grounding_rate"), F.coalesce("n", F.lit(0)).alias("n_terms"))


def grounded_terms_by(candidate: DataFrame) -> DataFrame:
    """Share of grounded terms per result: ``result_id, rate, n``."""
    c = candidate.where("term is not null and snippet is not null")
    return c.groupBy("result_id").agg(F.avg(F.contains(F.lower("snippet"), F.lower("term")).cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"))
