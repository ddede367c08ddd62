"""Queries of mentions, coverage, gold contexts and the evaluation of stored answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import citations, mentions
from quern.operators import metrics, validate
from quern.plans.data_queries import _CURRENT
from quern.plans.text_queries import ORACLE as TEXT_ORACLE
from quern.plans.text_queries import APPENDIX_SQL, PLACE_SQL, TARGET_SQL, norms
from quern.session import spread
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


def _soft(c: str) -> str:
    return (
        rf"list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '(?i)Điều\s+(\d+[a-z]?)', 1), lambda x: lower(x)))",
        rf"list_distinct(regexp_extract_all(coalesce({c}, ''), '(?i)Khoản\s+(\d+)', 1))",
        rf"list_distinct(list_filter(regexp_extract_all(coalesce({c}, ''), '[a-z0-9-]+'), lambda x: length(x) >= 15))",
    )


_A, _C = _soft("answer"), _soft("context")


@query(f"""WITH x AS (SELECT sample_id, {_A[0]} AS ad, {_A[1]} AS ak, {_A[2]} AS sl, {_C[0]} AS cd, {_C[1]} AS ck, coalesce(context, '') AS ctx FROM train_sample),
y AS (SELECT sample_id, len(ad) + len(ak) + len(sl) AS n, len(list_intersect(ad, cd)) + len(list_intersect(ak, ck)) + len(list_filter(sl, lambda s: contains(ctx, s))) AS hits FROM x)
SELECT sample_id, n, hits, CASE WHEN n > 0 THEN hits / n END AS rate FROM y""")
def soft_mentions(spark, sf_dir):
    t = spread(table(spark, sf_dir, "train_sample").select("sample_id", "answer", "context"))
    return t.select("sample_id", mentions.mention_hits(F.col("answer"), F.col("context")).alias("m")).select("sample_id", "m.n", "m.hits", "m.rate")


_SEG = r"regexp_replace(x, '^(Điều|Khoản|Điểm|Tiết|Phụ lục) ([^\s.]+)(?:[.\s].*)?$', '\1 \2')"


@query(f"""SELECT id, CASE WHEN length(p) > 0 THEN p || ' (' || context_path[1] || ')' ELSE context_path[1] END AS label
FROM (SELECT id, context_path, array_to_string([{_SEG} FOR x IN context_path[2:]], ', ') AS p FROM text_unit)""")
def short_labels(spark, sf_dir):
    return table(spark, sf_dir, "text_unit").select("id", mentions.short_label(F.col("context_path")).alias("label"))


_HEADS = " + ".join(rf"regexp_matches(coalesce(answer, ''), '(?im)^#{{2,4}}\s*{h}\s*$')::int" for h in mentions.CASE_HEADINGS)


@query(f"SELECT n_headings, count(*) AS n FROM (SELECT {_HEADS} AS n_headings FROM eval_result) GROUP BY 1")
def heading_histogram(spark, sf_dir):
    return table(spark, sf_dir, "eval_result").groupBy(mentions.case_headings(F.col("answer")).alias("n_headings")).agg(F.count(F.lit(1)).alias("n"))


@query()
def term_candidates(spark, sf_dir):
    r = spread(table(spark, sf_dir, "eval_result").select("result_id", "answer"))
    return r.select("result_id", F.explode(mentions.term_candidates(F.col("answer"))).alias("t")).select("result_id", "t.*")


@query(r"""WITH l AS (SELECT doc_id AS key, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
m AS (SELECT key, pos, trim(raw, ' ') AS line FROM l WHERE length(trim(raw, ' ')) > 0), n AS (SELECT *, nullif(regexp_extract(line, '^(\d+)\. ', 1), '') AS number, nullif(regexp_extract(line, '^([a-zđ])\) ', 1), '') AS point FROM m),
f AS (SELECT *, last_value(CASE WHEN number IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS at_pos FROM n)
SELECT key, max(number) AS clause, coalesce(string_agg(DISTINCT point, ',' ORDER BY point), '') AS points, md5(string_agg(regexp_replace(line, '^\d+\. ', ''), chr(10) ORDER BY pos)) AS body_md5 FROM f GROUP BY key, at_pos""")
def article_clauses(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return mentions.clauses(d, "doc_id", "text").select("key", "clause", "points", F.md5("body").alias("body_md5"))


@query(r"""WITH g AS (SELECT id AS q, c.van_ban AS v, c.dieu AS d, c.khoan AS k FROM (SELECT DISTINCT id, unnest(ground_truth_citations) AS c FROM eval_question)),
u AS (SELECT id, lower(trim(norm_id)) AS v, regexp_extract(context_path[2], '^Điều (\w+)', 1) AS d, nullif(regexp_extract(context_path[3], '^Khoản (\w+)', 1), '') AS k, text FROM text_unit WHERE text IS NOT NULL),
j AS (SELECT DISTINCT g.q, u.id, u.text FROM g JOIN u ON lower(trim(g.v)) = u.v AND g.d = u.d AND (g.k IS NULL OR g.k = u.k))
SELECT q, count(*) AS n_units, md5(substr(string_agg(text, chr(10) || chr(10) ORDER BY id), 1, 2200)) AS context_md5 FROM j GROUP BY 1""")
def gold_contexts(spark, sf_dir):
    """The text of what a question's ground truth cites, as an oracle's context."""
    g = table(spark, sf_dir, "eval_question").select(F.col("id").alias("q"), F.explode("ground_truth_citations").alias("c")).distinct()
    g = g.select("q", F.lower(F.trim("c.van_ban")).alias("v"), F.col("c.dieu").alias("d"), F.col("c.khoan").alias("gk"))
    clause = F.nullif(F.regexp_extract(F.get("context_path", F.lit(2)), r"^Khoản (\w+)", 1), F.lit(""))
    u = table(spark, sf_dir, "text_unit").where("text is not null").select("id", F.lower(F.trim("norm_id")).alias("v"), F.regexp_extract(F.get("context_path", F.lit(1)), r"^Điều (\w+)", 1).alias("d"), clause.alias("k"), "text")
    j = g.join(u, ["v", "d"]).where("gk is null or gk = k").select("q", "id", "text").distinct()
    lists = j.groupBy("q").agg(F.count(F.lit(1)).alias("n_units"), F.sort_array(F.collect_list(F.struct("id", "text"))).alias("l"))
    return lists.select("q", "n_units", F.md5(F.substring(F.array_join(F.transform("l", lambda x: x["text"]), "\n\n"), 1, 2200)).alias("context_md5"))


@query(f"""WITH g AS (SELECT DISTINCT id AS q, lower(trim(c.van_ban)) AS v, c.loai AS loai, trim(c.dieu) AS dieu, trim(c.khoan) AS khoan, trim(c.diem) AS diem FROM (SELECT id, unnest(ground_truth_citations) AS c FROM eval_question)),
h AS (SELECT *, {APPENDIX_SQL} AS app, {TARGET_SQL} AS target FROM g), u AS (SELECT id, lower(trim(norm_id)) AS v, {PLACE_SQL}, text FROM text_unit WHERE text IS NOT NULL),
j AS (SELECT DISTINCT h.q, u.id, u.text FROM h JOIN u ON h.v = u.v AND (h.khoan IS NULL OR h.khoan = u.khoan) AND CASE WHEN h.app THEN u.pl IS NOT NULL AND (h.dieu = '_default' OR starts_with(u.pl, h.target) OR starts_with(h.target, u.pl))
ELSE h.dieu = u.dieu AND (h.diem IS NULL OR h.diem = u.diem) END)
SELECT q, count(*) AS n_units, md5(substr(string_agg(text, chr(10) || chr(10) ORDER BY id, text), 1, 2200)) AS context_md5 FROM j GROUP BY 1""")
def cited_contexts(spark, sf_dir):
    """The text of what a question's ground truth cites, down to points and in appendices too."""
    return gold_texts(table(spark, sf_dir, "eval_question"), table(spark, sf_dir, "text_unit"))


def gold_texts(questions: DataFrame, units: DataFrame) -> DataFrame:
    """Texts of the leaves a question's ground truth names, put together: ``q, n_units, context_md5``.

    Articles match by their number, appendices where one label begins with the other or '_default' takes any; clause and
    point where they are named. The first 2200 characters count.
    """
    g = questions.select(F.col("id").alias("q"), F.explode("ground_truth_citations").alias("c"))
    g = g.select("q", F.lower(F.trim("c.van_ban")).alias("v"), "c.loai", *[F.trim(f"c.{x}").alias(f"g_{x}") for x in ("dieu", "khoan", "diem")]).distinct()
    u = units.where("text is not null").select("id", F.lower(F.trim("norm_id")).alias("v"), validate.leaf_place(F.col("context_path")).alias("p"), "text").select("id", "v", "p.*", "text")
    appendix, clause = validate.is_appendix(F.col("loai"), F.col("g_dieu")), F.expr("g_khoan is null or g_khoan = khoan")
    articles = g.where(~appendix).withColumn("dieu", F.col("g_dieu")).join(u, ["v", "dieu"]).where(clause & F.expr("g_diem is null or g_diem = diem"))
    labelled = u.where("pl is not null").withColumn("pl", validate.appendix_label("pl"))
    others = g.where(appendix).withColumn("target", validate.appendix_target(F.col("g_dieu"))).join(labelled, "v").where(clause & validate.labels_match(F.col("pl"), F.col("target"), F.col("g_dieu")))
    j = articles.select("q", "id", "text").unionByName(others.select("q", "id", "text")).distinct()
    lists = j.groupBy("q").agg(F.count(F.lit(1)).alias("n_units"), F.sort_array(F.collect_list(F.struct("id", "text"))).alias("l"))
    return lists.select("q", "n_units", F.md5(F.substring(F.array_join(F.transform("l", lambda x: x["text"]), "\n\n"), 1, 2200)).alias("context_md5"))


_GT = """gt AS (SELECT DISTINCT id AS q, lower(trim(c.van_ban)) AS v FROM (SELECT id, unnest(ground_truth_citations) AS c FROM eval_question) WHERE length(trim(c.van_ban)) > 0),
got AS (SELECT DISTINCT question_id AS q, lower(trim(norm_id)) AS v FROM scored_text_unit WHERE question_id IS NOT NULL AND norm_id IS NOT NULL)"""


def _truth(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    g = table(spark, sf_dir, "eval_question").select(F.col("id").alias("q"), F.explode("ground_truth_citations").alias("c")).select("q", F.lower(F.trim("c.van_ban")).alias("v")).where("length(v) > 0").distinct()
    s = table(spark, sf_dir, "scored_text_unit").where("question_id is not null and norm_id is not null").select(F.col("question_id").alias("q"), F.lower(F.trim("norm_id")).alias("v")).distinct()
    return g, s


@query(f"WITH {_GT} SELECT q, v AS van_ban FROM gt EXCEPT FROM got")
def coverage_gaps(spark, sf_dir):
    g, s = _truth(spark, sf_dir)
    return g.join(s, ["q", "v"], "left_anti").withColumnRenamed("v", "van_ban")


@query(f"""WITH {_GT}, cited AS (SELECT DISTINCT id AS q, lower(trim(c.van_ban)) AS v FROM (SELECT id, unnest(pred_citations) AS c FROM eval_result)),
j AS (SELECT gt.q, (EXISTS (FROM got WHERE got.q = gt.q AND got.v = gt.v))::int AS present, (EXISTS (FROM cited WHERE cited.q = gt.q AND cited.v = gt.v))::int AS cited FROM gt)
SELECT count(*) AS n_truths, round(avg(present), 9) AS present_share, round(avg(cited), 9) AS cited_share FROM j""")
def retrieval_ceiling(spark, sf_dir):
    g, s = _truth(spark, sf_dir)
    c = table(spark, sf_dir, "eval_result").select(F.col("id").alias("q"), F.explode("pred_citations").alias("c")).select("q", F.lower(F.trim("c.van_ban")).alias("v")).distinct()
    j = g.join(s.withColumn("present", F.lit(1)), ["q", "v"], "left").join(c.withColumn("cited", F.lit(1)), ["q", "v"], "left").na.fill(0, ["present", "cited"])
    return j.agg(F.count(F.lit(1)).alias("n_truths"), F.round(F.avg("present"), 9).alias("present_share"), F.round(F.avg("cited"), 9).alias("cited_share"))


@query("""WITH m AS (SELECT system, gap_type, avg(elapsed_seconds) AS m FROM eval_result WHERE NOT isnan(elapsed_seconds) GROUP BY ALL) SELECT system, round(avg(m), 6) AS mean_of_means, count(*) AS n_groups FROM m GROUP BY 1""")
def mean_of_means(spark, sf_dir):
    m = table(spark, sf_dir, "eval_result").where("elapsed_seconds is not null and not isnan(elapsed_seconds)").groupBy("system", "gap_type").agg(F.avg("elapsed_seconds").alias("m"))
    return m.groupBy("system").agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.count(F.lit(1)).alias("n_groups"))


@query(f"WITH {_CURRENT} SELECT key AS id, tier, theme, jurisdiction, md5(summary) AS summary_md5, 'summary' AS content_type FROM cur WHERE summary IS NOT NULL")
def summaries(spark, sf_dir):
    n = norms(spark, sf_dir).where("summary is not null")
    return n.select(F.col("key").alias("id"), "tier", "theme", "jurisdiction", F.md5("summary").alias("summary_md5"), F.lit("summary").alias("content_type"))


@query("SELECT id, norm_id FROM text_unit WHERE starts_with(norm_id, 'luat-') ORDER BY id LIMIT 200")
def scroll_page(spark, sf_dir):
    """One page of a scroll; the page size is the feature."""
    return table(spark, sf_dir, "text_unit").where(F.col("norm_id").startswith("luat-")).select("id", "norm_id").orderBy("id").limit(200)


@query("""SELECT lower(trim(norm_id)) AS norm, context_path[2] AS heading, count(*) AS n_leaves, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY id)) AS text_md5 FROM text_unit GROUP BY ALL""")
def subtrees(spark, sf_dir):
    """Whole articles: the leaves under a heading, put together. An article's leaves are few, whatever the corpus holds."""
    u = table(spark, sf_dir, "text_unit").groupBy(F.lower(F.trim("norm_id")).alias("norm"), F.get("context_path", F.lit(1)).alias("heading"))
    l = u.agg(F.count(F.lit(1)).alias("n_leaves"), F.sort_array(F.collect_list(F.struct("id", F.coalesce("text", F.lit("")).alias("t")))).alias("l"))
    return l.select("norm", "heading", "n_leaves", F.md5(F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("text_md5"))


@query(f"""WITH parsed AS ({TEXT_ORACLE['answer_citations']}),
p AS (SELECT DISTINCT result_id, lower(regexp_replace(van_ban, '^[\\p{{Z}}\\s]+|[\\p{{Z}}\\s]+$', '', 'g')) AS v FROM parsed),
g AS (SELECT id, list_distinct(list_filter([lower(trim(c.van_ban)) FOR c IN any_value(ground_truth_citations)], lambda v: v <> '')) AS g FROM eval_question GROUP BY id),
r AS (SELECT r.result_id, r.gap_type, g.g FROM eval_result r JOIN g USING (id)), c AS (SELECT result_id, list(v) AS p FROM p GROUP BY 1),
s AS (SELECT gap_type, CASE WHEN len(g) > 0 THEN len(list_intersect(g, coalesce(p, []))) / len(g) WHEN len(coalesce(p, [])) = 0 THEN 1.0 ELSE 0.0 END AS recall FROM r LEFT JOIN c USING (result_id))
SELECT gap_type, count(*) AS n, round(avg(recall), 6) AS mean_norm_recall FROM s GROUP BY 1""")
def evaluation_rerun(spark, sf_dir):
    """Stored answers parsed again and scored against the current ground truth."""
    q = table(spark, sf_dir, "eval_question").groupBy("id").agg(F.any_value("ground_truth_citations").alias("gt"))
    r = spread(table(spark, sf_dir, "eval_result").select("id", "gap_type", "answer")).join(q, "id")
    s = r.select("gap_type", metrics.norm_recall(citations.parse_citations(F.col("answer")), F.col("gt")).alias("recall"))
    return s.groupBy("gap_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("mean_norm_recall"))


@query("""WITH r AS (SELECT id, system, result_id, row_number() OVER (PARTITION BY id, system ORDER BY run_ts DESC NULLS LAST, result_id DESC) AS rn FROM eval_result WHERE id IS NOT NULL) SELECT id, system, result_id FROM r WHERE rn = 1""")
def latest_results(spark, sf_dir):
    w = Window.partitionBy("id", "system").orderBy(F.desc_nulls_last("run_ts"), F.desc("result_id"))
    return table(spark, sf_dir, "eval_result").where("id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "system", "result_id")
