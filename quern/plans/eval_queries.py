"""Queries of scores, statistics, set operations and event streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import metrics, stats
from quern.session import spread
from quern.streaming import traces
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


def _r(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "eval_result")


def _same(field: str) -> str:
    return f"nullif(lower(trim(p[i + 1].{field})), '') IS NOT DISTINCT FROM nullif(lower(trim(g[j].{field})), '')"


def _fold(level: str, name: str) -> str:
    """SQL of the greedy matching: prediction by prediction, each with the first free ground truth it meets; a null field of that meets all."""
    fields = {"van_ban": ["van_ban"], "dieu": ["van_ban", "dieu"]}.get(level, ["van_ban", "dieu"])
    deeper = {"khoan": ["khoan"], "diem": ["khoan", "diem"]}.get(level, [])
    meets = " AND ".join([*map(_same, fields), *(f"(nullif(trim(g[j].{f}), '') IS NULL OR {_same(f)})" for f in deeper)])
    return f"""{name}(result_id, i, used, hit) AS (SELECT result_id, 0, []::bigint[], []::boolean[] FROM x UNION ALL
SELECT result_id, i + 1, CASE WHEN spot IS NULL THEN used ELSE list_append(used, spot) END, list_append(hit, spot IS NOT NULL) FROM (
  SELECT result_id, i, used, hit, list_filter(range(1, len(g) + 1), lambda j: NOT list_contains(used, j) AND {meets})[1] AS spot FROM {name} JOIN x USING (result_id) WHERE i < len(p)))"""


_X = "x AS (SELECT result_id, gap_type, coalesce(pred_citations, []) AS p, coalesce(ground_truth_citations, []) AS g FROM eval_result{where})"


def _score_columns(level: str) -> str:
    prec, rec = f"CASE WHEN len(p) > 0 THEN m_{level} / len(p) WHEN len(g) = 0 THEN 1.0::double ELSE 0.0::double END", f"CASE WHEN len(g) > 0 THEN m_{level} / len(g) ELSE 1.0::double END"
    return f"{prec} AS {level}_precision, {rec} AS {level}_recall, CASE WHEN ({prec}) + ({rec}) > 0 THEN 2 * ({prec}) * ({rec}) / (({prec}) + ({rec})) ELSE 0.0::double END AS {level}_f1, m_{level} AS {level}_match_count"


_LEVEL_COUNTS = ", ".join(f"c_{lv} AS (SELECT result_id, len(used)::int AS m_{lv} FROM f_{lv} JOIN x USING (result_id) WHERE i = len(p))" for lv in metrics.LEVELS)


@query(f"""WITH RECURSIVE {_X.format(where='')}, {', '.join(_fold(lv, f'f_{lv}') for lv in metrics.LEVELS)}, {_LEVEL_COUNTS}
SELECT result_id, {', '.join(map(_score_columns, metrics.LEVELS))} FROM x {' '.join(f'JOIN c_{lv} USING (result_id)' for lv in metrics.LEVELS)}""")
def citation_scores(spark, sf_dir):
    p, g = F.col("pred_citations"), F.col("ground_truth_citations")
    levels = [metrics.citation_score(p, g, lv).alias(lv) for lv in metrics.LEVELS]
    return spread(_r(spark, sf_dir).select("result_id", p, g)).select("result_id", *levels).select("result_id", *[F.col(f"{lv}.{f}").alias(f"{lv}_{f}") for lv in metrics.LEVELS for f in ("precision", "recall", "f1", "match_count")])


_COUNTS = """p AS (SELECT result_id, lower(trim(c.van_ban)) AS k, count(*) AS n FROM (SELECT result_id, unnest(pred_citations) AS c FROM eval_result) GROUP BY ALL),
g AS (SELECT result_id, lower(trim(c.van_ban)) AS k, count(*) AS n FROM (SELECT result_id, unnest(ground_truth_citations) AS c FROM eval_result) GROUP BY ALL)"""


@query(f"""WITH {_COUNTS}, m AS (SELECT result_id, sum(least(p.n, g.n))::int AS m FROM p JOIN g USING (result_id) WHERE p.k IS NOT DISTINCT FROM g.k GROUP BY 1),
x AS (SELECT r.result_id, coalesce(len(pred_citations), 0) AS np, coalesce(len(ground_truth_citations), 0) AS ng, coalesce(m, 0) AS m FROM eval_result r LEFT JOIN m USING (result_id)),
y AS (SELECT *, CASE WHEN np > 0 THEN m / np WHEN ng = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN ng > 0 THEN m / ng ELSE 1.0 END AS r FROM x)
SELECT result_id, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, m AS match_count FROM y""")
def citation_scores_norm(spark, sf_dir):
    s = metrics.citation_score(F.col("pred_citations"), F.col("ground_truth_citations"), "van_ban")
    return _r(spark, sf_dir).select("result_id", s.alias("s")).select("result_id", *[F.round(f"s.{c}", 9).alias(c) for c in ("precision", "recall", "f1")], "s.match_count")


_ARTICLES = "SELECT result_id, nullif(lower(trim(c.van_ban)), '') AS k, nullif(lower(trim(c.dieu)), '') AS d, count(*) AS n FROM (SELECT result_id, unnest({c}) AS c FROM eval_result) GROUP BY ALL"


@query(f"""WITH p AS ({_ARTICLES.format(c='pred_citations')}), g AS ({_ARTICLES.format(c='ground_truth_citations')}),
m AS (SELECT result_id, sum(least(p.n, g.n))::int AS m FROM p JOIN g USING (result_id) WHERE p.k IS NOT DISTINCT FROM g.k AND p.d IS NOT DISTINCT FROM g.d GROUP BY 1),
x AS (SELECT r.result_id, coalesce(len(pred_citations), 0) AS np, coalesce(len(ground_truth_citations), 0) AS ng, coalesce(m, 0) AS m FROM eval_result r LEFT JOIN m USING (result_id)),
y AS (SELECT *, CASE WHEN np > 0 THEN m / np WHEN ng = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN ng > 0 THEN m / ng ELSE 1.0 END AS r FROM x)
SELECT result_id, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, m AS match_count FROM y""")
def citation_scores_article(spark, sf_dir):
    """At the level of articles nothing is a wildcard, so greedy matching is the multiset intersection SQL can count."""
    s = metrics.citation_score(F.col("pred_citations"), F.col("ground_truth_citations"), "dieu")
    r = spread(_r(spark, sf_dir).select("result_id", "pred_citations", "ground_truth_citations"))
    return r.select("result_id", s.alias("s")).select("result_id", *[F.round(f"s.{c}", 9).alias(c) for c in ("precision", "recall", "f1")], "s.match_count")


@query("""WITH x AS (SELECT result_id, gap_type, list_distinct(list_filter([lower(trim(c.van_ban)) FOR c IN coalesce(pred_citations, [])], lambda v: v <> '')) AS p,
  list_distinct(list_filter([lower(trim(c.van_ban)) FOR c IN coalesce(ground_truth_citations, [])], lambda v: v <> '')) AS g, coalesce(len(pred_citations), 0) AS n FROM eval_result)
SELECT result_id, CASE WHEN len(g) > 0 THEN len(list_intersect(g, p)) / len(g) WHEN len(p) = 0 THEN 1.0 ELSE 0.0 END AS norm_recall, CASE WHEN gap_type = 'negative' THEN n = 0 END AS negative_correct FROM x""")
def norm_recall(spark, sf_dir):
    p, g = F.col("pred_citations"), F.col("ground_truth_citations")
    return _r(spark, sf_dir).select("result_id", metrics.norm_recall(p, g).alias("norm_recall"), metrics.negative_correct(p, F.col("gap_type")).alias("negative_correct"))


@query("""WITH x AS (SELECT gap_type, theme, CASE WHEN NOT isnan(citation_score.f1) THEN citation_score.f1 END AS f1, norm_recall, negative_correct FROM eval_result)
SELECT grouping_id(gap_type, theme)::int AS level, gap_type, theme, count(*) AS n, round(coalesce(avg(f1), 0), 6) AS mean_f1, round(coalesce(avg(norm_recall), 0), 6) AS mean_norm_recall,
  count(*) FILTER (negative_correct) AS n_negative_correct FROM x GROUP BY GROUPING SETS ((), (gap_type), (theme), (gap_type, theme))""")
def eval_aggregate(spark, sf_dir):
    f1 = F.col("citation_score.f1")
    x = _r(spark, sf_dir).select("gap_type", "theme", F.when(~F.isnan(f1), f1).alias("f1"), "norm_recall", "negative_correct")
    g = x.groupingSets([[], ["gap_type"], ["theme"], ["gap_type", "theme"]], "gap_type", "theme")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return g.agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), mean("f1").alias("mean_f1"), mean("norm_recall").alias("mean_norm_recall"), F.count_if("negative_correct").alias("n_negative_correct")
    )


@query("""WITH s AS (SELECT system, list_sort(list(elapsed_seconds)) AS v FROM eval_result WHERE elapsed_seconds IS NOT NULL AND NOT isnan(elapsed_seconds) GROUP BY 1),
q AS (SELECT system, quantile_cont(elapsed_seconds, 0.5) AS median, quantile_cont(elapsed_seconds, 0.9) AS p90 FROM eval_result WHERE NOT isnan(elapsed_seconds) GROUP BY 1)
SELECT system, v[floor(0.95 * (len(v) - 1))::int + 1] AS p95_lower, v[least(len(v) - 1, floor(0.95 * len(v))::int) + 1] AS p95_clipped, round(median, 6) AS median, round(p90, 6) AS p90 FROM s JOIN q USING (system)""")
def quantile_rules(spark, sf_dir):
    x = _r(spark, sf_dir).where("elapsed_seconds is not null and not isnan(elapsed_seconds)")
    lower = metrics.ranked_quantile(x, ["system"], "elapsed_seconds", 0.95, "p95_lower")
    n = x.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("elapsed_seconds", 0.5), 6).alias("median"), F.round(F.percentile("elapsed_seconds", 0.9), 6).alias("p90"))
    # the second rule's index, looked up in the running counts of different values
    counts = x.groupBy("system", "elapsed_seconds").agg(F.count(F.lit(1)).alias("c"))
    run = counts.withColumn("to", F.sum("c").over(Window.partitionBy("system").orderBy("elapsed_seconds"))).join(n.select("system", "n"), "system")
    at = F.least(F.col("n") - 1, F.floor(0.95 * F.col("n")))
    clipped = run.where((F.col("to") > at) & (F.col("to") - F.col("c") <= at)).select("system", F.col("elapsed_seconds").alias("p95_clipped"))
    return lower.join(clipped, "system").join(n, "system").select("system", "p95_lower", "p95_clipped", "median", "p90")


@query(f"""WITH RECURSIVE {_X.format(where=' WHERE pred_citations IS NOT NULL AND ground_truth_citations IS NOT NULL')}, {_fold('khoan', 'f')},
m AS (SELECT x.*, used, hit FROM f JOIN x USING (result_id) WHERE i = len(p)), k AS (SELECT *, [nullif(lower(trim(c.van_ban)), '') FOR c IN p] AS pk FROM m),
e AS (SELECT gap_type, 'negative_fail' AS error FROM k WHERE gap_type = 'negative' AND len(p) > 0
UNION ALL SELECT gap_type, CASE WHEN v IS NOT NULL AND list_contains(pk, v) THEN 'generation_fail' ELSE 'retrieval_fail' END FROM (
  SELECT gap_type, pk, used, unnest([nullif(lower(trim(c.van_ban)), '') FOR c IN g]) AS v, unnest(range(1, len(g) + 1)) AS j FROM k WHERE gap_type IS DISTINCT FROM 'negative') WHERE NOT list_contains(used, j)
UNION ALL SELECT gap_type, 'over_cite' FROM (SELECT gap_type, unnest(hit) AS h FROM k WHERE gap_type IS DISTINCT FROM 'negative') WHERE NOT h)
SELECT gap_type, error, count(*) AS n FROM e GROUP BY ALL""")
def error_taxonomy(spark, sf_dir):
    return metrics.error_taxonomy(_r(spark, sf_dir)).groupBy("gap_type", "error").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT system, count(*) AS n, round(avg(citation_score.pred_count), 6) AS mean_pred, round(avg(citation_score.gt_count), 6) AS mean_gt, round(avg(CASE WHEN isnan(citation_score.precision) THEN NULL ELSE citation_score.precision END), 6) AS mean_precision,
  round(avg((citation_score.pred_count > citation_score.match_count)::int), 6) AS over_cite_rate FROM eval_result WHERE gap_type <> 'negative' GROUP BY 1""")
def citation_behaviour(spark, sf_dir):
    s = F.col("citation_score")
    p = F.when(~F.isnan(s["precision"]), s["precision"])
    x = _r(spark, sf_dir).where("gap_type <> 'negative'").groupBy("system")
    return x.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(s["pred_count"]), 6).alias("mean_pred"), F.round(F.avg(s["gt_count"]), 6).alias("mean_gt"), F.round(F.avg(p), 6).alias("mean_precision"),
        F.round(F.avg((s["pred_count"] > s["match_count"]).cast("int")), 6).alias("over_cite_rate"),
    )


@query("""SELECT system, round(avg(CASE WHEN isnan(faithfulness.existence_rate) THEN NULL ELSE faithfulness.existence_rate END), 6) AS existence, round(avg(CASE WHEN isnan(faithfulness.support_rate) THEN NULL ELSE faithfulness.support_rate END), 6) AS support,
  sum(faithfulness.citations_existing)::bigint AS existing, sum(faithfulness.citations_total)::bigint AS total FROM eval_result GROUP BY 1""")
def faithfulness_means(spark, sf_dir):
    real = lambda c: F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 6)
    return _r(spark, sf_dir).groupBy("system").agg(
        real("faithfulness.existence_rate").alias("existence"), real("faithfulness.support_rate").alias("support"), F.sum("faithfulness.citations_existing").alias("existing"), F.sum("faithfulness.citations_total").alias("total")
    )


_F1 = "SELECT id, system, avg(citation_score.f1) AS f1 FROM eval_result WHERE NOT isnan(citation_score.f1) AND gap_type <> 'negative' GROUP BY ALL"


def _means(spark, sf_dir) -> DataFrame:
    """Mean F1 per question and system, negatives left out."""
    f1 = F.col("citation_score.f1")
    return _r(spark, sf_dir).where((F.col("gap_type") != "negative") & ~F.isnan(f1)).groupBy("id", "system").agg(F.avg(f1).alias("f1"))


def _pair(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = _means(spark, sf_dir)
    return m.where("system = 'naive_rag'"), m.where("system = 'graphrag'")


_DELTA = f"m AS ({_F1}), d AS (SELECT id, b.f1 - a.f1 AS delta FROM (FROM m WHERE system = 'naive_rag') a JOIN (FROM m WHERE system = 'graphrag') b USING (id))"


@query(f"WITH {_DELTA} SELECT id, round(delta, 9) AS delta, CASE WHEN round(delta, 9) > 0.05 THEN 'better' WHEN round(delta, 9) < -0.05 THEN 'worse' ELSE 'same' END AS bucket FROM d")
def compare_buckets(spark, sf_dir):
    return stats.compare_buckets(stats.paired_deltas(*_pair(spark, sf_dir)).withColumn("delta", F.round("delta", 9)))


@query(f"WITH {_DELTA} SELECT count(*) FILTER (delta > 1e-9) AS wins, count(*) FILTER (delta < -1e-9) AS losses, count(*) FILTER (abs(delta) <= 1e-9) AS ties, round(avg(delta), 9) AS mean_delta FROM d")
def win_loss_tie(spark, sf_dir):
    return stats.win_loss_tie(stats.paired_deltas(*_pair(spark, sf_dir))).withColumn("mean_delta", F.round("mean_delta", 9))


@query()
def bootstrap_wilcoxon(spark, sf_dir):
    gaps = _r(spark, sf_dir).select("id", "gap_type").distinct().groupBy("id").agg(F.min("gap_type").alias("gap_type"))
    out = stats.per_group(stats.paired_deltas(*_pair(spark, sf_dir)).join(gaps, "id"), "gap_type")
    return out.withColumn("stars", stats.stars(F.col("p")))


_RATED = """r AS (SELECT least(5, 1 + floor(citation_score.f1 * 5))::int AS a, least(5, 1 + floor(citation_score_dieu.f1 * 5))::int AS b FROM eval_result
  WHERE citation_score.f1 IS NOT NULL AND NOT isnan(citation_score.f1) AND citation_score_dieu.f1 IS NOT NULL AND NOT isnan(citation_score_dieu.f1))"""


def _rated(spark, sf_dir) -> DataFrame:
    """Two ratings of each result on a scale of five."""
    grade = lambda c: F.least(F.lit(5), 1 + F.floor(F.col(c) * 5)).cast("int")
    ok = " and ".join(f"{c}.f1 is not null and not isnan({c}.f1)" for c in ("citation_score", "citation_score_dieu"))
    return _r(spark, sf_dir).where(ok).select(grade("citation_score.f1").alias("a"), grade("citation_score_dieu.f1").alias("b"))


@query(f"""WITH {_RATED}, n AS (SELECT count(*) AS n, avg((a = b)::int) AS po FROM r), e AS (SELECT sum(x.c * y.c) AS e FROM (SELECT a AS k, count(*) AS c FROM r GROUP BY 1) x JOIN (SELECT b AS k, count(*) AS c FROM r GROUP BY 1) y USING (k))
SELECT n, round(po, 9) AS po, round(e / (n * n), 9) AS pe, CASE WHEN e = n * n THEN 1.0 ELSE round((po - e / (n * n)) / (1 - e / (n * n)), 9) END AS kappa FROM n, e""")
def cohen_kappa(spark, sf_dir):
    k = stats.cohen_kappa(_rated(spark, sf_dir), "a", "b")
    return k.select("n", *[F.round(c, 9).alias(c) for c in ("po", "pe", "kappa")])


@query(f"""WITH {_RATED}, o AS (SELECT count(*) AS n, sum((a - b) ** 2) AS seen FROM r), e AS (SELECT sum(x.c * y.c * (x.k - y.k) ** 2) AS e FROM (SELECT a AS k, count(*) AS c FROM r GROUP BY 1) x, (SELECT b AS k, count(*) AS c FROM r GROUP BY 1) y)
SELECT n, round(1 - seen / (e / n), 9) AS kappa FROM o, e""")
def quadratic_kappa(spark, sf_dir):
    return stats.weighted_kappa(_rated(spark, sf_dir), "a", "b").withColumn("kappa", F.round("kappa", 9))


@query("""WITH s AS (SELECT system AS rater, id AS iid, max(citation_score.match_count) AS score FROM eval_result WHERE id IS NOT NULL AND system IS NOT NULL GROUP BY ALL),
p AS (SELECT a.rater AS r1, b.rater AS r2, a.score AS s1, b.score AS s2 FROM s a JOIN s b ON a.iid = b.iid AND a.rater < b.rater WHERE a.score IS NOT NULL AND b.score IS NOT NULL),
n AS (SELECT r1, r2, count(*) AS n, avg((s1 = s2)::int) AS po FROM p GROUP BY ALL),
e AS (SELECT r1, r2, sum(x.c * y.c) AS e FROM (SELECT r1, r2, s1 AS k, count(*) AS c FROM p GROUP BY ALL) x JOIN (SELECT r1, r2, s2 AS k, count(*) AS c FROM p GROUP BY ALL) y USING (r1, r2, k) GROUP BY ALL)
SELECT r1, r2, n, CASE WHEN coalesce(e, 0) = n * n THEN 1.0 ELSE round((po - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)), 6) END AS kappa FROM n LEFT JOIN e USING (r1, r2)""")
def pairwise_kappa(spark, sf_dir):
    s = _r(spark, sf_dir).where("id is not null and system is not null").groupBy(F.col("system").alias("rater"), F.col("id").alias("iid")).agg(F.max("citation_score.match_count").alias("score"))
    return stats.pairwise_kappa(s).withColumn("kappa", F.round("kappa", 6))


_RUNS = "runs AS (SELECT system, date_trunc('month', run_ts)::date AS run, avg(elapsed_seconds) AS v FROM eval_result WHERE NOT isnan(elapsed_seconds) AND run_ts IS NOT NULL GROUP BY ALL)"


def _runs(spark, sf_dir) -> DataFrame:
    """Mean seconds per system and month; a month counts as a run."""
    x = _r(spark, sf_dir).where("elapsed_seconds is not null and not isnan(elapsed_seconds) and run_ts is not null")
    return x.groupBy("system", F.trunc("run_ts", "month").alias("run")).agg(F.avg("elapsed_seconds").alias("v"))


@query(f"WITH {_RUNS} SELECT system, count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, round(coalesce(stddev_samp(v), 0) * 1.96 / sqrt(count(v)), 6) AS ci95 FROM runs GROUP BY 1")
def run_stats(spark, sf_dir):
    s = stats.run_stats(_runs(spark, sf_dir), ["system"], "v")
    return s.select("system", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "ci95")])


@query("""SELECT id, round(stddev_samp(citation_score.f1), 6) AS sigma, count(*) AS n FROM eval_result WHERE NOT isnan(citation_score.f1) AND id IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY sigma DESC, id LIMIT 10""")
def sigma_top10(spark, sf_dir):
    f1 = F.col("citation_score.f1")
    g = _r(spark, sf_dir).where(~F.isnan(f1) & F.col("id").isNotNull()).groupBy("id").agg(F.round(F.stddev_samp(f1), 6).alias("sigma"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.orderBy(F.desc("sigma"), "id").limit(10)


@query("""WITH m AS (SELECT system, avg(citation_score.f1) AS f1 FROM eval_result WHERE NOT isnan(citation_score.f1) GROUP BY 1)
SELECT system, round(f1, 6) AS f1, round((f1 - first_value(f1) OVER w) * 100 / first_value(f1) OVER w, 6) AS vs_base_pct, round(f1 - lag(f1) OVER w, 6) AS vs_prev FROM m WINDOW w AS (ORDER BY system)""")
def ablation_table(spark, sf_dir):
    f1 = F.col("citation_score.f1")
    m = _r(spark, sf_dir).where(~F.isnan(f1)).groupBy("system").agg(F.avg(f1).alias("f1"))
    return stats.ablation_table(m, "system", "f1").select("system", *[F.round(c, 6).alias(c) for c in ("f1", "vs_base_pct", "vs_prev")])


@query("""WITH q AS (SELECT DISTINCT id, gap_type FROM eval_question), r AS (SELECT *, row_number() OVER (PARTITION BY gap_type ORDER BY md5('42|' || id), id) AS rn FROM q)
SELECT id, gap_type FROM r WHERE rn <= 10 ORDER BY md5('42|' || id), id LIMIT 50""")
def stratified_sample(spark, sf_dir):
    return stats.stratified_sample(table(spark, sf_dir, "eval_question").select("id", "gap_type").distinct(), "gap_type", "id", 50, 5)


@query("""WITH g AS (SELECT doc_name, count(*) AS n FROM train_sample GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY md5(concat_ws('|', '42', doc_name)), doc_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(n) OVER () AS total FROM g)
SELECT t.sample_id, CASE WHEN coalesce(before, 0) < total * 0.05 THEN 'val' ELSE 'train' END AS split FROM train_sample t JOIN c ON t.doc_name IS NOT DISTINCT FROM c.doc_name""")
def split_by_document(spark, sf_dir):
    return stats.split_by_group(table(spark, sf_dir, "train_sample").select("sample_id", "doc_name"), "doc_name").select("sample_id", "split")


@query("""WITH p AS (SELECT unnest([lower(trim(c.van_ban)) FOR c IN pred_citations]) AS k FROM eval_result), g AS (SELECT unnest([lower(trim(c.van_ban)) FOR c IN ground_truth_citations]) AS k FROM eval_result)
SELECT k, count(*) AS n FROM (FROM p INTERSECT ALL FROM g) GROUP BY 1""")
def multiset_intersection(spark, sf_dir):
    """Counts first, then the least of both: the multiset intersection without carrying every row."""
    side = lambda c, n: _r(spark, sf_dir).select(F.explode(c).alias("c")).groupBy(F.lower(F.trim("c.van_ban")).alias("k")).agg(F.count(F.lit(1)).alias(n))
    a, b = side("pred_citations", "na"), side("ground_truth_citations", "nb")
    return a.join(b, a.k.eqNullSafe(b.k)).select(a.k, F.least("na", "nb").alias("n"))


@query("""WITH a AS (SELECT DISTINCT id FROM eval_result WHERE system = 'graphrag'), b AS (SELECT DISTINCT id FROM eval_result WHERE system = 'bm25_rag'), q AS (SELECT DISTINCT id FROM eval_question)
SELECT 'both' AS part, id FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only_graph', id FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'never_asked', id FROM (FROM q EXCEPT (FROM a UNION FROM b))""")
def run_set_operations(spark, sf_dir):
    r = _r(spark, sf_dir)
    a, b = r.where("system = 'graphrag'").select("id").distinct(), r.where("system = 'bm25_rag'").select("id").distinct()
    q = table(spark, sf_dir, "eval_question").select("id").distinct()
    part = lambda name, df: df.select(F.lit(name).alias("part"), "id")
    return part("both", a.intersect(b)).unionByName(part("only_graph", a.exceptAll(b))).unionByName(part("never_asked", q.subtract(a.union(b))))


@query("""SELECT system, round(avg(citation_score.f1) FILTER (gap_type = 'gap1'), 6) AS gap1, round(avg(citation_score.f1) FILTER (gap_type = 'gap2'), 6) AS gap2, round(avg(citation_score.f1) FILTER (gap_type = 'gap3'), 6) AS gap3,
  round(avg(citation_score.f1) FILTER (gap_type = 'gap4'), 6) AS gap4, round(avg(citation_score.f1) FILTER (gap_type = 'negative'), 6) AS negative FROM eval_result WHERE NOT isnan(citation_score.f1) GROUP BY 1""")
def mode_pivot(spark, sf_dir):
    f1 = F.col("citation_score.f1")
    return _r(spark, sf_dir).where(~F.isnan(f1)).groupBy("system").pivot("gap_type", ["gap1", "gap2", "gap3", "gap4", "negative"]).agg(F.round(F.avg(f1), 6))


@query("""WITH q AS (SELECT id, any_value(theme) AS theme, any_value(difficulty) AS difficulty FROM (SELECT DISTINCT id, theme, difficulty FROM eval_question) GROUP BY 1 HAVING count(*) = 1)
SELECT r.result_id, q.theme, q.difficulty, r.theme IS DISTINCT FROM q.theme AS changed FROM eval_result r JOIN q USING (id)""")
def refreshed_labels(spark, sf_dir):
    q = table(spark, sf_dir, "eval_question").select("id", "theme", "difficulty").distinct()
    one = q.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.any_value("theme").alias("new_theme"), F.any_value("difficulty").alias("new_difficulty")).where("n = 1")
    return _r(spark, sf_dir).join(one, "id").select("result_id", F.col("new_theme").alias("theme"), F.col("new_difficulty").alias("difficulty"), (~F.col("theme").eqNullSafe(F.col("new_theme"))).alias("changed"))


# --- event streams


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return traces.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id AS key, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, g""")
def event_sessions(spark, sf_dir):
    return traces.sessions(table(spark, sf_dir, "events"), "ts", "user_id")


@query("""SELECT event_id, greatest(0, least(coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6::double, 0) / 2, 5))::double AS wait FROM events""")
def replay_waits(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return traces.replay_waits(e, "user_id", "event_id", "t", speed=2.0, per_second=1e6).select("event_id", "wait")


@query("""SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS step FROM events""")
def carried_steps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("step"))
    return traces.carry_forward(e, "user_id", "event_id", "step").select("event_id", "step")


@query("SELECT event_id, json_extract(props, '$.k')::bigint AS k FROM events")
def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# --- star schema


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
    return x.agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n")
    )


@query("""WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - INTERVAL 1 DAY AS t FROM orders)
SELECT o_custkey, o_orderkey FROM v WHERE f <= TIMESTAMP '1998-01-01' AND coalesce(t, TIMESTAMP '9999-12-31') >= TIMESTAMP '1998-01-01'""")
def point_in_time(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("f"), (F.lead("o_orderdate").over(w) - F.expr("INTERVAL 1 DAY")).alias("t"))
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    return v.where((F.col("f") <= at) & (F.coalesce("t", F.lit("9999-12-31").cast("timestamp_ntz")) >= at)).select("o_custkey", "o_orderkey")
