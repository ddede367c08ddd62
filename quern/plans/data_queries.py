"""Queries of the general data operators (problems 1, 3, 5 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import hierarchy, intervals, nested, references
from quern.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.validity_intervals(table(spark, sf_dir, "scored_text_unit"), table(spark, sf_dir, "norm"))
    out = intervals.periods_and_gaps(intervals.continuous_periods(rows))
    return out.select(F.col("key").alias("component_id"), "kind", F.date_format("start", "yyyy-MM-dd").alias("from_date"), F.date_format("end", "yyyy-MM-dd").alias("to_date"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    children, parents = references.norm_references(table(spark, sf_dir, "eval_result"), table(spark, sf_dir, "norm"))
    return references.orphan_references(children, parents)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(p3_found(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.citation_rows(table(spark, sf_dir, "raw_result"))


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.json_nodes(table(spark, sf_dir, "raw_result"), "raw_id", "payload")


def _norm_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(*hierarchy.norm_links(table(spark, sf_dir, "norm")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _norm_hierarchy(spark, sf_dir).withColumnRenamed("node", "norm_id")


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(_norm_hierarchy(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_report, p5_found, p5_nodes, p7_found, p7_descendants)}

_CURRENT = """
norm_rows AS (SELECT lower(trim(id)) AS key, * FROM norm WHERE length(trim(id)) > 0),
cur AS (
  SELECT * FROM (SELECT *, min(ingested_at) OVER (PARTITION BY key) AS arrival,
    row_number() OVER (PARTITION BY key ORDER BY ingested_at DESC) AS rn FROM norm_rows) WHERE rn = 1)"""


def _day(c: str) -> str:
    return (
        f"coalesce(try_strptime(nullif(regexp_extract({c}, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})([T\\s].*)?$', 1), ''), '%Y-%m-%d')::date,"
        f" try_strptime(nullif(regexp_extract({c}, '^\\s*(\\d{{2}}/\\d{{2}}/\\d{{4}})([T\\s].*)?$', 1), ''), '%d/%m/%Y')::date)"
    )


_P1 = f"""
WITH {_CURRENT},
own AS (SELECT component_id, lower(trim(norm_id)) AS nk, valid_from AS f, valid_to AS t,
  length(trim(coalesce(valid_from, ''))) = 0 AND length(trim(coalesce(valid_to, ''))) = 0 AS lent FROM scored_text_unit),
dated AS (
  SELECT component_id, f, t FROM own WHERE NOT lent
  UNION ALL SELECT o.component_id, c.valid_from, c.valid_to FROM own o JOIN cur c ON o.nk = c.key WHERE o.lent),
iv AS (
  SELECT DISTINCT component_id, {_day('f')} AS a,
    CASE WHEN length(trim(coalesce(t, ''))) = 0 THEN DATE '9999-12-31' ELSE {_day('t')} END AS b FROM dated),
ok AS (SELECT * FROM iv WHERE component_id IS NOT NULL AND a <= b),
flag AS (SELECT *, CASE WHEN date_diff('day', max(b) OVER w, a) <= 1 THEN 0 ELSE 1 END AS fresh FROM ok
  WINDOW w AS (PARTITION BY component_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY component_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM flag),
period AS (SELECT component_id, g, min(a) AS a, max(b) AS b, count(*) AS n FROM island GROUP BY 1, 2),
nxt AS (SELECT *, lead(a) OVER (PARTITION BY component_id ORDER BY a) AS na FROM period)
SELECT component_id, 'merged' AS kind, strftime(a, '%Y-%m-%d') AS from_date, strftime(b, '%Y-%m-%d') AS to_date FROM nxt WHERE n >= 2
UNION ALL
SELECT component_id, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(na - 1, '%Y-%m-%d') FROM nxt WHERE na IS NOT NULL"""

_P3 = f"""
WITH {_CURRENT},
refs AS (
  SELECT 'eval_result' AS src_table, result_id::varchar AS src_key, lower(trim(c.van_ban)) AS ref_id, run_ts AS tm
  FROM (SELECT result_id, run_ts, unnest(pred_citations) AS c FROM eval_result)
  UNION ALL
  SELECT 'norm', key, lower(trim(i)), ingested_at FROM (SELECT key, ingested_at, unnest(implements) AS i FROM cur)),
j AS (SELECT r.*, c.key AS found, c.arrival, c.deleted_at FROM refs r LEFT JOIN cur c ON r.ref_id = c.key WHERE length(r.ref_id) > 0),
o AS (
  SELECT *, 'missing' AS reason FROM j WHERE found IS NULL
  UNION ALL SELECT *, 'late' FROM j WHERE arrival > tm
  UNION ALL SELECT *, 'deleted' FROM j WHERE deleted_at <= tm)
SELECT DISTINCT src_table, src_key, ref_id, reason, strftime(tm, '%Y-%m') AS period_ym FROM o"""

_P7_PATHS = f"""
WITH RECURSIVE {_CURRENT},
links AS (
  SELECT DISTINCT child, parent FROM (
    SELECT key AS child, lower(trim(p)) AS parent FROM (SELECT key, unnest(implements) AS p FROM cur)
    UNION ALL SELECT lower(trim(c)), key FROM (SELECT key, unnest(amended_by_norms) AS c FROM cur))
  WHERE child IN (SELECT key FROM cur) AND parent IN (SELECT key FROM cur)),
reach(v, u) AS (SELECT child, parent FROM links UNION SELECT r.v, l.parent FROM reach r JOIN links l ON r.u = l.child),
loops AS (SELECT v FROM reach WHERE u = v),
caught AS (
  SELECT v AS norm_id, 'cycle' AS kind FROM loops
  UNION SELECT v, 'below_cycle' FROM reach WHERE u IN (FROM loops) AND v NOT IN (FROM loops)),
clean AS (SELECT key FROM cur WHERE key NOT IN (SELECT norm_id FROM caught)),
ways(node, root_id, depth, path) AS (
  SELECT key, key, 0, key FROM clean WHERE key NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, w.root_id, w.depth + 1, w.path || '>' || l.child FROM ways w JOIN links l ON w.node = l.parent WHERE l.child IN (FROM clean))
"""

ORACLE = {
    "p1_found": _P1,
    "p3_found": _P3,
    "p3_report": f"SELECT src_table, reason, period_ym, count(*) AS n_refs, count(DISTINCT ref_id) AS n_keys FROM ({_P3}) GROUP BY ALL",
    "p7_found": _P7_PATHS
    + """SELECT node AS norm_id, 'path' AS kind, root_id, depth, path FROM ways
UNION ALL SELECT norm_id, kind, '', -1, '' FROM caught""",
    "p7_descendants": _P7_PATHS
    + """, steps AS (SELECT node, depth, unnest(string_split(path, '>')) AS ancestor, generate_subscripts(string_split(path, '>'), 1) AS i FROM ways)
SELECT ancestor, node AS descendant, min(depth - i + 1) AS distance FROM steps WHERE i <= depth GROUP BY ALL""",
}
