"""From questions to contexts in one plan, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import citations
from quern.operators import graph, pipeline, retrieval
from quern.operators.validate import leaf_place
from quern.plans.graph_queries import _LINKS, _MAPS, _allocate, _bm25, _concepts, _edges
from quern.plans.plan_queries import _ASKED, _asked
from quern.plans.text_queries import norms
from quern.session import cut
from quern.tables import table

#: The day questions are asked for, but for those that span versions.
AS_OF = "2020-06-30"
TOKEN_BUDGET = 6000

_BM25 = _bm25("SELECT id AS q, question AS text FROM asked").replace("doc_id AS item", "id AS item").replace("FROM documents)", "FROM text_unit)").replace("{k}", "200").replace("asked AS (SELECT q, term", "want AS (SELECT q, term").replace("JOIN asked USING (term)", "JOIN want USING (term)").replace("tot AS (SELECT count(*)", "size AS (SELECT count(*)").replace("JOIN dfs USING (term), tot", "JOIN dfs USING (term), size")
_PIPELINE = rf"""WITH RECURSIVE {_LINKS}, {_ASKED},
plan AS (SELECT id AS q, question, theme, jurisdiction AS j, CASE WHEN gap_type IS DISTINCT FROM 'gap4' THEN '{AS_OF}' END AS day FROM asked),
units AS (SELECT t.id AS item, lower(trim(t.norm_id)) AS norm, component_id AS component, coalesce(tier, 1) AS tier, context_path AS path, amendments, text FROM text_unit t JOIN cur c ON lower(trim(t.norm_id)) = c.key),
seen AS (SELECT s.question_id AS q, s.text_unit_id AS item, max(s.rrf_score) AS score FROM scored_text_unit s WHERE s.question_id IS NOT NULL AND s.rrf_score IS NOT NULL GROUP BY ALL),
best AS (SELECT q, norm, max(score) AS score FROM seen JOIN units USING (item) GROUP BY ALL),
seeds AS (SELECT q, norm AS node FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, norm) AS rn FROM best) WHERE rn <= {pipeline.SEEDS}),
both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk(q, node, hop) AS (SELECT q, node, 0 FROM seeds UNION SELECT w.q, e.b, w.hop + 1 FROM walk w JOIN both_ways e ON w.node = e.a WHERE w.hop < {pipeline.HOPS}),
within AS (SELECT DISTINCT w.q, w.node AS norm FROM walk w JOIN plan p USING (q) JOIN cur c ON w.node = c.key
  WHERE (p.j IS NULL OR p.j = 'multi-juris' OR c.jurisdiction = 'toan-quoc' OR c.jurisdiction = p.j AND p.j IN ('tp-hcm', 'dong-nai')) AND (p.day IS NULL OR c.valid_from <= p.day AND (c.valid_to IS NULL OR c.valid_to >= p.day))),
{_BM25},
d AS (SELECT q, item, rn - 1 AS dr FROM (SELECT s.q, s.item, row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, s.item) AS rn FROM seen s JOIN units u USING (item) JOIN within w ON w.q = s.q AND w.norm = u.norm) WHERE rn <= 50),
l AS (SELECT q, item, rn - 1 AS kr FROM (SELECT s.q, s.item, row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, s.item) AS rn FROM lex s JOIN units u USING (item) JOIN within w ON w.q = s.q AND w.norm = u.norm) WHERE rn <= 50),
amended AS (SELECT DISTINCT norm, component, lower(trim(a.amending_norm)) AS by FROM (SELECT norm, component, unnest(amendments) AS a FROM units)),
boost AS (SELECT DISTINCT w.q, a.component FROM within w JOIN amended a ON a.by = w.norm),
asks AS (SELECT DISTINCT q, x.dieu AS dieu, x.khoan AS khoan FROM (SELECT q, unnest(list_concat([{{'dieu': z[1], 'khoan': z[2]}} FOR z IN list_zip(ds, ks)], [{{'dieu': a, 'khoan': NULL::varchar}} FOR a IN list_filter(alone, lambda z: NOT list_contains(ds, z))])) AS x
  FROM (SELECT q, regexp_extract_all(question, '[Kk]ho[ảà]n\s+(\d+[\p{{L}}\p{{N}}_]*)\s+(?:c[ủù]a\s+)?[ĐDd]i[ềê]u\s+(\d+[\p{{L}}\p{{N}}_]*)', 2) AS ds, regexp_extract_all(question, '[Kk]ho[ảà]n\s+(\d+[\p{{L}}\p{{N}}_]*)\s+(?:c[ủù]a\s+)?[ĐDd]i[ềê]u\s+(\d+[\p{{L}}\p{{N}}_]*)', 1) AS ks,
  regexp_extract_all(question, '[ĐDd]i[ềê]u\s+(\d+[\p{{L}}\p{{N}}_]*)', 1) AS alone FROM plan))),
places AS (SELECT item, norm, regexp_extract(path[2], '^Điều\s+([\p{{L}}\p{{N}}_]+)', 1) AS dieu, regexp_extract(coalesce(path[3], ''), '^Khoản\s+([\p{{L}}\p{{N}}_]+)', 1) AS khoan FROM units),
named AS (SELECT DISTINCT a.q, p.item FROM asks a JOIN places p ON a.dieu = p.dieu AND (a.khoan IS NULL OR a.khoan = p.khoan) JOIN within w ON w.q = a.q AND w.norm = p.norm),
every AS (SELECT q, item FROM d UNION SELECT q, item FROM l UNION SELECT b.q, u.item FROM boost b JOIN units u USING (component) JOIN within w ON w.q = b.q AND w.norm = u.norm UNION SELECT q, item FROM named),
{_MAPS}, m AS (SELECT * FROM maps WHERE concept IS NOT NULL), tot AS (SELECT norm, count(DISTINCT component) AS total FROM m GROUP BY 1),
rare AS (SELECT norm, concept, 1 - count(DISTINCT component) / any_value(total) AS rarity FROM m JOIN tot USING (norm) GROUP BY ALL),
comp AS (SELECT p.q, m.component, max(rarity) AS rarity FROM m JOIN rare USING (norm, concept) JOIN requires r USING (concept) JOIN plan p ON p.theme = r.procedure GROUP BY ALL),
cand AS (SELECT e.q, e.item, u.norm, u.tier, d.dr AS dense_rank, n.item IS NOT NULL AS cited,
  round((1 / (60 + coalesce(d.dr, nd, 0)) + 1 / (60 + coalesce(l.kr, nk, 0))) * (1 + u.tier * 0.1) * CASE WHEN b.component IS NULL THEN 1 ELSE 100 END * (1 + 1.5 * coalesce(c.rarity, 0)), 9) AS score
  FROM every e JOIN units u USING (item) LEFT JOIN d ON d.q = e.q AND d.item = e.item LEFT JOIN l ON l.q = e.q AND l.item = e.item LEFT JOIN named n ON n.q = e.q AND n.item = e.item
  LEFT JOIN boost b ON b.q = e.q AND b.component = u.component LEFT JOIN comp c ON c.q = e.q AND c.component = u.component
  LEFT JOIN (SELECT q, count(*) AS nd FROM d GROUP BY q) x ON x.q = e.q LEFT JOIN (SELECT q, count(*) AS nk FROM l GROUP BY q) y ON y.q = e.q),
{_allocate('cand')},
sized AS (SELECT a.*, greatest(1, floor(length(coalesce(u.text, '')) / 3.5)::int) AS tokens FROM alloc a JOIN units u USING (item))
SELECT q, item, norm, score, rank, used::bigint AS used FROM (SELECT *, sum(tokens) OVER (PARTITION BY q ORDER BY score DESC, item ROWS UNBOUNDED PRECEDING) AS used FROM sized) WHERE used <= {TOKEN_BUDGET}"""


def question_pipeline(spark, sf_dir, ablation: str = "full") -> DataFrame:
    """Every question: seeds, documents within reach, units ranked by retrieval, words and graph, allocated and cut to the budget."""
    n = norms(spark, sf_dir)
    asked = _asked(spark, sf_dir).select(F.col("id").alias("q"), "question", "theme", "jurisdiction", F.when(~F.col("gap_type").eqNullSafe("gap4"), F.lit(AS_OF)).alias("temporal"))
    tiers = n.select(F.col("key").alias("norm"), F.coalesce("tier", F.lit(1)).alias("tier"))
    t = table(spark, sf_dir, "text_unit").select(F.col("id").alias("item"), F.lower(F.trim("norm_id")).alias("norm"), F.col("component_id").alias("component"), "context_path", "amendments")
    units = cut(t.join(tiers, "norm"))
    s = table(spark, sf_dir, "scored_text_unit").where("question_id is not null and rrf_score is not null")
    seen = cut(s.groupBy(F.col("question_id").alias("q"), F.col("text_unit_id").alias("item")).agg(F.max("rrf_score").alias("score")))
    seeds = pipeline.seed_norms(seen.join(units.select("item", "norm"), "item"))
    places = n.select(F.col("key").alias("norm"), "jurisdiction", "valid_from", "valid_to")
    within = cut(pipeline.searched_norms(asked, seeds, graph.gated_edges(*_edges(spark, sf_dir)), places, ablation))
    texts = table(spark, sf_dir, "text_unit").select(F.col("id").alias("item"), "text")
    lexical = retrieval.bm25_top_k(asked.select("q", F.col("question").alias("text")), texts, 200)
    amended = units.select("component", F.explode(F.transform("amendments", lambda a: F.lower(F.trim(a["amending_norm"])))).alias("norm")).distinct()
    boosted = cut(within.join(amended, "norm").select("q", "component").distinct())
    asks = asked.select("q", F.explode(citations.structured_cites(F.col("question"))).alias("c")).select("q", "c.dieu", F.col("c.khoan").alias("asked_khoan")).distinct()
    leaves = units.select("item", leaf_place(F.col("context_path")).alias("p")).select("item", "p.dieu", "p.khoan")
    cited = asks.join(leaves, "dieu").where("asked_khoan is null or asked_khoan = khoan").select("q", "item")
    rarity = graph.rarity_score(*_concepts(spark, sf_dir)).groupBy("procedure", "component").agg(F.max("score").alias("rarity"))
    procedures = asked.select("q", F.col("theme").alias("procedure"))
    kept = pipeline.search(within, units.select("item", "norm", "component", "tier"), seen, lexical, boosted, cited, rarity, procedures)
    return retrieval.budget_prune(kept.join(texts, "item"), TOKEN_BUDGET).select("q", "item", "norm", "score", "rank", "used")


QUERIES = {"question_pipeline": question_pipeline}
ORACLE = {"question_pipeline": _PIPELINE}
