"""Queries of the document graph and of retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from quern.operators import graph, retrieval
from quern.operators.metrics import ranking_metrics
from quern.plans.data_queries import _CURRENT
from quern.plans.text_queries import WORDS, norms
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


@query(f"WITH {_CURRENT} SELECT key AS id, title, tier, theme, ingested_at FROM cur")
def node_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "norm").select(F.lower(F.trim("id")).alias("id"), "title", "tier", "theme", "ingested_at").where("length(id) > 0")
    return graph.upsert_latest(rows, "id", "ingested_at")


_LINKS = f"""{_CURRENT},
links AS (SELECT DISTINCT src, dst, rel FROM (
  SELECT key AS src, lower(trim(x)) AS dst, 'IMPLEMENTS' AS rel FROM (SELECT key, unnest(implements) AS x FROM cur)
  UNION ALL SELECT lower(trim(x)), key, 'AMENDS' FROM (SELECT key, unnest(amended_by_norms) AS x FROM cur)) WHERE length(src) > 0 AND length(dst) > 0),
edges AS (SELECT * FROM links WHERE src IN (SELECT key FROM cur) AND dst IN (SELECT key FROM cur))"""


def _edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = norms(spark, sf_dir)
    return graph.norm_edges(n), n.select(F.col("key").alias("id"))


@query(f"WITH {_LINKS} FROM edges")
def edge_upsert(spark, sf_dir):
    return graph.gated_edges(*_edges(spark, sf_dir))


@query(f"WITH {_LINKS} FROM links EXCEPT FROM edges")
def edge_dangling(spark, sf_dir):
    return graph.dangling_edges(*_edges(spark, sf_dir))


@query(f"WITH {_LINKS} SELECT rel, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM edges GROUP BY 1")
def graph_census(spark, sf_dir):
    return graph.census(graph.gated_edges(*_edges(spark, sf_dir)))


_SEEDS = """seeds AS (SELECT question_id AS q, lower(trim(arg_max(norm_id, {'s': rrf_score, 'r': row_id}))) AS node FROM scored_text_unit WHERE question_id IS NOT NULL AND norm_id IS NOT NULL AND rrf_score IS NOT NULL GROUP BY 1)"""
_CLOSURE = f"""WITH RECURSIVE {_LINKS}, {_SEEDS},
both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk(q, node, hop) AS (SELECT q, node, 0 FROM seeds UNION SELECT w.q, e.b, w.hop + 1 FROM walk w JOIN both_ways e ON w.node = e.a WHERE w.hop < 4),
reached AS (SELECT q, node, min(hop) AS hop FROM walk GROUP BY ALL)"""


def _reached(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "scored_text_unit").where("question_id is not null and norm_id is not null and rrf_score is not null")
    seeds = s.groupBy(F.col("question_id").alias("q")).agg(F.lower(F.trim(F.max_by("norm_id", F.struct("rrf_score", "row_id")))).alias("node"))
    return graph.closure(seeds, graph.gated_edges(*_edges(spark, sf_dir)), 4)


@query(_CLOSURE + " FROM reached")
def graph_closure_4hop(spark, sf_dir):
    return _reached(spark, sf_dir)


@query(_CLOSURE + """, asked AS (SELECT DISTINCT id AS q, jurisdiction AS j FROM eval_question)
SELECT DISTINCT r.q, r.node FROM reached r JOIN asked a USING (q) JOIN cur c ON r.node = c.key
WHERE (a.j IS NULL OR a.j = 'multi-juris' OR c.jurisdiction = 'toan-quoc' OR c.jurisdiction = a.j AND a.j IN ('tp-hcm', 'dong-nai'))
  AND c.valid_from <= '2020-06-30' AND (c.valid_to IS NULL OR c.valid_to >= '2020-06-30')""")
def stage2_norms(spark, sf_dir):
    n = norms(spark, sf_dir).select(F.col("key").alias("node"), F.col("jurisdiction").alias("nj"), "valid_from", "valid_to")
    asked = table(spark, sf_dir, "eval_question").select(F.col("id").alias("q"), graph.allowed_jurisdictions(F.col("jurisdiction")).alias("allowed")).distinct()
    near = _reached(spark, sf_dir).join(asked, "q").join(n, "node")
    ok = (F.col("allowed").isNull() | F.array_contains("allowed", F.col("nj"))) & graph.valid_at(F.lit("2020-06-30"), F.col("valid_from"), F.col("valid_to"))
    return near.where(ok).select("q", "node").distinct()


@query("""WITH p AS (SELECT DISTINCT lower(trim(norm_id)) AS norm, component_id FROM text_unit WHERE norm_id IS NOT NULL)
SELECT norm, component_id FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY component_id) AS rn FROM p) WHERE rn <= 100""")
def norm_component_caps(spark, sf_dir):
    p = table(spark, sf_dir, "text_unit").where("norm_id is not null").select(F.lower(F.trim("norm_id")).alias("norm"), "component_id").distinct()
    return graph.per_group_cap(p, ["norm"], "component_id", 100)


_MAPS = r"""maps AS (SELECT DISTINCT lower(trim(norm_id)) AS norm, component_id AS component, nullif(regexp_extract(context_path[2], '^Điều \w+\. (.*)$', 1), '') AS concept FROM text_unit),
requires AS (SELECT DISTINCT theme AS procedure, regexp_extract(title, '^(.*?)(?: – .*)?$', 1) AS concept FROM documents WHERE theme IS NOT NULL AND title IS NOT NULL)"""


def _concepts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    u, d = table(spark, sf_dir, "text_unit"), table(spark, sf_dir, "documents")
    concept = F.nullif(F.regexp_extract(F.get("context_path", F.lit(1)), r"^Điều \w+\. (.*)$", 1), F.lit(""))
    maps = u.select(F.lower(F.trim("norm_id")).alias("norm"), F.col("component_id").alias("component"), concept.alias("concept"))
    req = d.where("theme is not null and title is not null").select(F.col("theme").alias("procedure"), F.regexp_extract("title", "^(.*?)(?: – .*)?$", 1).alias("concept"))
    return maps, req


@query(f"WITH {_MAPS} SELECT DISTINCT procedure, component FROM maps JOIN requires USING (concept)")
def procedure_components(spark, sf_dir):
    return graph.procedure_components(*_concepts(spark, sf_dir))


_RARITY = f"""WITH {_MAPS}, m AS (SELECT * FROM maps WHERE concept IS NOT NULL),
t AS (SELECT norm, count(DISTINCT component) AS total FROM m GROUP BY 1),
rare AS (SELECT norm, concept, 1 - count(DISTINCT component) / any_value(total) AS rarity FROM m JOIN t USING (norm) GROUP BY ALL)"""


@query(_RARITY + " FROM rare")
def concept_rarity(spark, sf_dir):
    return graph.concept_rarity(_concepts(spark, sf_dir)[0])


@query(_RARITY + " SELECT procedure, norm, component, max(rarity) AS score FROM m JOIN rare USING (norm, concept) JOIN requires USING (concept) GROUP BY ALL")
def rarity_scores(spark, sf_dir):
    return graph.rarity_score(*_concepts(spark, sf_dir))


@query(f"""WITH {_CURRENT} SELECT t.id AS unit_id, ctv_id, component_id, key AS norm_key, theme, jurisdiction, coalesce(tier, 1) AS tier, md5(t.text) AS text_md5
FROM text_unit t JOIN cur c ON lower(trim(t.norm_id)) = c.key WHERE theme IS NOT NULL AND length(trim(t.text)) > 0""")
def path_scan(spark, sf_dir):
    p = graph.path_scan(norms(spark, sf_dir), table(spark, sf_dir, "text_unit"))
    return p.select("unit_id", "ctv_id", "component_id", "norm_key", "theme", "jurisdiction", "tier", F.md5("text").alias("text_md5"))


@query(f"""WITH {_CURRENT}, u AS (SELECT t.id AS c, t.text, c.valid_from AS vf, t.original_version.text AS o, list_min([a.effective_date FOR a IN t.amendments IF a.effective_date IS NOT NULL]) AS first
  FROM text_unit t JOIN cur c ON lower(trim(t.norm_id)) = c.key),
v AS (SELECT c || '-v0' AS ctv_id, c AS component_id, vf AS valid_from, coalesce(strftime(try_strptime(first, '%Y-%m-%d')::date - 1, '%Y-%m-%d'), first) AS valid_to, 'superseded' AS status, o AS text FROM u WHERE o IS NOT NULL AND first IS NOT NULL
  UNION ALL SELECT c || '-v1', c, first, '9999-12-31', 'active', text FROM u WHERE o IS NOT NULL AND first IS NOT NULL
  UNION ALL SELECT c || '-v0', c, vf, '9999-12-31', 'active', text FROM u WHERE o IS NULL OR first IS NULL)
SELECT ctv_id, component_id, valid_from, valid_to, status, md5(text) AS text_md5 FROM v""")
def version_split(spark, sf_dir):
    n = norms(spark, sf_dir).select("key", "valid_from")
    u = table(spark, sf_dir, "text_unit").select(
        F.col("id").alias("component_id"), "text", F.lower(F.trim("norm_id")).alias("key"), F.col("original_version.text").alias("original_text"), F.transform("amendments", lambda a: a["effective_date"]).alias("effective_dates")
    )
    return graph.split_versions(u.join(n, "key")).select("ctv_id", "component_id", "valid_from", "valid_to", "status", F.md5("text").alias("text_md5"))


@query("SELECT count(*) FILTER (valid_to IS NULL) AS open_before, 0::bigint AS open_after, count(*) FILTER (coalesce(valid_to, '9999-12-31') = '9999-12-31') AS sentinels FROM norm")
def sentinel_migration(spark, sf_dir):
    n = table(spark, sf_dir, "norm").select("valid_to", F.col("valid_to").isNull().alias("was"))
    return graph.close_open_ends(n).agg(F.count_if("was").alias("open_before"), F.count_if(F.col("valid_to").isNull()).alias("open_after"), F.count_if(F.col("valid_to") == "9999-12-31").alias("sentinels"))


@query("""WITH a AS (SELECT component_id, list_sort(list(DISTINCT {'effective_date': a.effective_date, 'amending_norm': a.amending_norm})) AS l FROM (SELECT component_id, unnest(amendments) AS a FROM text_unit) WHERE a.amending_norm IS NOT NULL GROUP BY 1)
SELECT t.id AS unit_id, t.component_id, coalesce(array_to_string([concat_ws(' ', x.effective_date, x.amending_norm) FOR x IN l], '; '), '') AS amendments FROM text_unit t LEFT JOIN a USING (component_id)""")
def component_amendments(spark, sf_dir):
    u = table(spark, sf_dir, "text_unit")
    a = u.select("component_id", F.explode("amendments").alias("a")).select("component_id", "a.amending_norm", "a.effective_date")
    told = F.array_join(F.transform("amendments", lambda x: F.concat_ws(" ", x["effective_date"], x["amending_norm"])), "; ")
    return graph.amendments_of(u.select(F.col("id").alias("unit_id"), "component_id"), a).withColumn("amendments", told)


_SIDE = "SELECT result_id AS q, generate_subscripts({c}, 1) - 1 AS i, unnest({c}) AS c FROM eval_result"


@query(f"""WITH p AS ({_SIDE.format(c='pred_citations')}), g AS ({_SIDE.format(c='ground_truth_citations')}),
x AS (SELECT q || '-' || i AS cite_id, q, c.van_ban AS norm, c.dieu AS d, c.khoan AS k, c.diem AS m FROM p), y AS (SELECT i AS block_id, q, c.van_ban AS norm, c.dieu AS d, c.khoan AS k, c.diem AS m FROM g),
j AS (SELECT cite_id, block_id, coalesce((x.d = y.d)::int, 0) + coalesce((x.k = y.k)::int, 0) + coalesce((x.m = y.m)::int, 0) AS n_match,
  (y.d IS NOT NULL AND x.d IS NULL)::int + (y.k IS NOT NULL AND x.k IS NULL)::int + (y.m IS NOT NULL AND x.m IS NULL)::int AS n_extra
  FROM x JOIN y USING (q, norm) WHERE NOT (coalesce(x.d <> y.d, false) OR coalesce(x.k <> y.k, false) OR coalesce(x.m <> y.m, false))),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cite_id ORDER BY n_match DESC, n_extra, block_id) AS rn FROM j WHERE n_match > 0) WHERE rn = 1)
SELECT cite_id, block_id::int AS block_id, n_match, n_extra FROM x LEFT JOIN b USING (cite_id)""")
def best_links(spark, sf_dir):
    r = table(spark, sf_dir, "eval_result")
    side = lambda c: r.select(F.col("result_id").alias("q"), F.posexplode(c).alias("i", "c")).select("q", "i", F.col("c.van_ban").alias("norm"), "c.dieu", "c.khoan", "c.diem")
    cites = side("pred_citations").withColumn("cite_id", F.concat_ws("-", "q", "i")).drop("i")
    return graph.best_link(cites, side("ground_truth_citations").withColumnRenamed("i", "block_id"))


@query(f"""WITH {_CURRENT}, d AS (SELECT doc_id, lower(trim(norm_id)) AS k, theme FROM documents),
one AS (SELECT key, any_value(theme) AS t FROM cur WHERE theme IS NOT NULL GROUP BY key)
SELECT doc_id, coalesce(theme, t) AS theme FROM d LEFT JOIN one ON d.k = one.key""")
def theme_backfill(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("norm_id")).alias("key"), "theme")
    return d.join(norms(spark, sf_dir).select("key", F.col("theme").alias("t")), "key", "left").select("doc_id", F.coalesce("theme", "t").alias("theme"))


# --- retrieval

_DENSE = """dots AS (SELECT a.vec_id AS q, b.vec_id AS item, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) AS score FROM embeddings a JOIN embeddings b ON len(a.embedding) = len(b.embedding) WHERE a.vec_id % 100 = 0),
dense AS (SELECT q, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item)::int AS rank FROM dots) WHERE rank <= {k})"""


def _dense(spark, sf_dir, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieval.dense_top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec")), k)


@query(f"WITH {_DENSE.format(k=10)} FROM dense")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10)


@query(f"WITH {_DENSE.format(k=5)} FROM dense WHERE score >= 0.3 OR rank = 1")
def dense_threshold(spark, sf_dir):
    return retrieval.threshold_or_best(_dense(spark, sf_dir, 5))


def _bm25(queries: str) -> str:
    return f"""toks AS (SELECT doc_id AS item, {WORDS.format(c='text')} AS t FROM documents), tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (SELECT item, dl, term, count(*) AS tf FROM (SELECT item, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
asked AS (SELECT q, term, count(*) AS qf FROM (SELECT q, unnest({WORDS.format(c='text')}) AS term FROM ({queries})) GROUP BY ALL),
sums AS (SELECT q, item, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN asked USING (term) JOIN dfs USING (term), tot GROUP BY ALL),
lex AS (SELECT q, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item)::int AS rank FROM sums WHERE score > 0) WHERE rank <= {{k}})"""


@query(f"WITH {_bm25('SELECT id AS q, any_value(question) AS text FROM eval_question GROUP BY id').replace('{k}', '20')} FROM lex")
def bm25_topk(spark, sf_dir):
    q = table(spark, sf_dir, "eval_question").groupBy(F.col("id").alias("q")).agg(F.any_value("question").alias("text"))
    return retrieval.bm25_top_k(q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text"), 20)


_TOK = "list_distinct(list_filter(regexp_split_to_array(replace(strip_accents(lower({c})), 'đ', 'd'), '[^a-z0-9]+'), lambda x: length(x) > 1))"


@query(f"""WITH q AS (SELECT doc_id AS q, {_TOK.format(c="norm_id || ' ' || source")} AS t FROM documents WHERE doc_id % 100 = 0 AND norm_id IS NOT NULL),
i AS (SELECT DISTINCT lower(trim(id)) AS item FROM norm WHERE length(trim(id)) > 0), e AS (SELECT item, unnest({_TOK.format(c='item')}) AS tok FROM i),
x AS (SELECT q, len(t) AS n, unnest(t) AS tok FROM q)
SELECT q, item, count(*) / any_value(n) AS score FROM x JOIN e USING (tok) GROUP BY q, item HAVING count(*) / any_value(n) >= 0.5""")
def keyword_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 100 = 0 and norm_id is not null").select(F.col("doc_id").alias("q"), F.concat_ws(" ", "norm_id", "source").alias("text"))
    i = norms(spark, sf_dir).select(F.col("key").alias("item"), F.col("key").alias("name"))
    return retrieval.keyword_overlap(d, i)


_FUSED = f"""WITH {_DENSE.format(k=50)}, {_bm25('SELECT doc_id AS q, title AS text FROM documents WHERE doc_id % 100 = 0').replace('{k}', '50')},
f AS (SELECT coalesce(d.q, l.q) AS q, coalesce(d.item, l.item) AS item, d.rank - 1 AS dr0, l.rank - 1 AS kr0 FROM dense d FULL JOIN lex l ON d.q = l.q AND d.item = l.item),
g AS (SELECT q, item, coalesce(dr0, count(dr0) OVER (PARTITION BY q)) AS dr, coalesce(kr0, count(kr0) OVER (PARTITION BY q)) AS kr, dr0 FROM f),
fused AS (SELECT g.q, g.item, dr, kr, dr0, lower(trim(source)) AS norm, (length(lower(trim(source))) % 4 + 1)::int AS tier, round((1 / (60 + dr) + 1 / (60 + kr)) * (1 + (length(lower(trim(source))) % 4 + 1) * 0.1), 6) AS score
  FROM g JOIN documents ON doc_id = g.item)"""


def _fused(spark, sf_dir) -> DataFrame:
    """Dense and lexical lists fused; vectors are those of the documents with equal number, sources play documents, their length the tier."""
    d = table(spark, sf_dir, "documents")
    q = d.where("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("q"), F.col("title").alias("text"))
    dense = _dense(spark, sf_dir, 50)
    lex = retrieval.bm25_top_k(q, d.select(F.col("doc_id").alias("item"), "text"), 50)
    both = retrieval.fuse(dense, lex).join(dense.select("q", "item", (F.col("rank") - 1).alias("dense_rank")), ["q", "item"], "left")
    source = F.lower(F.trim("source"))
    docs = d.select(F.col("doc_id").alias("item"), source.alias("norm"), (F.length(source) % 4 + 1).cast("int").alias("tier"))
    score = retrieval.rrf_score(F.col("dr"), F.col("kr"), F.col("tier"), F.lit(False), F.lit(0.0))
    return both.join(docs, "item").withColumn("score", F.round(score, 6))


@query(_FUSED + " SELECT q, item, dr::bigint AS dr, kr::bigint AS kr, score FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("q", "item", F.col("dr").cast("bigint").alias("dr"), F.col("kr").cast("bigint").alias("kr"), "score")


def _allocate(src: str, q: str = "q") -> str:
    """SQL of the capped allocation over a table with q, item, norm, tier, score, dense_rank, cited."""
    return f"""w1 AS (SELECT *, row_number() OVER (PARTITION BY q, norm ORDER BY dense_rank NULLS LAST, item) AS fd, row_number() OVER (PARTITION BY q, norm ORDER BY score DESC NULLS LAST, item) AS fa,
  max((dense_rank IS NOT NULL)::int) OVER (PARTITION BY q, norm) AS hd FROM {src}),
w2 AS (SELECT *, CASE WHEN cited THEN -1 WHEN fd = 1 AND dense_rank IS NOT NULL THEN 0 WHEN hd = 0 AND fa = 1 THEN 1 ELSE 2 END AS step FROM w1),
w3 AS (SELECT *, CASE WHEN step = 0 THEN -dense_rank::double ELSE score END AS b FROM w2),
w4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, norm ORDER BY step, b DESC NULLS LAST, item) AS nn FROM w3) WHERE nn <= 3),
w5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, tier ORDER BY step, b DESC NULLS LAST, item) AS nt FROM w4) WHERE nt <= CASE tier WHEN 1 THEN 8 WHEN 2 THEN 8 WHEN 3 THEN 6 WHEN 4 THEN 8 ELSE 25 END),
w6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY step, b DESC NULLS LAST, item) AS na FROM w5) WHERE na <= 25),
alloc AS (SELECT q, item, norm, tier, score, row_number() OVER (PARTITION BY q ORDER BY score DESC NULLS LAST, item)::int AS rank FROM w6)"""


_UNITS = """units AS (SELECT question_id AS q, row_id AS item, lower(trim(norm_id)) AS norm, tier, rrf_score AS score, jurisdiction IS NULL AS cited,
  CASE WHEN rrf_score >= 0.03 THEN row_number() OVER (PARTITION BY question_id, rrf_score >= 0.03 ORDER BY rrf_score DESC, row_id) - 1 END AS dense_rank FROM scored_text_unit WHERE question_id IS NOT NULL AND rrf_score IS NOT NULL)"""


@query(f"WITH {_UNITS}, {_allocate('units')} FROM alloc")
def capped_allocation(spark, sf_dir):
    return retrieval.capped_allocation(_units(spark, sf_dir))


def _units(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "scored_text_unit").where("question_id is not null and rrf_score is not null")
    near = F.col("rrf_score") >= 0.03
    rank = F.row_number().over(Window.partitionBy("question_id", near).orderBy(F.desc("rrf_score"), "row_id")) - 1
    return s.select(
        F.col("question_id").alias("q"), F.col("row_id").alias("item"), F.lower(F.trim("norm_id")).alias("norm"), "tier", F.col("rrf_score").alias("score"),
        F.col("jurisdiction").isNull().alias("cited"), F.when(near, rank).alias("dense_rank"), "text_unit_id",
    )


_PRUNED = f"""WITH {_UNITS}, {_allocate('units')}, texts AS (SELECT a.q, a.item, a.score, a.rank, t.text, greatest(1, floor(length(coalesce(t.text, '')) / 3.5)::int) AS tokens
  FROM alloc a JOIN scored_text_unit s ON s.row_id = a.item JOIN text_unit t ON t.id = s.text_unit_id),
pruned AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY q ORDER BY score DESC, item ROWS UNBOUNDED PRECEDING) AS used FROM texts) WHERE used <= 1000)"""


def _pruned(spark, sf_dir) -> DataFrame:
    """Late materialisation: texts are joined to what the allocation left."""
    kept = retrieval.capped_allocation(_units(spark, sf_dir))
    ids = table(spark, sf_dir, "scored_text_unit").select(F.col("row_id").alias("item"), "text_unit_id")
    t = table(spark, sf_dir, "text_unit").select(F.col("id").alias("text_unit_id"), "text")
    return retrieval.budget_prune(kept.join(ids, "item").join(t, "text_unit_id"), 1000)


@query(_PRUNED + " SELECT q, item, tokens, used::bigint AS used FROM pruned")
def budget_prune(spark, sf_dir):
    return _pruned(spark, sf_dir).select("q", "item", "tokens", "used")


@query(_PRUNED + """ SELECT q, md5(string_agg('--- unit ' || item || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM pruned GROUP BY 1""")
def contexts(spark, sf_dir):
    u = _pruned(spark, sf_dir).withColumn("label", F.concat(F.lit("unit "), F.col("item").cast("string")))
    return retrieval.assemble_context(u).select("q", F.md5("context").alias("context_md5"))


@query(f"""WITH RECURSIVE {_UNITS}, {_allocate('units')}, texts AS (SELECT a.q, a.item, a.rank = 1 AS gold, a.score, greatest(1, floor(length(coalesce(t.text, '')) / 3.5)::int) AS tokens
  FROM alloc a JOIN scored_text_unit s ON s.row_id = a.item JOIN text_unit t ON t.id = s.text_unit_id),
line AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY NOT gold, -score, item) AS pos FROM texts),
fold(q, pos, used, item, tokens, kept) AS (SELECT q, 0, 0, 0, 0, false FROM (SELECT DISTINCT q FROM line) UNION ALL
  SELECT l.q, l.pos, f.used + CASE WHEN l.gold OR f.used + l.tokens <= 1000 THEN l.tokens ELSE 0 END, l.item, l.tokens, l.gold OR f.used + l.tokens <= 1000 FROM fold f JOIN line l ON l.q = f.q AND l.pos = f.pos + 1)
SELECT q, item, tokens FROM fold WHERE kept""")
def greedy_pack(spark, sf_dir):
    kept = retrieval.capped_allocation(_units(spark, sf_dir))
    ids = table(spark, sf_dir, "scored_text_unit").select(F.col("row_id").alias("item"), "text_unit_id")
    t = table(spark, sf_dir, "text_unit").select(F.col("id").alias("text_unit_id"), "text")
    return retrieval.first_fit(kept.join(ids, "item").join(t, "text_unit_id").withColumn("gold", F.col("rank") == 1), 1000)


@query("""WITH d AS (SELECT id, any_value(gap_type) AS gap_type, coalesce(any_value(theme), '-') AS theme, any_value(difficulty) AS difficulty FROM eval_question GROUP BY id),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gap_type ORDER BY id) AS rn FROM d) WHERE rn = 1),
b AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d.gap_type ORDER BY (d.theme = a.theme)::int, (d.difficulty = a.difficulty)::int, d.id) AS rn FROM d JOIN a ON d.gap_type = a.gap_type AND d.id <> a.id) WHERE rn = 1),
c AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d.gap_type ORDER BY (d.theme = a.theme)::int + (d.theme = b.theme)::int, (d.difficulty = a.difficulty)::int + (d.difficulty = b.difficulty)::int, d.id) AS rn
  FROM d JOIN a ON d.gap_type = a.gap_type AND d.id <> a.id JOIN b ON d.gap_type = b.gap_type AND d.id <> b.id) WHERE rn = 1)
SELECT id, gap_type, theme, difficulty, 1 AS pick FROM a UNION ALL SELECT id, gap_type, theme, difficulty, 2 FROM b UNION ALL SELECT id, gap_type, theme, difficulty, 3 FROM c""")
def greedy_diverse(spark, sf_dir):
    q = table(spark, sf_dir, "eval_question").dropDuplicates(["id"]).select("id", "gap_type", F.coalesce("theme", F.lit("-")).alias("theme"), "difficulty")
    return retrieval.greedy_diverse(q, "gap_type", "id", "theme", "difficulty", 3)


@query(f"""WITH {_DENSE.format(k=10)}, truth AS (SELECT a.vec_id AS q, b.vec_id AS item FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0),
j AS (SELECT t.q, d.rank FROM truth t LEFT JOIN dense d USING (q, item))
SELECT q, count(*) FILTER (rank <= 1) / count(*) AS recall_1, count(*) FILTER (rank <= 5) / count(*) AS recall_5, count(*) FILTER (rank <= 10) / count(*) AS recall_10, coalesce(1 / min(rank), 0.0) AS mrr FROM j GROUP BY 1""")
def recall_mrr(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    truth = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "label").join(e.select(F.col("vec_id").alias("item"), "label"), "label")
    return ranking_metrics(_dense(spark, sf_dir, 10), truth)


@query(_FUSED + f""", cand AS (SELECT q, item, norm, tier, score, dr0 AS dense_rank, false AS cited FROM fused), {_allocate('cand')},
sized AS (SELECT a.*, greatest(1, floor(length(coalesce(d.text, '')) / 3.5)::int) AS tokens FROM alloc a JOIN documents d ON d.doc_id = a.item)
SELECT q, item, norm, score, rank, used::bigint AS used FROM (SELECT *, sum(tokens) OVER (PARTITION BY q ORDER BY score DESC, item ROWS UNBOUNDED PRECEDING) AS used FROM sized) WHERE used <= 6000""")
def hybrid_retrieval(spark, sf_dir):
    kept = retrieval.capped_allocation(_fused(spark, sf_dir).withColumn("cited", F.lit(False)))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text")
    return retrieval.budget_prune(kept.join(texts, "item")).select("q", "item", "norm", "score", "rank", "used")


@query("SELECT vec_id, embedding[1]::double AS first, vec_id % 4 + 1 AS tier, 'text_unit' AS content_type FROM embeddings")
def payload_projection(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first"), (F.col("vec_id") % 4 + 1).alias("tier"), F.lit("text_unit").alias("content_type"))


@query("SELECT question_id, norm_id, count(*) AS n FROM scored_text_unit WHERE starts_with(norm_id, 'luat-') AND tier IN (1, 2) AND theme = 'dat-dai' GROUP BY ALL")
def payload_filters(spark, sf_dir):
    s = table(spark, sf_dir, "scored_text_unit").where(F.col("norm_id").startswith("luat-") & F.col("tier").isin(1, 2) & (F.col("theme") == "dat-dai"))
    return s.groupBy("question_id", "norm_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT id, CASE WHEN length(trim(s)) = 0 THEN question ELSE s END AS dense_text FROM (SELECT DISTINCT id, question, regexp_replace(question, '(?i) (tại|ở) (TP\.?HCM|Đồng Nai)', '', 'g') AS s FROM eval_question)")
def dense_text(spark, sf_dir):
    s = F.regexp_replace("question", r"(?iu) (tại|ở) (TP\.?HCM|Đồng Nai)", "")
    return table(spark, sf_dir, "eval_question").select("id", F.when(F.length(F.trim(s)) == 0, F.col("question")).otherwise(s).alias("dense_text")).distinct()


