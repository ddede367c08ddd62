"""Queries of question plans, verdicts on citations, labels and small text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import citations, mentions, text
from quern.operators import graph, graph_build, metrics, question_plans, retrieval, stats, validate
from quern.plans.data_queries import _CURRENT
from quern.plans.eval_queries import ORACLE as EVAL_ORACLE
from quern.plans.eval_queries import QUERIES as EVAL_QUERIES
from quern.plans.graph_queries import _LINKS, _MAPS, _SEEDS, _concepts, _edges
from quern.plans.text_queries import norms
from quern.session import cut, spread
from quern.sources import documents, sinks
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


# --- question plans


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "eval_question").groupBy("id").agg(*[F.min(c).alias(c) for c in ("question", "theme", "jurisdiction", "gap_type", "difficulty")])


_ASKED = "asked AS (SELECT id, min(question) AS question, min(theme) AS theme, min(jurisdiction) AS jurisdiction, min(gap_type) AS gap_type, min(difficulty) AS difficulty FROM eval_question GROUP BY id)"


@query(f"""WITH {_ASKED}, y AS (SELECT *, nullif(regexp_extract(question, '(\\d{{4}})', 1), '') AS year FROM asked)
SELECT id, CASE WHEN theme IN ('dat-dai', 'ho-tich', 'nuoi-con-nuoi') THEN theme END AS theme,
  coalesce(CASE WHEN jurisdiction IN ('toan-quoc', 'tp-hcm', 'dong-nai', 'multi-juris') AND jurisdiction <> 'toan-quoc' THEN jurisdiction END, CASE WHEN theme IN ('ho-tich', 'nuoi-con-nuoi') THEN 'toan-quoc' END, 'tp-hcm') AS jurisdiction,
  CASE WHEN gap_type = 'gap3' THEN 'irac' ELSE 'general' END AS response_mode, CASE WHEN year IS NOT NULL AND gap_type IS DISTINCT FROM 'gap4' THEN year || '-12-31' END AS temporal FROM y""")
def settled_plans(spark, sf_dir):
    """Planner's answers, written as a model would give them from what is known of the questions, settled into plans."""
    a = _asked(spark, sf_dir)
    year = F.nullif(F.regexp_extract("question", r"(\d{4})", 1), F.lit(""))
    status = F.when(F.col("gap_type") == "gap4", F.lit("do-dang")).otherwise(F.lit("hoan-tat"))
    intent = F.struct(year.isNotNull().alias("has_temporal_context"), year.alias("temporal_anchor"), status.alias("case_status"))
    mode = F.when(F.col("gap_type") == "gap3", "irac").otherwise("free")
    place = F.when(F.col("jurisdiction") != "toan-quoc", F.col("jurisdiction"))
    raw = F.concat(F.lit("Đây:\n```json\n"), F.to_json(F.struct("theme", place.alias("jurisdiction"), mode.alias("response_mode"), intent.alias("temporal_intent"))), F.lit("\n```"))
    p = question_plans.settled_plan(raw, "tp-hcm")
    return a.select("id", p.alias("p")).select("id", "p.theme", "p.jurisdiction", "p.response_mode", "p.temporal")


_NUMBER_TOKEN = "(^|[^\\p{L}\\p{N}_])(\\d{1,4}/\\d{4}/(?:nđ-cp|nd-cp|nq-hđnd|nq-hdnd|qđ-ubnd|qd-ubnd|qh\\d+|tt-[a-zđ-]+))"
_PLAIN = "replace(strip_accents(lower({c})), 'đ', 'd')"


@query(f"""WITH {_CURRENT}, d AS (SELECT result_id AS key, answer AS text FROM eval_result WHERE answer IS NOT NULL),
refs AS (SELECT DISTINCT key, unnest(list_concat([{_PLAIN.format(c='x')} FOR x IN regexp_extract_all(text, '{_NUMBER_TOKEN}', 2, 'i')], regexp_extract_all(text, '(^|[^\\p{{L}}\\p{{N}}_])((?:luat|nghi-dinh|thong-tu|quyet-dinh|nghi-quyet)-[a-z0-9-]+)', 2))) AS ref FROM d),
known AS (SELECT theme, key AS ref FROM cur WHERE theme IN ('dat-dai', 'ho-tich', 'nuoi-con-nuoi') UNION SELECT theme, {_PLAIN.format(c="regexp_extract(title, '(^|[^\\p{L}\\p{N}_])(\\d{1,4}/\\d{4}/[A-Za-zĐđ]{2,}\\d*(?:-[A-Za-zĐđ]+)*)', 2)")} FROM cur WHERE theme IN ('dat-dai', 'ho-tich', 'nuoi-con-nuoi')),
f AS (SELECT DISTINCT key, theme FROM refs JOIN known USING (ref) WHERE ref <> '')
SELECT key AS result_id, min(theme) AS theme FROM f GROUP BY key HAVING count(*) = 1""")
def themes_from_references(spark, sf_dir):
    """The theme an answer's document numbers and identifiers point to, where it is one."""
    d = spread(table(spark, sf_dir, "eval_result").select(F.col("result_id").alias("key"), F.col("answer").alias("text")))
    n = norms(spark, sf_dir).select(F.col("key").alias("id"), "title", "theme")
    return question_plans.theme_from_references(d, n).withColumnRenamed("key", "result_id")


_RELATIONS = {name: question_plans.ABLATIONS[name].relations for name in sorted(question_plans.ABLATIONS)}
_KINDS = sorted({tuple(r) for r in _RELATIONS.values()})


def _walk_sql(i: int, rels: tuple[str, ...]) -> str:
    among = ", ".join(f"'{r}'" for r in rels) or "''"
    return f"""b{i} AS (SELECT src AS a, dst AS b FROM edges WHERE rel IN ({among}) UNION SELECT dst, src FROM edges WHERE rel IN ({among})),
w{i}(q, node, hop) AS (SELECT q, node, 0 FROM seeds UNION SELECT w.q, e.b, w.hop + 1 FROM w{i} w JOIN b{i} e ON w.node = e.a WHERE w.hop < 2), n{i} AS (SELECT count(DISTINCT (q, node)) AS n FROM w{i})"""


@query(f"WITH RECURSIVE {_LINKS}, {_SEEDS}, " + ", ".join(_walk_sql(i, r) for i, r in enumerate(_KINDS)) + " " + " UNION ALL ".join(
    f"SELECT '{name}' AS ablation, '{','.join(rels)}' AS relations, (SELECT n FROM n{_KINDS.index(tuple(rels))}) AS n_reached" for name, rels in _RELATIONS.items()))
def ablation_reach(spark, sf_dir):
    """What each named variant of the plan reaches in two hops, over the relations it walks."""
    s = table(spark, sf_dir, "scored_text_unit").where("question_id is not null and norm_id is not null and rrf_score is not null")
    seeds = s.groupBy(F.col("question_id").alias("q")).agg(F.lower(F.trim(F.max_by("norm_id", F.struct("rrf_score", "row_id")))).alias("node"))
    edges = graph.gated_edges(*_edges(spark, sf_dir))
    out = None
    for rels in _KINDS:
        n = graph.closure(seeds, edges, 2, list(rels)).agg(F.count(F.lit(1)).alias("n_reached"))
        names = F.array(*[F.lit(k) for k, r in _RELATIONS.items() if tuple(r) == rels])
        part = n.select(F.explode(names).alias("ablation"), F.lit(",".join(rels)).alias("relations"), "n_reached")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT sample_id, greatest(1, floor(length(coalesce(context, '')) / 3.5)::int) AS tokens FROM train_sample WHERE greatest(1, floor(length(coalesce(context, '')) / 3.5)::int) + 100 > 200")
def prompts_over_budget(spark, sf_dir):
    s = table(spark, sf_dir, "train_sample").select("sample_id", text.estimate_tokens(F.col("context")).alias("tokens"))
    return question_plans.over_budget(s, "tokens", 100, 200)


_STOP = ("của", "các", "cho", "được", "không", "trong", "theo")
_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '\\p{{L}}+'), lambda w: length(w) >= 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in _STOP) + ")))"


@query(f"WITH {_ASKED} SELECT id, array_to_string(list_sort({_CONTENT.format(c='question')}), ' ') AS tokens FROM asked")
def question_tokens(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", F.array_join(F.sort_array(text.content_tokens(F.col("question"), list(_STOP))), " ").alias("tokens"))


@query(f"""WITH {_ASKED}, q AS (SELECT id AS q, unnest({_CONTENT.format(c='question')}) AS t FROM asked),
l AS (SELECT id AS item, lower(trim(norm_id)) AS norm, unnest({_CONTENT.format(c="array_to_string(context_path[2:], ' ')")}) AS t FROM text_unit),
h AS (SELECT q, item, norm, count(*) AS overlap FROM q JOIN l USING (t) GROUP BY ALL HAVING count(*) >= 2)
SELECT q, item, norm, overlap FROM (SELECT *, row_number() OVER (PARTITION BY q, norm ORDER BY -overlap, item) AS rn FROM h) WHERE rn <= 3""")
def label_candidates(spark, sf_dir):
    tokens = lambda c: text.content_tokens(c, list(_STOP))
    q = _asked(spark, sf_dir).select(F.col("id").alias("q"), tokens(F.col("question")).alias("tokens"))
    path = F.col("context_path")
    u = table(spark, sf_dir, "text_unit").select(F.col("id").alias("item"), F.lower(F.trim("norm_id")).alias("norm"), tokens(F.array_join(F.slice(path, F.lit(2), F.greatest(F.size(path), F.lit(1))), " ")).alias("tokens"))
    return question_plans.label_candidates(q, u)


# --- citations in contexts

_LABELS = r"""u AS (SELECT DISTINCT question_id AS q, text_unit_id AS id, max(rrf_score) OVER (PARTITION BY question_id, text_unit_id) AS score FROM scored_text_unit WHERE question_id IS NOT NULL AND rrf_score IS NOT NULL),
t AS (SELECT u.q, u.id, u.score, x.context_path AS p, x.text, row_number() OVER (PARTITION BY u.q ORDER BY u.score DESC, u.id) AS rank FROM u JOIN text_unit x USING (id)),
b AS (SELECT q, rank, lower(array_to_string(p[2:], ', ') || ' (' || p[1] || ')') AS label, text FROM t WHERE rank <= 25),
ctx AS (SELECT q, list(label ORDER BY rank) AS labels FROM b GROUP BY q)"""
_HAS = "contains(translate(l, '.,(', '   ') || ' ', '{word} ' || lower({v}) || ' ')"
_CITED = f"contains(l, lower(c.van_ban)) AND {_HAS.format(word='điều', v='c.dieu')} AND (c.khoan IS NULL OR {_HAS.format(word='khoản', v='c.khoan')})"


def _contexts(spark, sf_dir) -> DataFrame:
    """The best 25 units of each question as a context text, labelled by place and document: ``q, context``."""
    s = table(spark, sf_dir, "scored_text_unit").where("question_id is not null and rrf_score is not null")
    u = s.groupBy(F.col("question_id").alias("q"), F.col("text_unit_id").alias("item")).agg(F.max("rrf_score").alias("score"))
    texts = table(spark, sf_dir, "text_unit").select(F.col("id").alias("item"), "context_path", "text")
    best = retrieval.top_k(u.join(texts.select("item"), "item", "left_semi"), 25).join(texts, "item")
    none = F.lit(None)
    labelled = best.withColumn("label", citations.citation_label(F.col("context_path"), none.cast("int"), none.cast("string"), none.cast("string")))
    return retrieval.assemble_context(labelled)


def _cites(spark, sf_dir) -> DataFrame:
    r = spread(table(spark, sf_dir, "eval_result").select("result_id", F.col("id").alias("q"), "pred_citations", F.col("gap_type")))
    blocks = cut(_contexts(spark, sf_dir).select("q", citations.context_blocks(F.col("context")).alias("blocks")))
    return r.join(blocks, "q").select("result_id", "gap_type", "blocks", F.posexplode("pred_citations").alias("pos", "c"))


@query(f"""WITH {_LABELS}, r AS (SELECT result_id, id AS q, unnest(pred_citations) AS c, unnest(range(0, len(pred_citations))) AS pos FROM eval_result),
v AS (SELECT result_id, pos, coalesce(len(list_filter(labels, lambda l: {_CITED})) > 0, false) AS grounded, c.diem IS NULL AS supported FROM r JOIN ctx USING (q))
SELECT result_id, pos::int AS pos, CASE WHEN NOT grounded THEN 'drop' WHEN NOT supported THEN 'flag' ELSE 'keep' END AS verdict FROM v""")
def citation_verdicts(spark, sf_dir):
    """Predicted citations against the question's context; points count as unsupported here, in place of a judge."""
    c = _cites(spark, sf_dir)
    return c.select("result_id", "pos", metrics.verdict(citations.cited_in_blocks(F.col("c"), F.col("blocks")), F.col("c.diem").isNull()).alias("verdict"))


@query(f"""WITH {_LABELS}, two AS (SELECT q, list({{'l': label, 't': text}} ORDER BY rank) AS blocks FROM b GROUP BY q), r AS (SELECT result_id, id AS q, unnest(pred_citations) AS c, unnest(range(0, len(pred_citations))) AS pos FROM eval_result),
f AS (SELECT result_id, pos, c, list_filter(blocks, lambda x: {_CITED.replace('(l,', '(x.l,').replace('translate(l', 'translate(x.l').replace('c.dieu', 'c.dieu')}) AS loose FROM r JOIN two USING (q)),
g AS (SELECT *, list_filter(loose, lambda x: c.diem IS NULL OR {_HAS.format(word='điểm', v='c.diem').replace('translate(l', 'translate(x.l')}) AS strict FROM f)
SELECT result_id, pos::int AS pos, md5(coalesce(strict[1], loose[1]).l || '|' || trim(coalesce(strict[1], loose[1]).t, ' ' || chr(9) || chr(10) || chr(13))) AS block_md5 FROM g WHERE len(loose) > 0""")
def citation_chunks(spark, sf_dir):
    """The block of the context each predicted citation points to."""
    c = _cites(spark, sf_dir).withColumn("b", mentions.chunk_in_blocks(F.col("c"), F.col("blocks"))).where("b is not null")
    return c.select("result_id", "pos", F.md5(F.concat(F.lower("b.label"), F.lit("|"), F.col("b.body"))).alias("block_md5"))


@query("""WITH c AS (SELECT result_id, unnest(pred_citations) AS c, unnest(range(0, len(pred_citations))) AS pos FROM eval_result)
SELECT result_id, pos::int AS pos, '[' || concat_ws(', ', CASE WHEN c.loai = 'phu_luc' THEN CASE WHEN c.dieu = '_default' THEN 'Phụ lục' ELSE 'Phụ lục ' || c.dieu END ELSE 'Điều ' || c.dieu END,
  'Khoản ' || c.khoan, 'Điểm ' || c.diem, 'Tiết ' || c.tiet, 'Văn bản ' || c.van_ban) || ']' AS shown FROM c WHERE c.dieu IS NOT NULL AND c.loai IS NOT NULL""")
def formatted_citations(spark, sf_dir):
    c = table(spark, sf_dir, "eval_result").select("result_id", F.posexplode("pred_citations").alias("pos", "c")).where("c.dieu is not null and c.loai is not null")
    return c.select("result_id", "pos", citations.format_citation(F.col("c")).alias("shown"))


@query("""WITH p AS (SELECT result_id, [CASE WHEN len(g) = 0 THEN NULL END] AS none, coalesce(pred_citations, []) AS p, ground_truth_citations AS g FROM eval_result WHERE len(ground_truth_citations) > 0),
k AS (SELECT result_id, [{'v': nullif(lower(trim(c.van_ban)), ''), 'd': nullif(lower(trim(c.dieu)), ''), 'k': nullif(lower(trim(c.khoan)), '')} FOR c IN p] AS p, [{'v': nullif(lower(trim(c.van_ban)), ''), 'd': nullif(lower(trim(c.dieu)), ''), 'k': nullif(lower(trim(c.khoan)), '')} FOR c IN g] AS g FROM p),
e AS (SELECT result_id, len(g) AS n, unnest(g) AS t, p FROM k),
s AS (SELECT result_id, n, CASE WHEN len(list_filter(p, lambda x: x.v IS NOT DISTINCT FROM t.v AND x.d IS NOT DISTINCT FROM t.d AND (t.k IS NULL OR x.k IS NOT DISTINCT FROM t.k))) > 0 THEN 1.0
  WHEN len(list_filter(p, lambda x: x.v IS NOT DISTINCT FROM t.v AND x.d IS NOT DISTINCT FROM t.d)) > 0 THEN 0.6 WHEN len(list_filter(p, lambda x: x.v IS NOT DISTINCT FROM t.v)) > 0 THEN 0.3 ELSE 0.0 END::double AS credit FROM e)
SELECT result_id, round(sum(credit) / any_value(n), 6) AS credit FROM s GROUP BY result_id""".replace("[CASE WHEN len(g) = 0 THEN NULL END] AS none, ", ""))
def partial_credits(spark, sf_dir):
    empty = F.array().cast("array<struct<dieu:string,khoan:string,diem:string,tiet:string,van_ban:string,loai:string>>")
    r = spread(table(spark, sf_dir, "eval_result").where(F.size("ground_truth_citations") > 0).select("result_id", F.coalesce("pred_citations", empty).alias("p"), F.col("ground_truth_citations").alias("g")))
    return r.select("result_id", F.round(metrics.partial_credit(F.col("p"), F.col("g")), 6).alias("credit"))


@query("""WITH x AS (SELECT result_id, list_distinct(list_filter([lower(trim(c.van_ban)) FOR c IN pred_citations], lambda v: v <> '')) AS p, list_distinct(list_filter([lower(trim(c.van_ban)) FOR c IN ground_truth_citations], lambda v: v <> '')) AS g FROM eval_result WHERE pred_citations IS NOT NULL AND ground_truth_citations IS NOT NULL)
SELECT result_id, len(list_filter(p, lambda v: NOT list_contains(g, v))) = 0 AS is_subset FROM x""")
def cited_subsets(spark, sf_dir):
    """Whether all documents a result cites are among those of its ground truth."""
    r = table(spark, sf_dir, "eval_result").where("pred_citations is not null and ground_truth_citations is not null")
    return r.select("result_id", (F.size(F.array_except(metrics.norms_of(F.col("pred_citations")), metrics.norms_of(F.col("ground_truth_citations")))) == 0).alias("is_subset"))


# --- small text functions


@query("""WITH a AS (SELECT result_id, answer, strpos(answer, 'Điều') AS at FROM eval_result WHERE answer IS NOT NULL)
SELECT result_id, md5(CASE WHEN at > 0 THEN substr(answer, greatest(at - 200, 1), at - greatest(at - 200, 1) + 54) ELSE substr(answer, 1, 400) END) AS snippet_md5 FROM a""".replace(" at ", " spot ").replace("AS at FROM", "AS spot FROM").replace("(at ", "(spot "))
def answer_snippets(spark, sf_dir):
    a = table(spark, sf_dir, "eval_result").where("answer is not null")
    return a.select("result_id", F.md5(text.snippet(F.col("answer"), F.lit("Điều"))).alias("snippet_md5"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5, CASE WHEN length(title) > 20 THEN rtrim(substr(title, 1, 19)) || '…' ELSE title END AS short_title,
  replace(format('{:,}', n_chars), ',', '.') AS shown_chars, CASE WHEN substr(title, 1, 1) = upper(substr(title, 1, 1)) THEN lower(substr(title, 1, 1)) ELSE upper(substr(title, 1, 1)) END || substr(title, 2) AS flipped FROM documents""")
def shown_documents(spark, sf_dir):
    """How documents are shown in reports: escaped, cut, with dots between thousands, the first letter turned."""
    d, t = table(spark, sf_dir, "documents"), F.col("title")
    return d.select("doc_id", F.md5(text.html_escape(F.col("text"))).alias("escaped_md5"), text.truncate_text(t, 20).alias("short_title"), text.thousands(F.col("n_chars")).alias("shown_chars"), text.flip_first(t).alias("flipped"))


@query("""SELECT result_id, trim(coalesce(answer, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' AS no_answer, coalesce(system, '') AS pham_vi, trim(coalesce(id, '')) AS canh_bao_lex FROM eval_result""")
def answer_parts(spark, sf_dir):
    """Answers put under the three headings of a structured answer, in another order, and taken apart again."""
    line = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    body = F.regexp_replace(F.coalesce("answer", F.lit("")), "(?m)^##", "#")
    whole = F.concat(F.lit("## PHẠM VI\n"), line("system"), F.lit("\n## CẢNH BÁO LEX\n"), line("id"), F.lit("\n## TRẢ LỜI\n"), body, F.lit("\n"))
    p = citations.answer_sections(whole)
    r = spread(table(spark, sf_dir, "eval_result").select("result_id", "system", "id", "answer"))
    return r.select("result_id", p.alias("p")).select("result_id", (F.col("p.tra_loi") == "").alias("no_answer"), "p.pham_vi", "p.canh_bao_lex")


@query("""SELECT t.id, (u.i - 1)::int AS pos, trim(a.amending_norm) AS amending_norm, trim(a.amending_loc) AS amending_loc, a.effective_date AS effective_date, trim(a.content_summary) AS content_summary
FROM text_unit t, unnest(range(1, len(amendments) + 1)) AS u(i), LATERAL (SELECT t.amendments[u.i] AS a)
WHERE a.amending_norm IS NOT NULL AND a.amending_loc IS NOT NULL AND regexp_matches(a.effective_date, '^\\d{4}-\\d{2}-\\d{2}$') AND length(trim(a.content_summary)) > 0 AND NOT contains(a.amending_loc, ',')""")
def annotated_amendments(spark, sf_dir):
    """Amendments written into texts as annotations and read from there again."""
    a = F.col("a")
    sound = a["amending_norm"].isNotNull() & a["amending_loc"].isNotNull() & a["effective_date"].rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.length(F.trim(a["content_summary"])) > 0) & ~F.contains(a["amending_loc"], F.lit(","))
    e = table(spark, sf_dir, "text_unit").select("id", F.posexplode("amendments").alias("pos", "a")).where(sound)
    dmy = F.concat_ws("/", F.substring(a["effective_date"], 9, 2), F.substring(a["effective_date"], 6, 2), F.substring(a["effective_date"], 1, 4))
    note = F.concat(F.lit("x <!-- amended_by: "), a["amending_norm"], F.lit(", "), a["amending_loc"], F.lit(", hiệu lực: "), dmy, F.lit(", nội dung: "), a["content_summary"], F.lit(" --> y"))
    return e.select("id", "pos", F.explode(documents.amendments(note)).alias("b")).select("id", "pos", "b.amending_norm", "b.amending_loc", "b.effective_date", "b.content_summary")


@query("""SELECT id, original_version.date_label AS date_label, md5(trim(original_version.text)) AS text_md5 FROM text_unit WHERE regexp_matches(original_version.date_label, '^\\d{4}-\\d{2}-\\d{2}$') AND length(trim(original_version.text)) > 0""")
def annotated_originals(spark, sf_dir):
    """Original versions written into texts as annotations and read from there again."""
    o = F.col("original_version")
    u = table(spark, sf_dir, "text_unit").where(o["date_label"].rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.length(F.trim(o["text"])) > 0))
    v = documents.original_version(F.concat(F.lit("x <!-- original_v_"), o["date_label"], F.lit(": "), F.trim(o["text"]), F.lit(" --> y")))
    return u.select("id", v.alias("v")).select("id", "v.date_label", F.md5("v.text").alias("text_md5"))


@query("""WITH l AS (SELECT result_id AS doc, unnest(string_split(answer, chr(10))) AS line, unnest(range(0, len(string_split(answer, chr(10))))) AS pos FROM eval_result WHERE answer IS NOT NULL),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc ORDER BY pos) AS next FROM l) SELECT doc, pos::int AS pos FROM n WHERE starts_with(line, '#') AND length(trim(next, ' ')) > 0""")
def heading_spacing(spark, sf_dir):
    d = spread(table(spark, sf_dir, "eval_result").select("result_id", "answer"))
    return validate.spacing_problems(d.select(F.col("result_id").alias("doc"), F.posexplode(F.split("answer", "\n")).alias("pos", "line")))


_LINES = r"""l AS (SELECT result_id AS norm_id, unnest(x) AS raw, unnest(range(0, len(x)))::int AS pos FROM (SELECT result_id, string_split(regexp_replace(answer, '(?s)<!--.*?-->', '', 'g'), chr(10)) AS x FROM eval_result WHERE answer IS NOT NULL)),
m AS (SELECT norm_id, pos, trim(raw, ' ') AS line, length(regexp_extract(raw, '^(#+) \S', 1)) AS n, trim(regexp_replace(raw, '^#+ ', ''), ' ') AS head FROM l),
k AS (SELECT *, max(n > 0) OVER (PARTITION BY norm_id ORDER BY pos) AS seen FROM m)"""


@query(rf"""WITH {_LINES} SELECT * FROM (SELECT norm_id, pos, CASE WHEN n = 1 OR n > 5 THEN 'level' WHEN n = 2 AND NOT regexp_matches(head, '^(Điều|Phụ lục)([^\p{{L}}\p{{N}}_]|$)') OR n = 3 AND NOT regexp_matches(head, '^Khoản([^\p{{L}}\p{{N}}_]|$)')
  OR n = 4 AND NOT regexp_matches(head, '^Điểm([^\p{{L}}\p{{N}}_]|$)') OR n = 5 AND NOT regexp_matches(head, '^Tiết([^\p{{L}}\p{{N}}_]|$)') THEN 'kind' WHEN n = 0 AND line <> '' AND NOT seen THEN 'text before a heading' END AS problem FROM k) WHERE problem IS NOT NULL""")
def heading_problems(spark, sf_dir):
    """What a strict parser of documents objects to in answers."""
    return documents.heading_problems(spread(table(spark, sf_dir, "eval_result").select("result_id", "answer")), "result_id", "answer")


@query(f"""WITH {_LINES}, f AS (SELECT *, last_value(CASE WHEN n BETWEEN 2 AND 5 THEN pos END IGNORE NULLS) OVER w AS at_pos,
  {', '.join(f"last_value(CASE WHEN n = {n} THEN pos END IGNORE NULLS) OVER w AS p{n}, last_value(CASE WHEN n = {n} THEN head END IGNORE NULLS) OVER w AS h{n}" for n in range(2, 6))} FROM k WINDOW w AS (PARTITION BY norm_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
t AS (SELECT norm_id, pos, coalesce(at_pos, -1) AS ord, line, list_filter([norm_id::varchar, h2, CASE WHEN p3 > coalesce(p2, -1) THEN h3 END, CASE WHEN p4 > greatest(coalesce(p2, -1), coalesce(p3, -1)) THEN h4 END,
  CASE WHEN p5 > greatest(coalesce(p2, -1), coalesce(p3, -1), coalesce(p4, -1)) THEN h5 END], lambda x: x IS NOT NULL) AS path FROM f WHERE NOT n BETWEEN 2 AND 5 AND line <> '')
SELECT norm_id, ord, substr(sha256(array_to_string(any_value(path), '>')), 1, 16) AS unit_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM t GROUP BY norm_id, ord""")
def lenient_units(spark, sf_dir):
    """Leaf units of answers as documents, headings of any kind kept."""
    r = spread(table(spark, sf_dir, "eval_result").select(F.col("result_id").cast("string").alias("norm_id"), F.col("answer").alias("body")))
    return documents.leaf_units(r, strict=False).select(F.col("norm_id").cast("bigint").alias("norm_id"), "ord", "unit_id", F.md5("text").alias("text_md5"))


# --- caches, samples, labels


@query(f"WITH {_ASKED} SELECT id, substr(sha256(difficulty || '|' || question), 1, 16) AS key FROM asked WHERE difficulty IS NOT NULL")
def call_keys(spark, sf_dir):
    return _asked(spark, sf_dir).where("difficulty is not null").select("id", sinks.cache_key(F.col("difficulty"), F.col("question")).alias("key"))


@query("""WITH c AS (SELECT DISTINCT component_id FROM text_unit), done AS (SELECT DISTINCT component_id FROM scored_text_unit WHERE tier = 1) SELECT component_id FROM c WHERE component_id IS NOT NULL AND component_id NOT IN (SELECT component_id FROM done WHERE component_id IS NOT NULL)""")
def unmapped_components(spark, sf_dir):
    """What a resumed run has to do: components no unit of the first tier was retrieved for."""
    c = table(spark, sf_dir, "text_unit").where("component_id is not null").select("component_id").distinct()
    return sinks.unmapped(c, table(spark, sf_dir, "scored_text_unit").where("tier = 1"))


@query("""WITH l AS (SELECT id, system, max(result_id) AS result_id FROM eval_result WHERE id IS NOT NULL AND system IS NOT NULL GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('42|' || id || '|' || system), system) AS slot FROM l) SELECT id || '#' || slot AS iid, id, system, result_id, slot::int AS slot FROM s""")
def blinded_answers(spark, sf_dir):
    """The last answer of each system to each question, under names that don't tell the system."""
    l = table(spark, sf_dir, "eval_result").where("id is not null and system is not null").groupBy("id", "system").agg(F.max("result_id").alias("result_id"))
    return stats.blinded(l).select("iid", "id", "system", "result_id", "slot")


@query("SELECT doc_id, lower(trim(source)) AS source, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY n_chars DESC NULLS LAST, md5('42|' || doc_id), doc_id)::int AS place FROM documents")
def longest_first(spark, sf_dir):
    """Documents of each source from the longest, equal lengths in a shuffled, repeatable order."""
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), stats.hash_order("doc_id"), "doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), "n_chars")
    return d.select("doc_id", "source", F.row_number().over(w).alias("place"))


@query(f"SELECT *, CASE WHEN kappa IS NULL OR isnan(kappa) THEN 'n/a' WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS label FROM ({EVAL_ORACLE['pairwise_kappa']})")
def labelled_kappa(spark, sf_dir):
    k = EVAL_QUERIES["pairwise_kappa"](spark, sf_dir)
    return k.withColumn("label", stats.agreement_label(F.col("kappa")))


# --- streams and the whole graph


@query("""SELECT event_id, 'data: {"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' || chr(10) || chr(10) AS frame FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL""")
def event_frames(spark, sf_dir):
    e = table(spark, sf_dir, "events").dropna(subset=["event_id", "user_id", "event_type"])
    return traces.frames(e, "event_id", "user_id", "event_type").select("event_id", "frame")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
walk(user_id, event_id, pos, free, admitted) AS (SELECT user_id, event_id, pos, ts + INTERVAL 6 HOUR, true FROM e WHERE pos = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.pos, CASE WHEN e.ts >= w.free THEN e.ts + INTERVAL 6 HOUR ELSE w.free END, e.ts >= w.free FROM walk w JOIN e ON e.user_id = w.user_id AND e.pos = w.pos + 1)
SELECT user_id, event_id, admitted FROM walk UNION ALL SELECT user_id, event_id, false FROM events WHERE user_id IS NULL OR ts IS NULL""")
def single_flight(spark, sf_dir):
    """Events of each user, admitted if none was in the six hours before that was."""
    return traces.single_flight(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600)


_NODES = f"""{_LINKS}, {_MAPS},
u AS (SELECT id, ctv_id, component_id, lower(trim(norm_id)) AS norm FROM text_unit),
nodes AS (SELECT DISTINCT kind, id FROM (
  SELECT 'Norm' AS kind, key AS id FROM cur UNION ALL SELECT 'Theme', theme FROM cur UNION ALL SELECT 'Jurisdiction', jurisdiction FROM cur UNION ALL SELECT 'Component', component_id FROM u
  UNION ALL SELECT 'CTV', ctv_id FROM u UNION ALL SELECT 'TextUnit', id FROM u UNION ALL SELECT 'Concept', concept FROM maps UNION ALL SELECT 'Concept', concept FROM requires UNION ALL SELECT 'Procedure', procedure FROM requires) WHERE length(id) > 0)"""
_ALL_EDGES = """raw AS (SELECT rel, 'Norm' AS sk, src, 'Norm' AS dk, dst FROM links UNION ALL SELECT 'INCLUDES', 'Theme', theme, 'Norm', key FROM cur UNION ALL SELECT 'APPLIES_IN', 'Norm', key, 'Jurisdiction', jurisdiction FROM cur
  UNION ALL SELECT 'HAS_COMPONENT', 'Norm', norm, 'Component', component_id FROM u UNION ALL SELECT 'HAS_VERSION', 'Component', component_id, 'CTV', ctv_id FROM u UNION ALL SELECT 'HAS_TEXT', 'CTV', ctv_id, 'TextUnit', id FROM u
  UNION ALL SELECT 'MAPS_TO_CONCEPT', 'Component', component, 'Concept', concept FROM maps UNION ALL SELECT 'REQUIRES_CONCEPT', 'Procedure', procedure, 'Concept', concept FROM requires)"""


@query(f"WITH {_NODES} FROM nodes")
def graph_nodes(spark, sf_dir):
    return graph_build.nodes(*_graph_tables(spark, sf_dir))


@query(f"WITH {_NODES}, {_ALL_EDGES} SELECT DISTINCT rel, src, dst FROM raw r WHERE EXISTS (FROM nodes n WHERE n.kind = r.sk AND n.id = r.src) AND EXISTS (FROM nodes n WHERE n.kind = r.dk AND n.id = r.dst)")
def graph_edges(spark, sf_dir):
    tables = _graph_tables(spark, sf_dir)
    return graph_build.edges(graph_build.nodes(*tables), *tables)


def _graph_tables(spark, sf_dir):
    u = table(spark, sf_dir, "text_unit").select("id", "ctv_id", "component_id", F.lower(F.trim("norm_id")).alias("norm"))
    maps, requires = _concepts(spark, sf_dir)
    return norms(spark, sf_dir), u, maps, requires
