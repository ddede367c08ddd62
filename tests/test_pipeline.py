import datetime as dt
import math
import random
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quern import session
from quern.operators import graph_build, metrics, pipeline, question_plans, retrieval, stats
from quern.streaming import traces


def test_settled_plans(spark):
    raw = [
        ("national", '```json\n{"theme": "ho-tich", "jurisdiction": null}\n```'),
        ("forced", '{"theme": "dat-dai", "jurisdiction": "mars", "temporal": "2020"}'),
        ("open", '{"theme": "x", "jurisdiction": "dong-nai", "temporal_intent": {"has_temporal_context": true, "temporal_anchor": "2019", "case_status": "do-dang"}, "temporal": "2011"}'),
        ("done", '{"response_mode": "irac", "temporal_intent": {"has_temporal_context": true, "temporal_anchor": "2019-05", "case_status": "hoan-tat"}}'),
        ("vague", '{"temporal_intent": {"has_temporal_context": true, "temporal_anchor": "ngày xưa"}, "temporal": "2011"}'),
        ("broken", "no json"),
        ("null", None),
    ]
    df = spark.createDataFrame(raw, "k string, raw string").select("k", question_plans.settled_plan(F.col("raw"), "tp-hcm").alias("p"))
    got = {r.k: (r.theme, r.jurisdiction, r.response_mode, r.temporal) for r in df.select("k", "p.*").collect()}
    assert got == {
        "national": ("ho-tich", "toan-quoc", "general", None), "forced": ("dat-dai", "tp-hcm", "general", "2020-12-31"), "open": (None, "dong-nai", "general", None), "done": (None, "tp-hcm", "irac", "2019-05-15"),
        "vague": (None, "tp-hcm", "general", None), "broken": (None, "tp-hcm", "general", None), "null": (None, "tp-hcm", "general", None),
    }


def test_theme_from_references(spark):
    norms = spark.createDataFrame([("luat-a-2024", "Luật A số 1/2024/QH15", "dat-dai"), ("nd-b", "Nghị định 102/2024/NĐ-CP", "ho-tich"), ("luat-c", None, "dat-dai"), ("luat-d", "Luật D", None), (None, None, "dat-dai")], "id string, title string, theme string")
    texts = [(1, "theo luat-a-2024 và luat-c"), (2, "Nghị định 102/2024/nđ-cp."), (3, "luat-c, 102/2024/NĐ-CP"), (4, "không có"), (5, None), (6, ""), (7, "luat-d, xluat-c"), (8, "1/2024/QH15 (Luật A)")]
    got = rows(question_plans.theme_from_references(spark.createDataFrame(texts, "key int, text string"), norms))
    assert got == [(1, "dat-dai"), (2, "ho-tich"), (8, "dat-dai")]


def test_verdicts_and_blinded_answers(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (None, None), (True, None)], "g boolean, s boolean")
    v = df.select(metrics.verdict(F.col("g")).alias("a"), metrics.verdict(F.col("g"), F.col("s")).alias("b"), metrics.verdict(F.col("g"), F.col("s"), True).alias("c"))
    assert [tuple(r) for r in v.collect()] == [("keep", "keep", "keep"), ("keep", "flag", "drop"), ("drop", "drop", "drop"), ("drop", "drop", "drop"), ("keep", "keep", "keep")]
    answers = spark.createDataFrame([(f"Q{i}", s, "x") for i in range(60) for s in ("a", "b", "c")], "id string, system string, slot string").drop("slot")
    got = stats.blinded(answers).collect()
    assert len({r.iid for r in got}) == 180 and {r.slot for r in got} == {1, 2, 3} and all(r.iid == f"{r.id}#{r.slot}" for r in got)
    first = [r.system for r in got if r.slot == 1]
    assert all(8 < first.count(s) < 34 for s in "abc") and sorted(map(tuple, stats.blinded(answers).collect())) == sorted(map(tuple, got))
    assert stats.blinded(answers.limit(0)).count() == 0


def test_search_brings_in_boosted_and_cited_units(spark):
    within = spark.createDataFrame([("q", "n1"), ("q", "n2"), ("r", "n1")], "q string, norm string")
    units = spark.createDataFrame([(f"u{i}", f"n{i % 3}", f"c{i}", 1 + i % 4) for i in range(12)], "item string, norm string, component string, tier int")
    dense = spark.createDataFrame([("q", f"u{i}", 1.0 - i / 100) for i in range(8)] + [("r", "u1", 0.5)], "q string, item string, score double")
    none = spark.createDataFrame([], "q string, item string, score double")
    boosted = spark.createDataFrame([("q", "c11"), ("q", "c9"), ("q", "c11")], "q string, component string")
    cited = spark.createDataFrame([("q", "u10"), ("q", "u0")], "q string, item string")
    rarity = spark.createDataFrame([("p", "c4", 1.0), ("other", "c4", 0.5)], "procedure string, component string, rarity double")
    procedures = spark.createDataFrame([("q", "p"), ("r", None)], "q string, procedure string")
    got = pipeline.search(within, units, dense, none, boosted, cited, rarity, procedures).collect()
    q = {r.item: r for r in got if r.q == "q"}
    # u0, u3, u6, u9 are of a document that isn't searched; a document has three units at most, cited ones first, so u7 stays out
    assert set(q) == {"u1", "u2", "u4", "u5", "u10", "u11"} and {r.item for r in got if r.q == "r"} == {"u1"}
    assert max(q.values(), key=lambda r: r.score).item == "u11" and all(r.norm != "n0" for r in got)
    # u4 is third of the dense list of five, absent from the lexical one of none, of tier 1 and as rare as can be
    assert math.isclose(q["u4"].score, (1 / 62 + 1 / 60) * 1.1 * 2.5, abs_tol=1e-9)
    empty = pipeline.search(within.limit(0), units, dense, none, boosted, cited, rarity, procedures)
    assert empty.count() == 0


def test_searched_norms_and_ablations(spark):
    asked = spark.createDataFrame([("q", "tp-hcm", "2020-01-01"), ("r", None, None)], "q string, jurisdiction string, temporal string")
    seeds = spark.createDataFrame([("q", "a"), ("r", "a")], "q string, node string")
    edges = spark.createDataFrame([("a", "b", "IMPLEMENTS"), ("c", "a", "AMENDS"), ("b", "d", "IMPLEMENTS")], "src string, dst string, rel string")
    norms = spark.createDataFrame([("a", "toan-quoc", "2000-01-01", None), ("b", "dong-nai", "2000-01-01", None), ("c", "tp-hcm", "2021-01-01", None), ("d", "tp-hcm", "2000-01-01", "2030-01-01")], "norm string, jurisdiction string, valid_from string, valid_to string")
    of = lambda name, **k: rows(pipeline.searched_norms(asked, seeds, edges, norms, name, **k))
    assert of("full") == [("q", "a"), ("q", "d"), ("r", "a"), ("r", "b"), ("r", "c"), ("r", "d")]
    assert of("dense-only") == [("q", "a"), ("r", "a")] == of("no-traversal")
    assert ("q", "b") in of("no-jurisdiction") and ("q", "c") in of("no-temporal") and ("r", "c") not in of("no-amends") and ("r", "b") not in of("no-implements")


def test_graph_of_all_kinds(spark):
    norms = spark.createDataFrame([("n1", "t", "j", ["n2", None, "gone"], None), ("n2", None, "j", None, ["n1", ""])], "key string, theme string, jurisdiction string, implements array<string>, amended_by_norms array<string>")
    units = spark.createDataFrame([("u1", "v1", "c1", "n1"), ("u2", "v2", "c1", "nowhere"), (None, None, None, None)], "id string, ctv_id string, component_id string, norm string")
    maps, requires = spark.createDataFrame([("c1", "x"), ("c9", "x"), ("c1", None)], "component string, concept string"), spark.createDataFrame([("p", "x"), ("p", "x")], "procedure string, concept string")
    nodes = graph_build.nodes(norms, units, maps, requires)
    assert rows(nodes.groupBy("kind").count()) == [("CTV", 2), ("Component", 1), ("Concept", 1), ("Jurisdiction", 1), ("Norm", 2), ("Procedure", 1), ("TextUnit", 2), ("Theme", 1)]
    got = rows(graph_build.edges(nodes, norms, units, maps, requires))
    assert got == sorted([("AMENDS", "n1", "n2"), ("APPLIES_IN", "n1", "j"), ("APPLIES_IN", "n2", "j"), ("HAS_COMPONENT", "n1", "c1"), ("HAS_TEXT", "v1", "u1"), ("HAS_TEXT", "v2", "u2"), ("HAS_VERSION", "c1", "v1"), ("HAS_VERSION", "c1", "v2"), ("IMPLEMENTS", "n1", "n2"), ("INCLUDES", "t", "n1"), ("MAPS_TO_CONCEPT", "c1", "x"), ("REQUIRES_CONCEPT", "p", "x")], key=repr)


def test_names_are_joined_by_rare_tokens(spark):
    rng = random.Random(5)
    words = ["nghi", "dinh", *[f"w{i}" for i in range(12)]]
    name = lambda n: " ".join(rng.choice(words[:2] if rng.random() < 0.6 else words) for _ in range(n))
    q = [(f"q{i}", name(rng.randrange(0, 6))) for i in range(40)] + [("null", None)]
    items = [(f"i{i}", name(rng.randrange(0, 5))) for i in range(60)] + [("null", None), ("i0", "nghi dinh")]
    got = {(r.q, r.item, round(r.score, 9)) for r in retrieval.keyword_overlap(spark.createDataFrame(q, "q string, text string"), spark.createDataFrame(items, "item string, name string")).collect()}
    want = {(a, b, round(len(set(t.split()) & set(n.split())) / len(set(t.split())), 9)) for a, t in q if t for b, n in items if n and len(set(t.split()) & set(n.split())) * 2 >= len(set(t.split()))}
    assert got == want and want


@pytest.mark.parametrize("block", [2048, 3])
def test_bm25_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRS_AT_ONCE", 7)
    rng = random.Random(6)
    vocabulary = ["a", "đất", "b", "c", "d", "e", "f"]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.randrange(1, 8)]) for _ in range(rng.randrange(0, 12)))) for i in range(50)] + [(90, None), (91, "zz")]
    asked = [(f"q{i}", " ".join(rng.choice(vocabulary + ["unknown"]) for _ in range(rng.randrange(0, 5)))) for i in range(9)]
    toks = {i: (t or "").split() for i, t in docs}
    avg, n = sum(map(len, toks.values())) / len(toks), len(toks)
    want = set()
    for q, t in asked:
        s = {i: sum(math.log1p((n - d + 0.5) / (d + 0.5)) * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for x in t.split() for d in [sum(x in v for v in toks.values())]) for i, w in toks.items()}
        want |= {(q, i, r + 1) for r, (i, _) in enumerate(sorted(((i, round(v, 6)) for i, v in s.items() if round(v, 6) > 0), key=lambda x: (-x[1], x[0]))[:4])}
    got = retrieval.bm25_top_k(spark.createDataFrame(asked, "q string, text string"), spark.createDataFrame(docs, "item int, text string"), 4, block=block)
    assert {(r.q, r.item, r["rank"]) for r in got.collect()} == want and want
    assert retrieval.bm25_top_k(spark.createDataFrame(asked, "q string, text string").limit(0), spark.createDataFrame(docs, "item int, text string"), 4).count() == 0
    assert retrieval.bm25_top_k(spark.createDataFrame(asked, "q string, text string"), spark.createDataFrame(docs, "item int, text string").limit(0), 4).count() == 0


def test_quantiles_and_splits_of_any_size(spark):
    rng = random.Random(7)
    data = [("a" if rng.random() < 0.8 else "b", rng.choice([1.5, 2.0, round(rng.random() * 50, 1)])) for _ in range(700)] + [("c", None), (None, 3.0), ("a", None)]
    df = spark.createDataFrame(data, "g string, v double")
    at = lambda vs, q: sorted(vs)[int(q * (len(vs) - 1))]
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.x for r in metrics.ranked_quantile(df, ["g"], "v", q, "x").collect()}
        assert got == {k: at([v for g, v in data if g == k and v is not None], q) for k in ("a", "b", None)}
        assert rows(metrics.ranked_quantile(df, [], "v", q, "x")) == [(at([v for _, v in data if v is not None], q),)]
    assert metrics.ranked_quantile(df.limit(0), [], "v", 0.5).count() == 0
    got = stats.split_by_group(spark.createDataFrame([(f"d{i % 40}", i) for i in range(900)] + [(None, 900)], "doc string, i int"), "doc", 0.2).collect()
    val = [r for r in got if r.split == "val"]
    assert len(got) == 901 and 0.2 * 901 <= len(val) < 0.2 * 901 + 24 and not {r.doc for r in val} & {r.doc for r in got if r.split == "train"}


def test_single_flight_and_frames(spark):
    rng = random.Random(8)
    data = [(rng.choice("ab"), i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(0, 600))) for i in range(200)] + [("a", 500, None), (None, 501, dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(data, "k string, i int, at timestamp")
    got = {r.i: r.admitted for r in traces.single_flight(df, "k", "at", "i", 1800).collect()}
    want, free = {500: False, 501: False}, {}
    for k, i, t in sorted((x for x in data if x[0] and x[2]), key=lambda x: (x[2], x[1])):
        want[i] = t >= free.get(k, t)
        free[k] = t + dt.timedelta(minutes=30) if want[i] else free[k]
    assert got == want and traces.single_flight(df.limit(0), "k", "at", "i", 1.0).count() == 0
    assert traces.frames(df.where("i = 500"), "k", "i").first().frame == 'data: {"k":"a","i":500}\n\n'


def test_drain_writes_every_event_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)
    for more in (0, 5):
        spark.range(100, 100 + more).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        traces.drain(stream, str(tmp_path / "out"), str(tmp_path / "ck"), None).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id") == sorted([(i,) for i in [*range(10), *range(100, 105)]], key=repr)


def test_cut_asks_a_cluster_for_a_shared_folder():
    unset = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: unset), getConf=lambda: SimpleNamespace(get=lambda _: None), master="spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.cut(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc)))
