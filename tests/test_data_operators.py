import datetime as dt
import json
import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quern.functions.dates import parse_day
from quern.operators import hierarchy, intervals, nested, references

D = dt.date.fromisoformat


def day(df):
    return {tuple(str(x) if isinstance(x, dt.date) else x for x in r) for r in df.collect()}


def test_parse_day(spark):
    texts = ["2024-01-31", " 31/01/2024 ", "2024-01-31T00:00:00", "2024-01-31 10:00", "2023-02-30", "20xx-01-01", "", None, "1/2/2024", "9999-12-31"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_day(F.col("t")).alias("d"))
    assert [str(r.d) if r.d else None for r in df.collect()] == ["2024-01-31"] * 4 + [None] * 5 + ["9999-12-31"]


def test_periods_merge_nest_touch_and_gap(spark):
    data = [("a", "2020-01-01", "2020-01-10"), ("a", "2020-01-05", "2020-01-07"), ("a", "2020-01-11", "2020-01-20"), ("a", "2020-01-22", None), ("a", "2020-01-22", None), ("b", "2020-01-01", "2020-01-01"), (None, "2020-01-01", None), ("c", "2020-02-01", "2020-01-01"), ("d", None, "2020-01-01")]
    df = spark.createDataFrame([(k, D(a) if a else None, D(b) if b else None, 1) for k, a, b in data], "key string, start date, end date, w int")
    p = intervals.continuous_periods(df)
    assert day(p) == {("a", "2020-01-01", "2020-01-20", 3), ("a", "2020-01-22", "9999-12-31", 1), ("b", "2020-01-01", "2020-01-01", 1)}
    assert day(intervals.period_gaps(p)) == {("a", "2020-01-21", "2020-01-21")}
    assert day(intervals.periods_and_gaps(p)) == {("a", "merged", "2020-01-01", "2020-01-20"), ("a", "gap", "2020-01-21", "2020-01-21")}


def test_periods_against_brute_force(spark):
    rng = random.Random(1)
    base = D("2020-01-01")
    data = []
    for _ in range(600):
        a = rng.randrange(400)
        data.append((f"k{min(rng.randrange(12), 4)}", base + dt.timedelta(a), None if rng.random() < 0.01 else base + dt.timedelta(a + rng.randrange(-1, 6))))
    want = set()
    by = defaultdict(set)
    for k, a, b in data:
        b = b or D("9999-12-31")
        if a <= b:
            by[k].add((a, b))
    for k, iv in by.items():
        cur = None
        for a, b in sorted(iv):
            if cur and (a - cur[1]).days <= 1:
                cur = [cur[0], max(cur[1], b), cur[2] + 1]
            else:
                if cur:
                    want.add((k, str(cur[0]), str(cur[1]), cur[2]))
                cur = [a, b, 1]
        want.add((k, str(cur[0]), str(cur[1]), cur[2]))
    assert day(intervals.continuous_periods(spark.createDataFrame(data, "key string, start date, end date"))) == want


def test_periods_of_empty_table(spark):
    df = spark.createDataFrame([], "key string, start date, end date")
    assert intervals.periods_and_gaps(intervals.continuous_periods(df)).count() == 0


def test_validity_takes_dates_of_current_norm(spark):
    scored = spark.createDataFrame([("c1", " N1 ", None, ""), ("c2", "n1", "n/a", None), ("c3", None, None, None), ("c4", "n1", "2020-01-01", "soon")], "component_id string, norm_id string, valid_from string, valid_to string")
    norm = spark.createDataFrame([("n1", dt.datetime(2020, 1, 1), "2001-01-01", None), ("N1", dt.datetime(2021, 1, 1), "02/02/2002", None), (None, None, None, None)], "id string, ingested_at timestamp_ntz, valid_from string, valid_to string")
    assert day(intervals.validity_intervals(scored, norm)) == {("c1", "2002-02-02", "9999-12-31")}


def test_orphans_of_every_reason_with_a_hot_key(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    refs = [("r", str(i), "hot", t(3)) for i in range(40)] + [("r", "x", " GONE ", t(5)), ("r", "x", "gone", t(5)), ("r", "y", "ok", t(5)), ("r", "z", "late", t(1)), ("r", "u", "del", t(9)), ("r", "v", "both", None), ("r", "w", None, t(1)), ("r", "w", " ", t(1)), ("r", "q", "later-deleted", t(2))]
    parents = [("ok", t(1), None), ("late", t(2), None), ("del", t(1), t(9)), ("both", t(5), t(6)), ("later-deleted", t(1), t(3))]
    c = spark.createDataFrame(refs, "src_table string, src_key string, key string, at timestamp_ntz")
    p = spark.createDataFrame(parents, "key string, arrival timestamp_ntz, deleted_at timestamp_ntz")
    got = rows(references.orphan_references(c, p), "src_key", "ref_id", "reason", "period_ym")
    want = sorted([(str(i), "hot", "missing", "2024-01") for i in range(40)] + [("x", "gone", "missing", "2024-01"), ("z", "late", "late", "2024-01"), ("u", "del", "deleted", "2024-01")], key=repr)
    assert got == want
    report = rows(references.orphan_report(references.orphan_references(c, p)))
    assert ("r", "missing", "2024-01", 41, 2) in report
    assert references.orphan_references(c.limit(0), p).count() == 0
    assert references.orphan_references(c, p.limit(0)).where("reason <> 'missing'").count() == 0


PAYLOADS = [
    '{"results": [{"id": 1, "question": "a\\"[{", "pred_citations": [{"van_ban": "x", "khoan": 2}, 7, {"van_ban": "y\\u00e9", "khoan": " "}], "citation_score": {"f1": 0.25}}]}',
    '[{"question": "q", "pred_citations": {"van_ban": "x"}, "citation_score": {"f1": NaN}}, {"question": "q", "ground_truth_citations": [{"khoan": "3"}], "citation_score": {"f1": "0.5"}}]',
    '{"question": "q", "pred_citations": [{"van_ban": "a", "van_ban": "b", "khoan": null}], "citation_score": null}',
    '{"run": {"results": [{"pred_citations": [{"van_ban": "n", "x": {"pred_citations": [{"van_ban": "inner"}]}}]}]}}',
    json.dumps('[{"question": "q", "pred_citations": [{"van_ban": "wrapped"}]}]'),
    '{"results": []}', "", " ", "null", "{", '{"a": 1', '{"pred_citations": [{"van_ban": "cut', '{"a": 01}', '{"a": "\\x"}', '{"a" 1}', "[1,]", '{"pred_citations": [{"van_ban": "t"}]} x', '"plain"', '[1 2]', '{"a": "\\u12"}', '{"a": "b\nc"}', "]", "}{", '{"a":]}', '["\\\\"]', '{"a": "b\\\\"}', "tru", "-", "1.", "[[[[]]]]", '{"a":{"b":[{"c":[]}]}}',
]


def plain_rows(texts):
    """The same by the standard parser."""
    bp = lambda v: -1 if v is None or float(v) != float(v) else round(float(v) * 10000)
    out = set()
    for i, t in enumerate(texts):
        try:
            x = json.loads(t)
            while isinstance(x, str):
                x = json.loads(x)
        except (ValueError, TypeError):
            continue
        x = x.get("run", x) if isinstance(x, dict) else x
        x = x.get("results", x) if isinstance(x, dict) else x
        for k, r in enumerate(x if isinstance(x, list) else [x]):
            if not isinstance(r, dict):
                continue
            s = r.get("citation_score")
            for side, name in (("pred", "pred_citations"), ("gt", "ground_truth_citations")):
                c = r.get(name)
                for j, y in enumerate([c] if isinstance(c, dict) else c or []):
                    if isinstance(y, dict):
                        k2 = y.get("khoan")
                        out.add((i, k, side, j, y.get("van_ban"), "" if k2 is None or not str(k2).strip() else str(k2), bp(s.get("f1")) if isinstance(s, dict) else -1))
    return out


def test_citations_of_nested_payloads(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PAYLOADS)] + [(999, None)], "raw_id long, payload string").repartition(1)
    got = {tuple(r) for r in nested.citation_rows(df).collect()}
    assert got == plain_rows(PAYLOADS)
    assert nested.citation_rows(df.limit(0)).count() == 0


def test_index_accepts_what_the_parser_accepts():
    rng = random.Random(2)
    base = [p for p in PAYLOADS if p]
    texts = []
    for _ in range(3000):
        t = rng.choice(base)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(['"', "\\", "{", "}", "[", "]", ":", ",", " ", "1", "e", "u00", ""]) + t[at + rng.randrange(2) :]
        texts.append(t)

    def ok(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    valid = nested.JsonIndex([t.encode() for t in texts]).valid
    assert [t for t, v in zip(texts, valid) if v != ok(t)] == []


def test_nodes_rebuild_the_record(spark):
    value = {"a": [1, "x", None, {"b": []}], "c": {"d": True, "e": "é\"\\"}}
    df = spark.createDataFrame([("k", json.dumps(value))], "key string, p string")
    nodes = {r.node_id: r for r in nested.json_nodes(df, "key", "p").collect()}

    def build(i):
        r = nodes[i]
        kids = sorted((n for n in nodes.values() if n.parent_id == i), key=lambda n: (n.pos or 0, n.node_id))
        if r.kind == "object":
            return {n.name: build(n.node_id) for n in kids}
        if r.kind == "array":
            return [build(n.node_id) for n in kids]
        return r.value if r.kind == "string" else json.loads(r.value) if r.value is not None else None

    assert build(next(n for n in nodes if nodes[n].parent_id < 0)) == value


def brute_hierarchy(nodes, links):
    parents = defaultdict(set)
    for c, p in links:
        if c in nodes and p in nodes:
            parents[c].add(p)

    def above(v):
        seen, todo = set(), list(parents[v])
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += parents[u]
        return seen

    anc = {v: above(v) for v in nodes}
    loops = {v for v in nodes if v in anc[v]}
    ways = lambda v: [(v,)] if not parents[v] else [w + (v,) for p in parents[v] for w in ways(p)]
    out = set()
    for v in nodes:
        if v in loops or anc[v] & loops:
            out.add((v, "cycle" if v in loops else "below_cycle", "", -1, ""))
        else:
            out |= {(v, "path", w[0], len(w) - 1, ">".join(w)) for w in ways(v)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(60)]
    links = [(f"n{i}", f"n{max(0, i - rng.randrange(1, 4))}") for i in range(1, 60) if rng.random() < 0.8]
    links += [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(6)] + [("n5", "n5"), ("n1", "nowhere"), (None, "n1"), ("n2", None)] + links[:3]
    n = spark.createDataFrame([(x,) for x in nodes] + [("n0",), (None,)], "node string")
    e = spark.createDataFrame(links, "child string, parent string")
    got = {tuple(r) for r in hierarchy.hierarchy(n, e).collect()}
    assert got == brute_hierarchy(set(nodes), links)


def test_hierarchy_of_a_long_chain_and_of_nothing(spark):
    n = 120
    nodes = spark.createDataFrame([(f"{i:03}",) for i in range(n)], "node string")
    links = spark.createDataFrame([(f"{i:03}", f"{i - 1:03}") for i in range(1, n)], "child string, parent string")
    h = hierarchy.hierarchy(nodes, links)
    assert h.count() == n and h.agg(F.max("depth")).first()[0] == n - 1
    assert hierarchy.descendants(h).count() == n * (n - 1) // 2
    assert hierarchy.hierarchy(nodes.limit(0), links.limit(0)).count() == 0


def test_loops_beside_below_and_through_each_other(spark):
    """Loops of one to many nodes, loops that share a node, loops above each other with nodes between them."""
    links = [(f"r{i}", f"r{(i + 1) % 17}") for i in range(17)] + [("self", "self"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    links += [("lo1", "lo2"), ("lo2", "lo1"), ("lo1", "m1"), ("m1", "m2"), ("m2", "m3"), ("m3", "hi1"), ("hi1", "hi2"), ("hi2", "hi3"), ("hi3", "hi1"), ("lo2", "m9"), ("m9", "self")]
    links += [("end", "r3"), ("end2", "end"), ("free", "top"), ("end", "free")] + [(f"d{i}", f"d{(i * 7 + 1) % 11}") for i in range(11)] + [(f"d{i}", f"d{(i * 3 + 2) % 11}") for i in range(11)]
    nodes = {x for pair in links for x in pair}
    got = {tuple(r) for r in hierarchy.hierarchy(spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(links, "child string, parent string")).collect()}
    assert got == brute_hierarchy(nodes, links)


def test_hierarchy_with_a_hub(spark):
    links = [(f"n{i}", "hub") for i in range(3000)] + [("hub", "root")] + [(f"m{i}", f"n{i}") for i in range(0, 3000, 3)]
    nodes = {x for pair in links for x in pair}
    got = {tuple(r) for r in hierarchy.hierarchy(spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(links, "child string, parent string")).collect()}
    assert got == brute_hierarchy(nodes, links)


def test_orphans_beside_a_healthy_hot_key(spark):
    """A norm that half of all references name, none of them dangling, and as many that do name another."""
    t = lambda d: dt.datetime(2024, 1, d)
    refs = [("r", str(i), "healthy", t(5)) for i in range(3000)] + [("r", f"x{i}", "withdrawn", t(9)) for i in range(1500)] + [("r", f"y{i}", f"rare{i}", t(2)) for i in range(1500)]
    parents = [("healthy", t(1), None), ("withdrawn", t(1), t(8))] + [(f"rare{i}", t(3 if i % 2 else 1), None) for i in range(1400)]
    c = spark.createDataFrame(refs, "src_table string, src_key string, key string, at timestamp_ntz")
    p = spark.createDataFrame(parents, "key string, arrival timestamp_ntz, deleted_at timestamp_ntz")
    got = rows(references.orphan_references(c, p).groupBy("reason").count())
    assert got == [("deleted", 1500), ("late", 700), ("missing", 100)]
