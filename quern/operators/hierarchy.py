"""Parent-child links turned into full hierarchies: paths, depths, roots, descendants and cycles.

Nodes from which a way up never ends are peeled off first, with tables no larger than the links. What is left has no
cycles: its nodes are cut into short runs by hash splitters, every node walks to its next splitters (a few joins, all
nodes at once), the reduced graph of splitters is solved by doubling, and exact paths are put together from the
pieces, so the number of rounds follows the length of runs and the logarithm of the depth, not the depth.

Joins on a parent are sort-merge joins that adaptive execution splits where a parent has a great share of all links;
their other side has one row a node, but for the ways up from a splitter, which the output lists anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.intervals import current_rows
from quern.session import cut

#: One node in so many is a splitter.
SPLITTER_EVERY = 3
#: Steps of a walk between two cuts of the lineage.
STEPS = 3


def is_splitter(node: Column, every: int = SPLITTER_EVERY) -> Column:
    """Deterministic choice by hash."""
    return F.pmod(F.xxhash64(F.lit("splitter"), node), F.lit(every)) == 0


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def endless(links: DataFrame) -> DataFrame:
    """Nodes from which a way from child to parent never ends: ``node``.

    Round by round, links to a parent without parents are dropped, and a link to a parent with a single one is moved up
    to that, so chains shrink by half each time. Neither makes a way that ends endless, nor the other way round. Links only
    get fewer, and as long as there is a way that ends one of them is dropped; when none is, all ways left are endless.
    """
    left = cut(links.select("child", "parent").distinct())
    n = left.count()
    while n:
        up = left.groupBy(F.col("child").alias("parent")).agg(F.count(F.lit(1)).alias("ways"), F.min("parent").alias("only"))
        left = cut(left.join(up, "parent").select("child", F.when(F.col("ways") == 1, F.col("only")).otherwise(F.col("parent")).alias("parent")).distinct())
        before, n = n, left.count()
        if n == before:
            break
    return left.select(F.col("child").alias("node")).distinct()


def _within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between two of the nodes."""
    return links.join(nodes.withColumnRenamed("node", "child"), "child", "left_semi").join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent")


def _down(links: DataFrame) -> DataFrame:
    return links.select(F.col("parent").alias("child"), F.col("child").alias("parent"))


def _tops(links: DataFrame) -> DataFrame:
    """Where chains of links end, each child having one parent and each parent one child, without loops: ``node, top``."""
    ways = cut(links.select(F.col("child").alias("node"), F.col("parent").alias("top"), F.lit(True).alias("moved")))
    while not _empty(ways.where("moved")):
        further = ways.select(F.col("node").alias("top"), F.col("top").alias("next"))
        ways = cut(ways.join(further, "top", "left").select("node", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")))
    return ways.select("node", "top")


def _coloured_loops(links: DataFrame) -> DataFrame:
    """Nodes on a loop: every node takes the greatest name it reaches as its colour, and the nodes that the one of that name reaches within its colour are its loop.

    Loops that others reach hide behind their colours, so the rest is looked at again without what was found.
    """
    loops = links.select(F.col("child").alias("node")).limit(0)
    while not _empty(links):
        colours = cut(links.select(F.col("child").alias("node")).union(links.select("parent")).distinct().select("node", F.col("node").alias("colour")))
        moved = True
        while moved:
            reached = links.join(colours.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("child").alias("node")).agg(F.max("colour").alias("new"))
            colours = cut(colours.join(reached, "node", "left").select("node", F.greatest("colour", "new").alias("colour"), (F.col("new") > F.col("colour")).alias("moved")))
            moved = not _empty(colours.where("moved"))
            colours = colours.select("node", "colour")
        of = lambda name, colour: colours.select(F.col("node").alias(name), F.col("colour").alias(colour))
        inside = cut(links.join(of("child", "c1"), "child").join(of("parent", "c2"), "parent").where("c1 = c2").select("child", "parent"))
        seen = front = cut(colours.where("node = colour").select("node"))
        while True:
            front = cut(inside.join(front.withColumnRenamed("node", "child"), "child", "left_semi").select(F.col("parent").alias("node")).distinct().join(seen, "node", "left_anti"))
            if _empty(front):
                break
            seen = seen.unionByName(front)
        seen = cut(seen)
        # one node alone is a loop only if it names itself
        loops = cut(loops.unionByName(_within(inside, seen).select(F.col("child").alias("node")).distinct()))
        links = cut(links.join(seen.withColumnRenamed("node", "child"), "child", "left_anti").join(seen.withColumnRenamed("node", "parent"), "parent", "left_anti"))
    return loops


def on_loops(links: DataFrame) -> DataFrame:
    """Nodes on a loop, among links whose children all have endless ways up: ``node``.

    Nodes whose ways down are endless too lie on a loop or between two. A link that is the only way up of its child and
    the only way down of its parent joins two nodes of which both or none are on a loop: where such links go round they
    are a loop by themselves, and other chains of them shrink to their tops. Only what is left branches at every node.
    """
    links = cut(_within(links, endless(_down(links))))
    up = links.groupBy("child").agg(F.count(F.lit(1)).alias("ups"))
    down = links.groupBy("parent").agg(F.count(F.lit(1)).alias("downs"))
    links = cut(links.join(up, "child").join(down, "parent").select("child", "parent", (F.expr("ups = 1 and downs = 1")).alias("single")))
    single = links.where("single").select("child", "parent")
    round_ = cut(endless(single))
    tops = _tops(single.join(round_.withColumnRenamed("node", "child"), "child", "left_anti"))
    branching = links.where("not single").join(tops.select(F.col("node").alias("parent"), "top"), "parent", "left").select("child", F.coalesce("top", "parent").alias("parent")).distinct()
    loops = _coloured_loops(cut(branching))
    return round_.unionByName(loops).unionByName(tops.join(loops.withColumnRenamed("node", "top"), "top", "left_semi").select("node"))


def cycle_states(links: DataFrame) -> DataFrame:
    """Nodes on a loop ('cycle') and nodes with an ancestor on one ('below_cycle'): ``node, kind``."""
    caught = cut(endless(links))
    on = cut(on_loops(cut(_within(links, caught))))
    return on.select("node", F.lit("cycle").alias("kind")).unionByName(caught.join(on, "node", "left_anti").select("node", F.lit("below_cycle").alias("kind")))


def _upwards(pieces: DataFrame, upper: DataFrame) -> DataFrame:
    """Pieces of paths (v, u, open, tail, n) made longer by what begins at their top; those that aren't open stay.

    ``upper`` has the ways up from u: (u, top, top_open, upper, m). Pieces that stay meet nothing and are spread.
    """
    at = F.when(F.col("open"), F.col("u")).otherwise(F.concat(F.lit("\u0000"), "v"))
    met = pieces.withColumn("at", at).join(upper.withColumnRenamed("u", "at"), "at", "left")
    longer = F.col("open") & F.col("top").isNotNull()
    return met.select(
        "v",
        F.when(longer, F.col("top")).otherwise(F.col("u")).alias("u"),
        F.when(longer, F.col("top_open")).otherwise(F.col("open")).alias("open"),
        F.when(longer, F.concat("upper", "tail")).otherwise(F.col("tail")).alias("tail"),
        F.when(longer, F.col("n") + F.col("m")).otherwise(F.col("n")).alias("n"),
    )


def _ways_up(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("v").alias("u"), F.col("u").alias("top"), F.col("open").alias("top_open"), F.col("tail").alias("upper"), F.col("n").alias("m"))


def _paths(nodes: DataFrame, links: DataFrame, every: int) -> DataFrame:
    """All ways down from roots in a graph without cycles: ``node, root_id, depth, path``."""
    inner = links.select(F.col("child").alias("node")).distinct()
    marked = links.join(inner.select(F.col("node").alias("parent"), F.lit(True).alias("inner")), "parent", "left").select("child", "parent", F.col("inner").isNull().alias("root"))
    edges = cut(marked.withColumn("stop", F.col("root") | is_splitter(F.col("parent"), every)))
    # walk to the next splitter or root; a piece's tail is what follows its top
    step = edges.select(F.col("child").alias("u"), F.col("parent").alias("top"), (~F.col("stop")).alias("top_open"), F.concat(F.lit(">"), "child").alias("upper"), F.lit(1).alias("m"))
    front = edges.select(F.col("child").alias("v"), F.col("parent").alias("u"), (~F.col("stop")).alias("open"), F.concat(F.lit(">"), "child").alias("tail"), F.lit(1).alias("n"))
    ended = None
    while True:
        for _ in range(STEPS):
            front = _upwards(front, step)
        front = cut(front)
        done = front.where("not open")
        ended = done if ended is None else ended.unionByName(done)
        front = front.where("open")
        if _empty(front):
            break
    roots = nodes.join(inner, "node", "left_anti")
    # reduced graph: pieces from splitter to splitter, joined until each begins at a root; a top that isn't a splitter is a root
    rooted = ended.join(inner.select(F.col("node").alias("u"), F.lit(True).alias("more")), "u", "left").select("v", "u", F.col("more").isNotNull().alias("open"), "tail", "n")
    rooted = cut(rooted)
    whole = rooted.where(is_splitter(F.col("v"), every))
    while not _empty(whole.where("open")):
        whole = cut(_upwards(whole, _ways_up(whole)))
    rest = _upwards(rooted.where(~is_splitter(F.col("v"), every)), _ways_up(whole))
    below = rest.unionByName(whole).select(F.col("v").alias("node"), F.col("u").alias("root_id"), F.col("n").alias("depth"), F.concat("u", "tail").alias("path"))
    return below.unionByName(roots.select("node", F.col("node").alias("root_id"), F.lit(0).alias("depth"), F.col("node").alias("path")))


def hierarchy(nodes: DataFrame, links: DataFrame, every: int = SPLITTER_EVERY) -> DataFrame:
    """Full hierarchies of a graph of parent links: ``node, kind, root_id, depth, path``.

    ``nodes(node)`` are the ids there are, ``links(child, parent)`` what they name. Links to or from ids that
    aren't nodes, with nulls, and repeated links don't count. Kinds: 'cycle' (on a loop, a link to itself is one) and
    'below_cycle' (an ancestor is on one), both with root '', depth -1 and path ''; every other node has one
    'path' row for each way down from a node without parents, the ids joined by '>'. No nodes, no rows.
    """
    nodes = cut(nodes.where("node is not null").select("node").distinct())
    ids = nodes
    known = (
        links.select("child", "parent")
        .distinct()
        .join(ids.withColumnRenamed("node", "child"), "child", "left_semi")
        .join(ids.withColumnRenamed("node", "parent"), "parent", "left_semi")
    )
    known = cut(known)
    states = cut(cycle_states(known))
    clean_nodes = nodes.join(states, "node", "left_anti")
    clean_links = known.join(states.select(F.col("node").alias("child")), "child", "left_anti")
    paths = _paths(clean_nodes, clean_links, every)
    caught = states.select("node", "kind", F.lit("").alias("root_id"), F.lit(-1).alias("depth"), F.lit("").alias("path"))
    return paths.select("node", F.lit("path").alias("kind"), "root_id", "depth", "path").unionByName(caught)


def descendants(paths: DataFrame) -> DataFrame:
    """Each ancestor with each of its descendants and the shortest distance: ``ancestor, descendant, distance``."""
    ids = F.split("path", ">")
    pairs = paths.where("kind = 'path' and depth > 0").select(F.col("node").alias("descendant"), "depth", F.posexplode(F.slice(ids, F.lit(1), F.size(ids) - 1)).alias("at", "ancestor"))
    return pairs.groupBy("ancestor", "descendant").agg(F.min(F.col("depth") - F.col("at")).alias("distance"))


def norm_links(norm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and parent links of the current rows of norms: what a norm implements, and norms it says amended it are its children."""
    cur = current_rows(norm.select("id", "ingested_at", "implements", "amended_by_norms"))
    clean = lambda c: F.lower(F.trim(c))
    up = cur.select(F.col("key").alias("child"), F.explode("cur.implements").alias("p")).select("child", clean("p").alias("parent"))
    down = cur.select(F.col("key").alias("parent"), F.explode("cur.amended_by_norms").alias("c")).select(clean("c").alias("child"), "parent")
    return cur.select(F.col("key").alias("node")), up.unionByName(down)
