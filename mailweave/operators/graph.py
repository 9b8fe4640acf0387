"""Graph algorithms as iterative DataFrame jobs: components, PageRank, labels, paths, betweenness."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.operators import pathblocks
from mailweave.session import cut, measured

DAMPING, PASSES = 0.85, 20
LABEL_ROUNDS = 20
#: Iterations between two checkpoints.
EVERY = 5
#: A vertex with more edges than HOT_EDGES and than a HOT_PART-th of all is hot, so there are at most HOT_PART of them.
HOT_EDGES, HOT_PART = 10_000, 1_000
#: Values of at most so many vertices (counted) are sent to the edges, which then stay where they are.
FEW_VERTICES = 500_000
#: A table of counted rows is written by as many tasks as give each TASK_ROWS, and by LEAST_TASKS at least.
TASK_ROWS, LEAST_TASKS = 25_000, 8
#: Partial paths that are grown at first for each path asked for.
PREFIXES = 16


def undirected(edges: DataFrame) -> DataFrame:
    """Both orientations of (src, dst, …)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def single(edges: DataFrame) -> DataFrame:
    """Each edge (src, dst) once, in one orientation; self-loops are dropped."""
    return edges.filter("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def hot_vertices(degrees: DataFrame, edges: int) -> DataFrame:
    """Those of ``degrees`` (id, n, …) whose edges are too many for one task: ``HOT_PART`` at most."""
    return degrees.filter(F.col("n") > max(HOT_EDGES, edges // HOT_PART))


def with_vertex(edges: DataFrame, end: str, values: DataFrame, hot: DataFrame | None, vertices: int | None = None, how: str = "inner") -> DataFrame:
    """``edges`` beside the values (id, …) of the vertex at one end: a vertex cut.

    Edges of hot vertices stay where they are and get a copy of their vertex, of which there are few;
    only edges of other vertices are shuffled to theirs. Where no more than ``FEW_VERTICES`` were counted
    (``vertices``), all edges stay. ``how`` is inner, or left to keep edges whose vertex has no values.
    """
    if vertices is not None and vertices <= FEW_VERTICES:
        return edges.join(F.broadcast(values), edges[end] == values["id"], how).drop("id")
    if hot is None:
        return edges.join(values, edges[end] == values["id"], how).drop("id")
    ids = hot.select(F.col("id").alias("hot"))
    few = values.join(F.broadcast(ids), values["id"] == ids["hot"]).drop("hot")
    at_hot = edges.join(F.broadcast(ids), edges[end] == ids["hot"], "left_semi")
    mirrored = at_hot.join(F.broadcast(few), at_hot[end] == few["id"], how).drop("id")
    rest = edges.join(F.broadcast(ids), edges[end] == ids["hot"], "left_anti")
    return mirrored.unionByName(rest.join(values, rest[end] == values["id"], how).drop("id"))


def fewer_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than a counted number of rows asks for: with many shuffle partitions, small steps cost their tasks."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the undirected edges (src, dst): the smallest id of each component.

    Vertices first merge into their least neighbour, as long as that halves the edges: of stars, as
    shared values make them, next to nothing is left. On the rest, alternating large-star and
    small-star steps take about log(n) rounds. No neighbourhood is gathered in one row or task: the
    least neighbour combines before the shuffle, and edges of hot vertices meet it where they are.
    """
    # the number of edges and the sum of their hashes, taken while they are written, tell whether anything changed
    state = {"n": F.count("*"), "h": F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))}
    now, held = measured(
        edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .filter("a is not null and b is not null").distinct(), n=F.count("*"),
    )
    n, merged = held["n"], []

    def leasts(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None, int]:
        """(id, m): the least neighbour of each ``a``, itself included, of ``n`` rows at most; which are hot; how many."""
        least = rows.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
        least, seen = measured(
            fewer_tasks(least, n), nodes=F.count(F.lit(1)), edges=F.coalesce(F.sum("n"), F.lit(0)), most=F.coalesce(F.max("n"), F.lit(0))
        )
        hot = hot_vertices(least, seen["edges"]) if seen["most"] > HOT_EDGES else None
        return least.select("id", F.least("id", "m").alias("m")), hot, seen["nodes"]

    def beside_least(rows: DataFrame, n: int) -> DataFrame:
        """Rows with the least neighbour ``m`` of their ``a``."""
        least, hot, nodes = leasts(rows, n)
        return with_vertex(rows, "a", least, hot, nodes)

    while n and (not merged or 2 * n <= before):
        before = n
        least, hot, nodes = leasts(now.union(now.select("b", "a")), 2 * n)
        ends = with_vertex(now, "a", least, hot, nodes).select(F.col("m").alias("a"), "b")
        ends = with_vertex(ends, "b", least, hot, nodes).select(F.greatest("a", "m").alias("a"), F.least("a", "m").alias("b"))
        now, held = measured(fewer_tasks(ends.filter("a != b").distinct(), n), **state)
        n = held["n"]
        # of the vertices that are left, each is an end of an edge
        merged.append((least, hot, 2 * n))

    new, last = held if n else None, None
    while new != last:
        last = new
        both = now.union(now.select("b", "a"))
        large = beside_least(both, 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(fewer_tasks(large, n))
        pairs = beside_least(large, n)
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(pairs.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        now, new = measured(fewer_tasks(small, 2 * n), **state)
        n = new["n"]
    part = now.union(now.select("b", "b")).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    for least, hot, left in reversed(merged):
        # a vertex without edges after the merge is a component's smallest id
        of = least.withColumnRenamed("id", "of")
        part = (with_vertex(of, "m", part, hot, left, "left") if left else of.withColumn("component", F.col("m"))).select(F.col("of").alias("id"), F.coalesce("component", "m").alias("component"))
    return part


def weighted_pagerank(pairs: DataFrame, damping: float = DAMPING, passes: int = PASSES) -> DataFrame:
    """(id, rank) over undirected weighted pairs (src, dst, weight); self-loops are dropped.

    Each pass sends rank in proportion to the weight; nothing is renormalised, and every node has
    an edge, so no rank is lost.
    """
    both = undirected(cut(pairs.filter("src != dst").select("src", "dst", F.greatest(F.col("weight"), F.lit(1)).cast("double").alias("w"))))
    # sums with map-side combine, so that a hub's edges needn't meet in one task
    whole = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("all"), F.count("*").alias("n"))
    whole, seen = measured(whole, nodes=F.count(F.lit(1)), edges=F.coalesce(F.sum("n"), F.lit(0)), most=F.coalesce(F.max("n"), F.lit(0)))
    hot = cut(hot_vertices(whole, seen["edges"]).select("id")) if seen["most"] > HOT_EDGES else None
    nodes, n = whole.select("id"), seen["nodes"]
    both = with_vertex(both, "src", whole.select("id", "all"), hot, n).select("src", "dst", (F.col("w") / F.col("all")).alias("share"))
    # edges lie by their end, hubs in several parts, so that a pass sums most of a vertex before its shuffle
    both = cut(both.hint("rebalance", F.col("dst")))
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(passes):
        got = with_vertex(both, "src", rank, hot, n).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("r"))
        rank = got.select(F.col("dst").alias("id"), (F.lit((1 - damping) / n) + damping * F.col("r")).alias("rank"))
        if (k + 1) % EVERY == 0:
            rank = cut(rank)
    return rank.withColumn("rank", F.round("rank", 12))


def directed_pagerank(edges: DataFrame, damping: float = DAMPING, passes: int = PASSES) -> DataFrame:
    """(id, rank) over directed edges (src, dst); the rank of nodes without an edge out is spread evenly.

    A pass is linear, and what it spreads evenly is the same for all nodes: so ranks are a sum of what walks
    of 0, 1, 2 … edges bring to a node from one at each node, times numbers that follow from the totals alone. A walk
    only has rows for nodes that it reaches, of which there are fewer and fewer where chains end.
    """
    edges = cut(edges.select("src", "dst").distinct())
    nodes = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = edges.groupBy(F.col("src").alias("of")).agg(F.count("*").alias("n"))
    share = cut(edges.join(out, edges["src"] == out["of"]).select("src", "dst", (1.0 / F.col("n")).alias("share")))
    walks, totals, step = [], [float(n)], share.select("dst", "share")
    for _ in range(passes):
        walk, seen = measured(
            step.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("u")), n=F.count(F.lit(1)), all=F.coalesce(F.sum("u"), F.lit(0.0))
        )
        totals.append(seen["all"])
        if not seen["n"]:
            break
        walks.append(walk)
        step = with_vertex(share, "src", walk, None, seen["n"]).select("dst", (F.col("share") * F.col("u")).alias("share"))
    totals += [0.0] * (passes + 1 - len(totals))
    # what a walk loses is what its nodes with an edge out don't hand on
    parts = [1.0 / n]
    for _ in range(passes):
        lost = sum(c * (totals[k] - totals[k + 1]) for k, c in enumerate(parts))
        parts = [(1 - damping + damping * lost) / n, *[damping * c for c in parts]]
    rank = nodes.select("id", F.lit(parts[0]).alias("rank"))
    for c, walk in zip(parts[1:], walks):
        rank = rank.unionByName(walk.select("id", (F.col("u") * c).alias("rank")))
    return rank.groupBy("id").agg(F.round(F.sum("rank"), 12).alias("rank"))


def label_propagation(edges: DataFrame, rounds: int = LABEL_ROUNDS) -> DataFrame:
    """(id, label): each node takes the most frequent label around it, the smallest of equals.

    Half of the nodes (by a digit of their digest) move in each half-round, so two nodes can't swap forever.
    """
    pairs = single(edges)
    # edges lie by the vertex that counts votes, hubs in several parts
    both = cut(undirected(cut(pairs)).hint("rebalance", F.col("src")))
    degrees = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    degrees, seen = measured(degrees, nodes=F.count(F.lit(1)), edges=F.coalesce(F.sum("n"), F.lit(0)), most=F.coalesce(F.max("n"), F.lit(0)))
    hot = cut(hot_vertices(degrees, seen["edges"]).select("id")) if seen["most"] > HOT_EDGES else None
    labels = degrees.select("id", F.col("id").alias("label"))
    for k in range(rounds):
        before = labels
        for half in (0, 1):
            # only votes for vertices that move are counted
            moves = (F.left(F.md5(F.col("src").cast("string")), F.lit(1)) < "8") == (half == 0)
            votes = with_vertex(both.filter(moves), "dst", labels, hot, seen["nodes"]).groupBy("src", "label").agg(F.count("*").alias("n"))
            best = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("new"))
            labels = labels.join(best, labels["id"] == best["src"], "left").select("id", F.coalesce("new", "label").alias("label"))
        labels = cut(labels)
        if not labels.join(before.withColumnRenamed("label", "old"), "id").filter("label != old").limit(1).count():
            break
    return labels


def breadth_first(edges: DataFrame, start, depth: int) -> DataFrame:
    """(id, hop) of what is reached over outgoing edges (src, dst) within ``depth`` hops."""
    seen = edges.sparkSession.createDataFrame([(start, 0)], edges.select(F.col("src").alias("id"), F.lit(0).alias("hop")).schema)
    front = seen
    for hop in range(1, depth + 1):
        front = (
            edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
            .join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        )
        front = cut(front)
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, start, longest: int) -> DataFrame:
    """(nodes, length): undirected paths of 1 to ``longest`` edges from a node, no edge used twice."""
    marked = edges.select("src", "dst").distinct()
    both = undirected(marked.withColumn("edge", F.struct("src", "dst")))
    step = both.filter(F.col("src") == start).select(F.array("src", "dst").alias("nodes"), F.array("edge").alias("edges"))
    found = step
    for _ in range(longest - 1):
        last = step.withColumn("at", F.element_at("nodes", -1))
        step = (
            last.join(both, last["at"] == both["src"]).filter(~F.array_contains("edges", F.col("edge")))
            .select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"))
        )
        found = found.unionByName(step)
    return found.select("nodes", (F.size("nodes") - 1).alias("length"))


def shortest_paths(edges: DataFrame, left, right, longest: int = 8, count: int = 1) -> DataFrame:
    """(nodes, length): the ``count`` shortest undirected simple paths between two nodes, of at most ``longest`` hops.

    Lengths are tried upwards from the distance of the two until there are enough paths. For one
    length, partial paths grow hop by hop and only by nodes that can still arrive in time. Paths of a
    length come in the order of their nodes, so only the first partial paths of each hop are grown,
    and more of them only where these don't lead to enough paths.
    """
    both = cut(undirected(edges.select("src", "dst").filter("src != dst").distinct()).distinct())
    reach = breadth_first(both, right, longest).select(F.col("id").alias("dst"), F.col("hop").alias("left_hops"))
    reach = cut(reach)
    need = reach.filter(F.col("dst") == left).first()
    if need is None:
        return both.select(F.array("src").alias("nodes"), F.lit(0).alias("length")).limit(0)
    found, held = None, 0
    for length in range(need["left_hops"], longest + 1):
        most, more = PREFIXES * count, True
        while more:
            now, rows, more = _paths_of(both, reach, left, length, most)
            more = more and held + rows < count
            most *= 8
        now = now.withColumn("length", F.lit(length))
        found = now if found is None else found.unionByName(now)
        found, seen = measured(found.orderBy("length", "nodes").limit(count), n=F.count(F.lit(1)))
        held = seen["n"]
        if held >= count:
            break
    return found.orderBy("length", "nodes")


def _paths_of(both: DataFrame, reach: DataFrame, left, length: int, most: int) -> tuple[DataFrame, int, bool]:
    """Paths of one length from the first ``most`` partial paths of each hop, their number, and whether any were left out."""
    now, rows, left_out = both.sparkSession.range(1).select(F.array(F.lit(left)).alias("nodes")), 1, False
    for hop in range(1, length + 1):
        at = now.withColumn("src", F.element_at("nodes", -1))
        near = F.col("left_hops") <= length - hop
        # the end is reached with the last hop only
        near &= F.col("left_hops") == 0 if hop == length else F.col("left_hops") > 0
        grown = (
            at.join(both, "src").join(reach.filter(near), "dst").filter(~F.array_contains("nodes", F.col("dst")))
            .select(F.concat("nodes", F.array("dst")).alias("nodes"))
        )
        now, seen = measured(grown, n=F.count(F.lit(1)))
        rows = seen["n"]
        if rows > most and hop < length:
            now, left_out = cut(now.orderBy("nodes").limit(most)), True
    return now, rows, left_out


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, betweenness): Brandes' dependencies summed over the given sources (id), all at once.

    Levels go forward with path counts until nothing new is reached, then back with dependencies, for
    some sources side by side in each task (:mod:`pathblocks`). Nodes are numbered by their components, so that
    a search stays near its source. Work grows with sources times the edges around their levels: on a
    large graph use :func:`sampled_betweenness`.
    """
    once = cut(single(edges))
    nodes, _ = numbered(connected_components(once).orderBy("component", "id"))
    spans = nodes.groupBy("component").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    places = sources.select("id").distinct().join(nodes, "id").join(spans, "component").select("number", "lo", "hi")
    places, seen = measured(places, n=F.count(F.lit(1)), cells=F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)))
    if not seen["n"]:
        return sources.select("id", F.lit(0.0).alias("betweenness"))
    found = pathblocks.dependencies(once, nodes, places, seen["n"], seen["cells"])
    return nodes.join(found, "number").select("id", F.col("dep").alias("betweenness"))


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``number`` from 0 without gaps, and how many there are; only a count for each partition is gathered."""
    rows = cut(rows)
    at = rows.withColumn("at", F.monotonically_increasing_id())
    part, before, offsets = F.shiftright("at", 33), 0, []
    for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per partition
        offsets += [F.lit(r["part"]), F.lit(before)]
        before += r["n"]
    if not before:
        return rows.withColumn("number", F.lit(0).cast("long")), 0
    place = F.element_at(F.create_map(*offsets), part) + F.col("at").bitwiseAND((1 << 33) - 1)
    return cut(at.withColumn("number", place.cast("long")).drop("at")), before


def sampled_betweenness(edges: DataFrame, error: float = 0.01, risk: float = 0.1, seed: int = 1) -> tuple[DataFrame, float]:
    """(id, betweenness) from sampled shortest paths, and a bound of its error that holds but for ``risk``.

    Pairs of nodes are drawn, and of each pair one of its shortest paths, all alike; a node's share of
    paths that lead through it estimates its betweenness. Samples double until, for all nodes at
    once, the empirical Bernstein bound of that share is at most ``error``. Rows grow with samples times
    nodes that a search meets before its target, never with the square of the nodes. Pairs that no path
    joins are known by their components and not searched for.
    """
    once = cut(single(edges))
    both = cut(undirected(once))
    nodes, n = numbered(connected_components(once).orderBy("component", "id"))
    if n < 3:
        return nodes.select("id", F.lit(0.0).alias("betweenness")), 0.0
    hits, drawn, rounds = None, 0, 0
    size = max(16, math.ceil(3 * math.log(3 * n / risk) / error / 4))
    while True:
        rounds += 1
        through = _paths_through(both, nodes, n, drawn, size, seed)
        hits = through if hits is None else hits.unionByName(through)
        hits = cut(hits.groupBy("id").agg(F.sum("times").alias("times")))
        drawn, size = drawn + size, drawn + size
        most = hits.agg(F.max(F.col("times") * (drawn - F.col("times")))).first()[0] or 0
        # the risk is shared by nodes and by the bounds of all rounds
        odds = math.log(3 * n * rounds * (rounds + 1) / risk)
        reach = math.sqrt(2 * most / drawn**2 * odds / drawn) + 3 * odds / drawn
        if reach <= error:
            break
    pairs = n * (n - 1)
    share = F.coalesce("times", F.lit(0)) * (pairs / drawn)
    return nodes.select("id").join(hits, "id", "left").select("id", share.alias("betweenness")), reach * pairs


def _paths_through(both: DataFrame, nodes: DataFrame, n: int, first: int, size: int, seed: int) -> DataFrame:
    """(id, times): inner nodes of one shortest path for each of ``size`` drawn pairs.

    A search goes from both ends, a level at a time from the end whose last level has fewer edges, until the
    levels meet: nodes of the last two levels that are the same lie on shortest paths, one on each.
    """
    draw = lambda k: F.pmod(F.xxhash64("s", F.lit(k), F.lit(seed)), F.lit(n if k == 1 else n - 1))
    pairs = nodes.sparkSession.range(first, first + size).withColumnRenamed("id", "s").withColumns({"a": draw(1), "b": draw(2)})
    pairs = pairs.withColumn("b", F.when(F.col("b") >= F.col("a"), F.col("b") + 1).otherwise(F.col("b")))  # another node
    # of nodes of known components only pairs of one are joined by a path
    part = F.col("component") if "component" in nodes.columns else F.lit(0)
    named = lambda k, name: nodes.select(F.col("number").alias(k), F.col("id").alias(name), part.alias(f"{k}_part"))
    pairs = cut(pairs.join(named("a", "v"), "a").join(named("b", "target"), "b").filter("a_part = b_part").select("s", "v", "target"))
    degrees = cut(both.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("edges")))
    ends = pairs.select("s", F.lit(0).alias("side"), "v").unionByName(pairs.select("s", F.lit(1).alias("side"), F.col("target").alias("v")))
    front = cut(ends.join(degrees, "v").select("s", "side", F.lit(0).alias("depth"), "v", F.lit(1.0).alias("paths"), "edges"))
    levels, found = [front], None
    # of nodes that shortest paths choose from, one in proportion to its paths: the least of as many exponential draws
    chance = lambda k, v, paths: -F.log((F.pmod(F.xxhash64("s", v, F.lit(seed + k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / paths
    while True:
        turn = front.groupBy("s", "side").agg(F.sum("edges").alias("e")).groupBy("s").agg(F.min_by("side", F.struct("e", "side")).alias("turn"))
        last = cut(front.join(turn, "s"))
        seen = None
        for level in levels:
            seen = level.select("s", "side", "v") if seen is None else seen.unionByName(level.select("s", "side", "v"))
        level, grown = measured(
            last.filter("side = turn").join(both, F.col("v") == both["src"])
            .groupBy("s", "side", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"), (F.max("depth") + 1).alias("depth"))
            .join(seen, ["s", "side", "v"], "left_anti").join(degrees, "v").select(*front.columns), n=F.count(F.lit(1)),
        )
        if not grown["n"]:
            break
        levels.append(level)
        other = last.filter("side != turn").drop("turn")
        opposite = other.select("s", "v", F.col("depth").alias("rest"), F.col("paths").alias("ways"))
        met = cut(
            level.join(opposite, ["s", "v"]).groupBy("s")
            .agg(F.min_by(F.struct("side", "depth", "rest", "v"), chance(7, "v", F.col("paths") * F.col("ways"))).alias("m")).select("s", "m.*")
        )
        found = met if found is None else found.unionByName(met)
        # a search ends where the levels met or nothing new was reached
        front = other.unionByName(level).join(level.select("s").distinct(), "s", "left_semi").join(met.select("s"), "s", "left_anti")
        front, left = measured(front, n=F.count(F.lit(1)))
        if not left["n"]:
            break
    if found is None:
        return nodes.select("id", F.lit(0).cast("long").alias("times")).limit(0)
    kept = levels[0]
    for level in levels[1:]:
        kept = kept.unionByName(level)
    before = kept.select("s", "side", F.col("depth").alias("next"), F.col("v").alias("dst"), "paths")
    inner = [found.filter("depth > 0 and rest > 0").select("v")]
    at = found.select("s", "side", "depth", "v").unionByName(found.select("s", (1 - F.col("side")).alias("side"), F.col("rest").alias("depth"), "v"))
    while True:
        ahead = at.filter("depth > 1").select("s", "side", (F.col("depth") - 1).alias("next"), "v")
        step = ahead.join(both, F.col("v") == both["src"]).join(before, ["s", "side", "next", "dst"])
        at, seen = measured(
            step.groupBy("s", "side", F.col("next").alias("depth")).agg(F.min_by("dst", chance(8, "dst", F.col("paths"))).alias("v")), n=F.count(F.lit(1))
        )
        if not seen["n"]:
            break
        inner.append(at.select("v"))
    every = inner[0]
    for some in inner[1:]:
        every = every.unionByName(some)
    return every.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("times"))
