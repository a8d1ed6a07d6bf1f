"""Path operators: breadth-first loops over frontiers, hop and weighted shortest paths, PageRank.

One loop serves all: a frontier of (start, vertex) expands by one shuffle join with the edges, is reduced to distinct
pairs, and meets only pairs not visited before. Each round is written to the shared folder, so that the plan does not
grow and a lost executor costs no recomputation. Loops end on an empty frontier or at the depth asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.graph import PropertyGraph
from filigree.session import checkpoint, rounds

EARTH_RADIUS_M = 6_371_000.0


def hops(g: PropertyGraph, direction: str = "out", edge_type: str | None = None, weight: str | None = None) -> DataFrame:
    """(from, to, edge, w): the steps a path may take; a missing weight is 1.0, a boolean 0 or 1."""
    e = g.edges if edge_type is None else g.edges.filter(F.col("type") == edge_type)
    w = F.lit(1.0) if weight is None or weight not in e.columns else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    e = e.select("src", "dst", F.col("id").alias("edge"), w.alias("w"))
    out = e.select(F.col("src").alias("from"), F.col("dst").alias("to"), "edge", "w")
    if direction == "out":
        return out
    back = (e.filter("src <> dst") if direction == "both" else e).select(F.col("dst").alias("from"), F.col("src").alias("to"), "edge", "w")
    return back if direction == "in" else out.unionByName(back)


def bfs(g: PropertyGraph, starts: DataFrame, max_depth: int, direction: str = "out", edge_type: str | None = None, include_start: bool = False) -> DataFrame:
    """(start, end, depth): every vertex reached from each start at its least depth, 1 to max_depth, the start excluded."""
    steps = hops(g, direction, edge_type).select("from", "to").distinct()
    own = starts.select("start", F.col("start").alias("end"), F.lit(0).alias("depth"))
    visited = frontier = checkpoint(own)
    for depth in range(1, max_depth + 1):
        reached = frontier.join(steps, frontier["end"] == steps["from"]).select("start", F.col("to").alias("end")).distinct()
        frontier = checkpoint(reached.join(visited.select("start", "end"), ["start", "end"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited if include_start else visited.filter("depth > 0")


def _halves(g: PropertyGraph, sources: DataFrame, targets: DataFrame, max_depth: int, direction: str, edge_type: str | None) -> tuple[DataFrame, DataFrame]:
    """(source, mid, a) and (target, mid, b): what each end reaches in half the depth, itself included."""
    back = {"out": "in", "in": "out", "both": "both"}[direction]
    half = (max_depth + 1) // 2
    ahead = bfs(g, sources.select(F.col("source").alias("start")).distinct(), half, direction, edge_type, True)
    behind = bfs(g, targets.select(F.col("target").alias("start")).distinct(), max_depth - half, back, edge_type, True)
    return ahead.select(F.col("start").alias("source"), F.col("end").alias("mid"), F.col("depth").alias("a")), behind.select(F.col("start").alias("target"), F.col("end").alias("mid"), F.col("depth").alias("b"))


def _least(met: DataFrame) -> DataFrame:
    """The middle of a shortest path lies as deep from both ends, or one deeper from its source; no other meeting counts."""
    return met.filter("a - b in (0, 1)").groupBy("source", "target").agg(F.min(F.col("a") + F.col("b")).alias("distance"))


def shortest_paths(g: PropertyGraph, pairs: DataFrame, max_depth: int, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """(source, target, distance) in hops of the given pairs, met from both ends; unreachable pairs drop out.

    Each end is searched to half the depth. For all pairs of two sets of vertices use ``shortest_between``.
    """
    ahead, behind = _halves(g, pairs, pairs, max_depth, direction, edge_type)
    return _least(pairs.select("source", "target").distinct().join(ahead, "source").join(behind, ["target", "mid"]))


def shortest_between(g: PropertyGraph, sources: DataFrame, targets: DataFrame, max_depth: int, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """(source, target, distance) in hops from every one of sources(source) to every one of targets(target) in reach.

    The halves meet in the middle; pairs that no path links are never made.
    """
    ahead, behind = _halves(g, sources, targets, max_depth, direction, edge_type)
    return _least(ahead.join(behind, "mid"))


def weighted_paths(g: PropertyGraph, sources: DataFrame, weight: str, direction: str = "out", edge_type: str | None = None, max_distance: float | None = None, targets: DataFrame | None = None, max_rounds: int | None = None, potential: DataFrame | None = None) -> DataFrame:
    """(source, target, distance, via_edge, previous): least sums of weights, with the last step of a least path.

    Relaxation to the fixed point: only vertices whose distance fell go on. Negative weights are errors. Candidates
    above max_distance are cut; with ``potential`` (target, bound), a lower bound of what is left, those whose sum
    exceeds max_distance are cut as well, which is all an admissible heuristic changes. Ties go to the smaller edge.
    With ``max_rounds``, a search that needs more is an error.
    """
    steps = hops(g, direction, edge_type, weight)
    if steps.filter("w < 0").limit(1).count():
        raise ValueError("a weighted path needs weights of 0 or more")
    steps = checkpoint(steps)
    best = checkpoint(sources.select("source", F.col("source").alias("target"), F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("via_edge"), F.lit(None).cast("long").alias("previous")).distinct())
    frontier = best
    for _ in rounds(max_rounds):
        moved = frontier.select("source", F.col("target").alias("from"), F.col("distance").alias("d")).join(steps, "from")
        moved = moved.select("source", F.col("to").alias("target"), (F.col("d") + F.col("w")).alias("distance"), F.col("edge").alias("via_edge"), F.col("from").alias("previous"))
        if max_distance is not None:
            moved = moved.filter(F.col("distance") <= max_distance)
            if potential is not None:
                moved = moved.join(potential, "target").filter(F.col("distance") + F.greatest("bound", F.lit(0.0)) <= max_distance).drop("bound")
        least = moved.groupBy("source", "target").agg(F.min(F.struct("distance", "via_edge", "previous")).alias("m")).select("source", "target", "m.*")
        known = best.select("source", "target", F.col("distance").alias("old"))
        frontier = checkpoint(least.join(known, ["source", "target"], "left").filter(F.col("old").isNull() | (F.col("distance") < F.col("old"))).drop("old"))
        if frontier.isEmpty():
            break
        best = checkpoint(best.join(frontier.select("source", "target"), ["source", "target"], "left_anti").unionByName(frontier))
    return best if targets is None else best.join(targets, [c for c in ("source", "target") if c in targets.columns], "left_semi")


def path_of(tree: DataFrame, source: int, target: int) -> tuple[list[int], list[int]]:
    """(vertices, edges) of the least path found by ``weighted_paths``, read back step by step by the driver."""
    vertices, edges = [target], []
    while vertices[-1] != source:
        row = tree.filter((F.col("source") == source) & (F.col("target") == vertices[-1])).head()
        if row is None:
            return [], []
        edges.append(row.via_edge)
        vertices.append(row.previous)
    return vertices[::-1], edges[::-1]


def euclidean(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def coordinate_potential(g: PropertyGraph, target: int, x: str, y: str, kind: str = "euclidean", scale: float = 1.0) -> DataFrame:
    """(target, bound): the straight distance of every vertex to the goal; a missing coordinate is an error."""
    if g.vertices.filter(F.col(x).isNull() | F.col(y).isNull()).limit(1).count():
        raise ValueError("a vertex lacks a coordinate")
    goal = g.vertices.filter(F.col("id") == target).select(x, y).head()
    far = euclidean if kind == "euclidean" else haversine
    bound = far(F.col(x), F.col(y), F.lit(float(goal[0])), F.lit(float(goal[1])))
    return g.vertices.select(F.col("id").alias("target"), (bound * scale).alias("bound"))


def frontier_limit(reached: DataFrame, n: int) -> DataFrame:
    """At most n rows of each start and depth, by id."""
    order = Window.partitionBy("start", "depth").orderBy("end")
    return reached.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def pagerank(g: PropertyGraph, damping: float = 0.85, iterations: int = 20, edge_type: str | None = None) -> DataFrame:
    """(id, rank) summing to 1; what vertices without out-edges hold is spread evenly. Parallel edges count each."""
    e = g.edges if edge_type is None else g.edges.filter(F.col("type") == edge_type)
    links = checkpoint(e.groupBy("src", "dst").agg(F.count("*").alias("m")))
    degree = links.groupBy("src").agg(F.sum("m").alias("out"))
    nodes = checkpoint(g.vertices.select("id").distinct().join(degree.withColumnRenamed("src", "id"), "id", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(iterations):
        idle = ranks.filter("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        flow = ranks.filter("out is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("each"))
        into = links.join(flow, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("each") * F.col("m")).alias("into"))
        rank = (1 - damping) / n + damping * (F.coalesce("into", F.lit(0.0)) + idle / n)
        ranks = checkpoint(nodes.join(into, "id", "left").select("id", "out", rank.alias("rank")))
    return ranks.select("id", "rank")
