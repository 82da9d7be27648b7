"""Weighted directed networks as one edge table (net_id, src, dst, w): features of all networks in the same jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frontrank.functions import EPS_GRAPH, pearson
from frontrank.sources.tables import Scratch, materialized

NET = "net_id"


def positive_weights(weights: DataFrame) -> DataFrame:
    return weights.filter("weight > 0")


def normalized_weights(weights: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Weights of each network; divided by their sum where it is off 1 by more than tolerance."""
    total = F.sum("weight").over(Window.partitionBy(NET))
    return weights.withColumn("weight", F.col("weight") / F.when(F.abs(total - 1) > tolerance, total).otherwise(1.0))


def consensus(weights: DataFrame, base: DataFrame) -> DataFrame:
    """Weighted mean network of each candidate. Repeated edges of a base network are averaged; absent edges count 0."""
    once = base.groupBy("technique", "src", "dst").agg(F.avg("w").alias("w"))
    used = normalized_weights(normalized_weights(positive_weights(weights)), 0.01)
    return used.join(once, "technique").groupBy(NET, "src", "dst").agg(F.sum(F.col("weight") * F.col("w")).alias("w"))


def graph(edges: DataFrame) -> DataFrame:
    """Edges with repeats added up; missing endpoints dropped, missing weights 0."""
    known = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    return known.groupBy(NET, "src", "dst").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("w"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(NET, F.col("src").alias("node")).union(edges.select(NET, "dst")).distinct()


def strengths(edges: DataFrame) -> DataFrame:
    """out_s, in_s and total_s of every node, 0 where it has no such edge."""
    ends = edges.select(NET, F.col("src").alias("node"), F.col("w").alias("o"), F.lit(0.0).alias("i")).union(edges.select(NET, "dst", F.lit(0.0), "w"))
    out = ends.groupBy(NET, "node").agg(F.sum("o").alias("out_s"), F.sum("i").alias("in_s"))
    return out.withColumn("total_s", F.col("out_s") + F.col("in_s"))


def gini(df: DataFrame, value: str, over: Sequence[str], name: str = "gini") -> DataFrame:
    """Gini coefficient of non-negative values in each group, 0 without mass."""
    w = Window.partitionBy(*over)
    placed = df.select(*over, F.col(value).alias("x"), F.row_number().over(w.orderBy(value)).alias("i"), F.count("*").over(w).alias("n"))
    out = placed.groupBy(*over).agg(F.max("n").alias("n"), F.sum("x").alias("total"), F.sum((F.col("n") - F.col("i") + 1) * F.col("x")).alias("cum"))
    value_ = (F.col("n") + 1 - 2 * F.col("cum") / F.col("total")) / F.col("n")
    return out.select(*over, F.when(F.col("total") <= 0, 0.0).otherwise(value_).alias(name))


def top_share(edges: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Share of all weight on the heaviest fraction of edges (at least one)."""
    w = Window.partitionBy(NET)
    placed = edges.withColumns({"i": F.row_number().over(w.orderBy(F.desc("w"), "src", "dst")), "n": F.count("*").over(w)})
    k = F.greatest(F.lit(1), F.floor(F.col("n") * fraction))
    return placed.groupBy(NET).agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("i") <= k, F.col("w")).otherwise(0.0)), F.sum("w")), F.lit(0.0)).alias("top_share"))


def global_features(edges: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Nodes, edges, total and mean weight, weighted density, weight Gini, share of the top edges."""
    n = nodes(edges).groupBy(NET).agg(F.count("*").alias("n_nodes"))
    base = edges.groupBy(NET).agg(F.count("*").alias("n_edges"), F.sum("w").alias("total_w"), F.avg("w").alias("mean_w"))
    joined = base.join(n, NET).join(gini(edges, "w", [NET], "weight_gini"), NET).join(top_share(edges, fraction), NET)
    return joined.withColumn("density", F.col("total_w") / F.greatest(F.col("n_nodes") * (F.col("n_nodes") - 1), F.lit(1)))


def strength_features(edges: DataFrame) -> DataFrame:
    """Mean, population std, max and Gini of out, in and total strength; hubs above mean + 2 std of total strength."""
    s = strengths(edges)
    aggs = [f(c).alias(f"{c}_{n}") for c in ("out_s", "in_s", "total_s") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max))]
    out = s.groupBy(NET).agg(*aggs)
    for c in ("out_s", "in_s", "total_s"):
        out = out.join(gini(s, c, [NET], f"{c}_gini"), NET)
    w = Window.partitionBy(NET)
    hub = s.withColumn("hub", (F.col("total_s") > F.avg("total_s").over(w) + 2 * F.stddev_pop("total_s").over(w)).cast("int"))
    return out.join(hub.groupBy(NET).agg(F.sum("hub").alias("hubs")), NET)


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation over edges of the source's out-strength with the target's in-strength; 0 where a side is constant."""
    s = strengths(edges)
    both = edges.join(s.select(NET, F.col("node").alias("src"), F.col("out_s").alias("x")), [NET, "src"]).join(s.select(NET, F.col("node").alias("dst"), F.col("in_s").alias("y")), [NET, "dst"])
    return both.groupBy(NET).agg(F.coalesce(pearson(F.col("x"), F.col("y")), F.lit(0.0)).alias("assortativity"))


def reciprocal(edges: DataFrame) -> DataFrame:
    """Edges whose reverse exists, with both weights."""
    back = edges.select(NET, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("back_w"))
    return edges.join(back, [NET, "src", "dst"])


def reciprocity(edges: DataFrame) -> DataFrame:
    """Shared weight of both directions over all weight; a self loop shares its own."""
    shared = reciprocal(edges).groupBy(NET).agg(F.sum(F.least("w", "back_w")).alias("shared"))
    total = edges.groupBy(NET).agg(F.sum("w").alias("total"))
    return total.join(shared, NET, "left").select(NET, F.coalesce(F.try_divide("shared", "total"), F.lit(0.0)).alias("reciprocity"))


def undirected(edges: DataFrame) -> DataFrame:
    """One weight for each pair a < b: that of the edge whose source comes later in the edge list by w, src, dst."""
    order = Window.partitionBy(NET).orderBy(F.desc("w"), "src", "dst")
    first = edges.withColumn("at", F.row_number().over(order)).groupBy(NET, "src").agg(F.min("at").alias("first_at"))
    known = edges.filter("src <> dst").join(first, [NET, "src"])
    pair = known.groupBy(NET, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pair.agg(F.max_by("w", "first_at").alias("w"))


def clustering(edges: DataFrame) -> DataFrame:
    """Mean weighted clustering: geometric mean of a triangle's weights over the largest weight (Onnela et al. 2005).

    Edges point from the node of fewer edges to that of more, and only two edges out of one node make a wedge: a hub
    makes none with its leaves, and m edges make m ** 1.5 wedges at most.
    """
    u = undirected(edges)
    top = edges.groupBy(NET).agg(F.max("w").alias("top"))
    scaled = u.join(top, NET).select(NET, "a", "b", F.cbrt(F.col("w") / F.col("top")).alias("g"))
    degree = u.select(NET, F.explode(F.array("a", "b")).alias("node")).groupBy(NET, "node").agg(F.count("*").alias("d"))
    ranks = [degree.select(NET, F.col("node").alias(side), F.struct("d", "node").alias(f"r{side}")) for side in ("a", "b")]
    placed = scaled.join(ranks[0], [NET, "a"]).join(ranks[1], [NET, "b"])
    order = placed.select(NET, F.least("ra", "rb").alias("lo"), F.greatest("ra", "rb").alias("hi"), "g")
    two = order.select(NET, "lo", F.col("hi").alias("far"), F.col("g").alias("g2"))
    third = order.select(NET, F.col("lo").alias("hi"), F.col("hi").alias("far"), F.col("g").alias("g3"))
    wedges = order.join(two, [NET, "lo"]).filter("hi < far")
    triangles = wedges.join(third, [NET, "hi", "far"]).select(NET, F.col("lo.node").alias("a"), F.col("hi.node").alias("b"), F.col("far.node").alias("c"), (F.col("g") * F.col("g2") * F.col("g3")).alias("t"))
    at = triangles.select(NET, F.explode(F.array("a", "b", "c")).alias("node"), "t").groupBy(NET, "node").agg(F.sum("t").alias("t"))
    each = nodes(edges).join(degree, [NET, "node"], "left").join(at, [NET, "node"], "left")
    value = F.when(F.col("d") >= 2, 2 * F.coalesce("t", F.lit(0.0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return each.groupBy(NET).agg(F.avg(value).alias("clustering"))


def entropy(df: DataFrame, value: str, over: Sequence[str], name: str) -> DataFrame:
    """Entropy of shares value / (sum + 1e-9), positive shares only."""
    share = df.withColumn("p", F.col(value) / (F.sum(value).over(Window.partitionBy(*over)) + EPS_GRAPH))
    return share.groupBy(*over).agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias(name))


def entropies(edges: DataFrame) -> DataFrame:
    return entropy(edges, "w", [NET], "edge_entropy").join(entropy(strengths(edges), "total_s", [NET], "node_entropy"), NET)


def _spread(edges: DataFrame, labels: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Smallest label that reaches each node along edges, by rounds of joins until nothing changes.

    A label is the hash and name of a node, and what reaches that node reaches all that have its label: each round also
    takes over the label of one's label, so that a label goes twice as far each time along a path. Hashes, as a path whose
    names rise or fall would otherwise have the small labels wait at each step.
    """
    current = scratch.turn(labels, name)
    while True:
        reached = edges.join(current.select(NET, F.col("node").alias("src"), "label"), [NET, "src"]).groupBy(NET, F.col("dst").alias("node")).agg(F.min("label").alias("l"))
        jumped = current.select(NET, F.col("node").alias("__at"), F.col("label").alias("j"))
        both = current.withColumn("__at", F.col("label.name")).join(reached, [NET, "node"], "left").join(jumped, [NET, "__at"], "left")
        new = scratch.turn(both.select(NET, "node", F.least("label", "l", "j").alias("label"), (F.least("l", "j") < F.col("label")).alias("moved")), name)
        if new.filter("moved").isEmpty():
            return new.drop("moved")
        current = new.drop("moved")


def _hanging(edges: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(net, node): nodes that no cycle can hold, as the only way into them starts at a node without a way in.

    A node with a single edge in points at its source; pointers double until they end at a node with none or several.
    """
    way = edges.groupBy(NET, F.col("dst").alias("node")).agg(F.min("src").alias("up"), F.count("*").alias("n"))
    start = members.join(way, [NET, "node"], "left").select(NET, "node", F.when(F.col("n") == 1, F.col("up")).alias("up"), F.col("n").isNull().alias("free"))
    current = scratch.turn(start, "hanging")
    while True:  # log2 of the longest chain; what is left pointing when nothing more is freed or ended lies on or behind a cycle
        above = current.select(NET, F.col("node").alias("up"), F.col("up").alias("next"), F.col("free").alias("freed"))
        new = current.join(above, [NET, "up"], "left").select(NET, "node", F.col("next").alias("up"), (F.col("free") | F.coalesce("freed", F.lit(False))).alias("free"), F.col("up").isNotNull().alias("open"))
        new = scratch.turn(new, "hanging")
        now = new.agg(F.count_if("open")).first()[0]
        if now == 0 or now == new.agg(F.count_if(F.col("up").isNotNull())).first()[0]:
            return new.filter("free").select(NET, "node")
        current = new.drop("open")


def strong_components(edges: DataFrame) -> DataFrame:
    """(net, node, component): strongly connected components of all networks at once.

    In each round, nodes that hang from or end in chains leave as components of their own; the others take the smallest
    label that reaches them forwards and backwards. Where both agree the node belongs to that label's component, named by
    its smallest node, and leaves. Rounds go on until no node is left. Chains and cycles of any length take rounds by their logarithm.
    """
    turned = lambda e: e.select(NET, F.col("dst").alias("src"), F.col("src").alias("dst"))

    def without(e: DataFrame, gone: DataFrame) -> DataFrame:
        return e.join(gone.withColumnRenamed("node", "src"), [NET, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [NET, "dst"], "left_anti")

    with Scratch(edges.sparkSession) as scratch:
        left = scratch.turn(edges.filter("src <> dst").select(NET, "src", "dst").distinct(), "left")
        rest = scratch.turn(nodes(edges), "rest")
        done = materialized(rest.limit(0).withColumn("component", F.col("node")), "components")
        parts = [done]
        while not rest.isEmpty():
            for way in (lambda e: e, turned):
                lone = materialized(_hanging(way(left), rest, scratch).withColumn("component", F.col("node")), "components")
                parts.append(lone)
                rest = scratch.turn(rest.join(lone, [NET, "node"], "left_anti"), "rest")
                left = scratch.turn(without(left, lone.select(NET, "node")), "left")
            if rest.isEmpty():
                break
            start = rest.withColumn("label", F.struct(F.xxhash64("node").alias("hash"), F.col("node").alias("name")))
            ahead = _spread(left, start, scratch, "ahead").withColumnRenamed("label", "f")
            behind = _spread(turned(left), start, scratch, "behind").withColumnRenamed("label", "b")
            both = scratch.turn(ahead.join(behind, [NET, "node"]), "both")
            found = both.filter("f = b").select(NET, "node", F.col("f.name").alias("at"))
            first = found.groupBy(NET, "at").agg(F.min("node").alias("component"))
            parts.append(materialized(found.join(first, [NET, "at"]).select(NET, "node", "component"), "components"))
            rest = scratch.turn(both.filter("f <> b").select(NET, "node"), "rest")
            # nodes of one component share both labels, so no cycle goes over edges between others
            marks = both.filter("f <> b")
            ends = left.join(marks.select(NET, F.col("node").alias("src"), F.col("f").alias("fs"), F.col("b").alias("bs")), [NET, "src"]).join(marks.select(NET, F.col("node").alias("dst"), F.col("f").alias("ft"), F.col("b").alias("bt")), [NET, "dst"])
            left = scratch.turn(ends.filter("fs = ft AND bs = bt").select(NET, "src", "dst"), "left")
        return reduce(DataFrame.unionByName, parts)


def largest_component(components: DataFrame) -> DataFrame:
    """Nodes of each network's largest component; of equal ones that with the smallest label."""
    size = components.groupBy(NET, "component").agg(F.count("*").alias("n"))
    best = size.withColumn("i", F.row_number().over(Window.partitionBy(NET).orderBy(F.desc("n"), "component"))).filter("i = 1").select(NET, "component", "n")
    return components.join(best, [NET, "component"])


def inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members (net, node)."""
    own = members.select(NET, "node")
    return edges.join(own.withColumnRenamed("node", "src"), [NET, "src"], "left_semi").join(own.withColumnRenamed("node", "dst"), [NET, "dst"], "left_semi")


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(net, src, dst, d) over paths of distance 1 / (w + 1e-9).

    Min-plus relaxation from a frontier: only pairs that got shorter in the last round are carried on by an edge, and the
    rounds end when no pair does. Distances are compared as they are.
    """
    step = edges.filter("src <> dst").groupBy(NET, F.col("src").alias("via"), "dst").agg(F.min(1 / (F.col("w") + EPS_GRAPH)).alias("step"))
    with Scratch(edges.sparkSession) as scratch:
        step = scratch.turn(step, "steps")
        current = scratch.turn(step.select(NET, F.col("via").alias("src"), "dst", F.col("step").alias("d"), F.lit(True).alias("shorter")), "paths")
        while not current.filter("shorter").isEmpty():
            front = current.filter("shorter").select(NET, "src", F.col("dst").alias("via"), "d")
            longer = front.join(step, [NET, "via"]).filter("src <> dst").groupBy(NET, "src", "dst").agg(F.min(F.col("d") + F.col("step")).alias("n"))
            both = current.drop("shorter").join(longer, [NET, "src", "dst"], "full")
            current = scratch.turn(both.select(NET, "src", "dst", F.least("d", "n").alias("d"), F.coalesce(F.col("n") < F.col("d"), F.col("d").isNull()).alias("shorter")), "paths")
        scratch.keep("paths")
        return current.drop("shorter")


def path_features(edges: DataFrame) -> DataFrame:
    """Mean and 95th percentile of shortest paths inside the largest strong component."""
    paths = shortest_paths(inside(edges, largest_component(strong_components(edges))))
    return paths.groupBy(NET).agg(F.avg("d").alias("path_mean"), F.percentile("d", F.lit(0.95)).alias("path_p95"))


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Weighted modularity of parts (net, node, part), both directions of an edge added (Blondel et al. 2008)."""
    a = parts.select(NET, F.col("node").alias("src"), F.col("part").alias("ps"))
    b = parts.select(NET, F.col("node").alias("dst"), F.col("part").alias("pd"))
    known = edges.join(a, [NET, "src"]).join(b, [NET, "dst"])
    total = edges.groupBy(NET).agg(F.sum("w").alias("m"))
    own = known.filter("ps = pd").groupBy(NET, F.col("ps").alias("part")).agg(F.sum("w").alias("own"))
    degree = strengths(edges).join(parts, [NET, "node"]).groupBy(NET, "part").agg(F.sum("total_s").alias("deg"))
    each = degree.join(own, [NET, "part"], "left").join(total, NET)
    return each.groupBy(NET).agg(F.sum(F.coalesce("own", F.lit(0.0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), F.lit(2))).alias("modularity"))


def communities(edges: DataFrame) -> DataFrame:
    """(net, node, part) by Louvain: nodes move to neighbouring parts, then parts become nodes, until nothing moves any more."""
    with Scratch(edges.sparkSession) as scratch:
        return _levels(edges, scratch)


def _levels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    parts = scratch.turn(nodes(edges).withColumn("part", F.col("node")), "levels")
    while True:
        found = moved_nodes(edges, scratch)
        if found.filter("node <> part").isEmpty():
            scratch.keep("levels")
            return parts
        step = found.select(NET, F.col("part").alias("to"), F.col("node").alias("part"))
        parts = scratch.turn(parts.join(step, [NET, "part"]).select(NET, "node", F.col("to").alias("part")), "levels")
        a, b = (found.withColumnsRenamed({"node": side, "part": f"p_{side}"}) for side in ("src", "dst"))
        between = edges.join(a, [NET, "src"]).join(b, [NET, "dst"]).groupBy(NET, F.col("p_src").alias("src"), F.col("p_dst").alias("dst"))
        edges = scratch.turn(between.agg(F.sum("w").alias("w")), "contracted")


def moved_nodes(edges: DataFrame, scratch: Scratch, every: int = 8) -> DataFrame:
    """(net, node, part) by moving nodes to the neighbouring part of the largest modularity gain.

    In a round only nodes whose hash parity matches may move, so that neighbours don't swap for ever; a node moves only
    for a positive gain, ties go to the smallest part. Ends when two rounds in a row move nothing, or when the sum of
    modularities hasn't grown in `every` rounds, which are then undone.
    """
    sym = edges.filter("src <> dst").select(NET, "src", "dst", "w").union(edges.filter("src <> dst").select(NET, "dst", "src", "w"))
    sym = scratch.turn(sym.groupBy(NET, "src", "dst").agg(F.sum("w").alias("w")), "sym")
    degree = scratch.turn(strengths(edges).select(NET, "node", F.col("total_s").alias("deg")), "degree")
    total = scratch.turn(edges.groupBy(NET).agg(F.sum("w").alias("m")), "total")
    parts, still = scratch.turn(degree.select(NET, "node", F.col("node").alias("part")), "parts"), 0
    best_parts, height = parts, None
    for turn in count():
        if turn % every == 0:
            now = modularity(edges, parts).agg(F.sum("modularity")).first()[0] or 0.0
            if height is not None and now <= height + 1e-12:
                return best_parts
            best_parts, height = scratch.turn(parts, "best"), now
        mass = parts.join(degree, [NET, "node"]).groupBy(NET, "part").agg(F.sum("deg").alias("mass"))
        links = sym.join(parts.withColumnRenamed("node", "dst"), [NET, "dst"]).groupBy(NET, F.col("src").alias("node"), "part").agg(F.sum("w").alias("to"))
        own = parts.withColumnRenamed("part", "now").join(degree, [NET, "node"]).join(total, NET)
        seen = links.join(own, [NET, "node"]).join(mass, [NET, "part"])
        without = F.col("mass") - F.when(F.col("part") == F.col("now"), F.col("deg")).otherwise(0.0)
        gain = F.col("to") / F.col("m") - F.col("deg") * without / (2 * F.col("m") * F.col("m"))
        best = seen.withColumn("gain", gain).groupBy(NET, "node", "now").agg(F.max(F.struct(F.col("gain"))).alias("top"), F.max(F.when(F.col("part") == F.col("now"), F.col("gain"))).alias("stay"), F.min_by("part", F.struct(-F.col("gain"), F.col("part"))).alias("to"))
        may = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
        alone = own.join(mass.withColumnRenamed("part", "now"), [NET, "now"]).select(NET, "node", (-F.col("deg") * (F.col("mass") - F.col("deg")) / (2 * F.col("m") * F.col("m"))).alias("zero"))
        moved = best.join(alone, [NET, "node"]).filter(may & (F.col("top.gain") > F.coalesce("stay", "zero") + 1e-12) & (F.col("to") != F.col("now"))).select(NET, "node", "to")
        new = scratch.turn(parts.join(moved, [NET, "node"], "left").select(NET, "node", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("moved")), "parts")
        still = still + 1 if new.filter("moved").isEmpty() else 0
        parts = new.drop("moved")
        if still == 2:
            return parts


def community_features(edges: DataFrame) -> DataFrame:
    parts = materialized(communities(edges), "communities")
    size = parts.groupBy(NET, "part").agg(F.count("*").alias("n")).groupBy(NET).agg(F.count("*").alias("communities"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"))
    return size.join(modularity(edges, parts), NET)


BLOCKS = {"global": global_features, "strength": strength_features, "assortativity": assortativity, "reciprocity": reciprocity, "clustering": clustering, "entropy": entropies, "paths": path_features, "communities": community_features}


def network_features(edges: DataFrame, blocks: Sequence[str] = tuple(BLOCKS)) -> DataFrame:
    """The chosen blocks side by side, a row for each network; columns get the prefix grn_."""
    made = [BLOCKS[b](edges) for b in blocks]
    joined = reduce(lambda a, b: a.join(b, NET, "left"), made, edges.select(NET).distinct())
    return joined.select(NET, *[F.col(c).alias(f"grn_{c}") for c in joined.columns if c != NET])


def build_data(candidates: DataFrame, weights: DataFrame, edges: DataFrame, expression: DataFrame, blocks: Sequence[str] = ("global", "reciprocity")) -> DataFrame:
    """candidates (front_id, net_id, ...) with the features of their consensus networks and of their front's expression.

    weights: (net_id, technique, weight); edges: (technique, src, dst, w); expression: a row for each front_id with columns
    expr_<...>. Candidates without a network keep nulls. Feature columns come last, in order of their names.
    """
    grown = network_features(consensus(positive_weights(weights), edges), blocks)
    joined = candidates.join(grown, NET, "left").join(expression, "front_id", "left")
    return joined.select(*candidates.columns, *sorted(c for c in joined.columns if c not in candidates.columns))


def ranked_edges(edges: DataFrame) -> DataFrame:
    """edge_rank of each edge in its network: heaviest first, then by name."""
    return edges.withColumn("edge_rank", F.row_number().over(Window.partitionBy(NET).orderBy(F.desc("w"), "src", "dst")))


