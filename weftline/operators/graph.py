"""Operators on a directed graph: edges (src, dst) as a DataFrame. Iterations join and cut lineage by checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.scratch import cut


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree)."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst").alias("node"), F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").cast("bigint").alias("out_degree"), F.sum("i").cast("bigint").alias("in_degree"))


def hotspots(edges: DataFrame, top: int) -> DataFrame:
    return degrees(edges).withColumn("degree", F.col("out_degree") + F.col("in_degree")).orderBy(F.desc("degree"), "node").limit(top)


def _fronts(first: DataFrame, step, depth: int | None, key: list[str]) -> DataFrame:
    """Rows (key, distance) of all fronts: the first, and what step leads to from the last one and was in none before. Fronts are written once and never again."""
    seen, front, hop, parts = None, cut(first.select(*key).distinct().withColumn("distance", F.lit(0).cast("bigint"))), 0, 0
    while True:
        seen = front if seen is None else seen.unionByName(front)
        parts += 1
        if depth is not None and hop >= depth:
            return seen
        if parts == 32:  # keeps the plan small on deep graphs
            seen, parts = cut(seen), 1
        hop += 1
        front = cut(step(front).select(*key).distinct().join(seen.select(*key), key, "left_anti").withColumn("distance", F.lit(hop).cast("bigint")))
        if front.isEmpty():
            return seen


def _steps(edges: DataFrame, reverse: bool) -> DataFrame:
    """(at, to): the distinct edges, cut once."""
    ends = ("dst", "src") if reverse else ("src", "dst")
    return cut(edges.select(F.col(ends[0]).alias("at"), F.col(ends[1]).alias("to")).distinct())


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(node, distance) of what the seeds (node) reach in at most `depth` steps; the seeds have distance 0."""
    steps = _steps(edges, reverse)
    return _fronts(seeds, lambda front: steps.join(front.select(F.col("node").alias("at")), "at").select(F.col("to").alias("node")), depth, ["node"])


def reach_each(edges: DataFrame, seeds: DataFrame, depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(seed, node, distance) for each seed (node) by itself; for few seeds."""
    steps = _steps(edges, reverse)
    first = seeds.select(F.col("node").alias("seed"), "node")
    return _fronts(first, lambda front: steps.join(front.select("seed", F.col("node").alias("at")), "at").select("seed", F.col("to").alias("node")), depth, ["seed", "node"])


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, limit: int) -> DataFrame:
    """(src, dst, distance): the relations met by walking from the seeds in both directions, nearest first, ties by ends; at most `limit`."""
    both = edges.select("src", "dst").distinct()
    near = reach(both.union(both.select("dst", "src")), seeds, depth)
    a, b = near.select(F.col("node").alias("src"), F.col("distance").alias("x")), near.select(F.col("node").alias("dst"), F.col("distance").alias("y"))
    met = both.join(a, "src").join(b, "dst").withColumn("distance", F.least("x", "y") + 1).where(F.col("distance") <= depth)
    return met.select("src", "dst", "distance").orderBy("distance", "src", "dst").limit(limit)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph, components named by their least node: labels spread to neighbours and follow their own labels."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        moved = label.join(near, "node").select("node", "component", F.least("component", "near").alias("to"))
        jump = label.select(F.col("node").alias("to"), F.col("component").alias("onward"))
        new = cut(moved.join(jump, "to").select("node", F.col("component").alias("was"), F.least("to", "onward").alias("component")))
        label = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return label


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of at least one edge. For condensed or small graphs: it holds a row for each pair."""
    first = cut(edges.select("src", "dst").distinct())
    step = first.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    return _fronts(first, lambda front: front.join(step, "dst").select("src", F.col("to").alias("dst")), None, ["src", "dst"]).select("src", "dst")


def dependents(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, n): how many nodes reach it; itself only if it lies on a cycle. of (node): only these, each walked back by itself.

    For all nodes, cycles are condensed first, so that pairs are listed between components only.
    """
    edges = cut(edges.select("src", "dst").distinct())
    if of is not None:
        back = reach_each(edges, of, reverse=True)
        cyclic = back.join(edges.select(F.col("src").alias("seed"), F.col("dst").alias("node")), ["seed", "node"], "left_semi").select("seed").distinct().withColumn("own", F.lit(1))
        found = back.where("distance > 0").groupBy("seed").agg(F.count("*").alias("n"))
        return found.join(cyclic, "seed", "left").select(F.col("seed").alias("node"), (F.col("n") + F.coalesce("own", F.lit(0))).alias("n"))
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    on_cycle = cycles(edges)
    member = cut(nodes.join(on_cycle, "node", "left").select("node", F.coalesce("component", "node").alias("c"), F.col("component").isNotNull().alias("cyclic")).join(loops.withColumn("loop", F.lit(True)), "node", "left").withColumn("cyclic", F.col("cyclic") | F.coalesce("loop", F.lit(False))).drop("loop"))
    ends = member.select("node", "c")
    joined = edges.join(ends.withColumnsRenamed({"node": "src", "c": "a"}), "src").join(ends.withColumnsRenamed({"node": "dst", "c": "b"}), "dst")
    pairs = closure(joined.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    sizes = member.groupBy("c").agg(F.count("*").alias("size"), F.max("cyclic").alias("cyclic"))
    before = pairs.join(sizes.select(F.col("c").alias("src"), "size"), "src").groupBy(F.col("dst").alias("c")).agg(F.sum("size").alias("before"))
    told = sizes.join(before, "c", "left").select("c", (F.coalesce("before", F.lit(0)) + F.when(F.col("cyclic"), F.col("size")).otherwise(0)).alias("n"))
    return ends.join(told, "c").where("n > 0").select("node", "n")


def cycles(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(node, component) of nodes on a cycle, components named by their least node; self references don't count.

    Nodes that only lead in or out are peeled off. Each round then spreads the least label forward; a node that keeps its own label is the least of its
    component, which is what it reaches back among the nodes of its label. names (node, name): components whose members share one name, in any case, are dropped.
    """
    left, found = cut(edges.where("src <> dst").select("src", "dst").distinct()), []
    size = left.count()
    while size:
        while True:  # nodes that only lead in or out are on no cycle
            kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            kept = cut(kept)
            now = kept.count()
            if now == size:
                break
            left, size = kept, now
        if not size:
            break
        color = cut(left.groupBy(F.col("dst").alias("node")).agg(F.least(F.col("node"), F.min("src")).alias("c")))
        while True:
            sent = left.join(color.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("near"))
            new = cut(color.join(sent, "node", "left").select("node", F.col("c").alias("was"), F.least("c", F.coalesce("near", "c")).alias("c")))
            color = new.select("node", "c")
            if new.where("was <> c").isEmpty():
                break
        inside = left.join(color.withColumnsRenamed({"node": "src", "c": "a"}), "src").join(color.withColumnsRenamed({"node": "dst", "c": "b"}), "dst").where("a = b").select("src", "dst")
        back = reach(inside, color.where("node = c").select("node"), reverse=True)
        members = cut(back.select("node").join(color, "node").withColumnRenamed("c", "component"))
        found.append(members)
        for end in ("src", "dst"):
            left = left.join(members.select(F.col("node").alias(end)), end, "left_anti")
        left = cut(left.select("src", "dst"))
        size = left.count()
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    some = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1") if names is None else out.join(names, "node").groupBy("component").agg(F.countDistinct(F.lower("name")).alias("n")).where("n > 1")
    return out.join(some.select("component"), "component", "left_semi").select("node", "component")


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank): uniform start, dangling mass spread over all nodes, parallel edges count once."""
    edges = cut(edges.select("src", "dst").distinct())
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(degree, "node", "left"))  # out is null for dangling nodes
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        sent = edges.join(rank.where("out is not null").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("share")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        rank = nodes.join(sent, "node", "left").join(F.broadcast(loose)).select("node", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if i % 5 == 4:
            rank = cut(rank)
    return rank.select("node", "rank")


def overlaps(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (path, start, end, ...) that share a line with a changed range (path, first, last)."""
    hit = (ranges["path"] == spans["path"]) & (spans["start"] <= ranges["last"]) & (spans["end"] >= ranges["first"])
    return spans.join(ranges, hit, "left_semi")


def blast(edges: DataFrame, seeds: DataFrame, depth: int, limit: int) -> DataFrame:
    """What depends on the seeds: (node, distance, in_degree), nearest and most depended on first."""
    edges = cut(edges.select("src", "dst").distinct())
    found = reach(edges, seeds, depth, reverse=True).where("distance > 0")
    deg = degrees(edges).select("node", "in_degree")
    return found.join(deg, "node", "left").orderBy("distance", F.desc("in_degree"), "node").limit(limit)


def modules(edges: DataFrame, least: int = 1) -> DataFrame:
    """(node, module): two levels of deterministic modularity moves on the undirected weighted graph.

    Local moves depend on their order, so each connected component, as its distinct and weighted pairs, is one task; no move ever crosses components, and
    the weight of the whole graph, which the gains refer to, is handed to all.
    """
    pairs = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").cast("double").alias("w")))
    kind = edges.schema["src"].dataType.simpleString()
    weight = 2 * (pairs.agg(F.sum("w")).head()[0] or 0.0)
    part = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "a")

    def run(pdf):
        import pandas as pd

        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {v: i for i, v in enumerate(names)}
        member = louvain(len(names), [(at[a], at[b], w) for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"], strict=True)], weight=weight)
        first: dict[int, object] = {}
        for v, m in zip(names, member, strict=True):
            first.setdefault(m, v)
        out = pd.DataFrame({"node": names, "module": [first[m] for m in member]})
        size = out.groupby("module")["node"].transform("size")
        return out[size >= least]

    return pairs.join(part, "a").groupBy("component").applyInPandas(run, f"node {kind}, module {kind}")


def louvain(n: int, pairs: list[tuple[int, int, float]], levels: int = 2, sweeps: int = 12, weight: float | None = None) -> list[int]:
    """Community of each vertex. weight: twice that of all pairs of the graph that these are a part of."""
    group = list(range(n))
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in pairs:
        near[a][b] = near[a].get(b, 0.0) + w
        if a != b:
            near[b][a] = near[b].get(a, 0.0) + w
    loops = [near[v].pop(v, 0.0) for v in range(n)]
    for _ in range(levels):
        size = len(near)
        strength = [sum(d.values()) + 2 * loops[v] for v, d in enumerate(near)]
        total = weight or sum(strength)
        if not total:
            break
        own, mass = list(range(size)), strength[:]
        for _ in range(sweeps):
            moved = False
            for v in range(size):
                links: dict[int, float] = {}
                for u, w in near[v].items():
                    links[own[u]] = links.get(own[u], 0.0) + w
                mass[own[v]] -= strength[v]
                best, gain = own[v], links.get(own[v], 0.0) - strength[v] * mass[own[v]] / total
                for c in sorted(links):
                    g = links[c] - strength[v] * mass[c] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                moved |= best != own[v]
                own[v] = best
                mass[best] += strength[v]
            if not moved:
                break
        number = {c: i for i, c in enumerate(sorted(set(own)))}
        own = [number[c] for c in own]
        group = [own[g] for g in group]
        if len(number) == size:
            break
        merged: list[dict[int, float]] = [{} for _ in number]
        loop2 = [0.0] * len(number)
        for v, d in enumerate(near):
            loop2[own[v]] += loops[v]
            for u, w in d.items():
                if own[u] == own[v]:
                    loop2[own[v]] += w / 2
                else:
                    merged[own[v]][own[u]] = merged[own[v]].get(own[u], 0.0) + w
        near, loops = merged, loop2
    return group


def modularity_links(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(module_from, module_to, n) edges between and within modules (node, module)."""
    a, b = member.select(F.col("node").alias("src"), F.col("module").alias("module_from")), member.select(F.col("node").alias("dst"), F.col("module").alias("module_to"))
    return edges.join(a, "src").join(b, "dst").groupBy("module_from", "module_to").agg(F.count("*").alias("n"))


def cohesion(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(module, internal, external, cohesion): edges within a module, edges that leave or enter it, and the share of the first among both."""
    links = modularity_links(edges, member)
    ends = links.select(F.col("module_from").alias("module"), F.col("module_to").alias("other"), "n").union(links.where("module_from <> module_to").select("module_to", "module_from", "n"))
    same = F.col("module") == F.col("other")
    out = ends.groupBy("module").agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("internal"), F.sum(F.when(same, 0).otherwise(F.col("n"))).alias("external"))
    return out.withColumn("cohesion", F.round(F.col("internal") / (F.col("internal") + F.col("external")), 6))
