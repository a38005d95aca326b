"""Mixing sources to target weights: min-cost flow over membership patterns.

A document belongs to one or more sources. Documents are counted by membership pattern (the set of their sources). Each
pattern can give its words once, twice or up to `most` times, at a cost that rises with each repetition; each source wants its
target. The min-cost flow from patterns to sources says how often each pattern is taken. Of a pattern that is taken a fractional number of
times, the documents that are taken once more are chosen by a seeded hash: every document below a threshold, found by
refining a histogram, and of the last few units those that still fit. What is too long for the room left is skipped, and the documents after it
fill on in the same way until none fits. A document's share is thus a function of its own values: no join by id, and reruns agree.

Defined cases: null and empty texts have size 0 and are taken 0 words; the null source is a source like any other; rows alike in id, text and
sources are taken or left together; texts of any length are counted whole, and one longer than the room left in a target is skipped; an empty table gives
an empty result; over MAX_PATTERNS patterns raise an error. Only doc_id, text and the sources are read; `take` keeps all columns, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import Scratch

MAX_PATTERNS = 20_000
TOP = 1 << 53


def words(text: Column) -> Column:
    """Number of runs of anything but space, tab, LF, VT, FF, CR; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict, weights: dict, most: float = 3.0, total: float | None = None) -> dict[object, float]:
    """Shares of the total (of all sizes by default) by weight; none above `most` times its size, the excess reshared by weight among the others."""
    out, left, free = {}, float(sum(sizes.values()) if total is None else total), sorted(sizes, key=lambda s: (s is None, s or ""))
    while free:
        unit = left / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * unit > most * sizes[s]]
        if not over:
            return out | {s: weights[s] * unit for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def flow(sizes: dict[tuple, int], wanted: dict[object, float], most: int = 3) -> dict[tuple, dict[object, float]]:
    """Words that each pattern gives to each of its sources: max flow of least cost, the n-th repetition of a word costing n - 1.

    Successive shortest paths with potentials. Nodes: 0 start, patterns, sources, end.
    """
    pats, srcs = sorted(sizes, key=repr), sorted(wanted, key=repr)
    at = {s: 1 + len(pats) + i for i, s in enumerate(srcs)}
    end = 1 + len(pats) + len(srcs)
    arcs: list[list] = []  # to, left, cost
    of: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, cap: float, cost: int) -> int:
        of[a].append(len(arcs))
        arcs.append([b, cap, cost])
        of[b].append(len(arcs))
        arcs.append([a, 0.0, -cost])
        return len(arcs) - 2

    routes: dict[tuple, dict[object, int]] = {}
    for i, p in enumerate(pats):
        for n in range(most):
            arc(0, 1 + i, float(sizes[p]), n)
        routes[p] = {s: arc(1 + i, at[s], float("inf"), 0) for s in p if s in at}
    for s in srcs:
        arc(at[s], end, wanted[s], 0)
    eps, pot = 1e-6 * max(1.0, sum(wanted.values())) * 1e-3, [0] * (end + 1)
    while True:
        dist, via = [float("inf")] * (end + 1), [-1] * (end + 1)
        dist[0], heap = 0, [(0, 0)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for e in of[v]:
                b, left, cost = arcs[e]
                if left > eps and (new := d + cost + pot[v] - pot[b]) < dist[b]:
                    dist[b], via[b] = new, e
                    heapq.heappush(heap, (new, b))
        if via[end] < 0:
            return {p: {s: arcs[e ^ 1][1] for s, e in r.items()} for p, r in routes.items()}
        pot = [p + (d if d < float("inf") else 0) for p, d in zip(pot, dist, strict=True)]
        # a blocking flow over the arcs of no reduced cost: many paths of one length at once
        tight = lambda v, e: arcs[e][1] > eps and arcs[e][2] + pot[v] - pot[arcs[e][0]] == 0
        nxt = [0] * (end + 1)
        while True:
            path, v, on = [], 0, {0}
            while v != end:
                while nxt[v] < len(of[v]) and not (tight(v, of[v][nxt[v]]) and arcs[of[v][nxt[v]]][0] not in on):
                    nxt[v] += 1
                if nxt[v] < len(of[v]):
                    path.append((v, of[v][nxt[v]]))
                    v = arcs[path[-1][1]][0]
                    on.add(v)
                elif path:
                    on.discard(v)
                    v, _ = path.pop()
                    nxt[v] += 1
                else:
                    break
            if v != end:
                break
            push = min(arcs[e][1] for _, e in path)
            for _, e in path:
                arcs[e][1] -= push
                arcs[e ^ 1][1] += push
            if nxt[0] >= len(of[0]):
                break


def describe(docs: DataFrame, sources: Column, seed: int, keep: list[Column]) -> DataFrame:
    """keep, size, pattern (sorted distinct sources) and unit (the seeded place in [0, 2**53))."""
    size = words(F.col("text"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.col("text"), F.lit(seed)), 11)
    return docs.select(*keep, size.alias("size"), F.array_sort(F.array_distinct(sources)).alias("pattern"), place.alias("unit"))


def plan(meta: DataFrame, wanted: dict, sizes: dict[tuple, tuple[int, int]], most: int, scratch: Scratch, few: int = 64) -> list[tuple]:
    """(pattern, whole repetitions, ranges of units with the largest size taken there, further units) of each pattern; meta: size, pattern, unit."""
    given = flow({p: s for p, (s, _) in sizes.items()}, wanted, most)
    out, open_ = [], {}
    for p, (size, n) in sizes.items():
        words_ = min(sum(given[p].values()), float(most * size))
        full = int(words_ // size) if size else 0
        rest = words_ - full * size if full < most else 0.0
        if rest < 0.5:
            out.append((p, full, [], []))
        else:
            open_[p] = {"full": full, "rest": rest, "lo": 0, "hi": TOP, "n": n, "cap": TOP, "from": 0, "parts": [], "taken": {}, "left": {}}
    spark = scratch.spark
    schema = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("lo", T.LongType()), T.StructField("step", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("rest", T.DoubleType()), T.StructField("cap", T.LongType())])
    side = lambda ps: F.broadcast(spark.createDataFrame([(list(p), o["lo"], o["step"], o["hi"], o["rest"], o["cap"]) for p, o in ps.items()], schema))  # noqa: E731  MAX_PATTERNS rows at most
    fits = lambda ps: meta.where("size > 0").join(side(ps), "pattern").where("unit >= lo and unit < hi and size <= cap")

    def close(p: tuple) -> None:
        o = open_.pop(p)
        out.append((p, o["full"], o["parts"], exchange(o["taken"], o["left"], o["rest"])))

    while open_:
        while wide := {p: o for p, o in open_.items() if o["n"] > few and o["hi"] - o["lo"] > 1}:
            for o in wide.values():
                parts = min(1024, max(2, o["n"] // (few // 2)), o["hi"] - o["lo"])
                o["step"] = -(-(o["hi"] - o["lo"]) // parts)
            hist = fits(wide).groupBy("pattern", "lo", "step", "hi", "rest", F.expr("(unit - lo) div step").alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
            bins = hist.groupBy("pattern", "rest").agg(F.array_sort(F.collect_list(F.struct("b", "s", "n"))).alias("bins"))  # at most 1024 each
            found = {tuple(r["pattern"]): r["x"] for r in bins.select("pattern", _crossing(F.col("bins"), F.col("rest")).alias("x")).collect() if r["x"]["b"] is not None}
            for p, o in wide.items():
                x = found.get(p)
                if x is None:  # rounding: everything in the range is taken
                    o["parts"].append((o["from"], o["hi"], o["cap"]))
                    o["rest"] = 0.0
                    close(p)
                    continue
                base = o["lo"]
                o["lo"], o["hi"], o["n"] = base + x["b"] * o["step"], min(o["hi"], base + (x["b"] + 1) * o["step"]), x["n"]
                o["rest"] -= x["upto"] - x["s"]
        if not open_:
            break
        for o in open_.values():
            o["step"] = 1
        by: dict[tuple, list] = {}
        for r in fits(open_).groupBy("pattern", "unit").agg(F.sum("size").alias("s")).collect():  # about `few` units of each pattern
            by.setdefault(tuple(r["pattern"]), []).append((r["unit"], r["s"]))
        for p, o in open_.items():
            if o["lo"] > o["from"]:
                o["parts"].append((o["from"], o["lo"], o["cap"]))
            for u, size in sorted(by.get(p, [])):
                if size <= o["rest"]:
                    o["taken"][u] = size
                    o["rest"] -= size
                else:
                    o["left"][u] = size
            o["lo"] = o["from"] = o["hi"]
            o["hi"], o["cap"] = TOP, int(o["rest"])
        after = {tuple(r["pattern"]): r for r in fits(open_).groupBy("pattern").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
        for p, o in list(open_.items()):
            if p not in after:  # no document fits any more
                close(p)
            elif after[p]["s"] <= o["rest"]:  # all do
                o["parts"].append((o["from"], TOP, o["cap"]))
                o["rest"] -= after[p]["s"]
                close(p)
            else:
                o["n"] = after[p]["n"]
    return out


def exchange(taken: dict[int, int], rest: dict[int, int], left: float, swaps: int = 3) -> list[int]:
    """Units (with sizes) taken after the few exchanges with the rest that bring `left` nearest to 0."""
    taken, rest = dict(taken), dict(rest)
    for _ in range(swaps):
        moves = [(abs(left - b + a), x, y) for x, a in [(-1, 0), *taken.items()] for y, b in [(-1, 0), *rest.items()]]
        best, x, y = min(moves)
        if best >= abs(left):
            break
        if x >= 0:
            rest[x] = taken.pop(x)
            left += rest[x]
        if y >= 0:
            taken[y] = rest.pop(y)
            left -= taken[y]
    return sorted(taken)


def _crossing(bins: Column, rest: Column) -> Column:
    """The first bin (b, s, n) at which the running sum of s reaches `rest`, with the sum up to it; b is null if it never does."""
    start = F.struct(F.lit(None).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))

    def step(acc: Column, x: Column) -> Column:
        upto = acc["upto"] + x["s"]
        here = upto >= rest
        return F.when(acc["b"].isNotNull(), acc).otherwise(F.struct(F.when(here, x["b"]).cast("bigint").alias("b"), x["s"].cast("bigint").alias("s"), x["n"].cast("bigint").alias("n"), upto.cast("bigint").alias("upto")))

    return F.aggregate(bins, start, step)


def repeats(df: DataFrame, plan_rows: list[tuple]) -> DataFrame:
    """df (pattern, unit, size) with repeats, the times each document is taken."""
    schema = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("full", T.IntegerType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("more", T.ArrayType(T.LongType()))])
    side = df.sparkSession.createDataFrame([(list(p), f, [list(x) for x in b], m) for p, f, b, m in plan_rows], schema)
    once = F.exists("parts", lambda x: (F.col("unit") >= x[0]) & (F.col("unit") < x[1]) & (F.col("size") <= x[2])) | F.array_contains("more", F.col("unit"))
    return df.join(F.broadcast(side), "pattern").withColumn("repeats", F.col("full") + once.cast("int")).drop("full", "parts", "more")


def _pattern_sizes(meta: DataFrame) -> dict[tuple, tuple[int, int]]:
    rows = meta.groupBy("pattern").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    return {tuple(r["pattern"]): (r["s"], r["n"]) for r in rows}


def source_sizes(sizes: dict[tuple, tuple[int, int]]) -> dict:
    out: dict = {}
    for p, (s, _) in sizes.items():
        for x in p:
            out[x] = out.get(x, 0) + s
    return out


def default_weights(sources) -> dict:
    """1, 2, 3 and again, by code point, null last."""
    return {s: 1 + i % 3 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def mix(docs: DataFrame, scratch: Scratch, sources: Column | None = None, weights: dict | None = None, most: int = 3, seed: int = 1) -> DataFrame:
    """doc_id, size, pattern, repeats, taken of every document. sources: array of the document's sources (the column source alone by default).

    Targets share the total size by weight (1, 2, 3 and again by default).
    """
    meta = scratch.write(describe(docs, sources if sources is not None else F.array("source"), seed, [F.col("doc_id")]), "sizes")
    rows, _ = _planned(meta, scratch, weights, most)
    return repeats(meta, rows).withColumn("taken", F.col("size") * F.col("repeats"))


def _planned(meta: DataFrame, scratch: Scratch, weights: dict | None, most: int) -> tuple[list[tuple], dict]:
    sizes = _pattern_sizes(meta)
    total = sum(s for s, _ in sizes.values())
    own = source_sizes(sizes)
    wanted = targets(own, weights or default_weights(own), float(most), total)
    return plan(meta, wanted, sizes, most, scratch), {"sizes": own, "targets": wanted}


def mixing(docs: DataFrame, scratch: Scratch, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken: all documents, each in its own source."""
    meta = scratch.write(describe(docs, F.array("source"), seed, [F.col("doc_id")]), "sizes")
    rows, told = _planned(meta, scratch, None, 3)
    schema = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    side = docs.sparkSession.createDataFrame([([s], told["sizes"][s], told["targets"][s]) for s in told["sizes"]], schema)
    out = repeats(meta, rows).join(F.broadcast(side), "pattern")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("bigint").alias("taken"))


def take(docs: DataFrame, scratch: Scratch, seed: int = 1, most: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns; those of no words are kept once."""
    meta = scratch.write(describe(docs, F.array("source"), seed, []), "sizes")
    rows, _ = _planned(meta, scratch, None, most)
    scratch.drop(meta)
    names = docs.columns
    whole = [F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")]
    out = repeats(describe(docs, F.array("source"), seed, whole), rows)
    n = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("repeats"))
    out = out.where(n > 0).withColumn("__n", F.explode(F.array_repeat(F.lit(0), n)))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in names])
