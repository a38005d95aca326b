"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of five lower-cased words (all of its words, if fewer). Texts with equal sets are copies and become one
node. Every run starts with all nodes in one bucket; a bucket is split on a few sampled positions of the nodes' MinHash
sketches, so that nodes that share the token sampled there meet again; a bucket of at most `small` nodes is compared by brute force
on sketches; a bucket that stays large after `depth` splits is joined as a star, without comparing its pairs. Runs repeat until a
pair at the threshold is met with the target recall. What the runs joined is then verified exactly: the documents of each candidate group are
compared on their whole sets, tile by tile; no list of pairs is made. A group of at most BLOCK_NODES documents and BLOCK_ITEMS shingles is one task.
A larger one is dealt into parts of up to PART_NODES documents and PART_ITEMS shingles, hashed once, and every two parts meet in one task.

Defined cases: null and empty texts, or texts without words, have no links and are classes of their own; repeated rows are copies of each
other; null ids take part by their text (their class id is the least id in the class, null if there is none); a text of any length is compared whole, and one
larger than a part is a part of its own; a similarity equal to the threshold is a link; of the documents of a class the one with the least id, null ids last,
stands for it, and among rows of that id one by a hash of its text; an empty table gives an empty result. Only doc_id and text are read; drop_duplicates keeps all
columns, whatever their names but __k and __i.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import textvec as tv
from weftline.llm.common import Scratch, map_arrow, map_texts, row_keys

T = 64  # positions of a sketch
_U = np.uint64
_SEEDS = tv.mix64(np.arange(2 * T, dtype=_U) + _U(977))
BROADCAST_ROWS = 1_000_000
BLOCK_NODES, BLOCK_ITEMS = 1024, 1 << 20  # of a group that is compared in one task
PART_NODES, PART_ITEMS = 8192, 1 << 20  # of a part of a larger group
TILE = 512


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (16 bits) of the sets that begin at `first` in h; one row each."""
    out = np.empty((len(first), T), np.uint16)
    for k in range(T):
        v = np.minimum.reduceat((h * (_SEEDS[2 * k] | _U(1)) + _SEEDS[2 * k + 1]) >> _U(24), first)
        out[:, k] = ((v * _U(0x9E3779B97F4A7C15)) >> _U(48)).astype(np.uint16)
    return out


def describe(texts, width: int = 5) -> dict:
    """Of each text: content key of its set (null: no word) and a second digest, size of the set, sketch."""
    n = len(texts)
    key, more, size, sketch = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
    for at, run in tv.chunks(texts):
        h, d = tv.shingle_hashes(run, width)
        if not len(h):
            continue
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        counts = np.diff(np.concatenate([first, [len(d)]]))
        digest = tv.mix64(np.add.reduceat(tv.mix64(h), first) + counts.astype(_U))
        key[at + d[first]] = digest.view(np.int64)
        more[at + d[first]] = tv.mix64(np.add.reduceat(tv.mix64(h ^ _U(0x5DEECE66D)), first) + digest).view(np.int64)
        size[at + d[first]] = counts
        for i, row in zip((at + d[first]).tolist(), sketches(h, first), strict=True):
            sketch[i] = row.tobytes()
    none = size == 0
    return {"c": pa.array(key, mask=none), "c2": pa.array(more, mask=none), "size": size, "sketch": pa.array(sketch, pa.binary())}


def _chosen(node: np.ndarray, threshold: float) -> np.ndarray:
    """Which positions each node samples (rows of booleans): each with probability 1 / (threshold x T), and one at least."""
    x = tv.mix64(node[:, None] * _U(0x9E3779B97F4A7C15) + np.arange(T, dtype=_U)[None, :])
    take = (x >> _U(11)).astype(float) / 2.0**53 < 1 / (threshold * T)
    take[np.arange(len(node)), x.argmin(1)] = True
    return take


def _children(batch: pa.RecordBatch, threshold: float, roots: np.ndarray | None) -> pa.RecordBatch:
    c = batch.column(batch.schema.get_field_index("c")).to_numpy()
    s = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sketch")).to_pylist()), np.uint16).reshape(-1, T)
    if roots is not None:
        node, row = np.repeat(roots, len(c)), np.tile(np.arange(len(c)), len(roots))
        take = np.repeat(_chosen(roots, threshold), len(c), 0)
    else:
        node, row = batch.column(batch.schema.get_field_index("node")).to_numpy().view(_U), np.arange(len(c))
        take = _chosen(node, threshold)
    at, pos = np.nonzero(take)
    child = tv.mix64(node[at] + tv.mix64((pos.astype(_U) << _U(16)) | s[row[at], pos]))
    return pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(c[row[at]])], names=["node", "c"])


def _split(df: DataFrame, threshold: float, roots: np.ndarray | None = None) -> DataFrame:
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                yield _children(b.slice(lo, 2000), threshold, roots)

    return map_arrow(df, run, "node bigint, c bigint")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, least member) of the components of the edges a-b."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    members = [x for x in up if top(x) != x]
    return np.array(members, np.int64), np.array([top(x) for x in members], np.int64)


def _whole_groups(batches, key: list[str]):
    """Record batches cut so that each holds whole groups of equal key columns; rows come sorted by them."""
    left = None
    for b in batches:
        t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy() for k in key]
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        left = t.slice(cut)
    if left is not None and left.num_rows:
        yield left


def _brute(df: DataFrame, least: int) -> DataFrame:
    """Small buckets, sorted by node: star edges among nodes whose sketches agree in at least `least` positions."""

    def run(batches):
        for t in _whole_groups(batches, ["node"]):
            node, c = t.column("node").to_numpy(), t.column("c").to_numpy()
            s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, T)
            a, b = [], []
            for k in range(1, len(node)):
                i = np.flatnonzero(node[k:] == node[:-k])
                if not len(i):
                    break
                for lo in range(0, len(i), 1 << 15):
                    j = i[lo : lo + (1 << 15)]
                    j = j[(s[j] == s[j + k]).sum(1) >= least]
                    a.append(c[j])
                    b.append(c[j + k])
            x, y = _stars(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return map_arrow(df, run, "a bigint, b bigint")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root): the component of each vertex of edges (a, b), named by one of its vertices.

    Every vertex is hooked to its least neighbour, or itself, and the hooks are followed twice; the edges are then contracted to the
    new roots. A star is one vertex after the first round, so its edges are read once; vertices left over at least halve each round.
    """
    since = scratch.n
    left = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    levels = []
    while True:
        ends = left.select(F.col("a").alias("v"), F.col("b").alias("w")).union(left.select(F.col("b").alias("v"), F.col("a").alias("w")))
        hook = scratch.write(ends.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("root")), "hooks")
        for _ in range(2):
            onward = hook.select(F.col("v").alias("root"), F.col("root").alias("to"))
            hook = scratch.write(hook.join(onward, "root").select("v", F.col("to").alias("root")), "hooks")
        levels.append(hook)
        to_a, to_b = hook.select(F.col("v").alias("a"), F.col("root").alias("x")), hook.select(F.col("v").alias("b"), F.col("root").alias("y"))
        new = left.join(to_a, "a").join(to_b, "b").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct()
        left = scratch.write(new, "edges")
        if left.isEmpty():
            break
    out = levels.pop()
    while levels:  # from the last contraction back to the vertices
        down = levels.pop()
        out = scratch.write(down.join(out.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root")), "roots")
    scratch.sweep(since, (out,))
    return out


def candidates(nodes: DataFrame, scratch: Scratch, threshold: float, recall: float, small: int, depth: int) -> DataFrame:
    """Star edges (a, b) that join all groups of nodes (c, sketch) which some path puts into one bucket and sketches don't part."""
    once = threshold**depth  # at least: a pair at the threshold shares a token sampled at each split
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - once)))
    roots = tv.mix64(np.arange(runs, dtype=_U) + _U(4242))
    least = math.ceil(T * (threshold - 4.75 * math.sqrt(threshold * (1 - threshold) / T)))  # a pair at the threshold agrees less often once in a million
    found, level = [], _split(nodes.select("c", "sketch"), threshold, roots)
    for at in range(1, depth + 1):
        rows = scratch.write(level, "paths")
        sizes = scratch.write(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        small_nodes, large_nodes = sizes.where(F.col("n") <= small), sizes.where(F.col("n") > small)
        held = rows.join(small_nodes.select("node"), "node").join(nodes.select("c", "sketch"), "c").repartition("node").sortWithinPartitions("node", "c")
        found.append(scratch.write(_brute(held, least), "met"))
        if large_nodes.isEmpty():
            scratch.drop(rows, sizes)
            break
        more = scratch.write(rows.join(large_nodes.select("node"), "node"), "large")
        scratch.drop(rows, sizes)
        if at == depth:
            centre = more.groupBy("node").agg(F.min("c").alias("b"))
            found.append(scratch.write(more.join(scratch.write(centre, "centres"), "node").where("c > b").select(F.col("c").alias("a"), "b").distinct(), "stars"))
        level = _split(more.join(nodes.select("c", "sketch"), "c"), threshold)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


class _Sets:
    """Sets of 64-bit hashes, one after the other: h[starts[n] : starts[n + 1]] is set n."""

    def __init__(self, h: np.ndarray, sizes: np.ndarray):
        self.h, self.sizes, self.starts = h, sizes, np.concatenate([[0], np.cumsum(sizes)])

    def slice(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the sets lo to hi - 1 and the number, from 0, of the set of each."""
        return self.h[self.starts[lo] : self.starts[hi]], np.repeat(np.arange(hi - lo), self.sizes[lo:hi])


def _alike(a: _Sets, b: _Sets, threshold: float, i: tuple[int, int], j: tuple[int, int], same: bool) -> np.ndarray:
    """Which sets of a, from i[0] to i[1] - 1, are similar to which of b, from j[0] to j[1] - 1; same: both are one collection, and a set isn't compared with itself."""
    (ha, ra), (hb, rb) = a.slice(*i), b.slice(*j)
    common = np.intersect1d(ha, hb)
    n, m = i[1] - i[0], j[1] - j[0]
    shared = np.zeros((n, m), np.float32)
    at, bt = np.searchsorted(common, ha), np.searchsorted(common, hb)
    pad = np.append(common, _U(0))
    oka, okb = (pad[at] == ha) & (at < len(common)), (pad[bt] == hb) & (bt < len(common))
    order_a, order_b = np.argsort(at[oka], kind="stable"), np.argsort(bt[okb], kind="stable")
    ca, xa, cb, xb = at[oka][order_a], ra[oka][order_a], bt[okb][order_b], rb[okb][order_b]
    step = max(512, (1 << 20) // max(1, n + m))
    for lo in range(0, len(common), step):
        p, q = np.searchsorted(ca, [lo, lo + step]), np.searchsorted(cb, [lo, lo + step])
        x, y = np.zeros((n, step), np.float32), np.zeros((m, step), np.float32)
        x[xa[p[0] : p[1]], ca[p[0] : p[1]] - lo] = 1
        y[xb[q[0] : q[1]], cb[q[0] : q[1]] - lo] = 1
        shared += x @ y.T  # counts, exact below 2**24
    sa, sb = a.sizes[i[0] : i[1]].astype(np.float64), b.sizes[j[0] : j[1]].astype(np.float64)
    out = shared >= threshold * (sa[:, None] + sb[None, :] - shared) - 1e-9
    if same and i == j:
        np.fill_diagonal(out, False)
    return out


def _compare(a: _Sets, ca: np.ndarray, wa: np.ndarray, b: _Sets, cb: np.ndarray, wb: np.ndarray, threshold: float, same: bool):
    """Links (weighted by copies) of the nodes ca to those of cb and the other way, and star edges of what is linked. same: both sides are one."""
    links_a, links_b = np.zeros(len(ca), np.int64), np.zeros(len(cb), np.int64)
    xs, ys = [], []
    for lo in range(0, len(ca), TILE):
        i = (lo, min(lo + TILE, len(ca)))
        for at in range(lo if same else 0, len(cb), TILE):
            j = (at, min(at + TILE, len(cb)))
            hit = _alike(a, b, threshold, i, j, same)
            if not hit.any():
                continue
            links_a[i[0] : i[1]] += hit @ wb[j[0] : j[1]]
            if not same:
                links_b[j[0] : j[1]] += wa[i[0] : i[1]] @ hit
            elif i != j:
                links_a[j[0] : j[1]] += wa[i[0] : i[1]] @ hit
            x, y = np.nonzero(np.triu(hit) if same and i == j else hit)
            x, y = _stars(ca[i[0] : i[1]][x], cb[j[0] : j[1]][y])
            xs.append(x)
            ys.append(y)
    x, y = _stars(np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return links_a, links_b, x, y


def _verify(df: DataFrame, threshold: float, width: int) -> DataFrame:
    """Blocks of documents, sorted by (root, i, j, part, c): links of each node found in the block, and its least linked node there."""

    def sets(t: pa.Table, lo: int, hi: int) -> _Sets:
        stored, texts = t.column("items").slice(lo, hi - lo), t.column("text").slice(lo, hi - lo)
        if stored.null_count == 0:
            raw = [x.as_buffer() for x in stored]
            return _Sets(np.frombuffer(b"".join(raw), _U), np.array([r.size // 8 for r in raw]))
        h, sizes = [], np.zeros(hi - lo, np.int64)
        for at, run in tv.chunks(texts.to_pylist()):
            got, d = tv.shingle_hashes(run, width)
            h.append(got)
            sizes[at : at + len(run)] = np.bincount(d, minlength=len(run))
        return _Sets(np.concatenate(h) if h else np.zeros(0, _U), sizes)

    def run(batches):
        for t in _whole_groups(batches, ["root", "i", "j"]):
            keys = np.stack([t.column(k).to_numpy() for k in ("root", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            c, copies, mine = t.column("c").to_numpy(), t.column("copies").to_numpy(), t.column("part").to_numpy()
            out = [[], [], [], []]
            for lo, hi in zip([0, *cuts], [*cuts, len(c)], strict=True):
                same = keys[1, lo] == keys[2, lo]
                mid = hi if same else lo + int(np.searchsorted(mine[lo:hi], keys[2, lo]))
                if hi - lo < 2 or not same and mid in (lo, hi):
                    continue  # a block of one document, or with one side empty
                a = sets(t, lo, mid)
                b = a if same else sets(t, mid, hi)
                to = (lo, mid) if same else (mid, hi)
                la, lb, x, y = _compare(a, c[lo:mid], copies[lo:mid], b, c[to[0] : to[1]], copies[to[0] : to[1]], threshold, same)
                root = dict(zip(x.tolist(), y.tolist(), strict=True))
                links = la if same else np.concatenate([la, lb])
                some = np.flatnonzero(links > 0)
                out[0] += c[lo:hi][some].tolist()
                out[1] += [root.get(v, v) for v in c[lo:hi][some].tolist()]
                out[2] += links[some].tolist()
                out[3] += [int(keys[0, lo])] * len(some)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["c", "to", "links", "root"])

    return map_arrow(df, run, "c bigint, to bigint, links bigint, root bigint")


def _items(texts, width: int) -> dict:
    """The hashes of each text's set, 8 bytes each."""
    out = [b""] * len(texts)
    for at, run in tv.chunks(texts):
        h, d = tv.shingle_hashes(run, width)
        cuts = np.searchsorted(d, np.arange(len(run) + 1))
        for n in range(len(run)):
            out[at + n] = h[cuts[n] : cuts[n + 1]].tobytes()
    return {"items": pa.array(out, pa.binary())}


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _nodes(seen: DataFrame) -> DataFrame:
    """One row for each content key: copies, the row that stands for it, size, sketch, and whether several contents share the key."""
    by = seen.where("c is not null").groupBy("c").agg(
        F.count("*").alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "i")).alias("least"),
        (F.min("c2") != F.max("c2")).alias("clash"),
        F.max("size").alias("size"),
        F.any_value("sketch").alias("sketch"),
    )
    return by.select("c", "copies", F.col("least.none").alias("none"), F.col("least.doc_id").alias("id"), F.col("least.k").alias("k"), F.col("least.i").alias("i"), "clash", "size", "sketch")


def link(docs: DataFrame, scratch: Scratch, threshold: float = 0.8, width: int = 5, recall: float = 0.99, small: int = 64, depth: int = 3) -> DataFrame:
    """One row per document: k and i (hashes of id and text), doc_id, c (content), class_c (least content key of its class), copies, links (to other documents), keeper (whether its row stands for its class)."""
    key, since = ["k", "i"], scratch.n
    keyed = docs.select("doc_id", "text", *row_keys())
    seen = scratch.write(map_texts(keyed, [*key, "doc_id"], lambda t: describe(t, width), "c bigint, c2 bigint, size bigint, sketch binary"), "sketches")
    nodes = scratch.write(_nodes(seen), "nodes")
    clash = nodes.where("clash").select("c")
    if not clash.isEmpty():  # different contents of one 64-bit key: told apart by the second digest
        hit = F.when(F.col("n").isNotNull(), F.xxhash64("c", "c2")).otherwise(F.col("c"))
        seen = scratch.write(seen.join(clash.withColumn("n", F.lit(1)), "c", "left").withColumn("c", hit).drop("n"), "sketches")
        nodes = scratch.write(_nodes(seen), "nodes")
    edges = candidates(nodes, scratch, threshold, recall, small, depth)
    groups = components(edges, scratch)
    ranked = groups.withColumnRenamed("v", "c").join(nodes.select("c", *key, "copies", "size"), "c")
    ranked = scratch.write(ranked, "ranked")
    n, items = F.count("*"), F.sum("size")
    whole = (n <= BLOCK_NODES) & (items <= BLOCK_ITEMS)
    dealt = F.greatest(F.ceil(n / PART_NODES), F.ceil(items / PART_ITEMS), F.least(F.ceil(n / BLOCK_NODES), F.lit(8)), F.lit(2))
    parts = ranked.groupBy("root").agg(F.when(whole, 1).otherwise(dealt).cast("int").alias("parts"))
    members = ranked.drop("size").join(scratch.write(parts, "parts"), "root")
    members = scratch.write(members.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")), "members")
    n_members = members.count()
    mine = keyed.select(*key, "text").join(_maybe_broadcast(members, n_members), key).dropDuplicates(["c"])
    several = members.where("parts > 1").select("c")
    blocks = mine.where("parts = 1").select("root", "part", F.lit(0).alias("i"), F.lit(0).alias("j"), "c", "copies", "text", F.lit(None).cast("binary").alias("items"))
    spread = not several.isEmpty()
    if spread:
        hashed = map_texts(mine.where("parts > 1"), ["root", "part", "parts", "c", "copies"], lambda t: _items(t, width), "items binary")
        hashed = scratch.write(hashed, "items").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        blocks = blocks.union(hashed.select("root", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "c", "copies", F.lit(None).cast("string").alias("text"), "items"))
    blocks = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "part", "c")
    checked = scratch.write(_verify(blocks, threshold, width), "links")
    links = checked.groupBy("c").agg(F.sum("links").alias("links"), F.min("to").alias("to"))
    if spread:  # groups of several parts: their classes come from the links of all blocks
        split = checked.join(several, "c", "left_semi").where("c <> to").select(F.col("c").alias("a"), F.col("to").alias("b"))
        wide = components(split, scratch)
        links = links.join(wide.withColumnRenamed("v", "c"), "c", "left").select("c", "links", F.coalesce("root", "to").alias("to"))
    links = scratch.write(links, "links")
    classes = nodes.drop("sketch", "size", "clash").join(links, "c", "left").select("c", "copies", "none", "id", *key, F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), F.coalesce("to", "c").alias("class_c"))
    classes = scratch.write(classes, "classes")
    first = scratch.write(classes.groupBy("class_c").agg(F.min(F.struct("none", "id", "k", "i")).alias("first")), "first")
    classes = scratch.write(classes.join(first, "class_c").select("c", "class_c", "copies", "links", F.col("first.id").alias("class_id"), F.col("first.k").alias("first_k"), F.col("first.i").alias("first_i")), "classes")
    scratch.sweep(since, (seen, classes))
    out = seen.select(*key, "doc_id", "c").join(classes, "c", "left")
    alone = F.col("c").isNull()
    return out.select(
        *key, "doc_id", "c", "class_c",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("bigint").alias("copies"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("bigint").alias("n_links"),
        (alone | ((F.col("k") == F.col("first_k")) & (F.col("i") == F.col("first_i")))).alias("keeper"),
    )


def near_duplicates(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """doc_id, class_id (least doc_id of the documents that links connect), n_links (documents with similarity at the threshold or more), n_copies (documents with the same set)."""
    return link(docs, scratch, **how).select("doc_id", "class_id", "n_links", F.col("copies").alias("n_copies"))


def drop_duplicates(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """One document of each class, with all its columns: the one with the least id. Rows alike in id and text become one."""
    key = ["__k", "__i"]
    named: list[Column] = [F.col("k").alias("__k"), F.col("i").alias("__i")]
    found = scratch.write(link(docs, scratch, **how).select("k", "i", "c", "keeper"), "decisions")
    lost = scratch.write(found.where("not keeper").select(*named).distinct(), "lost")
    again = scratch.write(found.where("keeper and c is not null").groupBy(*named).agg(F.count("*").alias("n")).where("n > 1"), "again")
    k, i = row_keys()
    keyed = docs.select("*", k.alias("__k"), i.alias("__i"))
    kept = keyed.join(_maybe_broadcast(lost, lost.count()), key, "left_anti")
    n_again = again.count()
    if n_again:
        few = _maybe_broadcast(again.select(*key), n_again)
        kept = kept.join(few, key, "left_anti").unionByName(kept.join(few, key, "left_semi").dropDuplicates(key))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
