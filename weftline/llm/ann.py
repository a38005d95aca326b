"""Approximate nearest neighbours: score-aware anisotropic quantisation for maximum inner product.

A bounded sample trains coarse centres and product codebooks of 16 words (4 bits) a subspace. Codes are chosen to keep the
residual parallel to the vector small (anisotropic loss), which is what moves an inner product. Every row is coded and belongs to
its nearest centre's cell; a query reads the cells whose centres score highest. Cells are dealt out in blocks of bounded size, so
a crowded cell is many tasks; a block's codes are scanned with the query's tables, two 4-bit codes at a time, and the best, with all that lie
within three typical errors of the k-th, are ranked anew by the exact inner product in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths have no inner
product, so each length is searched by itself; every row is a query or candidate of its own: of rows alike in id and vector each has its list, in which the
others stand (they are coded and scanned once); different vectors under one id are separate queries, each with its own ranks from 1, and candidates of each other;
equal scores go to the smaller id; with fewer candidates all are returned; an empty table gives an empty result. Only the id and the vector are read, so further columns and their names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, map_arrow
from weftline.llm.jaccard import _whole_groups

SAMPLE = 8_000


def usable(df: DataFrame, vec: str = "embedding") -> DataFrame:
    v = F.col(vec)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(v.isNotNull() & F.coalesce(good, F.lit(False)))


@dataclass
class Index:
    centres: np.ndarray  # cells x d
    books: np.ndarray  # subspaces x 16 x width (padded)
    eta: float  # weight of the parallel residual
    width: int
    dim: int
    spread: float = 0.0  # typical error of an approximate score, for a query of length 1

    def split(self, x: np.ndarray) -> np.ndarray:
        """n x subspaces x width, zeros appended."""
        m = self.books.shape[0]
        return np.pad(x, ((0, 0), (0, m * self.width - x.shape[1]))).reshape(len(x), m, self.width)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(1)[None, :] - 2 * x @ self.centres.T).argmin(1)

    def encode(self, x: np.ndarray, cell: np.ndarray, rounds: int = 2) -> np.ndarray:
        """4-bit codes (n x subspaces) of the residuals, by coordinate descent on the anisotropic loss."""
        r, u = self.split(x - self.centres[cell]), self.split(x / np.linalg.norm(x, axis=1, keepdims=True))
        code = np.stack([((r[:, m, None, :] - self.books[m][None]) ** 2).sum(2).argmin(1) for m in range(r.shape[1])], 1)
        par = np.stack([((r[:, m] - self.books[m][code[:, m]]) * u[:, m]).sum(1) for m in range(r.shape[1])], 1)
        for _ in range(rounds):
            for m in range(r.shape[1]):
                err = r[:, m, None, :] - self.books[m][None]
                own = (err * u[:, m, None, :]).sum(2)
                other = par.sum(1) - par[:, m]
                code[:, m] = ((err**2).sum(2) + (self.eta - 1) * (other[:, None] + own) ** 2).argmin(1)
                par[:, m] = own[np.arange(len(r)), code[:, m]]
        return code.astype(np.uint8)

    def scan(self, q: np.ndarray, codes: np.ndarray, cell: int) -> np.ndarray:
        """Approximate scores, queries x rows, of packed codes (rows x subspaces / 2 bytes) of one cell."""
        table = np.einsum("qmw,mkw->qmk", self.split(q), self.books).astype(np.float32)
        pair = (table[:, 0::2, :, None] + table[:, 1::2, None, :]).reshape(len(q), -1, 256)
        out = np.repeat((q @ self.centres[cell])[:, None].astype(np.float32), len(codes), 1)
        for m in range(pair.shape[1]):
            out += pair[:, m, :][:, codes[:, m]]
        return out


def train(x: np.ndarray, cells: int, width: int = 2, cut: float = 0.2, rounds: int = 6, seed: int = 3) -> Index:
    rng = np.random.default_rng(seed)
    n, d = x.shape
    centres = x[rng.choice(n, min(cells, n), replace=False)].copy()
    for _ in range(rounds):
        at = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        for c in range(len(centres)):
            if (at == c).any():
                centres[c] = x[at == c].mean(0)
    m = -(-d // width)
    m += m % 2
    eta = max(1.0, (d - 1) * cut**2 / (1 - cut**2))
    index = Index(centres, np.zeros((m, 16, width)), eta, width, d)
    at = index.cell(x)
    r, u = index.split(x - centres[at]), index.split(x / np.linalg.norm(x, axis=1, keepdims=True))
    for j in range(m):
        book = r[rng.choice(n, 16, replace=n < 16), j].copy()
        for _ in range(rounds):
            near = ((r[:, j, None, :] - book[None]) ** 2).sum(2).argmin(1)
            for k in range(16):
                if (near == k).any():
                    book[k] = r[near == k, j].mean(0)
        index.books[j] = book
    for _ in range(3):  # codebooks for the anisotropic loss, codes fixed; then new codes
        code = index.encode(x, at)
        err = np.stack([r[:, j] - index.books[j][code[:, j]] for j in range(m)], 1)
        par = (err * u).sum(2)
        for j in range(m):
            other = par.sum(1) - par[:, j]
            for k in range(16):
                s = code[:, j] == k
                if s.sum() > width:
                    uu = np.einsum("ni,nj->ij", u[s, j], u[s, j]) * (eta - 1) + np.eye(width) * s.sum()
                    rhs = r[s, j].sum(0) + (eta - 1) * ((r[s, j] * u[s, j]).sum(1) + other[s]) @ u[s, j]
                    index.books[j, k] = np.linalg.solve(uu, rhs)
            par[:, j] = ((r[:, j] - index.books[j][code[:, j]]) * u[:, j]).sum(1)
    code = index.encode(x, at)
    index.spread = float(np.sqrt(np.mean([((r[:, j] - index.books[j][code[:, j]]) ** 2).sum(1) for j in range(m)]) * m / d))
    return index


def needed_share(index: Index, x: np.ndarray, k: int, recall: float, queries: int = 300) -> float:
    """Least part of the cells, in the order of their centres' scores, that holds `recall` of the k best rows of the sample for its first rows."""
    q = x[:queries]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, max(1, len(x) - 1))]
    cell = index.cell(x)
    place = np.argsort(np.argsort(-(q @ index.centres.T), axis=1, kind="stable"), axis=1)
    need = np.sort(place[np.arange(len(q))[:, None], cell[near]].ravel())
    return float(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)] + 1) / len(index.centres)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(base: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 20, key: str = "vec_id", vec: str = "embedding", **how) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of base for each row of queries (both: key, vec), but the query's own. how: see _search."""
    side = lambda df: usable(df.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("embedding")).where("id is not null"))
    src, asked = side(base), side(queries)
    sizes = {r["n"]: r["count"] for r in src.groupBy(F.size("embedding").alias("n")).count().collect()}  # one row for each length
    out = scratch.spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for dim in sorted(sizes):
        mine = asked.where(F.size("embedding") == dim)
        if len(sizes) == 1 or not mine.isEmpty():
            out = out.union(_search(src.where(F.size("embedding") == dim), mine, scratch, k, dim, sizes[dim], **how))
    return out


def _search(src: DataFrame, asked: DataFrame, scratch: Scratch, k: int, dim: int, n: int, recall: float = 0.98, block: int = 4096, rerank: int = 8) -> DataFrame:
    """Search among the n vectors of one length.

    recall: of the sample's own exact neighbours, the part that must lie in the cells a query reads; sets the number of cells.
    rerank: so many times k of a block, at least, are ranked by the exact product.
    """
    sample = src.select("embedding").orderBy(F.xxhash64("id", F.lit(5)), "id", "embedding").limit(SAMPLE).collect()
    cells = max(1, round(n**0.5 / 4)) if n > 2000 else 1
    known = np.array([r[0] for r in sample])
    index = train(known, cells)
    share = needed_share(index, known, k, recall)

    def code(batches):
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column(1), dim)
                cell = index.cell(x)
                c = index.encode(x, cell)
                packed = (c[:, 0::2] * 16 + c[:, 1::2]).astype(np.uint8)
                raw = pa.array([p.tobytes() for p in packed], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), *raw, b.column(2)], names=["id", "cell", "code", "vec", "copies"])

    alike = src.groupBy("id", "embedding").agg(F.count("*").alias("copies"))
    coded = scratch.write(map_arrow(alike, code, "id bigint, cell int, code binary, vec binary, copies bigint"), "codes")
    sizes = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}  # one row per cell
    full = np.array([sizes.get(c, 0) for c in range(len(index.centres))])
    probes = min(len(full), max(8, int(np.ceil(share * len(full)))))

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = _vectors(b.column(1), dim)
            order = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")
            held = np.cumsum(full[order], 1)
            use = (np.arange(order.shape[1])[None, :] < probes) | (held - full[order] < 4 * k + 1)  # so many cells, and enough rows
            row, at = np.nonzero(use & (full[order] > 0))
            cell = order[row, at]
            blocks = -(-full[cell] // block)
            row, cell, which = np.repeat(row, blocks), np.repeat(cell, blocks), np.concatenate([np.arange(x) for x in blocks]) if len(blocks) else np.zeros(0, int)
            raw = [v.tobytes() for v in q]
            cols = [pa.array(cell, pa.int32()), pa.array(which, pa.int32()), pa.array([raw[i] for i in row], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *cols, b.column(2).take(pa.array(row))], names=["id", "cell", "block", "vec", "copies"])

    asked = asked.groupBy("id", "embedding").agg(F.count("*").alias("copies")).mapInArrow(probe, "id bigint, cell int, block int, vec binary, copies bigint")
    turns = F.broadcast(scratch.spark.createDataFrame([(int(c), -(-x // block)) for c, x in sorted(sizes.items())], "cell int, blocks int"))  # one row per cell
    dealt = coded.join(turns, "cell").withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.col("blocks")).cast("int"))
    both = dealt.select("cell", "block", F.lit(0).alias("asks"), "id", F.xxhash64("vec").alias("own"), "code", "vec", "copies")
    both = both.unionByName(asked.select("cell", "block", F.lit(1).alias("asks"), "id", F.xxhash64("vec").alias("own"), F.lit(None).cast("binary").alias("code"), "vec", "copies"))
    both = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "asks", "id")

    def scan(batches):
        for t in _whole_groups(batches, ["cell", "block"]):
            cell, blk, asks = (t.column(c).to_numpy() for c in ("cell", "block", "asks"))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (blk[1:] != blk[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                mid = lo + int(np.searchsorted(asks[lo:hi], 1))
                if mid in (lo, hi):
                    continue
                codes = np.frombuffer(b"".join(t.column("code").slice(lo, mid - lo).to_pylist()), np.uint8).reshape(mid - lo, -1)
                rows = _Side(t, lo, mid, dim)
                for at in range(mid, hi, 128):
                    yield _best(index, _Side(t, at, min(hi, at + 128), dim), rows, codes, int(cell[lo]), k, rerank)

    found = map_arrow(both, scan, "query_id bigint, own bigint, times bigint, vec_id bigint, score double, copies bigint")
    order = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")  # k rows for each block read
    found = found.withColumn("row", F.row_number().over(order)).where(F.col("row") <= k)  # a row is a copy at least: each task keeps k rows before the shuffle
    found = found.withColumn("upto", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("before", F.col("upto") - F.col("copies")).where(F.col("before") < k)
    each = found.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("upto"), F.lit(k)))))
    several = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))  # rows alike in id and vector have equal lists
    return each.withColumn("copy", several).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class _Side:
    """Rows lo to hi - 1 of a table of queries or candidates: ids, hashes of the vectors, copies and vectors."""

    def __init__(self, t: pa.Table, lo: int, hi: int, dim: int):
        self.ids, self.own, self.copies = (t.column(c).slice(lo, hi - lo).to_numpy() for c in ("id", "own", "copies"))
        self.vectors = np.frombuffer(b"".join(t.column("vec").slice(lo, hi - lo).to_pylist()), np.float64).reshape(-1, dim)


def _best(index: Index, q: _Side, rows: _Side, codes: np.ndarray, cell: int, k: int, rerank: int) -> pa.RecordBatch:
    """The k best rows of the cell's block for each query. Of a query's own row, its copies but one are candidates."""
    rough = index.scan(q.vectors, codes, cell)
    own = (q.ids[:, None] == rows.ids[None, :]) & (q.own[:, None] == rows.own[None, :])
    rough[own & (rows.copies == 1)[None, :]] = -np.inf
    n = len(rows.ids)
    keep = min(n, k * rerank)
    least = np.partition(rough, n - keep, 1)[:, n - keep]
    kth = np.partition(rough, max(0, n - k), 1)[:, max(0, n - k)]
    bar = np.minimum(least, kth - 3 * index.spread * np.linalg.norm(q.vectors, axis=1))  # all that the table scan can't tell from the k best are ranked exactly
    out = [[], [], [], [], [], []]
    for i in range(len(q.ids)):
        left = rows.copies - own[i]
        near = np.flatnonzero((rough[i] >= bar[i]) & (left > 0))
        score = (rows.vectors[near] * q.vectors[i]).sum(1)
        best = np.lexsort((rows.ids[near], -score))[:k]
        for o, x in zip(out, (np.full(len(best), q.ids[i]), np.full(len(best), q.own[i]), np.full(len(best), q.copies[i]), rows.ids[near][best], score[best], left[near][best]), strict=True):
            o.append(x)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "own", "times", "vec_id", "score", "copies"])


def neighbours(embeddings: DataFrame, scratch: Scratch, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest rows of every row whose id is divisible by `every`."""
    return search(embeddings, embeddings.where(F.col("vec_id") % every == 0), scratch, k)
