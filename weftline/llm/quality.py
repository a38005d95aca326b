"""Quality: Bradley-Terry pairwise ranking.

Each text gets shape features (symbol, case and digit shares, word and line lengths, repetition). A feature is cut at the
quantiles of all training documents and of those of label 0, and enters as its bins. The preference pairs are all pairs of a document of
label 1 over one of label 0; the document score is learned by logistic loss on the difference of the pair's features. The cut is the quantile of
the training scores at the share of label 0; the published score is the logistic of the distance to that cut, moved so that the
cut lies at 0.7.

Every labelled document outside the test fold takes part in the counts, the quantiles, the pairs and the cut; nothing is sampled. Training is a row of passes
over the documents' features: sums of what each block of rows gives. Up to LOCAL_ROWS rows the driver makes them itself; beyond, each is a Spark job over the same rows.
The sum over all pairs needs no pairs: the logistic function is interpolated on a fine grid of scores (some 1e-12 off), so a pass spreads each label's
documents over the grid and a second one reads every document's sum over the other label from it.

Defined cases: null text counts as empty, and an empty text has all features 0; repeated rows are trained on and scored row by row, each with the largest label of its id;
null labels and null ids don't count in training; without labels of both kinds every score is the share of label 1 (0 without any label); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textvec as tv
from weftline.llm.common import Scratch, crc_mod, map_arrow, map_texts

CUT = 0.7
FEATURES = 14
LOCAL_ROWS = 200_000  # training rows that the driver passes over itself
BROADCAST_ROWS = 1_000_000
_ODDS = float(np.log(CUT / (1 - CUT)))
_STEP = 1 / 16  # of the grid of scores
_NODES = np.arange(-3, 5)  # that a score is interpolated from
_U = np.uint64


def features(texts) -> np.ndarray:
    """One row of shape features for each whole text."""
    out = [_features(run) for _, run in tv.chunks(texts, 1 << 19)]
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


def _classes() -> np.ndarray:
    """Of the code points below 2**16: 1 upper-case, 2 other letter, 3 digit, 4 space, 5 sentence mark, 6 other."""
    kinds = np.full(1 << 16, 6, np.int8)
    for c in range(0xD800):
        s = chr(c)
        kinds[c] = 1 if s.isupper() else 2 if s.isalpha() else 3 if s.isdigit() else 4 if s.isspace() else 5 if s in ".,;:'\"-?()" else 6
    return kinds


_KINDS: list[np.ndarray] = []


def _features(texts: list[str]) -> np.ndarray:
    if not _KINDS:
        _KINDS.append(_classes())
    codes, offs = tv.pack(texts)
    n = len(texts)
    kind = _KINDS[0][np.minimum(codes, 0xFFFF)]
    kind[codes >= 1 << 16] = 2
    kind[offs[1:] - 1] = 0
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), offs[:-1])
    upper, lower, digit, mark, other = (per(kind == k) for k in (1, 2, 3, 5, 6))
    shouts, lines = per(codes == 33), per(codes == 10) + 1
    chars = np.maximum(np.diff(offs) - 1, 1)
    letters = np.maximum(upper + lower, 1)
    starts, ends, wdoc = tv.runs(tv.words_of(codes), offs)
    words = np.bincount(wdoc, minlength=n)
    safe = np.maximum(words, 1)
    h = tv.hash_runs(codes, starts, ends)
    bare = np.bincount(wdoc, (ends - starts == 1) & (kind[starts] >= 5) if len(starts) else None, minlength=n)
    tail = np.bincount(wdoc, kind[ends - 1] == 6 if len(starts) else None, minlength=n)
    same = np.zeros(n)
    if len(h) > 1:
        again = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
        same = np.bincount(wdoc[1:], again, minlength=n)
    distinct, top = np.zeros(n), np.zeros(n)
    if len(h):
        order = np.lexsort((h, wdoc))
        hs, ds = h[order], wdoc[order]
        new = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]))
        distinct = np.bincount(ds[new], minlength=n).astype(float)
        np.maximum.at(top, ds[new], np.diff(np.concatenate([new, [len(hs)]])))
    cols = [
        np.log1p(words), np.bincount(wdoc, ends - starts, minlength=n) / safe, upper / letters, lower / chars, digit / chars, mark / chars, other / chars,
        shouts / safe, bare / safe, tail / safe, same / safe, distinct / safe, top / safe, np.log1p(words / lines),
    ]
    return np.stack([np.asarray(c, float) for c in cols], 1)


@dataclass
class Model:
    cuts: list[np.ndarray]  # of each feature
    weights: np.ndarray  # of all bins
    shift: float  # score at the cut

    def scores(self, x: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(x)), 0
        for k, c in enumerate(self.cuts):
            out += self.weights[at + np.searchsorted(c, x[:, k], "right")]
            at += len(c) + 1
        return out


class Rows:
    """Training rows (values, label, how many rows): one block in this process, or a table (v, y, n) with the values as bytes."""

    def __init__(self, kind: str, block: tuple | None = None, table: DataFrame | None = None, scratch: Scratch | None = None):
        self.kind, self.block, self.table, self.scratch = kind, block, table, scratch

    def total(self, fn: Callable, shape: tuple[int, ...]) -> np.ndarray:
        """The sum of fn(values, labels, counts), of this shape, over all blocks."""
        if self.block is not None:
            return fn(*self.block)
        kind = self.kind

        def run(batches):
            out = np.zeros(shape)
            for b in batches:
                out += fn(*_block(b, kind))
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

        out = np.zeros(shape)
        for r in map_arrow(self.table, run, "part binary").collect():  # one row a task
            out += np.frombuffer(r["part"]).reshape(shape)
        return out

    def coded(self, cuts: list[np.ndarray]) -> Rows:
        """Each row's bins instead of its values; rows alike become one with their number."""
        if self.block is not None:
            x, y, n = self.block
            got, at = np.unique(np.column_stack([_bins(x, cuts), y]), axis=0, return_inverse=True)
            return Rows("<u2", (got[:, :-1], got[:, -1], np.bincount(at.ravel(), n, minlength=len(got))))
        kind = self.kind

        def run(batches):
            for b in batches:
                codes = _bins(_block(b, kind)[0], cuts).astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), *b.columns[1:]], names=["v", "y", "n"])

        codes = map_arrow(self.table, run, "v binary, y int, n bigint").groupBy("v", "y").agg(F.sum("n").alias("n"))
        return Rows("<u2", table=self.scratch.write(codes.sortWithinPartitions("v", "y"), "codes"), scratch=self.scratch)


def _block(b: pa.RecordBatch | pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.frombuffer(b"".join(b.column(0).to_pylist()), kind).reshape(-1, FEATURES)
    return values, b.column(1).to_numpy(), b.column(2).to_numpy()


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)], 1)


def quantiles(rows: Rows, q: np.ndarray, value: Callable = lambda x: x, width: int = FEATURES, label: int | None = None) -> np.ndarray:
    """Exact quantiles, linear between neighbours, of each column of value(values) over all rows, or those of a label.

    The order statistics are found digit by digit in the doubles' bits: sixteen passes that count rows, whatever their number.
    """

    def chosen(x, y, n):
        on = slice(None) if label is None else y == label
        return np.ascontiguousarray(value(x[on]), np.float64) + 0.0, n[on]

    size = int(rows.total(lambda x, y, n: np.array([chosen(x, y, n)[1].sum()], float), (1,))[0])
    place = q * (size - 1)
    low = np.floor(place).astype(np.int64)
    ranks = np.unique(np.concatenate([low, np.minimum(low + 1, size - 1)]))
    known, left = np.zeros((width, len(ranks)), _U), np.tile(ranks, (width, 1))
    for shift in range(60, -1, -4):

        def count(x, y, n, known=known, shift=shift):
            v, n = chosen(x, y, n)
            bits = v.view(_U)
            bits = (bits ^ np.where(bits >> _U(63), ~_U(0), _U(1 << 63))) >> _U(shift)  # in the order of the doubles
            out = np.zeros((*known.shape, 16))
            for k in range(width):
                heads, of = np.unique(known[k], return_inverse=True)
                head = bits[:, k] >> _U(4)
                at = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
                ok = heads[at] == head
                out[k] = np.bincount(at[ok] * 16 + (bits[ok, k] & _U(15)).astype(np.int64), n[ok], 16 * len(heads)).reshape(-1, 16)[of]
            return out

        upto = np.cumsum(rows.total(count, (*known.shape, 16)), 2).astype(np.int64)
        digit = (upto <= left[:, :, None]).sum(2)
        left = left - np.where(digit > 0, np.take_along_axis(upto, np.maximum(digit - 1, 0)[:, :, None], 2)[:, :, 0], 0)
        known = (known << _U(4)) | digit.astype(_U)
    found = (known ^ np.where(known >> _U(63), _U(1 << 63), ~_U(0))).view(np.float64)
    a, b = found[:, np.searchsorted(ranks, low)], found[:, np.searchsorted(ranks, np.minimum(low + 1, size - 1))]
    t = place - low
    return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)


def _spread(s: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each score, the grid's nodes around it (the grid begins at node `first`) and their weights in the interpolation."""
    at = np.floor(s / _STEP)
    t = (s / _STEP - at)[:, None] - _NODES
    weights = np.ones_like(t)
    for j, node in enumerate(_NODES):
        for m, other in enumerate(_NODES):
            if m != j:
                weights[:, j] *= t[:, m] / (node - other)
    return at.astype(np.int64)[:, None] + (_NODES - first), weights


def _all_pairs(rows: Rows, base: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient by w of the logistic loss summed over all pairs of a row of label 1 and one of label 0."""
    bins = [w[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]
    first = int(np.floor(sum(b.min() for b in bins) / _STEP)) - 8
    size = int(np.ceil(sum(b.max() for b in bins) / _STEP)) + 8 - first
    start = base[:-1]

    def spread(x, y, n):
        at, weights = _spread(w[start + x].sum(1), first)
        return np.stack([np.bincount(at[y == c].ravel(), (weights[y == c] * n[y == c, None]).ravel(), size) for c in (0, 1)])

    bad, good = rows.total(spread, (2, size))
    wins = 1 / (1 + np.exp(np.clip(-_STEP * np.arange(1 - size, size), -500, 500)))
    pull = np.stack([np.convolve(good, wins)[size - 1 : 2 * size - 1], -np.convolve(bad, wins[::-1])[size - 1 : 2 * size - 1]])  # on a row of label 0, and of label 1

    def gather(x, y, n):
        x, y, n = x[y < 2], y[y < 2], n[y < 2]
        at, weights = _spread(w[start + x].sum(1), first)
        each = (pull[y[:, None], at] * weights).sum(1) * n
        return sum(np.bincount(start[k] + x[:, k], each, len(w)) for k in range(FEATURES))

    return rows.total(gather, (len(w),))


def learn(rows: Rows, bins: int = 24, pairs: int | None = None, steps: int = 150, ridge: float = 1e-4, seed: int = 7) -> Model:
    """Model from all rows (label 2: neither 0 nor 1) and all pairs; `pairs`, where given, draws that many instead, from a block."""
    count, n_bad, n_good = rows.total(lambda x, y, n: np.array([n.sum(), n[y == 0].sum(), n[y == 1].sum()], float), (3,))
    if not n_good or not n_bad:
        share = n_good / max(1, count)
        return Model([], np.zeros(0), -float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)) - _ODDS))
    q = np.arange(1, bins) / bins
    cuts = [np.unique(c) for c in np.concatenate([quantiles(rows, q), quantiles(rows, q, label=0)], 1)]
    base = np.cumsum([0, *(len(c) + 1 for c in cuts)])
    coded = rows.coded(cuts)
    if pairs:
        x, y, _ = rows.block
        code, rng = base[:-1] + _bins(x, cuts), np.random.default_rng(seed)
        i, j = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)

    def gradient(w):
        if not pairs:
            return _all_pairs(coded, base, w) / (n_good * n_bad)
        s = w[code].sum(1)
        e = -1 / (1 + np.exp(np.clip(s[i] - s[j], -500, 500)))  # d loss / d (difference)
        each = np.bincount(i, e, minlength=len(y)) - np.bincount(j, e, minlength=len(y))
        return sum(np.bincount(code[:, k], each, minlength=len(w)) for k in range(code.shape[1])) / pairs

    w = np.zeros(base[-1])
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w) + ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    start = base[:-1]
    shift = quantiles(coded, np.array([n_bad / count]), lambda x: w[start + x].sum(1)[:, None], 1)
    if coded.table is not None:
        coded.scratch.drop(coded.table)
    return Model(cuts, w, float(shift[0, 0]))


def train(texts: list[str], labels: list[int], **how) -> Model:
    """learn() from texts in this process."""
    y = np.asarray(labels, int)
    return learn(Rows("<f8", (features(texts), np.where((y == 0) | (y == 1), y, 2), np.ones(len(y), np.int64))), **how)


def describe(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep columns and v, the features of the text as bytes, of every row."""
    return map_texts(docs, keep or ["doc_id"], lambda texts: {"v": [x.tobytes() for x in features(texts).astype("<f8")]}, "v binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", test_fold: tuple[int, int] | None = (4, 2), **how) -> Model:
    """Model from every labelled document; ids in the test fold are left out."""
    return _fit(describe(docs), labels, label, test_fold, **how)


def _fit(described: DataFrame, labels: DataFrame, label: str = "quality", test_fold: tuple[int, int] | None = (4, 2), **how) -> Model:
    scratch = Scratch(described.sparkSession)
    take = crc_mod("doc_id", test_fold[0]) != test_fold[1] if test_fold else F.lit(True)
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & take).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = ids.withColumn("y", F.when(F.col("y").isin(0, 1), F.col("y")).otherwise(2))
    side = F.broadcast(ids) if labels.count() <= BROADCAST_ROWS else ids
    table = scratch.write(described.join(side, "doc_id").select("v", "y", F.lit(1).cast("bigint").alias("n")), "labelled")
    if table.count() <= LOCAL_ROWS:
        rows = Rows("<f8", _block(table.toArrow(), "<f8"))
    else:
        rows = Rows("<f8", table=table, scratch=scratch)
    model = learn(rows, **how)
    scratch.drop(table)
    return model


def _published(x: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    s = 1 / (1 + np.exp(-np.clip(model.scores(x) - model.shift + _ODDS, -500, 500)))
    return {"score": s, "predicted": (s >= CUT).astype(np.int32)}


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """keep columns, score (0 to 1) and predicted (1 if score >= 0.7) of every row."""
    return map_texts(docs, keep or ["doc_id"], lambda texts: _published(features(texts), model), "score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; texts are read once, for their features."""
    described = Scratch(docs.sparkSession).write(describe(docs), "features")
    model = _fit(described, labels, **how)

    def run(vs):
        return _published(np.frombuffer(b"".join(vs), "<f8").reshape(-1, FEATURES), model)

    scored = map_texts(described, ["doc_id"], run, "score double, predicted int", text="v")
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
