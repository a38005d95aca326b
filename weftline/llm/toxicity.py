"""Toxicity: character n-gram linear classifier, features scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 3 to 6 characters of the lower-cased text (white space collapsed to one space, one at
either end), hashed into 2**22 buckets. r = log ratio of smoothed document counts under label 1 and label 0; a logistic
regression is trained on the binary features times r. Only the `keep` buckets whose counts differ most from independence take
part, and of those the clearly dependent. Training is on a bounded sample (max_docs, max_chars); scoring reads every whole text.

Defined cases: null text counts as empty; an empty text, or one shorter than every n-gram, has no feature, so its score is the prior's;
repeated rows and ids are scored row by row; without labels of both kinds every score is the share of label 1 (0 without any label);
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textvec as tv
from weftline.llm.common import crc_mod, labelled_sample, map_texts

BITS = 22
SIZES = (3, 4, 5, 6)


@dataclass
class Model:
    bias: float
    buckets: np.ndarray  # ascending int32
    weights: np.ndarray  # of the same places: log-count ratio times coefficient


def _present(texts, wanted: np.ndarray | None = None):
    """Per chunk: first text, distinct (text in the chunk, bucket) pairs; only wanted buckets, where given."""
    for first, run in tv.chunks(texts, 1 << 19):
        for lo in range(0, len(run), 512):
            part = [f" {' '.join(t.lower().split())} " for t in run[lo : lo + 512]]
            codes, offs = tv.pack(part)
            doc = np.repeat(np.arange(len(part), dtype=np.int64), np.diff(offs))
            left = offs[1:][doc] - 1 - np.arange(len(codes))  # characters from here to the text's end
            keys = []
            for n, bucket in tv.ngram_buckets(codes, SIZES, BITS):
                ok = left >= n
                if wanted is not None:
                    ok &= wanted[bucket]
                keys.append(((doc[ok] << BITS) | bucket[ok]).astype(np.uint32))
            key = np.sort(np.concatenate(keys))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            yield first + lo, len(part), (key >> BITS).astype(np.int64), (key & ((1 << BITS) - 1)).astype(np.int64)


def train(texts: list[str], labels: list[int], keep: int = 8000, steps: int = 120, ridge: float = 1e-4) -> Model:
    """Deterministic full-batch training; equal texts count once (with the larger label)."""
    largest: dict[str, int] = {}
    for t, v in zip(texts, labels, strict=True):
        largest[t] = max(v, largest.get(t, 0))
    texts, labels = list(largest), list(largest.values())
    y = np.asarray(labels, float)
    pos, neg = y.sum(), (1 - y).sum()
    if not pos or not neg:
        share = pos / max(1.0, pos + neg)
        return Model(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(0, np.int32), np.zeros(0))
    p, a = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for first, _, doc, bucket in _present(texts):
        a += np.bincount(bucket, minlength=1 << BITS).astype(np.int32)
        p += np.bincount(bucket[y[first + doc] > 0], minlength=1 << BITS).astype(np.int32)
    r = np.log((p + 1) / (pos + 2)) - np.log((a - p + 1) / (neg + 2))
    gap = np.abs(p - pos / len(y) * a) / np.sqrt(a * (pos / len(y)) + 1e-9)
    gap[(a < 4) | (gap < 5)] = 0  # what a random n-gram of a few documents reaches is left out
    chosen = np.argsort(-gap, kind="stable")[:keep]
    chosen = np.sort(chosen[gap[chosen] > 0])
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True
    docs, feats = [], []
    for first, _, doc, bucket in _present(texts, wanted):
        docs.append(first + doc)
        feats.append(np.searchsorted(chosen, bucket))
    d, f = np.concatenate(docs), np.concatenate(feats)
    ratio = r[chosen]
    v = ratio[f]
    w, b = np.zeros(len(chosen)), float(np.log(pos / neg))
    m1, m2, c1, c2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for i in range(1, steps + 1):  # Adam on the whole sample
        z = b + np.bincount(d, v * w[f], minlength=len(y))
        err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        g, gb = np.bincount(f, v * err[d], minlength=len(w)) / len(y) + ridge * w, err.mean()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
        w -= 0.05 * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
        b -= 0.05 * (c1 / (1 - 0.9**i)) / (np.sqrt(c2 / (1 - 0.99**i)) + 1e-8)
    return Model(b, chosen.astype(np.int32), w * ratio)


def logits(texts, model: Model, tables: list | None = None) -> np.ndarray:
    """Of each whole text. tables: filled once and reused over batches."""
    tables = [] if tables is None else tables
    if not tables:
        wanted = np.zeros(1 << BITS, bool)
        wanted[model.buckets] = True
        tables.append(wanted)
    out = np.full(len(texts), model.bias)
    if len(model.buckets):
        for first, n, doc, bucket in _present(texts, tables[0]):
            out[first : first + n] += np.bincount(doc, model.weights[np.searchsorted(model.buckets, bucket)], minlength=n)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_docs: int = 6000, max_chars: int = 24_000_000, test_fold: tuple[int, int] | None = (5, 0)) -> Model:
    """Model from at most max_docs labelled documents and max_chars characters; ids in the test fold are left out."""
    take = crc_mod("doc_id", test_fold[0]) != test_fold[1] if test_fold else F.lit(True)
    texts, ys = labelled_sample(docs, labels, label, take, max_docs, max_chars)
    return train(texts, ys)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """keep columns, score (0 to 1) and predicted (1 if score >= threshold) of every row."""
    tables: list = []

    def run(texts):
        s = 1 / (1 + np.exp(-np.clip(logits(texts, model, tables), -500, 500)))
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_texts(docs, keep or ["doc_id"], run, "score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels, **how))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    tables: list = []
    model = fit(docs, labels, **how)
    names = docs.columns

    def run(texts):
        return {"__toxic": logits(texts, model, tables) >= 0}

    return map_texts(docs, names, run, "__toxic boolean").where(~F.col("__toxic")).select(*[F.col(f"`{c}`") for c in names])
