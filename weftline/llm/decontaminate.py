"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification; all over words.

An item's near copy is a passage whose word edit distance to the item is at most `edits` (a fifth) of the item's words. Such a
passage shares a run of ceil((m - k) / (k + 1)) words with the item (pigeonhole; m words, k edits), so only windows aligned with a shared run
of that length, or of 3 words, can match; no match is lost by leaving out the others. Each such item-sized window is embedded by the CGK random walk (a
pointer that repeats or advances by a random bit of the word it stands on), which turns edit distance into Hamming distance;
sampled places of the embedding are the LSH key. The number of repetitions is set for each item length: so many that the target share
of simulated copies, edited at the limit, is met at least once. Colliding (window, item) pairs are verified by exact approximate-substring
edit distance. For lengths at which MOST repetitions don't reach the target, every passage that shares enough runs with an item (k edits
destroy at most k * q of its runs of q words) is verified without LSH, so that nothing is lost there.

Defined cases: null and empty texts match nothing; items without words can't match; items of fewer than five words allow no edit, so they match exactly
(min_words leaves short items out); items with a null id are searched like others; texts of any length are searched whole; of equally near passages of a text the
first counts; repeated rows get equal results, equal items each match; an empty table of either kind gives no match. Of the documents only doc_id and text are
read; drop_contaminated keeps all their columns, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textvec as tv
from weftline.llm.common import map_texts

_U = np.uint64
_PAD = _U(0x5BD1E995A4F3C2E7)
_ODD = _U(0x9E3779B97F4A7C15)
MAX_ITEMS = 50_000
MOST = 256  # repetitions; beyond, the exact check of all passages costs less
COPIES = 400  # simulated for each length


@lru_cache(2)
def _walk(seed: int) -> np.ndarray:
    return (tv.mix64(np.arange(MOST * 1024, dtype=_U) + _U(seed << 32)) | _U(1)).reshape(MOST, 1024)


class Index:
    """The items' runs and LSH tables."""

    def __init__(self, ids: list[int | None], texts: list[str], edits: float = 0.2, recall: float = 0.99, places: int = 3, min_words: int = 1, seed: int = 11):
        self.edits, self.places = edits, places
        words, doc, _, _ = tv.word_hashes([t or "" for t in texts])
        parts = np.split(words, np.searchsorted(doc, np.arange(1, len(texts)))) if texts else []
        kept = [i for i, w in enumerate(parts) if len(w) >= min_words]
        self.ids, self.items = [ids[i] for i in kept], [parts[i] for i in kept]
        self.flat = np.concatenate(self.items) if self.items else np.zeros(0, _U)
        self.sizes = np.array([len(w) for w in self.items], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.seed = seed
        lengths = sorted({len(w) for w in self.items})
        self.grams = self._run_table(range(len(self.items)))
        self.repeats = self._repeats(lengths, recall)
        self.tables: dict[int, tuple] = {}
        for m in lengths:
            which = [i for i, w in enumerate(self.items) if len(w) == m]
            steps = self.steps(m, 0, self.repeats[m] or 0)
            mat = np.stack([self.items[i] for i in which])
            keys = self.signatures(mat, steps).ravel()  # all repetitions in one table: the number of the repetition is part of the key
            order = np.argsort(keys, kind="stable")
            self.tables[m] = (np.array(which), steps, keys[order], order % len(which))
        self.grams = self._run_table([i for i, w in enumerate(self.items) if self.repeats[len(w)]])
        self.exact = self._gram_table([i for i, w in enumerate(self.items) if not self.repeats[len(w)]])

    def _gram_table(self, which) -> dict[int, tuple]:
        """By length of run: runs in order, and the item and the place in it of each."""
        out = {}
        for q in sorted({self.run(len(self.items[i])) for i in which}):
            own = [i for i in which if self.run(len(self.items[i])) == q]
            grams = [gram(self.items[i], q)[: len(self.items[i]) - q + 1] for i in own]
            keys, item, offset = np.concatenate(grams), np.repeat(own, [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams])
            order = np.lexsort((offset, item, keys))
            out[q] = (keys[order], item[order], offset[order])
        return out

    def _run_table(self, which) -> dict[int, tuple]:
        """By length of run: runs in order, and the distinct lengths of the items with the run and places in them."""
        out = {}
        for q, (keys, item, offset) in self._gram_table(which).items():
            size = self.sizes[item]
            order = np.lexsort((offset, size, keys))
            keys, size, offset = keys[order], size[order], offset[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (size[1:] != size[:-1]) | (offset[1:] != offset[:-1])])
            out[q] = (keys[new], size[new], offset[new])
        return out

    def steps(self, m: int, first: int, last: int) -> list[np.ndarray]:
        """Sampled places of the repetitions first to last - 1 for items of m words."""
        return [np.sort(np.random.default_rng([self.seed, m, r]).choice(3 * m, min(self.places, 3 * m), replace=False)) for r in range(first, last)]

    def limit(self, m: int) -> int:
        return int(self.edits * m)

    def run(self, m: int) -> int:
        k = self.limit(m)
        return max(1, min(3, -(-(m - k) // (k + 1))))

    def signatures(self, windows: np.ndarray, steps: list[np.ndarray], first: int = 0) -> np.ndarray:
        """LSH keys (repetitions from `first` on x rows) of rows of words: the CGK embedding of each repetition at its sampled steps."""
        n, m = windows.shape
        ends = np.array([own[-1] for own in steps], np.int64)
        order = np.argsort(-ends, kind="stable")  # the walks still under way are the first ones
        span = int(ends.max(initial=-1)) + 1
        flat = np.full((n, m + span), _PAD, _U)
        flat[:, :m] = windows
        due: dict[int, list[int]] = {}
        for place, r in enumerate(order.tolist()):
            for j in steps[r].tolist():
                due.setdefault(j, []).append(place)
        seeds = _walk(self.seed)[first : first + len(steps)][order]
        at = np.repeat((np.arange(n) * (m + span))[None, :], len(steps), 0)
        out = np.repeat(tv.mix64(order.astype(_U) + _U(first))[:, None], n, 1)
        flat = flat.ravel()
        lives = np.searchsorted(-ends[order], -np.arange(span), "right").tolist()
        for j, live in enumerate(lives):
            sym = flat.take(at[:live])
            for place in due.get(j, ()):
                row = out[place]
                row += sym[place]
                row *= _ODD
                row ^= row >> _U(31)
            sym *= seeds[:live, j % seeds.shape[1], None]  # words are hashes already: a multiplication makes a fresh bit of them
            sym >>= _U(63)
            at[:live] += sym.view(np.int64)
        back = np.empty_like(out)
        back[order] = out
        return back

    def _repeats(self, lengths: list[int], recall: float) -> dict[int, int | None]:
        """Repetitions by item length; None: verified without LSH.

        Up to 64 words each length is simulated. Longer ones go by the longest within a tenth, with its edits rounded up. No length has fewer than
        a shorter one, as rates fall with length and single draws of places can be lucky; all beyond a length that MOST repetitions
        don't serve are verified without LSH, too.
        """
        out: dict[int, int | None] = {}
        left, most = list(lengths), 1
        while left:
            group = [m for m in left if m <= max(left[0], left[0] * 1.1 if left[0] > 64 else 0)]
            m = group[-1]
            n = self._simulated(m, math.ceil(self.edits * m) if m > 64 else self.limit(m), recall)
            most = None if n is None else max(most, n)
            if most is None:
                return out | dict.fromkeys(left)
            out |= dict.fromkeys(group, most)
            left = left[len(group) :]
        return out

    def _simulated(self, m: int, k: int, recall: float) -> int | None:
        """Repetitions that meet the recall's share of copies with k edits at least once, by all windows that are tried."""
        if not k or recall >= 1:
            return None if k else 1
        mat = np.stack([w for w in self.items if len(w) == m][:COPIES])
        rng = np.random.default_rng([self.seed, m])
        texts = []
        for i in range(COPIES):
            c = mat[i % len(mat)].tolist()
            for _ in range(k):
                p, kind = int(rng.integers(len(c))), int(rng.integers(4))
                new = int(rng.integers(1 << 63))
                c[p : p + (kind != 1)] = [new] if kind < 3 else []  # substitution twice as often as insertion and deletion
            texts.append(np.concatenate([rng.integers(1 << 63, size=k).astype(_U), np.array(c, _U), rng.integers(1 << 63, size=2 * k).astype(_U)]))
        words, bounds = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
        first, last = (np.repeat(x, np.diff(bounds)) for x in (bounds[:-1], bounds[1:]))
        start, begin, end = next((w for size, w in self.windows(words, first, last, m)), np.zeros((3, 0), np.int64))
        copy, view = np.searchsorted(bounds, begin), view_of(words, start, end, m)
        met = np.full(COPIES, MOST)
        due = math.ceil(recall * COPIES + 1.3 * math.sqrt(COPIES * recall * (1 - recall)))  # so that nine in ten such simulations hold what they say
        for r in range(0, MOST, 16):
            open_ = np.flatnonzero(met[copy] == MOST)
            steps = self.steps(m, MOST + r, MOST + r + 16)  # not those of the tables: these must not be lucky for these copies
            hit = self.signatures(view[open_], steps, r) == self.signatures(mat, steps, r)[:, copy[open_] % len(mat)]
            np.minimum.at(met, copy[open_], np.where(hit.any(0), r + hit.argmax(0), MOST))
            missed = np.count_nonzero(met == MOST)
            if COPIES - missed >= due:
                return int(np.sort(met)[due - 1]) + 1
            if (missed / COPIES) ** (MOST / (r + 16)) > 1 - recall:  # what is missed falls more slowly from repetition to repetition
                return None
        return None

    def _shared(self, table: tuple, q: int, words: np.ndarray, last: np.ndarray):
        """Place, second and third column of the table's row, of every run of q words that the words share with the table."""
        keys, items, offsets = table
        g = gram(words, q)
        lo = np.searchsorted(keys, g)
        hit = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == g)) if len(keys) else np.zeros(0, int)
        hit = hit[last[hit] - hit >= q]
        lo, hi = lo[hit], np.searchsorted(keys, g[hit], "right")
        count = hi - lo
        row = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(hit, count), items[row], offsets[row]

    def windows(self, words: np.ndarray, first: np.ndarray, last: np.ndarray, only: int | None = None):
        """Distinct (size, start, text bounds) of windows that can hold a near copy. first, last: bounds of each word's text."""
        got: dict[int, list[np.ndarray]] = {}
        for q, table in self.grams.items():
            place, size, offset = self._shared(table, q, words, last)
            start = np.clip(place - offset, first[place], last[place] - 1)
            for m in [only] if only else np.unique(size).tolist():
                mine = size == m
                if mine.any():
                    got.setdefault(m, []).append(np.unique(np.stack([start[mine], first[place[mine]], last[place[mine]]]), axis=1))
        for m, parts in got.items():
            yield m, np.unique(np.concatenate(parts, 1), axis=1)

    def passages(self, words: np.ndarray, first: np.ndarray, last: np.ndarray):
        """(size, items, starts, ends) of all passages that can hold a near copy of an item searched without LSH.

        A copy keeps at least m - q + 1 - k * q of the item's runs, displaced by amounts within k of each other.
        """
        sizes = self.sizes
        for q, table in self.exact.items():
            place, item, offset = self._shared(table, q, words, last)
            order = np.lexsort((place - offset, first[place], item))
            place, item, start = place[order], item[order], (place - offset)[order]
            m, text = sizes[item], first[place]
            k = (self.edits * m).astype(np.int64)
            group = np.cumsum(np.concatenate([[0], (item[1:] != item[:-1]) | (text[1:] != text[:-1])])) if len(item) else item
            line = group * (4 * (len(words) + int(sizes.max(initial=0)))) + start
            held = np.searchsorted(line, line + k, "right") - np.arange(len(line))
            found: dict[int, list] = {}
            before, at = None, 0
            for x in np.flatnonzero(held >= np.maximum(1, m - q + 1 - k * q)).tolist():
                if before != group[x] or start[x] - at > k[x]:  # starts within k share a passage
                    before, at = group[x], start[x]
                    found.setdefault(int(m[x]), []).append([item[x], max(at - k[x], text[x]), 0])
                found[int(m[x])][-1][2] = min(start[x] + m[x] + k[x], last[place[x]])
            for size, rows in found.items():
                yield size, *np.array(rows, np.int64).T

    def _verified(self, words: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """(items, starts, ends, distances) of the passages words[lo:hi] that hold the item within its limit; items of near lengths go together."""
        order = np.lexsort((hi - lo, self.sizes[item]))
        at = 0
        while at < len(order):
            width = int(self.sizes[item[order[at]]] * 1.2) + 8
            to = at + int(np.searchsorted(self.sizes[item[order[at:]]], width, "right"))
            rows = order[at : min(to, at + max(16, min(2048, (1 << 18) // width)))]
            at += len(rows)
            it, x, y = item[rows], lo[rows], hi[rows]
            size = self.sizes[it]
            limit = (self.edits * size).astype(np.int64)
            mat = view_of(self.flat, self.starts[it], self.starts[it] + size, int(size.max()), ~_PAD)
            near = view_of(words, x, y, int((y - x).max()))
            some = np.flatnonzero(present(mat, near) >= size - limit)  # at distance k, all words of the item but k stand in the passage
            dist, s, e = substring_distance(mat[some], near[some], size[some])
            ok = np.flatnonzero(dist <= limit[some])
            some, x, y = some[ok], x[some[ok]], y[some[ok]]
            yield it[some], x + s[ok], np.minimum(x + e[ok], y), dist[ok]

    def search(self, texts: list[str]) -> list[list[dict]]:
        """Of each text: best match of every item found in it."""
        words, doc, at, to = tv.word_hashes(texts)
        out: list[dict[int, tuple]] = [{} for _ in texts]
        if not len(words) or not self.items:
            return [[] for _ in texts]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        first, last = bounds[doc], bounds[doc + 1]

        found: list[tuple] = []  # items, and the bounds of the passages to check
        for m, w in self.windows(words, first, last):
            which, steps, keys, item_of = self.tables[m]
            k = self.limit(m)
            size = max(64, min(1024, (1 << 15) // len(steps)))
            for lo in range(0, w.shape[1], size):
                start, begin, end = w[:, lo : lo + size]
                sig = self.signatures(view_of(words, start, end, m), steps).ravel()
                a = np.searchsorted(keys, sig)
                hit = np.flatnonzero(keys[np.minimum(a, len(keys) - 1)] == sig)
                a, count = a[hit], np.searchsorted(keys, sig[hit], "right") - a[hit]
                row = np.repeat(hit % len(start), count)
                item = item_of[np.repeat(a, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)]
                pair = np.unique(row * len(which) + item)
                row, item = pair // len(which), pair % len(which)
                found.append((which[item], np.maximum(start[row] - k, begin[row]), np.minimum(start[row] + m + k, end[row])))
        found += [(item, lo, hi) for _, item, lo, hi in self.passages(words, first, last)]
        if not found:
            return [[] for _ in texts]
        item, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        for it, b, f, dist in self._verified(words, item, lo, hi):
            for i, x, y, n in zip(it.tolist(), b.tolist(), f.tolist(), dist.tolist(), strict=True):
                new = (n, int(at[x]), int(to[max(x, y - 1)]))
                if i not in out[doc[x]] or new < out[doc[x]][i]:
                    out[doc[x]][i] = new
        return [[{"item_id": self.ids[i], "distance": v[0], "start": v[1], "end": v[2]} for i, v in sorted(o.items())] for o in out]


def view_of(words: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, pad: np.uint64 = _PAD) -> np.ndarray:
    """Row by row `width` words from start on, padded from end on."""
    pos = start[:, None] + np.arange(width)[None, :]
    return np.where(pos < end[:, None], words[np.minimum(pos, len(words) - 1)], pad)


def gram(words: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words from each place on (the last q - 1 are not used)."""
    acc = np.zeros(len(words), _U)
    for k in range(q):
        if len(words) > k:
            acc[: len(words) - k] += words[k:] * (tv.mix64(np.array([k + 31], _U))[0] | _U(1))
    return tv.mix64(acc + _U(q)) if len(words) >= q else np.zeros(0, _U)


def present(items: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Row by row, how many of the item's words, repeats counted, stand anywhere in the region."""
    out = np.zeros(len(items), np.int64)
    step = max(1, (1 << 22) // max(1, items.shape[1] * regions.shape[1]))
    for lo in range(0, len(items), step):
        out[lo : lo + step] = (items[lo : lo + step, :, None] == regions[lo : lo + step, None, :]).any(2).sum(1)
    return out


def substring_distance(items: np.ndarray, regions: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row, the least edit distance of the item (its first `sizes` words) to a run of the region's words, and that run's start and end (the first such end)."""
    n, m = items.shape
    width = regions.shape[1]
    bits = max(4, int(width + 1).bit_length())
    kind = np.int32 if (m + width + 2) << bits < 1 << 31 else np.int64
    one = kind(1 << bits)
    ramp = np.arange(m + 1, dtype=kind) << bits
    v = np.tile(ramp, (n, 1))  # distance in the upper bits, start of the run behind it in the lower
    rows, sizes = np.arange(n), np.full(n, m) if sizes is None else sizes
    best, be = v[rows, sizes], np.zeros(n, np.int64)
    for j in range(width):
        new = np.empty_like(v)
        new[:, 0] = j + 1  # distance 0, start j + 1
        np.minimum(v[:, :-1] + (items != regions[:, j : j + 1]) * one, v[:, 1:] + one, out=new[:, 1:])
        new -= ramp
        np.minimum.accumulate(new, 1, out=new)
        new += ramp
        v = new
        last = v[rows, sizes]
        better = (last >> bits) < (best >> bits)
        best[better], be[better] = last[better], j + 1
    return (best >> bits).astype(np.int64), (best & (one - kind(1))).astype(np.int64), be


_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def index(benchmark: DataFrame, **how) -> Index:
    """From all items; a benchmark of over MAX_ITEMS items must be searched in parts."""
    rows = benchmark.select("item_id", "text").where("text is not null").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"over {MAX_ITEMS} benchmark items: search them in parts and union the matches")
    rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
    return Index([r["item_id"] for r in rows], [r["text"] for r in rows], **how)


def search(docs: DataFrame, found: Index, keep: list[str]) -> DataFrame:
    """keep columns and hits: array of (item_id, distance, start, end), the best match of each item; places are code points of the lower-cased text."""

    def run(texts):
        hits = []
        for _, part in tv.chunks(texts, 1 << 20):
            hits += found.search(part)
        return {"__hits": pa.array(hits, _HITS)}

    return map_texts(docs, keep, run, "__hits array<struct<item_id:bigint,distance:int,start:bigint,end:bigint>>")


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, distance, start, end of every near copy of an item in a document (the best one of each item)."""
    hits = search(docs, index(benchmark, **how), ["doc_id"])
    return hits.select("doc_id", F.explode("__hits").alias("h")).select("doc_id", "h.item_id", "h.distance", "h.start", "h.end")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no near copy of an item, with all their columns."""
    hits = search(docs, index(benchmark, **how), docs.columns)
    return hits.where(F.size("__hits") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
