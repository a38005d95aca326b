"""Language ID: segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (a SentencePiece model file, never trained here). For each language a
unigram distribution over pieces is learned by expectation-maximisation over all segmentations of the words of a bounded
sample. A text's likelihood under a language is the product over its words of the sum, by the forward algorithm, over all ways
to cut the word into pieces; the prediction has the largest posterior.

A word is a run of letters of the lower-cased text, of any length, with the vocabulary's word mark before it. A letter outside the vocabulary has the
same small probability in every language. The sample is drawn for each language by itself, so that rare languages are learned too; the
prior counts all training rows.

Defined cases: a null text, or one without letters, is `und` with score 0; equal posteriors go to the first language by code point; texts and words of any
length are scored whole (training leaves out words of over LONGEST letters); repeated rows are scored row by row; without training rows everything
is `und`; an empty table gives an empty result. Only doc_id, text and lang are read, so further columns and their names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import textvec as tv
from weftline.llm.common import Scratch, crc_mod, fetch, map_texts, within

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
LONGEST = 64  # letters of a word that is learned from, or scored together with others of its length
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)
_M = _U(0xD6E8FEB86659FD93)


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The model's pieces that consist of letters, but for the word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in pieces if p.lstrip(chr(MARK)).isalpha() and p == p.lower() and p.count(chr(MARK)) <= 1 or p == chr(MARK)})


def _code_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of a matrix of code points."""
    h = np.zeros(codes.shape[0], _U)
    for k in range(codes.shape[1]):
        h = h * _B + codes[:, k].astype(_U) * _M
    return h


@dataclass
class Pieces:
    """Finds a piece by its hash: two open tables, the second for what collides in the first."""

    texts: list[str]
    longest: int = 0
    tables: list[tuple[np.ndarray, int]] = field(default_factory=list)
    keys: np.ndarray | None = None
    BITS = 18

    def __post_init__(self):
        self.longest = max(map(len, self.texts), default=1)
        self.keys = np.array([_code_hash(np.array([[ord(c) for c in p]], np.uint32))[0] for p in self.texts] + [0], _U)
        left, salt = np.arange(len(self.texts)), 1
        while len(left):
            slot = self._slot(self.keys[left], salt)
            t = np.full(1 << self.BITS, len(self.texts), np.int32)
            t[slot[::-1]] = left[::-1]
            self.tables.append((t, salt))
            left, salt = left[t[slot] != left], salt + 1

    def _slot(self, h: np.ndarray, salt: int) -> np.ndarray:
        m = _U((0x94D049BB133111EB * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        return (((h ^ (h >> _U(31))) * m) >> _U(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with this hash, -1 for none."""
        out = np.full(len(h), -1, np.int32)
        for t, salt in self.tables:
            i = t[self._slot(h, salt)]
            hit = self.keys[i] == h
            hit &= i < len(self.texts)
            out[hit] = i[hit]
        return out


def _lattice(words: np.ndarray, pieces: Pieces):
    """words: matrix of code points of words of one length. (end, length, rows, piece) of every piece in them; letters without one get -1."""
    n, width = words.shape
    prefix = np.zeros((n, width + 1), _U)
    for j in range(width):
        prefix[:, j + 1] = prefix[:, j] * _B + words[:, j].astype(_U) * _M
    power = _U(1)
    powers = [power]
    for _ in range(pieces.longest):
        power = _U((int(power) * int(_B)) & 0xFFFFFFFFFFFFFFFF)
        powers.append(power)
    for end in range(1, width + 1):
        for k in range(1, min(end, pieces.longest) + 1):
            found = pieces.find(prefix[:, end] - prefix[:, end - k] * powers[k])
            rows = np.flatnonzero(found >= 0) if k > 1 else np.arange(n)
            if len(rows):
                yield end, k, rows, found[rows]


def forward(words: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log likelihood of each word (row) under each language. prob: pieces x languages, the last row for unknown letters."""
    n, width = words.shape
    alpha = np.zeros((width + 1, n, prob.shape[1]))
    alpha[0] = 1
    scale = np.zeros(n)
    at = 0
    for end, k, rows, ids in _lattice(words, pieces):
        if end != at and end % 16 == 1 and end > 1:  # keeps what later steps read in range
            top = alpha[end - 1].max(1)
            top[top <= 0] = 1
            lo = max(0, end - 1 - pieces.longest)
            alpha[lo:end] /= top[None, :, None]
            scale += np.log(top)
        at = end
        alpha[end, rows] += alpha[end - k, rows] * prob[ids]
    return np.log(np.maximum(alpha[width], 1e-300)) + scale[:, None]


def forward_long(word: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log likelihood of one long word (its code points) under each language; the same sum, place by place, in bounded memory."""
    width, top = len(word), pieces.longest
    table = np.concatenate([prob, np.zeros((1, prob.shape[1]))])  # the last row for no piece
    none = len(prob)
    ring = np.zeros((top, prob.shape[1]))  # values of the last places, the nearest first
    ring[0] = 1
    scale = 0.0
    for lo in range(0, width, 1 << 14):
        hi = min(width, lo + (1 << 14))
        first = max(0, lo - top)
        prefix = np.zeros(hi - first + 1, _U)
        run = _U(0)
        with np.errstate(over="ignore"):
            for j, c in enumerate((word[first:hi].astype(_U) * _M).tolist()):
                run = _U((int(run) * int(_B) + c) & 0xFFFFFFFFFFFFFFFF)
                prefix[j + 1] = run
        ids = np.full((hi - lo, top), none, np.int64)
        power = 1
        for k in range(1, top + 1):
            power = power * int(_B) & 0xFFFFFFFFFFFFFFFF
            end = np.arange(max(lo + 1, k), hi + 1) - first  # places where a piece of k letters may end
            if len(end):
                found = pieces.find(prefix[end] - prefix[end - k] * _U(power)).astype(np.int64)
                ids[end + first - lo - 1, k - 1] = np.where(found >= 0, found, none - 1 if k == 1 else none)
        for row in ids:
            value = (ring * table[row]).sum(0)
            most = value.max()
            if most > 0:
                value /= most
                scale += np.log(most)
            ring[1:] = ring[:-1]
            ring[0] = value
            ring[1:] /= most if most > 0 else 1
    return np.log(np.maximum(ring[0], 1e-300)) + scale


def expected(words: np.ndarray, weight: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected count of each piece, over all segmentations, of one language's words. prob: pieces (and unknown)."""
    n, width = words.shape
    arcs = list(_lattice(words, pieces))
    fwd, bwd = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    fwd[0] = bwd[width] = 1
    for end, k, rows, ids in arcs:
        fwd[end, rows] += fwd[end - k, rows] * prob[ids]
    for end, k, rows, ids in sorted(arcs, key=lambda a: -a[0]):
        bwd[end - k, rows] += bwd[end, rows] * prob[ids]
    total = np.maximum(fwd[width], 1e-300)
    out = np.zeros(len(prob))
    for end, k, rows, ids in arcs:
        got = weight[rows] * fwd[end - k, rows] * prob[ids] * bwd[end, rows] / total[rows]
        out += np.bincount(np.where(ids < 0, len(prob) - 1, ids), got, minlength=len(prob))
    return out


_LETTER: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0][codes]


def word_table(texts: list[str]):
    """Distinct words of a chunk and where they occur: hash of each, its letters as (codes, start, length), text and word of each occurrence."""
    codes, offs = tv.pack([t.lower() for t in texts])
    starts, ends, doc = tv.runs(_letters(codes), offs)
    h = tv.hash_runs(codes, starts, ends)
    distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
    return distinct, codes, starts[first], (ends - starts)[first], doc, which


def by_length(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(indexes, matrix of code points with the word mark before) for the words of each length."""
    order = np.argsort(lengths, kind="stable")
    cut = np.flatnonzero(np.diff(lengths[order])) + 1
    for idx in np.split(order, cut) if len(order) else []:
        for lo in range(0, len(idx), 1 << 14):
            part = idx[lo : lo + (1 << 14)]
            body = codes[starts[part][:, None] + np.arange(lengths[part[0]])[None, :]]
            yield part, np.concatenate([np.full((len(part), 1), MARK, np.uint32), body], 1)


@dataclass
class Model:
    langs: list[str]  # by code point
    prob: np.ndarray  # pieces and unknown x languages
    prior: np.ndarray  # log
    vocabulary: str


def train(texts: list[str], langs: list[str], path: str = VOCABULARY, rounds: int = 4, smooth: float = 0.05, counts: dict[str, int] | None = None) -> Model:
    """counts: training rows of each language, for the prior; those of the sample by default."""
    names = sorted(set(langs))
    counts = counts or {n: langs.count(n) for n in names}
    pieces = Pieces(vocabulary(path))
    prob = np.zeros((len(pieces.texts) + 1, len(names)))
    for col, name in enumerate(names):
        count: dict[int, float] = {}
        words: dict[int, np.ndarray] = {}
        for _, run in tv.chunks([t for t, g in zip(texts, langs, strict=True) if g == name]):
            h, codes, starts, lengths, _, which = word_table(run)
            for key, n, s, ln in zip(h.tolist(), np.bincount(which, minlength=len(h)).tolist(), starts.tolist(), lengths.tolist(), strict=True):
                if ln > LONGEST:
                    continue
                count[key] = count.get(key, 0) + n
                if key not in words:
                    words[key] = codes[s : s + ln].copy()
        keys = sorted(words)
        lengths = np.array([len(words[k]) for k in keys], int)
        flat = np.concatenate([words[k] for k in keys]) if keys else np.zeros(0, np.uint32)
        starts = np.cumsum(lengths) - lengths
        weight = np.array([count[k] for k in keys], float)
        p = np.full(len(prob), 1e-4)
        p[-1] = 1e-8
        for _ in range(rounds):
            got = np.zeros(len(p))
            for part, mat in by_length(flat, starts, lengths):
                got += expected(mat, weight[part], pieces, p)
            p = got + smooth
            p /= p[:-1].sum()
            p[-1] = 1e-8
        prob[:, col] = p
    prior = np.log(np.array([counts[n] + 1.0 for n in names]) / (sum(counts[n] for n in names) + len(names))) if names else np.zeros(0)
    return Model(names, prob, prior, path)


class Scorer:
    """Holds the lattice's tables, and the likelihoods of words already met, for one Python worker."""

    ROOM = 200_000

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(vocabulary(model.vocabulary))
        self.known, self.value = np.zeros(0, _U), np.zeros((0, len(model.langs)))

    def _likelihoods(self, h, codes, starts, lengths) -> np.ndarray:
        out = np.zeros((len(h), len(self.model.langs)))
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        met = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        out[met] = self.value[at[met]]
        new = np.flatnonzero(~met)
        for i in new[lengths[new] > LONGEST].tolist():
            word = np.concatenate([np.array([MARK], np.uint32), codes[starts[i] : starts[i] + lengths[i]]])
            out[i] = forward_long(word, self.pieces, self.model.prob)
        short = new[lengths[new] <= LONGEST]
        for part, mat in by_length(codes, starts[short], lengths[short]):
            out[short[part]] = forward(mat, self.pieces, self.model.prob)
        if len(new) and len(self.known) + len(new) <= self.ROOM:
            keys = np.concatenate([self.known, h[new]])
            order = np.argsort(keys)
            self.known, self.value = keys[order], np.concatenate([self.value, out[new]])[order]
        return out

    def __call__(self, texts) -> dict:
        names = self.model.langs
        pred, score = [], []
        for _, run in tv.chunks(texts):
            if not names:
                pred += ["und"] * len(run)
                score += [0.0] * len(run)
                continue
            h, codes, starts, lengths, doc, which = word_table(run)
            each = self._likelihoods(h, codes, starts, lengths)[which]
            total = np.stack([np.bincount(doc, each[:, k], minlength=len(run)) for k in range(len(names))], 1) + self.model.prior
            some = np.bincount(doc, minlength=len(run)) > 0
            best = total.argmax(1)
            post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            pred += [names[b] if s else "und" for b, s in zip(best, some, strict=True)]
            score += np.where(some, post, 0.0).tolist()
        return {"lang_pred": pred, "score": score}


def fit(docs: DataFrame, path: str = VOCABULARY, max_docs: int = 2000, max_chars: int = 3_000_000, least_docs: int = 50, least_chars: int = 100_000, test_fold: tuple[int, int] | None = (5, 0)) -> Model:
    """Model from rows with text, lang and id outside the test fold.

    max_docs documents and max_chars characters are shared evenly by the languages, but each gets least_docs and least_chars; what one has too few rows for
    is not given to others. The documents of a language come in the order of a hash of their ids; one that doesn't fit the characters left is skipped.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if test_fold:
        rows = rows.where(crc_mod("doc_id", test_fold[0]) != test_fold[1])
    told = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).collect()  # one row a language
    if not told:
        return train([], [], path)
    docs_each, chars_each = max(least_docs, max_docs // len(told)), max(least_chars, max_chars // len(told))
    scratch = Scratch(docs.sparkSession)
    h = F.xxhash64("doc_id", F.lit(29))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2.0 * docs_each + 200) / max(1, r["ids"]))) for r in told], "lang string, share double")
    near = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53) < F.col("share")  # about twice as many as needed, of each language
    some = rows.join(F.broadcast(share), "lang").where(near).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")  # some hundreds or thousands of rows a language
    some = some.withColumn("h", h).withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_each).drop("r").withColumn("size", F.char_length("text"))
    some = scratch.write(some, "sample")
    sizes: dict[str, list] = {}
    for r in some.select("lang", "h", "doc_id", "size").collect():
        sizes.setdefault(r["lang"], []).append((r["h"], r["doc_id"], r["size"]))
    chosen = set()
    for lang, found in sizes.items():
        chosen |= {(lang, *key) for key in within((((x, i), n) for x, i, n in sorted(found)), chars_each)}
    got = fetch(some, chosen, ["lang", "h", "doc_id"], ["text"])
    scratch.drop(some)
    return train([r["text"] for r in got], [r["lang"] for r in got], path, counts={r["lang"]: r["n"] for r in told})


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """keep columns, lang_pred and score of every row."""
    own: list[Scorer] = []

    def run(texts):
        if not own:
            own.append(Scorer(model))
        return own[0](texts)

    return map_texts(docs, keep or ["doc_id"], run, "lang_pred string, score double")


def language_id(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    got = predict(docs, fit(docs, **how))
    return got.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
