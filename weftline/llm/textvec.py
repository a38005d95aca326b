"""Vectorised text kernels: numpy over the code points of a whole Arrow batch.

Texts are handled in chunks of a bounded number of characters, so memory does not
grow with the batch or with the longest text beyond a small multiple of that text.
Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np

CHUNK_CHARS = 1 << 19
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_MUL = _U(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bijection on uint64 (splitmix64)."""
    x = x.astype(_U, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def chunks(texts, max_chars: int = CHUNK_CHARS):
    """(first, list of texts) runs of at most max_chars characters, or of one longer text."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if run and size + len(t) > max_chars:
            yield first, run
            first, size, run = i, 0, []
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


def pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one separator after each; start offset of each text (and the end)."""
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return codes, np.concatenate([[0], np.cumsum(lengths)])


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True inside each text: starts, ends, index of the text."""
    mask = mask.copy()
    mask[offs[1:] - 1] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def forget() -> None:
    """Frees the tables of powers, which are as long as the longest chunk so far."""
    _powers[:] = [np.ones(1, _U), np.ones(1, _U)]


def hash_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of code points, the same wherever the run stands."""
    up, down = _power(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, _U)
    for lo in range(0, len(codes), 1 << 17):  # in steps, for the sake of memory
        hi = min(len(codes), lo + (1 << 17))
        part = mix64(codes[lo:hi])
        part *= up[lo:hi]
        np.cumsum(part, dtype=_U, out=sums[lo + 1 : hi + 1])
        sums[lo + 1 : hi + 1] += sums[lo]
    return mix64((sums[ends] - sums[starts]) * down[starts])


def words_of(codes: np.ndarray) -> np.ndarray:
    """True where a character belongs to a word: anything but space, tab, LF, VT, FF, CR."""
    return ~((codes == 32) | ((codes >= 9) & (codes <= 13)))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lower-cased texts: hash, index of the text, start and end (in its code points) of each word."""
    codes, offs = pack([t.lower() for t in texts])
    starts, ends, doc = runs(words_of(codes), offs)
    return hash_runs(codes, starts, ends), doc, starts - offs[doc], ends - offs[doc]


def shingle_hashes(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of `width` words in each text, sorted by text then hash, and each one's text.

    A text of fewer words, but at least one, has one shingle: all of its words.
    """
    w, doc, _, _ = word_hashes(texts)
    n = len(w)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    keys = [mix64(np.array([k + 1], _U))[0] | _U(1) for k in range(width)]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    acc = np.zeros(n, _U)
    for k in range(width):
        acc[: n - k] += w[k:] * keys[k]
    full = np.zeros(n, bool)
    if n >= width:
        full[: n - width + 1] = doc[width - 1 :] == doc[: n - width + 1]
    short = first[count < width]
    for s in short:  # fewer than `width` words: rare and tiny
        e = s + int(np.searchsorted(doc[s : s + width], doc[s], "right"))
        acc[s] = (w[s:e] * np.array(keys[: e - s], _U)).sum(dtype=_U) + _U(e - s)
    full[short] = True
    h, d = mix64(acc[full]), doc[full]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    return h[keep], d[keep]


def ngram_buckets(codes: np.ndarray, sizes: tuple[int, ...], bits: int):
    """For each n in ascending `sizes`: bucket in [0, 2**bits) of the n-gram at each position (the last n-1 positions are padding)."""
    m = codes.astype(_U) * _MUL
    m ^= m >> _U(29)
    acc, step, upto = m.copy(), _BASE, 1
    for n in sizes:
        while upto < n:
            acc[: len(m) - upto] += m[upto:] * step if upto < len(m) else 0
            step = _U((int(step) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF)
            upto += 1
        h = (acc + _U(n)) * _MUL
        h ^= h >> _U(32)
        yield n, ((h * _BASE) >> _U(64 - bits)).astype(np.int64)
