"""Personal data: weak-supervision aggregation of regex, gazetteer and context labelers.

Base spans follow fixed patterns (email, ip, card, phone) and always stay. Further candidate spans (numbers that fail a check, local
phone numbers, spelled-out addresses, credential values, numbers after an account cue) get votes of five labelers: yes, no or
nothing. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and each kind's prior; a
logistic span classifier is then trained against these posteriors, on the kind, the votes (also by kind), the span's length and make-up and what stands before it, and
adds the spans it accepts. Patterns are counted over all documents; there are at most kinds x 3**5 x 4 x 4 x 6 of them, whatever the input.

Defined cases: null and empty texts have no span; every row is treated by itself, so repeated rows get equal results; texts of any length are read whole, in time
linear in their length but for runs of overlapping spans; added spans overlap no base span, and of added spans that overlap the one that starts first stays, then the
longer, then the kind listed first; an empty table gives an empty result. Only the text and the kept columns are read, so further columns and their names don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, map_texts

# Kinds in the order of the span list, the base ones first.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "account", "local_phone", "spelled_email", "secret"]
# The labelers' word lists.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "mil", "int", "arpa", "info", "biz", "name", "pro", "coop", "museum", "aero", "jobs", "mobi", "travel", "tel", "cat", "asia", "post", "app", "dev", "cloud", "online", "site", "shop", "store", "tech", "xyz", "blog", "email", "live", "news", "team", "work", "world"]  # besides all of two letters, the countries'
COUNTRY_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"]
COUNTRY_ZONES = ["21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99"]  # first digits of the codes of three
CARD_HEADS = ["34", "35", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "6", "2221", "223", "224", "225", "226", "227", "23", "24", "25", "26", "270", "271", "2720"]
KEY_NAMES = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth", "credential", "private_key", "bearer", "passwort", "kennwort", "contraseña", "clave", "mot_de_passe", "jeton", "schlüssel"]
# English, German, French, Spanish.
CUES = [
    "card", "credit", "visa", "mastercard", "account", "iban", "call", "phone", "tel", "telephone", "mobile", "fax", "mail", "email", "contact", "address", "ip", "host", "client", "reach",
    "karte", "kreditkarte", "konto", "kontonummer", "anrufen", "telefon", "handy", "mobil", "kontakt", "adresse", "erreichbar",
    "carte", "compte", "appelez", "appeler", "téléphone", "portable", "courriel", "contactez",
    "tarjeta", "crédito", "cuenta", "llame", "llamar", "teléfono", "móvil", "correo", "contacto", "dirección", *KEY_NAMES,
]
NOT_CUES = [
    "version", "order", "isbn", "issn", "sku", "page", "total", "invoice", "ticket", "row", "line", "build", "commit", "checksum", "sha", "md5", "hash", "digest", "release", "section", "figure",
    "bestellung", "seite", "rechnung", "zeile", "gesamt", "commande", "facture", "ligne", "pedido", "página", "factura", "línea",
]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![\w+.)-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")
_SPELLED = re.compile(r"(?<![\w.])[a-z0-9._-]{2,40}+ ?[\[(]?at[\])]? ?[a-z0-9-]{2,40}+ ?[\[(]dot[\])] ?[a-z]{2,6}(?!\w)", re.I)
_SECRET = re.compile(r"""(?<=[=:])[ \t]{0,3}["']?([A-Za-z0-9+/_-]{16,})""")
_KEY = re.compile(r"([^\W\d]{2,24})[ \t\"']{0,3}[=:][ \t]{0,3}[\"']?\Z")
_WORD = re.compile(r"[^\W]+")
_DOT = re.compile("dot", re.I)
_CUE_SET, _NOT_CUE_SET, _KEY_SET, _TOP_SET = map(frozenset, (CUES, NOT_CUES, KEY_NAMES, TOP_DOMAINS))
_ANY_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, in time linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind, by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = _emails(text)
    if _ANY_DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _near(text: str, start: int) -> tuple[int, str]:
    """Context vote of the 40 characters before a span, and the key name right before it."""
    before = text[max(0, start - 40) : start]
    words = _WORD.findall(before.lower())[-4:]
    key = _KEY.search(before)
    vote = 1 if any(w in _CUE_SET for w in words) else -1 if any(w in _NOT_CUE_SET for w in words) else 0
    return vote, key[1].lower() if key else ""


def _entropy(s: str) -> float:
    return -sum(p * math.log2(p) for p in (s.count(c) / len(s) for c in set(s)))


def _known_top(domain: str) -> bool:
    top = domain.rsplit(".", 1)[-1].lower()
    return top in _TOP_SET or len(top) == 2 and top.isalpha()


def _calling(digits: str) -> bool:
    """Whether an international number starts with a country's code."""
    return digits.startswith(tuple(COUNTRY_CODES)) or digits.startswith(tuple(COUNTRY_ZONES))


def _votes(text: str, kind: str, s: int, e: int, base: bool) -> tuple[int, ...]:
    """Of the shape, check, gazetteer, context and variety labelers."""
    span = text[s:e]
    digits = "".join(c for c in span if "0" <= c <= "9")
    context, key = _near(text, s)
    shape = 1 if base else 0
    check = gazetteer = 0
    if kind in ("card", "account"):
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(tuple(CARD_HEADS)) else -1
    elif kind == "phone":
        check = 1 if 10 <= len(digits) <= 13 else -1
        gazetteer = 1 if _calling(digits) else -1
    elif kind == "local_phone":
        check = 1 if digits[0] not in "01" and digits[3] not in "01" else -1  # area and exchange codes of the numbering plan
        gazetteer = -1 if digits[1:3] == "11" or digits[3:6] == "555" and digits[6:8] == "01" else 0  # service codes, numbers kept for fiction
    elif kind == "ip":
        parts = [int(p) for p in span.split(".")]
        check = 1 if 0 < parts[0] < 224 and not any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else -1
        gazetteer = -1 if max(parts) < 20 and parts[0] < 10 else 1 if parts[0] in (10, 127) or parts[:2] == [192, 168] else 0  # like a version; known networks
    elif kind == "email":
        local, domain = span.split("@", 1)
        check = 1 if not (local.startswith(".") or local.endswith(".") or ".." in local or any(p.startswith("-") or p.endswith("-") for p in domain.split("."))) else -1
        gazetteer = 1 if _known_top(domain) else -1
    elif kind == "spelled_email":
        gazetteer = 1 if _known_top(re.split(r"[^a-z]+", span.lower())[-1]) else -1
        check = 1 if "[" in span or "(" in span else 0
    else:
        shape = 1 if re.fullmatch(r"[0-9a-f]{32,}|[A-Za-z0-9+/_-]*[0-9][A-Za-z0-9+/_-]*", span) else -1
        gazetteer = 1 if key in _KEY_SET else -1 if key in _NOT_CUE_SET else 0
        check = 1 if len(set(span)) >= 10 else -1
    body = digits if kind not in ("secret", "email", "spelled_email") else span
    variety = 1 if _entropy(body) >= (3.0 if kind == "secret" else 2.0) else -1 if _entropy(body) < 1.5 else 0
    return shape, check, gazetteer, context, variety


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlap that cover the same places, by start."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _inside(spans: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether one of the spans, sorted and without overlap, overlaps [s, e)."""
    i = bisect_left(spans, (e, -1))
    return i > 0 and spans[i - 1][1] > s


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int, bool]]:
    """(kind index, start, end, base) of all spans, by kind then start; added ones overlap no base span and not each other."""
    out = [(KINDS.index(k), s, e, True) for k in BASE for s, e in base[k]]
    more: list[tuple[int, int, int]] = []  # start, -end, kind
    if _ANY_DIGIT.search(text):
        account = (m.span() for m in _DIGITS.finditer(text) if m.end() - m.start() >= 12 and 12 <= sum(c.isdigit() for c in m[0]) <= 19)
        more += [(s, -e, KINDS.index("account")) for s, e in account]
        more += [(m.start(), -m.end(), KINDS.index("local_phone")) for m in _LOCAL_PHONE.finditer(text)]
    if _DOT.search(text):
        more += [(m.start(), -m.end(), KINDS.index("spelled_email")) for m in _SPELLED.finditer(text)]
    if "=" in text or ":" in text:
        more += [(m.start(1), -m.end(1), KINDS.index("secret")) for m in _SECRET.finditer(text)]
    if more:
        taken = _merged([(s, e) for _, s, e, _ in out])
        at = 0
        for s, e, kind in sorted(more):
            if s >= at and not _inside(taken, s, -e):
                out.append((kind, s, -e, False))
                at = -e
    return sorted(out)


def _make_up(span: str) -> int:
    """0: digits and separators only; 1: hex letters too; 2: other letters of one case; 3: of both."""
    letters = [c for c in span if c.isalpha()]
    if not letters:
        return 0
    if all(c in "abcdefABCDEF" for c in letters):
        return 1
    return 3 if any(c.islower() for c in letters) and any(c.isupper() for c in letters) else 2


def _before(text: str, s: int) -> int:
    """What stands before a span: 0 nothing or a line end, 1 a space, 2 = or :, 3 a quote or bracket, 4 a letter or digit, 5 other."""
    c = text[s - 1] if s else "\n"
    return 0 if c in "\r\n" else 1 if c.isspace() else 2 if c in "=:" else 3 if c in "\"'`([{<" else 4 if c.isalnum() else 5


def pattern(text: str, kind: int, s: int, e: int, base: bool) -> int:
    """Code of kind, votes, length class, make-up and what stands before."""
    code = kind
    for v in _votes(text, KINDS[kind], s, e, base):
        code = code * 3 + v + 1
    return ((code * 4 + min(3, (e - s) // 12)) * 4 + _make_up(text[s:e])) * 6 + _before(text, s)


def _decode(code: int) -> tuple[int, tuple[int, ...], int, int, int]:
    """Kind, votes, length class, make-up, what stands before."""
    code, before = divmod(code, 6)
    code, mix = divmod(code, 4)
    code, length = divmod(code, 4)
    votes = []
    for _ in range(5):
        votes.append(code % 3 - 1)
        code //= 3
    return code, tuple(reversed(votes)), length, mix, before


def posteriors(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Expectation-maximisation: probability that a span is personal data, of each row of (kind, votes) that occurs n times.

    Each kind has a prior, each labeler a rate of yes votes among its votes for true and for false spans, smoothed towards better than chance.
    """
    q = 1 / (1 + np.exp(-1.0 * votes.sum(1)))  # starts from the majority
    for _ in range(rounds):
        prior = np.array([(n[kind == k] @ q[kind == k] + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])[kind]
        like = np.zeros((len(n), 2))
        for j in range(votes.shape[1]):
            for c, weight in ((1, n * q), (0, n * (1 - q))):
                yes, no = weight[votes[:, j] == 1].sum() + 2 + 6 * c, weight[votes[:, j] == -1].sum() + 8 - 6 * c
                rate = yes / (yes + no)
                like[:, c] += np.where(votes[:, j] == 1, np.log(rate), np.where(votes[:, j] == -1, np.log(1 - rate), 0))
        z = np.log(prior / (1 - prior)) + like[:, 1] - like[:, 0]
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q


def classifier(x: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probabilities of a ridge logistic regression of x against the posteriors q, rows weighted by n, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (q - p)) - w
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def aggregate(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Of each pattern: the span classifier's probability, from the patterns' counts alone."""
    if not counts:
        return {}
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    told = [_decode(c) for c in codes]
    kind, votes = np.array([t[0] for t in told]), np.array([t[1] for t in told])
    q = posteriors(kind, votes, n, rounds)
    kinds = np.eye(len(KINDS))[kind]
    by_kind = (kinds[:, :, None] * votes[:, None, :]).reshape(len(codes), -1)
    context = [np.eye(size)[[t[2 + i] for t in told]] for i, size in enumerate((4, 4, 6))]
    x = np.concatenate([kinds, votes == 1, votes == -1, by_kind, *context], 1).astype(float)
    p = classifier(x, q, n)
    return {c: float(v) for c, v in zip(codes, p, strict=True)}


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32())]))
_FIELDS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, __c array<struct<kind:int,start:bigint,end:bigint,base:boolean,pattern:int>>"


def scan(texts) -> dict:
    """Base counts, their digest, and all candidate spans with their vote patterns."""
    out: dict[str, list] = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "__c": []}
    for text in texts:
        text = text or ""
        base = base_spans(text)
        for k in BASE:
            out[f"n_{k}"].append(len(base[k]))
        out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in BASE for s, e in base[k]).encode()).hexdigest())
        out["__c"].append([{"kind": k, "start": s, "end": e, "base": b, "pattern": pattern(text, k, s, e, b)} for k, s, e, b in candidates(text, base)])
    out["__c"] = pa.array(out["__c"], _SPAN)
    return out


def find(docs: DataFrame, scratch: Scratch, keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """keep columns; counts and digest of the base spans; span_list: array of (kind, start, end, base, pattern) of all spans; spans: the same as text; n_spans: their number."""
    seen = scratch.write(map_texts(docs, keep or ["doc_id"], scan, _FIELDS), "spans")
    counts = seen.select(F.explode("__c.pattern").alias("p")).groupBy("p").count()
    probability = aggregate({r["p"]: r["count"] for r in counts.collect()})  # one row per pattern: bounded, see above
    yes = F.array(*[F.lit(int(c)) for c, p in sorted(probability.items()) if p >= threshold]).cast("array<int>")
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter("__c", lambda c: c["base"] | F.array_contains(yes, c["pattern"]))
    told = F.transform(kept, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string")))
    return seen.withColumn("span_list", kept).withColumn("spans", F.array_join(told, ",")).withColumn("n_spans", F.size("span_list").cast("bigint")).drop("__c")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span (start, end, kind) replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
