"""Texts for readers: Markdown without its marks, JSON with comments, signatures and comments of definitions, read modes, generic reduction of long outputs, tool results."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import chunks
from weftline.operators.chunks import count, text_lines

_EMOJI = re.compile("[☀-➿\U0001f000-\U0001faff\U0001fb00-\U0001fbff️‍]")
_STRING = r'"(?:[^"\\]|\\.)*"'
MOST_SIGNATURE = 10
LEAST_RESULT = 200


def _inline(s: str) -> str:
    """A line without images, link targets, emphasis, strike-through, code marks and tags; escaped characters stay."""
    out, i = [], 0
    token = re.compile(r"!\[[^\]]*\]?(?:\([^)]*\)?)?|\[([^\]]*)\]?(?:\([^)]*\)?)?|`([^`]*)`?|<[^>]*>?|\\(.)|\*\*?|__?|~~|(.)", re.S)
    while i < len(s):
        m = token.match(s, i)
        if m[1] is not None:
            out.append(_inline(m[1]))
        else:
            out.append(m[2] if m[2] is not None else m[3] or m[4] or "")
        i = m.end()
    return "".join(out)


def _marked(s: str) -> str:
    """A line without heading, quote, list and table marks."""
    s = re.sub(r"^> ?", "", s.lstrip("#").lstrip()).lstrip()
    s = re.sub(r"^[0-9]+\. ", "", re.sub(r"^[-*+] ", "", s))
    return "  ".join(c.strip() for c in s.split("|") if c.strip()) if s.startswith("|") else s


def clean_markdown(text: str) -> str:
    """Prose of a Markdown text: fences, rules, comments and table borders go, what stands within them stays; runs of blank lines become one."""
    out: list[str] = []
    fenced = False
    for raw in text_lines(text):
        t = raw.strip()
        if t.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if not fenced:
            if t.startswith("<!--") or re.fullmatch(r"[-*_= ]{3,}", t) or t.startswith("|") and not t.strip("|-: "):
                continue
            t = _inline(_marked(t))
        t = _EMOJI.sub("", t) if fenced else _EMOJI.sub("", t).strip()
        if t or out and out[-1]:
            out.append(t)
    return "\n".join(out).rstrip()


def strip_jsonc(c: Column | str) -> Column:
    """JSON without comments, trailing commas and a byte-order mark; strings stay as they are."""
    body = F.regexp_replace(T.text(c), "^﻿+", "")
    bare = F.regexp_replace(body, rf"({_STRING})|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)", "$1")
    return F.regexp_replace(bare, rf"({_STRING})|,(?=\s*[}}\]])", "$1")


def signature(lines: list[str], first: int, last: int) -> str:
    """Verbatim lines (from 1) of a declaration up to the one that opens its body, within its span and a few lines; the first alone where none does."""
    upto = min(max(last, first), first + MOST_SIGNATURE - 1, len(lines))
    for n in range(first, upto + 1):
        t = lines[n - 1].rstrip()
        if t.endswith(("{", ";")) or t.endswith(":") and not t.startswith(("//", "#")) and "=>" not in t:
            return "\n".join(lines[first - 1 : n])
    return lines[first - 1] if first <= len(lines) else ""


def comment_before(lines: list[str], first: int) -> str | None:
    """The one-line comment right before a line."""
    m = re.match(r"(?:///|//(?!/)|#(?!!))\s*(\S.*)$", lines[first - 2].strip()) if 2 <= first <= len(lines) + 1 else None
    return m[1].strip() if m else None


def outline(text: str, path: str, lang: str) -> str:
    """Every chunk's place, kind, name, signature and comment; texts without symbols cleaned, in whole."""
    if lang == "generic":
        return clean_markdown(text)
    lines, found = text_lines(text), chunks.chunk(text, lang)
    if not found:
        return "\n".join([f"[{len(lines)} lines - no symbols detected]", *lines[:30]])
    out = [f"[{path}] - {len(lines)} lines, {len(found)} symbols\n"]
    for c in found:
        note = comment_before(lines, c["start_line"])
        name = f" {c['symbol']}" if c["symbol"] else ""
        out.append(f"  L{c['start_line']}-{c['end_line']} [{c['kind']}]{name}: {signature(lines, c['start_line'], c['end_line'])}" + (f"  // {note}" if note else ""))
    return "\n".join(out)


def read(text: str, path: str, lang: str, mode: str = "auto", symbol: str | None = None) -> str:
    """A text as a reader wants it: `full`, `outline`, `signatures`, one `symbol`, or `auto`: whole below 200 lines, else its outline."""
    if symbol is not None:
        hits = [c for c in chunks.chunk(text, lang) if symbol.lower() in c["symbol"].lower()]
        return "\n".join(f"# L{c['start_line']}-{c['end_line']} [{c['kind']}] {c['symbol']}\n{c['content']}" for c in hits)
    if mode == "signatures":
        firsts = ((c["start_line"], next((s for s in c["content"].split("\n") if s.strip()), "")) for c in chunks.chunk(text, lang))
        return "\n".join(f"L{n}: {s.rstrip()}" for n, s in firsts)
    if mode == "outline" or mode == "auto" and len(text_lines(text)) >= 200:
        return outline(text, path, lang)
    return text


# How lines of progress begin.
PROGRESS = ["Downloading ", "Extracting ", "Installing ", "Fetching ", "Resolving ", "Building ", "Compiling ", "Generating ", "Running ", "Testing ", "Checking ", "Verifying "]


def shorten_long(text: str, least: int = 50, most: int = 100, head: int = 40, tail: int = 20) -> str:
    """Texts of over `least` lines: progress bars as one note, runs of like progress lines as the first and their number, then head and tail of what is over `most` lines."""
    lines = text_lines(text)
    if len(lines) <= least:
        return text
    out, i = [], 0
    while i < len(lines):
        s = lines[i]
        if re.search("[█░▓]", s) or len(re.findall("[=>#]", s)) > 15:
            if not out or "progress" not in out[-1]:
                out.append("[progress bar omitted]")
            i += 1
            continue
        start = next((p for p in PROGRESS if s.startswith(p)), None)
        n = 1
        while start and n < 100 and i + n < len(lines) and lines[i + n].startswith(start):
            n += 1
        out.append(f"{s} ({n - 1} similar lines)" if n >= 3 else s)
        i += n if n >= 3 else 1
    if len(out) > most:
        out = [*out[:head], f"[... {len(out) - head - tail} lines omitted ...]", *out[-tail:]]
    return "\n".join(out)


def _map(df: DataFrame, keep: list[str], cols: list[str], fn, field: str) -> DataFrame:
    """keep and the text fn(cols) of each row, in Arrow batches; of a batch a slice is held as Python objects."""
    src = df.select(*keep, *[T.text(c).alias(f"__{i}") for i, c in enumerate(cols)])

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                args = [b.column(len(keep) + i).to_pylist() for i in range(len(cols))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([fn(*a) for a in zip(*args, strict=True)], pa.string())], names=[*keep, field])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)])
    return src.mapInArrow(run, f"{schema}, {field} string")


def cleaned(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return _map(df, keep, [text], clean_markdown, "cleaned")


def read_all(df: DataFrame, keep: list[str], text: str, path: str, lang: str, mode: str = "auto") -> DataFrame:
    return _map(df, keep, [text, path, lang], lambda t, p, g: read(t, p, g, mode), "shown")


def shortened(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return _map(df, keep, [text], shorten_long, "shortened")


def tool_result(message: str) -> str:
    """A JSON-RPC message whose text blocks of LEAST_RESULT tokens or more are reduced where that saves tokens; all else, and what doesn't parse, as it came."""
    from weftline.operators.reduce import generic

    try:
        v = json.loads(message)
        content = v["result"]["content"]
    except (ValueError, KeyError, TypeError):
        return message
    changed = False
    for block in content if isinstance(content, list) else []:
        if isinstance(block, dict) and block.get("type") == "text" and isinstance(block.get("text"), str) and count(block["text"]) >= LEAST_RESULT:
            less = generic(block["text"])
            if count(less) < count(block["text"]):
                block["text"], changed = less, True
    return json.dumps(v, ensure_ascii=False, separators=(",", ":")) if changed else message


def proxied(messages: DataFrame, keep: list[str], message: str = "message") -> DataFrame:
    """keep and the message as a proxy passes it on; works on streams as on tables, one row a message."""
    return _map(messages, keep, [message], tool_result, "passed")


def pre_event(command: Column | str, covered: Column) -> Column:
    """What a command runs as: wrapped in the reducing runner where a filter covers it; empty and wrapped ones, and those with a here-document, as they are."""
    c = T.text(command)
    plain = (F.trim(c) == "") | F.trim(c).startswith("weftline run ") | c.contains("<<")
    return F.when(plain | ~F.coalesce(covered, F.lit(False)), c).otherwise(F.concat(F.lit("weftline run "), c))


def post_event(output: Column | str, most: int = 8000) -> Column:
    """What of an output is passed on: credentials masked, and of over `most` tokens three quarters of the room from the head and one from the tail."""
    t = T.redact_credentials(output)
    room = most * 4
    cut = F.concat(F.substring(t, 1, room * 3 // 4), F.lit("\n[... "), (T.tokens(t) - most).cast("string"), F.lit(" tokens omitted ...]\n"), F.right(t, F.lit(room // 4)))
    return F.when(T.tokens(t) > most, cut).otherwise(t)
