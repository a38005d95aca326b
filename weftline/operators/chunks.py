"""Text to chunks of at most 400 tokens, symbol spans, outlines, references and imports."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

MOST, OVERLAP, LEAST = 400, 40, 10
KEYWORDS = ["if", "for", "while", "match", "return", "fn", "let", "use", "pub", "struct", "enum", "impl", "trait", "mod", "const", "static", "switch", "catch", "function", "class", "def", "self", "super", "new", "loop", "else", "elif", "in", "not", "and", "or", "print"]
_C_LIKE = re.compile(r"^\s*(?:export\s+|pub(?:\([^)]*\))?\s+|default\s+|abstract\s+|async\s+|static\s+|unsafe\s+)*(fn|func|function|class|interface|enum|struct|trait|impl|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)")
_PYTHON = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)")
_VB = re.compile(r"(?i)^\s*(?:public\s+|private\s+|friend\s+)?(?:static\s+)?(sub|function|property\s+(?:get|let|set))\s+([A-Za-z][A-Za-z0-9_]*)")
_SQL = re.compile(r'(?i)^\s*create\s+(?:or\s+replace\s+)?(package|materialized\s+view|type|procedure|function|trigger|view|table|index|sequence)\s+(?:body\s+)?(?:if\s+not\s+exists\s+)?("?[\w$#]+"?(?:\s*\.\s*"?[\w$#]+"?)?)')


def count(text: str) -> int:
    return -(-len(text) // 4)


def text_lines(text: str) -> list[str]:
    out = [s[:-1] if s.endswith("\r") else s for s in text.split("\n")]
    return out[:-1] if out and out[-1] == "" else out


def _windows(lines: list[str], first: int, last: int):
    """(from, to) line windows of at most MOST tokens; each but the first repeats OVERLAP tokens of the one before."""
    at = first
    while at <= last:
        end, used = at, count(lines[at])
        while end < last and used + count(lines[end + 1]) <= MOST:
            end += 1
            used += count(lines[end])
        yield at, end
        if end >= last:
            return
        back, again = end, count(lines[end])
        while again < OVERLAP and back > at:
            back -= 1
            again += count(lines[back])
        at = back if back > at and again >= OVERLAP else end + 1


def symbols(lines: list[str], lang: str) -> list[tuple[int, int, str, str]]:
    """(first, last, name, kind) of definitions, by line patterns: braces end a block, in Python the indentation, in SQL and VB the next one."""
    found: list[tuple[int, int, str, str]] = []
    if lang in ("sql", "vb"):
        marks = [(i, m) for i, s in enumerate(lines) if (m := (_SQL if lang == "sql" else _VB).match(s))]
        for n, (i, m) in enumerate(marks):
            last = marks[n + 1][0] - 1 if n + 1 < len(marks) else len(lines) - 1
            found.append((i, last, re.sub(r'["\s]', "", m[2]), m[1].lower().split()[0].replace("materialized", "view").replace("sub", "function")))
    elif lang == "python":
        for i, s in enumerate(lines):
            if m := _PYTHON.match(s):
                end = i
                for j in range(i + 1, len(lines)):
                    if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                        break
                    end = j if lines[j].strip() else end
                found.append((i, end, m[3], "function" if m[2] == "def" else "class"))
    elif lang != "generic":
        for i, s in enumerate(lines):
            if m := _C_LIKE.match(s):
                found.append((i, _brace_end(lines, i), m[2], {"fn": "function", "func": "function"}.get(m[1], m[1])))
    return found


def _brace_end(lines: list[str], first: int) -> int:
    depth, opened = 0, False
    for i in range(first, len(lines)):
        for c in lines[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return i
            elif c == ";" and not opened:
                return i
    return len(lines) - 1


def chunk(text: str, lang: str = "generic") -> list[dict]:
    """Chunks of a text: its outermost symbols and the lines between them, each cut into windows. Line numbers from 1."""
    lines = text_lines(text)
    spans, at = [], 0
    for first, last, name, kind in sorted(symbols(lines, lang), key=lambda s: (s[0], -s[1])):
        if first < at:
            continue  # inside the one before
        if first > at:
            spans.append((at, first - 1, "", "module" if lang != "generic" else "block"))
        spans.append((first, last, name, kind))
        at = last + 1
    if at < len(lines):
        spans.append((at, len(lines) - 1, "", "module" if spans else "block"))
    out = []
    for first, last, name, kind in spans:
        for a, b in _windows(lines, first, last):
            body = "\n".join(lines[a : b + 1]).rstrip()
            if count(body) >= LEAST if kind == "block" else any(c.isalnum() for c in body):
                line = a
                for i in range(0, len(body), 4 * MOST):  # one overlong line
                    piece = body[i : i + 4 * MOST]
                    stop = line + piece.rstrip("\n").count("\n")
                    out.append({"start_line": line + 1, "end_line": min(stop, b) + 1, "symbol": name, "kind": kind, "content": piece, "token_count": count(piece)})
                    line += piece.count("\n")
    return [c for c in out if c["content"].strip()]


_CHUNK = pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("symbol", pa.string()), ("kind", pa.string()), ("content", pa.string()), ("token_count", pa.int32())]))


def chunks(df: DataFrame, id_col: str, text_col: str = "text", lang: Column | None = None) -> DataFrame:
    """(id, chunk_id, start_line, end_line, symbol, kind, content, token_count). chunk_id is a hash of place and name, the same on every run."""
    src = df.select(F.col(id_col).alias("id"), T.text(text_col).alias("t"), (lang if lang is not None else F.lit("generic")).alias("lang"))

    def run(batches):
        for b in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):  # of a batch, only a slice is held as Python objects
            got = [chunk(t, g) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, _CHUNK)], names=["id", "c"])

    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, c array<struct<start_line:int,end_line:int,symbol:string,kind:string,content:string,token_count:int>>")
    out = out.select("id", F.explode("c").alias("c")).select("id", "c.*")
    return out.withColumn("chunk_id", F.xxhash64("id", "start_line", "end_line", "symbol", F.xxhash64("content")))


def outline(df: DataFrame, id_col: str, text_col: str = "text", lang: Column | None = None) -> DataFrame:
    """(id, outline): the first line of every symbol, by line."""
    first = chunks(df, id_col, text_col, lang).where("symbol <> ''").groupBy("id", "symbol", "kind").agg(F.min(F.struct("start_line", F.element_at(F.split("content", "\n"), 1).alias("line"))).alias("s"))
    return first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat(s["start_line"].cast("string"), F.lit(": "), F.trim(s["line"]))), "\n").alias("outline"))


def references(content: Column | str) -> Column:
    """Names that a text calls: path calls, methods and plain calls, but for keywords and definitions. Comments and strings don't count."""
    noise = r"""(?s)/\*.*?\*/|//[^\n]*|#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n>]|\\.)*'"""
    c = F.regexp_replace(F.regexp_replace(T.text(content), noise, " "), r"\b(?:fn|def|func|function|sub|procedure)\s+[A-Za-z_][A-Za-z0-9_]*", " ")
    name = r"[A-Za-z_][A-Za-z0-9_]*"
    paths = F.regexp_extract_all(c, F.lit(rf"\b({name}(?:::{name})+)\s*\("), F.lit(1))
    calls = F.regexp_extract_all(c, F.lit(rf"\b({name})\s*\("), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(paths, F.filter(calls, lambda n: ~n.isin(KEYWORDS)))))


def resolve(refs: DataFrame, symbols_df: DataFrame, most: int = 8) -> DataFrame:
    """Edges (caller, callee): references (caller, ref) joined with definitions (callee, name, path).

    The whole name first, then its last part; a bare name with over `most` definitions is dropped, a qualified one keeps those whose path
    has a qualifier as a segment.
    """
    defs = symbols_df.select("callee", F.lower("name").alias("key"), F.transform(F.split(F.lower("path"), r"[/\\]"), lambda s: F.regexp_replace(s, r"\.rs$", "")).alias("segments"))
    counted = defs.groupBy("key").agg(F.count("*").alias("n"))
    parts = F.filter(F.split(F.lower("ref"), r"::|\."), lambda p: p != "")
    r = refs.select("caller", "ref", F.lower("ref").alias("whole"), F.element_at(parts, -1).alias("short"), F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.isin("crate", "self", "super")).alias("quals"))
    whole = r.join(counted.withColumnRenamed("key", "whole"), "whole", "left")
    exact = whole.where("n is not null").select("caller", F.col("whole").alias("key"), F.array().cast("array<string>").alias("quals"), F.lit(True).alias("sure"))
    loose = whole.where("n is null").drop("n").join(counted.withColumnRenamed("key", "short"), "short").where(~F.col("short").isin(KEYWORDS) & ((F.size("quals") > 0) | (F.col("n") <= most)))
    loose = loose.select("caller", F.col("short").alias("key"), "quals", F.lit(False).alias("sure"))
    hit = exact.union(loose).join(defs, "key").where((F.size("quals") == 0) | F.arrays_overlap("quals", "segments"))
    return hit.where("caller <> callee").select("caller", "callee").distinct()


# Import statements by language (pattern, kind).
IMPORTS = {
    "rust": [(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([A-Za-z_][A-Za-z0-9_:]*)", "use"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([a-z_][a-z0-9_]*)\s*;", "mod")],
    "python": [(r"^\s*from\s+([.\w]+)\s+import\b", "import"), (r"^\s*import\s+([.\w]+)", "import")],
    "javascript": [(r"^\s*(?:import|export)\s+(?:[^'\"]*?\s+from\s+)?['\"]([^'\"]+)['\"]", "import"), (r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", "require")],
    "go": [(r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"", "import")],
    "cpp": [(r"^\s*#\s*include\s+\"([^\"]+)\"", "include"), (r"^\s*#\s*include\s+<([^>]+)>", "include")],
}


def imports(lines: DataFrame) -> DataFrame:
    """(path, pos, target, kind) of lines (path, lang, pos, line)."""
    target, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, rules in IMPORTS.items():
        mine = F.col("lang").isin(["javascript", "typescript"]) if lang == "javascript" else F.col("lang") == lang
        for pattern, k in reversed(rules):
            hit = mine & F.col("line").rlike(pattern)
            target, kind = F.when(hit, F.regexp_extract("line", pattern, 1)).otherwise(target), F.when(hit, F.lit(k)).otherwise(kind)
    return lines.select("path", "pos", target.alias("target"), kind.alias("kind")).where("target is not null")


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """found with resolved: the first of a target's candidate paths that is a file (path); null for what lies outside."""
    folder, t = T.directory("path"), F.col("target")
    join = lambda *p: F.regexp_replace(F.concat(*p), r"^/+|(?<=^|/)\./", "")
    mod = F.replace(t, F.lit("."), F.lit("/"))
    segs = F.filter(F.split(t, "::"), lambda s: ~s.isin("crate", "self", "super", ""))
    upto = F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.size(segs), F.lit(1)))), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))
    rust = F.flatten(F.transform(upto, lambda b: F.array(F.concat(F.lit("src/"), b, F.lit(".rs")), F.concat(F.lit("src/"), b, F.lit("/mod.rs")), F.concat(b, F.lit(".rs")))))
    near = [join(folder, F.lit("/"), t, F.lit(e)) for e in ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.js")]
    cands = (
        F.when(F.col("kind") == "use", rust)
        .when(F.col("kind") == "mod", F.array(join(folder, F.lit("/"), t, F.lit(".rs")), join(folder, F.lit("/"), t, F.lit("/mod.rs"))))
        .when(F.col("kind").isin("import", "require") & t.startswith("."), F.array(*near))
        .when(F.col("kind") == "import", F.array(F.concat(mod, F.lit(".py")), F.concat(mod, F.lit("/__init__.py")), F.concat(F.lit("src/"), mod, F.lit(".py"))))
        .when(F.col("kind") == "include", F.array(join(folder, F.lit("/"), t), t))
        .otherwise(F.array().cast("array<string>"))
    )
    numbered = found.withColumn("no", F.xxhash64("path", "pos", "target"))
    tried = numbered.select("no", F.posexplode(cands).alias("place", "file")).join(files.select(F.col("path").alias("file")).distinct(), "file")
    best = tried.groupBy("no").agg(F.min_by("file", "place").alias("resolved"))
    return numbered.join(best, "no", "left").drop("no")
