"""Declarative line filters: definitions, command matching, and the interpreter that reduces an output."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field, fields
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.chunks import count, text_lines


@dataclass
class Definition:
    """One filter; every field but match_command is optional."""

    match_command: str
    name: str = ""
    description: str | None = None
    skip_when_matches: str | None = None
    notify_on_truncate: bool = False
    strip_ansi: bool = False
    strip_lines_matching: list[str] = field(default_factory=list)
    keep_lines_matching: list[str] = field(default_factory=list)
    max_lines: int | None = None
    head_lines: int | None = None
    tail_lines: int | None = None
    on_empty: str | None = None
    passthrough_when_emptied: bool = False
    match_output: list[dict] = field(default_factory=list)
    uniform_success: dict | None = None
    truncate_lines_at: int | None = None
    filter_stderr: bool = False
    replace_patterns: list[list[str]] = field(default_factory=list)
    extract_sections: list[dict] = field(default_factory=list)
    semantic_filter: dict | None = None
    deduplicate_blocks: dict | None = None
    summarize_json: dict | None = None
    token_budget: int | None = None
    on_failure: str | None = None
    priority_lines: list[str] = field(default_factory=list)
    category_caps: list[dict] = field(default_factory=list)
    block_caps: list[dict] = field(default_factory=list)


def load(text: str) -> list[Definition]:
    """Definitions of a TOML text with [filters.name] tables; unknown fields are an error."""
    known = {f.name for f in fields(Definition)}
    out = []
    for name, body in tomllib.loads(text).get("filters", {}).items():
        if extra := set(body) - known:
            raise ValueError(f"{name}: unknown fields {sorted(extra)}")
        out.append(Definition(name=name, **body))
    return out


@lru_cache(4096)
def rx(pattern: str) -> re.Pattern | None:
    """The pattern in Python's dialect (end of text for $, braces of code points); None if it doesn't compile."""
    p = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)
    p = re.sub(r"\[:(\w+):\]", lambda m: {"alpha": "A-Za-z", "digit": "0-9", "space": r"\s", "alnum": "A-Za-z0-9"}.get(m[1], ""), p)
    try:
        return re.compile(p)
    except re.error:
        return None


def hits(pattern: str, line: str) -> bool:
    p = rx(pattern)
    return bool(p and p.search(line))


def issues(d: Definition) -> list[str]:
    """What is wrong with a definition: patterns that don't compile, windows of nothing."""
    pats = [d.match_command, d.skip_when_matches, *d.strip_lines_matching, *d.keep_lines_matching, *d.priority_lines, *(p for p, _ in d.replace_patterns), *(m["pattern"] for m in d.match_output), *(c["pattern"] for c in d.category_caps)]
    out = [f"bad pattern: {p}" for p in pats if p and rx(p) is None]
    return out + [f"{n} is 0" for n in ("max_lines", "head_lines", "token_budget") if getattr(d, n) == 0]


_FAILURE = re.compile(T.FAILURE_SIGNAL.replace("(?dm)", "(?m)"))
_FAILURE_LINE = re.compile(T.FAILURE_LINE)
_ANSI = re.compile(T.ANSI)


def reduce(output: str, d: Definition, ok: bool | None = None) -> str:
    """The output as the filter leaves it; line ends as most of the output has them; never longer than the output. ok: whether the command succeeded, if known."""
    crlf = output.count("\r\n") * 2 > output.count("\n")
    got = _Run(output, d, ok).result()
    return got.replace("\r\n", "\n").replace("\n", "\r\n") if crlf else got


class _Run:
    def __init__(self, output: str, d: Definition, ok: bool | None):
        self.raw, self.d, self.failed = output, d, ok is False
        self.bad = self.failed or bool(_FAILURE.search(output))

    def not_longer(self, got: str) -> str:
        raw = self.raw.rstrip()
        return raw if raw and len(got.encode()) > len(raw.encode()) else got

    def result(self) -> str:
        d = self.d
        if self.failed and d.on_failure:
            if d.on_failure == "passthrough":
                return self.raw.rstrip()
            if m := re.fullmatch(r"tail:(\d+)", d.on_failure):
                lines = text_lines(self.raw.rstrip())
                return "\n".join(lines[len(lines) - min(int(m[1]), len(lines)) :])
        if not self.bad:
            for m in d.match_output:
                if hits(m["pattern"], self.raw) and not (m.get("unless") and (rx(m["unless"]) is None or hits(m["unless"], self.raw))):
                    return self.not_longer(m["message"])
        plain = _ANSI.sub("", self.raw) if d.strip_ansi else self.raw
        if not self.bad and d.uniform_success and (said := _uniform(plain, d.uniform_success)) is not None:
            return self.not_longer(said)
        lines = text_lines(plain)
        for stage in (_blocks, _strip, _keep, _sections, _replace, _categories, _similar, _relevant, _json):
            lines = stage(lines, d)
        lines, lost = self.sized(lines)
        if d.notify_on_truncate and lost:
            lines.append(f"[... {lost} lines omitted (line limit) ...]")
        body = self.shortened(lines)
        if d.token_budget:
            body = budgeted(body, d.token_budget)
        if not body.strip():
            if self.raw.strip() and (d.passthrough_when_emptied or self.bad):
                return self.not_longer(self.window(text_lines(plain)))
            if d.on_empty and not self.failed:
                return self.not_longer(d.on_empty)
        return self.not_longer(body)

    def cut(self, line: str) -> str:
        n = self.d.truncate_lines_at
        return line if n is None else line.encode()[:n].decode(errors="ignore")

    def shortened(self, lines: list[str]) -> str:
        short = [self.cut(s) for s in lines]
        n = sum(a != b for a, b in zip(short, lines, strict=True))
        if n and self.d.notify_on_truncate:
            short.append(f"[... {n} line(s) truncated to {self.d.truncate_lines_at} chars ...]")
        return "\n".join(short)

    def window(self, lines: list[str]) -> str:
        """First and last lines of what filtering emptied: errors are mostly last."""
        cap = 40 if self.d.max_lines is None else self.d.max_lines
        shown = [self.cut(s) for s in lines]
        if len(lines) > cap:
            head = -(-cap // 2)
            shown = [*shown[:head], f"[... {len(lines) - cap} lines omitted ...]", *shown[len(lines) - (cap - head) :]]
        body = "\n".join(shown)
        return budgeted(body, self.d.token_budget) if self.d.token_budget else body

    def sized(self, lines: list[str]) -> tuple[list[str], int]:
        d, n = self.d, len(lines)
        keep, seam = set(range(n)), False
        if d.head_lines is not None and d.tail_lines is not None:
            if n > d.head_lines + d.tail_lines:
                keep, seam = {*range(d.head_lines), *range(n - d.tail_lines, n)}, True
        elif d.head_lines is not None:
            keep = set(range(min(n, d.head_lines)))
        elif d.tail_lines is not None:
            keep = set(range(max(0, n - d.tail_lines), n))
        elif d.max_lines is not None and n > d.max_lines:
            order = list(range(n))
            if self.bad and not d.priority_lines:  # failures first, then the head
                order.sort(key=lambda i: not _FAILURE_LINE.search(lines[i]))
                seam = True
            keep = set(order[: d.max_lines])
        keep |= {i for i in range(n) if i not in keep and any(hits(p, lines[i]) for p in d.priority_lines)}
        lost = n - len(keep)
        if not lost:
            return lines, 0
        gap = min(set(range(n)) - keep)
        out = []
        for i, line in enumerate(lines):
            if i in keep:
                out.append(line)
            elif seam and i == gap:
                out.append(f"[... {lost} lines omitted ...]")
        return out, 0 if seam else lost


def _uniform(text: str, rule: dict) -> str | None:
    lines = [s for s in text_lines(text) if s.strip() and not any(hits(p, s) for p in rule.get("ignore_lines", []))]
    return rule["message"].replace("{n}", str(len(lines))) if lines and all(hits(rule["pattern"], s) for s in lines) else None


def _strip(lines, d):
    return [s for s in lines if not any(hits(p, s) for p in d.strip_lines_matching)]


def _keep(lines, d):
    return [s for s in lines if any(hits(p, s) for p in d.keep_lines_matching)] if d.keep_lines_matching else lines


def _replace(lines, d):
    for p, put in d.replace_patterns:
        if r := rx(p):
            # $1 and ${name} are groups, $$ is a dollar
            made = re.sub(r"\$(?:\$|\{(\w+)\}|(\w+))", lambda m: "$" if m[0] == "$$" else rf"\g<{m[1] or m[2]}>", put.replace("\\", r"\\"))
            lines = [r.sub(made, s) for s in lines]
    return lines


def _blocks(lines, d):
    caps = [(c["start"], c.get("end") or r"^\s*$", max(1, c["max_lines"])) for c in d.block_caps]
    out, open_, seen, lost, blocks = [], None, 0, 0, 0
    for s in lines:
        start = next((i for i, c in enumerate(caps) if hits(c[0], s)), None)
        if start is not None:
            open_, seen = start, 1
        elif open_ is not None and hits(caps[open_][1], s):
            open_ = None
        elif open_ is not None:
            seen += 1
            if seen > caps[open_][2]:
                lost += 1
                blocks += seen == caps[open_][2] + 1
                continue
        out.append(s)
    return [*out, f"[... {lost} detail lines omitted from {blocks} blocks ...]"] if lost else out


def _sections(lines, d):
    keep: set[int] = set()
    after: dict[int, int] = {}
    for sec in d.extract_sections:
        if not (rx(sec["start_pattern"]) and rx(sec["end_pattern"])):
            continue
        marks, most, cap = sec.get("include_markers", False), sec.get("max_matches"), max(1, sec.get("max_lines") or len(lines) + 1)
        done, held, inside = 0, [], False

        def close(held, cap=cap):
            if len(held) > cap:
                after[held[cap - 1]] = len(held) - cap
            keep.update(held[:cap])

        for i, s in enumerate(lines):
            opens, ends = hits(sec["start_pattern"], s), hits(sec["end_pattern"], s)
            if inside and (ends or opens and sec.get("split_on_start")):
                if ends and marks:
                    held.append(i)
                close(held)
                done, held, inside = done + 1, [], False
                if most and done >= most:
                    break
                if ends:
                    continue
            if opens and not inside:
                inside, held = True, [i] if marks else []
            elif inside:
                held.append(i)
        if inside:
            close(held)
    if not keep:
        return lines
    out = []
    for i in sorted(keep):
        out.append(lines[i])
        if i in after:
            out.append(f"    [... {after[i]} lines omitted ...]")
    return out


def _categories(lines, d):
    kept: dict[int, int] = {}
    lost: dict[int, int] = {}
    place: dict[int, int] = {}
    out = []
    for s in lines:
        c = next((i for i, cap in enumerate(d.category_caps) if hits(cap["pattern"], s)), None)
        if c is not None and kept.get(c, 0) >= d.category_caps[c]["max"]:
            lost[c] = lost.get(c, 0) + 1
            continue
        out.append(s)
        if c is not None:
            kept[c] = kept.get(c, 0) + 1
            place[c] = len(out)
    for c in sorted(lost, key=lambda c: -place.get(c, 0)):
        out.insert(place.get(c, 0), f"[... {lost[c]} more similar line(s) omitted ...]")
    return out


def _similar(lines, d):
    rule = d.deduplicate_blocks
    if not rule:
        return lines
    edge, least, same = rule.get("block_delimiter") or r"^\s*$", rule.get("min_block_lines", 2), rule.get("similarity", 0.9)
    blocks, body = [], []
    for s in lines:
        if hits(edge, s) and body:
            blocks.append(body)
            body = []
        else:
            body.append(s)
    if body:
        blocks.append(body)
    if sum(len(b) >= least for b in blocks) < 2:
        return lines
    alike = lambda a, b: len(a) == len(b) >= least and sum(x == y for x, y in zip(a, b, strict=True)) / len(a) >= same
    out, i = [], 0
    while i < len(blocks):
        j = i + 1
        while j < len(blocks) and alike(blocks[i], blocks[j]):
            j += 1
        out += blocks[i] + ([f"[... {j - i - 1} similar block(s) omitted ...]"] if j > i + 1 else [])
        i = j
    return out


def _relevant(lines, d):
    if not (rule := d.semantic_filter):
        return lines
    terms = rule["query"].lower().split()
    return [s for s in lines if any(hits(p, s) for p in rule.get("always_keep", [])) or any(t in s.lower() for t in terms)]


def _json(lines, d):
    if not (rule := d.summarize_json):
        return lines
    try:
        value = json.loads("\n".join(lines))
    except ValueError:
        return lines
    if not isinstance(value, (dict, list)):
        return lines
    return json.dumps(summarised(value, rule), indent=2, ensure_ascii=False).split("\n")


def summarised(value, rule: dict, depth: int = 0, path: str = ""):
    """Arrays cut to max_array_items, excluded keys left out, down to max_depth; always_include keeps a key's value whole."""
    most, deep = rule.get("max_array_items", 3), rule.get("max_depth", 4)
    if depth >= deep:
        return value
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            full = f"{path}.{k}" if path else k
            if {k, full} & set(rule.get("exclude", [])):
                continue
            out[k] = v if {k, full} & set(rule.get("always_include", [])) else summarised(v, rule, depth + 1, full)
        return out
    if isinstance(value, list):
        shown = [summarised(v, rule, depth + 1, path) for v in value[:most]]
        return [*shown, f"... {len(value) - most} more item(s) omitted ..."] if len(value) > most else shown
    return value


def budgeted(text: str, budget: int) -> str:
    """Errors, warnings and the outer quarters first, until a line doesn't fit; then the others the same way; in source order."""
    lines = text_lines(text)
    if count(text) <= budget or not lines:
        return text

    def high(i: int) -> bool:
        t = lines[i].strip()
        return t.startswith(("error", "warning", "FAIL", "panic")) or "error[" in t or "warning[" in t or i < len(lines) // 4 or i >= len(lines) * 3 // 4

    kept, used = [], 0
    for group in ([i for i in range(len(lines)) if high(i)], [i for i in range(len(lines)) if not high(i)]):
        for i in group:
            if used + count(lines[i]) > budget:
                break
            kept.append(i)
            used += count(lines[i])
    out = [lines[i] for i in sorted(kept)]
    return "\n".join([*out, f"[... {len(lines) - len(kept)} lines omitted to fit token budget {budget} ...]"] if len(kept) < len(lines) else out)


# Words that only wrap another command, with the number of own arguments.
WRAPPERS = {"sudo": 0, "time": 0, "nice": 0, "nohup": 0, "env": 0, "command": 0, "exec": 0, "timeout": 1, "xvfb-run": 0, "stdbuf": 1}
PACKAGE_RUNNERS = [("npx",), ("bunx",), ("uvx",), ("pnpm", "exec"), ("pnpm", "dlx"), ("yarn", "dlx"), ("bundle", "exec"), ("poetry", "run"), ("uv", "run"), ("pipenv", "run"), ("python", "-m"), ("python3", "-m")]


def words(command: str) -> list[str]:
    """Words of a shell command: quotes and escapes resolved, operators as words of their own."""
    out, word, quote, some, i = [], "", "", False, 0
    while i < len(command):
        c = command[i]
        if quote:
            if c == quote:
                quote = ""
            elif c == "\\" and quote == '"' and i + 1 < len(command):
                i += 1
                word += command[i]
            else:
                word += c
        elif c in "'\"":
            quote, some = c, True
        elif c == "\\" and i + 1 < len(command):
            i += 1
            word, some = word + command[i], True
        elif c.isspace() or c in "|&;":
            if word or some:
                out.append(word)
            word, some = "", False
            if c in "|&;":
                twice = command[i : i + 2] in ("&&", "||")
                out.append("\0" + (c * 2 if twice else c))
                i += twice
        else:
            word += c
        i += 1
    return [*out, word] if word or some else out


def segments(command: str) -> list[list[str]]:
    """The words of each simple command between operators; 2>&1 and &> don't part."""
    out: list[list[str]] = [[]]
    ws = words(re.sub(r"(?:[12]?>&[12]|&>>?\s*\S+)", " ", command))
    for w in ws:
        if w.startswith("\0"):
            out.append([])
        else:
            out[-1].append(w)
    return [s for s in out if s]


def effective(argv: list[str]) -> list[str]:
    """A command without assignments, wrappers, cd and package runners; of `sh -c` the inner command."""
    for _ in range(16):
        before = argv
        while argv and re.match(r"[A-Za-z_]\w*=", argv[0]):
            argv = argv[1:]
        if argv and argv[0] in WRAPPERS:
            argv = argv[1 + WRAPPERS[argv[0]] :]
            while argv and argv[0].startswith("-"):
                argv = argv[1:]
        for r in PACKAGE_RUNNERS:
            if tuple(argv[: len(r)]) == r and len(argv) > len(r):
                argv = argv[len(r) :]
                while len(argv) > 1 and argv[0].startswith("-"):
                    argv = argv[1:]
                break
        if len(argv) >= 3 and re.search(r"(?:^|/)(?:ba|z|da)?sh$", argv[0]) and re.fullmatch(r"-\w*c", argv[1]):
            inner = [s for s in segments(argv[2]) if s[0] != "cd"]
            argv = inner[-1] if inner else argv
        if argv == before:
            return argv
    return argv


def candidates(command: str) -> list[str]:
    """What a filter may match: the effective commands of the segments, the last first, then the whole."""
    found = [" ".join(e) for s in reversed(segments(command)) if s[0] != "cd" and (e := effective(s))]
    return list(dict.fromkeys([*found, command.strip()]))


# Tools whose -v asks for the version, and tools whose -j is a number of jobs.
VERSION_TOOLS = {"git", "node", "docker", "npm", "npx", "pnpm", "yarn", "bun"}
JOB_TOOLS = {"cargo", "make", "ninja", "cmake", "mvn", "gradle", "build"}


def bypass(command: str) -> str | None:
    """Why a command's output is never filtered: help, version, verbose or yaml; `json`: only filters that summarise JSON may."""
    argv = effective((segments(command) or [[]])[-1])
    low, whole = [w.lower() for w in argv], " ".join(argv)
    after = lambda flag, i: re.split(r"[/\\]", argv[i - 1])[-1].lower().removesuffix(".exe") if i and argv[i] == flag else None
    if {"-h", "-help", "/h", "/?"} & set(argv) or {"--help", "help"} & set(low) or any(w.startswith(("--help-", "-help-")) for w in low):
        return "help"
    if len(argv) <= 3 and ({"--version", "version"} & set(low) or "-V" in argv or any(after("-v", i) in VERSION_TOOLS for i in range(len(argv)))):
        return "version"
    if {"-vv", "-vvv"} & set(argv) or {"--debug", "--verbose", "--trace"} & set(low) or any(w.startswith(("--log-level=debug", "--log-level=trace")) for w in low):
        return "verbose"
    if {"--yaml", "-o=yaml", "yaml"} & set(low) or any(p in whole for p in ("-o yaml", "--format yaml", "--format=yaml")):
        return "yaml"
    jobs = any(w == "-j" and (not i or after("-j", i) not in JOB_TOOLS) for i, w in enumerate(argv))
    if jobs or {"--json", "-o=json", "json"} & set(low) or any(p in whole for p in ("-o json", "--format json", "--format=json", "--message-format=json", "--message-format json")):
        return "json"
    return None


def find(command: str, groups: list[list[Definition]]) -> Definition | None:
    """The filter of a command: first candidate first, then the first group, then the longest pattern. Commands that ask for help, a version, more detail or YAML have none."""
    why = bypass(command)
    if why not in (None, "json"):
        return None
    for c in candidates(command):
        for group in groups:
            fit = [d for d in group if hits(d.match_command, c) and not (why == "json" and not d.summarize_json) and not (d.skip_when_matches and hits(d.skip_when_matches, c))]
            if fit:
                return max(fit, key=lambda d: len(d.match_command))
    return None


# Our own small set of definitions.
BUILT_IN = load(
    r"""
[filters.listing]
match_command = '^(ls|find|tree)\b'
strip_ansi = true
strip_lines_matching = ['^\s*$']
max_lines = 40
notify_on_truncate = true
[filters.test-run]
match_command = '^(pytest|cargo test|go test|npm test)\b'
strip_ansi = true
strip_lines_matching = ['^\s*$', '^test .* ok$', 'PASSED$']
category_caps = [{ pattern = '^warning', max = 3 }]
token_budget = 400
passthrough_when_emptied = true
on_empty = 'all passed'
[filters.prose]
match_command = '^cat\b'
strip_lines_matching = ['^\s*$']
head_lines = 12
tail_lines = 4
truncate_lines_at = 160
"""
)


def apply_to(df: DataFrame, command: str, output: str, groups: list[list[Definition]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep columns, filter (its name, null for none) and reduced. Commands are resolved once for each distinct one of a batch."""
    groups = groups or [BUILT_IN]
    keep = keep or []
    src = df.select(*keep, F.col(command).alias("__c"), T.text(output).alias("__o"))

    def run(batches):
        memo: dict = {}
        for b in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):  # of a batch, only a slice is held as Python objects
            names, texts = [], []
            for c, o in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True):
                if len(memo) > 100_000:
                    memo.clear()
                if c not in memo:
                    memo[c] = find(c or "", groups)
                d = memo[c]
                names.append(d.name if d else None)
                texts.append(reduce(o, d) if d else o)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names, pa.string()), pa.array(texts, pa.string())], names=[*keep, "filter", "reduced"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)])
    return src.mapInArrow(run, ", ".join(x for x in (schema, "filter string, reduced string") if x))


def literal(pattern: Column) -> Column:
    """Letters and digits that every match of a pattern begins with: those after a leading ^, but for the last where a quantifier may follow; empty where none is sure."""
    head = F.regexp_extract(pattern, r"^\^([A-Za-z0-9 ]+)", 1)
    rest = F.substring(pattern, F.char_length(head) + 2, F.lit(1))
    sure = F.when(rest.isin("?", "*", "{", "+"), F.left(head, F.char_length(head) - 1)).otherwise(head)
    return F.when(pattern.contains("|"), "").otherwise(sure)


def match_table(commands: DataFrame, definitions: DataFrame, command: Column | str = "command") -> DataFrame:
    """SQL form of the match: distinct commands with definitions (name, pattern, rank), lowest rank then longest pattern first.

    A definition whose pattern begins with a fixed first character meets only the commands that begin with it, by an equal join; the others, which any command may
    meet, are broadcast in lots of 10,000, so no number of definitions turns the match into a product of shuffled sides.
    """
    some = commands.select((F.col(command) if isinstance(command, str) else command).alias("command")).distinct()
    defs = definitions.withColumn("head", F.left(literal(F.col("pattern")), F.lit(1)))
    fixed, loose = defs.where("head <> ''"), defs.where("head = ''").drop("head")
    pairs = some.withColumn("head", F.left("command", F.lit(1))).join(fixed, "head").where(F.expr("command rlike pattern")).select("command", "name", "pattern", "rank")
    lots = -(-loose.count() // 10_000)
    for n in range(lots):
        lot = loose if lots == 1 else loose.where(F.pmod(F.xxhash64("name", "pattern"), F.lit(lots)) == n)
        pairs = pairs.union(some.join(F.broadcast(lot), F.expr("command rlike pattern")).select("command", "name", "pattern", "rank"))
    first = Window.partitionBy("command").orderBy("rank", F.desc(F.length("pattern")), "name")
    return pairs.withColumn("r", F.row_number().over(first)).where("r = 1").select("command", "name")
