"""Scalar text functions as Spark columns; everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must equal the published behaviour.
ANSI = "\u001b\\[[0-?]*[ -/]*[@-~]|\u001b\\][^\u0007\u001b]*(?:\u0007|\u001b\\\\)|\u001b[@-Z\\\\-_]"
EMOJI_OUTPUT = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F000}-\\x{1F2FF}\\x{FE0F}\\x{200D}]"
EMOJI_MARKDOWN = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}]"
CREDENTIALS = [
    (r"(?i)://[^/\s@]+@", "://[REDACTED]@"),
    (r"(?i)(authorization|x-api-key|api-key)\s*:\s*[^\r\n\"']+", "[REDACTED]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._\-]+", "[REDACTED]"),
    (r"(?i)\b[A-Za-z0-9_]*(token|api[_-]?key|secret|password|passwd|pwd)(?:_[A-Za-z0-9_]*)?\s*[=:]\s*[^\s&\"']+", "[REDACTED]"),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", "[REDACTED]"),
]
SECRETS = [
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)bearer\s+[A-Za-z0-9._\-]{16,}",
    r"(?i)(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key)\s*[:=]\s*['\"]?[A-Za-z0-9._\-/+]{8,}['\"]?",
]
FAILURE_SIGNAL = (
    r"(?dm)^\s*(?:(?i:error|fatal|panic|panicked|exception|stderr|err)\b|FAILED\b|FAIL\b|---\s*FAIL\b|Traceback \(most recent call last\)|Unhandled exception|Exception in thread\b)"
    r"|^\S*:\s*(?i:error|fatal|panic):|\b(?i:failed with exit code|exited with status|exited with code|exit status|exit code|exit)\b\s*[:=]?\s*[1-9]\d*"
    r"|\b(?:SIGSEGV|SIGABRT|SIGILL|SIGBUS|AssertionError|NullPointerException|Segmentation fault|(?i:Command failed|command not found|failed to compile))\b"
    r"|\[(?i:error|fatal|panic|failed|fail)\]|level=(?i:error|fatal|panic)|\b(?i:err)(?:!|:)"
)
FAILURE_LINE = r"(?i)error|fail|fatal|panic|exception|denied|traceback|cannot|unable"
ENVIRONMENT_ERRORS = ["not found", "is not recognized", "No such file or directory", "No module named", "ModuleNotFoundError", "Cannot find module", "Permission denied"]
LANGUAGES = {
    "rust": ["rs"], "python": ["py"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "go": ["go"],
    "cpp": ["c", "cpp", "h", "hpp", "cc", "cxx"], "vb": ["bas", "cls", "ctl", "frm"], "sql": ["sql", "fnc", "trg", "pkg", "prc", "tab", "vw"],
}


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """ceil(code points / 4)."""
    return F.ceil(F.char_length(text(c)) / 4).cast("bigint")


def lines(c: Column | str) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    body = F.regexp_replace(text(c), r"\r?\n\z", "")
    return F.when(text(c) == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def content_hash(c: Column | str) -> Column:
    """First 8 bytes of SHA-256, hex."""
    return F.substring(F.sha2(text(c).cast("binary"), 256), 1, 16)


def dominant_eol(c: Column | str) -> Column:
    """CRLF if more than half of the line ends are."""
    crlf = F.regexp_count(text(c), F.lit("\r\n"))
    return F.when(crlf * 2 > F.regexp_count(text(c), F.lit("\n")), "\r\n").otherwise("\n")


def strip_ansi(c: Column | str) -> Column:
    return F.regexp_replace(text(c), ANSI, "")


def remove_emojis(c: Column | str, markdown: bool = False) -> Column:
    return F.regexp_replace(text(c), EMOJI_MARKDOWN if markdown else EMOJI_OUTPUT, "")


def collapse_blank_lines(c: Column | str) -> Column:
    """Runs of blank lines become one."""
    return F.regexp_replace(text(c), r"\n[ \t]*(?:\n[ \t]*)+\n", "\n\n")


def collapse_redraws(c: Column | str) -> Column:
    """Of a line redrawn with bare carriage returns, the last state."""
    return F.regexp_replace(text(c), r"[^\r\n]*\r(?!\n)", "")


def strip_crlf_warnings(c: Column | str) -> Column:
    kept = F.filter(F.split(text(c), "\n", -1), lambda s: ~(s.startswith("warning:") & (s.contains("LF will be replaced by CRLF") | s.contains("CRLF will be replaced by LF"))))
    return F.array_join(kept, "\n")


def redact_credentials(c: Column | str) -> Column:
    out = text(c)
    for pattern, put in CREDENTIALS:
        out = F.regexp_replace(out, pattern, put.replace("$", "\\$"))
    return out


def redact_secrets(c: Column | str) -> Column:
    out = text(c)
    for pattern in SECRETS:
        out = F.regexp_replace(out, pattern, "[REDACTED]")
    return out


def has_failure_signal(c: Column | str) -> Column:
    return text(c).rlike(FAILURE_SIGNAL)


def is_failure_line(c: Column | str) -> Column:
    return text(c).rlike(FAILURE_LINE)


def is_priority_line(c: Column | str) -> Column:
    t = F.trim(text(c))
    out = F.lit(False)
    for head in ("error", "warning", "FAIL", "panic"):
        out = out | t.startswith(head)
    for part in ("error[", "warning[", "ERROR", "FAILED"):
        out = out | t.contains(part)
    return out


def has_environment_error(c: Column | str) -> Column:
    out = F.lit(False)
    for part in ENVIRONMENT_ERRORS:
        out = out | text(c).contains(part)
    return out


def command_label(c: Column | str) -> Column:
    """Up to four leading words, before the first flag or word with a shell character; else the first word."""
    words = F.filter(F.split(text(c), r"\s+"), lambda w: w != "")
    stop = F.array_position(F.transform(words, lambda w: w.startswith("-") | w.rlike("[|&;<>=\"'/\\\\`$()]")), F.lit(True))
    n = F.least(F.when(stop > 0, stop - 1).otherwise(F.size(words)), F.lit(4)).cast("int")
    return F.when(F.size(words) == 0, text(c)).when(n == 0, F.element_at(words, 1)).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(n, F.lit(1))), " "))


def _trim_target(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\"'`\\,)\]};<>]+|[\s\"'`\\,)\]};<>]+$", "")


def normalize_host(c: Column | str) -> Column:
    h = F.regexp_replace(F.lower(_trim_target(text(c))), r"^(?:https?|ssh)://", "")
    h = F.regexp_replace(F.regexp_extract(h, r"^[^/?#]*", 0), r"^.*@", "")
    h = F.regexp_replace(F.regexp_extract(h, r"^[^:]*", 0), r"^[^a-z0-9.-]+|[^a-z0-9.-]+$", "")
    return F.regexp_replace(h, r"^www\.", "")


def normalize_target(c: Column | str) -> Column:
    t = _trim_target(text(c))
    base = F.regexp_replace(F.regexp_extract(t, r"^[^?#]*", 0), r"^([^:]*://)[^@]*@", "$1")
    return F.when(t.rlike("[?#]"), F.concat(base, F.lit("?[REDACTED]"))).otherwise(base)


def language(path: Column | str) -> Column:
    name = text(path)
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    out = F.lit("generic")
    for lang, exts in LANGUAGES.items():
        out = F.when(ext.isin(exts), lang).otherwise(out)
    return out


def basename(path: Column | str) -> Column:
    return F.regexp_extract(text(path), r"[^/\\]*$", 0)


def directory(path: Column | str) -> Column:
    return F.regexp_replace(text(path), r"/?[^/]*$", "")


def file_of(location: Column | str) -> Column:
    """Path of 'path:line'."""
    return F.regexp_replace(text(location), r":[0-9]+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often the body, or a function in it, refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entropy(c: Column | str) -> Column:
    """Bits per character of the text; 0 for none."""

    def bits(chars: Column) -> Column:
        share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.size(chars)
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, x: let(share(x), lambda p: acc - p * F.log2(p)))

    return let(F.filter(F.split(text(c), ""), lambda x: x != ""), bits)


def holdout(subject: Column | str, rate: float, seed: int = 0) -> Column:
    """Whether a subject falls into the seeded sample of this rate."""
    return F.pmod(F.xxhash64(text(subject), F.lit(seed)), F.lit(10_000)) < int(min(max(rate, 0.0), 1.0) * 10_000)


def escape_xml(c: Column | str) -> Column:
    out = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_html(c: Column | str) -> Column:
    return F.replace(escape_xml(c), F.lit("'"), F.lit("&#39;"))


def format_tokens(n: Column) -> Column:
    """Thousands as K and millions as M, with one digit."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", F.round(n / 1e6, 1))).when(n >= 1_000, F.format_string("%.1fK", F.round(n / 1e3, 1))).otherwise(n.cast("string"))


def format_cost(usd: Column) -> Column:
    """Whole dollars from 100 on, cents from 1 on, else four digits."""
    return F.when(usd >= 100, F.format_string("$%.0f", F.round(usd, 0))).when(usd >= 1, F.format_string("$%.2f", usd)).otherwise(F.format_string("$%.4f", usd))


def failure_signature(stdout: Column, stderr: Column, exit_code: Column) -> Column:
    """Identity of a failure: volatile numbers, addresses and times masked."""
    mask = lambda c: F.regexp_replace(text(c), r"0x[0-9a-fA-F]+|\b[0-9a-f]{7,40}\b|[0-9]+(?:[.:][0-9]+)*(?:ms|s|m|h)?", "~")
    return F.sha2(F.concat_ws("\u001f", mask(stdout), mask(stderr), exit_code.cast("string")), 256)
