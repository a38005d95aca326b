"""Agent transcripts: nested JSON to rows, tool calls with their outputs, large payloads, facts of the environment."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

FIELDS = "file string, line bigint, path string, kind string, call_id string, tool string, command string, text string"


def _text_of(v) -> str | None:
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        parts = [x.get("text") for x in v if isinstance(x, dict) and isinstance(x.get("text"), str)]
        return "\n".join(parts) if parts else None
    return None


def _command_of(v) -> str | None:
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return None
    if isinstance(v, dict):
        c = v.get("command")
        return " ".join(map(str, c)) if isinstance(c, list) else c if isinstance(c, str) else None
    return None


def flatten(value, path: str = ""):
    """(path, kind, call id, tool, command, text) of every call, output and string of a JSON value."""
    todo = [(value, path)]
    while todo:
        v, p = todo.pop()
        if isinstance(v, dict):
            kind = v.get("type")
            if kind in ("tool_use", "function_call"):
                yield p, "call", v.get("id") or v.get("call_id"), v.get("name"), _command_of(v.get("input") if kind == "tool_use" else v.get("arguments")), None
            elif kind in ("tool_result", "function_call_output"):
                yield p, "output", v.get("tool_use_id") or v.get("call_id"), None, None, _text_of(v.get("content") if kind == "tool_result" else v.get("output"))
            todo += [(x, f"{p}/{k}") for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(x, f"{p}/{i}") for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, str):
            yield p, "string", None, None, None, v


def rows(lines: DataFrame) -> DataFrame:
    """FIELDS of NDJSON lines (file, line, value); lines that aren't JSON are left out."""

    def run(batches):
        for b in batches:
            out = [[] for _ in range(8)]
            for f, n, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    parsed = json.loads(v or "")
                except ValueError:
                    continue
                for r in flatten(parsed):
                    for col, x in zip(out, (f, n, *r), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.string()) for c in out[2:])], names=["file", "line", "path", "kind", "call_id", "tool", "command", "text"])

    return lines.select("file", F.col("line").cast("bigint"), "value").mapInArrow(run, FIELDS)


def calls_with_outputs(flat: DataFrame) -> DataFrame:
    """(file, call_id, tool, command, output): within a file; of a repeated call id the last call."""
    last = Window.partitionBy("file", "call_id").orderBy(F.desc("line"), F.desc("path"))
    calls = flat.where("kind = 'call' and call_id is not null").withColumn("r", F.row_number().over(last)).where("r = 1").select("file", "call_id", "tool", "command")
    outs = flat.where("kind = 'output' and text is not null").select("file", "call_id", F.col("text").alias("output"))
    return calls.join(outs, ["file", "call_id"])


def scenario(path: Column, body: Column, command: Column) -> Column:
    """What a large payload is: the first rule that holds, on its place, its first 600 characters and its command."""
    p, t, c = F.lower(T.text(path)), F.lower(F.substring(T.text(body), 1, 600)), F.lower(T.text(command))
    has = lambda col, *xs: _any(col, xs)
    starts = lambda col, *xs: _any(col, xs, "startswith")
    numbered = F.size(F.filter(F.slice(F.split(T.text(body), "\n"), 1, 30), lambda s: s.rlike(r"^\s*[0-9]+[\t ]"))) >= 5
    # The rules, in their order.
    rules = [
        (has(p, "base_instructions", "developer_instructions", "skill_listing") | has(t, "# desired oververbosity", "you are codex", "base directory for this skill:", "# update config skill", "project mika", "you output only a thread title"), "bootstrap_prompt"),
        (has(p, "signature"), "signature_blob"),
        (starts(t, "data:image/", "/9j/") | has(p, "image_url", "/source/data", "/file/base64"), "image_blob"),
        (has(t, "documentation index", "llms.txt", "use this file to discover all available pages"), "documentation_blob"),
        (has(t, '<div id="app"', "<!doctype html", ".vitepress/dist/", "diagramcode") | has(p, "rawsvg"), "build_artifact_blob"),
        (has(p, "/payload/result/ok/content") & starts(t, '{"issues"', '{"repositories"', '{"data"'), "connector_json_blob"),
        ((p == "output") & has(t, ' output: {"') & has(t, '"issues"', '"repositories"', '"data"'), "connector_json_blob"),
        (starts(t, '{"data":') & has(t, '"enabled"', '"authenticated"', '"loginurl"'), "connector_json_blob"),
        (has(p, "/payload/input") & has(t, "*** begin patch", "*** update file", "*** add file"), "patch_blob"),
        (has(t, "=== task detail ===", "=== task artifacts ===", "context bundle") | has(p, "task_artifact", "task_detail"), "task_context_blob"),
        (has(t, "litellm proxy:", "---log snapshot---", "=== homolog start ===", "/.local/share/opencode/log/", "defaulted container", "select-string :", "service=llm") | starts(t, "error 20"), "agent_log_blob"),
        (has(t, '"hookspecificoutput"', "permissiondecision") | has(p, "hook_success"), "hook_metadata"),
        (has(t, '"input_schema"', '"tool"', "mcp"), "tool_schema"),
        (has(c, "git diff") | has(t, "diff --git ", "@@"), "diff_dump"),
        (starts(t, "grep:"), "large_command_output"),
        (has(t, "terraform", "refreshing state", "module."), "large_command_output"),
        (has(c, "test") | has(t, "running ", "test result:", "turbo run test", "failed"), "test_log"),
        (has(c, "kubectl", "git ", "npm ", "pnpm ", "cargo ", "node ", "tree", "gh run") | has(p, "function_call_output", "tool_result"), "large_command_output"),
        (numbered | has(c, "read"), "full_read"),
    ]
    out = F.lit("unknown_large")
    for test, name in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def _any(col: Column, parts, how: str = "contains") -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | getattr(col, how)(x)
    return out


def large_payloads(df: DataFrame, text_col: str, path: Column, command: Column, least_bytes: int, limit: int) -> DataFrame:
    """The `limit` largest texts of at least so many bytes, with scenario, bytes and tokens."""
    big = df.withColumn("bytes", F.octet_length(text_col).cast("bigint")).where(F.col("bytes") >= least_bytes)
    return big.withColumn("tokens", T.tokens(text_col)).withColumn("scenario", scenario(path, F.col(text_col), command)).orderBy(F.desc("bytes"), *df.columns[:2]).limit(limit)


def scenario_summary(findings: DataFrame) -> DataFrame:
    """By scenario, of the findings that the limit left."""
    return findings.groupBy("scenario").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"))


def environment_facts(calls: DataFrame, least: int = 2) -> DataFrame:
    """calls (session, command, output), sessions in order of age: tools that were missing in `least` sessions and not found working since, with the form that worked most."""
    words = F.filter(F.split(F.trim("command"), r"\s+"), lambda w: ~w.rlike(r"^[A-Za-z0-9_]+="))
    head = F.regexp_extract(F.element_at(words, 1), r"[^/\\]*$", 0)
    missing = F.flatten(F.transform(T.lines("output"), lambda s: F.array(F.coalesce(*[F.when(F.regexp_extract(s, p, 1) != "", F.regexp_extract(s, p, 1)) for p in (r"command not found:\s+(\S+)", r"([^\s:'\"]+):\s+(?:command\s+)?not found\s*$", r"'([^']+)' is not recognized")]))))
    rows_ = calls.where("size(split(trim(command), ' ')) > 0").select("session", head.alias("head"), words.alias("words"), F.array_compact(missing).alias("missing"), T.has_environment_error("output").alias("bad"))
    failed = rows_.where(F.array_contains("missing", F.col("head"))).groupBy(F.col("head").alias("tool")).agg(F.countDistinct("session").alias("failed_sessions"), F.max("session").alias("last_failed"))
    good = rows_.where("not bad")
    bare = good.groupBy(F.col("head").alias("tool")).agg(F.max("session").alias("ok"))
    runner = F.when(F.element_at("words", 1).rlike("^(python3?|py)$") & (F.get("words", F.lit(1)) == "-m"), 2).when(F.element_at("words", 1).isin("npx", "uvx", "bunx", "yarn"), 1).when(F.element_at("words", 1).isin("uv", "poetry", "pipenv", "pdm", "hatch", "bundle"), 2)
    forms = good.withColumn("k", runner).where("k is not null").select("session", F.get("words", F.col("k")).alias("tool"), F.array_join(F.slice("words", F.lit(1), F.col("k") + 1), " ").alias("form")).where("tool is not null")
    forms = forms.groupBy("tool", "form").agg(F.countDistinct("session").alias("n"))
    best = forms.groupBy("tool").agg(F.max(F.struct("n", (-F.length("form")).alias("l"), "form")).alias("b")).select("tool", F.col("b.form").alias("working_form"), F.col("b.n").alias("worked_sessions"))
    facts = failed.join(bare, "tool", "left").where((F.col("failed_sessions") >= least) & ~F.coalesce(F.col("ok") > F.col("last_failed"), F.lit(False)))
    return facts.join(best, "tool", "left").select("tool", "failed_sessions", "working_form", F.coalesce("worked_sessions", F.lit(0)).alias("worked_sessions"))
