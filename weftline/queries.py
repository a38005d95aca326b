"""Registered queries: name -> (query over (spark, sf_dir), oracle SQL or None). Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import chunks, events, filters, graph, lines, prompts, reports, rules, transcripts, usage
from weftline.plans.inputs import EVENT_LOG, TRADE, USAGE, mapped, oracle, table
from weftline.sources import files

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def docs(spark, d):
    return table(spark, d, "documents")


def log(spark, d):
    return mapped(spark, d, EVENT_LOG)


def trade(spark, d):
    return mapped(spark, d, TRADE)


def records(spark, d):
    return mapped(spark, d, USAGE)


EV = f"WITH ev0 AS ({oracle(EVENT_LOG)}), ev AS (SELECT * FROM ev0 WHERE NOT (phase = 'pre' AND action = 'intercepted' AND saved_tokens = 0 AND original_estimate = 0 AND actual_tokens = 0 AND command <> '' AND reason = 'recording capture'))"
LN = """WITH l AS (SELECT id, unnest(ls) AS line, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS pos FROM (
  SELECT doc_id AS id, string_split(CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls FROM documents WHERE coalesce(text, '') <> ''))"""
E = f"WITH RECURSIVE e AS ({oracle(TRADE)})"
_PRICES = ", ".join(f"({i}, '{m}', {a}, {b}, {c}, {d})" for i, (m, a, b, c, d) in enumerate(events.PRICES))
US = f"""WITH p(o, name, i, ou, r, w) AS (VALUES {_PRICES}), u AS ({oracle(USAGE)}),
tier AS (SELECT model, p.*, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN model = name THEN 0 WHEN starts_with(model, name) THEN 1 ELSE 2 END, o) AS k
  FROM (SELECT DISTINCT model FROM u) m JOIN p ON model = name OR starts_with(model, name) OR starts_with(model, regexp_extract(name, '^[^-]+-[^-]+'))),
c AS (SELECT u.*, input + output + cache_read + cache_write AS tokens, coalesce(logged_cost, coalesce((input * i + output * ou + cache_read * r + (cache_write - least(cache_write_1h, cache_write)) * w
  + least(cache_write_1h, cache_write) * i * 2.0::DOUBLE) / 1e6::DOUBLE, 0)) AS cost_usd FROM u LEFT JOIN tier ON u.model = tier.model AND k = 1)"""
_SUMS = "CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost_usd) + 1e-9::DOUBLE, 6) AS cost_usd"


# ---- text and lines -------------------------------------------------------------------------------------------


@query("token_stats_by_lang", "SELECT lang, count(*) AS n_docs, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def _(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(T.tokens("text")).alias("tokens"))


@query("content_hash", "SELECT doc_id, left(sha256(coalesce(text, '')), 16) AS hash FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.content_hash("text").alias("hash"))


@query("line_model", f"{LN} SELECT id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM l GROUP BY id")
def _(spark, d):
    return lines.explode_lines(docs(spark, d), "doc_id").groupBy("id").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("chars"), F.sum(F.octet_length("line")).alias("bytes"))


@query(
    "head_tail_lines",
    f"""{LN}, n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM l)
    SELECT id, pos, CASE WHEN n > 5 AND pos = 4 AND pos <= n - 2 THEN '[... ' || (n - 5) || ' lines omitted ...]' ELSE line END AS line FROM n WHERE n <= 5 OR pos <= 4 OR pos > n - 2""",
)
def _(spark, d):
    return lines.apply(docs(spark, d), "doc_id", lines.head_tail(3, 2))


@query(
    "failure_first_lines",
    f"""{LN} SELECT id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN regexp_matches(line, '(?i)error|fail|fatal|panic|exception|denied|traceback|cannot|unable') THEN 0 ELSE 1 END, pos) AS r FROM l) WHERE r <= 10""",
)
def _(spark, d):
    return lines.apply(docs(spark, d), "doc_id", lines.failure_first(10))


@query(
    "category_caps",
    f"""{LN}, c AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z]') THEN 0 WHEN contains(line, '.') THEN 1 END AS c FROM l),
    k AS (SELECT *, row_number() OVER (PARTITION BY id, c ORDER BY pos) AS k FROM c) SELECT id, pos, line FROM k WHERE c IS NULL OR k <= CASE c WHEN 0 THEN 3 ELSE 2 END""",
)
def _(spark, d):
    return lines.apply(docs(spark, d), "doc_id", lines.category_caps([("^[A-Z]", 3), (r"\.", 2)]))


@query(
    "block_caps",
    f"""{LN}, m AS (SELECT *, CASE WHEN regexp_matches(line, '^(The|And|Of|Is)') THEN 1 WHEN trim(line) = '' THEN 0 END AS mark FROM l),
    o AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS op, sum(coalesce(mark, 0)) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS b FROM m),
    k AS (SELECT *, row_number() OVER (PARTITION BY id, b, op ORDER BY pos) AS k FROM o) SELECT id, pos, line FROM k WHERE coalesce(op, 0) = 0 OR k <= 2""",
)
def _(spark, d):
    return lines.apply(docs(spark, d), "doc_id", lines.block_caps("^(The|And|Of|Is)", r"^\s*$", 2))


@query(
    "line_runs",
    f"""{LN}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY id, line ORDER BY pos) AS g FROM l),
    s AS (SELECT *, count(*) OVER (PARTITION BY id, line, g) AS n, row_number() OVER (PARTITION BY id, line, g ORDER BY pos) AS k FROM i)
    SELECT id, pos, line, CAST(CASE WHEN n < 3 THEN 1 ELSE n END AS BIGINT) AS n FROM s WHERE n < 3 OR k = 1""",
)
def _(spark, d):
    return lines.apply(docs(spark, d), "doc_id", lines.runs())


@query(
    "token_budget_cut",
    f"""{LN}, t AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, CAST(ceil(length(line) / 4.0) AS BIGINT) AS tok, trim(line) AS t FROM l),
    h AS (SELECT *, (starts_with(t, 'error') OR starts_with(t, 'warning') OR starts_with(t, 'FAIL') OR starts_with(t, 'panic') OR contains(t, 'error[') OR contains(t, 'warning[') OR pos <= n // 4 OR pos > (n * 3) // 4) AS high FROM t),
    o AS (SELECT *, sum(tok) OVER (PARTITION BY id, high ORDER BY pos ROWS UNBOUNDED PRECEDING) AS own FROM h),
    s AS (SELECT *, coalesce(max(CASE WHEN high AND own <= 200 THEN own END) OVER (PARTITION BY id), 0) AS spent FROM o)
    SELECT id, pos, line FROM s WHERE CASE WHEN high THEN own <= 200 ELSE own + spent <= 200 END""",
)
def _(spark, d):
    return lines.apply(docs(spark, d), "doc_id", lines.token_budget(200))


@query(
    "repeated_block_agreement",
    f"""{LN}, o AS (SELECT *, trim(line) <> '' AND coalesce(trim(lag(line) OVER w) = '', true) AS opens FROM l WINDOW w AS (PARTITION BY id ORDER BY pos)),
    b AS (SELECT id, CAST(sum(opens::INT) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS block, pos, line FROM o),
    g AS (SELECT id, block, list(line ORDER BY pos) AS body FROM b WHERE trim(line) <> '' GROUP BY id, block), p AS (SELECT *, lag(body) OVER (PARTITION BY id ORDER BY block) AS prior FROM g),
    a AS (SELECT id, block, CAST(len(body) AS INTEGER) AS n_lines, CASE WHEN len(body) = len(prior) THEN len(list_filter(list_zip(body, prior), lambda x: x[1] = x[2]))::DOUBLE / len(body) ELSE 0.0 END AS agreement FROM p)
    SELECT id, block, n_lines, round(agreement, 9) AS agreement, agreement >= 0.8 AND n_lines >= 2 AS similar FROM a""",
)
def _(spark, d):
    return lines.apply(docs(spark, d), "doc_id", lines.similar_blocks()).withColumn("agreement", F.round("agreement", 9))


@query(
    "density_filter",
    f"""{LN}, e AS (SELECT id, pos, round(-sum(q / n * log2(q / n)), 9) AS bits FROM (SELECT id, pos, ch, count(*)::DOUBLE AS q, max(n) AS n FROM (SELECT id, pos, unnest(string_split(line, '')) AS ch, length(line)::DOUBLE AS n FROM l WHERE line <> '') GROUP BY id, pos, ch) GROUP BY id, pos),
    t AS (SELECT l.id, l.pos, line, CAST(ceil(length(line) / 4.0) AS BIGINT) AS tok, strlen(line) AS b, coalesce(bits, 0) + 0.0 AS bits FROM l LEFT JOIN e ON l.id = e.id AND l.pos = e.pos),
    w AS (SELECT *, sum(tok) OVER (PARTITION BY id) AS al, coalesce(sum(tok) OVER (PARTITION BY id ORDER BY bits DESC, b DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
    SELECT id, pos, line FROM w WHERE before < floor(al * 0.3)""",
)
def _(spark, d):
    return lines.apply(docs(spark, d), "doc_id", lines.density(0.3))


@query(
    "redaction",
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)://[^/\s@]+@', '://[REDACTED]@', 'g'), '(?i)(authorization|x-api-key|api-key)\s*:\s*[^\r\n"'']+', '[REDACTED]', 'g'),
    '(?i)\bbearer\s+[A-Za-z0-9._\-]+', '[REDACTED]', 'g'), '(?i)\b[A-Za-z0-9_]*(token|api[_-]?key|secret|password|passwd|pwd)(?:_[A-Za-z0-9_]*)?\s*[=:]\s*[^\s&"'']+', '[REDACTED]', 'g'),
    '(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)', '[REDACTED]', 'g')) AS digest FROM documents""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.redact_credentials("text").cast("binary"), 256).alias("digest"))


@query("secret_redaction_counts", r"""SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '(?i)(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key)\s*[:=]\s*[''"]?[A-Za-z0-9._\-/+]{8,}')) AS redacted FROM documents GROUP BY lang""")
def _(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count_if(T.redact_secrets("text") != T.text("text")).alias("redacted"))


@query("failure_signals", "SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '(?i)error|fail|fatal|panic|exception|denied|traceback|cannot|unable')) AS n FROM documents GROUP BY lang")
def _(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count_if(T.is_failure_line("text")).alias("n"))


@query(
    "failure_signal_documents",
    r"""SELECT doc_id, regexp_matches(coalesce(text, ''), '(?m)^\s*(?:(?i:error|fatal|panic|panicked|exception|stderr|err)\b|FAILED\b|FAIL\b|---\s*FAIL\b|Traceback \(most recent call last\)|Unhandled exception|Exception in thread\b)|^\S*:\s*(?i:error|fatal|panic):|\b(?i:failed with exit code|exited with status|exited with code|exit status|exit code|exit)\b\s*[:=]?\s*[1-9]\d*|\b(?:SIGSEGV|SIGABRT|SIGILL|SIGBUS|AssertionError|NullPointerException|Segmentation fault|(?i:Command failed|command not found|failed to compile))\b|\[(?i:error|fatal|panic|failed|fail)\]|level=(?i:error|fatal|panic)|\b(?i:err)(?:!|:)') AS failed,
    regexp_matches(coalesce(text, ''), '(?i)error|fail|fatal|panic|exception|denied|traceback|cannot|unable') AS told FROM documents""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", T.has_failure_signal("text").alias("failed"), T.is_failure_line("text").alias("told"))


@query(
    "token_tree",
    """WITH t AS (SELECT lang || '/' || source AS path, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tok, lang FROM documents WHERE text IS NOT NULL)
    SELECT prefix, CAST(sum(tok) AS BIGINT) AS tokens, count(*) AS n FROM (SELECT '' AS prefix, tok FROM t UNION ALL SELECT lang, tok FROM t UNION ALL SELECT path, tok FROM t) GROUP BY prefix""",
)
def _(spark, d):
    rows = docs(spark, d).where("text is not null").withColumn("tok", T.tokens("text")).withColumn("parts", F.array("lang", "source"))
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))
    base = rows.groupBy("parts").agg(F.sum("tok").alias("tok"), F.count("*").alias("n"))  # summed by path before prefixes multiply it
    return base.select(F.explode(prefixes).alias("prefix"), "tok", "n").groupBy("prefix").agg(F.sum("tok").alias("tokens"), F.sum("n").alias("n"))


@query(
    "token_map",
    """SELECT source, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens, round(100.0 * sum(ceil(length(coalesce(text, '')) / 4.0)) / sum(sum(ceil(length(coalesce(text, '')) / 4.0))) OVER (), 6) AS pct
    FROM documents GROUP BY source ORDER BY tokens DESC, source LIMIT 10""",
)
def _(spark, d):
    by = docs(spark, d).groupBy("source").agg(F.sum(T.tokens("text")).alias("tokens"))
    total = by.agg(F.sum("tokens").alias("all"))
    return by.join(F.broadcast(total)).select("source", "tokens", F.round(F.col("tokens") * 100.0 / F.col("all"), 6).alias("pct")).orderBy(F.desc("tokens"), "source").limit(10)


@query("chunks_by_document")
def _(spark, d):
    return chunks.chunks(docs(spark, d), "doc_id").groupBy("id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("largest"), F.min("start_line").alias("first"), F.max("end_line").alias("last"))


@query("filtered_outputs")
def _(spark, d):
    rows = docs(spark, d).withColumn("command", F.concat(F.lit("cd /x && LC_ALL=C cat file"), F.col("doc_id").cast("string")))
    out = filters.apply_to(rows, "command", "text", keep=["doc_id", "lang"])
    return out.groupBy("lang", "filter").agg(F.count("*").alias("n"), F.sum(T.tokens("reduced")).alias("tokens"))


@query(
    "filter_match",
    """WITH c AS (SELECT DISTINCT event_type || ' ' || CAST(user_id % 5 AS VARCHAR) AS command FROM events), f(name, pattern, rank) AS (VALUES ('any', '^\\w+', 1), ('click', '^click', 1), ('view-1', '^view 1$', 0), ('err', 'err', 1)),
    m AS (SELECT command, name, row_number() OVER (PARTITION BY command ORDER BY rank, length(pattern) DESC, name) AS r FROM c JOIN f ON regexp_matches(command, pattern)) SELECT command, name FROM m WHERE r = 1""".replace("\\\\", "\\"),
)
def _(spark, d):
    defs = spark.createDataFrame([("any", r"^\w+", 1), ("click", "^click", 1), ("view-1", "^view 1$", 0), ("err", "err", 1)], "name string, pattern string, rank int")
    return filters.match_table(table(spark, d, "events"), defs, F.concat("event_type", F.lit(" "), (F.col("user_id") % 5).cast("string")))


# ---- rule scans -------------------------------------------------------------------------------------------------


@query(
    "secret_scan",
    rf"""{LN}, m AS (SELECT id, pos, unnest(regexp_extract_all(line, '(?i)(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?token|client[_-]?secret|private[_-]?key)["'' ]?\s*[:=]\s*["'']?([A-Za-z0-9+/_-]{{16,}})', 1)) AS value FROM l),
    c AS (SELECT DISTINCT id, pos, value FROM m),
    b AS (SELECT id, pos, value, -sum(q / length(value) * log2(q / length(value))) AS bits FROM (SELECT id, pos, value, ch, count(*)::DOUBLE AS q FROM (SELECT *, unnest(string_split(value, '')) AS ch FROM c) GROUP BY ALL) GROUP BY id, pos, value)
    SELECT id, pos, 'generic-secret-assignment' AS rule, left(value, 4) || '…' AS masked, round(bits, 6) AS bits FROM b WHERE round(bits, 6) >= 3.5""",
)
def _(spark, d):
    return rules.secrets(docs(spark, d), "doc_id")


_EG = """WITH h AS (SELECT DISTINCT page_id AS id, rule, regexp_replace(lower(regexp_extract(url, pat, 1)), '^www\\.', '') AS host FROM pages, (VALUES ('https-url', 'https://(?:[^/@\\s"<>]+@)?([A-Za-z0-9.-]+)'), ('http-url', 'http://(?:[^/@\\s"<>]+@)?([A-Za-z0-9.-]+)')) t(rule, pat) WHERE regexp_matches(url, pat))"""


@query("egress_scan", f"{_EG} SELECT id, CAST(1 AS BIGINT) AS pos, rule, host FROM h")
def _(spark, d):
    return rules.egress(table(spark, d, "pages"), "page_id", "url")


@query("egress_by_host", f"{_EG} SELECT host, count(*) AS n, count(DISTINCT id) AS pages FROM h GROUP BY host")
def _(spark, d):
    return rules.egress(table(spark, d, "pages"), "page_id", "url").groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("id").alias("pages"))


@query("host_verdicts", f"{_EG} SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN ends_with(host, '.example.org') OR host = 'example.org' THEN 'dangerous' WHEN ends_with(host, '.example.com') OR host = 'example.com' THEN 'safe' ELSE 'unknown' END AS verdict FROM h) GROUP BY verdict")
def _(spark, d):
    known = spark.createDataFrame([("example.org", "dangerous"), ("example.org", "safe"), ("example.com", "safe")], "host string, verdict string")
    return rules.verdicts(rules.egress(table(spark, d, "pages"), "page_id", "url"), known).groupBy("verdict").agg(F.count("*").alias("n"))


# ---- event log --------------------------------------------------------------------------------------------------

_GAIN = """count(*) AS total_calls, count(*) FILTER (WHERE action = 'intercepted') AS intercepted, count(*) FILTER (WHERE action = 'pass') AS passed, count(*) FILTER (WHERE action = 'bypassed') AS bypassed, count(*) FILTER (WHERE action = 'holdout') AS holdout,
CAST(sum(CASE WHEN action = 'intercepted' THEN saved_tokens ELSE 0 END) AS BIGINT) AS tokens_saved, CAST(sum(CASE WHEN action IN ('intercepted', 'pass') THEN actual_tokens ELSE 0 END) AS BIGINT) AS tokens_used,
CAST(sum(CASE WHEN action IN ('intercepted', 'pass') THEN original_estimate ELSE 0 END) AS BIGINT) AS tokens_original, count(*) FILTER (WHERE action = 'intercepted' AND command = '') AS indexed_queries"""


@query("gain", f"{EV}, g AS (SELECT {_GAIN} FROM ev) SELECT *, round(CASE WHEN tokens_original > 0 THEN tokens_saved::DOUBLE / tokens_original * 100 ELSE 0 END, 6) AS pct_saved, (intercepted + bypassed) > 0 AND bypassed * 10 >= intercepted + bypassed AS bypass_warning FROM g")
def _(spark, d):
    return events.gain(log(spark, d))


@query("gain_by_project", f"{EV}, g AS (SELECT project, {_GAIN} FROM ev GROUP BY project) SELECT *, round(CASE WHEN tokens_original > 0 THEN tokens_saved::DOUBLE / tokens_original * 100 ELSE 0 END, 6) AS pct_saved, (intercepted + bypassed) > 0 AND bypassed * 10 >= intercepted + bypassed AS bypass_warning FROM g")
def _(spark, d):
    return events.gain(log(spark, d), ["project"])


_LABEL = "CASE command WHEN 'git status --short' THEN 'git status' WHEN 'cargo test -p core | tail' THEN 'cargo test' WHEN 'npm run build && ls' THEN 'npm run build' WHEN 'X=1 make' THEN 'X=1' WHEN 'kubectl get pods -A' THEN 'kubectl get pods' END"


@query(
    "gain_by_dimension",
    f"{EV}, i AS (SELECT * FROM ev WHERE action = 'intercepted') SELECT 'tool' AS dimension, tool AS key, count(*) AS n, CAST(sum(saved_tokens) AS BIGINT) AS saved FROM i GROUP BY tool UNION ALL SELECT 'phase', phase, count(*), CAST(sum(saved_tokens) AS BIGINT) FROM i GROUP BY phase UNION ALL SELECT 'command', {_LABEL}, count(*), CAST(sum(saved_tokens) AS BIGINT) FROM i WHERE command <> '' GROUP BY 2",
)
def _(spark, d):
    return events.by_dimensions(log(spark, d))


@query("gain_cost_rows", f"{EV}, p(o, model, i, a, b, c) AS (VALUES {_PRICES}), g AS (SELECT {_GAIN} FROM ev) SELECT model, round(tokens_original * (i::DOUBLE / 1e6), 9) AS without_usd, round(tokens_used * (i::DOUBLE / 1e6), 9) AS with_usd, round((tokens_original - tokens_used) * (i::DOUBLE / 1e6), 9) AS saved_usd FROM g, p")
def _(spark, d):
    return events.cost_rows(log(spark, d))


@query("project_rollup", f"{EV} SELECT CASE WHEN grouping(project) = 1 THEN 'ALL' ELSE project END AS project, CAST(sum(CASE WHEN action = 'intercepted' THEN saved_tokens ELSE 0 END) AS BIGINT) AS tokens_saved, count(*) AS total_calls, count(*) FILTER (WHERE action = 'intercepted') AS intercepted FROM ev GROUP BY ROLLUP (project)")
def _(spark, d):
    return events.project_rollup(log(spark, d))


@query("command_stats", f"{EV} SELECT base, count(*) AS calls, CAST(sum(original_estimate) AS BIGINT) AS original, CAST(sum(saved_tokens) AS BIGINT) AS saved, count(DISTINCT command) AS commands, CAST(sum(original_estimate) - sum(saved_tokens) AS BIGINT) AS waste FROM (SELECT *, regexp_extract(command, '^\\S+') AS base FROM ev WHERE command <> '') GROUP BY base ORDER BY waste DESC, base LIMIT 20")
def _(spark, d):
    return events.command_stats(log(spark, d))


@query(
    "session_stats",
    f"""{EV}, o AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY project ORDER BY ts, event_id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY project ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session, CASE WHEN command = '' THEN input_preview ELSE command END AS subject FROM o),
    q AS (SELECT project, session, tool, subject, count(*) AS n FROM s GROUP BY ALL), z AS (SELECT project, session, sum(n) AS calls, sum(n - 1) AS again FROM q GROUP BY ALL)
    SELECT project, count(*) AS sessions, round(avg(calls), 6) AS calls_per_session, CAST(max(calls) AS BIGINT) AS calls_max, CAST(sum(again) AS BIGINT) AS re_requests FROM z GROUP BY project""",
)
def _(spark, d):
    return events.session_stats(log(spark, d))


@query(
    "repeated_outputs",
    f"""WITH ev AS ({oracle(EVENT_LOG)}), p AS (SELECT event_id, lag(event_id) OVER w AS earlier, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT) AS age FROM ev WHERE command <> '' AND actual_tokens >= 200 WINDOW w AS (PARTITION BY project, command, digest ORDER BY ts, event_id))
    SELECT * FROM p WHERE age <= 3600""",
)
def _(spark, d):
    return events.repeated_outputs(log(spark, d))


@query(
    "failure_streaks",
    f"""WITH ev AS ({oracle(EVENT_LOG)}), o AS (SELECT *, CASE WHEN failed AND lag(failed) OVER w AND signature = lag(signature) OVER w AND floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) <= 86400 THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY project, command ORDER BY ts, event_id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY project, command ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM o),
    n AS (SELECT event_id, project, command, failed, row_number() OVER v AS n, CAST(floor(epoch(ts)) - floor(epoch(first(ts) OVER v)) AS BIGINT) AS since FROM s WINDOW v AS (PARTITION BY project, command, streak ORDER BY ts, event_id))
    SELECT event_id, project, command, n, since FROM n WHERE failed AND n % 3 = 0""",
)
def _(spark, d):
    return events.failure_streaks(log(spark, d), ttl=86_400)


# ---- usage ------------------------------------------------------------------------------------------------------

_KEYS = {"day": "strftime(ts, '%Y-%m-%d')", "week": "strftime(ts, '%G-W%V')", "month": "strftime(ts, '%Y-%m')", "session": "session", "model": "model", "project": "project"}
for _by, _sql in _KEYS.items():
    QUERIES[f"usage_by_{_by}"] = (
        lambda spark, d, by=_by: usage.rollup(records(spark, d), by),
        f"{US} SELECT CASE WHEN grouping(k) = 1 THEN 'TOTAL' ELSE k END AS key, {_SUMS} FROM (SELECT *, {_sql} AS k FROM c) GROUP BY ROLLUP (k)",
    )


@query("usage_forecast", f"{US}, m AS (SELECT coalesce(sum(cost_usd), 0) AS s FROM c WHERE date_trunc('month', ts) = DATE '1996-03-01' AND CAST(ts AS DATE) <= DATE '1996-03-17') SELECT round(s, 4) AS spent_usd, round(s / 17 * 31, 4) AS forecast_usd FROM m")
def _(spark, d):
    return usage.month_forecast(records(spark, d), F.lit("1996-03-17").cast("date"))


@query("spend_mix", f"{US} SELECT CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, round(sum(cost_usd), 4) AS cost_usd, round(sum(cost_usd) / (sum(input) + 5.0 * sum(output) + 1.25 * sum(cache_write) + 0.1 * sum(cache_read)) * 1e6::DOUBLE, 6) AS usd_per_million_units FROM c")
def _(spark, d):
    return usage.spend_mix(records(spark, d))


@query(
    "usage_blocks",
    f"""WITH RECURSIVE {US[5:]}, h AS (SELECT project, date_trunc('hour', ts) AS hour, sum(tokens) AS tokens, sum(cost_usd) AS cost_usd, count(*) AS n FROM c GROUP BY ALL),
    s AS (SELECT project, min(hour) AS start FROM h GROUP BY project UNION SELECT s.project, (SELECT min(hour) FROM h WHERE h.project = s.project AND h.hour >= s.start + INTERVAL 5 HOURS) FROM s WHERE s.start IS NOT NULL)
    SELECT h.project, max(s.start) AS start, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost_usd) + 1e-9::DOUBLE, 6) AS cost_usd, CAST(sum(n) AS BIGINT) AS records FROM h JOIN s ON h.project = s.project AND h.hour >= s.start AND h.hour < s.start + INTERVAL 5 HOURS GROUP BY h.project, s.start""",
)
def _(spark, d):
    return usage.blocks(records(spark, d))


# ---- graph ------------------------------------------------------------------------------------------------------


@query("graph_degrees", f"{E}, n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM n GROUP BY node")
def _(spark, d):
    return graph.degrees(trade(spark, d))


@query("graph_hotspots", f"{E}, n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM n GROUP BY node ORDER BY degree DESC, node LIMIT 5")
def _(spark, d):
    return graph.hotspots(trade(spark, d), 5)


@query("graph_callers", f"{E} SELECT s.n_name AS caller, t.n_name AS callee FROM e JOIN nation s ON e.src = s.n_nationkey JOIN nation t ON e.dst = t.n_nationkey WHERE e.dst = (SELECT min(dst) FROM e)")
def _(spark, d):
    e, n = trade(spark, d), table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("caller")), n.select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("callee"))
    return e.join(e.agg(F.min("dst").alias("dst")), "dst").join(a, "src").join(b, "dst").select("caller", "callee")


@query("graph_flow", f"{E}, r(node, distance) AS (SELECT 0, 0 UNION SELECT e.dst, distance + 1 FROM r JOIN e ON e.src = r.node WHERE distance < 3) SELECT node, CAST(min(distance) AS BIGINT) AS distance FROM r GROUP BY node")
def _(spark, d):
    return graph.reach(trade(spark, d), spark.range(1).select(F.col("id").cast("int").alias("node")), 3)


@query(
    "graph_impact",
    f"{E}, seed AS (SELECT min(dst) AS s FROM e), r(node, distance) AS (SELECT s, 0 FROM seed UNION SELECT e.src, distance + 1 FROM r JOIN e ON e.dst = r.node WHERE distance < 2), m AS (SELECT node, min(distance) AS distance FROM r GROUP BY node) SELECT m.node, CAST(m.distance AS BIGINT) AS distance, (SELECT count(*) FROM e WHERE dst = m.node) AS in_degree FROM m WHERE distance > 0 ORDER BY distance, in_degree DESC, node LIMIT 12",
)
def _(spark, d):
    e = trade(spark, d)
    return graph.blast(e, e.agg(F.min("dst").alias("node")), 2, 12)


@query("graph_dependents", f"{E}, c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT dst AS node, count(*) AS n FROM c GROUP BY dst")
def _(spark, d):
    return graph.dependents(trade(spark, d))


@query("graph_cycles", f"{E}, c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT a.src AS node, min(a.dst) AS component FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")
def _(spark, d):
    return graph.cycles(trade(spark, d))


@query(
    "graph_pagerank",
    f"""{E}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), k AS (SELECT count(*)::DOUBLE AS n FROM n), o AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM e),
    loose AS (SELECT node FROM n WHERE node NOT IN (SELECT src FROM e)),
    r(i, node, rank) AS (SELECT 0, node, 1.0::DOUBLE / (SELECT n FROM k) FROM n UNION ALL
      SELECT i + 1, node, 0.15::DOUBLE / (SELECT n FROM k) + 0.85::DOUBLE * (got + lost / (SELECT n FROM k)) FROM (
        SELECT p.i AS i, n.node AS node, coalesce(sum(p.rank * o.share) FILTER (WHERE o.dst = n.node), 0) AS got, coalesce(max(p.lost), 0) AS lost
        FROM n, (SELECT r.*, sum(CASE WHEN r.node IN (SELECT node FROM loose) THEN r.rank ELSE 0 END) OVER () AS lost FROM r WHERE i < 20) p LEFT JOIN o ON o.src = p.node GROUP BY p.i, n.node))
    SELECT node, round(rank, 6) AS rank FROM r WHERE i = 20""",
)
def _(spark, d):
    return graph.pagerank(trade(spark, d)).select("node", F.round("rank", 6).alias("rank"))


@query("graph_modules")
def _(spark, d):
    e = trade(spark, d)
    return graph.modularity_links(e, graph.modules(e))


@query(
    "blast_ranges",
    """WITH r AS (SELECT o_orderkey AS path, 2 AS first, 3 AS last FROM orders WHERE o_orderstatus = 'F') SELECT l_orderkey AS path, l_linenumber AS start, l_linenumber + 1 AS "end" FROM lineitem SEMI JOIN r ON l_orderkey = path AND l_linenumber <= last AND l_linenumber + 1 >= first""",
)
def _(spark, d):
    ranges = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"), F.lit(2).alias("first"), F.lit(3).alias("last"))
    spans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"))
    return graph.overlaps(ranges, spans)


# ---- transcripts and sources ------------------------------------------------------------------------------------


@query("large_payloads", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents WHERE strlen(text) >= 4000 ORDER BY bytes DESC, doc_id LIMIT 50")
def _(spark, d):
    rows = docs(spark, d).select("doc_id", "text")
    return transcripts.large_payloads(rows, "text", F.lit("output"), F.lit("cat x"), 4000, 50).select("doc_id", "bytes", "tokens")


@query(
    "scenario_summary",
    """WITH t AS (SELECT role, left(lower(text), 600) AS t, strlen(text) AS b, ceil(length(text) / 4.0) AS k, conv_id, turn FROM conversations WHERE strlen(text) >= 200 ORDER BY b DESC, conv_id, turn LIMIT 100)
    SELECT CASE WHEN contains(t, 'mcp') THEN 'tool_schema' WHEN contains(t, '@@') THEN 'diff_dump' WHEN contains(t, 'module.') OR contains(t, 'terraform') THEN 'large_command_output' WHEN role = 'user' THEN 'test_log' WHEN contains(t, 'running ') OR contains(t, 'failed') THEN 'test_log' ELSE 'unknown_large' END AS scenario,
    count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(k) AS BIGINT) AS tokens FROM t GROUP BY 1""",
)
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return transcripts.scenario_summary(transcripts.large_payloads(rows, "text", F.lit("x"), F.when(F.col("role") == "user", "pytest"), 200, 100))


@query(
    "calls_with_outputs",
    "SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn AS VARCHAR) AS call_id, role AS tool, 'show ' || turn AS command, text AS output FROM conversations WHERE text IS NOT NULL",
)
def _(spark, d):
    rows = table(spark, d, "conversations")
    call = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.col("turn").cast("string").alias("id"), F.col("role").alias("name"), F.struct(F.concat(F.lit("show "), F.col("turn").cast("string")).alias("command")).alias("input"))).alias("content")).alias("message")))
    out = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), F.col("turn").cast("string").alias("tool_use_id"), F.col("text").alias("content"))).alias("content")).alias("message")))
    lines_ = rows.select(F.col("conv_id").cast("string").alias("file"), F.posexplode(F.array(call, out)).alias("line", "value"))
    return transcripts.calls_with_outputs(transcripts.rows(lines_))


@query("snapshot_changes", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0")
def _(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), "doc_id", T.content_hash("text").alias("hash"))
    new = rows.where("doc_id % 7 <> 0 or doc_id % 3 = 0").select("path", "hash")
    old = rows.where("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return files.changes(new, old)


@query("upsert_latest", "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'new' ELSE 'old' END AS state FROM customer")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return files.upsert(rows.withColumn("state", F.lit("old")), rows.where("c_nationkey < 5").withColumn("state", F.lit("new")), "c_custkey").select("c_custkey", "state")


@query("generic_reduction")
def _(spark, d):
    from weftline.operators import reduce

    rows = docs(spark, d).withColumn("command", F.when(F.col("doc_id") % 2 == 0, "git log").otherwise("grep -rn x ."))
    return reduce.apply(rows, "command", "text", ["doc_id", "lang"]).groupBy("lang").agg(F.count("*").alias("n"), F.sum("tokens_after").alias("tokens"))


@query("replay_savings")
def _(spark, d):
    rows = table(spark, d, "conversations").withColumn("command", F.when(F.col("role") == "user", "cat notes").otherwise("find ."))
    from weftline.operators import reduce

    out = filters.apply_to(rows, "command", "text", keep=["conv_id", "turn", "role", "text"])
    out = out.select(F.col("role").alias("agent"), "filter", T.tokens("text").alias("raw_tokens"), T.tokens("reduced").alias("tokens_after"))
    return reduce.savings(out)


# ---- retrieval, reports, prompt weight --------------------------------------------------------------------------


@query(
    "retrieval_slice",
    f"""{LN}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k, count(*) OVER (PARTITION BY id) AS n FROM l WHERE pos BETWEEN 2 AND 40 AND regexp_matches(line, '(?i)the|an'))
    SELECT id, pos, CASE WHEN n > 5 AND k = 4 AND k <= n - 2 THEN '[... ' || (n - 5) || ' lines omitted ...]' ELSE pos || ':' || line END AS line FROM k WHERE k <= 3 OR k > n - 2 OR (n > 5 AND k = 4)""",
)
def _(spark, d):
    return lines.apply(docs(spark, d), "doc_id", lines.retrieve(2, 40, "the|an", 3, 2))


@query(
    "uncovered_ranges",
    """WITH s AS (SELECT l_orderkey AS id, l_linenumber * 3 AS a, l_linenumber * 3 + CAST(l_quantity AS BIGINT) % 4 AS b FROM lineitem), p AS (SELECT o_orderkey AS id, unnest(range(1, 26)) AS p FROM orders),
    u AS (SELECT p.id, p, p - row_number() OVER (PARTITION BY p.id ORDER BY p) AS g FROM p ANTI JOIN s ON s.id = p.id AND p.p BETWEEN a AND b)
    SELECT id, CAST(min(p) AS BIGINT) AS start, CAST(max(p) AS BIGINT) AS "end" FROM u GROUP BY id, g""",
)
def _(spark, d):
    spans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 3).alias("start"), (F.col("l_linenumber") * 3 + F.col("l_quantity").cast("bigint") % 4).alias("end"))
    return lines.uncovered(spans, table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(25).cast("bigint").alias("total")))


def _diagram(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return nodes, trade(spark, d).select("src", "dst", F.lit("buys from").alias("reference"))


@query(
    "graph_mermaid",
    f"""{E}, x(section, line) AS (SELECT 0, unnest(['```mermaid', 'graph LR']) UNION ALL SELECT 3, unnest(['    %% trade', '```'])
    UNION ALL SELECT 1, '    N' || n_nationkey || '["' || n_name || '"]' FROM nation WHERE n_nationkey IN (SELECT src FROM e UNION SELECT dst FROM e)
    UNION ALL SELECT DISTINCT 2, '    N' || src || ' -->|"buys from"| N' || dst FROM e) SELECT section, line FROM x""",
)
def _(spark, d):
    return reports.mermaid(*_diagram(spark, d), "trade").select("section", "line")


@query(
    "graph_dot",
    f"""{E}, x(section, line) AS (SELECT 0, unnest(['digraph relations {{', '  label="trade";', '  rankdir=LR;', '  node [shape=box];']) UNION ALL SELECT 3, '}}'
    UNION ALL SELECT 1, '  N' || n_nationkey || ' [label="' || n_name || '"];' FROM nation WHERE n_nationkey IN (SELECT src FROM e UNION SELECT dst FROM e)
    UNION ALL SELECT DISTINCT 2, '  N' || src || ' -> N' || dst || ' [label="buys from"];' FROM e) SELECT section, line FROM x""",
)
def _(spark, d):
    return reports.dot(*_diagram(spark, d), "trade").select("section", "line")


@query(
    "repository_report",
    f"""{E}, c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src),
    n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e),
    s AS (SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, (SELECT count(*) FROM c WHERE dst = n.node) AS dependents FROM n GROUP BY node ORDER BY sum(o + i) DESC, node LIMIT 12),
    h AS (SELECT 'god nodes' AS heading, in_degree + out_degree AS b, * FROM s UNION ALL SELECT 'bottlenecks', in_degree - out_degree, * FROM s WHERE in_degree > out_degree UNION ALL SELECT 'blast leaders', dependents, * FROM s)
    SELECT heading, row_number() OVER (PARTITION BY heading ORDER BY b DESC, node) AS place, node, in_degree, out_degree, dependents FROM h QUALIFY place <= 4""",
)
def _(spark, d):
    return reports.repository(trade(spark, d), 4)


@query(
    "prompt_weight",
    """WITH s AS (SELECT n_name AS agent, count(*) AS servers, CAST(sum(s_suppkey % 30) AS BIGINT) AS tools, CAST(sum(s_suppkey * 37 % 4000) AS BIGINT) AS tool_tokens FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
    c AS (SELECT n_name AS agent, CAST(sum(ceil(length(c_name) / 4.0)) AS BIGINT) AS always_on FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
    b AS (SELECT agent, coalesce(servers, 0) AS servers, coalesce(tools, 0) AS tools, coalesce(tool_tokens, 0) AS tool_tokens, coalesce(always_on, 0) AS always_on FROM s FULL JOIN c USING (agent))
    SELECT *, tool_tokens > 300 OR servers > 3 OR tools > 60 OR always_on > 300 AS warn, concat_ws('; ', CASE WHEN tool_tokens > 300 THEN '~' || tool_tokens || ' tool tokens > 300' END, CASE WHEN servers > 3 THEN servers || ' servers > 3' END,
    CASE WHEN tools > 60 THEN tools || ' tools > 60' END, CASE WHEN always_on > 300 THEN '~' || always_on || ' always-on context tokens > 300' END) AS reasons FROM b""",
)
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("agent"))
    servers = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("k")).select("agent", F.col("s_name").alias("server"), (F.col("s_suppkey") % 30).alias("tools"), (F.col("s_suppkey") * 37 % 4000).alias("tokens"))
    context = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("k")).select("agent", T.tokens("c_name").alias("tokens"))
    return prompts.audit(servers, context, 300, 3, 60).withColumn("reasons", F.array_join("reasons", "; ")).drop("advice")


from weftline import queries_sources, queries_symbols  # noqa: E402

queries_symbols.register_usage(US, EV)
QUERIES |= queries_symbols.QUERIES | queries_sources.QUERIES
