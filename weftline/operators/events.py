"""Event-log analytics: savings, sessions, repeated requests, repeated outputs, failure streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

GAP_SECONDS = 1800
# US dollars for a million tokens (input, output, cache read, cache write), and the model that stands for all.
PRICES = [
    ("claude-haiku-4-5", 1.00, 5.00, 0.10, 1.25),
    ("claude-sonnet-4-6", 3.00, 15.00, 0.30, 3.75),
    ("claude-opus-4-8", 5.00, 25.00, 0.50, 6.25),
    ("claude-fable-5", 10.00, 50.00, 1.00, 12.50),
    ("gpt-5.4-mini", 0.75, 3.00, 0.19, 0.75),
    ("gpt-5.4", 2.50, 10.00, 0.63, 2.50),
    ("gpt-5.5", 5.00, 20.00, 1.25, 5.00),
    ("gemini-3.1-flash-lite", 0.25, 1.00, 0.06, 0.25),
    ("gemini-3.5-flash", 1.50, 6.00, 0.38, 1.50),
    ("gemini-3.1-pro-preview", 2.00, 8.00, 0.50, 2.00),
]


def prices(spark) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_rate double, output_rate double, read_rate double, write_rate double")


def is_handoff() -> Column:
    """A rewrite that only hands the command on: measured elsewhere, so not counted."""
    zero = (F.col("saved_tokens") == 0) & (F.col("original_estimate") == 0) & (F.col("actual_tokens") == 0)
    return (F.col("phase") == "pre") & (F.col("action") == "intercepted") & zero & (F.col("command") != "") & (F.col("reason").startswith("rewrote command to") | (F.col("reason") == "recording capture"))


def effective(log: DataFrame) -> DataFrame:
    return log.where(~is_handoff())


def gain(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts by action, and tokens saved, used and original over measured runs (intercepted or passed)."""
    measured = F.col("action").isin("intercepted", "pass")
    out = effective(log).groupBy(*(keys or [])).agg(
        F.count("*").alias("total_calls"),
        *[F.count_if(F.col("action") == a).alias(n) for a, n in (("intercepted", "intercepted"), ("pass", "passed"), ("bypassed", "bypassed"), ("holdout", "holdout"))],
        F.coalesce(F.sum(F.when(F.col("action") == "intercepted", F.col("saved_tokens"))), F.lit(0)).alias("tokens_saved"),
        F.coalesce(F.sum(F.when(measured, F.col("actual_tokens"))), F.lit(0)).alias("tokens_used"),
        F.coalesce(F.sum(F.when(measured, F.col("original_estimate"))), F.lit(0)).alias("tokens_original"),
        F.count_if((F.col("action") == "intercepted") & (F.col("command") == "")).alias("indexed_queries"),
    )
    pct = F.when(F.col("tokens_original") > 0, F.col("tokens_saved") / F.col("tokens_original") * 100).otherwise(0.0)
    seen = F.col("intercepted") + F.col("bypassed")
    return out.withColumn("pct_saved", F.round(pct, 6)).withColumn("bypass_warning", (seen > 0) & (F.col("bypassed") * 10 >= seen))


def by_dimensions(log: DataFrame) -> DataFrame:
    """Intercepted runs and saved tokens by tool, by phase and by command label, in one pass."""
    hit = effective(log).where("action = 'intercepted'").withColumn("label", F.when(F.col("command") != "", T.command_label("command")))
    sets = hit.groupingSets([["tool"], ["phase"], ["label"]], "tool", "phase", "label").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("saved_tokens").alias("saved"))
    kind = F.when(F.col("g") == 3, "tool").when(F.col("g") == 5, "phase").otherwise("command")
    return sets.select(kind.alias("dimension"), F.coalesce("tool", "phase", "label").alias("key"), "n", "saved").where("key is not null")


def cost_rows(log: DataFrame) -> DataFrame:
    """What the measured tokens cost without and with savings, for each price."""
    g = gain(log).select("tokens_original", "tokens_used")
    rate = F.col("input_rate") / 1e6
    rows = g.join(F.broadcast(prices(log.sparkSession)))  # one row by ten
    return rows.select("model", F.round(F.col("tokens_original") * rate, 9).alias("without_usd"), F.round(F.col("tokens_used") * rate, 9).alias("with_usd"), F.round((F.col("tokens_original") - F.col("tokens_used")) * rate, 9).alias("saved_usd"))


def project_rollup(log: DataFrame) -> DataFrame:
    """By project, and for all: saved tokens, calls, intercepted calls."""
    hit = F.col("action") == "intercepted"
    out = effective(log).rollup("project").agg(F.grouping("project").alias("g"), F.sum(F.when(hit, F.col("saved_tokens")).otherwise(0)).alias("tokens_saved"), F.count("*").alias("total_calls"), F.count_if(hit).alias("intercepted"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("project")).alias("project"), "tokens_saved", "total_calls", "intercepted")


def command_stats(log: DataFrame, top: int = 20) -> DataFrame:
    """By first word of the command: calls, original and saved tokens, distinct commands; the most wasteful first."""
    base = F.regexp_extract(F.trim("command"), r"^\S+", 0)
    by = effective(log).where("command <> ''").groupBy(base.alias("base"), "command").agg(F.count("*").alias("n"), F.sum("original_estimate").alias("o"), F.sum("saved_tokens").alias("s"))
    out = by.groupBy("base").agg(F.sum("n").alias("calls"), F.sum("o").alias("original"), F.sum("s").alias("saved"), F.count("*").alias("commands"))
    return out.withColumn("waste", F.col("original") - F.col("saved")).orderBy(F.desc("waste"), "base").limit(top)


def sessions(log: DataFrame, key: str = "project", gap: int = GAP_SECONDS) -> DataFrame:
    """log with session (numbered by key): a pause of more than `gap` seconds opens one."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))
    return log.withColumn("opens", F.coalesce((pause > gap * 1_000_000).cast("int"), F.lit(1))).withColumn("session", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def session_stats(log: DataFrame, key: str = "project") -> DataFrame:
    """By key: sessions, mean and largest number of calls in one, requests repeated within one."""
    rows = sessions(effective(log), key).withColumn("subject", F.when(F.col("command") == "", F.col("input_preview")).otherwise(F.col("command")))
    each = rows.groupBy(key, "session", "tool", "subject").agg(F.count("*").alias("n"))
    one = each.groupBy(key, "session").agg(F.sum("n").alias("calls"), F.sum(F.col("n") - 1).alias("again"))
    return one.groupBy(key).agg(F.count("*").alias("sessions"), F.round(F.avg("calls"), 6).alias("calls_per_session"), F.max("calls").alias("calls_max"), F.sum("again").alias("re_requests"))


def repeated_outputs(log: DataFrame, ttl: int = 3600, least_tokens: int = 200, entries: int | None = None) -> DataFrame:
    """Runs whose output equals an earlier one of the same project and command within ttl seconds: (event_id, earlier, age). entries: and among so many last ones of the project."""
    w = Window.partitionBy("project", "command", "digest").orderBy("ts", "event_id")
    big = log.where((F.col("command") != "") & (F.col("actual_tokens") >= least_tokens))
    if entries is not None:
        big = big.withColumn("no", F.row_number().over(Window.partitionBy("project").orderBy("ts", "event_id")))
    rows = big.withColumn("earlier", F.lag("event_id").over(w)).withColumn("age", F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)))
    near = F.col("age") <= ttl if entries is None else (F.col("age") <= ttl) & (F.col("no") - F.col("before") <= entries)
    if entries is not None:
        rows = rows.withColumn("before", F.lag("no").over(w))
    return rows.where(near).select("event_id", "earlier", "age")


def groups(rows: DataFrame, key: Column, seq: Column, size: Column | None = None) -> DataFrame:
    """(key, n, size, place, by_size): groups in the order in which they are first seen, and by size."""
    by = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(size if size is not None else F.lit(1)).alias("size"), F.min(seq).alias("first"))
    return by.select("key", "n", "size", F.row_number().over(Window.orderBy("first", "key")).alias("place"), F.row_number().over(Window.orderBy(F.desc("size"), "key")).alias("by_size"))


def audit(index: DataFrame, hooks: DataFrame, prompt: DataFrame, stale: Column) -> DataFrame:
    """One row of health: files, chunks, tokens, hook_events, prompt_tokens, stale and the recommendations. index (path, chunks, tokens), hooks: the log, prompt (tokens)."""
    i = index.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    one = i.join(hooks.agg(F.count("*").alias("hook_events"))).join(prompt.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("prompt_tokens"))).withColumn("stale", stale)  # one row each
    told = F.array_compact(F.array(
        F.when(F.col("files") == 0, "index missing"), F.when(F.col("stale"), "index stale"), F.when(F.col("hook_events") == 0, "no hook events"),
        F.when(F.col("prompt_tokens") > 10_000, "prompt weight high"), F.when(F.col("prompt_tokens") > 6_000, "keep the server list stable"),
    ))
    return one.withColumn("recommendations", F.when(F.size(told) == 0, F.array(F.lit("healthy"))).otherwise(told))


def failure_streaks(runs: DataFrame, threshold: int = 3, ttl: int = 1800) -> DataFrame:
    """Failures (project, command, signature, failed, ts, event_id) that repeat: the run's place in its streak, at multiples of the threshold.

    A success, another signature or a pause of more than ttl seconds ends a streak.
    """
    w = Window.partitionBy("project", "command").orderBy("ts", "event_id")
    same = F.col("failed") & F.lag("failed").over(w) & (F.col("signature") == F.lag("signature").over(w)) & (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)) <= ttl)
    rows = runs.withColumn("opens", (~F.coalesce(same, F.lag("failed").over(w).isNull() & F.lit(False))).cast("int")).withColumn("streak", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = Window.partitionBy("project", "command", "streak").orderBy("ts", "event_id")
    rows = rows.withColumn("n", F.row_number().over(place).cast("bigint")).withColumn("since", F.unix_timestamp("ts") - F.unix_timestamp(F.first("ts").over(place)))
    return rows.where(F.col("failed") & (F.col("n") % threshold == 0)).select("event_id", "project", "command", "n", "since")
