"""Event streams: file source, watermarked sessions, repeated outputs, failure streaks. Watermark = time to live; later rows are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """(key, start, end, calls) of sessions; a pause of more than the gap ends one."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count("*").alias("calls")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def first_outputs(events: DataFrame, ttl: str = "1 hour", least_tokens: int = 200) -> DataFrame:
    """Events but those whose project, command and digest came within the time to live. Where events have `failed` or `tokens`, only successes of least_tokens or more are told apart: all others pass."""
    passes = F.lit(False)
    if "failed" in events.columns:
        passes = passes | F.coalesce(F.col("failed"), F.lit(False))
    if "tokens" in events.columns:
        passes = passes | (F.coalesce(F.col("tokens"), F.lit(0)) < least_tokens)
    alone = F.when(passes, F.col("event_id")) if "event_id" in events.columns else F.when(passes, F.uuid())
    marked = events.withColumn("__alone", alone.cast("string")).withWatermark("ts", ttl)
    return marked.dropDuplicatesWithinWatermark(["project", "command", "digest", "__alone"]).drop("__alone")


def streaks(runs: DataFrame, threshold: int = 3, ttl: int = 1800) -> DataFrame:
    """(project, command, event_id, n) when identical failures of a command reach a multiple of the threshold; state is one streak a command, dropped after ttl."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sig, n, last = state.get if state.exists else ("", 0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for r in rows.itertuples():
            at = r.ts.value // 1000
            if not r.failed:
                sig, n = "", 0
            elif n and r.signature == sig and at - last <= ttl * 1_000_000:
                n += 1
            else:
                sig, n = r.signature, 1
            last = at
            if r.failed and n % threshold == 0:
                out.append((*key, r.event_id, n))
        state.update((sig, n, last))
        state.setTimeoutTimestamp(max(last // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["project", "command", "event_id", "n"])

    return runs.withWatermark("ts", f"{ttl} seconds").groupBy("project", "command").applyInPandasWithState(fold, "project string, command string, event_id bigint, n bigint", "sig string, n bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
