"""Usage records: cost, rollups, forecast, five-hour blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.events import prices

MEASURES = ["input", "output", "cache_read", "cache_write", "tokens"]


def with_cost(records: DataFrame, mode: str = "auto") -> DataFrame:
    """records with tokens and cost_usd. A model's price: of its exact name, else of the first name it starts with, else of the first two-part family.

    mode: auto (logged cost, else computed), display (logged, else 0), calculate.
    """
    p = prices(records.sparkSession).withColumn("order", F.monotonically_increasing_id())
    names = records.select("model").distinct()
    family = F.regexp_extract(F.col("p.model"), r"^[^-]+-[^-]+|^[^-]+", 0)
    tier = F.when(F.col("n.model") == F.col("p.model"), 0).when(F.col("n.model").startswith(F.col("p.model")), 1).when(F.col("n.model").startswith(family), 2)
    pairs = names.alias("n").join(F.broadcast(p.alias("p")), tier.isNotNull()).select(F.col("n.model").alias("model"), F.struct(tier.alias("tier"), F.col("p.order").alias("order"), "input_rate", "output_rate", "read_rate", "write_rate").alias("p"))
    chosen = pairs.groupBy("model").agg(F.min("p").alias("p"))  # a row for each model name
    hour = F.least("cache_write_1h", "cache_write")
    calc = (F.col("input") * F.col("p.input_rate") + F.col("output") * F.col("p.output_rate") + F.col("cache_read") * F.col("p.read_rate") + (F.col("cache_write") - hour) * F.col("p.write_rate") + hour * F.col("p.input_rate") * 2.0) / 1e6
    calc = F.coalesce(calc, F.lit(0.0))
    cost = {"auto": F.coalesce("logged_cost", calc), "display": F.coalesce("logged_cost", F.lit(0.0)), "calculate": calc}[mode]
    rows = records.join(chosen, "model", "left").withColumn("cost_usd", cost).drop("p")
    return rows.withColumn("tokens", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write"))


def scoped(records: DataFrame, since: str | None = None, until: str | None = None, project: str | None = None) -> DataFrame:
    """Records from since to until, both days included, of a project."""
    out = records
    if since:
        out = out.where(F.to_date("ts") >= F.lit(since).cast("date"))
    if until:
        out = out.where(F.to_date("ts") <= F.lit(until).cast("date"))
    return out.where(F.col("project") == project) if project else out


def group_key(by: str) -> Column:
    """Day, ISO week, month, session, model or project of a record."""
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return {"day": F.date_format("ts", "yyyy-MM-dd"), "week": week, "month": F.date_format("ts", "yyyy-MM")}.get(by, F.col(by))


def rollup(records: DataFrame, by: str, mode: str = "auto") -> DataFrame:
    """Measures by key, and their TOTAL."""
    rows = with_cost(records, mode).withColumn("key", group_key(by))
    out = rows.rollup("key").agg(F.grouping("key").alias("g"), *[F.sum(m).alias(m) for m in MEASURES], F.round(F.sum("cost_usd") + 1e-9, 6).alias("cost_usd"))  # halves up, whatever the order of the sum
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("key")).alias("key"), *MEASURES, "cost_usd")


def month_forecast(records: DataFrame, today: Column, mode: str = "auto") -> DataFrame:
    """Cost of today's month so far, and carried on to its end."""
    rows = with_cost(records, mode).where((F.trunc(F.to_date("ts"), "month") == F.trunc(today, "month")) & (F.to_date("ts") <= today))
    spent = F.coalesce(F.sum("cost_usd"), F.lit(0.0))
    return rows.agg(F.round(spent, 4).alias("spent_usd"), F.round(spent / F.day(today) * F.day(F.last_day(today)), 4).alias("forecast_usd"))


def spend_mix(records: DataFrame) -> DataFrame:
    """Sums over all records, and the cost of an input-equivalent unit (1, 5, 1.25 and 0.1 for input, output, cache writes and reads)."""
    rows = with_cost(records)
    out = rows.agg(*[F.sum(m).alias(m) for m in MEASURES[:4]], F.sum("cost_usd").alias("cost_usd"))
    units = F.col("input") + 5.0 * F.col("output") + 1.25 * F.col("cache_write") + 0.1 * F.col("cache_read")
    return out.select(*MEASURES[:4], F.round("cost_usd", 4).alias("cost_usd"), F.round(F.col("cost_usd") / units * 1e6, 6).alias("usd_per_million_units"))


def blocks(records: DataFrame, key: str = "project", hours: int = 5) -> DataFrame:
    """By key: blocks of five hours; the first record's full hour opens one, the first record after its end the next.

    The records of an hour open at most one block, so hours are summed first and the ordered fold sees one row an hour and key.
    """
    rows = with_cost(records).withColumn("hour", F.date_trunc("hour", "ts"))
    hourly = rows.groupBy(key, "hour").agg(F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("n"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hour")
        start, out = None, []
        for h in pdf["hour"]:
            if start is None or h >= start + pd.Timedelta(hours=hours):
                start = h
            out.append(start)
        pdf["start"] = out
        got = pdf.groupby("start").agg(tokens=("tokens", "sum"), cost_usd=("cost_usd", "sum"), records=("n", "sum")).reset_index()
        got.insert(0, key, pdf[key].iloc[0])
        return got

    kind = records.schema[key].dataType.simpleString()
    return hourly.groupBy(key).applyInPandas(fold, f"{key} {kind}, start timestamp, tokens bigint, cost_usd double, records bigint").withColumn("cost_usd", F.round(F.col("cost_usd") + 1e-9, 6))


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """rollup rows with place: time groups by key, others by cost, highest first; the total is left out."""
    order = ["key"] if by in ("day", "week", "month") else [F.desc("cost_usd"), "key"]
    return rows.where("key <> 'TOTAL'").withColumn("place", F.row_number().over(Window.orderBy(*order)))  # one row a group


def trailing_burn(records: DataFrame, now: Column, key: str = "project", hours: int = 5) -> DataFrame:
    """By key: tokens of the last `hours` before now, the minutes since the first record in them (one at least), and tokens a minute."""
    rows = with_cost(records).where((F.col("ts") >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= now))
    by = rows.groupBy(key).agg(F.sum("tokens").alias("tokens"), F.min("ts").alias("first"))
    minutes = F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp("first")) / 60), F.lit(1)).cast("bigint")
    return by.select(key, "tokens", minutes.alias("minutes"), F.round(F.col("tokens") / minutes, 6).alias("per_minute"))


def economics(mix: DataFrame, tokens_saved: Column) -> DataFrame:
    """What saved tokens are worth at the mean cost of an input-equivalent unit; at most the whole spend. mix: one row of sums and cost_usd; no row where nothing was spent."""
    units = F.col("input") + 5.0 * F.col("output") + 1.25 * F.col("cache_write") + 0.1 * F.col("cache_read")
    saved = F.greatest(tokens_saved, F.lit(0)).cast("bigint")
    worth = saved * F.col("cost_usd") / units
    told = mix.where((units > 0) & (F.col("cost_usd") > 0))
    total = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")
    return told.select(F.round("cost_usd", 4).alias("spend_usd"), F.round(worth, 6).alias("saved_usd"), F.round(F.least(worth / F.col("cost_usd") * 100, F.lit(100.0)), 6).alias("pct_of_spend"), total.cast("bigint").alias("total_tokens"), saved.alias("saved_tokens"))


def burn(blocks_df: DataFrame, now: Column, hours: int = 5) -> DataFrame:
    """Blocks open at `now`: tokens a minute, and the projected cost once 15 minutes are seen."""
    gone = F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp("start")) / 60), F.lit(1))
    left = F.greatest(F.lit(hours * 60) - gone, F.lit(0))
    open_ = (now >= F.col("start")) & (now < F.col("start") + F.expr(f"INTERVAL {hours} HOURS"))
    return blocks_df.where(open_).withColumn("burn_per_min", F.col("tokens") / gone).withColumn("projected_usd", F.when(gone >= 15, F.col("cost_usd") + F.col("cost_usd") / gone * left))


def latest(records: DataFrame, keys: list[str]) -> DataFrame:
    """First record of each key by time."""
    return records.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("ts"))).where("r = 1").drop("r")
