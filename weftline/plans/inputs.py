"""How the provided tables stand in for the operators' inputs. Each mapping is SQL that Spark and the oracle both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

EVENT_LOG = """
SELECT event_id, ts, concat('p', CAST(user_id % 7 AS STRING)) AS project, event_type AS tool,
  CASE WHEN event_id % 50 = 0 OR event_id % 10 < 6 THEN 'intercepted' WHEN event_id % 10 < 8 THEN 'pass' WHEN event_id % 10 = 8 THEN 'bypassed' ELSE 'holdout' END AS action,
  CASE WHEN event_id % 50 = 0 THEN 'recording capture' ELSE 'r' END AS reason,
  CASE WHEN event_id % 50 = 0 THEN 0 WHEN event_id % 10 < 6 THEN (event_id % 8) * 50 ELSE 0 END AS saved_tokens,
  CASE WHEN event_id % 50 = 0 THEN 0 WHEN event_id % 10 < 6 THEN 400 + event_id % 3000 - (event_id % 8) * 50 ELSE 400 + event_id % 3000 END AS actual_tokens,
  CASE WHEN event_id % 50 = 0 THEN 0 ELSE 400 + event_id % 3000 END AS original_estimate,
  concat('file', CAST(user_id % 20 AS STRING)) AS input_preview,
  CASE WHEN event_id % 50 = 0 OR event_id % 2 = 0 THEN 'pre' ELSE 'post' END AS phase,
  CASE event_id % 6 WHEN 0 THEN 'git status --short' WHEN 1 THEN 'cargo test -p core | tail' WHEN 2 THEN 'npm run build && ls' WHEN 3 THEN 'X=1 make' WHEN 4 THEN 'kubectl get pods -A' ELSE '' END AS command,
  concat(event_type, CAST(user_id % 3 AS STRING)) AS digest, event_id % 7 <> 0 AS failed, concat('s', CAST(event_id % 13 % 2 AS STRING)) AS signature
FROM {events}"""

USAGE = """
SELECT l_shipdate AS ts, l_orderkey, l_linenumber,
  CASE l_partkey % 6 WHEN 0 THEN 'claude-sonnet-4-6' WHEN 1 THEN 'gpt-5.4-mini-2026' WHEN 2 THEN 'claude-opus-1' WHEN 3 THEN 'gemini-3.5-flash' WHEN 4 THEN 'other' ELSE 'gpt-5.5' END AS model,
  l_returnflag AS project, concat('s', CAST(l_orderkey % 40 AS STRING)) AS session,
  CAST(l_quantity * 100 AS BIGINT) AS input, CAST(l_quantity * 10 AS BIGINT) AS output, CAST(l_partkey % 1000 AS BIGINT) AS cache_read,
  CAST(l_suppkey * 10 AS BIGINT) AS cache_write, CAST(l_linenumber * 100 AS BIGINT) AS cache_write_1h,
  CASE WHEN l_linenumber = 4 THEN CAST(0.25 AS DOUBLE) END AS logged_cost
FROM {lineitem}"""

TRADE = """
SELECT src, dst FROM (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM (
    SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey) t) u
WHERE r <= 3"""


def oracle(sql: str) -> str:
    """The mapping over the oracle's views of the same names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})
