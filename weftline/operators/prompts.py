"""Prompt weight of agent configurations: what is always in context, what is loaded on demand, and which limits it passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T


def _field(head: Column, key: str) -> Column:
    """Last value of a front-matter key: inline, or the indented lines after a block mark, joined by spaces; null without the key."""
    hits = F.regexp_extract_all(head, F.lit(rf"(?m)^[ \t]*{key}[ \t]*:((?:[ \t]*[|>]-?[ \t]*(?:\n[ \t].*)*$)|.*)"), F.lit(1))
    last = F.element_at(hits, -1)
    block = last.rlike(r"\A[ \t]*[|>]-?[ \t]*(?:\n|\z)")
    body = F.array_join(F.transform(F.split(F.regexp_replace(last, r"\A[ \t]*[|>]-?[ \t]*\n?", ""), "\n"), lambda s: F.trim(s)), " ")
    return F.when(F.size(hits) > 0, F.when(block, F.rtrim(body)).otherwise(F.trim(last)))


def skills(df: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """df with skill, listing (tokens of the always-loaded line `name: description`) and body (tokens of the whole text).

    Front matter stands between `---` at the start and the next line that opens with `---`. Without a name the given one holds, without a
    description the text's first line. Null texts are empty.
    """
    head = F.regexp_extract(T.text(text_col), r"(?s)\A---(.*?)\n---", 1)
    described = _field(head, "description")
    first = F.coalesce(F.get(T.lines(text_col), F.lit(0)), F.lit(""))
    shown = F.when(F.coalesce(described, F.lit("")) == "", first).otherwise(described)
    named = F.coalesce(_field(head, "name"), F.col(name_col).cast("string"))
    return df.withColumn("skill", named).withColumn("listing", T.tokens(F.concat("skill", F.lit(": "), shown))).withColumn("body", T.tokens(text_col))


def audit(servers: DataFrame, context: DataFrame, max_tokens: int, max_servers: int, max_tools: int) -> DataFrame:
    """One row an agent: totals, warn, reasons and advice.

    servers (agent, server, tools, tokens): tools and tokens are null where a server was not asked. context (agent, tokens): always-on
    texts, instructions and skill listings. Reasons come in the order tool tokens, servers, tools, context. Advice names the two heaviest servers
    above 1,500 tokens (ties: smaller name) and servers not asked.
    """
    heavy = F.filter(F.array_sort(F.collect_list(F.when(F.col("tokens").isNotNull(), F.struct((-F.col("tokens")).alias("k"), "server")))), lambda s: s["k"] < -1500)
    a = servers.groupBy("agent").agg(
        F.count("*").alias("servers"), F.coalesce(F.sum("tools"), F.lit(0)).alias("tools"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tool_tokens"),
        F.count_if(F.col("tokens").isNull()).alias("unknown"), F.slice(heavy, 1, 2).alias("heavy"),
    )
    c = context.groupBy("agent").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("always_on"))
    both = a.join(c, "agent", "full").fillna(0, ["servers", "tools", "tool_tokens", "unknown", "always_on"])

    def when(test: Column, *parts) -> Column:
        return F.when(test, F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))

    tokens, n, tools, on = F.col("tool_tokens"), F.col("servers"), F.col("tools"), F.col("always_on")
    reasons = F.array_compact(F.array(
        when(tokens > max_tokens, "~", tokens, f" tool tokens > {max_tokens}"),
        when(n > max_servers, n, f" servers > {max_servers}"),
        when(tools > max_tools, tools, f" tools > {max_tools}"),
        when(on > max_tokens, "~", on, f" always-on context tokens > {max_tokens}"),
    ))
    first = F.transform(F.coalesce("heavy", F.array().cast("array<struct<k:bigint,server:string>>")), lambda s: F.concat(F.lit("review `"), s["server"], F.lit("` first: ~"), (-s["k"]).cast("string"), F.lit(" tool-schema tokens")))
    advice = F.concat(
        F.array_compact(F.array(
            when((tokens > max_tokens) | (tools > max_tools), "find tools on demand or disable rarely used servers"),
            when(n > max_servers, "reduce ", n, f" servers to {max_servers} or fewer"),
        )),
        first,
        F.array_compact(F.array(when(F.col("unknown") > 0, "servers that were not asked count as unknown weight"))),
    )
    return both.select("agent", "servers", "tools", "tool_tokens", "always_on", (F.size(reasons) > 0).alias("warn"), reasons.alias("reasons"), advice.alias("advice"))
