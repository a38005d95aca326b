"""URL filters: temporal list join, DataFrame functions only.

A list entry says from which day on a key (an exact address, a host or a domain) has a verdict. The entries of a key become
validity intervals: each holds until the day before the key's next entry. Every capture is joined as of its fetch day with the
intervals of its address, its host and its registered domain; the most specific active entry decides, and no active entry means `allow`.
Of several entries of one key and day, the least verdict by code point holds (`allow` < `block`). At most one interval of a key is active on a day, so
no join multiplies captures. The intervals are broadcast only where they are few (counted); else captures are shuffled by key, and
the engine splits hot keys.

The registered domain is the public suffix of a host and one label more. A suffix is the last label, or the last two where the last is a country's (two letters)
and the one before is one of SECOND, or where both are in SUFFIXES (a parameter takes more). Numeric addresses, single labels and bare suffixes have no domain.

Defined cases: an address that is null or has no host gets the verdict `unparsed`; a null fetch day meets no entry; entries with a null key,
scope, verdict or day don't count, and an entry of the verdict `none` only ends the one before; repeated captures each get their row; an empty list allows everything;
addresses of any length are compared whole; a capture keeps all its columns but host, verdict, scope, matched and since, which the result's own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch

SCOPES = ["url", "host", "domain"]  # most specific first
BROADCAST_ROWS = 50_000
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+)"
# Labels that registries keep before a country's, and further public suffixes of two labels.
SECOND = ["ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "gv", "id", "info", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch", "web"]
SUFFIXES = ["github.io", "gitlab.io", "blogspot.com", "herokuapp.com", "netlify.app", "vercel.app", "pages.dev", "workers.dev", "web.app", "firebaseapp.com", "cloudfront.net", "azurewebsites.net", "readthedocs.io", "uk.com", "us.com", "eu.org"]


def host(url: Column) -> Column:
    """Lower-cased host without a leading www.; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(F.lower(url), _HOST, 1), r"^www\.", "")
    return F.when(found != "", found)


def domain(host_name: Column, more: list[str] | None = None) -> Column:
    """The registered domain of a host; null for numeric addresses, single labels and public suffixes. more: further suffixes of two labels."""
    parts = F.split(host_name, r"\.")
    last, second = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    two = F.substring_index(host_name, ".", -2)
    long = (F.char_length(last) == 2) & second.isin(SECOND) | two.isin([*SUFFIXES, *(more or [])])
    size = F.when(long, 3).otherwise(2)
    numeric = host_name.rlike(r"^(\[.*|[0-9.]+)$")
    return F.when(~numeric & (F.size(parts) >= size), F.when(long, F.substring_index(host_name, ".", -3)).otherwise(two))


def address(url: Column) -> Column:
    """Host and path, without scheme, user, port, query, fragment and final slashes; null if there is no host."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host(url), F.regexp_replace(path, r"/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(scope, key, verdict, since, until) of entries (scope, key, verdict, day); until is exclusive, null for the last."""
    known = entries.select("scope", "key", "verdict", F.to_date("day").alias("since")).where(F.col("scope").isin(SCOPES)).dropna()
    daily = known.groupBy("scope", "key", "since").agg(F.min("verdict").alias("verdict"))
    following = Window.partitionBy("scope", "key").orderBy("since")  # one row for each day at most
    return daily.withColumn("until", F.lead("since").over(following)).where("verdict <> 'none'")


def evaluate(captures: DataFrame, entries: DataFrame, scratch: Scratch, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures with host, verdict, scope, matched (the key that decided) and since (the day its entry began)."""
    names = captures.columns
    spans = scratch.write(intervals(entries), "intervals")
    few = spans.count() <= BROADCAST_ROWS
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("capture"), F.col(f"`{url}`").alias("__u"), F.to_date(F.col(f"`{at}`")).alias("day"))
    rows = rows.select("capture", "day", address(F.col("__u")).alias("k_url"), host(F.col("__u")).alias("k_host")).withColumn("k_domain", domain(F.col("k_host")))
    for s in SCOPES:
        side = spans.where(F.col("scope") == s).select(F.col("key").alias(f"k_{s}"), F.col("since").alias("f"), F.col("until").alias("u"), F.struct("verdict", "scope", "key", "since").alias(f"e_{s}"))
        side = F.broadcast(side) if few else side
        on = (rows[f"k_{s}"] == side[f"k_{s}"]) & (rows["day"] >= side["f"]) & (side["u"].isNull() | (rows["day"] < side["u"]))
        rows = rows.join(side, on, "left").drop(side[f"k_{s}"]).drop("f", "u")
    hit = F.coalesce(*[F.col(f"e_{s}") for s in SCOPES])
    return rows.withColumn("hit", hit).select(
        *[F.col("capture").getField(c).alias(c) for c in names if c not in ("host", "verdict", "scope", "matched", "since")],
        F.col("k_host").alias("host"),
        F.when(F.col("k_host").isNull(), "unparsed").otherwise(F.coalesce("hit.verdict", F.lit("allow"))).alias("verdict"),
        F.col("hit.scope").alias("scope"),
        F.col("hit.key").alias("matched"),
        F.col("hit.since").alias("since"),
    )


def _hash(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 4), 16, 10).cast("int")


def pages_captures(pages: DataFrame) -> DataFrame:
    """The page table has no fetch times: a page's day in 2024 is set by its id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_at"))


def pages_list(pages: DataFrame) -> DataFrame:
    """A dated list over the table's own hosts, domains and addresses: three entries each, days and verdicts set by a hash of the key."""
    keys = pages.select(host(F.col("url")).alias("host"), address(F.col("url")).alias("url"))
    keys = keys.withColumn("domain", domain(F.col("host"))).unpivot([], SCOPES, "scope", "key").where("key is not null").distinct()
    listed = keys.where(((F.col("scope") == "domain")) | ((F.col("scope") == "host") & (_hash(F.col("key")) % 2 == 0)) | ((F.col("scope") == "url") & (_hash(F.col("key")) % 50 == 0)))
    each = listed.withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    h = _hash(F.concat_ws("|", "scope", "key", F.col("n").cast("string")))
    return each.select(
        "scope", "key",
        F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("none")), F.pmod(h, F.lit(3)) + 1).alias("verdict"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(h, F.lit(366))).alias("day"),
    )


def url_filters(pages: DataFrame, scratch: Scratch) -> DataFrame:
    return evaluate(pages_captures(pages), pages_list(pages), scratch)


_SQL_HOST = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+)', 1), '^www\.', '')"
_SQL_SECOND = ", ".join(f"'{x}'" for x in SECOND)
_SQL_SUFFIXES = ", ".join(f"'{x}'" for x in SUFFIXES)
ORACLE = rf"""
WITH c AS (
  SELECT page_id, url, (DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER)) AS fetched_at,
         CASE WHEN {_SQL_HOST} <> '' THEN {_SQL_HOST} END AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
s AS (SELECT *, host || path AS address, string_split(host, '.') AS labels FROM c),
w AS (SELECT *, CASE WHEN length(labels[-1]) = 2 AND labels[-2] IN ({_SQL_SECOND}) OR array_to_string(labels[-2:], '.') IN ({_SQL_SUFFIXES}) THEN 3 ELSE 2 END AS need FROM s),
k AS (SELECT page_id, url, fetched_at, host, address,
         CASE WHEN len(labels) >= need AND NOT regexp_matches(host, '^(\[.*|[0-9.]+)$') THEN array_to_string(labels[-need:], '.') END AS domain FROM w),
keys AS (SELECT DISTINCT 'host' AS scope, host AS key FROM k WHERE host IS NOT NULL
  UNION SELECT DISTINCT 'domain', domain FROM k WHERE domain IS NOT NULL
  UNION SELECT DISTINCT 'url', address FROM k WHERE address IS NOT NULL),
listed AS (SELECT * FROM keys WHERE scope = 'domain' OR (scope = 'host' AND CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) % 2 = 0)
  OR (scope = 'url' AND CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) % 50 = 0)),
hashed AS (SELECT scope, key, CAST('0x' || substr(md5(scope || '|' || key || '|' || CAST(n AS VARCHAR)), 1, 4) AS INTEGER) AS h
  FROM listed, (VALUES (0), (1), (2)) t(n)),
daily AS (SELECT scope, key, DATE '2024-01-01' + h % 366 AS since, min(['block', 'allow', 'none'][h % 3 + 1]) AS verdict FROM hashed GROUP BY ALL),
spans AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY scope, key ORDER BY since) AS until FROM daily) WHERE verdict <> 'none'),
hits AS (
  SELECT k.page_id, s.scope, s.key, s.verdict, s.since,
         row_number() OVER (PARTITION BY k.page_id ORDER BY CASE s.scope WHEN 'url' THEN 0 WHEN 'host' THEN 1 ELSE 2 END) AS rn
  FROM k JOIN spans s ON ((s.scope = 'url' AND s.key = k.address) OR (s.scope = 'host' AND s.key = k.host) OR (s.scope = 'domain' AND s.key = k.domain))
   AND k.fetched_at >= s.since AND (s.until IS NULL OR k.fetched_at < s.until))
SELECT k.page_id, k.url, CAST(k.fetched_at AS DATE) AS fetched_at, k.host, CASE WHEN k.host IS NULL THEN 'unparsed' ELSE coalesce(h.verdict, 'allow') END AS verdict,
       h.scope, h.key AS matched, CAST(h.since AS DATE) AS since
FROM k LEFT JOIN hits h ON k.page_id = h.page_id AND h.rn = 1
"""
