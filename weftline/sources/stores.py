"""Stores of files, chunks, blobs and recordings as tables: changes, cascades, staleness, trust, caps, and what agents leave on disk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

# Where agents keep transcripts (below the home folder), what a text file is called, and limits.
TRANSCRIPT_ROOTS = [("claude", ".claude/projects"), ("codex", ".codex/sessions"), ("gemini", ".gemini/tmp"), ("copilot", ".copilot/session-state"), ("antigravity", ".gemini/antigravity")]
EGRESS_ROOTS = [("claude", ".claude/projects", None), ("gemini", ".gemini/tmp", ["logs.json", "checkpoint.json"]), ("gemini", ".gemini/history", None), ("copilot", ".copilot/session-state", None), ("copilot", ".copilot/logs", None), ("antigravity", ".gemini/antigravity", None)]
TEXT_EXTENSIONS = ["jsonl", "json", "log", "txt", "md", "yaml", "yml", "toml", "csv"]
MOST_TRANSCRIPT, MOST_EGRESS, MOST_CAPTURE, MOST_TEE = 25_000_000, 50_000_000, 256 * 1024, 1_000_000
CAPTURES, TEES, DIRTY = 30, 20, 25


def needs_reading(found: DataFrame, stored: DataFrame) -> DataFrame:
    """found (path, mtime, hash) with change: `new`, `same` (time within 0.01 s and equal hash), `touched` (equal hash only) or `edited`."""
    old = stored.select("path", F.col("mtime").alias("t"), F.col("hash").alias("h"))
    both = found.join(old, "path", "left")
    same_time, same_hash = F.abs(F.col("mtime") - F.col("t")) < 0.01, F.col("hash") == F.col("h")
    change = F.when(F.col("h").isNull(), "new").when(same_time & same_hash, "same").when(same_hash, "touched").otherwise("edited")
    return both.select(*found.columns, change.alias("change"))


def renames(added: DataFrame, removed: DataFrame) -> DataFrame:
    """(path, was) of added files (path, hash) whose content a removed file had: the first such path of each side, in order, so a file is renamed once."""
    number = lambda df, name: df.select(F.col("path").alias(name), "hash", F.row_number().over(Window.partitionBy("hash").orderBy("path")).alias("n"))
    return number(added, "path").join(number(removed, "was"), ["hash", "n"]).select("path", "was")


def cascade(gone: DataFrame, tables: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What is left of tables, parents first, after the keys of gone (key) are deleted: (table, own key, key of the parent); children follow their parents."""
    out, keys = [], gone.select("key")
    for df, own, parent in tables:
        lost = df.join(keys.select(F.col("key").alias(parent)).distinct(), parent, "left_semi")
        out.append(df.join(keys.select(F.col("key").alias(parent)).distinct(), parent, "left_anti"))
        keys = lost.select(F.col(own).alias("key"))
    return out


def write_index(rows: DataFrame, path: str, key: str = "path", buckets: int = 64) -> None:
    """Replaces, in a table partitioned by a hash of the key, the partitions that rows (all rows of every changed partition) touch; others stay as they are."""
    part = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows.withColumn("part", part).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def update_index(spark: SparkSession, fresh: DataFrame, changed: DataFrame, path: str, key: str = "path", buckets: int = 64) -> None:
    """Rows of changed (key) give way to fresh ones in a table that write_index made. Only the partitions of changed keys are read and written."""
    part = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = changed.select(part.alias("part")).distinct()
    stored = spark.read.parquet(path)
    kept = stored.join(F.broadcast(touched), "part", "left_semi").drop("part").join(changed, key, "left_anti")  # at most `buckets` rows are broadcast
    new = kept.unionByName(fresh.select(kept.columns)).withColumn("part", part)
    from weftline.plans.scratch import cut

    left = cut(new)  # what is overwritten must not be read at the same time
    empty = [r["part"] for r in touched.join(left.select("part").distinct(), "part", "left_anti").collect()]  # at most `buckets`
    left.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for p in empty:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={p}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staleness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(project, stale, reason) of stored (project, indexed_at, fingerprint) against current (project, fingerprint, diff, dirty); a new commit with the same code is fresh."""
    both = current.select("project", F.col("fingerprint").alias("now"), "diff", "dirty").join(stored, "project", "left")
    clean = (F.trim(F.coalesce("diff", F.lit(""))) == "") & (F.trim(F.coalesce("dirty", F.lit(""))) == "")
    reason = (
        F.when(F.col("indexed_at").isNull(), "missing indexed_at").when(F.col("now").isNull(), "fresh").when(F.col("fingerprint").isNull(), "missing git fingerprint")
        .when(F.col("fingerprint") == F.col("now"), "fresh").when(clean, "code is identical").otherwise("git HEAD changed")
    )
    return both.select("project", (~reason.isin("fresh", "code is identical")).alias("stale"), reason.alias("reason"))


def freshness(found: DataFrame, stored: DataFrame, removed: DataFrame, most: int = DIRTY) -> DataFrame:
    """(verdict, files, deleted) before a query: `clean`, `refresh` (up to `most` files) or `too big`. found (path, mtime) are dirty files, deletions are told, not done."""
    old = stored.select("path", F.col("mtime").alias("t"))
    files = found.join(old, "path", "left").where(F.col("t").isNull() | (F.abs(F.col("mtime") - F.col("t")) >= 0.01)).agg(F.count("*").alias("files"))
    gone = removed.join(old, "path", "left_semi").agg(F.count("*").alias("deleted"))
    n = F.col("files")
    return files.join(gone).select(F.when(n == 0, "clean").when(n > most, "too big").otherwise("refresh").alias("verdict"), "files", "deleted")  # one row each


def hashes(inputs: DataFrame) -> DataFrame:
    """(root, hashes): a digest of each root's inputs (root, path, content), independent of their order."""
    each = inputs.select("root", F.concat_ws("\0", "path", F.sha2(F.col("content").cast("binary"), 256)).alias("h"))
    return each.groupBy("root").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n").cast("binary"), 256).alias("hashes"))  # a few configuration files a root


def trusted(inputs: DataFrame, store: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, trusted): roots without inputs, and those whose inputs have the recorded digests (root, hashes); all else is not."""
    now = hashes(inputs).withColumnRenamed("hashes", "now")
    return roots.join(now, "root", "left").join(store, "root", "left").select("root", F.coalesce(F.col("now").isNull() | (F.col("now") == F.col("hashes")), F.lit(False)).alias("trusted"))


def _cut_bytes(c: Column, most: int) -> Column:
    """The first `most` bytes of a text, without a broken last character."""
    head = F.substring(F.encode(c, "UTF-8"), 1, most)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(F.decode(head, "UTF-8"), "�$", ""))


def captures(runs: DataFrame, most: int = CAPTURES, most_bytes: int = MOST_CAPTURE) -> DataFrame:
    """(base, n, body): the first `most` recorded outputs of each base command. runs (base, ts, command, stdout, stderr); outputs of nothing are left out, credentials masked before anything is kept."""
    out, err = T.text("stdout"), T.text("stderr")
    some = (F.trim(out) != "") | (F.trim(err) != "")
    ended = F.when(out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n")))
    body = F.concat(F.lit("$ "), F.trim("command"), F.lit("\n"), F.when(F.trim(out) != "", ended).otherwise(""), F.when(F.trim(err) != "", F.concat(F.lit("--- stderr ---\n"), err)).otherwise(""))
    first = Window.partitionBy("base").orderBy("ts", "command")
    kept = runs.where(some & F.col("base").isNotNull()).withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    return kept.select("base", "n", _cut_bytes(T.redact_credentials(body), most_bytes).alias("body"))


def capture_summary(recorded: DataFrame) -> DataFrame:
    """(base, captures, bytes), the largest first."""
    return recorded.groupBy("base").agg(F.count("*").alias("captures"), F.sum(F.octet_length("body")).cast("bigint").alias("bytes")).orderBy(F.desc("bytes"), "base")


def unscaffolded(body: Column | str) -> Column:
    """The output within a capture: without echoed commands and stream marks, each line ended."""
    kept = F.filter(T.lines(body), lambda s: ~(s.startswith("$ ") | (s == "--- stderr ---") | s.startswith("... (truncated at ")))
    return F.array_join(F.transform(kept, lambda s: F.concat(s, F.lit("\n"))), "")


def economy(recorded: DataFrame, definitions) -> DataFrame:
    """(base, captures, raw_tokens, filtered_tokens, matched): what the filter of each recorded command would leave of its captures."""
    from weftline.operators import filters

    rows = recorded.select("base", F.regexp_extract("body", r"\A\$ ([^\n]*)", 1).alias("command"), unscaffolded("body").alias("raw"))
    out = filters.apply_to(rows, "command", "raw", [definitions], keep=["base", "raw"])
    by = out.groupBy("base").agg(F.count("*").alias("captures"), F.sum(T.tokens("raw")).alias("raw_tokens"), F.sum(F.when(F.col("filter").isNull(), T.tokens("raw")).otherwise(T.tokens("reduced"))).alias("filtered_tokens"), F.max(F.col("filter").isNotNull()).alias("matched"))
    return by.orderBy(F.desc(F.col("raw_tokens") - F.col("filtered_tokens")), "base")


def tee(failures: DataFrame, most: int = TEES, most_bytes: int = MOST_TEE) -> DataFrame:
    """(name, body) of the newest failed runs (epoch, command, stdout, stderr): masked, each stream cut at most_bytes."""
    def stream(label: str, c: str) -> Column:
        raw = T.text(c)
        cut = _cut_bytes(raw, most_bytes)
        shown = F.concat(F.lit(f"--- {label} ---\n"), T.redact_credentials(cut), F.when(F.octet_length(raw) > most_bytes, F.lit("\n[tee capped at 1MB]")).otherwise(""))
        return F.when(F.trim(raw) == "", "").otherwise(F.when(shown.endswith("\n"), shown).otherwise(F.concat(shown, F.lit("\n"))))

    slug = F.regexp_replace(F.substring(F.regexp_replace(T.text("command"), "[^A-Za-z0-9]", "-"), 1, 40), "^-+|-+$", "")
    body = F.concat(F.lit("$ "), T.redact_credentials("command"), F.lit("\n"), stream("stdout", "stdout"), stream("stderr", "stderr"))
    named = failures.select(F.concat(F.col("epoch").cast("string"), F.lit("_"), slug, F.lit(".log")).alias("name"), body.alias("body"))
    return named.orderBy(F.desc("name"), "body").limit(most)


def artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path, content, status) of manifest entries (name, path): `ok`, `missing`, or `outside` for absolute paths and those with `..`; files (path, content)."""
    parts = F.split("path", r"[/\\]")
    outside = F.col("path").rlike(r"^([/\\]|[A-Za-z]:)") | F.array_contains(parts, "..")
    rel = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    m = manifest.select("name", "path", outside.alias("outside"), F.when(~outside, rel).alias("__p"))
    both = m.join(files.select(F.col("path").alias("__p"), "content"), "__p", "left")
    return both.select("name", "path", "content", F.when(F.col("outside"), "outside").when(F.col("content").isNull(), "missing").otherwise("ok").alias("status"))


def _present(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _files(spark: SparkSession, roots: list[tuple[str, str, list[str] | None]], home: str) -> DataFrame:
    """(agent, file, length, mtime, content) below the roots that exist."""
    found = []
    for agent, folder, only in roots:
        at = f"{home.rstrip('/')}/{folder}"
        if _present(spark, at):
            raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
            name = F.substring_index("path", "/", -1)
            raw = raw.where(name.isin(only) if only else F.lower(F.substring_index(name, ".", -1)).isin(TEXT_EXTENSIONS))
            found.append(raw.select(F.lit(agent).alias("agent"), F.col("path").alias("file"), "length", F.col("modificationTime").alias("mtime"), "content"))
    none = spark.createDataFrame([], "agent string, file string, length bigint, mtime timestamp, content binary")
    return reduce(DataFrame.union, found, none)


def agent_transcripts(spark: SparkSession, home: str, since: Column | None = None, most_bytes: int = MOST_TRANSCRIPT) -> tuple[DataFrame, DataFrame]:
    """Lines (agent, file, line, value) of the agents' transcripts, and (agent, read, skipped) files: too large ones and those older than `since` are skipped. Sizes and times are read without the content."""
    raw = _files(spark, [(a, f, None) for a, f in TRANSCRIPT_ROOTS], home).where(F.lower(F.substring_index("file", ".", -1)).isin("jsonl", "json", "log", "txt"))
    ok = F.col("length") <= most_bytes
    if since is not None:
        ok = ok & (F.col("mtime") >= since)
    told = raw.drop("content").groupBy("agent").agg(F.count_if(ok).alias("read"), F.count_if(~ok).alias("skipped"))
    return raw.where(ok).select("agent", "file", F.posexplode(T.lines(F.decode("content", "UTF-8"))).alias("line", "value")), told


def egress_files(spark: SparkSession, home: str, agent: str = "all") -> DataFrame:
    """(agent, file, text) of what is scanned for network destinations."""
    roots = [r for r in EGRESS_ROOTS if agent in ("all", r[0])]
    return _files(spark, roots, home).where(F.col("length") <= MOST_EGRESS).select("agent", "file", F.decode("content", "UTF-8").alias("text"))


def log_generations(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """Rows of an NDJSON log, its rotated generation (`log`.1) first: generation 0 is the older. Lines that don't parse are dropped."""
    parts = [(n, p) for n, p in ((0, f"{log}.1"), (1, log)) if _present(spark, p)]
    reads = [spark.read.schema(schema).option("mode", "DROPMALFORMED").json(p).withColumn("generation", F.lit(n)) for n, p in parts]
    return reduce(DataFrame.unionByName, reads) if reads else spark.createDataFrame([], f"{schema}, generation int")


def rotate(spark: SparkSession, log: str, most_bytes: int = 5_000_000) -> bool:
    """Renames a log of over most_bytes to its older generation, which it replaces."""
    jvm = spark._jvm
    at, old = jvm.org.apache.hadoop.fs.Path(log), jvm.org.apache.hadoop.fs.Path(f"{log}.1")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or fs.getContentSummary(at).getLength() <= most_bytes:
        return False
    fs.delete(old, True)
    return fs.rename(at, old)


def project_logs(spark: SparkSession, pattern: str, labels: DataFrame, schema: str) -> DataFrame:
    """Rows of all logs that the pattern names, with the label of their project (project, label); the project is the folder of the log, and its own label where none is known."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern)
    project = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+(?:/part-[^/]*)?$", 1)
    return rows.withColumn("project", project).join(labels, "project", "left").withColumn("label", F.coalesce("label", "project"))


def chat_strings(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """(source, row, field, text): the non-empty text columns of a chat database's tables as one tall table. The tables come from any reader (JDBC, or an export as Parquet or JSON)."""
    out = []
    for name, df in tables.items():
        key = df.columns[0]
        tall = df.select(F.col(key).cast("string").alias("row"), F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns[name]])))
        out.append(tall.where("text <> ''").select(F.lit(name).alias("source"), "row", "field", "text"))
    return reduce(DataFrame.union, out)

