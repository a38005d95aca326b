"""File and log sources and sinks; all paths go through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

# Fixed values.
EXTENSIONS = [".rs", ".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go", ".c", ".cpp", ".h", ".hpp", ".cc", ".cxx", ".bas", ".cls", ".frm", ".sql", ".md", ".txt", ".toml", ".sh"]
SKIPPED_DIRS = [".git", "node_modules", "target", "dist", "build", "vendor", "__pycache__", ".venv"]
SENSITIVE = [".env", "id_rsa", "id_ed25519", "credentials", "secrets", ".pem", ".key", ".pfx", ".p12"]
MOST_BYTES = 1_500_000
EVENT = "ts double, tool string, action string, reason string, saved_tokens bigint, actual_tokens bigint, original_estimate bigint, input_preview string, phase string, command string"


def should_index(path: Column | str) -> Column:
    p = F.lower(T.text(path))
    ok = F.lit(False)
    for e in EXTENSIONS:
        ok = ok | p.endswith(e)
    for e in (".min.js", ".min.css", ".map"):
        ok = ok & ~p.endswith(e)
    for s in SENSITIVE:
        ok = ok & ~T.basename(p).contains(s)
    return ok & ~F.arrays_overlap(F.split(p, r"[/\\]"), F.array(*[F.lit(d) for d in SKIPPED_DIRS]))


def decode(content: Column) -> Column:
    """Text of a file: by its byte-order mark UTF-16, else UTF-8; null for binary (a zero byte in the first 8 KiB)."""
    le, be = F.substring(content, 1, 2) == F.lit(bytearray(b"\xff\xfe")), F.substring(content, 1, 2) == F.lit(bytearray(b"\xfe\xff"))
    zero = F.locate("\x00", F.decode(F.substring(content, 1, 8192), "ISO-8859-1")) > 0
    return F.when(le | be, F.decode(content, "UTF-16")).when(~zero, F.decode(content, "UTF-8"))


def repository(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, mtime, hash, lang) of the indexable text files under root, up to MOST_BYTES each."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substring_index("path", root.rstrip("/") + "/", -1)
    files = raw.where(F.col("length") <= MOST_BYTES).select(rel.alias("path"), decode(F.col("content")).alias("text"), F.col("modificationTime").alias("mtime"))
    return files.where(should_index("path") & F.col("text").isNotNull()).withColumn("hash", T.content_hash("text")).withColumn("lang", T.language("path"))


def changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed between two snapshots (path, hash)."""
    both = new.select("path", F.col("hash").alias("n")).join(old.select("path", F.col("hash").alias("o")), "path", "full")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("n") != F.col("o"), "changed")
    return both.select("path", kind.alias("change")).where("change is not null")


def refresh(stored: DataFrame, fresh: DataFrame, change: DataFrame, key: str = "path") -> DataFrame:
    """stored rows of unchanged files with fresh rows of the changed: an index update as anti-join and union."""
    return stored.join(change, key, "left_anti").unionByName(fresh.join(change, key, "left_semi"))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Latest row of each key; new ones win."""
    rows = stored.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__v")))).where("__r = 1").drop("__v", "__r")


def event_log(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Events of NDJSON logs; lines that don't parse are dropped, absent phase and command have their defaults."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(paths).fillna({"phase": "pre", "command": ""}).withColumn("log", F.col("_metadata.file_path"))


def append_events(events: DataFrame, path: str) -> None:
    """Appends masked events as NDJSON."""
    events.withColumn("input_preview", T.redact_credentials("input_preview")).withColumn("command", T.redact_credentials("command")).write.mode("append").json(path)


def transcripts(spark: SparkSession, root: str, most_bytes: int = 25_000_000) -> DataFrame:
    """(file, line, value) of .jsonl, .json, .log and .txt files up to most_bytes; line order within a file by position."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,json,log,txt}").load(root)
    body = raw.where(F.col("length") <= most_bytes).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("t"))
    return body.select("file", F.posexplode(T.lines("t")).alias("line", "value"))


def prune(blobs: DataFrame, keep: int = 60, key: Column | None = None) -> DataFrame:
    """The newest `keep` blobs (ts), of each key if given."""
    w = Window.partitionBy(key if key is not None else F.lit(0)).orderBy(F.desc("ts"))
    if key is None:
        return blobs.orderBy(F.desc("ts")).limit(keep)
    return blobs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__r")
