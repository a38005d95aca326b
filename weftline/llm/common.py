"""Shared plumbing of the corpus operators: reading columns, Arrow maps, the shared scratch folder."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import textvec as tv


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset, a local session, as in tests, gets a local one; a cluster gets an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        at = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet under the shared folder: lineage ends there and lost executors cost no recomputation."""

    made: list[weakref.ref] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n, self.tables = spark, f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}", 0, {}
        Scratch.made.append(weakref.ref(self))

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        self.tables[at] = self.n
        out = self.spark.read.schema(df.schema).parquet(at)
        out._weftline_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        self._delete(t._weftline_path for t in tables)

    def sweep(self, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
        """Deletes the tables written after number `since`, but those to keep."""
        kept = {t._weftline_path for t in keep}
        self._delete([at for at, n in self.tables.items() if n > since and at not in kept])

    def _delete(self, paths: Iterable[str]) -> None:
        for at in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.tables.pop(at, None)


@contextlib.contextmanager
def swept():
    """Deletes, at the end, the tables of every Scratch that was made in between; shards and other files written to a path of its own stay."""
    before = len(Scratch.made)
    yield
    for ref in Scratch.made[before:]:
        if scratch := ref():
            scratch.sweep()
    del Scratch.made[before:]


def tidy() -> None:
    """Gives memory that a finished task has freed back to the machine: Python workers live on, and executors' memory is limited."""
    tv.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), tidied up after each task."""

    def tidied(batches):
        yield from run(batches)
        tidy()

    return df.mapInArrow(tidied, schema)


def map_texts(df: DataFrame, keep: list[str], fn: Callable[[list], dict], fields: str, text: str = "text") -> DataFrame:
    """keep columns pass through unchanged; fn gets the batch's texts (null: None) and returns arrays for the fields of the DDL `fields`.

    Only these columns are read, so further columns and their names don't matter. An empty table gives an empty result.
    """
    at = keep.index(text) if text in keep else len(keep)
    src = df.select(*[F.col(f"`{c}`") for c in keep], *([F.col(f"`{text}`").alias("__text")] if at == len(keep) else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)])
    out_ddl = f"{schema}, {fields}" if keep else fields
    types = _arrow_types(fields, df.sparkSession)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):  # of a batch, only a slice is held as Python objects
                b = whole.slice(lo, 1024)
                got = fn(b.column(at).to_pylist())
                cols = [b.column(i) for i in range(len(keep))] + [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in ((got[n], t) for n, t in types)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(n for n, _ in types)])

    return map_arrow(src, run, out_ddl)


def _arrow_types(ddl: str, spark: SparkSession) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(ddl).fields]


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the value as text, modulo mod; null stays null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def row_keys(*cols: str) -> list[Column]:
    """k and i: together 128 bits that tell rows of different (id, text) apart. i is the id itself, where there is one, so k alone decides only among rows of one id."""
    doc_id, text = (F.col(f"`{c}`") for c in cols or ("doc_id", "text"))
    return [F.xxhash64(doc_id, text).alias("k"), F.coalesce(doc_id.cast("bigint"), F.xxhash64(F.lit(41), text)).alias("i")]


def within(sizes: Iterable[tuple], most: int) -> set:
    """Keys of (key, size), in their order, as long as the sizes sum to at most `most`; what doesn't fit is skipped and what comes after may."""
    out, left = set(), most
    for key, size in sizes:
        if size <= left:
            out.add(key)
            left -= size
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, take: Column, max_docs: int, max_chars: int):
    """At most max_docs (text, label) of docs whose id is in the labels and passes `take`, in a fixed random order.

    A document with several labels has the largest; null labels and null ids don't count; of several texts of one id the least stands. The ids are
    chosen from the label table alone, so documents are read once and nothing is shuffled but ids and the sample. The sample's lengths come to
    the driver first, then the texts that make up at most max_chars characters: a text that doesn't fit the room left is skipped, not the sample's end.
    """
    scratch = Scratch(docs.sparkSession)
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & take)
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max(label).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__id", F.lit(17)), "__id")
        .limit(max_docs)
    )
    rows = (
        docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text"), F.lit("")).alias("__t"))
        .join(F.broadcast(ids), "__id")
        .groupBy("__id", "__y")
        .agg(F.min("__t").alias("__t"))
        .select("__id", "__y", "__t", F.char_length("__t").alias("__n"), F.xxhash64("__id", F.lit(17)).alias("__h"))
    )
    rows = scratch.write(rows, "sample")
    sizes = sorted((r["__h"], r["__id"], r["__n"]) for r in rows.select("__h", "__id", "__n").collect())  # max_docs rows at most
    chosen = within((((h, i), n) for h, i, n in sizes), max_chars)
    got = fetch(rows, chosen, ["__h", "__id"], ["__t", "__y"])
    scratch.drop(rows)
    return [r["__t"] for r in got], [r["__y"] for r in got]


def fetch(rows: DataFrame, chosen: set, key: list[str], cols: list[str]) -> list:
    """The chosen rows in the order of their keys; their number and size are bounded by the caller."""
    if not chosen:
        return []
    wanted = rows.sparkSession.createDataFrame(sorted(chosen), rows.select(*key).schema)
    got = rows.join(F.broadcast(wanted), key).select(*key, *cols).collect()
    return sorted(got, key=lambda r: tuple(r[k] for k in key))


__all__ = ["Scratch", "crc_mod", "fetch", "labelled_sample", "map_arrow", "map_texts", "row_keys", "shared_dir", "swept", "table", "tidy", "tv", "within"]
