"""Token-ID / binary output: training-order materialisation.

Documents become token ids of a public vocabulary (never trained here), each ended by the end id, and are cut into sequences of
a fixed length. Sequence number i, counted over the documents by id, gets the global slot that a keyed Feistel permutation with
cycle-walking assigns to i: a shuffle that needs no memory and that any reader can invert. Slots are dealt to shards by range, each
shard is sorted and written as records of one stride: a 16-byte header (document id, sequence number, number of ids, 1 for a null
id; little-endian 8, 4, 2 and 2 bytes), 2-byte ids padded with the end id, then a 2-byte record mark. Record s is at byte
(s mod slots per shard) x stride of its shard, so a reader starts anywhere and resumes from a slot number.

Texts are tokenised twice, first to count, so that only the final shuffle carries tokens; the ids of `stored` percent of the
documents are kept from the first time, which trades disk for CPU. Shards are written by the engine's own
writer, on any file system it knows and with its commit protocol.

Defined cases: a null or empty text is one sequence of the end id; rows alike in id and text are separate documents, tokenised once; null ids come
first, documents of one id by a hash of their text; a text of any length has the ids that the vocabulary gives to it as a whole; an empty table writes no
shard. Special tokens' strings in a text are ordinary text. Only doc_id and text are read, so further columns and their names don't matter.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textvec as tv
from weftline.llm.common import Scratch, map_arrow, row_keys

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The vocabulary's splitting pattern, and the record mark (two line feeds).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "\n\n"
BROADCAST_ROWS = 1_000_000
HEADER = 16
_U = np.uint64


@dataclass(frozen=True)
class Layout:
    length: int = 256  # ids a sequence
    slots: int = 32_768  # records a shard
    key: int = 20240101
    stored: int = 20  # percent of the documents whose ids are kept between the two passes
    vocabulary: str = VOCABULARY

    @property
    def stride(self) -> int:
        return HEADER + 2 * self.length + 2


_ENCODERS: dict[object, object] = {}


def _ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
    return _ENCODERS[path]


# The pattern for texts without two white-space characters in a row: without the look-ahead, which then decides nothing, the engine needs no backtracking.
_SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_SPACES = ("\t\n\v\f\r \x85\xa0\u1680", "\u2000-\u200a", "\u2028\u2029\u202f\u205f\u3000")  # the pattern's \s
_RUN = re.compile(f"[{''.join(_SPACES)}]{{2,}}")
_WORD_END = re.compile(r"(?<=[0-9A-Za-z])(?=[ \n])")


def _splitter(path: str):
    """The vocabulary with the simple pattern. Its one special token is never allowed, so it is ordinary text; without any, ids can't be had as a buffer."""
    if ("simple", path) not in _ENCODERS:
        import tiktoken

        _ENCODERS["simple", path] = tiktoken.Encoding("simple", pat_str=_SIMPLE, mergeable_ranks=_ranks(path), special_tokens={"\0none\0": 0})
    return _ENCODERS["simple", path]


def _parts(text: str, most: int = 1 << 20, runs: bool = True):
    """(part, whether it is one piece): texts whose ids, one after the other, are those of the whole; none but the single pieces has two white-space characters in a row.

    The splitting pattern never joins a word with the space after it, so a text may be cut there. Of a run of white space before a word, the pattern
    makes one piece of all but the last character; at the end of the text, of all. runs: False where it is known that there are none.
    """
    at = 0
    for run in [*(_RUN.finditer(text) if runs else ()), None]:
        stop = run.start() if run else len(text)
        while at < stop:
            cut = _WORD_END.search(text, at + most, stop) if stop - at > most else None
            to = cut.start() if cut else stop
            yield text[at:to], False
            at = to
        if run:
            at = run.end() - (run.end() < len(text))
            yield text[run.start() : at], True


def _ids(text: str | None, path: str, runs: bool = True) -> list[np.ndarray]:
    """Ids of a text, part by part, without the end id."""
    enc = _splitter(path)
    return [np.asarray(enc._encode_single_piece(part), np.uint32) if single else enc.encode_to_numpy(part, disallowed_special=()) for part, single in _parts(text or "", runs=runs)]


def tokens(text: str | None, path: str = VOCABULARY) -> array:
    """Ids of a text, with the end id (the vocabulary's size) after them."""
    return array("H", np.frombuffer(_packed(text, path), "<u2").astype(np.uint16).tobytes())


def n_tokens(text: str | None, path: str = VOCABULARY, runs: bool = True) -> int:
    """How many ids tokens() gives."""
    return 1 + sum(len(ids) for ids in _ids(text, path, runs))


def _packed(text: str | None, path: str, runs: bool = True) -> bytes:
    """The ids of a text and the end id, 2 bytes each, little-endian."""
    return b"".join([*(ids.astype("<u2").tobytes() for ids in _ids(text, path, runs)), _splitter(path).n_vocab.to_bytes(2, "little")])


def _with_runs(texts: pa.Array) -> list[bool | None]:
    """Which texts have two white-space characters in a row."""
    return pc.match_substring_regex(texts, f"[{''.join(_SPACES)}]{{2}}").to_pylist()


def feistel(index: np.ndarray, n: int, key: int, invert: bool = False) -> np.ndarray:
    """Permutation of [0, n): six Feistel rounds on the least even number of bits that holds n; values of n or more walk on."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = tv.mix64(np.arange(6, dtype=_U) + _U(key & 0xFFFFFFFFFFFF) * _U(6))
    x = np.asarray(index).astype(_U)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo] >> _U(half), x[todo] & mask
        for k in keys[::-1] if invert else keys:
            if invert:
                a, b = b ^ (tv.mix64(a ^ k) & mask), a
            else:
                a, b = b, a ^ (tv.mix64(b ^ k) & mask)
        x[todo] = (a << _U(half)) | b
        todo = todo[x[todo] >= _U(n)]
    return x.astype(np.int64)


def _count(layout: Layout):
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                n, kept = [], []
                for text, keep, runs in zip(b.column(3), b.column(4).to_pylist(), _with_runs(b.column(3)), strict=True):
                    if keep:
                        kept.append(_packed(text.as_py(), layout.vocabulary, runs))
                        n.append(-(-len(kept[-1]) // (2 * layout.length)))
                    else:
                        kept.append(None)
                        n.append(-(-n_tokens(text.as_py(), layout.vocabulary, runs) // layout.length))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(kept, pa.binary())], names=["k", "i", "doc_id", "n", "ids"])

    return run


def _offsets(counts: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """counts (doc_id, k, i, n, copies) with the number of the document's first sequence, over all by id and k; their total."""

    def run(batches):
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.column(2).to_numpy()
            upto = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(upto - n), b.column(2), b.column(3), pa.array(np.full(len(n), part, np.int32))], names=["k", "i", "local", "total", "copies", "part"])
            at = int(upto[-1]) if len(n) else at

    parts = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = counts.repartitionByRange(parts, "doc_id", "k").sortWithinPartitions("doc_id", "k", "i")
    local = scratch.write(order.select("k", "i", (F.col("n") * F.col("copies")).alias("total"), "copies").mapInArrow(run, "k bigint, i bigint, local bigint, total bigint, copies bigint, part int"), "local")
    sums = sorted((r["part"], r["s"]) for r in local.groupBy("part").agg(F.sum("total").alias("s")).collect())  # one row per partition
    starts, at = [], 0
    for part, s in sums:
        starts.append((part, at))
        at += s
    side = F.broadcast(scratch.spark.createDataFrame(starts, "part int, start bigint"))
    first = scratch.write(local.join(side, "part").select("k", "i", (F.col("local") + F.col("start")).alias("first"), "copies"), "first")
    scratch.drop(local)
    return first, at


COPIES = 4096  # of a row, that one task writes; it tokenises the text once


def sequences(docs: DataFrame, layout: Layout, scratch: Scratch) -> tuple[DataFrame, int]:
    """(slot, record without padding) of every sequence, and their number."""
    key = ["k", "i"]
    keyed = docs.select("doc_id", "text", *row_keys())
    keep = F.pmod("k", F.lit(100)) < layout.stored
    counted = map_arrow(keyed.select(*key, F.col("doc_id").cast("bigint"), "text", keep.alias("keep")), _count(layout), "k bigint, i bigint, doc_id bigint, n bigint, ids binary")
    counted = scratch.write(counted, "counts")
    counts = counted.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count("*").alias("copies"))
    first, total = _offsets(counts, scratch)
    several = first.where("copies > 1")
    rows = first.count()
    side = F.broadcast(first) if rows <= BROADCAST_ROWS else first
    none = F.lit(None).cast("binary").alias("ids")
    alone = F.col("copies") == 1
    known = counted.where("ids is not null").join(side, key).where(alone).select("doc_id", F.lit(None).cast("string").alias("text"), "ids", "first")
    single = keyed.where(~keep).join(side, key).where(alone).select(F.col("doc_id").cast("bigint"), "text", none, "first").union(known)

    def cut(batches):
        """Numbered sequences of each row, and those of its copies after them; some ten thousand at a time."""
        body, index = [], []
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                ids, start, copies = (b.column(i).to_pylist() for i in (0, 3, 4))
                for i, (text, stored, runs) in enumerate(zip(b.column(1), b.column(2), _with_runs(b.column(1)), strict=True)):
                    raw = stored.as_py() or _packed(text.as_py(), layout.vocabulary, runs)
                    length = len(raw) // 2
                    n = -(-length // layout.length)
                    for j in range(n):
                        size = min(layout.length, length - j * layout.length)
                        record = struct.pack("<qiHH", ids[i] or 0, j, size, ids[i] is None) + raw[2 * j * layout.length : 2 * (j + 1) * layout.length]
                        for copy in range(copies[i]):
                            body.append(record)
                            index.append(start[i] + copy * n + j)
                        if len(body) > 16_384:
                            yield _numbered(index, body)
                            body, index = [], []
                if body:
                    yield _numbered(index, body)
                    body, index = [], []

    def dealt(batches):
        for b in batches:
            slot = feistel(b.column(0).to_numpy(), total, layout.key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), b.column(1)], names=["slot", "record"])

    few = several.count()
    if not few:
        return map_arrow(single.withColumn("copies", F.lit(1)), lambda batches: dealt(cut(batches)), "slot bigint, record binary"), total
    # rows alike in id and text: one of them is tokenised, and its sequences are dealt out for all copies
    side = F.broadcast(several) if few <= BROADCAST_ROWS else several
    once = keyed.join(side, key).dropDuplicates(key).select(F.col("doc_id").cast("bigint"), "text", none, "first", "copies")
    rows = single.withColumn("copies", F.lit(1).cast("bigint")).union(once.where(F.col("copies") <= COPIES))
    out = map_arrow(rows, lambda batches: dealt(cut(batches)), "slot bigint, record binary")
    if several.where(F.col("copies") > COPIES).isEmpty():
        return out, total
    lots = once.where(F.col("copies") > COPIES).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))))  # by many tasks, each a lot of copies
    n = scratch.write(counted.join(several.where(F.col("copies") > COPIES).select(*key, "first"), key).groupBy("first").agg(F.min("n").alias("n")), "lengths")
    each = lots.join(n, "first").select("doc_id", "text", "ids", (F.col("first") + F.col("lot") * F.col("n")).alias("first"), F.least(F.lit(COPIES), F.col("copies") - F.col("lot")).alias("copies"))
    return out.union(map_arrow(each.repartition("first"), lambda batches: dealt(cut(batches)), "slot bigint, record binary")), total


def _numbered(index: list[int], body: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(body, pa.binary())], names=["number", "record"])


def materialise(docs: DataFrame, path: str, scratch: Scratch, layout: Layout = Layout()) -> DataFrame:
    """Writes the shards to `path`/shards; returns their index, read from them."""
    since = scratch.n
    records, total = sequences(docs, layout, scratch)
    shards = max(1, -(-total // layout.slots))
    dealt = records.repartitionById(shards, F.expr(f"cast(slot div {layout.slots} as int)")).sortWithinPartitions("slot")
    end = bytearray(int(encoder(layout.vocabulary).n_vocab).to_bytes(2, "little"))
    body = F.rpad("record", HEADER + 2 * layout.length, F.lit(end))
    dealt.select(body.cast("string").alias("value")).write.option("lineSep", MARK).option("compression", "none").text(f"{path}/shards")
    scratch.sweep(since)
    return read_index(scratch.spark, path, layout)


def shard_number(file: str) -> int:
    """Of a file that the engine's writer named part-<number>-..., five digits or more."""
    return int(re.match(r"part-([0-9]+)", file.rsplit("/", 1)[-1])[1])


def read_index(spark, path: str, layout: Layout = Layout()) -> DataFrame:
    """slot, shard, byte_offset, doc_id, seq_no, n_tokens and crc32 (of the ids, padding included) of every record of the shards."""
    kind = np.dtype([("id", "<i8"), ("seq", "<i4"), ("n", "<u2"), ("none", "<u2"), ("rest", "V", 2 * layout.length + 2)])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_buffer()  # of a whole shard, not copied
                shard, n = shard_number(name), raw.size // layout.stride
                rows, view = np.frombuffer(raw, kind, n), memoryview(raw)
                for lo in range(0, n, 8192):
                    part, at = rows[lo : lo + 8192], np.arange(lo, min(n, lo + 8192), dtype=np.int64)
                    crc = [zlib.crc32(view[i + HEADER : i + HEADER + 2 * layout.length]) for i in range(lo * layout.stride, (lo + len(part)) * layout.stride, layout.stride)]
                    cols = [pa.array(shard * layout.slots + at), pa.array(np.full(len(part), shard, np.int32)), pa.array(at * layout.stride), pa.array(part["id"].copy(), mask=part["none"] > 0)]
                    cols += [pa.array(part["seq"].copy()), pa.array(part["n"].astype(np.int32)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select("path", "content")
    return map_arrow(files, run, "slot bigint, shard int, byte_offset bigint, doc_id bigint, seq_no int, n_tokens int, crc32 bigint")


def read_slots(spark, path: str, first: int, count: int, layout: Layout = Layout()) -> np.ndarray:
    """Records [first, first + count) as a matrix of ids: seeks in the shards, reads nothing else."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shards")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = {shard_number(s.getPath().getName()): s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")}
    out, slot = [], first
    while slot < first + count and slot // layout.slots in files:
        shard, at = divmod(slot, layout.slots)
        n = min(first + count - slot, layout.slots - at)
        stream = fs.open(files[shard])
        try:
            stream.seek(at * layout.stride)
            raw = bytes(stream.readNBytes(n * layout.stride))
        finally:
            stream.close()
        out.append(np.frombuffer(raw, "<u2").reshape(-1, layout.stride // 2)[:, HEADER // 2 : -1])
        if len(out[-1]) < n:
            break
        slot += n
    return np.concatenate(out) if out else np.zeros((0, layout.length), np.uint16)


__all__ = ["Layout", "feistel", "materialise", "read_index", "read_slots", "sequences", "tokens"]
