"""Shared helpers of the training-data operators: scratch tables, column picking and compact numpy blobs."""

from __future__ import annotations

import ctypes
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACK_BYTES = 4 << 20  # text in one pack
SLICE_BYTES = 1 << 18  # text whose words are hashed at once: what a task needs beside its rows is a small multiple of it
BUCKET_PACKS = 16  # packs whose values one hash bucket takes, on average, at most
NO_ID = 2**63 - 1  # stands for a null id, after all others


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Where it is unset a local master, whose executors
    share the driver's disk, gets a folder of its own; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="versemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back: this cuts the lineage, and a lost
    executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/versemill/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this folder, on whatever file system it is. Results that were not written yet read
    them, so this is for the end of a job."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/versemill")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(taken: list[str], name: str) -> str:
    """``name``, or the first of name_, name__ ... that is not among the column names ``taken``."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that no other column of the input can clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def text_key(text: str = "text") -> Column:
    """Tells the texts of one id apart; null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def crc32_of_id(doc_id: str = "doc_id"):
    """crc32 of the id written as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def deflate(*arrays: np.ndarray) -> bytes:
    """Pack numpy arrays into one compressed blob; sorted unsigned arrays should be passed through ``np.diff`` first."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T if a.size else a.view(np.uint8)
        parts.append(f"{a.dtype.str},{a.size};".encode() + np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def inflate(blob: bytes) -> list[np.ndarray]:
    """The arrays given to :func:`deflate`."""
    raw, out, at = zstandard.ZstdDecompressor().decompress(bytes(blob)), [], 0
    while at < len(raw):
        end = raw.index(b";", at)
        kind, size = raw[at:end].decode().split(",")
        dtype, size = np.dtype(kind), int(size)
        body = np.frombuffer(raw, np.uint8, size * dtype.itemsize, end + 1)
        out.append(np.ascontiguousarray(body.reshape(dtype.itemsize, size).T).view(dtype).reshape(-1) if size else np.zeros(0, dtype))
        at = end + 1 + size * dtype.itemsize
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LONG_WORD = 64  # bytes
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class Words:
    """White-space separated words of a batch of UTF-8 texts, hashed to 64 bits without a Python loop over words.

    ``start``/``end`` are byte bounds of each word in ``data``; ``first[d] : first[d + 1]`` are the words of text d.
    A word's hash is a polynomial of its bytes modulo 2**64, read off prefix sums, and finalised with :func:`mix64`. Modulo
    a power of two, some long words that are each other's complement share any polynomial, so longer words are hashed
    by another function.
    """

    def __init__(self, texts: list[bytes], lower_ascii: bool = False):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        if lower_ascii:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        blank = np.ones(len(raw) + 2, bool)
        blank[1:-1] = SPACE[raw]
        turn = np.flatnonzero(blank[1:] != blank[:-1])
        self.start, self.end = turn[::2], turn[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), out=sums[1:])
        shift = _powers(_INVERSE, len(raw) + 1)[self.start] if len(self.start) else np.zeros(0, np.uint64)
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix64((sums[self.end] - sums[self.start]) * shift + length)
        for k in np.flatnonzero(length > LONG_WORD).tolist():
            self.hash[k] = xxhash.xxh3_64_intdigest(raw[self.start[k] : self.end[k]])

    def windows(self, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words that lies in one text, in order."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        base, total = np.uint64((0xD6E8FEB86659FD93 * (2 * seed + 1)) & (2**64 - 1) | 1), np.zeros(len(self.hash) - n + 1, np.uint64)
        for k in range(n):
            total = total * base + self.hash[k : len(self.hash) - n + 1 + k]
        inside = np.zeros(len(self.hash) + 1, np.int64)
        for d in self.first[1:-1]:
            inside[d] += 1
        text = np.cumsum(inside)[:-1]
        keep = np.flatnonzero(text[: len(total)] == text[n - 1 :])
        return keep, mix64(total[keep])


def text_slices(ids, texts, limit: int = SLICE_BYTES):
    """Cut the rows of a batch into (ids, UTF-8 texts) of about ``limit`` bytes, so that word arrays stay small."""
    some_ids, some, size = [], [], 0
    for d, t in zip(ids.to_pylist(), texts, strict=True):
        t = (t.as_py() or "").encode("utf-8", "surrogatepass")
        some_ids.append(d)
        some.append(t)
        size += len(t)
        if size >= limit:
            yield some_ids, some
            some_ids, some, size = [], [], 0
    if some:
        yield some_ids, some


def give_back() -> None:
    """Return freed memory to the system. A worker is kept for later tasks, beside others that need the memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library that has no such call
        pass


def packs_of(rows: DataFrame) -> DataFrame:
    """(pack, blob): the rows, whose last column is text, in compressed packs, written to the scratch folder."""
    limit = PACK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def pack() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(level=3).compress(pickle.dumps(held))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([blob], pa.binary())], ["pack", "blob"])

        for batch in batches:
            *keys, texts = batch.columns
            for k, t in zip(zip(*[c.to_pylist() for c in keys], strict=True), texts, strict=True):
                held.append((*k, (t.as_py() or "").encode("utf-8", "surrogatepass")))
                size += len(held[-1][-1])
                if size >= limit:
                    yield pack()
                    held, size = [], 0
        if held:
            yield pack()
            held = []
        give_back()

    return materialize(rows.mapInArrow(run, "pack long, blob binary"))


def unpack(blob: bytes) -> list[tuple]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(blob)))


def buckets_for(packs: DataFrame) -> int:
    """How many hash buckets the values of all packs are dealt to: it grows with the input, so that a bucket does not."""
    return max(2 * int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-packs.count() // BUCKET_PACKS))


def bucket_of(value: np.ndarray, buckets: int) -> np.ndarray:
    return (value >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
