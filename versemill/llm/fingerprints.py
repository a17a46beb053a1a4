"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash matches a mask, a strict one before the normal chunk
size and a loose one after it (normalised chunking), between a least and a greatest size. Boundaries depend on the bytes
before them only, so an insertion moves them no further than to the next common boundary. The fingerprint is the set of
chunk digests with their lengths, and the likeness of one to another is the share of its length found in the other.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm._common import keyed_text, mix64

LEAST, NORMAL, GREATEST = 12, 32, 128
STRICT, LOOSE = np.uint32(0xFE000000), np.uint32(0xE0000000)  # 7 and 3 bits
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: bytes) -> np.ndarray:
    """The gear hash after each byte: h = 2 h + gear[byte] modulo 2**32, so that 32 bytes count; built by doubling."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            older = h[:-step] << np.uint32(step)
            h = h.copy()
            h[step:] += older
    return h


def chunks(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text's bytes."""
    h = gear_hash(data)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[loose] & STRICT) == 0).tolist()
    out, start = [], 0
    for at, sure in zip((loose + 1).tolist(), strict, strict=True):
        while at - start > GREATEST:
            out.append((start, start + GREATEST))
            start += GREATEST
        if at - start >= (LEAST if sure else NORMAL):
            out.append((start, at))
            start = at
    while len(data) - start > GREATEST:
        out.append((start, start + GREATEST))
        start += GREATEST
    if start < len(data):
        out.append((start, len(data)))
    return out


def fingerprint(text: str) -> dict[str, int]:
    """Digest (eight hex digits) to length of each distinct chunk, in order of first appearance."""
    data = text.encode("utf-8", "surrogatepass")
    return {f"{xxhash.xxh32_intdigest(data[a:b]):08x}": b - a for a, b in chunks(data)}


def as_string(chunk_set: dict[str, int]) -> str:
    return ".".join(f"{digest}{length:x}" for digest, length in sorted(chunk_set.items()))


def from_string(text: str) -> dict[str, int]:
    return {part[:8]: int(part[8:], 16) for part in text.split(".")} if text else {}


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """The share of a's length whose chunks b holds too; 1 for two empty fingerprints, 0 if one alone is empty."""
    if not a or not b:
        return float(a == b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


NO_ID = -(2**63)  # a null doc_id, after all others in descending order
PARTS = 4  # buckets for each shuffle partition


def buckets_of(cuts: list[int]):
    """(doc_id, hash) to a range bucket. An id that is several cuts at once, for very many rows have it, is split by the hash.

    Buckets descend where ids descend and, within an id, where hashes ascend.
    """
    edges = np.asarray(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        low, high = np.searchsorted(edges, ids.to_numpy(), "left"), np.searchsorted(edges, ids.to_numpy(), "right")
        share = hashes.to_numpy().astype(float) / 2.0**64 + 0.5
        return pd.Series(np.where(high > low + 1, high - np.floor(np.minimum(share, 1 - 1e-9) * (high - low)), high).astype(np.int32))

    return bucket


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, nameless, h, text): range buckets of descending doc_id, each with the document that follows its last as a guest.

    Buckets come from quantiles of the ids, and the driver holds one row for each bucket. Texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = PARTS * parts
    rows = keyed_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = [min(int(x), 2**63 - 1) for x in rows.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)]
    ids = rows.select("doc_id", F.xxhash64("text").alias("h"))
    head = F.min(F.struct((-F.col("doc_id").cast("decimal(20)")).alias("back"), F.col("h"), F.col("doc_id")))  # the first of a bucket in order
    heads = {r["bucket"]: (r["doc_id"], r["h"]) for r in ids.withColumn("bucket", buckets_of(cuts)("doc_id", "h")).groupBy("bucket").agg(head.alias("x")).select("bucket", "x.doc_id", "x.h").collect()}
    full = sorted(heads, reverse=True)
    sent = [(*heads[b], full[k - 1]) for k, b in enumerate(full)]  # the first bucket's head follows the last bucket
    guests = spark.createDataFrame(sent, "doc_id long, h long, host int")
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("bucket", buckets_of(cuts)("doc_id", "h"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    both = F.array(own, F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest")))
    # guests has a row for each bucket at most
    placed = rows.join(F.broadcast(guests), ["doc_id", "h"], "left").select(F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(both)).alias("at"), "doc_id", "nameless", "h", "text")
    return placed.select("at.bucket", "at.guest", "doc_id", "nameless", "h", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("doc_id"), "h", "text")


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = ((b, g, None if none else d, t, fingerprint(t)) for f in frames for b, g, d, none, t in zip(f["bucket"], f["guest"], f["doc_id"], f["nameless"], f["text"], strict=True))
    names = SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")

    def results() -> Iterator[tuple]:
        for (b, guest, d, text, own), (b2, _, _, following, its) in itertools.pairwise(rows):
            if guest or b != b2:
                continue
            changed = edited(text, following)
            new = fingerprint(changed)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            yield d, len(text), digest, as_string(own), as_string(new), likeness(own, new), likeness(own, its)

    found = results()
    while part := list(itertools.islice(found, 500)):
        ids, *others = zip(*part, strict=True)  # beside nulls, pandas would take large ids for doubles
        yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), **dict(zip(names[1:], others, strict=True))})


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with the likeness to the edited and to the next text.

    The next document has the greatest smaller doc_id; after the last comes the first. Null text is empty; a null doc_id
    sorts last and stays null; rows of one doc_id follow each other by a hash of the text, then by text; a single row follows itself; an empty table
    gives no rows; other columns are ignored.
    """
    return in_order(docs).mapInPandas(_compare, SCHEMA)
