"""Exact substring deduplication with fixed-block anchors.

A repeat of 13 words holds one whole block of 7 words that starts at a multiple of 7 in the text it repeats. Every text's
non-overlapping blocks are the index, and every rolling 7-word window of every text is a probe. Where index and probe meet
in more than one place, the 13-word windows around the hit are compared exactly (by 96 bits of their hashes), and runs of
repeated windows extend a hit to the maximal repeat.

Texts are first written as compressed packs. Hash buckets receive sorted, delta-coded arrays and answer each pack with one
bit for each value, so what moves is small, no bucket lists the pairs of a frequent passage, and texts move twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from versemill.llm._common import NO_ID, SLICE_BYTES, Words, bucket_of, buckets_for, deflate, inflate, keyed_text, materialize, packs_of, unpack

WINDOW, BLOCK = 13, 7
ANSWERS = "pack long, kind int, bucket int, bits binary"


class _Pack:
    """Word positions and window hashes of the texts of one pack, positions counted over all its words."""

    def __init__(self, blob: bytes, buckets: int):
        held = unpack(blob)
        self.doc_ids = [d for d, _ in held]
        self.ids = np.asarray([NO_ID if d is None else d for d in self.doc_ids], np.int64)
        self.texts = [t for _, t in held]
        first, blocks, windows, at, k = [np.zeros(1, np.int64)], [], [], 0, 0
        while k < len(held):
            end, size = k, 0
            while end < len(held) and (end == k or size < SLICE_BYTES):
                size += len(self.texts[end])
                end += 1
            words = Words(self.texts[k:end])
            first.append(words.first[1:] + at)
            place, value = words.windows(BLOCK)
            blocks.append((place + at, value))
            place, value = words.windows(WINDOW)
            _, check = words.windows(WINDOW, seed=2)
            windows.append((place + at, value, (check >> np.uint64(32)).astype(np.uint32)))
            at += len(words.hash)
            k = end
        self.first = np.concatenate(first)
        self.block_at, self.block = (np.concatenate(c) for c in zip(*blocks, strict=True))
        self.window_at, self.window, self.check = (np.concatenate(c) for c in zip(*windows, strict=True))
        self.buckets = buckets
        # a block value, for its bucket: 32 bits of its hash. Blocks only propose, so a rare clash costs no more than time
        key = bucket_of(self.block, buckets) << np.uint64(32) | self.block & np.uint64(0xFFFFFFFF)
        self.key, self.key_of, self.key_count = np.unique(key, return_inverse=True, return_counts=True)
        self.cuts = np.searchsorted(self.key >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def block_rows(self) -> list[tuple[int, bytes]]:
        """(bucket, values with the marks `starts a block of the index` and `is here more than once`)."""
        indexed = np.zeros(len(self.key), bool)
        indexed[self.key_of[(self.block_at - self.first[self.text_of(self.block_at)]) % BLOCK == 0]] = True
        low, twice = (self.key & np.uint64(0xFFFFFFFF)).astype(np.uint32), self.key_count > 1
        return [
            (int(b), deflate(np.diff(low[c:d], prepend=np.uint32(0)), np.packbits(indexed[c:d]), np.packbits(twice[c:d])))
            for b, c, d in ((b, self.cuts[b], self.cuts[b + 1]) for b in np.flatnonzero(np.diff(self.cuts)))
        ]

    def propose(self, bits: dict[int, bytes]) -> None:
        """Keep the windows around shared blocks, one entry for each distinct window with the smallest doc_id here."""
        told = np.zeros(len(self.key), bool)
        for b in np.flatnonzero(np.diff(self.cuts)):
            c, d = self.cuts[b], self.cuts[b + 1]
            told[c:d] = np.unpackbits(inflate(bits[int(b)])[0], count=d - c)
        shared = np.zeros(self.first[-1] + WINDOW + 1, np.int32)
        shared[self.block_at + 1] = told[self.key_of]
        shared = np.cumsum(shared)
        near = shared[self.window_at + WINDOW - BLOCK + 1] > shared[self.window_at]
        self.at, value, check = self.window_at[near], self.window[near], self.check[near]
        self.owner = self.ids[self.text_of(self.at)]
        order = np.lexsort((self.owner, check, value))
        value, check, owner = value[order], check[order], self.owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (check[1:] != check[:-1])
        self.entry = np.zeros(len(value), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.value, self.value_check, self.least = value[new], check[new], owner[new]
        self.value_cuts = np.searchsorted(bucket_of(self.value, self.buckets), np.arange(self.buckets + 1, dtype=np.uint64))

    def window_rows(self) -> list[tuple[int, bytes]]:
        out = []
        for b in np.flatnonzero(np.diff(self.value_cuts)):
            c, d = self.value_cuts[b], self.value_cuts[b + 1]
            ids, index = np.unique(self.least[c:d], return_inverse=True)
            out.append((int(b), deflate(np.diff(self.value[c:d], prepend=np.uint64(0)), self.value_check[c:d], index.astype(np.uint32), ids)))
        return out

    def keep(self, bits: dict[int, bytes]) -> list[np.ndarray]:
        """For each text, which of its words stay."""
        earlier = np.zeros(len(self.value), bool)
        for b in np.flatnonzero(np.diff(self.value_cuts)):
            c, d = self.value_cuts[b], self.value_cuts[b + 1]
            earlier[c:d] = np.unpackbits(inflate(bits[int(b)])[0], count=d - c)
        gone = self.at[earlier[self.entry] | (self.owner > self.least[self.entry])]
        edge = np.zeros(self.first[-1] + WINDOW + 1, np.int32)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        stays = np.cumsum(edge) == 0
        return [stays[a:b] for a, b in zip(self.first[:-1], self.first[1:], strict=True)]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """The first row of each run of equal rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _answer(f: pd.DataFrame, kind: int, sizes: list[int], bits: np.ndarray) -> pd.DataFrame:
    parts = np.split(bits, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"pack": f["pack"], "kind": np.int32(kind), "bucket": f["bucket"], "bits": [deflate(np.packbits(p)) for p in parts]})


def _match_blocks(f: pd.DataFrame) -> pd.DataFrame:
    """Which block values of each pack are indexed somewhere and occur more than once in all."""
    values, indexed, twice = [], [], []
    for blob in f["blob"]:
        step, i, t = inflate(blob)
        values.append(np.cumsum(step, dtype=np.uint32))
        indexed.append(np.unpackbits(i, count=len(step)))
        twice.append(np.unpackbits(t, count=len(step)))
    sizes = [len(v) for v in values]
    value, some, many = (np.concatenate(c) for c in (values, indexed, twice))
    order = np.argsort(value, kind="stable")
    start = _runs(value[order])
    length = np.diff(np.append(start, len(value)))
    shared = (np.maximum.reduceat(some[order], start) > 0) & ((length > 1) | (np.maximum.reduceat(many[order], start) > 0))
    bits = np.zeros(len(value), bool)
    bits[order] = np.repeat(shared, length)
    return _answer(f, 0, sizes, bits)


def _match_windows(f: pd.DataFrame) -> pd.DataFrame:
    """Which window values of each pack also start in a document before the pack's own first."""
    parts = []
    for blob in f["blob"]:
        step, check, index, ids = inflate(blob)
        parts.append((np.cumsum(step, dtype=np.uint64), check, ids[index]))
    value, check, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((doc, check, value))
    start = _runs(value[order], check[order])
    length = np.diff(np.append(start, len(value)))
    bits = np.zeros(len(value), bool)
    bits[order] = np.repeat(doc[order][start], length) < doc[order]
    return _answer(f, 1, [len(p[0]) for p in parts], bits)


def _bits(answers: pd.DataFrame, kind: int) -> dict[int, bytes]:
    mine = answers[answers["kind"] == kind]
    return dict(zip(mine["bucket"].tolist(), mine["bits"], strict=True))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text): text is the kept words, joined by one space.

    A word goes if it lies in a window of 13 words that also starts in a document of smaller doc_id. Words are runs of
    characters other than ASCII white space. Null text has no words; a null doc_id stays null and comes after all others, beside
    the greatest id there can be;
    rows of one doc_id are one document to each other (none is smaller) and give a row each; an empty table gives no rows;
    other columns are ignored.
    """
    packs = packs_of(keyed_text(docs))
    buckets = buckets_for(packs)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = _Pack(blob.as_py(), buckets).block_rows()
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["pack", "bucket", "blob"])

    def windows(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for blob in own["blob"]:
            pack = _Pack(blob, buckets)
            pack.propose(_bits(answers, 0))
            rows += pack.window_rows()
        return pd.DataFrame({"pack": [own["pack"].iloc[0]] * len(rows), "bucket": [r[0] for r in rows], "blob": [r[1] for r in rows]})

    def finish(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in own["blob"]:
            pack = _Pack(blob, buckets)
            pack.propose(_bits(answers, 0))
            for d, text, stays in zip(pack.doc_ids, pack.texts, pack.keep(_bits(answers, 1)), strict=True):
                words = text.split()
                kept = words if stays.all() else [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                out.append((d, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        ids, *others = zip(*out, strict=True) if out else [()] * 4  # beside nulls, pandas would take large ids for doubles
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), **dict(zip(("n_words", "n_removed", "text"), others, strict=True))})

    sent = "pack long, bucket int, blob binary"
    answers = materialize(packs.mapInArrow(blocks, sent).groupBy("bucket").applyInPandas(_match_blocks, ANSWERS))
    proposed = packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(windows, sent)
    answers = answers.unionByName(materialize(proposed.groupBy("bucket").applyInPandas(_match_windows, ANSWERS)))
    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(finish, "doc_id long, n_words long, n_removed long, text string")
