"""Best-fit sequence packing with exact-complement hashing.

Tokenised pieces are counted by length: a histogram with at most ``capacity`` entries, whatever the input. From it the
driver makes a plan of runs (a pattern of lengths, and how many sequences use it): singles, pairs and triples of lengths
that fill a gap exactly are found through indexes of their sums and consumed as far as both sides last, and the residue
goes to best-fit. Executors then give each piece a rank within its length and read its place from the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versemill.llm._common import give_back, keyed_text, materialize

CAPACITY, EOS = 1024, 2
RANKED_ROWS = 50_000  # pieces of one length that one task ranks, on average
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Fixed value: the pre-tokeniser pattern of byte-level BPE vocabularies.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # what \s is in that pattern
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = 100_000  # white space of so many characters is taken apart before the pattern, whose look-ahead tries each of its ends
_LONG_SPACE = re.compile(f"[{WHITE_SPACE}]{{{LONG_RUN},}}")


class _Encoder:
    """Token ids of a text as little-endian bytes, those of the tokenizer object.

    A byte-level vocabulary whose ids follow its merge order is also a rank table, by which texts are merged several times
    faster than through the tokenizer object; any other vocabulary, and every special token, goes through the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.ranked, self.single_spaced = self._ranked(told)

    @staticmethod
    def _ranked(told: dict) -> tuple:
        """Encodings for any text, and for texts in which no two white-space characters meet: there the look-ahead of the
        pattern never holds, and the pattern without it runs faster."""
        import tiktoken

        model, pre = told["model"], told.get("pre_tokenizer") or {}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        in_order = [model["vocab"].get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs)))
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or told.get("normalizer") or not in_order:
            return None, None
        special = {t["content"] for t in told.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tuple(
            tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for name, pattern in (("any", BYTE_LEVEL_PATTERN), ("single", BYTE_LEVEL_PATTERN.replace(r"|\s+(?!\S)", "")))
        )

    def encode(self, text: str) -> bytes:
        if self.ranked is None or any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # as many words as spaces and newlines part, and no other white space anywhere, at either end neither
        if len(text) > LONG_RUN and (run := _LONG_SPACE.search(text)):
            return self._around(text, run)
        single = len(text.split()) == text.count(" ") + text.count("\n") + 1 and (rest := text.replace(" ", "").replace("\n", "")).split() == [rest]
        return (self.single_spaced if single else self.ranked).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def _around(self, text: str, run: re.Match) -> bytes:
        """A text with long white space. The pattern makes one part of all of it but the last character, which may belong to
        what follows; at the end of the text of all of it."""
        out, at = [], 0
        while run:
            end = run.end() - (run.end() < len(text))
            out += [self.encode(text[at : run.start()]), np.asarray(self.ranked._encode_single_piece(text[run.start() : end]), "<u4").tobytes()]
            at, run = end, _LONG_SPACE.search(text, end)
        return b"".join([*out, self.encode(text[at:])])


_ENCODERS: dict[str, _Encoder] = {}


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids; only the first piece of a cut document may be shorter."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    bounds = [0, *range(first, n, capacity), n] if n > first else [0, n]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        yield k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids, the document's end id included, with their CRC-32."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, _Encoder(tokenizer_path))
        end = np.asarray([EOS], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.encode(t or "") for t in part.column(1).to_pylist()]
                rows = [(d, *p) for d, x in zip(part.column(0).to_pylist(), ids, strict=True) for p in pieces_of(x + end, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        give_back()

    return keyed_text(docs).mapInArrow(run, PIECES)


@dataclass
class Run:
    pattern: tuple[int, ...]
    count: int


class _Sums:
    """Indexes of the sums of single, pairs and triples of lengths, under the counts that are left.

    Counts only fall, so what is exhausted leaves an index for good.
    """

    def __init__(self, left: np.ndarray):
        self.left, lengths = left, np.flatnonzero(left).tolist()
        self.lengths = lengths[::-1]
        self.pairs: dict[int, list[tuple[int, int]]] = {}  # by sum, the largest first member last
        for i, a in enumerate(lengths):
            for b in lengths[: i + 1]:
                if a + b >= len(left):
                    break
                self.pairs.setdefault(a + b, []).append((a, b))
        self.triples: dict[int, list[int]] = {}  # by sum, the first members of triples not exhausted yet, the largest last

    def _there(self, *members: int) -> bool:
        return all(self.left[x] >= members.count(x) for x in members)

    def pair(self, total: int, most: int, *taken: int) -> tuple[int, int] | None:
        """A pair of this sum with no member over ``most``, beside the lengths ``taken``."""
        known = self.pairs.get(total, [])
        while known and not self._there(*known[-1]):
            known.pop()
        return next((p for p in reversed(known) if p[0] <= most and self._there(*p, *taken)), None)

    def fill(self, gap: int, parts: int, *taken: int) -> tuple[int, ...] | None:
        """Up to ``parts`` (three at most) lengths that sum to the gap, beside the lengths ``taken``: the fewest first, then
        the largest."""
        if parts and self._there(gap, *taken):
            return (gap,)
        if parts > 1 and (found := self.pair(gap, gap, *taken)):
            return found
        if parts < 3:
            return None
        if gap not in self.triples:
            self.triples[gap] = [a for a in reversed(self.lengths) if a < gap <= 3 * a and gap - a in self.pairs]
        firsts = self.triples[gap]
        while firsts and not self.left[firsts[-1]]:
            firsts.pop()
        return next(((a, *p) for a in reversed(firsts) if self.left[a] and (p := self.pair(gap - a, a, a, *taken))), None)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs that use every piece of the histogram once, in the fewest sequences that complements of up to three, two, one or
    no pieces give: where short pieces are few, those that fill a gap exactly in twos and threes may be missed by others. Its size depends on
    the number of lengths, not of pieces."""
    return min((_planned(histogram, capacity, parts) for parts in (3, 2, 1, 0)), key=lambda runs: sum(r.count for r in runs))


def _planned(histogram: dict[int, int], capacity: int, parts: int) -> list[Run]:
    """A plan with exact complements of up to ``parts`` pieces, and best fit for what has none."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    runs: list[Run] = []
    if left[capacity]:
        runs.append(Run((capacity,), int(left[capacity])))
        left[capacity] = 0
    residue: list[tuple[int, int]] = []
    sums = _Sums(left)
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            rest = sums.fill(capacity - length, parts, length)
            if rest is None:
                residue.append((length, int(left[length])))
                left[length] = 0
                break
            pattern = (length, *rest)
            n = min(int(left[x]) // pattern.count(x) for x in set(pattern))
            runs.append(Run(pattern, n))
            for x in pattern:
                left[x] -= n
    # best fit of the residue, longest first; open runs are kept sorted by their gap
    gaps: list[int] = []
    opened: dict[int, list[Run]] = {}

    def put(run: Run) -> None:
        gap = capacity - sum(run.pattern)
        if gap == 0:
            runs.append(run)
            return
        if not opened.setdefault(gap, []):
            insort(gaps, gap)
        opened[gap].append(run)

    for length, n in residue:
        while n:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                each = capacity // length
                if n >= each:
                    put(Run((length,) * each, n // each))
                    n %= each
                else:
                    put(Run((length,) * n, 1))
                    n = 0
                continue
            gap = gaps[k]
            run = opened[gap].pop()
            if not opened[gap]:
                gaps.pop(k)
            m = min(n, run.count)
            if m < run.count:
                put(Run(run.pattern, run.count - m))
            put(Run((*run.pattern, length), m))
            n -= m
    return runs + [r for rs in opened.values() for r in rs]


def places(runs: list[Run], capacity: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """By length: the first rank of each stretch of equal places, its first sequence and the offset there."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    used, base = [0] * (capacity + 1), 0
    for run in runs:
        offset = 0
        for length in run.pattern:
            found[length].append((used[length], base, offset))
            used[length] += run.count
            offset += length
        base += run.count
    return [tuple(np.asarray(c, np.int64) for c in zip(*x, strict=True)) if x else None for x in found]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    The pieces are written to the scratch folder first, so that counts and ranks see the same rows. Ranks come from
    windows over (length, salt), with as many salts for a length as its count asks for: no length, however frequent, meets
    in one task.
    """
    rows = materialize(pieces)
    histogram = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(histogram, capacity), capacity)
    salts = F.array(*[F.lit(1 + histogram.get(k, 0) // RANKED_ROWS) for k in range(capacity + 1)])
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(salts, F.col("length").cast("int"))).cast("int"))
    counts = rows.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("_own", F.row_number().over(own) - 1).join(base, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_own")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, seq, off = table[x]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise every document and pack all pieces into sequences of at most ``capacity`` ids.

    Null text is the empty text, which is one piece holding the end id only; a null doc_id stays null; each of repeated
    rows is packed; an empty table gives no rows; other columns are ignored.
    """
    return pack(tokenize(docs, tokenizer_path, capacity), capacity)
