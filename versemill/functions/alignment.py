"""Word alignment with unit costs and a fixed rule for ties.

Among optimal scripts the one is taken that, read from the end, prefers a diagonal step, then a deletion, then an insertion.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versemill.functions.slices import in_slices

OPERATIONS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("ref_start", "ref_end", "hyp_start", "hyp_end")]]))
EQUAL, SUBSTITUTE, DELETE, INSERT = "equal", "substitute", "delete", "insert"


BLOCK = 256  # reference words between the states that are kept


class _Table:
    """The table of edit distances between prefixes of two word lists, as bit vectors over the hypothesis.

    A step takes one reference word: ``up`` and ``down`` say where neighbouring columns of a row differ by +1 and -1, and
    their successors follow with a few operations on whole integers. ``same`` says where a cell equals its upper left
    neighbour, ``more`` where it is greater than the upper one by 1: that is all a path back needs.
    """

    def __init__(self, ref: Sequence[str], hyp: Sequence[str]):
        self.ref, self.all = ref, (1 << len(hyp)) - 1
        self.places: dict[str, int] = {}
        for j, w in enumerate(hyp):
            self.places[w] = self.places.get(w, 0) | 1 << j

    def step(self, word: str, up: int, down: int) -> tuple[int, int, int, int]:
        """(up, down, same, more) of the next row."""
        equal = self.places.get(word, 0)
        same = ((((equal & up) + up) ^ up) | equal | down) & self.all
        more, less = (down | ~(same | up)) & self.all, up & same
        left = more << 1 | 1
        return (less << 1 | ~(same | left)) & self.all, left & same, same, more

    def rows(self) -> Iterator[tuple[int, int]]:
        """(same, more) of all rows, the last first. Only the state before every BLOCK rows is kept; a block's rows are made again."""
        state, kept = (self.all, 0), []
        for i, word in enumerate(self.ref):
            if i % BLOCK == 0:
                kept.append(state)
            state = self.step(word, *state)[:2]
        for k in range(len(kept) - 1, -1, -1):
            (up, down), block = kept[k], []
            for word in self.ref[k * BLOCK : (k + 1) * BLOCK]:
                up, down, same, more = self.step(word, up, down)
                block.append((same, more))
            yield from reversed(block)


def distance(ref: Sequence[str], hyp: Sequence[str]) -> int:
    """The edit distance of two word lists, in whole-integer steps and with memory for one row."""
    table, last, n = _Table(ref, hyp), 1 << len(hyp) >> 1, len(hyp)
    if not n:
        return len(ref)
    up, down = table.all, 0
    for word in ref:
        less = up  # the last column falls by 1 where the cell equals its upper left neighbour and that one is 1 more
        up, down, same, more = table.step(word, up, down)
        n += bool(more & last) - bool(less & same & last)
    return n


def align(ref: Sequence[str], hyp: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    """Chunks (type, ref start, ref end, hyp start, hyp end) of consecutive equal operations, ends exclusive."""
    i, j, steps = len(ref), len(hyp), []
    rows = _Table(ref, hyp).rows()
    same, more = next(rows, (0, 0))
    while i or j:
        bit = 1 << j >> 1
        climbs = False
        if i and j and bool(same & bit) == (ref[i - 1] == hyp[j - 1]):
            i, j = i - 1, j - 1
            steps.append((EQUAL if ref[i] == hyp[j] else SUBSTITUTE, i, j))
            climbs = True
        elif i and (not j or more & bit):
            i -= 1
            steps.append((DELETE, i, j))
            climbs = True
        else:
            j -= 1
            steps.append((INSERT, i, j))
        if climbs:
            same, more = next(rows, (0, 0))
    chunks: list[list] = []
    for kind, i, j in reversed(steps):
        ends = i + (kind != INSERT), j + (kind != DELETE)
        if chunks and chunks[-1][0] == kind:
            chunks[-1][2], chunks[-1][4] = ends
        else:
            chunks.append([kind, i, ends[0], j, ends[1]])
    return [tuple(c) for c in chunks]


@F.arrow_udf(OPERATIONS)
def _align_words(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Chunks of two arrays of words; a null array is empty."""
    names = OPERATIONS.elementType.names
    kind = pa.list_(pa.struct([(names[0], pa.string()), *[(n, pa.int32()) for n in names[1:]]]))
    for refs, hyps in batches:
        for rows in in_slices(refs, hyps):
            yield pa.array([[dict(zip(names, c, strict=True)) for c in align(r or [], h or [])] for r, h in zip(*rows, strict=True)], kind)


@F.arrow_udf(T.IntegerType())
def word_edit_distance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Word-level edit distance of two arrays of words of any length; null if either is null."""
    for refs, hyps in batches:
        for rows in in_slices(refs, hyps):
            yield pa.array([None if r is None or h is None else distance(r, h) for r, h in zip(*rows, strict=True)], pa.int32())


#: Declared as not deterministic, which is not so: the optimizer may then neither copy the call below a filter nor into each
#: of the expressions that use its result, and texts are aligned once.
align_words = _align_words.asNondeterministic()


def operation_count(chunks: str | Column, kind: str) -> Column:
    """Words in chunks of one type."""
    size = lambda c: c["hyp_end"] - c["hyp_start"] if kind == INSERT else c["ref_end"] - c["ref_start"]
    return F.aggregate(F.filter(chunks, lambda c: c["type"] == kind), F.lit(0), lambda n, c: n + size(c))
