"""Comparison of texts in one pass: both sides tokenised, their words aligned, in one Arrow function.

Tokens do not return to the JVM between the steps; what does is flat: texts and tag numbers under offsets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versemill.functions.alignment import DELETE, EQUAL, INSERT, OPERATIONS, SUBSTITUTE, align
from versemill.functions.slices import LONGEST_KEPT, in_slices
from versemill.functions.tokenizer import LINE, RICH, TAG_SETS, WORD, numbered_tags, tokenize

COMPARED = T.StructType([T.StructField("ref_words", RICH), T.StructField("hyp_words", RICH), T.StructField("breaks", T.ArrayType(T.IntegerType())), T.StructField("chunks", OPERATIONS)])
_KINDS = [EQUAL, SUBSTITUTE, DELETE, INSERT]
_IS_WORD, _IS_LINE = ([tag in tags for tags in TAG_SETS] for tag in (WORD, LINE))
_OTHER = regex.compile(r"[^\w']")


@functools.lru_cache(maxsize=1 << 16)
def _bare(word: str) -> str:
    return _OTHER.sub("", word)


def breaks_of(numbers: list[int]) -> list[int]:
    """The index of the last word before each line break that follows no other break (-1 if none is before it), once each."""
    word, broke, out = -1, False, []
    for n in numbers:
        if _IS_LINE[n] and not broke and word not in out[-1:]:
            out.append(word)
        word, broke = word + _IS_WORD[n], _IS_LINE[n]
    return out


def words_of(texts: list[str], numbers: list[int]) -> tuple[list[str], list[int]]:
    """The words of tagged tokens, without characters other than word characters and apostrophes."""
    kept = [k for k, n in enumerate(numbers) if _IS_WORD[n]]
    return [t if (t := texts[k]).isalpha() else _bare(t) if len(t) <= LONGEST_KEPT else _OTHER.sub("", t) for k in kept], [numbers[k] for k in kept]


class _Lists:
    """Lists of values, flat."""

    def __init__(self) -> None:
        self.values: list = []
        self.ends = [0]

    def add(self, values: list) -> None:
        self.values += values
        self.ends.append(len(self.values))

    def array(self, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), values)


def _compared(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]], words_only: bool) -> Iterator[pa.Array]:
    sets = pa.array(TAG_SETS, pa.list_(pa.string()))
    for refs, hyps, languages in batches:
        for rows in in_slices(refs, hyps, languages):
            texts, tags, breaks, chunks = [_Lists(), _Lists()], [_Lists(), _Lists()], _Lists(), _Lists()
            for ref, hyp, language in zip(*rows, strict=True):
                sides = []
                for k, text in enumerate((ref, hyp)):
                    own, numbers = numbered_tags(tokenize(text, language))
                    if k == 0:
                        breaks.add(breaks_of(numbers))
                    if words_only:
                        own, numbers = words_of(own, numbers)
                    texts[k].add(own)
                    tags[k].add(numbers)
                    sides.append([w.lower() for w in own])
                chunks.add(align(*sides))
            rich = [t.array(pa.StructArray.from_arrays([pa.array(t.values, pa.string()), sets.take(pa.array(n.values, pa.int32()))], ["text", "tags"])) for t, n in zip(texts, tags, strict=True)]
            kinds = pa.array(_KINDS, pa.string()).take(pa.array([_KINDS.index(c[0]) for c in chunks.values], pa.int32()))
            spans = [pa.array([c[k] for c in chunks.values], pa.int32()) for k in range(1, 5)]
            steps = chunks.array(pa.StructArray.from_arrays([kinds, *spans], OPERATIONS.elementType.names))
            yield pa.StructArray.from_arrays([*rich, breaks.array(pa.array(breaks.values, pa.int32())), steps], COMPARED.names)


@F.arrow_udf(COMPARED)
def _compare_words(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from _compared(batches, True)


@F.arrow_udf(COMPARED)
def _compare_tokens(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from _compared(batches, False)


def compared(ref: str, hyp: str, language: str, words_only: bool = True) -> Column:
    """Struct of (ref_words, hyp_words, breaks, chunks) of two text columns: tagged words, or all tokens, of either side, the
    reference's line breaks by word, and the alignment of the lower-cased texts. Null texts have no tokens.

    Declared as not deterministic, which is not so: the optimizer may then neither copy the call below a filter nor into
    each of the expressions that use its result, and texts are compared once.
    """
    return (_compare_words if words_only else _compare_tokens).asNondeterministic()(F.col(ref), F.col(hyp), F.col(language))
