"""Token counts of whole texts by overlap resynchronisation, for byte-fallback BPE models of sentencepiece.

A text longer than a chunk is encoded chunk by chunk, each from a token boundary a little before the last one's end. The
two are spliced at the first token, by its byte offsets, that both have there; where they share none, the overlap doubles,
at last to all that came before.

Why a common token is proof: BPE merges the pair of best score, the leftmost of equals. A sequence of tokens is a text's
encoding exactly if each two neighbours are the encoding of their own text: the first merge across any boundary of it
would be made in the two neighbours alone too, for all merges inside them come in the same order there. Up to a common
token, all neighbours stand in the encoding of the earlier chunks; from it on, in that of the later one. So all of the
spliced sequence are neighbours of an encoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm._common import give_back, keyed_text

LIMIT = 4096
CHUNK, OVERLAP = 1 << 16, 1 << 8  # bytes
SLICE_CHARS = 1 << 20  # text whose ids are held at once
COUNTS = "doc_id long, n_bytes long, n_tokens long"


class ChunkedCounter:
    """Counts the tokens of one model, with at most one chunk and its overlap encoded at a time."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto, TrainerSpec

        with open(path, "rb") as f:
            model = ModelProto.FromString(f.read())
        piece, form = ModelProto.SentencePiece, model.normalizer_spec
        plain = not form.precompiled_charsmap and not form.remove_extra_whitespaces and form.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        if model.trainer_spec.model_type != TrainerSpec.BPE or not plain or any(p.type in (piece.USER_DEFINED, piece.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: not a BPE model without text normalisation; offsets and splices need one")
        self.whole = SentencePieceProcessor(model_file=path)
        self.prefix = "▁" if form.add_dummy_prefix else ""
        form.add_dummy_prefix = False
        self.bare = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.sizes = np.asarray([1 if p.type == piece.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.chunk, self.overlap, self.widened = max(chunk, 8), max(overlap, 1), 0

    def _ends(self, data: bytes, start: int, end: int) -> np.ndarray:
        """The end offsets of the tokens of data[start:end], encoded alone."""
        ends = start + np.cumsum(self.sizes[np.asarray(self.bare.encode(data[start:end].decode("utf-8", "surrogatepass")), np.int64)])
        if ends[-1] != end:
            raise ValueError("the model's pieces do not cover the text")
        return ends

    @staticmethod
    def _at_character(data: bytes, at: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def count_long(self, text: str) -> int:
        """Tokens of one text, chunk by chunk."""
        if not text:
            return 0
        data = (self.prefix + text.replace(" ", "▁")).encode("utf-8", "surrogatepass")
        end = self._at_character(data, min(self.chunk, len(data)))
        bounds = [np.zeros(1, np.int64), self._ends(data, 0, end)]  # of the encoding of data[:end], in stretches
        while end < len(data):
            reach, lap = self._at_character(data, min(end + self.chunk, len(data))), self.overlap
            while True:
                while len(bounds) > 1 and (bounds[-1][0] > end - lap or len(bounds[-1]) < 2):
                    last = bounds.pop()
                    bounds[-1] = np.concatenate([bounds[-1], last])
                old = bounds[-1]
                k = max(0, int(np.searchsorted(old, end - lap, "right")) - 1)
                while k and old[k] < len(data) and data[old[k]] & 0xC0 == 0x80:  # a byte token inside a character
                    k -= 1
                if k == 0 and len(bounds) > 1 and data[old[0]] & 0xC0 == 0x80:
                    lap *= 2
                    continue
                new = np.concatenate([old[k : k + 1], self._ends(data, int(old[k]), reach)])
                _, i, j = np.intersect1d(old[k:], new, assume_unique=True, return_indices=True)
                both = np.flatnonzero((np.diff(i) == 1) & (np.diff(j) == 1))  # two boundaries, next to each other in both
                if len(both):
                    bounds[-1] = old[: k + i[both[0] + 1] + 1]
                    bounds.append(new[j[both[0] + 1] + 1 :])
                    break
                if old[k] == 0:  # encoded from the text's start: nothing to splice
                    bounds = [new]
                    break
                lap, self.widened = 2 * lap, self.widened + 1
            bounds = [b for b in bounds if len(b)]
            end = reach
        return sum(map(len, bounds)) - 1

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; those within a chunk are encoded as they are."""
        out, short = [0] * len(texts), []
        for k, t in enumerate(texts):
            if len(t) > self.chunk:
                out[k] = self.count_long(t)
            else:
                short.append(k)
        for k, ids in zip(short, self.whole.encode([texts[k] for k in short], num_threads=1), strict=True):
            out[k] = len(ids)
        return out


_COUNTERS: dict[tuple, ChunkedCounter] = {}


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, as sentencepiece encodes its whole text, without begin or end.

    Null text is the empty text, which has no token; a null doc_id stays null; repeated rows are each counted; an empty
    table gives no rows; other columns are ignored. A text's length is bounded only by what a row can hold: beside it, a
    task holds one chunk's ids and eight bytes a token of that text.
    """
    names = ["doc_id", "n_bytes", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model_path, chunk, overlap)
        counter = _COUNTERS.get(key) or _COUNTERS.setdefault(key, ChunkedCounter(*key))
        for batch in batches:
            text = batch.column(1)
            counts, some, size = [], [], 0
            for t in text:
                some.append(t.as_py() or "")
                size += len(some[-1])
                if size >= SLICE_CHARS:
                    counts += counter.counts(some)
                    some, size = [], 0
            counts += counter.counts(some)
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts, pa.int64())], names)
        give_back()

    return keyed_text(docs).mapInArrow(run, COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
