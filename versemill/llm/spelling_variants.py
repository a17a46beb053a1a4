"""Spelling variants: words of a vocabulary that differ by one edit, each led to a far more frequent form.

Words are counted once, then joined on the three rarest of their positional bigrams: one edit destroys two of a word's
bigrams at most, so of two words that near, the rarest bigram that both keep is among the three rarest of either. Bigrams
are ordered by how many words hold them, then by text and position; ties of one text are in order of position, which an
edit keeps. Of a kept bigram the edit lies wholly to one side: what lies to the other, the bigram included, is the same
in both words, at the same distance from that end of the word, and of what lies on the edit's own side one half is. Both, with
the words' lengths, are the join key, which is how the limit on positions is put; each pair that meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm._common import give_back, keyed_text, materialize

MIN_CHARS, MIN_COUNT, FACTOR, EVERY = 6, 5, 5, 199
RAREST = 3  # one more than the bigrams that an edit can destroy
SHORTEST_HALF = 2  # characters of what the edit lies in: of a longer rest one half is part of the key
HELD = 200_000  # distinct words that a task holds before it passes their counts on
PIECE = 1 << 20  # characters of a text whose words are listed at once
_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_CHARS},}}")  # of a text whose A-Z are lower-case; shorter runs give no word
_OTHER = re.compile("[^a-zÀ-ÿ]")


def _lower(text: str) -> str:
    """Only A-Z in lower case."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _stretches(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``size`` characters that cut no run."""
    at = 0
    while len(text) - at > size:
        found = _OTHER.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def words_of(doc_id: int | None, text: str) -> Counter:
    """Occurrences of words in a text, after the deletions that the id and the run decide."""
    runs: Counter = Counter()
    for part in _stretches(_lower(text)):
        runs.update(_RUN.findall(part))
    seed, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if h % EVERY == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < MIN_CHARS:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur ``min_count`` times at least. Each task counts its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.update(words_of(doc_id, text.as_py() or ""))
                if len(held) >= HELD:
                    yield told()
                    held.clear()
        if held:
            yield told()
        give_back()

    counted = keyed_text(docs).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def with_rarest(words: DataFrame) -> DataFrame:
    """Adds ``at``, the positions of the three rarest bigrams of each word, to (word, n).

    The order of bigrams is a table of a letter's square: no more than 90 x 90 entries, whatever the vocabulary.
    """
    grams = words.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda k: F.substring(F.col("word"), k, F.lit(2))))).alias("gram"))
    order = {r["gram"]: k for k, r in enumerate(sorted(grams.groupBy("gram").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["n"], r["gram"])))}
    shared = words.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            at = [sorted(range(len(w) - 1), key=lambda k, w=w: (rank[w[k : k + 2]], k))[:RAREST] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.list_(pa.int32()))], [*batch.schema.names, "at"])

    return words.mapInArrow(run, "word string, n long, at array<int>")


def _keys(rarest: DataFrame) -> DataFrame:
    """(role, key, word, n) of words with the positions of their rarest bigrams: role 0 meets words as long, 1 words longer by
    one character, 2 words shorter by one."""
    at = rarest.select("word", "n", F.char_length("word").alias("size"), F.explode("at").alias("k"))
    # the edit lies right of the bigram and all up to its end is kept, or left of it and all from its start on is
    right, left = ("substring(word, 1, k + 2)", "substring(word, k + 3)"), ("substring(word, k + 1)", "substring(word, 1, k)")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.expr(kept).alias("kept"), F.expr(rest).alias("rest")) for s, (kept, rest) in enumerate((right, left))])
    rows = at.select("word", "n", "size", F.explode(sides).alias("s")).select("word", "n", "size", "s.*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("role"))
    # of the rest, as long as the shorter word's, the edit leaves one half: that next to the bigram, or the far one
    rows = rows.withColumn("m", F.char_length("rest") - F.when(F.col("role") == 2, 1).otherwise(0)).where("m >= 0")
    halves = F.expr(f"""case when m < {2 * SHORTEST_HALF} then array(struct(0 as half, '' as text))
        when side = 0 then array(struct(1 as half, substring(rest, 1, m div 2) as text), struct(2 as half, right(rest, cast(m - m div 2 as int)) as text))
        else array(struct(1 as half, right(rest, cast(m div 2 as int)) as text), struct(2 as half, substring(rest, 1, m - m div 2) as text)) end""")
    rows = rows.select("word", "n", "size", "side", "kept", "role", "m", F.explode(halves).alias("h"))
    longer = F.col("size") + F.when(F.col("role") == 1, 1).otherwise(0)
    return rows.select("role", F.xxhash64("side", "kept", "m", F.col("role") == 0, longer, "h.half", "h.text").alias("key"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each two words of (word, n) that are one edit apart, once, the shorter or smaller first.

    The planner takes the keys to be as large as the compressed table that they are exploded from, and would broadcast some
    dozen rows for each word: so all joins of the vocabulary are told to shuffle.
    """
    keys = _keys(materialize(with_rarest(words)))
    probes, index = keys.where("role < 2"), keys.where("role <> 1").select(F.col("key").alias("key2"), F.col("role").alias("role2"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = ((F.col("role") == 1) & (F.col("role2") == 2)) | ((F.col("role") == 0) & (F.col("role2") == 0) & (F.col("word") < F.col("other")))
    return probes.join(index.hint("merge"), (F.col("key") == F.col("key2")) & met & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. A form is some times more frequent than its word, so that
    chains end after a few steps; each round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        after = materialize(now.join(up.hint("merge"), "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def group_spellings(docs: DataFrame, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents.

    ``form`` is the near word of largest n, the smallest in code-point order of equals, if that n is ``factor`` times the
    word's at least, else null; ``root`` is where forms lead, the word itself without one. Null text has no words; a null
    doc_id counts as the empty string in the deletions; repeated rows are each counted; an empty table, or one without
    words, gives no rows; other columns are ignored.
    """
    words = materialize(vocabulary(docs, min_count))
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    far = -F.col("best.less") >= factor * F.col("n")
    told = words.join(best.hint("merge"), "word", "left").select(
        "word", F.when(far, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, -F.col("best.less")).alias("form_n")
    )
    told = materialize(told)
    return told.join(roots(told.where("form is not null")).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
