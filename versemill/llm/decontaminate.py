"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's windows are the records of the join. Containment of a whole window needs every one of its words, so the prefix
that has to meet is one word: its rarest over all documents. Document words equal to such a prefix word are candidates,
bounded by position and length (the window must fit around them), and verified by comparing all words of the window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.llm._common import keyed_text, materialize, text_key, unused

WINDOW, SHARE = 13, 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_ROWS, BLOCKS = 100_000, 4  # windows, or words of items, that are broadcast at once, and scans that broadcasts may take


def words_of(text: Column) -> Column:
    """Words of a text in their own case: runs of digits, ASCII letters and characters beyond ASCII."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows_of(items: DataFrame) -> DataFrame:
    """(words, size, item_ids) of the distinct windows of all items."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(lower_ascii(F.col("text").cast("string"))).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - WINDOW + 1))
    return (
        words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.least(n, F.lit(WINDOW))))).alias("words"))
        .groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
        .select("words", F.size("words").alias("size"), "item_ids")
    )


def _in_blocks(small: DataFrame, key: str) -> list[DataFrame] | None:
    """``small`` cut into as many hash blocks as keep each within BLOCK_ROWS on average, for one broadcast join each; None if
    these would be too many scans of the documents, so that a shuffle is the better way."""
    blocks = -(-max(1, small.count()) // BLOCK_ROWS)
    if blocks > BLOCKS:
        return None
    return [small] if blocks == 1 else [small.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k) for k in range(blocks)]


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, count): how often each vocabulary word, in lower case, occurs in all documents."""
    every = docs.select(F.explode(words_of(F.col("text"))).alias("word")).select(F.lower("word").alias("token"))
    blocks = _in_blocks(vocabulary, "token")
    if blocks is None:  # counts are made before the shuffle
        return every.groupBy("token").count().join(vocabulary, "token", "left_semi")
    return reduce(DataFrame.unionByName, [every.join(F.broadcast(v), "token") for v in blocks]).groupBy("token").count()


def rarest_words(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(token, shift, words, size, item_ids): each window with its rarest word and the word's place in it."""
    placed = windows.select("*", F.posexplode("words").alias("shift", "word")).withColumn("token", F.lower("word"))
    counts = word_counts(docs, placed.select("token").distinct())
    rare = placed.join(counts, "token", "left").groupBy("words").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.col("token"), F.col("shift"))).alias("rare"), F.first("size").alias("size"), F.first("item_ids").alias("item_ids")
    )
    return rare.select(F.col("rare.token").alias("token"), F.col("rare.shift").alias("shift"), "words", "size", "item_ids")


FOUND = ("row", "doc_id", "tkey", "n", "span", "window")


def _occurrences(words: DataFrame, rare: DataFrame) -> DataFrame:
    """(FOUND): a row of null span for each document, and the occurrences of windows in it."""
    known = rare.select("token", "shift", "size", "window", F.array_join("words", " ").alias("text"))
    blocks = _in_blocks(known, "token")
    if blocks is not None and len(blocks) > 1:  # each block scans the rows again, which must have the same numbers each time
        words = materialize(words)
    # position 0 holds null: it stands for the document itself, so that one pass gives counts and hits
    at = words.select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.col("words"))).alias("place", "word")).withColumn("token", F.lower("word"))
    first = F.col("place") - F.col("shift")  # place of the window's first word
    fits = F.col("size").isNotNull() & (first >= 1) & (first + F.col("size") - 1 <= F.col("n"))
    # Every part of this condition takes part in code generation. A lambda would not: the filter would then run after the
    # generator has copied the whole word array for each word.
    same = lower_ascii(F.array_join(F.slice("words", F.greatest(first, F.lit(1)), F.col("size")), " ")) == F.col("text")
    span = F.when(F.col("size").isNotNull(), F.struct(first.alias("start"), (first + F.col("size")).alias("end"))).alias("span")
    if blocks is not None:
        found = []
        for k, block in enumerate(blocks):
            joined = at.join(F.broadcast(block), "token", "left")
            found.append(joined.where((fits & same | (F.col("place") == 0)) if k == 0 else fits & same).select("row", "doc_id", "tkey", "n", span, "window"))
        return reduce(DataFrame.unionByName, found)
    # many windows: places of rare words are shuffled, not documents, and what fits meets its document again
    words = materialize(words)
    places = words.select("row", "n", F.posexplode("words").alias("place", "word")).select("row", "n", (F.col("place") + 1).alias("place"), F.lower("word").alias("token"))
    maybe = places.join(known.drop("text"), "token").where(fits).groupBy("row").agg(F.collect_list(F.struct("place", "shift", "size", "window")).alias("maybe"))
    placed = words.join(maybe, "row").select("*", F.explode("maybe").alias("m")).select("row", "doc_id", "tkey", "n", "words", "m.*")
    hits = placed.join(known.select("window", "text"), "window").where(same).select("row", "doc_id", "tkey", "n", span, "window")
    return hits.unionByName(words.select("row", "doc_id", "tkey", "n", F.lit(None).cast(hits.schema["span"].dataType).alias("span"), F.lit(None).cast("long").alias("window")))


def find_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, doc_id, tkey, n_words, spans, items) of every document row: the word spans of all window occurrences, and their items.

    ``row`` tells rows of one doc_id apart, ``tkey`` its texts. The texts are read once for the counts and once for the
    join, and never shuffled unless the windows are very many; hits are. Windows go by a number, and the items that hold
    them are looked up for what is hit.
    """
    rows = keyed_text(docs).withColumn("tkey", text_key("text"))
    rare = materialize(rarest_words(rows, materialize(windows_of(items))).withColumn("window", F.monotonically_increasing_id()))
    words = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "tkey", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    told = _occurrences(words, rare).groupBy("row", "doc_id", "tkey").agg(F.max("n").cast("long").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("window").alias("windows"))
    told = materialize(told)
    held = told.select("row", F.explode("windows").alias("window")).join(rare.select("window", "item_ids"), "window").select("row", F.explode("item_ids").alias("item"))
    named = held.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return told.join(named, "row", "left").select("row", "doc_id", "tkey", "n_words", "spans", F.coalesce("items", none).alias("items"))


def hit_words(spans: str = "spans") -> Column:
    """Words in the union of sorted [start, end) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        spans, zero, lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n")),
        lambda acc: acc["n"],
    ).cast("long")


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, doc_id, tkey, n_words, n_hit, n_items, items_sha256, contaminated) of every document row."""
    found = find_windows(docs, items).withColumn("n_hit", hit_words())
    return found.select(
        "row", "doc_id", "tkey", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """What :func:`judge` says of each document row, without the row number and the text's key.

    Null text has no words and is clean; null item texts have no windows; a null item_id counts as the empty string; a null
    doc_id passes through; repeated rows are judged one by one; empty tables on either side are allowed; other columns are
    ignored.
    """
    return judge(docs, items).drop("row", "tkey")


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, of the texts that are not contaminated.

    Texts are judged, not ids: a clean text stays even if another row of its doc_id is contaminated, and rows that repeat
    doc_id and text share their fate. A null or wordless text is clean; a null doc_id is like any other; empty tables on
    either side are allowed; other columns, whatever their names, are carried along.
    """
    id_, key = (unused(docs.columns, c) for c in ("bad_id", "bad_key"))
    bad = materialize(judge(docs, items).where("contaminated").select("doc_id", "tkey").distinct().toDF(id_, key))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (text_key("text") == F.col(key)), "left_anti")
