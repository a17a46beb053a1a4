"""Transcription evaluation: from (ref, hyp) pairs to samples, chunks and edits, and the metrics on them.

Pairs are tokenised and aligned in one Arrow function, then everything is exploded and aggregated in the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.functions import alignment as al
from versemill.functions.comparison import compared
from versemill.functions.text import case_error, near_miss, word_dist
from versemill.functions.tokenizer import BACKING, LINE, NONLEXICAL, PAREN, PUNCT, SECT, texts_of
from versemill.operators.catalog import attach_system

TYPES = {al.EQUAL: "hit", al.SUBSTITUTE: "sub", al.DELETE: "del", al.INSERT: "ins"}
REPORTED_TAGS = (PUNCT, PAREN, LINE, SECT)


def aligned(pairs: DataFrame, normalise=None, words_only: bool = True) -> DataFrame:
    """Pairs (ref, hyp, language) with ref_words, hyp_words, the breaks of the reference and ``chunks``, the alignment of the
    lower-cased words; with ``words_only`` false, of all tokens, marks and breaks included."""
    if normalise is not None:
        pairs = pairs.withColumns({"ref": normalise(F.col("ref")), "hyp": normalise(F.col("hyp"))})
    return pairs.withColumn("_compared", compared("ref", "hyp", "language", words_only)).select("*", "_compared.*").drop("_compared")


def _slice(array: str, start: Column, end: Column) -> Column:
    return F.slice(array, start + 1, end - start)


def chunk_rows(alignments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a chunk: typ, ref and hyp tokens, len, chunk_idx."""
    rows = alignments.select(*keys, "ref_words", "hyp_words", F.posexplode("chunks").alias("chunk_idx", "c"))
    ref, hyp = _slice("ref_words", F.col("c.ref_start"), F.col("c.ref_end")), _slice("hyp_words", F.col("c.hyp_start"), F.col("c.hyp_end"))
    typ = reduce(lambda acc, kv: acc.when(F.col("c.type") == kv[0], kv[1]), list(TYPES.items())[1:], F.when(F.col("c.type") == al.EQUAL, "hit"))
    return rows.select(*keys, "chunk_idx", typ.alias("typ"), ref.alias("ref_tokens"), hyp.alias("hyp_tokens"), F.greatest(F.size(ref), F.size(hyp)).cast("long").alias("len"))


def edit_rows(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row an operation: typ, ref, hyp and their tags; an insertion carries no tags of its own side."""
    pairs = chunks.select(*keys, "chunk_idx", "typ", F.posexplode(F.arrays_zip(F.col("ref_tokens").alias("r"), F.col("hyp_tokens").alias("h"))).alias("pos", "p"))
    return pairs.select(
        *keys, "chunk_idx", "pos", "typ", F.col("p.r.text").alias("ref"), F.col("p.h.text").alias("hyp"),
        F.coalesce(F.col("p.r.tags"), F.array().cast("array<string>")).alias("ref_tags"), F.coalesce(F.col("p.h.tags"), F.array().cast("array<string>")).alias("hyp_tags"),
    )


def edits(alignments: DataFrame, keys: Sequence[str] = ("uid", "dataset", "language")) -> DataFrame:
    """The edits table: typ, ref, hyp, keys, dist, nl, bv."""
    rows = edit_rows(chunk_rows(alignments, keys), keys)
    has = lambda tag: F.array_contains("ref_tags", tag)
    return rows.select("typ", "ref", "hyp", *keys, word_dist(F.col("ref"), F.col("hyp")).alias("dist"), has(NONLEXICAL).alias("nl"), has(BACKING).alias("bv"))


def chunks(alignments: DataFrame, keys: Sequence[str] = ("uid", "dataset", "language", "sample_idx")) -> DataFrame:
    """The chunks table: typ, ref, hyp, len, keys, chunk_idx, nl, bv."""
    tagged = lambda tag: F.size(F.filter("ref_tokens", lambda t: F.array_contains(t["tags"], tag))).cast("long")
    return chunk_rows(alignments, keys).select(
        "typ", F.array_join(texts_of("ref_tokens"), " ").alias("ref"), F.array_join(texts_of("hyp_tokens"), " ").alias("hyp"), "len", *keys, "chunk_idx", tagged(NONLEXICAL).alias("nl"), tagged(BACKING).alias("bv")
    )


def samples(alignments: DataFrame, keys: Sequence[str] = ("uid", "dataset", "language", "sample_idx")) -> DataFrame:
    """The samples table. Counts are read off each row's alignment: nothing is shuffled. wer is null without reference words."""

    def ref_words(kind: str, tag: str | None) -> Column:
        of_kind = F.flatten(F.transform(F.filter("chunks", lambda c: c["type"] == kind), lambda c: F.slice("ref_words", c["ref_start"] + 1, c["ref_end"] - c["ref_start"])))
        return F.size(of_kind if tag is None else F.filter(of_kind, lambda t: F.array_contains(t["tags"], tag))).cast("long")

    count = {TYPES[k]: ref_words(k, None) for k in (al.EQUAL, al.SUBSTITUTE, al.DELETE)} | {"ins": al.operation_count("chunks", al.INSERT).cast("long")}
    count |= {f"{TYPES[k]}_{s}": ref_words(k, tag) for s, tag in (("nl", NONLEXICAL), ("bv", BACKING)) for k in (al.EQUAL, al.SUBSTITUTE, al.DELETE)}
    length = F.col("hit") + F.col("sub") + F.col("del")
    spans = [c for c in ("start", "end") if c in alignments.columns]
    out = alignments.select(*keys, *spans, *[c.alias(n) for n, c in count.items()], F.array_join(texts_of("ref_words"), " ").alias("ref"), F.array_join(texts_of("hyp_words"), " ").alias("hyp"))
    out = out.withColumn("len", length).withColumn("wer", F.try_divide((F.col("sub") + F.col("del") + F.col("ins")).cast("double"), F.col("len")))
    return out.withColumn("duration", F.col("end") - F.col("start")) if len(spans) == 2 else out


def word_metrics(alignments: DataFrame, by: Sequence[str] = ("uid",)) -> DataFrame:
    """Micro-averaged word metrics of each group. Deletions of backing and non-lexical words are counted as they are."""
    rows = edit_rows(chunk_rows(alignments, by), by)
    is_ = lambda t: F.col("typ") == t
    counted = rows.groupBy(*by).agg(
        *[F.count_if(is_(t)).alias(n) for t, n in (("hit", "hits"), ("sub", "substitutions"), ("del", "deletions"), ("ins", "insertions"))],
        F.count_if(is_("sub") & near_miss(F.col("ref"), F.col("hyp"))).alias("nears"), F.count_if(is_("hit") & case_error(F.col("ref"), F.col("hyp"))).alias("_case"),
        F.count_if(is_("del") & F.array_contains("ref_tags", BACKING)).alias("deletions_backing"), F.count_if(is_("del") & F.array_contains("ref_tags", NONLEXICAL)).alias("deletions_nonlexical"),
    )
    h, s, d, i = (F.col(c) for c in ("hits", "substitutions", "deletions", "insertions"))
    n_ref, n_hyp = h + s + d, h + s + i
    div = lambda a, b: F.try_divide(a.cast("double"), b)
    wer = div(s + d + i, n_ref)
    return counted.select(
        *by, wer.alias("WER"), (wer - div(F.col("nears"), n_ref)).alias("WER_near"), div(s + d + i, h + s + d + i).alias("MER"), (1 - div(h, n_ref) * div(h, n_hyp)).alias("WIL"), "hits",
        div(F.col("nears"), n_ref).alias("near"), "substitutions", "deletions", "insertions", "nears", div(s, n_ref).alias("sub_rate"), div(d, n_ref).alias("del_rate"), div(i, n_ref).alias("ins_rate"),
        div(F.col("_case"), n_ref).alias("ER_case"), (wer + div(F.col("_case"), n_ref)).alias("WER_case"), n_ref.alias("total_len"), "deletions_backing", "deletions_nonlexical",
    )


def tag_counts(alignments: DataFrame, by: Sequence[str] = ("uid",), count_substitutions: bool = True) -> DataFrame:
    """(by, tag, H, S, D, I): edit operations of each tag.

    On matched tokens, tags of both sides (and non-lexical or backing on the reference alone) count as hit or substitution;
    what only the reference has counts as deletion, what only the hypothesis has as insertion.
    """
    rows = edit_rows(chunk_rows(alignments, by), by)
    none = F.array().cast("array<string>")
    matched = F.col("typ").isin("hit", "sub")
    common = F.when(matched, F.array_intersect("ref_tags", "hyp_tags") if count_substitutions else none).otherwise(none)
    own = F.when(matched, F.array_intersect("ref_tags", F.array(F.lit(NONLEXICAL), F.lit(BACKING)))).otherwise(none)
    both = F.array_union(common, own)
    ops = F.flatten(F.array(
        F.transform(both, lambda t: F.struct(t.alias("tag"), F.when(F.col("typ") == "hit", "H").otherwise("S").alias("op"))),
        F.transform(F.array_except("ref_tags", both), lambda t: F.struct(t.alias("tag"), F.lit("D").alias("op"))),
        F.transform(F.array_except("hyp_tags", common), lambda t: F.struct(t.alias("tag"), F.lit("I").alias("op"))),
    ))
    return rows.select(*by, F.explode(ops).alias("o")).groupBy(*by, F.col("o.tag").alias("tag")).agg(*[F.count_if(F.col("o.op") == o).alias(o) for o in "HSDI"])


def tag_scores(alignments: DataFrame, by: Sequence[str] = ("uid",)) -> DataFrame:
    """Precision, recall and F1 of marks and breaks (P_punc, R_punc, F1_punc, ...), null where undefined."""
    counts = tag_counts(alignments, by).groupBy(*by).pivot("tag", list(REPORTED_TAGS)).agg(*[F.first(o).alias(o) for o in "HSDI"])
    out = []
    for tag in REPORTED_TAGS:
        h, s, d, i = (F.coalesce(F.col(f"{tag}_{o}"), F.lit(0)) for o in "HSDI")
        p, r = F.try_divide(h.cast("double"), h + s + i), F.try_divide(h.cast("double"), h + s + d)
        f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
        out += [p.alias(f"P_{tag[:4]}"), r.alias(f"R_{tag[:4]}"), f1.alias(f"F1_{tag[:4]}")]
    return counts.select(*by, *out)


def all_metrics(pairs: DataFrame, by: Sequence[str] = ("uid",), normalise=None) -> DataFrame:
    """Word metrics and tag scores of each group of pairs (ref, hyp, language)."""
    words = word_metrics(aligned(pairs, normalise), by)
    return words.join(tag_scores(aligned(pairs, normalise, words_only=False), by), list(by), "left")


def fact_tables(pairs: DataFrame, systems: Mapping[str, object] | None = None, normalise=None, store: str | None = None) -> dict[str, DataFrame]:
    """samples, chunks and edits of one run, with its system key columns.

    With ``store``, a new folder that all executors share, the compared pairs are written there once, as nested rows, and
    the three tables are read off them in the JVM; else each table compares the texts itself.
    """
    rows = aligned(pairs, normalise)
    if store is not None:
        rows.write.parquet(store)
        rows = pairs.sparkSession.read.schema(rows.schema).parquet(store)
    made = {"samples": samples(rows), "chunks": chunks(rows), "edits": edits(rows)}
    return {k: attach_system(v, **(systems or {})) for k, v in made.items()}


def fact_tables_of(runs: Sequence[tuple[Mapping[str, object], DataFrame]], normalise=None, store: str | None = None) -> dict[str, DataFrame]:
    """samples, chunks and edits of several runs (system keys, pairs) as one table each. All runs name the same keys. With
    ``store`` each run's compared pairs are written once, to a folder of its own below it."""
    if not runs or any(set(keys) != set(runs[0][0]) for keys, _ in runs):
        raise ValueError("runs need the same system keys, and there must be one at least")
    made = [fact_tables(pairs, keys, normalise, f"{store}/run{k}" if store else None) for k, (keys, pairs) in enumerate(runs)]
    return {name: reduce(DataFrame.unionByName, [m[name] for m in made]) for name in made[0]}


def song_pairs(songs: DataFrame, segments: DataFrame) -> DataFrame:
    """Whole songs against their joined segments: (uid, sample_idx 0, ref, hyp, start 0, end duration)."""
    hyp = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n")
    joined = segments.groupBy("uid").agg(hyp.alias("hyp"))
    return songs.join(joined, "uid").select("uid", F.lit(0).alias("sample_idx"), F.col("text").alias("ref"), "hyp", F.lit(0.0).alias("start"), F.col("duration_secs").alias("end"))


def line_pairs(lines: DataFrame, segments: DataFrame, key: str = "uid", position: str = "pos") -> DataFrame:
    """Reference lines and segments paired by position within a key; what is left over on either side is dropped."""
    ref = lines.select(key, F.col(position).alias("sample_idx"), F.col("text").alias("ref"), *[c for c in ("start", "end") if c in lines.columns])
    return ref.join(segments.select(key, F.col(position).alias("sample_idx"), F.col("text").alias("hyp")), [key, "sample_idx"])
