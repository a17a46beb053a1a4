"""How far the sources of a language differ in their words, by a distributed sort and scans of its runs.

Each task counts the terms of its documents first, in partial runs: (lang, term, source, document), with how many documents
from that one on hold the term and how often. The runs are dealt by ranges of the whole sort key and sorted within each
range, so that even the run of one term of one source is split where it is long. A scan adds up each run of (lang, term)
that lies in one range; the first and last of a range may go on in its neighbours and are added up afterwards: there are
two to a range. Terms kept are joined with the totals of their groups, sorted again, and a second scan emits partial sums
of pairs of sources and the first few terms of each group.

All numbers are whole: shares are counted in billionths. Where only one of two sources has a term, or none, the
other's share is that of a term it lacks, the same for all such terms; so each term is compared only between sources that
hold it, and what the others add comes from how many terms a source has with each count.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.llm._common import give_back, materialize

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
HELD = 500_000  # partial runs that a task holds before it passes them on
PIECE = 1 << 20  # bytes of a text whose terms are listed at once
BROADCAST_GROUPS = 100_000
HELD_PAIRS = 1 << 20  # sums of pairs that a scan holds before it passes them on
#: A-Z in lower case, a-z and all bytes of other scripts as they are, anything else a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SALTS = 32
REPORT = ["lang", "source", "part", "item", "value", "rank"]
RUN = ["lang", "term", "source", "document", "docs", "n"]


def _terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in stretches that cut none."""
    data, at = text.encode("utf-8", "surrogatepass").translate(_FOLD), 0
    while len(data) - at > PIECE:
        end = data.find(b" ", at + PIECE)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def partial_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, source, document, docs, n): the runs that a task's documents make; ``document`` is one of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter, int]] = {}

        def told() -> pa.RecordBatch:
            rows: list[list] = [[] for _ in RUN]
            for (lang, source), (n, in_docs, document) in held.items():
                for column, values in zip(rows, ([lang] * len(n), n.keys(), [source] * len(n), [document] * len(n), map(in_docs.__getitem__, n), n.values()), strict=True):
                    column.extend(values)
            kinds = [pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]
            columns[1] = columns[1].cast(pa.string())
            return pa.RecordBatch.from_arrays(columns, RUN)

        size = 0
        for batch in batches:
            doc_id, texts, lang, source = batch.columns
            for d, t, *key in zip(doc_id.to_pylist(), texts, lang.to_pylist(), source.to_pylist(), strict=True):
                n, in_docs, _ = held.setdefault(tuple(key), (Counter(), Counter(), d))
                before, seen = len(n), set()
                for terms in _terms(t.as_py()):
                    n.update(terms)
                    seen.update(terms)
                in_docs.update(seen)
                size += len(n) - before
                if size >= HELD:
                    yield told()
                    held, size = {}, 0
        if size:
            yield told()
        give_back()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("doc_id"), text("text"), text("lang"), text("source"))
    return rows.mapInArrow(run, "lang string, term string, source string, document long, docs long, n long")


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first row does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _arrays(rows: pa.Table) -> list[pa.Array]:
    return [c.combine_chunks() for c in rows.columns]


def _whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """(rows, last) of a sorted stream, cut between terms. A term's rows of one source are added up where they meet, so that
    what is carried from batch to batch has a row for each source at most."""
    carried = None
    for batch in batches:
        rows = pa.table({c: batch.column(c) for c in ("lang", "term", "source", "docs", "n")}).combine_chunks()
        rows = pa.concat_tables([carried, rows]).combine_chunks() if carried is not None else rows
        if not rows.num_rows:
            continue
        lang, term, source, docs, n = _arrays(rows)
        first = _starts(lang, term, source)
        sums = [pa.array(np.add.reduceat(c.to_numpy(), first)) for c in (docs, n)]
        rows = pa.table([c.take(pa.array(first)) for c in (lang, term, source)] + sums, ["lang", "term", "source", "docs", "n"])
        last = int(_starts(*_arrays(rows)[:2])[-1])
        carried = rows.slice(last)
        if last:
            yield rows.slice(0, last), False
    if carried is not None:
        yield carried, True


def _added_up(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Runs of a range by (lang, term, source): those of terms in ``least`` documents, and those at either edge."""
    at_edge = True
    for rows, last in _whole_terms(batches):
        lang, term, source, docs, n = _arrays(rows)
        first = _starts(lang, term)
        edge = np.zeros(len(first), bool)
        edge[0], at_edge = at_edge, False
        edge[-1] |= last
        keep = edge | (np.add.reduceat(docs.to_numpy(), first) >= least)
        times = np.diff(np.append(first, len(lang)))
        of_row = np.repeat(keep, times)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(of_row)) for c in (lang, term, source, docs, n)] + [pa.array(np.repeat(edge, times)[of_row])], ["lang", "term", "source", "docs", "n", "edge"])


def kept_terms(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n): occurrences of each term that ``least`` documents of its language hold."""
    rows = materialize(partial_runs(docs))
    # a hash before the names: it sorts as a number, and ranges of it are even
    order = [F.xxhash64("lang", "term"), "lang", "term", "source", "document"]
    ordered = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    added = materialize(ordered.mapInArrow(lambda batches: _added_up(batches, least), "lang string, term string, source string, docs long, n long, edge boolean"))
    at_edges = added.where("edge").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    enough = at_edges.groupBy("lang", "term").agg(F.sum("docs").alias("_docs")).where(F.col("_docs") >= least).select("lang", "term")
    return materialize(added.where("not edge").select("lang", "term", "source", "n").unionByName(at_edges.join(enough, ["lang", "term"], "left_semi").select("lang", "term", "source", "n")))


def _shares(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / m), exactly, whatever the size of n."""
    if len(n) and int(n.max()) > (2**63 - 1) // SCALE - 2:
        return np.asarray([1 + SCALE * (int(a) + 2) // int(b) for a, b in zip(n, m, strict=True)], np.int64)
    return 1 + SCALE * (n + 2) // m


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def share(n: Column, m: Column) -> Column:
    """The same as a column expression, in decimals."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(F.lit(SCALE)) * wide(n + 2), wide(F.nullif(m, F.lit(0))))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are SCALE + 1 at most, so that the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _compared(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, part, item, value) of terms sorted by (lang, term, source): corrections of pairs, and first terms.

    A pair's correction at a term that both hold is f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), with p0 and q0 the shares of a
    term that they lack.
    """
    names = ["lang", "source", "part", "item", "value"]
    sums: dict[tuple[str, str, str], int] = defaultdict(int)
    best: dict[tuple[str, str], list] = defaultdict(list)

    def told() -> pa.RecordBatch:
        rows = [(lang, a, "pair", b, v) for (lang, a, b), v in sums.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 4 + [pa.int64()], strict=True)], names)

    def whole(rows: pa.Table) -> None:
        lang, term, source, n, m, of_lang = _arrays(rows)
        n, m, of_lang = (c.to_numpy() for c in (n, m, of_lang))
        first = _starts(lang, term)
        ends = np.append(first[1:], len(n))
        p, p0, q = _shares(n, m), _shares(np.zeros(len(n), np.int64), m), _shares(np.repeat(np.add.reduceat(n, first), ends - first), of_lang)
        names_ = source.to_pylist()
        # pairs of each term: rows one apart, two apart and so on, as far as the longest run of sources goes
        run = np.repeat(np.arange(len(first)), ends - first)
        codes = {s: k for k, s in enumerate(sorted(set(names_)))}
        code = np.asarray([codes[s] for s in names_], np.int64)
        lang_code = np.repeat(np.cumsum(np.isin(first, _starts(lang))), ends - first) if len(first) else run
        langs = lang.take(pa.array(_starts(lang))).to_pylist()
        for k in range(1, int((ends - first).max())):
            i = np.flatnonzero(run[k:] == run[:-k])
            j = i + k
            v = _apart(p[i], p[j]) - _apart(p[i], p0[j]) - _apart(p0[i], p[j]) + _apart(p0[i], p0[j])
            pair, at = np.unique((lang_code[i] * len(codes) + code[i]) * len(codes) + code[j], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, at, v)
            back = list(codes)
            for x, v in zip(pair.tolist(), total.tolist(), strict=True):
                x, b = divmod(x, len(codes))
                g, a = divmod(x, len(codes))
                sums[langs[g - 1], back[a], back[b]] += v
        f = np.where(p > q, _apart(p, q), -1)
        group = lang_code * len(codes) + code
        order = np.lexsort((-f, group))
        start = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        # of equals at the last place all are looked at: the order of texts decides, below
        limit = f[order][np.repeat(np.minimum(start + top - 1, np.append(start[1:], len(order)) - 1), np.diff(np.append(start, len(order))))]
        for at in order[(f[order] >= 0) & ((place < top) | (f[order] == limit))].tolist():
            key = (lang[at].as_py(), names_[at])
            best[key].append((-int(f[at]), term[at].as_py().encode("utf-8", "surrogatepass")))
        for key, rows_ in best.items():
            if len(rows_) > top:
                best[key] = heapq.nsmallest(top, rows_)

    carried = None
    for batch in batches:
        rows = pa.table(batch.columns, names=batch.schema.names)
        rows = (pa.concat_tables([carried, rows]) if carried is not None else rows).combine_chunks()
        if not rows.num_rows:
            continue
        last = int(_starts(*_arrays(rows)[:2])[-1])
        carried = rows.slice(last)
        if last:
            whole(rows.slice(0, last))
        if len(sums) >= HELD_PAIRS:
            yield told()
            sums.clear()
    if carried is not None:
        whole(carried)
    if sums:
        yield told()
    rows = [(lang, source, "term", term.decode("utf-8", "surrogatepass"), -v) for (lang, source), terms in best.items() for v, term in terms]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 4 + [pa.int64()], strict=True)], names)
    give_back()


def audit_sources(docs: DataFrame, least: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of each (lang, source) group: part ``pair`` has its divergence from each other
    source of the language, part ``term`` the ``top`` terms that it holds more of than the language does.

    Each row is a document, so repeated rows count again and null ids are rows like others. Null text, lang and source
    are the empty string, which is a language and a source of its own. A group without terms is compared with all others; a
    language without kept terms has pairs of value 0; a language of one source has no pairs; an empty table gives no rows;
    other columns are ignored.
    """
    kept = kept_terms(docs, least)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    per_lang = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("n"))
    v = F.coalesce("v", F.lit(0))
    groups = docs.select(name("lang"), name("source")).distinct().join(held, ["lang", "source"], "left").join(per_lang.select("lang", "v", F.col("n").alias("_all")), "lang", "left")
    groups = materialize(groups.select("lang", "source", v.alias("v"), (F.coalesce("n", F.lit(0)) + 2 * v).alias("m"), (F.coalesce("_all", F.lit(0)) + 2 * v).alias("of_lang")))
    few = groups.count() <= BROADCAST_GROUPS
    sized = F.broadcast(groups) if few else groups

    # a term has a row for each source at most, so its rows may meet in one task
    ready = kept.join(sized, ["lang", "source"]).select("lang", "term", "source", "n", "m", "of_lang")
    ready = ready.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lang", "term").sortWithinPartitions("lang", "term", "source")
    found = materialize(ready.mapInArrow(lambda batches: _compared(batches, top), "lang string, source string, part string, item string, value long"))

    # what a source's terms add against a source that lacks all of them, by how many terms it has with each count
    counts = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(sized, ["lang", "source"]).select("lang", "source", "n", "terms", "m")
    others = groups.select("lang", F.col("source").alias("item"), F.col("m").alias("m2"), "v")
    lacking = share(F.lit(0), F.col("m2"))
    own = counts.join(F.broadcast(others) if few else others, "lang").where("source <> item")
    alone = own.select("lang", "source", "item", (F.col("terms") * (apart(share(F.col("n"), F.col("m")), lacking) - apart(share(F.lit(0), F.col("m")), lacking))).alias("value"))
    base = groups.select("lang", "source", "m").join(F.broadcast(others) if few else others, "lang").where("source <> item")
    base = base.select("lang", "source", "item", F.when(F.col("v") == 0, 0).otherwise(F.col("v") * apart(share(F.lit(0), F.col("m")), lacking)).alias("value"))
    turned = lambda rows: rows.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    both = found.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = reduce(DataFrame.unionByName, [base, alone, turned(alone), both, turned(both)]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # each task of the scan has its own first terms: those of a group are cut down in parts before they meet
    salted = found.where("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    ordered = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", *by).orderBy(F.desc("value"), "item"))
    terms = salted.withColumn("rank", ordered("salt")).where(F.col("rank") <= top).withColumn("rank", ordered()).where(F.col("rank") <= top)
    told = [pairs.withColumn("part", F.lit("pair")).withColumn("rank", ordered()), terms]
    return told[0].select(*REPORT).unionByName(told[1].select(*REPORT))

