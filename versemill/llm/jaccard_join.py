"""Jaccard self-join of shingle sets: rare-first prefix filtering with length, positional and suffix filters.

1. Texts are written as compressed packs. Each pack sends its distinct shingles to hash buckets, as sorted, delta-coded
   arrays, and each bucket answers with the rank of each shingle: the logarithm of the number of texts that have it.
2. Shingles are ordered rarest first (by rank, then by hash). A text needs partners only for the shingles of its prefix that
   occur elsewhere, so most texts need none at all. What is left are postings (shingle, class, size, place); texts of one
   shingle set are one class, so copies are never joined with each other.
3. A shingle's postings are first paired with one head for each size range, the class whose shingles are most frequent: the
   text that a group of near copies comes from. So a group gives as many pairs as it has members.
4. Distinct pairs pass the length, positional and suffix filters (counts of shingles between fixed pivots bound the symmetric
   difference), and each is verified once on whole sets.
5. Links make components. Shingles whose classes are still in several components are paired again: with a few heads, one of
   a component, and at last all classes of different components. So no component is missed, and no group emits all its
   pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versemill.llm._common import NO_ID, SLICE_BYTES, Words, bucket_of, buckets_for, deflate, give_back, inflate, keyed_text, materialize, mix64, packs_of, text_key, text_slices, unpack, unused
from versemill.llm.components import connected_components

SHINGLE, PIVOTS = 5, 64
HEADS = (4, 16)  # heads of different components for each shared shingle, in the rounds between the first and the last
TOP_RANK = 40
BROADCAST_ROWS = 1_000_000
CLASS = "doc_id long, n int, digest long, pivots binary, tkey long"
POSTING = "token long, node long, n int, place int, weight int, band int"


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of the five-word shingles of each text; a shorter text is one shingle."""
    words = Words(texts, lower_ascii=True)
    at, value = words.windows(SHINGLE)
    bounds = np.searchsorted(at, words.first)
    out = []
    for d in range(len(texts)):
        a, b = words.first[d], words.first[d + 1]
        if b - a >= SHINGLE:
            out.append(np.unique(value[bounds[d] : bounds[d + 1]]))
        elif b > a:
            total = np.uint64(b - a)
            for h in words.hash[a:b]:
                total = mix64(np.asarray([total ^ h]))[0]
            out.append(np.asarray([total], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest_of(s: np.ndarray) -> int:
    return int(mix64(np.asarray([mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))])).view(np.int64)[0])


def required(n: int) -> int:
    """Shingles a set of n must share with any set it links to: 100 * shared >= 80 * union needs 5 * shared >= 4 * n."""
    return (4 * n + 4) // 5


class _Pack:
    """The shingle sets of the texts of one pack: a digest for each row, and the distinct sets that are not empty."""

    def __init__(self, blob: bytes, buckets: int):
        self.rows = unpack(blob)
        self.digests: list[int] = []
        self.sizes: list[int] = []
        self.sets: dict[int, np.ndarray] = {}
        at = 0
        while at < len(self.rows):
            end, size = at, 0
            while end < len(self.rows) and (end == at or size < SLICE_BYTES):
                size += len(self.rows[end][-1])
                end += 1
            for s in shingle_sets([r[-1] for r in self.rows[at:end]]):
                self.digests.append(digest_of(s))
                self.sizes.append(len(s))
                if len(s):
                    self.sets.setdefault(self.digests[-1], s)
            at = end
        every = np.concatenate([np.zeros(0, np.uint64), *self.sets.values()])
        # what a bucket sees of a shingle: 32 bits beside the bucket. A rare clash makes both seem more frequent, for all texts alike
        key = bucket_of(every, buckets) << np.uint64(32) | every & np.uint64(0xFFFFFFFF)
        self.each = key
        self.key, self.times = np.unique(key, return_counts=True)
        cuts = np.searchsorted(self.key >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        self.parts = [(int(b), slice(cuts[b], cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts))]

    def classes(self) -> list[tuple]:
        """(doc_id, n, digest, pivots, tkey) of each row."""
        pivots = {d: np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PIVOTS), 255).astype(np.uint8).tobytes() for d, s in self.sets.items()}
        return [(r[0], n, d, pivots.get(d, b""), r[1]) for r, n, d in zip(self.rows, self.sizes, self.digests, strict=True)]

    def values(self) -> list[tuple[int, bytes]]:
        """(bucket, its shingles in this pack with the number of sets that have them)."""
        low, times = self.key.astype(np.uint32), np.minimum(self.times, 65535).astype(np.uint16)
        return [(b, deflate(np.diff(low[p], prepend=np.uint32(0)), times[p])) for b, p in self.parts]

    def postings(self, ranks: dict[int, bytes]) -> pa.Table:
        """The shingles of each set's prefix that occur in other sets."""
        rank = np.zeros(len(self.key), np.uint8)
        for b, p in self.parts:
            rank[p] = inflate(ranks[b])[0]
        rank, at, found = rank[np.searchsorted(self.key, self.each)], 0, []
        for digest, s in self.sets.items():
            r = rank[at : at + len(s)]
            at += len(s)
            prefix = len(s) - required(len(s)) + 1
            if np.count_nonzero(r == 0) >= prefix:
                continue
            order = np.lexsort((s, r))[:prefix]
            place = np.flatnonzero(r[order])
            size = np.full(len(place), len(s), np.int32)
            found.append((s[order[place]].view(np.int64), np.full(len(place), digest, np.int64), size, place.astype(np.int32), np.full(len(place), 1000 * int(r.sum()) // len(s), np.int32)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32)]
        # sizes within 4 : 5 are in one band or in neighbours
        band = np.floor(np.log(np.maximum(columns[2], 1)) / np.log(1.25)).astype(np.int32)
        return pa.table(dict(zip(("token", "node", "n", "place", "weight", "band"), (*columns, band), strict=True)))


def _read(buckets: int):
    """A row for each text (kind 1), and for each bucket the shingles of the pack (kind 0)."""
    names = ["kind", "pack", "bucket", "blob", "doc_id", "n", "digest", "pivots", "tkey"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                read = _Pack(blob.as_py(), buckets)
                yield table([(1, None, None, None, *c) for c in read.classes()])
                yield table([(0, pack, *v, None, None, None, None, None) for v in read.values()])
                del read
        give_back()

    return run


def _rank(sent: pa.Table) -> pa.Table:
    """Answers each pack of a bucket with the ranks of its shingles: 0 for what one set alone has."""
    parts = [inflate(blob.as_py()) for blob in sent["blob"]]
    value = np.concatenate([np.cumsum(step, dtype=np.uint32) for step, _ in parts])
    times = np.concatenate([t for _, t in parts])
    order = np.argsort(value, kind="stable")
    start = np.flatnonzero(np.diff(value[order].astype(np.int64), prepend=-1))
    total = np.add.reduceat(times[order].astype(np.int64), start)
    rank = np.zeros(len(value), np.uint8)
    rank[order] = np.repeat(np.minimum(np.floor(np.log2(total)), TOP_RANK).astype(np.uint8), np.diff(np.append(start, len(value))))
    cuts = np.cumsum([len(step) for step, _ in parts])[:-1]
    answers = pa.array([deflate(r) for r in np.split(rank, cuts)], pa.binary())
    del parts, value, times, order, rank
    give_back()
    return pa.table({"pack": sent["pack"], "bucket": sent["bucket"], "ranks": answers})


def _suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps (a, b, na, nb, pa, pb) whose counts between pivots allow the needed overlap."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
        pivots = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, PIVOTS).astype(np.int64) for k in (4, 5)]
        apart = np.abs(pivots[0] - pivots[1]).sum(1)
        need = -(-4 * (na + nb) // 9)
        ok = pa.array((apart <= na + nb - 2 * need) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, set) of each text; 48 bits of a hash are kept, sorted and as steps."""
    for batch in batches:
        for _, texts in text_slices(batch.column(0), batch.column(1)):
            sets = shingle_sets(texts)
            blobs = [deflate(np.diff(s >> np.uint64(16), prepend=np.uint64(0))) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in sets], pa.int64()), pa.array(blobs, pa.binary())], ["node", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = (np.cumsum(inflate(v.as_py())[0], dtype=np.uint64) for v in (x, y))
            shared = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(9 * shared >= 4 * (len(p) + len(q)))
        ok = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, each verified once on whole sets."""
    side = lambda x: classes.select(F.col("digest").alias(x), F.col("n").alias(f"n{x}"), F.col("pivots").alias(f"p{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_suffix_filter, "a long, b long")
    set_of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    return materialize(near.join(set_of("a"), "a").join(set_of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long"))


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) of the linked nodes after more links: they are drawn between the components so far, so what is
    joined costs nothing."""
    if labels is None:
        return materialize(connected_components(links))
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    named = materialize(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    joined = connected_components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("now"))
    every = labels.union(named.select("a", "ca")).union(named.select("b", "cb")).distinct()
    return materialize(every.join(joined, "component", "left").select("node", F.coalesce("now", "component").alias("component")))


SHARED = ("node", "n", "place")
#: Length and positional filters for (n1, place1) and (n2, place2): sizes within 4 : 5, and enough shingles left from the
#: shared one on.
MAY_LINK = "5 * least(n1, n2) >= 4 * greatest(n1, n2) and 9 * least(n1 - place1, n2 - place2) >= 4 * (n1 + n2)"


def _pairs(x: DataFrame, y: DataFrame, on: list[str], apart: str) -> DataFrame:
    """Distinct pairs (a, b) of the classes that x and y bring together and that pass the filters."""
    met = x.join(y, on).where(f"{apart} and {MAY_LINK}")
    return met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def _side(postings: DataFrame, k: int, *more: str) -> DataFrame:
    return postings.select("token", *more, *[F.col(c).alias(f"{c}{k}") for c in SHARED])


def _with_first_heads(postings: DataFrame) -> DataFrame:
    """Pairs of each posting with the head of its shingle in its own band of sizes and in the bands beside it."""
    best = postings.groupBy("token", "band").agg(F.max(F.struct("weight", "node", "n", "place")).alias("head"))
    heads = best.select("token", "band", *[F.col(f"head.{c}").alias(f"{c}2") for c in SHARED])
    near = postings.select("token", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), *[F.col(c).alias(f"{c}1") for c in SHARED])
    return _pairs(near, heads, ["token", "band"], "node1 <> node2")


def _mixed(postings: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, int, int]:
    """Postings, with their component, of the shingles whose classes are in more than one component; how many these are,
    and how many pairs of postings lie across components."""
    named = postings.withColumn("component", F.col("node")) if labels is None else postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = named.groupBy("token", "component").agg(F.count("*").alias("k"))
    tokens = each.groupBy("token").agg(F.count("*").alias("parts"), F.sum("k").alias("k"), F.sum(F.col("k").cast("double") ** 2).alias("same")).where("parts > 1")
    tokens = materialize(tokens)
    mixed = materialize(named.join(tokens, "token", "left_semi"))
    pairs = tokens.agg(F.sum("k"), F.sum((F.col("k").cast("double") ** 2 - F.col("same")) / 2)).first()
    return mixed, int(pairs[0] or 0), int(pairs[1] or 0)


def _across(mixed: DataFrame, heads: int | None) -> DataFrame:
    """Pairs of classes of different components that share a shingle: with ``heads`` heads of each shingle, one of a
    component, or all."""
    every = _side(mixed, 1, F.col("component").alias("component1"))
    if heads is None:
        return _pairs(every, _side(mixed, 2, F.col("component").alias("component2")), ["token"], "component1 < component2")
    best = mixed.groupBy("token", "component").agg(F.max(F.struct("weight", "node", "n", "place")).alias("head"))
    order = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("head")))
    few = best.withColumn("order", order).where(F.col("order") <= heads)
    few = few.select("token", F.col("component").alias("component2"), *[F.col(f"head.{c}").alias(f"{c}2") for c in SHARED])
    return _pairs(every, few, ["token"], "component1 <> component2")


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document at a Jaccard similarity of 0.8 of five-word shingle sets.

    component_id is the smallest doc_id reachable by links. Null and wordless texts have no shingles and stay alone; a null
    doc_id stays null, comes after all others and is a component's id only where there is no other; repeated rows give repeated results; an empty table gives
    no rows; other columns are ignored.
    """
    known = _components_of_rows(docs)
    smallest = known.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return known.join(smallest, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _postings(packs: DataFrame, read: DataFrame, buckets: int) -> DataFrame:
    """Distinct postings of the prefix shingles that more than one class has in its prefix."""
    ranks = materialize(read.where("kind = 0").select("pack", "bucket", "blob").groupBy("bucket").applyInArrow(_rank, "pack long, bucket int, ranks binary"))

    def prefixes(own: pa.Table, answers: pa.Table) -> pa.Table:
        told = dict(zip(answers["bucket"].to_pylist(), answers["ranks"].to_pylist(), strict=True))
        out = pa.concat_tables([_Pack(blob.as_py(), buckets).postings(told) for blob in own["blob"]])
        give_back()
        return out

    every = materialize(packs.groupBy("pack").cogroup(ranks.groupBy("pack")).applyInArrow(prefixes, POSTING))
    # minima are aggregated before the shuffle, so a frequent shingle costs a row of each task
    shared = every.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    return materialize(every.join(shared, "token", "left_semi").distinct())


def _components_of_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_shingles, component) of every row: no component for a wordless text."""
    rows = keyed_text(docs)
    packs = packs_of(rows.select("doc_id", text_key().alias("tkey"), "text"))
    buckets = buckets_for(packs)
    read = materialize(packs.mapInArrow(_read(buckets), f"kind int, pack long, bucket int, blob binary, {CLASS}"))
    members = read.where("kind = 1").select("doc_id", "n", "digest", "pivots", "tkey")
    postings = _postings(packs, read, buckets)

    # what links are sought for: one text of each class that shares a prefix shingle with another
    sought = postings.select(F.col("node").alias("digest")).distinct()
    classes = materialize(members.join(sought, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("pivots").alias("pivots")))
    known_id = F.coalesce("doc_id", F.lit(NO_ID))  # a class of null ids is looked up in all rows without an id
    wanted = classes.select(known_id.alias("wanted")).distinct()
    texts = rows.join(F.broadcast(wanted) if classes.count() <= BROADCAST_ROWS else wanted, known_id == F.col("wanted"), "left_semi")
    # rows that repeat a doc_id may give a set more than once
    sets = materialize(texts.mapInArrow(_sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")))

    labels, stage = None, 0
    now = tested = materialize(_with_first_heads(postings))
    while not now.isEmpty():
        links = _links(now, classes, sets)
        joined = not links.isEmpty()
        if joined:
            labels = _relabel(labels, links)
        if stage is None:
            break
        if joined or not stage:
            mixed, rows_left, pairs_left = _mixed(postings, labels)
        # heads are worth a round where all pairs are more than theirs
        heads = HEADS[stage] if stage < len(HEADS) and pairs_left > HEADS[stage] * rows_left else None
        stage = None if heads is None else stage + 1
        now = materialize(_across(mixed, heads).join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(now)
    if labels is None:
        labels = classes.select(F.col("digest").alias("node"), F.col("digest").alias("component"))

    known = members.join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    # every empty set is a component of its own, told apart by the document's id
    return known.select("doc_id", "tkey", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "digest")).alias("component"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, with all columns, of each component: the first by (doc_id, text), null ids last, one of those that
    repeat both. A wordless or null text is a component of its own; an empty table gives no rows; other columns, whatever
    their names, are carried along."""
    known = _components_of_rows(docs)
    same = known.where("component is not null").groupBy("component", "doc_id", "tkey").agg(F.count("*").alias("rows"))
    least = same.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tkey", "rows")).alias("first")).select("first.doc_id", "first.tkey", (F.col("first.rows") > 1).alias("many"))
    alone = known.where("component is null").select("doc_id", "tkey", F.lit(False).alias("many")).distinct()
    id_, key, many, row = (unused(docs.columns, c) for c in ("kept_id", "kept_key", "kept_many", "kept_row"))
    keep = materialize(least.unionByName(alone).toDF(id_, key, many))

    def rows(keys: DataFrame, how: str) -> DataFrame:
        return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys[id_]) & (text_key() == keys[key]), how)

    kept = rows(keep.where(~F.col(many)), "left_semi")
    if keep.where(F.col(many)).isEmpty():
        return kept
    # partial aggregation: a row repeated very often does not meet in one task
    one = rows(keep.where(F.col(many)), "inner").groupBy(id_, key).agg(F.first(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return kept.unionByName(one)
