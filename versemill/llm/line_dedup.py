"""Line deduplication by a segment-partition edit join, with DataFrame functions only.

Two lines within ``edits`` edits share one of ``edits + 1`` segments of the shorter line, near the same place. Each line is
indexed by its segments and probes the indexes of its own and the next smaller lengths with the few substrings that can
match (position- and length-aware). Lines that meet are filtered by counts of their characters and verified with a banded
bit-parallel edit distance.

Frequent lines and segments never meet in one task: exact repeats are counted with partial aggregation, lines with very many
copies (a bounded number of them can exist) are indexed once only, and frequent segments are salted. Lines that share a
segment are first compared with the earliest of them, and only those that it does not decide with all earlier ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.llm._common import keyed_text, materialize, text_key, unused

EDITS, MIN_CHARS = 2, 1  # an empty line parts paragraphs and is never a repeat
SEGMENT_CHARS = 4  # k edits need k + 1 segments of so many characters at least: shorter lines have fewer edits, the shortest none
HOT_SHARE = 10_000  # a line or a key is hot if it is more than one in so many; no more than so many can be
KEY_SAMPLE = 64  # hot keys are found among those of one line in so many; they are salted, which changes no result
KEY_ROWS = 1_000_000  # a key of so many rows is hot whatever its share
SALT_ROWS = 20_000  # rows of a hot key that one task sorts, about
LEAST_SALTS = 64
BROADCAST_ROWS = 1_000_000


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, lines): ``tkey`` tells texts of one doc_id apart. An empty text is one empty line.

    The hash and the split stand below the generators that use them, or they would be made again for each line.
    """
    rows = keyed_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", text_key().alias("tkey"), F.split("text", "\n").alias("lines"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, line_no, line) of all lines."""
    return texts_of(docs).select("doc_id", "tkey", F.posexplode("lines").alias("line_no", "line"))


def judged(line: str = "line") -> Column:
    return F.char_length(line) >= MIN_CHARS


def allowed(size: Column, edits: int = EDITS) -> Column:
    """The edits within which a line meets a shorter one, or one as long, of ``size`` characters: none below two segments."""
    return F.least(F.lit(edits), F.greatest(F.lit(0), F.floor(size / SEGMENT_CHARS).cast("int") - 1))


def _identity(lines: DataFrame) -> DataFrame:
    """Adds a 128-bit identity (h1, h2) of each line's text."""
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), F.col("line")))


def _place() -> Column:
    """What orders lines: document, text, line number; a null doc_id comes after all others."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("tkey"), F.col("line_no"))


def probes(edits: int = EDITS) -> list[tuple[int, int, int, int, int]]:
    """(segments, segment, shift, characters that the indexed line is shorter by, whether it is a probe only) of all keys of a line.

    A line's own segments are both its index and its probes of lines as long at no shift. A probe's shift leaves few enough
    edits on either side of the segment.
    """
    every = [(edits + 1, i, shift, shorter) for shorter in range(edits + 1) for i in range(edits + 1) for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)]
    return [(*x, int(x[2:] != (0, 0))) for x in every]


def keys_of(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key, id): the keys of lines (line, size, id). The lowest bit of a row's id says whether it is a probe only.

    One generator over constant lists: the expression for one key is small enough to be compiled, that for all is not. Lines
    too short for all edits, and those that reach down to such, carry the keys for fewer edits too.
    """
    names = ("n", "i", "shift", "shorter", "probe")
    spec = lambda some: F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, x, strict=True)]) for x in some])
    every = spec([x for e in range(1, edits + 1) for x in probes(e)])
    keys = F.when(F.col("size") >= SEGMENT_CHARS * (edits + 1) + edits, spec(probes(edits))).otherwise(every)
    rows = lines.where(F.col("size") >= 2 * SEGMENT_CHARS).select("line", "size", "id", F.explode(keys).alias("s"))
    rows = rows.select("line", "size", "id", "s.n", "s.i", "s.shift", "s.probe", (F.col("size") - F.col("s.shorter")).alias("length"))
    rows = rows.where(allowed(F.col("length"), edits) == F.col("n") - 1)
    rows = rows.withColumn("base", F.expr("cast(length div n as int)")).withColumn("longer", F.greatest(F.lit(0), F.col("i") - (F.col("n") - (F.col("length") - F.col("base") * F.col("n")))))
    # the last segments take the remainder: segment i is longer by one if i is not before the first of them
    start = F.col("base") * F.col("i") + F.col("longer") + F.col("shift")
    width = F.col("base") + F.when(F.col("i") >= F.col("n") - (F.col("length") - F.col("base") * F.col("n")), 1).otherwise(0)
    rows = rows.select("line", "size", "id", "i", "probe", "length", start.alias("start"), width.alias("width")).where((F.col("start") >= 0) & (F.col("start") + F.col("width") <= F.col("size")))
    return rows.select(F.xxhash64(F.substring(F.col("line"), F.col("start") + 1, F.col("width")), "length", "i").alias("key"), F.col("id").bitwiseOR(F.col("probe").cast("long")).alias("id"))


CLASSES = 16


def character_counts() -> list[Column]:
    """How often each of some classes of characters is in the line. An edit moves these counts by two in all, at most.

    A character stands for its last UTF-8 byte, which tells apart the letters of any script; its class is that modulo CLASSES.
    """
    last_bytes = F.regexp_replace(F.decode(F.encode("line", "UTF-8"), "ISO-8859-1"), "[\\xC0-\\xFF][\\x80-\\xBF]*([\\x80-\\xBF])", "$1")
    of_class = ["".join(chr(b) for b in range(0x20, 0xC0) if b % CLASSES == k) for k in range(CLASSES)]
    return [(F.char_length("line") - F.char_length(F.translate(last_bytes, chars, ""))).alias(f"n_{k}") for k, chars in enumerate(of_class)]


def _mask(ys: Column, c: Column, i: Column, edits: int, spread: int) -> Column:
    """The diagonals on which character ``c`` at ``i`` equals a character of ``ys``, in every lane."""
    bits = [F.when(F.get(ys, i + d) == c, F.lit(spread << d).cast("long")).otherwise(F.lit(0).cast("long")) for d in range(2 * edits + 1)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def within(x: Column, y: Column, most: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance of two lines is ``most`` (0 to ``edits``, which is 4 at most) or less.

    A banded bit-parallel automaton: a lane of bits for each number of edits holds the diagonals, ``edits`` to either side of
    the main one, that are reached. One step for each character of x moves all lanes at once, by a mask of the diagonals on
    which that character equals y's.
    """
    lane, band = 2 * edits + 2, (1 << (2 * edits + 1)) - 1
    spread = sum(1 << (lane * e) for e in range(edits + 1))
    long = lambda v: F.lit(v).cast("long")
    chars = lambda s: F.split(s, "")
    edge = F.array(*[F.lit("")] * edits)  # equals no character
    padded = F.concat(edge, chars(y), edge)

    def inserted(s: Column) -> Column:
        """One more character of y skipped, for an edit."""
        return s.bitwiseOR(F.shiftleft(s, lane + 1).bitwiseAND(long(band * spread)))

    def step(s: Column, mask: Column) -> Column:
        replaced_or_deleted = F.shiftleft(s.bitwiseOR(F.shiftright(s, 1)), lane)
        out = s.bitwiseAND(mask).bitwiseOR(replaced_or_deleted).bitwiseAND(long(band * spread))
        for _ in range(edits):
            out = inserted(out)
        return out

    start = sum(1 << (lane * e + edits + e) for e in range(edits + 1))
    with_y = F.transform(F.array(padded), lambda ys: F.transform(chars(x), lambda c, i: _mask(ys, c, i, edits, spread)))
    end = F.aggregate(F.get(with_y, F.lit(0)), long(start), step)
    lanes = F.get(F.array(*[long(sum(1 << (lane * e) for e in range(k + 1))) for k in range(edits + 1)]), most)
    shift = F.char_length(y) - F.char_length(x) + edits
    return (F.abs(F.char_length(y) - F.char_length(x)) <= edits) & (end.bitwiseAND(F.call_function("shiftleft", lanes, shift)) != 0)


def hot_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(key, salts) of the keys that more than one in HOT_SHARE rows have, or more than KEY_ROWS rows, by the keys of one line
    in KEY_SAMPLE; ``salts`` grows with a key's rows."""
    some = materialize(keys_of(lines.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(KEY_SAMPLE)) == 0), edits).groupBy("key").count())
    total = some.agg(F.sum("count")).first()[0] or 0
    salts = F.greatest(F.lit(LEAST_SALTS), F.ceil(F.col("count") * KEY_SAMPLE / SALT_ROWS)).cast("int")
    return materialize(some.where(F.col("count") > min(max(100, total // HOT_SHARE), KEY_ROWS // KEY_SAMPLE)).select("key", salts.alias("salts")))


def near_lines(docs: DataFrame, counts: DataFrame, total: int, edits: int = EDITS) -> DataFrame:
    """(h1, h2) of the lines that come after a different line within the edits allowed. ``counts`` has (h1, h2, first, n) of
    all judged lines, ``total`` is the sum of n."""
    lines = _identity(lines_of(docs).where(F.char_length("line") >= 2 * SEGMENT_CHARS))
    hot = counts.where(F.col("n") > max(1000, total // HOT_SHARE)).select("h1", "h2", "first")
    once = lines.join(F.broadcast(hot), ["h1", "h2"], "left").where(F.col("first").isNull() | (F.col("first") == _place()))  # hot has HOT_SHARE rows at most
    once = once.select("line", F.char_length("line").alias("size"), F.shiftleft("h1", 1).alias("id"))
    often = hot_keys(once, edits)
    rows = keys_of(once, edits)
    if often.isEmpty():
        rows = rows.select("*", F.lit(None).cast("boolean").alias("often"), F.lit(0).alias("salt"))
    else:
        few = often.count() <= BROADCAST_ROWS  # a million keys of a million rows each are a trillion rows
        rows = rows.join(F.broadcast(often) if few else often, "key", "left").select("key", "id", F.col("salts").isNotNull().alias("often"), F.coalesce(F.pmod("id", "salts"), F.lit(0)).alias("salt"))

    by = Window.partitionBy("key", "salt")
    own = F.col("id").bitwiseAND(F.lit(1).cast("long")) == 0
    line_id = F.shiftrightunsigned("id", 1)
    met = rows.select("key", "id", "often", F.min(line_id).over(by).alias("lo"), F.max(line_id).over(by).alias("hi"), F.max(own).over(by).alias("indexed"))
    # an index row of a line and a row of another line; the parts of a salted key are not judged one by one
    met = materialize(met.where("often or (indexed and lo <> hi)").groupBy("key", line_id.alias("line_id")).agg(F.max(own).alias("own")))
    ids = materialize(met.select("line_id").distinct())
    known = lines.withColumn("line_id", F.shiftrightunsigned(F.shiftleft("h1", 1), 1))
    known = known.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "line_id", "left_semi").groupBy("line_id", "h1", "h2", "line").agg(F.min(_place()).alias("first"))
    known = materialize(known.select("*", F.char_length("line").alias("size"), *character_counts()))
    counted = [f"n_{k}" for k in range(CLASSES)]
    carried = ("h1", "h2", "first", "size", *counted)
    signed = materialize(met.join(known.select("line_id", *carried), "line_id").select("key", "own", *carried))

    def side(rows: DataFrame, k: str, *more: str) -> DataFrame:
        return rows.select("key", *[F.col(c).alias(f"{c}_{k}") for c in (*carried, *more)])

    moved = reduce(Column.__add__, [F.abs(F.col(f"{c}_x") - F.col(f"{c}_y")) for c in counted])
    size = F.least("size_x", "size_y")
    maybe = (F.col("first_x") < F.col("first_y")) & (F.abs(F.col("size_x") - F.col("size_y")) <= edits) & (moved <= 2 * allowed(size, edits))
    names = ["h1_x", "h2_x", "h1_y", "h2_y"]
    line = lambda k: known.select(*[F.col(c).alias(f"{c}_{k}") for c in ("h1", "h2", "line")])

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(line("x"), ["h1_x", "h2_x"]).join(line("y"), ["h1_y", "h2_y"])
        most = allowed(F.least(F.char_length("line_x"), F.char_length("line_y")), edits)
        return materialize(both.where(within(F.col("line_x"), F.col("line_y"), most, edits)).select(F.col("h1_y").alias("h1"), F.col("h2_y").alias("h2")).distinct())

    # the earliest line of each key, by partial aggregation, decides most of what a template repeats
    heads = signed.groupBy("key").agg(F.min(F.struct("first", *[c for c in carried if c != "first"])).alias("head")).select("key", "head.*")
    tested = materialize(side(heads, "x").join(side(signed, "y"), "key").where(maybe).select(*names).distinct())
    decided = near(tested)
    undecided = signed.join(decided, ["h1", "h2"], "left_anti")
    rest = side(signed, "x", "own").join(side(undecided, "y", "own"), "key").where((F.col("own_x") | F.col("own_y")) & maybe).select(*names).distinct()
    return decided.unionByName(near(materialize(rest.join(tested, names, "left_anti"))))


def removed_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, tkey, n_lines, removed): the numbers, from 0, of the lines of each text that go, ascending.

    A line of any length but zero goes if an equal line, or one within the edits allowed (``edits`` from 12 characters of the
    shorter line on, one from 8), comes before it in the order of (doc_id, text, line number); empty lines stay. Lines are judged on the input, not on what is left.
    """
    lines = _identity(lines_of(docs))
    counts = materialize(lines.where(judged()).groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    near = near_lines(docs, counts, total, edits).withColumn("near", F.lit(True))
    verdict = counts.join(near, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    own = lines.where(judged()).select("h1", "h2", "doc_id", "tkey", "line_no")
    gone = own.join(verdict, ["h1", "h2"]).where(F.col("near") | (F.col("first") != _place())).select("doc_id", "tkey", F.lit(None).cast("int").alias("n_lines"), "line_no")
    # a row for each text, so that texts of which nothing goes are told too
    every = texts_of(docs).select("doc_id", "tkey", F.size("lines").alias("n_lines"), F.lit(None).cast("int").alias("line_no")).unionByName(gone)
    return every.groupBy("doc_id", "tkey").agg(F.max("n_lines").cast("long").alias("n_lines"), F.array_sort(F.collect_set("line_no")).alias("removed"))


def dedup_report(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed_lines) of each distinct (doc_id, text).

    Null text is the empty text, which is one empty line; rows that repeat both doc_id and text are one document; other
    texts of a doc_id are documents of their own; a null doc_id comes last; an empty table gives no rows; other columns are
    ignored.
    """
    return removed_lines(docs, edits).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def remove_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs``, all columns, with the removed lines gone from text. A document of which no line is left goes with them;
    documents that lose nothing stay as they are. A column n_chars, if there is one, follows the text.

    Null texts stay null; a null doc_id comes last; rows that repeat doc_id and text lose the same lines; an empty table
    gives no rows; other columns, whatever their names, are carried along.
    """
    gone = materialize(removed_lines(docs, edits).where(F.size("removed") > 0).select("doc_id", "tkey", "removed"))
    id_, key, removed = (unused(docs.columns, c) for c in ("gone_id", "gone_key", "gone_lines"))
    gone = gone.toDF(id_, key, removed)
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (text_key() == F.col(key)), "left")
    lines = F.split("text", "\n")
    kept = F.filter(F.transform(lines, lambda line, i: F.when(~F.array_contains(removed, i), line)), lambda line: line.isNotNull())
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(removed).isNull(), docs["n_chars"]).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    return joined.where(F.col(removed).isNull() | (F.size(removed) < F.size(lines))).select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])
