"""Catalogue operators: filters, recodings, exclusions, durations, paragraph assembly and training records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versemill.functions.text import clean_text

# Language names of annotations, and corrections of single entries.
LANGUAGE_CODES = {"english": "en", "french": "fr", "german": "de", "spanish": "es"}
LANGUAGE_OVERRIDES = {
    "3f95c86b880d483d905f20ec35e336fa": "de",
    "91885c30b8bb4847ac220e4ed36e96c3": "de",
    "efbc7553da754f28ba888c089216a731": "de",
    "f4f69b23ab9f4add9274fd712c75ff4": "fr",
}
SAMPLE_RATE = 16_000


def select_songs(songs: DataFrame, datasets: Sequence[str] = (), splits: Sequence[str] = (), langs: Sequence[str] = ()) -> DataFrame:
    """Conjunction of IN-filters; an empty list filters nothing."""
    for column, allowed in (("dataset_id", datasets), ("split", splits), ("language", langs)):
        if allowed:
            songs = songs.where(F.col(column).isin(*allowed))
    return songs


def last_by_uid(songs: DataFrame, uid: str = "uid", position: str = "position") -> DataFrame:
    """One row for each uid, that of the greatest position."""
    newest = F.row_number().over(Window.partitionBy(uid).orderBy(F.desc(position)))
    return songs.withColumn("_newest", newest).where("_newest = 1").drop("_newest")


def uid(song_id: str = "song_id", dataset_id: str = "dataset_id") -> Column:
    return F.concat_ws("_", F.col(song_id).cast("string"), dataset_id)


def recode(column: str, mapping: Mapping[str, str], keep_other: bool = True) -> Column:
    """Values replaced by a small mapping; others stay, or become null."""
    if not mapping:
        return F.col(column) if keep_other else F.lit(None).cast("string")
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.element_at(pairs, F.col(column))
    return F.coalesce(found, F.col(column)) if keep_other else found


def with_language_codes(songs: DataFrame, name: str = "language", song_id: str = "song_id") -> DataFrame:
    """Language names become codes and rows of other languages go; listed songs get their corrected code."""
    override = recode(song_id, LANGUAGE_OVERRIDES, keep_other=False)
    coded = songs.withColumn(name, recode(name, LANGUAGE_CODES, keep_other=False)).where(F.col(name).isNotNull())
    return coded.withColumn(name, F.coalesce(override, F.col(name)))


def exclusion_ids(reasons: DataFrame, reason_map: str = "reasons") -> DataFrame:
    """Distinct ids of a map of reason to id list."""
    return reasons.select(F.explode(reason_map).alias("reason", "ids")).select(F.explode("ids").alias("song_id")).distinct()


def without(songs: DataFrame, ids: DataFrame, key: str = "song_id") -> DataFrame:
    """Left anti join. Catalyst broadcasts the ids if their size allows."""
    return songs.join(ids.select(key).distinct(), key, "left_anti")


def with_durations(songs: DataFrame, durations: DataFrame, key: str = "song_id") -> DataFrame:
    """Adds duration_secs; a song without one fails the query."""
    found = songs.join(durations.select(key, F.col("duration_secs").alias("_duration")), key, "left")
    missing = F.raise_error(F.concat(F.lit("duration not found for id "), F.col(key).cast("string"))).cast("double")
    return found.withColumn("duration_secs", F.coalesce("_duration", missing)).drop("_duration")


def scan_counters(songs: DataFrame, excluded: DataFrame, has_audio: Column, key: str = "song_id") -> DataFrame:
    """How many songs are excluded, of the others how many lack audio, and how many there are."""
    marked = songs.join(excluded.select(key).distinct().withColumn("_excluded", F.lit(True)), key, "left")
    out = F.coalesce("_excluded", F.lit(False))
    return marked.agg(F.count_if(out).alias("excluded"), F.count_if(~out & ~has_audio).alias("missing_audio"), F.count("*").alias("total"))


def assert_unique(df: DataFrame, key: str = "uid") -> DataFrame:
    """The rows as they are, failing the query where a key repeats.

    Keys alone are counted, with partial aggregation, in a scalar subquery that runs before the rows are read: no row is
    shuffled or held for it, and nothing is written before it is known.
    """
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    worst = n.agg(F.max(F.struct("n", F.col(key).cast("string").alias("key"))).alias("worst")).scalar()
    return df.where(F.when(worst["n"] > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.coalesce(worst["key"], F.lit("null")))).cast("boolean")).otherwise(True))


def paragraphs(lines: DataFrame, song: str = "song_id", verse: str = "verse_index", position: str = "position", text: str = "text") -> DataFrame:
    """Song texts: lines of a verse joined by a newline in input order, verses in order joined by an empty line."""
    joined = lambda items: F.array_join(F.transform(F.array_sort(items), lambda x: x["t"]), "\n")
    verses = lines.groupBy(song, verse).agg(joined(F.collect_list(F.struct(F.col(position).alias("k"), F.coalesce(text, F.lit("")).alias("t")))).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(verse).alias("k"), "t"))), lambda x: x["t"]), "\n\n")
    return verses.groupBy(song).agg(whole.alias("text"))


def audio_path(source: str, audio_path: str = "audio_path", stem_dir: str = "stem_dir", separated_root: str = "sep") -> Column:
    """Where a song's audio lies: the original, the vocal stem (an error without a stem folder), or a separation's output."""
    if source == "original":
        return F.col(audio_path)
    if source == "vocal_stem":
        return F.when(F.col(stem_dir).isNull(), F.raise_error(F.lit("song has no stem folder")).cast("string")).otherwise(F.concat_ws("/", stem_dir, F.lit("vocals.wav")))
    return F.concat_ws("/", F.lit(separated_root), F.lit(source), F.col("dataset_id"), F.concat("uid", F.lit(".mp3")))


def to_samples(seconds: str | Column, rate: int = SAMPLE_RATE) -> Column:
    """Seconds to sample numbers, truncated toward zero."""
    return (F.col(seconds) if isinstance(seconds, str) else seconds).__mul__(F.lit(rate)).cast("long")


def clip_timestamps(segments: str = "segments", rate: int = SAMPLE_RATE) -> Column:
    """[s1, e1, s2, e2, ...] in seconds from an array of (start, end) in samples."""
    return F.flatten(F.transform(segments, lambda s: F.array(s["start"] / F.lit(float(rate)), s["end"] / F.lit(float(rate)))))


def use_tagged_text(lines: DataFrame) -> DataFrame:
    return lines.drop("text").withColumnRenamed("text_tagged", "text")


def short_lines(lines: DataFrame, longest: float = 30.0, inclusive: bool = True) -> DataFrame:
    """Lines of at most ``longest`` seconds, or shorter than that."""
    span = F.col("end") - F.col("start")
    return lines.where(span <= longest if inclusive else span < longest)


def with_trailing_newline(text: str = "text") -> Column:
    return F.when(F.col(text).endswith("\n"), F.col(text)).otherwise(F.concat(text, F.lit("\n")))


def to_records(lines: DataFrame, excluded: DataFrame | None = None, path: Column | None = None) -> DataFrame:
    """Training records of grouped lines (song_id, dataset_id, language, audio_path, start, end, text): cleaned text, without
    empty texts, without spans that do not advance, and without excluded songs."""
    rows = lines if excluded is None else without(lines, excluded)
    records = rows.select((F.col("audio_path") if path is None else path).alias("audio_path"), clean_text(F.col("text")).alias("text"), "start", "end", F.col("dataset_id").alias("dataset"), "language")
    return records.where((F.col("text") != "") & (F.col("end") > F.col("start")))


def attach_system(df: DataFrame, **keys: object) -> DataFrame:
    """Adds a run's key columns as literals."""
    return df.withColumns({k: F.lit(v) for k, v in keys.items()})


def first_rows(df: DataFrame, n: int = 5, position: str = "position") -> DataFrame:
    """The first rows by position: a debugging aid."""
    return df.orderBy(position).limit(n)
