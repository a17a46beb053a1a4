"""Sources and sinks: schema-checked JSON lines, documents, partitioned fact tables, song catalogues, reports."""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versemill.functions.text import has_words
from versemill.operators import catalog, intervals
from versemill.scratch import shared_folder  # noqa: F401

LINE = "struct<start:double,end:double,text:string,text_tagged:string>"
SONG = "uid string, dataset_id string, song_id string, text string, split string, duration_secs double, language string, audio_path string, stem_dir string"
TAGGED_SONGS = f"name string, language string, text_tagged string, audio_path string, duration_secs double, lines array<{LINE}>"
ANNOTATIONS = "id string, language string, lines array<struct<index:int,text:string,time:array<double>>>"


def read_jsonl(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """Typed JSON lines, compressed or not; a row that does not fit the schema fails the read. A gzip file is one task, so
    ``partitions`` spreads what follows."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.repartition(partitions) if partitions else df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path)


def write_document(value: Mapping, path: str) -> None:
    """A small driver-side JSON document, indented by four."""
    Path(path).write_text(json.dumps(value, indent=4, ensure_ascii=False))


def write_run(tables: Mapping[str, DataFrame], root: str, keys: tuple[str, ...]) -> None:
    """samples, chunks and edits of a run, partitioned by its system keys."""
    for name, df in tables.items():
        df.write.mode("append").partitionBy(*keys).parquet(f"{root}/{name}")


def read_runs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One fact table of all runs: partition discovery adds the key columns, and filters on them prune folders."""
    return spark.read.parquet(f"{root}/{name}")


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key to tasks for all cores, for sinks that open a file for each key: dealt without a number, a table of
    few bytes is coalesced, and one task opens all files."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def _lines(songs: DataFrame) -> DataFrame:
    rows = songs.select("song_id", F.posexplode("lines").alias("line_idx", "line")).select("song_id", "line_idx", "line.*")
    return catalog.short_lines(catalog.use_tagged_text(rows))


def tagged_songs(source: DataFrame, dataset_id: str, languages: tuple[str, ...] = (), underscore: bool = False, newline: bool = False, stem_dir: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(songs, merged lines, grouped lines) of a catalogue with tagged lines (TAGGED_SONGS).

    ``underscore`` writes spaces of names as underscores, ``newline`` ends each line's text with a newline;
    ``stem_dir`` is the folder of a song's stems as a function of its row, where the catalogue has stems.
    """
    rows = source.where(F.col("language").isin(*languages)) if languages else source
    rows = rows.withColumn("song_id", F.translate("name", " ", "_") if underscore else F.col("name"))
    songs = rows.select(
        F.concat_ws("_", "song_id", F.lit(dataset_id)).alias("uid"), F.lit(dataset_id).alias("dataset_id"), "song_id", F.col("text_tagged").alias("text"), F.lit("test").alias("split"), "duration_secs",
        "language", "audio_path", (F.lit(None) if stem_dir is None else stem_dir).cast("string").alias("stem_dir"),
    )
    lines = _lines(rows)
    if newline:
        lines = lines.withColumn("text", catalog.with_trailing_newline())
    merged = intervals.merge_lines(lines, songs.select("song_id", F.col("duration_secs").alias("duration")))
    return songs, merged, intervals.group_lines(merged.withColumn("line_idx", F.col("island")))


def annotated_songs(annotations: DataFrame, durations: DataFrame, dataset_id: str, excluded: DataFrame | None = None, languages: tuple[str, ...] = ("en", "es", "de", "fr")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(songs, lines, grouped lines) of line annotations (ANNOTATIONS): exclusions and languages are filtered first, lines
    without words or of 30 s and longer go, texts are assembled by paragraph, and each song needs a duration."""
    rows = annotations.withColumnRenamed("id", "song_id")
    if excluded is not None:
        rows = catalog.without(rows, excluded)
    rows = catalog.with_language_codes(rows)
    if languages:
        rows = rows.where(F.col("language").isin(*languages))
    lines = rows.select("song_id", F.posexplode("lines").alias("line_idx", "l"))
    texts = catalog.paragraphs(lines.select("song_id", F.col("l.index").alias("verse_index"), F.col("line_idx").alias("position"), F.col("l.text").alias("text")))
    timed = lines.select("song_id", "line_idx", F.element_at("l.time", 1).alias("start"), F.element_at("l.time", 2).alias("end"), F.trim("l.text").alias("text"), F.col("l.index").alias("verse_index"))
    timed = catalog.short_lines(timed.where(has_words(F.col("text"))), inclusive=False).withColumn("text", F.concat("text", F.lit("\n")))
    songs = catalog.with_durations(rows.select("song_id", "language"), durations).join(texts, "song_id", "left").select(
        F.concat_ws("_", "song_id", F.lit(dataset_id)).alias("uid"), F.lit(dataset_id).alias("dataset_id"), "song_id", "text", F.lit("train").alias("split"), "duration_secs", "language",
        F.concat(F.lit("audio/"), "song_id", F.lit(".mp3")).alias("audio_path"), F.lit(None).cast("string").alias("stem_dir"),
    )
    return songs, timed, intervals.group_lines(timed)


@F.arrow_udf(T.StringType())
def _unzipped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for contents in batches:
        yield pa.array([None if c is None else gzip.decompress(c) for c in contents.to_pylist()], pa.binary()).cast(pa.string())


#: What the name of a file is an id by: all but its endings.
FILE_ID = r"([^/]+?)(?:\.[a-z0-9]+)*$"


def listed_files(spark: SparkSession, folder: str, glob: str, file_id: str = FILE_ID) -> DataFrame:
    """(song_id, path, content) of the files below a folder. A query that does not use ``content`` reads names only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", file_id, 1).alias("song_id"), "path", "content")


def scan_annotations(
    spark: SparkSession, folder: str, audio_folder: str, excluded: DataFrame | None = None, glob: str = "*.gz", audio_glob: str = "*.mp3", file_id: str = FILE_ID, observation: Observation | None = None
) -> DataFrame:
    """(song_id, status, id, language, lines) of a folder of compressed annotation documents (ANNOTATIONS), one a file.

    ``status`` is "excluded", else "missing_audio" where no file of the id lies in ``audio_folder``, else "found"; only found ones
    are opened up and parsed, by the executors; a document that does not fit the schema fails. The counters of an
    ``observation`` (excluded, missing_audio, found) are filled in as the rows are used, in the same pass.
    """
    audio = listed_files(spark, audio_folder, audio_glob, file_id).select("song_id").distinct().withColumn("_audio", F.lit(True))
    rows = listed_files(spark, folder, glob, file_id).join(audio, "song_id", "left")
    if excluded is not None:
        rows = rows.join(excluded.select("song_id").distinct().withColumn("_excluded", F.lit(True)), "song_id", "left")
    out = F.col("_excluded").isNotNull() if excluded is not None else F.lit(False)
    status = F.when(out, "excluded").when(F.col("_audio").isNull(), "missing_audio").otherwise("found")
    rows = rows.withColumn("status", status).withColumn("text", _unzipped(F.when(F.col("status") == "found", F.col("content"))))
    parsed = F.from_json("text", ANNOTATIONS, {"mode": "FAILFAST"})
    rows = rows.select("song_id", "status", parsed.alias("a")).select("song_id", "status", "a.*")
    return rows.observe(observation, *[F.count_if(F.col("status") == s).alias(s) for s in ("excluded", "missing_audio", "found")]) if observation is not None else rows


def write_summary(songs: DataFrame, folder: str) -> None:
    """The uids of an extract beside it, sorted, as lines of text in parts whose order is theirs."""
    songs.select("uid").sort("uid").write.mode("overwrite").text(f"{folder}/summary")


def extract(sources: Mapping[str, tuple[str, DataFrame]], readers: Mapping[str, Callable[[DataFrame, str], DataFrame]]) -> DataFrame:
    """Songs of several datasets: {dataset_id: (dataset type, rows)} through one reader for each type, united by name."""
    out: DataFrame | None = None
    for dataset_id, (kind, rows) in sources.items():
        if kind not in readers:
            raise ValueError(f"unknown dataset type {kind}")
        songs = readers[kind](rows, dataset_id)
        out = songs if out is None else out.unionByName(songs)
    if out is None:
        raise ValueError("no dataset is given")
    return out


def write_pages(pages: DataFrame, folder: str, key: str = "uid") -> None:
    """Pages (key, html) as text under key folders, written by the executors to a path that they share."""
    pages.select(key, F.col("html").alias("value")).write.mode("overwrite").partitionBy(key).text(folder)


def write_pictures(pictures: DataFrame, folder: str, key: str = "uid") -> None:
    """Pictures (key, svg) as text under key folders, beside the pages."""
    pictures.select(key, F.col("svg").alias("value")).write.mode("overwrite").partitionBy(key).text(folder)


def write_side_files(songs: DataFrame, rows: DataFrame, folder: str, key: str = "uid") -> None:
    """What lies beside the pages: song texts as text files, and render rows as JSON lines, each under key folders."""
    by_key(songs.select(key, F.coalesce("text", F.lit("")).alias("value")), key).write.mode("overwrite").partitionBy(key).text(f"{folder}/lyrics")
    by_key(rows, key).sortWithinPartitions(key, "line_no", "piece_idx").write.mode("overwrite").partitionBy(key).json(f"{folder}/alignments")


def summary_page(totals: DataFrame, songs: DataFrame, title: str, description: str = "", pages: str | None = None, key: str = "uid") -> str:
    """The summary page: a small aggregate and one row for each song, collected. With ``pages``, the folder of
    :func:`write_pages`, the keys of songs are links to theirs."""
    import html
    from urllib.parse import quote

    def cell(name: str, v: object) -> str:
        text = html.escape(f"{v:.4f}" if isinstance(v, float) else str(v))
        return f'<a href="{html.escape(pages)}/{quote(f"{key}={v}")}/">{text}</a>' if pages and name == key else text

    def table(df: DataFrame) -> str:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(c, r[c])}</td>" for c in df.columns) + "</tr>" for r in df.toLocalIterator())
        return f"<table><tr>{head}</tr>{body}</table>"

    return f"<!DOCTYPE html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>{html.escape(description)}</p>{table(totals)}{table(songs)}"


def latex_table(df: DataFrame, digits: int = 2, missing: str = "-", bold: Mapping[str, str] | None = None) -> str:
    """A LaTeX tabular of a small result. ``bold`` names, for columns, the column of flags that sets their values in bold;
    columns of flags are not shown."""
    bold = bold or {}
    shown = [c for c in df.columns if c not in bold.values()]

    def plain(v: object) -> str:
        if v is None:
            return missing
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("&", r"\&").replace("%", r"\%")

    strong = lambda text: rf"\textbf{{{text}}}"
    cell = lambda row, c: strong(plain(row[c])) if c in bold and row[bold[c]] else plain(row[c])
    line = lambda cells: " & ".join(cells) + r" \\"
    rows = [line(cell(row, c) for c in shown) for row in df.toLocalIterator()]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(shown)}}}", r"\toprule", line(strong(plain(c)) for c in shown), r"\midrule", *rows, r"\bottomrule", r"\end{tabular}"])


class Roots:
    """Folders below an output root that the environment names; an unset variable is an error when it is needed."""

    def __init__(self, data: str = "DATA_ROOT", output: str = "OUTPUT_DIR"):
        self._data, self._output = data, output

    @staticmethod
    def _named(variable: str) -> Path:
        if not (value := os.environ.get(variable)):
            raise RuntimeError(f"environment variable {variable} is not set")
        return Path(value)

    @property
    def data(self) -> Path:
        return self._named(self._data)

    def folder(self, name: str) -> Path:
        if name not in ("sep", "models", "render", "infer", "extract", "share"):
            raise ValueError(name)
        return self._named(self._output) / name
