"""The contract of opaque per-item models (separation, transcription, decoding): a keyed map with cache and checks.

The model is an injected function over batches; this module gives it what a cluster needs: duplicate keys fail, finished
keys are skipped, results carry the key, and a run that is lost goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versemill.operators.catalog import assert_unique
from versemill.scratch import written


def cached_map(tasks: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str, done: DataFrame | None = None, key: str = "uid") -> DataFrame:
    """Results of ``model`` for all tasks: those in ``done`` are taken from there, the others are computed."""
    tasks = assert_unique(tasks, key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield model(f)

    if done is None:
        return tasks.mapInPandas(run, schema)
    fresh = tasks.join(done.select(key), key, "left_anti").mapInPandas(run, schema)
    return fresh.unionByName(done.join(tasks.select(key), key, "left_semi"))


def resumable_map(tasks: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str, store: str, key: str = "uid", partitions: int | None = None) -> DataFrame:
    """Results (``schema``, which has the key) of ``model`` for all tasks, kept in the folder ``store``.

    Each Spark task publishes its results by itself as soon as it is done, so what a run that fails or is killed had
    finished stays, and the next run computes the rest: the keys that an anti join with the store leaves. A task that is
    repeated writes the same file again. ``partitions`` deals the rest out, and so says how much a lost run loses at
    most. A task without results is kept too, as an empty list. Keys are unique, checked before anything runs; a null key
    fails; results of other keys in the store are left alone.
    """
    spark = tasks.sparkSession
    kinds = T.StructType.fromDDL(schema)
    fields = T.StructType([f for f in kinds if f.name != key])
    kept = T.StructType([kinds[key], T.StructField("results", T.ArrayType(fields))])
    done = spark.read.schema(kept).parquet(store) if _exists(spark, store) else spark.createDataFrame([], kept)
    named = tasks.where(F.when(F.col(key).isNull(), F.raise_error(F.lit("a task has no key")).cast("boolean")).otherwise(True))
    rest = assert_unique(named, key).join(done.select(key), key, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                made = model(f)
                by_key = {k: rows.drop(columns=key).to_dict("records") for k, rows in made.groupby(key, sort=False)}
                yield pd.DataFrame({key: f[key], "results": [by_key.get(k, []) for k in f[key]]})

    rest = rest.repartition(partitions, key) if partitions else rest
    # the second algorithm of Hadoop's committer moves a task's file into place when the task commits, not when the job does
    rest.mapInPandas(run, kept).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)
    found = spark.read.schema(kept).parquet(store).join(tasks.select(key), key, "left_semi")
    return found.select(key, F.explode("results").alias("r")).select(*[F.col(key) if f.name == key else F.col("r")[f.name].alias(f.name) for f in kinds])


def _exists(spark: SparkSession, path: str) -> bool:
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    return store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store)


def materialised(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``; made and written first if it isn't there, or if forced."""
    if force or not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def first_acceptable(candidates: str | Column, compression: float = 2.4, log_prob: float = -1.0, no_speech: float = 0.6) -> Column:
    """The decoding kept from an array of (temperature, text, compression_ratio, avg_logprob, no_speech_prob): the first, by
    temperature, that is neither repetitive nor improbable, else the last; silence is the empty text."""
    ordered = F.array_sort(candidates)
    silent = lambda c: c["no_speech_prob"] > no_speech
    fine = F.filter(ordered, lambda c: silent(c) | ((c["compression_ratio"] <= compression) & (c["avg_logprob"] >= log_prob)))
    kept = F.coalesce(F.get(fine, F.lit(0)), F.element_at(ordered, -1))
    return F.when(silent(kept), F.lit("")).otherwise(kept["text"])


def decoder_io(ids: str | Column, start: int, language: int, transcribe: int, no_timestamps: int, no_speech: int, end: int) -> tuple[Column, Column]:
    """(input, output) id arrays of a decoder: the special prefix, then the ids; the output is the input moved by one.
    Without ids the no-speech form is used."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    special = F.array(*[F.lit(x) for x in (start, language, transcribe, no_timestamps)])
    prefix = F.when(F.size(ids) > 0, special).otherwise(F.array(F.lit(start), F.lit(no_speech)))
    inputs = F.concat(prefix, ids)
    return inputs, F.concat(F.slice(inputs, 2, F.size(inputs)), F.array(F.lit(end)))


def padded(ids: str, length: Column, fill: int) -> Column:
    """An id array filled up to a length."""
    return F.concat(F.col(ids), F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(ids)).cast("int")))


def length_batches(rows: DataFrame, length: Column, size: int, key: str = "uid") -> DataFrame:
    """Adds batch, a number, and width, the greatest length in the batch: ``size`` rows that follow each other by (length, key).

    The order is that of a distributed sort, and a row's rank is its place in its range after the counts of the ranges
    before: no task sees more than a range or a batch. Filled up to ``width``, a batch holds little padding.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with_length = rows.withColumn("_length", length.cast("long"))
    ordered = with_length.repartitionByRange(parts, "_length", key).sortWithinPartitions("_length", key).withColumn("_id", F.monotonically_increasing_id())
    ordered = written(ordered.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = ordered.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select("_part", "_base")
    numbered = ordered.join(F.broadcast(base), "_part").withColumn("batch", F.floor((F.col("_base") + F.col("_place")) / size).cast("long"))
    return numbered.withColumn("width", F.max("_length").over(Window.partitionBy("batch"))).drop("_length", "_id", "_part", "_place", "_base")
