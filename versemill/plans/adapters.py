"""Projections of the driver's tables onto the engine's data model, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table of few splits dealt out over the cores, for work that is Python's own: a small file's only task would do
    all of it. A table of many splits stays as it is, so nothing large is shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 4 * cores else rows


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed lines of songs: a user's events."""
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6 / 3600.0
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("song_id"), F.col("event_id").alias("line_idx"), F.concat("event_type", F.lit(" ")).alias("text"), start.alias("start"), (start + F.col("value") / 10.0).alias("end")
    )


LINES = """lines as (
  select user_id as song_id, event_id as line_idx, event_type || ' ' as text, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 / 3600.0 as s,
         (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 / 3600.0 + value / 10.0 as e from events
)"""


def tagged_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs with tagged lines, one for each user; each third is English."""
    line = F.struct("line_idx", "start", "end", "text", F.upper("text").alias("text_tagged"))
    rows = lines(spark, sf_dir).groupBy("song_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.max(F.when(F.col("end") - F.col("start") <= 30, F.col("end"))).alias("last"))
    return rows.select(
        F.concat(F.lit("user "), F.col("song_id").cast("string")).alias("name"), F.when(F.col("song_id") % 3 == 0, "en").otherwise("de").alias("language"),
        F.concat(F.lit("text "), F.col("song_id").cast("string")).alias("text_tagged"), F.concat(F.lit("audio/"), F.col("song_id").cast("string")).alias("audio_path"), (F.col("last") + 1).alias("duration_secs"),
        F.transform("lines", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["text_tagged"].alias("text_tagged"))).alias("lines"),
    )


def chunks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Alignment chunks: an order's items, with further columns by expression."""
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    return table(spark, sf_dir, "lineitem").select(
        F.when(kind == 0, "hit").when(kind == 1, "sub").when(kind == 2, "del").otherwise("ins").alias("typ"), F.col("l_quantity").cast("long").alias("len"), F.col("l_linestatus").alias("dataset"),
        F.col("l_returnflag").alias("audio"), F.when(F.col("l_linenumber") <= 3, "merged_line").otherwise("grouped_line").alias("level"), (F.col("l_suppkey") % 5).alias("iter_idx"),
        F.floor(F.col("l_quantity") * F.col("l_tax")).cast("long").alias("nl"), F.floor(F.col("l_quantity") * F.col("l_discount")).cast("long").alias("bv"),
        F.concat(F.lit("song"), (F.col("l_orderkey") % 97).cast("string")).alias("uid"),
        *map(F.expr, more),
    )


CHUNKS = """chunks as (
  select case (l_orderkey + l_linenumber) % 4 when 0 then 'hit' when 1 then 'sub' when 2 then 'del' else 'ins' end as typ, cast(l_quantity as bigint) as len, l_linestatus as dataset,
         l_returnflag as audio, case when l_linenumber <= 3 then 'merged_line' else 'grouped_line' end as level, l_suppkey % 5 as iter_idx,
         cast(floor(l_quantity * l_tax) as bigint) as nl, cast(floor(l_quantity * l_discount) as bigint) as bv, 'song' || cast(l_orderkey % 97 as varchar) as uid from lineitem
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with counts, one for each chunk, a tenth of a second for each word."""
    rows = chunks(spark, sf_dir)
    of = lambda t, c="len": F.when(F.col("typ") == t, F.col(c)).otherwise(0)
    counts = {t: of(t) for t in ("hit", "sub", "del", "ins")} | {f"{t}_{c}": of(t, c) for t in ("hit", "sub", "del") for c in ("nl", "bv")}
    out = rows.select("uid", "dataset", "audio", "level", "iter_idx", *[c.alias(n) for n, c in counts.items()], F.lit(0.0).alias("start"), (F.col("len") / 10.0).alias("end"))
    return out.withColumn("duration", F.col("end") - F.col("start"))


SAMPLES = (
    CHUNKS
    + """, samples as (
  select uid, dataset, audio, level, iter_idx, """
    + ", ".join(f"case when typ = '{t}' then len else 0 end as {t}" for t in ("hit", "sub", "ins"))
    + ", case when typ = 'del' then len else 0 end as del, "
    + ", ".join(f"case when typ = '{t}' then {c} else 0 end as {t}_{c}" for t in ("hit", "sub", "del") for c in ("nl", "bv"))
    + """, 0.0::double as t0, len / 10.0::double as t1, len / 10.0::double as duration from chunks
)"""
)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("song_id"), F.col("source").alias("dataset_id"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
        (F.col("n_chars").cast("double") / 15).alias("duration_secs"), "text",
    )


CATALOG = """songs as (
  select doc_id as song_id, source as dataset_id, lang as language, case when doc_id % 5 = 0 then 'test' else 'train' end as split, cast(n_chars as double) / 15 as duration_secs, text from documents
)"""


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("song_id"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, dataset, language, sample_idx, ref, hyp): each turn's words against the same with every 11th deleted, every 7th
    reversed and every 13th doubled."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    def heard(w, k):
        i = k + 1
        return F.when(i % 11 == 0, F.array().cast("array<string>")).when(i % 7 == 0, F.array(F.reverse(w))).when(i % 13 == 0, F.array(w, w)).otherwise(F.array(w))

    rows = spread(turns(spark, sf_dir)).withColumn("r", words).withColumn("h", F.flatten(F.transform("r", heard)))
    return rows.select(
        F.col("conv_id").alias("uid"), F.col("role").alias("dataset"), F.lit("en").alias("language"), F.col("turn").alias("sample_idx"), F.array_join("r", " ").alias("ref"), F.array_join("h", " ").alias("hyp"),
        F.lit(0.0).alias("start"), F.size("r").cast("double").alias("end"),
    )


PAIRS = r"""words as (
  select conv_id as uid, turn as sample_idx, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') as r from conversations
), pairs as (
  select uid, sample_idx, r, flatten(list_transform(r, lambda w, i: case when i % 11 = 0 then cast([] as varchar[]) when i % 7 = 0 then [reverse(w)] when i % 13 = 0 then [w, w] else [w] end)) as h from words
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame scores of recordings: an embedding's magnitudes."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("scores"))


ALIGNED = PAIRS + """, dp as materialized (
  select uid, sample_idx, 0 as i, range(0, len(h) + 1) as row from pairs
  union all
  select uid, sample_idx, i + 1, list_transform(range(1, len(b) + 1), lambda k: list_min(list_transform(range(1, k + 1), lambda j: b[j] + k - j))) from (
    select d.uid, d.sample_idx, d.i, list_prepend(d.i + 1, list_transform(range(1, len(p.h) + 1), lambda j: least(d.row[j] + case when p.h[j] = p.r[d.i + 1] then 0 else 1 end, d.row[j + 1] + 1))) as b
    from dp d join pairs p using (uid, sample_idx) where d.i < len(p.r)
  )
), back as (
  select uid, sample_idx, len(r) as i, len(h) as j, 0 as step, '' as typ, cast(null as varchar) as ref, cast(null as varchar) as hyp from pairs
  union all
  select uid, sample_idx, case when typ = 'ins' then i else i - 1 end, case when typ = 'del' then j else j - 1 end, step + 1, typ, case when typ <> 'ins' then r[i] end, case when typ <> 'del' then h[j] end from (
    select t.uid, t.sample_idx, t.i, t.j, t.step, p.r, p.h,
           case when t.i > 0 and t.j > 0 and a.row[t.j + 1] = b.row[t.j] + case when p.r[t.i] = p.h[t.j] then 0 else 1 end then case when p.r[t.i] = p.h[t.j] then 'hit' else 'sub' end
                when t.i > 0 and a.row[t.j + 1] = b.row[t.j + 1] + 1 then 'del' else 'ins' end as typ
    from back t join pairs p using (uid, sample_idx) join dp a on a.uid = t.uid and a.sample_idx = t.sample_idx and a.i = t.i
    left join dp b on b.uid = t.uid and b.sample_idx = t.sample_idx and b.i = t.i - 1 where t.i > 0 or t.j > 0
  )
), ops as (
  select uid, sample_idx, role as dataset, -step as k, typ, ref, hyp from back join (select conv_id as uid, turn as sample_idx, role from conversations) using (uid, sample_idx) where step > 0
)"""
