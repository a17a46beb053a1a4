"""Named queries over sources, catalogues, decoding results and streams, and the SQL that says the same."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.functions import text as tx
from versemill.operators import catalog as cat
from versemill.operators import pools
from versemill.operators.analytics import combined_wer
from versemill.plans import adapters as ad
from versemill.plans.registry import query, rounded
from versemill.sources import io
from versemill.streaming import live

LANGUAGES = ("english", "french", "german", "spanish", "italian")


def _annotations(spark, sf) -> DataFrame:
    """Line annotations: a conversation's turns, two to a verse, every fourth without words; the first four songs have
    the ids whose language is corrected."""
    turn, said = F.col("turn") * 10.0, F.when(F.col("turn") % 4 == 3, "<nl>...</nl>").otherwise(F.col("text"))
    line = F.struct("turn", F.floor(F.col("turn") / 2).cast("int").alias("index"), said.alias("text"), F.array(turn, turn + F.char_length("text") / 20.0).alias("time"))
    rows = ad.turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    ids = dict(enumerate(cat.LANGUAGE_OVERRIDES))
    number = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return rows.select(
        "conv_id", F.coalesce(F.element_at(number, F.col("conv_id").cast("int")), F.concat(F.lit("conv"), F.col("conv_id").cast("string"))).alias("id"),
        F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("conv_id") % len(LANGUAGES) + 1).cast("int")).alias("language"),
        F.transform("lines", lambda x: F.struct(x["index"].alias("index"), x["text"].alias("text"), x["time"].alias("time"))).alias("lines"),
    )


def _annotated(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _annotations(spark, sf)
    durations = rows.select(F.col("id").alias("song_id"), (F.size("lines") * 10.0).alias("duration_secs"))
    excluded = rows.where("conv_id % 11 = 5").select(F.col("id").alias("song_id"))
    return io.annotated_songs(rows.drop("conv_id"), durations, "d", excluded)


ANNOTATED = (
    "ids as (select distinct conv_id, case "
    + " ".join(f"when conv_id = {k} then '{v}'" for k, v in enumerate(cat.LANGUAGE_OVERRIDES))
    + f" else 'conv' || conv_id end as song_id, {list(LANGUAGES)}[conv_id % {len(LANGUAGES)} + 1] as name from conversations), songs as (select *, case "
    + " ".join(f"when song_id = '{k}' then '{v}'" for k, v in cat.LANGUAGE_OVERRIDES.items())
    + " "
    + " ".join(f"when name = '{k}' then '{v}'" for k, v in cat.LANGUAGE_CODES.items())
    + " end as language from ids where name <> 'italian' and conv_id % 11 <> 5), said as (select song_id, language, turn, turn // 2 as verse, case when turn % 4 = 3 then '<nl>...</nl>' else coalesce(text, '') end as text, "
    "turn * 10.0::double as s, turn * 10.0::double + length(coalesce(text, '')) / 20.0::double as e from conversations join songs using (conv_id))"
)


@query(
    f"with {ANNOTATED}, verses as (select song_id, language, verse, string_agg(text, chr(10) order by turn) as t, count(*) as n from said group by all) "
    "select song_id || '_d' as uid, 'd' as dataset_id, song_id, string_agg(t, chr(10) || chr(10) order by verse) as text, 'train' as split, sum(n) * 10.0::double as duration_secs, language, 'audio/' || song_id || '.mp3' as audio_path, "
    "cast(null as varchar) as stem_dir from verses group by song_id, language"
)
def annotated_songs(spark, sf):
    return _annotated(spark, sf)[0]


@query(
    rf"with {ANNOTATED}, numbered as (select *, row_number() over (partition by song_id order by turn) - 1 as line_idx from said) select song_id, cast(line_idx as int) as line_idx, s as start, round(e, 6) as "
    r""""end", trim(text, ' ') || chr(10) as text, cast(verse as int) as verse_index from numbered where e - s < 30 and regexp_matches(regexp_replace(text, '(?i)</?nl>', '', 'g'), '[\pL\pN\pM_]')"""
)
def annotated_lines(spark, sf):
    return rounded(_annotated(spark, sf)[1])


@query(
    "with lines as (select user_id, max(epoch_us(ts) - epoch_us(timestamp '2024-01-01')) as t, max(case when value / 10.0 <= 30 then (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 / 3600.0 + value / 10.0 end) + 1 as d from events group by user_id), "
    "kinds as (select * from (values ('a', ' '), ('b', '_')) k(dataset_id, mark)) select 'user' || mark || user_id || '_' || dataset_id as uid, dataset_id, 'user' || mark || user_id as song_id, 'text ' || user_id as text, 'test' as split, "
    "round(d, 6) as duration_secs, case when user_id % 3 = 0 then 'en' else 'de' end as language, 'audio/' || user_id as audio_path, case when dataset_id = 'a' then 'stems/user ' || user_id end as stem_dir "
    "from lines, kinds where dataset_id = 'a' or user_id % 3 = 0"
)
def extracted_songs(spark, sf):
    """Two datasets of different types through one reader for each, united."""
    rows = ad.tagged_catalogue(spark, sf)
    readers = {
        "stems": lambda df, name: io.tagged_songs(df, name, stem_dir=F.concat(F.lit("stems/"), "name"))[0],
        "tagged": lambda df, name: io.tagged_songs(df, name, ("en",), underscore=True)[0],
    }
    return rounded(io.extract({"a": ("stems", rows), "b": ("tagged", rows)}, readers))


@query(
    "with songs as (select conv_id, count(*) as n from conversations group by conv_id), s as (select *, case when conv_id % 11 = 5 then 'excluded' when conv_id % 7 = 2 then 'missing_audio' else 'found' end as status from songs) "
    "select status, count(*) as songs, cast(sum(case when status = 'found' then n end) as bigint) as lines from s group by status"
)
def folder_scan(spark, sf):
    """Annotations written as one compressed document a song, scanned beside a folder in which some songs lack their audio."""
    root, rows = _shared(spark), _annotations(spark, sf).withColumn("file", F.col("conv_id").cast("string"))
    once = ("mapreduce.fileoutputcommitter.algorithm.version", "2")  # tasks move their files themselves, not the driver one by one
    io.by_key(rows.select("file", F.to_json(F.struct("id", "language", "lines")).alias("value")), "file").write.partitionBy("file").option(*once).option("compression", "gzip").text(f"{root}/annotations")
    io.by_key(rows.where("conv_id % 7 <> 2").select("file", F.lit("sound").alias("value")), "file").write.partitionBy("file").option(*once).text(f"{root}/audio")
    excluded = rows.where("conv_id % 11 = 5").select(F.col("file").alias("song_id"))
    found = io.scan_annotations(spark, f"{root}/annotations", f"{root}/audio", excluded, "*.txt.gz", "*.txt", r"file=([^/]+)/")
    return found.groupBy("status").agg(F.count("*").alias("songs"), F.sum(F.size("lines")).alias("lines"))


@query(
    "select conv_id as uid, turn, role as speaker, cast(length(coalesce(text, '')) as bigint) as chars, 1 + (conv_id % 2) as attempt from conversations"
)
def resumed_map(spark, sf):
    """A keyed map of which a first run has made the even keys: the second makes the others, and both are read."""
    store, rows = _shared(spark), ad.turns(spark, sf)
    tasks = rows.groupBy(F.col("conv_id").alias("uid")).agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))

    def model(attempt: int):
        def measure(f: pd.DataFrame) -> pd.DataFrame:
            told = [(u, t["turn"], t["role"], len(t["text"]), attempt) for u, turns in zip(f["uid"], f["turns"], strict=True) for t in turns]
            return pd.DataFrame(told, columns=["uid", "turn", "speaker", "chars", "attempt"])

        return measure

    schema = "uid long, turn long, speaker string, chars long, attempt long"
    pools.resumable_map(tasks.where("uid % 2 = 0"), model(1), schema, store)
    return pools.resumable_map(tasks, model(2), schema, store)


def _shared(spark) -> str:
    return f"{io.shared_folder(spark)}/{uuid.uuid4().hex}"


@query("select n_nationkey as id, n_name as name, n_regionkey / 2.0::double as half from nation")
def json_lines(spark, sf):
    """Typed rows written as compressed JSON lines and read again."""
    path = _shared(spark)
    io.write_jsonl(ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") / 2).alias("half")), path)
    return io.read_jsonl(spark, path, "id long, name string, half double", partitions=2)


WER = "round(cast(sum(case when typ <> 'hit' then len else 0 end) as double) / nullif(sum(case when typ <> 'ins' then len else 0 end), 0), 6) as wer"


@query(f"with {ad.CHUNKS} select audio, dataset, {WER}, count(*) as chunks from chunks where audio in ('A', 'N') group by audio, dataset")
def run_tables(spark, sf):
    """Two runs written to partitions by their system, read as one table of which a filter prunes the third."""
    root, rows = _shared(spark), ad.chunks(spark, sf)
    for audio in ("A", "N", "R"):
        io.write_run({"chunks": cat.attach_system(rows.where(F.col("audio") == audio).drop("audio"), audio=audio)}, root, ("audio",))
    return rounded(io.read_runs(spark, root, "chunks").where("audio in ('A', 'N')").groupBy("audio", "dataset").agg(combined_wer().alias("wer"), F.count("*").alias("chunks")))


@query("select n_nationkey as id, n_name as name, 1 as version from nation")
def materialised_table(spark, sf):
    """A table that is made once: the second request reads what the first has written."""
    path, rows = _shared(spark), ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    pools.materialised(spark, path, lambda: rows.withColumn("version", F.lit(1)))
    return pools.materialised(spark, path, lambda: rows.withColumn("version", F.lit(2)))


@query("select distinct doc_id as song_id from labels where toxic = 1 or quality = 0")
def exclusion_union(spark, sf):
    none = F.array().cast("array<bigint>")
    own = lambda c: F.when(c, F.array("doc_id")).otherwise(none)
    reasons = ad.table(spark, sf, "labels").select(F.create_map(F.lit("toxic"), own(F.col("toxic") == 1), F.lit("poor"), own(F.col("quality") == 0)).alias("reasons"))
    return cat.exclusion_ids(reasons)


@query(f"with {ad.CATALOG} select song_id, dataset_id, 'original' as audio, 0 as iter_idx from songs order by song_id limit 5")
def debug_rows(spark, sf):
    rows = cat.attach_system(ad.catalog(spark, sf).select("song_id", "dataset_id"), audio="original", iter_idx=0)
    return cat.first_rows(rows, 5, "song_id")


@query(f"with {ad.CATALOG} select song_id, case song_id % 8 when 0 then 'en' when 1 then 'de' when 2 then 'fr' when 3 then 'es' when 5 then 'cs' when 6 then 'pt' when 7 then 'zh' end as code from songs")
def language_parts(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ("eng", "German", "FR", "spa", "klingon", "cze", "Portuguese", "zho"))), (F.col("song_id") % 8 + 1).cast("int"))
    return ad.catalog(spark, sf).select("song_id", tx.iso_part1(name).alias("code"))


@query(
    "with c as (select l_orderkey as k, l_linenumber / 10.0::double as t, cast(l_partkey as varchar) as text, l_quantity / 10 as cr, -l_discount * 20 as lp, l_tax * 10 as ns from lineitem), "
    "f as (select *, ns > 0.6::double as silent, ns > 0.6::double or (cr <= 2.4::double and lp >= -1.0::double) as fine from c), o as (select *, row_number() over (partition by k order by t, text, cr, lp, ns) as pos from f) "
    "select k as uid, case when silent then '' else text end as text from o qualify row_number() over (partition by k order by case when fine then 0 else 1 end, case when fine then pos else -pos end) = 1"
)
def decoding_choice(spark, sf):
    """The attempt kept of several at rising temperatures."""
    tried = F.struct(
        (F.col("l_linenumber") / 10.0).alias("temperature"), F.col("l_partkey").cast("string").alias("text"), (F.col("l_quantity") / 10).alias("compression_ratio"), (-F.col("l_discount") * 20).alias("avg_logprob"),
        (F.col("l_tax") * 10).alias("no_speech_prob"),
    )
    rows = ad.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(F.collect_list(tried).alias("tried"))
    return rows.select("uid", pools.first_acceptable("tried").alias("text"))


@query(
    "with i as (select o_orderkey as uid, list_transform(range(0, o_orderkey % 4), lambda x: x + o_custkey % 100) as ids from orders), p as (select uid, list_concat(case when len(ids) > 0 then [50258, 50259, 50359, 50363] else [50258, 50362] end, ids) as x from i) "
    "select uid, array_to_string(list_concat(x, list_transform(range(0, 8 - len(x)), lambda z: 50257)), ' ') as inputs, array_to_string(list_concat(list_concat(x[2:], [50257]), list_transform(range(0, 8 - len(x)), lambda z: -100)), ' ') as outputs from p"
)
def decoder_batches(spark, sf):
    """Inputs and outputs of a decoder, filled up to one length."""
    n = (F.col("o_orderkey") % 4).cast("int")
    ids = F.transform(F.slice(F.array(*map(F.lit, range(3))), F.lit(1), n), lambda x: (x + F.col("o_custkey") % 100).cast("int"))
    inputs, outputs = pools.decoder_io(ids, 50258, 50259, 50359, 50363, 50362, 50257)
    rows = ad.table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), inputs.alias("x"), outputs.alias("y"))
    joined = lambda c, fill: F.array_join(pools.padded(c, F.lit(8), fill).cast("array<string>"), " ")
    return rows.select("uid", joined("x", 50257).alias("inputs"), joined("y", -100).alias("outputs"))


@query(
    "with r as (select doc_id as uid, length(coalesce(text, '')) as length, row_number() over (order by length(coalesce(text, '')), doc_id) - 1 as k from documents) "
    "select uid, k // 32 as batch, max(length) over (partition by k // 32) as width, max(length) over (partition by k // 32) - length as padding from r"
)
def length_batches(spark, sf):
    """Documents in batches of 32 by length, filled up to the longest of each."""
    rows = ad.table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    return pools.length_batches(rows, F.col("length"), 32).select("uid", "batch", "width", (F.col("width") - F.col("length")).alias("padding"))


@query(
    f"with {ad.CHUNKS.replace(' from lineitem', ', l_shipdate as ts from lineitem')} select dataset, time_bucket(interval 28 days, ts, timestamp '1970-01-01') as start, count(*) as chunks, {WER} from chunks group by all"
)
def windowed_wer(spark, sf):
    made = live.windowed_wer(ad.chunks(spark, sf, "l_shipdate as ts"), width="28 days")
    return rounded(made.select("dataset", F.col("window.start").alias("start"), "chunks", "wer"))
