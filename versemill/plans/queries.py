"""Named queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versemill.functions import alignment as al
from versemill.functions import text as tx
from versemill.operators import analytics as an
from versemill.operators import catalog as cat
from versemill.operators import evaluation as ev
from versemill.operators import intervals as iv
from versemill.operators import pools, render, tasks, vad
from versemill.plans import adapters as ad
from versemill.plans import source_queries, text_queries  # noqa: F401  they register their queries
from versemill.plans.registry import QUERIES, SQL, query, rounded  # noqa: F401
from versemill.sources import io
from versemill.streaming import live

SUMS = ", ".join(f"sum({c}) as {c}" for c in ("hit", "sub", "ins", "del", "hal", "del_nl", "del_bv"))
RATE = lambda top: f"round(({top}) * 100.0 / nullif(sub + hit + del, 0), 6)"
RATE_COLUMNS = ", ".join(f"{RATE(t)} as {n}" for n, t in zip(an.RATES, ("sub + del + ins", "sub", "del", "ins", "hal", "del_nl", "del_bv"), strict=True))


def counted(hal: str) -> str:
    return (
        ad.CHUNKS
        + ", counted as (select *, "
        + ", ".join(f"case when typ = '{t}' then len else 0 end as {t}" for t in ("hit", "sub", "ins", "del"))
        + f", case when typ = 'del' then nl else 0 end as del_nl, case when typ = 'del' then bv else 0 end as del_bv, case when {hal} then len else 0 end as hal from chunks)"
    )


SHORT, LONG = counted("typ = 'ins' and len > 10"), counted("typ in ('ins', 'sub') and len > 10")


@query(f"with {SHORT}, sums as (select dataset, audio, level, {SUMS} from counted group by all) select *, sub + hit + del as ref_len, {RATE_COLUMNS} from sums")
def error_table_short(spark, sf):
    return rounded(an.error_table(ad.chunks(spark, sf), ["dataset", "audio", "level"]))


@query(f"with {LONG}, sums as (select audio, level as algo, dataset, {SUMS} from counted group by all) select *, sub + hit + del as ref_len, {RATE_COLUMNS} from sums")
def error_table_long(spark, sf):
    return rounded(an.error_table(ad.chunks(spark, sf).withColumnRenamed("level", "algo"), ["audio", "algo", "dataset"], "long"))


@query(
    f"with {SHORT}, sums as (select dataset, audio, level, {SUMS} from counted group by all), t as (select *, {RATE_COLUMNS} from sums) select level, audio, "
    + ", ".join(f"max(case when dataset = '{d}' then {r} end) as \"{d}_{r}\"" for d in "FO" for r in an.RATES)
    + " from t group by level, audio"
)
def error_pivot_dataset(spark, sf):
    return rounded(an.error_pivot(ad.chunks(spark, sf), ["level", "audio"], "dataset", ["F", "O"]))


WER = "cast(sum(case when typ in ('ins', 'sub', 'del') then len else 0 end) as double) / nullif(sum(case when typ in ('hit', 'sub', 'del') then len else 0 end), 0)"


@query(
    f"with {ad.CHUNKS}, t as (select dataset, audio, level, {WER} * 100 as wer from chunks group by all) select dataset, audio, "
    "round(max(case when level = 'merged_line' then wer end), 6) as merged_line, round(max(case when level = 'grouped_line' then wer end), 6) as grouped_line from t group by all"
)
def wer_pivot_level(spark, sf):
    return rounded(an.wer_pivot(ad.chunks(spark, sf), ["dataset", "audio"], "level", ["merged_line", "grouped_line"], 100.0))


@query(
    f"with {ad.CHUNKS}, t as (select audio, level, iter_idx, {WER} as wer from chunks where not (typ in ('ins', 'sub') and len > 15) group by all) select audio, level, "
    + ", ".join(f'round(max(case when iter_idx = {k} then wer end), 6) as "{k}"' for k in range(5))
    + " from t group by all"
)
def wer_pivot_language(spark, sf):
    return rounded(an.wer_pivot(an.without_hallucinations(ad.chunks(spark, sf)), ["audio", "level"], "iter_idx", list(range(5))))


@query(f"with {ad.CHUNKS} select dataset, audio, round({WER}, 6) as wer from chunks where not (typ in ('ins', 'sub') and len > 15) group by all")
def hallucination_filtered_wer(spark, sf):
    return rounded(an.language_wer(ad.chunks(spark, sf), ["dataset", "audio"]))


@query(
    f"with {ad.CHUNKS}, t as (select level, audio, {WER} as wer from chunks group by all) select level, audio, round(wer, 6) as wer, "
    "coalesce(audio in ('A', 'N') and wer = min(case when audio in ('A', 'N') then wer end) over (partition by level), false) as best from t"
)
def best_system_flags(spark, sf):
    table = ad.chunks(spark, sf).groupBy("level", "audio").agg(an.combined_wer().alias("wer"))
    return rounded(an.best_flags(table, ["level"], "wer", F.col("audio").isin("A", "N")))


@query(
    f"with {ad.SAMPLES}, stats as (select dataset, level, avg(t1 - t0) as mean, stddev_samp(t1 - t0) as std, min(t1 - t0) as min, max(t1 - t0) as max, count(*) as count from samples "
    "where audio = 'N' and iter_idx = 0 group by all), grid as (select * from (values ('O', 0), ('F', 1), ('X', 2)) a(dataset, dataset_ord), (values ('merged_line', 0), ('grouped_line', 1)) b(level, level_ord)) "
    "select dataset, level, dataset_ord, level_ord, round(mean, 6) as mean, round(std, 6) as std, round(min, 6) as min, round(max, 6) as max, count from grid join stats using (dataset, level)"
)
def factor_grid_stats(spark, sf):
    stats = an.segment_statistics(ad.samples(spark, sf).where("audio = 'N' and iter_idx = 0"))
    grid = an.factor_grid(spark, dataset=["O", "F", "X"], level=["merged_line", "grouped_line"])
    return rounded(an.on_grid(stats, grid, ["dataset", "level"], ["mean", "std", "min", "max", "count"]))


@query(
    f"with {ad.CHUNKS}, t as (select audio, round({WER}, 6) as wer from chunks group by all), o as (select * from (values ('N', 0), ('A', 1), ('stem', 2), ('R', 3)) v(audio, audio_ord)) "
    "select audio, audio_ord, wer from o left join t using (audio)"
)
def ordered_reindex(spark, sf):
    table = ad.chunks(spark, sf).groupBy("audio").agg(an.combined_wer().alias("wer"))
    return rounded(an.on_grid(table, an.factor_grid(spark, audio=["N", "A", "stem", "R"]), ["audio"], ["wer"], keep_empty=True)).orderBy("audio_ord")


TOTALS = (
    "sum(ins) as ins, sum(sub) as sub, sum(del) as del, sum(hit) as hit, round(sum(duration), 6) as dur, cast(grouping(dataset) as tinyint) as overall, sum(hit) + sum(sub) + sum(del) as len, sum(ins) + sum(sub) + sum(del) as err, "
    + ", ".join(f"round(cast({t} as double) / nullif(sum(hit) + sum(sub) + sum(del), 0), 6) as {n}" for n, t in (("wer", "sum(ins) + sum(sub) + sum(del)"), ("ins_rate", "sum(ins)"), ("sub_rate", "sum(sub)"), ("del_rate", "sum(del)")))
)


@query(f"with {ad.SAMPLES} select dataset, {TOTALS} from samples group by grouping sets ((), (dataset))")
def headline_rollup(spark, sf):
    return rounded(an.headline(ad.samples(spark, sf)))


@query(f"with {ad.SAMPLES}, t as (select dataset, {TOTALS} from samples group by grouping sets ((), (dataset))) select dataset, overall, coalesce(wer, 0) as wer, coalesce(del_rate, 0) as dr, coalesce(sub_rate, 0) as sr, coalesce(ins_rate, 0) as ir from t")
def report_totals(spark, sf):
    return rounded(an.report_totals(ad.samples(spark, sf)))


@query(
    f"with {ad.SAMPLES}, t as (select uid, dataset, sum(hit) as hit, sum(sub) as sub, sum(del) as del, sum(ins) as ins from samples group by all) select *, "
    + ", ".join(f"coalesce(round(cast({c} as double) / nullif(hit + sub + del, 0), 6), 0) as {n}" for n, c in (("wer", "(sub + del + ins)"), ("dr", "del"), ("sr", "sub"), ("ir", "ins")))
    + " from t"
)
def song_totals(spark, sf):
    return rounded(an.song_totals(ad.samples(spark, sf)))


@query(f"with {ad.CHUNKS} select audio, round({WER}, 6) as wer, cast(null as varchar) as note from chunks group by audio union all select 'external', 0.237, 'published'")
def append_baseline(spark, sf):
    table = ad.chunks(spark, sf).groupBy("audio").agg(an.combined_wer().alias("wer"))
    return rounded(an.append_rows(table, spark.createDataFrame([("external", 0.237, "published")], "audio string, wer double, note string")))


@query(
    f"with {ad.SAMPLES} select dataset, count(distinct uid) as num_unique_uid, round(sum(duration) / 60, 6) as total_duration_mins, "
    + ", ".join(f"round(100.0 * sum(hit_{t} + sub_{t} + del_{t}) / nullif(sum(hit + sub + del), 0), 6) as {t}_len_percent" for t in ("nl", "bv"))
    + " from samples group by dataset"
)
def dataset_summary(spark, sf):
    return rounded(an.dataset_summary(ad.samples(spark, sf)))


@query(
    f"with {ad.CHUNKS}, x as (select dataset, audio, cast(len as double) as wer from chunks), q as (select dataset, audio, quantile_cont(wer, 0.25) as q1, quantile_cont(wer, 0.5) as q2, quantile_cont(wer, 0.75) as q3, avg(wer) as mean, "
    "count(*) as n from x group by all) select dataset, audio, round(q1, 6) as q1, round(q2, 6) as q2, round(q3, 6) as q3, round(mean, 6) as mean, n, min(wer) as whisker_low, max(wer) as whisker_high "
    "from q join x using (dataset, audio) where wer between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all"
)
def boxplot_stats(spark, sf):
    return rounded(an.boxplot_statistics(ad.chunks(spark, sf).select("dataset", "audio", F.col("len").cast("double").alias("wer")), ["dataset", "audio"]))


@query(f"with {ad.CATALOG} select song_id, dataset_id, language, split from songs where split = 'test' and language in ('en', 'de')")
def catalog_filter(spark, sf):
    return cat.select_songs(ad.catalog(spark, sf), splits=["test"], langs=["en", "de"]).select("song_id", "dataset_id", "language", "split")


@query(f"with {ad.CATALOG} select dataset_id, max(song_id) as song_id, arg_max(language, song_id) as language from songs group by dataset_id")
def last_per_key(spark, sf):
    return cat.last_by_uid(ad.catalog(spark, sf), "dataset_id", "song_id").select("dataset_id", "song_id", "language")


@query(f"with {ad.CATALOG} select song_id, dataset_id from songs where song_id not in (select doc_id from labels where toxic = 1)")
def exclude_anti_join(spark, sf):
    return cat.without(ad.catalog(spark, sf), ad.excluded(spark, sf)).select("song_id", "dataset_id")


@query(
    f"with {ad.CATALOG}, x as (select distinct doc_id from labels where toxic = 1) select count(*) filter (where doc_id is not null) as excluded, "
    "count(*) filter (where doc_id is null and song_id % 3 = 0) as missing_audio, count(*) as total from songs left join x on song_id = doc_id"
)
def missing_counters(spark, sf):
    return cat.scan_counters(ad.catalog(spark, sf), ad.excluded(spark, sf), F.col("song_id") % 3 != 0)


@query(f"with {ad.CATALOG} select song_id, d.n_chars / 15.0 as duration_secs, dataset_id || '' as dataset_id from songs join documents d on song_id = doc_id")
def duration_lookup(spark, sf):
    songs = cat.assert_unique(ad.catalog(spark, sf), "song_id")
    return cat.with_durations(songs.drop("duration_secs"), songs.select("song_id", "duration_secs")).select("song_id", "duration_secs", "dataset_id")


@query(f"with {ad.CATALOG} select song_id, case language when 'en' then 'English' when 'de' then 'German' else language end as language, upper(dataset_id) as dataset, cast(song_id as varchar) || '_' || dataset_id as uid from songs")
def language_recode(spark, sf):
    return ad.catalog(spark, sf).select("song_id", cat.recode("language", {"en": "English", "de": "German"}).alias("language"), F.upper("dataset_id").alias("dataset"), cat.uid().alias("uid"))


CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '</?nl>', '', 'g'), '\([^)]*\)', '', 'g'), '\s+,', ',', 'g'), '\s+', ' ', 'g'))"


@query(
    f"with {ad.CATALOG}, r as (select dataset_id as dataset, language, 'audio/' || cast(song_id as varchar) || '.mp3' as audio_path, {CLEAN} as text, 0.0::double as start, duration_secs - 10 as \"end\", song_id from songs) "
    "select audio_path, text, start, \"end\", dataset, language from r where text <> '' and \"end\" > start and song_id not in (select doc_id from labels where toxic = 1)"
)
def record_clean(spark, sf):
    lines = ad.catalog(spark, sf).withColumns({"start": F.lit(0.0), "end": F.col("duration_secs") - 10, "audio_path": F.concat(F.lit("audio/"), F.col("song_id").cast("string"), F.lit(".mp3"))})
    return cat.to_records(lines, ad.excluded(spark, sf))


@query(
    "with v as (select conv_id, role, string_agg(coalesce(text, ''), chr(10) order by turn) as t from conversations group by conv_id, role) "
    "select conv_id, string_agg(t, chr(10) || chr(10) order by role) as text from v group by conv_id"
)
def paragraph_assembly(spark, sf):
    return cat.paragraphs(ad.turns(spark, sf), "conv_id", "role", "turn")


ISLANDS = f"""with recursive {ad.LINES}, kept as (select * from lines where e - s <= 30), long as (select * from kept where e - s > 0.2), edges as (
  select a.song_id, a.line_idx as x, b.line_idx as y from long a join long b on a.song_id = b.song_id and a.line_idx <> b.line_idx and least(a.e, b.e) - greatest(a.s, b.s) > 0.2
), reach as (
  select song_id, line_idx as x, line_idx as y from kept union select r.song_id, r.x, edges.y from reach r join edges on r.song_id = edges.song_id and r.y = edges.x
), islands as (
  select song_id, x as line_idx, min(y) as island from reach group by song_id, x
)"""


@query(ISLANDS + " select song_id, line_idx, island from islands")
def overlap_islands(spark, sf):
    return iv.overlap_islands(cat.short_lines(ad.lines(spark, sf))).select("song_id", "line_idx", "island")


MERGED = ISLANDS + """, marked as (select * from kept join islands using (song_id, line_idx)), durations as (select song_id, max(e) + 1 as duration from kept group by song_id), groups as (
  select song_id, island, count(*) as n_lines, string_agg(text, '' order by line_idx) as text, min(s) as gs, max(e) as ge from marked group by song_id, island
), limits as (
  select g.song_id, g.island, greatest(0, coalesce(max(case when m.e < g.ge then m.e + 0.1::double end), 0)) as l, min(case when m.s > g.gs then m.s - 0.1::double end) as r
  from groups g left join marked m on m.song_id = g.song_id and m.island <> g.island group by g.song_id, g.island
), pads as (
  select *, least(greatest(0, gs - l), 0.5::double) as lp, least(greatest(0, least(duration, coalesce(r, duration)) - ge), 0.5::double) as rp, greatest(0, 30 - (ge - gs)) as room
  from groups join limits using (song_id, island) join durations using (song_id)
), even as (select *, least(lp, rp, room / 2) as m from pads), final as (
  select song_id, island, n_lines, text, gs - case when lp + rp > room then m + (greatest(0, room - 2 * m) - 0.001::double) / 2 else lp end as start, ge + case when lp + rp > room then m + (greatest(0, room - 2 * m) - 0.001::double) / 2 else rp end as "end" from even
)"""


@query(MERGED + ' select song_id, island, n_lines, text, round(start, 6) as start, round("end", 6) as "end" from final where not ("end" - start > 30)')
def merge_lines(spark, sf):
    lines = cat.short_lines(ad.lines(spark, sf))
    durations = lines.groupBy("song_id").agg((F.max("end") + 1).alias("duration"))
    return rounded(iv.merge_lines(lines, durations))


@query(
    MERGED.replace("string_agg(text, '' order", "string_agg(upper(text) || chr(10), '' order")
    + ' select \'user_\' || song_id as song_id, n_lines, text, round(start, 6) as start, round("end", 6) as "end" from final where not ("end" - start > 30) and song_id % 3 = 0'
)
def tagged_lines(spark, sf):
    return rounded(io.tagged_songs(ad.tagged_catalogue(spark, sf), "d", ("en",), underscore=True, newline=True)[1].drop("island"))


@query(
    f"with {ad.LINES}, g as (select *, s - lag(e) over (partition by song_id order by s, line_idx) as lag_gap from lines where e - s < 30) "
    "select song_id, line_idx, round(lag_gap, 6) as lag_gap, sum(case when lag_gap > 7 then 1 else 0 end) over (partition by song_id order by s, line_idx rows unbounded preceding) as session from g"
)
def gap_sessions(spark, sf):
    return rounded(iv.gap_sessions(cat.short_lines(ad.lines(spark, sf), inclusive=False)).select("song_id", "line_idx", "lag_gap", F.col("session").cast("long").alias("session")))


@query(
    f"""with recursive {ad.LINES}, g as (select *, s - lag(e) over (partition by song_id order by s, line_idx) as lag_gap from lines where e - s < 30), marked as (
  select *, sum(case when lag_gap > 7 then 1 else 0 end) over (partition by song_id order by s, line_idx rows unbounded preceding) as session from g
), sessions as (
  select song_id, session, list(s order by s, line_idx) as ss, list(e order by s, line_idx) as es, list(text order by s, line_idx) as ts from marked group by song_id, session
), best as (
  select song_id, session, len(ss) as i, ['infinity'::double] as worth, cast([] as bigint[]) as size from sessions
  union all
  select song_id, session, i - 1, list_prepend(list_max(choices), worth), list_prepend(list_position(choices, list_max(choices)), size) from (
    select b.*, list_transform(range(1, len(worth) + 1), lambda k: case when list_max(es[i : i + k - 1]) - ss[i] < 30 then least(es[i + k - 1] - ss[i], worth[k]) else '-infinity'::double end) as choices
    from best b join sessions using (song_id, session) where i > 0
  )
), cuts as (
  select song_id, session, 0 as group_idx, 1::bigint as pos, size from best where i = 0
  union all
  select song_id, session, group_idx + 1, pos + size[pos], size from cuts where pos + size[pos] <= len(size)
) select song_id, session::bigint as session, group_idx, size[pos]::int as n_lines, array_to_string(ts[pos : pos + size[pos] - 1], '') as text, round(list_min(ss[pos : pos + size[pos] - 1]), 6) as start, round(list_max(es[pos : pos + size[pos] - 1]), 6) as "end"
from cuts join sessions using (song_id, session)"""
)
def group_lines(spark, sf):
    return rounded(iv.group_lines(cat.short_lines(ad.lines(spark, sf), inclusive=False)))


@query(
    f"""with recursive {ad.LINES}, spans as (
  select song_id, cast(trunc(s * 16000) as bigint) as s, cast(trunc(e * 16000) as bigint) as e, row_number() over (partition by song_id order by s, line_idx) as k from lines
), steps as (
  select song_id, k, s as ps, e as pe, e as last, 0 as pack from spans where k = 1
  union all
  select x.song_id, x.k, case when x.e - p.ps > 480000 and p.last - p.ps > 0 then x.s else p.ps end, x.e, x.e, case when x.e - p.ps > 480000 and p.last - p.ps > 0 then p.pack + 1 else p.pack end
  from steps p join spans x on x.song_id = p.song_id and x.k = p.k + 1
) select song_id, pack as pack_idx, min(ps) as start, arg_max(pe, k) as "end", count(*) as n from steps group by song_id, pack"""
)
def pack_segments(spark, sf):
    rows = ad.lines(spark, sf).select("song_id", "line_idx", "start", cat.to_samples("start").alias("s"), cat.to_samples("end").alias("e"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("start", "line_idx", "s", "e"))), lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end")))
    packs = rows.groupBy("song_id").agg(items.alias("segments")).select("song_id", F.posexplode(iv.pack_segments("segments", 30 * cat.SAMPLE_RATE)).alias("pack_idx", "p"))
    return packs.select("song_id", "pack_idx", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.size("p.segments").cast("long").alias("n"))


OPTIONS = vad.VadOptions(onset=0.3, offset=0.3, max_speech_s=12, pad_ms=200, window=16000)
PAUSES = vad.VadOptions(onset=0.3, offset=0.3, min_speech_ms=1000, max_speech_s=12, min_silence_ms=3000, pad_ms=900, window=16000)


def activity_sql(o: vad.VadOptions) -> str:
    """SQL of segments(uid, n, segment_idx, s, e): a walk over the silences of each series, kept as a text of ones and zeros, for
    equal thresholds. A row is the state at a silence: where the segment began, from where silences are looked for, and
    the last pause with the frame at which activity resumed; what a step closes is (s, e)."""
    pad = o.rate * o.pad_ms / 1000
    longest, shortest = o.rate * o.max_speech_s - o.window - 2 * pad, o.rate * o.min_speech_ms / 1000
    ends, pauses, full = math.ceil(o.rate * o.min_silence_ms / 1000 / o.window), math.floor(o.rate * 98 / 1000 / o.window) + 1, math.floor(longest / o.window) + 1
    found = lambda mark, at: f"(nullif(instr(substr(act, ({at}) + 1), '{mark}'), 0) + ({at}) - 1)"
    return f"""series as (
  select vec_id as uid, len(embedding) as n, list_transform(embedding, lambda v: abs(cast(v as double)) / list_max(list_transform(embedding, lambda x: abs(cast(x as double))))) as y,
         array_to_string(list_transform(embedding, lambda v: case when abs(cast(v as double)) / list_max(list_transform(embedding, lambda x: abs(cast(x as double)))) >= {o.onset}::double then '1' else '0' end), '') as act from embeddings
), walk as (
  select uid, 0 as step, {found(1, "0")} as start, {found(1, "0")} + 1 as watched, {found(1, "0")} + 1 as pos, cast(null as bigint) as paused, cast(null as bigint) as resumed, cast(null as bigint) as s, cast(null as bigint) as e from series
  union all
  select uid, step + 1, next_start,
         case kind when 'next' then watched when 'paused' then case when resumed <= too_long then too_long else next_start + 1 end when 'cut' then too_long + 1 else next_start + 1 end,
         case kind when 'next' then until when 'paused' then case when resumed <= too_long then too_long else next_start + 1 end when 'cut' then too_long + 1 else next_start + 1 end,
         case when kind = 'next' then case when notes then first else paused end end, case when kind = 'next' then case when notes then until else resumed end end,
         case when kind <> 'next' and ending > start and (kind in ('paused', 'cut') or (ending - start) * {o.window} > {shortest}) then start end * {o.window}, case when kind <> 'next' then ending end * {o.window}
  from (
    select *, case kind when 'next' then start when 'closed' then {found(1, f"first + {ends} + 1")} when 'paused' then case when resumed <= too_long then resumed else {found(1, "too_long + 1")} end when 'cut' then ending end as next_start from (
      select *, case kind when 'closed' then first when 'last' then n when 'paused' then paused when 'cut' then half + len(later) - list_position(list_reverse(later), list_min(later)) end as ending from (
        select *, case when first < too_long and first + {ends} < least(until, too_long) then 'closed' when first < too_long then 'next' when too_long >= n then 'last' when paused is not null then 'paused' else 'cut' end as kind,
               first < too_long and first + {pauses} < least(until, too_long) as notes, list_slice(y, half + 1, too_long + 1) as later from (
          select *, coalesce({found(1, "first + 1")}, n) as until, start + (too_long + 1 - start) // 2 as half from (
            select w.*, x.n, x.y, x.act, greatest(watched, start + {full}) as too_long, {found(0, "pos")} as first from walk w join series x using (uid) where start is not null)))))
), closed as (
  select uid, n, step, s, e, s - lag(e) over w as before, lead(s) over w - e as after, row_number() over w - 1 as segment_idx from walk join series using (uid) where s is not null window w as (partition by uid order by step)
), segments as (
  select uid, n, cast(segment_idx as int) as segment_idx, cast(greatest(0, s - case when before < {2 * pad} then before // 2 else {pad} end) as bigint) as s, cast(least(n * {o.window}, e + case when after < {2 * pad} then after // 2 else {pad} end) as bigint) as e from closed
)"""


def _segments(spark, sf, options: vad.VadOptions):
    found = ad.scores(spark, sf).withColumn("segments", vad.vad_segments(vad.normalised("scores"), options))
    return found.select("uid", F.posexplode("segments").alias("segment_idx", "s")).select("uid", "segment_idx", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query(f'with recursive {activity_sql(OPTIONS)} select uid, segment_idx, s as start, e as "end" from segments')
def vad_segments(spark, sf):
    """Segments cut at their least score where they grow too long."""
    return _segments(spark, sf, OPTIONS)


@query(f'with recursive {activity_sql(PAUSES)} select uid, segment_idx, s as start, e as "end" from segments')
def vad_pauses(spark, sf):
    """Segments that longer silences end, cut at a pause where they grow too long and have one."""
    return _segments(spark, sf, PAUSES)


@query(
    "with x as (select vec_id as uid, len(embedding) as n, list_transform(embedding, lambda v: abs(cast(v as double))) as a from embeddings), y as (select uid, n, unnest(a) / list_max(a) as v, unnest(range(0, n)) as frame from x) "
    "select uid, cast(frame * 24 // n as int) as pixel, round(min(v), 6) as low, round(max(v), 6) as high from y group by uid, frame * 24 // n"
)
def activity_plot(spark, sf):
    """What a picture 24 pixels wide shows of each series."""
    rows = ad.scores(spark, sf).select("uid", F.explode(render.pixel_ranges(vad.normalised("scores"), 24)).alias("p"))
    return rounded(rows.select("uid", "p.pixel", "p.low", "p.high"))


ENERGY = """x as (select vec_id as uid, list_transform(embedding, lambda v: cast(v as double)) as a from embeddings), framed as (select uid, a, unnest(range(0, len(a) // 4 + 1)) as frame from x), energy as (
  select uid, len(a) // 4 + 1 as n, frame, sqrt(coalesce(list_sum(list_transform(list_slice(a, greatest(1, frame * 4 - 7), least(len(a), frame * 4 + 8)), lambda v: v * v)), 0) / 16) as energy from framed
)"""


@query(f"with {ENERGY} select uid, frame, round(energy, 6) as energy from energy")
def frame_energy(spark, sf):
    """Energy of frames of 16 samples, one every fourth: embeddings as samples."""
    rows = ad.table(spark, sf, "embeddings").select(F.col("vec_id").alias("uid"), F.posexplode(vad.frame_energy("embedding", 16, 4)).alias("frame", "energy"))
    return rounded(rows.select("uid", F.col("frame").cast("long").alias("frame"), "energy"))


UNCUT = vad.VadOptions(onset=0.3, offset=0.3, min_speech_ms=1000, max_speech_s=1e6, min_silence_ms=1000, pad_ms=1500, window=16000)


def islands_sql(scores: str, onset: float, shortest: int, pad: int) -> str:
    """SQL of padded runs of activity over (uid, n, score, frame); silences of one frame are part of a run."""
    return f"""{scores}, runs as (
  select uid, n, frame, case when frame - lag(frame) over (partition by uid order by frame) <= 2 then 0 else 1 end as opens from y where score >= {onset}::double
), numbered as (
  select *, sum(opens) over (partition by uid order by frame rows unbounded preceding) as run from runs
), raw as (
  select uid, n * 16000 as total, min(frame) * 16000 as s, case when n - max(frame) > 2 then max(frame) + 1 else n end * 16000 as e from numbered group by uid, n, run
), kept as (
  select *, s - lag(e) over w as before, lead(s) over w - e as after, row_number() over w - 1 as segment_idx from raw where e - s > {shortest} window w as (partition by uid order by s)
) select uid, segment_idx::int as segment_idx, greatest(0, s - case when before < {2 * pad} then before // 2 else {pad} end)::bigint as start, least(total, e + case when after < {2 * pad} then after // 2 else {pad} end)::bigint as "end" from kept"""


@query(
    islands_sql(
        "with x as (select vec_id as uid, len(embedding) as n, list_transform(embedding, lambda v: abs(cast(v as double))) as a from embeddings), y as (select uid, n, unnest(a) / list_max(a) as score, unnest(range(0, n)) as frame from x)",
        0.3, 16000, 24000,
    )
)
def vad_islands(spark, sf):
    """Segments that never grow too long: padded runs of activity, silences of one frame included."""
    return _segments(spark, sf, UNCUT)


LOUD = vad.VadOptions(onset=0.8, offset=0.8, max_speech_s=1e6, min_silence_ms=1000, pad_ms=1500, window=16000)


@query(islands_sql(f"with {ENERGY}, y as (select uid, n, energy / max(energy) over (partition by uid) as score, frame from energy)", 0.8, 0, 24000))
def energy_segments(spark, sf):
    """Segments of the loud frames of a series of samples."""
    rows = ad.table(spark, sf, "embeddings").select(F.col("vec_id").alias("uid"), vad.frame_energy("embedding", 16, 4).alias("energy"))
    found = rows.select("uid", F.posexplode(vad.vad_segments(vad.normalised("energy"), LOUD)).alias("segment_idx", "s"))
    return found.select("uid", "segment_idx", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query(
    "with x as (select vec_id as uid, list_transform(embedding, lambda v: abs(cast(v as double))) as a from embeddings), y as (select uid, unnest(a) as v, list_max(a) as top, unnest(range(0, len(a))) as frame from x) "
    "select uid, frame, round(v / top, 6) as score, cast(frame * 16000 between (uid % 7) * 16000 and (uid % 7 + 10) * 16000 - 1 or frame * 16000 between (30 + uid % 5) * 16000 + 1 and 50 * 16000 + 799 as int) as active from y"
)
def vad_mask(spark, sf):
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    w, uid = 16000, F.col("uid")
    segments = F.array(span((uid % 7) * w, (uid % 7 + 10) * w), span((30 + uid % 5) * w + 1, F.lit(50 * w + 800)))
    rows = ad.scores(spark, sf).withColumn("scores", vad.normalised("scores")).withColumn("segments", segments)
    return rounded(vad.activity_mask(rows, window=w).select("uid", F.col("frame").cast("long").alias("frame"), "score", "active"))


@query(
    f"with recursive {activity_sql(OPTIONS)}, frames as (select uid, n, unnest(range(0, n)) * {OPTIONS.window} as at from series), lit as (select distinct f.uid, f.at from frames f join segments g on g.uid = f.uid and g.s <= f.at and f.at < g.e) "
    "select x.uid, count(l.at) as active_frames, cast(any_value(n) as bigint) as frames from series x left join lit l using (uid) group by x.uid"
)
def vad_activity(spark, sf):
    found = ad.scores(spark, sf).withColumn("scores", vad.normalised("scores"))
    found = found.withColumn("segments", vad.vad_segments("scores", OPTIONS))
    return vad.activity_mask(found, window=OPTIONS.window).groupBy("uid").agg(F.sum("active").alias("active_frames"), F.count("*").alias("frames"))


WORDS = r"\pL\pN\pM_"
NORMALISED = rf"""list_transform(string_split(replace(text, '>,', '>'), chr(10)), lambda line: left(line, 1) || regexp_replace(substring(line, 2), '[^{WORDS}!?''´‘’"“”»>)]+ *$', ''))"""


@query(
    rf"""with {ad.CATALOG}, l as (select song_id, {NORMALISED} as ls from songs)
select song_id, array_to_string(list_transform(ls, lambda x: replace(upper(regexp_extract(x, '^[^{WORDS}]*[{WORDS}]')), 'ẞ', 'SS') || substring(x, length(regexp_extract(x, '^[^{WORDS}]*[{WORDS}]')) + 1)), chr(10)) as text from l"""
)
def normalize_lines(spark, sf):
    return ad.catalog(spark, sf).select("song_id", tx.normalize_lyrics(F.col("text")).alias("text"))


NAMES = "with n as (select s_suppkey as k, s_name as a, lead(s_name) over (order by s_suppkey) as b from supplier)"


@query(NAMES + " select k, levenshtein(lower(a), lower(b)) in (1, 2) and greatest(length(a), length(b)) > 2 * levenshtein(lower(a), lower(b)) as near from n where b is not null")
def near_miss(spark, sf):
    names = ad.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    after = names.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("b"))
    return names.join(after, "s_suppkey").select(F.col("s_suppkey").alias("k"), tx.near_miss(F.col("s_name"), F.col("b")).alias("near"))


@query(
    "select p_partkey as k, p_brand as brand, cast(levenshtein(replace(p_name, '''', ''), replace(p_type, '''', '')) as double) as dist from part"
)
def word_dist(spark, sf):
    return ad.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), tx.word_dist(F.col("p_name"), F.col("p_type")).alias("dist"))


@query(
    f"""with recursive {ad.PAIRS}, dp as (
  select uid, sample_idx, 0 as i, range(0, len(h) + 1) as row from pairs
  union all
  select uid, sample_idx, i + 1, list_transform(range(1, len(b) + 1), lambda k: list_min(list_transform(range(1, k + 1), lambda j: b[j] + k - j))) from (
    select d.uid, d.sample_idx, d.i, list_prepend(d.i + 1, list_transform(range(1, len(p.h) + 1), lambda j: least(d.row[j] + case when p.h[j] = p.r[d.i + 1] then 0 else 1 end, d.row[j + 1] + 1))) as b
    from dp d join pairs p using (uid, sample_idx) where d.i < len(p.r)
  )
) select uid, sample_idx, cast(row[len(h) + 1] as int) as distance from dp join pairs using (uid, sample_idx) where i = len(r)"""
)
def word_distance(spark, sf):
    rows = ad.pairs(spark, sf)
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return rows.select("uid", "sample_idx", al.word_edit_distance(split("ref"), split("hyp")).alias("distance"))


COUNTS = ", ".join(f"cast(count(*) filter (where typ = '{t}') as bigint) as {t}" for t in ("hit", "sub", "ins")) + ", cast(count(*) filter (where typ = 'del') as bigint) as del"
# the other engine's levenshtein counts bytes: lower-case letters beyond ASCII become upper-case ASCII ones first
ACCENTED, PLAIN = "äöüßéèêàâçôîûñíóúáœæãõìòùë", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DISTANCE = f"levenshtein(translate(ref, '{ACCENTED}', '{PLAIN}'), translate(hyp, '{ACCENTED}', '{PLAIN}'))"
NO_TAGS = ", ".join(f"0::bigint as {t}_{c}" for t in ("hit", "sub", "del") for c in ("nl", "bv"))


@query(
    f"with recursive {ad.ALIGNED}, counts as (select uid, sample_idx, {COUNTS} from ops group by uid, sample_idx) "
    f"select uid, role as dataset, 'en' as language, sample_idx, 0.0::double as start, len(r)::double as \"end\", coalesce(hit, 0) as hit, coalesce(sub, 0) as sub, coalesce(ins, 0) as ins, coalesce(del, 0) as del, {NO_TAGS}, "
    "array_to_string(r, ' ') as ref, array_to_string(h, ' ') as hyp, len(r)::bigint as len, round((sub + del + ins)::double / nullif(len(r), 0), 6) as wer, len(r)::double as duration "
    "from pairs left join counts using (uid, sample_idx) join (select conv_id as uid, turn as sample_idx, role from conversations) using (uid, sample_idx)"
)
def align_samples(spark, sf):
    return rounded(ev.samples(ev.aligned(ad.pairs(spark, sf))))


@query(
    f"with recursive {ad.ALIGNED}, marked as (select *, case when typ = lag(typ) over w then 0 else 1 end as opens from ops window w as (partition by uid, sample_idx order by k)), "
    "numbered as (select *, sum(opens) over (partition by uid, sample_idx order by k rows unbounded preceding) - 1 as chunk_idx from marked) "
    "select typ, coalesce(string_agg(ref, ' ' order by k), '') as ref, coalesce(string_agg(hyp, ' ' order by k), '') as hyp, count(*) as len, uid, dataset, 'en' as language, sample_idx, cast(chunk_idx as int) as chunk_idx, 0::bigint as nl, 0::bigint as bv "
    "from numbered group by uid, dataset, sample_idx, chunk_idx, typ"
)
def align_chunks(spark, sf):
    return ev.chunks(ev.aligned(ad.pairs(spark, sf)))


@query(
    f"with recursive {ad.ALIGNED}, marked as (select *, case when typ = lag(typ) over (partition by uid, sample_idx order by k) then 0 else 1 end as opens from ops) "
    "select 'samples' as name, count(*) as n, cast(sum(len(r)) as bigint) as words from pairs union all select 'chunks', cast(sum(opens) as bigint), count(*) from marked union all select 'edits', count(*), count(distinct typ) from ops"
)
def fact_tables(spark, sf):
    """Sizes of the three tables of a run whose texts are compared once; edits are told with how many kinds there are."""
    made = ev.fact_tables(ad.pairs(spark, sf), store=f"{io.shared_folder(spark)}/{uuid.uuid4().hex}")
    words = {"samples": F.sum("len"), "chunks": F.sum("len"), "edits": F.count_distinct("typ")}
    return reduce(DataFrame.unionByName, [made[k].agg(F.count("*").alias("n"), w.alias("words")).select(F.lit(k).alias("name"), "n", "words") for k, w in words.items()])


@query(
    f"with recursive {ad.ALIGNED} select typ, dataset, false as nl, false as bv, count(*) as edits, sum(case when ref is null or hyp is null then 0 else {DISTANCE} end)::double as dist from ops group by typ, dataset"
)
def align_edits(spark, sf):
    return ev.edits(ev.aligned(ad.pairs(spark, sf))).groupBy("typ", "dataset", "nl", "bv").agg(F.count("*").alias("edits"), F.sum(F.nanvl("dist", F.lit(0.0))).alias("dist"))


@query(
    f"with recursive {ad.ALIGNED}, heard as (select 'N' as audio, dataset, {COUNTS} from ops group by dataset), exact as (select 'A' as audio, role as dataset, cast(sum(len(r)) as bigint) as hit, 0::bigint as sub, 0::bigint as ins, 0::bigint as del "
    "from pairs join (select conv_id as uid, turn as sample_idx, role from conversations) using (uid, sample_idx) group by role) select * from heard union all select * from exact"
)
def system_samples(spark, sf):
    """The samples of two systems in one table."""
    rows = ad.pairs(spark, sf)
    made = ev.fact_tables_of([({"audio": "N"}, rows), ({"audio": "A"}, rows.withColumn("hyp", F.col("ref")))])["samples"]
    return made.groupBy("audio", "dataset").agg(*[F.sum(c).alias(c) for c in ("hit", "sub", "ins", "del")])


@query(
    f"""with recursive {ad.ALIGNED}, counts as (
  select dataset, count(*) filter (where typ = 'hit') as hits, count(*) filter (where typ = 'sub') as substitutions, count(*) filter (where typ = 'del') as deletions, count(*) filter (where typ = 'ins') as insertions,
         count(*) filter (where typ = 'sub' and {DISTANCE} in (1, 2) and greatest(length(ref), length(hyp)) > 2 * {DISTANCE}) as nears from ops group by dataset
), n as (select *, hits + substitutions + deletions as total_len, hits + substitutions + insertions as heard, substitutions + deletions + insertions as wrong from counts)
select dataset, round(wrong / total_len, 6) as "WER", round((wrong - nears) / total_len, 6) as "WER_near", round(wrong / (hits + wrong), 6) as "MER", round(1 - (hits / total_len) * (hits / heard), 6) as "WIL", hits, round(nears / total_len, 6) as near,
       substitutions, deletions, insertions, nears, round(substitutions / total_len, 6) as sub_rate, round(deletions / total_len, 6) as del_rate, round(insertions / total_len, 6) as ins_rate, 0.0::double as "ER_case",
       round(wrong / total_len, 6) as "WER_case", total_len, 0::bigint as deletions_backing, 0::bigint as deletions_nonlexical from n"""
)
def wer_metrics(spark, sf):
    return rounded(ev.word_metrics(ev.aligned(ad.pairs(spark, sf)), ["dataset"]))


def _song_rows(spark, sf):
    rows = ad.catalog(spark, sf).select("*", F.col("song_id").alias("uid"), F.concat(F.lit("audio/"), F.col("song_id").cast("string")).alias("audio_path"), F.concat(F.lit("stems/"), F.col("song_id").cast("string")).alias("stem_dir"))
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def _timed(spark, sf):
    return cat.short_lines(ad.lines(spark, sf)).withColumnRenamed("song_id", "uid")


TASK_SONGS = "select distinct user_id as uid from events"


@query(
    f"with {ad.LINES}, kept as (select song_id as uid, cast(trunc(s * 16000) as bigint) as a, cast(trunc(e * 16000) as bigint) as b, s, e from lines where e - s <= 30) "
    "select uid, 'sep/htdemucs/d/' || uid || '.mp3' as audio_path, 'en' as language, row_number() over (partition by uid order by s, e) - 1 as clip_idx, a as start, b as \"end\" from kept"
)
def line_tasks(spark, sf):
    lines = _timed(spark, sf)
    songs = lines.select("uid").distinct().select(F.col("uid").cast("string").alias("uid"), F.lit("d").alias("dataset_id"), F.lit("en").alias("language"), F.lit("x").alias("audio_path"), F.lit(None).cast("string").alias("stem_dir"))
    made = tasks.transcription_tasks(songs, "merged_line", tasks.line_clips(lines.withColumn("uid", F.col("uid").cast("string"))), audio="htdemucs")
    return made.select(F.col("uid").cast("long").alias("uid"), "audio_path", "language", F.posexplode("clips").alias("clip_idx", "c")).select("uid", "audio_path", "language", F.col("clip_idx").cast("long").alias("clip_idx"), "c.start", "c.end")


@query(
    f"""with recursive {activity_sql(OPTIONS)}, steps as (
  select uid, segment_idx as k, s as ps, e as last, 0 as pack from segments where segment_idx = 0
  union all
  select x.uid, x.segment_idx, case when x.e - p.ps > 480000 and p.last - p.ps > 0 then x.s else p.ps end, x.e, case when x.e - p.ps > 480000 and p.last - p.ps > 0 then p.pack + 1 else p.pack end
  from steps p join segments x on x.uid = p.uid and x.segment_idx = p.k + 1
), packs as (
  select uid, pack, min(ps) / 16000.0::double as s, max(last) / 16000.0::double as e from steps group by uid, pack
) select uid, 'stems/' || uid || '/vocals.wav' as audio_path, cast(count(pack) as int) as clips, coalesce(string_agg(s || ',' || e, ',' order by pack), '') as clip_timestamps from series left join packs using (uid) group by uid"""
)
def activity_tasks(spark, sf):
    """Song-level tasks whose clips are packed activity, as the flat list of sequential recognition."""
    found = ad.scores(spark, sf).withColumn("segments", vad.vad_segments(vad.normalised("scores"), OPTIONS)).select("uid", tasks.activity_clips("segments").alias("clips"))
    songs = found.select("uid", F.lit("d").alias("dataset_id"), F.lit("en").alias("language"), F.lit("x").alias("audio_path"), F.concat(F.lit("stems/"), F.col("uid").cast("string")).alias("stem_dir"))
    made = tasks.transcription_tasks(songs, "song", found, audio="vocal_stem", batched=False)
    return made.select("uid", "audio_path", F.size("clips").alias("clips"), F.array_join("clip_timestamps", ",").alias("clip_timestamps"))


@query(
    f"with {ad.CATALOG} select song_id as uid, 'audio/' || song_id as audio_path, dataset_id, language, 0 as sample_idx, coalesce(text, '') as ref, lower(coalesce(text, '')) as hyp, 0.0::double as start, duration_secs as \"end\" from songs"
)
def song_results(spark, sf):
    songs = _song_rows(spark, sf)
    outputs = songs.select("uid", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "text"))
    return tasks.results(songs, tasks.transcription_tasks(songs, "song"), outputs, "song")


@query(
    f"with recursive {ad.ALIGNED}, counts as (select uid, sample_idx, {COUNTS} from ops group by uid, sample_idx) select uid, 'audio' as audio_path, role as dataset_id, 'en' as language, sample_idx, coalesce(hit, 0) as hit, coalesce(sub, 0) as sub, "
    "coalesce(ins, 0) as ins, coalesce(del, 0) as del, round((sub + del + ins)::double / nullif(len(r), 0), 6) as wer from pairs left join counts using (uid, sample_idx) join (select conv_id as uid, turn as sample_idx, role from conversations) using (uid, sample_idx)"
)
def results_with_evaluation(spark, sf):
    rows = ad.pairs(spark, sf).withColumns({"dataset_id": F.col("dataset"), "audio_path": F.lit("audio")})
    return rounded(tasks.with_evaluation(rows).select("uid", "audio_path", "dataset_id", "language", "sample_idx", "hit", "sub", "ins", "del", "wer"))


@query(
    ISLANDS
    + ", numbered as (select *, row_number() over (partition by song_id order by line_idx) - 1 as k from kept join islands using (song_id, line_idx)) "
    "select song_id, island, case when count(*) > 1 then printf('%03d-%03d', min(k), max(k)) else printf('%03d', min(k)) end as name from numbered group by song_id, island"
)
def group_names(spark, sf):
    return tasks.group_names(cat.short_lines(ad.lines(spark, sf)))


@query(
    r"""with w as (select conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from conversations), x as (select conv_id, turn, len(ws) as n, unnest(range(0, len(ws))) as word_idx, unnest(ws) as word from w)
select conv_id, turn, word_idx, word, round(turn * 10 + word_idx::double / n * 8, 6) as time from x"""
)
def hyp_timestamps(spark, sf):
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = ad.turns(spark, sf).select("conv_id", "turn", F.posexplode(words).alias("word_idx", "word"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 8).alias("end"))
    timed = render.word_times(rows, ["conv_id", "turn"])
    return rounded(timed.select("conv_id", "turn", F.col("word_idx").cast("long").alias("word_idx"), "word", "time"))


@query(
    r"""with w as (select conv_id as uid, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n from conversations), x as (select uid, turn, n, unnest(range(0, n)) as i from w)
select uid, row_number() over (partition by uid order by turn, i) - 1 as word_idx, round(turn * 10 + i::double / n * 8, 6) as time from x"""
)
def segment_times(spark, sf):
    """Times of all words of a song's segments, which are its turns."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("n_words")
    rows = ad.turns(spark, sf).groupBy(F.col("conv_id").alias("uid")).agg(F.array_sort(F.collect_list(F.struct("turn", (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 8).alias("end"), n))).alias("segments"))
    times = rows.select("uid", F.posexplode(render.hyp_timestamps("segments")).alias("word_idx", "time"))
    return rounded(times.select("uid", F.col("word_idx").cast("long").alias("word_idx"), "time"))


@query(
    "with n as (select conv_id, role, coalesce(text, '') as text, row_number() over (partition by conv_id, role order by turn) - 1 as pos from conversations where role in ('user', 'assistant')) "
    "select a.conv_id as uid, a.pos as sample_idx, a.text as ref, b.text as hyp from n a join n b on a.conv_id = b.conv_id and a.pos = b.pos and a.role = 'user' and b.role = 'assistant'"
)
def positional_pairing(spark, sf):
    pos = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("long") - 1
    rows = ad.turns(spark, sf).withColumn("pos", pos).withColumnRenamed("conv_id", "uid")
    return ev.line_pairs(rows.where("role = 'user'").select("uid", "pos", "text"), rows.where("role = 'assistant'").select("uid", "pos", "text"))


@query(f"with {ad.CATALOG} select song_id as uid, case when song_id % 2 = 0 then 'cached' else 'new' end as origin, cast(length(text) as bigint) as chars from songs")
def cached_map(spark, sf):
    tasks = ad.catalog(spark, sf).select(F.col("song_id").alias("uid"), "text")
    done = tasks.where("uid % 2 = 0").select("uid", F.lit("cached").alias("origin"), F.char_length("text").cast("long").alias("chars"))
    model = lambda f: f.assign(origin="new", chars=f["text"].str.len())[["uid", "origin", "chars"]]
    return pools.cached_map(tasks, model, "uid long, origin string, chars long", done)


@query(
    "with e as (select user_id, ts, case when ts - lag(ts) over w < interval 1 hour then 0 else 1 end as opens from events window w as (partition by user_id order by ts)), "
    "s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as start, max(ts) + interval 1 hour as \"end\", count(*) as events from s group by user_id, k"
)
def event_sessions(spark, sf):
    return live.live_sessions(ad.table(spark, sf, "events"), gap="1 hour")


@query(f"with {ad.CHUNKS} select dataset, count(*) as chunks, round({WER}, 6) as wer from chunks group by dataset")
def running_wer(spark, sf):
    return rounded(live.running_wer(ad.chunks(spark, sf)))
