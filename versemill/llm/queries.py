"""Queries that apply the training-data operators to whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.llm import chat_format, decontaminate, fingerprints, html_extract, jaccard_join, language_id, line_dedup, packing, source_divergence, spelling_variants, substring_dedup, token_counts, toxicity


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROBE = "</s>[INST] ok [/INST]"


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP3_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), spread as (
  select item_id, w, least(len(w), 13) as size, unnest(range(1, greatest(len(w) - 11, 2))) as i from items where len(w) > 0
), windows as (
  select distinct item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as win from spread
), sizes as (
  select distinct size from windows
), places as (
  select doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) as i from words, sizes
), hits as (
  select p.doc_id, p.i, p.size, t.item_id from (select doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as win from places) p join windows t using (size, win)
), covered as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + size)) as k from hits) group by doc_id
), named as (
  select doc_id, count(distinct item_id) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by doc_id
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w.w) as contaminated
from words w left join covered using (doc_id) left join named using (doc_id)
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as win from (select doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) as i from words)
), least as (
  select win, min(doc_id) as d from windows group by win
), gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as k from windows join least using (win) where d < doc_id
), kept as (
  select doc_id, k, w[k] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as k from words) anti join gone using (doc_id, k)
), told as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by k) as t from kept group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words left join told using (doc_id)
"""


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_chats(rows.unionByName(probe)))


OP5_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'
), told as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
         sum(length(text) + case role when 'user' then 13 when 'system' then 15 when 'assistant' then 11 else 25 + length(role) end) as bare
  from rows group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
       cast(3 + bare + case when conv_id = -1 then 6 else 0 end as bigint) as formatted_chars
from told
"""


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), spread as (
  select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0
), shingles as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s from spread
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)
), both_ways as (
  select x, y from links union all select y, x from links
), reach as (
  select doc_id as x, doc_id as y from documents union select r.x, b.y from reach r join both_ways b on r.y = b.x
)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, c.component_id
from documents d left join sizes using (doc_id) join (select x as doc_id, min(y) as component_id from reach group by x) c using (doc_id)
"""


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_spellings(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with recursive poly as (
  select list_transform(range(256), lambda k: list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(k as bigint))) as t
), told as (
  select doc_id, w, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as w from documents) where length(w) >= 6 group by all
), coded as (
  select doc_id, w, n, list_transform(flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || w, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] end)), lambda b: cast(b as bigint)) as bytes from told
), hashed as (
  select doc_id, w, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) as h from coded, poly
), edited as (
  select case when h % 199 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from hashed
), words as (
  select word, cast(sum(n) as bigint) as n from edited where length(word) >= 6 group by word having sum(n) >= 5
), spots as (
  select word, n, unnest(range(1, length(word) + 1)) as k from words
), marked as (
  select word, n, k, left(word, k - 1) || '*' || substr(word, k + 1) as hole, left(word, k - 1) || substr(word, k + 1) as less from spots
), pairs as (
  select a.word, b.word as other, b.n as other_n from marked a join marked b on a.hole = b.hole and a.word <> b.word
  union select a.word, b.word, b.n from words a join marked b on a.word = b.less
  union select b.word, a.word, a.n from words a join marked b on a.word = b.less
), best as (
  select word, count(*) as n_near, max(other_n) as top from pairs group by word
), forms as (
  select w.word, case when top >= 5 * w.n then f.other end as form, w.n, coalesce(n_near, 0) as n_near, case when top >= 5 * w.n then top end as form_n
  from words w left join best using (word) left join (select p.word, min(p.other) as other from pairs p join best b on p.word = b.word and p.other_n = b.top group by p.word) f on f.word = w.word
), chain as (
  select word, word as leads, 0 as steps from forms union all select c.word, f.form, steps + 1 from chain c join forms f on f.word = c.leads where f.form is not null
)
select f.word, f.form, c.root, f.n, cast(n_near as bigint) as n_near, form_n from forms f join (select word, arg_max(leads, steps) as root from chain group by word) c on c.word = f.word
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit_sources(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with docs as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), counted as (
  select lang, source, term, count(*) as docs, sum(n) as n from (select lang, source, d, term, count(*) as n from (select lang, source, d, unnest(w) as term from docs) group by all) group by all
), terms as (
  select lang, term, cast(sum(n) as hugeint) as n from counted group by all having sum(docs) >= 10
), sizes as (
  select lang, cast(count(*) as hugeint) as v, sum(n) as n from terms group by lang
), groups as (
  select distinct lang, source from docs
), filled as (
  select g.lang, g.source, t.term, cast(coalesce(c.n, 0) as hugeint) as n from groups g join terms t using (lang) left join counted c on c.lang = g.lang and c.source = g.source and c.term = t.term
), shares as (
  select f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 2)) // (sum(f.n) over (partition by f.lang, f.source) + 2 * s.v) as p from filled f join sizes s using (lang)
), general as (
  select t.lang, t.term, 1 + (1000000000 * (t.n + 2)) // (s.n + 2 * s.v) as q from terms t join sizes s using (lang)
), pair as (
  select a.lang, a.source, b.source as item, cast(coalesce(sum(((p.p - q.p) * (p.p - q.p)) // (p.p + q.p)), 0) as bigint) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join shares p on p.lang = a.lang and p.source = a.source left join shares q on q.lang = b.lang and q.source = b.source and q.term = p.term
  group by all
), term as (
  select lang, source, term as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value from shares join general using (lang, term) where n > 0 and p > q
), ranked as (
  select lang, source, 'pair' as part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from pair
  union all
  select lang, source, 'term', item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) from term
)
select * from ranked where part = 'pair' or rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_line_dedup": op2_line_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_html_extraction": op6_html_extraction,
        "op7_language_id": op7_language_id,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_document_fingerprints": op9_document_fingerprints,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_token_counts": op12_token_counts,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_chat_formatting": OP5_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op13_source_divergence": OP13_SQL}
