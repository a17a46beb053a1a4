"""Named queries over tokens, tags and report rows, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill.functions import text as tx
from versemill.functions.tokenizer import _ABBREVIATIONS, _BEFORE_NUMBERS, LINE, NONLEXICAL, WORD, texts_of, tokens_of
from versemill.operators import evaluation as ev
from versemill.operators import render
from versemill.plans import adapters as ad
from versemill.plans.registry import query, rounded

OWN, INNER, NUMBER_COMMA = chr(0xE000), chr(0xE001), chr(0xE002)  # an apostrophe of its word, one inside a word, a comma in a number
W = rf"\pL\pM\pN*{OWN}{INNER}"
LETTER, Q = r"[\pL\pM\pN_]", "''"


def _by_language(table: dict[str, frozenset[str]]) -> str:
    listed = {g: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]" for g, words in table.items()}
    return "case lang " + " ".join(f"when '{g}' then {v}" for g, v in listed.items() if g != "en") + f" else {listed['en']} end::varchar[]"


def _replaced(x: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def tokens(source: str, key: str, text: str, lang: str = "'en'") -> str:
    """SQL of found(key, n, k, t): a text's tokens by line and place, and a row for each run of newlines (k is null). The same
    cascade of rules, for texts without typographic marks and scripts other than Latin, which the tables lack."""
    shown = _replaced(f"coalesce({text}, '')", (r"[^\pL\pN\pM_\s\pP<>]", " "), (r"\n[^\S\n]+\n", "\n\n"))
    other = "replace(x, ',\"', '\",')"
    quoted = "case when lang = 'en' then " + _replaced("x", ('"([,.]+)', r'\1"')) + " else " + _replaced(other, (r'(\.+)"(\s*[^<])', r'"\1\2')) + " end"
    inner = _replaced("x", *[(f"({LETTER}){Q}({LETTER})", rf"\1{INNER}\2")] * 2)
    edges = _replaced(inner, (f"({LETTER}){Q}", rf"\1{OWN}"), (f"{Q}({LETTER})", rf"{OWN}\1"))
    masked = f"case when lang in ('en', 'fr', 'it') then {edges} else replace(x, chr(39), '{OWN}') end"
    padded = _replaced("x", (rf"([^{W}\s.,-])", r" \1 "), *[(f"([{W}])-([{W}])", r"\1 @-@ \2")] * 2, (r"(\.{2,})", r" \1 "), *[(r"(\pN),(\pN)", rf"\1{NUMBER_COMMA}\2")] * 2, (",", " , "), (NUMBER_COMMA, ","))
    english = _replaced("x", (rf"{INNER}([\pN_])", rf" {Q} \1"), (rf"(\pL){INNER}(\pL)", rf"\1 {Q}\2"), (rf"(\pN){INNER}s", rf"\1 {Q}s"))
    romance = _replaced("x", (rf"{INNER}([\pN_])", rf" {Q} \1"), (rf"(\pL){INNER}(\pL)", rf"\1{Q} \2"), (rf"(\pN){INNER}(\pL)", rf"\1 {Q} \2"))
    german = _replaced("x", (rf"(?i)({LETTER}){OWN}s($|[^\pL\pM\pN_])", rf"\1 {Q}s\2"), (rf"(?i)(^|[^\pL\pM\pN_])(wie|für){OWN}n($|[^\pL\pM\pN_])", rf"\1\2 {Q}n\3"))
    clitics = f"translate(case when lang = 'en' then {english} when lang in ('fr', 'it') then {romance} when lang = 'de' then {german} else x end, '{OWN}{INNER}', repeat(chr(39), 2))"
    chain = (("_lines", "_quoted", quoted), ("_quoted", "_masked", masked), ("_masked", "_padded", padded), ("_padded", "_parted", clitics))
    steps = "".join(f"), {name} as (select {key}, n, lang, {rule} as x from {before}" for before, name, rule in chain)
    after = "left(coalesce(ts[i + 1], ''), 1)"
    stays = (
        f"list_contains({_by_language(_ABBREVIATIONS)}, w) or (lower({after}) = {after} and upper({after}) <> {after}) or (contains(w, '.') and regexp_matches(w, '\\pL')) "
        f"or (list_contains({_by_language(_BEFORE_NUMBERS)}, w) and regexp_matches({after}, '[0-9]'))"
    )
    return f"""_texts as (select {key}, {lang} as lang, regexp_replace({shown}, '\\n+$', '') as x from {source}
), _lines as (select {key}, lang, unnest(string_split(x, chr(10))) as x, unnest(range(len(string_split(x, chr(10))))) as n from _texts{steps}
), _listed as (select {key}, n, list_filter(regexp_split_to_array(x, '\\s+'), lambda t: t <> '') as ts, lang from _parted
), _words as (select {key}, n, lang, ts, unnest(ts) as t, unnest(range(1, len(ts) + 1)) as i from _listed
), _judged as (select *, t like '%_.' and not regexp_matches(t, '^\\.+$') and not ({stays}) as _ends from (select *, left(t, length(t) - 1) as w from _words)
), found as (
  select {key}, n, 2 * i as k, case when _ends then w else t end as t from _judged
  union all select {key}, n, 2 * i + 1, '.' from _judged where _ends
  union all select {key}, null, null, unnest(regexp_extract_all(x, '\\n+')) from _texts)"""


IS_WORD, IS_BREAK = r"regexp_matches(t, '[\pL\pN\pM_]')", "t[1] = chr(10)"


@query(
    rf"with {tokens('documents', 'doc_id', 'text', 'lang')}, counted as (select doc_id, count(*) + count(*) filter (where {IS_BREAK} and length(t) > 1) as tokens, count(*) filter (where {IS_WORD}) as words, count(*) filter (where {IS_BREAK}) as breaks "
    "from found group by doc_id) select doc_id as song_id, cast(coalesce(tokens, 0) as int) as tokens, cast(coalesce(words, 0) as int) as words, cast(coalesce(breaks, 0) as int) as breaks from documents left join counted using (doc_id)"
)
def word_tokens(spark, sf):
    rows = ad.spread(ad.catalog(spark, sf).select("song_id", "text", "language")).select("song_id", tokens_of("text", "language").alias("t"))
    tagged = lambda tag: F.size(F.filter("t", lambda x: F.array_contains(x["tags"], tag)))
    return rows.select("song_id", F.size("t").alias("tokens"), tagged(WORD).alias("words"), tagged(LINE).alias("breaks"))


@query(
    rf"with {tokens('conversations', 'conv_id', 'coalesce(text, chr(32))')}, own as (select count(*) filter (where {IS_WORD}) as words, count(*) filter (where {IS_BREAK}) as breaks, count(*) filter (where {IS_BREAK} and length(t) > 1) as sections, "
    rf"count(*) filter (where not {IS_WORD} and not ({IS_BREAK})) as marks from found), n as (select count(*) as n from conversations) "
    "select * from (select unnest(['word', 'backing', 'punctuation', 'line_break', 'section_break', 'parenthesis', 'nonlexical']) as tag, unnest([words + n, words, marks, breaks, sections, 2 * n, words + marks + breaks + sections + 2 * n]) as tokens, "
    "unnest([false, false, false, false, false, false, true]) as inherited from own, n) where tokens > 0"
)
def rich_tags(spark, sf):
    rows = ad.turns(spark, sf).withColumn("language", F.lit("en")).withColumn("text", F.concat(F.lit("<nl>("), F.col("text"), F.lit(") </nl> ok")))
    tags = rows.select(F.explode(tokens_of("text", "language")).alias("t")).select(F.explode("t.tags").alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("tokens"), (F.col("tag") == NONLEXICAL).alias("inherited"))


CONTRACTED = r"regexp_replace(text, '(\pL{2})(\pL{2}) ', '\1''\2 ', 'g') || ' rock ''n'' roll, Mr. No. 5 and the U.S.A. at www.x.org. 80''s end, geht''s'"
IN_TURN = "case turn % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end"


@query(
    rf"with {tokens('conversations', 'conv_id, turn', CONTRACTED, IN_TURN)} select conv_id, turn, string_agg(t, ' ' order by n, k) as tokens, count(*) as n_tokens, count(*) filter (where contains(t, '''')) as apostrophes "
    "from found where k is not null group by conv_id, turn"
)
def clitic_tokens(spark, sf):
    """Tokens of turns, in four languages in turn, with an apostrophe in most words and abbreviations at the end."""
    text = F.concat(F.regexp_replace("text", r"(\p{L}{2})(\p{L}{2}) ", "$1'$2 "), F.lit(" rock 'n' roll, Mr. No. 5 and the U.S.A. at www.x.org. 80's end, geht's"))
    language = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("turn") % 4 + 1).cast("int"))
    rows = ad.turns(spark, sf).select("conv_id", "turn", text.alias("text"), language.alias("language"))
    found = rows.select("conv_id", "turn", F.filter(texts_of(tokens_of("text", "language")), lambda t: ~t.isin("<L>", "<S>")).alias("t"))
    return found.select("conv_id", "turn", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"), F.size(F.filter("t", lambda t: F.contains(t, F.lit("'")))).cast("long").alias("apostrophes"))


# Full stops and commas are the only tokens that the hypothesis lacks, so every least alignment deletes these and hits the rest.
LOST = r"regexp_matches(t, '^[.,]+$')"


def _scores(tag: str, kind: str) -> str:
    h, d = (f"count(*) filter (where {kind} and {'not ' if lost else ''}{LOST})" for lost in (True, False))
    p, r = f"{h}::double / nullif({h}, 0)", f"{h}::double / nullif({h} + {d}, 0)"
    return f'{p} as "P_{tag}", round({r}, 6) as "R_{tag}", round(case when ({p}) + ({r}) = 0 then 0 else 2 * ({p}) * ({r}) / (({p}) + ({r})) end, 6) as "F1_{tag}"'


@query(
    f"with {tokens('conversations', 'role', 'coalesce(text, chr(32))')} select role as uid, "
    + ", ".join(_scores(t, k) for t, k in (("punc", f"not {IS_WORD} and not ({IS_BREAK}) and t not in ('(', ')')"), ("pare", "t in ('(', ')')"), ("line", IS_BREAK), ("sect", f"{IS_BREAK} and length(t) > 1")))
    + " from found group by role"
)
def tag_prf(spark, sf):
    rows = ad.turns(spark, sf).select(F.col("role").alias("uid"), F.col("turn").alias("sample_idx"), F.lit("en").alias("language"), F.col("text").alias("ref"), F.regexp_replace("text", "[.,]", "").alias("hyp"))
    return rounded(ev.tag_scores(ev.aligned(rows, words_only=False), ["uid"]))


@query(
    f"with {tokens('conversations', 'role', 'coalesce(text, chr(32))')}, "
    + "tags as (select role as uid, "
    + ", ".join(_scores(t, k) for t, k in (("punc", f"not {IS_WORD} and not ({IS_BREAK}) and t not in ('(', ')')"), ("pare", "t in ('(', ')')"), ("line", IS_BREAK), ("sect", f"{IS_BREAK} and length(t) > 1")))
    + f" from found group by role), said as (select role as uid, count(*) filter (where {IS_WORD}) as n from found group by role) "
    + 'select uid, 0.0::double as "WER", 0.0::double as "WER_near", 0.0::double as "MER", 0.0::double as "WIL", n as hits, 0.0::double as near, 0::bigint as substitutions, 0::bigint as deletions, 0::bigint as insertions, 0::bigint as nears, '
    + '0.0::double as sub_rate, 0.0::double as del_rate, 0.0::double as ins_rate, 0.0::double as "ER_case", 0.0::double as "WER_case", n as total_len, 0::bigint as deletions_backing, 0::bigint as deletions_nonlexical, tags.* exclude (uid) from said join tags using (uid)'
)
def all_metrics(spark, sf):
    """Word metrics and tag scores of turns of which full stops and commas were lost."""
    rows = ad.turns(spark, sf).select(F.col("role").alias("uid"), F.col("turn").alias("sample_idx"), F.lit("en").alias("language"), F.col("text").alias("ref"), F.regexp_replace("text", "[.,]", "").alias("hyp"))
    return rounded(ev.all_metrics(ad.spread(rows), ["uid"]))


WORDS = r"\pL\pN\pM_"
HEAD = rf"regexp_extract(x, '^[^{WORDS}]*[{WORDS}]')"


@query(
    rf"""with {ad.CATALOG}, l as (select song_id, list_transform(string_split(text, chr(10)), lambda line: left(line, 1) || regexp_replace(substring(line, 2), '[^{WORDS}!?''´‘’"“”»)]+ *$', '')) as ls from songs)
select song_id, array_to_string(list_transform(ls, lambda x: replace(upper({HEAD}), 'ẞ', 'SS') || substring(x, length({HEAD}) + 1)), chr(10)) as text from l"""
)
def normalize_lines_plain(spark, sf):
    return ad.catalog(spark, sf).select("song_id", tx.normalize_lyrics_plain(F.col("text")).alias("text"))


@query(
    r"with w as (select conv_id, unnest(regexp_extract_all(coalesce(text, ''), '[\pL\pN]+')) as r from conversations), p as (select conv_id, r, translate(r, 'aeiou', 'AEIOU') as h from w) "
    "select conv_id, count(*) filter (where r <> h and lower(r) = lower(h)) as errors, count(*) as words from p group by conv_id"
)
def case_errors(spark, sf):
    words = ad.turns(spark, sf).select("conv_id", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("r"))
    wrong = tx.case_error(F.col("r"), F.translate("r", "aeiou", "AEIOU"))
    return words.groupBy("conv_id").agg(F.count_if(wrong).alias("errors"), F.count("*").alias("words"))


@query(
    f"""with recursive {ad.ALIGNED}, placed as (
  select *, coalesce(sum(case when typ <> 'ins' then 1 end) over w, 0) as i, coalesce(sum(case when typ <> 'del' then 1 end) over w, 0) as j, case when typ = lag(typ) over (partition by uid, sample_idx order by k) then 0 else 1 end as opens
  from ops window w as (partition by uid, sample_idx order by k rows between unbounded preceding and 1 preceding)
), lined as (
  select o.*, len(p.h) as heard, case when typ = 'ins' then greatest(0, least(i // 5, (len(p.r) - 1) // 5)) else i // 5 end as line, sum(opens) over (partition by o.uid, o.sample_idx order by k rows unbounded preceding) as chunk
  from placed o join pairs p using (uid, sample_idx)
), pieces as (
  select uid, sample_idx, chunk, line, typ, string_agg(ref, ' ' order by k) as r, string_agg(hyp, ' ' order by k) as h, min(j) as j, any_value(heard) as heard from lined group by uid, sample_idx, chunk, line, typ
)
select uid, sample_idx, line::bigint as line_no, row_number() over (partition by uid, sample_idx order by chunk, line) - 1 as piece_idx, case typ when 'hit' then 'equal' when 'sub' then 'substitute' when 'del' then 'delete' else 'insert' end as chunk_type,
  case when typ = 'ins' then repeat('+', length(h)) else r end as ref_text, case when typ = 'del' then repeat('-', length(r)) when typ = 'hit' then r else h end as hyp_text,
  case when heard > 0 then round(greatest(0.1::double, least(j, heard - 1)::double / heard * 10), 6) else 0 end as timestamp from pieces"""
)
def render_pairs(spark, sf):
    """Report rows of turns that break after every fifth word."""
    words = F.split("ref", " ")
    broken = F.array_join(F.transform(words, lambda w, k: F.concat(w, F.when(k % 5 == 4, "\n").otherwise(" "))), "")
    keys = ["uid", "sample_idx"]
    rows = ev.aligned(ad.pairs(spark, sf).withColumn("ref", broken))
    times = render.hyp_timestamps(F.array(F.struct(F.lit(0.0).alias("start"), F.lit(10.0).alias("end"), F.size("hyp_words").alias("n_words"))))
    return rounded(render.render_rows(render.split_chunks(rows, keys, times=times), keys))


@query(
    rf"""with {tokens("conversations", "conv_id, turn", "text")}, spoken as (
  select conv_id, turn, row_number() over (partition by conv_id, turn order by n, k) - 1 as i, dense_rank() over (partition by conv_id, turn order by n) - 1 as line, regexp_replace(t, '[^\pL\pN\pM_'']', '', 'g') as w from found where k is not null and {IS_WORD}
), typed as (
  select *, w = 'of' as changed, count(*) over (partition by conv_id, turn) as heard, case when (w = 'of') = lag(w = 'of') over (partition by conv_id, turn order by i) then 0 else 1 end as opens from spoken
), cut as (
  select *, sum(opens) over (partition by conv_id, turn order by i rows unbounded preceding) as chunk from typed
), pieces as (
  select conv_id, turn, chunk, line, changed, min(i) as j, any_value(heard) as heard, string_agg(w, ' ' order by i) as r, string_agg(case when changed then 'off' else w end, ' ' order by i) as h from cut group by conv_id, turn, chunk, line, changed
) select conv_id as uid, turn as sample_idx, line::bigint as line_no, row_number() over (partition by conv_id, turn order by chunk, line) - 1 as piece_idx, case when changed then 'substitute' else 'equal' end as chunk_type, r as ref_text, h as hyp_text,
  round(greatest(0.1::double, j::double / heard * 10), 6) as timestamp from pieces"""
)
def split_lines_render(spark, sf):
    rows = ad.turns(spark, sf).select(F.col("conv_id").alias("uid"), F.col("turn").alias("sample_idx"), F.lit("en").alias("language"), F.col("text").alias("ref"), F.regexp_replace("text", r"\bof\b", "off").alias("hyp"))
    keys = ["uid", "sample_idx"]
    rows = ev.aligned(rows)
    times = render.hyp_timestamps(F.array(F.struct(F.lit(0.0).alias("start"), F.lit(10.0).alias("end"), F.size("hyp_words").alias("n_words"))))
    return rounded(render.render_rows(render.split_chunks(rows, keys, times=times), keys))
