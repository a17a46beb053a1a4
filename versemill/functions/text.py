"""Text functions as column expressions: they run in the JVM, inside code generation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: characters that may end a line besides word characters.
LINE_END = "!?'´‘’\"“”»)"


def _strip_line_ends(text: Column, allowed: str) -> Column:
    # the first character of a line never goes; (?Umd): Unicode classes, $ and ^ at newlines only
    return F.regexp_replace(text, F.lit(rf"(?Umd)(?<!^)[^\w\n{allowed}]+ *$"), F.lit(""))


def _capitalise_lines(text: Column) -> Column:
    def capital(line: Column) -> Column:
        head = F.call_function("regexp_extract", line, F.lit(r"(?U)^[^\w]*\w"), F.lit(0))
        return F.concat(F.upper(head), F.substring(line, F.char_length(head) + 1, F.char_length(line)))

    return F.array_join(F.transform(F.split(text, "\n", -1), capital), "\n")


def normalize_lyrics(text: Column) -> Column:
    """Evaluation form: ``>,`` becomes ``>``, punctuation at line ends goes, the first letter of each line is capital."""
    return _capitalise_lines(_strip_line_ends(F.regexp_replace(text, ">,", ">"), LINE_END + ">"))


def normalize_lyrics_plain(text: Column) -> Column:
    """The same without regard to tags."""
    return _capitalise_lines(_strip_line_ends(text, LINE_END))


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, which the JVM functions lack."""
    for s in batches:
        yield s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def clean_text(text: Column, compose: bool = True) -> Column:
    """Training form: NFKC, then tags and parentheses with their content go, no space before a comma, single spaces, trimmed.

    White space is that of any script. NFKC goes through Arrow, once and for texts beyond ASCII only; ``compose=False``
    leaves it out, for texts known to be composed, and keeps the rest in the JVM.
    """
    # declared as not deterministic, which is not so: else a filter on the result would compose all texts a second time
    out = F.coalesce(nfkc.asNondeterministic()(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text) if compose else text
    for pattern, to in ((r"</?nl>", ""), (r"\([^)]*\)", ""), (r"(?U)\s+,", ","), (r"(?U)\s+", " ")):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return F.trim(out)


def strip_edge_apostrophes(word: Column) -> Column:
    return F.btrim(word, F.lit("'"))


def near_miss(ref: Column, hyp: Column) -> Column:
    """One or two edits between the lower-cased words without edge apostrophes, fewer than half the longer word."""
    a, b = strip_edge_apostrophes(F.lower(ref)), strip_edge_apostrophes(F.lower(hyp))
    d = F.levenshtein(a, b)
    return d.isin(1, 2) & (F.greatest(F.char_length(a), F.char_length(b)) > 2 * d)


def word_dist(ref: Column, hyp: Column) -> Column:
    """Case-sensitive edits between the words without apostrophes; NaN if either is null."""
    plain = lambda w: F.replace(w, F.lit("'"), F.lit(""))
    return F.coalesce(F.levenshtein(plain(ref), plain(hyp)).cast("double"), F.lit(float("nan")))


def case_error(ref: Column, hyp: Column) -> Column:
    return (ref != hyp) & (F.lower(ref) == F.lower(hyp))


def has_words(text: Column) -> Column:
    """Whether a word is left when tags are taken away."""
    return F.regexp_replace(text, "(?i)</?nl>", "").rlike(r"(?U)\w")


# ISO 639 codes of two letters and of three (a second one where bibliographies differ), and English names.
ISO_639 = """
af afr Afrikaans
ar ara Arabic
az aze Azerbaijani
be bel Belarusian
bg bul Bulgarian
bn ben Bengali
bs bos Bosnian
ca cat Catalan
cs ces/cze Czech
cy cym/wel Welsh
da dan Danish
de deu/ger German
el ell/gre Greek
en eng English
eo epo Esperanto
es spa Spanish
et est Estonian
eu eus/baq Basque
fa fas/per Persian
fi fin Finnish
fr fra/fre French
ga gle Irish
gl glg Galician
he heb Hebrew
hi hin Hindi
hr hrv Croatian
hu hun Hungarian
hy hye/arm Armenian
id ind Indonesian
is isl/ice Icelandic
it ita Italian
ja jpn Japanese
ka kat/geo Georgian
ko kor Korean
la lat Latin
lt lit Lithuanian
lv lav Latvian
mk mkd/mac Macedonian
ms msa/may Malay
nl nld/dut Dutch
no nor Norwegian
pl pol Polish
pt por Portuguese
ro ron/rum Romanian
ru rus Russian
sk slk/slo Slovak
sl slv Slovenian
sq sqi/alb Albanian
sr srp Serbian
sv swe Swedish
sw swa Swahili
ta tam Tamil
te tel Telugu
th tha Thai
tr tur Turkish
uk ukr Ukrainian
ur urd Urdu
vi vie Vietnamese
yi yid Yiddish
zh zho/chi Chinese
"""


def iso_part1(code: Column) -> Column:
    """Two-letter codes from names or three-letter codes of the languages listed; any two-letter code passes, other values are null."""
    known = {}
    for line in ISO_639.strip().split("\n"):
        two, threes, name = line.split(" ")
        known |= dict.fromkeys([*threes.split("/"), name.lower()], two)
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.element_at(pairs, F.lower(code)), F.when(F.char_length(code) == 2, F.lower(code)))
