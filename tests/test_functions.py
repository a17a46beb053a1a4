import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versemill.functions import alignment as al
from versemill.functions import text as tx
from versemill.functions import tokenizer as tk

NEAR = [("an", "and"), ("gon'", "gonna"), *itertools.combinations(["their", "they", "there", "them"], 2)]


def column(spark, rows, names, c):
    return [r[0] for r in spark.createDataFrame(rows, names).select(c).collect()]


def test_near_miss(spark):
    rows = [*NEAR, ("a", "an"), ("this", "that")]
    assert column(spark, rows, "a string, b string", tx.near_miss(F.col("a"), F.col("b"))) == [True] * len(NEAR) + [False, False]


def test_word_dist(spark):
    got = column(spark, [("don't", "dont"), ("A", "a"), (None, "a")], "a string, b string", tx.word_dist(F.col("a"), F.col("b")))
    assert got[:2] == [0, 1] and math.isnan(got[2])


def test_normalise_and_clean(spark):
    assert column(spark, [("hello, \nworld...\n,\n...\nok!",)], "t string", tx.normalize_lyrics(F.col("t"))) == ["Hello\nWorld\n,\n.\nOk!"]
    assert column(spark, [("Héllo <nl>la la</nl> (ooh yeah)  world , ok",)], "t string", tx.clean_text(F.col("t"))) == ["Héllo la la world, ok"]
    assert column(spark, [("\u3000ｆｕｌｌ\u00a0 width\u2003，x ",)], "t string", tx.clean_text(F.col("t"))) == ["full width,x"]


def test_tags():
    got = tk.tag(tk.tokenize("( oh ) hey <nl> na , </nl> \n \n\n -"))
    assert got == [
        ("(", ["parenthesis"]), ("oh", ["backing", "word"]), (")", ["parenthesis"]), ("hey", ["word"]), ("na", ["nonlexical", "word"]), (",", ["nonlexical", "punctuation"]),
        ("<L>", ["line_break"]), ("<S>", ["section_break"]), ("-", ["punctuation"]),
    ]


@pytest.mark.parametrize(("text", "language", "tokens"), [
    ("don't stop, now...", "en", ["don", "'t", "stop", ",", "now", "..."]),
    ("it's y'all's a'b'c 80's 5'6 5'a", "en", ["it", "'s", "y", "'all", "'s", "a", "'b'c", "80", "'s", "5", "'", "6", "5'a"]),
    ("rock 'n' roll, goin' 'cause", "en", ["rock", "'n'", "roll", ",", "goin'", "'cause"]),
    ("l'amour d’une fille, aujourd'hui 'n' 5'a", "fr", ["l'", "amour", "d'", "une", "fille", ",", "aujourd'", "hui", "'n'", "5", "'", "a"]),
    ("dell'alba c'è", "it", ["dell'", "alba", "c'", "è"]),
    ("geht's für'n don't", "de", ["geht", "'s", "für", "'n", "don't"]),
    ("pa'lante", "es", ["pa'lante"]),
    ("The U.S.A. and www.x.org, e.g. Dr. No. Stop.", "en", ["The", "U.S.A.", "and", "www.x.org", ",", "e.g.", "Dr.", "No", ".", "Stop", "."]),
    ("No. 5 is No. Go on. and J. Doe...yes. Nr. 3", "en", ["No.", "5", "is", "No", ".", "Go", "on.", "and", "J.", "Doe", "...", "yes", ".", "Nr", ".", "3"]),
    ("usw. Und Mme. Str. 5", "de", ["usw.", "Und", "Mme.", "Str.", "5"]),
    ("5,000 a,b 5,a ,5 3.14 .5", "en", ["5,000", "a", ",", "b", "5", ",", "a", ",", "5", "3.14", ".5"]),
    ("f*** -- a-b-c -x y- @-@ a_b", "en", ["f***", "--", "a", "@-@", "b", "@-@", "c", "-x", "y-", "@", "-", "@", "a", "_", "b"]),
    ('"yes", he said "no."', "en", ['"', "yes", ",", '"', "he", "said", '"', "no", ".", '"']),
    ("„ja,“ – nein — 1\u00a0000", "de", ['"', "ja", '"', ",", "-", "nein", "-", "1,000"]),
    ("<NL>la-la</nl>(oh)", "en", ["<NL>", "la", "@-@", "la", "</nl>", "(", "oh", ")"]),
    ("ｱｲabcΑβγ ＡＢЖ ﬁ가 カー5 ア1", "ja", ["ｱ", "ｲ", "abc", "Αβγ", "ＡＢ", "Ж", "ﬁ", "가", "カ", "ー5", "ア", "1"]),
    ("well-known", "en", ["well", "@-@", "known"]),
    ("geht's gut", "de", ["geht", "'s", "gut"]),
    ("漢字abc", "ja", ["漢", "字", "abc"]),
    ("a\n\nb\n", "en", ["a", "\n", "\n\n", "b"]),
    (None, None, []),
])
def test_tokenize(text, language, tokens):
    assert tk.tokenize(text, language) == tokens


def test_alignment_golden():
    assert al.align("abcd", "axc") == [("equal", 0, 1, 0, 1), ("substitute", 1, 2, 1, 2), ("equal", 2, 3, 2, 3), ("delete", 3, 4, 3, 3)]
    kinds = al.align("the cat sat on the mat".split(), "the bat sat on mat now".split())
    assert sum(max(c[2] - c[1], c[4] - c[3]) for c in kinds if c[0] != "equal") == 3


def table(ref, hyp):
    rows = [list(range(len(hyp) + 1))]
    for i, x in enumerate(ref, 1):
        rows.append([i])
        for j, y in enumerate(hyp, 1):
            rows[i].append(min(rows[i - 1][j] + 1, rows[i][-1] + 1, rows[i - 1][j - 1] + (x != y)))
    return rows


def slow_steps(ref, hyp):
    """The path back through the whole table: diagonal before deletion before insertion."""
    d, i, j, out = table(ref, hyp), len(ref), len(hyp), []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append("equal" if ref[i] == hyp[j] else "substitute")
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append("delete")
        else:
            j -= 1
            out.append("insert")
    return out[::-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.sampled_from([1, 3, 256]))
def test_alignment_by_table(ref, hyp, block):
    kept, al.BLOCK = al.BLOCK, block
    try:
        steps = [kind for kind, r0, r1, h0, h1 in al.align(ref, hyp) for _ in range(max(r1 - r0, h1 - h0))]
    finally:
        al.BLOCK = kept
    assert steps == slow_steps(ref, hyp)
    assert al.distance(ref, hyp) == table(ref, hyp)[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_alignment_invariants(ref, hyp):
    n = dict.fromkeys(("equal", "substitute", "delete", "insert"), 0)
    at = (0, 0)
    for kind, r0, r1, h0, h1 in al.align(ref, hyp):
        assert (r0, h0) == at
        at = (r1, h1)
        n[kind] += max(r1 - r0, h1 - h0)
    assert at == (len(ref), len(hyp))
    assert n["delete"] - n["insert"] == len(ref) - len(hyp)
    assert n["equal"] + n["substitute"] + n["delete"] == len(ref)
    d = list(range(len(hyp) + 1))
    for i, x in enumerate(ref, 1):
        d, old = [i], d
        for j, y in enumerate(hyp, 1):
            d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
    assert d[-1] == n["substitute"] + n["delete"] + n["insert"]


def test_word_distance(spark):
    random.seed(3)
    rows = [([random.choice("abcdé") for _ in range(random.randint(0, 8))], [random.choice("abcdé") for _ in range(random.randint(0, 8))]) for _ in range(60)]
    got = column(spark, rows, "a array<string>, b array<string>", al.word_edit_distance(F.col("a"), F.col("b")))
    assert got == [table(a, b)[-1][-1] for a, b in rows]
    assert column(spark, [(None, ["a"]), (["a"], None)], "a array<string>, b array<string>", al.word_edit_distance(F.col("a"), F.col("b"))) == [None, None]
