"""Arrow functions give their results slice by slice: what they hold does not grow with the batch."""

import pyarrow as pa
import pytest

from versemill.functions import alignment, comparison, slices, tokenizer

TEXTS = ["One two, (three) four.\n\nFive", None, "", "word " * 300, "don't <nl>la la</nl>", "a\nb"] * 20
HEARD = ["one too three four five six", "x", None, "word " * 290, "do not la", "a b"] * 20


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(slices, "SLICE_BYTES", 500)


def test_slices_have_all_rows_in_order(small):
    texts, lists = pa.array(TEXTS), pa.array([None if t is None else t.split() for t in TEXTS], pa.list_(pa.string()))
    made = list(slices.in_slices(texts, lists))
    assert [t for rows, _ in made for t in rows] == TEXTS and [w for _, rows in made for w in rows] == lists.to_pylist()
    assert len(made) > 30 and list(slices.in_slices(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("words_only", [True, False])
def test_texts_are_compared_in_slices(words_only, monkeypatch):
    batch = pa.array(TEXTS), pa.array(HEARD), pa.array(["en"] * len(TEXTS))
    whole = [x for a in comparison._compared(iter([batch]), words_only) for x in a.to_pylist()]
    monkeypatch.setattr(slices, "SLICE_BYTES", 500)
    made = list(comparison._compared(iter([batch]), words_only))
    assert len(made) > 30 and [x for a in made for x in a.to_pylist()] == whole


def results(spark, function, *arrays):
    """What an Arrow function gives for one batch, through Spark."""
    rows = spark.createDataFrame(list(zip(range(len(arrays[0])), *arrays, strict=True)), "k int, " + ", ".join(f"c{k} {'array<string>' if isinstance(a[0], list) else 'string'}" for k, a in enumerate(arrays))).coalesce(1)
    return [r[0] for r in rows.select(function(*[f"c{k}" for k in range(len(arrays))]).alias("x"), "k").orderBy("k").collect()]


def test_tokens_are_made_in_slices(small):
    batch = pa.array(TEXTS), pa.array(["en"] * len(TEXTS))
    made = list(tokenizer._tokens_of.func(iter([batch])))
    assert len(made) > 30
    assert [[(t["text"], t["tags"]) for t in x] for a in made for x in a.to_pylist()] == [tokenizer.tag(tokenizer.tokenize(t, "en")) for t in TEXTS]


def test_functions_of_tokens_over_slices(spark):
    tokens, heard = ([(t or "").split() for t in texts] * 40 for texts in (TEXTS, HEARD))
    assert results(spark, tokenizer.plain_tokens, TEXTS * 40, ["en"] * len(tokens)) == [tokenizer.tokenize(t, "en") for t in TEXTS] * 40
    assert results(spark, alignment.word_edit_distance, tokens, heard) == [alignment.distance(a, b) for a, b in zip(tokens[: len(TEXTS)], heard, strict=False)] * 40
    assert [list(map(tuple, x)) for x in results(spark, alignment.align_words, tokens, heard)] == [alignment.align(a, b) for a, b in zip(tokens[: len(TEXTS)], heard, strict=False)] * 40
    assert [[(t.text, t.tags) for t in x] for x in results(spark, tokenizer.rich_tokens, tokens)] == [tokenizer.tag(x) for x in tokens]


def test_long_stretches_are_not_kept():
    tokenizer._pieces.cache_clear(), tokenizer._kind.cache_clear()
    tokenizer.tag(tokenizer.tokenize("a-b" * 5000 + " " + "c" * 5000, "en"))
    assert tokenizer._pieces.cache_info().currsize == 0 and tokenizer._kind.cache_info().currsize < 10
