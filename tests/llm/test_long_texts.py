"""Texts of megabytes, in one line, one word, many lines or white space, through every operator and the pipeline."""

import random

import pytest

import corpus_pipeline
from versemill.llm import chat_format, fingerprints, language_id, line_dedup, packing, source_divergence, spelling_variants, token_counts, toxicity
from versemill.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, line string, token int, removed int, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "k", "l", 1, 2, 3) for d, t in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    random.seed(71)
    words = ["".join(random.choices("abcdefgh", k=random.randint(3, 9))) for _ in range(500)]
    say = lambda n: " ".join(random.choices(words, k=n))
    line = say(30_000)
    changed = line[:100_000] + "X" + line[100_001:]
    return [(1, say(200_000)), (2, "w" * 1_000_000), (3, " " * 1_100_000 + "x"), (4, "\n".join(say(4) for _ in range(60_000))), (5, line), (6, changed), (7, say(50) + " moron"), (8, None), (9, ""), (10, "\n" * 300_000)]


def test_scores(spark, rows):
    lexicon = toxicity.Lexicon({" moron ": 5.0}, ())
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(frame(spark, rows), lexicon).collect()}
    assert len(got) == len(rows) and got[7] == 1 and sum(got.values()) == 1
    model = language_id.fit([(g, language_id.profile(t)) for g, t in (("de", "und der die das"), ("en", "the and of to"))])
    told = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame(spark, rows), model).collect()}
    assert {d for d, g in told.items() if g == "und"} == {8, 9, 10}


def test_lines(spark, rows):
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_report(frame(spark, rows)).collect()}
    assert got[6] == (1, 1) and got[5] == (1, 0) and got[2] == (1, 0) and got[10] == (300_001, 0) and got[4][0] == 60_000


def test_fingerprints_and_counts(spark, rows):
    prints = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(frame(spark, rows)).collect()}
    assert len(prints) == len(rows) and prints[1]["n_chars"] == len(rows[0][1]) and prints[6]["near_next"] > 0.9
    assert sum(r["n_tokens"] > 4096 for r in token_counts.count_tokens(frame(spark, rows), tokenizer_path("piece_bpe_32k.model")).collect()) == 7
    assert spelling_variants.group_spellings(frame(spark, rows)).count() > 100 and source_divergence.audit_sources(frame(spark, rows)).count() == 0
    pieces = packing.tokenize(frame(spark, rows), tokenizer_path()).groupBy("doc_id").count().count()
    assert pieces == len(rows)


def test_chats(spark, rows):
    said = spark.createDataFrame([(1, 0, "user", rows[0][1]), (1, 1, "assistant", rows[1][1]), (2, 0, "user", rows[2][1]), (2, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_format.read_back(chat_format.format_chats(said)).collect()}
    assert got == {1: (2, 1_000_000), 2: (2, 0)}


def tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d == 7)) for d in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "some words of an item that no text here has in it at all, not one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_of_long_texts(spark, rows, tmp_path):
    """Clashing columns go through all stages; a text that white space fills does not stop the corpus."""
    folder = tables(spark, str(tmp_path), frame(spark, rows))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == names
    kept = {r[0] for r in docs.select("doc_id").collect()}
    assert {1, 2, 3, 4, 5, 8, 9, 10} <= kept and 6 not in kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == kept


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = tables(spark, str(tmp_path), frame(spark, [(1, "a")]).limit(0))
    assert corpus_pipeline.run(spark, folder).count() == 0
