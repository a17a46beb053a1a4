"""The pipeline's stages on a small corpus."""

import random

import pytest

import corpus_pipeline
from versemill.llm import packing
from versemill.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(21)
    path = str(tmp_path_factory.mktemp("tables"))
    words = ["".join(random.choices("abcdefgh", k=random.randint(3, 9))) for _ in range(400)]
    say = lambda n: " ".join(random.choices(words, k=n))
    docs = [(d, say(60) + "\n" + say(40)) for d in range(200)]
    for d in range(0, 100, 4):
        docs[d] = (d, docs[d][1] + " moron")
    bench = [(1, say(40)), (2, say(20))]
    docs += [(300, bench[0][1] + "\n" + say(30)), (301, docs[1][1]), (302, docs[2][1].split("\n")[0] + "\n" + say(50)), (303, None), (304, "tiny")]
    near = docs[3][1].replace("\n", " ").split()
    near[10] = "changed"
    docs.append((305, " ".join(near)))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d < 100 and d % 4 == 0)) for d in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert docs.columns == names
        docs.write.parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        kept[name] = {r["doc_id"] for r in docs.collect()}
    assert kept["toxicity"] == ids - set(range(0, 100, 4))
    assert kept["toxicity"] - kept["line_dedup"] == {301}  # an exact copy has no line left
    assert kept["line_dedup"] - kept["ngram_jaccard_join"] == {305}
    assert kept["ngram_jaccard_join"] - kept["benchmark_decontamination"] == {300}
    assert kept["best_fit_packing"] == kept["benchmark_decontamination"]
    lines = spark.read.parquet(f"{folder}/out/line_dedup").where("doc_id = 302").first()
    assert "\n" not in lines["text"] and lines["n_chars"] == len(lines["text"])
    again = corpus_pipeline.run(spark, folder)
    assert again.count() == docs.count() and packing.tokenize(spark.read.parquet(f"{folder}/out/benchmark_decontamination"), tokenizer_path()).count() == docs.count()
