import datetime
import gzip
import itertools
import json
import math
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from versemill.functions import text as tx
from versemill.operators import analytics as an
from versemill.operators import catalog as cat
from versemill.operators import evaluation as ev
from versemill.operators import intervals as iv
from versemill.operators import pools, render, tasks, vad
from versemill.sources import io

LINES = "song_id long, line_idx long, start double, end double, text string"


def test_merge_golden(spark):
    lines = spark.createDataFrame([(1, 0, 1.0, 3.0, "a\n"), (1, 1, 2.5, 4.0, "b\n"), (1, 2, 4.1, 6.0, "c\n"), (1, 3, 10.0, 12.0, "d\n")], LINES)
    durations = spark.createDataFrame([(1, 20.0)], "song_id long, duration double")
    got = sorted((round(r["start"], 6), round(r["end"], 6), r["text"]) for r in iv.merge_lines(lines, durations).collect())
    assert got == [(0.5, 4.0, "a\nb\n"), (4.1, 6.5, "c\n"), (9.5, 12.5, "d\n")]


def test_islands_against_union_find(spark):
    random.seed(5)
    rows = [(s, k, a := random.randint(0, 40) / 4, a + random.randint(-1, 12) / 4, "x") for s in range(40) for k in range(random.randint(1, 12))]
    got = {(r["song_id"], r["line_idx"]): r["island"] for r in iv.overlap_islands(spark.createDataFrame(rows, LINES)).collect()}
    for s in range(40):
        mine = [r for r in rows if r[0] == s]
        label = {r[1]: r[1] for r in mine}
        for _ in mine:
            for p, q in itertools.permutations(mine, 2):
                if min(p[3], q[3]) - max(p[2], q[2]) > 0.2:
                    label[p[1]] = label[q[1]] = min(label[p[1]], label[q[1]])
        assert all(got[s, k] == v for k, v in label.items())


def test_group_lines(spark):
    rows = [(1, k, float(a), float(b), "x") for k, (a, b) in enumerate([(0, 10), (11, 20), (21, 32), (33, 40)])]
    got = sorted((r["start"], r["end"]) for r in iv.group_lines(spark.createDataFrame(rows, LINES)).collect())
    assert got == [(0, 20), (21, 40)]
    rows = spark.createDataFrame([(1, k, float(a), float(b), "x") for k, (a, b) in enumerate([(0, 1), (10, 12), (13, 15)])], LINES)
    spans = lambda **o: sorted((r["start"], r["end"]) for r in iv.group_lines(rows, **o).collect())
    assert spans() == [(0, 1), (10, 15)] and spans(drop_first_on_gap=True) == [(10, 15)]


def test_partition_is_best():
    random.seed(2)
    for _ in range(150):
        at, spans = 0.0, []
        for _ in range(random.randint(1, 8)):
            spans.append((at, at + random.randint(1, 12)))
            at = spans[-1][1] + random.randint(0, 3)
        worth = lambda sizes: min(spans[e - 1][1] - spans[e - n][0] for n, e in zip(sizes, itertools.accumulate(sizes), strict=True))
        options = []
        for cuts in itertools.product([0, 1], repeat=len(spans) - 1):
            sizes, n = [], 1
            for c in cuts:
                if c:
                    sizes.append(n)
                    n = 0
                n += 1
            sizes.append(n)
            if all(spans[e - 1][1] - spans[e - n][0] < 30 for n, e in zip(sizes, itertools.accumulate(sizes), strict=True)):
                options.append(sizes)
        assert worth(iv.partition_max_min(spans)) == max(map(worth, options))
    with pytest.raises(ValueError, match="30"):
        iv.partition_max_min([(0, 31)])


def test_pack_golden(spark):
    df = spark.createDataFrame([([(0, 10), (12, 25), (26, 41), (42, 60)],), ([],)], "s array<struct<start:long,end:long>>")
    got = [[(p["start"], p["end"]) for p in r[0]] for r in df.select(iv.pack_segments("s", 30)).collect()]
    assert got == [[(0, 25), (26, 41), (42, 60)], []]


def test_vad_golden():
    assert vad.segments_of([0] * 10 + [1] * 20 + [0] * 40 + [1] * 20 + [0] * 10) == [(1920, 18560), (32640, 51200)]
    assert vad.segments_of([float("nan")] * 50) == []
    # no pause within 12 s: cut at the least of the later half, the current frame included, the last of equals
    o = vad.VadOptions(window=16000, max_speech_s=12, pad_ms=0)
    assert vad.segments_of([1.0] * 14, o) == [(0, 192000), (192000, 224000)]
    assert vad.segments_of([1.0] * 8 + [0.5] + [1.0] * 5, o) == [(0, 128000), (128000, 224000)]
    # a pause of one frame, too short to end the segment, is where it is cut once it is too long
    o = vad.VadOptions(window=16000, max_speech_s=12, min_silence_ms=3000, pad_ms=0)
    assert vad.segments_of([1.0] * 5 + [0.0, 0.0] + [1.0] * 9, o) == [(0, 80000), (112000, 256000)]
    assert vad.segments_of([1.0] * 3, o, length=40000) == [(0, 40000)]
    o = vad.VadOptions(window=16000)
    for a, b in vad.segments_of([1.0] * 100, o):
        assert 0 <= a < b <= 1_600_000 and b - a <= 31 * 16000


def test_padded_spans():
    spans = lambda pairs, pad, total: vad.padded_spans(np.asarray(pairs, float).reshape(-1, 2), pad, total)
    assert spans([], 5, 100) == [] and spans([(3, 98)], 5, 100) == [(0, 100)]
    assert spans([(10, 20), (27, 40), (60, 70)], 5, 72) == [(5, 23), (24, 45), (55, 72)]  # a gap of 7 gives 3 to each side, one of 20 gives 5
    assert spans([(10, 20), (20, 40)], 5, 100) == [(5, 20), (20, 45)]


def slow_energies(x, frame, hop):
    padded = [0.0] * (frame // 2) + list(x) + [0.0] * frame
    return [math.sqrt(sum(v * v for v in padded[k * hop : k * hop + frame]) / frame) for k in range(1 + len(x) // hop)]


@pytest.mark.parametrize(("n", "frame", "hop"), [(0, 8, 4), (1, 8, 4), (64, 16, 4), (63, 16, 6), (100, 10, 4), (5000, 2048, 512), (17, 4, 8)])
def test_energies(n, frame, hop):
    random.seed(n)
    x = [random.uniform(-1, 1) for _ in range(n)]
    assert vad.energies(np.asarray(x), frame, hop) == pytest.approx(slow_energies(x, frame, hop))


def test_frame_energy(spark):
    rows = [(1, [0.0, 3.0, 4.0, 0.0]), (2, None), (3, []), (4, [1.0] * 8)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k int, x array<double>").coalesce(1).select("k", vad.frame_energy("x", 4, 2)).collect()}
    assert got[1] == pytest.approx([1.5, 2.5, 2.0]) and got[2] is None and got[3] == [0.0] and got[4] == pytest.approx([math.sqrt(0.5), 1, 1, 1, math.sqrt(0.5)])


def test_evaluation_conserves(spark):
    rows = [("u1", "d", "en", 0, "a b c d", "a x c", 0.0, 2.0), ("u1", "d", "en", 1, "<nl>la la</nl> (ooh) yes", "la ooh Yes", 0.0, 1.0), ("u2", "d", "en", 0, "", "x", 0.0, 1.0)]
    pairs = spark.createDataFrame(rows, "uid string, dataset string, language string, sample_idx int, ref string, hyp string, start double, end double")
    aligned = ev.aligned(pairs)
    samples = {(r["uid"], r["sample_idx"]): r for r in ev.samples(aligned).collect()}
    assert (samples["u1", 0]["hit"], samples["u1", 0]["sub"], samples["u1", 0]["del"], samples["u1", 0]["ins"], samples["u1", 0]["wer"]) == (2, 1, 1, 0, 0.5)
    assert samples["u2", 0]["wer"] is None and samples["u1", 1]["del_nl"] == 1
    chunks = ev.chunks(aligned).groupBy("typ").agg(F.sum("len").alias("n")).collect()
    edits = {r["typ"]: r["count"] for r in ev.edits(aligned).groupBy("typ").count().collect()}
    for r in chunks:
        assert r["n"] == edits[r["typ"]] == sum(s[r["typ"]] for s in samples.values())
    metrics = {r["uid"]: r for r in ev.word_metrics(aligned).collect()}
    assert metrics["u1"]["total_len"] == 8 and metrics["u1"]["deletions_nonlexical"] == 1 and metrics["u2"]["WER"] is None
    full = ev.all_metrics(pairs).where("uid = 'u1'").first()
    assert full["P_pare"] is None and full["R_pare"] == 0


def test_texts_are_compared_once(spark, tmp_path):
    pairs = spark.createDataFrame([("u", "d", "en", 0, "a (b)\nc's", "a x c"), ("v", "d", "en", 0, None, "")], "uid string, dataset string, language string, sample_idx int, ref string, hyp string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = ev.aligned(pairs).where(F.size("chunks") > 0)
    assert plan(ev.samples(rows)).count("ArrowEvalPython") == 1
    first = rows.first()
    assert [w["text"] for w in first["ref_words"]] == ["a", "b", "c", "'s"] and first["ref_words"][1]["tags"] == ["backing", "word"] and first["breaks"] == [1]
    stored, direct = ev.fact_tables(pairs, {"audio": "x"}, store=str(tmp_path / "run")), ev.fact_tables(pairs, {"audio": "x"})
    for name, df in stored.items():
        assert "Python" not in plan(df) and sorted(map(repr, df.collect())) == sorted(map(repr, direct[name].collect()))
    assert stored["samples"].count() == 2


def test_clean_text_composes_once(spark):
    rows = spark.createDataFrame([("ﬁne ½",), ("plain",), (None,), ("(all)",)], "text string").select(tx.clean_text(F.col("text")).alias("t")).where("t <> ''")
    assert sorted(r[0] for r in rows.collect()) == ["fine 1⁄2", "plain"]
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_runs_of_systems(spark):
    pairs = spark.createDataFrame([("u", "d", "en", 0, "a b", "a c")], "uid string, dataset string, language string, sample_idx int, ref string, hyp string")
    made = ev.fact_tables_of([({"audio": "N"}, pairs), ({"audio": "A"}, pairs.withColumn("hyp", F.col("ref")))])
    assert {r["audio"]: (r["hit"], r["sub"]) for r in made["samples"].collect()} == {"N": (1, 1), "A": (2, 0)}
    assert made["chunks"].count() == 3 and made["edits"].count() == 4
    for runs in ([], [({"audio": "N"}, pairs), ({"algo": "A"}, pairs)]):
        with pytest.raises(ValueError):
            ev.fact_tables_of(runs)


def test_render(spark):
    rows = [("u", 0, "en", "a b\nc d", "a x c")]
    aligned = ev.aligned(spark.createDataFrame(rows, "uid string, sample_idx int, language string, ref string, hyp string"))
    pieces = render.split_chunks(aligned, ["uid", "sample_idx"])
    got = [(r["line_no"], r["type"], r["ref_start"], r["ref_end"], r["hyp_start"], r["hyp_end"]) for r in pieces.orderBy("piece_idx").collect()]
    assert got == [(0, "equal", 0, 1, 0, 1), (0, "substitute", 1, 2, 1, 2), (1, "equal", 2, 3, 2, 3), (1, "delete", 3, 4, 3, 3)]
    times = render.hyp_timestamps(F.array(F.struct(F.lit(0.0).alias("start"), F.lit(3.0).alias("end"), F.lit(3).alias("n_words"))))
    shown = render.render_rows(render.split_chunks(aligned, ["uid", "sample_idx"], times=times), ["uid", "sample_idx"])
    assert [(r["ref_text"], r["hyp_text"], r["timestamp"]) for r in shown.orderBy("piece_idx").collect()] == [("a", "a", 0.1), ("b", "x", 1.0), ("c", "c", 2.0), ("d", "-", 2.0)]
    assert "<p>" in render.html_pages(shown).first()["html"]
    # a deletion in the middle has the time of the word that follows
    middle = ev.aligned(spark.createDataFrame([("u", 0, "en", "a b c", "a c")], "uid string, sample_idx int, language string, ref string, hyp string"))
    times = render.hyp_timestamps(F.array(F.struct(F.lit(0.0).alias("start"), F.lit(8.0).alias("end"), F.lit(4).alias("n_words"))))
    shown = render.render_rows(render.split_chunks(middle, ["uid"], times=times), ["uid"]).orderBy("piece_idx").collect()
    assert [(r["chunk_type"], r["timestamp"]) for r in shown] == [("equal", 0.1), ("delete", 2.0), ("equal", 2.0)]


def test_catalogue(spark, tmp_path):
    ids = spark.createDataFrame([({"a": ["1", "2"], "b": ["2"]},)], "reasons map<string,array<string>>")
    assert sorted(r[0] for r in cat.exclusion_ids(ids).collect()) == ["1", "2"]
    songs = spark.createDataFrame([("1", "english"), ("3", "dutch"), ("efbc7553da754f28ba888c089216a731", "english")], "song_id string, language string")
    assert sorted(r["language"] for r in cat.with_language_codes(songs).collect()) == ["de", "en"]
    with pytest.raises(Exception, match="duration not found"):
        cat.with_durations(songs, spark.createDataFrame([("1", 2.0)], "song_id string, duration_secs double")).collect()
    with pytest.raises(Exception, match="duplicate key"):
        cat.assert_unique(songs.union(songs), "song_id").collect()


def test_annotated_songs(spark):
    rows = [("s1", "english", [(1, "two", [3.0, 4.0]), (0, " one ", [0.0, 2.0]), (0, "...", [2.0, 2.5])]), ("s2", "dutch", []), ("s3", "german", [])]
    songs, lines, groups = io.annotated_songs(spark.createDataFrame(rows, io.ANNOTATIONS), spark.createDataFrame([("s1", 9.0)], "song_id string, duration_secs double"), "d", spark.createDataFrame([("s3",)], "song_id string"))
    assert [(r["uid"], r["text"], r["language"]) for r in songs.collect()] == [("s1_d", " one \n...\n\ntwo", "en")]
    assert sorted(r["text"] for r in lines.collect()) == ["one\n", "two\n"] and groups.count() == 1


def test_tagged_songs(spark):
    rows = [("A B", "en", "<nl>x</nl>", "p.mp3", 30.0, [(0.0, 2.0, "x", "<nl>x</nl>"), (1.0, 50.0, "y", "y")])]
    songs, merged, groups = io.tagged_songs(spark.createDataFrame(rows, io.TAGGED_SONGS), "d", underscore=True, newline=True)
    assert songs.first()["uid"] == "A_B_d" and merged.first()["text"] == "<nl>x</nl>\n" and groups.count() == 1


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    io.write_jsonl(df, f"{tmp_path}/x")
    assert sorted(map(tuple, io.read_jsonl(spark, f"{tmp_path}/x", "k long, t string").collect())) == [(1, "a"), (2, "b")]
    io.write_run({"samples": cat.attach_system(df, audio="mix", iter_idx=0)}, f"{tmp_path}/runs", ("audio", "iter_idx"))
    assert io.read_runs(spark, f"{tmp_path}/runs", "samples").where("audio = 'mix'").count() == 2
    io.write_document({"a": 1}, f"{tmp_path}/d.json")
    assert io.read_document(spark, f"{tmp_path}/d.json").first()["a"] == 1
    assert r"\begin{tabular}" in io.latex_table(df) and "<table>" in io.summary_page(df, df, "t")
    assert '<td><a href="pages/uid%3Da%20b/">a b</a></td><td>0.5000</td>' in io.summary_page(df, spark.createDataFrame([("a b", 0.5)], "uid string, wer double"), "t", pages="pages")
    flagged = spark.createDataFrame([("a_b", 0.5, True), ("c", 1.0, False), (None, None, None)], "name string, wer double, best boolean")
    assert io.latex_table(flagged, bold={"wer": "best"}).split("\n")[2:6:3] == [r"\textbf{name} & \textbf{wer} \\", r"c & 1.00 \\"]
    assert r"a\_b & \textbf{0.50} \\" in io.latex_table(flagged, bold={"wer": "best"}) and r"- & - \\" in io.latex_table(flagged)
    pieces = spark.createDataFrame([("u", 0, 0, "equal", "a", "a", 0.1), ("u", 0, 1, "delete", "b", "-", 0.1)], "uid string, line_no long, piece_idx int, chunk_type string, ref_text string, hyp_text string, timestamp double")
    io.write_side_files(spark.createDataFrame([("u", "a\nb"), ("v", None)], "uid string, text string"), pieces, f"{tmp_path}/side")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/side/lyrics/uid=u").collect()] == ["a", "b"]
    assert [r["ref_text"] for r in spark.read.json(f"{tmp_path}/side/alignments/uid=u").orderBy("piece_idx").collect()] == ["a", "b"]
    with pytest.raises(RuntimeError):
        io.Roots("NOT_SET_AT_ALL").data  # noqa: B018


def test_pools(spark, tmp_path):
    tasks = spark.createDataFrame([(k, k * 2) for k in range(5)], "uid long, x long")
    done = spark.createDataFrame([(0, "old"), (9, "old")], "uid long, y string")
    got = pools.cached_map(tasks, lambda f: f.assign(y="new")[["uid", "y"]], "uid long, y string", done)
    assert sorted(map(tuple, got.collect())) == [(0, "old"), *[(k, "new") for k in range(1, 5)]]
    calls = []
    make = lambda: calls.append(1) or tasks
    for _ in range(2):
        assert pools.materialised(spark, f"{tmp_path}/m", make).count() == 5
    assert len(calls) == 1
    tries = [(0.0, "a", 3.0, -0.1, 0.0), (0.2, "b", 1.0, -0.5, 0.1)]
    kind = "c array<struct<temperature:double,text:string,compression_ratio:double,avg_logprob:double,no_speech_prob:double>>"
    assert spark.createDataFrame([(tries,)], kind).select(pools.first_acceptable("c")).first()[0] == "b"


def test_unique_keys_by_partial_aggregation(spark, tmp_path):
    rows = spark.createDataFrame([(k, "text") for k in range(20)], "uid long, text string")
    df = cat.assert_unique(rows)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and df.count() == 20 and cat.assert_unique(rows.limit(0)).count() == 0
    with pytest.raises(Exception, match="duplicate key 7"):
        cat.assert_unique(rows.union(rows.where("uid = 7"))).write.parquet(f"{tmp_path}/out")
    with pytest.raises(Exception, match="duplicate key null"):
        cat.assert_unique(rows.selectExpr("nullif(uid > 3, true) as uid").where("uid is null")).collect()


def test_lost_run_resumes(spark, tmp_path):
    """A run that fails after most of its tasks have finished keeps their results; the next one makes the rest only."""
    store, flag = f"{tmp_path}/store", f"{tmp_path}/mended"
    tasks_ = spark.createDataFrame([(k, k * 2) for k in range(64)], "uid long, x long")

    def model(run):
        def work(f):
            if 7 in set(f["uid"]) and not os.path.exists(flag):
                time.sleep(8)
                raise RuntimeError("lost")
            return pd.DataFrame([(u, p, run) for u, x in zip(f["uid"], f["x"], strict=True) for p in range(u % 3)], columns=["uid", "pos", "run"])

        return work

    schema = "uid long, pos long, run long"
    with pytest.raises(Exception, match="lost"):
        pools.resumable_map(tasks_, model(1), schema, store, partitions=8)
    kept = {r["uid"] for r in spark.read.parquet(store).collect()}
    assert 30 < len(kept) < 64 and 7 not in kept
    open(flag, "w").close()
    got = pools.resumable_map(tasks_, model(2), schema, store, partitions=8).collect()
    assert sorted((r["uid"], r["pos"]) for r in got) == [(u, p) for u in range(64) for p in range(u % 3)]
    assert all((r["run"] == 1) == (r["uid"] in kept) for r in got)
    assert spark.read.parquet(store).count() == 64 and pools.resumable_map(tasks_.where("uid < 5"), model(3), schema, store).count() == 4
    with pytest.raises(Exception, match="no key"):
        pools.resumable_map(tasks_.union(spark.createDataFrame([(None, 1)], "uid long, x long")), model(4), schema, store)


def test_folder_scan(spark, tmp_path):
    (tmp_path / "annot").mkdir()
    (tmp_path / "audio").mkdir()
    for k in ("a.b", "c", "d"):
        with gzip.open(tmp_path / "annot" / f"{k}.gz", "wt") as f:
            json.dump({"id": k, "language": "english", "lines": [{"index": 0, "text": f"line of {k}", "time": [0.5, 1.5]}]}, f)
    for k in ("a.b", "c"):
        (tmp_path / "audio" / f"{k}.mp3").write_bytes(b"x")
    (tmp_path / "annot" / "other.txt").write_text("no annotation")
    seen = Observation("scan")
    rows = io.scan_annotations(spark, f"{tmp_path}/annot", f"{tmp_path}/audio", spark.createDataFrame([("c",)], "song_id string"), file_id=r"([^/]+)\.[a-z0-9]+$", observation=seen)
    rows.write.parquet(f"{tmp_path}/out")
    got = {r["song_id"]: (r["status"], r["lines"] and r["lines"][0]["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"a.b": ("found", "line of a.b"), "c": ("excluded", None), "d": ("missing_audio", None)}
    assert seen.get == {"excluded": 1, "missing_audio": 1, "found": 1}
    names = io.listed_files(spark, f"{tmp_path}/audio", "*.mp3").select("song_id")
    assert "content" not in names._jdf.queryExecution().executedPlan().toString()
    io.write_summary(spark.createDataFrame([("b",), ("a",)], "uid string"), f"{tmp_path}/extract")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/extract/summary").collect()] == ["a", "b"]


def test_box_and_rates(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)], "k string, wer double")
    r = an.boxplot_statistics(df, ["k"]).first()
    assert (r["q1"], r["q2"], r["q3"], r["whisker_low"], r["whisker_high"]) == (2, 3, 4, 1, 4)
    empty = spark.createDataFrame([("ins", 3, "d", 0, 0)], "typ string, len long, dataset string, nl long, bv long")
    assert an.error_table(empty, ["dataset"]).first()["wer"] is None


@pytest.mark.parametrize("few", [True, False])
def test_exact_quantiles(spark, monkeypatch, few):
    """Rank selection by histograms gives what sorting gives, with ties, groups of one value, negative and huge values."""
    monkeypatch.setattr(an, "BINS", 4)
    if not few:
        monkeypatch.setattr(an, "BROADCAST_ROWS", 0)
    random.seed(61)
    rows = [("many", random.gauss(0, 1)) for _ in range(700)] + [("ties", float(random.randint(0, 3))) for _ in range(300)] + [("one", 5.0), ("two", -1.0), ("two", 1e300)]
    rows += [("spread", random.choice([-1, 1]) * 10.0 ** random.randint(-30, 30)) for _ in range(101)] + [("none", None), ("ties", None), (None, 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, wer double")
    got = {r["k"]: (r["n"], r["q"]) for r in an.exact_quantiles(df.where("k is not null"), ["k"], "wer", (0, 0.25, 0.5, 0.75, 1)).collect()}
    for k in ("many", "ties", "one", "two", "spread"):
        values = [v for g, v in rows if g == k and v is not None]
        assert got[k][0] == len(values) and got[k][1] == pytest.approx(list(np.quantile(values, (0, 0.25, 0.5, 0.75, 1))), rel=1e-12)
    assert set(got) == {"many", "ties", "one", "two", "spread"} and an.exact_quantiles(df.limit(0), ["k"], "wer", (0.5,)).count() == 0
    both = [{r["k"]: tuple(r)[1:] for r in an.boxplot_statistics(df.where("k is not null"), ["k"], exact_rows=n).collect()} for n in (10**6, 0)]
    assert set(both[0]) == set(both[1]) and all(a == pytest.approx(b) for k in both[0] if k != "none" for a, b in zip(both[0][k], both[1][k], strict=True))


def test_boxplot_values_are_not_sorted_by_group(spark, monkeypatch):
    random.seed(63)
    rows = [(k, random.gauss(0, 1)) for k, n in (("large", 400), ("small", 20), ("one", 1)) for _ in range(n)] + [("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, wer double")
    told = lambda d: {r["k"]: tuple(r)[1:] for r in d.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = an.boxplot_statistics(df, ["k"])
        assert made._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1  # of the groups with their whiskers
        few = told(made)
        monkeypatch.setattr(an, "BROADCAST_ROWS", 0)
        many = told(an.boxplot_statistics(df.where("k is not null"), ["k"], exact_rows=100))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for k in ("large", "small", "one"):
        values = sorted(v for g, v in rows if g == k)
        a, b = np.quantile(values, (0.25, 0.75))
        inside = [v for v in values if a - 1.5 * (b - a) <= v <= b + 1.5 * (b - a)]
        assert few[k][-2:] == (inside[0], inside[-1]) and few[k][3:] == pytest.approx(many[k][3:]) and few[k][:3] == pytest.approx(many[k][:3])


def test_length_batches(spark):
    random.seed(62)
    rows = [(k, random.randint(0, 30)) for k in range(203)]
    got = {r["uid"]: (r["batch"], r["width"]) for r in pools.length_batches(spark.createDataFrame(rows, "uid long, x int"), F.col("x"), 16).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {u: (i // 16, max(x for _, x in ordered[i // 16 * 16 : i // 16 * 16 + 16])) for i, (u, _) in enumerate(ordered)}
    assert pools.length_batches(spark.createDataFrame([], "uid long, x int"), F.col("x"), 16).count() == 0


def test_side_files_are_written_by_many_tasks(spark, tmp_path):
    songs = spark.range(40).select(F.col("id").alias("uid"), F.lit("la").alias("text"))
    rows = songs.select("uid", F.lit(0).alias("line_no"), F.lit(0).alias("piece_idx"))
    io.write_side_files(songs, rows, str(tmp_path))
    for folder in ("lyrics", "alignments"):
        files = [f.name for f in (tmp_path / folder).glob("uid=*/part-*")]
        assert len(files) == 40 and len({f[:10] for f in files}) > 4


def test_pictures(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 0.5, 0.25, 0.75]), (2, [0.5]), (3, [])], "uid long, s array<double>")
    got = {r["uid"]: [tuple(p) for p in r["p"]] for r in rows.select("uid", render.pixel_ranges("s", 3).alias("p")).collect()}
    assert got == {1: [(0, 0.0, 1.0), (1, 0.25, 0.5), (2, 0.75, 0.75)], 2: [(0, 0.5, 0.5)], 3: []}
    made = rows.where("uid = 1").withColumn("g", F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))).select("uid", render.activity_svg("s", "g", F.lit(5), 10, 4).alias("svg"))
    io.write_pictures(made, f"{tmp_path}/svg")
    text = spark.read.text(f"{tmp_path}/svg/uid=1").first()[0]
    assert text.startswith("<svg") and '<rect class="active" x="2.0" width="4.0" height="4"/>' in text and "M0,4.0V4.0M2,0.0V0.0" in text


def test_streaming(spark, tmp_path):
    from versemill.streaming import live

    df = spark.createDataFrame([("hit", 8, "d"), ("sub", 2, "d")], "typ string, len long, dataset string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = live.running_wer(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    try:
        q.processAllAvailable()
        assert spark.table("running").first()["wer"] == 0.2
    finally:
        q.stop()


def test_activity_of_a_growing_series():
    """What a series decides frame by frame is what it decides as a whole."""
    from versemill.streaming.activity import _Recording

    random.seed(51)
    for k in range(400):
        o = vad.VadOptions(window=16000, onset=0.5, offset=random.choice([0.5, 0.3]), max_speech_s=random.choice([6, 12]), min_silence_ms=random.choice([1000, 3000]), min_speech_ms=random.choice([0, 2000]), pad_ms=random.choice([0, 200, 900]))
        scores, level = [], 0.9
        while len(scores) < 60:
            level = random.choice([0.9, 0.1, 0.4])
            scores += [min(1.0, max(0.0, level + random.uniform(-0.1, 0.1))) for _ in range(random.randint(1, 9))]
        recording, got = _Recording(o, None), []
        frames = list(enumerate(scores))
        while frames:
            n = random.randint(1, 8)
            part, frames = frames[:n], frames[n:]
            recording.add(iter(random.sample(part, len(part)) + part[:1]))
            got += recording.decided(last=False)
            recording = _Recording(o, recording.state())
            assert len(recording.scores) <= 40
        got += recording.decided(last=True)
        assert got == vad.segments_of(scores, o), k


def test_live_activity_equals_batch(spark, tmp_path):
    from versemill.streaming.activity import live_activity

    random.seed(52)
    o = vad.VadOptions(window=16000, onset=0.5, offset=0.5, max_speech_s=8, min_silence_ms=2000, pad_ms=200)
    series = {u: [random.choice([0.9, 0.1]) for _ in range(40) for _ in range(random.randint(1, 3))][:60] for u in ("a", "b", "c")}
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    for part in range(4):
        rows = [(u, k, x, at(k)) for u, scores in series.items() for k, x in enumerate(scores) if k // 16 == part]
        spark.createDataFrame([*rows, *rows[:2]], "uid string, frame long, score double, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in order of their times
    for k in range(2):
        spark.createDataFrame([("end", k, 0.0, at(10_000 + k))], "uid string, frame long, score double, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("uid string, frame long, score double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live_activity(stream, o, idle="30 seconds").writeStream.outputMode("append").format("memory").queryName("activity").start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("activity").collect()))
    finally:
        q.stop()
        spark.conf.unset(provider)
    assert got == sorted((u, a, b) for u, scores in series.items() for a, b in vad.segments_of(scores, o))


def test_tasks_and_results(spark):
    songs = spark.createDataFrame([("u1", "d", "en", "a.wav", "stems/u1", "one\ntwo", 9.0), ("u2", "d", "de", "b.wav", None, "drei", 3.0)], "uid string, dataset_id string, language string, audio_path string, stem_dir string, text string, duration_secs double")
    lines = spark.createDataFrame([("u1", 0, "one", 0.5, 1.0), ("u1", 1, "two", 2.0, 3.25), ("u1", 2, "lost", 4.0, 5.0)], "uid string, pos int, text string, start double, end double")
    clips = tasks.line_clips(lines)
    made = {r["uid"]: r for r in tasks.transcription_tasks(songs, "merged_line", clips, audio="htdemucs", with_language=False).collect()}
    assert made["u1"]["audio_path"] == "sep/htdemucs/d/u1.mp3" and made["u1"]["language"] is None and made["u1"]["clip_timestamps"] is None
    assert [tuple(c) for c in made["u1"]["clips"]] == [(8000, 16000), (32000, 52000), (64000, 80000)] and made["u2"]["clips"] == []
    native = {r["uid"]: r for r in tasks.transcription_tasks(songs, "song", batched=False).collect()}
    assert native["u2"]["clip_timestamps"] == ["0"] and native["u2"]["audio_path"] == "b.wav" and native["u2"]["language"] == "de"
    flat = tasks.transcription_tasks(songs, "song", clips.where("uid = 'u1'"), batched=False).where("uid = 'u1'").first()
    assert flat["clip_timestamps"][:4] == ["0.5", "1.0", "2.0", "3.25"]
    with pytest.raises(ValueError):
        tasks.transcription_tasks(songs, "verse")
    outputs = spark.createDataFrame([("u1", 1, "to"), ("u1", 0, "one")], "uid string, pos int, text string")
    known = tasks.transcription_tasks(songs, "song")
    whole = tasks.results(songs, known, outputs, "song").collect()
    assert [(r["uid"], r["ref"], r["hyp"], r["end"], r["audio_path"]) for r in whole] == [("u1", "one\ntwo", "one\nto", 9.0, "a.wav")]
    by_line = tasks.results(songs, known, outputs, "merged_line", lines)
    assert sorted((r["sample_idx"], r["ref"], r["hyp"]) for r in by_line.collect()) == [(0, "one", "one"), (1, "two", "to")]
    counted = {r["sample_idx"]: (r["hit"], r["sub"]) for r in tasks.with_evaluation(by_line).collect()}
    assert counted == {0: (1, 0), 1: (0, 1)}
    with pytest.raises(Exception, match="no task for"):
        tasks.results(songs, known.where("uid = 'u2'"), outputs, "song").collect()
    assert tasks.results(songs, known, outputs.limit(0), "song").count() == 0
