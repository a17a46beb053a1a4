"""Spelling variants, token counts and source divergence, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from versemill.llm import source_divergence, spelling_variants, token_counts
from versemill.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    rows = [(d, t, g, s, "x", 1, 2.0) for d, t, g, s in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, n int, size double").repartition(3)


def ascii_lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


# spelling variants


def variants_by_brute_force(rows):
    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]

    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def told(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def edited(word):
    k, c = random.randrange(len(word)), random.choice("abéß÷z")
    return random.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]])


def test_spelling_variants(spark, monkeypatch):
    random.seed(31)
    monkeypatch.setattr(spelling_variants, "HELD", 50)
    monkeypatch.setattr(spelling_variants, "PIECE", 40)
    words = ["".join(random.choices("abcdé", k=random.randint(5, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "ababab", "bababa", "Zürich×÷"]
    some = words + [edited(w) for w in words for _ in range(6)]
    some += [edited(w) for w in some]
    weights = [random.choice([1, 3, 20, 150]) for _ in some]
    rows = [(d, random.choice([" ", "-", "1", "\n"]).join(w.upper() if random.random() < 0.1 else w for w in random.choices(some, weights, k=random.randint(0, 300))), "en", "s") for d in range(120)]
    rows += [(None, " ".join(some), None, None), (5, None, "en", "s"), (5, "", "en", "s"), rows[0], rows[0], (9, "abcdefgh" * 4000 + " ababab", "en", "s")]
    want = variants_by_brute_force(rows)
    assert told(spelling_variants.group_spellings(frame(spark, rows))) == want
    assert sum(w[4] > 0 for w in want) > 50 and sum(w[1] is not None for w in want) > 20


def test_spelling_variants_ties_and_chains(spark):
    texts = {"bcdefgh": 5, "acdefgh": 25, "bcdefg": 25, "bcdefgq": 125, "bcdefxq": 700, "aardvark": 30, "ardvark": 6, "aardvarks": 30}
    rows = [(k, " ".join([w] * n), "en", "s") for k, (w, n) in enumerate(texts.items())]
    got = told(spelling_variants.group_spellings(frame(spark, rows)))
    assert got == variants_by_brute_force(rows)
    row = {r[0]: r for r in got}
    assert row["bcdefgh"][1:3] == ("bcdefgq", "bcdefxq") and row["ardvark"][1] == "aardvark"


def test_spelling_variants_empty(spark):
    for rows in ([], [(1, None, None, None)], [(1, "short text", "en", "s")]):
        assert spelling_variants.group_spellings(frame(spark, rows)).count() == 0


def test_spelling_variants_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(f"aabbcc{x}{y}", 5 + x) for x in range(5) for y in "abc"], "word string, n long").write.parquet(str(tmp_path / "words"))
    pairs = spelling_variants.near_pairs(spark.read.parquet(str(tmp_path / "words")))
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


# token counts

PARTS = ["a", "aa", " ", "  ", "\n", "é", "中", "文", "①", "😀", "the ", "ing", "<s>", "</s>", "\x00", "▁", "b", "ab", "--", "=", "0", " "]


@pytest.mark.parametrize(("chunk", "overlap"), [(8, 1), (20, 4), (64, 16)])
def test_chunked_counts(chunk, overlap):
    random.seed(chunk)
    whole, counter = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.ChunkedCounter(MODEL, chunk, overlap)
    for _ in range(400):
        parts = random.sample(PARTS, random.choice([1, 2, 3, len(PARTS)]))
        text = "".join(random.choices(parts, k=random.randint(0, 150)))
        assert counter.count_long(text) == len(whole.encode(text)), text
    assert counter.widened or overlap > 4


def test_token_counts_of_huge_texts():
    whole, counter = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.ChunkedCounter(MODEL)
    for text in ("a" * 1_000_000, " " * 500_000 + "x", "\n" * 300_000, "中文" * 200_000, "the quick brown fox " * 60_000, "=-" * 200_000, "①😀" * 50_000):
        assert counter.counts([text]) == [len(whole.encode(text))]


def test_token_counts(spark):
    random.seed(33)
    rows = [(d, " ".join(random.choices(["alpha", "béta", "漢字", "1234", "<s>"], k=random.randint(0, 400))), "en", "s") for d in range(60)]
    rows += [(None, "alpha", None, None), (1, None, None, None), (1, "", None, None), rows[3], rows[3], (7, "word " * 5000, None, None)]
    whole = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted(((d, len((t or "").encode()), len(whole.encode(t or "")), len(whole.encode(t or "")) > 4096) for d, t, *_ in rows), key=repr)
    for chunk in (token_counts.CHUNK, 100):
        df = token_counts.count_tokens(frame(spark, rows), MODEL, chunk=chunk, overlap=10)
        assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and sorted(map(tuple, df.collect()), key=repr) == want
    assert any(w[3] for w in want) and token_counts.count_tokens(frame(spark, []), MODEL).count() == 0


def test_token_counts_need_a_model_without_normalising(tmp_path):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    with open(MODEL, "rb") as f:
        model = ModelProto.FromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="normalisation"):
        token_counts.ChunkedCounter(str(tmp_path / "m.model"))


# source divergence


def audit_by_brute_force(rows, least=10, top=10):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, g, s in rows:
        g, s = g or "", s or ""
        groups[g].add(s)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t))
        counts[g, s].update(terms)
        in_docs[g].update(set(terms))
    out = []
    for g, sources in groups.items():
        kept = [w for w, k in in_docs[g].items() if k >= least]
        v = len(kept)
        share = {}
        for s in [*sources, None]:
            n = {w: sum(counts[g, x][w] for x in sources) if s is None else counts[g, s][w] for w in kept}
            total = sum(n.values()) + 2 * v
            share[s] = {w: 1 + 10**9 * (k + 2) // total for w, k in n.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(o, sum(f(share[s][w], share[o][w]) for w in kept)) for o in sources - {s}]
            terms = [(w, f(share[s][w], share[None][w])) for w in kept if counts[g, s][w] and share[s][w] > share[None][w]]
            for part, some in (("pair", pairs), ("term", terms)):
                some.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(g, s, part, w, x, k + 1) for k, (w, x) in enumerate(some) if part == "pair" or k < top]
    return sorted(out)


def audited(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("partitions", ["2", "7"])
def test_source_divergence(spark, monkeypatch, partitions):
    random.seed(35)
    monkeypatch.setattr(source_divergence, "HELD", 200)
    monkeypatch.setattr(source_divergence, "HELD_PAIRS", 3)
    monkeypatch.setattr(source_divergence, "PIECE", 50)
    words = ["".join(random.choices("abcdeé漢", k=random.randint(1, 3))) for _ in range(60)]
    rows = []
    for d in range(400):
        g, s = random.choice(["en", "de", None, "x"]), random.choice(["hot"] * 5 + ["a", "b", "c", None])
        some = words if g != "de" else words[:25]
        rows.append((d, random.choice([" ", ".", "-7"]).join(random.choices(some, range(1, len(some) + 1), k=random.randint(0, 40))), g, s))
    rows += [(None, "a a b", "en", "a"), (None, None, "en", "bare"), (3, "", "alone", "one"), (4, "AAA aaa", "few", "one"), (5, "bbb", "few", "two"), rows[0], rows[0]]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = audited(source_divergence.audit_sources(frame(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == audit_by_brute_force(rows)
    assert ("few", "one", "pair", "two", 0, 1) in got and not any(r[0] == "alone" for r in got)


def test_source_divergence_ties(spark):
    """Terms of equal value at the last rank are taken in the order of their bytes."""
    words = [a + b for a in "zyéxw漢" for b in "abcde"]
    rows = [(d, " ".join(words), "en", "a") for d in range(10)] + [(d, "other words " + " ".join(words[::-1] if d % 2 else []), "en", "b") for d in range(10, 20)]
    got = audited(source_divergence.audit_sources(frame(spark, rows)))
    assert got == audit_by_brute_force(rows) and len([r for r in got if r[:3] == ("en", "a", "term")]) == 10
    assert source_divergence.audit_sources(frame(spark, [])).count() == 0


def test_shares_of_huge_counts():
    n, m = np.asarray([0, 5, 10**15], np.int64), np.asarray([7, 100, 10**15 + 8], np.int64)
    assert source_divergence._shares(n, m).tolist() == [1 + 10**9 * (int(a) + 2) // int(b) for a, b in zip(n, m, strict=True)]
