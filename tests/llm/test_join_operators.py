"""Operators across texts, against brute force: line dedup, decontamination, substring dedup, Jaccard join, components."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from versemill.llm import _common, components, decontaminate, jaccard_join, line_dedup, substring_dedup

WORDS = ["alpha", "Beta", "gàmma", "delta", "eps", "zeta", "eta", "theta", "IOTA", "x1"]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, b"x", "b", 3) for d, t in rows], "doc_id long, text string, n int, blob binary, bucket string, token int")


def passage(n):
    return " ".join(random.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def corpus():
    random.seed(12)
    shared = [passage(40) for _ in range(4)]
    rows = []
    for d in range(60):
        parts = [passage(random.randint(0, 60))]
        if d % 3 == 0:
            parts.insert(random.randint(0, 1), random.choice(shared))
        rows.append((d, random.choice([" ", "\n", "\t "]).join(parts)))
    base = [passage(120) for _ in range(3)]
    for d in range(60, 110):  # near copies, many of one text
        words = base[0 if d < 95 else d % 3].split()
        for _ in range(random.randint(0, 3)):
            words[random.randrange(len(words))] = random.choice(WORDS)
        rows.append((d, " ".join(words)))
    rows += [(d, base[0]) for d in range(110, 135)]
    return rows + [(200, None), (201, ""), (202, " \n "), (203, "one two"), (204, "One TWO"), (None, shared[0]), (None, None), (0, rows[0][1]), (205, passage(6000) + " " + shared[1])]


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def test_jaccard(spark, corpus, monkeypatch):
    monkeypatch.setattr(_common, "PACK_BYTES", 2000)  # many packs, and rounds with one head at this size too
    monkeypatch.setattr(jaccard_join, "HEADS", (1,))
    sets = []
    for d, t in corpus:
        w = SPACE.findall(lower(t))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (d, s), x in zip(sets, label, strict=True):
        if s and d is not None:
            least[x] = min(d, least.get(x, d))
    want = sorted((-1 if d is None else d, len(s), least.get(x) if s else d) for (d, s), x in zip(sets, label, strict=True))
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in jaccard_join.near_duplicate_components(frame(spark, corpus)).select("doc_id", "n_shingles", "component_id").collect())
    assert [(w[0], w[1], w[2] if w[0] >= 0 or w[1] else None) for w in want] == got
    kept = jaccard_join.one_of_each_group(frame(spark, corpus))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns[0] == "doc_id" and {d for d in ids if d is not None} == {w[2] for w in want if w[0] >= 0}
    assert jaccard_join.near_duplicate_components(frame(spark, [])).count() == 0


def test_one_of_each_group_by_row(spark):
    """Exactly one row of each component stays, with null ids, repeated rows and ids shared by different texts too."""
    random.seed(16)
    a, b, c, d, e = (passage(40) for _ in range(5))
    rows = [(None, a)] * 3 + [(4, a), (None, b), (None, b), (1, c), (1, c), (1, d), (0, d), (7, e), (7, e + " " + e[:5]), (9, ""), (9, ""), (None, None)]
    got = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each_group(frame(spark, rows)).collect()]
    assert len(got) == 8 and sorted((x, y) for x, y in got if x is not None and x not in (7, 9)) == sorted([(4, a), (1, c), (0, d)])
    assert [x for x in got if x[0] is None and x[1]] == [(None, b)] and sum(x[0] == 7 for x in got) == 1 and got.count((9, "")) == 2 and (None, None) in got
    assert jaccard_join.one_of_each_group(frame(spark, [])).count() == 0


def test_substrings(spark, corpus):
    first = {}
    docs = [(float("inf") if d is None else d, (t or "").encode().split()) for d, t in corpus]
    for d, w in docs:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(d, first.get(k, d))
    want = []
    for d, w in docs:
        gone = {k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        want.append((-1 if d == float("inf") else d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3]) for r in substring_dedup.dedup_substrings(frame(spark, corpus)).collect())
    assert got == sorted(want) and sum(w[2] for w in want) > 1000
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, corpus, monkeypatch):
    random.seed(13)
    texts = [t for _, t in corpus if t and len(t.split()) > 40]
    items = [(k, " ".join(random.choice(texts).split()[3 : random.randint(10, 30)])) for k in range(12)] + [(50, "one two"), (51, None), (52, "..."), (None, "gàmma"), (3, "Beta, IOTA"), (53, passage(30))]
    want = []
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall(lower(t))
        for k in range(max(1, len(w) - 12)):
            if w:
                windows[tuple(w[k : k + 13])].add("" if i is None else str(i))
    for d, t in corpus:
        w = ITEM_WORD.findall(lower(t))
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    ids |= found
                    hit |= set(range(k, k + n))
        want.append((-1 if d is None else d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, words int")
    for rows, blocks in ((decontaminate.BLOCK_ROWS, 4), (40, 100), (5, 1)):  # one broadcast, several blocks, a shuffle
        monkeypatch.setattr(decontaminate, "BLOCK_ROWS", rows)
        monkeypatch.setattr(decontaminate, "BLOCKS", blocks)
        got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in decontaminate.decontaminate(frame(spark, corpus), bench).collect())
        assert got == sorted(want)
    assert decontaminate.decontaminate(frame(spark, corpus), bench.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.remove_contaminated(frame(spark, corpus), bench)
    # a clean text stays even if another row of its doc_id goes
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines(spark):
    random.seed(14)
    base = [passage(random.randint(4, 9)) for _ in range(25)]

    def mutated(s):
        s = list(s)
        for _ in range(random.randint(0, 4)):
            k = random.randrange(len(s))
            s[k : k + random.randint(0, 1)] = random.choice(["", "x", "é", " "])
        return "".join(s)

    rows = [(d, "\n".join(mutated(random.choice(base)) for _ in range(random.randint(0, 4)))) for d in range(90)]
    rows += [(200, None), (201, ""), (None, base[0]), (7, "short"), (8, rows[8][1]), (9, base[1] + "\n" + base[1])]
    df = frame(spark, rows)
    from pyspark.sql import functions as F

    key = {(r[0], r[1]): r[2] for r in df.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    placed = [((d is None, d or 0, key[d, t or ""], n), line, (d, t or "")) for d, t in rows for n, line in enumerate((t or "").split("\n")) if len(line) >= line_dedup.MIN_CHARS]
    gone = defaultdict(set)
    for p, line, k in placed:
        if any(q < p and abs(len(m) - len(line)) <= 2 and edits(line, m) <= 2 for q, m, _ in placed):
            gone[k].add(p[3])
    texts = {(d, t or "") for d, t in rows}
    want = sorted((-1 if d is None else d, len(t.split("\n")), len(gone[d, t]), ",".join(map(str, sorted(gone[d, t])))) for d, t in texts)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in line_dedup.dedup_report(df).collect()) == want
    kept = {(r["doc_id"], r["text"]) for r in line_dedup.remove_lines(df).collect()}
    left = set()
    for d, t in rows:
        lines = (t or "").split("\n")
        if len(gone[d, t or ""]) < len(lines):
            left.add((d, t if not gone[d, t or ""] else "\n".join(x for n, x in enumerate(lines) if n not in gone[d, t or ""])))
    assert kept == left and line_dedup.dedup_report(frame(spark, [])).count() == 0


def test_within(spark):
    """The bit-parallel automaton against the table of edit distances, with characters of one to four bytes."""
    from pyspark.sql import functions as F

    random.seed(17)
    pairs = [("", ""), ("", "ab"), ("abc", "")]
    for _ in range(1500):
        x = "".join(random.choices("abя漢😀 ", k=random.randint(0, 12)))
        y = list(x)
        for _ in range(random.randint(0, 4)):
            k = random.randint(0, len(y))
            y[k : k + random.randint(0, 1)] = random.choices("abя漢😀 ", k=random.randint(0, 1))
        pairs.append((x, "".join(y)))
    df = spark.createDataFrame(pairs, "x string, y string")
    for most in (0, 1, 2):
        got = df.select("x", "y", line_dedup.within(F.col("x"), F.col("y"), F.lit(most)).alias("near")).collect()
        assert all(bool(r["near"]) == (edits(r["x"], r["y"]) <= most) for r in got)


def test_lines_of_any_script_and_templates(spark, monkeypatch):
    """Lines without Latin letters, and a template that very many lines share, whose keys are salted."""
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 50)
    monkeypatch.setattr(line_dedup, "KEY_SAMPLE", 1)
    random.seed(18)
    base = ["съешь же ещё этих мягких французских булок", "色は匂へど散りぬるを我が世誰ぞ常ならむ有為の奥山", "نص عربي طويل بما يكفي للاختبار", "0123456789 9876543210"]
    lines = []
    for _ in range(60):
        s = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            s[random.randrange(len(s))] = random.choice("жщ漢字ابت07")
        lines.append("".join(s))
    lines += [f"The order {k * k * 7919:09d} of {k * 104729 % 99991:05d} was sent to you." for k in range(220)]
    rows = [(d, line) for d, line in enumerate(lines)]
    want = {d for d, line in rows if any(line == x or edits(line, x) <= max(0, min(2, min(len(line), len(x)) // 4 - 1)) for _, x in rows[:d] if abs(len(x) - len(line)) <= 2)}
    got = {r["doc_id"] for r in line_dedup.dedup_report(frame(spark, rows)).where("n_removed > 0").collect()}
    assert got == want and len(want) > 20


def test_clashing_columns(spark):
    """Operators that hand on whole rows do so under any column names."""
    taken = "gone_id long, gone_key string, gone_lines int, kept_id long, kept_key int, kept_many int, kept_row int, bad int, `row` int, n_chars int"
    rows = [(d, t, *range(10)) for d, t in [(1, passage(30)), (2, "one\ntwo"), (3, "one\nthree"), (None, None), (2, "one\ntwo")]]
    rows = [(d, t, *map(lambda v: str(v) if v == 1 else v, more)) for d, t, *more in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + taken)
    bench = spark.createDataFrame([(1, "two")], "item_id long, text string")
    for got, n in ((line_dedup.remove_lines(df), 5), (jaccard_join.one_of_each_group(df), 4), (decontaminate.remove_contaminated(df, bench), 3)):
        assert got.columns == df.columns and got.count() == n and [f.dataType for f in got.schema] == [f.dataType for f in df.schema]


def test_short_lines(spark):
    """Exact repeats go at any length; edits are fewer in short lines; empty lines stay."""
    first = ["Les.", "x", "abcdefgh", "abcdefghijk", "abcdefghijkl", "", "The same line of some length.", "abc"]
    later = ["Les.", "x", "abcdefgX", "abcXefgXijk", "abXdefghiXkl", "", "The same line of some length.", "abd", "Les.", "abcdefghi", "Xbcdefghij", "abXXXXghijkl"]
    df = frame(spark, [(1, "\n".join(first)), (2, "\n".join(later)), (3, "Les.\nNew.")])
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.dedup_report(df).collect()}

    def limit(a, b):
        return max(0, min(2, min(len(a), len(b)) // 4 - 1))

    seen, want = [], {}
    for d, lines in ((1, first), (2, later), (3, ["Les.", "New."])):
        gone = []
        for n, line in enumerate(lines):
            if line and any(line == x or edits(line, x) <= limit(line, x) for x in seen):
                gone.append(n)
            seen.append(line)
        want[d] = ",".join(map(str, gone))
    assert got == want and want[2].startswith("0,1,2,4,6,8,9") and want[3] == "0"
    assert {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(df).collect()}[3] == "New."


def test_components(spark):
    random.seed(15)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(200, 230)] + [(5, 5), (None, 3)]
    label = {n: n for e in edges if None not in e for n in e}
    for _ in label:
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == c for n, c in label.items())


def test_long_words_that_are_complements(spark):
    """Words whose polynomials are equal modulo a power of two are different words."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    words = _common.Words([f"{a} {b} {a[:1024]} {b[:1024]} {a}".encode()])
    assert len(set(words.hash.tolist())) == 4
    say = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{a} {say}"), (2, f"{b} {say}"), (3, f"{a} {say}"), (4, " ".join([a, "b", a, "c", a])), (5, " ".join([b, "b", b, "c", b]))]
    got = {r[0]: r[2] for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0}
    linked = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicate_components(frame(spark, rows)).collect()}
    assert linked[5] == 5 and linked[3] == 1


def test_decontamination_in_blocks(spark, monkeypatch):
    """Several blocks of windows read the same numbered rows, behind a shuffle too."""
    random.seed(19)
    items = [(k, passage(20)) for k in range(9)]
    rows = [(d, passage(30) + " " + items[d % 9][1] + " " + passage(5)) for d in range(40)]
    whole = sorted(map(tuple, decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 40)
    assert 1 < len(decontaminate._in_blocks(decontaminate.windows_of(spark.createDataFrame(items, "item_id long, text string")).select("words"), "words")) <= decontaminate.BLOCKS
    shuffled = frame(spark, rows).repartition(5)
    assert sorted(map(tuple, decontaminate.decontaminate(shuffled, spark.createDataFrame(items, "item_id long, text string")).collect())) == whole and all(r[2] for r in whole)


def test_greatest_and_least_ids_stay(spark):
    """An id that stands for null inside is an id like others when a document has it."""
    from versemill.llm import fingerprints

    most, least = 2**63 - 1, -(2**63)
    text = passage(30)
    rows = [(most, text), (None, text), (1, passage(30)), (least, passage(20)), (None, None)]
    ids = lambda df, c="doc_id": sorted((r[c] for r in df.collect()), key=repr)
    want = sorted((d for d, _ in rows), key=repr)
    assert ids(substring_dedup.dedup_substrings(frame(spark, rows))) == want and ids(fingerprints.fingerprint_documents(frame(spark, rows))) == want
    linked = jaccard_join.near_duplicate_components(frame(spark, rows))
    assert ids(linked) == want and ids(linked, "component_id") == sorted([most, most, 1, least, None], key=repr)
    kept = jaccard_join.one_of_each_group(frame(spark, rows))
    assert ids(kept) == sorted([most, 1, least, None], key=repr)
