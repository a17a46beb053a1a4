"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs of other scripts, digits that stand for letters), an Aho-Corasick automaton
finds lexicon entries in one pass, exception phrases shield what lies inside them, and the weighted hits, as a sum and
as a density over the words of the text, are mapped to a score. Entries, weights and the map are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm._common import crc32_of_id, give_back, keyed_text, text_slices
from versemill.llm.jaccard_join import shingle_sets

# Letters of other scripts that look like Latin ones, and digits used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "г": "r", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
#: "1" stands for i as well as for l, so these are one letter on both sides, and so are bars and exclamation marks within words.
SAME = {"l": "i"}
_BAR = re.compile(r"(?<=[^\W\d_])[!|](?=[^\W_])")

SAMPLE_ROWS = 20_000  # labelled rows that the lexicon and the score are learned from, at most
PREFIXES = (4, 5, 6, 7, 8)
MIN_SUPPORT, MIN_EVIDENCE = 6, 30.0
HARMLESS = 10.0  # evidence that a phrase with a hit is harmless, and how many texts of label 0 it takes for one of label 1
THRESHOLD = 0.3


class _Fold(dict):
    """Code point to folded text; all that is no letter or digit becomes a space."""

    def __missing__(self, code: int) -> str:
        ch = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFKD", HOMOGLYPHS.get(ch, ch)) if not unicodedata.combining(c))
        out = "".join(SAME.get(x, x) for c in base for x in (HOMOGLYPHS.get(c, DIGITS.get(c, c)) if c.isalnum() else " "))
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    if "!" in text or "|" in text:
        text = _BAR.sub("i", text)
    return " " + text.translate(_FOLD) + " "


def candidates(text: str) -> set[str]:
    """Lexicon candidates of a text: its folded words (" word ") and their beginnings (" wor")."""
    words = set(fold(text).split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n}


def evidence(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of an entry, and its log-likelihood ratio against independence of the label."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    share = n_pos / (n_pos + n_neg)
    n = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(pos > 0, pos * np.log(pos / (n * share)), 0) + np.where(neg > 0, neg * np.log(neg / (n * (1 - share))), 0))
    return odds, g


@dataclass
class Lexicon:
    """Entries with weights, exception phrases and the score's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, ...] = (-4.0, 1.0, 1.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        table: dict[str, tuple[int, float]] = {k: (len(k), w) for k, w in self.weights.items()}
        table |= {f" {' '.join(fold(p).split())} ": (0, 0.0) for p in self.exceptions}
        if not table:
            return None
        out = ahocorasick.Automaton()
        for k, (n, w) in table.items():
            out.add_word(k, (len(k), w, n == 0))
        out.make_automaton()
        return out


_SQUEEZE = re.compile("  +")


def folded_words(text: str) -> str:
    return _SQUEEZE.sub(" ", fold(text))


def find_hits(folded: str, automaton: ahocorasick.Automaton | None) -> dict[int, float]:
    """Place (of the space before the word) and weight of each hit: a word's heaviest entry, unless an exception phrase holds it."""
    hits: dict[int, float] = {}
    shields: list[tuple[int, int]] = []
    if automaton is not None:
        for end, (n, weight, shield) in automaton.iter(folded):
            start = end - n + 1
            if shield:
                shields.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
    shields.sort()
    at = reach = 0
    for place in sorted(hits) if shields else ():  # one sweep over both
        while at < len(shields) and shields[at][0] <= place:
            reach, at = max(reach, shields[at][1]), at + 1
        if place < reach:
            del hits[place]
    return hits


def features(text: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float, float]:
    """(log of the weighted hits, log of their density in a thousand words, heaviest hit). A word counts once, by its heaviest entry."""
    folded = folded_words(text)
    hits = find_hits(folded, automaton)
    total, words = sum(hits.values()), max(1, folded.count(" ") - 1)
    return math.log1p(total), math.log1p(1000 * total / words), max(hits.values(), default=0.0)


def phrases(text: str, automaton: ahocorasick.Automaton | None) -> set[str]:
    """The words that are hits, each with the word before and with the word after it."""
    folded = folded_words(text)
    out = set()
    for k in find_hits(folded, automaton):
        end = folded.index(" ", k + 1)
        if k > 0:
            out.add(folded[folded.rindex(" ", 0, k) + 1 : end])
        if end + 1 < len(folded):
            out.add(folded[k + 1 : folded.index(" ", end + 1)])
    return out


def _counter(entries_of):
    """Counts texts of either label that have each of the entries ``entries_of`` finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(counts: dict[str, list[int]]) -> pa.RecordBatch:
            pos, neg = ([v[k] for v in counts.values()] for k in range(2))
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(pos, pa.int64()), pa.array(neg, pa.int64())], ["entry", "pos", "neg"])

        find, counts = entries_of(), defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                for c in find(text.as_py() or ""):
                    counts[c][0 if toxic else 1] += 1
                if len(counts) > 60_000:
                    yield told(counts)
                    counts.clear()
        yield told(counts)
        counts.clear()
        give_back()

    return run


def _phrase_finder(lexicon: Lexicon):
    automaton = lexicon.automaton()
    return lambda text: phrases(text, automaton)


def _scorer(lexicon: Lexicon):
    """Text to score."""
    automaton, w = lexicon.automaton(), lexicon.coefficients

    def of(text: str | None) -> float:
        z = w[0] + sum(a * b for a, b in zip(w[1:], features(text or "", automaton), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return of


def _copy_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least shingle hash of each text, which near copies mostly share."""
    for batch in batches:
        done = 0
        for _, texts in text_slices(batch.column(0), batch.column(1)):
            least = [int(s[0] >> np.uint64(1)) if len(s) else -1 for s in shingle_sets(texts)]
            part = batch.slice(done, len(texts))
            done += len(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least, pa.int64())], ["toxic", "text", "least"])


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-3] + [0.05] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn a lexicon from labelled rows (doc_id, toxic), ``sample_rows`` of them at most, picked by the hash of doc_id.

    Which ids are used is the caller's choice: pass labels of training rows only. Rows of null doc_id or toxic are left
    out, repeated labels of a doc_id count once (toxic if any is), near copies of one label count once, by their least
    shingle. Phrases of a hit and the word beside it that are found in texts of label 0 only, or nearly so, are learned as
    exceptions and added to ``exceptions``. With no usable row the lexicon is empty and all scores are equal. Counting runs on executors; the driver receives entries and at most
    ``sample_rows`` rows of three numbers.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # bounded by sample_rows rows of two numbers
    told = keyed_text(docs).join(F.broadcast(picked), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_copy_class, "toxic int, text string, least long")
    rows = told.groupBy("toxic", "least").agg(F.min("text").alias("text")).persist()
    try:
        size = Counter({r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()})
        n_pos, n_neg = size[1], sum(size.values()) - size[1]
        lexicon = Lexicon({}, exceptions)
        if not n_pos or not n_neg:
            return lexicon
        counts = rows.mapInArrow(_counter(lambda: candidates), "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        found = counts.where(f"pos >= {MIN_SUPPORT} and pos * {n_neg} > 3 * neg * {n_pos}").toPandas()
        odds, g = evidence(found["pos"].to_numpy(float), found["neg"].to_numpy(float), n_pos, n_neg)
        keep = g >= MIN_EVIDENCE
        weights = dict(zip(found["entry"][keep], odds[keep].tolist(), strict=True))
        # a longer beginning that says no more than a shorter one of the same word is redundant
        lexicon.weights = {k: w for k, w in weights.items() if not any(weights.get(k[:n], -1) >= w for n in range(PREFIXES[0] + 1, len(k)))}
        beside = rows.mapInArrow(_counter(lambda: _phrase_finder(lexicon)), "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        beside = beside.where(f"neg >= {MIN_SUPPORT} and neg > {HARMLESS} * pos").toPandas()  # at most sample_rows / MIN_SUPPORT for each hit in a text
        # against even odds: a hit says label 1, its phrase label 0
        _, g = evidence(beside["pos"].to_numpy(float), beside["neg"].to_numpy(float), 1.0, 1.0)
        lexicon.exceptions = (*exceptions, *sorted(beside["entry"][g >= HARMLESS]))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = lexicon.automaton()
            for batch in batches:
                found = [features(t.as_py(), automaton) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([*[pa.array([f[k] for f in found], pa.float64()) for k in range(3)], batch.column("toxic")], ["a", "b", "c", "y"])

        table = rows.mapInArrow(measure, "a double, b double, c double, y int").toPandas().sort_values(["a", "b", "c", "y"])
        lexicon.coefficients = _fit(table[["a", "b", "c"]].to_numpy(), table["y"].to_numpy(float))
        return lexicon
    finally:
        rows.unpersist()


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every whole text: score in 0..1, predicted 1 from ``threshold`` on.

    Null text scores as empty text; a null doc_id passes through; repeated rows give repeated results; an empty table
    gives no rows; other columns are ignored. One map over the rows: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(lexicon)
        for batch in batches:
            s = np.asarray([of(t.as_py()) for t in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """Whether a row may not be learned from: crc32 of the id as text, modulo 4, is 2."""
    return crc32_of_id(doc_id) % 4 == 2


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out, then score all documents: doc_id, held_out, score, predicted."""
    lexicon = learn(docs, labels.where(~held_out()))
    return score(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents whose score is below ``threshold``, with all their columns, whatever their names.

    The decision is made on the row itself: nothing is joined. A null text scores as the empty text; a null doc_id stays;
    repeated rows share their fate; an empty table gives no rows.
    """
    lexicon = learn(docs, labels.where(~held_out()))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(lexicon)
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py()) < threshold for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
