"""Language identification by hierarchical discrimination.

Texts become hashed byte n-gram profiles. Linear support vector machines, one against one, first vote for a language
family; within the family that wins, others separate the closely related languages one against one.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versemill.llm._common import crc32_of_id, keyed_text, materialize

# Families of languages by ISO 639-1 code; any other label is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "turkic": "tr az uz kk ky tk".split(),
    "indic": "hi mr ne bn as gu pa or".split(),
    "cjk": "zh ja ko".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

DIMENSIONS = 2048
SAMPLE_ROWS = 4_000  # labelled rows that the machines are fitted on, at most
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")  # what the JVM takes for a letter too
_BLANK_PAIR = (((32 * 257 + 32) * 2654435761 & 0xFFFFFFFF) >> 15) & (DIMENSIONS - 1)
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def profile(text: str) -> np.ndarray:
    """Unit vector of square roots of n-gram counts (2 and 3 bytes of the lower-cased text, all but letters a space)."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(DIMENSIONS)
    mask = np.uint32(DIMENSIONS - 1)
    pair = raw[:-1] * np.uint32(257) + raw[1:]
    counts += np.bincount((pair * np.uint32(2654435761) >> np.uint32(15)) & mask, minlength=DIMENSIONS)
    triple = pair[:-1] * np.uint32(257) + raw[2:]
    counts += np.bincount((triple * np.uint32(2246822519) >> np.uint32(13)) & mask, minlength=DIMENSIONS)
    counts[_BLANK_PAIR] = 0
    x = np.sqrt(counts)
    return x / max(float(np.linalg.norm(x)), 1e-12)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> np.ndarray:
    """Linear SVM with squared hinge loss, balanced classes, by accelerated gradient descent; the last weight is the bias."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    lam = np.float32(1.0 / (c * 100))
    rate = np.float32(1.0 / (lam + 2 * float((weight[:, None] * a * a).sum())))
    w = v = np.zeros(a.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (a @ v))
        new = v - rate * (lam * v - 2 * (a.T @ (weight * y * slack)))
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w.astype(float)


@dataclass
class Model:
    """family pair -> machine, and family -> (language pair -> machine); a positive margin is for the first of a pair."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    between: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    within: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @staticmethod
    def _vote(x: np.ndarray, names: list[str], machines: dict[tuple[str, str], np.ndarray]) -> tuple[str, float]:
        """The name with most wins (ties: larger summed margin, then name), and the least of its pairwise probabilities."""
        wins, margins, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b in itertools.combinations(names, 2):
            m = float(x @ machines[a, b][:-1] + machines[a, b][-1])
            wins[a if m > 0 else b] += 1
            margins[a] += m
            margins[b] -= m
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * m))))
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = min(names, key=lambda n: (-wins[n], -margins[n], n))
        return best, least[best]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = profile(text)
        family, p = self._vote(x, self.families, self.between)
        lang, q = self._vote(x, self.languages[family], self.within)
        return lang, p * q


def fit(rows: list[tuple[str, np.ndarray]]) -> Model:
    """Machines for all pairs of families, and of languages within a family, from (lang, profile) rows."""
    by_lang: dict[str, list[np.ndarray]] = defaultdict(list)
    for lang, x in rows:
        by_lang[lang].append(x)
    data = {lang: np.stack(xs) for lang, xs in sorted(by_lang.items())}
    by_family: dict[str, list[str]] = defaultdict(list)
    for lang in data:
        by_family[FAMILY_OF.get(lang, f"only {lang}")].append(lang)
    model = Model(sorted(by_family), dict(by_family))

    def machine(a: list[str], b: list[str]) -> np.ndarray:
        x = np.vstack([data[k] for k in (*a, *b)])
        n = sum(len(data[k]) for k in a)
        return train_svm(x, np.where(np.arange(len(x)) < n, 1.0, -1.0))

    for a, b in itertools.combinations(model.families, 2):
        model.between[a, b] = machine(by_family[a], by_family[b])
    for langs in by_family.values():
        for a, b in itertools.combinations(langs, 2):
            model.within[a, b] = machine([a], [b])
    return model


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on (doc_id, text, lang) rows with a language and a letter, ``sample_rows`` at most.

    Each language gives its first rows by the hash of doc_id, then its second rows and so on, so that rare languages are
    learned too. Which rows may be learned from is the caller's choice. Profiles are made on executors, and the driver
    receives at most ``sample_rows`` of them. Without usable rows the model predicts ``und`` everywhere.
    """
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    ids = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("h", F.xxhash64("doc_id"))
    ids = materialize(ids)
    # a frequent language sends its least hashes only, some four times as many as can be picked, to the task that ranks them
    sizes = ids.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(sample_rows)
    few = ids.join(F.broadcast(sizes), "lang").where((F.col("h") / 2.0**64 + 0.5) * F.col("rows") <= 4 * sample_rows)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = few.withColumn("place", place).where(F.col("place") <= sample_rows).orderBy("place", "h", "doc_id").limit(sample_rows).select("doc_id")
    # bounded by sample_rows ids; of rows that repeat an id one is used
    rows = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("lang", "text").alias("row")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("row").alias("row")).select("row.lang", "row.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(lang, profile(text).astype(np.float32).tobytes()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if _LETTER.search(text)]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.binary())], ["lang", "profile"])

    found = rows.mapInArrow(run, "lang string, profile binary").collect()
    return fit(sorted(((r["lang"], np.frombuffer(r["profile"], np.float32).astype(float)) for r in found), key=lambda r: (r[0], r[1].tobytes())))


def held_out(doc_id: str = "doc_id"):
    """Whether a row may not be learned from: crc32 of the id as text, modulo 5, is 0."""
    return crc32_of_id(doc_id) % 5 == 0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; ``und`` with score 0 where text is null or has no letter.

    A null doc_id passes through; repeated rows give repeated results; an empty table gives no rows; other columns are
    ignored. One map over the rows: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [model.predict(batch.column(1)[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())], ["doc_id", "lang_pred", "score"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from rows that are not held out, then predict all: doc_id, held_out, lang_pred, score."""
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
