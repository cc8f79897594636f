"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every training row. Weights are learned by
follow-the-regularised-leader with an elastic net on a bounded sample (PER_LANGUAGE rows a
language, lowest hash first), and a temperature is fitted on rows of the sample kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 400  #: labelled rows of each language that the classifier is fitted on
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SLICE = 1 << 20


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text, lower-cased, letters and gaps only."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where((points < 65) | ((points > 90) & (points < 97)) | ((points > 122) & (points < 128)), np.uint32(32), points)
    points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]).astype(np.uint32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = points[keep]
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(points), _SLICE):
        part = points[at : at + _SLICE + max(ORDERS) - 1]
        own = min(_SLICE, len(points) - at)
        for n in ORDERS:
            m = min(own, len(part) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ part[k : k + m]) * _MULTIPLIERS[k]
            total += np.bincount(h >> np.uint32(17), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    temperature: float = 1.0

    def features(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(n)
        x = (1 + np.log(n[at])) * self.idf[at]
        return at, x / max(np.sqrt(x @ x), 1e-12)

    def probabilities(self, text: str) -> np.ndarray:
        at, x = self.features(counts(text))
        z = x @ self.weights[at] / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])

    def udf(self):
        """text -> struct(lang, score), a batch at a time."""

        @F.pandas_udf("lang string, score double")
        def predict(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang", "score"])

        return predict


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    seen += counts(t) > 0
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, label: Column, may_learn: Column, per_language: int = PER_LANGUAGE, epochs: int = 6) -> Model:
    """A model of the languages in ``label`` where ``may_learn`` holds and label isn't null."""
    _common.ship(docs.sparkSession)
    known = docs.select("doc_id", "text", label.alias("label")).where(may_learn & F.col("label").isNotNull() & F.col("text").isNotNull())
    frequency, n = _document_frequencies(known)
    place = Window.partitionBy("label").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    picked = known.select("doc_id", "label").withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= per_language)
    ids = [r["doc_id"] for r in picked.select("doc_id").collect()]  # at most per_language a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                c = counts(t)
                at = np.flatnonzero(c)
                rows.append((at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
            cols = list(zip(*rows)) if rows else [[], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("label"), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], ["doc_id", "label", "at", "n"])

    # InSet: the filter runs before texts reach Python.
    sample = known.where(F.col("doc_id").isin(ids)).select("doc_id", "text", F.col("label").cast("string")).mapInArrow(run, "doc_id long, label string, at binary, n binary").toPandas() if ids else pd.DataFrame(columns=["doc_id", "label", "at", "n"])
    sample = sample.sort_values(["doc_id", "label"]).reset_index(drop=True)
    languages = sorted(sample["label"].unique())
    model = Model(languages, np.log((1 + n) / (1 + frequency)) + 1, np.zeros((BUCKETS, len(languages))))
    order = np.random.default_rng(7).permutation(len(sample))
    rows = []
    for k in order:
        tf = np.zeros(BUCKETS, np.int64)
        tf[np.frombuffer(sample["at"][k], "<u2")] = np.frombuffer(sample["n"][k], "<u4")
        rows.append((*model.features(tf), languages.index(sample["label"][k])))
    apart = rows[: len(rows) // 5]
    model.weights = ftrl(rows[len(apart) :], len(languages), epochs)
    model.temperature = temperature([(x @ model.weights[at], y) for at, x, y in apart])
    return model


def ftrl(rows: list, classes: int, epochs: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Per-coordinate follow-the-proximally-regularised-leader for the softmax loss."""
    z, n, w = (np.zeros((BUCKETS, classes)) for _ in range(3))
    for _ in range(epochs):
        for at, x, y in rows:
            own = np.where(np.abs(z[at]) <= l1, 0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
            s = x @ own
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * own
            n[at] += g * g
    return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)) if rows else w


def temperature(scored: list) -> float:
    """The temperature of least log loss on scored rows, between 1/2 and 8."""
    if not scored:
        return 1.0
    s, y = np.array([a for a, _ in scored]), np.array([b for _, b in scored])

    def loss(t: float) -> float:
        q = s / t
        q = q - q.max(axis=1, keepdims=True)
        return float(-(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(axis=1))).mean())

    return float(min(np.exp(np.linspace(np.log(0.5), np.log(8), 65)), key=loss))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``prediction`` (lang, score) of the whole text.

    Null, empty and letterless texts are UNKNOWN with score 0, as is every text where no row had a
    label; ties go to the first language in sorted order; repeated rows get equal results; a column
    of ``docs`` that is named prediction is replaced.
    """
    return docs.withColumn("prediction", model.udf()("text"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.documents(spark, sf_dir)
    held = _common.id_remainder(F.col("doc_id"), 4) == 2
    model = fit(docs, F.col("lang"), ~held)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), F.col("prediction.lang").alias("lang_pred"), F.col("prediction.score").alias("score"))


QUERIES = {"op4_language": op4_language}
