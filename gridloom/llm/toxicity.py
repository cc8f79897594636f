"""Toxicity by weak supervision.

Terms (words and word beginnings) that labelled toxic rows favour become lexicon voters, and hit
patterns over the lexicon become pattern voters. A generative label model estimates, by expectation
maximisation, how often each voter (the given label is one) fires on either class and how much each
pair shares beyond the class: accuracies and correlations. A linear classifier is trained on
the posterior labels. It learns from a bounded sample: TOXIC_ROWS + CLEAN_ROWS labelled rows, drawn by language.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common

TOXIC_ROWS, CLEAN_ROWS = 3000, 9000  #: labelled rows that are learned from at most
TERMS = 256  #: lexicon voters at most
BEGINNINGS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("any hit", "two hits", "three hits", "two terms", "dense", "hit in first half", "hit in second half")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms_of(word: str) -> Iterator[str]:
    """The word, and its beginnings (with a star)."""
    yield word
    for k in BEGINNINGS:
        if len(word) > k:
            yield word[:k] + "*"


@dataclass
class Model:
    terms: list[str]
    voter_rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    independence: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS) + 2))
    bias: float = -5.0

    def __post_init__(self):
        self._at = {t: k for k, t in enumerate(self.terms)}

    def votes(self, text: str | None) -> np.ndarray:
        """1 where a voter says toxic: lexicon terms, then PATTERNS; the rest abstain."""
        out = np.zeros(len(self.terms) + len(PATTERNS), np.int8)
        found = words(text) if text else []
        hits, n, first, second = 0, 0, False, False
        seen = set()
        half = len(found) / 2
        for place, w in enumerate(found):
            if (k := self._memo.get(w)) is None:
                k = self._memo[w] = tuple(self._at[t] for t in terms_of(w) if t in self._at)
                if len(self._memo) > 300_000:
                    self._memo.clear()
            if k:
                hits += 1
                seen.add(w)
                out[list(k)] = 1
                first |= place < half
                second |= place >= half
        n = max(1, len(found))
        out[len(self.terms) :] = (hits > 0, hits > 1, hits > 2, len(seen) > 1, hits / n > 0.02, first, second)
        return out

    @property
    def _memo(self) -> dict:
        if "_cache" not in self.__dict__:
            self.__dict__["_cache"] = {}
        return self.__dict__["_cache"]

    def features(self, votes: np.ndarray) -> np.ndarray:
        """The classifier's inputs: evidence of lexicon voters by the label model, and the patterns."""
        m = len(self.terms)
        lift = np.log(self.voter_rates[:m, 1] / self.voter_rates[:m, 0]) * self.independence[:m]
        lexicon = votes[..., :m] @ lift if m else np.zeros(votes.shape[:-1])
        return np.concatenate([np.stack([np.clip(lexicon, -20, 20) / 5, np.log1p(votes[..., :m].sum(axis=-1))], axis=-1), votes[..., m:]], axis=-1)

    def score(self, text: str | None) -> float:
        z = float(self.features(self.votes(text)) @ self.weights + self.bias) if self.terms else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def udf(self):
        """text -> score, a batch at a time."""

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series([self.score(t if isinstance(t, str) else None) for t in texts], dtype="float64")

        return score


def _own_shares(v: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Each voter's share of evidence of its own: entropy over entropy and mutual information with every
    other voter, given the class. A pair's information is scaled as a correlation, by its square root."""
    n = v.shape[1]
    shared, alone = np.zeros((n, n)), np.zeros(n)
    for w in (post, 1 - post):
        total = w.sum() + 1
        one = np.clip((v.T @ w + 0.5) / total, 1e-9, 1 - 1e-9)
        both = (v.T @ (v * w[:, None]) + 0.25) / total
        cells = ((both, one[:, None] * one), (one[:, None] - both, one[:, None] * (1 - one)), (one - both, (1 - one[:, None]) * one), (1 - one[:, None] - one + both, (1 - one[:, None]) * (1 - one)))
        shared += total * sum(np.maximum(p, 1e-9) * np.log(np.maximum(p, 1e-9) / q) for p, q in cells)
        alone -= total * (one * np.log(one) + (1 - one) * np.log(1 - one))
    np.fill_diagonal(shared, 0)
    return 1 / (1 + np.sqrt(np.maximum(shared, 0) / np.maximum(np.sqrt(np.outer(alone, alone)), 1e-9)).sum(axis=1))


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates of firing on clean and toxic rows, share of own evidence, posterior of toxic) of each voter.

    The parameters are each voter's rates of firing on either class (its accuracy) and each pair's mutual
    information given the class (its correlation), both estimated by expectation maximisation, the
    pairs' anew every ten rounds. A voter's evidence is weighed by the share that others don't repeat.
    (Conditional rates on a tree of voters were tried: they take a language whose words are rare among
    hits for clean.) labels is a voter with an
    accuracy of its own; posteriors begin from it.
    """
    v = np.concatenate([votes, labels[:, None]], axis=1).astype(float)
    post = np.clip(labels.astype(float), 0.05, 0.95)
    for step in range(rounds):
        prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        toxic = (v.T @ post + 0.5) / (post.sum() + 1)
        clean = (v.T @ (1 - post) + 0.5) / ((1 - post).sum() + 1)
        if step % 10 == 0:
            own = _own_shares(v, post)
            own[-1] = 1
        z = np.log(prior / (1 - prior)) + (v * np.log(toxic / clean) + (1 - v) * np.log((1 - toxic) / (1 - clean))) @ own
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return np.stack([clean, toxic], axis=1), own, post


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method for the ridge-penalised log loss on soft labels."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """A model of ``labels`` (doc_id, toxic) on ``docs`` (doc_id, text) where may_learn(doc_id) holds.

    Labels other than 0 and 1 and those of a null doc_id are not read; a doc_id that is labelled both
    ways is clean. At most toxic_rows and clean_rows labelled rows and TERMS terms make the model.
    """
    _common.ship(docs.sparkSession)
    of, spoken = _draw(docs, labels.where(may_learn), toxic_rows, clean_rows)
    sample = docs.select("doc_id", "text").where(F.col("doc_id").isin(list(of)) & F.col("text").isNotNull()) if of else None
    terms = _lexicon(sample, of, spoken) if sample is not None else []
    model = Model(terms)
    if not terms:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([model.votes(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "votes"])

    rows = sample.mapInArrow(run, "doc_id long, votes binary").toPandas().sort_values(["doc_id", "votes"])
    votes = np.stack([np.frombuffer(x, np.int8) for x in rows["votes"]])
    given = np.array([of[i] for i in rows["doc_id"]])
    model.voter_rates, model.independence, posterior = label_model(votes, given)
    model.weights, model.bias = logistic(model.features(votes), posterior)
    return model


def shares(have: dict[str, int], most: int, weights: dict[str, int]) -> dict[str, int]:
    """Places of each language, by weight; what a language can't fill goes to the others."""
    out, open_, left = dict.fromkeys(have, 0), set(have), most
    while open_:
        each = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if have[k] <= each * weights[k]}
        out |= {k: have[k] if k in full else int(each * weights[k]) for k in open_}
        if not full:
            break
        left -= sum(have[k] for k in full)
        open_ -= full
    return out


def _draw(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> tuple[dict[int, int], dict[int, str]]:
    """The label and the language of each row that is learned from.

    Languages get equal places among toxic rows, so that rare ones keep theirs, and places among
    clean rows as their toxic ones, so that pooled rates compare like with like. Rows labelled both ways are clean.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"))
    lang = F.coalesce(F.min(F.col("lang").cast("string")), F.lit("")) if "lang" in docs.columns else F.lit("")
    known = known.join(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(lang.alias("lang")), "doc_id")
    have: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for r in known.groupBy("toxic", "lang").count().collect():
        have[r["toxic"]][r["lang"]] = r["count"]
    places = {1: shares(have[1], toxic_rows, dict.fromkeys(have[1], 1))}
    places[0] = shares(have[0], clean_rows, {k: max(places[1].get(k, 0), 20) for k in have[0]})
    # Rows below a bound on their hash: a little more than the places, and cut to them here.
    parts = [(y, k, min(1.0, (n + 6 * n**0.5 + 20) / have[y][k])) for y in places for k, n in places[y].items()]
    if not parts:
        return {}, {}
    bounds = docs.sparkSession.createDataFrame(parts, "toxic int, lang string, most double")
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    of, spoken = {}, {}
    for r in sorted(known.join(F.broadcast(bounds), ["toxic", "lang"]).withColumn("hash", hashed).where("hash <= most").collect(), key=lambda r: (r["hash"], r["doc_id"])):
        if places[r["toxic"]][r["lang"]] > 0:
            places[r["toxic"]][r["lang"]] -= 1
            of[r["doc_id"]], spoken[r["doc_id"]] = r["toxic"], r["lang"]
    return of, spoken


def sketch(text: str) -> list[int]:
    """The 16 smallest hashes of three words in a row, as white space parts them."""
    found = text.lower().split()
    return sorted({zlib.crc32(" ".join(found[k : k + 3]).encode()) for k in range(max(1, len(found) - 2))})[:16]


def copies(sketches: dict[int, list[int]]) -> set[int]:
    """Rows that share half of their sketch with an earlier row that is no copy itself."""
    first: dict[int, list[int]] = {}
    out = set()
    for i in sorted(sketches):
        shared = Counter(k for h in sketches[i] for k in first.get(h, ()))
        if any(2 * n >= max(len(sketches[i]), len(sketches[k])) for k, n in shared.items()):
            out.add(i)
        else:
            for h in sketches[i]:
                first.setdefault(h, []).append(i)
    return out


def _lexicon(sample: DataFrame, of: dict[int, int], spoken: dict[int, str]) -> list[str]:
    """Up to TERMS terms that labelled toxic rows favour with confidence, dealt in turn to the languages of their toxic rows.

    Near copies of a toxic row are no support of their own: else each rare word of a row that was copied is a term.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([sketch(t) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], ["doc_id", "sketch"])

    toxic = sample.where(F.col("doc_id").isin([i for i, y in of.items() if y]))
    again = copies({r["doc_id"]: r["sketch"] for r in toxic.mapInArrow(sketched, "doc_id long, sketch array<long>").collect()})
    of = {i: y for i, y in of.items() if i not in again}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, str], Counter] = {}
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if i in of:
                    found.setdefault((of[i], spoken[i]), Counter()).update({t for w in set(words(text)) for t in terms_of(w)})
        for (y, lang), terms in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(terms.keys(), pa.string()), pa.array([lang] * len(terms), pa.string()), pa.array([n * y for n in terms.values()], pa.int64()), pa.array([n * (1 - y) for n in terms.values()], pa.int64())], ["term", "lang", "toxic", "clean"])

    n = Counter(of.values())
    sums = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    # One shuffle: rows of a term are together for both groupings.
    each = sample.mapInArrow(run, "term string, lang string, toxic long, clean long").repartition("term").groupBy("term", "lang").agg(*sums)
    total = each.groupBy("term").agg(*sums, F.max_by("lang", F.struct("toxic", "lang")).alias("lang"))
    # The interval's lower end of the log odds ratio, so that support counts.
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (n[1] - F.col("toxic") + 0.5)) - F.log(c / (n[0] - F.col("clean") + 0.5))
    lower = odds - 3 * F.sqrt(1 / t + 1 / c)
    rows = total.where(F.col("toxic") >= 3).withColumn("lower", lower).where("lower > 0.5").collect()  # few, as the sample is bounded
    return _places(sorted(rows, key=lambda r: (-r["lower"], len(r["term"]), r["term"])))


def _places(rows: list) -> list[str]:
    """Of terms, best first, those that add something; in turn of each language until TERMS are full."""
    kept: dict[str, int] = {}
    dealt: Counter = Counter()
    ranked = []
    for r in rows:
        stem = r["term"].rstrip("*")
        # A word or longer beginning adds nothing to a better beginning, nor does a beginning that finds no more toxic rows.
        if any(stem[:k] + "*" in kept for k in BEGINNINGS if k <= len(stem)):
            continue
        if r["term"].endswith("*") and any(n == r["toxic"] and k.startswith(stem) for k, n in kept.items()):
            continue
        kept[r["term"]] = r["toxic"]
        ranked.append((dealt[r["lang"]], len(ranked), r["term"]))
        dealt[r["lang"]] += 1
    return [term for _, _, term in sorted(ranked)[:TERMS]]


def assess(docs: DataFrame, model: Model, column: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text, 0 to 1.

    Null and empty texts get the score of a text without hits; without labelled rows of both
    kinds every score is low; repeated rows get equal scores, ties don't matter, and texts of any length
    are read whole; a column of that name is replaced.
    """
    return docs.withColumn(column, model.udf()("text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.documents(spark, sf_dir)
    held = _common.id_remainder(F.col("doc_id"), 5) == 0
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return assess(docs.select("doc_id", "text"), model, "score").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
