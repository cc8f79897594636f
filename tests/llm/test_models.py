"""Learned operators: held-out accuracy, exact model probabilities, and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import _common, language, lm_score, toxicity

from .helpers import SCHEMA, corpus, empty

SMALL = "/root/testdata/sf0.001"


def labelled(spark, n=240):
    r, rows = random.Random(4), []
    kinds = {"en": ["the", "and", "thing", "with"], "fr": ["les", "être", "où", "après"], "de": ["über", "nicht", "schön", "und"]}
    for i in range(n):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join(r.choice(kinds[lang]) for _ in range(12)), lang if i % 7 else None, "s", 0, "x", "y", "z", "r", "b"))
    rows += [(n, None, "en", "s", 0, "x", "y", "z", "r", "b"), (n + 1, "12 34 !", "en", "s", 0, "x", "y", "z", "r", "b"), (None, "les les", "fr", "s", 0, "x", "y", "z", "r", "b")]
    return spark.createDataFrame(rows, SCHEMA)


def test_language(spark):
    docs = labelled(spark)
    model = language.fit(docs, F.col("lang"), _common.id_remainder(F.col("doc_id"), 4) != 2)
    assert model.languages == ["de", "en", "fr"]
    out = language.identify(docs, model).collect()
    assert len(out) == 243
    truth = ["en", "fr", "de"]
    for r in out:
        lang, score = r["prediction"]["lang"], r["prediction"]["score"]
        assert 0 <= score <= 1
        if r["doc_id"] is not None and r["doc_id"] < 240:
            assert lang == truth[r["doc_id"] % 3]
        if r["doc_id"] in (240, 241):
            assert (lang, score) == ("und", 0.0)
    none = language.fit(empty(spark), F.col("lang"), F.lit(True))
    assert none.predict("some words") == ("und", 0.0)
    assert language.identify(empty(spark), none).count() == 0


def test_counts_of_long_texts(monkeypatch):
    text = "abc déf " * 500
    whole = language.counts(text)
    monkeypatch.setattr(language, "_SLICE", 100)
    assert (language.counts(text) == whole).all()


def test_temperature_fits():
    r = np.random.default_rng(0)
    scored = [(np.array([4.0, 0.0]), int(r.random() > 0.75)) for _ in range(2000)]
    assert 2.5 < language.temperature(scored) < 5


def test_letters():
    assert not any(map(language.has_letter, [None, "", "12 !", "²½①", "_ 3"])) and all(map(language.has_letter, ["é", "1a", "日"]))


def brute_ngrams(text):
    clean = []
    for c in f" {text.lower()} ":
        c = c if c.isalpha() and c.isascii() or ord(c) > 127 else " "
        if c != " " or not clean or clean[-1] != " ":
            clean.append(c)
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(clean) - n + 1):
            h = n * 0x27D4EB2F & 0xFFFFFFFF
            for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[:n]):
                h = (h ^ ord(clean[i + k])) * m & 0xFFFFFFFF
            out[h >> 17] += 1
    return out


def test_language_by_hand():
    """N-grams, TF-IDF, two steps of the learner and the calibrated probability."""
    text = "Thé the, 3 über"
    n = language.counts(text)
    brute = brute_ngrams(text)
    assert {int(k): int(n[k]) for k in np.flatnonzero(n)} == dict(brute)
    idf = np.random.default_rng(1).random(language.BUCKETS) + 1
    model = language.Model(["a", "b"], idf, np.random.default_rng(2).normal(size=(language.BUCKETS, 2)), temperature=2.0)
    at, x = model.features(n)
    own = {k: (1 + math.log(c)) * idf[k] for k, c in brute.items()}
    norm = math.sqrt(sum(v * v for v in own.values()))
    assert {int(k): pytest.approx(own[int(k)] / norm) for k in at} == dict(zip(at.tolist(), x.tolist()))
    z = [sum(own[k] / norm * model.weights[k, j] for k in own) / 2.0 for j in (0, 1)]
    assert model.probabilities(text)[0] == pytest.approx(1 / (1 + math.exp(z[1] - z[0])))
    rows, alpha, beta, l1, l2 = [(np.array([3, 5]), np.array([0.6, 0.8]), 1), (np.array([5]), np.array([1.0]), 0)], 2.0, 1.0, 0.02, 0.02
    zs, ns = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    weight = lambda k, j: 0.0 if abs(zs[k][j]) <= l1 else -(zs[k][j] - math.copysign(l1, zs[k][j])) / ((beta + math.sqrt(ns[k][j])) / alpha + l2)
    for at, x, y in rows:
        s = [sum(v * weight(k, j) for k, v in zip(at.tolist(), x.tolist())) for j in (0, 1)]
        p = [math.exp(v) / sum(map(math.exp, s)) for v in s]
        for k, v in zip(at.tolist(), x.tolist()):
            w = [weight(k, j) for j in (0, 1)]
            for j in (0, 1):
                g = v * (p[j] - (j == y))
                zs[k][j] += g - (math.sqrt(ns[k][j] + g * g) - math.sqrt(ns[k][j])) / alpha * w[j]
                ns[k][j] += g * g
    learned = language.ftrl(rows, 2, 1)
    for k in (3, 5):
        assert learned[k].tolist() == pytest.approx([weight(k, 0), weight(k, 1)])
    assert (np.flatnonzero(learned.any(axis=1)) == [3, 5]).all()


def test_long_texts_ties_and_repeats(spark):
    """Words beyond the first megabyte count; equal texts score equally; a doc_id labelled both ways is clean."""
    toxic = toxicity.Model(["vile"], np.array([[0.01, 0.9]] * 9), np.ones(9), np.ones(9), -3.0)
    far = "word " * 300_000 + "vile"
    assert toxic.votes(far)[0] == 1 and toxic.score(far) == toxic.score(far)
    docs = spark.createDataFrame([(i, f"vile w{i % 3}" if i % 2 else "kind words", "en") for i in range(200)] + [(1, "vile w1", "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 0)], "doc_id long, toxic int")
    of, _ = toxicity._draw(docs, marks, 3000, 9000)
    assert of[7] == 0 and of[9] == 1
    out = toxicity.assess(docs, toxicity.fit(docs, marks, F.lit(True))).collect()
    assert len({r["toxic_score"] for r in out if r["text"] == "vile w1"}) == 1 and len(out) == 201
    model = language.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx")), F.col("lang"), F.lit(True))
    assert model.predict("kind words " * 200_000)[0] == "en"
    tied = language.Model(["a", "b"], np.ones(language.BUCKETS), np.zeros((language.BUCKETS, 2)))
    assert tied.predict("same") == ("a", 0.5)


def test_posterior_by_hand():
    r = np.random.default_rng(5)
    y = r.random(800) < 0.4
    votes = np.stack([r.random(800) < np.where(y, a, b) for a, b in ((0.8, 0.1), (0.6, 0.2), (0.7, 0.05))], axis=1).astype(np.int8)
    labels = (r.random(800) < np.where(y, 0.9, 0.1)).astype(np.int8)
    rates, own, post = toxicity.label_model(votes, labels, rounds=400)
    prior = post.mean()
    for v, label, p in list(zip(votes, labels, post))[:60]:
        z = math.log(prior / (1 - prior))
        for fires, (clean, toxic), share in zip([*v, label], rates, own):
            z += share * (math.log(toxic / clean) if fires else math.log((1 - toxic) / (1 - clean)))
        assert p == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)


def test_toxicity(spark):
    r, rows, labels = random.Random(6), [], []
    clean = [f"word{i}" for i in range(200)]
    for i in range(600):
        words = [r.choice(clean) for _ in range(30)]
        if bad := i % 8 == 0:
            words[3], words[20] = r.choice(["vilea", "vileb", "vilec"]), r.choice(["nasty", "awful"])
        rows.append((i, " ".join(words), "en", "s", 0, "x", "y", "z", "r", "b"))
        labels.append((i, 1, int(bad) if i % 50 else None))
    docs = spark.createDataFrame([*rows, (600, None, "en", "s", 0, "x", "y", "z", "r", "b"), (601, "", "en", "s", 0, "x", "y", "z", "r", "b")], SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, _common.id_remainder(F.col("doc_id"), 5) != 0)
    assert {t[:4] for t in model.terms} <= {"vile", "nast", "awfu"}
    for row in toxicity.assess(docs, model).collect():
        assert 0 <= row["toxic_score"] <= 1
        assert (row["toxic_score"] >= 0.5) == (row["doc_id"] % 8 == 0 and row["doc_id"] < 600)
    blank = toxicity.fit(empty(spark), marks.where("false"), F.lit(True))
    assert blank.score("anything") < 0.5 and blank.score(None) < 0.5
    assert toxicity.assess(empty(spark), blank).count() == 0


def test_toxicity_of_a_minority_language(spark):
    """Its words occur in some clean rows too; every language must be recalled on held-out rows, and copies are no support."""
    r, rows, labels = random.Random(8), [], []
    for i in range(1500):
        lang, bad = ("es", i % 32 == 0) if i % 4 == 0 else ("en", i % 8 == 1)
        words = [f"{lang}{r.randint(0, 150)}x" for _ in range(30)]
        stem = "bomente" if lang == "es" else "vile"
        if bad:
            words[3], words[20] = (stem + r.choice("abc") for _ in range(2))
        elif lang == "es" and r.random() < 0.06:
            words[9] = stem + r.choice("abc")
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(bad)))
    copied = " ".join(f"{w}vileq" for w in "once upon another evening somebody walked".split())
    rows += [(i, f"{copied} vilea vileb x{i}", "en") for i in range(2000, 2040)]
    labels += [(i, 1) for i in range(2000, 2040)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = _common.id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, marks, ~held)
    assert not any(t.startswith(("once", "upon", "even")) for t in model.terms)
    of = dict(labels)
    seen = defaultdict(list)
    for row in toxicity.assess(docs.where(held), model).collect():
        seen[row["lang"], of[row["doc_id"]]].append(row["toxic_score"] >= 0.5)
    for lang in ("en", "es"):
        assert np.mean(seen[lang, 1]) >= 0.9 and np.mean(seen[lang, 0]) <= 0.1, lang


def test_rare_languages_keep_places():
    assert toxicity.shares({"a": 900, "b": 30, "c": 400}, 330, dict.fromkeys("abc", 1)) == {"a": 150, "b": 30, "c": 150}
    assert toxicity.shares({"a": 5, "b": 3}, 10, {"a": 1, "b": 1}) == {"a": 5, "b": 3}
    assert toxicity.shares({"a": 900, "b": 300}, 90, {"a": 150, "b": 30}) == {"a": 75, "b": 15}


def test_label_model_discounts_copies():
    r = np.random.default_rng(2)
    y = (r.random(3000) < 0.3).astype(int)
    vote = lambda hit, miss: (r.random(3000) < np.where(y, hit, miss)).astype(np.int8)
    a, b = vote(0.8, 0.05), vote(0.7, 0.1)
    rates, own, post = toxicity.label_model(np.stack([a, a, b], axis=1), vote(0.9, 0.05))
    assert own[0] < own[2] and abs(rates[2, 1] - 0.7) < 0.1
    assert ((post > 0.5) == y).mean() > 0.9


def brute_ppm(train, order):
    table = [defaultdict(Counter) for _ in range(order + 1)]

    def symbols(t):
        return bytes([lm_score.START]) * order + (t or "").encode().lower() + bytes([lm_score.END])

    for t in train:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                table[k][s[i - k : i]][s[i]] += 1

    def score(t):
        s, total = symbols(t), 0.0
        for i in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                c = {a: n for a, n in table[k][s[i - k : i]].items() if a not in gone}
                if not c:
                    continue
                n, d = sum(c.values()), len(c)
                if s[i] in c:
                    total += math.log10(c[s[i]] / (n + d))
                    break
                total += math.log10(d / (n + d))
                gone |= set(c)
            else:
                total -= math.log10(257 - len(gone))
        return total

    return score


@pytest.mark.parametrize("order,block", [(2, 1 << 24), (5, 600)])
def test_language_model(spark, order, block, monkeypatch):
    for name, value in (("BLOCK_BYTES", block), ("PART_BYTES", block // 3), ("PART_ROWS", 4), ("BUCKET_BYTES", 4 * block)):
        monkeypatch.setattr(lm_score, name, value)
    docs = corpus(spark).where("doc_id is null or length(text) < 20000 or text is null")
    rows = docs.collect()
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    train = [r["text"] for r in rows if learn(r["doc_id"])]
    counts = Counter(w for t in train for w in lm_score.tokens(t))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    ppm = brute_ppm(train, order)
    out = lm_score.score_documents(docs, _common.id_remainder(F.col("doc_id"), 5) != 1, order).collect()
    assert len(out) == len(rows)
    wanted = sorted(((r["doc_id"] is None, r["doc_id"] or 0), len(w := lm_score.tokens(r["text"])) + 1, sum(x in counts for x in w) + 1, n, sum(log(counts[x]) for x in w) + log(len(train)), ppm(r["text"])) for r in rows)
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out)
    for a, b in zip(found, wanted):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-12)


def test_language_model_without_rows(spark):
    assert lm_score.score_documents(empty(spark), F.lit(True)).count() == 0
    alone = lm_score.score_documents(corpus(spark, ["ab"]), F.lit(False)).collect()[0]
    assert alone["score"] == pytest.approx(-3 * math.log10(257)) and alone["n_known"] == 0


def test_base_scores_without_trie(spark, monkeypatch):
    docs = corpus(spark, ["a b a", " B\tc ", None, "a"])
    full = lm_score.score_documents(docs, F.lit(True)).drop("score").collect()

    def trie(*_):
        raise AssertionError("base scores need no grams")

    monkeypatch.setattr(lm_score, "_second_order", trie)
    alone = lm_score.score_documents(docs, F.lit(True), None)
    assert sorted(map(tuple, alone.drop("score").collect())) == sorted(map(tuple, full)) and alone.where("score is not null").count() == 0
    assert lm_score.base_scores(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = set()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept.select("text").distinct().count() == kept.count()
    final = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert {r["doc_id"] for r in final.collect()} == before
    clashing = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing, SMALL).count() == 0
