"""A small corpus with every awkward case."""

import random

import public_tokenizers

WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, prediction string, start string, range string, block string"


def texts() -> list:
    r = random.Random(5)
    words = ["the", "and", "river", "stone", "Light", "über", "café", "naïve", "12", "don't", "<|endoftext|>", "日本", "x.y", "İ", "😀"]
    own = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(20)]
    long = " ".join(f"w{r.randint(0, 900)}" for _ in range(30_000))
    return [None, "", " ", "\n\t \r", "a", "a" * 5000, *own, own[0], own[0], own[1] + " ", long, "word\nword  word\tword", "x" * 70 + " y"]


def corpus(spark, rows=None):
    """Ids out of order, one twice, one null; extra columns with names that operators use."""
    rows = texts() if rows is None else rows
    ids = [(k * 7) % 1009 for k in range(len(rows))]
    if len(ids) > 8:
        ids[7] = ids[6]
        ids[8] = None
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "r", "b") for i, t in zip(ids, rows)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
