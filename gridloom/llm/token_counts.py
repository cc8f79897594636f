"""Token counts: pieces are counted once per distinct pre-token, then joined to per-document frequencies.

Each block of documents becomes a table (document, chunk, frequency), packed in one row, and asks for
its distinct chunks by hash bucket. A bucket sizes each distinct chunk once; the sizes go back by block
and meet the frequencies there. Chunks are what spaces part: whole runs of pre-tokens, as these never
cross white space. No ids of a document are built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common, blocks, wordpieces

LIMIT = 2048
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _counted(doc_ids: pa.Array, n_bytes: np.ndarray, n: np.ndarray, limit: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [x.split()[0] for x in COUNTS.split(", ")])


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _directly(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """For tokenizers whose pre-tokens may cross white space: each text by the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = wordpieces.load(tokenizer)
        for b in batches:
            n = np.array([pieces.count(t) for t in b.column("text").to_pylist()], np.int64)
            yield _counted(b.column("doc_id"), _sizes(b.column("text")), n, limit)

    return docs.mapInArrow(run, COUNTS)


def _frequencies(bounds: np.ndarray, numbers: np.ndarray, words: int) -> list[np.ndarray]:
    """(document, chunk, frequency) of a block: where each document ends, chunks, frequencies."""
    n = len(bounds) - 1
    pairs, times = np.unique(np.repeat(np.arange(n), np.diff(bounds)) * words + numbers, return_counts=True)
    return [np.searchsorted(pairs, (np.arange(n) + 1) * words), pairs % words, times]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text).

    Null and empty texts count as no bytes and no tokens; rows with equal doc_id stay apart, an
    empty table gives an empty one; further columns are ignored; a null doc_id is kept.
    """
    _common.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if not wordpieces.load(tokenizer).separable:
        return _directly(docs, tokenizer, limit)

    def size(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(map(wordpieces.load(tokenizer).size, chunks), np.int32, len(chunks)), np.zeros(0, np.int32)

    def join(doc_ids: pa.Array, heads: list[str], arrays: list[np.ndarray], sizes: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
        ends, chunks, times = arrays
        total = np.concatenate([[0], np.cumsum(sizes[chunks].astype(np.int64) * times)])[np.concatenate([[0], ends])]
        return _counted(doc_ids, np.array(heads, np.int64), np.diff(total), limit)

    # The bytes of each text travel as its head.
    table = blocks.staged(docs.withColumn("head", F.coalesce(F.octet_length("text"), F.lit(0)).cast("string")), wordpieces.numbered, _frequencies)
    return blocks.joined(table, blocks.answered(table, size), join, COUNTS)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_token_counts": op8_token_counts}
