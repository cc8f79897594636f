"""Joins of a corpus' words to what is made of each distinct word, without a row for each occurrence.

Documents are read in blocks. A block numbers its distinct words, keeps its documents as numbers,
and asks for its distinct words, packed by hash bucket. A bucket holds every request for its words,
so each distinct word is worked on once; answers go back by block. A word that stands in every
block is one entry a block in its bucket, so no bucket is hot. Rows of requests number at most the
distinct words of all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common

BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 12 << 20  #: bytes of texts a block and a bucket
STAGED = "asks boolean, bucket int, block long, words binary, times binary, doc_ids array<long>, heads array<string>, arrays array<binary>"
ANSWERS = "bucket int, block long, sizes binary, flat binary"
HISTOGRAM = -1  #: the block of a bucket's histogram
_KINDS = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, byte by byte, compressed; the first four bytes are how many."""
    n = len(numbers)
    return n.to_bytes(4, "little") + pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(n, 4).T), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64 if planes[3 * n :].any() else np.int32)


def groups(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts without nulls) in groups of about ``most`` bytes."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def gathered(flat: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ``flat`` that numbers name, one after the other, where each ends); sizes: of the runs."""
    lengths = sizes[numbers]
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64  # memory traffic is what this costs
    begins = (np.cumsum(sizes, dtype=kind) - sizes)[numbers] - ends.astype(kind) + lengths
    at = np.repeat(begins, lengths)
    at += np.arange(total, dtype=kind)
    return flat[at], ends


def whole_sequences(bounds: np.ndarray, numbers: np.ndarray, words: int) -> list[np.ndarray]:
    """The arrays of a block that are needed to put its texts together again."""
    return [bounds, numbers]


def staged(docs: DataFrame, split: Callable, arrays: Callable = whole_sequences) -> DataFrame:
    """Requests (asks) and one row for each block of ``docs`` (doc_id long, text, perhaps head), as a written table.

    split(texts): bounds of each text's words, the number of each word, the distinct words; no word
    holds a newline. arrays(bounds, numbers, words): what the block's row keeps. Numbers there
    follow the words' frequencies in the block, so that most are small.
    """
    buckets = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    headed = "head" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh32_intdigest

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for first, texts in groups(b.column("text"), BLOCK_BYTES):
                bounds, numbers, words = split(texts)
                times = np.bincount(numbers, minlength=len(words))
                ranked = np.argsort(-times, kind="stable")
                rank = np.empty(len(ranked), np.int32)
                rank[ranked] = np.arange(len(ranked))
                of = np.fromiter(map(xxh32_intdigest, words.cast(pa.binary()).to_pylist()), np.int64, len(words))[ranked] % buckets
                order = np.argsort(of, kind="stable")
                kinds, begins = np.unique(of[order], return_index=True)
                begins = np.append(begins, len(order))
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), words.take(pa.array(ranked[order])))
                times, rows = times[ranked[order]], []
                for k, joined in zip(range(len(kinds)), pc.binary_join(lists, "\n").cast(pa.binary()).to_pylist()):
                    rows.append((True, kinds[k], block, _common.squeezed(joined), packed(times[begins[k] : begins[k + 1]]), None, None, None))
                own = b.slice(first, len(texts))
                rows.append((False, None, block, None, None, own.column("doc_id").to_pylist(), own.column("head").to_pylist() if headed else None, [packed(x) for x in (of, *arrays(bounds, rank[numbers], len(order)))]))
                yield _batch(STAGED, rows)
                block += 1

    return _common.written(docs.mapInArrow(run, STAGED), "blocks", by="asks")


def answered(table: DataFrame, work: Callable, histogram: bool = False) -> DataFrame:
    """The answers to a staged table's requests. work(words): for each distinct word the size of its
    answer, and the answers' numbers one after the other.

    histogram: one row more a bucket (block HISTOGRAM) counts all these numbers over all occurrences.
    """

    def answer(requests: pa.Table) -> pa.Table:
        asked = list(map(_common.unsqueezed, requests.column("words").to_pylist()))
        lists = pc.split_pattern(pa.array(asked, pa.binary()).cast(pa.string()), "\n")
        encoded = lists.flatten().dictionary_encode()
        bounds, numbers = lists.offsets.to_numpy().tolist(), encoded.indices.to_numpy()
        sizes, flat = work(encoded.dictionary.to_pylist())
        rows = []
        buckets, blocks = requests.column("bucket").to_pylist(), requests.column("block").to_pylist()
        for k, (bucket, block) in enumerate(zip(buckets, blocks)):
            own = numbers[bounds[k] : bounds[k + 1]]
            rows.append((bucket, block, packed(sizes[own]), packed(gathered(flat, sizes, own)[0]) if len(flat) else None))
        if histogram and len(flat):
            times = np.bincount(numbers, np.concatenate([unpacked(x) for x in requests.column("times").to_pylist()]), len(sizes)).astype(np.int64)
            total = np.bincount(flat, np.repeat(times, sizes)).astype(np.int64)
            at = np.flatnonzero(total)
            rows.append((buckets[0], HISTOGRAM, at.astype("<u4").tobytes(), total[at].astype("<u8").tobytes()))
        return pa.Table.from_batches([_batch(ANSWERS, rows)])

    return table.where("asks").select("bucket", "block", "words", *["times"] * histogram).groupBy("bucket").applyInArrow(answer, ANSWERS)


def joined(table: DataFrame, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Each block with its answers: finish(doc_ids, heads, arrays, sizes, flat) gives a record batch; the
    sizes are in the order of the block's numbers, as are the runs of flat."""

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        rows = sorted(zip(given.column("bucket").to_pylist(), given.column("sizes").to_pylist(), given.column("flat").to_pylist()))
        sizes = np.concatenate([np.zeros(0, np.int32), *[unpacked(s) for _, s, _ in rows]])
        flat = np.concatenate([np.zeros(0, np.int32), *[unpacked(f) for _, _, f in rows if f is not None]])
        out = []
        for r in own.to_pylist():
            of, *arrays = (unpacked(x) for x in r["arrays"])
            place = np.empty(len(of), np.int32)
            place[np.argsort(of, kind="stable")] = np.arange(len(of))  # answers come bucket by bucket
            out.append(finish(pa.array(r["doc_ids"], pa.int64()), r["heads"], arrays, sizes[place], gathered(flat, sizes, place)[0] if len(flat) else flat))
        return pa.Table.from_batches(out)

    own = table.where("not asks").select("block", "doc_ids", "heads", "arrays")
    return own.groupBy("block").cogroup(answers.where(F.col("block") != HISTOGRAM).groupBy("block")).applyInArrow(run, schema)
