"""Token ids of documents as rANS-coded files, and the way back.

A dataset is a folder with three Parquet tables: ``table`` (shared symbol frequencies over all
documents), ``shards`` (tokens a shard) and ``segments``. Shards are ranges of ascending doc_id; a segment is up to
SEGMENT ids of a shard as independent rANS blocks, with the runs of documents in it. Parquet is the
container so that Spark's commit protocol covers lost executors on any file system.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common, rans, wordpieces

SEGMENT = 64 * rans.BLOCK
END_ID = 1
PREFIX = 64  #: characters of a text that order rows of equal doc_id
ROWS = "range int, doc_id long, head string, wide boolean, ids binary"
SEGMENTS = "shard int, first long, doc_ids array<long>, doc_starts array<long>, lengths array<long>, blocks array<binary>"


def _rows(cuts: np.ndarray):
    """A block's documents with the range of their doc_id (nulls first); 16 bits an id where all of a document fit, compressed."""

    def finish(doc_ids: pa.Array, heads: list, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        begins = np.concatenate([[0], ends[:-1]])
        wide = np.maximum.reduceat(ids, begins) > 0xFFFF
        narrow, whole = ids.astype("<u2").tobytes(), ids.astype("<u4").tobytes() if wide.any() else b""
        own = [_common.squeezed(whole[4 * x : 4 * y] if w else narrow[2 * x : 2 * y]) for x, y, w in zip(begins.tolist(), ends.tolist(), wide.tolist())]
        place = np.searchsorted(cuts, doc_ids.fill_null(0).to_numpy(zero_copy_only=False), "left") + 1
        place[doc_ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), doc_ids, pa.array(heads, pa.string()), pa.array(wide), pa.array(own, pa.binary())], [x.split()[0] for x in ROWS.split(", ")])

    return finish


def _segments(ordered: DataFrame, table: rans.Table, segment: int) -> DataFrame:
    """Coded segments of rows in order; a row is split where a segment is full."""
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        runs, parts, size, first = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            row = [shard, first, *[list(x) for x in zip(*runs)], rans.encode(np.concatenate(parts), table)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for b in batches:
            for doc_id, wide, data in zip(b.column("doc_id").to_pylist(), b.column("wide").to_pylist(), b.column("ids").to_pylist()):
                ids, at = np.frombuffer(_common.unsqueezed(data), "<u4" if wide else "<u2").astype(np.uint32), 0
                while at < len(ids):
                    part = ids[at : at + segment - size]
                    runs.append((doc_id, at, len(part)))
                    parts.append(part)
                    size += len(part)
                    at += len(part)
                    if size == segment:
                        yield flush()
                        runs, parts, size, first = [], [], 0, first + segment
        if size:
            yield flush()

    return ordered.select("doc_id", "wide", "ids").mapInArrow(run, SEGMENTS)


def write_token_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Write the ids of ``docs`` (doc_id, text) below path, in ascending doc_id order, end id after each.

    Texts stay where they lie; their ids, 16 bits each, are what is sorted. Null and empty
    texts are the end id alone; rows with equal doc_id stay apart, in the order of their texts' first
    PREFIX characters (null first), then of their compressed ids; a null doc_id comes first; an empty table makes
    empty tables; further columns are ignored.
    """
    spark = docs.sparkSession
    _common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.substring("text", 1, PREFIX).alias("head"), "text")
    cuts = _common.cuts(docs, "doc_id")
    rows, counts = wordpieces.tokenised(docs, tokenizer, end_id, _rows(cuts), ROWS, histogram=True)
    counts.write.parquet(f"{path}/table")
    ordered = rows.repartitionById(len(cuts) + 2, "range").sortWithinPartitions("doc_id", "head", "ids")
    _segments(ordered, _table(spark, path), segment).write.option("compression", "none").parquet(f"{path}/segments")
    _common.delete(rows)
    _common.delete(counts)
    spread = spark.read.parquet(f"{path}/segments").groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One row per shard, that is per written partition.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spread.select("shard", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/shards")


def _table(spark: SparkSession, path: str) -> rans.Table:
    """The shared table; its rows number at most the vocabulary."""
    rows = spark.read.parquet(f"{path}/table").toPandas().sort_values("id")
    return rans.Table.from_counts(rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def _decoded(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    _common.ship(spark)
    table = _table(spark, path)
    shards = spark.read.parquet(f"{path}/shards").toPandas()  # a row per written partition
    bases = dict(zip(shards["shard"].tolist(), shards["base"].tolist()))
    kind = pa.int64() if digest else pa.binary()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                ids = rans.decode(r["blocks"], table)
                cuts = np.concatenate([[0], np.cumsum(r["lengths"])])
                own = [ids[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
                begins = np.array(r["doc_starts"], np.int64)
                starts = bases[r["shard"]] + r["first"] + cuts[:-1] - begins
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(begins), pa.array(r["lengths"], pa.int64()), pa.array([zlib.crc32(x) for x in own] if digest else own, kind)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "at", "length", "ids"])

    return spark.read.parquet(f"{path}/segments").mapInArrow(decode, f"doc_id long, start long, at long, length long, ids {'long' if digest else 'binary'}")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The runs of documents in the files: doc_id, start (ids before the document), at (ids of the
    document before the run), length, ids (little-endian unsigned 32-bit).

    A document is one run, or several where it crosses segments; every checksum is tested.
    """
    return _decoded(spark, path, digest=False)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for runs in b.column("runs").to_pylist():
                crc = runs[0]["ids"]
                for r in runs[1:]:
                    crc = _common.crc32_combine(crc, r["ids"], 4 * r["length"])
                out.append(crc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    runs = _decoded(spark, path, digest=True)
    # A group is one document: a run for each million of its ids.
    whole = runs.groupBy("doc_id", "start").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "length", "ids"))).alias("runs"))
    return whole.mapInArrow(join_up, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = _common.work_dir(spark, "token_ids")
    write_token_ids(_common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return digests(spark, path)


QUERIES = {"op1_token_ids": op1_token_ids}
