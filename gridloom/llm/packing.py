"""Packing of documents into sequences by cutting-stock column generation.

Each document is cut into full sequences and one rest. Rests fall into length classes; a linear
program over the class histogram, its columns (patterns) priced by a knapsack dynamic program,
says how often to use which pattern; rounded-down patterns plus first-fit-decreasing ones for what
rounding leaves are numbered, and the r-th document of a class takes the r-th place that the
patterns have for it. The driver sees the histogram (at most ``capacity / grid`` numbers) and the
patterns, never documents; ranks come from counts per written partition, not from one sort.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common, wordpieces

CAPACITY, GRID, END_ID = 2048, 8, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, nth long"


def solve_patterns(demand: np.ndarray, gap: float = 1e-4, rounds: int = 20_000) -> list[tuple[dict[int, int], int]]:
    """(class -> copies, times) so that every class c has at least demand[c - 1] places of size c.

    Classes are sizes 1 .. len(demand) in units; a sequence holds len(demand) units. The master
    problem is solved by the revised simplex method until Farley's bound is within ``gap``.
    """
    units = len(demand)
    sizes = np.flatnonzero(demand > 0) + 1
    if not len(sizes):
        return []
    need = demand[sizes - 1].astype(float)
    m = len(sizes)
    columns = np.zeros((m, m))
    np.fill_diagonal(columns, units // sizes)
    inverse, x = np.diag(1.0 / (units // sizes)), need / (units // sizes)
    basis = [columns[:, i].copy() for i in range(m)]
    for _ in range(rounds):
        price = inverse.sum(axis=0)  # every pattern costs one sequence
        pattern, worth = _knapsack(sizes, np.maximum(price, 0), units)
        if worth <= 1 + 1e-9 or x.sum() / max(price @ need, 1e-12) < 0 or 1 - 1 / worth <= gap:
            break
        step = inverse @ pattern
        grows = step > 1e-9
        if not grows.any():
            break
        ratio = np.full(m, np.inf)
        ratio[grows] = x[grows] / step[grows]
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        inverse[out] /= step[out]
        others = step.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
        basis[out] = pattern.copy()
    left, found = Counter({int(c): int(demand[c - 1]) for c in sizes}), []
    for column, value in zip(basis, x):
        made = {int(sizes[i]): int(column[i]) for i in np.flatnonzero(column > 0)}
        times = min([int(value + 1e-9), *(left[c] // k for c, k in made.items())]) if made else 0
        if times > 0:
            found.append((made, times))
            for c, k in made.items():
                left[c] -= k * times
    return found + _first_fit(left, units)


def _knapsack(sizes: np.ndarray, price: np.ndarray, units: int) -> tuple[np.ndarray, float]:
    """The pattern of greatest price among those that fit, by dynamic programming over capacity."""
    best, taken = np.zeros(units + 1), np.full(units + 1, -1)
    for w in range(1, units + 1):
        n = np.searchsorted(sizes, w, "right")
        best[w] = best[w - 1]
        if n:
            total = best[w - sizes[:n]] + price[:n]
            k = int(np.argmax(total))
            if total[k] > best[w] + 1e-12:
                best[w], taken[w] = total[k], k
    pattern, w = np.zeros(len(sizes)), units
    while w > 0:
        if taken[w] < 0:
            w -= 1
        else:
            pattern[taken[w]] += 1
            w -= sizes[taken[w]]
    return pattern, float(best[units])


def _first_fit(left: Counter, units: int) -> list[tuple[dict[int, int], int]]:
    """Sequences for the few pieces that rounding leaves, the largest first."""
    rows: list[list[int]] = []
    room: list[int] = []
    for c in sorted((c for c, n in left.items() for _ in range(n)), reverse=True):
        at = next((i for i, r in enumerate(room) if r >= c), -1)
        if at < 0:
            rows.append([c])
            room.append(units - c)
        else:
            rows[at].append(c)
            room[at] -= c
    return [(dict(Counter(r)), 1) for r in rows]


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grid: int = GRID, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document, with class, writing partition and number there in the class."""
    fields = [x.split() for x in PIECES.split(", ")]
    kinds, names = [pa.int32() if k == "int" else pa.int64() for _, k in fields], [f for f, _ in fields]

    seen: dict[int, np.ndarray] = {}  # by partition; a task has its own copy, so one Python worker numbers what it makes

    def finish(doc_ids: pa.Array, _: None, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        lengths = np.diff(np.concatenate([[0], ends]))
        n = -(-lengths // capacity)
        row = np.repeat(np.arange(len(ends)), n)
        start = (np.arange(len(row)) - (np.cumsum(n) - n)[row]) * capacity
        own = np.minimum(lengths[row] - start, capacity)
        data, begin = memoryview(ids.astype("<u4").tobytes()), 4 * ((ends - lengths)[row] + start)
        crcs = [zlib.crc32(data[x:y]) for x, y in zip(begin.tolist(), (begin + 4 * own).tolist())]
        part, size = TaskContext.get().partitionId(), -(-own // grid)
        before = seen.setdefault(part, np.zeros(capacity // grid + 1, np.int64))
        order = np.argsort(size, kind="stable")
        found, first, times = np.unique(size[order], return_index=True, return_counts=True)
        nth = np.empty(len(size), np.int64)
        nth[order] = np.arange(len(size)) - np.repeat(first, times) + np.repeat(before[found], times)
        before[found] += times
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), *[pa.array(x, k) for x, k in zip((start, own, crcs, lengths[row], size, np.full(len(size), part), nth), kinds[1:])]], names)

    pieces, _ = wordpieces.tokenised(docs.select(F.col("doc_id").cast("long"), "text"), tokenizer, end_id, finish, PIECES)
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grid: int = GRID, end_id: int = END_ID) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): where it begins in its document and sequence.

    Null and empty texts are the end id alone. Rows with equal doc_id are documents of their own;
    an empty table gives an empty one; further columns are ignored; a null doc_id is kept.
    """
    if capacity % grid:
        raise ValueError("grid must divide capacity")
    spark = docs.sparkSession
    _common.ship(spark)
    pieces = _common.written(cut(docs, tokenizer, capacity, grid, end_id), "pieces")
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    demand = np.zeros(capacity // grid, np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most capacity / grid rows
        demand[r["class"] - 1] = r["n"]
    places, sequence, used = [], 0, Counter()
    for pattern, times in solve_patterns(demand):
        order = 0
        for c in sorted(pattern, reverse=True):
            places.append((c, used[c], used[c] + pattern[c] * times, pattern[c], sequence, order))
            used[c] += pattern[c] * times
            order += pattern[c]
        sequence += times
    slots = spark.createDataFrame(places, "class int, lo long, hi long, copies long, base long, first long")
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead, ["class", "part"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    # The places number at most a few per class and pattern whatever the corpus: a bounded broadcast.
    nth = F.col("rank") - F.col("lo")
    placed = ranked.join(F.broadcast(slots), "class").where("rank >= lo and rank < hi").withColumns({"sequence_id": (F.col("base") + F.floor(nth / F.col("copies"))).cast("long"), "slot": F.col("first") + nth % F.col("copies")})
    row = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(row), F.lit(0)).cast("long").alias("offset"))


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (doc_id must be unique and not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = wordpieces.load(tokenizer)
        for b in batches:
            ids = [np.append(np.frombuffer(pieces.encode(t), "<u4"), end_id).astype("i4") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    encoded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")
    own = packed.join(encoded, "doc_id").select("sequence_id", F.struct("offset", F.slice("ids", F.col("start") + 1, F.col("length")).alias("ids")).alias("piece"))
    return own.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["ids"])).alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_packing": op2_packing}
