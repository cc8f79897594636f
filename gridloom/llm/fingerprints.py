"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, for two primes, the sums of c[j] * B**j of a text's code points up to each
position. The hash of any span is a difference scaled by an inverse power, so spans compare in
constant time and a longest common extension is found by binary search. A fingerprint is the hash
of the whole span and the smallest hashes of all windows of WINDOW code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common

PRIMES = (2147483647, 2147483629)
BASES = (1_103_515_245, 1_664_525)
WINDOW, SHORT, KEPT = 24, 4, 64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**j and B**-j of prime k for j up to n or more, doubled as needed."""
    up, down = _powers.get(k, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    p = np.uint64(PRIMES[k])
    while len(up) <= n:
        m = len(up)
        step, back = pow(BASES[k], m, PRIMES[k]), pow(pow(BASES[k], m, PRIMES[k]), -1, PRIMES[k])
        up = np.concatenate([up, up * np.uint64(step) % p])
        down = np.concatenate([down, down * np.uint64(back) % p])
    _powers[k] = up, down
    return up, down


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Prefixes:
    """Span hashes of one text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums, self.back = [], []
        for k, p in enumerate(PRIMES):
            up, down = _tables(k, self.n + 1)
            terms = (points + np.uint64(1)) * up[: self.n] % np.uint64(p)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(p)]))  # sums stay below 2 ** 64 up to 2 ** 32 code points
            self.back.append(down)

    def span(self, begin, end) -> np.ndarray:
        """62-bit hashes of the spans begin .. end (numbers or arrays)."""
        begin, end = np.asarray(begin), np.asarray(end)
        out = np.zeros(np.broadcast(begin, end).shape, np.uint64)
        for k, p in enumerate(PRIMES):
            p = np.uint64(p)
            d = (self.sums[k][end] + p - self.sums[k][begin]) % p * self.back[k][begin] % p
            out = (out << np.uint64(31)) | d
        return out

    def single(self, begin: int, end: int) -> tuple[int, ...]:
        """The hash of one span, a number for each prime."""
        return tuple((int(s[end]) - int(s[begin])) * int(back[begin]) % p for s, back, p in zip(self.sums, self.back, PRIMES))

    def windows(self, width: int) -> np.ndarray:
        """The hashes of all spans of that width, in order: one where the text is shorter."""
        if self.n <= width:
            return self.span(np.array([0]), np.array([self.n]))
        out = np.zeros(self.n - width + 1, np.uint64)
        for k, p in enumerate(PRIMES):
            p, s = np.uint64(p), self.sums[k]
            out = (out << np.uint64(31)) | ((s[width:] + p - s[:-width]) % p * self.back[k][: len(out)] % p)
        return out


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How many code points of a from i and of b from j agree: the last equal span, by binary search."""
    most = min(a.n - i, b.n - j)
    low = 0
    while low < most:
        m = (low + most + 1) // 2
        if a.single(i, i + m) == b.single(j, j + m):
            low = m
        else:
            most = m - 1
    return low


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(32)


def sketch(prefixes: Prefixes, width: int = WINDOW, kept: int = KEPT) -> tuple[int, np.ndarray]:
    """(hash of the whole, up to ``kept`` smallest mixed hashes of windows, ascending and distinct)."""
    mixed = _mixed(prefixes.windows(width))
    if prefixes.n < 4 * width:  # a short text has few such windows
        mixed = np.concatenate([mixed, _mixed(prefixes.windows(SHORT))])
    m = 4 * kept
    small = mixed
    while len(mixed) > m:
        small = np.unique(np.partition(mixed, m)[: m + 1])
        if len(small) >= kept:
            break
        small, m = mixed, 8 * m  # many repeats: look at more
    return int(prefixes.span(0, prefixes.n)), np.unique(small)[:kept]


def as_text(whole: int, small: np.ndarray) -> str:
    return f"{whole:016x}" + small.astype(">u4").tobytes().hex()


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], kept: int = KEPT) -> float:
    """The share of common windows, estimated from the smallest of both; 1 for equal wholes."""
    if a[0] == b[0] and len(a[1]) == len(b[1]) and (a[1] == b[1]).all():
        return 1.0
    both = np.union1d(a[1], b[1])[:kept]
    common = np.intersect1d(a[1], b[1], assume_unique=True)
    return float(np.isin(both, common, assume_unique=True).sum() / max(1, len(both)))


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """docs (doc_id, text) in descending doc_id order within ranges; each range ends with the row
    that follows it (own = false). One shuffle of texts; the driver sees one doc_id a range."""
    spark = docs.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    known = docs.select("doc_id").where("doc_id is not null")
    cuts = np.unique(np.array(known.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else [], np.int64))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(cuts, ids.fillna(0).astype("int64"), "left")), dtype="int32")

    placed = docs.withColumn("range", place("doc_id"))
    tops = {r["range"]: r["top"] for r in docs.select("doc_id").withColumn("range", place("doc_id")).groupBy("range").agg(F.max("doc_id").alias("top")).collect()}  # a row a range
    order = sorted(tops, reverse=True)
    if not order:
        return placed.select("range", F.lit(True).alias("own"), "doc_id", "text")
    after = {order[k]: order[k - 1] for k in range(len(order))}  # the range that this one follows; the first follows the last

    @F.pandas_udf("int")
    def leads(ranges: pd.Series, ids: pd.Series, texts: pd.Series) -> pd.Series:
        """The range that needs this row as its end: rows of a range's highest doc_id only, of null ids those of the first text."""
        return pd.Series([after[r] if (tops[r] is None and t == first_text) or i == tops[r] else None for r, i, t in zip(ranges, ids, texts)], dtype="Int32")

    texts = F.coalesce(F.xxhash64("text"), F.lit(0))
    first_text = docs.where("doc_id is null").agg(F.min_by(texts, F.struct(F.col("text").isNotNull(), "text"))).first()[0]
    halo = leads("range", "doc_id", texts)
    spread = placed.withColumn("halo", halo).select(F.explode(F.when(F.col("halo").isNull(), F.array(F.struct("range", F.lit(True).alias("own")))).otherwise(F.array(F.struct("range", F.lit(True).alias("own")), F.struct(F.col("halo").alias("range"), F.lit(False).alias("own"))))).alias("at"), "doc_id", "text")
    return spread.select("at.range", "at.own", "doc_id", "text").repartitionById(n + 1, F.col("range") + 1).sortWithinPartitions("range", F.desc("own"), F.desc_nulls_last("doc_id"), "text")


def fingerprint_documents(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of each text and of the text whose last third gives way to the next text's start.

    near_*: the share of common windows, estimated; prefix_*: how many code points agree from the
    start, exactly, by the longest common extension. The next document is that of the next lower doc_id (after the lowest: the highest). Null texts
    count as empty; rows of equal doc_id follow in the order of their texts; null doc_ids come
    last; a lone row follows itself; an empty table gives an empty one; further columns are ignored.
    """
    _common.ship(docs.sparkSession)
    names = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_edited long, prefix_next long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, over = None, False  # the row whose successor comes next; whether its range has had it
        for b in batches:
            rows = []
            for place, own, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("range", "own", "doc_id", "text"))):
                if before is not None and before[0] == place and over:
                    continue  # a further row of the following range
                text = text or ""
                prefixes = Prefixes(code_points(text))
                mark = sketch(prefixes)
                if before is not None and before[0] == place:
                    rows.append(_row(before[1:], text, prefixes, mark))
                over = not own
                before = (place, doc_id, text, prefixes, mark)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], [x.split()[0] for x in names.split(", ")])

    return with_next(docs.select("doc_id", "text"), partitions).mapInArrow(run, names)


def _row(own: tuple, next_text: str, next_prefixes: Prefixes, next_mark: tuple) -> tuple:
    doc_id, text, prefixes, mark = own
    n = len(text)
    edited = text[: n - n // 3] + next_text[: n // 3]
    others = Prefixes(code_points(edited)) if edited != text else prefixes
    other = sketch(others) if edited != text else mark
    shared = common_extension(prefixes, 0, others, 0), common_extension(prefixes, 0, next_prefixes, 0)
    return (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), as_text(*mark), as_text(*other), likeness(mark, other), likeness(mark, next_mark), *shared)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_common.documents(spark, sf_dir))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the operator's rows: lengths, edited texts and what agrees with the next text."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256", "prefix_next")


QUERIES = {"op10_fingerprints": op10_fingerprints, "edited_texts": edited_texts}

ORACLES = {
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next FROM d WINDOW w AS (ORDER BY doc_id DESC))
 SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 3) || left(next, n // 3)) AS edited_sha256,
 coalesce(len(list_filter(range(1, least(n, length(next)) + 1), lambda k: left(t, k) = left(next, k))), 0) AS prefix_next FROM n"""
}
