"""Lookups in reference tables: every row of the left side stays once.

A reference is reduced to unique keys first. Where a check of its rows and bytes shows that it is
small, it is broadcast; an ordered lookup then joins on a searched part of the key's range, so that
few spans are compared with a row. Beyond that an exact lookup is a shuffled equi-join, and an ordered one
sorts both sides together within key ranges. Both ways compare keys in the same type and give the
same rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
PER_RANGE = 64  #: sampled keys for each range of a large ordered lookup
FAN = 63  #: points that one step of a search by generated code compares


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most that many rows and, as text, bytes; it stops counting at the row bound."""
    size = [F.coalesce(F.octet_length(_col(c).cast("string")), F.lit(0)) for c, t in df.dtypes if t.partition("<")[0] not in ("array", "map", "struct")]
    total = sum(size, F.lit(8 * len(df.columns)).cast("long"))
    n, b = df.limit(rows + 1).agg(F.count("*"), F.sum(total)).first()
    return n <= rows and (b or 0) <= most


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Column names that df doesn't have."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def _type(df: DataFrame, value: Column) -> str:
    return df.select(value.alias("x")).dtypes[0][1]


def _common_type(df: DataFrame, value: Column, reference: DataFrame, key: str) -> str:
    """The type in which values and keys are compared."""
    a, b = _type(df, value), _type(reference, _col(key))
    return a if a == b else df.sparkSession.range(0).select(F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b)).alias("x")).dtypes[0][1]


def exact_lookup(df: DataFrame, value: Column, reference: DataFrame, key: str, result: str, out: str, default: object = None, position: str | None = None, ignore_case: bool = False, small: bool | None = None) -> DataFrame:
    """df with column ``out``: the result of the first reference row (by position, else by result) whose key equals value, else default.

    A null value has the default; null keys count for nothing; a column of that name is replaced.
    """
    fold = F.lower if ignore_case else lambda c: c
    order = _col(position) if position else _col(result)
    k, r, hit, v = _fresh(df.columns, "key", "result", "hit", "value")
    unique = reference.select(fold(_col(key)).alias(k), _col(result).alias(r), order.alias("at")).where(_col(k).isNotNull()).groupBy(k).agg(F.min_by(r, "at").alias(r), F.lit(True).alias(hit))
    if is_small(reference.select(key, result)) if small is None else small:
        unique = F.broadcast(unique)
    joined = df.withColumn(v, fold(value)).join(unique, F.col(v) == F.col(k), "left")
    kept = [_col(c) for c in df.columns if c != out]
    return joined.select(*kept, F.when(F.col(hit), F.col(r)).otherwise(F.lit(default)).alias(out))


def _searched(value: Column, points: list[Column]) -> Column:
    """How many of the ascending points are at most value, by halving; a null point counts as beyond every value."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= points[middle], within(middle + 1, high)).otherwise(within(low, middle))

    return within(0, len(points))


def _numbered(df: DataFrame, value: str, points: list, kind: str, out: str) -> DataFrame:
    """df with the number of points (ascending, at most FAN ** 2) that are at most column ``value``; 0 for null.

    Compared in the points' own type, by generated code; more than FAN points are searched in a
    second step, in a broadcast row of FAN points.
    """
    typed = lambda x: F.lit(x).cast(kind)
    if len(points) <= FAN:
        return df.withColumn(out, _searched(_col(value), [typed(p) for p in points]))
    groups = [points[i : i + FAN] for i in range(0, len(points), FAN)]
    group, first, *names = _fresh([*df.columns, out], "group", "first", *[f"p{i}" for i in range(FAN)])
    rows = [(j, *g, *[None] * (FAN - len(g))) for j, g in enumerate(groups)]
    table = df.sparkSession.createDataFrame(rows, ", ".join([f"{first} int", *[f"{n} {kind}" for n in names]]))
    coarse = df.withColumn(group, _searched(_col(value), [typed(g[0]) for g in groups[1:]]))
    found = coarse.join(F.broadcast(table), F.col(group) == F.col(first))  # at most FAN rows
    return found.select(*[_col(c) for c in df.columns], (F.col(group) * FAN + _searched(_col(value), [F.col(n) for n in names])).alias(out))


def asof_lookup(df: DataFrame, value: Column, reference: DataFrame, key: str, result: str, out: str, default: object = None, below: str = "default", position: str | None = None, small: bool | None = None) -> DataFrame:
    """df with column ``out``: the result at the greatest key that is at most value, else default.

    Of rows with equal keys the last by position (else by result) counts. below="first" gives the
    first key's result to values below it. A null value has the default; a column named ``out`` is replaced.
    """
    kind = _common_type(df, value, reference, key)
    last = _col(position) if position else _col(result)
    unique = reference.select(_col(key).cast(kind).alias("k"), _col(result).alias("r"), last.alias("at")).where("k is not null").groupBy("k").agg(F.max_by("r", "at").alias("r"))
    fallback = F.lit(default)
    if below == "first":
        fallback = F.when(value.isNotNull(), unique.agg(F.min_by("r", "k")).scalar()).otherwise(fallback)
    return _ordered(df, value.cast(kind), unique, out, fallback, "last", is_small(reference.select(key, result)) if small is None else small)


def max_leq(df: DataFrame, value: Column, reference: DataFrame, key: str, result: str, out: str, small: bool | None = None) -> DataFrame:
    """df with the greatest result among reference rows whose key is at most value, else 0 (also for a null value)."""
    kind = _common_type(df, value, reference, key)
    unique = reference.select(_col(key).cast(kind).alias("k"), _col(result).alias("r")).where("k is not null").groupBy("k").agg(F.max("r").alias("r"))
    return _ordered(df, value.cast(kind), unique, out, F.lit(0.0), "max", is_small(reference.select(key, result)) if small is None else small)


def _ordered(df: DataFrame, value: Column, unique: DataFrame, out: str, fallback: Column, how: str, small: bool) -> DataFrame:
    """The last or the greatest result of ``unique`` (k, r) up to each value."""
    if not small:
        return _in_ranges(df, value, unique, out, fallback, how)
    if how == "max":  # checked to be small
        unique = unique.select("k", F.max("r").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("r"))
    v, at, number, low, high, r, hit = _fresh([*df.columns, out], "value", "at", "number", "low", "high", "r", "hit")
    spans = unique.select(F.col("k").alias(low), F.lead("k").over(Window.orderBy("k")).alias(high), F.col("r").alias(r), F.lit(True).alias(hit))
    keys = [x[low] for x in spans.select(low).orderBy(low).collect()]
    points = keys[:: max(1, -(-len(keys) // (FAN * FAN)))]
    kind = dict(unique.dtypes)["k"]
    spans = _numbered(spans, low, points, kind, number)
    # The greatest key up to a value lies in the value's own part, as parts begin with keys; few spans share a part.
    left = _numbered(df.withColumn(v, value), v, points, kind, at)
    joined = left.join(F.broadcast(spans), (F.col(at) == F.col(number)) & (F.col(v) >= F.col(low)) & (F.col(high).isNull() | (F.col(v) < F.col(high))), "left")
    kept = [_col(c) for c in df.columns if c != out]
    return joined.select(*kept, F.when(F.col(hit), F.col(r)).otherwise(fallback).alias(out))


def _ranges(keys: DataFrame, kind: str, n: int) -> tuple[list, list[int]]:
    """(split points, parts of each range) from a bounded sample of ``keys`` (k, left).

    Ranges hold about as many rows of both sides; a range that still is crowded with left rows, as
    by one hot value, has several parts.
    """
    sample = keys.where("k is not null").select("k", "left", F.rand(7).alias("by")).orderBy("by").limit(PER_RANGE * n)
    rows = sample.orderBy("k").collect()
    splits = list(dict.fromkeys(r["k"] for r in rows[PER_RANGE::PER_RANGE]))
    parts, at = [0] * (len(splits) + 1), 0
    for r in rows:
        while at < len(splits) and r["k"] >= splits[at]:
            at += 1
        parts[at] += r["left"]
    return splits, [max(1, -(-p // (2 * PER_RANGE))) for p in parts]


def _in_ranges(df: DataFrame, value: Column, unique: DataFrame, out: str, fallback: Column, how: str) -> DataFrame:
    """Both sides in ranges of the key, each part of a range sorted once; a range begins with what its predecessors end with.

    Left rows of a crowded range are dealt to its parts; its reference rows go to each part.
    """
    spark = df.sparkSession
    n = min(FAN * FAN, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = dict(unique.dtypes)["k"]
    keys = df.select(value.alias("k"), F.lit(1).alias("left")).unionByName(unique.select("k", F.lit(0).alias("left")))
    splits, parts = _ranges(keys, kind, n)
    # Crowded ranges are few: their parts are a short list of cases.
    crowded = [(i, p) for i, p in enumerate(parts) if p > 1]
    parts_of = F.lit(1)
    for i, p in crowded:
        parts_of = F.when(F.col("range") == i, p).otherwise(parts_of)
    left = df.select(F.struct(*[_col(c) for c in df.columns]).alias("row"), value.alias("k"))
    known = _numbered(left.where("k is not null"), "k", splits, kind, "range").withColumn("part", F.floor(F.rand(11) * parts_of).cast("int"))
    placed = _numbered(unique, "k", splits, kind, "range")
    spread = placed.withColumn("part", F.explode(F.sequence(F.lit(0), parts_of - F.lit(1))))
    both = known.select("range", "part", "k", F.lit(1).alias("side"), "row", F.lit(None).cast(dict(unique.dtypes)["r"]).alias("r"), F.lit(False).alias("hit"))
    both = both.unionByName(spread.select("range", "part", "k", F.lit(0).alias("side"), F.lit(None).cast(dict(left.dtypes)["row"]).alias("row"), "r", F.lit(True).alias("hit")))
    upto = Window.partitionBy("range", "part").orderBy("k", "side").rowsBetween(Window.unboundedPreceding, 0)
    hits = F.when(F.col("hit"), F.struct("hit", "r"))  # a result may itself be null
    here = both.withColumn("here", F.last(hits, True).over(upto) if how == "last" else F.when(F.max("hit").over(upto), F.struct(F.lit(True).alias("hit"), F.max("r").over(upto).alias("r"))))
    # One row a range: a bounded table.
    ends = placed.groupBy("range").agg(F.max_by("r", "k").alias("r") if how == "last" else F.max("r").alias("r"))
    filled = spark.range(len(splits) + 1).select(F.col("id").cast("int").alias("range")).join(ends.withColumn("hit", F.lit(True)), "range", "left")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(hits, True).over(before) if how == "last" else F.when(F.max("hit").over(before), F.struct(F.lit(True).alias("hit"), F.max("r").over(before).alias("r")))
    done = here.where("side = 1").join(F.broadcast(filled.select("range", carried.alias("carried"))), "range", "left")
    found = F.coalesce("here", "carried") if how == "last" else F.struct(F.coalesce("here.hit", "carried.hit").alias("hit"), F.greatest("here.r", "carried.r").alias("r"))
    done = done.select("row", F.when(found["hit"], F.struct(found["r"].alias("r"))).alias("found"))
    every = done.unionByName(left.where("k is null").select("row", F.lit(None).cast(dict(done.dtypes)["found"]).alias("found")))
    back = every.select("row.*", F.col("found").alias((hidden := _fresh([*df.columns, out], "found"))[0]))
    kept = [_col(c) for c in df.columns if c != out]
    return back.select(*kept, F.when(F.col(hidden[0]).isNotNull(), F.col(hidden[0])["r"]).otherwise(fallback).alias(out))


def remap(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Column values replaced by their mapping where there is one."""
    (name,) = _fresh(df.columns, "new")
    out = exact_lookup(df, _col(column), mapping, old, new, name)
    return out.select(*[F.coalesce(name, _col(c)).alias(c) if c == column else _col(c) for c in df.columns])
