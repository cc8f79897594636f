"""Streams: additive merges of atomic facts, and windowed sums with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cube


def atomic_stream(facts: DataFrame, hierarchy: DataFrame, dims: list[str]) -> DataFrame:
    """Running atomic facts of a stream of facts under a fixed hierarchy: one stateful sum (update or
    complete mode). The per-dimension maps are stream-static joins; sums between them would each
    need state, so here the signs multiply first."""
    for d in cube.deep_dimensions(hierarchy):
        m = cube.self_and_parent(hierarchy, d)
        facts = facts.join(m, facts[d] == m["prior"]).select(*[F.col("member").alias(d) if c == d else F.col(c) for c in dims], (F.col("value") * F.col("sign")).alias("value"))
    return facts.groupBy(*dims).agg(F.sum("value").alias("value"))


def merge_stream(facts: DataFrame, hierarchy: DataFrame, dims: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's atoms merged into a Parquet table of versions; a batch that runs again writes
    its own version again, so nothing counts twice. The two latest versions stay."""
    spark = facts.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        own = cube.atomic(batch, hierarchy, dims, tolerance=0.0)
        if number:
            own = cube.merge_atomic(spark.read.parquet(f"{path}/version={number - 1}"), own, dims)
        own.write.mode("overwrite").parquet(f"{path}/version={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return facts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_sums(events: DataFrame, time: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Sums and counts per (sliding) window and key; later rows than ``late`` go."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide) if slide else F.window(time, width), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "total", "n")


def sessions(events: DataFrame, time: str, keys: list[str], value: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sums and counts per session: rows of a key closer than ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), *keys, "total", "n")
