"""What the operators of this subpackage share: tables, the shared work folder, shipping, row hashes."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[2]
_PACKAGE = Path(__file__).resolve().parents[1].name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus table with the columns that operators read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables, below the folder that ``spark.checkpoint.dir`` names.

    All executors share that folder, so a lost executor loses none of it. Only where the setting
    is absent (tests, one machine) a temporary folder is chosen, once a session.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix=f"{_PACKAGE}-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def checkpoint_ready(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable: the session's setting first, a temporary folder else."""
    if not spark.sparkContext.getCheckpointDir():
        work_dir(spark, "x")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def written(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there."""
    path = work_dir(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def squeezed(data: bytes) -> bytes:
    """Compressed, after four bytes that say how long it was."""
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def cuts(df: DataFrame, column: str) -> np.ndarray:
    """Ascending values that part a long column into about as many ranges as shuffles have partitions."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = df.select(column).where(F.col(column).isNotNull())
    return np.unique(np.array(known.approxQuantile(column, [k / n for k in range(1, n)], 0.1 / n) if n > 1 else [], np.int64))


def delete(table: DataFrame, part: str = "") -> None:
    """Drop a written table that nothing reads any more, or the folder of one partition of it."""
    sc = table.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if folder.endswith(part):
            where = sc._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished jobs go now: they stay until the driver collects its garbage."""
    spark.range(1).count()  # the scheduler holds on to the last job until it has another
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where neither PYTHONPATH nor the working folder do."""
    root = str(_ROOT)
    if root in os.environ.get("PYTHONPATH", "").split(":") or os.getcwd() == root:
        return
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    file = Path(tempfile.mkdtemp()) / f"{_PACKAGE}_src.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in (_ROOT / _PACKAGE).rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(file))  # the driver serves it to every executor, also to later ones
    sc._llm_shipped = True


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def crc32_combine(a: int, b: int, b_bytes: int) -> int:
    """crc32 of x + y from a = crc32(x), b = crc32(y) and y's length (squaring of the zero-byte operator)."""
    if b_bytes <= 0:
        return a

    def times(m: list[int], v: int) -> int:
        s = 0
        for row in m:
            if not v:
                break
            if v & 1:
                s ^= row
            v >>= 1
        return s

    odd = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    even = [times(odd, x) for x in odd]
    odd = [times(even, x) for x in even]
    while b_bytes:
        even = [times(odd, x) for x in odd]
        if b_bytes & 1:
            a = times(even, a)
        b_bytes >>= 1
        odd, even = even, odd
    return a ^ b


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
