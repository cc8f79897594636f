"""The corpus pipeline: toxic documents go, then those of no known language, then near duplicates;
what stays is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``. Null and empty texts are clean of toxicity, but have no
language and go there; rows of one doc_id are one document, and stay or go together as near
duplicates; empty tables stay empty; further columns of ``docs`` pass through the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import _common, language, packing, simhash, toxicity

#: Least confidence in the language of a document that stays.
CONFIDENCE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; learned from four fifths of the labels."""
    may_learn = _common.id_remainder(F.col("doc_id"), 5) != 0
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), may_learn)
    return docs.where(model.udf()("text") < 0.5)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and whose most likely language is at least CONFIDENCE sure."""
    may_learn = _common.id_remainder(F.col("doc_id"), 4) != 2
    model = language.fit(docs, F.col("lang"), may_learn)
    return docs.where(model.udf()("text")["score"] >= CONFIDENCE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component of linked fingerprints."""
    found = simhash.near_duplicates(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_known_languages), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: The stages learn models; no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
