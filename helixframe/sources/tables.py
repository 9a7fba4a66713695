"""Sequences derived from the prose tables: documents are references, benchmark texts reads."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import codes, sequence as sq
from helixframe.sources.shared import ship, written


def derived(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq: sq.derived(text) by a table of bytes, which takes a small part of the time of its regular expression."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            for i, j, data, offsets in codes.chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), codes.strings(*codes.derived(data, offsets))], ["key", "seq"])

    got = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return got.mapInArrow(run, f"key {got.schema['key'].dataType.simpleString()}, seq string")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return derived(docs, "doc_id", "text").withColumnRenamed("key", "seq_id")


def stored_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """references() dealt over tasks and stored. A table may be one file of one row group, which one task reads whatever its size;
    kernels over whole sequences would then run in that task alone, and each step would derive the sequences again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text")
    many = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("doc_id", F.length("text")))
    return written(derived(many, "doc_id", "text").withColumnRenamed("key", "seq_id"), "refs")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text is not null")
    return derived(items, "item_id", "text").withColumnRenamed("key", "rid")


def strands(reads_of: DataFrame) -> DataFrame:
    """rid, rc, seq: each read and its reverse complement."""
    return reads_of.select("rid", F.posexplode(F.array("seq", sq.reverse_complement(F.col("seq")))).alias("rc", "seq"))
