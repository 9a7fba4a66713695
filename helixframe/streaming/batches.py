"""Reads that arrive as files: each micro-batch is one batch of reads, whose mean scales its mapping qualities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import finalize
from helixframe.params import AlignParams
from helixframe.plans import align
from helixframe.sources import files


def align_stream(spark: SparkSession, refs: DataFrame, folder: str, out: str, checkpoint: str, p: AlignParams, hist: DataFrame | None = None, index: DataFrame | None = None):
    """Starts a query over FASTQ files that come into folder; each batch's SAM rows go to out/batch=N, so that a batch that is run
    again after a failure replaces its own rows."""
    arriving = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", 1).load(folder).select("path", "content")

    def one(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").distinct().collect()]  # at most maxFilesPerTrigger
        for path in paths:
            reads = files.fastq(spark, path)
            found = align.best(refs, reads, p, hist=hist, index=index)
            files.write_sam(finalize.sam(found, reads, finalize.offsets(refs), refs.select("seq_id", F.coalesce("name", F.col("seq_id").cast("string")).alias("name"))), f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
