"""From votes to rows: mapping quality per batch, lookup of the sequence that holds a position, SAM rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import sequence as sq
from helixframe.params import AlignParams

#: Sequences whose lengths are added up by one task, and letters of a lookup bin.
RUN, BIN = 4096, 1 << 16


def offsets(seqs: DataFrame) -> DataFrame:
    """seq_id, len, offset: where each sequence begins if all follow one another by id. Sums of runs of ids come first, so that
    only one row a run meets in one task."""
    sized = seqs.select("seq_id", F.length("seq").cast("long").alias("len"), F.floor(F.col("seq_id") / RUN).alias("run"))
    runs = sized.groupBy("run").agg(F.sum("len").alias("n"))
    before = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("before"))
    inside = F.sum("len").over(Window.partitionBy("run").orderBy("seq_id")) - F.col("len")
    return sized.withColumn("inside", inside).join(before, "run").select("seq_id", "len", (F.col("before") + F.col("inside")).alias("offset"))


def lookup(points: DataFrame, placed: DataFrame, at: str = "ref_start") -> DataFrame:
    """points with seq_id, offset of the last sequence that begins at or before the position; an equi-join over bins."""
    end = F.col("offset") + F.greatest(F.col("len"), F.lit(1)) - 1
    bins = placed.where("len > 0").withColumn("bin", F.explode(F.sequence(F.floor(F.col("offset") / BIN), F.floor(end / BIN))))
    inside = F.col(at).between(F.col("offset"), end)
    return points.withColumn("bin", F.floor(F.col(at) / BIN)).join(bins.select("bin", "seq_id", "offset", "len"), "bin").where(inside).drop("bin", "len")


def mapped(best: DataFrame, p: AlignParams) -> DataFrame:
    """best with batch, mapq: scaled by the whole-number mean of the batch's votes, cut to whole numbers twice, not capped."""
    batched = best.withColumn("batch", F.floor(F.col("rid") / p.batch))
    mean = batched.where("votes > 0").groupBy("batch").agg(F.floor(F.sum("votes") / F.count(F.lit(1))).alias("mean"))
    share = F.floor(p.scale * (F.col("votes") - F.col("second_votes")) / F.col("votes"))
    quality = F.floor(share * F.col("votes") / F.col("mean")).cast("long")
    good = (F.col("votes") > F.col("second_votes")) & (F.col("votes") > p.cutoff)
    return batched.join(mean, "batch", "left").withColumn("mapq", F.when(good, quality).otherwise(F.lit(0).cast("long"))).drop("mean")


def sam(best: DataFrame, reads: DataFrame, placed: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The eleven fields. reads: rid, name, seq, qual. Unmapped reads have position 0; a reversed read's letters are turned, its
    qualities aren't."""
    found = lookup(best.where("ref_start > 0"), placed)
    found = found.withColumn("rname", F.col("seq_id").cast("string")) if names is None else found.join(names, "seq_id").withColumnRenamed("name", "rname")
    hit = found.select("rid", "rc", "rname", (F.col("ref_start") - F.col("offset") + 1).alias("pos"), "mapq")
    both = reads.join(hit, "rid", "left")
    none, lost = F.lit("*"), F.col("pos").isNull()
    return both.select(
        F.col("name").alias("qname"), F.when(lost, 4).when(F.col("rc") == 1, 16).otherwise(0).alias("flag"), F.coalesce("rname", none).alias("rname"),
        F.coalesce("pos", F.lit(0).cast("long")).alias("pos"), F.coalesce("mapq", F.lit(0).cast("long")).alias("mapq"),
        F.when(lost, "*").otherwise(F.concat(F.length("seq"), F.lit("M"))).alias("cigar"), none.alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"),
        F.when(F.col("rc") == 1, sq.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.coalesce("qual", none).alias("qual"))


def evaluated(best: DataFrame, truth: DataFrame, tolerance: int = 20) -> DataFrame:
    """One row: reads, mapped, right within the tolerance, and the same for mapping quality of at least 10 and 30."""
    both = truth.join(best, "rid", "left").withColumn("right", F.coalesce(F.abs(F.col("ref_start") - F.col("true_start")) <= tolerance, F.lit(False)))
    counts = [F.count_if(F.col("mapq") >= q).alias(f"q{q}") for q in (10, 30)] + [F.count_if((F.col("mapq") >= q) & F.col("right")).alias(f"q{q}_right") for q in (10, 30)]
    return both.agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("ref_start") > 0).alias("mapped"), F.count_if("right").alias("correct"), *counts)
