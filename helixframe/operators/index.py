"""The index of windows: projected sketches in buckets, runs of neighbours compacted; candidate contigs by probing it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import codes, sequence as sq
from helixframe.operators import kmers as km, sketch as sk
from helixframe.params import AlignParams
from helixframe.sources.shared import written


def informative_windows(seqs: DataFrame, p: AlignParams) -> DataFrame:
    """seq_id, pos of the windows that hold enough different bases."""

    def kernel(data, offsets):
        row, pos, at = codes.places(offsets, p.w)
        keep = codes.informative(data, p.w)[at]
        return row[keep], [pos[keep]]

    return km.both(seqs, "seq_id", lambda s: km.local(s, "seq_id", "pos long", kernel), lambda s: slid_informative(s, p))


def slid_informative(seqs: DataFrame, p: AlignParams) -> DataFrame:
    """The same for sequences that no task holds as a whole: counts slide with the window as running sums."""
    base = km.all_kmers(seqs, ["seq_id"], 1)
    order = Window.partitionBy("seq_id", "stretch").orderBy("pos")
    per = sk.STRETCH
    own = F.floor(F.col("pos") / per)
    both = base.withColumn("stretch", F.explode(F.when((F.col("pos") % per < p.w - 1) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    frame = order.rowsBetween(Window.unboundedPreceding, 0)
    run = both.select("seq_id", "stretch", "pos", *[F.sum((F.col("kmer") == b).cast("int")).over(frame).alias(b) for b in "ACGTN"], *[(F.col("kmer") == b).cast("int").alias("is" + b) for b in "ACGTN"])
    last = lambda b: F.lead(b, p.w - 1).over(order) - F.col(b) + F.col("is" + b)
    win = run.select("seq_id", "stretch", "pos", *[last(b).alias("n" + b) for b in "ACGTN"]).where((F.floor(F.col("pos") / per) == F.col("stretch")) & F.col("nA").isNotNull())
    rare = lambda least: sum(((F.col("n" + b) < least).cast("int") for b in "ACGT"), F.lit(0))
    return win.where((F.col("nN") <= p.w // 50) & (rare(1) <= 1) & (rare(5) <= 1)).select("seq_id", "pos")


def compacted(rows: DataFrame, by: str = "proj") -> DataFrame:
    """tbl, bucket, proj, seq_id, pos, len: runs of neighbouring windows with the same projection (or bucket), of which the
    first one's projection is kept."""
    same = ["seq_id", "tbl", by]
    run = F.col("pos") - F.row_number().over(Window.partitionBy(*same).orderBy("pos"))
    grouped = rows.withColumn("run", run).groupBy(*same, "run").agg(F.min(F.struct("pos", "proj", "bucket")).alias("f"), F.count(F.lit(1)).alias("len"))
    return grouped.select("tbl", "f.bucket", "f.proj", "seq_id", "f.pos", "len")


def build(seqs: DataFrame, hist: DataFrame, p: AlignParams, by: str = "proj") -> DataFrame:
    """The index over informative windows with a valid k-mer; a worker that has a whole sequence gives its runs."""
    sent = km.sent_codes(hist, p.max_count, p.k)
    tables, weights = p.projections(), p.projection_coefficients()
    # only coordinates that a table takes
    used = sorted({i for idx in tables for i in idx})
    coefficients = [p.minhash_coefficients()[i] for i in used]
    tables = [[used.index(i) for i in idx] for idx in tables]

    def kernel(data, offsets):
        row, pos, at, least = codes.window_minima(data, offsets, sent.value, p.k, p.w, coefficients)
        if len(at):
            keep = codes.informative(data, p.w)[at]
            row, pos, least = row[keep], pos[keep], [m[keep] for m in least]
        rows, out = [], []
        for t, idx in enumerate(tables):
            proj = sum((codes.low_product(c, least[i]) for c, i in zip(weights, idx, strict=True)), np.zeros(len(pos), np.int64)) & sq.LOW32
            bucket = proj >> (32 - p.buckets_pow2)
            same = proj if by == "proj" else bucket
            new = np.ones(len(pos), bool)
            new[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | (same[1:] != same[:-1])
            f = np.flatnonzero(new)
            rows.append(row[f])
            out.append([np.full(len(f), t, np.int32), bucket[f].astype(np.int32), proj[f], pos[f], np.diff(np.append(f, len(pos)))])
        return np.concatenate(rows), [np.concatenate(c) for c in zip(*out, strict=True)]

    def slid(s: DataFrame) -> DataFrame:
        sketches = sk.slid_sketches(s, hist, p).join(slid_informative(s, p), ["seq_id", "pos"], "left_semi")
        return compacted(sk.projected(sketches, ["seq_id", "pos"], p), by)

    if sent is None:
        return slid(seqs)
    near = lambda s: km.local(s, "seq_id", "tbl int, bucket int, proj long, pos long, len long", kernel).select("tbl", "bucket", "proj", "seq_id", "pos", "len")
    return km.both(seqs, "seq_id", near, slid)


def bucket_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("tbl", "bucket").agg(F.count(F.lit(1)).alias("size"), F.floor(F.sum("len") / F.count(F.lit(1))).cast("long").alias("avg_len"))


def probe(reads: DataFrame, index: DataFrame, p: AlignParams) -> DataFrame:
    """rid, rc, tbl, seq_id, pos, len: entries with a read's projection; buckets over the cap give nothing. Only buckets that a
    read asks for are counted."""
    asked = written(sk.projected(reads, ["rid", "rc"], p, "sig"), "asked")
    near = index.join(asked.select("tbl", "bucket").distinct(), ["tbl", "bucket"], "left_semi")
    fits = near.groupBy("tbl", "bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= p.bucket_cap).select("tbl", "bucket")
    hits = index.join(asked, ["tbl", "bucket", "proj"])
    return hits.join(fits, ["tbl", "bucket"], "left_semi").select("rid", "rc", "tbl", "seq_id", "pos", "len")


def islands(hits: DataFrame) -> DataFrame:
    """rid, rc, seq_id, start, len, hits: overlapping entries are one contig, which starts one behind the first entry and
    is one shorter than their span; hits counts distinct tables."""
    order = Window.partitionBy("rid", "rc", "seq_id").orderBy("pos", "len", "tbl")
    last = F.max(F.col("pos") + F.col("len") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = hits.withColumn("new", (last.isNull() | (F.col("pos") > last)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = fresh.groupBy("rid", "rc", "seq_id", "island").agg(F.min("pos").alias("a"), F.max(F.col("pos") + F.col("len") - 1).alias("b"), F.countDistinct("tbl").alias("hits"))
    return found.select("rid", "rc", "seq_id", (F.col("a") + 1).alias("start"), (F.col("b") - F.col("a")).alias("len"), "hits")


def filtered(contigs: DataFrame, lengths: DataFrame, p: AlignParams) -> DataFrame:
    """Contigs near the read's best in hits, padded by 50 and the read's length; valid unless too many and weak."""
    able = contigs.where((F.col("len") <= p.contig_cap) & (F.col("hits") >= p.min_hits))
    read = Window.partitionBy("rid")
    near = able.withColumn("best", F.max("hits").over(read)).where(F.col("hits") >= F.col("best") - p.best_dist).withColumn("n", F.count(F.lit(1)).over(read))
    padded = near.join(lengths, "rid").withColumn("start", F.greatest(F.col("start") - 50, F.lit(0).cast("long"))).withColumn("len", F.col("len") + 100 + F.col("read_len"))
    return padded.select("rid", "rc", "seq_id", "start", "len", "hits", (~((F.col("hits") < 2) & (F.col("n") > p.contigs_threshold))).alias("valid"))
