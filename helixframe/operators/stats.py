"""Reports over references and indexes: repeats in windows, their fingerprints, bins with many repeats."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import codes
from helixframe.operators import kmers as km


def window_counts(found: DataFrame, w: int, k: int, step: int) -> DataFrame:
    """seq_id, win, kmer, cnt for windows that begin every step letters and lie inside the k-mers' positions."""
    # a k-mer at pos lies in the windows that begin at pos - (w - k) to pos
    low = F.greatest(F.ceil((F.col("pos") - (w - k)) / step), F.lit(0))
    each = found.select("seq_id", "kmer", F.explode(F.sequence(low, F.floor(F.col("pos") / step))).alias("i")).withColumn("win", F.col("i") * step)
    return each.groupBy("seq_id", "win", "kmer").agg(F.count(F.lit(1)).alias("cnt"))


def window_repeats(counts: DataFrame) -> DataFrame:
    return counts.groupBy("seq_id", "win").agg(F.max("cnt").alias("most"), F.count_if(F.col("cnt") > 1).alias("repeated"))


def fingerprints(counts: DataFrame) -> DataFrame:
    """fingerprint (counts of repeated k-mers of a window, sorted), n windows that have it."""
    one = counts.groupBy("seq_id", "win").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("cnt") > 1, F.col("cnt")))), lambda c: c.cast("string")), " ").alias("fingerprint"))
    return one.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


def window_repeats_of(seqs: DataFrame, w: int, k: int, step: int) -> DataFrame:
    """window_repeats of sequences; whole ones need no shuffle."""

    def kernel(data, offsets):
        row, win, at, n = codes.window_runs(data, offsets, k, w, step)
        most = np.zeros(len(row), np.int64)
        np.maximum.at(most, at, n)
        return row, [win, most, np.bincount(at[n > 1], minlength=len(row)).astype(np.int64)]

    far = lambda s: window_repeats(window_counts(km.kmers(s, ["seq_id"], k), w, k, step))
    return km.both(seqs, "seq_id", lambda s: km.local(s, "seq_id", "win long, most long, repeated long", kernel), far)


def fingerprints_of(seqs: DataFrame, w: int, k: int, step: int) -> DataFrame:
    """fingerprints of sequences; workers count those of whole ones before they are shuffled."""

    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            for _, _, data, offsets in codes.chunks(b.column(0)):
                row, _, at, n = codes.window_runs(data, offsets, k, w, step)
                at, n = at[n > 1], n[n > 1]
                o = np.lexsort((n, at))
                cut = np.searchsorted(at[o], np.arange(len(row) + 1)).tolist()
                n = n[o].tolist()
                seen.update(tuple(n[i:j]) for i, j in zip(cut, cut[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, x)) for x in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["fingerprint", "n"])

    near = lambda s: s.select("seq").where("seq is not null").mapInArrow(run, "fingerprint string, n long")
    far = lambda s: fingerprints(window_counts(km.kmers(s, ["seq_id"], k), w, k, step))
    return km.both(seqs, "seq_id", near, far).groupBy("fingerprint").agg(F.sum("n").alias("n"))


def repeat_bins(next_dist: DataFrame, width: int, interval: int) -> DataFrame:
    """seq_id, bin, n of bins of that width with more than width div interval positions whose k-mer comes again."""
    return next_dist.where("next_dist > 0").groupBy("seq_id", F.floor(F.col("pos") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > width // interval // 2)


def communication(ciphers: DataFrame) -> DataFrame:
    """n_tasks, n_bytes: eight bytes for each k-mer sent."""
    return ciphers.groupBy("task").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_tasks"), F.sum(8 * F.col("n")).alias("n_bytes"))
