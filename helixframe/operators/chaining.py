"""Alternatives to voting: chains of matched fragments, and offsets by consensus of unique anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.operators.voting import TASK
from helixframe.sources.shared import ship


def fragments(found: DataFrame, k: int) -> DataFrame:
    """TASK, rpos, cpos, n: neighbouring matches on one diagonal are one fragment of n letters."""
    diag = [*TASK, "diag"]
    run = F.col("rpos") - F.row_number().over(Window.partitionBy(*diag).orderBy("rpos"))
    return found.withColumn("diag", F.col("cpos") - F.col("rpos")).withColumn("run", run).groupBy(*diag, "run").agg(F.min("rpos").alias("rpos"), F.min("cpos").alias("cpos"), (F.count(F.lit(1)) + k - 1).alias("n")).select(*TASK, "rpos", "cpos", "n")


def heaviest(r: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Score and first diagonal of the heaviest chain of fragments ordered by rpos, cpos; of equal ones the first is taken."""
    diag, r_end, c_end = c - r, r + n, c + n
    score, first = 5 * n, diag.copy()
    for i in range(1, len(r)):
        s = np.where((r_end[:i] <= r[i]) & (c_end[:i] <= c[i]), score[:i] - 2 - 10 * np.abs(diag[i] - diag[:i]), 0)
        j = int(s.argmax())
        if s[j] > 0:
            score[i] += s[j]
            first[i] = first[j]
    i = int(score.argmax())
    return int(score[i]), int(first[i])


def best_chain(parts: DataFrame) -> DataFrame:
    """TASK, score, at: the heaviest chain of fragments that follow each other in both; 5 a letter, less 2 a step and 10 a letter of
    shift. The fragments of one task are bounded by the read's length."""
    ship(parts.sparkSession)

    def run(batches):
        for b in batches:
            lists = b.column(len(TASK))
            each = lists.flatten()
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            r, c, n = (each.field(i).to_numpy() for i in range(3))
            best = [heaviest(r[i:j], c[i:j], n[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(TASK)], pa.array([x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.int64())], [*TASK, "score", "at"])

    long = [F.col(x).cast("long").alias(x) for x in ("rpos", "cpos", "n")]
    grouped = parts.groupBy(*TASK).agg(F.sort_array(F.collect_list(F.struct(*long))).alias("parts"))
    return grouped.select(F.col("rid").cast("long"), F.col("rc").cast("int"), F.col("seq_id").cast("long"), F.col("start").cast("long"), "parts").mapInArrow(run, "rid long, rc int, seq_id long, start long, score long, at long")


def consensus(found: DataFrame, d: int, anchors: int = 10, least: int = 5) -> DataFrame:
    """TASK, at, inliers: the lower median of the first diagonals, and the matches within d of it; tasks with fewer than least
    matches are left out."""
    diag = found.withColumn("diag", F.col("cpos") - F.col("rpos"))
    nth = F.row_number().over(Window.partitionBy(*TASK).orderBy("rpos", "cpos"))
    first = diag.withColumn("nth", nth).groupBy(*TASK).agg(F.sort_array(F.collect_list(F.when(F.col("nth") <= anchors, F.col("diag")))).alias("ds"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    middle = first.select(*TASK, F.element_at("ds", (F.floor((F.size("ds") - 1) / 2) + 1).cast("int")).alias("at"))
    return diag.join(middle, TASK).groupBy(*TASK, "at").agg(F.count_if(F.abs(F.col("diag") - F.col("at")) <= d).alias("inliers"))
