"""Voting ciphers, tasks, votes and the choice of the best and second-best position of a contig."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import sequence as sq
from helixframe.operators import kmers as km
from helixframe.params import AlignParams

TASK = ["rid", "rc", "seq_id", "start"]


def tasks(contigs: DataFrame, p: AlignParams) -> DataFrame:
    """contigs with cid, task: p.task_size contigs of a read's strand share a task, counted before invalid ones go."""
    nth = F.row_number().over(Window.partitionBy("rid", "rc").orderBy("seq_id", "start")) - 1
    numbered = contigs.withColumn("cid", nth).withColumn("task", F.concat_ws(":", "rid", "rc", F.floor(nth / p.task_size)))
    return numbered.where("valid")


def contig_kmers(contigs: DataFrame, seqs: DataFrame, p: AlignParams) -> DataFrame:
    """contig columns, cpos, kmer: every p.interval-th k-mer, or of each bin of p.bin_size the first ones in bin order.
    Contigs meet the pieces of the references that they touch, which clip them; k-mers are cut behind that join."""
    last = F.col("start") + F.greatest(F.col("len") - p.k2, F.lit(0).cast("long"))
    spans = contigs.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / km.PIECE), F.floor(last / km.PIECE))))
    first = F.col("piece") * km.PIECE
    placed = spans.join(km.pieces(seqs, ["seq_id"], p.k2), ["seq_id", "piece"])
    placed = placed.withColumn("low", F.greatest(F.col("start"), first)).withColumn("high", F.least(last, first + F.length("part") - p.k2)).where("low <= high")
    slots = placed.withColumn("pos", F.explode(F.sequence("low", "high"))).withColumn("cpos", F.col("pos") - F.col("start"))
    if p.bin_size == 1:
        slots = slots.where(F.col("cpos") % p.interval == 0)
    else:
        chosen = p.bin_order()[: p.bin_size // p.interval]
        slots = slots.where((F.col("cpos") % p.bin_size).isin(chosen))
    found = slots.withColumn("kmer", F.substr("part", (F.col("pos") - first + 1).cast("int"), F.lit(p.k2)).cast("string"))
    return found.drop("piece", "part", "low", "high").where(~sq.ambiguous(F.col("kmer")))


def ciphers(kmers: DataFrame, masks: DataFrame | None, keys: list[str], task: str, secret: str) -> DataFrame:
    """kmers with cipher, null where masked: SHA-1 of the k-mer under the two keys of its task."""
    high, low = sq.halves64(F.col("kmer"))
    key1, key2 = (sq.task_key(F.col(task), secret, i) for i in (1, 2))
    out = kmers.withColumn("cipher", sq.keyed(high, low, key1, key2))
    if masks is None:
        return out
    return out.join(masks, keys, "left").withColumn("cipher", F.when(~F.coalesce("masked", F.lit(False)), F.col("cipher"))).drop("masked")


def cloud_view(ciphers_of: DataFrame, slot: str, bin_size: int) -> DataFrame:
    """What leaves the client: task, contig number, cipher and binned position."""
    return ciphers_of.where("cipher is not null").select("task", "cid", "cipher", F.floor(F.col(slot) / bin_size).alias("bin"))


def unique(kmers: DataFrame, keys: list[str], value: str) -> DataFrame:
    return kmers.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, value))).where("_n = 1").drop("_n")


def matches(read_kmers: DataFrame, contig: DataFrame) -> DataFrame:
    """TASK, rpos, cpos: k-mers that are unique in the read's strand and in the contig."""
    own = unique(read_kmers.select("rid", "rc", F.col("pos").alias("rpos"), "kmer"), ["rid", "rc"], "kmer")
    other = unique(contig.select(*TASK, "cpos", "kmer"), TASK, "kmer")
    return other.join(own, ["rid", "rc", "kmer"]).select(*TASK, "rpos", "cpos")


def discretised(found: DataFrame, sizes: DataFrame, p: AlignParams) -> DataFrame:
    """TASK, nr, nc, diag, votes: a match votes for every diagonal that its bins allow, at bin size 1 for two of them."""
    b = p.bin_size
    r, c = F.floor(F.col("rpos") / b), F.floor(F.col("cpos") / b)
    low = c * b - F.least((r + 1) * b, F.col("nr"))
    high = F.least((c + 1) * b, F.col("nc")) - r * b
    each = found.join(sizes, TASK).select(*TASK, "nr", "nc", F.explode(F.sequence(low, high - 1)).alias("diag"))
    return each.groupBy(*TASK, "nr", "nc", "diag").agg(F.count(F.lit(1)).alias("votes"))


def convolved(votes: DataFrame, d: int) -> DataFrame:
    """TASK, nr, nc, at, score: votes within d of each diagonal; the very first diagonal doesn't count for the first d + 1."""
    spread = votes.select(*TASK, "nr", "nc", "diag", "votes", F.explode(F.sequence(F.greatest(F.col("diag") - d, -F.col("nr")), F.least(F.col("diag") + d, F.col("nc") - 1))).alias("at"))
    spread = spread.where(~((F.col("diag") == -F.col("nr")) & (F.col("at") <= -F.col("nr") + d)))
    return spread.groupBy(*TASK, "nr", "nc", "at").agg(F.sum("votes").alias("score"))


def top_two(scores: DataFrame, exclude: int) -> DataFrame:
    """TASK, best, best_at (middle of the first plateau), second, second_at (first of its plateau, null without votes).
    All steps keep the partitioning by TASK."""
    whole = Window.partitionBy(*TASK)
    order = whole.orderBy("at")
    at, top = F.col("at"), F.col("score") == F.col("best")
    peak = scores.withColumn("best", F.max("score").over(whole))
    goes_on = F.coalesce((F.lead("at").over(order) == at + 1) & (F.lead("score").over(order) == F.col("best")), F.lit(False))
    ends = peak.withColumn("goes_on", goes_on).withColumn("a", F.min(F.when(top, at)).over(whole)).withColumn("b", F.min(F.when(top & ~F.col("goes_on"), at)).over(whole))
    mid = F.floor((F.col("a") + F.col("b") + 1 + 2 * F.col("nr")) / 2) - F.col("nr")
    far = F.when(F.abs(at - F.col("best_at")) > exclude, F.struct("score", (-at).alias("m")))
    both = ends.withColumn("best_at", mid).groupBy(*TASK, "best", "best_at").agg(F.max(far).alias("s"))
    return both.select(*TASK, "best", "best_at", F.coalesce("s.score", F.lit(0).cast("long")).alias("second"), (-F.col("s.m")).alias("second_at"))


def refined(best: DataFrame, found: DataFrame, p: AlignParams) -> DataFrame:
    """best with exact_at: the diagonal of the first match (by read position) whose votes reach best_at, else best_at."""
    b = p.bin_size
    r, c = F.floor(F.col("rpos") / b), F.floor(F.col("cpos") / b)
    near = found.join(best.select(*TASK, "best_at"), TASK).where(F.col("best_at").between(c * b - (r + 1) * b, (c + 1) * b - r * b))
    first = near.groupBy(*TASK).agg(F.min(F.struct("rpos", "cpos")).alias("m")).select(*TASK, (F.col("m.cpos") - F.col("m.rpos")).alias("exact"))
    return best.join(first, TASK, "left").withColumn("exact_at", F.coalesce("exact", "best_at")).drop("exact")


def best_of_read(results: DataFrame, offsets: DataFrame, delta_x: int) -> DataFrame:
    """rid, rc, ref_start, votes, second_votes, second_start: the results of a read's contigs, forward ones first and by position,
    merged one after the other; a better hit within delta_x replaces the best but leaves the second."""
    at = lambda c: F.col("offset") + F.col("start") + F.col(c)
    entry = lambda s, a, i: F.struct("rc", (F.col("offset") + F.col("start")).alias("g"), F.lit(i).alias("i"), F.col(s).cast("long").alias("v"), F.coalesce(at(a), F.lit(0)).cast("long").alias("p"))
    rows = results.join(offsets, "seq_id").select("rid", F.explode(F.array(entry("best", "exact_at", 0), entry("second", "second_at", 1))).alias("e"))
    state = lambda bv, bp, br, sv, sp: F.struct(bv.alias("bv"), bp.alias("bp"), br.alias("br"), sv.alias("sv"), sp.alias("sp"))
    zero = state(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def merge(a, e):
        apart = F.abs(e["p"] - a["bp"]) > delta_x
        better = state(e["v"], e["p"], e["rc"], F.when(apart, a["bv"]).otherwise(a["sv"]), F.when(apart, a["bp"]).otherwise(a["sp"]))
        runner = state(a["bv"], a["bp"], a["br"], e["v"], e["p"])
        return F.when(e["v"] > a["bv"], better).when((e["v"] > a["sv"]) & apart, runner).otherwise(a)

    folded = rows.groupBy("rid").agg(F.aggregate(F.sort_array(F.collect_list("e")), zero, merge).alias("z"))
    return folded.select("rid", F.col("z.br").alias("rc"), F.col("z.bp").alias("ref_start"), F.col("z.bv").alias("votes"), F.col("z.sv").alias("second_votes"), F.col("z.sp").alias("second_start"))
