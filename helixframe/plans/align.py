"""The whole way: index references, find candidates of reads, vote, choose, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import finalize, index as ix, kmers as km, sketch as sk, voting as vt
from helixframe.params import AlignParams
from helixframe.sources import files, tables
from helixframe.sources.shared import forget, written


def histogram(refs: DataFrame, p: AlignParams) -> DataFrame:
    return km.spelled(km.coded_counts(refs, "seq_id", p.k), p.k)


def frequent(refs: DataFrame, p: AlignParams, hist: DataFrame | None = None) -> DataFrame:
    """The rows of the histogram that filters need, at most one in p.max_count positions; stored, as reads and windows ask it."""
    if hist is None:
        hist = km.spelled(km.frequent_counts(refs, "seq_id", p.k, p.max_count), p.k)
    return written(hist.where(F.col("cnt") >= p.max_count), "frequent")


def candidates(refs: DataFrame, strands: DataFrame, p: AlignParams, hist: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    hist = frequent(refs, p, hist)
    index = written(ix.build(refs, hist, p), "index") if index is None else index
    hits = ix.probe(sk.read_sketches(strands, hist, p), index, p)
    return ix.filtered(ix.islands(hits), strands.where("rc = 0").select("rid", F.length("seq").alias("read_len")), p)


def contig_kmers(refs: DataFrame, tasks: DataFrame, p: AlignParams) -> DataFrame:
    """Only references with a contig are cut into pieces."""
    near = refs.join(tasks.select("seq_id").distinct(), "seq_id", "left_semi")
    return vt.contig_kmers(tasks, near, p)


def private_matches(refs: DataFrame, strands: DataFrame, tasks: DataFrame, p: AlignParams, secret: str) -> DataFrame:
    """Matches found on ciphers alone: every task has its own keys, repeats of the read are masked."""
    masks = km.repeats(strands, ["rid", "rc"], p.k2)
    if p.mask_neighbours:
        masks = km.with_neighbours(masks, ["rid", "rc"], p.k2)
    own = km.kmers(strands, ["rid", "rc"], p.k2).join(tasks.select("rid", "rc", "task").distinct(), ["rid", "rc"])
    own = own.join(masks.where("masked").select("rid", "rc", "pos"), ["rid", "rc", "pos"], "left_anti")
    own = vt.ciphers(own, None, [], "task", secret).select("task", F.col("pos").alias("rpos"), "cipher")
    other = vt.ciphers(contig_kmers(refs, tasks, p), None, [], "task", secret)
    other = vt.unique(other.select(*vt.TASK, "task", "cid", "cpos", "cipher"), vt.TASK, "cipher")
    return other.join(vt.unique(own, ["task"], "cipher"), ["task", "cipher"]).select(*vt.TASK, "rpos", "cpos")


def voted(found: DataFrame, strands: DataFrame, tasks: DataFrame, p: AlignParams) -> DataFrame:
    sizes = tasks.join(strands.select("rid", "rc", (F.length("seq") - (p.k2 - 1)).cast("long").alias("nr")), ["rid", "rc"]).select(*vt.TASK, "nr", (F.col("len") - (p.k2 - 1)).alias("nc"))
    return vt.discretised(found, sizes, p)


def best(refs: DataFrame, reads: DataFrame, p: AlignParams, secret: str = "s", hist: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """rid, rc, ref_start (over all references one after the other), votes, second_votes, second_start, batch, mapq."""
    strands = tables.strands(reads)
    # stored, as several steps read them: a stage lost with its executor starts from there
    tasks = written(vt.tasks(candidates(refs, strands, p, hist, index), p), "tasks")
    found = written(private_matches(refs, strands, tasks, p, secret), "matches")
    top = written(vt.top_two(vt.convolved(voted(found, strands, tasks, p), p.delta), p.exclude), "top")
    merged = written(vt.best_of_read(vt.refined(top, found, p), finalize.offsets(refs), p.delta_x), "best")
    forget(tasks, found, top)
    return finalize.mapped(merged, p)


def align_files(spark, fasta: str, fastq: str, out: str, p: AlignParams, store: str | None = None) -> None:
    """Aligns a FASTQ file to a FASTA file and writes SAM rows; histogram and index are kept in the store for the next run."""
    refs, reads = files.fasta(spark, fasta), files.fastq(spark, fastq)
    hist = index = None
    if store:
        kept = files.Store(spark, store, p)
        hist = kept.get("kmer_hist", lambda: histogram(refs, p))
        index = kept.get("index", lambda: ix.build(refs, hist, p), ["tbl"])
    found = best(refs, reads, p, hist=hist, index=index)
    files.write_sam(finalize.sam(found, reads, finalize.offsets(refs), refs.select("seq_id", "name")), out)
