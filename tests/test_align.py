"""Files in, SAM out: reads cut at known places are found again. Worked examples of single operators."""

import random

import pytest

from helixframe import __main__ as cli
from helixframe.functions import sequence as sq
from helixframe.operators import finalize, index as ix, kmers as km, voting as vt
from helixframe.params import AlignParams
from helixframe.plans import align, queries
from helixframe.sources import files

P = AlignParams(h=8, n_tables=4, proj_len=1, w=100)
TURN = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def written(tmp_path_factory):
    """A reference of two records and 40 reads, half of them turned, with one letter in a hundred changed."""
    r, folder = random.Random(4), tmp_path_factory.mktemp("reads")
    seqs = ["".join(r.choice("ACGT") for _ in range(1500)) for _ in range(2)]
    (folder / "ref.fa").write_text("".join(f">chr{i + 1} made up\n" + "".join(s[j : j + 70].lower() + "\n" for j in range(0, len(s), 70)) for i, s in enumerate(seqs)))
    (folder / "fq").mkdir()
    lines = []
    for i in range(40):
        c, at = r.randrange(2), r.randrange(100, 1300)
        s = [b if r.random() > 0.01 else r.choice("ACGT") for b in seqs[c][at : at + 150]]
        s = "".join(s) if i % 2 else "".join(s)[::-1].translate(TURN)
        lines += [f"@chr{c + 1}_{at + 1}_{at + 150}_{i}", s, "+", "@" * 150]
    (folder / "fq" / "reads.fq").write_text("\n".join(lines) + "\n")
    return folder, seqs


def test_files(spark, written):
    folder, seqs = written
    refs = files.fasta(spark, str(folder / "ref.fa"))
    assert [(r.name, r.seq) for r in refs.orderBy("seq_id").collect()] == [(f"chr{i + 1} made up", s) for i, s in enumerate(seqs)]
    reads = files.fastq(spark, str(folder / "fq"))
    assert sorted(r.rid for r in reads.collect()) == list(range(40))
    (folder / "bad.fq").write_text("@a\nACGT\n+\n@@\n")
    with pytest.raises(Exception, match="bad FASTQ"):
        files.fastq(spark, str(folder / "bad.fq")).collect()


def test_reads_are_found_again(spark, written):
    folder, _ = written
    refs, reads = files.fasta(spark, str(folder / "ref.fa")), files.fastq(spark, str(folder / "fq"))
    found = align.best(refs, reads, P).cache()
    placed = finalize.offsets(refs)
    score = finalize.evaluated(found, files.global_truth(files.truth(reads), placed)).first()
    assert score.reads == 40 and score.correct >= 38 and score.mapped >= 38
    files.write_sam(finalize.sam(found, reads, placed, refs.select("seq_id", "name")), str(folder / "out.sam"))
    lines = [x.value.split("\t") for x in spark.read.text(str(folder / "out.sam")).collect()]
    assert len(lines) == 40 and all(len(x) == 11 for x in lines) and {x[1] for x in lines} >= {"0", "16"}
    near = [abs(int(x[3]) - int(x[0].split("_")[1])) <= 20 and x[2].split()[0] == x[0].split("_")[0] for x in lines]
    assert sum(near) >= 38


def test_store_and_command_line(spark, written, tmp_path):
    kept = files.Store(spark, str(tmp_path), P)
    refs = files.fasta(spark, str(written[0] / "ref.fa"))
    hist = kept.get("kmer_hist", lambda: align.histogram(refs, P))
    index = kept.get("index", lambda: ix.build(refs, hist, P), ["tbl"])
    assert kept.has("index") and index.count() == ix.build(refs, hist, P).count()
    p = cli.params(cli.parse(["align", "a.fa", "b.fq", "--out", "o", "-k", "12", "-I", "3", "-B", "20", "-M"]))
    assert (p.k, p.interval, p.bin_size, p.mask_neighbours, p.h) == (12, 3, 20, True, 128)
    with pytest.raises(ValueError):
        AlignParams(interval=30, bin_size=20)


def test_worked_examples(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("acgtRN", "ACGTACGTNACGT")], "a string, b string")
    assert tuple(one.select(sq.encode(F.col("a")), sq.reverse_complement(F.col("b"))).first()) == ("ACGTNN", "ACGTNACGTACGT")
    seqs = spark.createDataFrame([(0, "ACGTACGTNACGT")], "seq_id long, seq string")
    assert [r.kmer for r in km.kmers(seqs, ["seq_id"], 4).orderBy("pos").collect()] == ["ACGT", "CGTA", "GTAC", "TACG", "ACGT", "ACGT"]
    hits = spark.createDataFrame([(0, 0, 0, 0, 10, 3), (0, 0, 1, 0, 12, 2), (0, 0, 0, 0, 20, 1)], "rid long, rc int, tbl int, seq_id long, pos long, len long")
    found = ix.islands(hits)
    assert sorted((r.start, r.len, r.hits) for r in found.collect()) == [(11, 3, 2), (21, 0, 1)]
    padded = ix.filtered(found, spark.createDataFrame([(0, 150)], "rid long, read_len int"), AlignParams())
    assert sorted((r.start, r.len) for r in padded.collect()) == [(0, 250), (0, 253)]
    masks = spark.createDataFrame([(0, i, i in (2, 6)) for i in range(14)], "rid long, pos long, masked boolean")
    assert [r.pos for r in km.with_neighbours(masks, ["rid"], 4).where("masked").orderBy("pos").collect()] == [2, 3, 4, 5, 6]
    task = "rid long, rc int, seq_id long, start long, "
    size = spark.createDataFrame([(0, 0, 0, 0, 131, 231)], task + "nr long, nc long")
    diagonals = lambda r, c, b: sorted(x.diag for x in vt.discretised(spark.createDataFrame([(0, 0, 0, 0, r, c)], task + "rpos long, cpos long"), size, AlignParams(bin_size=b)).collect())
    assert diagonals(3, 7, 1) == [3, 4] and diagonals(20, 40, 20) == list(range(40)) and diagonals(120, 220, 20) == list(range(89, 111))
    pairs = [(0, 0, 0, 0, i, i + 60) for i in range(30)] + [(0, 0, 0, 0, i, i + 2) for i in range(5)]
    small = spark.createDataFrame([(0, 0, 0, 0, 30, 131)], task + "nr long, nc long")
    votes = vt.discretised(spark.createDataFrame(pairs, task + "rpos long, cpos long"), small, AlignParams())
    top = vt.top_two(vt.convolved(votes, 10), 50).first()
    assert (top.best, top.best_at, top.second, top.second_at) == (60, 60, 10, -8)
    best = spark.createDataFrame([(0, 40, 10), (1, 60, 0)], "rid long, votes long, second_votes long")
    assert [r.mapq for r in finalize.mapped(best, AlignParams()).orderBy("rid").collect()] == [29, 60]


def test_private_view_and_keys(spark):
    """Equal k-mers of different tasks have different ciphers, and only four columns leave the client."""
    seqs = spark.createDataFrame([(0, 0, "ACGTTGCA" * 4), (1, 0, "ACGTTGCA" * 4)], "rid long, rc int, seq string")
    found = queries.ciphers(type("D", (), {"strands": seqs})()).withColumn("cid", queries.F.lit(0))
    open_ = vt.ciphers(km.kmers(seqs, ["rid", "rc"], 20).withColumn("task", queries.F.col("rid").cast("string")), None, [], "task", "s")
    by = {}
    for r in open_.collect():
        by.setdefault(r.rid, set()).add(r.cipher)
    assert not by[0] & by[1] and vt.cloud_view(found, "pos", 20).columns == ["task", "cid", "cipher", "bin"]
