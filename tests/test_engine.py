"""Every engine query against independent SQL in a second engine."""

import hashlib
import time
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import codes
from helixframe.operators import chaining, index as ix, kmers as km, sketch as sk, stats
from helixframe.plans import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracles.SQL))
def test_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(oracles.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = Counter(map(tuple, got.select(*cols).collect()))
    assert rows == Counter(con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({oracles.SQL[name]}) q").fetchall())
    assert rows


def made(spark):
    """Sequences with N, repeats, none, one short one, and an id that two rows share."""
    import random

    r = random.Random(3)
    seqs = ["".join(r.choice("ACGT" * 8 + "N") for _ in range(n)) for n in (700, 40, 5, 0, 900, 300, 300)]
    seqs[4] = seqs[4][:300] * 3 + "A" * 60
    return spark.createDataFrame(list(enumerate(seqs)) + [(1, seqs[0][:80])], "seq_id long, seq string")


@pytest.mark.parametrize("k", [1, 7, 16, 20, 32])
def test_codes_count_as_strings(spark, k, monkeypatch):
    """Counts by code, in chunks of few letters, are those of the strings; frequent k-mers sent in parts are all left out."""
    monkeypatch.setattr(km, "SENT", 5)
    seqs = made(spark)
    plain = km.kmers(seqs, ["seq_id"], k)
    counts = km.coded_counts(seqs, "seq_id", k)
    assert Counter(map(tuple, km.spelled(counts, k).collect())) == Counter(map(tuple, km.histogram(plain).collect()))
    want = km.without_frequent(plain, km.histogram(plain), 3).groupBy("seq_id").count()
    assert sorted(map(tuple, km.count_without_frequent(seqs, "seq_id", k, counts, 3).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("whole", [500, 1 << 22])
def test_next_occurrence_of_whole_sequences(spark, whole, monkeypatch):
    """Sequences taken as a whole, long ones and those that share an id agree with the window over k-mers; whole ones need no window."""
    monkeypatch.setattr(km, "WHOLE", whole)
    seqs = made(spark)
    got, want = km.next_occurrence_of(seqs, "seq_id", 6), km.next_occurrence(km.kmers(seqs, ["seq_id"], 6), ["seq_id"])
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    alone = km.next_occurrence_of(seqs.where("seq_id <> 1"), "seq_id", 6)
    assert ("Window" in alone._jdf.queryExecution().toString()) == (whole == 500)


@pytest.mark.parametrize("whole", [500, 1 << 22])
def test_masks_of_whole_sequences(spark, whole, monkeypatch):
    """Every k-mer has a slot, also behind the first 150, of short sequences and with N; rows that share an id stay apart."""
    monkeypatch.setattr(km, "WHOLE", whole)
    seqs = [x["seq"] for x in made(spark).collect()] + ["ACGTACGTAC", "N" * 12]
    df = spark.createDataFrame([(min(i, 6), x) for i, x in enumerate(seqs)] + [(None, "ACGTTACGTT")], "seq_id long, seq string")
    for farthest in (65_535, 40):
        want = Counter()
        for i, x in [(min(i, 6), x) for i, x in enumerate(seqs)] + [(None, "ACGTTACGTT")]:
            at: dict[str, list[int]] = {}
            for p in range(len(x) - 4):
                at.setdefault(x[p : p + 5], []).append(p)
            want.update((i, p, any(0 < abs(p - q) <= farthest for q in at[x[p : p + 5]])) for p in range(len(x) - 4))
        assert Counter(map(tuple, km.whole_mask(df, "seq_id", 5, farthest).collect())) == want


def test_contig_masks_reach_the_ends(spark):
    """All positions of all references, masked as the parts' operator has it where the whole sequence is the part."""
    d = queries.Data(spark, SF)
    refs = d.refs.where("length(seq) < 3000").persist()
    parts = refs.where("length(seq) >= 8").select(F.col("seq_id").alias("part"), "seq_id", F.lit(0).cast("long").alias("start"), (F.length("seq") - 7).cast("long").alias("n"))
    want = km.in_part_mask(km.next_occurrence(km.all_kmers(refs, ["seq_id"], 8), ["seq_id"]), parts)
    got = queries.QUERIES["contig_repeat_mask"](spark, SF)
    sizes = {x["part"]: (x["n"], x["most"]) for x in got.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("most")).collect()}
    assert sizes == {x["seq_id"]: (x["n"], x["n"] - 1) for x in d.refs.where("length(seq) >= 8").select("seq_id", (F.length("seq") - 7).alias("n")).collect()}
    assert Counter(map(tuple, got.join(parts.select("part"), "part").select("part", "slot", "masked").collect())) == Counter(map(tuple, want.collect()))
    refs.unpersist()


def test_hashes_in_step():
    """SHA-1 of many k-mers at once is that of the library, for all lengths and over block edges."""
    for k in (1, 16, 32, 55):
        text = np.random.default_rng(k).integers(0, 256, (8200, k)).astype(np.uint8)
        assert codes.hash32(text).tolist() == [int.from_bytes(hashlib.sha1(x.tobytes()).digest()[:4], "big") for x in text]
    assert len(codes.hash32(np.zeros((0, 16), np.uint8))) == 0


def test_windows_of_whole_sequences(spark, monkeypatch):
    """Index and repeats of sequences taken as a whole are those of windows over rows, also with frequent k-mers and shared ids."""
    p, seqs = replace(queries.P, w=100, max_count=3), made(spark)
    hist = km.spelled(km.coded_counts(seqs, "seq_id", p.k), p.k)
    got = []
    for whole in (1 << 22, 0):
        monkeypatch.setattr(km, "WHOLE", whole)
        got.append([Counter(map(tuple, x.collect())) for x in (ix.build(seqs, hist, p), stats.window_repeats_of(seqs, 100, 8, 32), stats.fingerprints_of(seqs, 100, 8, 32))])
    assert got[0] == got[1] and all(got[0])


def test_frequent_counts_are_those_of_the_histogram(spark, monkeypatch):
    r = np.random.default_rng(5)
    seqs = ["".join(r.choice(list("ACGTN"), 400, p=[0.4, 0.3, 0.15, 0.1, 0.05])) for _ in range(40)] + ["A" * 300, "ACG", ""]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    seen = []
    counted = km.coded_counts
    monkeypatch.setattr(km, "coded_counts", lambda s, key, k, wanted=None: seen.append(wanted) or counted(s, key, k, wanted))
    every = sorted(tuple(x) for x in counted(df, "seq_id", 6).collect())
    for least in (2, 9, 1 << 15):
        got = sorted(tuple(x) for x in km.frequent_counts(df, "seq_id", 6, least).collect())
        assert got == [x for x in every if x[1] >= least]
    # k-mers of buckets that hold too few are not counted one by one
    assert all(seen) and not seen[-1](np.arange(4**6, dtype=np.uint64)).any()


def test_window_minima_of_32_bits():
    """A k-mer whose product is the largest of 32 bits is a minimum like any other; windows without a valid k-mer have none."""
    data = np.frombuffer(b"ACGTTGCAAC" + b"N" * 12 + b"GGATCCATGA", np.uint8)
    row, pos, at, least = codes.window_minima(data, np.array([0, 10, 32]), np.zeros(0, np.uint64), 4, 8, [1, 0xFFFFFFFF])
    hashes = {i: int(codes.hash32(data[i : i + 4][None])[0]) for i in range(29) if b"N" not in data[i : i + 4].tobytes()}
    expected = [(r, p) for r, n, first in ((0, 10, 0), (1, 22, 10)) for p in range(n - 7) if any(first + p + j in hashes for j in range(5))]
    assert list(zip(row.tolist(), pos.tolist(), strict=True)) == expected
    for a, m in zip((1, 0xFFFFFFFF), least, strict=True):
        assert m.tolist() == [min(hashes[i + j] * a % (1 << 32) for j in range(5) if i + j in hashes) for i in at.tolist()]


def test_one_file_is_dealt_to_all_tasks(spark, tmp_path):
    """A table of one file and one row group must not leave all windows to one task."""
    text = "concat_ws(' ', transform(sequence(1, 10), i -> sha2(concat(id, ' ', i), 256))) as text"
    spark.range(300).selectExpr("id as doc_id", text).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3).selectExpr("id as item_id", text).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    d = queries.Data(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
        parts = d.index().select("seq_id", F.spark_partition_id().alias("part")).distinct().groupBy("part").count().collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 300


def test_only_asked_buckets_are_counted(spark):
    """Buckets over the cap give nothing; the size counts all entries of a bucket, those of other projections included."""
    p = replace(queries.P, bucket_cap=3)
    reads = spark.createDataFrame([(1, 0, 40, list(range(100, 108)))], "rid long, rc int, n_valid long, sig array<long>")
    asked = sk.projected(reads, ["rid", "rc"], p, "sig").orderBy("tbl").collect()
    rows = []
    for a, same, others in zip(asked, (1, 2, 3, 4), (2, 2, 0, 0), strict=True):
        rows += [(a.tbl, a.bucket, a.proj, i, 0, 1) for i in range(same)] + [(a.tbl, a.bucket, a.proj ^ 1, i, 9, 1) for i in range(others)]
    rows += [(0, -5, 1, i, 0, 1) for i in range(50)]
    index = spark.createDataFrame(rows, "tbl int, bucket int, proj long, seq_id long, pos long, len long")
    assert Counter(r.tbl for r in ix.probe(reads, index, p).collect()) == {0: 1, 2: 3}


def test_chains_of_many_fragments(spark):
    """The heaviest chains are those of a plain search; a task of some thousand fragments ends in seconds."""
    r = np.random.default_rng(9)
    rows = [(t, 0, 5, 100, *x) for t in range(20) for x in sorted({(int(a), int(b)): (int(a), int(b), int(n)) for a, b, n in zip(r.integers(0, 60, 30), r.integers(0, 90, 30), r.integers(2, 9, 30), strict=True)}.values())]
    parts = spark.createDataFrame(rows, "rid long, rc int, seq_id long, start long, rpos long, cpos long, n long").repartition(3, "rpos")
    want = []
    for t in range(20):
        own, score, first = [x[4:] for x in rows if x[0] == t], [], []
        for i, (a, b, n) in enumerate(own):
            best, head = 0, b - a
            for j, (x, y, m) in enumerate(own[:i]):
                s = score[j] - 2 - 10 * abs((b - a) - (y - x))
                if x + m <= a and y + m <= b and s > best:
                    best, head = s, first[j]
            score.append(5 * n + best)
            first.append(head)
        at = score.index(max(score))
        want.append((t, 0, 5, 100, score[at], first[at]))
    assert sorted(map(tuple, chaining.best_chain(parts).collect())) == want
    n = 4000
    began = time.time()
    assert chaining.heaviest(np.arange(n) * 3, np.arange(n) * 3, np.full(n, 3)) == (15 * n - 2 * (n - 1), 0)
    assert time.time() - began < 20


@pytest.mark.parametrize("k", [1, 4, 7, 12, 16])
def test_many_frequent_kmers_are_sent_as_bits(spark, k, monkeypatch):
    """Few frequent k-mers as numbers, many as bits in rounds give the counts of a join over strings; rounds don't grow with k-mers."""
    seqs = made(spark)
    plain = km.kmers(seqs, ["seq_id"], k)
    want = sorted(map(tuple, km.without_frequent(plain, km.histogram(plain), 3).groupBy("seq_id").count().collect()))
    monkeypatch.setattr(km, "PART_BITS", 20)
    monkeypatch.setattr(km, "SENT_BITS", max(2 * k - 2, 20))
    for most in (1 << 22, 0):
        monkeypatch.setattr(km, "SENT", most)
        assert sorted(map(tuple, km.count_without_often(seqs, "seq_id", k, 3).collect())) == want


def test_numbers_of_kmers_in_two_bytes():
    """Parts give back all numbers with their counts, and no occurrence takes much over two bytes."""
    number = km.mixed(np.random.default_rng(2).integers(0, 1 << 32, 1 << 20, dtype=np.uint64), 16)
    number[:999] = number[0]
    part, blocks = km.packed_parts(number, 22)
    back = np.concatenate([km.unpacked_part(x, 22) + (int(i) << 22) for i, x in zip(part, blocks, strict=True)])
    assert (back == np.sort(number).astype(np.int64)).all()
    assert sum(map(len, blocks)) < 2.3 * len(number)
    assert len(np.unique(km.mixed(np.arange(4**6, dtype=np.uint64), 6))) == 4**6
