"""MinHash of reads and of windows, SimHash, projections of sketches into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import codes, sequence as sq
from helixframe.operators import kmers as km
from helixframe.params import AlignParams

#: Windows of a sequence that one task slides over; pieces overlap by a window.
STRETCH = 1 << 16


def read_sketches(reads: DataFrame, hist: DataFrame, p: AlignParams, keys: tuple[str, ...] = ("rid", "rc")) -> DataFrame:
    """keys, n_valid, sig of the reads with more than 2k valid k-mers; frequent k-mers and those with N don't count."""
    valid = km.without_frequent(km.kmers(reads, list(keys), p.k), hist, p.max_count).withColumn("x", sq.hash32(F.col("kmer")))
    least = [F.min(sq.low_product(a, F.col("x"))) for a in p.minhash_coefficients()]
    return valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_valid"), F.array(*least).alias("sig")).where(F.col("n_valid") > 2 * p.k)


def window_sketches(seqs: DataFrame, hist: DataFrame, p: AlignParams, key: str = "seq_id") -> DataFrame:
    """key, pos, m0...: the minima of each window with a valid k-mer; within a worker where it can have the whole sequence."""
    sent = km.sent_codes(hist, p.max_count, p.k)
    if sent is None:
        return slid_sketches(seqs, hist, p, key)
    coefficients = p.minhash_coefficients()

    def kernel(data, offsets):
        row, pos, _, least = codes.window_minima(data, offsets, sent.value, p.k, p.w, coefficients)
        return row, [pos, *least]

    schema = ", ".join(["pos long", *[f"m{j} long" for j in range(p.h)]])
    return km.both(seqs, key, lambda s: km.local(s, key, schema, kernel), lambda s: slid_sketches(s, hist, p, key))


def slid_sketches(seqs: DataFrame, hist: DataFrame, p: AlignParams, key: str = "seq_id") -> DataFrame:
    """The same by windows over rows of k-mers, for sequences that no task holds as a whole. A sliding minimum is the lesser of a suffix minimum of its
    block and a prefix minimum of the next one, so a row costs the same however wide the window is."""
    width = p.w - p.k + 1
    per = STRETCH // width * width
    found = km.all_kmers(seqs, [key], p.k)
    frequent = hist.where(F.col("cnt") >= p.max_count).select("kmer", F.lit(True).alias("frequent"))
    x = F.when(F.col("frequent").isNull() & ~sq.ambiguous(F.col("kmer")), sq.hash32(F.col("kmer")))
    hashed = found.join(frequent, "kmer", "left").select(key, "pos", x.alias("x"))
    own = F.floor(F.col("pos") / per)
    # the first positions of a stretch belong to the last windows of the one before, too
    both = hashed.withColumn("stretch", F.explode(F.when((F.col("pos") % per < width - 1) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    hs = [f"h{j}" for j in range(p.h)]
    values = both.select(key, "stretch", "pos", *[sq.low_product(a, F.col("x")).alias(h) for a, h in zip(p.minhash_coefficients(), hs, strict=True)])
    block = Window.partitionBy(key, "stretch", F.floor(F.col("pos") / width))
    up, down = block.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0), block.orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    runs = values.select(key, "stretch", "pos", *[F.min(h).over(up).alias("p" + h) for h in hs], *[F.min(h).over(down).alias("s" + h) for h in hs])
    order = Window.partitionBy(key, "stretch").orderBy("pos")
    far = runs.select(key, "stretch", "pos", F.lead("pos", width - 1).over(order).alias("last"), *[F.least("s" + h, F.lead("p" + h, width - 1).over(order)).alias(f"m{j}") for j, h in enumerate(hs)])
    whole = far.where((F.floor(F.col("pos") / per) == F.col("stretch")) & F.col("last").isNotNull() & F.col("m0").isNotNull())
    return whole.select(key, "pos", *[f"m{j}" for j in range(p.h)])


def projected(sketches: DataFrame, keys: list[str], p: AlignParams, column: str | None = None) -> DataFrame:
    """keys, tbl, proj, bucket: one row a table. The sketch is in columns m0... or in one array."""
    at = (lambda i: F.col(column)[i]) if column else (lambda i: F.col(f"m{i}"))
    rows = [F.struct(F.lit(t).alias("tbl"), sq.vector_hash(p.projection_coefficients(), [at(i) for i in idx]).alias("proj")) for t, idx in enumerate(p.projections())]
    out = sketches.select(*keys, F.explode(F.array(*rows)).alias("z")).select(*keys, "z.tbl", "z.proj")
    return out.withColumn("bucket", sq.bucket(F.col("proj"), p.buckets_pow2))


def simhash(found: DataFrame, keys: list[str], bits: int = 32) -> DataFrame:
    """keys, fp: a bit is set where at least half of the k-mer hashes have it."""
    x = sq.hash32(F.col("kmer")).alias("x")
    sums = [F.sum(F.lit(2) * F.shiftright("x", b).bitwiseAND(F.lit(1).cast("long")) - 1).alias(f"v{b}") for b in range(bits)]
    total = sum((F.when(F.col(f"v{b}") >= 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in range(bits)), F.lit(0).cast("long"))
    return found.select(*keys, x).groupBy(*keys).agg(*sums).select(*keys, total.alias("fp"))


def estimated_jaccard(a, b):
    """Share of equal coordinates of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)
