"""Column functions over sequences of A, C, G, T and N, their k-mers and hashes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LOW32 = 0xFFFFFFFF


def encode(text: Column) -> Column:
    """Upper case; whatever is not A, C, G or T becomes N."""
    return F.regexp_replace(F.upper(text), "[^ACGT]", "N")


def derived(text: Column) -> Column:
    """A sequence from prose: its letters, dealt over the bases; Q, X and Z become N."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTNCGTACGNAN")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def n_kmers(length: Column, k: int) -> Column:
    return F.greatest(length - (k - 1), F.lit(0))


def n_sampled(length: Column, k: int, interval: int) -> Column:
    return F.floor((length - (k - 1)) / interval).cast("long")


def n_sampled_binned(length: Column, k: int, interval: int, bin_size: int) -> Column:
    """Full bins give bin_size div interval k-mers, the last bin what it has divided by interval."""
    n = length - (k - 1)
    bins = F.ceil(n / bin_size)
    return ((bins - 1) * (bin_size // interval) + F.floor((n - (bins - 1) * bin_size) / interval)).cast("long")


def ambiguous(kmer: Column) -> Column:
    return F.instr(kmer, "N") > 0


def packed(kmer: Column) -> Column:
    """Two bits a base (A, G, C, T = 0 to 3), first base highest; null with an N. Up to 31 bases."""
    return F.when(~ambiguous(kmer), F.conv(F.translate(kmer, "AGCT", "0123"), 4, 10).cast("long"))


def unpacked(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "AGCT")


def hash32(kmer: Column) -> Column:
    """The first 32 bits of SHA-1, as a long."""
    return F.conv(F.substring(F.sha1(F.encode(kmer, "utf-8")), 1, 8), 16, 10).cast("long")


def halves64(kmer: Column) -> tuple[Column, Column]:
    """The first 64 bits of SHA-1 as two longs of 32 bits."""
    digest = F.sha1(F.encode(kmer, "utf-8"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def low_product(a: int | Column, x: Column) -> Column:
    """a * x modulo 2**32 for 32-bit values, without overflow."""
    a = F.lit(a) if isinstance(a, int) else a
    return (a * x.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((a * F.shiftright(x, 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(LOW32))


def universal(a: int, x: Column, bits: int = 32) -> Column:
    return F.shiftright(low_product(a, x), 32 - bits)


def vector_hash(coefficients: list[int], values: list[Column]) -> Column:
    total = sum((low_product(a, v) for a, v in zip(coefficients, values, strict=True)), F.lit(0).cast("long"))
    return total.bitwiseAND(F.lit(LOW32))


def bucket(projection: Column, pow2: int) -> Column:
    return F.shiftright(projection, 32 - pow2).cast("int")


def keyed(high: Column, low: Column, key1: tuple[Column, Column], key2: tuple[Column, Column]) -> Column:
    """((c xor key1) * key2) modulo 2**64 as 16 hex digits; all values are given as halves of 32 bits."""
    xh, xl = high.bitwiseXOR(key1[0]), low.bitwiseXOR(key1[1])
    kh, kl = key2
    p0, p1 = xl * kl.bitwiseAND(F.lit(0xFFFF)), xl * F.shiftright(kl, 16)
    t = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
    top = (F.shiftright(t, 32) + F.shiftright(p1, 16) + low_product(kh, xl) + low_product(kl, xh)).bitwiseAND(F.lit(LOW32))
    digits = lambda c: F.lpad(F.hex(c), 8, "0")
    return F.concat(digits(top), digits(t.bitwiseAND(F.lit(LOW32))))


def task_key(task: Column, secret: str, which: int) -> tuple[Column, Column]:
    """A fresh key for each task, as halves; the second one is odd, so that no two ciphers of a task coincide."""
    high, low = halves64(F.concat(F.lit(f"{secret}:{which}:"), task))
    return high, low.bitwiseOR(F.lit(1)) if which == 2 else low


def informative(seq: Column, w: int) -> Column:
    """At most w div 50 N, at most one base absent and at most one with fewer than 5 occurrences."""
    count = {b: F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit(""))) for b in "ACGTN"}
    rare = lambda least: sum(((count[b] < least).cast("int") for b in "ACGT"), F.lit(0))
    return (count["N"] <= w // 50) & (rare(1) <= 1) & (rare(5) <= 1)


def in_range(a: Column, b: Column, d: int) -> Column:
    return F.abs(a - b) <= d


def in_interval(pos: Column, start: Column, length: Column) -> Column:
    return pos.between(start, start + length)


def in_range_asymmetric(a: Column, b: Column, before: int, after: int) -> Column:
    return (a > F.greatest(b - before, F.lit(0))) & (a < b + after)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sampled_bases(seq: Column, indexes: list[int]) -> Column:
    return F.concat(*[F.substring(seq, i + 1, 1) for i in indexes])


def register(spark: SparkSession) -> None:
    """SQL functions seq_encode, seq_revcomp, kmers and kmer_hash32."""
    spark.sql("create or replace temporary function seq_encode(s string) returns string return regexp_replace(upper(s), '[^ACGT]', 'N')")
    spark.sql("create or replace temporary function seq_revcomp(s string) returns string return reverse(translate(s, 'ACGT', 'TGCA'))")
    spark.sql("create or replace temporary function kmers(s string, k int) returns array<string> return if(length(s) < k, array(), transform(sequence(1, length(s) - k + 1), i -> substr(s, i, k)))")
    spark.sql("create or replace temporary function kmer_hash32(s string) returns bigint return cast(conv(substr(sha1(s), 1, 8), 16, 10) as bigint)")
