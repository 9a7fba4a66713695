"""MinHash near-dedup by bottom-k sketches from one hash function.

Documents with equal shingle sets form one class, known by a 128-bit fingerprint of its set. Each class keeps the SKETCH
smallest shingle hashes. Its rarest retained values enter inverted lists: two sketches that share at least MIN_SHARED
values share one of the SKETCH - MIN_SHARED + 1 rarest (fewer values: a small set lists all that it must).

Every list has a head, the class whose retained values are commonest, that is, near the middle of a group of copies. Each
member is compared with the head on full sets, which gives its exact similarity and its differences D: the head's shingles that
it lacks and its own that the head lacks. The group then takes the member nearest to what most members have as its head, to
which the differences are converted exactly. With e = 100 * lacking + p * own and L = (100 - p) * |head| a member is linked with
the head if and only if e <= L, and members x, y are linked if and only if
    (100 + p) * |D(x) & D(y)| >= e(x) + e(y) - L.
So if x isn't linked with the head, D(x) and D(y) overlap by more than e(y) / (100 + p), and a prefix filter over differences,
the rarest first, finds y. Private differences match nothing and fill the prefixes, so a large group of copies costs about
its size, not its square. Union sketches then estimate the similarity of the pairs found, drop those that share under
MIN_UNION values, and the rule above verifies the rest. Lists and pairs have no caps.

Defined results. Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows stay as
many as given. Rows with equal ids but different texts are judged by their own texts. A null id takes part: its component is
the smallest id reachable that is not null, or null, and it is kept if that is null. A set is held as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm import textkernel as tk
from helixframe.llm.common import forget, fresh, small_side, written

SKETCH, MIN_SHARED = 32, 16

#: Values of SKETCH that union sketches share at least, or the pair is dropped: at similarity 0.80 fewer have a chance of 2.7e-8.
MIN_UNION = 12

#: Members that one task compares with a head at a time; a larger group is dealt over several tasks with its head in each.
SALT = 256

#: Sets one of the two kinds of differences apart.
_LACKING = np.uint64(0x5851F42D4C957F2D)


def set_hashes(text: str | bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; of the whole sequence if it is shorter."""
    data = np.frombuffer(text.encode() if isinstance(text, str) else text or b"", np.uint8)
    h, *_ = tk.word_hashes(data, np.array([0, len(data)]), tk.BLANKS)
    return shingle_set(h, k)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(tk.shingle_hashes(h, k) if len(h) >= k else tk.sequence_hash(h))


def column_sets(column: pa.Array, k: int):
    """The set of each text of a column, in order."""
    for i, j, data, offsets in tk.slices(column):
        h, _, _, first = tk.word_hashes(data, offsets, tk.BLANKS)
        for r in range(j - i):
            yield shingle_set(h[first[r] : first[r + 1]], k)


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a set, whatever the order."""
    with np.errstate(over="ignore"):
        return np.array([tk.mix(s).sum(), tk.mix(s * tk._M1 + np.uint64(len(s))).sum()], np.uint64).tobytes()


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """id, th (hash of the text), n_shingles, fp (of the set), sketch (its smallest hashes as signed longs)."""

    def run(batches):
        for batch in batches:
            n, fp, sketch = [], [], []
            for s in column_sets(batch.column(2), k):
                n.append(len(s))
                fp.append(fingerprint(s))
                sketch.append(s[:SKETCH].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], ["id", "th", "n_shingles", "fp", "sketch"])

    return docs.select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "id long, th long, n_shingles long, fp binary, sketch array<long>")


def ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(float(b)))


def listed(nodes: DataFrame, percent: int) -> DataFrame:
    """v, fp, score, f: the inverted lists. score adds up how common the class's retained values are."""
    values = nodes.select("fp", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    seen = values.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    per = values.join(seen, "v").groupBy("fp", "m").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vs"), F.sum("f").alias("score"))
    need = F.when(F.col("m") < SKETCH, F.ceil(F.col("m") * (percent / 100))).otherwise(MIN_SHARED)
    # a value that nobody shares is rarer than all others and takes part in no list
    take = F.greatest(F.lit(0), F.size("vs") - need + 1).cast("int")
    return per.select("fp", "score", F.explode(F.slice("vs", F.lit(1), take)).alias("z")).select("z.v", "fp", "score")


def compared(star: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """For each (h, fp): nh (size of the head), and the hashes that fp lacks and those it has of its own, by full sets.
    A head travels once per SALT members."""

    def run(batches):
        key, head, last = None, None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("h", "salt", "kind", "fp")]
            out = [[], [], [], [], []]
            for h, salt, kind, fp, s in zip(*cols, column_sets(batch.column(4), k), strict=True):
                if kind == 0:
                    key, head, last = (h, salt), s, None
                    continue
                if key != (h, salt):
                    raise ValueError("a member came before its head")
                if fp == last:  # a repeated row
                    continue
                last = fp
                for c, x in zip(out, (h, fp, len(head), np.setdiff1d(head, s, assume_unique=True).view(np.int64), np.setdiff1d(s, head, assume_unique=True).view(np.int64)), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["h", "fp", "nh", "lacks", "own"])

    salts = star.groupBy("h").agg(ceil_div(F.count(F.lit(1)), SALT).alias("salts"))
    dealt = written(star.join(salts, "h").withColumn("salt", F.pmod(F.xxhash64("fp"), "salts").cast("int")).drop("salts"), "dealt")
    heads = dealt.select("h", "salt").distinct().select("h", "salt", F.lit(0).alias("kind"), F.col("h").alias("fp"))
    wanted = heads.unionByName(dealt.select("h", "salt", F.lit(1).alias("kind"), "fp")).join(nodes.select("fp", "id", "th"), "fp")
    wanted = written(wanted.withColumnRenamed("id", "wid").withColumnRenamed("th", "wth"), "wanted")
    hashed = docs.where("text is not null").select("id", F.xxhash64("text").alias("th"), "text")
    both = hashed.join(small_side(wanted, 96), (F.col("th") == F.col("wth")) & F.col("id").eqNullSafe(F.col("wid"))).select("h", "salt", "kind", "fp", "text")
    ordered = both.repartition("h", "salt").sortWithinPartitions("h", "salt", "kind", "fp")
    met = written(ordered.mapInArrow(run, "h long, fp long, nh long, lacks array<long>, own array<long>"), "met")
    forget(dealt, wanted)
    return met


def priced(met: DataFrame, percent: int) -> DataFrame:
    """h (group), c (its head), fp, e, lim, linked, d (all differences: a hash is of the same kind in all members of a group)."""
    e = 100 * F.size("lacks").cast("long") + percent * F.size("own").cast("long")
    return met.select("h", "c", "fp", e.alias("e"), ((100 - percent) * F.col("nh")).alias("lim"), F.concat("lacks", "own").alias("d")).withColumn("linked", F.col("e") <= F.col("lim"))


def recentred(met: DataFrame, percent: int) -> DataFrame:
    """met with the group's head replaced by the member that is nearest to what most members have, from the differences
    alone. Fewer members differ from it by much. Groups whose members are all linked with the head are left out."""
    cost = 100 * F.size("lacks").cast("long") + percent * F.size("own").cast("long") > (100 - percent) * F.col("nh")
    groups = met.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max(cost).alias("some")).where("some").select("h", "m")
    met = met.join(groups, "h")
    token = met.select("h", "m", F.explode(F.concat("lacks", "own")).alias("w"))
    most = token.groupBy("h", "m", "w").agg(F.count(F.lit(1)).alias("f")).where("2 * f > m + 1").groupBy("h").agg(F.collect_list("w").alias("most"))
    near = met.join(most, "h")  # where most members differ in nothing, the head stays
    d = F.concat("lacks", "own")
    far = near.select("h", "fp", (F.size(d) + F.size("most") - 2 * F.size(F.array_intersect(d, "most"))).alias("far"), F.size("most").alias("now"))
    best = far.where("far < now").groupBy("h").agg(F.min(F.struct("far", "fp"))["fp"].alias("fp"))
    centre = met.join(best, ["h", "fp"]).select("h", F.col("fp").alias("c"), F.col("lacks").alias("cl"), F.col("own").alias("co"))
    none = F.array().cast("array<long>")
    every = met.select("h", "fp", "nh", "lacks", "own").unionByName(met.join(best.select("h"), "h", "left_semi").groupBy("h").agg(F.max("nh").alias("nh")).select("h", F.col("h").alias("fp"), "nh", none.alias("lacks"), none.alias("own")))
    moved = every.join(centre, "h", "left").where("c is null or c <> fp")
    lacks = F.when(F.col("c").isNull(), F.col("lacks")).otherwise(F.concat(F.array_except("lacks", "cl"), F.array_except("co", "own")))
    own = F.when(F.col("c").isNull(), F.col("own")).otherwise(F.concat(F.array_except("own", "co"), F.array_except("cl", "lacks")))
    size = F.when(F.col("c").isNull(), F.col("nh")).otherwise(F.col("nh") - F.size("cl") + F.size("co"))
    return moved.select(F.coalesce("c", "h").alias("c"), "h", "fp", size.alias("nh"), lacks.alias("lacks"), own.alias("own"))


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and union sketches allow the similarity."""
    side = lambda s: nodes.select(F.col("fp").alias(s), F.col("n_shingles").alias("n" + s), F.col("sketch").alias("s" + s))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    order = lambda x, y: F.when(x.bitwiseXOR(F.lit(-(1 << 63))) < y.bitwiseXOR(F.lit(-(1 << 63))), -1).when(x == y, 0).otherwise(1)
    union = F.slice(F.array_sort(F.array_union("sa", "sb"), order), 1, SKETCH)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    # a union of fewer values is the whole union: the estimate is exact
    return both.where(F.when(F.size(union) < SKETCH, 100 * shared >= percent * F.size(union)).otherwise(shared >= MIN_UNION)).select(*pairs.columns)


def across(met: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """h, a, b: members of h's group in different components, one not linked with h, whose differences may overlap enough."""
    member = met.join(label.withColumnRenamed("id", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    live = member.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(~F.col("linked")).alias("some"), F.min("e").alias("least")).where("lo < hi and some")
    member = member.join(live.select("h", "least"), "h")
    token = member.select("h", "fp", "e", "lim", "comp", "linked", "least", F.size("d").alias("m"), F.explode("d").alias("w"))
    common = token.groupBy("h", "w").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    per = token.join(common, ["h", "w"]).groupBy("h", "fp", "e", "lim", "comp", "linked", "least", "m").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("ws"))
    # of a pair y is the one with the smaller e, x is not linked; private differences come first and match nothing
    least_overlap = lambda mine, other: F.greatest(F.lit(1), ceil_div(mine + other - F.col("lim"), 100 + percent))
    prefix = lambda overlap: F.explode(F.slice("ws", F.lit(1), F.greatest(F.lit(0), F.size("ws") - overlap + 1).cast("int")))
    held = per.select("h", F.col("fp").alias("y"), F.col("e").alias("ey"), F.col("comp").alias("cy"), prefix(least_overlap(F.col("e"), F.greatest(F.col("e"), F.col("lim") + 1))).alias("z")).select("h", "y", "ey", "cy", "z.w")
    asked = per.where("not linked").select("h", F.col("fp").alias("x"), F.col("e").alias("ex"), F.col("comp").alias("cx"), prefix(least_overlap(F.col("e"), F.col("least"))).alias("z")).select("h", "x", "ex", "cx", "z.w")
    found = asked.join(held, ["h", "w"]).where("cx <> cy and (ey < ex or (ey = ex and y < x))")
    return found.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("h").alias("h"))


def verified(pairs: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity, by their differences from a head of both."""
    side = lambda s: met.select("h", F.col("fp").alias(s), F.col("e").alias("e" + s), F.col("d").alias("d" + s), *([F.col("lim")] if s == "a" else []))
    both = pairs.join(side("a"), ["h", "a"]).join(side("b"), ["h", "b"])
    return both.where((100 + percent) * F.size(F.array_intersect("da", "db")) >= F.col("ea") + F.col("eb") - F.col("lim")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """id, comp for every end of an edge: smallest reachable number. Labels go over edges and then jump to their label's label,
    until nothing changes."""
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("comp")), "label")
    changed = label.limit(1).count()
    while changed:
        near = both.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = label.join(near, "id").select("id", "comp", F.least("comp", "near").alias("new"))
        jump = label.select(F.col("id").alias("new"), F.col("comp").alias("far"))
        new = F.least("new", F.coalesce("far", "new"))
        moved = written(step.join(jump, "new", "left").select("id", new.alias("comp"), (F.col("comp") != new).alias("moved")), "label")
        changed = moved.where("moved").limit(1).count()
        forget(label)
        label = moved.select("id", "comp")
        label._stored = moved._stored
    forget(both)
    return label


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept, group_key (null without words), text_hash."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(sketched(base, k), "sketched")
    full = rows.where("n_shingles > 0")
    # from here on a class goes by a number, which is half as long as its fingerprint
    classes = full.select(F.col("fp").alias("key"), "id", "th", "n_shingles", "sketch").dropDuplicates(["key"])
    nodes = written(classes.withColumn("fp", F.monotonically_increasing_id()), "classes")
    lists = written(listed(nodes, percent), "lists")
    heads = lists.groupBy("v").agg(F.max(F.struct("score", "fp"))["fp"].alias("h"))
    star = written(lists.join(heads, "v").where("h <> fp").select("h", "fp").distinct(), "star")
    met = compared(star, nodes, base, k, percent)
    forget(lists, star)
    again = written(recentred(met, percent), "again")
    linked = priced(met.withColumn("c", F.col("h")), percent).unionByName(priced(again, percent)).where("linked")
    first = components(linked.select(F.col("c").alias("a"), F.col("fp").alias("b")).distinct())
    met_again = priced(again, percent)
    pairs = estimated(across(met_again, first, percent), nodes, percent)
    links = written(verified(pairs, met_again, percent), "links")
    # the second links join components, so the graph is contracted first
    of = lambda s: first.select(F.col("id").alias(s), F.col("comp").alias("c" + s))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    second = components(joined)
    whole = first.unionByName(second.join(first.select("id"), "id", "left_anti").select("id", F.col("id").alias("comp")))
    label = whole.join(second.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left").select(F.col("id").alias("fp"), F.coalesce("top", "comp").alias("comp"))
    label = written(label, "components")
    forget(met, again, links, first, second)
    smallest = full.groupBy(F.col("fp").alias("key")).agg(F.min("id").alias("id")).join(nodes.select("key", "fp"), "key")
    smallest = written(smallest.join(label, "fp", "left").select("key", "id", F.coalesce("comp", "fp").alias("comp")), "smallest")
    least = smallest.groupBy("comp").agg(F.min("id").alias("component_id"))
    place = smallest.join(least, "comp").select(F.col("key").alias("fp"), "comp", "component_id")
    forget(nodes, label)
    out = rows.select("id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("fp")).alias("fp")).join(place, "fp", "left")
    out = out.withColumn("component_id", F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("comp").alias("group_key"), F.col("th").alias("text_hash"))


def without_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group the row with the smallest id that is not null stays, of rows with that id the one with the smallest text
    hash, once. Rows without words are in no group and stay, equal ones (id and text) once. Columns stay as they are."""
    found = written(near_duplicates(docs, k, percent, id_col, text_col).select(F.col(id_col).alias("i"), F.col("text_hash").alias("t"), "group_key"), "found")
    first = found.where("group_key is not null").groupBy("group_key").agg(F.min(F.struct(F.col("i").isNull().alias("last"), "i", "t")).alias("m")).select("m.i", "m.t")
    keys = first.unionByName(found.where("group_key is null").select("i", "t").distinct())
    i, t, x = (fresh(docs, c) for c in ("i", "t", "x"))
    same = F.col(i).eqNullSafe(F.col(id_col).cast("long")) & (F.col(t) == F.col(x))
    rows = docs.withColumn(x, F.xxhash64(text_col)).join(keys.select(F.col("i").alias(i), F.col("t").alias(t)), same, "left_semi")
    repeated = found.groupBy("i", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("i").alias(i), F.col("t").alias(t))
    if repeated.limit(1).count():
        rows = rows.join(repeated, same, "left_anti").unionByName(rows.join(repeated, same, "left_semi").dropDuplicates([id_col, x]))
    return rows.select(*docs.columns)
