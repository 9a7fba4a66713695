"""Benchmark decontamination: prefix-filtered set join with exact verification over item-sized windows.

A window is 10 consecutive item words (all words of a shorter item). Its tokens are 3-word shingles, ordered by rarity in
the corpus; exact containment needs every token, so the rarest one is the necessary prefix. A document position joins a
window on that token only if the window, placed by the token's offset, fits inside the document (length and position
bounds), and all its words are then compared. Frequent passages cost one row per occurrence and window.
Null texts have no words. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import fresh, small_side, written

WINDOW, SHINGLE = 10, 3
#: Positions are first looked up in a table of this many bits; a fixed size, however large the benchmark is.
BITS = 1 << 20


def words_of(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""), F.array().cast("array<string>"))


def shingles(words: Column, k: int) -> Column:
    """64-bit hashes of k consecutive words, one for each position that has them."""
    n = F.size(words) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: win (words), k (words of a token), with the sorted ids of the items that have them."""
    worded = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    each = worded.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(WINDOW)))).alias("win"))
    return each.distinct().withColumn("k", F.least(F.size("win"), F.lit(SHINGLE)))


def hit_rows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(documents with key and words, verified occurrences: key, start, size, item)."""
    spark = docs.sparkSession
    windows = written(item_windows(items, item_id, item_text), "windows")
    # written, so that no later lambda evaluates the splitting again for each position
    base = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words_of(F.col(text_col)).alias("w")), "words")
    hits = None
    for (k,) in windows.select("k").distinct().orderBy("k").collect():  # at most SHINGLE rows
        of_k = windows.where(F.col("k") == k)
        tokens = of_k.select("win", F.posexplode(shingles(F.col("win"), k)).alias("off", "tok")).distinct()
        slots = tokens.select(F.pmod("tok", F.lit(BITS)).cast("int").alias("s")).distinct().collect()  # at most BITS rows
        bits = bytearray(BITS)
        for (s,) in slots:
            bits[s] = 1
        table, one = F.lit(bits), F.lit(bytearray(b"\x01"))
        marked = base.withColumn("at", F.filter(F.transform(shingles(F.col("w"), k), lambda t, i: F.struct(i.alias("i"), t.alias("t"))),
                                                lambda z: F.substr(table, F.pmod(z["t"], F.lit(BITS)).cast("int") + 1, F.lit(1)) == one))
        span = lambda z: F.struct(
            z["i"].alias("pos"), z["t"].alias("tok"), F.least(z["i"], F.lit(WINDOW - k)).alias("before"),
            F.slice(F.col("w"), F.greatest(z["i"] - (WINDOW - k), F.lit(0)) + 1, F.lit(2 * WINDOW - k)).alias("near"))
        spots = written(marked.select("id", "h", F.explode_outer(F.transform("at", span)).alias("z")).where("z is not null").select("id", "h", "z.*"), "spots")
        # the outer form keeps the optimizer from evaluating the array once more to filter empty ones
        # rarity: occurrences in the corpus; tokens that occur nowhere rule their windows out
        seen = spots.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
        ranked = tokens.join(small_side(tokens.select("tok").distinct().join(seen, "tok", "left"), 24), "tok")
        order = Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "tok", "off")
        anchors = written(ranked.withColumn("r", F.row_number().over(order)).where("r = 1 and n > 0").select("win", "off", "tok"), "anchors")
        placed = spots.join(small_side(anchors, 256), "tok")
        size = F.size("win")
        fits = (F.col("before") >= F.col("off")) & (F.size("near") - F.col("before") >= size - F.col("off"))
        same = placed.where(fits).where(F.slice("near", F.col("before") - F.col("off") + 1, size) == F.col("win"))
        found = same.select("id", "h", (F.col("pos") - F.col("off")).alias("start"), size.alias("size"), "win").join(small_side(of_k.select("win", "item"), 256), "win").drop("win")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        schema = base.select("id", "h").schema.add("start", "int").add("size", "int").add("item", items.schema[item_id].dataType)
        hits = spark.createDataFrame([], schema)
    return base, hits


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items_sha256, contaminated. Repeated rows repeat."""
    base, hits = hit_rows(docs, items, id_col, text_col, item_id, item_text)
    spans = F.sort_array(F.collect_set(F.struct("start", "size")))
    per = hits.groupBy("id", "h").agg(spans.alias("spans"), F.collect_set(F.col("item").cast("string")).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["start"] + s["size"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], s["start"] + s["size"]).alias("end"))
    per = per.select("id", "h", F.aggregate("spans", zero, step)["n"].alias("n_hit"), F.size("items").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("names"))
    # documents without a match go past the join: it holds only matched ones and bare counts
    joined = base.select("id", "h", F.size("w").alias("n_words")).join(per.withColumnRenamed("id", "pid").withColumnRenamed("h", "ph"), F.col("id").eqNullSafe(F.col("pid")) & (F.col("h") == F.col("ph")), "left")
    return joined.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.encode(F.coalesce("names", F.lit("")), "utf-8"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.col("h").alias("text_hash"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a benchmark window; rows with a null id are judged by their texts too. Columns stay as they are."""
    i, t = fresh(docs, "i"), fresh(docs, "t")
    bad = contamination(docs, items, id_col, text_col).where("contaminated").select(F.col(id_col).alias(i), F.col("text_hash").alias(t)).distinct()
    return docs.join(bad, F.col(i).eqNullSafe(F.col(id_col)) & (F.col(t) == F.xxhash64(text_col)), "left_anti")
