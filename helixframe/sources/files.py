"""FASTA and FASTQ in, SAM out, and stores for what is computed once. All read and write through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import sequence as sq
from helixframe.params import AlignParams


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, name (the whole header), seq. A record is one row: files are cut at line starts with '>'."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    record = F.regexp_replace("value", "^>", "")
    parts = raw.where(F.trim("value") != "").select("file", "at", F.split(record, "\n", 2).alias("z"))
    named = parts.select("file", "at", F.regexp_replace(F.col("z")[0], "\r$", "").alias("name"), F.coalesce(F.try_element_at("z", F.lit(2)), F.lit("")).alias("body"))
    rows = named.select("file", "at", "name", sq.encode(F.regexp_replace("body", "[\r\n]", "")).alias("seq"))
    return rows.select((F.row_number().over(Window.orderBy("file", "at")) - 1).cast("long").alias("seq_id"), "name", "seq")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value. Lines are numbered within their partition after the counts of the partitions before it, one row a
    partition."""
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    first = raw.groupBy("file", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = first.select("file", "part", "first", (F.sum("n").over(Window.partitionBy("file").orderBy("first")) - F.col("n")).alias("before"))
    return raw.join(F.broadcast(before), ["file", "part"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line"), "value")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """rid, name, seq, qual, len. Four lines a record; a record whose qualities are of another length is an error."""
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    pick = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    records = lines.groupBy("file", F.floor(F.col("line") / 4).alias("nth")).agg(pick(0).alias("head"), pick(1).alias("seq"), pick(3).alias("qual"))
    sizes = records.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    fits = F.length("seq") == F.length(F.coalesce("qual", F.lit("")))
    out = records.where("head <> ''").join(F.broadcast(before), "file")
    seq = F.when(fits & F.startswith("head", F.lit("@")), sq.encode(F.col("seq"))).otherwise(F.raise_error(F.concat(F.lit("bad FASTQ record "), "head")).cast("string"))
    return out.select((F.col("before") + F.col("nth")).alias("rid"), F.substring("head", 2, 1 << 30).alias("name"), seq.alias("seq"), "qual").withColumn("len", F.length("seq"))


def truth(reads: DataFrame) -> DataFrame:
    """rid, chromosome, left, right from simulated read names: chr_left_right_..., X is 23."""
    part = F.split("name", "_")
    chromosome = F.when(part[0].isin("X", "chrX"), 23).otherwise(F.regexp_replace(part[0], "^chr", "").try_cast("int"))
    return reads.select("rid", chromosome.alias("chromosome"), part[1].try_cast("long").alias("left"), part[2].try_cast("long").alias("right"))


def global_truth(found: DataFrame, placed: DataFrame) -> DataFrame:
    """rid, true_start: the left end plus the offset of its sequence, the first of which is chromosome 1."""
    return found.join(placed, F.col("seq_id") == F.col("chromosome") - 1).select("rid", (F.col("left") - 1 + F.col("offset")).alias("true_start"))


def write_sam(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated lines without a header, by read within each file."""
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value")).sortWithinPartitions("value").write.mode(mode).text(path)


def write_counts(hist: DataFrame, path: str) -> None:
    hist.select("cnt").write.mode("overwrite").csv(path)


class Store:
    """Tables kept under a folder and the parameters they were made with: histogram, windows, index, voting hashes, contigs."""

    def __init__(self, spark: SparkSession, folder: str, params: AlignParams):
        self.spark, self.root = spark, f"{folder.rstrip('/')}/{params.name}"

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def save(self, name: str, df: DataFrame, by: list[str] | None = None) -> None:
        out = df.sortWithinPartitions("bucket", "proj", "pos") if name == "index" else df
        out.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{self.root}/{name}")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def get(self, name: str, make, by: list[str] | None = None) -> DataFrame:
        """Loads the table, made and saved first if it isn't there."""
        if not self.has(name):
            self.save(name, make(), by)
        return self.load(name)


