"""Helpers shared by the corpus operators: reading, shared-folder materialisation, checked broadcast."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in estimated bytes, that an operator broadcasts. Beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


_shipped: set[str] = set()
_local: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        path = Path(tempfile.mkdtemp()) / "helixframe.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted((root / "helixframe").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where it is unset, local mode takes a temporary folder; on a
    cluster, whose executors do not see each other's disks, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="helixframe-"))
        atexit.register(shutil.rmtree, _local[0][7:], ignore_errors=True)
    return _local[0]


def written(df: DataFrame, label: str = "t", codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back. forget() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    # shuffle files go when the JVM finds that no plan holds them; without this that may be after the disk is full
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what written() has stored. No query over these tables may run any more; other DataFrames are left alone."""
    for df in tables:
        if path := vars(df).get("_stored"):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, in whatever case."""
    taken, n = {c.lower() for c in df.columns}, 0
    while f"_{base}{n}" in taken:
        n += 1
    return f"_{base}{n}"


def small_side(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows fit BROADCAST_BYTES, else df as it is (the join then shuffles)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def give_back() -> None:
    """Returns what this worker has freed to the system. Idle workers stay for a minute, and count for their executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(kernel):
    """The kernel over batches; at its end the worker gives back what it has freed."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def lean_group(kernel):
    """The same for a kernel over one table."""

    def run(t):
        try:
            return kernel(t)
        finally:
            give_back()

    return run
