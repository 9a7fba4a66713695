"""Tables in the folder that all executors share: they cut long plans and survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        path = Path(tempfile.mkdtemp()) / "helixframe_engine.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted((root / "helixframe").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)


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
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what written() has stored. No query over these tables may run any more; other DataFrames are left alone."""
    for df in tables:
        if path := vars(df).get("_stored"):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
