"""What the training-data operators share: reading tables, shipping this package, the shared folder."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch. Texts may be long, so a batch is kept to a few MB.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark's own reader, whatever store it is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors once per application and bound the Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_sparkcell_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "sparkcell.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._sparkcell_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset in
    local mode (tests), a temporary folder of our own. On a cluster it has to be set."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(path)
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(sc, "_sparkcell_dir", None):
        sc._sparkcell_dir = tempfile.mkdtemp(prefix="sparkcell-")
        atexit.register(shutil.rmtree, sc._sparkcell_dir, True)
        sc.setCheckpointDir(sc._sparkcell_dir)
    return sc._sparkcell_dir


#: Tables that stored() has written and nothing has removed.
_tables: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.
    The table is there until remove() or the end of the program."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkcell/{name}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_remove_all, spark)
    _tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """The paths of the tables that are there, oldest first."""
    return [*_tables]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of stored() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _tables.remove(path)


def _remove_all(spark: SparkSession) -> None:
    try:
        remove(spark, tables())
    except Exception:  # the JVM is gone: there is no one to ask
        pass
