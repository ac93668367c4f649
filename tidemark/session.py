"""Sessions, the driver's tables, and tables in the folder that all hosts of a cluster share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: list[str] = []
_WRITTEN: list[str] = []


def local_session(name: str = "tidemark", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library expects (UTC, adaptive plans)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder, by Spark's own reader, so any store that Spark reads will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this process's own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its hosts share")
    if not _OWN_FOLDER:
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN_FOLDER.append(f"file://{folder}")
    return _OWN_FOLDER[0]


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/tidemark-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table", codec: str = "zstd") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: computed once, whatever executors are lost later."""
    path = new_folder(df.sparkSession, what)
    _WRITTEN.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the tables that written() made in this process, once the results that read them have been stored; how many."""
    gone = len(_WRITTEN)
    while _WRITTEN:
        delete_folder(spark, _WRITTEN.pop())
    return gone


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
