"""Session, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str | int = "*", name: str = "flowquarry", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with; on a cluster use the cluster's own."""
    options = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=options).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without that setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = spark.conf.get("spark.flowquarry.localFolder", None)
    if not folder:
        own = tempfile.mkdtemp(prefix="flowquarry-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.flowquarry.localFolder", folder)
    return folder


_CUTS: dict[str, list[str]] = {}


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_cuts(spark: SparkSession) -> None:
    """Deletes the tables this session's application has cut. To be called when no result that reads them is still to come."""
    for path in _CUTS.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again; the result survives lost executors.

    The table stays until ``drop_cuts``, as results that read it may still be lazy.
    """
    return _write(df, label)[0]


class Latest:
    """Cuts the states of an iteration one after the other; only the last ``keep`` tables stay, so disk holds no more however many rounds there are."""

    def __init__(self, label: str, keep: int = 1):
        self.label, self.keep = label, keep
        self.paths: list[str] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        out, path = _write(df, self.label)
        self.paths.append(path)
        while len(self.paths) > self.keep:
            old = self.paths.pop(0)
            _CUTS[df.sparkSession.sparkContext.applicationId].remove(old)
            delete(df.sparkSession, old)
        return out


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` persisted for the time of a loop that reads it every round, so it keeps its partitioning. Results must be cut before it ends."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()
