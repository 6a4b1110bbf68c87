"""Sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_months(df: DataFrame, path: str, period: str = "time_key") -> None:
    """Parquet by month; months in ``df`` replace those there, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def missing_months(df: DataFrame, path: str, period: str = "time_key") -> DataFrame:
    """The rows of months that ``path`` does not hold yet; all of them if it is empty or absent."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target) or not any(s.getPath().getName().startswith(f"{period}=") for s in fs.listStatus(target)):
        return df
    done = [s.getPath().getName().partition("=")[2] for s in fs.listStatus(target) if s.isDirectory()]
    return df.filter(~F.col(period).isin(done))


def save_table(df: DataFrame, name: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").format("parquet").option("compression", "snappy")
    (w.partitionBy(*by) if by else w).saveAsTable(name)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table bucketed and sorted by keys, so that later joins and groupings on them need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def write_report(path: str, report: dict) -> None:
    """A small JSON report on the driver's side."""
    Path(path).write_text(json.dumps(report, indent=1, sort_keys=True, default=str))


def save_ladder(ladder: DataFrame, thresholds: DataFrame, path: str) -> None:
    ladder.write.mode("overwrite").parquet(f"{path}/ladder")
    thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")


def load_ladder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/ladder"), spark.read.parquet(f"{path}/thresholds")


def ladder_from_flags(flags: DataFrame, prefix: str = "in_") -> DataFrame:
    """(version, node) from a table with a flag column for each tier, given as booleans, 0/1 or text."""
    tiers = [c for c in flags.columns if c.startswith(prefix)]
    on = lambda c: F.lower(F.trim(F.col(c).cast("string"))).isin("true", "1", "1.0", "t", "yes", "y")
    each = F.explode(F.array_compact(F.array(*[F.when(on(c), F.lit(c[len(prefix) :])) for c in tiers])))
    return flags.select(each.alias("version"), "node")


def retire_version(panel: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(the panel without a version, a dry run: rows to go and to stay by month)."""
    gone = F.col("version") == version
    return panel.filter(~F.coalesce(gone, F.lit(False))), panel.groupBy("time_key").agg(F.count_if(gone).alias("n_gone"), F.count_if(~F.coalesce(gone, F.lit(False))).alias("n_kept"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save_state(df: DataFrame, path: str) -> None:
    """Replaces a table as a whole: the new one is written beside it and then renamed, so a reader finds the old or the new one. ``df`` may read the old one."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    (new, fs), (old, _), (gone, _) = _fs(spark, f"{path}.new"), _fs(spark, path), _fs(spark, f"{path}.old")
    fs.delete(gone, True)
    if fs.exists(old):
        fs.rename(old, gone)
    fs.rename(new, old)
    fs.delete(gone, True)


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of ``save_state``, or None before the first. A run that ended between the two renames left the old one under its other name; that is put back."""
    (old, fs), (gone, _) = _fs(spark, path), _fs(spark, f"{path}.old")
    if not fs.exists(old) and fs.exists(gone):
        fs.rename(gone, old)
    return spark.read.parquet(path) if fs.exists(old) else None


def apply_retirement(spark: SparkSession, path: str, version: str, backup: str) -> DataFrame:
    """Takes a version out of a panel in place, after a copy of the whole to ``backup``, which must not exist. Gives the report of the dry run."""
    panel = spark.read.parquet(path)
    panel.write.mode("errorifexists").parquet(backup)
    kept, report = retire_version(spark.read.parquet(backup), version)
    save_state(kept, path)
    return report


def projected_seconds(seconds: list[float], total: int, budget: float) -> tuple[float, bool]:
    """(seconds that all ``total`` months should take at the mean of those done, whether that is within ``budget``); 0 and True before the first."""
    if not seconds:
        return 0.0, True
    whole = sum(seconds) / len(seconds) * total
    return whole, whole <= budget
