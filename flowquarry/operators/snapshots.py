"""What changed between full snapshots: validity intervals by gaps and islands, then change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def current_rows(df: DataFrame, key: str, order: str, columns: dict[str, Column]) -> DataFrame:
    """One row for each ``key``: that of the greatest ``order``. Ties are equal by contract; else the greatest in column order. Null keys are left out."""
    packed = F.struct(F.col(order).alias("__o"), *[c.alias(k) for k, c in columns.items()])
    rows = df.select(F.col(key).alias("__key"), packed.alias("v")).filter("__key is not null")
    return rows.groupBy("__key").agg(F.max("v").alias("v")).select("v.*").drop("__o")


def snapshot_ranks(df: DataFrame, period: str) -> Column:
    """The delivered periods in order, as an array: a scalar of one row, as long as there are snapshots."""
    return df.filter(F.col(period).isNotNull()).agg(F.array_sort(F.collect_set(period))).scalar()


def validity_intervals(rows: DataFrame, keys: list[str], period: str, row_hash: Column, periods: Column) -> DataFrame:
    """(keys, start_r, end_r): the runs of consecutive snapshots in which a key stands with the same hash. ``rows`` is unique by keys and period.

    A key has at most one row a snapshot, so no window partition is long. Ranks count from 1 in the order of delivery.
    """
    ranked = rows.select(*keys, F.array_position(periods, F.col(period)).cast("int").alias("__r"), row_hash.alias("__h"))
    w = Window.partitionBy(*keys).orderBy("__r")
    fresh = F.coalesce((F.lag("__r").over(w) != F.col("__r") - 1) | ~F.lag("__h").over(w).eqNullSafe(F.col("__h")), F.lit(True))
    marked = ranked.withColumn("__fresh", fresh.cast("int")).withColumn("__island", F.sum("__fresh").over(w))
    return marked.groupBy(*keys, "__island").agg(F.min("__r").alias("start_r"), F.max("__r").alias("end_r")).drop("__island")


def change_events(intervals: DataFrame, keys: list[str], periods: Column) -> DataFrame:
    """(keys, time_key, change_kind): ``added`` where an interval starts after a gap, ``changed`` where it meets the one before, ``removed`` after one that nothing follows.

    Starts in the first snapshot and ends in the last are no events. time_key is the later of the two snapshots.
    """
    w = Window.partitionBy(*keys).orderBy("start_r")
    met = intervals.select(*keys, "start_r", "end_r", F.lag("end_r").over(w).alias("before"), F.lead("start_r").over(w).alias("after"))
    begin = F.when(F.col("start_r") > 1, F.struct(F.col("start_r").alias("r"), F.when(F.col("before") == F.col("start_r") - 1, "changed").otherwise("added").alias("kind")))
    gone = (F.col("end_r") < F.size(periods)) & (F.col("after").isNull() | (F.col("after") > F.col("end_r") + 1))
    end = F.when(gone, F.struct((F.col("end_r") + 1).alias("r"), F.lit("removed").alias("kind")))
    events = met.select(*keys, F.explode(F.array_compact(F.array(begin, end))).alias("e"))
    return events.select(*keys, F.get(periods, F.col("e.r") - 1).alias("time_key"), F.col("e.kind").alias("change_kind"))
