"""Totals and averages over trailing periods, quiet days included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_days(daily: DataFrame, node: Column, day: Column, amount: Column, order: Column) -> DataFrame:
    """One row (node, day, cents) for each node and day: that of the greatest ``order``.

    Rows without node or day are left out. Rows that tie on ``order`` are equal by contract; if they aren't, the
    largest amount counts, a null being the smallest.
    """
    rows = daily.select(node.alias("node"), day.alias("day"), F.struct(order.alias("o"), amount.alias("cents")).alias("v"))
    return (
        rows.filter("node is not null and day is not null")
        .groupBy("node", "day")
        .agg(F.max("v").alias("v"))
        .select("node", "day", F.col("v.cents").alias("cents"))
    )


def rolling_totals(days: DataFrame, last_day: Column, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For each node and each day from its first day with an amount above 0 through ``last_day``: trailing totals.

    ``days`` has (node, day, cents), one row a node and day. Each total is exploded onto every day it influences, at
    most ``max(windows)`` of them; calendar rows carry zeros into the same grouping, which is the left join of the
    calendar without a second shuffle. All of it runs in the one partitioning by node: a node has as many rows as
    there are days, so none can be large. Result: node, day, then for each window w ``total_w`` (cents), ``active_w``
    (days with an amount above 0) and ``avg_w`` (dollars a day). Null and zero amounts are no activity and nodes without
    any have no rows. An empty table gives an empty result.
    """
    longest = max(windows)
    active = days.filter("cents > 0").repartition("node")
    reach = F.least(F.date_add("day", longest - 1), last_day)
    spread = active.select("node", F.col("day").alias("from_day"), "cents", F.explode(F.sequence("day", reach)).alias("day"))
    age = F.datediff("day", "from_day")
    parts = spread.select(
        "node",
        "day",
        *[F.when(age < w, F.col("cents")).otherwise(0).cast("bigint").alias(f"total_{w}") for w in windows],
        *[F.when(age < w, 1).otherwise(0).cast("bigint").alias(f"active_{w}") for w in windows],
    )
    calendar = active.groupBy("node").agg(F.min("day").alias("first_day")).select("node", F.explode(F.sequence("first_day", last_day)).alias("day"))
    zeros = calendar.select("node", "day", *[F.lit(0).cast("bigint").alias(f"{k}_{w}") for k in ("total", "active") for w in windows])
    sums = parts.unionByName(zeros).groupBy("node", "day").agg(*[F.sum(f"{k}_{w}").alias(f"{k}_{w}") for k in ("total", "active") for w in windows])
    return sums.select("*", *[F.round(F.col(f"total_{w}") / F.lit(100 * w), 6).alias(f"avg_{w}") for w in windows])


def first_days(days: DataFrame) -> DataFrame:
    return days.filter("cents > 0").groupBy("node").agg(F.min("day").alias("first_day"))
