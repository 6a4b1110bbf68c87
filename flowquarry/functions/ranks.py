"""Ranks over groups of any size, without a window over a whole group.

Rows are first counted by value; values fall into buckets by magnitude; a window over a group's few thousand buckets gives each bucket the rows below it; and
only the different values within one bucket share a window. Groups, equal values and orders of magnitude may each hold most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEPS = 64


def _bucket(v: Column) -> Column:
    """Ascending with the value; 64 buckets for each power of e."""
    v = v.cast("double")
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * STEPS)).cast("bigint")


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, before, total): for each non-null value of a group, its rows, the rows with smaller values, and the group's rows."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).withColumn("__b", _bucket(F.col(value)))
    sums = per.groupBy(*keys, "__b").agg(F.sum("n").alias("__n"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    low = F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*keys, "__b", low.alias("__low"), F.sum("__n").over(w).alias("total"))
    inner = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "__b"]]
    joined = per.alias("p").join(offsets.alias("o"), same).select("p.*", "o.__low", "o.total")
    return joined.select(*keys, value, "n", (F.col("__low") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("before"), "total")


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(keys, a column for each name in ``probs``): exact quantiles with linear interpolation. No group's values meet in one task; groups without a value are missing, as is the one group of no keys."""
    r = value_ranks(df, keys, value)
    at = {name: F.lit(float(p)) * (F.col("total") - 1) for name, p in probs.items()}
    held = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value).cast("double")))
    aggs = [x for name, h in at.items() for x in (held(F.floor(h)).alias(f"__lo_{name}"), held(F.ceil(h)).alias(f"__hi_{name}"))]
    out = r.groupBy(*keys).agg(F.max("total").alias("total"), *aggs).filter("total is not null")
    part = {name: h - F.floor(h) for name, h in at.items()}
    return out.select(*keys, *[(F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * part[name]).alias(name) for name in probs])


def quantile(df: DataFrame, value: str | Column, p: float) -> Column:
    """The quantile of a whole column, as a scalar."""
    v = df.select((F.col(value) if isinstance(value, str) else value).alias("__q"))
    return group_quantiles(v, [], "__q", {"q": p}).scalar()


def with_average_rank(df: DataFrame, keys: list[str], value: str, rank: str, share: str | None = None) -> DataFrame:
    """Adds the rank with ties averaged (1 is lowest), as pandas' rank(), and if asked its share of the group, rank(pct=True). Null values have null ranks."""
    r = value_ranks(df, keys, value)
    avg = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    out = [avg.alias(rank)] + ([(avg / F.col("total")).alias(share)] if share else [])
    r = r.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__v"), *out)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col(value) == F.col("__v")]
    return df.join(r, same, "left").drop("__v", *[f"__k{i}" for i in range(len(keys))])


def top_sum(ranks: DataFrame, keys: list[str], value: str, most: Column) -> Column:
    """Aggregate over ``value_ranks``: the sum of a group's ``most`` largest values; equal values at the edge are interchangeable."""
    above = F.col("total") - F.col("before") - F.col("n")
    return F.sum(F.greatest(F.lit(0), F.least(F.col("n"), most - above)) * F.col(value))
