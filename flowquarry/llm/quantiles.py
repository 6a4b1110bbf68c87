"""Percentiles with a guaranteed relative error from counts in signed logarithmic buckets.

A sketch is a table (keys, bucket, n). Bucket i > 0 holds values in (g^(i-1), g^i] with g = (1 + alpha) / (1 - alpha),
shifted so that all indexes of positive values are positive; negative values have the negative index and 0 has bucket 0.
Sketches of the same alpha merge by adding counts. The estimate of the q-quantile lies within alpha * |x| of x, the value of
rank floor(q * (n - 1)) among the n sorted values.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHIFT = 1 << 40


def _log_gamma(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return math.log((1 + alpha) / (1 - alpha))


def bucket(value: Column, alpha: float) -> Column:
    """The signed bucket of a value; null for null and non-finite values."""
    v = value.cast("double")
    i = F.ceil(F.log(F.abs(v)) / F.lit(_log_gamma(alpha))).cast("bigint") + SHIFT
    finite = ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))
    return F.when(finite, F.when(v > 0, i).when(v < 0, -i).otherwise(F.lit(0).cast("bigint")))


def bucket_value(b: Column, alpha: float) -> Column:
    """The value that stands for a bucket: off by at most alpha of any value in it (of subnormal ones, below 2.3e-308, as far as doubles can tell)."""
    log_g = _log_gamma(alpha)
    # The factor 2 / (g + 1) stands in the exponent, so that the last buckets before the end of the doubles don't overflow.
    size = F.least(F.exp((F.abs(b) - SHIFT) * F.lit(log_g) + F.lit(math.log(2.0 / (math.exp(log_g) + 1.0)))), F.lit(sys.float_info.max))
    return F.when(b == 0, 0.0).otherwise(F.signum(b) * size)


def sketch(df: DataFrame, keys: list[str], value: str, alpha: float = 0.01) -> DataFrame:
    """(keys, bucket, n): combined on the map side, so a group of any size is a few thousand rows a task. Null and non-finite values are left out."""
    rows = df.select(*keys, bucket(F.col(value), alpha).alias("bucket")).filter("bucket is not null")
    return rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def sketch_sets(df: DataFrame, sets: list[list[str]], value: str, alpha: float = 0.01) -> DataFrame:
    """Sketches of several groupings in one pass: columns of all groupings (null where not grouped by), ``set_id`` (0, 1, ...), bucket, n."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    rows = df.select(*keys, bucket(F.col(value), alpha).alias("bucket")).filter("bucket is not null")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("set_id"), *[(F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys]) for i, s in enumerate(sets)]))
    rows = rows.select(each.alias("x"), "bucket").select("x.*", "bucket")
    return rows.groupBy("set_id", *keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the counts of sketches over coarser or equal keys."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def bucket_bounds(b: Column, alpha: float) -> tuple[Column, Column]:
    """The least and the greatest value a bucket may hold; both 0 for bucket 0."""
    g = F.lit(_log_gamma(alpha))
    i = F.abs(b) - SHIFT
    near, far = F.exp((i - 1) * g), F.least(F.exp(i * g), F.lit(sys.float_info.max))
    return F.when(b == 0, 0.0).when(b > 0, near).otherwise(-far), F.when(b == 0, 0.0).when(b > 0, far).otherwise(-near)


def quantiles(sketches: DataFrame, keys: list[str], probs: dict[str, float], alpha: float = 0.01, bounds: bool = False) -> DataFrame:
    """(keys, n, alpha, one column for each name in ``probs``), unrounded: each value is off by at most alpha of the true one.

    With ``bounds`` also ``<name>_low`` and ``<name>_high``, between which the true value lies. A group has at most a few thousand buckets, whatever its rows.
    """
    by = Window.partitionBy(*keys)
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = sketches.select(*keys, "bucket", F.sum("n").over(upto).alias("cum"), F.sum("n").over(by).alias("total"))
    at = {name: F.min(F.when(F.col("cum") > F.floor(F.lit(p) * (F.col("total") - 1)), F.col("bucket"))) for name, p in probs.items()}
    out = cum.groupBy(*keys).agg(F.max("total").alias("n"), *[c.alias(name) for name, c in at.items()])
    sides = {}
    for name in probs:
        low, high = bucket_bounds(F.col(name), alpha)
        sides |= {f"{name}_low": low, f"{name}_high": high} if bounds else {}
    values = {name: bucket_value(F.col(name), alpha) for name in probs}
    return out.select(*keys, "n", F.lit(alpha).alias("alpha"), *[c.alias(name) for name, c in values.items()], *[c.alias(name) for name, c in sides.items()])
