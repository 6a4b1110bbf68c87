"""Statistics as aggregates over DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions.ranks import group_quantiles, value_ranks, with_average_rank


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 by the rational formula 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mann_kendall(series: DataFrame, key: str, t: str, x: str, least: int = 4) -> DataFrame:
    """(key, n, s, z, p) of the trend test with ties, for keys of at least ``least`` points; the pairs are those of one key's months, which are few."""
    a = series.select(key, F.col(t).alias("t1"), F.col(x).alias("x1"))
    b = series.select(key, F.col(t).alias("t2"), F.col(x).alias("x2"))
    s = a.join(b, key).filter("t1 < t2").groupBy(key).agg(F.sum(F.signum(F.col("x2") - F.col("x1"))).cast("bigint").alias("s"))
    tie = series.groupBy(key, x).agg(F.count(F.lit(1)).alias("g"))
    g, n = F.col("g"), F.col("n")
    tie = tie.groupBy(key).agg(F.sum("g").alias("n"), F.sum(g * (g - 1) * (2 * g + 5)).alias("ties"))
    j = tie.join(s, key).filter(n >= least)
    var = (n * (n - 1) * (2 * n + 5) - F.col("ties")) / F.lit(18.0)
    z = F.when(var > 0, (F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt(F.greatest(var, F.lit(1e-12)))).otherwise(0.0)
    j = j.withColumn("zz", z)
    return j.select(key, "n", "s", F.round("zz", 6).alias("z"), F.round(erfc(F.abs("zz") / math.sqrt(2.0)), 6).alias("p"))


def theil_sen(series: DataFrame, key: str, t: str, x: str) -> DataFrame:
    """(key, slope): median of the pairwise slopes of a key's points."""
    a = series.select(key, F.col(t).alias("t1"), F.col(x).alias("x1"))
    b = series.select(key, F.col(t).alias("t2"), F.col(x).alias("x2"))
    return a.join(b, key).filter("t1 < t2").select(key, ((F.col("x2") - F.col("x1")) / (F.col("t2") - F.col("t1"))).alias("m")).groupBy(key).agg(F.round(F.percentile("m", F.lit(0.5)), 4).alias("slope"))


def benjamini_hochberg(tests: DataFrame, p: str, q: float = 0.1) -> DataFrame:
    """Adds ``passes``: p at most the largest p that lies under rank * q / n. Ranks come from counts of distinct p, so no window holds all tests."""
    # p counts to six digits, so there are at most a million values in this window, whatever the number of tests.
    six = F.round(p, 6)
    n = tests.filter(F.col(p).isNotNull()).groupBy(six.alias("p")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    total = n.agg(F.sum("k")).scalar()
    cut_at = n.withColumn("r", upto).filter(F.col("p") <= F.col("r") * q / total).agg(F.max("p")).scalar()
    return tests.withColumn("passes", F.coalesce(six <= cut_at, F.lit(False)))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, digits: int = 6) -> DataFrame:
    """(keys, n, rho): correlation of average ranks over rows with both values."""
    r = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    r = with_average_rank(with_average_rank(r, keys, x, "__rx"), keys, y, "__ry")
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("__rx", "__ry"), digits).alias("rho"))


def within_corr(df: DataFrame, key: str, x: str, y: str, least: int = 8, digits: int = 6) -> DataFrame:
    """One row (n_keys, n, r): correlation of both variables less each key's mean, over keys of at least ``least`` rows."""
    w = Window.partitionBy(key)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.count(F.lit(1)).over(w).alias("k"), (F.col(x) - F.avg(x).over(w)).alias("x"), (F.col(y) - F.avg(y).over(w)).alias("y"))
    return d.filter(F.col("k") >= least).agg(F.count_distinct(key).alias("n_keys"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") ** 2) * F.sum(F.col("y") ** 2)), digits).alias("r"))


def residuals(df: DataFrame, keys: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Adds ``residual`` of y on x1 and x2 within keys, from sums alone; null where the two are collinear."""
    c = lambda a, b: F.covar_pop(a, b)
    f = df.filter(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    s = f.groupBy(*keys).agg(c(x1, x1).alias("__11"), c(x2, x2).alias("__22"), c(x1, x2).alias("__12"), c(x1, y).alias("__1y"), c(x2, y).alias("__2y"), F.avg(x1).alias("__m1"), F.avg(x2).alias("__m2"), F.avg(y).alias("__my"))
    det = F.col("__11") * F.col("__22") - F.col("__12") * F.col("__12")
    ok = det > 1e-9 * F.col("__11") * F.col("__22")
    b1, b2 = (F.col("__22") * F.col("__1y") - F.col("__12") * F.col("__2y")) / F.when(ok, det), (F.col("__11") * F.col("__2y") - F.col("__12") * F.col("__1y")) / F.when(ok, det)
    r = F.col(y) - F.col("__my") - b1 * (F.col(x1) - F.col("__m1")) - b2 * (F.col(x2) - F.col("__m2"))
    return df.join(s, keys, "left").withColumn("residual", r).drop("__11", "__22", "__12", "__1y", "__2y", "__m1", "__m2", "__my")


def decile(value: Column, cuts: Column, n: int = 10) -> Column:
    """Bucket 0..n-1 of a value among n - 1 ascending cut points (an array, which may be a scalar subquery); -1 for null."""
    above = F.lit(0)
    for i in range(n - 1):
        above = above + (value > F.get(cuts, F.lit(i))).cast("int")
    return F.when(value.isNull(), -1).otherwise(above)


def quantile_cuts(df: DataFrame, column: str, n: int = 10) -> Column:
    """The n - 1 inner cut points of a column, exact, as a scalar array."""
    names = {f"q{i}": i / n for i in range(1, n)}
    return group_quantiles(df, [], column, names).select(F.array(*names)).scalar()


def auc(df: DataFrame, score: str, label: str, digits: int = 6) -> DataFrame:
    """(n_pos, n_neg, auc) by rank sums over counts of distinct scores, ties counting half."""
    r = value_ranks(df, [], score).select(F.col(score).alias("__s"), "n", "before")
    pos = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("__s")).agg(F.sum(F.col(label).cast("int")).alias("p"))
    g = r.join(pos, "__s")
    # The sum of the average ranks of the positive rows, less what they hold among themselves.
    p, n = F.sum("p"), F.sum("n")
    ranks = F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / F.lit(2.0)))
    q = n - p
    return g.agg(p.alias("n_pos"), q.alias("n_neg"), F.round((ranks - p * (p + 1) / 2) / F.when(p * q > 0, (p * q).cast("double")), digits).alias("auc"))


def lift(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, n_pos, lift) by exact score cuts, bin 0 the highest."""
    cuts = quantile_cuts(df, score, bins)
    b = (F.lit(bins - 1) - decile(F.col(score), cuts, bins)).cast("int")
    rate = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    return df.filter(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("n_pos"), F.round(F.avg(F.col(label).cast("double")) / rate, 6).alias("lift"))
