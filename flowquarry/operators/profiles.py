"""Profiles and studies of parties over time: address changes, market entry, locality, role lift, robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions.ranks import group_quantiles
from flowquarry.functions.geo import haversine_km
from flowquarry.operators.edges import ratio


def change_log(history: DataFrame, key: str, period: str, address: Column, point: Column) -> DataFrame:
    """(key, period, change): against the row before, none, address, point, both or first, by hashes of the address and of the coordinates."""
    w = Window.partitionBy(key).orderBy(period)
    h = history.select(key, period, F.xxhash64(address).alias("a"), F.xxhash64(point).alias("p"))
    a, p = ~F.lag("a").over(w).eqNullSafe(F.col("a")), ~F.lag("p").over(w).eqNullSafe(F.col("p"))
    first = F.row_number().over(w) == 1
    return h.select(key, period, F.when(first, "first").when(a & p, "both").when(a, "address").when(p, "point").otherwise("none").alias("change"))


def move_class(history: DataFrame, key: str, period: str) -> DataFrame:
    """Distance-graded class of each move between rows with coordinates: none, jitter (< 0.1 km), local (< 5), city (< 50), regional (< 250), far, or first."""
    w = Window.partitionBy(key).orderBy(period)
    km = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    k = history.filter("lat is not null and lon is not null").select(key, period, km.alias("km"))
    c = F.col("km")
    return k.select(key, period, F.round("km", 3).alias("km"), F.when(c.isNull(), "first").when(c < 1e-6, "none").when(c < 0.1, "jitter").when(c < 5, "local").when(c < 50, "city").when(c < 250, "regional").otherwise("far").alias("move"))


def repeated_profile(raw: DataFrame, key: str, value: str) -> DataFrame:
    """(n_rows, n_values, n_keys): keys by their rows and their different values."""
    per = raw.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(value).alias("n_values"))
    return per.groupBy("n_rows", "n_values").agg(F.count(F.lit(1)).alias("n_keys"))


def role_lift(df: DataFrame, area: str, role: str) -> DataFrame:
    """(area, role, n, share, lift): the role's share in the area over its share of all."""
    cell = df.filter(F.col(area).isNotNull() & F.col(role).isNotNull()).groupBy(area, role).agg(F.count(F.lit(1)).alias("n"))
    a, r, t = F.sum("n").over(Window.partitionBy(area)), F.sum("n").over(Window.partitionBy(role)), cell.agg(F.sum("n")).scalar()
    return cell.select(area, role, "n", F.round(F.col("n") / a, 6).alias("share"), F.round(F.col("n") / a / (r / t), 6).alias("lift"))


def sign_agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n, agree): rows in both whose values have the same sign; the robustness of a result to another version of the graph."""
    j = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    return j.agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.signum(F.col("x").cast("double")) == F.signum(F.col("y").cast("double"))), F.count(F.lit(1))).alias("agree"))


def persistence(df: DataFrame, key: list[str], flag: Column, k: int, m: int) -> DataFrame:
    """Keys whose flag is true in at least ``k`` of their last ``m`` periods t."""
    top = df.agg(F.max("t")).scalar()
    return df.filter(F.col("t") > top - m).groupBy(*key).agg(F.count_if(flag).alias("n_true"), F.count(F.lit(1)).alias("n_periods")).filter(F.col("n_true") >= k)


def locality_transitions(df: DataFrame, key: str) -> DataFrame:
    """(from_class, to_class, n) of consecutive periods t."""
    w = Window.partitionBy(key).orderBy("t")
    n = df.select(F.col("locality").alias("from_class"), F.when(F.lead("t").over(w) == F.col("t") + 1, F.lead("locality").over(w)).alias("to_class"))
    return n.filter("from_class is not null and to_class is not null").groupBy("from_class", "to_class").agg(F.count(F.lit(1)).alias("n"))


def common_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's value less the month's median over all keys, and each key's median absolute deviation of that."""
    med = group_quantiles(df, ["t"], value, {"__m": 0.5})
    adj = df.join(F.broadcast(med), "t").withColumn("adjusted", F.col(value) - F.col("__m")).drop("__m")
    own = adj.groupBy(key).agg(F.percentile("adjusted", F.lit(0.5)).alias("__c"))
    return adj.join(own, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("__c"), 4).alias("median"), F.round(F.percentile(F.abs(F.col("adjusted") - F.col("__c")), F.lit(0.5)), 4).alias("mad"))


def cosine_pairs_to(reference: DataFrame, df: DataFrame, key: str, vector: str) -> DataFrame:
    """Each row's cosine to one reference vector."""
    dot = F.aggregate(F.zip_with(vector, "__v", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda a: a * a), F.lit(0.0), lambda acc, x: acc + x))
    return df.withColumn("__v", reference.agg(F.first(vector)).scalar()).select(key, F.round(dot / (norm(vector) * norm("__v")), 6).alias("cosine"))


def neighbours_jaccard(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common, jaccard, adamic_adar) of given pairs, on the undirected graph ``links`` (src, dst both ways)."""
    deg = links.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    x = pairs.select("a", "b").distinct()
    k = lambda s: deg.select(F.col("src").alias(s), F.col("k").alias(f"k{s}"))
    ends = x.join(k("a"), "a").join(k("b"), "b")
    # The neighbours of the end that has fewer are looked up at the other, so a hub's are not listed for each of its pairs.
    few = F.col("ka") <= F.col("kb")
    ends = ends.select("a", "b", F.when(few, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(few, F.col("b")).otherwise(F.col("a")).alias("hi"))
    via = ends.join(links.select(F.col("src").alias("lo"), F.col("dst").alias("z")), "lo").join(links.select(F.col("src").alias("hi"), F.col("dst").alias("z")), ["hi", "z"]).join(deg.select(F.col("src").alias("z"), F.col("k").alias("kz")), "z")
    c = via.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(F.when(F.col("kz") > 1, 1 / F.log(F.col("kz").cast("double"))).otherwise(0.0)).alias("aa"))
    d = lambda s: deg.select(F.col("src").alias(s), F.col("k").alias(f"k{s}"))
    j = x.join(c, ["a", "b"], "left").join(d("a"), "a", "left").join(d("b"), "b", "left")
    common = F.coalesce("common", F.lit(0))
    return j.select("a", "b", common.alias("common"), ratio(common, F.coalesce("ka", F.lit(0)) + F.coalesce("kb", F.lit(0)) - common).alias("jaccard"), F.round(F.coalesce("aa", F.lit(0.0)), 6).alias("adamic_adar"))
