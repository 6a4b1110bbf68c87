"""Per-key results without imbalance: keys are packed into tasks by load, large keys are split into shards.

Loads come from counts that are combined on the map side. Only keys above a share of a task's load, and the loads of a
fixed number of buckets of other keys, reach the driver: at most ``SPLIT * tasks + BUCKETS * tasks`` rows, whatever the data.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.session import cut

SPLIT = 4
BUCKETS = 8
#: Hot keys that are broadcast, a few dozen bytes each.
MOST_HOT = 50_000


@dataclass
class Fragments:
    """Which task takes which bucket and which shard of a large key."""

    tasks: int
    buckets: int
    bucket_task: list[int]
    large: list[tuple]  # key values, then the list of tasks, one a shard
    loads: list[float] = field(default_factory=list)

    @property
    def imbalance(self) -> float:
        mean = sum(self.loads) / max(1, len(self.loads))
        return max(self.loads) / mean if mean else 1.0


def pack(tasks: int, bucket_loads: list[int], large: list[tuple[tuple, int]]) -> Fragments:
    """Packs buckets and shards into tasks, largest first into the task with the least load; ties go to the lower task.

    A large key gets shards in proportion to its load, each of at most a quarter of a task's fair load.
    """
    total = sum(bucket_loads) + sum(n for _, n in large)
    piece = max(1.0, total / (SPLIT * tasks))
    items: list[tuple[float, int, int, int]] = [(-n, 0, i, 0) for i, n in enumerate(bucket_loads)]
    shards = [max(1, math.ceil(n / piece)) for _, n in large]
    for k, (_, n) in enumerate(large):
        items += [(-n / shards[k], 1, k, s) for s in range(shards[k])]
    heap = [(0.0, t) for t in range(tasks)]
    loads, bucket_task, placed = [0.0] * tasks, [0] * len(bucket_loads), [[0] * n for n in shards]
    for load, kind, i, s in sorted(items):
        had, t = heapq.heappop(heap)
        if kind:
            placed[i][s] = t
        else:
            bucket_task[i] = t
        loads[t] = had - load
        heapq.heappush(heap, (loads[t], t))
    return Fragments(tasks, len(bucket_loads), bucket_task, [(*key, placed[i]) for i, (key, _) in enumerate(large)], loads)


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def plan_fragments(df: DataFrame, keys: list[str], tasks: int | None = None) -> Fragments:
    """Measures the rows a key holds and packs them. One pass, combined before its shuffle."""
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = BUCKETS * tasks
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    large = F.col("__n") > max(1.0, total / (SPLIT * tasks))
    grouped = counts.groupBy(*[F.when(large, F.col(k)).alias(k) for k in keys], large.alias("__large"), F.when(~large, _bucket(keys, n_buckets)).alias("__b"))
    rows = grouped.agg(F.sum("__n").alias("__n")).collect()
    loads = [0] * n_buckets
    heavy = []
    for r in rows:
        if r["__large"]:
            heavy.append((tuple(r[k] for k in keys), r["__n"]))
        else:
            loads[r["__b"]] += r["__n"]
    heavy.sort(key=lambda x: (-x[1], str(x[0])))
    return pack(tasks, loads, heavy)


def _large_frame(df: DataFrame, keys: list[str], plan: Fragments) -> DataFrame:
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    schema = T.StructType([*fields, T.StructField("__tasks", T.ArrayType(T.IntegerType()))])
    return F.broadcast(df.sparkSession.createDataFrame(plan.large, schema))


def place(df: DataFrame, keys: list[str], spread: Column, plan: Fragments) -> DataFrame:
    """Adds ``__task`` and ``__shard``: the task of the row and, for large keys, the shard that ``spread`` picks (else -1)."""
    # One constant however many tasks there are, not a literal for each bucket.
    tasks = F.split(F.lit(",".join(map(str, plan.bucket_task))), ",").cast("array<int>")
    light = F.get(tasks, _bucket(keys, plan.buckets))
    if not plan.large:
        return df.withColumns({"__shard": F.lit(-1), "__task": light})
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    met = df.alias("l").join(_large_frame(df, keys, plan).alias("r"), same, "left").select("l.*", "r.__tasks")
    shard = F.when(F.col("__tasks").isNotNull(), F.pmod(F.xxhash64(spread), F.size("__tasks")).cast("int")).otherwise(-1)
    return met.withColumn("__shard", shard).withColumn("__task", F.when(F.col("__shard") >= 0, F.get("__tasks", F.col("__shard"))).otherwise(light)).drop("__tasks")


def balanced_totals(pairs: DataFrame, keys: list[str], other: str, plan: Fragments) -> DataFrame:
    """Per key: rows, cents and number of different non-null ``other``, from ``pairs`` = (keys, other, n_rows, cents), unique by keys and other.

    Rows go to the packed tasks; the shards of a large key hold different ``other``, so their counts add up.
    """
    sums = [F.sum("n_rows").alias("n_rows"), F.sum("cents").alias("cents"), F.count(other).alias("n_other")]
    placed = place(pairs, keys, F.col(other), plan).repartitionById(plan.tasks, F.col("__task"))
    by_shard = placed.groupBy("__task", *keys, "__shard").agg(*sums)
    light = by_shard.filter("__shard < 0").select(*keys, "n_rows", "cents", "n_other")
    large = by_shard.filter("__shard >= 0").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_rows", "cents", "n_other")])
    return light.unionByName(large) if plan.large else light


def fragment_replicate_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, plan: Fragments, how: str = "inner") -> DataFrame:
    """Joins ``left`` with ``right`` on ``keys`` (inner or left): rows of large keys are split into shards, to which alone the matching right rows are replicated.

    Other keys join by hash. Null keys match nothing. Columns of ``right`` that clash with those of ``left`` are dropped.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    right = right.drop(*[c for c in right.columns if c in left.columns and c not in keys])
    if not plan.large:
        return left.join(right, keys, how)
    marked = place(left, keys, spread, plan).drop("__task")
    copies = right.join(_large_frame(right, keys, plan), keys).withColumn("__shard", F.explode(F.sequence(F.lit(0), F.size("__tasks") - 1))).drop("__tasks")
    split = marked.filter("__shard >= 0").join(copies, [*keys, "__shard"], how).drop("__shard")
    rest = marked.filter("__shard < 0").drop("__shard").join(right, keys, how)
    return rest.unionByName(split)


def hot_keys(df: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, int]:
    """((keys, __salts), how many) of the keys with more than ``most`` rows, a salt for each ``most`` of them. Counted before the shuffle, at most rows / ``most`` keys, and written, so it is counted once."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    hot = cut(n.select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__salts")), "hot")
    return hot, hot.count()


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], most: int = 2000, hot: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Inner join in which a key with more than ``most`` right rows has a salt for each ``most`` of them: right rows take one, left rows all of their key's.

    ``hot`` is what ``hot_keys`` gives for the right side, where it is known. Up to ``MOST_HOT`` hot keys are broadcast, more are joined by a shuffle; without any it is a plain join.
    """
    marks, k = hot or hot_keys(right, keys, most)
    if not k:
        return left.join(right, keys)
    marks = F.broadcast(marks) if k <= MOST_HOT else marks
    others = [c for c in right.columns if c not in keys]
    salts = F.coalesce("__salts", F.lit(1))
    r = right.join(marks, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*others), salts).cast("int")).drop("__salts")
    left_ = left.join(marks, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left_.join(r, [*keys, "__salt"]).drop("__salt")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, salt: str, salts: int = 16, rank: str | None = None) -> DataFrame:
    """The k first rows of each key. They are first taken within salts of ``salt``, so the rows of a hot key are never sorted in one task; ``order`` should be total."""
    from pyspark.sql.window import Window

    within = Window.partitionBy(*keys, "__salt").orderBy(*order)
    some = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts))).withColumn("__k", F.row_number().over(within)).filter(F.col("__k") <= k)
    out = some.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__k") <= k).drop("__salt")
    return out.withColumnRenamed("__k", rank) if rank else out.drop("__k")
