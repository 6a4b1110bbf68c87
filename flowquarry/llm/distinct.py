"""Distinct counts that merge: sorted runs of 64-bit hashes, delta-coded, joined by k-way union.

The ids of a group are hashed and cut by the hashes' leading bits into shards, a large group into many and a small one into one; the distinct hashes of a shard, sorted,
are one run, stored as its first hash and varints of the differences. Prefixes nest, so runs of groups with different bits are cut or put together
to those of the group they merge into; runs of the same shard then merge without any other. A count is the number of hashes in
the union; two ids share a hash with a probability of 2^-64, so n ids lose n (n - 1) / 2^65 in the mean, and that is
reported as the error (also a bound of the probability that the count is not exact).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.session import cut

SHARD_ROWS = 1 << 17
#: Large groups that are broadcast, a few dozen bytes each; more are met by a shuffle.
MOST_LARGE = 50_000


def encode(sorted_hashes: np.ndarray) -> bytes:
    """A sorted array of different int64 as 8 bytes of the first and LEB128 varints of the differences."""
    if len(sorted_hashes) == 0:
        return b""
    a = sorted_hashes.astype(np.int64)
    gaps = a[1:].view(np.uint64) - a[:-1].view(np.uint64)
    if len(gaps) == 0:
        return a[:1].tobytes()
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        size += gaps >= np.uint64(1 << (7 * k))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max())):
        has = size > k
        low = (gaps[has] >> np.uint64(7 * k)) & np.uint64(0x7F)
        out[at[has] + k] = low.astype(np.uint8) | np.where(size[has] > k + 1, 0x80, 0).astype(np.uint8)
    return a[:1].tobytes() + out.tobytes()


def decode(run: bytes) -> np.ndarray:
    """The array that ``encode`` stored."""
    if not run:
        return np.empty(0, np.int64)
    first = np.frombuffer(run[:8], np.int64)
    b = np.frombuffer(run, np.uint8, offset=8)
    if len(b) == 0:
        return first.copy()
    ends = np.flatnonzero(b < 0x80)
    starts = np.concatenate(([0], ends[:-1] + 1))
    pos = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    parts = (b & 0x7F).astype(np.uint64) << (np.uint64(7) * pos.astype(np.uint64))
    gaps = np.add.reduceat(parts, starts)
    return np.concatenate((first.view(np.uint64), first.view(np.uint64) + np.cumsum(gaps))).view(np.int64)


def union(runs: list[np.ndarray]) -> np.ndarray:
    """The k-way union of sorted arrays: a merge sort of their concatenation finds the runs already in order."""
    if len(runs) == 1:
        return runs[0]
    a = np.concatenate(runs)
    a.sort(kind="stable")
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


def shard_bits(n: Column) -> Column:
    """Leading bits so that a shard of n different hashes holds at most about ``SHARD_ROWS``."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(SHARD_ROWS)))).cast("int")


def _shard(h: Column, bits: Column) -> Column:
    """The leading bits as a number from 0 on; hashes of a shard are neighbours also as signed numbers."""
    return F.call_function("shiftrightunsigned", F.call_function("shiftrightunsigned", h, F.lit(63) - bits), F.lit(1)).cast("int")


@F.pandas_udf(T.BinaryType())
def _encode(hashes: pd.Series) -> pd.Series:
    return hashes.map(lambda a: encode(np.asarray(a, np.int64)))


def with_bits(df: DataFrame, keys: list[str], size: Column, name: str) -> DataFrame:
    """Adds ``name``: the leading bits for a group whose rows' ``size`` adds up to that of its hashes at most.

    Only groups of more than ``SHARD_ROWS`` have any, at most the sum of sizes / ``SHARD_ROWS``, counted before the shuffle. Up to ``MOST_LARGE`` of them are broadcast;
    more meet the rows by a shuffle, which adaptive execution splits where a group is large.
    """
    large = df.groupBy(*keys).agg(F.sum(size).alias("__n")).filter(F.col("__n") > SHARD_ROWS).select(*keys, shard_bits(F.col("__n")).alias("__bits"))
    large = cut(large, "large")
    k = large.count()
    if not k:
        return df.withColumn(name, F.lit(0))
    side = F.broadcast(large) if k <= MOST_LARGE else large
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    return df.alias("l").join(side.alias("r"), same, "left").select("l.*", F.coalesce("__bits", F.lit(0)).alias(name))


def build_runs(df: DataFrame, keys: list[str], ids: Column) -> DataFrame:
    """(keys, bits, shard, n, run) of the non-null ``ids``; null is a key like others. Sets are combined on the map side, so an id that repeats is sent once a task; a set is one shard of one group."""
    rows = df.filter(ids.isNotNull()).select(*keys, F.xxhash64(ids).alias("h"))
    rows = with_bits(rows, keys, F.lit(1), "bits")
    sets = rows.groupBy(*keys, "bits", _shard(F.col("h"), F.col("bits")).alias("shard")).agg(F.array_sort(F.collect_set("h")).alias("hs"))
    return sets.select(*keys, "bits", "shard", F.size("hs").cast("bigint").alias("n"), _encode("hs").alias("run"))


def resplit(run: bytes, bits: int, shard: int, to: int) -> list[tuple[int, bytes]]:
    """A run of ``bits`` leading bits as (shard, run) of ``to`` bits."""
    if to <= bits:
        return [(shard >> (bits - to), run)]
    a = decode(run)
    s = (a.view(np.uint64) >> np.uint64(64 - to)).astype(np.int64)
    ends = np.flatnonzero(np.concatenate((s[1:] != s[:-1], [True])))
    return [(int(s[e]), encode(a[b : e + 1])) for b, e in zip([0, *(ends[:-1] + 1)], ends, strict=True)]


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bits, shard, n, run): the runs of each group and shard united, in shards for what the merged group may hold. Rows stream through sorted; one group's shard is held at a time."""
    aimed = with_bits(runs.select(*keys, "bits", "shard", "n", "run"), keys, F.col("n"), "to").drop("n")
    names = [*keys, "bits", "shard"]
    piece = T.StructType([*[runs.schema[k] for k in keys], T.StructField("bits", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("run", T.BinaryType())])
    schema = T.StructType([*piece.fields[:-1], T.StructField("n", T.LongType()), T.StructField("run", T.BinaryType())])

    def recut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*row[:-4], row[-1], s, r) for row in pdf[[*keys, "bits", "shard", "run", "to"]].itertuples(index=False, name=None) for s, r in resplit(row[-2], row[-4], row[-3], row[-1])]
            yield pd.DataFrame(rows, columns=piece.names)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, out = None, [], []
        for pdf in batches:
            for row in pdf[[*names, "run"]].itertuples(index=False, name=None):
                key = tuple(None if x is None or x != x else x for x in row[:-1])
                if key != at:
                    if held:
                        u = union(held)
                        out.append((*at, len(u), encode(u)))
                    at, held = key, []
                held.append(decode(row[-1]))
                if len(held) >= 64:
                    held = [union(held)]
            if len(out) >= 256:
                yield pd.DataFrame(out, columns=schema.names)
                out = []
        if held:
            u = union(held)
            out.append((*at, len(u), encode(u)))
        if out:
            yield pd.DataFrame(out, columns=schema.names)

    whole = aimed.filter("to <= bits").select(*keys, F.col("to").alias("bits"), F.call_function("shiftright", F.col("shard"), F.col("bits") - F.col("to")).alias("shard"), "run")
    wide = aimed.filter("to > bits").mapInPandas(recut, piece)
    placed = whole.unionByName(wide).repartition(*names).sortWithinPartitions(*names)
    return placed.mapInPandas(walk, schema)


def counts(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_distinct, expected_lost) of runs that are unique by keys and shard."""
    n = runs.groupBy(*keys).agg(F.sum("n").alias("n_distinct"))
    d = F.col("n_distinct").cast("double")
    return n.withColumn("expected_lost", d * (d - 1) / F.lit(2.0**65))
