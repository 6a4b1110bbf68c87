"""Rounds of a sparse matrix times a vector, over blocks of numpy arrays.

Nodes are numbered within parts. The links of a part's nodes lie in its partition as arrays, and so does its share of the state, so a round is one job: each part multiplies its links,
sums by the other end, and sends one value a node and part. Nothing but a few sums comes to the driver. The state is kept in the executors and checkpointed to the shared folder every
``EVERY`` rounds, so a lost executor costs at most as many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.session import cut, delete, shared_folder

EVERY = 10
#: Links a part, and rows packed at once.
PER_PART, AT_ONCE = 1_000_000, 2_000_000
#: Below these bits of an id (as of monotonically_increasing_id) is the number within the part.
BITS = 33
LOW = (1 << BITS) - 1
Arrays = tuple[np.ndarray, ...]


def own(part: int) -> int:
    return part


def numbered(links: DataFrame) -> DataFrame:
    """(node, id) of all ends; ``links`` is read twice."""
    sc = links.sparkSession.sparkContext
    parts = max(sc.defaultParallelism, -(-links.count() // PER_PART))
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return cut(nodes.repartition(parts, "node").select("node", F.monotonically_increasing_id().alias("id")), "numbers")


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= AT_ONCE:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def _link_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in _gathered(frames):
        s, d, w = (f[c].to_numpy() for c in ("s", "d", "w"))
        order = np.lexsort((d, s >> BITS))
        s, d, w = s[order], d[order], w[order]
        sp, dp = s >> BITS, d >> BITS
        edge = np.flatnonzero(np.r_[True, (sp[1:] != sp[:-1]) | (dp[1:] != dp[:-1])])
        rows = []
        for lo, hi in zip(edge, np.r_[edge[1:], len(s)], strict=True):
            ends = d[lo:hi]
            starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
            arrays = ((s[lo:hi] & LOW).astype(np.int32), starts.astype(np.int32), (ends[starts] & LOW).astype(np.int32), w[lo:hi])
            rows.append((int(sp[lo]), int(dp[lo]), *(a.tobytes() for a in arrays)))
        yield pd.DataFrame(rows, columns=["part", "other", "a", "starts", "b", "w"])


def _row_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in _gathered(frames):
        ids = f["id"].to_numpy()
        values = f.drop(columns="id").to_numpy(np.float64)
        order = np.argsort(ids >> BITS, kind="stable")
        ids, values = ids[order], values[order]
        edge = np.flatnonzero(np.r_[True, ids[1:] >> BITS != ids[:-1] >> BITS])
        rows = [(int(ids[lo] >> BITS), (ids[lo:hi] & LOW).tobytes(), np.ascontiguousarray(values[lo:hi].T).tobytes()) for lo, hi in zip(edge, np.r_[edge[1:], len(ids)], strict=True)]
        yield pd.DataFrame(rows, columns=["part", "at", "v"])


def _assembled(rows: Iterator[tuple[int, Arrays]]) -> Iterator[tuple[int, tuple[Arrays, tuple]]]:
    got = list(rows)
    if got:
        out = np.zeros((len(got[0][1][1]) // max(len(got[0][1][0]), 1), sum(len(at) for _, (at, _) in got)))
        for _, (at, v) in got:
            out[:, at] = v.reshape(len(out), len(at))
        yield got[0][0], (tuple(out), ())


def _rows(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for r in f.itertuples(index=False):
            arrays = {c: np.frombuffer(r[k + 1]) for k, c in enumerate(names)}
            yield pd.DataFrame({"id": (r[0] << BITS) + np.arange(len(arrays[names[0]]))} | arrays)


class Matrix:
    """Links (src, dst, w) by the part of src, over nodes (node, id). To be used in a with statement."""

    def __init__(self, nodes: DataFrame, links: DataFrame):
        self.spark, self.nodes = nodes.sparkSession, nodes
        self.sc = self.spark.sparkContext
        if self.sc.getCheckpointDir() is None:
            self.sc.setCheckpointDir(shared_folder(self.spark))
        self.parts = ((nodes.agg(F.max("id")).first()[0] or 0) >> BITS) + 1
        end = lambda name, to: nodes.select(F.col("node").alias(name), F.col("id").alias(to))
        ids = links.select("src", "dst", "w").join(end("src", "s"), "src").join(end("dst", "d"), "dst").select("s", "d", F.col("w").cast("double").alias("w"))
        packed = ids.repartition(self.parts, F.shiftright("s", BITS)).mapInPandas(_link_blocks, "part bigint, other bigint, a binary, starts binary, b binary, w binary")
        i32 = lambda b: np.frombuffer(b, np.int32)
        self.links = packed.rdd.map(lambda r: (r[0], (r[1], i32(r[2]), i32(r[3]), i32(r[4]), np.frombuffer(r[5])))).partitionBy(self.parts, own).map(lambda r: r, True).persist(StorageLevel.MEMORY_AND_DISK)
        self.rounds, self.kept, self.file = 0, [], None

    def __enter__(self) -> Matrix:
        return self

    def __exit__(self, *_: object) -> None:
        for x in (self.links, *self.kept):
            x.unpersist()
        if self.file:
            delete(self.spark, self.file)

    def state(self, values: DataFrame) -> RDD:
        """A state of one array a column from (id, columns of numbers), which has each node of ``nodes`` once."""
        packed = values.mapInPandas(_row_blocks, "part bigint, at binary, v binary").rdd
        return self._keep(packed.map(lambda r: (r[0], (np.frombuffer(r[1], np.int64), np.frombuffer(r[2])))).partitionBy(self.parts, own).mapPartitions(_assembled, True))

    def _keep(self, new: RDD) -> RDD:
        self.kept.append(new.persist(StorageLevel.MEMORY_AND_DISK))
        return new

    def sent(self, state: RDD, f: Callable[[Arrays, np.ndarray], Arrays]) -> RDD:
        """The state of f(arrays, sums of the weights of a node's own links): no round, as the links lie where their node does."""

        def along(rows: Iterator[tuple]) -> Iterator[tuple]:
            v = None
            for key, got in rows:
                if v is None:
                    v, total = got[0], np.zeros(len(got[0][0]))
                else:
                    total += np.bincount(got[1], got[4], len(total))
            if v is not None:
                yield key, (f(v, total), ())

        return self._keep(state.union(self.links).mapPartitions(along, True))

    def step(self, state: RDD, x: Callable[[Arrays], np.ndarray], f: Callable[[Arrays, np.ndarray], tuple[Arrays, tuple]], least: bool = False) -> tuple[RDD, list[tuple]]:
        """The state of f(arrays, y), where y holds for each node the sum of weight times ``x(arrays)`` over its links' other ends (``least``: the least x instead, infinite without links).
        f also returns a few numbers; those of all parts are the second result."""

        def spread(rows: Iterator[tuple]) -> Iterator[tuple]:
            v = None
            for _, got in rows:
                if v is None:  # the state comes before the links
                    v = x(got[0])
                else:
                    to, a, starts, b, w = got
                    yield to, (b, np.minimum.reduceat(v[a], starts) if least else np.add.reduceat(w * v[a], starts))

        def gather(rows: Iterator[tuple]) -> Iterator[tuple]:
            v = None
            for key, got in rows:
                if v is None:
                    v = got[0]
                    y = np.full(len(v[0]), np.inf if least else 0.0)
                elif least:
                    y[got[0]] = np.minimum(y[got[0]], got[1])
                else:
                    y[got[0]] += got[1]
            if v is not None:
                yield key, f(v, y)

        moved = state.union(self.links).mapPartitions(spread).partitionBy(self.parts, own)
        moved._jrdd_deserializer = self.sc.serializer  # reads the same batches; otherwise union would write them once more
        new = self._keep(state.union(moved).mapPartitions(gather, True))
        self.rounds += 1
        lasting = self.rounds % EVERY == 0
        if lasting:
            new.checkpoint()
        said = new.map(lambda r: r[1][1]).collect()
        for old in self.kept[:-1]:
            old.unpersist()
        if lasting:  # without its Python ancestors, so that their shuffles can go
            short = RDD(new._jrdd, self.sc, new._jrdd_deserializer)
            short.partitioner, new = new.partitioner, short
            if self.file:
                delete(self.spark, self.file)
            self.file = new.getCheckpointFile()
        self.kept = [new]
        if self.rounds % (2 * EVERY) == 0:
            self.sc._jvm.System.gc()
        return new, said

    def frame(self, state: RDD, names: list[str], label: str) -> DataFrame:
        """(node, names): the state's first arrays, written to the shared folder."""
        n = len(names)
        blobs = self.spark.createDataFrame(state.map(lambda r: (r[0], *(np.ascontiguousarray(c, np.float64).tobytes() for c in r[1][0][:n]))), ", ".join(["part bigint", *(f"c{k} binary" for k in range(n))]))
        rows = blobs.mapInPandas(lambda frames: _rows(frames, names), ", ".join(["id bigint", *(f"{c} double" for c in names)]))
        return cut(self.nodes.join(rows, "id").select("node", *names), label)
