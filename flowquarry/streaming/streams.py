"""Structured Streaming forms: arrivals, deduplication, windows with late rows, sessions, and relationship memory as keyed state.

State is one row a key (or a key and window) and lives in the checkpoint folder, so a lost executor resumes from it. Batch and stream share the
column expressions, and the tests hold each stream to its batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowquarry.functions.cleaning import canonical_id, cents, month_key


def arrivals(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def clean_edges(stream: DataFrame) -> DataFrame:
    """Raw edges in standard form; rows without a month or an end are left out. Works on batches too."""
    e = stream.select("edge_id", month_key("time_key").alias("time_key"), canonical_id("source").alias("source"), canonical_id("dest").alias("dest"), F.coalesce(cents("amount"), F.lit(0)).alias("cents"), F.col("load_ts").cast("timestamp").alias("load_ts"))
    return e.filter("time_key is not null and source is not null and dest is not null")


def first_arrivals(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key; a repeat is dropped if it comes within ``late`` of it, which bounds the state."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def window_totals(stream: DataFrame, key: list[str], ts: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows and cents by key and event-time window (sliding if ``slide``); rows up to ``late`` late still count, and a window is final once it is that old."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = stream.withWatermark(ts, late).groupBy(*key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return g.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "cents")


def sessions(stream: DataFrame, key: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Rows by key and session: a session ends when nothing comes for ``gap``."""
    g = stream.withWatermark(ts, late).groupBy(*key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


MEMORY = "source string, dest string, t int, cohort string, is_persistent boolean"


def relationship_memory(stream: DataFrame, memory: int = 6, span: int = 6, persistent: int = 4) -> DataFrame:
    """Pairs with their month's rank t, in order of t, as retained, returning or new: the state of a pair is a bit for each of its last months.

    A batch may hold several months of a pair, but a month that comes after a later one of the same pair was seen is left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, bits = state.get if state.exists else (0, 0)
        months = sorted({int(t) for pdf in batches for t in pdf["t"]})
        rows = []
        for t in months:
            if t <= last:
                continue
            bits = (bits << min(t - last, 62)) & ((1 << 40) - 1) if last else 0
            cohort = "retained" if bits & 2 else "returning" if bits & (((1 << memory) - 1) << 1) else "new"
            bits |= 1
            last = t
            rows.append((*key, t, cohort, (bits & ((1 << span) - 1)).bit_count() >= persistent))
        state.update((last, bits))
        yield pd.DataFrame(rows, columns=["source", "dest", "t", "cohort", "is_persistent"])

    return stream.select("source", "dest", "t").groupBy("source", "dest").applyInPandasWithState(step, MEMORY, "last int, bits bigint", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into parquet, and returns the result."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
