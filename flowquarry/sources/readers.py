"""Scans. Schemas are given, so nothing is inferred and unused columns are never read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT = T.StructType([T.StructField("source", T.StringType()), T.StructField("dest", T.StringType()), T.StructField("amount", T.DoubleType()), T.StructField("volume", T.LongType())])


def monthly_csv(spark: SparkSession, pattern: str, columns: Sequence[str] = ("source", "dest", "amount", "volume"), rename: dict[str, str] | None = None) -> DataFrame:
    """Monthly CSV snapshots with the month in the file name (..YYYY-MM.csv); ids stay text. Columns are found by header, others are not parsed.

    Files without a month in their name give a null time_key. ``rename`` maps header names to the standard ones.
    """
    rename = rename or {}
    kinds = {f.name: f.dataType for f in SNAPSHOT.fields}
    df = spark.read.option("header", True).option("enforceSchema", False).csv(pattern)
    have = {rename.get(c, c): c for c in df.columns}
    missing = [c for c in columns if c not in have]
    if missing:
        raise ValueError(f"snapshot lacks {missing}; it has {df.columns}")
    picked = [F.col(have[c]).try_cast(kinds.get(c, T.StringType())).alias(c) for c in columns]
    return df.select(F.nullif(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2})\.csv", 1), F.lit("")).alias("time_key"), *picked)


def clean_snapshot(df: DataFrame) -> DataFrame:
    """Rows with both ids and an amount above 0, without self-edges, parallel edges summed (in whole cents)."""
    ok = df.filter("source is not null and dest is not null and source <> dest and amount > 0")
    return ok.groupBy("time_key", "source", "dest").agg(F.sum(F.round(F.col("amount") * 100).cast("bigint")).alias("cents"), F.sum(F.coalesce("volume", F.lit(0))).alias("volume"))


def wide_snapshot(df: DataFrame, required: Sequence[str], fill: Sequence[str] = ("amount", "volume")) -> DataFrame:
    """The required columns, checked; nulls of ``fill`` become 0."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"snapshot lacks {missing}")
    return df.select(*required).na.fill(0, [c for c in fill if c in required])


def with_aliases(df: DataFrame, aliases: dict[str, Sequence[str]], optional: Sequence[str] = ()) -> DataFrame:
    """Standard columns from the first alias that exists, without regard to case; missing optional ones are null, others raise. Only these columns are read."""
    lower = {c.lower(): c for c in df.columns}
    out = []
    for name, names in aliases.items():
        hit = next((lower[a.lower()] for a in (name, *names) if a.lower() in lower), None)
        if hit is None and name not in optional:
            raise ValueError(f"no column for {name}; tried {[name, *names]}, have {df.columns}")
        out.append((F.col(hit) if hit else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def dtype_hazards(df: DataFrame, text: Sequence[str]) -> list[tuple[str, str]]:
    """Columns that should be text but are numbers, with their type: their leading zeros are gone."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name in text and isinstance(f.dataType, T.NumericType)]


def table_or_parquet(spark: SparkSession, name: str, view: str | None = None) -> DataFrame:
    """A catalogue table, or parquet if the name holds a slash; registered as ``view`` if given."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    if view:
        df.createOrReplaceTempView(view)
    return df


def guarded_collect(df: DataFrame, most: int) -> list:
    """All rows, if there are at most ``most``; raises else. One job that reads at most one row more than it may return."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def guarded_sql(spark: SparkSession, sql: str, most: int, **args: object) -> list:
    """Rows of a query with named parameters (``:name``), never with literals pasted in."""
    return guarded_collect(spark.sql(sql, args=args or None), most)


def partitions_of(df: DataFrame, column: str) -> DataFrame:
    """The inventory of snapshots: (column, n_rows)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def latest(df: DataFrame, column: str) -> DataFrame:
    """The rows of the greatest ``column``; on a partition column, only that partition is read."""
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def top_nodes(panel: DataFrame, by: str, n: int, node: str = "node") -> DataFrame:
    """The n rows with the greatest ``by`` (a top-k report), ties by node."""
    return panel.orderBy(F.desc(by), node).limit(n)


def directed_scan(edges: DataFrame, focal: DataFrame) -> DataFrame:
    """(focal, other, direction, time_key, cents) of the edges of some nodes (node), a row for each end that is focal: two scans, each pruned to its side."""
    f = focal.select(F.col("node").alias("focal")).distinct()
    side = lambda own, other, name: edges.select(F.col(own).alias("focal"), F.col(other).alias("other"), F.lit(name).alias("direction"), "time_key", "cents").join(f, "focal", "left_semi")
    return side("source", "dest", "out").unionByName(side("dest", "source", "in"))


def completed(df: DataFrame, schema: str) -> DataFrame:
    """Exactly the columns of ``schema`` in its order: those there cast, those missing null, others dropped, so tables of all months and versions stack."""
    want = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in want])


def restricted_to(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among those of ``other``."""
    return df.join(other.select(key).distinct(), key, "left_semi")


class PanelSource:
    """Node and role panels behind one interface, from parquet folders or catalogue tables.

    Only columns of ``measures`` may rank nodes, by default all numeric ones of the node panel. The list of months is read once.
    """

    def __init__(self, spark: SparkSession, nodes: str, roles: str, measures: list[str] | None = None) -> None:
        self.nodes, self.roles = table_or_parquet(spark, nodes), table_or_parquet(spark, roles)
        self.measures = measures or [c for c, t in self.nodes.dtypes if t in ("double", "float", "bigint", "int") or t.startswith("decimal")]
        self._months: list[str] | None = None

    def months(self) -> list[str]:
        if self._months is None:
            self._months = [r[0] for r in guarded_collect(self.nodes.select("time_key").distinct().orderBy("time_key"), 10_000)]
        return self._months

    def node_month(self, month: str, n: int, by: str = "strength") -> DataFrame:
        if by not in self.measures:
            raise ValueError(f"nodes can't be ranked by {by}")
        return top_nodes(self.nodes.filter(F.col("time_key") == month), by, n)

    def roles_month(self, month: str, n: int, by: str = "strength") -> DataFrame:
        return restricted_to(self.roles.filter(F.col("time_key") == month), self.node_month(month, n, by), "node")

    def history(self, node: str) -> DataFrame:
        return self.nodes.filter(F.col("node") == node).orderBy("time_key")
