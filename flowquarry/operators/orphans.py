"""References to records that do not exist, by table, field and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.cleaning import canonical_id, month_index, month_key


def references(df: DataFrame, table_name: str, fields: list[str], period: Column) -> DataFrame:
    """(table_name, field_name, time_key, node, n_rows): the distinct non-null references of some fields, counted.

    Combined before the shuffle, so an id that holds a third of the rows is a few rows in each task. Rows without a month are left out.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), canonical_id(f).alias("node")) for f in fields]))
    rows = df.select(month_key(period).alias("time_key"), each.alias("x")).select("time_key", "x.field_name", "x.node")
    return (
        rows.filter("node is not null and time_key is not null")
        .groupBy("field_name", "time_key", "node")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(table_name).alias("table_name"), "field_name", "time_key", "node", "n_rows")
    )


def presence(parents: DataFrame, node: str = "node", loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """(node, first_m, last_m): for each id and month of loading, the months in which its row is present, as month indexes.

    A row is present in a month if it was loaded before the month's end and not deleted before its start. last_m is
    2**30 while a row isn't deleted; first_m is 2**30 for a row without a time of loading, which is present in no month.
    """
    month = lambda c: F.year(c) * 12 + F.month(c) - 1
    never = F.lit(2**30)
    rows = parents.select(canonical_id(node).alias("node"), F.coalesce(month(F.col(loaded)), never).alias("first_m"), F.coalesce(month(F.col(deleted)), never).alias("last_m"))
    return rows.filter("node is not null").groupBy("node", "first_m").agg(F.max("last_m").alias("last_m"))


def orphans(refs: DataFrame, present: DataFrame) -> DataFrame:
    """The references without a present parent, with ``kind``: missing (no row at all), late (none loaded yet) or deleted.

    A left anti-join of the distinct references against the spans of months in which a parent is present, a few rows a parent whatever
    the number of months; the kind then comes from each id's first month.
    """
    spans = present.filter("first_m <= last_m").select(F.col("node").alias("__node"), F.col("first_m").alias("__a"), F.col("last_m").alias("__b"))
    keyed = refs.withColumn("m", month_index("time_key"))
    lost = keyed.join(spans, (F.col("node") == F.col("__node")) & F.col("m").between(F.col("__a"), F.col("__b")), "left_anti")
    firsts = present.groupBy("node").agg(F.min("first_m").alias("first_m"))
    kind = F.when(F.col("first_m").isNull(), "missing").when(F.col("first_m") > F.col("m"), "late").otherwise("deleted")
    return lost.join(firsts, "node", "left").select("table_name", "field_name", "time_key", "node", kind.alias("kind"), "n_rows")


def orphan_report(refs: DataFrame, lost: DataFrame) -> DataFrame:
    """Per table, field and month: references and rows in all, and those of each kind of orphan."""
    keys = ["table_name", "field_name", "time_key"]
    tagged = refs.withColumn("kind", F.lit("ok")).select(*keys, "kind", "n_rows").unionByName(lost.select(*keys, "kind", "n_rows"))
    kinds = ("missing", "late", "deleted")
    every = tagged.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "ok").alias("n_ids"),
        F.sum(F.when(F.col("kind") == "ok", F.col("n_rows")).otherwise(0)).alias("n_rows"),
        *[F.count_if(F.col("kind") == k).alias(f"ids_{k}") for k in kinds],
        *[F.sum(F.when(F.col("kind") == k, F.col("n_rows")).otherwise(0)).alias(f"rows_{k}") for k in kinds],
    )
    return every
