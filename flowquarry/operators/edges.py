"""The edge relation, its both-direction form, and graph versions without hubs.

A payment graph is a DataFrame (time_key, source, dest, cents, volume), one row for each month and directed pair. All months and
versions are one relation, so each metric is one aggregation keyed by month (and version), never a loop over months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.ranks import group_quantiles, quantile
from flowquarry.functions.cleaning import canonical_id, cents, month_key
from flowquarry.operators.snapshots import current_rows


def payments(raw: DataFrame) -> DataFrame:
    """Current rows of raw snapshots with both ids, summed by month and pair. Null amounts and volumes count as 0."""
    columns = {"time_key": month_key("time_key"), "source": canonical_id("source"), "dest": canonical_id("dest"), "cents": cents("amount"), "volume": F.col("volume")}
    current = current_rows(raw.select("edge_id", "time_key", "source", "dest", "amount", "volume", "load_ts"), "edge_id", "load_ts", columns)
    current = current.filter("time_key is not null and source is not null and dest is not null")
    zero = F.lit(0).cast("bigint")
    return current.groupBy("time_key", "source", "dest").agg(F.coalesce(F.sum("cents"), zero).alias("cents"), F.coalesce(F.sum("volume"), zero).alias("volume"))


def incidence(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: node, cp (the other end) and dir, ``out`` at the payer and ``in`` at the payee. Other columns stay."""
    rest = [c for c in edges.columns if c not in ("source", "dest")]
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.col("dest").alias("cp"), F.lit("out").alias("dir")),
        F.struct(F.col("dest").alias("node"), F.col("source").alias("cp"), F.lit("in").alias("dir")),
    )
    return edges.select(*rest, F.explode(ends).alias("e")).select(*rest, "e.*")


def node_universe(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "dest")).alias("node")).distinct()


def no_self(edges: DataFrame) -> DataFrame:
    return edges.filter("source <> dest")


# ---- hub ladder


def ladder_basis(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(node, degree, strength): the degree is the sum over months of each month's different counterparties, or with ``distinct`` those of the whole window."""
    inc = incidence(edges)
    if distinct:
        return inc.groupBy("node").agg(F.count_distinct("dir", "cp").alias("degree"), F.sum("cents").alias("strength"))
    # The relation is unique by month and pair, so counting rows counts different counterparties of each month and side.
    return inc.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("cents").alias("strength"))


def build_ladder(edges: DataFrame, tiers: dict[str, float], distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ladder, thresholds): ladder has (version, node) of the nodes above a tier's percentile of degree or of strength; thresholds one row a tier."""
    basis = ladder_basis(edges, distinct)
    both = basis.select(F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("x")) for c in ("degree", "strength")])).alias("b")).select("b.*")
    at = group_quantiles(both, ["of"], "x", tiers).unpivot("of", list(tiers), "version", "x")
    thresholds = at.groupBy("version").agg(*[F.max(F.when(F.col("of") == c, F.col("x"))).alias(f"{c}_at") for c in ("degree", "strength")])
    above = (F.col("degree") > F.col("degree_at")) | (F.col("strength") > F.col("strength_at"))
    ladder = basis.join(F.broadcast(thresholds), above, "inner").select("version", "node")
    return ladder, thresholds


def apply_version(edges: DataFrame, ladder: DataFrame, version: str) -> DataFrame:
    """The edges that touch no node of the version's exclusions, at either end."""
    out = ladder.filter(F.col("version") == version).select("node").distinct()
    return edges.join(out.withColumnRenamed("node", "source"), "source", "left_anti").join(out.withColumnRenamed("node", "dest"), "dest", "left_anti").select(*edges.columns)


def all_versions(edges: DataFrame, ladder: DataFrame, versions: list[str]) -> DataFrame:
    """All versions stacked with a ``version`` column; V0 holds every edge. One pass marks the tiers an edge is left out of."""
    gone = ladder.groupBy("node").agg(F.collect_set("version").alias("gone"))
    marked = edges.join(gone.select(F.col("node").alias("source"), F.col("gone").alias("gs")), "source", "left").join(gone.select(F.col("node").alias("dest"), F.col("gone").alias("gd")), "dest", "left")
    none = F.array().cast("array<string>")
    kept = F.array_except(F.array(*[F.lit(v) for v in versions]), F.array_union(F.coalesce("gs", none), F.coalesce("gd", none)))
    return marked.select(F.explode(kept).alias("version"), *edges.columns)


#: Rules of the older ladders: version, then which measure must exceed which tier; any of them excludes a node.
STRICT_FIRST = {"V1": [("degree", "strict")], "V2": [("strength", "strict")], "V3": [("degree", "strict"), ("strength", "strict")], "V4": [("degree", "broad"), ("strength", "broad")]}
BROAD_FIRST = {"V1": [("degree", "broad")], "V2": [("degree", "strict")], "V3": [("strength", "broad")], "V4": [("degree", "broad"), ("strength", "broad")]}


def older_ladder(edges: DataFrame, rules: dict[str, list[tuple[str, str]]], broad: float = 0.999, strict: float = 0.9999) -> DataFrame:
    """(version, node) of the nodes each version leaves out, by percentiles of degree and strength."""
    basis = ladder_basis(edges)
    at = build_ladder(edges, {"broad": broad, "strict": strict})[1]
    one = at.agg(*[F.max(F.when(F.col("version") == t, F.col(f"{c}_at"))).alias(f"{c}_{t}") for t in ("broad", "strict") for c in ("degree", "strength")])
    marked = basis.withColumn("at", one.select(F.struct("*")).scalar())
    out = lambda rule: [F.col(c) > F.col(f"at.{c}_{t}") for c, t in rule]
    versions = []
    for v, rule in rules.items():
        hit = F.lit(False)
        for cond in out(rule):
            hit = hit | cond
        versions.append(F.when(hit, F.lit(v)))
    return marked.select("node", F.explode(F.array_compact(F.array(*versions))).alias("version")).select("version", "node")


def retention(edges: DataFrame, ladder: DataFrame, versions: list[str]) -> DataFrame:
    """(version, edges_kept, nodes_removed, cents_kept) of V0 and each version, from one pass over the edges."""
    kept = all_versions(edges, ladder, ["V0", *versions]).groupBy("version").agg(F.count(F.lit(1)).alias("edges_kept"), F.sum("cents").alias("cents_kept"))
    gone = ladder.groupBy("version").agg(F.count_distinct("node").alias("nodes_removed"))
    return kept.join(gone, "version", "left").select("version", "edges_kept", F.coalesce("nodes_removed", F.lit(0)).alias("nodes_removed"), "cents_kept")


def hub_nodes_by_degree(edges: DataFrame, cap: int) -> DataFrame:
    """(node, n_neighbors) of nodes with more than ``cap`` different neighbours over the window."""
    n = incidence(no_self(edges)).groupBy("node").agg(F.count_distinct("cp").alias("n_neighbors"))
    return n.filter(F.col("n_neighbors") > cap)


def hub_nodes_by_median(edges: DataFrame, factor: float = 15.0) -> DataFrame:
    """(node, degree) of nodes whose degree is at least ``factor`` times the median degree."""
    degree = incidence(no_self(edges)).groupBy("node").agg(F.count_distinct("cp").alias("degree"))
    return degree.filter(F.col("degree") >= F.lit(factor) * quantile(degree, "degree", 0.5))


# ---- small helpers used by many metrics


def ratio(n: Column | str, d: Column | str, digits: int = 6) -> Column:
    """n / d rounded, null unless d > 0."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (n, d))
    return F.round(F.when(d > 0, n.cast("double") / d.cast("double")), digits)

