"""Queries of the general problems: rolling totals, proximity, orphan references, skewed keys, snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.cleaning import canonical_id, cents, day_date, located, month_key, sql_cents, sql_day, sql_id, sql_month, zip3
from flowquarry.operators import orphans as orp
from flowquarry.operators import proximity, rolling, skew, snapshots
from flowquarry.plans.registry import query
from flowquarry.session import cut, table

# ---- p1 rolling totals


def daily_totals(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "node_metrics_daily")
    days = rolling.current_days(raw, canonical_id("node"), day_date("time_key"), cents("strength"), F.col("load_ts"))
    last = raw.agg(F.max(day_date("time_key"))).scalar()
    return rolling.rolling_totals(days, last)


P1_SQL = f"""
WITH raw AS (SELECT {sql_id("node")} AS node, {sql_day("time_key")} AS day, {sql_cents("strength")} AS cents, load_ts FROM node_metrics_daily),
cur AS (SELECT node, day, cents FROM (SELECT *, row_number() OVER (PARTITION BY node, day ORDER BY load_ts DESC, cents DESC NULLS LAST) AS k FROM raw WHERE node IS NOT NULL) WHERE k = 1),
act AS (SELECT node, day, cents FROM cur WHERE cents > 0),
cal AS (SELECT node, CAST(unnest(generate_series(first_day, (SELECT max(day) FROM raw), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT node, min(day) AS first_day FROM act GROUP BY node)),
full_days AS (SELECT cal.node, cal.day, coalesce(act.cents, 0) AS cents, CASE WHEN act.cents > 0 THEN 1 ELSE 0 END AS active FROM cal LEFT JOIN act ON act.node = cal.node AND act.day = cal.day),
roll AS (SELECT node, day,
  CAST(sum(cents) OVER w7 AS BIGINT) AS total_7, CAST(sum(cents) OVER w30 AS BIGINT) AS total_30,
  CAST(sum(active) OVER w7 AS BIGINT) AS active_7, CAST(sum(active) OVER w30 AS BIGINT) AS active_30,
  row_number() OVER (PARTITION BY node ORDER BY day) AS n
  FROM full_days WINDOW w7 AS (PARTITION BY node ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY node ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""


@query(
    "p1_rolling_totals",
    P1_SQL + "SELECT node, CAST(day AS VARCHAR) AS time_key, total_7, total_30, active_7, active_30, round(total_7 / CAST(700 AS DOUBLE), 6) AS avg_7, round(total_30 / CAST(3000 AS DOUBLE), 6) AS avg_30 FROM roll",
)
def p1_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    return daily_totals(spark, d).withColumn("time_key", F.col("day").cast("string")).drop("day")


@query("p1_found", P1_SQL + "SELECT node, CAST(day AS VARCHAR) AS time_key FROM roll WHERE n >= 30 AND 10 * total_7 >= 7 * total_30 AND active_30 >= 10")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rolled = daily_totals(spark, d)
    # The 30th day from the first on is the one by which 30 calendar rows have passed: the first day is the node's earliest row.
    from pyspark.sql.window import Window

    first = F.min("day").over(Window.partitionBy("node"))
    hit = (F.col("total_7") * 10 >= F.col("total_30") * 7) & (F.col("active_30") >= 10)
    return rolled.withColumn("first_day", first).filter(hit & (F.col("day") >= F.date_add("first_day", 29))).select("node", F.col("day").cast("string").alias("time_key"))


# ---- p3 proximity


def located_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customers").filter(located("lat", "lon"))
    return c.select(canonical_id("node").alias("node"), "lat", "lon", zip3("zip3").alias("zip3")).filter("node is not null")


def areas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zip3_areas").select("area_id", zip3("zip3").alias("area_zip3"), "min_lat", "max_lat", "min_lon", "max_lon")


_LOCATED = f"""
WITH loc AS (SELECT DISTINCT {sql_id("node")} AS node, lat, lon, CASE WHEN length(trim(zip3)) < 3 THEN lpad(trim(zip3), 3, '0') ELSE trim(zip3) END AS zip3 FROM customers
 WHERE isfinite(lat) AND isfinite(lon) AND NOT (lat = 0 AND lon = 0) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
area AS (SELECT lpad(zip3, 3, '0') AS az, min_lat, max_lat, min_lon, max_lon FROM zip3_areas)
"""
_NEAR = """
SELECT DISTINCT 'near' AS kind, a.node AS key_a, b.node AS key_b FROM loc a JOIN loc b ON a.node < b.node AND abs(a.lat - b.lat) < 0.01
WHERE 2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 0.25
"""
_AREA = "SELECT DISTINCT 'area' AS kind, loc.node AS key_a, az AS key_b FROM loc JOIN area ON lat >= min_lat AND lat < max_lat AND lon >= min_lon AND lon < max_lon"


def stray_areas(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """(node, zip3 of the area that holds one of its points) for nodes of which a located row states another zip3."""
    held = proximity.in_boxes(rows, boxes).select("node", "area_zip3").distinct()
    stated = rows.filter("zip3 is not null").select("node", "zip3").distinct()
    return held.join(stated, "node").filter("zip3 <> area_zip3").select("node", "area_zip3").distinct()


@query("p3_found", _LOCATED + _NEAR + "UNION ALL " + _AREA + " JOIN loc s ON s.node = loc.node AND s.zip3 <> az")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(located_rows(spark, d).distinct(), "located")
    near = proximity.near_pairs(rows, 0.25)
    stray = stray_areas(rows, areas(spark, d))
    return near.select(F.lit("near").alias("kind"), "key_a", "key_b").unionByName(stray.select(F.lit("area").alias("kind"), F.col("node").alias("key_a"), F.col("area_zip3").alias("key_b")))


@query("p3_areas", _LOCATED + _AREA)
def p3_areas(spark: SparkSession, d: str) -> DataFrame:
    held = proximity.in_boxes(located_rows(spark, d), areas(spark, d))
    return held.select(F.lit("area").alias("kind"), F.col("node").alias("key_a"), F.col("area_zip3").alias("key_b")).distinct()


@query(
    "p3_places",
    _LOCATED
    + """, pl AS (SELECT lat, lon, count(DISTINCT node) AS n_keys FROM loc WHERE node IS NOT NULL GROUP BY lat, lon),
lk AS (SELECT a.lat, a.lon, b.n_keys AS k FROM pl a JOIN pl b ON abs(a.lat - b.lat) < 0.01 AND (a.lat <> b.lat OR a.lon <> b.lon)
 WHERE 2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 0.25)
SELECT pl.lat, pl.lon, n_keys, count(k) AS n_places, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_near FROM pl LEFT JOIN lk ON lk.lat = pl.lat AND lk.lon = pl.lon GROUP BY pl.lat, pl.lon, n_keys""",
)
def p3_places(spark: SparkSession, d: str) -> DataFrame:
    """A row a place with the nodes there and those of other places at most 0.25 km away: the pairs of p3_found by class, without writing each."""
    return proximity.near_places(located_rows(spark, d), 0.25)


# ---- p4 orphan references


def all_references(spark: SparkSession, d: str) -> DataFrame:
    e = orp.references(table(spark, d, "edges"), "edges", ["source", "dest"], F.col("time_key"))
    return e.unionByName(orp.references(table(spark, d, "node_metrics"), "node_metrics", ["node"], F.col("time_key")))


_REFS = f"""
WITH refs AS (
 SELECT 'edges' AS table_name, 'source' AS field_name, {sql_month("time_key")} AS time_key, {sql_id("source")} AS node FROM edges UNION ALL
 SELECT 'edges', 'dest', {sql_month("time_key")}, {sql_id("dest")} FROM edges UNION ALL
 SELECT 'node_metrics', 'node', {sql_month("time_key")}, {sql_id("node")} FROM node_metrics),
r AS (SELECT table_name, field_name, time_key, node, count(*) AS n_rows FROM refs WHERE node IS NOT NULL GROUP BY ALL),
par AS (SELECT {sql_id("node")} AS node, strftime(loaded_at, '%Y-%m') AS lm, strftime(deleted_at, '%Y-%m') AS dm FROM customers),
lost AS (SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM par WHERE par.node = r.node) THEN 'missing'
  WHEN NOT EXISTS (SELECT 1 FROM par WHERE par.node = r.node AND par.lm <= r.time_key) THEN 'late' ELSE 'deleted' END AS kind
 FROM r WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.node = r.node AND par.lm <= r.time_key AND coalesce(par.dm, '9999-12') >= r.time_key))
"""


@query("p4_found", _REFS + "SELECT table_name, field_name, time_key, node, kind FROM lost")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orp.orphans(all_references(spark, d), orp.presence(table(spark, d, "customers"))).drop("n_rows")


@query(
    "p4_report",
    _REFS
    + """SELECT r.table_name, r.field_name, r.time_key, count(*) AS n_ids, CAST(sum(r.n_rows) AS BIGINT) AS n_rows,
 count(*) FILTER (lost.kind = 'missing') AS ids_missing, CAST(coalesce(sum(r.n_rows) FILTER (lost.kind = 'missing'), 0) AS BIGINT) AS rows_missing,
 count(*) FILTER (lost.kind = 'late') AS ids_late, CAST(coalesce(sum(r.n_rows) FILTER (lost.kind = 'late'), 0) AS BIGINT) AS rows_late,
 count(*) FILTER (lost.kind = 'deleted') AS ids_deleted, CAST(coalesce(sum(r.n_rows) FILTER (lost.kind = 'deleted'), 0) AS BIGINT) AS rows_deleted
 FROM r LEFT JOIN lost ON lost.table_name = r.table_name AND lost.field_name = r.field_name AND lost.time_key = r.time_key AND lost.node = r.node
 GROUP BY r.table_name, r.field_name, r.time_key""",
)
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    refs = all_references(spark, d)
    return orp.orphan_report(refs, orp.orphans(refs, orp.presence(table(spark, d, "customers"))))


# ---- p6 skewed keys


def edge_ends(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, node, other, cents): each end of each row of edges as delivered, with the other end."""
    e = table(spark, d, "edges").select(canonical_id("source").alias("s"), canonical_id("dest").alias("t"), F.coalesce(cents("amount"), F.lit(0)).alias("cents"))
    ends = F.array(
        F.struct(F.lit("source").alias("field_name"), F.col("s").alias("node"), F.col("t").alias("other")),
        F.struct(F.lit("dest").alias("field_name"), F.col("t").alias("node"), F.col("s").alias("other")),
    )
    return e.select(F.explode(ends).alias("x"), "cents").select("x.*", "cents").filter("node is not null")


def node_totals(spark: SparkSession, d: str) -> DataFrame:
    pairs = edge_ends(spark, d).groupBy("field_name", "node", "other").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("cents"))
    pairs = cut(pairs, "pairs")
    plan = skew.plan_fragments(pairs, ["field_name", "node"])
    return skew.balanced_totals(pairs, ["field_name", "node"], "other", plan)


_ENDS = f"""
WITH e AS (SELECT {sql_id("source")} AS s, {sql_id("dest")} AS t, coalesce({sql_cents("amount")}, 0) AS cents FROM edges),
ends AS (SELECT 'source' AS field_name, s AS node, t AS other, cents FROM e WHERE s IS NOT NULL UNION ALL SELECT 'dest', t, s, cents FROM e WHERE t IS NOT NULL),
tot AS (SELECT field_name, node, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS cents, count(DISTINCT other) AS n_other FROM ends GROUP BY field_name, node)
"""


@query("p6_found", _ENDS + "SELECT field_name, node FROM tot WHERE 50 * n_rows >= (SELECT count(*) FROM edges)")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "edges").agg(F.count(F.lit(1))).scalar()
    return node_totals(spark, d).filter(F.col("n_rows") * 50 >= total).select("field_name", "node")


@query("p6_totals", _ENDS + "SELECT * FROM tot")
def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    return node_totals(spark, d)


@query(
    "p6_partner_types",
    _ENDS
    + f""", party AS (SELECT {sql_id("node")} AS node, min(party_type) AS party_type FROM customers GROUP BY 1)
SELECT field_name, ends.node, count(*) FILTER (party_type = 'P') AS rows_person, count(*) FILTER (party_type = 'O') AS rows_organisation, count(*) FILTER (party_type IS NULL) AS rows_other
FROM ends LEFT JOIN party ON party.node = ends.other GROUP BY field_name, ends.node""",
)
def p6_partner_types(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the other end's party type; the join to the parties is by the other end, where hubs hold most rows."""
    ends = edge_ends(spark, d).groupBy("field_name", "node", "other").agg(F.count(F.lit(1)).alias("n_rows"))
    party = table(spark, d, "customers").select(canonical_id("node").alias("other"), "party_type").filter("other is not null").groupBy("other").agg(F.min("party_type").alias("party_type"))
    plan = skew.plan_fragments(ends, ["other"])
    met = skew.fragment_replicate_join(ends, party, ["other"], F.col("node"), plan, "left")
    n = lambda cond: F.sum(F.when(cond, F.col("n_rows")).otherwise(0)).alias
    t = F.col("party_type")
    return met.groupBy("field_name", "node").agg(n(t == "P")("rows_person"), n(t == "O")("rows_organisation"), n(t.isNull())("rows_other"))


# ---- p7 snapshot changes


def edge_changes(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "edges").select("edge_id", "time_key", "source", "dest", "amount", "load_ts")
    columns = {"time_key": month_key("time_key"), "key_a": canonical_id("source"), "key_b": canonical_id("dest"), "cents": cents("amount")}
    current = snapshots.current_rows(raw, "edge_id", "load_ts", columns).filter("key_a is not null and key_b is not null and time_key is not null")
    pairs = current.groupBy("key_a", "key_b", "time_key").agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))
    periods = snapshots.snapshot_ranks(raw.select(month_key("time_key").alias("m")), "m")
    # xxhash64 of a single bigint is one to one, so equal hashes are equal totals.
    spans = snapshots.validity_intervals(pairs, ["key_a", "key_b"], "time_key", F.xxhash64("cents"), periods)
    return snapshots.change_events(spans, ["key_a", "key_b"], periods)


def node_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "node_metrics").select(month_key("time_key").alias("time_key"), F.trim("version").alias("key_a"), canonical_id("node").alias("key_b"))
    periods = snapshots.snapshot_ranks(rows, "time_key")
    there = rows.filter("key_a is not null and key_b is not null and time_key is not null").distinct()
    spans = snapshots.validity_intervals(there, ["key_a", "key_b"], "time_key", F.lit(0).cast("bigint"), periods)
    return snapshots.change_events(spans, ["key_a", "key_b"], periods)


P7_SQL = f"""
WITH raw AS (SELECT edge_id, {sql_month("time_key")} AS m, {sql_id("source")} AS s, {sql_id("dest")} AS t, {sql_cents("amount")} AS c, load_ts FROM edges),
cur AS (SELECT m, s, t, c FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY load_ts DESC) AS k FROM raw) WHERE k = 1 AND s IS NOT NULL AND t IS NOT NULL),
em AS (SELECT m, dense_rank() OVER (ORDER BY m) AS r FROM (SELECT DISTINCT m FROM raw)),
ep AS (SELECT s AS a, t AS b, r, coalesce(sum(c), 0) AS c FROM cur JOIN em USING (m) GROUP BY s, t, r),
nraw AS (SELECT DISTINCT {sql_month("time_key")} AS m, trim(version) AS a, {sql_id("node")} AS b FROM node_metrics),
nm AS (SELECT m, dense_rank() OVER (ORDER BY m) AS r FROM (SELECT DISTINCT m FROM nraw)),
np AS (SELECT a, b, r, 0 AS c FROM nraw JOIN nm USING (m) WHERE a IS NOT NULL AND b IS NOT NULL),
ech AS (SELECT coalesce(y.r, x.r + 1) AS r, coalesce(y.a, x.a) AS key_a, coalesce(y.b, x.b) AS key_b, CASE WHEN x.a IS NULL THEN 'added' WHEN y.a IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
 FROM ep x FULL JOIN ep y ON x.a = y.a AND x.b = y.b AND y.r = x.r + 1 WHERE x.a IS NULL OR y.a IS NULL OR x.c <> y.c),
nch AS (SELECT coalesce(y.r, x.r + 1) AS r, coalesce(y.a, x.a) AS key_a, coalesce(y.b, x.b) AS key_b, CASE WHEN x.a IS NULL THEN 'added' ELSE 'removed' END AS change_kind
 FROM np x FULL JOIN np y ON x.a = y.a AND x.b = y.b AND y.r = x.r + 1 WHERE x.a IS NULL OR y.a IS NULL)
SELECT 'edges' AS table_name, m AS time_key, key_a, key_b, change_kind FROM ech JOIN em USING (r) WHERE r > 1
UNION ALL SELECT 'node_metrics', m, key_a, key_b, change_kind FROM nch JOIN nm USING (r) WHERE r > 1
"""


@query("p7_found", P7_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    e = edge_changes(spark, d).select(F.lit("edges").alias("table_name"), "time_key", "key_a", "key_b", "change_kind")
    return e.unionByName(node_changes(spark, d).select(F.lit("node_metrics").alias("table_name"), "time_key", "key_a", "key_b", "change_kind"))


@query("p7_summary", P7_SQL.replace("SELECT 'edges' AS", ", found AS (SELECT 'edges' AS", 1) + ") SELECT table_name, time_key, change_kind, count(*) AS n FROM found GROUP BY ALL")
def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return p7_found(spark, d).groupBy("table_name", "time_key", "change_kind").agg(F.count(F.lit(1)).alias("n"))
