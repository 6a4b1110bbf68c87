"""Shared views of the queries: the edge relation and the party dimension, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.cleaning import sql_cents, sql_id, sql_month
from flowquarry.operators import edges as eg
from flowquarry.operators import parties as pt
from flowquarry.session import cut, table


def edges(spark: SparkSession, d: str) -> DataFrame:
    return eg.payments(table(spark, d, "edges"))


def edges_once(spark: SparkSession, d: str) -> DataFrame:
    """The same, written to the shared folder first, for queries that read the relation several times."""
    return cut(edges(spark, d), "edges")


def parties(spark: SparkSession, d: str) -> DataFrame:
    return pt.load_parties(table(spark, d, "customers"))


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """(node, sector): two-digit sector where the code is valid."""
    return parties(spark, d).select("node", F.col("naics2").alias("sector"))


def partition(spark: SparkSession, d: str) -> DataFrame:
    """(node, grp): a given partition of the nodes, by state; parties without a state have no group."""
    return parties(spark, d).select("node", F.col("state").alias("grp")).filter("grp is not null")


E = f"""
WITH eraw AS (SELECT edge_id, {sql_month("time_key")} AS time_key, {sql_id("source")} AS source, {sql_id("dest")} AS dest, {sql_cents("amount")} AS cents, volume, load_ts FROM edges),
ecur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY load_ts DESC, time_key DESC NULLS LAST, source DESC NULLS LAST, dest DESC NULLS LAST, cents DESC NULLS LAST, volume DESC NULLS LAST) AS k FROM eraw) WHERE k = 1 AND source IS NOT NULL AND dest IS NOT NULL),
e AS (SELECT time_key, source, dest, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents, CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume FROM ecur GROUP BY ALL),
inc AS (SELECT time_key, source AS node, dest AS cp, 'out' AS dir, cents, volume FROM e UNION ALL SELECT time_key, dest, source, 'in', cents, volume FROM e)
"""

_NAICS = "nullif(trim(naics_cd), '')"
_PLACE = ", ".join(f"'{x}'" for x in pt.PLACEHOLDER_CODES)
_OK = "coalesce(isfinite(lat) AND isfinite(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0), false)"
_WORDS = "|".join(pt.BUSINESS_WORDS)
_RANK = "CASE upper(trim(addr_loc_rec_type)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pt.GEO_RANKS.items()) + " ELSE 0 END"


def status_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'missing' WHEN upper({c}) IN ({_PLACE}) THEN 'placeholder' WHEN regexp_matches({c}, '^[0-9]{{2}}') THEN 'valid' ELSE 'placeholder' END"


def name_type_sql(c: str) -> str:
    n = f"trim(regexp_replace(regexp_replace(upper({c}), '[^A-Z0-9& ]', ' ', 'g'), ' +', ' ', 'g'))"
    return f"CASE WHEN {n} IS NULL OR {n} = '' THEN NULL WHEN regexp_matches({n}, '(^| )({_WORDS})( |$)') THEN 'business' WHEN regexp_matches({n}, '^[A-Z]+ [A-Z]+( [A-Z]+)?$') THEN 'individual' ELSE 'unknown' END"


#: party: one row a node with all derived columns; goes after a WITH or another view.
PARTY = f"""
craw AS (SELECT rec_id, {sql_id("node")} AS node, nullif(trim(cust_name), '') AS cust_name, nullif(trim(party_type), '') AS party_type, {_NAICS} AS naics_cd, lat, lon,
  CASE WHEN length(nullif(trim(zip3), '')) < 3 THEN lpad(trim(zip3), 3, '0') ELSE nullif(trim(zip3), '') END AS zip3, state, city, addr_loc_rec_type, {_OK} AS ok FROM customers),
cscore AS (SELECT *, CASE WHEN ok OR zip3 IS NOT NULL THEN {_RANK} ELSE -1 END AS s FROM craw WHERE node IS NOT NULL),
cgeo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY s DESC, rec_id) AS k FROM cscore) WHERE k = 1),
cid AS (SELECT node, arg_min(cust_name, rec_id) FILTER (cust_name IS NOT NULL) AS cust_name, arg_min(party_type, rec_id) FILTER (party_type IS NOT NULL) AS party_type,
  arg_min(naics_cd, rec_id) FILTER (naics_cd IS NOT NULL) AS naics_cd, count(*) AS n_rows, count(DISTINCT cust_name) > 1 AS name_conflict, count(DISTINCT CASE WHEN ok THEN (lat, lon) END) > 1 AS point_conflict FROM cscore GROUP BY node),
p0 AS (SELECT cid.*, CASE WHEN cgeo.ok THEN cgeo.lat END AS lat, CASE WHEN cgeo.ok THEN cgeo.lon END AS lon, cgeo.zip3, cgeo.state, cgeo.city, cgeo.addr_loc_rec_type, cgeo.ok, CASE upper(substr(party_type, 1, 1)) WHEN 'P' THEN 'individual' WHEN 'O' THEN 'business' END AS entity_observed,
  nullif({name_type_sql("cid.cust_name")}, 'unknown') AS entity_inferred, {status_sql("cid.naics_cd")} AS naics_status, coalesce(upper(cid.naics_cd) IN ({_PLACE}), false) AS held, upper(coalesce(trim(cgeo.addr_loc_rec_type), '')) AS adr
  FROM (SELECT * FROM cid) cid JOIN (SELECT node, lat, lon, zip3, state, city, addr_loc_rec_type, ok FROM cgeo) cgeo USING (node)),
p1 AS (SELECT *, coalesce(entity_observed, entity_inferred, 'unknown') AS entity, CASE WHEN entity_observed IS NOT NULL THEN 'party_type' WHEN entity_inferred IS NOT NULL THEN 'name' ELSE 'none' END AS entity_source,
  CASE WHEN naics_status = 'valid' THEN regexp_extract(naics_cd, '^([0-9]+)', 1) END AS digits FROM p0),
party AS (SELECT * EXCLUDE (held, adr), CASE WHEN length(digits) >= 2 THEN substr(digits, 1, 2) END AS naics2, CASE WHEN length(digits) >= 3 THEN substr(digits, 1, 3) END AS naics3, CASE WHEN length(digits) >= 4 THEN substr(digits, 1, 4) END AS naics4, CASE WHEN length(digits) >= 6 THEN substr(digits, 1, 6) END AS naics6,
  CASE WHEN naics_status = 'valid' THEN 'valid' WHEN entity <> 'business' THEN 'not_applicable' WHEN held THEN 'placeholder' ELSE 'missing' END AS naics_coverage,
  CASE WHEN entity = 'business' AND naics_status = 'valid' THEN 'business_naics_valid' WHEN entity = 'business' AND held THEN 'business_naics_placeholder' WHEN entity = 'business' AND naics_status = 'missing' THEN 'business_naics_missing' WHEN entity = 'individual' THEN 'individual' ELSE 'unknown' END AS node_type,
  CASE WHEN naics_status = 'valid' THEN 'business_naics_valid' WHEN entity_inferred = 'business' AND held THEN 'business_naics_placeholder' WHEN entity_inferred = 'business' AND naics_status = 'missing' THEN 'business_naics_missing' WHEN entity_inferred = 'individual' THEN 'individual' ELSE 'unknown' END AS node_type_v5,
  CASE WHEN entity = 'business' AND naics_status = 'valid' THEN 'business_naics_valid' WHEN entity = 'business' AND held THEN 'business_naics_placeholder' WHEN entity = 'business' AND naics_status = 'missing' THEN 'business_naics_missing' WHEN entity = 'individual' AND naics_status = 'valid' THEN 'individual_naics_valid' WHEN entity = 'individual' THEN 'individual' WHEN naics_status = 'valid' THEN 'unknown_naics_valid' ELSE 'unknown' END AS entity_class,
  CASE WHEN NOT ok THEN 'missing' WHEN adr IN ('POSTOFFICEBOX', 'GENERALDELIVERY') THEN 'placeholder' ELSE 'valid' END AS geo_status,
  CASE WHEN (cust_name IS NOT NULL OR party_type IS NOT NULL OR naics_cd IS NOT NULL) AND ok THEN 'identity+geo' WHEN cust_name IS NOT NULL OR party_type IS NOT NULL OR naics_cd IS NOT NULL THEN 'identity_only' WHEN ok THEN 'geo_only' ELSE 'neither' END AS attr_profile,
  CAST(adr IN ('HIGHRISE') AS INTEGER) AS shared_structure FROM p1)
"""
WP = "WITH " + PARTY
EP = E + ", " + PARTY


def rsql(n: str, d: str, k: int = 6) -> str:
    """n / d rounded, null unless d > 0."""
    return f"round(CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END, {k})"
