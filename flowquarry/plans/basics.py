"""Queries on parties, profiles, and the plain relational operators, on the payment tables and on orders, events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions.cleaning import canonical_id, day_date, month_key, sql_day, sql_id, sql_month
from flowquarry.functions.ranks import group_quantiles, with_average_rank
from flowquarry.operators import edges as eg
from flowquarry.operators import geo_block as gb
from flowquarry.operators import iterative as it
from flowquarry.operators import parties as pt
from flowquarry.operators import profiles as pf
from flowquarry.operators import temporal as tm
from flowquarry.plans.base import E, EP, WP, edges, edges_once, name_type_sql, parties, rsql, status_sql
from flowquarry.plans.flow import _LADDER, TIERS
from flowquarry.plans.geography import SPREAD_ROWS, hav, points
from flowquarry.plans.graph import W
from flowquarry.plans.registry import query
from flowquarry.plans.temporal import T
from flowquarry.session import cut, table
from flowquarry.sources import readers as rd

# ---- sources


@query("s09_inventory", f"SELECT {sql_month('time_key')} AS time_key, count(*) AS n_rows FROM edges GROUP BY 1")
def s09(spark: SparkSession, d: str) -> DataFrame:
    return rd.partitions_of(table(spark, d, "edges").select(month_key("time_key").alias("time_key")), "time_key")


@query("s09_latest", f"SELECT count(*) AS n FROM node_metrics WHERE {sql_month('time_key')} = (SELECT max({sql_month('time_key')}) FROM node_metrics)")
def s09l(spark: SparkSession, d: str) -> DataFrame:
    return rd.latest(table(spark, d, "node_metrics").select(month_key("time_key").alias("time_key")), "time_key").agg(F.count(F.lit(1)).alias("n"))


@query("s11_top_nodes", f"SELECT {sql_id('node')} AS node, max(strength) AS strength FROM node_metrics WHERE version = 'V0' AND {sql_id('node')} IS NOT NULL AND strength IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def s11(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "node_metrics").filter("version = 'V0' and strength is not null").groupBy(canonical_id("node").alias("node")).agg(F.max("strength").alias("strength"))
    return rd.top_nodes(m.filter("node is not null"), "strength", 50)


@query("s05_aliases", f"SELECT {sql_id('node')} AS party_id, cust_name AS customer_name, CAST(NULL AS VARCHAR) AS naics_desc FROM customers")
def s05(spark: SparkSession, d: str) -> DataFrame:
    c = rd.with_aliases(table(spark, d, "customers"), {"party_id": ["node"], "customer_name": ["cust_name", "name"], "naics_desc": ["naics_description"]}, optional=["naics_desc"])
    return c.withColumn("party_id", canonical_id("party_id"))


# ---- cleaning


@query("p03_canonical_ids", f"SELECT node AS raw, {sql_id('node')} AS node, count(*) AS n FROM customers GROUP BY 1, 2")
def p03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customers").groupBy(F.col("node").alias("raw"), canonical_id("node").alias("node")).agg(F.count(F.lit(1)).alias("n"))


@query("p04_text_or_null", "SELECT nullif(trim(cust_name), '') AS name, count(*) AS n FROM customers GROUP BY 1")
def p04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customers").groupBy(pt.text_or_null("cust_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("p05_numeric_text", r"SELECT naics_cd, CASE WHEN regexp_matches(naics_cd, '^\s*-?\d+(\.\d+)?\s*$') THEN TRY_CAST(trim(naics_cd) AS DOUBLE) END AS number, count(*) AS n FROM customers GROUP BY 1, 2")
def p05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customers").groupBy("naics_cd", pt.numeric_text("naics_cd").alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("p06_zip5", "SELECT zip3, substr(lpad(nullif(regexp_replace(zip3, '[^0-9]', '', 'g'), ''), 5, '0'), 1, 5) AS zip5, count(*) AS n FROM customers GROUP BY 1, 2")
def p06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customers").groupBy("zip3", pt.zip_digits("zip3").alias("zip5")).agg(F.count(F.lit(1)).alias("n"))


@query("p09_zip_shapes", r"SELECT CASE WHEN zip3 IS NULL THEN 'null' WHEN trim(zip3) = '' THEN 'empty' WHEN regexp_matches(trim(zip3), '^\d{5}-\d{4}$') THEN 'zip9_dash' WHEN regexp_matches(trim(zip3), '^\d{9}$') THEN 'zip9' WHEN regexp_matches(trim(zip3), '^\d{5}$') THEN 'zip5' WHEN regexp_matches(trim(zip3), '^\d{1,4}$') THEN 'short' ELSE 'other' END AS shape, count(*) AS n FROM customers GROUP BY 1")
def p09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customers").groupBy(pt.zip_shape("zip3").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("p10_name_flags", r"SELECT node, regexp_matches(upper(cust_name), '\bP\.? ?O\.? BOX\b') AS po_box, regexp_matches(upper(cust_name), '(^| )C/O( |$)') AS care_of, regexp_matches(upper(cust_name), '& SONS') AS and_sons FROM customers")
def p10n(spark: SparkSession, d: str) -> DataFrame:
    n = F.upper("cust_name")
    return table(spark, d, "customers").select("node", n.rlike(r"\bP\.? ?O\.? BOX\b").alias("po_box"), n.rlike(r"(^| )C/O( |$)").alias("care_of"), n.rlike("& SONS").alias("and_sons"))


@query("p11_hash_keys")
def p11(spark: SparkSession, d: str) -> DataFrame:
    """Stable 64-bit keys of a party's address columns; no other engine has the same hash."""
    return table(spark, d, "customers").select("rec_id", F.xxhash64("addr_loc_rec_type", "zip3", "state", "city").alias("address_key"), F.xxhash64("lat", "lon").alias("point_key"))


@query("p13_naics_levels", WP + "SELECT naics_cd, naics2, naics3, naics4, naics6, count(*) AS n FROM party GROUP BY ALL")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return parties(spark, d).groupBy("naics_cd", "naics2", "naics3", "naics4", "naics6").agg(F.count(F.lit(1)).alias("n"))


@query("p14_p15_naics_status", WP + "SELECT naics_status, naics_coverage, count(*) AS n FROM party GROUP BY ALL")
def p14(spark: SparkSession, d: str) -> DataFrame:
    return parties(spark, d).groupBy("naics_status", "naics_coverage").agg(F.count(F.lit(1)).alias("n"))


@query("p16_name_types", WP + "SELECT cust_name, entity_inferred FROM party")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return parties(spark, d).select("cust_name", "entity_inferred")


@query("p17_p19_types", WP + "SELECT entity, entity_source, node_type, node_type_v5, entity_class, geo_status, attr_profile, shared_structure, count(*) AS n FROM party GROUP BY ALL")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return parties(spark, d).groupBy("entity", "entity_source", "node_type", "node_type_v5", "entity_class", "geo_status", "attr_profile", "shared_structure").agg(F.count(F.lit(1)).alias("n"))


@query("p24_party_classes", WP + f"SELECT CASE WHEN naics_status = 'valid' AND b THEN '1_biz_both' WHEN naics_status = 'valid' THEN '2_biz_naics_only' WHEN b THEN '3_biz_name_only' ELSE '4_consumer_like' END AS party_class, count(*) AS n, {rsql('count(*) FILTER (ok)', 'count(*)')} AS located_share FROM (SELECT *, coalesce({name_type_sql('cust_name')} = 'business', false) AS b FROM party) GROUP BY 1")
def p24(spark: SparkSession, d: str) -> DataFrame:
    """Parties by the two classifiers, code and name, with the share that is located."""
    p = parties(spark, d)
    return p.groupBy(pt.party_class("cust_name", "naics_cd").alias("party_class")).agg(F.count(F.lit(1)).alias("n"), eg.ratio(F.count_if(F.col("geo_status") != "missing"), F.count(F.lit(1))).alias("located_share"))


@query("p20_j05_graph_parties", EP + "SELECT party.node FROM party WHERE node IN (SELECT source FROM e UNION SELECT dest FROM e)")
def p20(spark: SparkSession, d: str) -> DataFrame:
    return parties(spark, d).join(eg.node_universe(edges(spark, d)), "node", "left_semi").select("node")


@query("j06_unmatched", EP + "SELECT node FROM (SELECT source AS node FROM e UNION SELECT dest FROM e) WHERE node NOT IN (SELECT node FROM party)")
def j06(spark: SparkSession, d: str) -> DataFrame:
    return eg.node_universe(edges(spark, d)).join(parties(spark, d).select("node"), "node", "left_anti")


@query("p32_match_rate", EP + f", u AS (SELECT source AS node FROM e UNION SELECT dest FROM e) SELECT count(*) AS n_keys, round(count(p.node) / CAST(count(*) AS DOUBLE), 6) AS match_rate FROM u LEFT JOIN party p USING (node)")
def p32(spark: SparkSession, d: str) -> DataFrame:
    return pt.match_rate(eg.node_universe(edges(spark, d)), parties(spark, d), "node")


_FORMS = {"as_is": "k", "trimmed": "t", "upper": "upper(t)", "no_decimals": r"regexp_replace(t, '\.0+$', '')", "no_zeros": r"regexp_replace(t, '^0+(.)', '\1')"}


@query(
    "p33_key_tournament",
    "WITH a AS (SELECT DISTINCT source AS k, trim(source, ' ' || chr(9) || chr(13) || chr(10)) AS t, "
    + sql_id("source") + " AS c FROM edges WHERE source IS NOT NULL), b AS (SELECT DISTINCT node AS k, trim(node, ' ' || chr(9) || chr(13) || chr(10)) AS t, " + sql_id("node") + " AS c FROM customers WHERE node IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n_match FROM (SELECT DISTINCT {x} AS v FROM a WHERE {x} IS NOT NULL) WHERE v IN (SELECT {x} FROM b WHERE {x} IS NOT NULL)" for n, x in {**_FORMS, "canonical": "c"}.items()),
)
def p33(spark: SparkSession, d: str) -> DataFrame:
    return pt.key_tournament(table(spark, d, "edges").select(F.col("source").alias("node")), table(spark, d, "customers"), "node")


@query("p34_id_shapes", r"SELECT CAST(length(node) AS INTEGER) AS n_chars, CASE WHEN node IS NULL THEN 'null' WHEN trim(node) = '' THEN 'blank' WHEN regexp_matches(node, '^[0-9]+$') THEN 'digits' WHEN regexp_matches(node, '^[0-9]+\.[0-9]+$') THEN 'decimal' WHEN regexp_matches(node, '^\s|\s$') THEN 'padded' WHEN regexp_matches(node, '^[0-9A-Za-z]+$') THEN 'alphanumeric' ELSE 'other' END AS kind, count(*) AS n FROM customers GROUP BY 1, 2")
def p34(spark: SparkSession, d: str) -> DataFrame:
    return pt.id_shapes(table(spark, d, "customers"), "node")


_GATE = {"business": "entity = 'business'", "located": "geo_status IN ('valid', 'placeholder')", "valid_sector": "naics_status = 'valid'"}


@query("p25_p29_funnel", WP + ", f AS (SELECT count(*) FILTER (a) AS n1, count(*) FILTER (a AND b) AS n2, count(*) FILTER (a AND b AND c) AS n3 FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in zip("abc", _GATE.values(), strict=True)) + " FROM party)) SELECT 1 AS position, 'business' AS step, n1 AS n_kept FROM f UNION ALL SELECT 2, 'located', n2 FROM f UNION ALL SELECT 3, 'valid_sector', n3 FROM f")
def p25(spark: SparkSession, d: str) -> DataFrame:
    return pt.funnel(parties(spark, d), {k: F.expr(v) for k, v in _GATE.items()})


@query(
    "p30_text_profile",
    "WITH x AS (SELECT cust_name AS c, cust_name IS NOT NULL AND trim(cust_name) <> '' AS f FROM customers) SELECT count(*) AS n_rows, count(*) FILTER (c IS NULL) AS n_null, count(*) FILTER (trim(c) = '') AS n_blank, "
    + ", ".join(f"round(count(*) FILTER (f AND {cond}) / CAST(count(*) FILTER (f) AS DOUBLE), 6) AS {n}" for n, cond in {"capitals_share": "c = upper(c)", "digit_share": "regexp_matches(c, '[0-9]')", "special_share": "regexp_matches(c, '[^A-Za-z0-9 ]')"}.items())
    + ", CAST(min(length(c)) FILTER (f) AS INTEGER) AS least_chars, CAST(max(length(c)) FILTER (f) AS INTEGER) AS most_chars, round(avg(length(c)) FILTER (f), 6) AS mean_chars FROM x",
)
def p30(spark: SparkSession, d: str) -> DataFrame:
    return pt.text_profile(table(spark, d, "customers"), "cust_name")


@query("k03_disagreement", WP + "SELECT coalesce(entity_observed, 'none') AS observed, coalesce(entity_inferred, 'none') AS inferred, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM party) AS DOUBLE), 6) AS share FROM party GROUP BY 1, 2")
def k03(spark: SparkSession, d: str) -> DataFrame:
    return pt.disagreement(parties(spark, d))


@query("k04_coverage", WP + "SELECT count(*) AS n_nodes, " + ", ".join(f"round(count(*) FILTER ({c}) / CAST(count(*) AS DOUBLE), 6) AS {n}" for n, c in {"observed_share": "entity_observed IS NOT NULL", "typed_share": "entity <> 'unknown'", "naics_valid_share": "naics_status = 'valid'", "located_share": "geo_status IN ('valid', 'placeholder')", "repeated_share": "n_rows > 1"}.items()) + " FROM party")
def k04(spark: SparkSession, d: str) -> DataFrame:
    return pt.coverage_report(parties(spark, d))


@query("k43_repeated_parties", f"SELECT n_rows, n_values, count(*) AS n_keys FROM (SELECT {sql_id('node')} AS node, count(*) AS n_rows, count(DISTINCT city) AS n_values FROM customers GROUP BY 1) GROUP BY ALL")
def k43(spark: SparkSession, d: str) -> DataFrame:
    return pf.repeated_profile(table(spark, d, "customers").select(canonical_id("node").alias("node"), "city"), "node", "city")


@query("k45_role_lift", WP + ", c AS (SELECT state, node_type, count(*) AS n FROM party WHERE state IS NOT NULL AND node_type IS NOT NULL GROUP BY ALL) SELECT state, node_type, n, round(n / CAST(sum(n) OVER (PARTITION BY state) AS DOUBLE), 6) AS share, round(n / CAST(sum(n) OVER (PARTITION BY state) AS DOUBLE) / (sum(n) OVER (PARTITION BY node_type) / CAST((SELECT sum(n) FROM c) AS DOUBLE)), 6) AS lift FROM c")
def k45r(spark: SparkSession, d: str) -> DataFrame:
    return pf.role_lift(parties(spark, d), "state", "node_type")


_HIST = f"WITH h AS (SELECT {sql_id('node')} AS node, rec_id, zip3, city, CASE WHEN isfinite(lat) AND isfinite(lon) THEN lat END AS lat, CASE WHEN isfinite(lat) AND isfinite(lon) THEN lon END AS lon FROM customers WHERE {sql_id('node')} IS NOT NULL) "


def history(spark: SparkSession, d: str) -> DataFrame:
    fin = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))
    ok = fin("lat") & fin("lon")
    return table(spark, d, "customers").select(canonical_id("node").alias("node"), "rec_id", "zip3", "city", F.when(ok, F.col("lat")).alias("lat"), F.when(ok, F.col("lon")).alias("lon")).filter("node is not null")


@query(
    "m18_change_log",
    _HIST + "SELECT node, rec_id, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN a AND p THEN 'both' WHEN a THEN 'address' WHEN p THEN 'point' ELSE 'none' END AS change FROM (SELECT *, lag(zip3) OVER v IS DISTINCT FROM zip3 OR lag(city) OVER v IS DISTINCT FROM city AS a, lag(lat) OVER v IS DISTINCT FROM lat OR lag(lon) OVER v IS DISTINCT FROM lon AS p FROM h WINDOW v AS (PARTITION BY node ORDER BY rec_id)) WINDOW w AS (PARTITION BY node ORDER BY rec_id)",
)
def m18(spark: SparkSession, d: str) -> DataFrame:
    return pf.change_log(history(spark, d), "node", "rec_id", F.struct("zip3", "city"), F.struct("lat", "lon"))


@query(
    "m18_move_classes",
    _HIST + f", k AS (SELECT node, rec_id, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS km FROM h WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat BETWEEN -90 AND 90 WINDOW w AS (PARTITION BY node ORDER BY rec_id)) SELECT node, rec_id, round(km, 3) AS km, CASE WHEN km IS NULL THEN 'first' WHEN km < 1e-6 THEN 'none' WHEN km < 0.1 THEN 'jitter' WHEN km < 5 THEN 'local' WHEN km < 50 THEN 'city' WHEN km < 250 THEN 'regional' ELSE 'far' END AS move FROM k",
)
def m18m(spark: SparkSession, d: str) -> DataFrame:
    return pf.move_class(history(spark, d).filter("lat between -90 and 90"), "node", "rec_id")


@query(
    "k47_sign_agreement",
    E + ", f AS (SELECT time_key, node, sum(CASE WHEN dir = 'in' THEN cents ELSE -cents END) AS net FROM inc GROUP BY ALL), g AS (SELECT time_key, node, sum(CASE WHEN dir = 'in' THEN cents ELSE -cents END) AS net FROM inc WHERE node <> cp AND cents >= 10000 GROUP BY ALL) SELECT count(*) AS n, round(count(*) FILTER (sign(f.net) = sign(g.net)) / CAST(count(*) AS DOUBLE), 6) AS agree FROM f JOIN g USING (time_key, node)",
)
def k47(spark: SparkSession, d: str) -> DataFrame:
    net = lambda i: i.groupBy("time_key", "node").agg(F.sum(F.when(F.col("dir") == "in", F.col("cents")).otherwise(-F.col("cents"))).alias("net"))
    i = eg.incidence(edges(spark, d))
    return pf.sign_agreement(net(i), net(i.filter("node <> cp and cents >= 10000")), ["time_key", "node"], "net")


@query("k47_persistence", T + ", f AS (SELECT node, t, sum(CASE WHEN dir = 'in' THEN cents ELSE -cents END) > 0 AS pos FROM it GROUP BY ALL) SELECT node, count(*) FILTER (pos) AS n_true, count(*) AS n_periods FROM f WHERE t > (SELECT max(t) FROM mm) - 6 GROUP BY node HAVING count(*) FILTER (pos) >= 4")
def k47p(spark: SparkSession, d: str) -> DataFrame:
    f = eg.incidence(tm.with_t(edges(spark, d))).groupBy("node", "t").agg((F.sum(F.when(F.col("dir") == "in", F.col("cents")).otherwise(-F.col("cents"))) > 0).alias("pos"))
    return pf.persistence(f, ["node"], F.col("pos"), 4, 6)


@query("k28_locality_transitions", SPREAD_ROWS + ", mm AS (SELECT time_key, dense_rank() OVER (ORDER BY time_key) AS t FROM (SELECT DISTINCT time_key FROM spread)), l AS (SELECT node, t, locality AS from_class, CASE WHEN lead(t) OVER w = t + 1 THEN lead(locality) OVER w END AS to_class FROM spread JOIN mm USING (time_key) WINDOW w AS (PARTITION BY node ORDER BY t)) SELECT from_class, to_class, count(*) AS n FROM l WHERE from_class IS NOT NULL AND to_class IS NOT NULL GROUP BY ALL")
def k28(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive months' locality classes; the classes come from g02_g09, which has an SQL form."""
    return pf.locality_transitions(tm.with_t(gb.spread(edges(spark, d), points(spark, d))), "node")


@query(
    "k28_common_mode",
    T + ", s AS (SELECT node, t, CAST(sum(cents) AS DOUBLE) AS x FROM it GROUP BY ALL), m AS (SELECT t, quantile_cont(x, 0.5) AS m FROM s GROUP BY t), a AS (SELECT node, x - m AS y FROM s JOIN m USING (t)), c AS (SELECT node, quantile_cont(y, 0.5) AS c FROM a GROUP BY node) SELECT node, count(*) AS n, round(max(c), 4) AS median, round(quantile_cont(abs(y - c), 0.5), 4) AS mad FROM a JOIN c USING (node) GROUP BY node",
)
def k28c(spark: SparkSession, d: str) -> DataFrame:
    s = eg.incidence(tm.with_t(edges(spark, d))).groupBy("node", "t").agg(F.sum("cents").cast("double").alias("x"))
    return pf.common_mode(s, "node", "x")


@query(
    "k55_link_prediction",
    W + ", dg AS (SELECT src, count(*) AS k FROM ud GROUP BY src), pp AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ud), c AS (SELECT a, b, count(*) AS common, sum(CASE WHEN k > 1 THEN 1 / ln(k) ELSE 0 END) AS aa FROM pp JOIN ud x ON x.src = a JOIN ud y ON y.src = b AND y.dst = x.dst JOIN dg ON dg.src = x.dst GROUP BY a, b) SELECT pp.a, pp.b, coalesce(common, 0) AS common, " + rsql("coalesce(common, 0)", "p.k + q.k - coalesce(common, 0)") + " AS jaccard, round(coalesce(aa, 0), 6) AS adamic_adar FROM pp LEFT JOIN c ON c.a = pp.a AND c.b = pp.b JOIN dg p ON p.src = pp.a JOIN dg q ON q.src = pp.b",
)
def k55(spark: SparkSession, d: str) -> DataFrame:
    u = cut(it.undirected(it.window_links(edges(spark, d))), "undirected")
    return pf.neighbours_jaccard(u, u.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")))


# ---- relational operators on the order tables


@query("a01_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, min(l_quantity) AS least, max(l_quantity) AS most, round(quantile_cont(l_quantity, 0.5), 4) AS median FROM lineitem GROUP BY ALL")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.percentile("l_quantity", F.lit(0.5)), 4).alias("median"))


@query("a02_a03_conditional", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers, count(*) FILTER (o_orderstatus = 'F') AS n_done, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'O'), 0) AS BIGINT) AS open_cents FROM orders GROUP BY 1")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_customers"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.sum(F.when(F.col("o_orderstatus") == "O", F.round(F.col("o_totalprice") * 100).cast("bigint")).otherwise(0)).alias("open_cents"))


@query("a04_percentiles", "SELECT o_orderpriority, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) AS p{round(p * 1000)}" for p in (0.1, 0.5, 0.9, 0.99)) + " FROM orders GROUP BY 1")
def a04(spark: SparkSession, d: str) -> DataFrame:
    probs = {f"p{round(p * 1000)}": p for p in (0.1, 0.5, 0.9, 0.99)}
    q = group_quantiles(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", probs)
    return q.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in probs])


@query("a05_a26_approximate")
def a05(spark: SparkSession, d: str) -> DataFrame:
    """Approximate percentile and distinct count, which differ from engine to engine."""
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.percentile_approx("o_totalprice", 0.5, 10000).alias("p50"), F.approx_count_distinct("o_custkey").alias("n_customers"))


@query("a06_weighted_percentile", "WITH s AS (SELECT l_returnflag AS g, l_extendedprice AS x, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(sum(l_quantity) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS sh FROM lineitem) SELECT g, min(x) FILTER (sh >= 0.5) AS p50, min(x) FILTER (sh >= 0.9) AS p90 FROM s GROUP BY g")
def a06(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"))
    # The sums by value come first, so a window holds a group's different values, not its rows.
    v = li.groupBy("g", "x").agg(F.sum("w").alias("w"))
    _, a = gb.weighted_percentile(F.col("x"), F.col("w"), 0.5, "g")
    _, b = gb.weighted_percentile(F.col("x"), F.col("w"), 0.9, "g")
    return v.select("g", a.alias("a"), b.alias("b")).groupBy("g").agg(F.min("a").alias("p50"), F.min("b").alias("p90"))


@query("a07_weighted_mean", "SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted_discount, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("weighted_discount"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("a08_mode", "WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, arg_min(l_quantity, (-n, l_quantity)) AS mode, max(n) AS n FROM c GROUP BY 1")
def a08(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("l_returnflag").agg(F.min_by("l_quantity", F.struct(-F.col("n"), F.col("l_quantity"))).alias("mode"), F.max("n").alias("n"))


@query("a09_arg_max", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best_order, max(o_totalprice) AS best FROM orders GROUP BY 1")
def a09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best_order"), F.max("o_totalprice").alias("best"))


@query("a10_top_k", "SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS top3_cents FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3) GROUP BY 1")
def a10(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).filter("k <= 3").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("top3_cents"))


@query("a12_entropy", "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_custkey, n / CAST(sum(n) OVER (PARTITION BY o_custkey) AS DOUBLE) AS p FROM c) SELECT o_custkey, round(-sum(p * log2(p)), 6) AS bits, round(sum(p * p), 6) AS hhi FROM p GROUP BY 1")
def a12(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    p = c.select("o_custkey", (F.col("n") / F.sum("n").over(Window.partitionBy("o_custkey"))).alias("p"))
    return p.groupBy("o_custkey").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("bits"), F.round(F.sum(F.col("p") * F.col("p")), 6).alias("hhi"))


@query("a17_moments", "SELECT l_returnflag, round(skewness(l_extendedprice), 4) AS skew, round(stddev_pop(l_extendedprice), 4) AS sd FROM lineitem GROUP BY 1")
def a17(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.skewness("l_extendedprice") * F.sqrt((n * (n - 1)).cast("double")) / (n - 2), 4).alias("skew"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("sd"))


@query("a18_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("a19_share", "SELECT c_nationkey, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE), 6) AS share FROM customer GROUP BY 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / c.agg(F.count(F.lit(1))).scalar(), 6))


@query("a23_a24_histogram", "WITH h AS (SELECT CAST(floor(log10(o_totalprice) * 4) AS BIGINT) AS bin, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1) SELECT bin, n, round(sum(n) OVER (ORDER BY bin DESC) / CAST((SELECT sum(n) FROM h) AS DOUBLE), 6) AS survival FROM h")
def a23(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "orders").filter("o_totalprice > 0").groupBy(F.floor(F.log10("o_totalprice") * 4).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin"))  # a few dozen bins
    return h.select("bin", "n", F.round(F.sum("n").over(w) / h.agg(F.sum("n")).scalar(), 6).alias("survival"))


@query("a27_rollup", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def a27(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("a28_bootstrap")
def a28(spark: SparkSession, d: str) -> DataFrame:
    """Mean order value by priority with a 95 % interval from 200 Poisson-weighted replicates, drawn from a hash so that they repeat."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_totalprice", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("rep"), "o_orderkey")
    u = F.pmod(F.xxhash64("o_orderkey", "rep"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in (0.367879, 0.735759, 0.919699, 0.981012, 0.99634)), F.lit(0))
    m = o.withColumn("w", weight).groupBy("o_orderpriority", "rep").agg((F.sum(F.col("w") * F.col("o_totalprice")) / F.sum("w")).alias("m"))
    return m.groupBy("o_orderpriority").agg(F.round(F.avg("m"), 2).alias("mean"), F.round(F.percentile("m", F.lit(0.025)), 2).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 2).alias("high"))


@query("w01_dedup", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) = 1")
def w01(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).filter("k = 1").select("o_custkey", "o_orderkey")


@query(
    "w02_w05_frames",
    "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lag(o_totalprice, 3) OVER w AS before_3, max(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak, max(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS peak_3, max(o_totalprice) OVER (w ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS earlier_peak, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lowest, lead(o_totalprice) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
def w02(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", F.lag(p).over(w).alias("before"), F.lag(p, 3).over(w).alias("before_3"), F.max(p).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"), F.max(p).over(w.rowsBetween(-2, 0)).alias("peak_3"),
        F.max(p).over(w.rowsBetween(-8, -3)).alias("earlier_peak"), F.min(p).over(Window.partitionBy("o_custkey")).alias("lowest"), F.lead(p).over(w).alias("after"),
    )


@query("w07_rank_pct", "WITH r AS (SELECT o_orderkey, (rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY o_orderpriority) AS p FROM orders) SELECT o_orderkey, round(p, 6) AS pct FROM r")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return with_average_rank(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "r", "p").select("o_orderkey", F.round("p", 6).alias("pct"))


@query("w17_hash_order", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders")
def w17(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k"))


@query("t01_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("t03_union_all", "SELECT c_nationkey AS nationkey, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("kind")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("kind")))


@query("t05_intersect", E + "SELECT source AS node FROM e INTERSECT SELECT dest FROM e")
def t05(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return e.select(F.col("source").alias("node")).intersect(e.select(F.col("dest").alias("node")))


@query("t06_except", E + "SELECT source AS node FROM e EXCEPT SELECT dest FROM e")
def t06(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return e.select(F.col("source").alias("node")).exceptAll(e.select(F.col("dest").alias("node"))).distinct().join(e.select(F.col("dest").alias("node")).distinct(), "node", "left_anti")


@query("j03_full_outer", "WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY 1) SELECT coalesce(c.k, s.k) AS nationkey, coalesce(n, 0) AS n_customers, coalesce(m, 0) AS n_suppliers, CASE WHEN c.k IS NULL THEN 'right' WHEN s.k IS NULL THEN 'left' ELSE 'both' END AS side FROM c FULL JOIN s ON c.k = s.k")
def j03(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    j = c.join(s, "k", "full")
    return j.select(F.col("k").alias("nationkey"), F.coalesce("n", F.lit(0)).alias("n_customers"), F.coalesce("m", F.lit(0)).alias("n_suppliers"), F.when(F.col("n").isNull(), "right").when(F.col("m").isNull(), "left").otherwise("both").alias("side"))


@query("j12_blocking", "WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS block FROM part) SELECT block, count(*) AS n_parts, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_candidate_pairs FROM p GROUP BY block")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the blocks and the pairs they would give, counted without making a pair."""
    p = table(spark, d, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("block")).agg(F.count(F.lit(1)).alias("n_parts"))
    return p.withColumn("n_candidate_pairs", (F.col("n_parts") * (F.col("n_parts") - 1) / 2).cast("bigint"))


@query(
    "j13_fallback_key",
    EP + ", n AS (SELECT node, naics4, naics2, sum(cents) AS x FROM inc JOIN party USING (node) GROUP BY ALL), a AS (SELECT naics4, avg(x) AS m FROM n WHERE naics4 IS NOT NULL GROUP BY 1 HAVING count(*) >= 10), b AS (SELECT naics2, avg(x) AS m FROM n WHERE naics2 IS NOT NULL GROUP BY 1) SELECT node, CASE WHEN a.m IS NOT NULL THEN 'naics4' WHEN b.m IS NOT NULL THEN 'naics2' END AS level, round(coalesce(a.m, b.m), 4) AS peer_mean FROM n LEFT JOIN a USING (naics4) LEFT JOIN b USING (naics2)",
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    n = eg.incidence(edges(spark, d)).join(parties(spark, d).select("node", "naics4", "naics2"), "node").groupBy("node", "naics4", "naics2").agg(F.sum("cents").alias("x"))
    a = n.filter("naics4 is not null").groupBy("naics4").agg(F.avg("x").alias("a"), F.count(F.lit(1)).alias("k")).filter("k >= 10").drop("k")
    b = n.filter("naics2 is not null").groupBy("naics2").agg(F.avg("x").alias("b"))
    return n.join(a, "naics4", "left").join(b, "naics2", "left").select("node", F.when(F.col("a").isNotNull(), "naics4").when(F.col("b").isNotNull(), "naics2").alias("level"), F.round(F.coalesce("a", "b"), 4).alias("peer_mean"))


@query("j14_range_join", "WITH b AS (SELECT * FROM (VALUES (0, 1000), (1000, 50000), (50000, 200000), (200000, 1000000)) v(lo, hi)) SELECT lo, hi, count(o_orderkey) AS n FROM b LEFT JOIN orders ON o_totalprice >= lo AND o_totalprice < hi GROUP BY ALL")
def j14(spark: SparkSession, d: str) -> DataFrame:
    """Bands are a fixed short list, so the range join is a broadcast one."""
    b = spark.createDataFrame([(0, 1000), (1000, 50000), (50000, 200000), (200000, 1000000)], "lo int, hi int")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    hit = o.join(F.broadcast(b), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return b.join(hit, ["lo", "hi"], "left").na.fill(0, ["n"])


@query("x01_json_props", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS n_k FROM events GROUP BY 1")
def x01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("n_k"))


@query("x02_sessions", "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, count(DISTINCT k) AS n_sessions, count(*) AS n_events FROM g GROUP BY user_id")
def x02(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1).alias("s"))
    return e.withColumn("k", F.sum("s").over(w)).groupBy("user_id").agg(F.count_distinct("k").alias("n_sessions"), F.count(F.lit(1)).alias("n_events"))


@query("x03_tumbling_windows", "SELECT event_type, CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL")
def x03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n")


@query("k58_older_typing", f"WITH x AS (SELECT {sql_id('node')} AS node, arg_min(nullif(trim(naics_cd), ''), rec_id) AS c, arg_min(nullif(trim(party_type), ''), rec_id) AS p FROM customers GROUP BY 1) SELECT node, CASE WHEN {status_sql('c')} = 'valid' THEN 'business' WHEN p = 'P' THEN 'individual' WHEN p = 'O' THEN 'business' ELSE 'unknown' END AS kind FROM x WHERE node IS NOT NULL")
def k58(spark: SparkSession, d: str) -> DataFrame:
    """The older precedence: the first row of a node counts, and a valid sector outranks the party type."""
    c = table(spark, d, "customers").select(canonical_id("node").alias("node"), "rec_id", pt.text_or_null("naics_cd").alias("c"), pt.text_or_null("party_type").alias("p")).filter("node is not null")
    first = lambda x: F.min_by(x, F.when(F.col(x).isNotNull(), F.col("rec_id")))
    f = c.groupBy("node").agg(first("c").alias("c"), first("p").alias("p"))
    return f.select("node", F.when(pt.naics_status("c") == "valid", "business").when(F.col("p") == "P", "individual").when(F.col("p") == "O", "business").otherwise("unknown").alias("kind"))


#: The spread on the raw edges and on those of a rung, whose own WITH hides the edge relation behind the rung's.
_RUNGS = (
    _LADDER
    + ", raw AS (SELECT * FROM e), rung AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM ladder l WHERE l.version = 'P99_9' AND (l.node = e.source OR l.node = e.dest))), "
    + ", ".join(f"{name} AS (WITH e2 AS (SELECT * FROM {rel}), " + SPREAD_ROWS[SPREAD_ROWS.index("craw AS") :].replace("party AS (", "party AS (", 1) + " SELECT time_key, node, locality FROM spread)" for name, rel in (("x", "raw"), ("y", "rung")))
    + " SELECT x.locality AS x, y.locality AS y, count(*) AS n FROM x JOIN y USING (time_key, node) WHERE x.locality IS NOT NULL AND y.locality IS NOT NULL GROUP BY ALL"
).replace("FROM inc i LEFT JOIN pl a", "FROM (SELECT time_key, source AS node, dest AS cp, 'out' AS dir, cents FROM e2 UNION ALL SELECT time_key, dest, source, 'in', cents FROM e2) i LEFT JOIN pl a")


@query("k33_rung_agreement", _RUNGS)
def k33(spark: SparkSession, d: str) -> DataFrame:
    """Locality classes of the same nodes and months with and without hubs: how often two rungs of the ladder agree."""
    e, p = edges_once(spark, d), points(spark, d)
    ladder = eg.build_ladder(e, TIERS)[0]
    a, b = gb.spread(e, p).select("time_key", "node", F.col("locality").alias("x")), gb.spread(eg.apply_version(e, ladder, "P99_9"), p).select("time_key", "node", F.col("locality").alias("y"))
    return a.join(b, ["time_key", "node"]).filter("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("s13_directed_scan", EP + ", f AS (SELECT node FROM party WHERE naics2 = '52') SELECT direction, time_key, count(*) AS n, count(DISTINCT focal) AS n_focal, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT source AS focal, 'out' AS direction, time_key, cents FROM e WHERE source IN (SELECT node FROM f) UNION ALL SELECT dest, 'in', time_key, cents FROM e WHERE dest IN (SELECT node FROM f)) GROUP BY ALL")
def s13(spark: SparkSession, d: str) -> DataFrame:
    s = rd.directed_scan(edges_once(spark, d), parties(spark, d).filter("naics2 = '52'"))
    return s.groupBy("direction", "time_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("focal").alias("n_focal"), F.sum("cents").alias("cents"))


@query("p12_decimal_places", "WITH x AS (SELECT CAST(CAST(lat AS DECIMAL(12, 6)) AS VARCHAR) AS a, CAST(CAST(lon AS DECIMAL(12, 6)) AS VARCHAR) AS b FROM customers WHERE isfinite(lat) AND isfinite(lon)) SELECT CAST(least(length(rtrim(split_part(a, '.', 2), '0')), length(rtrim(split_part(b, '.', 2), '0'))) AS INTEGER) AS places, count(*) AS n FROM x GROUP BY 1")
def p12(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the decimal places of their coarser coordinate, trailing zeros aside: a few stand for a rounded or placeholder point."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    text = lambda c: F.rtrim(F.col(c).cast("decimal(12,6)").cast("string"), F.lit("0"))
    c = table(spark, d, "customers").filter(ok("lat") & ok("lon"))
    return c.groupBy(F.least(pt.decimal_places(text("lat")), pt.decimal_places(text("lon"))).alias("places")).agg(F.count(F.lit(1)).alias("n"))


@query("k49_party_payment_months", EP + "SELECT time_key, coalesce(a.entity, 'none') AS payer, coalesce(b.entity, 'none') AS payee, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e LEFT JOIN party a ON a.node = source LEFT JOIN party b ON b.node = dest GROUP BY ALL")
def k49(spark: SparkSession, d: str) -> DataFrame:
    p = parties(spark, d).select("node", "entity")
    e = edges(spark, d).join(p.select(F.col("node").alias("source"), F.col("entity").alias("x")), "source", "left").join(p.select(F.col("node").alias("dest"), F.col("entity").alias("y")), "dest", "left")
    return e.groupBy("time_key", F.coalesce("x", F.lit("none")).alias("payer"), F.coalesce("y", F.lit("none")).alias("payee")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("k08_coverage_by_month", EP + f", n AS (SELECT DISTINCT time_key, node FROM inc) SELECT time_key, count(*) AS n_nodes, {rsql('count(p.node)', 'count(*)')} AS in_parties FROM n LEFT JOIN party p USING (node) GROUP BY time_key")
def k08(spark: SparkSession, d: str) -> DataFrame:
    n = eg.incidence(edges(spark, d)).select("time_key", "node").distinct().join(parties(spark, d).select("node", F.lit(1).alias("hit")), "node", "left")
    return n.groupBy("time_key").agg(F.count(F.lit(1)).alias("n_nodes"), eg.ratio(F.count("hit"), F.count(F.lit(1))).alias("in_parties"))


@query("k07_grain", f"SELECT count(*) AS n_rows, count(DISTINCT ({sql_day('time_key')}, {sql_id('node')})) AS n_keys FROM node_metrics_daily")
def k07(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "node_metrics_daily").groupBy(day_date("time_key").alias("day"), canonical_id("node").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
