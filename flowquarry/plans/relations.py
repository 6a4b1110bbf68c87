"""Queries on pairs, name matching and rails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.ranks import group_quantiles
from flowquarry.operators import edges as eg
from flowquarry.operators import match as mt
from flowquarry.operators import pairs as pr
from flowquarry.operators import rails as rl
from flowquarry.plans.base import E, EP, WP, edges, parties, rsql, sectors
from flowquarry.plans.registry import query
from flowquarry.session import table

SEED_PREFIXES = ["48", "33"]
SEED_NAMES = r"FREIGHT|LOGISTICS|STAFFING"
SEED_NOT = r"STAFFING"


def seeds(spark: SparkSession, d: str) -> DataFrame:
    return pr.select_seeds(parties(spark, d), SEED_PREFIXES, SEED_NAMES, SEED_NOT)


_SEED = f""", sx AS (SELECT node, naics_status = 'valid' AND (starts_with(naics_cd, '48') OR starts_with(naics_cd, '33')) AS c, regexp_matches(upper(coalesce(cust_name, '')), '{SEED_NAMES}') AND (NOT regexp_matches(upper(coalesce(cust_name, '')), '{SEED_NOT}') OR (naics_status = 'valid' AND (starts_with(naics_cd, '48') OR starts_with(naics_cd, '33')))) AS n FROM party),
seed AS (SELECT node, CASE WHEN c AND n THEN 'sector_and_name' WHEN c THEN 'sector' ELSE 'name' END AS seed_reason FROM sx WHERE c OR n) """


@query("p21_seeds", WP + _SEED + "SELECT * FROM seed")
def p21(spark: SparkSession, d: str) -> DataFrame:
    return seeds(spark, d)


RULES = {"freight": (r"FREIGHT|LOGISTICS|CARTAGE", "48"), "building": (r"ROOFING|PLUMBING|MASONRY", "23")}


@query(
    "p22_entity_class",
    WP + """, c AS (SELECT node, upper(coalesce(cust_name, '')) AS n, coalesce(naics_cd, '') AS c FROM party) SELECT node, CASE WHEN regexp_matches(n, 'FREIGHT|LOGISTICS|CARTAGE') AND NOT starts_with(c, '23') THEN 'freight' WHEN regexp_matches(n, 'ROOFING|PLUMBING|MASONRY') AND NOT starts_with(c, '48') THEN 'building' WHEN starts_with(c, '48') THEN 'freight' WHEN starts_with(c, '23') THEN 'building' ELSE 'other' END AS class FROM c""",
)
def p22(spark: SparkSession, d: str) -> DataFrame:
    return parties(spark, d).select("node", pr.entity_class(F.col("cust_name"), F.col("naics_cd"), RULES).alias("class"))


@query("j11_ego", EP + _SEED + "SELECT e.* FROM e WHERE source IN (SELECT node FROM seed) AND dest IN (SELECT node FROM seed)")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return pr.ego(edges(spark, d), seeds(spark, d))


@query("k21_ego_panel", EP + _SEED + "SELECT time_key, count(*) AS n_edges, CAST(sum(cents) AS BIGINT) AS cents FROM e WHERE source IN (SELECT node FROM seed) AND dest IN (SELECT node FROM seed) GROUP BY time_key")
def k21(spark: SparkSession, d: str) -> DataFrame:
    return pr.ego(edges(spark, d), seeds(spark, d)).groupBy("time_key").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("cents").alias("cents"))


_BI = (
    E
    + f""", mo AS (SELECT least(source, dest) AS a, greatest(source, dest) AS b, time_key, CAST(coalesce(sum(cents) FILTER (source < dest), 0) AS BIGINT) AS ab, CAST(coalesce(sum(cents) FILTER (source > dest), 0) AS BIGINT) AS ba, count(DISTINCT source < dest) AS ways, bool_or(source < dest) AS forth, bool_or(source > dest) AS back, CAST(sum(volume) AS BIGINT) AS volume FROM e WHERE source <> dest GROUP BY ALL),
bp AS (SELECT a, b, CAST(sum(ab) AS BIGINT) AS ab, CAST(sum(ba) AS BIGINT) AS ba, count(*) AS n_months, count(*) FILTER (ways = 2) AS n_both, CAST(sum(volume) AS BIGINT) AS volume, round(coalesce(stddev_samp((ab + ba) / CAST(100 AS DOUBLE)), 0) / CASE WHEN avg((ab + ba) / CAST(100 AS DOUBLE)) > 0 THEN avg((ab + ba) / CAST(100 AS DOUBLE)) END, 6) AS cv, count(*) FILTER (forth) AS months_ab, count(*) FILTER (back) AS months_ba, {", ".join(f"round(stddev_samp(CASE WHEN {w} THEN {c} / CAST(100 AS DOUBLE) END) / CASE WHEN avg(CASE WHEN {w} THEN {c} / CAST(100 AS DOUBLE) END) > 0 THEN avg(CASE WHEN {w} THEN {c} / CAST(100 AS DOUBLE) END) END, 6) AS cv_{c}" for c, w in (("ab", "forth"), ("ba", "back")))} FROM mo GROUP BY a, b),
bi AS (SELECT a, b, ab, ba, ab + ba AS gross, ab - ba AS net, {rsql("least(ab, ba)", "greatest(ab, ba)")} AS reciprocity, {rsql("2 * least(ab, ba)", "ab + ba")} AS netting_ratio, n_months, n_both, volume, {rsql("(ab + ba) / CAST(100 AS DOUBLE)", "volume")} AS ticket, cv, months_ab, months_ba, cv_ab, cv_ba FROM bp) """
)


@query("k17_bilateral", _BI + "SELECT * FROM bi")
def k17(spark: SparkSession, d: str) -> DataFrame:
    return pr.bilateral(edges(spark, d))


_SC = _BI + """, sc AS (SELECT *, round((0.30 * least(greatest(months_ab, months_ba) / CAST(11 AS DOUBLE), 1) + 0.30 * coalesce(reciprocity, 0) + 0.10 / (1 + coalesce((cv_ab + cv_ba) / 2, cv_ab, cv_ba, 1))
 + 0.20 * coalesce(exp(-power((log10(CASE WHEN ticket > 0 THEN ticket END) - 4) / 1, 2)), 0) + 0.10 * least(log10(greatest(volume, 1)) / 3, 1)) * CASE WHEN ab > 0 AND ba > 0 THEN 1 ELSE 0.5 END, 6) AS score FROM bi) """


@query("k18_pair_score", _SC + "SELECT a, b, score FROM sc")
def k18(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("a", "b", "score")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return pr.score_pairs(pr.bilateral(edges(spark, d)), 11)


def _steps() -> dict:
    return {"reciprocal": (F.col("ab") > 0) & (F.col("ba") > 0), "persistent": F.col("n_months") >= 3, "balanced": F.col("reciprocity") >= 0.3, "small_ticket": F.col("ticket") < 5000}


@query(
    "k22_gates",
    _BI + """, g AS (SELECT ab > 0 AND ba > 0 AS g1, n_months >= 3 AS g2, coalesce(reciprocity >= 0.3, false) AS g3, coalesce(ticket < 5000, false) AS g4 FROM bi), n AS (SELECT count(*) AS n0, count(*) FILTER (g1) AS n1, count(*) FILTER (g1 AND g2) AS n2, count(*) FILTER (g1 AND g2 AND g3) AS n3, count(*) FILTER (g1 AND g2 AND g3 AND g4) AS n4 FROM g)
SELECT 1 AS position, 'reciprocal' AS stage, n1 AS n_kept, n0 - n1 AS n_dropped FROM n UNION ALL SELECT 2, 'persistent', n2, n1 - n2 FROM n UNION ALL SELECT 3, 'balanced', n3, n2 - n3 FROM n UNION ALL SELECT 4, 'small_ticket', n4, n3 - n4 FROM n""",
)
def k22(spark: SparkSession, d: str) -> DataFrame:
    return pr.gates(pr.bilateral(edges(spark, d)), 11, _steps())[1]


@query(
    "k23_tiers",
    _BI.rstrip() + ", " + WP[len("WITH ") :] + """, cl AS (SELECT node, CASE WHEN entity = 'business' THEN 'business' ELSE 'other' END AS c FROM party), tt AS (SELECT bi.*, coalesce(x.c, 'other') AS ca, coalesce(y.c, 'other') AS cb FROM bi LEFT JOIN cl x ON x.node = a LEFT JOIN cl y ON y.node = b)
SELECT CASE WHEN ca <> 'other' AND cb <> 'other' THEN CASE WHEN ab > 0 AND ba > 0 AND n_both >= 3 THEN 'A' WHEN ab > 0 AND ba > 0 THEN 'B' ELSE 'C' END WHEN ca <> 'other' OR cb <> 'other' THEN 'X' ELSE 'D' END AS tier, count(*) AS n, CAST(sum(gross) AS BIGINT) AS gross FROM tt GROUP BY 1""",
)
def k23(spark: SparkSession, d: str) -> DataFrame:
    cls = parties(spark, d).select("node", F.when(F.col("entity") == "business", "business").otherwise("other").alias("c"))
    b = pr.bilateral(edges(spark, d))
    for side in ("a", "b"):
        b = b.join(cls.select(F.col("node").alias(side), F.col("c").alias(f"class_{side}")), side, "left").withColumn(f"class_{side}", F.coalesce(f"class_{side}", F.lit("other")))
    return b.groupBy(pr.tier(b).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum("gross").alias("gross"))


@query("k20_shared_counterparties", EP + _SEED + "SELECT cp, count(DISTINCT node) AS n_seeds, CAST(sum(cents) AS BIGINT) AS cents FROM inc WHERE node IN (SELECT node FROM seed) AND node <> cp GROUP BY cp HAVING count(DISTINCT node) >= 2")
def k20(spark: SparkSession, d: str) -> DataFrame:
    return pr.shared_counterparties(edges(spark, d), seeds(spark, d))


@query(
    "k20_intermediaries",
    EP + _SEED + f", n AS (SELECT node, count(DISTINCT cp) FILTER (dir = 'in') AS n_payers, count(DISTINCT cp) FILTER (dir = 'out') AS n_payees, CAST(coalesce(sum(cents) FILTER (dir = 'in'), 0) AS BIGINT) AS in_cents, CAST(coalesce(sum(cents) FILTER (dir = 'out'), 0) AS BIGINT) AS out_cents FROM inc WHERE cp IN (SELECT node FROM seed) AND node <> cp GROUP BY node), b AS (SELECT *, {rsql('least(in_cents, out_cents)', 'greatest(in_cents, out_cents)')} AS balance FROM n) SELECT * FROM b WHERE n_payers >= 2 AND n_payees >= 2 AND balance >= 0.3",
)
def k20i(spark: SparkSession, d: str) -> DataFrame:
    return pr.intermediaries(edges(spark, d), seeds(spark, d))


@query("k20_sector_profile", EP + _SEED + f", g AS (SELECT dir, coalesce(p.naics2, 'NA') AS sector, count(DISTINCT cp) AS n_cp, CAST(sum(cents) AS BIGINT) AS cents FROM inc LEFT JOIN party p ON p.node = inc.cp WHERE inc.node IN (SELECT node FROM seed) AND inc.node <> cp GROUP BY ALL) SELECT *, {rsql('cents', 'sum(cents) OVER (PARTITION BY dir)')} AS share FROM g")
def k20s(spark: SparkSession, d: str) -> DataFrame:
    return pr.sector_profile(edges(spark, d), seeds(spark, d), sectors(spark, d))


_CORE, _ADJACENT, _SEED_NAME = ["524126", "524130"], ["524291", "524292"], "BANK|TRUST|MUTUAL|CREDIT"


@query(
    "p23_seed_roles",
    EP + f""", dg AS (SELECT node, count(DISTINCT cp) AS degree FROM inc WHERE node <> cp GROUP BY node), s AS (SELECT party.node, CASE WHEN substr(naics_cd, 1, 6) IN ('524126', '524130') THEN 'core_insurer' WHEN substr(naics_cd, 1, 6) IN ('524291', '524292') THEN 'claims_adjacent' WHEN regexp_matches(upper(coalesce(cust_name, '')), '{_SEED_NAME}') THEN 'name_match_only' END AS seed_role, coalesce(degree, 0) AS degree FROM party LEFT JOIN dg ON dg.node = party.node)
SELECT *, degree <= 50 AS expands FROM s WHERE seed_role IS NOT NULL""",
)
def p23(spark: SparkSession, d: str) -> DataFrame:
    degree = eg.incidence(eg.no_self(edges(spark, d))).groupBy("node").agg(F.count_distinct("cp").alias("degree"))
    return pr.seed_roles(parties(spark, d), degree, _CORE, _ADJACENT, _SEED_NAME, 50)


@query("s22_export_vertices", EP + ", s AS (SELECT source, dest, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY ALL), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY cents DESC, dest) <= 3) SELECT n.node, party.cust_name, party.state FROM (SELECT source AS node FROM k UNION SELECT dest FROM k) n LEFT JOIN party ON party.node = n.node")
def s22(spark: SparkSession, d: str) -> DataFrame:
    return pr.export_graph(edges(spark, d), 3, parties(spark, d).select("node", "cust_name", "state"))[0]


@query("t10_capped_edges", E + ", s AS (SELECT source, dest, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY ALL) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY cents DESC, dest) <= 10")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return pr.capped_edges(edges(spark, d), 10)


# ---- names

_TAIL = "|".join(sorted(mt.SUFFIXES, key=len, reverse=True))


def _base(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(replace(lower({c}), '.', ''), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def named(spark: SparkSession, d: str) -> DataFrame:
    """Edges over the window with the names of both ends."""
    n = parties(spark, d).select("node", "cust_name")
    e = edges(spark, d).filter("source <> dest")
    return e.join(n.select(F.col("node").alias("source"), F.col("cust_name").alias("payer")), "source").join(n.select(F.col("node").alias("dest"), F.col("cust_name").alias("payee")), "dest")


@query(
    "p27_normal_names",
    WP + f", b AS (SELECT node, {_base('cust_name')} AS t FROM party) SELECT node, nullif(regexp_replace(t, ' ({_TAIL})$', ''), '') AS name, nullif(regexp_extract(t, ' ({_TAIL})$', 1), '') AS suffix FROM b",
)
def p27(spark: SparkSession, d: str) -> DataFrame:
    return parties(spark, d).select("node", mt.normal_name(F.col("cust_name")).alias("name"), mt.name_suffix(F.col("cust_name")).alias("suffix"))


@query(
    "k48_name_matches",
    EP
    + f""", p AS (SELECT x.cust_name AS payer_name, y.cust_name AS payee_name, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS cents FROM e JOIN party x ON x.node = source JOIN party y ON y.node = dest WHERE source <> dest AND x.cust_name IS NOT NULL AND y.cust_name IS NOT NULL GROUP BY ALL),
q AS (SELECT *, {_base("payer_name")} AS ta, {_base("payee_name")} AS tb FROM p), r AS (SELECT *, nullif(regexp_replace(ta, ' ({_TAIL})$', ''), '') AS a, nullif(regexp_replace(tb, ' ({_TAIL})$', ''), '') AS b, nullif(regexp_extract(ta, ' ({_TAIL})$', 1), '') AS sa, nullif(regexp_extract(tb, ' ({_TAIL})$', 1), '') AS sb FROM q),
s AS (SELECT *, CASE WHEN a = b THEN 1 ELSE round(jaro_winkler_similarity(a, b), 6) END AS score FROM r WHERE length(a) > 2 AND length(b) > 2 AND (a = b OR split_part(a, ' ', 1) = split_part(b, ' ', 1)))
SELECT payer_name, payee_name, n_rows, cents, CASE WHEN a = b AND sa IS NOT DISTINCT FROM sb THEN 'TIER1_EXACT' WHEN a = b THEN 'TIER1B_SUFFIX_VARIANT' ELSE 'TIER2_FUZZY' END AS tier, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 1 THEN 'exact' WHEN score >= 0.97 THEN 'very_high' WHEN score >= 0.95 THEN 'high' ELSE 'medium' END AS band, cents > 100000000 AS above_cap FROM s WHERE a = b OR score >= 0.85""",
)
def k48(spark: SparkSession, d: str) -> DataFrame:
    return mt.name_matches(named(spark, d), "payer", "payee", "cents", fuzzy=0.85)


@query(
    "k19_affiliates",
    EP + f""", p AS (SELECT DISTINCT source, dest, {_base("x.cust_name")} AS ta, {_base("y.cust_name")} AS tb FROM e JOIN party x ON x.node = source JOIN party y ON y.node = dest WHERE source <> dest AND x.cust_name IS NOT NULL AND y.cust_name IS NOT NULL),
r AS (SELECT source, dest, nullif(regexp_replace(ta, ' ({_TAIL})$', ''), '') AS a, nullif(regexp_replace(tb, ' ({_TAIL})$', ''), '') AS b FROM p) SELECT source, dest, coalesce(round(jaro_winkler_similarity(a, b), 6) >= 0.85 OR split_part(a, ' ', 1) = split_part(b, ' ', 1), false) AS is_affiliate FROM r""",
)
def k19(spark: SparkSession, d: str) -> DataFrame:
    from flowquarry.functions.similarity import jaro_winkler

    p = named(spark, d).filter("payer is not null and payee is not null").select("source", "dest", "payer", "payee").distinct().select("source", "dest", mt.normal_name(F.col("payer")).alias("a"), mt.normal_name(F.col("payee")).alias("b"))
    return p.select("source", "dest", F.coalesce((F.round(jaro_winkler("a", "b"), 6) >= 0.85) | (mt.first_token(F.col("a")) == mt.first_token(F.col("b"))), F.lit(False)).alias("is_affiliate"))


# ---- rails, on orders as payments of customers to suppliers

RAILS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_EXACT = "(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) // 100)"
_RF = f"WITH fl AS (SELECT 'C' || o_custkey AS focal, 'S' || l_suppkey AS other, CASE WHEN l_linenumber % 2 = 0 THEN 'in' ELSE 'out' END AS dir, substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS time_key, o_orderpriority AS rail, {_EXACT} AS cents, 1 AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey) "


def rail_flows(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    net = F.floor(F.round(F.col("l_extendedprice") * 100).cast("bigint") * (F.lit(100) - F.round(F.col("l_discount") * 100).cast("bigint")) / 100)
    return o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("C"), "o_custkey").alias("focal"), F.concat(F.lit("S"), "l_suppkey").alias("other"), F.when(F.col("l_linenumber") % 2 == 0, "in").otherwise("out").alias("dir"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("time_key"), F.col("o_orderpriority").alias("rail"), net.alias("cents"), F.lit(1).alias("n"),
    )


@query("k50_rail_mix", _RF + "SELECT time_key, " + ", ".join(rsql(f"coalesce(sum(cents) FILTER (rail = '{r}'), 0)", "sum(cents)") + f' AS "share_{r}"' for r in RAILS) + " FROM fl GROUP BY time_key")
def k50(spark: SparkSession, d: str) -> DataFrame:
    return rl.rail_mix(rail_flows(spark, d), RAILS)


@query("p28_payable", _RF + f", p AS (SELECT 'Customer ' || focal AS payer, 'Partner ' || other AS payee, rail, cents FROM fl WHERE dir = 'out') SELECT rail, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM p WHERE ((rail = '{RAILS[0]}' AND cents >= 5000000) OR (rail = '{RAILS[1]}' AND cents >= 1000000)) AND payer <> 'Customer 1' AND payee NOT IN ('Partner 2', 'Partner 3') GROUP BY rail")
def p28(spark: SparkSession, d: str) -> DataFrame:
    """What is left to compare by name, by rail."""
    p = rail_flows(spark, d).filter("dir = 'out'").select(F.concat(F.lit("Customer "), "focal").alias("payer"), F.concat(F.lit("Partner "), "other").alias("payee"), "rail", "cents")
    kept = mt.payable(p, "payer", "payee", "rail", "cents", {RAILS[0]: 5_000_000, RAILS[1]: 1_000_000}, ("Customer 1",), ("Partner 2", "Partner 3"))
    return kept.groupBy("rail").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("k50_top_partners", _RF + ", s AS (SELECT focal, other, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(n) AS BIGINT) AS n FROM fl GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY focal ORDER BY cents DESC, other) AS INTEGER) AS k FROM s QUALIFY k <= 5")
def k50t(spark: SparkSession, d: str) -> DataFrame:
    return rl.top_partners(rail_flows(spark, d))


@query(
    "k51_rail_behaviour",
    _RF + """, s AS (SELECT focal, rail, sum(cents) AS c FROM fl GROUP BY ALL), p AS (SELECT *, c / CAST(sum(c) OVER (PARTITION BY focal) AS DOUBLE) AS p FROM s), d AS (SELECT focal, round(sum(p * p), 6) AS rail_hhi, arg_min(rail, (-c, rail)) AS dominant_rail, round(max(p), 6) AS dominant_share FROM p GROUP BY focal), m AS (SELECT focal, count(DISTINCT time_key) AS active_months FROM fl GROUP BY focal)
SELECT *, round((rank() OVER (PARTITION BY dominant_rail ORDER BY dominant_share) - 1) / CAST(count(*) OVER (PARTITION BY dominant_rail) AS DOUBLE), 6) AS peer_pct FROM d JOIN m USING (focal)""",
)
def k51(spark: SparkSession, d: str) -> DataFrame:
    return rl.rail_behaviour(rail_flows(spark, d))


@query(
    "k51_rail_shifts",
    _RF + """, m AS (SELECT focal, rail, time_key, sum(cents) / CAST(100 AS DOUBLE) AS x FROM fl GROUP BY ALL), w AS (SELECT *, min(time_key) OVER (PARTITION BY focal) AS a, max(time_key) OVER (PARTITION BY focal) AS b, avg(x) OVER (PARTITION BY focal, rail) AS mu, stddev_samp(x) OVER (PARTITION BY focal, rail) AS sd, count(*) OVER (PARTITION BY focal, rail) AS k FROM m)
SELECT focal, rail, min(time_key) AS first_month, max(time_key) AS last_month, min(time_key) > min(a) AS is_debut, max(time_key) < max(b) AS is_exit, round(max(CASE WHEN sd > 1e-9 AND k >= 3 THEN abs(x - mu) / sd END), 4) AS peak_z FROM w GROUP BY focal, rail""",
)
def k51s(spark: SparkSession, d: str) -> DataFrame:
    return rl.rail_shifts(rail_flows(spark, d))


def _cos(a: str, b: str) -> str:
    dot = " + ".join(f"{a}{i} * {b}{i}" for i in range(5))
    na, nb = (" + ".join(f"{x}{i} * {x}{i}" for i in range(5)) for x in (a, b))
    return f"round(CASE WHEN {na} > 0 AND {nb} > 0 THEN 1 - ({dot}) / sqrt({na}) / sqrt({nb}) END, 6)"


def _sums(prefix: str, cond: str) -> str:
    return ", ".join(f"CAST(coalesce(sum(cents) FILTER (rail = '{r}' AND {cond}), 0) AS DOUBLE) AS {prefix}{i}" for i, r in enumerate(RAILS))


@query(
    "k52_rail_drift",
    _RF + f", m AS (SELECT focal, rail, cents, time_key = min(time_key) OVER (PARTITION BY focal) AS f, time_key = max(time_key) OVER (PARTITION BY focal) AS l FROM fl), p AS (SELECT focal, {_sums('f', 'f')}, {_sums('l', 'l')}, {_sums('t', 'true')} FROM m GROUP BY focal), w AS (SELECT {_sums('w', 'true')} FROM fl) SELECT focal, {_cos('f', 'l')} AS first_last_distance, {_cos('t', 'w')} AS population_distance FROM p, w",
)
def k52(spark: SparkSession, d: str) -> DataFrame:
    return rl.rail_drift(rail_flows(spark, d), RAILS)


@query("k52_partner_overlap", _RF + f", p AS (SELECT focal, other, bool_or(dir = 'out') AS o, bool_or(dir = 'in') AS i FROM fl GROUP BY ALL) SELECT focal, count(*) AS n_partners, {rsql('count(*) FILTER (o AND i)', 'count(*)')} AS partner_jaccard FROM p GROUP BY focal")
def k52p(spark: SparkSession, d: str) -> DataFrame:
    return rl.partner_overlap(rail_flows(spark, d))


@query("k53_rail_distribution", _RF + ", s AS (SELECT focal, dir, rail, sum(cents) AS c, count(*) AS k FROM fl GROUP BY ALL) SELECT dir, rail, count(*) AS n_nodes, round(quantile_cont(c, 0.5), 2) AS median_cents, max(k) AS most_rows FROM s GROUP BY dir, rail")
def k53(spark: SparkSession, d: str) -> DataFrame:
    s = rail_flows(spark, d).groupBy("focal", "dir", "rail").agg(F.sum("cents").alias("c"), F.count(F.lit(1)).alias("k"))
    q = group_quantiles(s, ["dir", "rail"], "c", {"m": 0.5})
    return s.groupBy("dir", "rail").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("k").alias("most_rows")).join(q, ["dir", "rail"]).select("dir", "rail", "n_nodes", F.round("m", 2).alias("median_cents"), "most_rows")
