"""Queries across months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.ranks import quantile
from flowquarry.operators import edges as eg
from flowquarry.operators import temporal as tm
from flowquarry.plans.base import E, edges, rsql
from flowquarry.plans.registry import query

T = E + ", mm AS (SELECT time_key, CAST(dense_rank() OVER (ORDER BY time_key) AS INTEGER) AS t FROM (SELECT DISTINCT time_key FROM e)), et AS (SELECT e.*, t FROM e JOIN mm USING (time_key)), it AS (SELECT inc.*, t FROM inc JOIN mm USING (time_key)) "


@query(
    "m01_tenure",
    T + ", s AS (SELECT DISTINCT time_key, node, t FROM it) SELECT time_key, node, t - min(t) OVER w AS months_since_first_seen, CAST(row_number() OVER w AS INTEGER) AS months_active, t - lag(t) OVER w AS activity_gap FROM s WINDOW w AS (PARTITION BY node ORDER BY t)",
)
def m01(spark: SparkSession, d: str) -> DataFrame:
    return tm.tenure(edges(spark, d))


_MEM = T + """, mem AS (SELECT *, CASE WHEN l = t - 1 THEN 'retained' WHEN l >= t - 6 THEN 'returning' ELSE 'new' END AS cohort, n6 >= 4 AS is_persistent FROM (
 SELECT *, lag(t) OVER (PARTITION BY source, dest ORDER BY t) AS l, count(*) OVER (PARTITION BY source, dest ORDER BY t RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n6 FROM et)) """


@query("m02_memory", _MEM + "SELECT time_key, source, dest, cents, volume, t, cohort, is_persistent FROM mem")
def m02(spark: SparkSession, d: str) -> DataFrame:
    return tm.relationship_memory(edges(spark, d))


@query(
    "m03_cohorts",
    _MEM + ", mi AS (SELECT time_key, source AS node, 'out' AS dir, cents, t, cohort, is_persistent FROM mem UNION ALL SELECT time_key, dest, 'in', cents, t, cohort, is_persistent FROM mem) SELECT time_key, node, dir, "
    + ", ".join(f"CASE WHEN max(t) > 1 THEN count(*) FILTER (cohort = '{k}') END AS n_{k}, CASE WHEN max(t) > 1 THEN {rsql(f'''coalesce(sum(cents) FILTER (cohort = '{k}'), 0)''', 'sum(cents)')} END AS {k}_amount_share" for k in ("retained", "returning", "new"))
    + ", CASE WHEN max(t) > 1 THEN count(*) FILTER (is_persistent) END AS n_persistent FROM mi GROUP BY time_key, node, dir",
)
def m03(spark: SparkSession, d: str) -> DataFrame:
    return tm.cohorts(edges(spark, d))


_SH = T + ", sh AS (SELECT coalesce(y.t, x.t + 1) AS t, coalesce(y.source, x.source) AS source, coalesce(y.dest, x.dest) AS dest, y.cents AS now, x.cents AS before FROM et x FULL JOIN et y ON x.source = y.source AND x.dest = y.dest AND y.t = x.t + 1 WHERE coalesce(y.t, x.t + 1) BETWEEN 2 AND (SELECT max(t) FROM mm)) "


@query(
    "m04_side_turnover",
    _SH + f", si AS (SELECT t, source AS node, 'out' AS dir, now, before FROM sh UNION ALL SELECT t, dest, 'in', now, before FROM sh) SELECT t, node, dir, count(*) FILTER (now IS NULL) AS n_lost, {rsql('count(*) FILTER (now IS NOT NULL AND before IS NOT NULL)', 'count(*)')} AS jaccard, CASE WHEN count(*) FILTER (now IS NULL) > 0 THEN {rsql('sum(before) FILTER (now IS NULL)', 'sum(before)')} END AS lost_amount_share FROM si GROUP BY t, node, dir",
)
def m04(spark: SparkSession, d: str) -> DataFrame:
    return tm.side_turnover(edges(spark, d))


@query(
    "m07_graph_turnover",
    _SH
    + f""", nd AS (SELECT t, node, bool_or(now) AS now, bool_or(before) AS before FROM (SELECT t, source AS node, now IS NOT NULL AS now, before IS NOT NULL AS before FROM sh UNION ALL SELECT t, dest, now IS NOT NULL, before IS NOT NULL FROM sh) GROUP BY t, node),
nj AS (SELECT t, {rsql("count(*) FILTER (now AND before)", "count(*)")} AS node_jaccard FROM nd GROUP BY t)
SELECT t, {rsql("count(*) FILTER (now IS NOT NULL AND before IS NOT NULL)", "count(*)")} AS edge_jaccard, {rsql("coalesce(sum(now) FILTER (before IS NOT NULL), 0)", "sum(now)")} AS retained_amount_share, {rsql("coalesce(sum(now) FILTER (before IS NULL), 0)", "sum(now)")} AS new_amount_share, max(node_jaccard) AS node_jaccard FROM sh JOIN nj USING (t) GROUP BY t""",
)
def m07(spark: SparkSession, d: str) -> DataFrame:
    return tm.graph_turnover(edges(spark, d))


@query(
    "m05_top_payers",
    T + """, tp AS (SELECT t, time_key, dest AS node, arg_min(source, (-cents, source)) AS top_payer, round(max(cents) / CAST(nullif(sum(cents), 0) AS DOUBLE), 9) AS s FROM et GROUP BY ALL)
SELECT time_key, node, top_payer, round(s, 6) AS top_share, CASE WHEN lag(t) OVER w = t - 1 THEN top_payer = lag(top_payer) OVER w END AS top_payer_same, CASE WHEN lag(t) OVER w = t - 1 THEN round(s - lag(s) OVER w, 6) END AS top_share_delta FROM tp WINDOW w AS (PARTITION BY node ORDER BY t)""",
)
def m05(spark: SparkSession, d: str) -> DataFrame:
    return tm.top_payers(edges(spark, d))


@query(
    "m06_contagion",
    T
    + f""", s AS (SELECT t, node, sum(cents) AS s FROM it GROUP BY ALL), ch AS (SELECT t, node, CASE WHEN lag(t) OVER w = t - 1 AND lag(s) OVER w > 0 THEN s / CAST(lag(s) OVER w AS DOUBLE) END AS r FROM s WINDOW w AS (PARTITION BY node ORDER BY t))
SELECT time_key, dest AS node, round(CASE WHEN sum(cents) > 0 THEN sum(cents * ln(r)) / sum(cents) END, 6) AS payer_log_change, {rsql("coalesce(sum(cents) FILTER (r < 0.8), 0)", "sum(cents)")} AS shrinking_inflow_share FROM et JOIN ch ON ch.t = et.t AND ch.node = et.source WHERE r > 0 GROUP BY time_key, dest""",
)
def m06(spark: SparkSession, d: str) -> DataFrame:
    return tm.contagion(edges(spark, d))


@query(
    "m08_pair_persistence",
    T + f"SELECT t, {rsql('count(*) FILTER (l = t - 1)', 'count(*)')} AS persisted_share, {rsql('coalesce(sum(cents) FILTER (l IS NULL OR l <> t - 1), 0)', 'count(*) FILTER (l IS NULL OR l <> t - 1)', 4)} AS mean_new_cents FROM (SELECT t, cents, lag(t) OVER (PARTITION BY source, dest ORDER BY t) AS l FROM et) GROUP BY t",
)
def m08(spark: SparkSession, d: str) -> DataFrame:
    m = tm.relationship_memory(edges(spark, d))
    fresh = F.col("cohort") != "retained"
    return m.groupBy("t").agg(eg.ratio(F.count_if(~fresh), F.count(F.lit(1))).alias("persisted_share"), eg.ratio(F.coalesce(F.sum(F.when(fresh, F.col("cents"))), F.lit(0)), F.count_if(fresh), 4).alias("mean_new_cents"))


@query(
    "m09_degree_drift",
    T + ", g AS (SELECT t, time_key, node, count(*) AS degree FROM it GROUP BY ALL) SELECT time_key, node, degree - lag(degree) OVER w AS degree_delta FROM g WINDOW w AS (PARTITION BY node ORDER BY t) QUALIFY lag(t) OVER w = t - 1",
)
def m09(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    g = eg.incidence(tm.with_t(edges(spark, d))).groupBy("t", "time_key", "node").agg(F.count(F.lit(1)).alias("degree"))
    w = Window.partitionBy("node").orderBy("t")
    return g.select("time_key", "node", (F.col("degree") - F.lag("degree").over(w)).alias("degree_delta"), (F.lag("t").over(w) == F.col("t") - 1).alias("ok")).filter("ok").drop("ok")


@query(
    "m10_rings",
    T + """, q AS (SELECT t, source, dest, cents FROM et WHERE source <> dest AND cents >= (SELECT quantile_cont(cents, 0.9) FROM e))
SELECT x.t, x.source AS a, x.dest AS b, y.dest AS c, least(x.cents, y.cents, z.cents) AS least_cents FROM q x JOIN q y ON y.source = x.dest AND y.t = x.t + 1 AND y.dest <> x.source JOIN q z ON z.source = y.dest AND z.dest = x.source AND z.t = x.t + 2""",
)
def m10(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return tm.rings(e, quantile(e, "cents", 0.9))


@query(
    "m11_series",
    T
    + """, s AS (SELECT node, t, sum(cents) / CAST(100 AS DOUBLE) AS x FROM it GROUP BY ALL), l AS (SELECT *, CASE WHEN lag(t) OVER w = t - 1 THEN lag(x) OVER w END AS p FROM s WINDOW w AS (PARTITION BY node ORDER BY t)),
g AS (SELECT node, count(*) AS n_months, avg(x) AS m, stddev_samp(x) AS sd, count(p) AS n, sum(x) FILTER (p IS NOT NULL) AS sx, sum(p) AS sp, sum(x * x) FILTER (p IS NOT NULL) AS sxx, sum(p * p) AS spp, sum(x * p) AS sxp FROM l GROUP BY node)
SELECT node, n_months, round(m, 4) AS mean_strength, round(CASE WHEN m > 0 THEN sd / m END, 6) AS burstiness, round(CASE WHEN n >= 3 AND n * sxx - sx * sx > sxx * 1e-9 AND n * spp - sp * sp > spp * 1e-9 THEN (n * sxp - sx * sp) / sqrt((n * sxx - sx * sx) * (n * spp - sp * sp)) END, 4) AS lag1_autocorrelation FROM g""",
)
def m11(spark: SparkSession, d: str) -> DataFrame:
    return tm.node_series(edges(spark, d))


@query(
    "m12_lagged_correlation",
    T + ", s AS (SELECT t, CAST(sum(cents) AS DOUBLE) AS x, CAST(count(DISTINCT source) AS DOUBLE) AS y FROM et GROUP BY t) SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, round(corr(a.x, b.y), 6) AS correlation FROM s a, generate_series(0, 3) g(lag), s b WHERE b.t = a.t + lag GROUP BY lag",
)
def m12(spark: SparkSession, d: str) -> DataFrame:
    s = tm.with_t(edges(spark, d)).groupBy("t").agg(F.sum("cents").cast("double").alias("x"), F.count_distinct("source").cast("double").alias("y"))
    return tm.lagged_correlation(s, "x", "y", 3)


_RH = T + """, r0 AS (SELECT source, dest, t, cents / CAST(100 AS DOUBLE) AS x, t - lag(t) OVER w AS gap, t - row_number() OVER w AS island FROM et WINDOW w AS (PARTITION BY source, dest ORDER BY t)),
r1 AS (SELECT *, count(*) OVER (PARTITION BY source, dest, island) AS run FROM r0), lm AS (SELECT max(t) AS last FROM mm),
r2 AS (SELECT source, dest, count(*) AS n_months, min(t) AS first_t, max(t) AS last_t, max(gap) AS max_gap, round(avg(gap), 6) AS mean_gap, max(run) AS longest_run, count(DISTINCT island) AS n_runs, coalesce(max(run) FILTER (t = last), 0) AS current_run,
 round(avg(x), 6) AS mean_amount, round(CASE WHEN avg(x) > 0 THEN coalesce(stddev_samp(x), 0) / avg(x) END, 6) AS cv_amount,
 round(greatest(count(*) FILTER (t % 2 = 0), count(*) FILTER (t % 2 = 1)) / CAST(count(*) AS DOUBLE), 6) AS phase_2, round(greatest(count(*) FILTER (t % 3 = 0), count(*) FILTER (t % 3 = 1), count(*) FILTER (t % 3 = 2)) / CAST(count(*) AS DOUBLE), 6) AS phase_3, max(last) AS last FROM r1, lm GROUP BY source, dest),
r3 AS (SELECT * EXCLUDE (last), last_t - first_t + 1 AS span, round(n_months / CAST(last_t - first_t + 1 AS DOUBLE), 6) AS support, last_t < last - 2 AS ended, last FROM r2),
rhy AS (SELECT * EXCLUDE (last), CASE WHEN first_t > last - 3 THEN 'TOO_YOUNG' WHEN n_months = 1 THEN 'ONE_SHOT' WHEN support >= 0.8 AND cv_amount < 0.05 THEN 'FIXED' WHEN support >= 0.8 THEN 'VARIABLE' WHEN n_months >= 3 AND phase_2 >= 0.8 THEN 'PERIODIC_2' WHEN n_months >= 3 AND phase_3 >= 0.8 THEN 'PERIODIC_3' ELSE 'INTERMITTENT' END AS rhythm FROM r3) """


@query("m13_m14_rhythm", _RH + "SELECT * FROM rhy")
def m13(spark: SparkSession, d: str) -> DataFrame:
    return tm.edge_rhythm(edges(spark, d))


@query("m15_rhythm_survival", _RH + ", h AS (SELECT n_months, count(*) AS n FROM rhy GROUP BY n_months) SELECT n_months, n, round(sum(n) OVER (ORDER BY n_months DESC) / CAST((SELECT sum(n) FROM h) AS DOUBLE), 6) AS survival FROM h")
def m15(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    h = tm.edge_rhythm(edges(spark, d)).groupBy("n_months").agg(F.count(F.lit(1)).alias("n"))
    # As many rows as there are months.
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n_months"))
    return h.select("n_months", "n", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("survival"))


@query(
    "m16_m17_window_pairs",
    T
    + f""", i AS (SELECT *, t - row_number() OVER (PARTITION BY source, dest ORDER BY t) AS island FROM et), r AS (SELECT source, dest, island, count(*) AS n, sum(cents) AS c, sum(CAST(cents AS HUGEINT) * cents) AS cc, sum(volume) AS v, min(time_key) AS a, max(time_key) AS b FROM i GROUP BY ALL)
SELECT source, dest, CAST(sum(n) AS BIGINT) AS n_months, CAST(sum(c) AS BIGINT) AS cents, round(sum(c) / CAST(sum(n) AS DOUBLE) / 100, 6) AS mean_amount, round(sqrt(CAST(sum(n) * CAST(sum(cc) AS HUGEINT) - CAST(sum(c) AS HUGEINT) * CAST(sum(c) AS HUGEINT) AS DOUBLE) / CASE WHEN sum(n) > 1 THEN sum(n) * (sum(n) - 1) END) / 100, 6) AS sd_amount,
 {rsql("sum(c) / CAST(100 AS DOUBLE)", "sum(v)")} AS ticket, min(a) AS first_month, max(b) AS last_month, max(n) AS longest_run, round(sum(n) / CAST((SELECT max(t) FROM mm) AS DOUBLE), 6) AS persistence FROM r GROUP BY source, dest""",
)
def m16(spark: SparkSession, d: str) -> DataFrame:
    return tm.window_pairs(edges(spark, d))
