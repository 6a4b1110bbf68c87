"""Queries on panels, roles, peers and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions import stats
from flowquarry.operators import edges as eg
from flowquarry.operators import flow
from flowquarry.operators import panel as pn
from flowquarry.operators import temporal as tm
from flowquarry.plans.base import E, EP, edges, edges_once, parties, rsql
from flowquarry.plans.flow import _CONC, _DEG, _FLOW_COLS, _LADDER, _REC, TIERS
from flowquarry.plans.registry import query
from flowquarry.plans.temporal import T
from flowquarry.session import cut

# ---- statistics on strengths by month

ST = T + ", sm AS (SELECT node, t, time_key, CAST(sum(cents) AS BIGINT) AS x, count(*) AS k FROM it GROUP BY ALL) "


def strengths(spark: SparkSession, d: str) -> DataFrame:
    """(node, t, time_key, x, k): strength in cents and degree."""
    return eg.incidence(tm.with_t(edges(spark, d))).groupBy("node", "t", "time_key").agg(F.sum("cents").alias("x"), F.count(F.lit(1)).alias("k"))


_ERFC = "((1 / (1 + 0.3275911 * {x})) * (0.254829592 + (1 / (1 + 0.3275911 * {x})) * (-0.284496736 + (1 / (1 + 0.3275911 * {x})) * (1.421413741 + (1 / (1 + 0.3275911 * {x})) * (-1.453152027 + (1 / (1 + 0.3275911 * {x})) * 1.061405429)))) * exp(-{x} * {x}))"
_MK = (
    ST
    + f""", ss AS (SELECT a.node, CAST(sum(sign(b.x - a.x)) AS BIGINT) AS s FROM sm a JOIN sm b ON b.node = a.node AND a.t < b.t GROUP BY a.node), tg AS (SELECT node, x, count(*) AS g FROM sm GROUP BY ALL),
tt AS (SELECT node, CAST(sum(g) AS BIGINT) AS n, sum(g * (g - 1) * (2 * g + 5)) AS ties FROM tg GROUP BY node), vv AS (SELECT node, n, s, (n * (n - 1) * (2 * n + 5) - ties) / CAST(18 AS DOUBLE) AS var FROM tt JOIN ss USING (node) WHERE n >= 4),
zz AS (SELECT node, n, s, CASE WHEN var > 0 THEN (s - sign(s)) / sqrt(var) ELSE 0 END AS z FROM vv), mk AS (SELECT node, n, s, round(z, 6) AS z, round({_ERFC.format(x="(abs(z) / sqrt(CAST(2 AS DOUBLE)))")}, 6) AS p FROM zz) """
)


@query("k25_mann_kendall", _MK + "SELECT * FROM mk")
def k25(spark: SparkSession, d: str) -> DataFrame:
    return stats.mann_kendall(strengths(spark, d), "node", "t", "x")


@query("k27_benjamini_hochberg", _MK + ", r AS (SELECT *, count(*) OVER (ORDER BY p) AS r, count(*) OVER () AS tot FROM mk), c AS (SELECT max(p) AS c FROM r WHERE p <= r * 0.1 / tot) SELECT mk.*, coalesce(p <= c, false) AS passes FROM mk, c")
def k27(spark: SparkSession, d: str) -> DataFrame:
    return stats.benjamini_hochberg(stats.mann_kendall(strengths(spark, d), "node", "t", "x"), "p")


@query("k26_theil_sen", ST + "SELECT a.node, round(quantile_cont((b.x - a.x) / CAST(b.t - a.t AS DOUBLE), 0.5), 4) AS slope FROM sm a JOIN sm b ON b.node = a.node AND a.t < b.t GROUP BY a.node")
def k26(spark: SparkSession, d: str) -> DataFrame:
    return stats.theil_sen(strengths(spark, d), "node", "t", "x")


def _avg_rank(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / CAST(2 AS DOUBLE))"


@query("a22_k09_spearman", ST + f", r AS (SELECT t, {_avg_rank('x', 't')} AS rx, {_avg_rank('k', 't')} AS rk FROM sm) SELECT t, count(*) AS n, round(corr(rx, rk), 6) AS rho FROM r GROUP BY t")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(strengths(spark, d), ["t"], "x", "k")


@query(
    "k10_within_corr",
    ST + ", c AS (SELECT node, count(*) OVER w AS n, x - avg(x) OVER w AS a, k - avg(k) OVER w AS b FROM sm WINDOW w AS (PARTITION BY node)) SELECT count(DISTINCT node) AS n_keys, count(*) AS n, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS r FROM c WHERE n >= 8",
)
def k10(spark: SparkSession, d: str) -> DataFrame:
    return stats.within_corr(strengths(spark, d), "node", "x", "k")


@query(
    "a21_k24_residuals",
    ST
    + """, l AS (SELECT node, t, ln(x / CAST(100 AS DOUBLE) + 1) AS y, ln(k) AS a, CAST(t AS DOUBLE) * 0 + k / CAST(1 + k AS DOUBLE) AS b FROM sm),
c AS (SELECT t, covar_pop(a, a) AS c11, covar_pop(b, b) AS c22, covar_pop(a, b) AS c12, covar_pop(a, y) AS c1y, covar_pop(b, y) AS c2y, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM l GROUP BY t)
SELECT node, l.t, round(y - my - (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) * (a - ma) - (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) * (b - mb), 4) AS residual FROM l JOIN c ON c.t = l.t""",
)
def a21(spark: SparkSession, d: str) -> DataFrame:
    s = strengths(spark, d).select("node", "t", F.log(F.col("x") / F.lit(100.0) + 1).alias("y"), F.log("k").alias("a"), (F.col("k") / (F.col("k") + 1)).alias("b"))
    return stats.residuals(s, ["t"], "y", "a", "b").select("node", "t", F.round("residual", 4).alias("residual"))


@query("a20_trend_fit", ST + "SELECT node, count(*) AS n, round(regr_slope(x / CAST(100 AS DOUBLE), t), 4) AS slope, round(regr_intercept(x / CAST(100 AS DOUBLE), t), 4) AS intercept FROM sm GROUP BY node HAVING count(*) >= 3")
def a20(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("x") / F.lit(100.0)
    return strengths(spark, d).withColumn("y", y).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("y", "t"), 4).alias("slope"), F.round(F.regr_intercept("y", "t"), 4).alias("intercept")).filter("n >= 3")


@query("p26_deciles", ST + ", q AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM sm) SELECT len(list_filter(c, lambda v: x > v)) AS decile, count(*) AS n FROM sm, q GROUP BY 1")
def p26(spark: SparkSession, d: str) -> DataFrame:
    s = strengths(spark, d)
    return s.groupBy(stats.decile(F.col("x"), stats.quantile_cuts(s, "x")).cast("bigint").alias("decile")).agg(F.count(F.lit(1)).alias("n"))


_LAB = ST + ", lb AS (SELECT a.node, a.t, CAST(a.x AS BIGINT) AS x, a.k, coalesce(b.x < 0.8 * a.x, true) AS y FROM sm a LEFT JOIN sm b ON b.node = a.node AND b.t = a.t + 1 WHERE a.t < (SELECT max(t) FROM mm)) "


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Node months with y: strength falls by over a fifth, or to nothing, in the next month."""
    s = strengths(spark, d)
    last = s.agg(F.max("t")).scalar()
    w = Window.partitionBy("node").orderBy("t")
    nxt = F.when(F.lead("t").over(w) == F.col("t") + 1, F.lead("x").over(w))
    return s.withColumn("y", F.coalesce(nxt < 0.8 * F.col("x"), F.lit(True))).filter(F.col("t") < last)


@query("k14_auc", _LAB + ", g AS (SELECT k, sum(CAST(y AS INTEGER)) AS p, sum(1 - CAST(y AS INTEGER)) AS q FROM lb GROUP BY k), h AS (SELECT *, sum(q) OVER (ORDER BY k) - q AS b FROM g) SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, round(sum(p * (b + q / CAST(2 AS DOUBLE))) / (CAST(sum(p) AS DOUBLE) * sum(q)), 6) AS auc FROM h")
def k14(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc(labelled(spark, d), "k", "y")


@query("k14_lift", _LAB + ", q AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c, avg(CAST(y AS INTEGER)) AS r FROM lb) SELECT CAST(9 - len(list_filter(c, lambda v: x > v)) AS INTEGER) AS bin, count(*) AS n, CAST(sum(CAST(y AS INTEGER)) AS BIGINT) AS n_pos, round(avg(CAST(y AS INTEGER)) / max(r), 6) AS lift FROM lb, q GROUP BY 1")
def k14l(spark: SparkSession, d: str) -> DataFrame:
    return stats.lift(labelled(spark, d), "x", "y")


FEATURES = ["size", "degree", "change", "age"]


def decline_features(spark: SparkSession, d: str) -> DataFrame:
    """(node, t, label, features, ...) of all labelled node months, written once."""
    from pyspark.ml.feature import VectorAssembler

    f = labelled(spark, d).select("node", "t", F.log1p(F.col("x") / F.lit(100.0)).alias("size"), F.log1p("k").alias("degree"), F.col("y").cast("double").alias("label"))
    w = Window.partitionBy("node").orderBy("t")
    f = f.withColumn("change", F.coalesce(F.when(F.lag("t").over(w) == F.col("t") - 1, F.col("size") - F.lag("size").over(w)), F.lit(0.0))).withColumn("age", F.log1p(F.row_number().over(w)))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(cut(f, "features"))


@query("k14_k15_decline_model")
def k14m(spark: SparkSession, d: str) -> DataFrame:
    """A logistic model of the next month's decline, fitted on all earlier months and scored on the last (out of time): AUC of the model and of degree alone."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    v = decline_features(spark, d)
    last = v.agg(F.max("t")).first()[0]
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(v.filter(F.col("t") < last))
    scored = model.transform(v.filter(F.col("t") == last)).select(F.round(vector_to_array("probability")[1], 6).alias("score"), "degree", (F.col("label") > 0).alias("y"))
    return stats.auc(scored, "score", "y").withColumn("model", F.lit("logistic")).unionByName(stats.auc(scored, "degree", "y").withColumn("model", F.lit("degree")))


@query("k14_rolling_origin")
def k14r(spark: SparkSession, d: str) -> DataFrame:
    """(model, test_t, n_pos, n_neg, auc, pr_auc): a logistic model and boosted trees fitted on all months before each of the last two and scored on it; a month's fit never sees a later one."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import vector_to_array

    v = decline_features(spark, d)
    last = v.agg(F.max("t")).first()[0]
    out = None
    for t in (last - 1, last):
        for name, estimator in (("logistic", LogisticRegression(maxIter=20, regParam=0.01)), ("boosted_trees", GBTClassifier(maxIter=10, maxDepth=3, seed=7))):
            model = estimator.fit(v.filter(F.col("t") < t))
            scored = cut(model.transform(v.filter(F.col("t") == t)).select(F.round(vector_to_array("probability")[1], 6).alias("score"), "label"), "scored")
            pr = BinaryClassificationEvaluator(rawPredictionCol="score", metricName="areaUnderPR").evaluate(scored)
            row = stats.auc(scored.withColumn("y", F.col("label") > 0), "score", "y").select(F.lit(name).alias("model"), F.lit(t).alias("test_t"), "n_pos", "n_neg", "auc", F.lit(round(pr, 6)).alias("pr_auc"))
            out = row if out is None else out.unionByName(row)
    return out


@query("k14_importance")
def k14i(spark: SparkSession, d: str) -> DataFrame:
    """(feature, auc, drop): the logistic model's AUC on the last month with one feature's values dealt to other nodes, and how far it falls below the whole one's. The deal is a rotation along a hash order within buckets of nodes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = decline_features(spark, d)
    last = v.agg(F.max("t")).first()[0]
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(v.filter(F.col("t") < last))
    test = v.filter(F.col("t") == last).drop("features")
    # Buckets keep the rotation out of one task; which values a bucket holds is chance.
    w = Window.partitionBy(F.pmod(F.xxhash64("node"), F.lit(64))).orderBy(F.xxhash64("node", F.lit(1)), "node")
    whole = Window.partitionBy(F.pmod(F.xxhash64("node"), F.lit(64)))
    out = None
    for feature in ("none", *FEATURES):
        x = test if feature == "none" else test.withColumn(feature, F.coalesce(F.lag(feature).over(w), F.max(feature).over(whole)))
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x)).select(F.round(vector_to_array("probability")[1], 6).alias("score"), (F.col("label") > 0).alias("y"))
        row = stats.auc(scored, "score", "y").select(F.lit(feature).alias("feature"), "auc")
        out = row if out is None else out.unionByName(row)
    out = cut(out, "importance")
    base = out.filter("feature = 'none'").agg(F.max("auc")).scalar()
    return out.filter("feature <> 'none'").select("feature", "auc", F.round(base - F.col("auc"), 6).alias("drop"))


# ---- balance panel

_WIDE = E + ", mo AS (SELECT DISTINCT time_key FROM e), nd AS (SELECT DISTINCT node FROM inc), long AS (SELECT nd.node, mo.time_key, CAST(coalesce(sum(cents), 0) AS BIGINT) AS balance FROM nd CROSS JOIN mo LEFT JOIN inc ON inc.node = nd.node AND inc.time_key = mo.time_key GROUP BY ALL) "


def wide(spark: SparkSession, d: str) -> DataFrame:
    """One row a node, a column for each delivered month, 0 without activity."""
    e = edges(spark, d)
    months = [r[0] for r in e.select("time_key").distinct().orderBy("time_key").collect()]
    return pn.widen(eg.incidence(e), "node", "cents", months).na.fill(0)


@query("t07_t08_melt", _WIDE + "SELECT * FROM long")
def t07(spark: SparkSession, d: str) -> DataFrame:
    return pn.melt(wide(spark, d), "node")


_FEAT = (
    _WIDE
    + """, l1 AS (SELECT *, CAST(substr(time_key, 1, 4) AS INTEGER) * 12 + CAST(substr(time_key, 6, 2) AS INTEGER) - 1 AS m FROM long),
f1 AS (SELECT *, min(m) FILTER (balance <> 0) OVER (PARTITION BY node) AS first_active, max(m) FILTER (balance <> 0) OVER (PARTITION BY node) AS last_active, balance - lag(balance) OVER w AS change_1, balance - lag(balance, 3) OVER w AS change_3,
 CASE WHEN count(*) OVER w3 = 3 THEN avg(balance) OVER w3 END AS mean_3, CASE WHEN count(*) OVER w6 = 6 THEN avg(balance) OVER w6 END AS mean_6, max(balance) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM l1
 WINDOW w AS (PARTITION BY node ORDER BY m), w3 AS (PARTITION BY node ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w6 AS (PARTITION BY node ORDER BY m ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING)),
f2 AS (SELECT *, CASE WHEN mean_6 > 0 THEN mean_3 / mean_6 - 1 END AS pct_change, CASE WHEN peak > 0 THEN 1 - balance / CAST(peak AS DOUBLE) END AS drawdown FROM f1), f3 AS (SELECT *, coalesce(pct_change <= -0.30, false) AS is_decline FROM f2),
f4 AS (SELECT *, is_decline AND NOT coalesce(lag(is_decline) OVER (PARTITION BY node ORDER BY m), false) AS event_start FROM f3), pan AS (SELECT *, min(m) FILTER (event_start) OVER (PARTITION BY node) AS first_event FROM f4) """
)


def panel(spark: SparkSession, d: str) -> DataFrame:
    return pn.balance_features(pn.melt(wide(spark, d), "node"), "node")


@query("k06_panel", _FEAT + "SELECT * REPLACE (round(mean_3, 4) AS mean_3, round(mean_6, 4) AS mean_6, round(pct_change, 6) AS pct_change, round(drawdown, 6) AS drawdown) FROM pan")
def k06(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).withColumns({c: F.round(c, k) for c, k in (("mean_3", 4), ("mean_6", 4), ("pct_change", 6), ("drawdown", 6))})


@query("k57_balance_shares", _WIDE + f"SELECT time_key, {rsql('count(*) FILTER (balance IS NULL)', 'count(*)')} AS null_share, {rsql('count(*) FILTER (balance = 0)', 'count(*)')} AS zero_share, {rsql('count(*) FILTER (balance < 0)', 'count(*)')} AS negative_share FROM long GROUP BY time_key")
def k57(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    b = F.col("balance")
    return pn.melt(wide(spark, d), "node").groupBy("time_key").agg(eg.ratio(F.count_if(b.isNull()), n).alias("null_share"), eg.ratio(F.count_if(b == 0), n).alias("zero_share"), eg.ratio(F.count_if(b < 0), n).alias("negative_share"))


@query("k11_lead_lag", _FEAT + ", s AS (SELECT a.node, a.change_1 AS x, b.balance AS y, b.m - a.m AS shift FROM pan a JOIN pan b ON b.node = a.node AND b.m - a.m BETWEEN -6 AND 6) SELECT shift, count(*) AS n, round(corr(x, y), 4) AS r FROM s WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY shift")
def k11(spark: SparkSession, d: str) -> DataFrame:
    return pn.lead_lag(panel(spark, d), "node", "change_1", "balance")


@query(
    "k12_event_study",
    _FEAT
    + """, ev AS (SELECT node, m AS em FROM pan WHERE event_start AND m = first_event), hit AS (SELECT p.m - em AS o, p.balance AS x FROM ev JOIN pan p ON p.node = ev.node AND p.m - em BETWEEN -6 AND 3),
mo2 AS (SELECT em, count(*) AS k FROM ev GROUP BY em), fr AS (SELECT p.node, p.m AS em, k FROM pan p JOIN mo2 ON mo2.em = p.m WHERE NOT EXISTS (SELECT 1 FROM pan q WHERE q.node = p.node AND q.event_start AND abs(q.m - p.m) <= 6)),
ct AS (SELECT p.m - em AS o, p.balance AS x, k FROM fr JOIN pan p ON p.node = fr.node AND p.m - em BETWEEN -6 AND 3), a AS (SELECT o, count(x) AS n_events, round(avg(x), 4) AS mean_event FROM hit GROUP BY o), b AS (SELECT o, CAST(sum(k) AS BIGINT) AS n_controls, round(sum(x * k) / CAST(sum(k) AS DOUBLE), 4) AS mean_control FROM ct GROUP BY o)
SELECT a.o AS "offset", n_events, mean_event, n_controls, mean_control FROM a LEFT JOIN b ON b.o = a.o""",
)
def k12(spark: SparkSession, d: str) -> DataFrame:
    return pn.event_study(panel(spark, d), "node", "balance")


@query(
    "k13_model_features",
    ST
    + """, g AS (SELECT node, t AS m, x, CASE WHEN lag(t) OVER w = t - 1 THEN x - lag(x) OVER w END AS d1, CASE WHEN lag(t, 3) OVER w = t - 3 THEN x - lag(x, 3) OVER w END AS d3, count(*) OVER w3 AS c3, avg(x) OVER w3 AS a3, count(*) OVER w6 AS presence_6 FROM sm
 WINDOW w AS (PARTITION BY node ORDER BY t), w3 AS (PARTITION BY node ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), w6 AS (PARTITION BY node ORDER BY t RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, sum(CASE WHEN d1 < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY m) AS s FROM g)
SELECT node, m, x, d1, d3, CAST(sum(CASE WHEN d1 < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY node, s ORDER BY m) AS BIGINT) AS negative_streak, round(CASE WHEN c3 >= 2 THEN a3 END, 4) AS mean_3, presence_6 FROM h""",
)
def k13(spark: SparkSession, d: str) -> DataFrame:
    s = strengths(spark, d).select("node", F.col("t").alias("m"), "x")
    return pn.model_features(s, "node", "x").withColumn("mean_3", F.round("mean_3", 4))


@query("w06_tiers", ST + ", n AS (SELECT node, sum(x) AS x FROM sm GROUP BY node), q AS (SELECT quantile_cont(x, [CAST(1 AS DOUBLE) / 3, CAST(2 AS DOUBLE) / 3]) AS c FROM n) SELECT node, CAST(len(list_filter(c, lambda v: x > v)) + 1 AS INTEGER) AS tier FROM n, q")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return pn.tiers(strengths(spark, d).groupBy("node").agg(F.sum("x").alias("x")), "x").select("node", "tier")


# ---- roles

_PANEL = (
    _CONC.rstrip()
    + ", " + _REC.partition(", dy AS")[1][2:] + _REC.partition(", dy AS")[2].rstrip()
    + ", " + _LADDER.partition(", basis AS")[1][2:] + _LADDER.partition(", basis AS")[2].rstrip()
    + _DEG.partition(", deg AS")[1] + _DEG.partition(", deg AS")[2]
    + f""", fl AS (SELECT {_FLOW_COLS} FROM deg), hubs AS (SELECT DISTINCT node FROM ladder WHERE version = 'P99_9'),
hx AS (SELECT time_key, inc.node, {", ".join(rsql(f"coalesce(sum(cents) FILTER (dir = '{x}' AND hubs.node IS NOT NULL), 0)", f"sum(cents) FILTER (dir = '{x}')") + f" AS hub_{x}_share" for x in ("in", "out"))} FROM inc LEFT JOIN hubs ON hubs.node = inc.cp GROUP BY time_key, inc.node),
np AS (SELECT fl.*, hhi_in, hhi_out, top1_in, top1_out, reciprocity_amount_share, hub_in_share, hub_out_share FROM fl JOIN conc USING (time_key, node) JOIN rec USING (time_key, node) JOIN hx USING (time_key, node)) """
)
_ROLE = (
    _PANEL
    + """, th AS (SELECT time_key, quantile_cont(throughflow, 0.9) AS tf90, quantile_cont(reciprocity_amount_share, 0.5) AS rec50 FROM np GROUP BY time_key), el AS (SELECT time_key, quantile_cont(hhi_in, 0.5) AS med_in, quantile_cont(hhi_out, 0.5) AS med_out FROM np WHERE degree >= 3 GROUP BY time_key),
roles AS (SELECT np.*, CASE WHEN in_cents > 0 AND out_cents <= 0 THEN 'one_sided' WHEN out_cents > 0 AND in_cents <= 0 THEN 'one_sided' WHEN abs(flow_ratio) <= 0.15 AND throughflow >= tf90 THEN 'conduit' WHEN flow_ratio > 0.5 THEN 'collector' WHEN flow_ratio < -0.5 THEN 'distributor' WHEN abs(flow_ratio) <= 0.15 AND reciprocity_amount_share >= rec50 THEN 'trader' ELSE 'mixed' END AS flow_role,
 CASE WHEN degree < 3 THEN 'single_relationship' WHEN coalesce(hub_in_share, 0) > 0.7 THEN 'infra_dependent' WHEN coalesce(top1_in, 0) > 0.7 THEN 'concentrated' WHEN coalesce(top1_out, 0) > 0.7 THEN 'concentrated' WHEN hhi_in <= med_in AND hhi_out <= med_out THEN 'balanced' ELSE 'balanced' END AS dependence_role FROM np JOIN th USING (time_key) LEFT JOIN el USING (time_key)) """
)


def node_panel(spark: SparkSession, d: str) -> DataFrame:
    """Node metrics of one hop side by side: each is one aggregation by month and node; their joins on that key move nothing again."""
    e = edges_once(spark, d)
    hubs = eg.build_ladder(e, TIERS)[0].filter("version = 'P99_9'").select("node")
    key = ["time_key", "node"]
    conc = flow.concentration(e).select(*key, "hhi_in", "hhi_out", "top1_in", "top1_out")
    return flow.flows(e).join(conc, key, "left").join(flow.reciprocity(e).select(*key, "reciprocity_amount_share"), key, "left").join(flow.hub_exposure(e, hubs), key, "left")


def role_panel(spark: SparkSession, d: str) -> DataFrame:
    return pn.dependence_roles(pn.flow_roles(node_panel(spark, d), ["time_key"]))


@query("r01_r05_roles", _ROLE + "SELECT time_key, node, flow_role, dependence_role FROM roles")
def r01(spark: SparkSession, d: str) -> DataFrame:
    return role_panel(spark, d).select("time_key", "node", "flow_role", "dependence_role")


@query("w06_size_terciles", _PANEL + ", q AS (SELECT time_key, quantile_cont(strength, [CAST(1 AS DOUBLE) / 3, CAST(2 AS DOUBLE) / 3]) AS c FROM np GROUP BY time_key) SELECT np.time_key, node, CASE WHEN strength <= c[1] THEN 'small' WHEN strength <= c[2] THEN 'middle' ELSE 'large' END AS size_role FROM np JOIN q USING (time_key)")
def r02(spark: SparkSession, d: str) -> DataFrame:
    return pn.tercile_classes(flow.flows(edges(spark, d)), ["time_key"], "strength", ("small", "middle", "large"), "size_role").select("time_key", "node", "size_role")


_STABLE = (
    _ROLE
    + """, mm AS (SELECT time_key, CAST(dense_rank() OVER (ORDER BY time_key) AS INTEGER) AS t FROM (SELECT DISTINCT time_key FROM e)), r0 AS (SELECT node, t, flow_role AS role, t - row_number() OVER (PARTITION BY node ORDER BY t) AS isl FROM roles JOIN mm USING (time_key)),
r1 AS (SELECT *, CASE WHEN lag(role) OVER w = role OR lag(t) OVER w IS NULL THEN role END AS c FROM r0 WINDOW w AS (PARTITION BY node, isl ORDER BY t)), r2 AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY node, isl ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stable_role FROM r1),
r3 AS (SELECT *, coalesce(lag(stable_role) OVER w <> stable_role, true) AS ch, lag(t) OVER w IS NOT NULL AS had FROM r2 WINDOW w AS (PARTITION BY node, isl ORDER BY t)), r4 AS (SELECT *, sum(CAST(ch AS INTEGER)) OVER (PARTITION BY node, isl ORDER BY t) AS sp FROM r3),
stab AS (SELECT node, t, role, stable_role, ch AND had AS switched, CAST(row_number() OVER (PARTITION BY node, isl, sp ORDER BY t) AS INTEGER) AS months_in FROM r4) """
)


def stable(spark: SparkSession, d: str) -> DataFrame:
    r = tm.with_t(role_panel(spark, d).select("time_key", "node", F.col("flow_role").alias("role"))).select("node", "t", "role")
    return tm.stable_roles(r, ["node"])


@query("r06_stable_roles", _STABLE + "SELECT * FROM stab")
def r06(spark: SparkSession, d: str) -> DataFrame:
    return stable(spark, d)


@query("r07_transitions", _STABLE + ", p AS (SELECT stable_role AS to_role, CASE WHEN lag(t) OVER w = t - 1 THEN lag(stable_role) OVER w END AS from_role FROM stab WINDOW w AS (PARTITION BY node ORDER BY t)) SELECT from_role, to_role, count(*) AS n FROM p WHERE from_role IS NOT NULL GROUP BY ALL")
def r07(spark: SparkSession, d: str) -> DataFrame:
    return tm.transitions(stable(spark, d), ["node"])


@query("r08_stability", _STABLE + "SELECT node, count(*) AS n_months, count(*) FILTER (switched) AS n_role_switches, round(1 - count(*) FILTER (switched) / CAST(count(*) AS DOUBLE), 6) AS stability FROM stab GROUP BY node")
def r08(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return stable(spark, d).groupBy("node").agg(n.alias("n_months"), F.count_if("switched").alias("n_role_switches"), F.round(1 - F.count_if("switched") / n, 6).alias("stability"))


_PEER = EP + ", s AS (SELECT time_key, inc.node, CAST(sum(cents) AS BIGINT) AS strength, p.naics2, p.naics3, p.naics4 FROM inc LEFT JOIN party p ON p.node = inc.node GROUP BY ALL), c AS (SELECT *, CASE WHEN naics4 IS NOT NULL THEN count(*) OVER (PARTITION BY time_key, naics4) END AS n4, CASE WHEN naics3 IS NOT NULL THEN count(*) OVER (PARTITION BY time_key, naics3) END AS n3, CASE WHEN naics2 IS NOT NULL THEN count(*) OVER (PARTITION BY time_key, naics2) END AS n2 FROM s), l AS (SELECT *, CASE WHEN n4 >= 30 THEN 'naics4' WHEN n3 >= 30 THEN 'naics3' WHEN n2 >= 30 THEN 'naics2' END AS peer_level, CASE WHEN n4 >= 30 THEN naics4 WHEN n3 >= 30 THEN naics3 WHEN n2 >= 30 THEN naics2 END AS peer_key FROM c) "


@query("r09_peers", _PEER + f"SELECT time_key, node, peer_level, peer_key, CASE WHEN peer_level IS NOT NULL THEN round({_avg_rank('strength', 'time_key, peer_level, peer_key')} / count(*) OVER (PARTITION BY time_key, peer_level, peer_key), 6) END AS pct_strength FROM l")
def r09(spark: SparkSession, d: str) -> DataFrame:
    s = eg.incidence(edges(spark, d)).groupBy("time_key", "node").agg(F.sum("cents").alias("strength")).join(parties(spark, d).select("node", "naics2", "naics3", "naics4"), "node", "left")
    return pn.peer_percentiles(s, ["time_key"], ["naics4", "naics3", "naics2"], ["strength"]).select("time_key", "node", "peer_level", "peer_key", "pct_strength")


@query(
    "r10_rising_queue",
    ST + ", g AS (SELECT node, t, time_key, x, x - lag(x) OVER w AS rise, lag(t) OVER w AS l FROM sm WINDOW w AS (PARTITION BY node ORDER BY t)) SELECT node, time_key, x, rise FROM g WHERE t = (SELECT max(t) FROM mm) AND l = t - 1 AND rise > 0 ORDER BY rise DESC, node LIMIT 30",
)
def r10(spark: SparkSession, d: str) -> DataFrame:
    """Top 30 nodes by rise of strength in the last month (a top-k report)."""
    s = strengths(spark, d)
    w = Window.partitionBy("node").orderBy("t")
    g = s.select("node", "t", "time_key", "x", (F.col("x") - F.lag("x").over(w)).alias("rise"), F.lag("t").over(w).alias("l"))
    last = s.agg(F.max("t")).scalar()
    return pn.queue(g, (F.col("t") == last) & (F.col("l") == F.col("t") - 1) & (F.col("rise") > 0), [F.desc("rise"), F.col("node")], pn.money(F.col("rise") / F.lit(100.0))).select("node", "time_key", "x", "rise")


@query("r11_role_ribbon", _STABLE + ", b AS (SELECT node, t, stable_role, t - row_number() OVER (PARTITION BY node, stable_role ORDER BY t) AS s FROM stab) SELECT node, stable_role, min(t) AS first_t, max(t) AS last_t, count(*) AS n_months FROM b GROUP BY node, stable_role, s")
def r11(spark: SparkSession, d: str) -> DataFrame:
    s = stable(spark, d)
    w = Window.partitionBy("node", "stable_role").orderBy("t")
    b = s.select("node", "t", "stable_role", (F.col("t") - F.row_number().over(w)).alias("s"))
    return b.groupBy("node", "stable_role", "s").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n_months")).drop("s")


@query("k56_panel_checks", _DEG + "SELECT time_key, count(*) AS n_nodes, CAST(sum(in_cents) - sum(out_cents) AS BIGINT) AS closure, count(*) FILTER (in_degree = 0) AS n_no_in, count(*) FILTER (out_degree = 0) AS n_no_out FROM deg GROUP BY time_key")
def k56(spark: SparkSession, d: str) -> DataFrame:
    return flow.degrees(edges(spark, d)).groupBy("time_key").agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("in_cents") - F.sum("out_cents")).alias("closure"), F.count_if(F.col("in_degree") == 0).alias("n_no_in"), F.count_if(F.col("out_degree") == 0).alias("n_no_out"))
