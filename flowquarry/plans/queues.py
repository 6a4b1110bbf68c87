"""Work queues over the last month: top-30 reports (their limit is the feature) from roles, momentum and peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions.ranks import group_quantiles
from flowquarry.operators import panel as pn
from flowquarry.operators import temporal as tm
from flowquarry.plans.base import PARTY, edges_once, parties
from flowquarry.plans.panels import _STABLE, _avg_rank, role_panel
from flowquarry.plans.registry import query
from flowquarry.plans.studies import _DYN, dynamics_metrics
from flowquarry.session import cut

TOP = 30

_ROLES_SQL = (
    _DYN
    + """, dr AS (SELECT dm.*, CASE WHEN since <= 2 THEN 'newcomer' WHEN gap > 1 THEN 'intermittent' WHEN prior >= 3 AND (lost_share >= 0.4 OR (mom <= -0.3 AND pj <= p25)) THEN 'bleeding' WHEN in_degree >= 3 AND new_share >= 0.4 AND mom > 0.1 THEN 'expanding'
 WHEN pj >= p50 AND abs(mom) < 0.35 THEN 'steady' ELSE 'variable' END AS role FROM dm JOIN dq USING (t)), q0 AS (SELECT *, t - row_number() OVER (PARTITION BY node ORDER BY t) AS isl FROM dr),
q1 AS (SELECT *, CASE WHEN lag(role) OVER w = role OR lag(t) OVER w IS NULL THEN role END AS c FROM q0 WINDOW w AS (PARTITION BY node, isl ORDER BY t)), q2 AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY node, isl ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stable_role FROM q1), lst AS (SELECT max(t) AS t FROM mm) """
)


def stable_dynamics(spark: SparkSession, d: str) -> DataFrame:
    """The months' dynamics with the role that held, written once."""
    m = cut(pn.dynamics_roles(dynamics_metrics(edges_once(spark, d)), ["t"]), "dynamics")
    held = tm.stable_roles(m.select("node", "t", F.col("dynamics_role").alias("role")), ["node"]).select("node", "t", "stable_role")
    return m.join(held, ["node", "t"])


def _last(df: DataFrame) -> DataFrame:
    return df.filter(F.col("t") == df.agg(F.max("t")).scalar())


@query("r10_revenue_at_risk", _ROLES_SQL + "SELECT node, s AS strength, lost_share AS lost_amount_share, round(s * lost_share, 2) AS at_risk FROM q2 JOIN lst USING (t) WHERE stable_role = 'bleeding' ORDER BY at_risk DESC, node LIMIT 30")
def at_risk(spark: SparkSession, d: str) -> DataFrame:
    """Bleeding nodes by strength times the share of payers' money lost."""
    lost = F.coalesce("lost_amount_share", F.lit(0.0))
    b = _last(stable_dynamics(spark, d)).filter("stable_role = 'bleeding'").select("node", "strength", lost.alias("lost_amount_share"), F.round(F.col("strength") * lost, 2).alias("at_risk"))
    return b.orderBy(F.desc("at_risk"), "node").limit(TOP)


@query(
    "r10_steady_to_bleeding",
    _ROLES_SQL + ", pv AS (SELECT *, CASE WHEN lag(t) OVER w = t - 1 THEN lag(stable_role) OVER w END AS was FROM q2 WINDOW w AS (PARTITION BY node ORDER BY t)) SELECT node, s AS strength FROM pv JOIN lst USING (t) WHERE stable_role = 'bleeding' AND was = 'steady' ORDER BY s DESC, node LIMIT 30",
)
def drift(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose role that held was steady the month before and is bleeding now."""
    w = Window.partitionBy("node").orderBy("t")
    p = stable_dynamics(spark, d).withColumn("was", F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("stable_role").over(w)))
    return _last(p).filter("stable_role = 'bleeding' and was = 'steady'").select("node", "strength").orderBy(F.desc("strength"), "node").limit(TOP)


@query(
    "r10_losing_to_peers",
    _DYN + ", " + PARTY
    + f""", lm AS (SELECT dm.node, s, mom, naics2, naics3, naics4 FROM dm LEFT JOIN party ON party.node = dm.node WHERE t = (SELECT max(t) FROM mm) AND mom IS NOT NULL), sec AS (SELECT naics2, quantile_cont(mom, 0.5) AS sector_mom FROM lm WHERE naics2 IS NOT NULL GROUP BY naics2),
c AS (SELECT *, CASE WHEN naics4 IS NOT NULL THEN count(*) OVER (PARTITION BY naics4) END AS n4, CASE WHEN naics3 IS NOT NULL THEN count(*) OVER (PARTITION BY naics3) END AS n3, CASE WHEN naics2 IS NOT NULL THEN count(*) OVER (PARTITION BY naics2) END AS n2 FROM lm),
l AS (SELECT *, CASE WHEN n4 >= 30 THEN 'naics4' WHEN n3 >= 30 THEN 'naics3' WHEN n2 >= 30 THEN 'naics2' END AS lv, CASE WHEN n4 >= 30 THEN naics4 WHEN n3 >= 30 THEN naics3 WHEN n2 >= 30 THEN naics2 END AS pk FROM c),
r AS (SELECT *, CASE WHEN lv IS NOT NULL THEN round({_avg_rank('mom', 'lv, pk')} / count(*) OVER (PARTITION BY lv, pk), 6) END AS pct FROM l)
SELECT node, naics2, s AS strength, round(mom, 6) AS strength_mom, pct AS pct_strength_mom, round(sector_mom - mom, 6) AS gap FROM r JOIN sec USING (naics2) WHERE pct <= 0.2 AND sector_mom >= -0.02 AND mom < 0 ORDER BY gap DESC, s DESC, node LIMIT 30""",
)
def losing(spark: SparkSession, d: str) -> DataFrame:
    """Nodes in the lowest fifth of their peers' momentum that shrink in a sector whose median is flat or rising."""
    m = dynamics_metrics(edges_once(spark, d))
    x = cut(_last(m).filter("strength_mom is not null").join(parties(spark, d).select("node", "naics2", "naics3", "naics4"), "node", "left"), "last").withColumn("one", F.lit(1))
    sector = group_quantiles(x.filter("naics2 is not null"), ["naics2"], "strength_mom", {"sector_mom": 0.5})
    r = pn.peer_percentiles(x, ["one"], ["naics4", "naics3", "naics2"], ["strength_mom"]).join(sector, "naics2")
    hit = r.filter((F.col("pct_strength_mom") <= 0.2) & (F.col("sector_mom") >= -0.02) & (F.col("strength_mom") < 0))
    out = hit.select("node", "naics2", "strength", F.round("strength_mom", 6).alias("strength_mom"), "pct_strength_mom", F.round(F.col("sector_mom") - F.col("strength_mom"), 6).alias("gap"))
    return out.orderBy(F.desc("gap"), F.desc("strength"), "node").limit(TOP)


@query(
    "r10_new_conduits",
    _STABLE + ", pv AS (SELECT node, t, stable_role, CASE WHEN lag(t) OVER w = t - 1 THEN lag(stable_role) OVER w END AS was FROM stab WINDOW w AS (PARTITION BY node ORDER BY t)) SELECT pv.node, was, throughflow, flow_ratio FROM pv JOIN mm USING (t) JOIN roles ON roles.node = pv.node AND roles.time_key = mm.time_key WHERE t = (SELECT max(t) FROM mm) AND stable_role = 'conduit' AND was <> 'conduit' ORDER BY throughflow DESC, pv.node LIMIT 30",
)
def new_conduits(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose flow role that holds became conduit."""
    m = cut(tm.with_t(role_panel(spark, d)).select("node", "t", "flow_role", "throughflow", "flow_ratio"), "roles")
    held = tm.stable_roles(m.select("node", "t", F.col("flow_role").alias("role")), ["node"]).select("node", "t", "stable_role")
    w = Window.partitionBy("node").orderBy("t")
    p = held.withColumn("was", F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("stable_role").over(w))).join(m, ["node", "t"])
    return _last(p).filter("stable_role = 'conduit' and was <> 'conduit'").select("node", "was", "throughflow", "flow_ratio").orderBy(F.desc("throughflow"), "node").limit(TOP)
