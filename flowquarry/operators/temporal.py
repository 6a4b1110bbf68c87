"""Metrics across months: tenure, relationship memory, turnover, rhythm, roles' hysteresis.

A month loop with state becomes windows over ``t``, the rank of a month among those delivered. Window partitions are one node or one pair, with at most
one row a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.operators.edges import incidence, ratio
from flowquarry.operators.snapshots import snapshot_ranks


def with_t(df: DataFrame, period: str = "time_key") -> DataFrame:
    """Adds t: 1 for the first delivered period, counting delivered ones only."""
    return df.withColumn("t", F.array_position(snapshot_ranks(df, period), F.col(period)).cast("int"))


def tenure(edges: DataFrame) -> DataFrame:
    """Per node and month: months since first seen, months active so far, and the gap to the month of activity before (1 = consecutive, null at first)."""
    seen = with_t(incidence(edges).select("time_key", "node").distinct())
    w = Window.partitionBy("node").orderBy("t")
    return seen.select("time_key", "node", (F.col("t") - F.min("t").over(w)).alias("months_since_first_seen"), F.row_number().over(w).alias("months_active"), (F.col("t") - F.lag("t").over(w)).alias("activity_gap"))


def relationship_memory(edges: DataFrame, memory: int = 6, span: int = 6, persistent: int = 4) -> DataFrame:
    """Each pair and month as retained (there the month before), returning (within ``memory`` months) or new; persistent if there in at least ``persistent`` of the last ``span``."""
    e = with_t(edges)
    w = Window.partitionBy("source", "dest").orderBy("t")
    last = F.lag("t").over(w)
    recent = F.count(F.lit(1)).over(w.rangeBetween(-(span - 1), 0))
    cls = F.when(last == F.col("t") - 1, "retained").when(last >= F.col("t") - memory, "returning").otherwise("new")
    return e.select(*e.columns, cls.alias("cohort"), (recent >= persistent).alias("is_persistent"))


def cohorts(edges: DataFrame) -> DataFrame:
    """Per node, month and side: counts and amount shares of retained, returning and new relationships, and of persistent ones. Null in the first month."""
    m = incidence(relationship_memory(edges))
    aggs = []
    for k in ("retained", "returning", "new"):
        hit = F.col("cohort") == k
        aggs += [F.when(F.max("t") > 1, F.count_if(hit)).alias(f"n_{k}"), F.when(F.max("t") > 1, ratio(F.sum(F.when(hit, F.col("cents")).otherwise(0)), F.sum("cents"))).alias(f"{k}_amount_share")]
    aggs.append(F.when(F.max("t") > 1, F.count_if("is_persistent")).alias("n_persistent"))
    return m.groupBy("time_key", "node", "dir").agg(*aggs)


def _shifted(edges: DataFrame) -> DataFrame:
    """Each pair and month with its amount now and the month before; a pair gone this month has a row too, with null ``now``."""
    e = with_t(edges)
    top = e.agg(F.max("t")).scalar()
    both = F.array(F.struct(F.col("t").alias("at"), F.col("cents").alias("now"), F.lit(None).cast("bigint").alias("before")), F.struct((F.col("t") + 1).alias("at"), F.lit(None).cast("bigint").alias("now"), F.col("cents").alias("before")))
    rows = e.select("source", "dest", F.explode(both).alias("x")).select("source", "dest", "x.*").filter(F.col("at") <= top)
    return rows.groupBy("at", "source", "dest").agg(F.max("now").alias("now"), F.max("before").alias("before"))


def side_turnover(edges: DataFrame) -> DataFrame:
    """Per node, t and side: counterparties lost since the month before, Jaccard of both months' sets, and the lost share of the month before's amount (null if nothing was lost)."""
    s = _shifted(edges)
    ends = F.array(F.struct(F.col("source").alias("node"), F.lit("out").alias("dir")), F.struct(F.col("dest").alias("node"), F.lit("in").alias("dir")))
    per = s.filter("at > 1").select("at", F.explode(ends).alias("e"), "now", "before").select("at", "e.*", "now", "before")
    lost = F.col("now").isNull()
    both = F.col("now").isNotNull() & F.col("before").isNotNull()
    return per.groupBy(F.col("at").alias("t"), "node", "dir").agg(
        F.count_if(lost).alias("n_lost"),
        ratio(F.count_if(both), F.count(F.lit(1))).alias("jaccard"),
        F.when(F.count_if(lost) > 0, ratio(F.sum(F.when(lost, F.col("before")).otherwise(0)), F.sum(F.coalesce("before", F.lit(0))))).alias("lost_amount_share"),
    )


def graph_turnover(edges: DataFrame) -> DataFrame:
    """Per t: Jaccard of edges and of nodes with the month before, and amount shares of edges kept and new."""
    s = _shifted(edges).filter("at > 1")
    both = F.col("now").isNotNull() & F.col("before").isNotNull()
    e = s.groupBy("at").agg(
        ratio(F.count_if(both), F.count(F.lit(1))).alias("edge_jaccard"),
        ratio(F.sum(F.when(both, F.col("now")).otherwise(0)), F.sum("now")).alias("retained_amount_share"),
        ratio(F.sum(F.when(F.col("before").isNull(), F.col("now")).otherwise(0)), F.sum("now")).alias("new_amount_share"),
    )
    n = s.select("at", F.explode(F.array("source", "dest")).alias("node"), F.col("now").isNotNull().alias("now"), F.col("before").isNotNull().alias("before"))
    n = n.groupBy("at", "node").agg(F.max("now").alias("now"), F.max("before").alias("before")).groupBy("at").agg(ratio(F.count_if(F.col("now") & F.col("before")), F.count(F.lit(1))).alias("node_jaccard"))
    return e.join(n, "at").withColumnRenamed("at", "t")


def top_payers(edges: DataFrame) -> DataFrame:
    """Per payee and month: top payer (largest amount, then lowest id), its share, whether it is the one of the month before, and the share's change. Null without the month before."""
    e = with_t(edges)
    top = e.groupBy("t", "time_key", F.col("dest").alias("node")).agg(F.min_by("source", F.struct(-F.col("cents"), F.col("source"))).alias("top_payer"), F.max("cents").alias("c"), F.sum("cents").alias("s"))
    top = top.withColumn("top_share", ratio("c", "s", 9))
    w = Window.partitionBy("node").orderBy("t")
    prev = F.lag("t").over(w) == F.col("t") - 1
    return top.select("time_key", "node", "top_payer", F.round("top_share", 6).alias("top_share"), F.when(prev, F.col("top_payer") == F.lag("top_payer").over(w)).alias("top_payer_same"), F.when(prev, F.round(F.col("top_share") - F.lag("top_share").over(w), 6)).alias("top_share_delta"))


def contagion(edges: DataFrame, shrink: float = 0.8) -> DataFrame:
    """Per payee and month: the payers' mean log change of strength weighted by what they pay, and the share of inflow from payers that shrank below ``shrink``."""
    e = with_t(edges)
    s = incidence(e).groupBy("t", "node").agg(F.sum("cents").alias("s"))
    w = Window.partitionBy("node").orderBy("t")
    change = s.select("t", F.col("node").alias("source"), F.when(F.lag("t").over(w) == F.col("t") - 1, F.when(F.lag("s").over(w) > 0, F.col("s") / F.lag("s").over(w))).alias("r")).filter("r > 0")
    m = e.join(change, ["t", "source"])
    weight = F.sum("cents")
    return m.groupBy("time_key", F.col("dest").alias("node")).agg(F.round(F.when(weight > 0, F.sum(F.col("cents") * F.log("r")) / weight), 6).alias("payer_log_change"), ratio(F.sum(F.when(F.col("r") < shrink, F.col("cents")).otherwise(0)), weight).alias("shrinking_inflow_share"))


def rings(edges: DataFrame, least_cents: Column | int) -> DataFrame:
    """Rings a -> b -> c -> a over three consecutive months, along edges of at least ``least_cents``. a, b and c differ; a hub's paths are bounded by that threshold, which the caller sets."""
    e = with_t(edges).filter((F.col("cents") >= least_cents) & (F.col("source") != F.col("dest")))
    x = e.select(F.col("source").alias("a"), F.col("dest").alias("b"), "t", F.col("cents").alias("c1"))
    y = e.select(F.col("source").alias("b"), F.col("dest").alias("c"), (F.col("t") - 1).alias("t"), F.col("cents").alias("c2"))
    z = e.select(F.col("source").alias("c"), F.col("dest").alias("a"), (F.col("t") - 2).alias("t"), F.col("cents").alias("c3"))
    return x.join(y, ["b", "t"]).filter("a <> c").join(z, ["c", "a", "t"]).select("t", "a", "b", "c", F.least("c1", "c2", "c3").alias("least_cents"))


def node_series(edges: DataFrame) -> DataFrame:
    """Per node: months, mean and coefficient of variation of strength (sample), and lag-1 autocorrelation over consecutive months (null below three pairs)."""
    s = incidence(with_t(edges)).groupBy("node", "t").agg((F.sum("cents") / F.lit(100.0)).alias("x"))
    w = Window.partitionBy("node").orderBy("t")
    s = s.withColumn("p", F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("x").over(w)))
    n = F.count("p")
    sx, sp, sxx, spp, sxp = (F.sum(F.when(F.col("p").isNotNull(), v)) for v in (F.col("x"), F.col("p"), F.col("x") * F.col("x"), F.col("p") * F.col("p"), F.col("x") * F.col("p")))
    vx, vp = n * sxx - sx * sx, n * spp - sp * sp
    r = F.when((n >= 3) & (vx > sxx * 1e-9) & (vp > spp * 1e-9), (n * sxp - sx * sp) / F.sqrt(F.greatest(vx * vp, F.lit(1e-300))))
    return s.groupBy("node").agg(F.count(F.lit(1)).alias("n_months"), F.round(F.avg("x"), 4).alias("mean_strength"), F.round(F.when(F.avg("x") > 0, F.stddev_samp("x") / F.avg("x")), 6).alias("burstiness"), F.round(r, 4).alias("lag1_autocorrelation"))


def lagged_correlation(series: DataFrame, x: str, y: str, lags: int) -> DataFrame:
    """Correlation of x at t with y at t + lag for lags 0..``lags``. ``series`` is one row a month, (t, x, y)."""
    a = series.select(F.col("t"), F.col(x).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")).withColumn("t2", F.col("t") + F.col("lag"))
    b = series.select(F.col("t").alias("t2"), F.col(y).alias("y"))
    return a.join(b, "t2").groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("correlation"))


def edge_rhythm(edges: DataFrame, age: int = 4) -> DataFrame:
    """Per directed pair over the window: presence, span, support, gaps, runs, amount statistics, and its rhythm class.

    Classes in order: TOO_YOUNG (first seen in the last ``age`` - 1 months), ONE_SHOT, FIXED (present in 80 % of its span, amount varies by under 5 %), VARIABLE (present in 80 %),
    PERIODIC_2 and PERIODIC_3 (80 % in one phase), INTERMITTENT. ``ended`` if last seen over two months before the last.
    """
    e = with_t(edges)
    last = e.agg(F.max("t")).scalar()
    w = Window.partitionBy("source", "dest").orderBy("t")
    e = e.select("source", "dest", "t", (F.col("cents") / F.lit(100.0)).alias("x"), "volume", (F.col("t") - F.lag("t").over(w)).alias("gap"), (F.col("t") - F.row_number().over(w)).alias("island"))
    e = e.withColumn("run", F.count(F.lit(1)).over(Window.partitionBy("source", "dest", "island")))
    phase = lambda k: F.greatest(*[F.count_if(F.col("t") % k == i) for i in range(k)]) / F.count(F.lit(1))
    per = e.groupBy("source", "dest").agg(
        F.count(F.lit(1)).alias("n_months"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.max("gap").alias("max_gap"),
        F.round(F.avg("gap"), 6).alias("mean_gap"),
        F.max("run").alias("longest_run"),
        F.count_distinct("island").alias("n_runs"),
        F.max(F.when(F.col("t") == last, F.col("run"))).alias("current_run"),
        F.round(F.avg("x"), 6).alias("mean_amount"),
        F.round(F.when(F.avg("x") > 0, F.coalesce(F.stddev_samp("x"), F.lit(0.0)) / F.avg("x")), 6).alias("cv_amount"),
        F.round(phase(2), 6).alias("phase_2"),
        F.round(phase(3), 6).alias("phase_3"),
    )
    per = per.withColumns({"span": F.col("last_t") - F.col("first_t") + 1, "current_run": F.coalesce("current_run", F.lit(0))})
    per = per.withColumns({"support": ratio("n_months", "span"), "ended": F.col("last_t") < last - 2})
    steady = F.col("support") >= 0.8
    cls = (
        F.when(F.col("first_t") > last - age + 1, "TOO_YOUNG")
        .when(F.col("n_months") == 1, "ONE_SHOT")
        .when(steady & (F.col("cv_amount") < 0.05), "FIXED")
        .when(steady, "VARIABLE")
        .when((F.col("n_months") >= 3) & (F.col("phase_2") >= 0.8), "PERIODIC_2")
        .when((F.col("n_months") >= 3) & (F.col("phase_3") >= 0.8), "PERIODIC_3")
        .otherwise("INTERMITTENT")
    )
    return per.withColumn("rhythm", cls)


def window_pairs(edges: DataFrame) -> DataFrame:
    """Per directed pair over the window, by sufficient statistics in one fold: months, amount sum, mean, sample deviation and CV, ticket, first and last month, longest run, persistence of the delivered months."""
    e = with_t(edges)
    n_months = e.agg(F.max("t")).scalar()
    w = Window.partitionBy("source", "dest").orderBy("t")
    e = e.withColumn("island", F.col("t") - F.row_number().over(w))
    runs = e.groupBy("source", "dest", "island").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("c"), F.sum(F.col("cents").cast("decimal(18,0)") * F.col("cents").cast("decimal(18,0)")).cast("decimal(28,0)").alias("cc"), F.sum("volume").alias("v"), F.min("time_key").alias("a"), F.max("time_key").alias("b"))
    n, s = F.sum("n"), F.sum("c")
    # Whole numbers up to the last step, so equal amounts have a deviation of exactly 0.
    var = (n.cast("decimal(10,0)") * F.sum("cc") - s.cast("decimal(19,0)") * s.cast("decimal(19,0)")).cast("double") / F.when(n > 1, n * (n - 1))
    return runs.groupBy("source", "dest").agg(
        n.alias("n_months"), s.alias("cents"), F.round(s / n / F.lit(100.0), 6).alias("mean_amount"), F.round(F.sqrt(var) / F.lit(100.0), 6).alias("sd_amount"),
        ratio(s / F.lit(100.0), F.sum("v")).alias("ticket"), F.min("a").alias("first_month"), F.max("b").alias("last_month"), F.max("n").alias("longest_run"), F.round(n / n_months, 6).alias("persistence"),
    )


# ---- roles with hysteresis


def stable_roles(roles: DataFrame, key: list[str], role: str = "role") -> DataFrame:
    """Adds stable_role, months_in and switched to (key, t, role): the stable role changes only when a raw role stands for the second month in a row.

    A key absent for a month starts anew with its raw role. In closed form: within an island of consecutive months, the stable role is the last
    raw role that was confirmed, or the island's first.
    """
    w = Window.partitionBy(*key).orderBy("t")
    r = roles.withColumn("__island", F.col("t") - F.row_number().over(w))
    wi = Window.partitionBy(*key, "__island").orderBy("t")
    confirmed = F.when((F.lag(role).over(wi) == F.col(role)) | F.lag("t").over(wi).isNull(), F.col(role))
    r = r.withColumn("__c", confirmed)
    r = r.withColumn("stable_role", F.last("__c", ignorenulls=True).over(wi.rowsBetween(Window.unboundedPreceding, 0)))
    changed = F.coalesce(F.lag("stable_role").over(wi) != F.col("stable_role"), F.lit(True))
    r = r.withColumn("switched", changed & F.lag("t").over(wi).isNotNull()).withColumn("__spell", F.sum(changed.cast("int")).over(wi))
    months = F.row_number().over(Window.partitionBy(*key, "__island", "__spell").orderBy("t"))
    return r.withColumn("months_in", months).drop("__island", "__c", "__spell")


def transitions(stable: DataFrame, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("t")
    prev = stable.select("*", F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("stable_role").over(w)).alias("from_role"))
    return prev.filter("from_role is not null").groupBy("from_role", F.col("stable_role").alias("to_role")).agg(F.count(F.lit(1)).alias("n"))
