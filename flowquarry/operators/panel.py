"""Balance panels: wide to long, activity, declines, event studies; role labels and peers over the node panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions.cleaning import month_index
from flowquarry.functions.ranks import group_quantiles, with_average_rank


def melt(wide: DataFrame, key: str, prefix: str = "bal_") -> DataFrame:
    """Columns ``prefix``YYYY_MM as rows (key, time_key, balance)."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.select(key, *cols).unpivot(key, cols, "name", "balance")
    return long.select(key, F.replace(F.substring("name", len(prefix) + 1, 7), F.lit("_"), F.lit("-")).alias("time_key"), "balance")


def widen(long: DataFrame, key: str, value: str, months: list[str], prefix: str = "bal_") -> DataFrame:
    """Rows as columns; the months are given, so no job looks for them."""
    w = long.groupBy(key).pivot("time_key", months).agg(F.sum(value))
    return w.withColumnsRenamed({m: prefix + m.replace("-", "_") for m in months})


def balance_features(panel: DataFrame, key: str, drop: float = -0.30, floor: float = 0.0) -> DataFrame:
    """Adds to a dense panel (key, time_key, balance): month index, activity bounds, one and three month changes, means of the last 3 and the 6 before them, running peak and drawdown, decline flag, event start and the first event.

    A decline compares full windows: mean of 3 months against that of the 6 before, below ``drop``, the earlier mean above ``floor``.
    """
    p = panel.withColumn("m", month_index("time_key"))
    w = Window.partitionBy(key).orderBy("m")
    active = F.when(F.col("balance") != 0, F.col("m"))
    late, early = w.rowsBetween(-2, 0), w.rowsBetween(-8, -3)
    p = p.withColumns(
        {
            "first_active": F.min(active).over(Window.partitionBy(key)),
            "last_active": F.max(active).over(Window.partitionBy(key)),
            "change_1": F.col("balance") - F.lag("balance").over(w),
            "change_3": F.col("balance") - F.lag("balance", 3).over(w),
            "mean_3": F.when(F.count("balance").over(late) == 3, F.avg("balance").over(late)),
            "mean_6": F.when(F.count("balance").over(early) == 6, F.avg("balance").over(early)),
            "peak": F.max("balance").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    p = p.withColumn("pct_change", F.when(F.col("mean_6") > floor, F.col("mean_3") / F.col("mean_6") - 1)).withColumn("drawdown", F.when(F.col("peak") > 0, 1 - F.col("balance") / F.col("peak")))
    p = p.withColumn("is_decline", F.coalesce(F.col("pct_change") <= drop, F.lit(False)))
    p = p.withColumn("event_start", F.col("is_decline") & ~F.coalesce(F.lag("is_decline").over(w), F.lit(False)))
    return p.withColumn("first_event", F.min(F.when(F.col("event_start"), F.col("m"))).over(Window.partitionBy(key)))


def model_features(panel: DataFrame, key: str, value: str) -> DataFrame:
    """Level, change, 3-month change, negative streak, 3-month mean, presence, with true-gap checks on the month index m."""
    w = Window.partitionBy(key).orderBy("m")
    x = F.col(value)
    gap = lambda k: F.when(F.lag("m", k).over(w) == F.col("m") - k, x - F.lag(value, k).over(w))
    p = panel.withColumns({"d1": gap(1), "d3": gap(3)})
    up = F.sum(F.when(F.coalesce(F.col("d1") < 0, F.lit(False)), 0).otherwise(1)).over(w)
    p = p.withColumn("__s", up)
    p = p.withColumn("negative_streak", F.sum(F.when(F.col("d1") < 0, 1).otherwise(0)).over(Window.partitionBy(key, "__s").orderBy("m")))
    late = w.rangeBetween(-2, 0)
    return p.withColumns({"mean_3": F.when(F.count(value).over(late) >= 2, F.avg(value).over(late)), "presence_6": F.count(value).over(w.rangeBetween(-5, 0))}).drop("__s")


def lead_lag(panel: DataFrame, key: str, x: str, y: str, most: int = 6) -> DataFrame:
    """(shift, n, r): correlation of x with y at m + shift, for shift -most..most, only across true gaps."""
    a = panel.select(key, "m", F.col(x).alias("x"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")).withColumn("m", F.col("m") + F.col("shift"))
    b = panel.select(key, "m", F.col(y).alias("y"))
    return a.join(b, [key, "m"]).filter("x is not null and y is not null").groupBy("shift").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 4).alias("r"))


def event_study(panel: DataFrame, key: str, value: str, before: int = 6, after: int = 3, guard: int = 6) -> DataFrame:
    """(offset, n_events, mean_event, n_controls, mean_control): value around first events against keys without any event within ``guard`` months of that month."""
    ev = panel.filter("event_start and m = first_event").select(key, F.col("m").alias("em"))
    grid = ev.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    x = panel.select(key, "m", F.col(value).alias("x"))
    hit = grid.withColumn("m", F.col("em") + F.col("offset")).join(x, [key, "m"]).groupBy("offset").agg(F.count("x").alias("n_events"), F.round(F.avg("x"), 4).alias("mean_event"))
    months = ev.groupBy("em").agg(F.count(F.lit(1)).alias("k"))
    near = panel.filter("event_start").select(key, F.explode(F.sequence(F.col("m") - guard, F.col("m") + guard)).alias("em")).distinct()
    # A control is a key present in an event month and free of events near it; it weighs as many times as that month has events.
    free = panel.select(key, F.col("m").alias("em")).join(months, "em").join(near, [key, "em"], "left_anti")
    ctl = free.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("m", F.col("em") + F.col("offset")).join(x, [key, "m"])
    ctl = ctl.filter("x is not null").groupBy("offset").agg(F.sum("k").alias("n_controls"), F.round(F.sum(F.col("x") * F.col("k")) / F.sum("k"), 4).alias("mean_control"))
    return hit.join(ctl, "offset", "left")


def tiers(df: DataFrame, value: str, n: int = 3) -> DataFrame:
    """Adds ``tier`` 1..n by exact cuts of the value (in place of an ntile over one window of all rows)."""
    from flowquarry.functions.stats import decile, quantile_cuts

    return df.withColumn("tier", (decile(F.col(value), quantile_cuts(df, value, n), n) + 1).cast("int"))


# ---- roles


#: Nodes with fewer counterparties are a thin file: what they lose or hold most of says little.
THIN = 3


def _with(metrics: DataFrame, keys: list[str], value: str, probs: dict[str, float], only: Column | None = None) -> DataFrame:
    """Adds quantiles of a group; null where it has no values. Groups are months and versions, so their table is small."""
    at = group_quantiles(metrics if only is None else metrics.filter(only), keys, value, probs)
    return metrics.join(at, keys, "left")


def flow_roles(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Adds flow_role by ordered rules; the 90th percentile of throughflow and the median of reciprocity are those of each group of ``keys`` (month, version)."""
    m = _with(_with(metrics, keys, "throughflow", {"__tf90": 0.9}), keys, "reciprocity_amount_share", {"__rec50": 0.5})
    f = F.col("flow_ratio")
    role = (
        F.when((F.col("in_cents") > 0) != (F.col("out_cents") > 0), "one_sided")
        .when((F.abs(f) <= 0.15) & (F.col("throughflow") >= F.col("__tf90")), "conduit")
        .when(f > 0.5, "collector")
        .when(f < -0.5, "distributor")
        .when((F.abs(f) <= 0.15) & (F.col("reciprocity_amount_share") >= F.col("__rec50")), "trader")
        .otherwise("mixed")
    )
    return m.withColumn("flow_role", role).drop("__tf90", "__rec50")


def hierarchy_roles(metrics: DataFrame, keys: list[str], level: str = "trophic_level") -> DataFrame:
    """Adds hierarchy_role by terciles of the trophic level within each group of ``keys``."""
    m = _with(metrics, keys, level, {"__lo": 1 / 3, "__hi": 2 / 3})
    v = F.col(level)
    role = F.when(v.isNull() | F.isnan(v), "unknown").when(v <= F.col("__lo"), "upstream_supplier").when(v >= F.col("__hi"), "downstream_buyer").otherwise("midstream")
    return m.withColumn("hierarchy_role", role).drop("__lo", "__hi")


def dependence_roles(metrics: DataFrame) -> DataFrame:
    """Adds dependence_role. Nodes below the medians of HHI on both sides are balanced, and so are all others that no rule takes, so the medians need not be known."""
    over = lambda c: F.coalesce(F.col(c), F.lit(0.0)) > 0.7
    role = F.when(F.col("degree") < THIN, "single_relationship").when(over("hub_in_share"), "infra_dependent").when(over("top1_in") | over("top1_out"), "concentrated").otherwise("balanced")
    return metrics.withColumn("dependence_role", role)


def embeddedness_roles(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Adds embeddedness_role from degree, core, participation_coef and frac_intra_amount; core quartile and 90th percentile are those of the group's nodes with ``THIN`` counterparties or more.

    Thin files come first, as the only edge of a node is trivially within its group; the upper limit is strict, as cores are whole numbers that tie.
    """
    m = _with(metrics, keys, "core", {"__lo": 0.25, "__hi": 0.9}, F.col("degree") >= THIN)
    local = F.col("frac_intra_amount") >= 0.7
    role = F.when((F.col("degree") < THIN) | (F.col("core") <= F.col("__lo")), "peripheral").when(F.col("participation_coef") >= 0.62, "connector").when(local, "embedded").otherwise("intermediate")
    return m.withColumn("embeddedness_role", role).drop("__lo", "__hi")


def dynamics_roles(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Adds dynamics_role from months_since_first_seen, activity_gap, in_degree, prior_in_degree, payer_jaccard, strength_mom, lost_amount_share and new_amount_share.

    A node bleeds only with ``THIN`` payers the month before, and expands only with as many now: losing one of two is no bleeding. Quartile and median of the
    payers' Jaccard are those of each group of ``keys``. What is null meets no condition; null shares count as 0.
    """
    m = _with(metrics, keys, "payer_jaccard", {"__lo": 0.25, "__mid": 0.5})
    lost, new, mom, pj = F.coalesce("lost_amount_share", F.lit(0.0)), F.coalesce("new_amount_share", F.lit(0.0)), F.col("strength_mom"), F.col("payer_jaccard")
    role = (
        F.when(F.col("months_since_first_seen") <= 2, "newcomer")
        .when(F.col("activity_gap") > 1, "intermittent")
        .when((F.col("prior_in_degree") >= THIN) & ((lost >= 0.4) | ((mom <= -0.3) & (pj <= F.col("__lo")))), "bleeding")
        .when((F.col("in_degree") >= THIN) & (new >= 0.4) & (mom > 0.1), "expanding")
        .when((pj >= F.col("__mid")) & (F.abs(mom) < 0.35), "steady")
        .otherwise("variable")
    )
    return m.withColumn("dynamics_role", role).drop("__lo", "__mid")


def tercile_classes(metrics: DataFrame, keys: list[str], value: str, names: tuple[str, str, str], out: str) -> DataFrame:
    """Adds ``out``: the third of its group that a value falls into; null stays null."""
    m = _with(metrics, keys, value, {"__lo": 1 / 3, "__hi": 2 / 3})
    v = F.col(value)
    return m.withColumn(out, F.when(v.isNull(), None).when(v <= F.col("__lo"), names[0]).when(v <= F.col("__hi"), names[1]).otherwise(names[2])).drop("__lo", "__hi")


def peer_percentiles(metrics: DataFrame, by: list[str], levels: list[str], values: list[str], least: int = 30) -> DataFrame:
    """Adds peer_level, peer_key and pct_<value>: rank among the rows that choose the same peer group, the finest of ``levels`` with at least ``least`` rows; null without one."""
    m = metrics
    for lv in levels:
        sizes = metrics.filter(F.col(lv).isNotNull()).groupBy(*by, lv).agg(F.count(F.lit(1)).alias(f"__n_{lv}"))
        m = m.join(sizes, [*by, lv], "left")
    level, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lv in reversed(levels):
        big = F.col(f"__n_{lv}") >= least
        level, key = F.when(big, F.lit(lv)).otherwise(level), F.when(big, F.col(lv)).otherwise(key)
    m = m.withColumn("peer_level", level).withColumn("peer_key", key)
    group = [*by, "peer_level", "peer_key"]
    for v in values:
        m = with_average_rank(m, group, v, "__r", "__p").withColumn(f"pct_{v}", F.when(F.col("peer_level").isNotNull(), F.round("__p", 6))).drop("__r", "__p")
    return m.drop(*[f"__n_{lv}" for lv in levels])


def queue(df: DataFrame, cond: Column, order: list[Column], headline: Column, n: int = 30) -> DataFrame:
    """The top n rows (a report) that meet a condition, with a headline."""
    return df.filter(cond).orderBy(*order).limit(n).withColumn("headline", headline)


def money(dollars: Column) -> Column:
    """Dollars as text: $1.2M, $3.4K, $56."""
    a = F.abs(dollars)
    sign = F.when(dollars < 0, "-").otherwise("")
    # Whole tenths are made before the text, so that halves round one way everywhere.
    tenths = lambda x: F.concat(F.floor(x).cast("string"), F.lit("."), (F.floor(x * 10) % 10).cast("string"))
    body = F.when(a >= 1e9, F.concat(tenths(a / 1e9), F.lit("B"))).when(a >= 1e6, F.concat(tenths(a / 1e6), F.lit("M"))).when(a >= 1e3, F.concat(tenths(a / 1e3), F.lit("K"))).otherwise(F.floor(a).cast("string"))
    return F.concat(sign, F.lit("$"), body)
