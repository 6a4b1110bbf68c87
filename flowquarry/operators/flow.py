"""Node metrics of one hop: degrees, strengths, concentration, reciprocity, composition, hub exposure.

``edges`` is the relation of ``edges.payments``; results have one row for each month and node with an edge in that month. What is undefined is
null, never 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.operators.edges import incidence, no_self, ratio
from flowquarry.operators.skew import top_k

KEY = ["time_key", "node"]


def _side(d: str, c: str):
    return F.sum(F.when(F.col("dir") == d, F.col(c)).otherwise(0))


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree (different counterparties), strength and volume; degree; different neighbours of either side."""
    inc = incidence(edges)
    out = inc.groupBy(*KEY).agg(
        F.count_if(F.col("dir") == "in").alias("in_degree"),
        F.count_if(F.col("dir") == "out").alias("out_degree"),
        _side("in", "cents").alias("in_cents"),
        _side("out", "cents").alias("out_cents"),
        _side("in", "volume").alias("in_volume"),
        _side("out", "volume").alias("out_volume"),
        F.count_distinct("cp").alias("n_neighbors"),
    )
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def flows(edges: DataFrame) -> DataFrame:
    """Degrees with strength, net flow, flow ratio (0 without strength), throughflow, log strength and average tickets, in dollars."""
    i, o = F.col("in_cents"), F.col("out_cents")
    s = i + o
    return degrees(edges).select(
        "*",
        (s / F.lit(100.0)).alias("strength"),
        ((i - o) / F.lit(100.0)).alias("net_flow"),
        F.coalesce(ratio(i - o, s), F.lit(0.0)).alias("flow_ratio"),
        (F.least(i, o) / F.lit(100.0)).alias("throughflow"),
        F.round(F.log1p(s / F.lit(100.0)), 6).alias("log_strength"),
        ratio(i / F.lit(100.0), "in_volume").alias("avg_in_ticket"),
        ratio(o / F.lit(100.0), "out_volume").alias("avg_out_ticket"),
    )


def flow_variants(edges: DataFrame) -> DataFrame:
    """Older forms: in share of strength, pass-through index min/max, asymmetry, pass-through score 1 - |net| / strength."""
    i, o = F.col("in_cents"), F.col("out_cents")
    return degrees(edges).select(
        *KEY,
        ratio(i, i + o).alias("in_share"),
        ratio(F.least(i, o), F.greatest(i, o)).alias("pass_through_index"),
        ratio(i - o, i + o).alias("in_out_asymmetry"),
        F.round(F.lit(1.0) - ratio(F.abs(i - o), i + o, 12), 6).alias("passthrough_score"),
    )


def concentration(edges: DataFrame, salts: int = 16) -> DataFrame:
    """For each side: HHI, largest and three largest counterparties' shares, entropy (nats); null for an empty side or one without amount.

    All but the three largest come from sums that combine before the shuffle. The three largest are first taken within salts of the counterparty, so a hub's
    edges are never ranked in one task.
    """
    inc = incidence(edges)
    c = F.col("cents").cast("double")
    sums = inc.groupBy(*KEY, "dir").agg(F.sum("cents").alias("s"), F.sum(c * c).alias("ss"), F.max("cents").alias("top"), F.sum(F.when(c > 0, c * F.log(c)).otherwise(0.0)).alias("cl"))
    best = top_k(inc.select(*KEY, "dir", "cp", "cents"), [*KEY, "dir"], [F.desc("cents"), F.col("cp")], 3, "cp", salts).groupBy(*KEY, "dir").agg(F.sum("cents").alias("top3"))
    s = F.col("s").cast("double")
    some = F.col("s") > 0
    x = sums.join(best, [*KEY, "dir"]).select(
        *KEY, "dir",
        F.round(F.when(some, F.col("ss") / (s * s)), 6).alias("hhi"), F.round(F.when(some, F.col("top") / s), 6).alias("top1"), F.round(F.when(some, F.col("top3") / s), 6).alias("top3"),
        F.round(F.when(some, F.greatest(F.lit(0.0), F.log(s) - F.col("cl") / s)), 6).alias("entropy"),
    )
    names = ("hhi", "top1", "top3", "entropy")
    return x.groupBy(*KEY).agg(*[F.max(F.when(F.col("dir") == d, F.col(n))).alias(f"{n}_{d}") for d in ("in", "out") for n in names])


def dyads(edges: DataFrame, keys: tuple[str, ...] = ("time_key",)) -> DataFrame:
    """One row for each unordered pair: a < b (or a = b), the cents each way. A grouping, so no self join is needed."""
    a, b = F.least("source", "dest"), F.greatest("source", "dest")
    forth = F.col("source") <= F.col("dest")
    return edges.groupBy(*keys, a.alias("a"), b.alias("b")).agg(F.sum(F.when(forth, F.col("cents"))).alias("ab"), F.sum(F.when(~forth, F.col("cents"))).alias("ba"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """Per node: share of its amount that is matched the other way, sum min / sum max, and share of neighbours that pay both ways. Self-edges are their own reverse."""
    d = dyads(edges)
    x, y = F.coalesce("ab", F.lit(0)), F.coalesce("ba", F.when(F.col("a") == F.col("b"), F.col("ab")).otherwise(0))
    both = d.select("time_key", "a", "b", F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"), (F.col("a") == F.col("b")).alias("own"))
    ends = F.when(F.col("own"), F.array("a")).otherwise(F.array("a", "b"))
    per = both.select("time_key", F.explode(ends).alias("node"), "lo", "hi")
    return per.groupBy(*KEY).agg(
        ratio(F.sum("lo"), F.sum(F.col("lo") + F.col("hi"))).alias("reciprocity_amount_share"),
        ratio(F.sum("lo"), F.sum("hi")).alias("reciprocity_min_max"),
        ratio(F.count_if(F.col("lo") > 0), F.count(F.lit(1))).alias("reciprocated_neighbors"),
    )


def intra_fractions(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Share of a node's edges, and of its amount, within its own group. ``partition`` is (node, grp); nodes without a group are in none."""
    own, other = partition.select("node", F.col("grp").alias("g")), partition.select(F.col("node").alias("cp"), F.col("grp").alias("h"))
    inc = incidence(edges).join(own, "node", "left").join(other, "cp", "left")
    same = F.coalesce(F.col("g") == F.col("h"), F.lit(False))
    return inc.groupBy(*KEY).agg(ratio(F.count_if(same), F.count(F.lit(1))).alias("frac_intra_edges"), ratio(F.sum(F.when(same, F.col("cents")).otherwise(0)), F.sum("cents")).alias("frac_intra_amount"))


def participation(edges: DataFrame, partition: DataFrame, unknown: str = "NA") -> DataFrame:
    """Participation coefficient, within-group z score (sample deviation, 0 without spread) and the role R1 to R7 from both."""
    groups = partition.select("node", F.coalesce("grp", F.lit(unknown)).alias("grp"))
    inc = incidence(edges).select("time_key", "node", "cp")
    inc = inc.join(groups.select("node", F.col("grp").alias("g")), "node", "left").join(groups.select(F.col("node").alias("cp"), F.col("grp").alias("h")), "cp", "left")
    inc = inc.withColumns({"g": F.coalesce("g", F.lit(unknown)), "h": F.coalesce("h", F.lit(unknown))})
    per = inc.groupBy(*KEY, "g", "h").agg(F.count(F.lit(1)).alias("k"))
    node = per.groupBy(*KEY, "g").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.sum(F.when(F.col("g") == F.col("h"), F.col("k")).otherwise(0)).alias("ki"))
    spread = node.groupBy("time_key", "g").agg(F.avg("ki").alias("mean"), F.stddev_samp("ki").alias("sd"))
    node = node.join(spread, ["time_key", "g"])
    z = F.when(F.col("sd") > 0, (F.col("ki") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    out = node.select(*KEY, F.round(F.lit(1.0) - F.col("kk") / (F.col("k") * F.col("k")), 6).alias("participation_coef"), F.round(z, 6).alias("within_module_z"))
    c, hub = F.col("participation_coef"), F.col("within_module_z") >= 2.5
    role = F.when(hub, F.when(c <= 0.30, "R5").when(c <= 0.75, "R6").otherwise("R7")).otherwise(F.when(c <= 0.05, "R1").when(c <= 0.62, "R2").when(c <= 0.80, "R3").otherwise("R4"))
    return out.withColumn("ga_role", role)


def homophily(edges: DataFrame, sector: DataFrame) -> DataFrame:
    """Share of in and out amount with known-sector counterparties that is of the node's own sector; 0 where the own sector is unknown. ``sector`` is (node, sector)."""
    own, other = sector.select("node", F.col("sector").alias("g")), sector.select(F.col("node").alias("cp"), F.col("sector").alias("h"))
    inc = incidence(edges).join(own, "node", "left").join(other, "cp", "left")
    same = F.coalesce(F.col("g") == F.col("h"), F.lit(False))

    def share(d: str):
        known = (F.col("dir") == d) & F.col("h").isNotNull()
        return ratio(F.sum(F.when(known & same, F.col("cents")).otherwise(0)), F.sum(F.when(known, F.col("cents")).otherwise(0))).alias(f"same_sector_{d}_share")

    return inc.groupBy(*KEY).agg(share("in"), share("out"))


def hub_exposure(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """Share of in and out amount whose counterparty is a hub, on the raw graph. ``hubs`` is (node)."""
    marked = incidence(edges).join(hubs.select(F.col("node").alias("cp"), F.lit(True).alias("hub")).distinct(), "cp", "left")

    def share(d: str):
        side = F.col("dir") == d
        return ratio(F.sum(F.when(side & F.col("hub"), F.col("cents")).otherwise(0)), F.sum(F.when(side, F.col("cents")).otherwise(0))).alias(f"hub_{d}_share")

    return marked.groupBy(*KEY).agg(share("in"), share("out"))


# Node types and the short names that their columns carry.
CATEGORIES = {"individual": "individual", "business_naics_valid": "biz_valid", "business_naics_placeholder": "biz_placeholder", "business_naics_missing": "biz_missing", "unknown": "unknown", "hub": "hub"}


def composition(edges: DataFrame, category: DataFrame) -> DataFrame:
    """Per side and category, share of different counterparties and of amount; self-edges out; a side without edges is null. ``category`` is (node, category)."""
    inc = incidence(no_self(edges)).join(category.select(F.col("node").alias("cp"), "category"), "cp", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    aggs = []
    for d in ("in", "out"):
        side = F.col("dir") == d
        n, a = F.count_if(side), F.sum(F.when(side, F.col("cents")).otherwise(0))
        for category_name, c in CATEGORIES.items():
            hit = side & (F.col("category") == category_name)
            aggs += [ratio(F.count_if(hit), n).alias(f"share_{d}_cp_{c}"), ratio(F.sum(F.when(hit, F.col("cents")).otherwise(0)), a).alias(f"share_{d}_amt_{c}")]
    return inc.groupBy(*KEY).agg(*aggs)


def sector_mix(edges: DataFrame, sector: DataFrame, least: int = 5) -> DataFrame:
    """Per side over counterparties of known sector: their number, different sectors, entropy (bits) and top share of amount; null below ``least`` of them."""
    inc = incidence(no_self(edges)).join(sector.select(F.col("node").alias("cp"), "sector").filter("sector is not null"), "cp")
    per = inc.groupBy(*KEY, "dir", "sector").agg(F.sum("cents").alias("a"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*KEY, "dir")
    p = F.col("a") / F.when(F.sum("a").over(w) > 0, F.sum("a").over(w))
    per = per.select(*KEY, "dir", "n", p.alias("p"))
    enough = F.sum("n") >= least
    return per.groupBy(*KEY, "dir").agg(
        F.sum("n").alias("n_known_cp"),
        F.when(enough, F.count(F.lit(1))).alias("n_sectors"),
        F.round(F.when(enough, -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))), 6).alias("sector_entropy"),
        F.round(F.when(enough, F.max("p")), 6).alias("sector_top_share"),
    )
