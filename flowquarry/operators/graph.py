"""Graph, distribution, community and hub level, and supergraphs. Partitions are given as (node, grp); every operator takes any partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions.ranks import group_quantiles, top_sum, value_ranks
from flowquarry.operators.edges import incidence, ratio
from flowquarry.operators.flow import dyads


def scale(edges: DataFrame) -> DataFrame:
    """Per month: nodes, edges, totals, average ticket, density."""
    nodes = incidence(edges).groupBy("time_key").agg(F.count_distinct("node").alias("n_nodes"))
    e = edges.groupBy("time_key").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("cents").alias("cents"), F.sum("volume").alias("volume"))
    n = F.col("n_nodes")
    return e.join(nodes, "time_key").select("time_key", "n_nodes", "n_edges", "cents", "volume", ratio(F.col("cents") / F.lit(100.0), "volume").alias("avg_ticket"), F.round(F.when(n > 1, F.col("n_edges") / (n * (n - 1))), 9).alias("density"))


def graph_reciprocity(edges: DataFrame) -> DataFrame:
    """Per month: share of edges with a reverse edge, and of amount matched by it. A self-edge is its own reverse."""
    d = dyads(edges)
    own = F.col("a") == F.col("b")
    both = F.col("ab").isNotNull() & F.col("ba").isNotNull()
    n = F.when(own, 1).otherwise(F.col("ab").isNotNull().cast("int") + F.col("ba").isNotNull().cast("int"))
    back = F.when(own, 1).when(both, 2).otherwise(0)
    matched = F.when(own, F.col("ab")).when(both, F.least("ab", "ba") * 2).otherwise(0)
    return d.groupBy("time_key").agg(ratio(F.sum(back), F.sum(n)).alias("reciprocity_edges"), ratio(F.sum(matched), F.sum(F.coalesce("ab", F.lit(0)) + F.coalesce("ba", F.lit(0)))).alias("reciprocity_amount"))


def _moments(w, x, y):
    """Weighted correlation from sums; null without spread."""
    sw, sx, sy, sxx, syy, sxy = F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * y * y), F.sum(w * x * y)
    vx, vy = sw * sxx - sx * sx, sw * syy - sy * sy
    return F.when((vx > sw * sxx * 1e-10) & (vy > sw * syy * 1e-10), (sw * sxy - sx * sy) / F.sqrt(F.greatest(vx, F.lit(1e-300))) / F.sqrt(F.greatest(vy, F.lit(1e-300))))


def assortativity(edges: DataFrame, digits: int = 4) -> DataFrame:
    """Per month: amount-weighted correlation of log10(strength + 1) of payer and payee for the four pairs of sides, and the unweighted out-in one."""
    inc = incidence(edges)
    side = lambda d: F.round(F.log10(F.sum(F.when(F.col("dir") == d, F.col("cents")).otherwise(0)) / F.lit(100.0) + 1), 9)
    s = inc.groupBy("time_key", "node").agg(side("out").alias("o"), side("in").alias("i"))
    e = edges.join(s.select("time_key", F.col("node").alias("source"), F.col("o").alias("so"), F.col("i").alias("si")), ["time_key", "source"])
    e = e.join(s.select("time_key", F.col("node").alias("dest"), F.col("o").alias("to"), F.col("i").alias("ti")), ["time_key", "dest"])
    w = F.col("cents") / F.lit(100.0)
    pairs = {"out_in": ("so", "ti"), "out_out": ("so", "to"), "in_in": ("si", "ti"), "in_out": ("si", "to")}
    one = F.lit(1.0)
    return e.groupBy("time_key").agg(*[F.round(_moments(w, F.col(a), F.col(b)), digits).alias(f"assort_{k}") for k, (a, b) in pairs.items()], F.round(_moments(one, F.col("so"), F.col("ti")), digits).alias("assort_unweighted"))


def strength_degree_beta(edges: DataFrame) -> DataFrame:
    """Per month: slope, intercept and R2 of log strength on log degree over nodes with both above 0."""
    s = incidence(edges).groupBy("time_key", "node").agg(F.count(F.lit(1)).alias("k"), F.sum("cents").alias("c")).filter("c > 0")
    x, y = F.log("k"), F.log(F.col("c") / F.lit(100.0))
    return s.select("time_key", x.alias("x"), y.alias("y")).groupBy("time_key").agg(F.round(F.regr_slope("y", "x"), 4).alias("beta"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.regr_r2("y", "x"), 4).alias("r2"))


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n_positive, gini) over values above 0. The rank comes from sums over value groups, so equal values need no order."""
    r = value_ranks(df.filter(F.col(value) > 0).select(*keys, value), keys, value)
    # Equal values take the ranks before + 1 .. before + n, which sum to n * before + n (n + 1) / 2.
    weighted = (F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / F.lit(2.0)) * F.col(value)
    n, s = F.sum("n"), F.sum(F.col("n") * F.col(value)).cast("double")
    return r.groupBy(*keys).agg(n.alias("n_positive"), F.round((2 * F.sum(weighted) - (n + 1) * s) / (n * s), 6).alias("gini"))


def tail_stats(df: DataFrame, keys: list[str], value: str, tail: float = 0.05, least: int = 10, top: float = 0.001) -> DataFrame:
    """(keys, hill_alpha, top_share): Hill index over the largest max(floor(tail n), least) positive values, and the share of the largest ceil(top n)."""
    r = value_ranks(df.filter(F.col(value) > 0).select(*keys, value), keys, value)
    k = F.least(F.greatest(F.floor(F.col("total") * tail), F.lit(least)), F.col("total"))
    above = F.col("total") - F.col("before") - F.col("n")
    took = F.greatest(F.lit(0), F.least(F.col("n"), k - above))
    least_x = F.min(F.when(took > 0, F.col(value)))
    mean = F.sum(took * F.log(value)) / F.max(k) - F.log(least_x)
    most = F.greatest(F.ceil(F.col("total") * top), F.lit(1))
    return r.groupBy(*keys).agg(F.round(F.when(mean > 1e-12, 1 / mean), 4).alias("hill_alpha"), ratio(top_sum(r, keys, value, most), F.sum(F.col("n") * F.col(value))).alias("top_share"))


def rich_club(edges: DataFrame, share: float) -> DataFrame:
    """Per month: amount among the max(floor(share N), 2) strongest nodes over that of as many of the largest edges, and the amounts inside and touching the club."""
    s = incidence(edges).groupBy("time_key", "node").agg(F.sum("cents").alias("s"))
    r = value_ranks(s, ["time_key"], "s").withColumn("k", F.greatest(F.floor(F.col("total") * share), F.lit(2))).withColumn("above", F.col("total") - F.col("before") - F.col("n"))
    edge = s.join(r.filter("above < k").select("time_key", "s", "n", "k", "above"), ["time_key", "s"])
    # Nodes strictly above the edge are in; of those level with it, the first by name.
    tied = edge.filter("above + n > k").withColumn("r", F.row_number().over(Window.partitionBy("time_key").orderBy("node"))).filter("above + r <= k")
    rich = edge.filter("above + n <= k").select("time_key", "node").unionByName(tied.select("time_key", "node")).withColumn("rich", F.lit(1))
    e = edges.join(rich.select("time_key", F.col("node").alias("source"), F.col("rich").alias("rs")), ["time_key", "source"], "left").join(rich.select("time_key", F.col("node").alias("dest"), F.col("rich").alias("rd")), ["time_key", "dest"], "left")
    inside, touched = F.col("rs").isNotNull() & F.col("rd").isNotNull(), F.col("rs").isNotNull() | F.col("rd").isNotNull()
    club = e.groupBy("time_key").agg(F.count_if(inside).alias("n_in"), F.sum(F.when(inside, F.col("cents")).otherwise(0)).alias("in_cents"), F.sum(F.when(touched, F.col("cents")).otherwise(0)).alias("touched_cents"), F.sum("cents").alias("all_cents"))
    ranks = value_ranks(edges.select("time_key", "cents"), ["time_key"], "cents").join(club.select("time_key", "n_in"), "time_key")
    big = ranks.groupBy("time_key").agg(top_sum(ranks, ["time_key"], "cents", F.col("n_in")).alias("best"))
    return club.join(big, "time_key", "left").select("time_key", "n_in", ratio("in_cents", "best").alias("rich_club"), ratio("in_cents", "all_cents").alias("inside_share"), ratio("touched_cents", "all_cents").alias("touched_share"))


def strength_hhi_entropy(edges: DataFrame) -> DataFrame:
    """Per month: HHI of strength, and the Renyi-2 entropy of the undirected graph, -ln(tr L^2 / (tr L)^2)."""
    s = incidence(edges.filter("source <> dest")).groupBy("time_key", "node").agg((F.sum("cents") / F.lit(100.0)).alias("k"))
    hh = s.groupBy("time_key").agg(F.sum("k").alias("s1"), F.sum(F.col("k") * F.col("k")).alias("s2"))
    d = dyads(edges.filter("source <> dest")).groupBy("time_key").agg(F.sum(F.pow((F.coalesce("ab", F.lit(0)) + F.coalesce("ba", F.lit(0))) / F.lit(100.0), 2)).alias("w2"))
    tr2 = (F.col("s2") + 2 * F.col("w2")) / (F.col("s1") * F.col("s1"))
    return hh.join(d, "time_key").select("time_key", F.round(F.col("s2") / (F.col("s1") * F.col("s1")), 6).alias("strength_hhi"), F.round(-F.log(tr2), 6).alias("renyi2_entropy"))


def distribution(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, metric, ...): count, null and zero share, mean, deviation (population), extremes, corrected skewness, percentiles and Gini of positive values, of numeric columns in long form."""
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select(*keys, "v.*")
    n = F.count("x")
    skew = F.when((n > 2) & (F.stddev_pop("x") > 0), F.skewness("x") * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))
    out = rows.groupBy(*keys, "metric").agg(
        n.alias("n"), F.round(1 - n / F.count(F.lit(1)), 6).alias("null_share"), F.round(F.count_if(F.col("x") == 0) / F.when(n > 0, n), 6).alias("zero_share"),
        F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"), F.round(skew, 4).alias("skew"),
    )
    probs = {f"p{round(p * 100)}": p for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}
    cuts = group_quantiles(rows, [*keys, "metric"], "x", probs).select(*keys, "metric", *[F.round(c, 4).alias(c) for c in probs])
    return out.join(cuts, [*keys, "metric"], "left").join(gini(rows, [*keys, "metric"], "x").select(*keys, "metric", "gini"), [*keys, "metric"], "left")


# ---- communities


def labelled(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """The edges whose ends both have a group, with gs and gd."""
    a, b = partition.select(F.col("node").alias("source"), F.col("grp").alias("gs")), partition.select(F.col("node").alias("dest"), F.col("grp").alias("gd"))
    return edges.join(a, "source").join(b, "dest")


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Per month: modularity of the partition on the undirected amount-weighted graph of labelled nodes."""
    e = labelled(edges, partition)
    ends = e.select("time_key", "cents", F.explode(F.array(F.struct(F.col("gs").alias("g"), (F.col("gs") == F.col("gd")).alias("own")), F.struct(F.col("gd").alias("g"), (F.col("gs") == F.col("gd")).alias("own")))).alias("x")).select("time_key", "cents", "x.*")
    per = ends.groupBy("time_key", "g").agg(F.sum("cents").cast("double").alias("tot"), F.sum(F.when(F.col("own"), F.col("cents")).otherwise(0)).cast("double").alias("inn"))
    m2 = F.sum("tot").over(Window.partitionBy("time_key"))
    per = per.select("time_key", "g", (F.col("inn") / m2 - F.pow(F.col("tot") / m2, 2)).alias("q"))
    return per.groupBy("time_key").agg(F.count(F.lit(1)).alias("n_communities"), F.round(F.sum("q"), 6).alias("modularity"))


def community_table(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Per month and group: members active, edges and amounts inside, out and in, densities, mixing, conductance, shares, boundary members, matched share inside."""
    e = labelled(edges, partition)
    own = F.col("gs") == F.col("gd")
    ends = F.when(own, F.array(F.struct(F.col("gs").alias("grp"), F.lit("inside").alias("kind")))).otherwise(F.array(F.struct(F.col("gs").alias("grp"), F.lit("out").alias("kind")), F.struct(F.col("gd").alias("grp"), F.lit("in").alias("kind"))))
    flows = e.select("time_key", "cents", F.explode(ends).alias("x")).select("time_key", "cents", "x.*").groupBy("time_key", "grp").agg(
        *[f for k in ("inside", "out", "in") for f in (F.count_if(F.col("kind") == k).alias(f"n_{k}"), F.sum(F.when(F.col("kind") == k, F.col("cents")).otherwise(0)).alias(f"cents_{k}"))]
    )
    member = e.select("time_key", F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("gs").alias("grp"), (~own).alias("cross")), F.struct(F.col("dest").alias("node"), F.col("gd").alias("grp"), (~own).alias("cross")))).alias("x")).select("time_key", "x.*")
    size = member.groupBy("time_key", "grp", "node").agg(F.max("cross").alias("cross")).groupBy("time_key", "grp").agg(F.count(F.lit(1)).alias("n_members"), F.count_if("cross").alias("n_boundary"))
    inner = dyads(e.filter(own).withColumnRenamed("gs", "grp"), ("time_key", "grp"))
    mutual = inner.groupBy("time_key", "grp").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("ab")).otherwise(2 * F.coalesce(F.least(F.col("ab") + 0, F.col("ba") + 0) * (F.col("ab").isNotNull() & F.col("ba").isNotNull()).cast("int"), F.lit(0)))).alias("matched"))
    t = flows.join(size, ["time_key", "grp"]).join(mutual, ["time_key", "grp"], "left")
    c, n = F.col, F.col("n_members")
    whole = F.sum(2 * c("cents_inside") + c("cents_out") + c("cents_in")).over(Window.partitionBy("time_key"))
    outer = c("cents_out") + c("cents_in")
    volume = 2 * c("cents_inside") + outer
    return t.select(
        "time_key", "grp", "n_members", "n_inside", "n_out", "n_in", "cents_inside", "cents_out", "cents_in",
        F.round(F.when(n > 1, c("n_inside") / (n * (n - 1))), 9).alias("internal_density"),
        ratio(c("n_inside"), c("n_inside") + c("n_out") + c("n_in")).alias("mixing_edges"), ratio(c("cents_inside"), c("cents_inside") + outer).alias("mixing_amount"),
        F.round(F.when(F.least(volume, whole - volume) > 0, outer / F.least(volume, whole - volume)), 6).alias("conductance"),
        ratio(volume, whole).alias("amount_share"), ratio("n_boundary", "n_members").alias("boundary_fraction"), ratio(F.coalesce("matched", F.lit(0)), "cents_inside").alias("matched_share"),
    )


def supergraph(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Groups as nodes, in the base schema plus counts: (time_key, source, dest, cents, volume, n_edges, n_pairs, is_self). Flow within a group is a self-edge, so no amount is lost."""
    e = labelled(edges, partition)
    return e.groupBy("time_key", F.col("gs").alias("source"), F.col("gd").alias("dest")).agg(F.sum("cents").alias("cents"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_edges"), F.count_distinct("source", "dest").alias("n_pairs")).withColumn("is_self", F.col("source") == F.col("dest"))


def supergraph_nodes(edges: DataFrame, partition: DataFrame) -> DataFrame:
    s = incidence(supergraph(edges, partition).select("time_key", "source", "dest", "cents", "volume"))
    own = F.col("node") == F.col("cp")
    return s.groupBy("time_key", "node").agg(
        F.sum(F.when(own & (F.col("dir") == "out"), F.col("cents")).otherwise(0)).alias("internal_cents"),
        F.sum(F.when(~own & (F.col("dir") == "out"), F.col("cents")).otherwise(0)).alias("out_cents"),
        F.sum(F.when(~own & (F.col("dir") == "in"), F.col("cents")).otherwise(0)).alias("in_cents"),
        F.count_distinct(F.when(~own, F.col("cp"))).alias("n_partners"),
    )


def flow_matrix(edges: DataFrame, partition: DataFrame, groups: list[str]) -> DataFrame:
    """One row a paying group, one column a paid group, over the window."""
    s = supergraph(edges, partition)
    return s.groupBy("source").pivot("dest", groups).agg(F.sum("cents")).na.fill(0)


def partition_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, nmi, ari) of two partitions on the nodes both have."""
    m = a.select("node", F.col("grp").alias("a")).join(b.select("node", F.col("grp").alias("b")), "node")
    cell = m.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    c2 = lambda x: x * (x - 1) / F.lit(2.0)
    h = lambda x: F.sum(x * F.log(x.cast("double")))
    n = F.col("n")
    cells = cell.agg(F.sum("n").alias("t"), h(n).alias("hab"), F.sum(c2(n)).alias("cab"))
    side = lambda k: cell.groupBy(k).agg(F.sum("n").alias("n")).agg(h(n).alias(f"h{k}"), F.sum(c2(n)).alias(f"c{k}"))
    one = lambda k: side(k).agg(F.first(F.struct(f"h{k}", f"c{k}"))).scalar()
    x = cells.withColumns({"__a": one("a"), "__b": one("b")}).select("*", "__a.*", "__b.*")
    t = F.col("t").cast("double")
    ha, hb, hab = (F.log(t) - F.col(c) / t for c in ("ha", "hb", "hab"))
    mi = ha + hb - hab
    expected = F.col("ca") * F.col("cb") / c2(t)
    most = (F.col("ca") + F.col("cb")) / 2
    return x.select(F.col("t").alias("n"), F.round(F.when(ha + hb > 0, 2 * mi / (ha + hb)).otherwise(1.0), 6).alias("nmi"), F.round(F.when(most != expected, (F.col("cab") - expected) / (most - expected)).otherwise(1.0), 6).alias("ari"))


def _overlaps(groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes before, sizes after, overlaps with Jaccard) of each period t with the one before; ``groups`` is (t, node, grp)."""
    last, first = groups.agg(F.max("t")).scalar(), groups.agg(F.min("t")).scalar()
    a = groups.select((F.col("t") + 1).alias("t"), "node", F.col("grp").alias("x")).filter(F.col("t") <= last)
    b = groups.select("t", "node", F.col("grp").alias("y")).filter(F.col("t") > first)
    na, nb = a.groupBy("t", "x").agg(F.count(F.lit(1)).alias("nx")), b.groupBy("t", "y").agg(F.count(F.lit(1)).alias("ny"))
    both = a.join(b, ["t", "node"]).groupBy("t", "x", "y").agg(F.count(F.lit(1)).alias("n")).join(na, ["t", "x"]).join(nb, ["t", "y"])
    return na, nb, both.withColumn("jaccard", F.col("n") / (F.col("nx") + F.col("ny") - F.col("n")))


def lifecycle(groups: DataFrame, least: float = 0.3, growth: float = 1.2, shrink: float = 0.8) -> DataFrame:
    """(t, grp_before, grp_after, event) of each period against the one before, from ``groups`` (t, node, grp), t counting delivered periods.

    Split over merge over growth, shrinkage, continuation by a Jaccard overlap of at least ``least``; birth and death without any.
    """
    na, nb, both = _overlaps(groups)
    hit = both.filter(F.col("jaccard") >= least)
    hit = hit.withColumns({"splits": F.count(F.lit(1)).over(Window.partitionBy("t", "x")), "merges": F.count(F.lit(1)).over(Window.partitionBy("t", "y"))})
    r = F.col("ny") / F.col("nx")
    event = F.when(F.col("splits") > 1, "split").when(F.col("merges") > 1, "merge").when(r > growth, "growth").when(r < shrink, "shrinkage").otherwise("continuation")
    found = hit.select("t", F.col("x").alias("grp_before"), F.col("y").alias("grp_after"), event.alias("event"))
    null = F.lit(None).cast("string")
    born = nb.join(hit.select("t", "y").distinct(), ["t", "y"], "left_anti").select("t", null.alias("grp_before"), F.col("y").alias("grp_after"), F.lit("birth").alias("event"))
    died = na.join(hit.select("t", "x").distinct(), ["t", "x"], "left_anti").select("t", F.col("x").alias("grp_before"), null.alias("grp_after"), F.lit("death").alias("event"))
    return found.unionByName(born).unionByName(died)


def lifecycle_by_best(groups: DataFrame, match: float = 0.3, strong: float = 0.15) -> DataFrame:
    """(t, grp_before, grp_after, jaccard, event): the other matcher. Each group goes to its best successor (ties to the least name): continued, or split if several overlap by ``strong``, when the best reaches
    ``match``; merged when some only reach ``strong``; else died. Successors that no group goes to are born. A group none of whose nodes is left has no row.
    """
    _, nb, both = _overlaps(groups)
    top = F.struct(-F.col("jaccard"), F.col("y"))
    best = both.groupBy("t", "x").agg(F.min_by("y", top).alias("y"), F.max("jaccard").alias("jaccard"), F.count_if(F.col("jaccard") >= strong).alias("k"))
    event = F.when(F.col("jaccard") >= match, F.when(F.col("k") > 1, "split").otherwise("continued")).when(F.col("k") > 0, "merged").otherwise("died")
    found = best.select("t", F.col("x").alias("grp_before"), F.when(event != "died", F.col("y")).alias("grp_after"), F.round("jaccard", 6).alias("jaccard"), event.alias("event"))
    taken = found.filter("grp_after is not null").select("t", F.col("grp_after").alias("y")).distinct()
    born = nb.join(taken, ["t", "y"], "left_anti").select("t", F.lit(None).cast("string").alias("grp_before"), F.col("y").alias("grp_after"), F.lit(None).cast("double").alias("jaccard"), F.lit("born").alias("event"))
    return found.unionByName(born)


def hub_summary(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """Per month and hub: degrees, amounts, share of all amount (each edge counts at both ends), pairs of counterparties that share the hub."""
    inc = incidence(edges).join(hubs.select("node").distinct(), "node", "left_semi")
    total = edges.groupBy("time_key").agg(F.sum("cents").alias("all_cents"))
    h = inc.groupBy("time_key", "node").agg(
        F.count_if(F.col("dir") == "in").alias("n_in"), F.count_if(F.col("dir") == "out").alias("n_out"), F.sum(F.when(F.col("dir") == "in", F.col("cents")).otherwise(0)).alias("in_cents"), F.sum(F.when(F.col("dir") == "out", F.col("cents")).otherwise(0)).alias("out_cents"), F.count_distinct("cp").alias("n_cp")
    )
    n = F.col("n_cp")
    return h.join(total, "time_key").select("time_key", "node", "n_in", "n_out", "in_cents", "out_cents", ratio(F.col("in_cents") + F.col("out_cents"), 2 * F.col("all_cents")).alias("amount_share"), (n * (n - 1) / 2).cast("bigint").alias("co_pay_pairs"))
