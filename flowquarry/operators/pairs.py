"""Two-way relationships: bilateral pairs, their score, gates and tiers, seeds, intermediaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.edges import incidence, no_self, ratio
from flowquarry.operators.skew import top_k


def select_seeds(parties: DataFrame, prefixes: list[str], name_pattern: str, exclude_pattern: str | None = None) -> DataFrame:
    """(node, seed_reason): by sector prefix, by name, or both; a name of the exclusion counts only with the sector."""
    by_code = F.lit(False)
    for p in prefixes:
        by_code = by_code | F.coalesce(F.col("naics_cd").startswith(p) & (F.col("naics_status") == "valid"), F.lit(False))
    name = F.upper(F.coalesce("cust_name", F.lit("")))
    by_name = name.rlike(name_pattern)
    if exclude_pattern:
        by_name = by_name & (~name.rlike(exclude_pattern) | by_code)
    reason = F.when(by_code & by_name, "sector_and_name").when(by_code, "sector").when(by_name, "name")
    return parties.select("node", reason.alias("seed_reason")).filter("seed_reason is not null")


def seed_roles(parties: DataFrame, degree: DataFrame, core: list[str], adjacent: list[str], name_pattern: str, most: int = 5000) -> DataFrame:
    """(node, seed_role, degree, expands): by six-digit sector core_insurer or claims_adjacent, else by name name_match_only. Seeds with a degree above ``most`` stay seeds, but their neighbours are not drawn in.

    ``degree`` is (node, degree); a party without one has 0.
    """
    code = F.substring("naics_cd", 1, 6)
    by_name = F.upper(F.coalesce("cust_name", F.lit(""))).rlike(name_pattern)
    role = F.when(code.isin(core), "core_insurer").when(code.isin(adjacent), "claims_adjacent").when(by_name, "name_match_only")
    seeds = parties.select("node", role.alias("seed_role")).filter("seed_role is not null").join(degree.select("node", "degree"), "node", "left")
    k = F.coalesce("degree", F.lit(0))
    return seeds.select("node", "seed_role", k.alias("degree"), (k <= most).alias("expands"))


def entity_class(name: Column, code: Column, rules: dict[str, tuple[str, str]]) -> Column:
    """The first class whose name pattern fits and whose sector isn't contradicted by another class' sector prefix, else by sector alone, else other."""
    n, c = F.upper(F.coalesce(name, F.lit(""))), F.coalesce(code, F.lit(""))
    out = F.lit("other")
    for cls, (_, prefix) in reversed(rules.items()):
        out = F.when(c.startswith(prefix), cls).otherwise(out)
    for cls, (pattern, _) in reversed(rules.items()):
        others = F.lit(False)
        for other, (_, prefix) in rules.items():
            if other != cls:
                others = others | c.startswith(prefix)
        out = F.when(n.rlike(pattern) & ~others, cls).otherwise(out)
    return out


def ego(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in ``nodes`` (node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "dest"), "dest", "left_semi").select(*edges.columns)


def bilateral(edges: DataFrame) -> DataFrame:
    """Per unordered pair over the window, self-edges out: cents each way, gross, net, reciprocity lo / hi, netting ratio, months with either, with both and with each way, ticket, CV of monthly amounts and of each way's (null below two months)."""
    a, b = F.least("source", "dest"), F.greatest("source", "dest")
    forth = F.col("source") < F.col("dest")
    m = no_self(edges).groupBy(a.alias("a"), b.alias("b"), "time_key").agg(F.sum(F.when(forth, F.col("cents")).otherwise(0)).alias("ab"), F.sum(F.when(~forth, F.col("cents")).otherwise(0)).alias("ba"), F.count_distinct(forth).alias("ways"), F.max(forth).alias("forth"), F.max(~forth).alias("back"), F.sum("volume").alias("volume"))
    x = (F.col("ab") + F.col("ba")) / F.lit(100.0)
    there = {"ab": F.col("forth"), "ba": F.col("back")}
    way = lambda c: F.when(there[c], F.col(c) / F.lit(100.0))
    cv = lambda c: F.round(F.stddev_samp(way(c)) / F.when(F.avg(way(c)) > 0, F.avg(way(c))), 6).alias(f"cv_{c}")
    p = m.groupBy("a", "b").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"), F.count(F.lit(1)).alias("n_months"), F.count_if(F.col("ways") == 2).alias("n_both"), F.sum("volume").alias("volume"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.when(F.avg(x) > 0, F.avg(x)), 6).alias("cv"), *[F.count_if(there[c]).alias(f"months_{c}") for c in ("ab", "ba")], *[cv(c) for c in ("ab", "ba")])
    lo, hi = F.least("ab", "ba"), F.greatest("ab", "ba")
    return p.select("a", "b", "ab", "ba", (F.col("ab") + F.col("ba")).alias("gross"), (F.col("ab") - F.col("ba")).alias("net"), ratio(lo, hi).alias("reciprocity"), ratio(2 * lo, lo + hi).alias("netting_ratio"), "n_months", "n_both", "volume", ratio((F.col("ab") + F.col("ba")) / F.lit(100.0), "volume").alias("ticket"), "cv", "months_ab", "months_ba", "cv_ab", "cv_ba")


# The weights of the parts of the score.
WEIGHTS = {"persistence": 0.30, "reciprocity": 0.30, "steadiness": 0.10, "ticket_fit": 0.20, "volume_fit": 0.10}


def score_pairs(pairs: DataFrame, n_months: int, ticket_lo: float = 1_000.0, ticket_hi: float = 100_000.0, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1) to ``bilateral``: the weighted parts, halved for pairs that pay one way only.

    Persistence is the share of months in which the more frequent way is there; steadiness 1 / (1 + cv), cv the mean of both ways' (1 where neither is known); the ticket's fit a
    Gaussian of its decimal logarithm about the middle of the band from ``ticket_lo`` to ``ticket_hi``, half its width wide (0 without a ticket); the volume's fit its
    decimal logarithm, a thousand payments being enough.
    """
    w = WEIGHTS | (weights or {})
    cv = F.coalesce((F.col("cv_ab") + F.col("cv_ba")) / 2, "cv_ab", "cv_ba", F.lit(1.0))
    lo, hi = math.log10(ticket_lo), math.log10(ticket_hi)
    off = (F.log10(F.when(F.col("ticket") > 0, F.col("ticket"))) - (lo + hi) / 2) / ((hi - lo) / 2)
    parts = {
        "persistence": F.least(F.greatest("months_ab", "months_ba") / F.lit(float(n_months)), F.lit(1.0)),
        "reciprocity": F.coalesce("reciprocity", F.lit(0.0)),
        "steadiness": 1 / (1 + cv),
        "ticket_fit": F.coalesce(F.exp(-off * off), F.lit(0.0)),
        "volume_fit": F.least(F.log10(F.greatest("volume", F.lit(1))) / 3.0, F.lit(1.0)),
    }
    score = F.lit(0.0)
    for name, part in parts.items():
        score = score + F.lit(w[name]) * part
    return pairs.withColumn("score", F.round(score * F.when((F.col("ab") > 0) & (F.col("ba") > 0), 1.0).otherwise(0.5), 6))


def gates(pairs: DataFrame, n_months: int, steps: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(survivors, log): the pairs that pass all steps in turn, and (position, stage, n_kept, n_dropped) of each, from one pass."""
    kept, aggs, before = F.lit(True), [], F.count(F.lit(1))
    for i, (name, cond) in enumerate(steps.items()):
        kept = kept & F.coalesce(cond, F.lit(False))
        n = F.count_if(kept)
        aggs.append(F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("stage"), n.alias("n_kept"), (before - n).alias("n_dropped")))
        before = n
    log = pairs.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return pairs.filter(kept), log


def tier(pairs: DataFrame, class_a: str = "class_a", class_b: str = "class_b") -> Column:
    """A both ways and persistent between two classes of interest, B both ways, C one way; X with one class only, D without."""
    one, two = F.col(class_a) != "other", F.col(class_b) != "other"
    both = (F.col("ab") > 0) & (F.col("ba") > 0)
    return F.when(one & two, F.when(both & (F.col("n_both") >= 3), "A").when(both, "B").otherwise("C")).when(one | two, "X").otherwise("D")


def shared_counterparties(edges: DataFrame, seeds: DataFrame, least: int = 2) -> DataFrame:
    """(cp, n_seeds, cents) of counterparties that deal with at least ``least`` different seeds, from a grouping, never from pairs of seeds."""
    inc = incidence(no_self(edges)).join(seeds.select("node").distinct(), "node", "left_semi")
    return inc.groupBy("cp").agg(F.count_distinct("node").alias("n_seeds"), F.sum("cents").alias("cents")).filter(F.col("n_seeds") >= least)


def intermediaries(edges: DataFrame, seeds: DataFrame, least: int = 2, balance: float = 0.3) -> DataFrame:
    """(node, n_payers, n_payees, in_cents, out_cents, balance): nodes paid by and paying at least ``least`` seeds each, with lo / hi of the amounts at least ``balance``."""
    s = seeds.select(F.col("node").alias("cp")).distinct()
    inc = incidence(no_self(edges)).join(s, "cp", "left_semi")
    i, o = F.col("dir") == "in", F.col("dir") == "out"
    n = inc.groupBy("node").agg(F.count_distinct(F.when(i, F.col("cp"))).alias("n_payers"), F.count_distinct(F.when(o, F.col("cp"))).alias("n_payees"), F.sum(F.when(i, F.col("cents")).otherwise(0)).alias("in_cents"), F.sum(F.when(o, F.col("cents")).otherwise(0)).alias("out_cents"))
    n = n.withColumn("balance", ratio(F.least("in_cents", "out_cents"), F.greatest("in_cents", "out_cents")))
    return n.filter((F.col("n_payers") >= least) & (F.col("n_payees") >= least) & (F.col("balance") >= balance))


def sector_profile(edges: DataFrame, seeds: DataFrame, sector: DataFrame) -> DataFrame:
    """(dir, sector, n_cp, cents, share) of the seeds' counterparties; unknown sectors as NA."""
    inc = incidence(no_self(edges)).join(seeds.select("node").distinct(), "node", "left_semi").join(sector.select(F.col("node").alias("cp"), "sector"), "cp", "left")
    g = inc.groupBy("dir", F.coalesce("sector", F.lit("NA")).alias("sector")).agg(F.count_distinct("cp").alias("n_cp"), F.sum("cents").alias("cents"))
    from pyspark.sql.window import Window

    return g.withColumn("share", ratio("cents", F.sum("cents").over(Window.partitionBy("dir"))))


def capped_edges(edges: DataFrame, most: int) -> DataFrame:
    """For drawing: at most ``most`` of the largest edges at each paying node, over the window."""
    s = edges.groupBy("source", "dest").agg(F.sum("cents").alias("cents"))
    return top_k(s, ["source"], [F.desc("cents"), F.col("dest")], most, "dest")


def export_graph(edges: DataFrame, most: int, attributes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) for other tools: at most ``most`` of the largest edges at each paying node, and their ends with ``attributes`` (node, ...)."""
    kept = capped_edges(edges, most)
    ends = kept.select(F.explode(F.array("source", "dest")).alias("node")).distinct()
    return (ends if attributes is None else ends.join(attributes, "node", "left")), kept


def node_budget(pairs: DataFrame, budget: int, order: list[Column]) -> list[tuple[str, str]]:
    """Greedy choice, best first, of pairs until ``budget`` different nodes are taken; a pair that needs more is passed over. For drawing.

    While two places are left no pair is passed over, so the best budget^2 pairs reach that point. The last place goes to the best pair that needs one. Then every pair
    among the nodes taken is chosen and no other; the driver never holds more than budget^2 pairs.
    """
    taken: set[str] = set()
    for a, b in pairs.orderBy(*order).select("a", "b").limit(budget * budget).collect():
        if budget - len(taken | {a, b}) >= 0:
            taken |= {a, b}
        if budget - len(taken) < 2:
            break
    a, b = F.col("a"), F.col("b")
    if budget - len(taken) == 1:
        one = (a.isin(list(taken)) != b.isin(list(taken))) | ((a == b) & ~a.isin(list(taken)))
        for r in pairs.filter(one).orderBy(*order).select("a", "b").limit(1).collect():
            taken |= {r["a"], r["b"]}
    among = pairs.filter(a.isin(list(taken)) & b.isin(list(taken)))
    return [tuple(r) for r in among.orderBy(*order).select("a", "b").limit(budget * budget).collect()]

