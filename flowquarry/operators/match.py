"""Matching the names of payer and payee: normal forms, tiers, score bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.functions.similarity import jaro_winkler

# Fixed value: legal suffixes.
SUFFIXES = ("incorporated", "inc", "corporation", "corp", "company", "co", "limited", "ltd", "llc", "llp", "lp", "pllc", "plc", "trust", "holdings", "group", "cooperative", "partners lp", "and sons")
_TAIL = " (" + "|".join(sorted(SUFFIXES, key=len, reverse=True)) + ")$"


def _base(name: Column) -> Column:
    t = F.replace(F.replace(F.lower(name), F.lit("."), F.lit("")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9 ]", " "), r" +", " "))


def normal_name(name: Column) -> Column:
    """Lower case, without points, special characters as blanks, blanks folded, one legal suffix taken off; blank gives null."""
    return F.nullif(F.regexp_replace(_base(name), _TAIL, ""), F.lit(""))


def name_suffix(name: Column) -> Column:
    return F.nullif(F.regexp_extract(_base(name), _TAIL, 1), F.lit(""))


def first_token(name: Column) -> Column:
    return F.split_part(name, F.lit(" "), F.lit(1))


def payable(payments: DataFrame, payer: str, payee: str, rail: str, amount: str, least: dict[str, int], payer_hubs: tuple[str, ...] = (), payee_hubs: tuple[str, ...] = ()) -> DataFrame:
    """The rows worth comparing by name: rails of ``least`` with at least its amount, names on both sides, the payee's of more than three characters, no hub's name, and more than two characters left of each normal name.

    Null rails, amounts and names are left out. Columns stay as they are.
    """
    enough = F.lit(False)
    for name, cents in least.items():
        enough = enough | ((F.col(rail) == name) & (F.col(amount) >= cents))
    a, b = F.col(payer), F.col(payee)
    named = (F.trim(a) != "") & ~a.isin(list(payer_hubs)) & (F.length(F.trim(b)) > 3) & ~b.isin(list(payee_hubs))
    return payments.filter(enough & named & (F.length(normal_name(a)) > 2) & (F.length(normal_name(b)) > 2))


def _may_reach(a: str, b: str, fuzzy: float) -> Column:
    """False where the lengths alone keep the similarity below ``fuzzy``: at best all of the shorter name matches, with a common start."""
    few, many = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    jaro = (F.lit(2.0) + few / many) / 3
    return jaro + 0.4 * (1 - jaro) >= fuzzy - 1e-6


def name_matches(payments: DataFrame, payer: str, payee: str, amount: str, fuzzy: float = 0.92, cap: int = 1_000_000_00) -> DataFrame:
    """One row for each pair of names that pay each other's like: tier, score, band, rows, cents and whether the amount is above ``cap``.

    TIER1_EXACT has equal normal names and suffixes, TIER1B_SUFFIX_VARIANT equal names and other suffixes, TIER2_FUZZY the same first word and a similarity of at least ``fuzzy``.
    Rows are first folded to different pairs of names, so a name is compared once, however often it pays.
    """
    p = payments.filter(F.col(payer).isNotNull() & F.col(payee).isNotNull()).groupBy(F.col(payer).alias("payer_name"), F.col(payee).alias("payee_name")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(amount).alias("cents"))
    p = p.withColumns({"a": normal_name(F.col("payer_name")), "b": normal_name(F.col("payee_name")), "sa": name_suffix(F.col("payer_name")), "sb": name_suffix(F.col("payee_name"))}).filter(F.length("a") > 2).filter(F.length("b") > 2)
    same = p.filter("a = b").select("payer_name", "payee_name", "n_rows", "cents", F.when(F.col("sa").eqNullSafe(F.col("sb")), "TIER1_EXACT").otherwise("TIER1B_SUFFIX_VARIANT").alias("tier"), F.lit(1.0).alias("score"))
    near = p.filter((F.col("a") != F.col("b")) & (first_token(F.col("a")) == first_token(F.col("b"))))
    near = near.filter(_may_reach("a", "b", fuzzy)).select("payer_name", "payee_name", "n_rows", "cents", F.lit("TIER2_FUZZY").alias("tier"), F.round(jaro_winkler("a", "b"), 6).alias("score")).filter(F.col("score") >= fuzzy)
    band = F.when(F.col("score") >= 1, "exact").when(F.col("score") >= 0.97, "very_high").when(F.col("score") >= 0.95, "high").otherwise("medium")
    return same.unionByName(near).withColumns({"band": band, "above_cap": F.col("cents") > cap})


def best_per_key(matches: DataFrame, key: list[str]) -> DataFrame:
    """The best tier and score of each key; ties by the names."""
    rank = F.when(F.col("tier") == "TIER1_EXACT", 1).when(F.col("tier") == "TIER1B_SUFFIX_VARIANT", 2).otherwise(3)
    w = Window.partitionBy(*key).orderBy(rank, F.desc("score"), "payer_name", "payee_name")
    return matches.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
