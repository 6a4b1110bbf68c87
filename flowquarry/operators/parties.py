"""Party dimension: cleaning, typing and the collapse of repeated rows to one row a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.cleaning import canonical_id, located, zip3

# Words that mark a business name, codes that stand for no sector, address types that stand for no place or for many parties,
# and the labels of types.
BUSINESS_WORDS = (
    "LLC INC CORP CORPORATION LTD LP LLP LLLP PLLC PC CO COMPANY TRUST DBA ASSOC ASSOCIATES ASSOCIATION GROUP HOLDINGS ENTERPRISES ENTERPRISE FOUNDATION CHURCH MINISTRIES "
    "SCHOOL ACADEMY UNIVERSITY COLLEGE CITY COUNTY BANK PARTNERS PARTNERSHIP SERVICES SOLUTIONS SYSTEMS CONSTRUCTION CONTRACTING PROPERTIES REALTY MEDICAL DENTAL CLINIC "
    "HOSPITAL LAW FARMS MOTORS AUTO RESTAURANT MARKET SHOP SALON AGENCY INDUSTRIES CENTER CENTRE &"
).split()
PLACEHOLDER_CODES = ("-1", "0", "00", "000000", "999999", "******", "UNKNOWN", "N/A", "NA", "NULL", "NONE")
PLACEHOLDER_ADDRESSES = ("POSTOFFICEBOX", "GENERALDELIVERY")
SHARED_ADDRESSES = ("HIGHRISE",)
BIZ_VALID, BIZ_PLACEHOLDER, BIZ_MISSING = "business_naics_valid", "business_naics_placeholder", "business_naics_missing"
GEO_RANKS = {"STREET": 3, "HIGHRISE": 3, "FIRM": 3, "RURALROUTE": 2, "POSTOFFICEBOX": 1}


def text_or_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def numeric_text(c: Column | str) -> Column:
    """A number written as text, screened by its form before the cast; else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), F.trim(c).try_cast("double"))


def zip_digits(c: Column | str) -> Column:
    """Digits of a zip as zip5: padded to five if there are at most five, else the first five of up to nine."""
    c = F.col(c) if isinstance(c, str) else c
    d = F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit(""))
    return F.substring(F.when(F.length(d) <= 5, F.lpad(d, 5, "0")).otherwise(F.lpad(d, 9, "0")), 1, 5)


def zip_shape(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    return (
        F.when(c.isNull(), "null")
        .when(t == "", "empty")
        .when(t.rlike(r"^\d{5}-\d{4}$"), "zip9_dash")
        .when(t.rlike(r"^\d{9}$"), "zip9")
        .when(t.rlike(r"^\d{5}$"), "zip5")
        .when(t.rlike(r"^\d{1,4}$"), "short")
        .otherwise("other")
    )


def coordinate_class(lat: Column | str, lon: Column | str) -> Column:
    """Nine ordered classes of a coordinate pair given as text or number."""
    la, lo = ((F.col(x) if isinstance(x, str) else x).cast("string") for x in (lat, lon))
    y, x = la.try_cast("double"), lo.try_cast("double")
    token = lambda c: F.lower(F.trim(c)).isin("null", "none", "na", "n/a")
    return (
        F.when(la.isNull() | lo.isNull(), "null")
        .when((F.trim(la) == "") | (F.trim(lo) == ""), "empty")
        .when(token(la) | token(lo), "null_token")
        .when(y.isNull() | x.isNull() | F.isnan(y) | F.isnan(x), "non_numeric")
        .when((y == 0) & (x == 0), "null_island")
        .when(~y.between(-90.0, 90.0) | ~x.between(-180.0, 180.0), "out_of_range")
        .when(x > 0, "positive_lon")
        .when(y.between(24.0, 50.0) & x.between(-125.0, -66.0), "conus")
        .otherwise("other")
    )


def decimal_places(c: Column | str) -> Column:
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.length(F.split_part(c, F.lit("."), F.lit(2))), F.lit(0))


def naics_status(c: Column | str) -> Column:
    """missing, then placeholder, then valid (two or more leading digits), else placeholder."""
    t = text_or_null(c)
    return F.when(t.isNull(), "missing").when(F.upper(t).isin(*PLACEHOLDER_CODES), "placeholder").when(t.rlike(r"^\d{2}"), "valid").otherwise("placeholder")


def naics_level(c: Column | str, n: int) -> Column:
    """The first n digits of a valid code; null if it is shorter."""
    t = F.regexp_extract(text_or_null(c), r"^(\d+)", 1)
    return F.when((naics_status(c) == "valid") & (F.length(t) >= n), F.substring(t, 1, n))


def name_type(c: Column | str) -> Column:
    """business if the name holds a business word, individual if it is two or three alphabetic words, else unknown; null stays null."""
    n = F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z0-9& ]", " "), r" +", " "))
    words = "|".join(BUSINESS_WORDS)
    return F.when(n.isNull() | (n == ""), None).when(n.rlike(rf"(^| )({words})( |$)"), "business").when(n.rlike(r"^[A-Z]+ [A-Z]+( [A-Z]+)?$"), "individual").otherwise("unknown")


def entity_columns(df: DataFrame, party_type_wins: bool = True) -> DataFrame:
    """Adds observed, inferred and resolved entity with its source, NAICS status, levels and coverage, node type (also by the older rule), entity class, and the geographic status and profile.

    A party type given (P, O) outweighs the type of the name. ``party_type_wins`` says whether a valid code makes a business only of a party that is one.
    The older node type goes by code and name alone. A code that is no placeholder yet doesn't start with two digits has the status placeholder, and the coverage of a missing one.
    """
    given = F.substring(F.upper(F.coalesce("party_type", F.lit(""))), 1, 1)
    observed = F.when(given == "P", "individual").when(given == "O", "business")
    inferred = F.when(name_type("cust_name").isin("individual", "business"), name_type("cust_name"))
    df = df.withColumns({"entity_observed": observed, "entity_inferred": inferred, "naics_status": naics_status("naics_cd")})
    resolved = F.coalesce("entity_observed", "entity_inferred", F.lit("unknown"))
    source = F.when(F.col("entity_observed").isNotNull(), "party_type").when(F.col("entity_inferred").isNotNull(), "name").otherwise("none")
    df = df.withColumns({"entity": resolved, "entity_source": source, **{f"naics{n}": naics_level("naics_cd", n) for n in (2, 3, 4, 6)}})
    valid, missing = F.col("naics_status") == "valid", F.col("naics_status") == "missing"
    held = F.coalesce(F.upper("naics_cd").isin(*PLACEHOLDER_CODES), F.lit(False))
    biz, ind = F.col("entity") == "business", F.col("entity") == "individual"
    named, person = F.coalesce(F.col("entity_inferred") == "business", F.lit(False)), F.coalesce(F.col("entity_inferred") == "individual", F.lit(False))

    def kind(first: Column, b: Column, i: Column) -> Column:
        return F.when(first, BIZ_VALID).when(b & held, BIZ_PLACEHOLDER).when(b & missing, BIZ_MISSING).when(i, "individual").otherwise("unknown")

    detail = F.when(biz & valid, BIZ_VALID).when(biz & held, BIZ_PLACEHOLDER).when(biz & missing, BIZ_MISSING).when(ind & valid, "individual_naics_valid").when(ind, "individual").when(valid, "unknown_naics_valid").otherwise("unknown")
    ok = located("lat", "lon")
    address = F.upper(F.coalesce(F.trim("addr_loc_rec_type"), F.lit("")))
    known = F.col("cust_name").isNotNull() | F.col("party_type").isNotNull() | F.col("naics_cd").isNotNull()
    return df.withColumns(
        {
            "naics_coverage": F.when(valid, "valid").when(~biz, "not_applicable").when(held, "placeholder").otherwise("missing"),
            "node_type": kind(biz & valid if party_type_wins else valid, biz, ind),
            "node_type_v5": kind(valid, named, person),
            "entity_class": detail,
            "geo_status": F.when(~ok, "missing").when(address.isin(*PLACEHOLDER_ADDRESSES), "placeholder").otherwise("valid"),
            "attr_profile": F.when(known & ok, "identity+geo").when(known, "identity_only").when(ok, "geo_only").otherwise("neither"),
            "shared_structure": address.isin(*SHARED_ADDRESSES).cast("int"),
        }
    )


def party_class(name: Column | str, code: Column | str) -> Column:
    """Business or consumer by two classifiers that know nothing of each other: a valid sector code and a business word in the name."""
    by_code, by_name = naics_status(code) == "valid", F.coalesce(name_type(name) == "business", F.lit(False))
    return F.when(by_code & by_name, "1_biz_both").when(by_code, "2_biz_naics_only").when(by_name, "3_biz_name_only").otherwise("4_consumer_like")


def resolve_duplicates(raw: DataFrame) -> DataFrame:
    """One row a node: each identity field is its first non-null value by rec_id, the geography is the whole row of the best address type.

    Also n_rows and whether names or coordinates conflict. Rows without an id are left out. Ties of the address type go to the lower rec_id.
    Coordinates that locate nothing (missing, not finite, both 0, out of range) are null, both of them.
    """
    rank = F.create_map(*[x for k, v in GEO_RANKS.items() for x in (F.lit(k), F.lit(v))])
    has_geo = located("lat", "lon") | F.col("zip3").isNotNull()
    score = F.when(has_geo, F.coalesce(F.element_at(rank, F.upper(F.trim("addr_loc_rec_type"))), F.lit(0))).otherwise(-1)
    rows = raw.withColumns({"node": canonical_id("node"), "zip3": zip3("zip3"), "cust_name": text_or_null("cust_name"), "party_type": text_or_null("party_type"), "naics_cd": text_or_null("naics_cd"), "__s": score}).filter("node is not null")
    identity = ["cust_name", "party_type", "naics_cd"]
    geography = ["lat", "lon", "zip3", "state", "city", "addr_loc_rec_type"]
    spot = F.when(located("lat", "lon"), F.struct("lat", "lon"))
    out = rows.groupBy("node").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rec_id"))).alias(c) for c in identity],
        F.max_by(F.struct(*[F.when(located("lat", "lon"), F.col(c)).alias(c) if c in ("lat", "lon") else c for c in geography]), F.struct("__s", -F.col("rec_id"))).alias("g"),
        F.count(F.lit(1)).alias("n_rows"),
        (F.count_distinct("cust_name") > 1).alias("name_conflict"),
        (F.count_distinct(spot) > 1).alias("point_conflict"),
    )
    return out.select("node", *identity, "g.*", "n_rows", "name_conflict", "point_conflict")


def load_parties(raw: DataFrame) -> DataFrame:
    return entity_columns(resolve_duplicates(raw))


def disagreement(parties: DataFrame) -> DataFrame:
    """Observed against inferred entity: count and share of all."""
    n = parties.groupBy(F.coalesce("entity_observed", F.lit("none")).alias("observed"), F.coalesce("entity_inferred", F.lit("none")).alias("inferred")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / parties.agg(F.count(F.lit(1))).scalar(), 6))


def coverage_report(parties: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    share = lambda cond: F.round(F.count_if(cond) / n, 6)
    return parties.agg(
        n.alias("n_nodes"),
        share(F.col("entity_observed").isNotNull()).alias("observed_share"),
        share(F.col("entity") != "unknown").alias("typed_share"),
        share(F.col("naics_status") == "valid").alias("naics_valid_share"),
        share(F.col("geo_status").isin("valid", "placeholder")).alias("located_share"),
        share(F.col("n_rows") > 1).alias("repeated_share"),
    )


def match_rate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: share of left's different keys that right holds; the guard of a join."""
    r = right.select(key).distinct().withColumn("__hit", F.lit(1))
    return left.select(key).distinct().join(r, key, "left").agg(F.count(F.lit(1)).alias("n_keys"), F.round(F.count("__hit") / F.count(F.lit(1)), 6).alias("match_rate"))


def require_match(left: DataFrame, right: DataFrame, key: str, least: float = 0.5) -> None:
    """Raises if fewer than ``least`` of the keys match. Runs a job."""
    rate = match_rate(left, right, key).first()["match_rate"]
    if rate is not None and rate < least:
        raise ValueError(f"only {rate:.1%} of the keys in {key} match")


def require_categories(df: DataFrame, column: str, allowed: list[str]) -> None:
    """Raises on a value that isn't declared. Runs a job that reads at most one value more than it reports."""
    strange = [r[0] for r in df.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).select(column).distinct().limit(5).collect()]
    if strange:
        raise ValueError(f"undeclared values of {column}: {strange}")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """Raises if two rows share their keys. Runs a job."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).collect():
        raise ValueError(f"rows are not unique by {keys}")


def key_tournament(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(rule, n_match): different left keys found on the right under each of six normal forms, to choose the form of a join."""
    k = F.col(key).cast("string")
    t = F.btrim(k, F.lit(" \t\r\n"))
    forms = {
        "as_is": k,
        "trimmed": t,
        "upper": F.upper(t),
        "no_decimals": F.regexp_replace(t, r"\.0+$", ""),
        "no_zeros": F.regexp_replace(t, r"^0+(.)", "$1"),
        "canonical": canonical_id(k),
    }
    each = lambda df: df.filter(k.isNotNull()).select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), f.alias("k")) for n, f in forms.items()])).alias("x")).select("x.*").filter("k is not null").distinct()
    return each(left).join(each(right), ["rule", "k"], "left_semi").groupBy("rule").agg(F.count(F.lit(1)).alias("n_match"))


def id_shapes(df: DataFrame, key: str) -> DataFrame:
    """Ids by length and kind of characters."""
    t = F.col(key).cast("string")
    kind = F.when(t.isNull(), "null").when(F.trim(t) == "", "blank").when(t.rlike(r"^[0-9]+$"), "digits").when(t.rlike(r"^[0-9]+\.[0-9]+$"), "decimal").when(t.rlike(r"^\s|\s$"), "padded").when(t.rlike(r"^[0-9A-Za-z]+$"), "alphanumeric").otherwise("other")
    return df.groupBy(F.length(t).alias("n_chars"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """(step, n_kept, position): rows left after each filter in turn, in one pass."""
    kept, aggs = F.lit(True), []
    for i, (name, cond) in enumerate(steps.items()):
        kept = kept & F.coalesce(cond, F.lit(False))
        aggs.append(F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("step"), F.count_if(kept).alias("n_kept")))
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def text_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, nulls, blanks, and among the rest shares in capitals, with digits, with special characters, and lengths."""
    c = F.col(column)
    full = c.isNotNull() & (F.trim(c) != "")
    n = F.count_if(full)
    part = lambda cond: F.round(F.when(n > 0, F.count_if(full & cond) / n), 6)
    size = F.when(full, F.length(c))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(c.isNull()).alias("n_null"),
        F.count_if(F.coalesce(F.trim(c) == "", F.lit(False))).alias("n_blank"),
        part(c == F.upper(c)).alias("capitals_share"),
        part(c.rlike(r"[0-9]")).alias("digit_share"),
        part(c.rlike(r"[^A-Za-z0-9 ]")).alias("special_share"),
        F.min(size).alias("least_chars"),
        F.max(size).alias("most_chars"),
        F.round(F.avg(size), 6).alias("mean_chars"),
    )
