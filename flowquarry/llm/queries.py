"""Queries of this subpackage, with SQL where SQL can put the question."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.cleaning import canonical_id, day_date, month_key, sql_day, sql_id, sql_month
from flowquarry.llm import contamination, distinct, mixing, quantiles, spam, tokens
from flowquarry.operators.snapshots import current_rows
from flowquarry.plans.registry import Registry
from flowquarry.session import cut, table

REGISTRY = Registry()
query = REGISTRY.query

# ---- p2 percentiles

ALPHA = 0.01
PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def _current_edges(spark: SparkSession, d: str) -> DataFrame:
    columns = {"month": month_key("time_key"), "source": canonical_id("source"), "arrival_day": F.to_date("load_ts").cast("string"), "amount": F.col("amount")}
    return current_rows(table(spark, d, "edges").select("edge_id", "time_key", "source", "amount", "load_ts"), "edge_id", "load_ts", columns)


def _current_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "node_metrics").select(month_key("time_key").alias("month"), F.trim("version").alias("version"), canonical_id("node").alias("node"), F.struct("computed_at", "strength").alias("v"))
    return n.groupBy("month", "version", "node").agg(F.max("v").alias("v")).select("month", "version", F.col("v.strength").alias("strength"))


def _current_daily(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "node_metrics_daily").select(day_date("time_key").cast("string").alias("day"), canonical_id("node").alias("node"), F.struct("load_ts", "strength").alias("v"))
    return n.groupBy("day", "node").agg(F.max("v").alias("v")).select("day", F.col("v.strength").alias("strength"))


def all_sketches(spark: SparkSession, d: str) -> DataFrame:
    """(scope, key_a, key_b, bucket, n) of all groupings: the mergeable partial results."""
    names = F.array(*[F.lit(x) for x in ("edges_month", "edges_source", "edges_arrival_day")])
    e = quantiles.sketch_sets(_current_edges(spark, d), [["month"], ["source"], ["arrival_day"]], "amount", ALPHA)
    e = e.select(F.get(names, "set_id").alias("scope"), F.coalesce("month", "source", "arrival_day").alias("key_a"), F.lit(None).cast("string").alias("key_b"), "bucket", "n")
    n = quantiles.sketch(_current_nodes(spark, d), ["month", "version"], "strength", ALPHA)
    n = n.select(F.lit("nodes_month_version").alias("scope"), F.col("month").alias("key_a"), F.col("version").alias("key_b"), "bucket", "n")
    y = quantiles.sketch(_current_daily(spark, d), ["day"], "strength", ALPHA)
    y = y.select(F.lit("daily_day").alias("scope"), F.col("day").alias("key_a"), F.lit(None).cast("string").alias("key_b"), "bucket", "n")
    return e.unionByName(n).unionByName(y).filter("key_a is not null")


_P2_CUR = f"""
WITH e AS (SELECT * FROM (SELECT {sql_month("time_key")} AS month, {sql_id("source")} AS source, CAST(CAST(load_ts AS DATE) AS VARCHAR) AS arrival_day, amount, row_number() OVER (PARTITION BY edge_id ORDER BY load_ts DESC) AS k FROM edges) WHERE k = 1),
nm AS (SELECT * FROM (SELECT {sql_month("time_key")} AS month, trim(version) AS version, {sql_id("node")} AS node, strength, row_number() OVER (PARTITION BY {sql_month("time_key")}, trim(version), {sql_id("node")} ORDER BY computed_at DESC, strength DESC NULLS LAST) AS k FROM node_metrics) WHERE k = 1),
nd AS (SELECT * FROM (SELECT CAST({sql_day("time_key")} AS VARCHAR) AS day, {sql_id("node")} AS node, strength, row_number() OVER (PARTITION BY {sql_day("time_key")}, {sql_id("node")} ORDER BY load_ts DESC, strength DESC NULLS LAST) AS k FROM node_metrics_daily) WHERE k = 1),
v AS (SELECT 'edges_month' AS scope, month AS key_a, CAST(NULL AS VARCHAR) AS key_b, amount AS x FROM e UNION ALL SELECT 'edges_source', source, NULL, amount FROM e UNION ALL SELECT 'edges_arrival_day', arrival_day, NULL, amount FROM e
 UNION ALL SELECT 'nodes_month_version', month, version, strength FROM nm UNION ALL SELECT 'daily_day', day, NULL, strength FROM nd),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, key_a, key_b ORDER BY x) AS rk, count(*) OVER (PARTITION BY scope, key_a, key_b) AS n FROM v WHERE x IS NOT NULL AND key_a IS NOT NULL)
"""
_LG = "CAST(ln(CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE)) AS DOUBLE)"


def _sketch_value(x: str) -> str:
    i = f"ceil(ln(abs({x})) / {_LG})"
    return f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE sign({x}) * 2.0 / (exp({_LG}) + 1) * exp({i} * {_LG}) END"


_P2_SQL = (
    _P2_CUR
    + f"SELECT scope, key_a, key_b, max(n) AS n, CAST({ALPHA} AS DOUBLE) AS alpha, "
    + ", ".join(f"max(CASE WHEN rk = floor({p} * (n - 1)) + 1 THEN {_sketch_value('x')} END) AS {name}" for name, p in PROBS.items())
    + " FROM r GROUP BY scope, key_a, key_b"
)


@query("p2_percentiles", _P2_SQL)
def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.quantiles(all_sketches(spark, d), ["scope", "key_a", "key_b"], PROBS, ALPHA)


_P2_YEAR_SQL = (
    _P2_CUR.partition(",\nnm AS")[0]
    + ", r AS (SELECT substr(month, 1, 4) AS year, amount AS x, row_number() OVER (PARTITION BY substr(month, 1, 4) ORDER BY amount) AS rk, count(*) OVER (PARTITION BY substr(month, 1, 4)) AS n FROM e WHERE amount IS NOT NULL) "
    + f"SELECT year, max(n) AS n, CAST({ALPHA} AS DOUBLE) AS alpha, "
    + ", ".join(f"max(CASE WHEN rk = floor({p} * (n - 1)) + 1 THEN {_sketch_value('x')} END) AS {name}" for name, p in PROBS.items())
    + " FROM r GROUP BY year"
)


@query("p2_merged_months", _P2_YEAR_SQL)
def p2_merged_months(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each year, merged from the sketches of the months alone."""
    months = quantiles.sketch(_current_edges(spark, d), ["month"], "amount", ALPHA)
    years = quantiles.merge(months.withColumn("year", F.substring("month", 1, 4)), ["year"])
    return quantiles.quantiles(years, ["year"], PROBS, ALPHA)


# ---- p5 distinct counts


def base_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs by kind, arrival day and month of the rows of edges as delivered."""
    e = table(spark, d, "edges")
    s, t = canonical_id("source"), canonical_id("dest")
    rows = e.select(F.to_date("load_ts").alias("arrival_day"), month_key("time_key").alias("month"), s.alias("s"), t.alias("t"))
    kinds = F.array(
        F.struct(F.lit("source").alias("kind"), F.col("s").alias("id")),
        F.struct(F.lit("dest").alias("kind"), F.col("t").alias("id")),
        F.struct(F.lit("pair").alias("kind"), F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), F.concat_ws("\x00", "s", "t")).alias("id")),
    )
    each = rows.select(F.col("arrival_day").cast("string").alias("arrival_day"), "month", F.explode(kinds).alias("x")).select("arrival_day", "month", "x.*")
    return distinct.build_runs(each, ["kind", "arrival_day", "month"], F.col("id"))


_P5_SQL = f"""
WITH e AS (SELECT CAST(CAST(load_ts AS DATE) AS VARCHAR) AS arrival_day, {sql_month("time_key")} AS month, {sql_id("source")} AS s, {sql_id("dest")} AS t FROM edges),
k AS (SELECT 'source' AS kind, arrival_day, month, s AS id FROM e WHERE s IS NOT NULL UNION ALL SELECT 'dest', arrival_day, month, t FROM e WHERE t IS NOT NULL
 UNION ALL SELECT 'pair', arrival_day, month, s || '>' || t FROM e WHERE s IS NOT NULL AND t IS NOT NULL),
c AS (SELECT 'day_month' AS level, kind, arrival_day, month, count(DISTINCT id) AS n_distinct FROM k GROUP BY ALL
 UNION ALL SELECT 'day', kind, arrival_day, NULL, count(DISTINCT id) FROM k GROUP BY ALL
 UNION ALL SELECT 'month', kind, NULL, month, count(DISTINCT id) FROM k GROUP BY ALL
 UNION ALL SELECT 'all', kind, NULL, NULL, count(DISTINCT id) FROM k GROUP BY ALL)
SELECT *, CAST(n_distinct AS DOUBLE) * (CAST(n_distinct AS DOUBLE) - 1) / power(CAST(2 AS DOUBLE), 65) AS expected_lost FROM c
"""


@query("p5_distinct_counts", _P5_SQL)
def p5_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    runs = cut(base_runs(spark, d), "runs")
    day, month, none = F.col("arrival_day"), F.col("month"), F.lit(None).cast("string")
    level = lambda name, a, b: F.struct(F.lit(name).alias("level"), a.alias("a"), b.alias("m"))
    keys, rest = ["level", "kind", "a", "m"], ["bits", "shard", "n", "run"]
    coarse = runs.select("kind", F.explode(F.array(level("day", day, none), level("month", none, month))).alias("x"), *rest).select("kind", "x.*", *rest)
    merged = cut(distinct.merge_runs(coarse, keys), "merged")
    # What is counted over everything is merged from the months, which are far fewer runs.
    every = distinct.merge_runs(merged.filter("level = 'month'").withColumns({"level": F.lit("all"), "m": none}), keys)
    fine = runs.select(F.lit("day_month").alias("level"), "kind", day.alias("a"), month.alias("m"), "n")
    return distinct.counts(fine.unionByName(merged.select(*keys, "n")).unionByName(every.select(*keys, "n")), keys).withColumnsRenamed({"a": "arrival_day", "m": "month"})


# ---- p8 held-out passages




def _sql_words(text: str) -> str:
    """SQL for the list of words of a text: tags out, the entities of the tables decoded, compatibility forms folded. What folds to one character goes through a table made by rule, the rest that has letters or digits by name."""
    singles = [(c, unicodedata.normalize("NFKC", c)) for c in map(chr, range(0xA0, 0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    singles = [(c, n) for c, n in singles if n != c and len(n) == 1 and (n.isalnum() or n.isspace())]
    longer = {c: unicodedata.normalize("NFKC", c) for c in "ﬀﬁﬂﬃﬄﬅﬆ½¼¾Ⅳ㎞№"}
    named = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&#160;": " ", "&amp;": "&"}
    q = lambda x: x.replace("'", "''")
    t = f"regexp_replace(coalesce({text}, ''), '<!--.*?-->|</?[A-Za-z][^<>]*>', ' ', 'gs')"
    for k, v in {**named, **longer}.items():
        t = f"replace({t}, '{q(k)}', '{q(v)}')"
    t = f"nfc_normalize(translate({t}, '{''.join(c for c, _ in singles)}', '{''.join(n for _, n in singles)}'))"
    return f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"


_P8 = f"""
WITH d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents), i AS (SELECT item_id, {_sql_words("text")} AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 9), ' ') AS g, k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) >= 10)),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 9), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i WHERE len(w) >= 10)),
hit AS (SELECT doc_id, item_id, min(k) AS a, max(k) + 9 AS z FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id)
"""


@query("p8_found", _P8 + "SELECT doc_id, item_id FROM hit")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query("p8_items", _P8 + "SELECT e.item_id, e.suite, count(doc_id) AS n_documents, CAST(max(z - a + 1) AS INTEGER) AS longest FROM eval_items e LEFT JOIN hit ON hit.item_id = e.item_id GROUP BY e.item_id, e.suite")
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: the documents that hold a passage of it and the longest stretch found."""
    items = table(spark, d, "eval_items")
    found = contamination.leaks(table(spark, d, "documents"), items)
    per = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max(F.col("last_word") - F.col("first_word") + 1).alias("longest"))
    return items.select("item_id", "suite").join(per, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "longest")


@query("p8_clean")
def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return contamination.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


# ---- p9 mixing


def sized_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = tokens.ranks_path(docs, None)
    return cut(docs.select("doc_id", mixing.source_name("source").alias("source"), tokens.n_tokens("text", path).alias("n_tokens")), "sized")


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    sized = sized_documents(spark, d)
    p = mixing.plan(sized, table(spark, d, "mix_targets"))
    return mixing.report(mixing.mix(sized, p), p).filter("is_short").select("source")


@query("p9_report")
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    sized = sized_documents(spark, d)
    p = mixing.plan(sized, table(spark, d, "mix_targets"))
    return mixing.report(mixing.mix(sized, p), p)


@query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    sized = sized_documents(spark, d)
    return mixing.mix(sized, mixing.plan(sized, table(spark, d, "mix_targets")))


# ---- p10 pages of keywords and links


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.judged(table(spark, d, "documents")).filter("is_spam").select("doc_id")


@query("p10_measures")
def p10_measures(spark: SparkSession, d: str) -> DataFrame:
    return spam.judged(table(spark, d, "documents"))
