"""The llm operators: SQL where there is one, else brute force, exact round trips and properties; nulls, empty and long texts, ties, clashing columns."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowquarry.llm import contamination, distinct, mixing, quantiles, queries, spam, text, tokens
from tests.oracle import compare

ENTRIES = queries.REGISTRY.entries


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, folder, duck, name):
    e = ENTRIES[name]
    df = e.run(spark, folder)
    assert compare(df, duck, e.sql) is None if e.sql else df.collect() is not None
    spark.catalog.clearCache()


# ---- percentiles


@pytest.mark.parametrize("alpha", [0.05, 0.01, 0.001])
def test_relative_error(spark, alpha):
    rng = random.Random(1)
    data = [("a", rng.lognormvariate(5, 3)) for _ in range(3000)] + [("b", rng.choice([-1, 1]) * rng.lognormvariate(0, 8)) for _ in range(3000)] + [("b", 0.0)] * 40 + [("c", 7.0), ("tiny", 1.3e-8), ("tiny", -4e-300), ("huge", 1.7e308), ("d", None), ("e", float("nan")), ("f", float("inf")), ("c", None)]
    df = spark.createDataFrame(data, "g string, x double").withColumn("bucket", F.lit("clash"))
    probs = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    parts = quantiles.sketch(df.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(5))), ["g", "part"], "x", alpha)
    got = {r["g"]: r for r in quantiles.quantiles(quantiles.merge(parts, ["g"]), ["g"], probs, alpha, bounds=True).collect()}
    assert set(got) == {"a", "b", "c", "tiny", "huge"}
    assert all(r["alpha"] == alpha for r in got.values())
    for g in got:
        v = sorted(x for k, x in data if k == g and x is not None and math.isfinite(x))
        assert got[g]["n"] == len(v)
        for name, p in probs.items():
            exact = v[math.floor(p * (len(v) - 1))]
            assert abs(got[g][name] - exact) <= alpha * abs(exact) * (1 + 1e-9)
            assert got[g][name + "_low"] - abs(exact) * 1e-12 <= exact <= got[g][name + "_high"] + abs(exact) * 1e-12
    assert quantiles.quantiles(quantiles.sketch(df.limit(0), ["g"], "x"), ["g"], probs).count() == 0
    with pytest.raises(ValueError):
        quantiles.sketch(df, ["g"], "x", 1.5)


# ---- distinct counts


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=60))
def test_runs_round_trip(values):
    a = np.array(sorted(values), np.int64)
    assert np.array_equal(distinct.decode(distinct.encode(a)), a)


def test_union_and_dense_runs():
    a = np.arange(-500, 5000, 7, dtype=np.int64)
    b = np.arange(0, 9000, 5, dtype=np.int64)
    assert np.array_equal(distinct.union([a, b, a]), np.union1d(a, b))
    assert len(distinct.encode(a)) == 8 + len(a) - 1  # small gaps take a byte each
    assert len(distinct.union([np.empty(0, np.int64), np.empty(0, np.int64)])) == 0


@pytest.mark.parametrize("shard_rows", [1 << 17, 20, 3])
def test_distinct_counts(spark, monkeypatch, shard_rows):
    """The same counts whether groups hold one shard or many, and whether merged shards are coarser or finer."""
    monkeypatch.setattr(distinct, "SHARD_ROWS", shard_rows)
    rng = random.Random(2)
    data = [(rng.choice("xyz"), rng.choice(["hot", None, *[str(i) for i in range(200)]])) for _ in range(5000)] + [("small", "1"), (None, "1"), (None, "7")]
    df = spark.createDataFrame(data, "g string, id string").withColumn("shard", F.lit("clash"))
    runs = distinct.build_runs(df, ["g"], F.col("id"))
    assert (runs.agg(F.max("bits")).first()[0] > 0) == (shard_rows < 1000) and runs.filter("g = 'small'").count() == 1
    per = {r["g"]: r["n_distinct"] for r in distinct.counts(runs, ["g"]).collect()}
    assert per == {g: len({i for k, i in data if k == g and i}) for g in ("x", "y", "z", "small", None)}
    whole = distinct.merge_runs(runs.withColumn("g", F.lit(None).cast("string")), ["g"])
    r = distinct.counts(whole, ["g"]).first()
    n = len({i for _, i in data if i})
    assert r["n_distinct"] == n and r["expected_lost"] == pytest.approx(n * (n - 1) / 2**65)
    monkeypatch.setattr(distinct, "SHARD_ROWS", 1 << 10)
    assert distinct.counts(distinct.merge_runs(whole, ["g"]), ["g"]).first()["n_distinct"] == n
    assert distinct.counts(distinct.build_runs(df.limit(0), ["g"], F.col("id")), ["g"]).count() == 0


def test_runs_are_recut():
    a = np.unique(np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 300, np.int64))
    cut = distinct.resplit(distinct.encode(a), 0, 0, 5)
    assert sorted(np.concatenate([distinct.decode(r) for _, r in cut]).tolist()) == a.tolist() and len(cut) == 32
    assert all(set((distinct.decode(r).view(np.uint64) >> np.uint64(59)).tolist()) == {s} for s, r in cut)
    assert distinct.resplit(b"x", 5, 19, 2) == [(2, b"x")]


# ---- leaks


def _leaks(spark, docs, items, n=10, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in contamination.leaks(d, i, n, **kw).collect())


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 20)))) for i in range(30)]
    docs = [(d, " ".join(rng.choice([*vocabulary, "other"]) for _ in range(rng.randint(0, 80)))) for d in range(120)]
    want = set()
    for d, t in docs:
        w = t.split()
        have = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
        for i, s in items:
            v = s.split()
            if any(tuple(v[k : k + 4]) in have for k in range(len(v) - 3)):
                want.add((d, i))
    assert want and _leaks(spark, docs, items, 4) == sorted(want)
    assert _leaks(spark, docs, items, 4, max_chars=300) == sorted(want)  # several blocks give the same


def test_leak_normal_form(spark):
    s = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in s)
    docs = [
        (1, "x " + s), (2, s.upper().replace(" ", "\r\n> ")), (3, wide), (4, "<p>" + s.replace(" ", "</b> <b>") + "</p>"), (5, s.replace(" ", "&nbsp;")), (6, s.replace("zeta", "zetta")), (7, None), (8, ""),
        (9, " ".join(s.split()[:10])), (10, " ".join(s.split()[:9])), (11, "z " * 400_000 + s), (12, s + " " + s),
    ]
    assert _leaks(spark, docs, [(1, s), (2, None), (3, ""), (4, "too short"), (5, "other " * 12), (5, s)]) == [(d, i) for d in (1, 2, 3, 4, 5, 9, 11, 12) for i in (1, 5)]
    assert _leaks(spark, docs, []) == [] and _leaks(spark, [], [(1, s)]) == []
    assert text.words("Don't <b>stop</b>_now&amp;then ½") == ["don", "t", "stop", "now", "then", "1", "2"]


def test_spans_are_cut(spark):
    s = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, f"Before, {s}. After."), (2, "clean <b>text</b>"), (3, None)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, s)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_removed"], r["clean_text"]) for r in contamination.without_leaks(d, i).collect()}
    assert got[2] == (0, "clean <b>text</b>") and got[3] == (0, None)
    assert got[1][0] == 11 and got[1][1].split() == ["Before,", ".", "After."]


def test_spans_of_several_blocks(spark):
    """Items in several blocks, whose windows overlap in a text, are removed as if they were one block."""
    rng = random.Random(8)
    v = [f"w{i}" for i in range(60)]
    docs = [(d, " ".join(rng.choice(v) for _ in range(60))) for d in range(40)]
    items = [(i, " ".join(docs[i % 40][1].split()[k : k + 9])) for i, k in enumerate([0, 3, 5, 20, 40] * 12)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(tuple, contamination.without_leaks(d, i, 4).collect()))
    assert sorted(map(tuple, contamination.without_leaks(d, i, 4, max_chars=200).collect())) == one
    grams = {tuple(t.split()[k : k + 4]) for _, t in items for k in range(6)}
    for doc, t in docs:
        w = t.split()
        gone = {j for k in range(len(w) - 3) if tuple(w[k : k + 4]) in grams for j in range(k, k + 4)}
        assert one[doc][1:] == (len(gone), t) if not gone else (one[doc][1], one[doc][2].split()) == (len(gone), [x for j, x in enumerate(w) if j not in gone])


# ---- mixing


def _dealt(counts, shards, seed, most):
    """Draws of each shard, by expanding the top of the tree group by group."""
    counts = np.array(counts, np.int64)
    out, first = np.zeros((shards, len(counts)), np.int64), np.zeros((shards, len(counts)), np.int64)
    for lo, hi, c, at in mixing.leaves(0, shards, counts, np.zeros_like(counts), seed, most):
        for shard, _, n, start in mixing.leaves(lo, hi, c, at, seed, 1):
            out[shard], first[shard] = n, start
    return out, first


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(1, 17), st.integers(0, 9))
def test_tree_deals_everything(counts, shards, seed):
    dealt, first = _dealt(counts, shards, seed, 1)
    assert dealt.sum(0).tolist() == counts and (dealt >= 0).all()
    assert dealt.sum(1).max() - dealt.sum(1).min() <= 1 + math.ceil(math.log2(shards) if shards > 1 else 0)
    assert np.array_equal(first, np.cumsum(dealt, 0) - dealt)  # consecutive, without overlap
    for most in (2, 5, 100):
        again, start = _dealt(counts, shards, seed, most)
        assert np.array_equal(again, dealt) and np.array_equal(start, first)


def test_hundred_thousand_shards_are_all_filled():
    shards, corpus = 100_000, 100_000 * mixing.SHARD_TOKENS
    shares = [0.3, 0.25, 0.15, 0.1, 0.08, 0.06, 0.03, 0.02, 0.01]
    blocks = [mixing.n_blocks(int(x * corpus), 10**12, corpus, shards) for x in shares]
    assert sum(blocks) >= 64 * shards and all(b & (b - 1) == 0 for b in blocks)
    dealt, _ = _dealt(blocks, shards, 0, -(-shards // mixing.GROUPS))
    assert dealt.sum(0).tolist() == blocks
    assert dealt.sum(1).min() >= 64 and dealt.sum(1).max() - dealt.sum(1).min() <= 18
    assert mixing.n_blocks(10**15, 5, 10**15, shards) == 4 and mixing.n_blocks(0, 0, 0, 8) == 1


def test_quota():
    s = mixing.Source("a", 0.5, 3, available=1045)
    assert [mixing.quota(s, c) for c in (0, 100, 2091, 10_000)] == [0, 50, 1046, 3135]
    assert mixing.quota(mixing.Source("b", 0.5, 2), 100) == mixing.quota(mixing.Source("b", 0.5, 0, available=5), 100) == 0


def test_last_pass_ends_where_the_quota_does(spark):
    """With more blocks than pieces, the end is found in several rounds and the mix meets each quota to within a document."""
    sized = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), (F.col("id") % 7 + 1).alias("n_tokens"))
    targets = spark.createDataFrame([("a", 0.45, 5), ("b", 0.55, 1)], "source string, target_share double, max_repeats int")
    p = mixing.plan(sized, targets, shards=200, seed=3)
    assert all(s.blocks > 2 * mixing.PIECES for s in p.sources) and p.sources[0].passes == 1
    m = mixing.mix(sized, p)
    got = {r["source"]: r for r in m.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count_distinct("doc_id", "copy").alias("k"), F.count(F.lit(1)).alias("rows")).collect()}
    for s in p.sources:
        assert 0 <= got[s.name]["n"] - mixing.quota(s, p.corpus) < 8 and got[s.name]["k"] == got[s.name]["rows"]
    assert m.select("shard").distinct().count() == 200
    assert [r["is_short"] for r in mixing.report(m, p).orderBy("source").collect()] == [False, False]


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["a", "a", "a", "b", None, "zz"]), rng.choice([0, rng.randint(1, 50)])) for i in range(3000)] + [(9000, "c", 5)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("A ", 0.3, 1), ("b", 0.4, 2), ("c", 0.2, 4), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    p = mixing.plan(sized, targets, shards=5, seed=7)
    assert p.corpus == sum(n for _, _, n in docs)
    m = mixing.mix(sized, p)
    rows = m.collect()
    again = sorted((r["shard"], r["position"], r["doc_id"], r["copy"]) for r in mixing.mix(sized, mixing.plan(sized, targets, shards=5, seed=7)).collect())
    assert again == sorted((r["shard"], r["position"], r["doc_id"], r["copy"]) for r in rows)
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    size = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) for s in "abc"}
    for s in p.sources:
        if s.name != "none":
            assert 0 <= size[s.name] - mixing.quota(s, p.corpus) < 50
    assert size["c"] == 20
    told = {r["source"]: r for r in mixing.report(m, p).collect()}
    assert {s for s, r in told.items() if r["is_short"]} == {x.name for x in p.sources if x.available * x.max_repeats < x.share * p.corpus} >= {"c", "none"}
    assert {s: told[s]["mixed_tokens"] for s in "abc"} == size
    for shard in range(5):
        assert sorted(r["position"] for r in rows if r["shard"] == shard) == list(range(1, 1 + sum(r["shard"] == shard for r in rows)))
    assert len(told) == 4
    with pytest.raises(ValueError):
        mixing.plan(sized, targets.union(targets))
    none = sized.limit(0)
    assert mixing.mix(none, mixing.plan(none, targets)).count() == 0
    assert [r[0] for r in spark.createDataFrame([(" Web-Crawl ",), ("web crawl",), ("",), (None,)], "s string").select(mixing.source_name("s")).collect()] == ["web_crawl", "web_crawl", None, None]


def test_write_mix(spark, tmp_path):
    sized = spark.createDataFrame([(i, "a", 3) for i in range(40)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    corpus = sized.withColumn("text", F.lit("t")).withColumn("shard", F.lit("clash"))
    mixing.write_mix(mixing.mix(sized, mixing.plan(sized, targets, shards=3)), corpus, str(tmp_path / "mix"), 3)
    assert spark.read.parquet(str(tmp_path / "mix")).count() == 40


def test_token_counts(spark):
    enc = tokens.encoding(tokens.DEFAULT_RANKS)
    texts = ["Hello world", "", None, "<|endoftext|>", "añ😀\r\n" * 50]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.n_tokens("t", tokens.DEFAULT_RANKS)).collect()]
    assert got == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


# ---- pages of keywords

PROSE = "The town lost nine shops this winter, and the mayor blames the bank. Two of them had been there for a century. It is not clear if any will return."
LINKS = "\n".join(f"[Cheap Loan {i}](http://www.site{i}.example/cheap-loan-{i}.html)" for i in range(30))
TAGS = " ".join(f"#cheap{w}{i}" for i in range(12) for w in ("safe", "lamp", "roll"))
GOODS = "\n".join(f"TOP lamp X{i * 37 % 999} $1{i}.99" for i in range(30))
TABLE = "month\tparty\tvolume\tamount\n" + "\n".join(f"2024-0{i % 9 + 1}\tOak Masonry Group\t{i}\t{i}.50" for i in range(30))
STUFFED = " ".join(["Why bank bonus? Because bank bonus is top bank bonus.", "Our new bank bonus beats any bank bonus, so get bank bonus with bank bonus!"] * 9)
CASES = {
    "prose": (PROSE, False), "long": (PROSE * 400, False), "links": (LINKS, True), "tags": (TAGS, True), "goods": (GOODS, True), "repeat": ("cheap bank bonus " * 80, True), "stuffed": (STUFFED, True),
    "places": (" ".join(f"dental offices near Elk{x} dental offices in Oak{x}" for x in ("ford", "bury", "mere", "wick", "dale", "gate")), True), "table": (PROSE + "\n" + TABLE, False),
    "note with links": (PROSE * 4 + "\nReferences:\n" + "\n".join(LINKS.split("\n")[:6]), False), "half": (PROSE + "\n" + LINKS, True), "forum": ("lol no, that is not a small thing for a shop like mine tbh it was fine for me until they closed the branch and we had to call them", False),
    "ru": ("Сегодня утром компания объявила о закрытии трёх магазинов в центре города, потому что продажи заметно упали за последний год и вернуть покупателей уже не удалось. Управляющий сказал, что решение было трудным, но другого выхода у них просто не осталось, и поблагодарил всех, кто приходил к ним все эти годы.", False),
    "pl": ("Wczoraj wieczorem firma ogłosiła zamknięcie trzech sklepów w centrum miasta, ponieważ sprzedaż wyraźnie spadła w ciągu ostatniego roku. Kierownik powiedział, że decyzja była trudna, ale innego wyjścia po prostu nie było", False),
    "ru list": ("\n".join(f"Дешёвый кредит {i} | Лучшая страховка {i * 7} | Срочный займ онлайн" for i in range(30)), True), "zh": ("今日、会社は三つの店を閉めると発表した。売上が大きく下がったためだという。店長は難しい決断だったと話した。", False),
    "phrases": ("\n".join(f"{a.title()} {b} works." for _ in range(40) for a in ("marine", "crypto", "payday", "lawyer") for b in ("insurance", "lending", "refunds")), True),
    "es": ("La empresa pagó a su proveedor durante el mes y el saldo quedó más bajo de lo previsto. No hay datos para explicar por qué.", False),
}


def test_list_pages(spark):
    base = [(i, PROSE, "en") for i in range(50)]
    docs = base + [(100 + i, t, None if i % 2 else "en") for i, (t, _) in enumerate(CASES.values())] + [(900, None, "en"), (901, "", "en"), (902, "!!!", "de")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: r for r in spam.judged(df).collect()}
    assert {n: got[100 + i]["is_spam"] for i, n in enumerate(CASES)} == {n: x for n, (_, x) in CASES.items()}
    assert not got.keys() & {900, 901, 902}
    assert spam.judged(df.limit(0)).count() == 0


def test_very_long_page(monkeypatch):
    n, bad = spam.list_words("cheap bank bonus " * 60_000 + PROSE * 10)
    assert n > 180_000 and bad / n > 0.98
    held = spam.list_words(LINKS + PROSE * 3 + "cheap bank bonus " * 30)
    monkeypatch.setattr(spam, "HELD", 10)
    assert spam.list_words(LINKS + PROSE * 3 + "cheap bank bonus " * 30) == held
    assert "".join(spam.blocks(PROSE * 100)) == PROSE * 100
