"""Iterative metrics and statistics against plain computations on small graphs."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowquarry.functions import stats
from flowquarry.functions.similarity import jaro_winkler_text
from flowquarry.operators import edges as eg
from flowquarry.operators import flow, graph
from flowquarry.operators import iterative as it
from flowquarry.operators import pairs as pr
from flowquarry.operators import temporal as tm


@pytest.fixture(scope="module")
def net():
    rng = random.Random(7)
    out = {}
    for _ in range(120):
        a, b = rng.randint(0, 24), rng.randint(0, 24)
        if a != b:
            out[f"n{a:02d}", f"n{b:02d}"] = rng.randint(1, 50)
    out["z1", "z2"] = 3  # a component of its own
    return out


@pytest.fixture(scope="module")
def links(spark, net):
    return spark.createDataFrame([(a, b, float(w)) for (a, b), w in net.items()], "src string, dst string, w double")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_pagerank(links, net):
    nodes = sorted({x for e in net for x in e})
    out = {n: sum(w for (a, _), w in net.items() if a == n) for n in nodes}
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(12):
        lost = sum(r[n] for n in nodes if not out[n])
        r = {n: 0.15 / len(nodes) + 0.85 * (sum(r[a] * w / out[a] for (a, b), w in net.items() if b == n) + lost / len(nodes)) for n in nodes}
    got = as_dict(it.pagerank(links, 12))
    assert got == pytest.approx(r, abs=1e-8) and sum(got.values()) == pytest.approx(1, abs=1e-6)


def test_iterated_to_a_tolerance(spark):
    net = {("a", "b"): 5.0, ("b", "a"): 4.0, ("a", "c"): 3.0, ("c", "a"): 2.0, ("b", "c"): 4.0, ("c", "b"): 5.0, ("a", "d"): 2.0}
    links = spark.createDataFrame([(a, b, w) for (a, b), w in net.items()], "src string, dst string, w double").coalesce(1)
    w = np.zeros((4, 4))
    for (a, b), v in net.items():
        w["abcd".index(a), "abcd".index(b)] = v
    h = {r["node"]: r for r in it.hits(links, 200, tol=1e-4).collect()}
    u, _, vt = np.linalg.svd(w)
    assert [h[n]["hub"] for n in "abcd"] == pytest.approx(list(np.abs(u[:, 0])), abs=1e-2) and [h[n]["authority"] for n in "abcd"] == pytest.approx(list(np.abs(vt[0])), abs=1e-2)
    with pytest.raises(RuntimeError):
        it.hits(links, 1, tol=1e-9)
    one = (w > 0).astype(float)
    alpha = 0.85 / max(abs(np.linalg.eigvals(one)))
    k = as_dict(it.katz(links, None, 300, tol=1e-2))
    assert [k[n] for n in "abcd"] == pytest.approx(list(np.linalg.solve(np.eye(4) - alpha * one.T, np.ones(4))), abs=0.1)


def test_components_and_cores(links, net):
    near = {}
    for a, b in net:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {n: n for n in near}
    for _ in near:
        label = {n: min([label[n], *(label[m] for m in near[n])]) for n in near}
    assert as_dict(it.components(links)) == label
    core, left, k = {}, {n: set(m) for n, m in near.items()}, 0
    while left:
        n = min(left, key=lambda x: (len(left[x]), x))
        k = max(k, len(left[n]))
        core[n] = k
        for m in left.pop(n):
            left[m].discard(n)
    assert as_dict(it.core_numbers(links)) == core


def test_triangles(links, net):
    near = {}
    for a, b in net:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {r["node"]: r for r in it.triangles(links).collect()}
    for n, m in near.items():
        t = sum(b in near[a] for a, b in itertools.combinations(sorted(m), 2))
        assert got[n]["triangles"] == t and got[n]["degree"] == len(m)
    cyc = as_dict(it.cyclic_triangles(links))
    want = {}
    for a, b in net:
        for c in near[b]:
            if (b, c) in net and (c, a) in net and c != a:
                want[a] = want.get(a, 0) + 1
    assert cyc == want


def _reach(net, n):
    seen, todo = {n}, [n]
    while todo:
        x = todo.pop()
        for a, b in net:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_strong_components_and_bow_tie(links, net):
    nodes = sorted({x for e in net for x in e})
    reach = {n: _reach(net, n) for n in nodes}
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    scc = it.strong_components(links)
    assert as_dict(scc) == want
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    top = min(sizes, key=lambda c: (-sizes[c], c))
    bow = {n: "CORE" if want[n] == top else "OUT" if n in reach[top] else "IN" if top in reach[n] else "OTHER" for n in nodes}
    assert as_dict(it.bow_tie(links, scc)) == bow


def test_betweenness(links, net):
    nodes = sorted({x for e in net for x in e})
    adj = {n: [b for a, b in net if a == n] for n in nodes}
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order, pred = {s: 0}, {s: 1.0}, [], {n: [] for n in nodes}
        todo = [s]
        while todo:
            v = todo.pop(0)
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0) + paths[v]
                    pred[w].append(v)
        dep = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in pred[w]:
                dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                want[w] += dep[w]
    got = as_dict(it.betweenness(links, k=len(nodes)))
    assert got == pytest.approx(want, abs=1e-4)


def test_betweenness_of_a_long_chain(spark):
    n = 34
    chain = spark.createDataFrame([(f"c{i:02d}", f"c{i + 1:02d}", 1.0) for i in range(n)], "src string, dst string, w double")
    seed = spark.createDataFrame([("c00",)], "node string")
    assert {r["node"]: r["dist"] for r in it.distances(chain, seed).collect()} == {f"c{i:02d}": i for i in range(n + 1)}
    assert as_dict(it.betweenness(chain)) == {f"c{i:02d}": float(i * (n - i)) for i in range(n + 1)}


def test_betweenness_query_samples_as_the_reference(spark, folder, monkeypatch):
    from flowquarry.plans.graph import n13

    asked = []
    sample = it.sample_nodes
    monkeypatch.setattr(it, "sample_nodes", lambda links, k, seed=0: (asked.append(k), sample(links, 2, seed))[1])
    n13(spark, folder)
    assert asked == [128]


def test_trophic_levels(spark, links, net):
    got = {r["node"]: r["level"] for r in it.trophic_levels(links).collect()}
    nodes = sorted({x for e in net for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for (a, b), v in net.items():
        w[at[a], at[b]] += v
    u, v = w.sum(0) + w.sum(1), w.sum(0) - w.sum(1)
    h = np.linalg.lstsq(np.diag(u) - w - w.T, v, rcond=None)[0]
    comp = as_dict(it.components(links))
    for c in set(comp.values()):
        m = [n for n in nodes if comp[n] == c]
        low = min(h[at[n]] for n in m)
        assert {n: got[n] for n in m} == pytest.approx({n: h[at[n]] - low for n in m}, abs=2e-3)
    chain = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0)], "src string, dst string, w double")
    lv = it.trophic_levels(chain)
    assert as_dict(lv.select("node", "level")) == {"A": 0.0, "B": 1.0, "C": 2.0, "D": 3.0}
    assert it.trophic_incoherence(chain, lv).first()["f0"] == 0.0


def test_unsolved_trophic_levels_are_an_error(links):
    with pytest.raises(RuntimeError, match="residual"):
        it.trophic_levels(links, rounds=2)


def test_spectral_radius(spark):
    ring = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, w double")
    assert it.spectral_radius(ring) == pytest.approx(1.0)


def _edges(spark, data):
    return spark.createDataFrame(data, "time_key string, source string, dest string, cents bigint, volume bigint")


def test_hand_made_flow(spark):
    e = _edges(spark, [("2024-01", "a", "b", 600, 2), ("2024-01", "b", "a", 400, 1), ("2024-01", "a", "c", 0, 0)])
    got = {r["node"]: r for r in flow.reciprocity(e).collect()}
    assert got["a"]["reciprocity_amount_share"] == 0.4 and got["c"]["reciprocity_amount_share"] is None
    f = {r["node"]: r for r in flow.flows(e).collect()}
    assert f["a"]["net_flow"] == -2.0 and f["c"]["flow_ratio"] == 0.0 and f["c"]["avg_in_ticket"] is None
    c = {r["node"]: r for r in flow.concentration(e).collect()}
    assert c["a"]["top1_out"] == 1.0 and c["c"]["hhi_out"] is None


def test_relationship_memory(spark):
    on = [1, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    months = [f"2024-{i + 1:02d}" for i in range(12)]
    data = [(m, "x", "y", 1, 1) for m in months] + [(m, "a", "b", 1, 1) for m, o in zip(months, on, strict=True) if o]
    got = [r["cohort"] for r in tm.relationship_memory(_edges(spark, data)).filter("source = 'a'").orderBy("t").collect()]
    assert got == ["new", "returning", "retained", "new"]


def test_stable_roles(spark):
    data = [("k", t, r) for t, r in enumerate("abbcbb", 1)] + [("g", 1, "a"), ("g", 2, "b"), ("g", 4, "b")]
    got = tm.stable_roles(spark.createDataFrame(data, "node string, t int, role string"), ["node"])
    k = got.filter("node = 'k'").orderBy("t").collect()
    assert [r["stable_role"] for r in k] == list("aabbbb") and [r["months_in"] for r in k] == [1, 2, 1, 2, 3, 4]
    g = got.filter("node = 'g'").orderBy("t").collect()
    assert [r["stable_role"] for r in g] == ["a", "a", "b"] and g[-1]["months_in"] == 1


def test_dynamics(spark):
    from flowquarry.plans.studies import dynamics

    months = [f"2024-0{m}" for m in range(1, 7)]
    data = [(m, f"p{i}", "x", 100_00, 1) for m in months for i in range(4) if m < months[-1] or i == 0]  # loses three of four
    data += [(m, f"p{i}", "thin", 100_00, 1) for m in months for i in range(2) if m < months[-1] or i == 0]  # loses one of two
    data += [(m, f"p{i}", "kept", 100_00, 1) for m in months for i in range(4)]
    data += [(m, f"p{i}", "grown", 100_00, 1) for m in months for i in range(8 if m == months[-1] else 3)]
    data += [(m, "p1", "back", 5_00, 1) for m in months if m != months[-2]]
    got = {(r["time_key"], r["node"]): r["dynamics_role"] for r in dynamics(_edges(spark, data)).collect()}
    assert {n: got[months[-1], n] for n in ("x", "thin", "kept", "grown", "back")} == {"x": "bleeding", "thin": "variable", "kept": "steady", "grown": "expanding", "back": "intermittent"}
    assert got[months[2], "x"] == "newcomer" and got[months[3], "x"] == "steady"


def test_roles_of_rules(spark):
    from flowquarry.operators import panel as pn

    cols = "time_key string, node string, in_cents bigint, out_cents bigint, flow_ratio double, throughflow double, reciprocity_amount_share double, degree int, hub_in_share double, top1_in double, top1_out double, trophic_level double, core int, participation_coef double, frac_intra_amount double, want string"
    rows_ = [
        ("m", "in", 5, 0, 1.0, 0.0, 0.0, 2, None, 1.0, None, 0.0, 1, 0.0, 1.0, "one_sided single_relationship upstream_supplier peripheral"),
        ("m", "out", 0, 5, -1.0, 0.0, 0.0, 5, 0.1, None, 0.8, 1.0, 1, 0.0, 1.0, "one_sided concentrated upstream_supplier peripheral"),
        ("m", "near", 59, 41, 0.18, 900.0, 0.9, 5, 0.8, 0.9, 0.1, 2.0, 3, 0.7, 0.9, "mixed infra_dependent midstream peripheral"),  # 0.18 is no conduit
        ("m", "conduit", 50, 50, 0.15, 900.0, 0.1, 9, 0.7, 0.7, 0.7, 3.0, 9, 0.1, 0.7, "conduit balanced downstream_buyer embedded"),
        ("m", "trader", 50, 50, -0.15, 1.0, 0.9, 9, 0.0, 0.2, 0.2, None, 4, 0.62, 0.9, "trader balanced unknown connector"),
        ("m", "quiet", 50, 50, 0.0, 1.0, 0.0, 9, 0.0, 0.2, 0.2, 4.0, 4, None, None, "mixed balanced downstream_buyer intermediate"),
        ("other", "alone", 90, 10, 0.8, 10.0, 0.0, 3, 0.0, 0.5, 0.5, 1.0, 2, 0.0, 0.5, "collector balanced upstream_supplier peripheral"),
    ]
    m = spark.createDataFrame(rows_, cols)
    got = pn.embeddedness_roles(pn.hierarchy_roles(pn.dependence_roles(pn.flow_roles(m, ["time_key"])), ["time_key"]), ["time_key"])
    assert {r["node"]: " ".join(r[c] for c in ("flow_role", "dependence_role", "hierarchy_role", "embeddedness_role")) for r in got.collect()} == {r[1]: r[-1] for r in rows_}
    assert pn.flow_roles(m.limit(0), ["time_key"]).count() == 0


def test_lifecycle(spark):
    before = {"A": "abcdefgh", "B": "ij", "C": "kl", "D": "mn", "G": "opq"}
    after = {"A1": "abcd", "A2": "efgh", "BC": "ijkl", "N": "xy", "G": "opqrs"}
    rows_ = [(t, n, g) for t, part in ((1, before), (2, after), (3, before)) for g, ns in part.items() for n in ns]
    groups = spark.createDataFrame(rows_, "t int, node string, grp string")
    got = {tuple(r) for r in graph.lifecycle(groups).collect()}
    first = {(2, "A", "A1", "split"), (2, "A", "A2", "split"), (2, "B", "BC", "merge"), (2, "C", "BC", "merge"), (2, None, "N", "birth"), (2, "D", None, "death"), (2, "G", "G", "growth")}
    back = {(3, "A1", "A", "merge"), (3, "A2", "A", "merge"), (3, "BC", "B", "split"), (3, "BC", "C", "split"), (3, "N", None, "death"), (3, None, "D", "birth"), (3, "G", "G", "shrinkage")}
    assert got == first | back
    best = {tuple(r) for r in graph.lifecycle_by_best(groups).filter("t = 2").collect()}
    assert best == {(2, "A", "A1", 0.5, "split"), (2, "B", "BC", 0.5, "continued"), (2, "C", "BC", 0.5, "continued"), (2, "G", "G", 0.6, "continued"), (2, None, "A2", None, "born"), (2, None, "N", None, "born")}


def test_statistics(spark):
    s = [("up", t, t) for t in range(12)] + [("flat", t, 5) for t in range(12)] + [("tie", t, t // 3) for t in range(12)] + [("few", 1, 1)]
    got = {r["k"]: r for r in stats.mann_kendall(spark.createDataFrame(s, "k string, t int, x int"), "k", "t", "x").collect()}
    assert got["up"]["s"] == 66 and got["flat"]["z"] == 0 and got["flat"]["p"] == pytest.approx(1, abs=1e-6) and "few" not in got
    z = got["up"]["z"]
    assert got["up"]["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=2e-6)
    assert got["tie"]["s"] == 54
    p = spark.createDataFrame([(0.001,), (0.02,), (0.03,), (0.5,), (None,)], "p double")
    assert sorted(str(r["passes"]) for r in stats.benjamini_hochberg(p, "p", 0.05).collect()) == ["False", "False", "True", "True", "True"]


def test_node_budget(spark):
    p = spark.createDataFrame([("a", "b", 9), ("c", "d", 8), ("a", "c", 7), ("e", "f", 6)], "a string, b string, s int")
    assert pr.node_budget(p, 4, [F.desc("s")]) == [("a", "b"), ("c", "d"), ("a", "c")]
    late = spark.createDataFrame([("a", "b", 99), *[(f"p{i}", f"q{i}", 50 - i) for i in range(40)], ("a", "x", 1), ("x", "b", 0), (None, "a", 0)], "a string, b string, s int")
    assert pr.node_budget(late, 3, [F.desc("s")]) == [("a", "b"), ("a", "x"), ("x", "b")]  # the last place is filled far down
    assert pr.node_budget(late, 1, [F.desc("s")]) == pr.node_budget(p.limit(0), 3, [F.desc("s")]) == []


def test_budget_against_the_greedy_choice(spark):
    rng = random.Random(12)
    data = [(a, b, i) for i, (a, b) in enumerate({tuple(rng.sample("abcdefghijklmnop", 2)) for _ in range(60)})]
    p = spark.createDataFrame(data, "a string, b string, s int")
    for budget in (2, 5, 8, 11):
        taken, want = set(), []
        for a, b, _ in sorted(data, key=lambda x: x[2]):
            if len(taken | {a, b}) <= budget:
                taken |= {a, b}
                want.append((a, b))
        assert pr.node_budget(p, budget, [F.col("s")]) == want


def test_constraint_against_the_definition(spark):
    """Also on a star whose hub has many leaves: no pairs of leaves are built."""
    rng = random.Random(3)
    e = {(a, b): float(rng.randint(1, 9)) for a, b in {tuple(rng.sample("abcdefgh", 2)) for _ in range(25)}}
    links = spark.createDataFrame([(a, b, w) for (a, b), w in e.items()], "src string, dst string, w double")
    w = {}
    for (a, b), x in e.items():
        w[a, b] = w.get((a, b), 0) + x
        w[b, a] = w.get((b, a), 0) + x
    n = sorted({a for a, _ in w})
    tot = {i: sum(x for (a, _), x in w.items() if a == i) for i in n}
    p = lambda i, j: w.get((i, j), 0) / tot[i]
    want = {i: sum((p(i, j) + sum(p(i, q) * p(q, j) for q in n if q not in (i, j))) ** 2 for j in n if (i, j) in w) for i in n}
    got = {r["node"]: r["constraint"] for r in it.constraint(links).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-5) for i in n)
    star = spark.range(100_000).select(F.lit("hub").alias("src"), F.concat(F.lit("l"), "id").alias("dst"), F.lit(1.0).alias("w"))
    c = it.constraint(star)
    assert c.filter("node = 'l7'").first()["constraint"] == 1.0 and c.count() == 100_001


def test_louvain_joins_two_cliques(spark):
    e = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "xyz" for i in range(5) for j in range(i)] + [("x0", "y0", 0.1), ("y1", "z1", 0.1)]
    got = {r["node"]: r["grp"] for r in it.louvain(spark.createDataFrame(e, "src string, dst string, w double")).collect()}
    assert len(set(got.values())) == 3 and all(len({g for n, g in got.items() if n[0] == c}) == 1 for c in "xyz")


def test_current_flow_against_a_dense_solver(spark):
    rng = random.Random(6)
    e = {tuple(sorted(rng.sample(range(12), 2))): rng.uniform(0.5, 5) for _ in range(24)}
    links = spark.createDataFrame([(f"n{a}", f"n{b}", w) for (a, b), w in e.items()] + [("lone1", "lone2", 1.0)], "src string, dst string, w double")
    names = sorted({x for a, b in e for x in (a, b)})
    pairs = [(i, f"n{names[a]}", f"n{names[b]}") for i, (a, b) in enumerate(((0, 5), (3, 7), (1, 2)))]
    at = {n: i for i, n in enumerate(names)}
    lap = np.zeros((len(names), len(names)))
    for (a, b), w in e.items():
        i, j = at[a], at[b]
        lap[i, i] += w
        lap[j, j] += w
        lap[i, j] -= w
        lap[j, i] -= w
    want = dict.fromkeys(names, 0.0)
    for _, s, t in pairs:
        b = np.zeros(len(names))
        b[at[int(s[1:])]], b[at[int(t[1:])]] = 1, -1
        h = np.linalg.pinv(lap) @ b
        for n in names:
            if n not in (int(s[1:]), int(t[1:])):
                want[n] += 0.5 * sum(w * abs(h[at[x]] - h[at[y]]) for (x, y), w in e.items() if n in (x, y)) / 3
    got = {r["node"]: r["current_flow"] for r in it.current_flow(links, pairs=spark.createDataFrame(pairs, "pair bigint, s string, t string")).collect()}
    assert got["lone1"] == 0.0 and all(got[f"n{n}"] == pytest.approx(want[n], abs=1e-4) for n in names)
    deg = spark.createDataFrame([("a", 8.0), ("b", 1.0), ("c", 1.0), ("z", 0.0)], "node string, d double")
    drawn = [r for r in it.landmark_pairs(deg, 200).collect()]
    assert 20 < len(drawn) < 120 and {r["s"] for r in drawn} == {"a", "b", "c"} and sum(r["s"] == "a" or r["t"] == "a" for r in drawn) > 0.8 * len(drawn)


def test_states_of_a_loop_are_deleted(spark, links):
    import os

    from flowquarry import session

    folder = session.shared_folder(spark).removeprefix("file://")
    states = lambda: {f for f in os.listdir(folder) if f.startswith("rank-")}
    before = states()
    it.pagerank(links, rounds=6).count()
    assert len(states() - before) <= 2


def test_jaro_winkler_against_the_engine():
    import duckdb

    con = duckdb.connect()
    rng = random.Random(4)
    names = ["martha", "marhta", "dixon", "dicksonx", "", "a", *("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12))) for _ in range(60))]
    for a, b in itertools.product(names[:30], names[30:]):
        if a and b:
            assert jaro_winkler_text(a, b) == pytest.approx(con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0], abs=1e-9)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["2024-01", "2024-02"]), st.sampled_from("abcde"), st.sampled_from("abcde"), st.integers(0, 10**6)), min_size=1, max_size=25))
def test_flow_identities(spark, data):
    unique = {(m, s, t): (m, s, t, c, 1) for m, s, t, c in data}
    e = _edges(spark, list(unique.values()))
    f = flow.flows(e).collect()
    assert sum(r["in_cents"] - r["out_cents"] for r in f) == 0
    assert sum(r["in_cents"] for r in f) == sum(x[3] for x in unique.values())
    part = spark.createDataFrame([(n, n in "ab" and "x" or "y") for n in "abcde"], "node string, grp string")
    assert graph.supergraph(e, part).agg(F.sum("cents")).first()[0] == sum(x[3] for x in unique.values())
    ladder, _ = eg.build_ladder(e, {"P50": 0.5, "P90": 0.9})
    n = {r["version"]: r["count"] for r in eg.all_versions(e, ladder, ["V0", "P90", "P50"]).groupBy("version").count().collect()}
    assert n["V0"] == len(unique) >= n.get("P90", 0) >= n.get("P50", 0)
    both = tm.relationship_memory(e).groupBy("time_key").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in both) == len(unique)


def test_ranks_of_any_size(spark):
    from flowquarry.functions.ranks import top_sum, value_ranks, with_average_rank
    from flowquarry.operators.skew import top_k

    rng = random.Random(9)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, -3.5, 7.0, rng.uniform(-1e6, 1e6), rng.uniform(0, 1)])) for _ in range(600)] + [("hot", 1.0)] * 50
    df = spark.createDataFrame(data, "g string, x double")
    got = with_average_rank(df, ["g"], "x", "r", "p").collect()
    assert len(got) == len(data)
    for g in ("a", "b", None, "hot"):
        v = [x for k, x in data if k == g and x is not None]
        for r in got:
            if r["g"] == g and r["x"] is not None:
                want = sum(y < r["x"] for y in v) + (sum(y == r["x"] for y in v) + 1) / 2
                assert r["r"] == want and r["p"] == pytest.approx(want / len(v))
            elif r["x"] is None:
                assert r["r"] is None
    ranks = value_ranks(df.filter("x > 0"), ["g"], "x")
    for r in ranks.groupBy("g").agg(top_sum(ranks, ["g"], "x", F.lit(17)).alias("s")).collect():
        assert r["s"] == pytest.approx(sum(sorted((x for k, x in data if k == r["g"] and x and x > 0), reverse=True)[:17]))
    k = df.filter("g is not null and x is not null").withColumn("id", F.monotonically_increasing_id())
    best = top_k(k, ["g"], [F.desc("x"), F.col("id")], 5, "id", salts=3, rank="k").collect()
    for g in ("a", "b", "hot"):
        assert [r["x"] for r in sorted((r for r in best if r["g"] == g), key=lambda r: r["k"])] == sorted((x for m, x in data if m == g and x is not None), reverse=True)[:5]


def test_modularity_moves(spark):
    rng = random.Random(3)
    data = []
    for block in range(4):
        names = [f"b{block}n{i}" for i in range(8)]
        data += [(a, b, 5.0) for a in names for b in names if a < b and rng.random() < 0.8]
    data += [("b0n0", "b1n0", 1.0), ("b1n1", "b2n1", 1.0), ("b2n2", "b3n2", 1.0)]
    links = spark.createDataFrame(data, "src string, dst string, w double")
    part = as_dict(it.modularity_moves(links, 10))
    m2 = 2 * sum(w for _, _, w in data)

    def modularity(g):
        tot = {}
        for a, b, w in data:
            tot[g[a]] = tot.get(g[a], 0) + w
            tot[g[b]] = tot.get(g[b], 0) + w
        return sum(2 * w for a, b, w in data if g[a] == g[b]) / m2 - sum((t / m2) ** 2 for t in tot.values())

    assert set(part) == {x for a, b, _ in data for x in (a, b)}
    assert modularity(part) > 0.8 * modularity({n: n[:2] for n in part})
    assert as_dict(it.modularity_moves(links, 10)) == part


def _tables_written(monkeypatch):
    from flowquarry import session

    written = []
    write = session._write
    monkeypatch.setattr(session, "_write", lambda df, label: (written.append(label), write(df, label))[1])
    return written


def _ranks(net, t, rounds=300):
    out = {n: sum(w for (a, _), w in net.items() if a == n) for n in t}
    r = dict(t)
    for _ in range(rounds):
        came = dict.fromkeys(t, 0.0)
        for (a, b), w in net.items():
            came[b] += r[a] * w / out[a]
        lost = 1 - sum(came.values())
        r = {n: 0.15 * t[n] + 0.85 * (came[n] + lost * t[n]) for n in t}
    return r


def test_personal_pagerank_to_a_tolerance_writes_no_table_a_round(spark, links, net, monkeypatch):
    nodes = sorted({x for e in net for x in e})
    want = _ranks(net, {n: 0.5 if n in ("n03", "z1") else 0.0 for n in nodes})
    written = _tables_written(monkeypatch)
    got = as_dict(it.pagerank(links, 200, seeds=spark.createDataFrame([("n03",), ("z1",)], "node string"), tol=1e-10))
    assert got == pytest.approx(want, abs=2e-9) and len(written) < 6


def test_pagerank_to_a_tolerance_writes_no_table_a_round(links, net, monkeypatch):
    nodes = sorted({x for e in net for x in e})
    written = _tables_written(monkeypatch)
    got = as_dict(it.pagerank(links, 200, tol=1e-10))
    assert got == pytest.approx(_ranks(net, dict.fromkeys(nodes, 1 / len(nodes))), abs=2e-9) and len(written) < 6
    with pytest.raises(RuntimeError, match="rank"):
        it.pagerank(links, 2, tol=1e-10)


def test_spectral_radius_where_powers_swing_or_creep(spark):
    graph_of = lambda e: spark.createDataFrame([(a, b, 1.0) for a, b in e], "src string, dst string, w double").coalesce(1)
    hub = [("hub", f"l{i}") for i in range(30)] + [(f"l{i}", "hub") for i in range(30)] + [("l0", "l1")]
    names = sorted({x for e in hub for x in e})
    w = np.zeros((31, 31))
    for a, b in hub:
        w[names.index(a), names.index(b)] = 1
    top = max(abs(np.linalg.eigvals(w)))
    assert it.spectral_radius(graph_of(hub)) == pytest.approx(top, rel=1e-9)
    k = as_dict(it.katz(graph_of(hub), None, 300, tol=1e-8))
    assert [k[n] for n in names] == pytest.approx(list(np.linalg.solve(np.eye(31) - 0.85 / top * w.T, np.ones(31))), abs=1e-5)
    assert it.spectral_radius(graph_of([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")])) == pytest.approx(1.0, rel=1e-9)
    assert it.spectral_radius(graph_of([(f"c{i:02d}", f"c{i + 1:02d}") for i in range(55)])) == 0.0


def test_eigenvector_next_to_hubs(spark):
    e = [("x", f"a{i}") for i in range(400)] + [(f"b{i}", "y") for i in range(300)] + [("x", "y"), ("z1", "z2")]
    names = sorted({x for p in e for x in p})
    at = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b in e:
        w[at[a], at[b]] = w[at[b], at[a]] = 1
    want = np.abs(np.linalg.eigh(w)[1][:, -1])
    got = as_dict(it.eigenvector(spark.createDataFrame([(a, b, 1.0) for a, b in e], "src string, dst string, w double"), 100, tol=1e-8))
    assert [got[n] for n in names] == pytest.approx(list(want), abs=2e-6)


def test_hits_to_a_tolerance_writes_no_table_a_round(links, net, monkeypatch):
    names = sorted({x for e in net for x in e})
    w = np.zeros((len(names), len(names)))
    for (a, b), v in net.items():
        w[names.index(a), names.index(b)] = v
    u, _, vt = np.linalg.svd(w)
    written = _tables_written(monkeypatch)
    got = {r["node"]: r for r in it.hits(links, 200, tol=1e-9).collect()}
    assert [got[n]["hub"] for n in names] == pytest.approx(list(np.abs(u[:, 0])), abs=2e-6) and [got[n]["authority"] for n in names] == pytest.approx(list(np.abs(vt[0])), abs=2e-6)
    assert len(written) < 6


def test_levels_and_components_write_no_table_a_round(spark, links, monkeypatch):
    written = _tables_written(monkeypatch)
    assert it.trophic_levels(links, tol=1e-10).count() == links.select(F.explode(F.array("src", "dst"))).distinct().count() and len(written) < 8
    chain = spark.createDataFrame([(f"c{i:02d}", f"c{i + 1:02d}", 1.0) for i in range(it.PLAIN + 8)] + [("own", "own", 1.0)], "src string, dst string, w double")
    lv = {r["node"]: (r["component"], r["level"]) for r in it.trophic_levels(chain, tol=1e-10).collect()}
    assert lv == {"own": ("own", 0.0)} | {f"c{i:02d}": ("c00", float(i)) for i in range(it.PLAIN + 9)}


def test_levels_of_months_in_one_run(spark, monkeypatch):
    from flowquarry.plans import studies

    written = _tables_written(monkeypatch)
    e = _edges(spark, [("2024-01", "a", "b", 500, 1), ("2024-01", "b", "c", 500, 1), ("2024-02", "c", "b", 500, 1), ("2024-02", "b", "a", 500, 1), ("2024-02", "d|e", "d|e", 500, 1)])
    got = {(r["time_key"], r["node"]): r["level"] for r in studies.of_month(it.trophic_levels(studies.by_month(e))).collect()}
    assert got == {("2024-01", "a"): 0.0, ("2024-01", "b"): 1.0, ("2024-01", "c"): 2.0, ("2024-02", "c"): 0.0, ("2024-02", "b"): 1.0, ("2024-02", "a"): 2.0, ("2024-02", "d|e"): 0.0}
    assert "cg" not in written


def test_current_flow_of_whole_graphs_and_of_rounds(links, monkeypatch):
    written = _tables_written(monkeypatch)
    whole = as_dict(it.current_flow(links, k=6))
    assert len(written) < 16
    monkeypatch.setattr(it, "WHOLE", 0)
    assert as_dict(it.current_flow(links, k=6)) == pytest.approx(whole, abs=1e-5) and max(whole.values()) > 0
    monkeypatch.undo()
    with pytest.raises(RuntimeError, match="residual"):
        it.current_flow(links, k=6, rounds=1)


def _dense_levels(links):
    """{(month, node): level} of (month, source, dest, w) by least squares, unrounded."""
    out = {}
    for month in {r[0] for r in links}:
        e = [r for r in links if r[0] == month]
        nodes = sorted({x for r in e for x in r[1:3]})
        at = {n: i for i, n in enumerate(nodes)}
        w, label = np.zeros((len(nodes), len(nodes))), np.arange(len(nodes))
        for _, a, b, x in e:
            if a != b:
                w[at[a], at[b]] += x
                label[label == max(label[at[a]], label[at[b]])] = min(label[at[a]], label[at[b]])
        h = np.linalg.lstsq(np.diag(w.sum(0) + w.sum(1)) - w - w.T, w.sum(0) - w.sum(1), rcond=1e-13)[0]
        out |= {(month, n): h[i] - h[label == label[i]].min() for n, i in at.items()}
    return out


def test_hierarchy_roles_of_months_without_rounds_of_jobs(spark, folder, duck, monkeypatch):
    from flowquarry.plans import load_registry
    from flowquarry.plans.base import E

    want = _dense_levels(duck.sql(E + "SELECT time_key, source, dest, round(ln(1 + cents / 100.0), 9) AS w FROM e WHERE cents > 0").fetchall())
    written = _tables_written(monkeypatch)
    rows = load_registry().queries()["r02_hierarchy_roles"](spark, folder).collect()
    assert written == ["edges", "levels"]
    assert {(r["time_key"], r["node"]): r["trophic_level"] for r in rows} == pytest.approx(want, abs=5.1e-5) and len(rows) == len(want)
    assert {r["hierarchy_role"] for r in rows} == {"upstream_supplier", "midstream", "downstream_buyer"}


def test_levels_of_small_and_of_large_months(spark, monkeypatch):
    from flowquarry.plans import studies

    rng = random.Random(3)
    pairs = {(f"2024-{m:02d}", f"n{rng.randint(0, 14)}", f"n{rng.randint(15, 30)}") for m in (1, 2) for _ in range(20 * m)}
    chain = [("2024-03", f"c{i:03d}", f"c{i + 1:03d}", 500, 1) for i in range(120)] + [("2024-03", "d|e", "d|e", 500, 1), ("2024-03", "nothing", "paid", 0, 1), ("2024-04", "own", "own", 7, 1), ("2024-05", "nothing", "paid", 0, 1)]
    rows = [(*p, rng.randint(1, 90000), 1) for p in sorted(pairs)] + chain
    want = _dense_levels([(m, a, b, round(math.log1p(c / 100), 9)) for m, a, b, c, _ in rows if c])
    e = _edges(spark, rows)
    levels = lambda: {(r["time_key"], r["node"]): r["level"] for r in studies.month_levels(e).collect()}
    whole = levels()
    assert whole == pytest.approx(want, abs=5.1e-5) and whole["2024-03", "c120"] == 120 and whole["2024-03", "d|e"] == 0 and whole["2024-04", "own"] == 0
    monkeypatch.setattr(it, "GROUP", 30)  # one month and the chain go over blocks
    assert levels() == pytest.approx(whole, abs=1e-4)
    with pytest.raises(Exception, match="residual"):
        it.levels_of_groups(studies.by_month(e).withColumn("time_key", F.lit("all")), "time_key", rounds=2).collect()
