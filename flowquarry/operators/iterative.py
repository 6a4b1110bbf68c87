"""Iterative graph algorithms: a driver loop over joins, with the state written to the shared folder each round.

``links`` is (src, dst, w). The links are partitioned once by the join key and held for the loop; the state is one row a node, and only
the last two states stay on disk. A lost executor costs at most a round. Algorithms with an exact end run to it; those that approach a limit take a number of rounds, or a tolerance and a bound.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowquarry.operators.blocks import BITS, Arrays, Matrix, numbered
from flowquarry.operators.edges import incidence
from flowquarry.session import Latest, cut, held

EVERY = 5


def window_links(edges: DataFrame, log: bool = False) -> DataFrame:
    """(src, dst, w) summed over the window, w in dollars or log1p of dollars; self-edges stay."""
    s = edges.groupBy(F.col("source").alias("src"), F.col("dest").alias("dst")).agg(F.sum("cents").alias("c"))
    w = F.col("c") / F.lit(100.0)
    return s.select("src", "dst", (F.round(F.log1p(w), 9) if log else w).alias("w")).filter("w > 0")


def undirected(links: DataFrame) -> DataFrame:
    """(src, dst) both ways, each pair once each way, without self-edges."""
    both = links.filter("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("x")).select("x.src", "x.dst")
    return both.distinct()


def both_ways(links: DataFrame) -> DataFrame:
    """(src, dst, w) symmetrised: the weights of both directions together, each pair once each way; self-edges out."""
    both = links.filter("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("x"), "w").select("x.src", "x.dst", "w")
    return both.groupBy("src", "dst").agg(F.round(F.sum("w"), 6).alias("w"))


def node_names(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, label: str) -> DataFrame:
    """A number of steps, each cut, as a step may read its state twice."""
    latest = Latest(label)
    for _ in range(rounds):
        state = latest(step(state))
    return state


def until_fixed(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str, label: str) -> DataFrame:
    """Steps until no row's ``changed`` is true. For steps that move one way only, so that they end whatever the graph."""
    latest = Latest(label)
    while True:
        state = latest(step(state))
        if not state.filter(changed).limit(1).collect():
            return state


def gap(new: DataFrame, old: DataFrame, c: str) -> float:
    """Largest change of ``c`` over the nodes."""
    return new.select("node", c).join(old.select("node", F.col(c).alias("was")), "node").agg(F.max(F.abs(F.col(c) - F.col("was")))).first()[0] or 0.0


def until_near(state: DataFrame, step: Callable[[DataFrame], DataFrame], c: str, tol: float, most: int, label: str) -> DataFrame:
    """Steps until no node's ``c`` changes by more than ``tol``; fails after ``most``."""
    latest = Latest(label, keep=2)
    state = latest(state)
    for _ in range(most):
        old, state = state, latest(step(state))
        if gap(state, old, c) <= tol:
            return state
    raise RuntimeError(f"{label} did not come within {tol} in {most} rounds")


def pagerank(links: DataFrame, rounds: int = 20, damping: float = 0.85, seeds: DataFrame | None = None, digits: int = 9, tol: float | None = None) -> DataFrame:
    """(node, pagerank): weighted, directed, the mass of nodes without out-links spread as the teleport is. ``seeds`` (node) makes it personalised. With ``tol``, ``rounds`` is a bound."""
    nodes = node_names(links)
    if seeds is None:
        base = nodes.withColumn("t", F.lit(1.0) / nodes.agg(F.count(F.lit(1))).scalar())
    else:
        hit = nodes.join(seeds.select("node").distinct().withColumn("s", F.lit(1.0)), "node", "left")
        base = hit.select("node", (F.coalesce("s", F.lit(0.0)) / hit.agg(F.sum("s")).scalar()).alias("t"))
    numbers = numbered(links)

    def ready(v: Arrays, total: np.ndarray) -> Arrays:
        return v[0], v[0], total

    with Matrix(numbers, links) as m:
        state = m.sent(m.state(numbers.join(base, "node").select("id", "t")), ready)  # rank, teleport, outgoing weight
        kept = state.map(lambda r: float(r[1][0][0][r[1][0][2] > 0].sum())).sum()
        for _ in range(rounds):

            def step(v: Arrays, came: np.ndarray, kept: float = kept) -> tuple[Arrays, tuple]:
                r = (1 - damping) * v[1] + damping * (came + (1 - kept) * v[1])
                return (r, *v[1:]), (float(r[v[2] > 0].sum()), float(np.abs(r - v[0]).max(initial=0)))

            state, said = m.step(state, lambda v: v[0] / np.where(v[2] > 0, v[2], 1), step)
            kept = math.fsum(x[0] for x in said)
            if tol is not None and max(x[1] for x in said) <= tol:
                break
        else:
            if tol is not None:
                raise RuntimeError(f"rank did not come within {tol} in {rounds} rounds")
        rank = m.frame(state, ["r"], "rank")
    return rank.select("node", F.round("r", digits).alias("pagerank"))


def hits(links: DataFrame, rounds: int = 20, digits: int = 6, tol: float | None = None) -> DataFrame:
    """(node, hub, authority): weighted, each scaled to unit length every round. With ``tol``, ``rounds`` is a bound. The links are held twice, by either end."""
    numbers = numbered(links)
    size = lambda said: math.sqrt(math.fsum(x[0] for x in said)) or 1.0
    gap = lambda said: max((x[1] for x in said), default=0.0)
    hub_size = 1.0
    with Matrix(numbers, links) as m, Matrix(numbers, links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")) as back:
        state = m.state(numbers.select("id", *(F.lit(x).alias(c) for c, x in (("h", 1.0), ("a", 0.0), ("h_was", 1.0), ("a_was", 0.0)))))
        for i in range(rounds):

            def to_authorities(v: Arrays, a: np.ndarray, hub_size: float = hub_size) -> tuple[Arrays, tuple]:
                h = v[0] / hub_size
                return (h, a, v[2], v[3]), (float(a @ a), float(np.abs(h - v[2]).max(initial=0)))

            state, said = m.step(state, lambda v, hub_size=hub_size: v[0] / hub_size, to_authorities)
            auth_size, hub_gap = size(said), gap(said)

            def to_hubs(v: Arrays, h: np.ndarray, auth_size: float = auth_size) -> tuple[Arrays, tuple]:
                a = v[1] / auth_size
                return (h, a, v[0], a), (float(h @ h), float(np.abs(a - v[3]).max(initial=0)))

            state, said = back.step(state, lambda v, auth_size=auth_size: v[1] / auth_size, to_hubs)
            hub_size = size(said)
            if tol is not None and i and hub_gap <= tol and gap(said) <= tol:  # the hubs' gap is that of the round before
                break
        else:
            if tol is not None:
                raise RuntimeError(f"hits did not come within {tol} in {rounds} rounds")
        out = m.frame(state, ["h", "a"], "hits")
    return out.select("node", F.round(F.col("h") / hub_size, digits).alias("hub"), F.round("a", digits).alias("authority"))


def eigenvector(links: DataFrame, rounds: int = 20, digits: int = 6, tol: float | None = None) -> DataFrame:
    """(node, eigenvector) of the undirected graph: so many rounds with the identity added, which has the same vectors and converges on bipartite graphs too.

    With ``tol``, the limit of these rounds, until no node changes by more; ``rounds`` is a bound. Next to hubs the least eigenvalue almost has the size of the largest, so plain rounds would take thousands;
    here each round takes the best vector within the last one, its residual and the last move (conjugate gradients of the Rayleigh quotient).
    """
    u = cut(undirected(links).withColumn("w", F.lit(1.0)), "undirected")
    numbers = numbered(u)
    n = numbers.count()
    size = math.sqrt(n) or 1.0
    with Matrix(numbers, u) as m:
        state = m.state(numbers.select("id", F.lit(1.0 / size).alias("x")))
        if tol is None:
            size = 1.0
            for _ in range(rounds):

                def plain(v: Arrays, y: np.ndarray, size: float = size) -> tuple[Arrays, tuple]:
                    x = v[0] / size + y
                    return (x,), (float(x @ x),)

                state, said = m.step(state, lambda v, size=size: v[0] / size, plain)
                size = math.sqrt(math.fsum(x[0] for x in said)) or 1.0
            return m.frame(state, ["x"], "eigenvector").select("node", F.round(F.col("x") / size, digits).alias("eigenvector"))

        def first(v: Arrays, y: np.ndarray) -> tuple[Arrays, tuple]:
            none = np.zeros(len(y))
            return (v[0], none, none, y, none, none), (float(v[0] @ y),)

        state, said = m.step(state, lambda v: v[0], first)
        value, by = math.fsum(x[0] for x in said), np.array([1.0, 0.0, 0.0])
        for i in range(rounds):

            def moved(v: Arrays, by: np.ndarray = by, value: float = value) -> Arrays:
                """Vector, residual and move, from the last three and their products."""
                x, ax = by[0] * v[0] + by[1] * v[1] + by[2] * v[2], by[0] * v[3] + by[1] * v[4] + by[2] * v[5]
                return x, ax - value * x, by[1] * v[1] + by[2] * v[2], ax, by[1] * v[4] + by[2] * v[5]

            def products(v: Arrays, y: np.ndarray, moved: Callable = moved) -> tuple[Arrays, tuple]:
                x, w, p, ax, ap = moved(v)
                s, a = np.array([x, w, p]), np.array([ax, y, ap])
                return (x, w, p, ax, y, ap), (s @ s.T, s @ a.T, float(np.abs(x - v[0]).max(initial=0)))

            state, said = m.step(state, lambda v, moved=moved: moved(v)[1], products)
            gram, form = sum((x[0] for x in said), np.zeros((3, 3))), sum((x[1] for x in said), np.zeros((3, 3)))
            if gram[1, 1] <= (1e-14 * value) ** 2 or i and max(x[2] for x in said) <= tol:
                break
            scale = np.array([1 / math.sqrt(g) if g > 0 else 0.0 for g in np.diag(gram)])
            lengths, axes = np.linalg.eigh(gram * np.outer(scale, scale))
            white = scale[:, None] * axes[:, lengths > 1e-12] / np.sqrt(lengths[lengths > 1e-12])
            values, vectors = np.linalg.eigh(white.T @ (form + form.T) @ white / 2)
            value, by = float(values[-1]), white @ vectors[:, -1]
            by = by * (1 if by[0] >= 0 else -1)
        else:
            raise RuntimeError(f"eigenvector did not come within {tol} in {rounds} rounds")
        x = m.frame(state, ["x"], "eigenvector")
    return x.select("node", F.round(F.greatest("x", F.lit(0.0)), digits).alias("eigenvector"))


def _simple(links: DataFrame) -> DataFrame:
    return cut(links.select("src", "dst").distinct().withColumn("w", F.lit(1.0)), "simple")


def katz(links: DataFrame, alpha: float | None, rounds: int = 20, digits: int = 6, tol: float | None = None) -> DataFrame:
    """(node, katz): x = 1 + alpha * sum of x over in-neighbours, directed and unweighted; alpha must lie below one over the largest eigenvalue.

    Without ``alpha`` it is 0.85 over that eigenvalue (over 1 if there are no cycles). With ``tol``, ``rounds`` is a bound.
    """
    e = _simple(links)
    numbers = numbered(e)
    with Matrix(numbers, e) as m:
        if alpha is None:
            alpha = 0.85 / (_radius(m, e) or 1.0)
        state = m.state(numbers.select("id", F.lit(1.0).alias("x")))

        def step(v: Arrays, y: np.ndarray, alpha: float = alpha) -> tuple[Arrays, tuple]:
            x = 1 + alpha * y
            return (x,), (float(np.abs(x - v[0]).max(initial=0)),)

        for _ in range(rounds):
            state, said = m.step(state, lambda v: v[0], step)
            if tol is not None and max((x[0] for x in said), default=0.0) <= tol:
                break
        else:
            if tol is not None:
                raise RuntimeError(f"katz did not come within {tol} in {rounds} rounds")
        x = m.frame(state, ["x"], "katz")
    return x.select("node", F.round("x", digits).alias("katz"))


def spectral_radius(links: DataFrame) -> float:
    """Largest eigenvalue of the directed unweighted adjacency matrix, to 11 digits; 0 if there are no cycles."""
    e = _simple(links)
    with Matrix(numbered(e), e) as m:
        return _radius(m, e)


def _radius(m: Matrix, links: DataFrame, rounds: int = 200) -> float:
    """By powers of the matrix with half the value added to its diagonal: plain powers swing for ever between two values where hubs pay and are paid. The largest quotient of a node's
    value and its last one bounds the eigenvalue from above, so it ends when the growth has come to that bound.

    Where two strong components with one radius follow each other, powers grow like k times the k-th power and come to the bound only slowly; then only links within strong components are kept, which leaves the eigenvalues as they are.
    """
    state = m.state(m.nodes.select("id", F.lit(1.0).alias("x")))
    n = -1.0
    while n:  # nodes that no cycle leads to fall out
        state, said = m.step(state, lambda v: v[0], lambda v, y: (((y > 0) * v[0],), (float(np.count_nonzero((y > 0) * v[0])),)))
        was, n = n, math.fsum(x[0] for x in said)
        if n == was:
            break
    if not n:
        return 0.0
    size, add = math.sqrt(n), 1.0
    for i in range(rounds):

        def step(v: Arrays, y: np.ndarray, size: float = size, add: float = add) -> tuple[Arrays, tuple]:
            x = v[0] / size
            y = y + add * x
            there = x > 1e-200
            return (y,), (float(y @ y), float((y[there] / x[there]).max(initial=0)))

        state, said = m.step(state, lambda v, size=size: v[0] / size, step)
        size = math.sqrt(math.fsum(x[0] for x in said))
        value, most = size - add, max(x[1] for x in said) - add
        if i >= 10 and most - value <= 1e-11 * most:
            return value
        if i < 10:
            add = max(0.5, value / 2)
    scc = strong_components(links)
    if rounds > 1000:
        raise RuntimeError(f"spectral radius: between {value} and {most} after {rounds} rounds")
    inner = links.join(scc.select(F.col("node").alias("src"), F.col("scc").alias("a")), "src").join(scc.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst").filter("a = b").select("src", "dst", "w")
    inner = cut(inner, "inner")
    with Matrix(numbered(inner), inner) as within:
        return _radius(within, inner, 3000)


def components(links: DataFrame) -> DataFrame:
    """(node, component): weak components, each named by its least node. Labels only fall, so it ends: as a rule within ``PLAIN`` rounds over blocks; where chains are longer, in joins that halve them."""
    u = cut(undirected(links).withColumn("w", F.lit(1.0)), "undirected")
    with Matrix(numbered(u), u) as m:
        found = _components(m)
    if found is None:
        found = _components_of_chains(u.select("src", "dst"))
    alone = node_names(links).join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)


PLAIN = 40


def _components(m: Matrix) -> DataFrame | None:
    """Those of a matrix that has its links both ways, or nothing if they are not settled after ``PLAIN`` rounds."""
    state = m.state(m.nodes.select("id", F.col("id").cast("double").alias("label")))

    def step(v: Arrays, y: np.ndarray) -> tuple[Arrays, tuple]:
        label = np.minimum(v[0], y)
        return (label,), (int(np.count_nonzero(label < v[0])),)

    for _ in range(PLAIN):
        state, said = m.step(state, lambda v: v[0], step, least=True)
        if not any(x[0] for x in said):
            labels = m.frame(state, ["label"], "labels")
            return labels.join(labels.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component")
    return None


def _components_of_chains(links: DataFrame) -> DataFrame:
    """The same by joins. Each round takes the least label of the neighbours and then the label's own label, so long chains halve; labels only fall, so it ends."""
    nodes = node_names(links)
    with held(undirected(links).repartition("src")) as u:

        def step(s: DataFrame) -> DataFrame:
            s = s.select("node", "label")
            near = u.join(s.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("n"))
            one = s.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("n", "label")).alias("m"))
            jump = s.select(F.col("node").alias("m"), F.col("label").alias("j"))
            two = one.join(jump, "m", "left").select("node", F.least("m", F.coalesce("j", "m")).alias("new"), "label")
            return two.select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved"))

        out = until_fixed(nodes.withColumn("label", F.col("node")), step, "moved", "components")
    return out.select("node", F.col("label").alias("component"))


def core_numbers(links: DataFrame) -> DataFrame:
    """(node, core) of the undirected simple graph: each node lowers its value to the h-index of its neighbours' values until nothing moves.

    The h-index comes from counts of neighbours by value: at most as many rows as there are different values. Values only fall, so it ends, after as many rounds as the longest
    chain of nodes that fall one by one. A round moves one value a link, combined by node and value before the shuffle.
    """
    with held(undirected(links).repartition("dst")) as u:
        start = u.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("core"))

        def step(s: DataFrame) -> DataFrame:
            s = s.select("node", "core")
            near = u.join(s.select(F.col("node").alias("dst"), F.col("core").alias("v")), "dst")
            hist = near.groupBy(F.col("src").alias("node"), "v").agg(F.count(F.lit(1)).alias("n"))
            w = Window.partitionBy("node").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
            h = hist.select("node", F.least("v", F.sum("n").over(w)).alias("h")).groupBy("node").agg(F.max("h").alias("h"))
            return h.join(s, "node").select("node", F.least("h", "core").alias("core"), (F.col("h") < F.col("core")).alias("moved"))

        cores = until_fixed(start, step, "moved", "cores").select("node", "core")
    alone = node_names(links).join(cores, "node", "left_anti").select("node", F.lit(0).cast("bigint").alias("core"))
    return cores.unionByName(alone)


def _closed(up: DataFrame, carry: list[str]) -> DataFrame:
    """(src, x, y, ...): each triangle once, from oriented links (src, dst, kd, ``carry``), which lead from lower to higher degree; carried columns with the suffixes _sx, _sy, _xy."""
    named = lambda end, tag: [F.col(c).alias(f"{c}_{tag}") for c in carry]
    a = up.select("src", F.col("dst").alias("x"), F.col("kd").alias("kx"), *named("x", "sx"))
    b = up.select("src", F.col("dst").alias("y"), F.col("kd").alias("ky"), *named("y", "sy"))
    first = (F.col("kx") < F.col("ky")) | ((F.col("kx") == F.col("ky")) & (F.col("x") < F.col("y")))
    return a.join(b, "src").filter(first).drop("kx", "ky").join(up.select(F.col("src").alias("x"), F.col("dst").alias("y"), *named("", "xy")), ["x", "y"])


def _oriented(u: DataFrame, deg: DataFrame, carry: list[str]) -> DataFrame:
    e = u.join(deg.select(F.col("node").alias("src"), F.col("k").alias("ks")), "src").join(deg.select(F.col("node").alias("dst"), F.col("k").alias("kd")), "dst")
    return cut(e.filter((F.col("ks") < F.col("kd")) | ((F.col("ks") == F.col("kd")) & (F.col("src") < F.col("dst")))).select("src", "dst", "kd", *carry), "oriented")


def triangles(links: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering) of the undirected simple graph. Edges point from lower to higher degree, so no node starts more than about sqrt(2 m) paths, however large a hub it is."""
    u = cut(undirected(links), "undirected")
    deg = u.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    closed = _closed(_oriented(u, deg, []), [])
    per = closed.select(F.explode(F.array("src", "x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    k, t = F.col("k"), F.coalesce("t", F.lit(0).cast("bigint"))
    return deg.join(per, "node", "left").select("node", k.alias("degree"), t.alias("triangles"), F.round(F.when(k > 1, 2 * t / (k * (k - 1))), 6).alias("clustering"))


def cyclic_triangles(links: DataFrame) -> DataFrame:
    """(node, cyclic) directed cycles a -> b -> c -> a through each node. Each cycle is found once, from its lowest-ranked node, rank being by degree."""
    e = links.filter("src <> dst").select("src", "dst").distinct()
    deg = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    ranked = cut(e.join(deg.select(F.col("node").alias("src"), F.struct("k", F.col("node").alias("n")).alias("rs")), "src").join(deg.select(F.col("node").alias("dst"), F.struct("k", F.col("node").alias("n")).alias("rd")), "dst"), "ranked")
    x = ranked.filter("rs < rd").select(F.col("src").alias("a"), F.col("dst").alias("b"), "rs", F.col("rd").alias("rb"))
    z = ranked.filter("rd < rs").select(F.col("src").alias("c"), F.col("dst").alias("a"), F.col("rs").alias("rc"))
    cycles = x.join(z, "a").filter("b <> c").join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    return cycles.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("cyclic"))


def constraint(links: DataFrame, digits: int = 6) -> DataFrame:
    """(node, constraint): Burt's, on symmetrised weights: sum over neighbours j of (p_ij + sum_q p_iq p_qj)^2.

    Paths i - q - j that count end at a neighbour of i, so they are triangles; each is found once, from its node of lowest degree, and gives its six paths. A hub starts no pairs of its neighbours.
    """
    s = both_ways(links)
    total = s.groupBy("src").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("k"))
    p = s.join(total, "src").select("src", "dst", "w", (F.col("w") / F.col("total")).alias("p"), "k")
    back = total.select(F.col("src").alias("dst"), F.col("total").alias("back_total"))
    p = cut(p.join(back, "dst").select("src", "dst", "p", (F.col("w") / F.col("back_total")).alias("b"), "k"), "shares")
    deg = p.select(F.col("src").alias("node"), "k").distinct()
    t = _closed(_oriented(p.drop("k"), deg, ["p", "b"]), ["p", "b"])  # p along the orientation, b against it
    path = lambda i, j, one, two: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (F.col(one) * F.col(two)).alias("v"))
    six = F.array(path("src", "x", "p_sy", "b_xy"), path("x", "src", "p_xy", "b_sy"), path("src", "y", "p_sx", "p_xy"), path("y", "src", "b_xy", "b_sx"), path("x", "y", "b_sx", "p_sy"), path("y", "x", "b_sy", "p_sx"))
    via = t.select(F.explode(six).alias("z")).select("z.*").groupBy("i", "j").agg(F.sum("v").alias("v"))
    direct = p.select(F.col("src").alias("i"), F.col("dst").alias("j"), "p")
    c = direct.join(via, ["i", "j"], "left").select("i", F.pow(F.col("p") + F.coalesce("v", F.lit(0.0)), 2).alias("c"))
    return c.groupBy(F.col("i").alias("node")).agg(F.round(F.sum("c"), digits).alias("constraint"))


def sample_nodes(links: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k nodes in the order of a hash: the same ones every time. A bounded sample, as the sampled metrics need one."""
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "node")), "node").limit(k)


def distances(links: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """(seed, node, dist, paths): unweighted breadth-first levels from each seed along links, and the number of shortest paths. Without ``hops`` it goes on until nothing new is reached."""
    e = cut(links.select("src", "dst").distinct(), "links")
    seen = cut(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("dist"), F.lit(1.0).alias("paths")), "levels")
    front = seen
    for level in itertools.count(1) if hops is None else range(1, hops + 1):
        came = front.join(e, front["node"] == e["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = cut(came.join(seen, ["seed", "node"], "left_anti").select("seed", "node", F.lit(level).alias("dist"), "paths"), "levels")
        if not front.limit(1).collect():
            break
        seen = seen.unionByName(front)
        if level % EVERY == 0:
            seen = cut(seen, "seen")
    return seen


def betweenness(links: DataFrame, k: int = 128, seed: int = 0, digits: int = 6) -> DataFrame:
    """(node, betweenness): unweighted, directed, from k sampled sources, scaled by n / k; ends don't count. Levels forward, then dependencies back."""
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    e = cut(links.filter("src <> dst").select("src", "dst").distinct(), "links")
    d = cut(distances(e, cut(sample_nodes(links, k, seed), "sources")), "levels")
    deepest = d.agg(F.max("dist")).first()[0] or 0
    n_nodes = nodes.count()
    dep = add = None
    for level in range(deepest, 0, -1):
        low = d.filter(F.col("dist") == level)
        if add is not None:  # holds the nodes of this level
            low = low.join(add, ["seed", "node"], "left")
        else:
            low = low.withColumn("delta", F.lit(0.0))
        coef = low.select("seed", F.col("node").alias("dst"), ((1 + F.coalesce("delta", F.lit(0.0))) / F.col("paths")).alias("c"))
        up = d.filter(F.col("dist") == level - 1).select("seed", F.col("node").alias("src"), F.col("paths").alias("p"))
        add = cut(coef.join(e, "dst").join(up, ["seed", "src"]).groupBy("seed", F.col("src").alias("node")).agg(F.sum(F.col("p") * F.col("c")).alias("delta")), "dependency")
        dep = add if dep is None else dep.unionByName(add)
        if level % EVERY == 0:
            dep = cut(dep, "dependency")
    if dep is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    total = dep.filter("seed <> node").groupBy("node").agg(F.sum("delta").alias("b"))
    scale = F.lit(n_nodes / min(k, max(n_nodes, 1)))
    return nodes.join(total, "node", "left").select("node", F.round(F.coalesce("b", F.lit(0.0)) * scale, digits).alias("betweenness"))


def landmark_pairs(degree: DataFrame, k: int, seed: int = 11) -> DataFrame:
    """(pair, s, t): k pairs of nodes drawn with the weight ``d`` of ``degree`` (node, d), pairs of one node left out. Seeded: the least of exponential draws is a draw by weight."""
    each = degree.filter("d > 0").select("node", "d", F.explode(F.sequence(F.lit(0), F.lit(2 * k - 1))).alias("i"))
    u = (F.shiftrightunsigned(F.xxhash64("node", "i", F.lit(seed)), 11) + 1) / F.lit(2.0**53 + 1)
    drawn = each.groupBy("i").agg(F.min_by("node", F.struct(-F.log(u) / F.col("d"), F.col("node"))).alias("node"))
    pair = F.floor(F.col("i") / 2)
    ends = drawn.groupBy(pair.alias("pair")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("node"))).alias("s"), F.max(F.when(F.col("i") % 2 == 1, F.col("node"))).alias("t"))
    return ends.filter("s <> t")


def current_flow(links: DataFrame, k: int = 64, seed: int = 11, digits: int = 6, rounds: int = 1000, tol: float = 1e-6, pairs: DataFrame | None = None) -> DataFrame:
    """(node, current_flow): random-walk betweenness from k landmark pairs, on the undirected weighted graph: the current through a node when a unit enters at s and leaves at t, s and t themselves out, in the mean over pairs.

    The pairs' potentials are solved by conjugate gradients with a diagonal preconditioner: pair by pair in tasks that hold the whole graph up to ``WHOLE`` links, beyond that all together in joins. A hair is added
    to the diagonal, as the Laplacian is singular. Fails if the residual is not below ``tol`` of the first one after ``rounds``. Nodes that no landmark's component holds have 0.
    """
    both = cut(both_ways(links), "both")
    degree = cut(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d")), "degree")
    marks = cut(landmark_pairs(degree, k, seed) if pairs is None else pairs, "landmarks")
    n_pairs = marks.count()
    if n_pairs == 0:
        return node_names(links).select("node", F.lit(0.0).alias("current_flow"))
    eps = 1e-8 * (degree.agg(F.avg("d")).first()[0] or 1.0)
    # A pair has rows only where its current may run: the nodes of its landmarks' component.
    comp = cut(components(both), "components")
    of = cut(comp.select(F.col("node").alias("s"), "component").join(marks, "s").join(comp.select(F.col("node").alias("t"), F.col("component").alias("other")), "t").filter("component = other").select("pair", "s", "t", "component"), "pairs")
    if both.count() <= WHOLE:
        through = _flow_of_pairs(both, of, eps, rounds, tol)
    else:
        through = _flow_of_rounds(both, comp, degree, of, eps, rounds, tol)
    mean = through.select("node", (F.col("c") / n_pairs).alias("c"))
    return cut(node_names(links).join(mean, "node", "left").select("node", F.round(F.coalesce("c", F.lit(0.0)), digits).alias("current_flow")), "flow")


#: Links (both ways) that a task takes whole, 16 bytes each, to solve pairs of its own.
WHOLE = 8_000_000


def _flow_of_pairs(both: DataFrame, of: DataFrame, eps: float, rounds: int, tol: float) -> DataFrame:
    """(node, c): each task has the whole graph as arrays and solves some of the pairs, so a pair's rounds move nothing; the residual of each pair is below ``tol`` of its first one."""
    numbers = numbered(both)
    sc = both.sparkSession.sparkContext
    names = cut(numbers.select("node", (F.row_number().over(Window.partitionBy(F.shiftright("id", BITS)).orderBy("id")) - 1).alias("k"), F.shiftright("id", BITS).alias("part")), "names")
    sizes = {r["part"]: r["n"] for r in names.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = {p: sum(n for q, n in sizes.items() if q < p) for p in sizes}
    offset = F.create_map(*(F.lit(x) for p, n in before.items() for x in (p, n)))
    at = names.select("node", (F.col("k") + offset[F.col("part")]).cast("int").alias("i"))
    end = lambda c: at.select(F.col("node").alias(c), F.col("i").alias(f"{c}_i"))
    rows = both.join(end("src"), "src").join(end("dst"), "dst").select("src_i", "dst_i", "w").mapInPandas(_packed, "a binary, b binary, w binary").collect()
    a, b, w = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in enumerate((np.int32, np.int32, np.float64)))
    del rows
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]).astype(np.int32)
    graph = sc.broadcast((starts, b, w))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, b, w = graph.value
        times = lambda v: np.add.reduceat(w * v[b], starts)
        u = times(np.ones(len(starts))) + eps
        own = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(b)]))
        total, solved = np.zeros(len(starts)), False
        for f in frames:
            for s, t in zip(f["s_i"], f["t_i"], strict=True):
                h, r = np.zeros(len(starts)), np.zeros(len(starts))
                r[s], r[t] = 1.0, -1.0
                p = r / u
                rz = start = float(r @ p)
                for _ in range(rounds):
                    if rz <= tol * tol * start:
                        break
                    ap = u * p - times(p)
                    step = rz / float(p @ ap)
                    h += step * p
                    r -= step * ap
                    z = r / u
                    was, rz = rz, float(r @ z)
                    p = z + rz / was * p
                if rz > tol * tol * start:
                    yield pd.DataFrame({"i": [-1], "c": [(rz / start) ** 0.5]})
                c = np.add.reduceat(np.abs(w * (h[own] - h[b])), starts) / 2
                c[s] = c[t] = 0.0
                total, solved = total + c, True
        if solved:
            yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "c": total})

    pairs = of.join(end("s"), "s").join(end("t"), "t").select("pair", "s_i", "t_i")
    found = cut(pairs.repartition(sc.defaultParallelism, "pair").mapInPandas(solve, "i int, c double"), "currents")
    graph.unpersist()
    worst = found.filter("i < 0").agg(F.max("c")).first()[0]
    if worst is not None:
        raise RuntimeError(f"current flow: residual {worst:.1e} of the first after {rounds} rounds, {tol} wanted")
    return found.groupBy("i").agg(F.sum("c").alias("c")).join(at, "i").select("node", "c")


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame([tuple(f[c].to_numpy(t).tobytes() for c, t in (("src_i", np.int32), ("dst_i", np.int32), ("w", np.float64)))], columns=["a", "b", "w"])


def _flow_of_rounds(both: DataFrame, comp: DataFrame, degree: DataFrame, of: DataFrame, eps: float, rounds: int, tol: float) -> DataFrame:
    """The same for graphs of any size: all pairs' potentials as one block system, a row for each node and pair, one join with the links a round."""
    b = F.when(F.col("node") == F.col("s"), 1.0).when(F.col("node") == F.col("t"), -1.0).otherwise(0.0)
    x = comp.join(F.broadcast(of), "component").join(degree, "node").select("node", "pair", (F.col("d") + eps).alias("u"), b.alias("r"))
    latest = Latest("currents")
    x = latest(x.select("node", "pair", "u", F.lit(0.0).alias("h"), "r", (F.col("r") / F.col("u")).alias("p")))
    rz = start = x.agg(F.sum(F.col("r") * F.col("r") / F.col("u"))).first()[0] or 0.0
    with held(both.repartition("src")) as links_:
        for _ in range(rounds):
            if rz <= tol * tol * start:
                break
            wp = links_.join(x.select("node", "pair", "p"), links_["src"] == F.col("node")).groupBy(F.col("dst").alias("node"), "pair").agg(F.sum(F.col("w") * F.col("p")).alias("wp"))
            y = latest(x.join(wp, ["node", "pair"]).withColumn("ap", F.col("u") * F.col("p") - F.col("wp")))
            a = rz / y.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
            y = y.select("node", "pair", "u", (F.col("h") + a * F.col("p")).alias("h"), (F.col("r") - a * F.col("ap")).alias("r"), "p")
            new = y.agg(F.sum(F.col("r") * F.col("r") / F.col("u"))).first()[0] or 0.0
            x = y.withColumn("p", F.col("r") / F.col("u") + F.lit(new / rz) * F.col("p"))
            rz = new
        if rz > tol * tol * start:
            raise RuntimeError(f"current flow: residual {(rz / start) ** 0.5:.1e} of the first after {rounds} rounds, {tol} wanted")
        h = x.select("node", "pair", "h")
        at = links_.join(h, links_["src"] == F.col("node")).select("src", "dst", "w", "pair", F.col("h").alias("hs"))
        cur = at.join(h.select(F.col("node").alias("dst"), "pair", F.col("h").alias("hd")), ["dst", "pair"]).groupBy(F.col("src").alias("node"), "pair").agg((F.sum(F.abs(F.col("w") * (F.col("hs") - F.col("hd")))) / 2).alias("c"))
        through = cur.join(F.broadcast(of.select("pair", "s", "t")), "pair").filter("node <> s and node <> t").groupBy("node").agg(F.sum("c").alias("c"))
        return cut(through, "through")


def trophic_levels(links: DataFrame, rounds: int = 1000, tol: float = 1e-6) -> DataFrame:
    """(node, component, level): solves (diag(u) - W - W') h = v per weak component by conjugate gradients with a diagonal preconditioner; each component's least level is 0.

    One product and a few sums a round; it fails if the residual is not below ``tol`` of the first one after ``rounds``. u is in plus out weight, v in minus out weight.
    """
    s = links.filter("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    both = cut(s.select(F.explode(F.array(F.struct("src", "dst", F.lit(-1.0).alias("s")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("s")))).alias("x"), "w").select("x.*", "w"), "both")
    x = both.groupBy("src").agg(F.sum("w").alias("u"), F.sum(F.col("w") * F.col("s")).alias("v"))
    numbers = numbered(both)
    none = F.lit(0.0)
    with Matrix(numbers, both) as m:
        found = _components(m)
        state = m.state(numbers.join(x, numbers["node"] == x["src"]).select("id", "u", none.alias("h"), F.col("v").alias("r"), none.alias("p"), none.alias("ap")))
        a = b = 0.0
        rz = start = None
        for _ in range(rounds):

            def moved(v: Arrays, a: float = a, b: float = b) -> Arrays:
                r = v[2] - a * v[4]
                return v[0], v[1] + a * v[3], r, r / v[0] + b * v[3]

            def step(v: Arrays, y: np.ndarray, moved: Callable = moved) -> tuple[Arrays, tuple]:
                u, h, r, p = moved(v)
                ap = u * p - y
                return (u, h, r, p, ap), (float(r @ (r / u)), float(p @ ap), float(r @ (ap / u)), float(ap @ (ap / u)))

            state, said = m.step(state, lambda v, moved=moved: moved(v)[3], step)
            rz, pap, rq, qq = (math.fsum(x[k] for x in said) for k in range(4))
            start = rz if start is None else start
            if rz <= tol * tol * start or not pap:
                break
            a = rz / pap
            b = max(0.0, rz - 2 * a * rq + a * a * qq) / rz  # the next residual's size, known before it is there
        h = m.frame(state.map(lambda r: (r[0], ((r[1][0][1],), ())), True), ["h"], "levels")
    if (rz or 0.0) > tol * tol * (start or 0.0):
        raise RuntimeError(f"trophic levels: residual {(rz / start) ** 0.5:.1e} of the first after {rounds} rounds, {tol} wanted")
    if found is None:
        found = _components_of_chains(both.select("src", "dst").distinct())
    alone = node_names(links).join(found, "node", "left_anti").select("node", F.col("node").alias("component"), none.alias("h"))
    out = cut(found.join(h, "node").unionByName(alone), "levels")
    low = out.groupBy("component").agg(F.min("h").alias("low"))
    return out.join(low, "component").select("node", "component", F.round(F.col("h") - F.col("low"), 4).alias("level"))


#: Links of a group that a task takes whole, some 250 bytes each while it solves them.
GROUP = 1_500_000


def levels_of_groups(links: DataFrame, key: str, rounds: int = 20_000, tol: float = 1e-12) -> DataFrame:
    """(key, node, level): the levels of ``trophic_levels`` for each group of links (key, src, dst, w) as a graph of its own. A task holds a group as arrays, so its rounds move nothing; groups beyond ``GROUP`` links are not for it.

    Fails if a residual is not below ``tol`` of its node's weight after ``rounds``. The result does not depend on the order of rows.
    """

    def solve(t: pa.Table) -> pa.Table:
        ends = pa.chunked_array([*t["src"].chunks, *t["dst"].chunks]).combine_chunks().dictionary_encode()
        by_name = pc.sort_indices(ends.dictionary).to_numpy()
        names, n = ends.dictionary.take(by_name), len(by_name)
        place = np.empty(n, np.int32)
        place[by_name] = np.arange(n, dtype=np.int32)
        at = place[ends.indices.to_numpy()]
        del ends, place, by_name
        other = at[: len(t)] != at[len(t) :]
        level = _levels(n, at[: len(t)][other], at[len(t) :][other], t["w"].to_numpy()[other], rounds, tol)
        return pa.table({key: pa.repeat(t[key][0], n), "node": names, "level": level})

    return links.select(key, "src", "dst", F.col("w").cast("double").alias("w")).groupBy(key).applyInArrow(solve, f"{key} {links.schema[key].dataType.simpleString()}, node string, level double")


def _levels(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int, tol: float) -> np.ndarray:
    """Levels of nodes 0 to n - 1 over links from a to b, without self-links."""
    if not len(a):
        return np.zeros(n)
    own, to = np.r_[a, b], np.r_[b, a]
    order = np.lexsort((to, own)).astype(np.int32)
    own, to, w, out_links = own[order], to[order], np.r_[w, w][order], order < len(a)
    del a, b, order
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]).astype(np.int32)
    nodes = own[starts]
    place = np.zeros(n, np.int32)
    place[nodes] = np.arange(len(nodes), dtype=np.int32)
    to = place[to]
    label = np.arange(len(nodes), dtype=np.int32)
    while True:  # labels only fall
        least = np.minimum(label, np.minimum.reduceat(label[to], starts))
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    u, r, h = np.add.reduceat(w, starts), np.add.reduceat(np.where(out_links, -w, w), starts), np.zeros(len(nodes))
    del own, out_links
    p = z = r / u
    rz, left = float(r @ z), float(np.abs(z).max())
    for _ in range(rounds):
        if left <= tol:
            break
        ap = u * p - np.add.reduceat(w * p[to], starts)
        step = rz / float(p @ ap)
        h += step * p
        r -= step * ap
        z = r / u
        was, rz, left = rz, float(r @ z), float(np.abs(z).max())
        p = z + rz / was * p
    if left > tol:
        raise RuntimeError(f"trophic levels: residual {left:.1e} of a node's weight after {rounds} rounds, {tol} wanted")
    low = np.full(len(nodes), np.inf)
    np.minimum.at(low, label, h)
    out = np.zeros(n)
    out[nodes] = np.round(h - low[label], 4)
    return out


def trophic_incoherence(links: DataFrame, levels: DataFrame) -> DataFrame:
    """(f0, f0_root): weighted mean squared deviation of level steps from 1, and its root."""
    e = links.filter("src <> dst").join(levels.select(F.col("node").alias("src"), F.col("level").alias("a")), "src").join(levels.select(F.col("node").alias("dst"), F.col("level").alias("b")), "dst")
    f = F.sum(F.col("w") * F.pow(F.col("b") - F.col("a") - 1, 2)) / F.sum("w")
    return e.agg(F.round(f, 4).alias("f0"), F.round(F.sqrt(f), 4).alias("f0_root"))


def label_propagation(links: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, grp): synchronous label propagation on the undirected graph; each node takes the label with most weight among its neighbours and itself, ties to the least.

    It need not settle, so it is the labels after ``rounds`` rounds, or from the round on that changes none.
    """
    latest = Latest("labels", keep=2)
    with held(both_ways(links).repartition("dst")) as both:
        own = cut(both.groupBy(F.col("src").alias("node")).agg((F.max("w")).alias("w")), "own")

        def step(s: DataFrame) -> DataFrame:
            votes = both.join(s.select(F.col("node").alias("dst"), "grp"), "dst").select(F.col("src").alias("node"), "grp", "w").unionByName(s.join(own, "node").select("node", "grp", "w"))
            tally = votes.groupBy("node", "grp").agg(F.round(F.sum("w"), 6).alias("w"))
            return tally.groupBy("node").agg(F.min_by("grp", F.struct(-F.col("w"), F.col("grp"))).alias("grp"))

        state = own.select("node", F.col("node").alias("grp"))
        for _ in range(rounds):
            was, state = state, latest(step(state))
            if not state.join(was.select("node", F.col("grp").alias("was")), "node").filter("grp <> was").limit(1).collect():
                break
    return state


def strong_components(links: DataFrame) -> DataFrame:
    """(node, scc), each named by its least node: forward-backward colouring in rounds.

    Each round: every open node takes the least node that reaches it (its colour); those that reach their colour's root back within the colour are that
    root's component and close. Nodes without an open in- or out-link close at once as their own component.
    """
    e = cut(links.filter("src <> dst").select("src", "dst").distinct(), "links")
    open_ = cut(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "open")
    done = None
    while True:  # each round closes a component at least
        for _ in range(3):  # a few rounds of trimming
            ends = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node")
            lone = cut(open_.join(ends, "node", "left_anti").select("node", F.col("node").alias("scc")), "lone")
            done = lone if done is None else done.unionByName(lone)
            open_ = cut(open_.join(lone, "node", "left_anti"), "open")
            e = cut(e.join(open_.withColumnRenamed("node", "src"), "src", "left_semi").join(open_.withColumnRenamed("node", "dst"), "dst", "left_semi"), "links")
        if not open_.limit(1).collect():
            return done
        links_in = e

        def spread(s: DataFrame, links_in: DataFrame = links_in) -> DataFrame:
            s = s.select("node", "c")
            near = links_in.join(s.select(F.col("node").alias("src"), F.col("c").alias("n")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("n").alias("n"))
            return s.join(near, "node", "left").select("node", F.least("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") < F.col("c")).alias("moved"))

        colour = until_fixed(open_.withColumn("c", F.col("node")), spread, "moved", "colour").select("node", "c")
        within = cut(e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst"), "within")
        reach = colour.filter("node = c").select("node", "c")
        front = reach
        while True:
            new = within.join(front.select(F.col("node").alias("dst"), "c"), "dst").select(F.col("src").alias("node"), "c").distinct()
            front = cut(new.join(reach, "node", "left_anti"), "back")
            if not front.limit(1).collect():
                break
            reach = cut(reach.unionByName(front), "reach")
        closed = cut(reach.select("node", F.col("c").alias("scc")), "closed")
        done = closed if done is None else done.unionByName(closed)
        open_ = cut(open_.join(closed, "node", "left_anti"), "open")
        e = cut(e.join(open_.withColumnRenamed("node", "src"), "src", "left_semi").join(open_.withColumnRenamed("node", "dst"), "dst", "left_semi"), "links")
        if not open_.limit(1).collect():
            return done


def bow_tie(links: DataFrame, scc: DataFrame) -> DataFrame:
    """(node, bow_tie): CORE is the largest strong component (ties to the least name), IN reaches it, OUT is reached by it, OTHER the rest."""
    size = scc.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    top = size.agg(F.min_by("scc", F.struct(-F.col("n"), F.col("scc")))).first()[0]
    core = cut(scc.filter(F.col("scc") == F.lit(top)).select("node"), "core")

    def reach(e: DataFrame) -> DataFrame:
        seen = front = core
        while True:
            new = e.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
            front = cut(new.join(seen, "node", "left_anti"), "front")
            if not front.limit(1).collect():
                return seen.join(core, "node", "left_anti")
            seen = cut(seen.unionByName(front), "seen")

    e = cut(links.select("src", "dst").distinct(), "links")
    out = reach(e).select("node", F.lit("OUT").alias("b"))
    into = reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("node", F.lit("IN").alias("b"))
    labelled = core.select("node", F.lit("CORE").alias("b")).unionByName(out).unionByName(into)
    return scc.select("node").join(labelled, "node", "left").select("node", F.coalesce("b", F.lit("OTHER")).alias("bow_tie"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """(node, hop): nodes within ``hops`` of any seed, along payments (out), against them (in) or either way."""
    inc = incidence(edges).select("node", "cp", "dir").distinct()
    e = inc if direction == "both" else inc.filter(F.col("dir") == direction)
    e = cut(e.select("node", "cp").distinct(), "links")
    seen = front = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "hop")
    for h in range(1, hops + 1):
        new = e.join(front.select("node"), "node").select(F.col("cp").alias("node")).distinct()
        front = cut(new.join(seen, "node", "left_anti").select("node", F.lit(h).alias("hop")), "hop")
        seen = seen.unionByName(front)
    return seen


def _moves(both: DataFrame, rounds: int) -> DataFrame:
    """(node, grp): moves on a symmetric relation (src, dst, w) whose self rows hold the weight within a node twice."""
    degree = cut(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "degree")
    m2 = degree.agg(F.sum("k")).first()[0]
    latest = Latest("groups")
    state = degree.select("node", "k", F.col("node").alias("grp"))
    with held(both.filter("src <> dst").repartition("dst")) as links:
        for i in range(rounds):
            size = state.groupBy("grp").agg(F.sum("k").alias("tot"))
            near = links.join(state.select(F.col("node").alias("dst"), "grp"), "dst").groupBy(F.col("src").alias("node"), "grp").agg(F.sum("w").alias("kin"))
            options = near.unionByName(state.select("node", "grp", F.lit(0.0).alias("kin"))).groupBy("node", "grp").agg(F.sum("kin").alias("kin"))
            own = state.select("node", "k", F.col("grp").alias("own"))
            j = options.join(own, "node").join(size, "grp")
            gain = F.round(F.col("kin") - F.col("k") * (F.col("tot") - F.when(F.col("grp") == F.col("own"), F.col("k")).otherwise(0.0)) / m2, 9)
            best = j.withColumn("gain", gain).groupBy("node", "k", "own").agg(F.min_by("grp", F.struct(-F.col("gain"), F.col("grp"))).alias("best"), F.max("gain").alias("top"), F.max(F.when(F.col("grp") == F.col("own"), F.col("gain"))).alias("stay"))
            turn = F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2)) == 0
            state = latest(best.select("node", "k", F.when(turn & (F.col("top") > F.col("stay")), F.col("best")).otherwise(F.col("own")).alias("grp")))
    return state.select("node", "grp")


def modularity_moves(links: DataFrame, rounds: int = 12) -> DataFrame:
    """(node, grp): one level of modularity optimisation on the undirected graph.

    In each round, the half of the nodes that a hash picks move to the neighbouring group with the greatest gain, if that beats their own; halves keep neighbours from
    trading places. Deterministic; the groups carry the name of the node that founded them.
    """
    return _moves(cut(both_ways(links), "both"), rounds)


def louvain(links: DataFrame, rounds: int = 12, levels: int = 10) -> DataFrame:
    """(node, grp, level): modularity moves, then the same on the graph of groups, until a level joins none or ``levels`` are done. level is the last one that joined groups.

    The graph of groups keeps the weights within groups as self rows, so a move's gain is that of all its nodes. Deterministic, unlike the usual form that visits nodes one by one.
    """
    both = cut(both_ways(links), "both")
    member, done = None, 0
    for level in range(1, levels + 1):
        moved = cut(_moves(both, rounds), "level")
        member = moved if member is None else cut(member.join(moved.select(F.col("node").alias("grp"), F.col("grp").alias("up")), "grp").select("node", F.col("up").alias("grp")), "member")
        done = level
        if moved.filter("node <> grp").limit(1).collect() == []:
            break
        both = cut(both.join(moved.select(F.col("node").alias("src"), F.col("grp").alias("a")), "src").join(moved.select(F.col("node").alias("dst"), F.col("grp").alias("b")), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.round(F.sum("w"), 6).alias("w")), "both")
    return member.select("node", "grp", F.lit(done).alias("level"))
