import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame(sorted({p for p in pairs if p[0] != p[1]}), "src long, dst long")


def some(seed, n=40, m=70):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)} - {(i, i) for i in range(n)})


@pytest.mark.parametrize("seed", [1, 2])
def test_both_forms_agree(spark, seed):
    e = edges(spark, some(seed))
    for f, col in ((G.pagerank, "pagerank"), (G.strong_components, "scc_id"), (G.dependency_depth, "depth")):
        kw = {"rounds": 6} if f is G.pagerank else {}
        a, b = ({r["id"]: r[col] for r in f(e, kernel_edges=k, **kw).collect()} for k in (10**6, 0))
        assert a.keys() == b.keys() and all(a[i] == b[i] or abs(a[i] - b[i]) < 1e-9 for i in a), col


def test_pagerank_of_a_chain(spark):
    got = {r["id"]: r["pagerank"] for r in G.pagerank(edges(spark, [(1, 2), (2, 3)])).collect()}
    a = 0.15 / 3
    assert got[1] == pytest.approx(a) and got[2] == pytest.approx(a * 1.85) and got[3] == pytest.approx(a + 0.85 * a * 1.85) and sum(got.values()) < 1


def test_components_against_reachability(spark):
    pairs = some(5)
    ids = sorted({x for p in pairs for x in p})
    reach = {i: {i} for i in ids}
    for i in ids:
        todo = [i]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in reach[i]:
                    reach[i].add(b)
                    todo.append(b)
    want = {i: min(j for j in ids if j in reach[i] and i in reach[j]) for i in ids}
    got = {r["id"]: (r["scc_id"], r["scc_size"]) for r in G.strong_components(edges(spark, pairs)).collect()}
    assert {i: c for i, (c, _) in got.items()} == want and all(n == sum(v == c for v in want.values()) for c, n in got.values())


def brandes(pairs):
    ids = sorted({x for p in pairs for x in p})
    out = dict.fromkeys(ids, 0.0)
    for s in ids:
        order, pred, sigma, dist, q = [], {i: [] for i in ids}, dict.fromkeys(ids, 0), {s: 0}, deque([s])
        sigma[s] = 1
        while q:
            v = q.popleft()
            order.append(v)
            for a, w in pairs:
                if a == v:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        q.append(w)
                    if dist[w] == dist[v] + 1:
                        sigma[w] += sigma[v]
                        pred[w].append(v)
        delta = dict.fromkeys(ids, 0.0)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    n = len(ids)
    return {i: v / ((n - 1) * (n - 2)) for i, v in out.items()}


def test_betweenness(spark):
    pairs = some(7)
    want = brandes(pairs)
    got = {r["id"]: r["betweenness"] for r in G.betweenness(edges(spark, pairs)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    near = {r["id"]: r["betweenness"] for r in G.betweenness(edges(spark, pairs), exact_up_to=0, pivots=len(want)).collect()}
    assert all(abs(near[i] - want[i]) < 1e-12 for i in want)
    hub = {r["id"]: r["betweenness"] for r in G.betweenness(edges(spark, [(1, 0), (2, 0), (0, 3), (0, 4)])).collect()}
    assert hub[0] == pytest.approx(4 / 12) and np.isclose(sum(hub.values()), 4 / 12)


def test_depth_and_entries(spark):
    e = spark.createDataFrame([("f::main", "f::a"), ("f::a", "f::b"), ("f::b", "f::a"), ("f::x", "f::y")], "src string, dst string")
    assert {r["id"]: r["depth"] for r in G.dependency_depth(e).collect()} == {"f::main": 0, "f::a": 1, "f::b": 2, "f::x": None, "f::y": None}
    e = spark.createDataFrame([("f::p", "f::a"), ("f::a", "f::b")], "src string, dst string")
    assert {r["id"]: r["depth"] for r in G.dependency_depth(e).collect()} == {"f::p": 0, "f::a": 1, "f::b": 2}


def test_degrees_and_reachability(spark):
    e = edges(spark, [(1, 2), (1, 3), (3, 2)])
    assert sorted(tuple(r) for r in G.degrees(e, spark.createDataFrame([(1,), (9,)], "id long")).collect()) == [(1, 0, 2), (2, 2, 0), (3, 1, 1), (9, 0, 0)]
    p = spark.createDataFrame([(5, 4), (4, 3), (3, None), (9, 3)], "sha long, parent long")
    assert sorted(r[0] for r in G.reachable(p, spark.createDataFrame([(5,)], "sha long")).collect()) == [3, 4, 5]


def test_betweenness_counts_functions_without_edges(spark):
    e = edges(spark, [(0, 1), (1, 2)])
    everyone = spark.range(23).select("id")
    got = {r["id"]: r["betweenness"] for r in G.betweenness(e, all_nodes=everyone).collect()}
    assert len(got) == 23 and got[1] == pytest.approx(1 / (22 * 21)) and got[20] == 0


def test_depth_keeps_entries_beyond_the_kernel(spark):
    e = edges(spark, [(0, 1), (1, 2)])
    everyone = spark.range(23).select("id")
    want = {r["id"]: r["depth"] for r in G.dependency_depth(e, everyone).collect()}
    assert {r["id"]: r["depth"] for r in G.dependency_depth(e, everyone, kernel_edges=5).collect()} == want
    assert want[2] == 2 and all(want[i] == 0 for i in range(3, 23))


def test_betweenness_gives_out_what_it_reached(spark):
    from tests.test_operators import most_rows

    e = spark.range(320).select((F.col("id") * 3).alias("src"), (F.col("id") * 3 + 1).alias("dst")).union(spark.range(320).select(F.col("id") * 3 + 1, F.col("id") * 3 + 2))
    for exact in (1000, 0):
        out = G.betweenness(e, exact_up_to=exact, pivots=960)
        assert most_rows(out) <= 2 * 960 and {r["id"]: r["betweenness"] > 0 for r in out.collect()} == {i: i % 3 == 1 for i in range(960)}
