import numpy as np

from riskloom.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(vectors, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a, i in enumerate(ids):
        s = np.floor(x @ x[a] * 1e9 + 0.5) / 1e9
        order = [j for j in np.lexsort((ids, -s)) if j != a][:k]
        out[int(i)] = [(int(ids[j]), round(float(s[j]), 6)) for j in order]
    return out


def test_equals_brute_force_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(K, "TILE", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 12))
    vectors = {i: (centres[i % 5] * (i % 3 > 0) + rng.normal(size=12)).tolist() for i in range(230)}
    vectors[300] = vectors[7]
    df = spark.createDataFrame([(i, v, "c") for i, v in vectors.items()], SCHEMA)
    got = {}
    for r in K.exact_top_k(df, 5, chunk=50).orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append((r["neighbor_id"], r["score"]))
    want = brute(vectors, 5)
    assert {i: [a for a, _ in v] for i, v in got.items()} == {i: [a for a, _ in v] for i, v in want.items()}
    assert all(abs(x[1] - y[1]) < 2e-6 for i in got for x, y in zip(got[i], want[i]))
    some = K.exact_top_k(df, 5, chunk=50, every=20).collect()
    assert {(r["vec_id"], r["rank"], r["neighbor_id"]) for r in some} == {(i, n + 1, a) for i, v in want.items() if i % 20 == 0 for n, (a, _) in enumerate(v)}


def test_query_against_its_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = {tuple(r) for r in con.execute(K.OP4_SQL).fetchall()}
    assert {tuple(r) for r in K.op4_exact_top_k(spark, small).collect()} == want and want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [1.0, None]), (8, [0.0, 0.0]), (9, [1.0]), (None, [1.0, 1.0]), (10, [inf, 1.0])]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    got = [tuple(r) for r in K.exact_top_k(df, 5).orderBy("vec_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]
    assert K.exact_top_k(df.limit(0)).count() == 0
    assert K.exact_top_k(df.filter("vec_id = 1")).count() == 0
