import numpy as np
import pyarrow as pa

from riskloom.llm import quality as Q
from riskloom.llm.common import read, text_slices


def rows(texts):
    return [f for _, _, data, offs in text_slices(pa.array(texts, pa.string())) for f in Q.features(data, offs)]


def test_features_are_distinct_and_depend_on_the_text_alone():
    texts = ["Hello there, hello there.", "", "ab", "x", "Hello there, hello there."]
    together, alone = rows(texts), [rows([t])[0] for t in texts]
    for a, b in zip(together, alone):
        assert len(set(a.tolist())) == len(a) and sorted(a.tolist()) == sorted(b.tolist())
    assert len(together[1]) == 0 and len(together[0]) > 20


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    """Against subgradient descent on the same scaled rows."""
    rng = np.random.default_rng(0)
    good = np.arange(60) % 2 == 0
    data = [np.unique(np.r_[rng.integers(0, 40, 12), rng.integers(40 if g else 50, 60 if g else 70, 6)]).astype(np.int32) for g in good]
    model = Q.fit_rows(data, good, cost=1.0, epochs=300)
    scores = np.array([model.score(f) for f in data])
    assert ((scores > 0) == good).mean() > 0.95
    y = np.where(good, 1, -1)
    size = 1 << Q.FEATURE_BITS
    pos, neg = (np.bincount(np.concatenate([r for r, g in zip(data, good) if g == side]), minlength=size) + Q.SMOOTH for side in (True, False))
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))
    used = np.unique(np.concatenate(data))
    x = np.zeros((60, len(used) + 1))
    for i, r in enumerate(data):
        v = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, np.searchsorted(used, r)], x[i, -1] = v, 1
    primal = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    mine = np.r_[(model.weights.astype(float) / np.where(ratio == 0, 1, ratio))[used], model.bias]
    w, best = np.zeros(x.shape[1]), np.inf
    for t in range(1, 20001):
        w -= (w - ((y * (x @ w) < 1) * y) @ x) / t
        best = min(best, primal(w))
    assert primal(mine) <= best * 1.01 + 1e-3


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    even, odd = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = Q.quality_scores(docs, even).join(odd, "doc_id").select("kept", "quality").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in got]) > 0.95
    assert np.mean([r["kept"] for r in got if r["quality"] == 1]) > 0.98


def test_edges(spark):
    schema = "doc_id long, text string, score int"
    texts = [(i, ("good words in a row " if i % 2 else "&&& $$$ ### ") * 5, 1) for i in range(40)]
    docs = spark.createDataFrame([*texts, (None, None, None), (None, "good words", 1), (90, "", 1), (1, texts[1][1], 1), (91, "word " * 100_000, 1)], schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (5, 0)], "doc_id long, quality int")
    out = Q.quality_scores(docs, labels).collect()
    assert len(out) == docs.count() and all(r["kept"] for r in out if r["doc_id"] is None and r["score"] is None)
    kept = Q.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out) < len(out)
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
    assert all(r["kept"] and r["score"] is None for r in Q.quality_scores(docs, labels.limit(0)).collect())
    assert Q.good_documents(docs, labels.filter("quality = 1")).count() == docs.count()
