import random

import numpy as np
import pyarrow as pa

from riskloom.llm import lzprint as Z
from riskloom.llm.common import text_slices


def brute(words):
    seen, out, now = set(), [], ()
    for w in words:
        now += (w,)
        if now not in seen:
            seen.add(now)
            out.append(now)
            now = ()
    if now:
        out.append(now)
    return out


def sets(texts):
    return [p for _, _, data, offs in text_slices(pa.array(texts, pa.string())) for p in Z.phrase_sets(data, offs)]


def test_parse_is_lz78():
    r = random.Random(0)
    for n in (0, 1, 5, 300):
        seq = [r.randrange(6) for _ in range(n)]
        ends = Z.phrase_ends(seq)
        assert [tuple(seq[a:b]) for a, b in zip([0, *ends], ends)] == brute(seq)


def test_equal_phrases_hash_alike():
    texts = ["a b a b c, a b!", "A b. A B c a b", "x", "", None, "!!", "??", "!!"]
    s = sets(texts)
    assert s[0].tolist() == s[1].tolist() and len(s[0]) == len(brute("a b a b c a b".split()))
    assert len(s[3]) == len(s[4]) == 0 and s[5].tolist() == s[7].tolist() != s[6].tolist()
    assert all(a.tolist() == sets([t])[0].tolist() for a, t in zip(s, texts))


def test_sketch_estimates_jaccard():
    rng, errors = np.random.default_rng(0), []
    for share in (0.1, 0.4, 0.6, 0.9):
        for _ in range(20):
            x = rng.integers(0, 2**63, 400).astype(np.uint64)
            y = np.r_[x[: int(400 * share)], rng.integers(0, 2**63, 400 - int(400 * share)).astype(np.uint64)]
            real = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            k = Z.sketch(np.stack([Z.signature(x), Z.signature(y)]))
            errors.append(float(Z.estimate(k[0] ^ k[1])) - real)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.25


def test_groups_against_brute_force(spark):
    vocab = ["".join(random.Random(i).choices("klmnopqrst", k=6)) for i in range(2000)]
    rows = []
    for g in range(50):
        base = random.Random(g).choices(vocab, k=100)
        for k in range(3):
            r, t = random.Random(g * 7 + k), list(base)
            for i in r.sample(range(100), 3 * k):
                t[i] = r.choice(vocab)
            rows.append((len(rows), " ".join(t)))
    rows += [(1000 + i, " ".join(random.Random(777 + i).choices(vocab, k=60))) for i in range(60)]
    sig = np.stack([Z.signature(p) for p in sets([t for _, t in rows])])
    k = Z.sketch(sig)
    pairs = [(a, a + 1 + int(b)) for a in range(len(rows) - 1) for b in np.flatnonzero(Z.estimate(k[a] ^ k[a + 1 :]) >= Z.SIMILARITY)]
    got = {r["doc_id"]: r["group_id"] for r in Z.phrase_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = [i for i, _ in rows]
    assert len(pairs) > 80 and sum(got[ids[a]] == got[ids[b]] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(got[1000 + i] == 1000 + i for i in range(60))


def test_edges(spark):
    rows = [(1, "some words here"), (1, "some words here"), (None, "some words here"), (None, None), (2, ""), (3, "!!"), (4, "z " * 200_000), (None, "lonely text of a null id")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, sketch string")
    out = sorted(((r["doc_id"] or 0, r["n_phrases"], r["group_id"]) for r in Z.phrase_groups(df).collect()), key=str)
    assert (0, 3, 1) in out and out.count((1, 3, 1)) == 2 and (0, 0, None) in out and (2, 0, None) in out and (3, 1, 3) in out and (0, 6, None) in out and len(out) == 8
    assert Z.phrase_groups(df.limit(0)).count() == 0


def test_postings_that_meet_no_other_go(spark):
    r = random.Random(8)
    rows = [(r.randrange(900), i) for i in range(800)] + [(2000, 5000 + i) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(x) for x in Z.met(spark.createDataFrame(rows, "key long, id long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(x for x in rows if sum(y[0] == x[0] for y in rows) > 1)
