import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import simhash as S
from riskloom.llm.common import text_slices
from riskloom.llm.components import components, popcount, posting_links

VOCAB = ["".join(random.Random(i).choices("abcdefghij", k=5)) for i in range(3000)]


def text(seed, n=80):
    return random.Random(seed).choices(VOCAB, k=n)


def edited(words, share, seed):
    r, out = random.Random(seed), list(words)
    for i in r.sample(range(len(out)), max(1, int(len(out) * share))):
        out[i] = r.choice(VOCAB)
    return out


def prints(texts):
    parts = [S.fingerprints(data, offs) for _, _, data, offs in text_slices(pa.array(texts, pa.string()))]
    return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])


def groups(rows):
    by = defaultdict(set)
    for r in rows:
        by[r["group_id"]].add(r["doc_id"])
    return {frozenset(v) for v in by.values()}


def test_fingerprints_are_of_the_word_set():
    p, has = prints(["The quick, brown fox", "fox THE brown quick quick", "", None, "!!!", "???", "!!!", "Été là", "été LÀ"])
    assert (p[0] == p[1]).all() and has.tolist() == [4, 5, 0, 0, 1, 1, 1, 2, 2]
    assert (p[4] == p[6]).all() and (p[4] != p[5]).any() and (p[7] == p[8]).all()
    many = [" ".join(text(i, 700)) for i in range(4)]
    assert (prints(many)[0] == np.concatenate([prints([t])[0] for t in many])).all()


def test_signs_against_sums_by_hand():
    words = ["alpha", "beta", "gamma"]
    single = np.unpackbits(prints(words)[0].view(np.uint8), axis=1).astype(int)
    whole = np.unpackbits(prints([" ".join(words)])[0].view(np.uint8), axis=1)[0]
    assert (whole == (single.sum(0) * 2 > 3)).all()


def test_count_filter_is_guaranteed():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, (500, 4)).astype(np.uint64)
    b = np.unpackbits(a.view(np.uint8), axis=1)
    for row, d in zip(b, rng.integers(0, 70, 500)):
        row[rng.permutation(256)[:d]] ^= 1
    b = np.packbits(b, axis=1).view(np.uint64)
    h = popcount(a ^ b)
    assert (S.shared_positions(a ^ b) == (S.digits(a) == S.digits(b)).sum(1)).all()
    assert (S.shared_positions(a ^ b)[h <= S.DISTANCE] >= S.DIGITS - S.DISTANCE).all()
    n, m = np.full((500, 1), 80, np.uint64), np.repeat(np.array([[80], [100], [101]], np.uint64), 167, 0)[:500]
    want = (h <= S.DISTANCE) & (m[:, 0] <= 100)
    assert (S.near(S.DISTANCE)(np.hstack([a, n]), np.hstack([b, m])) == want).all() and want.any()


def test_recall_and_precision_against_brute_force(spark):
    rows, n = [], 0
    for g in range(60):
        base = text(g)
        for k in range(3):
            rows.append((n, " ".join(base if k == 0 else edited(base, 0.02 + 0.03 * k, g * 10 + k))))
            n += 1
    rows += [(n + i, " ".join(text(10_000 + i))) for i in range(150)]
    p, _ = prints([t for _, t in rows])
    near = {(a, int(b)) for a in range(len(rows) - 1) for b in a + 1 + np.flatnonzero(popcount(p[a] ^ p[a + 1 :]) <= S.DISTANCE)}
    got = {r["doc_id"]: r["group_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[a] == got[b] for a, b in near)
    assert len(near) > 100 and found >= 0.95 * len(near)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(root(a) == root(g) for a, g in got.items())


@pytest.mark.parametrize("words", [50, 100, 250])
def test_recall_of_pairs_with_a_tenth_of_the_words_replaced(spark, words):
    r, rows, pairs = random.Random(words), [], 300
    for i in range(pairs):
        pick = r.sample(VOCAB, words + words // 10)
        base, new = pick[:words], pick[words:]
        copy = list(base)
        for at, w in zip(r.sample(range(words), len(new)), new):
            copy[at] = w
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    got = {x["doc_id"]: x["group_id"] for x in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(pairs)) >= 0.9 * pairs
    assert all(g // 2 == d // 2 for d, g in got.items())


@pytest.mark.parametrize("distance, least", [(10, 0.999), (20, 0.999), (30, 0.995), (40, 0.93), (44, 0.85), (48, 0.72)])
def test_recall_of_the_index_by_distance(distance, least):
    """The groups don't depend on the corpus, so this is the recall at any size."""
    rng, groups = np.random.default_rng(distance), S.key_positions()
    differ = np.zeros((3000, S.DIGITS), bool)
    for row in differ:
        row[rng.permutation(S.BITS)[:distance] // 4] = True
    assert (~differ[:, groups]).all(2).any(1).mean() >= least


@pytest.mark.parametrize("distance", [0, 5, 14, 15, 48])
def test_lookups_find_all_pairs_within_the_distance(distance):
    rng = np.random.default_rng(distance)
    a = rng.integers(0, 2**63, (400, 4)).astype(np.uint64)
    b = np.unpackbits(a.view(np.uint8), axis=1)
    for k, row in enumerate(b):  # the bits differ anywhere, or close together
        row[rng.permutation(256 if k % 2 else max(distance, 64))[: distance - k % 3 if distance else 0]] ^= 1
    b = np.packbits(b, axis=1).view(np.uint64)
    within = lambda x, y: popcount(x ^ y) <= distance
    found = {(i, j) for x, y in S.pairs_within(a, b, distance) for i, j in zip(x.tolist(), y.tolist()) if within(a[i], b[j])}
    assert found == {(i, i) for i in range(400)}
    both = np.concatenate([a, b])
    found = {(min(i, j), max(i, j)) for x, y in S.pairs_within(both, both, distance, own=True) for i, j in zip(x.tolist(), y.tolist()) if within(both[i], both[j])}
    assert found == {(i, i + 400) for i in range(400)}


@pytest.mark.parametrize("rows, large", [(1 << 18, 4096), (40, 4096), (150, 5)])
def test_all_links_between_groups_against_brute_force(spark, monkeypatch, rows, large):
    monkeypatch.setattr(S, "LARGE", large)
    rng = np.random.default_rng(rows + large)
    bits = np.repeat(rng.integers(0, 2, (100, 256)), 4, axis=0)
    for row in bits:
        row[rng.permutation(256)[: rng.integers(0, 33)]] ^= 1
    prints = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
    n, g = rng.choice([1, 2, 64, 80, 100, 125, 126, 156, 10**9], 400), np.where(np.arange(400) < 200, rng.integers(0, 6, 400), rng.permutation(400) + 100)
    table = np.hstack([prints, n[:, None], g[:, None]])
    near, u = S.near(S.DISTANCE), table.view(np.uint64)
    want = {(min(g[i], g[j]), max(g[i], g[j])) for i in range(399) for j in i + 1 + np.flatnonzero(near(u[i : i + 1, :5], u[i + 1 :, :5])) if g[i] != g[j]}
    df = spark.createDataFrame([tuple(map(int, r)) for r in table], "p0 long, p1 long, p2 long, p3 long, n long, g long")
    assert {tuple(r) for r in S.missed_links(df, S.DISTANCE, rows=rows).collect()} == want and len(want) > 30
    assert S.missed_links(df.limit(0), S.DISTANCE).count() == 0


def test_no_pair_within_the_distance_is_left_out(spark):
    r, texts = random.Random(9), []
    for _ in range(400):
        pick = r.sample(VOCAB, 112)
        texts += [" ".join(pick[:100]), " ".join(pick[12:])]
    p, n = prints(texts)
    table = np.hstack([p, n[:, None].astype(np.uint64)])
    near = [k for k in range(0, 800, 2) if S.near(S.DISTANCE)(table[k : k + 1], table[k + 1 : k + 2])[0]]
    assert sum(popcount(p[k] ^ p[k + 1]) > 44 for k in near) > 40
    got = {x["doc_id"]: x["group_id"] for x in S.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [k for k in near if got[k] != got[k + 1]] == []


def test_lists_beyond_a_tasks_memory_lose_no_link(spark):
    rng, rows = np.random.default_rng(5), []
    for key, n in ((1, 500), (2, 3), (3, 90), (4, 1)):
        for p in rng.integers(0, 1 << 30, (n, 1)).astype(int).tolist():
            rows.append((key, len(rows), p[0]))
    rows += rows[:40]
    near = lambda a, b: popcount(a ^ b) <= 6
    df = spark.createDataFrame(rows, "key long, id long, p long")

    def classes(edges):
        parent = list(range(len(rows)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in range(len(rows))]

    want = classes([(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (a[2] ^ b[2]).bit_count() <= 6])
    assert len(set(want)) < len(rows) - 50
    for most in (10**6, 60):
        got = [(r["a"], r["b"]) for r in posting_links(df, near, rows=most).collect()]
        assert classes(got) == want


def test_large_group_leaves_one(spark):
    base = text(1, 120)
    rows = [(i, " ".join(edited(base, 0.02, i))) for i in range(400)] + [(1000 + i, " ".join(base)) for i in range(300)] + [(5000, " ".join(text(2)))]
    out = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out if r["kept"]} == {0, 5000} and Counter(r["group_id"] for r in out) == {0: 700, 5000: 1}


def test_repeated_words_are_no_copies(spark):
    words = " ".join(text(3, 20))
    rows = [(1, words), (2, words + " " + "word " * 300), (3, words + " " + words.split()[0])]
    out = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["group_id"] for r in out} == {1: 1, 2: 2, 3: 1}


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for x in parent if root(x) != x}
    assert {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_edges(spark, parts):
    a, b = " ".join(text(5)), " ".join(text(6))
    rows = [(1, a), (1, a), (None, a), (2, b), (None, None), (3, None), (4, ""), (5, ""), (6, "!!!"), (7, "!!!"), (8, "word " * 100_000), (2, a + " more")]
    docs = spark.createDataFrame([(i, t, "x", "c", 0) for i, t in rows], "doc_id long, text string, group_id string, h string, _id int").repartition(parts)
    out = S.near_duplicates(docs).collect()
    assert len(out) == len(rows) and groups([r for r in out if r["group_id"] in (6, 8)]) == {frozenset([6, 7]), frozenset([8])}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out if r["group_id"] is None) == [(False, 3), (False, 4), (False, 5), (True, 0)]
    left = S.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] and r["text"][:20]) for r in left.collect() if r["text"]) == sorted([(1, a[:20]), (2, b[:20]), (6, "!!!"), (8, ("word " * 4)[:20])])
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect() if not r["text"]) == [(0, ""), (3, ""), (4, ""), (5, "")]
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.without_near_duplicates(docs.limit(0)).count() == 0
