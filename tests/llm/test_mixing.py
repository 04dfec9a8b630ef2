import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, slot string"


def corpus(spark, n=600):
    return spark.createDataFrame([(i, "w " * (1 + i * 7 % 90), ["big", "big", "big", "mid", "tiny"][i % 5], "clash") for i in range(n)], SCHEMA)


def by_hand(blocks, raw, sequence="golden"):
    """(slot, source, block) by a loop over all slots, with the phases' arithmetic in plain Python."""
    x = {s: blocks[s] / raw[s] for s in blocks}
    v0, v1, begin, out = 0.0, min(x.values()), 0, []
    played = lambda s, v: blocks[s] if x[s] <= v else min(math.floor(raw[s] * v), blocks[s])
    while any(x[s] > v0 for s in x):
        live = [(s, played(s, v0) if v0 else 0, played(s, v1)) for s in sorted(x) if x[s] > v0]
        live = [(s, a, b - a) for s, a, b in live if b > a]
        total, at, edges = sum(q for *_, q in live), 0, []
        for s, a, q in live:
            edges.append((at / total, (at + q) / total, s, a, q))
            at += q
        n, seen = max(math.ceil(min(M.SPARSE[sequence] * (q + 1), q + M.SLACK) * total / q) for *_, q in live) if live else 0, Counter()
        for t in range(begin, begin + n):
            u = (t + 1) * M.PHI % 1.0
            lo, hi, s, a, q = next(e for e in edges if e[0] <= u < e[1])
            if seen[s] < q:
                out.append((t, s, a + seen[s]))
            seen[s] += 1
        assert all(seen[s] >= q for *_, s, _, q in edges)
        begin, v0, v1 = begin + n, v1, v1 * 2
    return out


def test_every_stretch_keeps_the_weights_until_a_source_runs_out(spark):
    plan = M.schedule(corpus(spark, 1500), {"big": 5, "mid": 3, "tiny": 2}, block_tokens=50).select("slot", "source", "block").distinct().collect()
    last = {s: max(r["slot"] for r in plan if r["source"] == s) for s in ("big", "mid", "tiny")}
    first_out = min(last.values())
    for upto in (first_out // 2, first_out):
        seen = {s: max((r["block"] for r in plan if r["source"] == s and r["slot"] <= upto), default=0) for s in last}
        for name, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
            assert abs(seen[name] - w * (upto + 1)) <= 5
    assert len(set(last.values())) == 3


@pytest.mark.parametrize("weights", [None, {"big": 5, "mid": 3, "tiny": 2}, {"big": 1e-6, "mid": 1.0, "tiny": 1000.0}, {"tiny": 1.0}])
def test_all_documents_have_the_slot_found_by_hand(spark, weights):
    docs = corpus(spark)
    rows = M.schedule(docs, weights, 0.7, block_tokens=200).collect()
    want = {r["doc_id"]: r["source"] for r in docs.collect() if weights is None or r["source"] in weights}
    assert {r["doc_id"]: r["source"] for r in rows} == want and len(rows) == len(want)
    n = Counter()
    for r in rows:
        n[r["source"]] += r["n_tokens"]
    slots = {(s, b): t for t, s, b in by_hand({s: -(-k // 200) for s, k in n.items()}, {s: weights[s] if weights else float(k) ** 0.7 for s, k in n.items()})}
    assert len(slots) == sum(-(-k // 200) for k in n.values())
    assert all(slots[r["source"], r["block"]] == r["slot"] for r in rows)


def test_blocks_hold_equal_tokens_and_nothing_repeats(spark):
    rows = M.schedule(corpus(spark), None, 0.7, block_tokens=200).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 600
    per = Counter()
    for r in rows:
        per[r["source"], r["block"]] += r["n_tokens"]
    inner = [v for (s, b), v in per.items()]
    assert max(inner) <= 200 + 90 and sum(inner) / len(inner) > 100
    assert len({(r["slot"]) for r in rows}) == len(per)


def test_thousands_of_sources(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id)) as source")
    rows = M.schedule(docs, block_tokens=20).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 4000
    assert len({(r["slot"]) for r in rows}) == len({(r["source"], r["block"]) for r in rows})


@pytest.mark.parametrize("buckets", [20, 50_000])
def test_matches_sql_and_buckets_do_not_matter(spark, monkeypatch, buckets):
    monkeypatch.setattr(M, "BUCKET_ROWS", buckets)
    docs = corpus(spark)
    mine = {tuple(r) for r in M.schedule(docs).collect()}
    con, documents = duckdb.connect(), docs.toPandas()
    theirs = {tuple(int(x) if i != 1 else x for i, x in enumerate(r)) for r in con.execute(M.OP1_SQL).fetchall()}
    assert mine == theirs and mine


def test_van_der_corput(spark):
    def vdc(n):
        x, f = 0.0, 0.5
        while n:
            x, n, f = x + f * (n & 1), n >> 1, f / 2
        return x

    got = [r[0] for r in spark.range(16).orderBy("id").select(M.points(F.col("id"), "van_der_corput")).collect()]
    assert all(math.isclose(a, vdc(i + 1)) for i, a in enumerate(got))


def test_mixed_keeps_all_in_slot_order(spark):
    docs = corpus(spark).repartition(3)
    kept = M.mixed(docs, block_tokens=200)
    assert kept.columns == docs.columns
    slot = {r["doc_id"]: r["slot"] for r in M.schedule(docs, block_tokens=200).collect()}
    parts = {}
    for r in kept.select("doc_id", F.spark_partition_id().alias("p")).collect():
        parts.setdefault(r["p"], []).append(slot[r["doc_id"]])
    assert sum(map(len, parts.values())) == len(slot) == 600 and all(v == sorted(v) for v in parts.values())
    assert {r["source"] for r in M.mixed(docs, {"mid": 2.0}).collect()} == {"mid"}


def test_edges(spark):
    rows = [(None, None, None, None), (None, "a b", "s", None), (1, "", "s", None), (2, "a b c", None, None), (2, "a b c", None, None), (3, "x " * 50_000, "s", None), (4, None, "none", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = M.schedule(docs, alpha=1.0).collect()
    assert sorted(r["n_tokens"] for r in out) == [0, 0, 0, 2, 3, 3, 50_000]
    assert sorted(M.mixed(docs, alpha=1.0).collect(), key=str) == sorted(docs.collect(), key=str)
    assert M.schedule(docs.limit(0)).count() == 0 and M.mixed(docs.limit(0)).count() == 0
    assert M.schedule(docs, {"nowhere": 1.0}).count() == 0
