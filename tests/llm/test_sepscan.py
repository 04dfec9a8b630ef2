import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import sepscan as S
from riskloom.llm.common import read


def brute(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start))
            start = i + 1
    return out + ([(start, len(ids) - start)] if start < len(ids) else [])


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_blocks_are_stitched(spark, size):
    rng, rows, want = np.random.default_rng(size), [], {}
    for f in range(4):
        ids = rng.integers(0, 9, 200 * f + 5)
        want[f"f{f}"] = [(j, s, n) for j, (s, n) in enumerate(brute(ids.tolist(), 0))]
        rows += [(f"f{f}", b, ids[b * size : (b + 1) * size].astype("<u2").tobytes(), 1) for b in range(-(-len(ids) // size))]
    df = spark.createDataFrame(rows, "file string, block long, tokens binary, n int").repartition(3)
    got = {}
    for r in S.separator_scan(df, end=0).orderBy("file", "ordinal").collect():
        got.setdefault(r["file"], []).append((r["ordinal"], r["start"], r["n_tokens"]))
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.integers(1, 6))
def test_small_files(spark, ids, size):
    rows = [("f", b, np.array(ids[b * size : (b + 1) * size], "<u4").tobytes()) for b in range(-(-len(ids) // size))]
    df = spark.createDataFrame(rows, "file string, block long, tokens binary")
    assert [(r["start"], r["n_tokens"]) for r in S.separator_scan(df, 0, 4).orderBy("ordinal").collect()] == brute(ids, 0)


def test_counts_equal_direct_tokenisation(spark, small, monkeypatch):
    docs = read(spark, small, "documents")
    enc = S.encoder(S.ranks_path())
    want = sorted((r["doc_id"], len(enc.encode_ordinary(r["text"]))) for r in docs.collect())
    assert sorted(tuple(r) for r in S.op8_separator_scan(spark, small).collect()) == want
    monkeypatch.setattr(S, "RUN_BLOCKS", 3)
    got = S.separator_scan(S.flat_files(docs.repartition(3), block_tokens=501)).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want
    blocks = S.flat_files(docs, block_tokens=501).select(F.length("tokens")).collect()
    assert max(r[0] for r in blocks) == 1002


@pytest.mark.parametrize("width", [1, 2, 4])
def test_files_are_read_in_ranges(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(S, "RUN_BLOCKS", 5)
    rng, want = np.random.default_rng(width), {}
    for f, n in (("a b.bin", 3000), ("c.bin", 17), ("empty.bin", 0)):
        ids = rng.integers(0, 40, n)
        (tmp_path / f).write_bytes(ids.astype(f"<u{width}").tobytes())
        want[f] = brute(ids.tolist(), 0)
    blocks = S.read_flat_files(spark, str(tmp_path), width, block_tokens=64)
    assert blocks.count() == 47 + 1  # the source lists no empty files
    got = {f: [] for f in want}
    for r in S.separator_scan(blocks.unionByName(blocks), 0, width).orderBy("file", "ordinal").collect():
        got[r["file"].rsplit("/", 1)[1]].append((r["start"], r["n_tokens"]))
    assert got == want


def test_edges(spark):
    texts = [None, "", "a", "a", "word " * 200_000, "x" * 100_000, " " * 100_000]
    docs = spark.createDataFrame([(t, "c", None if i == 2 else i) for i, t in enumerate(texts)], "text string, tokens string, doc_id int")
    got = sorted(r["n_tokens"] for r in S.separator_scan(S.flat_files(docs)).collect())
    assert got[:4] == [0, 0, 1, 1] and len(got) == 7
    assert S.separator_scan(S.flat_files(docs.limit(0))).count() == 0
    twice = spark.createDataFrame([("f", 0, b"\x01\x00\x00\x00", 1), ("f", 0, b"\x01\x00\x00\x00", 2), ("f", 1, b"\x02\x00", 1), ("f", None, b"\x07\x00", 1)], "file string, block long, tokens binary, n int")
    assert sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in S.separator_scan(twice, 0).collect()) == [(0, 0, 2), (1, 3, 1)]
    odd = spark.createDataFrame([("f", 0, None), ("f", 1, b""), ("f", 2, b"\x01\x00\x02"), (None, 0, b"\x00\x00")], "file string, block long, tokens binary")
    assert sorted(((r["file"] or "", r["start"], r["n_tokens"]) for r in S.separator_scan(odd, 0).collect())) == [("", 0, 0), ("f", 0, 1)]
