"""Groups of similar rows from an inverted index: verified links within each posting list, then connected components.

A posting list of thousands of copies is never expanded into all pairs. Within a list a breadth-first walk compares the members reached
with those not yet reached, and reports a spanning forest: it links exactly what all verified pairs would link, in time near linear
for lists that are mostly copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Up to this length all pairs of a list are compared at once, over all lists of that length together.
FULL = 24
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def _forest(ids: np.ndarray, prints: np.ndarray, near: Near) -> tuple[list[np.ndarray], list[np.ndarray]]:
    left, a, b = np.arange(len(ids)), [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = np.empty(len(left), bool)
            for i in range(0, len(left), 1 << 16):
                hit[i : i + (1 << 16)] = near(prints[x][None, :], prints[left[i : i + (1 << 16)]])
            found, left = left[hit], left[~hit]
            if len(found):
                a.append(np.full(len(found), ids[x]))
                b.append(ids[found])
                todo.extend(found.tolist())
    return a, b


def links(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the runs of equal keys (the keys are sorted)."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lens = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    for n in range(2, FULL + 1):
        s = starts[lens == n]
        for i in range(n if len(s) else 0):
            for j in range(i + 1, n):
                for at in range(0, len(s), 1 << 16):
                    p, q = s[at : at + (1 << 16)] + i, s[at : at + (1 << 16)] + j
                    hit = near(prints[p], prints[q])
                    a.append(ids[p[hit]])
                    b.append(ids[q[hit]])
    for s, n in zip(starts[lens > FULL].tolist(), lens[lens > FULL].tolist()):
        x, y = _forest(ids[s : s + n], prints[s : s + n], near)
        a += x
        b += y
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    if not len(a):
        return a, b
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    pair = pair[pair[:, 0] != pair[:, 1]]
    return pair[:, 0], pair[:, 1]


def posting_links(postings: DataFrame, near: Near, rows: int = 200_000) -> DataFrame:
    """postings (key, id, and longs that ``near`` compares) -> links (a, b): pairs of one list for which near(prints, prints) holds, less those that others imply.

    A task holds at most about ``rows`` postings. Lists longer than that (a hot key) are passed on unread and dealt into blocks of hashed
    ids; each pair of blocks is a task of its own, so such lists are compared in full too. A posting may be repeated.
    """
    width, names = len(postings.columns), postings.columns
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((c, pa.int64()) for c in names)])

    def table(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], 1)

    def linked(part: np.ndarray) -> pa.RecordBatch:
        a, b = links(part[:, 0], part[:, 1], part[:, 2:].view(np.uint64), near)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), pa.int64()) for _ in names)], schema=schema)

    def passed(part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64()), *(pa.array(np.ascontiguousarray(part[:, i])) for i in range(width))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, hot = [], 0, None  # hot: the key of a list that is being passed on
        for batch in batches:
            part = table(batch)
            if hot is not None and len(part):
                cut = int(np.searchsorted(part[:, 0], hot, "right"))
                if cut:
                    yield passed(part[:cut])
                    part = part[cut:]
                if len(part):
                    hot = None
            if not len(part):
                continue
            held.append(part)
            size += len(part)
            if size < rows:
                continue
            part = np.concatenate(held)
            cut = int(np.searchsorted(part[:, 0], part[-1, 0]))
            if cut:
                yield linked(part[:cut])
            held, size = [part[cut:]], len(part) - cut
            if size >= rows:
                yield passed(part[cut:])
                held, size, hot = [], 0, part[-1, 0]
        if held:
            yield linked(np.concatenate(held))

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(f"`{c}` long" for c in names)
    found = stored(postings.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, f"a long, b long, {columns}"), "links")
    short, hot = found.filter("a is not null").select("a", "b"), found.filter("a is null").drop("a", "b")
    if not hot.limit(1).count():
        return short.distinct()
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(rows / 2)).alias("_n"))
    block = F.pmod(F.xxhash64("id"), F.col("_n"))
    cells = hot.join(blocks, "key").withColumn("_i", block).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    cells = cells.withColumn("_cell", F.struct("key", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j")))

    def cell(part: pa.Table) -> pa.Table:
        x = np.stack([part.column(c).to_numpy() for c in names], 1)
        x[:, 0] = 0
        a, b = links(x[:, 0], x[:, 1], x[:, 2:].view(np.uint64), near)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return short.unionByName(cells.groupBy("_cell").applyInArrow(cell, "a long, b long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, root): of each vertex the smallest of its connected component; the smallest itself isn't listed.

    Alternates the large-star and the small-star step; both keep components and the number of rounds grows with the logarithm of their
    size. Each round is a table in the shared folder; it ends when a round changes nothing.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        if now.limit(1).count() == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        by = Window.partitionBy("a")
        large = both.withColumn("m", F.least("a", F.min("b").over(by))).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.withColumn("m", F.min("b").over(by)).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b")
        then = stored(small.distinct(), "edges")
        total = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(now)
        now = then
        if total == seen:
            break
        seen = total
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
