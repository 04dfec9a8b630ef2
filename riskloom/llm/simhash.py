"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 256 bits: the signs of the sums, over a document's distinct words, of each word's hashed +1/-1 vector. It is written as
64 hexadecimal digits, one byte per position. Two fingerprints within Hamming distance d differ in at most d positions, so they share at
least 64 - d positional bytes: the guaranteed minimum. Of the pairs that meet in the index the shared positional bytes are tallied, pairs
below the minimum are dropped, and the distance of the others is verified. Each posting carries the fingerprint's bytes, so a pair's
tally is complete where the pair first meets, and no row is written for each byte that a pair shares.

Lists of single positions would hold N/16 documents, so the index is of fixed groups of five positions, each chosen so that every position
occurs equally often. That alone is approximate: a pair is found if it agrees in all five positions of some group, at distances of 10, 20, 30,
40, 44 and 48 with probability 1.00, 1.00, 1.00, 0.95, 0.87 and 0.74. A list has N / 16^5 chance members; none is capped, see components.py. It joins large groups
of copies in near linear time.

The links between different groups that it missed are then found exactly. Such pairs have like word counts, so rows meet in cells of word counts. The
fingerprint is 16 chunks of four positions (16 bits); their distances add up to at most 48, so in some chunk it is at most 2, or 3 in the first. Each row looks up
every value that near its own in every chunk, which reads a 24th of a cell's pairs; those are verified. So all pairs within the distance end in one group.
This part grows with the square of the rows of like word count: a join within a distance this wide has no exact index that doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, col, distinct, fresh, mix64, prefix_hash, read, span_hash, stored, text_slices, words
from .components import components, popcount, posting_links

BITS, DIGITS = 256, 64
#: Largest Hamming distance of near copies: texts of which a tenth of the words is replaced are 36 apart on average, 2 % of them more than 48.
DISTANCE = 48
#: Least ratio of the word counts of near copies: fingerprints are of word sets and don't tell how often words are repeated.
RATIO = 0.8
#: Positions in a posting group, and posting groups: the same at every size of the corpus, so recall doesn't depend on it.
WIDTH, KEYS = 5, 112
#: Chunks of 16 bits in which near pairs are looked up, bins of word counts within one RATIO, and rows of a bin that are compared at once.
CHUNKS, BINS, CELL_ROWS = 16, 2, 1 << 18
#: Groups with more rows than this in a cell are looked up without their own rows.
LARGE = 4096
PRINT = ["p0", "p1", "p2", "p3", "n"]
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def key_positions(keys: int = KEYS, width: int = WIDTH, seed: int = 11) -> np.ndarray:
    """(keys, width) positions; each run of shuffled positions is dealt out whole before a position comes again."""
    rng = np.random.default_rng(seed)
    runs = [rng.permutation(DIGITS)[: DIGITS // width * width] for _ in range(-(-keys // (DIGITS // width)))]
    return np.concatenate(runs)[: keys * width].reshape(keys, width)


def fingerprints(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, 4) uint64 fingerprints and the documents' word counts, 0 for those without a fingerprint. A text without words counts as one word; an empty one has none."""
    n = len(offs) - 1
    b, starts, ends, doc = words(data, offs)
    bare = np.setdiff1d(np.flatnonzero(np.diff(offs)), doc)
    b = np.where(b == 0, data, b) if len(bare) else b
    starts, ends, doc = np.r_[starts, offs[bare]], np.r_[ends, offs[bare + 1]], np.r_[doc, bare]
    h = span_hash(prefix_hash(b), starts, ends) >> np.uint64(16)
    count = np.bincount(doc, minlength=n)
    key = distinct((doc.astype(np.uint64) << np.uint64(48)) | h)
    doc, h = (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)
    first = np.searchsorted(doc, np.arange(n))
    out = np.zeros((n, 4), np.uint64)
    at = 0
    while at < n:  # a bounded number of words at a time
        upto = max(at + 1, int(np.searchsorted(first, first[at] + 60_000, "right")) - 1)
        lo, hi = first[at], first[upto] if upto < n else len(h)
        sums = np.zeros((upto - at, BITS), np.int64)
        for s in range(lo, hi, 60_000):
            e = min(hi, s + 60_000)
            signs = np.stack([mix64((h[s:e] + np.uint64(k << 48)) * _GOLD) for k in range(4)], 1)
            rows = np.unpackbits(signs.view(np.uint8), axis=1)
            d = doc[s:e]
            run = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]).tolist()
            for r, q in zip(run, [*run[1:], e - s]):
                for c in range(r, q, 255):  # sums of 255 bits fit in a byte
                    sums[d[r] - at] += np.add.reduce(rows[c : min(q, c + 255)], axis=0, dtype=np.uint8)
        kinds = np.diff(np.r_[first, len(h)])[at:upto]
        out[at:upto] = np.packbits(2 * sums > kinds[:, None], axis=1).view(np.uint64)
        at = upto
    out[count == 0] = 0
    return out, count


def digits(prints: np.ndarray) -> np.ndarray:
    """(n, 64) hexadecimal digits of (n, 4) fingerprints."""
    b = np.ascontiguousarray(prints).view(np.uint8)
    return np.stack([b >> 4, b & 15], 2).reshape(len(b), DIGITS)


def shared_positions(x: np.ndarray) -> np.ndarray:
    """How many of the 64 positional bytes agree, of the XOR of fingerprints."""
    y = x | (x >> np.uint64(1))
    y = (y | (y >> np.uint64(2))) & np.uint64(0x1111111111111111)
    return DIGITS - popcount(y)


def near(distance: int, ratio: float = RATIO):
    """The count filter (at least 64 - distance shared positional bytes), then the distance itself and the ratio of the word counts in the fifth column."""

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a[:, :4] ^ b[:, :4]
        ok = shared_positions(x) >= DIGITS - distance
        ok[ok] = popcount(x[ok]) <= distance
        n, m = a[:, 4].astype(np.float64), b[:, 4].astype(np.float64)
        return ok & (np.minimum(n, m) >= ratio * np.maximum(n, m))

    return test


def fingerprint_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, h, p0..p3, n): the row's identity (its id and a hash of its text), its fingerprint and word count; NULL where the text is NULL or empty."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("h"), col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in text_slices(batch.column(2), SLICE_BYTES):
                prints, n = fingerprints(data, offs)
                ps = [*(pa.array(prints[:, k].view(np.int64), mask=n == 0) for k in range(4)), pa.array(n, pa.int64(), mask=n == 0)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, last - first) for i in (0, 1)), *ps], ["doc_id", "h", *PRINT])

    return narrow.mapInArrow(run, "doc_id long, h long, p0 long, p1 long, p2 long, p3 long, n long")


def postings(prints: DataFrame, keys: int = KEYS, width: int = WIDTH) -> DataFrame:
    """(id, p0..p3, n) -> one posting (key, id, p0..p3, n) for each group of positions."""
    groups = key_positions(keys, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                p = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6)], 1)
                d, n = digits(np.ascontiguousarray(p[:, :4])).astype(np.int64), len(p)
                key = np.zeros((len(groups), n), np.int64)
                for j, group in enumerate(groups):
                    for x in group:
                        key[j] = key[j] * 16 + d[:, x]
                    key[j] += j << 4 * width
                arrays = [pa.array(key.ravel()), pa.array(np.tile(batch.column(0).to_numpy(zero_copy_only=False), len(groups)))]
                arrays += [pa.array(np.tile(p[:, k], len(groups))) for k in range(5)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "id", *PRINT])

    return prints.select("id", *PRINT).mapInArrow(run, "key long, id long, p0 long, p1 long, p2 long, p3 long, n long")


def radii(distance: int) -> list[int]:
    """Of each chunk a distance, such that fingerprints within ``distance`` are within it in at least one chunk; -1 for chunks that aren't needed."""
    least, more = divmod(distance + 1, CHUNKS)
    return [least - 1 + (k < more) for k in range(CHUNKS)]


@lru_cache(maxsize=8)
def _ball(radius: int) -> np.ndarray:
    return np.flatnonzero(np.bitwise_count(np.arange(1 << 16)) <= radius)


def pairs_within(a: np.ndarray, b: np.ndarray, distance: int, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of the (n, 4) fingerprints a and b, among them all pairs within the distance, some repeatedly, and a few others. own: b is a, and each pair comes in one order.

    The chunks lie in a ring. If all distances are less in sum than all radii + 1, then from some chunk on they are so in every run: in that chunk
    alone, which is looked up, and in the word of four chunks that begins there, which is tested.
    """
    ca, cb = (np.ascontiguousarray(x[:, :4]).view(np.uint16) for x in (a, b))
    within = radii(distance)
    for c, radius in enumerate(within):
        if radius < 0:
            continue
        masks = _ball(radius)
        ob = np.argsort(cb[:, c], kind="stable")
        oa = ob if own else np.argsort(ca[:, c], kind="stable")
        begin = np.searchsorted(cb[ob, c], np.arange((1 << 16) + 1))
        run = [(c + k) % CHUNKS for k in range(4)]
        most = sum(within[k] + 1 for k in run) - 1
        x, y = (np.ascontiguousarray(chunks[:, run]).view(np.uint64)[:, 0][order] for chunks, order in ((ca, oa), (cb, ob)))
        value, full = ca[oa, c].astype(np.int64), begin[1:] > begin[:-1]
        step = max(1, (1 << 16) // len(masks))
        rows = np.repeat(np.arange(step), len(masks))
        for s in range(0, len(a), step):
            mine = value[s : s + step, None]
            key = mine ^ masks
            some = np.flatnonzero(full[key] & (key >= mine) if own else full[key])
            key, row = key.ravel()[some], rows[some] + s
            lo, hi = begin[key], begin[key + 1]
            if own:
                lo = np.maximum(lo, row + 1)
                left = np.flatnonzero(hi > lo)
                lo, hi, row = lo[left], hi[left], row[left]
            n = hi - lo
            upto = np.r_[0, np.cumsum(n)]
            at = 0
            while at < len(n):  # a bounded number of pairs at a time; a key has len(b) at most
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + (1 << 18), "right")) - 1)
                i = np.repeat(row[at:end], n[at:end])
                j = np.repeat(lo[at:end] - (upto[at:end] - upto[at]), n[at:end]) + np.arange(len(i))
                near = np.flatnonzero(np.bitwise_count(x[i] ^ y[j]) <= most)
                if len(near):
                    yield oa[i[near]], ob[j[near]]
                at = end


def links_between_groups(a: np.ndarray, b: np.ndarray | None, distance: int, ratio: float = RATIO) -> np.ndarray:
    """Distinct pairs (lesser, greater) of groups that a near pair of rows (p0..p3, n, group) of a and b links; b None: of rows of a alone."""
    test, out = near(distance, ratio), np.zeros((0, 2), np.uint64)

    def look(x: np.ndarray, y: np.ndarray, own: bool = False) -> None:
        nonlocal out
        for i, j in pairs_within(x, y, distance, own):
            apart = x[i, 5] != y[j, 5]
            i, j = i[apart], j[apart]
            hit = test(x[i, :5], y[j, :5])
            if hit.any():
                found = np.stack([x[i[hit], 5].view(np.int64), y[j[hit], 5].view(np.int64)], 1)
                out = np.unique(np.concatenate([out, np.sort(found, axis=1).view(np.uint64)]), axis=0)

    names, size = np.unique(a[:, 5], return_counts=True)
    for g in names[size > LARGE]:
        mine = a[:, 5] == g
        x, a = a[mine], a[~mine]
        other = a if b is None else b[b[:, 5] != g]
        look(x, other)
    look(a, a if b is None else b, b is None)
    return out.view(np.int64)


def missed_links(vertices: DataFrame, distance: int, ratio: float = RATIO, rows: int = CELL_ROWS) -> DataFrame:
    """vertices (p0..p3, n, g) -> (a, b): all pairs of different groups g that hold a near pair.

    Rows of like word counts are at most BINS bins of log(n) apart. Bins are dealt by hash into blocks of about ``rows`` rows, and each pair of
    blocks that near pairs can be in is a cell, a task's work; so no bin is too long, and none is capped.
    """
    spread = F.floor(F.log("n") * F.lit(BINS / (-np.log(ratio) * (1 + 1e-9))).cast("double")).cast("long")
    v = vertices.select(*PRINT, "g", spread.alias("_bin"))
    blocks = {r["_bin"]: -(-r["count"] // rows) for r in v.groupBy("_bin").count().collect()}  # as many as the doublings of n, times seven
    if not blocks:
        return v.sparkSession.createDataFrame([], "a long, b long")
    top = max(blocks)
    held = F.array(*[F.lit(blocks.get(k, 0)) for k in range(top + 1)])
    # A unit is a bin's number and a block's.
    v = v.withColumn("_u", F.shiftleft("_bin", 32) + F.pmod(F.xxhash64(*PRINT), F.element_at(held, (F.col("_bin") + 1).cast("int"))))
    v = v.withColumn("_o", F.explode(F.sequence(F.greatest(F.col("_bin") - BINS, F.lit(0)), F.least(F.col("_bin") + BINS, F.lit(top)))))
    v = v.withColumn("_k", F.element_at(held, (F.col("_o") + 1).cast("int"))).filter("_k > 0")
    v = v.withColumn("_w", F.explode(F.sequence(F.shiftleft("_o", 32), F.shiftleft("_o", 32) + F.col("_k") - 1)))
    v = v.select(*PRINT, "g", F.least("_u", "_w").alias("_a"), F.greatest("_u", "_w").alias("_b"), (F.col("_u") > F.col("_w")).cast("long").alias("_side"))

    def cell(part: pa.Table) -> pa.Table:
        x = np.stack([part.column(c).to_numpy() for c in [*PRINT, "g"]], 1).view(np.uint64)
        side = part.column("_side").to_numpy() == 1
        own = part.column("_a")[0].as_py() == part.column("_b")[0].as_py()
        found = links_between_groups(x[~side], None if own else x[side], distance, ratio)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return v.groupBy("_a", "_b").applyInArrow(cell, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, h, group_id, kept): the group of each row, named by its smallest doc_id, and whether the row stays.

    Rows whose fingerprints are within ``distance`` and whose word counts are alike, directly or through others, make a group; one row of each stays, that of the smallest
    doc_id (NULL ids last), then of the smallest text hash. Repeated rows (same id and text) are one group, of which one row stays: such rows
    are returned once for each. Rows with NULL or empty text are in no group: group_id is NULL and they stay. An empty table gives no rows.
    Extra columns are ignored. h is xxhash64(text): with doc_id it identifies the row.
    """
    rows = stored(fingerprint_rows(docs).withColumn("row", F.monotonically_increasing_id()), "prints")
    p = PRINT
    # One vertex for each fingerprint and word count: exact copies cost no comparison.
    some = rows.filter("p0 is not null")
    prints = stored(some.select(*p).distinct().withColumn("id", F.xxhash64(*p)), "vertices")
    roots = components(posting_links(postings(prints), near(distance)))
    prints = stored(prints.join(roots, "id", "left").select("id", *p, F.coalesce("root", "id").alias("g")), "grouped")
    # What the index missed: links between its groups.
    whole = components(missed_links(prints, distance)).withColumnRenamed("id", "g")
    node = some.withColumn("id", F.xxhash64(*p)).join(prints.select("id", "g").join(whole, "g", "left"), "id").select("doc_id", "h", "row", F.coalesce("root", "g").alias("g"))
    # The first of a group by an aggregate, which each executor begins on its own rows: a group may be a third of the corpus.
    first = node.groupBy("g").agg(F.min("doc_id").alias("group_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "row"))["row"].alias("_first"))
    grouped = node.join(first, "g").select("doc_id", "h", "group_id", (F.col("row") == F.col("_first")).alias("kept"))
    alone = rows.filter("p0 is null").select("doc_id", "h", F.lit(None).cast("long").alias("group_id"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def without_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of near_duplicates(). NULL and empty texts stay.

    Only ids and hashes are compared with the decisions; the texts cross the network once. Repeated rows leave one.
    """
    i, h, r = fresh(docs, "_id", "_h", "_r")
    gone = near_duplicates(docs, distance).groupBy("doc_id", "h").agg(F.max("kept").alias("stays"), (F.count("*") - F.count("group_id")).alias("alone"), F.count("*").alias("n"))
    gone = gone.filter("alone < n and (not stays or n > 1)").select(F.col("doc_id").alias(i), F.col("h").alias(h), F.col("stays").alias(r))
    (k,) = fresh(docs, "_k")
    keyed = docs.withColumn(h, F.xxhash64(F.col("text"))).withColumn(k, F.col("doc_id").cast("long"))
    same = keyed[k].eqNullSafe(gone[i]) & (keyed[h] == gone[h])
    left = keyed.join(gone.filter(~F.col(r)), same, "left_anti")
    # Rows that are repeated and stay: one of each.
    again = gone.filter(F.col(r))
    once = left.join(again, left[k].eqNullSafe(again[i]) & (left[h] == again[h]), "left_anti").select(*[col(c) for c in docs.columns])
    few = left.join(again, left[k].eqNullSafe(again[i]) & (left[h] == again[h]), "left_semi")
    one = few.withColumn(r, F.row_number().over(Window.partitionBy(k, h).orderBy(k))).filter(F.col(r) == 1).select(*[col(c) for c in docs.columns])
    return once.unionByName(one)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of near copies among all documents."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "group_id", "kept")
