"""Exact top-k search by a three-phase uniform threshold over vertically split vectors.

The score of two unit vectors, their dot product, is the sum of the partial dot products of M blocks of dimensions; each block is one score
list. Phase 1 gathers for every query the best k of each list among the items of one chunk, the query's own, and resolves these candidates;
the k-th best total is a safe cutoff: k items reach it, so no answer of the whole table is below it. A row whose total reaches the cutoff
has a partial score of at least cutoff / M in some list (else its sum were less), so in phase 2 the cutoff goes out with the queries and each
list reports the entries that reach it. Phase 3 resolves the exact totals of those and keeps the best k. The answer is that of brute force.

Phase 2 is one pass over a grid of (query chunk, item chunk) cells whose row counts are bounded, so a cell fits in a worker at any table size.
Within a cell the lists are read one after the other, and before each the items go for which no query of the tile can still reach its cutoff: the
sum of the lists read so far plus the product of the norms of the rest bounds the total. Cells send on their best k of a query only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

K, LISTS = 10, 4
#: Rows of a chunk; a cell multiplies two chunks of vectors.
CHUNK = 8192
#: Rows of a cell that are multiplied at a time: bounds the scratch memory to a few MB.
TILE = 512
#: How far rounding may lower a float32 partial score.
SLACK = 1e-5


def unit_vectors(rows: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v): unit vectors in double precision, one for each id.

    Left out: NULL ids; NULL or empty vectors, those with NULL, NaN or infinite elements, of another length than dim, or of norm 0. dim is
    the most frequent length unless given (the longer of two). Of rows with the same id the smallest vector counts.
    """
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    good = good.filter(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    if dim is None:
        top = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = top["d"] if top else 1
    good = good.filter(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return good.withColumn("n", norm).filter("n > 0").select("vec_id", F.expr("transform(v, x -> x / n)").alias("v"))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    v = table.column(column).combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def _lists(dim: int, lists: int) -> list[slice]:
    edges = np.linspace(0, dim, min(lists, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def exact_top_k(rows: DataFrame, k: int = K, lists: int = LISTS, chunk: int = CHUNK, dim: int | None = None, every: int = 1) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, rank, neighbor_id, score): the k other rows of the greatest cosine, for every row whose id is divisible by ``every``.

    Ties in the score, rounded to 9 places, go to the smaller neighbor_id; rows with fewer than k others have them all. See unit_vectors()
    for rows that are left out, as queries and as answers. An empty table gives no rows; extra columns are ignored.
    """
    units = unit_vectors(rows, dim)
    units = stored(units.withColumn("c", F.xxhash64("vec_id")).withColumn("asks", F.pmod("vec_id", F.lit(every)) == 0), "units")
    n, asked = units.agg(F.count("*"), F.count_if("asks")).first()
    m, mq = max(1, -(-n // chunk)), max(1, -(-asked // chunk))
    items = units.withColumn("xc", F.pmod("c", F.lit(m)).cast("int"))
    asking = units.filter("asks").select("vec_id", "v", F.pmod("c", F.lit(m)).cast("int").alias("xc"), F.pmod(F.xxhash64("c"), F.lit(mq)).cast("int").alias("qc"))

    def grid(queries: DataFrame, items: DataFrame):
        """Cells (qc, xc) of query rows (side 0: vec_id, v, cut, qc, xc) and item rows (side 1)."""
        q = queries.select(F.lit(0).alias("side"), "vec_id", "v", "cut", "qc", "xc")
        x = items.select(F.lit(1).alias("side"), "vec_id", "v", F.lit(None).cast("double").alias("cut"), "qc", "xc")
        return q.unionByName(x).groupBy("qc", "xc")

    def sides(cell: pa.Table):
        side = cell.column("side").to_numpy()
        q, x = cell.filter(pa.array(side == 0)), cell.filter(pa.array(side == 1))
        return q, x, q.column("vec_id").to_numpy(), x.column("vec_id").to_numpy()

    def found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
        a, b, s = (np.concatenate(z) if parts else np.zeros(0) for z in (zip(*parts) if parts else ([], [], [])))
        return pa.table({"vec_id": pa.array(a, pa.int64()), "neighbor_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    def resolve(qv, xv, i, j) -> np.ndarray:
        out = np.empty(len(i))
        for s in range(0, len(i), 1 << 14):
            out[s : s + (1 << 14)] = np.einsum("ij,ij->i", qv[i[s : s + (1 << 14)]], xv[j[s : s + (1 << 14)]])
        return np.floor(out * 1e9 + 0.5) / 1e9

    def best(i: np.ndarray, ids: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Of entries (query, id, score) those of the best k of each query."""
        order = np.lexsort((ids, -s, i))
        i = i[order]
        start = np.searchsorted(i, i)
        return order[np.arange(len(i)) - start < k]

    def phase1(cell: pa.Table) -> pa.Table:
        q, x, qi, xi = sides(cell)
        if not len(qi) or not len(xi):
            return found([])
        qv, xv, parts = _matrix(q, "v"), _matrix(x, "v"), []
        qf, xf = qv.astype(np.float32), xv.astype(np.float32)
        take = min(k + 1, len(xi))  # one more, for the query itself
        for at in range(0, len(qi), TILE):
            some = []
            for block in _lists(qv.shape[1], lists):
                part = qf[at : at + TILE, block] @ xf[:, block].T
                some.append(np.argpartition(-part, take - 1, axis=1)[:, :take])
            j = np.sort(np.concatenate(some, 1), axis=1)
            i = np.repeat(np.arange(len(j)), j.shape[1])
            first = np.ones(j.shape, bool)
            first[:, 1:] = j[:, 1:] != j[:, :-1]
            j = j.ravel()
            ok = first.ravel() & (xi[j] != qi[at : at + TILE][i])
            i, j = i[ok], j[ok]
            s = resolve(qv[at : at + TILE], xv, i, j)
            keep = best(i, xi[j], s)
            parts.append((qi[at : at + TILE][i[keep]], xi[j[keep]], s[keep]))
        return found(parts)

    def phase2(cell: pa.Table) -> pa.Table:
        q, x, qi, xi = sides(cell)
        if not len(qi) or not len(xi):
            return found([])
        qv, xv, parts = _matrix(q, "v"), _matrix(x, "v"), []
        qf, xf = qv.astype(np.float32), xv.astype(np.float32)
        cut = q.column("cut").to_numpy(zero_copy_only=False)
        cut = np.where(np.isnan(cut), -np.inf, cut)
        blocks = _lists(qv.shape[1], lists)
        # Norms of the dimensions from each block on.
        rest_q, rest_x = (np.stack([np.sqrt((v[:, b.start :].astype(np.float64) ** 2).sum(1)) for b in blocks] + [np.zeros(len(v))]).astype(np.float32) for v in (qf, xf))
        for at in range(0, len(qi), TILE):
            tile = slice(at, at + TILE)
            whole = (cut[tile] - len(blocks) * SLACK).astype(np.float32)[:, None]
            least = (cut[tile] / len(blocks) - SLACK).astype(np.float32)[:, None]
            live = np.arange(len(xi))
            total, some = np.zeros((len(least), len(live)), np.float32), np.zeros((len(least), len(live)), bool)
            for k_, block in enumerate(blocks):
                part = qf[tile, block] @ xf[live, block].T
                some |= part >= least
                total += part
                can = (total + rest_q[k_ + 1, tile][:, None] * rest_x[k_ + 1, live][None, :] >= whole).any(0)
                if can.sum() < 0.8 * len(live):
                    live, total, some = live[can], np.ascontiguousarray(total[:, can]), np.ascontiguousarray(some[:, can])
                if not len(live):
                    break
            some &= total >= whole  # the lists' sum
            i, j = np.nonzero(some)
            j = live[j]
            ok = xi[j] != qi[tile][i]
            i, j = i[ok], j[ok]
            s = resolve(qv[tile], xv, i, j)
            keep = best(i, xi[j], s)
            parts.append((qi[tile][i[keep]], xi[j[keep]], s[keep]))
        return found(parts)

    schema = "vec_id long, neighbor_id long, score double"
    ranked = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id")
    # Phase 1: each query in its own chunk of items alone.
    local = grid(asking.withColumn("cut", F.lit(None).cast("double")).withColumn("qc", F.lit(0)), items.withColumn("qc", F.lit(0))).applyInArrow(phase1, schema)
    cuts = local.groupBy("vec_id").agg(F.count("*").alias("n"), F.min("score").alias("cut")).filter(F.col("n") >= k).select(F.col("vec_id").alias("q"), "cut")
    queries = stored(asking.join(cuts, F.col("vec_id") == F.col("q"), "left").select("vec_id", "v", "qc", "cut"), "cuts")
    everywhere = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    full = grid(queries.select("*", everywhere("xc", m)), items.select("vec_id", "v", "xc", everywhere("qc", mq))).applyInArrow(phase2, schema)
    return full.withColumn("rank", F.row_number().over(ranked).cast("long")).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", F.round("score", 6).alias("score"))


#: Each vector whose id is divisible by this asks; all rows answer.
EVERY = 20


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all other vectors, for each vector whose id is divisible by 20."""
    return exact_top_k(read(spark, sf_dir, "embeddings"), every=EVERY)


OP4_SQL = f"""
WITH g AS (SELECT vec_id::BIGINT AS vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
e AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM g WHERE list_inner_product(v, v) > 0),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, floor(list_inner_product(a.v, b.v) / a.n / b.n * 1e9 + 0.5) / 1e9 AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbor_id) AS rank, neighbor_id, s FROM p)
SELECT vec_id, rank::BIGINT AS rank, neighbor_id, round(s, 6) AS score FROM r WHERE rank <= {K}
"""
