"""Quality classifier: naive Bayes support vectors.

A document's features are the indicators of its n-grams: byte trigrams, and n-grams (n = 1..4) of word shapes, where a word's shape tells its
case, length class, symbols, and whether it repeats the word before. Each indicator is scaled by its log-count ratio between the classes, rows
are scaled to unit length, and a linear hinge-loss model is fitted to them by dual coordinate descent.

The fit takes a bounded sample of labelled rows (max_labelled); all documents are scored with whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, mix64, prefix_hash, read, span_hash, text_slices, words

FEATURE_BITS = 18
#: Labelled rows that the model is fitted to at most, those of the smallest hashes of (seed, doc_id).
MAX_LABELLED = 8000
SEED, SMOOTH, COST, EPOCHS = 5, 0.5, 4.0, 30
#: Documents below this score are rejected.
THRESHOLD = 0.0
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower or other letter, 3 digit, 4 symbol
for _c in range(256):
    _KIND[_c] = 3 if 48 <= _c < 58 else 1 if 65 <= _c < 91 else 2 if 97 <= _c < 123 or _c >= 128 else 4
_DIGIT = np.arange(256, dtype=np.uint8)
_DIGIT[48:58] = 48


def features(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """For each document its distinct feature numbers."""
    n, size = len(offs) - 1, 1 << FEATURE_BITS
    d = _DIGIT[data].astype(np.uint32)
    code = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:] if len(d) > 2 else np.zeros(0, np.uint32)
    tri = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS)).astype(np.int32)
    b, starts, ends, doc = words(data, offs, folded=False)
    kind = _KIND[data]
    count = [np.r_[0, np.cumsum(kind == k, dtype=np.int32)] for k in (1, 2, 3, 4)]
    up, low, dig, sym = (c[ends] - c[starts] for c in count)
    h = span_hash(prefix_hash(b), starts, ends)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    length = np.digitize(ends - starts, [2, 4, 8, 16, 40])
    case = np.where(up + low == 0, 0, np.where(low == 0, np.where(up > 1, 1, 2), np.where((up > 0) & (kind[starts] == 1), 3, np.where(up > 0, 4, 5))))
    shape = ((((length * 6 + case) * 4 + np.minimum(sym, 3)) * 2 + (dig > 0)) * 2 + again).astype(np.uint64) + np.uint64(1)
    grams, run = [], np.zeros(len(shape), np.uint64)
    at = np.searchsorted(doc, np.arange(n + 1))
    begin = at[:-1][doc]
    for k in range(4):  # shapes of the words i-k..i
        run = run * np.uint64(1000003) + np.concatenate([np.zeros(min(k, len(shape)), np.uint64), shape[: max(0, len(shape) - k)]])
        f = (mix64(run + np.uint64(k)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        grams.append(np.where(np.arange(len(f)) - k >= begin, f, -1))
    last = np.empty(size, np.int32)
    for i in range(n):
        parts = [tri[offs[i] : max(offs[i], offs[i + 1] - 2)], *(g[at[i] : at[i + 1]] for g in grams)]
        f = np.concatenate(parts)
        f = f[f >= 0]
        order = np.arange(len(f), dtype=np.int32)
        last[f] = order
        yield f[last[f] == order]


@dataclass
class Model:
    """weights: of each feature, scaling included; a document scores sum(weights of its features) / sqrt(sum of ratio^2) + bias."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float

    def score(self, f: np.ndarray) -> float:
        return float(self.weights[f].sum() / np.sqrt(max(1e-12, self.squares[f].sum()))) + self.bias


def fit_rows(rows: list[np.ndarray], good: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> Model | None:
    """A model of rows of distinct features; None unless both classes occur."""
    y = np.where(good, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return None
    size = 1 << FEATURE_BITS
    pos, neg = (np.bincount(np.concatenate([r for r, g in zip(rows, good) if bool(g) == side] + [np.zeros(0, np.int32)]).astype(np.int64), minlength=size) + SMOOTH for side in (True, False))
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))
    unit = [(ratio[r] / np.sqrt(max(1e-12, float((ratio[r] ** 2).sum())))).astype(np.float32) for r in rows]
    # Dual coordinate descent for the hinge loss; the bias is a feature of value 1, classes weigh alike.
    w, bias, alpha, rng = np.zeros(size), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    most = np.where(good, cost * len(y) / (2 * good.sum()), cost * len(y) / (2 * (~good).sum()))
    diagonal = np.array([float(v @ v) + 1.0 for v in unit])
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], unit[i]
            gradient = y[i] * (float(w[f] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> Model | None:
    """The model of docs (doc_id, text) with labels (doc_id, quality); None if either class is missing. Rows with NULL id, text or quality aren't used.

    At most max_labelled rows are fitted to: those of the smallest hashes of their ids, and of repeated ids those of the smallest hashes of their texts.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("quality") > 0).alias("good"))
    some = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text")).filter("_doc is not null and text is not null")
    # The sample is chosen by id before any text moves.
    chosen = known.join(some.select(F.col("_doc").alias("_id")).distinct(), "_id", "left_semi").withColumn("o", F.xxhash64(F.lit(seed), "_id")).orderBy("o", "_id").limit(max_labelled)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    sample = some.join(F.broadcast(chosen), some["_doc"] == chosen["_id"])  # max_labelled bounds the ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in text_slices(batch.column(0)):
                part = batch.slice(first, last - first)
                f = pa.array(list(features(data, offs)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), f], ["o", "good", "h", "f"])

    # Ids may be repeated, with any texts: the limit bounds the rows too, and the order makes their choice the same on every cluster.
    found = sample.select("text", "o", "good", F.xxhash64("text").alias("h")).mapInArrow(run, "o long, good boolean, h long, f array<int>")
    got = found.orderBy("o", "h").limit(max_labelled).toArrow().combine_chunks()
    column = got.column("f").combine_chunks()
    if not len(got):
        return None
    flat, offs = column.flatten().to_numpy(), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
    return fit_rows([flat[a:b] for a, b in zip(offs[:-1], offs[1:])], got.column("good").to_numpy().astype(bool))


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with one more column, the score of ``text``. NULL texts, and all without a model, score NULL; an empty text scores the bias."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, np.nan)
            if m is not None:
                for first, _, data, offs in text_slices(batch.column(at)):
                    for i, f in enumerate(features(data, offs)):
                        out[first + i] = m.score(f)
            null = np.isnan(out) | batch.column(at).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=null)], [*batch.schema.names, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> (doc_id, score, kept).

    A document is kept unless its score is below the threshold; NULL scores (NULL text; no labelled rows of both classes) keep it. Several
    labels of a document count as their largest. Repeated rows are scored each; an empty table gives no rows; extra columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(narrow, fit(docs, labels, max_labelled)).select("doc_id", "score")
    return out.withColumn("kept", F.coalesce(F.col("score") >= threshold, F.lit(True)))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that quality_scores() keeps, with all their columns."""
    (s,) = fresh(docs, "_score")
    out = scored(docs, fit(docs, labels, max_labelled), s)
    return out.filter(F.coalesce(F.col(s) >= threshold, F.lit(True))).select(*[col(c) for c in docs.columns])


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document and whether it is kept."""
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
