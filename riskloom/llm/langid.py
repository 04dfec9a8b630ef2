"""Language identification by a string kernel.

The kernel is a blended spectrum: two texts are compared by the share of hashed n-grams of 1 to 3 bytes that are present in both, normalised
by their presence counts. Nyström landmarks approximate it: the kernel against M landmark texts times the inverse root of the landmarks'
own kernel gives M features, on which one-versus-rest kernel ridge regression is fitted. Scoring a batch is two matrix
products: presence bits by landmark bits, and the normalised kernel by the coefficients.

The fit takes a bounded sample (max_rows) of the texts whose language is given; all texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, col, fresh, read, text_slices

BITS = 14
#: Rows that the model is fitted to at most, and landmarks among them.
MAX_ROWS, LANDMARKS = 4000, 192
SEED, RIDGE = 3, 1e-2
#: A text is in a known language if its best score is a share SURE of the way from even odds (1 / languages) to 1. A short text may score lower if
#: NEIGHBOUR landmarks hold a share LEAST of its n-grams; none whose share is below FLOOR is, as the fit may have learnt a mislabelled text by heart.
#: With one language all scores are 1, so only this share tells, and it needs to be LONE.
SURE, NEIGHBOUR, LEAST, FLOOR, LONE = 1 / 3, 8, 0.75, 0.3, 0.55


def presence(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, 2**BITS) 0/1 bytes: which hashed n-grams of the folded text occur. Runs of other characters are one space."""
    n, size = len(offs) - 1, 1 << BITS
    b = _LOWER[data].astype(np.uint32)
    if len(b) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        b[1:][upper] += 32
    keep = b != 0
    keep[1:] |= b[:-1] != 0
    at = np.r_[0, np.cumsum(keep)][offs]
    b = np.where(b == 0, 32, b)[keep]
    out = np.zeros((n, size), np.uint8)
    codes = [b, (b[:-1] << 8) | b[1:] | np.uint32(1 << 24), (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
    idx = [((c * np.uint32(0x9E3779B1) + np.uint32(k << 20)) >> np.uint32(32 - BITS)).astype(np.int32) for k, c in enumerate(codes)]
    for i in range(n):
        for k, x in enumerate(idx):
            out[i, x[at[i] : max(at[i], at[i + 1] - k)]] = 1
    return out


@dataclass
class Model:
    names: list[str]
    landmarks: np.ndarray  # (2**BITS, M), columns divided by the root of their counts
    coefficients: np.ndarray  # (M, languages)
    bias: np.ndarray

    def scores(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) scores, and each text's resemblance: the share of its own n-grams, however few, that the NEIGHBOUR-th nearest landmark holds."""
        x = bits.astype(np.float32)
        root = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        kernel = (x @ self.landmarks) / root
        share = kernel / np.maximum(self.landmarks.max(0), 1e-6) / root
        k = min(NEIGHBOUR, kernel.shape[1])
        return kernel @ self.coefficients + self.bias, np.partition(share, -k, axis=1)[:, -k]


def fit_rows(packed: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """The model of rows of presence bits, packed eight to a byte."""
    names = sorted(set(langs))
    y = np.array([[float(x == n) for n in names] for x in langs])
    rng = np.random.default_rng(seed)
    # As many landmarks of each language as can be, in turn.
    by = [rng.permutation(np.flatnonzero(y[:, j])).tolist() for j in range(len(names))]
    chosen = [r[i] for i in range(max(map(len, by))) for r in by if i < len(r)][:landmarks]
    def unit(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(rows, axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    marks = unit(packed[chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    ok = values > 1e-6 * values.max()
    root = vectors[:, ok] / np.sqrt(values[ok])
    phi = np.concatenate([unit(packed[i : i + 256]) @ marks.T for i in range(0, len(packed), 256)]).astype(np.float64) @ root
    # Each language weighs alike.
    w = 1 / y.sum(0)[y.argmax(1)]
    w /= w.sum()
    mean, target = w @ phi, w @ y
    a = phi - mean
    beta = np.linalg.solve((a * w[:, None]).T @ a + ridge / len(packed) * np.eye(a.shape[1]), (a * w[:, None]).T @ (y - target))
    return Model(names, np.ascontiguousarray(marks.T), (root @ beta).astype(np.float32), (target - mean @ beta).astype(np.float32))


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS, seed: int = SEED) -> Model | None:
    """The model of docs (text, lang): a sample of the rows of the smallest hashes of text whose language and text aren't NULL or empty; None if there are none."""
    some = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("length(text) > 0 and length(lang) > 0")
    o = some.withColumn("o", F.xxhash64(F.lit(seed), "text"))
    # Only hashes meet in the choice; the cut then picks the texts where they lie.
    cut = o.select("o").orderBy("o").limit(max_rows).agg(F.max("o")).first()[0]
    if cut is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in text_slices(batch.column(0), 1 << 18):
                for i in range(0, last - first, 256):
                    j = min(last - first, i + 256)
                    packed = np.packbits(presence(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), axis=1)
                    part = batch.slice(first + i, j - i)
                    yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([r.tobytes() for r in packed], pa.binary())], ["lang", "o", "bits"])

    chosen = o.filter(F.col("o") <= F.lit(cut)).mapInArrow(run, "lang string, o long, bits binary")
    got = chosen.orderBy("o", "lang").limit(max_rows).toArrow()  # copies of one text share its hash: the limit holds them too
    packed = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(len(got), -1)
    return fit_rows(packed, got.column("lang").to_pylist(), landmarks)


def identified(docs: DataFrame, model: Model | None, name: str, score: str, like: str) -> DataFrame:
    """docs with three more columns: the best language of ``text``, its score, and the resemblance to landmarks; NULL for NULL texts, texts without a letter or digit, or without a model."""
    from pyspark.sql import types as T

    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            best, top, near, some = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, bool)
            if m is not None:
                for first, last, data, offs in text_slices(batch.column(at)):
                    for i in range(0, last - first, 256):
                        j = min(last - first, i + 256)
                        bits = presence(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                        s, near[first + i : first + j] = m.scores(bits)
                        best[first + i : first + j], top[first + i : first + j] = s.argmax(1), s.max(1)
                        some[first + i : first + j] = bits.sum(1, dtype=np.int64) > 3
            lang = pa.array(np.array([*(m.names if m else []), ""], object)[best], pa.string(), mask=~some)
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, pa.array(top, mask=~some), pa.array(near, mask=~some)], [*batch.schema.names, name, score, like])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(like, T.DoubleType())]))


def known(model: Model, score: str, like: str, least: float = LEAST) -> Column:
    """Whether a text with this score and resemblance is in one of the model's languages."""
    even = 1 / len(model.names)
    if len(model.names) == 1:
        return F.coalesce(F.col(like) >= LONE, F.lit(False))
    sure = (F.col(score) >= even + (1 - even) * SURE) & (F.col(like) >= FLOOR)
    return F.coalesce(sure | (F.col(like) >= least), F.lit(False))


def language_ids(docs: DataFrame, least: float = LEAST, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs (doc_id, text, lang) -> (doc_id, lang, predicted, score, resemblance, kept).

    kept: if known() by the score or, for short texts, a resemblance of ``least``; else the text is in none of the languages. Texts that are NULL or have no letters or digits
    have NULL predictions and are rejected only if they aren't NULL; without a model nothing is rejected. Repeated rows are identified each;
    an empty table gives no rows; extra columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(docs, max_rows)
    out = identified(narrow, model, "predicted", "score", "resemblance")
    kept = F.lit(True) if model is None else F.col("text").isNull() | known(model, "score", "resemblance", least)
    return out.select("doc_id", "lang", "predicted", "score", "resemblance", kept.alias("kept"))


def in_known_language(docs: DataFrame, least: float = LEAST, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that language_ids() keeps, with all their columns."""
    p, s, near = fresh(docs, "_predicted", "_score", "_near")
    model = fit(docs, max_rows)
    if model is None:
        return docs
    out = identified(docs, model, p, s, near)
    return out.filter(col("text").isNull() | known(model, s, near, least)).select(*[col(c) for c in docs.columns])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by its text."""
    return language_ids(read(spark, sf_dir, "documents"))
