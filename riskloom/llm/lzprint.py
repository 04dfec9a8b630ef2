"""Lempel-Ziv phrase fingerprints.

A document's folded words are parsed into dictionary phrases as LZ78 does: each phrase is the longest one seen before plus one word. The set of
phrases is what a compressor would learn of the text, and documents that share much of it compress well together. (Over words rather
than bytes: after an edit the parse falls back into step at once, so near copies share over half their phrases and others few.) The set is
hashed, and documents are compared by the least hashes of their sets under 128 permutations.

Candidates come from an inverted index of bands of five least hashes. A signature keeps four bits of each least hash (b-bit minwise hashing) and
is posted with each band, so the signatures of a candidate pair are compared in full where the two meet. The estimate's standard error at
the threshold is 0.046, against 0.043 of whole 32-bit hashes; 25 bands meet for 0.87 of pairs at the threshold itself and for 0.99
at a similarity of 0.7. Groups are the connected components of the pairs that reach the threshold; see components.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, prefix_hash, read, span_hash, stored, text_slices, words
from .components import components, popcount, posting_links

HASHES = 128
BANDS, ROWS = 25, 5
#: Words of a signature of four bits a hash, and their columns.
WORDS = HASHES * 4 // 64
PRINT = [f"p{k}" for k in range(WORDS)]
#: Estimated share of phrases in common (Jaccard) from which documents belong together.
SIMILARITY = 0.6


_NEW = object()


def phrase_ends(seq: list[int]) -> list[int]:
    """LZ78 over a sequence of numbers: the ends of its phrases; the last may be one that was seen before."""
    root: dict = {}
    ends, node = [], root
    end = ends.append
    for i, w in enumerate(seq, 1):
        to = node.get(w, _NEW)
        if to is _NEW:
            node[w] = None
            end(i)
            node = root
        else:
            if to is None:
                to = node[w] = {}
            node = to
    if node is not root:
        end(len(seq))
    return ends


def phrase_sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """For each document the hashes of its phrases. A text without words is one phrase, an empty one has none."""
    n = len(offs) - 1
    b, starts, ends, doc = words(data, offs)
    bare = np.setdiff1d(np.flatnonzero(np.diff(offs)), doc)
    h = span_hash(prefix_hash(b), starts, ends) >> np.uint64(16)
    at = np.searchsorted(doc, np.arange(n + 1))
    raw = prefix_hash(data) if len(bare) else None
    bare = set(bare.tolist())
    with np.errstate(over="ignore"):
        sums = prefix_hash(h)
        for i in range(n):
            if i in bare:
                yield span_hash(raw, offs[i : i + 1], offs[i + 1 : i + 2])
                continue
            cut = np.array(phrase_ends(h[at[i] : at[i + 1]].tolist()), np.int64) + at[i]
            begin = np.r_[at[i], cut[:-1]] if len(cut) else cut
            yield span_hash(sums, begin, cut)


def _permutations(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint32)


def signature(phrases: np.ndarray) -> np.ndarray:
    """The least of the phrases' hashes under each permutation."""
    a, b = _permutations()
    h = phrases.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(h), 2048):
        x = h[None, s : s + 2048] * a[:, None] + b[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(1), out=out)
    return out


def sketch(sig: np.ndarray) -> np.ndarray:
    """(n, 8) uint64: the b-bit signature, four bits of each of the 128 least hashes."""
    four = ((sig >> np.uint32(9)) & np.uint32(15)).astype(np.uint64).reshape(len(sig), WORDS, 16)
    return (four << (4 * np.arange(16, dtype=np.uint64))).sum(2, dtype=np.uint64)


def estimate(x: np.ndarray) -> np.ndarray:
    """The Jaccard similarity estimated from the XOR of signatures; unlike phrases agree in four bits once in 16 times."""
    y = x | (x >> np.uint64(1))
    differ = popcount((y | (y >> np.uint64(2))) & np.uint64(0x1111111111111111))
    return ((HASHES - differ) / HASHES - 1 / 16) * 16 / 15


def near(similarity: float):
    return lambda a, b: estimate(a ^ b) >= similarity


def phrase_fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_phrases, id, p0..p7, k0..k24): how many phrases, a hash of the least hashes, their signature, and a key for each band; NULL but for the first two where text is NULL or empty."""
    keys = [f"k{j}" for j in range(BANDS)]
    names = ["id", *PRINT, *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in text_slices(batch.column(1)):
                sigs, n = np.zeros((last - first, HASHES), np.uint32), np.zeros(last - first, np.int64)
                for i, p in enumerate(phrase_sets(data, offs)):
                    n[i] = len(p)
                    if len(p):
                        sigs[i] = signature(p)
                key, whole = np.zeros((last - first, BANDS), np.uint64), np.zeros(last - first, np.uint64)
                for j in range(HASHES):
                    whole = mix64(whole + sigs[:, j] + np.uint64(1))
                    if j < BANDS * ROWS:
                        key[:, j // ROWS] = mix64(key[:, j // ROWS] + sigs[:, j] + np.uint64(j // ROWS + 1))
                columns = np.concatenate([whole[:, None], sketch(sigs), key], 1).view(np.int64)
                ps = [pa.array(np.ascontiguousarray(columns[:, k]), mask=n == 0) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n), *ps], ["doc_id", "n_phrases", *names])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_phrases long, " + ", ".join(f"{c} long" for c in names))


def met(postings: DataFrame) -> DataFrame:
    """postings (key, id) without those that are alone in their list. Of a list no more than a batch is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last posting, whether it has met another, and was passed on
        for batch in batches:
            key, ids = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(key):
                continue
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            out = same.copy()
            out[:-1] |= same[1:]
            if last is not None and last[0] == key[0]:
                out[0] = True
                if not last[2]:
                    yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]])], ["key", "id"])
            last = key[-1], ids[-1], bool(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(ids[out])], ["key", "id"])

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "key long, id long")


def phrase_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_phrases, sketch, group_id): the group of documents whose phrase sets are alike, named by its smallest doc_id.

    A document like no other is a group of its own. NULL and empty texts have 0 phrases and NULL sketch and group. Rows of equal least
    hashes are together; repeated rows stay repeated; groups of NULL ids alone have a NULL group. An empty table gives no rows; extra columns are ignored.
    """
    rows = stored(phrase_fingerprints(docs), "phrases")
    some = rows.filter("id is not null")
    # Vertices are whole signatures: copies are brought together, on each executor first, before any band is posted.
    keys = [c for c in rows.columns if c[0] == "k"]
    vertices = stored(some.groupBy("id").agg(*[F.first(c).alias(c) for c in [*PRINT, *keys]]), "vertices")
    # Most postings are alone in their list: signatures go only with those that aren't.
    postings = met(vertices.select(F.explode(F.array(*keys)).alias("key"), "id")).join(vertices.select("id", *PRINT), "id").select("key", "id", *PRINT)
    roots = components(posting_links(postings, near(similarity)))
    named = some.select("doc_id", "n_phrases", "id", *PRINT).join(roots, "id", "left").withColumn("g", F.coalesce("root", "id"))
    least = named.groupBy("g").agg(F.min("doc_id").alias("group_id"))
    text = F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in PRINT]).alias("sketch")
    out = named.join(least, "g").select("doc_id", "n_phrases", text, "group_id")
    none = rows.filter("id is null").select("doc_id", "n_phrases", F.lit(None).cast("string").alias("sketch"), F.lit(None).cast("long").alias("group_id"))
    return out.unionByName(none)


def op7_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase fingerprint and group of every document."""
    return phrase_groups(read(spark, sf_dir, "documents"))
