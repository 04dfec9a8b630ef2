"""Token counts by a separator scan of flat token files.

A flat token file is nothing but token ids, documents one after another, each ended by the end-of-document id; no index says where they begin.
Files are read in blocks. Each block is searched for the separator in one vectorised comparison; a document's tokens may lie in
several blocks, or a block in the midst of one document, so boundaries are stitched by a prefix scan over the blocks' summaries: tokens and
separators before the block, and the place of the last separator before it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranged, read, stored

#: The end-of-document id, which the rank files of the two 50k byte-level vocabularies leave free.
END = 50256
BLOCK_TOKENS = 1 << 16
#: Blocks that the lower level of the prefix scan takes together.
RUN_BLOCKS = 4096
#: Rank file of the byte-level tokenizer.
RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(ranks: str):
    """The byte-level tokenizer of a rank file. The file must be on every executor, as installed packages are."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def flat_files(docs: DataFrame, ranks: str | None = None, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs (doc_id, text) -> (file, block, tokens, doc_ids): the documents as flat token files, one for each partition, in blocks of little-endian uint16 ids.

    NULL and empty texts are documents without tokens: a separator alone. Blocks are filled to the last token, whatever document it cuts.
    doc_ids are those of the documents whose separators lie in the block: not part of a file, but kept beside it so that counts can be told by document.
    """
    ranks = ranks or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        core, file, block, held, size, ids = encoder(ranks)._core_bpe, f"part-{TaskContext.get().partitionId():05d}", 0, [], 0, []
        stop = np.array([end], "<u2")

        def out(part: np.ndarray) -> pa.RecordBatch:
            n = int(np.count_nonzero(part == end))
            mine, ids[:n] = ids[:n], []
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([part.tobytes()], pa.binary()), pa.array([mine], pa.list_(pa.int64()))], ["file", "block", "tokens", "doc_ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text:
                    held.append(np.frombuffer(core.encode_to_tiktoken_buffer(text, set()), np.uint32).astype("<u2"))
                    size += len(held[-1])
                held.append(stop)
                ids.append(doc_id)
                size += 1
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    while len(flat) >= block_tokens:
                        yield out(flat[:block_tokens])
                        flat, block = flat[block_tokens:], block + 1
                    held, size = [flat], len(flat)
        if size:
            yield out(np.concatenate(held))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, block long, tokens binary, doc_ids array<long>")


def read_flat_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files under a path or glob as (file, block, tokens). Only names and lengths are listed; each task reads its own byte ranges, so a file may be of any size."""
    step = block_tokens * width
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / step) - 1, F.lit(0)))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, block in zip(*(c.to_pylist() for c in batch.columns)):
                raw = ranged(name, block * step, min(step, length - block * step))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([raw], pa.binary())], ["file", "block", "tokens"])

    return ranges.repartition("path", "block").mapInArrow(run, "file string, block long, tokens binary")


def _before(df: DataFrame, value: str, how, zero: int) -> DataFrame:
    """df (file, run, block, ...) with ``value`` replaced by how() of it over the blocks of the file that come before: over the runs before, then within the run."""
    runs = df.groupBy(F.col("file").alias("_f"), F.col("run").alias("_r")).agg(how(value).alias("_v"))
    over = Window.partitionBy("_f").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_f", "_r", how("_v").over(over).alias("_v"))
    within = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn(value, how(value).over(within)).join(runs, F.col("file").eqNullSafe(F.col("_f")) & (F.col("run") == F.col("_r")))
    both = F.array(F.coalesce("_v", F.lit(zero)), F.coalesce(value, F.lit(zero)))
    return out.withColumn(value, F.array_max(both) if how is F.max else both[0] + both[1]).drop("_f", "_r", "_v")


def separator_scan(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """blocks (file, block, tokens) -> (file, ordinal, start, n_tokens): each document of each file, without its separator; with doc_id if blocks has doc_ids.

    Tokens are little-endian ids of ``width`` bytes. Tokens after the last separator of a file are a document of their own; a separator at
    the very begin, or two in a row, make documents of 0 tokens. NULL or empty blocks, and bytes that don't fill a token, count for
    nothing. Blocks may come in any order and spread. Of blocks with the same file and number one counts, the longest; a NULL number comes before
    all others. An empty table gives no rows; extra columns are ignored.
    """
    kind = {1: "<u1", 2: "<u2", 4: "<u4"}[width]
    named = "doc_ids" in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = [], []
            for x in batch.column(2):
                raw = x.as_buffer()
                ids = np.frombuffer(raw, kind, count=raw.size // width) if raw is not None else np.zeros(0, kind)
                n.append(len(ids))
                at.append(np.flatnonzero(ids == end))
            offs = np.r_[0, np.cumsum([len(a) for a in at])].astype(np.int32)
            flat = np.concatenate(at).astype(np.int64) if at else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)), batch.column(3)], ["file", "block", "n", "at", "ids"])

    ids = F.col("doc_ids").cast("array<long>") if named else F.lit(None).cast("array<long>")
    number = F.coalesce(F.col("block").cast("long"), F.lit(-(1 << 62)))
    found = blocks.select(F.col("file").cast("string"), number.alias("block"), F.col("tokens").cast("binary"), ids.alias("ids")).mapInArrow(run, "file string, block long, n long, at array<long>, ids array<long>")
    found = stored(found.groupBy("file", "block").agg(F.max(F.struct("n", "at", "ids")).alias("x")).select("file", "block", "x.*"), "separators")
    # The prefix scan is over summaries of the blocks, in two levels; separators stay where they are.
    sums = found.select("file", "block", F.floor(F.col("block") / RUN_BLOCKS).alias("run"), F.col("n").alias("base"), F.size("at").cast("long").alias("first"), F.try_element_at("at", F.lit(-1)).alias("last"))
    sums = _before(_before(sums, "base", F.sum, 0), "first", F.sum, 0)
    sums = _before(sums.withColumn("last", F.col("base") + F.col("last")), "last", F.max, -1)
    ends = found.groupBy(F.col("file").alias("_f")).agg(F.max("block").alias("_end"))
    sums = sums.join(ends, F.col("file").eqNullSafe(F.col("_f"))).select(F.col("file").alias("_f"), F.col("block").alias("_b"), "base", "first", (F.col("last") + 1).alias("after"), (F.col("block") == F.col("_end")).alias("_last"))
    placed = found.join(sums, F.col("file").eqNullSafe(F.col("_f")) & (F.col("block") == F.col("_b")))
    placed = placed.withColumn("at", F.expr("transform(at, x -> x + base)"))
    # Of a block the documents that end in it, and of the last block also what follows its last separator.
    upto = F.col("base") + F.col("n")
    tail = F.coalesce(F.try_element_at("at", F.lit(-1)) + 1, F.col("after"))
    ends = F.when(F.col("_last") & (upto > tail), F.concat("at", F.array(upto))).otherwise(F.col("at"))
    docs = placed.withColumn("ends", ends).select("file", "first", "after", "ids", F.col("ends"), F.posexplode("ends").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("after")).otherwise(F.expr("element_at(ends, k)") + 1)
    doc_id = [F.get("ids", F.col("k")).alias("doc_id")] if named else []
    return docs.select(*doc_id, "file", (F.col("first") + F.col("k")).cast("long").alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"))


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as flat token files, and the token count of each document found in them again. Files and places depend on how Spark splits its input; counts by document don't."""
    return separator_scan(flat_files(read(spark, sf_dir, "documents"))).select("doc_id", "n_tokens")
