"""Time series of snapshots: velocity, stability, refactorings, compaction, pruning. Snapshots are (function_id, k, lrs, band), k their position in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLAT, IMPROVED, REBOUND = 1e-9, -1.0, 0.5


def window(index: DataFrame, last: int) -> DataFrame:
    """The last entries (sha, ts) of the index, in order, as (sha, ts, k) from 0."""
    recent = index.orderBy(F.desc("ts"), F.desc("sha")).limit(last)
    return recent.withColumn("k", F.row_number().over(Window.orderBy("ts", "sha")) - 1)


def numbered(snapshots: DataFrame) -> DataFrame:
    """snapshots with i: the position of k among the distinct ones, from 0."""
    ks = snapshots.select("k").distinct().withColumn("i", (F.row_number().over(Window.orderBy("k")) - 1).cast("long"))
    return snapshots.join(F.broadcast(ks), "k")


def velocities(snapshots: DataFrame, flat: float = FLAT) -> DataFrame:
    """(function_id, velocity, direction, first_lrs, last_lrs, commit_count) of functions with at least two snapshots."""
    g = snapshots.groupBy("function_id").agg(F.min_by("lrs", "k").alias("first_lrs"), F.max_by("lrs", "k").alias("last_lrs"), F.count("*").alias("commit_count")).filter("commit_count >= 2")
    v = (F.col("last_lrs") - F.col("first_lrs")) / (F.col("commit_count") - 1)
    return g.withColumn("velocity", v).withColumn("direction", F.when(F.abs("velocity") < flat, "flat").when(F.col("velocity") > 0, "positive").otherwise("negative"))


def stability(snapshots: DataFrame, top: int = 5) -> DataFrame:
    """(function_id, stability, overlap_ratio, appearances, total_snapshots) of functions that were ever among the riskiest of a snapshot; ties go by id."""
    total = snapshots.agg(F.countDistinct("k").alias("total_snapshots"))
    best = snapshots.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("lrs"), "function_id"))).filter(F.col("r") <= top)
    n = best.groupBy("function_id").agg(F.count("*").alias("appearances")).crossJoin(F.broadcast(total)).withColumn("overlap_ratio", F.col("appearances") / F.col("total_snapshots"))
    return n.withColumn("stability", F.when(F.col("overlap_ratio") >= 0.8, "stable").when(F.col("overlap_ratio") >= 0.5, "emerging").otherwise("volatile"))


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """(function_id, i, delta) against the snapshot just before; functions that skipped it have none there."""
    w = Window.partitionBy("function_id").orderBy("i")
    d = numbered(snapshots).withColumns({"_l": F.lag("lrs").over(w), "_i": F.lag("i").over(w)})
    return d.filter("i - _i = 1").select("function_id", "i", (F.col("lrs") - F.col("_l")).alias("delta"))


def refactorings(snapshots: DataFrame, improved: float = IMPROVED, rebound: float = REBOUND) -> DataFrame:
    """(function_id, outcome, improvement_delta, sustained_commits, rebound_detected) of functions that once fell by at least 1.

    The improvement itself and the two positions after it are walked: each further fall sustains it, a rise of 0.5 ends the walk as a rebound. The walk
    begins at the improvement, so it is sustained twice at least and no outcome is 'cosmetic'.
    """
    d = snapshot_deltas(snapshots)
    first = d.filter(F.col("delta") <= improved).groupBy("function_id").agg(F.min("i").alias("f"), F.min_by("delta", "i").alias("improvement_delta"))
    near = d.join(first, "function_id").filter("i >= f and i < f + 3")
    back = near.groupBy("function_id", "f", "improvement_delta").agg(F.min(F.when(F.col("delta") >= rebound, F.col("i"))).alias("r"), F.collect_list(F.when(F.col("delta") <= improved, F.col("i"))).alias("falls"))
    sustained = F.size(F.filter("falls", lambda i: i < F.coalesce(F.col("r"), F.lit(1 << 40)))) + 1
    out = back.select("function_id", "improvement_delta", sustained.cast("long").alias("sustained_commits"), F.col("r").isNotNull().alias("rebound_detected"))
    outcome = F.when(F.col("sustained_commits") < 2, "cosmetic").when(F.col("rebound_detected"), "partial").otherwise("successful")
    return out.withColumn("outcome", outcome)


def compact_level1(index: DataFrame, keep_recent: int = 1) -> DataFrame:
    """(sha, ts, stored_as): 'full' for the oldest and the newest keep_recent snapshots, 'delta' for those between."""
    total = index.count()
    w = Window.orderBy("ts", "sha")
    x = index.withColumn("_r", F.row_number().over(w))
    return x.withColumn("stored_as", F.when((F.col("_r") == 1) | (F.col("_r") > total - keep_recent), "full").otherwise("delta")).drop("_r")


def compact_level2(snapshots: DataFrame) -> DataFrame:
    """(k): the snapshots to keep: the oldest, the newest, and each in which a function came, went or changed its band since the last kept one.

    Any change since the last kept snapshot shows as a change against the one just before it, or is undone; to tell these apart each snapshot is
    reduced to an order-free hash of its (function_id, band) pairs, and only these hashes, one row a snapshot, are walked in order.
    """
    pair = F.xxhash64("function_id", "band").cast("decimal(38,0)")
    state = snapshots.groupBy("k").agg(F.sum(pair).alias("s"), F.count("*").alias("n"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(batches) or [pd.DataFrame({"k": [], "s": [], "n": []})]).sort_values("k")
        keep, last = [], None
        for i, (k, s, n) in enumerate(zip(x["k"], x["s"], x["n"])):
            if i == 0 or i == len(x) - 1 or (s, n) != last:
                keep.append(k)
                last = (s, n)
        yield pd.DataFrame({"k": keep}, dtype="int64")

    return state.repartition(1).mapInPandas(walk, "k long")


def prune(index: DataFrame, reachable: DataFrame, as_of: int | None = None, older_than_days: int | None = None) -> DataFrame:
    """index (sha, ts) with ``action``: kept if reachable (sha) or, where a cutoff is given, not older than it; else pruned."""
    j = index.join(reachable.select("sha", F.lit(True).alias("_r")), "sha", "left")
    keep = F.coalesce("_r", F.lit(False))
    if older_than_days is not None:
        keep = keep | (F.col("ts") >= as_of - older_than_days * 86400)
    return j.withColumn("action", F.when(keep, "kept").otherwise("pruned")).drop("_r")
