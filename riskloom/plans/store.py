"""Snapshots as Parquet partitioned by commit, with an index; compaction and pruning."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trends as T
from ..operators.delta import apply_storage_delta, storage_delta


class SnapshotStore:
    """functions/commit_sha=... holds full snapshots, changes/commit_sha=... storage deltas, index the commits (sha, parents, ts)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, what: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{what}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def index(self) -> DataFrame:
        """(sha, parents, ts) in order of time, then sha."""
        found = self._read("index")
        return found.orderBy("ts", "sha") if found is not None else self.spark.createDataFrame([], "sha string, parents array<string>, ts long")

    def contains(self, sha: str) -> bool:
        return bool(self.index().filter(F.col("sha") == sha).limit(1).count())

    def persist(self, functions: DataFrame, sha: str, parents: list[str], ts: int, force: bool = False) -> None:
        """Writes a snapshot; one that exists is immutable unless forced. The index gets the commit once."""
        known = self.contains(sha)
        if known and not force:
            raise ValueError(f"snapshot {sha} exists")
        functions.drop("commit_sha").sortWithinPartitions(F.desc("lrs")).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/functions/commit_sha={sha}")
        if not known:
            self.spark.createDataFrame([(sha, parents, ts)], "sha string, parents array<string>, ts long").coalesce(1).write.mode("append").parquet(f"{self.root}/index")

    def load(self, sha: str) -> DataFrame | None:
        """The rows of a snapshot, rebuilt from its chain of storage deltas where it isn't stored in full; None if unknown."""
        full = self._read(f"functions/commit_sha={sha}")
        if full is not None:
            return full
        change = self._read(f"changes/commit_sha={sha}")
        if change is None:
            return None
        base = self.load(change.select("base_sha").first()[0]) if change.limit(1).count() else None
        return apply_storage_delta(base, change.drop("base_sha").filter("op <> 'same'")) if base is not None else None

    def window(self, last: int) -> DataFrame:
        """(function_id, k, lrs, band) of the newest snapshots, k their order."""
        chosen = T.window(self.index(), last).collect()
        parts = [self.load(r["sha"]).select("function_id", F.lit(r["k"]).cast("long").alias("k"), "lrs", "band") for r in chosen]
        out = parts[0] if parts else self.spark.createDataFrame([], "function_id string, k long, lrs double, band string")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _rewrite_index(self, keep: list[str]) -> None:
        rows = [r for r in self.index().collect() if r["sha"] in set(keep)]
        self.spark.createDataFrame(rows, "sha string, parents array<string>, ts long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/index")

    def compact(self, level: int, keep_recent: int = 1, dry_run: bool = False) -> list[str]:
        """Level 1: what lies between the oldest and the newest becomes deltas. Level 2: snapshots without a band change are dropped. The shas concerned."""
        rows = self.index().collect()
        if level == 0 or len(rows) < 3:
            return []
        if level == 1:
            plan = [r["sha"] for r in T.compact_level1(self.index(), keep_recent).filter("stored_as = 'delta'").orderBy("ts", "sha").collect()]
            if dry_run:
                return plan
            order = [r["sha"] for r in rows]
            for sha in plan:
                base = order[order.index(sha) - 1]
                change = storage_delta(self.load(base), self.load(sha)).withColumn("base_sha", F.lit(base))
                if not change.limit(1).count():
                    change = self.load(sha).limit(1).withColumns({"op": F.lit("same"), "base_sha": F.lit(base)})
                change.write.mode("overwrite").parquet(f"{self.root}/changes/commit_sha={sha}")
            for sha in plan:
                self._delete(f"functions/commit_sha={sha}")
            return plan
        keep = {r["k"] for r in T.compact_level2(self.window(len(rows))).collect()}
        drop = [r["sha"] for k, r in enumerate(rows) if k not in keep]
        if not dry_run and drop:
            for sha in [r["sha"] for k, r in enumerate(rows) if k in keep]:  # no delta may hang on a dropped base
                if self._read(f"functions/commit_sha={sha}") is None:
                    self.load(sha).write.mode("overwrite").parquet(f"{self.root}/functions/commit_sha={sha}")
                    self._delete(f"changes/commit_sha={sha}")
            for sha in drop:
                self._delete(f"functions/commit_sha={sha}")
                self._delete(f"changes/commit_sha={sha}")
            self._rewrite_index([r["sha"] for r in rows if r["sha"] not in drop])
        return drop

    def prune(self, reachable: DataFrame, as_of: int | None = None, older_than_days: int | None = None, dry_run: bool = False) -> list[str]:
        """Drops snapshots that no tip reaches and that are older than the cutoff; the shas concerned."""
        gone = [r["sha"] for r in T.prune(self.index().select("sha", "ts"), reachable, as_of, older_than_days).filter("action = 'pruned'").orderBy("ts", "sha").collect()]
        if not dry_run and gone:
            for sha in gone:
                self._delete(f"functions/commit_sha={sha}")
                self._delete(f"changes/commit_sha={sha}")
            self._rewrite_index([r["sha"] for r in self.index().collect() if r["sha"] not in gone])
        return gone
