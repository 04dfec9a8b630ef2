"""What a user runs: analyze, diff, trends, train, compact and prune."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scoring as S
from ..operators import coupling as C
from ..operators import delta as D
from ..operators import extract as X
from ..operators import graph as G
from ..operators import history as H
from ..operators import joins as J
from ..operators import policy as P
from ..operators import quantiles as Q
from ..operators import ranking as R
from ..operators import trends as T
from ..sources import files as SF
from ..sources.shared import stored
from .store import SnapshotStore


def call_edges(reports: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(src, dst) of function_id, by name: the same file first, then imported files, then the first anywhere."""
    calls = reports.select(F.col("function_id").alias("caller"), F.col("file").alias("caller_file"), F.explode("callees").alias("name"))
    defs = reports.select("function_id", "file", F.col("function").alias("name"), F.struct("file", "line").alias("ord"))
    return J.resolve_callees(calls, defs, imports)


def import_edges(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(src_file, dst_file) of all languages; manifests (directory, text) of crates add the edges of workspace members."""
    c = F.col
    raw = files.select(c("path").alias("src_file"), "language", F.explode(SF.raw_imports(c("text"), c("language"))).alias("target"))
    names = files.select(c("path").alias("file"))
    ecma = c("language").isin("TypeScript", "TypeScriptReact", "JavaScript", "JavaScriptReact", "Vue")
    cand = F.when(ecma, SF.ecmascript_candidates(c("src_file"), c("target"))).when(c("language") == "Python", SF.python_candidates(c("src_file"), c("target"))).when(c("language") == "Rust", SF.rust_candidates(c("src_file"), c("target")))
    out = J.resolve_imports(raw.select("src_file", cand.alias("candidates")).filter("candidates is not null"), names)
    out = out.unionByName(SF.suffix_imports(raw.filter(c("language").isin("Java", "CSharp")), names)).unionByName(SF.package_imports(raw.filter("language = 'Go'"), names))
    return (out.unionByName(SF.workspace_edges(manifests, names)) if manifests is not None else out).distinct()


def enrich(reports: DataFrame, edges: DataFrame, commit_files: DataFrame | None, as_of: int | None, config: Config = Config()) -> DataFrame:
    """Reports with history, graph measures, activity risk, percentiles, driver, quadrant and patterns.

    commit_files: (sha, ts, author, subject, file, lines_added, lines_deleted) up to as_of; the newest commit's churn counts as churn.
    """
    f = reports
    ids = f.select(F.col("function_id").alias("id")).distinct()
    g = G.graph_metrics(edges, ids, config.callgraph_skip_above, config.betweenness_exact_threshold, config.betweenness_approx_k)
    if g is not None:
        g = stored(g, "graph")
        f = f.join(g.withColumnsRenamed({"id": "function_id", "depth": "dependency_depth"}), "function_id", "left")
    else:
        f = f.withColumns({c: F.lit(None).cast("double" if c in ("pagerank", "betweenness") else "long") for c in ("fan_in", "fan_out", "pagerank", "betweenness", "scc_size", "dependency_depth")})
    if commit_files is not None:
        newest = commit_files.agg(F.max_by("sha", F.struct("ts", "sha"))).first()[0]
        churn = H.commit_churn(commit_files, newest).select("file", "lines_added", "lines_deleted", (F.col("lines_added") + F.col("lines_deleted")).alias("file_churn"))
        f = f.join(churn, "file", "left").join(H.touch_metrics(commit_files, as_of), "file", "left").join(H.history_signals(commit_files, as_of), "file", "left")
        f = f.join(H.authors_in_window(commit_files, as_of), "file", "left").withColumn("touch_count_30d", F.coalesce("touch_count_30d", F.lit(0)))
        fixes = commit_files if "is_fix" in commit_files.columns else commit_files.withColumn("is_fix", S.is_fix(F.col("subject")))
        worst = reports.groupBy("file").agg(F.max("lrs").alias("score"))
        f = f.join(H.fix_counts(fixes), "file", "left").join(C.directed_coupling(commit_files, worst), "file", "left")
        by_id = f.select(F.col("function_id").alias("id"), F.col("file_churn").alias("churn_lines")).filter("churn_lines is not null")
        f = f.join(J.neighbor_churn(edges, by_id).withColumnRenamed("id", "function_id"), "function_id", "left")
    else:
        f = f.withColumns({c: F.lit(None).cast("long") for c in ("lines_added", "lines_deleted", "file_churn", "touch_count_30d", "days_since_last_change", "neighbor_churn", "commit_count", "author_count", "authors_90d", "convention_bug_fix_count")})
        f = f.withColumns({c: F.lit(None).cast("double") for c in ("author_entropy", "isolation_rate", "age_days", "last_touch_days", "burst_score", "directed_coupling")})
    # Churn is known by file, so patterns of a function's own churn don't see it.
    f = f.withColumns({"total_churn": F.coalesce("file_churn", F.lit(0)), "churn_lines": F.lit(None).cast("long"), "is_entrypoint": S.is_entry_point(F.col("function_id")), "touch": F.coalesce("touch_count_30d", F.lit(0))})
    f = S.with_activity_risk(f, config.scoring).withColumn("patterns", S.pattern_ids(S.pattern_details(config.patterns)))
    f = f.withColumn("score", S.rank_score()).fillna(0, ["fan_in", "fan_out"])
    f = Q.percentile_flags(stored(f, "scored"), "score")  # the measures below each read all rows: they start from a table
    f = S.near_miss(stored(S.driver(f.crossJoin(F.broadcast(Q.dimension_thresholds(f, config.driver_threshold_percentile)))), "driven"))
    return f.withColumn("quadrant", S.quadrant(F.col("touch_count_30d"), F.col("days_since_last_change"), F.col("touch_med"), F.col("band"))).drop("cc_high", "cc_med", "cc_low", "nd_high", "fan_out_high", "fan_in_high", "touch_high", "touch_med")


@dataclass
class Engine:
    """All commands over one snapshot store."""

    spark: SparkSession
    store: SnapshotStore
    config: Config = Config()

    def analyze(self, root: str, commit_files: DataFrame | None = None, as_of: int | None = None) -> DataFrame:
        """The enriched functions of a source tree."""
        # Tables, not a cache: a cache would answer for a tree that has changed since.
        files = stored(SF.source_files(self.spark, root, self.config.include, self.config.exclude), "files")
        reports = stored(X.reports(files, self.config), "reports")
        return enrich(reports, call_edges(reports, import_edges(files)), commit_files, as_of, self.config)

    def snapshot(self, root: str, sha: str, parents: list[str], ts: int, commit_files: DataFrame | None = None, force: bool = False) -> DataFrame:
        """analyze(), stored under a commit."""
        out = self.analyze(root, commit_files, ts)
        self.store.persist(out.dropDuplicates(["function_id"]), sha, parents, ts, force)
        return self.store.load(sha)

    def diff(self, base: str, head: str, top: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(deltas, policy results) between two stored commits."""
        b, h = self.store.load(base), self.store.load(head)
        if h is None or b is None:
            raise ValueError(f"no snapshot {head if h is None else base}")
        d = D.with_rename_hints(D.deltas(b, h), D.rename_hints(b, h))
        shown = D.diff_top(d, top) if top else d.filter("status <> 'unchanged'")
        return shown, P.order_by(P.evaluate(shown, b, h, self.config))

    def trends(self, last: int = 10, top: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(velocities, stability, refactorings) of the newest snapshots."""
        w = self.store.window(last).persist()
        return T.velocities(w), T.stability(w, top), T.refactorings(w)

    def labelled(self, functions: DataFrame, fixed: DataFrame) -> DataFrame:
        """functions with label: 1 for those of the files (file) that fixes touched, else 0."""
        hit = fixed.select("file", F.lit(1.0).alias("label")).distinct()
        return functions.join(hit, "file", "left").fillna(0.0, ["label"])

    def train(self, functions: DataFrame, label: str = "label", features: list[str] | None = None):
        """(model, kind) fitted to enriched functions."""
        return R.train(functions, features or R.FEATURES, label, "function_id")

    def rank(self, functions: DataFrame, model, features: list[str] | None = None) -> DataFrame:
        """functions with rank_score, the model's score in 0..1."""
        return R.ranked(functions, model, features or R.FEATURES, "rank_score")

    def coupling(self, commit_files: DataFrame, imports: DataFrame, as_of: int) -> DataFrame:
        return C.with_static_deps(C.co_change(commit_files, self.config.co_change_min_count, as_of, self.config.co_change_window_days), imports)

    def compact(self, level: int, keep_recent: int = 1, dry_run: bool = False) -> list[str]:
        return self.store.compact(level, keep_recent, dry_run)

    def prune(self, parents: DataFrame, tips: DataFrame, as_of: int | None = None, older_than_days: int | None = None, dry_run: bool = False) -> list[str]:
        return self.store.prune(G.reachable(parents, tips), as_of, older_than_days, dry_run)
