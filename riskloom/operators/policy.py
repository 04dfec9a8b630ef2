"""Policies over deltas, and the precision gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scoring import half_up, is_fix

ORDER = ["critical-introduction", "excessive-risk-regression", "watch-threshold", "attention-threshold", "rapid-growth", "suppression-missing-reason", "net-repo-regression"]


def _result(rows: DataFrame, name: str, severity: str, message, delta=None, total=None, growth=None, fid=None) -> DataFrame:
    none = F.lit(None).cast("double")
    return rows.select(F.lit(name).alias("id"), F.lit(severity).alias("severity"), (F.col("function_id") if fid is None else fid).cast("string").alias("function_id"), message.alias("message"),
                       (none if delta is None else delta).alias("delta_lrs"), (none if total is None else total).alias("total_delta"), (none if growth is None else growth).alias("growth_percent"))


def _two(x):
    return F.format_string("%.2f", half_up(x, 2))


def _severity(mode: str) -> str:
    return "blocking" if mode == "block" else "warning"


def critical_introduction(d: DataFrame, config: Config = Config()) -> DataFrame:
    x = d.filter((F.col("after_band") == "critical") & F.col("suppression_reason").isNull() & ~F.coalesce(F.col("before_band") == "critical", F.lit(False)))
    return _result(x, ORDER[0], _severity(config.critical_introduction), F.concat(F.lit("Function "), F.col("function_id"), F.lit(" has become critical")))


def excessive_risk_regression(d: DataFrame, config: Config = Config(), least: float = 1.0) -> DataFrame:
    x = d.filter((F.col("status") == "modified") & (F.col("delta_lrs") >= least) & F.col("suppression_reason").isNull())
    return _result(x, ORDER[1], _severity(config.excessive_risk_regression), F.concat(F.lit("Function "), F.col("function_id"), F.lit(" rose by "), _two(F.col("delta_lrs"))), delta=F.col("delta_lrs"))


def _entering(d: DataFrame, low: float, high: float) -> DataFrame:
    a, b = F.col("after_lrs"), F.col("before_lrs")
    return d.filter(F.col("status").isin("new", "modified") & F.col("suppression_reason").isNull() & (a >= low) & (a < high) & (b.isNull() | (b < low)))


def watch_threshold(d: DataFrame, config: Config = Config()) -> DataFrame:
    w = config.warning_thresholds
    return _result(_entering(d, w.watch_min, w.watch_max), ORDER[2], "warning", F.concat(F.lit("Function "), F.col("function_id"), F.lit(" nears moderate risk at "), _two(F.col("after_lrs"))), delta=F.col("delta_lrs"))


def attention_threshold(d: DataFrame, config: Config = Config()) -> DataFrame:
    w = config.warning_thresholds
    return _result(_entering(d, w.attention_min, w.attention_max), ORDER[3], "warning", F.concat(F.lit("Function "), F.col("function_id"), F.lit(" nears high risk at "), _two(F.col("after_lrs"))), delta=F.col("delta_lrs"))


def rapid_growth(d: DataFrame, config: Config = Config()) -> DataFrame:
    growth = F.try_divide(F.col("after_lrs") - F.col("before_lrs"), F.col("before_lrs")) * 100
    x = d.filter((F.col("status") == "modified") & F.col("suppression_reason").isNull() & (F.col("before_lrs") > 2.220446049250313e-16)).withColumn("_g", growth)
    x = x.filter(F.col("_g") >= config.warning_thresholds.rapid_growth_percent)
    return _result(x, ORDER[4], "warning", F.concat(F.lit("Function "), F.col("function_id"), F.lit(" grew from "), _two(F.col("before_lrs")), F.lit(" to "), _two(F.col("after_lrs"))), delta=F.col("after_lrs") - F.col("before_lrs"), growth=F.col("_g"))


def suppression_missing_reason(d: DataFrame) -> DataFrame:
    return _result(d.filter("suppression_reason = ''"), ORDER[5], "warning", F.concat(F.lit("Function "), F.col("function_id"), F.lit(" is suppressed without a reason")))


def net_repo_regression(parent: DataFrame | None, current: DataFrame) -> DataFrame:
    after = current.agg(F.coalesce(F.sum("lrs"), F.lit(0.0)).alias("a"))
    before = parent.agg(F.coalesce(F.sum("lrs"), F.lit(0.0)).alias("b")) if parent is not None else after.select(F.lit(0.0).alias("b"))
    x = after.crossJoin(before).withColumn("t", F.col("a") - F.col("b")).filter("t > 0")
    return _result(x, ORDER[6], "warning", F.concat(F.lit("Total risk rose by "), _two(F.col("t"))), total=F.col("t"), fid=F.lit(None))


def evaluate(d: DataFrame, parent: DataFrame | None, current: DataFrame, config: Config = Config()) -> DataFrame:
    """All results; order_by() sorts them. A baseline (no parent) has none."""
    parts = []
    if parent is None:
        return suppression_missing_reason(d).limit(0)
    if config.critical_introduction != "off":
        parts.append(critical_introduction(d, config))
    if config.excessive_risk_regression != "off":
        parts.append(excessive_risk_regression(d, config))
    parts += [watch_threshold(d, config), attention_threshold(d, config), rapid_growth(d, config), suppression_missing_reason(d), net_repo_regression(parent, current)]
    return reduce(DataFrame.unionByName, parts)


def order_by(results: DataFrame) -> DataFrame:
    return results.orderBy(F.array_position(F.array(*map(F.lit, ORDER)), F.col("id")), F.asc_nulls_last("function_id"))


def has_blocking(results: DataFrame) -> bool:
    return bool(results.filter("severity = 'blocking'").limit(1).count())


def gate(functions: DataFrame, fix_files: DataFrame, score: str, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """One row (verdict, p_at_10, fix_files_found): pass, suppressed or inconclusive, by how many of the k riskiest functions (function_id, file, score) lie in files of fixes (file)."""
    fixes = fix_files.select("file").distinct()
    top = functions.orderBy(F.desc(score), "function_id").limit(k)
    hit = top.join(fixes.withColumn("_f", F.lit(1)), "file", "left").agg(F.count("*").alias("n"), F.count("_f").alias("h"))
    row = hit.crossJoin(fixes.agg(F.count("*").alias("fix_files_found")))
    unsure = (F.col("fix_files_found") == 0) | (F.col("n") < 10)
    p = F.col("h") / F.col("n")
    return row.select(F.when(unsure, "inconclusive").when(p < threshold, "suppressed").otherwise("pass").alias("verdict"), F.when(~unsure, p).alias("p_at_10"), "fix_files_found")


def fix_files(commits: DataFrame, commit_files: DataFrame, as_of: int, days: int = 90, most: int = 5000) -> DataFrame:
    """(file): files of fix commits among the newest commits of the window."""
    recent = commits.filter(F.col("ts").between(as_of - days * 86400, as_of)).orderBy(F.desc("ts"), F.desc("sha")).limit(most)
    fixes = recent.filter(is_fix(F.col("subject"))).select("sha")
    return commit_files.join(fixes, "sha", "left_semi").select("file").distinct()
