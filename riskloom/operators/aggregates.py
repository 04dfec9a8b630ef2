"""Roll-ups of functions to files, directories, modules and the whole repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import half_up


def file_aggregates(functions: DataFrame) -> DataFrame:
    """(file, sum_lrs, max_lrs, high_plus_count)."""
    high = F.count(F.when(F.col("band").isin("high", "critical"), 1))
    return functions.groupBy("file").agg(F.sum("lrs").alias("sum_lrs"), F.max("lrs").alias("max_lrs"), high.alias("high_plus_count"))


def ancestors(path: Column) -> Column:
    """Every directory above a relative path, from '.' down; paths that begin with '/' or '..' have none."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(path.startswith("/") | path.startswith(".."), F.array().cast("array<string>")).when(F.size(parts) > 1, F.concat(F.array(F.lit(".")), some)).otherwise(F.array(F.lit(".")))


def directory(path: Column) -> Column:
    """The directory of a path, '.' at the top."""
    d = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit(".")).otherwise(d)


def directory_rollup(files: DataFrame) -> DataFrame:
    """file_aggregates() rolled up to (directory, sum_lrs, max_lrs, high_plus_count); a file counts in each of its ancestors."""
    each = files.withColumn("directory", F.explode(ancestors(F.col("file"))))
    return each.groupBy("directory").agg(F.sum("sum_lrs").alias("sum_lrs"), F.max("max_lrs").alias("max_lrs"), F.sum("high_plus_count").alias("high_plus_count"))


def file_risk_view(functions: DataFrame) -> DataFrame:
    """(file, function_count, loc, max_cc, avg_cc, critical_count, file_churn, file_risk_score). churn_lines: NULL for none."""
    g = functions.groupBy("file").agg(
        F.count("*").alias("function_count"), F.sum("loc").alias("loc"), F.max("cc").alias("max_cc"), (F.sum("cc") / F.count("*")).alias("_avg"),
        F.count(F.when(F.col("band") == "critical", 1)).alias("critical_count"), F.coalesce(F.max("churn_lines"), F.lit(0)).alias("file_churn"),
    )
    score = F.col("max_cc") * 0.4 + F.col("_avg") * 0.3 + F.log2(F.col("function_count") + 1.0) * 0.2 + F.least(F.col("file_churn") / 100.0, F.lit(10.0)) * 0.1
    return g.select("file", "function_count", "loc", "max_cc", half_up(F.col("_avg"), 2).alias("avg_cc"), "critical_count", "file_churn", half_up(score, 2).alias("file_risk_score"))


def module_instability(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """functions (file, cc) and import edges (src_file, dst_file) -> the coupling of each directory that has functions."""
    dirs = imports.select(directory(F.col("src_file")).alias("a"), directory(F.col("dst_file")).alias("b")).filter("a <> b")
    out = dirs.groupBy(F.col("a").alias("module")).agg(F.count("*").alias("efferent"))
    into = dirs.groupBy(F.col("b").alias("module")).agg(F.count("*").alias("afferent"))
    own = functions.groupBy(directory(F.col("file")).alias("module")).agg(F.countDistinct("file").alias("file_count"), F.count("*").alias("function_count"), (F.sum("cc") / F.count("*")).alias("_avg"))
    full = own.join(out, "module", "left").join(into, "module", "left").fillna(0, ["efferent", "afferent"])
    e, a = F.col("efferent"), F.col("afferent")
    i = F.when(e + a == 0, 0.5).otherwise(e / (e + a))
    risk = F.when((i < 0.3) & (F.col("_avg") > 10), "high").otherwise("low")
    return full.select("module", "file_count", "function_count", half_up(F.col("_avg"), 2).alias("avg_complexity"), "afferent", "efferent", half_up(i, 3).alias("instability"), risk.alias("module_risk"))


def band_distribution(functions: DataFrame, score: Column) -> DataFrame:
    return functions.groupBy("band").agg(F.count("*").alias("count"), F.sum(score).alias("sum_risk"))


def summary(functions: DataFrame, score: str) -> DataFrame:
    """One row: total_functions, total_risk, and what share of it the top 1, 5 and 10 per cent (one function at least) have.

    The top shares come from a histogram of scores: the k-th greatest score bounds each sum, and equal scores are interchangeable.
    """
    hist = functions.groupBy(F.col(score).alias("v")).agg(F.count("*").alias("c"))
    w = Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    h = hist.select("v", "c", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("above"), F.sum("c").over(Window.partitionBy()).alias("n"))
    outs = [F.coalesce(F.sum("c"), F.lit(0)).alias("total_functions"), F.coalesce(F.sum(F.col("c") * F.col("v")), F.lit(0.0)).alias("total_risk")]
    for p in (1, 5, 10):
        k = F.greatest(F.floor(F.col("n") * p / 100), F.lit(1))
        taken = F.greatest(F.least(F.col("c"), k - F.col("above")), F.lit(0))
        outs.append(F.try_divide(F.sum(taken * F.col("v")), F.sum(F.col("c") * F.col("v"))).alias(f"top_{p}_pct_share"))
    row = h.agg(*outs)
    return row.select("total_functions", "total_risk", *[F.when(F.col("total_risk") > 0, F.col(f"top_{p}_pct_share")).otherwise(0.0).alias(f"top_{p}_pct_share") for p in (1, 5, 10)])


def graph_stats(functions: DataFrame) -> DataFrame:
    """One row: total_edges, avg_fan_in over all functions, how many cycles, and the largest. Needs fan_in, fan_out, scc_id, scc_size."""
    cyc = F.when(F.col("scc_size") > 1, F.col("scc_id"))
    return functions.agg(F.coalesce(F.sum("fan_out"), F.lit(0)).alias("total_edges"), (F.coalesce(F.sum("fan_in"), F.lit(0)) / F.count("*")).alias("avg_fan_in"), F.countDistinct(cyc).alias("scc_count"),
                         F.coalesce(F.max(F.when(F.col("scc_size") > 1, F.col("scc_size"))), F.lit(0)).alias("largest_scc_size"))


def pattern_breakdown(functions: DataFrame) -> DataFrame:
    """patterns ARRAY<STRING> -> (pattern, count)."""
    return functions.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("count"))


def delta_files(deltas: DataFrame) -> DataFrame:
    """deltas() -> (file, net_lrs_delta, regression_count, improvement_count). New functions add their score without counting as regressions; deleted ones count as improvements."""
    d = F.col("delta_lrs")
    x = deltas.filter(F.instr("function_id", "::") > 0).withColumn("file", F.regexp_extract("function_id", "^(.*)::", 1))
    net = F.when(d.isNotNull(), d).when(F.col("status") == "new", F.col("after_lrs")).otherwise(0.0)
    return x.groupBy("file").agg(F.sum(net).alias("net_lrs_delta"), F.count(F.when(d > 0, 1)).alias("regression_count"), F.count(F.when(d < 0, 1)).alias("improvement_count"))
