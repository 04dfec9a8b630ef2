"""Quantiles by integer index, percentile ranks and ranking windows, without sorting a whole table in one task where a histogram will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_quantiles(df: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """One row: for each output name the ascending element of a column at index (n - 1) * percent / 100 (integer division); 0 without rows.

    wanted: name -> (column, percent). Each column is reduced to a histogram of its values first, so only distinct values meet in one task.
    """
    out = None
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        hist = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
        upto = hist.select("v", F.sum("c").over(Window.orderBy("v")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
        aggs = []
        for name, (c, p) in wanted.items():
            if c == column:
                at = F.floor((F.col("n") - 1) * p / 100)
                aggs.append(F.coalesce(F.min(F.when(F.col("upto") > at, F.col("v"))), F.lit(0)).alias(name))
        row = upto.agg(*aggs)
        out = row if out is None else out.crossJoin(row)
    return out


def dimension_thresholds(df: DataFrame, percentile: int = 75) -> DataFrame:
    """One row with cc_high, cc_med, cc_low, nd_high, fan_out_high, fan_in_high, touch_high, touch_med."""
    p = percentile
    return index_quantiles(df, {"cc_high": ("cc", p), "cc_med": ("cc", 50), "cc_low": ("cc", 100 - p), "nd_high": ("nd", p), "fan_out_high": ("fan_out", p), "fan_in_high": ("fan_in", p), "touch_high": ("touch", p), "touch_med": ("touch", 50)})


def percentile_flags(df: DataFrame, score: str) -> DataFrame:
    """df with is_top_10_pct, is_top_5_pct, is_top_1_pct: whether the score reaches the element at the 90, 95 or 99 per cent index."""
    cuts = index_quantiles(df, {"_p90": (score, 90), "_p95": (score, 95), "_p99": (score, 99)})
    out = df.crossJoin(F.broadcast(cuts))
    flags = {f"is_top_{100 - p}_pct": F.col(score) >= F.col(f"_p{p}") for p in (90, 95, 99)}
    return out.withColumns(flags).drop("_p90", "_p95", "_p99")


def ntile_thresholds(df: DataFrame, score: str, order: list[Column]) -> DataFrame:
    """One row: the least score of the hundredths from 90, 95 and 99 on."""
    tiled = df.withColumn("_t", F.ntile(100).over(Window.orderBy(*order)))
    return tiled.agg(*[F.min(F.when(F.col("_t") >= p, F.col(score))).alias(f"p{p}") for p in (90, 95, 99)])


def percentile_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the share of rows that are strictly less."""
    hist = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    rank = hist.select("_v", (F.coalesce(F.sum("_c").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.sum("_c").over(Window.partitionBy())).alias(name))
    return df.join(rank, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= k)


def top_n(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """The first n rows; all for None or 0."""
    out = df.orderBy(*order)
    return out.limit(n) if n else out


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with 1-based ranks, ties sharing their mean."""
    hist = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    below = F.coalesce(F.sum("_c").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = hist.select("_v", (below + 1 + (F.col("_c") - 1) / 2).alias(name))
    return df.join(rank, F.col(column) == F.col("_v")).drop("_v")
