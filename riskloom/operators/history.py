"""Signals of the commit log: churn, touches, recency, bursts, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import spread

DAY = 86400


def commit_churn(commit_files: DataFrame, sha: object) -> DataFrame:
    """(file, lines_added, lines_deleted, net_change) of one commit; binary files (NULL counts) are left out."""
    x = commit_files.filter((F.col("sha") == F.lit(sha)) & F.col("lines_added").isNotNull())
    return x.select("file", "lines_added", "lines_deleted", (F.col("lines_added") - F.col("lines_deleted")).alias("net_change"))


def touch_metrics(commit_files: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    """(file, touch_count_30d, days_since_last_change) up to as_of."""
    x = commit_files.filter(F.col("ts") <= as_of)
    return x.groupBy("file").agg(F.count(F.when(F.col("ts") >= as_of - days * DAY, 1)).alias("touch_count_30d"), F.floor(F.greatest(F.lit(as_of) - F.max("ts"), F.lit(0)) / DAY).alias("days_since_last_change"))


def hybrid_touches(functions: DataFrame, by_file: DataFrame, by_function: DataFrame, threshold: int = 5) -> DataFrame:
    """functions (function_id, file) with touches: those of the function where its file has at least ``threshold``, else those of the file; 0 for none."""
    f = functions.join(by_file.select("file", F.col("touch_count_30d").alias("_file")), "file", "left").join(by_function.select("function_id", F.col("touch_count_30d").alias("_own")), "function_id", "left")
    file = F.coalesce("_file", F.lit(0))
    return f.withColumn("touch_count_30d", F.when(file >= threshold, F.coalesce("_own", F.lit(0))).otherwise(file)).drop("_file", "_own")


def branch_recency(now: DataFrame, at_base: DataFrame, branch_age_days: int) -> DataFrame:
    """(file, days_since_last_change): where a file changed since the branch began, what was true at the merge base (at_base), so that opening a branch isn't activity."""
    j = now.join(at_base.select("file", F.col("days_since_last_change").alias("_base")), "file", "left")
    return j.select("file", F.when(F.col("days_since_last_change") < branch_age_days, F.coalesce("_base", "days_since_last_change")).otherwise(F.col("days_since_last_change")).alias("days_since_last_change"))


def burst_scores(commit_files: DataFrame, days: int = 30) -> DataFrame:
    """(file, burst_score): of each commit how many from it on lie within the window, the greatest of these over their mean; 1 for a single commit.

    Of commits at the same second a later one counts fewer, as if by position: the count up to the window's end, less the commits before it.
    """
    c = spread(commit_files, "file").select("file", _from_each(days).alias("c"))
    return c.groupBy("file").agg(_burst(F.count("*"), F.max("c"), F.avg("c")).alias("burst_score"))


def _from_each(days: int = 30) -> Column:
    ends = Window.partitionBy("file").orderBy("ts").rangeBetween(Window.unboundedPreceding, days * DAY - 1)
    place = Window.partitionBy("file").orderBy("ts", "sha")
    return F.count("*").over(ends) - F.row_number().over(place) + 1


def _burst(n: Column, most: Column, mean: Column) -> Column:
    return F.when(n < 2, 1.0).otherwise(most / mean)


def author_entropy(commit_files: DataFrame) -> DataFrame:
    """(file, author_entropy): Shannon entropy in bits of the authors' shares."""
    per = commit_files.groupBy("file", "author").agg(F.count("*").alias("c"))
    w = Window.partitionBy("file")
    p = per.withColumn("p", F.col("c") / F.sum("c").over(w))
    return p.groupBy("file").agg((-F.sum(F.col("p") * F.log2("p"))).alias("author_entropy"))


def history_signals(commit_files: DataFrame, as_of: int) -> DataFrame:
    """(file, commit_count, author_count, author_entropy, isolation_rate, age_days, last_touch_days, burst_score)."""
    # One shuffle by commit, one by file: all signals come from the rows of a file and author. Rows without a commit count for entropy and bursts only.
    c, day, own = F.col, float(DAY), lambda x: F.when(F.col("sha").isNotNull(), x)
    x = commit_files.select("sha", "file", "ts", "author").filter("file is not null").withColumn("_files", F.count("*").over(Window.partitionBy("sha")))
    x = spread(x, "file").withColumn("_c", _from_each())
    per = x.groupBy("file", "author").agg(F.count("*").alias("k"), F.count("sha").alias("n"), F.count(own(F.when(c("_files") == 1, 1))).alias("alone"), F.min(own(c("ts"))).alias("first"), F.max(own(c("ts"))).alias("last"), F.max("_c").alias("most"), F.sum("_c").alias("all"))
    p = per.withColumn("p", c("k") / F.sum("k").over(Window.partitionBy("file")))
    base = p.groupBy("file").agg(
        F.sum("n").alias("commit_count"), F.count(F.when(c("n") > 0, c("author"))).alias("author_count"), (-F.sum(c("p") * F.log2("p"))).alias("author_entropy"), (F.sum("alone") / F.sum("n")).alias("isolation_rate"),
        ((F.max("last") - F.min("first")) / day).alias("age_days"), ((F.lit(as_of) - F.max("last")) / day).alias("last_touch_days"), _burst(F.sum("k"), F.max("most"), F.sum("all") / F.sum("k")).alias("burst_score"),
    )
    return base.filter("commit_count > 0")


def authors_in_window(commit_files: DataFrame, as_of: int, days: int = 90) -> DataFrame:
    """(file, authors_90d): distinct authors in the window."""
    return commit_files.filter(F.col("ts").between(as_of - days * DAY, as_of)).groupBy("file").agg(F.countDistinct("author").alias("authors_90d"))


def fix_counts(commit_files: DataFrame) -> DataFrame:
    """(file, convention_bug_fix_count): commits of is_fix; files without one aren't listed."""
    return commit_files.filter("is_fix").groupBy("file").agg(F.countDistinct("sha").alias("convention_bug_fix_count"))


def stale_files(commit_files: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    """(file, last_ts) of files without a change in the window."""
    x = commit_files.filter(F.col("ts") <= as_of).groupBy("file").agg(F.max("ts").alias("last_ts"))
    return x.filter(F.col("last_ts") < as_of - days * DAY)


def commit_log(commit_files: DataFrame) -> DataFrame:
    """(sha, ts, author, files): the files of each commit in order; emails in lower case."""
    return commit_files.groupBy("sha", "ts", F.lower(F.col("author").cast("string")).alias("author")).agg(F.array_sort(F.collect_set("file")).alias("files"))
