"""Co-change and directed coupling of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import half_up
from .aggregates import directory

#: Commits of more files give no pairs, though they count as appearances.
MASS_COMMIT = 200
DAY = 86400


def trivial_pair(a: Column, b: Column) -> Column:
    """A file with its test, or a module file with a sibling, in one directory."""
    a, b = a.cast("string"), b.cast("string")
    stem = lambda x: F.regexp_replace(F.regexp_extract(x, "([^/]*)$", 1), "(.)\\.[^.]*$", "$1")
    sa, sb = stem(a), stem(b)
    test = lambda x, y: (y == F.concat(x, F.lit("_test"))) | (y == F.concat(x, F.lit("_tests")))
    return (directory(a) == directory(b)) & (test(sa, sb) | test(sb, sa) | (sa == "mod") | (sb == "mod"))


def co_change(commit_files: DataFrame, min_count: int = 3, as_of: int | None = None, window_days: int | None = None, existing: DataFrame | None = None, mass_commit: int = MASS_COMMIT) -> DataFrame:
    """(file_a, file_b, co_change_count, coupling_ratio, risk), file_a < file_b: how often two files changed together, over the appearances of the rarer.

    Pairs are made from each commit's array of files, so a commit is shuffled once and pairs are combined before their own shuffle.
    """
    x = commit_files.select("sha", "file", *(["ts"] if as_of is not None else []))
    if as_of is not None:
        x = x.filter(F.col("ts").between(as_of - window_days * DAY, as_of))
    appear = x.groupBy("file").agg(F.count("*").alias("n"))
    per = x.groupBy("sha").agg(F.sort_array(F.collect_set("file")).alias("f"), F.count("*").alias("_n")).filter(F.col("_n") <= mass_commit)
    first = per.select("f", F.posexplode("f").alias("i", "file_a"))
    pairs = first.select("file_a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("file_b"))
    counted = pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("co_change_count")).filter(F.col("co_change_count") >= min_count)
    if existing is not None:
        for side in ("file_a", "file_b"):
            counted = counted.join(existing.select(F.col("file").alias(side)).distinct(), side, "left_semi")
    counted = counted.filter(~trivial_pair(F.col("file_a"), F.col("file_b")))
    na, nb = appear.select(F.col("file").alias("file_a"), F.col("n").alias("na")), appear.select(F.col("file").alias("file_b"), F.col("n").alias("nb"))
    ratio = F.col("co_change_count") / F.least("na", "nb")
    risk = F.when(ratio > 0.5, "high").when(ratio > 0.25, "moderate").otherwise("low")
    return counted.join(na, "file_a").join(nb, "file_b").select("file_a", "file_b", "co_change_count", half_up(ratio, 3).alias("coupling_ratio"), risk.alias("risk"))


def with_static_deps(pairs: DataFrame, imports: DataFrame) -> DataFrame:
    """pairs with has_static_dep, and risk 'expected' where an import (src_file, dst_file) links the pair either way."""
    a, b = F.col("src_file"), F.col("dst_file")
    known = imports.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).distinct().withColumn("_dep", F.lit(True))
    j = pairs.join(known, (F.least("file_a", "file_b") == F.col("_a")) & (F.greatest("file_a", "file_b") == F.col("_b")), "left")
    dep = F.coalesce("_dep", F.lit(False))
    return j.withColumns({"has_static_dep": dep, "risk": F.when(dep, "expected").otherwise(F.col("risk"))}).drop("_a", "_b", "_dep")


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "critical", 4).when(risk == "high", 3).when(risk == "moderate", 2).when(risk == "low", 1).otherwise(0)


def co_change_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_a, file_b, status, prev_risk, curr_risk): new, dropped, risk_increased or risk_decreased pairs."""
    key = lambda df, risk: df.select(F.least("file_a", "file_b").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b"), F.col("risk").alias(risk))
    j = key(before, "prev_risk").join(key(after, "curr_risk"), ["file_a", "file_b"], "full")
    p, c = risk_rank(F.col("prev_risk")), risk_rank(F.col("curr_risk"))
    status = F.when(F.col("prev_risk").isNull(), "new").when(F.col("curr_risk").isNull(), "dropped").when(c > p, "risk_increased").when(c < p, "risk_decreased")
    return j.withColumn("status", status).filter(F.col("status").isNotNull())


def hidden_coupling(pairs: DataFrame, source: str = "\\.(ts|tsx|js|jsx|mjs|cjs|vue|go|java|py|rs|cs|c|h|cpp|hpp|cc)$") -> DataFrame:
    """Pairs of source files that change together at high or moderate risk without an import."""
    ok = F.col("file_a").rlike(source) & F.col("file_b").rlike(source) if source else F.lit(True)
    return pairs.filter(~F.col("has_static_dep") & F.col("risk").isin("high", "moderate") & ok)


def directed_coupling(commit_files: DataFrame, scores: DataFrame, min_appearances: int = 10, window_days: int | None = None) -> DataFrame:
    """(file, directed_coupling): the scores (file, score) of a file's partners over all its commits, divided by its commits.

    A file's partners in a commit are all others of it, so their scores are the commit's total less its own: no pairs are made.
    """
    x = commit_files.select("sha", "file", "ts").distinct()
    if window_days is not None:
        newest = x.agg(F.max("ts").alias("_t"))
        x = x.crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("_t") - window_days * DAY).drop("_t")
    s = x.join(scores.select("file", F.greatest("score", F.lit(0.0)).alias("s")), "file", "left").fillna(0.0, ["s"])
    total = s.withColumn("t", F.sum("s").over(Window.partitionBy("sha")))
    return total.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.col("t") - F.col("s")).alias("w")).filter(F.col("n") >= min_appearances).select("file", (F.col("w") / F.col("n")).alias("directed_coupling"))


def jaccard_stability(commits: DataFrame, commit_files: DataFrame, train: float = 0.8, top: float = 0.2) -> DataFrame:
    """One row: how much the files with most fixes in the first part of history and in the rest overlap; NULL if either has no fix. Ties go by file.

    Positions in the log come from the counts before each second, so the log isn't sorted in one task. commits (sha, ts), commit_files (sha, file, is_fix).
    """
    hist = commits.groupBy("ts").agg(F.count("*").alias("c"))
    base = hist.select("ts", F.coalesce(F.sum("c").over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    place = commits.join(base, "ts").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("ts").orderBy("sha")) - 1)
    side = place.select("sha", (F.col("i") >= F.floor(F.col("n") * train)).alias("late"))
    per = commit_files.filter("is_fix").join(side, "sha").groupBy("late", "file").agg(F.count("*").alias("c"))
    n = per.withColumn("n", F.count("*").over(Window.partitionBy("late"))).withColumn("r", F.row_number().over(Window.partitionBy("late").orderBy(F.desc("c"), "file")))
    best = n.filter(F.col("r") <= F.greatest(F.floor(F.col("n") * top), F.lit(1)))
    both = best.groupBy("file").agg(F.count("*").alias("k"), F.max("late").alias("b"), F.min("late").alias("a"))
    row = both.agg(F.count(F.when(F.col("k") == 2, 1)).alias("i"), F.count("*").alias("u"), F.min("a").alias("a"), F.max("b").alias("b"))
    return row.select(F.when(~F.col("a") & F.col("b"), F.col("i") / F.col("u")).alias("jaccard"))


def coupling_driver(commits: DataFrame, commit_files: DataFrame, scores: DataFrame, unstable: float = 0.15) -> DataFrame:
    """directed_coupling() over the last year where the riskiest files rotate (jaccard below ``unstable``), over all history otherwise."""
    j = jaccard_stability(commits, commit_files).first()[0]
    return directed_coupling(commit_files, scores, window_days=365 if j is not None and j < unstable else None)
