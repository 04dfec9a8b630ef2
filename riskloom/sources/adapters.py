"""Views that give the driver tables the shapes of functions, commits, touches, edges and snapshots.

Each has a DataFrame form and the same as SQL text (SQL[name], a CTE body) for oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread

#: The time that histories are seen from: the end of the events table.
AS_OF = 1706745600
#: The same for commits: a day after the last order.
COMMITS_AS_OF = 996710400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Unix seconds of a timestamp with or without a zone (the session's zone must be UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function reports from part."""
    p, c = table(spark, sf_dir, "part"), F.col
    file = F.concat("p_brand", F.lit("/"), "p_type")
    return p.select(
        F.concat(file, F.lit("::"), c("p_partkey").cast("string")).alias("function_id"), file.alias("file"), c("p_partkey").cast("long").alias("line"), (c("p_partkey") % 12 + 1).alias("cc"),
        (c("p_size") % 5).cast("long").alias("nd"), (c("p_partkey") * 7 % 10).alias("fo"), (c("p_size") % 3).cast("long").alias("ns"), (c("p_size") * 2 + 5).cast("long").alias("loc"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit log from orders."""
    o, c = table(spark, sf_dir, "orders"), F.col
    return o.select(c("o_orderkey").alias("sha"), seconds(c("o_orderdate")).alias("ts"), c("o_custkey").alias("author"), c("o_orderpriority").alias("subject"), (c("o_orderpriority") == "1-URGENT").alias("is_fix"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (commit, file) from lineitem: suppliers are files."""
    li, c = table(spark, sf_dir, "lineitem"), F.col
    each = spread(li.select(c("l_orderkey").alias("sha"), c("l_suppkey").alias("file"), "l_quantity", "l_linenumber"), "sha")
    per = each.groupBy("sha", "file").agg(F.sum("l_quantity").cast("long").alias("lines_added"), F.sum("l_linenumber").alias("lines_deleted"))
    return per.join(commits(spark, sf_dir), "sha")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges (src, dst): parts of consecutive lines of an order, large quantities only."""
    li = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_partkey")
    a, b = li.alias("a"), li.alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1) & (F.col("a.l_partkey") != F.col("b.l_partkey"))
    return a.join(b, on).select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")).distinct()


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot series (function_id, k, lrs) from orders: customers by quarter."""
    o, c = table(spark, sf_dir, "orders"), F.col
    k = F.year("o_orderdate") * 4 + F.quarter("o_orderdate")
    return o.groupBy(c("o_custkey").alias("function_id"), k.cast("long").alias("k")).agg(F.round(F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("double") / 100000, 7).alias("lrs"))


def snapshot_pair(spark: SparkSession, sf_dir: str, before: int = 7985, after: int = 7986) -> tuple[DataFrame, DataFrame]:
    """Two quarters as parent and current: (function_id, file, line, cc, nd, fo, ns, lrs, band, suppression_reason)."""
    from ..functions.scoring import band

    s, c = snapshots(spark, sf_dir), F.col

    def shape(k: int) -> DataFrame:
        some = s.filter(c("k") == k)
        score = F.round(c("lrs") * 2, 6)
        why = F.when(c("function_id") % 37 == 0, F.lit("")).when(c("function_id") % 41 == 0, F.lit("legacy"))
        return some.select(F.concat(F.lit("f"), (c("function_id") % 100).cast("string"), F.lit("::"), c("function_id").cast("string")).alias("function_id"), F.concat(F.lit("f"), (c("function_id") % 100).cast("string")).alias("file"),
                           (c("function_id") % 1000).cast("long").alias("line"), (F.floor(score) + 1).cast("long").alias("cc"), (c("function_id") % 5).cast("long").alias("nd"), F.lit(1).cast("long").alias("fo"), F.lit(0).cast("long").alias("ns"),
                           score.alias("lrs"), band(score).alias("band"), why.alias("suppression_reason"))

    return shape(before), shape(after)


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The touch log (file, ts, author) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("file"), seconds(F.col("ts")).alias("ts"), F.col("event_type").alias("author"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with churn of their file, touches, degrees, and stand-ins for cycle size and depth; scored.

    Churn: large line items of a file's parts and their distinct suppliers. Touches: those of user partkey % 150. scc_size: one more than the
    callees that call back.
    """
    from ..functions.scoring import scored

    c = F.col
    f = scored(fn(spark, sf_dir))
    li = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(c("l_partkey").alias("line"), "l_suppkey")
    churn = li.join(f.select("line", "file"), "line").groupBy("file").agg(F.count("*").alias("lines_added"), F.countDistinct("l_suppkey").alias("lines_deleted"))
    t = touches(spark, sf_dir)
    seen = t.groupBy(c("file").alias("u")).agg(F.count(F.when(c("ts") >= AS_OF - 10 * 86400, 1)).alias("touch_count_30d"), F.floor((F.lit(AS_OF) - F.max("ts")) / 86400).alias("days_since_last_change"))
    e = edges(spark, sf_dir)
    out = e.groupBy(c("src").alias("line")).agg(F.count("*").alias("fan_out"))
    into = e.groupBy(c("dst").alias("line")).agg(F.count("*").alias("fan_in"))
    back = e.join(e.select(c("src").alias("dst"), c("dst").alias("src")), ["src", "dst"]).groupBy(c("src").alias("line")).agg((F.count("*") + 1).alias("scc_size"))
    full = f.join(churn, "file", "left").withColumn("u", c("line") % 150).join(seen, "u", "left").drop("u")
    full = full.join(out, "line", "left").join(into, "line", "left").join(back, "line", "left")
    return full.fillna(0, ["fan_out", "fan_in"]).fillna(1, ["scc_size"]).withColumns({"touch": F.coalesce("touch_count_30d", F.lit(0)), "dependency_depth": (c("line") % 17).cast("long"), "neighbor_churn": (c("fan_out") * 120).cast("long"), "is_entrypoint": c("line") % 29 == 0, "churn_lines": c("lines_added") + c("lines_deleted")})


SCORE_SQL = """SELECT *, CASE WHEN lrs < 3 THEN 'low' WHEN lrs < 6 THEN 'moderate' WHEN lrs < 9 THEN 'high' ELSE 'critical' END AS band FROM (
  SELECT *, r_cc * 1.0::DOUBLE + r_nd * 0.8::DOUBLE + r_fo * 0.6::DOUBLE + r_ns * 0.7::DOUBLE AS lrs FROM (
    SELECT *, least(log2(cc + 1), 6.0)::DOUBLE AS r_cc, least(nd, 8)::DOUBLE AS r_nd, least(log2(fo + 1), 6.0)::DOUBLE AS r_fo, least(ns, 6)::DOUBLE AS r_ns FROM v_fn))"""

SQL = {
    "v_fn": "SELECT p_brand || '/' || p_type || '::' || p_partkey::VARCHAR AS function_id, p_brand || '/' || p_type AS file, p_partkey AS line, p_partkey % 12 + 1 AS cc, (p_size % 5)::BIGINT AS nd, p_partkey * 7 % 10 AS fo, (p_size % 3)::BIGINT AS ns, (p_size * 2 + 5)::BIGINT AS loc FROM part",
    "v_scored": SCORE_SQL,
    "v_commit": "SELECT o_orderkey AS sha, epoch(o_orderdate)::BIGINT AS ts, o_custkey AS author, o_orderpriority AS subject, o_orderpriority = '1-URGENT' AS is_fix FROM orders",
    "v_commit_file": "SELECT * FROM (SELECT l_orderkey AS sha, l_suppkey AS file, sum(l_quantity)::BIGINT AS lines_added, sum(l_linenumber)::BIGINT AS lines_deleted FROM lineitem GROUP BY 1, 2) JOIN v_commit USING (sha)",
    "v_edge": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey WHERE a.l_quantity >= 45 AND b.l_quantity >= 45",
    "v_snap": "SELECT o_custkey AS function_id, (year(o_orderdate) * 4 + quarter(o_orderdate))::BIGINT AS k, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 100000, 7) AS lrs FROM orders GROUP BY 1, 2",
    "v_pair": """SELECT 'f' || (function_id % 100)::VARCHAR || '::' || function_id::VARCHAR AS function_id, 'f' || (function_id % 100)::VARCHAR AS file, function_id % 1000 AS line, k, (floor(s) + 1)::BIGINT AS cc, function_id % 5 AS nd, 1::BIGINT AS fo, 0::BIGINT AS ns, s AS lrs,
      CASE WHEN s < 3 THEN 'low' WHEN s < 6 THEN 'moderate' WHEN s < 9 THEN 'high' ELSE 'critical' END AS band, CASE WHEN function_id % 37 = 0 THEN '' WHEN function_id % 41 = 0 THEN 'legacy' END AS suppression_reason FROM (SELECT *, round(lrs * 2, 6) AS s FROM v_snap)""",
    "v_before": "SELECT * FROM v_pair WHERE k = 7985",
    "v_after": "SELECT * FROM v_pair WHERE k = 7986",
    "v_touch": "SELECT user_id AS file, floor(epoch(ts))::BIGINT AS ts, event_type AS author FROM events",
    "v_churn": "SELECT file, count(*) AS lines_added, count(DISTINCT l_suppkey) AS lines_deleted FROM lineitem JOIN v_fn ON l_partkey = line WHERE l_quantity >= 49 GROUP BY file",
    "v_seen": f"SELECT file AS u, count(*) FILTER (WHERE ts >= {AS_OF} - 864000) AS touch_count_30d, (({AS_OF} - max(ts)) // 86400)::BIGINT AS days_since_last_change FROM v_touch GROUP BY file",
    "v_full": """SELECT f.*, lines_added, lines_deleted, touch_count_30d, days_since_last_change, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in, coalesce(scc_size, 1) AS scc_size, coalesce(touch_count_30d, 0) AS touch, f.line % 17 AS dependency_depth,
      coalesce(fan_out, 0) * 120 AS neighbor_churn, f.line % 29 = 0 AS is_entrypoint, lines_added + lines_deleted AS churn_lines
      FROM v_scored f LEFT JOIN v_churn USING (file) LEFT JOIN v_seen ON u = f.line % 150 LEFT JOIN (SELECT src AS line, count(*) AS fan_out FROM v_edge GROUP BY 1) o ON o.line = f.line
      LEFT JOIN (SELECT dst AS line, count(*) AS fan_in FROM v_edge GROUP BY 1) i ON i.line = f.line
      LEFT JOIN (SELECT a.src AS line, count(*) + 1 AS scc_size FROM v_edge a JOIN v_edge b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) s ON s.line = f.line""",
}
_NEEDS = {"v_scored": ["v_fn"], "v_commit_file": ["v_commit"], "v_pair": ["v_snap"], "v_before": ["v_pair"], "v_after": ["v_pair"], "v_churn": ["v_fn"], "v_seen": ["v_touch"], "v_full": ["v_scored", "v_churn", "v_seen", "v_edge"]}


def with_views(body: str, *names: str, also: dict[str, str] | None = None, recursive: bool = False) -> str:
    """body behind the CTEs of the named views and all that they need, then those of ``also``."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (also or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body
