"""The query catalogue: each operator on the adapter views, with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import aggregates as A
from ..operators import coupling as C
from ..operators import delta as D
from ..operators import graph as G
from ..operators import history as H
from ..operators import joins as J
from ..operators import models as M
from ..operators import policy as P
from ..operators import quantiles as Q
from ..operators import ranking as R
from ..operators import trends as T
from ..sources import adapters as V
from ..sources.adapters import AS_OF, COMMITS_AS_OF, with_views
from ..sources.shared import spread, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DAY = 86400
HALF = "floor(({0}) * {1}.0 + 0.5) / {1}.0"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Scores ----------------------------------------------------------------------------------------------------------------------------


@query(with_views("SELECT function_id, round(r_cc, 6) AS r_cc, r_nd, round(r_fo, 6) AS r_fo, r_ns, round(lrs, 6) AS lrs, band FROM v_scored", "v_scored"))
def q_lrs_scores(spark, d):
    return S.scored(V.fn(spark, d)).select("function_id", *r6("r_cc"), "r_nd", *r6("r_fo"), "r_ns", *r6("lrs"), "band")


@query(with_views("SELECT band, count(*) AS count, round(sum(lrs), 6) AS sum_risk FROM v_scored GROUP BY band", "v_scored"))
def q_band_distribution(spark, d):
    return A.band_distribution(S.scored(V.fn(spark, d)), F.col("lrs")).select("band", "count", *r6("sum_risk"))


@query(with_views("SELECT function_id, round(lrs, 6) AS lrs FROM v_scored WHERE lrs >= 9", "v_scored"))
def q_min_lrs_filter(spark, d):
    from ..config import Config

    return S.scored(V.fn(spark, d), Config(min_lrs=9.0)).select("function_id", *r6("lrs"))


@query(with_views("SELECT file, line, function_id, round(lrs, 6) AS lrs FROM v_scored ORDER BY v_scored.lrs DESC, file, line, function_id LIMIT 20", "v_scored"))
def q_topn_reports(spark, d):
    order = [F.desc("lrs"), F.col("file"), F.col("line"), F.col("function_id")]
    return Q.top_n(S.scored(V.fn(spark, d)), order, 20).select("file", "line", "function_id", *r6("lrs"))


FACTORS = """SELECT *, coalesce((lines_added + lines_deleted) / 100.0 * 0.5, 0)::DOUBLE AS f_churn, coalesce(CASE WHEN touch_count_30d IS NOT NULL THEN least(touch_count_30d / 10.0, 5.0) * 0.3 END, 0)::DOUBLE AS f_activity,
  coalesce(greatest(5.0 - days_since_last_change / 7.0, 0.0) * 0.2, 0)::DOUBLE AS f_recency, (least(fan_in / 5.0, 10.0) * 0.4)::DOUBLE AS f_fan_in, CASE WHEN scc_size > 1 THEN scc_size * 0.3 ELSE 0 END::DOUBLE AS f_cycle,
  (least(dependency_depth / 3.0, 5.0) * 0.1)::DOUBLE AS f_depth, (neighbor_churn / 500.0 * 0.2)::DOUBLE AS f_neighbor FROM v_full"""
RISK = "SELECT *, CASE WHEN s > lrs OR f_churn > 0 THEN s END AS activity_risk FROM (SELECT *, lrs + f_churn + f_activity + f_recency + f_fan_in + f_cycle + f_depth + f_neighbor AS s FROM factors)"
_PARTS = ["f_churn", "f_activity", "f_recency", "f_fan_in", "f_cycle", "f_depth", "f_neighbor"]


@query(with_views(f"SELECT function_id, {', '.join(f'round({p}, 6) AS {p}' for p in _PARTS)}, round(activity_risk, 6) AS activity_risk FROM risk", "v_full", also={"factors": FACTORS, "risk": RISK}))
def q_activity_risk(spark, d):
    return S.with_activity_risk(V.enriched(spark, d)).select("function_id", *r6(*_PARTS, "activity_risk"))


AT = lambda c, p: f"(SELECT {c} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM v_full) WHERE i = (n - 1) * {p} // 100)"
THRESHOLDS = f"SELECT {AT('cc', 75)} AS cc_high, {AT('cc', 50)} AS cc_med, {AT('cc', 25)} AS cc_low, {AT('nd', 75)} AS nd_high, {AT('fan_out', 75)} AS fan_out_high, {AT('fan_in', 75)} AS fan_in_high, {AT('touch', 75)} AS touch_high, {AT('touch', 50)} AS touch_med"
DRIVER = """SELECT f.*, t.touch_med, CASE WHEN scc_size > 1 THEN 'cyclic_dep' WHEN cc > cc_high THEN 'high_complexity' WHEN touch > touch_high AND cc < cc_low THEN 'high_churn_low_cc'
  WHEN fan_out > fan_out_high AND touch > touch_med THEN 'high_fanout_churning' WHEN nd > nd_high THEN 'deep_nesting' WHEN fan_in > fan_in_high AND cc > cc_med THEN 'high_fanin_complex' ELSE 'composite' END AS driver
  FROM v_full f, thresholds t"""
_THRESH_COLS = ["cc_high", "cc_med", "cc_low", "nd_high", "fan_out_high", "fan_in_high", "touch_high", "touch_med"]


@query(with_views("SELECT * FROM thresholds", "v_full", also={"thresholds": THRESHOLDS}))
def q_dimension_thresholds(spark, d):
    return longs(Q.dimension_thresholds(V.enriched(spark, d)), *_THRESH_COLS)


def _driven(spark, d):
    f = stored(V.enriched(spark, d), "enriched")
    return S.driver(f.crossJoin(F.broadcast(Q.dimension_thresholds(f))))


@query(with_views("SELECT function_id, driver FROM driven", "v_full", also={"thresholds": THRESHOLDS, "driven": DRIVER}))
def q_driver_labels(spark, d):
    return _driven(spark, d).select("function_id", "driver")


_DIMS = ("cc", "nd", "fan_out", "fan_in", "touch")
_RANKS = ", ".join(f"((rank() OVER (ORDER BY {x}) - 1) * 100 // count(*) OVER ())::INT AS p_{x}" for x in _DIMS)
_UNPIVOT = " UNION ALL ".join(f"SELECT function_id, p_{x} AS p, {i} AS o, '{x}' AS d FROM ranks WHERE p_{x} >= 40 AND driver = 'composite'" for i, x in enumerate(_DIMS))
NEAR = """SELECT function_id, string_agg(d || ' (P' || p::VARCHAR || ')', ', ' ORDER BY p DESC, o) AS driver_detail FROM (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY p DESC, o) AS r FROM dims) WHERE r <= 3 GROUP BY function_id"""


@query(with_views("SELECT function_id, driver, driver_detail FROM driven LEFT JOIN near USING (function_id)", "v_full", also={"thresholds": THRESHOLDS, "driven": DRIVER, "ranks": f"SELECT function_id, driver, {_RANKS} FROM driven", "dims": _UNPIVOT, "near": NEAR}))
def q_near_miss(spark, d):
    return S.near_miss(stored(_driven(spark, d), "driven")).select("function_id", "driver", "driver_detail")


QUAD = "CASE WHEN band IN ('high', 'critical') THEN CASE WHEN act THEN 'fire' ELSE 'debt' END WHEN act THEN 'watch' ELSE 'ok' END"
QUADS = f"SELECT *, {QUAD} AS quadrant FROM (SELECT *, coalesce(touch_count_30d > touch_med, false) OR coalesce(days_since_last_change <= 30, false) AS act FROM driven)"


def _quads(spark, d):
    x = _driven(spark, d)
    return x.withColumn("quadrant", S.quadrant(F.col("touch_count_30d"), F.col("days_since_last_change"), F.col("touch_med"), F.col("band")))


@query(with_views("SELECT function_id, band, quadrant FROM quads", "v_full", also={"thresholds": THRESHOLDS, "driven": DRIVER, "quads": QUADS}))
def q_quadrants(spark, d):
    return _quads(spark, d).select("function_id", "band", "quadrant")


def _action_sql() -> str:
    out = []
    for (k, q), text in sorted(S.ACTIONS.items(), key=lambda x: (x[0][0] is None, x[0][1] is None)):
        tests = [f"driver = '{k}'"] * bool(k) + [f"quadrant = '{q}'"] * bool(q) or ["true"]
        out.append(f"WHEN {' AND '.join(tests)} THEN '{text}'")
    return f"CASE {' '.join(out)} END"


@query(with_views(f"SELECT driver, quadrant, {_action_sql()} AS action, count(*) AS functions FROM quads GROUP BY ALL", "v_full", also={"thresholds": THRESHOLDS, "driven": DRIVER, "quads": QUADS}))
def q_driver_actions(spark, d):
    x = _quads(spark, d).withColumn("action", S.driver_action(F.col("driver"), F.col("quadrant")))
    return x.groupBy("driver", "quadrant", "action").agg(F.count("*").alias("functions"))


@query(with_views(f"SELECT quadrant, rank, function_id, round(score, 6) AS score FROM (SELECT quadrant, function_id, activity_score AS score, row_number() OVER (PARTITION BY quadrant ORDER BY activity_score DESC, function_id) AS rank FROM (SELECT q.quadrant, q.function_id, coalesce(r.activity_risk, r.lrs) AS activity_score FROM quads q JOIN risk r USING (function_id))) WHERE rank <= 5", "v_full", also={"thresholds": THRESHOLDS, "driven": DRIVER, "quads": QUADS, "factors": FACTORS, "risk": RISK}))
def q_triage(spark, d):
    x = S.with_activity_risk(_quads(spark, d)).withColumn("score", S.rank_score())
    return longs(Q.top_per_group(x, ["quadrant"], [F.desc("score"), F.col("function_id")], 5), "rank").select("quadrant", "rank", "function_id", *r6("score"))


TIER1 = [("complex_branching", "cc >= 10 AND nd >= 4"), ("deeply_nested", "nd >= 5"), ("exit_heavy", "ns >= 5"), ("god_function", "loc >= 60 AND fo >= 10"), ("long_function", "loc >= 80")]
TIER2 = [
    ("churn_magnet", "churn_lines >= 200 AND cc >= 8"), ("cyclic_hub", "scc_size >= 2 AND fan_in >= 6"), ("hub_function", "fan_in >= 10 AND cc >= 8"), ("middle_man", "NOT is_entrypoint AND fan_in >= 8 AND fo >= 8 AND cc <= 4"),
    ("neighbor_risk", "NOT is_entrypoint AND neighbor_churn >= 400 AND fo >= 8"), ("shotgun_target", "fan_in >= 8 AND churn_lines >= 150"), ("stale_complex", "cc >= 10 AND loc >= 60 AND days_since_last_change >= 180"),
    ("volatile_god", "loc >= 60 AND fo >= 10 AND churn_lines >= 200 AND cc >= 8"),
]


def _patterns_sql(rules, view):
    parts = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in rules)
    return f"SELECT function_id, concat_ws(',', {parts}) AS patterns FROM {view}"


def _bare(df):
    """Without graph and history: only the first tier can fire."""
    none = F.lit(None).cast("long")
    return df.withColumns({c: none for c in ("fan_in", "scc_size", "churn_lines", "neighbor_churn", "days_since_last_change")} | {"is_entrypoint": F.lit(False)})


@query(with_views(_patterns_sql(TIER1, "v_fn"), "v_fn"))
def q_patterns_tier1(spark, d):
    return _bare(V.fn(spark, d)).select("function_id", F.array_join(S.pattern_ids(S.pattern_details()), ",").alias("patterns"))


@query(with_views(_patterns_sql(TIER1 + TIER2, "v_full"), "v_full"))
def q_patterns_tier2(spark, d):
    return V.enriched(spark, d).select("function_id", F.array_join(S.pattern_ids(S.pattern_details()), ",").alias("patterns"))


_BREAK = " UNION ALL ".join(f"SELECT '{n}' AS pattern FROM v_full WHERE {t}" for n, t in TIER1 + TIER2)


@query(with_views(f"SELECT pattern, count(*) AS count FROM ({_BREAK}) GROUP BY pattern", "v_full"))
def q_pattern_breakdown(spark, d):
    return A.pattern_breakdown(V.enriched(spark, d).withColumn("patterns", S.pattern_ids(S.pattern_details())))


@query(with_views("SELECT function_id, 'complex_branching' AS id, 1 AS tier, metric, op, value, threshold FROM (SELECT function_id, 'cc' AS metric, '>=' AS op, cc AS value, 10::BIGINT AS threshold FROM v_full WHERE cc >= 10 AND nd >= 4 UNION ALL SELECT function_id, 'nd', '>=', nd, 4 FROM v_full WHERE cc >= 10 AND nd >= 4)", "v_full"))
def q_pattern_details(spark, d):
    x = V.enriched(spark, d).select("function_id", F.explode(S.pattern_details()).alias("p")).filter("p.id = 'complex_branching'")
    return x.select("function_id", "p.id", "p.tier", F.explode("p.triggered_by").alias("t")).select("function_id", "id", "tier", "t.*")


_EXPL = {"total_churn": "coalesce(churn_lines, 0)", "lrs": "lrs", "fan_in": "CASE WHEN fan_in < 3 THEN 0 ELSE fan_in END", "authors_90d": "touch", "directed_coupling": "coalesce(lines_deleted, 0)", "cc": "cc", "nd": "nd"}
_PCT = ", ".join(f"(rank() OVER (ORDER BY {e}) - 1)::DOUBLE / count(*) OVER () AS p_{n}" for n, e in _EXPL.items())
_ELEV = " UNION ALL ".join(f"SELECT function_id, p_{n} AS p, {i} AS o, '{n}' AS f FROM pcts" for i, n in enumerate(_EXPL))
_SINGLE = "CASE f " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.PHRASES.items()) + " END"
_PAIR = "CASE " + " ".join(f"WHEN (f1 = '{a}' AND f2 = '{b}') OR (f1 = '{b}' AND f2 = '{a}') THEN '{t}'" for (a, b), t in S.PAIRS.items()) + " END"
EXPLAIN = f"""SELECT function_id, upper(t[1]) || t[2:] || '.' AS explanation FROM (
  SELECT function_id, coalesce(CASE WHEN k >= 2 THEN {_PAIR} END, CASE WHEN k <= 1 THEN s1 WHEN k = 2 THEN s1 || ' and ' || s2 ELSE s1 || ', ' || s2 || ', and ' || s3 END) AS t FROM (
    SELECT function_id, count(*) FILTER (WHERE p >= 0.8) AS k, max(f) FILTER (WHERE r = 1) AS f1, max(f) FILTER (WHERE r = 2) AS f2, max(s) FILTER (WHERE r = 1) AS s1, max(s) FILTER (WHERE r = 2) AS s2, max(s) FILTER (WHERE r = 3) AS s3
    FROM (SELECT *, {_SINGLE} AS s, row_number() OVER (PARTITION BY function_id ORDER BY p DESC, o) AS r FROM elev) GROUP BY function_id))"""


@query(with_views(f"SELECT e.* FROM ({EXPLAIN}) e JOIN v_full USING (function_id) WHERE band IN ('high', 'critical')", "v_full", also={"pcts": f"SELECT function_id, {_PCT} FROM v_full", "elev": _ELEV}))
def q_explanations(spark, d):
    x = V.enriched(spark, d)
    x = stored(x.select("function_id", "band", *[F.expr(e).alias(f"v_{n}") for n, e in _EXPL.items()]), "features")
    for n in _EXPL:
        x = Q.percentile_rank(x, f"v_{n}", f"p_{n}")
    return x.filter(F.col("band").isin("high", "critical")).select("function_id", S.explanation().alias("explanation"))


# Roll-ups --------------------------------------------------------------------------------------------------------------------------

FILES = "SELECT file, sum(lrs) AS sum_lrs, max(lrs) AS max_lrs, count(*) FILTER (WHERE band IN ('high', 'critical')) AS high_plus_count FROM v_scored GROUP BY file"


@query(with_views("SELECT file, round(sum_lrs, 6) AS sum_lrs, round(max_lrs, 6) AS max_lrs, high_plus_count FROM files", "v_scored", also={"files": FILES}))
def q_file_aggregates(spark, d):
    return A.file_aggregates(S.scored(V.fn(spark, d))).select("file", *r6("sum_lrs", "max_lrs"), "high_plus_count")


@query(with_views("SELECT directory, round(sum(sum_lrs), 6) AS sum_lrs, round(max(max_lrs), 6) AS max_lrs, sum(high_plus_count)::BIGINT AS high_plus_count FROM (SELECT '.' AS directory, * FROM files UNION ALL SELECT split_part(file, '/', 1), * FROM files) GROUP BY directory", "v_scored", also={"files": FILES}))
def q_directory_rollup(spark, d):
    return A.directory_rollup(A.file_aggregates(S.scored(V.fn(spark, d)))).select("directory", *r6("sum_lrs", "max_lrs"), "high_plus_count")


_FRV = f"""SELECT file, function_count, loc::BIGINT AS loc, max_cc, {HALF.format("a", 100)} AS avg_cc, critical_count, file_churn, {HALF.format("max_cc * 0.4::DOUBLE + a * 0.3::DOUBLE + log2(function_count + 1) * 0.2::DOUBLE + least(file_churn / 100.0::DOUBLE, 10.0) * 0.1::DOUBLE", 100)} AS file_risk_score
  FROM (SELECT file, count(*) AS function_count, sum(loc) AS loc, max(cc) AS max_cc, sum(cc)::DOUBLE / count(*) AS a, count(*) FILTER (WHERE band = 'critical') AS critical_count, coalesce(max(churn_lines), 0) AS file_churn FROM v_full GROUP BY file)"""


@query(with_views(_FRV, "v_full"))
def q_file_risk_view(spark, d):
    return A.file_risk_view(V.enriched(spark, d))


_TOPS = ", ".join(f"round(sum(s) FILTER (WHERE r <= greatest(n * {p} // 100, 1)) / sum(s), 6) AS top_{p}_pct_share" for p in (1, 5, 10))


@query(with_views(f"SELECT count(*) AS total_functions, round(sum(s), 6) AS total_risk, {_TOPS} FROM (SELECT s, row_number() OVER (ORDER BY s DESC) AS r, count(*) OVER () AS n FROM (SELECT coalesce(activity_risk, lrs) AS s FROM risk))", "v_full", also={"factors": FACTORS, "risk": RISK}))
def q_summary_shares(spark, d):
    x = S.with_activity_risk(V.enriched(spark, d)).withColumn("score", S.rank_score())
    return A.summary(x, "score").select("total_functions", *r6("total_risk", "top_1_pct_share", "top_5_pct_share", "top_10_pct_share"))


@query(with_views("SELECT sum(fan_out)::BIGINT AS total_edges, round(sum(fan_in) / count(*), 6) AS avg_fan_in, count(DISTINCT CASE WHEN scc_size > 1 THEN line END) AS scc_count, coalesce(max(CASE WHEN scc_size > 1 THEN scc_size END), 0) AS largest_scc_size FROM v_full", "v_full"))
def q_graph_stats(spark, d):
    x = A.graph_stats(V.enriched(spark, d).withColumn("scc_id", F.col("line")))
    return x.select("total_edges", *r6("avg_fan_in"), "scc_count", "largest_scc_size")


_LINKS = "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) || '/' || (page_id % 7)::VARCHAR || '/p' || page_id::VARCHAR AS file, page_id % 23 + 1 AS cc FROM pages"
_IMPORTS = "SELECT a.file AS src_file, b.file AS dst_file FROM pf a JOIN pf b ON b.page_id = a.page_id * 7 % 251 OR b.page_id = a.page_id + 1 WHERE a.page_id <> b.page_id"


def _page_files(spark, d):
    c = F.col
    p = V.table(spark, d, "pages").select("page_id", "url")
    pf = p.select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("/"), (c("page_id") % 7).cast("string"), F.lit("/p"), c("page_id").cast("string")).alias("file"), (c("page_id") % 23 + 1).alias("cc"))
    b = pf.select(c("page_id").alias("b"), c("file").alias("dst_file"))
    each = pf.select("page_id", c("file").alias("src_file"), F.explode(F.array_distinct(F.array(c("page_id") * 7 % 251, c("page_id") + 1))).alias("b")).filter("page_id <> b")
    return pf, each.join(b, "b").select("src_file", "dst_file")


_DIR = lambda x: f"regexp_extract({x}, '^(.*)/[^/]*$', 1)"
_MODULES = f"""SELECT module, file_count, function_count, {HALF.format("a", 100)} AS avg_complexity, coalesce(af, 0) AS afferent, coalesce(ef, 0) AS efferent, {HALF.format("CASE WHEN coalesce(af, 0) + coalesce(ef, 0) = 0 THEN 0.5 ELSE coalesce(ef, 0)::DOUBLE / (coalesce(af, 0) + coalesce(ef, 0)) END", 1000)} AS instability,
  CASE WHEN (CASE WHEN coalesce(af, 0) + coalesce(ef, 0) = 0 THEN 0.5 ELSE coalesce(ef, 0)::DOUBLE / (coalesce(af, 0) + coalesce(ef, 0)) END) < 0.3 AND a > 10 THEN 'high' ELSE 'low' END AS module_risk
  FROM (SELECT {_DIR("file")} AS module, count(DISTINCT file) AS file_count, count(*) AS function_count, sum(cc)::DOUBLE / count(*) AS a FROM pf GROUP BY 1)
  LEFT JOIN (SELECT {_DIR("src_file")} AS module, count(*) AS ef FROM imp WHERE {_DIR("src_file")} <> {_DIR("dst_file")} GROUP BY 1) USING (module)
  LEFT JOIN (SELECT {_DIR("dst_file")} AS module, count(*) AS af FROM imp WHERE {_DIR("src_file")} <> {_DIR("dst_file")} GROUP BY 1) USING (module)"""


@query(with_views(_MODULES, also={"pf": _LINKS, "imp": _IMPORTS}))
def q_module_instability(spark, d):
    pf, imports = _page_files(spark, d)
    return A.module_instability(pf, imports)


@query(with_views("SELECT file, 'm' || (CASE WHEN length(file) % 3 = 0 THEN '' ELSE '' END) || split_part(file, '/', 1) || CASE WHEN split_part(file, '/', 2) IN ('0', '3', '5') THEN '/' || split_part(file, '/', 2) ELSE '' END AS subsystem FROM pf", also={"pf": _LINKS}).replace("'m' || (CASE WHEN length(file) % 3 = 0 THEN '' ELSE '' END) || ", ""))
def q_subsystem(spark, d):
    pf, _ = _page_files(spark, d)
    host, sub = F.split("file", "/")[0], F.split("file", "/")[1]
    manifests = pf.select(host.alias("directory")).unionByName(pf.filter(sub.isin("0", "3", "5")).select(F.concat_ws("/", host, sub).alias("directory"))).distinct()
    return J.subsystem(pf.select("file"), manifests)


# Quantiles -------------------------------------------------------------------------------------------------------------------------

_CUT = lambda p: f"(SELECT s FROM o WHERE i = (n - 1) * {p} // 100)"


@query(with_views(f"SELECT function_id, s >= {_CUT(90)} AS is_top_10_pct, s >= {_CUT(95)} AS is_top_5_pct, s >= {_CUT(99)} AS is_top_1_pct FROM o", "v_full", also={"factors": FACTORS, "risk": RISK, "o": "SELECT function_id, s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM (SELECT function_id, round(coalesce(activity_risk, lrs), 6) AS s FROM risk)"}))
def q_percentile_flags(spark, d):
    x = S.with_activity_risk(V.enriched(spark, d)).select("function_id", F.round(S.rank_score(), 6).alias("score"))
    return Q.percentile_flags(x, "score").drop("score")


@query(with_views("SELECT round(min(CASE WHEN t >= 90 THEN lrs END), 6) AS p90, round(min(CASE WHEN t >= 95 THEN lrs END), 6) AS p95, round(min(CASE WHEN t >= 99 THEN lrs END), 6) AS p99 FROM (SELECT lrs, ntile(100) OVER (ORDER BY round(lrs, 6), function_id) AS t FROM v_scored)", "v_scored"))
def q_ntile_thresholds(spark, d):
    return Q.ntile_thresholds(S.scored(V.fn(spark, d)), "lrs", [F.round("lrs", 6), F.col("function_id")]).select(*r6("p90", "p95", "p99"))


@query(with_views("SELECT function_id, round((rank() OVER (ORDER BY round(lrs, 6)) - 1)::DOUBLE / count(*) OVER (), 6) AS pct FROM v_scored", "v_scored"))
def q_percentile_rank(spark, d):
    x = S.scored(V.fn(spark, d)).withColumn("v", F.round("lrs", 6))
    return Q.percentile_rank(x, "v", "pct").select("function_id", *r6("pct"))


# History ---------------------------------------------------------------------------------------------------------------------------


@query(with_views("SELECT f.function_id, lines_added, lines_deleted, lines_added - lines_deleted AS net_change FROM v_fn f LEFT JOIN v_churn USING (file)", "v_churn"))
def q_churn_join(spark, d):
    x = V.enriched(spark, d)
    return x.select("function_id", "lines_added", "lines_deleted", (F.col("lines_added") - F.col("lines_deleted")).alias("net_change"))


@query(with_views("SELECT file, lines_added, lines_deleted, lines_added - lines_deleted AS net_change FROM v_commit_file WHERE sha = 7", "v_commit_file"))
def q_commit_churn(spark, d):
    return H.commit_churn(V.commit_files(spark, d), 7)


@query(with_views(f"SELECT file, count(*) FILTER (WHERE ts >= {AS_OF} - {5 * DAY}) AS touch_count_30d FROM v_touch WHERE ts <= {AS_OF} GROUP BY file", "v_touch"))
def q_touch_30d(spark, d):
    return H.touch_metrics(V.touches(spark, d), AS_OF, 5).select("file", "touch_count_30d")


@query(with_views(f"SELECT file, ({COMMITS_AS_OF} - max(ts)) // {DAY} AS days_since_last_change FROM v_commit_file WHERE ts <= {COMMITS_AS_OF} GROUP BY file", "v_commit_file"))
def q_recency(spark, d):
    return H.touch_metrics(V.commit_files(spark, d), COMMITS_AS_OF).select("file", "days_since_last_change")


@query(with_views(f"SELECT f.function_id, CASE WHEN coalesce(t, 0) >= 60 THEN coalesce(o, 0) ELSE coalesce(t, 0) END AS touch_count_30d FROM v_fn f LEFT JOIN (SELECT file AS u, count(*) AS t FROM v_touch WHERE ts BETWEEN {AS_OF} - {30 * DAY} AND {AS_OF} GROUP BY 1) a ON a.u = f.line % 150 LEFT JOIN (SELECT l_partkey AS line, count(*) AS o FROM lineitem GROUP BY 1) b ON b.line = f.line", "v_fn", "v_touch"))
def q_hybrid_touch(spark, d):
    f = V.fn(spark, d).select("function_id", "line", (F.col("line") % 150).alias("file"))
    by_file = H.touch_metrics(V.touches(spark, d), AS_OF, 30)
    own = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("line")).agg(F.count("*").alias("touch_count_30d")).join(f.select("line", "function_id"), "line")
    return H.hybrid_touches(f, by_file, own, 60).select("function_id", "touch_count_30d")


_BASE = COMMITS_AS_OF - 20 * DAY
_BR = f"SELECT file, CASE WHEN n.d < 20 THEN coalesce(b.d, n.d) ELSE n.d END AS days_since_last_change FROM (SELECT file, ({COMMITS_AS_OF} - max(ts)) // {DAY} AS d FROM v_commit_file WHERE ts <= {COMMITS_AS_OF} GROUP BY file) n LEFT JOIN (SELECT file, ({_BASE} - max(ts)) // {DAY} AS d FROM v_commit_file WHERE ts <= {_BASE} GROUP BY file) b USING (file)"


@query(with_views(_BR, "v_commit_file"))
def q_branch_recency(spark, d):
    cf = V.commit_files(spark, d)
    return H.branch_recency(H.touch_metrics(cf, COMMITS_AS_OF), H.touch_metrics(cf, _BASE), 20)


_ENTROPY = "SELECT file, -sum(p * log2(p)) AS author_entropy FROM (SELECT file, c / sum(c) OVER (PARTITION BY file) AS p FROM (SELECT file, author, count(*)::DOUBLE AS c FROM v_touch GROUP BY 1, 2)) GROUP BY file"
_BURST = f"""SELECT file, CASE WHEN count(*) < 2 THEN 1.0 ELSE max(c) / avg(c) END AS burst_score FROM (
  SELECT file, (count(*) OVER (PARTITION BY file ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND {30 * DAY - 1} FOLLOWING) - row_number() OVER (PARTITION BY file ORDER BY ts, sha) + 1)::DOUBLE AS c FROM v_commit_file) GROUP BY file"""


@query(with_views(f"SELECT file, round(burst_score, 6) AS burst_score FROM ({_BURST})", "v_commit_file"))
def q_burst_score(spark, d):
    return H.burst_scores(V.commit_files(spark, d)).select("file", *r6("burst_score"))


@query(with_views(f"SELECT file, round(author_entropy, 6) AS author_entropy FROM ({_ENTROPY})", "v_touch"))
def q_author_entropy(spark, d):
    return H.author_entropy(V.touches(spark, d)).select("file", *r6("author_entropy"))


@query(with_views("SELECT file, round(count(*) FILTER (WHERE n = 1)::DOUBLE / count(*), 6) AS isolation_rate FROM v_commit_file JOIN (SELECT sha, count(*) AS n FROM v_commit_file GROUP BY sha) USING (sha) GROUP BY file", "v_commit_file"))
def q_isolation_rate(spark, d):
    return H.history_signals(V.commit_files(spark, d), COMMITS_AS_OF).select("file", *r6("isolation_rate"))


_HIST = f"""SELECT h.file, commit_count, author_count, round(author_entropy, 6) AS author_entropy, round(isolation_rate, 6) AS isolation_rate, round(age_days, 6) AS age_days, round(last_touch_days, 6) AS last_touch_days, round(burst_score, 6) AS burst_score
  FROM (SELECT file, count(*) AS commit_count, count(DISTINCT author) AS author_count, count(*) FILTER (WHERE n = 1)::DOUBLE / count(*) AS isolation_rate, (max(ts) - min(ts)) / 86400.0 AS age_days, ({COMMITS_AS_OF} - max(ts)) / 86400.0 AS last_touch_days
    FROM v_commit_file JOIN (SELECT sha, count(*) AS n FROM v_commit_file GROUP BY sha) USING (sha) GROUP BY file) h JOIN ({_ENTROPY.replace("v_touch", "v_commit_file")}) USING (file) JOIN ({_BURST}) USING (file)"""


@query(with_views(_HIST, "v_commit_file"))
def q_history_signals(spark, d):
    x = H.history_signals(V.commit_files(spark, d), COMMITS_AS_OF)
    return x.select("file", "commit_count", "author_count", *r6("author_entropy", "isolation_rate", "age_days", "last_touch_days", "burst_score"))


@query(with_views(f"SELECT file, count(DISTINCT author) AS authors_90d FROM v_commit_file WHERE ts BETWEEN {COMMITS_AS_OF} - {90 * DAY} AND {COMMITS_AS_OF} GROUP BY file", "v_commit_file"))
def q_authors_90d(spark, d):
    return H.authors_in_window(V.commit_files(spark, d), COMMITS_AS_OF)


@query(with_views("SELECT file, count(DISTINCT sha) AS convention_bug_fix_count FROM v_commit_file WHERE is_fix GROUP BY file", "v_commit_file"))
def q_fix_counts(spark, d):
    return H.fix_counts(V.commit_files(spark, d))


@query(with_views(f"SELECT * FROM (SELECT file, max(ts) AS last_ts FROM v_touch WHERE ts <= {AS_OF} GROUP BY file) WHERE last_ts < {AS_OF} - {2 * DAY}", "v_touch"))
def q_stale_files(spark, d):
    return H.stale_files(V.touches(spark, d), AS_OF, 2)


@query(with_views("SELECT sha, ts, author::VARCHAR AS author, string_agg(file::VARCHAR, ',' ORDER BY file) AS files FROM (SELECT DISTINCT sha, ts, author, file FROM v_commit_file) GROUP BY ALL", "v_commit_file"))
def q_commit_log(spark, d):
    return H.commit_log(V.commit_files(spark, d)).withColumn("files", F.array_join(F.col("files").cast("array<string>"), ","))


# Coupling --------------------------------------------------------------------------------------------------------------------------


def _pairs_sql(where: str = "true", least: int = 25) -> str:
    x = f"SELECT sha, file FROM v_commit_file WHERE {where}"
    return f"""SELECT file_a, file_b, co_change_count, {HALF.format("co_change_count / least(na, nb)::DOUBLE", 1000)} AS coupling_ratio, CASE WHEN co_change_count / least(na, nb)::DOUBLE > 0.5 THEN 'high' WHEN co_change_count / least(na, nb)::DOUBLE > 0.25 THEN 'moderate' ELSE 'low' END AS risk
      FROM (SELECT a.file AS file_a, b.file AS file_b, count(*) AS co_change_count FROM ({x}) a JOIN ({x}) b ON a.sha = b.sha AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= {least})
      JOIN (SELECT file AS file_a, count(*) AS na FROM ({x}) GROUP BY 1) USING (file_a) JOIN (SELECT file AS file_b, count(*) AS nb FROM ({x}) GROUP BY 1) USING (file_b)"""


@query(with_views(_pairs_sql(), "v_commit_file"))
def q_cochange_pairs(spark, d):
    return C.co_change(V.commit_files(spark, d), 25)


_DEPS = "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT s_suppkey AS a, s_suppkey * 3 % 101 AS b FROM supplier)"
_STATIC = "SELECT file_a, file_b, co_change_count, coupling_ratio, CASE WHEN d.a IS NOT NULL THEN 'expected' ELSE risk END AS risk, d.a IS NOT NULL AS has_static_dep FROM pairs LEFT JOIN deps d ON d.a = file_a AND d.b = file_b"


def _deps(spark, d):
    return V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("src_file"), (F.col("s_suppkey") * 3 % 101).alias("dst_file"))


@query(with_views(_STATIC, "v_commit_file", also={"pairs": _pairs_sql(), "deps": _DEPS}))
def q_cochange_static(spark, d):
    return C.with_static_deps(C.co_change(V.commit_files(spark, d), 25), _deps(spark, d))


# Files are return flags, alone and with line statuses, here: few, so they change together often. A flag imports its own with statuses.
_FLAG_PAIRS = """WITH x AS (SELECT DISTINCT l_orderkey AS sha, unnest([l_returnflag, l_returnflag || l_linestatus]) AS file FROM lineitem), n AS (SELECT file, count(*) AS n FROM x GROUP BY 1),
  p AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS c FROM x a JOIN x b ON a.sha = b.sha AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 3),
  r AS (SELECT file_a, file_b, c, c / least(na.n, nb.n)::DOUBLE AS r FROM p JOIN n na ON na.file = file_a JOIN n nb ON nb.file = file_b)
  SELECT file_a, file_b, c AS co_change_count, floor(r * 1000 + 0.5) / 1000 AS coupling_ratio, CASE WHEN r > 0.5 THEN 'high' ELSE 'moderate' END AS risk, FALSE AS has_static_dep FROM r WHERE r > 0.25 AND NOT starts_with(file_b, file_a)"""


@query(_FLAG_PAIRS)
def q_hidden_coupling(spark, d):
    x = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), "l_returnflag", F.concat("l_returnflag", "l_linestatus").alias("both"))
    cf = spread(x, "sha").select("sha", F.explode(F.array("l_returnflag", "both")).alias("file")).distinct()
    return C.hidden_coupling(C.with_static_deps(C.co_change(cf), x.select(F.col("l_returnflag").alias("src_file"), F.col("both").alias("dst_file"))), source="")


_RANK = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_MID = 883612800


@query(with_views(f"SELECT file_a, file_b, CASE WHEN p.risk IS NULL THEN 'new' WHEN c.risk IS NULL THEN 'dropped' WHEN {_RANK.format('c.risk')} > {_RANK.format('p.risk')} THEN 'risk_increased' ELSE 'risk_decreased' END AS status, p.risk AS prev_risk, c.risk AS curr_risk FROM prev p FULL JOIN curr c USING (file_a, file_b) WHERE p.risk IS DISTINCT FROM c.risk", "v_commit_file", also={"prev": _pairs_sql(f"ts < {_MID}", 10), "curr": _pairs_sql(f"ts >= {_MID}", 10)}))
def q_cochange_diff(spark, d):
    cf = V.commit_files(spark, d)
    return C.co_change_diff(C.co_change(cf.filter(F.col("ts") < _MID), 10), C.co_change(cf.filter(F.col("ts") >= _MID), 10))


@query(with_views("SELECT file, round(w / n, 6) AS directed_coupling FROM (SELECT a.file, count(DISTINCT a.sha) AS n, coalesce(sum(CASE WHEN b.file <> a.file THEN greatest(s_acctbal, 0) END), 0) AS w FROM v_commit_file a JOIN v_commit_file b ON a.sha = b.sha LEFT JOIN supplier ON s_suppkey = b.file GROUP BY a.file) WHERE n >= 10", "v_commit_file"))
def q_directed_coupling(spark, d):
    scores = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_acctbal").alias("score"))
    return C.directed_coupling(V.commit_files(spark, d), scores).select("file", *r6("directed_coupling"))


_JAC = """SELECT CASE WHEN count(*) FILTER (WHERE late) > 0 AND count(*) FILTER (WHERE NOT late) > 0 THEN (count(*) - count(DISTINCT file))::DOUBLE / count(DISTINCT file) END AS j FROM (
  SELECT late, file, row_number() OVER (PARTITION BY late ORDER BY c DESC, file) AS r, count(*) OVER (PARTITION BY late) AS n FROM (SELECT late, file, count(*) AS c FROM v_commit_file JOIN (SELECT sha, i >= floor(n * 0.8) AS late FROM (SELECT sha, row_number() OVER (ORDER BY ts, sha) - 1 AS i, count(*) OVER () AS n FROM v_commit)) USING (sha) WHERE is_fix GROUP BY 1, 2)) WHERE r <= greatest(floor(n * 0.2), 1)"""


@query(with_views(f"SELECT round(j, 6) AS jaccard FROM ({_JAC})", "v_commit_file"))
def q_jaccard_stability(spark, d):
    return C.jaccard_stability(V.commits(spark, d), V.commit_files(spark, d)).select(*r6("jaccard"))


# Joins -----------------------------------------------------------------------------------------------------------------------------

_CALLS = "SELECT p_partkey AS caller, p_brand AS caller_file, 'n' || (p_partkey * 13 % 97)::VARCHAR AS name FROM part"
_DEFS = "SELECT p_partkey AS function_id, p_brand AS file, 'n' || (p_partkey % 97)::VARCHAR AS name, p_partkey AS ord FROM part"
_RES = """SELECT DISTINCT caller AS src, dst FROM (SELECT caller, d.function_id AS dst, row_number() OVER (PARTITION BY caller, name ORDER BY lvl, ord) AS r FROM (
  SELECT c.caller, c.name, d.function_id, d.ord, CASE WHEN d.file = c.caller_file THEN 0 WHEN i.src IS NOT NULL THEN 1 ELSE 2 END AS lvl FROM calls c JOIN defs d USING (name) LEFT JOIN (SELECT DISTINCT 'Brand#' || (10 + b)::VARCHAR AS src, 'Brand#' || (10 + b * 3 % 26)::VARCHAR AS dst FROM range(0, 50) t(b)) i ON i.src = c.caller_file AND i.dst = d.file) d
  WHERE lvl < 2 OR d.function_id <> caller) WHERE r = 1 AND dst <> caller"""


@query(with_views(_RES, also={"calls": _CALLS, "defs": _DEFS}))
def q_callee_resolution(spark, d):
    p, c = V.table(spark, d, "part"), F.col
    calls = p.select(c("p_partkey").alias("caller"), c("p_brand").alias("caller_file"), F.concat(F.lit("n"), (c("p_partkey") * 13 % 97).cast("string")).alias("name"))
    defs = p.select(c("p_partkey").alias("function_id"), c("p_brand").alias("file"), F.concat(F.lit("n"), (c("p_partkey") % 97).cast("string")).alias("name"), c("p_partkey").alias("ord"))
    b = spark.range(0, 50).select(F.concat(F.lit("Brand#"), (c("id") + 10).cast("string")).alias("src_file"), F.concat(F.lit("Brand#"), (c("id") * 3 % 26 + 10).cast("string")).alias("dst_file"))
    return J.resolve_callees(calls, defs, b)


_CAND = "SELECT file AS src_file, unnest([split_part(file, '/', 1) || '/' || (page_id % 5)::VARCHAR || '/p' || (page_id + 1)::VARCHAR, split_part(file, '/', 1) || '/' || ((page_id + 2) % 7)::VARCHAR || '/p' || (page_id + 2)::VARCHAR, file]) AS dst_file, unnest([0, 1, 2]) AS o FROM pf"


@query(with_views("SELECT DISTINCT src_file, dst_file FROM (SELECT src_file, dst_file, row_number() OVER (PARTITION BY src_file ORDER BY o) AS r FROM cand WHERE dst_file IN (SELECT file FROM pf)) WHERE r = 1 AND src_file <> dst_file", also={"pf": _LINKS, "cand": _CAND}))
def q_import_resolution(spark, d):
    pf, _ = _page_files(spark, d)
    host, i = F.split("file", "/")[0], F.col("page_id")
    path = lambda m, k: F.concat_ws("/", host, m.cast("string"), F.concat(F.lit("p"), k.cast("string")))
    raw = pf.select(F.col("file").alias("src_file"), F.array(path(i % 5, i + 1), path((i + 2) % 7, i + 2), F.col("file")).alias("candidates"))
    return J.resolve_imports(raw, pf)


@query("SELECT e.event_id, o.ts AS order_ts, o.o_orderkey FROM (SELECT event_id, user_id, epoch(ts)::BIGINT - 800 * 86400 AS at FROM events) e ASOF LEFT JOIN (SELECT max(o_orderkey) AS o_orderkey, o_custkey, epoch(o_orderdate)::BIGINT AS ts FROM orders GROUP BY o_custkey, o_orderdate) o ON e.user_id = o.o_custkey AND e.at >= o.ts")
def q_asof_nearest(spark, d):
    e = V.table(spark, d, "events").select("event_id", "user_id", (V.seconds(F.col("ts")) - 800 * DAY).alias("at"))
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), V.seconds(F.col("o_orderdate")).alias("order_ts"), "o_orderkey")
    return J.asof_backward(e, o, ["user_id"], "at", "order_ts", ["o_orderkey"]).select("event_id", "order_ts", "o_orderkey")


@query(with_views("SELECT f.function_id, count(DISTINCT h.sha) AS touches, max(h.ts) AS last_ts FROM (SELECT p_partkey AS function_id, p_partkey % 50 AS file, p_partkey * 3 % 900 AS a, p_partkey * 3 % 900 + p_size AS b FROM part) f JOIN (SELECT o_orderkey AS sha, o_custkey % 50 AS file, epoch(o_orderdate)::BIGINT AS ts, o_orderkey % 900 AS a, o_orderkey % 900 + 2 AS b FROM orders) h ON h.file = f.file AND h.a <= f.b AND f.a <= h.b GROUP BY 1"))
def q_function_touches(spark, d):
    c = F.col
    f = V.table(spark, d, "part").select(c("p_partkey").alias("function_id"), (c("p_partkey") % 50).alias("file"), (c("p_partkey") * 3 % 900).alias("start_line"), (c("p_partkey") * 3 % 900 + c("p_size")).alias("end_line"))
    h = V.table(spark, d, "orders").select(c("o_orderkey").alias("sha"), (c("o_custkey") % 50).alias("file"), V.seconds(c("o_orderdate")).alias("ts"), (c("o_orderkey") % 900).alias("start"), F.lit(3).alias("length"))
    return J.interval_touches(h, f)


@query(with_views("SELECT src AS id, sum(lines) AS neighbor_churn FROM v_edge JOIN (SELECT l_partkey AS dst, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1) USING (dst) GROUP BY src", "v_edge").replace("sum(lines)", "sum(lines)::BIGINT"))
def q_neighbor_churn(spark, d):
    churn = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_linenumber").alias("churn_lines"))
    return J.neighbor_churn(V.edges(spark, d), churn)


@query("SELECT doc_id FROM documents WHERE 'a/b/' || source || '/x' || (doc_id % 9)::VARCHAR IN (SELECT DISTINCT 'a/b/src' || i::VARCHAR || '/x' || i::VARCHAR FROM range(0, 9) t(i))")
def q_suffix_labels(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.concat(F.lit("a/b/"), F.col("source"), F.lit("/x"), (F.col("doc_id") % 9).cast("string")).alias("path"))
    fixes = spark.range(0, 9).select(F.concat(F.lit("src"), F.col("id").cast("string"), F.lit("/x"), F.col("id").cast("string")).alias("fix"))
    return J.suffix_match(docs, fixes, "path", "fix").select("doc_id")


# Deltas and policies ---------------------------------------------------------------------------------------------------------------

DELTA = """SELECT function_id, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'deleted' WHEN a.cc <> b.cc OR abs(a.lrs - b.lrs) > 2.220446049250313e-16 OR a.band <> b.band THEN 'modified' ELSE 'unchanged' END AS status,
  b.lrs AS before_lrs, a.lrs AS after_lrs, b.band AS before_band, a.band AS after_band, b.cc AS before_cc, a.cc AS after_cc, CASE WHEN a.k IS NULL THEN b.suppression_reason ELSE a.suppression_reason END AS suppression_reason FROM v_before b FULL JOIN v_after a USING (function_id)"""
DELTAS = "SELECT *, CASE status WHEN 'modified' THEN after_lrs - before_lrs WHEN 'deleted' THEN -before_lrs END AS delta_lrs, CASE status WHEN 'modified' THEN after_cc - before_cc WHEN 'deleted' THEN -before_cc END AS delta_cc FROM d0"
_DV = {"d0": DELTA, "d": DELTAS}


def _deltas(spark, d):
    b, a = V.snapshot_pair(spark, d)
    return D.deltas(b, a)


@query(with_views("SELECT function_id, status, before_lrs, after_lrs, round(delta_lrs, 6) AS delta_lrs, delta_cc, CASE WHEN before_band <> after_band THEN before_band END AS band_from, CASE WHEN before_band <> after_band THEN after_band END AS band_to, suppression_reason FROM d", "v_before", "v_after", also=_DV))
def q_delta_full_outer(spark, d):
    return _deltas(spark, d).select("function_id", "status", "before_lrs", "after_lrs", *r6("delta_lrs"), "delta_cc", "band_from", "band_to", "suppression_reason")


@query(with_views("SELECT split_part(function_id, '::', 1) AS file, round(sum(coalesce(delta_lrs, CASE WHEN status = 'new' THEN after_lrs ELSE 0 END)), 6) AS net_lrs_delta, count(*) FILTER (WHERE delta_lrs > 0) AS regression_count, count(*) FILTER (WHERE delta_lrs < 0) AS improvement_count FROM d GROUP BY 1", "v_before", "v_after", also=_DV))
def q_delta_files(spark, d):
    return A.delta_files(_deltas(spark, d)).select("file", *r6("net_lrs_delta"), "regression_count", "improvement_count")


@query(with_views("SELECT function_id, 'new' AS status, lrs AS after_lrs FROM v_after", "v_after"))
def q_delta_baseline(spark, d):
    return D.deltas(None, V.snapshot_pair(spark, d)[1]).select("function_id", "status", "after_lrs")


@query(with_views("SELECT function_id, coalesce(a.lrs, b.lrs) AS lrs, coalesce(a.band, b.band) AS band, CASE WHEN b.lrs IS NULL THEN 'added' WHEN a.lrs IS NULL THEN 'removed' ELSE 'modified' END AS op FROM v_before b FULL JOIN v_after a USING (function_id) WHERE b.lrs IS DISTINCT FROM a.lrs", "v_before", "v_after"))
def q_storage_delta(spark, d):
    b, a = V.snapshot_pair(spark, d)
    return D.storage_delta(b, a).select("function_id", "lrs", "band", "op")


@query(with_views("SELECT function_id, lrs, band FROM v_after", "v_after"))
def q_apply_delta(spark, d):
    b, a = V.snapshot_pair(spark, d)
    return D.apply_storage_delta(b, D.storage_delta(b, a)).select("function_id", "lrs", "band")


@query(with_views("SELECT function_id, lrs FROM v_after UNION ALL SELECT function_id, lrs FROM v_before WHERE function_id NOT IN (SELECT function_id FROM v_after)", "v_before", "v_after"))
def q_upsert(spark, d):
    b, a = V.snapshot_pair(spark, d)
    return D.upsert(b, a).select("function_id", "lrs")


@query(with_views("SELECT function_id, status, round(change, 6) AS change FROM (SELECT *, CASE status WHEN 'new' THEN after_lrs WHEN 'deleted' THEN before_lrs ELSE abs(delta_lrs) END AS change FROM d WHERE status <> 'unchanged') ORDER BY d_change DESC, function_id LIMIT 20".replace("d_change", "change"), "v_before", "v_after", also=_DV))
def q_diff_topn(spark, d):
    return D.diff_top(_deltas(spark, d), 20).select("function_id", "status", *r6("change"))


@query()
def q_rename_hints(spark, d):
    b, a = V.snapshot_pair(spark, d)
    return D.rename_hints(b, a)


def _msg(*parts: str) -> str:
    return " || ".join(p if p.startswith("printf") or p == "function_id" else f"'{p}'" for p in parts)


_N = "NULL::DOUBLE"
_P2 = lambda x: f"printf('%.2f', {HALF.format(x, 100)})"
_POL = {
    "critical-introduction": f"SELECT 'critical-introduction' AS id, 'blocking' AS severity, function_id, {_msg('Function ', 'function_id', ' has become critical')} AS message, {_N} AS delta_lrs, {_N} AS total_delta, {_N} AS growth_percent FROM d WHERE after_band = 'critical' AND suppression_reason IS NULL AND before_band IS DISTINCT FROM 'critical'",
    "excessive-risk-regression": f"SELECT 'excessive-risk-regression' AS id, 'blocking' AS severity, function_id, {_msg('Function ', 'function_id', ' rose by ', _P2('delta_lrs'))} AS message, delta_lrs, {_N} AS total_delta, {_N} AS growth_percent FROM d WHERE status = 'modified' AND delta_lrs >= 1 AND suppression_reason IS NULL",
    "watch-threshold": f"SELECT 'watch-threshold' AS id, 'warning' AS severity, function_id, {_msg('Function ', 'function_id', ' nears moderate risk at ', _P2('after_lrs'))} AS message, delta_lrs, {_N} AS total_delta, {_N} AS growth_percent FROM d WHERE status IN ('new', 'modified') AND suppression_reason IS NULL AND after_lrs >= 2.5 AND after_lrs < 3 AND (before_lrs IS NULL OR before_lrs < 2.5)",
    "attention-threshold": f"SELECT 'attention-threshold' AS id, 'warning' AS severity, function_id, {_msg('Function ', 'function_id', ' nears high risk at ', _P2('after_lrs'))} AS message, delta_lrs, {_N} AS total_delta, {_N} AS growth_percent FROM d WHERE status IN ('new', 'modified') AND suppression_reason IS NULL AND after_lrs >= 5.5 AND after_lrs < 6 AND (before_lrs IS NULL OR before_lrs < 5.5)",
    "rapid-growth": f"SELECT 'rapid-growth' AS id, 'warning' AS severity, function_id, {_msg('Function ', 'function_id', ' grew from ', _P2('before_lrs'), ' to ', _P2('after_lrs'))} AS message, after_lrs - before_lrs AS delta_lrs, {_N} AS total_delta, (after_lrs - before_lrs) / before_lrs * 100 AS growth_percent FROM d WHERE status = 'modified' AND suppression_reason IS NULL AND before_lrs > 2.220446049250313e-16 AND (after_lrs - before_lrs) / before_lrs * 100 >= 50",
    "suppression-missing-reason": f"SELECT 'suppression-missing-reason' AS id, 'warning' AS severity, function_id, {_msg('Function ', 'function_id', ' is suppressed without a reason')} AS message, {_N} AS delta_lrs, {_N} AS total_delta, {_N} AS growth_percent FROM d WHERE suppression_reason = ''",
    "net-repo-regression": f"SELECT 'net-repo-regression' AS id, 'warning' AS severity, NULL::VARCHAR AS function_id, {_msg('Total risk rose by ', _P2('t'))} AS message, {_N} AS delta_lrs, t AS total_delta, {_N} AS growth_percent FROM (SELECT (SELECT coalesce(sum(lrs), 0) FROM v_after) - (SELECT coalesce(sum(lrs), 0) FROM v_before) AS t) WHERE t > 0",
}
_PCOLS = "id, severity, function_id, message, round(delta_lrs, 6) AS delta_lrs, round(total_delta, 4) AS total_delta, round(growth_percent, 6) AS growth_percent"


def _policy_cols(df):
    return df.select("id", "severity", "function_id", "message", *r6("delta_lrs"), F.round("total_delta", 4).alias("total_delta"), *r6("growth_percent"))


def _policy_query(name: str, make) -> None:
    def run(spark, d):
        return _policy_cols(make(spark, d))

    run.__name__ = "q_policy_" + name.replace("-", "_")
    query(with_views(f"SELECT {_PCOLS} FROM ({_POL[name]})", "v_before", "v_after", also=_DV))(run)


_policy_query("critical-introduction", lambda s, d: P.critical_introduction(_deltas(s, d)))
_policy_query("excessive-risk-regression", lambda s, d: P.excessive_risk_regression(_deltas(s, d)))
_policy_query("watch-threshold", lambda s, d: P.watch_threshold(_deltas(s, d)))
_policy_query("attention-threshold", lambda s, d: P.attention_threshold(_deltas(s, d)))
_policy_query("rapid-growth", lambda s, d: P.rapid_growth(_deltas(s, d)))
_policy_query("suppression-missing-reason", lambda s, d: P.suppression_missing_reason(_deltas(s, d)))
_policy_query("net-repo-regression", lambda s, d: P.net_repo_regression(*V.snapshot_pair(s, d)))


@query(with_views(f"SELECT {_PCOLS} FROM ({' UNION ALL '.join(_POL.values())})", "v_before", "v_after", also=_DV))
def q_policy_all(spark, d):
    b, a = V.snapshot_pair(spark, d)
    return _policy_cols(P.evaluate(D.deltas(b, a), b, a))


_GATE = f"SELECT DISTINCT file FROM v_commit_file WHERE is_fix AND ts BETWEEN {COMMITS_AS_OF} - {90 * DAY} AND {COMMITS_AS_OF}"


@query(with_views(f"SELECT CASE WHEN ff = 0 OR n < 10 THEN 'inconclusive' WHEN h / n::DOUBLE < 0.5 THEN 'suppressed' ELSE 'pass' END AS verdict, CASE WHEN ff > 0 AND n >= 10 THEN h / n::DOUBLE END AS p_at_10, ff AS fix_files_found FROM (SELECT count(*) AS n, count(*) FILTER (WHERE s_suppkey IN (SELECT file FROM fx)) AS h, (SELECT count(*) FROM fx) AS ff FROM (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10))", "v_commit_file", also={"fx": _GATE}))
def q_gate_p10(spark, d):
    f = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("function_id"), F.col("s_suppkey").alias("file"), F.col("s_acctbal").alias("score"))
    cf = V.commit_files(spark, d)
    return P.gate(f, cf.filter(F.col("is_fix") & F.col("ts").between(COMMITS_AS_OF - 90 * DAY, COMMITS_AS_OF)), "score")


# Trends ----------------------------------------------------------------------------------------------------------------------------


@query(with_views("SELECT function_id, round(v, 12) AS velocity, CASE WHEN abs(v) < 1e-9 THEN 'flat' WHEN v > 0 THEN 'positive' ELSE 'negative' END AS direction, first_lrs, last_lrs, n AS commit_count FROM (SELECT *, (last_lrs - first_lrs) / (n - 1) AS v FROM (SELECT function_id, arg_min(lrs, k) AS first_lrs, arg_max(lrs, k) AS last_lrs, count(*) AS n FROM v_snap GROUP BY 1) WHERE n >= 2)", "v_snap"))
def q_velocity(spark, d):
    return T.velocities(V.snapshots(spark, d)).select("function_id", F.round("velocity", 12).alias("velocity"), "direction", "first_lrs", "last_lrs", "commit_count")


@query(with_views("SELECT function_id, CASE WHEN r >= 0.8 THEN 'stable' WHEN r >= 0.5 THEN 'emerging' ELSE 'volatile' END AS stability, round(r, 6) AS overlap_ratio, a AS appearances, t AS total_snapshots FROM (SELECT function_id, count(*) AS a, (SELECT count(DISTINCT k) FROM v_snap) AS t, count(*)::DOUBLE / (SELECT count(DISTINCT k) FROM v_snap) AS r FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lrs DESC, function_id) AS x FROM v_snap) WHERE x <= 50 GROUP BY 1)", "v_snap"))
def q_stability(spark, d):
    return T.stability(V.snapshots(spark, d), 50).select("function_id", "stability", *r6("overlap_ratio"), "appearances", "total_snapshots")


_TD = "SELECT function_id, i, lrs - l AS delta FROM (SELECT *, lag(lrs) OVER w AS l, lag(i) OVER w AS pi FROM (SELECT *, dense_rank() OVER (ORDER BY k) - 1 AS i FROM v_snap) WINDOW w AS (PARTITION BY function_id ORDER BY i)) WHERE i - pi = 1"
_RF = """SELECT function_id, round(improvement_delta, 7) AS improvement_delta, sustained_commits, rebound_detected, CASE WHEN rebound_detected THEN 'partial' ELSE 'successful' END AS outcome FROM (
  SELECT function_id, improvement_delta, 1 + count(*) FILTER (WHERE delta <= -1 AND i < coalesce(rb, 1000000)) AS sustained_commits, max(rb) IS NOT NULL AS rebound_detected FROM (
    SELECT t.*, f.improvement_delta, min(CASE WHEN t.delta >= 0.5 THEN t.i END) OVER (PARTITION BY t.function_id) AS rb FROM td t JOIN (SELECT function_id, min(i) AS f, arg_min(delta, i) AS improvement_delta FROM td WHERE delta <= -1 GROUP BY 1) f ON t.function_id = f.function_id AND t.i >= f.f AND t.i < f.f + 3) GROUP BY 1, 2)"""


@query(with_views("SELECT function_id, i, round(delta, 7) AS delta FROM td", "v_snap", also={"td": _TD}))
def q_snapshot_deltas(spark, d):
    return T.snapshot_deltas(V.snapshots(spark, d)).select("function_id", "i", F.round("delta", 7).alias("delta"))


@query(with_views(_RF, "v_snap", also={"td": _TD}))
def q_refactor(spark, d):
    return T.refactorings(V.snapshots(spark, d)).select("function_id", F.round("improvement_delta", 7).alias("improvement_delta"), "sustained_commits", "rebound_detected", "outcome")


_L2 = """SELECT k FROM walk UNION SELECT max(k) FROM st"""


@query("WITH RECURSIVE " + with_views("", "v_snap", also={"b": "SELECT function_id, k, CASE WHEN lrs < 3 THEN 'low' WHEN lrs < 6 THEN 'moderate' ELSE 'high' END AS band FROM v_snap", "st": "SELECT k, (row_number() OVER (ORDER BY k))::BIGINT AS i, string_agg(function_id::VARCHAR || band, ',' ORDER BY function_id) AS s FROM b GROUP BY k", "walk(k, i, s)": "SELECT k, i, s FROM st WHERE i = 1 UNION ALL SELECT n.k, n.i, n.s FROM walk w JOIN st n ON n.i = (SELECT min(x.i) FROM st x WHERE x.i > w.i AND x.s <> w.s)"}).removeprefix("WITH ") + " SELECT DISTINCT k FROM (SELECT k FROM walk UNION ALL SELECT max(k) FROM st)")
def q_compact_l2(spark, d):
    s = V.snapshots(spark, d)
    return T.compact_level2(s.withColumn("band", F.when(F.col("lrs") < 3, "low").when(F.col("lrs") < 6, "moderate").otherwise("high")))


@query(with_views("SELECT sha, ts, CASE WHEN r = 1 OR r > n - 3 THEN 'full' ELSE 'delta' END AS stored_as FROM (SELECT k AS sha, k AS ts, row_number() OVER (ORDER BY k) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM v_snap))", "v_snap"))
def q_compact_l1(spark, d):
    index = V.snapshots(spark, d).select(F.col("k").alias("sha"), F.col("k").alias("ts")).distinct()
    return T.compact_level1(index, 3)


def _parents(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"))
    return o.withColumn("parent", F.when(F.col("sha") > 1, F.floor(F.col("sha") / 2).cast("long")))


@query("WITH RECURSIVE p AS (SELECT o_orderkey AS sha, CASE WHEN o_orderkey > 1 THEN o_orderkey // 2 END AS parent FROM orders), reach(sha) AS (SELECT sha FROM p WHERE sha IN (999, 500, 77) UNION SELECT p.parent FROM reach JOIN p USING (sha) WHERE p.parent IS NOT NULL) SELECT sha, ts, CASE WHEN sha IN (SELECT sha FROM reach) OR ts >= 900000000 THEN 'kept' ELSE 'pruned' END AS action FROM (SELECT o_orderkey AS sha, epoch(o_orderdate)::BIGINT AS ts FROM orders)")
def q_prune_reachability(spark, d):
    tips = spark.createDataFrame([(999,), (500,), (77,)], "sha long")
    reach = G.reachable(_parents(spark, d), tips.join(_parents(spark, d).select("sha"), "sha"))
    return T.prune(V.commits(spark, d).select("sha", "ts"), reach, 900000000 + 10 * DAY, 10)


# Graphs ----------------------------------------------------------------------------------------------------------------------------


@query(with_views("SELECT id, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM (SELECT src AS id FROM v_edge UNION SELECT dst FROM v_edge) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM v_edge GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM v_edge GROUP BY 1) USING (id)", "v_edge"))
def q_fan_in_out(spark, d):
    return G.degrees(V.edges(spark, d))


_PR = {
    "nodes": "SELECT src AS id FROM v_edge UNION SELECT dst FROM v_edge",
    "cnt": "SELECT count(*)::DOUBLE AS n FROM nodes",
    "e": "SELECT src, dst, count(*) OVER (PARTITION BY src)::DOUBLE AS deg FROM v_edge",
    "pr(it, id, r, was)": "SELECT 0, id, 1 / n, NULL::DOUBLE FROM nodes, cnt UNION ALL SELECT p.it + 1, p.id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce((SELECT sum(q.r / e.deg) FROM e JOIN pr q ON q.id = e.src WHERE e.dst = p.id), 0), p.r FROM pr p, cnt WHERE p.it < 30",
}


@query(with_views("SELECT id, round(r, 9) AS pagerank FROM pr WHERE it = coalesce((SELECT min(it) FROM (SELECT it, max(abs(r - was)) AS m FROM pr WHERE it > 0 GROUP BY it) WHERE m < 1e-6), 30)", "v_edge", also=_PR, recursive=True))
def q_pagerank(spark, d):
    return G.pagerank(V.edges(spark, d)).select("id", F.round("pagerank", 9).alias("pagerank"))


_DEPTH = {"nodes": "SELECT src AS id FROM v_edge UNION SELECT dst FROM v_edge", "bfs(id, depth)": "SELECT id, 0::BIGINT FROM nodes WHERE id NOT IN (SELECT dst FROM v_edge) UNION SELECT e.dst, b.depth + 1 FROM bfs b JOIN v_edge e ON e.src = b.id WHERE b.depth < 60"}


@query(with_views("SELECT id, min(depth) AS depth FROM nodes LEFT JOIN bfs USING (id) GROUP BY id", "v_edge", also=_DEPTH, recursive=True))
def q_dependency_depth(spark, d):
    return G.dependency_depth(V.edges(spark, d))


@query()
def q_scc(spark, d):
    return G.strong_components(V.edges(spark, d))


@query()
def q_betweenness(spark, d):
    return G.betweenness(V.edges(spark, d), exact_up_to=1_000_000).select("id", F.round("betweenness", 9).alias("betweenness"))


@query()
def q_betweenness_approx(spark, d):
    return G.betweenness(V.edges(spark, d), exact_up_to=0).select("id", F.round("betweenness", 9).alias("betweenness"))


# Ranking ---------------------------------------------------------------------------------------------------------------------------


@query("SELECT round(sum((2 * i - n - 1) * v) / (max(n) * sum(v)), 6) AS gini FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders)")
def q_gini(spark, d):
    return R.gini(V.table(spark, d, "orders"), "o_totalprice").select(*r6("gini"))


def _eval(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(V.table(spark, d, "labels"), "doc_id").select("doc_id", F.col("n_chars").alias("score"), F.col("quality").alias("label"))


_EV = "SELECT doc_id, n_chars AS score, quality AS label FROM documents JOIN labels USING (doc_id)"
_AVG = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"SELECT round(corr(a, b), 6) AS rho FROM (SELECT {_AVG.format('score')} AS a, {_AVG.format('label')} AS b FROM ({_EV}))")
def q_spearman(spark, d):
    return R.spearman(_eval(spark, d), "score", "label").select(*r6("rho"))


@query(f"WITH e AS ({_EV}), r AS (SELECT label, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM e) SELECT k::INT AS k, round(avg(label), 6) AS precision, round((SELECT avg(label) FROM e), 6) AS base_rate FROM (SELECT unnest([10, 20, 50, 100, 200]) AS k) JOIN r ON r.r <= k GROUP BY k")
def q_precision_at_k(spark, d):
    return R.precision_at_k(_eval(spark, d), "score", "label", "doc_id").select("k", *r6("precision", "base_rate"))


@query("SELECT round(avg(s_acctbal) / 100000, 6) AS mean_score, CASE WHEN avg(s_acctbal) / 100000 >= 0.06 THEN 'run' WHEN avg(s_acctbal) / 100000 >= 0.03 THEN 'ambiguous' ELSE 'skip' END AS verdict FROM supplier")
def q_screener(spark, d):
    return R.screen(V.table(spark, d, "supplier"), F.col("s_acctbal") / 100000).select(*r6("mean_score"), "verdict")


_COLD = """WITH c AS (SELECT l_suppkey, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1), o AS (SELECT v, row_number() OVER (ORDER BY v) AS i, row_number() OVER (ORDER BY v DESC) AS j, count(*) OVER () AS n FROM c),
 s AS (SELECT sum(v) FILTER (WHERE j <= greatest(ceil(n * 0.1), 1)) / sum(v) AS t, sum((2 * i - n - 1) * v) / (max(n) * sum(v)) AS g FROM o)
 SELECT CASE WHEN t < 0.05 THEN 'uniform_prior' WHEN g < 0.55 THEN 'anomaly' ELSE 'formula' END AS route, round(t, 6) AS top_share, round(g, 6) AS gini, 0.0::DOUBLE AS positive_rate FROM s"""


@query(_COLD)
def q_cold_start_route(spark, d):
    c = V.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("commit_count"))
    return R.cold_start_route(c, uniform=0.05).select("route", *r6("top_share", "gini"), "positive_rate")


@query("SELECT p_partkey, round(CASE WHEN p <= 0 OR p >= 1 THEN 0.0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END, 6) AS entropy FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS p FROM part)")
def q_binary_entropy(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.round(R.binary_entropy(F.col("p_size") / 50.0), 6).alias("entropy"))


def _features(spark, d):
    e = V.enriched(spark, d)
    return e.withColumns({"total_churn": F.col("churn_lines"), "authors_90d": F.col("touch"), "directed_coupling": F.col("lines_deleted"), "commit_count": F.col("touch"), "author_count": F.col("touch") % 5, "author_entropy": F.col("nd") / 3.0, "burst_score": F.col("ns") + 1.0, "isolation_rate": F.col("fo") / 10.0, "age_days": F.col("loc") * 3.0, "last_touch_days": F.col("days_since_last_change"), "convention_bug_fix_count": F.col("touch") % 3, "label": (F.col("cc") + F.col("nd") >= 11).cast("double")})


@query()
def q_isolation_forest(spark, d):
    return R.anomaly_scores(_features(spark, d), R.COLD_FEATURES, "function_id").select("function_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@query()
def q_random_forest(spark, d):
    x = _features(spark, d)
    return R.ranked(x, R.fit_forest(x, R.FEATURES, "label"), R.FEATURES).select("function_id", F.round("score", 6).alias("score"))


@query()
def q_ridge(spark, d):
    x = _features(spark, d)
    return R.ranked(x, R.fit_ridge(x, R.FEATURES, "label"), R.FEATURES).select("function_id", F.round("score", 6).alias("score"))


@query()
def q_regime_screen(spark, d):
    return R.regime(_features(spark, d), R.FEATURES, "label", "function_id")


# Models ----------------------------------------------------------------------------------------------------------------------------

_MF = {
    "ms": "SELECT s_suppkey, 'M' || s_suppkey::VARCHAR AS model, CASE WHEN s_suppkey % 30 = 29 THEN 'g' || s_suppkey::VARCHAR ELSE 'f' || (s_suppkey // 3)::VARCHAR END AS model_file FROM supplier",
    "fs": "SELECT function_id, CASE WHEN o % 30 = 29 THEN 'g' || o::VARCHAR ELSE 'f' || (o // 3)::VARCHAR END AS file, CASE WHEN line % 5 < 3 AND o % 3 = 0 THEN 'M' || o::VARCHAR || '::go' WHEN line % 5 < 3 AND o % 3 = 1 THEN 'loadm' || o::VARCHAR || 'm' || (o + 1)::VARCHAR || '_x' ELSE 'other' || line::VARCHAR END AS name, line, lrs AS score, band FROM (SELECT *, line // 20 AS o FROM v_scored)",
    "ru": "SELECT *, CASE WHEN starts_with(name, model || '::') THEN 1 WHEN contains(lower(name), lower(model)) THEN 2 WHEN n <= 1 THEN 3 END AS rule FROM (SELECT *, count(*) OVER (PARTITION BY model_file) AS n FROM ms) JOIN fs ON model_file = file",
    "assoc": "SELECT * FROM (SELECT *, min(rule) OVER (PARTITION BY model) AS best FROM ru WHERE rule IS NOT NULL) WHERE rule = best",
}


def _assoc(spark, d):
    """Every supplier is a model, three to a file and some alone in theirs; its functions are twenty parts."""
    c, text = F.col, lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    file = lambda o: F.when(o % 30 == 29, text("g", o)).otherwise(text("f", F.floor(o / 3)))
    ms = V.table(spark, d, "supplier").select(text("M", c("s_suppkey")).alias("model"), file(c("s_suppkey")).alias("file"), c("s_suppkey").alias("line"))
    o = F.floor(c("line") / 20)
    name = F.when((c("line") % 5 < 3) & (o % 3 == 0), F.concat(text("M", o), F.lit("::go"))).when((c("line") % 5 < 3) & (o % 3 == 1), F.concat(text("loadm", o), text("m", o + 1), F.lit("_x"))).otherwise(text("other", c("line")))
    fs = S.scored(V.fn(spark, d)).select("function_id", file(o).alias("file"), name.alias("name"), "line", c("lrs").alias("score"), "band")
    return M.associations(ms, fs)


_COUNTS = ", ".join(f"count(*) FILTER (WHERE band = '{b}') AS {b}" for b in ("critical", "high", "moderate", "low"))


@query(with_views(f"SELECT model, round(sum(score) FILTER (WHERE r <= 5), 6) AS score, count(*) AS functions, {_COUNTS} FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, file, line, name) AS r FROM assoc) GROUP BY model HAVING count(*) >= 2", "v_scored", also=_MF))
def q_model_risk_map(spark, d):
    return M.risk_map(_assoc(spark, d)).select("model", *r6("score"), "functions", "critical", "high", "moderate", "low")


@query(with_views("SELECT CASE WHEN (a.model_file, a.s_suppkey) < (b.model_file, b.s_suppkey) THEN a.model ELSE b.model END AS source, CASE WHEN (a.model_file, a.s_suppkey) < (b.model_file, b.s_suppkey) THEN b.model ELSE a.model END AS target, count(*) AS shared_functions, round(sum(greatest(a.score, b.score)), 6) AS shared_risk FROM assoc a JOIN assoc b ON a.function_id = b.function_id AND a.s_suppkey < b.s_suppkey GROUP BY 1, 2", "v_scored", also=_MF))
def q_model_links(spark, d):
    return M.links(_assoc(spark, d)).select("source", "target", "shared_functions", *r6("shared_risk"))


# Text and paths --------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, array_to_string((list_concat(regexp_extract_all(m, '([A-Z]+-[0-9]+)', 1), ['#' || x for x in regexp_extract_all(m, '#([0-9]+)', 1)])), ',') AS tickets FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ABC-' || doc_id::VARCHAR || ' fixes #' || (doc_id % 7)::VARCHAR WHEN doc_id % 3 = 1 THEN 'see #' || (doc_id % 11)::VARCHAR ELSE 'no ticket' END AS m FROM documents)")
def q_ticket_ids(spark, d):
    i = F.col("doc_id")
    m = F.when(i % 3 == 0, F.concat(F.lit("ABC-"), i.cast("string"), F.lit(" fixes #"), (i % 7).cast("string"))).when(i % 3 == 1, F.concat(F.lit("see #"), (i % 11).cast("string"))).otherwise("no ticket")
    return V.table(spark, d, "documents").select("doc_id", F.array_join(S.ticket_ids(m), ",").alias("tickets"))


@query("SELECT doc_id, len([l for l in string_split(text, chr(10)) if length(l) > 1000]) >= 3 AS minified FROM documents")
def q_long_line_guard(spark, d):
    from ..sources.files import is_minified

    return V.table(spark, d, "documents").select("doc_id", is_minified(F.col("text")).alias("minified"))


@query("SELECT doc_id, len(list_distinct([t for t in regexp_split_to_array(text, '[^A-Za-z0-9_$]+') if t <> '']))::BIGINT AS tokens FROM documents")
def q_source_tokens(spark, d):
    from ..sources.files import source_tokens

    return V.table(spark, d, "documents").select("doc_id", F.size(source_tokens(F.col("text"))).cast("long").alias("tokens"))


_SRC = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '// risk-ignore: reason ' || doc_id::VARCHAR WHEN 1 THEN '// risk-ignore' WHEN 2 THEN '  // risk-ignored' ELSE '// other' END AS before FROM documents"""


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'reason ' || doc_id::VARCHAR WHEN 1 THEN '' WHEN 2 THEN '' END AS suppression_reason FROM ({_SRC})")
def q_suppression(spark, d):
    from ..sources.files import suppression

    i = F.col("doc_id")
    before = F.when(i % 4 == 0, F.concat(F.lit("// risk-ignore: reason "), i.cast("string"))).when(i % 4 == 1, "// risk-ignore").when(i % 4 == 2, "  // risk-ignored").otherwise("// other")
    text = F.concat(F.lit("import x\n"), before, F.lit("\nfunction f() {}\n"))
    return V.table(spark, d, "documents").select("doc_id", suppression(text, F.lit(3)).alias("suppression_reason"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'M' || doc_id::VARCHAR WHEN 1 THEN 'A' || doc_id::VARCHAR || ',B' || doc_id::VARCHAR ELSE '' END AS models, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END::INT AS line FROM documents")
def q_model_decls(spark, d):
    from ..sources.files import line_of, model_names

    i = F.col("doc_id")
    n = i.cast("string")
    x = V.table(spark, d, "documents").select("doc_id", F.when(i % 3 == 0, "Python").when(i % 3 == 1, "TypeScript").otherwise("Go").alias("lang"), F.when(i % 3 == 0, F.concat(F.lit("import x\nclass M"), n, F.lit("(Base):\n"))).when(i % 3 == 1, F.concat(F.lit("export interface A"), n, F.lit(" {}\nexport class B"), n, F.lit(" {}\n"))).otherwise("type lower struct {}\n").alias("t"))
    names = model_names(F.col("t"), F.col("lang"))
    return x.select("doc_id", F.array_join(names, ",").alias("models"), line_of(F.col("t"), F.get(names, F.lit(0))).alias("line"))


@query(with_views("SELECT 'risk-' || band AS rule_id, CASE band WHEN 'critical' THEN 'error' WHEN 'high' THEN 'warning' ELSE 'note' END AS level, file AS uri, line, function_id FROM v_scored WHERE band <> 'low'", "v_scored").replace(", function_id FROM v_scored", " FROM v_scored"))
def q_sarif(spark, d):
    from .sinks import sarif_results

    return sarif_results(S.scored(V.fn(spark, d))).select("rule_id", "level", "uri", "line")


@query()
def q_jsonl(spark, d):
    from .sinks import snapshot_jsonl

    return snapshot_jsonl(S.scored(V.fn(spark, d)), {"sha": "head", "ts": AS_OF})


@query(with_views("SELECT count(*) AS total, count(*) FILTER (WHERE quadrant = 'fire') AS fire, count(*) FILTER (WHERE quadrant = 'debt') AS debt, count(*) FILTER (WHERE band IN ('high', 'critical')) AS high_plus FROM quads", "v_full", also={"thresholds": THRESHOLDS, "driven": DRIVER, "quads": QUADS}))
def q_summary_cards(spark, d):
    from .sinks import summary_cards

    return summary_cards(_quads(spark, d))


@query(with_views("SELECT function_id, round(lrs, 6) AS x, coalesce(touch_count_30d, churn_lines, 0)::DOUBLE AS y, upper(band[1]) AS band FROM v_full", "v_full"))
def q_scatter(spark, d):
    from .sinks import scatter_rows

    return scatter_rows(V.enriched(spark, d)).select("function_id", *r6("x"), "y", "band")


@query(with_views("SELECT k, count(*) AS functions, round(sum(lrs), 6) AS total_risk, count(*) FILTER (WHERE lrs >= 9) AS critical, count(*) FILTER (WHERE lrs >= 6 AND lrs < 9) AS high, count(*) FILTER (WHERE lrs >= 3 AND lrs < 6) AS moderate, count(*) FILTER (WHERE lrs < 3) AS low FROM v_snap WHERE k IN (SELECT k FROM (SELECT DISTINCT k FROM v_snap ORDER BY k DESC LIMIT 5)) GROUP BY k", "v_snap"))
def q_history_rows(spark, d):
    from .sinks import history_rows

    s = V.snapshots(spark, d)
    return history_rows(s.withColumn("band", S.band(F.col("lrs"))), 5).select("k", "functions", *r6("total_risk"), "critical", "high", "moderate", "low")


@query()
def q_extract(spark, d):
    """Functions of small generated sources in five languages, one for each document id."""
    from ..operators.extract import reports

    i = F.col("doc_id")
    n = i.cast("string")
    py = F.concat(F.lit("def f"), n, F.lit("(x):\n    for a in x:\n        if a and g(a):\n            return a\n"))
    brace = lambda head: F.concat(F.lit(head), n, F.lit("(x) {\n  while (x) { if (x && g(x)) { return x; } }\n}\n"))
    x = V.table(spark, d, "documents").select(F.concat(F.lit("src/d"), n).alias("path"), F.element_at(F.array(*map(F.lit, ["Python", "JavaScript", "C"])), (i % 3 + 1).cast("int")).alias("language"), F.when(i % 3 == 0, py).when(i % 3 == 1, brace("function f")).otherwise(brace("int f")).alias("text"))
    return reports(x).select("function_id", "language", "line", "cc", "nd", "fo", "ns", "loc", F.round("lrs", 6).alias("lrs"), "band")
