"""Scores, bands, labels and patterns of functions, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Patterns, Scoring, Thresholds, Weights

BANDS = ["low", "moderate", "high", "critical"]


def half_up(x: Column, digits: int) -> Column:
    """x to some decimal places, halves upwards on the binary product."""
    p = float(10**digits)
    return F.floor(x * p + 0.5) / p


def risk_components(df: DataFrame) -> DataFrame:
    """df (cc, nd, fo, ns) with r_cc, r_nd, r_fo, r_ns."""
    capped_log = lambda c: F.least(F.log2(F.col(c) + 1.0), F.lit(6.0))
    return df.withColumns({"r_cc": capped_log("cc"), "r_nd": F.least(F.col("nd").cast("double"), F.lit(8.0)), "r_fo": capped_log("fo"), "r_ns": F.least(F.col("ns").cast("double"), F.lit(6.0))})


def lrs(w: Weights = Weights()) -> Column:
    return F.col("r_cc") * w.cc + F.col("r_nd") * w.nd + F.col("r_fo") * w.fo + F.col("r_ns") * w.ns


def band(score: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(score < t.moderate, "low").when(score < t.high, "moderate").when(score < t.critical, "high").otherwise("critical")


def band_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BANDS)), name)


def scored(df: DataFrame, config: Config = Config()) -> DataFrame:
    """df (cc, nd, fo, ns) with the components, lrs and band; rows below min_lrs are dropped."""
    out = risk_components(df).withColumn("lrs", lrs(config.weights)).withColumn("band", band(F.col("lrs"), config.thresholds))
    return out if config.min_lrs is None else out.filter(F.col("lrs") >= config.min_lrs)


def risk_factors(df: DataFrame, s: Scoring = Scoring()) -> DataFrame:
    """df with f_churn .. f_neighbor and the raw sum ``risk_sum``. Inputs (NULL counts as none): lines_added, lines_deleted, touch_count_30d, days_since_last_change, fan_in, scc_size, dependency_depth, neighbor_churn, lrs."""
    none = lambda x: F.coalesce(x, F.lit(0.0))
    capped = lambda x, most: F.when(x.isNotNull(), F.least(x, F.lit(most)))  # noqa: E731  (least alone passes over NULLs)
    c = F.col
    parts = {
        "f_churn": none((c("lines_added") + c("lines_deleted")) / 100.0 * s.churn),
        "f_activity": none(capped(c("touch_count_30d") / 10.0, 5.0) * s.touch),
        "f_recency": none(F.greatest(5.0 - c("days_since_last_change") / 7.0, F.lit(0.0)) * s.recency),
        "f_fan_in": none(capped(c("fan_in") / 5.0, 10.0) * s.fan_in),
        "f_cycle": none(F.when(c("scc_size") > 1, c("scc_size") * s.scc)),
        "f_depth": none(capped(c("dependency_depth") / 3.0, 5.0) * s.depth),
        "f_neighbor": none(c("neighbor_churn") / 500.0 * s.neighbor_churn),
    }
    total = c("lrs")
    for p in parts:
        total = total + c(p)
    return df.withColumns(parts).withColumn("risk_sum", total)


def with_activity_risk(df: DataFrame, s: Scoring = Scoring()) -> DataFrame:
    """risk_factors() and activity_risk, which stays NULL unless it exceeds lrs or there is churn."""
    return risk_factors(df, s).withColumn("activity_risk", F.when((F.col("risk_sum") > F.col("lrs")) | (F.col("f_churn") > 0), F.col("risk_sum")))


def rank_score() -> Column:
    """What rankings go by."""
    return F.coalesce(F.col("activity_risk"), F.col("lrs"))


def function_id(file: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(file, "\\\\", "/"), F.lit("::"), name)


def is_entry_point(fid: Column) -> Column:
    name = F.lower(F.element_at(F.split(fid, "::"), -1))
    return name.isin("main", "start", "init", "initialize", "run", "execute", "bootstrap") | name.rlike("handle|onrequest|onmessage|onevent|middleware|controller")


def is_fix(message: Column) -> Column:
    return F.lower(message).rlike("fix|bug")


def is_fix_subject(message: Column) -> Column:
    """The wider notion of a fix that labels and coupling use."""
    return F.lower(message).rlike("fix|bug|patch|regression|defect")


def is_revert(message: Column) -> Column:
    return F.contains(F.lower(message), F.lit("revert"))


def ticket_ids(message: Column, branch: Column | None = None) -> Column:
    """PROJECT-123 then #123, of the message and then the branch, each once."""
    parts = []
    for text in [message] + ([branch] if branch is not None else []):
        text = F.coalesce(text, F.lit(""))
        parts.append(F.regexp_extract_all(text, F.lit("([A-Z]+-[0-9]+)"), 1))
        parts.append(F.transform(F.regexp_extract_all(text, F.lit("#([0-9]+)"), 1), lambda x: F.concat(F.lit("#"), x)))
    return F.array_distinct(F.concat(*parts))


DRIVERS = ["cyclic_dep", "high_complexity", "high_churn_low_cc", "high_fanout_churning", "deep_nesting", "high_fanin_complex"]


def driver(df: DataFrame) -> DataFrame:
    """df with ``driver``; needs cc, nd, fan_in, fan_out, touch, scc_size and the columns of dimension_thresholds()."""
    c = F.col
    label = (
        F.when(c("scc_size") > 1, "cyclic_dep")
        .when(c("cc") > c("cc_high"), "high_complexity")
        .when((c("touch") > c("touch_high")) & (c("cc") < c("cc_low")), "high_churn_low_cc")
        .when((c("fan_out") > c("fan_out_high")) & (c("touch") > c("touch_med")), "high_fanout_churning")
        .when(c("nd") > c("nd_high"), "deep_nesting")
        .when((c("fan_in") > c("fan_in_high")) & (c("cc") > c("cc_med")), "high_fanin_complex")
        .otherwise("composite")
    )
    return df.withColumn("driver", label)


def normalized_driver(label: Column) -> Column:
    return F.when(label.isin(*DRIVERS), label).otherwise("composite")


def near_miss(df: DataFrame, dims: tuple[str, ...] = ("cc", "nd", "fan_out", "fan_in", "touch")) -> DataFrame:
    """df (driver, dims) with ``driver_detail``: for composite rows the three highest percentile ranks from 40 up, as "cc (P72), nd (P68)".

    The share of rows that are strictly less comes from a histogram of each dimension's values, so no row is sorted against all others.
    """
    total = df.agg(F.count("*").alias("_n"))
    out = df.crossJoin(F.broadcast(total))
    for d in dims:
        hist = df.groupBy(F.col(d).alias("_v")).agg(F.count("*").alias("_c"))
        below = hist.select("_v", F.coalesce(F.sum("_c").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{d}"))
        out = out.join(below, F.col(d) == F.col("_v")).drop("_v")
    pairs = F.array(*[F.struct(F.floor(F.col(f"_b_{d}") * 100 / F.col("_n")).cast("int").alias("p"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(dims)])
    best = F.slice(F.sort_array(F.filter(pairs, lambda x: x["p"] >= 40), asc=False), 1, 3)
    text = F.array_join(F.transform(best, lambda x: F.concat(x["d"], F.lit(" (P"), x["p"].cast("string"), F.lit(")"))), ", ")
    return out.withColumn("driver_detail", F.when((F.col("driver") == "composite") & (F.size(best) > 0), text)).drop("_n", *[f"_b_{d}" for d in dims])


def quadrant(touch: Column, days: Column, touch_med: Column, band_name: Column, ranker_score: Column | None = None) -> Column:
    active = F.coalesce(touch > touch_med, F.lit(False)) | F.coalesce(days <= 30, F.lit(False))
    if ranker_score is not None:
        active = active | F.coalesce(ranker_score >= 0.7, F.lit(False))
    risky = band_name.isin("high", "critical")
    return F.when(risky & active, "fire").when(risky, "debt").when(active, "watch").otherwise("ok")


ACTIONS = {
    ("cyclic_dep", "fire"): "Break the cycle now: it is being changed",
    ("cyclic_dep", None): "Resolve the dependency cycle",
    ("high_complexity", "fire"): "Extract functions now: it is being changed",
    ("high_complexity", "debt"): "Plan a reduction of its branches; it is stable",
    ("high_complexity", None): "Reduce its branches",
    ("high_churn_low_cc", "fire"): "Add tests now: it churns without any",
    ("high_churn_low_cc", None): "Add tests before the next change",
    ("high_fanout_churning", "fire"): "Extract an interface: coupled and being changed",
    ("high_fanout_churning", None): "Consider an interface boundary",
    ("deep_nesting", "fire"): "Flatten it before the next change",
    ("deep_nesting", "debt"): "Plan to flatten it; it is quiet now",
    ("deep_nesting", None): "Flatten its nesting",
    ("high_fanin_complex", "fire"): "Stabilize its interface: many callers, being changed",
    ("high_fanin_complex", None): "Stabilize its interface: many callers",
    (None, "fire"): "Risky and active: plan a refactoring soon",
    (None, None): "Watch its trend before the next change",
}


def driver_action(label: Column, quad: Column) -> Column:
    """The recommended action: the most specific entry of ACTIONS."""
    out = None
    for (d, q), text in sorted(ACTIONS.items(), key=lambda x: (x[0][0] is None, x[0][1] is None)):
        test = (label == d if d else F.lit(True)) & (quad == q if q else F.lit(True))
        out = F.when(test, text) if out is None else out.when(test, text)
    return out


def pattern_details(p: Patterns = Patterns()) -> Column:
    """ARRAY<STRUCT<id, tier, kind, triggered_by>> of a row's patterns. A NULL input keeps a pattern from firing.

    Needs cc, nd, fo, ns, loc, and for the second tier fan_in, scc_size, churn_lines, neighbor_churn, days_since_last_change, is_entrypoint.
    """
    c = F.col

    def trig(metric: str, op: str, bound: int) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.lit(op).alias("op"), c(metric).cast("long").alias("value"), F.lit(bound).cast("long").alias("threshold"))

    def one(name: str, tier: int, *tests: tuple[str, str, int], also: Column | None = None, kind: str = "primitive") -> Column:
        ok = also if also is not None else F.lit(True)
        for m, op, b in tests:
            ok = ok & ((c(m) >= b) if op == ">=" else (c(m) <= b))
        made = F.struct(F.lit(name).alias("id"), F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), F.array(*[trig(*t) for t in tests]).alias("triggered_by"))
        return F.when(ok, made)

    god = [("loc", ">=", p.god_function_loc), ("fo", ">=", p.god_function_fo)]
    magnet = [("churn_lines", ">=", p.churn_magnet_churn), ("cc", ">=", p.churn_magnet_cc)]
    inner = ~F.coalesce(c("is_entrypoint"), F.lit(False))
    found = [
        one("complex_branching", 1, ("cc", ">=", p.complex_branching_cc), ("nd", ">=", p.complex_branching_nd)),
        one("deeply_nested", 1, ("nd", ">=", p.deeply_nested_nd)),
        one("exit_heavy", 1, ("ns", ">=", p.exit_heavy_ns)),
        one("god_function", 1, *god),
        one("long_function", 1, ("loc", ">=", p.long_function_loc)),
        one("churn_magnet", 2, *magnet),
        one("cyclic_hub", 2, ("scc_size", ">=", p.cyclic_hub_scc), ("fan_in", ">=", p.cyclic_hub_fan_in)),
        one("hub_function", 2, ("fan_in", ">=", p.hub_function_fan_in), ("cc", ">=", p.hub_function_cc)),
        one("middle_man", 2, ("fan_in", ">=", p.middle_man_fan_in), ("fo", ">=", p.middle_man_fo), ("cc", "<=", p.middle_man_cc_max), also=inner),
        one("neighbor_risk", 2, ("neighbor_churn", ">=", p.neighbor_risk_churn), ("fo", ">=", p.neighbor_risk_fo), also=inner),
        one("shotgun_target", 2, ("fan_in", ">=", p.shotgun_target_fan_in), ("churn_lines", ">=", p.shotgun_target_churn)),
        one("stale_complex", 2, ("cc", ">=", p.stale_complex_cc), ("loc", ">=", p.stale_complex_loc), ("days_since_last_change", ">=", p.stale_complex_days)),
        one("volatile_god", 2, *god, *magnet, kind="derived"),
    ]
    return F.array_compact(F.array(*found))


def pattern_ids(details: Column) -> Column:
    return F.transform(details, lambda d: d["id"])


PHRASES = {
    "total_churn": "much churn over its life",
    "lrs": "complex in structure",
    "fan_in": "called from many places",
    "authors_90d": "without one steady owner lately",
    "directed_coupling": "often changed together with risky files",
    "cc": "many branches",
    "nd": "deep nesting",
}
PAIRS = {
    ("total_churn", "fan_in"): "churns much and carries many callers",
    ("total_churn", "authors_90d"): "churns much without one steady owner lately",
    ("lrs", "fan_in"): "complex in structure and called from many places",
    ("lrs", "total_churn"): "complex and often changed",
    ("authors_90d", "fan_in"): "without one steady owner lately and called from many places",
    ("directed_coupling", "total_churn"): "changed often, together with risky files",
}


def explanation(n: int = 3, elevated: float = 0.8) -> Column:
    """A sentence of the features whose percentile (columns p_<feature>) is elevated: the pair phrase of the top two, else up to n phrases, else the top feature's."""
    order = list(PHRASES)
    items = F.array(*[F.struct(F.col(f"p_{x}").cast("double").alias("p"), F.lit(-i).alias("o"), F.lit(x).alias("f")) for i, x in enumerate(order)])
    ranked = F.sort_array(items, asc=False)
    up = F.filter(ranked, lambda x: x["p"] >= elevated)
    single = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    both = F.create_map(*[F.lit(x) for (a, b), text in PAIRS.items() for k in (f"{a}|{b}", f"{b}|{a}") for x in (k, text)])
    size = F.size(up)
    pair = F.when(size >= 2, F.try_element_at(both, F.concat(F.get(up, F.lit(0))["f"], F.lit("|"), F.get(up, F.lit(1))["f"])))
    names = F.transform(F.slice(F.when(size > 0, up).otherwise(F.slice(ranked, 1, 1)), 1, max(n, 1)), lambda x: F.element_at(single, x["f"]))
    k = F.size(names)
    joined = F.when(k == 1, names[0]).when(k == 2, F.concat(names[0], F.lit(" and "), names[1])).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), k - 1), ", "), F.lit(", and "), F.element_at(names, -1)))
    text = F.coalesce(pair, joined)
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)), F.lit("."))
