import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import aggregates as A
from riskloom.operators import coupling as C
from riskloom.operators import delta as D
from riskloom.operators import history as H
from riskloom.operators import joins as J
from riskloom.operators import models as M
from riskloom.operators import policy as P
from riskloom.operators import ranking as R
from riskloom.operators import trends as T

DAY = 86400
LOG = "sha long, ts long, author string, file string, lines_added long, lines_deleted long, is_fix boolean"


def log(spark, rows):
    return spark.createDataFrame([(*r, *(1, 1, False)[len(r) - 4 :]) for r in rows], LOG)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_burst(spark):
    x = log(spark, [(1, 0, "a", "f"), (2, 10 * DAY, "a", "f"), (3, 100 * DAY, "a", "f"), (4, 5, "a", "g"), (5, 7, "a", "h"), (6, 7, "a", "h")])
    got = dict(rows(H.burst_scores(x), "file", "burst_score"))
    assert got["f"] == pytest.approx(1.5) and got["g"] == 1.0 and got["h"] == pytest.approx(2 / 1.5)


def test_history_signals(spark):
    x = log(spark, [(1, 0, "a", "f"), (2, 0, "a", "f"), (3, DAY, "b", "f"), (4, 2 * DAY, "b", "f"), (4, 2 * DAY, "b", "g")])
    r = H.history_signals(x, 3 * DAY).filter("file = 'f'").first()
    assert (r["commit_count"], r["author_count"], r["author_entropy"], r["isolation_rate"], r["age_days"], r["last_touch_days"]) == (4, 2, 1.0, 0.75, 2.0, 1.0)


def test_touches_and_branch(spark):
    x = log(spark, [(1, 0, "a", "f"), (2, 80 * DAY, "a", "f"), (3, 0, "a", "g"), (4, 200 * DAY, "a", "g")])
    assert rows(H.touch_metrics(x, 90 * DAY), "file", "touch_count_30d", "days_since_last_change") == [("f", 1, 10), ("g", 0, 90)]
    now, base = H.touch_metrics(x, 90 * DAY), H.touch_metrics(x, 70 * DAY)
    assert rows(H.branch_recency(now, base, 20), "file", "days_since_last_change") == [("f", 70), ("g", 90)]
    assert rows(H.stale_files(x, 90 * DAY), "file") == [("g",)]


def test_co_change(spark):
    x = log(spark, [(i, i, "a", f) for i in range(4) for f in ("p", "q")] + [(9, 9, "a", "q"), (10, 9, "a", "x/a.rs"), (10, 9, "a", "x/a_test.rs")] + [(50, 50, "a", f"m{i}") for i in range(201)])
    assert rows(C.co_change(x, 1), "file_a", "file_b", "co_change_count", "coupling_ratio", "risk") == [("p", "q", 4, 1.0, "high")]
    deps = spark.createDataFrame([("q", "p")], "src_file string, dst_file string")
    assert rows(C.with_static_deps(C.co_change(x, 1), deps), "risk", "has_static_dep") == [("expected", True)]
    ratio = log(spark, [(i, i, "a", "a") for i in range(4)] + [(i, i, "a", "b") for i in range(1, 11)])
    assert rows(C.co_change(ratio, 3), "coupling_ratio", "risk") == [(0.75, "high")]


def test_directed_coupling(spark):
    x = log(spark, [(i, i, "a", f) for i in range(10) for f in ("p", "q")])
    s = spark.createDataFrame([("p", 2.0), ("q", -1.0)], "file string, score double")
    assert rows(C.directed_coupling(x, s), "file", "directed_coupling") == [("p", 0.0), ("q", 2.0)]


def test_asof(spark):
    h = spark.createDataFrame([("f", 5), ("f", 10), ("f", 99), ("g", 1)], "file string, old_start long")
    s = spark.createDataFrame([("f", "a", 5), ("f", "b", 20)], "file string, function_id string, start_line long")
    assert sorted(map(str, rows(J.nearest_function(h, s), "old_start", "function_id"))) == sorted(map(str, [(5, "a"), (10, "a"), (99, "b"), (1, None)]))


def most_rows(df):
    """The most rows that any step of the collected plan gave out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
    return most


def test_interval_touches_joins_places(spark):
    h = spark.range(400).select(F.col("id").alias("sha"), F.lit("f").alias("file"), F.col("id").alias("ts"), F.lit(5).alias("start"), F.lit(3).alias("length"))
    s = spark.range(400).select(F.col("id").alias("function_id"), F.lit("f").alias("file"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    out = J.interval_touches(h, s)
    assert most_rows(out) <= 800 and {tuple(r)[1:] for r in out.collect()} == {(400, 399)}


def test_interval_touches_counts_commits_once(spark):
    import random

    r = random.Random(7)
    hunks = [(r.choice([*range(12), None]), r.choice("ab"), r.randrange(99), r.randrange(1, 400), r.choice([0, 1, 3, 90, None])) for _ in range(150)]
    spans = [(f"f{i if i < 50 else i - 30}", r.choice("ab"), a := r.randrange(1, 400), a + r.choice([-4, 0, 5, 40, 200])) for i in range(60)]
    want = {}
    for f, file, a, b in spans:
        for sha, other, ts, start, length in hunks:
            if file == other and start <= b and a <= start + max(length or 1, 1) - 1:
                want.setdefault(f, []).append((sha, ts))
    h = spark.createDataFrame(hunks, "sha long, file string, ts long, start long, length long")
    s = spark.createDataFrame(spans, "function_id string, file string, start_line long, end_line long")
    assert {x[0]: tuple(x)[1:] for x in J.interval_touches(h, s).collect()} == {f: (len({a for a, _ in x} - {None}), max(b for _, b in x)) for f, x in want.items()}


def test_interval_touches(spark):
    s = spark.createDataFrame([("f", "a", 1, 200), ("f", "b", 201, 210)], "file string, function_id string, start_line long, end_line long")
    h = spark.createDataFrame([(1, "f", 1, 60, 10), (2, "f", 2, 195, 10), (3, "f", 3, 400, 1), (4, "f", 4, 128, 0)], "sha long, file string, ts long, start long, length long")
    assert rows(J.interval_touches(h, s), "function_id", "touches", "last_ts") == [("a", 3, 4), ("b", 1, 2)]


def test_callees(spark):
    calls = spark.createDataFrame([("f::a", "f", "b"), ("f::a", "f", "c"), ("f::a", "f", "a"), ("f::a", "f", "d")], "caller string, caller_file string, name string")
    fns = spark.createDataFrame([("f::b", "f", "b", 9), ("e::b", "e", "b", 1), ("e::c", "e", "c", 1), ("i::c", "i", "c", 5), ("f::a", "f", "a", 1), ("z::d", "z", "d", 3), ("y::d", "y", "d", 2)], "function_id string, file string, name string, ord long")
    imports = spark.createDataFrame([("f", "i")], "src_file string, dst_file string")
    assert rows(J.resolve_callees(calls, fns, imports), "src", "dst") == [("f::a", "f::b"), ("f::a", "i::c"), ("f::a", "y::d")]


def test_subsystem_and_rollup(spark):
    f = spark.createDataFrame([("a/b/c.ts",), ("a/d.ts",), ("/abs/x.ts",), ("top.ts",)], "file string")
    m = spark.createDataFrame([("a",), ("a/b",)], "directory string")
    assert {r["file"]: r["subsystem"] for r in J.subsystem(f, m).collect()} == {"a/b/c.ts": "a/b", "a/d.ts": "a", "/abs/x.ts": None, "top.ts": None}
    agg = f.filter("file like 'a/%'").withColumns({"sum_lrs": F.lit(1.0), "max_lrs": F.lit(1.0), "high_plus_count": F.lit(1)})
    assert rows(A.directory_rollup(agg), "directory", "sum_lrs") == [(".", 2.0), ("a", 2.0), ("a/b", 1.0)]


def test_instability(spark):
    f = spark.createDataFrame([("m/a", 11), ("n/b", 1), ("o/c", 1)], "file string, cc long")
    e = spark.createDataFrame([("m/a", "n/b"), ("n/b", "m/a"), ("o/c", "m/a"), ("n/b", "m/z")], "src_file string, dst_file string")
    assert rows(A.module_instability(f, e), "module", "efferent", "afferent", "instability", "module_risk") == [("m", 1, 3, 0.25, "high"), ("n", 2, 1, 0.667, "low"), ("o", 1, 0, 1.0, "low")]


SNAP = "function_id string, file string, line long, cc long, nd long, fo long, ns long, lrs double, band string, suppression_reason string"


def snap(spark, items):
    from riskloom.functions.scoring import band

    df = spark.createDataFrame([(i, i.split("::")[0], line, 1, 0, 0, 0, lrs, None, why) for i, line, lrs, why in items], SNAP)
    return df.withColumn("band", band(F.col("lrs")))


def test_delta_and_policies(spark):
    b = snap(spark, [("x::same", 1, 2.0, None), ("x::up", 2, 4.0, None), ("x::gone", 3, 5.0, None), ("x::crit", 4, 8.0, None), ("x::quiet", 5, 1.0, "legacy")])
    a = snap(spark, [("x::same", 9, 2.0, None), ("x::up", 2, 6.0, None), ("x::new", 3, 2.7, None), ("x::crit", 4, 9.5, None), ("x::quiet", 5, 9.9, "")])
    d = D.deltas(b, a)
    assert rows(d, "function_id", "status") == [("x::crit", "modified"), ("x::gone", "deleted"), ("x::new", "new"), ("x::quiet", "modified"), ("x::same", "unchanged"), ("x::up", "modified")]
    got = P.order_by(P.evaluate(d, b, a)).collect()
    assert [(r["id"], r["function_id"]) for r in got] == [
        ("critical-introduction", "x::crit"), ("excessive-risk-regression", "x::crit"), ("excessive-risk-regression", "x::up"), ("watch-threshold", "x::new"),
        ("rapid-growth", "x::up"), ("suppression-missing-reason", "x::quiet"), ("net-repo-regression", None),
    ]
    assert next(r for r in got if r["id"] == "rapid-growth")["growth_percent"] == pytest.approx(50.0)
    assert P.has_blocking(P.evaluate(d, b, a)) and P.evaluate(D.deltas(None, a), None, a).count() == 0
    assert rows(D.deltas(None, a), "status") == [("new",)] * 5
    assert rows(D.apply_storage_delta(b, D.storage_delta(b, a)), "function_id", "lrs", "line") == rows(a, "function_id", "lrs", "line")


def test_rename_hints_makes_no_pairs(spark):
    side = lambda x: spark.range(300).select(F.format_string(f"f::{x}%03d", "id").alias("function_id"), F.lit("f").alias("file"), F.lit(5).alias("line"))
    out = D.rename_hints(side("a"), side("b"))
    assert most_rows(out) <= 600 and sorted(map(tuple, out.collect())) == [(f"f::a{i:03}", f"f::b{i:03}") for i in range(300)]


def test_rename_hints_as_walked_over_pairs(spark):
    import random

    r = random.Random(3)

    def side():
        # Names come again in other files, functions at other lines; some have no line, some ids don't begin with their file.
        some = [(r.choice("pqrstu"), f"n{r.randrange(40)}", r.choice([*range(1, 300, 7), None])) for _ in range(90)]
        return [(name if r.random() < 0.1 else f"{file}::{name}", file, line) for file, name, line in some]

    before, after = side(), side()
    name = lambda x: x[0].removeprefix(x[1] + "::")
    gone, made = [x for x in before if x[0] not in {y[0] for y in after}], [x for x in after if x[0] not in {y[0] for y in before}]
    pairs = {(a[0], b[0]) for a in gone for b in made if (name(a) == name(b) and a[1] != b[1]) or (a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 10)}
    want = {}
    for a, b in sorted(pairs):
        if a not in want and b not in want.values():
            want[a] = b
    kind = "function_id string, file string, line long"
    assert len(want) > 20 and dict(map(tuple, D.rename_hints(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind)).collect())) == want


def test_rename_hints(spark):
    b = snap(spark, [("x.ts::f", 1, 2.0, None), ("y.ts::g", 10, 2.0, None), ("y.ts::h", 15, 2.0, None)])
    a = snap(spark, [("z.ts::f", 1, 2.0, None), ("y.ts::i", 18, 2.0, None), ("y.ts::far", 90, 2.0, None)])
    assert rows(D.rename_hints(b, a), "function_id", "rename_hint") == [("x.ts::f", "z.ts::f"), ("y.ts::g", "y.ts::i")]


def series(spark, items):
    return spark.createDataFrame([(f, k, lrs, "high" if lrs >= 6 else "low") for f, s in items.items() for k, lrs in s], "function_id string, k long, lrs double, band string")


def test_trends(spark):
    s = series(spark, {"a": [(0, 1.0), (1, 3.0), (2, 5.0)], "b": [(0, 9.0), (1, 7.0), (2, 8.0)], "c": [(0, 4.0), (1, 2.0), (2, 0.5)], "d": [(1, 2.0)]})
    assert {r["function_id"]: (r["velocity"], r["direction"]) for r in T.velocities(s).collect()} == {"a": (2.0, "positive"), "b": (-0.5, "negative"), "c": (-1.75, "negative")}
    assert {r["function_id"]: (r["outcome"], r["sustained_commits"]) for r in T.refactorings(s).collect()} == {"b": ("partial", 2), "c": ("successful", 3)}
    assert rows(T.stability(s, 1), "function_id", "stability") == [("b", "stable")]


def test_compaction(spark):
    s = series(spark, {"a": [(0, 1.0), (1, 2.0), (2, 7.0), (3, 7.5), (4, 1.0), (5, 1.0)]})
    assert rows(T.compact_level2(s), "k") == [(0,), (2,), (4,), (5,)]
    index = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "sha string, ts long")
    assert rows(T.compact_level1(index, 1), "sha", "stored_as") == [("s0", "full"), ("s1", "delta"), ("s2", "delta"), ("s3", "delta"), ("s4", "full")]


def test_ranking_measures(spark):
    v = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (4.0,)], "v double")
    assert R.gini(v, "v").first()[0] == pytest.approx(0.75) and R.gini(v.limit(0), "v").first()[0] == 0.0
    assert R.normalizer(2) == pytest.approx(0.1544313298) and R.normalizer(1) == 0
    xy = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (3.0, 9.0)], "a double, b double")
    assert R.spearman(xy, "a", "b").first()[0] == pytest.approx(0.632455, abs=1e-5) and R.spearman(xy.withColumn("b", F.lit(1.0)), "a", "b").first()[0] == 0
    e = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (0.25,)], "p double").select(R.binary_entropy(F.col("p"))).collect()
    assert [r[0] for r in e] == pytest.approx([0, 1, 0, 0.811278], abs=1e-5)


def test_cold_start(spark):
    made = lambda xs: spark.createDataFrame([(x,) for x in xs], "commit_count long")
    assert R.cold_start_route(made([1] * 100)).first()["route"] == "uniform_prior"
    assert R.cold_start_route(made([100] * 20 + [1] * 80)).first()["route"] == "formula"
    assert R.cold_start_route(made([100] * 20 + [1] * 80), positives=15).first()["route"] == "anomaly"
    assert R.cold_start_route(made([5] * 30 + [1] * 70)).first()["route"] == "anomaly"
    assert R.cold_start_route(made([])).first()["route"] == "uniform_prior"


def test_isolation_forest_finds_the_outlier(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(300)] + [(999, 80.0, -70.0)], "id long, a double, b double")
    got = R.anomaly_scores(df, ["a", "b"], "id").orderBy(F.desc("anomaly_score")).first()
    assert got["id"] == 999 and 0.6 < got["anomaly_score"] < 1


def test_rankers_put_positives_first(spark):
    df = spark.createDataFrame([(f"f{i:03}", float(i % 20), float(i % 3), int(i % 20 > 15)) for i in range(200)], "function_id string, a double, b double, y int")
    for fit in (lambda: R.fit_forest(df, ["a", "b"], "y", trees=20), lambda: R.fit_ridge(df, ["a", "b"], "y")):
        top = R.ranked(df, fit(), ["a", "b"]).orderBy(F.desc("score")).limit(20).agg(F.avg("y")).first()[0]
        assert top > 0.9
    with pytest.raises(ValueError):
        R.train(df.limit(20), ["a"], "y", "function_id")


def test_models(spark):
    m = spark.createDataFrame([("User", "m.py", 1), ("Order", "m.py", 9), ("Solo", "s.py", 1)], "model string, file string, line long")
    f = spark.createDataFrame([("m.py::User::save", "m.py", "User::save", 2, 5.0, "high"), ("m.py::load_order", "m.py", "load_order", 3, 4.0, "low"), ("m.py::x", "m.py", "x", 4, 9.0, "critical"), ("s.py::p", "s.py", "p", 1, 1.0, "low"), ("s.py::q", "s.py", "q", 2, 2.0, "low"), ("u.py::use", "u.py", "use", 1, 3.0, "low")], "function_id string, file string, name string, line long, score double, band string")
    imports = spark.createDataFrame([("u.py", "m.py")], "src_file string, dst_file string")
    tokens = spark.createDataFrame([("u.py", "User"), ("u.py", "Order")], "file string, token string")
    a = M.associations(m, f, imports, tokens)
    assert rows(M.risk_map(a), "model", "score", "functions") == [("Order", 7.0, 2), ("Solo", 3.0, 2), ("User", 8.0, 2)]
    assert rows(M.links(a), "source", "target", "shared_functions", "shared_risk") == [("User", "Order", 1, 3.0)]


def test_summary(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 201)], "s double")
    r = A.summary(df, "s").first()
    assert r["total_functions"] == 200 and r["top_1_pct_share"] == pytest.approx(399 / 20100) and r["top_10_pct_share"] == pytest.approx(sum(range(181, 201)) / 20100)
    assert A.summary(df.limit(0), "s").first()["total_risk"] == 0 and math.isclose(A.summary(df.limit(3), "s").first()["top_1_pct_share"], 3 / 6)


def test_hidden_coupling_finds_pairs_without_an_import(spark):
    log = [(i, f) for i in range(4) for f in ("x/a.py", "x/b.py", "x/c.py")] + [(9, "x/c.py")]
    cf = spark.createDataFrame(log, "sha long, file string")
    deps = spark.createDataFrame([("x/b.py", "x/a.py")], "src_file string, dst_file string")
    out = C.hidden_coupling(C.with_static_deps(C.co_change(cf), deps))
    assert rows(out, "file_a", "file_b", "risk") == [("x/a.py", "x/c.py", "high"), ("x/b.py", "x/c.py", "high")]


def test_callees_of_a_common_name(spark):
    fns = spark.createDataFrame([(f"f{i}::get", f"f{i}", "get", i) for i in range(40)], "function_id string, file string, name string, ord long")
    calls = spark.createDataFrame([("f0::get", "f0x", "get"), ("f7::go", "f7", "get"), ("z::go", "z", "get"), ("y::go", "y", "get"), ("y::go", "y", "nothing")], "caller string, caller_file string, name string")
    imports = spark.createDataFrame([("y", "f9"), ("y", "f5")], "src_file string, dst_file string")
    want = [("f0::get", "f1::get"), ("f7::go", "f7::get"), ("y::go", "f5::get"), ("z::go", "f0::get")]
    assert rows(J.resolve_callees(calls, fns, imports), "src", "dst") == want
    assert rows(J.resolve_callees(calls, fns, imports, skip_self_candidate=False), "src", "dst") == want[1:]
