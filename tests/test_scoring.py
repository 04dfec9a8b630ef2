import pytest
from pyspark.sql import functions as F

from riskloom.config import Config
from riskloom.functions import scoring as S
from riskloom.operators import quantiles as Q


def fn(spark, rows):
    return spark.createDataFrame(rows, "cc long, nd long, fo long, ns long")


def test_lrs_and_cap(spark):
    got = [(round(r["lrs"], 6), r["band"]) for r in S.scored(fn(spark, [(1, 0, 0, 0), (63, 8, 63, 6), (1000, 99, 9999, 99)])).collect()]
    assert got == [(1.0, "low"), (20.2, "critical"), (20.2, "critical")]


def test_band_edges(spark):
    df = spark.createDataFrame([(2.999,), (3.0,), (6.0,), (9.0,)], "x double")
    assert [r[0] for r in df.select(S.band(F.col("x"))).collect()] == ["low", "moderate", "high", "critical"]


ACTIVITY = "lrs double, lines_added long, lines_deleted long, touch_count_30d long, days_since_last_change long, fan_in long, scc_size long, dependency_depth long, neighbor_churn long"


def test_activity_risk(spark):
    rows = [(10.0, 100, 100, 20, 7, 10, 3, 6, 500), (5.0, None, None, None, None, None, None, None, None), (5.0, 0, 0, 0, 99, 0, 1, 0, 0)]
    got = [r["activity_risk"] for r in S.with_activity_risk(spark.createDataFrame(rows, ACTIVITY)).collect()]
    assert got[0] == pytest.approx(14.5) and got[1:] == [None, None]


def test_index_quantile_and_flags(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "id long, s double")
    assert Q.index_quantiles(df, {"p": ("s", 90), "m": ("s", 50)}).first().asDict() == {"p": 9.0, "m": 5.0}
    flags = {r["id"]: (r["is_top_10_pct"], r["is_top_1_pct"]) for r in Q.percentile_flags(df, "s").collect()}
    assert flags[8] == (False, False) and flags[9] == (True, True) and flags[10] == (True, True)
    assert Q.index_quantiles(df.limit(0), {"p": ("s", 90)}).first()["p"] == 0


PATTERN = "cc long, nd long, fo long, ns long, loc long, fan_in long, scc_size long, churn_lines long, neighbor_churn long, days_since_last_change long, is_entrypoint boolean"


@pytest.mark.parametrize(
    ("row", "ids"),
    [
        ((10, 4, 0, 0, 5, None, None, None, None, None, None), ["complex_branching"]), ((9, 5, 0, 5, 5, None, None, None, None, None, None), ["deeply_nested", "exit_heavy"]),
        ((1, 0, 10, 0, 80, None, None, None, None, None, None), ["god_function", "long_function"]), ((8, 0, 10, 0, 60, 6, 2, 200, None, None, None), ["god_function", "churn_magnet", "cyclic_hub", "volatile_god"]),
        ((4, 0, 8, 0, 5, 8, 1, 0, 400, None, False), ["middle_man", "neighbor_risk"]), ((4, 0, 8, 0, 5, 8, 1, 150, 400, None, True), ["shotgun_target"]), ((10, 0, 0, 0, 60, 10, 1, 0, 0, 180, None), ["hub_function", "stale_complex"]),
        ((9, 3, 9, 4, 59, 5, 1, 149, 399, 179, None), []),
    ],
)
def test_patterns(spark, row, ids):
    df = spark.createDataFrame([row], PATTERN)
    assert df.select(S.pattern_ids(S.pattern_details())).first()[0] == ids


def test_texts(spark):
    df = spark.createDataFrame([("ABC-12 fixes #7, see ABC-12", "feature/XY-3"), ("Revert it", None)], "m string, b string")
    assert [r[0] for r in df.select(S.ticket_ids(F.col("m"), F.col("b"))).collect()] == [["ABC-12", "#7", "XY-3"], []]
    assert [tuple(r) for r in df.select(S.is_fix(F.col("m")), S.is_revert(F.col("m"))).collect()] == [(True, False), (False, True)]
    ids = spark.createDataFrame([("a::main",), ("a::onRequestX",), ("a::helper",)], "i string")
    assert [r[0] for r in ids.select(S.is_entry_point(F.col("i"))).collect()] == [True, True, False]


def test_explanation(spark):
    cols = [f"p_{x}" for x in S.PHRASES]
    rows = [(0.9, 0.1, 0.85, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0.9, 0.85), (0, 0.1, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0.81, 0.9, 0.85)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{c} double" for c in cols))
    got = [r[0] for r in df.select(S.explanation()).collect()]
    assert got[0] == "Churns much and carries many callers." and got[1] == "Many branches and deep nesting." and got[2] == "Complex in structure."
    assert got[3] == "Many branches, deep nesting, and often changed together with risky files."


def test_quadrants_and_actions(spark):
    df = spark.createDataFrame([(5, 99, "high"), (0, 30, "low"), (0, None, "critical"), (None, None, "low")], "t long, d long, b string").withColumn("q", S.quadrant(F.col("t"), F.col("d"), F.lit(3), F.col("b")))
    assert [r["q"] for r in df.collect()] == ["fire", "watch", "debt", "ok"]
    assert df.select(S.driver_action(F.lit("nonsense"), F.col("q"))).first()[0] == S.ACTIONS[None, "fire"]


def test_config():
    assert Config().validate().thresholds.high == 6.0
    for bad in ({"nope": 1}, {"thresholds": {"high": 2.0}}, {"weights": {"cc": 11}}, {"critical_introduction": "warn"}, {"patterns": {"deeply_nested_nd": 0}}, {"warning_thresholds": {"watch_min": 9.0}}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)
    assert Config.from_dict({"critical_introduction": "warn", "policy_reasons": {"critical_introduction": "legacy"}}).critical_introduction == "warn"


def test_config_files(tmp_path):
    assert Config.load(str(tmp_path)) == Config()
    (tmp_path / "package.json").write_text('{"riskloom": {"top": 7}}')
    assert Config.load(str(tmp_path)).top == 7
    (tmp_path / ".riskloomrc.json").write_text('{"top": 9}')
    assert Config.load(str(tmp_path)).top == 9
