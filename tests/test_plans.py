import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.plans import sinks
from riskloom.plans.catalog import ORACLES, QUERIES
from riskloom.plans.engine import Engine
from riskloom.plans.store import SnapshotStore
from riskloom.sources import adapters as V

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"q_regime_screen", "q_random_forest", "q_ridge"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    if name not in ORACLES:
        df.write.format("noop").mode("overwrite").save()
        return
    cols = sorted(df.columns)
    want = duck.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def sample(spark, small):
    from riskloom.plans.catalog import _quads
    from riskloom.functions import scoring as S

    return S.with_activity_risk(_quads(spark, small)).withColumn("patterns", S.pattern_ids(S.pattern_details()))


def test_sinks(spark, small, tmp_path):
    f = sample(spark, small).persist()
    log = json.loads(sinks.sarif(f))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == f.filter("band <> 'low'").count()
    view = json.loads(sinks.agent_view(f))
    assert view["schema_version"] == 4 and all(len(v) <= 5 for v in view["triage"].values()) and len(view["file_risk"]) == 10
    sinks.write_jsonl(f.select("function_id", "lrs"), {"sha": "abc"}, str(tmp_path / "o"))
    assert json.loads(spark.read.text(str(tmp_path / "o")).first()[0])["commit"] == {"sha": "abc"}
    assert "critical" in sinks.grouped_report(f) or "high" in sinks.grouped_report(f)
    assert len(sinks.text_report(f, 3).splitlines()) == 4
    page = sinks.html_snapshot(f, title="<x>")
    assert "&lt;x&gt;" in page and "Triage" in page
    b, a = V.snapshot_pair(spark, "/root/testdata/sf0.01")
    from riskloom.operators import delta as D
    from riskloom.operators import policy as P

    d = D.deltas(b, a)
    assert "Policies" in sinks.html_delta(d, P.evaluate(d, b, a)) and "modified" in sinks.diff_text(D.diff_top(d, 50).collect()) and "Policy" in sinks.policy_text(P.evaluate(d, b, a).collect())


def tree(root, body):
    (root / "s").mkdir(exist_ok=True)
    (root / "s/a.js").write_text("function main() { helper(); }\nfunction helper() {\n" + body + "}\n")


def test_engine_from_source_to_trends(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    e = Engine(spark, SnapshotStore(spark, str(tmp_path / "store")))
    log = spark.createDataFrame([("c1", 100, "a", "fix", "s/a.js", 5, 1)], "sha string, ts long, author string, subject string, file string, lines_added long, lines_deleted long")
    branch = "if (a && b) { for (;;) { if (c) break; } }\n"
    for i, n in enumerate([0, 6, 1]):
        tree(src, branch * n + "x();\n")
        e.snapshot(str(src), f"c{i + 1}", [f"c{i}"] if i else [], 100 + i, log)
    with pytest.raises(ValueError):
        e.snapshot(str(src), "c3", ["c2"], 104)
    first = e.store.load("c1").filter("function = 'main'").first()
    assert (first["fan_out"], first["fan_in"], first["is_entrypoint"], first["dependency_depth"], first["quadrant"]) == (1, 0, True, 0, "watch")
    shown, policies = e.diff("c1", "c2")
    assert [r["function_id"] for r in shown.collect()] == ["s/a.js::helper"] and policies.filter("id = 'rapid-growth'").count() == 1
    v, s, r = e.trends()
    assert v.count() == 2 and s.count() == 2 and [x["outcome"] for x in r.collect()] == ["successful"]
    before = {f"c{i}": sorted(map(str, e.store.load(f"c{i}").select("function_id", "lrs").collect())) for i in range(1, 4)}
    assert e.compact(1) == ["c2"]
    assert {k: sorted(map(str, e.store.load(k).select("function_id", "lrs").collect())) for k in before} == before
    assert e.compact(2) == []  # helper changed its band each time
    parents, tip = spark.createDataFrame([("c3", "c2"), ("c2", None)], "sha string, parent string"), spark.createDataFrame([("c3",)], "sha string")
    assert e.prune(parents, tip, dry_run=True) == e.prune(parents, tip) == ["c1"]
    assert [x["sha"] for x in e.store.index().collect()] == ["c2", "c3"]


def test_engine_trains_and_ranks_what_it_analyzed(spark, tmp_path):
    from riskloom.operators import ranking as R

    src = tmp_path / "src"
    (src / "s").mkdir(parents=True)
    for i in range(60):
        (src / f"s/f{i}.js").write_text(f"function go{i}() {{\n" + "if (a && b) { x(); }\n" * (i % 10) + "}\n")
    log = [(f"c{k}", 100 + k, f"a{k % 3}", "fix it" if k % 2 else "more", f"s/f{i}.js", i % 10, 1) for k in range(12) for i in range(60) if i % 10 >= k % 10]
    cf = spark.createDataFrame(log, "sha string, ts long, author string, subject string, file string, lines_added long, lines_deleted long")
    e = Engine(spark, SnapshotStore(spark, str(tmp_path / "store")))
    f = e.analyze(str(src), cf, 200)
    assert set(R.FEATURES) | set(R.COLD_FEATURES) <= set(f.columns) and f.filter("betweenness is null").count() == 0
    x = e.labelled(f, cf.filter("subject = 'fix it' and sha = 'c9'"))
    assert {r["file"] for r in x.filter("label = 1").collect()} == {f"s/f{i}.js" for i in range(60) if i % 10 == 9}
    last = x.filter("file = 's/f9.js'").first()
    assert (last["convention_bug_fix_count"], last["total_churn"], last["commit_count"]) == (6, 10, 12) and last["directed_coupling"] > 0
    model, kind = e.train(x)
    R.save(model, str(tmp_path / "m"))
    again = {r["function_id"]: r["rank_score"] for r in e.rank(x, R.load(str(tmp_path / "m"), kind)).collect()}
    score = {r["function_id"]: (r["rank_score"], r["label"]) for r in e.rank(x, model).collect()}
    assert again == {k: v[0] for k, v in score.items()} and len(score) == 60
    assert min(v for v, y in score.values() if y) > max(v for v, y in score.values() if not y)
    assert "anomaly_score" in R.anomaly_scores(x, R.COLD_FEATURES, "function_id").columns


def test_streaming_touches(spark, tmp_path, small):
    from riskloom.streaming.touches import windowed_touches

    src = str(tmp_path / "in")
    V.table(spark, small, "events").select(F.col("user_id").alias("file"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(src)
    events = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = windowed_touches(events, 2, 2).writeStream.format("memory").queryName("touched").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("touched").agg(F.sum("touches")).first()[0] == spark.read.parquet(src).count()


def test_level_two_drops_what_changed_no_band(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    for i, x in enumerate([1.0, 2.0, 7.0, 7.5]):
        df = spark.createDataFrame([("f", x, "high" if x > 6 else "low")], "function_id string, lrs double, band string")
        store.persist(df, f"c{i}", [], i)
    assert store.compact(1) == ["c1", "c2"] and store.load("c2").first()["lrs"] == 7.0
    assert store.compact(2, dry_run=True) == store.compact(2) == ["c1"]
    assert store.load("c1") is None and store.load("c2").first()["lrs"] == 7.0 and [r["sha"] for r in store.index().collect()] == ["c0", "c2", "c3"]


def test_random_forest_query_fits_the_references_200_trees(spark, small, monkeypatch):
    from riskloom.plans import catalog

    made, fit = [], catalog.R.fit_forest

    def fitted(*args, **kwargs):
        made.append(fit(*args, **kwargs))
        return made[-1]

    monkeypatch.setattr(catalog.R, "fit_forest", fitted)
    assert catalog.QUERIES["q_random_forest"](spark, small).count() > 0
    assert any(getattr(s, "getNumTrees", None) == 200 for m in made for s in getattr(m, "stages", [m]))


@pytest.mark.parametrize("name, shuffles", [("q_directed_coupling", 1), ("q_cochange_pairs", 1), ("q_cochange_static", 1), ("q_isolation_rate", 2), ("q_history_signals", 2), ("q_burst_score", 2), ("q_hidden_coupling", 1)])
def test_commit_rows_go_to_tasks_of_bounded_size(spark, name, shuffles):
    from riskloom.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= shuffles
    if name == "q_history_signals":
        assert plan.count("lineitem.parquet") == 1
