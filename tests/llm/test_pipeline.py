import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from riskloom.llm import langid, mixing, piece, quality, queries, simhash
from riskloom.llm.common import in_file_order, read


def test_stages_against_their_operators(spark, small):
    docs, cols = read(spark, small, "documents"), None
    labels = read(spark, small, "labels")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    want = [
        lambda d: [r["doc_id"] for r in quality.quality_scores(d, labels).collect() if r["kept"]],
        lambda d: [r["doc_id"] for r in langid.language_ids(d).collect() if r["kept"]],
        lambda d: [r["doc_id"] for r in simhash.near_duplicates(d).collect() if r["kept"]],
        lambda d: [r["doc_id"] for r in mixing.schedule(d).collect()],
        lambda d: [r["doc_id"] for r in piece.encode_documents(d).collect()],
    ]
    cols = docs.columns
    for i, ((name, stage), brute) in enumerate(zip(corpus_pipeline.STAGES, want)):
        out = stage(spark, docs, small).persist()
        assert ids(out) == sorted(brute(docs)), name
        assert out.columns == cols if i < 4 else out.columns == ["doc_id", "n_ids", "ids", "lossless"]
        docs = out
    assert 0 < docs.count() < read(spark, small, "documents").count()
    assert ids(corpus_pipeline.run(spark, small)) == ids(docs)


def test_tokens_come_in_the_order_of_the_mixture(spark, small, tmp_path, monkeypatch):
    docs = read(spark, small, "documents")
    slot = {r["doc_id"]: r["slot"] for r in mixing.schedule(docs).collect()}
    assert len(slot) == docs.count() and len(set(slot.values())) > 20
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    (_, mix), (_, encode) = corpus_pipeline.STAGES
    # Several partitions and files, as large tables have.
    packing = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in packing}
    try:
        for k, v in packing.items():
            spark.conf.set(k, v)
        mix(spark, docs, small).write.parquet(str(tmp_path / "mixed"))
        encode(spark, spark.read.parquet(str(tmp_path / "mixed")), small).write.parquet(str(tmp_path / "encoded"))
        files = sorted((tmp_path / "encoded").glob("part-*"))
        written = [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()]
        for got in (written, [r["doc_id"] for r in corpus_pipeline.run(spark, small).collect()]):
            assert sorted(got) == sorted(slot) and [slot[i] for i in got] == sorted(slot.values())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_scan_is_put_back_in_the_order_of_its_parts(spark, tmp_path):
    n = 0
    for part, rows in enumerate([5, 40, 400, 4000]):  # a scan takes the largest file first
        pq.write_table(pa.table({"doc_id": list(range(n, n + rows))}), tmp_path / f"part-{part:05d}-x.snappy.parquet")
        n += rows
    table = spark.read.parquet(str(tmp_path))
    order = lambda df: [r["doc_id"] for r in df.collect()]
    assert order(table) != list(range(n)) and order(in_file_order(table)) == list(range(n))
    assert in_file_order(table).columns == table.columns
    other = table.filter("doc_id > 3")
    assert in_file_order(other) is other


def test_odd_rows_and_empty_tables_go_through(spark, small):
    docs = read(spark, small, "documents")
    extra = docs.limit(20).selectExpr("*", "'x' as score", "'y' as _h", "1 as ids")
    odd = extra.unionByName(extra).unionByName(extra.limit(3).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars", "score", "_h", "ids"))
    for table in (odd, odd.limit(0)):
        d = table
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, small)
            assert d.count() <= table.count()


def test_queries_are_registered():
    q = queries.queries()
    assert [n.split("_")[0] for n in q if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in q
    assert set(queries.oracle_sql()) <= set(q) and len(corpus_pipeline.STAGES) == 5
