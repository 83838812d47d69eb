from pyspark.sql import functions as F

from sextant.operators.runtime import batch_aggregate
from sextant.sources import tables
from sextant.streaming import ingest

SF = "/root/testdata/sf0.001"


def parts(spark, folder):
    tables.table(spark, SF, "events").repartition(3, "event_id").write.parquet(str(folder))
    return str(folder)


def run(df, spark, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    src = parts(spark, tmp_path / "in")
    q = ingest.ingest(ingest.events(spark, src), str(tmp_path / "state"), str(tmp_path / "ck"))
    q.awaitTermination(180)
    got = {(r.symbol_id, r.source): (r["count"], r.first_seen) for r in ingest.state_of(spark, str(tmp_path / "state")).collect()}
    ev = tables.runtime_events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.symbol_id, r.source): r["count"] for r in batch_aggregate(ev).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    before = ingest.state_of(spark, str(tmp_path / "state")).count()
    ingest.upsert_batch(ev.withColumnRenamed("symbol_id", "user_id").withColumnRenamed("source", "event_type").withColumnRenamed("duration_ms", "value").limit(0), 99, str(tmp_path / "state"), max_rows=5)
    assert before > 5 and ingest.state_of(spark, str(tmp_path / "state")).count() == 5


def test_windows(spark, tmp_path):
    stream = ingest.events(spark, parts(spark, tmp_path / "in"), 10)
    got = {(r.event_type, r.start): r.n for r in run(ingest.windows(stream, late="60 days"), spark, "w1", "complete").collect()}
    ev = tables.table(spark, SF, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("d")).count()
    assert got == {(r.event_type, r.d): r["count"] for r in ev.withColumn("d", F.col("d").cast("timestamp")).collect()}


def test_latency_ring(spark, tmp_path):
    stream = ingest.events(spark, parts(spark, tmp_path / "in"), 10)
    got = {r.tool: r for r in run(ingest.latency_ring(stream, 50), spark, "ring", "update").collect()}
    for tool, r in got.items():
        rows = tables.table(spark, SF, "events").where(F.col("event_type") == tool).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).toPandas()["value"].sort_values().tolist()
        assert (r.n, r.p50, r.max_ms) == (len(rows), rows[len(rows) // 2], rows[-1])


def test_batches_rewrite_what_they_touch(spark, tmp_path):
    state = str(tmp_path / "state")
    rows = lambda *xs: spark.createDataFrame([(u, "t", float(v)) for u, v in xs], "user_id long, event_type string, value double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    ingest.upsert_batch(rows((1, 1), (2, 2), (3, 3)), 0, state)
    ingest.upsert_batch(rows((1, 5)), 1, state)
    ingest.upsert_batch(rows((1, 5)), 1, state)  # the same batch again
    counts = lambda: {r.symbol_id: r["count"] for r in ingest.state_of(spark, state).collect()}
    assert counts() == {1: 2, 2: 1, 3: 1}
    for i in range(2, 6):
        ingest.upsert_batch(rows((1, i), (2, i), (3, i)), i, state)
    assert counts() == {1: 6, 2: 5, 3: 5} and len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("v")]) <= 3


def test_other_logs_and_watchers(spark, tmp_path):
    lines = spark.createDataFrame([('{"sql": "select 1 from a.t join u on 1 = 1", "duration_ms": 2}',), ("# no",)], "value string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    ingest.upsert_batch(lines, 0, str(tmp_path / "s"), counts=ingest.statement_counts)
    assert {r.symbol_id for r in ingest.state_of(spark, str(tmp_path / "s")).collect()} == {"t", "u"}
    logs = spark.createDataFrame([(1, 'Traceback (most recent call last):\n  File "a.py", line 3, in go\n    x\nE: y')], "id long, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    ingest.upsert_batch(logs, 0, str(tmp_path / "k"), counts=ingest.frame_counts)
    assert [(r.symbol_id, r["count"]) for r in ingest.state_of(spark, str(tmp_path / "k")).collect()] == [("a.py:go", 1)]
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.txt").write_text("x")
    watchers = ingest.Watchers(lambda f: ingest.watch(spark, f).writeStream.format("memory").queryName("watched").start())
    watchers.add(str(folder))
    q = watchers.queries[str(folder)]
    q.processAllAvailable()
    assert ingest.wait_until_fresh(q, 20_000) and spark.table("watched").count() == 1 and watchers.tend() == []
    watchers.stop()
    assert not q.isActive and watchers.queries == {}
