import datetime as dt
import json

from pyspark.sql import functions as F

from aiscope.sources import files
from aiscope.streaming import events as S

RULES = "rule_id int, effect string, action string, field string, op string, value string"


def requests(tmp_path, n=6):
    folder = tmp_path / "log"
    folder.mkdir()
    rows = [{"timestamp": "2024-01-01T00:00:00Z", "method": "GET", "url": f"https://{'bad' if i % 2 else 'ok'}.com/{i}", "status_code": 200, "duration_ms": 1.0} for i in range(n)]
    (folder / "a.json").write_text("\n".join(map(json.dumps, rows)))
    return str(folder)


def run(spark, tmp_path, age):
    path = requests(tmp_path)
    rules = spark.createDataFrame([(1, "forbid", "*", "url", "contains", "bad")], RULES)
    load = lambda: rules.withColumn("loaded_at", F.current_timestamp() - F.expr(f"interval {age} seconds"))
    stream = files.request_log(spark, path, stream=True).withColumn("request_id", F.col("url"))
    S.evaluate_stream(stream, load, str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "cp")).awaitTermination()
    count = lambda name: spark.read.schema("url string, reason string").json(str(tmp_path / name)).count()
    return count("ok"), count("no")


def test_fresh_rules_block(spark, tmp_path):
    assert run(spark, tmp_path, 1) == (3, 3)


def test_stale_rules_allow(spark, tmp_path):
    assert run(spark, tmp_path, 1000) == (6, 0)


def test_middleware_drops_and_maps(spark):
    rows = spark.range(4)
    assert [r.id for r in S.middleware(rows, [lambda f: f.where("id > 1"), lambda f: f.select((F.col("id") * 10).alias("id"))]).collect()] == [20, 30]


def test_deliver_sends_each_event_once(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"id": f"e{i}", "type": "error", "name": "n", "timestamp": "2024-01-01T00:00:00Z"}) for i in range(40)))
    sent = []
    S.deliver(S.events(spark, str(folder)), lambda batch, _: sent.extend(batch.collect()), str(tmp_path / "cp"), size=2, every=None).awaitTermination()
    assert sum(r.n_events for r in sent) == 40 and max(r.n_events for r in sent) <= 2


def test_watch_sees_new_files(spark, tmp_path):
    root = tmp_path / "src"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text("x")
    (root / "node_modules" / "b.py").write_text("x")
    seen = []
    S.watch(spark, str(root), lambda batch, _: seen.extend(r.path for r in batch.select("path").collect()), str(tmp_path / "cp"), every=None).awaitTermination()
    assert [p.rsplit("/", 1)[1] for p in seen] == ["a.py"]


def test_liveness(spark):
    t = dt.datetime(2024, 1, 1)
    beats = spark.createDataFrame([("a", t), ("b", t - dt.timedelta(minutes=9))], "agent_id string, ts timestamp")
    assert {r.agent_id: r.alive for r in S.liveness(S.last_seen(beats), t).collect()} == {"a": True, "b": False}


def test_call_statistics(spark):
    rows = spark.createDataFrame([("f", 1.0, True), ("f", 3.0, False)], "name string, duration_ms double, success boolean")
    row = S.call_statistics(rows).first()
    assert (row.n, row.error_rate, row.mean_ms) == (2, 0.5, 2.0)


def test_a_replayed_batch_replaces_what_it_wrote(spark, tmp_path):
    """The sinks of a stream hold each batch once, also when it runs again because its commit was lost."""
    import shutil

    from pyspark.sql import functions as F

    from aiscope.streaming import events

    spark.range(20).select(F.col("id").alias("request_id"), F.lit("GET").alias("method"), F.concat(F.lit("https://h/"), "id").alias("url")).write.parquet(f"{tmp_path}/in")
    rules = lambda: spark.createDataFrame([(1, "forbid", "*", "url", "endswith", "7")], "rule_id int, effect string, action string, field string, op string, value string").withColumn("loaded_at", F.current_timestamp())
    for _ in range(2):
        stream = spark.readStream.schema("request_id long, method string, url string").parquet(f"{tmp_path}/in")
        events.evaluate_stream(stream, rules, f"{tmp_path}/allowed", f"{tmp_path}/blocked", f"{tmp_path}/checkpoint").awaitTermination()
        shutil.rmtree(f"{tmp_path}/checkpoint/commits")
    assert spark.read.json(f"{tmp_path}/allowed").count() == 18 and spark.read.json(f"{tmp_path}/blocked").count() == 2
