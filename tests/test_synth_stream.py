import os

from pyspark.sql import functions as F

from binsight.functions.random import cumulative_bounds
from binsight.operators import synth as sy
from binsight.session import scratch_path

def end():
    return F.lit("2024-11-09 12:00:00").cast("timestamp_ntz")


def test_partition_independent(spark):
    a = sy.synth_range(spark, 3000, end(), partitions=1).collect()
    b = sy.synth_range(spark, 3000, end(), partitions=8).collect()
    assert sorted(a) == sorted(b)


def test_frequencies(spark):
    df = sy.synth_range(spark, 40000, end(), "python", seed=7)
    n = 40000
    freq = {r.brand: r["count"] / n for r in df.groupBy("brand").count().collect()}
    assert abs(freq["Amazon"] - 0.5) < 0.02 and abs(freq["Nike"] - 0.05) < 0.01
    t = df.agg(F.min("time"), F.max("time")).first()
    assert str(t[0]) == "2024-11-02 12:00:00" and str(t[1]) == "2024-11-09 11:00:00"
    metal = df.filter("is_metal").count() / n
    assert abs(metal - 0.2) < 0.02
    rec = df.filter("brand = 'Amazon'").agg(F.avg(F.col("is_recyclable").cast("double"))).first()[0]
    assert abs(rec - 0.9) < 0.02


def test_matlab_profile_and_bounds(spark):
    assert cumulative_bounds([0.1, 0.2, 0.4, 0.25, 0.1, 0.05])[-1] == 1.0
    df = sy.synth_range(spark, 20000, end(), "matlab")
    freq = {r.brand: r["count"] / 20000 for r in df.groupBy("brand").count().collect()}
    assert abs(freq["Coca-Cola"] - 0.4 / 1.1) < 0.02
    t = df.agg(F.min("time"), F.max("time"), F.countDistinct("time")).first()
    assert (str(t[0]), str(t[1]), t[2]) == ("2024-11-02 12:00:00", "2024-11-09 12:00:00", 169)
    assert sy.hour_spine(spark, end(), "matlab").count() == 169


def test_hour_spine(spark):
    rows = sy.hour_spine(spark, end()).collect()
    assert len(rows) == 168 and str(rows[-1].hour_start) == "2024-11-09 11:00:00"


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    d = "/root/testdata/sf0.001"
    qs = E.queries()
    batch = sorted(map(tuple, qs["composition_by_hour"](spark, d).collect()))
    stream = sorted(map(tuple, qs["stream_composition"](spark, d).collect()))
    assert batch == stream


def test_ingest_stream_restart_adds_nothing(spark):
    from binsight.sources import driver_tables as dt
    from binsight.sources import table as tb
    from binsight.streaming.ingest_stream import start_ingest
    d = "/root/testdata/sf0.001"
    table, ckpt, work = (scratch_path(spark, x) for x in ("t", "c", "w"))
    arrivals = dt.stream_events_parts(spark, d).select(
        F.concat(F.col("event_id").cast("string"), F.lit(".jpg")).alias("filename"), F.col("ts").alias("time"))
    start_ingest(arrivals, table, ckpt, work).awaitTermination()
    n = tb.read_table(spark, table).count()
    start_ingest(arrivals, table, ckpt, work).awaitTermination()  # restart from checkpoint
    start_ingest(arrivals, table, scratch_path(spark, "c2"), work).awaitTermination()  # full replay
    assert tb.read_table(spark, table).count() == n == dt.table(spark, d, "events").count()


def test_seeds_salts_and_large_ids_are_independent(spark):
    from binsight.functions.random import uniform
    df = spark.range(0, 4000).union(spark.range(2**31, 2**31 + 4000)).union(spark.range(2**62, 2**62 + 4000))
    cols = [uniform("id", salt, seed).alias(f"u{salt}_{seed}") for salt in (1, 2) for seed in (0, 1)]
    rows = df.select("id", *cols).toPandas()
    for c in rows.columns[1:]:
        assert rows[c].nunique() == 12_000 and abs(rows[c].mean() - 0.5) < 0.02
    assert rows.iloc[:, 1:].corr().where(lambda x: x < 0.999).abs().max().max() < 0.05
    for a in rows.columns[1:]:
        for b in rows.columns[1:]:
            if a != b:
                assert not set(rows[a]) & set(rows[b])  # no shifted copy of another sequence


def test_image_stream_ingest_enrich_restart_and_retry(spark, tmp_dir):
    import json
    from binsight.plans import jobs
    from binsight.sources import table as tb
    from binsight.streaming.ingest_stream import arrivals_from_images, start_ingest

    img = os.path.join(tmp_dir, "images")
    os.makedirs(img)

    def put(name):
        with open(os.path.join(img, name), "wb") as f:
            f.write(b"jpeg-bytes-" + name.encode())

    class Picky:
        """Answers every image except 'bad.jpg' (malformed text)."""

        def __call__(self, filename, request):
            assert json.loads(request)["messages"][0]["content"][1]["image_url"]["url"].startswith(
                "data:image/jpeg;base64,")
            if filename == "bad.jpg":
                return "not json"
            return json.dumps({"is_recyclable": True, "is_compostable": False, "is_metal": False,
                               "brand": "", "description": f"thing {filename}"})

    table, ckpt, work = (scratch_path(spark, x) for x in ("imgt", "imgc", "imgw"))
    for n in ("a.jpg", "bad.jpg"):
        put(n)
    start_ingest(arrivals_from_images(spark, img), table, ckpt, work, Picky, backoff_s=0.0).awaitTermination()
    rows = {r.filename: r for r in tb.read_table(spark, table).collect()}
    assert rows["a.jpg"].description == "thing a.jpg" and rows["bad.jpg"].description == ""
    put("c.jpg")
    start_ingest(arrivals_from_images(spark, img), table, ckpt, work, Picky, backoff_s=0.0).awaitTermination()
    rows = {r.filename: r for r in tb.read_table(spark, table).collect()}
    assert sorted(rows) == ["a.jpg", "bad.jpg", "c.jpg"] and rows["c.jpg"].is_recyclable is True
    # the batch job retries what is still pending; the answer stays invalid -> rejected, row kept pending
    n, bad = jobs.enrich_pending(spark, table, img, Picky, backoff_s=0.0)
    assert [r.filename for r in bad.collect()] == ["bad.jpg"]
    assert tb.read_table(spark, table).filter("description = ''").count() == 1


def test_processing_time_trigger_drain_and_stop(spark):
    from binsight.sources import driver_tables as dt
    from binsight.sources import table as tb
    from binsight.streaming import drain_and_stop
    from binsight.streaming.ingest_stream import start_ingest
    d = "/root/testdata/sf0.001"
    table = scratch_path(spark, "pt")
    arrivals = dt.stream_events_parts(spark, d, max_files_per_trigger=1).select(
        F.concat(F.col("event_id").cast("string"), F.lit(".jpg")).alias("filename"), F.col("ts").alias("time"))
    q = start_ingest(arrivals, table, scratch_path(spark, "ptc"), scratch_path(spark, "ptw"),
                     trigger={"processingTime": "1 second"})
    drain_and_stop(q)
    assert not q.isActive
    assert tb.read_table(spark, table).count() == dt.table(spark, d, "events").count()


def test_a_new_checkpoint_asks_again_and_a_replay_does_not(spark, tmp_dir):
    from binsight.sources import table as tb
    from binsight.streaming import ingest_stream as st
    calls = os.path.join(tmp_dir, "calls")
    os.makedirs(calls)

    def factory():
        def call(name, request):
            import uuid
            open(os.path.join(calls, f"{name}-{uuid.uuid4().hex}"), "w").close()
            return "not json"
        return call

    batch = spark.createDataFrame([("1.jpg", "2024-01-01 00:00:00")], "filename string, time string").withColumn(
        "time", F.col("time").cast("timestamp"))
    ckpt, work = scratch_path(spark, "sc"), scratch_path(spark, "sw")
    for checkpoint, expected in ((ckpt, 1), (ckpt, 1), (scratch_path(spark, "sc2"), 2)):
        table = scratch_path(spark, "st")  # the same epoch again, as after a crash before the append
        st.ingest_batch(spark, batch, 0, table, f"{work}/{st.stream_id(spark, checkpoint)}", factory, backoff_s=0.0)
        assert len(os.listdir(calls)) == expected and tb.read_table(spark, table).count() == 1


def test_composition_stream_restarts_and_keeps_few_results(spark, tmp_dir):
    from binsight.sources import table as tb
    from binsight.sources.driver_tables import items
    from binsight.streaming.composition_stream import read_composition, start_composition
    src, out, ckpt = os.path.join(tmp_dir, "in"), scratch_path(spark, "rc"), scratch_path(spark, "rk")
    rows = items(spark, "/root/testdata/sf0.001")
    total = 0
    for i in range(3):
        rows.write.mode("append").parquet(src)
        total += rows.count()
        q = start_composition(spark.readStream.schema(rows.schema).parquet(src), "hour", out, ckpt, keep=2)
        q.awaitTermination()
        assert q.exception() is None
        assert read_composition(spark, out).agg(F.sum("total_count")).first()[0] == total
    assert len(tb.versions(spark, out)) == 2


def test_cluster_settings_are_known(spark):
    from binsight.session import CLUSTER_SETTINGS
    for k in CLUSTER_SETTINGS:
        assert spark.conf.get(k)  # raises for a setting that Spark does not know


def test_no_driver_folder_on_a_cluster(monkeypatch):
    from binsight import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key, default=None):
            return default

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()

    import pytest
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_shared_dir_when_checkpoint_dir_is_unset(tmp_dir):
    """A session without spark.checkpoint.dir: a local folder is registered
    through the SparkContext (the core setting cannot be changed at run time)."""
    import subprocess
    import sys
    conf_dir = os.path.join(tmp_dir, "conf")
    os.makedirs(conf_dir)
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "from binsight.session import shared_dir\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
            "d = shared_dir(s); assert d == s.sparkContext.getCheckpointDir().rstrip('/'); print('SHARED', d)\n" % repo)
    env = dict(os.environ, SPARK_CONF_DIR=conf_dir)
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert "SHARED file:" in out.stdout, out.stderr[-2000:]
