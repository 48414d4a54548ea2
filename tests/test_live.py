"""Key tables, de-duplication in state, live counts, the item life cycle and array feeds."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from binsight.operators import ingest as ing
from binsight.operators.composition import composition
from binsight.operators.prepare import prepare
from binsight.plans import jobs
from binsight.plans import live_counts as live
from binsight.session import scratch_path
from binsight.sources import json_array as ja
from binsight.sources import keys
from binsight.sources import table as tb
from binsight.sources.json_items import read_feed

SF = "/root/testdata/sf0.001"


def items(spark, *rows):
    """(name, hour, brand, recyclable, compostable, description) rows."""
    made = [(n, f"2024-01-0{1 + i % 3} {h:02d}:00:00", "NJ", "P", d, r, c, None, b) for i, (n, h, b, r, c, d) in enumerate(rows)]
    df = spark.createDataFrame(made, "filename string, time string, state string, city string, description string, is_recyclable boolean, "
                                     "is_compostable boolean, is_metal boolean, brand string")
    return df.withColumn("time", F.col("time").cast("timestamp"))


# --- key table -------------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_table_is_read_without_an_exchange(spark):
    table = scratch_path(spark, "keyed")
    rows = spark.range(5000).select(F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("filename"),
                                    F.lit("2024-01-01").cast("timestamp").alias("time"))
    jobs.append_new(spark, rows, table)
    jobs.append_new(spark, rows.withColumn("filename", F.concat(F.lit("n"), "filename")), table)  # a second file a bucket
    batch = spark.range(4000, 6000).select(F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("filename"))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        for buckets in (8, 64, 4):  # 8: the session's shuffle partitions
            if buckets != 8:
                keys.rebuild(spark, table, buckets)
            new = ing.new_only(batch, keys.known(spark, table))
            assert new.count() == 1000
            text = plan(new)
            side = text[text.index("LeftAnti"):].split("FileScan")[1]
            assert f"SelectedBucketsCount: {buckets} out of {buckets}" in side
            # one exchange: the batch's
            assert text.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    finally:
        for k in off:
            spark.conf.unset(k)


def test_appends_are_checked_by_keys_and_rebuilt_keys_are_the_same(spark):
    table = scratch_path(spark, "keyed")
    one = items(spark, ("a", 1, "x", None, None, ""), ("b", 2, "y", None, None, ""))
    two = items(spark, ("b", 2, "y", None, None, ""), ("c", 3, None, None, None, ""), (None, 4, "z", None, None, ""))
    for rows in (one, two, one, two):
        jobs.append_new(spark, rows, table, partitioned=True)
    names = sorted(r.filename or "" for r in tb.read_table(spark, table).collect())
    assert names == ["", "", "a", "b", "c"]  # without a name: nothing tells it from others
    before = sorted(r.filename for r in keys.known(spark, table).distinct().collect())
    keys.rebuild(spark, table)
    assert sorted(r.filename for r in keys.known(spark, table).collect()) == before == ["a", "b", "c"]


def test_a_replayed_epoch_appends_what_is_missing(spark, monkeypatch):
    from binsight.streaming.ingest_stream import ingest_batch
    table, work = scratch_path(spark, "replay"), scratch_path(spark, "replay-work")
    batch = spark.createDataFrame([("1.jpg", "2024-01-01"), ("2.jpg", "2024-01-02")], "filename string, time string").withColumn(
        "time", F.col("time").cast("timestamp"))
    real = keys.add

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(keys, "add", broken)  # the rows are in, their names are not
    with pytest.raises(RuntimeError, match="lost"):
        ingest_batch(spark, batch, 0, table, work, None)
    monkeypatch.setattr(keys, "add", real)
    for _ in range(2):
        ingest_batch(spark, batch, 0, table, work, None)
    ingest_batch(spark, batch, 1, table, work, None)
    assert tb.read_table(spark, table).count() == 2


# --- state -----------------------------------------------------------------------------------

def test_repeats_are_dropped_in_state_across_a_restart(spark, tmp_dir):
    from binsight.streaming.dedupe import distinct_arrivals, rocksdb_state
    folder, out, ckpt = os.path.join(tmp_dir, "in"), scratch_path(spark, "dd"), scratch_path(spark, "dd-ckpt")
    schema = "filename string, time timestamp, n int"

    def run(*rows):
        df = spark.createDataFrame(rows, "filename string, time string, n int").withColumn("time", F.col("time").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = distinct_arrivals(spark.readStream.schema(schema).parquet(folder), "1 hour")
        with rocksdb_state(spark):
            q = stream.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(out)
        q.awaitTermination()
        assert q.exception() is None
        assert "RocksDB" in ckpt or os.path.isdir(os.path.join(ckpt.removeprefix("file:"), "state"))

    run(("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 10:10:00", 2), (None, "2024-01-01 10:00:00", 3), (None, "2024-01-01 10:00:00", 4))
    run(("a", "2024-01-01 10:20:00", 5), ("b", "2024-01-01 10:20:00", 6))
    got = sorted((r.filename or "", r.n) for r in spark.read.schema(schema).parquet(out).collect())
    assert [g for g in got if g[0] == ""] == [("", 3), ("", 4)] and len(got) == 4
    assert {g[0] for g in got} == {"", "a", "b"}


# --- live counts -----------------------------------------------------------------------------

def answers(spark, *rows):
    return spark.createDataFrame(rows, "filename string, description string, is_recyclable boolean, is_compostable boolean, "
                                       "is_metal boolean, brand string")


def same_as_full(spark, table):
    for key in ("hour", "brand"):
        want = composition(prepare(tb.read_table(spark, table)), key, order=False)
        got = live.composition(spark, table, key)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("partitioned", [True, False])
def test_live_counts_follow_merges_appends_and_repeats(spark, partitioned):
    table, work = scratch_path(spark, "live"), scratch_path(spark, "live-work")
    rows = [(f"{i}", i % 4, ["", None, "A", "B"][i % 4], None, None, "") for i in range(12)] + [(None, 3, "A", None, None, "")]
    tb.append(spark, items(spark, *rows), table, partitioned=partitioned)
    live.start(spark, table)
    live.start(spark, table)
    same_as_full(spark, table)
    first = answers(spark, ("1", "cup", True, False, False, "B"), ("2", "peel", False, True, None, "A"), ("99", "ghost", True, True, True, "Z"))
    for _ in range(2):  # published once
        live.merge(spark, table, first, "m1", work)
        same_as_full(spark, table)
    live.append(spark, table, items(spark, ("1", 1, "A", None, None, ""), ("20", 7, "C", True, None, "x")), "a1", partitioned)
    same_as_full(spark, table)
    # the flags of a described item change again, its brand leaves no row behind
    live.merge(spark, table, answers(spark, ("20", "y", False, True, None, None), ("2", "z", None, None, None, "")), "m2", work)
    same_as_full(spark, table)
    live.merge(spark, table, answers(spark, ("99", "nobody", True, True, True, "Z")), "m3", work)
    same_as_full(spark, table)
    before = live.read_counts(spark, table).count()
    live.fold(spark, table, keep=1)
    assert live.read_counts(spark, table).count() < before
    same_as_full(spark, table)
    live.merge(spark, table, answers(spark, ("3", "w", True, None, None, "D")), "m4", work)
    same_as_full(spark, table)


@pytest.mark.parametrize("at", ["merge_answers", "publish"])
def test_live_counts_after_a_failure(spark, monkeypatch, at):
    table, work = scratch_path(spark, "live"), scratch_path(spark, "live-work")
    tb.append(spark, items(spark, ("1", 1, "A", None, None, ""), ("2", 2, "B", None, None, "")), table, partitioned=True)
    live.start(spark, table)
    told = answers(spark, ("1", "cup", True, False, False, "Q"))

    def broken(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if at == "publish":
            m.setattr(live, "_publish", broken)
        else:
            m.setattr(jobs, "merge_answers", broken)
        with pytest.raises(RuntimeError, match="lost"):
            live.merge(spark, table, told, "m1", work)
    live.merge(spark, table, told, "m1", work)
    same_as_full(spark, table)
    assert tb.read_table(spark, table).filter("brand = 'Q'").count() == 1


# --- life cycle ------------------------------------------------------------------------------

def moody_factory():
    """A factory (by value, the workers do not know this module) of a provider that describes at the first try, but for names that need two, three or never get an answer."""

    def moody():
        import base64
        import json

        def call(filename, request):
            url = json.loads(request)["messages"][0]["content"][1]["image_url"]["url"]
            attempt = int(base64.b64decode(url.split(",", 1)[1]).decode().rsplit("#", 1)[1])
            if attempt < {"two": 2, "three": 3, "never": 99}.get(filename.split("-")[0], 1):
                return "sorry"
            return json.dumps({"is_recyclable": True, "is_compostable": False, "is_metal": False, "brand": f"try {attempt}",
                               "description": f"thing {filename}"})

        return call

    return moody


def wait_for(check, seconds=120):
    import time
    until = time.monotonic() + seconds
    while not check():
        assert time.monotonic() < until, "not settled in time"
        time.sleep(0.5)


def test_rejected_items_are_asked_again_across_a_restart(spark, tmp_dir):
    from binsight.streaming.lifecycle import start_lifecycle, unsettled
    folder = os.path.join(tmp_dir, "in")
    table, ckpt, work = (scratch_path(spark, x) for x in ("cycle", "cycle-ckpt", "cycle-work"))
    schema = "filename string, time timestamp_ntz"

    def put(*names):
        spark.createDataFrame([(n,) for n in names], "filename string").select(
            "filename", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("time")).coalesce(1).write.mode("append").parquet(folder)

    def start(wait_s):
        return start_lifecycle(spark.readStream.schema(schema).parquet(folder), table, ckpt, work, moody_factory(), wait_s=wait_s, most=3,
                               trigger={"processingTime": "1 second"}, backoff_s=0.0)

    def described():
        return {r.filename: r.brand for r in tb.read_table(spark, table).collect() if r.description} if tb.exists(spark, table) else {}

    put("one-a", "two-a", "never-a", "two-a", None)
    q = start(3.0)
    wait_for(lambda: q.exception() is not None or "one-a" in described())
    assert q.exception() is None and "never-a" not in described()
    q.stop()  # wherever it is; the timers of the rejected ones go on in the checkpoint
    put("one-b", "three-b", "two-a")
    q = start(3.0)
    wait_for(lambda: q.exception() is not None or {"one-a", "one-b", "two-a", "three-b"} <= set(described()))
    wait_for(lambda: q.exception() is not None or [tuple(r) for r in unsettled(spark, work).collect()] == [("never-a", 3)])
    assert q.exception() is None
    q.stop()
    rows = tb.read_table(spark, table).collect()
    assert sorted(r.filename for r in rows) == ["never-a", "one-a", "one-b", "three-b", "two-a"]
    assert described() == {"one-a": "try 1", "one-b": "try 1", "two-a": "try 2", "three-b": "try 3"}


class KeptState:
    """Stands for Spark's handle and state of one bucket, and counts the calls."""

    def __init__(self):
        self.timers, self.calls, self.values = set(), 0, {}

    def getValueState(self, name, schema):
        kept = self

        class Value:
            def get(self):
                kept.calls += 1
                return kept.values.get(name)

            def update(self, value):
                kept.calls += 1
                kept.values[name] = value

            def clear(self):
                kept.calls += 1
                kept.values.pop(name, None)

        return Value()

    def getListState(self, name, schema):
        kept = self

        class Values:
            def get(self):
                kept.calls += 1
                return iter(kept.values.get(name, []))

            def appendValue(self, value):
                kept.calls += 1
                kept.values.setdefault(name, []).append(value)

        return Values()

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentProcessingTimeInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def test_items_of_one_bucket_go_their_own_ways():
    import datetime

    from pyspark.sql import Row

    from binsight.streaming.lifecycle import ItemCycle
    kept, cycle, day = KeptState(), ItemCycle(wait_ms=100, lost_ms=5000, most=2), datetime.datetime(2024, 1, 1)
    cycle.init(kept)

    def told(at, *events):
        rows = iter([Row(filename=n, time=t, event=e, attempt=a) for n, t, e, a in events])
        return [tuple(r) for r in cycle.handleInputRows((7,), rows, Now(at))]

    def expired(at):
        out = []
        for timer in sorted(t for t in kept.timers if t <= at):
            out += [tuple(r) for r in cycle.handleExpiredTimer((7,), Now(at), Now(timer))]
            kept.timers.discard(timer)  # as Spark does
        return out

    arrive = lambda n, t=day: (n, t, "arrived", 0)
    assert told(1000, arrive("a"), arrive("b"), arrive("a"), arrive("c", None)) == [
        ("a", day, "ask", 1), ("b", day, "ask", 1), ("c", None, "ask", 1)]
    assert kept.timers == {6000}
    assert told(2000, ("a", day, "described", 1), ("b", day, "rejected", 1), ("b", day, "rejected", 1), ("x", day, "rejected", 1), arrive("a")) == []
    assert kept.timers == {2100} and expired(2099) == []
    assert told(2050, arrive("d"), arrive("a"), arrive("b"), ("a", day, "rejected", 1)) == [("d", day, "ask", 1)]
    assert expired(2150) == [("b", day, "ask", 2)] and kept.timers == {6000}
    assert told(2200, ("b", day, "rejected", 1), ("b", day, "rejected", 2), arrive("b")) == [("b", day, "given up", 2)]
    assert sorted(expired(7050)) == [("c", None, "ask", 2), ("d", day, "ask", 2)] and kept.timers == {12050}
    assert told(7100, ("d", day, "described", 2)) == [] and expired(12050) == [("c", None, "given up", 2)]
    assert kept.timers == set() and "open" not in kept.values
    assert told(13000, *(arrive(n) for n in "abcd")) == []


def test_state_is_called_for_buckets_not_for_items():
    from pyspark.sql import Row

    from binsight.streaming.lifecycle import ItemCycle
    kept, cycle = KeptState(), ItemCycle(100, 5000, 2)
    cycle.init(kept)
    for event, attempt in (("arrived", 0), ("rejected", 1)):
        rows = iter([Row(filename=f"{i}", time=None, event=event, attempt=attempt) for i in range(1000)])
        list(cycle.handleInputRows((7,), rows, Now(1000)))
    assert kept.calls < 20
    assert len(list(cycle.handleExpiredTimer((7,), Now(1100), Now(1100)))) == 1000


def event_tables(folder, n=40):
    """``events`` and ``part`` as single files; every second event is a pending item."""
    import pandas as pd
    ts = pd.to_datetime("2024-01-01") + pd.to_timedelta(range(n), unit="min")
    pd.DataFrame({"event_id": range(n), "ts": ts.astype("datetime64[us]"), "event_type": ["error", "view"] * (n // 2),
                  "props": [f'{{"k": {i % 5}}}' for i in range(n)]}).to_parquet(os.path.join(folder, "events.parquet"))
    pd.DataFrame({"p_partkey": range(5), "p_name": "ring", "p_brand": "B"}).to_parquet(os.path.join(folder, "part.parquet"))
    return folder


def test_a_long_batch_is_not_taken_for_a_stuck_stream(spark, tmp_dir, monkeypatch):
    import time

    from binsight.plans.catalogue import QUERIES
    now = iter(range(0, 10 ** 9, 700))
    monkeypatch.setattr(time, "monotonic", lambda: next(now))  # 700 s from one look to the next
    rows = QUERIES["stream_lifecycle"](spark, event_tables(tmp_dir)).collect()
    assert sorted(int(r.filename.split(".")[0]) for r in rows) == list(range(0, 40, 2))
    assert all(r.description == f"item {n}, try {2 if n % 5 == 0 else 1}" for r in rows for n in [int(r.filename.split(".")[0])])


def test_a_stream_that_ends_or_goes_on_for_nothing_raises(spark):
    from binsight.streaming.lifecycle import EVENT, wait_described
    work = scratch_path(spark, "cycle-work")
    spark.createDataFrame([("a", None, "described", 1)], EVENT).write.parquet(f"{work}/outcomes/epoch=0")

    class Query:
        isActive, batch = True, 0

        @property
        def lastProgress(self):
            self.batch += 10
            return {"batchId": self.batch}

        def exception(self):
            return None

    wait_described(Query(), spark, work, 1)
    with pytest.raises(TimeoutError, match="1 of 2"):
        wait_described(Query(), spark, work, 2, stuck_s=0.0, stuck_batches=20)
    ended = Query()
    ended.isActive = False
    with pytest.raises(RuntimeError, match="1 of 2"):
        wait_described(ended, spark, work, 2)


def test_events_are_streamed_from_a_file_or_a_folder(spark, tmp_dir):
    from binsight.sources import driver_tables as dt
    os.makedirs(single := os.path.join(tmp_dir, "single"))
    event_tables(single)
    os.makedirs(several := os.path.join(tmp_dir, "several"))
    for name in ("events", "part"):
        spark.read.parquet(f"{single}/{name}.parquet").repartition(3).write.parquet(f"{several}/{name}.parquet")
    for folder in (single, several, f"{several}/"):
        out = scratch_path(spark, "streamed")
        q = (dt.stream_events_parts(spark, folder).writeStream.format("parquet").trigger(availableNow=True)
             .option("checkpointLocation", scratch_path(spark, "streamed-ckpt")).start(out))
        q.awaitTermination()
        assert q.exception() is None
        assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_a_table_registered_while_it_is_looked_up_is_found(spark, monkeypatch):
    table = scratch_path(spark, "late")
    tb.replace(spark, spark.range(3), table)
    where, real = tb.location(spark, table), tb.versions
    spark.sql(f"DROP TABLE {tb.name_of(table)}")

    def registered_meanwhile(spark, table):
        tb._register(spark, table, spark.range(1).schema, where, False)
        return real(spark, table)

    monkeypatch.setattr(tb, "versions", registered_meanwhile)
    assert tb.exists(spark, table) and tb.read_table(spark, table).count() == 3


def test_a_table_may_be_looked_up_while_another_thread_replaces_it(spark):
    import threading
    table, seen, failed, stop = scratch_path(spark, "watched"), set(), [], threading.Event()

    def look():
        while not stop.is_set():
            try:
                if tb.exists(spark, table):
                    seen.add(len(tb.schema_of(spark, table)))
                    tb.read_table(spark, table)
            except Exception as e:
                failed.append(e)
                return

    watcher = threading.Thread(target=look)
    watcher.start()
    try:
        for n in range(8):
            tb.replace(spark, spark.range(n + 1), table, keep=100)
    finally:
        stop.set()
        watcher.join()
    assert failed == [] and seen == {1} and tb.read_table(spark, table).count() == 8


# --- array feeds -----------------------------------------------------------------------------

def whole_array(spark, path):
    return sorted((r.filename, r.description, r.brand) for r in read_feed(spark, path)[0].collect())


@pytest.mark.parametrize("size", ["1m", "997b", "67b"])
def test_array_file_in_ranges_equals_the_one_task_reader(spark, tmp_dir, size):
    rnd = random.Random(size)
    bits = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "漢", " ", "\n", "\t", "a", "\\\\", '\\"', "}},{", "\U0001f600"]
    path = os.path.join(tmp_dir, "feed.json")
    n = {"1m": 300, "997b": 100, "67b": 10}[size]
    rows = [{"filename": f"{i}.jpg", "description": "".join(rnd.choices(bits, k=rnd.randint(0, 60))), "brand": rnd.choice(bits),
             "extra": {"a": [1, {"b": "}]"}, []], "c": {}}} for i in range(n)]
    with open(path, "w") as f:
        json.dump(rows, f, indent=rnd.choice([None, 2]), ensure_ascii=rnd.random() < 0.5)
    want = whole_array(spark, path)
    assert len(want) == n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        tasks = ja._fragments(spark, path).rdd.getNumPartitions()
        good, bad = ja.read_array(spark, path)
        assert sorted((r.filename, r.description, r.brand) for r in good.collect()) == want and bad.collect() == []
        assert tasks == 1 if size == "1m" else tasks > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text, names, rejects", [
    ("", [], []), ("[]", [], []), (" [ \n ] ", [], []), ('[{"filename": "a"}]', ["a"], []),
    ('[{"filename": "a"},\n 5, "x,}", [1, {"filename": "n"}], null, {"brand": "b"}, {"filename": "z"}]\n', ["a", "z"],
     ["5", '"x,}"', '[1, {"filename": "n"}]', "null", '{"brand": "b"}']),
    ('[{"filename": "a"}, {"filename": "b", "brand": "cut', ["a"], ['{"filename": "b", "brand": "cut']),
    ('[{"filename": "a"}] later', ["a"], ["later"]),
    ('[{"filename": "a", "brand": 5 5}, {"filename": "b"}]', ["b"], ['{"filename": "a", "brand": 5 5}'])])
def test_array_borders(spark, tmp_dir, text, names, rejects):
    path = os.path.join(tmp_dir, "feed.json")
    with open(path, "w") as f:
        f.write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1m", "37b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            good, bad = ja.read_array(spark, tmp_dir)
            assert sorted(r.filename for r in good.collect()) == names
            assert sorted(r.record.strip() for r in bad.collect()) == sorted(rejects)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
