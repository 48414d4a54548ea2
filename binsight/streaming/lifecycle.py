"""The life of an item in one stream: arrived -> asked -> described, or rejected ->
asked again after a while -> ... -> given up.

The state of an item (``transformWithState``, RocksDB) is its status and how often
it was asked. A rejected answer, or one that never came, sets a timer; when it
expires the item is asked again, the waiting time doubling each time.

Each call of the state takes a round trip between Python and the JVM, so the state is
kept for buckets of names: a batch reads and writes a bucket's open items at once, and
a bucket has one timer, for the first of its items that is due. Of the items that are
done only the names stay, read when something arrives.

The stream reads two folders: arrivals, and the outcomes that its own batches
write. A batch appends the items that arrived, asks the provider about the items
that are due, stores the answers, merges the valid ones, and writes an outcome for
each item asked. A repeated batch (after a crash) finds what it stored: it appends
nothing twice, does not ask again and writes no second outcome. An outcome
names the try that it belongs to, so one that comes late or twice changes nothing.
"""

from __future__ import annotations

import base64
import json
import time as _time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from binsight.operators import enrich as en
from binsight.operators import ingest as ing
from binsight.plans import jobs
from binsight.session import ship_package
from binsight.sources import table as tb
from binsight.streaming.dedupe import rocksdb_state

#: An arrival (``attempt`` 0) or the outcome of a try.
EVENT = "filename string, time timestamp_ntz, event string, attempt int"
ARRIVED, DESCRIBED, REJECTED = "arrived", "described", "rejected"
#: What a batch has to do: ``ask`` (``attempt`` counts from 1) or note ``given up``.
_DUE = "filename string, time timestamp_ntz, action string, attempt int"
ASK, GIVEN_UP = "ask", "given up"
_ASKED, _WAITING = "asked", "waiting"
#: Of names; a stream's checkpoint holds for one number of buckets.
BUCKETS = 1 << 16


class ItemCycle(StatefulProcessor):
    """State machine of the items of one bucket; see the module's text."""

    def __init__(self, wait_ms: int, lost_ms: int, most: int):
        self.wait_ms, self.lost_ms, self.most = wait_ms, max(lost_ms, 1), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "filename array<string>, status array<string>, attempt array<int>, "
                                                 "time array<timestamp_ntz>, due array<bigint>")
        self.done = handle.getListState("done", "filenames array<string>")

    def _items(self) -> dict:
        """(status, attempt, time, due) of each open item."""
        names, *columns = self.open.get() or [[]]
        return dict(zip(names, zip(*columns)))

    def _store(self, items: dict, settled: list, fired: int | None = None) -> None:
        """``fired``: the timer that is being handled, which Spark removes."""
        if items:
            self.open.update((list(items), *map(list, zip(*items.values()))))
        else:
            self.open.clear()
        if settled:
            self.done.appendValue((settled,))
        first = min((due for *_, due in items.values()), default=None)
        timers = set(self.handle.listTimers())
        for old in timers - {first, fired}:
            self.handle.deleteTimer(old)
        if first is not None and first not in timers:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        items, done, settled, changed = self._items(), None, {}, False
        for row in rows:
            name, time, event, attempt = row.filename, row.time, row.event, row.attempt
            item = items.get(name)
            if event == ARRIVED:
                if item is None and name not in settled:  # a repeated arrival changes nothing
                    if done is None:
                        done = {n for names, in self.done.get() for n in names}
                    if name not in done:
                        items[name] = (_ASKED, 1, time, now + self.lost_ms)
                        changed = True
                        yield Row(filename=name, time=time, action=ASK, attempt=1)
            elif item is not None and item[0] == _ASKED and item[1] == attempt:
                changed = True
                if event == REJECTED and attempt < self.most:
                    items[name] = (_WAITING, attempt, item[2], now + self.wait_ms * 2 ** (attempt - 1))
                    continue
                if event == REJECTED:
                    yield Row(filename=name, time=item[2], action=GIVEN_UP, attempt=attempt)
                del items[name]
                settled[name] = True
        if changed:
            self._store(items, list(settled))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        items, settled = self._items(), []
        for name, (_status, attempt, time, due) in list(items.items()):
            if due > now:
                continue
            if attempt < self.most:
                items[name] = (_ASKED, attempt + 1, time, now + self.lost_ms)
                yield Row(filename=name, time=time, action=ASK, attempt=attempt + 1)
            else:  # the last answer never came
                del items[name]
                settled.append(name)
                yield Row(filename=name, time=time, action=GIVEN_UP, attempt=attempt)
        self._store(items, settled, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def due_items(events: DataFrame, wait_s: float = 60.0, lost_s: float = 3600.0, most: int = 5,
              buckets: int = BUCKETS) -> DataFrame:
    """Stream of (filename, time, action, attempt) from a stream of ``EVENT`` rows: what is
    to be asked now, and what is given up after ``most`` tries. ``wait_s`` is
    the time until the second try, ``lost_s`` the time after which an answer
    that did not come counts as rejected. The state is kept for ``buckets`` of names."""
    ship_package(events.sparkSession)
    cycle = ItemCycle(int(wait_s * 1000), int(lost_s * 1000), most)
    bucket = F.pmod(F.xxhash64("filename"), F.lit(buckets)).alias("bucket")
    return (events.filter(F.col("filename").isNotNull()).select("*", bucket).groupBy("bucket")
            .transformWithState(cycle, _DUE, "Append", "ProcessingTime"))


def _by_name(due: DataFrame) -> DataFrame:
    """Stand-in for reading the images: the file name and the try as content."""
    content = F.concat_ws("#", "filename", F.col("attempt").cast("string")).cast("binary")
    return due.select("filename", content.alias("content"))


def run_batch(spark: SparkSession, batch: DataFrame, epoch_id: int, table: str, outcomes: str, work_dir: str,
              provider_factory: Callable, contents: Callable[[DataFrame], DataFrame] = _by_name,
              partitioned: bool = False, **provider_kw) -> None:
    """One batch of due items; ``contents`` gives (filename, content) for rows to be asked."""
    path, answers = f"{work_dir}/due/epoch={epoch_id}", f"{work_dir}/answers/epoch={epoch_id}"
    # also when repeated: the batch's time comes from the checkpoint, so do the same items,
    # and the state is only carried on by a batch that is run
    batch.write.mode("overwrite").parquet(path)
    due = spark.read.schema(_DUE).parquet(path)
    if not due.isEmpty():
        first = due.filter((F.col("action") == ASK) & (F.col("attempt") == 1)).select("filename", "time")
        jobs.append_new(spark, ing.with_ingest_defaults(first), table, partitioned=partitioned)
        asked = due.filter(F.col("action") == ASK)
        if not tb.committed(spark, answers):
            en.ask(contents(asked), provider_factory, **provider_kw).write.mode("overwrite").parquet(answers)
        ok, _ = en.split_answers(spark.read.parquet(answers))
        jobs.merge_answers(spark, table, ok)
        told = f"{outcomes}/epoch={epoch_id}"
        if not tb.committed(spark, told):
            good = ok.select("filename", F.lit(DESCRIBED).alias("event"))
            (asked.join(good, "filename", "left")
             .select("filename", "time", F.coalesce("event", F.lit(REJECTED)).alias("event"), "attempt")
             .write.mode("overwrite").parquet(told))
    for old in ("due", "answers"):  # an epoch before the last is never repeated
        tb.delete(spark, f"{work_dir}/{old}/epoch={epoch_id - 2}")


def start_lifecycle(arrivals: DataFrame, table: str, checkpoint: str, work_dir: str, provider_factory: Callable,
                    wait_s: float = 60.0, lost_s: float = 3600.0, most: int = 5, trigger: dict | None = None,
                    buckets: int = BUCKETS, **kw):
    """Start the stream over ``arrivals`` (``filename, time``); it runs until it is stopped
    (``streaming.drain_and_stop``), by default with a batch every ten seconds."""
    spark = arrivals.sparkSession
    outcomes = f"{work_dir.rstrip('/')}/outcomes"
    first = f"{outcomes}/epoch=-1"  # the folder has to exist
    if not tb.committed(spark, first):
        spark.createDataFrame([], EVENT).write.mode("overwrite").parquet(first)
    told = spark.readStream.schema(EVENT).option("basePath", outcomes).parquet(f"{outcomes}/epoch=*").select(
        "filename", "time", "event", "attempt")
    arrived = arrivals.select("filename", F.col("time").cast("timestamp_ntz").alias("time"), F.lit(ARRIVED).alias("event"),
                              F.lit(0).alias("attempt"))

    def run(batch, epoch_id):
        run_batch(spark, batch, epoch_id, table, outcomes, work_dir.rstrip("/"), provider_factory, **kw)

    due = due_items(arrived.union(told), wait_s, lost_s, most, buckets)
    writer = due.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append")
    with rocksdb_state(spark):
        return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


class SecondTry:
    """Deterministic stand-in provider for ``_by_name`` contents: answers by the number in the
    file name, one in five only at the second try."""

    def __call__(self, filename: str, request: str) -> str:
        url = json.loads(request)["messages"][0]["content"][1]["image_url"]["url"]
        attempt = int(base64.b64decode(url.split(",", 1)[1]).decode().rsplit("#", 1)[1])
        n = int(filename.split(".", 1)[0])
        if n % 5 == 0 and attempt < 2:
            return "Sorry, I cannot see anything."
        return json.dumps({"is_recyclable": n % 2 == 0, "is_compostable": n % 3 == 0, "is_metal": n % 7 == 0,
                           "brand": f"Brand#{n % 25 + 1}", "description": f"item {n}, try {attempt}"})


def described(spark: SparkSession, work_dir: str) -> DataFrame:
    """Names of the items whose answer has been merged. An outcome is written after its
    batch's merge, so this never touches a table that a batch is about to replace."""
    told = spark.read.schema(EVENT).option("basePath", f"{work_dir}/outcomes").parquet(f"{work_dir}/outcomes/epoch=*")
    return told.filter(F.col("event") == DESCRIBED).select("filename").distinct()


def wait_described(query, spark: SparkSession, work_dir: str, expected: int, stuck_s: float = 600.0,
                   stuck_batches: int = 60) -> None:
    """Wait until ``expected`` items of a running stream are described. Raises if the stream
    ends before, or if nothing more was described for ``stuck_s`` and in ``stuck_batches``
    batches: one batch takes as long as what arrived needs, however much that is. Outcomes
    are counted whenever a batch has written some."""
    told = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir}/outcomes/epoch=*/_SUCCESS")
    files = told.getFileSystem(spark._jsc.hadoopConfiguration())
    written, done, since, first = -1, -1, _time.monotonic(), -1
    while True:
        active = query.isActive  # asked before the outcomes are counted: an ended stream writes no more
        progress = query.lastProgress
        batch = progress["batchId"] if progress else -1
        before, written = written, len(files.globStatus(told))
        if written != before:
            before, done = done, described(spark, work_dir).count()
            if done > before:
                since, first = _time.monotonic(), batch
        if done >= expected:
            return
        if not active:
            raise RuntimeError(str(query.exception() or f"the stream ended with {done} of {expected} items described"))
        if _time.monotonic() - since > stuck_s and batch - first >= stuck_batches:
            raise TimeoutError(f"no more items described for {stuck_s:.0f} s and {batch - first} batches: {done} of {expected}")
        _time.sleep(1)


def unsettled(spark: SparkSession, work_dir: str) -> DataFrame:
    """Items asked so far whose last known outcome is a rejection."""
    told = spark.read.schema(EVENT).option("basePath", f"{work_dir}/outcomes").parquet(f"{work_dir}/outcomes/epoch=*")
    last = told.groupBy("filename").agg(F.max(F.struct("attempt", "event")).alias("last"))
    return last.filter(F.col("last.event") == REJECTED).select("filename", "last.attempt")
