import json
import os

import pytest
from pyspark.sql import functions as F

from binsight.operators.ingest import new_only, shape_feed, union_by_name
from binsight.operators.merge import DUPLICATE, DuplicateKeyError, assert_unique_keys, merge_update
from binsight.plans import jobs
from binsight.sources import table as tb
from binsight.sources.json_items import read_json_items

KEYS = "filename string, v int"


def test_anti_join_null_and_duplicates(spark):
    inc = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], KEYS)
    ex = spark.createDataFrame([("b", 0), (None, 0)], KEYS)
    got = sorted((r.filename or "", r.v) for r in new_only(inc, ex).collect())
    assert got == [("", 3), ("a", 1), ("a", 2)]
    got = sorted((r.filename or "", r.v) for r in new_only(inc, ex, dedupe=True).collect())
    assert len(got) == 2


def test_anti_join_without_broadcast(spark):
    inc = spark.range(0, 2000).select(F.col("id").cast("string").alias("filename"))
    ex = spark.range(500, 5000).select(F.col("id").cast("string").alias("filename"))
    small = {r.filename for r in new_only(inc, ex).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = {r.filename for r in new_only(inc, ex).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert small == big == {str(i) for i in range(500)}


def test_anti_join_splits_a_hot_key_and_sets_null_keys_aside(spark):
    hot = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for k, v in hot.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60_000, 1, 12).select(
            F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string"))
            .alias("filename"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        known = spark.range(0, 5000).select(F.col("id").cast("string").alias("filename"))
        out = new_only(rows, known)
        assert out.count() == 60_000 - sum(1 for i in range(5000) if i % 3 == 2)
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in hot:
            spark.conf.unset(k)


def test_union_by_name_schema_evolution(spark):
    a = spark.createDataFrame([("x", 1)], KEYS)
    b = spark.createDataFrame([("y", "new")], "filename string, extra string")
    out = union_by_name(a, b)
    assert out.columns == ["filename", "v", "extra"]
    assert {(r.filename, r.v, r.extra) for r in out.collect()} == {("x", 1, None), ("y", None, "new")}


def test_merge_semantics(spark):
    target = spark.createDataFrame([("a", "", None, "keep"), ("b", "", True, "keep"), ("c", "old", False, "keep")],
                                   "filename string, description string, is_metal boolean, city string")
    source = spark.createDataFrame([("a", "cup", True), ("b", "can", None), ("z", "ghost", True)],
                                   "filename string, description string, is_metal boolean")
    out = {r.filename: r for r in merge_update(target, source, columns=["description", "is_metal"]).collect()}
    assert len(out) == 3 and "z" not in out
    assert (out["a"].description, out["a"].is_metal) == ("cup", True)
    assert out["b"].is_metal is None  # NULL new value overwrites
    assert (out["c"].description, out["c"].is_metal) == ("old", False)
    assert all(r.city == "keep" for r in out.values())
    dup = source.unionByName(source.limit(1))
    with pytest.raises(Exception, match=DUPLICATE):
        merge_update(target, dup, columns=["description", "is_metal"]).collect()
    with pytest.raises(DuplicateKeyError):
        assert_unique_keys(dup, "filename")


def _write_images(d):
    os.makedirs(os.path.join(d, "sub"), exist_ok=True)
    for name, data in [("a.jpg", b"\xff\xd8abc"), ("b.png", b"\x89PNG"), (".hidden", b"x"), ("_temp", b"x"),
                       ("empty.jpg", b""), ("sub/deep.jpg", b"x")]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)


def test_ingest_images_twice_is_once(spark, tmp_dir):
    img, table = os.path.join(tmp_dir, "images"), os.path.join(tmp_dir, "items")
    _write_images(img)
    jobs.ingest_images(spark, img, table)
    first = tb.read_table(spark, table)
    names = sorted(r.filename for r in first.collect())
    # hidden/underscore files, sub-directories and zero-length files are skipped by the file source
    assert names == ["a.jpg", "b.png"]
    row = first.filter("filename = 'a.jpg'").first()
    assert (row.state, row.city, row.description, row.brand, row.is_metal) == ("NJ", "Princeton", "", "", None)
    jobs.ingest_images(spark, img, table)
    assert tb.read_table(spark, table).count() == 2
    with open(os.path.join(img, "c.jpg"), "wb") as f:
        f.write(b"new")
    jobs.ingest_images(spark, img, table)
    assert tb.read_table(spark, table).count() == 3


def test_json_feed_array_lines_and_bad_time(spark, tmp_dir):
    arr = os.path.join(tmp_dir, "feed.json")
    rows = [{"filename": "0.jpg", "time": "2024-11-09T07:19:50", "brand": "Amazon", "extra": 1},
            {"filename": "1.jpg", "time": "garbage", "is_metal": True}]
    with open(arr, "w") as f:
        json.dump(rows, f, indent=2)
    lines = os.path.join(tmp_dir, "feed.jsonl")
    with open(lines, "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    a = shape_feed(read_json_items(spark, arr)).collect()
    b = shape_feed(read_json_items(spark, lines, multiline=False)).collect()
    assert len(a) == len(b) == 2
    by = {r.filename: r for r in a}
    assert by["0.jpg"].extra == 1 and by["1.jpg"].extra is None
    assert by["0.jpg"].time is not None and by["1.jpg"].time is None
    assert by["0.jpg"].state is None and by["1.jpg"].is_metal is True
    with pytest.raises(Exception):
        shape_feed(read_json_items(spark, arr), strict_time=True).collect()


def test_load_json_items_anti_join_and_schema_conflict(spark, tmp_dir):
    path, table = os.path.join(tmp_dir, "f.json"), os.path.join(tmp_dir, "items")
    with open(path, "w") as f:
        json.dump([{"filename": f"{i}.jpg", "time": "2024-01-01T00:00:00", "brand": "x"} for i in range(5)], f)
    jobs.load_json_items(spark, path, table)
    jobs.load_json_items(spark, path, table)
    assert tb.read_table(spark, table).count() == 5
    bad = spark.createDataFrame([("9.jpg", 1)], "filename string, brand int")
    with pytest.raises(tb.SchemaConflictError):
        tb.append(spark, bad, table)


def test_merge_null_target_keys_untouched(spark):
    target = spark.createDataFrame([(None, "x"), (None, "y"), ("a", "")], "filename string, description string")
    source = spark.createDataFrame([("a", "cup"), (None, "ghost")], "filename string, description string")
    out = sorted((r.filename or "", r.description) for r in
                 merge_update(target, source, columns=["description"]).collect())
    assert out == [("", "x"), ("", "y"), ("a", "cup")]


def test_json_export_round_trip(spark, tmp_dir):
    from binsight.operators.synth import synth_range
    from binsight.sources.json_items import write_json_items
    end = F.lit("2024-11-09 12:00:00").cast("timestamp_ntz")
    items = synth_range(spark, 500, end, partitions=4)
    out = os.path.join(tmp_dir, "feed")
    write_json_items(items, out)
    back = shape_feed(read_json_items(spark, out, multiline=False))
    assert back.count() == 500
    a = {(r.filename, str(r.time), r.brand, r.is_metal) for r in items.collect()}
    b = {(r.filename, str(r.time), r.brand, r.is_metal) for r in back.collect()}
    assert a == b


def test_partition_scoped_merge_rewrites_touched_dates_only(spark, tmp_dir):
    import glob
    import json as _json
    img, table = os.path.join(tmp_dir, "images"), os.path.join(tmp_dir, "items")
    os.makedirs(img)
    for name, ts in [("old1.jpg", 1_600_000_000), ("old2.jpg", 1_600_000_100), ("new.jpg", 1_700_000_000)]:
        path = os.path.join(img, name)
        with open(path, "wb") as f:
            f.write(b"x" + name.encode())
        os.utime(path, (ts, ts))
    jobs.ingest_images(spark, img, table, partitioned=True)
    assert tb.is_partitioned(spark, table)
    snap = tb.location(spark, table).removeprefix("file:")
    dirs = sorted(os.path.basename(d) for d in glob.glob(f"{snap}/capture_date=*"))
    assert dirs == ["capture_date=2020-09-13", "capture_date=2023-11-14"]
    # enrich the old day first, by hand: mark the new image as already described
    old_files = sorted(glob.glob(f"{snap}/capture_date=2020-09-13/*.parquet"))

    class Answer:
        def __call__(self, filename, request):
            return _json.dumps({"is_recyclable": True, "is_compostable": False, "is_metal": False,
                                "brand": "B", "description": f"d {filename}"})

    n, bad = jobs.enrich_pending(spark, table, img, Answer, backoff_s=0.0)
    assert n == 0 and bad.count() == 0
    rows = {r.filename: r for r in tb.read_table(spark, table).collect()}
    assert len(rows) == 3 and all(r.brand == "B" for r in rows.values())
    assert "capture_date" not in tb.read_table(spark, table).columns
    # nothing pending any more; a new image on a new day touches only its own partition
    assert jobs.enrich_pending(spark, table, img, Answer)[0] == -1
    path = os.path.join(img, "later.jpg")
    with open(path, "wb") as f:
        f.write(b"later")
    os.utime(path, (1_700_500_000, 1_700_500_000))
    jobs.ingest_images(spark, img, table)
    before_old = sorted(glob.glob(f"{snap}/capture_date=2020-09-13/*.parquet"))
    jobs.enrich_pending(spark, table, img, Answer, backoff_s=0.0)
    assert sorted(glob.glob(f"{snap}/capture_date=2020-09-13/*.parquet")) == before_old
    assert before_old != old_files  # the first merge did rewrite that day
    assert tb.read_table(spark, table).filter("brand = 'B'").count() == 4


def test_read_table_with_known_schema(spark, tmp_dir):
    from pyspark.sql import types as T
    table = os.path.join(tmp_dir, "t")
    tb.append(spark, spark.createDataFrame([("a", 1)], "filename string, v int"), table)
    tb.append(spark, spark.createDataFrame([("b", 2, "new")], "filename string, v int, extra string"), table)
    assert tb.read_table(spark, table).columns == ["filename", "v", "extra"]
    known = T.StructType([T.StructField("filename", T.StringType()), T.StructField("v", T.IntegerType())])
    got = sorted(tuple(r) for r in tb.read_table(spark, table, schema=known).collect())
    assert got == [("a", 1), ("b", 2)]


def test_feed_adds_a_column_and_keeps_bad_records_apart(spark, tmp_dir):
    feed, table = os.path.join(tmp_dir, "f.jsonl"), os.path.join(tmp_dir, "items")
    with open(feed, "w") as f:
        f.write('{"filename": "a.jpg", "time": "2024-01-01T00:00:00"}\n')
    jobs.load_json_items(spark, feed, table, multiline=False)
    with open(feed, "w") as f:
        f.write('{"filename": "b.jpg", "weight": 2.5}\nnot json\n{"brand": "x"}\n')
    for _ in range(2):
        rejects = jobs.load_json_items(spark, feed, table, multiline=False)
        assert {(r.record, r.reason) for r in rejects.collect()} == {("not json", "malformed"), ('{"brand":"x"}', "no filename")}
    got = {r.filename: r.weight for r in tb.read_table(spark, table).collect()}
    assert got == {"a.jpg": None, "b.jpg": 2.5}


def test_unmarked_folder_is_refused_and_missing_table_raises(spark, tmp_dir):
    table = os.path.join(tmp_dir, "items")
    with pytest.raises(tb.TableMissingError):
        tb.read_table(spark, table)
    df = spark.createDataFrame([("a", 1)], KEYS)
    tb.append(spark, df, table)
    where = tb.location(spark, table).removeprefix("file:")
    spark.sql(f"DROP TABLE {tb.name_of(table)}")  # as in a session whose catalog does not know it
    tb.append(spark, df, table)
    assert tb.read_table(spark, table).count() == 2
    spark.sql(f"DROP TABLE {tb.name_of(table)}")
    os.remove(os.path.join(where, "_SUCCESS"))
    with pytest.raises(tb.UnmarkedTableError):
        tb.append(spark, df, table)
    assert os.path.isdir(where)


DATED = "filename string, time timestamp, description string, is_recyclable boolean, is_compostable boolean, is_metal boolean, brand string"


def _dated(spark, *names):
    rows = [(n, "2024-01-0%d 10:00:00" % (1 + i % 2), "", None, None, None, "") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, DATED.replace("timestamp", "string")).withColumn("time", F.col("time").cast("timestamp"))


def _answers(spark, *names):
    return spark.createDataFrame([(n, f"thing {n}", True, False, False, "B") for n in names],
                                 "filename string, description string, is_recyclable boolean, is_compostable boolean, "
                                 "is_metal boolean, brand string")


def test_interrupted_swap_is_finished_from_the_staged_copy(spark, tmp_dir, monkeypatch):
    import shutil
    table = os.path.join(tmp_dir, "items")
    tb.append(spark, _dated(spark, "a", "b"), table, partitioned=True)

    def broken(spark_, table_):  # the overwrite removes a partition and dies
        shutil.rmtree(os.path.join(tb.location(spark, table_).removeprefix("file:"), "capture_date=2024-01-01"))
        raise RuntimeError("lost")

    overwrite = tb._overwrite
    monkeypatch.setattr(tb, "_overwrite", broken)
    with pytest.raises(RuntimeError, match="lost"):
        jobs.merge_answers(spark, table, _answers(spark, "a"))
    monkeypatch.setattr(tb, "_overwrite", overwrite)
    with pytest.raises(tb.MergePendingError):
        tb.read_table(spark, table, wait_s=0.1)
    with pytest.raises(tb.MergePendingError):
        tb.append(spark, _dated(spark, "c"), table, wait_s=0.1)
    assert tb.finish_merge(spark, table)
    got = {r.filename: r.description for r in tb.read_table(spark, table).collect()}
    assert got == {"a": "thing a", "b": ""}
    assert not tb.finish_merge(spark, table)


@pytest.mark.parametrize("partitioned", [True, False])
def test_rows_appended_during_a_merge_are_never_lost(spark, tmp_dir, monkeypatch, partitioned):
    table = os.path.join(tmp_dir, "items")
    tb.append(spark, _dated(spark, "a", "b"), table, partitioned=partitioned)
    grown = tb._grown

    def late(now, before):  # another writer, between the merged rows and the check
        if not late.done:
            late.done = True
            tb.append(spark, _dated(spark, "late"), table)
            now = tb.read_table(spark, table, keep_partition=True)
        return grown(now, before)

    late.done = False
    monkeypatch.setattr(tb, "_grown", late)
    with pytest.raises(tb.MergeConflictError):
        jobs.merge_answers(spark, table, _answers(spark, "a"))
    monkeypatch.undo()
    assert {r.filename for r in tb.read_table(spark, table).collect()} == {"a", "b", "late"}
    jobs.merge_answers(spark, table, _answers(spark, "a"))
    got = {r.filename: r.description for r in tb.read_table(spark, table).collect()}
    assert got == {"a": "thing a", "b": "", "late": ""}


def test_duplicate_answers_fail_the_public_merge(spark, tmp_dir):
    table = os.path.join(tmp_dir, "items")
    tb.append(spark, _dated(spark, "a", "b"), table)
    with pytest.raises(Exception, match=DUPLICATE):
        jobs.merge_answers(spark, table, _answers(spark, "a", "a"))
    assert tb.read_table(spark, table).count() == 2


def test_replace_keeps_so_many_snapshots(spark, tmp_dir):
    table = os.path.join(tmp_dir, "t")
    for i in range(4):
        tb.replace(spark, spark.createDataFrame([("a", i)], KEYS), table, keep=2)
    assert tb.versions(spark, table) == [2, 3] and tb.read_table(spark, table).first().v == 3


def test_only_pending_images_are_opened(spark, tmp_dir):
    img = os.path.join(tmp_dir, "images")
    os.makedirs(img)
    for i in range(12):
        with open(os.path.join(img, f"{i}.jpg"), "wb") as f:
            f.write(b"x")
    names = spark.createDataFrame([("3.jpg",), ("7.jpg",), ("none.jpg",)], "filename string")
    frames = list(jobs.pending_images(spark, names, img))
    assert sorted(os.path.basename(f) for df in frames for f in df.inputFiles()) == ["3.jpg", "7.jpg"]
    many = list(jobs.pending_images(spark, spark.createDataFrame([(f"{i}.jpg",) for i in range(12)], "filename string"), img, at_once=5))
    assert len(many) > 1 and sorted(r.filename for df in many for r in df.collect()) == sorted(f"{i}.jpg" for i in range(12))
