"""Widening feeds, answers by content, files by name, top values of a stream, SQL with arguments."""

import os

import pytest
from pyspark.sql import functions as F

from binsight.operators import by_content as bc
from binsight.plans import item_sql
from binsight.session import scratch_path
from binsight.sources import generations as gen
from binsight.sources import table as tb
from binsight.sources.named_files import read_named

SF = "/root/testdata/sf0.001"


def frame(spark, kind, *rows, extra=""):
    return spark.createDataFrame(rows, f"filename string, v {kind}{extra}")


def test_appends_of_wider_types_read_back_exactly(spark):
    base = scratch_path(spark, "wide")
    assert gen.append(spark, frame(spark, "int", ("a", 1), ("b", None)), base) == 0
    assert gen.append(spark, frame(spark, "bigint", ("c", 2 ** 40)), base) == 1
    assert gen.append(spark, frame(spark, "bigint", ("d", 7, "new"), extra=", w string"), base) == 1
    got = {r.filename: (r.v, r.w) for r in gen.read(spark, base).collect()}
    assert got == {"a": (1, None), "b": (None, None), "c": (2 ** 40, None), "d": (7, "new")}
    assert gen.append(spark, frame(spark, "double", ("e", 0.5)), base) == 2  # w is missing: NULL
    assert dict(gen.read(spark, base).dtypes) == {"filename": "string", "v": "double", "w": "string"}
    assert {r.filename: r.v for r in gen.read(spark, base).collect()} == {"a": 1.0, "b": None, "c": 2.0 ** 40, "d": 7.0, "e": 0.5}
    for kind, value in (("int", 1), ("bigint", 1), ("string", "x"), ("boolean", True)):
        with pytest.raises(tb.SchemaConflictError):
            gen.append(spark, frame(spark, kind, ("z", value)), base)
    assert gen.read(spark, base).count() == 5


def test_integers_that_are_no_doubles_keep_the_type(spark):
    base = scratch_path(spark, "wide")
    gen.append(spark, frame(spark, "bigint", ("a", 2 ** 53 + 1)), base)
    with pytest.raises(tb.SchemaConflictError):
        gen.append(spark, frame(spark, "double", ("b", 0.5)), base)
    assert [r.v for r in gen.read(spark, base).collect()] == [2 ** 53 + 1]
    with pytest.raises(tb.TableMissingError):
        gen.read(spark, scratch_path(spark, "none"))


def test_integers_beyond_2_53_widen_if_they_are_doubles(spark):
    base = scratch_path(spark, "wide")
    exact = [2 ** 53 + 2, 6_000_001 * 4_000_000_000, -(2 ** 60), 2 ** 63 - 1024, -(2 ** 63), None]
    gen.append(spark, frame(spark, "bigint", *((str(v), v) for v in exact)), base)
    assert gen.append(spark, frame(spark, "double", ("x", 0.5)), base) == 1
    got = {r.filename: r.v for r in gen.read(spark, base).collect()}
    assert got == {"x": 0.5} | {str(v): v if v is None else float(v) for v in exact}
    for v in (2 ** 53 + 1, -(2 ** 53) - 1, 2 ** 60 + 1, 2 ** 63 - 1, 2 ** 63 - 511, -(2 ** 63) + 1):
        base = scratch_path(spark, "wide")
        gen.append(spark, frame(spark, "bigint", ("a", 1), ("b", v)), base)
        with pytest.raises(tb.SchemaConflictError):
            gen.append(spark, frame(spark, "double", ("x", 0.5)), base)


def test_equal_images_are_asked_once_also_by_a_failed_task(spark, tmp_dir):
    calls = os.path.join(tmp_dir, "calls")
    os.makedirs(calls)

    def factory():
        def call(sha, request):
            import uuid
            open(os.path.join(calls, f"{sha[:8]}-{uuid.uuid4().hex}"), "w").close()
            if len(os.listdir(calls)) == 3:
                raise ConnectionError("once")
            return bc.SizeProvider()(sha, request)
        return call

    images = spark.createDataFrame([(f"{i}.jpg", bytes([i % 4]) * (1 + i % 4)) for i in range(40)], "filename string, content binary")
    names, contents = images.select("filename"), lambda n: images.join(n, "filename", "left_semi")
    answers = scratch_path(spark, "answers")
    # a task that fails after some calls, and the job that is repeated
    with pytest.raises(Exception, match="once"):
        bc.describe(names, contents, answers, factory, retries=1, strict=True, backoff_s=0.0)
    ok, bad = bc.describe(names, contents, answers, factory, retries=1, strict=True, backoff_s=0.0)
    rows = {r.filename: r.description for r in ok.collect()}
    assert rows == {f"{i}.jpg": f"{1 + i % 4} bytes" for i in range(40)} and bad.count() == 0
    assert len(os.listdir(calls)) == 5  # four contents, one call that failed
    more = spark.createDataFrame([("new.jpg", bytes([2]) * 3), ("other.jpg", b"other")], "filename string, content binary")
    ok, _ = bc.describe(more.select("filename"), lambda n: more.join(n, "filename", "left_semi"), answers, factory, backoff_s=0.0)
    assert {r.filename: r.description for r in ok.collect()} == {"new.jpg": "3 bytes", "other.jpg": "5 bytes"}
    assert len(os.listdir(calls)) == 6


def test_the_journal_has_few_files_and_a_repeated_job_asks_for_the_rest_only(spark, tmp_dir, monkeypatch):
    calls = os.path.join(tmp_dir, "calls")

    def factory():
        def call(sha, request):
            with open(calls, "a") as f:
                f.write(f"{sha}\n")
            if os.path.getsize(calls) == 65 * 800:
                raise ConnectionError("once")
            return bc.SizeProvider()(sha, request)
        return call

    def segments(folder):
        return [os.path.join(at, x) for at, _, found in os.walk(folder.removeprefix("file:")) for x in found]

    images = spark.createDataFrame([(f"{i}.jpg", b"%d" % i) for i in range(1000)], "filename string, content binary")
    names, contents = images.select("filename"), lambda n: images.join(n, "filename", "left_semi")
    answers, seen = scratch_path(spark, "answers"), []
    with pytest.raises(Exception, match="once"):
        bc.describe(names, contents, answers, factory, retries=1, strict=True, backoff_s=0.0)
    kept = segments(f"{answers}-journal")
    noted = sum(open(f).read().count("\n") for f in kept)
    assert noted >= 799 > len(kept)
    with open(kept[0]) as f:
        whole = f.readline()
    with open(kept[0], "a") as f:  # a task that broke off inside a line
        f.write(f"{'0' * 64} {whole.split(' ')[1][:-8]}")
    monkeypatch.setattr(bc.tb, "delete", lambda spark, path: seen.append(segments(path)))
    ok, bad = bc.describe(names, contents, answers, factory, retries=1, strict=True, backoff_s=0.0)
    assert {r.filename: r.description for r in ok.collect()} == {f"{i}.jpg": f"{len(str(i))} bytes" for i in range(1000)}
    assert bad.count() == 0 and len(seen) == 1 and len(seen[0]) < 200
    with open(calls) as f:
        asked = f.read().split()
    assert len(asked) == 1001 and len(set(asked)) == 1000  # one call failed


def test_invalid_answers_are_not_kept(spark):
    images = spark.createDataFrame([("1.jpg", b"x"), ("2.jpg", b"x")], "filename string, content binary")
    args = (images.select("filename"), lambda n: images.join(n, "filename", "left_semi"), scratch_path(spark, "answers"))
    ok, bad = bc.describe(*args, lambda: lambda sha, request: "no idea", backoff_s=0.0)
    assert ok.count() == 0 and sorted(r.filename for r in bad.collect()) == ["1.jpg", "2.jpg"]
    ok, bad = bc.describe(*args, bc.SizeProvider, backoff_s=0.0)
    assert ok.count() == 2 and bad.count() == 0


def test_named_files_are_opened_by_the_tasks(spark, tmp_dir):
    for i in range(5):
        with open(os.path.join(tmp_dir, f"{i}.jpg"), "wb") as f:
            f.write(b"x" * i)
    paths = spark.createDataFrame([(f"file:{tmp_dir}/{i}.jpg",) for i in (1, 3)], "path string")
    assert sorted((r.filename, bytes(r.content)) for r in read_named(paths).collect()) == [("1.jpg", b"x"), ("3.jpg", b"xxx")]
    with pytest.raises(Exception, match="9.jpg"):
        read_named(spark.createDataFrame([(f"file:{tmp_dir}/9.jpg",)], "path string")).collect()


def test_top_values_are_proven_or_counted(spark, tmp_dir):
    from binsight.streaming.top_stream import start_top, top_values
    folder, out, ckpt = os.path.join(tmp_dir, "in"), scratch_path(spark, "top"), scratch_path(spark, "top-ckpt")
    rows = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("b"), F.col("id") % 12)).when(
        F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("rare"), "id")).alias("brand"))

    def run(df):
        df.coalesce(2).write.mode("append").parquet(folder)
        q = start_top(spark.readStream.schema("brand string").parquet(folder), "brand", out, ckpt)
        q.awaitTermination()
        assert q.exception() is None
        return spark.read.schema("brand string").parquet(folder)

    for part in (rows.limit(10_000), rows):  # the sketch goes on after a restart
        stored = run(part)
        want = stored.groupBy("brand").count().orderBy(F.desc("count"), F.asc_nulls_first("brand"))
        top, proven = top_values(spark, out, stored, "brand", 7)
        assert [tuple(r) for r in top.collect()] == [tuple(r) for r in want.limit(7).collect()] and proven
        top, proven = top_values(spark, out, stored, "brand", 9)  # the rest are ties of one
        assert [tuple(r) for r in top.collect()] == [tuple(r) for r in want.limit(9).collect()] and not proven


def test_sql_arguments_are_values(spark):
    from binsight.sources.driver_tables import items
    item_sql.register(spark, items(spark, SF))
    hostile = "x' OR '1'='1'; DROP VIEW items; --"
    assert item_sql.of_brand(spark, hostile).count() == 0
    every = spark.table("items")
    assert item_sql.of_brand(spark, "Brand#19").count() == every.filter("brand = 'Brand#19'").count() > 0
    assert item_sql.of_brand(spark, None).count() == every.filter("brand IS NULL").count() > 0
    got = {r.key: r["count"] for r in item_sql.count_by(spark, "brand").collect()}
    assert got == {r.brand: r["count"] for r in every.groupBy("brand").count().collect()}
    for key in ("brand; DROP VIEW items", "1", "brand, city", "nothing"):
        with pytest.raises(ValueError):
            item_sql.count_by(spark, key)
    item_sql.register(spark, items(spark, SF).filter("brand = 'Brand#19'"))  # again, over other items
    assert item_sql.of_brand(spark, "Brand#18").count() == 0


def test_a_larger_feed_has_more_array_files_and_larger_ranges(spark, tmp_dir, monkeypatch):
    import glob
    import json
    from binsight.plans import catalogue
    spark.range(900).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 10:00:00' AS ts", "'view' AS event_type",
                                "concat('{\"k\": ', id % 3, '}') AS props").write.parquet(f"{tmp_dir}/events.parquet")
    spark.range(3).selectExpr("id AS p_partkey", "concat('red anvil ', id) AS p_name", "'Brand#1' AS p_brand").write.parquet(
        f"{tmp_dir}/part.parquet")
    monkeypatch.setattr(catalogue, "FEED_ROWS", 100)
    path = catalogue._array_feed(spark, tmp_dir)
    arrays = [json.load(open(f)) for f in glob.glob(f"{path}/file=*/part-*")]
    assert len(arrays) == 9 and all(a[-1] == {"brand": "end"} for a in arrays)
    assert sorted(int(x["filename"][:-4]) for a in arrays for x in a[:-1]) == list(range(900))
    assert catalogue._range_size(spark, path) == 64 << 10
    monkeypatch.setattr(catalogue, "FEED_RANGES", 1)
    assert catalogue._range_size(spark, path) > 64 << 10
    rows = catalogue.QUERIES["json_array_feed"](spark, tmp_dir).collect()
    assert sorted(int(r.filename[:-4]) for r in rows) == list(range(900))
