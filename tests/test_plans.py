"""Plan guards over every registered query (scale properties, not values)."""

import pytest

import __spark_entry__ as E
from binsight.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
PYTHON_OK = {"classify_batch", "enrich_batch", "stream_ingest"}
STREAMS = {"stream_composition", "stream_ingest", "stream_files", "stream_dedupe", "stream_lifecycle", "stream_top_brands"}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMS))
def test_no_forbidden_operators(spark, key):
    text = plan_text(QUERIES[key](spark, SF))
    for op in FORBIDDEN:
        assert op not in text, f"{key} plans {op}"
    if key not in PYTHON_OK:
        assert "MapInPandas" not in text and "PythonUDF" not in text


def test_scans_are_pruned(spark):
    df = E.queries()["composition_by_hour"](spark, SF)
    scans = [s for s in plan_text(df).splitlines() if "FileScan" in s]
    part = [s for s in scans if "part.parquet" in s]
    events = [s for s in scans if "events.parquet" in s]
    assert part and "ReadSchema: struct<p_partkey:bigint>" in part[0]
    assert events and "ReadSchema: struct<ts:timestamp_ntz,event_type:string,props:string>" in events[0]


def test_small_dimension_broadcast_and_partial_aggregation(spark):
    df = E.queries()["composition_by_brand"](spark, SF)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text
    assert "partial_count" in text


def test_merge_reads_only_the_touched_dates(spark, tmp_dir):
    from pyspark.sql import functions as F

    from binsight.operators.merge import merge_update
    from binsight.sources import driver_tables as dt
    from binsight.sources import table as tb
    tb.append(spark, dt.items(spark, SF), f"{tmp_dir}/items", partitioned=True)
    day = F.lit("2024-01-01").cast("date")
    target = tb.read_table(spark, f"{tmp_dir}/items", keep_partition=True).filter(F.col(tb.PARTITION_COL).isin(day))
    answers = spark.createDataFrame([("1.jpg", "x")], "filename string, description string")
    text = plan_text(merge_update(target, answers, columns=["description"]))
    scans = [s for s in text.splitlines() if "FileScan" in s]
    assert scans and all("PartitionFilters: [" in s and tb.PARTITION_COL in s.split("PartitionFilters: ")[1] for s in scans)
    for op in FORBIDDEN:
        assert op not in text
