import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binsight.operators.composition import brand_total_label, composition, composition_long
from binsight.operators.prepare import exclusive_flags, fill_flags, normalize_brand, prepare
from binsight.operators.ranking import top_brands, waste_by_brand

SCHEMA = "filename string, time timestamp, brand string, is_recyclable boolean, is_compostable boolean"


def flags_frame(spark):
    vals = [True, False, None]
    rows = [(f"{i}.jpg", None, "", r, c) for i, (r, c) in enumerate(itertools.product(vals, vals))]
    return spark.createDataFrame(rows, SCHEMA)


def test_flags_exactly_one_true(spark):
    out = exclusive_flags(fill_flags(flags_frame(spark))).collect()
    assert len(out) == 9
    for r in out:
        assert [r.is_compostable, r.is_recyclable, r.is_trash].count(True) == 1
    # recyclable wins over compostable; NULL flags are trash
    by = {r.filename: r for r in out}
    assert by["0.jpg"].is_recyclable and not by["0.jpg"].is_compostable
    assert by["8.jpg"].is_trash


def test_brand_rule(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", " "), ("d", "Other")], "filename string, brand string")
    got = {r.filename: r.brand for r in normalize_brand(df).collect()}
    assert got == {"a": "Other", "b": None, "c": " ", "d": "Other"}


def test_composition_counts_and_shares(spark):
    df = prepare(flags_frame(spark).withColumn("time", F.lit("2024-01-01 05:30:00").cast("timestamp")))
    (row,) = composition(df, "hour").collect()
    assert row.hour == 5 and row.total_count == 9
    assert row.compostable_count + row.recyclable_count + row.trash_count == 9
    assert abs(row.compostable_pct + row.recyclable_pct + row.trash_pct - 100) < 1e-9


def test_null_brand_own_group_and_long_form(spark):
    df = spark.createDataFrame([("a", None, "x", None, None), ("b", None, None, True, None), ("c", None, "", None, True)],
                               SCHEMA)
    wide = composition(prepare(df), "brand", order=False)
    assert {r.brand for r in wide.collect()} == {"x", None, "Other"}
    long = composition_long(wide, ["brand", "total_count"])
    assert long.count() == 3 * wide.count()
    assert {r.Category for r in long.collect()} == {"Compostable", "Recyclable", "Trash"}
    labels = {r.brand: r.label for r in brand_total_label(wide).collect()}
    assert labels["x"] == "Total: 1"


def test_top_brands_ties_and_subset(spark):
    rows = [(str(i), None, b, None, None) for i, b in enumerate(["a", "a", "b", "b", "c", None, None])]
    prepared = prepare(spark.createDataFrame(rows, SCHEMA))
    top = [(r.brand, r.total_waste_count) for r in top_brands(prepared, 2).collect()]
    assert top == [(None, 2), ("a", 2)]
    allb = {(r.brand, r.total_waste_count) for r in waste_by_brand(prepared).collect()}
    assert set(top) <= allb


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([True, False, None]), st.sampled_from([True, False, None]),
                          st.integers(0, 23), st.sampled_from(["", "x", None])), min_size=1, max_size=40))
def test_property_partition_of_rows(spark, rows):
    data = [(str(i), f"2024-01-01 {h:02d}:00:00", b, r, c) for i, (r, c, h, b) in enumerate(rows)]
    df = spark.createDataFrame(data, "filename string, time string, brand string, is_recyclable boolean, "
                                     "is_compostable boolean").withColumn("time", F.col("time").cast("timestamp"))
    res = composition(prepare(df), "hour").collect()
    assert sum(r.total_count for r in res) == len(rows)
    for r in res:
        assert r.compostable_count + r.recyclable_count + r.trash_count == r.total_count
        assert abs(r.compostable_pct + r.recyclable_pct + r.trash_pct - 100) < 1e-9


def test_dashboard_top_brands_equal_direct(spark):
    from binsight.plans.jobs import dashboard, dashboard_groups
    from binsight.sources.driver_tables import items
    it = items(spark, "/root/testdata/sf0.001")
    d = dashboard(dashboard_groups(it))
    assert set(d) == {"composition_by_hour", "composition_by_hour_long", "composition_by_brand",
                      "composition_by_brand_long", "top_brands"}
    assert [tuple(r) for r in d["top_brands"].collect()] == [tuple(r) for r in top_brands(prepare(it)).collect()]
    direct = sorted(map(tuple, composition(prepare(it), "brand", order=False).collect()), key=str)
    assert sorted(map(tuple, d["composition_by_brand"].collect()), key=str) == direct


def test_prepare_equals_chained_steps(spark):
    from binsight.operators.prepare import with_hour
    df = flags_frame(spark).withColumn("time", F.lit("2024-01-01 05:30:00").cast("timestamp"))
    chained = with_hour(exclusive_flags(normalize_brand(fill_flags(df))))
    one = prepare(df)
    assert one.columns == chained.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, chained.collect()))


def test_one_pass_compositions_equal_separate(spark):
    from binsight.operators.composition import compositions
    from binsight.sources.driver_tables import items
    prepared = prepare(items(spark, "/root/testdata/sf0.001"))
    both = compositions(prepared, ["hour", "brand"])
    for k in ("hour", "brand"):
        a = sorted(map(tuple, both[k].collect()), key=str)
        b = sorted(map(tuple, composition(prepared, k, order=False).collect()), key=str)
        assert a == b
    assert any(r.brand is None for r in both["brand"].collect())  # NULL brand is its own group


def test_publish_dashboard(spark, tmp_dir):
    import os
    from binsight.plans.jobs import publish_dashboard
    from binsight.sources import table as tb
    from binsight.sources.driver_tables import items
    src, out = os.path.join(tmp_dir, "items"), os.path.join(tmp_dir, "dash")
    tb.append(spark, items(spark, "/root/testdata/sf0.001"), src)
    publish_dashboard(spark, src, out)
    assert tb.read_table(spark, f"{out}/composition_by_hour").count() == 24
    assert tb.read_table(spark, f"{out}/top_brands").count() == 10
    before = tb.read_table(spark, f"{out}/composition_by_hour").agg(F.sum("total_count")).first()[0]
    tb.append(spark, items(spark, "/root/testdata/sf0.001"), src)  # another writer, between two publications
    publish_dashboard(spark, src, out)
    assert tb.read_table(spark, f"{out}/composition_by_hour").agg(F.sum("total_count")).first()[0] == 2 * before
