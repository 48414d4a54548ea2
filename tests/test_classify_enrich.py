import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from binsight.functions.columns import base64_text, basename, capture_name, parse_time, percent_text, request_document
from binsight.operators import classify as cl
from binsight.operators import enrich as en
from binsight.plans import jobs
from binsight.sources import table as tb



def frame(spark, rows, *keys):
    """Long (key, [model,] label, score) rows -> one row per image (and model)."""
    keys = keys or ("key",)
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in keys) + ", label string, score double")
    return df.groupBy(*keys).agg(F.collect_list(F.struct("label", "score")).alias("scores"))


def test_taxonomy_size_and_case(spark):
    assert cl.taxonomy(spark).count() == 46
    scores = frame(spark, [("k", "paper", 0.9), ("k", "Paper", 0.1)])
    assert [r.label for r in cl.label_lookup(scores, "trash1").collect()] == ["Paper"]
    with pytest.raises(ValueError):
        cl.label_lookup(scores, "nope")


def test_ties_and_unmapped(spark):
    scores = frame(spark, [("k", "Plastic", 0.5), ("k", "Paper", 0.5), ("k", "Unmapped", 0.9), ("u", "Unmapped", 0.3)])
    top = {r.key: r for r in cl.top_label(scores, "trash1").collect()}
    assert top["k"].label == "Paper" and "u" not in top
    ranked = [(r.rank, r.label) for r in cl.ranked_labels(scores, "trash1").orderBy("rank").collect()]
    assert ranked == [(1, "Paper"), (2, "Plastic")]
    raw = {r.key: r for r in cl.top_label_raw(scores, "trash1").collect()}
    assert raw["k"].label == "Unmapped" and raw["k"].category is None
    with pytest.raises(Exception):
        cl.top_label_raw(scores, "trash1", strict=True).collect()
    best = {r.key: r for r in cl.best_per_image(scores, "trash1").collect()}
    assert best["u"].category is None and best["k"].category == "RECYCLE"


def test_scorer_in_map_in_pandas(spark):
    imgs = spark.createDataFrame([("a.jpg", [0.1, -0.9, 0.3, 0.0, 0.2, 0.95])], "key string, embedding array<float>")
    out = cl.classify_images(imgs, "trash1", lambda: cl.ComponentScorer(["Paper", "Other", "Plastic", "G_M",
                                                                        "Organic", "Unmapped"])).collect()
    assert out[0].label == "Other" and out[0].category == "TRASH"


def test_scalar_functions(spark):
    data = bytes(range(256)) * 3
    row = spark.createDataFrame([(bytearray(data), "file:/x/y/z.jpg", 0.12125, "2024-11-09T07:19:50")],
                                "c binary, p string, s double, t string").select(
        base64_text("c").alias("b"), basename("p").alias("n"), percent_text("s").alias("pct"),
        request_document("c").alias("req"), capture_name(parse_time("t")).alias("cap"),
        parse_time(F.lit("bad")).alias("bad")).first()
    assert row.b == base64.b64encode(data).decode()
    assert row.n == "z.jpg" and row.pct == "12.13%"
    req = json.loads(row.req)
    parts = req["messages"][0]["content"]
    assert parts[0].keys() == {"type", "text"} and parts[1]["image_url"]["url"].endswith(row.b)
    assert row.cap == "images/capture_20241109-071950.jpg" and row.bad is None


def test_parse_answers(spark):
    good = '{"is_recyclable": true, "is_compostable": false, "is_metal": false, "brand": "", "description": "a cup"}'
    rows = [("1", " " + good + "\n"), ("2", "```json\n" + good + "\n```"), ("3", good.replace("true", '"yes"')),
            ("4", '{"is_recyclable": true}'), ("5", "nonsense"), ("6", None), ("7", good + " thanks"), ("8", good + good),
            ("9", good.replace('"', "'")), ("10", good.replace('"brand": ""', '"brand": 5')),
            ("11", good.replace('"brand": ""', '"brand": {"x": 1}')), ("12", good.replace('"brand": ""', '"brand": null')),
            ("13", good + "], [" + good), ("14", f"[{good}]"), ("15", "")]
    got = {r.filename: r for r in en.parse_answers(spark.createDataFrame(rows, "filename string, answer string")).collect()}
    assert got["1"].is_valid and got["1"].description == "a cup" and got["1"].brand == ""
    assert not any(got[str(k)].is_valid for k in range(2, 16) if k != 12)
    assert got["12"].is_valid and got["12"].brand is None and got["12"].reason is None
    assert (got["4"].reason, got["6"].reason, got["10"].reason, got["14"].reason) == (
        "no is_compostable", "no answer", "brand is not string", "not one object")
    assert got["5"].rejected_text == "nonsense" and got["1"].rejected_text is None
    assert got["3"].is_recyclable is None


def test_enrich_pending_end_to_end(spark, tmp_dir):
    class Flaky:
        calls = 0

        def __call__(self, filename, request):
            Flaky.calls += 1
            if Flaky.calls % 2 == 1:
                raise RuntimeError("transient")
            return json.dumps({"is_recyclable": True, "is_compostable": False, "is_metal": True,
                               "brand": "Kirkland", "description": "empty plastic water bottle"})

    img, table = os.path.join(tmp_dir, "images"), os.path.join(tmp_dir, "items")
    os.makedirs(img)
    for n in ["image1.jpg", "image2.jpg", "marker.jpg"]:
        with open(os.path.join(img, n), "wb") as f:
            f.write(b"jpeg" + n.encode())
    jobs.ingest_images(spark, img, table)
    snap, bad = jobs.enrich_pending(spark, table, img, Flaky, backoff_s=0.0)
    assert snap == 1 and bad.count() == 0
    rows = tb.read_table(spark, table).collect()
    assert len(rows) == 3 and all(r.brand == "Kirkland" and r.is_metal for r in rows)
    assert jobs.enrich_pending(spark, table, img, Flaky)[0] == -1  # nothing pending


def test_report_repeated_item_key_does_not_multiply(spark):
    scores = frame(spark, [("k.jpg", "Paper", 0.4), ("k.jpg", "Organic", 0.6)])
    items = spark.createDataFrame([("k.jpg", "2024-01-01 10:00:00"), ("k.jpg", "2024-01-01 11:00:00")],
                                  "filename string, time string").withColumn("time", F.col("time").cast("timestamp"))
    rows = cl.classification_report(scores, items, "trash1").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.category, r.label, r.confidence_text, r.image_saved) == (
        "COMPOST", "Organic", "60.00%", "images/capture_20240101-110000.jpg")


def test_enrich_duplicate_rows_give_one_answer(spark):
    rows = spark.createDataFrame([("7.jpg", bytearray(b"a")), ("7.jpg", bytearray(b"b")), ("50.jpg", bytearray(b"c"))],
                                 "filename string, content binary")
    ok, bad = en.enrich(rows, en.NumberedProvider, backoff_s=0.0)
    got = ok.collect()
    assert [(r.filename, r.description) for r in got] == [("7.jpg", "item 7")]
    assert [r.filename for r in bad.collect()] == ["50.jpg"]


def test_small_column_functions(spark):
    from binsight.functions.columns import indexed_name, iso_text, last_dotted, recode, total_label
    row = spark.createDataFrame([("Disposable.RECYCLE", "compostable_pct", 7, "2024-11-09 07:19:50")],
                                "e string, c string, i long, t string").select(
        last_dotted("e").alias("cat"), recode("c", {"compostable_pct": "Compostable"}).alias("name"),
        recode(F.lit("other"), {"compostable_pct": "Compostable"}).alias("missing"),
        indexed_name("i").alias("fn"), iso_text(F.col("t").cast("timestamp")).alias("iso"),
        total_label("i").alias("lbl"),
        capture_name(F.col("t").cast("timestamp"), suffix=F.col("i")).alias("cap")).first()
    assert (row.cat, row.name, row.missing, row.fn, row.iso, row.lbl) == (
        "RECYCLE", "Compostable", None, "7.jpg", "2024-11-09T07:19:50", "Total: 7")
    assert row.cap == "images/capture_20241109-071950-7.jpg"


def test_percent_text_edges(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (0.00005,)], "s double").select(percent_text("s").alias("p")).collect()
    assert [r.p for r in rows] == ["0.00%", "100.00%", "0.01%"]


def test_several_models_in_one_run(spark):
    rows = [("k", "trash1", "Paper", 0.2), ("k", "trash1", "Organic", 0.7), ("k", "trash2", "metal", 0.9),
            ("k", "trash2", "paper", 0.1), ("k", "fruits", "jalepeno", 0.5)]
    with pytest.raises(Exception, match="unknown model nope"):
        cl.top_label(frame(spark, rows + [("k", "nope", "Paper", 1.0)], "key", "model"), None).collect()
    scores = frame(spark, rows, "key", "model")
    top = {r.model: (r.category, r.label) for r in cl.top_label(scores, None).collect()}
    assert top == {"trash1": ("COMPOST", "Organic"), "trash2": ("METAL", "metal"),
                   "fruits": ("QUICK_COMPOST", "jalepeno")}
    ranks = [(r.model, r.rank, r.label) for r in cl.ranked_labels(scores, None).orderBy("model", "rank").collect()]
    assert ranks == [("fruits", 1, "jalepeno"), ("trash1", 1, "Organic"), ("trash1", 2, "Paper"),
                     ("trash2", 1, "metal"), ("trash2", 2, "paper")]


def test_classify_images_several_models(spark):
    import pandas as pd

    def factory():
        def score(pdf):
            rows = []
            for k in pdf["key"]:
                rows += [(k, "trash1", "Organic", 0.6), (k, "trash1", "Paper", 0.3),
                         (k, "trash2", "Unknown", 0.9), (k, "fruits", "mango", 0.4)]
            return pd.DataFrame(rows, columns=["key", "model", "label", "score"])
        return score

    imgs = spark.createDataFrame([("a.jpg", b"x")], "key string, content binary")
    out = {r.model: (r.category, r.label) for r in cl.classify_images(imgs, None, factory).collect()}
    assert out == {"trash1": ("COMPOST", "Organic"), "trash2": (None, None), "fruits": ("REUSEABLE", "mango")}


def test_every_image_keeps_a_row(spark):
    import pandas as pd

    def factory():
        return lambda pdf: pd.DataFrame([(k, "Paper", 0.5) for k in pdf["key"] if k != "b"], columns=["key", "label", "score"])

    imgs = spark.createDataFrame([("a", b"x"), ("b", b"y")], "key string, content binary")
    got = {r.key: (r.label, r.confidence) for r in cl.classify_images(imgs, "trash1", factory).collect()}
    assert got == {"a": ("Paper", 0.5), "b": (None, None)}


def test_two_factories_of_one_class(spark):
    class Loader:
        def __init__(self, label):
            self.label = label

        def build(self):
            import pandas as pd
            return lambda pdf: pd.DataFrame({"key": pdf["key"], "label": self.label, "score": 1.0})

    imgs = spark.createDataFrame([("a", b"x")], "key string, content binary")
    labels = [cl.classify_images(imgs, "trash1", Loader(x).build).first().label for x in ("Paper", "Organic", "Paper")]
    assert labels == ["Paper", "Organic", "Paper"]


def test_classification_plan_has_no_shuffle(spark):
    from binsight.sources import driver_tables as dt
    scores = dt.scores(spark, "/root/testdata/sf0.001")
    for df in (cl.top_label(scores, "trash1"), cl.ranked_labels(scores, "trash1"), cl.best_per_image(scores, "trash1"),
               cl.top_label_raw(scores, "trash1"), cl.top_label(dt.model_scores(spark, "/root/testdata/sf0.001"), None)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_strict_enrichment_raises_and_merges_nothing(spark, tmp_dir):
    img, table = os.path.join(tmp_dir, "images"), os.path.join(tmp_dir, "items")
    os.makedirs(img)
    with open(os.path.join(img, "a.jpg"), "wb") as f:
        f.write(b"x")
    jobs.ingest_images(spark, img, table)
    with pytest.raises(en.InvalidAnswerError, match="a.jpg: not JSON"):
        jobs.enrich_pending(spark, table, img, lambda: lambda name, request: "malformed", strict=True)
    assert tb.versions(spark, table) == [0]

    def outage():
        def call(name, request):
            raise ConnectionError("no route")
        return call

    _, bad = jobs.enrich_pending(spark, table, img, outage, backoff_s=0.0)
    row = bad.first()
    assert (row.reason, row.error) == ("no answer", "ConnectionError: no route")
