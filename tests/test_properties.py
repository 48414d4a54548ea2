"""Property tests: join operators against a brute-force Python model."""

from hypothesis import given, settings
from hypothesis import strategies as st

from binsight.operators.ingest import new_only
from binsight.operators.merge import merge_update

KEYS = st.sampled_from(["a", "b", "c", "d", None])
VALS = st.sampled_from(["x", "y", "", None])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(KEYS, st.integers(0, 9)), max_size=12),
       st.lists(KEYS, max_size=8), st.booleans())
def test_new_only_matches_model(spark, incoming, existing, dedupe):
    inc = spark.createDataFrame(incoming, "filename string, v int")
    ex = spark.createDataFrame([(k,) for k in existing], "filename string")
    seen = {k for k in existing if k is not None}
    got = sorted(((r.filename or "~"), r.v) for r in new_only(inc, ex, dedupe=dedupe).collect())
    model = [(k or "~", v) for k, v in incoming if k is None or k not in seen]
    if dedupe:
        assert len(got) == len({k for k, _ in model if k != "~"}) + sum(k == "~" for k, _ in model)
        assert {k for k, _ in got} == {k for k, _ in model}
    else:
        assert got == sorted(model)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(KEYS, VALS, st.integers(0, 9)), max_size=12),
       st.dictionaries(st.sampled_from(["a", "b", "c", "z"]), VALS, max_size=4))
def test_merge_matches_model(spark, target, answers):
    tgt = spark.createDataFrame(target, "filename string, description string, keep int")
    src = spark.createDataFrame(list(answers.items()), "filename string, description string")
    got = sorted((r.filename or "~", r.description or "-", r.keep)
                 for r in merge_update(tgt, src, columns=["description"]).collect())
    model = sorted((k or "~", (answers[k] if k in answers else d) or "-", keep) for k, d, keep in target)
    assert got == model  # row count kept, NULL answers overwrite, other columns untouched
