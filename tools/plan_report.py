"""Write PLANS.md: the physical plan tree of every batch query of the catalogue,
with each scan's ReadSchema and PushedFilters (``explain("formatted")``).

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

STREAMS = {"stream_composition", "stream_ingest", "stream_files", "stream_dedupe", "stream_lifecycle", "stream_top_brands"}


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarize(text: str) -> list[str]:
    lines = text.splitlines()
    tree, details = [], []
    in_tree = False
    for ln in lines:
        if ln.startswith("== Physical Plan =="):
            in_tree = True
            continue
        if in_tree:
            if not ln.strip():
                in_tree = False
                continue
            tree.append(ln)
        elif ln.startswith(("ReadSchema", "PushedFilters", "Location")):
            details.append("    " + (ln if len(ln) < 220 else ln[:217] + "..."))
        elif ln.startswith("(") and "Scan" in ln:
            details.append(ln)
    return tree + [""] + details


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from binsight.plans.catalogue import QUERIES
    from binsight.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    print(f"# Physical plans ({os.path.basename(sf)}, before AQE re-planning)\n")
    print("Generated by `tools/plan_report.py`. Streaming queries are omitted (their "
          "micro-batch plans match the batch plans of the same operators).\n")
    for name, fn in QUERIES.items():
        if name not in STREAMS:
            show(name, fn(spark, sf))
    from binsight.operators import enrich as en
    from binsight.operators.merge import merge_update
    from binsight.session import scratch_path
    from binsight.sources import driver_tables as dt
    from binsight.sources import table as tb
    path = scratch_path(spark, "plan")
    tb.append(spark, dt.items(spark, sf), path, partitioned=True)
    ok, _ = en.split_valid(en.parse_answers(dt.answers(spark, sf)))
    stored = scratch_path(spark, "answers")
    ok.write.parquet(stored)
    target = tb.read_table(spark, path, keep_partition=True).filter(f"{tb.PARTITION_COL} = date'2024-01-01'")
    show("merge_in_place: the merge of one touched date", merge_update(target, spark.read.parquet(stored)))


def show(name: str, df) -> None:
    print(f"## {name}\n\n```")
    print("\n".join(summarize(formatted(df))))
    print("```\n")


if __name__ == "__main__":
    main()
