"""bench.py prints exactly one JSON line with the fields the driver records."""

import json
import os
import subprocess
import sys


def test_bench_prints_one_json_line():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_RUNS="1",
               BENCH_QUERIES="composition_by_hour,top_brands")
    out = subprocess.run([sys.executable, os.path.join(repo, "bench.py")], env=env, cwd="/tmp",
                         capture_output=True, text=True, timeout=300)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1, out.stdout + out.stderr[-2000:]
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == "0.001" and set(d["queries"]) == {"composition_by_hour", "top_brands"}
    assert abs(d["value"] - sum(d["queries"].values())) < 1e-3
