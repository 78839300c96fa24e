"""bench.py prints one JSON line of the agreed shape."""

import json
import os
import subprocess
import sys

from .conftest import ROOT, SF001


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_CPUS="2")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py"), "monthly_series", "search_count"],
        capture_output=True, text=True, env=env, timeout=600, check=True,
    ).stdout.strip().splitlines()
    record = json.loads(out[-1])
    assert record["unit"] == "sec" and record["sf"] == 0.001
    assert set(record["queries"]) == {"monthly_series", "search_count"}
    assert record["value"] == round(sum(record["queries"].values()), 3)
    assert record["failed"] == {}
