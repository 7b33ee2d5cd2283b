"""Memory of the Python workers of the pipeline's stages."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np

from lodestone.llm import ppm, substring


def test_cutting_repeats_needs_one_worker_a_task(spark):
    """No two Python steps of a stage: where the spans are few, their join is not a broadcast either."""
    shared = " ".join(f"w{i}" for i in range(80))
    rows = [(i, f"a{i} {shared} z{i}") for i in range(6)] + [(9, "other words")]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    above: list[tuple[int, str]] = []
    steps = 0
    for line in out._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.search(r"[A-Za-z*]", line).start() if re.search(r"[A-Za-z*]", line) else 0
        above = [x for x in above if x[0] < depth] + [(depth, line[depth:])]
        if line[depth:].startswith("MapInArrow"):
            steps += 1
            for _, name in reversed(above[:-1]):
                assert not name.startswith("MapInArrow"), "two Python workers a task"
                if "Exchange" in name:
                    break
    assert steps == 3
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: rows[0][1], 9: "other words"} | {i: f"a{i} z{i}" for i in range(1, 6)}


def test_cost_tables_are_made_in_blocks():
    """Costs follow from the counts by blocks of contexts: the same whatever the block, and with little memory besides."""
    rng = np.random.default_rng(1)
    counts = {}
    for name in "xy":
        data = rng.integers(33, 113, 60_000)
        counts[name] = {k: np.unique(sum(data[i : len(data) - k + 1 + i].astype(np.int64) << (8 * (k - 1 - i)) for i in range(k)), return_counts=True) for k in range(1, 5)}
    model = ppm.ContextTrees(counts)
    tracemalloc.start()
    code, width, lookup, costs = model._build()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * costs.nbytes
    held, ppm.STATES = ppm.STATES, 1 << 30
    try:
        assert np.array_equal(costs, model._build()[3])
    finally:
        ppm.STATES = held
