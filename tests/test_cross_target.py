import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cellspan.operators import cross_target


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_of_targets_are_never_aggregated(spark, monkeypatch, block):
    """Large classes of equal targets, in one block or many, and targets of several items: each pair once, with its count."""
    monkeypatch.setattr(cross_target, "BLOCK", block)
    r = random.Random(5)
    sets = {f"t{i:03}": {"a"} for i in range(40)} | {f"u{i}": {"a", "b"} for i in range(9)} | {f"v{i}": set(r.sample("abcdef", 3)) for i in range(25)}
    rows = [(t, x) for t, s in sets.items() for x in s for _ in range(2)] + [("t000", None), ("w", ""), (None, "a")]
    df = spark.createDataFrame(rows, "target string, item string")
    got = sorted(map(tuple, cross_target.pair_overlap(df, F.col("item")).collect()))
    assert got == sorted((s, t, n) for s, t in combinations(sorted(sets), 2) if (n := len(sets[s] & sets[t])))
    few = cross_target.pair_overlap(df, F.col("item"), 2).collect()
    assert len(few) == sum(n >= 2 for *_, n in got)
    plan = cross_target.pair_overlap(df, F.col("item"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.splitlines()[0] and plan.splitlines()[0].startswith("Project")
