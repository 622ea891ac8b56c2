import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seisloom.operators import transitions

WAVES = ["P", "S", "Surface"]


def brute(rows):
    matrix = {a: [1 / 3] * 3 for a in WAVES}
    for _, a, b, x in sorted(rows, key=lambda r: r[0]):
        if x is None or not abs(x) < float("inf"):
            continue
        row, k = matrix[a if a in WAVES else "P"], WAVES.index(b if b in WAVES else "P")
        row[k] = max(row[k] + x, 0.0)
        total = sum(row)
        row[:] = [v / total for v in row] if total > 1e-8 else [1 / 3] * 3
    return {(a, b): matrix[a][k] for a in WAVES for k, b in enumerate(WAVES)}


@pytest.mark.parametrize("low, high, pieces", [(-0.05, 0.2, 256), (-0.2, 0.2, 256), (-1.5, 1.5, 256), (-0.1, 0.02, 64), (0.0, 0.3, 1), (-0.05, 0.2, 16)])
def test_as_step_by_step(spark, low, high, pieces):
    """Where rows are drawn together, by large updates, where they are driven apart, and with maps that end early."""
    random.seed(int(1000 * high) + pieces)
    rows = [(k, random.choice([*WAVES, "Unknown", None]), random.choice([*WAVES, "Unknown"]), random.choice([None, float("nan"), float("inf"), -2.0]) if k % 50 == 0 else random.uniform(low, high)) for k in range(3000)]
    df = spark.createDataFrame(random.sample(rows, len(rows)), "t int, from_wave string, to_wave string, delta double")
    got = {(r["from_wave"], r["to_wave"]): r["p"] for r in transitions.ordered_transitions(df, ["t"], parts=7, pieces=pieces).collect()}
    expected = brute(rows)
    assert got.keys() == expected.keys() and max(abs(got[k] - expected[k]) for k in got) < 1e-6


def test_maps_meet_every_start():
    random.seed(3)
    rng = np.random.default_rng(3)
    for case in range(60):
        ups = [(random.randrange(3), random.choice([-1.0, random.gauss(0, 0.5)])) for _ in range(case)]
        scan = transitions.Scan()
        for up in ups:
            scan.update(*up)
        for row in [*np.eye(3), *rng.dirichlet([0.5] * 3, 10)]:
            expected = row
            for up in ups:
                expected = transitions.updated(expected, *up)
            assert np.abs(transitions.followed(row, scan.start, scan.end) - expected).max() < 1e-6


def test_none_and_odd(spark):
    schema = "t int, from_wave string, to_wave string, delta double"
    none = transitions.ordered_transitions(spark.createDataFrame([], schema), ["t"])
    assert none.count() == 9 and none.where(F.abs(F.col("p") - 1 / 3) > 1e-12).count() == 0
    rows = spark.createDataFrame([(None, "S", "S", 1.0), (1, "S", "P", -5.0), (1, "S", "P", -5.0)], schema)
    got = {r["to_wave"]: r["p"] for r in transitions.ordered_transitions(rows, ["t"]).where("from_wave = 'S'").collect()}
    assert got == pytest.approx({"P": 0.0, "S": 0.8, "Surface": 0.2})
