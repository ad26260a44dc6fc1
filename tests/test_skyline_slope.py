import math
import random

import numpy as np
import pytest

from vecframe.operators import reports as R
from vecframe.operators.skyline import skyline

SCHEMA = "g string, id long, a double, b double, c double"


def plain(rows):
    sound = [r for r in rows if all(x is not None and not math.isnan(x) for x in r[2:])]
    value = lambda r: (r[2], -r[3], r[4])
    beats = lambda x, y: x[0] == y[0] and all(p >= q for p, q in zip(value(x), value(y), strict=True)) and value(x) != value(y)
    return sorted(r[1] for r in sound if not any(beats(o, r) for o in sound))


@pytest.mark.parametrize("block", [5, 4096])
def test_skyline_against_pairs(spark, block):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None, ""]), i, *(float(rng.randrange(6)) for _ in range(3))) for i in range(250)]
    rows += [("x", 900, None, 9.0, 9.0), ("x", 901, float("nan"), 9.0, 9.0), ("y", 902, float("inf"), 5.0, 0.0)]
    rows += [("z", 1000 + i, float(i), float(i), 0.0) for i in range(60)]  # all on the front
    rows += [("z", 1100, 3.0, 3.0, 0.0)]  # equal to another: both stay
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = skyline(df, {"a": False, "b": True, "c": False}, ["g"], block_rows=block)
    assert found.columns == df.columns
    assert sorted(r.id for r in found.collect()) == plain(rows)


def test_skyline_without_rows_groups_or_measures(spark):
    df = spark.createDataFrame([("x", 1, 1.0, 1.0, 1.0), ("y", 2, 2.0, 1.0, 1.0)], SCHEMA)
    assert [r.id for r in skyline(df, {"a": False}).collect()] == [2]
    assert skyline(df.limit(0), {"a": False}, ["g"]).count() == 0
    with pytest.raises(ValueError):
        skyline(df, {})


def test_scaling_slope_is_the_exponent(spark):
    rows = [("p", n, 3.0 * n**0.5, 10.0) for n in (10, 100, 1000, 5000)] + [("one", 10, 1.0, 1.0), ("two", 10, 1.0, None), ("two", 100, 10.0, 0.0)]
    rng = np.random.default_rng(2)
    noisy = [("n", int(n), float(n**1.2 * np.exp(rng.normal() / 5)), 1.0) for n in (5, 50, 500, 900, 2000)]
    df = spark.createDataFrame(rows + noisy, "db string, n_dataset long, p50_ms double, qps double")
    got = {(r.db, r.metric): r for r in R.scaling_slope(df, ["p50_ms", "qps"]).collect()}
    p = got["p", "p50_ms"]
    assert p.points == 4 and p.slope == pytest.approx(0.5) and p.intercept == pytest.approx(math.log(3)) and p.slope_error < 1e-6 and p.r2 == pytest.approx(1)
    assert got["p", "qps"].slope == pytest.approx(0) and got["p", "qps"].r2 is None
    assert got["one", "p50_ms"].slope is None and got["two", "p50_ms"].slope == pytest.approx(1.0) and got["two", "p50_ms"].slope_error is None
    assert ("two", "qps") not in got
    x, y = (np.log([r[i] for r in noisy]) for i in (1, 2))
    fit, cov = np.polyfit(x, y, 1, cov="unscaled")
    error = math.sqrt(((y - np.polyval(fit, x)) ** 2).sum() / 3 * cov[0][0])
    assert got["n", "p50_ms"].slope == pytest.approx(fit[0]) and got["n", "p50_ms"].slope_error == pytest.approx(error)


def test_stacked_records_with_an_absent_column(spark):
    full = spark.createDataFrame([("a", 1, 5.0, 2.0)], "db string, n_dataset long, memory_mb double, qps double")
    bare = spark.createDataFrame([("b", 1, 3.0)], "db string, n_dataset long, qps double")
    both = R.suite_table([full, bare])
    assert [tuple(r) for r in both.collect()] == [("a", 1, 5.0, 2.0), ("b", 1, None, 3.0)]
    assert {(r.db, r.metric): r.value for r in R.bar_values(both, ["memory_mb", "qps"]).collect()}["b", "memory_mb"] == 0.0
