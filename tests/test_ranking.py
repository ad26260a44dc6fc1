import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from vecframe.operators.ranking import dense_ids, group_quantiles, with_positions


def test_positions_match_row_number_with_hot_group_and_sampling(spark):
    # 60k rows: one group holds most rows and many equal values, so the range sampler
    # really samples and a hot group spans many partitions.
    df = spark.range(60000).select(
        F.col("id").alias("uid"),
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise((F.col("id") % 3).cast("string")).alias("g"),
        (F.col("id") * 7919 % 101).cast("double").alias("v"),
    )
    got = with_positions(df, ["g"], ["v"], ["uid"], partitions=16)
    w = Window.partitionBy("g").orderBy("v", "uid")
    want = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("group_rows", F.count(F.lit(1)).over(Window.partitionBy("g")))
    diff = got.select("uid", "pos", "group_rows").exceptAll(want.select("uid", "pos", "group_rows"))
    assert diff.count() == 0
    assert got.count() == 60000


def test_dense_ids_are_consecutive(spark):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "k").repartition(7)
    ids = sorted((r.id, r.k) for r in dense_ids(df, ["k"], ["k"]).collect())
    assert [i for i, _ in ids] == list(range(1000))
    assert [k for _, k in ids] == list(range(0, 3000, 3))


def reference_linear(values, p):
    v = sorted(values)
    if not v:
        return None
    if len(v) == 1:
        return v[0]
    idx = p * (len(v) - 1)
    lo, hi = int(np.floor(idx)), int(np.ceil(idx))
    return v[lo] if lo == hi else v[lo] * (1 - (idx - lo)) + v[hi] * (idx - lo)


def test_quantiles_for_0_1_2_4_values(spark):
    data = {"one": [3.0], "two": [1.0, 9.0], "four": [5.0, 1.0, 7.5, 10.0]}
    rows = [(g, float(x), i) for i, (g, xs) in enumerate((g, xs) for g, xs in data.items()) for x in xs]
    rows = [(g, x, n) for n, (g, x, _) in enumerate(rows)]
    df = spark.createDataFrame(rows + [("none", None, 99)], "g string, v double, uid long")
    probs = [0.0, 0.5, 0.95, 0.99, 1.0]
    got = {(r.g, r.p): r.value for r in group_quantiles(df, ["g"], "v", ["uid"], probs).collect()}
    assert not any(g == "none" for g, _ in got)
    for g, xs in data.items():
        for p in probs:
            assert abs(got[(g, p)] - reference_linear(xs, p)) < 1e-12
    low = {(r.g, r.p): r.value for r in group_quantiles(df, ["g"], "v", ["uid"], [0.5, 0.95], rule="lower").collect()}
    for g, xs in data.items():
        s = sorted(xs)
        for p in (0.5, 0.95):
            assert low[(g, p)] == s[int(p * (len(s) - 1))]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "g string, v double, uid long")
    assert with_positions(empty, ["g"], ["v"], ["uid"]).count() == 0
    assert group_quantiles(empty, ["g"], "v", ["uid"], [0.5]).count() == 0
    assert dense_ids(empty.select("uid"), ["uid"]).count() == 0
