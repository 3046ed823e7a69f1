"""Numbers for categories without a list of them on the driver; H25: the binned density."""

import math

import numpy as np
from pyspark.sql import functions as F

from tunesift.operators import dictionary as DC
from tunesift.operators import profile as P


def test_numbers_follow_the_order_of_values(spark):
    rows = [("b",), ("a",), (None,), ("",), ("é",), ("b",), ("Z",)]
    df = spark.createDataFrame(rows, "cat string")
    codes = DC.dictionary(df, "cat")
    assert {r.value: r.code for r in codes.collect()} == {"": 0, "Z": 1, "a": 2, "b": 3, "é": 4}
    other = spark.createDataFrame([("a",), ("unseen",), (None,)], "cat string")
    got = {r.cat: (r.code, r.hot.indices, r.hot["values"], r.hot.size) for r in DC.encode(other, "cat", codes).withColumn("hot", DC.one_hot("code", 5)).collect()}
    assert got == {"a": (2, [2], [1.0], 5), "unseen": (None, [], [], 5), None: (None, [], [], 5)}
    assert DC.dictionary(df.filter("false"), "cat").count() == 0


def test_a_million_categories_and_a_hot_one(spark):
    n = 1_000_000
    df = spark.range(n * 3 // 2).select(F.when(F.col("id") < n, F.format_string("c%07d", "id")).otherwise(F.lit("c0000007")).alias("cat"))
    codes = DC.dictionary(df, "cat")
    row = codes.agg(F.count(F.lit(1)), F.min("code"), F.max("code"), F.count_if(F.col("code") != F.substring("value", 2, 7).cast("long"))).first()
    assert tuple(row) == (n, 0, n - 1, 0)
    coded = DC.encode(df, "cat", codes)
    assert tuple(coded.agg(F.count("code"), F.count_if(F.col("code") == 7)).first()) == (n * 3 // 2, n // 2 + 1)


def density(ms, grid=200):
    x = np.array(ms) / 60000.0
    bw = x.std(ddof=1) * len(x) ** -0.2
    g = x.min() - 3 * bw + np.arange(grid) * ((x.max() - x.min()) + 6 * bw) / (grid - 1)
    return g, np.exp(-0.5 * ((g[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))


def test_binned_density_equals_the_sum_over_rows(spark):
    rnd = np.random.default_rng(3)
    for ms in (rnd.lognormal(12, 0.5, 5000).astype(int).tolist(), [1000, 2000], [5] * 10 + [600_000] * 3, rnd.integers(0, 10**7, 300).tolist()):
        got = P.duration_kde(spark.createDataFrame([(m,) for m in ms] + [(None,)], "duration_ms long")).orderBy("i").collect()
        x, want = density(ms)
        assert [r.i for r in got] == list(range(200))
        assert np.abs(np.array([r.x for r in got]) - x).max() < 1e-6
        assert np.abs(np.array([r.density for r in got]) - want).max() < 1e-7 * max(1, want.max())
    plan = P.duration_kde(spark.createDataFrame([(1,)], "duration_ms long"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_density_without_rows_or_spread(spark):
    assert P.duration_kde(spark.createDataFrame([(None,)], "duration_ms long")).count() == 0
    for ms in ([7], [7, 7]):
        got = P.duration_kde(spark.createDataFrame([(m,) for m in ms], "duration_ms long")).collect()
        assert len(got) == 200 and {r.density for r in got} == {None}
