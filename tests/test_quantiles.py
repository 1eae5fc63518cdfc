"""Percentiles by selection against Spark's own and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import quantiles

SHARES = {"least": 0.0, "low": 0.025, "third": 1 / 3, "middle": 0.5, "high": 0.975, "most": 1.0}


def test_equal_to_sparks_percentile_on_odd_values(spark):
    rng = random.Random(6)
    kinds = [lambda: rng.uniform(-1, 1), lambda: rng.choice([-0.0, 0.0, 1.0]), lambda: float(rng.randint(-5, 5)), lambda: rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300), lambda: rng.choice([float("inf"), float("-inf"), 5e-324, 2.0]), lambda: None]
    rows = [("a", "x", rng.uniform(0, 1e6)) for _ in range(500)] + [("hot", None, 7.0)] * 700 + [("hot", None, 8.5)] + [(None, None, float(i)) for i in range(9)]
    rows += [("b", "y", rng.choice(kinds)()) for _ in range(400)] + [("one", "z", 3.0), ("none", "z", None), ("none", "z", None), ("nan", "z", float("nan")), ("nan", "z", 1.0)]
    df = spark.createDataFrame(rows, "g string, h string, Value double").selectExpr("*", "1 AS n", "2 AS share", "3 AS digit")
    got = {(r.g, r.h): [r[s] for s in SHARES] for r in quantiles.percentiles(df, ["g", "h"], "Value", SHARES).collect()}
    expected = {(r.g, r.h): [r[s] for s in SHARES] for r in df.groupBy("g", "h").agg(*[F.percentile("Value", F.lit(p)).alias(s) for s, p in SHARES.items()]).collect()}
    assert set(got) == set(expected)
    for k, own in expected.items():
        assert str(got[k]) == str(own) or got[k] == pytest.approx(own, nan_ok=True, rel=1e-12), k


def test_whole_table_integers_and_empty(spark):
    df = spark.range(1_001).select((F.col("id") * 3).cast("int").alias("x"))
    assert quantiles.percentiles(df, [], "x", {"m": 0.5, "q": 0.9}).collect()[0].asDict() == {"m": 1500.0, "q": 2700.0}
    none = df.where("x < 0").withColumn("g", F.lit("g"))
    assert quantiles.percentiles(none, ["g"], "x", {"m": 0.5}).count() == 0
    with pytest.raises(ValueError):
        quantiles.percentiles(df, [], "x", {"m": 1.5})


def test_many_ranges_are_joined_and_no_plan_holds_a_group(spark, monkeypatch):
    df = spark.range(3_000).select((F.col("id") % 40).alias("g"), F.rand(3).alias("x"))
    few = sorted(map(tuple, quantiles.percentiles(df, ["g"], "x", {"m": 0.4}).collect()))
    monkeypatch.setattr(quantiles, "MOST_RANGES", 0)
    many = quantiles.percentiles(df, ["g"], "x", {"m": 0.4})
    assert sorted(map(tuple, many.collect())) == few
    assert "percentile" not in many._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("n", [1, 2, 3, 17])
def test_few_values(spark, n):
    rng = random.Random(n)
    values = [rng.uniform(-9, 9) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    own, at = sorted(values), (n - 1) * 0.3
    low = int(at)
    plain = own[low] if low == at else own[low] * (1 - (at - low)) + own[low + 1] * (at - low)
    assert quantiles.percentiles(df, [], "x", {"p": 0.3}).collect()[0].p == pytest.approx(plain, rel=1e-12)
