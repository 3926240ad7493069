import numpy as np
import pytest
from pyspark.sql import functions as F

from stagewise.operators import census


@pytest.mark.parametrize("rank", [0.0, 0.5, 0.93, 1.0])
def test_quantiles(spark, rank):
    made = np.random.default_rng(1)
    values = {"even": made.normal(size=20_001), "ties": made.integers(0, 3, 10_000).astype(float), "tail": made.pareto(0.5, 5_000), "one": np.array([7.5]), "two": np.array([-1.0, 2.0]), None: np.arange(10.0)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("even", None), ("even", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: (r.n, r["quantile"]) for r in census.quantiles(df, ["k"], "v", rank, small=50, size=200).collect()}
    assert got.pop("nothing") == (0, None)
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in values.items()}
    for k, (_, q) in got.items():
        assert q == pytest.approx(np.quantile(values[k], rank), rel=1e-12), k


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, n int, v double")
    assert census.quantiles(empty, ["k"], "v").count() == 0


def test_strata(spark):
    df = spark.createDataFrame([(None,), (0.5,), (4.0,), (9.9,), (10.0,)], "x double")
    assert [r[0] for r in df.select(census.stratum("x", [4, 10], "none")).collect()] == ["none", "< 4", "4 - 10", "4 - 10", "10+"]
    rate = census.yearly(F.lit(731), F.lit("2000-01-01"), "2002-01-01")
    assert df.select(rate).first()[0] == pytest.approx(731 / (731 / 365.25))
