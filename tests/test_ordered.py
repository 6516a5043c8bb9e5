"""Order-dependent operators, with small buckets so that groups are split."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators.combine import concat_columns
from millrace.operators.ordered import row_number, running_total
from millrace.operators.quantiles import group_quantiles, quantiles
from millrace.operators.windows import create_lag_features, create_rolling_features, time_series_fill


def series(n=4000, hot=0.5, seed=1):
    """Rows in random order; one user holds half of them."""
    rng = np.random.default_rng(seed)
    user = np.where(rng.random(n) < hot, 7, rng.integers(0, 40, n))
    value = np.where(rng.random(n) < 0.4, np.nan, rng.normal(100, 20, n).round(2))
    pdf = pd.DataFrame({"id": np.arange(n), "user": user, "day": rng.integers(0, 300, n), "v": value})
    return pdf.sample(frac=1, random_state=3)


def frame(spark, pdf):
    df = spark.createDataFrame(pdf).repartition(5)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def compare(df, expected, columns):
    got = df.toPandas().sort_values("id")[columns].to_numpy(dtype=float)
    want = expected.sort_values("id")[columns].to_numpy(dtype=float)
    np.testing.assert_allclose(got, want, rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("by", [[], ["user"]])
@pytest.mark.parametrize("bucket", [None, 150])
def test_lag_and_rolling(spark, by, bucket):
    pdf = series()
    df = frame(spark, pdf)
    ordered = pdf.sort_values(["day", "id"])
    grouped = ordered.groupby("user") if by else ordered
    for n in (1, 5):
        ordered[f"v_lag_{n}"] = grouped["v"].shift(n)
    lagged = create_lag_features(df, "v", [5, 1, 5], ["day", "id"], by, bucket)
    compare(lagged, ordered, ["v_lag_1", "v_lag_5"])

    stats = ["mean", "std", "min", "max", "median"]
    for s in stats:
        rolled = (grouped["v"].rolling(6, min_periods=2))
        result = getattr(rolled, s)()
        ordered[f"v_rolling_6_{s}"] = result.reset_index(level=0, drop=True) if by else result
    rolled = create_rolling_features(df, "v", [6], ["day", "id"], stats, 2, by, bucket)
    compare(rolled, ordered, [f"v_rolling_6_{s}" for s in stats])


def test_reach_longer_than_buckets(spark):
    pdf = series(600)
    ordered = pdf.sort_values(["day", "id"])
    ordered["v_lag_200"] = ordered["v"].shift(200)
    compare(create_lag_features(frame(spark, pdf), "v", [200], ["day", "id"], None, 40), ordered, ["v_lag_200"])


@pytest.mark.parametrize("by", [[], ["user"]])
@pytest.mark.parametrize("bucket", [None, 150])
@pytest.mark.parametrize("method", ["ffill", "bfill"])
def test_fill(spark, by, bucket, method):
    pdf = series()
    pdf.loc[(pdf.day > 50) & (pdf.day < 200), "v"] = np.nan
    pdf.loc[(pdf.day < 10) | (pdf.day > 280), "v"] = np.nan
    ordered = pdf.sort_values(["day", "id"])
    ordered["v"] = getattr(ordered.groupby("user")["v"] if by else ordered["v"], method)()
    filled = time_series_fill(frame(spark, pdf), ["v"], ["day", "id"], method, by, bucket)
    compare(filled, ordered, ["v"])


def test_row_numbers_of_copies(spark):
    """A third of all rows share one sort key; numbers must still be 1..n."""
    df = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 50)).alias("k"))
    out = row_number(df, "n", [], ["k"], 100).toPandas()
    assert sorted(out.n) == list(range(1, 3001))
    assert (out.sort_values("n").k.diff().dropna() >= 0).all()


def test_running_total(spark):
    pdf = series(2000)
    pdf["c"] = pdf["day"] % 7
    ordered = pdf.sort_values(["day", "id"])
    ordered["t"] = ordered.groupby("user")["c"].cumsum()
    out = running_total(spark.createDataFrame(pdf), F.col("c"), "t", ["user"], ["day", "id"], 100)
    compare(out, ordered, ["t"])


def test_concat_columns(spark):
    a = spark.createDataFrame([(i, i * 10) for i in range(500)], "k long, a long").repartition(7)
    b = spark.createDataFrame([(i, -i) for i in range(450)], "k long, b long").repartition(3)
    out = concat_columns(a, b, ["k"], ["k"], 60).toPandas().sort_values("k_x")
    assert list(out.columns) == ["k_x", "a", "k_y", "b"]
    assert (out.k_y.dropna() == out.k_x[:450]).all() and out.b.isna().sum() == 50


@pytest.mark.parametrize("kind", ["normal", "heavy", "one_value", "few", "two"])
@pytest.mark.parametrize("accuracy,limit", [(10_000, 20_000), (50, 20), (20, 1)])
def test_quantiles(spark, kind, accuracy, limit):
    rng = np.random.default_rng(5)
    x = {
        "normal": rng.normal(0, 1, 5000),
        "heavy": np.where(rng.random(5000) < 0.4, 3.0, rng.pareto(0.5, 5000)),
        "one_value": np.full(100, 2.5),
        "few": rng.integers(0, 3, 3000).astype(float),
        "two": np.array([1.0, 2.0]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).union(spark.createDataFrame([(None,), (float("nan"),)], "x double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles(df, ["x"], probs, accuracy, limit)["x"]
    np.testing.assert_allclose(got, np.quantile(x, probs), rtol=1e-12)


@pytest.mark.parametrize("bucket", [None, 100])
def test_group_quantiles(spark, bucket):
    pdf = series()
    out = group_quantiles(frame(spark, pdf), "user", "v", [0.25, 0.75], bucket).toPandas().sort_values("user")
    want = pdf.groupby("user")["v"].quantile([0.25, 0.75]).unstack()
    np.testing.assert_allclose(out[["q0", "q1"]].to_numpy(), want.to_numpy(), rtol=1e-12)
