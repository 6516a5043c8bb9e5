"""Fills, outliers, scaling, encoding, binning, duplicates and joins on literals."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.frame import PreconditionError
from millrace.operators import binning, combine, dedupe, encode, impute, outliers, scale, windows


def column(spark, name, values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_fills(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (None, 4.0, "b"), (4, None, "b"), (4, float("nan"), None), (9, 7.0, "a")],
                               "n long, x double, t string")
    got = lambda c, **p: [r[c] for r in impute.fill_missing(df, [c], **p).collect()]
    assert got("x", method="mean") == [1.0, 4.0, 4.0, 4.0, 7.0]
    assert got("n", method="mean")[1] == 4.5 and got("n", method="median")[1] == 4.0
    assert got("t", method="mode")[3] == "a" and got("n", method="mode")[1] == 4
    assert got("t", method="constant", value="z")[3] == "z"
    for bad in ({"method": "mean"}, {"method": "median"}):
        with pytest.raises(PreconditionError):
            impute.fill_missing(df, ["t"], **bad)
    with pytest.raises(PreconditionError):
        impute.fill_missing(df, ["x"], "constant", "text")
    assert column(spark, "e", [None, None], "double").transform(impute.fill_missing, ["e"], "mean").filter("e IS NULL").count() == 2


def test_iqr_cap(spark):
    values = [31, 35, 30, 38, 33, 36, 420, -90, 34]
    got = sorted(r.A for r in outliers.handle_outliers(column(spark, "A", values), ["A"]).collect())
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert got == pytest.approx(np.clip(sorted(values), q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)).tolist())


def test_iqr_drop_and_flag(spark):
    df = column(spark, "B", [7, 8, 8, 7, 9, 8, 7, -300, None])
    dropped = outliers.handle_outliers(df, ["B"], strategy="drop")
    assert dropped.count() == 8 and dropped.agg(F.min("B")).first()[0] == 7
    flags = outliers.handle_outliers(df, ["B"], strategy="flag")
    assert flags.agg(F.sum("B_is_outlier")).first()[0] == 1
    report = outliers.outlier_report(df, ["B"]).collect()[0]
    assert (report.n_outliers, report.pct) == (1, 11.11)


def test_zscore_cap(spark):
    out = outliers.handle_outliers(column(spark, "C", [20, 21] * 6 + [900]), ["C"], "zscore")
    assert out.count() == 13 and 21 < out.agg(F.max("C")).first()[0] < 900


def test_outlier_refusals(spark):
    df = column(spark, "D", [1, 2, 3])
    for args in (("unknown", 1.5, "cap"), ("iqr", 1.5, "unknown"), ("percentile", 1.5, "cap")):
        with pytest.raises(ValueError):
            outliers.handle_outliers(df, ["D"], *args)


def test_sequential_outliers(spark):
    rows = [(float(i % 5), float(i % 7)) for i in range(50)] + [(99.0, 1000.0), (2.0, 60.0)]
    out = outliers.remove_outliers_iqr(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    assert out.count() == 50


def test_scaling(spark):
    df = column(spark, "x", [1, 2, 3, 4])
    z = [r.x for r in scale.standard_scale(df, ["x"]).collect()]
    assert z == pytest.approx(list((np.arange(1, 5) - 2.5) / np.std([1, 2, 3, 4])))
    assert [r.x for r in scale.normalize(df, ["x"], -1, 1).collect()] == pytest.approx([-1, -1 / 3, 1 / 3, 1])
    assert [r.x for r in scale.robust_scale(df, ["x"]).collect()] == pytest.approx([-1, -1 / 3, 1 / 3, 1])
    flat = column(spark, "x", [5, None, 5])
    assert [r.x for r in scale.normalize(flat, ["x"], 2, 3).collect()] == [2.0, None, 2.0]
    assert [r.x for r in scale.standard_scale(column(spark, "x", [7, 7]), ["x"]).collect()] == [0.0, 0.0]
    with pytest.raises(PreconditionError):
        scale.standard_scale(flat, ["x"])


def test_one_hot(spark):
    df = column(spark, "wood", ["oak", "pine", "ash", "pine"], "string")
    out = encode.encode_categorical(df, "wood", "one_hot")
    assert out.columns == ["wood_oak", "wood_pine"] and [tuple(r) for r in out.collect()] == [(1, 0), (0, 1), (0, 0), (0, 1)]
    with pytest.raises(PreconditionError):
        encode.encode_categorical(df, "wood", "one_hot", max_categories=2)


def test_ordinal(spark):
    df = column(spark, "size", ["XL", "S", "M", "XL", "S"], "string")
    assert [r.size for r in encode.encode_categorical(df, "size", "ordinal").collect()] == [2, 1, 0, 2, 1]
    given = encode.encode_categorical(df, "size", "ordinal", ordered_categories=["S", "XL", "S"])
    assert [r.size for r in given.collect()] == [1, 2, None, 1, 2]
    many = spark.range(300).selectExpr("id", "concat('c', lpad(id, 4, '0')) AS c")
    coded = encode.encode_categorical(many, "c", "ordinal", rows_per_bucket=40)
    assert coded.filter("c <> id").count() == 0
    listed = encode.encode_categorical(many, "c", "ordinal", ordered_categories=[f"c{i:04d}" for i in range(299, 0, -1)])
    assert listed.filter("c = 299 - id").count() == 299 and listed.filter("c IS NULL").count() == 1


def test_frequency_target_binary(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0), ("c", 1.0), ("a", 1.0)], "k string, y double")
    freq = sorted(r.k_freq for r in encode.encode_categorical(df, "k", "frequency").collect())
    assert freq == [0.2, 0.2, 0.6, 0.6, 0.6]
    out = {r.y: r.k for r in encode.encode_categorical(df, "k", "target", target_column="y", min_samples_leaf=1).collect()}
    weight = 1 / (1 + np.exp(-2))
    assert out[0.0] == pytest.approx(weight * 2 / 3 + (1 - weight) * 0.8)
    bits = encode.encode_categorical(df, "k", "binary")
    assert bits.columns == ["y", "k_0", "k_1"]
    assert sorted((r.k_0, r.k_1) for r in bits.collect()) == [(0, 1)] * 3 + [(1, 0), (1, 1)]
    nulls = df.union(spark.createDataFrame([(None, 1.0)], df.schema))
    for method in encode.METHODS:
        with pytest.raises(PreconditionError):
            encode.encode_categorical(nulls, "k", method, target_column="y")
    with pytest.raises(ValueError):
        encode.encode_categorical(df, "k", "woe")


def test_bins(spark):
    salary = column(spark, "salary", [10000, 20000, 50000, 100000, 250000])
    out = binning.bin_column(salary, "salary", "equal_frequency", 4)
    assert out.select("salary_binned").distinct().count() == 4
    age = column(spark, "age", list(range(10, 101, 10)))
    out = binning.bin_column(age, "age", n_bins=5)
    assert [r.age_binned for r in out.orderBy("age").collect()][::2] == ["age_10_28", "age_28_46", "age_46_64", "age_64_82", "age_82_100"]
    own = binning.bin_column(age, "age", "custom", custom_boundaries=[10, 30, 90], labels=["a", "b"], output_column="g", drop_original=True)
    assert own.columns == ["g"] and [r.g for r in own.collect()] == ["a"] * 3 + ["b"] * 6 + [None]
    assert {r.bin: r.n_rows for r in binning.bin_report(own, "g").collect()} == {"a": 3, "b": 6, None: 1}
    many = binning.bin_column(spark.range(1000).withColumnRenamed("id", "v"), "v", n_bins=100, labels=[str(i) for i in range(100)])
    assert [r.n for r in many.groupBy("v_binned").agg(F.count("*").alias("n")).select("n").distinct().collect()] == [10] or \
        many.groupBy("v_binned").count().count() == 100
    for bad in ({"strategy": "custom", "custom_boundaries": [1]}, {"strategy": "odd"}, {"labels": ["x"]}):
        with pytest.raises(ValueError):
            binning.bin_column(age, "age", **bad)
    with pytest.raises(ValueError):
        binning.bin_column(age, "missing")


def test_lag_and_rolling_fixture(spark):
    rows = [(dt.datetime(2023, 1, 1 + i), 10 * (i + 1)) for i in range(5)]
    df = spark.createDataFrame(rows, "date timestamp, sales long")
    lagged = windows.create_lag_features(df, "sales", [1], "date")
    assert [r.sales_lag_1 for r in lagged.orderBy("date").collect()] == [None, 10, 20, 30, 40]
    assert windows.lag_nulls(lagged, ["sales_lag_1"]) == 1
    rolled = windows.create_rolling_features(df, "sales", [2], "date", min_periods=2).orderBy("date").collect()
    assert [r.sales_rolling_2_mean for r in rolled] == [None, 15.0, 25.0, 35.0, 45.0]
    for bad in (dict(lags=[0], order_by="date"), dict(lags=[1], order_by=[])):
        with pytest.raises(ValueError):
            windows.create_lag_features(df, "sales", **bad)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "b", 3), (1, "a", 2), (2, "c", 1), (1, "b", 3), (None, "d", 0), (None, "e", 5)], "k int, t string, o int")
    assert dedupe.drop_duplicates(df).count() == 5
    assert sorted(r.t for r in dedupe.drop_duplicates(df, ["k"], ["o"]).collect()) == ["a", "c", "d"]
    assert dedupe.duplicate_count(df) == 1
    maps = df.selectExpr("map('k', k) AS m", "t")
    assert dedupe.drop_duplicates(maps).count() == 5
    assert sorted(r.t for r in dedupe.drop_duplicates(maps.withColumn("o", F.col("t")), ["m"], ["o"]).collect()) == ["a", "c", "d"]


@pytest.mark.parametrize("hot", [None, 1])
@pytest.mark.parametrize("how,rows", [("inner", 5), ("left", 6), ("right", 6), ("outer", 7)])
def test_joins(spark, hot, how, rows):
    left = spark.createDataFrame([(1, "l1"), (1, "l2"), (None, "l3"), (4, "l4")], "k int, v string")
    right = spark.createDataFrame([(1, "r1"), (1, "r2"), (None, "r3"), (5, "r4")], "k int, v string")
    out = combine.merge(left, right, "k", how=how, hot_key_rows=hot)
    assert out.columns == ["k", "v_x", "v_y"] and out.count() == rows
    got = {(r.k, r.v_x, r.v_y) for r in out.collect()}
    assert (None, "l3", "r3") in got
    assert ((4, "l4", None) in got) == (how in ("left", "outer"))
    assert ((5, None, "r4") in got) == (how in ("right", "outer"))
    apart = combine.merge(left, right, "k", how=how, null_safe=False, hot_key_rows=hot)
    assert (None, "l3", "r3") not in {(r.k, r.v_x, r.v_y) for r in apart.collect()}


@pytest.fixture
def unsent(spark):
    """No table is small enough for Spark to send it to all tasks."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_rows_of_a_hot_key_are_joined_in_several_tasks(spark, monkeypatch, unsent, how):
    """Null keys, a key of one side only and equal rows; no task makes more than a part of the pairs."""
    monkeypatch.setattr(combine, "PAIRS_PER_TASK", 2_000, raising=False)
    monkeypatch.setattr(combine, "BLOCK_ROWS", 30, raising=False)
    left = spark.range(1200).selectExpr("IF(id % 2 = 0, NULL, IF(id % 3 = 0, 7L, id)) AS k", "id % 50 AS a")
    right = spark.range(300).selectExpr("IF(id % 3 = 0, NULL, IF(id % 3 = 1, 8L, CAST(id AS INT))) AS k", "id AS b")
    out = combine.merge(left, right, "k", how=how, hot_key_rows=40)
    counted = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    l, r = left.selectExpr("k", "a"), right.selectExpr("k AS k2", "b")
    plain = l.join(r, l.k.eqNullSafe(r.k2), {"outer": "full"}.get(how, how)).selectExpr("coalesce(k, k2) AS k", "a", "b")
    assert counted(out) == counted(plain)
    pairs = out.filter("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert sum(p["count"] for p in pairs) == 60_000 and max(p["count"] for p in pairs) < 20_000
    apart = combine.merge(left, right, "k", how=how, null_safe=False, hot_key_rows=40)
    plain = l.join(r, l.k == r.k2, {"outer": "full"}.get(how, how)).selectExpr("coalesce(k, k2) AS k", "a", "b")
    assert counted(apart) == counted(plain)


def test_few_rows_that_make_a_key_hot_do_not_make_small_blocks(spark, unsent):
    """A block is a task's worth of pairs: rows of one side are not copied for every few rows of the other."""
    left, right = spark.range(3000).selectExpr("CAST(NULL AS INT) AS k", "id AS a"), spark.range(500).selectExpr("CAST(NULL AS INT) AS k", "id AS b")
    keys, tasks, *_ = combine._hot_keys(left, right, (F.col("k"), F.col("k")), True, 5)
    assert tasks == 1 and [(r.hot, r.parts_l, r.parts_r) for r in keys.collect()] == [(None, 1, 1)]
    assert combine.merge(left, right, "k", how="outer", hot_key_rows=5).count() == 1_500_000


def test_join_keys_of_unlike_types(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([("1",)], "k string")
    with pytest.raises(PreconditionError):
        combine.merge(left, right, "k")
    with pytest.raises(ValueError):
        combine.merge(left, left, "k", how="cross")


def test_concat_rows(spark):
    out = combine.concat(spark.createDataFrame([(1, "a")], "x int, t string"), spark.createDataFrame([(2, 3.0)], "x int, y double"))
    assert out.columns == ["x", "t", "y"] and out.count() == 2
    with pytest.raises(PreconditionError):
        combine.concat(out, out, axis=1)


def test_merge_refuses_names_that_would_repeat(spark):
    left = spark.createDataFrame([(1, 2, 3)], "k long, a long, a_x long")
    with pytest.raises(PreconditionError, match="a_x"):
        combine.merge(left, spark.createDataFrame([(1, 2)], "k long, a long"), "k")


def test_group_quantiles_with_infinity(spark):
    from millrace.operators.quantiles import group_quantiles

    df = spark.createDataFrame([("a", 1.0), ("a", float("inf")), ("b", 2.0), ("b", 4.0)], "g string, x double")
    got = {r.g: (r.q0, r.q1) for r in group_quantiles(df, "g", "x", [0.0, 1.0]).collect()}
    assert got == {"a": (1.0, float("inf")), "b": (2.0, 4.0)}


def test_keep_first_carries_rows_once(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k", "id AS v", "concat('t', id) AS t")
    out = dedupe.drop_duplicates(df, ["k"], ["v"])
    assert sorted(r.v for r in out.collect()) == list(range(7))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SortAggregate" not in plan


def test_small_joins_start_no_job(spark):
    left, right = spark.range(100).selectExpr("id AS k", "id AS a"), spark.range(50).selectExpr("id AS k", "id AS b")
    spark.sparkContext.setJobGroup("plan", "joins are only planned")
    joined = combine.merge(left, right, "k", how="outer")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert joined.count() == 100
