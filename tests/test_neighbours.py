"""Nearest neighbours and rebalancing, against brute force on small tables."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.frame import PreconditionError
from millrace.operators import knn, resample
from millrace.operators.knn import knn_impute, nearest


def brute_impute(pdf, target, k):
    """Mean of the k nearest rows by distance over shared coordinates, ties by value."""
    others = [c for c in pdf.columns if c not in (target,)]
    x, y = pdf[others].to_numpy(float), pdf[target].to_numpy(float)
    out = y.copy()
    for i in np.flatnonzero(np.isnan(y)):
        found = []
        for j in np.flatnonzero(~np.isnan(y)):
            gap = x[i] - x[j]
            shared = ~np.isnan(gap)
            if shared.any():
                found.append((np.sqrt((gap[shared] ** 2).sum() * len(others) / shared.sum()), y[j]))
        found.sort()
        out[i] = np.mean([v for _, v in found[:k]]) if found else np.nanmean(y)
    return out


@pytest.mark.parametrize("block", [None, 25])
@pytest.mark.parametrize("holes", [0.0, 0.2])
def test_impute_equals_brute_force(spark, block, holes):
    rng = np.random.default_rng(2)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n, dtype=float), "a": rng.integers(0, 30, n).astype(float),
                        "b": rng.normal(0, 5, n), "t": rng.normal(50, 9, n), "u": rng.normal(0, 1, n)})
    pdf.loc[rng.random(n) < 0.4, ["a", "b", "u"]] = [7.0, 1.5, 0.5]  # many copies
    pdf = pdf.drop(columns="id")
    for c in ("t", "u"):
        pdf.loc[rng.random(n) < 0.15, c] = np.nan
    if holes:
        for c in ("a", "b"):
            pdf.loc[rng.random(n) < holes, c] = np.nan
        pdf.loc[0, :] = np.nan
    df = spark.createDataFrame(pdf.assign(key=range(n)).astype({"key": str}))
    out = knn_impute(df, ["t", "u"], 4, block).toPandas()
    out = out.assign(key=out.key.astype(int)).sort_values("key")
    np.testing.assert_allclose(out.t, brute_impute(pdf, "t", 4), rtol=1e-9)
    np.testing.assert_allclose(out.u, brute_impute(pdf, "u", 4), rtol=1e-9)
    assert len(out) == n


@pytest.mark.parametrize("block", [None, 30])
def test_nearest_leaves_out_itself(spark, block):
    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (200, 3)).round(1)
    points[:60] = points[0]
    df = spark.createDataFrame([("g", [float(v) for v in p]) for p in points], "grp string, vec array<double>")
    out = nearest(df, df.withColumn("val", F.col("vec")), 3, 5, skip_self=True, block_rows=block).collect()
    assert len(out) == len({tuple(p) for p in points})
    for row in out:
        away = np.sort(np.linalg.norm(points - np.array(row["vec"]), axis=1))[1:6]
        got = list(itertools.chain.from_iterable([h["dist"]] * h["n"] for h in row["hits"]))[:5]
        np.testing.assert_allclose(got, away, atol=1e-12)


def sizes(df, target="target"):
    return {r[0]: r[1] for r in df.groupBy(target).count().collect()}


def table(spark, counts, n_features=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"r{i}", *(float(v) for v in rng.normal(c * 3, 1, n_features)), c)
            for c, n in counts.items() for i in range(n)]
    names = ["name", *[f"f{i}" for i in range(n_features)], "target"]
    return spark.createDataFrame(rows, names)


FX12 = [(1, 1.1, 0), (2, 2.1, 0), (1, 1.2, 0), (2, 2.2, 0), (1, 1.3, 0), (2, 2.3, 0), (8, 8.1, 1), (9, 9.1, 1)]


def test_small_over_and_undersample(spark):
    df = spark.createDataFrame(FX12, "feature1 long, feature2 double, target int")
    grown = resample.handle_imbalance(df, "target", ["feature1", "feature2"], k_neighbors=1)
    assert sizes(grown) == {0: 6, 1: 6} and grown.count() == 12
    new = grown.filter("target = 1").toPandas()
    assert new.feature1.between(8, 9).all() and new.feature2.between(8.1, 9.1).all()
    shrunk = resample.handle_imbalance(df, "target", strategy="undersample")
    assert sizes(shrunk) == {0: 2, 1: 2}
    assert not set(map(tuple, shrunk.collect())) - set(FX12)


@pytest.mark.parametrize("bucket,block", [(None, None), (15, 20)])
def test_classes_balance_and_others_are_null(spark, bucket, block):
    df = table(spark, {0: 200, 1: 45, 2: 70})
    out = resample.handle_imbalance(df, "target", k_neighbors=5, rows_per_bucket=bucket, block_rows=block)
    assert sizes(out) == {0: 200, 1: 200, 2: 200}
    assert out.filter("name IS NULL").count() == 155 + 130
    assert out.filter("name IS NOT NULL").select("name", "f0", "target").exceptAll(
        df.select("name", "f0", "target")).count() == 0
    made = out.filter("name IS NULL AND target = 1").toPandas()
    real = df.filter("target = 1").toPandas()
    for f in ("f0", "f1", "f2"):
        assert made[f].between(real[f].min(), real[f].max()).all()
    assert made[["f0", "f1", "f2"]].drop_duplicates().shape[0] > 100


def test_synthetic_rows_lie_between_neighbours(spark):
    """In one dimension a new value lies between a row and one of its 2 nearest."""
    xs = [0.0, 1.0, 10.0, 11.0, 12.0, 100.0]
    rows = [(x, 1) for x in xs] + [(float(-i), 0) for i in range(60)]
    out = resample.handle_imbalance(spark.createDataFrame(rows, "x double, target int"), "target", k_neighbors=2)
    made = sorted(r.x for r in out.filter("target = 1").collect())
    assert len(made) == 60
    for v in made:
        assert any(min(a, b) <= v <= max(a, b) for a in xs for b in sorted(xs, key=lambda o: abs(o - a))[1:3])


@pytest.mark.parametrize("bucket", [None, 20])
def test_undersample_keeps_whole_rows_and_copies(spark, bucket):
    copies = spark.range(900).selectExpr("1.0D AS f", "'same' AS name", "0 AS target")
    rare = spark.createDataFrame([(float(i), f"n{i}", 1) for i in range(50)], "f double, name string, target int")
    out = resample.handle_imbalance(copies.union(rare), "target", ["f"], strategy="undersample", rows_per_bucket=bucket)
    assert sizes(out) == {0: 50, 1: 50}


def test_smote_then_undersample_and_ratio(spark):
    df = table(spark, {0: 60, 1: 20})
    assert sizes(resample.handle_imbalance(df, "target", strategy="smote_then_undersample")) == {0: 60, 1: 60}
    assert sizes(resample.handle_imbalance(df, "target", sampling_strategy=0.5)) == {0: 60, 1: 30}
    assert sizes(resample.handle_imbalance(df, "target", strategy="undersample", sampling_strategy=0.5)) == {0: 40, 1: 20}


def test_same_choice_each_time(spark):
    df = table(spark, {0: 80, 1: 20})
    for strategy in ("smote", "undersample"):
        a, b = (resample.handle_imbalance(df.repartition(n), "target", strategy=strategy) for n in (2, 7))
        assert a.exceptAll(b).count() == 0


def test_float_target_becomes_integer(spark):
    df = table(spark, {0: 30, 1: 10}).withColumn("target", F.col("target").cast("double"))
    assert sizes(resample.handle_imbalance(df, "target")) == {0: 30, 1: 30}
    rounded = df.withColumn("target", F.when(F.col("name") == "r3", 0.73).otherwise(F.col("target")))
    assert set(sizes(resample.handle_imbalance(rounded, "target"))) == {0, 1}


def test_refusals(spark):
    text = spark.createDataFrame([("a", 1.0, 0)] * 4 + [("b", 2.0, 1)] * 2, "name string, score double, target int")
    with pytest.raises(PreconditionError):
        resample.handle_imbalance(text, "target", ["name"])
    holes = spark.createDataFrame([(None, 0), (1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1), (5.0, 1)], "f0 double, target int")
    with pytest.raises(PreconditionError):
        resample.handle_imbalance(holes, "target")
    with pytest.raises(ValueError):
        resample.handle_imbalance(holes, "absent")
    one = spark.createDataFrame([(float(i), 1) for i in range(6)], "f double, target int")
    with pytest.raises(PreconditionError):
        resample.handle_imbalance(one, "target")
    smooth = spark.createDataFrame([(float(i), i / 7) for i in range(40)], "f double, target double")
    with pytest.raises(PreconditionError):
        resample.handle_imbalance(smooth, "target")


def handed_on(spark, monkeypatch, points, queries, block, k=3):
    """(query, block) rows of the first searches and of all after them, and what was found."""
    asked, search = [], knn._search_blocks
    monkeypatch.setattr(knn, "_search_blocks", lambda asks, *rest: asked.append(asks.count()) or search(asks, *rest))
    rows = [("g", [None if np.isnan(v) else float(v) for v in p]) for p in points]
    df = spark.createDataFrame(rows, "grp string, vec array<double>")
    some = spark.createDataFrame([("g", [None if np.isnan(v) else float(v) for v in p]) for p in queries], "grp string, vec array<double>")
    found = nearest(some, df.withColumn("val", F.col("vec")), points.shape[1], k, block_rows=block).collect()
    monkeypatch.setattr(knn, "_search_blocks", search)
    return asked[0], sum(asked[1:]), found


@pytest.mark.parametrize("holes", [0.02, 0.2])
def test_missing_values_do_not_widen_the_search(spark, monkeypatch, holes):
    """Rows handed to further blocks stay near those of the same table without nulls."""
    rng = np.random.default_rng(8)
    points = rng.normal(0, 1, (6000, 3))
    _, whole, _ = handed_on(spark, monkeypatch, points, points[:400], 200)
    points[rng.random(points.shape) < holes] = np.nan
    _, more, _ = handed_on(spark, monkeypatch, points, points[:400], 200)
    assert more / 400 <= (1.6 if holes < 0.1 else 3) * whole / 400 + 7  # one more for each set of missing coordinates


def clusters(rng, n, dims, centres):
    middle = rng.uniform(0, 100, (centres, dims))
    return middle[rng.integers(0, centres, n)] + rng.normal(0, 1.5, (n, dims))


def assert_nearest(found, points, k):
    for row in found:
        away = np.sort(np.linalg.norm(points - np.array(row["vec"]), axis=1))[:k]
        np.testing.assert_allclose([h["dist"] for h in row["hits"]][:k], away, atol=1e-9)


def test_few_blocks_are_searched_in_twelve_dimensions(spark, monkeypatch, caplog):
    """Clusters let pivots and boxes rule blocks out; between uniform values the work is foretold."""
    rng = np.random.default_rng(3)
    points = clusters(rng, 7800, 12, 60)
    queries = clusters(np.random.default_rng(3), 7800, 12, 60)[:300] + rng.normal(0, 0.5, (300, 12))
    first, more, found = handed_on(spark, monkeypatch, points, queries, 200)
    assert first == 300 and first + more < 0.25 * 300 * 39
    assert_nearest(found, points, 3)

    caplog.set_level("INFO", "millrace.operators.knn")
    points = rng.uniform(0, 1, (7800, 12))
    _, more, found = handed_on(spark, monkeypatch, points, points[:100], 200)
    assert_nearest(found, points, 3)
    told = caplog.records[-1]
    queries, blocks, to_come, every = told.args
    assert queries == 100 and every == queries * blocks and told.levelname == "WARNING"
    assert 0.9 * more <= to_come <= 1.3 * more + 100  # each later wave may need less


@pytest.mark.parametrize("sent", [True, False])
def test_three_levels_of_boxes(spark, monkeypatch, sent):
    """A directory of any height, sent to tasks or joined; many queries share a rack."""
    monkeypatch.setattr(knn, "FAN", 4)
    monkeypatch.setattr(knn, "QUERY_ROWS", 50)
    if not sent:
        monkeypatch.setattr(knn, "SENT_BYTES", 0)
        monkeypatch.setattr(knn, "SENT_ROWS", 0)
    trees, tree = [], knn.Tree
    monkeypatch.setattr(knn, "Tree", lambda *a: trees.append(tree(*a)) or trees[-1])
    rng = np.random.default_rng(5)
    points = clusters(rng, 1500, 6, 20)
    points[:200] = points[0]
    _, _, found = handed_on(spark, monkeypatch, points, points[:300], 25)
    assert trees[-1].depth >= 3 and (trees[-1].top is not None) == sent
    assert max(r[0] for r in trees[-1].leaves.selectExpr("size(counts)").collect()) <= 25
    assert max(r[0] for r in trees[-1].nodes.filter("level > 0").selectExpr("size(children)").collect()) <= 4
    for row in found:
        away = np.sort(np.linalg.norm(points - np.array(row["vec"]), axis=1))[:3]
        got = list(itertools.chain.from_iterable([h["dist"]] * h["n"] for h in row["hits"]))[:3]
        np.testing.assert_allclose(got, away, atol=1e-9)


def test_bounds_are_below_every_distance():
    rng = np.random.default_rng(6)
    for dims, holes in ((2, 0), (5, 0.2), (12, 0.05)):
        points, queries = rng.normal(0, 3, (80, dims)), rng.normal(0, 3, (60, dims))
        for x in (points, queries):
            x[rng.random(x.shape) < holes] = np.nan
        pivots = rng.normal(0, 3, (4, dims))
        shapes = knn._shape(points)
        parts = [points[shapes == s] for s in sorted(set(shapes))] + [points[i : i + 20] for i in range(0, 80, 20)]
        names = [*sorted(set(shapes)), *[None] * 4]
        boxes = knn.Boxes(np.array([knn._summary(p, s, pivots) for p, s in zip(parts, names)]), names, pivots, dims)
        least = np.array([knn._distances(queries, p).min(axis=1) for p in parts]).T
        assert (boxes.bounds(queries) <= least * (1 + 1e-12)).all()


def test_blocks_stay_few_with_scattered_nulls_and_many_groups(spark, monkeypatch):
    """Donors that each lack other coordinates share blocks, and small groups share racks; results stay exact."""
    trees, tree = [], knn.Tree
    monkeypatch.setattr(knn, "Tree", lambda *a: trees.append(tree(*a)) or trees[-1])
    rng = np.random.default_rng(9)
    points = rng.normal(0, 1, (1000, 16))
    points[rng.random(points.shape) < 0.4] = np.nan
    pdf = pd.DataFrame(points, columns=[f"c{j}" for j in range(16)])
    pdf["t"] = np.where(rng.random(1000) < 0.05, np.nan, rng.normal(50, 9, 1000))
    out = knn_impute(spark.createDataFrame(pdf.assign(key=range(1000)).astype({"key": str})), ["t"], 4, 100).toPandas()
    out = out.assign(key=out.key.astype(int)).sort_values("key")
    np.testing.assert_allclose(out.t, brute_impute(pdf, "t", 4), rtol=1e-9)
    assert 5 <= trees[-1].blocks <= 40

    many = spark.range(900).selectExpr("concat('g', id % 300) AS grp", "array(cast(id as double)) AS vec")
    got = nearest(many, many.withColumn("val", F.col("vec")), 1, 1, skip_self=True, block_rows=50).collect()
    assert trees[-1].leaves.select("rack").distinct().count() <= 40 and len(got) == 900
    assert all(r["hits"][0]["dist"] == 300 for r in got)


def test_classes_do_not_deal_rows(spark):
    """Rows meet the plan of their class where they are, not all rows of a class in one task."""
    df = spark.range(4000).selectExpr("id", "CAST(id % 20 AS DOUBLE) AS f", "id % 10 < 8 AS target")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = resample.undersample(df, "target")
        assert sizes(out) == {True: 800, False: 800}
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_small_blocks_share_tasks(spark):
    """Tasks grow with the rows, not with the blocks they are cut into."""
    donors = spark.range(20_000).selectExpr("'a' AS grp", "array(CAST(id AS DOUBLE)) AS vec", "array(CAST(id AS DOUBLE)) AS val", "1L AS n")
    tree = knn.Tree(donors, 20_000, 1, 20)
    assert tree.blocks >= 1000 and tree.leaves.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_groups_without_a_layout_are_placed_at_once():
    class Layout:
        def __init__(self, start):
            self.start, self.calls = start, 0

        def place(self, points):
            self.calls += 1
            return points[:, 0].astype(np.int64) + self.start

    layouts = {None: Layout(0), "7": Layout(10_000)}
    groups, points = np.array([str(i % 300) for i in range(3000)], object), np.arange(3000.0)[:, None]
    spots = knn._spots(layouts, groups, points)
    assert (spots == np.arange(3000) + np.where(groups == "7", 10_000, 0)).all()
    assert layouts[None].calls == layouts["7"].calls == 1


def test_searching_a_block_takes_little_memory_at_once():
    """2,000 queries of a full block of donors in 64 dimensions."""
    import tracemalloc

    rng = np.random.default_rng(5)
    points, queries = rng.normal(size=(knn.BLOCK_ROWS, 64)), rng.normal(size=(2_000, 64))
    leaf = {"points": points.ravel(), "vals": points.ravel(), "counts": np.ones(len(points), np.int64)}
    tracemalloc.start()
    hits, sizes = knn._search(queries, np.full(len(queries), np.inf), leaf, 5, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and (sizes == 5).all()
    first = ((queries[:, None, :] - points[None, :100]) ** 2).sum(axis=2)
    assert (np.array(hits.field("dist").to_pylist()).reshape(-1, 5)[:, 0] <= np.sqrt(first.min(axis=1)) + 1e-9).all()
