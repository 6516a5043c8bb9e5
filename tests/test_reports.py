"""Profile, quality alerts and readiness findings against pandas."""

import json
import os

import numpy as np
import pandas as pd
import pytest

from millrace.operators.quantiles import group_quantiles
from millrace.reports import profile as P
from millrace.reports import readiness as R
from millrace.reports.facts import count_duplicates
from millrace.reports.quality import by_severity, quality_alerts


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(0)
    n = 300
    pdf = pd.DataFrame({
        "emp": [f"E{i:04d}" for i in range(n)],
        "age": rng.integers(20, 65, n),
        "salary": rng.lognormal(10, 1.5, n).round(2),
        "department": rng.choice(["HR", "IT", "OPS"], n),
        "active": np.where(rng.random(n) < 0.05, 0, 1),
        "score_text": [str(i) if i % 4 else "thirty" for i in range(n)],
        "join_date": [f"2023-01-{i % 28 + 1:02d}" if i % 10 else "soon" for i in range(n)],
        "empty": [None] * 250 + ["x"] * 50,
        "note": ["unknown" if i % 3 == 0 else f"note {i}" for i in range(n)],
    })
    pdf["salary_copy"] = pdf.salary * 2 + 1
    pdf = pd.concat([pdf, pdf.iloc[:6]], ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


def test_profile(people):
    pdf, df = people
    rows = {r.name: r for r in P.profile(df).collect()}
    assert [rows[c].position for c in pdf.columns] == list(range(len(pdf.columns)))
    kinds = {c: r.detected_type for c, r in rows.items()}
    assert kinds["age"] == "Numeric" and kinds["join_date"] == "Date" and kinds["department"] == "Categorical"
    assert kinds["emp"] == "Text"
    assert rows["empty"].null_count == 250 + 6 and rows["empty"].null_pct == pytest.approx(256 / 306 * 100)
    for c in pdf.columns:
        assert rows[c].unique_count == pdf[c].nunique()
        counts = pdf[c].value_counts()
        got = json.loads(rows[c].top_values)
        assert sorted(got.values(), reverse=True) == counts.head(5).tolist()
        assert all(counts[counts.index.astype(str) == k].iloc[0] == v for k, v in got.items())
    assert rows["salary"].mean_val == pytest.approx(pdf.salary.mean())
    assert rows["age"].min_val == str(pdf.age.min())


def test_numeric_card(people):
    pdf, df = people
    row = P.numeric_card(df, ["salary", "active"]).collect()[0]
    x = pdf.salary
    z = (x - x.mean()) / x.std(ddof=0)
    assert row.median == pytest.approx(x.median()) and row.std_dev == pytest.approx(x.std(ddof=0))
    assert row.skewness == pytest.approx((z**3).mean()) and row.kurtosis == pytest.approx((z**4).mean() - 3)
    flat = df.sparkSession.createDataFrame([(1.0,)] * 5, "x double")
    assert P.numeric_card(flat, ["x"]).collect()[0].skewness == 0


def test_histogram(people):
    pdf, df = people
    x = pdf.salary
    q1, q3 = x.quantile([0.25, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    rows = P.histogram(df, "salary").orderBy("bin").collect()
    assert [r.n_rows for r in rows] == np.histogram(inside, 10)[0].tolist()
    assert rows[0].n_excluded == len(x) - len(inside)


def test_before_after(spark, people):
    pdf, df = people
    after = df.fillna({"empty": "filled"})
    rows = {r.measure: r for r in P.before_after(df, after, "empty").collect()}
    assert rows["null_count"].delta == -256 and rows["n_unique"].delta == 1 and rows["mean"].before is None
    sample = P.before_after_sample(df.limit(300), after.limit(300), "age", ["emp"]).collect()
    assert len(sample) >= 15 and all(r.before == r.after for r in sample)


def test_quality_alerts(people):
    pdf, df = people
    alerts = quality_alerts(df)
    got = {(r.entity, r.type): r for r in alerts.collect()}
    assert ("empty", "missing_values") in got and "mostly empty" in got["empty", "missing_values"].recommended_action
    assert got["note", "placeholder_values"].missing_pct == pytest.approx((pdf.note == "unknown").mean() * 100)
    assert ("score_text", "mixed_type_numeric") in got
    assert ("score_text", "invalid_numeric_format") in got
    assert ("join_date", "invalid_date_format") in got
    assert got["(dataset)", "duplicate_rows"].missing_pct == pytest.approx(6 / 306 * 100)
    assert ("active", "class_imbalance") in got and "minority ‘0’" in got["active", "class_imbalance"].recommended_action
    assert got["salary", "skewed_distribution"].recommended_action.startswith(f"Skewness {pdf.salary.skew():.2f} ")
    assert ("empty", "constant_column") in got and ("emp", "high_cardinality") in got
    q1, q3 = pdf.salary.quantile([0.25, 0.75])
    n = int(((pdf.salary < q1 - 1.5 * (q3 - q1)) | (pdf.salary > q3 + 1.5 * (q3 - q1))).sum())
    assert got["salary", "outliers"].recommended_action.startswith(f"{n} outliers")
    ranked = by_severity(alerts).collect()
    assert [r.entity_rank for r in ranked] == sorted(r.entity_rank for r in ranked)
    assert all(r.entity_rank == 0 for r in ranked if r.entity == "(dataset)")
    assert quality_alerts(df.limit(0)).count() == 0


def test_duplicates_of_hot_row(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS a", "map('k', 1) AS m", "NULL AS n")
    assert count_duplicates(df) == 1000 - df.select("a").distinct().count()


def test_readiness(people):
    pdf, df = people
    found = {r.id: r for r in R.readiness_findings(df).collect()}
    assert "high_null_col_empty" in found and "zero_variance_empty" in found
    assert found["duplicate_rows"].severity == "warning"
    assert {"mixed_numeric_score_text", "hidden_datetime_join_date", "imbalanced_binary_active"} <= set(found)
    assert found["high_corr_salary_salary_copy"].affected_columns == ["salary", "salary_copy"]
    assert "high_cardinality_emp" in found and "skewed_dist_salary" in found
    summary = R.readiness_summary(df).collect()[0]
    order = [r.severity for r in R.readiness_findings(df).collect()]
    assert order == sorted(order, key=R.SEVERITIES.index)
    expected = 1 - 0.15 * order.count("critical") - 0.07 * order.count("warning") - 0.02 * order.count("info")
    assert summary.score == pytest.approx(max(0, expected)) and summary.domain == "hr"
    assert len(summary.top_actions) == 5


def test_constant_and_placeholder(spark):
    df = spark.createDataFrame([(i, 0 if i % 20 else i, 5.0 + i * 1e-4, -1.0 if i == 3 else 1.0) for i in range(100)],
                               "id long, z long, near double, price double")
    found = {r.id: r for r in R.readiness_findings(df, domain="generic").collect()}
    assert {"id_leakage_id", "placeholder_z", "near_zero_variance_near", "suspicious_negatives_price"} <= set(found)
    assert "Replace '0'" in found["placeholder_z"].suggested_action


def test_domain_rules(spark):
    hr = spark.createDataFrame([(30, 20, 100.0 + i, "A") for i in range(20)] + [(40, 5, 9999.0, "A")],
                               "age int, tenure int, salary double, department string")
    found = {r.id: r for r in R.readiness_findings(hr, domain="hr").collect()}
    assert found["hr_age_tenure_conflict"].detail.startswith("20 rows")
    assert found["hr_salary_dept_outlier"].detail.startswith("1 values")
    health = spark.createDataFrame([(150, 10), (30, 80)], "age int, heart_rate int")
    found = {r.id for r in R.readiness_findings(health, domain="healthcare").collect()}
    assert {"hc_impossible_age_age", "hc_impossible_hr_heart_rate"} <= found
    money = spark.createDataFrame([(1, -5.0), (2, 6.0)], "id int, amount double")
    assert "fi_negative_amounts" in {r.id for r in R.readiness_findings(money, domain="finance").collect()}


def test_domain_scores(spark):
    df = spark.createDataFrame([(i % 5, 70 + i % 50, None) for i in range(200)], "device_id int, reading int, note string")
    scores = {r.domain: r for r in R.domain_scores(df).collect()}
    assert scores["iot_sensor"].score == pytest.approx(0.30)
    assert "vital_values: reading" in scores["healthcare"].signals


def test_group_outliers_with_hot_group(spark):
    rows = [("hot", float(i % 50)) for i in range(3000)] + [("hot", 900.0), ("cold", 1.0), ("cold", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    assert [r.x for r in R.group_outliers(df, "g", "x").collect()] == [900.0]
    q = {r.g: r.q1 for r in group_quantiles(df, "g", "x", [0.25, 0.75], 10).collect()}
    assert q["hot"] == np.quantile([x for g, x in rows if g == "hot"], 0.75)


def test_long_texts_are_counted_by_hash(spark, monkeypatch):
    from millrace.reports import facts

    rows = [("x" * 60 + str(i % 40),) for i in range(300)] + [("y" * 80,)] * 9 + [("z" * 50,), (None,), ("12" * 30,)]
    df = spark.createDataFrame(rows, "t string")
    got = lambda: [(f.distinct, f.top, f.least, f.got["numbers"], f.present) for f in facts.column_facts(df, texts=True, values=12)]
    by_hash = got()
    for few in (1, 0):
        monkeypatch.setattr(facts, "FEW_CANDIDATES", few)
        assert got() == by_hash
    monkeypatch.setattr(facts, "LONG_TEXT", 10**9)
    assert got() == by_hash
    unique = spark.range(100).selectExpr("concat(repeat('u', 50), id) AS t")
    assert [f.top for f in facts.column_facts(unique, values=2)][0] == [("u" * 50 + "0", 1), ("u" * 50 + "1", 1)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")
@pytest.mark.parametrize("report", ["profile", "alerts", "readiness"])
def test_reports_of_lineitem_take_few_jobs(spark, jobs, report):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    run = {"profile": P.profile, "alerts": quality_alerts, "readiness": R.readiness_findings}[report]
    assert jobs(lambda: run(df)) <= 10


def test_costly_tables_are_read_once(spark, tmp_path):
    from millrace.reports import facts

    plain = spark.range(20).selectExpr("id", "CAST(id % 3 AS STRING) AS s")
    plain.write.parquet(str(tmp_path / "p"))
    plain.write.option("header", True).csv(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    parsed = spark.read.csv(str(tmp_path / "c"), header=True, inferSchema=True)
    assert facts.read_once(stored.filter("id > 2")) is not stored and "parquet" in str(facts.read_once(stored)._jdf.queryExecution().optimizedPlan())
    for costly in (parsed, stored.join(stored.select("id"), "id"), stored.groupBy("s").count()):
        assert "RDD" in facts.read_once(costly)._jdf.queryExecution().optimizedPlan().toString()
    assert P.profile(parsed).count() == 2


def test_facts_of_every_type(spark):
    """Distinct, most and least frequent values, ends and repeated rows, as one table and column by column."""
    from decimal import Decimal

    from millrace.reports.facts import column_facts

    df = spark.sql("""SELECT * FROM VALUES
        (1, 1.5D, CAST(0.1 AS FLOAT), 1.10BD, true, DATE'2020-01-05', TIMESTAMP_NTZ'2020-01-05 03:04:05', 'a', array(1)),
        (1, -0.0D, CAST(0.1 AS FLOAT), 1.10BD, true, DATE'2020-01-05', TIMESTAMP_NTZ'2020-01-05 03:04:05', 'b', array(1)),
        (2, 0.0D, CAST('NaN' AS FLOAT), -2.00BD, null, DATE'1969-12-31', null, 'b', array(1, 2)),
        (2, 0.0D, CAST('NaN' AS FLOAT), -2.00BD, null, DATE'1969-12-31', null, 'b', array(1, 2)),
        (null, 0.0D, null, null, null, null, null, 'b', null), (3, null, null, null, null, null, null, 'b', null)
        AS t(i, d, f, m, b, day, at, s, o)""")
    got = {f.name: f for f in column_facts(df, moments=True, values=2, repeats=True)}
    assert [got[c].distinct for c in df.columns] == [3, 2, 1, 2, 1, 2, 1, 2, 2]
    assert got["i"].top == [("1", 2), ("2", 2)] and got["i"].least == ("3", 1) and got["d"].top == [("0.0", 4), ("1.5", 1)]
    assert got["f"].top == [("0.1", 2)] and got["f"].present == 2 and got["b"].top == [("true", 2)]
    assert (got["i"].got["min"], got["i"].got["max"]) == (1, 3) and got["m"].got["min"] == Decimal("-2.00") and str(got["m"].got["max"]) == "1.10"
    assert str(got["day"].got["min"]) == "1969-12-31" and str(got["at"].got["max"]) == "2020-01-05 03:04:05"
    assert {f.repeats for f in got.values()} == {1} and {f.rows for f in got.values()} == {6}
    assert got["o"].top == [('{"v":[1]}', 2), ('{"v":[1,2]}', 2)]


@pytest.mark.parametrize("bytes_at_once", [64 << 20, 1])
def test_correlations_of_three_hundred_columns(spark, monkeypatch, bytes_at_once):
    """Tasks hand on one packed row each, and the rows meet in a tree."""
    monkeypatch.setattr(R, "PRODUCT_BYTES", bytes_at_once)
    rng = np.random.default_rng(4)
    cells = rng.normal(0, 1, (400, 300)) + 1000
    cells[:, 7] = cells[:, 3] * 2 + rng.normal(0, 0.1, 400)
    cells[rng.random(cells.shape) < 0.05] = np.nan
    cells[:, 9] = 5.0
    pdf = pd.DataFrame(cells, columns=[f"c{i}" for i in range(300)])
    df = spark.createDataFrame(pdf).repartition(12)
    from millrace.reports.facts import column_facts

    got = R.correlations(df, column_facts(df, moments=True))
    want = pdf.corr().to_numpy()
    for (a, b), r in got.items():
        i, j = int(a[1:]), int(b[1:])
        assert r is None if 9 in (i, j) else r == pytest.approx(want[i, j], abs=1e-9)
    sums = R.product_sums(df.select(*[df[c].cast("double") for c in df.columns[:3]]))
    assert sums[0][0, 1] == (~np.isnan(cells[:, 0]) & ~np.isnan(cells[:, 1])).sum()


def test_alert_of_copies_where_a_key_looks_like_a_placeholder(spark, tmp_path):
    """The key 999 is an alert on its column, which the query does not list."""
    import duckdb

    import __spark_entry__ as entry
    from check_queries import table

    spark.range(1000).selectExpr("id AS s_suppkey", "id / 7.0D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    got = entry.queries()["quality_alerts_of_copies"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()["quality_alerts_of_copies"])
    assert table(got.columns, got.collect()) == table([d[0] for d in want.description], want.fetchall())


def _large(spark, parts=5):
    """Columns of many kinds, nulls and NaN among them, dealt over some parts."""
    return spark.range(0, 3000, 1, parts).selectExpr(
        "id", "id % 400 AS some", "CAST(id % 7 AS INT) AS few", "CAST(9000000000000000000 + id % 20 AS BIGINT) AS big",
        "CASE WHEN id % 10 < 9 THEN 0 ELSE id END AS mostly", "IF(id % 3 = 0, NULL, CAST('NaN' AS DOUBLE)) AS none",
        "0.1D AS same", "IF(id % 11 = 0, CAST('NaN' AS DOUBLE), (id * 7919 % 1500 DIV 5) / 8.0D) AS x", "CAST(id % 5 / 10.0 AS FLOAT) AS f",
        "CAST(id % 600 AS DECIMAL(9, 2)) AS m", "IF(id % 50 = 0, 100000D, id % 90) AS far", "IF(id % 2 = 0, -0.0D, 0.0D) AS zero",
        "id % 2 AS bit", "CAST(id % 3 AS STRING) AS s", "DATE'2020-01-01' + CAST(id % 40 AS INT) AS day").unionAll(
        spark.range(1).selectExpr("-1", "1", "NULL", "9000000000000000001", "0", "NULL", "0.1D", "NULL", "0.1F", "NULL", "0.5D", "0.0D", "0", "NULL", "NULL"))


@pytest.mark.parametrize("block_rows", [7, 10_000])
def test_facts_of_large_tables_are_those_of_small_ones(spark, monkeypatch, block_rows):
    """Many values are not counted, everything else is as if they were."""
    from millrace.reports import facts, numbers

    df = _large(spark)
    df = df.unionAll(df.limit(3))
    run = lambda: {f.name: f for f in facts.column_facts(df, moments=True, texts=True, dates=True, signals=True, values=1, repeats=True, spread=True,
                                                         few=True, exact=("far",))}
    want = run()
    monkeypatch.setattr(facts, "LARGE_TABLE", -1)
    monkeypatch.setattr(numbers, "BYTES_AT_ONCE", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", block_rows)
    try:
        got = run()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not any(f.many for f in want.values())
    assert {c for c, f in got.items() if f.many} == ({"some", "big", "x"} if block_rows > 7 else set())
    for c, f in want.items():
        mine = got[c]
        assert (mine.kind, mine.rows, mine.present, mine.repeats) == (f.kind, f.rows, f.present, f.repeats)
        assert (mine.distinct, mine.top, mine.least) == ((11, [], None) if mine.many else (f.distinct, f.top, f.least)), c
        for name, v in f.got.items():
            if c == "same" and name in ("skew", "kurtosis"):  # Spark's are what rounding leaves of a constant column
                assert mine.got[name] is None
                continue
            assert name == "c" or mine.got.get(name) == (pytest.approx(v, rel=1e-9, nan_ok=True) if isinstance(v, float) else v), (c, name)


@pytest.mark.parametrize("report", [quality_alerts, R.readiness_findings])
def test_reports_of_large_tables_are_those_of_small_ones(spark, rows, monkeypatch, report):
    from millrace.reports import facts

    df = _large(spark).withColumnRenamed("some", "device_id")
    want = rows(report(df))
    monkeypatch.setattr(facts, "LARGE_TABLE", -1)
    assert want and rows(report(df)) == want


def test_values_of_large_tables_are_not_all_shuffled(spark, monkeypatch):
    """Of number columns with many values only facts of blocks leave the tasks."""
    from millrace.reports import facts

    counted = []
    monkeypatch.setattr(facts, "_counted_cells", lambda df, some, *switches: counted.extend(f.name for _, f in some) or [])
    df = _large(spark).select("some", "x", "few", "s", "id", "mostly")
    monkeypatch.setattr(facts, "LARGE_TABLE", -1)
    facts.column_facts(df, moments=True, texts=True, values=1, few=True)
    assert sorted(counted) == ["id", "mostly", "s"]


def test_moments_and_quartiles_of_far_numbers_in_large_tables(spark, monkeypatch):
    """Infinite values, and sorted ones whose parts do not overlap."""
    from millrace.reports import facts

    df = spark.range(0, 60_000, 1, 6).selectExpr("id DIV 2 AS half", "CASE id % 1000 WHEN 0 THEN CAST('Infinity' AS DOUBLE) ELSE sqrt(id) END AS i")
    run = lambda: {f.name: (f.present, f.got["q1"], f.got["median"], f.got["q3"], f.got["outliers"], f.got["mean"], f.got["min"], f.got["max"])
                   for f in facts.column_facts(df, moments=True, values=1, spread=True, few=True)}
    want = run()
    monkeypatch.setattr(facts, "LARGE_TABLE", -1)
    assert run() == want


def test_readiness_of_large_tables_counts_few_columns(spark, monkeypatch):
    """A column of many values is counted only if named like a device, or if all its values may differ."""
    from millrace.reports import facts

    counted = []
    whole = facts._counted_cells
    monkeypatch.setattr(facts, "_counted_cells", lambda df, some, *switches: counted.extend(f.name for _, f in some) or whole(df, some, *switches))
    monkeypatch.setattr(facts, "LARGE_TABLE", -1)
    df = _large(spark).selectExpr("some AS node", "x", "few", "s", "id")
    found = {r.id for r in R.readiness_findings(df).collect()}
    assert sorted(counted) == ["id", "node", "s"] and "id_leakage_id" in found


def test_brackets_of_many_equal_blocks_hold_the_quartiles(monkeypatch):
    """Sizes that no step divides, and blocks that are all alike, do not move the brackets."""
    from millrace.reports import numbers

    rng, x = np.random.default_rng(0), np.arange(6_100.0)
    monkeypatch.setattr(numbers, "POINTS", 64)
    found = [numbers._of_block(x, len(x), False, rng) for _ in range(400)]
    points, steps = [f["points"] for f in found], np.array([f["step"] for f in found])
    slack = 3 * float(np.sqrt((steps**2).sum()))
    weights = np.repeat(steps, [len(p) for p in points])
    low, high = numbers._brackets(np.concatenate(points), weights, 400 * len(x), slack, [0.25, 0.5, 0.75])
    for p, a, b in zip([0.25, 0.5, 0.75], low, high):
        assert a <= np.floor(p * (len(x) - 1)) and np.ceil(p * (len(x) - 1)) <= b and b - a < 100
