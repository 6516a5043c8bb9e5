"""Step replay."""

from pyspark.sql import functions as F

from millrace.operators import resample
from millrace.plans.steps import error_report, run_steps, step_checksum

from . import query
from .columns import LINES, LINES_SQL

FLAGSHIP = [
    {"operation": "fill_missing", "params": {"columns": ["price"], "method": "mean"}},
    {"operation": "filter_rows", "params": {"condition": "l_quantity > 10"}},
    {"operation": "normalize", "params": {"columns": ["price"]}},
]
FLAGSHIP_SQL = f"""
    WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity, coalesce(price, avg(price) OVER ()) AS price, flag FROM ({LINES_SQL})),
    k AS (SELECT * FROM f WHERE l_quantity > 10)
    SELECT l_orderkey, l_linenumber, l_quantity, flag,
      round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) AS price FROM k"""


@query("replay_fill_filter_normalize", FLAGSHIP_SQL)
def flagship(t):
    out, errors = run_steps(t.derive("lineitem", LINES), FLAGSHIP)
    assert not errors
    return out.withColumn("price", F.round("price", 6))


LONGER = [
    {"operation": "drop_duplicates", "params": {"columns": []}},
    {"operation": "fill_missing", "params": {"columns": ["O_TOTALPRICE"], "method": "median"}},
    {"operation": "merge", "params": {"secondary_dataset_id": "customers", "how": "left", "left_on": "o_custkey", "right_on": "c_custkey"}},
    {"operation": "text_case", "params": {"columns": ["c_mktsegment"], "case": "title"}},
    {"operation": "extract_datetime_components", "params": {"column": "o_orderdate", "components": ["year", "is_weekend"]}},
    {"operation": "standard_scale", "params": {"columns": ["c_name"]}},
    {"operation": "bin_column", "params": {"column": "c_acctbal", "strategy": "custom", "custom_boundaries": [-10000, 0, 10000],
                                           "labels": ["owes", "has"], "drop_original": True}},
    {"operation": "drop_columns", "params": {"columns": ["c_name", "c_nationkey", "o_orderdate"]}},
]


@query("replay_longer_list", """
    WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS p, o_orderdate, o_orderpriority FROM orders)
    SELECT o_orderkey, o_custkey, o_orderstatus, round(coalesce(p, (SELECT quantile_cont(p, 0.5) FROM o)), 3) AS o_totalprice, o_orderpriority,
      c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
      CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS o_orderdate_is_weekend,
      CASE WHEN c_acctbal IS NULL THEN NULL WHEN c_acctbal <= 0 THEN 'owes' ELSE 'has' END AS c_acctbal_binned
    FROM o LEFT JOIN customer ON o_custkey = c_custkey""")
def _(t):
    orders = t.orders.withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END"))
    out, errors = run_steps(orders.unionAll(orders), LONGER, {"customers": t.customer})
    assert [e["step_index"] for e in errors] == [5]
    return out.withColumn("o_totalprice", F.round("o_totalprice", 3))


@query("replay_on_another_table", """
    SELECT s_suppkey, lower(s_name) AS s_name, s_nationkey, round((s_acctbal - min(s_acctbal) OVER ()) /
      (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS s_acctbal FROM supplier""")
def _(t):
    steps = [{"operation": "text_case", "params": {"columns": ["NAME"]}}, {"operation": "normalize", "params": {"columns": ["acctbal"]}}]
    rename = lambda df, p: df.withColumnsRenamed({c: c.removeprefix(p) for c in df.columns})
    first, errors = run_steps(rename(t.customer, "c_"), steps)
    second, more = run_steps(rename(t.supplier, "s_"), steps)
    assert not errors and not more
    return second.select(*[F.col(c).alias(f"s_{c}") for c in second.columns]).withColumn("s_acctbal", F.round("s_acctbal", 6))


BAD_STEPS = [  # each breaks one rule that is checked before a step runs
    ("fill_missing", {"columns": ["flag"], "method": "mean"}),
    ("fill_missing", {"columns": ["absent"], "method": "median"}),
    ("knn_impute", {"columns": ["flag"]}),
    ("handle_outliers", {"columns": ["flag"], "method": "iqr", "strategy": "cap"}),
    ("remove_outliers_iqr", {"columns": ["absent"]}),
    ("standard_scale", {"columns": ["price"]}),
    ("normalize", {"columns": ["flag"]}),
    ("round_numeric", {"columns": ["flag"]}),
    ("encode_categorical", {"column": "absent", "method": "one_hot"}),
    ("encode_categorical", {"column": "flag", "method": "target", "target_column": "absent"}),
    ("bin_column", {"column": "flag", "strategy": "equal_width", "n_bins": 3}),
    ("create_lag_features", {"column": "absent", "lags": [1], "sort_by": "l_orderkey"}),
    ("create_lag_features", {"column": "price", "lags": [1], "sort_by": "absent"}),
    ("create_rolling_features", {"column": "flag", "windows": [3], "sort_by": "l_orderkey"}),
    ("extract_datetime_components", {"column": "absent", "components": ["year"]}),
    ("merge", {"secondary_dataset_id": "lines", "left_on": "absent", "right_on": "l_orderkey", "how": "left"}),
    ("drop_missing", {"columns": ["absent"]}),
    ("text_case", {"columns": ["absent"]}),
    ("validate_format", {"columns": ["absent"]}),
    ("filter_rows", {"condition": "nothing > 1"}),
    ("handle_imbalance", {"target_column": "absent"}),
    ("handle_imbalance", {"target_column": "flag", "feature_columns": ["price"]}),
    ("handle_imbalance", {"target_column": "price", "feature_columns": ["l_quantity"]}),
]


@query("replay_errors", " UNION ALL ".join(
    f"SELECT {i} AS step_index, '{name}' AS operation, 'pre_flight_check' AS skipped_by" for i, (name, _) in enumerate(BAD_STEPS)))
def _(t):
    lines = t.derive("lineitem", LINES)
    steps = [{"operation": name, "params": params} for name, params in BAD_STEPS]
    steps.append({"operation": "drop_missing", "params": {}})
    _, errors = run_steps(lines, steps, {"lines": t.lineitem})
    return error_report(t.spark, errors).drop("error")


GUARDS = {  # steps that must be refused, or must pass, on line items and orders
    "merge_number_with_text": ("merge", {"secondary_dataset_id": "orders", "left_on": "l_orderkey", "right_on": "o_orderstatus"}, True),
    "merge_number_with_number": ("merge", {"secondary_dataset_id": "orders", "left_on": "l_orderkey", "right_on": "o_orderkey"}, False),
    "balance_without_numeric_features": ("handle_imbalance", {"target_column": "l_linestatus", "feature_columns": ["flag"]}, True),
    "balance_with_nulls_in_features": ("handle_imbalance", {"target_column": "l_linestatus", "feature_columns": ["price"]}, True),
    "balance_of_a_continuous_target": ("handle_imbalance", {"target_column": "l_extendedprice", "feature_columns": ["l_quantity"]}, True),
    "balance_excluding_columns": ("handle_imbalance", {"target_column": "l_linestatus", "strategy": "undersample",
                                                       "exclude_columns": ["price"]}, False),
    "checksum_that_fits": ("text_case", {"columns": ["flag"], "case": "lower"}, False),
    "checksum_that_does_not_fit": ("text_case", {"columns": ["flag"], "case": "lower"}, True),
    "float_turned_into_text": ("fill_missing", {"columns": ["price"], "method": "constant", "value": "none"}, True),
}


@query("step_guards", " UNION ALL ".join(
    f"SELECT '{name}' AS guard, {refused} AS refused, CAST(CASE WHEN {refused} THEN count(*) END AS BIGINT) AS n_rows FROM lineitem"
    for name, (_, _, refused) in GUARDS.items()))
def _(t):
    """Whether each step is refused; a refused one leaves all rows as they are."""
    lines = t.derive("lineitem", LINES + ["l_linestatus", "l_extendedprice"])
    out = []
    for name, (operation, params, _) in GUARDS.items():
        step = {"operation": operation, "params": params}
        if name.startswith("checksum"):
            step["parameter_checksum"] = step_checksum(params if name.endswith("that_fits") else {})
        left, errors = run_steps(lines, [step], {"orders": t.orders})
        out.append((name, bool(errors), left.count() if errors else None))
    return t.spark.createDataFrame(out, "guard string, refused boolean, n_rows bigint")


@query("smote_of_small_classes", """
    WITH c AS (SELECT p_size % 10 = 0 AND p_partkey % 20 < 3 AS rare, count(*) AS n FROM part GROUP BY 1)
    SELECT CAST(rare AS VARCHAR) AS class, n AS n_before, (SELECT max(n) FROM c) AS n_after FROM c""")
def _(t):
    """More neighbours asked for than the smaller class has; they are lowered to what it has."""
    parts = t.derive("part", ["p_partkey", "p_retailprice", "CAST(p_size AS DOUBLE) AS p_size", "p_size % 10 = 0 AND p_partkey % 20 < 3 AS rare"])
    grown = resample.handle_imbalance(parts, "rare", exclude_columns=["p_partkey"], k_neighbors=100_000)
    return resample.balance_report(parts, grown, "rare")
