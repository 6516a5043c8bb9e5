"""Duplicates, joins, row order, windows and rebalancing."""

from pyspark.sql import functions as F

from millrace.operators import combine, dedupe, resample, windows
from millrace.sources.flatten import flatten
from millrace.sources.readers import preview

from . import query, select

# Duplicates: every order appears twice, as the given tables have no copies.


@query("drop_duplicate_rows", "SELECT * FROM orders")
def _(t):
    return dedupe.drop_duplicates(t.orders.unionAll(t.orders))


@query("drop_duplicate_keys_keep_first", """
    SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
    FROM orders) WHERE rn = 1""")
def _(t):
    return dedupe.drop_duplicates(t.orders.unionAll(t.orders), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("drop_duplicate_maps", """
    SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events GROUP BY 1, 2""")
def _(t):
    maps = t.derive("events", ["event_type", "from_json(props, 'map<string,bigint>') AS props"])
    return dedupe.drop_duplicates(maps).selectExpr("event_type", "props['k'] AS k")


@query("duplicate_report", """
    SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_returnflag)) AS n_distinct,
      count(*) - count(DISTINCT (l_orderkey, l_returnflag)) AS n_duplicates FROM lineitem""")
def _(t):
    return dedupe.duplicate_report(t.lineitem.select("l_orderkey", "l_returnflag"))


# Joins, with null keys on both sides.

ORDERS = ["o_orderkey", "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS cust", "o_totalprice"]
CUSTOMERS = ["CASE WHEN c_custkey % 500 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS cust",
             "c_name", "c_acctbal"]


def _join_sql(how: str) -> str:
    return (f"SELECT o_orderkey, coalesce(l.cust, r.cust) AS cust, o_totalprice, c_name, c_acctbal FROM "
            f"({select(ORDERS, 'orders')}) l {how} JOIN ({select(CUSTOMERS, 'customer')}) r "
            f"ON l.cust IS NOT DISTINCT FROM r.cust")


def _register_join(how: str, sql: str):
    @query(f"merge_{how}", _join_sql(sql))
    def _(t):
        return combine.merge(t.derive("orders", ORDERS), t.derive("customer", CUSTOMERS), "cust", how=how)


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _register_join(_how, _sql)


@query("merge_outer_with_hot_keys", _join_sql("FULL"))
def _(t):
    return combine.merge(t.derive("orders", ORDERS), t.derive("customer", CUSTOMERS), "cust", how="outer", hot_key_rows=50)


@query("merge_nulls_apart", _join_sql("LEFT").replace("IS NOT DISTINCT FROM", "="))
def _(t):
    return combine.merge(t.derive("orders", ORDERS), t.derive("customer", CUSTOMERS), "cust", how="left", null_safe=False)


@query("merge_different_key_names", """
    SELECT n_nationkey, n_name AS name_x, n_regionkey, r_regionkey, r_name AS name_y
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    nations = t.nation.withColumnRenamed("n_name", "name")
    regions = t.region.withColumnRenamed("r_name", "name")
    return combine.merge(nations, regions, "n_regionkey", "r_regionkey")


@query("concat_rows", """
    SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_mktsegment FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier""")
def _(t):
    customers = t.derive("customer", ["c_custkey AS key", "c_name AS name", "c_nationkey AS nation", "c_mktsegment"])
    suppliers = t.derive("supplier", ["s_name AS name", "s_suppkey AS key", "s_nationkey AS nation"])
    return combine.concat_rows(customers, suppliers)


@query("concat_columns", """
    SELECT c_custkey, c_name, key_x, p_partkey, p_name, key_y
    FROM (SELECT c_custkey, c_name, c_nationkey AS key_x, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer)
    FULL JOIN (SELECT p_partkey, p_name, p_size AS key_y, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rn FROM part) USING (rn)""")
def _(t):
    customers = t.customer.withColumnRenamed("c_nationkey", "key")
    parts = t.part.withColumnRenamed("p_size", "key")
    out = combine.concat_columns(customers, parts, ["c_acctbal", "c_custkey"], ["p_retailprice", "p_partkey"], rows_per_bucket=400)
    return out.select("c_custkey", "c_name", "key_x", "p_partkey", "p_name", "key_y")


@query("preview", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def _(t):
    return preview(t.orders, ["o_orderdate", "o_orderkey"], 100)


# Order-dependent features. The *_split queries force several buckets.

USER = "PARTITION BY user_id ORDER BY ts, event_id"
EVENTS = ["event_id", "user_id", "ts", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value"]
EVENTS_SQL = select(EVENTS, "events")
ORDER = ["ts", "event_id"]


def _lag_sql(over, source, keys, column, lags):
    return f"SELECT {keys}, {column}, " + ", ".join(
        f"lag({column}, {n}) OVER ({over}) AS {column}_lag_{n}" for n in lags) + f" FROM {source}"


@query("lag_features", _lag_sql(USER, f"({EVENTS_SQL})", "event_id, user_id, ts", "value", (1, 3)))
def _(t):
    return windows.create_lag_features(t.derive("events", EVENTS), "value", [3, 1], ORDER, "user_id")


@query("lag_features_split", _lag_sql("ORDER BY o_orderdate, o_orderkey", "orders", "o_orderkey, o_orderdate", "o_totalprice", (1, 7)))
def _(t):
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return windows.create_lag_features(orders, "o_totalprice", [1, 7], ["o_orderdate", "o_orderkey"], rows_per_bucket=2000)


STATS = {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "median": "quantile_cont({c}, 0.5)"}


def _rolling_sql(over, source, keys, column, sizes, stats, least=1):
    parts = []
    for n in sizes:
        frame = f"OVER ({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for s in stats:
            cell = STATS[s].format(c=column)
            parts.append(f"round(CASE WHEN count({column}) {frame} >= {least} THEN {cell} {frame} END, 4) AS {column}_rolling_{n}_{s}")
    return f"SELECT {keys}, {column}, {', '.join(parts)} FROM {source}"


def _rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in df.columns if "_rolling_" in c})


@query("rolling_mean_and_std", _rolling_sql(USER, f"({EVENTS_SQL})", "event_id, user_id, ts", "value", (3, 7), ("mean", "std")))
def _(t):
    return _rounded(windows.create_rolling_features(t.derive("events", EVENTS), "value", [3, 7], ORDER, partition_by="user_id"))


@query("rolling_min_and_max", _rolling_sql(USER, f"({EVENTS_SQL})", "event_id, user_id, ts", "value", (5,), ("min", "max"), 3))
def _(t):
    return _rounded(windows.create_rolling_features(
        t.derive("events", EVENTS), "value", [5], ORDER, ["min", "max"], 3, "user_id"))


@query("rolling_median", _rolling_sql(USER, f"({EVENTS_SQL})", "event_id, user_id, ts", "value", (7,), ("median",)))
def _(t):
    return _rounded(windows.create_rolling_features(
        t.derive("events", EVENTS), "value", [7], ORDER, ["median"], partition_by="user_id"))


@query("rolling_features_split", _rolling_sql("ORDER BY o_orderdate, o_orderkey", "orders", "o_orderkey, o_orderdate",
                                              "o_totalprice", (7,), ("mean", "min", "max")))
def _(t):
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return _rounded(windows.create_rolling_features(
        orders, "o_totalprice", [7], ["o_orderdate", "o_orderkey"], ["mean", "min", "max"], rows_per_bucket=2000))


SPARSE = ["event_id", "user_id", "ts", "CASE WHEN event_id % 4 = 0 THEN value ELSE NULL END AS value"]
SPARSE_SQL = select(SPARSE, "events")


@query("forward_fill", f"""
    SELECT event_id, user_id, ts, last_value(value IGNORE NULLS) OVER ({USER} ROWS UNBOUNDED PRECEDING) AS value FROM ({SPARSE_SQL})""")
def _(t):
    return windows.time_series_fill(t.derive("events", SPARSE), ["value"], ORDER, partition_by="user_id")


@query("backward_fill", f"""
    SELECT event_id, user_id, ts, first_value(value IGNORE NULLS) OVER ({USER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
    FROM ({SPARSE_SQL})""")
def _(t):
    return windows.time_series_fill(t.derive("events", SPARSE), ["value"], ORDER, "bfill", "user_id")


GAPPED = ["o_orderkey", "o_orderdate", "CASE WHEN o_custkey % 40 = 0 THEN o_totalprice ELSE NULL END AS price"]


@query("forward_fill_split", f"""
    SELECT o_orderkey, o_orderdate, last_value(price IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS price
    FROM ({select(GAPPED, 'orders')})""")
def _(t):
    return windows.time_series_fill(t.derive("orders", GAPPED), ["price"], ["o_orderdate", "o_orderkey"], rows_per_bucket=2000)


@query("backward_fill_split", f"""
    SELECT o_orderkey, o_orderdate, first_value(price IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price FROM ({select(GAPPED, 'orders')})""")
def _(t):
    return windows.time_series_fill(t.derive("orders", GAPPED), ["price"], ["o_orderdate", "o_orderkey"], "bfill", rows_per_bucket=2000)


# Rebalancing.

LABELLED = "SELECT l.doc_id, d.n_chars, l.quality, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def labelled(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars", "quality", "toxic")


@query("smote_report", f"""
    SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS n_before,
      (SELECT max(n) FROM (SELECT count(*) AS n FROM ({LABELLED}) GROUP BY toxic)) AS n_after
    FROM ({LABELLED}) GROUP BY toxic""")
def _(t):
    docs = labelled(t)
    return resample.balance_report(docs, resample.handle_imbalance(docs, "toxic", ["n_chars", "quality"]), "toxic")


@query("smote_rows", f"""
    SELECT toxic, count(*) AS n_given, (SELECT max(n) FROM (SELECT count(*) AS n FROM ({LABELLED}) GROUP BY toxic)) - count(*) AS n_made,
      0 AS n_outside, 0 AS n_wrong FROM ({LABELLED}) GROUP BY toxic""")
def _(t):
    """Made rows must lie between two given ones of their class, and be null but for features and class."""
    docs = labelled(t)
    out = resample.handle_imbalance(docs, "toxic", ["n_chars", "quality"])
    limits = docs.groupBy(F.col("toxic").alias("of")).agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
    made = F.col("doc_id").isNull()
    outside = ~F.col("n_chars").between(F.col("low"), F.col("high")) | ~F.col("quality").between(0, 1)
    wrong = F.col("n_chars").isNull() | F.col("quality").isNull()
    return out.join(limits, F.col("toxic") == F.col("of")).groupBy("toxic").agg(
        F.count_if(~made).alias("n_given"), F.count_if(made).alias("n_made"),
        F.count_if(made & outside).cast("int").alias("n_outside"), F.count_if(made & wrong).cast("int").alias("n_wrong"))


@query("smote_keeps_the_given_rows", LABELLED)
def _(t):
    grown = resample.handle_imbalance(labelled(t), "toxic", ["n_chars", "quality"])
    return grown.filter("doc_id IS NOT NULL").select("doc_id", "n_chars", "quality", "toxic")


@query("undersample_report", f"""
    SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS n_before,
      (SELECT min(n) FROM (SELECT count(*) AS n FROM ({LABELLED}) GROUP BY toxic)) AS n_after
    FROM ({LABELLED}) GROUP BY toxic""")
def _(t):
    docs = labelled(t)
    return resample.balance_report(docs, resample.handle_imbalance(docs, "toxic", strategy="undersample"), "toxic")


@query("undersample_rows", f"""
    SELECT toxic, (SELECT min(n) FROM (SELECT count(*) AS n FROM ({LABELLED}) GROUP BY toxic)) AS n_kept,
      (SELECT min(n) FROM (SELECT count(*) AS n FROM ({LABELLED}) GROUP BY toxic)) AS n_given FROM ({LABELLED}) GROUP BY toxic""")
def _(t):
    """Kept rows, and how many of them are different given rows."""
    docs = labelled(t)
    kept = resample.handle_imbalance(docs, "toxic", strategy="undersample")
    given = kept.distinct().join(docs, docs.columns, "left_semi").groupBy(F.col("toxic").alias("of")).agg(F.count("*").alias("n_given"))
    return kept.groupBy("toxic").agg(F.count("*").alias("n_kept")).join(given, F.col("toxic") == F.col("of")).drop("of")


@query("undersample_of_many_classes", """
    WITH c AS (SELECT o_custkey % 1500 AS class, count(*) AS n_before FROM orders GROUP BY 1)
    SELECT CAST(class AS VARCHAR) AS class, n_before, (SELECT min(n_before) FROM c) AS n_after FROM c""")
def _(t):
    orders = t.derive("orders", ["o_orderkey", "o_totalprice", "o_custkey % 1500 AS class"])
    return resample.balance_report(orders, resample.handle_imbalance(orders, "class", strategy="undersample"), "class")


@query("smote_of_many_classes", """
    WITH c AS (SELECT o_custkey % 1500 AS class, count(*) AS n_before FROM orders GROUP BY 1)
    SELECT CAST(class AS VARCHAR) AS class, n_before, (SELECT max(n_before) FROM c) AS n_after FROM c""")
def _(t):
    orders = t.derive("orders", ["o_orderkey", "o_totalprice", "o_custkey % 1500 AS class"])
    copies = orders.unionAll(orders)  # every class needs two rows
    report = resample.balance_report(copies, resample.handle_imbalance(copies, "class", ["o_totalprice"]), "class")
    return report.withColumns({"n_before": (F.col("n_before") / 2).cast("bigint"), "n_after": (F.col("n_after") / 2).cast("bigint")})


@query("smote_then_undersample_report", f"""
    SELECT CAST(quality AS VARCHAR) AS class, count(*) AS n_before,
      (SELECT max(n) FROM (SELECT count(*) AS n FROM ({LABELLED}) GROUP BY quality)) AS n_after
    FROM ({LABELLED}) GROUP BY quality""")
def _(t):
    docs = labelled(t)
    after = resample.handle_imbalance(docs, "quality", ["n_chars"], strategy="smote_then_undersample")
    return resample.balance_report(docs, after, "quality")


@query("class_distribution", "SELECT label AS class, count(*) AS n_rows FROM embeddings GROUP BY label")
def _(t):
    return resample.class_counts(t.embeddings, "label")


@query("discrete_target", "SELECT doc_id, CAST(toxic AS BIGINT) AS toxic FROM labels")
def _(t):
    return resample.discrete_target(t.derive("labels", ["doc_id", "CAST(toxic AS DOUBLE) AS toxic"]), "toxic")


@query("smote_of_embeddings", """
    SELECT CAST(label AS VARCHAR) AS class, count(*) AS n_before,
      (SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) AS n_after
    FROM embeddings GROUP BY label""")
def _(t):
    points = flatten(t.embeddings, "_")
    features = [c for c in points.columns if c.startswith("embedding_")]
    return resample.balance_report(points, resample.handle_imbalance(points, "label", features), "label")
