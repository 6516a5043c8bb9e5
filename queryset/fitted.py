"""Fills, outliers, scaling, encoding and binning."""

from pyspark.sql import functions as F

from millrace.operators import binning, encode, impute, knn, outliers, scale
from millrace.operators.quantiles import quantiles

from . import query, select
from .columns import LINES, LINES_SQL

# Fills.


@query("fill_constant", f"""
    SELECT l_orderkey, l_linenumber, l_quantity, coalesce(price, 0.0::DOUBLE) AS price, flag FROM ({LINES_SQL})""")
def _(t):
    return impute.fill_missing(t.derive("lineitem", LINES), ["price"], "constant", 0)


@query("fill_mean", f"""
    SELECT l_orderkey, l_linenumber, l_quantity, round(coalesce(price, avg(price) OVER ()), 4) AS price, flag
    FROM ({LINES_SQL})""")
def _(t):
    filled = impute.fill_missing(t.derive("lineitem", LINES), ["price"], "mean")
    return filled.withColumn("price", F.round("price", 4))


@query("fill_median", f"""
    SELECT l_orderkey, l_linenumber, l_quantity,
      round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM ({LINES_SQL}))), 4) AS price, flag
    FROM ({LINES_SQL})""")
def _(t):
    filled = impute.fill_missing(t.derive("lineitem", LINES), ["price"], "median")
    return filled.withColumn("price", F.round("price", 4))


@query("fill_mode", f"""
    SELECT l_orderkey, l_linenumber, l_quantity, price, coalesce(flag, (
      SELECT flag FROM ({LINES_SQL}) WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag
    FROM ({LINES_SQL})""")
def _(t):
    return impute.fill_missing(t.derive("lineitem", LINES), ["flag"], "mode")


PRICED = ["CAST(p_partkey AS STRING) AS part", "CAST(p_size AS DOUBLE) AS size", "CAST(length(p_name) AS DOUBLE) AS name_length",
          "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price"]


@query("knn_impute", f"""
    WITH b AS ({select(PRICED, 'part')}),
    near AS (
      SELECT q.part, d.price, row_number() OVER (PARTITION BY q.part ORDER BY
        (q.size - d.size) * (q.size - d.size) + (q.name_length - d.name_length) * (q.name_length - d.name_length), d.price) AS rn
      FROM b q JOIN b d ON q.price IS NULL AND d.price IS NOT NULL),
    means AS (SELECT part, avg(price) AS mean FROM near WHERE rn <= 5 GROUP BY part)
    SELECT b.part, b.size, b.name_length, round(coalesce(b.price, means.mean), 4) AS price
    FROM b LEFT JOIN means ON b.part = means.part""")
def _(t):
    filled = knn.knn_impute(t.derive("part", PRICED), ["price"], 5)
    return filled.withColumn("price", F.round("price", 4))


HOLED = ["CAST(c_custkey AS STRING) AS cust", "CAST(c_nationkey AS DOUBLE) AS nation",
         "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE round(c_acctbal) END AS balance",
         "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(length(c_mktsegment) AS DOUBLE) END AS segment"]


@query("knn_impute_with_missing_coordinates", f"""
    WITH b AS ({select(HOLED, 'customer')}),
    near AS (
      SELECT q.cust, d.balance, row_number() OVER (PARTITION BY q.cust ORDER BY
        ((q.nation - d.nation) * (q.nation - d.nation) + coalesce((q.segment - d.segment) * (q.segment - d.segment), 0))
        * 2 / CASE WHEN q.segment - d.segment IS NULL THEN 1 ELSE 2 END, d.balance) AS rn
      FROM b q JOIN b d ON q.balance IS NULL AND d.balance IS NOT NULL),
    means AS (SELECT cust, avg(balance) AS mean FROM near WHERE rn <= 3 GROUP BY cust)
    SELECT b.cust, b.nation, b.segment, round(coalesce(b.balance, means.mean), 4) AS balance
    FROM b LEFT JOIN means ON b.cust = means.cust""")
def _(t):
    filled = knn.knn_impute(t.derive("customer", HOLED), ["balance"], 3)
    return filled.withColumn("balance", F.round("balance", 4))


GAPS = ["CAST(c_custkey AS STRING) AS cust", "CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS a",
        "CASE WHEN c_custkey % 9 <> 0 THEN CAST(length(c_mktsegment) AS DOUBLE) END AS b",
        "CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey * 37 % 101 AS DOUBLE) END AS c",
        "CASE WHEN c_custkey % 6 <> 0 THEN round(c_acctbal) END AS balance"]


@query("knn_impute_with_gaps_in_blocks", f"""
    WITH v AS ({select(GAPS, 'customer')}),
    p AS (SELECT q.cust, d.balance, coalesce((q.a - d.a) ** 2, 0) + coalesce((q.b - d.b) ** 2, 0) + coalesce((q.c - d.c) ** 2, 0) AS total,
      CAST(q.a - d.a IS NOT NULL AS INTEGER) + CAST(q.b - d.b IS NOT NULL AS INTEGER) + CAST(q.c - d.c IS NOT NULL AS INTEGER) AS shared
      FROM v q JOIN v d ON q.balance IS NULL AND d.balance IS NOT NULL),
    near AS (SELECT cust, balance, row_number() OVER (PARTITION BY cust ORDER BY total * 3 / shared, balance) AS rn FROM p WHERE shared > 0),
    means AS (SELECT cust, avg(balance) AS mean FROM near WHERE rn <= 3 GROUP BY cust)
    SELECT v.cust, a, b, c, round(coalesce(v.balance, means.mean, (SELECT avg(balance) FROM v)), 4) AS balance
    FROM v LEFT JOIN means ON v.cust = means.cust""")
def _(t):
    filled = knn.knn_impute(t.derive("customer", GAPS), ["balance"], 3, block_rows=100)
    return filled.withColumn("balance", F.round("balance", 4))


TWELVE = ["CAST(vec_id AS STRING) AS vec"] + [f"round(CAST(element_at(embedding, {j + 1}) AS DOUBLE), 4) AS e{j}" for j in range(12)] + [
    "CASE WHEN vec_id % 6 <> 0 THEN round(CAST(element_at(embedding, 13) AS DOUBLE), 4) END AS t"]
unsigned_zero = lambda x: f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE {x} END"
_fourth = lambda j: unsigned_zero(f"round(CAST(embedding[{j}] AS DOUBLE), 4)")
TWELVE_SQL = ", ".join(["CAST(vec_id AS VARCHAR) AS vec", *[f"{_fourth(j + 1)} AS e{j}" for j in range(12)],
                        f"CASE WHEN vec_id % 6 <> 0 THEN {_fourth(13)} END AS t"])


@query("knn_impute_in_twelve_dimensions", f"""
    WITH v AS (SELECT {TWELVE_SQL} FROM embeddings),
    near AS (SELECT q.vec, d.t, row_number() OVER (PARTITION BY q.vec ORDER BY {' + '.join(f'(q.e{j} - d.e{j}) ** 2' for j in range(12))}, d.t) AS rn
      FROM v q JOIN v d ON q.t IS NULL AND d.t IS NOT NULL),
    means AS (SELECT vec, avg(t) AS mean FROM near WHERE rn <= 4 GROUP BY vec)
    SELECT v.* EXCLUDE (t), {unsigned_zero('round(coalesce(v.t, means.mean), 6)')} AS t FROM v LEFT JOIN means ON v.vec = means.vec""")
def _(t):
    filled = knn.knn_impute(t.derive("embeddings", TWELVE), ["t"], 4)
    return filled.withColumn("t", F.round("t", 6))


# Outliers. Prices get a heavy tail, since the given ones have no outliers.

TAILED = ["l_orderkey", "l_linenumber", "l_quantity",
          "CASE WHEN l_partkey % 50 = 0 THEN l_extendedprice * 20 WHEN l_partkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS price"]
TAILED_SQL = select(TAILED, "lineitem")
BOUNDS = {
    "iqr": ("iqr", 1.5, "quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))",
            "quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"),
    "zscore": ("zscore", 2.0, "avg({c}) - 2 * stddev_samp({c})", "avg({c}) + 2 * stddev_samp({c})"),
    "percentile": ("percentile", 0.05, "quantile_cont({c}, 0.05)", "quantile_cont({c}, 0.95)"),
}


def bounds_sql(method: str, column: str, source: str) -> str:
    _, _, low, high = BOUNDS[method]
    return f"SELECT {low.format(c=column)} AS lo, {high.format(c=column)} AS hi FROM ({source})"


def _register_outliers(method: str):
    name, fold, _, _ = BOUNDS[method]
    limits = bounds_sql(method, "price", TAILED_SQL)
    outside = "(price < lo OR price > hi)"

    @query(f"outliers_{method}_cap", f"""
        SELECT l_orderkey, l_linenumber, l_quantity, round(CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END, 3) AS price
        FROM ({TAILED_SQL}), ({limits})""")
    def _(t):
        out = outliers.handle_outliers(t.derive("lineitem", TAILED), ["price"], name, fold, "cap")
        return out.withColumn("price", F.round("price", 3))

    @query(f"outliers_{method}_drop", f"""
        SELECT l_orderkey, l_linenumber, l_quantity, price FROM ({TAILED_SQL}), ({limits}) WHERE NOT coalesce({outside}, false)""")
    def _(t):
        return outliers.handle_outliers(t.derive("lineitem", TAILED), ["price"], name, fold, "drop")

    @query(f"outliers_{method}_flag", f"""
        SELECT l_orderkey, l_linenumber, l_quantity, price, CAST(coalesce({outside}, false) AS INTEGER) AS price_is_outlier
        FROM ({TAILED_SQL}), ({limits})""")
    def _(t):
        return outliers.handle_outliers(t.derive("lineitem", TAILED), ["price"], name, fold, "flag")


for _method in BOUNDS:
    _register_outliers(_method)


@query("outlier_report", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", round(lo, 3) AS lower, round(hi, 3) AS upper,
      count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS n_outliers,
      round(count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count(*) * 100, 2) AS pct
    FROM ({TAILED_SQL}), ({bounds_sql('iqr', c, TAILED_SQL)}) GROUP BY lo, hi""" for c in ("price", "l_quantity")))
def _(t):
    report = outliers.outlier_report(t.derive("lineitem", TAILED), ["price", "l_quantity"])
    return report.withColumns({"lower": F.round("lower", 3), "upper": F.round("upper", 3)})


SEQUENTIAL = ["l_orderkey", "l_linenumber", "CASE WHEN l_partkey % 50 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price",
              "CASE WHEN l_partkey % 50 = 1 THEN l_quantity * 9 WHEN l_partkey % 50 = 0 THEN l_quantity * 90 ELSE l_quantity END AS quantity"]


@query("remove_outliers_iqr", f"""
    WITH first AS (SELECT * EXCLUDE (lo, hi) FROM ({select(SEQUENTIAL, 'lineitem')}),
      ({bounds_sql('iqr', 'price', select(SEQUENTIAL, 'lineitem'))}) WHERE price IS NULL OR price BETWEEN lo AND hi)
    SELECT * EXCLUDE (lo, hi) FROM first, ({bounds_sql('iqr', 'quantity', 'SELECT * FROM first')})
    WHERE quantity IS NULL OR quantity BETWEEN lo AND hi""")
def _(t):
    return outliers.remove_outliers_iqr(t.derive("lineitem", SEQUENTIAL), ["price", "quantity"])


# Scaling.


@query("standard_scale", """
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice,
      round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity FROM lineitem""")
def _(t):
    columns = ["l_extendedprice", "l_quantity"]
    out = scale.standard_scale(t.lineitem.select("l_orderkey", "l_linenumber", *columns), columns)
    return out.withColumns({c: F.round(c, 6) for c in columns})


@query("normalize", f"""
    SELECT l_orderkey, l_linenumber, l_quantity,
      round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) * 2 - 1, 6) AS price, flag
    FROM ({LINES_SQL})""")
def _(t):
    out = scale.normalize(t.derive("lineitem", LINES), ["price"], -1, 1)
    return out.withColumn("price", F.round("price", 6))


@query("normalize_constant", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 0.0::DOUBLE END AS level FROM customer""")
def _(t):
    flat = t.derive("customer", ["c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 5 END AS level"])
    return scale.normalize(flat, ["level"])


@query("robust_scale", """
    SELECT c_custkey, round((c_acctbal - q[2]) / (q[3] - q[1]), 6) AS c_acctbal
    FROM customer, (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer)""")
def _(t):
    out = scale.robust_scale(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


# Encoding.

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _one_hot(column, values):
    return ", ".join(f"CAST({column} = '{v}' AS INTEGER) AS \"{column}_{v}\"" for v in values)


@query("encode_one_hot", f"SELECT c_custkey, {_one_hot('c_mktsegment', SEGMENTS[1:])} FROM customer")
def _(t):
    return encode.encode_categorical(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "one_hot")


@query("encode_one_hot_all", f"SELECT l_orderkey, l_linenumber, {_one_hot('l_returnflag', 'ANR')} FROM lineitem")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return encode.encode_categorical(lines, "l_returnflag", "one_hot", drop_first=False)


@query("encode_ordinal", """
    SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority FROM orders""")
def _(t):
    return encode.encode_categorical(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "ordinal")


@query("encode_ordinal_given_order", """
    SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 END AS BIGINT) AS o_orderstatus FROM orders""")
def _(t):
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    return encode.encode_categorical(orders, "o_orderstatus", "ordinal", ordered_categories=["P", "O"])


@query("encode_ordinal_many_categories", """
    SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY l_partkey) - 1 AS BIGINT) AS l_partkey FROM lineitem""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return encode.encode_categorical(lines, "l_partkey", "ordinal", rows_per_bucket=500)


@query("encode_frequency", """
    SELECT o_orderkey, round(count(*) OVER (PARTITION BY o_orderpriority) / count(*) OVER (), 9) AS o_orderpriority_freq FROM orders""")
def _(t):
    out = encode.encode_categorical(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "frequency")
    return out.withColumn("o_orderpriority_freq", F.round("o_orderpriority_freq", 9))


@query("encode_target", """
    WITH s AS (SELECT l_partkey, count(*) AS n, avg(l_discount) AS m FROM lineitem GROUP BY l_partkey),
    w AS (SELECT l_partkey, m, 1 / (1 + exp(-(n - 20)::DOUBLE)) AS w FROM s)
    SELECT l_orderkey, l_linenumber, l_discount, round(w * m + (1 - w) * (SELECT avg(l_discount) FROM lineitem), 7) AS l_partkey
    FROM lineitem JOIN w USING (l_partkey)""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_partkey")
    out = encode.encode_categorical(lines, "l_partkey", "target", target_column="l_discount")
    return out.withColumn("l_partkey", F.round("l_partkey", 7))


@query("encode_binary", """
    WITH c AS (SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) AS INTEGER) AS code FROM part)
    SELECT p_partkey, (code >> 4) & 1 AS p_brand_0, (code >> 3) & 1 AS p_brand_1, (code >> 2) & 1 AS p_brand_2,
      (code >> 1) & 1 AS p_brand_3, code & 1 AS p_brand_4 FROM c""")
def _(t):
    return encode.encode_categorical(t.part.select("p_partkey", "p_brand"), "p_brand", "binary")


@query("encoding_report", """
    SELECT 'frequency' AS method, 'c_mktsegment_freq' AS new_columns, count(DISTINCT c_mktsegment) AS n_unique,
      CAST(1 AS BIGINT) AS n_new_columns FROM customer""")
def _(t):
    customers = t.customer.select("c_custkey", "c_mktsegment")
    out = encode.encode_categorical(customers, "c_mktsegment", "frequency")
    report = encode.encoding_report(customers, out, "c_mktsegment", "frequency")
    return report.withColumn("new_columns", F.array_join("new_columns", ","))


# Binning.


@query("bin_equal_width", """
    WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, (max(c_acctbal) - min(c_acctbal)) / 5 AS w FROM customer)
    SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal <= lo + w THEN 'b1' WHEN c_acctbal <= lo + 2 * w THEN 'b2'
      WHEN c_acctbal <= lo + 3 * w THEN 'b3' WHEN c_acctbal <= lo + 4 * w THEN 'b4' ELSE 'b5' END AS c_acctbal_binned
    FROM customer, m""")
def _(t):
    customers = t.customer.select("c_custkey", "c_acctbal")
    return binning.bin_column(customers, "c_acctbal", "equal_width", 5, ["b1", "b2", "b3", "b4", "b5"])


def _edge_labels(edges: list[str], column: str) -> str:
    """Bins by SQL edges, labelled by the half-even rounded edges."""
    whole = lambda e: f"CAST(round_even(round({e}, 3), 0) AS BIGINT)"
    first = f"CAST(round_even(round({edges[0]}, 3) - 0.001, 0) AS BIGINT)"
    lows = [first, *[whole(e) for e in edges[1:-1]]]
    cases = " ".join(
        f"WHEN {column} <= {hi} THEN concat('{column}_', {lo}, '_', {whole(hi)})" for lo, hi in zip(lows, edges[1:]))
    return f"CASE WHEN {column} < {edges[0]} THEN NULL {cases} END"


_EVEN = ["(lo - (hi - lo) * 0.001)", *[f"(lo + {i} * ((hi - lo) / 8))" for i in range(1, 8)], "hi"]


@query("bin_equal_width_edge_labels", f"""
    SELECT o_orderkey, {_edge_labels(_EVEN, 'o_totalprice')} AS price_band
    FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
def _(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    return binning.bin_column(orders, "o_totalprice", "equal_width", 8, output_column="price_band", drop_original=True)


_QUANTILES = [f"q[{i}]" for i in range(1, 6)]


@query("bin_equal_frequency", f"""
    SELECT l_orderkey, l_linenumber, l_extendedprice, {_edge_labels(_QUANTILES, 'l_extendedprice')} AS l_extendedprice_binned
    FROM lineitem, (SELECT quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) AS q FROM lineitem)""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return binning.bin_column(lines, "l_extendedprice", "equal_frequency", 4)


TIED = ["l_orderkey", "l_linenumber", "CASE WHEN l_quantity <= 35 THEN 1 ELSE l_quantity END AS level"]


@query("bin_equal_frequency_tied", f"""
    SELECT l_orderkey, l_linenumber, level, {_edge_labels(['lo', 'q', 'hi'], 'level')} AS level_binned
    FROM ({select(TIED, 'lineitem')}),
      (SELECT min(level) AS lo, quantile_cont(level, 0.75) AS q, max(level) AS hi FROM ({select(TIED, 'lineitem')}))""")
def _(t):
    return binning.bin_column(t.derive("lineitem", TIED), "level", "equal_frequency", 4)


@query("bin_custom", """
    SELECT p_partkey, p_size, CASE WHEN p_size < 5 THEN NULL WHEN p_size <= 10 THEN 'p_size_5_10'
      WHEN p_size <= 25 THEN 'p_size_10_25' WHEN p_size <= 40 THEN 'p_size_25_40' END AS p_size_binned FROM part""")
def _(t):
    return binning.bin_column(t.part.select("p_partkey", "p_size"), "p_size", "custom", custom_boundaries=[5, 10, 25, 40])


@query("bin_report", """
    SELECT CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 25 THEN 'medium' ELSE 'large' END AS bin, count(*) AS n_rows
    FROM part GROUP BY 1""")
def _(t):
    binned = binning.bin_column(t.part, "p_size", "custom", custom_boundaries=[0, 10, 25, 50], labels=["small", "medium", "large"])
    return binning.bin_report(binned, "p_size_binned")


@query("encode_ordinal_repeated_order", """
    SELECT l_orderkey, l_linenumber, CAST(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS BIGINT) AS l_returnflag FROM lineitem""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return encode.encode_categorical(lines, "l_returnflag", "ordinal", ordered_categories=["R", "A", "N", "R"])


@query("encode_ordinal_repeated_long_order", """
    SELECT o_orderkey, CAST(CASE WHEN o_custkey < 50 THEN 150 + o_custkey WHEN o_custkey < 150 THEN o_custkey END AS BIGINT) AS o_custkey FROM orders""")
def _(t):
    order = [*range(150), *range(50)]
    return encode.encode_categorical(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "ordinal", ordered_categories=order)


@query("quantiles_with_infinity", """
    WITH v AS (SELECT CASE WHEN l_orderkey % 100 = 0 THEN CAST('inf' AS DOUBLE) ELSE l_quantity END AS x FROM lineitem)
    SELECT quantile_cont(x, 0.25) AS low, quantile_cont(x, 0.5) AS mid, max(x) AS high FROM v""")
def _(t):
    lines = t.derive("lineitem", ["CASE WHEN l_orderkey % 100 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity END AS x"])
    low, mid, high = quantiles(lines, ["x"], [0.25, 0.5, 1.0])["x"]
    return t.spark.createDataFrame([(low, mid, high)], "low double, mid double, high double")
