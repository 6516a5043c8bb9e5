"""Projection, filters, conversions, formats and dates."""

from pyspark.sql import functions as F

from millrace.fixed_values import FORMAT_PATTERNS
from millrace.operators import columns as C
from millrace.sources.flatten import flatten_json_column

from . import query, select

LINES = ["l_orderkey", "l_linenumber", "l_quantity",
         "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS price",
         "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_returnflag END AS flag"]
LINES_SQL = select(LINES, "lineitem")


@query("drop_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
def _(t):
    keep = {"l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"}
    return C.drop_columns(t.lineitem, [c for c in t.lineitem.columns if c not in keep])


@query("rename_columns", "SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer")
def _(t):
    return C.rename_columns(t.customer, {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"})


@query("filter_rows", "SELECT * FROM lineitem WHERE l_quantity > 30 AND (l_returnflag = 'R' OR NOT l_discount < 0.05)")
def _(t):
    return C.filter_rows(t.lineitem, "l_quantity > 30 and (l_returnflag == 'R' or not l_discount < 0.05)")


@query("filter_rows_keeping_nulls", f"SELECT * FROM ({LINES_SQL}) WHERE flag IS DISTINCT FROM 'R'")
def _(t):
    return C.filter_rows(t.derive("lineitem", LINES), "NOT (flag <=> 'R')")


@query("drop_missing_any", f"SELECT * FROM ({LINES_SQL}) WHERE price IS NOT NULL AND flag IS NOT NULL")
def _(t):
    return C.drop_missing(t.derive("lineitem", LINES))


@query("drop_missing_subset", f"SELECT * FROM ({LINES_SQL}) WHERE price IS NOT NULL")
def _(t):
    return C.drop_missing(t.derive("lineitem", LINES), ["price"])


@query("missingness_indicator", f"""
    SELECT *, CAST(price IS NULL AS INTEGER) AS price_was_missing, CAST(flag IS NULL AS INTEGER) AS flag_was_missing
    FROM ({LINES_SQL})""")
def _(t):
    return C.add_missingness_indicator(t.derive("lineitem", LINES), ["price", "flag"])


@query("missingness_indicator_only", f"""
    SELECT l_orderkey, l_linenumber, l_quantity, flag, CAST(price IS NULL AS INTEGER) AS price_was_missing
    FROM ({LINES_SQL})""")
def _(t):
    return C.add_missingness_indicator(t.derive("lineitem", LINES), ["price"], drop_original=True)


@query("missing_counts", f"""
    SELECT 'price' AS "column", count(*) - count(price) AS n_missing FROM ({LINES_SQL})
    UNION ALL SELECT 'flag', count(*) - count(flag) FROM ({LINES_SQL})""")
def _(t):
    return C.missing_counts(t.derive("lineitem", LINES), ["price", "flag"])


# Conversions of text.

MONEY = ["l_orderkey", "l_linenumber", """
    CASE l_linenumber % 7
      WHEN 0 THEN concat('$', CAST(CAST(l_quantity AS INT) AS STRING), ',', '250.75')
      WHEN 1 THEN concat(' ', CAST(CAST(l_quantity AS INT) AS STRING), '.5 ')
      WHEN 2 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '%')
      WHEN 3 THEN concat('€', CAST(CAST(l_quantity AS INT) AS STRING))
      WHEN 4 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' pieces')
      WHEN 5 THEN ''
      ELSE NULL END AS amount"""]
# The SQL computes what each shape means, without parsing.
MONEY_MEANT = """
    CASE l_linenumber % 7
      WHEN 0 THEN CAST(l_quantity AS INT) * 1000 + 250.75::DOUBLE
      WHEN 1 THEN CAST(l_quantity AS INT) + 0.5::DOUBLE
      WHEN 2 THEN CAST(l_quantity AS INT) / 100::DOUBLE
      WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE)
      ELSE NULL END"""


@query("convert_text_to_numeric", f"""
    SELECT l_orderkey, l_linenumber, round({MONEY_MEANT}, 4) AS amount FROM lineitem""")
def _(t):
    out = C.convert_type(t.derive("lineitem", MONEY), ["amount"], "numeric")
    return out.withColumn("amount", F.round("amount", 4))


DATED = ["o_orderkey", """
    CASE WHEN o_custkey % 13 = 0 THEN 'not known'
      WHEN o_orderkey % 4 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd')
      WHEN o_orderkey % 4 = 1 THEN date_format(o_orderdate, 'MM/dd/yyyy')
      WHEN o_orderkey % 4 = 2 THEN date_format(o_orderdate, 'MMM d, yyyy')
      ELSE date_format(o_orderdate, 'yyyyMMdd') END AS day"""]


@query("convert_text_to_date", """
    SELECT o_orderkey, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS day
    FROM orders""")
def _(t):
    return C.convert_type(t.derive("orders", DATED), ["day"], "date")


@query("convert_text_to_date_by_formats", """
    SELECT o_orderkey, CASE WHEN o_custkey % 13 = 0 OR o_orderkey % 4 IN (2, 3) THEN NULL
      ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS day
    FROM orders""")
def _(t):
    return C.convert_type(t.derive("orders", DATED), ["day"], "date", formats=["yyyy-MM-dd", "MM/dd/yyyy"])


@query("convert_mail_dates_to_date", """
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 3 THEN date_trunc('month', o_orderdate) WHEN 5 THEN NULL
      WHEN 1 THEN date_trunc('day', o_orderdate) + INTERVAL 37230 SECOND ELSE date_trunc('day', o_orderdate) END AS day
    FROM orders""")
def _(t):
    texts = t.derive("orders", ["o_orderkey", """
        CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'EEE, dd MMM yyyy') WHEN 1 THEN date_format(o_orderdate, "EEE, dd MMM yyyy '10:20:30 +0200'")
          WHEN 2 THEN date_format(o_orderdate, 'EEEE, MMMM d, yyyy') WHEN 3 THEN date_format(o_orderdate, 'MMMM yyyy')
          WHEN 4 THEN date_format(o_orderdate, "MMM'xyz' d, yyyy") END AS day"""])
    return C.convert_type(texts, ["day"], "date")


@query("convert_to_string", """
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part""")
def _(t):
    sizes = t.derive("part", ["p_partkey", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS p_size"])
    return C.convert_type(sizes, ["p_size"], "string")


ANSWERS = ["c_custkey", "CASE c_nationkey % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN 'FALSE' "
           "WHEN 4 THEN 'maybe' ELSE NULL END AS answer"]


@query("convert_to_boolean", """
    SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false
      ELSE NULL END AS answer FROM customer""")
def _(t):
    return C.convert_type(t.derive("customer", ANSWERS), ["answer"], "boolean")


UNITS_SQL = "['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen'," \
    "'fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"
TENS_SQL = "['ten','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"


def words_below_hundred(n: str) -> str:
    return (f"CASE WHEN {n} < 20 THEN {UNITS_SQL}[{n}] WHEN {n} % 10 = 0 THEN {TENS_SQL}[{n} // 10] "
            f"ELSE {TENS_SQL}[{n} // 10] || '-' || {UNITS_SQL}[{n} % 10] END")


def words_below_thousand(n: str) -> str:
    return (f"CASE WHEN {n} < 100 THEN {words_below_hundred(n)} WHEN {n} % 100 = 0 THEN {UNITS_SQL}[{n} // 100] || ' hundred' "
            f"ELSE {UNITS_SQL}[{n} // 100] || ' hundred and ' || {words_below_hundred(f'({n} % 100)')} END")


def words_below_million(n: str) -> str:
    low = f"({n} % 1000)"
    return (f"CASE WHEN {n} = 0 THEN 'zero' WHEN {n} < 1000 THEN {words_below_thousand(n)} ELSE "
            f"{words_below_thousand(f'({n} // 1000)')} || ' thousand' || "
            f"CASE WHEN {low} = 0 THEN '' WHEN {low} < 100 THEN ' and ' ELSE ', ' END || "
            f"CASE WHEN {low} = 0 THEN '' ELSE {words_below_thousand(low)} END END")


@query("numbers_to_words", f"""
    SELECT o_orderkey, {words_below_million('o_custkey')} AS o_custkey,
      {words_below_million("CAST(floor(o_totalprice) AS BIGINT)")} AS whole_price
    FROM orders""")
def _(t):
    numbers = t.derive("orders", ["o_orderkey", "o_custkey", "CAST(floor(o_totalprice) AS STRING) AS whole_price"])
    return C.convert_type(numbers, ["o_custkey", "whole_price"], "numeric_to_text")


@query("words_to_numbers", """
    SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS price,
      CASE WHEN o_custkey % 9 = 0 THEN 'no price' END AS price_unparsed FROM orders""")
def _(t):
    numbers = t.derive("orders", ["o_orderkey", "o_custkey", "CAST(floor(o_totalprice) AS BIGINT) AS n"])
    words = C.convert_type(numbers.withColumn("price", F.col("n")), ["price"], "numeric_to_text")
    mixed = words.selectExpr("o_orderkey", "CASE WHEN o_custkey % 9 = 0 THEN 'no price' WHEN o_custkey % 9 = 1 "
                             "THEN CAST(n AS STRING) ELSE upper(price) END AS price")
    return C.convert_type(mixed, ["price"], "text_to_numeric", keep_unparsed=True)


@query("round_numeric", """
    SELECT p_partkey, round_even(p_retailprice, 1) AS p_retailprice, round_even(p_size / 8.0::DOUBLE, 2) AS eighth FROM part""")
def _(t):
    sizes = t.derive("part", ["p_partkey", "p_retailprice", "p_size / 8.0D AS eighth"])
    return C.round_numeric(C.round_numeric(sizes, ["p_retailprice"], 1), ["eighth"], 2)


@query("text_case_lower", "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer")
def _(t):
    return C.text_case(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "lower")


@query("text_case_upper", "SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS text FROM documents")
def _(t):
    return C.text_case(t.documents.select("doc_id", "text"), ["text"], "upper")


# Runs of letters keep their first letter in capitals; DuckDB takes the text
# apart into runs with the same two classes.
TITLE_SQL = """array_to_string(list_transform(
    regexp_extract_all({c}, '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"""


@query("text_case_title", f"""
    SELECT p_partkey, {TITLE_SQL.format(c="concat(p_name, ' o''neil-', p_type, p_size, 'x')")} AS label FROM part""")
def _(t):
    names = t.derive("part", ["p_partkey", "concat(p_name, \" o'neil-\", p_type, p_size, 'x') AS label"])
    return C.text_case(names, ["label"], "title")


@query("trim_whitespace", "SELECT c_custkey, c_name FROM customer")
def _(t):
    padded = t.derive("customer", ["c_custkey", "concat('  ', c_name, CASE WHEN c_custkey % 2 = 0 THEN ' \\t' ELSE '\\n' END) AS c_name"])
    return C.trim_whitespace(padded, ["c_name"])


MESSY = ["l_orderkey", "l_linenumber", """
    CASE l_linenumber % 7
      WHEN 0 THEN concat('Rs. ', CAST(CAST(l_quantity AS INT) AS STRING), ',250.75')
      WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.5 usd')
      WHEN 2 THEN concat('Price: -', CAST(CAST(l_quantity AS INT) AS STRING), ' / item')
      WHEN 3 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' usd!!!')
      WHEN 4 THEN 'FREE'
      WHEN 5 THEN concat('₹', CAST(CAST(l_quantity AS INT) AS STRING), ' (10% off)')
      ELSE NULL END AS amount"""]
MESSY_MEANT = """
    CASE l_linenumber % 7
      WHEN 0 THEN CAST(l_quantity AS INT) * 1000 + 250.75::DOUBLE
      WHEN 1 THEN CAST(l_quantity AS INT) + 0.5::DOUBLE
      WHEN 2 THEN -CAST(CAST(l_quantity AS INT) AS DOUBLE)
      WHEN 5 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE)
      ELSE NULL END"""


@query("extract_numeric", f"SELECT l_orderkey, l_linenumber, {MESSY_MEANT} AS amount FROM lineitem")
def _(t):
    return C.extract_numeric(t.derive("lineitem", MESSY), ["amount"])


@query("extract_numeric_or_drop", f"""
    SELECT * FROM (SELECT l_orderkey, l_linenumber, {MESSY_MEANT} AS amount FROM lineitem) WHERE amount IS NOT NULL""")
def _(t):
    return C.extract_numeric(t.derive("lineitem", MESSY), ["amount"], "drop")


@query("replace_placeholders", """
    SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS c_mktsegment
    FROM customer""")
def _(t):
    return C.replace_with_null(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["BUILDING", "MACHINERY"])


# Formats: contact texts are built from keys, some of them broken.

CONTACTS = ["c_custkey", """
    CASE c_custkey % 5 WHEN 0 THEN concat('user', CAST(c_custkey AS STRING), '@example.com')
      WHEN 1 THEN concat('user ', CAST(c_custkey AS STRING), '@example') WHEN 2 THEN NULL
      ELSE concat('a.b+', CAST(c_nationkey AS STRING), '@mail.example.org') END AS email""", """
    CASE c_custkey % 4 WHEN 0 THEN concat('+1 (555) 123-', CAST(1000 + c_nationkey AS STRING))
      WHEN 1 THEN 'call me' WHEN 2 THEN '12345' ELSE '0441 234567' END AS phone""", """
    concat('10.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 1200 AS STRING), '.1') AS ip_address""", """
    CASE c_custkey % 5 WHEN 0 THEN '4111111111111111' WHEN 1 THEN '5500000000000004' WHEN 2 THEN '340000000000009'
      WHEN 3 THEN '1234567890123456' ELSE concat('6011', CAST(100000000000 + c_custkey AS STRING)) END AS credit_card""", """
    CASE c_custkey % 3 WHEN 0 THEN '2345 6789 0123' WHEN 1 THEN '1345 6789 0123' ELSE ' 998877665544 ' END AS aadhaar""", """
    CASE c_custkey % 4 WHEN 0 THEN ' -12.50 ' WHEN 1 THEN '12.' WHEN 2 THEN '1e5'
      ELSE CAST(c_custkey AS STRING) END AS `numeric`""", """
    CASE c_custkey % 6 WHEN 0 THEN '2021-1-31' WHEN 1 THEN '31/12/2021 10:20:30' WHEN 2 THEN '2021.01.31'
      WHEN 3 THEN '2021-01-31T10:20:30.5Z' WHEN 4 THEN 'soon' ELSE '1-2-2020 10:20+02:00' END AS `date`"""]
CONTACTS_SQL = select([e.replace("`", '"') for e in CONTACTS], "customer")


def _register_format(kind: str):
    pattern = FORMAT_PATTERNS[kind].replace("'", "''")
    ok = f"coalesce(regexp_matches(\"{kind}\", '{pattern}'), false)"

    @query(f"validate_{kind}_drop", f"SELECT c_custkey, \"{kind}\" FROM ({CONTACTS_SQL}) WHERE {ok}")
    def _(t):
        return C.validate_format(t.derive("customer", CONTACTS).select("c_custkey", kind), [kind], kind)

    @query(f"validate_{kind}_set_null", f"""
        SELECT c_custkey, CASE WHEN {ok} THEN \"{kind}\" END AS \"{kind}\" FROM ({CONTACTS_SQL})""")
    def _(t):
        return C.validate_format(t.derive("customer", CONTACTS).select("c_custkey", kind), [kind], kind, "set_null")


for _kind in ("email", "phone", "ip_address", "credit_card", "aadhaar", "numeric", "date"):
    _register_format(_kind)

URL = FORMAT_PATTERNS["url"]


@query("validate_url_drop", f"SELECT page_id, url FROM pages WHERE regexp_matches(url, '{URL}')")
def _(t):
    return C.validate_format(t.pages.select("page_id", "url"), ["url"], "url")


@query("validate_url_set_null", f"SELECT page_id, CASE WHEN regexp_matches(url, '{URL}') THEN url END AS url FROM pages")
def _(t):
    return C.validate_format(t.pages.select("page_id", "url"), ["url"], "url", "set_null")


@query("validate_custom", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^(?:Brand#1\\d)')")
def _(t):
    return C.validate_format(t.part.select("p_partkey", "p_brand"), ["p_brand"], "custom", pattern=r"Brand#1\d")


# Date parts.

PARTS = {
    "year": "year({c})", "month": "month({c})", "day": "day({c})", "hour": "hour({c})", "minute": "minute({c})",
    "dayofweek": "isodow({c}) - 1", "dayofyear": "dayofyear({c})", "weekofyear": "weekofyear({c})",
    "quarter": "quarter({c})", "is_weekend": "isodow({c}) >= 6", "is_month_start": "day({c}) = 1",
    "is_month_end": "last_day({c}) = CAST({c} AS DATE)",
}
_parts = lambda c: ", ".join(f"CAST({e.format(c=c)} AS INTEGER) AS {c}_{n}" for n, e in PARTS.items())


@query("datetime_components_of_events", f"SELECT event_id, ts, {_parts('ts')} FROM events")
def _(t):
    return C.extract_datetime_components(t.events.select("event_id", "ts"), "ts", list(PARTS))


@query("datetime_components_of_orders", f"SELECT o_orderkey, o_orderdate, {_parts('o_orderdate')} FROM orders")
def _(t):
    return C.extract_datetime_components(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", list(PARTS))


@query("extract_datetime", """
    SELECT l_orderkey, l_linenumber, l_shipdate, CAST(year(l_shipdate) AS INTEGER) AS l_shipdate_year,
      CAST(month(l_shipdate) AS INTEGER) AS l_shipdate_month, CAST(day(l_shipdate) AS INTEGER) AS l_shipdate_day
    FROM lineitem""")
def _(t):
    return C.extract_datetime(t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_shipdate"])


@query("convert_dates_in_many_shapes", """
    SELECT o_orderkey, CAST(CASE o_orderkey % 9 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 7 THEN date_trunc('minute', o_orderdate)
      ELSE date_trunc('day', o_orderdate) END AS TIMESTAMP) AS day FROM orders""")
def _(t):
    texts = t.derive("orders", ["o_orderkey", """CASE o_orderkey % 9
        WHEN 0 THEN date_format(o_orderdate, 'MM/dd/yyyy HH:mm:ss') WHEN 1 THEN date_format(o_orderdate, 'd MMMM yyyy')
        WHEN 2 THEN date_format(o_orderdate, 'MMMM d, yyyy') WHEN 3 THEN date_format(o_orderdate, 'yyyy.MM.dd')
        WHEN 4 THEN date_format(o_orderdate, 'M/d/yy') WHEN 5 THEN date_format(o_orderdate, 'd-MMM-yyyy')
        WHEN 6 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 7 THEN date_format(o_orderdate, 'MMM d yyyy h:mm a')
        ELSE date_format(o_orderdate, CASE WHEN day(o_orderdate) > 12 THEN 'dd/MM/yyyy' ELSE 'yyyy/M/d' END) END AS day"""])
    return C.convert_type(texts, ["day"], "date")


@query("percent_inside_text", """
    SELECT o_orderkey, CASE o_custkey % 3 WHEN 1 THEN o_custkey / 100 WHEN 2 THEN CAST(o_custkey AS DOUBLE) END AS o_custkey FROM orders""")
def _(t):
    texts = t.derive("orders", ["o_orderkey", "CASE o_custkey % 3 WHEN 0 THEN concat(o_custkey, '%', o_custkey) "
                                "WHEN 1 THEN concat(o_custkey, '%') ELSE concat('$', o_custkey) END AS o_custkey"])
    return C.convert_type(texts, ["o_custkey"], "numeric")


@query("numbers_to_words_of_any_size", f"""
    SELECT o_orderkey, {UNITS_SQL}[o_custkey % 9 + 1] || ['', ' quintillion', ' sextillion', ' septillion', ' octillion'][o_orderkey % 4 + 2] AS large,
      'minus zero point ' || repeat('zero ', 18 + CAST(o_orderkey % 4 AS INTEGER)) || {UNITS_SQL}[o_custkey % 9 + 1] AS small FROM orders""")
def _(t):
    numbers = t.derive("orders", ["o_orderkey", "CAST(concat(o_custkey % 9 + 1, 'e', 18 + 3 * (o_orderkey % 4)) AS DOUBLE) AS large",
                                  "CAST(concat('-', o_custkey % 9 + 1, 'e-', 19 + o_orderkey % 4) AS DOUBLE) AS small"])
    return C.convert_type(numbers, ["large", "small"], "numeric_to_text")


@query("drop_missing_flattened", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events
    WHERE event_id % 3 <> 0 AND json_extract(props, '$.k') IS NOT NULL""")
def _(t):
    events = t.derive("events", ["event_id", "CASE WHEN event_id % 3 <> 0 THEN props ELSE '{}' END AS props"])
    flat = flatten_json_column(events, "props")
    return C.drop_missing(flat, ["props.k"]).withColumn("props.k", F.col("`props.k`").cast("bigint"))
