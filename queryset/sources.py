"""Readers, writers, flattening and date standards."""

import uuid

from pyspark.sql import functions as F

from millrace.frame import shared_folder
from millrace.sources import dates, flatten, readers, writers

from . import query


def _written(df, write) -> str:
    path = f"{shared_folder(df)}/{uuid.uuid4()}"
    write(df, path)
    return path


@query("csv_round_trip", """
    SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice,
      strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, concat(o_orderpriority, ' "', o_orderstatus, '", x') AS note FROM orders""")
def _(t):
    orders = t.derive("orders", ["o_orderkey", "CASE WHEN o_custkey % 10 = 0 THEN 'NA' ELSE CAST(o_custkey AS STRING) END AS o_custkey",
                                 "o_totalprice", "o_orderdate", "concat(o_orderpriority, ' \"', o_orderstatus, '\", x') AS note"])
    return readers.read_csv(t.spark, _written(orders, writers.write_csv))


@query("json_round_trip", """
    SELECT event_id, user_id AS "who.id", event_type AS "who.did.what", value AS "list.0", CASE WHEN event_id % 2 = 0 THEN value * 2 END AS "list.1"
    FROM events""")
def _(t):
    nested = t.derive("events", [
        "event_id", "named_struct('id', user_id, 'did', named_struct('what', event_type)) AS who",
        "CASE WHEN event_id % 2 = 0 THEN array(value, value * 2) ELSE array(value) END AS list"])
    back = readers.read_json(t.spark, _written(nested, writers.write_json), lines=True)
    return back.select("event_id", "`who.id`", "`who.did.what`", "`list.0`", "`list.1`")


@query("flatten_embeddings", """
    SELECT vec_id, label, len(embedding) AS n, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings""")
def _(t):
    flat = flatten.flatten(t.embeddings)
    cells = [c for c in flat.columns if c.startswith("embedding.")]
    return flat.select("vec_id", "label", F.lit(len(cells)).cast("bigint").alias("n"),
                       F.col(f"`{cells[0]}`").alias("first"), F.col(f"`{cells[-1]}`").alias("last"))


@query("flatten_json_text", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def _(t):
    return flatten.flatten_json_column(t.events.select("event_id", "props"), "props").withColumn(
        "props.k", F.col("`props.k`").cast("bigint"))


@query("read_parquet", "SELECT * FROM part")
def _(t):
    return readers.read_parquet(t.spark, f"{t.folder}/part.parquet")


@query("standardise_dates", """
    SELECT o_orderkey, o_orderpriority, CASE WHEN o_custkey % 13 = 0 THEN 'not known'
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS bought FROM orders""")
def _(t):
    texts = t.derive("orders", ["o_orderkey", "o_orderpriority", """
        CASE WHEN o_custkey % 13 = 0 THEN 'not known'
          WHEN o_orderkey % 7 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')
          WHEN o_orderkey % 7 = 1 THEN date_format(o_orderdate, 'MM/dd/yyyy')
          WHEN o_orderkey % 7 = 2 THEN concat('Purchased on ', date_format(o_orderdate, 'MMM d, yyyy'))
          WHEN o_orderkey % 7 = 3 THEN date_format(o_orderdate, 'yyyyMMdd')
          WHEN o_orderkey % 7 = 4 THEN concat('Order #12 - ', date_format(o_orderdate, 'd-MMM-yyyy'))
          WHEN o_orderkey % 7 = 5 THEN date_format(o_orderdate, 'yyyy.M.d')
          ELSE concat('Date: ', date_format(o_orderdate, 'd MMMM yyyy')) END AS bought"""])
    return dates.standardise_dates(texts)
