"""Order-dependent work without putting a whole table or group into one task.

A window over ``partition_by`` sorts each group in one task. That is right while
the groups are small, and that is checked. When a group (or a whole table, with
no ``partition_by``) is larger than ``rows_per_bucket``, rows get a bucket number
from their position in the sort order: a binary search of the row's key in a
sorted sample of keys. The bucket is a pure function of the row, so a lost
executor cannot move rows between buckets. Windows then run per (bucket, group),
and the few groups that span buckets are joined up through small summaries:
offsets for running sums, carried values for fills, and copied edge rows for
lags and rolling frames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec, functions as F, types as T

from ..frame import col, data_type, require_columns, settle
from ..functions.numbers import let

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 32_768
SAMPLED_PER_BUCKET = 16
BUCKET = "_bucket"
TIE = "_tie"


def sort_key(names: list[str]) -> Column:
    """One comparable value for several columns, nulls last."""
    fields = [f for i, n in enumerate(names)
              for f in (col(n).isNull().alias(f"n{i}"), col(n).alias(f"k{i}"))]
    return F.struct(*fields)


def position(bounds: Column, count: int, key: Column) -> Column:
    """Number of sorted ``bounds`` that are not above ``key`` (binary search)."""
    strides = [2**i for i in reversed(range(count.bit_length()))]
    if not strides:
        return F.lit(0)
    advance = lambda k: lambda at, stride: F.when(F.get(bounds, at + stride - 1) <= k, at + stride).otherwise(at)
    return let(key, lambda k: F.aggregate(F.array(*[F.lit(i) for i in strides]), F.lit(0), advance(k)))


def bucket_of(df: DataFrame, names: list[str], rows: int, rows_per_bucket: int) -> Column:
    """Bucket number of each row by the order of ``names``.

    The bounds are a sorted sample of keys, at most ``MAX_BUCKETS`` of them. Any
    bounds give right results; the sample only evens out bucket sizes.
    """
    buckets = min(-(-rows // rows_per_bucket), MAX_BUCKETS)
    if buckets <= 1:
        return F.lit(0)
    fraction = min(1.0, buckets * SAMPLED_PER_BUCKET / rows)
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    keys = df.select(sort_key(names).alias("key"))
    sample = keys.sample(fraction, 17).orderBy("key").select(F.to_json("key", options)).collect()
    if not sample:
        return F.lit(0)
    picks = sorted({len(sample) * i // buckets for i in range(1, buckets)})
    text = "[" + ",".join(sample[i][0] for i in picks) + "]"
    bounds = F.from_json(F.lit(text), T.ArrayType(keys.schema["key"].dataType), options)
    return position(bounds, len(picks), sort_key(names))


@dataclass
class Arranged:
    """Rows with a bucket column, and the groups that span several buckets."""

    df: DataFrame
    groups: list[str]
    order: list[str]
    split: bool
    spans: list[tuple[tuple, list[Row]]] = field(default_factory=list)

    def window(self, backward: bool = False) -> WindowSpec:
        order = [col(k).desc_nulls_first() if backward else col(k).asc_nulls_last() for k in self.order]
        return Window.partitionBy(BUCKET, *[col(g) for g in self.groups]).orderBy(*order)

    def restore(self, df: DataFrame) -> DataFrame:
        return df.drop(BUCKET, TIE)

    def side_table(self, rows: list[tuple], extra: T.StructType) -> DataFrame:
        """Small table keyed by bucket and group; its size is bounded by the buckets."""
        keys = [T.StructField(f"_g{i}", data_type(self.df, g)) for i, g in enumerate(self.groups)]
        schema = T.StructType([T.StructField("_b", T.IntegerType()), *keys, *extra.fields])
        return self.df.sparkSession.createDataFrame(rows, schema)

    def side_keys(self) -> list[str]:
        return ["_b", *[f"_g{i}" for i in range(len(self.groups))]]

    def attach(self, df: DataFrame, side: DataFrame, how: str = "left") -> DataFrame:
        same = F.col(BUCKET) == F.col("_b")
        for i, g in enumerate(self.groups):
            same = same & col(g).eqNullSafe(F.col(f"_g{i}"))
        return df.join(F.broadcast(side), same, how).drop(*self.side_keys())


def arrange(df: DataFrame, partition_by: list[str] | None, order_by: list[str],
            rows_per_bucket: int | None = None, summaries=None) -> Arranged:
    """Give rows buckets, if a group is too large for one task.

    ``summaries`` takes the order columns and names the aggregates wanted per
    (bucket, group) of spanning groups.
    """
    groups, order = list(partition_by or []), list(order_by or [])
    if not order:
        raise ValueError("order_by is needed: a distributed table has no row order of its own")
    require_columns(df, groups + order)
    limit = rows_per_bucket or ROWS_PER_BUCKET
    sizes = df.groupBy(*[col(g) for g in groups]).count()
    total, largest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if largest <= limit:
        return Arranged(df.withColumn(BUCKET, F.lit(0)), groups, order, split=False)

    bucketed = df.withColumn(BUCKET, bucket_of(df, groups + order, total, limit))
    wanted = {"count": F.count("*"), **(summaries(order) if summaries else {})}
    per_bucket = bucketed.groupBy(BUCKET, *[col(g) for g in groups]).agg(
        *[e.alias(n) for n, e in wanted.items()]
    )
    pieces = per_bucket.groupBy(*[col(g) for g in groups]).agg(
        F.sort_array(F.collect_list(F.struct(BUCKET, *wanted))).alias("pieces"), F.max("count").alias("fullest"))
    too_full = 8 * max(limit, -(-total // MAX_BUCKETS))
    found = pieces.filter((F.size("pieces") > 1) | (F.col("fullest") > too_full)).collect()
    if any(r["fullest"] > too_full for r in found) and TIE not in df.columns:
        # Many rows share one full sort key, so no bound can part them. An id,
        # made stable by writing the rows out, breaks the ties.
        tied = settle(df.withColumn(TIE, F.monotonically_increasing_id()))
        return arrange(tied, groups, order + [TIE], rows_per_bucket, summaries)
    spans = [(tuple(r[g] for g in groups), r["pieces"]) for r in found if len(r["pieces"]) > 1]
    return Arranged(bucketed, groups, order, split=True, spans=spans)


def running_total(df: DataFrame, amount: Column, name: str, partition_by: list[str] | None,
                  order_by: list[str], rows_per_bucket: int | None = None) -> DataFrame:
    """Add the running sum of ``amount`` (bigint) up to and including the row."""
    plan = arrange(df, partition_by, order_by, rows_per_bucket, lambda _: {"amount": F.sum(amount)})
    out = plan.df.withColumn(name, F.sum(amount).over(plan.window().rowsBetween(Window.unboundedPreceding, 0)))
    if plan.split:
        rows = []
        for group, pieces in plan.spans:
            before = 0
            for piece in pieces:
                rows.append((piece[BUCKET], *group, before))
                before += piece["amount"] or 0
        side = plan.side_table(rows, T.StructType([T.StructField("_before", T.LongType())]))
        out = plan.attach(out, side)
        out = out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")
    return plan.restore(out)


def row_number(df: DataFrame, name: str, partition_by: list[str] | None, order_by: list[str],
               rows_per_bucket: int | None = None) -> DataFrame:
    """Add 1, 2, 3, … in the given order."""
    return running_total(df, F.lit(1).cast("bigint"), name, partition_by, order_by, rows_per_bucket)


def fill_along(df: DataFrame, columns: list[str], backward: bool, partition_by: list[str] | None,
               order_by: list[str], rows_per_bucket: int | None = None) -> DataFrame:
    """Replace nulls by the nearest earlier (or later) value in the order."""
    pick = F.min_by if backward else F.max_by
    edge = lambda c, order: pick(col(c), F.when(col(c).isNotNull(), sort_key(order)))
    plan = arrange(df, partition_by, order_by, rows_per_bucket,
                   lambda order: {f"v{i}": edge(c, order) for i, c in enumerate(columns)})
    # Backwards means along the reversed order: a frame that runs to the end of
    # its partition would be computed anew for every row.
    window = plan.window(backward).rowsBetween(Window.unboundedPreceding, 0)
    out = plan.df.withColumns({c: F.last(col(c), ignorenulls=True).over(window) for c in columns})
    if not plan.split:
        return plan.restore(out)

    rows = []
    for group, pieces in plan.spans:
        carried = [None] * len(columns)
        for piece in reversed(pieces) if backward else pieces:
            rows.append((piece[BUCKET], *group, *carried))
            carried = [old if piece[f"v{i}"] is None else piece[f"v{i}"] for i, old in enumerate(carried)]
    fields = [T.StructField(f"_v{i}", data_type(df, c)) for i, c in enumerate(columns)]
    out = plan.attach(out, plan.side_table(rows, T.StructType(fields)))
    out = out.withColumns({c: F.coalesce(col(c), F.col(f"_v{i}")) for i, c in enumerate(columns)})
    return plan.restore(out.drop(*[f.name for f in fields]))


def over_preceding(df: DataFrame, reach: int, columns, partition_by: list[str] | None,
                   order_by: list[str], rows_per_bucket: int | None = None) -> DataFrame:
    """Add window columns that look back at most ``reach`` rows.

    ``columns`` maps a window specification to named expressions. For a group
    that spans buckets, the last ``reach`` rows before each of its buckets are
    copied into that bucket, used by the windows, and dropped again.
    """
    plan = arrange(df, partition_by, order_by, rows_per_bucket)
    if not plan.split or not plan.spans:
        return plan.restore(plan.df.withColumns(columns(plan.window())))

    # (from bucket, group, to bucket, rows of the group in between)
    routes = []
    for group, pieces in plan.spans:
        for i, piece in enumerate(pieces):
            between = 0
            for later in pieces[i + 1:]:
                if between >= reach:
                    break
                routes.append((piece[BUCKET], *group, later[BUCKET], between))
                between += later["count"]
    side = plan.side_table(routes, T.StructType([
        T.StructField("_to", T.IntegerType()), T.StructField("_between", T.LongType())]))
    starts = side.select(*plan.side_keys()).distinct()

    tails = plan.attach(plan.df, starts, "inner").withColumn("_back", F.row_number().over(plan.window(backward=True)))
    tails = plan.attach(tails.filter(F.col("_back") <= reach), side, "inner")
    halo = tails.filter(F.col("_back") + F.col("_between") <= reach)
    halo = halo.withColumn(BUCKET, F.col("_to")).drop("_to", "_between", "_back").withColumn("_copy", F.lit(True))
    both = plan.df.withColumn("_copy", F.lit(False)).unionByName(halo)
    out = both.withColumns(columns(plan.window())).filter(~F.col("_copy")).drop("_copy")
    return plan.restore(out)
