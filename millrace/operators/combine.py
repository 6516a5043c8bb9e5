"""Joining and stacking tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..frame import PreconditionError, col, data_type, is_numeric, is_text, require_columns, settle
from .ordered import row_number

HOT_KEY_ROWS = 1_000_000
#: Pairs of equal keys that a task makes at most, and rows of the smaller side that it pairs.
PAIRS_PER_TASK, BLOCK_ROWS = 4_000_000, 2_000
#: Rows of a key on a side that Spark sends to all tasks, up to which the other side is not counted.
FAN_OUT = 100
#: Keys that are joined apart at most, those with most pairs, and tasks for them.
HOT_KEYS, HOT_TASKS = 10_000, 10_000
OUTER = {"left": "left", "right": "right", "outer": "full", "inner": "inner"}


def merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None, how: str = "inner",
          null_safe: bool = True, hot_key_rows: int | None = None) -> DataFrame:
    """Equi-join on one key each; null keys match null keys unless told not to.

    Equal key names give one key column; other columns that both tables have get
    ``_x`` and ``_y``. Small sides with few rows of each key are left to Spark's own
    size check. Otherwise keys are counted first: those with more than
    ``hot_key_rows`` rows on a side or more pairs than a task should make are joined
    apart, in blocks of rows of both sides, each a task's worth.
    """
    right_on = right_on or left_on
    if how not in OUTER:
        raise ValueError(f"unknown join {how!r}")
    require_columns(left, [left_on])
    require_columns(right, [right_on])
    if (is_numeric(left, left_on) and is_text(right, right_on)) or (
            is_text(left, left_on) and is_numeric(right, right_on)):
        raise PreconditionError(f"keys {left_on!r} and {right_on!r} are numeric on one side and text on the other")

    l = left.select(*[col(c).alias(f"l{i}") for i, c in enumerate(left.columns)])
    r = right.select(*[col(c).alias(f"r{i}") for i, c in enumerate(right.columns)])
    lk, rk = f"l{left.columns.index(left_on)}", f"r{right.columns.index(right_on)}"
    same = F.col(lk).eqNullSafe(F.col(rk)) if null_safe else F.col(lk) == F.col(rk)

    hot, both = None, _common_key(l, r, lk, rk)
    if hot_key_rows or _may_pile_up(l, r, both, how):
        hot = _hot_keys(l, r, both, null_safe, hot_key_rows or HOT_KEY_ROWS)
    if hot is None:
        joined = l.join(r, same, OUTER[how])
    else:
        keys, tasks, kl, kr = hot
        cold = [side.join(F.broadcast(keys), k.eqNullSafe(F.col("hot")), "left_anti") for side, k in ((l, kl), (r, kr))]
        joined = cold[0].join(cold[1], same, OUTER[how])
        for part in _hot_parts(l, r, keys, tasks, kl, kr, how):
            joined = joined.unionByName(part, allowMissingColumns=True)

    one_key = left_on == right_on
    shared = {c for c in left.columns if c in right.columns} - ({left_on} if one_key else set())
    out = []
    for i, c in enumerate(left.columns):
        source = F.coalesce(lk, rk) if one_key and c == left_on else F.col(f"l{i}")
        out.append(source.alias(f"{c}_x" if c in shared else c))
    for i, c in enumerate(right.columns):
        if not (one_key and c == right_on):
            out.append(F.col(f"r{i}").alias(f"{c}_y" if c in shared else c))
    names = [joined.select(c).columns[0] for c in out]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise PreconditionError(f"the merged table would have several columns named {repeated}; rename them first")
    return joined.select(*out)


def estimated_bytes(df: DataFrame) -> int:
    """Size of the table by Spark's own statistics, no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _may_pile_up(l: DataFrame, r: DataFrame, both: tuple[Column, Column], how: str) -> bool:
    """Whether a key may make many pairs in a task: not in small tables, nor where Spark sends a side with few rows of each key."""
    sizes, spark = (estimated_bytes(l), estimated_bytes(r)), l.sparkSession
    if sizes[0] * sizes[1] <= 64 * PAIRS_PER_TASK:
        return False
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    sides = [(size, i) for i, size in enumerate(sizes) if i in {"inner": (0, 1), "left": (1,), "right": (0,), "outer": ()}[how] and size <= limit]
    if not sides:
        return True
    i = min(sides)[1]
    return (l, r)[i].groupBy(both[i]).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] > FAN_OUT


def _common_key(l: DataFrame, r: DataFrame, lk: str, rk: str) -> tuple[Column, Column]:
    """Both keys in the type in which they are compared."""
    types = data_type(l, lk), data_type(r, rk)
    if types[0] == types[1]:
        return F.col(lk), F.col(rk)
    texts = is_text(l, lk), is_text(r, rk)
    wide = types[texts.index(False)] if any(texts) else l.limit(0).crossJoin(r.limit(0)).select(F.coalesce(lk, rk).alias("k")).schema["k"].dataType
    return F.col(lk).cast(wide), F.col(rk).cast(wide)


def _hot_keys(l: DataFrame, r: DataFrame, both: tuple[Column, Column], null_safe: bool, limit: int):
    """Keys to be joined apart with the blocks of their rows, the tasks for these, and the keys of both sides."""
    kl, kr = both
    count = lambda side, key, name: side.groupBy(key.alias(f"k_{name}")).agg(F.count("*").alias(name))
    same = F.col("k_n_l").eqNullSafe(F.col("k_n_r")) if null_safe else F.col("k_n_l") == F.col("k_n_r")
    counted = count(l, kl, "n_l").join(count(r, kr, "n_r"), same, "full").select(
        F.coalesce("k_n_l", "k_n_r").alias("hot"), F.coalesce("n_l", F.lit(0)).alias("n_l"), F.coalesce("n_r", F.lit(0)).alias("n_r"))
    if not null_safe:  # nulls of both sides are one key here, whose rows match nothing
        counted = counted.groupBy("hot").agg(F.max("n_l").alias("n_l"), F.max("n_r").alias("n_r"))
    pairs = F.col("n_l").cast("double") * F.col("n_r")
    matched = (F.col("n_l") > 0) & (F.col("n_r") > 0) & (F.lit(null_safe) | F.col("hot").isNotNull())
    short = F.least("n_l", "n_r", F.lit(BLOCK_ROWS))
    block = lambda n, other: F.when(F.col(n) <= F.col(other), short).otherwise(F.greatest(F.lit(1), F.least(F.floor(F.lit(PAIRS_PER_TASK) / short), F.lit(HOT_KEY_ROWS))))
    parts = lambda n, other: F.when(matched, F.ceil(F.col(n) / block(n, other))).otherwise(F.lit(0)).cast("bigint")
    hot = counted.filter((F.greatest("n_l", "n_r") > limit) | (pairs > PAIRS_PER_TASK)).orderBy(F.desc(F.greatest(pairs, "n_l", "n_r"))).limit(HOT_KEYS)
    hot = settle(hot.select("hot", parts("n_l", "n_r").alias("parts_l"), parts("n_r", "n_l").alias("parts_r")).coalesce(1))
    blocks = hot.agg(F.count("*"), F.sum(F.col("parts_l") * F.col("parts_r"))).first()
    if blocks[0]:
        return hot.withColumn("hot_id", F.monotonically_increasing_id()), max(1, min(blocks[1], HOT_TASKS)), kl, kr


def _hot_parts(l: DataFrame, r: DataFrame, keys: DataFrame, tasks: int, kl: Column, kr: Column, how: str) -> list[DataFrame]:
    """Joined rows of the hot keys, and those of keys that the other side lacks.

    Rows get a number that is fixed in the checkpoint folder, so that a task that is
    run again deals them to the same blocks, and equal rows to several.
    """
    of = lambda side, k: side.join(F.broadcast(keys), k.eqNullSafe(F.col("hot")))
    block = [F.col("hot_id"), F.col("block_l"), F.col("block_r")]

    def dealt(side, k, mine, other):
        rows = settle(of(side, k).filter("parts_l > 0").drop("hot")).withColumn("at", F.monotonically_increasing_id())
        rows = rows.withColumns({f"block_{mine}": F.expr(f"pmod(xxhash64(at), parts_{mine})"),
                                 f"block_{other}": F.explode(F.expr(f"sequence(0L, parts_{other} - 1)"))})
        return rows.select(*side.columns, *block).repartition(tasks, *block)

    out = [dealt(l, kl, "l", "r").join(dealt(r, kr, "r", "l"), ["hot_id", "block_l", "block_r"]).drop("hot_id", "block_l", "block_r")]
    for side, k, kept in ((l, kl, ("left", "outer")), (r, kr, ("right", "outer"))):
        if how in kept:
            out.append(of(side, k).filter("parts_l = 0").select(*side.columns))
    return out


def concat_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Stack by column name; absent columns become null; nothing is deduplicated."""
    return df.unionByName(other, allowMissingColumns=True)


def concat_columns(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str],
                   rows_per_bucket: int | None = None) -> DataFrame:
    """Put two tables side by side by position in their orders.

    Shared names get ``_x`` and ``_y``; the shorter table is padded with nulls.
    """
    at = "_at"
    l = row_number(left, at, [], left_order, rows_per_bucket)
    r = row_number(right, at, [], right_order, rows_per_bucket)
    shared = set(left.columns) & set(right.columns)
    l = l.withColumnsRenamed({c: f"{c}_x" for c in shared})
    r = r.withColumnsRenamed({c: f"{c}_y" for c in shared})
    return l.join(r, at, "full").drop(at)


def concat(df: DataFrame, other: DataFrame, axis: int = 0, order_by: list[str] | None = None,
           other_order_by: list[str] | None = None) -> DataFrame:
    if axis == 0:
        return concat_rows(df, other)
    if not order_by:
        raise PreconditionError("concat side by side needs order_by")
    return concat_columns(df, other, order_by, other_order_by or order_by)
