"""Class rebalancing: synthetic minority rows and random undersampling.

Random choices are hashes of the row and the seed, so a task that runs again
chooses the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..frame import (
    PreconditionError, aggregate_row, col, data_type, is_fractional, is_integral, is_numeric, number,
    numeric_columns, require_columns, settle, value,
)
from .knn import nearest, vector
from .ordered import row_number

STRATEGIES = ("smote", "undersample", "smote_then_undersample")
SEED = 42
#: Classes up to which their plan is sent to all tasks, so that rows are not dealt by class.
SENT_CLASSES = 100_000
#: Synthetic rows that one row of the plan is unfolded into at once.
ROWS_AT_ONCE = 100_000


def class_counts(df: DataFrame, target_column: str) -> DataFrame:
    """(class, n_rows) of the rows that have a class."""
    require_columns(df, [target_column])
    v = value(df, target_column)
    return df.filter(v.isNotNull()).groupBy(col(target_column).alias("class")).agg(F.count("*").alias("n_rows"))


def discrete_target(df: DataFrame, target: str) -> DataFrame:
    """Whole-number float targets become integers; up to 20 fractions are rounded."""
    if not is_fractional(df, target):
        return df
    v = value(df, target)
    got = aggregate_row(df, {"whole": F.coalesce(F.bool_and(v == F.floor(v)), F.lit(True))})
    if not got["whole"] and df.select(v.alias("v")).filter("v IS NOT NULL").distinct().limit(21).count() > 20:
        raise PreconditionError(f"target {target!r} is continuous; bin it first")
    return df.withColumn(target, F.bround(v, 0).cast("bigint"))


def pick_features(df: DataFrame, target: str, feature_columns=None, exclude_columns=None) -> list[str]:
    """Numeric columns but the target and the excluded ones."""
    left_out = {target, *(exclude_columns or [])}
    wanted = feature_columns or numeric_columns(df)
    chosen = [c for c in wanted if c in df.columns and is_numeric(df, c) and c not in left_out]
    if not chosen:
        raise PreconditionError("no numeric feature columns; encode categorical columns first")
    return chosen


def class_plan(df: DataFrame, target: str, sampling_strategy, grow: bool):
    """(_class, n, wanted) as a table, and its (classes, smallest, largest).

    Classes grow up to the majority's size, or shrink to the minority's. Equal sizes
    are told apart by the text of the class.
    """
    plan = settle(class_counts(df, target).withColumnsRenamed({"class": "_class", "n_rows": "n"}))
    order = F.struct("n", F.col("_class").cast("string"))
    got = plan.agg(F.count("*"), F.min("n"), F.max("n"), F.min_by("_class", order), F.max_by("_class", order)).first()
    classes, smallest, largest, minority, majority = got
    size, low, high = largest if grow else smallest, F.col("_class") == F.lit(minority), F.col("_class") == F.lit(majority)
    wanted = F.col("n")
    if not classes:
        pass
    elif isinstance(sampling_strategy, dict):
        for name, number_of in sampling_strategy.items():
            wanted = F.when(F.col("_class") == F.lit(name), number_of).otherwise(wanted)
    elif isinstance(sampling_strategy, (int, float)):
        if classes != 2:
            raise PreconditionError("a ratio needs exactly two classes")
        if grow:
            wanted = F.when(low, max(smallest, int(sampling_strategy * largest))).otherwise(wanted)
        else:
            wanted = F.when(high, min(largest, int(smallest / sampling_strategy))).otherwise(wanted)
    else:
        name = {"auto": "not majority" if grow else "not minority"}.get(sampling_strategy, sampling_strategy)
        chosen = {"minority": low, "majority": high, "not minority": ~low, "not majority": ~high, "all": F.lit(True)}.get(name)
        if chosen is None:
            raise ValueError(f"unknown sampling_strategy {sampling_strategy!r}")
        wanted = F.when(chosen, size).otherwise(wanted)
    return plan.withColumn("wanted", wanted.cast("bigint")), (classes, smallest, largest)


def _unit(*parts):
    """Hash as a number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**53)).cast("double") / F.lit(float(2**53))


def undersample(df: DataFrame, target_column: str, sampling_strategy="auto", seed: int = SEED,
                rows_per_bucket: int | None = None) -> DataFrame:
    """Shrink classes to the minority's size; whole rows are kept.

    A counting pass finds a hash threshold that leaves just enough candidates, so
    that only these are shuffled to pick the exact number.
    """
    df = df.filter(value(df, target_column).isNotNull())
    plan, (classes, _, _) = class_plan(df, target_column, sampling_strategy, grow=False)
    sent = F.broadcast if classes <= SENT_CLASSES else lambda p: p
    share = F.least(F.lit(1.0), 1.2 * F.col("wanted") / F.col("n") + 1000 / F.col("n"))
    hashed = df.withColumn("_u", _unit(F.lit(seed), *[col(c) for c in df.columns]))
    same = col(target_column) == F.col("_class")
    reached = hashed.join(sent(plan.withColumn("_share", share)), same).filter("_u <= _share").groupBy(F.col("_class").alias("_of")).agg(F.count("*").alias("reached"))
    plan = settle(plan.withColumn("_share", share).join(reached, F.col("_class") == F.col("_of"), "left").select(
        "_class", "wanted", F.when(F.coalesce("reached", F.lit(0)) >= F.col("wanted"), F.col("_share")).otherwise(1.0).alias("_share")))
    candidates = hashed.join(sent(plan), same).filter("_u <= _share").drop("_class", "_share")
    ranked = row_number(candidates, "_rn", [target_column], ["_u"], rows_per_bucket)
    return ranked.filter("_rn <= wanted").select(*[col(c) for c in df.columns])


def smote(df: DataFrame, target_column: str, feature_columns: list[str], k_neighbors: int = 5,
          sampling_strategy="auto", seed: int = SEED, rows_per_bucket: int | None = None,
          block_rows: int | None = None) -> DataFrame:
    """Grow classes with rows between a row and one of its k nearest of that class.

    Every row of a class serves as base equally often, give or take one. Columns
    that are neither feature nor target are null on synthetic rows. k is lowered
    to the size of the smallest class less one.
    """
    df = df.filter(value(df, target_column).isNotNull())
    plan, (classes, smallest, _) = class_plan(df, target_column, sampling_strategy, grow=True)
    plan = settle(plan.filter("wanted > n").withColumn("missing", F.col("wanted") - F.col("n")))
    whole = all(is_integral(df, c) for c in feature_columns)
    shaped = df.withColumns({c: col(c).cast("bigint" if whole else "double") for c in feature_columns})
    if plan.isEmpty():
        return shaped
    sent = F.broadcast if classes <= SENT_CLASSES else lambda p: p
    if smallest < 2:
        raise PreconditionError("every class needs at least two rows")
    k = max(1, min(k_neighbors, smallest - 1))

    base = df.select(col(target_column).alias("_class"), vector(df, feature_columns).alias("vec")).join(
        sent(plan.select("_class")), "_class", "left_semi")
    base = base.withColumn("grp", F.col("_class").cast("string"))
    order = base.withColumn("_u", F.xxhash64(F.lit(seed), "vec"))
    ranked = row_number(order, "_rn", ["_class"], ["_u", "vec"], rows_per_bucket)
    # A class that grows by less than its size needs only that many base rows.
    ranked = ranked.join(sent(plan.select(F.col("_class").alias("_c"), "missing")), F.col("_class") == F.col("_c")) \
        .filter("_rn <= missing").drop("_c", "missing")
    answers = nearest(ranked.select("grp", "vec"), base.select("grp", "vec", F.col("vec").alias("val")),
                      len(feature_columns), k, skip_self=True, block_rows=block_rows)
    copies = F.transform("hits", lambda h: F.array_repeat(h["val"], F.least(h["n"], F.lit(k).cast("bigint")).cast("int")))
    answers = answers.select(F.col("grp").alias("g"), F.col("vec").alias("v"), F.slice(F.flatten(copies), 1, k).alias("near"))
    bases = ranked.join(answers, (F.col("grp") == F.col("g")) & (F.col("vec") == F.col("v"))).select(
        F.col("grp").alias("_of"), "_class", "_rn", "vec", "near")

    # The synthetic rows of a class are numbered 0, 1, …; each belongs to the base
    # row of its remainder.
    loads = plan.withColumn("load", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(missing - 1) div {ROWS_AT_ONCE}"))))
    start = F.col("load") * ROWS_AT_ONCE
    picks = loads.repartition("_class", "load").select(
        F.col("_class").cast("string").alias("_to"), "n", F.explode(F.sequence(start, F.least(start + ROWS_AT_ONCE, "missing") - 1)).alias("nth"))
    picks = picks.select("_to", (F.col("nth") % F.col("n") + 1).alias("_at"), F.xxhash64("_to", "nth").alias("id"))
    paired = picks.join(bases, (F.col("_to") == F.col("_of")) & (F.col("_at") == F.col("_rn")))
    partner = F.get("near", F.pmod(F.xxhash64(F.lit(seed), F.lit("partner"), "id"), F.size("near").cast("bigint")).cast("int"))
    paired = paired.select("_class", "vec", partner.alias("mate"), _unit(F.lit(seed), F.lit("gap"), F.col("id")).alias("gap"))
    between = lambda j: F.col("vec")[j] + F.col("gap") * (F.col("mate")[j] - F.col("vec")[j])
    made = paired.select(
        F.col("_class").alias(target_column),
        *[between(j).cast(data_type(shaped, c)).alias(c) for j, c in enumerate(feature_columns)])
    return shaped.unionByName(made, allowMissingColumns=True)


def check_balance_input(df: DataFrame, target_column: str, features: list[str]) -> None:
    """Refuse nulls in features, fewer than four rows and fewer than two classes."""
    wanted = {c: F.count_if(number(df, c).isNull()) for c in features}
    got = aggregate_row(df, {**wanted, ("rows",): F.count("*")})
    nulls = [c for c in features if got[c]]
    if nulls:
        raise PreconditionError(f"feature columns {nulls} hold nulls; fill or drop them first")
    if got[("rows",)] < 4:
        raise PreconditionError("rebalancing needs at least four rows")


def handle_imbalance(df: DataFrame, target_column: str, feature_columns: list[str] | None = None,
                     exclude_columns: list[str] | None = None, strategy: str = "smote", k_neighbors: int = 5,
                     sampling_strategy="auto", seed: int = SEED, rows_per_bucket: int | None = None,
                     block_rows: int | None = None) -> DataFrame:
    """Rebalance the classes of a target; rows without a class are dropped."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    require_columns(df, [target_column])
    features = pick_features(df, target_column, feature_columns, exclude_columns)
    check_balance_input(df, target_column, features)
    df = discrete_target(df, target_column)
    if df.select(value(df, target_column).alias("v")).filter("v IS NOT NULL").distinct().limit(2).count() < 2:
        raise PreconditionError(f"target {target_column!r} needs at least two classes")
    if strategy in ("smote", "smote_then_undersample"):
        df = smote(df, target_column, features, k_neighbors, sampling_strategy, seed, rows_per_bucket, block_rows)
        sampling_strategy = "auto"
    if strategy in ("undersample", "smote_then_undersample"):
        df = undersample(df, target_column, sampling_strategy, seed, rows_per_bucket)
    return df


def balance_report(before: DataFrame, after: DataFrame, target_column: str) -> DataFrame:
    """(class, n_before, n_after)."""
    b = class_counts(before, target_column).select(F.col("class").cast("string"), F.col("n_rows").alias("n_before"))
    a = class_counts(after, target_column).select(F.col("class").cast("string"), F.col("n_rows").alias("n_after"))
    return b.join(a, "class", "full").na.fill(0, ["n_before", "n_after"])
