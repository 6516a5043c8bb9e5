"""Quality alerts: (entity, type, missing_pct, recommended_action)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..fixed_values import ALERT_ACTIONS, ALERT_DATE_KEYWORDS, ALERT_SEVERITY, NUMERIC_NAME_KEYWORDS
from .facts import ColumnFacts, column_facts, read_once

SCHEMA = "entity string, type string, missing_pct double, recommended_action string"
DATASET = "(dataset)"
LEVELS = ["high", "medium", "low"]


def _named(f: ColumnFacts, keywords: list[str]) -> bool:
    return any(k in f.name.lower() for k in keywords)


def _missing(f):
    if f.nulls:
        share = f.nulls / f.rows * 100
        yield "missing_values", share, ALERT_ACTIONS["missing_mostly" if share >= 50 else "missing_some"]


def _placeholders(f):
    n = f.got.get("sentinels") or 0
    if n:
        yield "placeholder_values", n / f.rows * 100, ALERT_ACTIONS["placeholder_values"] % n


def _mixed(f):
    numbers, words = f.got.get("numbers") or 0, f.got.get("worded") or 0
    if f.kind == "text" and min(numbers, words) > 0 and numbers != words:
        yield f"mixed_type_{'numeric' if numbers > words else 'worded'}", 0.0, ALERT_ACTIONS["mixed_type"]


def _invalid_numbers(f):
    if f.kind == "text" and f.present:
        wrong = f.present - f.got["numeric_shape"]
        if wrong and (_named(f, NUMERIC_NAME_KEYWORDS) or f.share("numeric_shape") > 0.5):
            yield "invalid_numeric_format", wrong / f.rows * 100, ALERT_ACTIONS["invalid_numeric_format"]


def _invalid_dates(f):
    if f.kind == "text" and f.present:
        wrong = f.present - f.got["date_shape"]
        if 0 < wrong < f.present and (_named(f, ALERT_DATE_KEYWORDS) or f.share("date_shape") > 0.5):
            yield "invalid_date_format", wrong / f.rows * 100, ALERT_ACTIONS["invalid_date_format"]


def _outliers(f):
    n = f.got.get("outliers") or 0
    if f.kind == "numeric" and f.present >= 10 and f.got["q1"] != f.got["q3"] and n:
        yield "outliers", n / f.rows * 100, ALERT_ACTIONS["outliers"] % n


def _imbalance(f):
    if 2 <= f.distinct <= 10 and f.present >= 50:
        majority = f.top[0][1] / f.present * 100
        label, least = f.least
        if majority >= 80:
            yield "class_imbalance", 0.0, ALERT_ACTIONS["class_imbalance"] % (majority, label, least / f.present * 100)


def adjusted_skew(f: ColumnFacts) -> float | None:
    """Sample skewness with the bias correction for n values."""
    n, skew = f.present, f.got.get("skew")
    if skew is None or math.isnan(skew) or n < 3:
        return None
    return skew * math.sqrt(n * (n - 1)) / (n - 2)


def _skew(f):
    skew = adjusted_skew(f) if f.kind == "numeric" and f.present >= 20 else None
    if skew is not None and abs(skew) > 2.0:
        direction = "right (positive)" if skew > 0 else "left (negative)"
        yield "skewed_distribution", 0.0, ALERT_ACTIONS["skewed_distribution"] % (skew, direction)


def _constant(f):
    if f.distinct == 1:
        yield "constant_column", 0.0, ALERT_ACTIONS["constant_column"]


def _many_values(f):
    if f.kind == "text" and f.present > 100 and f.distinct > 0.9 * f.present:
        yield "high_cardinality", 0.0, ALERT_ACTIONS["high_cardinality"]


BEFORE_DUPLICATES = [_missing, _placeholders, _mixed, _invalid_numbers, _invalid_dates]
AFTER_DUPLICATES = [_outliers, _imbalance, _skew, _constant, _many_values]


def quality_alerts(df: DataFrame) -> DataFrame:
    """Alerts of all rules, rule by rule; an empty table has none."""
    df = read_once(df)
    facts = column_facts(df, moments=True, texts=True, values=1, repeats=True, spread=True, few=True)
    rows = facts[0].rows if facts else 0
    alerts = []
    if rows:
        apply = lambda rules: [(f.name, *alert) for rule in rules for f in facts for alert in rule(f)]
        alerts += apply(BEFORE_DUPLICATES)
        repeated = facts[0].repeats
        if repeated:
            alerts.append((DATASET, "duplicate_rows", repeated / rows * 100, ALERT_ACTIONS["duplicate_rows"] % repeated))
        alerts += apply(AFTER_DUPLICATES)
    return df.sparkSession.createDataFrame(alerts, SCHEMA)


def by_severity(alerts: DataFrame) -> DataFrame:
    """Alerts with severity and ``entity_rank``: 0, 1 or 2 by the entity's worst alert."""
    level = F.lit(None).cast("int")
    for name, severity in ALERT_SEVERITY.items():
        level = F.when(F.col("type") == name, LEVELS.index(severity)).otherwise(level)
    ranked = alerts.withColumn("_level", F.coalesce(level, F.lit(2)))
    worst = F.min("_level").over(Window.partitionBy("entity"))
    return ranked.select(
        "entity", "type", "missing_pct", "recommended_action",
        F.get(F.array(*[F.lit(n) for n in LEVELS]), F.col("_level")).alias("severity"),
        worst.alias("entity_rank"),
    ).orderBy("entity_rank", "entity")
