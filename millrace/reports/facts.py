"""Facts about columns that all reports share.

Two passes over the table serve all columns. Both take the table as cells, a row per
row and column with the column's number, so that a plan has one set of aggregates
however wide the table is. The first pass adds up counts and moments by column. The
second counts cells by column and value, already in the map stage, and takes from
these counts the distinct, most and least frequent values and the shapes of texts;
a hash of the whole row is one more column, whose repeated values are the repeated
rows. Columns of long texts are counted by hash apart, and of them only the texts that
are shown are fetched. What comes back to the driver is a few numbers per column.

Alerts and findings look at the values of a number column only if these are few, all
different, or mostly the same one. In large tables the first pass therefore also tells
how many values there are, of every row, and only columns that may be all different or
mostly the same are counted by value; the repeated rows are counted apart.

Reports read a table several times, so one that is costly to read again, from CSV or
behind a join, is written to the checkpoint folder first and parsed once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..fixed_values import (
    BINARY_TEXTS, CURRENCY_CODES, NUMERIC_SENTINELS, SCALES_READ, TENS, TEXT_SENTINELS, UNITS,
)
from ..frame import (
    aggregate_row, chunks, col, data_type, in_parallel, is_fractional, is_integral, is_numeric, is_temporal, is_text, number,
    orderable, settle, value,
)
from ..functions.dates import parse_timestamp
from ..functions.numbers import plain_number, words_to_number
from ..functions.text import matches_format
from ..operators.quantiles import quantiles
from .numbers import FEW_VALUES, RANGES, number_facts

FEW_CANDIDATES = 1_000_000
#: Bytes, by Spark's statistics, up to which a table is not dealt anew.
SMALL_TABLE = 8 << 20
#: Bytes, by the same, from which only few values of number columns are counted, if that will do.
LARGE_TABLE = 8 << 20
#: Mean characters from which values are counted by their hash.
LONG_TEXT = 40
#: Columns that share a plan, and the number of the column that holds the hash of a row.
COLUMNS_AT_ONCE, ROW = 100, -1
QUARTILES = [0.25, 0.5, 0.75]
NUMBER_WORD = r"(^|[\s,-])(" + "|".join([*UNITS, *TENS, "hundred", *SCALES_READ]) + r")($|[\s,-])"


@dataclass
class ColumnFacts:
    name: str
    kind: str
    integral: bool = False
    fractional: bool = False
    rows: int = 0
    present: int = 0
    distinct: int = 0  # if ``many``, one more than FEW_VALUES
    many: bool = False  # more than FEW_VALUES, some of them repeated and none in most rows; not counted
    top: list[tuple[str, int]] = field(default_factory=list)
    least: tuple[str, int] | None = None
    repeats: int = 0
    got: dict[str, Any] = field(default_factory=dict)

    @property
    def std(self) -> float | None:
        """Sample standard deviation."""
        wide = self.got.get("std_pop")
        return None if wide is None or self.present < 2 else wide * (self.present / (self.present - 1)) ** 0.5

    @property
    def nulls(self) -> int:
        return self.rows - self.present

    def share(self, name: str) -> float:
        """Share of the present values that a counted property holds for."""
        return (self.got.get(name) or 0) / self.present if self.present else 0.0


def kind_of(df: DataFrame, name: str) -> str:
    if isinstance(data_type(df, name), T.BooleanType):
        return "boolean"
    if is_numeric(df, name):
        return "numeric"
    if is_temporal(df, name):
        return "temporal"
    return "text" if is_text(df, name) else "other"


def as_text(df: DataFrame, name: str):
    """The value as text, null staying null."""
    if kind_of(df, name) == "other":
        return F.when(col(name).isNotNull(), F.to_json(F.struct(col(name).alias("v"))))
    return value(df, name).cast("string")


def _as_parts(text: str) -> Column:
    """Text of a list or record in which its end sorts before any further part of it."""
    return F.translate(text, "]}", "  ")


#: Plan nodes that make a table costly to read again, and scans that are not.
COSTLY_NODES = re.compile(r"^[\s:+-]*(Join|Aggregate|Window|Sort|Generate|Distinct|Deduplicate|Expand|MapIn\w+|FlatMap\w+|\w*Python\w*|\w*UDF\w*)\b", re.M)
SCANS = re.compile(r"^[\s:+-]*Relation \[.*\] (\S+)", re.M)


def read_once(df: DataFrame) -> DataFrame:
    """The table, written to the checkpoint folder if each pass would parse or compute it anew.

    So is one that is read in so few parts that most cores would wait, evenly dealt.
    """
    optimized, cores = df._jdf.queryExecution().optimizedPlan(), df.sparkSession.sparkContext.defaultParallelism
    plan = optimized.toString()
    columnar = all(kind.lower() in ("parquet", "orc") for kind in SCANS.findall(plan))
    if not columnar or COSTLY_NODES.search(plan):
        return settle(df)
    few = int(str(optimized.stats().sizeInBytes())) > SMALL_TABLE and 2 * df.rdd.getNumPartitions() <= cores
    return settle(df.repartition(cores)) if few else df


def column_facts(df: DataFrame, columns: list[str] | None = None, moments: bool = False, texts: bool = False,
                 dates: bool = False, signals: bool = False, values: int | None = None, repeats: bool = False, spread: bool = False,
                 few: bool = False, exact: tuple[str, ...] = ()) -> list[ColumnFacts]:
    """Facts per column; the switches say which are wanted.

    ``values`` is the number of most frequent values to keep. With them ``repeats``
    counts rows that repeat another one, and ``spread``, which finds the quartiles,
    the values beyond 1.5 times their range. With ``few``, number columns of large tables
    but the ``exact`` ones are not counted by value where there are ``many``.
    """
    names = list(columns or df.columns)
    kinds = {c: kind_of(df, c) for c in names}
    large = few and moments and values is not None and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > LARGE_TABLE
    numbers = {i: c for i, c in enumerate(names) if large and kinds[c] == "numeric" and not isinstance(data_type(df, c), T.DecimalType)}
    got, found = in_parallel(df.sparkSession, [partial(_moments, df, names, kinds, moments, signals, numbers),
                                               partial(number_facts, df, numbers, QUARTILES)])
    got |= {i: _moments_of(r, is_integral(df, names[i]), signals) for i, r in found.items()}
    rows = max((g["rows"] for g in got.values()), default=0)
    facts = []
    for i, c in enumerate(names):
        mine = got.get(i) or {"rows": 0, "present": 0, "length": 0.0}
        facts.append(ColumnFacts(c, kinds[c], is_integral(df, c), is_fractional(df, c), rows, mine["present"], got=mine))
    if spread and rows:
        _add_quartiles(df, facts, {names[i]: r for i, r in found.items()})
    if values is not None and rows:
        settled = {id(facts[i]) for i, r in found.items() if names[i] not in exact and _few(facts[i], r)}
        long = [f for f in facts if f.kind in ("text", "other") and (f.got.get("length") or 0) > LONG_TEXT]
        jobs = [partial(_count_long_column, df, f, values, texts, dates, signals) for f in long]
        jobs += [partial(_count_rows, df, facts)] * (repeats and large)
        jobs += [partial(_count_outliers, df, [f for f in facts if id(f) in settled])] * spread
        apart = {id(f) for f in long} | settled
        in_parallel(df.sparkSession, [partial(_count_cells, df, facts, apart, values, texts, dates, signals, repeats and not large), *jobs])
    return facts


def _cells(df: DataFrame, cells: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*cells)))


def _moments_of(r: dict, integral: bool, signals: bool) -> dict:
    """Counts and moments out of the facts of a number column."""
    n, m2 = r["present"], r["m2"]
    got = {k: r[k] for k in ("rows", "present", "min", "max", "negatives", "sentinels", "least_whole", "most_whole")}
    got |= {"mean": r["sum"] / n if n else None, "std_pop": (m2 / n) ** 0.5 if n else None,
            "skew": n**0.5 * r["m3"] / m2**1.5 if m2 else None, "kurtosis": n * r["m4"] / m2**2 - 3 if m2 else None}
    if integral:
        got |= {"min": r["least_whole"], "max": r["most_whole"]}
    return got | ({k: r[k] for k in ("positive", *RANGES)} if signals else {})


def _few(f: ColumnFacts, r: dict) -> bool:
    """Takes over the values of a number column, if they are few or need not be counted."""
    if r["many"] and (2 * r["at_most"] > f.present or not r["again"]):
        return False
    f.many, f.distinct = r["many"], FEW_VALUES + 1 if r["many"] else len(r["values"])
    f.got["binary"] = r["binary"]
    counted = list(zip(r["values"], r["k"]))
    if counted:
        f.least, f.top = min(counted, key=lambda t: (t[1], t[0])), [min(counted, key=lambda t: (-t[1], t[0]))]
    return True


def _moments(df: DataFrame, names: list[str], kinds: dict[str, str], moments: bool, signals: bool, but: dict[int, str]) -> dict[int, dict]:
    """Counts and moments by number of the column, of all ``but`` some."""
    blank = {"x": "double", "whole": "bigint", "at": "timestamp_ntz", "size": "int"}

    def cell(i: int, c: str) -> Column:
        v, kind = as_text(df, c) if kinds[c] == "other" else value(df, c), kinds[c]
        held = {"x": v if kind == "numeric" else None, "whole": v if is_integral(df, c) else None,
                "at": v if kind == "temporal" else None, "size": F.length(v) if kind in ("text", "other") else None}
        fields = [(F.lit(None) if held[n] is None else held[n]).cast(t).alias(n) for n, t in blank.items()]
        return F.struct(F.lit(i).alias("c"), v.isNotNull().alias("there"), *fields)

    x = F.col("x")
    wanted = {"rows": F.count("*"), "present": F.count_if("there"), "length": F.coalesce(F.avg("size"), F.lit(0.0))}
    if moments:
        wanted |= {"min": F.min("x"), "max": F.max("x"), "mean": F.avg("x"), "std_pop": F.stddev_pop("x"), "skew": F.skewness("x"),
                   "kurtosis": F.kurtosis("x"), "negatives": F.count_if(x < 0), "sentinels": F.count_if(x.isin(NUMERIC_SENTINELS)),
                   "least_whole": F.min("whole"), "most_whole": F.max("whole"), "first_at": F.min("at"), "last_at": F.max("at")}
    if signals:
        wanted |= {n: F.count_if(x.between(*r)) for n, r in RANGES.items()}
        wanted["positive"] = F.count_if(x > 0)
    part = lambda some: _cells(df, [cell(i, c) for i, c in some]).groupBy("c").agg(*[e.alias(n) for n, e in wanted.items()]).collect()
    jobs = [partial(part, some) for some in chunks([(i, c) for i, c in enumerate(names) if i not in but], COLUMNS_AT_ONCE)]
    out = {}
    for r in [r for rows in in_parallel(df.sparkSession, jobs) for r in rows]:
        got, c = r.asDict(), names[r["c"]]
        if kinds[c] != "text":
            got.pop("length")
        if kinds[c] != "numeric":
            for n in wanted.keys() - {"rows", "present", "length"}:
                got.pop(n, None)
        if moments and is_integral(df, c):
            got |= {"min": r["least_whole"], "max": r["most_whole"]}
        if moments and kinds[c] == "temporal":
            day = lambda t: t.date() if t is not None and isinstance(data_type(df, c), T.DateType) else t
            got |= {"min": day(r["first_at"]), "max": day(r["last_at"])}
        out[r["c"]] = got
    exact = [(i, c) for i, c in enumerate(names) if moments and isinstance(data_type(df, c), T.DecimalType) and i in out]
    ends = aggregate_row(df, {(i, n): e for i, c in exact for n, e in (("min", F.min(col(c))), ("max", F.max(col(c))))}) if exact else {}
    for (i, n), v in ends.items():
        out[i][n] = v
    return out


def _shape_names(kind: str, texts: bool, dates: bool, signals: bool) -> list[str]:
    out = ["sentinels", "numbers", "numeric_shape", "date_shape", "worded"] * (kind == "text" and texts)
    return out + ["dates"] * (kind == "text" and dates) + ["currency"] * (kind == "text" and signals) + ["binary"] * (kind != "other" and signals)


def _shapes(v: Column, kind: str, texts: bool, dates: bool, signals: bool) -> dict[str, Column]:
    """Tests on the text of a value, made once per distinct value.

    Number words are read only where the text holds one and is no number itself.
    """
    out = {}
    if kind == "text" and texts:
        worded = F.when(F.lower(v).rlike(NUMBER_WORD), plain_number(v).isNull() & words_to_number(v).isNotNull())
        out |= {"sentinels": F.lower(F.trim(v)).isin(TEXT_SENTINELS), "numbers": plain_number(v).isNotNull(),
                "numeric_shape": matches_format(v, "numeric"), "date_shape": matches_format(v, "date"), "worded": worded}
    if kind == "text" and dates:
        out["dates"] = parse_timestamp(v).isNotNull()
    if kind == "text" and signals:
        out["currency"] = F.lower(v).isin(CURRENCY_CODES)
    if kind != "other" and signals:
        out["binary"] = F.lower(v.cast("string")).isin(BINARY_TEXTS)
    return out


def _count_cells(df: DataFrame, facts: list[ColumnFacts], apart: set[int], top: int, texts: bool, dates: bool, signals: bool,
                 repeats: bool) -> None:
    """Distinct, least and most frequent values of all columns but those apart, text shapes, and repeated rows.

    Numbers are counted as numbers and everything else as text; what looks at the
    text of a value does so once per distinct value. Equal counts are ordered by text,
    those of lists and records by ``_as_parts`` of it.
    """
    short = [(i, f) for i, f in enumerate(facts) if id(f) not in apart]
    found = in_parallel(df.sparkSession, [
        partial(_counted_cells, df, some, top, texts, dates, signals, repeats and not n)
        for n, some in enumerate(chunks(short, COLUMNS_AT_ONCE) or [[]] * bool(repeats))])
    best: dict[int, list] = {}
    for r in [r for rows in found for r in rows]:
        if r["c"] == ROW:
            for f in facts:
                f.repeats = f.rows - r["distinct"]
            continue
        f = facts[r["c"]]
        if r["distinct"] is None:
            best.setdefault(r["c"], []).append((r["rank"], r["v"], r["n"]))
            continue
        f.distinct = r["distinct"]
        f.least, f.top = (r["least"]["v"], r["least"]["n"]), [(r["most"]["v"], -r["most"]["n"])]
        f.got |= {name: r[name] or 0 for name in _shape_names(f.kind, texts, dates, signals)}
        if f.got.get("q1") is not None:
            f.got["outliers"] = r["outliers"] or 0
    for i, rows in best.items():
        facts[i].top = [(v, n) for _, v, n in sorted(rows)]


def _row_hashes(df: DataFrame) -> list[Column]:
    keys = [k for c in df.columns for k in (orderable(df, c), col(c).isNull())]
    return [F.xxhash64(*keys).alias("a"), F.xxhash64(F.lit(1), *keys).alias("b")]


def _count_rows(df: DataFrame, facts: list[ColumnFacts]) -> None:
    """Repeated rows, by 128 bits of hash."""
    unlike = df.select(*_row_hashes(df)).distinct().count()
    for f in facts:
        f.repeats = f.rows - unlike


def _beyond(x: Column, f: ColumnFacts) -> Column:
    q1, q3 = f.got["q1"], f.got["q3"]
    return ~x.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))


def _count_outliers(df: DataFrame, facts: list[ColumnFacts]) -> None:
    fenced = [f for f in facts if f.got.get("q1") is not None]
    got = aggregate_row(df, {f.name: F.count_if(_beyond(number(df, f.name), f)) for f in fenced}) if fenced else {}
    for f in fenced:
        f.got["outliers"] = got[f.name]


def _counted_cells(df: DataFrame, facts: list[tuple[int, ColumnFacts]], top: int, texts: bool, dates: bool, signals: bool, repeats: bool) -> list:
    blank = {"s": "string", "d": "double", "l": "bigint"}

    def cell(i: int, slot: str | None, v: Column | None, a: Column | None = None, b: Column | None = None) -> Column:
        fields = [(v if n == slot else F.lit(None)).cast(t).alias(n) for n, t in blank.items()]
        hashes = [(F.lit(None) if h is None else h).cast("bigint").alias(n) for n, h in (("a", a), ("b", b))]
        return F.struct(F.lit(i).alias("c"), *fields, *hashes)

    cells, narrow = [], []
    for i, f in facts:
        v = value(df, f.name)
        if f.kind == "numeric" and not isinstance(data_type(df, f.name), T.DecimalType):
            cells.append(cell(i, "l" if f.integral else "d", v))
            narrow += [i] * isinstance(data_type(df, f.name), T.FloatType)
        else:
            cells.append(cell(i, "s", as_text(df, f.name)))
    if repeats:
        cells.append(cell(ROW, None, None, *_row_hashes(df)))
    counted = _cells(df, cells).filter("s IS NOT NULL OR d IS NOT NULL OR l IS NOT NULL OR a IS NOT NULL") \
        .groupBy("c", "s", "d", "l", "a", "b").agg(F.count("*").alias("n"))
    number = F.when(F.col("c").isin(narrow), F.col("d").cast("float").cast("string")).otherwise(F.col("d").cast("string"))
    x = F.coalesce("d", F.col("l").cast("double"), F.when(F.col("c").isin([i for i, f in facts if f.kind == "numeric"]), F.col("s").try_cast("double")))
    counted = counted.select("c", F.coalesce("s", F.col("l").cast("string"), number).alias("v"), x.alias("x"), "n")
    tests = {}
    fenced = [(i, f) for i, f in facts if f.got.get("q1") is not None]
    if fenced:
        tests["outliers"] = F.coalesce(*[F.when(F.col("c") == i, _beyond(F.col("x"), f)) for i, f in fenced])
    for kind in dict.fromkeys(f.kind for _, f in facts):
        mine = F.col("c").isin([i for i, f in facts if f.kind == kind])
        for name, test in _shapes(F.col("v"), kind, texts, dates, signals).items():
            tests[name] = tests.get(name, F.lit(False)) | (mine & F.when(mine, test))
    nested = [i for i, f in facts if f.kind == "other"]
    tie = [F.when(F.col("c").isin(nested), _as_parts("v"))] if nested else []
    ends = counted.groupBy("c").agg(
        F.count("*").alias("distinct"), F.min(F.struct("n", *tie, "v")).alias("least"), F.min(F.struct((-F.col("n")).alias("n"), *tie, "v")).alias("most"),
        *[F.sum(F.when(test, F.col("n"))).alias(name) for name, test in tests.items()])
    if top > 1:
        # Both sides read the same counts, which Spark shuffles once; each task hands on its best of a column.
        best = Window.partitionBy("c").orderBy(F.desc("n"), *tie, F.asc("v"))
        first = counted.filter(F.col("c") != ROW).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        ends = ends.unionByName(first.select("c", "v", "n", "rank"), allowMissingColumns=True)
    return ends.collect()


def _count_long_column(df: DataFrame, f: ColumnFacts, top: int, texts: bool, dates: bool, signals: bool) -> None:
    values = df.select((as_text(df, f.name) if f.kind == "other" else value(df, f.name)).alias("v")).filter("v IS NOT NULL")
    _count_long_texts(values, f, top)
    shapes = _shapes(F.col("v"), f.kind, texts, dates, signals)
    f.got |= aggregate_row(values, {name: F.count_if(test) for name, test in shapes.items()}) if shapes else {}


def _count_long_texts(values: DataFrame, f: ColumnFacts, top: int) -> None:
    """Distinct, least and most frequent values, counted by 128 bits of hash.

    The counts tell which levels of frequency are wanted; only of these are the
    smallest texts fetched.
    """
    marked = values.withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})
    counted = marked.groupBy("a", "b").agg(F.count("*").alias("n"))
    levels = counted.groupBy("n").agg(F.count("*").alias("size"))
    f.distinct, least = levels.agg(F.coalesce(F.sum("size"), F.lit(0)), F.min("n")).first()
    if not f.distinct:
        return
    sizes = {r["n"]: r["size"] for r in levels.orderBy(F.desc("n")).limit(max(top, 1)).collect()}
    size_of_least = sizes.get(least) or levels.filter(F.col("n") == least).first()["size"]

    def smallest(level: int, size: int, wanted: int) -> list[str]:
        """The first texts among those that occur ``level`` times."""
        there = counted.filter(F.col("n") == level).select("a", "b")
        others = counted.filter(F.col("n") != level).select("a", "b")
        if size <= FEW_CANDIDATES:
            rows = marked.join(F.broadcast(there), ["a", "b"], "left_semi").select("v").distinct()
        elif f.distinct - size <= FEW_CANDIDATES:
            rows = marked.join(F.broadcast(others), ["a", "b"], "left_anti").select("v")
            rows = rows if level == 1 else rows.distinct()
        else:
            rows = marked.join(there, ["a", "b"], "left_semi").select("v").distinct()
        return [r["v"] for r in rows.orderBy(*[_as_parts("v")] * (f.kind == "other"), "v").limit(wanted).collect()]

    f.top = []
    for level, size in sizes.items():
        if len(f.top) < max(top, 1):
            f.top += [(v, level) for v in smallest(level, size, min(size, max(top, 1) - len(f.top)))]
    f.least = (f.top[0][0], least) if least in sizes and len(sizes) == 1 else (smallest(least, size_of_least, 1)[0], least)


def add_text_range(df: DataFrame, facts: list[ColumnFacts]) -> None:
    """Smallest and largest text of columns that hold dates as text."""
    wanted = {(f.name, k): e for f in facts for k, e in (("min", F.min(col(f.name))), ("max", F.max(col(f.name))))}
    got = aggregate_row(df, wanted)
    for f in facts:
        f.got |= {k: got[f.name, k] for k in ("min", "max")}


def _add_quartiles(df: DataFrame, facts: list[ColumnFacts], found: dict[str, dict]) -> None:
    """Quartiles of number columns, from the brackets ``found`` where there are such."""
    numeric = {f.name: f for f in facts if f.kind == "numeric"}
    for c, q in quantiles(df, list(numeric), QUARTILES, found=found).items() if numeric else []:
        numeric[c].got |= dict(zip(("q1", "median", "q3"), q))


def count_duplicates(df: DataFrame) -> int:
    """Rows beyond the first of each fully equal row.

    A first pass shuffles only a hash per row. Rows whose hash occurs once are
    unique; the others are compared in full.
    """
    keys = [orderable(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
    hashed = df.select(*keys).withColumn("h", F.xxhash64(*[f"k{i}" for i in range(len(keys))]))
    repeated = hashed.groupBy("h").count().filter("count > 1").select("h")
    size = repeated.limit(FEW_CANDIDATES + 1).count()
    if size == 0:
        return 0
    if size <= FEW_CANDIDATES:
        hashed = hashed.join(F.broadcast(repeated), "h", "left_semi")
    counted = hashed.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
