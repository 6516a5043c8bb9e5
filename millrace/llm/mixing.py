"""Mixing sources to target weights, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.frame import col, settle

#: Documents in one bucket of a leaf's seeded order.
BUCKET_ROWS = 20_000
#: Leaves, some 100 bytes each, whose plan may be sent to every task.
SENT = 100_000
BLANKS = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Stretches without blanks; null has none. Only the ends of a split can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return (F.size(parts) - (parts[0] == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def weight_of(level: str, weights: dict) -> Column:
    """The weight of a node by its value; 1 where none is given."""
    out = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Split each parent's budget over its children (name, capacity, weight, budget of the parent).

    Children get what their weights ask for, up to capacity; what full children
    leave goes to their siblings by weight. In the order of capacity per weight all
    full children come first, so running sums tell which they are. Shares are
    rounded down.
    """
    order = [(F.col("capacity") / F.col("weight")), F.col("name")]
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("rest", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) \
        .withColumn("open", F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    nodes = nodes.withColumn("full", big(F.col("rest")) * big(F.col("weight")) >= big(F.col("capacity")) * big(F.col("open")))
    first = F.min(F.when(~F.col("full"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "rest", "open"))).over(w)
    nodes = nodes.withColumn("first", first)
    exact = F.expr("cast(cast(weight as decimal(38,0)) * first.rest div first.open as bigint)")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(exact)).drop("rest", "open", "full", "first")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict, budget: Column | int | None, share: float, max_epochs: int) -> DataFrame:
    """Token budget of each leaf (levels, tokens, rows): from the root down, level by level."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    wanted = F.lit(budget).cast("long") if budget is not None else F.floor(total * share).cast("long")
    nodes = nodes.withColumn("budget", F.least(wanted, F.sum("capacity").over(Window.partitionBy(F.lit(1)))))
    for depth, level in enumerate(levels):
        here = levels[: depth + 1]
        children = nodes.groupBy(*here).agg(F.sum("capacity").alias("capacity"), F.first("budget").alias("budget")) \
            .withColumn("name", F.col(level)).withColumn("weight", weight_of(level, weights))
        given = share_out(children.filter("weight > 0"), here[:-1]).select(*here, F.col("budget").alias("given"))
        nodes = nodes.join(given, here, "left").withColumn("budget", F.coalesce("given", F.lit(0).cast("long"))).drop("given")
    return nodes


def mix_sources(docs: DataFrame, levels: dict[str, str], weights: dict[str, dict[str, int]] | None = None, budget: int | None = None,
                share: float = 1.0, max_epochs: int = 2, seed: int = 7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, levels..., n_tokens, copies): how often each row enters the mixture.

    ``levels`` names the tree from the top, domain over language over source, each
    with its SQL expression; a null counts as the empty string. ``weights`` gives whole
    numbers by level and value, 1 by default; a weight of 0 shuts a node out. The
    ``budget``, or ``share`` of all tokens, goes down the tree: each node splits its
    own among its children by weight, a leaf holds at most ``max_epochs`` times its
    tokens, and what a child cannot use goes to its siblings first and only through
    the parent to the parent's siblings. Tokens are words.

    A leaf takes whole epochs, then the longest prefix of one more seeded order of
    its documents that fits the rest. The order is that of an md5 of seed, epoch and
    id; equal rows go together. Running sums are made of buckets of that order, and
    only the bucket in which the prefix ends is sorted, so a hot leaf fills no task.
    The plan of up to SENT leaves, which are counted, is sent to all tasks; a larger
    one is joined.
    Empty texts cost nothing and go in where the order places them. An empty table
    gives no rows.
    """
    names = list(levels)
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"),
                       *[F.coalesce(F.expr(e).cast("string"), F.lit("")).alias(n) for n, e in levels.items()],
                       col(id_column).alias("id"), word_count(col(text_column).cast("string")).alias("n_tokens"),
                       F.md5(F.coalesce(col(text_column).cast("string"), F.lit(""))).alias("tie"))
    narrow = settle(rows.drop("row"))
    leaves = narrow.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    plan = leaf_budgets(leaves, names, weights or {}, budget, share, max_epochs)
    plan = settle(plan.select(*names, F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).alias("epochs"),
                       F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0)).alias("rest"),
                       F.ceil(F.col("rows") / BUCKET_ROWS).cast("long").alias("buckets")))
    sent = F.broadcast if plan.count() <= SENT else lambda table: table

    def placed(table):
        text = F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))
        place = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
        table = table.withColumn("place", place)
        return table.withColumn("bucket", F.expr("shiftright(shiftright(place, 30) * buckets, 30)"))

    joined = placed(narrow.join(sent(plan), names))
    sums = joined.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    running = F.sum("n").over(Window.partitionBy(*names).orderBy("bucket"))
    ends = sums.withColumn("upto", running).filter("upto > rest") \
        .groupBy(*names).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("end")) \
        .select(*names, F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before"))
    order = ["place", "id", "n_tokens", "tie"]
    inside = joined.join(sent(ends), names).filter("bucket = end_bucket")
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*names).orderBy(*order))
    cuts = inside.withColumn("upto", upto).filter("upto <= rest").groupBy(*names).agg(F.max(F.struct(*order)).alias("cut"))
    plan = plan.join(ends.drop("before"), names, "left").join(cuts, names, "left")
    out = placed(rows.join(sent(settle(plan)), names))
    in_prefix = F.expr("end_bucket IS NULL OR bucket < end_bucket") | \
        (F.expr("bucket = end_bucket") & F.coalesce(F.struct(*order) <= F.col("cut"), F.lit(False)))
    fits = F.col("rest") > 0
    return out.select("row", *names, "n_tokens", (F.col("epochs") + (fits & in_prefix).cast("long")).alias("copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as ``mix_sources`` says."""
    chosen = mix_sources(docs, **options).filter("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
