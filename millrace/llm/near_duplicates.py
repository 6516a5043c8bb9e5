"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.frame import settle

from .components import components
from .features import pieces
from .rolling import Rolling, mix, ranges
from .texts import BLANK, LOWER, Shard, encoded, keyed, shards, word_hashes, words_of

U = np.uint64
SHARD = 1 << 20
BLOCK = 2000  # documents of a band that are compared with as many at once
FAMILY_SHINGLES = 1_000_000  # of a family's documents in one block
SKETCHES = "key long, n long, set_a long, set_b long, bands array<long>, sketch array<long>"


def shingle_sets(s: Shard, width: int):
    """For each document of a shard the sorted hashes of its distinct shingles.

    Letters A-Z count as a-z. Fewer words than width make one shingle, none make none.
    """
    low = Shard(s.keys, LOWER[s.data], s.starts, s.lengths)
    words = words_of(low, BLANK)
    rolling = Rolling(word_hashes(low.data, words))
    grams = rolling.grams(width)
    for first, count in zip(words.first.tolist(), words.counts.tolist()):
        if count >= width:
            yield np.unique(grams[first : first + count - width + 1])
        else:
            yield rolling.spans(np.array([first]), np.array([first + count])) if count else np.zeros(0, U)


def sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Odd sketch: bit i tells whether an odd number of the samples hash to i."""
    place = mix(samples.astype(U) + np.arange(len(samples), dtype=U) * U(0x9E3779B97F4A7C15)) % U(bits)
    return np.packbits((np.bincount(place.astype(int), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def largest_difference(samples: int, bits: int, similarity: float, sigmas: float = 6) -> int:
    """Bits in which sketches of sets of this similarity differ, plus sigmas deviations.

    A sample differs with probability 1 - similarity and then flips two bits.
    """
    flips = 2 * samples * (1 - similarity)
    expected = bits / 2 * (1 - math.exp(-2 * flips / bits))
    by_samples = 2 * math.sqrt(samples * similarity * (1 - similarity)) * math.exp(-2 * flips / bits)
    by_bits = math.sqrt(flips * min(1, flips / bits))
    return math.ceil(expected + sigmas * math.hypot(by_samples, by_bits))


def sketch_documents(width: int, bands: int, rows: int, bits: int) -> Callable:
    def run(batches):
        rng = np.random.default_rng(6)
        n = bands * rows
        a = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None] | np.uint32(1)
        b = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]
        weight = rng.integers(0, 2**63, (bands, rows), dtype=U) * U(2) + U(1)
        for s in shards(batches, SHARD):
            out, known = [], {}
            for key, x in zip(s.keys.tolist(), shingle_sets(s, width)):
                spread = mix(x + U(77))
                sums = (int(x.sum(dtype=U).view(np.int64)), int(spread.sum(dtype=U).view(np.int64)))
                if not len(x):
                    out.append((key, 0, 0, 0, [], []))
                    continue
                if sums not in known:
                    short = (spread >> U(32)).astype(np.uint32)
                    least = np.full(n, 2**32 - 1, np.uint32)
                    for at in range(0, len(short), 1024):
                        np.minimum(least, (a * short[at : at + 1024] + b).min(axis=1), out=least)
                    band = mix((least.reshape(bands, rows) * weight).sum(axis=1, dtype=U) + np.arange(bands, dtype=U))
                    known[sums] = band.view(np.int64), sketch(least, bits)
                out.append((key, len(x), *sums, *known[sums]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2)],
                names=["key", "n", "set_a", "set_b", "bands", "sketch"])

    return run


def difference(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


class Joined:
    """Which of some numbered things have been joined so far."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, of) -> np.ndarray:
        root = self.up[of]
        while True:
            above = self.up[root]
            if (above == root).all():
                return root
            root = above

    def join(self, a: int, others: np.ndarray) -> np.ndarray:
        """Join a with the others; returns one of the others for each set that was still apart."""
        if not len(others):
            return others
        mine, theirs = self.roots(np.array([a]))[0], self.roots(others)
        apart, first = np.unique(theirs, return_index=True)
        first = first[apart != mine]
        self.up[apart] = mine
        return others[first]


def plausible_links(most: int, percent: int) -> Callable:
    """Links between components that the sketches allow, of two blocks of a band, one for each join."""

    def run(t: pa.Table) -> pa.Table:
        key, size = t["key"].to_numpy(), t["n"].to_numpy()
        asks = t["asks"].to_numpy(zero_copy_only=False)
        component = np.unique(t["component"].to_numpy(), return_inverse=True)[1]
        bits = np.array(t["sketch"].to_pylist(), np.int64).reshape(len(key), -1).view(U)
        there = np.flatnonzero(~asks)
        known, out = Joined(int(component.max()) + 1), []
        for i in np.flatnonzero(asks):
            others = there[100 * np.minimum(size[there], size[i]) >= percent * np.maximum(size[there], size[i])]
            others = others[np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1) <= most]
            numbers, first = np.unique(component[others], return_index=True)
            new = known.join(component[i], numbers)
            out += [(key[i], key[others[f]]) for f, c in zip(first, numbers) if c in set(new.tolist())]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def confirmed_links(width: int, percent: int) -> Callable:
    """Links that the full sets of some documents confirm, one for each join.

    A document is counted against all others through the places of its shingles.
    Those that the first document does not reach are each compared with all, so no
    link between two components is missed.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")  # links then point to the least document where they can
        key = t["key"].to_numpy()
        # Hashing takes many times the bytes of a text, so only a piece of the block is hashed at once.
        sets = [x for s in pieces(encoded(t["text"])) for x in shingle_sets(s, width)]
        size = np.array([len(x) for x in sets])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(size)
        order = np.argsort(number, kind="stable")
        owner = np.repeat(np.arange(len(key)), size)[order]
        edges = np.searchsorted(number[order], np.arange(number.max() + 2))
        known, out, todo = Joined(len(key)), [], [0]
        while todo:
            i = todo.pop()
            mine = number[ends[i] - size[i] : ends[i]]
            low = edges[mine]
            shared = np.bincount(owner[ranges(low, edges[mine + 1] - low)], minlength=len(key))
            near = np.flatnonzero(100 * shared >= percent * (size + size[i] - shared))
            out += [(key[i], key[j]) for j in known.join(i, near[near != i])]
            if not i:
                roots = known.roots(np.arange(len(key)))
                todo = np.flatnonzero(roots != roots[0]).tolist()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def across_bands(member: DataFrame, families: DataFrame, mates: DataFrame, link: Callable) -> DataFrame:
    """Links (a, b) between the families that still meet in a band.

    The members outside a band's largest family ask all members. Both sides are cut
    into blocks, so that a task never holds more of a band than two of them.
    """
    labelled = member.select("band", "key").join(families.withColumnRenamed("node", "key"), "key", "left") \
        .select("band", "key", F.coalesce("component", "key").alias("component"))
    sizes = labelled.groupBy("band", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("band").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("c"),
                                      F.sum("c").alias("total"), F.count("*").alias("components")).filter("components > 1")
    mixed = mixed.select("band", "main", F.ceil(F.col("total") / BLOCK).cast("int").alias("wide"),
                         F.ceil((F.col("total") - F.col("c")) / BLOCK).cast("int").alias("tall"))
    inside = labelled.join(mixed, "band").join(mates, "key")
    place = F.xxhash64("key", "band")
    outside = inside.filter("component != main").withColumn("y", F.pmod(place, F.col("tall")).cast("int")) \
        .withColumn("x", F.explode(F.expr("sequence(0, wide - 1)"))).withColumn("asks", F.lit(True))
    against = inside.withColumn("x", F.pmod(place, F.col("wide")).cast("int")) \
        .withColumn("y", F.explode(F.expr("sequence(0, tall - 1)"))).withColumn("asks", F.lit(False))
    columns = ["band", "x", "y", "key", "component", "n", "sketch", "asks"]
    return outside.select(*columns).unionAll(against.select(*columns)).groupBy("band", "x", "y") \
        .applyInArrow(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = 50, band_rows: int = 6, bits: int = 1024,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The component of each document under links of similar shingle sets.

    Words are stretches without blanks, with A-Z as a-z. A document's set is its
    distinct shingles of ``width`` words, or all its words if there are fewer.
    Two documents are linked if their sets' Jaccard similarity is at least
    ``percent`` / 100, confirmed on the full sets.

    Equal sets go as one. Sets that share a band of MinHash samples are candidates.
    Odd sketches, parity bitmaps of the samples, rule out candidates whose XOR count
    lies six deviations beyond that of the wanted similarity; what they allow makes
    families. A band links its members to the least of them, and then those outside
    its largest family to all. Within a family, blocks of documents meet in pairs
    and links are confirmed on the full sets; only links that join something leave a
    task. At similarity 0.85 the bands miss a pair with a probability of
    (1 - 0.85**band_rows)**bands, 5e-11.

    Returns per row: the id, n_shingles, component_id (the least id of the
    component) and kept (true for that one). Null and empty texts have no shingles
    and are their own component. Rows that share an id, or have none, are separate
    documents, of which the first by text counts as the least. An empty table
    gives no rows; other columns are ignored.
    """
    return label_rows(keyed(docs, id_column, text_column), width, percent, bands, band_rows, bits).withColumnRenamed("id", id_column).drop("key")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 60, band_rows: int = 5, bits: int = 1024,
                         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that ``near_duplicates`` keeps, one of each component."""
    rows = keyed(docs, id_column, text_column, whole=True)
    labelled = label_rows(rows.select("key", "id", "text"), width, percent, bands, band_rows, bits)
    return rows.join(labelled.filter("kept").select("key"), "key", "left_semi").select("row.*")


def label_rows(rows: DataFrame, width: int, percent: int, bands: int, band_rows: int, bits: int) -> DataFrame:
    """``near_duplicates`` for rows (key, id, text); returns key and id too."""
    sketches = settle(rows.select("key", "text").mapInArrow(sketch_documents(width, bands, band_rows, bits), SKETCHES))
    full = sketches.filter("n > 0")
    kinds = settle(full.groupBy("set_a", "set_b", "n").agg(F.min("key").alias("rep")))
    reps = full.join(kinds.select(F.col("rep").alias("key")), "key", "left_semi")
    banded = reps.select("key", F.explode("bands").alias("band"))
    pivots = banded.groupBy("band").agg(F.min("key").alias("pivot"), F.count("*").alias("c")).filter("c > 1")
    member = settle(banded.join(pivots, "band").select("band", "key", "pivot"))
    mates = settle(reps.join(member.select("key").distinct(), "key", "left_semi").select("key", "n", "sketch"))
    most = largest_difference(bands * band_rows, bits, percent / 100)

    def side(name, table, *columns):
        return table.select(F.col("key").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def confirmed(pairs):
        both = pairs.join(side("a", texts, "text"), "a").select("a", "b", "text_a").join(side("b", texts, "text"), "b")
        return settle(both.select("a", "b", "text_a", "text_b").mapInArrow(confirm(width, percent), "a long, b long"))

    pairs = member.filter("key > pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    allowed = settle(pairs.join(side("a", mates, "n", "sketch"), "a").join(side("b", mates, "n", "sketch"), "b")
                     .filter(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)") & (difference("sketch_a", "sketch_b") <= most))
                     .select("a", "b"))
    families = components(allowed)
    across = settle(across_bands(member, families, mates, plausible_links(most, percent)))
    if not across.isEmpty():
        families = components(allowed.unionAll(across))
    family = families.withColumnRenamed("node", "key").withColumnRenamed("component", "family").join(mates.select("key", "n"), "key")
    blocks = family.groupBy("family").agg(F.ceil(F.sum("n") / FAMILY_SHINGLES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = family.join(blocks, "family").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    texts = rows.select("key", "text")
    links = settle(placed.select("key", "family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).join(texts, "key")
                   .groupBy("family", "x", "y").applyInArrow(confirmed_links(width, percent), "a long, b long"))
    found = components(links)
    named = rows.select(F.col("key").alias("component"), F.col("id").alias("component_id"))
    return (
        rows.select("key", "id").join(sketches.select("key", "n", "set_a", "set_b"), "key")
        .join(kinds, ["set_a", "set_b", "n"], "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "id", "n", F.coalesce("component", "rep", "key").alias("component"))
        .join(named, "component")
        .select("key", "id", F.col("n").alias("n_shingles"), "component_id", (F.col("key") == F.col("component")).alias("kept"))
    )
