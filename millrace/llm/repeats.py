"""Stretches of a fixed length that occur more than once in a corpus, found exactly.

Two operators share this plan; they differ in the unit (bytes or words), in which
occurrences go, and in how windows of one shard are compared.

1. Winnowing. Every window of ``length`` units owns one gram, the least hash in it.
   Equal windows own equal grams at equal places. The windows that own one gram
   form a region. Regions are dealt out by gram; copies within a shard go as one.
2. Regions that are equal as a whole need no further look. Regions that share a
   gram but differ are offered for comparison, one of each kind.
3. Only offered regions leave their documents again: as text for a suffix array,
   or as one hash per window. A gram with very many kinds of region always goes as
   hashes, which spread over all tasks.
4. Windows are compared; what is found returns to its documents as intervals.

Documents are met in groups of bounded size, by key modulo a prime. Nothing is
held per gram or per document beyond one shard, so no hot gram fills a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rolling import Rolling, byte_codes, merged, mix, ranges, winnow
from .suffixes import LARGEST, classes
from .texts import encoded, joined, keyed, planes, prime_from, shard, shards, split_by, text_bytes, word_hashes, words_of

U = np.uint64
SHARD = 1 << 20  # bytes of text that are hashed at once
HELD = 1 << 19  # regions that a task gathers before it deals them out
PER_TASK = 1_000_000  # regions, or bytes of offered text, in one bucket
GROUP = 4 << 20  # bytes of text in a group of documents
HOT_KINDS = 4096  # kinds of region beyond which a gram goes as window hashes

REGIONS = "bucket int, gram binary, whole binary, key binary, start binary, size binary, many binary, done_key binary, done_start binary, done_size binary"
FLAGGED = "grp int, key binary, start binary, size binary, flag binary, gram binary"
OFFERED = "part int, key binary, start binary, size binary, gram binary, hash binary, text binary"
FOUND = "grp int, key binary, start binary, stop binary"
REPEATED, OFFER, HOT = 1, 2, 4


@dataclass(frozen=True)
class Rule:
    """What repeats: windows of ``length`` units, owned by grams of ``gram`` units.

    separators: bytes between words, or None where the units are bytes.
    keep_first: spare the first occurrence, by key and place; else all go.
    """

    length: int
    gram: int
    separators: np.ndarray | None
    keep_first: bool

    @property
    def span(self) -> int:
        return self.length - self.gram + 1


def units(s, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a shard's units, and of each document its first unit and their count."""
    if rule.separators is None:
        return byte_codes(1)[s.data], s.starts, s.lengths
    w = words_of(s, rule.separators)
    return word_hashes(s.data, w), w.first, w.counts


def regions_of(s, rule: Rule):
    """(gram, whole, key, start, size) of every region of a shard."""
    codes, first, counts = units(s, rule)
    rolling = Rolling(codes)
    grams = rolling.grams(rule.gram)
    owner = winnow(grams, rule.span)
    per_doc = np.maximum(counts - rule.length + 1, 0)
    window = ranges(first, per_doc)
    doc = np.repeat(np.arange(len(first)), per_doc)
    own = owner[window]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])))) if len(own) else np.zeros(0, int)
    size = np.diff(np.append(new, len(own)))
    at = window[new]
    d = doc[new]
    return grams[own[new]], rolling.spans(at, at + size - 1 + rule.length), s.keys[d], (at - first[d]).astype(np.uint32), size.astype(np.uint16)


def kinds(gram, whole, key, start):
    """Order by gram, whole, key and start; heads of grams and of kinds in it."""
    order = np.lexsort((start, key, whole, gram))
    g, w = gram[order], whole[order]
    new_gram = np.concatenate(([True], g[1:] != g[:-1]))
    return order, new_gram, new_gram | np.concatenate(([True], w[1:] != w[:-1]))


def find_regions(rule: Rule, buckets: int) -> Callable:
    """Step 1: regions of a task's documents by bucket, one of each kind per load."""

    def deal(parts):
        gram, whole, key, start, size = (np.concatenate(x) for x in zip(*parts))
        if not len(gram):
            return
        order, _, new = kinds(gram, whole, key, start)
        heads = np.flatnonzero(new)
        many = np.diff(np.append(heads, len(order))) > 1
        kept, rest = order[heads], order[~new]
        place = (gram >> U(32)) % U(buckets)
        rests = {b: x for b, x in split_by(place[rest], key[rest], start[rest], size[rest])}
        for b, x in split_by(place[kept], gram[kept], whole[kept], key[kept], start[kept], size[kept], many.astype(np.uint8)):
            by_place = np.lexsort((x[3], x[2]))
            row = [b, *[planes(a[by_place]) for a in x], *([planes(a) for a in rests[b]] if b in rests else [None] * 3)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32()] + [pa.binary()] * 9)],
                                             names=["bucket", "gram", "whole", "key", "start", "size", "many", "done_key", "done_start", "done_size"])

    def run(batches):
        parts, held = [], 0
        for s in shards(batches, SHARD):
            parts.append(regions_of(s, rule))
            held += len(parts[-1][0])
            if held >= HELD:
                yield from deal(parts)
                parts, held = [], 0
        if parts:
            yield from deal(parts)

    return run


def by_group(groups: int, key, *arrays):
    """Packed rows (grp, key, arrays...) of each group of documents."""
    for g, x in split_by(key % groups, key, *arrays):
        yield [g, *map(planes, x)]


def table(rows: list[list], names: str) -> pa.Table:
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    kind = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array(c, kind[t]) for (n, t), c in zip(fields, columns)})


def flag_regions(rule: Rule, groups: int, by_hash: bool) -> Callable:
    """Step 2: what the regions of one bucket know of one another."""

    def run(t: pa.Table) -> pa.Table:
        gram, whole, key = (joined(t[c], d) for c, d in (("gram", U), ("whole", U), ("key", np.int64)))
        start, size, many = (joined(t[c], d) for c, d in (("start", np.uint32), ("size", np.uint16), ("many", np.uint8)))
        order, new_gram, new = kinds(gram, whole, key, start)
        gram_no, kind_no = np.cumsum(new_gram) - 1, np.cumsum(new) - 1
        count = np.bincount(kind_no)
        several = (np.add.reduceat(many[order], np.flatnonzero(new)) > 0) | (count > 1) if len(new) else count > 1
        kinds_of = np.bincount(gram_no[new])
        flag = np.where(rule.keep_first, ~new, several[kind_no]) * REPEATED
        offer = new & (kinds_of[gram_no] > 1)
        flag = flag + offer * OFFER + (offer & (by_hash | (kinds_of[gram_no] > HOT_KINDS))) * HOT
        told = flag > 0
        at = order[told]
        done = [joined(t[c], d) for c, d in (("done_key", np.int64), ("done_start", np.uint32), ("done_size", np.uint16))]
        n = len(done[0])
        out = [np.concatenate(x) for x in ((key[at], done[0]), (start[at], done[1]), (size[at], done[2]),
                                           (flag[told].astype(np.uint8), np.full(n, REPEATED, np.uint8)), (gram[at], np.zeros(n, U)))]
        by_place = np.lexsort((out[1], out[0]))
        return table(list(by_group(groups, *[x[by_place] for x in out])), FLAGGED)

    return run


def per_key(keys: np.ndarray, wanted: np.ndarray):
    """For each key of a group of documents, the slice of the sorted ``wanted`` that is its."""
    return np.searchsorted(wanted, keys, "left"), np.searchsorted(wanted, keys, "right")


def offer_regions(rule: Rule, parts: int) -> Callable:
    """Step 3: the offered regions of a group of documents, and what already is known to go."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return table([], OFFERED)
        key, start, size = (joined(told[c], d) for c, d in (("key", np.int64), ("start", np.uint32), ("size", np.uint16)))
        flag, gram = joined(told["flag"], np.uint8), joined(told["gram"], U)
        order = np.lexsort((start, key))
        key, start, size, flag, gram = (x[order] for x in (key, start, size, flag, gram))
        rows = []
        gone = (flag & REPEATED) > 0
        if gone.any():
            k, a, b = intervals(key[gone], start[gone].astype(np.int64), start[gone].astype(np.int64) + size[gone] - 1 + rule.length)
            rows.append([int(k[0] % parts), planes(k), planes(a.astype(np.uint32)), planes(b.astype(np.uint32)), None, None, None])
        offer = (flag & OFFER) > 0
        key, start, size, flag, gram = (x[offer] for x in (key, start, size, flag, gram))
        keys = docs["key"].to_numpy()
        low, high = per_key(keys, key)
        with_offers = np.flatnonzero(high > low)
        if len(with_offers):
            taken = docs.take(pa.array(with_offers))
            s = shard(keys[with_offers], encoded(taken["text"]))
            codes, first, _ = units(s, rule)
            mine = ranges(low[with_offers], (high - low)[with_offers])
            at = start[mine].astype(np.int64) + np.repeat(first, (high - low)[with_offers])
            key, start, size, flag, gram = (x[mine] for x in (key, start, size, flag, gram))
            hashed = (flag & HOT) > 0
            rows += window_rows(codes, at[hashed], key[hashed], start[hashed], size[hashed], gram[hashed])
            text = ~hashed
            for p, (a, k, st, sz) in split_by((gram[text] >> U(32)) % U(parts), at[text], key[text], start[text], size[text]):
                b = s.data[ranges(a, sz.astype(np.int64) - 1 + rule.length)]
                rows.append([p, planes(k), planes(st), planes(sz), None, None, b.tobytes()])
        return table(rows, OFFERED)

    def window_rows(codes, at, key, start, size, gram):
        n = size.astype(np.int64)
        own = Rolling(codes).grams(rule.length)[ranges(at, n)]
        own_gram = np.repeat(gram, n)
        places = ranges(start.astype(np.int64), n).astype(np.uint32)
        return [[p, planes(k), planes(s), None, planes(g), planes(h), None] for p, (k, s, g, h) in
                split_by((mix(own ^ own_gram) >> U(32)) % U(parts), np.repeat(key, n), places, own_gram, own)]

    return run


def intervals(key, start, stop):
    """Maximal intervals of each key."""
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    if not len(key):
        return key, start, stop
    # one line for all keys: each key's places lie beyond those of the key before it
    new = np.concatenate(([True], key[1:] != key[:-1]))
    number = np.cumsum(new) - 1
    widest = np.maximum.reduceat(stop, np.flatnonzero(new)) + 1
    shift = np.concatenate(([0], np.cumsum(widest)))[:-1]
    a, b = merged(start + shift[number], stop + shift[number])
    owner = np.searchsorted(shift, a, "right") - 1
    return key[new][owner], a - shift[owner], b - shift[owner]


def repeated_by_hash(rule: Rule, t: pa.Table):
    """Windows that occur again, of those that came as (gram, hash)."""
    gram, own, key, start = (joined(t[c], d) for c, d in (("gram", U), ("hash", U), ("key", np.int64), ("start", np.uint32)))
    order = np.lexsort((start, key, own, gram))
    gram, own, key, start = (x[order] for x in (gram, own, key, start))
    if not len(key):
        return key, start
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])))
    number = np.cumsum(new) - 1
    goes = ~new if rule.keep_first else (np.bincount(number) > 1)[number]
    return key[goes], start[goes]


def shard_classes(rule: Rule, data, key, start, size):
    """Windows of one suffix array: key, start and class number in suffix order, and a hash of each class."""
    lengths = size - 1 + rule.length
    first = np.cumsum(lengths + 1) - lengths - 1  # a separator that no UTF-8 text holds follows each region
    text = np.full(int(lengths.sum()) + len(lengths), 255, np.uint8)
    text[ranges(first, lengths)] = data
    places, number = classes(text, first, size, rule.length)
    region = np.searchsorted(first, places, "right") - 1
    rolling = Rolling(byte_codes(3)[text])
    heads = np.concatenate(([True], number[1:] != number[:-1]))
    hashes = rolling.spans(places[heads], places[heads] + rule.length)
    return key[region], start[region].astype(np.int64) + places - first[region], np.cumsum(heads) - 1, hashes


def repeated_by_suffixes(rule: Rule, t: pa.Table):
    """Windows that occur again, of regions that came as text.

    Regions fill suffix arrays of bounded size. Classes of equal windows within one
    are neighbours whose common prefix is long enough. Classes of several arrays
    are merged by binary search in the sorted hashes seen so far.
    """
    key, start, size = (joined(t[c], d) for c, d in (("key", np.int64), ("start", np.uint32), ("size", np.uint16)))
    size = size.astype(np.int64)
    data = np.frombuffer(b"".join(t["text"].to_pylist()), np.uint8)
    lengths = size - 1 + rule.length
    ends = np.cumsum(lengths)
    load = (np.cumsum(lengths + 1) - 1) // (LARGEST - 2 * (1 << 16) - rule.length)
    done, seen, shared = [], np.zeros(0, U), np.zeros(0, U)
    for number in range(int(load[-1]) + 1 if len(load) else 0):
        a, b = np.searchsorted(load, [number, number + 1])
        if a == b:
            continue
        k, s, c, hashes = shard_classes(rule, data[ends[a] - lengths[a] : ends[b - 1]], key[a:b], start[a:b], size[a:b])
        at = np.searchsorted(seen, hashes)
        again = seen[np.minimum(at, len(seen) - 1)] == hashes if len(seen) else np.zeros(len(hashes), bool)
        shared = np.union1d(shared, hashes[again])
        seen = np.sort(np.concatenate((seen, hashes[~again])))
        done.append((k, s, c, hashes))
    goes = []
    for k, s, c, hashes in done:
        at = np.searchsorted(shared, hashes)
        elsewhere = shared[np.minimum(at, len(shared) - 1)] == hashes if len(shared) else np.zeros(len(hashes), bool)
        yes = ((np.bincount(c) > 1) | elsewhere)[c]
        goes.append((k[yes], s[yes]))
    return tuple(np.concatenate(x) for x in zip(*goes)) if goes else (np.zeros(0, np.int64),) * 2


def compare_windows(rule: Rule, groups: int) -> Callable:
    """Step 4: the windows of one part that go, with the intervals known before."""

    def run(t: pa.Table) -> pa.Table:
        has_text, has_hash = t["text"].is_valid().to_numpy(), t["hash"].is_valid().to_numpy()
        known = t.filter(pa.array(~has_text & ~has_hash))
        key, start = (joined(known[c], d) for c, d in (("key", np.int64), ("start", np.uint32)))
        out = [(key, start.astype(np.int64), joined(known["size"], np.uint32).astype(np.int64))]
        for k, s in (repeated_by_hash(rule, t.filter(pa.array(has_hash))), repeated_by_suffixes(rule, t.filter(pa.array(has_text)))):
            s = s.astype(np.int64)
            out.append((k, s, s + rule.length))
        k, a, b = intervals(*[np.concatenate(x) for x in zip(*out)])
        return table(list(by_group(groups, k, a.astype(np.uint32), b.astype(np.uint32))), FOUND)

    return run


def repeats(docs: DataFrame, rule: Rule, finish: Callable, schema: str, by_hash: bool, id_column: str, text_column: str) -> DataFrame:
    """One row per document: ``finish(shard, ids, intervals per document)`` as Arrow arrays of schema."""
    spark = docs.sparkSession
    rows = keyed(docs, id_column, text_column)
    total = text_bytes(rows)
    tasks = spark.sparkContext.defaultParallelism
    buckets = max(tasks, -(-total // (40 * PER_TASK)))
    parts = max(tasks, -(-total // (3 * PER_TASK)))
    groups = prime_from(max(tasks, total // GROUP))
    grp = F.pmod(F.col("key"), F.lit(groups)).cast("int")
    by_doc = rows.withColumn("grp", grp).groupBy("grp")
    regions = rows.select("key", "text").mapInArrow(find_regions(rule, int(buckets)), REGIONS)
    told = regions.groupBy("bucket").applyInArrow(flag_regions(rule, groups, by_hash), FLAGGED)
    offered = by_doc.cogroup(told.groupBy("grp")).applyInArrow(offer_regions(rule, int(parts)), OFFERED)
    found = offered.groupBy("part").applyInArrow(compare_windows(rule, groups), FOUND)

    def close(docs: pa.Table, found: pa.Table) -> pa.Table:
        key, start, stop = (joined(found[c], d) for c, d in (("key", np.int64), ("start", np.uint32), ("stop", np.uint32)))
        key, start, stop = intervals(key, start.astype(np.int64), stop.astype(np.int64))
        keys = docs["key"].to_numpy()
        low, high = per_key(keys, key)
        texts = encoded(docs["text"])
        return finish(docs["id"], texts, [(start[a:b], stop[a:b]) for a, b in zip(low, high)])

    return by_doc.cogroup(found.groupBy("grp")).applyInArrow(close, schema)
