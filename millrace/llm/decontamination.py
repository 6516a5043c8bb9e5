"""Overlap of documents with benchmark items, by winnowing."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rolling import Rolling, merged, mix, ranges, winnow
from .texts import LOWER, NOT_ALNUM, Shard, encoded, keyed, prime_from, shard, shards, text_bytes, word_hashes, words_of

U = np.uint64
SHARD = 1 << 20
GROUP = 8 << 20
SENT = 1 << 20  # fingerprints, 8 bytes each, that may be sent to every task


def salt(n: int) -> np.uint64:
    """Keeps grams of different lengths apart."""
    return U(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def lowered(s: Shard) -> Shard:
    return Shard(s.keys, LOWER[s.data], s.starts, s.lengths)


def fingerprints(codes, first, counts, length: int, gram: int, short: list[int]):
    """(document, word, words covered, fingerprint): winnowed grams of all windows, and all grams of the short lengths."""
    rolling = Rolling(codes)
    parts = []
    grams = rolling.grams(gram)
    owner = winnow(grams, length - gram + 1)
    per_doc = np.maximum(counts - length + 1, 0)
    doc = np.repeat(np.arange(len(first)), per_doc)
    own = owner[ranges(first, per_doc)]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]))) if len(own) else np.zeros(0, bool)
    parts.append((doc[new], own[new], np.full(new.sum(), gram), mix(grams[own[new]])))
    for n in short:
        per_doc = np.maximum(counts - n + 1, 0)
        at = ranges(first, per_doc)
        parts.append((np.repeat(np.arange(len(first)), per_doc), at, np.full(len(at), n), mix(rolling.grams(n)[at] + salt(n))))
    return [np.concatenate(x) for x in zip(*parts)]


def fingerprint_rows(length: int, gram: int, short: list[int], only: np.ndarray | None) -> Callable:
    """Distinct (key, fp) of each document, of these fingerprints alone if they are given."""

    def run(batches):
        for s in shards(batches, SHARD):
            s = lowered(s)
            words = words_of(s, NOT_ALNUM)
            doc, _, _, fp = fingerprints(word_hashes(s.data, words), words.first, words.counts, length, gram, short)
            if only is not None and len(only):
                hit = only[np.minimum(np.searchsorted(only, fp), len(only) - 1)] == fp
                doc, fp = doc[hit], fp[hit]
            elif only is not None:
                doc, fp = doc[:0], fp[:0]
            pair = np.unique(np.stack([doc.astype(U), fp]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(s.keys[pair[0].astype(int)]), pa.array(pair[1].view(np.int64))], names=["key", "fp"])

    return run


def item_rows(length: int, gram: int) -> Callable:
    """Distinct (item, fp) of each benchmark item; an item shorter than a window is one gram."""

    def run(batches):
        for s in shards(batches, SHARD):
            s = lowered(s)
            words = words_of(s, NOT_ALNUM)
            codes = word_hashes(s.data, words)
            doc, _, _, fp = fingerprints(codes, words.first, words.counts, length, gram, [])
            rolling = Rolling(codes)
            few = np.flatnonzero((words.counts > 0) & (words.counts < length))
            own = rolling.spans(words.first[few], words.first[few] + words.counts[few])
            fp = np.concatenate((fp, mix(own + np.array([salt(n) for n in words.counts[few].tolist()], U))))
            doc = np.concatenate((doc, few))
            pair = np.unique(np.stack([doc.astype(U), fp]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(s.keys[pair[0].astype(int)]), pa.array(pair[1].view(np.int64))], names=["item", "fp"])

    return run


def word_lists(s: Shard, words) -> list[list[bytes]]:
    data = s.data.tobytes()
    flat = [data[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]
    return [flat[a : a + n] for a, n in zip(words.first.tolist(), words.counts.tolist())]


def extended(doc: list, seeds, item: list, at_of: dict, length: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``length`` words that the document shares with the item."""
    found, seen = [], {}
    for p, covers, fp in seeds:
        for q in at_of.get(fp, ()):
            if p < seen.get(p - q, 0) or doc[p : p + covers] != item[q : q + covers]:
                continue
            a, b = 0, covers
            while p - a > 0 and q - a > 0 and doc[p - a - 1] == item[q - a - 1]:
                a += 1
            while p + b < len(doc) and q + b < len(item) and doc[p + b] == item[q + b]:
                b += 1
            seen[p - q] = p + b
            if a + b >= min(length, len(item)):
                found.append((p - a, p + b))
    return found


def mark_documents(length: int, gram: int, short: list[int]) -> Callable:
    def run(docs: pa.Table, candidates: pa.Table) -> pa.Table:
        s = lowered(shard(docs["key"].to_numpy(), encoded(docs["text"])))
        words = words_of(s, NOT_ALNUM)
        asked = defaultdict(list)
        for key, item in zip(candidates["key"].to_pylist(), candidates["item"].to_pylist()):
            asked[key].append(item)
        items, first = {}, {}
        for i, item in enumerate(candidates["item"].to_pylist()):
            first.setdefault(item, i)
        if first:
            taken = candidates.take(pa.array(list(first.values())))
            t = lowered(shard(taken["item"].to_numpy(), encoded(taken["item_text"])))
            w = words_of(t, NOT_ALNUM)
            lists, rolling = word_lists(t, w), Rolling(word_hashes(t.data, w))
            for n, (item, name, list_) in enumerate(zip(taken["item"].to_pylist(), taken["item_id"].to_pylist(), lists)):
                a, c = int(w.first[n]), len(list_)
                covers = gram if c >= length else c
                own = rolling.spans(np.arange(a, a + c - covers + 1), np.arange(a + covers, a + c + 1))
                own = mix(own if c >= length else own + salt(c))
                at_of = defaultdict(list)
                for q, fp in enumerate(own.tolist()):
                    at_of[fp].append(q)
                items[item] = (name, list_, at_of)
        out = [[] for _ in range(6)]
        wanted = [i for i, key in enumerate(s.keys.tolist()) if key in asked]
        seeds, lists = defaultdict(list), {}
        if wanted:
            some = Shard(s.keys[wanted], *_cut(s, wanted))
            w = words_of(some, NOT_ALNUM)
            for d, p, covers, fp in zip(*[x.tolist() for x in fingerprints(word_hashes(some.data, w), w.first, w.counts, length, gram, short)]):
                seeds[wanted[d]].append((p - int(w.first[d]), covers, fp))
            lists = dict(zip(wanted, word_lists(some, w)))
        for i, (key, n) in enumerate(zip(s.keys.tolist(), words.counts.tolist())):
            spans, names = [], []
            for item in asked.get(key, ()) if i in lists else ():
                name, words_, at_of = items[item]
                got = extended(lists[i], sorted(seeds[i]), words_, at_of, length)
                if got:
                    spans += got
                    names.append("" if name is None else str(name))
            a, b = merged(*np.array(spans, np.int64).reshape(-1, 2).T)
            hit = int((b - a).sum())
            for column, v in zip(out, (n, hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), a.tolist(), b.tolist())):
                column.append(v)
        return pa.table({"id": docs["id"], "n_words": pa.array(out[0], pa.int64()), "n_hit": pa.array(out[1], pa.int64()),
                         "n_items": pa.array(out[2], pa.int64()), "items_sha256": pa.array(out[3], pa.string()),
                         "contaminated": pa.array([h > 0 for h in out[1]], pa.bool_()),
                         "starts": pa.array(out[4], pa.list_(pa.int64())), "stops": pa.array(out[5], pa.list_(pa.int64())), "key": docs["key"]})

    def _cut(s, wanted):
        lengths = s.lengths[wanted]
        ends = np.cumsum(lengths + 1)
        data = np.full(int(ends[-1]), 10, np.uint8)
        data[ranges(ends - lengths - 1, lengths)] = s.data[ranges(s.starts[wanted], lengths)]
        return data, ends - lengths - 1, lengths

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, gram: int = 6, id_column: str = "doc_id",
                  text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of documents that stand in a window of a benchmark item.

    Words are runs of digits, letters a-z and non-ASCII characters, after A-Z became
    a-z. A window is ``length`` consecutive words of an item; an item with fewer
    words, but not none, is one window. Of each window winnowing keeps the gram of
    ``gram`` words with the least hash, so that document and item choose the same
    gram of any window they share. Fingerprints are joined, and each hit is
    extended to the maximal run of equal words; runs of a window or more count.
    Items shorter than a window are sought by the hash of all their words.

    While the benchmark has at most SENT fingerprints, tasks leave out others before
    the join; otherwise all fingerprints take part. The result is the same.

    Returns per document: the id, n_words, n_hit (words in any shared window),
    n_items, items_sha256 (of the items' ids, as strings, sorted, comma-joined),
    contaminated and the hit intervals as starts and stops. Null and empty texts
    have no words. Documents, and items, that share an id are separate; an item
    without id is listed as the empty string. Empty tables give no rows, or no
    hits; other columns are ignored.
    """
    return mark_rows(keyed(docs, id_column, text_column), benchmark, length, gram, item_column, item_text) \
        .withColumnRenamed("id", id_column).drop("key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10, gram: int = 6, id_column: str = "doc_id", text_column: str = "text",
                      item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without a word in a benchmark window; see ``decontaminate``."""
    rows = keyed(docs, id_column, text_column, whole=True)
    marked = mark_rows(rows.select("key", "id", "text"), benchmark, length, gram, item_column, item_text)
    return rows.join(marked.filter("NOT contaminated").select("key"), "key", "left_semi").select("row.*")


def mark_rows(rows: DataFrame, benchmark: DataFrame, length: int, gram: int, item_column: str, item_text: str) -> DataFrame:
    """``decontaminate`` for rows (key, id, text); returns key and id too."""
    items = keyed(benchmark, item_column, item_text).select(F.col("key").alias("item"), F.col("id").alias("item_id"), F.col("text").alias("item_text"))
    plain = items.select(F.col("item").alias("key"), F.col("item_text").alias("text"))
    prints = plain.mapInArrow(item_rows(length, gram), "item long, fp long").distinct()
    short = sorted(r[0] for r in plain.mapInArrow(_short_lengths(length), "n int").distinct().collect())
    known = prints.select("fp").distinct()
    few = known.limit(SENT + 1).count() <= SENT
    only = np.sort(np.array([r[0] for r in known.collect()], np.int64).view(U)) if few else None
    found = rows.select("key", "text").mapInArrow(fingerprint_rows(length, gram, short, only), "key long, fp long")
    candidates = found.join(prints, "fp").select("key", "item").distinct().join(items, "item")
    groups = prime_from(max(rows.sparkSession.sparkContext.defaultParallelism, text_bytes(rows) // GROUP))
    grp = F.pmod(F.col("key"), F.lit(groups)).cast("int")
    schema = (f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, "
              "contaminated boolean, starts array<long>, stops array<long>, key long")
    return rows.withColumn("grp", grp).groupBy("grp").cogroup(candidates.withColumn("grp", grp).groupBy("grp")) \
        .applyInArrow(mark_documents(length, gram, short), schema)


def _short_lengths(length: int) -> Callable:
    def run(batches):
        for s in shards(batches, SHARD):
            n = words_of(lowered(s), NOT_ALNUM).counts
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(n[(n > 0) & (n < length)]), pa.int32())], names=["n"])

    return run
