"""Stretches of words that repeat with a period, and texts collapsed to one period each."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.frame import col, ship_code

from .recompression import compress, extend
from .rolling import cover, ranges
from .texts import BLANK, Shard, Words, shards, word_hashes, words_of

SHARD_BYTES = 2 << 20  # of text that shares a grammar; a longer text has one of its own
CANDIDATES = 1 << 21  # places on the grid that are tried at once
RUN = "struct<start:long,length:long,period:long>"


def grid(counts: np.ndarray, exponent: int):
    """(document, place, period) in chunks: for every period q the places 0, (exponent - 1) q, 2 (exponent - 1) q, ...

    Of a stretch of exponent * q words with period q, at least (exponent - 1) * q
    neighbouring words equal the one q further, so one of them is on the grid.
    """
    periods = counts // exponent
    doc = np.repeat(np.arange(len(counts)), periods)
    q = ranges(np.ones(len(counts), np.int64), periods)
    steps = (counts[doc] - 1 - q) // ((exponent - 1) * q) + 1
    cuts = np.searchsorted(np.cumsum(steps), np.arange(CANDIDATES, int(steps.sum()) + CANDIDATES, CANDIDATES), "right")
    for a, b in zip(np.concatenate(([0], cuts + 1)), np.minimum(cuts + 1, len(q))):
        if a < b:
            of = np.repeat(np.arange(a, b), steps[a:b])
            yield doc[of], ranges(np.zeros(b - a, np.int64), steps[a:b]) * (exponent - 1) * q[of], q[of]


def runs_of(s: Shard, w: Words, min_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops (in words of the shard) and least periods of all runs, by start and period.

    A separator before, between and behind the documents, each unlike anything else,
    keeps extensions within their document.
    """
    none = np.zeros(0, np.int64)
    docs = len(w.counts)
    names = np.unique(word_hashes(s.data, w), return_inverse=True)[1]
    cuts = np.append(w.first, len(names))
    sequence = np.insert(names, cuts, len(names) + np.arange(docs + 1))
    grammar, found = None, [(none, none, none)]
    for doc, place, q in grid(np.where(w.counts >= min_length, w.counts, 0), exponent):
        x = w.first[doc] + doc + 1 + place
        hit = sequence[x] == sequence[x + q]
        if hit.any():
            grammar = grammar or compress(sequence)
            x, q, doc = x[hit], q[hit], doc[hit]
            start = x - extend(grammar, x - 1, x + q - 1, -1)
            stop = x + q + extend(grammar, x, x + q, 1)
            long = stop - start >= np.maximum(min_length, exponent * q)
            found.append(tuple(a[long] for a in (start - doc - 1, stop - doc - 1, q)))
    start, stop, q = (np.concatenate(a) for a in zip(*found))
    order = np.lexsort((q, stop, start))  # multiples of a period find the same stretch
    start, stop, q = start[order], stop[order], q[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])))[: len(start)]
    start, stop, q = start[new], stop[new], q[new]
    order = np.lexsort((q, start))
    return start[order], stop[order], q[order]


def kept_texts(s: Shard, w: Words, dropped: np.ndarray) -> pa.Array:
    """For each document its words that are not dropped, joined by a blank."""
    kept = np.flatnonzero(~dropped)
    mask = cover(w.starts[kept], w.ends[kept] + 1, len(s.data) + 1)[:-1]  # each word with the separator behind it
    doc = np.searchsorted(w.first + w.counts, kept, "right")
    final = np.concatenate((doc[1:] != doc[:-1], [True]))[: len(kept)]
    mask[w.ends[kept[final]]] = False
    data = np.where(BLANK[s.data], np.uint8(32), s.data)[mask]
    ends = np.concatenate(([0], np.cumsum(mask)))[np.append(s.starts, len(s.data))].astype(np.int32)
    return pa.StringArray.from_buffers(len(s.starts), pa.py_buffer(ends), pa.py_buffer(data))


def periodic_runs(docs: DataFrame, min_length: int = 6, exponent: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All maximal periodic stretches of words of each document, and its text without the repetitions.

    Words are stretches without blanks. A run is a stretch with least period q (words
    q apart are identical) of at least ``min_length`` words and ``exponent`` (2 or
    more) periods that no neighbouring word extends with that period. Candidates lie
    on a harmonic grid: for every period q, every (exponent - 1) q-th word that
    equals the one q further. Their exact extensions both ways come from a run-length
    grammar of the words, made by recompression. Words are compared by 64-bit hashes.

    Returns a row per input row: the id, n_words, runs (start, length and period in
    words, by start and then period), best (the run with the greatest length by
    period, of equals the first; null without runs) and collapsed, the words joined
    by a blank of which those are left out that a run holds after its first q. Null
    text has no words. Rows are independent: equal and missing ids are no matter. An
    empty table gives no rows; other columns are ignored.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    ship_code(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, at = batch.column("id"), 0
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["key", "text"])
            for s in shards([rows], SHARD_BYTES):
                w = words_of(s, BLANK)
                start, stop, q = runs_of(s, w, min_length, exponent)
                doc = np.searchsorted(w.first + w.counts, start, "right")
                dropped = cover(start + q, stop, len(w.starts))
                fields = [pa.array(x) for x in (start - w.first[doc], stop - start, q)]
                flat = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
                offsets = np.searchsorted(doc, np.arange(len(w.counts) + 1)).astype(np.int32)
                best: list[int | None] = [None] * len(w.counts)
                for i in range(len(start)):
                    b, ratio = best[doc[i]], Fraction(int(stop[i] - start[i]), int(q[i]))
                    if b is None or ratio > Fraction(int(stop[b] - start[b]), int(q[b])):
                        best[doc[i]] = i
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(w.counts)), pa.array(w.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat),
                     flat.take(pa.array(best, pa.int64())), kept_texts(s, w, dropped)],
                    names=["id", "n_words", "runs", "best", "collapsed"])
                at += len(w.counts)

    rows = docs.select(col(id_column).alias("id"), col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string") \
        .withColumnRenamed("id", id_column)
