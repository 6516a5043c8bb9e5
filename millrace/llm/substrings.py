"""Removal of repeated bytes, and of repeated word windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Rule, repeats
from .texts import BLANK, shard, words_of


def id_type(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()


def suffix_array_dedup(docs: DataFrame, length: int = 200, gram: int = 100, id_column: str = "doc_id",
                       text_column: str = "text") -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which also starts elsewhere.

    Bytes are those of the UTF-8 text. Strings never cross documents; overlapping
    occurrences count, all occurrences go, and the input alone is judged. Per-shard
    suffix arrays come from Larsson-Sadakane refinement, common prefixes from
    Kasai's walk, and arrays are merged by binary search. Only text in which a
    winnowed gram of ``gram`` bytes occurs twice enters an array: other text
    cannot hold a repeated string.

    Returns a row per input row: the id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 (of the remaining bytes) and spans, their starts and
    ends as arrays. Null and empty text have 0 bytes and keep the hash of nothing.
    Rows with equal or null ids are separate documents. An empty table gives no
    rows; other columns are ignored.
    """
    kind = id_type(docs, id_column)

    def finish(ids, texts, gone):
        n_removed, digests = [], []
        for text, (start, stop) in zip(texts, gone):
            h, at = hashlib.sha256(), 0
            for a, b in zip(start.tolist(), stop.tolist()):
                h.update(text[at:a])
                at = b
            h.update(text[at:])
            n_removed.append(int((stop - start).sum()))
            digests.append(h.hexdigest())
        return pa.table({id_column: ids, "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "n_spans": pa.array([len(a) for a, _ in gone], pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
                         "starts": pa.array([a for a, _ in gone], pa.list_(pa.int64())), "stops": pa.array([b for _, b in gone], pa.list_(pa.int64()))})

    schema = f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>"
    return repeats(docs, Rule(length, gram, None, False), finish, schema, False, id_column, text_column)


def substring_dedup(docs: DataFrame, length: int = 20, gram: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove every word that a window covers whose words also start earlier.

    A window is ``length`` consecutive words (stretches without blanks, unchanged)
    of one document; earlier means a smaller id, or the same document and an
    earlier word. Windows whose winnowed gram of ``gram`` words occurs once in the
    corpus cannot repeat and are not sent. Regions that are equal as a whole are
    settled by their hashes; only windows of one of each kind among regions that
    share a gram but differ get a Rabin-Karp hash. Hashes are sorted and counted
    within each bucket, and later occurrences merge into maximal intervals.

    Returns a row per input row: the id, n_words, n_removed, kept_sha256 (of the
    kept words, joined by a blank), kept (those words) and the removed intervals as
    starts and stops. Null text has no words. Rows that share an id are separate
    documents, in the order of their texts; a null id is before all others. An
    empty table gives no rows; other columns are ignored.
    """
    kind = id_type(docs, id_column)

    def finish(ids, texts, gone):
        s = shard(np.zeros(len(texts)), texts)
        w = words_of(s, BLANK)
        data = s.data.tobytes()
        n_removed, digests, kept = [], [], []
        for d, (start, stop) in enumerate(gone):
            a, b = w.first[d], w.first[d] + w.counts[d]
            words = [data[x:y] for x, y in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist())]
            for x, y in zip(start[::-1].tolist(), stop[::-1].tolist()):
                del words[x:y]
            text = b" ".join(words)
            kept.append(text.decode())
            digests.append(hashlib.sha256(text).hexdigest())
            n_removed.append(int((stop - start).sum()))
        return pa.table({id_column: ids, "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.string()),
                         "starts": pa.array([a for a, _ in gone], pa.list_(pa.int64())), "stops": pa.array([b for _, b in gone], pa.list_(pa.int64()))})

    schema = f"`{id_column}` {kind}, n_words long, n_removed long, kept_sha256 string, kept string, starts array<long>, stops array<long>"
    return repeats(docs, Rule(length, gram, BLANK, True), finish, schema, True, id_column, text_column)
