"""Rows of text as arrays: keys, shards, words, and packed columns between stages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.frame import col, settle, ship_code

from .rolling import Rolling, WORD_BASE, byte_codes

#: Bytes that separate words: blanks and line ends; or everything but digits, small letters and non-ASCII.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", whole: bool = False) -> DataFrame:
    """Rows as (key, id, text), where key is a long that identifies the row; with ``whole`` also row, all columns as a struct.

    The id itself is the key while ids are integers, present and unique, which is
    counted first. Otherwise rows are numbered in the order of id and text (nulls
    first) and written to the shared folder, so that the numbers cannot change;
    rows that share an id are separate documents.
    """
    ship_code(docs.sparkSession)
    columns = ["id", "text", *(["row"] if whole else [])]
    row = F.struct(*[col(c) for c in docs.columns]).alias("row")
    rows = docs.select(col(id_column).alias("id"), col(text_column).cast("string").alias("text"), row).select(*columns)
    if isinstance(rows.schema["id"].dataType, T.IntegralType):
        odd = rows.groupBy("id").count().filter("id IS NULL OR count > 1").limit(1)
        if odd.isEmpty():
            return rows.select(F.col("id").cast("long").alias("key"), *columns)
    return settle(rows.orderBy("id", "text").select(F.monotonically_increasing_id().alias("key"), *columns))


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


@dataclass
class Shard:
    """Some documents as one byte array, a line end after each."""

    keys: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def shard(keys, texts: list[bytes]) -> Shard:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return Shard(np.asarray(keys, np.int64), data, ends - lengths - 1, lengths)


def encoded(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def shards(batches, size: int):
    """Documents of Arrow batches (key, text) in shards of about this many bytes."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), encoded(batch.column("text"))):
            keys.append(key)
            texts.append(text)
            held += len(text)
            if held >= size:
                yield shard(keys, texts)
                keys, texts, held = [], [], 0
    if keys:
        yield shard(keys, texts)


@dataclass
class Words:
    """The words of a shard: places in its bytes, and how many each document has."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each document, its first word
    counts: np.ndarray


def words_of(s: Shard, separators: np.ndarray) -> Words:
    inside = ~separators[s.data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(starts, s.starts)
    last = np.searchsorted(starts, s.starts + s.lengths)
    return Words(starts, ends, first, last - first)


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    return Rolling(byte_codes(2)[data], WORD_BASE).spans(w.starts, w.ends)


def planes(a: np.ndarray) -> bytes:
    """An integer array with equal bytes side by side, which Spark's codec then shrinks."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def joined(column, dtype) -> np.ndarray:
    """All packed arrays of an Arrow column, one after the other."""
    parts = [unplanes(b, dtype) for b in column.to_pylist() if b]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def split_by(part: np.ndarray, *arrays: np.ndarray):
    """(part, arrays) for each part number, each in the given order."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    pieces = [np.split(a[order], cuts) for a in arrays]
    for i, p in enumerate(part[np.concatenate(([0], cuts)).astype(int)] if len(part) else []):
        yield int(p), [x[i] for x in pieces]


def prime_from(n: int) -> int:
    """The least prime that is not below n; ids spread evenly over its remainders."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n
