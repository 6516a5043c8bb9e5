"""Hashed n-grams of documents, and scores that are computed row by row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.frame import col, ship_code

from .rolling import Rolling, WORD_BASE, byte_codes, mix, ranges
from .texts import Shard, encoded, shard

U = np.uint64
PIECE = 1 << 20  # bytes of text that are hashed at once
#: 0 blank, 1 letter, digit or non-ASCII, 2 anything else
KIND = np.array([0 if b == 32 or 9 <= b <= 13 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def hashed_ngrams(s: Shard, orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of up to ``orders`` tokens.

    Tokens are runs of letters and digits, or runs of other signs, so that marks
    attached to a word count apart from it. All bigrams of a token and itself are
    one n-gram, whatever the token.
    """
    kind = KIND[s.data]
    new = np.concatenate(([True], kind[1:] != kind[:-1]))
    edge = np.flatnonzero(new)
    ends = np.append(edge[1:], len(kind))
    word = kind[edge] > 0
    starts, ends = edge[word], ends[word]
    codes = Rolling(byte_codes(4)[s.data], WORD_BASE).spans(starts, ends)
    first, last = np.searchsorted(starts, s.starts), np.searchsorted(starts, s.starts + s.lengths)
    rolling = Rolling(codes)
    docs, places = [], []
    for n in range(1, orders + 1):
        count = np.maximum(last - first - n + 1, 0)
        grams = rolling.grams(n)
        if n == 2:
            grams[codes[1:] == codes[:-1]] = 0
        docs.append(np.repeat(np.arange(len(first)), count))
        places.append((mix(grams[ranges(first, count)] + U(n)) % U(buckets)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(places)


def pieces(texts: list[bytes]):
    """The texts in order, as shards of bounded size."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= PIECE or i == len(texts) - 1:
            yield shard(np.arange(at, i + 1), texts[at : i + 1])
            at, held = i + 1, 0


def score_rows(docs: DataFrame, text_column: str, score: Callable[[list[bytes]], list[pa.Array]], schema: str) -> DataFrame:
    """(row, columns of schema): each row as a struct, with what ``score`` makes of its text."""
    ship_code(docs.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("row"), *score(encoded(batch.column("text")))], names=["row", *names])

    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(text_column).cast("string").alias("text"))
    kind = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row")).schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, {schema}")


def held_out(id_: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by folds; false without an id."""
    return F.coalesce(F.crc32(id_.cast("string")) % folds == 0, F.lit(False))
