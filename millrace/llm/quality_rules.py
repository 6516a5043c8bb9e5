"""Counting rules, and likelihood ratios of n-grams between trusted and raw text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.frame import col, ship_code

from .features import hashed_ngrams, pieces, score_rows
from .rolling import Rolling, cover, mix, ranges
from .texts import BLANK, encoded, word_hashes, words_of

U = np.uint64
ORDERS, BUCKETS = 2, 1 << 18
RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


def per_document(marks: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of marks over each document's stretch."""
    sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return sums[starts + lengths] - sums[starts]


def repeated(doc: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which codes occur more than once within their document."""
    _, where, count = np.unique(mix(codes + doc.astype(U) * U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    return count[where] > 1


def rule_counts(s) -> list[np.ndarray]:
    """The columns of RULES for the documents of a shard."""
    words = words_of(s, BLANK)
    inside = ~BLANK[s.data]
    chars = per_document(inside & STARTS_CHARACTER[s.data], s.starts, s.lengths)
    symbols = per_document(SYMBOL[s.data], s.starts, s.lengths)
    # lines: a document's text is followed by a line end in its shard
    ends = np.flatnonzero(s.data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    has_word = per_document(inside, starts, ends - starts) > 0
    starts, ends = starts[has_word], ends[has_word]
    doc = np.searchsorted(s.starts, starts, "right") - 1
    codes = word_hashes(s.data, type(words)(starts, ends, None, None))
    same = mix(codes + doc.astype(U) * U(0x9E3779B97F4A7C15))
    _, first = np.unique(same, return_index=True)
    again = np.ones(len(same), bool)
    again[first] = False
    dup_lines = np.bincount(doc[again], minlength=len(s.keys))
    count = np.maximum(words.counts - 2, 0)
    at = ranges(words.first, count)
    grams = Rolling(word_hashes(s.data, words)).grams(3)
    hit = at[repeated(np.repeat(np.arange(len(count)), count), grams[at])]
    covered = cover(hit, hit + 3, len(words.starts))
    return [words.counts, chars, symbols, dup_lines, per_document(covered, words.first, words.counts)]


def ngram_counts(docs: DataFrame, trusted: DataFrame, id_column: str, text_column: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every n-gram bucket in trusted documents and in all of them."""
    ship_code(docs.sparkSession)
    ids = trusted.select(col(id_column).alias("id")).filter("id IS NOT NULL").distinct()
    # one plan at every size: trusted ids grow with the corpus, and a merge join holds neither side in memory
    rows = docs.select(col(id_column).alias("id"), col(text_column).cast("string").alias("text")) \
        .join(ids.withColumn("good", F.lit(True)).hint("merge"), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches):
        total, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flags, at = batch.column("good").to_numpy(zero_copy_only=False), 0
            for s in pieces(encoded(batch.column("text"))):
                doc, place = hashed_ngrams(s, ORDERS, BUCKETS)
                total += np.bincount(place, minlength=BUCKETS)
                good += np.bincount(place[flags[at + doc]], minlength=BUCKETS)
                at += len(s.keys)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(good[some]), pa.array(total[some])], names=["bucket", "good", "total"])

    sums = rows.mapInArrow(count, "bucket int, good long, total long").groupBy("bucket").agg(F.sum("good"), F.sum("total")).toPandas().to_numpy(np.int64)
    good, total = np.zeros(BUCKETS), np.zeros(BUCKETS)  # BUCKETS bounds what comes here
    good[sums[:, 0]], total[sums[:, 0]] = sums[:, 1], sums[:, 2]
    return good, total


def log_ratios(good: np.ndarray, total: np.ndarray, prior: float) -> np.ndarray:
    """log p(n-gram | trusted) / p(n-gram | raw); rare n-grams shrink to 0.

    The trusted counts get ``prior`` further observations that follow the raw ones.
    """
    if not good.sum():
        return np.zeros(len(good), np.float32)
    raw = np.maximum(total, 0.5) / np.maximum(total, 0.5).sum()
    return np.log((good + prior * raw) / ((good.sum() + prior) * raw)).astype(np.float32)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = -0.5, prior: float = 10_000.0, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """Counting rules and the n-gram likelihood ratio of every document.

    Words are stretches without blanks. Base rules: n_words, word_chars (code points
    in words), n_symbols (of ``#*$%&|<>``), n_dup_lines (lines with a word that equal
    an earlier one), n_repeat_words (words in 3-word windows that the text has twice
    or more). base_failed: fewer than 50 words, or over half of them repeated.

    ``trusted`` lists the ids of trusted documents, all of which teach the target
    multinomial over hashed uni- and bigrams; all documents teach the raw one. score is a document's mean log-likelihood ratio
    per n-gram, in natural logarithms. kept: not base_failed and score at least
    ``threshold``.

    Null and empty texts have no words and fail. Without trusted documents, and for
    texts without n-grams, the score is 0. Repeated rows are judged each; other
    columns are ignored; an empty table gives no rows.
    """
    good, total = ngram_counts(docs, trusted, id_column, text_column)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(good, total, prior))

    def score(texts):
        out, scores = [], []
        for s in pieces(texts):
            out.append(rule_counts(s))
            doc, place = hashed_ngrams(s, ORDERS, BUCKETS)
            n = np.bincount(doc, minlength=len(s.keys))
            scores.append(np.bincount(doc, ratios.value[place].astype(np.float64), len(s.keys)) / np.maximum(n, 1))
        return [*[pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], pa.array(np.concatenate(scores), pa.float64())]

    scored = score_rows(docs.select(col(id_column), col(text_column)), text_column, score, RULES + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(F.col("row")[id_column].alias(id_column), *[f.split()[0] for f in RULES.split(", ")], failed.alias("base_failed"),
                         (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
