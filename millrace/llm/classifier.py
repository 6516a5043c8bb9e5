"""Quality scores by logistic regression on hashed n-grams, trained online."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.frame import col, ship_code

from .features import hashed_ngrams, held_out, pieces, score_rows
from .texts import encoded

U = np.uint64
ORDERS, BUCKETS = 2, 1 << 18
FIT_ROWS = 6000


def vectors(texts: list[bytes]):
    """(document, bucket, value): damped n-gram counts of each document, of length 1."""
    at = 0
    for s in pieces(texts):
        doc, place = hashed_ngrams(s, ORDERS, BUCKETS)
        cell, count = np.unique(doc * BUCKETS + place, return_counts=True)
        doc, value = cell // BUCKETS, 1 + np.log(count)
        norm = np.sqrt(np.bincount(doc, value**2, len(s.keys)))
        yield at, len(s.keys), doc, cell % BUCKETS, value / norm[doc]
        at += len(s.keys)


def follow_the_leader(rows, alpha=2.0, beta=1.0, l1=0.02, l2=0.0, epochs=4) -> np.ndarray:
    """FTRL-proximal weights of (places, values, label) rows; the last weight is the bias.

    ``rows`` is called once per epoch. Each step adapts its rate to the gradients a
    weight has seen and keeps weights at zero whose sum of gradients stays below l1.
    """
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        for places, values, label in rows():
            zi, ni = z[places], n[places]
            w = np.where(np.abs(zi) <= l1, 0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            z[places] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[places] += g * g
    return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def train(t: pa.Table) -> pa.Table:
    """Weights of packed vectors (id, label, vector), taken in a fixed shuffled order of ids.

    Vectors are unpacked one at a time, as all of them take several times what the
    packed ones do.
    """
    order = np.argsort((t["id"].to_numpy() * 2654435761 + 12345) % 2**31, kind="stable").tolist()
    packed, labels = t["vector"], t["label"].to_pylist()

    def rows():
        for i in order:
            b = packed[i].as_py()
            places = np.frombuffer(b, np.int32, len(b) // 8).astype(np.int64)
            yield np.append(places, BUCKETS), np.append(np.frombuffer(b, np.float32, offset=len(b) // 2), 1.0), labels[i]

    return pa.table({"weights": pa.array([follow_the_leader(rows).tobytes()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
        fit_rows: int = FIT_ROWS) -> np.ndarray | None:
    """Weights learnt from up to ``fit_rows`` labelled documents outside the held-out fold.

    The rows are the first by a hash of their id; of several labels of an id the
    least counts, rows without a label do not. None if no row is left.
    """
    ship_code(docs.sparkSession)
    chosen = (labels.select(col(id_column).alias("id"), col(label_column).cast("int").alias("label"))
              .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
              .groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    rows = docs.select(col(id_column).alias("id"), col(text_column).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def sparse(batches):
        for batch in batches:
            out = [[], [], []]
            labels, ids = batch.column("label").to_numpy(), batch.column("id").to_pylist()
            for at, n, doc, place, value in vectors(encoded(batch.column("text"))):
                cuts = np.searchsorted(doc, np.arange(n + 1))
                for d in range(n):
                    a, b = cuts[d], cuts[d + 1]
                    out[0].append(ids[at + d])
                    out[1].append(float(labels[at + d] > 0))
                    out[2].append(place[a:b].astype(np.int32).tobytes() + value[a:b].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.binary())],
                                             names=["id", "label", "vector"])

    one = rows.withColumn("id", F.col("id").cast("long")).mapInArrow(sparse, "id long, label double, vector binary") \
        .withColumn("all", F.lit(1)).groupBy("all").applyInArrow(train, "weights binary").first()
    return np.frombuffer(one[0], np.float32) if one else None


def quality_scores(docs: DataFrame, weights: np.ndarray | None, text_column: str = "text") -> DataFrame:
    """(row, score): the probability of a good label for every row, from its whole text.

    Without weights every score is 0.5. Null and empty texts score by the bias alone.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(np.zeros(BUCKETS + 1, np.float32) if weights is None else weights)

    def score(texts):
        w, out = broadcast.value, []
        for _, n, doc, place, value in vectors(texts):
            out.append(np.bincount(doc, w[place] * value, n) + w[BUCKETS])
        return [pa.array(1 / (1 + np.exp(-np.concatenate(out).astype(np.float64))), pa.float64())]

    return score_rows(docs, text_column, score, "score double")


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text",
                       label_column: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every document with a classifier learnt from the labelled ones.

    Features are hashed uni- and bigrams of tokens; the learner is logistic
    regression with follow-the-regularised-leader updates on at most ``fit_rows``
    labelled rows, none of them in the held-out fold (crc32 of the id as text
    divisible by 5). Labels, ids and other columns are no input of a score.

    Returns per row: the id, held_out, score (0 to 1) and predicted (1 from the
    threshold on). Null and empty texts score by the bias; without any label every
    score is 0.5. Repeated rows are scored each; a null id is not held out.
    """
    weights = fit(docs, labels, id_column, text_column, label_column, fit_rows)
    scored = quality_scores(docs.select(col(id_column), col(text_column)), weights, text_column)
    id_ = F.col("row")[id_column]
    return scored.select(id_.alias(id_column), held_out(id_).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text",
                     label_column: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that ``quality_classifier`` predicts to be good."""
    weights = fit(docs, labels, id_column, text_column, label_column, fit_rows)
    return quality_scores(docs, weights, text_column).filter(F.col("score") >= threshold).select("row.*")
