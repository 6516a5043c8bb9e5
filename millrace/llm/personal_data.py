"""Personal data: base patterns, and contexts that are learnt from what they find."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.frame import settle

from .rolling import Rolling
from .texts import BLANK, LOWER, Shard, encoded, keyed, shard, word_hashes, words_of

U = np.uint64
PIECE = 1 << 20
SENT = 1 << 20  # contexts, 8 bytes each, that may be sent to every task
KINDS = ("email", "ip", "card", "phone")
LEARNT = "context"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IDENTIFIER = np.isin(np.arange(256), list(b"0123456789@"))
SPAN = "struct<kind:string,start:int,stop:int>"
SPOT = "struct<context:bigint,instance:bigint,seed:boolean,start:int,stop:int>"
ENTITIES = f"key long, n_email long, n_ip long, n_card long, n_phone long, spans array<{SPAN}>, spots array<{SPOT}>"


def emails(text: str):
    """Leftmost, non-overlapping; the local part is looked for backwards from each @."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, stop, kind number) of the base entities, by start and kind."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() <= 60 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def contexts(s: Shard):
    """Words of a shard and, for each, the hash of the two words before it in its document (0 without)."""
    low = Shard(s.keys, LOWER[s.data], s.starts, s.lengths)
    words = words_of(low, BLANK)
    codes = word_hashes(low.data, words)
    pairs = Rolling(codes).grams(2)
    before = np.zeros(len(codes), U)
    before[2:] = pairs[: max(len(codes) - 2, 0)]
    before[words.first[words.counts > 0]] = 0
    before[words.first[words.counts > 1] + 1] = 0
    return words, codes, before


def text_pieces(batches):
    for batch in batches:
        keys, texts = batch.column("key").to_pylist(), encoded(batch.column("text"))
        at = held = 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= PIECE or i == len(texts) - 1:
                yield shard(keys[at : i + 1], texts[at : i + 1]), texts[at : i + 1]
                at, held = i + 1, 0


def find_entities(batches):
    """Base entities of each document, and the spots that contexts are learnt from or applied to.

    A spot is a base entity, or a word with a digit or @ that touches none, with the
    two words before it. The spot of an entity is the word in which it begins.
    """
    for s, texts in text_pieces(batches):
        words, codes, before = contexts(s)
        marks = np.concatenate(([0], np.cumsum(IDENTIFIER[s.data])))
        telling = np.flatnonzero((marks[words.ends] > marks[words.starts]) & (before != 0))
        rows = []
        for d, raw in enumerate(texts):
            text = raw.decode()
            spans = base_spans(text)
            first, n, base = int(words.first[d]), int(words.counts[d]), int(s.starts[d])
            a, b = np.searchsorted(telling, [first, first + n])
            spots = []
            if b > a:
                mine = telling[a:b]
                ascii_ = len(text) == len(raw)
                points = None if ascii_ else np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                starts, stops = words.starts[mine] - base, words.ends[mine] - base
                if not ascii_:
                    starts, stops = points[starts] - 1, points[stops - 1]
                edge = [x for x, _, _ in spans]
                reach = np.maximum.accumulate([y for _, y, _ in spans]).tolist() if spans else []
                for j, x, y in zip(mine.tolist(), starts.tolist(), stops.tolist()):
                    before_word, in_word = bisect_left(edge, x) - 1, bisect_left(edge, y) - 1
                    if not (before_word >= 0 and reach[before_word] > x):
                        spots.append((before[j], codes[j], in_word > before_word, x, y))
            counts = np.bincount([k for _, _, k in spans], minlength=4).tolist() if spans else [0] * 4
            rows.append({"key": int(s.keys[d]), **dict(zip(("n_email", "n_ip", "n_card", "n_phone"), counts)),
                         "spans": [{"kind": KINDS[k], "start": x, "stop": y} for x, y, k in spans],
                         "spots": [{"context": int(c.view(np.int64)), "instance": int(i.view(np.int64)), "seed": z, "start": x, "stop": y}
                                   for c, i, z, x, y in spots]})
        yield pa.RecordBatch.from_pylist(rows, schema=ENTITY_ARROW)


ENTITY_ARROW = pa.schema([
    *[(n, pa.int64()) for n in ("key", "n_email", "n_ip", "n_card", "n_phone")],
    ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))),
    ("spots", pa.list_(pa.struct([("context", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32())])))])


def count_contexts(only: np.ndarray | None) -> Callable:
    """How often each context occurs in a task's texts, of these contexts alone if they are given."""

    def run(batches):
        for s, _ in text_pieces(batches):
            _, _, before = contexts(s)
            found = before[before != 0]
            if only is not None:
                found = found[only[np.minimum(np.searchsorted(only, found), len(only) - 1)] == found] if len(only) else found[:0]
            context, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(n)], names=["context", "n"])

    return run


def reachable_edges(spots: DataFrame, support: int, precision: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(context, instance, n, seed) of the graph, and its contexts that may become reliable.

    A context may if instances that seeds lead to are ``support`` or more and make up
    ``precision`` of its spots: trust is at most 1, and the spots at most all of its
    occurrences, so that none is left out. Contexts of fewer instances never may.
    An instance is a seed wherever it stands if it is one anywhere.
    """
    edges = settle(spots.groupBy("context", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    seeds = edges.filter("seed").select("instance", F.lit(True).alias("seed")).distinct()
    wide = edges.groupBy("context").agg(F.count("*").alias("instances")).filter(F.col("instances") >= support).select("context")
    edges = settle(edges.drop("seed").join(wide, "context").join(seeds, "instance", "left").withColumn("seed", F.coalesce("seed", F.lit(False))))
    flagged = edges.withColumn("reached", F.col("seed"))
    size = 0
    for _ in range(rounds):
        hit = F.col("reached").cast("int")
        able = settle(flagged.groupBy("context").agg(F.sum(hit).alias("support"), (F.sum(hit * F.col("n")) / F.sum("n")).alias("share"))
                      .filter((F.col("support") >= support) & (F.col("share") >= precision)).select("context"))
        known, size = size, able.count()
        if size == known:
            break
        reached = edges.join(able, "context", "left_semi").select("instance", F.lit(True).alias("found")).distinct()
        flagged = edges.join(reached, "instance", "left").withColumn("reached", F.col("seed") | F.coalesce("found", F.lit(False)))
    return edges, able


def reliable_contexts(edges: DataFrame, totals: DataFrame, support: int, precision: float, rounds: int) -> DataFrame:
    """Contexts whose occurrences are mostly trusted instances.

    Trust flows over the graph of contexts and instances: seeds have 1; a context has
    the trusted share of all its occurrences in the corpus; another instance has the
    chance that one of its contexts is right. Few rounds suffice, as trust only grows.
    """
    edges = settle(edges.join(totals, "context"))
    trust = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    for _ in range(rounds):
        scores = edges.join(trust, "instance").groupBy("context", "total").agg(
            (F.sum(F.col("n") * F.col("trust")) / F.col("total")).alias("precision"),
            F.sum((F.col("trust") >= precision).cast("int")).alias("support"))
        good = settle(scores.filter((F.col("support") >= support) & (F.col("precision") >= precision)).select("context", "precision"))
        trust = edges.join(good, "context", "left").groupBy("instance").agg(F.greatest(
            F.max(F.col("seed").cast("double")),
            1 - F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("precision", F.lit(0.0)), F.lit(1e-9)))))).alias("trust"))
    return good.select("context")


def personal_data(docs: DataFrame, support: int = 5, precision: float = 0.8, rounds: int = 3, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """Personal data in every document.

    Base entities, leftmost and non-overlapping per kind: e-mail addresses, IPv4
    addresses with parts up to 255, cards of 12 to 19 digits that pass Luhn, and
    international phone numbers of 9 to 15 digits. They seed contexts, the two words
    before an entity. A context counts as reliable if at least ``support`` different
    trusted instances follow it and make up ``precision`` of all its occurrences in
    the corpus; words with a digit or @ that follow it elsewhere then are personal
    data of kind ``context``, and trust other contexts in turn, for ``rounds`` rounds.

    Returns per document: the id, n_email, n_ip, n_card, n_phone, base_sha256 (of
    the base spans as kind:start:stop, by start and kind, comma-joined, in code
    points), spans (all spans so joined, learnt ones after base ones that start
    alike) and entities (all spans as an array). Null and empty texts have none.
    Rows that share an id are separate documents; other columns are ignored; an
    empty table gives no rows.
    """
    rows = keyed(docs, id_column, text_column)
    found = settle(rows.select("key", "text").mapInArrow(find_entities, ENTITIES))
    spots = found.select("key", F.explode("spots").alias("spot")).select("key", "spot.*")
    edges, able = reachable_edges(spots, support, precision, rounds)
    few = able.limit(SENT + 1).count() <= SENT
    only = np.sort(np.array([r[0] for r in able.collect()], np.int64).view(U)) if few else None
    if few and not len(only):
        learnt = None
    else:
        totals = rows.select("key", "text").mapInArrow(count_contexts(only), "context long, n long").join(able, "context", "left_semi") \
            .groupBy("context").agg(F.sum("n").alias("total"))
        good = reliable_contexts(edges, totals, support, precision, rounds)
        learnt = spots.filter("NOT seed").join(good, "context").groupBy("key").agg(
            F.collect_list(F.struct(F.lit(LEARNT).alias("kind"), "start", "stop")).alias("learnt"))
    out = found.join(learnt, "key", "left") if learnt is not None else found.withColumn("learnt", F.expr(f"cast(null as array<{SPAN}>)"))
    kinds = f"array({', '.join(repr(k) for k in (*KINDS, LEARNT))})"
    by = f"(a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE cast(array_position({kinds}, a.kind) - array_position({kinds}, b.kind) as int) END"
    listed = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"
    out = out.withColumn("entities", F.expr(f"array_sort(concat(spans, coalesce(learnt, array())), {by})")) \
        .select("key", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.expr(listed.format("spans")), 256).alias("base_sha256"),
                F.expr(listed.format("entities")).alias("spans"), "entities")
    return rows.select("key", F.col("id").alias(id_column)).join(out, "key").drop("key")
