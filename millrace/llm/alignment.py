"""Links between the tokens that two tokenizers make of the same texts."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from millrace.frame import col, shared_folder, ship_code

from .rolling import ranges
from .texts import encoded, joined, planes, unplanes

BLOCK_BYTES = 16 << 20  # of text whose documents share a list of pairs
AT_ONCE = 1 << 20  # bytes of text that are aligned at once
LINKS = 1 << 21  # links that are expanded at once
REMEMBERED, LONGEST = 120_000, 64  # pieces in each of two generations whose ids a worker keeps, and their characters
# Fixed value: how the byte-level tokenizer parts a text, so that a blank before a sign begins a part.
BYTE_LEVEL = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
#: Single blanks within text: both kinds of tokenizers begin a token there.
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevelTokens:
    """A byte-level BPE of a tokenizers file; special tokens in a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        plan = json.loads(self.tokenizer.to_str())
        parts = plan.get("pre_tokenizer") or {}
        self.parts_at_blanks = plan.get("normalizer") is None and all(parts.get(k) == v for k, v in BYTE_LEVEL.items())
        byte, names = byte_of_character(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.spelt = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.spelt[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class PieceTokens:
    """A sentencepiece model, which puts a blank before each text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        self.spelt = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.parts_at_blanks = not any("▁" in p.lstrip("▁") for p in names)  # then no merge reaches over a blank

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Both tokenizers of a worker, with the ids of pieces of text that it remembers.

    Texts are cut at CUT where both tokenizers part them anyway; each distinct piece
    is then encoded once while it is remembered.
    """

    def __init__(self, a_path: str, b_path: str):
        self.sides = ByteLevelTokens(a_path), PieceTokens(b_path)
        self.cuts = all(s.parts_at_blanks for s in self.sides)
        self.spelt = [np.array([*s.spelt, None], object)[:-1] for s in self.sides]
        self.sizes = [np.array([len(b) for b in s.spelt]) for s in self.sides]
        self.young: list[dict] = [{}, {}]
        self.old: list[dict] = [{}, {}]
        self.odd: set[str] = set()  # pieces that a side does not spell as they stand
        #: Each id as text, with what may follow it in the list of groups.
        self.written = [{end: np.array([f"{i}{end}" for i in range(len(s.spelt))], object) for end in ends} for s, ends in zip(self.sides, (",|", ",;"))]

    def ids(self, texts: list[bytes]) -> list[list[np.ndarray]]:
        """Per side the ids of each text; none for a text that is empty or that a side does not spell as it stands."""
        pieces = [CUT.split(t.decode()) if self.cuts else [t.decode()] for t in texts]
        if len(self.young[0]) > REMEMBERED:
            self.young, self.old = [{}, {}], self.young
            self.odd &= self.old[0].keys()
        fresh = set().union(*pieces) - self.young[0].keys()
        again = fresh & self.old[0].keys()
        for young, old in zip(self.young, self.old):
            young.update({p: old[p] for p in again})
        self.learn(fresh - again)
        none = np.zeros(0, "<i4")
        out = [[np.frombuffer(b"".join(map(known.__getitem__, c)), "<i4") for c in pieces] for known in self.young]
        for known in self.young:
            for p in fresh:
                if len(p) > LONGEST:
                    del known[p]
        for i, (text, c) in enumerate(zip(texts, pieces)):
            if not text or (not self.odd.isdisjoint(c) and any(self.spell(k, ids[i]) != b" " + text for k, ids in enumerate(out))):
                out[0][i] = out[1][i] = none
        return out

    def spell(self, side: int, ids: np.ndarray) -> bytes:
        return b"".join(self.spelt[side][ids].tolist())

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces, many at a time as one text where CUT would part them again."""
        plain = [p for p in pieces if self.cuts and p and not p[0].isspace() and not p[-1].isspace()]
        rest = list(pieces.difference(plain))
        groups = [plain[at : at + 200] for at in range(0, len(plain), 200)]
        for k, (side, size, known) in enumerate(zip(self.sides, self.sizes, self.young)):
            alone = rest.copy()
            for at in range(0, len(groups), 16):
                some = groups[at : at + 16]
                whole = [" ".join(g) for g in some]
                for group, text, ids in zip(some, whole, side.encode(whole)):
                    flat = np.array(ids, "<i4")
                    if self.spell(k, flat) == f" {text}".encode():
                        ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in group]) + np.arange(1, len(group) + 1)
                        raw, cuts = flat.tobytes(), (4 * np.searchsorted(np.cumsum(size[flat]), ends) + 4).tolist()
                        known.update(zip(group, [raw[x:y] for x, y in zip([0, *cuts], cuts)]))
                    else:  # a piece is not spelt as it stands
                        alone += group
            for at in range(0, len(alone), 1024):
                some = alone[at : at + 1024]
                for p, ids in zip(some, side.encode(some)):
                    flat = np.array(ids, "<i4")
                    known[p] = flat.tobytes()
                    if p and self.spell(k, flat) != f" {p}".encode():
                        self.odd.add(p)


#: Aligners of this worker process by the paths of their tokenizers.
ALIGNERS: dict[tuple[str, str], Aligner] = {}


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of two ways to cut the same bytes into tokens of these sizes.

    All tokens are sorted by start. A group breaks where a start reaches the greatest
    end so far: there both sides end a token.
    """
    ends = np.concatenate((np.cumsum(a_sizes), np.cumsum(b_sizes)))
    starts = ends - np.concatenate((a_sizes, b_sizes))
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.concatenate(([False], starts[order][1:] >= reach[:-1]))[: len(order)])
    return group[: len(a_sizes)], group[len(a_sizes) :]


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs or what its weights add up to."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def linked(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, doc_of: np.ndarray, a_kinds: int,
           b_kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and id pair as one number, document * a_kinds * b_kinds + a * b_kinds + b, in order, and its links.

    Equal ids of a group count as one with a weight, so that what is expanded is
    bounded by the distinct ids of a group, and is expanded some links at a time.
    """
    a_keys, a_times = counted(a_group * a_kinds + a)
    b_keys, b_times = counted(b_group * b_kinds + b)
    first = np.searchsorted(b_keys // b_kinds, np.arange(len(doc_of) + 1))
    group = a_keys // a_kinds
    lengths = first[group + 1] - first[group]
    upto, keys, weights, at = np.cumsum(lengths), [], [], 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS, "right")))
        x = np.repeat(np.arange(at, to), lengths[at:to])
        y = ranges(first[group[at:to]], lengths[at:to])
        key = (doc_of[group[x]] * a_kinds + a_keys[x] % a_kinds) * b_kinds + b_keys[y] % b_kinds
        for part, got in zip((keys, weights), counted(key, a_times[x] * b_times[y])):
            part.append(got)
        at = to
    return counted(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *weights]))


@dataclass
class Aligned:
    """Some documents: counts per document (n_a, n_b, n_groups, n_links), groups as text, and their pairs."""

    counts: list[np.ndarray]
    groups: list[str]
    pairs: np.ndarray
    links: np.ndarray
    cuts: np.ndarray  # where each document's pairs begin


def align(aligner: Aligner, texts: list[bytes]) -> Aligned:
    a_ids, b_ids = aligner.ids(texts)
    n_a, n_b = (np.array([len(i) for i in side], np.int64) for side in (a_ids, b_ids))
    a, b = (np.concatenate([np.zeros(0, "<i4"), *side]).astype(np.int64) for side in (a_ids, b_ids))
    a_group, b_group = coalesce(aligner.sizes[0][a], aligner.sizes[1][b])
    kinds = [len(s) for s in aligner.sizes]
    n = int(a_group[-1]) + 1 if len(a) else 0
    a_in, b_in = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    a_first, b_first = (np.concatenate(([0], np.cumsum(x))) for x in (a_in, b_in))
    doc_of = np.searchsorted(np.cumsum(n_a), a_first[:-1], "right")
    upto = np.searchsorted(doc_of, np.arange(len(texts) + 1))
    n_links = np.diff(np.concatenate(([0], np.cumsum(a_in * b_in)))[upto])
    text = np.empty(len(a) + len(b), object)
    for ids, group, others, nth, written in ((a, a_group, b_first[a_group], a_first, aligner.written[0]),
                                             (b, b_group, a_first[b_group + 1], b_first, aligner.written[1])):
        (mid, final), at = written.values(), np.arange(len(ids)) + others
        text[at] = mid[ids]
        closing = nth[1:] - 1
        text[at[closing]] = final[ids[closing]]
    edges = np.concatenate(([0], np.cumsum(n_a + n_b)))
    groups = ["".join(text[x:y].tolist())[:-1] for x, y in zip(edges, edges[1:])]
    keys, links = linked(a, b, a_group, b_group, doc_of, *kinds)
    doc, pairs = np.divmod(keys, kinds[0] * kinds[1])
    return Aligned([n_a, n_b, np.diff(upto), n_links], groups, pairs, links, np.searchsorted(doc, np.arange(len(texts) + 1)))


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def block_rows(block: int, ids: pa.Array, parts: list[Aligned], keep_groups: bool) -> pa.RecordBatch:
    """The documents of a block. Their pairs are places in the block's list, which its first row carries with document counts."""
    pairs = np.concatenate([p.pairs for p in parts])
    links = np.concatenate([p.links for p in parts])
    listed, place, docs = np.unique(pairs, return_inverse=True, return_counts=True)
    sizes = np.concatenate([np.diff(p.cuts) for p in parts])
    ends = np.cumsum(sizes)
    groups = [g for p in parts for g in p.groups]
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
    slices = list(zip(ends - sizes, ends))
    head = [pa.array([packed, *[None] * (len(ids) - 1)], pa.binary()) for packed in (planes(listed), planes(docs.astype("<i4")))]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), block)), ids, *[pa.array(np.concatenate(c)) for c in zip(*[p.counts for p in parts])],
         pa.array(digests), pa.array(groups if keep_groups else [None] * len(ids), pa.string()),
         pa.array([planes(np.diff(place[x:y], prepend=0).astype("<i4")) for x, y in slices], pa.binary()),
         pa.array([planes(links[x:y].astype("<i8")) for x, y in slices], pa.binary()), *head],
        names=["block", "id", *COUNTS, "groups_sha256", "groups", "places", "links", "listed", "docs"])


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, folder: str | None = None, keep_groups: bool = False,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """How two tokenizers' tokens of the same text overlap, and how common each linked pair of ids is.

    Side A is a byte-level BPE in a tokenizers file and encodes a blank and the text;
    side B is a sentencepiece model, which adds the blank. Strings of special tokens
    are plain text. Where tokens of both sides end, a group ends; every A token of a
    group is linked with every B token of it. The count of an id pair is the number
    of documents of the table that hold it linked.

    Returns a row per input row: the id, n_a and n_b (tokens), n_groups, n_links,
    n_best (links whose count is the highest of their A id, ties included), count_sum
    (over links) and groups_sha256, the digest of the groups written as
    ``a1,a2|b1;a3|b2,b3``; with ``keep_groups`` also that text. Null and empty texts,
    and those that a side does not spell as they stand, have no tokens: zeros, and an
    empty string for the digest. Rows are independent but for the counts: equal and
    missing ids are no matter. An empty table gives no rows; other columns are
    ignored.

    Documents are encoded once, block by block, and written to ``folder`` (a new one
    in the shared folder by default) with their pairs as places in the block's list.
    Lists are counted over all blocks, a row per block and pair, and sent back to
    their blocks. No document travels with more than its places.
    """
    spark = docs.sparkSession
    ship_code(spark)
    folder = folder or f"{shared_folder(docs)}/alignment-{uuid.uuid4().hex}"
    kind = docs.schema[id_column].dataType.simpleString()

    def encode(batches):
        if (a_path, b_path) not in ALIGNERS:
            ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
        aligner = ALIGNERS[a_path, b_path]
        block = TaskContext.get().partitionId() << 32
        ids, parts, held = [], [], 0
        for batch in batches:
            texts, at, size = encoded(batch.column("text")), 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= AT_ONCE or i == len(texts) - 1:
                    ids.append(batch.column("id").slice(at, i + 1 - at))
                    parts.append(align(aligner, texts[at : i + 1]))
                    at, held, size = i + 1, held + size, 0
                    if held >= BLOCK_BYTES:
                        yield block_rows(block, pa.concat_arrays(ids), parts, keep_groups)
                        block, ids, parts, held = block + 1, [], [], 0
        if parts:
            yield block_rows(block, pa.concat_arrays(ids), parts, keep_groups)

    schema = f"block long, id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, groups string, " \
        "places binary, links binary, listed binary, docs binary"
    rows = docs.select(col(id_column).alias("id"), col(text_column).cast("string").alias("text"))
    rows.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.parquet(folder)
    b_kinds = len(PieceTokens(b_path).spelt)

    def unpack(batches):
        for batch in batches:
            for block, listed, count in zip(batch.column("block").to_pylist(), batch.column("listed").to_pylist(), batch.column("docs").to_pylist()):
                pair = unplanes(listed, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), block)), pa.array(np.arange(len(pair), dtype=np.int32)), pa.array(pair), pa.array(unplanes(count, "<i4"))],
                    names=["block", "place", "pair", "docs"])

    lists = stored.filter("listed IS NOT NULL").select("block", "listed", "docs").mapInArrow(unpack, "block long, place int, pair long, docs int")
    counts = lists.groupBy("pair").agg(F.sum("docs").alias("count"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / b_kinds))  # as many rows as B has ids, at most
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_a))
    answers = lists.join(counts, "pair").select("block", "place", "count", "best")

    def add_up(documents: pa.Table, answers: pa.Table) -> pa.Table:
        place = answers.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place], best[place] = answers.column("count").to_numpy(), answers.column("best").to_numpy()
        sums = [[], []]
        for places, links in zip(documents.column("places").to_pylist(), documents.column("links").to_pylist()):
            at, n = np.cumsum(unplanes(places, "<i4")), unplanes(links, "<i8")
            sums[0].append(int(n[best[at]].sum()))
            sums[1].append(int((n * count[at]).sum()))
        out = documents.select(["id", *COUNTS])
        for name, values in zip(("n_best", "count_sum"), sums):
            out = out.append_column(name, pa.array(values, pa.int64()))
        for name in ("groups_sha256", *["groups"] * keep_groups):
            out = out.append_column(name, documents.column(name))
        return out

    read = stored.select("block", "id", *COUNTS, "groups_sha256", *["groups"] * keep_groups, "places", "links")
    schema = f"id {kind}, {', '.join(f'{c} long' for c in [*COUNTS, 'n_best', 'count_sum'])}, groups_sha256 string" + ", groups string" * keep_groups
    return read.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, schema).withColumnRenamed("id", id_column)
