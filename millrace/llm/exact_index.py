"""Exact duplicates by an extendible-hash index of texts in files that all executors share."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.frame import shared_folder, settle

from .rolling import ranges
from .texts import encoded, keyed

BUCKET_BYTES = 4 << 20  # of text, with ROW_BYTES a row, that fill a bucket
ROW_BYTES = 64
#: Buckets, and keys of more than a bucket, that a directory is made for. Larger tables get larger buckets.
SLOTS = 1 << 16
PAGE_ROWS = 16_384  # rows of one key that share a page
TASK_BYTES = 64 << 20  # of buckets that one task owns
DEEPEST = 24


@dataclass
class Directory:
    """Where keys live: the bucket of each key prefix of ``depth`` bits, and of the pages of keys that outgrow one."""

    depth: int
    bucket: np.ndarray  # of each slot; a bucket of less depth has several
    task: np.ndarray  # the owner of each bucket, as a range of keys
    pages: dict[int, tuple[int, bool]]  # of keys that fill more than a bucket, and whether their texts part them
    tasks: int

    def slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64) if self.depth else np.zeros(len(codes), np.int64)

    def owners(self, codes: np.ndarray, keys: np.ndarray, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(task, page, pages) of texts by their code, row key and digest. Pages by digest hold all copies of a text, so they count as one."""
        task, page, pages = self.task[self.bucket[self.slots(codes)]], np.zeros(len(codes), np.int64), np.ones(len(codes), np.int64)
        for i, code in enumerate(codes.tolist() if self.pages else []):
            n, by_digest = self.pages.get(code, (1, False))
            if n > 1:
                page[i] = int.from_bytes(digests[i][8:16], "big") % n if by_digest else int(keys[i]) % n
                pages[i] = 1 if by_digest else n
                task[i] = ((code & 0xFFFFFFFF) + page[i]) % self.tasks
        return task.astype(np.int32), page, pages


def split(loads: list[dict[int, int]], first: int, capacity: int) -> np.ndarray:
    """The bucket of each slot of the directory, as a number in the order of keys.

    ``loads`` has what each key prefix holds, for prefixes of ``first`` bits and of
    one more bit each. While a bucket is overfull the directory doubles: each slot
    becomes two, and overfull buckets alone are parted between them.
    """
    opened = starts = np.ones(1 << first, bool)
    for load in loads[:-1]:
        over = np.zeros(len(opened), bool)
        over[[slot for slot, size in load.items() if size > capacity]] = True
        opened = np.repeat(over & opened, 2)
        starts = np.repeat(starts, 2)
        starts[1::2] = opened[1::2]
    return np.cumsum(starts) - 1


def directory(sizes: DataFrame, tasks: int, bucket_bytes: int, page_rows: int) -> Directory:
    """The directory of a table of keys (code, n, size of one text, before: pages so far), by counting and doubling.

    Keys of more rows than a page or more bytes than a bucket get pages of their own
    and weigh nothing in their bucket. There are at most SLOTS of either sort, as
    limits grow with the table: nothing here depends on its length.
    """
    load = F.col("n") * (F.col("size") + ROW_BYTES)
    total, rows = sizes.agg(F.sum(load), F.sum("n")).first()
    total, rows = total or 0, rows or 0
    capacity, page_rows = max(bucket_bytes, total // SLOTS), max(page_rows, rows // SLOTS)
    hot = sizes.filter((load > capacity) | (F.col("n") > page_rows)).collect()
    pages = {}
    for r in hot:  # four rows a page at least, so that the next level is shorter; if many texts share a key, they part it
        many = min(max(-(-r.n * (r.size + ROW_BYTES) // capacity), -(-r.n // page_rows)), -(-r.n // 4))
        pages[r.code] = many, 0 < 2 * r.before < r.n
    plain = sizes.filter((load <= capacity) & (F.col("n") <= page_rows))
    depth = min(max(0, (total // capacity).bit_length()), SLOTS.bit_length())
    first, loads = depth, []
    while True:  # a round for each doubling
        slot = F.shiftrightunsigned("code", 64 - depth) if depth else F.lit(0).cast("long")
        loads.append({r[0]: r[1] for r in plain.groupBy(slot.alias("slot")).agg(F.sum(load).alias("load")).collect()})
        if depth >= min(DEEPEST, first + 4) or max(loads[-1].values(), default=0) <= capacity:
            break
        depth += 1
    bucket = split(loads, first, capacity)
    filled = np.zeros(int(bucket[-1]) + 1, np.int64)
    for slot, size in loads[-1].items():
        filled[bucket[slot]] += size
    share = max(1, min(TASK_BYTES, total // max(tasks, 1)))
    before = np.cumsum(filled) - filled
    owner = np.unique(before // share, return_inverse=True)[1]
    return Directory(depth, bucket, owner, pages, max(tasks, int(owner[-1]) + 1))


def code_of(digest: bytes, key_bits: int) -> int:
    return int.from_bytes(digest[:8], "big", signed=True) >> (64 - key_bits) << (64 - key_bits)


class Chains:
    """Texts by key, each once: texts that share a key are chained, and compared byte by byte."""

    def __init__(self, key_bits: int):
        self.key_bits = key_bits
        self.of: dict[int, list[list]] = {}

    def add(self, text: bytes, digest: bytes, row: int, n: int) -> None:
        chain = self.of.setdefault(code_of(digest, self.key_bits), [])
        for entry in chain:
            if entry[0] == text:
                entry[2].append(row)
                entry[3] += n
                return
        chain.append([text, digest, [row], n])


MEMBER = "struct<key:long,id:{}>"
COLUMNS = ["code", "page", "pages", "keep", "n", "digest", "text", "members"]


def exact_duplicates(docs: DataFrame, folder: str | None = None, key_bits: int = 64, bucket_bytes: int = BUCKET_BYTES, page_rows: int = PAGE_ROWS,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents with the same text but for the case of A-Z, found in an index of all texts.

    Texts are indexed by ``key_bits`` of their SHA-256. A pass over the table counts
    the rows and bytes of every key; from it follows the directory, which doubles until no
    bucket is overfull. A second pass deals every text, once per batch that holds
    it, to the task that owns its range of keys. Owners chain the texts of a key,
    compare their bytes, and write an entry per text to ``folder`` (a new one in the
    shared folder by default). Keys of many copies are dealt over pages with owners of
    their own; what the pages keep is dealt again, until a key has one page.

    Returns a row per input row: the id, keep_id (the largest id with that text),
    group_size, kept (whether this row stays, one of each group) and text_sha256 (of
    the text in small letters). Null text is empty text. Rows with equal ids are
    separate rows, of which the last in the order of id and text counts as the
    largest; a null id is less than any other. An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(docs)}/texts-{uuid.uuid4().hex}"
    rows = keyed(docs, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    level, levels = 0, []
    found = rows.select("key", "id", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("before"), "text")
    while True:
        entries = index_level(spark, found, f"{folder}/level={level}", kind, key_bits, bucket_bytes, page_rows)
        levels.append(entries)
        paged = entries.filter("pages > 1")
        if paged.limit(1).isEmpty():
            break
        found = paged.select(F.col("keep.key").alias("key"), F.col("keep.id").alias("id"), "n", F.col("pages").alias("before"), "text")
        level += 1
    final = None
    for entries in reversed(levels):
        whole = entries.filter("pages = 1").select("keep", "n", "digest", "members")
        if final is not None:
            parts = entries.filter("pages > 1").select(F.col("keep.key").alias("key"), "members")
            whole = whole.unionByName(parts.join(final.select("key", "keep", "n", "digest"), "key").drop("key"))
        final = whole.select("keep", "n", "digest", F.explode("members").alias("member")) \
            .select("keep", "n", "digest", F.col("member.key").alias("key"), F.col("member.id").alias("id"))
    return final.select(F.col("id").alias(id_column), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("key") == F.col("keep.key")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def index_level(spark: SparkSession, rows: DataFrame, folder: str, kind: str, key_bits: int, bucket_bytes: int, page_rows: int) -> DataFrame:
    """Entries of the rows (key, id, n, text), one per text and page, written to the folder and read from it."""
    member = MEMBER.format(kind)

    def measure(batches):
        for batch in batches:
            texts = encoded(batch.column("text"))
            codes = [code_of(hashlib.sha256(t.lower()).digest(), key_bits) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(map(len, texts), pa.int64()), batch.column("before")],
                                             names=["code", "size", "before"])

    sizes = settle(rows.select("text", "before").mapInArrow(measure, "code long, size long, before long").groupBy("code").agg(
        F.count("*").alias("n"), F.max("size").alias("size"), F.max("before").alias("before")))
    plan = spark.sparkContext.broadcast(directory(sizes, spark.sparkContext.defaultParallelism, bucket_bytes, page_rows))

    def deal(batches):
        for batch in batches:
            chains, n, key = Chains(key_bits), batch.column("n").to_pylist(), batch.column("key").to_numpy()
            for row, text in enumerate(encoded(batch.column("text"))):
                text = text.lower()  # of bytes: A-Z alone
                chains.add(text, hashlib.sha256(text).digest(), row, n[row])
            if not batch.num_rows:
                continue
            codes = np.array([code for code, chain in chains.of.items() for _ in chain], np.int64)
            texts, digests, members, counts = zip(*[e for chain in chains.of.values() for e in chain])
            keep = np.array([max(m, key=key.__getitem__) for m in members])
            both = pa.StructArray.from_arrays([batch.column("key"), batch.column("id")], names=["key", "id"])
            task, page, pages = plan.value.owners(codes, key[keep], digests)
            offsets = np.concatenate(([0], np.cumsum([len(m) for m in members]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(task), pa.array(codes), pa.array(page), pa.array(pages), both.take(pa.array(keep)), pa.array(counts, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(texts, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), both.take(pa.array([r for m in members for r in m], pa.int64())))],
                names=["task", *COLUMNS])

    columns = f"code long, page long, pages long, keep {member}, n long, digest binary, text binary, members array<{member}>"
    dealt = rows.mapInArrow(deal, f"task int, {columns}")
    owned = dealt.repartitionById(plan.value.tasks, F.col("task")).sortWithinPartitions("code", "page")

    def own(batches):
        """Rows come in the order of keys; the last key of a batch waits for the next one. A page bounds what waits."""
        waiting = None
        for batch in batches:
            if waiting is not None:
                batch = pa.concat_batches([waiting, batch])
            place = np.stack([batch.column(c).to_numpy() for c in ("code", "page")])
            new = np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(axis=0)))[: batch.num_rows]
            first = np.flatnonzero(new)
            if len(first):
                waiting = batch.slice(int(first[-1]))
                yield chained(batch.slice(0, int(first[-1])), first[:-1])
        if waiting is not None:
            yield chained(waiting, np.zeros(1, np.int64))

    def chained(batch, first):
        """Rows of whole keys as an entry per text. Most keys have one row; others are chained and compared."""
        ends = np.append(first[1:], batch.num_rows)
        entry, entries, text = np.empty(batch.num_rows, np.int64), 0, batch.column("text")
        for a, b in zip(first.tolist(), ends.tolist()):
            chain = []
            for row in range(a, b):
                here = text[row].as_py() if b - a > 1 else None
                found = next((k for k, other in enumerate(chain) if other == here), len(chain))
                entry[row] = entries + found
                if found == len(chain):
                    chain.append(here)
            entries += len(chain)
        key = pc.struct_field(batch.column("keep"), "key").to_numpy()
        order = np.lexsort((key, entry))
        last = np.append(entry[order][1:] != entry[order][:-1], True)[: len(order)]
        best = batch.take(pa.array(order[last]))
        members, sizes = batch.column("members"), np.bincount(entry, weights=batch.column("n").to_numpy(), minlength=entries)
        offsets = members.offsets.to_numpy().astype(np.int64)
        lengths = np.diff(offsets)[order]
        held = np.bincount(entry[order], weights=lengths, minlength=entries)
        flat = members.values.take(pa.array(ranges(offsets[order], lengths)))
        return pa.RecordBatch.from_arrays(
            [*[best.column(c) for c in ("code", "page", "pages", "keep")], pa.array(sizes.astype(np.int64)), best.column("digest"), best.column("text"),
             pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32)), flat)], names=COLUMNS)

    owned.select(*COLUMNS).mapInArrow(own, columns) \
        .write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)
