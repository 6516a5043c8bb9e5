"""Token ids of documents as Parquet lists, written for selective reads."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.frame import col, shared_folder, ship_code

from .texts import encoded

REMEMBERED = 150_000  # pieces in each of two generations whose ids a worker keeps
FILE_BYTES = 64 << 20  # of text that goes into one file
ROWS_AT_ONCE = 1024
# Fixed value: how the word tokenizer of the public files parts a text into words.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Runs of ASCII letters and non-ASCII characters, or of other ASCII characters but blanks and line feeds.
RUNS = re.compile(r"[^\x00-@\[-`{-\x7f]+|[\x00-\x09\x0b-\x1f!-@\[-`{-\x7f]+")
WORDS_AT_ONCE, TEXTS_AT_ONCE = 128, 32


class PieceEncoder:
    """Ids of pieces of text, each encoded once while it is remembered.

    The tokenizer must drop blanks and line feeds and never join what they part, as
    one with word ends does; then pieces are what stands between them. One with the
    split of WORD_SPLIT and small letters also parts words from signs: there texts
    are cut into RUNS, and new words go to the tokenizer many at a time, as the ids
    that end a word tell where each one stops. Texts with apostrophes, which may
    belong to a word, with ``<|``, which may begin a special token, or with
    non-ASCII characters that are no letters are cut at blanks alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plan = json.loads(self.tokenizer.to_str())
        suffix = plan["model"].get("end_of_word_suffix")
        steps = (plan.get("normalizer") or {}).get("normalizers", [])
        splits = [s.get("pattern", {}).get("Regex") for s in (plan.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = bool(suffix) and WORD_SPLIT in splits and any(s["type"] == "Lowercase" for s in steps)
        if self.by_word:
            names = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(names.values()) + 1, bool)
            self.ends_word[[i for t, i in names.items() if t.endswith(suffix)]] = True
        self.young, self.old = {}, {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each UTF-8 text."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        by_word = [self.by_word and b"'" not in t and b"<|" not in t for t in texts]
        cut = [RUNS.findall(t.lower().decode()) if w else t.decode().replace("\n", " ").split(" ") for t, w in zip(texts, by_word)]
        self.learn(set().union(*[c for c, w in zip(cut, by_word) if w]), True)
        self.learn({f" {p}" for c, w in zip(cut, by_word) if not w for p in c}, False)
        known, out = self.young, []
        for text, c, w in zip(texts, cut, by_word):
            try:
                out.append(b"".join(map(known.__getitem__, c if w else [f" {p}" for p in c])))
            except TypeError:  # a run that is no word
                c = [f" {p}" for p in text.decode().replace("\n", " ").split(" ")]
                self.learn(set(c), False)
                out.append(b"".join([known[p] for p in c]))
        return out

    def learn(self, pieces: set[str], by_word: bool) -> None:
        """Remember ids: of runs, or of pieces between blanks, which a blank before them tells apart."""
        known, old = self.young, self.old
        fresh = pieces - known.keys()
        again = fresh & old.keys()
        known.update(zip(again, map(old.__getitem__, again)))
        fresh -= again
        words = list(filter(str.isalpha, fresh)) if by_word else []
        rest = []
        for p in fresh.difference(words):
            if by_word and not p.isascii():
                known[p] = None  # not a word; signs beside it could belong to it
            else:
                rest.append(p)
        groups = [words[at : at + WORDS_AT_ONCE] for at in range(0, len(words), WORDS_AT_ONCE)]
        for at in range(0, len(groups), TEXTS_AT_ONCE):
            some = groups[at : at + TEXTS_AT_ONCE]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, "<i4")
                ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
                if len(ends) == len(group) and ends[-1] == 4 * len(ids):
                    raw = ids.tobytes()
                    known.update(zip(group, [raw[x:y] for x, y in zip([0, *ends], ends)]))
                else:
                    rest += group
        for at in range(0, len(rest), 1024):
            some = rest[at : at + 1024]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[p] = np.array(e.ids, "<i4").tobytes()


#: Encoders of this worker process by the path of their tokenizer.
ENCODERS: dict[str, PieceEncoder] = {}


def encode_texts(tokenizer_path: str, end_id: int, text_column: str = "text") -> Callable:
    """Batches with their text replaced by (ids, n_tokens): those of the whole text and the end id."""
    end = np.array([end_id], "<i4").tobytes()

    def run(batches):
        if tokenizer_path not in ENCODERS:
            ENCODERS[tokenizer_path] = PieceEncoder(tokenizer_path)
        encoder = ENCODERS[tokenizer_path]
        for whole in batches:
            at = whole.schema.get_field_index(text_column)
            others = [i for i in range(whole.num_columns) if i != at]
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                flat = encoder.ids(encoded(batch.column(at)))
                values = np.frombuffer(b"".join([x + end for x in flat]), "<i4")
                sizes = np.array([len(x) // 4 + 1 for x in flat], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in others], pa.ListArray.from_arrays(offsets, pa.array(values)), pa.array(sizes)],
                    names=[*[batch.schema.names[i] for i in others], "ids", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, row_group_bytes: int = 16 << 20,
                      page_rows: int = 2000, delta: bool = False, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write (id, ids, n_tokens, part) as Parquet, in ascending order of id, nulls first.

    Files are ranges of ids, and rows are sorted within. Ids are dictionary-encoded,
    or delta-encoded with ``delta``; row groups, and pages of ``page_rows`` rows with
    their column indexes, let readers fetch single columns and ranges of documents.
    Spark's committer makes the files of a lost task disappear.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(col(id_column).alias("id"), col(text_column).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, size // FILE_BYTES)
    kind = rows.schema["id"].dataType.simpleString()
    ranged = rows.repartitionByRange(int(files), F.col("id"), F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    tokens = ranged.sortWithinPartitions("id", F.xxhash64("text")).select("id", "part", "text")
    (tokens.mapInArrow(encode_texts(tokenizer_path, end_id), f"id {kind}, part int, ids array<int>, n_tokens long")
     .select(F.col("id").alias(id_column), "ids", "n_tokens", "part")
     .write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
     .option("parquet.page.size", 1 << 20).option("parquet.enable.dictionary", str(not delta).lower())
     .option("parquet.writer.version", "v2" if delta else "v1").parquet(folder))


def read_token_files(spark: SparkSession, folder: str, id_column: str = "doc_id") -> DataFrame:
    """Per document of token files: the id, start (ids of all documents before it), n_tokens and ids_crc32.

    Starts come from the metadata columns alone: a running sum within each file,
    after the sums of the files before it. The checksum is that of the ids as
    little-endian unsigned 32-bit integers. Equal ids follow in the files' order.
    """
    ship_code(spark)
    files = spark.read.parquet(folder)
    kind = files.schema[id_column].dataType.simpleString()

    def sums(batches):
        for batch in batches:
            lists = batch.column("ids")
            values, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_tokens", "part", "place")), pa.array(crc, pa.int64())],
                                             names=["id", "n_tokens", "part", "place", "ids_crc32"])

    before = files.groupBy("part").agg(F.sum("n_tokens").alias("total")) \
        .withColumn("offset", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    rows = files.select(col(id_column).alias("id"), "ids", "n_tokens", "part", F.monotonically_increasing_id().alias("place"))
    read = rows.mapInArrow(sums, f"id {kind}, n_tokens long, part int, place long, ids_crc32 long")
    inside = Window.partitionBy("part").orderBy("id", "place").rowsBetween(Window.unboundedPreceding, -1)
    return read.join(before.select("part", "offset"), "part").select(
        F.col("id").alias(id_column), (F.coalesce("offset", F.lit(0)) + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"),
        "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 1, delta: bool = False,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write token files of the documents and return what reading them back gives.

    ``folder`` defaults to a new one in the folder all executors share. Null and
    empty texts have the end id alone; documents with equal ids follow one another
    in the order of a hash of their texts, those without id come first. An empty
    table writes an empty file. Other columns are left out.
    """
    folder = folder or f"{shared_folder(docs)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer_path, end_id, delta=delta, id_column=id_column, text_column=text_column)
    return read_token_files(docs.sparkSession, folder, id_column)
