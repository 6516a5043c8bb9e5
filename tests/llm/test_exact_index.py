"""Exact duplicates by the extendible-hash index, against a plain version."""

import random

import numpy as np
import pytest

import plain_versions as plain
from millrace.llm import exact_index
from test_corpus import ODD, ROWS, both_ways, frame, table

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
rng = random.Random(12)


def test_overfull_buckets_split_and_the_directory_doubles():
    loads = [{0: 3, 1: 20}, {0: 1, 1: 2, 2: 18, 3: 2}, {0: 1, 2: 2, 4: 9, 5: 9, 6: 1, 7: 1}]
    assert exact_index.split(loads, 1, 10).tolist() == [0, 0, 0, 0, 1, 2, 3, 3]
    assert exact_index.split(loads[:1], 1, 10).tolist() == [0, 1]


@pytest.mark.parametrize("key_bits, bucket, rows", [(64, 4 << 20, 16_384), (64, 300, 4), (3, 1 << 20, 100), (1, 500, 4), (64, 1 << 20, 7)])
def test_duplicates(spark, key_bits, bucket, rows):
    run = lambda d: exact_index.exact_duplicates(d, key_bits=key_bits, bucket_bytes=bucket, page_rows=rows)
    both_ways(spark, run, plain.exact_duplicates, COLUMNS)
    many = [(i, rng.choice(["hot text", "Hot TEXT", "hot text", "", None, "rare %d" % rng.randint(0, 60), "\u00c9 \u212a %d" % (i % 3)])) for i in range(700)]
    assert table(run(frame(spark, many)), *COLUMNS) == sorted(plain.exact_duplicates(many), key=repr)


def test_all_texts_alike_and_all_different(spark):
    run = lambda d: exact_index.exact_duplicates(d, bucket_bytes=2000, page_rows=16)
    for rows in ([(i, "Same Words") for i in range(2000)], [(i, f"text {i}") for i in range(900)]):
        rng.shuffle(shuffled := list(rows))
        assert table(run(frame(spark, shuffled)), *COLUMNS) == sorted(plain.exact_duplicates(rows), key=repr)


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "X"), (None, "x"), ("c", "y")], "doc_id string, text string")
    assert table(exact_index.exact_duplicates(df), *COLUMNS[:4]) == sorted(
        [("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("c", "c", 1, True)], key=repr)


def test_a_hot_text_is_dealt_over_pages(spark, tmp_path):
    """No owner gets more than a few pages, and the texts of a page are read once."""
    docs = frame(spark, [(i, "one text of many copies") for i in range(3000)] + [(5000 + i, f"text {i} " * 5) for i in range(1500)]).repartition(40)
    exact_index.exact_duplicates(docs, str(tmp_path / "index"), bucket_bytes=4096, page_rows=32).collect()
    entries = spark.read.parquet(str(tmp_path / "index" / "level=0"))
    pages = [r[0] for r in entries.filter("pages > 1").selectExpr("n").collect()]
    assert sum(pages) == 3000 and len(pages) > 20
    assert max(len(r[0]) for r in entries.select("members").collect()) < 600
    assert entries.filter("pages = 1").count() == 1500
