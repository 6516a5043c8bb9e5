"""The registered corpus queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .alignment import align_tokenizers
from .classifier import quality_classifier
from .decontamination import decontaminate
from .exact_index import exact_duplicates
from .licenses import license_scan
from .mixing import mix_sources
from .near_duplicates import near_duplicates
from .periodic import periodic_runs
from .personal_data import personal_data
from .quality_rules import quality_rules
from .substrings import substring_dedup, suffix_array_dedup
from .token_files import token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("op1_bootstrapped_personal_data")
def _(table):
    return personal_data(table("documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


WORDS = r"[x FOR x IN regexp_split_to_array({}, '{}') IF x <> '']"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = WORDS.format(LOWERED, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK_WORDS = WORDS.format("coalesce(text, '')", r"[\x20\x09-\x0D]+")


@query("op2_winnowing_decontamination", f"""
    WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark),
    g AS (SELECT item_id, least(len(w), 10) AS n, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
    k AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM g),
    l AS (SELECT DISTINCT n FROM k),
    p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, l WHERE len(w) >= n),
    h AS (SELECT doc_id, i, p.n, item_id FROM p JOIN k ON p.n = k.n AND array_to_string(w[i:i + p.n - 1], ' ') = gram),
    c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""")
def _(table):
    return decontaminate(table("documents"), table("benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op3_suffix_array_dedup")
def _(table):
    return suffix_array_dedup(table("documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op4_likelihood_ratio_rules")
def _(table):
    return quality_rules(table("documents"), table("labels").filter("quality = 1")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


DOMAIN = "CASE CAST(regexp_extract(source, '[0-9]+', 0) AS INT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END"
LEVELS = {"domain": DOMAIN, "lang": "lang", "source": "source"}
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 3}}


def share_sql(name: str, of: str, parent: str, child: str, weight: str) -> str:
    """One level of the budget: children of each parent, full ones first by capacity per weight."""
    by = f"PARTITION BY {parent}"
    before = f"OVER ({by} ORDER BY capacity / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_c AS (SELECT {parent}, {child}, CAST(sum(cap) AS HUGEINT) AS capacity, any_value(given) AS budget, CAST({weight} AS HUGEINT) AS weight
      FROM {of} GROUP BY ALL),
    {name}_r AS (SELECT *, budget - coalesce(sum(capacity) {before}, 0) AS rest,
      sum(weight) OVER ({by}) - coalesce(sum(weight) {before}, 0) AS open FROM {name}_c),
    {name}_f AS (SELECT *, rest * weight >= capacity * open AS filled FROM {name}_r),
    {name}_o AS (SELECT {parent}, arg_min(rest, (capacity / weight, {child})) AS rest, arg_min(open, (capacity / weight, {child})) AS open
      FROM {name}_f WHERE NOT filled GROUP BY {parent}),
    {name}_g AS (SELECT f.{parent.replace(', ', ', f.')}, f.{child}, CASE WHEN filled THEN capacity ELSE weight * o.rest // o.open END AS share
      FROM {name}_f f LEFT JOIN {name}_o o ON {' AND '.join(f'f.{p} = o.{p}' for p in parent.split(', '))}),
    {name} AS (SELECT l.* EXCLUDE (given), share AS given FROM {of} l JOIN {name}_g g
      ON {' AND '.join(f'l.{p} = g.{p}' for p in [*parent.split(', '), child])})"""


@query("op5_hierarchical_mixing", f"""
    WITH d AS (SELECT 0 AS root, doc_id, {DOMAIN.replace("0) AS INT", "0) AS INTEGER")} AS domain, lang, source,
      len({BLANK_WORDS}) AS n_tokens, md5(text) AS tie FROM documents),
    leaf AS (SELECT root, domain, lang, source, sum(n_tokens) AS tokens, 2 * sum(n_tokens) AS cap FROM d GROUP BY ALL),
    top AS (SELECT *, least(sum(tokens) OVER (), sum(cap) OVER ()) AS given FROM leaf),
    {share_sql("a", "top", "root", "domain", "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END")},
    {share_sql("b", "a", "root, domain", "lang", "CASE lang WHEN 'en' THEN 3 ELSE 1 END")},
    {share_sql("c", "b", "root, domain, lang", "source", "1")},
    p AS (SELECT domain, lang, source, given // greatest(tokens, 1) AS epochs, given % greatest(tokens, 1) AS rest FROM c),
    o AS (SELECT d.*, epochs, rest, substr(md5('7:' || epochs || ':' || doc_id), 1, 15) AS place
      FROM d JOIN p ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source),
    s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n_tokens, tie) AS upto FROM o)
    SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM s""")
def _(table):
    mixed = mix_sources(table("documents"), LEVELS, WEIGHTS, max_epochs=2)
    return mixed.select("row.doc_id", "domain", "lang", "source", "n_tokens", "copies")


@query("op6_odd_sketch_near_duplicates", rf"""
    WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWERED, r'[\x20\x09-\x0D]+')} AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM p),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
    r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, m = d.doc_id AS kept
    FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) ON x = d.doc_id""")
def _(table):
    return near_duplicates(table("documents"))


@query("op7_token_files")
def _(table):
    return token_output(table("documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_substring_dedup", f"""
    WITH d AS (SELECT doc_id, {BLANK_WORDS} AS w FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
    k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS again FROM p),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM k WHERE again),
    n AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
    s AS (SELECT n.doc_id, string_agg(word, ' ' ORDER BY n.j) FILTER (WHERE g.j IS NULL) AS kept, count(g.j) AS n_removed
      FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.j = g.j GROUP BY n.doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN s ON d.doc_id = s.doc_id""")
def _(table):
    return substring_dedup(table("documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op9_ftrl_quality_classifier")
def _(table):
    return quality_classifier(table("documents"), table("labels"))


@query("op10_diagonal_license_scan")
def _(table):
    return license_scan(table("documents"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """documents whose words from some place on repeat the first few from there, in a tenth of the rows by crc32 of the id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    parts = docs.withColumns({"h": h, "g": F.floor(h / 10), "w": F.when(h % 10 == 0, words)}) \
        .withColumn("a", (F.col("g") % F.greatest(F.size("w"), F.lit(1))).cast("int")) \
        .withColumn("rest", F.size("w") - F.col("a")) \
        .withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(F.col("rest") / F.col("p")).cast("int"))),
                   F.lit(1), F.col("rest"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return parts.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


@query("op11_recompression_runs")
def _(table):
    runs = periodic_runs(with_periodic_tails(table("documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_extendible_hash_dedup", f"""
    WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
      sha256(t) AS text_sha256 FROM d WINDOW same AS (PARTITION BY t)""")
def _(table):
    return exact_duplicates(table("documents"))


@query("op13_interval_alignment")
def _(table):
    return align_tokenizers(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
