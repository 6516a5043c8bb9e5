"""License texts in documents, by diagonal voting, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.numbers import let

from .texts import keyed

# Opening passages and common notices of public licenses, and the base phrases.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0."],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ],
}
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: A short template, up to so many grams long, must be covered so far; the words without a hit within a span.
SHORT, SHORT_COVERAGE = 4, 0.8
LONGEST_GAP = 24
OTHERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)


def words(text: Column) -> Column:
    """Runs of digits, a-z and non-ASCII characters. Only the ends of a split can be empty."""

    def trimmed(parts):
        first = (parts[0] == "").cast("int")
        last = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
        return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))

    return let(F.split(text, OTHERS), trimmed)


def grams(text: Column, k: int) -> Column:
    """Hashes of all runs of k words of a text, by their first word; none for fewer words."""

    def hashed(w):
        places = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

    return let(words(text), hashed)


def template_grams(spark, templates: dict[str, list[str]], k: int) -> DataFrame:
    """(template, label, size, place, gram) of all templates; their number is fixed by the templates."""
    rows = [F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"))
            for n, (label, text) in enumerate((label, text) for label, texts in templates.items() for text in texts)]
    t = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*").withColumn("low", lowered(F.col("text")))
    return t.select("template", "label", F.size(words(F.col("low"))).alias("size"), F.posexplode(grams(F.col("low"), k)).alias("place", "gram"))


def stands_at(w: Column, sought: list[str]):
    """Whether the words sought begin at a place of w."""

    def here(i):
        hit = F.get(w, i) == sought[0]
        for j in range(1, len(sought)):
            hit = hit & (F.get(w, i + j) == sought[j])
        return hit

    return here


def place_of(label: str):
    return lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))


def phrase_places(w: Column) -> Column:
    """(start, label) of every place where a phrase's words stand one after the other."""
    parts = []
    for phrase, label in PHRASES.items():
        sought = phrase.split()
        last = F.size(w) - len(sought)
        some = F.array_contains(w, sought[0]) & F.array_contains(w, sought[-1]) & (last >= 0)
        starts = F.when(some, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(F.filter(starts, stands_at(w, sought)), place_of(label)))
    return F.concat(*parts)


def best_chain(hits: Column, k: int, drift: Column, reach: Column) -> Column:
    """(score, covered, first, last) of the best chain of hits in order of their place in the text.

    A chain goes on in the text and in the template at once, at most ``reach`` words
    further and with at most ``drift`` words more or less. covered counts the words
    of the template, score is less by the words in between that the template lacks.
    """

    def linked(recent, h):
        after = F.filter(recent, lambda r: (r["at"] < h["at"]) & (r["place"] < h["place"])
                         & (F.abs(h["at"] - r["at"] - h["place"] + r["place"]) <= drift))

        def longer(r):
            new = F.least(F.lit(k), h["place"] - r["place"])
            surplus = F.greatest(F.lit(0), h["at"] - r["at"] - h["place"] + r["place"])
            return F.struct((r["score"] + new - surplus).alias("score"), (r["covered"] + new).alias("covered"), r["first"].alias("first"))

        alone = F.struct(F.lit(k).alias("score"), F.lit(k).alias("covered"), h["at"].alias("first"))
        return F.array_max(F.concat(F.array(alone), F.transform(after, longer)))

    def step(state, h):
        def moved(recent):
            return let(linked(recent, h), lambda c: F.struct(
                F.concat(recent, F.array(F.struct(h["at"].alias("at"), h["place"].alias("place"), c["score"].alias("score"),
                                                  c["covered"].alias("covered"), c["first"].alias("first")))).alias("recent"),
                F.greatest(state["best"], F.struct(c["score"].alias("score"), c["covered"].alias("covered"), c["first"].alias("first"),
                                                   h["at"].alias("last"))).alias("best")))

        return let(F.filter(state["recent"], lambda r: r["at"] >= h["at"] - reach), moved)

    start = F.expr("named_struct('recent', cast(array() as array<struct<at:int,place:int,score:int,covered:int,first:int>>), "
                   "'best', named_struct('score', 0, 'covered', 0, 'first', 0, 'last', 0))")
    return F.aggregate(hits, start, step, lambda state: state["best"])


def license_spans(rows: DataFrame, templates: dict[str, list[str]], k: int, drift: int, coverage: float) -> DataFrame:
    """(key, label, first, last, covered) of stretches that follow a template.

    Every k-gram of a document meets the template places with its hash; a hit votes
    for its diagonal, the document's place less the template's. The hits of one
    template are cut where the text goes on for more words without any than a span
    may miss. In each stretch, hits in order whose diagonals differ by at most
    ``drift`` from one to the next are chained, so that a word more or less does not
    break a span. A span stands if it covers the given share of the template's words,
    with at most as many words in between that are not the template's as it may miss
    of those. Of a template of up to ``SHORT`` grams' length it must cover
    ``SHORT_COVERAGE`` without a word more or less.
    """
    t = template_grams(rows.sparkSession, templates, k)
    short = F.col("size") <= SHORT * k
    share = F.when(short, F.greatest(F.lit(coverage), F.lit(SHORT_COVERAGE))).otherwise(F.lit(coverage))
    t = t.withColumn("need", F.ceil(F.col("size") * share - 1e-9).cast("int")).withColumn("drift", F.when(short, 0).otherwise(drift)) \
        .withColumn("reach", F.least(F.col("size") - F.col("need"), F.lit(LONGEST_GAP)) + F.col("drift") + k)
    hits = rows.select("key", F.posexplode(grams(lowered(F.col("text")), k)).alias("at", "gram")).join(F.broadcast(t), "gram")
    w = Window.partitionBy("key", "template").orderBy("at")
    near = F.col("at") - F.lag("at").over(w) <= F.col("reach")
    stretches = hits.withColumn("stretch", F.sum(F.when(near, 0).otherwise(1)).over(w)) \
        .groupBy("key", "template", "label", "size", "need", "drift", "reach", "stretch") \
        .agg(F.collect_list(F.struct("at", "place")).alias("hits")).filter(F.size("hits") * k >= F.col("need"))
    spans = stretches.withColumn("best", best_chain(F.array_sort("hits"), k, F.col("drift"), F.col("reach"))).select("key", "label", "size", "need", "best.*")
    return spans.filter((F.col("covered") >= F.col("need")) & (F.col("covered") - F.col("score") <= F.col("size") - F.col("need"))) \
        .select("key", "label", "first", (F.col("last") + (k - 1)).alias("last"), (F.col("covered") / F.col("size")).alias("covered"))


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, k: int = 3, drift: int = 3, coverage: float = 0.6,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Licenses that a document names or quotes.

    Words are runs of digits, letters a-z and non-ASCII characters, after A-Z became
    a-z. Base: places where the words of a phrase stand one after the other. The
    method adds labels of templates that a stretch of text follows, by votes of all
    its k-grams for diagonals; see ``license_spans``.

    Returns per document: the id, n_words, n_base (places), first_word and last_word
    (least and largest start of a place, null without), base_labels, labels (with
    the method's; both distinct, sorted, comma-joined) and score, the largest share
    of a template that a span covers (0 without). Null and empty texts have no
    words and no labels. Rows that share an id are separate documents; other columns
    are ignored; an empty table gives no rows.
    """
    rows = keyed(docs, id_column, text_column)
    counted = let(words(lowered(F.col("text"))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), phrase_places(w).alias("places")))
    base = rows.select("key", "id", counted.alias("counted")).select("key", "id", "counted.*")
    spans = license_spans(rows, templates or TEMPLATES, k, drift, coverage)
    found = spans.groupBy("key").agg(F.collect_set("label").alias("learnt"), F.max("covered").alias("score"))
    joined = base.join(found, "key", "left")

    def listed(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    own = F.col("places.label")
    return joined.select(
        F.col("id").alias(id_column), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"), F.array_max("places.start").cast("long").alias("last_word"),
        listed(own).alias("base_labels"), listed(F.concat(own, F.coalesce("learnt", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
