"""Grammars by recompression and the runs found with them, against plain versions."""

import random
from fractions import Fraction

import numpy as np
import pytest

import plain_versions as plain
from millrace.llm import periodic, queries, recompression
from test_corpus import ODD, ROWS, frame, table

rng = random.Random(8)


def test_extensions_both_ways_equal_a_walk():
    for _ in range(60):
        text = [rng.choice("ab") for _ in range(rng.randint(2, 120))]
        if rng.random() < 0.5:
            text = text[: rng.randint(1, 9)] * rng.randint(2, 20)
        codes = np.array([-1, *map(ord, text), -2])
        grammar = recompression.compress(codes)
        pairs = [(i, j) for i in range(1, len(codes) - 1) for j in range(i + 1, len(codes) - 1)]
        x, y = np.array(pairs, np.int64).reshape(-1, 2).T
        for step in (1, -1):
            want = []
            for i, j in pairs:
                n = 0
                while codes[i + step * n] == codes[j + step * n]:
                    n += 1
                want.append(n)
            assert recompression.extend(grammar, x, y, step).tolist() == want


def test_grammar_shrinks_and_ends_in_distinct_symbols():
    codes = np.concatenate(([-1], np.tile([3, 4, 4, 5], 5000), [-2]))
    levels = recompression.compress(codes).levels
    assert len(levels) < 60
    assert all(len(b.symbols) < len(a.symbols) for a, b in zip(levels, levels[1:]))


def expected(rows, min_length, exponent):
    out = []
    for i, text in rows:
        words = plain.blank_words(text)
        found = plain.runs(words, min_length, exponent)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        out.append((i, len(words), found, best, " ".join(plain.collapsed(words, found))))
    return sorted(out, key=repr)


def got(df):
    rows = df.select("doc_id", "n_words", "runs", "best", "collapsed").collect()
    return sorted([(r[0], r[1], [tuple(x) for x in r[2]], r[3] and tuple(r[3]), r[4]) for r in rows], key=repr)


ODD_RUNS = [(1, "a b " * 9 + "a"), (2, "x " * 5), (3, "x " * 6), (3, "x " * 6), (4, "a a b " * 4), (5, "a b c " * 4 + "d " * 7 + "d e " * 5),
            (6, "a a a b " * 12 + "c " + "a b a c " * 7)]


@pytest.mark.parametrize("size, at_once", [(2 << 20, 1 << 21), (200, 50)])
def test_runs_of_every_kind_of_text(spark, monkeypatch, size, at_once):
    monkeypatch.setattr(periodic, "SHARD_BYTES", size)
    monkeypatch.setattr(periodic, "CANDIDATES", at_once)
    short = [(i, t) for i, t in ROWS if len(t or "") < 20_000]  # the plain version is quadratic
    shuffled = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 80)))) for i in range(80)]
    for rows in (short, ODD, ODD_RUNS, shuffled):
        assert got(periodic.periodic_runs(frame(spark, rows))) == expected(rows, 6, 4)
    assert got(periodic.periodic_runs(frame(spark, shuffled), 2, 2)) == expected(shuffled, 2, 2)
    assert got(periodic.periodic_runs(frame(spark, []))) == []


def test_a_very_long_period_and_a_very_long_run(spark):
    long = [str(i) for i in range(9_000)]
    rows = [(1, " ".join(long * 4 + long[:10])), (2, "la " * 60_000)]
    found = {r[0]: r for r in got(periodic.periodic_runs(frame(spark, rows)))}
    assert found[1][2] == [(0, 36_010, 9_000)] and found[1][4] == " ".join(long)
    assert found[2][2] == [(0, 60_000, 1)] and found[2][4] == "la"


def test_runs_of_one_period_only_are_refused(spark):
    with pytest.raises(ValueError):
        periodic.periodic_runs(frame(spark, ROWS), exponent=1)


def test_query_of_runs(spark, tmp_path):
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e é"]) for _ in range(rng.randint(0, 60)))) for i in range(300)] + \
        [(400 + i, t) for i, t in ROWS if len(t or "") < 20_000] + [(None, "a b c")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words = plain.blank_words(text) if i is None else plain.planted_words(i, text)
        found = plain.runs(words, 6, 4)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        want.append((i, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
                     plain.sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), plain.sha(" ".join(plain.collapsed(words, found)))))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert table(queries.QUERIES["op11_recompression_runs"](spark, str(tmp_path)), *columns) == sorted(want, key=repr)
    assert sum(w[1] for w in want if w[0] is not None and w[0] < 300) > 5
