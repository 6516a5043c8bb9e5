"""Links between the tokens of two tokenizers, against a plain version."""

import random

import numpy as np
import public_tokenizers
import pytest

import plain_versions as plain
from millrace.llm import alignment, queries
from test_corpus import ODD, ROWS, frame, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
rng = random.Random(11)
STRANGE = [(i, t) for i, t in enumerate([
    " leading", "trailing ", "two  blanks   three", "a\u2581b c \u2581", "\u3000x \u3000 y\xa0 z \xa0w", "a\nb\t c\r\n d", "<s> </s> <unk> <0x41>",
    "<|endoftext|> the<|endoftext|>", "\x00 \x1f \x85 \u2028 x", "\U0001F600\U0001F600 \U0001F468\u200d\U0001F469 \ufeff", "1234567 89,5 \u00b2\u0661",
    "it's I'LL 's ' s", " ", "  ", "\n", "\ufb01 e\u0301 \u00e9 \u212b", "x" * 3000, "ab" * 2000 + " c", "\u00e9" * 700])]


def test_coalesced_groups_break_at_common_ends():
    r = np.random.default_rng(2)
    for _ in range(50):
        n = int(r.integers(1, 60))
        cuts = [np.union1d(r.choice(np.arange(1, n + 1), int(r.integers(1, n + 1))), [n]) for _ in range(2)]
        ends = np.intersect1d(*cuts)
        groups = alignment.coalesce(*[np.diff(c, prepend=0) for c in cuts])
        for c, g in zip(cuts, groups):
            assert g.tolist() == np.searchsorted(ends, c).tolist()


@pytest.mark.parametrize("block, at_once, links, remembered", [(16 << 20, 1 << 20, 1 << 21, 120_000), (300, 100, 5, 20)])
def test_alignment(spark, monkeypatch, block, at_once, links, remembered):
    for name, value in (("BLOCK_BYTES", block), ("AT_ONCE", at_once), ("LINKS", links)):
        monkeypatch.setattr(alignment, name, value)

    for rows in (ROWS, ODD, STRANGE):
        got = alignment.align_tokenizers(frame(spark, rows), A, B, keep_groups=True)
        assert table(got, *COLUMNS) == sorted([(*r[:7], r[7] or "") for r in plain.alignments(rows, A, B)], key=repr)
    assert table(alignment.align_tokenizers(frame(spark, []), A, B), *COLUMNS[:-1]) == []
    aligner = alignment.Aligner(A, B)
    assert aligner.cuts
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    texts = [" ".join(rng.choice(["the", "of,", "r\u00e9sum\u00e9", "x" * 70, "a\u2581", str(rng.randint(0, 999))]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    want = plain.alignments(list(enumerate(texts)), A, B)
    for at in range(0, 60, 5):
        part = alignment.align(aligner, [t.encode() for t in texts[at : at + 5]])
        assert part.groups == [w[7] for w in want[at : at + 5]]


def test_query_of_alignments(spark, tmp_path):
    frame(spark, ROWS + [(100 + i, t) for i, t in STRANGE]).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain.alignments(ROWS + [(100 + i, t) for i, t in STRANGE], A, B)
    got = queries.QUERIES["op13_interval_alignment"](spark, str(tmp_path))
    assert table(got, *COLUMNS[:-1], "groups_sha256") == sorted([(*r[:7], plain.sha(r[7]) if r[7] else "") for r in want], key=repr)
