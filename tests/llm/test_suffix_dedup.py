"""Operator 7 against a brute-force count of all 400-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stallboard.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, fp int, block string"


def brute(rows, length=S.LENGTH):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for r, d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((r[0], len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
    return sorted(out, key=str)


def word_text(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passage = word_text(rng, 120)
    edge = word_text(rng, 200).encode()[:400].decode(errors="ignore").ljust(400, "x")
    out = []
    for k in range(40):
        body = word_text(rng, rng.randint(5, 300))
        if k % 5 == 0:
            body = body[:rng.randint(0, 200)] + passage + body[200:]
        if k % 7 == 0:
            body = body + edge
        if k % 11 == 0:
            body = edge[:-1] + "y" + body
        out.append((k, body, 1, "b"))
    copy = word_text(rng, 150)
    out += [(100 + k, copy, None, None) for k in range(6)] + [(106, copy[:300], 0, "")]
    out += [(200, None, None, None), (201, "", 0, ""), (202, "abc" * 400, 1, "a"), (203, edge[:399], 1, "a"), (None, passage, 1, "n"),
            (204, "short copy", 1, "x"), (205, "short copy", 1, "x"), (100, copy, 9, "again"), (206, "é" * 250, 1, "z"), (3, "other text", 1, "r")]
    return out


def test_cover_holds_every_difference():
    c = S.cover()
    assert len(c) == 17 and {(a - b) % S.V for a in c for b in c} == set(range(S.V))


def test_equals_brute_force(spark, rows):
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA), block_bytes=5000).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_longer_strings(spark, rows):
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=500).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 500)


def test_long_texts_in_pieces(spark, rows):
    """Texts cut into pieces of 300 strings, also of exactly one and two pieces; matches cross the cuts."""
    more = rows + [(900 + n, rows[-2][1] + word_text(random.Random(8), 80).encode()[:n].decode(errors="ignore"), 0, "") for n in (99, 100, 101, 399, 400, 401)]
    for length in (S.LENGTH, 401):
        got = S.remove_repeats(spark.createDataFrame(more, SCHEMA), length=length, block_bytes=5000, piece_bytes=300).collect()
        assert sorted(map(tuple, got), key=str) == brute(more, length)
    data = np.arange(1700) % 251
    assert [len(p) for p in S.pieces(data, 400, 300)] == [699, 699, 699, 699, 500] and not S.pieces(data[:399], 400, 300)


def test_text_buffer_is_read_once(spark, rows):
    """The three passes share one exchange of the texts."""
    df = S.remove_repeats(spark.createDataFrame(rows, SCHEMA))
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
