"""Suffix-array dedup against a brute-force table of all strings."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prosemill.llm.suffix_dedup import _depths, refined, suffix_dedup


def brute(rows, length):
    owner = {}
    for doc_id, text in rows:
        body, mine = (text or "").encode(), (1 << 63) - 1 if doc_id is None else doc_id
        for p in range(len(body) - length + 1):
            s = body[p : p + length]
            owner[s] = min(mine, owner.get(s, mine))
    out = []
    for doc_id, text in rows:
        body, mine = (text or "").encode(), (1 << 63) - 1 if doc_id is None else doc_id
        gone = [False] * len(body)
        for p in range(len(body) - length + 1):
            if owner[body[p : p + length]] < mine:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "é", "omega", "x"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [line(25) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [line(r.randint(1, 30))]
        for s in r.sample(shared, r.randint(0, 2)):
            cut = r.randint(0, len(s) - 60) if len(s) > 60 else 0
            parts += [s[cut : cut + r.randint(48, 90)], line(r.randint(0, 8))]
        rows.append((k, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = texts(seed)
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "a" * 130), (105, "a" * 70 + "b"), (106, "ab" * 80), (107, "ab" * 40), (7, rows[9][1]), (108, "z" * 49), (109, "z" * 49)]
    rows += [(None, rows[0][1]), (None, rows[0][1])]
    got = suffix_dedup(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, batch int").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 50)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=3), min_size=1, max_size=25))
def test_refinement_orders_suffixes(rows):
    ids = refined(np.array(rows, np.uint64))
    order = sorted(set(map(tuple, rows)))
    assert ids.tolist() == [order.index(tuple(r)) for r in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=19, max_size=19).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=25))
def test_depths_tell_equal_prefixes(rows):
    for depth, ids in enumerate(_depths(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 19), 20)):
        assert all((ids[a] == ids[b]) == (rows[a][:depth] == rows[b][:depth]) for a in range(len(rows)) for b in range(a))


def test_long_repetitive_texts(spark):
    """One letter and short periods over megabytes: every position is an anchor, and contexts are few."""
    rows = [(1, "a" * 60), (2, "a" * 2_000_000), (3, "b" * 1_000_000), (4, "abc" * 500_000), (5, "abc" * 20 + "x"), (6, "b" * 300_000 + "c"), (7, None)]
    got = sorted(map(tuple, suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == brute(rows, 50)


def test_many_small_batches(spark):
    rows = texts(5)
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), batch_bytes=400)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 50)


def test_empty_table_and_text(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    body = "The quick brown fox jumps over the lazy dog, and then it rests a while."
    rows = suffix_dedup(spark.createDataFrame([(1, body), (2, "x" + body + "y")], "doc_id bigint, text string"), with_text=True).collect()
    assert {r.doc_id: bytes(r.kept) for r in rows} == {1: body.encode(), 2: b"xy"}
