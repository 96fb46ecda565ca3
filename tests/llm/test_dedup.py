"""Exact, near and vector dedup against brute force, with odd inputs."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosemill.llm import near_dedup as near_dedup_module
from prosemill.llm.components import connected_components
from prosemill.llm.exact_dedup import RadixTrie, exact_dedup
from prosemill.llm.near_dedup import near_dedup
from prosemill.llm.vector_dedup import vector_dedup

ODD = [(900, None), (901, ""), (902, " \t\n"), (903, None), (904, "one"), (905, "One"), (906, "a b c"), (907, "a  b c"), (908, "É b c d e f"), (909, "é b c d e f"), (910, "x" * 200_000), (911, "y " * 60_000)]


def roots(n, links):
    up = list(range(n))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        up[find(a)] = find(b)
    return [find(k) for k in range(n)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 50)), max_size=30))
def test_trie(pairs):
    trie, want = RadixTrie(), {}
    for key, owner in pairs:
        trie.insert(key, owner, 1)
        low, n = want.get(key, (owner, 0))
        want[key] = (min(low, owner), n + 1)
    half = trie.held // 2
    some = list(trie.spill(half)) if half else []
    assert trie.held <= half and trie.held == sum(trie.weight.values())
    rest = list(trie.spill())
    assert {k: (t[0], t[1]) for k, t in some + rest} == want and trie.held == 0 and len(some) + len(rest) == len(want)


def test_trie_counts_nodes():
    trie = RadixTrie()
    for k in range(2000):
        trie.insert(b"%04d" % k, k, 1)
    assert trie.held > 2000 * 500


def test_exact_by_row(rows_of):
    rows = [(1, "a"), (2, "b"), (2, "a"), (None, "c"), (None, "c"), (5, "b"), (2, "b")]
    docs = rows_of(rows, 1).withColumn("v", F.monotonically_increasing_id())
    numbered = {r.v: (r.doc_id, r.text) for r in docs.collect()}
    got = exact_dedup(docs, row_col="v").collect()
    assert sorted(r.v for r in got) == sorted(numbered)
    least = {}
    for v, (i, t) in numbered.items():
        least[t] = min(least.get(t, (1 << 63, 0)), ((1 << 63) - 1 if i is None else i, v))
    assert {r.v for r in got if r.kept} == {v for _, v in least.values()}


def test_exact(rows_of):
    r = random.Random(3)
    rows = [(k, r.choice(["a b", "a  b", "a\tb", "a b ", "c", f"own {k}"])) for k in range(300)] + ODD + [(5, "c"), (None, "c"), (None, "alone"), (None, "alone")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids, default=None)
        want.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    for most in (64 << 20, 5000, 100):
        assert sorted(map(tuple, exact_dedup(rows_of(rows), most_bytes=most).collect()), key=str) == sorted(want, key=str)
    assert exact_dedup(rows_of([])).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    ids = [i if i is not None else 1 << 63 for i, _ in rows]
    low = {}
    for k, x in enumerate(root):
        low[x] = min(low.get(x, 1 << 63), ids[k])
    return sorted(((i, len(sets[k]), low[root[k]] if low[root[k]] < 1 << 63 else None, ids[k] == low[root[k]]) for k, (i, _) in enumerate(rows)), key=str)


def test_near(rows_of):
    r = random.Random(5)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 40))
    passage = [word() for _ in range(60)]
    rows = []
    for base in range(25):
        text = [word() for _ in range(r.choice([3, 6, 12, 30, 36, 40, 120, 400]))]
        if base % 4 == 0:
            text = passage + text
        for _ in range(r.randint(1, 7)):
            copy = list(text)
            for _ in range(r.randint(0, max(1, len(copy) // 60))):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), r.choice([" ", "\n"]).join(copy)))
    rows += ODD[:-2] + [(3, rows[40][1]), (None, rows[7][1]), (None, "all by itself here"), (None, None)]
    want = near_brute(rows)
    assert sorted(map(tuple, near_dedup(rows_of(rows)).collect()), key=str) == want
    assert sorted(map(tuple, near_dedup(rows_of(rows), tile=3).collect()), key=str) == want


def test_near_families(rows_of):
    """Families of near copies that lie close to one another, some with a link between them and most without."""
    r = random.Random(12)
    rows = []
    for family in range(6):
        text = [f"f{family}w{r.randint(0, 9999)}" for _ in range(300)]
        for relative in range(6):
            words = list(text)
            for k in range(relative * 4):
                words[(k * 53) % 300] = f"r{relative}x{k}y{r.randint(0, 9)}"
            for _ in range(r.randint(1, 9)):
                copy = list(words)
                copy[r.randrange(300)] = f"own{len(rows)}"
                rows.append((len(rows), " ".join(copy)))
    r.shuffle(rows)
    want = near_brute(rows)
    assert 6 < len({x[2] for x in want}) < len(rows) // 3
    for tile in (4096, 5):
        assert sorted(map(tuple, near_dedup(rows_of(rows), tile=tile).collect()), key=str) == want


def test_near_passages_do_not_link(rows_of):
    r = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(k, f"{passage} " + " ".join(f"w{r.randint(0, 9999)}" for _ in range(90))) for k in range(150)]
    got = near_dedup(rows_of(rows)).collect()
    assert all(x.kept for x in got)


def test_near_texts_are_hashed_together():
    texts = ["", None, " ", "a", "A b", "a b c d", "a b c d e", "A  B\tc\nd\x0be\x0cf\r g", " lead", "x y   z É é v w", "a a a a a a a", "\x1c \x85 \x00 [ @", "Z z { q r s"] * 3
    for size in (1, 5, len(texts)):
        got = [h for k in range(0, len(texts), size) for h in near_dedup_module.shingle_sets(texts[k : k + size])]
        name = {}
        for t, h in zip(texts, got, strict=True):
            w = (t or "").encode().lower().split()
            want = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            assert len(h) == len(want) and (np.diff(h.astype(object)) > 0).all()
            assert name.setdefault(frozenset(want), h.tobytes()) == h.tobytes()
        assert len(set(name.values())) == len(name)


def test_near_lists_are_told_together(monkeypatch):
    """Candidates of short and long lists that span batches, against pairs one by one; short lists make no blocks of their own."""
    rng, rows = np.random.default_rng(3), []
    names = ["v", "tile", "key", "part", "n", "mask", "side", "sketch"]
    for v in range(60):
        n = int(rng.choice([1, 2, 3, 6, 14]))
        for key in rng.choice(300, n, replace=False).tolist():
            sketch = sorted({v * 1000, *(int(x) for x in rng.integers(0, 60, 3))} | set(range(100, 100 + int(rng.integers(9, 20)))))
            rows.append((v * 1000, v % 2, key, key % 4, len(sketch), int(rng.integers(0, 1 << len(sketch))) & 0xF, 2 if v % 3 else key % 2, sketch))

    def told(best):
        found = []
        for v in sorted({r[0] for r in rows}):
            for x in (r for r in rows if r[0] == v):
                partners = []
                for y in (r for r in rows if r[0] == v and r[2] < x[2]):
                    if min(x[4], y[4]) < 0.85 * max(x[4], y[4]):
                        continue
                    common = len(set(x[7]) & set(y[7]) & set(sorted(set(x[7]) | set(y[7]))[:32]))
                    if common < min(math.ceil(0.85 * r[4]) for r in (x, y)):
                        continue
                    before = [{s for k, s in enumerate(r[7]) if r[5] >> k & 1 and s < v} for r in (x, y)]
                    if best:
                        partners.append((-common, y[2]))
                    elif x[3] != y[3] and (x[6] != y[6] or x[6] == 2) and not before[0] & before[1]:
                        found.append((y[2], x[2], y[3], x[3]))
                if partners:
                    common, y = min(partners)
                    found.append((y, x[2], -common))
        return sorted(found)

    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    for best in (True, False):
        want = told(best)
        assert len(want) > 50
        for block, pairs, step in ((64, 20_000, len(rows)), (64, 20_000, 7), (3, 10, 5), (64, 5, 1)):
            monkeypatch.setattr(near_dedup_module, "_BLOCK", block)
            monkeypatch.setattr(near_dedup_module, "_PAIRS", pairs)
            got = near_dedup_module._lists(best, 0.85)(whole.slice(k, step) for k in range(0, len(rows), step))
            assert sorted(r for b in got for r in zip(*(c.to_pylist() for c in b.columns), strict=True)) == want
    calls, common = [], near_dedup_module._common
    monkeypatch.setattr(near_dedup_module, "_PAIRS", 20_000)
    monkeypatch.setattr(near_dedup_module, "_common", lambda a, b, most: (calls.append(len(a)), common(a, b, most))[1])
    assert len(list(near_dedup_module._lists(True, 0.85)(iter([whole])))) and len(calls) <= 2


def test_near_empty(rows_of):
    assert near_dedup(rows_of([])).count() == 0
    assert [tuple(x) for x in near_dedup(rows_of([(1, None)])).collect()] == [(1, 0, 1, True)]


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert connected_components(spark, spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vector_brute(rows):
    def ok(label, v):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cos(a, b):
        if len(a) != len(b):
            return 0.0
        a, b = ([Fraction(x) for x in v] for v in (a, b))
        dot, square = sum(x * y for x, y in zip(a, b, strict=True)), sum(x * x for x in a) * sum(x * x for x in b)
        return math.sqrt(dot * dot / square) * (1 if dot > 0 else -1)

    links = [(a, b) for a in range(len(rows)) for b in range(a) if ok(*rows[a][1:]) and ok(*rows[b][1:]) and rows[a][1] == rows[b][1] and cos(rows[a][2], rows[b][2]) >= 0.93]
    root, n = roots(len(rows), links), [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    low = {}
    for k, x in enumerate(root):
        low[x] = min(low.get(x, 1 << 63), rows[k][0])
    return sorted((i, n[k], low[root[k]], i == low[root[k]]) for k, (i, _, _) in enumerate(rows))


def test_vectors(spark):
    r = random.Random(2)
    rows = []
    for c in range(12):
        centre = [r.gauss(0, 1) for _ in range(6)]
        for _ in range(r.randint(1, 25)):
            rows.append((len(rows), c % 3, [x + r.gauss(0, 0.2) for x in centre]))
    rows += [(1000, 0, rows[0][2]), (1001, 0, rows[0][2]), (1002, 0, [2 * x for x in rows[0][2]]), (1003, None, rows[0][2]), (1004, 0, None), (1005, 0, [0.0] * 6), (1006, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(1007, 0, [float("nan")] * 6), (1008, 0, [float("inf")] + [0.0] * 5), (1009, 0, [1.0, 2.0]), (1010, 0, []), (1011, 1, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (1012, 1, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(2000, 0, [1e200, 1e200]), (2001, 0, [1.0, 1.0]), (2002, 1, [1e-200, 1e-200]), (2003, 1, [1.0, 0.1]), (2004, 1, [0.1, 1.0]), (2005, 2, [1.0, 2.0, 3.0]), (2006, 2, [1.0, 2.0, 3.0]), (2007, 2, [5e-324, 1e-323]), (2008, 2, [1.0, 2.0])]
    rows += [(2009, 0, [1.79e308, 0.0, 1.79e308]), (2010, 0, [3.0, 0.0, 3.0]), (2011, 0, [7.0]), (2012, 0, [0.5]), (2013, 0, [-7.0])]
    df = spark.createDataFrame([(*x, 1, True) for x in rows], "vec_id bigint, label int, embedding array<double>, key int, kept boolean")
    want = vector_brute(rows)
    for block, leaf in ((2048, 128), (16, 4)):
        assert sorted(map(tuple, vector_dedup(df, block=block, leaf=leaf).collect())) == want
    assert sorted(map(tuple, vector_dedup(df, block=4, leaf=2, group=2, region=2).collect())) == want
    assert vector_dedup(df.filter("false")).count() == 0
    assert [tuple(x) for x in vector_dedup(df.filter("vec_id = 1004")).collect()] == [(1004, 0, 1004, True)]
