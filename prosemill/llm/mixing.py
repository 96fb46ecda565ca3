"""Mixing sources to target weights by balanced (cube-method) sampling.

Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the total size by
weight; a target above three times its source's size is cut there and the excess shared anew.
A source's ratio target / size is its copies' whole part, which every document gets, and a
fraction: the inclusion probability of one copy more.

The cube method (Deville and Tille, 2004; the fast flight phase of Chauvet and Tille, 2006) moves
these probabilities, three documents at a time, along the null-space of two constraints, the
number of documents and the total of tokens, until at most ``LANDING`` fractions are left: of the
documents that are still open the three longest fly, so that short ones stay to land with. Each
chunk of a source flies by itself in a stream with ``RESERVE`` documents in memory, so a source
with a third of all rows is many tasks; the fractions left over by chunks fly together (``RESERVE`` for
each chunk and source at most), and the last of a source land on the choice nearest its totals, found by
trying all. Where one document is so long that no choice comes near the source's tokens, the other
documents that were left over by chunks take more or fewer copies, longest first, to make up for it.

All choices are keyed hashes of ``seed`` and the document: reruns agree. Results: doc_id, source,
size, source_size, target, copies and taken (copies * size). Cases: a null text has size 0 and
takes nothing; a source of empty texts has target 0. A document longer than its source's target is left out or
taken, whichever brings the source nearer. Null sources are one source. A null
doc_id is one more document. Repeated rows are separate documents of equal key. Empty table: no rows.
The table of sources, one row each, is on the driver.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import Scratch, count_words, parallelism, table
from prosemill.sources.scan import spread

_M = (1 << 64) - 1
_CLOSE = 1e-9
#: Units that land together: all 2 ** LANDING choices are tried.
LANDING = 14
#: Open units that a chunk of a source leaves at most to the source's own flight.
RESERVE = 64


def targets(sizes: list[tuple[str | None, int]], most: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Target of each source from (source, size)."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: float(cycle[k % len(cycle)]) for k, (s, _) in enumerate(order)}
    size = {s: float(n) for s, n in order}
    out: dict[str | None, float] = {}
    rest, open_ = float(sum(size.values())), [s for s, _ in order]
    while open_:
        per = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if per * weight[s] > most * size[s]]
        if not over:
            return out | {s: per * weight[s] for s in open_}
        for s in over:
            out[s] = most * size[s]
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _uniform(key: int) -> float:
    """A number in [0, 1) from a key (splitmix64)."""
    z = (key + 0x9E3779B97F4A7C15) & _M
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def _step(pool: list[list]) -> None:
    """Moves the probabilities of up to three units [p, size, key, row] along the constraints' null-space."""
    if len(pool) == 3:
        a, b, c = (u[1] for u in pool)
        way = [c - b, a - c, b - a] if not a == b == c else [1.0, -1.0, 0.0]
    else:
        way = [1.0, -1.0]
    up = min((1 - u[0]) / w if w > 0 else u[0] / -w for u, w in zip(pool, way, strict=True) if w)
    down = min(u[0] / w if w > 0 else (1 - u[0]) / -w for u, w in zip(pool, way, strict=True) if w)
    key = pool[0][2]
    for u in pool[1:]:
        key = (key * 0x100000001B3 ^ u[2]) & _M
    move = up if _uniform(key) * (up + down) < down else -down
    for u, w in zip(pool, way, strict=True):
        u[0] += move * w
        u[0] = 0.0 if u[0] < _CLOSE else 1.0 if u[0] > 1 - _CLOSE else u[0]


def fly(units: Iterator[list], most_left: int = 2) -> Iterator[list]:
    """Flight phase: yields units as they are decided (p 0 or 1), at last those that stay fractional, ``most_left`` at most."""
    pool: list[list] = []  # longest first
    for unit in units:
        if unit[0] in (0.0, 1.0):
            yield unit
            continue
        insort(pool, unit, key=lambda u: (-u[1], u[2]))
        while len(pool) > max(2, most_left):
            _step(pool[:3])
            yield from (u for u in pool[:3] if u[0] in (0.0, 1.0))
            pool[:3] = [u for u in pool[:3] if u[0] not in (0.0, 1.0)]
    while len(pool) == 2 and pool[0][1] == pool[1][1]:
        _step(pool)
        yield from (u for u in pool if u[0] in (0.0, 1.0))
        pool = [u for u in pool if u[0] not in (0.0, 1.0)]
    yield from pool


def land(pool: list[list], slack: float = 0.0) -> None:
    """Landing: of all choices for the last units, the one nearest the documents among those within ``slack`` of the tokens they stand for.

    Where none is that near, the one nearest the tokens.
    """
    if not pool:
        return
    p, size = np.array([u[0] for u in pool]), np.array([u[1] for u in pool])
    choices = np.arange(1 << len(pool))[:, None] >> np.arange(len(pool)) & 1
    off = np.abs(choices @ size - p @ size)
    best = np.lexsort((off, np.abs(choices.sum(axis=1) - p.sum()), np.maximum(off, slack)))[0]
    for x, u in zip(choices[best], pool, strict=True):
        u[0] = float(x)


def settle(units: list[list], most: float, near: float = 0.002) -> None:
    """Flight and landing of a source's left-over units [p, size, key, row]; a row has target and whole copies.

    Where the landing misses the tokens that the units stand for by more than ``near`` of the target, units take
    other numbers of copies: p becomes the number added to the whole copies, which may be more than 1 or below 0.
    """
    goal = sum(u[0] * u[1] for u in units)
    left = list(fly(iter(units), LANDING))  # decided ones too: all have their p changed in place
    open_ = [u for u in left if u[0] not in (0.0, 1.0)]
    slack = near * (units[0][3][4] if units else 0)
    land(open_, slack / 2)

    def mended(start: list[float]) -> tuple[float, list[float]]:
        p, off = list(start), goal - sum(x * u[1] for x, u in zip(start, units, strict=True))
        for k in sorted(range(len(units)), key=lambda k: (-units[k][1], units[k][2])):
            if abs(off) <= slack or not units[k][1]:
                continue
            whole = units[k][3][5]
            step = min(max(int(off / units[k][1]), -whole - int(p[k])), int(most) - whole - int(p[k]))
            p[k] += step
            off -= step * units[k][1]
        return abs(off), p

    landed = [u[0] for u in units]
    tries = [mended(landed)]
    if tries[0][0] > slack and open_:  # the longest open document on the other side
        longest = max(range(len(units)), key=lambda k: (any(u is units[k] for u in open_), units[k][1]))
        tries.append(mended([1 - x if k == longest else x for k, x in enumerate(landed)]))
    for u, x in zip(units, min(tries, key=lambda t: t[0])[1], strict=True):
        u[0] = float(x)


_NAMES = ("doc_id", "source", "size", "source_size", "target", "whole", "p", "key")
_KIND = "doc_id bigint, source string, size bigint, source_size bigint, target double, whole bigint, p double, key bigint"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("whole", pa.int64()), ("p", pa.float64()), ("key", pa.int64())])


def _flight(group: tuple[str, ...], last: bool, most: float):
    """Flies each group of rows in a stream sorted by group and key. last: groups are bounded, and what is left lands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*group, *_NAMES)]
                yield from zip(*columns, strict=True)

        def groups() -> Iterator[list]:
            for _, members in groupby(rows(), key=lambda r: r[: len(group)]):
                units = ([r[len(group) + 6], float(r[len(group) + 2]), r[-1] & _M, r[len(group) :]] for r in members)
                if not last:
                    yield from fly(units, RESERVE)
                    continue
                some = list(units)
                settle(some, most)
                yield from some

        held: list[tuple] = []
        for p, _, _, row in groups():
            held.append((*row[:6], p, row[7]))
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 3.0, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each document; see the module."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    light = scratch.keep(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size")))
    totals = [(r.source, r.n) for r in light.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    goal = targets(totals, most)
    rows = []
    for s, n in totals:
        ratio = min(goal[s] / n, most) if n else 0.0
        whole = int(ratio + _CLOSE)
        part = ratio - whole
        rows.append((s, n, goal[s], whole, part if part > _CLOSE else 0.0))
    by_source = spark.createDataFrame(rows, "of string, source_size bigint, target double, whole bigint, p double")
    chunks = parallelism(spark)
    keyed = light.join(by_source, F.col("source").eqNullSafe(F.col("of"))).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size"))
    chunked = keyed.withColumn("chunk", F.pmod("key", F.lit(chunks)).cast("int"))
    spread = chunked.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "key", "doc_id")
    flown = scratch.keep(spread.mapInArrow(_flight(("source", "chunk"), False, most), _KIND))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    left = flown.filter(open_).repartition("source").sortWithinPartitions("source", "key", "doc_id")
    decided = flown.filter(~open_).unionAll(left.mapInArrow(_flight(("source",), True, most), _KIND))
    copies = F.col("whole") + F.col("p").cast("bigint")
    return decided.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix_sources(spread(table(spark, sf_dir, "documents"), "doc_id")).select("doc_id", "size", "source_size", "target", "taken", "copies")
