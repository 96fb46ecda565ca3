"""Embedding near-dedup by an epsilon grid order join.

Vectors of one label and dimension link at a cosine of ``cosine`` or more. On unit vectors that is a
distance of at most epsilon = sqrt(2 - 2 * cosine). The epsilon grid order (Boehm et al., 2001)
sorts vectors by grid cells of side epsilon, here on the leading principal directions; intervals
of the sequence are joined recursively, and a pair of intervals whose boxes lie further apart
than epsilon in the projection is skipped, since a projection never lengthens a distance.

1. Equal vectors of a label collapse to one row with its number of copies.
2. Principal directions of the ``MOST_DIMS`` commonest dimensions: each task sums its second moments, a
   tree of sums adds them. Any other dimension takes its first coordinates: less is skipped, nothing lost.
3. Range partitioning on (label, dimension, cells) sorts the sequence; each task cuts it into blocks of
   ``block`` vectors, ``GROUP`` blocks to a group and ``REGION`` groups to a region, all with their boxes.
4. Boxes are joined from the top: near pairs of regions of a label, then near groups within them. Only
   regions are compared label by label, so a label of n vectors costs (n / (block * GROUP * REGION))^2 tests.
5. Blocks travel once for each near pair of groups, not of blocks. There halves of blocks are joined
   recursively down to ``leaf`` vectors, where cosines are computed in double precision. A pair of blocks
   returns link counts per vector and a spanning forest of its links, never all pairs.
6. Components of the forests.

A vector is divided by its largest magnitude before its length is taken, so neither overflows nor vanishes.

Cases: a vector that is null or empty, zero, or holds null or non-finite components links with nothing, and neither
does a null label; such rows are their own component and kept. Vectors of different dimensions don't link. A null
vec_id takes part under the largest id; its own component id is null. Repeated rows are copies of each other: each
has its row and counts the others as links. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import NULL_ID, Scratch, table, tree_sum, vector_row
from prosemill.llm.components import connected_components

DIRECTIONS = 6
#: Dimensions with principal directions, the commonest; blocks in a group, and groups in a region.
MOST_DIMS, GROUP, REGION = 8, 16, 256


def _matrix(rows: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one dimension from little-endian doubles in binary values."""
    return np.frombuffer(b"".join(rows.to_pylist()), "<f8").reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of doubles become binary values, alike for equal vectors: the sign of a zero goes."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("embedding"))
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0, np.cumsum([0, *(len(x) for x in lists)])
        raw = flat.tobytes()
        body = pa.array([raw[8 * a : 8 * b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int32)), body], names=["vec_id", "label", "dim", "body"])


def _moments(dims: list[int]):
    """Second moments of unit vectors of each dimension, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros((d, d)) for d in dims}
        for batch in batches:
            of = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in set(of.tolist()) & set(dims):
                x = _unit(_matrix(batch.column("body").take(pa.array(np.nonzero(of == d)[0])), d))
                total[d] += x.T @ x
        yield vector_row(np.concatenate([total[d].reshape(-1) for d in dims]))

    return run


class _Axes(dict):
    """Orthonormal directions of each dimension; coordinates where none were fitted."""

    def __missing__(self, dim: int) -> np.ndarray:
        self[dim] = np.eye(dim, min(DIRECTIONS, dim))
        return self[dim]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors on the directions, with zeros up to ``DIRECTIONS``."""
        out = np.zeros((len(x), DIRECTIONS))
        axes = self[x.shape[1]]
        out[:, : axes.shape[1]] = x @ axes
        return out


CELLS = [f"c{k}" for k in range(DIRECTIONS)]
LOW, HIGH = [f"l{k}" for k in range(DIRECTIONS)], [f"h{k}" for k in range(DIRECTIONS)]


def _projected(axes: _Axes, epsilon: float):
    """Adds the grid cells on the leading directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("dim").to_numpy(zero_copy_only=False)
            cells = np.zeros((len(of), DIRECTIONS), np.int32)
            for d in set(of.tolist()):
                at = np.nonzero(of == d)[0]
                cells[at] = np.floor(axes.project(_unit(_matrix(batch.column("body").take(pa.array(at)), d))) / epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, k]) for k in range(DIRECTIONS))], names=[*batch.schema.names, *CELLS])

    return run


_BLOCKS = pa.schema(
    [(n, pa.int64()) for n in ("label", "at", "grp", "region")] + [("dim", pa.int32())] + [(n, pa.float64()) for n in LOW + HIGH] + [(n, pa.binary()) for n in ("keys", "copies", "data")]
)
_BLOCK_KIND = ", ".join([*(f"{n} bigint" for n in ("label", "at", "grp", "region")), "dim int", *(f"{n} double" for n in LOW + HIGH), *(f"{n} binary" for n in ("keys", "copies", "data"))])


def _blocks(axes: _Axes, size: int, group: int, groups: int):
    """Cuts the sorted sequence of a task into blocks of one label and dimension; blocks, groups and regions are named by their first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0
        grp = region = count = 0

        def block() -> pa.RecordBatch:
            nonlocal grp, region, count
            keys, copies, data = (np.concatenate([h[k] for h in held]) for k in range(3))
            at = int(keys[0])
            grp = at if count % group == 0 else grp
            region = at if count % (group * groups) == 0 else region
            count += 1
            p = axes.project(_unit(data))
            row = (now[0], at, grp, region, now[1], *p.min(axis=0).tolist(), *p.max(axis=0).tolist(), keys.tobytes(), copies.tobytes(), data.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

        for batch in batches:
            label, dim, keys, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "dim", "key", "copies"))
            turns = np.nonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1]))[0] + 1
            for a, b in zip([0, *turns], [*turns, len(label)], strict=True):
                if a == b:
                    continue
                if now != (int(label[a]), int(dim[a])):
                    if n:
                        yield block()
                    now, held, n, count = (int(label[a]), int(dim[a])), [], 0, 0
                x = _matrix(batch.column("body").slice(a, b - a), now[1])
                while a < b:
                    end = min(b, a + size - n)
                    held.append((keys[a:end], copies[a:end], x[len(x) - (b - a) : len(x) - (b - end)]))
                    n, a = n + end - a, end
                    if n == size:
                        yield block()
                        held, n = [], 0
        if n:
            yield block()

    return run


def _sequence_join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, i: int, j: int, same: bool, cosine: float, epsilon: float, leaf: int, out: list) -> None:
    """Joins two intervals of the sequence; appends (i, j, link matrix) of leaves that hold links."""
    gap = np.maximum(0, np.maximum(pa_.min(axis=0) - pb.max(axis=0), pb.min(axis=0) - pa_.max(axis=0)))
    if (gap * gap).sum() > epsilon * epsilon:
        return
    if len(a) <= leaf and len(b) <= leaf:
        links = a @ b.T >= cosine
        if same:
            links = np.triu(links, 1)
        if links.any():
            out.append((i, j, links))
        return
    if same:
        m = len(a) // 2
        _sequence_join(a[:m], a[:m], pa_[:m], pa_[:m], i, i, True, cosine, epsilon, leaf, out)
        _sequence_join(a[:m], a[m:], pa_[:m], pa_[m:], i, i + m, False, cosine, epsilon, leaf, out)
        _sequence_join(a[m:], a[m:], pa_[m:], pa_[m:], i + m, i + m, True, cosine, epsilon, leaf, out)
    elif len(a) >= len(b):
        m = len(a) // 2
        _sequence_join(a[:m], b, pa_[:m], pb, i, j, False, cosine, epsilon, leaf, out)
        _sequence_join(a[m:], b, pa_[m:], pb, i + m, j, False, cosine, epsilon, leaf, out)
    else:
        m = len(b) // 2
        _sequence_join(a, b[:m], pa_, pb[:m], i, j, False, cosine, epsilon, leaf, out)
        _sequence_join(a, b[m:], pa_, pb[m:], i, j + m, False, cosine, epsilon, leaf, out)


def _join_blocks(ka: np.ndarray, ca: np.ndarray, a: np.ndarray, kb: np.ndarray, cb: np.ndarray, b: np.ndarray, same: bool, axes: _Axes, cosine: float, epsilon: float, leaf: int) -> tuple[np.ndarray, ...] | None:
    """Links between two blocks of keys, copies and unit vectors: keys with their link counts, keys with a root."""
    found: list = []
    _sequence_join(a, b, axes.project(a), axes.project(b), 0, 0, same, cosine, epsilon, leaf, found)
    if not found:
        return None
    # one index space: a's vectors, then b's (the same ones within one block)
    keys = ka if same else np.concatenate([ka, kb])
    shift = 0 if same else len(ka)
    n_links, root = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for i, j, m in found:
        n_links[i : i + m.shape[0]] += m @ cb[j : j + m.shape[1]]
        n_links[shift + j : shift + j + m.shape[1]] += ca[i : i + m.shape[0]] @ m
    moving = True
    while moving:
        moving = False
        for i, j, m in found:
            left, right = root[i : i + m.shape[0]], root[shift + j : shift + j + m.shape[1]]
            for mine, other, grid in ((left, right, m), (right, left, m.T)):
                best = np.where(grid, other[None, :], len(keys)).min(axis=1)
                if (best < mine).any():
                    np.minimum(mine, best, out=mine)
                    moving = True
        root = root[root]
    linked, tied = np.nonzero(n_links)[0], np.nonzero(root != np.arange(len(keys)))[0]
    return keys[linked], n_links[linked], keys[tied], keys[root[tied]]


def _join_tiles(axes: _Axes, cosine: float, epsilon: float, leaf: int):
    """Link counts (kind 0: key, count) and forests (kind 1: key, root), from blocks sorted by pair of groups and side.

    The first group of a pair is in memory, ``group`` blocks at most; the second one streams by.
    """
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now != (row["grp_a"], row["grp_b"]):
                    now, first = (row["grp_a"], row["grp_b"]), []
                data = _unit(np.frombuffer(row["data"], "<f8").reshape(-1, row["dim"]))
                own = (np.frombuffer(row["keys"], np.int64), np.frombuffer(row["copies"], np.int64), data)
                if row["side"] == 0:
                    first.append(own)
                partners = first if row["side"] or now[0] == now[1] else []
                for other in partners:
                    got = _join_blocks(*other, *own, other is own, axes, cosine, epsilon, leaf)
                    if got is not None:
                        linked, counts, tied, roots = got
                        kinds = np.repeat([0, 1], [len(linked), len(tied)]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([linked, tied])), pa.array(np.concatenate([counts, roots]))], schema=schema)

    return run


def _near(pairs: DataFrame, boxes: DataFrame, name: str, epsilon: float) -> DataFrame:
    """Pairs (x, y), x <= y, of boxes under pairs of parents (x, y) that are no further apart than epsilon; a box is ``name`` under ``up``."""
    named = lambda s: boxes.select(F.col("up").alias(s), F.col(name).alias(f"{s}{s}"), *(F.col(c).alias(f"{s}_{c}") for c in LOW + HIGH))
    gap = " + ".join(f"pow(greatest(0, x_{lo} - y_{hi}, y_{lo} - x_{hi}), 2)" for lo, hi in zip(LOW, HIGH, strict=True))
    both = pairs.join(named("x"), "x").join(named("y"), "y")
    return both.filter(F.expr(f"(x <> y OR xx <= yy) AND {gap} <= {epsilon * epsilon!r}")).select(F.col("xx").alias("x"), F.col("yy").alias("y"))


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, block: int = 2048, leaf: int = 128, group: int = GROUP, region: int = REGION) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector; see the module for the method and its cases."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    sound = F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    used = rows.filter(sound).mapInArrow(_packed, "vec_id bigint, label bigint, dim int, body binary")
    alone = rows.filter(~sound).select("vec_id", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("component"))
    real = lambda c: F.when(c < NULL_ID, c)
    epsilon = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9) + 1e-9

    stands = used.groupBy("label", "body").agg(F.first("dim").alias("dim"), F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    reps = scratch.keep(stands.withColumn("key", F.monotonically_increasing_id()))
    dims = [r.dim for r in reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_DIMS).collect()]
    axes = _Axes()
    if dims:
        moments = tree_sum(reps.select("dim", "body").mapInArrow(_moments(dims), "v binary"))
        for d, m in zip(dims, np.split(moments, np.cumsum([d * d for d in dims])[:-1]), strict=True):
            axes[d] = np.linalg.eigh(m.reshape(d, d))[1][:, ::-1][:, : min(DIRECTIONS, d)].copy()

    placed = reps.select("label", "dim", "key", "copies", "body").mapInArrow(_projected(axes, epsilon), "label bigint, dim int, key bigint, copies bigint, body binary, " + ", ".join(f"{c} int" for c in CELLS))
    order = ("label", "dim", *CELLS, "key")
    blocks = scratch.keep(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(axes, block, group, region), _BLOCK_KIND))

    boxes = lambda name, *up: blocks.groupBy(name, *up).agg(*(F.min(c).alias(c) for c in LOW), *(F.max(c).alias(c) for c in HIGH))
    groups = scratch.keep(boxes("grp", "region", "label", "dim"))
    tops = groups.groupBy("region", "label", "dim").agg(*(F.min(c).alias(c) for c in LOW), *(F.max(c).alias(c) for c in HIGH))
    # The label and dimension are one parent, told by the pair itself.
    parent = F.struct("label", "dim")
    pairs = _near(tops.select(parent.alias("x"), parent.alias("y")).distinct(), tops.select(parent.alias("up"), "region", *LOW, *HIGH), "region", epsilon)
    near = scratch.keep(_near(pairs, groups.select(F.col("region").alias("up"), "grp", *LOW, *HIGH), "grp", epsilon))
    body = blocks.select("grp", "at", "dim", "keys", "copies", "data")
    side = lambda s, at, which: which.join(body, F.col(at) == F.col("grp")).select(F.col("x").alias("grp_a"), F.col("y").alias("grp_b"), F.lit(s).alias("side"), "at", "dim", "keys", "copies", "data")
    tiles = side(0, "x", near).unionAll(side(1, "y", near.filter("x <> y"))).repartition("grp_a", "grp_b").sortWithinPartitions("grp_a", "grp_b", "side", "at")
    found = scratch.keep(tiles.mapInArrow(_join_tiles(axes, cosine, epsilon, leaf), "kind int, key bigint, value bigint"))
    counts = found.filter("kind = 0").groupBy("key").agg(F.sum("value").alias("others"))
    merged = connected_components(spark, found.filter("kind = 1").select(F.col("key").alias("a"), F.col("value").alias("b")))
    named_reps = reps.join(merged, F.col("key") == F.col("node"), "left").withColumn("part", F.coalesce("component", "key")).drop("component")
    least = named_reps.groupBy("part").agg(F.min("least_id").alias("component"))
    whole = named_reps.join(least, "part").join(counts, "key", "left")
    of_vector = whole.select("label", "body", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    linked = used.join(of_vector, ["label", "body"]).select("vec_id", "n", "component")
    component = F.coalesce("component", "vec_id")
    return linked.unionAll(alone).select(real(F.col("vec_id")).alias("vec_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), real(component).alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-dedup of all embeddings within their labels at a cosine of 0.93."""
    return vector_dedup(table(spark, sf_dir, "embeddings"))


#: All pairs of a label, and components by recursion; for small tables.
ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), ok AS (
  SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93
), c(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT p.j, c.root FROM c JOIN p ON p.i = c.vec_id WHERE c.root < p.j
), r AS (SELECT vec_id, min(root) AS root FROM c GROUP BY 1),
d AS (SELECT i, count(*) AS n FROM p GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, root AS component_id, e.vec_id = root AS kept
FROM e JOIN r USING (vec_id) LEFT JOIN d ON d.i = e.vec_id
"""
