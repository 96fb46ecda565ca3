"""MinHash near-dedup with bottom-k sketches of one hash function.

Each document is the set of its distinct word shingles, hashed by one 64-bit function.
The ``SKETCH`` smallest hashes are its sketch; a sketch of a smaller set is the whole set.

1. Equal sets collapse to one representative (128-bit digest of the full sorted set).
2. Inverted lists of retained values: values that one sketch alone holds can't match and
   are only counted. Of the rest each set enters the lists of its rarest values, as many
   as the prefix principle asks for: two sketches that share ``OVERLAP`` values also share
   one of the ``SKETCH - OVERLAP + 1`` rarest. A passage that very many documents share
   yields frequent values, which come last and mostly need no list.
3. Inside a list the union sketch of two sets estimates their overlap; a pair with fewer
   than ``OVERLAP`` of the union's k smallest values in common is dropped. At a true
   similarity of 0.85 that happens with a probability below 1e-10 a pair, at 0.80 below 1e-8.
4. Round one verifies for each set the pair with its best smaller candidate, which gives the components
   of a first forest. Lists of over ``tile`` sets are handled in buckets, and their components are joined by
   further rounds over one set a component.
5. Round two covers all other candidate pairs, but for those inside one component. A list tells a pair only if
   none of the smaller values that both sets are listed under told it before. Where two components have
   ``MANY`` pairs or more, the pair of their centres and the pairs of members with their own centre are verified
   first: Jaccard distance is a metric, so a pair whose centres lie too far apart is no link and needs no look.
   The rest is verified. So no link between components is lost, while families of copies aren't
   expanded into their pairs. Verification compares full sets: 100 * intersection >= percent * union.
6. Components of verified links; all documents of a collapsed set share its component.

Long lists are split in round two as well: sets of the commonest component and the others are cut into buckets, and
tiles of two buckets each are tasks of bounded size; pairs inside the commonest component have no tile.

Sets are compared by 64-bit hashes of shingles; two different shingles of one pair agree
with a probability of about n^2 / 2^64.

Cases: null and blank texts have an empty set (n_shingles 0) and link with nothing. With
fewer words than the shingle's, the whole sequence is the one shingle. A null doc_id takes
part under the largest possible id: it is never a component's name unless alone, and its
component is then null, kept true. Rows that repeat one doc_id take part each with its own
text; all of them are kept if the id names their component. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.llm.common import NULL_ID, Scratch, emit, table
from prosemill.llm.components import connected_components

WORDS = 5
SKETCH, OVERLAP = 32, 10
#: Candidate pairs of two components from which their centres are compared first.
MANY = 3
#: Bytes of text that are hashed together, if they are of more than one document.
_TOGETHER = 2_000_000


def _lowered(coded: bytes) -> np.ndarray:
    """Bytes of texts in lower case, as bytes.lower has it (ASCII alone)."""
    data = np.frombuffer(coded, np.uint8)
    return data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles. Letters and blanks are those of ASCII."""
    coded = [(t or "").encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = _lowered(b"".join(coded))
    solid = (data != 32) & ((data < 9) | (data > 13))
    upto = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
    # Each word with one blank behind it.
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    places = np.nonzero(solid & ~np.append(False, solid[:-1]))[0]
    n_words = np.diff(np.searchsorted(places, upto), prepend=0)
    offsets = np.append(0, np.nonzero(~solid[keep])[0] + 1)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep].tobytes())]).dictionary_encode()
    kinds, (_, bounds, blob) = found.dictionary, found.dictionary.buffers()
    assert kinds.offset == 0
    bounds, blob = np.frombuffer(bounds, np.int64)[: len(kinds) + 1].tolist() if len(kinds) else [0], bytes(blob or b"")
    w = np.fromiter((xxhash.xxh64_intdigest(blob[x : y - 1]) for x, y in zip(bounds, bounds[1:], strict=False)), np.uint64, len(kinds))[found.indices.to_numpy()]
    # Texts of fewer words have one shingle, of what there is; other shingles that reach into the next text go.
    sizes = np.where(n_words > 0, np.maximum(1, n_words - words + 1), 0)
    starts = np.cumsum(n_words) - n_words
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(sizes.sum())
    factor, padded = np.uint64(0x9E3779B97F4A7C15), np.append(w, np.zeros(words, np.uint64))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w), np.uint64)
        for k in range(words):
            h *= factor
            h += padded[k : k + len(w)] ^ np.uint64(k + 1)
        h = h[at]
        for text in np.nonzero((n_words > 0) & (n_words < words))[0].tolist():
            x = np.zeros(1, np.uint64)
            for k in range(n_words[text]):
                x = x * factor + (w[starts[text] + k] ^ np.uint64(k + 1))
            h[ends[text] - 1] = x[0] ^ np.uint64(0xA5A5_0000 + n_words[text])
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    bounds = [0, *ends.tolist()]
    for x, y in zip(bounds, bounds[1:], strict=False):
        h[x:y].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    h, bounds = h[new], np.append(0, np.cumsum(new))[bounds].tolist()
    return [h[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]


def _hashed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple]:
    """Rows of batches whose last column is a text, with the text's shingle hashes in its place."""
    for batch in batches:
        *others, texts = (c.to_pylist() for c in batch.columns)
        bytes_ = np.cumsum([0, *(len(t or "") for t in texts)])
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(bytes_, bytes_[a] + _TOGETHER, "right")) - 1)
            yield from zip(*(c[a:b] for c in others), shingle_sets(texts[a:b], words), strict=True)
            a = b


def _sketches(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, text_key, h in _hashed(batches, words):
            rows.append((doc_id, text_key, len(h), xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None, h[:SKETCH].view(np.int64).copy()))
            if len(rows) >= 5000:
                yield emit(rows, schema)
                rows = []
        yield emit(rows, schema)

    return run


def _least_overlap(n_shingles, share: float):
    """Values that two sketches of linked sets share at least; exact for sets that are sketched whole."""
    return F.when(n_shingles < SKETCH, F.greatest(F.lit(1), F.ceil(n_shingles * F.lit(share)))).otherwise(F.lit(OVERLAP)).cast("int")


_NONE = np.uint64(2**64 - 1)
_BLOCK = 64
#: Pairs that are looked at together.
_PAIRS = 20_000


def _common(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """For each row of two matrices of values: how many are in both and among the ``most`` smallest of the union."""
    both = np.concatenate([a, b], axis=1)
    both.sort(axis=1)
    same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
    rank = np.cumsum(np.concatenate([np.ones((len(both), 1), bool), ~same], axis=1), axis=1)[:, 1:]  # rank among distinct values
    return (same & (rank <= most)).sum(axis=1)


def _shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values that rows of a have in common with rows of b, for all pairs of rows."""
    values, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    code = code.reshape(-1, a.shape[1])
    grid = np.zeros((len(a) + len(b), len(values)), np.float32)
    np.put_along_axis(grid, code, 1, axis=1)
    grid[:, values == _NONE] = 0
    return grid[: len(a)] @ grid[len(a) :].T


class _Lists:
    """Sets of several lists, or of tiles of them, one list behind the other; within each in the order of their keys."""

    def __init__(self, number: np.ndarray, lists: np.ndarray, keys: np.ndarray, parts: np.ndarray, sizes: np.ndarray, masks: np.ndarray, sides: np.ndarray, values: np.ndarray, share: float):
        order = np.lexsort((keys, number))
        self.keys, self.parts, self.sizes, self.sides, self.values, self.share = keys[order], parts[order], sizes[order], sides[order], values[order], share
        # Values that a set is listed under and that come before this one.
        listed = (masks[order][:, None] >> np.arange(SKETCH) & 1).astype(bool) & (self.values < lists[order].view(np.uint64)[:, None])
        self.before = np.where(listed, self.values, _NONE)
        self.least = np.where(self.sizes < SKETCH, np.maximum(1, np.ceil(self.sizes * share - 1e-9)), OVERLAP)
        self.bounds = np.concatenate([[0], np.nonzero(np.diff(number[order]))[0] + 1, [len(order)]])

    def _fits(self, i: np.ndarray, j: np.ndarray, every: bool) -> np.ndarray:
        fits = np.minimum(self.sizes[i], self.sizes[j]) >= self.share * np.maximum(self.sizes[i], self.sizes[j]) - 1e-9
        if every:
            # side 2: pairs within the tile count as well
            fits &= (self.parts[i] != self.parts[j]) & ((self.sides[i] != self.sides[j]) | (self.sides[i] == 2))
        return fits

    def _candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[slice, slice] | None]]:
        """Rows i > j of one list each, in pieces of bounded size; the blocks that they make up in a list of over ``_BLOCK`` rows."""
        counts = np.diff(self.bounds)
        ahead = np.where(np.repeat(counts, counts) <= _BLOCK, np.arange(len(self.keys)) - np.repeat(self.bounds[:-1], counts), 0)
        upto = np.concatenate([[0], np.cumsum(ahead)])
        r = 0
        while r < len(ahead):
            until = max(r + 1, int(np.searchsorted(upto, upto[r] + _PAIRS, "right")) - 1)
            n = ahead[r:until]
            i = np.repeat(np.arange(r, until), n)
            # the k-th pair of row i is that with the k-th row of its list
            j = i - np.repeat(n, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            yield i, j, None
            r = until
        for k in np.nonzero(counts > _BLOCK)[0]:
            start, end = self.bounds[k : k + 2].tolist()
            for a in range(start, end, _BLOCK):
                for b in range(start, a + 1, _BLOCK):
                    i, j = np.meshgrid(np.arange(a, min(end, a + _BLOCK)), np.arange(b, min(end, b + _BLOCK)), indexing="ij")
                    yield i, j, (slice(a, min(end, a + _BLOCK)), slice(b, min(end, b + _BLOCK)))

    def pairs(self, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows i > j of candidates and their overlap. every: of different components, each told in its first list alone."""
        for i, j, block in self._candidates():
            fits = (j < i) & self._fits(i, j, every)
            if block and fits.sum() > 500:
                fits &= _shared_counts(self.values[block[0]], self.values[block[1]]) >= np.minimum(self.least[i], self.least[j])
            i, j = i[fits], j[fits]
            if not len(i):
                continue
            common = _common(self.values[i], self.values[j], SKETCH)
            good = common >= np.minimum(self.least[i], self.least[j])
            i, j, common = i[good], j[good], common[good]
            if every and len(i):
                new = _common(self.before[i], self.before[j], 2 * SKETCH) == 0
                i, j, common = i[new], j[new], common[new]
            if len(i):
                yield i, j, common

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each set of a list the candidate among smaller keys with the largest overlap, the smallest of these: keys a and b, overlap."""
        most, partner = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        for i, j, common in self.pairs(False):
            order = np.lexsort((j, -common, i))
            i, j, common = i[order], j[order], common[order]
            first = np.append(True, i[1:] != i[:-1])
            i, j, common = i[first], j[first], common[first]
            more = common > most[i]
            most[i[more]], partner[i[more]] = common[more], j[more]
        found = np.nonzero(most)[0]
        return self.keys[partner[found]], self.keys[found], most[found]


def _lists(best: bool, share: float):
    """Candidates from rows sorted by list and tile. best: for each set its best smaller partner; else all pairs between components."""
    names = ["a", "b", "common"] if best else ["a", "b", "part_a", "part_b"]

    def told(rows: list[np.ndarray], number: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of the rows of whole lists, those that hold more than one set."""
        several = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        if not several.any():
            return
        v, _, *others = (x[several] for x in rows)
        x = _Lists(number[several], v, *others, share)
        found = [x.best()] if best else ((x.keys[j], x.keys[i], x.parts[j], x.parts[i]) for i, j, _ in x.pairs(True))
        for columns in found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []  # pieces of the list that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(7)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            n = np.diff(ends)
            values = np.full((batch.num_rows, SKETCH), _NONE)
            values[np.arange(SKETCH) < n[:, None]] = flat[ends[0] : ends[-1]]
            rows = [*(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)), values]
            v, tile = rows[:2]
            change = np.nonzero((v[1:] != v[:-1]) | (tile[1:] != tile[:-1]))[0] + 1
            if waiting and (waiting[-1][0][-1], waiting[-1][1][-1]) != (v[0], tile[0]):
                whole = [np.concatenate(c) for c in zip(*waiting, strict=True)]
                yield from told(whole, np.zeros(len(whole[0]), np.int64))
                waiting = []
            if not len(change):
                waiting.append(rows)
                continue
            whole = [np.concatenate(c) for c in zip(*waiting, [c[: change[-1]] for c in rows], strict=True)]
            number = np.zeros(len(whole[0]), np.int64)
            number[change[:-1] + len(number) - change[-1]] = 1
            yield from told(whole, np.cumsum(number))
            waiting = [[c[change[-1] :] for c in rows]]
        if waiting:
            whole = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            yield from told(whole, np.zeros(len(whole[0]), np.int64))

    return run


def _verify(percent: int, words: int):
    """Distance and link of pairs, from rows sorted by (a, role): the centre's text first, then its partners'."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.float64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, centre = None, None
        for a, b, h in _hashed(batches, words):
            if b is None:
                now, centre = a, h
                continue
            assert a == now, "a pair's centre is missing"
            both = len(np.intersect1d(centre, h, assume_unique=True))
            whole = len(centre) + len(h) - both
            rows.append((a, b, 1 - both / whole, 100 * both >= percent * whole))
            if len(rows) >= 20000:
                yield emit(rows, schema)
                rows = []
        yield emit(rows, schema)

    return run


def _tiled(lists: DataFrame, sizes: DataFrame, tile: int, best: bool) -> DataFrame:
    """Rows of lists with tile and side. Long lists, those named in ``sizes``, go in buckets (best) or in tiles of two buckets."""
    short = lists.join(sizes.select("v"), "v", "left_anti").withColumns({"tile": F.lit(0).cast("bigint"), "side": F.lit(2)})
    bucket = lambda t: F.pmod(F.xxhash64("key"), t).cast("bigint")
    if best:
        long = lists.join(sizes, "v").withColumns({"tile": bucket(F.ceil(F.col("size") / tile)), "side": F.lit(2)})
        return short.unionByName(long.select(short.columns))
    here = lists.join(sizes.select("v", "size"), "v")
    by_part = here.groupBy("v", "part").agg(F.count("*").alias("n_part"), F.first("size").alias("size"))
    common = by_part.groupBy("v").agg(F.max(F.struct("n_part", "part")).alias("most"), F.first("size").alias("size"))
    shape = common.select("v", F.col("most.part").alias("main"), F.ceil(F.col("most.n_part") / tile).alias("t_main"), F.ceil((F.col("size") - F.col("most.n_part")) / tile).alias("t_rest"))
    long = here.join(shape, "v").filter("t_rest > 0")
    in_main = F.col("part") == F.col("main")
    own = F.when(in_main, bucket(F.col("t_main"))).otherwise(bucket(F.col("t_rest")))
    upto = lambda t: F.sequence(F.lit(0).cast("bigint"), t - 1)
    # kind 0: a bucket of the commonest component with one of the rest; kind 1: two buckets of the rest
    place = lambda kind, x, y: F.lit(kind << 60).cast("bigint") + x * F.lit(1 << 30) + y
    with_rest = F.transform(upto(F.col("t_rest")), lambda y: F.struct(place(0, F.col("own"), y).alias("tile"), F.lit(0).alias("side")))
    with_main = F.transform(upto(F.col("t_main")), lambda x: F.struct(place(0, x, F.col("own")).alias("tile"), F.lit(1).alias("side")))
    among = F.transform(upto(F.col("t_rest")), lambda y: F.struct(place(1, F.least(y, F.col("own")), F.greatest(y, F.col("own"))).alias("tile"), F.when(y == F.col("own"), 2).when(y > F.col("own"), 0).otherwise(1).alias("side")))
    spread = long.withColumn("own", own).withColumn("to", F.explode(F.when(in_main, with_rest).otherwise(F.concat(with_main, among)))).withColumns({"tile": F.col("to.tile"), "side": F.col("to.side")})
    return short.unionByName(spread.select(short.columns))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = WORDS, tile: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; documents link at a Jaccard similarity of ``percent`` % or more.

    percent: 80 or more; the sketch's error bounds are stated for that range. tile: sets that one bucket of a list holds.
    """
    if percent < 80:
        raise ValueError("the sketch is sized for similarities of 80 % or more")
    spark, share = docs.sparkSession, percent / 100
    scratch = Scratch(spark, "near")
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    light = scratch.keep(rows.mapInArrow(_sketches(words), "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, sketch array<bigint>"))
    # One row a distinct set: its own key, and the row whose text stands for it.
    stands = light.filter("n_shingles > 0").groupBy("digest", F.col("n_shingles").alias("n"), "sketch").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    sets = scratch.keep(stands.select("digest", "n", "sketch", "row.*", F.monotonically_increasing_id().alias("key")))

    values = sets.select("key", "n", F.posexplode("sketch").alias("pos", "v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    w = Window.partitionBy("key")
    size = F.least(F.col("n"), F.lit(SKETCH))
    rare = (
        values.join(shared, "v")
        .withColumn("alone", size - F.count("*").over(w))
        .withColumn("rank", F.row_number().over(w.orderBy("df", "v")))
        .filter(F.col("rank") <= size - _least_overlap(F.col("n"), share) + 1 - F.col("alone"))
        .groupBy("key").agg(F.sum(F.expr("shiftleft(1L, pos)")).alias("mask"), F.collect_list("v").alias("vs"))
    )
    listed = scratch.keep(rare.join(sets.select("key", "n", "sketch"), "key").select(F.explode("vs").alias("v"), "key", "n", "mask", "sketch"))
    wanted = sets.join(listed.select("key").distinct(), "key", "left_semi").select("key", "doc_id", "text_key")
    texts = scratch.keep(rows.join(wanted, ["doc_id", "text_key"]).select("key", "text").dropDuplicates(["key"]))
    long = scratch.keep(listed.groupBy("v").agg(F.count("*").alias("size")).filter(F.col("size") > tile))

    def in_lists(df: DataFrame, sizes: DataFrame, best: bool) -> DataFrame:
        kind = "a bigint, b bigint, common bigint" if best else "a bigint, b bigint, part_a bigint, part_b bigint"
        placed = _tiled(df, sizes, tile, best).select("v", "tile", "key", "part", "n", "mask", "side", "sketch")
        return placed.repartition("v", "tile").sortWithinPartitions("v", "tile").mapInArrow(_lists(best, share), kind)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = scratch.keep(pairs)  # read twice
        centres = pairs.select("a").distinct().join(texts, F.col("a") == F.col("key")).select("a", F.lit(None).cast("bigint").alias("b"), "text")
        partners = pairs.join(texts, F.col("b") == F.col("key")).select("a", "b", "text")
        spread = centres.unionAll(partners).repartition("a").sortWithinPartitions(F.col("a"), F.col("b").asc_nulls_first())
        return scratch.keep(spread.mapInArrow(_verify(percent, words), "a bigint, b bigint, distance double, linked boolean"))

    def best_pairs(df: DataFrame, sizes: DataFrame) -> DataFrame:
        return verified(in_lists(df, sizes, True).groupBy("b").agg(F.max_by("a", F.struct("common", -F.col("a"))).alias("a")).select("a", "b"))

    links = best_pairs(listed.withColumn("part", F.col("key")), long).filter("linked").select("a", "b")
    parted = lambda df, parts: df.join(parts, F.col("key") == F.col("node"), "left").withColumn("part", F.coalesce("component", "key")).drop("node", "component")
    parts = connected_components(spark, links)
    hot = long
    while not hot.isEmpty():  # one set a component of each long list, until no list of components is long
        some = parted(listed.join(hot.select("v"), "v"), parts).groupBy("v", "part").agg(F.min_by(F.struct("key", "n", "mask", "sketch"), "key").alias("row")).select("v", "row.*", "part")
        some = scratch.keep(some)
        sizes = scratch.keep(some.groupBy("v").agg(F.count("*").alias("size")).filter("size > 1"))
        more = best_pairs(some, sizes).filter("linked").select("a", "b")
        before, hot = hot, scratch.keep(sizes.filter(F.col("size") > tile))
        if more.isEmpty() or not hot.join(before, ["v", "size"], "left_anti").head(1) and hot.count() == before.count():
            break
        links = scratch.keep(links.unionAll(more))
        parts = connected_components(spark, links)

    within = parted(listed, parts)
    mixed = within.groupBy("v").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("v")
    across = scratch.keep(in_lists(within.join(mixed, "v", "left_semi"), long, False))
    counted = across.groupBy(F.least("part_a", "part_b").alias("p"), F.greatest("part_a", "part_b").alias("q")).agg(F.count("*").alias("pairs"))
    many = scratch.keep(counted.filter(F.col("pairs") >= MANY).select("p", "q"))
    named = across.withColumns({"p": F.least("part_a", "part_b"), "q": F.greatest("part_a", "part_b")})
    single = named.join(many, ["p", "q"], "left_anti").select("a", "b")
    crowd = named.join(many, ["p", "q"])
    member = lambda k, part: crowd.filter(F.col(k) != F.col(part)).select(F.col(part).alias("a"), F.col(k).alias("b"))
    first = verified(single.unionAll(many.select(F.col("p").alias("a"), F.col("q").alias("b"))).unionAll(member("a", "part_a")).unionAll(member("b", "part_b")).distinct())
    from_centre = lambda k, name: first.select(F.col("a").alias(f"part_{k}"), F.col("b").alias(k), F.col("distance").alias(name))
    apart = first.select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("distance").alias("between"), F.col("linked").alias("centres"))
    judged = crowd.join(apart, ["p", "q"]).join(from_centre("a", "off_a"), ["part_a", "a"], "left").join(from_centre("b", "off_b"), ["part_b", "b"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    open_ = judged.filter(~F.col("centres") & (F.col("between") - zero("off_a") - zero("off_b") <= 1 - share + 1e-9)).join(first.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
    second = verified(open_.distinct())
    merged = connected_components(spark, links.unionAll(first.filter("linked").select("a", "b")).unionAll(second.filter("linked").select("a", "b")))
    named_sets = sets.select("digest", "key", "doc_id").join(merged, F.col("key") == F.col("node"), "left").withColumn("part", F.coalesce("component", "key"))
    least = named_sets.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of_set = named_sets.select("digest", "part").join(least, "part").select("digest", "component_id")
    found = light.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    real = lambda c: F.when(c < NULL_ID, c)
    return found.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-dedup of all documents at 85 %, shingles of five words."""
    return near_dedup(table(spark, sf_dir, "documents"))


#: Exact all-pairs similarity through shared shingles, in SQL.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (
  SELECT a.doc_id AS i, b.doc_id AS j FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))
), r AS (
  SELECT component.doc_id, component.root FROM (
    WITH RECURSIVE c(doc_id, root) AS (
      SELECT doc_id, doc_id FROM s UNION SELECT p.j, c.root FROM c JOIN p ON p.i = c.doc_id WHERE c.root < p.j
    ) SELECT doc_id, min(root) AS root FROM c GROUP BY 1) component
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, root AS component_id, s.doc_id = root AS kept FROM s JOIN r USING (doc_id)
"""
