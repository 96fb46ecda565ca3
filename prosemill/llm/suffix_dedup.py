"""Suffix-array dedup of repeated byte strings, by bucket-pointer refinement.

Every byte that lies in a ``length``-byte string which also starts in a document with a
smaller doc_id is removed. Bucket-pointer refinement (Schuermann and Stoye) sorts suffixes
into buckets by their first q bytes and refines a bucket by the bucket identifiers that
its suffixes have at later offsets. Here only one suffix per matched string is needed:

1. Anchors. With q + w - 1 = length, a string of ``length`` bytes holds w q-grams; the
   positions of its smallest q-gram hash are anchors. Equal strings choose equal anchors,
   so two copies of a string always meet in the bucket of an anchor's q-gram. About one
   position in w/2 is an anchor.
2. Buckets. Documents form batches (by hash of the id). A batch sends each distinct anchor
   hash to its bucket once, sorted and delta-coded; the bucket answers with the hashes that
   several batches hold. Anchors whose q-gram occurs in one document alone end here.
3. Refinement. For each remaining anchor a batch sends each distinct context (w - 1 bytes
   before, the q-gram, w - 1 after) once, with the smallest doc_id that has it. The anchor's q-gram is
   the initial bucket of its suffix. Behind it the context goes on in ``STEP``-byte grams, whose own buckets are
   the byte strings in order. From the last gram to the first, the bucket of the suffix at a gram is refined by
   sorting on the bucket identifier that the suffix has one gram later; that identifier is itself refined
   already, so each update is used again by the suffix before it, and buckets of one member
   aren't sorted any more. The same runs backwards on the bytes before the q-gram. Neighbours in the final
   order differ at one depth, which gives the bucket identifiers of every depth; the string at offset o is the pair
   (left identifier of depth o, right identifier of depth w - 1 - o). One more refinement, of the left bucket
   by the right identifier, yields the smallest owner of every string exactly.
4. Removal. The batch gets a bit mask per context, marks the strings and hashes what is left.

A passage that a third of all documents share costs one row entry per batch and bucket, not
one per document. Documents travel once, in compressed blobs by batch; the same exchange
serves anchors, contexts and removal.

Memory: batches and buckets are as many as the text's bytes ask for (``batch_bytes`` each), and a task takes
one at a time, so neither grows with the table; one document is never split, so a longer one is a batch by itself.
Anchors are looked at in slices of ``_SLICE``: a text of one letter or a short period, in which every
position is an anchor, holds few distinct contexts, and only those stay. A bucket holds all
contexts of its q-grams: a q-gram with very many different surroundings isn't split.

Results: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, the kept text.
Cases: a null text is empty; texts shorter than ``length`` keep all bytes. A null doc_id
counts as larger than all others. Rows that repeat a doc_id don't remove each other's bytes,
for neither id is smaller. Matches never cross documents. Empty table: no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import NULL_ID, parallelism, table

_PACKED = pa.schema([("batch", pa.int32()), ("blob", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("blob", pa.binary())])
_TOP = np.uint64(2**64 - 1)
_FLUSH = 24 << 20
_SLICE = 1 << 17
STEP = 8


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Compressed arrays; their types are the reader's knowledge."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(raw))


def _unpack(blob: bytes, *types: object) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, 1 + len(types))[1:]
    at, out = 8 * (1 + len(types)), []
    for size, kind in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _pack_sorted(values: np.ndarray) -> np.ndarray:
    """Sorted 32-bit values as byte planes of their differences, which compress well."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.copy().reshape(-1)


def _unpack_sorted(planes: np.ndarray) -> np.ndarray:
    steps = planes.reshape(4, -1).T.copy().reshape(-1).view("<u4")
    return np.cumsum(steps, dtype=np.uint64).astype(np.uint32)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of ``width`` values, by doubling."""
    out, done, step, size = None, 0, x, 1
    while width:
        if width & 1:
            if out is None:
                out, done = step, size
            else:
                n = len(x) - done - size + 1
                out = f(out[:n], step[done : done + n])
                done += size
        width >>= 1
        if width:
            n = len(x) - 2 * size + 1
            step = f(step[:n], step[size : size + n])
            size *= 2
    return out


def _gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Mixed 64-bit hashes of all q-grams."""
    out, done, size = None, 0, 1
    step, factor = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    n_all, left = len(data), q
    while left:
        if left & 1:
            if out is None:
                out, done = step, size
            else:
                n = n_all - done - size + 1
                out = out[:n] * factor + step[done : done + n]
                done += size
        left >>= 1
        if left:
            n = n_all - 2 * size + 1
            step = step[:n] * factor + step[size : size + n]
            factor, size = factor * factor, 2 * size
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


class _Batch:
    """Documents of one batch in a fixed order, joined to one byte array."""

    def __init__(self, blobs: list[bytes], length: int, n_buckets: int):
        ids, parts = [], []
        for blob in blobs:
            doc_ids, sizes, data = _unpack(blob, np.int64, np.int64, np.uint8)
            at = np.concatenate([[0], np.cumsum(sizes)])
            ids.extend(doc_ids.tolist())
            raw = data.tobytes()
            parts.extend(raw[at[k] : at[k + 1]] for k in range(len(sizes)))
        order = sorted(range(len(ids)), key=lambda k: (ids[k], len(parts[k]), parts[k]))
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.parts = [parts[k] for k in order]
        self.ends = np.cumsum([len(p) for p in self.parts])
        self.starts = self.ends - np.array([len(p) for p in self.parts], np.int64)
        self.w = length // 2
        self.q = length - self.w + 1
        self.length, self.n_buckets = length, n_buckets

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, hash and document index of the anchors, piece by piece of about a megabyte."""
        found, w, q = [], self.w, self.q
        first = 0
        n_docs = len(self.parts)
        while first < n_docs:
            last = int(np.searchsorted(self.ends, self.starts[first] + (1 << 20), "right"))
            last = min(n_docs, max(last, first + 1))
            base = int(self.starts[first])
            data = np.frombuffer(b"".join(self.parts[first:last]), np.uint8)
            if len(data) >= self.length:
                h = _gram_hashes(data, q)
                inner = self.ends[first : last - 1] - base  # q-grams over the end of a document don't count
                for k in range(1, q):
                    at = inner - k
                    at = at[(at >= 0) & (at < len(h))]
                    h[at] = _TOP
                low = _slide(h, w, np.minimum)
                edge = np.zeros(w - 1, np.uint64)
                high = _slide(np.concatenate([edge, low, edge]), w, np.maximum)
                at = np.nonzero((high == h) & (h != _TOP))[0]
                doc = np.searchsorted(self.ends, at + base, "right")
                long_enough = self.ends[doc] - self.starts[doc] >= self.length
                at, doc = at[long_enough], doc[long_enough]
                found.append((at + base, h[at], doc))
            first = last
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]

    def split(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and 32-bit rest of each hash."""
        return (h >> np.uint64(32)) % np.uint64(self.n_buckets), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def contexts(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Bytes around the anchors, zero beyond the document, then how many there are to the left and right."""
        side = self.w - 1
        width = self.q + 2 * side
        out = np.zeros((len(at), width + 2), np.uint8)
        if not len(at):
            return out
        left, right = np.minimum(side, at - self.starts[doc]), np.minimum(side, self.ends[doc] - at - self.q)
        lo, hi = int(doc.min()), int(doc.max()) + 1  # anchors come in the order of documents
        data = np.frombuffer(b"".join(self.parts[lo:hi]), np.uint8)
        step = np.arange(width) - side
        where = np.clip(at[:, None] - self.starts[lo] + step, 0, len(data) - 1)
        inside = (step >= -left[:, None]) & (step < self.q + right[:, None])
        out[:, :width] = np.where(inside, data[where], 0)
        out[:, width], out[:, width + 1] = left, right
        return out


def _packer(n_batches: int):
    """Documents to compressed blobs by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for batch in sorted(held):
                ids, bodies = held[batch]
                blob = _pack([np.array(ids, np.int64), np.array([len(b) for b in bodies], np.int64), np.frombuffer(b"".join(bodies), np.uint8)])
                yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int32()), pa.array([blob], pa.binary())], schema=_PACKED)
            held.clear()

        for piece in batches:
            ids, batch, bodies = piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2)
            for k in range(piece.num_rows):
                body = bodies[k].as_py()
                own = held.setdefault(batch[k], ([], []))
                own[0].append(ids[k])
                own[1].append(body)
                size += len(body)
                if size > _FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of each bucket in a sorted array."""
    starts = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0] if len(bucket) else np.empty(0, np.int64)
    yield from zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=False)


def _send_hashes(length: int, n_buckets: int):
    """Each bucket gets the distinct anchor hashes of a batch."""

    def run(t: pa.Table) -> pa.Table:
        number, own = t.column(0)[0].as_py(), _Batch(t.column(1).to_pylist(), length, n_buckets)
        _, h, _ = own.anchors()
        bucket, rest = own.split(h)
        keys = np.unique((bucket << np.uint64(32)) | rest)
        return _table([(b, number, _pack([_pack_sorted(keys[lo:hi].astype(np.uint32))])) for b, lo, hi in _runs(keys >> np.uint64(32))])

    return run


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT, strict=True)], schema=_SENT)


def _answer_hashes():
    """A batch's hashes that another batch holds too."""

    def run(t: pa.Table) -> pa.Table:
        bucket, batches = t.column(0)[0].as_py(), t.column(1).to_pylist()
        values = [_unpack_sorted(_unpack(b, np.uint8)[0]) for b in t.column(2).to_pylist()]
        everything = np.concatenate(values)
        everything.sort()
        twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
        rows = []
        for batch, own in zip(batches, values, strict=True):
            hit = own[np.isin(own, twice, assume_unique=True)]
            if len(hit):
                rows.append((bucket, batch, _pack([_pack_sorted(hit)])))
        return _table(rows)

    return run


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bytes in order, and the place of each row among them."""
    found, place = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").reshape(-1), return_inverse=True)
    return found.view(np.uint8).reshape(len(found), rows.shape[1]), place.reshape(-1)


def _chosen(own: _Batch, at: np.ndarray, h: np.ndarray, doc: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the anchors whose key is wanted: distinct (bucket, context) in order, the anchor's entry, position and document."""
    bucket, rest = own.split(h)
    key = (bucket << np.uint64(32)) | rest
    hit = np.isin(key, wanted)
    at, doc, key = at[hit], doc[hit], key[hit]
    parts, places, n = [], [], 0
    for k in range(0, max(1, len(at)), _SLICE):
        some = slice(k, k + _SLICE)
        # big-endian: entries sort by bucket
        found, place = _distinct(np.concatenate([key[some].astype(">u8").view(np.uint8).reshape(-1, 8), own.contexts(at[some], doc[some])], axis=1))
        parts.append(found)
        places.append((place + n).astype(np.int32))
        n += len(found)
    entries, again = _distinct(np.concatenate(parts))
    return entries, again[np.concatenate(places)], at, doc


def _send_contexts(length: int, n_buckets: int):
    """Each bucket gets a batch's distinct contexts with their smallest doc_id."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([])
        number, own = docs.column(0)[0].as_py(), _Batch(docs.column(1).to_pylist(), length, n_buckets)
        at, h, doc = own.anchors()
        bucket, rest = own.split(h)
        keys = (bucket << np.uint64(32)) | rest
        # known here: q-grams that several documents of this batch hold
        order = np.lexsort((own.ids[doc], keys)) if len(keys) else np.empty(0, np.int64)
        k, i = keys[order], own.ids[doc][order]
        here = np.unique(k[1:][(k[1:] == k[:-1]) & (i[1:] != i[:-1])]) if len(k) > 1 else np.empty(0, np.uint64)
        there = [
            (np.uint64(b) << np.uint64(32)) | _unpack_sorted(_unpack(blob, np.uint8)[0]).astype(np.uint64)
            for b, blob in zip(answers.column(0).to_pylist(), answers.column(2).to_pylist(), strict=True)
        ]
        wanted = np.unique(np.concatenate([here, *there]))
        entries, entry, _, doc = _chosen(own, at, h, doc, wanted)
        if not len(entries):
            return _table([])
        least = np.full(len(entries), NULL_ID, np.int64)
        np.minimum.at(least, entry, own.ids[doc])
        owner = entries[:, :4].copy().view(">u4").reshape(-1)
        rows = []
        for b, lo, hi in _runs(owner):
            grams = entries[lo:hi, 4:8].copy().view(">u4").reshape(-1).astype(np.uint32)
            rows.append((b, number, _pack([_pack_sorted(np.unique(grams)), least[lo:hi], entries[lo:hi, 8:].reshape(-1)])))
        return _table(rows)

    return run


def refined(grams: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the suffixes that start at the first column of grams (rows of integers), in lexical order.

    Bucket-pointer refinement from the last column back: a suffix's bucket, its own gram, is refined by the bucket identifier
    of the suffix one gram later. A suffix whose gram no other row has is alone in its bucket and isn't sorted further.
    """
    n, columns = grams.shape
    later = np.zeros(n, np.int64)  # identifiers of the suffixes one gram later; the empty suffix has one bucket
    for k in range(columns - 1, -1, -1):
        order = np.argsort(grams[:, k], kind="stable")
        gram = grams[order, k]
        first = np.concatenate([[True], gram[1:] != gram[:-1]])
        bucket = np.cumsum(first) - 1
        crowded = np.nonzero((np.bincount(bucket) > 1)[bucket])[0]  # members of buckets that aren't refined yet, together
        within = later[order[crowded]]
        finer = np.lexsort((within, bucket[crowded]))
        order[crowded] = order[crowded][finer]
        pointer, own = later[order], bucket
        ids = np.empty(n, np.int64)
        ids[order] = np.cumsum(np.concatenate([[True], (own[1:] != own[:-1]) | (pointer[1:] != pointer[:-1])])) - 1
        later = ids
    return later


def _depths(rows: np.ndarray, depths: int) -> list[np.ndarray]:
    """Bucket identifiers of the rows by their first 0, 1, ... ``depths`` - 1 bytes."""
    width = -(-rows.shape[1] // STEP) * STEP
    padded = np.zeros((len(rows), max(width, STEP)), np.uint8)
    padded[:, : rows.shape[1]] = rows
    suffix = refined(padded.view(">u8").astype(np.uint64))
    order = np.argsort(suffix, kind="stable")
    differ = np.empty(max(0, len(order) - 1), np.int32)
    for k in range(0, len(differ), 1 << 16):
        some = rows[order[k : k + (1 << 16) + 1]]
        unequal = some[:-1] != some[1:]
        differ[k : k + len(unequal)] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), rows.shape[1])
    out = []
    for depth in range(depths):
        ids = np.empty(len(order), np.int64)
        ids[order] = np.concatenate([[0], np.cumsum(differ < depth)]) if len(order) else 0
        out.append(ids)
    return out


def _answer_contexts(length: int):
    """For each context of a batch, the offsets at which a smaller document holds the same string."""
    w = length // 2
    q, side = length - w + 1, w - 1

    def run(t: pa.Table) -> pa.Table:
        bucket, batches = t.column(0)[0].as_py(), t.column(1).to_pylist()
        got = [_unpack(b, np.uint8, np.int64, np.uint8) for b in t.column(2).to_pylist()]
        width = q + 2 * side
        sizes = [len(least) for _, least, _ in got]
        least = np.concatenate([x[1] for x in got])
        rows = np.concatenate([x[2].reshape(-1, width + 2) for x in got])
        left, right = rows[:, width].astype(np.int64), rows[:, width + 1].astype(np.int64)
        # All depths go on from the anchor's q-gram, the initial bucket.
        _, gram = _distinct(rows[:, side : side + q])
        to_right = _depths(rows[:, side + q : width], side + 1)
        to_left = _depths(rows[:, :side][:, ::-1], side + 1)
        mask = np.zeros(len(rows), np.uint64)
        for o in range(side + 1):
            valid = np.nonzero((left >= o) & (right >= side - o))[0]
            if len(valid) < 2:
                continue
            left_id, right_id, own = to_left[o][valid], to_right[side - o][valid], gram[valid]
            order = np.lexsort((right_id, left_id, own))
            at = valid[order]
            left_id, right_id, own = left_id[order], right_id[order], own[order]
            starts = np.nonzero(np.concatenate([[True], (left_id[1:] != left_id[:-1]) | (right_id[1:] != right_id[:-1]) | (own[1:] != own[:-1])]))[0]
            lowest = np.minimum.reduceat(least[at], starts)
            lowest = np.repeat(lowest, np.diff(np.append(starts, len(at))))
            hit = at[least[at] > lowest]
            mask[hit] |= np.uint64(1) << np.uint64(o)
        out, at = [], 0
        for batch, size, (grams, _, _) in zip(batches, sizes, got, strict=True):
            out.append((bucket, batch, _pack([grams, mask[at : at + size]])))
            at += size
        return _table(out)

    return run


def _removal(length: int, n_buckets: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text)

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        own = _Batch(docs.column(1).to_pylist(), length, n_buckets)
        steps = np.zeros(int(own.ends[-1]) + 1, np.int32)
        if answers.num_rows:
            by_bucket = sorted(zip(answers.column(0).to_pylist(), answers.column(2).to_pylist(), strict=True))
            got = [(b, *_unpack(blob, np.uint8, np.uint64)) for b, blob in by_bucket]
            wanted = np.concatenate([(np.uint64(b) << np.uint64(32)) | _unpack_sorted(g).astype(np.uint64) for b, g, _ in got])
            mask = np.concatenate([m for _, _, m in got])
            at, h, doc = own.anchors()
            entries, entry, at, doc = _chosen(own, at, h, doc, np.unique(wanted))
            assert len(entries) == len(mask), "contexts and answers differ"
            least = np.full(len(entries), NULL_ID, np.int64)
            np.minimum.at(least, entry, own.ids[doc])
            side, width = own.w - 1, own.q + 2 * own.w - 2
            left, right = entries[entry, 8 + width].astype(np.int64), entries[entry, 9 + width].astype(np.int64)
            later = own.ids[doc] > least[entry]  # a smaller document of this batch has the whole context
            for o in range(side + 1):
                hit = (left >= o) & (right >= side - o) & (later | ((mask[entry] >> np.uint64(o)) & np.uint64(1) > 0))
                np.add.at(steps, at[hit] - o, 1)
                np.add.at(steps, at[hit] - o + length, -1)
        covered = np.cumsum(steps[:-1]) > 0
        rows = []
        for k, body in enumerate(own.parts):
            gone = covered[own.starts[k] : own.ends[k]]
            n = int(gone.sum())
            kept = body if not n else np.frombuffer(body, np.uint8)[~gone].tobytes()
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if n else 0
            doc_id = int(own.ids[k])
            rows.append((None if doc_id == NULL_ID else doc_id, len(body), n, spans, hashlib.sha256(kept).hexdigest(), *([kept] * with_text)))
        columns = list(zip(*rows, strict=True))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_text: bool = False, batch_bytes: int = 8 << 20) -> DataFrame:
    """What is left of each document; see the module for the columns and for null and empty cases.

    length: bytes of the shortest removed string, 16 to 128. batch_bytes: text of one batch, on average.
    """
    if not 16 <= length <= 128:
        raise ValueError("length has to lie between 16 and 128")
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    total = rows.agg(F.sum(F.octet_length("body").cast("bigint"))).first()[0] or 0
    least = parallelism(docs.sparkSession)
    n_batches = max(least, -(-total // batch_bytes))
    n_buckets = n_batches
    keyed = rows.select("doc_id", F.pmod(F.xxhash64("doc_id", F.octet_length("body")), F.lit(n_batches)).cast("int").alias("batch"), "body")
    # As many tasks as batches and buckets, so that a task's share stays the same at any size.
    by = lambda df, key: df.repartition(n_batches, key)
    packed = by(keyed.mapInArrow(_packer(n_batches), "batch int, blob binary"), "batch")
    sent = "bucket int, batch int, blob binary"
    hashes = by(packed.groupBy("batch").applyInArrow(_send_hashes(length, n_buckets), sent), "bucket")
    shared = by(hashes.groupBy("bucket").applyInArrow(_answer_hashes(), sent), "batch")
    contexts = by(packed.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_send_contexts(length, n_buckets), sent), "bucket")
    masks = by(contexts.groupBy("bucket").applyInArrow(_answer_contexts(length), sent), "batch")
    result = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return packed.groupBy("batch").cogroup(masks.groupBy("batch")).applyInArrow(_removal(length, n_buckets, with_text), result)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 50 bytes, removed from all but the smallest document that holds them."""
    return suffix_dedup(table(spark, sf_dir, "documents"))
