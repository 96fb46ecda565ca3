"""SentencePiece encoding and decoding with seeded merge-dropout.

The pieces and scores of a merge-type model drive an agenda: pairs of neighbouring symbols
that form a piece, best score first, leftmost on ties. Each candidate that comes up is skipped
with probability ``dropout``, decided by a keyed hash of the seed, the document's id, the segment's
position in the document and the candidate's number in the order of coming up. So each occurrence of
a word has decisions of its own, and its segmentations vary without a bound. The same seed gives the
same segmentation in any run and on any executor; another seed gives other ones. Symbols that are no piece
fall back to bytes. At dropout 0 the result is the library's own encoding.

No piece of the model spans the start of a word, so a text is cut into segments there. The distinct
segments of a batch are merged once without skips, which tells the occurrences that skip a candidate; these are merged
each for itself, all together in rounds of array operations. Nothing is kept between batches. With ``lanes``,
documents share that many sets of decisions instead, and a segment has one segmentation a lane. Decoding joins bytes, so it inverts every segmentation.
The sign that stands for a space inside pieces (U+2581) goes through byte pieces where a text
itself holds it: texts come back unchanged.

Cases: a null text has null ids, and decodes to null; an empty text has none. A null doc_id is an id
like any other (in lane 0). Very long words take n log n steps. Repeated rows are encoded alike, unless
``encode`` is given a column that numbers them. Empty table: no
rows. Extra columns stay in ``encode``; one of a name that is added is an error unless a prefix is given.
The model file's path is a parameter and has to be readable on every executor.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import table
from prosemill.sources.scan import spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
DROPOUT, LANES = 0.1, None
#: Segments that a process keeps; an entry takes some 400 bytes, and an executor has a process for each core.
_CACHED, _BETWEEN = 300_000, 60_000
_SHORT = 32
#: Rows that one round handles together.
_ROWS = 8192
#: What stands for no pair, for an empty slot, and numbers from which a symbol is a character that is no piece.
_NOTHING, _EMPTY, _FOREIGN = np.int64(1 << 62), np.int64(-2), 1 << 24
_M = (1 << 64) - 1


def _mixed(keys: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Hash k of each key (splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys + (k + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


_SHARED: dict[tuple, PieceCodec] = {}


def _shared(*parameters) -> PieceCodec:
    """One codec for each set of parameters in a process, so that a worker's next task finds its tables."""
    if parameters not in _SHARED:
        _SHARED[parameters] = PieceCodec(*parameters)
    return _SHARED[parameters]


class PieceCodec:
    """Encoder and decoder of one model file, seed and dropout; pickles by its parameters.

    lanes: None for decisions of each occurrence. With lanes, segments met lately are kept in two generations a lane: a full
    young one becomes the old one, and what is met again moves to the young one.
    """

    def __init__(self, path: str = MODEL, dropout: float = 0.0, seed: int = 0, lanes: int | None = 1):
        if not 0 <= dropout < 1 or (lanes is not None and lanes < 1):
            raise ValueError("dropout has to lie in [0, 1) and lanes to be positive")
        self.path, self.dropout, self.seed, self.lanes = path, dropout, seed, lanes
        self.ready = False

    def __reduce__(self):
        return _shared, (self.path, self.dropout, self.seed, self.lanes)

    def load(self) -> PieceCodec:
        """Reads the pieces, once per process."""
        if self.ready:
            return self
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}  # negated: the smallest comes first
        self.bytes_ = [0] * 256
        self.body: list[bytes] = []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes_[int(piece[3:5], 16)] = k
                self.body.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.body.append(b"")
            else:
                self.ids[piece], self.scores[piece] = k, -model.get_score(k)
                self.body.append(piece.replace(SPACE, " ").encode())
        # Pairs of symbols that form a piece, by number; characters that are no piece have numbers behind the pieces.
        number = {c: _FOREIGN + ord(c) for p in self.ids for c in p} | self.ids
        self.by_code = np.arange(_FOREIGN, _FOREIGN + 0x110000, dtype=np.int32)
        for c, k in number.items():
            if len(c) == 1:
                self.by_code[ord(c)] = k
        pairs = sorted((number[a] << 32 | number[b], self.scores[p], k) for p, k in self.ids.items() for cut in range(1, len(p)) if (a := p[:cut]) in number and (b := p[cut:]) in number)
        self._index(np.array([x[0] for x in pairs], np.int64), np.array([x[1] for x in pairs]), np.array([x[2] for x in pairs], np.int64))
        within = [p for p in self.ids if SPACE in p.lstrip(SPACE)]
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not within else "(?s).+")
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        if not within and "\n" not in joined:
            self.segments = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.at_spaces, self.at_lines = not within, not within and "\n" not in joined
        self.literal = np.array([self.bytes_[b] for b in SPACE.encode()], "<i4").tobytes()
        self.young: list[dict] = [{} for _ in range(self.lanes or 1)]
        self.old: list[dict] = [{} for _ in range(self.lanes or 1)]
        self.limit = int(self.dropout * (1 << 64))
        self.ready = True
        return self

    def _index(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Hash table of pairs, with linear probing; a pair's code holds the rank of its score and the piece's number."""
        bits = max(4, int(8 * len(keys)).bit_length() - 1)
        self.slot_shift, self.slot_mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_keys, self.slot_codes = np.full(1 << bits, _EMPTY, np.int64), np.full(1 << bits, _NOTHING, np.int64)
        codes = np.unique(scores, return_inverse=True)[1].astype(np.int64) << 40 | ids
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slot_keys[slots[left]] == _EMPTY]
            taken, first = np.unique(slots[free], return_index=True)
            self.slot_keys[taken], self.slot_codes[taken] = keys[free[first]], codes[free[first]]
            left = np.setdiff1d(left, free[first])
            slots[left] = slots[left] + 1 & self.slot_mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.slot_shift).astype(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes of the pieces that symbols a and b form, ``_NOTHING`` where none; -1 is no symbol."""
        keys = a.astype(np.int64) << 32 | b
        slots = self._slots(keys)
        there = self.slot_keys[slots]
        differs = np.nonzero(there != keys)[0]
        other = differs[there[differs] != _EMPTY]
        while len(other):
            slots[other] = slots[other] + 1 & self.slot_mask
            there[other] = self.slot_keys[slots[other]]
            other = other[(there[other] != keys[other]) & (there[other] != _EMPTY)]
        return np.where(there == keys, self.slot_codes[slots], _NOTHING)

    def _skipped(self, keys: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether candidates of number k are skipped, by the keys of their segments."""
        return _mixed(keys, k) < np.uint64(self.limit)

    def _lane_keys(self, texts: list[str], lane: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(t.encode(), (self.seed * 1_000_003 + lane) & _M) for t in texts), np.uint64, len(texts))

    def _segment(self, text: str, lane: int) -> bytes:
        """Ids of one segment as 32-bit integers."""
        return self._merge(text, self._lane_skips(text, lane))[0]

    def _lane_skips(self, text: str, lane: int) -> np.ndarray:
        return self._skips_of(self._lane_keys([text], lane)[0], text)

    def _skips_of(self, key: np.uint64, text: str) -> np.ndarray:
        """Decisions about all candidates of one segment: two neighbours at first, two more at most for each merge."""
        return self._skipped(np.full(3 * len(text), key), np.arange(3 * len(text), dtype=np.uint64))

    def _merge(self, text: str, skip: np.ndarray | list[bool]) -> tuple[bytes, int]:
        """Ids of one segment, and how many candidates came up; skip: by the candidate's number."""
        scores, symbols, n = self.scores, list(text), len(text)
        agenda = [(scores[p], k, k + 1, p) for k in range(n - 1) if (p := text[k : k + 2]) in scores]
        met = 0
        if agenda:
            heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                _, left, right, piece = heappop(agenda)
                if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != piece:
                    continue
                met += 1
                if skip[met - 1]:
                    continue
                symbols[left], symbols[right] = piece, ""
                after[left] = nxt = after[right]
                if nxt < n:
                    before[nxt] = left
                    if (p := piece + symbols[nxt]) in scores:
                        heappush(agenda, (scores[p], left, nxt, p))
                if (prv := before[left]) >= 0 and (p := symbols[prv] + piece) in scores:
                    heappush(agenda, (scores[p], prv, left, p))
        out: list[int] = []
        ids = self.ids
        for s in symbols:
            if s:
                k = ids.get(s)
                if k is None:
                    out.extend(self.bytes_[b] for b in s.encode())
                else:
                    out.append(k)
        return array("i", out).tobytes(), met

    def _bulk(self, texts: list[str], of: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``_merge`` of many short segments at once: the same merges in the same order, a round for all segments.

        Row k is texts[of[k]] with the decisions of keys[k] (no keys: nothing is skipped). Ids of all rows in one array,
        then each row's start in it, its size, and how many candidates came up.
        """
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths) - lengths
        flat = self.by_code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        codes = self._pairs(flat, np.append(flat[1:], np.int32(-1)))
        starts, sizes, met = (np.zeros(len(of), np.int64) for _ in range(3))
        parts, done = [np.empty(0, np.int32)], 0
        group = (lengths[of] - 1) // 4
        for g in np.unique(group).tolist():
            members = np.nonzero(group == g)[0]
            for k in range(0, len(members), _ROWS):
                rows = members[k : k + _ROWS]
                ids, n, m = self._rounds(flat, codes, begins[of[rows]], lengths[of[rows]], None if keys is None else keys[rows])
                ids, n = self._spelled(ids, n)
                starts[rows], sizes[rows], met[rows] = done + np.cumsum(n) - n, n, m
                parts.append(ids)
                done += len(ids)
        return np.concatenate(parts), starts, sizes, met

    def _rounds(self, flat: np.ndarray, codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols that are left of each row, end to end; how many; how many candidates came up. Rows lie in flat from begins on."""
        n, width = len(begins), int(lengths.max())
        # Cell (c, r) is at c * n + r. A row's symbols are in columns up to its length, then -1; the last column is before the first symbol.
        column = np.arange(width)[:, None]
        at = np.minimum(begins + column, len(flat) - 1)
        symbol = np.full((width + 2, n), -1, np.int32)
        symbol[:width] = np.where(column < lengths, flat[at], -1)
        agenda = np.full((width + 2, n), _NOTHING)
        agenda[:width] = np.where(column + 1 < lengths, codes[at], _NOTHING) + (column << 32)
        real, symbol, agenda = agenda[:width], symbol.reshape(-1), agenda.reshape(-1)
        after = np.arange(n, (width + 3) * n)
        before = np.arange(-n, (width + 1) * n)
        before[:n] += (width + 2) * n
        met = np.zeros(n, np.int64)
        while True:
            best = np.minimum.reduce(real, axis=0)
            row = np.nonzero(best < _NOTHING)[0]
            if not len(row):
                break
            best = best[row]
            cell = (best >> 32 & 0xFF) * n + row
            if keys is not None:
                out = self._skipped(keys[row], met[row].view(np.uint64))
                agenda[cell[out]] = _NOTHING
                met[row] += 1
                best, cell = best[~out], cell[~out]
            else:
                met[row] += 1
            gone = after[cell]
            after[cell] = behind = after[gone]
            before[behind] = cell
            symbol[cell] = made = best & 0xFFFFFFFF
            symbol[gone], agenda[gone] = -1, _NOTHING
            left = before[cell]
            found = self._pairs(np.concatenate([made, symbol[left]]), np.concatenate([symbol[behind], made]))
            found += np.concatenate([cell, left]) // n << 32
            agenda[cell], agenda[left] = found[: len(cell)], found[len(cell) :]
        final = symbol.reshape(-1, n)[:width].T
        good = final >= 0
        return final[good], good.sum(axis=1), met

    def _spelled(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, with bytes for those that are no piece, and how many of them each row has."""
        places = np.nonzero(symbols >= _FOREIGN)[0]
        if not len(places):
            return symbols, sizes
        kinds, kind = np.unique(symbols[places], return_inverse=True)
        spelled = [[self.bytes_[b] for b in chr(k - _FOREIGN).encode()] for k in kinds.tolist()]
        count = np.ones(len(symbols), np.int64)
        count[places] = np.array([len(x) for x in spelled])[kind]
        ids, first = np.repeat(symbols, count), np.cumsum(count) - count
        for k, x in enumerate(spelled):
            for j, b in enumerate(x):
                ids[first[places[kind == k]] + j] = b
        return ids, np.bincount(np.repeat(np.arange(len(sizes)), sizes), count, len(sizes)).astype(np.int64)

    def _segments_of(self, text: str) -> list[list[str]]:
        """Segments of each part between the signs that stand for a space."""
        return [self.segments.findall((SPACE if not k else "") + part.replace(" ", SPACE)) for k, part in enumerate(text.split(SPACE))] if text else []

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Numbers of the segments of ``_segments_of`` of all texts, where each text's end among them, and the segments; "" is the sign itself."""
        coded = [b" " + t.encode() if t else b"" for t in texts]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        blob = b"".join(coded)
        data = np.frombuffer(blob, np.uint8)
        cut = np.zeros(len(data) + 1, bool)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cut[ends] = True
        if self.at_spaces:
            space = data == 0x20
            cut[1:-1] |= space[1:] & ~space[:-1]
        if self.at_lines:
            lines = np.nonzero(data == 0x0A)[0]
            cut[lines] = cut[lines + 1] = True
        signs = np.nonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))[0]
        cut[signs] = cut[signs + 3] = True
        places = np.nonzero(cut)[0]
        found = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(blob)).dictionary_encode()
        segments = ["" if x == SPACE else x.replace(" ", SPACE) for x in found.dictionary.to_pylist()]
        return found.indices.to_numpy().astype(np.int64), np.searchsorted(places, ends), segments

    def _encode_freely(self, texts: list[str | None], names: list[str]) -> list[bytes | None]:
        """Ids of texts where each occurrence of a segment has its own decisions; names: what the documents' keys are made of."""
        node, ends, segments = self._numbered(texts)
        counts = np.diff(ends)
        keys = np.repeat(np.fromiter((xxhash.xxh64_intdigest(x, self.seed & _M) for x in names), np.uint64, len(names)), counts)
        keys = _mixed(keys, (np.arange(len(node)) - np.repeat(ends[:-1], counts)).astype(np.uint64))
        # First each segment with no skip, which tells how many decisions its occurrences ask for at least.
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        short = np.nonzero((lengths > 0) & (lengths <= _SHORT))[0]
        ids, begin, size, most = self._bulk(segments, short, None)
        pool, done = [ids], len(ids)
        begins, sizes, met = (np.zeros(len(segments), np.int64) for _ in range(3))
        begins[short], sizes[short], met[short] = begin, size, most
        begins, sizes, most = begins[node], sizes[node], met[node]
        # Then the occurrences with a skip among these, each for itself.
        skips = np.zeros(len(node), bool)
        live = np.nonzero(most)[0] if self.limit else np.arange(0)
        k = 0
        while len(live):
            hit = self._skipped(keys[live], np.uint64(k))
            skips[live[hit]] = True
            k += 1
            live = live[~hit]
            live = live[most[live] > k]
        own = np.nonzero(skips)[0]
        ids, begin, size, _ = self._bulk(segments, node[own], keys[own])
        begins[own], sizes[own] = done + begin, size
        pool.append(ids)
        done += len(ids)
        rest = (lengths == 0) | (lengths > _SHORT)
        for k in np.nonzero(rest[node])[0].tolist() if rest.any() else ():
            s = segments[node[k]]
            ids = np.frombuffer(self._merge(s, self._skips_of(keys[k], s).tolist())[0] if s else self.literal, "<i4")
            begins[k], sizes[k] = done, len(ids)
            pool.append(ids)
            done += len(ids)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        whole = np.concatenate(pool).astype("<i4", copy=False)[np.repeat(begins - upto[:-1], sizes) + np.arange(upto[-1])]
        upto = upto[ends].tolist()
        return [None if t is None else whole[a:b].tobytes() for t, a, b in zip(texts, upto, upto[1:], strict=False)]

    def encode_many(self, texts: list[str | None], doc_ids: list[int | None], copies: list[int] | None = None) -> list[bytes | None]:
        """Ids of whole texts as little-endian 32-bit integers; None for null. copies: numbers of rows that share an id and vary."""
        self.load()
        if self.lanes is None:
            return self._encode_freely(texts, [f"{i}/{c}" for i, c in zip(doc_ids, copies or [1] * len(texts), strict=True)])
        cut: list = []
        for text, doc_id in zip(texts, doc_ids, strict=True):
            lane = 0 if self.lanes == 1 or doc_id is None else xxhash.xxh64_intdigest(str(doc_id), self.seed & _M) % self.lanes
            cut.append(None if text is None else (lane, self._segments_of(text)))
        for lane in range(self.lanes):
            young, old = self.young[lane], self.old[lane]
            if len(young) > _CACHED // (2 * self.lanes):
                self.old[lane], self.young[lane] = old, young = young, {}
            fresh = {s for x in cut if x and x[0] == lane for part in x[1] for s in part if s not in young}
            short: list[str] = []
            for s in fresh:
                if (ids := old.get(s)) is not None:
                    young[s] = ids
                elif 2 <= len(s) <= _SHORT:
                    short.append(s)
            found, begins, sizes, _ = self._bulk(short, np.arange(len(short)), self._lane_keys(short, lane))
            blob = found.astype("<i4").tobytes()
            young.update((s, blob[4 * a : 4 * (a + n)]) for s, a, n in zip(short, begins.tolist(), sizes.tolist(), strict=True))
        out: list[bytes | None] = []
        for x in cut:
            if x is None:
                out.append(None)
                continue
            young, parts = self.young[x[0]], []
            for k, found in enumerate(x[1]):
                if k:
                    parts.append(self.literal)
                for s in found:
                    ids = young.get(s)
                    if ids is None:
                        ids = self._segment(s, x[0])
                        if len(s) == 1:
                            young[s] = ids
                    parts.append(ids)
            out.append(b"".join(parts))
        return out

    def trim(self) -> None:
        """Lets go of all but ``_BETWEEN`` segments, which the process's next task starts with."""
        for lane, young in enumerate(self.young if self.ready else ()):
            n = _BETWEEN // len(self.young)
            self.old[lane], self.young[lane] = dict(islice(young.items(), max(0, len(young) - n), None)), {}

    def encode(self, text: str, doc_id: int | None = None) -> bytes:
        """Ids of one whole text."""
        return self.encode_many([text], [doc_id])[0]

    def decode(self, ids: bytes | np.ndarray | list[int]) -> str:
        """The text of ids; undoes ``encode``."""
        self.load()
        numbers = np.frombuffer(ids, "<i4").tolist() if isinstance(ids, bytes) else list(ids)
        if not numbers:
            return ""
        return b"".join(map(self.body.__getitem__, numbers))[1:].decode()


def encode(docs: DataFrame, codec: PieceCodec, id_col: str = "doc_id", text_col: str = "text", prefix: str = "", copy_col: str | None = None) -> DataFrame:
    """The rows of docs with piece_ids (array of int) added, under a name that starts with ``prefix``; copy_col numbers rows that share an id."""
    name = f"{prefix}piece_ids"
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}; give a prefix")
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    at_copy = None if copy_col is None else docs.columns.index(copy_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                piece = batch.slice(k, 1000)
                got = codec.encode_many(piece.column(at_text).to_pylist(), piece.column(at_id).to_pylist(), None if at_copy is None else piece.column(at_copy).to_pylist())
                ends = np.cumsum([0, *(0 if g is None else len(g) // 4 for g in got)]).astype(np.int32)
                flat = np.frombuffer(b"".join(g for g in got if g), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array([g is None for g in got], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*piece.columns, ids], names=[*batch.schema.names, name])
        codec.trim()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{name}` array<int>")


def decode(rows: DataFrame, codec: PieceCodec, ids_col: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """The rows with the text of ids_col added."""
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [None if x is None else codec.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{name}` string")


def digest(docs: DataFrame, codec: PieceCodec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_chars, ids_sha256, decoded_sha256 and lossless of each text; each is encoded and decoded whole."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            coded = (x for k in range(0, len(texts), 1000) for x in codec.encode_many(texts[k : k + 1000], ids_[k : k + 1000]))
            for i, t, ids in zip(ids_, texts, coded, strict=True):
                if t is None:
                    rows.append((i, None, None, None, None, True))
                    continue
                back = codec.decode(ids)
                rows.append((i, len(t), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        codec.trim()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, n_pieces bigint, ids_sha256 string, decoded_sha256 string, lossless boolean")


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge-dropout encoding of all documents, decoded again."""
    return digest(spread(table(spark, sf_dir, "documents"), "doc_id"), PieceCodec(MODEL, DROPOUT, seed=1, lanes=LANES))
