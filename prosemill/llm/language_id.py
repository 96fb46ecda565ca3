"""Language ID: script ranges narrow the candidates, Viterbi labels spans of words.

A word is a run of letters, lower-cased. Its score for a language is the log probability of its
character n-grams (hashed to ``2**BITS`` buckets, smoothed) in that language's training texts.
The script of most of a word's letters admits only languages that write at least ``SCRIPT_SHARE``
of their letters in it; a script that no learned language uses says nothing. Viterbi with a
penalty per switch labels each word, so a text of several languages falls into spans; the
language with most letters is the prediction. The path that keeps one language is taken
without the search where no other language gains a penalty's worth on any run of words, nor two of
them at the start and the end together, for then it is the best path. Texts of a batch are cut into words, looked up
and searched together.

Training reads texts with a language outside the held-out fold: all of them while there are at
most ``most_rows``, else at most ``most_rows`` in expectation, chosen by a hash of the id (documented
bound). Each language has an equal share of the bound, and what small ones leave goes to the others, so a
rare language is learnt from all of its texts. Each task counts n-grams in one array of fixed
size; a tree of sums adds the arrays.

Score: the share of letters in spans of the predicted language, times how much likelier that
language is over the whole text than the next one (1 - exp(-log odds)). Cases: a null text, or one
without a letter, is ``und`` with score 0, as is every text if nothing could be learnt. A null doc_id
is predicted, never trained on, and held_out false. A null lang isn't trained on. Repeated rows
are predicted alike; ties go to the language that sorts first. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import crc_mod, table, tree_sum, vector_row
from prosemill.sources.scan import spread

BITS = 15
SCRIPT_SHARE = 0.01
PENALTY = 25.0
_CACHED = 200_000
#: Characters of texts that are read together, if they are of more than one document.
_TOGETHER = 2_000_000
#: Texts that are searched together at least; fewer are searched one by one.
_FEW = 5
_WORD = re.compile(r"[^\W\d_]+")
#: First code points of script ranges, ascending; letters before the first are Latin.
_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0E00, "Thai"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Han"), (0xFB00, "Latin"), (0xFB10, "other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "other"), (0x20000, "Han"),
)
_STARTS = [a for a, _ in _RANGES]
SCRIPTS = sorted({s for _, s in _RANGES})


_OF_RANGE = np.array([SCRIPTS.index(s) for _, s in _RANGES])


def scripts_of(words: list[str]) -> np.ndarray:
    """Signs of each word (rows) in each script of ``SCRIPTS``: every sign of a word counts, to its end."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    script = _OF_RANGE[np.searchsorted(_STARTS, codes, "right") - 1]
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    return np.bincount(word * len(SCRIPTS) + script, minlength=len(words) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))


def words_of(text: str | None) -> list[str]:
    """Letter runs of a text; runs of letter-like signs that aren't letters don't count."""
    return [w for w in _WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


@cache
def _in_words() -> np.ndarray:
    """For each code point: 2 if it is a letter, 1 if words may hold it beside letters, else 0."""
    signs = "".join(map(chr, range(0x110000)))
    found = np.zeros(len(signs), np.int8)
    for run in _WORD.finditer(signs):
        found[run.start() : run.end()] = 1
    found[(found > 0) & np.fromiter(map(str.isalpha, signs), bool, len(signs))] = 2
    return found


def distinct_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of ``words_of`` of all texts, the number of each occurrence's word, and where each text's occurrences end."""
    coded = [(t or "").lower().encode() + b"\n" for t in texts]
    upto, whole, kinds = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))), b"".join(coded), _in_words()
    kind = np.frombuffer(whole.translate(kinds[:128].tobytes() + bytes(128)), np.int8)
    if (far := np.frombuffer(whole, np.int8) < 0).any():
        codes = np.frombuffer(np.frombuffer(whole, np.int8)[far].tobytes().decode().encode("utf-32-le"), "<u4")
        kind = kind.copy()
        kind[far] = np.repeat(kinds[codes], 2 + (codes >= 0x800) + (codes >= 0x10000).view(np.int8))
    # Words and what lies between them, in turn.
    places = np.nonzero(np.diff(kind > 0, prepend=False))[0]
    ends = np.searchsorted(places[::2], upto)
    if not len(places):
        return [], np.zeros(0, np.int64), ends
    found = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(whole)).dictionary_encode()
    number, kinds = found.indices.to_numpy()[::2], found.dictionary.to_pylist()
    good = np.zeros(len(kinds), bool)
    good[number] = True
    if (kind == 1).any():
        good &= np.fromiter((any(map(str.isalpha, w)) for w in kinds), bool, len(kinds))
    keep = good[number]
    return [kinds[k] for k in np.nonzero(good)[0].tolist()], (np.cumsum(good) - 1)[number[keep]], np.append(0, np.cumsum(keep))[ends]


def _buckets(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size, and for whole words: (buckets, index of the word that each belongs to)."""
    marked = [b"^" + w.encode() + b"$" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes from here to the word's end
    mask, h = np.uint32((1 << BITS) - 1), np.zeros(len(data), np.uint32)
    for n in range(1, 6):
        size = len(data) - n + 1
        if size <= 0:
            return
        h = (h[:size] ^ data[n - 1 :]) * np.uint32(0x01000193) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        fits = left[:size] >= n
        mixed = h[fits]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        yield (mixed ^ (mixed >> np.uint32(13))) & mask, word[:size][fits]
    yield np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint32, len(words)) & mask, np.arange(len(words))


class LanguageModel:
    """Log probabilities of n-gram buckets by language, and the scripts that languages use."""

    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()  # bucket by language
        self.usual = letters / np.maximum(1, letters.sum(axis=1, keepdims=True)) >= SCRIPT_SHARE  # language by script
        self.fresh()

    def fresh(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.langs)), np.float32)
        self.sizes = np.zeros(1024, np.float32)

    def __getstate__(self):
        return {"langs": self.langs, "logs": self.logs, "usual": self.usual}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.fresh()

    def learn(self, words: list[str]) -> None:
        """Scores of words that aren't known yet; a cache over its bound is emptied first."""
        if len(self.index) > _CACHED:
            self.fresh()
        new = list({w for w in words if w not in self.index})
        if not new or not self.langs:
            return
        at = len(self.index)
        while at + len(new) > len(self.scores):
            self.scores, self.sizes = np.concatenate([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        score = np.zeros((len(new), len(self.langs)))
        for bucket, word in _buckets(new):
            for k in range(len(self.langs)):
                score[:, k] += np.bincount(word, weights=self.logs[bucket, k], minlength=len(new))
        admitted = self.usual[:, scripts_of(new).argmax(axis=1)].T
        score -= score.max(axis=1, keepdims=True)
        score = np.where(admitted.any(axis=1, keepdims=True), np.where(admitted, score, score - 100), 0)
        self.scores[at : at + len(new)] = np.maximum(score, -200)
        self.sizes[at : at + len(new)] = [len(w) for w in new]
        self.index.update(zip(new, range(at, at + len(new)), strict=True))

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of distinct words in ``scores`` and ``sizes``, learnt if need be."""
        self.learn(words)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def _steady(e: np.ndarray, total: np.ndarray, penalty: float) -> int | None:
    """The one label of the best path, where it can be told without a search."""
    best = int(total.argmax())
    gain = np.cumsum(e - e[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, e.shape[1])), gain[:-1]]), axis=0)
    # A path that touches the best language pays a switch for each stretch outside it; one that never does saves one
    # switch, but has its first stretch at the start and its last at the end.
    inside, start, end = (gain - low).max(), gain.max(), (gain[-1] - low[-1]).max()
    return best if inside < penalty and start + end < penalty else None


def _search(v: list[float], rows: list[list[float]], penalty: float) -> list[int]:
    """Best labels, from the word on that the sums v end in, by the rows of the words behind it."""
    back = []
    for row in rows:
        top = max(v)
        lead, change = v.index(top), top - penalty
        back.append([k if x >= change else lead for k, x in enumerate(v)])
        v = [(x if x >= change else change) + y for x, y in zip(v, row, strict=True)]
    path = [v.index(max(v))]
    for x in reversed(back):
        path.append(x[path[-1]])
    return path[::-1]


def _searched(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best labels of texts whose words lie in e from starts on: all texts' first words, then all second ones, and so on."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    v, sums, signs = e[starts].T.astype(np.float64), [], e.T.copy()
    while (live := int(np.searchsorted(-sizes, -1 - len(sums)))) >= _FEW:
        sums.append(now := v[:, :live].copy())
        v[:, :live] = np.maximum(now, now.max(axis=0) - penalty) + signs[:, starts[:live] + len(sums)]
    own, upto = np.cumsum(sizes) - sizes, len(sums)
    path, state = np.empty(sizes.sum(), np.int64), v.argmax(axis=0)
    for k in range(live):
        a, n = int(starts[k]), int(sizes[k])
        path[own[k] + upto : own[k] + n] = rest = _search(v[:, k].tolist(), e[a + upto + 1 : a + n].tolist(), penalty)
        state[k] = rest[0]
    if sums:
        # Where each label comes from, for all words at once: from itself, or from the label in the lead.
        counts = [x.shape[1] for x in sums]
        before = np.concatenate(sums, axis=1)
        back = np.where(before >= before.max(axis=0) - penalty, np.arange(len(before))[:, None], before.argmax(axis=0))
        until = back.shape[1]
        for k in range(upto, 0, -1):
            n = counts[k - 1]
            path[own[:n] + k] = now = state[:n]
            state[:n] = back[now, np.arange(until - n, until)]
            until -= n
    path[own] = state
    out: list = [None] * len(order)
    for k, x in zip(order.tolist(), np.split(path, own[1:]), strict=True):
        out[k] = x
    return out


def viterbi(e: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word under a switching penalty; the first language wins ties."""
    label = _steady(e, e.sum(axis=0, dtype=np.float64), penalty)
    return _searched(e, np.zeros(1, np.int64), np.array([len(e)]), penalty)[0] if label is None else np.full(len(e), label)


def predict(model: LanguageModel, texts: list[str | None], penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans (first word, words, language) of whole texts."""
    out: list = [("und", 0.0, [])] * len(texts)
    if not model.langs:
        return out
    words, number, ends = distinct_words(texts)
    at = model.places(words)[number]
    e, bounds, totals, unclear = model.scores[at], [0, *ends.tolist()], {}, []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if a == b:
            continue
        totals[k] = total = e[a:b].sum(axis=0, dtype=np.float64)
        label = _steady(e[a:b], total, penalty)
        if label is None:
            unclear.append(k)
        else:
            out[k] = (model.langs[label], _odds(total, label), [(0, b - a, model.langs[label])])
    if unclear:
        starts = np.array([bounds[k] for k in unclear])
        for k, path in zip(unclear, _searched(e, starts, np.array([bounds[k + 1] for k in unclear]) - starts, penalty), strict=True):
            letters = np.bincount(path, weights=model.sizes[at[bounds[k] : bounds[k + 1]]], minlength=len(model.langs))
            best = int(letters.argmax())
            turns = [0, *(np.nonzero(path[1:] != path[:-1])[0] + 1).tolist(), len(path)]
            spans = [(x, y - x, model.langs[path[x]]) for x, y in zip(turns, turns[1:], strict=False)]
            out[k] = (model.langs[best], float(letters[best] / letters.sum()) * _odds(totals[k], best), spans)
    return out


def _odds(total: np.ndarray, best: int) -> float:
    """How much likelier a language is than the next one."""
    own, *rest = (total[best], *total[:best], *total[best + 1 :])
    return 1 - float(np.exp(-max(0.0, own - max(rest)))) if rest else 1.0


def fit(training: DataFrame, langs: list[str]) -> LanguageModel:
    """Fit on rows (text, lang)."""
    of = {lang: k for k, lang in enumerate(langs)}
    width = (1 << BITS) + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), width))
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in seen.items():
                if not words:
                    continue
                distinct, row = list(words), total[of[lang]]
                n = np.fromiter(words.values(), np.float64, len(distinct))
                for bucket, word in _buckets(distinct):
                    row[: 1 << BITS] += np.bincount(bucket, weights=n[word], minlength=1 << BITS)
                row[1 << BITS :] += n @ scripts_of(distinct)
        yield vector_row(total.reshape(-1))

    total = tree_sum(training.mapInArrow(count, "v binary"))
    if total is None:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((0, 1)))
    total = total.reshape(len(langs), width)
    return LanguageModel(langs, total[:, : 1 << BITS], total[:, 1 << BITS :])


def quotas(rows: dict[str, int], most_rows: int) -> dict[str, int]:
    """Training rows of each language: all where there is room, the rest shared evenly."""
    out, left = {}, most_rows
    for k, lang in enumerate(sorted(rows, key=lambda x: (rows[x], x))):
        out[lang] = min(rows[lang], left // (len(rows) - k))
        left -= out[lang]
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_fold: int = 1, folds: int = 3, most_rows: int = 30_000) -> LanguageModel:
    """Model of the languages of rows outside the held-out fold."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != held_fold))
    found = known.groupBy(F.col(lang_col).alias("lang")).count().collect()
    rows = {r.lang: r["count"] for r in found}
    langs = sorted(rows)
    if sum(rows.values()) > most_rows:  # the documented bound
        share = [x for lang, n in quotas(rows, most_rows).items() for x in (F.lit(lang), F.lit(-(-n * 1_000_000_000 // rows[lang])))]
        known = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000_000)) < F.element_at(F.create_map(*share), F.col(lang_col)))
    return fit(known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), langs)


def detect_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", penalty: float = PENALTY, prefix: str = "") -> DataFrame:
    """The rows of docs with lang_pred, score and spans added, under names that start with ``prefix``."""
    added = [f"{prefix}{c}" for c in ("lang_pred", "score", "spans")]
    if clash := sorted(set(added) & set(docs.columns)):
        raise ValueError(f"docs has columns {clash}; give a prefix")
    at = docs.columns.index(text_col)
    spans = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, texts = [], batch.column(at).to_pylist()
            upto = np.cumsum([0, *(len(t or "") for t in texts)])
            while len(got) < len(texts):
                until = max(len(got) + 1, int(np.searchsorted(upto, upto[len(got)] + _TOGETHER, "right")) - 1)
                got.extend(predict(model, texts[len(got) : until], penalty))
            own = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([[dict(zip(("first_word", "n_words", "lang"), s, strict=True)) for s in g[2]] for g in got], spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{added[0]}` string, `{added[1]}` double, `{added[2]}` array<struct<first_word:int,n_words:int,lang:string>>")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt outside the held-out fold."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    model = learn(docs)
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return detect_languages(rows, model).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
