"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Document statistics (shares of letter kinds, signs, repeats, word and line shapes; see
``STATISTICS``) are standardised and mapped to random Fourier features, which approximate
a Gaussian kernel. Each task sums its part of the normal equations and a tree of sums adds
the parts; the driver solves one system of ``features`` unknowns. A fifth of the training rows, chosen by a
hash of the id, isn't fitted on: its scores, counted in ``BINS`` bins by label, calibrate by pooling adjacent
violators, with straight lines between the pools' centres. Where that fifth holds under
``LEAST_CALIBRATION`` rows of either class, all training rows fit and calibrate.

Training reads the labelled rows outside the held-out fold, at most ``most_rows`` of them in
expectation (a hash of the id decides; documented bound). Labels, lang, source and doc_id are
never inputs of a score.

Cases: null and empty texts have statistics of zero and get a score like any text. A null
doc_id is never trained on and is held_out false. Rows with a null label are not trained on;
of several different labels for one id each counts once. Repeated rows are scored alike. With no labelled row,
or one class only, every score is the share of class 1 (0.5 without any row). An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import Scratch, crc_mod, table, tree_sum, vector_row
from prosemill.sources.scan import spread

BINS = 1000
LEAST_CALIBRATION = 20
_KINDS = np.zeros(256, np.int64)
_KINDS[ord("a") : ord("z") + 1] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[ord("0") : ord("9") + 1] = 3
_KINDS[[9, 11, 12, 13, 32]] = 4
_KINDS[10] = 5
_KINDS[[ord(c) for c in ".,;:"]] = 6
_KINDS[[ord(c) for c in "!?"]] = 7
_KINDS[[ord(c) for c in "%&$#*@^~"]] = 8
_KINDS[[ord(c) for c in "|<>{}[]\\/=+_`"]] = 9
_KINDS[[ord(c) for c in "'\"()-"]] = 10
_KINDS[128:] = 11
STATISTICS = (
    "lower upper digit blank newline stop shout symbol markup quote wide other log_bytes log_words distinct_words top_word mean_word sd_word "
    "long_words short_words capital_words same_neighbour distinct_lines mean_line lines_ended entropy byte_run"
).split()


def statistics(text: str | None) -> list[float]:
    """The figures of one whole text, in the order of ``STATISTICS``."""
    body = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(body))
    data = np.frombuffer(body, np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_KINDS, weights=counts, minlength=12) / n
    p = counts[counts > 0] / n
    words, lines = body.split(), [x for x in body.split(b"\n") if x.strip()]
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    table_: dict[bytes, int] = {}
    for w in words:
        table_[w] = table_.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    runs = float((data[1:] == data[:-1]).mean()) if len(data) > 1 else 0.0
    return [
        *(kinds[k] for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0)),
        np.log1p(len(body)), np.log1p(len(words)), len(table_) / m, max(table_.values(), default=0) / m, sizes.mean(), sizes.std(),
        float((sizes > 14).mean()), float((sizes < 3).mean()), sum(w[:1].isupper() for w in words) / m, same / m, len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))), sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)), float(-(p * np.log2(p)).sum()), runs,
    ]


class Features:
    """Standardisation and random Fourier features; the same seed gives the same map."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x: the points' fitted, never falling values."""
    value, mass, width = [], [], []
    for v, m in zip(y, weight, strict=True):
        value.append(float(v))
        mass.append(float(m))
        width.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            m2, v2, w2 = mass.pop(), value.pop(), width.pop()
            value[-1] = (value[-1] * mass[-1] + v2 * m2) / (mass[-1] + m2)
            mass[-1] += m2
            width[-1] += w2
    return x, np.repeat(value, width)


def knots(x: np.ndarray, fitted: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and value of each pool of equal fitted values."""
    starts = np.nonzero(np.concatenate([[True], fitted[1:] != fitted[:-1]]))[0]
    return np.add.reduceat(x * weight, starts) / np.add.reduceat(weight, starts), fitted[starts]


def _texts(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in pieces with the statistics of their texts."""
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            piece = batch.slice(k, size)
            yield piece, np.array([statistics(t) for t in piece.column("text").to_pylist()]).reshape(-1, len(STATISTICS))


class QualityModel:
    """A fitted score: features, ridge weights and calibration."""

    def __init__(self, features: Features | None, weights: np.ndarray | None, base: float):
        self.features, self.weights, self.base = features, weights, base
        self.x = self.y = None

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), self.base)
        raw = self.raw(stats)
        # A millionth of the ridge score keeps the order of texts beyond the outermost pools.
        return (1 - 1e-6) * np.clip(np.interp(raw, self.x, self.y), 0, 1) + 1e-6 * np.clip(raw, 0, 1)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)


def fit(training: DataFrame, features: int = 300, width: float = 3.0, ridge: float = 1e-2, seed: int = 7) -> QualityModel:
    """Fit on rows (text, y, fold), fold 1 for calibration, else 0. Three passes over their statistics, which are written once to the shared folder."""

    def stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, s in _texts(batches):
            yield pa.RecordBatch.from_arrays([piece.column("y").cast(pa.float64()), piece.column("fold"), pa.array([r.tobytes() for r in s], pa.binary())], names=["y", "fold", "s"])

    def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            s = np.frombuffer(b"".join(batch.column("s").to_pylist())).reshape(-1, len(STATISTICS))
            yield s, batch.column("y").to_numpy(zero_copy_only=False)

    def class_counts(batches):
        total = np.zeros(4)
        for batch in batches:
            y, fold = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("y", "fold"))
            total += np.bincount((2 * fold + (y > 0)).astype(np.int64), minlength=4)
        yield vector_row(total)

    def moments(batches):
        total = np.zeros(2 + 2 * len(STATISTICS))
        for s, y in rows_in(batches):
            total += np.concatenate([[len(y), y.sum()], s.sum(axis=0), (s * s).sum(axis=0)])
        yield vector_row(total)

    kept = Scratch(training.sparkSession, "quality").keep(training.select("text", "y", F.col("fold").cast("int").alias("fold")).mapInArrow(stats_rows, "y double, fold int, s binary"))
    classes = tree_sum(kept.select("y", "fold").mapInArrow(class_counts, "v binary"))
    apart = classes is not None and classes[2:].min() >= LEAST_CALIBRATION and classes[:2].min() > 0
    fitted, calibrated = (kept.filter("fold = 0"), kept.filter("fold = 1")) if apart else (kept, kept)
    m = tree_sum(fitted.mapInArrow(moments, "v binary"))
    if m is None or m[0] == 0 or m[1] in (0, m[0]):
        return QualityModel(None, None, 0.5 if m is None or m[0] == 0 else float(m[1] / m[0]))
    d = len(STATISTICS)
    mean = m[2 : 2 + d] / m[0]
    scale = np.sqrt(np.maximum(m[2 + d :] / m[0] - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    phi = Features(mean, scale, features, width, seed)
    # Both classes weigh alike in the fit; calibration brings the true shares back.
    heavy = {0.0: m[0] / (2 * (m[0] - m[1])), 1.0: m[0] / (2 * m[1])}

    def normal(batches):
        k = features + 1
        a, b = np.zeros((k, k)), np.zeros(k)
        for s, y in rows_in(batches):
            f, w = phi(s), np.where(y > 0, heavy[1.0], heavy[0.0])
            a += (f * w[:, None]).T @ f
            b += f.T @ (y * w)
        yield vector_row(np.concatenate([a.reshape(-1), b]))

    total = tree_sum(fitted.mapInArrow(normal, "v binary"))
    k = features + 1
    a, b = total[: k * k].reshape(k, k), total[k * k :]
    weights = np.linalg.solve(a + ridge * m[0] / k * np.eye(k), b)
    model = QualityModel(phi, weights, float(m[1] / m[0]))

    def bins(batches):
        n = np.zeros((2, BINS))
        for s, y in rows_in(batches):
            at = _bin(phi(s) @ weights)
            np.add.at(n, (0, at), 1)
            np.add.at(n, (1, at), y)
        yield vector_row(n.reshape(-1))

    n, ones = tree_sum(calibrated.mapInArrow(bins, "v binary")).reshape(2, BINS)
    full = np.nonzero(n)[0]
    x, values = isotonic((full + 0.5) / BINS * 2 - 0.5, ones[full] / n[full], n[full])
    model.x, model.y = knots(x, values, n[full])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_fold: int = 0, folds: int = 5, threshold: float = 0.3, most_rows: int = 200_000) -> DataFrame:
    """doc_id, held_out, score and predicted of each document; see the module for the method and its cases."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != held_fold)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).distinct()
    share = max(1, known.count()) / most_rows
    if share > 1:  # the documented bound on training rows
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 / share))
    # Broadcast: (id, label) pairs, distinct, and never more than the bound on training rows in expectation.
    training = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("text", "y", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0).cast("int").alias("fold"))
    model = fit(training)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, s in _texts(batches):
            got = model.score(s)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_mod(id_col, folds) == held_fold, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scores, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labels.quality outside the held-out fold."""
    return score_quality(spread(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "labels"))
