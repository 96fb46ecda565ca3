"""URL filter: host and path rules first, else a logistic regression.

The method is a logistic regression on hashed character n-grams of host and path, trained
from the small labelled table below when the operator is built: a few hundred gradient steps
on a vector of ``2**bits`` weights, a bounded size that travels with the tasks.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
there up to ``?``, ``#`` or the end. A null url or one without ``://`` has an empty host and
path. A rule ``host/prefix`` fits its host and all subdomains if the path starts with ``/prefix``;
the longest rule wins, the first of equal length in code-point order.

Cases: an empty host fits no rule and is judged by the model like any other (its bias and the
n-grams of an empty string). Null ids and repeated rows are judged row by row. Ports and user
names stay part of the host, as the definition has it. Empty table: no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import table

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_GOOD = """
news.northfield.example.org/en/812 library.university.example.org/catalogue/history museum.example.org/exhibitions/2021
docs.toolkit.example.org/guide/install blog.gardener.example.org/posts/roses www.cityhall.example.org/services/water
research.institute.example.org/papers/44 weather.example.org/forecast/today recipes.kitchen.example.org/soup/lentil
www.school.example.org/timetable wiki.example.org/article/astronomy journal.medicine.example.org/volume/12
science.example.net/en/article/6 maps.example.net/de/region history.example.net/en/rome music.example.net/en/jazz
www.theatre.example.net/en/programme forum.cycling.example.net/en/thread/77 m.rivers.example.net/en/25
www.hiking.example.org/trails/alps blog.station.example.net/en/533 gathering.example.org/en/328 theatre.example.org/fr/414
www.southern.example.org/en/471 blog.orchard.example.net/de/612 m.thousand.example.org/es/797 concerts.example.org/en/334
www.books.example.org/reviews/novel parliament.example.org/debates/2020 court.example.org/decisions/19
physics.example.org/lectures/optics blog.teacher.example.org/lessons garden.example.org/plants/oak
harbour.example.net/en/770 blog.northern.example.net/en/455 violin.example.org/de/671 www.family.example.org/en/148
""".split()
_BAD = """
spam-site.example.org/en/728 www.cheap-pills.example.org/en/450 casino-bonus.example.org/win/now
free-money.example.net/click/here hot-singles.example.org/chat buy-followers.example.net/order
www.cheap-loans.example.org/apply/now pills-online.example.net/viagra/order spam-links.example.org/en/90
best-casino.example.net/slots/free cheap-watches.example.org/replica/buy xxx-videos.example.org/watch
adult-cams.example.net/live win-prizes.example.org/claim/iphone crypto-doubler.example.net/send
blog.spam-shop.example.net/de/12 m.cheap-pills.example.net/en/33 download-crack.example.org/keygen
www.spam-store.example.net/fr/5 cheap-pills.example.org/de/71 torrent-free.example.org/movies/full
seo-links.example.net/backlinks/buy lottery-winner.example.org/claim miracle-diet.example.net/order/now
payday-cash.example.org/fast casino-spins.example.net/en/bonus escort-city.example.org/girls
phish-login.example.net/verify/account bank-secure-update.example.org/login/confirm cheap-meds.example.net/rx
spam-page.example.net/en/7 www.spam-offers.example.org/es/61 blog.cheap-pills.example.net/en/82 work-from-home-rich.example.org/join
""".split()
#: The labelled URL table: (label, host, path); label 1 is to be blocked. The last row stands for urls without a host.
LABELLED = (*((label, u.partition("/")[0], "/" + u.partition("/")[2]) for label, urls in ((0, _GOOD), (1, _BAD)) for u in urls), (0, "", ""))


def parts_of(url: str | None) -> tuple[str, str]:
    """Host and path of a url, as the module defines them; what the native expressions compute."""
    rest = (url or "").partition("://")[2]
    end = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:end], rest[end:]
    stop = next((k for k, c in enumerate(tail) if c in "?#"), len(tail))
    return host.translate({k: k + 32 for k in range(65, 91)}), tail[:stop]


def _features(host: str, path: str, bits: int, sizes: tuple[int, ...] = (2, 3, 4)) -> np.ndarray:
    """Buckets of the n-grams of host and path; digits count as one sign, so that numbers don't matter."""
    out = []
    for mark, text in (("h", host), ("p", path)):
        text = "^" + "".join("0" if c.isdigit() else c for c in text) + "$"
        out += [xxhash.xxh64_intdigest(mark + text[k : k + n]) & ((1 << bits) - 1) for n in sizes for k in range(len(text) - n + 1)]
    return np.unique(np.array(out, np.int64))


@lru_cache(maxsize=4)
def train(labelled: tuple[tuple[int, str, str], ...] = LABELLED, bits: int = 13, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent with L2 decay; deterministic."""
    rows = [_features(h, p, bits) for _, h, p in labelled]
    x = np.zeros((len(rows), 1 << bits))
    for k, r in enumerate(rows):
        x[k, r] = 1 / np.sqrt(len(r))
    y = np.array([label for label, _, _ in labelled], float)
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(steps):
        off = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ off + decay * w)
        b -= rate * off.mean()
    return w, b


def score_of(host: str, path: str, model: tuple[np.ndarray, float], bits: int = 13) -> float:
    """Probability that a url is to be blocked."""
    w, b = model
    f = _features(host, path, bits)
    return float(1 / (1 + np.exp(-((w[f].sum() / np.sqrt(len(f)) if len(f) else 0.0) + b))))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Native expressions of host and path."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls; a chain of native tests."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=LABELLED, threshold: float = 0.5, bits: int = 13) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of each row."""
    model = train(tuple(labelled), bits)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            got = pa.array([score_of(h, p, model, bits) for h, p in pairs], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, "score"])

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    kind = rows.schema["page_id"].dataType.simpleString()
    scored = rows.mapInArrow(scores, f"page_id {kind}, host string, path string, score double")
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; reads no html."""
    return filter_urls(table(spark, sf_dir, "pages"))
