"""The pipeline's stages against the operators' brute-force versions."""

import random
import re
from collections import Counter

import corpus_pipeline
from test_texts import WORDS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    r = random.Random(9)
    rows = []
    for k in range(120):
        lang = r.choice(["en", "de", "el"])
        rows.append((k, " ".join(r.choice(WORDS[lang].split()) + str(r.randint(0, 9)) * (k % 2) for _ in range(r.randint(20, 120))), lang, r.choice(["a", "b", None])))
    rows += [(200 + k, rows[k][1].replace(" ", "  "), rows[k][2], rows[k][3]) for k in range(10)]
    rows += [(300 + k, rows[k][1] + " zzz", rows[k][2], rows[k][3]) for k in range(50, 60)]
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (402, "12 34", "de", "b"), (None, rows[3][1] + " extra words here", "en", "a")]
    return [(*x, len(x[1] or "")) for x in rows]


def test_stages(spark, tmp_path):
    rows = documents()
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, kind)
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "unused")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    ids = [sorted((r.doc_id if r.doc_id is not None else -1) for r in d.select("doc_id").collect()) for d in seen]
    assert set(ids[0]) == {r[0] if r[0] is not None else -1 for r in rows} - {400, 401, 402}
    assert set(ids[0]) - set(ids[1]) == set(range(200, 210))
    assert {300 + k for k in range(50, 60) if len(rows[k][1].split()) > 45} <= set(ids[1]) - set(ids[2]) and set(ids[2]) >= set(range(120))
    copies = {i: ids[3].count(i) for i in set(ids[2])}
    assert max(copies.values()) <= 3
    size = {(-1 if r.doc_id is None else r.doc_id): (r.source, len(re.findall(r"\S+", r.text))) for r in seen[2].collect()}
    total = sum(n for _, n in size.values())
    assert abs(sum(copies[i] * n for i, (_, n) in size.items()) - total) <= 3 * 125
    from prosemill.llm.piece_codec import PieceCodec

    text = {(-1 if r.doc_id is None else r.doc_id): r.text for r in seen[3].collect()}
    codec = PieceCodec()
    final = seen[4].collect()
    assert len(final) == len(ids[3]) and all(codec.decode(r.piece_ids) == text[-1 if r.doc_id is None else r.doc_id] and r.n_pieces == len(r.piece_ids) for r in final)


KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra map<string,int>"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), {"a": 1}) for i, t, s in rows], KIND).repartition(3)


def test_decisions_apply_by_row(spark):
    own = lambda k: " ".join(f"w{k}x{n}" for n in range(40))
    rows = [(1, "a", "s"), (2, "b", "s"), (2, "a", "s"), (None, own(1), "s"), (None, own(2), "s"), (None, own(1), "t"), (7, own(2), "s"), (8, own(3), "s"), (8, own(3), "s"), (None, "c", "s"), (None, "c", "s")]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, frame(spark, rows), "unused").collect()), key=str)
    assert got == sorted([(1, "a"), (2, "b"), (None, own(1)), (7, own(2)), (8, own(3)), (None, "c")], key=str)
    near = [(5, own(1), "s"), (5, own(2), "s"), (5, own(1) + " more", "s"), (None, own(2) + " more", "s"), (None, own(4), "s"), (None, own(5), "s"), (None, own(4) + " x", "s"), (9, own(5) + " y", "s"), (11, own(6), "s"), (11, own(6), "s")]
    left = corpus_pipeline.drop_near_copies(spark, frame(spark, near), "unused").collect()
    by_group = lambda t: t.split("x")[0]
    assert sorted((by_group(r.text), str(r.doc_id)) for r in left) == [("w1", "5"), ("w2", "5"), ("w4", "None"), ("w5", "9"), ("w6", "11")]


def test_mix_takes_what_it_says(spark):
    from prosemill.llm import mixing

    r = random.Random(5)
    rows = [(r.choice([None, 1, 2, 3, k]), " ".join(["w"] * r.randint(1, 50)), r.choice(["a", "b", "c"])) for k in range(200)]
    rows += [(4, "same text here", "a")] * 9
    docs = frame(spark, rows)
    numbered = corpus_pipeline._numbered(docs)
    said = {x.source: x.n for x in mixing.mix_sources(numbered, id_col="_stage_row").groupBy("source").agg({"taken": "sum"}).toDF("source", "n").collect()}
    out = corpus_pipeline.mix(spark, docs, "unused").collect()
    words = {}
    for x in out:
        words[x.source] = words.get(x.source, 0) + len(x.text.split())
    assert words == said and max(Counter((x.doc_id, x.text, x.source) for x in out if x.doc_id != 4).values()) <= 3 * max(Counter(rows).values())


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() == 0


def test_near_copies_from_80_percent_go(spark):
    from test_dedup import roots, shingles

    r = random.Random(3)
    rows = []
    for base in range(90):
        words = [f"w{base}x{r.randint(0, 10**6)}" for _ in range(r.choice([20, 60, 200]))]
        rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(words[: round(len(words) * r.uniform(0.75, 0.9))])))
    rows += [(len(rows) + k, " ".join(f"exact{n}" for n in range(24 - 4 * k))) for k in range(2)]
    sets = [shingles(t) for _, t in rows]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(rows)) for b in range(a)}
    root = roots(len(rows), [pair for pair, x in alike.items() if x >= 0.8])
    low = {}
    for k, x in enumerate(root):
        low[x] = min(low.get(x, k), k)
    docs = spark.createDataFrame([(*x, "en", "a", len(x[1])) for x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sum(0.8 <= x < 0.85 for x in alike.values()) > 20 and any(x == 0.8 for x in alike.values())
    assert {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "unused").collect()} == set(low.values())
