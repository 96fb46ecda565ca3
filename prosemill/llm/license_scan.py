"""License scans by diagonal voting, in DataFrame operations only.

A text's words are cut into rolling k-grams, which join the k-grams of all templates on
their hash and their words. A hit at word p on template position t votes for the diagonal
p - t; a license text copied verbatim fills one diagonal, one with words added or left out
a few neighbouring ones. Neighbouring diagonals merge, and a span is verified by the share
of the template's positions that it holds and by its length.

Base phrases are templates too: a place is a diagonal that holds a phrase's every position,
so base labels don't depend on thresholds. Template k-grams are the constants of this
module, a bounded table that is broadcast; only hits, and one row for each document, are
shuffled, once, by document.

Results: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the
largest share of a template that a span of the document holds, 1 for a base phrase).
Cases: a null or empty text has no words and no labels ('' for both label columns). Rows that
repeat a doc_id, or have none, are judged row by row; fully equal ones are judged once. Very long texts
are read whole, and very many hits of one text are rows; a span keeps one number for each diagonal and template. Empty table: no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.llm.common import table
from prosemill.sources.scan import spread

K = 3
#: A k-gram's neighbour diagonals: words that may be added or left out between two hits of a span.
DRIFT = 3
#: Positions of a template at most: those that a span holds are the bits of one number.
MOST = 62
#: Least share of a template's positions, and most words of a span by its template's length.
COVERED, STRETCH = 0.6, 1.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
)


def _grams(base=BASE, templates=TEMPLATES) -> list[tuple]:
    """(template, label, base, positions, words, position, three words) of each template k-gram.

    A template of more than ``MOST`` positions is cut into pieces of that many, each a template of its own.
    """
    pieces = []
    for is_base, label, text in (*((True, *b) for b in base), *((False, *t) for t in templates)):
        words = text.split()
        if len(words) < K or (is_base and len(words) - K + 1 > MOST):
            raise ValueError(f"a template needs {K} words, a base phrase at most {MOST + K - 1}: {text}")
        n = -(-(len(words) - K + 1) // MOST)
        size = -(-(len(words) - K + 1) // n)
        pieces += [(label, is_base, words[k : k + size + K - 1]) for k in range(0, len(words) - K + 1, size)]
    return [(n, label, is_base, len(words) - K + 1, len(words), k, *words[k : k + K]) for n, (label, is_base, words) in enumerate(pieces) for k in range(len(words) - K + 1)]


def _template_table(spark: SparkSession, base, templates) -> DataFrame:
    """One row for each distinct template k-gram, with all places that it has in templates."""
    names = ("tpl", "label", "base", "positions", "tpl_words", "at")
    places: dict[tuple, list[tuple]] = {}
    for row in _grams(base, templates):
        places.setdefault(row[6:], []).append(row[:6])
    cells = [F.struct(*(F.lit(w).alias(f"t{k}") for k, w in enumerate(gram)), F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(p, names, strict=True))) for p in found)).alias("places")) for gram, found in places.items()]
    return spark.range(1).select(F.inline(F.array(*cells))).withColumn("hash", F.xxhash64("t0", "t1", "t2"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """Labels of each text; see the module for the columns and for null and empty cases."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    # Rows of one id and text are one group, and come back as often as they are there: its key is the same whenever it is computed anew.
    key = F.struct(F.xxhash64(text_col), F.xxhash64(F.lit(K), text_col), F.octet_length(text_col))
    words = docs.select(key.alias("row"), F.col(id_col).alias("doc_id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w0"))
    n = F.size("w0")
    zipped = words.select("row", "doc_id", n.cast("long").alias("n_words"), "w0", F.slice("w0", F.lit(2), n).alias("w1"), F.slice("w0", F.lit(3), n).alias("w2"))
    rolled = zipped.select("row", "doc_id", "n_words", F.posexplode_outer(F.arrays_zip("w0", "w1", "w2"))).select("row", "doc_id", "n_words", "pos", "col.*")
    grams = F.broadcast(_template_table(docs.sparkSession, base, templates))
    same = (F.xxhash64("w0", "w1", "w2") == F.col("hash")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    # The first word's row stays even without a hit: it stands for the document.
    met = rolled.join(grams, same, "left").filter("places IS NOT NULL OR pos IS NULL OR pos = 0").select("row", "doc_id", "n_words", "pos", F.posexplode_outer("places").alias("nth", "p"))
    own = ["row", "doc_id", "n_words", "tpl", "label", "base", "positions", "tpl_words"]
    hits = met.select("row", "doc_id", "n_words", "pos", "p.*", (F.coalesce("pos", F.lit(0)) + F.coalesce("nth", F.lit(0)) == 0).cast("long").alias("stands")).repartition("doc_id", "row")

    bit = F.expr("shiftleft(1L, at)")
    diagonals = hits.groupBy(*own, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.bit_or(bit).alias("held"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.sum("stands").alias("stands"))
    by_template = Window.partitionBy("doc_id", "row", "tpl").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_template) > DRIFT, F.lit(True))
    merged = diagonals.withColumn("span", F.sum(apart.cast("int")).over(by_template))
    place = F.col("base") & (F.bit_count("held") == F.col("positions"))
    spans = merged.groupBy(*own, "span").agg(
        F.bit_count(F.bit_or("held")).alias("covered"),
        (F.max("high") - F.min("low") + K).alias("length"),
        F.sum(place.cast("long")).alias("places"),
        F.min(F.when(place, F.col("diagonal"))).alias("first"),
        F.max(F.when(place, F.col("diagonal"))).alias("last"),
        F.sum("stands").alias("stands"),
    )
    share = F.col("covered") / F.col("positions")
    verified = (share >= COVERED) & (F.col("length") <= STRETCH * F.col("tpl_words") + DRIFT) & ~F.col("base")
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    found = spans.groupBy("doc_id", "row", "n_words").agg(
        F.coalesce(F.sum("places"), F.lit(0)).alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        joined(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
        joined(F.when((F.col("places") > 0) | verified, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(~F.col("base") | (F.col("places") > 0), F.least(share, F.lit(1.0)))), F.lit(0.0)).alias("score"),
        F.sum("stands").cast("int").alias("stands"),
    )
    return found.withColumn("stands", F.explode(F.sequence(F.lit(1), F.col("stands")))).drop("row", "stands")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return scan_licenses(spread(table(spark, sf_dir, "documents"), "doc_id"))


_VALUES = ", ".join(f"({t}, '{label}', {str(b).lower()}, {p}, {m}, {k}, '{a} {x} {c}')" for t, label, b, p, m, k, a, x, c in _grams())
ORACLE = rf"""
WITH g(tpl, label, base, positions, tpl_words, tpos, gram) AS (VALUES {_VALUES}),
w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
x AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT r, i - 1 AS pos, g.* FROM (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM x) y JOIN g USING (gram)),
d AS (SELECT r, tpl, label, base, positions, tpl_words, pos - tpos AS diagonal, count(*) AS votes, list(DISTINCT tpos) AS held, min(pos) AS low, max(pos) AS high FROM h GROUP BY ALL),
a AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, tpl ORDER BY diagonal) <= {DRIFT} THEN 0 ELSE 1 END AS apart FROM d),
m AS (SELECT *, sum(apart) OVER (PARTITION BY r, tpl ORDER BY diagonal) AS span FROM a),
s AS (
  SELECT r, tpl, label, base, positions, tpl_words, span, len(list_distinct(flatten(list(held)))) AS covered, max(high) - min(low) + {K} AS length,
    sum(CASE WHEN base AND votes = positions THEN 1 ELSE 0 END) AS places,
    min(CASE WHEN base AND votes = positions THEN diagonal END) AS first, max(CASE WHEN base AND votes = positions THEN diagonal END) AS last
  FROM m GROUP BY ALL
), v AS (SELECT *, NOT base AND covered / positions >= {COVERED} AND length <= {STRETCH} * tpl_words + {DRIFT} AS verified FROM s),
f AS (
  SELECT r, sum(places) AS n_base, min(first) AS first_word, max(last) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE places > 0)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE places > 0 OR verified)), ',') AS labels,
    max(CASE WHEN NOT base OR places > 0 THEN covered / positions END) AS score
  FROM v GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN f USING (r)
"""
