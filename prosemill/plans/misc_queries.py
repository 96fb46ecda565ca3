"""Queries of the parsers, list rules and the whole engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import lists as L
from prosemill.plans.engine import Engine
from prosemill.plans.fixtures import JB, jb_sentences, md_lines
from prosemill.plans.rhythm_queries import LEN, _round
from prosemill.sources.parser import directives, parse, sentence_table


def jb(spark, d):
    return jb_sentences(spark, d).withColumn("length", T.reading_length(F.col("text")).cast("long"))


def md_docs(spark, d):
    """The Markdown fixture as documents, one source each."""
    lines = md_lines(spark, d)
    source = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "line"))), lambda x: x["line"]))
    return lines.groupBy("doc_id").agg(source.alias("source")).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".md")).alias("name"), F.lit("markdown").alias("format"), "source")


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("source"), F.lit("html").alias("format"))


JBS = f"WITH {JB}, s AS (SELECT *, {LEN} AS length FROM jb)"
_BRACKETS = f"[{T.OPENERS}{T.CLOSERS}{T.PLACEHOLDER}]"
_SHORT = L._EVAL.replace("(?:に|で|な)?", "(?:に|で|な)")
_SECOND = f"(?:^|[^{T.NOUNISH}、，・]){L._EVAL}[、，・]{L._EVAL}[、，・]{_SHORT}[^、，・]"
_F = ", ".join(f"sum(len(regexp_extract_all(text, '{p}'))) AS f{k}" for k, p in enumerate(L.FAMILIES))
_FS = range(len(L.FAMILIES))

QUERIES = {
    "r04_buried_lists": lambda spark, d: L.buried_lists(jb(spark, d), min_chars=40),
    "r16_triads": lambda spark, d: L.evaluative_triads(jb(spark, d), 1),
    "r17_guide_density": lambda spark, d: _round(L.guide_density(jb(spark, d), min_chars=50, min_families=1)),
    "r18_nominal_lists": lambda spark, d: L.nominal_lists(jb(spark, d), 1, 10),
    "r21_short_slogans": lambda spark, d: L.short_slogans(jb(spark, d), 1),
    "r22_phrase_clusters": lambda spark, d: L.phrase_clusters(jb(spark, d), 120, 2),
    "parse_html": lambda spark, d: parse(_pages(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")),
    "parse_markdown": lambda spark, d: parse(md_docs(spark, d)).select("doc_id", "block_ix", "kind", "level", "text", "start", "end", "n_strong"),
    "parse_markdown_sentences": lambda spark, d: sentence_table(parse(md_docs(spark, d))).select("doc_id", "block_ix", "ord", "text", "length", "source_start", "source_end"),
    "directives": lambda spark, d: directives(md_docs(spark, d).withColumn("source", F.concat(F.lit("<!-- prosemill-disable-file S01, S02 -- fixture -->\n"), "source"))),
    "engine_lint": lambda spark, d: Engine().lint(md_docs(spark, d)).groupBy("rule_id", "severity", "suppressed").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")),
}

ORACLES = {
    "r16_triads": f"""{JBS} SELECT doc_id, count(*) FILTER (WHERE NOT regexp_matches(text, '{_BRACKETS}') AND (regexp_matches(text, '{L.TRIAD}') OR regexp_matches(text, '{_SECOND}'))) AS triads FROM s GROUP BY 1 HAVING triads >= 1""",
    "r17_guide_density": f"""{JBS}, g AS (SELECT doc_id, sum(length) AS chars, {_F} FROM s GROUP BY 1), h AS (SELECT doc_id, chars, {' + '.join(f'f{k}' for k in _FS)} AS hits, {' + '.join(f'CAST(f{k} > 0 AS INT)' for k in _FS)} AS families FROM g)
      SELECT doc_id, CAST(hits AS BIGINT) AS hits, CAST(families AS BIGINT) AS families, round(hits * 1000.0 / greatest(chars, 1), 4) AS density FROM h WHERE chars >= 50 AND families >= 1 AND hits * 1000.0 / greatest(chars, 1) >= 2""",
    "r18_nominal_lists": f"""{JBS} SELECT doc_id, count(*) FILTER (WHERE length >= 10 AND regexp_matches(text, '{L.NOMINAL_LIST}') AND NOT regexp_matches(text, '^(?:[そこ]の(?:結果|後|ため)|その一方|その反面)')) AS lists FROM s GROUP BY 1 HAVING lists >= 1""",
}
