"""Queries and SQL of the native rhythm rules, over ``documents`` and the Japanese fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import rhythm as R
from prosemill.plans.fixtures import JA, ja_sentences
from prosemill.sources import plain
from prosemill.sources.scan import spread

C = {"S": r"\s\x{3000}"}


def _docs(spark, sf_dir) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")


def doc_sentences(spark, sf_dir) -> DataFrame:
    return plain.sentences(plain.paragraphs(_docs(spark, sf_dir)))


def ja(spark, sf_dir) -> DataFrame:
    return ja_sentences(spark, sf_dir).withColumn("length", T.reading_length(F.col("text")).cast("long"))


def _round(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _on(source, rule, **options):
    return lambda spark, sf_dir: _round(rule(source(spark, sf_dir), **options))


LEN = rf"length(regexp_replace(regexp_replace(text, '[{T.ENDERS}.{C['S']}]+$', ''), '[{C['S']}]', '', 'g'))"
DOC = f"WITH RECURSIVE {plain.SQL}, {plain.sql_sentences('p')}"
JAS = f"WITH {JA}, s AS (SELECT *, {LEN} AS length FROM ja)"
END = rf"regexp_replace(text, '[{T.ENDERS}.{T.CLOSERS}{C['S']}]+$', '')"
NOMINAL = rf"regexp_matches({END}, '(?:[{T.NOUNISH}]|{'|'.join(T.FORMAL_NOUNS)})$')"


def _commas(commas: str) -> str:
    return f"len(regexp_extract_all(text, '[{commas}]'))"


def _stats(commas: str = T.COMMAS) -> str:
    x = "CASE WHEN length > 0 THEN length END"
    return f"""t AS (SELECT doc_id, count(*) AS n_sent, count({x}) AS n, coalesce(sum(length), 0) AS chars, avg({x}) AS mean, stddev_pop({x}) AS sd, max({x}) AS longest,
      sum(CASE WHEN {NOMINAL} THEN 1 ELSE 0 END) AS nominal, sum({_commas(commas)}) AS commas, max({_commas(commas)}) AS most_commas FROM s GROUP BY 1)"""


def _burst(base: str) -> str:
    return f"""{base}, {_stats()}, b AS (SELECT *, (sd - mean) / (sd + mean) AS burstiness FROM t WHERE n >= 10 AND mean > 0)
      SELECT doc_id, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(burstiness, 4) AS burstiness, CASE WHEN n >= 20 THEN 'warning' ELSE 'info' END AS severity
      FROM b WHERE burstiness < -0.5"""


ENDING = rf"CASE WHEN {END} = '' THEN NULL WHEN regexp_matches({END}, '[{T.NOUNISH}]$') THEN 'nominal' ELSE right({END}, 3) END"
LEAD = rf"""CASE WHEN regexp_extract(rest, '^([^{T.COMMAS}]{{2,5}}[{T.COMMAS}])', 1) <> '' THEN regexp_extract(rest, '^([^{T.COMMAS}]{{2,5}}[{T.COMMAS}])', 1)
  WHEN length(rest) >= 4 THEN left(rest, 4) END"""


def _leads(base: str, least: int) -> str:
    return rf"""{base}, r AS (SELECT *, regexp_extract(text, '([{T.JAPANESE}{T.ALNUM}](?s:.*))$', 1) AS rest FROM s), l AS (SELECT *, {LEAD} AS lead FROM r),
      m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, lead) AS members FROM l WHERE lead IS NOT NULL)
      SELECT doc_id, block_ix, ord, lead, members FROM m WHERE members >= {least}"""


def _conj(column: str) -> str:
    cases = []
    for c in sorted(R.CONJUNCTIONS, key=len, reverse=True):
        after = f"[^{T.JAPANESE}{T.ALNUM}]" if c[-1] in "方" else f"[^{T.HIRAGANA}]"
        cases.append(f"WHEN regexp_matches({column}, '^[{C['S']}]*{c}(?:{after}|$)') THEN '{c}'")
    return f"CASE {' '.join(cases)} ELSE '' END"


PAIRS = """n AS (SELECT *, lead(text) OVER w AS next_text, lead(block_ix) OVER w AS next_block FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY block_ix, ord)),
  pairs AS (SELECT * FROM n WHERE next_text IS NOT NULL AND next_block - block_ix <= 1)"""
FINAL = "f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix DESC, ord DESC) AS back FROM s)"
KEY = f"regexp_replace(text, '[{C['S']}]', '', 'g')"
DUP_P = f"""pt AS (SELECT doc_id, block_ix, string_agg(text, '' ORDER BY ord) AS text FROM s GROUP BY 1, 2), pk AS (SELECT doc_id, block_ix, {KEY} AS key FROM pt),
  dp AS (SELECT doc_id, block_ix, row_number() OVER (PARTITION BY doc_id, key ORDER BY block_ix) AS nth FROM pk WHERE length(key) >= 30)"""
STYLE = rf"regexp_replace({END}, '[ねよかぞ]+$', '')"


def _uniform(base: str) -> str:
    return f"""{base}, k AS (SELECT doc_id, block_ix, count(*) AS k FROM s GROUP BY 1, 2), u AS (SELECT doc_id, count(*) AS paragraphs, avg(k) AS mean, stddev_pop(k) AS sd FROM k GROUP BY 1)
      SELECT doc_id, paragraphs, round(mean, 4) AS mean, round(sd / mean, 4) AS cv FROM u WHERE paragraphs >= 4 AND mean >= 1.5 AND sd / mean < 0.15"""


def _profile(base: str, commas: str, least: int) -> str:
    return f"""{base}0, s AS (SELECT * FROM s0 WHERE length > 0), {_stats(commas)}
      SELECT doc_id, n, commas, most_commas, round(commas / n, 4) AS per_sentence FROM t WHERE n >= 20 AND commas / n >= {least}"""


QUERIES = {
    "parse_paragraphs": lambda spark, d: plain.paragraphs(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max(F.length("text")).alias("longest")),
    "split_sentences": doc_sentences,
    "sentence_lengths": lambda spark, d: doc_sentences(spark, d).groupBy((F.col("length") - F.col("length") % 10).alias("bucket")).agg(F.count("*").alias("n")),
    "r01_burstiness": _on(doc_sentences, R.low_burstiness, threshold=-0.3, info_threshold=-0.3),
    "r01_burstiness_ja": _on(ja, R.low_burstiness),
    "r02_ending_runs": _on(ja, R.repetitive_endings, min_run=2),
    "r02_ending_runs_documents": _on(doc_sentences, R.repetitive_endings),
    "r03_long_sentences": _on(doc_sentences, R.long_sentences),
    "r05_antithesis": _on(ja, R.antithesis),
    "r06_no_nominal": _on(ja, R.no_nominal_ending, min_chars=200),
    "r07_uniform_paragraphs": _on(ja, R.uniform_paragraphs),
    "r07_uniform_paragraphs_documents": _on(doc_sentences, R.uniform_paragraphs),
    "r08_repeated_leads": _on(ja, R.repeated_leads, min_count=3),
    "r08_repeated_leads_documents": _on(doc_sentences, R.repeated_leads),
    "r09_lead_conjunctions": _on(ja, R.lead_conjunctions, share=0.1),
    "r10_cleft": _on(ja, R.cleft_because),
    "r11_self_answer": _on(ja, R.self_answer),
    "r12_alternation": _on(doc_sentences, R.alternation, at_most=-0.2),
    "r12_nominal_ratio": _on(doc_sentences, R.nominal_ratio),
    "r13_comma_profile": _on(doc_sentences, R.comma_profile, per_sentence=1.0, commas=","),
    "r13_top_leads": _on(ja, R.top_comma_leads),
    "r14_duplicate_sentences": _on(ja, R.duplicate_sentences, min_chars=15),
    "r14_duplicate_paragraphs": lambda spark, d: R.duplicate_paragraphs(R.paragraph_texts(doc_sentences(spark, d))),
    "r15_future_closer": _on(ja, R.future_closer),
    "r19_action_closer": _on(ja, R.action_closer),
    "r20_mixed_style": _on(ja, R.mixed_style),
}

ORACLES = {
    "parse_paragraphs": f"WITH {plain.SQL} SELECT doc_id, count(*) AS n_paragraphs, max(length(text)) AS longest FROM p GROUP BY 1",
    "split_sentences": f"{DOC} SELECT * FROM s",
    "sentence_lengths": f"{DOC} SELECT length - length % 10 AS bucket, count(*) AS n FROM s GROUP BY 1",
    "r01_burstiness": _burst(DOC).replace("burstiness < -0.5", "burstiness < -0.3"),
    "r01_burstiness_ja": _burst(JAS),
    **{
        name: f"""{base}, e AS (SELECT doc_id, block_ix, ord, {ENDING} AS ending, row_number() OVER (PARTITION BY doc_id, block_ix ORDER BY ord) AS pos FROM s),
      g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, block_ix, ending ORDER BY ord) AS island FROM e WHERE ending IS NOT NULL)
      SELECT doc_id, block_ix, min(ord) AS first_ord, ending, count(*) AS run FROM g GROUP BY doc_id, block_ix, ending, island HAVING count(*) >= {least}"""
        for name, base, least in (("r02_ending_runs", JAS, 2), ("r02_ending_runs_documents", DOC, 3))
    },
    "r03_long_sentences": f"{DOC} SELECT doc_id, block_ix, ord, length FROM s WHERE length > 90",
    "r05_antithesis": f"""{JAS}, h AS (SELECT doc_id, sum(len(regexp_extract_all(text, 'ではなく')) + len(regexp_extract_all(text, 'だけでなく.{{0,10}}も'))) AS hits, count(*) AS n_sent FROM s GROUP BY 1)
      SELECT doc_id, CAST(hits AS BIGINT) AS hits, n_sent, round(hits / n_sent, 4) AS ratio, CASE WHEN hits / n_sent >= 0.05 THEN 'error' ELSE 'info' END AS severity FROM h WHERE hits >= 3 AND hits / n_sent >= 0.02""",
    "r06_no_nominal": f"{JAS}, {_stats()} SELECT doc_id, n_sent AS sentences, CAST(chars AS BIGINT) AS chars FROM t WHERE n_sent >= 5 AND chars >= 200 AND nominal = 0",
    "r07_uniform_paragraphs": _uniform(JAS),
    "r07_uniform_paragraphs_documents": _uniform(DOC),
    "r08_repeated_leads": _leads(JAS, 3),
    "r08_repeated_leads_documents": _leads(DOC, 6),
    "r09_lead_conjunctions": f"""{JAS}, f AS (SELECT doc_id, block_ix, arg_min(text, ord) AS text FROM s GROUP BY 1, 2),
      c AS (SELECT doc_id, count(*) AS paragraphs, CAST(sum(CASE WHEN {_conj('text')} <> '' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM f GROUP BY 1)
      SELECT *, round(hits / paragraphs, 4) AS ratio FROM c WHERE paragraphs >= 3 AND hits > 0 AND hits / paragraphs >= 0.1""",
    "r10_cleft": f"{JAS}, {PAIRS} SELECT doc_id, block_ix, ord FROM pairs WHERE regexp_matches({END}, '{R.CLEFT_HEAD}') AND regexp_matches(next_text, '{R.CLEFT_NEXT}')",
    "r11_self_answer": f"""{JAS}, {PAIRS} SELECT doc_id, block_ix, ord FROM pairs WHERE (regexp_matches(text, '[？?][{T.CLOSERS}{C['S']}]*$') OR regexp_matches({END}, '(?:でしょうか|だろうか|のか|なのか)$'))
      AND regexp_matches(next_text, '{R.ANSWER}')""",
    "r12_alternation": f"""{DOC}, d AS (SELECT doc_id, block_ix, ord, length - avg(length) OVER (PARTITION BY doc_id) AS d FROM s WHERE length > 0), l AS (SELECT *, lag(d) OVER (PARTITION BY doc_id ORDER BY block_ix, ord) AS d0 FROM d),
      a AS (SELECT doc_id, count(*) AS n, sum(d * d0) AS num, sum(d * d) AS den FROM l GROUP BY 1) SELECT doc_id, n, round(num / den, 4) AS lag1 FROM a WHERE n >= 20 AND den > 0 AND num / den <= -0.2""",
    "r12_nominal_ratio": f"{DOC}, {_stats()} SELECT doc_id, n, CAST(nominal AS BIGINT) AS nominal, round(nominal / n, 4) AS ratio FROM t WHERE n >= 10 AND nominal / n >= 0.4",
    "r13_comma_profile": _profile(DOC.replace("\ns AS (", "\ns00 AS (") + ", s", ",", 1).replace("FROM s0 WHERE", "FROM s00 WHERE").replace(", s0, s AS", ", s AS"),
    "r13_top_leads": f"""{JAS}, h AS (SELECT doc_id, block_ix, ord, unnest(ls) AS lead, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, block_ix, ord, regexp_extract_all(text, '([{T.HIRAGANA}]{{2}}|[^{T.COMMAS}])[{T.COMMAS}]', 1) AS ls FROM s)),
      g AS (SELECT doc_id, lead, count(*) AS n, min({{'b': block_ix, 'o': ord, 'a': pos}}) AS first FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM g)
      SELECT doc_id, rank, lead, n FROM r WHERE rank <= 5""",
    "r14_duplicate_sentences": f"""{JAS}, {DUP_P.replace('>= 30', '>= 15')}, k AS (SELECT doc_id, block_ix, ord, {KEY} AS key FROM s), n AS (SELECT doc_id, block_ix, ord, row_number() OVER (PARTITION BY doc_id, key ORDER BY block_ix, ord) AS nth FROM k WHERE length(key) >= 15)
      SELECT n.* FROM n WHERE nth > 1 AND NOT EXISTS (SELECT 1 FROM dp WHERE dp.nth > 1 AND dp.doc_id = n.doc_id AND dp.block_ix = n.block_ix)""",
    "r14_duplicate_paragraphs": f"{DOC}, {DUP_P} SELECT * FROM dp WHERE nth > 1",
    "r15_future_closer": rf"""{JAS}, {FINAL}, e AS (SELECT doc_id, arg_min(text, back) AS "end", arg_max(text, back) AS before, count(*) AS k FROM f WHERE back <= 2 GROUP BY 1)
      SELECT doc_id, before, "end" FROM e WHERE k = 2 AND regexp_matches("end", '{R.FUTURE_LAST}') AND regexp_matches(before, '{R.FUTURE_FIRST}') AND NOT regexp_matches("end" || before, '[0-9０-９「」『』\[]|http')""",
    "r19_action_closer": rf"""{JAS}, {FINAL} SELECT doc_id, text FROM f WHERE back = 1 AND regexp_matches(text, '{R.ACTION_LEAD}[^。！？!?\n]{{0,90}}{R.ACTION_END}[。！!]?$') AND NOT regexp_matches(text, '[0-9０-９「」『』（）()]|https?://')""",
    "r20_mixed_style": f"""{JAS}, y AS (SELECT doc_id, CASE WHEN regexp_matches({STYLE}, '(?:{'|'.join(R.POLITE)})$') THEN 'polite' WHEN regexp_matches({STYLE}, '(?:{'|'.join(R.PLAIN)}|[{T.KANJI}]だ)$') THEN 'plain' END AS style FROM s),
      z AS (SELECT doc_id, count(*) FILTER (WHERE style = 'polite') AS polite, count(*) FILTER (WHERE style = 'plain') AS plain FROM y GROUP BY 1) SELECT * FROM z WHERE polite >= 2 AND plain >= 2""",
}
