"""Queries and SQL of phrase counts, findings, calibration, revisions and custom rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import calibrate as C
from prosemill.operators import findings as G
from prosemill.operators import phrases as P
from prosemill.operators import revision as V
from prosemill.operators.custom import CustomRule, apply_custom
from prosemill.operators.phrase_data import CATALOGUE, RULES, alternation
from prosemill.plans.fixtures import JA, JB, jb_sentences
from prosemill.plans.rhythm_queries import DOC, JAS, NOMINAL, _commas, _round, doc_sentences, ja

COUNTED = tuple(sorted(CATALOGUE))
FIRST = ("P02", "P04", "P05", "P06", "P07", "P08", "P12", "P18", "P19", "P27", "P29")
BASE = ("P02", "P04", "P05", "P06", "P07", "P08", "P12", "P18", "P19", "P27")


def _q(text: str) -> str:
    return text.replace("'", "''")


def ja_findings(spark, d):
    """One row for each sentence and base rule with a hit: pos and line are the sentence's place."""
    of = lambda k: F.create_map(*(F.lit(x) for r in BASE for x in (r, RULES[r][k])))[F.col("rule_id")]
    return P.rule_hits(ja(spark, d), BASE).select("doc_id", "block_ix", F.col("ord").alias("line"), F.col("ord").alias("pos"), "text", "rule_id", of(3).alias("severity"), of(1).alias("lane"), F.size("hits").cast("long").alias("n"), F.col("hits")[0].alias("matched"))


FIND = (
    f"WITH {JA}, f AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, block_ix, ord AS line, ord AS pos, text, '{r}' AS rule_id, '{RULES[r][3]}' AS severity, '{RULES[r][1]}' AS lane, len(regexp_extract_all(text, '{_q(alternation(r))}')) AS n, regexp_extract(text, '{_q(alternation(r))}', 0) AS matched FROM ja WHERE regexp_matches(text, '{_q(alternation(r))}')"
        for r in BASE
    )
    + ")"
)
RANK = "CASE severity WHEN 'info' THEN 1 WHEN 'warning' THEN 2 WHEN 'error' THEN 3 ELSE 0 END"


def _regions(spark, d):
    """Regions of suppression by id: a whole file, a line, a range of lines."""
    ids = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    k = F.col("doc_id") % 4
    make = lambda kind, low, high, rules, but: F.struct(F.lit(kind).alias("kind"), F.lit(low).cast("int").alias("low"), F.lit(high).cast("int").alias("high"), F.array(*map(F.lit, rules)).cast("array<string>").alias("rules"), F.lit(but).alias("all_but"), F.lit("reviewed").alias("reason"))
    rows = F.when(k == 0, F.array(make("file", None, None, ["P05"], False))).when(k == 1, F.array(make("line", 3, 3, [], True), make("range", 5, 9, ["P04", "P06"], False))).when(k == 2, F.array(make("range", 4, None, ["P05"], True))).otherwise(F.array(make("file", None, None, ["P99"], False)))
    return ids.select("doc_id", F.posexplode(rows).alias("ix", "r")).select("doc_id", "ix", "r.*")


_SUPPRESSED = "(doc_id % 4 = 0 AND rule_id = 'P05') OR (doc_id % 4 = 1 AND (line = 3 OR (pos >= 5 AND pos < 9 AND rule_id IN ('P04', 'P06')))) OR (doc_id % 4 = 2 AND pos >= 4 AND rule_id <> 'P05')"


def _groups(spark, d):
    """Labelled documents as the two groups, with the characters of their Japanese text."""
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.when(F.col("quality") == 1, "human").otherwise("generated").alias("grp"))
    return ja(spark, d).groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars")).join(labels, "doc_id")


GROUPS = "g AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'human' ELSE 'generated' END AS grp, chars FROM (SELECT doc_id, sum(length(text)) AS chars FROM ja GROUP BY 1) JOIN labels USING (doc_id))"
N = "nn AS (SELECT count(*) FILTER (WHERE grp = 'human') AS n_human, count(*) FILTER (WHERE grp = 'generated') AS n_generated, greatest(coalesce(sum(chars) FILTER (WHERE grp = 'human'), 0), 1) AS chars_human, greatest(coalesce(sum(chars) FILTER (WHERE grp = 'generated'), 0), 1) AS chars_generated FROM g)"
Z = 1.6449


def _rates_sql(by: str, source: str) -> str:
    return f"""{GROUPS}, {N}, per AS (SELECT doc_id, {by}, sum(n) AS n, max({RANK}) AS worst FROM {source} GROUP BY ALL), hit AS (SELECT per.*, grp FROM per JOIN g USING (doc_id)),
  agg AS (SELECT {by}, count(*) FILTER (WHERE grp = 'human') AS docs_human, count(*) FILTER (WHERE grp = 'generated') AS docs_generated, count(*) FILTER (WHERE grp = 'human' AND worst >= 2) AS warned_human,
    count(*) FILTER (WHERE grp = 'generated' AND worst >= 2) AS warned_generated, CAST(coalesce(sum(n) FILTER (WHERE grp = 'human'), 0) AS BIGINT) AS findings_human, CAST(coalesce(sum(n) FILTER (WHERE grp = 'generated'), 0) AS BIGINT) AS findings_generated FROM hit GROUP BY ALL),
  rates AS (SELECT {by}, docs_human, docs_generated, warned_human, warned_generated, findings_human, findings_generated, n_human, n_generated, round(findings_human * 1000.0 / chars_human, 4) AS per_1000_human, round(findings_generated * 1000.0 / chars_generated, 4) AS per_1000_generated,
    round(least(1.0, (docs_human / n_human + {Z * Z / 2} / n_human + {Z} * sqrt(docs_human / n_human * (1 - docs_human / n_human) / n_human + {Z * Z / 4} / n_human / n_human)) / (1 + {Z * Z} / n_human)), 4) AS fp_upper,
    CASE WHEN docs_human + docs_generated < 5 THEN NULL WHEN docs_generated >= 5 AND docs_generated / n_generated + 1e-9 >= 3 * docs_human / n_human AND docs_human / n_human <= 0.05 + 1e-9 THEN 'strong'
      WHEN docs_human >= 5 AND docs_generated / n_generated <= 1.5 * docs_human / n_human + 1e-9 THEN 'weak' ELSE 'moderate' END AS signal FROM agg, nn)"""


def _measures(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.when(F.col("quality") == 1, "human").otherwise("generated").alias("grp"))
    from prosemill.operators.rhythm import doc_stats

    stats = doc_stats(doc_sentences(spark, d)).filter("n >= 10 AND mean > 0")
    return stats.select("doc_id", F.round((F.col("sd") - F.col("mean")) / (F.col("sd") + F.col("mean")), 6).alias("value")).join(labels, "doc_id")


def _edited(s):
    """The second revision: a word less, a number changed, every seventh sentence gone, one added."""
    text = F.replace(F.replace(F.replace("text", F.lit("非常に重要"), F.lit("重要")), F.lit("三段"), F.lit("四段")), F.lit("在庫"), F.lit("在庫12,000個"))
    return s.filter("ord % 7 <> 6").withColumn("text", F.when(F.col("ord") == 2, F.concat(text, F.lit("多くの人が使うGuide v2を3万円で買う。"))).otherwise(text)).withColumn("length", T.reading_length(F.col("text")).cast("long"))


EDITED = "ed AS (SELECT doc_id, block_ix, ord, CASE WHEN ord = 2 THEN t || '多くの人が使うGuide v2を3万円で買う。' ELSE t END AS text FROM (SELECT *, replace(replace(replace(text, '非常に重要', '重要'), '三段', '四段'), '在庫', '在庫12,000個') AS t FROM ja WHERE ord % 7 <> 6))"


def _matched(s):
    rows = P.rule_hits(s, BASE).select("doc_id", F.col("ord").cast("long").alias("ix"), "text", "rule_id", F.col("hits")[0].alias("matched")).filter("matched <> ''")
    return rows.select("doc_id", "ix", "rule_id", "matched", F.md5(F.concat_ws("|", "rule_id", "text")).alias("fingerprint"))


def _matched_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, ord AS ix, '{r}' AS rule_id, regexp_extract(text, '{_q(alternation(r))}', 0) AS matched, md5('{r}|' || text) AS fingerprint FROM {source} WHERE regexp_matches(text, '{_q(alternation(r))}')" for r in BASE)


CUSTOM = [CustomRule("X1", "STOREHOUSE", "倉庫", "倉庫と書かない"), CustomRule("X2", "CLOCK", "[朝夕]に", "時刻を書く", severity="info", regex=True)]
ROLE = [CustomRule("X3", "SHORT_WORDS", "(?:de|la|the|of) ", "", severity="info", regex=True)]


def _facts_before(spark, d):
    return ja(spark, d).select("doc_id", "text")


def _facts_after(spark, d):
    return _edited(ja(spark, d)).select("doc_id", "text")


def _page_facts(spark, d):
    return V.facts(spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")), ("url",))


QUERIES = {
    **{f"{r.lower()}_counts": (lambda r: lambda spark, d: P.native_counts(ja(spark, d) if r in FIRST else jb_sentences(spark, d), r))(r) for r in COUNTED},
    "p01_closing": lambda spark, d: P.find_phrases(jb_sentences(spark, d), ("P01",)).groupBy("doc_id", "item").agg(F.count("*").alias("n")),
    "p15_kanji_runs": lambda spark, d: ja(spark, d).select("doc_id", "ord", F.explode(F.regexp_extract_all("text", F.lit(f"[{T.KANJI}]{{7,}}"), F.lit(0))).alias("run")),
    "phrase_findings": lambda spark, d: P.find_phrases(ja(spark, d)),
    "phrase_findings_b": lambda spark, d: P.find_phrases(jb_sentences(spark, d)),
    "phrase_findings_by_rule": lambda spark, d: P.find_phrases(ja(spark, d), tuple(r for r in P.SENTENCE_RULES if r in ("P04", "P05", "P07", "P19"))).groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")),
    "suppress_apply": lambda spark, d: G.suppress(ja_findings(spark, d), _regions(spark, d)).groupBy("rule_id", "suppressed").agg(F.count("*").alias("n")),
    "rule_summary_rollup": lambda spark, d: G.summary(ja_findings(spark, d)),
    "brief_topk": lambda spark, d: G.brief(ja_findings(spark, d), 3),
    "fail_on_warning": lambda spark, d: G.fail_on(ja_findings(spark, d), "warning"),
    "changed_line_filter": lambda spark, d: G.in_changed_lines(ja_findings(spark, d), ja(spark, d).filter("ord % 3 = 0").select("doc_id", F.col("ord").alias("line"))).select("doc_id", "rule_id", "line", "n"),
    "report_counts": lambda spark, d: ja_findings(spark, d).groupBy("doc_id").pivot("severity", ["info", "warning", "error"]).agg(F.count("rule_id")).fillna(0),
    "calibrate_rates": lambda spark, d: _round(C.rates(ja_findings(spark, d), _groups(spark, d))),
    "calibrate_items": lambda spark, d: C.top_items(ja_findings(spark, d).groupBy("rule_id", F.col("matched").alias("item")).agg(F.sum("n").alias("n"))),
    "calibrate_reviews": lambda spark, d: C.reviews(C.rates(ja_findings(spark, d), _groups(spark, d))),
    "calibrate_disagreements": lambda spark, d: C.disagreements(C.rates(ja_findings(spark, d), _groups(spark, d)), spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule_id"), F.lit(RULES[r][2]).alias("declared")) for r in BASE))))),
    "calibrate_sweep": lambda spark, d: C.sweep(_measures(spark, d)),
    "calibrate_split": lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", C.holdout(F.col("doc_id")).alias("held_out")),
    "diff_findings": lambda spark, d: V.compare_findings(_matched(ja(spark, d)), _matched(_edited(ja(spark, d)))),
    "diff_facts": lambda spark, d: V.compare_facts(_facts_before(spark, d), _facts_after(spark, d), ("latin", "katakana", "quoted")),
    "diff_fact_numbers": lambda spark, d: V.compare_facts(_facts_before(spark, d), _facts_after(spark, d), ("number",)),
    "diff_fact_urls_dates": lambda spark, d: V.compare_facts(_facts_before(spark, d), _facts_after(spark, d), ("url", "date")),
    "diff_shifts": lambda spark, d: _round(V.shifts(ja(spark, d), _edited(ja(spark, d)))),
    "facts_urls": _page_facts,
    "custom_rules": lambda spark, d: apply_custom(ja(spark, d), CUSTOM),
    "custom_rule_by_role": lambda spark, d: apply_custom(spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_ix"), F.col("role").alias("ord"), F.lower("text").alias("text")), ROLE).groupBy(F.col("ord").alias("role")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("conversations")),
}

ORACLES = {
    **{f"{r.lower()}_counts": f"WITH {JA if r in FIRST else JB} SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '{_q(alternation(r))}'))) AS BIGINT) AS n FROM {'ja' if r in FIRST else 'jb'} GROUP BY 1 HAVING n > 0" for r in COUNTED},
    "p15_kanji_runs": f"WITH {JA} SELECT doc_id, ord, unnest(regexp_extract_all(text, '[{T.KANJI}]{{7,}}')) AS run FROM ja",
    "phrase_findings_by_rule": f"WITH {JA}, c AS ("
    + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, doc_id, len(regexp_extract_all(text, '{_q(alternation(r))}')) AS n FROM ja" for r in ("P04", "P05", "P07", "P19"))
    + ") SELECT rule_id, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT doc_id) AS docs FROM c WHERE n > 0 GROUP BY 1",
    "suppress_apply": f"{FIND} SELECT rule_id, {_SUPPRESSED} AS suppressed, count(*) AS n FROM f GROUP BY 1, 2",
    "rule_summary_rollup": f"{FIND} SELECT lane, severity, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM f GROUP BY ROLLUP (lane, severity)",
    "brief_topk": f"{FIND}, r AS (SELECT doc_id, rule_id, pos, count(*) OVER (PARTITION BY doc_id, rule_id) AS total, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY pos) AS rank FROM f) SELECT doc_id, rule_id, rank, pos, total, greatest(total - 3, 0) AS omitted FROM r WHERE rank <= 3",
    "fail_on_warning": f"{FIND} SELECT doc_id, max({RANK}) AS worst FROM f GROUP BY 1 HAVING worst >= 2",
    "changed_line_filter": f"{FIND} SELECT doc_id, rule_id, line, n FROM f WHERE line % 3 = 0",
    "report_counts": f"{FIND} SELECT doc_id, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'error') AS error FROM f GROUP BY 1",
    "calibrate_rates": f"{FIND}, {_rates_sql('rule_id', 'f')} SELECT * FROM rates",
    "calibrate_items": f"{FIND}, i AS (SELECT rule_id, matched AS item, sum(n) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, item) AS rank FROM i) SELECT rule_id, rank, item, CAST(n AS BIGINT) AS n FROM r WHERE rank <= 3",
    "calibrate_reviews": f"""{FIND}, {_rates_sql('rule_id', 'f')}, v AS (SELECT rule_id, docs_human, docs_generated, CASE WHEN warned_human / n_human > 0.05 THEN 'false_positives' WHEN docs_human + docs_generated >= 5 AND docs_generated / n_generated <= 1.5 * docs_human / n_human + 1e-9 THEN 'no_separation'
      WHEN docs_human / n_human > 0.5 THEN 'info_burden' END AS review FROM rates) SELECT * FROM v WHERE review IS NOT NULL""",
    "calibrate_disagreements": f"{FIND}, {_rates_sql('rule_id', 'f')}, dc(rule_id, declared) AS (VALUES {', '.join(f'({chr(39)}{r}{chr(39)}, {chr(39) + RULES[r][2] + chr(39) if RULES[r][2] else chr(78) + chr(85) + chr(76) + chr(76)})' for r in BASE)}) SELECT rule_id, declared, signal AS measured FROM rates JOIN dc USING (rule_id) WHERE signal IS NOT NULL AND signal <> declared",
    "calibrate_sweep": f"""{DOC}, st AS (SELECT doc_id, count(*) AS n, avg(length) AS mean, stddev_pop(length) AS sd FROM s WHERE length > 0 GROUP BY 1), m AS (SELECT round((sd - mean) / (sd + mean), 6) AS value, CASE WHEN quality = 1 THEN 'human' ELSE 'generated' END AS grp FROM st JOIN labels USING (doc_id) WHERE n >= 10 AND mean > 0),
      c AS (SELECT round(value, 2) AS threshold, count(*) FILTER (WHERE grp = 'human') AS h, count(*) FILTER (WHERE grp = 'generated') AS a FROM m GROUP BY 1),
      x AS (SELECT threshold, CAST(coalesce(sum(h) OVER w, 0) AS BIGINT) AS human, CAST(coalesce(sum(a) OVER w, 0) AS BIGINT) AS generated, CAST(sum(h) OVER () AS BIGINT) AS n_human, CAST(sum(a) OVER () AS BIGINT) AS n_generated FROM c WINDOW w AS (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      y AS (SELECT *, human <= 0.05 * n_human + 1e-9 AS usable FROM x) SELECT *, row_number() OVER (ORDER BY usable DESC, generated DESC, human, threshold) AS rank FROM y""",
    "calibrate_split": "SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 AS held_out FROM documents",
    "diff_findings": f"""WITH {JA}, {EDITED}, b AS ({_matched_sql('ja')}), a AS ({_matched_sql('ed')}),
      b1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id, fingerprint ORDER BY ix) AS k FROM b), a1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id, fingerprint ORDER BY ix) AS k FROM a),
      p1 AS (SELECT b1.doc_id, b1.rule_id, b1.ix AS before_ix, a1.ix AS after_ix FROM b1 JOIN a1 USING (doc_id, rule_id, fingerprint, k)),
      b2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id, matched ORDER BY ix) AS j FROM b1 WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.doc_id = b1.doc_id AND p1.rule_id = b1.rule_id AND p1.before_ix = b1.ix)),
      a2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id, matched ORDER BY ix) AS j FROM a1 WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.doc_id = a1.doc_id AND p1.rule_id = a1.rule_id AND p1.after_ix = a1.ix)),
      p2 AS (SELECT b2.doc_id, b2.rule_id, b2.ix AS before_ix, a2.ix AS after_ix FROM b2 JOIN a2 USING (doc_id, rule_id, matched, j))
      SELECT *, 'persisting' AS status FROM p1 UNION ALL SELECT *, 'carried_over' FROM p2
      UNION ALL SELECT doc_id, rule_id, ix, NULL, 'resolved' FROM b2 WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.doc_id = b2.doc_id AND p2.rule_id = b2.rule_id AND p2.before_ix = b2.ix)
      UNION ALL SELECT doc_id, rule_id, NULL, ix, 'new' FROM a2 WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.doc_id = a2.doc_id AND p2.rule_id = a2.rule_id AND p2.after_ix = a2.ix)""",
    "diff_facts": f"""WITH {JA}, {EDITED}, n AS (SELECT doc_id, sum(CASE WHEN ord = 2 THEN 1 ELSE 0 END) AS k FROM ed GROUP BY 1)
      SELECT doc_id, 'latin' AS kind, unnest(['guide', 'v2']) AS key, 0 AS n_before, 1 AS n_after, 'added' AS status, false AS suspicious FROM n WHERE k > 0""",
    "diff_shifts": f"""{JAS}, {EDITED}, t AS (SELECT *, length(regexp_replace(regexp_replace(text, '[{T.ENDERS}.\\s\\x{{3000}}]+$', ''), '[\\s\\x{{3000}}]', '', 'g')) AS length FROM ed),
      sb AS (SELECT doc_id, count(*) AS n, (stddev_pop(length) - avg(length)) / (stddev_pop(length) + avg(length)) AS bu, sum({_commas(T.COMMAS)}) / count(*) AS co, sum(CASE WHEN {NOMINAL} THEN 1 ELSE 0 END) / count(*) AS no FROM s WHERE length > 0 GROUP BY 1),
      sa AS (SELECT doc_id, count(*) AS n, (stddev_pop(length) - avg(length)) / (stddev_pop(length) + avg(length)) AS bu, sum({_commas(T.COMMAS)}) / count(*) AS co, sum(CASE WHEN {NOMINAL} THEN 1 ELSE 0 END) / count(*) AS no FROM t WHERE length > 0 GROUP BY 1),
      j AS (SELECT doc_id, least(sb.n, sa.n) AS n, sb.bu AS bb, sa.bu AS ba, sb.co AS cb, sa.co AS ca, sb.no AS nb, sa.no AS na FROM sb JOIN sa USING (doc_id))
      SELECT doc_id, 'burstiness' AS kind, round(bb, 4) AS before, round(ba, 4) AS after FROM j WHERE n >= 10 AND abs(ba - bb) >= 0.15
      UNION ALL SELECT doc_id, 'commas', round(cb, 4), round(ca, 4) FROM j WHERE n >= 8 AND (abs(ca - cb) >= 0.8 OR abs(ca - cb) >= 0.4 * greatest(cb, 1e-9))
      UNION ALL SELECT doc_id, 'nominal_endings', round(nb, 4), round(na, 4) FROM j WHERE n >= 8 AND abs(na - nb) >= 0.15""",
    "facts_urls": f"SELECT page_id AS doc_id, 'url' AS kind, regexp_replace(unnest(regexp_extract_all(url, '{V.URL}')), '[.,。、！？!?:;’”]+$', '') AS key FROM pages",
    "custom_rules": f"""WITH {JA}, x AS (SELECT doc_id, block_ix, ord, 'X1' AS rule_id, 'warning' AS severity, 'custom' AS lane, regexp_extract_all(text, '倉庫') AS ms FROM ja UNION ALL SELECT doc_id, block_ix, ord, 'X2', 'info', 'custom', regexp_extract_all(text, '[朝夕]に') FROM ja)
      SELECT doc_id, block_ix, ord, rule_id, severity, lane, generate_subscripts(ms, 1) - 1 AS nth, unnest(ms) AS matched FROM x""",
    "custom_rule_by_role": r"SELECT role, CAST(sum(k) AS BIGINT) AS n, count(DISTINCT conv_id) FILTER (WHERE k > 0) AS conversations FROM (SELECT conv_id, role, len(regexp_extract_all(lower(text), '(?:de|la|the|of) ')) AS k FROM conversations) GROUP BY 1 HAVING sum(k) > 0",
}
