"""Queries and SQL of the structure rules over the Markdown fixture and the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import structure as S
from prosemill.plans.fixtures import MD, md_lines
from prosemill.plans.rhythm_queries import _round


def _blocks(spark, d):
    return S.line_blocks(md_lines(spark, d))


def _on(rule, **options):
    return lambda spark, d: _round(rule(_blocks(spark, d), **options))


STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x{{3000}}]+', ''), '[\s\x{{3000}}]+$', '')"
BODY = r"regexp_replace(line, '^(?:#{1,6}\s+|\s*(?:[-*+]|[0-9]+[.)])\s+)', '')"
B = rf"""WITH {MD}, b AS (
  SELECT doc_id, line_ix AS block_ix, CASE WHEN regexp_matches(line, '^#{{1,6}}\s') THEN 'heading' WHEN regexp_matches(line, '^\s*(?:[-*+]|[0-9]+[.)])\s') THEN 'item' ELSE 'paragraph' END AS kind,
    CASE WHEN regexp_matches(line, '^#{{1,6}}\s') THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 0 END AS level,
    {STRIP.format(f"replace({BODY}, '**', '')")} AS text, len(regexp_extract_all({BODY}, '{S.BOLD}')) AS n_strong,
    regexp_extract({BODY}, '^\*\*([^*]+)\*\*\s*[:：—―|｜-]|^\*\*([^*]+[:：])\*\*', 0) AS lead_label, line AS raw
  FROM md WHERE {STRIP.format("line")} <> ''
)"""
EMOJI_STRICT = S.EMOJI
CHARS = "sum(length(raw) + 1)"
LIST = "SELECT *, sum(CASE WHEN kind <> 'item' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_ix) AS run FROM b"
NEXT = "nx AS (SELECT *, lead(kind) OVER w AS next_kind, lead(level) OVER w AS next_level FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY block_ix))"
_BODY, _NEXT = f"regexp_extract(text, '{S.LABEL}', 1)", f"regexp_extract(text, '{S.LABEL}', 2)"
_NUMERIC = f"(regexp_matches({_BODY}, '^[0-9０-９]+$') OR (regexp_matches({_BODY}, '[0-9０-９]$') AND regexp_matches({_NEXT}, '^[0-9０-９]')))"
LEADS = f"""(kind IN ('paragraph', 'item') AND regexp_matches(text, '^{S.EMOJI}') AND regexp_matches(text, '[{T.JAPANESE}]'))
  OR (kind = 'paragraph' AND {_BODY} <> '' AND NOT {_NUMERIC} AND regexp_matches(text, '[{T.JAPANESE}]'))"""
SHAPE = f"CASE WHEN regexp_matches(text, '{T._NUMBERED}') THEN 'numbered' WHEN regexp_matches(text, '{T._COLON}') THEN 'colon' WHEN regexp_matches(text, '{T._QUESTION}') THEN 'question' ELSE 'plain' END"
ANNOUNCED = "regexp_extract(translate(translate(text, '一二三四五六七八九', '123456789'), '０１２３４５６７８９', '0123456789'), '(?:次|以下)の *([0-9]{1,2}) *(?:項目|つ|点|個|件)', 1)"
RESIDUE = r"\*\*([^*\s](?:[^*]{0,58}[^*\s])?)\*\*"


COMMENT = "(?s)<!-" + "-.*?-" + "->"


def html_visible_text(pages):
    """page_id, title, n_headings, n_items, n_paragraphs and the visible characters of each page's html.

    Scripts, styles, comments, templates and code are dropped with their content, other tags alone.
    """
    html = F.coalesce("html", F.lit(""))
    dropped = html
    for tag in ("script", "style", "template", "textarea", "pre", "code"):
        dropped = F.regexp_replace(dropped, f"(?s)<{tag}[ >].*?</{tag}>", " ")
    bare = F.regexp_replace(F.regexp_replace(dropped, COMMENT, " "), "<[^>]*>", " ")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(sign))
    text = F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))
    count = lambda tag: F.regexp_count(html, F.lit(f"<{tag}[ >]")).cast("long")
    return pages.select("page_id", F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"), count("h[1-6]").alias("n_headings"), count("li").alias("n_items"), count("p").alias("n_paragraphs"), count("b").alias("n_bold"), F.length(text).alias("n_visible"), F.md5(text).alias("text_md5"))


def _html_sql() -> str:
    x = "coalesce(html, '')"
    for tag in ("script", "style", "template", "textarea", "pre", "code"):
        x = f"regexp_replace({x}, '(?s)<{tag}[ >].*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '{COMMENT}', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{sign}')"
    x = f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"
    n = lambda tag: f"CAST(len(regexp_extract_all(coalesce(html, ''), '<{tag}[ >]')) AS BIGINT)"
    return f"""SELECT page_id, title, n_headings, n_items, n_paragraphs, n_bold, length(x) AS n_visible, md5(x) AS text_md5 FROM (
      SELECT page_id, regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1) AS title, {n('h[1-6]')} AS n_headings, {n('li')} AS n_items, {n('p')} AS n_paragraphs, {n('b')} AS n_bold, {x} AS x FROM pages)"""


QUERIES = {
    "md_line_blocks": lambda spark, d: _blocks(spark, d).drop("raw"),
    "s01_bold_density": _on(S.bold_density),
    "s02_bullet_ratio": _on(S.bullet_ratio),
    "s03_boilerplate": _on(S.boilerplate_headings),
    "s04_phases": _on(S.numbered_phases),
    "s05_emoji": _on(S.emoji_density),
    "s06_bold_label_list": _on(S.bold_label_lists),
    "s07_heading_shapes": _on(S.heading_template, min_headings=3, share=0.2),
    "s08_heading_emphasis": _on(S.heading_emphasis),
    "s09_structure_density": _on(S.structure_density, min_chars=100),
    "s10_label_style": _on(S.label_style),
    "s11_enumeration_mismatch": _on(S.enumeration_mismatch),
    "s12_empty_sections": _on(S.empty_sections),
    "p20_colon_list": _on(S.colon_continuation),
    "p22_citation_markers": _on(S.citation_markers),
    "p23_markup_residue": lambda spark, d: S.markup_residue(md_lines(spark, d).select("doc_id", F.col("line_ix").alias("block_ix"), F.col("line").alias("text"))).groupBy("doc_id", "block_ix", "inner").agg(F.count("*").alias("n")),
    "html_visible_text": lambda spark, d: html_visible_text(spark.read.parquet(f"{d}/pages.parquet")),
}

ORACLES = {
    "md_line_blocks": f"{B} SELECT doc_id, block_ix, kind, level, text, n_strong, lead_label FROM b",
    "s01_bold_density": f"{B}, d AS (SELECT doc_id, sum(n_strong) AS bold, sum(n_strong) * 1000.0 / greatest({CHARS}, 1) AS density FROM b GROUP BY 1) SELECT doc_id, CAST(bold AS BIGINT) AS bold, round(density, 4) AS density FROM d WHERE bold >= 3 AND density >= 3",
    "s02_bullet_ratio": f"{B}, d AS (SELECT doc_id, count(*) FILTER (WHERE kind <> 'heading') AS n, count(*) FILTER (WHERE kind = 'item') AS items FROM b GROUP BY 1) SELECT *, round(items / n, 4) AS ratio FROM d WHERE n >= 10 AND items > 0 AND items / n >= 0.35",
    "s03_boilerplate": f"{B} SELECT doc_id, block_ix, text FROM b WHERE kind = 'heading' AND regexp_matches(lower(text), '^(?:{'|'.join(S.BOILERPLATE)})')",
    "s04_phases": f"{B} SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '{S.PHASE}')) - len(regexp_extract_all(text, '{S.PHASE}[つ個]'))) AS BIGINT) AS phases FROM b GROUP BY 1 HAVING phases >= 3",
    "s05_emoji": f"{B}, d AS (SELECT doc_id, sum(len(regexp_extract_all(text, '{S.CLUSTER}'))) AS emoji, {CHARS} AS chars FROM b GROUP BY 1) SELECT doc_id, CAST(emoji AS BIGINT) AS emoji, round(emoji * 1000.0 / chars, 4) AS density FROM d WHERE emoji >= 3 AND emoji * 1000.0 / chars >= 2",
    "s06_bold_label_list": f"{B}, l AS ({LIST}) SELECT doc_id, min(block_ix) AS first_block, count(*) AS labels FROM l WHERE kind = 'item' AND lead_label <> '' GROUP BY doc_id, run HAVING count(*) >= 3",
    "s07_heading_shapes": f"""{B}, h AS (SELECT doc_id, {SHAPE} AS shape FROM b WHERE kind = 'heading' AND level >= 2), c AS (SELECT doc_id, count(*) AS headings, count(*) FILTER (WHERE shape = 'colon') AS c, count(*) FILTER (WHERE shape = 'question') AS q, count(*) FILTER (WHERE shape = 'numbered') AS m FROM h GROUP BY 1)
      SELECT doc_id, headings, CASE WHEN c = greatest(c, q, m) THEN 'colon' WHEN q = greatest(c, q, m) THEN 'question' ELSE 'numbered' END AS shape, greatest(c, q, m) AS n FROM c WHERE headings >= 3 AND greatest(c, q, m) / headings >= 0.2""",
    "s08_heading_emphasis": f"{B} SELECT doc_id, block_ix, text FROM b WHERE kind = 'heading' AND (n_strong > 0 OR regexp_matches(text, '{S.EMOJI}'))",
    "s09_structure_density": f"""{B}, d AS (SELECT doc_id, {CHARS} AS chars, count(*) FILTER (WHERE kind = 'heading') AS h, count(*) FILTER (WHERE kind = 'item') AS i FROM b GROUP BY 1)
      SELECT doc_id, round(h * 1000.0 / chars, 4) AS headings_per_1000, round(i * 1000.0 / chars, 4) AS items_per_1000 FROM d WHERE chars >= 100 AND (h * 1000.0 / chars >= 4 OR i * 1000.0 / chars >= 10)""",
    "s10_label_style": f"{B} SELECT doc_id, count(*) FILTER (WHERE {LEADS}) AS n, min(block_ix) FILTER (WHERE {LEADS}) AS first_block FROM b GROUP BY 1 HAVING n >= 3",
    "s11_enumeration_mismatch": f"""{B}, l AS ({LIST}), i AS (SELECT doc_id, run, count(*) AS items FROM l WHERE kind = 'item' GROUP BY 1, 2), a AS (SELECT doc_id, block_ix, run, {ANNOUNCED} AS x FROM l WHERE kind = 'paragraph')
      SELECT doc_id, block_ix, CAST(x AS BIGINT) AS announced, items FROM a JOIN i USING (doc_id, run) WHERE x <> '' AND CAST(x AS BIGINT) <> items""",
    "s12_empty_sections": f"{B}, {NEXT} SELECT doc_id, block_ix, text FROM nx WHERE kind = 'heading' AND (next_kind IS NULL OR (next_kind = 'heading' AND next_level <= level))",
    "p20_colon_list": f"{B}, {NEXT} SELECT doc_id, block_ix, regexp_extract(text, '{S.COLON_END}', 0) AS matched FROM nx WHERE kind = 'paragraph' AND next_kind = 'item' AND regexp_matches(text, '{S.COLON_END}')",
    "p22_citation_markers": f"{B} SELECT doc_id, block_ix, unnest(regexp_extract_all(text, '{S.CITATIONS}')) AS matched FROM b",
    "p23_markup_residue": f"WITH {MD}, r AS (SELECT doc_id, line_ix AS block_ix, unnest(regexp_extract_all(line, '{RESIDUE}', 1)) AS \"inner\" FROM md) SELECT doc_id, block_ix, \"inner\", count(*) AS n FROM r WHERE regexp_matches(\"inner\", '[{T.JAPANESE}]') GROUP BY ALL",
    "html_visible_text": _html_sql(),
}
