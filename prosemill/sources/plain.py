"""Plain text as native tables: paragraphs and sentences without a Python worker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.functions.text import CLOSERS, ENDERS, reading_length, strip_space

#: Where a sentence ends: an ideographic ender with the closing brackets after it, or ASCII enders before a space.
BREAK = f"([{ENDERS.replace('!', '').replace('?', '')}]+[{CLOSERS}]*|[.!?]+[ \\t]+)"
SEP = "\u0001"


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, block_ix, text: one row for each line that isn't blank; block_ix is the line's number.

    Null and blank texts have no rows.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "^﻿", ""), r"\r\n?", "\n")
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("block_ix", "line"))
    return lines.select("doc_id", "block_ix", strip_space(F.col("line")).alias("text")).filter("text <> ''")


def blank_line_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, block_ix, text: lines between blank lines, joined; block_ix counts from 0.

    One array of lines for each document keeps the work in its row; no shuffle.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "^﻿", ""), r"\r\n?", "\n")
    blocks = F.split(F.regexp_replace(text, r"\n[ \t\x{3000}]*(?:\n[ \t\x{3000}]*)+", SEP), SEP)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(blocks).alias("block_ix", "text"))
    return rows.select("doc_id", "block_ix", strip_space(F.regexp_replace("text", r"\n", " ")).alias("text")).filter("text <> ''")


def sentences(blocks: DataFrame) -> DataFrame:
    """doc_id, block_ix, ord, text, length: the blocks' sentences; blank ones are left out."""
    parts = F.split(F.regexp_replace("text", BREAK, f"$1{SEP}"), SEP)
    rows = blocks.select("doc_id", "block_ix", F.posexplode(parts).alias("ord", "text"))
    rows = rows.select("doc_id", "block_ix", "ord", strip_space(F.col("text")).alias("text")).filter("text <> ''")
    return rows.withColumn("length", reading_length(F.col("text")).cast("long"))


#: The same in SQL over the view ``documents``: ``p`` has paragraphs, ``s`` sentences.
SQL_BREAK = BREAK.replace("\\t", "\t")
SQL = rf"""
p AS (
  SELECT doc_id, block_ix, text FROM (
    SELECT doc_id, block_ix, regexp_replace(regexp_replace(ls[block_ix + 1], '^[\s\x{{3000}}]+', ''), '[\s\x{{3000}}]+$', '') AS text FROM (
      SELECT doc_id, ls, unnest(range(len(ls))) AS block_ix FROM (
        SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^\x{{FEFF}}', ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents)))
  WHERE text <> ''
)"""


def sql_sentences(blocks: str, name: str = "s") -> str:
    """SQL of ``sentences`` over a relation of blocks."""
    length = f"length(regexp_replace(regexp_replace(text, '[{ENDERS}.\\s\\x{{3000}}]+$', ''), '[\\s\\x{{3000}}]', '', 'g'))"
    return rf"""
{name} AS (
  SELECT doc_id, block_ix, ord, text, {length} AS length FROM (
    SELECT doc_id, block_ix, ord, regexp_replace(regexp_replace(ps[ord + 1], '^[\s\x{{3000}}]+', ''), '[\s\x{{3000}}]+$', '') AS text FROM (
      SELECT doc_id, block_ix, ps, unnest(range(len(ps))) AS ord FROM (
        SELECT doc_id, block_ix, string_split(regexp_replace(text, '{SQL_BREAK}', '\1' || chr(1), 'g'), chr(1)) AS ps FROM {blocks})))
  WHERE text <> ''
)"""
