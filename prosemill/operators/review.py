"""A review protocol: which techniques to look for, and whether observations hold up.

A reviewer answers with observations (doc_id, technique, found, quote). Validation is relational:
every technique answered once for each document, every positive answer with a quotation that stands in a
block of the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TECHNIQUES = (
    "concrete_opening", "claim_before_reason", "evidence_for_numbers", "named_sources", "own_experience", "counterexample", "limits_stated", "terms_defined", "one_topic_per_paragraph", "varied_sentence_length", "active_subjects", "no_stock_phrases",
    "no_empty_praise", "lists_only_for_parallels", "headings_say_content", "links_resolve", "reader_addressed", "ending_adds_something",
)


def requests(docs: DataFrame) -> DataFrame:
    """One JSON request for each document (doc_id, source)."""
    items = F.array(*map(F.lit, TECHNIQUES))
    return docs.select("doc_id", F.to_json(F.struct(F.lit(1).alias("version"), items.alias("techniques"), F.col("source").alias("text"))).alias("request"))


def responses(raw: DataFrame) -> DataFrame:
    """Observations from JSON answers (doc_id, response)."""
    kind = "array<struct<technique:string,found:boolean,quote:string>>"
    return raw.select("doc_id", F.explode(F.from_json("response", kind)).alias("o")).select("doc_id", "o.*")


def problems(spark: SparkSession, observations: DataFrame, docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, technique and problem: unknown, missing, repeated, no_quote or quote_not_found."""
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, TECHNIQUES))).alias("technique"))
    unknown = observations.join(F.broadcast(known), "technique", "left_anti").select("doc_id", "technique", F.lit("unknown").alias("problem"))
    expected = docs.select("doc_id", F.explode(F.array(*map(F.lit, TECHNIQUES))).alias("technique"))
    missing = expected.join(observations, ["doc_id", "technique"], "left_anti").select("doc_id", "technique", F.lit("missing").alias("problem"))
    repeated = observations.groupBy("doc_id", "technique").count().filter("count > 1").select("doc_id", "technique", F.lit("repeated").alias("problem"))
    claims = observations.filter("found")
    bare = claims.filter(F.coalesce(F.trim("quote"), F.lit("")) == "").select("doc_id", "technique", F.lit("no_quote").alias("problem"))
    quoted = claims.filter(F.trim("quote") != "")
    seen = quoted.join(blocks.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t")), (F.col("doc_id") == F.col("_d")) & F.expr("contains(_t, quote)"), "left_anti")
    return unknown.unionByName(missing).unionByName(repeated).unionByName(bare).unionByName(seen.select("doc_id", "technique", F.lit("quote_not_found").alias("problem")))
