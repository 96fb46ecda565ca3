"""The corpus pipeline: five stages, each a training-data operator applied to what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A driver may write each result as Parquet and read it again as the next stage's docs; ``run``
does the same in the shared folder.

Decisions are taken and applied by row: a stage numbers rows by hashes of all their columns, so a number is
the same whenever it is computed anew, and fully equal rows, which share one, are told apart by count alone.

Nulls and repeats: rows without a letter (null and empty texts too) are rejected by the first stage. Of rows with
equal texts one stays, that of the smallest doc_id (a null counts as the largest), also where ids are null or
repeated. An empty table stays empty. Extra columns of docs are carried along, whatever their names; names that
start with ``_stage_`` are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from prosemill.llm import exact_dedup, language_id, mixing, near_dedup, piece_codec
from prosemill.llm.common import NULL_ID, Scratch, table

#: SQL can't express the classifier, the balanced sample or the codec; tests/llm holds the stages against brute force.
ORACLE_SQL = None
#: Languages that the corpus keeps; None keeps every learned one.
LANGUAGES: tuple[str, ...] | None = None
#: Jaccard similarity in % from which documents are near copies.
NEAR = 80


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with ``_stage_row``, a number made of all their columns."""
    cells = [F.coalesce(F.xxhash64(F.lit(k), c), F.lit(0)) if not isinstance(f.dataType, MapType) else F.xxhash64(F.lit(k), F.to_json(c)) for k, (c, f) in enumerate(zip((docs[f"`{x}`"] for x in docs.columns), docs.schema, strict=True))]
    return docs.withColumn("_stage_row", F.xxhash64(*cells))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of numbered docs whose number is among the kept ones; of fully equal rows one."""
    among = docs.join(kept.select("_stage_row"), "_stage_row", "left_semi")
    first = F.row_number().over(Window.partitionBy("_stage_row").orderBy("_stage_row"))
    return among.withColumn("_stage_copy", first).filter("_stage_copy = 1").drop("_stage_row", "_stage_copy")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents in no learned (or wanted) language go; lang becomes the prediction."""
    model = language_id.learn(docs)
    found = language_id.detect_languages(docs, model, prefix="_stage_")
    known = F.col("_stage_lang_pred") != "und"
    if LANGUAGES is not None:
        known &= F.col("_stage_lang_pred").isin(*LANGUAGES)
    return found.filter(known).withColumn("lang", F.col("_stage_lang_pred")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the row with the smallest doc_id stays."""
    rows = _numbered(docs)
    return _only(rows, exact_dedup.exact_dedup(rows, row_col="_stage_row").filter("kept")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of near copies the row with the smallest doc_id stays; near are 80 % and more, the contract's 85 % is op5's."""
    rows = _numbered(docs)
    groups = near_dedup.near_dedup(rows, id_col="_stage_row", percent=NEAR).select(F.col("doc_id").alias("_stage_row"), F.col("component_id").alias("_stage_group"))
    named = groups.join(rows.select("_stage_row", F.coalesce("doc_id", F.lit(NULL_ID)).alias("_stage_id")), "_stage_row")
    least = named.groupBy("_stage_group").agg(F.min(F.struct("_stage_id", "_stage_row")).alias("_stage_least"))
    return _only(rows, least.select("_stage_least._stage_row")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each document as often as the mix takes it, not at all or up to three times."""
    rows = _numbered(docs)
    # Fully equal rows share out what the mix takes of them all.
    drawn = mixing.mix_sources(rows, id_col="_stage_row").groupBy(F.col("doc_id").alias("_stage_row")).agg(F.sum("copies").alias("_stage_sum"), F.count("*").alias("_stage_rows")).filter("_stage_sum > 0")
    place = F.row_number().over(Window.partitionBy("_stage_row").orderBy("_stage_row"))
    taken = rows.withColumn("_stage_place", place).join(drawn, "_stage_row")
    copies = F.floor(F.col("_stage_sum") / F.col("_stage_rows")) + (F.col("_stage_place") <= F.col("_stage_sum") % F.col("_stage_rows")).cast("int")
    return taken.withColumn("_stage_copies", copies.cast("int")).filter("_stage_copies > 0").withColumn("_stage_copy", F.explode(F.sequence(F.lit(1), F.col("_stage_copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: doc_id, lang, source, the piece ids of each text and how many there are."""
    codec = piece_codec.PieceCodec(piece_codec.MODEL, piece_codec.DROPOUT, seed=1, lanes=piece_codec.LANES)
    # The copies that the mix took of a document are numbered, so that each has a segmentation of its own.
    same = Window.partitionBy(F.xxhash64(F.coalesce("doc_id", F.lit(NULL_ID)), "text")).orderBy("doc_id")
    numbered = docs.select("doc_id", "lang", "source", "text", F.row_number().over(same).alias("_stage_copy"))
    coded = piece_codec.encode(numbered, codec, copy_col="_stage_copy")
    return coded.select("doc_id", "lang", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mixing", mix),
    ("piece_codec", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
