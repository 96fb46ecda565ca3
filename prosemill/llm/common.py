"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Put in place of a null doc_id wherever documents are ordered: such rows come last.
NULL_ID = (1 << 63) - 1
#: ASCII white space as the contracts spell it.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANKS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder serves a local master only; a cluster has to name one.
    """
    conf = spark.sparkContext.getConf()
    if base := conf.get("spark.checkpoint.dir") or spark.conf.get("prosemill.own.checkpoint.dir", None):
        return base
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="prosemill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("prosemill.own.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what led to them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/prosemill-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again; the result has no lineage before the files."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete what ``keep`` wrote for ``df``, once nothing reads it any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)  # type: ignore[attr-defined]
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the measure for numbers of buckets."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of row tuples."""
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def crc_mod(column: str, by: int):
    """crc32 of the id written as text, modulo ``by``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by))


def count_words(column):
    """Number of runs of non-blanks as a native expression; null counts as empty."""
    text = F.coalesce(column, F.lit(""))
    for blank in "\t\n\v\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    # Only texts with blanks in a row need the expression.
    text = F.btrim(F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " +", " ")).otherwise(text))
    return F.when(F.octet_length(text) == 0, F.lit(0)).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def tree_sum(parts: DataFrame, groups: int = 16) -> np.ndarray | None:
    """Sum of the vectors of doubles in the binary column v; None without a row.

    Tasks have summed their own rows; ``groups`` partial sums alone reach the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("v").to_pylist():
                x = np.frombuffer(blob)
                total = x if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], names=["v"])

    rows = sorted(bytes(r.v) for r in parts.repartition(groups).mapInArrow(add, "v binary").collect())
    return sum((np.frombuffer(x) for x in rows[1:]), start=np.frombuffer(rows[0])) if rows else None


def vector_row(v: np.ndarray) -> pa.RecordBatch:
    """One row for ``tree_sum``."""
    return pa.RecordBatch.from_arrays([pa.array([v.astype(np.float64).tobytes()], pa.binary())], names=["v"])
