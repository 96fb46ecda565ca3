"""Reading tables so that all cores have work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _bytes(text: str) -> int:
    """A size as settings write it: 4m, 128MB, 134217728b."""
    number, unit = text.strip().lower().rstrip("b"), 1
    if number[-1:] in "kmgt":
        number, unit = number[:-1], 1 << (10 * ("kmgt".index(number[-1]) + 1))
    return int(number) * unit


def unfolded(keys: DataFrame, key: str, slices: int = 2, most: int = 4 << 20) -> DataFrame:
    """Keys of a scan, hashed over all cores and into parts of ``most`` bytes of scan at most, for keys that unfold into many rows each.

    The keys are little to send, what they unfold to is much; a later aggregation or window by key needs no shuffle.
    """
    size = int(str(keys._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return keys.repartition(max(slices * keys.sparkSession.sparkContext.defaultParallelism, size // most), key)


def spread(rows: DataFrame, key: str, slices: int = 2) -> DataFrame:
    """Rows of a scan, hashed by key over all cores where the table is too small to be cut into as many splits.

    A file's row group is one task at least, so a small table is often read by one or two. The shuffle costs little there, and
    a later aggregation by key needs none. From ``cores * maxPartitionBytes`` on, a scan has its splits and stays as it is.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")):
        return rows
    return rows.repartition(slices * cores, key)
