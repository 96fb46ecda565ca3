"""Exact dedup with Patricia-trie owners.

Texts are normalised (each run of blanks becomes one space), then partitioned by
byte length and content hash. Every partition inserts the full byte strings into a
compressed radix trie whose terminal nodes hold the smallest doc_id and the number
of rows. The same trie pre-aggregates on the map side, so a group of copies that
holds a third of all rows reaches a reducer as one row per map task and flush.

Memory: a trie counts its edges' bytes and ``NODE_BYTES`` for each node, so that very many
short texts weigh what they take. Beyond ``most_bytes`` it spills subtrees to the output and
frees them. On the map side those are the heaviest ones, until half is free. On the reduce side rows
arrive sorted by (length, hash): all subtrees are complete once another prefix appears, and go
together. Spark's external sort does the spilling of what is still to come.

Cases: a null text counts as empty; empty texts are equal to each other. A null
doc_id sorts after all others and never owns a group that has an id; a group of
null ids only has a null keep_id, and all its rows are kept. Repeated rows with one
doc_id are equal documents: each is returned, kept if the id is the smallest. An
empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import BLANKS, NULL_ID, emit, table

#: What a node takes besides its edge: a list, a dict of children, a terminal and their Python objects.
NODE_BYTES = 600
OWNERS = pa.schema([("n_len", pa.int32()), ("bucket", pa.int64()), ("sha", pa.binary()), ("body", pa.binary()), ("owner", pa.int64()), ("owner_row", pa.int64()), ("n", pa.int64())])


class RadixTrie:
    """Compressed trie over byte strings; a terminal holds [smallest owner, rows, payload].

    A node is [edge bytes, children by first byte, terminal or None]; ``weight`` is what the subtree of each first byte takes.
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.weight: dict[int, int] = {}
        self.held = 0

    def _add(self, first: int, size: int) -> None:
        self.weight[first] = self.weight.get(first, 0) + size
        self.held += size

    def insert(self, key: bytes, owner: object, n: int, payload: object = None) -> None:
        node, at, size = self.root, 0, len(key)
        while at < size:
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = node = [key[at:], {}, None]
                self._add(key[0], size - at + NODE_BYTES)
                at = size
                break
            edge = child[0]
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            low, high = 1, min(len(edge), size - at)  # first differing byte, by bisection over slices
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if key.startswith(edge[:middle], at) else (low, middle - 1)
            branch = [edge[:low], {edge[low]: child}, None]
            child[0] = edge[low:]
            node[1][key[at]] = node = branch
            self._add(key[0], NODE_BYTES)
            at += low
        if node[2] is None:
            node[2] = [owner, n, payload]
        else:
            node[2][0] = min(node[2][0], owner)
            node[2][1] += n

    def spill(self, most: int = 0) -> Iterator[tuple[bytes, list]]:
        """(key, terminal) of all strings in the heaviest subtrees, until the rest takes ``most`` at most; 0: of all strings."""
        if not most and self.root[2] is not None:
            yield b"", self.root[2]
            self.root[2] = None
        for first in sorted(self.weight, key=lambda k: (-self.weight[k], k)):
            if self.held <= most and most:
                break
            stack = [(b"", self.root[1].pop(first))]
            while stack:
                prefix, node = stack.pop()
                key = prefix + node[0]
                if node[2] is not None:
                    yield key, node[2]
                stack.extend((key, child) for child in node[1].values())
                node[1] = {}
            self.held -= self.weight.pop(first)


def _owners(most_bytes: int, ordered: bool):
    """Rows with one owner for each distinct byte string. ordered: rows come sorted by (n_len, bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, seen = RadixTrie(), None

        def flush(most: int) -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            for body, (owner, n, (size, bucket, sha)) in trie.spill(most):
                rows.append((size, bucket, sha, body, *owner, n))
                held += len(body)
                if held > 4 << 20 or len(rows) >= 5000:
                    yield emit(rows, OWNERS)
                    rows, held = [], 0
            if rows:
                yield emit(rows, OWNERS)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in OWNERS.names]
            for k in range(batch.num_rows):
                size, bucket, sha, body, owner, owner_row, n = (c[k].as_py() for c in columns)
                # within one (length, hash) prefix the subtree is still open: spill only between prefixes
                if trie.held > most_bytes and not (ordered and (size, bucket) == seen):
                    yield from flush(0 if ordered else most_bytes // 2)
                seen = (size, bucket)
                trie.insert(body, (owner, owner_row), n, (size, bucket, sha))
        yield from flush(0)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row; see the module for null and empty cases.

    row_col: a column of 64-bit numbers that tells rows of one id apart. It is returned too, and of the rows of the smallest id the
    one with the smallest number alone is kept.
    """
    body = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANKS, " ").cast("binary")
    own = F.lit(0).cast("bigint") if row_col is None else F.col(row_col).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), own.alias("row"), body.alias("body"))
    keyed = rows.select("doc_id", "row", F.octet_length("body").cast("int").alias("n_len"), F.xxhash64("body").alias("bucket"), F.unhex(F.sha2("body", 256)).alias("sha"), "body")
    schema = "n_len int, bucket bigint, sha binary, body binary, owner bigint, owner_row bigint, n bigint"
    local = keyed.select("n_len", "bucket", "sha", "body", F.coalesce("doc_id", F.lit(NULL_ID)).alias("owner"), F.col("row").alias("owner_row"), F.lit(1).cast("bigint").alias("n")).mapInArrow(_owners(most_bytes, False), schema)
    spread = local.repartition("n_len", "bucket").sortWithinPartitions("n_len", "bucket")
    owners = spread.mapInArrow(_owners(most_bytes, True), schema).select("n_len", "bucket", "sha", "owner", "owner_row", "n")
    # Light rows only; a hot group is split by the adaptive skew join.
    light = keyed.select("doc_id", "row", "n_len", "bucket", "sha")
    found = light.join(owners, ["n_len", "bucket", "sha"], "left")
    keep = F.when(F.col("owner") < NULL_ID, F.col("owner"))
    kept = F.coalesce(F.col("doc_id") == F.col("owner"), F.col("owner") == NULL_ID) & (F.col("row") == F.col("owner_row"))
    return found.select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *([] if row_col is None else [F.col("row").alias(row_col)]))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
