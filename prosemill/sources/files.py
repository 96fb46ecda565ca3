"""Files to documents: recursive reads, ignore patterns, UTF-8 errors as rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.sources.parser import FORMATS, format_of


def ignore_expression(pattern: str) -> str:
    """A regular expression over paths for one line of an ignore file."""
    anchored = pattern.startswith("/") or "/" in pattern.rstrip("/")
    body = re.escape(pattern.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"{'^' if anchored else '(?:^|/)'}{body}{'/' if pattern.endswith('/') else '(?:/|$)'}"


def ignored(path, patterns: list[str]):
    """Whether a relative path is ignored; later patterns win, ! includes again."""
    out = F.lit(False)
    for p in (x.strip() for x in patterns):
        if p and not p.startswith("#"):
            again = p.startswith("!")
            out = F.when(path.rlike(ignore_expression(p.lstrip("!"))), F.lit(not again)).otherwise(out)
    return out


def read_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md", "markdown", "txt"), ignore: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) under a folder: name, format, source; files that aren't UTF-8 are error rows.

    Hidden files and folders are left out. doc_id is a hash of the name, stable between runs.
    """
    if unknown := set(extensions) - set(FORMATS):
        raise ValueError(f"no such formats: {sorted(unknown)}")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    base = re.escape(root.rstrip("/"))
    name = F.regexp_replace("path", f"^(?:file:/*)?/?{base.lstrip('/')}/", "")
    rows = raw.select(name.alias("name"), "content").filter(~F.col("name").rlike(r"(?:^|/)\.") & ~ignored(F.col("name"), list(ignore)))
    good = F.expr("is_valid_utf8(content)")
    docs = rows.filter(good).select(F.xxhash64("name").alias("doc_id"), "name", format_of(F.col("name")).alias("format"), F.decode("content", "UTF-8").alias("source"))
    return docs, rows.filter(~good).select("name", F.lit("not UTF-8").alias("message"))


def parse_diff(diff: str) -> list[tuple[str, int, int]]:
    """(file, first line, last line) of the lines that a unified diff adds or changes."""
    out, name = [], None
    for line in diff.split("\n"):
        if line.startswith("+++ "):
            name = re.sub(r"^[abciw]/", "", line[4:].split("\t")[0])
            name = None if name == "/dev/null" else name
        elif name and (m := re.match(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@", line)):
            first, n = int(m.group(1)), int(m.group(2) or 1)
            if n:
                out.append((name, first, first + n - 1))
    return out


def changed_lines(spark: SparkSession, diff: str) -> DataFrame:
    """name and line of the changed lines of a diff."""
    ranges = spark.createDataFrame(parse_diff(diff), "name string, first int, last int")
    return ranges.select("name", F.explode(F.sequence("first", "last")).alias("line"))
