"""What happens to findings: suppression, ordering, scope, reports.

Findings have at least doc_id, rule_id, severity, lane and pos (their place in the document: a
character offset or a line); more columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.text import any_of

SEVERITIES = ("info", "warning", "error")
SIGNALS = ("weak", "moderate", "strong")


def severity_rank(severity: Column) -> Column:
    """1 info, 2 warning, 3 error; 0 for anything else."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def signal_rank(signal: Column) -> Column:
    """1 weak, 2 moderate, 3 strong; 0 where a rule has none."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SIGNALS)), signal), F.lit(0)).cast("int")


KINDS = "enable disable disable-file disable-line disable-next-line"
_BODY = re.compile(rf"\A\s*(?:lint|prosemill)-({any_of(KINDS)})(?P<rest>\s.*)?\Z", re.S)


def parse_directive(comment: str) -> tuple[str, list[str], str | None] | None:
    """(kind, rules, reason) of a comment's inside, or None; no rules means all of them."""
    m = _BODY.match(comment)
    if not m:
        return None
    rules, _, reason = (m["rest"] or "").strip().partition("--")
    return m.group(1), [r for r in re.split(r"[,\s]+", rules) if r], reason.strip() or None


class _Rules:
    """A set of rules that may be everything but some."""

    def __init__(self, names: set[str], but: bool):
        self.names, self.but = names, but

    def minus(self, o: _Rules) -> _Rules:
        if not o.but:
            return _Rules(self.names | o.names, True) if self.but else _Rules(self.names - o.names, False)
        return _Rules(o.names - self.names, False) if self.but else _Rules(self.names & o.names, False)

    def empty(self) -> bool:
        return not self.but and not self.names


def fold_directives(directives: list[tuple]) -> list[tuple]:
    """Regions (low, high, rules, all but, reason) of one document's directives (pos, end, line, kind, rules, reason) in order.

    A line region is (line, line) with kind 'line'; others hold positions, high None meaning the end.
    """
    out, open_ = [], []
    for pos, end, line, kind, rules, reason in sorted(directives, key=lambda d: d[0]):
        own = _Rules(set(rules), False) if rules else _Rules(set(), True)
        if kind == "disable-file":
            out.append(("file", None, None, own, reason))
        elif kind in ("disable-line", "disable-next-line"):
            at = line + (kind == "disable-next-line")
            out.append(("line", at, at, own, reason))
        elif kind == "disable":
            open_.append((own, end, reason))
        else:
            still = []
            for held, start, why in open_:
                rest = held.minus(own)
                if held.minus(rest).empty():
                    still.append((held, start, why))
                    continue
                out.append(("range", start, pos, held, why))
                if not rest.empty():
                    still.append((rest, end, why))
            open_ = still
    out.extend(("range", start, None, held, why) for held, start, why in open_)
    return [(kind, low, high, sorted(r.names), r.but, why) for kind, low, high, r, why in out]


REGIONS = "doc_id bigint, ix int, kind string, low int, high int, rules array<string>, all_but boolean, reason string"


def regions(directives: DataFrame) -> DataFrame:
    """Suppressed regions from directives (doc_id, pos, end, line, kind, rules, reason), folded per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ix", pa.int32()), ("kind", pa.string()), ("low", pa.int32()), ("high", pa.int32()), ("rules", pa.list_(pa.string())), ("all_but", pa.bool_()), ("reason", pa.string())])

    def run(t: pa.Table) -> pa.Table:
        rows = fold_directives([tuple(r[c] for c in ("pos", "end", "line", "kind", "rules", "reason")) for r in t.to_pylist()])
        doc_id = t.column("doc_id")[0].as_py()
        full = [(doc_id, k, *r) for k, r in enumerate(rows)]
        columns = list(zip(*full, strict=True)) if full else [[] for _ in schema]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return directives.groupBy("doc_id").applyInArrow(run, REGIONS)


def suppress(findings: DataFrame, regions_: DataFrame) -> DataFrame:
    """Findings with suppressed and reason: each document's regions, as one row, join its findings; the first region that fits wins.

    A 'line' region tests the finding's column line, others its pos.
    """
    one = F.struct("ix", "kind", "low", "high", "rules", "all_but", "reason")
    r = regions_.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(one)).alias("_regions"))

    def fits(x: Column) -> Column:
        named = F.array_contains(x["rules"], F.col("rule_id"))
        line, pos = (x["kind"] == "line") & (F.col("line") == x["low"]), (x["kind"] == "range") & (F.col("pos") >= x["low"]) & (x["high"].isNull() | (F.col("pos") < x["high"]))
        return F.when(x["all_but"], ~named).otherwise(named) & ((x["kind"] == "file") | line | pos)

    first = F.get(F.filter("_regions", fits), F.lit(0))
    hits = findings.join(r, F.col("doc_id") == F.col("_doc"), "left").withColumn("_first", first)
    return hits.select(*findings.columns, F.col("_first.ix").isNotNull().alias("suppressed"), F.col("_first.reason").alias("reason"))


def in_changed_lines(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings on changed lines (doc_id, line): a semi join."""
    return findings.join(lines.select("doc_id", "line"), ["doc_id", "line"], "left_semi")


def fail_on(findings: DataFrame, level: str = "error") -> DataFrame:
    """doc_id and worst severity of documents with a finding of ``level`` or above."""
    rows = findings.groupBy("doc_id").agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    return rows.filter(F.col("worst") >= SEVERITIES.index(level) + 1)


def summary(findings: DataFrame) -> DataFrame:
    """Counts of findings and documents by lane and severity with subtotals (null: all)."""
    per = findings.groupBy("doc_id", "lane", "severity").agg(F.count("*").alias("n"))
    return per.rollup("lane", "severity").agg(F.sum("n").alias("findings"), F.countDistinct("doc_id").alias("documents"))


def brief(findings: DataFrame, top: int = 5) -> DataFrame:
    """The first ``top`` findings of each rule and document, with how many there are and how many aren't shown."""
    w = Window.partitionBy("doc_id", "rule_id")
    rows = findings.withColumn("total", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("pos")))
    return rows.filter(F.col("rank") <= top).select("doc_id", "rule_id", "rank", "pos", "total", F.greatest(F.col("total") - top, F.lit(0)).alias("omitted"))


def annotations(findings: DataFrame) -> DataFrame:
    """One workflow-command line for each finding; needs name, line and message."""
    def escaped(c: str, more: tuple = ()) -> Column:
        out = F.col(c)
        for sign, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *more):
            out = F.replace(out, F.lit(sign), F.lit(code))
        return out

    level = F.when(F.col("severity") == "info", "notice").otherwise(F.col("severity"))
    head = F.concat(F.lit("::"), level, F.lit(" file="), escaped("name", ((":", "%3A"), (",", "%2C"))), F.lit(",line="), F.col("line").cast("string"))
    return findings.select("doc_id", F.concat(head, F.lit(",title="), F.col("rule_id"), F.lit("::"), escaped("message")).alias("annotation"))


def report_json(findings: DataFrame) -> DataFrame:
    """One JSON object a document: its findings in order, and counts by severity."""
    one = F.struct("pos", "rule_id", "severity", "lane")
    listed = F.array_sort(F.collect_list(one))
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    rows = findings.groupBy("doc_id").agg(listed.alias("findings"), *counts)
    return rows.select("doc_id", F.to_json(F.struct(F.lit(1).alias("version"), F.struct(*SEVERITIES).alias("counts"), "findings")).alias("report"))


def indexed(findings: DataFrame) -> DataFrame:
    """Findings of ``lint`` with ix, their number in a document by position and rule, as ``compare_findings`` wants them."""
    return findings.withColumn("ix", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "rule_id", "fingerprint")).cast("long") - 1)


def text_report(findings: DataFrame) -> DataFrame:
    """One line of text for each finding that isn't suppressed, in the order of a report; needs name."""
    shown = findings.filter("NOT suppressed")
    line = F.format_string("%s:%d %s [%s] %s", F.col("name"), F.col("line"), F.col("severity"), F.col("rule_id"), F.col("message"))
    return shown.select("doc_id", "pos", "rule_id", line.alias("report"))


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in the order of a report."""
    return findings.orderBy("doc_id", "pos", "rule_id")


def batched(rows: list[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Record batches of row tuples."""
    for k in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + size], strict=True), schema, strict=True)], schema=schema)
