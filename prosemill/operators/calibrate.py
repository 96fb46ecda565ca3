"""Calibration: what rules find in two labelled groups of documents.

Groups: 'human' (a) and 'generated' (b). Every aggregate is keyed by rule, item or threshold, whose
number doesn't grow with the corpus, so each family costs one small shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.text import wilson_upper
from prosemill.operators.findings import severity_rank

EPSILON = 1e-9


def split_point(key: str, seed: int = 0xCBF29CE484222325) -> float:
    """A number in [0, 1) from a key: FNV-1a and a finaliser, so that a split is stable everywhere."""
    h = seed
    for b in key.encode():
        h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = ((h ^ (h >> shift)) * factor) & (2**64 - 1)
    return ((h ^ (h >> 33)) >> 11) / (1 << 53)


def holdout(key: Column, share: float = 0.3) -> Column:
    """Whether a key belongs to the held-out part: a native split by the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32) < share


def required_docs(target: float, z: float = 1.6449) -> int:
    """Fewest documents without a hit whose upper bound is at most the target."""
    n = z * z * (1 - target) / target
    return int(n) + (n > int(n))


def signal_of(human: Column, n_human: Column, generated: Column, n_generated: Column) -> Column:
    """strong, moderate or weak by the rates of both groups; null with fewer than five documents hit."""
    h, a = human / n_human, generated / n_generated
    strong = (generated >= 5) & (a + EPSILON >= 3 * h) & (h <= 0.05 + EPSILON)
    weak = (human >= 5) & (a <= 1.5 * h + EPSILON)
    return F.when(human + generated < 5, F.lit(None)).when(strong, "strong").when(weak, "weak").otherwise("moderate")


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy().agg(*(x for g in ("human", "generated") for x in (F.count_if(F.col("grp") == g).alias(f"n_{g}"), F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("chars"))), F.lit(0)).alias(f"chars_{g}"))))


def rates(findings: DataFrame, docs: DataFrame, by: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """Rates of rules (or rules and items) from findings (doc_id, rule_id, severity, n) and docs (doc_id, grp, chars).

    Columns: documents hit and findings in each group, findings by 1000 characters, the upper bound of the
    false-positive rate, and the measured signal. Documents without findings stay in the denominators.
    """
    per = findings.groupBy("doc_id", *by).agg(F.sum("n").alias("n"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    hit = per.join(docs.select("doc_id", "grp"), "doc_id")
    g = {x: F.col("grp") == x for x in ("human", "generated")}
    agg = hit.groupBy(*by).agg(*(e for x, c in g.items() for e in (F.count_if(c).alias(f"docs_{x}"), F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"findings_{x}"), F.count_if(c & (F.col("worst") >= 2)).alias(f"warned_{x}"))))
    rows = agg.crossJoin(F.broadcast(_sizes(docs)))  # one row of totals
    return rows.select(
        *by, "docs_human", "docs_generated", "warned_human", "warned_generated", "findings_human", "findings_generated", "n_human", "n_generated",
        (F.col("findings_human") * 1000.0 / F.greatest("chars_human", F.lit(1))).alias("per_1000_human"),
        (F.col("findings_generated") * 1000.0 / F.greatest("chars_generated", F.lit(1))).alias("per_1000_generated"),
        wilson_upper(F.col("docs_human"), F.col("n_human")).alias("fp_upper"),
        signal_of(F.col("docs_human"), F.col("n_human"), F.col("docs_generated"), F.col("n_generated")).alias("signal"),
    )


def reviews(rule_rates: DataFrame, fp_target: float = 0.05) -> DataFrame:
    """Rules to look at: too many false positives, no separation of the groups, or a burden of weak findings."""
    h, a = F.col("docs_human") / F.col("n_human"), F.col("docs_generated") / F.col("n_generated")
    why = F.when((F.col("warned_human") / F.col("n_human") > fp_target), "false_positives").when((F.col("docs_human") + F.col("docs_generated") >= 5) & (a <= 1.5 * h + EPSILON), "no_separation").when(h > 0.5, "info_burden")
    return rule_rates.withColumn("review", why).filter("review IS NOT NULL").select("rule_id", "review", "docs_human", "docs_generated")


def disagreements(rule_rates: DataFrame, declared: DataFrame) -> DataFrame:
    """Rules whose measured signal isn't the declared one (rule_id, declared)."""
    return rule_rates.join(declared, "rule_id").filter("signal IS NOT NULL AND signal <> declared").select("rule_id", "declared", F.col("signal").alias("measured"))


def top_items(items: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent notations of each rule from (rule_id, item, n)."""
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("n"), "item"))
    return items.withColumn("rank", rank).filter(F.col("rank") <= top).select("rule_id", "rank", "item", "n")


def sweep(measures: DataFrame, fires_below: bool = True, fp_target: float = 0.05, digits: int = 2) -> DataFrame:
    """What each threshold of a measure would flag, from (doc_id, grp, value).

    Candidates are the values that occur, rounded to ``digits`` decimals as thresholds are written, so their
    number doesn't grow with the corpus; counts come from running sums over them, not from pairs of documents
    and thresholds. usable: the human rate is within the target; rank: detection, then false positives, then value.
    """
    sign = 1 if fires_below else -1
    by = measures.groupBy(F.round(F.col("value"), digits).alias("threshold")).agg(F.count_if(F.col("grp") == "human").alias("h"), F.count_if(F.col("grp") == "generated").alias("a"))
    upto = Window.orderBy(F.col("threshold") * sign).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = by.select("threshold", F.coalesce(F.sum("h").over(upto), F.lit(0)).alias("human"), F.coalesce(F.sum("a").over(upto), F.lit(0)).alias("generated"), F.sum("h").over(whole).alias("n_human"), F.sum("a").over(whole).alias("n_generated"))
    usable = F.col("human") <= fp_target * F.col("n_human") + EPSILON
    order = Window.orderBy(usable.desc(), F.desc("generated"), "human", "threshold")
    return rows.withColumn("usable", usable).withColumn("rank", F.row_number().over(order))
