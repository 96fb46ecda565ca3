"""Rules of the user's own: literals or expressions with a message, validated, run natively."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PATTERN_CHARS = 1000


@dataclass(frozen=True)
class CustomRule:
    """A literal, or a regular expression if ``regex``; ids may not repeat and may not be a built-in's."""

    id: str
    name: str
    pattern: str
    message: str
    hint: str = ""
    severity: str = "warning"
    lane: str = "custom"
    regex: bool = False

    def expression(self) -> str:
        return self.pattern if self.regex else re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", self.pattern)


def validated(rules: list[CustomRule], taken: set[str]) -> list[CustomRule]:
    """The rules, or ValueError for the first thing wrong with them."""
    seen = {t.lower() for t in taken}
    for r in rules:
        if r.id.lower() in seen:
            raise ValueError(f"rule id {r.id} is taken")
        seen.add(r.id.lower())
        if not r.pattern or len(r.pattern) > MOST_PATTERN_CHARS:
            raise ValueError(f"{r.id}: a pattern has 1 to {MOST_PATTERN_CHARS} characters")
        if r.severity not in ("info", "warning", "error"):
            raise ValueError(f"{r.id}: no severity {r.severity}")
        if r.regex:
            compiled = re.compile(r.pattern)
            if compiled.match("") and compiled.match("").end() == 0 and compiled.fullmatch(""):
                raise ValueError(f"{r.id}: the pattern matches nothing at all")
    return rules


def apply_custom(s: DataFrame, rules: list[CustomRule]) -> DataFrame:
    """doc_id, block_ix, ord, rule_id, severity, lane, nth and matched: one row a match, in one pass over the sentences."""
    per = [F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.lane).alias("lane"), F.regexp_extract_all("text", F.lit(r.expression()), F.lit(0)).alias("hits")) for r in rules]
    rows = s.select("doc_id", "block_ix", "ord", F.explode(F.array(*per)).alias("r")).select("doc_id", "block_ix", "ord", "r.rule_id", "r.severity", "r.lane", F.posexplode("r.hits").alias("nth", "matched"))
    return rows
