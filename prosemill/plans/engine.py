"""The engine: options, rule selection, and one plan from documents to findings.

    engine = Engine(Options(genre="tech", disable=("P05",)))
    findings = engine.lint(docs)          # doc_id, name, source, format
    engine.report(findings).write.json(...)

Rules that aren't selected leave no trace in the plan. Documents are parsed once: the block table is
written to the folder ``store`` where one is given (a shared one, on a cluster), else it is persisted in
memory and on disk, from where a lost partition is parsed again.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.operators import findings as G
from prosemill.operators import lists as L
from prosemill.operators import rhythm as R
from prosemill.operators import structure as S
from prosemill.operators.custom import CustomRule, apply_custom, validated
from prosemill.operators.messages import MESSAGES
from prosemill.operators.phrase_data import RULES
from prosemill.operators.phrases import SENTENCE_RULES, find_phrases
from prosemill.sources.parser import directives, parse, sentence_table

GENRES = {"general": "general", "tech": "tech", "technical": "tech", "business": "business", "biz": "business", "essay": "essay"}
#: Rules that a genre leaves out.
NOT_IN = {
    "business": {"S01", "S02", "S03", "S04", "S07", "S09", "S10", "R17", "R18", "R19", "R22"}, "tech": {"R18", "R22"}, "general": {"R22"}, "essay": {"R17", "R19"},
}
#: Options of rules by genre where they differ from the functions' own.
BY_GENRE = {"essay": {"R03": {"max_chars": 110}, "R06": {"min_chars": 1500}, "R08": {"min_count": 5}}, "tech": {"R06": {"min_chars": 3000}, "R08": {"min_count": 7}}, "business": {"R06": {"min_chars": 3000}, "R08": {"min_count": 7}}}


@dataclass(frozen=True)
class Options:
    """What to run. only beats disable, disable beats enable; layers merge with ``over``."""

    genre: str = "general"
    only: tuple[str, ...] = ()
    enable: tuple[str, ...] = ()
    disable: tuple[str, ...] = ()
    readability: bool = True
    severity: dict[str, str] = field(default_factory=dict)
    rules: dict[str, dict] = field(default_factory=dict)
    custom: tuple[CustomRule, ...] = ()

    def over(self, **layer) -> Options:
        """A layer on top: scalars replace, mappings and custom rules (by id) merge."""
        for key in ("severity", "rules"):
            if key in layer:
                layer[key] = {**getattr(self, key), **layer[key]}
        if "custom" in layer:
            ids = {c.id for c in layer["custom"]}
            layer["custom"] = (*(c for c in self.custom if c.id not in ids), *layer["custom"])
        return replace(self, **layer)


def resolve(name: str) -> str:
    """A rule's id from its id or name in any case."""
    by = {k.lower(): k for k in RULES} | {v[0].lower(): k for k, v in RULES.items()}
    if name.lower() not in by:
        raise ValueError(f"no rule {name}")
    return by[name.lower()]


class Engine:
    """Checks options once; every method returns a DataFrame."""

    def __init__(self, options: Options | None = None):
        self.options = o = options or Options()
        self.held: list[DataFrame] = []
        if o.genre not in GENRES:
            raise ValueError(f"no genre {o.genre}")
        self.genre = GENRES[o.genre]
        for key, level in o.severity.items():
            resolve(key)
            if level not in G.SEVERITIES:
                raise ValueError(f"no severity {level}")
        self.custom = validated(list(o.custom), set(RULES))
        self.settings = {**BY_GENRE.get(self.genre, {})}
        for key, values in o.rules.items():
            self.settings[resolve(key)] = {**self.settings.get(resolve(key), {}), **values}

    def active(self) -> list[str]:
        """Ids of the rules that run."""
        o = self.options
        if o.only:
            return sorted({resolve(r) for r in o.only})
        chosen = {r for r, meta in RULES.items() if r not in NOT_IN[self.genre] and (o.readability or meta[1] != "readability")}
        return sorted((chosen | {resolve(r) for r in o.enable}) - {resolve(r) for r in o.disable})

    def _rows(self, rule: str, df: DataFrame, severity=None) -> DataFrame:
        """A rule's result in the form of findings; its own columns become metrics."""
        name, lane, signal, level = RULES[rule]
        place = {"first_ord": "ord", "first_block": "block_ix"}
        for a, b in place.items():
            if a in df.columns:
                df = df.withColumnRenamed(a, b)
        null = F.lit(None).cast("int")
        used = {"doc_id", "block_ix", "ord", "severity", "text", "matched"}
        metrics = [x for c in df.columns if c not in used for x in (F.lit(c), F.col(c).cast("string"))]
        return df.select(
            F.col("doc_id").cast("bigint"), F.lit(rule).alias("rule_id"), F.lit(name).alias("rule_name"), F.lit(lane).alias("lane"), F.lit(signal).cast("string").alias("signal"),
            (F.col("severity") if "severity" in df.columns else F.lit(level)).alias("severity"),
            (F.col("block_ix").cast("int") if "block_ix" in df.columns else null).alias("block_ix"), (F.col("ord").cast("int") if "ord" in df.columns else null).alias("ord"),
            (F.col("matched") if "matched" in df.columns else F.col("text") if "text" in df.columns else F.lit(None).cast("string")).alias("matched"),
            (F.create_map(*metrics) if metrics else F.create_map().cast("map<string,string>")).alias("metrics"),
        )

    def findings(self, blocks: DataFrame) -> DataFrame:
        """Findings of the active rules in parsed blocks, before suppression."""
        active, opt = self.active(), self.settings
        s = sentence_table(blocks)
        scoped = s.filter("kind IN ('paragraph', 'comment', 'doc', 'string') AND NOT in_quote")
        prose = s.filter("kind = 'paragraph' AND NOT in_quote AND NOT in_footnote AND NOT label_value").filter(F.col("text").rlike(f"[{S.T.JAPANESE}]"))
        paragraphs = blocks.filter("kind = 'paragraph' AND NOT in_quote")
        parts: list[DataFrame] = []
        phrases = tuple(r for r in active if r in SENTENCE_RULES)
        if phrases:
            found = find_phrases(scoped, phrases)
            meta = F.create_map(*(F.lit(x) for r in phrases for x in (r, RULES[r][0])))
            lane = F.create_map(*(F.lit(x) for r in phrases for x in (r, RULES[r][1])))
            parts.append(found.select("doc_id", "rule_id", meta[F.col("rule_id")].alias("rule_name"), lane[F.col("rule_id")].alias("lane"), "signal", "severity", "block_ix", "ord", "matched", F.create_map(F.lit("item"), F.col("item")).alias("metrics")))
        plans = {
            "R01": (R.low_burstiness, prose), "R02": (R.repetitive_endings, prose), "R03": (R.long_sentences, scoped), "R04": (L.buried_lists, scoped), "R05": (R.antithesis, scoped), "R06": (R.no_nominal_ending, prose),
            "R07": (R.uniform_paragraphs, prose), "R08": (R.repeated_leads, prose), "R09": (R.lead_conjunctions, prose), "R10": (R.cleft_because, prose), "R11": (R.self_answer, prose), "R13": (R.comma_profile, prose),
            "R15": (R.future_closer, prose), "R16": (L.evaluative_triads, prose), "R17": (L.guide_density, prose), "R18": (L.nominal_lists, prose), "R19": (R.action_closer, prose), "R20": (R.mixed_style, prose), "R22": (L.phrase_clusters, prose),
            "S01": (S.bold_density, blocks), "S02": (S.bullet_ratio, blocks), "S03": (S.boilerplate_headings, blocks), "S04": (S.numbered_phases, blocks), "S05": (S.emoji_density, blocks), "S06": (S.bold_label_lists, blocks), "S07": (S.heading_template, blocks),
            "S08": (S.heading_emphasis, blocks), "S09": (S.structure_density, blocks), "S10": (S.label_style, blocks), "S11": (S.enumeration_mismatch, blocks), "S12": (S.empty_sections, blocks), "P20": (S.colon_continuation, blocks),
        }
        for rule, (plan, source) in plans.items():
            if rule in active:
                parts.append(self._rows(rule, plan(source, **opt.get(rule, {}))))
        if "R12" in active:
            parts += [self._rows("R12", R.alternation(prose)), self._rows("R12", R.nominal_ratio(prose))]
        if "R14" in active:
            parts += [self._rows("R14", R.duplicate_sentences(prose, **opt.get("R14", {}))), self._rows("R14", R.duplicate_paragraphs(paragraphs, **opt.get("R14", {})))]
        if "R21" in active:
            single = paragraphs.filter(F.size("sentences") == 1).select("doc_id", "text").unionAll(blocks.filter("kind = 'heading'").select("doc_id", "text"))
            parts.append(self._rows("R21", L.short_slogans(single, **opt.get("R21", {}))))
        if "S13" in active:
            parts.append(self._rows("S13", blocks.filter("wrapped").select("doc_id").distinct()))
        if self.custom:
            name = F.create_map(*(F.lit(x) for c in self.custom for x in (c.id, c.name)))
            parts.append(apply_custom(scoped, self.custom).select("doc_id", "rule_id", name[F.col("rule_id")].alias("rule_name"), "lane", F.lit(None).cast("string").alias("signal"), "severity", F.col("block_ix").cast("int"), F.col("ord").cast("int"), "matched", F.create_map().cast("map<string,string>").alias("metrics")))
        if not parts:
            return self._rows("S13", blocks.filter("false").select("doc_id"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if self.options.severity:
            levels = {resolve(k): v for k, v in self.options.severity.items()}
            mapped = F.create_map(*(F.lit(x) for kv in levels.items() for x in kv))
            out = out.withColumn("severity", F.coalesce(mapped[F.col("rule_id")], F.col("severity")))
        return out

    def lint(self, docs: DataFrame, store: str | None = None) -> DataFrame:
        """Findings of documents (doc_id, source, format) with position, line, context, message, fingerprint and suppression.

        context is the sentence of a finding, null for one of a whole block or document. The fingerprint is made of the rule, the matched
        text and the first 32 signs of the context, without white space: it stays the same when lines are put in elsewhere.
        """
        blocks = parse(docs)
        if store:
            blocks.write.mode("overwrite").parquet(store)
            blocks = docs.sparkSession.read.schema(blocks.schema).parquet(store)
        else:
            blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
            self.held.append(blocks)
        s = blocks.select(F.col("doc_id").alias("_d"), F.col("block_ix").alias("_b"), F.col("start").alias("_start"), F.col("line").alias("_line"), F.col("text").alias("_t"), F.col("sentences").alias("_s"))
        found = self.findings(blocks).join(s, (F.col("doc_id") == F.col("_d")) & (F.coalesce("block_ix", F.lit(0)) == F.col("_b")), "left")
        one = F.get(F.col("_s"), F.col("ord"))
        bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), f"[{S.T.SPACES}]", "")
        context = F.substring(F.col("_t"), one["start"] + 1, one["end"] - one["start"])
        placed = found.withColumns({"pos": F.coalesce(one["source_start"], F.col("_start"), F.lit(0)), "line": F.coalesce(one["line"], F.col("_line"), F.lit(1)), "context": context})
        texts = {**MESSAGES, **{c.id: c.message for c in self.custom}}
        said = F.coalesce(F.create_map(*(F.lit(x) for kv in texts.items() for x in kv))[F.col("rule_id")], F.col("rule_name"))
        named = placed.withColumns(
            {
                "message": F.when(F.col("matched").isNull(), said).otherwise(F.concat(said, F.lit(": "), F.col("matched"))),
                "fingerprint": F.lower(F.lpad(F.hex(F.xxhash64("rule_id", bare(F.col("matched")), F.substring(bare(F.col("context")), 1, 32))), 16, "0")),
            }
        )
        return G.suppress(named.drop("_d", "_b", "_start", "_line", "_t", "_s"), G.regions(directives(docs)))

    def release(self) -> None:
        """Frees block tables that ``lint`` persisted, once their findings are written."""
        while self.held:
            self.held.pop().unpersist()

    def report(self, findings: DataFrame) -> DataFrame:
        """A JSON report per document of what isn't suppressed."""
        return G.report_json(findings.filter("NOT suppressed"))
