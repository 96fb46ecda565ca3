"""The engine, reports, calibration, revisions and streams."""

import json

import pytest
from pyspark.sql import functions as F

from prosemill.operators import calibrate, findings, review, revision
from prosemill.operators.custom import CustomRule
from prosemill.plans.engine import Engine, Options
from prosemill.sources.parser import parse
from prosemill.streaming import lint as stream

DOCS = "doc_id bigint, name string, format string, source string"


def rules(df):
    return sorted((r.doc_id, r.rule_id) for r in df.collect())


def test_lint_places_and_suppresses(spark):
    source = "<!-- prosemill-disable-next-line P05 -- 既知 -->\n様々な物がある。\n\n多くの人が読む。\n"
    engine = Engine(Options(only=("P05", "EMPTY_SECTION")))
    docs = spark.createDataFrame([(1, "a.md", "markdown", source), (2, "b.md", "markdown", "# 空\n"), (3, "c", "plain", None)], DOCS)
    got = engine.lint(docs).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.rule_id, r.line, r.suppressed, r.reason) for r in got] == [(1, "P05", 2, True, "既知"), (1, "P05", 4, False, None), (2, "S12", 1, False, None)]
    report = json.loads(engine.report(engine.lint(docs)).filter("doc_id = 1").first().report)
    assert report["counts"]["info"] == 1


def test_findings_carry_message_line_and_fingerprint(spark):
    before = "棚の話。\n\n多くの人が読む。様々な物がある。\n"
    after = "# 題\n\n新しい行。\n\n多くの人が読む。<!-- prosemill-disable P05 -->様々な物がある。\n"
    engine = Engine(Options(only=("P05",)))
    frame = lambda source: spark.createDataFrame([(1, "a.md", "markdown", source)], DOCS)
    b, a = engine.lint(frame(before)), engine.lint(frame(after))
    assert [(r.line, r.message, r.context) for r in b.orderBy("pos").collect()] == [(3, "A modifier that adds nothing: 多くの", "多くの人が読む。"), (3, "A modifier that adds nothing: 様々な", "様々な物がある。")]
    assert [r.line for r in a.orderBy("pos").collect()] == [5, 5]
    got = {(r.status, r.before_ix, r.after_ix) for r in revision.compare_findings(findings.indexed(b), findings.indexed(a)).collect()}
    assert got == {("persisting", 0, 0), ("suppressed", 1, 1)}
    named = b.withColumn("name", F.lit("a.md"))
    assert findings.annotations(named).count() == 2 and findings.text_report(named).orderBy("pos").first().report == "a.md:3 info [P05] A modifier that adds nothing: 多くの"
    engine.release()
    assert not engine.held


def test_selection_and_options(spark):
    assert "S01" not in Engine(Options(genre="business")).active() and "R22" in Engine(Options(genre="essay")).active()
    assert Engine(Options(only=("p01",), disable=("P01",))).active() == ["P01"]
    assert "P04" not in Engine(Options(readability=False)).active() and "P05" not in Engine(Options(enable=("P05",), disable=("p05",))).active()
    for bad in (Options(genre="x"), Options(only=("P99",)), Options(severity={"P01": "fatal"}), Options(custom=(CustomRule("P01", "x", "y", "z"),)), Options(custom=(CustomRule("A", "x", "", "z"),))):
        with pytest.raises(ValueError):
            Engine(bad).active()
    layered = Options(severity={"P01": "info"}).over(severity={"P02": "error"}, custom=(CustomRule("A", "x", "棚", "z"),)).over(custom=(CustomRule("A", "x", "箱", "z"),))
    assert layered.severity == {"P01": "info", "P02": "error"} and [c.pattern for c in layered.custom] == ["箱"]


def test_custom_and_severity(spark):
    docs = spark.createDataFrame([(1, "a", "plain", "倉庫(仮)の棚。様々な箱。")], DOCS)
    options = Options(only=("P05",), severity={"P05": "error"}, custom=(CustomRule("X1", "TEMP", "(仮)", "m"), CustomRule("X2", "BOX", "[箱棚]", "m", regex=True, severity="info")))
    got = sorted((r.rule_id, r.severity, r.matched) for r in Engine(options).lint(docs).collect())
    assert got == [("P05", "error", "様々な"), ("X1", "warning", "(仮)"), ("X2", "info", "棚"), ("X2", "info", "箱")]


def test_empty_table(spark):
    assert Engine().lint(spark.createDataFrame([], DOCS)).count() == 0


def test_annotations_escape(spark):
    df = spark.createDataFrame([(1, "a,b:c.md", 3, "P01", "warning", "100%\nx")], "doc_id bigint, name string, line int, rule_id string, severity string, message string")
    assert findings.annotations(df).first().annotation == "::warning file=a%2Cb%3Ac.md,line=3,title=P01::100%25%0Ax"


def test_signals(spark):
    rows = [(1, 15, "strong"), (76, 70, "weak"), (14, 22, "moderate"), (0, 1, None), (43, 106, "moderate"), (6, 59, "strong"), (192, 170, "weak")]
    df = spark.createDataFrame(rows, "h int, a int, want string").select("want", calibrate.signal_of(F.col("h"), F.lit(440), F.col("a"), F.lit(390)).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_sweep_matches_brute_force(spark):
    rows = [(k, "human" if k % 3 else "generated", ((k * 37) % 100) / 100 - 0.5) for k in range(90)]
    got = calibrate.sweep(spark.createDataFrame(rows, "doc_id bigint, grp string, value double")).collect()
    for r in got:
        assert r.human == sum(g == "human" and round(v, 2) < r.threshold for _, g, v in rows)
        assert r.generated == sum(g == "generated" and round(v, 2) < r.threshold for _, g, v in rows)
    best = min(got, key=lambda r: r.rank)
    assert best.usable and best.generated == max(r.generated for r in got if r.usable)


def test_fact_keys(spark):
    text = "2024年3月5日に3万円、6割、1.10節、3月5日、https://a.b/c。「語」とカタカナ語とGPT-4。三段。"
    got = {(r.kind, r.key) for r in revision.facts(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()}
    assert {("number", "1.10節"), ("date", "2024-03-05"), ("date", "--03-05"), ("number", "30000円"), ("number", "60%"), ("url", "https://a.b/c"), ("quoted", "語"), ("katakana", "カタカナ"), ("latin", "gpt-4")} <= got


def test_fact_changes(spark):
    kind = "doc_id bigint, text string"
    before, after = spark.createDataFrame([(1, "3万円と5人とABC。")], kind), spark.createDataFrame([(1, "30000円と6人とABCとABC。")], kind)
    got = {(r.kind, r.key, r.status, r.suspicious) for r in revision.compare_facts(before, after).collect()}
    assert got == {("number", "5人", "removed", False), ("number", "6人", "added", True)}


def test_findings_pair_as_multisets(spark):
    kind = "doc_id bigint, ix bigint, rule_id string, fingerprint string, matched string"
    before = spark.createDataFrame([(1, 0, "P05", "a", "x"), (1, 1, "P05", "a", "x"), (1, 2, "P05", "b", "x"), (1, 3, "P06", "c", "y")], kind)
    after = spark.createDataFrame([(1, 0, "P05", "a", "x"), (1, 1, "P05", "z", "x"), (1, 2, "P07", "q", "w")], kind)
    got = sorted((r.status, r.rule_id, r.before_ix, r.after_ix) for r in revision.compare_findings(before, after).collect())
    assert got == [("carried_over", "P05", 1, 1), ("new", "P07", None, 2), ("persisting", "P05", 0, 0), ("resolved", "P05", 2, None), ("resolved", "P06", 3, None)]


def test_findings_pair_in_five_ways(spark):
    kind = "doc_id bigint, ix bigint, rule_id string, fingerprint string, matched string, suppressed boolean, context string"
    before = spark.createDataFrame([(1, 0, "P05", "a", "x", False, "c"), (1, 1, "P05", "b", "y y", False, "c"), (1, 2, "R01", "d", None, False, None), (1, 3, "P06", "e", "z", False, "c"), (1, 4, "P07", "f", "w", False, "c"), (1, 5, "P08", "g", "v", True, "c")], kind)
    after = spark.createDataFrame([(1, 0, "P05", "a", "x", True, "c"), (1, 1, "P05", "q", "yy", False, "k"), (1, 2, "R01", "r", None, False, None), (1, 3, "P06", "s", "z", True, "k"), (1, 4, "P07", "t", "other", False, "k"), (1, 5, "P08", "g", "v", False, "c")], kind)
    got = sorted((r.status, r.before_ix, r.after_ix) for r in revision.compare_findings(before, after).fillna(-1).collect())
    assert got == [("carried_over", 1, 1), ("new", -1, 4), ("new", -1, 5), ("persisting", 2, 2), ("resolved", 4, -1), ("suppressed", 0, 0), ("suppressed", 3, 3)]


def test_shifts_of_headings_rhythm_and_edits(spark):
    heads = lambda *t: spark.createDataFrame([(1, x) for x in t], "doc_id bigint, text string")
    assert [tuple(r) for r in revision.headings_rewritten(heads("a", "b", "c"), heads("x", "y", "z")).collect()] == [(1, 3, 3, 1.0)]
    assert revision.headings_rewritten(heads("a", "b", "c"), heads("a", "y", "z")).count() == 0 and revision.headings_rewritten(heads("a", "b"), heads("x", "y")).count() == 0
    kind = "doc_id bigint, block_ix int, ord int, text string, length bigint"
    sents = lambda texts: spark.createDataFrame([(1, 0, k, t, len(t)) for k, t in enumerate(texts)], kind)
    flat, waves = [f"{k}日目は倉庫を確かめた。" for k in range(12)], ["朝のうちに倉庫の棚を端から順に確かめた。" if k % 2 else "終わった。" for k in range(12)]
    assert [r.after for r in revision.alternation_shift(sents(flat), sents(waves)).collect()] == [pytest.approx(-1)]
    assert revision.alternation_shift(sents(waves), sents(waves)).count() == 0
    old = [f"部品{k}を倉庫で確かめている。" for k in range(5)] + ["変わらない文。"]
    new = [t.replace("確かめている", "確かめています") for t in old]
    assert [tuple(r) for r in revision.repeated_edits(sents(old), sents(new)).collect()] == [(1, "る", "ます", 5)]
    assert revision.local_edit("abcd", "abXcd") == ("", "X") and revision.local_edit("aaa", "aa") == ("a", "") and revision.edits_of(old, old) == []


def test_review(spark):
    docs = spark.createDataFrame([(1, "a", "plain", "倉庫の棚は三段です。")], DOCS)
    answers = json.dumps([{"technique": t, "found": False, "quote": None} for t in review.TECHNIQUES[2:]] + [{"technique": review.TECHNIQUES[0], "found": True, "quote": "棚は三段"}, {"technique": review.TECHNIQUES[1], "found": True, "quote": "無い"}, {"technique": "other", "found": False}])
    seen = review.responses(spark.createDataFrame([(1, answers)], "doc_id bigint, response string"))
    assert [(r.technique, r.problem) for r in review.problems(spark, seen, docs, parse(docs)).collect()] == [("other", "unknown"), (review.TECHNIQUES[1], "quote_not_found")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"doc_id": 1, "name": "a", "format": "plain", "source": "様々な棚。", "at": "2024-01-01T00:00:00Z"}
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(row | {"doc_id": k}) for k in (1, 2)))
    docs = stream.once_each(stream.read_documents(spark, str(tmp_path / "in")))
    stream.lint_stream(docs, Engine(Options(only=("P05",))), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
