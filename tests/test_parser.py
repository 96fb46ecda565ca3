"""Parsers: kinds, texts and positions."""

from prosemill.sources import files, parser
from prosemill.sources.parser import block_rows


def blocks(source, form="markdown"):
    return [(b.kind, b.text) for b in parser.parse_one(source, form)[0]]


def test_markdown_kinds():
    source = "---\nauthor: me\n---\n# 題\n\n本文**太字**と`code`。\n続き。\n\n- 一\n  - [ ] 二\n1. 三\n\n> 引用。\n\n| a | b |\n|---|---|\n| 一 | 二 |\n\n***\n\n題二\n---\n\n~~~ sh\nls\n~~~"
    assert blocks(source) == [("heading", "題"), ("paragraph", "本文太字と￼。続き。"), ("item", "一"), ("item", "二"), ("item", "三"), ("paragraph", "引用。"), ("cell", "a"), ("cell", "b"), ("cell", "一"), ("cell", "二"), ("heading", "題二")]


def test_spans_point_at_the_source():
    source = "前の段落。\n\nこれは**強い**[語](http://a.b)です。次の文。\n"
    for row in block_rows(1, source, "markdown"):
        assert source[row[5] : row[6]] == row[11]
        for s in row[15]:
            assert s["line"] == source[: s["source_start"]].count("\n") + 1
            assert source[s["source_start"] : s["source_end"]].strip()[-1] == row[4][s["end"] - 1]


def test_front_matter_and_rule():
    assert blocks("---\nこれは地の文です。\n---\n本文。")[-1] == ("paragraph", "本文。")
    assert parser.front_matter("---\na: 1\n---\n") > 0 and parser.front_matter("---\n地の文。\n---\n") == 0


def test_wrapped_document():
    got, wrapped = parser.parse_one("```markdown\n# x\n\n本文。\n```\n", "markdown")
    assert wrapped and [b.kind for b in got] == ["heading", "paragraph"]
    assert not parser.parse_one("文。\n```markdown\nx\n```\n", "markdown")[1]


def test_unrendered_strong_stays():
    assert blocks("棚は**「丈夫」**です。") == [("paragraph", "棚は**「丈夫」**です。")]


def test_html():
    source = "<h2>題 &amp; 名</h2><script>x</script><p>本<b>文</b>。<!-- c --></p><blockquote><p>引用</p></blockquote><ul><li>項</li></ul>"
    got = parser.html(source)
    assert [(b.kind, b.text) for b in got] == [("heading", "題 & 名"), ("paragraph", "本文。"), ("paragraph", "引用"), ("item", "項")]
    assert got[2].in_quote and ("strong", 1, 2) in got[1].marks


def test_code():
    assert blocks("# 一行目。\n# 二行目。\nx = '# no'\n", "code:py") == [("comment", "一行目。二行目。")]
    assert blocks("/** 概要。\n * 続き。\n */\nint x; // 行\n", "code:java") == [("doc", "概要。続き。"), ("comment", "行")]
    assert blocks("-- 説明。\nSELECT '-- no';\n", "code:sql") == [("comment", "説明。")]
    assert blocks("// Copyright 2020\n\n// 本文。\n", "code:rs") == [("comment", "本文。")]


def test_plain_text():
    assert blocks("題名\n\n一行目。\n二行目。\n\n・項一\n・項二", "plain") == [("heading", "題名"), ("paragraph", "一行目。二行目。"), ("item", "項一"), ("item", "項二")]
    assert blocks("一。\n二。\n三。\n四。", "plain") == [("paragraph", "一。"), ("paragraph", "二。"), ("paragraph", "三。"), ("paragraph", "四。")]


def test_odd_inputs():
    for form in ("markdown", "plain", "html", "code:py", "code:rs", "code:sql"):
        for source in ("", "\n\n", "﻿", "**", "[", "```", "<", "|", "> ", "- ", "\\", "#", "/*", "'''", "a" * 50_000, "（" * 2000, "* " * 2000):
            parser.parse_one(source, form)
    assert block_rows(1, None, "plain") == []


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# 題\n", encoding="utf-8")
    (tmp_path / "a" / "skip.md").write_text("x", encoding="utf-8")
    (tmp_path / "y.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / ".hidden.md").write_text("x", encoding="utf-8")
    (tmp_path / "z.rs").write_text("// x", encoding="utf-8")
    docs, errors = files.read_files(spark, str(tmp_path), ignore=("skip.*",))
    assert [(r.name, r.format) for r in docs.collect()] == [("a/x.md", "markdown")] and [r.name for r in errors.collect()] == ["y.txt"]


def test_diff():
    diff = "--- a/x.md\n+++ b/x.md\n@@ -1,2 +1,3 @@\n a\n+b\n@@ -9,0 +11 @@\n+c\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    assert files.parse_diff(diff) == [("x.md", 1, 3), ("x.md", 11, 11)]
