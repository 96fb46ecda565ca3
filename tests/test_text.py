"""Column helpers, phrase matching, splitting."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import phrases as P
from prosemill.operators.calibrate import required_docs, split_point
from prosemill.operators.findings import fold_directives, parse_directive
from prosemill.operators.lists import buried_items, is_slogan
from prosemill.operators.phrase_data import CATALOGUE, RULES, expand
from prosemill.sources import parser


def test_columns(spark):
    rows = spark.createDataFrame([("𠮟る人。",), ("三つの箱 ",), ("「行こう。」",), ("",), (None,), ("ためになること。",)], "t string")
    got = rows.select(T.reading_length(F.col("t")).alias("n"), T.is_nominal(F.col("t")).alias("nom"), T.ending_of(F.col("t")).alias("e")).collect()
    assert [r.n for r in got] == [3, 4, 6, 0, None, 7]
    assert [r.nom for r in got] == [True, True, False, False, None, True]
    assert [r.e for r in got] == ["nominal", "nominal", "行こう"[-3:], None, None, "ること"]


def test_heading_shapes(spark):
    texts = {"1. 準備": "numbered", "在庫: 数え方": "colon", "準備とは": "question", "倉庫の棚": "plain", "Step 2 数える": "numbered", "なぜか？」": "question"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.s for r in rows.select("t", T.heading_shape(F.col("t")).alias("s")).collect()} == texts


def test_wilson_bounds(spark):
    rows = spark.createDataFrame([(0, n) for n in (10, 20, 30, 50, 100)], "h int, n int")
    got = [round(100 * r.u, 1) for r in rows.select(T.wilson_upper(F.col("h"), F.col("n")).alias("u")).collect()]
    assert got == [21.3, 11.9, 8.3, 5.1, 2.6]
    assert [required_docs(t) for t in (0.1, 0.05, 0.03, 0.02, 0.01)] == [25, 52, 88, 133, 268]


def matched(text, rule):
    return [f[6] for f in P.find_in(text, (rule,))]


@pytest.mark.parametrize(
    ("rule", "text", "want"),
    [
        ("P05", "様々な人が多くの本を読む。", ["様々な", "多くの"]),
        ("P06", "「非常に重要」とだけ書いた。", []),
        ("P06", "「非常に重要」と書かず、重要ですとも書かない。", ["重要です"]),
        ("P07", "一概には言えませんが、安い。", ["一概には言えません"]),
        ("P13", "この事実は需要の変化を示している。", ["この事実は需要の変化を示し"]),
        ("P13", "この事実は図で示された。", []),
        ("P14", "棚は——古いが丈夫で——使える。", ["——古いが丈夫で——"]),
        ("P15", "最高裁判所事務総局研究所へ行く。", []),
        ("P17", "知らないわけではない。", ["ないわけではない"]),
        ("P22", "詳しくは[cite: 1, 2]を見る。", ["[cite: 1, 2]"]),
        ("P23", "棚は**「丈夫」**です。", ["**「丈夫」**"]),
        ("P26", "囲碁の次の打ち手を考える。", []),
        ("P28", "入れてもかまいません。", ["てもかまいません"]),
        ("P28", "どちらを入れてもかまいません。", []),
        ("P29", "単なる記録ではなく、判断の材料だ。", ["単なる記録ではなく"]),
        ("P11", "理由は1つあります。", []),
    ],
)
def test_phrases(rule, text, want):
    assert matched(text, rule) == want


def test_leftmost_longest_and_selection():
    assert matched("在庫の確認を行います。", "P04") == ["を行います"]
    assert P.select([(0, 5, 3), (0, 7, 4), (6, 9, 1)]) == [(0, 7, 4)]
    assert P.select([(0, 9, 3), (4, 6, 0)], preferred=1) == [(4, 6, 0)]


def test_catalogue_is_whole():
    assert sorted(r for r in RULES if r[0] == "P") == [f"P{k:02d}" for k in range(1, 30)]
    assert sorted(r for r in RULES if r[0] == "R") == [f"R{k:02d}" for k in range(1, 23)]
    assert sorted(r for r in RULES if r[0] == "S") == [f"S{k:02d}" for k in range(1, 14)]
    assert len({v[0] for v in RULES.values()}) == len(RULES)
    assert all((signal is None) == (lane == "readability") for _, lane, signal, _ in RULES.values())
    assert set(P.SENTENCE_RULES) | {"P20"} == {r for r in RULES if r[0] == "P"} and set(CATALOGUE) <= set(RULES)


def test_notation():
    assert expand("{a/b}~1-3<c>[/{]") == "(?:a|b).{1,3}?(c)[/{]"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="あ漢A。！?「」（）. 1", max_size=40))
def test_sentences_cover_the_text(text):
    cuts = parser.split_sentences(text)
    assert all(a < b for a, b in cuts) and all(x[1] <= y[0] for x, y in zip(cuts, cuts[1:], strict=False))
    covered = {k for a, b in cuts for k in range(a, b)}
    assert all(c.isspace() or k in covered for k, c in enumerate(text))


def test_splitter():
    cut = lambda t: [t[a:b] for a, b in parser.split_sentences(t)]
    assert cut("これは（例。です）文。次！") == ["これは（例。です）文。", "次！"]
    assert cut("開いた（まま。次の文。") == ["開いた（まま。", "次の文。"]
    assert cut("https://x?a=1 を見る。") == ["https://x?a=1 を見る。"]
    assert cut("円周率は３．１４だ。") == ["円周率は３．１４だ。"]


def test_directives_fold():
    assert parse_directive(" prosemill-disable P01, P02 -- reason ") == ("disable", ["P01", "P02"], "reason")
    assert parse_directive("something else") is None
    got = fold_directives([(0, 10, 1, "disable", [], "why"), (20, 30, 3, "enable", ["P01"], None), (50, 60, 6, "enable", [], None), (70, 80, 9, "disable-next-line", ["P05"], None)])
    assert got == [("range", 10, 20, [], True, "why"), ("range", 30, 50, ["P01"], True, "why"), ("line", 10, 10, ["P05"], False, None)]


def test_lists():
    assert buried_items("机、椅子、書架、台帳を並べる。") == 4
    assert buried_items("今日、机（椅子、棚）を置く。") == 0
    assert is_slogan("迷う日は、まず数える。") == 1 and is_slogan("雨なので、休む。") == 0


def test_split_point_is_uniform():
    points = [split_point(f"doc{k}") for k in range(4000)]
    assert 0.27 < sum(p < 0.3 for p in points) / 4000 < 0.33 and split_point("a") == split_point("a")
