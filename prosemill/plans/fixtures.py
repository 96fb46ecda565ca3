"""Deterministic Japanese and Markdown texts over the ids of ``documents``, in both engines.

The driver's tables hold no Japanese and no Markdown; phrase, rhythm and structure rules
need both. Each view exists as a DataFrame and as SQL over the view ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.sources.scan import unfolded

POOL = (
    "さて、今日は倉庫の棚卸しについて書きます。", "様々な部署が多くの資料を保管している。", "この結果は非常に重要だと考えている。", "費用は一概には言えませんが、目安はある。", "鍵となる作業は朝のうちに終える。",
    "この事実は、需要が移ったことを示している。", "新しい端末は圧倒的な速さで動く。", "午前中に在庫の確認を行います。", "倉庫の外から状態を見ることができます。", "かしこまりました、すぐに手配いたします。",
    "手順の参考になれば幸いです。", "これは単なる記録ではなく、判断の材料だ。", "大事なのは速度ではなく、正確さだ。", "それは避けられない作業だ。", "なぜなら、締め日が店ごとに違うからだ。",
    "なぜ在庫は合わないのか。", "答えは、返品の記録が遅れるからだ。", "箱は三段。", "顧客情報統合管理基盤移行計画を承認した。", "遅れが出ないわけではない。",
    "棚の番号は朝に貼り替え、夕方に写真を撮って残し、翌朝の打ち合わせで全員が確かめてから次の入荷に備えることにしている。", "担当者は昼までに入荷の数を数え、台帳へ書き写した。",
)
CLOSERS = ("まずは、小さな棚から試してみましょう。", "運用には課題が残ります。", "今後の普及が期待されます。")


def _pick(values: tuple[str, ...], at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def ja_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, block_ix, ord, text of 12 to 31 Japanese sentences a document; four make a paragraph."""
    ids = unfolded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")
    i, d = F.col("ord"), F.col("doc_id")
    rows = ids.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(31)))).filter(i < 12 + d % 20)
    pid = F.when(d % 5 == 0, 1 + (d + i) % 7).otherwise((d * 7 + i + F.floor(i / 3) * 5) % 22)
    last = 11 + d % 20
    text = F.when((d % 3 == 0) & (i == last), F.lit(CLOSERS[0])).when((d % 3 == 1) & (i == last - 1), F.lit(CLOSERS[1])).when((d % 3 == 1) & (i == last), F.lit(CLOSERS[2])).otherwise(_pick(POOL, pid))
    return rows.select("doc_id", F.floor(i / 4).cast("int").alias("block_ix"), "ord", text.alias("text"))


def _quoted(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


JA = f"""
ja AS (
  SELECT doc_id, CAST(ord // 4 AS INT) AS block_ix, ord, CASE
    WHEN doc_id % 3 = 0 AND ord = 11 + doc_id % 20 THEN '{CLOSERS[0]}'
    WHEN doc_id % 3 = 1 AND ord = 10 + doc_id % 20 THEN '{CLOSERS[1]}'
    WHEN doc_id % 3 = 1 AND ord = 11 + doc_id % 20 THEN '{CLOSERS[2]}'
    WHEN doc_id % 5 = 0 THEN ({_quoted(POOL)})[CAST(1 + (doc_id + ord) % 7 AS INT) + 1]
    ELSE ({_quoted(POOL)})[CAST((doc_id * 7 + ord + (ord // 3) * 5) % 22 AS INT) + 1] END AS text
  FROM (SELECT doc_id, unnest(range(32)) AS ord FROM documents) WHERE ord < 12 + doc_id % 20
)"""

#: Lines of a Markdown page; documents take a run of them that depends on the id.
LINES = (
    "# 棚卸しの手順", "朝の作業は**早く**始めます。", "## 1. 準備する", "- **道具**: 脚立と台帳", "- **人**: 二人で行う", "- **時間**: 一時間ほど", "## 準備とは何か", "**棚**の前で**数**を読み、**台帳**へ書きます：", "- 数える", "- 書く",
    "## まとめ", "ステップ1で数え、ステップ2で書き、フェーズ3で確かめる。", "✅ 台帳は倉庫に置く", "注意点：雨の日は開けない。", "次の3項目を確かめます。", "- 鍵", "- 窓", "## 空の節", "## 在庫: 数え方", "詳しくは[cite: 1, 2]を見る。",
    "⭐ 棚番号は朝に貼る 📌 夕方に写す 🚀", "補足：古い棚は使わない。", "連絡先：倉庫の窓口へ。", "### **重要** な棚",
)


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_ix, line: 10 to 33 lines of a Markdown page for each document."""
    ids = unfolded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")
    i, d = F.col("line_ix"), F.col("doc_id")
    rows = ids.withColumn("line_ix", F.explode(F.sequence(F.lit(0), F.lit(32)))).filter(i < 10 + d % 24)
    return rows.select("doc_id", "line_ix", _pick(LINES, (d % 11 + i) % len(LINES)).alias("line"))


MD = f"""
md AS (
  SELECT doc_id, line_ix, ({_quoted(LINES)})[CAST((doc_id % 11 + line_ix) % {len(LINES)} AS INT) + 1] AS line
  FROM (SELECT doc_id, unnest(range(33)) AS line_ix FROM documents) WHERE line_ix < 10 + doc_id % 24
)"""


#: Sentences for the phrase rules that the first pool doesn't reach.
POOL_B = (
    "結論として、棚は三つで足りると言えます。", "このように、荷は減っていく。", "つまり、鍵を渡すということです。", "仕組みを深掘りします。", "原因を掘り下げている。", "手順を言語化していく。", "これこそが棚卸しの醍醐味だ。",
    "理由は3つあります。", "大きく分けて二つの棚がある。", "以下の4点を確かめる。", "この道具は地味に効く。", "次の打ち手を考えます。", "計画に落とし込む作業が残る。", "入口の扉は開けておいてもかまいません。", "専門家は需要の増加を指摘しています。",
    "本書は手順の重要さを強調する。", "倉庫の棚の番号の表を見る。", "迅速、柔軟、安全な作業を目指す。", "赤の棚、青の棚、白の棚、黒の棚。", "記録は安全につながります。", "準備は静かに進み、ふと気づくと夜だった。", "私たちは少しだけ立ち止まる。", "棚は——古いけれど丈夫で——今も使える。",
    "机、椅子、書架、台帳、脚立、照明、暖房器具、掲示板を倉庫の北側に運び、入口から順に並べてください。", "以上、棚卸しについて解説しました。", "迷う日は、まず数える。",
)


def jb_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, block_ix, ord, text of 15 sentences a document from the second pool, three a paragraph."""
    ids = unfolded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")
    rows = ids.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(14))))
    return rows.select("doc_id", F.floor(F.col("ord") / 3).cast("int").alias("block_ix"), "ord", _pick(POOL_B, (F.col("doc_id") * 3 + F.col("ord") * 7) % len(POOL_B)).alias("text"))


JB = f"""
jb AS (SELECT doc_id, CAST(ord // 3 AS INT) AS block_ix, ord, ({_quoted(POOL_B)})[CAST((doc_id * 3 + ord * 7) % {len(POOL_B)} AS INT) + 1] AS text
  FROM (SELECT doc_id, unnest(range(15)) AS ord FROM documents))"""
