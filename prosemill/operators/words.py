"""Word lists of the rules, each in the order of a dictionary.

These lists, and the catalogue in ``phrase_data``, decide what a rule finds. They agree with the rule set that this library
re-implements, and are data taken from it; its license is in the file NOTICE.
"""

from __future__ import annotations

#: Nouns that only stand for a clause.
FORMAL_NOUNS = "うち こと ため つもり とき ところ はず ほう ほど まま もの わけ"
#: Conjunctions that open a paragraph (R09).
CONJUNCTIONS = "このように さらに しかし したがって そして そのため ただし つまり なぜなら また 一方 一方で 一方では"
#: Starts of headings that say nothing (S03).
BOILERPLATE = "conclusion おわりに さいごに まとめ 最後に 終わりに 結論 総括"
#: Words of praise (R16).
PRAISE = "価値 便利 信頼 効果的 効率 効率的 品質 安全 安心 成長 持続可能 早く 柔軟 画期的 直感的 簡単 迅速 速く 革新的 高品質"
#: Words of games and bells, where a jargon verb is meant literally (P26).
GAMES = "オセロ 囲碁 太鼓 対局 将棋 棋士 盤面 碁盤 鐘 雀士 麻雀"
#: Ends of a state, which no permission follows (P28).
STATES = "あっ かつ がい くなっ くもっ すべ だっ てい でい となっ にい になっ"
#: Question words, after which a permission is none (P28).
QUESTION_WORDS = "いかなる いくつ いくら いずれ だれ どう どこ どちら どっち どの どれ どんな なに 何 誰"
#: Words that merely begin like question words (P28).
NOT_QUESTION_WORDS = "どうしても どうぞ ほどこ みんな 何らか 何卒"
#: Last characters of verb stems whose te-form is voiced (P28).
VOICED_STEMS = "仰凌削剥嗅塞寛急担注泳漕研稼紡継繋脱防騒"
#: What the future is hoped to bring (R15).
HOPES = "成長 改善 普及 活用 発展 進展"
#: Units of counted facts.
UNITS = "% GB KB MB TB cm kg km mm ms か月 カ月 キロ ページ ヵ月 ヶ月 人 件 個 倍 円 分 分間 割 台 名 回 字 年 年代 年間 文 日 日間 時 時間 月 本 歳 点 社 秒 秒間 章 箇月 節 行 週 週間 頁 ％"
