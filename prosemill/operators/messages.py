"""Short messages of the rules, for reports and annotations."""

from __future__ import annotations

MESSAGES = {
    "P01": "A stock phrase of conclusion",
    "P02": "A stock phrase of introduction",
    "P03": "A stock conjunction",
    "P04": "A verb that says what a shorter one says",
    "P05": "A modifier that adds nothing",
    "P06": "Emphasis beyond what is said",
    "P07": "Hedging",
    "P08": "An adjective without content",
    "P09": "A verb without content",
    "P10": "A dramatic closing phrase",
    "P11": "An announced count",
    "P12": "Phrasing as of a translation",
    "P13": "An inanimate subject that acts",
    "P14": "A long dash",
    "P15": "A long run of kanji",
    "P16": "A chain of the same particle",
    "P17": "A double negative",
    "P18": "A trace of a chat answer",
    "P19": "Hype",
    "P20": "A sentence that goes on behind a colon",
    "P21": "An attribution without a source",
    "P22": "A citation mark of a tool",
    "P23": "A residue of markup",
    "P24": "An effect that isn't named",
    "P25": "A comment on sources instead of their content",
    "P26": "Jargon for an action",
    "P27": "A stock closing sentence",
    "P28": "A permission where an action is meant",
    "P29": "A contrast with what nobody claimed",
    "R01": "Sentences are all about equally long",
    "R02": "Several sentences in a row end alike",
    "R03": "A long sentence",
    "R04": "A list buried in a sentence",
    "R05": "Contrasts repeat",
    "R06": "No sentence ends in a noun",
    "R07": "Paragraphs hold equally many sentences",
    "R08": "Sentences open alike",
    "R09": "Paragraphs open with conjunctions",
    "R10": "A reason is given by a cleft sentence",
    "R11": "A question that its writer answers",
    "R12": "Rhythm looks made",
    "R13": "Commas are unusual in number",
    "R14": "A passage comes twice",
    "R15": "The end hopes for the future",
    "R16": "Triads of praise repeat",
    "R17": "Phrases of guides are dense",
    "R18": "Lists of nouns repeat",
    "R19": "The end calls to action",
    "R20": "Polite and plain endings mix",
    "R21": "Short slogans repeat",
    "R22": "Phrases of essays cluster",
    "S01": "Much bold text",
    "S02": "Much of the text is bullets",
    "S03": "A heading that says nothing",
    "S04": "Numbered phases",
    "S05": "Many emoji",
    "S06": "List items with bold labels",
    "S07": "Headings follow one template",
    "S08": "Emphasis inside headings",
    "S09": "Much structure for little text",
    "S10": "Labels in place of sentences",
    "S11": "An announced count differs from the items",
    "S12": "A section without text",
    "S13": "The whole document is wrapped in a fence",
}
