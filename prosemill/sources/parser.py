"""Documents to blocks and sentences with positions: Markdown, plain text, HTML, code comments.

``parse`` runs one Python pass over (doc_id, name, source, format) rows and yields blocks; the
sentence table is cut from them in the same pass. Offsets count characters of the source.
A block's text is what a reader sees: markup is gone, inline code, images and mathematics are
one placeholder. ``map`` pieces tie text ranges to source ranges.

Markdown is the subset that prose uses: ATX and setext headings, paragraphs with soft and hard
breaks, lists with task marks, block quotes, fenced and indented code (dropped), tables, thematic
breaks, front matter, HTML blocks and comments, emphasis, strong, strikethrough, links, images,
inline code, footnotes, and a whole-document ``markdown`` fence, which is unwrapped. Not covered:
reference definitions that span lines, nested block structure beyond quotes in lists.

Cases: a null source has no blocks. A text of one line, and one of very many, are parsed in
linear time. Unknown formats are read as plain text. Undecodable files never get here: see
``sources.files``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions.text import BRACKETS, ENDERS
from prosemill.operators.phrases import JAPANESE

HOLDER = "￼"
#: Families of comment syntax by language.
LANGUAGES = {
    "rs": "c", "js": "c", "jsx": "c", "ts": "c", "tsx": "c", "java": "c", "c": "c", "h": "c", "cpp": "c", "cc": "c", "hpp": "c", "cs": "c", "go": "c", "kt": "c", "swift": "c", "scala": "c", "dart": "c", "php": "c#", "css": "c",
    "py": "python", "rb": "#", "sh": "#", "bash": "#", "yaml": "#", "yml": "#", "toml": "#", "r": "#", "pl": "#", "ex": "#", "sql": "--", "lua": "--", "hs": "--", "elm": "--", "vue": "c", "zig": "c",
}
FORMATS = {**{e: "markdown" for e in ("md", "markdown", "mdown", "mkd", "mdx")}, "txt": "plain", "html": "html", "htm": "html", **{e: f"code:{e}" for e in LANGUAGES}}


def format_of(name: Column) -> Column:
    """The format that a file name's extension implies; plain where it says nothing."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    out = F.lit("plain")
    for e, f in FORMATS.items():
        out = F.when(ext == e, F.lit(f)).otherwise(out)
    return out


@dataclass
class Block:
    """One block; marks are (kind, start, end) in the text, pieces (text start, source start, length)."""

    kind: str
    text: str
    start: int
    end: int
    level: int = 0
    in_quote: bool = False
    in_footnote: bool = False
    marks: list[tuple[str, int, int]] = field(default_factory=list)
    pieces: list[tuple[int, int, int]] = field(default_factory=list)
    breaks: list[int] = field(default_factory=list)

    def source_at(self, at: int) -> int:
        """Source offset of a text offset."""
        best = self.start
        for t, s, n in self.pieces:
            if t > at:
                break
            best = s + min(at - t, n)
        return best


_INLINE = re.compile(r"(?P<code>`+)(?P<in>.+?)(?<!`)(?P=code)(?!`)|!\[[^\]]*\]\([^)\s]*(?:\s+\"[^\"]*\")?\)|\$\$[^$]+\$\$|\[\^[^\s\]]+\]|<!--.*?-->|</?[A-Za-z][^<>]*>|\[(?P<label>[^\[\]]+)\]\((?P<url>[^)\s]*)(?:\s+\"[^\"]*\")?\)|(?P<auto><https?://[^>\s]+>)|(?P<run>\*{1,3}|~~)|\\(?P<esc>[!-/:-@\[-`{-~])", re.S)


def _flank(text: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether a run of asterisks may open and close emphasis."""
    before, after = text[start - 1 : start] or " ", text[end : end + 1] or " "
    mark = lambda c: not c.isalnum() and not c.isspace()
    left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
    right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
    return left, right


def inline(raw: str, at: int, block: Block) -> None:
    """Adds inline Markdown to a block; ``at`` is the source offset of raw."""
    out, open_ = [], []
    size = len(block.text)

    def put(text: str, source: int) -> None:
        nonlocal size
        if text:
            block.pieces.append((size, source, len(text)))
            out.append(text)
            size += len(text)

    k = 0
    for m in _INLINE.finditer(raw):
        if m.start() < k:
            continue
        run = m.group("run")
        if run:
            left, right = _flank(raw, m.start(), m.end())
            mate = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == run), None) if right else None
            later = left and mate is None and any(_flank(raw, c.start(), c.end())[1] for c in re.finditer(r"(?<![*~])" + re.escape(run) + r"(?![*~])", raw[m.end() :]) if c.start() > 0 or run == "~~")
            if mate is None and not later:
                continue
            put(raw[k : m.start()], at + k)
            if mate is not None:
                _, start = open_[mate]
                del open_[mate:]
                kind = {"*": "emphasis", "**": "strong", "***": "strong", "~~": "strikethrough"}[run]
                block.marks.append((kind, start, size))
            else:
                open_.append((run, size))
            k = m.end()
            continue
        put(raw[k : m.start()], at + k)
        k = m.end()
        if m.group("esc"):
            put(m.group("esc"), at + m.start() + 1)
        elif m.group("label") is not None:
            start = size
            put(m.group("label"), at + m.start("label"))
            block.marks.append(("link", start, size))
        elif m.group("code") or m.group().startswith(("![", "$$")) or m.group("auto"):
            kind = "code" if m.group("code") else "image" if m.group().startswith("![") else "math" if m.group().startswith("$$") else "link"
            block.marks.append((kind, size, size + 1))
            put(HOLDER, at + m.start())
    put(raw[k:], at + k)
    block.text += "".join(out)


_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"^(\s*)(?:\d{1,9}[).]|[+*-])[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^\s`]*)")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_TABLE = re.compile(r"^ {0,3}\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$")
_NOTE = re.compile(r"^\[\^[^\]\s]+\]:\s*")
_HTML = re.compile(r"^ {0,3}<(?:!--|/?(?:address|article|aside|blockquote|center|details|div|dl|dt|dd|figure|footer|form|h[1-6]|header|hr|iframe|li|main|nav|ol|p|pre|script|section|style|summary|table|tbody|td|th|thead|tr|ul)\b)", re.I)


def _lines(source: str, offset: int = 0) -> list[tuple[int, str]]:
    out, at = [], offset
    for line in source.split("\n"):
        out.append((at, line[:-1] if line.endswith("\r") else line))
        at += len(line) + 1
    return out


def front_matter(source: str) -> int:
    """Characters of the front matter at the top; 0 without one, or if it holds prose."""
    m = re.match(r"\A(---|\+\+\+)[ \t]*\r?\n(.*?)^\1[ \t]*$\r?\n?", source, re.S | re.M)
    if not m:
        return 0
    body = m.group(2)
    return m.end() if all(not x.strip() or re.match(r"\s*(?:[\w.-]+\s*[:=]|[-#\]\[}{\"']|\S+:)|\s+\S", x) for x in body.split("\n")) else 0


def unwrap(source: str, start: int) -> tuple[int, int, bool]:
    """(start, end, wrapped): the inside of a fence that holds the whole body as Markdown."""
    m = re.match(r"\s*(`{3,}|~{3,})(?:markdown|md)[ \t]*\r?\n", source[start:], re.I)
    if m:
        end = re.search(rf"\n{re.escape(m.group(1)[0])}{{{len(m.group(1))},}}[ \t]*\s*\Z", source[start + m.end() - 1 :])
        if end:
            return start + m.end(), start + m.end() - 1 + end.start(), True
    return start, len(source), False


def markdown(source: str) -> tuple[list[Block], bool]:
    """Blocks of Markdown, and whether a fence wrapped the whole document."""
    start, end, wrapped = unwrap(source, front_matter(source))
    blocks: list[Block] = []
    now: Block | None = None
    fence: str | None = None
    in_html = table = False
    quoted = False

    def close() -> None:
        nonlocal now
        if now is not None and now.text.strip():
            blocks.append(now)
        now = None

    for at, line in _lines(source[start:end], start):
        body, off = line, at
        quote = False
        while m := re.match(r" {0,3}> ?", body):
            quote, body, off = True, body[m.end() :], off + m.end()
        if quote != quoted:
            if not (quoted and now is not None and body.strip() and not quote and now.kind == "paragraph"):
                close()
                table = False
            quoted = quote
        if fence:
            if re.match(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}\s*$", body.strip() and body):
                fence = None
            continue
        if in_html:
            in_html = bool(body.strip())
            if in_html:
                continue
        if not body.strip():
            close()
            table = False
            continue
        if m := _FENCE.match(body):
            close()
            fence = m.group(1)
        elif m := _HEADING.match(body):
            close()
            now = Block("heading", "", off, at + len(line), len(m.group(1)), quote)
            if m.group(2):
                inline(m.group(2), off + m.start(2), now)
            close()
        elif now is not None and now.kind == "paragraph" and re.match(r"^ {0,3}(=+|-+)\s*$", body):
            now.kind, now.level, now.end = "heading", 1 if "=" in body else 2, at + len(line)
            close()
        elif _RULE.match(body):
            close()
        elif _TABLE.match(body) and now is not None and "|" in source[now.start : now.end]:
            head = source[now.start : now.end].split("\n")[-1]
            row_at = now.end - len(head)
            now = None
            _cells(head, row_at, quote, blocks)
            table = True
        elif table and "|" in body:
            _cells(body, off, quote, blocks)
        elif m := _ITEM.match(body):
            close()
            now = Block("item", "", off, at + len(line), len(m.group(1)) // 2, quote)
            inline(body[m.end() :], off + m.end(), now)
        elif _HTML.match(body) and now is None:
            if not body.lstrip().startswith("<!--") or "-->" not in body:
                blocks.extend(_shift(html(body), off))
                in_html = True
        elif now is None and re.match(r"^(?: {4}|\t)", body):
            continue
        else:
            note = _NOTE.match(body) if now is None else None
            if now is None:
                now = Block("paragraph", "", off, at + len(line), 0, quote, note is not None)
            else:
                now.breaks.append(len(now.text))
                if now.text and not (re.search(f"[{JAPANESE}。、」）]$", now.text) or re.match(f"\\s*[{JAPANESE}。、「（]", body)):
                    now.text += " "
            raw = body[note.end() :] if note else body
            lead = len(raw) - len(raw.lstrip())
            inline(raw.strip(), off + (note.end() if note else 0) + lead, now)
            now.end = at + len(line)
    close()
    return blocks, wrapped


def _cells(row: str, at: int, quote: bool, blocks: list[Block]) -> None:
    for m in re.finditer(r"(?:\\.|[^|\\])+", row):
        raw = m.group()
        if raw.strip():
            b = Block("cell", "", at + m.start(), at + m.end(), 0, quote)
            inline(raw.strip(), at + m.start() + len(raw) - len(raw.lstrip()), b)
            blocks.append(b)


def _shift(blocks: list[Block], by: int) -> list[Block]:
    for b in blocks:
        b.start, b.end, b.pieces = b.start + by, b.end + by, [(t, s + by, n) for t, s, n in b.pieces]
    return blocks


_BULLET = re.compile(r"^\s*(?:[・●○◆◇■□▪▶►※✓✔*+-]|\d{1,3}[.)．）]|[①-⑳]|[(（]\d{1,3}[)）])\s*(?=\S)")


def plain_text(source: str) -> list[Block]:
    """Paragraphs between blank lines; bullets are items, a short line without punctuation is a heading of level 0.

    Where blank lines are rare, each line is a paragraph of its own.
    """
    source_ = re.sub(r"<!--.*?-->", lambda m: re.sub(r"[^\n]", " ", m.group()), source, flags=re.S)
    lines = _lines(source_)
    full = [x for x in lines if x[1].strip()]
    blank = len(lines) - len(full)
    by_line = len(full) >= 3 and blank <= 0.05 * len(full)
    blocks: list[Block] = []
    now: Block | None = None
    for at, line in [*lines, (len(source), "")]:
        stripped = line.strip("\u3000 \t")
        bullet = _BULLET.match(line)
        if not stripped or by_line or bullet or line[:1] in ("\u3000", "「", "『"):
            if now is not None:
                if now.kind == "paragraph" and not now.breaks and not by_line and len(now.text) <= 20 and not re.search("[。、，．！？!?,.:：;]", now.text):
                    now.kind = "heading"
                blocks.append(now)
            now = None
        if not stripped:
            continue
        lead = bullet.end() if bullet else len(line) - len(line.lstrip("\u3000 \t"))
        text = line[lead:].rstrip("\u3000 \t")
        if now is None:
            now = Block("item" if bullet else "paragraph", "", at, at + len(line))
        else:
            now.breaks.append(len(now.text))
            if not (re.search(f"[{JAPANESE}。、」）]$", now.text) or re.match(f"[{JAPANESE}。、「（]", text)):
                now.text += " "
        now.pieces.append((len(now.text), at + lead, len(text)))
        now.text, now.end = now.text + text, at + len(line)
    return blocks


class _Html(HTMLParser):
    HIDDEN = set("noscript textarea template pre code style script".split())
    KINDS = {**{f"h{k}": ("heading", k) for k in range(1, 7)}, "li": ("item", 0), "td": ("cell", 0), "th": ("cell", 0), "p": ("paragraph", 0), "div": ("paragraph", 0), "blockquote": ("paragraph", 0), "title": ("paragraph", 0), "article": ("paragraph", 0), "section": ("paragraph", 0), "footer": ("paragraph", 0), "nav": ("paragraph", 0), "ul": ("paragraph", 0), "ol": ("paragraph", 0), "body": ("paragraph", 0), "dd": ("paragraph", 0), "dt": ("paragraph", 0)}
    MARKS = {"b": "strong", "strong": "strong", "i": "emphasis", "em": "emphasis", "a": "link", "del": "strikethrough", "s": "strikethrough"}

    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.source, self.blocks, self.now, self.hidden, self.quote, self.marks = source, [], None, [], 0, []
        self.starts = [0]
        for m in re.finditer("\n", source):
            self.starts.append(m.end())

    def at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def open(self, kind: str, level: int) -> None:
        self.close_block()
        self.now = Block(kind, "", self.at(), self.at(), level, self.quote > 0)

    def close_block(self) -> None:
        if self.now is not None:
            for kind, start in self.marks:
                self.now.marks.append((kind, start, len(self.now.text)))
            text = self.now.text.rstrip()
            if text.strip():
                self.now.text = text
                self.blocks.append(self.now)
        self.now, self.marks = None, []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN or any(k == "hidden" for k, _ in attrs):
            if tag not in ("br", "img", "hr", "input", "meta", "link"):
                self.hidden.append(tag)
        elif self.hidden:
            return
        elif tag in self.KINDS:
            if tag == "blockquote":
                self.quote += 1
            self.open(*self.KINDS[tag])
        elif tag == "br" and self.now is not None:
            self.now.breaks.append(len(self.now.text))
        elif tag in self.MARKS and self.now is not None:
            self.marks.append((self.MARKS[tag], len(self.now.text)))

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif tag in self.KINDS:
            self.close_block()
            if tag == "blockquote":
                self.quote = max(0, self.quote - 1)
        elif tag in self.MARKS and self.now is not None:
            for k in range(len(self.marks) - 1, -1, -1):
                if self.marks[k][0] == self.MARKS[tag]:
                    kind, start = self.marks.pop(k)
                    self.now.marks.append((kind, start, len(self.now.text)))
                    break

    def put(self, text: str, width: int) -> None:
        if self.hidden:
            return
        if self.now is None:
            if not text.strip():
                return
            self.open("paragraph", 0)
        lead = len(text) - len(text.lstrip())
        clean = re.sub(r"\s+", " ", text.lstrip() if not self.now.text or self.now.text.endswith(" ") else text)
        self.now.pieces.append((len(self.now.text), self.at() + (lead if clean[:1] != " " else 0), len(clean)))
        self.now.text += clean
        self.now.end = self.at() + width

    def handle_data(self, data):
        self.put(data, len(data))

    def handle_entityref(self, name):
        from html import unescape

        self.put(unescape(f"&{name};"), len(name) + 2)

    def handle_charref(self, name):
        from html import unescape

        self.put(unescape(f"&#{name};"), len(name) + 3)


def html(source: str) -> list[Block]:
    """Visible blocks of HTML."""
    p = _Html(source)
    p.feed(source)
    p.close()
    p.close_block()
    return p.blocks


_LICENSE = re.compile(r"SPDX-License-Identifier|^\s*Copyright\b|All rights reserved|Licensed under", re.I | re.M)
_TOOL = re.compile(r"^\s*(?:noqa|type:\s*ignore|pylint:|eslint-|fmt:|rustfmt|clang-format|@ts-|NOLINT|go:|!|coding[:=]|vim:)")
_CODE = {
    "c": re.compile(r"(?P<s>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[/!]?(?P<line>[^\n]*)|/\*+!?(?P<block>.*?)\*/", re.S),
    "#": re.compile(r"(?P<s>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|#(?P<line>[^\n]*)", re.S),
    "--": re.compile(r"(?P<s>'(?:''|[^'])*'|\"(?:\\.|[^\"\\\n])*\")|--(?!\[\[)(?P<line>[^\n]*)|(?:/\*|--\[\[|\{-)(?P<block>.*?)(?:\*/|\]\]|-\})", re.S),
    "python": re.compile(r"(?P<doc>(?<=\n)[ \t]*(?:[rRbBuU]{0,2})(?P<q>\"\"\"|''')(?P<block>.*?)(?P=q)|\A(?P<q2>\"\"\"|''')(?P<block2>.*?)(?P=q2))|(?P<s>[rRbBuUfF]{0,2}(?:\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))|#(?P<line>[^\n]*)", re.S),
}
_CODE["c#"] = re.compile(_CODE["c"].pattern + r"|#(?!\[)(?P<hash>[^\n]*)", re.S)


def code(source: str, language: str, strings: bool = False) -> list[Block]:
    """Comments and doc strings; neighbouring line comments are one block. strings: Japanese literals too."""
    blocks: list[Block] = []
    last_end, last_line = -1, -2
    for m in _CODE[LANGUAGES.get(language, "c")].finditer(source):
        g = m.groupdict()
        line_no = source.count("\n", 0, m.start())
        if g.get("s") is not None:
            if strings and re.search(f"[{JAPANESE}]", g["s"]):
                blocks.append(Block("string", g["s"].strip("\"'`"), m.start(), m.end(), pieces=[(0, m.start() + 1, len(g["s"]) - 2)]))
            continue
        group = next((k for k in ("line", "hash", "block", "block2") if g.get(k) is not None), None)
        if group is None:
            continue
        text, at = g[group], m.start(group)
        if group in ("line", "hash"):
            if _TOOL.match(text) or (text.startswith("!") and m.start() == 0):
                continue
            lead = len(text) - len(text.lstrip())
            if blocks and blocks[-1].kind == "comment" and line_no == last_line + 1 and source[last_end : m.start()].strip() == "" and text.strip():
                b = blocks[-1]
                b.breaks.append(len(b.text))
                if b.text and not re.search(f"[{JAPANESE}。、」）]$", b.text):
                    b.text += " "
                b.pieces.append((len(b.text), at + lead, len(text.strip())))
                b.text, b.end = b.text + text.strip(), m.end()
            elif text.strip():
                blocks.append(Block("comment", text.strip(), m.start(), m.end(), pieces=[(0, at + lead, len(text.strip()))]))
            last_end, last_line = m.end(), line_no
            continue
        for off, line in _lines(text, at):
            lead = re.match(r"[ \t]*(?:\*(?!\*)[ \t]?)?[ \t]*", line).end()
            body = re.sub(r"</?[A-Za-z][^<>]*>|\{@\w+\s+|(?<=\S)\}", " ", line[lead:]).rstrip()
            if not body.strip():
                last_line = -2
                continue
            if blocks and blocks[-1].kind == "doc" and blocks[-1].end == off - 1:
                b = blocks[-1]
                b.breaks.append(len(b.text))
                if b.text and not re.search(f"[{JAPANESE}。、」）]$", b.text):
                    b.text += " "
            else:
                b = Block("doc", "", off + lead, off + len(line))
                blocks.append(b)
            b.pieces.append((len(b.text), off + lead, len(body)))
            b.text, b.end = b.text + body, off + len(line)
    return [b for b in blocks if not _LICENSE.search(b.text)]


_ABBREVIATIONS = re.compile(r"(?:\b(?:e\.g|i\.e|etc|vs|No|Mr|Mrs|Dr|Fig)|\b[A-Z])$")


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Ranges of sentences: none ends inside matched brackets; an unmatched bracket doesn't swallow what follows.

    ASCII ! and ? end a sentence unless a letter, digit or sign follows; a full-width point between digits doesn't.
    """
    match: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for k, c in enumerate(text):
        if c in BRACKETS:
            stack.append((BRACKETS[c], k))
        elif any(c == want for want, _ in stack):
            while stack:
                want, at = stack.pop()
                if want == c:
                    match[at] = k
                    break
    out, start, k, n = [], 0, 0, len(text)
    while k < n:
        c = text[k]
        if k in match:
            k = match[k] + 1
            continue
        k += 1
        if c not in ENDERS:
            continue
        while k < n and text[k] in ENDERS:
            k += 1
        nxt, prv = text[k : k + 1], text[k - 2 : k - 1]
        if c in "!?" and nxt and (nxt.isascii() and (nxt.isalnum() or nxt in "=/&#%_-")):
            continue
        if c == "．" and prv.isdigit() and nxt.isdigit():
            continue
        while k < n and text[k] in "」』）)】〉》”’":
            k += 1
        out.append((start, k))
        start = k
    if text[start:].strip():
        out.append((start, n))
    trimmed = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            trimmed.append((a, b))
    return trimmed


_LABEL_VALUE = re.compile(r"^[^\s。、:：]{1,20}[:：]\s*[^。！？]{1,40}$")
DIRECTIVE = re.compile(r"<!--(.*?)-->", re.S)


def parse_one(source: str, form: str, strings: bool = False) -> tuple[list[Block], bool]:
    """Blocks of one document, and whether it was wrapped in a fence."""
    body = source.removeprefix("\ufeff")
    if form == "markdown":
        blocks, wrapped = markdown(body)
    elif form == "html":
        blocks, wrapped = html(body), False
    elif form.startswith("code:"):
        blocks, wrapped = code(body, form[5:], strings), False
    else:
        blocks, wrapped = plain_text(body), False
    return (_shift(blocks, len(source) - len(body)) if len(source) != len(body) else blocks), wrapped


BLOCKS = "doc_id bigint, block_ix int, kind string, level int, text string, start int, end int, in_quote boolean, in_footnote boolean, n_strong bigint, lead_label string, raw string, line int, marks array<struct<kind:string,start:int,end:int>>, wrapped boolean, sentences array<struct<start:int,end:int,source_start:int,source_end:int,label_value:boolean,line:int>>"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("block_ix", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("in_quote", pa.bool_()), ("in_footnote", pa.bool_()), ("n_strong", pa.int64()), ("lead_label", pa.string()), ("raw", pa.string()), ("line", pa.int32()),
    ("marks", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("wrapped", pa.bool_()),
    ("sentences", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source_start", pa.int32()), ("source_end", pa.int32()), ("label_value", pa.bool_()), ("line", pa.int32())]))),
])


def _label(b: Block) -> str:
    mark = next((m for m in b.marks if m[0] == "strong" and m[1] == len(b.text) - len(b.text.lstrip())), None)
    if mark is None:
        return ""
    label = b.text[mark[1] : mark[2]].rstrip()
    return label if label.endswith((":", "：")) or re.match(r"\s*[:：—―－|｜-]", b.text[mark[2] :]) else ""


def block_rows(doc_id: int, source: str | None, form: str, strings: bool = False) -> list[tuple]:
    """Rows of ``BLOCKS`` of one document."""
    if source is None:
        return []
    blocks, wrapped = parse_one(source, form, strings)
    out, breaks = [], [m.start() for m in re.finditer("\n", source)]
    line = lambda at: bisect_left(breaks, at) + 1
    for k, b in enumerate(blocks):
        cuts = [(x, y, b.source_at(x), b.source_at(y - 1) + 1, bool(_LABEL_VALUE.match(b.text[x:y])), line(b.source_at(x))) for x, y in split_sentences(b.text)]
        out.append((doc_id, k, b.kind, b.level, b.text, b.start, b.end, b.in_quote, b.in_footnote, sum(m[0] == "strong" for m in b.marks), _label(b), source[b.start : b.end], line(b.start), [dict(zip(("kind", "start", "end"), m, strict=True)) for m in b.marks], wrapped, [dict(zip(("start", "end", "source_start", "source_end", "label_value", "line"), c, strict=True)) for c in cuts]))
    return out


def parse(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", format_col: str = "format", strings: bool = False) -> DataFrame:
    """Blocks of all documents, with their sentences nested; ``sentence_table`` unnests them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                rows = [r for d, s, f in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True) for r in block_rows(d, s, f or "plain", strings)]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _SCHEMA]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), F.col(format_col).alias("format")).mapInArrow(run, BLOCKS)


def sentence_table(blocks: DataFrame) -> DataFrame:
    """doc_id, block_ix, ord, text, length, source_start, source_end, label_value and the block's kind and place."""
    from prosemill.functions.text import reading_length

    rows = blocks.select("doc_id", "block_ix", "kind", "in_quote", "in_footnote", F.col("text").alias("block_text"), F.posexplode("sentences").alias("ord", "s"))
    text = F.substring(F.col("block_text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return rows.select("doc_id", "block_ix", "ord", text.alias("text"), reading_length(text).cast("long").alias("length"), "s.source_start", "s.source_end", "s.label_value", "s.line", "kind", "in_quote", "in_footnote")


def directives(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Suppression directives in HTML comments: doc_id, pos, end, line, kind, rules, reason."""
    from prosemill.operators.findings import parse_directive

    kind = "doc_id bigint, pos int, end int, line int, kind string, rules array<string>, reason string"
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("end", pa.int32()), ("line", pa.int32()), ("kind", pa.string()), ("rules", pa.list_(pa.string())), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for m in DIRECTIVE.finditer(s):
                    if got := parse_directive(m.group(1)):
                        line = s.count("\n", 0, m.end() if got[0] == "disable-next-line" else m.start()) + 1
                        rows.append((d, m.start(), m.end(), line, *got))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source")).filter(F.col("source").rlike(r"<!--\s*(?:prosemill|lint)-"))
    return found.mapInArrow(run, kind)
