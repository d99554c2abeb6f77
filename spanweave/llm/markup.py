"""Problem 5: markup residue to clean text that keeps its structure.

Method. Tag-path ratios. A turn is read into leaf nodes, each with its path from the root: its block, the elements
and the inline marks around or in it. Text length and punctuation are summed per path; a path's ratio is text per node,
fused with its punctuation per node, and smoothed over the neighbouring nodes; paths under a threshold relative to the
turn's mean are boilerplate (navigation, banners, scripts) and are dropped unless they carry structure. Headings, list
items, code blocks, table rows and formulas are structure and always stay, in one plain notation: `# ` headings, `- `
and `1. ` items, fenced code, `$` formulas, ` | ` between cells.

The paths' table holds for each path its sums, its ratio, whether it is content, and the kinds of markup (html,
markdown, wiki, latex) its steps are. The clean text is put together from the nodes of content paths; the kinds of a
turn are those of the content paths and of the markup for which a path was dropped, since a banner is markup too.

What stands inside a code block or inline code is content. Operators, names such as __init__, paths, prices,
generics and brackets of code in plain text are no markup.

Defined cases: null text gives no node, no kind and a null clean text; empty text an empty one; an unclosed fence
runs to the end; unclosed tags and commands are removed and count; turns count from 0; repeated rows of a
conversation count once.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kernel of the smoothing and share of the mean ratio under which a path is boilerplate.
KERNEL, LEAST_SHARE = (0.25, 0.5, 0.25), 0.12
#: HTML element names (fixed values).
ELEMENTS = "a abbr address article aside audio b blockquote body br button canvas caption center cite code col dd del details div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript ol option p pre q s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead title tr tt u ul var video"
#: LaTeX commands that occur without braces (fixed values).
COMMANDS = "item hline cdot cdots ldots times leq geq le ge neq approx infty alpha beta gamma delta epsilon lambda mu pi sigma theta omega sum prod int log ln exp sin cos max min noindent newline newpage centering maketitle tableofcontents LaTeX quad qquad to rightarrow leftarrow in partial nabla"
BOILER = frozenset("script style nav footer header aside noscript form button select option head".split())
STRUCTURE = frozenset("heading item code table formula".split())


class Node(NamedTuple):
    path: str
    kinds: frozenset[str]  # html, markdown, wiki, latex: what the steps of the path are
    role: str  # text, heading, item, code, table, formula, rule, mark (markup without any text)
    text: str
    block: int = 0  # nodes of one block of lines share it


class TagPath:
    """What is known of one path of a turn."""

    def __init__(self) -> None:
        self.length = self.punctuation = self.nodes = 0
        self.smooth: list[float] = []
        self.kinds: set[str] = set()
        self.content = True


FENCE = re.compile(r"^[ ]{0,3}(```+|~~~+)[ \t]*([^\n`]*)\n(.*?)(?:^[ ]{0,3}\1[`~]*[ \t]*$\n?|\Z)", re.M | re.S)
PRE = re.compile(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:(?:</code>\s*)?</pre>|\Z)", re.S | re.I)
LISTING = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(.*?)(?:\\end\{\1\}|\Z)", re.S)
WIKICODE = re.compile(r"<(syntaxhighlight|source|nowiki)\b[^>]*>(.*?)(?:</\1>|\Z)", re.S | re.I)
DISPLAY = re.compile(r"\$\$(?=\S)(.+?)\$\$|\\\[(?=[\s\S]*?\\\])(.+?)\\\]|\\begin\{(equation|align|gather|math|displaymath|eqnarray)\*?\}(.+?)\\end\{\3\*?\}", re.S)
INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]*?[^`\n])\1(?!`)")
INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\d$\w])|\\\((?=[^\n]*?\\\))(.+?)\\\)")
MATHLIKE = re.compile(r"[\\^_{}=<>+]|^[A-Za-z]$|^[A-Za-z]\([^)]*\)$")
TAG = re.compile(rf"(?:(?<![\w<])|(?=</?(?:br|hr|img|h[1-6]|li|ul|ol|div|pre|tr|td|th|p)[\s/>])|(?=</))<(/?)({'|'.join(sorted(ELEMENTS.split(), key=len, reverse=True))})((?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))?)*)\s*(/?)>|<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>", re.I | re.S)
CLOSING = re.compile(rf"</({'|'.join(sorted(ELEMENTS.split(), key=len, reverse=True))})\s*>", re.I)
ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][\da-fA-F]{1,6});")
MD_LINK = re.compile(r"(?:(?<![\w)\]])|(?=\[[^\[\]\n]*\]\(\s*<?(?:\w+://|mailto:|[#/])))(!?)\[([^\[\]\n]*)\]\(\s*<?([^()\s<>]*(?:\([^()\s]*\))?[^()\s<>]*)>?(?:\s+[\"'(][^\n]*?[\"')])?\s*\)")
MD_REF = re.compile(r"^[ ]{0,3}\[[^\]\n]+\]:[ \t]+\S+.*$", re.M)
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
STRONG = re.compile(r"(?<![\w*])\*\*(?=[^\s*])([^\n]*?[^\s*])\*\*(?![\w*])|(?<!\w)__(?=[^\s_])([^\n]*?[^\s_])__(?!\w)|(?<!~)~~(?=\S)([^\n]*?\S)~~(?!~)")
EMPH = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]*?[^\s_])_(?![\w_])")
WIKI_LINK = re.compile(r"\[\[(?=[^\d\[\]\s'\"-])([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
WIKI_EXT = re.compile(r"(?<!\[)\[(https?://[^\s\]]+)(?:\s+([^\]\n]*))?\](?!\()")
WIKI_TEMPLATE = re.compile(r"\{\{(?=[A-Za-z#])([^{}|\n:]+(?::[^{}|\n]*)?)((?:\|[^{}\n]*)?)\}\}")
WIKI_BOLD = re.compile(r"(?<!')('{2,5})(?=[^'\s])([^\n]*?[^'\s])\1(?!')")
WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n].*?[^=\n]|[^=\n])[ \t]*\1[ \t]*$")
WIKI_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}[^\n]*$|\Z)", re.M | re.S)
LATEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|paragraph|title)\*?\{([^{}\n]*)\}")
LATEX_CMD = re.compile(rf"(?<![\w:\\])\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}|(?<![\w:\\])\\({'|'.join(COMMANDS.split())})(?![A-Za-z\\])")
LATEX_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
MD_HEAD = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
MD_ITEM = re.compile(r"^([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+(?=\S)(.*)$")
INDENTED = re.compile(r"[ ]{4}|\t")
MD_SETEXT = re.compile(r"^[ ]{0,3}(=+|-{2,})[ \t]*$")
WIKI_ITEM = re.compile(r"^(\*+)[ \t]+(?=\S)(.*)$")
MD_QUOTE = re.compile(r"^[ ]{0,3}>[ \t]?(.*)$")
MD_RULE = re.compile(r"^[ ]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
MD_DELIM = re.compile(r"^[ ]{0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
HOLD_A, HOLD_B = "\ue000", "\ue001"


#: What a text must hold for a pattern to be tried at all.
TRIGGERS = {
    FENCE: ('```', '~~~',),
    PRE: ('<',),
    WIKICODE: ('<',),
    LISTING: ('\\begin',),
    INLINE_CODE: ('`',),
    DISPLAY: ('$$', '\\[', '\\begin',),
    INLINE_MATH: ('$', '\\(',),
    WIKI_TABLE: ('{|',),
}


def _sub(pattern: re.Pattern, t: str, to: str | Callable) -> str:
    return pattern.sub(to, t) if any(x in t for x in TRIGGERS[pattern]) else t


class Reader:
    """Reads one text into nodes. Content that must not be read as markup (code, formulas) is put aside first."""

    def __init__(self, text: str):
        self.nodes: list[Node] = []
        self.kinds: set[str] = set()  # met since the last node
        self.held: list[tuple[str, str, str, bool]] = []  # kind, role, text, is a block
        self.block = 0
        self.read(text)

    def hold(self, kind: str, role: str, text: str, block: bool) -> str:
        self.held.append((kind, role, text, block))
        mark = f"{HOLD_A}{len(self.held) - 1}{HOLD_B}"
        return f"\n{mark}\n" if block else mark

    def read(self, text: str) -> None:
        t = text.replace("\r\n", "\n").replace(HOLD_A, "").replace(HOLD_B, "")
        t = _sub(FENCE, t, lambda m: self.hold("markdown", "code", m.group(3).rstrip("\n"), True))
        t = _sub(PRE, t, lambda m: self.hold("html", "code", html.unescape(re.sub(r"</?code\b[^>]*>", "", m.group(1))).strip("\n"), True))
        t = _sub(WIKICODE, t, lambda m: self.hold("wiki", "code", m.group(2).strip("\n"), True))
        t = _sub(LISTING, t, lambda m: self.hold("latex", "code", m.group(2).strip("\n"), True))
        t = _sub(INLINE_CODE, t, lambda m: self.hold("markdown", "inline", m.group(2), False))
        t = _sub(DISPLAY, t, lambda m: self.hold("latex", "formula", (m.group(1) or m.group(2) or m.group(4)).strip(), "\n" in t[max(0, m.start() - 1) : m.start()]))
        t = _sub(INLINE_MATH, t, lambda m: self.hold("latex", "formula", m.group(1) or m.group(2), False) if m.group(2) or MATHLIKE.search(m.group(1)) else m.group())
        t = _sub(WIKI_TABLE, t, self.wiki_table)
        t = MD_REF.sub(lambda m: self.mark("root/ref", "markdown"), t)
        lines = t.split("\n")
        i = 0
        para: list[str] = []

        def flush() -> None:
            if para:
                self.inline("root/p", "text", "\n".join(para))
                para.clear()

        while i < len(lines):
            line = lines[i]
            held = HOLD_A in line and re.fullmatch(rf"\s*{HOLD_A}(\d+){HOLD_B}\s*", line)
            if held and self.held[int(held.group(1))][1] in ("code", "table", "formula") and self.held[int(held.group(1))][3]:
                flush()
                kind, role, body, _ = self.held[int(held.group(1))]
                self.nodes.append(Node(f"root/{role}", frozenset((kind,)), role, body, i + 1))
            elif not line.strip():
                flush()
            elif (m := WIKI_HEAD.match(line)) and len(m.group(1)) >= 2:
                flush()
                self.inline("root/h", "heading", m.group(2), "wiki", len(m.group(1)) - 1)
            elif m := MD_HEAD.match(line):
                flush()
                self.inline("root/h", "heading", m.group(2), "markdown", len(m.group(1)))
            elif para and len(para) == 1 and (m := MD_SETEXT.match(line)) and not INDENTED.match(para[0]):
                title = para.pop()
                self.inline("root/h", "heading", title, "markdown", 1 if m.group(1)[0] == "=" else 2)
            elif MD_RULE.match(line):
                flush()
                self.nodes.append(Node("root/hr", frozenset(("markdown",)), "rule", ""))
            elif "|" in line and i + 1 < len(lines) and "|" in lines[i + 1] and MD_DELIM.match(lines[i + 1]):
                flush()
                self.mark("root/table", "markdown")
                j = i
                while j < len(lines) and "|" in lines[j] and lines[j].strip():
                    if j != i + 1:
                        cells = [c.strip() for c in lines[j].strip().strip("|").split("|")]
                        self.inline("root/table/tr", "table", " | ".join(cells), "markdown")
                    j += 1
                i = j
                continue
            elif line[:1] == "*" and (end := self.wiki_list(lines, i)) > i:
                flush()
                for item in lines[i:end]:
                    m = WIKI_ITEM.match(item)
                    self.inline("root/ul/li", "item", m.group(2), "wiki", "  " * (len(m.group(1)) - 1) + "-")
                i = end
                continue
            elif m := MD_ITEM.match(line):
                flush()
                mark = m.group(2)
                self.inline("root/ul/li" if mark in "-*+" else "root/ol/li", "item", m.group(3), "markdown", mark if mark[0].isdigit() else "-")
            elif m := MD_QUOTE.match(line):
                flush()
                self.inline("root/quote", "text", m.group(1), "markdown")
            else:
                para.append(line)
            i += 1
        flush()

    @staticmethod
    def wiki_list(lines: list[str], i: int) -> int:
        """The end of a list from line `i` on whose deeper items have several asterisks; `i` if it is no such list."""
        end = i
        while end < len(lines) and WIKI_ITEM.match(lines[end]):
            end += 1
        return end if any(x.startswith("**") for x in lines[i:end]) else i

    def wiki_table(self, m: re.Match) -> str:
        rows, row = [], []
        for line in m.group().split("\n")[1:]:
            s = line.strip()
            if s.startswith("|-") or s.startswith("|}"):
                if row:
                    rows.append(" | ".join(row))
                row = []
            elif s[:1] in "|!" and s:
                row += [c.rpartition("|")[2].strip() if "=" in c.partition("|")[0] else c.strip() for c in re.split(r"\|\||!!", s[1:])]
        if row:
            rows.append(" | ".join(row))
        return self.hold("wiki", "table", "\n".join(rows), True)

    def mark(self, path: str, kind: str) -> str:
        """Notes markup that leaves no text."""
        self.nodes.append(Node(path, frozenset((kind,)), "mark", ""))
        return ""

    def plain(self, t: str) -> str:
        """Inline text without marks; notes the kinds met."""
        def tag(m: re.Match) -> str:
            self.kinds.add("html")
            name = (m.group(2) or "").lower()
            return "\n" if name in ("br", "p", "div", "li", "ul", "ol", "tr", "hr") or re.fullmatch(r"h[1-6]", name) else ""

        def link(m: re.Match) -> str:
            self.kinds.add("markdown")
            return m.group(2)

        def strong(m: re.Match) -> str:
            inner = next(g for g in m.groups() if g is not None)
            if m.group().startswith("__") and re.fullmatch(r"\w+", inner):
                return m.group()  # a name such as __init__
            self.kinds.add("markdown")
            return inner

        def wiki(m: re.Match, inner: str) -> str:
            self.kinds.add("wiki")
            return inner

        def command(m: re.Match) -> str:
            self.kinds.add("latex")
            return m.group(2) or ""

        # a pattern is tried only where its sign occurs
        if "\\" in t:
            t = LATEX_HEAD.sub(lambda m: (self.kinds.add("latex"), m.group(1))[1], t)
            t = LATEX_ENV.sub(lambda m: (self.kinds.add("latex"), "")[1], t)
            for _ in range(3):
                t = LATEX_CMD.sub(command, t)
        if "{{" in t:
            t = WIKI_TEMPLATE.sub(lambda m: wiki(m, ": ".join(x for x in (m.group(1).strip(), m.group(2).strip("|").strip()) if x)), t)
        if "[" in t:
            t = WIKI_LINK.sub(lambda m: wiki(m, m.group(2) or m.group(1)), t)
            t = MD_LINK.sub(link, t)
            t = WIKI_EXT.sub(lambda m: wiki(m, m.group(2) or m.group(1)), t)
        if "<" in t:
            t = AUTOLINK.sub(lambda m: (self.kinds.add("markdown"), m.group(1))[1], t)
            t = TAG.sub(tag, t)
            t = CLOSING.sub(lambda m: tag(re.match(r"(<)(/?\w*)", m.group())), t)
        if "''" in t:
            t = WIKI_BOLD.sub(lambda m: wiki(m, m.group(2)), t)
        if "**" in t or "__" in t or "~~" in t:
            t = STRONG.sub(strong, t)
        if "*" in t or "_" in t:
            t = EMPH.sub(strong, t)
        if "&" in t:
            t = ENTITY.sub(lambda m: (self.kinds.add("html"), html.unescape(m.group()).replace("\xa0", " "))[1] if html.unescape(m.group()) != m.group() else m.group(), t)
        return t

    def restore(self, t: str) -> str:
        if HOLD_A not in t:
            return t

        def back(m: re.Match) -> str:
            kind, role, body, _ = self.held[int(m.group(1))]
            self.kinds.add(kind)
            return f"${body}$" if role == "formula" else body

        return re.sub(rf"{HOLD_A}(\d+){HOLD_B}", back, t)

    def inline(self, path: str, role: str, t: str, kind: str = "", level: int | str = 0) -> None:
        """A block's leaf nodes: HTML elements inside it open deeper paths."""
        self.kinds.clear()
        self.block += 1
        open_tags: list[str] = []
        at = 0
        pieces: list[tuple[str, str]] = []
        for m in TAG.finditer(t) if "<" in t else ():
            if m.start() > at:
                pieces.append(("/".join(open_tags), t[at : m.start()]))
            name = (m.group(2) or "").lower()
            if name:
                if m.group(1):
                    while open_tags and name in open_tags and open_tags.pop() != name:
                        pass
                elif name not in ("br", "hr", "img", "input", "meta", "link", "col", "embed") and not m.group(4):
                    open_tags.append(name)
                if name in ("br", "hr", "p", "div", "li", "tr", "ul", "ol") or re.fullmatch(r"h[1-6]", name):
                    pieces.append(("/".join(open_tags), "\n"))
            self.kinds.add("html")
            at = m.end()
        pieces.append(("/".join(open_tags), t[at:]))
        mark = "" if role not in ("heading", "item") else ("#" * int(level or 1) + " " if role == "heading" else f"{level} ")
        for tags, piece in pieces:
            head = "\\" in piece and bool(LATEX_HEAD.search(piece))
            for part in re.split(r"(?=\\item\b)|(?=\\(?:sub)*section\*?\{)|(?=\n)", piece) if "\\" in piece or tags else [piece]:
                inner_role = role
                inner_mark = mark
                h = tags and re.search(r"(?:^|/)h([1-6])(?:/|$)", tags)
                if h:
                    inner_role, inner_mark = "heading", "#" * int(h.group(1)) + " "
                elif tags and re.search(r"(?:^|/)li(?:/|$)", tags) and part.strip():
                    inner_role, inner_mark = "item", "- "
                elif "\\item" in part:
                    inner_role, inner_mark = "item", "- "
                elif head and (m := LATEX_HEAD.search(part)):
                    before, after = part[: m.start()], part[m.end() :]
                    self.leaf(path, tags, kind, role, mark, before)
                    self.leaf(path + "/section", tags, "latex", "heading", "# ", m.group(1))
                    part = after
                self.leaf(path, tags, kind or ("html" if tags else ""), inner_role, inner_mark, part)
                mark = "" if part.strip() else mark
        for k in self.kinds:  # of an element that closes or stands without text after it
            self.mark(path, k)
        self.kinds.clear()

    def leaf(self, path: str, tags: str, kind: str, role: str, mark: str, t: str) -> None:
        plain = self.restore(self.plain(t))
        if kind:
            self.kinds.add(kind)
        if plain:
            steps = "/".join((path, *([tags] if tags else []), *sorted(self.kinds - {"html"})))
            self.nodes.append(Node(steps, frozenset(self.kinds), role, mark + plain.strip() if mark and plain.strip() else plain, -self.block))
            self.kinds.clear()


def tag_paths(nodes: list[Node]) -> dict[str, TagPath]:
    """The paths of a turn, and which are content: fused, smoothed text and punctuation per path against the mean of the
    turn's text. Structure nodes, one each however long, enter neither sums, smoothing nor mean, and stay content."""
    table: dict[str, TagPath] = {}
    for n in nodes:
        p = table.setdefault(n.path, TagPath())
        p.kinds |= n.kinds
        if BOILER & set(n.path.split("/")):
            p.content = False
    texts = [n for n in nodes if n.role not in STRUCTURE and n.text.strip() and table[n.path].content]
    if not texts:
        return table
    for n in texts:
        p = table[n.path]
        p.length += len(n.text.strip())
        p.punctuation += len(re.findall(r"[.,;:!?。、！？]", n.text))
        p.nodes += 1
    fused = [p.length / p.nodes * math.log(2.0 + p.punctuation / p.nodes) for p in (table[n.path] for n in texts)]
    smooth = []
    for i, n in enumerate(texts):
        window = [(w, fused[i + d]) for d, w in zip((-1, 0, 1), KERNEL) if 0 <= i + d < len(texts)]
        smooth.append(sum(w * v for w, v in window) / sum(w for w, _ in window))
        table[n.path].smooth.append(smooth[-1])
    least = LEAST_SHARE * sum(smooth) / len(smooth)
    for p in table.values():
        if p.smooth and sum(p.smooth) / len(p.smooth) < least:
            p.content = False
    return table


def content_nodes(nodes: list[Node], table: dict[str, TagPath]) -> list[Node]:
    """The nodes of content paths, and structure outside boilerplate elements."""
    return [n for n in nodes if n.role != "mark" and (table[n.path].content or (n.role in STRUCTURE or not n.text.strip()) and not BOILER & set(n.path.split("/")))]


def read_turn(text: str | None) -> tuple[list[str], str | None]:
    """The kinds of markup of a text, in order of name, and its clean text, both from the table of its tag paths."""
    if not text:
        return [], text
    nodes = Reader(text).nodes
    table = tag_paths(nodes)
    return sorted({k for p in table.values() for k in p.kinds}), _joined(content_nodes(nodes, table))


def clean_text(text: str | None) -> str | None:
    return read_turn(text)[1]


def markup_kinds(text: str | None) -> list[str]:
    return read_turn(text)[0]


def _joined(nodes: list[Node]) -> str:
    out: list[str] = []
    last, block_no = "", 0
    for n in nodes:
        block = n.role in STRUCTURE or n.role == "rule"
        s = {"code": f"```\n{n.text}\n```", "formula": f"$${n.text}$$" if n.path == "root/formula" else n.text, "rule": ""}.get(n.role, n.text)
        if out and (block or block_no != n.block or last in STRUCTURE):
            out.append("\n" if n.role == "item" and last == "item" or n.role == "table" and last == "table" else "\n\n")
        out.append(s)
        last, block_no = n.role if block else "text", n.block
    t = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def turns(conversations: DataFrame) -> DataFrame:
    """(conversation_id, turn, user, assistant); repeated rows of a conversation once."""
    c = conversations.select("conversation_id", "history").where(F.col("history").isNotNull() & (F.size("history") > 0))
    t = c.select("conversation_id", F.posexplode("history").alias("turn", "h")).where("h is not null")
    t = t.select("conversation_id", F.col("turn").cast("long").alias("turn"), F.col("h.user").alias("user"), F.col("h.assistant").alias("assistant"))
    return t.groupBy("conversation_id", "turn").agg(F.min(F.struct("user", "assistant")).alias("x")).select("conversation_id", "turn", "x.user", "x.assistant")


def cleaned(conversations: DataFrame) -> DataFrame:
    """(conversation_id, turn, kinds, text) of every turn: its kinds of markup and its clean text."""
    src = turns(conversations).select("conversation_id", "turn", "assistant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read_turn(t) for t in b.column("assistant").to_pylist()]
            cols = [b.column("conversation_id"), b.column("turn"), pa.array([k for k, _ in got], pa.list_(pa.string())), pa.array([t for _, t in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["conversation_id", "turn", "kinds", "text"])

    return src.mapInArrow(run, "conversation_id string, turn long, kinds array<string>, text string")


def found(conversations: DataFrame) -> DataFrame:
    """(conversation_id, turn, markup), one row per turn and kind."""
    return cleaned(conversations).select("conversation_id", "turn", F.explode("kinds").alias("markup"))
