"""Problem 2: flag source files that their language does not accept.

Method. A lexer per language (one regular expression each, and a mode stack for nested literals) feeds a pushdown
automaton. It reports unterminated literals, unbalanced delimiters, premature ends, conflict markers that stand in
code, characters no token starts with, and tokens that cannot meet: prose or another language under a wrong extension,
a missing operand, operator, comma, colon or word. For Python it follows statements, blocks and expressions, for JSON
and TOML the whole grammar with TOML's rules on keys defined twice, for TypeScript the statements and neighbours that
need no knowledge of types. For Python, JSON and TOML an exact check by the interpreter's own parser follows for the
files so flagged and drops false alarms; it flags none. TypeScript has no parser here; the automaton decides alone.

Not found are faults that need more than a stack: names and arguments used twice, assignments to what cannot be
assigned to, statements outside their function or loop.

Defined cases: a file is its chunks by `chunk_index` (null last, then id), each id once, joined by a line feed;
null texts of chunks are empty; files of other extensions and null paths come out nowhere; an empty file is
accepted by Python, TypeScript and TOML and not by JSON; a byte-order mark at the start is accepted by Python
and TypeScript only; repeated rows count once.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = {"py": "python", "ts": "typescript", "json": "json", "toml": "toml"}
OPEN, CLOSE = "([{", {")": "(", "]": "[", "}": "{"}
CONFLICT = re.compile(r"(?:<{7} |>{7} |\|{7} |={7}$)", re.M)
Defect = tuple[str, int]


class Stop(Exception):
    """A defect at a position ends the scan."""

    def __init__(self, kind: str, at: int):
        self.defect = (kind, at)


# --------------------------------------------------------------------------------------------------- Python
PY_TOKEN = re.compile(
    r"""(?:[ \t\f]+|\\\r?\n|\#[^\n]*)*+
      (?:(?P<nl>\r?\n|\r)
      |(?P<str>(?:[rRbBuUfFtT]{1,2})?(?:'''|\"\"\"|'|\"))
      |(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?)[jJ]?)
      |(?P<name>[^\W\d]\w*)
      |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[-+*/%@&|^=<>!]=|\*\*|//|>>|<<|[-+*/%@&|^~<>=.,:;])
      |(?P<open>[\(\[\{])|(?P<close>[\)\]\}])
      |(?P<end>\Z))""",
    re.X,
)
PY_LEAD = re.compile(r"[ \t\f]*")
PY_WORDS = frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
PY_SOFT = frozenset(("match", "case", "type"))
PY_BLOCK = frozenset("class def elif else except finally for if try while with".split())
#: Words that begin a statement and are no part of an expression; signs that assign to what they change.
PY_STATEMENT = PY_WORDS - {"await", "yield", "lambda", "not"}
PY_AUGMENTED = frozenset("+= -= *= /= //= %= **= @= &= |= ^= <<= >>=".split())


def _py_string(text: str, at: int, quote: str, raw: bool) -> int:
    """The end of a literal that starts after its opening quote at `at`."""
    i, n, k = at, len(text), len(quote)
    while True:
        j = text.find(quote, i)
        b = text.find("\\", i, j if j >= 0 else n)
        if k == 1:
            e = text.find("\n", i, b if b >= 0 else (j if j >= 0 else n))
            if e >= 0:
                raise Stop("unterminated literal", at - 1)
        if b >= 0:
            i = b + 2
            continue
        if j < 0:
            raise Stop("unterminated literal", at - k)
        return j + k


PY_F_NEXT = {"text": re.compile(r"[\\{}'\"\n]"), "spec": re.compile(r"[\\{}'\"\n]"), "expr": re.compile(r"[\[\](){}:'\"]"), "bracket": re.compile(r"[\[\](){}'\"]")}


def _py_fstring(text: str, at: int, quote: str) -> int:
    """The end of a formatted literal that starts after its opening quote at `at`: a stack of what the reader is in, the
    text, a replacement field's expression, brackets in it, or its format."""
    stack, i, n = ["text"], at, len(text)
    while True:
        m = PY_F_NEXT[stack[-1]].search(text, i)
        if not m:
            raise Stop("unterminated literal", at - len(quote))
        c, i = m.group(), m.end()
        if stack[-1] in ("text", "spec"):
            if c == "\\":
                if text.startswith("N{", i) and "}" in text[i:]:
                    i = text.index("}", i) + 1
                else:
                    i += text[i : i + 1] not in ("{", "}")
            elif c == "{":
                if stack[-1] == "text" and text.startswith("{", i):
                    i += 1
                else:
                    stack.append("expr")
            elif c == "}":
                if stack[-1] == "spec":
                    del stack[-2:]
                elif text.startswith("}", i):
                    i += 1
                else:
                    raise Stop("unbalanced delimiter", i - 1)
            elif c == "\n":
                if len(quote) == 1:
                    raise Stop("unterminated literal", at - 1)
            elif text.startswith(quote, i - 1):
                if len(stack) > 1:
                    raise Stop("unbalanced delimiter", i - 1)
                return i - 1 + len(quote)
        elif c in "'\"":
            inner = c * 3 if text.startswith(c * 3, i - 1) else c
            start = i - 1
            i = start + len(inner)
            f = re.search(r"(?<!\w)[rR]?[fF][rR]?$", text[max(0, start - 3) : start])
            i = _py_fstring(text, i, inner) if f else _py_string(text, i, inner, False)
        elif c in OPEN:
            stack.append("bracket")
        elif c == ":":
            stack.append("spec")
        elif c == "}" and stack[-1] == "expr":
            if text[i - 2] == "{":  # nothing in the field
                raise Stop("tokens that cannot meet", i - 1)
            stack.pop()
        elif stack[-1] == "bracket":
            stack.pop()
        else:
            raise Stop("unbalanced delimiter", i - 1)


class _Frame:
    """A bracket, a lambda's parameters, or the statement itself at the bottom of the stack."""

    __slots__ = ("opener", "at", "kind", "ternary", "comp", "targets", "fresh")

    def __init__(self, opener: str, at: int, kind: str):
        self.opener, self.at, self.kind = opener, at, kind
        self.ternary = 0  # conditionals that lack their else
        self.comp = self.targets = False  # in a comprehension; in targets that lack their `in`
        self.fresh = True  # nothing inside yet


class _Python:
    """A pushdown automaton over tokens. `want` says whether an operand must come or one has just ended; what a sign or
    word may do depends on that, on the frame on top of the stack and on the word the statement began with. Blocks are
    kept by indentation with the last compound statement of each level."""

    def __init__(self, text: str):
        self.t, self.n = text, len(text)
        self.indents, self.last = [0], [""]
        self.need_block = self.decorated = False
        self.begin()

    def begin(self, inline: bool = False) -> None:
        self.stack = [_Frame("", 0, "statement")]
        self.want, self.first, self.prev, self.kind = True, "", "", ""
        self.assigned = self.annotated = self.bare_end = False
        self.attr, self.need = False, ""  # a name must follow; this very token must
        self.block_open = self.soft = False  # after a block's colon; a soft keyword is used as one
        self.inline = inline

    def run(self) -> None:
        t, n, i, line_start = self.t, self.n, 0, True
        while i < n:
            if line_start and len(self.stack) == 1:
                m = PY_LEAD.match(t, i)
                j = m.end()
                if j < n and t[j] not in "#\r\n":
                    self.line(i, len(m.group().expandtabs(8)))
                i, line_start = j, False
                continue
            line_start = False
            m = PY_TOKEN.match(t, i)
            if not m:
                raise Stop("foreign character", i)
            kind = m.lastgroup
            tok, at, i = m.group(kind), m.start(kind), m.end()
            if kind == "end":
                break
            if kind == "nl":
                if len(self.stack) == 1:
                    line_start = True
                    self.end(at)
                elif CONFLICT.match(t, i):
                    raise Stop("conflict marker", i)
                continue
            if kind == "str":
                quote = tok.lstrip("rRbBuUfFtT")
                start, i = i, _py_fstring(t, i, quote) if "f" in tok.lower() else _py_string(t, i, quote, "r" in tok.lower())
                if "b" in tok.lower() and not t[start:i].isascii():
                    raise Stop("foreign character", at)
            self.token(kind, tok, at)
        if len(self.stack) > 1:
            raise Stop("unbalanced delimiter", self.stack[-1].at)
        self.end(n)
        if self.need_block or self.decorated or "try" in self.last:
            raise Stop("premature end", n)

    def line(self, at: int, lead: int) -> None:
        if CONFLICT.match(self.t, at):
            raise Stop("conflict marker", at)
        if self.need_block and lead <= self.indents[-1]:
            raise Stop("missing block", at)
        if lead > self.indents[-1]:
            if not self.need_block:
                raise Stop("unexpected indent", at)
            self.indents.append(lead)
            self.last.append("")
        while lead < self.indents[-1]:
            self.indents.pop()
            if self.last.pop() == "try":
                raise Stop("premature end", at)
        if lead != self.indents[-1]:
            raise Stop("indentation", at)
        self.need_block = False
        self.begin()

    def end(self, at: int) -> None:
        """The end of a statement."""
        if self.block_open:
            self.need_block, self.block_open, self.first = True, False, ""
        if not self.first:
            return
        f = self.stack[0]
        if self.need not in ("", ";") or self.attr or f.ternary or f.targets:
            raise Stop("premature end", at)
        if self.first in PY_BLOCK or self.first == "from" and not self.assigned:
            raise Stop("premature end", at)
        if self.want and not self.bare_end and (self.prev != "," or self.first in ("import", "from", "assert", "global", "nonlocal", "raise")):
            raise Stop("premature end", at)
        self.first = ""

    def opening(self, kind: str, tok: str, at: int) -> None:
        """The first token of a statement."""
        self.first = tok if kind == "name" else kind
        if self.decorated and tok not in ("@", "def", "class", "async"):
            self.fail(at)
        self.decorated = tok == "@"
        if kind != "name" or tok not in PY_WORDS:
            if not self.inline:
                self.follow(tok if tok in PY_SOFT else "", at)
            return
        if tok in PY_BLOCK or tok == "async":
            if self.inline:
                raise Stop("tokens that cannot meet", at)
            self.follow(tok, at)
        elif not self.inline:
            self.follow("", at)
        if tok in ("try", "else", "finally"):
            self.need = ":"
        elif tok in ("pass", "break", "continue"):
            self.need, self.want = ";", False
        elif tok in ("return", "raise"):
            self.bare_end = True
        elif tok == "for":
            self.stack[0].targets = True
        elif tok in ("def", "class"):
            self.attr = True
        elif tok == "async":
            self.need = "async"

    def follow(self, tok: str, at: int) -> None:
        """Whether the statement may follow the last one of its level."""
        last = self.last[-1]
        if tok in ("elif", "else", "except", "finally"):
            fine = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "else of try")}[tok]
            if last not in fine:
                raise Stop("tokens that cannot meet", at)
            tok = "else of try" if tok == "else" and last == "except" else tok
        elif last == "try":
            raise Stop("premature end", at)
        self.last[-1] = tok

    def fail(self, at: int) -> None:
        raise Stop("tokens that cannot meet", at)

    def token(self, kind: str, tok: str, at: int) -> None:
        if self.block_open:
            self.begin(True)
        f = self.stack[-1]
        if not self.first:
            self.opening(kind, tok, at)
            if kind == "name" and tok in PY_STATEMENT or tok == "@":
                self.prev, self.kind = tok, "word"
                return
        elif self.need:
            self.needed(tok, at)
            return
        if self.attr:
            if kind == "name" and tok not in PY_WORDS:
                self.attr, self.want = False, False
            else:
                self.fail(at)
        elif self.first in ("import", "from") and f.kind in ("statement", "names") and kind != "str":
            self.importing(kind, tok, at, f)
            return
        elif f.kind == "lambda":
            self.in_lambda(kind, tok, at, f)
            return
        elif kind in ("num", "str") or kind == "name" and tok not in PY_WORDS or tok == "...":
            self.operand(kind, tok, at)
        elif kind == "open":
            self.open(tok, at, f)
            return
        elif kind == "close":
            self.close(tok, at, f)
            self.kind = "close"
            self.prev = tok
            return
        elif kind == "name":
            self.word(tok, at, f)
        else:
            self.sign(tok, at, f)
        f.fresh = False
        if tok != "yield":
            self.bare_end = False
        if tok != ";":
            self.prev, self.kind = tok, kind

    def needed(self, tok: str, at: int) -> None:
        if self.need == "async":
            if tok not in ("def", "for", "with"):
                self.fail(at)
            self.need, self.first = "", tok
            self.last[-1] = tok
            self.attr = tok == "def"
            self.stack[0].targets = tok == "for"
            self.prev, self.kind = tok, "word"
        elif self.need == tok == ":":
            self.need, self.block_open = "", True
        elif self.need == tok == ";":
            self.end(at)
            self.begin(True)
        elif self.need == tok:
            self.need, self.want, self.prev, self.kind = "", True, tok, "op"
        else:
            self.fail(at)

    def operand(self, kind: str, tok: str, at: int) -> None:
        if self.want:
            self.want = False
        elif kind == "str" and self.kind == "str":
            pass
        elif self.prev in PY_SOFT and self.prev == self.first and len(self.stack) == 1 and not self.soft:
            self.soft = True
        else:
            self.fail(at)

    def open(self, tok: str, at: int, f: _Frame) -> None:
        f.fresh = False
        if self.want or self.prev == self.first and self.prev in ("match", "case"):
            kind = {"(": "group", "[": "list", "{": "dict"}[tok]
        elif tok == "{":
            self.fail(at)
        elif tok == "(":
            kind = "params" if self.first == "def" and len(self.stack) == 1 and not self.assigned else "call"
            self.assigned = self.assigned or kind == "params"
        else:
            kind = "index"
        self.stack.append(_Frame(tok, at, kind))
        self.want, self.prev, self.kind = True, tok, "open"

    def close(self, tok: str, at: int, f: _Frame) -> None:
        if f.opener != CLOSE[tok]:
            raise Stop("unbalanced delimiter", at)
        if f.ternary or f.targets or self.attr:
            self.fail(at)
        if self.want:
            empty = f.fresh and f.kind != "index"
            if not (empty or self.prev == "," and not f.comp or self.prev == ":" and f.kind == "index" or self.prev in ("yield", "/")):
                self.fail(at)
        self.stack.pop()
        self.want = False

    def word(self, tok: str, at: int, f: _Frame) -> None:
        have = not self.want
        if tok == "not":
            if have:
                self.need = "in"
        elif tok == "in":
            if have or f.targets and self.prev == ",":
                f.targets, self.want = False, True
            else:
                self.fail(at)
        elif tok in ("and", "or", "is"):
            if not have:
                self.fail(at)
            self.want = True
        elif tok == "if":
            if not have or f.targets:
                self.fail(at)
            f.ternary += not f.comp and not (self.first == "case" and len(self.stack) == 1)
            self.want = True
        elif tok == "else":
            if not have or not f.ternary and not f.comp:
                self.fail(at)
            f.ternary -= f.ternary > 0
            self.want = True
        elif tok == "for" or tok == "async":
            if tok == "for" and self.prev == "async":
                have = True
            if not have or f.kind not in ("group", "call", "list", "dict") or f.ternary or f.targets:
                self.fail(at)
            if tok == "for":
                f.comp = f.targets = True
            else:
                self.need = ""
            self.want = True
        elif tok == "lambda":
            if have:
                self.fail(at)
            self.stack.append(_Frame("lambda", at, "lambda"))
        elif tok == "await":
            if have:
                self.fail(at)
        elif tok == "yield":
            if have:
                self.fail(at)
            self.bare_end = self.bare_end or len(self.stack) == 1
        elif tok == "from":
            if self.prev != "yield" and not (self.first == "raise" and have and len(self.stack) == 1):
                self.fail(at)
            self.want, self.bare_end = True, False
        elif tok == "as":
            if not have or self.first not in ("with", "except", "case") and f.kind != "names":
                self.fail(at)
            self.want = True
        else:
            self.fail(at)

    def sign(self, tok: str, at: int, f: _Frame) -> None:
        have = not self.want
        if tok == ".":
            if not have:
                self.fail(at)
            self.attr = True
        elif tok == ",":
            fine = have or self.prev == ":" and f.kind == "index" or f.kind == "params" and self.prev in ("*", "/") or self.prev == "yield"
            if not fine or f.ternary or len(self.stack) == 1 and self.first in ("except", "while", "elif", "if", "class", "def"):
                self.fail(at)
            self.want = True
        elif tok == ":":
            if len(self.stack) == 1:
                if f.targets or f.ternary or not have and not (self.first == "except" and self.prev == "except" or self.prev == "," and self.first in ("for", "match", "case")):
                    self.fail(at)
                soft = self.first == "case" and self.prev != "case" or self.first == "match" and not self.assigned and (self.soft or re.match(r"[ \t]*(?:#|\r|\n|\Z)", self.t[at + 1 : at + 400]))
                if self.first in PY_BLOCK or soft:
                    if self.first == "def" and not self.assigned:
                        self.fail(at)
                    self.block_open = True
                    return
                if self.annotated or self.assigned or self.first in PY_WORDS:
                    self.fail(at)
                self.annotated = self.want = True
            elif f.kind == "index" or f.kind in ("dict", "params") and have and not f.ternary:
                self.want = True
            else:
                self.fail(at)
        elif tok == "=":
            fine = f.kind == "params" or f.kind == "call" and self.kind == "name" or f.kind == "index" and self.first in ("def", "class", "type") or len(self.stack) == 1 and self.first not in PY_WORDS - {"await", "yield", "lambda", "not"} or f.kind == "call" and self.first == "case"
            if not have and not (self.prev == "," and len(self.stack) == 1) or not fine or f.ternary:
                self.fail(at)
            self.want, self.bare_end = True, False
            self.assigned = self.assigned or len(self.stack) == 1
        elif tok == ":=":
            if not have or self.kind != "name" or len(self.stack) == 1 and self.first not in ("if", "while", "elif"):
                self.fail(at)
            self.want = True
        elif tok in PY_AUGMENTED:
            if not have or len(self.stack) > 1 or self.assigned or self.annotated or self.first in PY_WORDS:
                self.fail(at)
            self.want = self.assigned = True
        elif tok == "->":
            if not have or len(self.stack) > 1 or self.first != "def" or self.prev != ")":
                self.fail(at)
            self.want = True
        elif tok == ";":
            if len(self.stack) > 1:
                self.fail(at)
            self.end(at)
            self.begin(True)
        elif have:
            if tok == "~" or tok == "!":
                self.fail(at)
            self.want = True
            self.bare_end = False
        elif tok in ("+", "-", "~"):
            pass
        elif tok in ("*", "**"):
            unpack = f.kind in ("call", "params") or tok == "*" and f.kind in ("list", "group", "index", "statement", "dict") or tok == "**" and f.kind == "dict"
            if not unpack or self.prev not in ("(", "[", "{", ",", "", "=", "return", "yield", "in", "for", "except", "case", "del", "match", ":"):
                self.fail(at)
        elif tok == "/" and f.kind == "params":
            pass
        else:
            self.fail(at)

    def importing(self, kind: str, tok: str, at: int, f: _Frame) -> None:
        """`import a.b as c, d`; `from ..a import (b as c, d)`."""
        state = self.prev
        if tok == ";" and len(self.stack) == 1:
            self.end(at)
            self.begin(True)
            return
        name = kind == "name" and tok not in PY_WORDS
        if state == "import" and self.first == "from":
            fine = name or tok in ("(", "*")
        elif state in ("import", ",", "as", "("):
            fine = name or state == "," and tok == ")"
        elif state in ("from", ".", "..."):
            fine = name or self.first == "from" and not self.annotated and (tok in (".", "...") or tok == "import" and state != "from")
        elif state == "*" or state == ")":
            fine = False
        else:  # after a name
            fine = tok in (".", ",", "as") or tok == "import" and self.first == "from" and not self.assigned or tok == ")" and f.kind == "names"
            if tok == "." and self.first == "from" and self.assigned or tok in (",", "as") and self.first == "from" and not self.assigned:
                fine = False
        if not fine:
            self.fail(at)
        if tok == "import":
            self.assigned = True
        self.annotated = self.annotated or name  # a module or name has been said
        if tok == "(":
            self.stack.append(_Frame(tok, at, "names"))
        elif tok == ")":
            self.stack.pop()
        self.want = not name and tok not in (")", "*")
        self.prev, self.kind = tok if not name else "name", kind

    def in_lambda(self, kind: str, tok: str, at: int, f: _Frame) -> None:
        if kind == "close" or kind == "op" and tok in (";", "->", ":="):
            self.fail(at)
        if tok == ":" and kind == "op":
            if self.want and not (f.fresh or self.prev in (",", "*", "/")):
                self.fail(at)
            self.stack.pop()
            self.want = True
        elif kind == "open":
            if self.prev not in ("=", "(", "in", "not", "and", "or", "if", "else") and self.want and self.kind != "op":
                self.fail(at)
            self.open(tok, at, f)
            return
        elif tok == "lambda":
            self.stack.append(_Frame("lambda", at, "lambda"))
        else:
            self.want = kind == "op" and tok != "..." or kind == "name" and tok in PY_WORDS
        f.fresh = False
        self.prev, self.kind = tok, kind


def scan_python(text: str) -> Defect | None:
    try:
        _Python(text).run()
    except Stop as s:
        return s.defect
    return None


# ----------------------------------------------------------------------------------------------------- JSON
JSON_TOKEN = re.compile(
    r"""[ \t\r\n]+|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)"""
    r"""|(?P<word>true|false|null)(?!\w)|(?P<p>[\[\]{},:])""",
    re.A,
)


def scan_json(text: str) -> Defect | None:
    """A pushdown automaton; its states say what may come next."""
    stack: list[str] = []
    want, i, n = "value", 0, len(text)
    while i < n:
        m = JSON_TOKEN.match(text, i)
        if not m:
            return ("unterminated literal" if text[i] == '"' else "conflict marker" if CONFLICT.match(text, i) else "foreign character", i)
        at, i = i, m.end()
        kind, tok = m.lastgroup, m.group()
        if kind is None:
            continue
        if kind == "p" and tok in "]}":
            if not stack or stack[-1] != tok:
                return ("unbalanced delimiter", at)
            if want not in ("more", "first" + tok):
                return ("tokens that cannot meet", at)
            stack.pop()
            want = "more" if stack else "end"
        elif want in ("key", "first}"):
            if kind != "str":
                return ("tokens that cannot meet", at)
            want = "colon"
        elif want == "colon":
            if tok != ":":
                return ("tokens that cannot meet", at)
            want = "value"
        elif want in ("value", "first]"):
            if tok in "[{" and kind == "p":
                stack.append("]" if tok == "[" else "}")
                want = "first" + stack[-1]
            elif kind == "p":
                return ("tokens that cannot meet", at)
            else:
                want = "more" if stack else "end"
        elif want == "more" and tok == ",":
            want = "key" if stack[-1] == "}" else "value"
        else:
            return ("tokens that cannot meet", at)
    return None if want == "end" else ("premature end", n)


# ----------------------------------------------------------------------------------------------------- TOML
TOML_ESCAPE = r'\\(?:[btnfr"\\]|u[\da-fA-F]{4}|U[\da-fA-F]{8})'
TOML_LITERAL = re.compile(rf'"""(?:[^\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|{TOML_ESCAPE}|\\[ \t]*\n)*?"{{3,5}}(?!")|\'\'\'[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*?\'{{3,5}}(?!\')|"(?!"")(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|{TOML_ESCAPE})*"|\'(?!\'\')[^\'\x00-\x08\x0a-\x1f\x7f]*\'|""|\'\'')
TOML_BARE = re.compile(r"[A-Za-z0-9_.+:-]+(?: \d\d:\d\d:[\d.:+Z-]+)?")
TOML_SCALAR = re.compile(r"true|false|0x[\da-fA-F]+(?:_[\da-fA-F]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*|[+-]?(?:inf|nan|(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+(?:_\d+)*)?)|\d{4}-\d\d-\d\d(?:[Tt ][\d:.]+(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:[\d.]+")


class _TomlKeys:
    """The tables and values defined so far, by their whole path."""

    def __init__(self) -> None:
        self.kind: dict[tuple[str, ...], str] = {}  # value, table, dotted (made by a dotted key), implied, array
        self.at: tuple[str, ...] = ()
        self.seen: set[tuple[str, ...]] = set()

    @staticmethod
    def parts(text: str) -> tuple[str, ...]:
        return tuple(p.strip("\"'") if p[0] in "\"'" else p for p in re.findall(r"\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|[^\s.\"']+", text))

    def below(self, path: tuple[str, ...]) -> tuple[str, ...]:
        """The path with each array of tables on the way replaced by its last table."""
        out: tuple[str, ...] = ()
        for p in path:
            out = (*out, p)
            if self.kind.get(out, "").startswith("array"):
                out = (*out, self.kind[out])
        return out

    def table(self, header: str) -> bool:
        names = self.parts(header.strip("[]"))
        parent = self.below(names[:-1])
        if any(self.kind.get(parent[:k]) == "value" for k in range(1, len(parent) + 1)):
            return False
        path = (*parent, names[-1])
        have = self.kind.get(path)
        if header.startswith("[["):
            if have is not None and not have.startswith("array"):
                return False
            self.kind[path] = f"array {int(have.split()[1]) + 1 if have else 0}"
            self.at = (*path, self.kind[path])
        else:
            if have not in (None, "implied"):
                return False
            self.kind[path] = "table"
            self.at = path
        for k in range(1, len(path)):
            self.kind.setdefault(path[:k], "implied")
        return True

    def value(self, key: str) -> bool:
        names = self.parts(key)
        for k in range(1, len(names)):
            if self.kind.setdefault((*self.at, *names[:k]), "dotted") != "dotted":
                return False
        return self.kind.setdefault(path := (*self.at, *names), "value") == "value" and not (path in self.seen or self.seen.add(path))


def scan_toml(text: str) -> Defect | None:
    """Line grammar (table header, or key = value) over a stack of array and inline-table brackets."""
    text = text.replace("\r\n", "\n")
    stack: list[tuple[str, int]] = []
    part, i, n = "start", 0, len(text)  # start, header, key, value, done
    keys = _TomlKeys()
    while i < n:
        c = text[i]
        if c in " \t":
            i += 1
        elif c == "#":
            j = text.find("\n", i)
            i = n if j < 0 else j
        elif c == "\n":
            if not stack:
                if part in ("header", "key", "value"):
                    return ("premature end", i)
                part = "start"
            elif stack[-1][0] == "{":
                return ("unbalanced delimiter", stack[-1][1])
            i += 1
        elif part in ("start", "key") and not (stack and stack[-1][0] == "["):
            if part == "start" and c == "[":
                m = re.compile(r"\[{1,2}[ \t]*[\w\"'][^\n\[\]]*\]{1,2}").match(text, i)
                if not m or m.group().startswith("[[") != m.group().endswith("]]"):
                    return ("unbalanced delimiter", i)
                if not keys.table(m.group()):
                    return ("key defined twice", i)
                i, part = m.end(), "done"
                continue
            m = re.compile(r"(?:[A-Za-z0-9_-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[A-Za-z0-9_-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'))*[ \t]*(=?)").match(text, i)
            if not m:
                if c == "}" and stack and stack[-1][0] == "{":
                    stack.pop()
                    i, part = i + 1, "done"
                    continue
                return ("conflict marker" if CONFLICT.match(text, i) else "foreign character", i)
            if not m.group(1):
                return ("conflict marker" if CONFLICT.match(text, i) else "tokens that cannot meet", i)
            if not stack and not keys.value(m.group()[:-1]):
                return ("key defined twice", i)
            i, part = m.end(), "value"
        elif c in "\"'":
            m = TOML_LITERAL.match(text, i)
            if not m or m.group() in ('""', "''") and text[i : i + 3] in ('"""', "'''"):
                return ("unterminated literal", i)
            if part != "value":
                return ("tokens that cannot meet", i)
            i, part = m.end(), "done"
        elif c in "[{" and part == "value":
            stack.append((c, i))
            i, part = i + 1, "value" if c == "[" else "key"
        elif c in "]}":
            if not stack or stack[-1][0] != CLOSE[c]:
                return ("unbalanced delimiter", i)
            stack.pop()
            i, part = i + 1, "done"
        elif c == "," and stack and part == "done":
            i, part = i + 1, "value" if stack[-1][0] == "[" else "key"
        elif part == "value" and (m := TOML_BARE.match(text, i)):
            if not TOML_SCALAR.fullmatch(m.group()):
                return ("tokens that cannot meet", i)
            i, part = m.end(), "done"
        else:
            return ("conflict marker" if CONFLICT.match(text, i) else "tokens that cannot meet", i)
    if stack:
        return ("unbalanced delimiter", stack[-1][1])
    return ("premature end", n) if part in ("header", "key", "value") else None


# ----------------------------------------------------------------------------------------------- TypeScript
TS_TOKEN = re.compile(
    r"""(?P<skip>[^\S\n\r\u2028\u2029]+|\ufeff)|(?P<nl>[\n\r\u2028\u2029]+)|(?P<line>//[^\n\r]*)|(?P<block>/\*)
      |(?P<str>'|\")|(?P<tick>`)
      |(?P<num>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d+)?n?)
      |(?P<name>\#?(?:[^\W\d]|[$])(?:\w|[$])*)
      |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.@])
      |(?P<open>[\(\[\{])|(?P<close>[\)\]\}])""",
    re.X,
)
TS_STR = {q: re.compile(rf"(?:[^{q}\\\n\r]|\\(?:\r\n|[\s\S]))*{q}") for q in "'\""}
TS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[a-z]*")
TS_RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static implements interface package private protected public".split())
#: Words that may stand beside another word because they are keywords in some place.
TS_CONTEXT = frozenset("abstract accessor as asserts async await constructor declare from get global infer intrinsic is keyof module namespace of out override readonly require satisfies set type unique using".split())
TS_VALUE_WORDS = frozenset("this super null true false".split())
TS_BINARY = frozenset("= == === != !== <= >= && || ?? ?. += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= . + - / % ** ^ =>".split())
TS_UNENDED = TS_BINARY | frozenset((",", ":", "@", "*", "&", "|", "<", "~", "...", "?"))
TS_UNENDED_WORDS = frozenset("class const enum export extends import in instanceof interface new typeof let var from function if for while switch case else try catch do implements namespace throw delete void".split()) - {"from"}
#: Operators that need an operand before and after them; those that no statement begins with; words that may be names.
TS_ONLY_BINARY = frozenset("= == === != !== <= >= && || ?? += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => % ** ^ | &".split())
TS_NEVER_FIRST = TS_ONLY_BINARY - {"|", "&"} | frozenset((",", ".", "?", ":", "?.", "*", ">"))
TS_STRICT_ONLY = frozenset("let static implements interface package private protected public yield".split())
TS_DECLARED = frozenset("let const var type declare export function abstract async class interface enum namespace module case default import static public private protected readonly".split())


class _TypeScript:
    def __init__(self, text: str):
        self.t, self.n = text, len(text)
        self.stack: list[list] = []  # [opener, position, is a statement block, tokens seen inside, word before, holds an if, of a switch, semicolons, has of or in, of a try]
        self.prev = self.kind = ""
        self.before = ""  # the token before prev
        self.newline = True
        self.start = True  # at the start of a statement
        self.words: list[str] = []  # the tokens of the statement, outside brackets
        self.header = 0  # position of a declaration that still needs its body, plus 1
        self.generic = False  # its head has type parameters
        self.resume = self.pending_template = False
        self.seen_if = self.after_try = self.nameless = False
        self.closed = ""  # the word before the parentheses closed last
        self.resume_at = 0

    def fail(self, kind: str, at: int) -> None:
        raise Stop(kind, at)

    def value_before(self) -> bool:
        """Whether the previous token ends a value, so that a slash divides."""
        if self.kind in ("num", "str"):
            return True
        if self.kind == "name":
            return self.prev not in TS_RESERVED or self.prev in TS_VALUE_WORDS
        return self.prev in (")", "]", "}", "++", "--") and self.kind in ("close", "op")

    def run(self) -> None:
        t, n, i = self.t, self.n, 0
        if t.startswith("#!"):
            i = t.find("\n") if "\n" in t else n
        while i < n:
            if self.newline and t[i] in "<>=|" and CONFLICT.match(t, i) and (i == 0 or t[i - 1] in "\n\r"):
                self.fail("conflict marker", i)
            m = TS_TOKEN.match(t, i)
            if not m:
                self.fail("foreign character", i)
            kind, tok = m.lastgroup, m.group()
            at, i = i, m.end()
            if kind in ("skip", "line"):
                continue
            if kind == "nl":
                self.newline = True
                continue
            if kind == "block":
                j = t.find("*/", i)
                if j < 0:
                    self.fail("unterminated literal", at)
                self.newline = self.newline or "\n" in t[at:j]
                i = j + 2
                continue
            if kind == "op" and tok in ("/", "/=") and not self.value_before():
                m = TS_REGEX.match(t, at)
                if not m:
                    self.fail("unterminated literal", at)
                i, kind, tok = m.end(), "str", "/re/"
            elif kind == "str":
                m = TS_STR[tok].match(t, i)
                if not m:
                    self.fail("unterminated literal", at)
                i, tok = m.end(), "''"
            elif kind == "tick":
                i = self.template(i, at)
                kind, tok = "str", "``"
            self.token(kind, tok, at)
            if kind == "close" and tok == "}" and self.resume:
                i = self.template(i, self.resume_at)
        if self.stack:
            self.fail("unbalanced delimiter", self.stack[-1][1])
        if self.header:
            self.fail("premature end", self.header - 1)
        if self.after_try:
            self.fail("premature end", n)
        if self.prev == "from" and self.words[:1] in (["import"], ["export"]) or self.kind == "op" and self.prev in TS_UNENDED or self.kind == "name" and self.prev in TS_UNENDED_WORDS:
            self.fail("premature end", n)

    def template(self, i: int, at: int) -> int:
        """Reads template text from `i`; at `${` pushes a frame that goes on with the template when closed."""
        t, n = self.t, self.n
        while i < n:
            c = t[i]
            if c == "\\":
                i += 2
            elif c == "`":
                self.resume = False
                self.prev, self.kind = "``", "str"
                return i + 1
            elif c == "$" and t.startswith("${", i):
                self.stack.append(["${", at, False, 0, "", False, False, 0, False, False])
                self.resume = False
                self.prev, self.kind = "${", "open"
                self.pending_template = True
                return i + 2
            else:
                i += 1
        self.fail("unterminated literal", at)
        return n

    def token(self, kind: str, tok: str, at: int) -> None:
        if self.pending_template:  # the template opened an expression; its own token is not one yet
            self.pending_template = False
            self.newline = False
            return
        prev, pk, top = self.prev, self.kind, self.stack[-1] if self.stack else None
        word = kind == "name"
        reserved = word and tok in TS_RESERVED
        same_line = not self.newline
        member = prev in (".", "?.")
        # neighbours that cannot meet on one line
        if same_line and not member and (kind in ("num", "str") and tok != "``" or word and not (reserved and tok not in TS_VALUE_WORDS)):
            if pk == "num" or pk == "str" and prev != "/re/" or pk == "name" and (prev not in TS_RESERVED or prev in TS_VALUE_WORDS) or pk == "close" and prev == "]":
                apart = word and (tok in TS_CONTEXT or tok in ("in", "instanceof")) or pk == "name" and prev in TS_CONTEXT and (self.before not in (".", "?."))
                if not apart or pk == "num" and not (word and tok in TS_CONTEXT):
                    self.fail("tokens that cannot meet", at)
        if prev == "." and not word or prev == "?." and kind not in ("name", "open"):
            self.fail("tokens that cannot meet", at)
        if pk == "op" and prev in TS_BINARY and (kind == "close" or tok in (";", ",")):
            if not (prev in ("-", "+") and self.before == "readonly"):
                self.fail("tokens that cannot meet", at)
        free = self.before not in (".", "?.")
        if pk == "op" and prev in TS_ONLY_BINARY and tok in TS_ONLY_BINARY and kind == "op" and not (prev == "=" and tok in ("|", "&")):
            self.fail("tokens that cannot meet", at)
        if tok == "," and (prev == "(" and pk == "open" or prev == "," and top and top[0] == "(" or prev == "{" and pk == "open"):
            self.fail("tokens that cannot meet", at)
        if pk == "name" and free:
            if prev in ("let", "const", "var") and reserved and tok not in TS_STRICT_ONLY and not (prev == "const" and tok == "enum"):
                self.fail("tokens that cannot meet", at)
            if prev in ("extends", "implements") and tok == "{" and (self.header or self.words[:1] == ["class"]):
                self.fail("tokens that cannot meet", at)
            if prev in ("new", "typeof", "instanceof") and (tok == ";" or kind == "close") or prev == "throw" and (tok == ";" or self.newline or kind == "close"):
                self.fail("tokens that cannot meet", at)
            if prev in ("function", "class") and self.nameless and (tok == "(" if prev == "function" else tok == "{"):
                self.fail("tokens that cannot meet", at)
        if kind == "close" and pk == "open" and prev == "(" and top and top[4] in ("if", "while", "switch", "catch"):
            self.fail("tokens that cannot meet", at)
        if self.after_try and tok not in ("catch", "finally"):
            self.fail("tokens that cannot meet", at)
        self.after_try = False
        if self.start and (prev in ("", ";") and (not top or top[2]) or prev == "{" and pk == "open" and top and top[2]) and kind == "op" and tok in TS_NEVER_FIRST:
            self.fail("tokens that cannot meet", at)
        block = top[2] if top else True
        if word and self.start and block and free and prev != ".":
            if tok == "else":
                if not (top[5] if top else self.seen_if):
                    self.fail("tokens that cannot meet", at)
            elif tok == "case" and not (top and top[6]):
                self.fail("tokens that cannot meet", at)
        if word and tok == "if" and free:
            if top:
                top[5] = True
            else:
                self.seen_if = True
        if top and top[4] == "for" and top[0] == "(":
            top[7] += tok == ";"
            top[8] = top[8] or tok in ("of", "in")
        self.nameless = word and tok in ("function", "class") and self.start and block
        # words that must be followed by something
        if pk == "name" and not (self.before in (".", "?.")) and not (top and top[0] == "{" and kind in ("op", "open") and tok in (":", "(", "?", "<", ",", "}") and not top[2]):
            if prev in ("if", "while", "switch") and tok != "(" or prev == "for" and tok not in ("(", "await") or prev == "catch" and tok not in ("(", "{"):
                self.fail("tokens that cannot meet", at)
            if prev == "import" and kind not in ("str", "open") and tok not in ("*", ".", "type") and not word:
                self.fail("tokens that cannot meet", at)
            if prev in ("try", "do", "finally") and prev != "do" and tok != "{":
                self.fail("tokens that cannot meet", at)
        if self.before == "import" and pk == "name" and prev not in ("type",) and self.words[:1] == ["import"] and len(self.words) == 2 and tok not in ("from", ",", "="):
            self.fail("tokens that cannot meet", at)
        if self.before in ("const",) and pk == "name" and prev != "enum" and "declare" not in self.words and tok not in ("=", ":", "of", "in", "!"):
            self.fail("tokens that cannot meet", at)
        if self.words[:1] == ["import"] and prev == "}" and pk == "close" and len(self.words) == 2 and tok != "from":
            self.fail("tokens that cannot meet", at)
        if self.words[:1] == ["from"] and len(self.words) == 1 and word and same_line:
            self.fail("tokens that cannot meet", at)
        # a string key directly in a statement block is no object
        if top and top[2] and top[3] == 1 and pk == "str" and tok == ":":
            self.fail("tokens that cannot meet", at)
        # declarations need a body
        if self.header:
            self.generic = self.generic or tok == "<"
            if tok == ";" or kind == "close" or kind == "op" and tok in (":", "=>", "=") and not self.generic:
                self.fail("tokens that cannot meet", at)
            if tok == "{":
                self.header = 0
        elif pk == "name" and prev in ("class", "interface", "enum") and word and self.before not in (".", "?.") and tok not in ("extends", "implements"):
            self.header, self.generic = at + 1, False
        # a colon outside brackets belongs to a label, a case, a conditional or a declared name
        if tok == ":" and not self.stack and len(self.words) != 1 and self.words and self.words[0] not in TS_DECLARED and "?" not in self.words:
            self.fail("tokens that cannot meet", at)
        if kind == "open":
            statement = tok == "{" and (self.start or prev in (")", "=>", "else", "do", "try", "finally", ";") or not prev or pk == "close" and prev == "}" and self.newline)
            if top:
                top[3] += 1
            after = (prev if prev != "await" else self.before) if pk == "name" and tok == "(" and free else ""
            self.stack.append([tok, at, statement, 0, after, False, tok == "{" and prev == ")" and self.closed == "switch", 0, False, tok == "{" and pk == "name" and prev == "try" and free])
        elif kind == "close":
            opener = top[0] if top else ""
            if opener == "(" and top[4] == "for" and not (top[7] == 2 or top[7] == 0 and top[8]):
                self.fail("tokens that cannot meet", at)
            self.closed = top[4] if opener == "(" else ""
            self.after_try = opener == "{" and top[9]
            if opener == "${" and tok == "}":
                self.stack.pop()
                self.resume, self.resume_at = True, top[1]
                return
            if opener != CLOSE[tok]:
                self.fail("unbalanced delimiter", at)
            self.stack.pop()
        elif top:
            top[3] += 1
        if kind == "open" and tok == "{":
            self.start = True
            if len(self.stack) == 1:
                self.words.append("{}")
        elif tok == ";" or kind == "close" and tok == "}":
            self.start = True
            if not self.stack and (tok == ";" or self.words[:1] != ["import"] and self.words[:1] != ["export"]):
                self.words = []
        else:
            if not self.stack:
                if self.newline and kind != "op" and pk != "op" and not (self.words[-1:] and self.words[-1] in TS_RESERVED):
                    self.words = []
                self.words.append(tok)
            self.start = False
        self.newline = False
        self.before, self.prev, self.kind = prev, tok, kind


def scan_typescript(text: str) -> Defect | None:
    try:
        _TypeScript(text).run()
    except Stop as s:
        return s.defect
    return None


# --------------------------------------------------------------------------------------------- all languages
SCANNERS = {"py": scan_python, "json": scan_json, "toml": scan_toml, "ts": scan_typescript}


def _refuse(word: str) -> None:
    raise ValueError(word)


def _exact(text: str, ext: str) -> bool | None:
    """Whether the language's own parser accepts the text; None if there is none here."""
    try:
        if ext == "py":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text.removeprefix("\ufeff"), "<file>", "exec", dont_inherit=True)
        elif ext == "json":
            json.loads(text, parse_constant=_refuse)
        elif ext == "toml":
            tomllib.loads(text)
        else:
            return None
    except (RecursionError, MemoryError):
        return None  # nested too deeply for the parser; the stack machine decides
    except (SyntaxError, ValueError):
        return False
    return True


def judge(text: str, ext: str) -> Defect | None:
    """The defect that lexer and stack find in a file, unless the language's own parser accepts it all the same. A file in
    which they find none is not parsed again."""
    found = SCANNERS[ext](text)
    return found if found and _exact(text, ext) is not True else None


def clean_path(c: Column) -> Column:
    """From `repos/` on, single forward slashes, no blanks around."""
    c = F.regexp_replace(F.translate(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), "\\", "/"), "/+", "/")
    return F.regexp_replace(c, r"^.*?(?=repos/)", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def whole_files(chunks: DataFrame) -> DataFrame:
    """(graph_id, source_file, ext, text), one row per file. Repeated rows of a chunk fall to a partial aggregate
    first, so a chunk that makes up a third of all rows is not gathered."""
    path = clean_path(F.col("metadata.source_file"))
    c = chunks.select("graph_id", path.alias("source_file"), F.col("metadata.chunk_index").alias("ord"), "id", F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("ext", extension(F.col("source_file"))).where(F.col("ext").isin(*LANGUAGES))
    c = c.groupBy("graph_id", "source_file", "ext", "id").agg(F.min_by(F.struct("ord", "text"), F.struct(F.col("ord").isNull(), "ord", "text")).alias("c"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("c.ord").isNull().alias("no"), F.col("c.ord").alias("ord"), "id", F.col("c.text").alias("text"))))
    return c.groupBy("graph_id", "source_file", "ext").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def judged_files(chunks: DataFrame) -> DataFrame:
    """(graph_id, source_file, language, defect, line): defect and line are null for accepted files."""
    files = whole_files(chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, lines = [], []
            for text, ext in zip(b.column("text").to_pylist(), b.column("ext").to_pylist()):
                d = judge(text, ext)
                kinds.append(d and d[0])
                lines.append(d and text.count("\n", 0, d[1]) + 1)
            languages = [LANGUAGES[e] for e in b.column("ext").to_pylist()]
            cols = [b.column("graph_id"), b.column("source_file"), pa.array(languages, pa.string()), pa.array(kinds, pa.string()), pa.array(lines, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["graph_id", "source_file", "language", "defect", "line"])

    return files.mapInArrow(run, "graph_id string, source_file string, language string, defect string, line int")


def rates(chunks: DataFrame) -> DataFrame:
    """Files, rejected files and their rate per graph and language, with the count of each kind of defect."""
    j = judged_files(chunks)
    return j.groupBy("graph_id", "language").agg(
        F.count(F.lit(1)).alias("files"), F.count("defect").alias("rejected"),
        F.round(F.count("defect") / F.count(F.lit(1)), 6).alias("rate"),
        *(F.count_if(F.col("defect") == k).alias(k.replace(" ", "_")) for k in ("unterminated literal", "unbalanced delimiter", "premature end", "conflict marker")),
    )
