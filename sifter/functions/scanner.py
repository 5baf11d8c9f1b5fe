"""A small scanner for TypeScript and JavaScript: definitions, imports and calls of one source text.

It works on tokens with matched brackets, not on a full grammar. Function, class and method declarations and variables that hold
a function are definitions; constructor calls, interfaces, enums, generators and class-field arrows aren't. JSX is read as far as
its text resembles code.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<str>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<num>\d[\w.]*)"
    r"|(?P<id>[#A-Za-z_$\u0080-￿][\w$]*)"
    r"|(?P<op>=>|\?\.(?!\d)|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|.)",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "instanceof", "new", "throw", "else", "do", "await", "yield"}
_NOT_CALLED = {
    "if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "yield", "void", "delete", "throw", "in", "of", "new", "do", "else", "case", "with", "async", "instanceof", "class", "extends", "constructor",
}
_MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "override", "get", "set", "abstract", "declare", "accessor"}
_OPEN = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Definition(NamedTuple):
    name: str
    kind: str
    start_line: int
    end_line: int
    body_text: str
    exported: bool


class Import(NamedTuple):
    names: list[str]
    source: str
    line: int


class Call(NamedTuple):
    callee: str
    caller: str | None
    line: int


def _template_end(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """End of the template literal that begins at ``at``, and the ranges of its substitutions."""
    parts, i = [], at + 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == "`":
            return i + 1, parts
        elif text.startswith("${", i):
            depth, j = 1, i + 2
            while j < len(text) and depth:
                if text[j] == "`":
                    j = _template_end(text, j)[0]
                    continue
                depth += {"{": 1, "}": -1}.get(text[j], 0)
                j += 1
            parts.append((i + 2, j - 1))
            i = j
        else:
            i += 1
    return len(text), parts


def tokenize(text: str, start: int = 0, end: int | None = None) -> list[Token]:
    out: list[Token] = []
    end, i = len(text) if end is None else end, start
    while i < end:
        if text[i] == "`":
            stop, parts = _template_end(text, i)
            out.append(Token("str", "``", i, stop))
            for a, b in parts:
                # A substitution reads as an argument list of its own, which no name stands before.
                out += [Token("op", ";", a, a), *tokenize(text, a, b), Token("op", ";", b, b)]
            out.append(Token("str", "``", stop, stop))
            i = stop
            continue
        if text[i] == "/" and text[i + 1 : i + 2] not in ("/", "*"):
            last = out[-1] if out else None
            value = last is not None and (last.kind in ("num", "str") or last.text in (")", "]", "}") or (last.kind == "id" and last.text not in _BEFORE_VALUE))
            m = None if value else _REGEX.match(text, i, end)
            if m:
                out.append(Token("str", m[0], i, m.end()))
                i = m.end()
                continue
        m = _TOKEN.match(text, i, end)
        if m is None:
            break
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup or "op", m[0], i, m.end()))
        i = m.end()
    return out


class _Scanner:
    def __init__(self, text: str):
        self.text, self.t = text, tokenize(text)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, x in enumerate(self.t):
            if x.kind == "op" and x.text in _OPEN:
                stack.append(i)
            elif x.kind == "op" and x.text in ")]}":
                while stack and _OPEN[self.t[stack[-1]].text] != x.text:
                    stack.pop()
                if stack:
                    self.pair[stack[-1]] = i
                    self.pair[i] = stack.pop()
        self.definitions: list[Definition] = []
        self.imports: list[Import] = []
        self.calls: list[Call] = []

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1

    def text_at(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind != "str" else ""

    def skip_types(self, i: int) -> int:
        """Past type arguments or parameters in angle brackets that begin at i; i itself if there are none."""
        if self.text_at(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.t) and j < i + 200:
            x = self.t[j]
            if x.text == "<":
                depth += 1
            elif x.text == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif x.kind == "op" and x.text in _OPEN:
                j = self.pair.get(j, len(self.t))
            elif x.kind == "op" and x.text in (";", "&&", "||", ")", "}"):
                return i
            j += 1
        return i

    def body(self, i: int) -> int:
        """The opening brace of a body after parameters that end before i, past a return type; -1 for a bare signature."""
        if self.text_at(i) == ":":
            i += 1
            first = True
            while i < len(self.t) and not (self.text_at(i) == "{" and not first):
                x = self.text_at(i)
                if x in ("", ";", ",", ")", "}", "="):
                    return -1
                typed = self.skip_types(i)
                i = self.pair.get(i, i) + 1 if x in _OPEN else typed if typed != i else i + 1
                first = x in ("|", "&", "=>")
        return i if self.text_at(i) == "{" and i in self.pair else -1

    def define(self, name: str, kind: str, first: int, last: int, exported: bool) -> None:
        a, b = self.t[first].start, self.t[last].end
        self.definitions.append(Definition(name, kind, self.line(a), self.line(b), self.text[a:b], exported))

    def exported(self, i: int) -> bool:
        return self.text_at(i - 1) == "export" or (self.text_at(i - 1) == "default" and self.text_at(i - 2) == "export")

    def statement(self, i: int) -> bool:
        return self.text_at(i - 1) in ("", ";", "{", "}", ")", "export", "default", "declare")

    def arrow(self, i: int) -> int:
        """The last token of a function value that begins at i; -1 if there is no function."""
        j = i + 1 if self.text_at(i) == "async" else i
        if self.text_at(j) == "function" and self.text_at(j + 1) != "*":
            j += 1 + (self.t[j + 1].kind == "id" if j + 1 < len(self.t) else 0)
            j = self.skip_types(j)
            b = self.body(self.pair[j] + 1) if self.text_at(j) == "(" and j in self.pair else -1
            return self.pair[b] if b >= 0 else -1
        j = self.skip_types(j)
        if self.text_at(j) == "(" and j in self.pair:
            j = self.pair[j] + 1
            if self.text_at(j) == ":":
                while j < len(self.t) and self.text_at(j) not in ("=>", ";", ""):
                    j = self.pair.get(j, j) + 1 if self.text_at(j) in _OPEN else j + 1
        elif j < len(self.t) and self.t[j].kind == "id":
            j += 1
        else:
            return -1
        if self.text_at(j) != "=>":
            return -1
        j += 1
        if self.text_at(j) == "{" and j in self.pair:
            return self.pair[j]
        while j < len(self.t):
            if self.text_at(j) in _OPEN and j in self.pair:
                j = self.pair[j]
            following = self.t[j + 1] if j + 1 < len(self.t) else None
            if following is None or following.text in (";", ",", ")", "]", "}"):
                return j
            fresh_line = self.line(following.start) > self.line(self.t[j].end)
            if fresh_line and (following.kind == "id" or following.text == "@") and self.t[j].text not in ("=>", "=", "?", ":", "&&", "||", "+", "."):
                return j
            j += 1
        return len(self.t) - 1

    def callee(self, i: int) -> int:
        """The first token of the member chain that ends with token i."""
        while True:
            x = self.t[i]
            if x.kind == "op" and x.text in ")]" and i in self.pair:
                i = self.pair[i]
                before = self.t[i - 1] if i else None
                if before is not None and (before.kind == "id" and before.text not in _NOT_CALLED or before.text in (")", "]")):
                    i -= 1
                    continue
                return i
            if self.text_at(i - 1) in (".", "?.") and i >= 2:
                i -= 2
                continue
            return i

    def walk(self, i: int, end: int, caller: str | None, in_class: bool = False) -> None:
        while i < end:
            x = self.t[i]
            if x.kind == "id" and self.text_at(i - 1) not in (".", "?."):
                jump = self.keyword(i, end, caller, in_class)
                if jump:
                    i = jump
                    continue
            if x.kind == "op" and x.text == "(" and i:
                self.call(i, caller)
            if x.kind == "op" and x.text in _OPEN and i in self.pair and self.pair[i] < end:
                self.walk(i + 1, self.pair[i], caller)
                i = self.pair[i]
            i += 1

    def keyword(self, i: int, end: int, caller: str | None, in_class: bool) -> int:
        word, statement = self.t[i].text, self.statement(i)
        if word == "import" and self.text_at(i + 1) not in ("(", "."):
            return self.import_at(i, end)
        if word in ("interface", "enum") and statement and i + 1 < end and self.t[i + 1].kind == "id":
            j = i
            while j < end and self.text_at(j) != "{":
                j += 1
            return self.pair.get(j, j) + 1
        if word == "type" and statement and i + 2 < end and self.t[i + 1].kind == "id" and self.text_at(self.skip_types(i + 2)) == "=":
            j = i
            while j < end and self.text_at(j) != ";":
                j = self.pair.get(j, j) + 1 if self.text_at(j) in _OPEN else j + 1
                if j < end and self.line(self.t[j].start) > self.line(self.t[j - 1].end) and self.text_at(j) not in ("|", "&") and self.text_at(j - 1) not in ("=", "|", "&"):
                    break
            return j
        if word == "function" and (statement or (self.text_at(i - 1) == "async" and self.statement(i - 1))) and i + 1 < end and self.t[i + 1].kind == "id":
            first = i - 1 if self.text_at(i - 1) == "async" else i
            j = self.skip_types(i + 2)
            b = self.body(self.pair[j] + 1) if self.text_at(j) == "(" and j in self.pair else -1
            if b >= 0:
                name = self.t[i + 1].text
                self.define(name, "function", first, self.pair[b], self.exported(first))
                self.walk(j + 1, self.pair[j], name)
                self.walk(b + 1, self.pair[b], name)
                return self.pair[b] + 1
            return j
        if word == "class" and i + 1 < end:
            j = i
            while j < end and self.text_at(j) != "{":
                j += 1
            if j not in self.pair:
                return 0
            name = self.t[i + 1].text if self.t[i + 1].kind == "id" and self.text_at(i + 1) not in ("extends", "implements") else None
            own = caller
            if name and statement:
                self.define(name, "class", i, self.pair[j], self.exported(i))
                own = name
            self.walk(i + 1, j, own)
            self.walk(j + 1, self.pair[j], own, in_class=True)
            return self.pair[j] + 1
        if word in ("const", "let", "var") and i + 2 < end and self.t[i + 1].kind == "id":
            j = i + 2
            if self.text_at(j) == ":":
                while j < end and self.text_at(j) not in ("=", ";", ""):
                    j = self.pair.get(j, j) + 1 if self.text_at(j) in _OPEN else j + 1
            last = self.arrow(j + 1) if self.text_at(j) == "=" else -1
            if 0 <= last < end:
                name = self.t[i + 1].text
                self.define(name, "variable", i + 1, last, self.exported(i))
                self.walk(j + 1, last + 1, name)
                return last + 1
            return 0
        return self.method(i, end, in_class)

    def method(self, i: int, end: int, in_class: bool) -> int:
        word = self.t[i].text
        before = self.text_at(i - 1)
        j = self.skip_types(i + 1)
        if self.text_at(j) == "?" and in_class:
            j += 1
        if self.text_at(j) != "(" or j not in self.pair or (word in _NOT_CALLED and word != "constructor") or before in ("new", "function"):
            return 0
        close = self.pair[j]
        if in_class:
            if before not in ("", "{", "}", ";", "*", ")") and before not in _MODIFIERS and not (i and self.line(self.t[i].start) > self.line(self.t[i - 1].end)):
                return 0
            b = self.body(close + 1)
        else:
            b = close + 1 if before in ("{", ",", "async", "get", "set", "*") and self.text_at(close + 1) == "{" and close + 1 in self.pair else -1
        if b < 0:
            if in_class and (before in _MODIFIERS or before in ("{", "}", ";", ")", "")) and self.text_at(close + 1) in (":", ";", "}"):
                return close + 1  # a signature without a body
            return 0
        first = i
        while self.text_at(first - 1) in _MODIFIERS or self.text_at(first - 1) == "*":
            first -= 1
        self.define(word, "method", first, self.pair[b], False)
        self.walk(j + 1, close, word)
        self.walk(b + 1, self.pair[b], word)
        return self.pair[b] + 1

    def import_at(self, i: int, end: int) -> int:
        names, j = [], i + 1
        while j < end and self.t[j].kind != "str" and self.text_at(j) not in (";", "="):
            x = self.t[j]
            following = self.text_at(j + 1)
            if x.kind == "id" and x.text not in ("as", "from") and not (x.text == "type" and following not in (",", "}", "from")):
                names.append(x.text)
            j += 1
        if j < end and self.t[j].kind == "str":
            source = self.t[j].text.strip("\"'")
            if source:
                self.imports.append(Import(names, source, self.line(self.t[i].start)))
            return j + 1
        return j

    def call(self, i: int, caller: str | None) -> None:
        j = i - 1
        if self.text_at(j) == ">":  # type arguments
            k = j
            while k > max(0, j - 60) and not (self.text_at(k) == "<" and self.skip_types(k) == j + 1):
                k -= 1
            if self.text_at(k) != "<":
                return
            j = k - 1
        if self.text_at(j) == "?.":
            j -= 1
        if j < 0:
            return
        x = self.t[j]
        member = self.text_at(j - 1) in (".", "?.")
        if x.kind == "id":
            if x.text in _NOT_CALLED and not member or (self.text_at(j - 1) == "function"):
                return
        elif x.text not in (")", "]") or j not in self.pair:
            return
        elif x.text == ")" and self.text_at(self.pair[j] - 1) in _NOT_CALLED:
            return
        first = self.callee(j)
        if self.text_at(first - 1) == "new":
            return
        name = self.text[self.t[first].start : self.t[j].end]
        if member and j - 2 == first and self.t[first].text in ("this", "super"):
            name = x.text
        self.calls.append(Call(name, caller, self.line(self.t[first].start)))


def scan(text: str) -> tuple[list[Definition], list[Import], list[Call]]:
    s = _Scanner(text)
    s.walk(0, len(s.t), None)
    return s.definitions, s.imports, s.calls
