"""CSS selectors with the endings `::text`, ` ::text` and `::attr(name)` over flat documents.

Supported: type, `*`, class, id, all attribute operators with the flags i and s, the four combinators, `:root :empty
:first-child :last-child :only-child :first-of-type :last-of-type :only-of-type :nth-child :nth-last-child :nth-of-type
:nth-last-of-type :not :is :where :has :checked :disabled :enabled :link :any-link :lang :scope`. Ancestors above a
scope may satisfy combinators; only what is below it is found.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

from .html import Document

Test = Callable[[Document, int], bool]


class SelectorError(ValueError):
    """A selector that cannot be read."""


class Hit(NamedTuple):
    """A result: a node, or a string that a node gave."""

    ord: int
    value: str
    is_node: bool


_NAME = re.compile(r"(?:--|-?(?:[_a-zA-Z]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n0-9a-fA-F]))(?:[-\w]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n0-9a-fA-F])*")
_STRING = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'""", re.S)
_ATTR_OP = re.compile(r"\s*([~|^$*]?=)\s*")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n(?:\s*([+-])\s*(\d+))?|([+-]?\d+))\s*", re.I)
_ENDING = re.compile(r"(\s*)::(?:(text)|attr\(\s*([^()\s]+)\s*\))\s*$", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


def _plain(name: str) -> str:
    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", lambda m: chr(int(m[1], 16)) if m[1] and 0 < int(m[1], 16) < 0x110000 else m[2] or "�", name)


def _elements(doc: Document, at: int) -> list[int]:
    return [k for k in doc.children(at) if doc.kind[k] == "element"]


def _siblings(doc: Document, at: int) -> list[int]:
    return _elements(doc, doc.parent[at]) if doc.parent[at] >= 0 else [at]


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, why: str = "cannot be read"):
        raise SelectorError(f"selector {self.text!r} {why} at {self.at}")

    def take(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def name(self) -> str:
        m = self.take(_NAME)
        return _plain(m[0]) if m else self.fail("needs a name")

    def spaces(self) -> bool:
        return bool(self.take(_SPACES))

    def group(self, relative: bool = False) -> Test:
        """A comma-separated list up to `)` or the end."""
        tests = []
        while True:
            self.spaces()
            tests.append(self.complex(relative))
            self.spaces()
            if self.peek() != ",":
                break
            self.at += 1
        return lambda d, i: any(t(d, i) for t in tests)

    def complex(self, relative: bool = False) -> Test:
        parts: list[tuple[str, Test]] = []
        link = " "
        if relative and self.peek() in (">", "+", "~") and self.peek():
            link = self.peek()
            self.at += 1
            self.spaces()
        while True:
            parts.append((link, self.compound()))
            spaced = self.spaces()
            c = self.peek()
            if c and c in ">+~":
                link = c
                self.at += 1
                self.spaces()
            elif c in ("", ",", ")"):
                break
            elif spaced:
                link = " "
            else:
                self.fail()
        return _has(parts) if relative else _chain(parts)

    def compound(self) -> Test:
        tests: list[Test] = []
        if self.peek() == "*":
            self.at += 1
            tests.append(lambda d, i: True)
        elif _NAME.match(self.text, self.at):
            tag = self.name().lower()
            tests.append(lambda d, i: d.tag[i] == tag)
        while True:
            c = self.peek()
            if c == ".":
                self.at += 1
                cls = self.name()
                tests.append(lambda d, i, cls=cls: cls in (d.attr(i, "class") or "").split())
            elif c == "#":
                self.at += 1
                own = self.name()
                tests.append(lambda d, i, own=own: d.attr(i, "id") == own)
            elif c == "[":
                tests.append(self.attribute())
            elif c == ":":
                tests.append(self.pseudo())
            else:
                break
        if not tests:
            self.fail("has an empty part")
        return tests[0] if len(tests) == 1 else lambda d, i: all(t(d, i) for t in tests)

    def attribute(self) -> Test:
        self.at += 1
        self.spaces()
        name = self.name().lower()
        op = self.take(_ATTR_OP)
        if not op:
            self.spaces()
            if self.peek() != "]":
                self.fail()
            self.at += 1
            return lambda d, i: d.attr(i, name) is not None
        s = self.take(_STRING)
        value = _plain(s[1] if s[1] is not None else s[2]) if s else self.name()
        self.spaces()
        flag = ""
        if self.peek() in ("i", "I", "s", "S") and self.peek():
            flag = self.peek().lower()
            self.at += 1
            self.spaces()
        if self.peek() != "]":
            self.fail()
        self.at += 1
        op, fold = op[1], flag == "i"
        value = value.lower() if fold else value
        tests = {
            "=": lambda v: v == value,
            "~=": lambda v: bool(value) and value in v.split(),
            "|=": lambda v: v == value or v.startswith(value + "-"),
            "^=": lambda v: bool(value) and v.startswith(value),
            "$=": lambda v: bool(value) and v.endswith(value),
            "*=": lambda v: bool(value) and value in v,
        }
        test = tests[op]

        def run(d: Document, i: int) -> bool:
            v = d.attr(i, name)
            return v is not None and test(v.lower() if fold else v)

        return run

    def pseudo(self) -> Test:
        self.at += 1
        if self.peek() == ":":
            self.fail("has an ending where none can stand")
        name = self.name().lower()
        if self.peek() == "(":
            self.at += 1
            if name in ("not", "is", "where", "matches", "has"):
                inner = self.group(name == "has")
                test = (lambda d, i: not inner(d, i)) if name == "not" else inner
            elif name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
                m = self.take(_NTH) or self.fail("has no such number")
                if m[1]:
                    a, b = 2, 1 if m[1].lower() == "odd" else 0
                elif m[5] is not None:
                    a, b = 0, int(m[5])
                else:
                    a = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
                    b = int((m[3] or "") + m[4]) if m[4] else 0
                of = None
                if name in ("nth-child", "nth-last-child") and self.text[self.at : self.at + 2].lower() == "of":
                    self.at += 2
                    of = self.group()
                test = _nth(a, b, "last" in name, "type" in name, of)
            elif name == "lang":
                wanted = self.take(_STRING)
                wanted = (wanted[1] or wanted[2] or "") if wanted else self.name()
                test = lambda d, i: _lang(d, i, wanted.lower())
            elif name in ("contains", "-soup-contains"):
                s = self.take(_STRING) or self.fail()
                part = s[1] if s[1] is not None else s[2]
                test = lambda d, i: part in d.string(i)
            else:
                self.fail(f"has an unknown :{name}()")
            self.spaces()
            if self.peek() != ")":
                self.fail("has an open bracket")
            self.at += 1
            return test
        if name not in _SIMPLE:
            self.fail(f"has an unknown :{name}")
        return _SIMPLE[name]


def _lang(d: Document, i: int, wanted: str) -> bool:
    while i >= 0:
        own = d.attr(i, "lang") if d.kind[i] == "element" else None
        if own is not None:
            return own.lower() == wanted or own.lower().startswith(wanted + "-")
        i = d.parent[i]
    return False


def _nth(a: int, b: int, last: bool, of_type: bool, of: Test | None = None) -> Test:
    def run(d: Document, i: int) -> bool:
        if of is not None and not of(d, i):
            return False
        same = [k for k in _siblings(d, i) if (not of_type or d.tag[k] == d.tag[i]) and (of is None or of(d, k))]
        n = len(same) - same.index(i) if last else same.index(i) + 1
        return (n - b) % a == 0 and (n - b) // a >= 0 if a else n == b

    return run


_FORM = ("button", "input", "select", "textarea", "option", "optgroup", "fieldset")
_SIMPLE: dict[str, Test] = {
    "root": lambda d, i: d.kind[d.parent[i]] == "document",
    "scope": lambda d, i: d.kind[d.parent[i]] == "document",
    "empty": lambda d, i: not any(d.kind[k] == "element" or (d.kind[k] == "text" and d.data[k]) for k in d.children(i)),
    "first-child": _nth(0, 1, False, False),
    "last-child": _nth(0, 1, True, False),
    "only-child": lambda d, i: len(_siblings(d, i)) == 1,
    "first-of-type": _nth(0, 1, False, True),
    "last-of-type": _nth(0, 1, True, True),
    "only-of-type": lambda d, i: sum(d.tag[k] == d.tag[i] for k in _siblings(d, i)) == 1,
    "link": lambda d, i: d.tag[i] in ("a", "area") and d.attr(i, "href") is not None,
    "any-link": lambda d, i: d.tag[i] in ("a", "area") and d.attr(i, "href") is not None,
    "checked": lambda d, i: (d.tag[i] == "input" and d.attr(i, "checked") is not None) or (d.tag[i] == "option" and d.attr(i, "selected") is not None),
    "disabled": lambda d, i: d.tag[i] in _FORM and d.attr(i, "disabled") is not None,
    "enabled": lambda d, i: d.tag[i] in _FORM and d.attr(i, "disabled") is None,
}


def _related(d: Document, i: int, link: str):
    """Where the part before a combinator may stand."""
    if link in " >":
        k = d.parent[i]
        while k >= 0 and d.kind[k] == "element":
            yield k
            if link == ">":
                return
            k = d.parent[k]
    else:
        before = [k for k in _siblings(d, i) if k < i]
        yield from before[-1:] if link == "+" else before


def _chain(parts: list[tuple[str, Test]]) -> Test:
    def run(d: Document, i: int, n: int = len(parts) - 1) -> bool:
        link, test = parts[n]
        return test(d, i) and (n == 0 or any(run(d, k, n - 1) for k in _related(d, i, link)))

    return run


def _has(parts: list[tuple[str, Test]]) -> Test:
    def after(d: Document, i: int, link: str):
        if link == " ":
            yield from (k for k in range(i + 1, d.end[i]) if d.kind[k] == "element")
        elif link == ">":
            yield from _elements(d, i)
        else:
            later = [k for k in _siblings(d, i) if k > i]
            yield from later[:1] if link == "+" else later

    def run(d: Document, i: int, n: int = 0) -> bool:
        return n == len(parts) or any(parts[n][1](d, k) and run(d, k, n + 1) for k in after(d, i, parts[n][0]))

    return run


def split_list(query: str) -> list[str]:
    """The members of a list: commas outside quotes, brackets and escapes."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(query):
        c = query[i]
        if c == "\\":
            i += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(query[start:i])
            start = i + 1
        i += 1
    out.append(query[start:])
    if any(not part.strip() for part in out):
        raise SelectorError(f"selector {query!r} has an empty member")
    return out


class Branch(NamedTuple):
    test: Test
    ending: str  # "", "text", "all text" or "attr"
    name: str


@lru_cache(512)
def compiled(query: str) -> tuple[Branch, ...]:
    out = []
    for part in split_list(query):
        m = _ENDING.search(part)
        body = part[: m.start()] if m else part
        if m and not body.strip():
            out.append(Branch(lambda d, i: True, "every text" if m[2] else "attr", (m[3] or "").lower()))
            continue
        r = _Reader(body.strip())
        test = r.complex()
        if r.at != len(r.text):
            r.fail()
        out.append(Branch(test, ("all text" if m[1] else "text") if m and m[2] else "attr" if m else "", (m[3] or "").lower() if m else ""))
    return tuple(out)


def select(doc: Document, query: str, scope: int = 0) -> list[Hit]:
    """Hits below scope in document order, each once."""
    found: dict[tuple[int, int], Hit] = {}
    below = [i for i in range(scope + 1, doc.end[scope]) if doc.kind[i] == "element"]
    for no, branch in enumerate(compiled(query)):
        if branch.ending == "every text":
            matches, texts = [], [k for k in range(scope + 1, doc.end[scope]) if doc.kind[k] == "text"]
        else:
            matches, texts = [i for i in below if branch.test(doc, i)], []
        if branch.ending == "text":
            texts = [k for i in matches for k in doc.children(i) if doc.kind[k] == "text"]
        elif branch.ending == "all text":
            last = -1
            for i in matches:
                if i >= last:
                    texts += [k for k in range(i + 1, doc.end[i]) if doc.kind[k] == "text"]
                    last = doc.end[i]
        if branch.ending == "attr":
            for i in matches:
                value = doc.attr(i, branch.name)
                if value is not None:
                    place = next(n for n, (k, _) in enumerate(doc.attrs[i], 1) if k == branch.name)
                    found.setdefault((i, place), Hit(i, value, False))
        elif branch.ending:
            for k in texts:
                found.setdefault((k, 0), Hit(k, doc.data[k], True))
        else:
            for i in matches:
                found.setdefault((i, 0), Hit(i, "", True))
    return [h if h.value or not h.is_node or doc.kind[h.ord] == "text" else h._replace(value=doc.outer(h.ord)) for _, h in sorted(found.items())]
