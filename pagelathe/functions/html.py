"""HTML parsing into flat, interval-encoded documents, after the WHATWG tree construction rules.

Node 0 is the document; `ord` is the place in document order, `end` one past the last descendant. Covered: implied
html, head, body and tbody, implied end tags, raw and escapable raw text, the adoption agency, the list of active
formatting elements, foster parenting, templates (whose content counts as children). Not covered: framesets, and the
case fixes of names in SVG and MathML.
"""

from __future__ import annotations

import html as entities
import re
from time import monotonic

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p plaintext pre listing search section summary table ul xmp".split())
BLOCK_ENDS = frozenset("address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul".split())
SPECIAL = CLOSES_P | HEAD | VOID | frozenset("applet body button caption col colgroup frame frameset head html iframe marquee object optgroup option select tbody td textarea tfoot th thead tr".split()) - {"optgroup", "option"}
SCOPE = frozenset("applet caption html table td th marquee object template".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SPACE = "\t\n\f\r "

_TOKEN = re.compile(
    r"<!--(?P<comment>(?=-?>)|.*?(?=--!?>|\Z))(?:-?>|--!?>|\Z)?"
    r"|<!doctype(?P<doctype>[^>]*+)>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?|[\"'])*+)>"
    r"|<(?P<bogus>[!?][^>]*+|/(?![a-zA-Z>])[^>]*+)>?|</>"
    r"|<(?P<cut>/?[a-zA-Z])(?s:.*)\Z"
    r"|(?P<text>(?:[^<]++|<(?![a-zA-Z!?/]))++)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_LEGACY = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)(?=(.?))", re.S)


def decode_attribute(value: str) -> str:
    """Character references of an attribute: those without semicolon stay before `=` and alphanumerics."""
    if "&" not in value:
        return value

    def one(m: re.Match) -> str:
        name, after = m[1], m[2]
        if name.startswith("#") or name.endswith(";"):
            return entities.unescape("&" + name)
        return m[0] if after == "=" or after.isalnum() or name not in entities.entities.html5 else entities.entities.html5[name]

    return _LEGACY.sub(one, value)


class ParseTimeout(Exception):
    """The budget of a parse is used up; `done` of `size` characters were read."""

    def __init__(self, done: int, size: int):
        super().__init__(f"parse stopped after {done} of {size} characters")
        self.done, self.size = done, size


class Stack(list):
    """The stack of open elements, with how many of each tag there are, so that most questions about it need no walk."""

    def __init__(self, rows=()):
        super().__init__(rows)
        self.open: dict[str, int] = {}
        for e in rows:
            self._add(e)

    def _add(self, e: Element) -> None:
        self.open[e.tag] = self.open.get(e.tag, 0) + 1
        e.stacked += 1

    def _take(self, e: Element) -> None:
        self.open[e.tag] -= 1
        e.stacked -= 1

    def append(self, e: Element) -> None:
        self.open[e.tag] = self.open.get(e.tag, 0) + 1
        e.stacked += 1
        list.append(self, e)

    def pop(self, at: int = -1) -> Element:
        e = list.pop(self, at)
        self.open[e.tag] -= 1
        e.stacked -= 1
        return e

    def remove(self, e: Element) -> None:
        list.remove(self, e)
        self._take(e)

    def insert(self, at: int, e: Element) -> None:
        self._add(e)
        list.insert(self, at, e)

    def __delitem__(self, at) -> None:
        for e in self[at] if isinstance(at, slice) else [self[at]]:
            self._take(e)
        list.__delitem__(self, at)

    def __setitem__(self, at, e) -> None:
        self._take(self[at])
        self._add(e)
        list.__setitem__(self, at, e)

    def __contains__(self, e: Element) -> bool:
        return e.stacked > 0


class Element:
    __slots__ = ("kind", "tag", "attrs", "kids", "parent", "data", "stacked")

    def __init__(self, kind: str, tag: str = "", attrs=(), data: str = ""):
        self.kind, self.tag, self.attrs, self.data, self.stacked = kind, tag, list(attrs), data, 0
        self.kids: list[Element] = []
        self.parent: Element | None = None


def _put(parent: Element, node: Element, before: Element | None = None) -> None:
    if node.parent is not None:
        node.parent.kids.remove(node)
    node.parent = parent
    if before is None:
        parent.kids.append(node)
    else:
        parent.kids.insert(parent.kids.index(before), node)


class Builder:
    """The tree construction stage."""

    def __init__(self) -> None:
        self.doc = Element("document")
        self.stack: Stack = Stack()
        self.active: list[Element | None] = []
        self.html = self.head = self.body = self.form = None
        self.phase = "before"  # before, head, after head, body
        self.newline = False

    # the stack

    @property
    def at(self) -> Element:
        return self.stack[-1] if self.stack else self.doc

    def in_scope(self, *tags: str, more: frozenset = frozenset(), only: frozenset | None = None) -> bool:
        if not any(map(self.stack.open.get, tags)):
            return False
        walls = only if only is not None else SCOPE | more
        for e in reversed(self.stack):
            if e.tag in tags:
                return True
            if e.tag in walls:
                return False
        return False

    def pop_to(self, *tags: str) -> None:
        while self.stack and self.stack.pop().tag not in tags:
            pass

    def imply(self, but: str = "") -> None:
        while self.at.tag in IMPLIED and self.at.tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope("p", more=frozenset({"button"})):
            self.imply("p")
            self.pop_to("p")

    def place(self, top: int | None = None) -> tuple[Element, Element | None]:
        """Where a node goes in the top element, or in that at `top`: foster parents out of tables."""
        if self.fostering and (self.at if top is None else self.stack[top]).tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.stack) - 1 if top is None else top, -1, -1):
                if self.stack[i].tag == "template":
                    return self.stack[i], None
                if self.stack[i].tag == "table":
                    table = self.stack[i]
                    return (table.parent, table) if table.parent is not None else (self.stack[i - 1], None)
        return (self.at if top is None else self.stack[top]), None

    fostering = False

    def insert(self, tag: str, attrs=()) -> Element:
        e = Element("element", tag, attrs)
        _put(*(lambda p: (p[0], e, p[1]))(self.place()))
        self.stack.append(e)
        return e

    # the phases before the body

    def need_html(self, attrs=()) -> None:
        if self.html is None:
            self.html = Element("element", "html", attrs)
            _put(self.doc, self.html)
            self.stack.append(self.html)

    def need_head(self, attrs=()) -> None:
        self.need_html()
        if self.head is None:
            self.head = self.insert("head", attrs)
            self.phase = "head"

    def leave_head(self) -> None:
        self.need_head()
        if self.phase == "head":
            while self.stack[-1] is not self.html:
                self.stack.pop()
            self.phase = "after head"

    def need_body(self, attrs=()) -> None:
        self.leave_head()
        if self.body is None:
            self.body = self.insert("body", attrs)
            self.phase = "body"

    # active formatting elements

    def rebuild(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.insert(old.tag, old.attrs)

    def remember(self, e: Element) -> None:
        same = 0
        for i in range(len(self.active) - 1, -1, -1):
            f = self.active[i]
            if f is None:
                break
            if f.tag == e.tag and sorted(f.attrs) == sorted(e.attrs):
                same += 1
                if same == 3:
                    del self.active[i]
                    break
        self.active.append(e)

    def forget_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> None:
        """The adoption agency."""
        if self.at.tag == tag and self.at not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            mine = None
            for f in reversed(self.active):
                if f is None:
                    break
                if f.tag == tag:
                    mine = f
                    break
            if mine is None:
                self.other_end(tag)
                return
            if mine not in self.stack:
                self.active.remove(mine)
                return
            if not self.in_scope(tag):
                return
            at = self.stack.index(mine)
            furthest = next((e for e in self.stack[at + 1 :] if e.tag in SPECIAL), None)
            if furthest is None:
                del self.stack[at:]
                self.active.remove(mine)
                return
            common, bookmark = self.stack[at - 1], self.active.index(mine)
            node = last = furthest
            place, inner = self.stack.index(furthest), 0
            while True:
                inner += 1
                place -= 1
                node = self.stack[place]
                if node is mine:
                    break
                if inner > 3 and node in self.active:
                    where = self.active.index(node)
                    del self.active[where]
                    bookmark -= where < bookmark
                if node not in self.active:
                    del self.stack[place]
                    continue
                new = Element("element", node.tag, node.attrs)
                self.active[self.active.index(node)] = new
                self.stack[place] = new
                node = new
                if last is furthest:
                    bookmark = self.active.index(new) + 1
                _put(node, last)
                last = node
            if common.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                held, self.fostering = self.fostering, True
                where = self.place(self.stack.index(common))
                self.fostering = held
            else:
                where = (common, None)
            _put(where[0], last, where[1])
            new = Element("element", mine.tag, mine.attrs)
            for k in list(furthest.kids):
                _put(new, k)
            _put(furthest, new)
            self.active.insert(bookmark, new)
            self.active.remove(mine)
            self.stack.remove(mine)
            self.stack.insert(self.stack.index(furthest) + 1, new)

    def other_end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            e = self.stack[i]
            if e.tag == tag:
                self.imply(tag)
                del self.stack[i:]
                return
            if e.tag in SPECIAL:
                return

    # tokens

    def text(self, data: str) -> None:
        if not data:
            return
        if self.newline:
            self.newline = False
            data = data[1:] if data.startswith("\n") else data
            if not data:
                return
        if self.phase != "body" and not self.stack.open.get("template"):
            rest = data.lstrip(SPACE)
            if self.phase in ("head", "after head") and len(rest) < len(data):
                self.add_text(data[: len(data) - len(rest)])
            if not rest:
                return
            self.need_body()
            data = rest
        if self.at.tag in ("table", "tbody", "tfoot", "thead", "tr") and data.strip(SPACE):
            self.fostering = True
            self.rebuild()
            self.add_text(data)
            self.fostering = False
            return
        self.rebuild()
        self.add_text(data)

    def add_text(self, data: str) -> None:
        parent, before = self.place()
        kids = parent.kids
        last = kids[-1] if before is None and kids else kids[kids.index(before) - 1] if before is not None and kids.index(before) else None
        if last is not None and last.kind == "text":
            last.data += data
        else:
            _put(parent, Element("text", data=data), before)

    def comment(self, data: str) -> None:
        node = Element("comment", data=data)
        _put(self.doc if self.html is None or self.ended == "html" else self.html if self.ended == "body" else self.at, node)

    ended = ""

    def start(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        self.newline = False
        if tag == "html":
            if self.html is None:
                self.need_html(attrs)
            else:
                self.more_attrs(self.html, attrs)
            return
        if self.phase != "body" and not self.stack.open.get("template"):
            if tag == "head":
                if self.head is None:
                    self.need_head(attrs)
                return
            if tag in HEAD or (tag == "noscript" and self.phase != "after head"):
                if self.phase == "before":
                    self.need_head()
                if self.phase == "after head":
                    self.stack.append(self.head)
                    self.insert(tag, attrs)
                    self.stack.remove(self.head)
                else:
                    self.insert(tag, attrs)
                if tag in VOID:
                    self.stack.pop()
                return
            if tag == "body":
                self.need_body(attrs)
                return
            self.need_body()
        elif tag in ("head", "body"):
            if tag == "body" and self.body is not None:
                self.more_attrs(self.body, attrs)
            return
        self.ended = ""
        if self.at.tag in ("table", "tbody", "tfoot", "thead", "tr") or tag in TABLE_PARTS:
            if self.in_table(tag, attrs):
                return
        self.in_body(tag, attrs)
        self.fostering = False

    @staticmethod
    def more_attrs(e: Element, attrs) -> None:
        known = {k for k, _ in e.attrs}
        e.attrs += [(k, v) for k, v in attrs if k not in known]

    def in_table(self, tag: str, attrs) -> bool:
        """Whether the start tag was dealt with by the table rules."""
        if tag in TABLE_PARTS:
            if self.stack.open.get("template") and not self.in_scope("table", only=frozenset({"template", "html"})):
                self.insert(tag, attrs)
                if tag == "col":
                    self.stack.pop()
                return True
            if not self.in_scope("table", only=frozenset({"html", "template"})):
                return True  # a part without table is ignored
            if tag in ("td", "th"):
                self.clear("tr", "tbody", "thead", "tfoot", "table")
                if self.at.tag == "table":
                    self.insert("tbody")
                if self.at.tag != "tr":
                    self.insert("tr")
                self.insert(tag, attrs)
                self.active.append(None)
            elif tag == "tr":
                self.clear("tbody", "thead", "tfoot", "table")
                if self.at.tag == "table":
                    self.insert("tbody")
                self.insert(tag, attrs)
            elif tag == "col":
                self.clear("colgroup", "table")
                if self.at.tag != "colgroup":
                    self.insert("colgroup")
                self.insert(tag, attrs)
                self.stack.pop()
            else:
                self.clear("table")
                self.insert(tag, attrs)
                if tag == "caption":
                    self.active.append(None)
            return True
        if tag == "table":
            self.pop_to("table")
            return False
        if tag in ("script", "style", "template"):
            self.insert(tag, attrs)
            return True
        if tag == "input" and dict(attrs).get("type", "").lower() == "hidden":
            self.insert(tag, attrs)
            self.stack.pop()
            return True
        if tag == "form":
            if self.form is None:
                self.form = self.insert(tag, attrs)
                self.stack.pop()
            return True
        self.fostering = True
        return False

    def clear(self, *tags: str) -> None:
        """Pops to one of the tags; leaving a cell or caption forgets its formatting."""
        while self.at.tag not in tags and self.at.tag not in ("html", "template"):
            if self.stack.pop().tag in ("td", "th", "caption"):
                self.forget_to_marker()

    def in_body(self, tag: str, attrs) -> None:
        if tag in HEAD:
            self.insert(tag, attrs)
            if tag in VOID:
                self.stack.pop()
            if tag == "template":
                self.active.append(None)
            return
        if tag in ("li", "dd", "dt"):
            for e in reversed(self.stack) if any(map(self.stack.open.get, ("li",) if tag == "li" else ("dd", "dt"))) else ():
                if e.tag == tag or (tag != "li" and e.tag in ("dd", "dt")):
                    self.imply(e.tag)
                    self.pop_to(e.tag)
                    break
                if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                    break
        if tag in CLOSES_P and not (tag == "form" and self.form is not None):
            self.close_p()
        if tag in HEADINGS and self.at.tag in HEADINGS:
            self.stack.pop()
        if tag == "form":
            if self.form is not None and not self.stack.open.get("template"):
                return
            self.form = self.insert(tag, attrs)
            return
        if tag in ("pre", "listing", "textarea"):
            self.insert(tag, attrs)
            self.newline = True
            return
        if tag == "a":
            for f in reversed(self.active):
                if f is None:
                    break
                if f.tag == "a":
                    self.adopt("a")
                    if f in self.active:
                        self.active.remove(f)
                    if f in self.stack:
                        self.stack.remove(f)
                    break
        if tag == "button" and self.in_scope("button"):
            self.imply()
            self.pop_to("button")
        if tag == "select" and self.in_scope("select"):
            self.pop_to("select")
            return
        if tag in ("option", "optgroup"):
            if self.at.tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.at.tag == "optgroup":
                self.stack.pop()
        if tag in FORMAT:
            self.rebuild()
            if tag == "nobr" and self.in_scope("nobr"):
                self.adopt("nobr")
                self.rebuild()
            self.remember(self.insert(tag, attrs))
            return
        if tag in ("rb", "rtc", "rp", "rt") and self.in_scope("ruby"):
            self.imply("rtc" if tag in ("rp", "rt") else "")
        if tag not in CLOSES_P:
            self.rebuild()
        self.insert("img" if tag == "image" else tag, attrs)
        if tag in VOID or tag == "image":
            self.stack.pop()
        elif tag in ("applet", "marquee", "object"):
            self.active.append(None)

    def end(self, tag: str) -> None:
        self.newline = False
        if self.phase != "body":
            if tag == "head":
                self.leave_head()
                return
            if tag in ("body", "html", "br"):
                self.need_body()
                if tag != "br":
                    self.ended = tag
                    return
            elif self.at.tag == tag and tag != "html":
                self.stack.pop()
                return
            else:
                return
        if tag in ("body", "html"):
            self.ended = tag
            return
        if tag == "br":
            self.in_body("br", [])
        elif tag == "p":
            if not self.in_scope("p", more=frozenset({"button"})):
                self.insert("p")
            self.close_p()
        elif tag in ("li", "dd", "dt"):
            if self.in_scope(tag, more=frozenset({"ol", "ul"}) if tag == "li" else frozenset()):
                self.imply(tag)
                self.pop_to(tag)
        elif tag in HEADINGS:
            if self.in_scope(*HEADINGS):
                self.imply()
                self.pop_to(*HEADINGS)
        elif tag in FORMAT:
            self.adopt(tag)
        elif tag == "form":
            form, self.form = self.form, None
            if form is not None and form in self.stack:
                self.imply()
                self.stack.remove(form)
        elif tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"):
            if self.in_scope(tag, only=frozenset({"html", "template"} | ({"table"} if tag != "table" else set()))):
                self.clear(tag)
                if self.at.tag == tag:
                    self.stack.pop()
                    if tag in ("td", "th", "caption"):
                        self.forget_to_marker()
        elif tag in BLOCK_ENDS or tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self.imply()
                self.pop_to(tag)
                if tag in ("applet", "marquee", "object"):
                    self.forget_to_marker()
        elif tag == "template":
            if self.stack.open.get("template"):
                self.pop_to("template")
                self.forget_to_marker()
        elif tag == "select":
            if self.in_scope("select"):
                self.pop_to("select")
        else:
            self.other_end(tag)


def attributes(source: str) -> list[tuple[str, str]]:
    """Names and values in source order; of equal names the first."""
    if not source:
        return []
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        out.setdefault(name.lower(), decode_attribute(a or b or c))
    return list(out.items())


def build(html: str, seconds: float | None = None) -> Element:
    b = Builder()
    until = None if seconds is None else monotonic() + seconds
    html = html.replace("\r\n", "\n").replace("\r", "\n")
    if html.startswith("﻿"):
        html = html[1:]
    at, size, turn = 0, len(html), 0
    while at < size:
        turn += 1
        if until is not None and not turn & 255 and monotonic() > until:
            raise ParseTimeout(at, size)
        m = _TOKEN.match(html, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            b.text(entities.unescape(text).replace("\0", "") if "&" in text else text.replace("\0", ""))
        elif m["tag"] is not None:
            tag = m["tag"].lower()
            if m["end"]:
                b.end(tag)
                continue
            depth = len(b.stack)
            b.start(tag, attributes(m["attrs"]))
            if (tag in RAW or tag in ESCAPABLE) and b.at.tag == tag:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                raw = html[at : close.start() if close else size]
                if tag == "textarea" and raw.startswith("\n"):
                    raw = raw[1:]
                if tag in ESCAPABLE:
                    raw = entities.unescape(raw)
                if raw:
                    _put(b.at, Element("text", data=raw))
                b.newline = False
                b.stack.pop()
                at = close.end() if close else size
            elif tag == "plaintext" and len(b.stack) > depth:
                if at < size:
                    _put(b.at, Element("text", data=html[at:]))
                at = size
        elif m["comment"] is not None:
            b.comment(m["comment"])
        elif m["doctype"] is not None:
            if b.html is None and not any(k.kind == "doctype" for k in b.doc.kids):
                _put(b.doc, Element("doctype", data=m["doctype"].strip().split(" ")[0].lower() if m["doctype"].strip() else ""))
        elif m["bogus"] is not None:
            b.comment(m["bogus"][1:] if m["bogus"][0] in "!/" else m["bogus"])
        elif m["cut"] is not None:
            break
    b.need_body()
    return b.doc


class Document:
    """Columns of nodes in document order."""

    __slots__ = ("parent", "end", "depth", "kind", "tag", "attrs", "data", "_ids")

    def __init__(self) -> None:
        self.parent, self.end, self.depth, self.kind, self.tag, self.attrs, self.data = [], [], [], [], [], [], []
        self._ids = None

    def __len__(self) -> int:
        return len(self.kind)

    def children(self, at: int):
        k, end = at + 1, self.end[at]
        while k < end:
            yield k
            k = self.end[k]

    def attr(self, at: int, name: str) -> str | None:
        for k, v in self.attrs[at]:
            if k == name:
                return v
        return None

    def string(self, at: int) -> str:
        """All text below a node, as XPath has it; attributes and comments have their own."""
        if self.kind[at] in ("text", "comment"):
            return self.data[at]
        return "".join(self.data[i] for i in range(at + 1, self.end[at]) if self.kind[i] == "text")

    def readable(self, at: int, separator: str = "", strip: bool = False) -> str:
        """Text without that of scripts, styles and templates below the node."""
        if self.kind[at] in ("text", "comment"):
            return self.data[at].strip() if strip else self.data[at]
        out, i, end = [], at + 1, self.end[at]
        while i < end:
            if self.kind[i] == "element" and self.tag[i] in ("script", "style", "template"):
                i = self.end[i]
                continue
            if self.kind[i] == "text":
                piece = self.data[i].strip() if strip else self.data[i]
                if piece or not strip:
                    out.append(piece)
            i += 1
        return separator.join(out)

    def outer(self, at: int) -> str:
        """HTML of a node."""
        out: list[str] = []
        todo: list = [at]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
                continue
            kind = self.kind[n]
            if kind == "text":
                above = self.tag[self.parent[n]] if self.parent[n] >= 0 else ""
                out.append(self.data[n] if above in RAW or above == "plaintext" else _escape(self.data[n]))
            elif kind == "comment":
                out.append(f"<!--{self.data[n]}-->")
            elif kind == "doctype":
                out.append(f"<!DOCTYPE {self.data[n]}>")
            else:
                if kind == "element":
                    out.append("<" + self.tag[n] + "".join(f' {k}="{_escape(v, True)}"' for k, v in self.attrs[n]) + ">")
                    if self.tag[n] in VOID:
                        continue
                    todo.append(f"</{self.tag[n]}>")
                todo += reversed(list(self.children(n)))
        return "".join(out)


def _escape(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("\xa0", "&nbsp;")
    return text.replace('"', "&quot;") if attribute else text.replace("<", "&lt;").replace(">", "&gt;")


def parse(html: str | None, seconds: float | None = None) -> Document:
    """The document of an HTML text; null counts as empty. Raises ParseTimeout after so many seconds."""
    root = build(html or "", seconds)
    doc = Document()
    todo: list = [(root, -1, 0)]
    while todo:
        node, parent, depth = todo.pop()
        if node is None:
            doc.end[parent] = len(doc.kind)
            continue
        at = len(doc.kind)
        doc.parent.append(parent)
        doc.end.append(at + 1)
        doc.depth.append(depth)
        doc.kind.append(node.kind)
        doc.tag.append(node.tag)
        doc.attrs.append(node.attrs)
        doc.data.append(node.data)
        if node.kids:
            todo.append((None, at, 0))
            todo += [(k, at, depth + 1) for k in reversed(node.kids)]
    return doc
