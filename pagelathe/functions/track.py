"""What an element is known by, and finding it again after a redesign."""

from __future__ import annotations

import json
import re
from collections import Counter
from typing import NamedTuple

from . import css, xpath
from .html import Document

#: What each kind of evidence counts, the score that counts as the same, and how much is kept.
TEXT, ATTRS, PRECEDING, PATH, PARENT, SIBLINGS = 0.45, 0.15, 0.15, 0.10, 0.10, 0.05
THRESHOLD = 0.75
TEXT_KEPT, SIBLINGS_KEPT, NODES_BACK = 120, 32, 200
FAMILIES = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "h"), "strong": "b", "em": "i"}


class Print(NamedTuple):
    tag: str
    text: str
    classes: str
    id: str | None
    names: list[str]
    path: list[str]
    siblings: list[str]
    parent_tag: str | None
    parent_class: str
    preceding: str
    text_varies: bool = False
    preceding_varies: bool = False

    def to_json(self) -> str:
        return json.dumps(self._asdict(), ensure_ascii=False, sort_keys=True)


def from_json(text: str | None) -> Print | None:
    """None for what is no fingerprint."""
    try:
        return Print(**json.loads(text or ""))
    except (ValueError, TypeError):
        return None


def family(tag: str) -> str:
    return FAMILIES.get(tag, tag)


def _clip(text: str) -> str:
    return " ".join(text.split())[:TEXT_KEPT]


def print_of(doc: Document, at: int) -> Print:
    """The fingerprint of an element."""
    above = doc.parent[at]
    path, up = [], above
    while up >= 0:
        if doc.kind[up] == "element":
            path.append(doc.tag[up])
        up = doc.parent[up]
    inside = above >= 0 and doc.kind[above] == "element"
    beside = [doc.tag[k] for k in doc.children(above) if k != at and doc.kind[k] == "element"][:SIBLINGS_KEPT] if inside else []
    text, size = [], 0
    for k in range(at + 1, doc.end[at]):
        if doc.kind[k] == "text":
            text.append(doc.data[k])
            size += len(doc.data[k].encode())
            if size > 4 * TEXT_KEPT:
                break
    before = next((doc.data[k] for k in range(at - 1, max(-1, at - 1 - NODES_BACK), -1) if doc.kind[k] == "text" and doc.data[k].strip()), "")
    return Print(
        doc.tag[at],
        _clip("".join(text)),
        doc.attr(at, "class") or "",
        doc.attr(at, "id"),
        sorted(k for k, _ in doc.attrs[at]),
        path[::-1],
        beside,
        doc.tag[above] if inside else None,
        (doc.attr(above, "class") or "") if inside else "",
        _clip(before),
    )


def learned(now: Print, previous: Print | None) -> Print:
    """A new fingerprint of an element with what differed from earlier ones: that it varies is never forgotten."""
    if previous is None:
        return now
    return now._replace(text_varies=previous.text_varies or now.text != previous.text, preceding_varies=previous.preceding_varies or now.preceding != previous.preceding)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein's distance, a column at a time in the bits of one number."""
    if not a or not b:
        return len(a) or len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    more, less, out = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up = less | (full & ~(across | more))
        low = more & across
        out += bool(up & last) - bool(low & last)
        up = (up << 1 | 1) & full
        more = (low << 1 & full) | (full & ~(down | up))
        less = up & down
    return out


def ratio(a: str, b: str) -> float:
    return 1 - edit_distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def lcs_ratio(a: list, b: list) -> float:
    """Twice the length of the longest common subsequence over the lengths of both."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def jaccard(a: list, b: list) -> float:
    """Of lists with repeats."""
    if not a and not b:
        return 1.0
    x, y = Counter(a), Counter(b)
    return (x & y).total() / (x | y).total()


def trigrams(text: str) -> set[str]:
    plain = "".join(filter(str.isalnum, text.lower()))
    return {plain[i : i + 3] for i in range(len(plain) - 2)}


def trigram_ratio(a: str, b: str) -> float:
    x, y = trigrams(a), trigrams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def shape(text: str) -> str:
    return re.sub("[0-9]", "0", text)


def score(known: Print, other: Print) -> float:
    """How much `other` looks like a known element, 0 to 1."""
    alone = lambda a, b, measure: 0.5 if bool(a) != bool(b) else measure(a, b)  # noqa: E731  what one side lacks says nothing
    label = ratio(known.preceding, other.preceding)
    if not known.preceding_varies and known.preceding and other.preceding and label < 0.5:
        return 0.0  # another label: another field
    shapes = ratio(shape(known.text), shape(other.text))
    ids = 1.0 if known.id == other.id else 0.5 if known.id is None or other.id is None else ratio(known.id, other.id)
    parts = (
        (TEXT, shapes if known.text_varies else max(ratio(known.text, other.text), 0.85 * shapes)),
        (ATTRS, 0.5 * trigram_ratio(known.classes, other.classes) + 0.25 * ids + 0.25 * jaccard(known.names, other.names)),
        (PRECEDING, 0.5 if known.preceding_varies else alone(known.preceding, other.preceding, ratio)),
        (PATH, lcs_ratio(known.path, other.path)),
        (PARENT, 0.5 * (known.parent_tag == other.parent_tag) + 0.5 * alone(known.parent_class, other.parent_class, trigram_ratio)),
        (SIBLINGS, jaccard(known.siblings, other.siblings)),
    )
    return sum(w * x for w, x in parts) * (1 if known.tag == other.tag else 0.95)


def _kin(doc: Document, known: Print, scope: int = 0) -> list[int]:
    return [i for i in range(scope + 1, doc.end[scope]) if doc.kind[i] == "element" and family(doc.tag[i]) == family(known.tag)]


def still_repeated(doc: Document, known: Print, scope: int = 0) -> bool:
    """Whether two or more elements of the kind still have all classes: a list, in which this one's element is just missing."""
    wanted = set(known.classes.split())
    return bool(wanted) and sum(wanted <= set((doc.attr(i, "class") or "").split()) for i in _kin(doc, known, scope)) >= 2


def best(doc: Document, known: Print, scope: int = 0) -> tuple[int, float] | None:
    """(element, score) of the element of the kind most like a known one, the last of equals."""
    found = max(((score(known, print_of(doc, i)), i) for i in _kin(doc, known, scope)), default=None)
    return (found[1], found[0]) if found else None


def relocate(known: Print, doc: Document, least: float = THRESHOLD, scope: int = 0) -> tuple[int, float] | None:
    if still_repeated(doc, known, scope):
        return None
    found = best(doc, known, scope)
    return found if found and found[1] >= least else None


_CSS_END = re.compile(r"(.*?)\s*(::(?:text|attr\([^)]*\)))\s*", re.S)
_XPATH_END = re.compile(r"(.*?)(//?)(text\(\)|@[\w:.*-]+)\s*", re.S)


def _lists(query: str) -> bool:
    """Whether a CSS query has a comma outside of brackets and quotes."""
    plain = re.sub(r"\"[^\"]*\"|'[^']*'", "", query)
    while plain != (plain := re.sub(r"\([^()]*\)|\[[^\[\]]*\]", "", plain)):
        pass
    return "," in plain


class Tracker:
    """A query that is followed under a name: the part that finds an element, and the ending that takes a value from it."""

    def __init__(self, name: str, query: str):
        self.name, self.query = name, query
        self.kind = xpath if query.startswith(("/", "(", "xpath:")) else css
        plain = query.removeprefix("xpath:")
        if self.kind is css and _lists(plain):
            raise ValueError(f"track {name!r}: one selector can be followed, not a list: {query!r}")
        m = (_CSS_END if self.kind is css else _XPATH_END).fullmatch(plain)
        self.whole, self.element = plain, m[1] if m else plain
        self.ending = None if not m else m[2] if self.kind is css else (f".//{m[3]}" if m[2] == "//" else m[3])
        if not self.element.strip():
            raise ValueError(f"track {name!r}: an element is needed, not just {query!r}")
        for q in (self.whole, self.element):
            self.kind.compiled(q)

    def _values(self, doc: Document, at: int) -> list[str]:
        if self.ending is None:
            return [doc.outer(at)]
        if self.kind is css:
            if self.ending == "::text":
                return [doc.data[k] for k in doc.children(at) if doc.kind[k] == "text"]
            value = doc.attr(at, self.ending[7:-1].strip())
            return [] if value is None else [value]
        return [h.value for h in xpath.select(doc, self.ending, at)]

    def run(self, doc: Document, known: Print | None, least: float = THRESHOLD) -> tuple[str, float | None, list[str], Print | None]:
        """(state, score, values, fingerprint of the element if the query matched): matched, relocated, lost or unknown."""
        hits = self.kind.select(doc, self.element)
        found = next((h.ord for h in hits if h.is_node and doc.kind[h.ord] == "element"), None)
        if hits and found is None:
            raise xpath.XPathError(f"track {self.name!r}: the query finds no element")
        if found is not None:
            return "matched", None, [h.value for h in self.kind.select(doc, self.whole)], learned(print_of(doc, found), known)
        if known is None:
            return "unknown", None, [], None
        if still_repeated(doc, known):
            return "lost", 0.0, [], None
        like = best(doc, known)
        if like is None or like[1] < least:
            return "lost", like[1] if like else 0.0, [], None
        return "relocated", like[1], self._values(doc, like[0]), None
