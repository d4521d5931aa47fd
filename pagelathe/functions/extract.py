"""Fields and items, conversions, metadata, forms, and search in the manner of Beautiful Soup."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import urlencode

from . import css, urls, xpath
from .html import Document

# conversions

_INT = re.compile(r"[+-]?[0-9]+", re.A)
_FLOAT = re.compile(r"[+-]?(?:inf(?:inity)?|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)", re.I | re.A)
YES, NO = frozenset({"true", "yes", "on", "1"}), frozenset({"false", "no", "off", "0"})


class Invalid(ValueError):
    """A text that a conversion refuses."""


def convert(text: str, kind: str | None):
    text = text.strip()
    if kind == "int" and _INT.fullmatch(text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    if kind == "float" and _FLOAT.fullmatch(text):
        return float(text)
    if kind == "bool" and text.lower() in YES | NO:
        return text.lower() in YES
    if kind in (None, "str"):
        return text
    raise Invalid(text)


class Field(NamedTuple):
    """A named query: the first result, or all; then a pattern (its first group), stripping, a conversion, a default."""

    name: str
    css: str | None = None
    xpath: str | None = None
    re: str | None = None
    all: bool = False
    strip: bool = True
    into: str | Callable | None = None
    default: object = None

    def values(self, doc: Document, scope: int = 0) -> list[str]:
        hits = css.select(doc, self.css, scope) if self.css is not None else xpath.select(doc, self.xpath, scope)
        return [h.value for h in hits]


def field_value(f: Field, doc: Document, scope: int = 0) -> tuple[object, str | None]:
    """(value, the text that was refused or None)."""
    out, refused = [], None
    for text in f.values(doc, scope):
        if f.re is not None:
            m = re.search(f.re, text)
            if m is None:
                continue
            text = (m[1] or "") if m.re.groups else m[0]
        text = text.strip() if f.strip else text
        try:
            value = f.into(text) if callable(f.into) else convert(text, f.into) if f.into else text
        except Exception:
            value, refused = None, text
        out.append(value)
        if not f.all:
            break
    if f.all:
        return out, refused
    return (out[0] if out else f.default), refused


def item(fields: list[Field], doc: Document, scope: int = 0) -> tuple[dict, list[str]]:
    """(values in the order of fields, names of those refused)."""
    found = {f.name: field_value(f, doc, scope) for f in fields}
    return {k: v for k, (v, _) in found.items()}, [k for k, (_, bad) in found.items() if bad is not None]


def regex_all(text: str, pattern: str, replace_entities: bool = True) -> list[str]:
    """Whole matches, or all groups in turn, or the group `extract` of the first match."""
    p = re.compile(pattern)
    if "extract" in p.groupindex:
        m = p.search(text)
        found = [m["extract"]] if m and m["extract"] is not None else []
    else:
        found = [g or "" for m in p.finditer(text) for g in (m.groups() or (m[0],))]
    return [re.sub(r"&(?!(?:lt|amp);)#?\w+;", lambda m: entities.unescape(m[0]), x) for x in found] if replace_entities else found


def base_url(doc: Document, url: str | None) -> str | None:
    hits = css.select(doc, "base[href]::attr(href)")
    return urls.resolve(url, hits[0].value) or url if hits else url


def links(doc: Document, url: str | None, selector: str = "a") -> list[tuple[int, str, str | None]]:
    """(ord, href, absolute URL) of the elements with href, and of strings as they are."""
    base, out = base_url(doc, url), []
    for h in css.select(doc, selector):
        href = doc.attr(h.ord, "href") if h.is_node and doc.kind[h.ord] == "element" else h.value
        if href is not None:
            out.append((h.ord, href, urls.resolve(base, href)))
    return out


# metadata

_GRAPH = ("og:", "article:", "product:", "book:", "profile:", "music:", "video:", "fb:")


def json_ld(doc: Document) -> list:
    out = []
    for i in range(len(doc)):
        if doc.tag[i] == "script" and (doc.attr(i, "type") or "").partition(";")[0].strip().lower() == "application/ld+json":
            text = re.sub(r"^\s*(?:<!--|(?://\s*)?<!\[CDATA\[)|(?:-->|(?://\s*)?\]\]>)\s*$", "", doc.string(i))
            try:
                value = json.loads(text)
            except ValueError:
                continue
            out += value if isinstance(value, list) else [value]
    return out


def meta_maps(doc: Document) -> dict[str, dict[str, list[str]]]:
    out: dict[str, dict[str, list[str]]] = {"opengraph": {}, "twitter": {}, "dublin_core": {}}
    for i in range(len(doc)):
        if doc.tag[i] != "meta" or doc.attr(i, "content") is None:
            continue
        for key in ((doc.attr(i, "property") or "").strip().lower(), (doc.attr(i, "name") or "").strip().lower()):
            section = "opengraph" if key.startswith(_GRAPH) else "twitter" if key.startswith("twitter:") else "dublin_core" if key.startswith(("dc.", "dcterms.")) else None
            if section:
                out[section].setdefault(key, []).append(doc.attr(i, "content"))
                break
    return out


_URL_TAGS = {"a": "href", "area": "href", "link": "href", "audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src", "track": "src", "video": "src", "object": "data"}


def microdata(doc: Document, base: str | None = None) -> list[dict]:
    ids: dict[str, int] = {}
    for i in range(len(doc)):
        own = doc.attr(i, "id") if doc.kind[i] == "element" else None
        if own:
            ids.setdefault(own, i)

    def value(i: int, path: frozenset):
        if doc.attr(i, "itemscope") is not None:
            return None if i in path else read(i, path)
        tag = doc.tag[i]
        if tag in _URL_TAGS:
            raw = doc.attr(i, _URL_TAGS[tag]) or ""
            return urls.resolve(base, raw) or raw
        for tags, name in ((("meta",), "content"), (("data", "meter"), "value"), (("time",), "datetime")):
            if tag in tags and doc.attr(i, name) is not None:
                return doc.attr(i, name)
        return doc.string(i)

    def read(i: int, path: frozenset) -> dict:
        out: dict = {}
        types = (doc.attr(i, "itemtype") or "").split()
        if types:
            out["type"] = types[0] if len(types) == 1 else types
        if doc.attr(i, "itemid") is not None:
            out["id"] = urls.resolve(base, doc.attr(i, "itemid")) or doc.attr(i, "itemid")
        properties: dict[str, list] = {}
        todo = [k for k in doc.children(i)] + [ids[r] for r in (doc.attr(i, "itemref") or "").split() if r in ids and ids[r] != i]
        seen: set[int] = {i}
        found = []
        while todo:
            k = todo.pop(0)
            if k in seen or doc.kind[k] != "element":
                continue
            seen.add(k)
            if doc.attr(k, "itemprop"):
                found.append(k)
            if doc.attr(k, "itemscope") is None:
                todo = list(doc.children(k)) + todo
        for k in sorted(found):
            v = value(k, path | {i})
            if v is not None:
                for name in doc.attr(k, "itemprop").split():
                    properties.setdefault(name, []).append(v)
        out["properties"] = {k: v[0] if len(v) == 1 else v for k, v in properties.items()}
        return out

    return [read(i, frozenset()) for i in range(len(doc)) if doc.kind[i] == "element" and doc.attr(i, "itemscope") is not None and doc.attr(i, "itemprop") is None]


# forms


class Form(NamedTuple):
    method: str
    action: str | None
    enctype: str
    fields: list[tuple[str, str]]

    def _pairs(self) -> list[tuple[str, str]]:
        crlf = lambda t: re.sub(r"\r\n|\r|\n", "\r\n", t)
        return [(crlf(k), crlf(v)) for k, v in self.fields]

    def encoded(self) -> str:
        return urlencode(self._pairs())

    def sent(self, boundary: str | None = None) -> tuple[str | None, str | None, bytes | None]:
        """(URL, content type, body) of the form's request; the boundary of multipart forms is made of their fields if none is given."""
        if self.method == "get":
            url = urls.join(None, self.action)
            return (None if url is None else str(url._replace(query=self.encoded() or None))), None, None
        if self.enctype == "text/plain":
            return self.action, "text/plain", "".join(f"{k}={v}\r\n" for k, v in self._pairs()).encode()
        if self.enctype != "multipart/form-data":
            return self.action, "application/x-www-form-urlencoded", self.encoded().encode()
        mark = boundary or "form-" + hashlib.sha256(repr(self.fields).encode()).hexdigest()[:32]
        quoted = lambda name: name.replace("\r\n", "%0D%0A").replace('"', "%22")
        parts = "".join(f'--{mark}\r\nContent-Disposition: form-data; name="{quoted(k)}"\r\n\r\n{v}\r\n' for k, v in self._pairs())
        return self.action, f"multipart/form-data; boundary={mark}", (parts + f"--{mark}--\r\n").encode()


def payload(method: str, form=None, data=None, body: bytes | str | None = None) -> dict:
    """How a request is sent: method, kind (navigate, form or fetch), content_type and body, of at most one of a form, JSON data and a raw body."""
    if sum(x is not None for x in (form, data, body)) > 1:
        raise ValueError("a request carries one of form, data and body")
    method = method.upper()
    out = {"method": method, "kind": "navigate" if method == "GET" else "fetch", "content_type": None, "body": None}
    if form is data is body is None:
        return out
    if method in ("GET", "HEAD"):
        raise ValueError(f"a {method} carries no body")
    if form is not None:
        pairs = list(form.items()) if hasattr(form, "items") else list(form)
        return out | {"kind": "form", "content_type": "application/x-www-form-urlencoded", "body": urlencode(pairs, doseq=True).encode()}
    if data is not None:
        return out | {"content_type": "application/json", "body": json.dumps(data, separators=(",", ":"), ensure_ascii=False).encode()}
    return out | {"body": body.encode() if isinstance(body, str) else bytes(body)}


def form(doc: Document, url: str | None = None, query: str = "form", number: int = 0, data: dict | None = None, click: str | None = None) -> Form | None:
    """The form that a query finds, with its successful controls, changed by data (None takes a field away)."""
    found = [h.ord for h in css.select(doc, query) if doc.tag[h.ord] == "form"]
    if number >= len(found):
        return None
    at = found[number]
    own = doc.attr(at, "id")
    fields: list[tuple[str, str]] = []
    overrides = {}

    def disabled(i: int) -> bool:
        if doc.attr(i, "disabled") is not None:
            return True
        below, k = i, doc.parent[i]
        while k >= 0:
            if doc.tag[k] == "fieldset" and doc.attr(k, "disabled") is not None:
                legend = next((c for c in doc.children(k) if doc.tag[c] == "legend"), None)
                if legend is None or below != legend:
                    return True
            below, k = k, doc.parent[k]
        return False

    buttons = 0
    for i in range(len(doc)):
        if doc.kind[i] != "element" or doc.tag[i] not in ("input", "select", "textarea", "button"):
            continue
        owner = doc.attr(i, "form")
        if (owner != own if owner is not None else not at < i < doc.end[at]) or disabled(i):
            continue
        name, tag, kind = doc.attr(i, "name") or "", doc.tag[i], (doc.attr(i, "type") or ("submit" if doc.tag[i] == "button" else "text")).lower()
        if tag == "button" or kind in ("submit", "image", "button", "reset"):
            if kind in ("submit", "image") and (name == click if click is not None else buttons == 0):
                buttons += 1
                overrides = {k: doc.attr(i, f"form{k}") for k in ("method", "action", "enctype")}
                if name:
                    fields.append((name, doc.attr(i, "value") or ""))
            continue
        if not name:
            continue
        if tag == "select":
            options = [k for k in range(i + 1, doc.end[i]) if doc.tag[k] == "option"]
            chosen = [k for k in options if doc.attr(k, "selected") is not None]
            if doc.attr(i, "multiple") is None:
                chosen = chosen[-1:] or [k for k in options if doc.attr(k, "disabled") is None][:1]
            for k in chosen:
                if doc.attr(k, "disabled") is None:
                    v = doc.attr(k, "value")
                    fields.append((name, v if v is not None else " ".join(doc.string(k).split())))
        elif tag == "textarea":
            fields.append((name, doc.string(i)))
        elif kind in ("checkbox", "radio"):
            if doc.attr(i, "checked") is not None:
                fields.append((name, doc.attr(i, "value") if doc.attr(i, "value") is not None else "on"))
        elif kind != "file":
            fields.append((name, doc.attr(i, "value") or ""))
    for k, v in (data or {}).items():
        where = next((n for n, (name, _) in enumerate(fields) if name == k), len(fields))
        fields = [f for f in fields if f[0] != k]
        for n, one in enumerate([] if v is None else v if isinstance(v, list) else [v]):
            fields.insert(min(where + n, len(fields)), (k, str(one)))
    method = (overrides.get("method") or doc.attr(at, "method") or "get").lower()
    action = overrides.get("action") or doc.attr(at, "action") or url
    enctype = overrides.get("enctype") or doc.attr(at, "enctype") or "application/x-www-form-urlencoded"
    return Form(method if method in ("get", "post", "dialog") else "get", urls.resolve(base_url(doc, url), action), enctype.lower(), fields)


# search in the manner of Beautiful Soup

_MANY = frozenset("class rel rev accept-charset headers accesskey dropzone".split())
DIRECTIONS = ("descendants", "children", "parents", "next_siblings", "previous_siblings", "next_elements", "previous_elements")


def along(doc: Document, at: int, direction: str) -> list[int]:
    """Nodes in a direction, nearest first; the element directions follow document order alone."""
    if direction == "descendants":
        return list(range(at + 1, doc.end[at]))
    if direction == "children":
        return list(doc.children(at))
    if direction == "parents":
        return [n for n, _ in xpath.axis(doc, (at, 0), "ancestor")]
    if direction in ("next_siblings", "previous_siblings"):
        return [n for n, _ in xpath.axis(doc, (at, 0), "following-sibling" if direction[0] == "n" else "preceding-sibling")]
    return list(range(at + 1, len(doc))) if direction == "next_elements" else list(range(at - 1, -1, -1))


def accepts(wanted, value: str | None) -> bool:
    """A filter: a string, True, False or None, a pattern, a function, or a list of these."""
    if callable(wanted):
        return bool(wanted(value))
    if isinstance(wanted, bool) or wanted is None:
        return (value is not None) is bool(wanted)
    if isinstance(wanted, re.Pattern):
        return value is not None and wanted.search(value) is not None
    if isinstance(wanted, (list, tuple, set, frozenset)):
        return any(accepts(w, value) for w in wanted)
    return value == str(wanted)


def only_string(doc: Document, at: int) -> str | None:
    """The only text through a chain of single children."""
    while doc.kind[at] not in ("text", "comment"):
        kids = list(doc.children(at))
        if len(kids) != 1:
            return None
        at = kids[0]
    return doc.data[at]


def find_all(doc: Document, at: int = 0, name=None, attrs: dict | str | None = None, string=None, limit: int = 0, direction: str = "descendants", class_=None, **more) -> list[int]:
    """Nodes that pass all filters; with only a string filter, text nodes."""
    if limit and limit < 0:
        raise ValueError("limit is negative")
    wanted = dict(attrs) if isinstance(attrs, dict) else {} if attrs is None else {"class": attrs}
    wanted |= ({"class": class_} if class_ is not None else {}) | more
    out = []
    for i in along(doc, at, direction):
        if name is None and not wanted and string is not None:
            ok = doc.kind[i] == "text" and accepts(string, doc.data[i])
        else:
            ok = doc.kind[i] == "element" and (name is None or name is True or accepts(name, doc.tag[i]))
            for key, w in wanted.items():
                value = doc.attr(i, key) if ok else None
                ok = ok and (accepts(w, value) or (key in _MANY and value is not None and any(accepts(w, t) for t in value.split())))
            ok = ok and (string is None or accepts(string, only_string(doc, i)))
        if ok:
            out.append(i)
            if limit and len(out) == limit:
                break
    return out
