"""robots.txt, reservations of text and data mining, sitemaps, decoding and classification of responses."""

from __future__ import annotations

import gzip
import io
import json
import re
import zlib
from datetime import datetime, timezone
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

LARGEST_ROBOTS = 500 * 1024
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def normal_path(path: str) -> str:
    """Escapes of unreserved characters decoded, other escapes in upper case, what is not ASCII escaped."""

    def one(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if c in _UNRESERVED else "%" + m[1].upper()

    path = re.sub("%([0-9a-fA-F]{2})", one, path)
    return "".join(c if c.isascii() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in path)


def path_matches(pattern: str, path: str) -> bool:
    """A prefix with `*` for anything and a `$` at the end for the end."""
    anchored = pattern.endswith("$")
    parts = (pattern[:-1] if anchored else pattern).split("*")
    if not path.startswith(parts[0]):
        return False
    at = len(parts[0])
    for part in parts[1:-1] if anchored and len(parts) > 1 else parts[1:]:
        at = path.find(part, at)
        if at < 0:
            return False
        at += len(part)
    if not anchored:
        return True
    return at == len(path) if len(parts) == 1 else len(path) - len(parts[-1]) >= at and path.endswith(parts[-1])


class Robots:
    """Groups of a robots.txt: (agents, rules (allow, pattern), crawl delay), and its sitemaps."""

    def __init__(self, text: str | None, disallow_all: bool = False):
        self.groups: list[tuple[list[str], list[tuple[bool, str]], list[float]]] = []
        self.sitemaps: list[str] = []
        self.disallow_all = disallow_all
        open_group = False
        raw = (text or "").encode("utf-8", "replace")[:LARGEST_ROBOTS].decode("utf-8", "ignore")
        for line in raw.lstrip("﻿").splitlines():
            key, colon, value = line.partition("#")[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if not colon:
                continue
            if key == "user-agent":
                if not open_group:
                    self.groups.append(([], [], []))
                open_group = True
                self.groups[-1][0].append(value.lower())
            elif key == "sitemap":
                if value:
                    self.sitemaps.append(value)
            elif key in ("allow", "disallow", "crawl-delay"):
                open_group = False
                if self.groups and key == "crawl-delay":
                    try:
                        if float(value) >= 0:
                            self.groups[-1][2].append(float(value))
                    except ValueError:
                        pass
                elif self.groups and value:
                    self.groups[-1][1].append((key == "allow", normal_path(value)))

    def of(self, agent: str) -> list:
        name = re.match(r"[a-zA-Z_\-]*", agent)[0].lower() or agent.lower()
        named = [g for g in self.groups if name in (re.match(r"[a-z_\-]*", a)[0] or a for a in g[0])]
        return named or [g for g in self.groups if "*" in g[0]]

    def allowed(self, agent: str, path: str) -> bool:
        """The longest matching pattern decides, allow among equals."""
        if path.partition("?")[0] == "/robots.txt":
            return True
        if self.disallow_all:
            return False
        path = normal_path(path)
        best = max(((len(p), allow) for g in self.of(agent) for allow, p in g[1] if path_matches(p, path)), default=(0, True))
        return best[1]

    def crawl_delay(self, agent: str) -> float | None:
        return max((d for g in self.of(agent) for d in g[2]), default=None)


class Reservation(NamedTuple):
    reserved: bool | None
    policy: str | None


def tdm_file(text: str | None, path: str) -> Reservation:
    """The first rule of a tdmrep.json that matches; a file with an invalid rule says nothing."""
    try:
        rules = json.loads(text or "")
        ok = isinstance(rules, list) and all(isinstance(r, dict) and isinstance(r.get("location"), str) and type(r.get("tdm-reservation")) is int and r["tdm-reservation"] in (0, 1) and isinstance(r.get("tdm-policy", ""), str) for r in rules)
    except ValueError:
        ok = False
    if not ok:
        return Reservation(None, None)
    path = re.sub("%([0-9a-fA-F]{2})", lambda m: m[0].upper() if chr(int(m[1], 16)) in ":/?#[]@!$&'()*+,;=%" else chr(int(m[1], 16)), path)
    for r in rules:
        if path_matches(r["location"], path):
            return Reservation(bool(r["tdm-reservation"]), r.get("tdm-policy"))
    return Reservation(None, None)


def tdm_value(value: str | None, policy: str | None) -> Reservation:
    """What a header or meta pair says."""
    known = {"1": True, "0": False}.get((value or "").strip())
    return Reservation(known, policy if known is not None else None)


def tdm(text: str | None, path: str, header: tuple = (None, None), meta: tuple = (None, None)) -> Reservation:
    """The page's own say before the header's before the file's."""
    for r in (tdm_value(*meta), tdm_value(*header), tdm_file(text, path)):
        if r.reserved is not None:
            return r
    return Reservation(None, None)


class Entry(NamedTuple):
    loc: str
    lastmod: str | None
    changefreq: str | None
    priority: float | None
    alternates: list[str]


def sitemap(body: bytes | None, most: int = 50 << 20) -> tuple[str, list[Entry]]:
    """(kind, entries): kind is urlset, index, text or error. Entities are never expanded."""
    body = body or b""
    if body[:2] == b"\x1f\x8b":
        try:
            body = gzip.GzipFile(fileobj=io.BytesIO(body)).read(most + 1)
        except (OSError, EOFError, zlib.error):
            return "error", []
        if len(body) > most:
            return "error", []
    text = body.decode("utf-8-sig", "replace")
    plain = text.lstrip()
    if not plain.startswith("<"):
        found = [line.strip() for line in text.splitlines() if re.match(r"\s*https?://", line)]
        return ("text", [Entry(u, None, None, None, []) for u in found]) if found else ("error", [])
    if "<!ENTITY" in plain:
        return "error", []
    from xml.parsers import expat

    kind, entries, path, held, words = "", [], [], {}, []

    def start(tag: str, attrs: dict) -> None:
        nonlocal kind
        tag = tag.rpartition(":")[2]
        path.append(tag)
        words.clear()
        if len(path) == 1:
            kind = {"urlset": "urlset", "sitemapindex": "index"}.get(tag, "error")
        if tag in ("url", "sitemap") and len(path) == 2:
            held.clear()
            held["alternates"] = []
        if tag == "link" and len(path) == 3 and attrs.get("rel") == "alternate" and attrs.get("href"):
            held["alternates"].append(attrs["href"].strip())

    def end(tag: str) -> None:
        tag = path.pop()
        if len(path) == 2 and tag in ("loc", "lastmod", "changefreq", "priority"):
            held.setdefault(tag, "".join(words).strip())
        if len(path) == 1 and tag in ("url", "sitemap") and held.get("loc"):
            try:
                priority = float(held["priority"])
            except (KeyError, ValueError):
                priority = None
            entries.append(Entry(held["loc"], held.get("lastmod"), held.get("changefreq"), priority, list(held["alternates"])))

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, words.append
    try:
        parser.Parse(plain.encode("utf-8"), True)
    except expat.ExpatError:
        return "error", []
    return (kind, entries) if kind != "error" else ("error", [])


_CHARSETS = {"iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "gb2312": "gb18030", "gbk": "gb18030", "ks_c_5601-1987": "cp949", "shift_jis": "cp932", "utf8": "utf-8"}


def decode(body: bytes | None, content_type: str | None = None) -> str:
    """Byte order mark, then the header, then the document's own say, then UTF-8 if it is that, else windows-1252."""
    body = body or b""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    head = body[:1024]
    said = re.search(r"charset\s*=\s*[\"']?\s*([^\s\"';]+)", content_type or "", re.I)
    name = said[1] if said else None
    if not known(name):
        m = re.search(rb"<\?xml[^>]*encoding\s*=\s*[\"']([^\"']+)", head) or re.search(rb"<meta[^>]*charset\s*=\s*[\"']?\s*([^\s\"'/>;]+)", head, re.I)
        name = m[1].decode("ascii", "replace") if m else None
        if name and name.lower().startswith("utf-16"):
            name = "utf-8"
    if known(name):
        return body.decode(_CHARSETS.get(name.lower(), name), "replace")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


def known(name: str | None) -> bool:
    try:
        return bool(name) and isinstance(b"".decode(_CHARSETS.get(name.lower(), name)), str)
    except (LookupError, ValueError):
        return False


def meta_content(body: bytes | None, name: str) -> str | None:
    """The content of the first meta of a name in the first 64 KiB."""
    for tag in re.findall(rb"<meta\b[^>]*>", (body or b"")[:65536], re.I):
        pairs = {k.lower(): a or b or c for k, a, b, c in re.findall(rb"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", tag)}
        if pairs.get(b"name", b"").strip().lower() == name.lower().encode() and b"content" in pairs:
            return pairs[b"content"].decode("utf-8", "replace")
    return None


class Signature(NamedTuple):
    """All conditions that are given must hold."""

    vendor: str
    kind: str
    status: tuple[int, ...] = ()
    header: tuple[str, str] | None = None
    server: str | None = None
    cookies: tuple[str, ...] = ()
    body: tuple[str, ...] = ()

    @property
    def rank(self) -> int:
        return 0 if self.header else 1 if self.cookies else 2 if self.body else 3


#: Pages by which vendors of bot protection block, in the order in which equals in rank are tried.
SIGNATURES = (
    Signature("cloudflare", "challenge", header=("cf-mitigated", "challenge")),
    Signature("cloudflare", "challenge", (403, 503), server="cloudflare", body=("<title>Just a moment...</title>", "/cdn-cgi/challenge-platform/")),
    Signature("cloudflare", "block", (403,), server="cloudflare", body=("Attention Required! | Cloudflare", "Sorry, you have been blocked")),
    Signature("cloudflare", "rate_limit", (429,), server="cloudflare", body=("error code: 1015",)),
    Signature("datadome", "captcha", (403, 405), header=("x-datadome", "")),
    Signature("datadome", "captcha", (403, 405), cookies=("datadome",), body=("captcha-delivery.com",)),
    Signature("aws-waf", "challenge", header=("x-amzn-waf-action", "challenge")),
    Signature("aws-waf", "captcha", header=("x-amzn-waf-action", "captcha")),
    Signature("kasada", "challenge", (429,), header=("x-kpsdk-ct", "")),
    Signature("imperva", "block", header=("x-iinfo", ""), body=("Incapsula incident ID", "_Incapsula_Resource?CWUDNSAI=")),
    Signature("imperva", "block", cookies=("visid_incap_", "incap_ses_"), body=("Incapsula incident ID", "_Incapsula_Resource?CWUDNSAI=")),
    Signature("human", "captcha", (403,), cookies=("_pxhd", "_px3", "_px2"), body=("px-captcha", "Press &amp; Hold", "Press & Hold")),
    Signature("human", "captcha", (403,), body=('<div id="px-captcha">', "window._pxAppId")),
    Signature("akamai", "block", (403,), server="AkamaiGHost", body=("Access Denied",)),
)


def read_signatures(text: str) -> tuple[Signature, ...]:
    """Signatures from TOML: tables `signature` with vendor, kind and the conditions status, header (name, contains), server, cookies, body."""
    import tomllib

    out = []
    for row in tomllib.loads(text).get("signature", []):
        more = row.keys() - {"vendor", "kind", "status", "header", "server", "cookies", "body"}
        if more or not {"vendor", "kind"} < row.keys():
            raise ValueError(f"no signature: {row}")
        head = row.get("header")
        pair = (head["name"].lower(), head.get("contains", "")) if head else None
        out.append(Signature(row["vendor"], row["kind"], tuple(row.get("status", ())), pair, row.get("server"), tuple(row.get("cookies", ())), tuple(row.get("body", ()))))
    return tuple(out)


def vendors(signatures: tuple[Signature, ...] = SIGNATURES) -> list[str]:
    return sorted({s.vendor for s in signatures})


class Outcome(NamedTuple):
    outcome: str
    vendor: str | None = None
    kind: str | None = None
    retry_after: float | None = None
    price: str | None = None


def header(headers: list, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name), None)


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds, or a date less now (0 if it is past)."""
    if value is None:
        return None
    value = value.strip()
    if value.isascii() and value.isdigit():
        return float(value)
    try:
        at = datetime.strptime(value, "%a, %d %b %Y %H:%M:%S GMT").replace(tzinfo=timezone.utc)
    except ValueError:
        return None
    return max(0.0, at.timestamp() - now)


def classify(status: int, headers: list, body: bytes | None, now: float = 0.0, signatures: tuple[Signature, ...] = SIGNATURES) -> Outcome:
    """What a response means; a signature that matches counts even at status 200."""
    start = (body or b"")[:65536].decode("utf-8", "replace").lower()

    def matches(s: Signature) -> bool:
        return (
            (not s.status or status in s.status)
            and (s.header is None or any(k.lower() == s.header[0] and s.header[1].lower() in v.lower() for k, v in headers))
            and (s.server is None or any(k.lower() == "server" and s.server.lower() in v.lower() for k, v in headers))
            and (not s.cookies or any(k.lower() == "set-cookie" and v.lstrip().startswith(s.cookies) for k, v in headers))
            and (not s.body or any(b.lower() in start for b in s.body))
        )

    for s in sorted(signatures, key=lambda s: s.rank):
        if matches(s):
            return Outcome("blocked", s.vendor, s.kind)
    wait = header(headers, "retry-after")
    if status == 402:
        return Outcome("payment_required", price=header(headers, "crawler-price"))
    if status == 429 or (status == 503 and wait is not None):
        return Outcome("throttled", retry_after=retry_after(wait, now))
    return Outcome("http_error") if status >= 400 else Outcome("ok")
