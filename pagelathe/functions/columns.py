"""Column functions: kernels as vectorised functions over Arrow batches, and SQL expressions where those suffice.

A page is parsed to its end, however long that takes. A page on which a query fails gives null, and `problem` says
why. Spark bounds the batches by rows and by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import css as _css
from . import extract as _extract
from . import policy as _policy
from . import urls as _urls
from . import xpath as _xpath
from .html import Document, ParseTimeout, parse

HIT = "array<struct<ord:int,value:string,is_node:boolean>>"
NODE = "array<struct<ord:int,parent:int,end:int,depth:int,kind:string,tag:string,attrs:array<struct<name:string,value:string>>,data:string>>"


def _per_page(kind: str, one, *columns: Column) -> Column:
    """one(document, further values) for each page; null html gives null."""

    @F.pandas_udf(kind)
    def run(htmls: pd.Series, *more: pd.Series) -> pd.Series:
        rest = list(zip(*more)) if more else [()] * len(htmls)
        return pd.Series([_tried(lambda d: one(d, *r), h) for h, r in zip(htmls, rest)], dtype="object")

    return run(*columns)


def _tried(one, html: str | None):
    try:
        return None if html is None else one(parse(html))
    except _xpath.XPathError:
        return None


def problem(html: Column, *queries: str, seconds: float | None = None) -> Column:
    """Why a page gives null: one of the queries fails on it; or that its parse takes more than so many seconds, if given. Null if neither."""

    def why(text: str | None) -> str | None:
        try:
            if text is not None:
                d = parse(text, seconds)
                for q in queries:
                    (_xpath if _is_xpath(q) else _css).select(d, q.removeprefix("xpath:"))
        except (ParseTimeout, _xpath.XPathError) as e:
            return str(e)
        return None

    return _each("string", why, html)


def terminated(html: Column) -> Column:
    """html in which a character reference counts only with its semicolon: other ampersands are escaped, those of scripts and styles too.

    The parser follows the standard and reads `&amp` without one as well, as where a text was cut off.
    """
    return F.regexp_replace(html, "&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)", "&amp;")


def _hits(hits: list) -> list[dict]:
    return [h._asdict() for h in hits]


def css(html: Column, query: str) -> Column:
    """array<struct<ord, value, is_node>> of a CSS query; a malformed query fails at once."""
    _css.compiled(query)
    return _per_page(HIT, lambda d: _hits(_css.select(d, query)), html)


def xpath(html: Column, query: str, **variables) -> Column:
    """array<struct<ord, value, is_node>> of an XPath query."""
    lacking = _xpath.compiled(query)[1] - variables.keys()
    if lacking:
        raise _xpath.XPathError(f"variables without value: {', '.join(sorted(lacking))}")
    return _per_page(HIT, lambda d: _hits(_xpath.select(d, query, **variables)), html)


def values(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["value"])


def first(hits: Column, default: str | None = None) -> Column:
    """The first value of a selection, `default` of an empty one; null where there is no page or the query failed."""
    return F.when(hits.isNotNull(), F.coalesce(F.get(values(hits), F.lit(0)), F.lit(default)))


def queries(html: Column, **wanted: str) -> Column:
    """struct<name: array<string>> of several queries over one parse; XPath queries begin with `/`, `(` or `xpath:`."""
    for q in wanted.values():
        (_xpath if _is_xpath(q) else _css).compiled(q.removeprefix("xpath:"))

    def one(d: Document) -> dict:
        return {k: [h.value for h in (_xpath if _is_xpath(q) else _css).select(d, q.removeprefix("xpath:"))] for k, q in wanted.items()}

    kind = "struct<" + ",".join(f"{k}:array<string>" for k in wanted) + ">"

    @F.pandas_udf(kind)
    def run(htmls: pd.Series) -> pd.DataFrame:
        rows = [_tried(one, h) or {} for h in htmls]
        return pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype="object") for k in wanted})

    return run(html)


def _is_xpath(query: str) -> bool:
    return query.startswith(("/", "(", "xpath:"))


def nodes(html: Column, tags: tuple[str, ...] | None = None, kinds: tuple[str, ...] | None = None) -> Column:
    """NODE: the flat document, or its elements of some tags and nodes of some kinds alone, so that no other leaves the worker."""

    def one(d: Document) -> list[dict]:
        some = range(len(d)) if tags is None and kinds is None else [i for i in range(len(d)) if d.tag[i] in (tags or ()) or d.kind[i] in (kinds or ())]
        return [{"ord": i, "parent": d.parent[i], "end": d.end[i], "depth": d.depth[i], "kind": d.kind[i], "tag": d.tag[i], "attrs": [{"name": k, "value": v} for k, v in d.attrs[i]], "data": d.data[i]} for i in some]

    return _per_page(NODE, one, html)


def positions(html: Column, tags: tuple[str, ...] | None = None) -> Column:
    """array<struct<ord, tag, nth, nth_last, nth_of_type>>: places of elements (of some tags) among the elements of their parents."""

    def one(d: Document) -> list[dict]:
        among: dict[int, int] = {}
        typed: dict[tuple[int, str], int] = {}
        rows = []
        for i in range(len(d)):
            if d.kind[i] == "element":
                p = d.parent[i]
                among[p] = among.get(p, 0) + 1
                typed[p, d.tag[i]] = typed.get((p, d.tag[i]), 0) + 1
                if tags is None or d.tag[i] in tags:
                    rows.append((i, p, among[p], typed[p, d.tag[i]]))
        return [{"ord": i, "tag": d.tag[i], "nth": n, "nth_last": among[p] - n + 1, "nth_of_type": k} for i, p, n, k in rows]

    return _per_page("array<struct<ord:int,tag:string,nth:int,nth_last:int,nth_of_type:int>>", one, html)


def below(html: Column, *chain: str) -> Column:
    """HIT of chained queries: each runs below every element that the one before found, and what it finds stays for each.

    Results of a query that ends in texts or values have nothing below them.
    """
    for q in chain:
        (_xpath if _is_xpath(q) else _css).compiled(q.removeprefix("xpath:"))

    def one(d: Document) -> list[dict]:
        scopes, hits = [0], []
        for q in chain:
            if scopes is None:
                raise _xpath.XPathError("texts and values have nothing below them")
            kind = _xpath if _is_xpath(q) else _css
            hits = [h for s in scopes for h in kind.select(d, q.removeprefix("xpath:"), s)]
            scopes = [h.ord for h in hits] if all(h.is_node and d.kind[h.ord] == "element" for h in hits) else None
        return _hits(hits)

    return _per_page(HIT, one, html)


def hit(hits: Column, at: int) -> Column:
    """The value of a selection's result, from the end if `at` is negative; null beyond."""
    n = F.size(hits)
    return F.when((n > at) & (n >= -at), F.element_at(values(hits), at + 1 if at >= 0 else at))


def part(hits: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """A slice of a selection with the bounds of Python's slices."""
    if not step:
        raise ValueError("a step of zero")
    whole = lambda h: _part(h, start, stop, step)
    return F.when(hits.isNotNull(), F.get(F.transform(F.array(hits), whole), F.lit(0)))


def _part(hits: Column, start: int | None, stop: int | None, step: int) -> Column:
    n = F.size(hits)

    def bound(x: int | None, least: int, most: Column, otherwise: Column) -> Column:
        at = otherwise if x is None else F.lit(x) if x >= 0 else n + x
        return F.least(F.greatest(at, F.lit(least)), most)

    if step > 0:
        first, last = bound(start, 0, n, F.lit(0)), bound(stop, 0, n, n) - 1
        go = first <= last
    else:
        first, last = bound(start, -1, n - 1, n - 1), (F.lit(-1) if stop is None else bound(stop, -1, n - 1, n)) + 1
        go = first >= last
    places = F.when(go, F.sequence(first, F.when(go, last).otherwise(first), F.when(go, F.lit(step)).otherwise(F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(hits, i))


def attributes(html: Column, query: str) -> Column:
    """map<string, string>: the attributes of a query's first element, empty without any."""

    def one(d: Document) -> list[tuple[str, str]]:
        hits = _css.select(d, query)
        return dict(d.attrs[hits[0].ord]) if hits and d.kind[hits[0].ord] == "element" else {}

    _css.compiled(query)
    return _per_page("map<string,string>", one, html)


def regex_all(text: Column, pattern: str, replace_entities: bool = True) -> Column:
    """array<string>: matches of a Python pattern; all groups in turn if it has any, or the group `extract` of the first match."""
    return _each("array<string>", lambda t: None if t is None else _extract.regex_all(t, pattern, replace_entities), text)


def readable(html: Column, separator: str = "", strip: bool = False) -> Column:
    return _per_page("string", lambda d: d.readable(0, separator, strip), html)


def outer(html: Column) -> Column:
    return _per_page("string", lambda d: d.outer(0), html)


_CALLED = T.StringType()  # what a function of a field returns is kept as text, or as JSON if it is no text
_SPARK = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType(), None: T.StringType()}


def item(html: Column, fields: list[_extract.Field]) -> Column:
    """struct<field…, problems: array<string>>: an item in the order of its fields, and the fields whose text was refused."""
    plain = [_CALLED if callable(f.into) else _SPARK[f.into] for f in fields]
    kinds = [T.ArrayType(k) if f.all else k for f, k in zip(fields, plain)]
    schema = T.StructType([T.StructField(f.name, k) for f, k in zip(fields, kinds)] + [T.StructField("problems", T.ArrayType(T.StringType()))])
    for f in fields:
        (_css.compiled if f.css is not None else _xpath.compiled)(f.css if f.css is not None else f.xpath)

    @F.pandas_udf(schema)
    def run(htmls: pd.Series) -> pd.DataFrame:
        rows = [_tried(lambda d: _extract.item(fields, d), h) or ({f.name: None for f in fields}, ["parse"] if h is not None else []) for h in htmls]
        for f in fields:
            if callable(f.into):
                for values, _ in rows:
                    v = values[f.name]
                    values[f.name] = v and [_as_text(x) for x in v] if f.all else _as_text(v)
        out = {f.name: pd.Series([r[0][f.name] for r in rows], dtype="Int64" if f.into == "int" and not f.all else "object") for f in fields}
        return pd.DataFrame(out | {"problems": pd.Series([r[1] for r in rows], dtype="object")})

    return run(html)


def _as_text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)


def links(html: Column, url: Column, selector: str = "a") -> Column:
    """array<struct<ord, href, url>>: links resolved against base and the page's URL; fragments are dropped."""
    kind = "array<struct<ord:int,href:string,url:string>>"
    return _per_page(kind, lambda d, u: [{"ord": o, "href": h, "url": a} for o, h, a in _extract.links(d, u, selector)], html, url)


def rule_links(html: Column, url: Column, queries: tuple[str, ...]) -> Column:
    """array<struct<rule, url>>: the absolute links of several queries, in the order of queries, from one parse."""
    for q in queries:
        (_xpath if _is_xpath(q) else _css).compiled(q.removeprefix("xpath:"))

    def one(d: Document, u: str | None) -> list[dict]:
        base = _extract.base_url(d, u)
        out = []
        for no, q in enumerate(queries):
            for h in (_xpath if _is_xpath(q) else _css).select(d, q.removeprefix("xpath:")):
                href = d.attr(h.ord, "href") if h.is_node and d.kind[h.ord] == "element" else h.value
                if href is not None:
                    out.append({"rule": no, "url": _urls.resolve(base, href)})
        return out

    return _per_page("array<struct<rule:int,url:string>>", one, html, url)


def metadata(html: Column, url: Column) -> Column:
    """JSON of json_ld, microdata, opengraph, twitter and dublin_core."""
    return _per_page("string", lambda d, u: json.dumps({"json_ld": _extract.json_ld(d), "microdata": _extract.microdata(d, _extract.base_url(d, u)), **_extract.meta_maps(d)}, ensure_ascii=False), html, url)


def find_all(html: Column, name=None, attrs=None, string=None, limit: int = 0, class_=None) -> Column:
    """HIT of elements (their HTML) or texts, searched in the manner of Beautiful Soup."""

    def one(d: Document) -> list[dict]:
        found = _extract.find_all(d, 0, name, attrs, string, limit, class_=class_)
        return [{"ord": i, "value": d.data[i] if d.kind[i] == "text" else d.outer(i), "is_node": True} for i in found]

    return _per_page(HIT, one, html)


def form(html: Column, url: Column, query: str = "form", number: int = 0) -> Column:
    kind = "struct<method:string,action:string,enctype:string,fields:array<struct<name:string,value:string>>>"

    @F.pandas_udf(kind)
    def run(htmls: pd.Series, places: pd.Series) -> pd.DataFrame:
        found = [_tried(lambda d: _extract.form(d, u, query, number), h) for h, u in zip(htmls, places)]
        return pd.DataFrame({"method": [f and f.method for f in found], "action": [f and f.action for f in found], "enctype": [f and f.enctype for f in found], "fields": [f and [{"name": k, "value": v} for k, v in f.fields] for f in found]})

    return run(html, url)


def _each(kind: str, one, *columns: Column) -> Column:
    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(*series)], dtype="object")

    return run(*columns)


def canonical(url: Column) -> Column:
    return _each("string", _urls.canonical, url)


def resolve(base: Column, href: Column) -> Column:
    return _each("string", _urls.resolve, base, href)


def host(url: Column) -> Column:
    return _each("string", _urls.host_of, url)


def fingerprint(url: Column, method: str = "GET") -> Column:
    """32 hex digits; the digest itself is computed in the JVM."""
    plain = canonical(url)
    return F.substring(F.sha2(F.concat(F.lit(method.upper() + " "), plain), 256), 1, 32)


def offsite(url: Column, allowed: list[str]) -> Column:
    return _each("boolean", lambda u: _urls.offsite(u, allowed), url)


def canonical_host(canonical: Column) -> Column:
    """`host` of a URL in canonical form, as an SQL expression."""
    found = F.regexp_extract(canonical, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(canonical.isNotNull(), found)


def canonical_offsite(canonical: Column, allowed: list[str]) -> Column:
    """`offsite` of a URL in canonical form, as an SQL expression."""
    if not allowed:
        return F.lit(False)
    host = F.rtrim(canonical_host(canonical), F.lit("."))
    port = F.regexp_extract(canonical, r"^https?://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):([0-9]+)", 1)
    port = F.when(port != "", port).otherwise(F.when(canonical.startswith("https:"), "443").otherwise("80"))
    inside = F.lit(False)
    for domain in allowed:
        if "/" in domain:
            raise ValueError(f"not a domain: {domain!r}")
        name, _, own = domain.partition(":")
        name = _urls._host(name.strip().rstrip(".")) or ""
        one = (host == name) | host.endswith("." + name)
        inside = inside | (one & (port == own) if own else one)
    return ~F.coalesce(inside, F.lit(False))


def repeats(path: Column) -> Column:
    """Whether a path looks like a trap: a run of segments three times over, or one segment four times."""
    plain = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract(path, r"^[^?]*", 0)), "/+", "/"), "/$", "")
    return plain.rlike(r"((?:/[^/]+){2,}?)\1{2}(?=/|$)") | plain.rlike(r"(/[^/]+)\1{3}(?=/|$)")


@lru_cache(maxsize=1024)
def _robots(text: str | None) -> _policy.Robots:
    return _policy.Robots(text)


def robots_allowed(text: Column, agent: Column, path: Column) -> Column:
    """Whether a robots.txt lets an agent read a path; a file is read once for neighbouring rows."""
    return _each("boolean", lambda t, a, p: _robots(t).allowed(a, p), text, agent, path)


def robots_sitemaps(text: Column) -> Column:
    """array<string>: the sitemaps that a robots.txt names."""
    return _each("array<string>", lambda t: _robots(t).sitemaps, text)


def crawl_delay(text: Column, agent: Column) -> Column:
    return _each("double", lambda t, a: _robots(t).crawl_delay(a), text, agent)


def tdm_reserved(text: Column, path: Column) -> Column:
    return _each("boolean", lambda t, p: _policy.tdm_file(t, p).reserved, text, path)


RESERVATION = "struct<reserved:boolean,policy:string>"


def reservation(text: Column, path: Column, headers: Column, body: Column) -> Column:
    """RESERVATION of a page: its own say (meta) before that of the header before that of the origin's file."""

    def one(t, p, h, b) -> dict:
        pairs = [(x["name"], x["value"]) for x in (h if h is not None else [])]
        head = _policy.header(pairs, "tdm-reservation"), _policy.header(pairs, "tdm-policy")
        meta = _policy.meta_content(b, "tdm-reservation"), _policy.meta_content(b, "tdm-policy")
        return _policy.tdm(t, p or "/", head, meta)._asdict()

    @F.pandas_udf(RESERVATION)
    def run(texts: pd.Series, paths: pd.Series, heads: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = [one(*r) for r in zip(texts, paths, heads, bodies)]
        return pd.DataFrame({"reserved": pd.Series([r["reserved"] for r in rows], dtype="object"), "policy": pd.Series([r["policy"] for r in rows], dtype="object")})

    return run(text, path, headers, body)


def meta_content(body: Column, name: str) -> Column:
    return _each("string", lambda b: _policy.meta_content(b, name), body)


def header_map(headers: Column) -> Column:
    """map<string, string> of headers by their names in lower case: repeats are joined by a comma, of set-cookie the last counts."""
    names = F.array_distinct(F.transform(headers, lambda h: F.lower(h["name"])))

    def value(name: Column) -> Column:
        some = F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h["value"])
        return F.when(name == "set-cookie", F.element_at(some, -1)).otherwise(F.array_join(some, ", "))

    return F.map_from_arrays(names, F.transform(names, value))


def decode(body: Column, content_type: Column) -> Column:
    return _each("string", _policy.decode, body, content_type)


OUTCOME = "struct<outcome:string,vendor:string,kind:string,retry_after:double,price:string>"


def classify(status: Column, headers: Column, body: Column, now: float = 0.0, signatures: tuple = _policy.SIGNATURES) -> Column:
    """OUTCOME of a response; headers: array<struct<name, value>>."""

    @F.pandas_udf(OUTCOME)
    def run(codes: pd.Series, heads: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = [_policy.classify(int(s), [(x["name"], x["value"]) for x in (h if h is not None else [])], b, now, signatures) for s, h, b in zip(codes, heads, bodies)]
        return pd.DataFrame(rows, columns=list(_policy.Outcome._fields)).astype({"retry_after": "float64"})

    return run(status, headers, body)


# conversions as SQL expressions


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def to_int(text: Column) -> Column:
    return F.when(strip(text).rlike("^[+-]?[0-9]+$"), strip(text).try_cast("bigint"))


def to_float(text: Column) -> Column:
    plain = strip(text)
    return F.when(plain.rlike(r"^(?i)[+-]?(inf(inity)?|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"), plain.try_cast("double"))


def to_bool(text: Column) -> Column:
    plain = F.lower(strip(text))
    return F.when(plain.isin(*_extract.YES), True).when(plain.isin(*_extract.NO), False)


def item_id(source: Column, position: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source, position.cast("string")), 256), 1, 24)


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
