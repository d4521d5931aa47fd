import pytest

from pagelathe.functions import css, extract, policy, track, urls, xpath
from pagelathe.functions.html import parse

BODY = "<html><head></head><body>{}</body></html>"


@pytest.mark.parametrize(
    "html, body",
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<table><tr><td>x<td>y</table>", "<table><tbody><tr><td>x</td><td>y</td></tr></tbody></table>"),
        ("<table>foo<tr><td>a</table>", "foo<table><tbody><tr><td>a</td></tr></tbody></table>"),
        ("<p>1<b>2<i>3</b>4</i>5", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3", "<b>1</b><p><b>2</b>3</p>"),
        ("<a href=1>x<a href='2&amp;3'>y", '<a href="1">x</a><a href="2&amp;3">y</a>'),
        ("a < b &lt c", "a &lt; b &lt; c"),
        ("<p><b>T<br><p>x</p></article><footer>y</footer>", "<p><b>T<br></b></p><p><b>x</b></p><footer><b>y</b></footer>"),
        ("<ul><li>a<li>b</ul>c", "<ul><li>a</li><li>b</li></ul>c"),
        ("<div a=1 a=2 B>", '<div a="1" b=""></div>'),
        ("x</p>y", "x<p></p>y"),
        ("<!-->x", "x"),
    ],
)
def test_tree(html, body):
    assert parse(html).outer(0).replace("<!---->", "") == BODY.format(body)


def test_tree_whole():
    assert parse("<!doctype html><!-- c --><title>a&amp;b</title><script>if(a<b)</script>x").outer(0) == "<!DOCTYPE html><!-- c --><html><head><title>a&amp;b</title><script>if(a<b)</script></head><body>x</body></html>"
    assert parse("<template><td>x</td></template>").outer(0).count("x") == 1
    assert parse(None).outer(0) == parse("").outer(0) == BODY.format("")


def test_deep_and_odd_input():
    assert len(parse("<div>" * 3000)) == 3004
    for html in ("<", "</", "<a", "<a href='", "<!--", "&", "<table><table><tr><p>", "<select><select>", "\0<b>\0"):
        doc = parse(html)
        assert parse(doc.outer(0)).outer(0) == doc.outer(0)


def test_readable():
    doc = parse("<p>a<script>b</script> c </p><style>d</style><template>e</template><noscript>f</noscript>")
    assert doc.readable(0, "|", True) == "a|c|f" and "b" in doc.string(0)


PAGE = parse('<div id=m class="a b"><p>one <b>x</b></p><p class=c>two</p><ul lang=en><li><a href="/1">l1</a><li><a href="/2" title=t>l2</a></ul><!--c--></div><p>out</p>')


@pytest.mark.parametrize(
    "query, wanted",
    [("#m > p::text", ["one ", "two"]), ("p ::text", ["one ", "x", "two", "out"]), ("a::attr(href)", ["/1", "/2"]), ("li:nth-child(2) a::text", ["l2"]), ("ul:has(> li) a::text", ["l1", "l2"]), ("p + p::text", ["two"]), ("[title^=t]::text", ["l2"]), (".a.b p:not(.c) b::text", ["x"]), ("b::text, .c::text", ["x", "two"])],
)
def test_css(query, wanted):
    assert [h.value for h in css.select(PAGE, query)] == wanted


@pytest.mark.parametrize("query", ["p,", "p >", "[a", "::text::attr(x)", ":zz", "a..b", ">p", "p,,q", "", "a[b=]", "p:nth-child(x)"])
def test_css_errors(query):
    with pytest.raises(css.SelectorError):
        css.select(PAGE, query)


@pytest.mark.parametrize(
    "query, wanted",
    [
        ("//a/@href", ["/1", "/2"]),
        ("count(//li)", ["2.0"]),
        ("//li[2]/a/text()", ["l2"]),
        ("(//p)[last()]/text()", ["out"]),
        ('//a[@title="t"]/../preceding-sibling::li//text()', ["l1"]),
        ("1 div 0", ["inf"]),
        ("-1 mod 2", ["-1.0"]),
        ('//a[lang("en")]/@href', ["/1", "/2"]),
        ("//ul/ancestor::*[1]/@id", ["m"]),
        ('substring("12345", 1.5, 2.6)', ["234"]),
        ('re:replace("aab","a","g","x")', ["xxb"]),
        ('//p[has-class("c")]/text()', ["two"]),
        ("round(-0.5)", ["-0.0"]),
        ("//li/following::p/text()", ["out"]),
        ("string(1000000)", ["1000000"]),
        ("1e3 = 1", None),
        ("not(//zz)", ["1"]),
    ],
)
def test_xpath(query, wanted):
    if wanted is None:
        with pytest.raises(xpath.XPathError):
            xpath.select(PAGE, query)
    else:
        assert [h.value for h in xpath.select(PAGE, query)] == wanted


@pytest.mark.parametrize("query", ["//", "//p[", "foo()", "//x:y", "count(1)", "1 +", "$v", "//p/zz::a", ""])
def test_xpath_errors(query):
    with pytest.raises(xpath.XPathError):
        xpath.select(PAGE, query)


def test_urls():
    assert urls.canonical("HTTP://Exa.com:80/a/../b?z=1&a=2&utm_source=x#f") == "http://exa.com/b?a=2&z=1"
    assert urls.canonical("ftp://a") is None and urls.canonical(None) is None
    assert [urls.resolve("http://a.com/x/y/z?k=1", h) for h in ("c", "../c", "/c", "?q", "#f", "//o.com/x", "mailto:x")] == ["http://a.com/x/y/c", "http://a.com/x/c", "http://a.com/c", "http://a.com/x/y/z?q", "http://a.com/x/y/z?k=1", "http://o.com/x", None]
    assert urls.fingerprint("get", "http://a.com") == urls.fingerprint("GET", "http://a.com/#x") != urls.fingerprint("GET", "http://a.com", b"x")
    assert not urls.offsite("http://b.a.com", ["a.com"]) and urls.offsite("http://ba.com", ["a.com"])
    assert [urls.repeats(p) for p in ("/a/b/a/b/a/b", "/a/a/a/a", "/a/a/a", "/a/b/c")] == [True, True, False, False]


def test_policy():
    r = policy.Robots("User-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2\nUser-agent: bot\nDisallow: /*.pdf$\nSitemap: http://x/s")
    assert [r.allowed("x", "/a/c"), r.allowed("x", "/a/b"), r.allowed("bot", "/q.pdf"), r.allowed("bot", "/a"), r.crawl_delay("z"), r.sitemaps] == [False, True, False, True, 2.0, ["http://x/s"]]
    kind, entries = policy.sitemap(b'<urlset xmlns="x"><url><loc>http://a</loc><priority>0.5</priority></url><url/></urlset>')
    assert kind == "urlset" and [(e.loc, e.priority) for e in entries] == [("http://a", 0.5)]
    assert policy.sitemap(b"<urlset><url>")[0] == policy.sitemap(None)[0] == "error"
    assert policy.classify(503, [("Retry-After", "5")], b"").retry_after == 5
    assert policy.classify(200, [("CF-Mitigated", "challenge")], b"").outcome == "blocked"
    assert policy.tdm('[{"location":"/a","tdm-reservation":1}]', "/a/b", header=("0", None)).reserved is False
    assert policy.tdm_file('[{"location":"/a","tdm-reservation":2}]', "/a").reserved is None
    assert policy.decode("é".encode("cp1252"), "text/html; charset=latin1") == "é" == policy.decode("é".encode())


def test_extract():
    doc = parse('<form action=/go><input name=a value=1><input type=checkbox name=c checked><select name=s><option>x<option selected>y</select><button name=b value=v>k</button></form><div itemscope itemtype=T><span itemprop=n>N</span></div>')
    assert extract.form(doc, "http://h/").fields == [("a", "1"), ("c", "on"), ("s", "y"), ("b", "v")]
    assert extract.microdata(doc) == [{"type": "T", "properties": {"n": "N"}}]
    assert extract.item([extract.Field("k", xpath="//input/@value", into="int"), extract.Field("bad", css="button::text", into="int")], doc) == ({"k": 1, "bad": None}, ["bad"])
    button = extract.find_all(doc, name="button")[0]
    assert track.relocate(track.print_of(doc, button), doc)[0] == button
    assert extract.regex_all("a1b22", r"\d+") == ["1", "22"]
    assert extract.convert("1e2", "float") == 100.0
    for text, kind in (("1.0", "int"), ("5d", "float"), ("maybe", "bool")):
        with pytest.raises(extract.Invalid):
            extract.convert(text, kind)
