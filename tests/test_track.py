import pytest
from pyspark.sql import functions as F

from pagelathe.functions import track
from pagelathe.functions.html import parse
from pagelathe.functions.xpath import XPathError
from pagelathe.operators import tracking

SHOP = "<html><body><div id=top><h1 class='product-name'>Blue kettle</h1><dl><dt>Price</dt><dd class='price_color'>£51.77</dd><dt>Stock</dt><dd class=stock>In stock (7)</dd></dl><p class=author id=by>By A. Writer</p></div></body></html>"

#: (what was followed, the page after a redesign, the text found there or None)
REDESIGNS = [
    ("dd.price_color", SHOP.replace("price_color", "ProductPrice-sc1"), "£51.77"),
    ("h1.product-name", SHOP.replace("<h1 class='product-name'>Blue kettle</h1>", "<h2 class='product-name'>Blue kettle</h2>"), "Blue kettle"),
    ("dd.price_color", SHOP.replace("price_color", "price").replace("51.77", "49.20"), "£49.20"),
    ("#by", SHOP.replace(" id=by", ""), "By A. Writer"),
    ("dd.stock", SHOP.replace("<dt>Price</dt><dd class='price_color'>£51.77</dd>", "").replace("class=stock", "class=availability").replace("</dl>", "<dt>Price</dt><dd>£51.77</dd></dl>"), "In stock (7)"),
    ("h1.product-name", SHOP.replace("<h1 class='product-name'>Blue kettle</h1>", "<section><h1 class='name'>Blue kettle</h1></section>"), "Blue kettle"),
    ("dd.price_color", SHOP.replace("<dt>Price</dt><dd class='price_color'>£51.77</dd>", ""), None),
    ("dd.price_color", "<html><body><p>We moved</p></body></html>", None),
    ("p.author", SHOP.replace("<p class=author id=by>By A. Writer</p>", "<p>Delivery within three days</p>"), None),
    ("#one", "<body><ul><li class='item big'>b</li><li class='item big'>c</li></ul>", None),
]


@pytest.mark.parametrize("query, after, text", REDESIGNS)
def test_redesigns(query, after, text):
    before = parse(SHOP if query != "#one" else "<body><ul><li class='item big' id=one>a</li><li class='item big'>b</li></ul>")
    state, _, _, known = track.Tracker("x", query).run(before, None)
    assert state == "matched"
    doc = parse(after)
    known = track.from_json(known.to_json())
    found = track.relocate(known, doc)
    assert (doc.readable(found[0]) if found else None) == text
    state, score, values, _ = track.Tracker("x", query + "::text").run(doc, known)
    assert state == ("relocated" if text else "lost") and values == ([text] if text else [])
    assert (score >= track.THRESHOLD) == bool(text)


def test_same_element_scores_one_and_learning_is_sticky():
    doc = parse(SHOP)
    for i in range(len(doc)):
        if doc.kind[i] == "element":
            p = track.print_of(doc, i)
            assert track.score(p, p) == pytest.approx(1)
    a = track.print_of(doc, next(i for i in range(len(doc)) if doc.tag[i] == "h1"))
    b = track.learned(a._replace(text="Red pan"), a)
    assert b.text_varies and not b.preceding_varies and track.learned(b, b).text_varies
    one, two = a._replace(text="£51.77"), a._replace(text="£12.00")
    assert track.score(one._replace(text_varies=True), two) == pytest.approx(1) and track.score(one, two) < 0.95


def test_measures_against_plain_ones():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert track.edit_distance(a, b) == plain(a, b)
    assert track.jaccard(["a", "a"], ["a"]) == 0.5 and track.lcs_ratio(["a", "b"], ["a", "x", "b"]) == 0.8
    assert track.ratio("", "") == track.jaccard([], []) == track.trigram_ratio("", "x") == 1.0
    assert track.from_json("{") is None and track.from_json('{"tag": 1}') is None


@pytest.mark.parametrize("query", ["a, b", "::text", "  ::attr(href)", "/text()", "//@href"])
def test_trackers_that_are_refused(query):
    with pytest.raises(ValueError):
        track.Tracker("n", query)


def test_endings():
    assert track.Tracker("n", "a[title='x,y']::attr(href)").element == "a[title='x,y']"
    t = track.Tracker("n", "//h1//text()")
    assert (t.element, t.ending) == ("//h1", ".//text()")
    with pytest.raises(XPathError):
        track.Tracker("n", "//p/text()[1]").run(parse("<p>x"), None)


def test_store(spark):
    schema = "site string, page long, html string"
    before = spark.createDataFrame([("a", 1, SHOP), ("a", 2, SHOP.replace("51.77", "12.00")), ("b", 3, SHOP), ("c", 4, "<p>x"), ("d", 5, None)], schema)
    empty = spark.createDataFrame([], "site string, name string, print string")
    first = tracking.tracked(before, empty, "price", "dd.price_color::text")
    assert {r.page: r.track.state for r in first.collect()} == {1: "matched", 2: "matched", 3: "matched", 4: "unknown", 5: None}
    store = tracking.upserted(empty, first, "price", "page").cache()
    assert {r.site: '"text_varies": true' in r.print for r in store.collect()} == {"a": True, "b": False}
    assert tracking.changed(store, tracking.upserted(store, first.where("site = 'b'"), "price", "page")).count() == 0
    after = spark.createDataFrame([("a", 6, SHOP.replace("price_color", "ProductPrice").replace("51.77", "9.99")), ("b", 7, "<p>gone"), ("b", 8, "<p>gone"), ("c", 9, "<p>x")], schema)
    second = tracking.tracked(after, store, "price", "dd.price_color::text")
    assert {r.page: (r.track.state, list(r.track["values"])) for r in second.collect()} == {6: ("relocated", ["£9.99"]), 7: ("lost", []), 8: ("lost", []), 9: ("unknown", [])}
    assert sorted((r.site, r.what) for r in tracking.reports(second, "price").collect()) == [("a", "relocated"), ("b", "lost")]
    again = tracking.upserted(store, tracking.tracked(before.where("page = 1"), store, "price", "dd.price_color::text"), "price", "page")
    assert all('"text_varies": true' in r.print for r in again.where("site = 'a'").collect())
    p = tracking.fingerprint(F.col("html"), "dd.price_color")
    x = before.where("page < 3").select("page", p.alias("p")).cache()
    both = x.where("page = 1").select(F.col("p").alias("a")).join(x.where("page = 2").select(F.col("p").alias("b")))
    assert 0.8 < both.select(tracking.scores(F.col("a"), F.col("b")).alias("s")).first().s < 1
