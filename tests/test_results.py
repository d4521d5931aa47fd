"""Queries against their SQL on pages that the given tables hold at larger sizes only."""

import duckdb
import pytest

from pagelathe.functions import columns as C
from pagelathe.functions import css
from pagelathe.functions import html as H
from pagelathe.plans.queries import ORACLES, QUERIES

from pyspark.sql import functions as F

CUT = ["a &amp;&amp", "b &amp", "&lt;c&gt", "d &quot;e&quot", "f &am", "g&copy", "h & i &amp; j", "k &middot;"]
PAGE = '<!DOCTYPE html><html lang="en"><head><title>{x}</title><script>if(a&&b)track({n});</script></head><body><nav><ul><li><a href="/x?a=1">l</a></li></ul></nav><article><h1>{x}</h1><p><b>{x}</b> t</p></article></body></html>'


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("cut"))
    rows = [(n, f"http://h{n}.com/en/{n}", PAGE.format(x=x, n=n)) for n, x in enumerate(CUT)]
    rows += [(len(CUT), "http://e.com/", "<html><body>no title, no heading</body></html>"), (len(CUT) + 1, "http://n.com/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def both(spark, at, name):
    got = QUERIES[name](spark, at)
    plain = lambda rows: sorted((tuple(list(v) if hasattr(v, "tolist") else v for v in r) for r in rows), key=repr)
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet/*.parquet'")
    return plain(got.collect()), plain(sql.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", ["page_title", "item_extract", "string_value_join", "readable_text"])
def test_references_without_semicolon(spark, cut, name):
    got, wanted = both(spark, cut, name)
    assert got == wanted


@pytest.mark.parametrize("name", ["h1_xpath", "track_states", "track_learning"])
def test_references_without_semicolon_in_headings(spark, cut, name):
    got, wanted = both(spark, cut, name)
    few = lambda rows: [r for r in rows if not {len(CUT), len(CUT) + 1, "e.com", "n.com"} & set(r)]  # noqa: E731  pages without heading are another matter
    assert few(got) == few(wanted)


def test_terminated(spark):
    rows = spark.createDataFrame([("a&amp",), ("a&amp;b&#39;c&#x27;d&#39 &x y&&lt;",), (None,)], "h string")
    assert [r[0] for r in rows.select(C.terminated(F.col("h"))).collect()] == ["a&amp;amp", "a&amp;b&#39;c&#x27;d&amp;#39 &amp;x y&amp;&lt;", None]


def test_a_slow_page_is_read_to_its_end(monkeypatch):
    clock = iter(range(0, 10**9, 1000))
    monkeypatch.setattr(H, "monotonic", lambda: next(clock))
    page = "<title>t</title>" + "<p>x" * 1000
    assert C._tried(lambda d: [h.value for h in css.select(d, "title::text")], page) == ["t"]
    assert C._tried(lambda d: d.readable(0), page) == "t" + "x" * 1000


def test_lone_brackets_are_one_text():
    assert [d.data[i] for d in [H.parse("<p>a < b <1 << c<b>d<")] for i in range(len(d)) if d.kind[i] == "text"] == ["a < b <1 << c", "d<"]


def test_a_failure_is_no_result(spark):
    rows = spark.createDataFrame([("<p>1",), (None,)], "h string")
    out = rows.select(C.first(C.xpath(F.col("h"), "count(1)"), "").alias("failed"), C.first(C.css(F.col("h"), "title::text"), "").alias("title")).collect()
    assert [tuple(r) for r in out] == [(None, ""), (None, None)]
