import json

from pyspark.sql import functions as F

from pagelathe.functions import columns as C
from pagelathe.operators import nodes as N
from pagelathe.plans import frontier
from pagelathe.sources import readers, sinks
from pagelathe.streaming import hosts


def test_relational_form_agrees_with_the_kernel(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    n = N.nodes(pages).cache()
    kernel = {(r.page_id, o) for r in pages.select("page_id", C.css(F.col("html"), "article p").alias("h")).collect() for o in (h.ord for h in r.h)}
    assert {(r.page_id, r.ord) for r in N.under(N.elements(n, "p"), N.elements(n, "article")).collect()} == kernel
    kernel = {(r.page_id, o) for r in pages.select("page_id", C.xpath(F.col("html"), "//li/following-sibling::li[1]").alias("h")).collect() for o in (h.ord for h in r.h)}
    near = N.axis(N.elements(n, "li"), N.elements(n, "li"), "following-sibling").where("position = 1")
    assert {(r.page_id, r.ord) for r in near.collect()} == kernel


def test_nulls(spark):
    df = spark.createDataFrame([(None, None), ("http://a/", "<a href=x>")], "url string, html string")
    rows = df.select(C.css(F.col("html"), "a").alias("c"), C.canonical(F.col("url")).alias("u"), C.links(F.col("html"), F.col("url")).alias("l"), C.item(F.col("html"), []).alias("i")).collect()
    assert rows[0].c is None and rows[0].u is None and rows[1].l[0].url == "http://a/x"


def test_admission(spark):
    rows = [("http://a.com/x", 0, 1), ("http://a.com/x#y", 0, 2), ("ftp://a", 0, 3), ("http://b.com/", 0, 4), ("http://a.com/q/q/q/q", 0, 5), ("http://a.com/z", 9, 6), ("http://a.com/1", 0, 7), ("http://a.com/2", 0, 8)]
    out = frontier.admitted(spark.createDataFrame(rows, "url string, depth int, seq long"), None, ["a.com"], 3, 2)
    assert {r.seq: r.reason for r in out.collect()} == {1: None, 2: "seen", 3: "invalid", 4: "offsite", 5: "trap", 6: "depth", 7: None, 8: "host cap"}


def test_reached(spark, tmp_path):
    def keep(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "source string, target string")
    out = frontier.reached(spark.createDataFrame([("a",)], "url string"), links, 3, keep)
    assert {r.url: r.depth for r in out.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), ["x"]), (2, 1.5, None)], "a long, b double, c array<string>")
    sinks.write(df, f"{tmp_path}/o.jsonl")
    lines = sorted(spark.read.text(f"{tmp_path}/o.jsonl").toPandas()["value"])
    assert [json.loads(x) for x in lines] == [{"a": 1, "b": None, "c": ["x"]}, {"a": 2, "b": 1.5, "c": None}]
    sinks.write(df, f"{tmp_path}/o.csv")
    assert spark.read.csv(f"{tmp_path}/o.csv", header=True).count() == 2
    sinks.write(df, f"{tmp_path}/o.parquet")
    assert spark.read.parquet(f"{tmp_path}/o.parquet").count() == 2


def test_schema_lattice(spark):
    items = spark.createDataFrame([('{"a":1,"b":"x","c":null}',), ('{"a":2.5,"b":true}',), ('{"d":[1]}',)], "item string")
    assert dict(sinks.typed(items).dtypes) == {"a": "double", "b": "string", "c": "string", "d": "string"}
    assert {r.key: r.missing for r in sinks.misfits(items).collect()} == {"a": 1, "b": 1, "c": 2, "d": 2}


def test_sitemaps(spark):
    files = spark.createDataFrame([("s", bytearray(b"<urlset><url><loc>http://a</loc></url></urlset>")), ("t", None)], "url string, body binary")
    assert {(r.url, r.kind, r.loc) for r in readers.sitemap_entries(files).collect()} == {("s", "urlset", "http://a"), ("t", "error", None)}


def test_delays():
    assert hosts.next_delay(0.0, 1.0, 200) == 0.5 and hosts.next_delay(0.1, 1.0, 429) == 0.5 and hosts.next_delay(2.0, 1.0, 500) == 2.0
    b = hosts.Breaker()
    assert [b.add(i % 2 == 0) for i in range(10)][-1] and not b.add(True)


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = spark.createDataFrame([("h", i, float(i % 3), 200 if i % 4 else 429) for i in range(20)] + [("g", 1, 2.0, 200)], "host string, seq long, latency double, status int")
    rows.write.parquet(f"{tmp_path}/in")
    stream = hosts.delays_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("delays").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("delays").collect())) == sorted(map(tuple, hosts.delays(rows).collect()))
