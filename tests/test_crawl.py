import random

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import columns as C
from pagelathe.functions import extract, html, policy, urls
from pagelathe.functions.extract import Field
from pagelathe.functions.html import parse
from pagelathe.plans import frontier, rules
from pagelathe.plans.checkpoint import Checkpoint
from pagelathe.sources import sinks
from pagelathe.streaming import hosts


@pytest.mark.parametrize("key", sorted(urls.TRACKERS) + ["utm_source", "UTM_x", "FBCLID"])
def test_every_tracker_goes(key):
    assert urls.canonical(f"http://e.com/?b=1&{key}=2&a=3") == "http://e.com/?a=3&b=1"
    assert urls.fingerprint("GET", f"http://e.com/?{key}") == urls.fingerprint("get", "http://E.com:80/#x")


@pytest.mark.parametrize("key", ["gclsrc", "oly_anon_id", "oly_enc_id", "vero_id", "ref", "utm", "ga"])
def test_other_keys_stay(key):
    assert urls.canonical(f"http://e.com/?{key}=1") == f"http://e.com/?{key}=1"


def test_repeated_keys_keep_their_order():
    assert urls.canonical("http://e.com/?b=2&a=9&b=1&a=0") == "http://e.com/?a=9&a=0&b=2&b=1"
    assert urls.canonical("http://e.com/?x&y=%20+") == "http://e.com/?x=&y=++"


def test_sql_forms_agree_with_the_kernels(spark):
    hosts_ = ["http://a.com/x", "https://b.a.com:8443/", "http://user@a.com/", "http://xa.com/", "http://a.com./", "https://[::1]/q", "http://a.com:80/?h=http://b.com", "ftp://a.com/", "x", None]
    paths = ["", "/a/a/a/a", "/a/a/a", "/a/b/a/b/a/b/", "/a/b/c/a/b/c/a/b/c?x", "//a//a/a/a", "/a/aa/a/aa/a/aab", "/q?/a/a/a/a", None]
    df = spark.createDataFrame([(h,) for h in hosts_], "u string").withColumn("c", C.canonical(F.col("u")))
    for allowed in (["a.com"], ["a.com:8443"], ["b.com", "A.com:80"], []):
        out = df.where("c is not null").select("c", C.host(F.col("c")).alias("h"), C.canonical_host(F.col("c")).alias("h2"), C.offsite(F.col("c"), allowed).alias("o"), C.canonical_offsite(F.col("c"), allowed).alias("o2")).collect()
        assert len(out) == 7 and all(r.h == r.h2 and r.o == r.o2 for r in out), (allowed, out)
    out = spark.createDataFrame([(p,) for p in paths], "p string").select("p", C.repeats(F.col("p")).alias("r")).collect()
    assert [r.r for r in out] == [None if p is None else urls.repeats(p) for p in paths]


def test_nesting_is_linear_and_budgets_hold(spark):
    from time import perf_counter

    start = perf_counter()
    assert len(parse("<div>" * 80_000)) == 80_004
    assert perf_counter() - start < 5
    with pytest.raises(html.ParseTimeout):
        parse("<p>x" * 100_000, 0.001)
    df = spark.createDataFrame([("<p>x" * 50_000,), ("<p>1<b>2",), (None,)], "h string")
    out = df.select(C.problem(F.col("h"), "p", "xpath://p", seconds=0.001).alias("a"), C.problem(F.col("h"), "//p").alias("b"), C.problem(F.col("h"), "xpath:count(1)", seconds=60).alias("c")).collect()
    assert "parse stopped" in out[0].a and out[1].a is None and out[2].a is None and [r.b for r in out] == [None] * 3
    assert out[1].c and df.select(C.xpath(F.col("h"), "count(1)").alias("x")).collect()[1].x is None


def test_misnested_tables_keep_their_stack():
    for text in ("<table><b><tr><td>x</b></table>y", "<p><b><table><p>x</b>y</table>z", "<b><button><b></button></b>x"):
        doc = parse(text)
        assert parse(doc.outer(0)).outer(0) == doc.outer(0)


def test_selections(spark):
    page = "<ul><li><a href=1>a</a><a href=2>b</a></li><li><a href=3>c</a></li></ul>"
    df = spark.createDataFrame([(page,), ("",), (None,)], "h string")
    h = C.below(F.col("h"), "li, ul", "a::text")
    out = df.select(C.values(h).alias("v"), *[C.hit(h, i).alias(f"h{i + 9}") for i in (0, -1, 4, 5, -6)]).collect()
    assert out[0].v == ["a", "b", "c", "a", "b", "c"] and out[1].v == [] and out[2].v is None
    assert [out[0][f"h{i + 9}"] for i in (0, -1, 4, 5, -6)] == ["a", "c", "b", "c", "a"] and out[1].h9 is None
    values = list("abcabc")
    for start in (None, 0, 2, -2, 9, -9):
        for stop in (None, 0, 4, -1, 9, -9):
            for step in (1, 2, -1, -3):
                got = df.select(C.values(C.part(h, start, stop, step)).alias("v")).first().v
                assert got == values[start:stop:step], (start, stop, step)
    assert df.select(C.below(F.col("h"), "a::text", "b").alias("x")).first().x is None  # texts have nothing below them
    assert df.select(C.attributes(F.col("h"), "a").alias("x")).collect()[0].x == {"href": "1"}


def test_item_with_a_function(spark):
    fields = [Field("n", css="a::text", into=lambda t: [t, 1]), Field("all", css="a::text", all=True, into=str.upper), Field("bad", css="a::text", into=int)]
    row = spark.createDataFrame([("<a>x</a><a>y</a>",)], "h string").select(C.item(F.col("h"), fields).alias("i")).first().i
    assert row.n == '["x", 1]' and row.all == ["X", "Y"] and row.bad is None and row.problems == ["bad"]


def test_rules(spark):
    page = "<base href=/b/><a href=x#1>1</a><a href=x>2</a><a href='http://o.com/y'>3</a><a href=z.pdf>4</a><a href='mailto:q'>5</a><a href=' w '>6</a>"
    pages = spark.createDataFrame([(1, "http://e.com/p", page), (2, None, page), (3, "http://e.com/", None)], "page_id long, url string, html string")
    some = [rules.Follow("a", deny=(r"\.pdf$",), allow_domains=("e.com",)), rules.Follow("a::attr(href)", deny_domains=("e.com",), follow=False, priority=2), rules.Follow("//a")]
    out = sorted((r.page_id, r.pos, r.target, r.rule, r.priority, r.follow) for r in rules.taken(pages, some).collect())
    assert out[:4] == [(1, 0, "http://e.com/b/x", 0, 0, True), (1, 1, "http://e.com/b/w", 0, 0, True), (1, 2, "http://o.com/y", 1, 2, False), (1, 3, "http://e.com/b/z.pdf", 2, 0, True)]
    assert [(r[0], r[2], r[3]) for r in out[4:]] == [(2, "http://o.com/y", 1)]
    owners = spark.createDataFrame([("http://e.com/p", 1)], "url string, rule int")
    got = rules.items(pages, owners, [some[0], some[1]._replace(fields=(Field("t", css="a::text"),))])
    assert list(got) == [1] and [r.item.t for r in got[1].collect()] == ["1"]


def test_gates(spark):
    requests = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.com/x", "http://a.com/no", "http://b.com/", "http://c.com/", "http://d.com/", "https://a.com/x", "http://a.com/tdm/1"])], "id long, url string")
    robots = spark.createDataFrame([("http://a.com", 200, "User-agent: *\nDisallow: /no"), ("http://b.com", 404, "User-agent: *\nDisallow: /"), ("http://c.com", 503, None), ("http://d.com", 200, None)], "origin string, status int, text string")
    tdm = spark.createDataFrame([("http://a.com", '[{"location": "/tdm/", "tdm-reservation": 1}]')], "origin string, text string")
    assert {r.id: r.gate for r in rules.gated(requests, robots, tdm, "bot").collect()} == {0: None, 1: "robots", 2: None, 3: "robots", 4: None, 5: "robots", 6: "tdm"}


def test_reservations(spark):
    heads = "array<struct<name:string,value:string>>"
    file = '[{"location": "/", "tdm-reservation": 1, "tdm-policy": "http://p"}]'
    rows = [(0, file, "/x", [], None), (1, file, "/x", [("TDM-Reservation", "0")], None), (2, file, "/x", [("tdm-reservation", "0")], bytearray(b"<meta name=tdm-reservation content=1>")), (3, None, "/x", None, None)]
    out = spark.createDataFrame(rows, f"id int, t string, p string, h {heads}, b binary").select("id", C.reservation(F.col("t"), F.col("p"), F.col("h"), F.col("b")).alias("r")).collect()
    assert {r.id: (r.r.reserved, r.r.policy) for r in out} == {0: (True, "http://p"), 1: (False, None), 2: (True, None), 3: (None, None)}


def test_pipeline_stages(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n long, s string")
    out = rules.piped(items, lambda r: r if r["n"] != 2 else None, lambda r: r | {"s": r["s"] * 2}, schema="n long, s string")
    assert sorted(map(tuple, out.collect())) == [(1, "aa"), (3, "cc")]


def test_signatures():
    assert len(policy.SIGNATURES) == 14 and policy.vendors() == ["akamai", "aws-waf", "cloudflare", "datadome", "human", "imperva", "kasada"]
    read = policy.read_signatures('[[signature]]\nvendor = "x"\nkind = "block"\nstatus = [403]\nheader = { name = "X-A" }\nbody = ["no"]')
    assert policy.classify(403, [("x-a", "")], b"NO way", signatures=read)[:3] == ("blocked", "x", "block")
    assert policy.classify(403, [], b"no way", signatures=read).outcome == "http_error"
    with pytest.raises(ValueError):
        policy.read_signatures('[[signature]]\nvendor = "x"\nkind = "b"\nstat = [1]')
    # a header counts before a cookie, a cookie before the body
    both = policy.classify(403, [("x-iinfo", "1"), ("set-cookie", "_px3=1")], b"px-captcha Incapsula incident ID")
    assert both.vendor == "imperva"


def test_forms_and_payloads():
    form = extract.form(parse('<form method=post enctype="multipart/form-data" action=/s><input name=a value="1&quot;2"><textarea name=b>\nx\ny</textarea></form>'), "http://e.com/")
    url, kind, body = form.sent("BB")
    assert url == "http://e.com/s" and kind == "multipart/form-data; boundary=BB"
    assert body == b'--BB\r\nContent-Disposition: form-data; name="a"\r\n\r\n1"2\r\n--BB\r\nContent-Disposition: form-data; name="b"\r\n\r\nx\r\ny\r\n--BB--\r\n'
    get = extract.form(parse("<form action='/s?old=1'><input name=q value='a b'></form>"), "http://e.com/")
    assert get.sent() == ("http://e.com/s?q=a+b", None, None)
    assert extract.payload("post", {"a": [1, 2]})["body"] == b"a=1&a=2" and extract.payload("put", data={"é": 1})["body"] == '{"é":1}'.encode()
    assert extract.payload("get")["kind"] == "navigate" and extract.payload("delete")["kind"] == "fetch"
    for bad in (lambda: extract.payload("get", body="x"), lambda: extract.payload("post", {}, {})):
        with pytest.raises(ValueError):
            bad()


def test_admission_without_filters(spark):
    rows = [("http://a.com/x", 0, 1, False), ("http://a.com/x", 0, 2, True), ("http://b.com/", 0, 3, True), ("http://b.com/", 0, 4, False), ("http://a.com/q/q/q/q", 0, 5, True)]
    out = frontier.admitted(spark.createDataFrame(rows, "url string, depth int, seq long, free boolean"), None, ["a.com"], unfiltered="free")
    assert {r.seq: r.reason for r in out.collect()} == {1: None, 2: None, 3: None, 4: "offsite", 5: "trap"}
    many = spark.createDataFrame([(f"http://a.com/{i}", 0, i) for i in range(50)] + [("http://b.com/", 0, 99)], "url string, depth int, seq long")
    out = frontier.admitted(many, per_host=3)
    assert {r.seq for r in out.where("reason is null").collect()} == {0, 1, 2, 99}
    assert {r.reason: r.n for r in frontier.counted(out).collect()} == {None: 4, "host cap": 47}


def test_redirects(spark, tmp_path):
    def keep(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), *[(f"n{i}", f"n{i + 1}") for i in range(9)]], "source string, target string")
    start = spark.createDataFrame([("a",), ("c",), ("x",), ("n0",), ("n5",)], "url string")
    out = {r.url: (r.last, r.hops, r.loop) for r in frontier.redirected(start, hops, keep, 5).collect()}
    assert out == {"a": ("c", 2, False), "c": ("c", 0, False), "x": ("y", 1, True), "n0": ("n5", 5, True), "n5": ("n9", 4, False)}


def test_retries_and_pauses(spark):
    rows = [("f", "GET", 503, 0), ("f", "GET", 503, 3), ("g", "POST", 503, 0), ("h", "GET", None, 1), ("i", "GET", 404, 0)]
    out = hosts.retries(spark.createDataFrame(rows, "fp string, method string, status int, attempt int"), 3, 2.0, 3.0).collect()
    assert [r.again for r in out] == [True, False, False, True, False]
    assert 0 <= out[0].wait < 2 and 0 <= out[3].wait < 3 and out[1].wait is None
    seen = spark.createDataFrame([("h", i, float(i), i % 2 == 0) for i in range(30)], "host string, seq long, at double, blocked boolean")
    assert sorted((r.seq, r["from"], r.until) for r in hosts.pauses(seen).collect()) == [(9, 9.0, 309.0), (19, 19.0, 319.0), (29, 29.0, 329.0)]


def test_stream_in_small_chunks(spark, tmp_path):
    rng = random.Random(2)
    rows = [("h", i, float(i % 7), 200 if i % 3 else 429) for i in range(40)] + [("g", i, 1.0, None) for i in range(25)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "host string, seq long, latency double, status int")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        q = hosts.delays_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("chunks").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, spark.table("chunks").collect())) == sorted(map(tuple, hosts.delays(df).collect()))


def test_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "_id string, n int").withColumn("at", F.timestamp_seconds(F.col("n")))
    assert hosts.once(df).count() == 2
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError):
        hosts.once(stream)
    q = hosts.once(stream, time="at", within="1 hour").writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_killed_runs_deliver_once(spark, tmp_path):
    """Batches that die before their commit, or are repeated after it, change nothing."""
    c = Checkpoint(spark, f"file://{tmp_path}/state")
    requests = lambda *n: spark.createDataFrame([(f"f{i}", f"http://e/{i}", 0, i % 2, i) for i in n], "fp string, url string, depth int, priority int, seq long")
    items = lambda *n: spark.createDataFrame([(f"i{i}", f'{{"n":{i}}}') for i in n], "_id string, item string")
    done = lambda *n: spark.createDataFrame([(f"f{i}", "ok") for i in n], "fp string, outcome string")
    assert c.pending().count() == 0 and c.next_batch() == 0
    assert c.deliver(0, items(), None, requests(1, 2, 3, 3))
    assert [r.seq for r in c.pending().collect()] == [1, 3, 2]
    items(9).write.parquet(f"{tmp_path}/state/items/batch=1")  # killed: written, not committed
    assert c.read("items").count() == 0
    assert c.deliver(c.next_batch(), items(1, 1, 2), done(1), requests(3, 4))
    assert not c.deliver(1, items(7))  # repeated
    assert c.deliver(2, items(2, 3), done(3))
    again = Checkpoint(spark, f"file://{tmp_path}/state")  # a new run
    assert sorted(r._id for r in again.read("items").collect()) == ["i1", "i2", "i3"]
    assert [r.seq for r in again.pending().collect()] == [2, 4] and {r.fp for r in again.seen().collect()} == {"f1", "f2", "f3", "f4"}
    assert {r.counter: r.n for r in again.counted().collect()} == {"items": 3}


def test_stream_into_the_checkpoint(spark, tmp_path):
    rows = spark.createDataFrame([("a", "{}"), ("b", "{}"), ("a", "{}")], "_id string, item string")
    rows.write.parquet(f"{tmp_path}/in")
    c = Checkpoint(spark, f"file://{tmp_path}/state")
    for _ in range(2):  # the second run starts over, as after the loss of the stream's own checkpoint
        q = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(c.sink()).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r._id for r in c.read("items").collect()) == ["a", "b"]


def test_sinks_with_fields_and_schemas(spark, tmp_path):
    items = spark.createDataFrame([('{"a":1,"z":2}',), ('{"a":"x","b":null}',)], "item string")
    assert {r.key: r.n for r in sinks.extras(items, ["a"]).collect()} == {"z": 1, "b": 1}
    assert {r.key: (r.missing, r.wrong) for r in sinks.misfits(items, [("a", "bigint"), ("b", "double"), ("c", "string")]).collect()} == {"a": (0, 1), "b": (1, 0), "c": (2, 0)}
    with pytest.raises(ValueError):
        sinks.inferred(items, 2)
    sinks.write(spark.createDataFrame([(1, 2)], "a int, b int"), f"{tmp_path}/o.csv", fields=["b", "q"])
    assert spark.read.csv(f"{tmp_path}/o.csv", header=True).columns == ["b", "q"]
