import __spark_entry__
import corpus_pipeline


def test_pipeline(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert sorted(out.columns) == sorted(docs.columns), name
        out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0.5 * n <= docs.count() <= n, name
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert len(last) == n and all(r.round_trip for r in last)


def test_registry():
    names = [q for q in __spark_entry__.queries() if q.startswith("op") and "_" in q and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11))
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, and extra columns with names that the stages use themselves."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = "A text that is long enough to be judged by its characters and that holds no passage of the benchmark at all. "
    rows = [(None, None, None, None, None, "x", 1), (-1, None, "en", "s", 0, "x", 1), (-2, "", "en", "s", 0, "x", 1), (-3, text, None, None, None, None, None), (-3, text, None, None, None, None, None), (None, text + "more", "xx", None, 1, None, 2)]
    odd = spark.createDataFrame(rows, docs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ") + ", __gone string, row int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, d)
        assert out.columns == odd.columns, name
        out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        odd = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted((r.doc_id or 0, (r.text or "")[:6]) for r in odd.collect()) in ([(-3, "A text"), (-1, ""), (0, "A text")], [(-3, "A text"), (0, "A text"), (-1, "")])
    last = corpus_pipeline.STAGES[-1][1](spark, odd, d)
    assert last.count() == 3
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), d).count() == 0, name
