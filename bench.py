"""Times the headline queries, and the kernels in one thread; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = "page_title h1_xpath nav_links resolved_links canonical_urls dedup_pages item_extract link_counts nth_child relational_descendant host_stats breaker_window throttle_fold readable_text".split()


def kernels(htmls: list[str]) -> dict:
    """Pages and MB a second in one thread: parse alone, parse and 3 CSS queries, parse and 6 XPath queries."""
    from pagelathe.functions import css, xpath
    from pagelathe.functions.html import parse

    jobs = {
        "parse": (None, ()),
        "parse_css3": (css, ("h1::text", "nav a::attr(href)", "article p")),
        "parse_xpath6": (xpath, ("//a/@href", "//h1", "count(//li)", "//p[2]", "//nav//li[last()]", "string(//title)")),
    }
    size, out = sum(len(h.encode()) for h in htmls) / 1e6, {}
    for name, (kind, queries) in jobs.items():
        start = time.perf_counter()
        for h in htmls:
            doc = parse(h)
            for q in queries:
                kind.select(doc, q)
        took = time.perf_counter() - start
        out[name] = {"pages_per_s": round(len(htmls) / took, 1), "mb_per_s": round(size / took, 2)}
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    from pagelathe.plans.queries import QUERIES as queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.files.maxPartitionBytes": "1m", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/pages.parquet").count()  # the session's own start is not a query's
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    htmls = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").limit(500).collect()]
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "kernels": kernels(htmls), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
