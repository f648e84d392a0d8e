"""The paged feed: whole results, push-down, retries, and the stream's offsets."""

import time

import pytest
from pyspark.sql import functions as F

from scriptloom.sources import paged

SF = "/root/testdata/sf0.001"


def items(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600), "yyyy-MM-dd HH:mm:ss")
    return docs.select(F.col("doc_id").alias("id"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("doc_id") % 3 + 1).cast("int")).alias("keyword"), "source", at.alias("published"), F.col("text").alias("content"))


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    paged.register(spark)
    folder = str(tmp_path_factory.mktemp("feed"))
    paged.record(items(spark), folder, size=20)
    return folder


def read(spark, folder, **options):
    return spark.read.format("paged_feed").options(path=folder, initialDelay="0.01", **options).load()


def rows(df):
    return sorted(map(tuple, df.select(*paged.FIELDS).collect()))


def test_all_pages(spark, feed):
    assert rows(read(spark, feed)) == rows(items(spark))
    assert read(spark, feed, pagesPerTask="1").rdd.getNumPartitions() >= 9


def test_filters_reach_the_reader(spark, feed, capsys):
    for condition in ("keyword = 'b'", "published >= '2023-11-16 00:00:00' and published < '2023-11-18 00:00:00'", "keyword = 'a' and published > '2023-11-20 01:13:20'", "keyword = 'zz'", "published <= '2023-11-15 02:13:20' and id % 2 = 0", "keyword = 'a' and keyword = 'b'"):
        found = read(spark, feed).filter(condition)
        assert rows(found) == rows(items(spark).filter(condition)), condition
    read(spark, feed).filter("keyword = 'b' and id > 3").explain("formatted")
    plan = capsys.readouterr().out
    assert "keyword" not in plan.split("(2) ")[-1] or "PushedFilters" in plan
    few = read(spark, feed, pagesPerTask="1").filter("published < '2023-11-15 10:00:00'")
    assert few.rdd.getNumPartitions() <= 2  # pages outside the time range aren't fetched


def test_a_page_that_fails_twice(spark, feed, tmp_path):
    import shutil

    folder = str(tmp_path / "f")
    shutil.copytree(feed, folder)
    (tmp_path / "f" / "fail-3").write_text("2")
    start = time.perf_counter()
    found = read(spark, folder)
    assert rows(found) == rows(items(spark)) and time.perf_counter() - start > 0.03
    figures = paged.retry_figures(found).first()
    assert (figures.pages, figures.retries, figures.at_once) == (10, 2, 9)
    (tmp_path / "f" / "fail-3").write_text("9")
    with pytest.raises(Exception, match="page 3"):
        read(spark, folder, maxRetries="1").collect()


def test_stream_reads_new_pages_once(spark, tmp_path):
    paged.register(spark)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("feed", "out", "c"))
    for a, b in ((0, 90), (90, 200)):
        paged.record(items(spark).filter((F.col("id") >= a) & (F.col("id") < b)), folder, size=25)
        q = spark.readStream.format("paged_feed").options(path=folder, initialDelay="0.01").load().writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start(out)
        q.processAllAvailable()
        q.stop()
        assert rows(spark.read.parquet(out)) == rows(items(spark).filter(F.col("id") < b))
