import pytest
from pyspark.sql import functions as F

from tabularium.session import new_path
from tabularium.sources import pages, pagestore


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, html string")


ROWS = [(1, "<div><p>one"), (2, "<div><p>one"), (3, None), (4, ""), (5, "<h1>x</h1><ul><li>a<li>b</ul>"), (6, "no tags"), (7, "<p>" * 300)]


def same(got, want):
    rows = lambda df: sorted(map(str, df.collect()))
    return rows(got) == rows(want)


def test_each_markup_is_parsed_once(spark):
    store = pagestore.PageStore(spark, new_path(spark, "pages"))
    assert same(store.segments(table(spark, ROWS)), pages.segments(table(spark, ROWS)))
    assert store.parsed == 5  # equal markup, and null and empty, are one
    assert same(store.segments(table(spark, ROWS[::-1])), pages.segments(table(spark, ROWS)))
    assert store.parsed == 0
    more = [*ROWS, (8, "<div>new"), (9, "<div><p>one")]
    assert same(store.segments(table(spark, more)), pages.segments(table(spark, more))) and store.parsed == 1
    again = pagestore.PageStore(spark, store.folder)  # another driver
    assert same(again.segments(table(spark, more)), pages.segments(table(spark, more))) and again.parsed == 0
    assert again.index().select("run").distinct().count() == 2


def test_a_run_without_its_index_has_stored_nothing(spark):
    store = pagestore.PageStore(spark, new_path(spark, "pages"))
    store.scan(table(spark, ROWS[:1]))
    wrong = spark.read.parquet(f"{store.folder}/segments").where("false").drop("run")
    lost = spark.createDataFrame([("0" * 64, 0, "div")], "digest string, idx int, tag string")
    wrong.unionByName(lost, allowMissingColumns=True).write.parquet(f"{store.folder}/segments/run=broken")
    assert same(store.segments(table(spark, ROWS)), pages.segments(table(spark, ROWS))) and store.parsed == 4


def test_two_runs_with_one_digest(spark):
    """Two drivers that parse the same markup at a time: readers take one run's segments."""
    store = pagestore.PageStore(spark, new_path(spark, "pages"))
    store.scan(table(spark, ROWS[:1]))
    run = store.index().first()["run"]
    copy = spark.read.parquet(f"{store.folder}/segments/run={run}")
    copy.write.parquet(f"{store.folder}/segments/run=zz")
    spark.read.parquet(f"{store.folder}/index").withColumn("run", F.lit("zz")).coalesce(1).write.mode("append").parquet(f"{store.folder}/index")
    assert same(store.segments(table(spark, ROWS[:2])), pages.segments(table(spark, ROWS[:2])))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "plain")]])
def test_pages_without_segments(spark, rows):
    store = pagestore.PageStore(spark, new_path(spark, "pages"))
    assert store.segments(table(spark, rows)).collect() == []
    assert store.segments(table(spark, rows)).collect() == [] and store.parsed == 0
