"""What the findings of the third round showed, on small inputs."""

import hashlib

import pyarrow as pa
import pytest
from compare import difference
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tabularium.functions import names as N
from tabularium.operators import extraction as X
from tabularium.operators import review
from tabularium.plans import registry
from tabularium.session import new_path
from tabularium.sources import pages as P
from tabularium.sources import pagestore


def test_a_number_named_as_one_is_no_year(spark):
    rows = spark.createDataFrame([("Ann Lee, no 1999", 0.3, "candidate", ""), ("No. 2001 of all", 0.1, None, "no entities"), ("Jo Poe 1999", 0.5, "years", "date"), ("casino 1999", 0.4, "years", "date")], "text string, score double, field string, notes string")
    no = F.lit(False)
    got = rows.select("text", N.entry_score(F.col("text")).alias("score"), N.field_of(F.col("text"), no).alias("field"), F.array_join(N.notes(F.col("text"), no), ",").alias("notes"))
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


@pytest.mark.parametrize("span", [2, 1000])
def test_digests_of_labels_chain_all_nodes_in_order(spark, span):
    nodes = spark.createDataFrame([(i, ["a", "b", "a"] if i % 3 else ["b"], f"v{i * 7 % 11}") for i in (5, 3, 9, 1, 4, 12, 8)], "k long, labels array<string>, value string")
    got = {r["label"]: (r["digest"], r["n"]) for r in X.label_digests(X.grouped_labels(nodes, "k", "labels", "value"), "k", "value", span).collect()}
    said = {"a": [1, 4, 5, 8], "b": [1, 3, 4, 5, 8, 9, 12]}
    assert got == {label: (hashlib.md5(",".join(f"v{i * 7 % 11}" for i in keys).encode()).hexdigest(), len(keys)) for label, keys in said.items()}
    assert X.label_digests(X.grouped_labels(nodes.where("false"), "k", "labels", "value"), "k", "value").collect() == []


@pytest.mark.parametrize("name", ["page_labels", "page_titles"])
def test_references_end_with_a_semicolon(spark, tmp_path, name):
    html = "<html><head><title>cut {i} &amp&amp</title></head><body><h1>three more words &amp;&amp</h1><p>a &lt;b</p><ul><li>said = &quot;x&quot; &lt;</li><li><a href=\"/x?a=1&copy=2\">go &#x27;on&#x27;</a></li></ul></body></html>"
    spark.createDataFrame([(i, html.replace("{i}", str(i))) for i in range(3)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert difference(spark, registry.QUERIES[name], registry.SQL[name], str(tmp_path)) == ""


def test_segments_leave_python_in_bounded_batches():
    page = "<ul>" + "<li>x</li>" * 9 + "</ul>"
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(5_000)), "html": [page] * 4_999 + [None]})
    sizes = [b.num_rows for b in P._segments(iter([pages]))]
    assert sum(sizes) == 4_999 * 10 and max(sizes) < P.MOST_ROWS + 10
    long = pa.RecordBatch.from_pydict({"page_id": ["a", "b", "c"], "html": ["<p>" + "y" * P.MOST_CHARS] * 3})
    assert [b.num_rows for b in P._segments(iter([long]))] == [1, 1, 1]


def test_edits_of_a_pattern_meet_its_entries_once(spark, monkeypatch):
    """With 200 edits of a pattern of 300 entries, each entry is told one label, not 200."""
    told = []
    labels = review._labels
    monkeypatch.setattr(review, "_labels", lambda rows, key: told.append(rows) or labels(rows, key))
    entries = spark.range(300).select("id", F.concat(F.lit("<p>"), "id").alias("html"), F.lit("old").alias("label"), F.lit("p").alias("pattern_id"))
    changes = spark.range(200).select(F.col("id").alias("seq"), "id", F.lit("edit_pattern").alias("action"), F.concat(F.lit("new"), "id").alias("label"))
    got = review.reviewed_segments(entries, changes)
    assert {r["label"] for r in got.collect()} == {"new199"} and told[0].count() == 200 + 300


def test_one_page_of_each_digest_is_parsed_by_as_many_tasks_as_markup_needs(spark, monkeypatch):
    """Copies of a page, rows alike in page and digest, and pages without number; tasks of a few characters."""
    monkeypatch.setattr(pagestore, "TASK_CHARS", 40)
    rows = [(i, "<div><p>copy") for i in range(40)] + [(7, "<div><p>copy"), (7, "<h1>x"), (None, "<h1>x"), (None, "<p>y"), (-1, "<p>y"), (50, None)]
    table = spark.createDataFrame(rows, "page_id long, html string")
    store = pagestore.PageStore(spark, new_path(spark, "pages"))
    got, want = store.segments(table), P.segments(table)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and store.parsed == 4
    assert spark.read.parquet(f"{store.folder}/segments").count() == 2 + 1 + 1
    monkeypatch.setattr(pagestore, "FEW_PAGES", 3)
    streamed = store.segments(table)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, want.collect()))
    assert "ShuffledHashJoin" in streamed._jdf.queryExecution().executedPlan().toString()


def test_a_scan_has_as_many_tasks_as_its_markup_needs(spark, monkeypatch):
    monkeypatch.setattr(pagestore, "TASK_CHARS", 2_000)
    dealt, once = [], pagestore._once
    table = spark.range(2_000).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), "id").alias("html"))
    repartition = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, n, *c: dealt.append(n) or repartition(df, n, *c))
    store = pagestore.PageStore(spark, new_path(spark, "pages"))
    assert store.segments(table).count() == 2_000 and dealt == [7, 7]  # 12,890 characters
    batch = pa.RecordBatch.from_pydict({"page_id": ["aa", "bb", "aa"], "html": ["<p>1", "<p>2", "<p>1"]})
    assert sum(b.num_rows for b in once(iter([batch, batch]))) == 2


def test_markup_is_cut_out_of_wanted_segments_alone(spark):
    table = spark.createDataFrame([(1, "<div><p>a</p><p>b</p></div>"), (2, "<p>c</p>")], "page_id long, html string")
    found = P.segments(table)
    every = {(r["page_id"], r["idx"]): r["html"] for r in P.subtree_html(found, table).collect()}
    some = P.subtree_html(found, table, found.where("tag = 'div'").select("page_id", "idx")).collect()
    assert len(every) == 4 and [(r["page_id"], r["idx"], r["html"]) for r in some] == [(1, 0, every[1, 0])]
