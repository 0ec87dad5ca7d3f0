"""Operators on small invented tables: what SQL cannot say, and odd rows."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.functions import fuzzy
from tabularium.functions import text as T
from tabularium.operators import features, integrity, lookup, pivots, store, structures, tables
from tabularium.sources import files, pages
from tabularium.streaming import alerts


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_fuzzy_functions(spark):
    got = spark.createDataFrame([("Éric ﬁn", "eric fin"), (None, "x")], "a string, b string").select(fuzzy.fold("a"), fuzzy.ratio("a", "b")).collect()
    assert got[0][0] == "eric fin" and 0 < got[0][1] < 1 and tuple(got[1]) == (None, None)


def test_text_functions(spark):
    one = spark.createDataFrame([("City  of Élan – Ward 3 (Vote for 2) 1,234 80 % Reported 2024",)], "x string")
    got = one.select(
        T.collapse(F.col("x")), T.label(F.lit("Élan-3_a")), T.contest_title(F.lit("Mayor (Vote for 2)")), T.percent_reported(F.col("x")), T.year(F.col("x")), T.votes(F.lit("1,234")), T.votes(F.lit("-")),
        T.percent_reported(F.lit("Fully Reported")), T.place(F.lit("Kings County")), T.delimiter(F.lit("a;b;c\nd;e,f")), T.context_windows(F.lit("abXcdXef"), "X", 1),
    ).first()
    assert list(got)[1:] == ["élan3_a", "Mayor", "80%", 2024, 1234, None, "100%", "kings", ";", ["bXc", "dXe"]]


def test_harmonise_odd_rows(spark):
    df = spark.createDataFrame([(1, "a", "x", "1", "0"), (2, "a", "x", "1", "0"), (3, None, "x", "1", None), (4, "", "x", "1", ""), (5, "a", "x", "2", "0")], "ord int, loc string, cand string, mail string, void string")
    got = tables.harmonise(df, "loc", "cand", ["mail", "void"], "ord")
    assert got.columns == ["ord", "loc", "cand", "mail"]
    assert rows(got) == [(1, "a", "x", "1"), (3, "", "x", "1"), (4, "", "x", "1"), (5, "a", "x", "2")]
    assert tables.harmonise(df.where("false"), "loc", "cand", ["mail", "void"], "ord").count() == 0


def test_merged_headers(spark):
    got = spark.range(1).select(tables.merged_headers([F.array(F.lit("Name"), F.lit("Votes"), F.lit("")), F.array(F.lit(""), F.lit("Mail"), F.lit("12"))])).first()[0]
    assert got == ["Name", "Votes Mail", ""]


def test_pivot_refuses_too_many_columns(spark):
    with pytest.raises(ValueError):
        pivots.keys_of(spark.range(20).selectExpr("cast(id as string) k"), "k", 10)


def test_wide_results_of_odd_values(spark):
    votes = spark.createDataFrame([("u", "A", "P", "Mail", "1,000"), ("u", "A", "P", "Mail", "n/a"), ("v", "B", "Q", "Mail", None)], "unit string, candidate string, party string, ballot string, votes_raw string")
    got = {r["unit"]: r.asDict() for r in pivots.wide_results(votes).collect()}
    assert got["u"]["A (P) - Mail"] == 1000 and got["u"]["Grand Total"] == 1000 and got["v"]["Grand Total"] == 0 and got["TOTAL"]["Grand Total"] == 1000


def test_reads_a_table_behind_notes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Results of the day\n\nPrecinct, Candidate ,Votes\n1,"Roe, Ann",10\n2,Bo,\n,,\n')
    got = files.with_preamble(spark, str(path), ("precinct",))
    assert got.columns == ["Precinct", "Candidate", "Votes"] and rows(got) == [("1", "Roe, Ann", "10"), ("2", "Bo", None)]
    assert files.listing(spark, str(tmp_path), "csv").select("size").first()[0] == path.stat().st_size


def test_url_list(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# notes\n\nhttp://a\n  http://b \n")
    assert rows(files.url_list(spark, str(tmp_path / "urls.txt"))) == [("http://a",), ("http://b",)]


def test_segments_of_broken_markup(spark):
    html = "<div id=a><h2>Ward 1</h2><custom><p>one<p>two</custom><table><tr><th>N<th> <tr><td>x<td>y<td>z<tr><td> </table></div><script>var t='<p>';</script>"
    found = pages.segments(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))
    tags = [r["tag"] for r in found.where("page_id = 1").orderBy("idx").collect()]
    assert tags == ["div", "h2", "p", "p", "table", "tr", "th", "th", "tr", "td", "td", "td", "tr", "td"]
    assert found.where("page_id > 1").count() == 0 and pages.tree_faults(found).count() == 0
    assert rows(pages.table_cells(found).select("row_idx", "header", "value")) == [(0, "Column 2", "y"), (0, "Extra_1", "z"), (0, "N", "x")]
    assert {r["heading"] for r in found.where("tag = 'td'").collect()} == {"Ward 1"}


def test_isolation_finds_the_odd_one(spark):
    rng = np.random.default_rng(1)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (400, 2)))] + [(1000, 30.0, -30.0)]
    got = features.isolation_scores(spark.createDataFrame(points, "id long, x double, y double"), "id", ["x", "y"]).orderBy(F.desc("score")).first()
    assert got["id"] == 1000


def test_latest_version_of_a_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.rewrite_latest(spark, path, spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, ord int, s string"), ["k"], "ord")
    last = store.rewrite_latest(spark, path, spark.createDataFrame([(1, 2, "c"), (1, 0, "z")], "k int, ord int, s string"), ["k"], "ord")
    assert rows(spark.read.parquet(last)) == [(1, 2, "c"), (2, 1, "b")]


def test_results_by_folder(spark, tmp_path):
    df = spark.createDataFrame([("NY", None, 1), ("NY", "Kings", 2)], "state string, county string, n int")
    meta = store.write_results(df, str(tmp_path / "out"), ("state", "county"))
    assert rows(meta) == [("NY", "Kings", 1, "n"), ("NY", "Unknown", 1, "n")]
    assert rows(spark.read.parquet(str(tmp_path / "out/results")).select("county", "n")) == [("Kings", 2), ("Unknown", 1)]


def test_append_new(spark):
    old, new = spark.createDataFrame([("a", 1)], "k string, n int"), spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "k string, n int")
    assert rows(store.append_new(old, new, ["k"])) == [("b", 3)]


def test_alerts_are_polled_once(spark, tmp_path):
    folder, seen = str(tmp_path / "alerts"), []
    schema = "id long, level string"
    for part in ([(1, "low"), (2, "high")], [(3, "high")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        query = alerts.poll(alerts.alert_stream(spark, folder, schema), lambda df, n: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "checkpoint"))
        query.awaitTermination()
    assert seen == [1, 2, 3]


def test_similar_headers_become_one(spark):
    df = spark.createDataFrame([("a", "", "1"), ("b", "x", None)], "`Candidate Name` string, `Candidate Names` string, Votes string")
    got = structures.merge_similar_headers(df)
    assert got.columns == ["Candidate Name", "Votes"] and rows(got) == [("a", "1"), ("b", None)]


def test_choice_of_rows(spark):
    df = spark.range(5).toDF("id")
    assert rows(structures.chosen(df, "id", "2, 5,9,x")) == [(1,), (4,)] and structures.chosen(df, "id", "ALL").count() == 5 and structures.chosen(df, "id", "").count() == 0


def test_library_takes_what_is_new(spark):
    library, found = spark.createDataFrame([("Kings",)], "name string"), spark.createDataFrame([("kings ",), ("Queens",), ("queens",)], "name string")
    assert rows(structures.unseen(library, found, ["name"])) == [("Kings",), ("Queens",)]


def test_merged_maps(spark):
    got = spark.range(1).select(structures.merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(4)))).first()[0]
    assert got == {"a": 1, "b": 3, "c": 4}


def test_harmonise_twice_is_once(spark):
    df = spark.createDataFrame([(i, f"u{i % 3}", f"c{i % 2}", str(i % 4), "") for i in range(40)], "ord int, loc string, cand string, mail string, void string")
    once = tables.harmonise(df, "loc", "cand", ["mail", "void"], "ord")
    assert rows(tables.harmonise(once, "loc", "cand", ["mail"], "ord")) == rows(once)


def test_pivot_and_back(spark):
    cells = spark.createDataFrame([(f"u{i % 4}", f"C{i % 3}", "P", f"B{i % 2}", str(i)) for i in range(24)], "unit string, candidate string, party string, ballot string, votes_raw string")
    keyed = cells.withColumn("v", T.votes(F.col("votes_raw"))).withColumn("key", pivots.column_key(F.col("candidate"), F.col("party"), F.col("ballot")))
    back = pivots.parsed_headers(tables.melted(pivots.pivoted(keyed, "unit", "key", F.sum("v")), ["unit"])).where("value is not null")
    want = keyed.groupBy("unit", "candidate", "party", "ballot").agg(F.sum("v").cast("string"))
    assert rows(back.select("unit", "candidate", "party", "ballot", "value")) == rows(want)


def test_every_query_survives_empty_tables(spark, data, tmp_path):
    import os

    from tabularium.plans import registry

    for f in os.listdir(data):
        if f.endswith(".parquet"):
            spark.read.parquet(f"{data}/{f}").limit(0).write.parquet(f"{tmp_path}/{f}")
    needs_rows = {"kmeans_tfidf", "components"}  # there is nothing to fit
    for name in sorted(set(registry.QUERIES) - needs_rows):
        registry.QUERIES[name](spark, str(tmp_path)).count()


def test_outliers_with_and_without_groups(spark):
    df = spark.createDataFrame([(i, i % 2, 1.0 + i % 3) for i in range(60)] + [(100, 0, 50.0), (101, 2, 7.0)], "id int, g int, x double")
    assert [r["id"] for r in integrity.z_outliers(df, ["g"], "x").collect()] == [100]
    assert [r["id"] for r in integrity.z_outliers(df, [], "x").collect()] == [100]
    assert integrity.contamination(df, "x").first()[0] == 0.2
