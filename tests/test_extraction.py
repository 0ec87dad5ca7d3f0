"""Names, cascades, extraction, files and stores on small invented rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabularium.functions import names as N
from tabularium.functions import text as T
from tabularium.operators import extraction as X
from tabularium.operators import features, lookup, store
from tabularium.sources import files, pages


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x string")


def test_state_names(spark):
    said = ["ny", " New York ", "new_york", "ElecResultsFL", "results-tx-2024", "Ohio final", "nowhere 7", "", None, "district of columbia"]
    got = [r[0] for r in texts(spark, said).orderBy("id").select(N.state_name(F.col("x"))).collect()]
    assert got == ["new_york", "new_york", "new_york", "florida", "texas", "ohio", "nowhere_7", None, None, "district_of_columbia"]


def test_county_names(spark):
    said = ["Miami-Dade County", "miami_dade-county", "ResultsKingsCounty2024", "12 Kings ", "", None]
    got = [r[0] for r in texts(spark, said).orderBy("id").select(N.county_name(F.col("x"))).collect()]
    assert got == ["miami dade", "miami dade", "resultskings", "kings", None, None]


def test_cascades(spark):
    got = texts(spark, ["Council District 7", "Ward 12 race", "Distrct 9B seat", "at large", "", None]).orderBy("id").select(N.district(F.col("x")).alias("d")).select("d.*").collect()
    assert [tuple(r) for r in got] == [("7", 0.95, "regex", "pass"), ("12", 0.85, "number", "pass"), ("9", 0.75, "fuzzy", "pass"), (None, 0.0, "regex", "fail"), (None, 0.0, "regex", "fail"), (None, 0.0, "regex", "fail")]
    got = texts(spark, ["GREEN list", "Libertaran ticket", "Greek", "nobody"]).orderBy("id").select(N.party(F.col("x")).alias("d")).select("d.*").collect()
    assert [(r["value"], r["method"], r["result"]) for r in got] == [("GREEN", "regex", "pass"), ("Libertarian", "fuzzy", "pass"), ("Green", "fuzzy", "pass"), (None, "regex", "fail")]


def test_paths_and_redirects(spark):
    got = [r[0] for r in texts(spark, ["a/../b", "../x", "a/../../x", "./a//b", "/etc", "", "a/b/.."]).orderBy("id").select(N.inside("/d", F.col("x"))).collect()]
    assert got == ["/d/b", None, None, "/d/a/b", None, "/d/", "/d/a"]
    got = [r[0] for r in texts(spark, ["http://a.org/x", "ftp://a.org", "https://b.org", "//a.org", None, "javascript:1"]).orderBy("id").select(N.redirect(F.col("x"), ("a.org",))).collect()]
    assert got == ["http://a.org/x", "/", "/", "/", "/", "/"]


def test_contexts_overlap_and_ignore_case(spark):
    text = "aXax" + "y" * 40 + "AXAXA"
    got = texts(spark, [text, "", None, "no hit", "a.x a+x"]).orderBy("id").select(T.context_windows(F.col("x"), "axa", 3)).collect()
    low, want = text.lower(), []
    for i in range(len(text)):
        if low[i : i + 3] == "axa":
            want.append(text[max(0, i - 3) : i + 6])
    assert got[0][0] == want and len(want) == 3 and list(got[1][0]) == [] and got[2][0] is None and list(got[3][0]) == []
    assert texts(spark, ["a.x a+x"]).select(T.context_windows(F.col("x"), "a+x", 2)).first()[0] == ["x a+x"]


def test_context_of_many_hits_is_linear(spark):
    assert len(texts(spark, ["tion " * 20_000]).select(T.context_windows(F.col("x"), "tion")).first()[0]) == 20_000


PAGE = """<html><body><h2>Town 5% reported</h2><div class="row"><p><span>Candidate</span><span>Votes</span></p><p><span>Ann</span><span>1,200</span></p>
<p><span>Bo</span></p><p><span></span><span></span></p><p><span>Total</span><span>9</span></p></div><div class="row"><p>alone</p></div>
<div class="result-row"><p><b>7</b></p><p><span>1</span><span>2</span></p><p><span>3</span><span>4</span></p></div>
<div><div><table><tr><td>x</td></tr></table></div></div></body></html>"""


@pytest.fixture(scope="module")
def found(spark):
    return pages.segments(spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>no tables")], "page_id long, html string")).cache()


def test_rows_headers_and_bodies(found):
    got = X.repeated_rows(found)
    assert {r["heading"] for r in got.collect()} == {"Town 5% reported"}
    headers = X.headers_of(got)
    assert sorted(list(r["headers"]) for r in headers.collect())[1] == ["Candidate", "Votes"]
    body = X.body_of(got, headers)
    named = body.where(F.map_contains_key("values", F.lit("Candidate")))
    assert sorted((r["values"]["Candidate"], r["values"]["Votes"]) for r in named.collect()) == [("Ann", "1,200"), ("Bo", "")]
    placed = X.with_place(named).first()
    assert placed["place_column"] == "Town" and placed["values"]["Town"] == "Town 5% reported" and placed["values"]["Percent Reported"] == "5%"


def test_sections_without_heading(found):
    assert [r["section"] for r in X.section_headings(found).collect()] == ["Town 5% reported"]
    alone = pages.segments(found.sparkSession.createDataFrame([(9, "<div><table><tr><td>x</table></div><table></table>")], "page_id long, html string"))
    assert sorted(r["section"] for r in X.section_headings(alone).collect()) == ["Section 1", "Section 2"]


def test_names_of_candidates(spark):
    got = [r[0] for r in texts(spark, ["1 Ann Lee DEM", "Bo REP", "x\n y z", ""]).orderBy("id").select(X.candidate_and_party(F.col("x"))).collect()]
    assert got == ["Ann Lee (DEM)", "Bo REP", "y (z)", ""]


def test_files_behind_notes_keep_rows_equal_to_notes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("note,1\nPrecinct,Votes\nnote,1\nPrecinct,Votes\n7,8\n")
    (tmp_path / "b.csv").write_text("Votes,Precinct,Extra\n5,6,z\n")
    got = files.with_preamble(spark, str(tmp_path), ("precinct",))
    assert sorted(got.columns) == ["Extra", "Precinct", "Votes"]
    assert rows(got.select("Precinct", "Votes", "Extra")) == sorted([("note", "1", None), ("Precinct", "Votes", None), ("7", "8", None), ("6", "5", "z")], key=str)


def test_density_noise_is_brute_force(spark):
    rng = random.Random(5)
    points = [(i, rng.choice([0.0, 5.0]) + rng.gauss(0, 0.3), rng.gauss(0, 1.5)) for i in range(150)] + [(200 + i, 20.0, 20.0) for i in range(4)] + [(300, 50.0, 50.0)]
    near = {i: [j for j, a, b in points if math.hypot(a - x, b - y) <= 0.4] for i, x, y in points}
    core = {i for i, own in near.items() if len(own) >= 4}
    want = sorted((i, i in core, not any(j in core for j in near[i])) for i, _, _ in points)
    got = features.density_noise(spark.createDataFrame(points, "id int, x double, y double"), "id", ["x", "y"], 0.4, 4)
    assert sorted((r["id"], r["core"], r["noise"]) for r in got.collect()) == want


def test_components_are_those_of_the_covariance(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    got = features.projected(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>"), "id", "v").orderBy("id").collect()
    vectors = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs([r["components"] for r in got]), np.abs(x @ vectors), atol=1e-6)


def test_clusters_keep_the_nearest(spark):
    said = ["red green blue"] * 4 + ["one two three"] * 5 + ["red green", "one two"]
    got = features.text_clusters(texts(spark, said), "id", "x", k=2)
    assert {(r["rank"]) for r in got.collect()} == {1, 2, 3} and got.count() == 6
    groups = {}
    for r in got.collect():
        groups.setdefault(r["cluster"], set()).add(said[r["id"]].split()[0])
    assert sorted(map(sorted, groups.values())) == [["one"], ["red"]]


def test_sources_and_corrections(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    first, second = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), spark.createDataFrame([(1, "c"), (2, "d")], "k int, v string")
    assert rows(lookup.first_source(keys, "k", first, second)) == [(1, "a", 0), (1, "b", 0), (2, "d", 1)]
    with pytest.raises(ValueError):
        lookup.overridden(texts(spark, ["x"]), "x", spark.range(5).selectExpr("id as ord", "'f' as fragment", "'m' as module"), most=3)
    library = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 4)], "id int, label string, n int")
    changes = spark.createDataFrame([(1, "edit", "A", None), (2, "remove", None, None), (3, "merge", None, 4)], "id int, action string, label string, into int")
    assert rows(store.corrected(library, changes, "id", "n")) == [(1, "A", 1), (4, "d", 7)]
