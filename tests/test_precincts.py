from tabularium.operators import precincts as R
from tabularium.sources import pages as P

HEAD = "<thead><tr><th>Name</th><th>Mail</th><th>Early</th><th>Total</th></tr></thead>"


def _table(*rows):
    return f"<table>{HEAD}<tbody>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</tbody></table>"


def _rows(spark, *pages, missing=True):
    found = P.segments(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))
    cells = R.precinct_cells(found)
    return sorted((r["page_id"], r["precinct"], r["report"], r["candidate"], r["method"], r["votes"]) for r in (R.with_missing(cells) if missing else cells).collect())


def test_labels_open_and_tables_close(spark):
    bad = "<table><tr><td>Ann</td></tr></table>"
    page = f"<h3>Office</h3>{_table(['x', 1, 2, 3])}<h3>Ward 1</h3>{bad}<h3>Overview</h3>{_table(['1 Ann Lee REP', 1, 2, 3], ['short', 1])}{_table(['y', 1, 2, 3])}"
    assert _rows(spark, page) == [(0, "Ward 1", "", "Ann Lee (REP)", m, v) for m, v in (("Early", "2"), ("Mail", "1"), ("Total Votes", "3"))]


def test_missing_candidates_of_earlier_tables_only(spark):
    page = f"<h3>Ward 1</h3>{_table(['Ann', 1, 2, 3])}<h3>Ward 2</h3>{_table(['Bob', 4, 5, 9], ['Bob', 4, 6, 10])}"
    got = _rows(spark, page, f"<h3>Ward 1</h3>{_table(['Cy', 1, 1, 2])}")
    assert {r[3] for r in got if r[:2] == (0, "Ward 1")} == {"Ann"}
    assert {(r[3], r[4], r[5]) for r in got if r[1] == "Ward 2"} == {("Ann", "Mail", "-"), ("Ann", "Early", "-"), ("Ann", "Total Votes", "-"), ("Bob", "Mail", "4"), ("Bob", "Early", "6"), ("Bob", "Total Votes", "10")}
    assert {r[3] for r in got if r[0] == 1} == {"Cy"}


def test_report_and_labels_in_tables(spark):
    report = '<span class="ng-star-inserted a fw-bold">Fully Reported</span>'
    inner = _table(["<span>District 9</span>", 1, 2, 3])
    got = _rows(spark, report + "<span>Precinct A</span>" + inner + _table(["Bob", 1, 2, 3]), '<span class="fw-bold">Fully Reported</span><h3>7</h3>' + inner, missing=False)
    assert {(r[0], r[1], r[2], r[3]) for r in got} == {(0, "Precinct A", "Fully Reported", "District 9"), (0, "District 9", "Fully Reported", "Bob"), (1, "7", "", "District 9")}


def test_nothing_to_find(spark):
    assert _rows(spark, "", None, "<h3>Ward 1</h3>", f"{_table(['Ann', 1, 2, 3])}") == []
    assert _rows(spark, f"<h3>Ward 1</h3><table>{HEAD}<tbody></tbody></table>{_table(['', '', '', ''])}") == [(0, "Ward 1", "", "", m, "") for m in ("Early", "Mail", "Total Votes")]
