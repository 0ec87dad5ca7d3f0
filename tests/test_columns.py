import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tabularium.operators import columns as C

CELLS = "county string, t long, row_idx int, col_idx int, header string, value string"
BY = ["t"]


def _cells(spark, tables):
    rows = [(county, t, i, j, heads[j], v) for t, (county, heads, body) in enumerate(tables) for i, r in enumerate(body) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, CELLS)


def _plain_score(heads, body, known):
    """The scores of a table's columns, cell by cell."""
    out = []
    for j, h in enumerate(heads):
        values = [(r[j] if j < len(r) else None) or "" for r in body]
        low = (h or "").lower()
        hits = sum(any(SequenceMatcher(None, k.lower(), v.lower()).ratio() >= 0.8 for k in known) for v in values if v) / len(body)
        signs = sum("%" in v for v in values) / len(body)
        score = 0.8 if any(w in low for w in ("ward", "precinct")) and low != "candidate" else 0.0
        score += 0.7 if hits > 0.5 else 0
        score += 0.2 if len({v.lower() for v in values}) > 3 and not all(v.replace(",", "").isdigit() for v in values if v) else 0
        percent = 1.0 if "percent" in low else 0.8 if "%" in low else 0.0
        out.append((round(max(score, 0.5 + hits if hits > 0.5 else 0), 5), round(max(percent, 0.5 + signs if signs > 0.5 else 0), 5)))
    return out


def test_scores_equal_a_plain_count(spark):
    rng = random.Random(4)
    districts = {"x": ["North Side", "South Side", "Mill Town"], "y": ["Old Harbour", "Lake"]}
    values = ["north side", "Nort Side", "Lake", "lakes", "Old Harbor", "12", "1,200", "5%", "80 %", "", None, "other", "Mill"]
    heads = ["Ward", "Candidate", "% in", "Percent", None, "Total", "Precinct %"]
    tables = []
    for _ in range(30):
        names, width = rng.sample(heads, 4), rng.randrange(1, 5)
        usual = rng.sample(values, 3)
        tables.append((rng.choice("xy"), names, [[rng.choice(usual if rng.random() < 0.8 else values) for _ in range(width)]] + [[rng.choice(usual) for _ in range(rng.randrange(1, width + 1))] for _ in range(rng.randrange(6))]))
    known = spark.createDataFrame([(c, n) for c, ns in districts.items() for n in ns] + [("x", None), ("x", "North Side")], "county string, name string")
    got = {(r["t"], r["col_idx"]): (round(r["location_score"], 5), round(r["percent_score"], 5)) for r in C.column_scores(_cells(spark, tables), BY, known, "name", ["county"]).collect()}
    want = {(t, j): s for t, (c, names, body) in enumerate(tables) for j, s in enumerate(_plain_score(names, body, districts[c])) if any(j < len(r) for r in body)}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 1e-4 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_shares_are_filled_in_short_rows_too(spark):
    tables = [
        ("x", ["Ward", "Percent"], [["a", ""], ["b"], ["c", "40%"], ["d", "60%"], ["e", None]]),  # own column, short row, null
        ("x", ["Ward", "Percent"], [["a 7%", ""], ["b"]]),  # another cell's sign: the whole cell
        ("x", ["Ward", "Votes"], [["a", "5%"], ["b", ""]]),  # no column of shares
        ("x", ["Ward", "Percent"], [["a", ""]]),  # no share told
    ]
    cells = _cells(spark, tables)
    picked = spark.createDataFrame([(0, 0, "Ward", 1, "Percent"), (1, 0, "Ward", 1, "Percent"), (2, 0, "Ward", None, None), (3, 0, "Ward", 1, "Percent")], "t long, location_idx int, location string, percent_idx int, percent string")
    got = {(r["t"], r["row_idx"], r["col_idx"]): r["value"] for r in C.with_percent(cells, picked, BY).collect()}
    assert [got[0, i, 1] for i in range(5)] == ["40%", "40%", "40%", "60%", "40%"]
    assert [got[1, i, 1] for i in range(2)] == ["a 7%", "a 7%"] and got[2, 1, 1] == "" and got[3, 0, 1] == ""
    page = {(r["t"], r["row_idx"], r["col_idx"]): r["value"] for r in C.with_percent(cells, picked, BY, F.lit("99%")).collect()}
    assert page[0, 1, 1] == "40%" and page[1, 1, 1] == "99%" and page[3, 0, 1] == "99%"


def test_first_of_equal_columns_and_threshold(spark):
    scores = spark.createDataFrame([(1, 0, "a", 0.8, 0.0), (1, 1, "b", 0.8, 0.8), (2, 0, "c", 0.7, 0.7), (3, 4, None, 1.0, 0.0)], "t long, col_idx int, header string, location_score double, percent_score double")
    assert {tuple(r) for r in C.picked_columns(scores, BY).collect()} == {(1, 0, "a", 1, "b"), (2, None, None, None, None), (3, 4, None, None, None)}


def test_stages_of_headers(spark):
    tables = {1: ["Name", "City ward", "Ward"], 2: ["Reported", "City Ward", "x %"], 3: ["Reported", "ED"], 4: ["a", "Utah"], 5: ["a", "b"], 6: [None, ""], 7: ["% Reporting", "now % reporting"], 8: ["now % reporting now", "Percent %"]}
    headers = spark.createDataFrame([(t, j, h) for t, hs in tables.items() for j, h in enumerate(hs)], "t long, col_idx int, header string")
    got = {r["t"]: tuple(r)[1:] for r in C.location_headers(headers, BY, F.col("header") == "Utah").collect()}
    assert got == {
        1: ("Ward", "exact", None, None), 2: ("City Ward", "contains", "x %", "sign"), 3: ("ED", "exact", None, None), 4: ("Utah", "entity", None, None), 5: ("a", "first", None, None),
        6: (None, "first", None, None), 7: ("% Reporting", "first", "% Reporting", "exact"), 8: ("now % reporting now", "first", "now % reporting now", "contains")}


def test_predicates(spark):
    tables = [
        ("x", ["Candidate", "Total Votes"], [["a", "1"], ["Write-in", "2"]]),
        ("x", ["Ward", "a"], [["1", "2"]]),
        ("x", [f"c{i}" for i in range(11)], [["1"] * 11] * 3),
        ("x", ["Votes", "Nominee"], [["1", "x"]] * 12),
    ]
    cells = _cells(spark, tables)
    headers = cells.select("t", "col_idx", "header").distinct().union(spark.createDataFrame([(9, 0, None)], "t long, col_idx int, header string"))
    got = {r["t"]: r.asDict() for r in C.predicates(cells, headers, BY).collect()}
    true = lambda t: {k for k, v in got[t].items() if v is True}
    assert true(0) == {"candidate_rows", "candidate_cols", "flat_candidates", "candidate_footer"} and got[0]["by_entities"] == "candidate-major"
    assert true(1) == {"precinct_major", "single_row"} and got[1]["by_entities"] == "ambiguous"
    assert got[2]["shape"] == "wide" and got[3]["shape"] == "long" and true(3) == {"candidate_cols"}
    assert true(9) == set() and got[9]["shape"] == "ambiguous"
    assert C.predicates(cells.limit(0), headers.limit(0), BY).count() == 0


def test_previews_of_no_cells(spark):
    empty = spark.createDataFrame([], CELLS)
    picked = C.picked_columns(C.column_scores(empty, BY, spark.createDataFrame([], "name string"), "name"), BY)
    assert picked.count() == 0 and C.previews(empty, picked, BY).count() == 0 and C.with_percent(empty, picked, BY).count() == 0
