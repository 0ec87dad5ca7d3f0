"""What the findings of the fourth round showed, on small inputs."""

import random
import re

import pyarrow as pa
import pytest
from compare import difference
from pyspark.sql import functions as F

from tabularium.operators import columns as C
from tabularium.plans import columns, registry
from tabularium.sources import pages as P

_BITS = "<table> <tr> <td> <th> </td> </tr> </table> x <p> </p> <b> </b> <custom> <br> <input> &amp; & <TR> <!--z--> <thead> <title> <li> <script> </script> <br/> <tr><td>a</td><td>b</td></tr> <tr><th>a</th></tr> <td>q</td>".split() + ["\n", " y ", "<td class=a>"]


def _pages(n):
    rng = random.Random(7)
    for i in range(n):
        few = _BITS[: rng.choice([12, len(_BITS)])]
        yield i, "<table><tr><th>h</th><th> </th></tr>" * rng.randrange(2) + "".join(rng.choices(few + _BITS[-5:], k=rng.randrange(60)))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_numbered_in_the_walk_as_they_are_from_segments(spark):
    table = spark.createDataFrame([*_pages(600), (-1, None), (-2, "")], "page_id long, html string")
    names = ["page_id", "table_idx", "row_idx", "col_idx", "header", "value", "nested"]
    got, want = P.page_cells(table), P.table_cells(P.segments(table)).select(names)
    rows = sorted(map(str, want.collect()))
    assert len(rows) > 500 and sorted(map(str, got.select(names).collect())) == rows
    counted = want.groupBy("page_id", "table_idx").agg(F.count_distinct("row_idx").alias("n_rows"))
    assert sorted(map(str, got.select("page_id", "table_idx", "n_rows").distinct().collect())) == sorted(map(str, counted.collect()))
    assert "Exchange" not in _plan(got)


def test_cells_leave_python_in_bounded_batches():
    page = "<table><tr><th>a</th></tr>" + "<tr><td>x</td></tr>" * 25_000 + "</table>"
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2], "html": [page, page]})
    sizes = [b.num_rows for b in P._cells(iter([batch]))]
    assert sum(sizes) == 50_000 and max(sizes) <= P.MOST_CELLS


@pytest.mark.parametrize("name", ["markup_tables", "scored_columns"])
def test_pages_that_are_read_once_are_not_parsed_into_segments(spark, data, monkeypatch, name):
    def segments(_):
        raise AssertionError("segments of pages that are read once")

    monkeypatch.setattr(P, "segments", segments)
    assert "MapInArrow" in _plan(registry.QUERIES[name](spark, data)) or name == "scored_columns"


def test_written_cells_are_shuffled_once(spark, data):
    plan = _plan(registry.QUERIES["scored_columns"](spark, data))
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["table_previews", "filled_percents", "scored_columns"])
def test_lines_are_dealt_to_as_many_tasks_as_they_need(spark, data, monkeypatch, name):
    """6,000 lines: however little they take in a shuffle, a task's cells are bounded."""
    monkeypatch.setattr(columns, "TASK_LINES", 500)
    plan = _plan(registry.QUERIES[name](spark, data))
    assert set(re.findall(r"Exchange hashpartitioning\(table_id#\d+L?, (\d+)\), (\w+)", plan)) == {("13", "REPARTITION_BY_NUM")}


def test_marked_columns_are_the_picked_ones(spark):
    scores = spark.createDataFrame([(1, 0, "a", 0.8, 0.0), (1, 1, "b", 0.8, 0.8), (2, 0, "c", 0.7, 0.7), (3, 4, None, 1.0, 0.0)], "t long, col_idx int, header string, location_score double, percent_score double")
    got = {(r["t"], r["col_idx"]): (r["is_location"], r["is_percent"]) for r in C.marked_columns(scores, ["t"]).collect()}
    assert got == {(1, 0): (True, False), (1, 1): (False, True), (2, 0): (False, False), (3, 4): (True, False)}


@pytest.mark.parametrize("name", ["table_previews", "filled_percents"])
def test_lines_are_shuffled_once_and_cells_not_at_all(spark, data, name):
    plan = _plan(registry.QUERIES[name](spark, data))
    keys = re.findall(r"Exchange hashpartitioning\((\S+?)#\d+L?, \d+\)", plan)
    assert keys == ["table_id"] * 2 and plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan
    # of the two, one is read twice
    below = re.findall(r"Exchange hashpartitioning.*?\n(.*?)\n.*?\n.*?FileScan", plan)
    assert len({re.sub(r"[#:+\-\s]\d*L?", "", x) for x in below}) == 1


@pytest.mark.parametrize("name", ["table_previews", "filled_percents", "scored_columns", "structure_predicates"])
def test_lines_without_keys(spark, data, tmp_path, name):
    line = spark.read.parquet(f"{data}/lineitem.parquet").limit(400)
    line.withColumn("l_partkey", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_partkey"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.read.parquet(f"{data}/region.parquet").write.parquet(str(tmp_path / "region.parquet"))
    assert difference(spark, registry.QUERIES[name], registry.SQL[name], str(tmp_path)) == ""


def test_rows_are_filled_as_cells_are(spark):
    """Rows counted beforehand, first signs found with the sums; another column's sign, a row without the cell, no sign, no column."""
    tables = [[["a", ""], ["b"], ["c", "40%"], ["d", "60%"]], [["a 7%", ""], ["b"]], [["a", ""]], [["5%"]], [["", "3%"], [None, "2%"]]]
    heads = [["Ward", "Percent"]] * 3 + [["Ward"]] + [["%", "Share"]]
    cells = spark.createDataFrame([(t, i, j, heads[t][j], v, len(body)) for t, body in enumerate(tables) for i, r in enumerate(body) for j, v in enumerate(r)], "t long, row_idx int, col_idx int, header string, value string, n long")
    picked = C.picked_percent(C.percent_scores(cells, ["t"], "n"), ["t"])
    rows = cells.groupBy("t", "row_idx").agg(F.collect_list(F.struct("col_idx", "header", "value")).alias("cells"))
    known = spark.createDataFrame([("x",)], "name string")
    long = C.with_percent(cells, C.picked_columns(C.column_scores(cells, ["t"], known, "name"), ["t"]), ["t"])
    got = sorted(map(str, C.rows_with_percent(rows, picked, ["t"]).collect()))
    assert got == sorted(map(str, long.collect())) and len(got) == 19
    assert {(r["t"], r["row_idx"]): r["value"] for r in long.where("col_idx = 1").collect()} == {(0, 0): "40%", (0, 1): "40%", (0, 2): "40%", (0, 3): "60%", (1, 0): "a 7%", (1, 1): "a 7%", (2, 0): "", (4, 0): "3%", (4, 1): "2%"}
