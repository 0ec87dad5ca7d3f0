"""Queries that take tables out of pages: repeated rows, headers, places, candidates, and the chain to one result.

The pages are made of customers, twenty to a page, a panel for each market
segment: so a page's size is bounded at any scale, and SQL over the customers
says what has to come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions import text as T
from tabularium.operators import extraction as X
from tabularium.operators import pivots, tables
from tabularium.session import ship_package
from tabularium.sources import pages, pagestore

from .results import read


def made_pages(spark, sf_dir):
    """page_id, html: a panel for each segment, with a heading, a container of rows (names and votes, a total) and a table; every third page has a second row of headers, every second one a share reported."""
    ship_package(spark)
    (customer,) = read(spark, sf_dir, "customer")
    page = F.floor(F.col("c_custkey") / 20)
    row = lambda *cells: F.concat(F.lit("<p>"), *[F.concat(F.lit("<span>"), c, F.lit("</span>")) for c in cells], F.lit("</p>"))
    line = F.concat(F.lit("<tr><td>"), F.col("c_custkey").cast("string"), F.lit("</td></tr>"))
    own = customer.groupBy(page.alias("page_id"), "c_mktsegment").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row(F.col("c_name"), F.floor(F.abs("c_acctbal")).cast("string")).alias("row"), line.alias("line")))), lambda x: x).alias("rows"), F.count(F.lit(1)).alias("n")
    )
    second = F.when(F.col("page_id") % 3 == 0, row(F.lit("name"), F.lit("count"))).otherwise("")
    share = F.when(F.col("page_id") % 2 == 0, F.lit(" 80% Reported")).otherwise("")
    report = F.when(F.col("page_id") % 2 == 0, F.lit('<span class="fw-bold">Fully Reported</span>')).otherwise("")
    panel = F.concat(
        F.lit('<section class="panel"><h3>Ward '), "c_mktsegment", share, F.lit("</h3>"), F.lit('<div class="table-row" id="r1">'), row(F.lit("Candidate"), F.lit("Votes")), second, F.array_join(F.transform("rows", lambda x: x["row"]), ""),
        row(F.lit("Total"), F.col("n").cast("string")), F.lit("</div><div><table><tr><th>Key</th></tr>"), F.array_join(F.transform("rows", lambda x: x["line"]), ""), F.lit("</table></div><div>"), report, F.lit("</div></section>"),
    )
    return own.groupBy(F.col("page_id").cast("bigint").alias("page_id")).agg(F.concat(F.lit("<html><body>"), F.array_join(F.array_sort(F.collect_list(panel)), ""), F.lit("</body></html>")).alias("html"))


_scanned = {}


def _found(spark, sf_dir):
    """Segments of the made pages: scanned once in a session, then read from its store."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _scanned:
        _scanned[key] = pagestore.segments(made_pages(spark, sf_dir))
    return _scanned[key]


_BASE = """
c AS (SELECT c_custkey // 20 AS page_id, c_mktsegment AS seg, c_custkey, c_name, floor(abs(c_acctbal))::BIGINT::VARCHAR AS votes,
    'Ward ' || c_mktsegment || CASE WHEN (c_custkey // 20) % 2 = 0 THEN ' 80% Reported' ELSE '' END AS heading FROM customer),
t AS (SELECT page_id, seg, any_value(heading) AS heading, count(*) AS n, (page_id % 3 = 0)::INT AS extra FROM c GROUP BY ALL)"""


def repeated_rows(spark, sf_dir):
    rows = X.repeated_rows(_found(spark, sf_dir))
    return rows.select("page_id", "heading", "row_no", F.array_join("cells", "|").alias("cells"))


SQL_REPEATED = f"""WITH {_BASE}
SELECT page_id, heading, 0::INTEGER AS row_no, 'Candidate|Votes' AS cells FROM t
UNION ALL SELECT page_id, heading, 1, 'name|count' FROM t WHERE extra = 1
UNION ALL SELECT page_id, heading, (row_number() OVER (PARTITION BY page_id, seg ORDER BY c_custkey) + (page_id % 3 = 0)::INT)::INTEGER, c_name || '|' || votes FROM c
UNION ALL SELECT page_id, heading, (n + 1 + extra)::INTEGER, 'Total|' || n FROM t"""


def dom_headers(spark, sf_dir):
    """Headers of each container, and what its columns hold."""
    rows = X.repeated_rows(_found(spark, sf_dir))
    headers = X.headers_of(rows)
    heads = rows.where("row_no = 0").select("page_id", "table_idx", "heading")
    return X.column_stats(rows, headers).join(heads, ["page_id", "table_idx"]).select("page_id", "heading", "header", "numeric", "empty", "distinct")


SQL_HEADERS = f"""WITH {_BASE},
v AS (
    SELECT page_id, seg, heading, c_custkey, c_name, votes FROM c
    UNION ALL SELECT page_id, seg, heading, 1000000000000, 'Total', n::VARCHAR FROM t),
s AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY page_id, seg ORDER BY c_custkey) <= 20),
g AS (SELECT page_id, heading, count(DISTINCT c_name)::INTEGER AS names, count(DISTINCT votes)::INTEGER AS counts FROM s GROUP BY ALL)
SELECT page_id, heading, CASE WHEN page_id % 3 = 0 THEN 'Candidate name' ELSE 'Candidate' END AS header, 0.0::DOUBLE AS numeric, 0.0::DOUBLE AS empty, names AS distinct FROM g
UNION ALL SELECT page_id, heading, CASE WHEN page_id % 3 = 0 THEN 'Votes count' ELSE 'Votes' END, 1.0, 0.0, counts FROM g"""


def _body(spark, sf_dir):
    rows = X.repeated_rows(_found(spark, sf_dir))
    return X.body_of(rows, X.headers_of(rows))


def dom_rows(spark, sf_dir):
    """Rows behind the headers, without totals, as JSON."""
    return _body(spark, sf_dir).select("page_id", "heading", F.to_json("values").alias("row"))


SQL_DOM_ROWS = f"""WITH {_BASE}
SELECT page_id, heading, CASE WHEN page_id % 3 = 0 THEN '{{"Candidate name":"' || c_name || '","Votes count":"' || votes || '"}}' ELSE '{{"Candidate":"' || c_name || '","Votes":"' || votes || '"}}' END AS row FROM c"""


def location_tables(spark, sf_dir):
    """Rows with the place and the share reported that their heading tells."""
    found = X.with_place(_body(spark, sf_dir))
    return found.select("page_id", "place_column", F.element_at("values", F.col("place_column")).alias("place"), F.element_at("values", F.lit("Percent Reported")).alias("share"), F.size("values").alias("n"))


SQL_LOCATION = f"WITH {_BASE} SELECT page_id, 'Ward' AS place_column, heading AS place, CASE WHEN page_id % 2 = 0 THEN '80%' ELSE '' END AS share, 4::INTEGER AS n FROM c"


def section_tables(spark, sf_dir):
    found = _found(spark, sf_dir)
    return X.section_headings(found).select("page_id", "section")


SQL_SECTION = f"WITH {_BASE} SELECT page_id, heading AS section FROM t"


def _candidates(spark, sf_dir):
    found = _found(spark, sf_dir)
    rows = X.repeated_rows(found)
    headers = X.headers_of(rows)
    repeated = X.body_of(rows, headers).groupBy("page_id", "table_idx").agg(F.count(F.lit(1)).alias("n_rows")).join(headers, ["page_id", "table_idx"])
    cells = pages.table_cells(found)
    marked = cells.groupBy("page_id", "table_idx").agg(F.array_sort(F.collect_set("header")).alias("headers"), F.count_distinct("row_idx").alias("n_rows"))
    pattern = repeated.where(F.col("page_id") % 5 == 0)
    return X.candidates(marked, repeated, pattern)


def table_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("source", "page_id").agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n_rows").alias("n_rows"))


SQL_CANDIDATES = f"""WITH {_BASE}, g AS (SELECT page_id, count(*) AS n_tables, sum(n)::BIGINT AS n_rows FROM t GROUP BY 1)
SELECT 'table' AS source, * FROM g UNION ALL SELECT 'repeated', * FROM g UNION ALL SELECT 'pattern', * FROM g WHERE page_id % 5 = 0"""


def detected_tables(spark, sf_dir):
    """Of the tables of a page with the same headers, the first."""
    return X.first_of_headers(_candidates(spark, sf_dir)).select("page_id", "source", F.array_join("headers", "|").alias("headers"))


SQL_DETECTED = f"""WITH {_BASE}
SELECT DISTINCT page_id, 'table' AS source, 'Key' AS headers FROM t
UNION ALL SELECT DISTINCT page_id, 'repeated', CASE WHEN extra = 1 THEN 'Candidate name|Votes count' ELSE 'Candidate|Votes' END FROM t"""


def built_table(spark, sf_dir):
    """The whole chain: rows out of pages, places by headings, one name for each header, repeats dropped, wide by place with totals."""
    found = X.with_place(_body(spark, sf_dir))
    value = lambda word: F.element_at(F.map_values(F.map_filter("values", lambda k, _: F.startswith(F.lower(k), F.lit(word)))), 1)
    rows = found.select("page_id", F.regexp_replace(F.element_at("values", F.col("place_column")), r"^Ward (\w+).*$", "$1").alias("place"), value("candidate").alias("candidate"), value("votes").alias("votes"), F.struct("page_id", "row_no").alias("ord"))
    clean = tables.harmonise(rows.withColumn("mail", F.lit("1")), "place", "candidate", ["mail"], "ord")
    group = F.concat(F.lit("Customer "), F.substring("candidate", -1, 1))
    wide = pivots.pivoted(clean.withColumn("v", T.votes(F.col("votes"))).withColumn("group", group), "place", "group", F.sum("v"), [f"Customer {i}" for i in range(10)])
    return pivots.with_total_row(pivots.with_totals(wide, "place", {"Total Votes": [f"Customer {i}" for i in range(10)]}), "place")


_GROUPS = ", ".join(f"(sum(floor(abs(c_acctbal))::BIGINT) FILTER (WHERE c_custkey % 10 = {i}))::BIGINT AS \"Customer {i}\"" for i in range(10))
SQL_BUILT = f"""
SELECT c_mktsegment AS place, {_GROUPS}, sum(floor(abs(c_acctbal))::BIGINT)::BIGINT AS "Total Votes", sum(floor(abs(c_acctbal))::BIGINT)::BIGINT AS "Grand Total" FROM customer GROUP BY 1
UNION ALL SELECT 'TOTAL', {_GROUPS}, sum(floor(abs(c_acctbal))::BIGINT)::BIGINT, sum(floor(abs(c_acctbal))::BIGINT)::BIGINT FROM customer"""


def ambiguous_pivot(spark, sf_dir):
    """Orders of each customer read both ways; the fuller reading stays."""
    (orders,) = read(spark, sf_dir, "orders")
    cells = orders.select("o_custkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 3).alias("v"))
    one = cells.groupBy("o_custkey", F.col("o_orderstatus").alias("unit"), F.col("o_orderpriority").alias("column")).agg(F.sum("v").alias("value"))
    two = cells.where("o_orderpriority <> '5-LOW' or o_custkey % 2 = 0").groupBy("o_custkey", F.col("o_orderpriority").alias("unit"), F.concat("o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, F.col("v").cast("string")).otherwise("")).alias("column")).agg(F.sum("v").alias("value"))
    return X.fuller(one, two, "o_custkey")


SQL_AMBIGUOUS = """
WITH cells AS (SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderkey % 3 AS v FROM orders),
one AS (SELECT o_custkey, o_orderstatus AS unit, o_orderpriority AS column, sum(v)::BIGINT AS value, 'candidate-major' AS reading FROM cells GROUP BY ALL),
two AS (SELECT o_custkey, o_orderpriority AS unit, o_orderstatus || CASE WHEN o_custkey % 2 = 0 THEN v::VARCHAR ELSE '' END AS column, sum(v)::BIGINT AS value, 'precinct-major' AS reading
    FROM cells WHERE o_orderpriority <> '5-LOW' OR o_custkey % 2 = 0 GROUP BY ALL),
both_ AS (SELECT * FROM one UNION ALL SELECT * FROM two),
n AS (SELECT o_custkey, count(*) FILTER (WHERE value <> 0 AND reading = 'candidate-major') AS c, count(*) FILTER (WHERE value <> 0 AND reading = 'precinct-major') AS p FROM both_ GROUP BY 1)
SELECT b.* FROM both_ b JOIN n USING (o_custkey) WHERE reading = CASE WHEN c >= p THEN 'candidate-major' ELSE 'precinct-major' END"""


def card_tables(spark, sf_dir):
    """Elements of pages in order: a heading opens a precinct, the table below it is that precinct's and closes it; names give candidate and party."""
    (orders,) = read(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 4 == 0, "heading").when(F.col("o_orderkey") % 4 == 1, "table").otherwise("text")
    rows = orders.select(F.floor(F.col("o_orderkey") / 50).alias("page"), "o_orderkey", kind.alias("kind"), "o_custkey", "o_orderpriority", "o_totalprice")
    from pyspark.sql import Window

    own = Window.partitionBy("page").orderBy("o_orderkey")
    step = F.when(F.col("kind") == "heading", F.struct(F.concat(F.lit("Precinct "), F.col("o_custkey").cast("string")).alias("label"))).when(F.col("kind") == "table", F.struct(F.lit(None).cast("string").alias("label")))
    # after a table nothing is open, until the next heading
    rows = rows.withColumn("open", F.last(step, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))["label"])
    name = F.concat(F.col("o_custkey").cast("string"), F.lit(" "), F.regexp_replace("o_orderpriority", "^[0-9]-", ""), F.lit(" REP"))
    return rows.where("kind = 'table' and open is not null").select("page", "open", X.candidate_and_party(name).alias("candidate"), F.round("o_totalprice", 2).alias("votes"))


SQL_CARDS = """
WITH r AS (SELECT o_orderkey // 50 AS page, *, lag(o_orderkey % 4) OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) AS k1 FROM orders WHERE o_orderkey % 4 < 2),
p AS (SELECT *, lag(o_custkey) OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) AS before FROM r)
SELECT page, 'Precinct ' || before AS open, substr(o_orderpriority, 3) || ' (REP)' AS candidate, round(o_totalprice, 2) AS votes FROM p WHERE o_orderkey % 4 = 1 AND k1 = 0"""


def sibling_reports(spark, sf_dir):
    """What the marked span of a segment or its siblings reports: of each container of rows."""
    found = _found(spark, sf_dir)
    own = X.sibling_reports(found).join(found.where(F.array_contains("classes", "table-row")).select("page_id", "idx"), ["page_id", "idx"])
    return own.groupBy("page_id", "report").agg(F.count(F.lit(1)).alias("n"))


SQL_SIBLINGS = f"WITH {_BASE} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Fully Reported' ELSE '' END AS report, count(*) AS n FROM t GROUP BY ALL"


def reporting_text(spark, sf_dir):
    """The first marked span of each panel that tells what is reported, read from its markup."""
    made = made_pages(spark, sf_dir)
    found = pagestore.segments(made)
    cut = pages.subtree_html(found, made).join(found.where("tag = 'section'").select("page_id", "idx"), ["page_id", "idx"])
    return cut.select("page_id", F.regexp_extract("html", "<h3>Ward ([A-Z]+)", 1).alias("panel"), F.regexp_extract("html", '<span class="fw-bold">([^<]*Reported[^<]*)</span>', 1).alias("text"))


SQL_REPORTING = f"WITH {_BASE} SELECT page_id, seg AS panel, CASE WHEN page_id % 2 = 0 THEN 'Fully Reported' ELSE '' END AS text FROM t"


def grouped_labels(spark, sf_dir):
    """Orders of a customer by each of their labels: how many, and a digest of all in order."""
    ship_package(spark)
    (orders,) = read(spark, sf_dir, "orders")
    nodes = orders.select("o_orderkey", F.array_distinct(F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1), (F.col("o_custkey") % 40).cast("string"))).alias("labels"), F.col("o_custkey").cast("string").alias("value"))
    return X.label_digests(X.grouped_labels(nodes, "o_orderkey", "labels", "value"), "o_orderkey", "value").withColumn("n", F.col("n").cast("int"))


SQL_GROUPED = """
WITH l AS (SELECT o_orderkey, o_custkey, unnest(list_distinct([o_orderstatus, o_orderpriority[1], (o_custkey % 40)::VARCHAR])) AS label FROM orders)
SELECT label, md5(string_agg(o_custkey::VARCHAR, ',' ORDER BY o_orderkey)) AS digest, count(*)::INTEGER AS n FROM l GROUP BY label"""


def segment_texts(spark, sf_dir):
    found = _found(spark, sf_dir).where("tag in ('h3', 'th')")
    return found.select("page_id", X.segment_texts(found).alias("text"))


SQL_SEGMENT = f"WITH {_BASE} SELECT page_id, 'h3  ' || heading AS text FROM t UNION ALL SELECT page_id, 'th  Key' FROM t"


def selector_discovery(spark, sf_dir):
    return pages.selector_scores(_found(spark, sf_dir), ("candidate", "row", "vote"))


SQL_SELECTORS = f"""WITH {_BASE}
SELECT 'div.table-row' AS selector, count(*) AS n, sum(9)::BIGINT AS score FROM t HAVING count(*) > 0 UNION ALL SELECT 'div#r1', count(*), sum(9)::BIGINT FROM t HAVING count(*) > 0"""

QUERIES = {
    "repeated_rows": (repeated_rows, SQL_REPEATED),
    "dom_headers": (dom_headers, SQL_HEADERS),
    "dom_rows": (dom_rows, SQL_DOM_ROWS),
    "location_tables": (location_tables, SQL_LOCATION),
    "section_tables": (section_tables, SQL_SECTION),
    "table_candidates": (table_candidates, SQL_CANDIDATES),
    "detected_tables": (detected_tables, SQL_DETECTED),
    "built_table": (built_table, SQL_BUILT),
    "ambiguous_pivot": (ambiguous_pivot, SQL_AMBIGUOUS),
    "card_tables": (card_tables, SQL_CARDS),
    "sibling_reports": (sibling_reports, SQL_SIBLINGS),
    "reporting_text": (reporting_text, SQL_REPORTING),
    "grouped_labels": (grouped_labels, SQL_GROUPED),
    "segment_texts": (segment_texts, SQL_SEGMENT),
    "selector_discovery": (selector_discovery, SQL_SELECTORS),
}
