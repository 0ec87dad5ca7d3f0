"""Queries that build one result for each page: made pages of four kinds, and the given ones.

Made pages hold twenty customers each: a good table; a table without headers beside a
list; two tables without headers, which belong together; repeated rows, one of which is
the end of the row before.  The given pages hold lists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.operators import builder
from tabularium.session import ship_package
from tabularium.sources import pagestore

from .results import read

#: Added to the numbers of the given pages.
GIVEN = 1_000_000_000


def _pages(spark, sf_dir):
    customer, pages = read(spark, sf_dir, "customer", "pages")
    k, votes = F.col("c_custkey"), F.floor(F.abs("c_acctbal")).cast("string")
    name = F.element_at(F.array(F.lit("Ann Lee"), F.lit("Jo Poe"), F.lit("Mia Roe")), (k % 3).cast("int") + 1)
    td = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    span = lambda *cells: F.concat(F.lit("<p>"), *[F.concat(F.lit("<span>"), c, F.lit("</span>")) for c in cells], F.lit("</p>"))
    lines = {"good": td("c_mktsegment", name, votes), "bare": td("c_name", votes), "spans": span("c_mktsegment", name, votes)}
    own = F.array_sort(F.collect_list(F.struct(k, *[v.alias(n) for n, v in lines.items()])))
    made = customer.groupBy(F.floor(k / 20).alias("page_id")).agg(own.alias("rows"))
    said = lambda name, rows="rows": F.array_join(F.transform(rows, lambda x: x[name]), "")
    third = F.filter("rows", lambda x: x["c_custkey"] % 3 == 0), F.filter("rows", lambda x: x["c_custkey"] % 3 != 0)
    bare = lambda rows: F.concat(F.lit("<table><tr><th></th><th></th></tr>"), said("bare", rows), F.lit("</table>"))
    kinds = [
        F.concat(F.lit("<table><tr><th>Precinct</th><th>Candidate</th><th>Votes</th></tr>"), said("good"), F.lit("</table>")),
        F.concat(bare("rows"), F.lit("<ul><li>one item</li><li>two items</li><li>three</li></ul>")),
        F.concat(bare(third[0]), bare(third[1])),
        F.concat(F.lit('<div class="table-row">'), span(F.lit("Ward"), F.lit("Candidate"), F.lit("Votes")), F.get("rows", F.lit(0))["spans"], span(F.lit(""), F.lit("Green"), F.lit("")), said("spans", F.slice("rows", F.lit(2), F.size("rows"))), F.lit("</div>")),
    ]
    html = F.concat(F.lit("<html><body>"), F.element_at(F.array(*kinds), (F.col("page_id") % 4).cast("int") + 1), F.lit("</body></html>"))
    return made.select("page_id", html.alias("html")).union(pages.select(F.col("page_id") + GIVEN, "html"))


_built = {}


def _results(spark, sf_dir):
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        ship_package(spark)
        _built[key] = builder.built(pagestore.segments(_pages(spark, sf_dir)))
    return _built[key]


def built_cells(spark, sf_dir):
    return _results(spark, sf_dir)[0]


def built_facts(spark, sf_dir):
    return _results(spark, sf_dir)[1]


_ROWS = rf"""
c AS (
    SELECT c_custkey // 20 AS page_id, c_custkey AS k, c_mktsegment AS place, ['Ann Lee', 'Jo Poe', 'Mia Roe'][c_custkey % 3 + 1] AS name, c_name, floor(abs(c_acctbal))::BIGINT::VARCHAR AS votes,
        (c_custkey // 20) % 4 AS kind, row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) AS n FROM customer),
halves AS (SELECT page_id, count(*) FILTER (WHERE k % 3 = 0) AS a, count(*) FILTER (WHERE k % 3 <> 0) AS b FROM c GROUP BY 1),
-- pages with places and candidates: equal rows once, the second half of a name joined
full_ AS (SELECT page_id, kind, k, n, place, name || CASE WHEN kind = 3 AND n = 1 THEN ' (Green)' ELSE '' END AS name, name AS own, votes FROM c WHERE kind IN (0, 3)),
kept AS (SELECT * FROM full_ QUALIFY row_number() OVER (PARTITION BY page_id, place, own, votes ORDER BY n) = 1),
places AS (SELECT page_id, count(DISTINCT place) AS n_places FROM kept GROUP BY 1),
-- tables without headers: of two, the rows of both if the second one is longer
bare AS (
    SELECT page_id, kind, c_name, votes, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN kind = 2 THEN (k % 3 <> 0)::INT ELSE 0 END, k) - 1 AS row_no
    FROM c JOIN halves USING (page_id) WHERE kind = 1 OR kind = 2 AND (a = 0 OR b > a OR k % 3 = 0)),
items AS (
    SELECT page_id + {GIVEN} AS page_id, unnest(range(len(l))) AS row_no, unnest(l) AS item
    FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS l FROM pages) WHERE len(l) >= 2)"""
SQL_CELLS = f"""
WITH {_ROWS}
SELECT page_id, place AS unit, name || ' - Votes' AS "column", arg_min(votes, n) AS value FROM kept JOIN places USING (page_id) WHERE n_places > 1 GROUP BY ALL
UNION ALL SELECT page_id, (n - (kind = 0)::INT + (kind = 3 AND n > 1)::INT)::VARCHAR, unnest([CASE WHEN kind = 0 THEN 'Precinct' ELSE 'Ward' END, 'Candidate', 'Votes']), unnest([place, name, votes]) FROM kept JOIN places USING (page_id) WHERE n_places = 1
UNION ALL SELECT page_id, row_no::VARCHAR, unnest(['Column 1', 'Column 2']), unnest([c_name, votes]) FROM bare
UNION ALL SELECT page_id, row_no::VARCHAR, 'Item', item FROM items"""
SQL_FACTS = rf"""
WITH {_ROWS}
SELECT page_id, CASE WHEN kind = 0 THEN 'markup' ELSE 'repeated' END AS source, 1.0::DOUBLE AS score, 0::INTEGER AS rounds, 'precinct-major' AS structure, count(*) AS n_rows, count(DISTINCT own) AS people, count(DISTINCT votes) AS numbers
FROM kept GROUP BY page_id, kind
UNION ALL SELECT page_id, CASE WHEN kind = 2 AND a > 0 AND b > a THEN 'patched' ELSE 'markup' END, 1.0, (kind = 2 AND a > 0 AND b > a)::INTEGER, 'ambiguous', count(*), 0, count(DISTINCT votes) FROM bare JOIN halves USING (page_id) GROUP BY page_id, kind, a, b
UNION ALL SELECT page_id, 'list', 1.0, 0, 'ambiguous', count(*), count(DISTINCT item) FILTER (WHERE regexp_matches(item, '\b[A-Z][a-z]+ [A-Z][a-z]+\b')), count(DISTINCT item) FILTER (WHERE regexp_matches(item, '^[\d,.]*\d[\d,.]*$')) FROM items GROUP BY page_id"""


QUERIES = {
    "built_cells": (built_cells, SQL_CELLS),
    "built_facts": (built_facts, SQL_FACTS),
}
