"""Queries over pages with a table for each precinct."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.operators import precincts as R
from tabularium.session import ship_package
from tabularium.sources import pagestore

from .results import read

#: Markup before a table, by kind: labels by word and digit, a plain heading, two labels, none.
_KINDS = ("<h3>Ward {}</h3>", "<p><span>Ward 0</span></p><span>{} 12</span>", "<h3>{}</h3>", "<h3>{} Town</h3><span>no label</span>", "")


def precinct_tables(spark, sf_dir):
    """Pages of customers, a table for each segment: candidates, methods and votes of each precinct, with what a precinct lacks."""
    ship_package(spark)
    (customer,) = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tag = lambda name, *x: F.concat(F.lit(f"<{name}>"), *x, F.lit(f"</{name}>"))
    votes = F.floor(F.abs("c_acctbal")).cast("string")
    name = F.concat((k % 9).cast("string"), F.lit(" Ann "), (k % 4).cast("string"), F.lit("\n REP"))
    row = F.when(k % 7 == 0, tag("tr", tag("td", name), tag("td", votes))).otherwise(tag("tr", tag("td", F.when(k % 5 == 0, "Write-in").otherwise(name)), tag("td", (k % 3).cast("string")), tag("td", votes)))
    rows = customer.groupBy(F.floor(k / 60).alias("page_id"), F.col("c_mktsegment").alias("seg")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("row")))), lambda r: r["row"]), "").alias("rows"), F.min(k).alias("least"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), ((F.col("least") + F.length("seg")) % len(_KINDS)).cast("int") + 1)
    heads = tag("tr", F.lit("<th>Candidate</th><th>Mail</th><th>Total</th>"))
    table = tag("table", F.when(F.col("least") % 6 == 0, heads).otherwise(tag("thead", heads)), tag("tbody", "rows"))
    block = F.struct("seg", F.concat(F.replace(kind, F.lit("{}"), F.col("seg")), table).alias("html"))
    report = F.when(F.col("page_id") % 2 == 0, F.lit('<span class="fw-bold x ng-star-inserted">Fully Reported</span>')).otherwise("")
    made = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["html"]), "").alias("html")).select("page_id", F.concat(F.lit("<main>"), "html", report, F.lit("</main>")).alias("html"))
    return R.with_missing(R.precinct_cells(pagestore.segments(made))).drop("table_idx")


SQL_PRECINCTS = rf"""
WITH c AS (
    SELECT c_custkey AS k, c_custkey // 60 AS page_id, c_mktsegment AS seg, floor(abs(c_acctbal))::BIGINT::VARCHAR AS votes, (c_custkey % 3)::VARCHAR AS mail,
        CASE WHEN c_custkey % 5 = 0 THEN 'Write-in' ELSE 'Ann ' || c_custkey % 4 || ' (REP)' END AS candidate FROM customer),
t AS (SELECT page_id, seg, min(k) AS least, (min(k) + length(seg)) % 5 AS kind, min(k) % 6 > 0 AS good FROM c GROUP BY page_id, seg),
-- what stands before a table last, and whether it is a label; a table that is one leaves nothing open
events AS (
    SELECT page_id, seg, 0 AS place, CASE kind WHEN 0 THEN 'Ward ' || seg WHEN 1 THEN seg || ' 12' ELSE seg || ' Town' END AS label FROM t WHERE kind IN (0, 1, 3)
    UNION ALL SELECT page_id, seg, 1, NULL FROM t WHERE good),
opened AS (SELECT page_id, seg, lag(label) OVER (PARTITION BY page_id ORDER BY seg, place) AS precinct, place FROM events),
p AS (SELECT page_id, seg, precinct FROM opened WHERE place = 1 AND precinct IS NOT NULL),
cells AS (
    SELECT page_id, seg, precinct, candidate, unnest(['Mail', 'Total Votes']) AS method, unnest([mail, votes]) AS votes
    FROM (SELECT page_id, seg, precinct, candidate, arg_max(mail, k) AS mail, arg_max(votes, k) AS votes FROM c JOIN p USING (page_id, seg) WHERE k % 7 > 0 GROUP BY ALL)),
seen AS (SELECT page_id, candidate, min(seg) AS since FROM cells GROUP BY ALL),
every AS (SELECT DISTINCT c.page_id, c.seg, c.precinct, c.method, s.candidate FROM cells c JOIN seen s ON s.page_id = c.page_id AND s.since <= c.seg)
SELECT page_id, precinct, CASE WHEN page_id % 2 = 0 THEN 'Fully Reported' ELSE '' END AS report, candidate, method, coalesce(votes, '-') AS votes FROM every LEFT JOIN cells USING (page_id, seg, precinct, method, candidate)"""


QUERIES = {"precinct_tables": (precinct_tables, SQL_PRECINCTS)}
