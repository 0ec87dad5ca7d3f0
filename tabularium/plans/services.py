"""Queries over the store of hints and over registered extractors."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tabularium.operators import hints, nested, plugins
from tabularium.session import new_path

from .results import read


def hint_store(spark, sf_dir):
    """Hints after a run of steps: two batches added, some removed, that undone, some edited, a third batch, rolled back to the edit, and what was exported imported elsewhere."""
    supplier, customer, part = read(spark, sf_dir, "supplier", "customer", "part")
    store = hints.HintStore(spark, new_path(spark, "hints"))
    store.upsert(supplier.select(F.concat(F.lit("nation-"), "s_nationkey").alias("fragment"), F.concat(F.lit("supplier "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("module")))
    store.upsert(customer.select(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("-"), F.col("c_nationkey") % 7).alias("fragment"), F.concat(F.lit("customer "), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("module")))
    store.remove(store.current().where("fragment like 'nation-1%'"))
    store.undo()
    store.edit(part.select(F.concat(F.lit("nation-"), F.col("p_size")).alias("fragment"), F.concat(F.lit("part "), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("module")))
    store.upsert(part.select(F.col("p_name").alias("fragment"), F.col("p_type").alias("module")))
    store.rollback(2)
    out = new_path(spark, "export")
    store.export_csv(out)
    copy = hints.HintStore(spark, new_path(spark, "hints"))
    copy.import_csv(out)
    return copy.current().withColumn("versions", F.lit(store.history().count()))


SQL_HINTS = """
WITH one AS (SELECT 'nation-' || s_nationkey AS fragment, 'supplier ' || lpad(max(s_suppkey)::VARCHAR, 9, '0') AS module FROM supplier GROUP BY 1),
two AS (SELECT lower(c_mktsegment) || '-' || c_nationkey % 7 AS fragment, 'customer ' || lpad(max(c_custkey)::VARCHAR, 9, '0') AS module FROM customer GROUP BY 1),
new AS (SELECT 'nation-' || p_size AS fragment, 'part ' || lpad(max(p_partkey)::VARCHAR, 9, '0') AS module FROM part GROUP BY 1)
SELECT fragment, coalesce(new.module, o.module) AS module, 3::BIGINT AS versions FROM (SELECT * FROM one UNION ALL SELECT * FROM two) o LEFT JOIN new USING (fragment)"""


@plugins.extractor("links")
def _links(html, *columns):
    for link, text in re.findall(r'<a href="([^"]*)">([^<]*)</a>', html):
        yield {"link": link, "text": text}


@plugins.extractor("first_heading")
def _first_heading(html, *columns):
    found = re.search(r"<h1>([^<]*)</h1>", html)
    if len(html) % 5 == 0:
        raise ValueError("a length that this one refuses")
    yield {"text": found[1], "size": len(html)}


def plugin_rows(spark, sf_dir):
    """Rows of two extractors over the given pages, one of which fails on some pages."""
    (pages,) = read(spark, sf_dir, "pages")
    return plugins.extracted(spark, pages, {"links": ["link", "text"], "first_heading": ["text", "size"]})


SQL_PLUGINS = r"""
SELECT 'links' AS plugin, page_id, (unnest(range(len(l))))::INTEGER AS row_no, unnest(l) AS link, unnest(t) AS text, NULL AS size, NULL AS error
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS l, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)
UNION ALL
SELECT 'first_heading', page_id, CASE WHEN length(html) % 5 <> 0 THEN 0 END::INTEGER, NULL, CASE WHEN length(html) % 5 <> 0 THEN regexp_extract(html, '<h1>([^<]*)</h1>', 1) END,
    CASE WHEN length(html) % 5 <> 0 THEN length(html)::VARCHAR END, CASE WHEN length(html) % 5 = 0 THEN 'ValueError: a length that this one refuses' END FROM pages"""


_PATHS = {"state": "$.place.state", "county": "$.place.county.name", "code": "$.place.county.code", "votes": "$.votes", "mail": "$.ballots.mail", "early": "$.ballots.early", "kind": "$.kind"}


def deep_merges(spark, sf_dir):
    """Libraries of customers as nested values, with what was learnt later merged into them: single fields of the result."""
    (customer,) = read(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    old = F.concat(F.lit('{"place":{"state":"'), "c_mktsegment", F.lit('","county":{"name":"c'), "c_nationkey", F.lit('","code":'), k, F.lit('}},"votes":[1,2,'), k, F.lit('],"ballots":{"mail":'), k, F.lit('}}'))
    new = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('{"place":{"county":{"code":-'), k, F.lit('}},"kind":"new"}'))).when(F.col("c_custkey") % 4 == 1, F.lit('{"place":"none","votes":[7]}'))
    new = new.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit('{"ballots":{"early":'), k, F.lit('},"place":{"county":"gone"}}'))).otherwise(F.lit("{}"))
    found = nested.deep_merged(customer.select("c_custkey", old.alias("old"), new.alias("new")), "c_custkey", "old", "new")
    return found.select("c_custkey", *[F.get_json_object("merged", path).alias(name) for name, path in _PATHS.items()])


_FIELDS = ", ".join(f"json_extract_string(m, '{path}') AS {name}" for name, path in _PATHS.items())
SQL_DEEP = f"""
WITH r AS (
    SELECT c_custkey, json_merge_patch(('{{"place":{{"state":"' || c_mktsegment || '","county":{{"name":"c' || c_nationkey || '","code":' || c_custkey || '}}}},"votes":[1,2,' || c_custkey || '],"ballots":{{"mail":' || c_custkey || '}}}}')::JSON,
        (CASE c_custkey % 4 WHEN 0 THEN '{{"place":{{"county":{{"code":-' || c_custkey || '}}}},"kind":"new"}}' WHEN 1 THEN '{{"place":"none","votes":[7]}}'
            WHEN 2 THEN '{{"ballots":{{"early":' || c_custkey || '}},"place":{{"county":"gone"}}}}' ELSE '{{}}' END)::JSON) AS m FROM customer)
SELECT c_custkey, {_FIELDS} FROM r"""


QUERIES = {
    "deep_merges": (deep_merges, SQL_DEEP),
    "hint_store": (hint_store, SQL_HINTS),
    "plugin_rows": (plugin_rows, SQL_PLUGINS),
}
