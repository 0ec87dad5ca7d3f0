"""Queries over lookups: routes through dimensions, contained and fuzzy matches, anti-joins, ranked choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions import text as T
from tabularium.operators import lookup, similar, store

from .cascades import RATIO
from .results import read


def district_county_state(spark, sf_dir):
    """Suppliers and customers routed up to their region, counted."""
    supplier, customer, nation, region = read(spark, sf_dir, "supplier", "customer", "nation", "region")
    units = supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("n_nationkey")).union(customer.select(F.lit("customer"), "c_nationkey"))
    sums = units.groupBy("kind", "n_nationkey").agg(F.count(F.lit(1)).alias("n"))
    routed = lookup.routed(sums, (nation.withColumnRenamed("n_regionkey", "r_regionkey"), "n_nationkey"), (region, "r_regionkey"))
    return routed.groupBy("kind", "n_name", "r_name").agg(F.sum("n").alias("n"))


SQL_ROUTE = """
WITH u AS (SELECT 'supplier' AS kind, s_nationkey AS k FROM supplier UNION ALL SELECT 'customer', c_nationkey FROM customer)
SELECT kind, n_name, r_name, count(*) AS n FROM u LEFT JOIN nation ON k = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""


def _words(benchmark):
    return benchmark.select(F.lower(F.get(F.split("text", " "), 0)).alias("word")).where("word rlike '^[a-z]+$'").distinct()


_SQL_WORDS = "words AS (SELECT DISTINCT lower(string_split(text, ' ')[1]) AS word FROM benchmark WHERE regexp_matches(lower(string_split(text, ' ')[1]), '^[a-z]+$'))"


def theta_contains_match(spark, sf_dir):
    """Documents per word of a list that their texts contain."""
    documents, benchmark = read(spark, sf_dir, "documents", "benchmark")
    found = lookup.contained(documents, "doc_id", "text", _words(benchmark), "word")
    return found.groupBy("word").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


SQL_CONTAINS = rf"""
WITH {_SQL_WORDS},
own AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS word FROM documents)
SELECT word, count(*) AS n_docs, min(doc_id) AS first_doc FROM own JOIN words USING (word) GROUP BY word"""


def unmatched_bucket(spark, sf_dir):
    """Documents with none of the words."""
    documents, benchmark = read(spark, sf_dir, "documents", "benchmark")
    return lookup.unmatched(documents.select("doc_id", "source"), lookup.contained(documents, "doc_id", "text", _words(benchmark), "word"), "doc_id")


SQL_UNMATCHED = rf"""
WITH {_SQL_WORDS},
own AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS word FROM documents)
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM own JOIN words USING (word))"""


def cache_anti_join(spark, sf_dir):
    """Customers whose title is not in the cache of those with open orders."""
    customer, orders = read(spark, sf_dir, "customer", "orders")
    cached = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.unmatched(customer.select("c_custkey", F.lower("c_name").alias("title")), cached, "c_custkey")


SQL_CACHE = "SELECT c_custkey, lower(c_name) AS title FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')"


def existing_outputs(spark, sf_dir):
    """Wanted results that are in the output cache already."""
    customer, supplier = read(spark, sf_dir, "customer", "supplier")
    wanted = customer.select("c_custkey", F.col("c_nationkey").alias("state"), F.floor(F.col("c_acctbal") / 100).alias("year"))
    cache = supplier.select(F.col("s_nationkey").alias("state"), F.floor(F.col("s_acctbal") / 100).alias("year"))
    return store.existing_outputs(wanted, cache, ["state", "year"])


SQL_EXISTING = """
SELECT c_custkey, c_nationkey AS state, floor(c_acctbal / 100)::BIGINT AS year FROM customer
WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND floor(s_acctbal / 100) = floor(c_acctbal / 100))"""


def contest_filter(spark, sf_dir):
    """Equality on every key, whatever the case."""
    (orders,) = read(spark, sf_dir, "orders")
    return lookup.filtered(orders, {"o_orderstatus": "f", "o_orderpriority": " 1-urgent "}).select("o_orderkey", "o_custkey", "o_totalprice")


SQL_FILTER = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"


def contest_select(spark, sf_dir):
    """By place, year and clean title; one per (year, type, title), the least key."""
    orders, customer, nation = read(spark, sf_dir, "orders", "customer", "nation")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("type"), F.concat("c_mktsegment", F.lit(" "), "o_orderpriority").alias("title"), "n_name", "o_orderkey")
    chosen = lookup.filtered(rows, {"n_name": "nation_3"}).where(~F.regexp_like("title", F.lit("(?i)not specified")))
    return chosen.groupBy("year", "type", "title").agg(F.min("o_orderkey").alias("o_orderkey"))


SQL_SELECT = """
SELECT year(o_orderdate)::INTEGER AS year, o_orderstatus AS type, c_mktsegment || ' ' || o_orderpriority AS title, min(o_orderkey) AS o_orderkey
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_name = 'NATION_3' AND o_orderpriority NOT LIKE '%NOT SPECIFIED%' GROUP BY ALL"""


def contest_verify_score(spark, sf_dir):
    """.4 for a year, .2 for a type, .2 for a keyword, .2 times the model's score; those at .85 and more are verified."""
    (orders,) = read(spark, sf_dir, "orders")
    title = F.concat_ws(" ", F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy")), "o_orderpriority")
    parts = [(0.4, T.year(title).isNotNull()), (0.2, F.col("o_orderstatus") != "P"), (0.2, T.any_word(title, ("urgent", "high"))), (0.2, F.col("o_orderkey") % 10 / 10)]
    rows = lookup.scored(orders, parts)
    return rows.select("o_orderkey", "score", (F.col("score") >= 0.85).alias("verified"))


SQL_VERIFY = """
WITH s AS (SELECT o_orderkey, round(0.4 * (o_orderkey % 3 <> 0)::INT + 0.2 * (o_orderstatus <> 'P')::INT + 0.2 * (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT + 0.2 * (o_orderkey % 10) / 10, 6)::DOUBLE AS score FROM orders)
SELECT o_orderkey, score, score >= 0.85 AS verified FROM s"""


def fuzzy_lookup_top1(spark, sf_dir):
    """Misspelt names of parts with the known name that is closest."""
    (part,) = read(spark, sf_dir, "part")
    wrong = part.select(F.translate(F.concat("p_name", (F.col("p_partkey") % 9).cast("string")), "aeo", "4e0").alias("name"))
    return similar.closest(wrong, "name", part.select(F.col("p_name").alias("known")), "known", 0.6)


SQL_LOOKUP = f"""
WITH RECURSIVE
wrong AS (SELECT DISTINCT translate(p_name || p_partkey % 9, 'aeo', '4e0') AS name FROM part),
pairs AS (SELECT p_name AS a, name AS b FROM (SELECT DISTINCT p_name FROM part), wrong),
{RATIO}
SELECT b AS name, max({{'score': score, 'a': a}}).a AS known, max(score) AS score FROM ratios WHERE score >= 0.6 GROUP BY b"""


def best_per_unit(spark, sf_dir):
    """The candidate with the greatest score of each unit: score, then type, then key."""
    supplier, nation = read(spark, sf_dir, "supplier", "nation")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_acctbal")
    return lookup.best_per_key(rows, ["n_name"], F.desc("s_acctbal"), F.col("s_suppkey"))


SQL_BEST = "SELECT n_name, s_suppkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) = 1"


def merge_and_rank(spark, sf_dir):
    """Candidates of two sources, repeated (label, selector) dropped, the best of each type by weighted score."""
    part, line = read(spark, sf_dir, "part", "lineitem")
    sold = line.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    one = part.select(F.col("p_name").alias("label"), F.col("p_type").alias("selector"), (F.col("p_size") / 50).alias("semantic"), F.lit(0).cast("bigint").alias("n"))
    two = part.join(sold, F.col("p_partkey") == F.col("l_partkey")).select("p_name", "p_type", (F.col("p_size") / 50), "n")
    merged = one.union(two).groupBy("label", "selector").agg(F.max("semantic").alias("semantic"), F.max("n").alias("n"))
    ranked = lookup.scored(merged, [(0.7, F.col("semantic")), (0.3, F.least(F.col("n") / 100, F.lit(1.0)))])
    return lookup.best_per_key(ranked, ["selector"], F.desc("score"), F.col("label")).select("selector", "label", "score")


SQL_RANK = """
WITH sold AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT p_name AS label, p_type AS selector, p_size / 50 AS semantic, coalesce(n, 0) AS n FROM part LEFT JOIN sold ON p_partkey = l_partkey),
m AS (SELECT label, selector, max(semantic) AS semantic, max(n) AS n FROM c GROUP BY ALL),
s AS (SELECT selector, label, round(0.7 * semantic + 0.3 * least(n / 100, 1.0), 6)::DOUBLE AS score FROM m)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY selector ORDER BY score DESC, label) = 1"""


def output_paths(spark, sf_dir):
    """Where each result goes: levels as folders, Unknown where one is missing."""
    customer, nation = read(spark, sf_dir, "customer", "nation")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_name").alias("state"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("county"), (F.col("c_custkey") % 3 + 2020).alias("year"), F.lit("general").alias("kind"), F.concat("c_mktsegment", F.lit("?")).alias("race"))
    return store.with_path(rows).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


SQL_PATHS = """
SELECT n_name || '/' || CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE 'Unknown' END || '/' || (c_custkey % 3 + 2020) || '/general/' || c_mktsegment || '_' AS path, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""

QUERIES = {
    "district_county_state": (district_county_state, SQL_ROUTE),
    "theta_contains_match": (theta_contains_match, SQL_CONTAINS),
    "unmatched_bucket": (unmatched_bucket, SQL_UNMATCHED),
    "cache_anti_join": (cache_anti_join, SQL_CACHE),
    "existing_outputs": (existing_outputs, SQL_EXISTING),
    "contest_filter": (contest_filter, SQL_FILTER),
    "contest_select": (contest_select, SQL_SELECT),
    "contest_verify_score": (contest_verify_score, SQL_VERIFY),
    "fuzzy_lookup_top1": (fuzzy_lookup_top1, SQL_LOOKUP),
    "best_per_unit": (best_per_unit, SQL_BEST),
    "merge_and_rank": (merge_and_rank, SQL_RANK),
    "output_paths": (output_paths, SQL_PATHS),
}
