"""Queries over result tables: cleaning, merging, pivots and totals.

Stand-ins for the domain's tables: nation for the unit of report, part type for
the candidate, return flag for the ballot type, quantities for votes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions import text as T
from tabularium.operators import pivots, tables

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
FLAGS = ("A", "N", "R")


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, candidate, party, ballot, votes_raw: lines summed before the small tables are joined, counts written as text."""
    line, supplier, nation, part = read(spark, sf_dir, "lineitem", "supplier", "nation", "part")
    sums = line.groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    rows = sums.join(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy(F.col("n_name").alias("unit"), F.col("p_type").alias("candidate"), F.col("l_returnflag").alias("ballot")).agg(F.sum("q").alias("q"))
    return rows.select("unit", "candidate", F.lit("Other").alias("party"), "ballot", F.format_number("q", 0).alias("votes_raw"))


_VOTES = """
votes AS (
    SELECT n_name AS unit, p_type AS candidate, l_returnflag AS ballot, sum(l_quantity::BIGINT)::BIGINT AS v
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
    GROUP BY ALL)"""

_KEYS = [f"{t} (Other) - {f}" for t in TYPES for f in FLAGS]
_CELL = {f"{t} (Other) - {f}": f"sum(v) FILTER (WHERE candidate = '{t}' AND ballot = '{f}')" for t in TYPES for f in FLAGS}


def wide_pivot_totals(spark, sf_dir):
    return pivots.wide_results(votes(spark, sf_dir), "unit", _KEYS)


_WIDE = ", ".join(f'({x})::BIGINT AS "{k}"' for k, x in _CELL.items())
_WIDE += ", " + ", ".join(f"coalesce(sum(v) FILTER (WHERE candidate = '{t}'), 0)::BIGINT AS \"{t} (Other) - Total Votes\"" for t in TYPES)
SQL_WIDE = f"""WITH {_VOTES}
SELECT unit, {_WIDE}, sum(v)::BIGINT AS "Grand Total" FROM votes GROUP BY unit
UNION ALL SELECT 'TOTAL' AS unit, {_WIDE}, sum(v)::BIGINT AS "Grand Total" FROM votes"""


def candidate_major(spark, sf_dir):
    wide = pivots.pivoted(votes(spark, sf_dir).withColumn("v", T.votes(F.col("votes_raw"))), "candidate", "ballot", F.sum("v"), FLAGS)
    return pivots.with_totals(wide, "candidate", {"ballots_total": list(FLAGS)})


SQL_CANDIDATE = f"""WITH {_VOTES}
SELECT candidate, {", ".join(f"(sum(v) FILTER (WHERE ballot = '{f}'))::BIGINT AS {f}" for f in FLAGS)},
    sum(v)::BIGINT AS ballots_total, sum(v)::BIGINT AS "Grand Total" FROM votes GROUP BY candidate"""


def _cells(spark, sf_dir):
    """Line items as cells with an ordinal: some values blank."""
    line, supplier, nation = read(spark, sf_dir, "lineitem", "supplier", "nation")
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("n_name").alias("unit"),
        F.concat("l_returnflag", F.lit(" - "), "l_linestatus").alias("key"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("value"),
        (F.col("l_orderkey") * 1_000_000_000 + F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_quantity").cast("bigint")).alias("ord"),
    )


_SQL_CELLS = """
cells AS (
    SELECT n_name AS unit, l_returnflag || ' - ' || l_linestatus AS key,
        CASE WHEN l_linenumber = 1 THEN '' ELSE l_quantity::BIGINT::VARCHAR END AS value,
        l_orderkey * 1000000000 + l_linenumber::BIGINT * 100000000 + l_partkey * 1000 + l_quantity::BIGINT AS ord
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
_CELL_KEYS = ("A - F", "N - F", "N - O", "R - F")


def candidate_party_cells(spark, sf_dir):
    """A row for each candidate and place, some without a place: cells by candidate, party and ballot type, with totals."""
    line, supplier, nation = read(spark, sf_dir, "lineitem", "supplier", "nation")
    who = F.element_at(F.array(F.lit("Ann Lee\nGreen Party"), F.lit("Jo Poe"), F.lit("Mia Roe \n Old Harbor Committee")), F.pmod("l_partkey", F.lit(3)).cast("int") + 1)
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.groupBy(F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")).alias("place"), who.alias("who")).agg(*[F.format_number(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity").cast("bigint"))), 0).alias(f) for f in FLAGS], F.min("l_orderkey").alias("ord"))
    return pivots.candidate_cells(rows, "who", "place", FLAGS, "ord")


SQL_PARTY_CELLS = f"""
WITH r AS (
    SELECT CASE WHEN n_nationkey % 5 > 0 THEN n_name ELSE 'All' END AS location, ['Ann Lee (Green Party)', 'Jo Poe (Other)', 'Mia Roe (Old Harbor Committee)'][l_partkey % 3 + 1] AS label, l_returnflag AS ballot, l_quantity::BIGINT AS q
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT location, label || ' - ' || ballot AS "column", sum(q)::BIGINT AS value FROM r GROUP BY ALL
UNION ALL SELECT location, label || ' - Total', sum(q)::BIGINT FROM r GROUP BY ALL
UNION ALL SELECT location, 'Grand Total', sum(q)::BIGINT FROM r GROUP BY ALL"""


def wide_first_wins(spark, sf_dir):
    return pivots.first_wins(_cells(spark, sf_dir), "unit", "key", "value", "ord", _CELL_KEYS)


def wide_last_wins(spark, sf_dir):
    return pivots.last_wins(_cells(spark, sf_dir), "unit", "key", "value", "ord", _CELL_KEYS)


def _wins(f):
    cols = ", ".join(f"{f}(value, ord) FILTER (WHERE key = '{k}' AND value <> '') AS \"{k}\"" for k in _CELL_KEYS)
    return f"WITH {_SQL_CELLS} SELECT unit, {cols} FROM cells WHERE value <> '' GROUP BY unit"


def precinct_major_from_headers(spark, sf_dir):
    """The wide table read back: headers parsed, one row per unit, candidate and ballot."""
    wide = pivots.pivoted(votes(spark, sf_dir).withColumn("v", T.votes(F.col("votes_raw"))).withColumn("key", pivots.column_key(F.col("candidate"), F.col("party"), F.col("ballot"))), "unit", "key", F.sum("v"), _KEYS)
    cells = pivots.parsed_headers(tables.melted(wide, ["unit"])).where("candidate is not null and value is not null")
    return cells.select("unit", "candidate", "party", "ballot", T.votes(F.col("value")).alias("votes"))


SQL_PRECINCT = f"WITH {_VOTES} SELECT unit, candidate, 'Other' AS party, ballot, v AS votes FROM votes"


def grand_total_row(spark, sf_dir):
    (nation, customer) = read(spark, sf_dir, "nation", "customer")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("unit"))
    table = rows.agg(F.count(F.lit(1)).cast("string").alias("people"), F.max("c_mktsegment").alias("segment"), F.format_number(F.sum(F.col("c_custkey")), 0).alias("keys"))
    return pivots.grand_total_row(table, "unit")


SQL_GRAND = """
WITH rows AS (SELECT n_name AS unit, count(*) AS people, max(c_mktsegment) AS segment, sum(c_custkey)::BIGINT AS keys
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT unit, people::VARCHAR AS people, segment, format('{:,}', keys) AS keys FROM rows
UNION ALL SELECT 'Grand Total', sum(people)::BIGINT::VARCHAR, '', sum(keys)::BIGINT::VARCHAR FROM rows"""


def ballot_type_order(spark, sf_dir):
    """Order priorities named as ballot types, in the customary order."""
    (orders,) = read(spark, sf_dir, "orders")
    name = F.element_at(F.array(*map(F.lit, ("Mail", "Election Day", "Void", "Absentee", "Affidavit"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return orders.groupBy(name.alias("ballot")).agg(F.count(F.lit(1)).alias("n")).withColumn("place", pivots.ballot_rank(F.col("ballot")).cast("int")).orderBy("place", "ballot")


SQL_BALLOT = """
SELECT ['Mail', 'Election Day', 'Void', 'Absentee', 'Affidavit'][substr(o_orderpriority, 1, 1)::INT] AS ballot, count(*) AS n,
    CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 1 WHEN '4' THEN 3 WHEN '1' THEN 4 ELSE 6 END AS place
FROM orders GROUP BY ALL"""


def json_nested_to_wide(spark, sf_dir):
    """Order lines nested as results JSON, read back and pivoted by method with a total."""
    line, orders = read(spark, sf_dir, "lineitem", "orders")
    methods = F.when(F.col("l_returnflag") == "A", "Mail-In").when(F.col("l_returnflag") == "N", "Election Day").otherwise("Early Voting")
    groups = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus", "o_orderpriority", "l_linestatus", methods.alias("m")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("v"))
    precincts = groups.groupBy("o_orderstatus", "o_orderpriority", "l_linestatus").agg(F.sum("v").alias("all"), F.collect_list(F.struct(F.col("m").alias("groupName"), F.col("v").alias("voteCount"))).alias("groupResults"))
    options = precincts.groupBy("o_orderstatus", "o_orderpriority").agg(F.collect_list(F.struct(F.col("l_linestatus").alias("name"), F.col("all").alias("voteCount"), "groupResults")).alias("precinctResults"))
    items = options.groupBy("o_orderstatus").agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("name"), F.lit("Other").alias("politicalParty"), "precinctResults")).alias("ballotOptions"))
    nested = items.select(F.to_json(F.struct(F.struct(F.array(F.struct(F.col("o_orderstatus").alias("name"), "ballotOptions")).alias("ballotItems")).alias("results"))).alias("doc"))
    long = pivots.nested_results(nested, "doc")
    wide = long.groupBy("contest", "candidate", "precinct").pivot("method", ["Absentee Mail", "Early Voting", "Election Day"]).agg(F.max("votes"))
    return wide.join(long.groupBy("contest", "candidate", "precinct").agg(F.max("all_votes").alias("Total")), ["contest", "candidate", "precinct"])


SQL_JSON = """
SELECT o_orderstatus AS contest, o_orderpriority AS candidate, l_linestatus AS precinct,
    (sum(l_quantity::BIGINT) FILTER (WHERE l_returnflag = 'A'))::BIGINT AS "Absentee Mail",
    (sum(l_quantity::BIGINT) FILTER (WHERE l_returnflag = 'R'))::BIGINT AS "Early Voting",
    (sum(l_quantity::BIGINT) FILTER (WHERE l_returnflag = 'N'))::BIGINT AS "Election Day", sum(l_quantity::BIGINT)::BIGINT AS "Total"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""


def harmonize_dedupe(spark, sf_dir):
    (customer,) = read(spark, sf_dir, "customer")
    table = customer.select(
        F.col("c_custkey").alias("ord"),
        F.when(F.col("c_custkey") % 11 == 0, None).otherwise(F.col("c_nationkey").cast("string")).alias("location"),
        F.col("c_mktsegment").alias("candidate"),
        F.floor(F.col("c_acctbal") / 5000).cast("string").alias("mail"),
        F.lit("0").alias("void"),
    )
    return tables.harmonise(table, "location", "candidate", ["mail", "void"], "ord")


SQL_HARMONIZE = """
WITH rows AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_nationkey::VARCHAR END AS location,
    c_mktsegment AS candidate, floor(c_acctbal / 5000)::BIGINT::VARCHAR AS mail FROM customer)
SELECT ord, location, candidate, mail FROM rows
QUALIFY location IN ('', '0') OR row_number() OVER (PARTITION BY location, candidate, mail ORDER BY ord) = 1"""


def header_dedupe(spark, sf_dir):
    """The first spelling of each normalised header."""
    (part,) = read(spark, sf_dir, "part")
    words = part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "word"))
    headers = words.select(F.when(F.col("p_partkey") % 3 == 0, F.upper("word")).otherwise(F.initcap("word")).alias("header"), (F.col("p_partkey") * 10 + F.col("at")).alias("ord"))
    return tables.first_rows(headers.withColumn("normal", T.collapse(F.col("header"))), ["normal"], "ord")


SQL_HEADER = """
WITH words AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part),
headers AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(word) ELSE upper(word[1]) || lower(word[2:]) END AS header, p_partkey * 10 + pos AS ord FROM words)
SELECT arg_min(header, ord) AS header, min(ord) AS ord, lower(header) AS normal FROM headers GROUP BY lower(header)"""


def schema_union_fill(spark, sf_dir):
    customer, supplier = read(spark, sf_dir, "customer", "supplier")
    one = customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    two = supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    return tables.union_filled(one, two)


SQL_UNION = "SELECT c_name AS name, c_mktsegment AS segment, '' AS nation FROM customer UNION ALL SELECT s_name, '', s_nationkey::VARCHAR FROM supplier"


def low_signal_columns(spark, sf_dir):
    """Names of the columns that stay."""
    (line,) = read(spark, sf_dir, "lineitem")
    table = line.select("*", F.lit("x").alias("constant"), F.when(F.col("l_orderkey") % 1000 == 0, F.col("l_returnflag")).otherwise("").alias("sparse"))
    return spark.createDataFrame([(c,) for c in tables.informative_columns(table)], "header string")


SQL_SIGNAL = """
SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']) AS header"""


def empty_row_filter(spark, sf_dir):
    (customer,) = read(spark, sf_dir, "customer")
    keep = F.col("c_custkey") % 4 != 0
    return tables.drop_empty_rows(customer.select(F.when(keep, F.col("c_name")).otherwise("  ").alias("name"), F.when(keep | (F.col("c_custkey") % 8 == 0), F.col("c_mktsegment")).alias("segment")))


SQL_EMPTY = """
SELECT CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE '  ' END AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 8 = 0"""


def footer_filter(spark, sf_dir):
    (part,) = read(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("TOTAL "), F.col("p_type"))).when(F.col("p_size") % 10 == 5, F.lit("Write-In")).otherwise(F.col("p_type"))
    return tables.drop_footers(part.select("p_partkey", name.alias("candidate"), "p_brand"), ["candidate"])


SQL_FOOTER = "SELECT p_partkey, p_type AS candidate, p_brand FROM part WHERE p_size % 10 NOT IN (0, 5) AND NOT regexp_matches(lower(p_type), 'total|sum|votes|overall|all|undervote|overvote|scattering|write-in|blank|void|spoiled')"


def merge_coalesce_keyed(spark, sf_dir):
    customer, supplier = read(spark, sf_dir, "customer", "supplier")
    left = customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), "c_mktsegment")
    right = supplier.select((F.col("s_suppkey") * 3).alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return tables.merge_keyed(left, right, ["k"])


SQL_MERGE = """
SELECT coalesce(c_custkey, s_suppkey * 3) AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE s_name END AS name, s_nationkey AS nation, c_mktsegment
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3"""


def patch_by_row_index(spark, sf_dir):
    customer, supplier = read(spark, sf_dir, "customer", "supplier")
    left = customer.select(F.col("c_nationkey").alias("table_id"), F.col("c_custkey").alias("ord"), "c_name")
    right = supplier.select(F.col("s_nationkey").alias("table_id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("patched"))
    return tables.patch_by_position(left, right, ["table_id"], "ord", ["patched"])


SQL_PATCH = """
WITH r AS (SELECT s_nationkey AS table_id, s_name AS patched, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS row_idx FROM supplier),
l AS (SELECT c_nationkey AS table_id, c_custkey AS ord, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row_idx FROM customer)
SELECT table_id, row_idx::INTEGER AS row_idx, ord, c_name, patched FROM l LEFT JOIN r USING (table_id, row_idx)"""


def column_types(spark, sf_dir):
    (orders,) = read(spark, sf_dir, "orders")
    table = orders.select(
        F.col("o_orderkey").alias("count"), F.concat((F.col("o_orderkey") % 101).cast("string"), F.lit("%")).alias("share"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("name"),
    )
    return tables.column_figures(table)


SQL_TYPES = r"""
WITH cells AS (
    SELECT 'count' AS header, o_orderkey::VARCHAR AS v FROM orders
    UNION ALL SELECT 'share', (o_orderkey % 101)::VARCHAR || '%' FROM orders
    UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders
    UNION ALL SELECT 'status', o_orderstatus FROM orders
    UNION ALL SELECT 'name', CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'order ' || o_orderkey END FROM orders)
SELECT header, round(avg((v IS NOT NULL)::INT::DOUBLE), 6) AS filled, round(avg((v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NOT NULL)::INT::DOUBLE), 6) AS numeric,
    count(DISTINCT v) AS distinct_values,
    CASE WHEN bool_and(regexp_full_match(v, '\d+')) THEN 'int' WHEN bool_and(regexp_full_match(v, '\d+(\.\d+)?%')) THEN 'percent' ELSE 'str' END AS basic_type,
    CASE WHEN avg((TRY_CAST(v AS DOUBLE) IS NOT NULL)::INT) FILTER (WHERE v IS NOT NULL) > 0.7 THEN 'numeric'
        WHEN bool_and(TRY_STRPTIME(v, '%Y-%m-%d') IS NOT NULL) FILTER (WHERE v IS NOT NULL) THEN 'date'
        WHEN count(DISTINCT v) < 10 THEN 'categorical' ELSE 'string' END AS stat_type
FROM cells GROUP BY header"""


def wide_vs_long(spark, sf_dir):
    """Each nation's customers as a table of so many rows and columns."""
    (customer,) = read(spark, sf_dir, "customer")
    sizes = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_rows"), (F.count_distinct("c_mktsegment") * (F.col("c_nationkey") % 4)).alias("n_cols"))
    shape = F.when((F.col("n_cols") > 10) & (F.col("n_rows") < 10), "wide").when((F.col("n_cols") <= 5) & (F.col("n_rows") > 10), "long").otherwise("unknown")
    return sizes.withColumn("shape", shape)


SQL_SHAPE = """
SELECT c_nationkey, count(*) AS n_rows, count(DISTINCT c_mktsegment) * (c_nationkey % 4) AS n_cols,
    CASE WHEN n_cols > 10 AND n_rows < 10 THEN 'wide' WHEN n_cols <= 5 AND n_rows > 10 THEN 'long' ELSE 'unknown' END AS shape FROM customer GROUP BY c_nationkey"""


def multiline_candidates(spark, sf_dir):
    (customer,) = read(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("\n"), "c_mktsegment")).otherwise(F.col("c_name"))
    return tables.merge_multiline(customer.select("c_custkey", name.alias("candidate")), "candidate")


SQL_MULTI = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (' || c_mktsegment || ')' ELSE c_name END AS candidate FROM customer"


def structure_verify(spark, sf_dir):
    """Which parts of a complete result each source of documents shows, as a list of what is missing."""
    (documents,) = read(spark, sf_dir, "documents")
    low = F.lower("text")
    has = {"location": T.any_word(low, ("ward", "city")), "candidate": F.contains(low, F.lit("name")), "ballot_type": F.contains(low, F.lit("mail")), "numbers": F.regexp_like("text", F.lit("[0-9]{4}"))}
    found = documents.groupBy("source").agg(*[F.bool_or(F.coalesce(x, F.lit(False))).alias(n) for n, x in has.items()])
    return found.withColumn("missing", F.array_join(F.array_compact(F.array(*[F.when(~F.col(n), n) for n in has])), ","))


SQL_STRUCTURE = """
WITH f AS (SELECT source, bool_or(regexp_matches(lower(text), 'ward|city')) AS location, bool_or(contains(lower(text), 'name')) AS candidate,
    bool_or(contains(lower(text), 'mail')) AS ballot_type, bool_or(regexp_matches(text, '[0-9]{4}')) AS numbers FROM documents GROUP BY source)
SELECT *, concat_ws(',', CASE WHEN NOT location THEN 'location' END, CASE WHEN NOT candidate THEN 'candidate' END,
    CASE WHEN NOT ballot_type THEN 'ballot_type' END, CASE WHEN NOT numbers THEN 'numbers' END) AS missing FROM f"""

QUERIES = {
    "wide_pivot_totals": (wide_pivot_totals, SQL_WIDE),
    "candidate_party_cells": (candidate_party_cells, SQL_PARTY_CELLS),
    "candidate_major": (candidate_major, SQL_CANDIDATE),
    "wide_first_wins": (wide_first_wins, _wins("arg_min")),
    "wide_last_wins": (wide_last_wins, _wins("arg_max")),
    "precinct_major_from_headers": (precinct_major_from_headers, SQL_PRECINCT),
    "grand_total_row": (grand_total_row, SQL_GRAND),
    "ballot_type_order": (ballot_type_order, SQL_BALLOT),
    "json_nested_to_wide": (json_nested_to_wide, SQL_JSON),
    "harmonize_dedupe": (harmonize_dedupe, SQL_HARMONIZE),
    "header_dedupe": (header_dedupe, SQL_HEADER),
    "schema_union_fill": (schema_union_fill, SQL_UNION),
    "low_signal_columns": (low_signal_columns, SQL_SIGNAL),
    "empty_row_filter": (empty_row_filter, SQL_EMPTY),
    "footer_filter": (footer_filter, SQL_FOOTER),
    "merge_coalesce_keyed": (merge_coalesce_keyed, SQL_MERGE),
    "patch_by_row_index": (patch_by_row_index, SQL_PATCH),
    "column_types": (column_types, SQL_TYPES),
    "wide_vs_long": (wide_vs_long, SQL_SHAPE),
    "multiline_candidates": (multiline_candidates, SQL_MULTI),
    "structure_verify": (structure_verify, SQL_STRUCTURE),
}
