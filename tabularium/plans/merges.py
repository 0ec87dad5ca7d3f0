"""Queries over merges that depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.operators import merging, tables

from .results import read

_COLUMNS = ("name", "phone", "tag", "nation")


def merge_any_shared(spark, sf_dir):
    """Rows of two tables, customers and suppliers, merged on any value that they share."""
    customer, supplier = read(spark, sf_dir, "customer", "supplier")
    k = F.col("c_custkey")
    blank = lambda n, c: F.when(k % n == 0, c).otherwise("")
    one = customer.select(
        k.alias("ord"),
        F.when(k % 3 > 0, F.concat(F.lit("n"), k % 977)).alias("name"),
        F.when(k % 2 > 0, F.concat(F.lit("p"), k * 7 % 1201)).alias("phone"),
        blank(40, F.col("c_mktsegment")).alias("tag"),
    )
    two = supplier.select((F.col("s_suppkey") + 10_000_000).alias("ord"), F.concat(F.lit("n"), F.col("s_suppkey") * 11 % 977).alias("name"), F.concat(F.lit("nation "), "s_nationkey").alias("nation"))
    return merging.merged_any(tables.union_filled(one, two), "ord", _COLUMNS)


# the merge is said as it is defined: a fold over the rows in order, whose state is the list of kept rows
_SAME = " OR ".join(f"(m.{c} <> '' AND m.{c} = x[1].{c})" for c in _COLUMNS)
_AT = f"list_position(list_transform(acc, lambda m: {_SAME}), true)"
_FILL = ", ".join(f"'{c}': CASE WHEN o.{c} <> '' THEN o.{c} ELSE x[1].{c} END" for c in _COLUMNS)
SQL_ANY = f"""
WITH rows AS (
    SELECT c_custkey AS ord, CASE WHEN c_custkey % 3 > 0 THEN 'n' || c_custkey % 977 ELSE '' END AS name, CASE WHEN c_custkey % 2 > 0 THEN 'p' || c_custkey * 7 % 1201 ELSE '' END AS phone,
        CASE WHEN c_custkey % 40 = 0 THEN c_mktsegment ELSE '' END AS tag, '' AS nation FROM customer
    UNION ALL SELECT s_suppkey + 10000000, 'n' || s_suppkey * 11 % 977, '', '', 'nation ' || s_nationkey FROM supplier),
folded AS (
    SELECT list_reduce(list([{{'ord': ord, {", ".join(f"'{c}': {c}" for c in _COLUMNS)}, 'n_rows': 1::BIGINT}}] ORDER BY ord), lambda acc, x:
        CASE WHEN {_AT} IS NULL OR {_AT} = 0 THEN list_concat(acc, x)
        ELSE list_transform(acc, lambda o, i: CASE WHEN i = {_AT} THEN {{'ord': o.ord, {_FILL}, 'n_rows': o.n_rows + 1}} ELSE o END) END) AS kept FROM rows)
SELECT unnest(kept, recursive := true) FROM folded"""


QUERIES = {
    "merge_any_shared": (merge_any_shared, SQL_ANY),
}
