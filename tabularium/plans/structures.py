"""Queries over the structure of tables, logs and libraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions import text as T
from tabularium.operators import ordered, structures, tables

from .results import read


def header_roles(spark, sf_dir):
    """Headers of two tables in words of the domain, with their roles."""
    (part,) = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 6
    header = F.when(k == 0, F.concat(F.lit("Precinct "), "p_brand")).when(k == 1, F.concat("p_type", F.lit(" % in"))).when(k == 2, F.concat(F.lit("Nominee "), "p_name")).when(k == 3, F.concat(F.lit("Sum of "), "p_brand")).otherwise(F.col("p_brand"))
    return part.select("p_partkey", structures.header_role(header).alias("role"))


SQL_ROLES = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'location' WHEN 1 THEN 'percent' WHEN 2 THEN 'candidate' WHEN 3 THEN 'total' ELSE 'other' END AS role FROM part"


def structure_classify(spark, sf_dir):
    """Each brand as a table: which structure it has."""
    (part,) = read(spark, sf_dir, "part")
    facts = part.groupBy("p_brand").agg(F.bool_or(F.col("p_type") == "ECONOMY").alias("cand"), F.bool_or(F.col("p_size") > 45).alias("loc"), (F.count_distinct("p_name") > 5).alias("wide"))
    return facts.select("p_brand", structures.orientation(F.col("cand"), F.col("loc"), F.col("wide")).alias("structure"))


SQL_CLASSIFY = """
WITH f AS (SELECT p_brand, bool_or(p_type = 'ECONOMY') AS cand, bool_or(p_size > 45) AS loc, count(DISTINCT p_name) > 5 AS wide FROM part GROUP BY 1)
SELECT p_brand, CASE WHEN wide AND loc THEN 'already-wide' WHEN cand AND loc THEN 'precinct-major' WHEN cand THEN 'candidate-major' ELSE 'ambiguous' END AS structure FROM f"""


def candidate_scores(spark, sf_dir):
    """Score of each order as a table found: lines, parts, fill."""
    line, orders = read(spark, sf_dir, "lineitem", "orders")
    facts = line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("r"), F.count_distinct("l_partkey").alias("c"), F.round(F.avg((F.col("l_discount") > 0).cast("double")), 4).alias("fill"), F.max("l_quantity").alias("q"))
    rows = facts.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    score = structures.candidate_score(F.col("q") / 50, F.col("r"), F.col("c"), F.col("fill"), F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "5-LOW")
    return rows.select("o_orderkey", score.alias("score"))


SQL_SCORES = """
WITH f AS (SELECT l_orderkey, count(*) AS r, count(DISTINCT l_partkey) AS c, round(avg((l_discount > 0)::INT), 4) AS fill, max(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(greatest(0.0, least(1.0, 0.5 * (q / 50) + 0.2 * least(r / 10, 1.0) + 0.2 * least(c / 8, 1.0) + CASE WHEN fill > 0.7 THEN fill ELSE -0.5 END
    + 0.2 * (o_orderstatus = 'F')::INT - 0.2 * (o_orderpriority = '5-LOW')::INT)), 6)::DOUBLE AS score
FROM f JOIN orders ON l_orderkey = o_orderkey"""


def signature_dedupe(spark, sf_dir):
    """Orders as tables: of those with one list of return flags and statuses, the largest."""
    (line,) = read(spark, sf_dir, "lineitem")
    found = line.groupBy(F.col("l_orderkey").alias("ord")).agg(T.signature(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus")))).alias("signature"), F.count(F.lit(1)).alias("n"))
    return structures.best_of_signature(found, "signature", "n", "ord")


SQL_DEDUPE = """
WITH f AS (SELECT l_orderkey AS ord, md5(array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), chr(31))) AS signature, count(*) AS n FROM lineitem GROUP BY 1)
SELECT ord, signature, n FROM f QUALIFY row_number() OVER (PARTITION BY signature ORDER BY n DESC, ord) = 1"""


def structure_lookup(spark, sf_dir):
    """Per title, the structure that is confirmed, most confident, least key."""
    (orders,) = read(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("title"), (F.col("o_orderstatus") == "F").alias("confirmed"), F.col("o_totalprice").alias("confidence"), "o_orderkey")
    return structures.top_one(rows, "title", F.desc("confirmed"), F.desc("confidence"), F.col("o_orderkey"))


SQL_LOOKUP = """
SELECT o_custkey AS title, o_orderstatus = 'F' AS confirmed, o_totalprice AS confidence, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey) = 1"""


def contest_scan(spark, sf_dir):
    """Filters, the hundred last keys, and the metadata's keys over the columns."""
    (events,) = read(spark, sf_dir, "events")
    found = events.where("event_type = 'view' and value > 5").orderBy(F.desc("event_id")).limit(100)
    meta = F.from_json("props", "map<string, string>")
    own = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.lit("none"))
    both = structures.merged_maps(own, meta)
    return found.select("event_id", both["user"].alias("user"), both["k"].alias("k"))


SQL_SCAN = "SELECT event_id, user_id::VARCHAR AS user, coalesce(props::JSON ->> 'k', 'none') AS k FROM events WHERE event_type = 'view' AND value > 5 ORDER BY event_id DESC LIMIT 100"


def manifest_latest(spark, sf_dir):
    """The last entry of each url, counted by status."""
    events, found = read(spark, sf_dir, "events", "pages")
    log = events.select((F.col("user_id") % 97).alias("page_id"), "event_id", "event_type").join(found.select("page_id", "url"), "page_id")
    return tables.last_rows(log, ["url"], "event_id").select("url", "event_id", "event_type")


SQL_MANIFEST = "SELECT url, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events JOIN pages ON page_id = user_id % 97 GROUP BY url"


def already_downloaded(spark, sf_dir):
    """Parts whose name or key is in the list of suppliers' downloads."""
    part, line = read(spark, sf_dir, "part", "lineitem")
    have = line.where("l_returnflag = 'A' and l_quantity > 49").select("l_partkey").distinct()
    by_key = part.join(have, F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    by_name = part.join(by_key.select("p_name", "p_type").distinct(), ["p_name", "p_type"], "left_semi")
    return by_key.select("p_partkey").union(by_name.select("p_partkey")).distinct()


SQL_DOWNLOADED = """
WITH k AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49))
SELECT p_partkey FROM k UNION SELECT p_partkey FROM part WHERE (p_name, p_type) IN (SELECT p_name, p_type FROM k)"""


def recognised_lines(spark, sf_dir):
    """Lines of several passes over one page, each once, with their mean confidence; below 30 they do not count."""
    (line,) = read(spark, sf_dir, "lineitem")
    rows = line.where("l_quantity >= 30").select((F.col("l_orderkey") % 50).alias("page"), F.concat_ws(" ", "l_returnflag", "l_linestatus", (F.col("l_partkey") % 20).cast("string")).alias("text"), "l_quantity")
    return rows.groupBy("page", "text").agg(F.round(F.avg("l_quantity"), 4).alias("confidence"))


SQL_LINES = "SELECT l_orderkey % 50 AS page, l_returnflag || ' ' || l_linestatus || ' ' || (l_partkey % 20) AS text, round(avg(l_quantity), 4) AS confidence FROM lineitem WHERE l_quantity >= 30 GROUP BY ALL"


def text_rows(spark, sf_dir):
    """Lines of text split at wide spaces; those with as many cells as there are headers."""
    (part,) = read(spark, sf_dir, "part")
    gap = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise("   ")
    lines = part.select("p_partkey", F.concat("p_brand", F.lit("  "), "p_type", gap, F.col("p_size").cast("string")).alias("line"))
    return structures.rows_of_lines(lines, "p_partkey", "line", 3).select("p_partkey", F.array_join("cells", "|").alias("cells"))


SQL_ROWS = "SELECT p_partkey, p_brand || '|' || p_type || '|' || p_size AS cells FROM part WHERE p_partkey % 3 <> 0"


def header_line(spark, sf_dir):
    (documents,) = read(spark, sf_dir, "documents")
    return structures.header_lines(documents, "doc_id", "text", ("tion", "the", "der", "que")).select("doc_id", "line", F.length("value").alias("n_chars"))


SQL_HEADER_LINE = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS line, unnest(l) AS value FROM t),
hits AS (SELECT * FROM lines WHERE contains(lower(value), 'tion')::INT + contains(lower(value), 'the')::INT + contains(lower(value), 'der')::INT + contains(lower(value), 'que')::INT >= 2)
SELECT doc_id, min(line) AS line, length(arg_min(value, line))::INTEGER AS n_chars FROM hits GROUP BY doc_id"""


def csv_long_to_wide(spark, sf_dir):
    """Result lines as text, parsed and pivoted to candidate - method columns."""
    (line,) = read(spark, sf_dir, "lineitem")
    text = F.concat_ws(",", (F.col("l_suppkey") % 25).cast("string"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity").cast("bigint").cast("string"))
    rows = line.select(F.from_csv(text, "precinct bigint, candidate string, method string, votes bigint").alias("r")).select("r.*")
    keys = [f"{a} - {b}" for a in ("A", "N", "R") for b in ("F", "O")]
    return rows.withColumn("key", F.concat_ws(" - ", "candidate", "method")).groupBy("precinct").pivot("key", keys).agg(F.sum("votes"))


SQL_CSV = (
    "SELECT l_suppkey % 25 AS precinct, "
    + ", ".join(f"(sum(l_quantity::BIGINT) FILTER (WHERE l_returnflag = '{a}' AND l_linestatus = '{b}'))::BIGINT AS \"{a} - {b}\"" for a in ("A", "N", "R") for b in ("F", "O"))
    + " FROM lineitem GROUP BY 1"
)


def party_candidates(spark, sf_dir):
    """Per party its candidates, each with its ballot types."""
    line, part = read(spark, sf_dir, "lineitem", "part")
    seen = line.select("l_partkey", "l_returnflag").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
    types = seen.groupBy("p_brand", "p_type").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "/").alias("ballots"))
    return types.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(F.concat("p_type", F.lit(":"), "ballots"))), ",").alias("candidates"))


SQL_PARTY = """
WITH t AS (SELECT p_brand, p_type, array_to_string(list_sort(list_distinct(list(l_returnflag))), '/') AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_brand, array_to_string(list_sort(list(p_type || ':' || b)), ',') AS candidates FROM t GROUP BY p_brand"""


def log_entries(spark, sf_dir):
    """Entries that passed, by their first key that is there."""
    (orders,) = read(spark, sf_dir, "orders")
    key = F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("contest "), F.col("o_custkey").cast("string"))), F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("field "), "o_orderpriority")), F.lit("unknown"))
    return orders.where(F.col("o_orderstatus").startswith("F")).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


SQL_LOG = """
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'contest ' || o_custkey WHEN 1 THEN 'field ' || o_orderpriority ELSE 'unknown' END AS key, count(*) AS n, max(o_orderkey) AS last
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"""


def library_update(spark, sf_dir):
    """Known names with those of suppliers that are new."""
    customer, supplier = read(spark, sf_dir, "customer", "supplier")
    library = customer.select(F.concat(F.lit("Unit "), (F.col("c_custkey") % 700).cast("string")).alias("name")).distinct()
    return structures.unseen(library, supplier.select(F.concat(F.lit("UNIT "), F.col("s_suppkey").cast("string")).alias("name")), ["name"])


SQL_LIBRARY = """
WITH l AS (SELECT DISTINCT 'Unit ' || (c_custkey % 700) AS name FROM customer)
SELECT name FROM l UNION ALL SELECT 'UNIT ' || s_suppkey FROM supplier WHERE lower('UNIT ' || s_suppkey) NOT IN (SELECT lower(name) FROM l)"""


def hints_as_of(spark, sf_dir):
    """The hints of all users as they stood after event 5000."""
    (events,) = read(spark, sf_dir, "events")
    return structures.as_of(events.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id", 5000)


SQL_AS_OF = "SELECT user_id, event_id, event_type, value FROM events WHERE event_id <= 5000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def log_tail(spark, sf_dir):
    """The last hundred entries of each kind of event."""
    (events,) = read(spark, sf_dir, "events")
    return ordered.keep_last(events.select("event_type", "event_id", "value"), ["event_type"], F.desc("event_id"), 100)


SQL_TAIL = "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100"


def chosen_rows(spark, sf_dir):
    """The rows picked by place."""
    (nation,) = read(spark, sf_dir, "nation")
    return structures.chosen(nation, "n_nationkey", "1, 3,x,7").select("n_nationkey", "n_name")


SQL_CHOSEN = "SELECT n_nationkey, n_name FROM nation QUALIFY row_number() OVER (ORDER BY n_nationkey) IN (1, 3, 7)"


def set_operations(spark, sf_dir):
    """Pairs (customer, status) by what they are in: new, cached, both."""
    (orders,) = read(spark, sf_dir, "orders")
    new = orders.where("year(o_orderdate) = 1999").select("o_custkey", "o_orderstatus").distinct()
    cached = orders.where("year(o_orderdate) < 1999").select("o_custkey", "o_orderstatus").distinct()
    keys = ["o_custkey", "o_orderstatus"]
    both, only = new.join(cached, keys, "left_semi"), new.join(cached, keys, "left_anti")
    return only.withColumn("in", F.lit("new")).union(both.withColumn("in", F.lit("both"))).union(cached.join(new, keys, "left_anti").withColumn("in", F.lit("cached")))


SQL_SETS = """
WITH n AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) = 1999), c AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) < 1999)
SELECT *, 'new' AS "in" FROM (SELECT * FROM n EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'both' FROM (SELECT * FROM n INTERSECT SELECT * FROM c) UNION ALL SELECT *, 'cached' FROM (SELECT * FROM c EXCEPT SELECT * FROM n)"""


def candidate_names(spark, sf_dir):
    """Names in cells of two lines, parts that begin with a party left out."""
    (customer,) = read(spark, sf_dir, "customer")
    cell = F.concat_ws("\n", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("DEM "), "c_mktsegment")), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Joe "), "c_mktsegment")))
    names = customer.select(F.explode(F.split(cell, "\n")).alias("name")).where(~F.regexp_like("name", F.lit("^(DEM|REP|IND)\\b")))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


SQL_NAMES = "SELECT name, count(*) AS n FROM (SELECT c_name AS name FROM customer UNION ALL SELECT 'Joe ' || c_mktsegment FROM customer WHERE c_custkey % 5 = 0) GROUP BY name"


QUERIES = {
    "header_roles": (header_roles, SQL_ROLES),
    "structure_classify": (structure_classify, SQL_CLASSIFY),
    "candidate_scores": (candidate_scores, SQL_SCORES),
    "signature_dedupe": (signature_dedupe, SQL_DEDUPE),
    "structure_lookup": (structure_lookup, SQL_LOOKUP),
    "contest_scan": (contest_scan, SQL_SCAN),
    "manifest_latest": (manifest_latest, SQL_MANIFEST),
    "already_downloaded": (already_downloaded, SQL_DOWNLOADED),
    "recognised_lines": (recognised_lines, SQL_LINES),
    "text_rows": (text_rows, SQL_ROWS),
    "header_line": (header_line, SQL_HEADER_LINE),
    "csv_long_to_wide": (csv_long_to_wide, SQL_CSV),
    "party_candidates": (party_candidates, SQL_PARTY),
    "log_entries": (log_entries, SQL_LOG),
    "library_update": (library_update, SQL_LIBRARY),
    "hints_as_of": (hints_as_of, SQL_AS_OF),
    "log_tail": (log_tail, SQL_TAIL),
    "chosen_rows": (chosen_rows, SQL_CHOSEN),
    "set_operations": (set_operations, SQL_SETS),
    "candidate_names": (candidate_names, SQL_NAMES),
}
