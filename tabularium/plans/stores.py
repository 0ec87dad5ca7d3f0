"""Queries over files, logs and stores: what they read they have written themselves, into a new folder of the shared one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions import text as T
from tabularium.operators import integrity, lookup, store, structures, tables
from tabularium.session import new_path
from tabularium.sources import files

from .results import read


def csv_preamble(spark, sf_dir):
    """CSV files by nation, each behind a note that also stands among its rows, read back."""
    customer, = read(spark, sf_dir, "customer")
    out = new_path(spark, "csv")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_mktsegment", F.col("c_nationkey").cast("string"))
    rows = customer.select(F.concat("c_nationkey", F.lit("")).alias("file"), F.col("c_custkey").alias("ord"), line.alias("value"))
    notes = customer.select(F.concat("c_nationkey", F.lit("")).alias("file")).distinct().select("file", F.explode(F.array(F.struct(F.lit(-3).alias("ord"), F.lit("unofficial, 1, 2").alias("value")), F.struct(F.lit(-2).alias("ord"), F.lit("Precinct No,Segment,Nation").alias("value")))).alias("z")).select("file", "z.*")
    again = notes.where("ord = -3").select("file", F.lit(1 << 40).alias("ord"), "value")
    rows.unionByName(notes).unionByName(again).repartition("file").sortWithinPartitions("file", "ord").select("file", "value").write.partitionBy("file").text(f"{out}/t")
    return files.with_preamble(spark, f"{out}/t", ("precinct",))


SQL_PREAMBLE = """
SELECT c_custkey::VARCHAR AS "Precinct No", c_mktsegment AS "Segment", c_nationkey::VARCHAR AS "Nation" FROM customer
UNION ALL SELECT 'unofficial', '1', '2' FROM (SELECT DISTINCT c_nationkey FROM customer)"""


def delimited_interpret(spark, sf_dir):
    """Delimited texts, of at most 500 customers of a nation each: mark and headers found out; those without the needed columns give an error."""
    customer, = read(spark, sf_dir, "customer")
    k = F.pmod("c_nationkey", F.lit(4))
    mark = F.element_at(F.array(F.lit(","), F.lit("\t"), F.lit(";"), F.lit("|")), k.cast("int") + 1)
    head = F.when(F.col("c_nationkey") % 5 == 4, F.concat_ws("x", F.lit("Place"), F.lit("Votes"))).otherwise(F.concat(F.lit("Jurisdiction"), "mark", F.lit("GOP"), "mark", F.lit("Other")))
    lines = customer.withColumn("mark", mark).groupBy("c_nationkey", F.floor(F.col("c_custkey") / 500).alias("part"), "mark").agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.concat(F.col("c_custkey").cast("string"), "mark", "c_mktsegment", "mark", F.lit("z")).alias("line")))).alias("l"))
    texts = lines.select(F.struct("c_nationkey", "part").alias("text_id"), F.concat_ws("\n", head, F.transform("l", lambda x: x["line"])).alias("text"))
    found = files.interpreted(texts, "text_id", "text")
    return found.select("text_id.*", F.element_at("values", F.lit("county")).alias("county"), F.element_at("values", F.lit("rep")).alias("rep"), "error")


SQL_INTERPRET = """
SELECT c_nationkey, c_custkey // 500 AS part, c_custkey::VARCHAR AS county, c_mktsegment AS rep, NULL::VARCHAR AS error FROM customer WHERE c_nationkey % 5 <> 4
UNION ALL SELECT DISTINCT c_nationkey, c_custkey // 500, NULL, NULL, 'essential headers are missing' FROM customer WHERE c_nationkey % 5 = 4"""


def url_lines(spark, sf_dir):
    """Addresses written as a list with comments and blanks, read back."""
    found, = read(spark, sf_dir, "pages")
    out = new_path(spark, "urls")
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("# "), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("  "), "url", F.lit(" "))).otherwise(F.col("url"))
    found.select(F.explode(F.array(line, F.lit(" ")))).write.text(f"{out}/t")
    return files.url_list(spark, f"{out}/t")


SQL_URLS = "SELECT url FROM pages WHERE page_id % 3 <> 0"


def file_listing(spark, sf_dir):
    """Files of one ending with their sizes and ages in days."""
    nation, = read(spark, sf_dir, "nation")
    out = new_path(spark, "files")
    nation.select(F.col("n_regionkey").alias("r"), "n_name").repartition("r").write.partitionBy("r").text(f"{out}/t")
    found = files.listing(spark, f"{out}/t", "txt")
    return found.select(F.regexp_extract("path", "r=(\\d+)", 1).alias("region"), F.col("size").alias("n_bytes"), F.date_diff(F.current_date(), F.to_date("modified")).between(0, 1).alias("fresh")).groupBy("region").agg(F.sum("n_bytes").alias("n_bytes"), F.bool_and("fresh").alias("fresh"))


SQL_LISTING = "SELECT n_regionkey::VARCHAR AS region, sum(length(n_name) + 1)::BIGINT AS n_bytes, true AS fresh FROM nation GROUP BY 1"


def written_results(spark, sf_dir):
    """Results written by folders of their levels, with metadata; both read back."""
    orders, = read(spark, sf_dir, "orders")
    out = new_path(spark, "results")
    rows = orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("state"), F.substring("o_orderpriority", 1, 1).alias("race"), "o_orderkey", "o_totalprice")
    store.write_results(rows, out, ("state", "race"))
    meta = spark.read.schema("state string, race string, n_rows bigint, headers string").json(f"{out}/metadata")
    kept = spark.read.schema("o_orderkey bigint, o_totalprice double, state string, race string").parquet(f"{out}/results").groupBy("state", "race").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return meta.join(kept, ["state", "race"])


SQL_WRITTEN = """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'Unknown' ELSE o_orderstatus END AS state, o_orderpriority[1] AS race, count(*) AS n_rows, 'o_orderkey,o_totalprice' AS headers, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2"""


def fixed_csv(spark, sf_dir):
    """A table as CSV with fixed leading columns, the others by name; read back."""
    orders, = read(spark, sf_dir, "orders")
    out = new_path(spark, "fixed")
    rows = orders.select("o_totalprice", F.col("o_orderkey").alias("Precinct"), F.lit("50%").alias("% Precincts Reporting"), "o_orderstatus", F.concat(F.lit('a "b", '), "o_orderpriority").alias("name"))
    store.write_fixed_csv(rows, f"{out}/t", ("Precinct", "% Precincts Reporting"))
    back = spark.read.option("header", True).option("escape", '"').csv(f"{out}/t")
    return back.select(F.lit(",".join(back.columns)).alias("header"), F.col("Precinct").cast("bigint").alias("key"), F.col("o_totalprice").cast("double").alias("price"), "name")


SQL_FIXED = """SELECT 'Precinct,% Precincts Reporting,name,o_orderstatus,o_totalprice' AS header, o_orderkey AS key, o_totalprice AS price, 'a "b", ' || o_orderpriority AS name FROM orders"""


def appended_rows(spark, sf_dir):
    """New keys of a log, one row each, that a store does not hold yet."""
    events, = read(spark, sf_dir, "events")
    have = events.where("event_id < 300").select("user_id", "event_type").distinct()
    new = events.where("event_id >= 200").select("user_id", "event_type", F.lit(1).alias("one"))
    return store.append_new(have, new, ["user_id", "event_type"])


SQL_APPENDED = """SELECT DISTINCT user_id, event_type, 1::INTEGER AS one FROM events WHERE event_id >= 200
    AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id < 300)"""


def rewritten_versions(spark, sf_dir):
    """Contests inserted and updated by version: the table after three rewrites."""
    events, = read(spark, sf_dir, "events")
    out = new_path(spark, "versions")
    rows = events.select("user_id", "event_id", "event_type", "value")
    path = ""
    for i in range(3):
        path = store.rewrite_latest(spark, out, rows.where(F.col("event_id") % 3 == i), ["user_id"], "event_id")
    return spark.read.parquet(path)


SQL_REWRITTEN = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"


def pattern_log(spark, sf_dir):
    """A log of patterns as JSON lines, read back with counts of what was kept."""
    events, = read(spark, sf_dir, "events")
    out = new_path(spark, "patterns")
    events.select(F.concat(F.lit("div."), "event_type").alias("selector"), (F.col("value") > 20).alias("approved"), F.substring("props", 1, 2000).alias("html")).write.json(f"{out}/t")
    back = spark.read.schema("selector string, approved boolean, html string").json(f"{out}/t")
    return back.groupBy("selector").agg(F.count_if("approved").alias("approved"), F.count(F.lit(1)).alias("n"), F.max(F.length("html")).alias("longest"))


SQL_PATTERNS = "SELECT 'div.' || event_type AS selector, count(*) FILTER (WHERE value > 20) AS approved, count(*) AS n, max(length(props))::INTEGER AS longest FROM events GROUP BY 1"


def merged_header_rows(spark, sf_dir):
    """Two header rows of each table made one."""
    part, = read(spark, sf_dir, "part")
    one = F.array("p_brand", F.lit("12"), F.lit(" "))
    two = F.array(F.lit("Votes"), "p_name", F.col("p_size").cast("string"))
    return part.select("p_partkey", F.array_join(tables.merged_headers([one, two]), "|").alias("headers"))


SQL_MERGED = "SELECT p_partkey, p_brand || ' Votes|' || p_name || '|' AS headers FROM part"


def similar_headers(spark, sf_dir):
    """Columns with names that are alike become one."""
    customer, = read(spark, sf_dir, "customer")
    odd = F.col("c_custkey") % 2 == 0
    rows = customer.select("c_custkey", F.when(odd, F.col("c_mktsegment")).alias("Market Segment"), F.when(~odd, F.col("c_mktsegment")).alias("market segments"))
    return structures.merge_similar_headers(rows)


SQL_SIMILAR = 'SELECT c_custkey, c_mktsegment AS "Market Segment" FROM customer'


def status_filter(spark, sf_dir):
    """Addresses whose last status is one of those asked for, with the metadata of their last entry."""
    events, found = read(spark, sf_dir, "events", "pages")
    log = events.select((F.col("user_id") % 97).alias("page_id"), "event_id", "event_type", "value")
    last = tables.last_rows(log, ["page_id"], "event_id").where(F.col("event_type").isin("error", "view"))
    return last.join(found.select("page_id", "url"), "page_id").select("url", "event_type", "value")


SQL_STATUS = """
WITH l AS (SELECT user_id % 97 AS page_id, max(event_id) AS e, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1)
SELECT url, event_type, value FROM l JOIN pages USING (page_id) WHERE event_type IN ('error', 'view')"""


def domain_selectors(spark, sf_dir):
    """The selector that last worked for each page's domain."""
    events, found = read(spark, sf_dir, "events", "pages")
    host = F.try_parse_url("url", F.lit("HOST"))
    log = events.where("value > 10").select((F.col("user_id") % 97).alias("page_id"), "event_id", "event_type").join(found.select("page_id", host.alias("host")), "page_id")
    best = tables.last_rows(log.select("host", "event_id", F.concat(F.lit("div."), "event_type").alias("selector")), ["host"], "event_id")
    return found.select("page_id", host.alias("host")).join(best, "host", "left").select("page_id", "host", F.coalesce("selector", F.lit("table")).alias("selector"))


SQL_DOMAIN = r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^\w+://([^/?#]+)', 1) AS host FROM pages),
b AS (SELECT host, 'div.' || arg_max(event_type, event_id) AS selector FROM events JOIN h ON page_id = user_id % 97 WHERE value > 10 GROUP BY host)
SELECT page_id, host, coalesce(selector, 'table') AS selector FROM h LEFT JOIN b USING (host)"""


def url_overrides(spark, sf_dir):
    """The module of the first fragment, in the list's order, that an address holds."""
    found, = read(spark, sf_dir, "pages")
    hints = spark.createDataFrame([(0, "/fr/", "modules.fr"), (1, "example.org", "modules.org"), (2, "page=", "modules.paged"), (3, "m.", "modules.mobile")], "ord int, fragment string, module string")
    return lookup.overridden(found.select("page_id", "url"), "url", hints).select("page_id", "module")


SQL_OVERRIDES = """
WITH o(ord, fragment, module) AS (VALUES (0, '/fr/', 'modules.fr'), (1, 'example.org', 'modules.org'), (2, 'page=', 'modules.paged'), (3, 'm.', 'modules.mobile'))
SELECT page_id, arg_min(module, ord) AS module FROM pages LEFT JOIN o ON contains(url, fragment) GROUP BY page_id"""


def button_cascade(spark, sf_dir):
    """Buttons of a contest: one that has worked before, else those with its title, else those with its keyword, else all of its page: how many, and the first."""
    orders, events = read(spark, sf_dir, "orders", "events")
    contests = orders.select(F.col("o_orderkey").alias("contest"), (F.col("o_custkey") % 140).alias("title"), F.substring("o_orderpriority", 1, 1).alias("keyword"), (F.col("o_orderkey") % 25).alias("page"))
    buttons = events.select(F.col("event_id").alias("button"), (F.col("user_id") * 3 % 100).alias("title"), (F.col("event_id") % 3).cast("string").alias("keyword"), (F.col("event_id") % 25).alias("page"))
    log = events.where("event_type = 'purchase'").groupBy((F.col("user_id") * 7 % 97).alias("title")).agg(F.lit(1).cast("long").alias("n"), F.max("event_id").alias("button"))
    # buttons are counted by what is asked for before they meet contests: no join multiplies rows
    by = lambda rows, *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("button").alias("button"))
    sources = [contests.join(log, "title"), contests.join(by(buttons.where("button % 2 = 0"), "title"), "title"), contests.join(by(buttons, "keyword", "page"), ["keyword", "page"]), contests.join(by(buttons, "page"), "page")]
    return lookup.first_source(contests.select("contest"), "contest", *[x.select("contest", "n", "button") for x in sources])


SQL_BUTTONS = """
WITH c AS (SELECT o_orderkey AS contest, o_custkey % 140 AS title, o_orderpriority[1] AS keyword, o_orderkey % 25 AS page FROM orders),
b AS (SELECT event_id AS button, user_id * 3 % 100 AS title, (event_id % 3)::VARCHAR AS keyword, event_id % 25 AS page FROM events),
l AS (SELECT user_id * 7 % 97 AS title, 1::BIGINT AS n, max(event_id) AS button FROM events WHERE event_type = 'purchase' GROUP BY 1),
t AS (SELECT title, count(*) AS n, min(button) AS button FROM b WHERE button % 2 = 0 GROUP BY 1),
k AS (SELECT keyword, page, count(*) AS n, min(button) AS button FROM b GROUP BY 1, 2),
p AS (SELECT page, count(*) AS n, min(button) AS button FROM b GROUP BY 1),
s AS (SELECT 0 AS source, contest, l.n, l.button FROM c JOIN l USING (title) UNION ALL SELECT 1, contest, t.n, t.button FROM c JOIN t USING (title)
    UNION ALL SELECT 2, contest, k.n, k.button FROM c JOIN k USING (keyword, page) UNION ALL SELECT 3, contest, p.n, p.button FROM c JOIN p USING (page))
SELECT contest, source::INTEGER AS source, n, button FROM s QUALIFY source = min(source) OVER (PARTITION BY contest)"""


def panel_contests(spark, sf_dir):
    """Contests with the first panel of the same normalised label, if there is one."""
    customer, part = read(spark, sf_dir, "customer", "part")
    contests = customer.select("c_custkey", F.concat(F.lit("Brand # "), F.col("c_custkey") % 40).alias("label"))
    panels = part.select("p_partkey", F.upper("p_brand").alias("label"))
    first = panels.groupBy(T.label(F.col("label")).alias("k")).agg(F.min("p_partkey").alias("panel"))
    return contests.withColumn("k", T.label(F.col("label"))).join(first, "k", "left").select("c_custkey", "panel")


SQL_PANEL = "SELECT c_custkey, panel FROM customer LEFT JOIN (SELECT p_brand, min(p_partkey) AS panel FROM part GROUP BY 1) ON p_brand = 'Brand#' || (c_custkey % 40)"


def denied_structures(spark, sf_dir):
    """How often each structure has been denied, added to the counts there were."""
    events, = read(spark, sf_dir, "events")
    denied = events.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    before = events.where("event_id % 500 = 0").select("user_id", F.lit(10).cast("bigint").alias("n"))
    return denied.unionByName(before).groupBy("user_id").agg(F.sum("n").alias("n"))


SQL_DENIED = "SELECT user_id, sum(n)::BIGINT AS n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 UNION ALL SELECT user_id, 10 FROM events WHERE event_id % 500 = 0) GROUP BY 1"


def reviewed_labels(spark, sf_dir):
    """A library after a table of corrections: labels edited, rows merged into another one, rows removed."""
    part, = read(spark, sf_dir, "part")
    library = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"), F.col("p_size").alias("n"))
    k = F.col("p_partkey")
    changes = part.where("p_partkey % 4 = 0").select(k.alias("id"), F.when(k % 12 == 0, "edit").when(k % 12 == 4, "remove").otherwise("merge").alias("action"), F.when(k % 12 == 0, F.lower("p_brand")).alias("label"), F.when(k % 12 == 8, k + 1).alias("into"))
    return store.corrected(library, changes, "id", "n")


SQL_REVIEWED = """
WITH m AS (SELECT p_partkey + 1 AS id, p_size AS n FROM part WHERE p_partkey % 12 = 8)
SELECT p_partkey AS id, CASE WHEN p_partkey % 12 = 0 THEN lower(p_brand) ELSE p_type END AS label, (p_size + coalesce(m.n, 0))::BIGINT AS n
FROM part LEFT JOIN m ON m.id = p_partkey WHERE p_partkey % 12 NOT IN (4, 8)"""


def unknown_tags(spark, sf_dir):
    """Tags of pages that the list of known ones lacks, each once."""
    found, = read(spark, sf_dir, "pages")
    tags = found.select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))
    known = spark.createDataFrame([(t,) for t in ("html", "head", "body", "p", "a", "ul", "li", "div")], "tag string")
    return tags.distinct().join(known, "tag", "left_anti")


SQL_TAGS = "SELECT DISTINCT tag FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) WHERE tag NOT IN ('html', 'head', 'body', 'p', 'a', 'ul', 'li', 'div')"


def integrity_report(spark, sf_dir):
    """All checks of contests in one table: duplicates and gaps, fields that do not fit, dates out of the expected year, outliers."""
    orders, = read(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", F.concat("o_orderstatus", (F.col("o_custkey") % 200).cast("string")).alias("title"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 50 > 0, "x").alias("state"), F.lit(None).cast("string").alias("county"), "o_totalprice", "o_orderdate")
    plain = integrity.issues(rows, "o_orderkey", "title", "year", "state", "county", "o_orderkey")
    fields = integrity.cross_field(rows, "o_orderkey", {"open_and_cheap": (F.substring("title", 1, 1) == "O") & (F.col("o_totalprice") < 2000)})
    dates = rows.where(F.year("o_orderdate") != 1998).select("o_orderkey", F.lit("other_year").alias("issue"))
    far = integrity.z_outliers(rows, ["state"], "o_totalprice", 1.7).select("o_orderkey", F.lit("outlier").alias("issue"))
    return plain.unionByName(fields).unionByName(dates).unionByName(far)


SQL_REPORT = """
WITH r AS (SELECT o_orderkey, o_orderstatus || (o_custkey % 200) AS title, year(o_orderdate) AS year, CASE WHEN o_orderkey % 50 > 0 THEN 'x' END AS state, o_totalprice AS p FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY title, year, state ORDER BY o_orderkey) AS k, (p - avg(p) OVER (PARTITION BY state)) / stddev_pop(p) OVER (PARTITION BY state) AS z FROM r)
SELECT o_orderkey, 'duplicate' AS issue FROM n WHERE k > 1 UNION ALL SELECT o_orderkey, 'missing_location' FROM n WHERE state IS NULL
UNION ALL SELECT o_orderkey, 'open_and_cheap' FROM n WHERE title[1] = 'O' AND p < 2000 UNION ALL SELECT o_orderkey, 'other_year' FROM n WHERE year <> 1998
UNION ALL SELECT o_orderkey, 'outlier' FROM n WHERE abs(z) > 1.7 AND state IS NOT NULL"""


def annotated_rows(spark, sf_dir):
    """How many different people, places, ballot types and numbers the whole texts of each source name, and in how many documents."""
    documents, = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = lambda known: F.filter(F.array(*map(F.lit, known)), lambda b: F.contains(F.lower(text), b))
    kinds = {"people": F.regexp_extract_all(text, F.lit("([A-Z][a-z]+ [A-Z][a-z]+)"), 1), "places": words(T.LOCATION_WORDS), "ballots": words(T.BALLOT_ORDER), "numbers": F.regexp_extract_all(text, F.lit("\\b([0-9][0-9,.]*)"), 1)}
    rows = documents.select("source", "doc_id", *[F.array_distinct(v).alias(k) for k, v in kinds.items()])
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in kinds])
    return rows.select("source", "doc_id", F.inline(named)).select("source", "doc_id", "kind", F.explode("found").alias("name")).groupBy("source", "kind").agg(F.count_distinct("name").alias("n_names"), F.count_distinct("doc_id").alias("n_documents"))


_BALLOTS = ", ".join(f"'{b}'" for b in T.BALLOT_ORDER)
_WORDS = ", ".join(f"'{b}'" for b in T.LOCATION_WORDS)
SQL_ANNOTATED = rf"""
WITH d AS (SELECT source, doc_id, coalesce(text, '') AS text FROM documents),
r AS (
    SELECT source, doc_id, 'people' AS kind, unnest(regexp_extract_all(text, '([A-Z][a-z]+ [A-Z][a-z]+)', 1)) AS name FROM d
    UNION ALL SELECT source, doc_id, 'numbers', unnest(regexp_extract_all(text, '\b([0-9][0-9,.]*)', 1)) FROM d
    UNION ALL SELECT source, doc_id, 'places', unnest(list_filter([{_WORDS}], lambda b: contains(lower(text), b))) FROM d
    UNION ALL SELECT source, doc_id, 'ballots', unnest(list_filter([{_BALLOTS}], lambda b: contains(lower(text), b))) FROM d)
SELECT source, kind, count(DISTINCT name) AS n_names, count(DISTINCT doc_id) AS n_documents FROM r GROUP BY ALL"""


def confirmed_structures(spark, sf_dir):
    """Structures that were confirmed, of tables that hold something: one row each, and whether it is its title's latest."""
    orders, = read(spark, sf_dir, "orders")
    rows = orders.select((F.col("o_custkey") % 100).alias("title"), F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") == "F").alias("confirmed"), (F.col("o_orderkey") % 3).alias("n_rows"))
    kept = rows.where("confirmed and n_rows > 0").select("title", "key")
    return kept.join(kept.groupBy("title").agg(F.max("key").alias("last")), "title").select("title", "key", (F.col("key") == F.col("last")).alias("latest"))


SQL_CONFIRMED = "SELECT o_custkey % 100 AS title, o_orderkey AS key, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey % 100) AS latest FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0"


QUERIES = {
    "csv_preamble": (csv_preamble, SQL_PREAMBLE),
    "delimited_interpret": (delimited_interpret, SQL_INTERPRET),
    "url_lines": (url_lines, SQL_URLS),
    "file_listing": (file_listing, SQL_LISTING),
    "written_results": (written_results, SQL_WRITTEN),
    "fixed_csv": (fixed_csv, SQL_FIXED),
    "appended_rows": (appended_rows, SQL_APPENDED),
    "rewritten_versions": (rewritten_versions, SQL_REWRITTEN),
    "pattern_log": (pattern_log, SQL_PATTERNS),
    "merged_header_rows": (merged_header_rows, SQL_MERGED),
    "similar_headers": (similar_headers, SQL_SIMILAR),
    "status_filter": (status_filter, SQL_STATUS),
    "domain_selectors": (domain_selectors, SQL_DOMAIN),
    "url_overrides": (url_overrides, SQL_OVERRIDES),
    "button_cascade": (button_cascade, SQL_BUTTONS),
    "panel_contests": (panel_contests, SQL_PANEL),
    "denied_structures": (denied_structures, SQL_DENIED),
    "reviewed_labels": (reviewed_labels, SQL_REVIEWED),
    "unknown_tags": (unknown_tags, SQL_TAGS),
    "integrity_report": (integrity_report, SQL_REPORT),
    "annotated_rows": (annotated_rows, SQL_ANNOTATED),
    "confirmed_structures": (confirmed_structures, SQL_CONFIRMED),
}
