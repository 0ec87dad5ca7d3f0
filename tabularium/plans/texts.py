"""Queries over text: normalised labels, extracted values, spans, lines and flat-text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions import fuzzy
from tabularium.functions import text as T
from tabularium.operators import integrity
from tabularium.sources import files, pages

from .results import read


def percent_reported(spark, sf_dir):
    """Share reported, read from headings of four shapes."""
    (orders,) = read(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    heading = F.when(n % 4 == 0, F.concat((n % 101).cast("string"), F.lit(" % - Reported"))).when(n % 4 == 1, F.concat(F.lit("Ward "), n.cast("string"), F.lit(": Fully Reported")))
    heading = heading.when(n % 4 == 2, F.concat((n % 1000).cast("string"), F.lit("%reported"))).otherwise(F.lit("Not yet in"))
    return orders.select("o_orderkey", T.percent_reported(heading).alias("percent"))


SQL_PERCENT = r"""
WITH h AS (SELECT o_orderkey, lower(CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 101) || ' % - Reported' WHEN 1 THEN 'Ward ' || o_orderkey || ': Fully Reported'
    WHEN 2 THEN (o_orderkey % 1000) || '%reported' ELSE 'Not yet in' END) AS heading FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(heading, '(\d{1,3})\s*%[\s\-]*reported') THEN regexp_extract(heading, '(\d{1,3})\s*%[\s\-]*reported', 1) || '%'
    WHEN contains(heading, 'fully reported') THEN '100%' END AS percent FROM h"""


def year_extract(spark, sf_dir):
    """Orders per year named in their titles."""
    (orders,) = read(spark, sf_dir, "orders")
    title = F.concat_ws(" ", "o_orderpriority", F.date_format("o_orderdate", "yyyy"), F.lit("general"), F.col("o_orderkey").cast("string"))
    return orders.groupBy(T.year(title).alias("year"), T.contest_title(F.concat("o_orderstatus", F.lit(" (Vote for 2)"))).alias("title")).agg(F.count(F.lit(1)).alias("n"))


SQL_YEAR = "SELECT year(o_orderdate)::INTEGER AS year, o_orderstatus AS title, count(*) AS n FROM orders GROUP BY ALL"


def emails(spark, sf_dir):
    (documents,) = read(spark, sf_dir, "documents")
    return documents.select("doc_id", F.explode(T.emails(F.col("text"))).alias("email"))


SQL_EMAILS = r"SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1)) AS email FROM documents"


def urls(spark, sf_dir):
    """Addresses written in texts, pages' own among them."""
    documents, found = read(spark, sf_dir, "documents", "pages")
    texts = documents.select(F.col("doc_id").alias("id"), "text").union(found.select("page_id", F.concat(F.lit("see "), "url", F.lit(" and "), "url")))
    return texts.select("id", F.explode(T.urls(F.col("text"))).alias("url"))


SQL_URLS = r"""
SELECT id, unnest(regexp_extract_all(text, '(https?://\S+)', 1)) AS url
FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT page_id, 'see ' || url || ' and ' || url FROM pages)"""


def normalize_label(spark, sf_dir):
    """Labels of parts, whatever their case, spaces and marks, with what they stand for."""
    (part,) = read(spark, sf_dir, "part")
    raw = F.concat(F.initcap("p_name"), F.lit(" / "), "p_brand", F.lit(" é-"), (F.col("p_size") % 5).cast("string"))
    return part.groupBy(T.label(raw).alias("label"), T.column_name(F.col("p_brand")).alias("brand")).agg(F.count(F.lit(1)).alias("n"))


SQL_LABEL = r"""
SELECT regexp_replace(lower(p_name || ' / ' || p_brand || ' é-' || (p_size % 5)), '[^\p{L}\p{N}_]', '', 'g') AS label, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS brand, count(*) AS n
FROM part GROUP BY ALL"""


def folded_text(spark, sf_dir):
    """Lower case without accents: digest of every text and turn."""
    documents, turns = read(spark, sf_dir, "documents", "conversations")
    texts = documents.select(F.col("doc_id").alias("id"), F.lit(-1).cast("bigint").alias("turn"), "text").union(turns.select("conv_id", "turn", "text"))
    return texts.select("id", "turn", F.md5(fuzzy.fold("text").cast("binary")).alias("digest"))


SQL_FOLD = r"""
SELECT id, turn, md5(regexp_replace(strip_accents(trim(lower(text), E' \t\n\r\x0b\x0c')), '[^\x00-\x7F]', '', 'g')) AS digest
FROM (SELECT doc_id AS id, -1::BIGINT AS turn, text FROM documents UNION ALL SELECT conv_id, turn, text FROM conversations)"""


def html_text_strip(spark, sf_dir):
    (found,) = read(spark, sf_dir, "pages")
    return found.select("page_id", T.strip_html(F.col("html")).alias("text"))


SQL_STRIP = r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages"""


def download_links(spark, sf_dir):
    """Links of pages with the first supported format they name."""
    (found,) = read(spark, sf_dir, "pages")
    rows = pages.links(found).withColumn("link", F.when(F.col("ord") % 3 == 0, F.concat("link", F.lit(".CSV"))).otherwise(F.col("link")))
    return rows.select("page_id", "ord", "link", pages.link_format(F.col("link")).alias("format"))


SQL_LINKS = r"""
WITH found AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS l FROM pages),
links AS (SELECT page_id, unnest(range(len(l)))::INTEGER AS ord, unnest(l) AS link FROM found),
marked AS (SELECT page_id, ord, CASE WHEN ord % 3 = 0 THEN link || '.CSV' ELSE link END AS link FROM links)
SELECT *, CASE WHEN contains(lower(link), '.json') THEN 'json' WHEN contains(lower(link), '.csv') THEN 'csv' WHEN contains(lower(link), '.pdf') THEN 'pdf' END AS format FROM marked"""


def url_host_path(spark, sf_dir):
    (found,) = read(spark, sf_dir, "pages")
    part = lambda name: F.try_parse_url("url", F.lit(name)).alias(name.lower())
    return found.select("page_id", part("HOST"), part("PATH"), F.try_parse_url("url", F.lit("QUERY"), F.lit("page")).alias("number"))


SQL_HOST = r"""
SELECT page_id, nullif(regexp_extract(url, '^\w+://([^/?#]+)', 1), '') AS host, regexp_extract(url, '^\w+://[^/?#]+([^?#]*)', 1) AS path,
    nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS number FROM pages"""


def entity_context(spark, sf_dir):
    """Thirty characters on both sides of every hit of a word."""
    (documents,) = read(spark, sf_dir, "documents")
    return documents.select("doc_id", F.posexplode(T.context_windows(F.col("text"), "tion")).alias("hit", "context"))


SQL_CONTEXT = """
WITH p AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS place FROM documents),
h AS (SELECT doc_id, text, place FROM p WHERE lower(substr(text, place, 4)) = 'tion')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INTEGER AS hit, substr(text, greatest(place - 30, 1), place + 34 - greatest(place - 30, 1)) AS context FROM h"""


def keyphrase_match(spark, sf_dir):
    (documents,) = read(spark, sf_dir, "documents")
    return documents.select("doc_id", F.coalesce(T.keyphrase(F.col("text"), "under the city"), F.lit(False)).alias("hit"), T.words_present(F.coalesce("text", F.lit("")), ("mail", "name", "city", "ward")).alias("n_words"))


SQL_KEYPHRASE = r"""
SELECT doc_id, coalesce(regexp_matches(lower(text), 'under\s+the\s+city[\s:]*$') OR contains(lower(text), 'under')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'city')::INT >= 2, false) AS hit,
    (contains(lower(coalesce(text, '')), 'mail')::INT + contains(lower(coalesce(text, '')), 'name')::INT + contains(lower(coalesce(text, '')), 'city')::INT + contains(lower(coalesce(text, '')), 'ward')::INT)::INTEGER AS n_words
FROM documents"""


def regex_entities(spark, sf_dir):
    """How often each pair of capitalised words occurs: the most frequent hundred."""
    (documents,) = read(spark, sf_dir, "documents")
    return integrity.top_counts(documents.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+ [A-Z][a-z]+)"), 1)).alias("name")), "name", 100)


SQL_ENTITIES = "SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+ [A-Z][a-z]+)', 1)) AS name FROM documents) GROUP BY name ORDER BY n DESC, name LIMIT 100"


def overlap_removal(spark, sf_dir):
    """Spans of each order without overlaps: by start, longest first."""
    (line,) = read(spark, sf_dir, "lineitem")
    span = F.struct((F.col("l_partkey") % 60).cast("int").alias("start"), (F.col("l_partkey") % 60 + F.col("l_quantity") / 4 + 1).cast("int").alias("end"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("label"))
    spans = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    kept = T.without_overlaps(F.array_distinct(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit("x").alias("label")))))
    return spans.select("l_orderkey", F.inline(kept)).drop("label")


SQL_OVERLAP = """
WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey, (l_partkey % 60)::INTEGER AS a, floor(l_partkey % 60 + l_quantity / 4 + 1)::INTEGER AS b FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b DESC) AS n FROM s),
walk AS (
    SELECT l_orderkey, a, b, n, b AS last, true AS keep FROM ranked WHERE n = 1
    UNION ALL
    SELECT r.l_orderkey, r.a, r.b, r.n, CASE WHEN r.a >= w.last THEN r.b ELSE w.last END, r.a >= w.last FROM walk w JOIN ranked r ON r.l_orderkey = w.l_orderkey AND r.n = w.n + 1)
SELECT l_orderkey, a AS "start", b AS "end" FROM walk WHERE keep"""


def flat_text_table(spark, sf_dir):
    (documents,) = read(spark, sf_dir, "documents")
    return files.flat_tables(documents, "doc_id", "text").select("doc_id", "line", "width", F.array_join("cells", "|").alias("cells"))


SQL_FLAT = r"""
WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS line, unnest(l) AS value FROM texts),
cells AS (SELECT doc_id, line, list_transform(list_filter(regexp_split_to_array(value, '\s{2,}|\t|\|'), lambda x: trim(x) <> ''), lambda x: trim(x)) AS cells FROM lines),
wide AS (SELECT *, len(cells)::INTEGER AS width FROM cells WHERE len(cells) > 1),
modal AS (SELECT doc_id, width FROM (SELECT doc_id, width, count(*) AS n FROM wide GROUP BY ALL HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, width DESC) = 1)
SELECT doc_id, line, width, array_to_string(cells, '|') AS cells FROM wide JOIN modal USING (doc_id, width)"""


def text_block_rows(spark, sf_dir):
    """Turns as blocks of lines: one that ends in a mark opens a block."""
    (documents,) = read(spark, sf_dir, "documents")
    return files.text_blocks(documents, "doc_id", "text", r"^[A-Z][a-z]+ .*\.$").groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line").alias("first_line"))


SQL_BLOCKS = r"""
WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS line, unnest(l) AS value FROM texts),
blocks AS (SELECT *, sum(regexp_matches(value, '^[A-Z][a-z]+ .*\.$')::INT) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM lines)
SELECT doc_id, block::BIGINT AS block, count(*) AS n_lines, min(line) AS first_line FROM blocks WHERE block > 0 GROUP BY ALL"""


def contest_blocks(spark, sf_dir):
    """Contests, candidates, parties, shares and votes that texts tell: a text for each customer with orders, lines by a rule."""
    (orders,) = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pick = lambda n, *options: F.element_at(F.array(*map(F.lit, options)), F.pmod(n, F.lit(len(options))).cast("int") + 1)
    votes = F.format_number(k, 0)
    line = F.when(k % 11 == 0, F.concat(pick(k, "US SENATE ", "For President ", "Governor, ", "Member of Congress "), "o_orderpriority")).when(k % 7 == 0, F.lit("  ")).when(k % 5 == 1, F.concat((k % 101).cast("string"), F.lit(".5 %")))
    line = line.when(k % 5 == 2, votes).when(k % 5 == 3, pick(k, "Democratic", "the REPUBLICAN line", "Working Families", "write-in votes")).when(k % 13 == 0, F.lit("Republican 40%")).otherwise(F.concat(F.lit(" Ann "), "o_orderstatus", F.lit(" "), k % 17))
    texts = orders.select("o_custkey", "o_orderkey", line.alias("line")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return files.contest_rows(texts, "o_custkey", "text")


SQL_CONTESTS = r"""
WITH l AS (
    SELECT o_custkey, o_orderkey AS k, trim(CASE WHEN o_orderkey % 11 = 0 THEN ['US SENATE ', 'For President ', 'Governor, ', 'Member of Congress '][o_orderkey % 4 + 1] || o_orderpriority WHEN o_orderkey % 7 = 0 THEN '  '
        WHEN o_orderkey % 5 = 1 THEN o_orderkey % 101 || '.5 %' WHEN o_orderkey % 5 = 2 THEN format('{:,}', o_orderkey)
        WHEN o_orderkey % 5 = 3 THEN ['Democratic', 'the REPUBLICAN line', 'Working Families', 'write-in votes'][o_orderkey % 4 + 1] WHEN o_orderkey % 13 = 0 THEN 'Republican 40%' ELSE ' Ann ' || o_orderstatus || ' ' || o_orderkey % 17 END) AS v
    FROM orders),
c AS (SELECT *, regexp_matches(lower(v), 'president|senate|congress|governor') AS opens FROM l WHERE v <> ''),
n AS (SELECT *, sum(opens::INT) OVER w AS contest_no FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY k)),
p AS (SELECT *, first_value(v) OVER w AS contest, row_number() OVER w - 2 AS place FROM n WHERE contest_no > 0 WINDOW w AS (PARTITION BY o_custkey, contest_no ORDER BY k)),
s AS (SELECT *, place // 4 AS row_no, CASE WHEN place % 4 = 0 THEN 'candidate' WHEN contains(v, '%') THEN 'percentage' WHEN regexp_matches(replace(v, ',', ''), '^\d+$') THEN 'votes'
    WHEN regexp_matches(lower(v), 'democratic|republican|conservative|working|families|write-in') THEN 'party' END AS kind FROM p WHERE NOT opens)
SELECT o_custkey, contest_no::BIGINT AS contest_no, contest, row_no, max(v) FILTER (WHERE kind = 'candidate') AS candidate, arg_max(v, k) FILTER (WHERE kind = 'party') AS party,
    arg_max(v, k) FILTER (WHERE kind = 'percentage') AS percentage, arg_max(v, k) FILTER (WHERE kind = 'votes') AS votes FROM s GROUP BY o_custkey, contest_no, contest, row_no"""


def delimiter_sniff(spark, sf_dir):
    (documents,) = read(spark, sf_dir, "documents")
    return documents.select("doc_id", T.delimiter(F.coalesce("text", F.lit(""))).alias("mark"))


SQL_SNIFF = r"""
WITH heads AS (SELECT doc_id, array_to_string(string_split(coalesce(text, ''), chr(10))[1:10], chr(10)) AS h FROM documents),
counts AS (SELECT doc_id, length(h) - length(replace(h, ',', '')) AS c, length(h) - length(replace(h, chr(9), '')) AS t, length(h) - length(replace(h, ';', '')) AS s, length(h) - length(replace(h, '|', '')) AS b FROM heads)
SELECT doc_id, CASE WHEN c >= greatest(t, s, b) THEN ',' WHEN t >= greatest(s, b) THEN chr(9) WHEN s >= b THEN ';' ELSE '|' END AS mark FROM counts"""


def page_hash(spark, sf_dir):
    """Pages by the digest of their markup; the first page of each."""
    (found,) = read(spark, sf_dir, "pages")
    return found.groupBy(F.sha2("html", 256).alias("hash")).agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"), F.bool_or(pages.is_captcha(F.col("html"))).alias("captcha"))


SQL_HASH = "SELECT sha256(html) AS hash, min(page_id) AS first_page, count(*) AS n, bool_or(regexp_matches(lower(html), 'captcha|are you human|checking your browser|verify you are')) AS captcha FROM pages GROUP BY 1"


def table_signature(spark, sf_dir):
    """Tables (brands) by the digest of their ordered header list; the first table of each keeps it."""
    (part,) = read(spark, sf_dir, "part")
    tables = part.groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_set("p_type")).alias("headers"))
    return tables.groupBy(T.signature(F.col("headers")).alias("signature")).agg(F.min("p_brand").alias("first_brand"), F.count(F.lit(1)).alias("n"))


SQL_SIGNATURE = """
WITH t AS (SELECT p_brand, p_size, array_to_string(list_sort(list_distinct(list(p_type))), chr(31)) AS h FROM part GROUP BY ALL)
SELECT md5(h) AS signature, min(p_brand) AS first_brand, count(*) AS n FROM t GROUP BY 1"""


def location_names(spark, sf_dir):
    """Places without the word county, file-safe, with their stamp."""
    supplier, nation = read(spark, sf_dir, "supplier", "nation")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    raw = F.concat("n_name", F.lit("  County "), (F.col("s_suppkey") % 7).cast("string"))
    return rows.groupBy(T.place(raw).alias("place"), T.file_name(F.concat("n_name", F.lit("/"), "s_nationkey")).alias("file")).agg(F.count(F.lit(1)).alias("n"))


SQL_PLACE = "SELECT lower(n_name) || ' ' || (s_suppkey % 7) AS place, n_name || '_' || s_nationkey AS file, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL"


def stamped_files(spark, sf_dir):
    (events,) = read(spark, sf_dir, "events")
    return events.groupBy(F.substring(T.stamp(F.col("ts")), 1, 11).alias("hour"), T.collapse(F.concat(F.lit(" "), F.upper("event_type"), F.lit("  Log "))).alias("name")).agg(F.count(F.lit(1)).alias("n"))


SQL_STAMP = "SELECT strftime(ts, '%Y%m%d_%H') AS hour, event_type || ' log' AS name, count(*) AS n FROM events GROUP BY ALL"

QUERIES = {
    "percent_reported": (percent_reported, SQL_PERCENT),
    "year_extract": (year_extract, SQL_YEAR),
    "emails": (emails, SQL_EMAILS),
    "urls": (urls, SQL_URLS),
    "normalize_label": (normalize_label, SQL_LABEL),
    "folded_text": (folded_text, SQL_FOLD),
    "html_text_strip": (html_text_strip, SQL_STRIP),
    "download_links": (download_links, SQL_LINKS),
    "url_host_path": (url_host_path, SQL_HOST),
    "entity_context": (entity_context, SQL_CONTEXT),
    "keyphrase_match": (keyphrase_match, SQL_KEYPHRASE),
    "regex_entities": (regex_entities, SQL_ENTITIES),
    "overlap_removal": (overlap_removal, SQL_OVERLAP),
    "flat_text_table": (flat_text_table, SQL_FLAT),
    "contest_blocks": (contest_blocks, SQL_CONTESTS),
    "text_block_rows": (text_block_rows, SQL_BLOCKS),
    "delimiter_sniff": (delimiter_sniff, SQL_SNIFF),
    "page_hash": (page_hash, SQL_HASH),
    "table_signature": (table_signature, SQL_SIGNATURE),
    "location_names": (location_names, SQL_PLACE),
    "stamped_files": (stamped_files, SQL_STAMP),
}
