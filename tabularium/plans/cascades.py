"""Queries whose rules end with a close match: handlers, headers, titles, entities, words, elements, addresses.

Texts are names of the star schema, misspelt by a rule.  The SQL compares all pairs and
says the ratio in full: the longest common block of a pair (the first of several), then
those of what is left on either side of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions import names as N
from tabularium.functions import text as T
from tabularium.operators import places, review, similar, structures
from tabularium.operators.lookup import scored

from .results import read

#: ``ratios`` (a, b, score) of the rows of ``pairs`` (a, b): a the known name, b the one looked for.
RATIO = """
told_pairs AS (SELECT DISTINCT a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL),
runs AS (
    SELECT a, b, i, j, list_max(list_filter(range(1, least(length(a) - i, length(b) - j) + 2), lambda k: a[i : i + k - 1] = b[j : j + k - 1])) AS n
    FROM (SELECT a, b, i, unnest(range(1, length(b) + 1)) AS j FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM told_pairs)) WHERE a[i] = b[j]),
blocks(a, b, i1, i2, j1, j2, m) AS (
    SELECT a, b, 1::BIGINT, length(a) + 1, 1::BIGINT, length(b) + 1, 0::BIGINT FROM told_pairs
    UNION ALL
    SELECT a, b, x.i1, x.i2, x.j1, x.j2, x.m FROM (
        SELECT a, b, unnest([
            {'i1': i1, 'i2': -t.i, 'j1': j1, 'j2': -t.j, 'm': t.n},
            {'i1': -t.i + t.n, 'i2': i2, 'j1': -t.j + t.n, 'j2': j2, 'm': 0::BIGINT}]) AS x
        FROM (
            SELECT s.a, s.b, s.i1, s.i2, s.j1, s.j2, max({'n': least(r.n, s.i2 - r.i, s.j2 - r.j), 'i': -r.i, 'j': -r.j}) AS t
            FROM blocks s JOIN runs r ON r.a = s.a AND r.b = s.b AND r.i >= s.i1 AND r.i < s.i2 AND r.j >= s.j1 AND r.j < s.j2 GROUP BY ALL))),
ratios AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * sum(m) / (length(a) + length(b)) END::DOUBLE AS score FROM blocks GROUP BY a, b)"""


def _pick(k, *options):
    """One of the options, by the remainder of k."""
    return F.element_at(F.array(*options), F.pmod(k, F.lit(len(options))).cast("int") + 1)


def handler_routing(spark, sf_dir):
    """Handler of each supplier's typed state and county: by name, by district, by likeness, or the state's own."""
    supplier, nation, region = read(spark, sf_dir, "supplier", "nation", "region")
    k = F.col("s_suppkey")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    low, own = F.lower("r_name"), F.lower("n_name")
    state = _pick(k, low, low, F.translate(low, "ai", "ey"), F.concat(low, F.lit("n")), F.lit("zzz"), F.lit(None))
    county = _pick(F.floor(k / 6), own, F.concat(F.lit("district "), "s_nationkey"), F.translate(own, "ti", "dy"), F.concat(F.lit("n"), own, F.lit("x")), F.lit("elsewhere"), F.lit(None))
    handlers = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name").alias("state"), F.lower("n_name").alias("county"))
    districts = nation.select(F.concat(F.lit("district "), "n_nationkey").alias("district"), F.lower("n_name").alias("county"))
    return similar.routed_handlers(rows.select("s_suppkey", state.alias("state"), county.alias("county")), "state", "county", handlers, districts)


SQL_ROUTING = f"""
WITH RECURSIVE
rows AS (
    SELECT s_suppkey, [lower(r_name), lower(r_name), translate(lower(r_name), 'ai', 'ey'), lower(r_name) || 'n', 'zzz', NULL][s_suppkey % 6 + 1] AS state,
        [lower(n_name), 'district ' || s_nationkey, translate(lower(n_name), 'ti', 'dy'), 'n' || lower(n_name) || 'x', 'elsewhere', NULL][(s_suppkey // 6) % 6 + 1] AS county
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
handlers AS (SELECT lower(r_name) AS state, lower(n_name) AS county, 'district ' || n_nationkey AS district FROM nation JOIN region ON n_regionkey = r_regionkey),
pairs AS (SELECT h.state AS a, r.state AS b FROM handlers h, rows r UNION SELECT h.county, r.county FROM handlers h, rows r),
{RATIO},
states AS (SELECT b, max({{'same': a = b, 'score': score, 'a': a}}).a AS s FROM ratios JOIN (SELECT DISTINCT state AS a FROM handlers) USING (a) WHERE score >= 0.6 GROUP BY b),
placed AS (SELECT r.*, s.s AS handler_state FROM rows r LEFT JOIN states s ON s.b = r.state),
told AS (
    SELECT p.*, (SELECT h.county FROM handlers h WHERE h.state = handler_state AND h.county = p.county) AS own,
        (SELECT h.county FROM handlers h WHERE h.district = p.county AND handler_state IS NOT NULL) AS part,
        (SELECT max({{'score': score, 'a': a}}).a FROM ratios JOIN handlers h ON h.county = a WHERE h.state = handler_state AND b = p.county AND score >= 0.6) AS alike
    FROM placed p)
SELECT s_suppkey, state, county, handler_state, coalesce(own, part, alike) AS handler_county,
    CASE WHEN handler_state IS NULL THEN 'none' WHEN own IS NOT NULL THEN 'county' WHEN part IS NOT NULL THEN 'district' WHEN alike IS NOT NULL THEN 'similar' ELSE 'state' END AS rule
FROM told"""


def best_headers(spark, sf_dir):
    """Of the headers of each brand and size, the one with the first of the keywords, else the one most like the first that any is like."""
    (part,) = read(spark, sf_dir, "part")
    thing = F.element_at(F.split("p_name", " "), 2)
    header = _pick(F.col("p_partkey"), thing, F.concat(F.upper(F.translate(thing, "ig", "ye")), F.lit("s")), F.col("p_type"))
    headers = part.select(F.concat_ws("/", "p_brand", "p_size").alias("table_id"), "p_partkey", header.alias("header"))
    return similar.best_header(headers, "table_id", "p_partkey", "header", ("ring", "widget", "gizmo", "gear"))


SQL_BEST = f"""
WITH RECURSIVE
headers AS (
    SELECT p_brand || '/' || p_size AS table_id, p_partkey, [split_part(p_name, ' ', 2), upper(translate(split_part(p_name, ' ', 2), 'ig', 'ye')) || 's', p_type][p_partkey % 3 + 1] AS header FROM part),
words(rank, word) AS (VALUES (0, 'ring'), (1, 'widget'), (2, 'gizmo'), (3, 'gear')),
pairs AS (SELECT lower(header) AS a, word AS b FROM headers, words),
{RATIO},
first AS (
    SELECT table_id, p_partkey, header, 'contains' AS method FROM headers JOIN words ON contains(lower(header), word)
    QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY rank, p_partkey) = 1)
SELECT * FROM first
UNION ALL
SELECT table_id, p_partkey, header, 'similar' FROM headers JOIN ratios ON a = lower(header) JOIN words ON word = b
WHERE score >= 0.7 AND table_id NOT IN (SELECT table_id FROM first)
QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY rank, score DESC, a DESC, p_partkey) = 1"""


def guessed_titles(spark, sf_dir):
    """The contest title that the headers of each customer's table tell: headers are misspelt titles or none."""
    orders, part = read(spark, sf_dir, "orders", "part")
    k = F.col("o_orderkey")
    header = _pick(k, F.lit("Votes"), F.translate(F.lower("o_orderpriority"), "ieu", "yao"), F.concat(F.lit("Total "), "o_orderstatus"), F.concat(F.substring("o_orderpriority", 3, 20), F.lit(" contest")))
    headers = orders.select((k % 500).alias("table_id"), "o_orderkey", header.alias("header"))
    titles = orders.select(F.concat(F.lower("o_orderpriority"), F.lit(" ")).alias("title")).union(part.select(F.concat("p_type", F.lit(" contest")))).distinct()
    return similar.guessed_title(headers, "table_id", "o_orderkey", "header", titles, "title")


SQL_GUESSED = f"""
WITH RECURSIVE
headers AS (
    SELECT o_orderkey % 500 AS table_id, o_orderkey, ['Votes', translate(lower(o_orderpriority), 'ieu', 'yao'), 'Total ' || o_orderstatus, substr(o_orderpriority, 3, 20) || ' contest'][o_orderkey % 4 + 1] AS header FROM orders),
titles AS (SELECT lower(o_orderpriority) || ' ' AS a FROM orders UNION SELECT p_type || ' contest' FROM part),
pairs AS (SELECT a, header AS b FROM titles, headers),
{RATIO},
best AS (SELECT b, max({{'score': score, 'title': a}}) AS t FROM ratios WHERE score >= 0.7 GROUP BY b)
SELECT table_id, header, t.title AS title, t.score AS score FROM headers JOIN best ON b = header QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY o_orderkey) = 1"""


def entity_links(spark, sf_dir):
    """Candidates' names as typed, linked to known ones: over .8 alike without regard to case and blanks, else as typed."""
    (part,) = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    typed = _pick(k, F.initcap("p_name"), F.concat(F.lit("  "), F.upper(F.translate("p_name", "g", "j"))), F.translate("p_name", "aeiou", "eioua"), F.concat("p_name", F.lit(" Jr")), F.col("p_type"))
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return similar.linked(part.select("p_partkey", typed.alias("typed")), "typed", part.select("p_name"), "p_name", fold)


SQL_LINKS = f"""
WITH RECURSIVE
rows AS (
    SELECT p_partkey, [array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' '), '  ' || upper(translate(p_name, 'g', 'j')), translate(p_name, 'aeiou', 'eioua'), p_name || ' Jr', p_type][p_partkey % 5 + 1] AS typed
    FROM part),
pairs AS (SELECT p_name AS a, trim(lower(typed)) AS b FROM (SELECT DISTINCT p_name FROM part), (SELECT DISTINCT typed FROM rows)),
{RATIO},
best AS (SELECT b, min({{'score': -score, 'a': a}}).a AS entity FROM ratios WHERE score > 0.8 GROUP BY b)
SELECT p_partkey, typed, coalesce(entity, typed) AS entity FROM rows LEFT JOIN best ON b = trim(lower(typed))"""


def words_alike(spark, sf_dir):
    """Whether a header tells a place: contains a word for one, or is like one (.7)."""
    (part,) = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    typed = _pick(k, F.lit("Precnt"), F.lit("Wards"), F.lit("Muncipal"), F.col("p_type"), F.lit("voting distrct"), F.lit("Orangetown"), F.lit("Cty"))
    rows = part.select(F.concat(typed, F.when(k % 2 == 0, F.lit(" 1")).otherwise(F.lit(""))).alias("header")).distinct()
    asked = rows.select("header", F.explode(F.array(*map(F.lit, T.LOCATION_WORDS))).alias("word"))
    return asked.select("header", "word", similar.same_word(F.col("word"), F.col("header")).alias("alike")).groupBy("header").agg(F.bool_or("alike").alias("place"), F.count_if("alike").alias("n_words"))


SQL_WORDS = f"""
WITH RECURSIVE
rows AS (SELECT DISTINCT ['Precnt', 'Wards', 'Muncipal', p_type, 'voting distrct', 'Orangetown', 'Cty'][p_partkey % 7 + 1] || CASE WHEN p_partkey % 2 = 0 THEN ' 1' ELSE '' END AS header FROM part),
pairs AS (SELECT word AS a, lower(header) AS b, header FROM rows, (SELECT unnest([{", ".join(repr(w) for w in T.LOCATION_WORDS)}]) AS word)),
{RATIO}
SELECT header, bool_or(contains(p.b, p.a) OR score >= 0.7) AS place, count(*) FILTER (WHERE contains(p.b, p.a) OR score >= 0.7) AS n_words FROM pairs p JOIN ratios r ON r.a = p.a AND r.b = p.b GROUP BY header"""


def toggle_scores(spark, sf_dir):
    """The three best elements of each page: 10 for a text like a keyword (.6), 5 for the contest's title, 2 for being visible and enabled."""
    (events,) = read(spark, sf_dir, "events")
    k = F.col("event_id")
    text = _pick(k, F.col("event_type"), F.concat(F.initcap("event_type"), F.lit(" all")), F.translate("event_type", "ei", "ay"))
    rows = events.select((F.col("user_id") % 30).alias("page"), "event_id", F.lower(text).alias("text"), (F.col("value") > 15).alias("visible"), (k % 4 != 0).alias("enabled"))
    keywords = spark.createDataFrame([("clicks",), ("viewing",)], "keyword string")
    near = similar.closest(rows, "text", keywords, "keyword", 0.6).select("text", F.lit(True).alias("near"))
    found = scored(rows.join(near, "text", "left"), [(10.0, F.col("near")), (5.0, F.contains("text", F.lit("sign"))), (2.0, F.col("visible") & F.col("enabled"))])
    return structures.top_n(found, "page", 3, F.desc("score"), F.col("event_id")).select("page", "event_id", "text", "score")


SQL_TOGGLE = f"""
WITH RECURSIVE
rows AS (
    SELECT user_id % 30 AS page, event_id, lower([event_type, upper(event_type[1]) || event_type[2:] || ' all', translate(event_type, 'ei', 'ay')][event_id % 3 + 1]) AS text, value > 15 AND event_id % 4 <> 0 AS seen FROM events),
pairs AS (SELECT a, text AS b FROM rows, (VALUES ('clicks'), ('viewing')) AS w(a)),
{RATIO},
near AS (SELECT DISTINCT b FROM ratios WHERE score >= 0.6)
SELECT page, event_id, text, (10 * (b IS NOT NULL)::INT + 5 * contains(text, 'sign')::INT + 2 * coalesce(seen, false)::INT)::DOUBLE AS score FROM rows LEFT JOIN near ON b = text
QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, event_id) <= 3"""


def keyphrases(spark, sf_dir):
    """Labels with the phrase at their end, like it, or with two of its words; and how many documents end with a phrase of theirs."""
    (part,) = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    label = _pick(k, F.lit("Choose vote method"), F.lit("Vote  Method: "), F.lit("vota methods"), F.col("p_name"), F.lit("a method to vote"), F.lit("method"))
    rows = part.select("p_partkey", F.concat(label, F.when(k % 5 == 0, F.lit(" 2")).otherwise(F.lit(""))).alias("label"))
    return rows.select("p_partkey", "label", T.keyphrase(F.col("label"), "Vote Method").alias("hit"))


SQL_KEYPHRASES = f"""
WITH RECURSIVE
rows AS (
    SELECT p_partkey, ['Choose vote method', 'Vote  Method: ', 'vota methods', p_name, 'a method to vote', 'method'][p_partkey % 6 + 1] || CASE WHEN p_partkey % 5 = 0 THEN ' 2' ELSE '' END AS label FROM part),
pairs AS (SELECT trim(lower(label)) AS a, 'vote method' AS b FROM rows),
{RATIO}
SELECT p_partkey, label, regexp_matches(a, 'vote\\s+method[\\s:]*$') OR score >= 0.8 OR (contains(a, 'vote') AND contains(a, 'method')) AS hit FROM rows JOIN ratios ON a = trim(lower(label))"""


def located_urls(spark, sf_dir):
    """State and county of addresses: of the given pages, and of ones that name states and counties in every way."""
    customer, pages = read(spark, sf_dir, "customer", "pages")
    k = F.col("c_custkey")
    state, abbr = _pick(k, *map(F.lit, N.STATE_NAMES)), _pick(k, *map(F.lit, N.STATES))
    spelled = _pick(F.floor(k / 7), F.concat(F.lit("/"), abbr), F.concat(F.lit("/"), F.regexp_replace(state, "_", "-"), F.lit("-results")), F.concat(F.lit("/x/"), F.translate(state, "ae", "ea"), F.lit("s")), F.concat(F.lit("/"), F.initcap(state)), F.lit(""))
    county = _pick(F.floor(k / 3), F.lit("/fair-oak-county"), F.lit("/fairoax_county/2"), F.lit("/mill"), F.lit("/stone_county"), F.lit(""))
    made = customer.select(F.concat(F.lit("https://vote.example.gov"), spelled, county, F.lit("/"), (k % 3).cast("string")).alias("url"))
    rows = made.union(pages.select("url")).distinct()
    counties = spark.createDataFrame([(s, i, c) for s in N.STATE_NAMES for i, c in enumerate(("Mill", "Fair Oak County", "Stone"))], "state string, ord int, county string")
    return places.located(rows, "url", counties)


_NAMES = ", ".join(f"'{s}'" for s in N.STATE_NAMES)
_SPELLINGS = ", ".join(f"({i}, '{a}', '{n}')" for i, (a, n) in enumerate(N.STATES.items()))
_ABBRS = ", ".join(f"'{a}'" for a in N.STATES)
SQL_LOCATED = rf"""
WITH RECURSIVE
spellings(i, abbr, name) AS (VALUES {_SPELLINGS}),
c AS (SELECT c_custkey AS k, [{_NAMES}][c_custkey % {len(N.STATE_NAMES)} + 1] AS state, [{_ABBRS}][c_custkey % {len(N.STATES)} + 1] AS abbr FROM customer),
urls AS (
    SELECT 'https://vote.example.gov' || ['/' || abbr, '/' || replace(state, '_', '-') || '-results', '/x/' || translate(state, 'ae', 'ea') || 's', '/' || upper(state[1]) || state[2:], ''][(k // 7) % 5 + 1]
        || ['/fair-oak-county', '/fairoax_county/2', '/mill', '/stone_county', ''][(k // 3) % 5 + 1] || '/' || k % 3 AS url FROM c
    UNION SELECT url FROM pages),
low AS (SELECT url, regexp_replace(lower(url), '[- ]', '_', 'g') AS low, string_split(regexp_replace(lower(url), '[- ]', '_', 'g'), '/')[2:] AS steps FROM urls WHERE url IS NOT NULL),
named AS (
    SELECT url, arg_min(name, i) AS state FROM low, spellings
    WHERE len(list_filter(steps, lambda x: x = abbr OR starts_with(x, abbr || '_') OR x = name OR starts_with(x, name || '_'))) > 0 GROUP BY url),
parts AS (
    SELECT url, generate_subscripts(p, 1) AS place, unnest(p) AS part
    FROM (SELECT url, regexp_split_to_array(low, '[/_.]') AS p FROM low WHERE url NOT IN (SELECT url FROM named))),
asked AS (SELECT url, place, part FROM parts WHERE part <> '' AND part NOT IN ('com', 'org', 'net', 'gov', 'edu', 'co', 'us', 'info', 'biz', 'io', 'me', 'ca', 'uk', 'de', 'fr', 'jp')),
said AS (SELECT url, regexp_replace(regexp_replace(nullif(regexp_extract(low, '/([a-z0-9_\-]+)[-_]?county', 1), ''), '_', ' ', 'g'), '^[^a-z]+|[^a-z]+$', '', 'g') AS said FROM low),
counties(ord, county, norm) AS (VALUES (0, 'Mill', 'mill'), (1, 'Fair Oak County', 'fair oak'), (2, 'Stone', 'stone')),
pairs AS (SELECT s AS a, part AS b FROM (SELECT DISTINCT part FROM asked), (SELECT abbr AS s FROM spellings UNION SELECT name FROM spellings) UNION SELECT norm, said FROM counties, said),
{RATIO},
likest AS (SELECT b, max({{'score': score, 'a': a}}).a AS a FROM ratios WHERE score >= 0.8 AND a IN (SELECT abbr FROM spellings UNION SELECT name FROM spellings) GROUP BY b),
near AS (SELECT url, arg_min(a, place) AS a FROM asked JOIN likest ON b = part GROUP BY url),
states AS (SELECT l.url, l.low, coalesce(n.state, (SELECT name FROM spellings WHERE abbr = r.a), r.a) AS state FROM low l LEFT JOIN named n ON n.url = l.url LEFT JOIN near r ON r.url = l.url),
alike AS (SELECT b, max({{'score': score, 'a': a}}).a AS norm FROM ratios WHERE score >= 0.7 AND a IN (SELECT norm FROM counties) GROUP BY b)
SELECT t.url, state, CASE WHEN state IS NOT NULL THEN coalesce((SELECT norm FROM counties WHERE norm = said), alike.norm, (SELECT arg_min(norm, ord) FROM counties WHERE contains(low, norm))) END AS county
FROM states t JOIN said USING (url) LEFT JOIN alike ON alike.b = said"""


def reviewed_segments(spark, sf_dir):
    """Segments by markup and pattern after a table of corrections: one by one, by likeness over .9, by pattern, removed."""
    (part,) = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    html = F.concat(F.lit("<div><b>"), "p_name", F.lit("</b><i>"), k % 3, F.lit("</i></div>"))
    entries = part.select(k.alias("id"), html.alias("html"), F.col("p_type").alias("label"), F.col("p_brand").alias("pattern_id"))
    corrections = part.where("p_partkey % 40 = 7").select((k * 7919 % 100_003).alias("seq"), k.alias("id"), _pick(F.floor(k / 40), F.lit("edit"), F.lit("edit_similar"), F.lit("edit_pattern"), F.lit("remove")).alias("action"), F.concat(F.lit("label "), k).alias("label"))
    return review.reviewed_segments(entries, corrections)


SQL_SEGMENTS = f"""
WITH RECURSIVE
e AS (SELECT p_partkey AS id, '<div><b>' || p_name || '</b><i>' || p_partkey % 3 || '</i></div>' AS html, p_type AS label, p_brand AS pattern_id FROM part),
c AS (SELECT id, html, pattern_id, id * 7919 % 100003 AS seq, ['edit', 'edit_similar', 'edit_pattern', 'remove'][(id // 40) % 4 + 1] AS action, 'label ' || id AS new FROM e WHERE id % 40 = 7),
pairs AS (SELECT DISTINCT e.html AS a, c.html AS b FROM e, c WHERE action = 'edit_similar'),
{RATIO},
told AS (
    SELECT id, seq, new FROM c WHERE action <> 'remove'
    UNION ALL SELECT e.id, seq, new FROM c JOIN e USING (pattern_id) WHERE action = 'edit_pattern'
    UNION ALL SELECT e.id, seq, new FROM c JOIN ratios ON b = c.html JOIN e ON e.html = a WHERE action = 'edit_similar' AND score > 0.9),
last AS (SELECT id, arg_max(new, seq) AS new FROM told GROUP BY id)
SELECT id, html, coalesce(new, label) AS label, pattern_id FROM e LEFT JOIN last USING (id) WHERE id NOT IN (SELECT id FROM c WHERE action = 'remove')"""


def merged_patterns(spark, sf_dir):
    """A pattern for each part, after a review that edits, removes and merges them, chains included."""
    (part,) = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    features = F.create_map(F.lit("brand"), "p_brand", F.concat(F.lit("size "), k % 3), F.col("p_size").cast("string"))
    patterns = part.select(k.alias("pattern_id"), F.when(k % 17 > 0, F.col("p_type")).alias("label"), features.alias("features"))
    target = F.floor(k / 60) * 60 + (k * 31 + 7) % 60
    changes = part.where("p_partkey % 8 <> 3").select((k * 7919 % 1_000_003).alias("seq"), k.alias("pattern_id"), _pick(k, F.lit("merge"), F.lit("merge"), F.lit("merge"), F.lit("edit"), F.lit("remove")).alias("action"), F.concat(F.lit("label "), k).alias("label"), target.alias("target"))
    return review.merged_patterns(patterns, changes).select("pattern_id", "label", F.array_join(F.transform(F.array_sort(F.map_entries("features")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ").alias("features"))


SQL_MERGED = """
WITH RECURSIVE
p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 17 > 0 THEN p_type END AS label, p_brand AS brand, 'size ' || p_partkey % 3 AS k, p_size::VARCHAR AS v FROM part),
c AS (SELECT id, id * 7919 % 1000003 AS seq, ['merge', 'merge', 'merge', 'edit', 'remove'][id % 5 + 1] AS action, id // 60 * 60 + (id * 31 + 7) % 60 AS target FROM p WHERE id % 8 <> 3),
going AS (SELECT id, seq, CASE WHEN action = 'merge' AND target <> id THEN 'merge' ELSE 'remove' END AS action FROM c WHERE action = 'remove' OR action = 'merge' AND target IN (SELECT id FROM p)),
e AS (SELECT c.id, c.seq, c.target, g.action AS before FROM c LEFT JOIN going g ON g.id = c.target AND g.seq < c.seq WHERE c.action = 'merge' AND c.target <> c.id AND c.target IN (SELECT id FROM p)),
holds(id, ok) AS (
    SELECT id, before IS NULL FROM e WHERE before IS NULL OR before = 'remove'
    UNION ALL SELECT e.id, NOT ok FROM e JOIN holds h ON h.id = e.target WHERE e.before = 'merge'),
valid AS (SELECT * FROM e WHERE id IN (SELECT id FROM holds WHERE ok)),
way(id, root, path) AS (SELECT id, id, []::BIGINT[] FROM p UNION ALL SELECT w.id, v.target, list_prepend(v.seq, w.path) FROM way w JOIN valid v ON v.id = w.root),
ends AS (SELECT * FROM way WHERE root NOT IN (SELECT id FROM valid)),
labels AS (
    SELECT root, arg_max(label, path) AS label FROM (SELECT root, label, path FROM ends JOIN p USING (id) WHERE label IS NOT NULL UNION ALL SELECT id, 'label ' || id, [seq] FROM c WHERE action = 'edit') GROUP BY root),
told AS (
    SELECT root, k, arg_max(v, path) AS v FROM (SELECT root, 'brand' AS k, brand AS v, path FROM ends JOIN p USING (id) UNION ALL SELECT root, k, v, path FROM ends JOIN p USING (id)) GROUP BY root, k)
SELECT root AS pattern_id, any_value(label) AS label, string_agg(k || '=' || v, ', ' ORDER BY k) AS features FROM told LEFT JOIN labels USING (root)
WHERE root NOT IN (SELECT id FROM going WHERE action = 'remove') GROUP BY root"""


QUERIES = {
    "merged_patterns": (merged_patterns, SQL_MERGED),
    "reviewed_segments": (reviewed_segments, SQL_SEGMENTS),
    "handler_routing": (handler_routing, SQL_ROUTING),
    "best_headers": (best_headers, SQL_BEST),
    "guessed_titles": (guessed_titles, SQL_GUESSED),
    "entity_links": (entity_links, SQL_LINKS),
    "words_alike": (words_alike, SQL_WORDS),
    "toggle_scores": (toggle_scores, SQL_TOGGLE),
    "keyphrases": (keyphrases, SQL_KEYPHRASES),
    "located_urls": (located_urls, SQL_LOCATED),
}
