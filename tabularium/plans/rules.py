"""Queries over names, titles and entries: place names, cascades of rules, validations.

Texts are made of the star schema's keys and names by a rule, so that every branch
of an operator is met; the SQL says the rule's meaning and not its construction.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions import names as N
from tabularium.functions import text as T
from tabularium.operators import structures, tables

from .results import read

_STATE_ROWS = ", ".join(f"({i}, '{a}', '{full}')" for i, (a, full) in enumerate(N.STATES.items()))


def _state_texts(spark, sf_dir):
    """Names and spellings of all states, two of them in some texts."""
    (customer,) = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    pick = lambda values, n=1: F.element_at(F.array(*map(F.lit, values)), F.pmod(k * n, F.lit(len(values))).cast("int") + 1)
    full, other, abbr = pick(N.STATE_NAMES), pick(N.STATE_NAMES, 7), pick(N.STATES)
    spaced = F.regexp_replace(full, "_", " ")
    way = F.pmod(F.floor(k / len(N.STATES)), F.lit(7))
    text = F.when(way == 0, F.upper(abbr)).when(way == 1, F.initcap(spaced)).when(way == 2, F.concat(F.lit(" Results-"), abbr, F.lit("-2024")))
    text = text.when(way == 3, F.concat(F.lit("Results "), F.initcap(spaced), F.lit(" final"))).when(way == 4, F.concat(F.lit("ResultsXX"), F.upper(abbr)))
    text = text.when(way == 5, F.concat(full, F.lit(" and "), other)).otherwise(F.concat("c_mktsegment", F.lit(" 7")))
    return customer.select("c_custkey", "c_mktsegment", text.alias("text"), way.alias("way"), spaced.alias("spaced"))


def state_names(spark, sf_dir):
    return _state_texts(spark, sf_dir).select("c_custkey", "text", N.state_name(F.col("text")).alias("state"))


_STATE_LIST = ", ".join(f"'{n}'" for n in N.STATE_NAMES)
_ABBR_LIST = ", ".join(f"'{a}'" for a in N.STATES)
_STATE_TEXTS = rf"""
states(i, abbr, name) AS (VALUES {_STATE_ROWS}),
t AS (
    SELECT c_custkey, c_mktsegment, [{_STATE_LIST}][c_custkey % {len(N.STATE_NAMES)} + 1] AS name, [{_STATE_LIST}][c_custkey * 7 % {len(N.STATE_NAMES)} + 1] AS other,
        [{_ABBR_LIST}][c_custkey % {len(N.STATES)} + 1] AS abbr, (c_custkey // {len(N.STATES)}) % 7 AS way FROM customer),
cap AS (SELECT *, array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS spaced FROM t),
texts AS (SELECT c_custkey, c_mktsegment, way, name, CASE way WHEN 0 THEN upper(abbr) WHEN 1 THEN spaced WHEN 2 THEN ' Results-' || abbr || '-2024' WHEN 3 THEN 'Results ' || spaced || ' final'
    WHEN 4 THEN 'ResultsXX' || upper(abbr) WHEN 5 THEN name || ' and ' || other ELSE c_mktsegment || ' 7' END AS text FROM cap)"""
SQL_STATES = rf"""
WITH {_STATE_TEXTS},
low AS (SELECT *, replace(lower(trim(text)), ' ', '_') AS n FROM texts),
hits AS (
    SELECT l.c_custkey, l.text, l.n, s.name, CASE WHEN l.n = s.abbr THEN 0 WHEN l.n = s.name THEN 1
        WHEN regexp_matches(l.n, '\b' || replace(s.abbr, '.', '\.') || '\b') OR regexp_matches(replace(l.n, '_', ' '), '\b' || s.name || '\b') THEN 2
        WHEN ends_with(l.n, s.abbr) THEN 3 END AS rule, s.i
    FROM low l, states s)
SELECT c_custkey, text, coalesce(arg_min(name, rule * 1000 + i) FILTER (WHERE rule IS NOT NULL), any_value(n)) AS state FROM hits GROUP BY c_custkey, text"""


def county_names(spark, sf_dir):
    supplier, nation = read(spark, sf_dir, "supplier", "nation")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    own = F.concat_ws("-", F.translate("n_name", "0123456789_", "abcdefghij-"), F.lit("Dade"))
    way = F.pmod("s_suppkey", F.lit(4))
    text = F.when(way == 0, F.concat(own, F.lit(" County"))).when(way == 1, F.concat(F.lit("results_"), own, F.lit("_county_2024"))).when(way == 2, F.concat(F.lit("12 "), own, F.lit("  7"))).otherwise(F.concat(own, F.lit("County2024")))
    return rows.select("s_suppkey", N.county_name(text).alias("county"))


SQL_COUNTIES = """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'results ' ELSE '' END || lower(replace(replace(translate(n_name, '0123456789_', 'abcdefghij-'), '-', ' '), '_', ' ')) || ' dade' AS county
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def county_matches(spark, sf_dir):
    """Suppliers of each region chosen: their county is the region, or one of its districts (nations)."""
    supplier, nation, region = read(spark, sf_dir, "supplier", "nation", "region")
    districts = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name").alias("chosen"), F.lower("n_name").alias("county"))
    own = region.select(F.lower("r_name").alias("chosen"), F.lower("r_name").alias("county"))
    odd = F.when(F.col("s_suppkey") % 5 == 0, F.lit("AMERICA")).otherwise(F.concat(F.lit("NATION_"), "s_nationkey"))
    contests = supplier.select("s_suppkey", F.lower(odd).alias("county"))
    return contests.join(districts.union(own), "county").select("chosen", "s_suppkey")


SQL_MATCHES = """
SELECT lower(r_name) AS chosen, s_suppkey FROM supplier, region
WHERE CASE WHEN s_suppkey % 5 = 0 THEN r_name = 'AMERICA' ELSE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = r_regionkey) END"""


def _titles(spark, sf_dir):
    (part,) = read(spark, sf_dir, "part")
    k = F.pmod("p_partkey", F.lit(7))
    p = F.element_at(F.array(F.lit("Democrat"), F.lit("republican"), F.lit("Libertaran"), F.lit("Grey"), F.lit("Indepndent")), F.pmod("p_partkey", F.lit(5)).cast("int") + 1)
    place = F.when(k == 0, F.concat(F.lit("DISTRICT  "), "p_size")).when(k == 1, F.concat(F.lit("Ward "), "p_size")).when(k == 2, F.concat(F.lit("Distrct "), "p_size", F.lit("B"))).otherwise(F.lit("at large"))
    return part.select("p_partkey", F.concat_ws(" ", F.lit("Council"), place, p, "p_name").alias("title"))


def district_cascade(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", N.district(F.col("title")).alias("d")).select("p_partkey", "d.*")


SQL_DISTRICT = """
SELECT p_partkey, CASE WHEN p_partkey % 7 < 3 THEN p_size::VARCHAR END AS value, [0.95, 0.85, 0.75, 0.0, 0.0, 0.0, 0.0][p_partkey % 7 + 1]::DOUBLE AS score,
    ['regex', 'number', 'fuzzy', 'regex', 'regex', 'regex', 'regex'][p_partkey % 7 + 1] AS method, CASE WHEN p_partkey % 7 < 3 THEN 'pass' ELSE 'fail' END AS result FROM part"""


def party_cascade(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", N.party(F.col("title")).alias("d")).select("p_partkey", "d.*")


SQL_PARTY = """
WITH t AS (
    SELECT p_partkey, list_concat(string_split(lower('Council ' || CASE p_partkey % 7 WHEN 0 THEN 'DISTRICT ' || p_size WHEN 1 THEN 'Ward ' || p_size WHEN 2 THEN 'Distrct ' || p_size || 'B' ELSE 'at large' END), ' '),
        string_split(lower(['Democrat', 'republican', 'Libertaran', 'Grey', 'Indepndent'][p_partkey % 5 + 1] || ' ' || p_name), ' ')) AS w,
        ['Democrat', 'republican', 'Libertaran', 'Grey', 'Indepndent'][p_partkey % 5 + 1] || ' ' || p_name AS said FROM part),
p(i, name) AS (VALUES (0, 'Democrat'), (1, 'Republican'), (2, 'Green'), (3, 'Libertarian'), (4, 'Independent')),
near AS (SELECT p_partkey, said, i, name, 1 - list_min(list_transform(w, lambda x: levenshtein(x, lower(name)))) / length(name) AS score, contains(lower(said), lower(name)) AS named FROM t, p),
best AS (SELECT p_partkey, said, bool_or(named) AS named, arg_min(name, i) FILTER (WHERE named) AS own, max(score) AS score, arg_max(name, score * 10 - i * 0.001) AS name FROM near GROUP BY ALL)
SELECT p_partkey, CASE WHEN named THEN said[strpos(lower(said), lower(own)) : strpos(lower(said), lower(own)) + length(own) - 1] WHEN score >= 0.8 THEN name END AS value,
    CASE WHEN named THEN 0.9 WHEN score >= 0.8 THEN round(score, 6) ELSE 0.0 END::DOUBLE AS score, CASE WHEN named OR score < 0.8 THEN 'regex' ELSE 'fuzzy' END AS method,
    CASE WHEN named OR score >= 0.8 THEN 'pass' ELSE 'fail' END AS result FROM best"""


def contest_fields(spark, sf_dir):
    """Title, candidates, panel, tables and districts of each contest: value, score, method and result, one row for each field."""
    orders, customer, nation = read(spark, sf_dir, "orders", "customer", "nation")
    k = F.col("c_custkey")
    said = F.element_at(F.array(F.lit("Council AREA results"), F.lit("Summary, Green Harbor Board"), F.lit("for Mill Valley Council"), F.lit("plain words"), F.lit(None), F.lit("ward 7 of Oak Party")), F.pmod(k, F.lit(6)).cast("int") + 1)
    county = F.when(k % 4 == 0, F.concat(F.lit("Zone "), "c_nationkey")).when(k % 4 == 1, F.lit("Elm Street Committee"))
    people = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("people"))
    # what is known by direct lookup: panels by nation, districts by the nation's region
    known = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("panel of "), "n_name")).alias("panel"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("region "), "n_regionkey")).alias("part"))
    rows = customer.join(people, "c_custkey", "left").join(known, "c_nationkey").select("c_custkey", said.alias("title"), county.alias("county"), "people", "panel", "part")
    title, place = F.col("title"), F.col("county")
    fields = {"title": N.given(title, "manual", "undefined"), "candidate": N.given(F.col("people"), "nlp", "nlp"), "panel": N.sought((title,), N.PANEL_WORDS, F.col("panel")), "tables": N.sought((title,), N.TABLE_WORDS, F.col("panel")), "districts": N.sought((title, place), N.DISTRICT_WORDS, F.col("part"))}
    return rows.select("c_custkey", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("v")) for f, v in fields.items()]))).select("c_custkey", "field", "v.*")


_SOUGHT = "SELECT c_custkey, '{field}' AS field, nullif(regexp_extract({text}, '(?i)({words})', 1), '') AS word, nullif(regexp_extract({text}, '({org})', 1), '') AS org, {known} AS known FROM r"
_TWO = "coalesce(nullif(regexp_extract(title, '{p}', 1), ''), nullif(regexp_extract(county, '{p}', 1), ''))"
SQL_FIELDS = rf"""
WITH p AS (SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '|') AS people FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
r AS (
    SELECT c_custkey, ['Council AREA results', 'Summary, Green Harbor Board', 'for Mill Valley Council', 'plain words', NULL, 'ward 7 of Oak Party'][c_custkey % 6 + 1] AS title,
        CASE c_custkey % 4 WHEN 0 THEN 'Zone ' || c_nationkey WHEN 1 THEN 'Elm Street Committee' END AS county, people,
        CASE WHEN n_nationkey % 2 = 0 THEN 'panel of ' || n_name END AS panel, CASE WHEN n_regionkey > 1 THEN 'region ' || n_regionkey END AS part
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN p ON o_custkey = c_custkey),
s AS (
    {_SOUGHT.format(field="panel", text="title", words="|".join(N.PANEL_WORDS), org=N.ORGANISATION, known="panel")}
    UNION ALL {_SOUGHT.format(field="tables", text="title", words="|".join(N.TABLE_WORDS), org=N.ORGANISATION, known="panel")}
    UNION ALL SELECT c_custkey, 'districts', {_TWO.format(p="(?i)(" + "|".join(N.DISTRICT_WORDS) + ")")}, {_TWO.format(p="(" + N.ORGANISATION + ")")}, part FROM r)
SELECT c_custkey, 'title' AS field, title AS value, (title IS NOT NULL)::INT::DOUBLE AS score, CASE WHEN title IS NULL THEN 'undefined' ELSE 'manual' END AS method, CASE WHEN title IS NULL THEN 'fail' ELSE 'pass' END AS result FROM r
UNION ALL SELECT c_custkey, 'candidate', people, (people IS NOT NULL)::INT::DOUBLE, 'nlp', CASE WHEN people IS NULL THEN 'fail' ELSE 'pass' END FROM r
UNION ALL SELECT c_custkey, field, coalesce(word, org, known), CASE WHEN word IS NOT NULL THEN 0.9 WHEN org IS NOT NULL THEN 0.85 WHEN known IS NOT NULL THEN 1.0 ELSE 0.0 END,
    CASE WHEN word IS NOT NULL THEN 'regex' WHEN org IS NOT NULL THEN 'entity' ELSE 'direct_lookup' END, CASE WHEN coalesce(word, org, known) IS NULL THEN 'fail' ELSE 'pass' END FROM s"""


def entry_scores(spark, sf_dir):
    """Score, likely field and notes of each entry of a correction list."""
    (orders,) = read(spark, sf_dir, "orders")
    k = F.pmod("o_orderkey", F.lit(5))
    day = F.date_format("o_orderdate", "yyyy")
    text = F.when(k == 0, F.concat(F.lit("since "), day)).when(k == 1, F.concat(F.lit("Ann Lee, no "), "o_custkey")).when(k == 2, F.lit("in texas today")).when(k == 3, F.lit("plain words")).otherwise(F.concat(F.lit("Jo Poe "), day))
    places = F.arrays_overlap(F.split(F.lower(text), r"\W+"), F.array(*[F.lit(s) for s in N.STATE_NAMES]))
    rows = orders.select("o_orderkey", text.alias("text"), places.alias("places"))
    return rows.select("o_orderkey", N.entry_score(F.col("text")).alias("score"), N.field_of(F.col("text"), F.col("places")).alias("field"), F.array_join(N.notes(F.col("text"), F.col("places")), ",").alias("notes"))


SQL_ENTRIES = """
SELECT o_orderkey, [0.4, 0.3, 0.1, 0.0, 0.5][o_orderkey % 5 + 1]::DOUBLE AS score, ['years', 'candidate', 'states', NULL, 'years'][o_orderkey % 5 + 1] AS field,
    ['date', '', 'location', 'no entities', 'date'][o_orderkey % 5 + 1] AS notes FROM orders"""


def ensured_titles(spark, sf_dir):
    customer, = read(spark, sf_dir, "customer")
    blank = lambda n, c: F.when(F.col("c_custkey") % n == 0, F.lit("  ")).otherwise(c)
    rows = customer.select("c_custkey", blank(2, F.col("c_mktsegment")).alias("title"), blank(3, F.col("c_name")).alias("name"), blank(5, F.lit("contest")).alias("contest_name"))
    return rows.select("c_custkey", F.coalesce(N.title_of("title", "name", "contest_name"), F.to_json(F.struct("title", "name"))).alias("title"))


SQL_TITLES = """
SELECT c_custkey, CASE WHEN c_custkey % 2 <> 0 THEN c_mktsegment WHEN c_custkey % 3 <> 0 THEN c_name WHEN c_custkey % 5 <> 0 THEN 'contest' ELSE '{"title":"  ","name":"  "}' END AS title FROM customer"""


def redirect_targets(spark, sf_dir):
    (pages,) = read(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url"))
    hosts = ("therin.example.net", "thther.example.org", "m.ththth.example.net", "ththre.example.com")
    return pages.select("page_id", N.redirect(url, hosts).alias("target"))


SQL_REDIRECT = """
SELECT page_id, CASE WHEN page_id % 4 <> 0 AND regexp_matches(url, '^https?://(therin.example.net|thther.example.org|m.ththth.example.net|ththre.example.com)([/?#]|$)') THEN url ELSE '/' END AS target FROM pages"""


def safe_paths(spark, sf_dir):
    """Paths behind a base folder; null where they lead out of it."""
    (line,) = read(spark, sf_dir, "lineitem")
    step = lambda n: F.element_at(F.array(F.lit(".."), F.lit("a"), F.lit("."), F.lit("b")), F.pmod(F.floor(F.col("l_partkey") / n), F.lit(4)).cast("int") + 1)
    path = F.concat(F.when(F.col("l_linenumber") == 7, "/").otherwise(""), F.array_join(F.array(step(1), step(4), step(16), step(64)), "/"))
    return line.select(path.alias("path")).distinct().select("path", N.inside("/data", F.col("path")).alias("resolved"))


SQL_PATHS = """
WITH s AS (SELECT ['..', 'a', '.', 'b'] AS w),
p AS (SELECT DISTINCT l_linenumber = 7 AS rooted, [w[l_partkey % 4 + 1], w[(l_partkey // 4) % 4 + 1], w[(l_partkey // 16) % 4 + 1], w[(l_partkey // 64) % 4 + 1]] AS p FROM lineitem, s),
d AS (SELECT rooted, p, list_transform(range(1, 5), lambda i: list_sum(list_transform(p[1:i], lambda x: CASE x WHEN '..' THEN -1 WHEN '.' THEN 0 ELSE 1 END))) AS depth FROM p),
k AS (SELECT rooted, p, list_min(depth) < 0 AS out, list_filter(list_transform(range(1, 5), lambda i: CASE WHEN p[i] IN ('a', 'b') AND coalesce(list_min(depth[i:4]) >= depth[i], true) THEN p[i] END), lambda x: x IS NOT NULL) AS kept FROM d)
SELECT CASE WHEN rooted THEN '/' ELSE '' END || array_to_string(p, '/') AS path, CASE WHEN NOT rooted AND NOT out THEN '/data/' || array_to_string(kept, '/') END AS resolved FROM k"""


def formats(spark, sf_dir):
    (pages,) = read(spark, sf_dir, "pages")
    said = F.concat("url", F.element_at(F.array(F.lit(".PDF"), F.lit(".csv"), F.lit("?as=json&pdf"), F.lit("")), F.pmod("page_id", F.lit(4)).cast("int") + 1))
    return pages.select("page_id", N.format_handler(said).alias("handler"))


SQL_FORMATS = "SELECT page_id, ['pdf', 'csv', 'json', NULL][page_id % 4 + 1] AS handler FROM pages WHERE NOT regexp_matches(url, 'json|pdf|csv')"


def entity_names(spark, sf_dir):
    """Names in canonical form, those that are a state's marked."""
    rows = _state_texts(spark, sf_dir)
    name = N.canonical(F.concat(F.lower("text"), F.lit("  of\t"), F.upper("c_mktsegment")))
    return rows.select("c_custkey", name.alias("name"), F.lower(F.regexp_replace("text", " ", "_")).isin(*N.STATE_NAMES).alias("known"))


SQL_NAMES = rf"""
WITH {_STATE_TEXTS}
SELECT c_custkey, array_to_string(list_transform(string_split(trim(regexp_replace(lower(text) || ' of ' || lower(c_mktsegment), '\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name,
    way = 1 AS known FROM texts"""


def dates_told(spark, sf_dir):
    (orders,) = read(spark, sf_dir, "orders")
    forms = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "MMMM d, yyyy")
    k = F.pmod("o_orderkey", F.lit(6))
    text = F.lit("no date")
    for i, f in enumerate(forms):
        text = F.when(k == i, F.date_format("o_orderdate", f)).otherwise(text)
    text = F.when(k == 4, F.lit("13/45/2024")).otherwise(text)
    return orders.select("o_orderkey", N.date_like(text).alias("dated"))


SQL_DATES = "SELECT o_orderkey, o_orderkey % 6 < 4 AS dated FROM orders"


def languages(spark, sf_dir):
    (documents,) = read(spark, sf_dir, "documents")
    return documents.select("doc_id", N.language(F.coalesce("text", F.lit(""))).alias("language"))


_LANGUAGE_ROWS = ", ".join(f"({i}, '{lang}', [{', '.join(repr(w) for w in own)}])" for i, (lang, own) in enumerate(sorted(N.LANGUAGE_WORDS.items())))
SQL_LANGUAGES = rf"""
WITH langs(i, lang, own) AS (VALUES {_LANGUAGE_ROWS}),
w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}]+')) AS w FROM documents),
n AS (SELECT doc_id, i, lang, len(list_intersect(w, own)) AS n FROM w, langs)
SELECT doc_id, CASE WHEN max(n) > 0 THEN arg_max(lang, n * 10 - i) ELSE 'en' END AS language FROM n GROUP BY doc_id"""


def accessors(spark, sf_dir):
    """What a library of contests offers: sorted lists of its candidates, states and years, as JSON too."""
    customer, orders = read(spark, sf_dir, "customer", "orders")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lists = rows.groupBy("o_orderpriority").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("kinds"), F.sort_array(F.collect_set("c_nationkey")).alias("states"), F.sort_array(F.collect_set(F.year("o_orderdate"))).alias("years"))
    return lists.select("o_orderpriority", F.array_join("kinds", ",").alias("kinds"), F.array_join("years", ",").alias("years"), F.to_json(F.struct("kinds", "states")).alias("json"))


SQL_ACCESSORS = """
WITH g AS (SELECT o_orderpriority, list_sort(list_distinct(list(c_mktsegment))) AS k, list_sort(list_distinct(list(c_nationkey))) AS s, list_sort(list_distinct(list(year(o_orderdate)))) AS y
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT o_orderpriority, array_to_string(k, ',') AS kinds, array_to_string(y, ',') AS years, '{"kinds":["' || array_to_string(k, '","') || '"],"states":[' || array_to_string(s, ',') || ']}' AS json FROM g"""


def likely_headers(spark, sf_dir):
    """Rows of cells with two known field names or more."""
    (part,) = read(spark, sf_dir, "part")
    word = lambda n: F.element_at(F.array(F.lit("Candidate"), F.lit("VOTES"), F.lit("percent"), F.lit("x"), F.lit("12"), F.lit("Party")), F.pmod(F.floor(F.col("p_partkey") / n), F.lit(6)).cast("int") + 1)
    return part.select("p_partkey", structures.likely_header(F.array(word(1), word(6), word(36))).alias("header"))


SQL_LIKELY = """
SELECT p_partkey, (p_partkey % 6 NOT IN (3, 4))::INT + ((p_partkey // 6) % 6 NOT IN (3, 4))::INT + ((p_partkey // 36) % 6 NOT IN (3, 4))::INT >= 2 AS header FROM part"""


def missing_columns(spark, sf_dir):
    """Required columns that a table's rows lack, by table: percent is required only where it is said to be reported."""
    (orders,) = read(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_custkey").alias("table_id"), (F.col("o_custkey") % 2 == 0).alias("reported"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("precinct"), F.when(F.col("o_orderkey") % 5 > 0, "50%").alias("percent"), F.col("o_totalprice").alias("total"),
    )
    return tables.missing_columns(rows, "table_id", {"precinct": F.lit(True), "percent": F.col("reported"), "total": F.lit(True)})


SQL_MISSING = """
SELECT o_custkey AS table_id, count(*) AS n_rows, concat_ws(',', CASE WHEN bool_or(o_orderkey % 3 = 0) THEN 'precinct' END, CASE WHEN o_custkey % 2 = 0 AND bool_or(o_orderkey % 5 = 0) THEN 'percent' END) AS missing
FROM orders GROUP BY o_custkey"""


def rescanned_headers(spark, sf_dir):
    """Headers with their scores as entries; where these are below 0.25 on average, headers become the first entity they name, and equal ones are one."""
    (part,) = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    header = F.element_at(F.array(F.col("p_name"), F.concat(F.lit("votes of Ann Lee "), "p_size"), F.lit("since 2020 Jo Poe"), F.lit("total")), F.pmod(k * k, F.lit(7)).cast("int") % 4 + 1)
    rows = part.select(F.concat_ws("/", "p_brand", F.col("p_size") % 5).alias("table_id"), "p_partkey", header.alias("header"))
    entity = F.nullif(F.regexp_extract("header", r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b", 1), F.lit(""))
    return structures.rescanned(rows, "table_id", "p_partkey", "header", N.entry_score(F.col("header")), entity, 0.25)


SQL_RESCAN = r"""
WITH h AS (SELECT p_brand || '/' || p_size % 5 AS table_id, p_partkey, [p_name, 'votes of Ann Lee ' || p_size, 'since 2020 Jo Poe', 'total'][(p_partkey * p_partkey % 7) % 4 + 1] AS header FROM part),
s AS (
    SELECT *, round(regexp_matches(header, '\b(19|20)\d\d\b|\b[A-Z][a-z]+ [A-Z][a-z]+\b')::INT * 0.2 + regexp_matches(header, '\b(19|20)\d\d\b')::INT * 0.2 + (len(string_split(header, ' ')) > 2)::INT * 0.1, 6)::DOUBLE AS score FROM h),
m AS (SELECT *, round(avg(score) OVER (PARTITION BY table_id), 6) AS mean FROM s),
n AS (SELECT *, CASE WHEN mean >= 0.25 THEN header ELSE coalesce(nullif(regexp_extract(header, '\b([A-Z][a-z]+ [A-Z][a-z]+)\b', 1), ''), header) END AS new FROM m)
SELECT table_id, p_partkey, new AS header, score, mean, mean >= 0.25 AS passed, mean >= 0.25 OR p_partkey = min(p_partkey) OVER (PARTITION BY table_id, new) AS kept FROM n"""


def suggested_corrections(spark, sf_dir):
    """Entries of a log that score below 0.7 or failed, with the field and the note that each seems to need; the ten best of each status, by score and key."""
    (orders,) = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.element_at(F.array(F.concat(F.lit("since "), F.date_format("o_orderdate", "yyyy")), F.lit("Ann Lee"), F.lit("plain words here"), F.concat(F.lit("Jo Poe "), F.date_format("o_orderdate", "yyyy"))), F.pmod(k, F.lit(4)).cast("int") + 1)
    none = F.lit(False)
    rows = orders.select("o_orderkey", "o_orderstatus", text.alias("text"), F.round(F.col("o_totalprice") / 500000, 4).alias("logged"), F.when(k % 9 == 0, "fail").otherwise("pass").alias("result"))
    rows = rows.where("logged < 0.7 or result = 'fail'").select("*", N.entry_score(F.col("text")).alias("score"), N.field_of(F.col("text"), none).alias("field"), F.array_join(N.notes(F.col("text"), none), ",").alias("notes"))
    return structures.top_n(rows, "o_orderstatus", 10, F.desc("score"), F.desc("logged"), F.col("o_orderkey"))


SQL_SUGGESTED = """
WITH r AS (
    SELECT o_orderkey, o_orderstatus, ['since ' || year(o_orderdate), 'Ann Lee', 'plain words here', 'Jo Poe ' || year(o_orderdate)][o_orderkey % 4 + 1] AS text, round(o_totalprice / 500000, 4) AS logged,
        CASE WHEN o_orderkey % 9 = 0 THEN 'fail' ELSE 'pass' END AS result, [0.4, 0.2, 0.1, 0.5][o_orderkey % 4 + 1]::DOUBLE AS score, ['years', 'candidate', NULL, 'years'][o_orderkey % 4 + 1] AS field,
        ['date', '', 'no entities', 'date'][o_orderkey % 4 + 1] AS notes FROM orders)
SELECT * FROM r WHERE logged < 0.7 OR result = 'fail' QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY score DESC, logged DESC, o_orderkey) <= 10"""


def enriched_contests(spark, sf_dir):
    """Entities, places and years named in each page's title, added to it."""
    documents, = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    every = lambda pattern: F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))), "|")
    return documents.select("doc_id", every("([A-Z][a-z]+ [A-Z][a-z]+)").alias("entities"), every("((?:19|20)[0-9]{2})").alias("years"), T.words_present(text, T.LOCATION_WORDS).alias("places"))


_PLACES = " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in T.LOCATION_WORDS)
SQL_ENRICHED = rf"""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '([A-Z][a-z]+ [A-Z][a-z]+)', 1))), '|') AS entities,
    array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '((?:19|20)[0-9]{{2}})', 1))), '|') AS years, ({_PLACES})::INTEGER AS places FROM documents"""


QUERIES = {
    "state_names": (state_names, SQL_STATES),
    "county_names": (county_names, SQL_COUNTIES),
    "county_matches": (county_matches, SQL_MATCHES),
    "district_cascade": (district_cascade, SQL_DISTRICT),
    "party_cascade": (party_cascade, SQL_PARTY),
    "contest_fields": (contest_fields, SQL_FIELDS),
    "entry_scores": (entry_scores, SQL_ENTRIES),
    "suggested_corrections": (suggested_corrections, SQL_SUGGESTED),
    "ensured_titles": (ensured_titles, SQL_TITLES),
    "redirect_targets": (redirect_targets, SQL_REDIRECT),
    "safe_paths": (safe_paths, SQL_PATHS),
    "formats": (formats, SQL_FORMATS),
    "entity_names": (entity_names, SQL_NAMES),
    "dates_told": (dates_told, SQL_DATES),
    "languages": (languages, SQL_LANGUAGES),
    "accessors": (accessors, SQL_ACCESSORS),
    "likely_headers": (likely_headers, SQL_LIKELY),
    "missing_columns": (missing_columns, SQL_MISSING),
    "rescanned_headers": (rescanned_headers, SQL_RESCAN),
    "enriched_contests": (enriched_contests, SQL_ENRICHED),
}
