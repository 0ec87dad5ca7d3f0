"""Queries over spans: labels of headers by rules and a vocabulary, entities of texts.

The SQL finds a pattern's places as the lengths of what it matches and of what is
between, and a vocabulary's by trying every place.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions import spans

from .results import read

_PHRASES = (
    "President 2024 Votes", "Working Families write-in total", "absentee mail ballots", "Precinct 12 of the City", "subtotal overall", "50% reporting", "county and state results", "General election, special", "undervote blank",
    "Amendment 3 referendum", "Town of Orange", "on march 4, 2022", "incumbent winner loser", "Write In unopposed", "Proposition 12", "agency authority", "poll worker vote count", "nominee hopeful", "percent", "% precincts reporting",
)


def _headers(spark, sf_dir):
    """Phrases, each with a name of a nation, a region or a part behind it or within."""
    nation, region, part = read(spark, sf_dir, "nation", "region", "part")
    phrase = F.explode(F.array(*map(F.lit, _PHRASES))).alias("phrase")
    names = nation.select(F.col("n_name").alias("name")).union(region.select("r_name")).union(part.select(F.concat(F.upper("p_type"), F.lit(" "), F.lower("p_type"))).distinct())
    return names.select("name", phrase).select(F.concat("phrase", F.lit(" "), "name").alias("header"))


def header_labels(spark, sf_dir):
    nation, region, part = read(spark, sf_dir, "nation", "region", "part")
    rows = nation.select(F.lit("COUNTY").alias("label"), F.lower("n_name").alias("value")).union(region.select(F.lit("STATE"), F.initcap("r_name"))).union(part.select(F.lit("CANDIDATE"), "p_type").distinct())
    vocabulary = rows.union(spark.createDataFrame([("LOCATION", "Orange"), ("DISTRICT", "12"), ("DISTRICT", "e")], "label string, value string"))
    return spans.header_labels(_headers(spark, sf_dir), "header", vocabulary)


def _sql_spans(table: str, key: str, text: str, rules, any_case: bool) -> str:
    """SELECTs of ``key``, n (of the rule), label, start, end for each rule, from ``table``."""
    out = []
    for n, (pattern, label) in enumerate(rules):
        p = ("(?i)" if any_case else "") + pattern.replace("'", "''")
        out.append(
            f"SELECT {key}, {n} AS n, '{label}' AS label, list_transform(h, lambda x, i: list_sum(list_transform(g[1 : i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1 : i - 1], lambda y: length(y))), 0)) AS starts, h, "
            # a word ends where no letter of any alphabet follows; the engine's own border knows ASCII only
            f"list_transform(h, lambda x, i: {str(pattern.startswith(chr(92) + 'b')).lower()} AND regexp_matches(x, '^[\\p{{L}}\\p{{N}}]') AND regexp_matches(g[i][-1], '[\\p{{L}}\\p{{N}}]') AND g[i][-1] > chr(127) "
            f"OR {str(pattern.endswith(chr(92) + 'b')).lower()} AND regexp_matches(x, '[\\p{{L}}\\p{{N}}]$') AND regexp_matches(g[i + 1][1], '[\\p{{L}}\\p{{N}}]') AND g[i + 1][1] > chr(127)) AS inside "
            f"FROM (SELECT {key}, regexp_split_to_array({text}, '{p}') AS g, regexp_extract_all({text}, '{p}') AS h FROM {table}) WHERE len(h) > 0"
        )
    body = "\nUNION ALL ".join(out)
    return f"SELECT {key}, n, label, s::INTEGER AS start, (s + length(x))::INTEGER AS end_ FROM (SELECT {key}, n, label, unnest(starts) AS s, unnest(h) AS x, unnest(inside) AS wrong FROM ({body})) WHERE NOT wrong"


SQL_LABELS = f"""
WITH RECURSIVE
names AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT DISTINCT upper(p_type) || ' ' || lower(p_type) FROM part),
headers AS (SELECT DISTINCT phrase || ' ' || name AS header FROM names, (SELECT unnest([{", ".join(repr(p) for p in _PHRASES)}]) AS phrase)),
ruled AS ({_sql_spans("headers", "header", "header", spans.HEADER_RULES, True)}),
words AS (
    SELECT DISTINCT label, lower(value) AS word FROM (
        SELECT 'COUNTY' AS label, n_name AS value FROM nation UNION ALL SELECT 'STATE', r_name FROM region UNION ALL SELECT 'CANDIDATE', p_type FROM part
        UNION ALL VALUES ('LOCATION', 'Orange'), ('DISTRICT', '12'), ('DISTRICT', 'e'))),
found AS (SELECT header, label, word, i FROM (SELECT header, label, word, unnest(range(1, length(header) + 1)) AS i FROM headers, words) WHERE lower(header)[i : i + length(word) - 1] = word),
kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.header = f.header AND g.label = f.label AND g.word = f.word AND g.i < f.i AND g.i + length(g.word) > f.i))
SELECT DISTINCT header, start, end_ AS "end", label FROM ruled
UNION
SELECT header, (i - 1)::INTEGER, (i - 1 + length(word))::INTEGER, label FROM kept"""


def entity_spans(spark, sf_dir):
    """Entities of whole texts with their places, no two of a text overlapping."""
    (documents,) = read(spark, sf_dir, "documents")
    found = documents.select("doc_id", "text", F.inline(spans.entities(F.col("text"))))
    return found.select("doc_id", "start", "end", "label", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("entity"))


SQL_ENTITIES = f"""
WITH RECURSIVE
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
every AS ({_sql_spans("docs", "doc_id", "text", spans.ENTITY_RULES, False)}),
ranked AS (SELECT doc_id, list({{'start': start, 'end_': end_, 'label': label}} ORDER BY start, end_ DESC, n) AS s FROM every GROUP BY doc_id),
kept AS (
    SELECT doc_id, list_reduce(list_prepend({{'at': 0, 'out': []::STRUCT(start INTEGER, end_ INTEGER, label VARCHAR)[]}}, list_transform(s, lambda x: {{'at': 0, 'out': [x]}})), lambda a, x:
        CASE WHEN x.out[1].start >= a.at THEN {{'at': x.out[1].end_, 'out': list_concat(a.out, x.out)}} ELSE a END).out AS out FROM ranked)
SELECT k.doc_id, x.start, x.end_ AS "end", x.label, d.text[x.start + 1 : x.end_] AS entity FROM (SELECT doc_id, unnest(out) AS x FROM kept) k JOIN docs d USING (doc_id)"""


def entity_kinds(spark, sf_dir):
    """Entities of each kind and language: how many, how many different ones, in how many documents."""
    (documents,) = read(spark, sf_dir, "documents")
    found = documents.select("doc_id", "lang", "text", F.inline(spans.entities(F.col("text"))))
    name = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return found.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(name).alias("n_names"), F.count_distinct("doc_id").alias("n_documents"))


SQL_KINDS = SQL_ENTITIES.replace("\nSELECT k.doc_id", ",\nspans AS (SELECT k.doc_id", 1) + """)
SELECT lang, label, count(*) AS n, count(DISTINCT entity) AS n_names, count(DISTINCT doc_id) AS n_documents FROM spans JOIN documents USING (doc_id) GROUP BY ALL"""


QUERIES = {
    "header_labels": (header_labels, SQL_LABELS),
    "entity_spans": (entity_spans, SQL_ENTITIES),
    "entity_kinds": (entity_kinds, SQL_KINDS),
}
