"""Queries over integrity rules, outliers and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions import text as T
from tabularium.operators import integrity

from .results import read


def _contests(spark, sf_dir):
    """Orders as contests: some without a year or a place, many repeated."""
    orders, customer, nation = read(spark, sf_dir, "orders", "customer", "nation")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    return rows.select(
        k.alias("id"),
        F.concat(F.lit(" "), "o_orderpriority", F.when(k % 13 == 0, F.lit(" sample")).otherwise(F.lit(""))).alias("title"),
        F.when(k % 7 != 0, F.date_format("o_orderdate", "yyyy")).alias("year"),
        F.when(k % 5 != 0, F.col("n_name")).alias("state"),
        F.when(k % 10 != 0, F.col("c_mktsegment")).alias("county"),
        F.col("o_orderstatus").alias("type"),
        (F.col("o_totalprice") - 2000).alias("votes"),
    )


_SQL = """
contests AS (SELECT o_orderkey AS id, ' ' || o_orderpriority || CASE WHEN o_orderkey % 13 = 0 THEN ' sample' ELSE '' END AS title,
    CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y') END AS year, CASE WHEN o_orderkey % 5 <> 0 THEN n_name END AS state,
    CASE WHEN o_orderkey % 10 <> 0 THEN c_mktsegment END AS county, o_orderstatus AS type, o_totalprice - 2000 AS votes
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def integrity_issues(spark, sf_dir):
    return integrity.issues(_contests(spark, sf_dir), "id", "title", "year", "state", "county", "id")


SQL_ISSUES = f"""WITH {_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(title)), year, state, county ORDER BY id) AS n FROM contests)
SELECT id, 'duplicate' AS issue FROM n WHERE n > 1
UNION ALL SELECT id, 'missing_location' FROM n WHERE state IS NULL AND county IS NULL
UNION ALL SELECT id, 'missing_year' FROM n WHERE year IS NULL"""


def cross_field(spark, sf_dir):
    return integrity.cross_field(_contests(spark, sf_dir), "id", {"wrong_place": (F.col("type") == "F") & ~F.coalesce("state", F.lit("")).isin("NATION_1", "NATION_2"), "negative_votes": F.col("votes") < 0})


SQL_CROSS = f"""WITH {_SQL}
SELECT id, 'wrong_place' AS issue FROM contests WHERE type = 'F' AND coalesce(state, '') NOT IN ('NATION_1', 'NATION_2')
UNION ALL SELECT id, 'negative_votes' FROM contests WHERE votes < 0"""


def zscore_outliers(spark, sf_dir):
    (events,) = read(spark, sf_dir, "events")
    return integrity.z_outliers(events.select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "event_type", "value", F.round("z", 4).alias("z"))


SQL_Z = """
WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_id, event_type, value, round((value - m) / s, 4) AS z FROM events JOIN s USING (event_type) WHERE s > 0 AND abs((value - m) / s) > 3"""


def contamination_tune(spark, sf_dir):
    """The share of events whose distance from their kind's mean is in the upper tenth."""
    (events,) = read(spark, sf_dir, "events")
    means = events.groupBy("event_type").agg(F.avg("value").alias("m"))
    return integrity.contamination(events.join(means, "event_type").select(F.round(F.abs(F.col("value") - F.col("m")), 6).alias("score")), "score")


SQL_CONTAMINATION = """
WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1),
s AS (SELECT round(abs(value - m), 6) AS score FROM events JOIN m USING (event_type)),
c AS (SELECT quantile_cont(score, 0.9) AS cut FROM s)
SELECT greatest(0.01, least(0.2, round(avg((score >= cut)::INT), 6)))::DOUBLE AS contamination FROM s, c"""


def suspicious_flags(spark, sf_dir):
    return integrity.suspicious(_contests(spark, sf_dir), "id", "title", "state", "county")


SQL_SUSPICIOUS = f"""WITH {_SQL}, r AS (SELECT id, concat_ws(',', CASE WHEN state IS NULL THEN 'no state' END, CASE WHEN county IS NULL THEN 'no county' END, CASE WHEN title LIKE '%sample%' THEN 'noise' END) AS reasons FROM contests)
SELECT * FROM r WHERE reasons <> ''"""


def entity_label_counts(spark, sf_dir):
    """How many texts of each language show each kind of mark."""
    (documents,) = read(spark, sf_dir, "documents")
    marks = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "number": "[0-9]{3,}", "name": "[A-Z][a-z]+ [A-Z][a-z]+", "money": "[$€]"}
    labels = F.array_compact(F.array(*[F.when(F.regexp_like("text", F.lit(p)), n) for n, p in marks.items()]))
    return integrity.counts_by(documents.select("lang", F.explode(labels).alias("label")), "lang", "label")


SQL_COUNTS = " UNION ALL ".join(
    f"SELECT lang, '{n}' AS label, count(*) AS n FROM documents WHERE regexp_matches(text, '{p}') GROUP BY lang"
    for n, p in {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "number": "[0-9]{3,}", "name": "[A-Z][a-z]+ [A-Z][a-z]+", "money": "[$€]"}.items()
)


def run_summary(spark, sf_dir):
    """Users by the status of their last event."""
    (events,) = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 30, "success").when(F.col("value") > 10, "partial").otherwise("fail")
    return integrity.run_summary(events.withColumn("status", status), "user_id", "status", "event_id")


SQL_SUMMARY = """
WITH l AS (SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN value > 30 THEN 'success' WHEN value > 10 THEN 'partial' ELSE 'fail' END AS s FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT count(*) AS processed, count(*) FILTER (WHERE s = 'success') AS success, count(*) FILTER (WHERE s = 'partial') AS "partial", count(*) FILTER (WHERE s = 'fail') AS fail, count(*) FILTER (WHERE s = 'error') AS error FROM l"""


def top_classes(spark, sf_dir):
    """The ten most frequent classes of tags in all pages."""
    (found,) = read(spark, sf_dir, "pages")
    names = F.flatten(F.transform(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), 1), lambda x: F.split(x, " ")))
    return integrity.top_counts(found.select(F.explode(names).alias("name")), "name", 10)


SQL_CLASSES = """
SELECT name, count(*) AS n FROM (SELECT unnest(string_split(c, ' ')) AS name FROM (SELECT unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS c FROM pages)) GROUP BY name ORDER BY n DESC, name LIMIT 10"""


def approved_patterns(spark, sf_dir):
    """Patterns (part brands and types) seen twice and more, with their successes and last use."""
    line, part = read(spark, sf_dir, "lineitem", "part")
    log = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("successes"), F.max("l_shipdate").alias("last_used"))
    return log.where("n >= 2")


SQL_PATTERNS = "SELECT p_brand, p_type, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS successes, max(l_shipdate) AS last_used FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) >= 2"


def date_anomalies(spark, sf_dir):
    """Contests none of whose dates holds the year of their title."""
    line, orders = read(spark, sf_dir, "lineitem", "orders")
    dates = line.groupBy("l_orderkey").agg(F.bool_or(F.year("l_shipdate") == F.lit(1999)).alias("seen"))
    rows = orders.where(T.year(F.date_format("o_orderdate", "'held' yyyy")) == 1999)
    return rows.join(dates, F.col("o_orderkey") == F.col("l_orderkey"), "left").where("not coalesce(seen, false)").select("o_orderkey")


SQL_DATES = "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1999 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE year(l_shipdate) = 1999)"

QUERIES = {
    "integrity_issues": (integrity_issues, SQL_ISSUES),
    "cross_field": (cross_field, SQL_CROSS),
    "zscore_outliers": (zscore_outliers, SQL_Z),
    "contamination_tune": (contamination_tune, SQL_CONTAMINATION),
    "suspicious_flags": (suspicious_flags, SQL_SUSPICIOUS),
    "entity_label_counts": (entity_label_counts, SQL_COUNTS),
    "run_summary": (run_summary, SQL_SUMMARY),
    "top_classes": (top_classes, SQL_CLASSES),
    "approved_patterns": (approved_patterns, SQL_PATTERNS),
    "date_anomalies": (date_anomalies, SQL_DATES),
}
