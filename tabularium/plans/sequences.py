"""Queries whose answer depends on order: labels carried forward, latest rows, merged neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.operators import ordered, tables

from .results import read


def nearest_preceding_label(spark, sf_dir):
    """Every purchase with the kind of the last other event of its user."""
    (events,) = read(spark, sf_dir, "events")
    label = F.when(F.col("event_type") != "purchase", F.concat_ws(":", "event_type", "event_id"))
    return ordered.nearest_before(events, ["user_id"], "event_id", label, "label").where("event_type = 'purchase'").select("event_id", "user_id", "label")


SQL_NEAREST = """
SELECT event_id, user_id, label FROM (
    SELECT *, last_value(CASE WHEN event_type <> 'purchase' THEN event_type || ':' || event_id END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS label FROM events)
WHERE event_type = 'purchase'"""


def heading_carry_forward(spark, sf_dir):
    """Turns with the last user turn up to each."""
    (turns,) = read(spark, sf_dir, "conversations")
    return ordered.carried(turns, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "asked_at").select("conv_id", "turn", "role", "asked_at")


SQL_CARRY = "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_at FROM conversations"


def title_within_window(spark, sf_dir):
    """The first big event within five events of each error, per user."""
    (events,) = read(spark, sf_dir, "events")
    near = ordered.within(events, ["user_id"], "event_id", F.when(F.col("value") > 40, F.col("event_id")), "title", 5)
    return near.where("event_type = 'error'").select("event_id", "title")


SQL_WITHIN = """
SELECT event_id, title FROM (SELECT event_id, event_type, first_value(CASE WHEN value > 40 THEN event_id END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS title FROM events) WHERE event_type = 'error'"""


def lead_row_merge(spark, sf_dir):
    """Lines of an order in which a name alone is the second half of the line before."""
    (line,) = read(spark, sf_dir, "lineitem")
    lone = F.col("l_linenumber") % 3 == 0
    rows = line.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_quantity").cast("bigint").cast("string").alias("q"))
    rows = rows.select("l_orderkey", F.col("l_linenumber").alias("ord"), F.concat(F.lit("c"), F.col("p").cast("string")).alias("candidate"), F.when(lone, "").otherwise(F.col("q")).alias("votes"))
    return tables.merge_next_rows(rows, ["l_orderkey"], "ord", "candidate", ["votes"])


SQL_LEAD = """
WITH r AS (SELECT l_orderkey, l_linenumber AS ord, 'c' || min(l_partkey) AS candidate, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE max(l_quantity)::BIGINT::VARCHAR END AS votes FROM lineitem GROUP BY l_orderkey, l_linenumber),
n AS (SELECT *, lag(votes) OVER w AS above, lead(votes) OVER w AS below, lead(candidate) OVER w AS next FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY ord)),
-- two lone lines never meet but after a missing one: of such a pair behind a full line the first is the half
p AS (SELECT *, votes = '' AS lone, sum((votes <> '')::INT) OVER (PARTITION BY l_orderkey ORDER BY ord) AS run FROM n),
q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, run ORDER BY ord) AS place FROM p),
h AS (SELECT *, lone AND place % 2 = 0 AS half FROM q),
m AS (SELECT *, lead(half) OVER (PARTITION BY l_orderkey ORDER BY ord) AS next_half FROM h)
SELECT l_orderkey, ord, CASE WHEN next_half THEN candidate || ' (' || next || ')' ELSE candidate END AS candidate, votes FROM m WHERE NOT half"""


def latest_wins_upsert(spark, sf_dir):
    """The status of each user after all changes: the last event stays."""
    (events,) = read(spark, sf_dir, "events")
    rows = events.select(F.col("user_id"), F.col("event_id").alias("ord"), "event_type", "value")
    return ordered.upsert(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1"), ["user_id"], "ord")


SQL_UPSERT = "SELECT user_id, event_id AS ord, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def keep_last_n(spark, sf_dir):
    (orders,) = read(spark, sf_dir, "orders")
    return ordered.keep_last(orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey").desc(), 5)


SQL_KEEP = "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5"


def dedupe_first(spark, sf_dir):
    """The first order of each customer and status."""
    (orders,) = read(spark, sf_dir, "orders")
    return tables.first_rows(orders.select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderstatus"], "o_orderkey")


SQL_FIRST = "SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1"


def repeat_flags(spark, sf_dir):
    """Second and later events of a user and kind."""
    (events,) = read(spark, sf_dir, "events")
    return ordered.nth_occurrence(events, [F.col("user_id"), F.col("event_type")], "event_id").where("nth > 1").select("event_id", "nth")


SQL_REPEAT = "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INTEGER AS nth FROM events QUALIFY nth > 1"


def adjusted_thresholds(spark, sf_dir):
    (events,) = read(spark, sf_dir, "events")
    return ordered.adjusted_threshold(events.withColumn("accepted", F.col("event_type").isin("click", "view", "purchase")), "user_id", "event_id", "accepted")


SQL_THRESHOLD = """
WITH last AS (SELECT user_id, event_type IN ('click', 'view', 'purchase') AS ok FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5)
SELECT user_id, sum(ok::INT)::BIGINT AS accepted, (CASE WHEN sum(ok::INT) >= 4 THEN 0.87 WHEN sum(ok::INT) <= 2 THEN 0.80 ELSE 0.85 END)::DOUBLE AS threshold FROM last GROUP BY user_id"""

QUERIES = {
    "nearest_preceding_label": (nearest_preceding_label, SQL_NEAREST),
    "heading_carry_forward": (heading_carry_forward, SQL_CARRY),
    "title_within_window": (title_within_window, SQL_WITHIN),
    "lead_row_merge": (lead_row_merge, SQL_LEAD),
    "latest_wins_upsert": (latest_wins_upsert, SQL_UPSERT),
    "keep_last_n": (keep_last_n, SQL_KEEP),
    "dedupe_first": (dedupe_first, SQL_FIRST),
    "repeat_flags": (repeat_flags, SQL_REPEAT),
    "adjusted_thresholds": (adjusted_thresholds, SQL_THRESHOLD),
}
