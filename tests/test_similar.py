import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from tabularium.functions import names, text
from tabularium.operators import similar


def column(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def words(seed, n, longest=9):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcde é", k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("least", [0.6, 0.7, 0.8, 0.85, 1.0])
def test_no_pair_is_lost(spark, least):
    a, b = [*words(1, 150), "aaaaaaaaaaaa", "", "long " * 30], [*words(2, 120), "aaaaaaaaa", "", "lonk " * 29]
    want = {(x, y, round(SequenceMatcher(None, y, x).ratio(), 9)) for x in a for y in b if SequenceMatcher(None, y, x).ratio() >= least}
    got = similar.close_pairs(column(spark, "a", [*a, None]), "a", column(spark, "b", [*b, None]), "b", least).collect()
    assert len(got) == len(want) and {(r["a"], r["b"], round(r["score"], 9)) for r in got} == want
    known = list(dict.fromkeys(b))
    best = {(x, *get_close_matches(x, known, 1, least)) for x in set(a)} - {(x,) for x in a}
    assert {(r["a"], r["b"]) for r in similar.closest(column(spark, "a", a), "a", column(spark, "b", b), "b", least).collect()} == best
    three = {(x, y) for x in set(a) for y in get_close_matches(x, known, 3, least)}
    assert {(r["a"], r["b"]) for r in similar.closest(column(spark, "a", a), "a", column(spark, "b", b), "b", least, most=3).collect()} == three


def test_pairs_of_one_key_only(spark):
    a = spark.createDataFrame([(1, "abcd"), (2, "abcd"), (3, "abcd")], "k int, a string")
    b = spark.createDataFrame([(1, "abce"), (2, "zzzz"), (2, "abcd")], "k int, b string")
    assert {tuple(r) for r in similar.close_pairs(a, "a", b, "b", 0.7, ["k"]).collect()} == {(1, "abcd", "abce", 0.75), (2, "abcd", "abcd", 1.0)}


def test_many_known_names(spark):
    """More known names than any table of them would be broadcast for."""
    known = spark.range(30_000).select(F.concat(F.lit("name "), F.md5(F.col("id").cast("string"))).alias("b"))
    asked = spark.range(3).select(F.concat(F.lit("nome "), F.md5((F.col("id") * 7000).cast("string"))).alias("a"))
    assert {r["a"].replace("nome", "name") == r["b"] for r in similar.closest(asked, "a", known, "b", 0.9).collect()} == {True}


def test_linked_names_keep_themselves_below_the_limit(spark):
    rng = random.Random(3)
    known = ["Ann Lee", "ANN LEE", "Jo Poe", "Mary Ann", "", None]
    said = ["ann  lee", "An Lee", "Joe Poe", "mary an", "someone", None] + ["".join(rng.sample("ann leejopo", 7)) for _ in range(30)]
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    plain = lambda x: " ".join(x.lower().split())
    got = similar.linked(column(spark, "said", said), "said", column(spark, "known", known), "known", fold).collect()
    assert len(got) == len(said)
    for r in got:
        if r["said"] is None:
            assert r["entity"] is None
            continue
        scores = {k: SequenceMatcher(None, plain(k), plain(r["said"])).ratio() for k in known if k is not None}
        most = max(scores.values())
        assert r["entity"] == (min(k for k in scores if scores[k] == most) if most > 0.8 else r["said"])


def test_empty_tables(spark):
    none, some = column(spark, "a", []), column(spark, "b", ["x"])
    assert similar.close_pairs(none, "a", some, "b", 0.6).collect() == []
    assert similar.closest(some, "b", none, "a", 0.6).collect() == []
    assert [tuple(r) for r in similar.linked(some, "b", none, "a", F.lower).collect()] == [("x", "x")]


def test_every_spelling_of_a_state(spark):
    # blanks become underscores first, so the four spellings with a blank are none; one ends with another spelling
    known = [(a, n if " " not in a else "virginia" if a == "w. va." else a.replace(" ", "_")) for a, n in names.STATES.items()]
    said = known + [(a.upper(), n) for a, n in known] + [(n.replace("_", " ").title(), n) for n in names.STATE_NAMES]
    said += [("alabama and alaska", "alabama"), ("alaska and alabama", "alabama"), ("results-n.y.city", "new_york"), ("ResultsFL", "florida"), ("vote ga. x", "vote_ga._x"), ("", None), (None, None), ("nowhere else 7", "nowhere_else_7")]
    rows = spark.createDataFrame(said, "text string, state string")
    assert [tuple(r) for r in rows.withColumn("got", names.state_name(F.col("text"))).where("not got <=> state").collect()] == []


def test_keyphrases(spark):
    cases = [("Vote Method", True), ("the vote   method:  ", True), ("vote methode", True), ("method, then vote", True), ("method", False), ("x " * 500 + "vote", False), ("", False)]
    rows = spark.createDataFrame(cases, "label string, hit boolean")
    assert rows.withColumn("got", text.keyphrase(F.col("label"), "vote method")).where("got <> hit or got is null").collect() == []
