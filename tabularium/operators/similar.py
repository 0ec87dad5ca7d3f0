"""Close matches of names: an index of character bags, then the exact ratio.

The measure is the share of characters in matching blocks, 2 * matched / (length +
length).  It is at most the same figure of the two bags of characters, so names at least
``least`` alike share that many characters, counted: of the rarer characters of either
name, enough that the rest cannot do, one is common.  Both sides are listed under those
(an inverted index of prefixes, "third e" being another entry than "first e"), meet by
equality, and are held against bounds by length and by whole bags.  Only what passes is
compared exactly, so no pair is lost, no side has a limit, and no side is broadcast
because of its name.  A pair is met under its first common entry alone.

Names are compared as they are; callers fold them.  Nulls match nothing; two empty names
are alike.  Equal scores: the greatest name, in code-point order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.fuzzy import ratio


def bag(text: Column) -> Column:
    """The characters of a text, numbered among equal ones, highest numbers first: '00002e', '00001z', '00001e'."""
    letters = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.sort_array(F.transform(letters, lambda c, i: F.concat(F.lpad((i + 2 - F.array_position(letters, c)).cast("string"), 5, "0"), c)), asc=False)


def _listed(rows: DataFrame, by: Sequence[str], name: str, side: str, least: float) -> DataFrame:
    """by, name, bag and one row for each entry of the bag's prefix; an empty name has one entry."""
    bags = rows.select(*by, F.col(name).alias(side)).where(F.col(side).isNotNull()).distinct().withColumn(f"{side}_bag", bag(F.col(side)))
    size = F.size(f"{side}_bag")
    # a partner is at least share * size long, so at least that many characters are common
    share = least / (2 - least)
    shared = F.ceil(F.round(size * share, 9)).cast("int")
    prefix = F.slice(f"{side}_bag", F.lit(1), F.greatest(size - F.greatest(shared, F.lit(1)) + 1, F.lit(1)))
    return bags.withColumn("_entry", F.explode(F.when(size == 0, F.array(F.lit(""))).otherwise(prefix)))


def close_pairs(names: DataFrame, name: str, known: DataFrame, target: str, least: float, by: Sequence[str] = ()) -> DataFrame:
    """by, name, target, score: all pairs of distinct values with a ratio of at least ``least``, equal in the columns ``by``."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    left, right = _listed(names, by, name, "_a", least), _listed(known, by, target, "_b", least)
    if name in by or target in by:
        raise ValueError("a name is no key")
    met = left.join(right, [*by, "_entry"])
    a, b = F.size("_a_bag"), F.size("_b_bag")
    common = F.array_intersect("_a_bag", "_b_bag")
    first = F.coalesce(F.get(common, F.lit(0)), F.lit(""))
    met = met.where(2 * F.least(a, b) >= F.lit(least - 1e-9) * (a + b)).where((F.col("_entry") == first) & (2 * F.size(common) >= F.lit(least - 1e-9) * (a + b)))
    scored = met.select(*by, F.col("_a").alias(name), F.col("_b").alias(target), ratio(F.col("_b"), F.col("_a")).alias("score"))
    return scored.where(F.col("score") >= least)


def closest(names: DataFrame, name: str, known: DataFrame, target: str, least: float = 0.6, by: Sequence[str] = (), most: int = 1) -> DataFrame:
    """by, name, target, score: for each distinct name its ``most`` closest known ones, if any reach ``least``."""
    pairs = close_pairs(names, name, known, target, least, by)
    if most == 1:
        best = pairs.groupBy(*by, name).agg(F.max(F.struct("score", target)).alias("_best"))
        return best.select(*by, name, f"_best.{target}", "_best.score")
    ranked = pairs.groupBy(*by, name).agg(F.slice(F.sort_array(F.collect_list(F.struct("score", target)), asc=False), 1, most).alias("_best"))
    return ranked.select(*by, name, F.inline("_best")).select(*by, name, target, "score")


def linked(rows: DataFrame, name: str, known: DataFrame, target: str, fold, least: float = 0.8) -> DataFrame:
    """rows with ``entity``: the known name most like ``name`` where the ratio of their folded forms exceeds ``least``, else ``name`` itself.

    Of known names equally like it, or alike when folded, the least.
    """
    own = rows.select(F.col(name).alias("_said")).distinct().withColumn("_name", fold(F.col("_said")))
    forms = known.select(F.col(target).alias("_entity")).where(F.col(target).isNotNull()).distinct().withColumn("_form", fold(F.col("_entity")))
    pairs = close_pairs(own, "_name", forms, "_form", math.nextafter(least, 2))
    best = pairs.join(forms.groupBy("_form").agg(F.min("_entity").alias("_entity")), "_form").groupBy("_name").agg(F.min_by("_entity", F.struct(-F.col("score"), "_entity")).alias("_entity"))
    found = own.join(best, "_name").select("_said", "_entity")
    return rows.join(found, rows[name] == found["_said"], "left").withColumn("entity", F.coalesce("_entity", name)).drop("_said", "_entity")


def same_word(word: Column, text: Column, least: float = 0.7) -> Column:
    """Whether the word is in the text, or the two are alike; whatever the case."""
    word, text = F.lower(word), F.lower(text)
    return F.contains(text, word) | (ratio(word, text) >= least)


def best_header(headers: DataFrame, table: str, order: str, name: str, keywords: Sequence[str], least: float = 0.7) -> DataFrame:
    """The header of each table that contains the first possible keyword, the earliest of several; in a table without one, the header most like the first keyword that any is like.

    Returns the columns of ``headers``, and method: 'contains' or 'similar'.
    """
    low = F.lower(name)
    rest = F.struct(*[c for c in headers.columns if c != table])
    rank = F.coalesce(*[F.when(F.contains(low, F.lit(k)), i) for i, k in enumerate(keywords)])
    best = headers.withColumn("_rank", rank).where("_rank is not null").groupBy(table).agg(F.min_by(rest, F.struct("_rank", order)).alias("_r"))
    found = best.select(table, "_r.*", F.lit("contains").alias("method"))
    open_ = headers.join(best.select(table), table, "left_anti").withColumn("_low", low)
    words = F.array(*[F.struct(F.lit(i).alias("_rank"), F.lit(k).alias("_word")) for i, k in enumerate(keywords)])
    asked = open_.select(table).distinct().select(table, F.inline(words))
    near = closest(asked, "_word", open_, "_low", least, [table]).join(asked, [table, "_word"])
    near = near.groupBy(table).agg(F.min_by("_low", "_rank").alias("_low"))
    similar = open_.join(near, [table, "_low"]).groupBy(table).agg(F.min_by(rest, F.col(order)).alias("_r"))
    return found.union(similar.select(table, "_r.*", F.lit("similar").alias("method"))).select(*headers.columns, "method")


def guessed_title(headers: DataFrame, table: str, order: str, name: str, titles: DataFrame, title: str, least: float = 0.7) -> DataFrame:
    """table, header, title, score: the first header of each table that is like a known title, and the title most like it."""
    near = closest(headers, name, titles, title, least)
    rows = headers.select(table, order, name).join(near, name)
    return rows.groupBy(table).agg(F.min_by(F.struct(F.col(name).alias("header"), title, "score"), F.col(order)).alias("_r")).select(table, "_r.*")


def routed_handlers(rows: DataFrame, state: str, county: str, handlers: DataFrame, districts: DataFrame, least: float = 0.6) -> DataFrame:
    """rows with handler_state, handler_county and rule, from (state, county; county null for the state's own) ``handlers`` and (district, county) ``districts``.

    A state is the handler of that name, else the most similar one.  A county is the
    state's handler of that name, else the county of a district of that name, whichever
    the state (the least), else the most similar of the state's.  rule: 'county',
    'district', 'similar', 'state', or 'none' without a state.
    """
    states = handlers.select(F.col("state").alias("_known")).distinct()
    typed = rows.select(F.col(state).alias("_state")).where(F.col(state).isNotNull()).distinct()
    exact = typed.join(states, F.col("_state") == F.col("_known"), "left")
    missed = closest(exact.where("_known is null"), "_state", states, "_known", least)
    placed = exact.where("_known is not null").select("_state", "_known").union(missed.select("_state", "_known"))
    out = rows.join(placed, rows[state] == placed["_state"], "left").withColumnRenamed("_known", "handler_state").drop("_state")

    own = handlers.where("county is not null").select(F.col("state").alias("handler_state"), F.col("county").alias("_own"))
    parts = districts.groupBy(F.col("district").alias("_typed")).agg(F.min("county").alias("_of"))
    asked = out.select("handler_state", F.col(county).alias("_typed")).where(F.col("handler_state").isNotNull() & F.col(county).isNotNull()).distinct()
    named = asked.join(own, (asked["handler_state"] == own["handler_state"]) & (asked["_typed"] == own["_own"]), "left").select(asked["handler_state"], "_typed", "_own")
    named = named.join(parts, "_typed", "left")
    similar = closest(named.where("_own is null and _of is null"), "_typed", own, "_own", least, ["handler_state"]).select("handler_state", "_typed", F.col("_own").alias("_like"))
    told = named.join(similar, ["handler_state", "_typed"], "left").withColumnRenamed("handler_state", "_in")
    out = out.join(told, (out["handler_state"] == told["_in"]) & (out[county] == told["_typed"]), "left")
    rule = F.when(F.col("handler_state").isNull(), "none").when(F.col("_own").isNotNull(), "county").when(F.col("_of").isNotNull(), "district").when(F.col("_like").isNotNull(), "similar").otherwise("state")
    return out.withColumn("handler_county", F.coalesce("_own", "_of", "_like")).withColumn("rule", rule).drop("_in", "_typed", "_own", "_of", "_like")
