"""States and counties that web addresses name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions import names as N

from . import similar

# Ends of host names and other parts that are never taken for a state.
NO_PLACES = ("com", "org", "net", "gov", "edu", "co", "us", "info", "biz", "io", "me", "ca", "uk", "de", "fr", "jp")


def states_of(urls: DataFrame, url: str, least: float = 0.8) -> DataFrame:
    """url, state of each distinct address: a state that its path names, else the one most like its first part that is like any; null if none is."""
    own = urls.select(url).where(F.col(url).isNotNull()).distinct().withColumn("_state", N.state_in_path(F.col(url)))
    parts = own.where("_state is null").select(url, F.posexplode(F.split(N.address(F.col(url)), "[/_.]")).alias("_place", "_part")).where((F.col("_part") != "") & ~F.col("_part").isin(*NO_PLACES))
    known = urls.sparkSession.createDataFrame([(x,) for x in dict.fromkeys([*N.STATES, *N.STATE_NAMES])], "_spelling string")
    near = similar.closest(parts, "_part", known, "_spelling", least)
    named = F.create_map(*[F.lit(x) for pair in N.STATES.items() for x in pair])
    found = parts.join(near, "_part").groupBy(url).agg(F.min_by("_spelling", "_place").alias("_spelling"))
    found = found.select(url, F.coalesce(F.element_at(named, F.col("_spelling")), "_spelling").alias("_near"))
    return own.join(found, url, "left").select(url, F.coalesce("_state", "_near").alias("state"))


def located(urls: DataFrame, url: str, counties: DataFrame, least: float = 0.7) -> DataFrame:
    """urls with state and county, from (state, ord, county) ``counties``.

    A county is looked for within the state: the one that stands before 'county' in the
    path, by its normalised name or else by likeness; else the first whose name the
    address contains.
    """
    known = counties.select(F.col("state"), F.col("ord"), F.col("county"), N.county_name(F.col("county")).alias("_norm"))
    places = states_of(urls, url).withColumn("_low", N.address(F.col(url)))
    said = F.regexp_extract("_low", r"/([a-z0-9_\-]+)[-_]?county", 1)
    places = places.withColumn("_said", F.when(said != "", N.county_name(said)))
    asked = places.where("state is not null")
    forms = known.groupBy("state", "_norm").agg(F.min_by("county", "ord").alias("county"))
    exact = asked.join(forms.withColumnRenamed("_norm", "_said"), ["state", "_said"]).select(url, F.col("county").alias("_exact"))
    open_ = asked.where("_said is not null").join(exact.select(url), url, "left_anti")
    near = similar.closest(open_, "_said", forms, "_norm", least, ["state"])
    alike = open_.join(near, ["state", "_said"]).join(forms, ["state", "_norm"]).select(url, F.col("county").alias("_alike"))
    rest = asked.join(exact.select(url).union(alike.select(url)), url, "left_anti")
    # the state's own counties are few; those that the address contains
    inside = rest.select(url, "state", "_low").join(known, "state").where((F.col("_norm") != "") & F.contains("_low", F.col("_norm"))).groupBy(url).agg(F.min_by("county", "ord").alias("_inside"))
    found = places.join(exact, url, "left").join(alike, url, "left").join(inside, url, "left")
    return urls.join(found.select(url, "state", N.county_name(F.coalesce("_exact", "_alike", "_inside")).alias("county")), url, "left")
