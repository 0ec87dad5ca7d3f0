"""Page scan with a store of what pages hold, addressed by content.

A page's digest is that of its markup.  A scan parses each digest that no earlier run has
stored, once, whichever pages have it; runs are folders of their own: segments first, then
an index of the digests, so a run that breaks off before its index is there has stored
nothing.  Two runs at a time may parse a digest both; readers take the first run's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.session import cut, new_path

from . import pages as P

_INDEX = "digest string, run string, n_segments long"


#: A task of a scan parses about this many characters of markup, of this many pages at most: the number of tasks grows with the input, and no task does.
TASK_CHARS, TASK_PAGES = 16_000_000, 100_000
#: So many pages may be held beside the segments of all, if the planner thinks so.
FEW_PAGES = 50_000
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def _small_batches(spark: SparkSession):
    """While markup is parsed, a batch of it is a few megabytes, however many or long its pages."""
    before = {name: spark.conf.get(name) for name in _BATCHES}
    for name, value in _BATCHES.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each digest's first row: rows alike in digest and page are of one task."""
    seen: set[bytes] = set()

    def new(batch):
        for digest in map(bytes.fromhex, batch.column("page_id").to_pylist()):
            yield digest not in seen
            seen.add(digest)

    return P._segments(b.filter(pa.array(new(b), pa.bool_())) for b in batches)


class PageStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def index(self) -> DataFrame:
        """digest, run, n_segments of every digest stored."""
        if not self._exists("index"):
            return self.spark.createDataFrame([], _INDEX)
        found = self.spark.read.schema(_INDEX).parquet(f"{self.folder}/index")
        return found.groupBy("digest").agg(F.min("run").alias("run"), F.min_by("n_segments", "run").alias("n_segments"))

    def scan(self, pages: DataFrame) -> DataFrame:
        """Stores what is new of pages (page_id, html); returns page_id, digest of all.  ``parsed`` has how many digests this run parsed."""
        markup = pages.select("page_id", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
        # pages are made twice: here, and where they are parsed
        sized = cut(markup.select("page_id", "digest", F.length("html").alias("_chars")), "told")
        told = sized.select("page_id", "digest")
        page = F.coalesce(F.col("page_id").cast("long"), F.lit(-1))
        known = self.index().select("digest")
        first = known.isEmpty()
        # one page of each digest is parsed: copies of a page are as many tasks' work as other pages
        fresh = sized.groupBy("digest").agg(F.min(page).alias("_page"))
        if not first:
            fresh = cut(fresh.join(known, "digest", "left_anti"), "fresh")
            if fresh.isEmpty():
                self.parsed = 0
                return told
        n, chars = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("_chars"), F.lit(0))).first()
        tasks = max(self.spark.sparkContext.defaultParallelism, chars // TASK_CHARS + 1, n // TASK_PAGES + 1)
        # markup streams past the digests and is not sorted
        dealt = lambda df: df.repartition(tasks, "digest", "_page")
        mine = dealt(markup.select("digest", page.alias("_page"), "html")).join(dealt(fresh.select("digest", "_page")).hint("shuffle_hash"), ["digest", "_page"], "left_semi")
        run = uuid.uuid4().hex
        walked = mine.select(F.col("digest").alias("page_id"), "html").mapInArrow(_once, P.SEGMENT.replace("page_id long", "page_id string")).withColumnRenamed("page_id", "digest")
        with _small_batches(self.spark):
            walked.write.parquet(f"{self.folder}/segments/run={run}")
        stored = self.spark.read.parquet(f"{self.folder}/segments/run={run}").groupBy("digest").agg(F.count(F.lit(1)).alias("n_segments"))
        # a page without a segment is stored as well; the index is as many tasks' work as it needs
        rows = fresh.select("digest").join(stored, "digest", "left").select("digest", F.lit(run).alias("run"), F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"))
        rows.write.mode("append").parquet(f"{self.folder}/index")
        self.parsed = self.spark.read.schema(_INDEX).parquet(f"{self.folder}/index").where(F.col("run") == run).count()
        return told

    def segments(self, pages: DataFrame) -> DataFrame:
        """Segments of pages, as ``sources.pages.segments`` returns them, read from the store; what is new is parsed first."""
        told = self.scan(pages)
        if not self._exists("segments"):
            return P.segments(pages)
        columns = [x.split()[0] for x in P.SEGMENT.split(", ")]
        kept = self.spark.read.schema(P.SEGMENT.replace("page_id long", "digest string") + ", run string").parquet(f"{self.folder}/segments")
        where = told.join(self.index().where("n_segments > 0").select("digest", "run"), "digest")
        if told.count() > FEW_PAGES:
            # segments stream past the pages and are not sorted
            where = where.hint("shuffle_hash")
        return kept.join(where, ["digest", "run"]).select(columns)


_stores: dict[str, PageStore] = {}


def stored(spark: SparkSession) -> PageStore:
    """The session's store, in the shared folder."""
    name = spark.sparkContext.applicationId
    if name not in _stores:
        _stores[name] = PageStore(spark, new_path(spark, "pages"))
    return _stores[name]


def segments(pages: DataFrame) -> DataFrame:
    """Segments of pages by way of the session's store: each markup is walked once, however many questions are asked of it."""
    return stored(pages.sparkSession).segments(pages)
