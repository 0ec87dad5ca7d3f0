"""Extractors that are registered by name: each a table function over a page, with columns by argument.

An extractor is a function (html, *columns) that yields dicts.  Registered, it is a Python
table function: Spark asks it for its columns once, when a query is analysed, and calls it
for each page in the executors.  Rows of several extractors are united by name; a page on
which one fails gives one row with its error, and neither the other pages nor the other
extractors notice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tabularium.session import ship_package

Extractor = Callable[..., Iterator[dict]]
REGISTRY: dict[str, Extractor] = {}


def extractor(name: str) -> Callable[[Extractor], Extractor]:
    """Registers a function under a name; a second one of the same name takes its place."""

    def keep(run: Extractor) -> Extractor:
        REGISTRY[name] = run
        return run

    return keep


def _table_function(run: Extractor):
    class Extract:
        @staticmethod
        def analyze(html: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
            if columns.value is None:
                raise ValueError("the columns have to be constant")
            fields = [T.StructField("row_no", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in columns.value.split(",")], T.StructField("error", T.StringType())]
            return AnalyzeResult(T.StructType(fields))

        def eval(self, html: str, columns: str):
            names = columns.split(",")
            try:
                rows = [(n, *[None if row.get(c) is None else str(row[c]) for c in names], None) for n, row in enumerate(run(html or "", *names))]
            except Exception as e:  # an extractor's fault is a row of the result
                rows = [(None, *[None] * len(names), f"{type(e).__name__}: {e}")]
            yield from rows

    return udtf(Extract)


def extracted(spark: SparkSession, pages: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """plugin, page_id, row_no, the columns of all extractors wanted (null where one has none of that name), error."""
    ship_package(spark)
    missing = sorted(set(wanted) - set(REGISTRY))
    if missing:
        raise KeyError(f"no extractor is registered as {', '.join(missing)}")
    out = None
    rows = pages.select("page_id", F.col("html").cast("string").alias("html"))
    for name, columns in wanted.items():
        function = _table_function(REGISTRY[name])
        made = rows.lateralJoin(function(F.col("html").outer(), F.lit(",".join(columns)))).select(F.lit(name).alias("plugin"), "page_id", "row_no", *columns, "error")
        out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    return out
