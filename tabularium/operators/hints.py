"""A store of hints (fragment -> module) with history: upsert, edit, remove, import, export, undo, rollback.

Every change writes the whole new state as a version of its own, and one row of a log:
step, action, depth (how many versions the history has after it), version.  Undo and
rollback write a log row alone, with a smaller depth.  The history at depth j is the last
version pushed to that depth, and the current state the one at the last step's depth; so
nothing is ever rewritten, and what was there before any step can be read again.  A log row
is a folder named by its step, written only if it is not there: of two writers at a time
one gets an error and has changed nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HINTS = "fragment string, module string"
_LOG = "step long, action string, depth long, version long"


class HintStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def log(self) -> DataFrame:
        """step, action, depth, version of all steps."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).option("recursiveFileLookup", "true").parquet(f"{self.folder}/log")

    def history(self) -> DataFrame:
        """place (from 0), version, step, action of the versions that undo and rollback can reach, the current one last."""
        log = self.log()
        last = log.agg(F.max_by("depth", "step").alias("now"))
        pushed = log.where("version is not null").groupBy("depth").agg(F.max(F.struct("step", "version", "action")).alias("s"))
        return pushed.join(F.broadcast(last), F.col("depth") <= F.col("now")).select((F.col("depth") - 1).alias("place"), "s.version", "s.step", "s.action")

    def _state(self) -> tuple[int, int, int | None]:
        """Last step, depth, current version."""
        last = self.log().agg(F.max("step"), F.max_by("depth", "step")).first()
        if last[0] is None:
            return 0, 0, None
        now = self.history().where(F.col("place") == last[1] - 1).first()
        return last[0], last[1], now["version"] if now else None

    def version(self, number: int | None) -> DataFrame:
        """The hints of one version; none has no hints."""
        return self.spark.createDataFrame([], _HINTS) if number is None else self.spark.read.schema(_HINTS).parquet(f"{self.folder}/versions/{number:09d}")

    def current(self) -> DataFrame:
        return self.version(self._state()[2])

    def _write(self, action: str, step: int, depth: int, version: int | None) -> None:
        self.spark.createDataFrame([(step, action, depth, version)], _LOG).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/log/{step:09d}")

    def _push(self, action: str, change) -> None:
        step, depth, version = self._state()
        change(self.version(version)).write.mode("overwrite").parquet(f"{self.folder}/versions/{step + 1:09d}")
        self._write(action, step + 1, depth + 1, step + 1)

    @staticmethod
    def _clean(hints: DataFrame) -> DataFrame:
        """Trimmed; of rows with one fragment the greatest module; blank ones go."""
        rows = hints.select(F.trim("fragment").alias("fragment"), F.trim("module").alias("module")).where("fragment <> '' and module <> ''")
        return rows.groupBy("fragment").agg(F.max("module").alias("module"))

    def upsert(self, hints: DataFrame, action: str = "upsert") -> None:
        """Adds hints (fragment, module) and replaces those there are."""
        new = self._clean(hints)
        self._push(action, lambda old: old.join(new, "fragment", "left_anti").unionByName(new))

    def edit(self, hints: DataFrame) -> None:
        """Replaces the modules of fragments that are there; others are ignored."""
        new = self._clean(hints).withColumnRenamed("module", "_new")
        self._push("edit", lambda old: old.join(new, "fragment", "left").select("fragment", F.coalesce("_new", "module").alias("module")))

    def remove(self, fragments: DataFrame) -> None:
        self._push("remove", lambda old: old.join(fragments.select("fragment").distinct(), "fragment", "left_anti"))

    def import_csv(self, path: str) -> None:
        """Rows of a CSV file with a header and two columns; those with blanks are ignored."""
        self.upsert(self.spark.read.csv(path, header=True, schema=_HINTS, enforceSchema=True, mode="DROPMALFORMED"), "import")

    def export_csv(self, path: str) -> None:
        self.current().select(F.col("fragment").alias("URL Fragment"), F.col("module").alias("Module Path")).write.mode("overwrite").csv(path, header=True)

    def undo(self) -> bool:
        """Back to the version before; False, and no step, if there is none."""
        step, depth, _ = self._state()
        if depth < 2:
            return False
        self._write("undo", step + 1, depth - 1, None)
        return True

    def rollback(self, place: int) -> bool:
        """Back to a version of the history; later ones leave it.  False, and no step, for a place that it lacks."""
        step, depth, _ = self._state()
        if not 0 <= place < depth:
            return False
        self._write("rollback", step + 1, place + 1, None)
        return True
