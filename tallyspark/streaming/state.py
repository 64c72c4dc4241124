"""Streaming forms of the stateful operators: trace logs and rollups, and keyed memory merged by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.operators.entities import merged_memory
from tallyspark.operators.facts import first_in


def trace_windows(steps: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of trace steps by event-time window and state. Later rows than the watermark are dropped, so state stays bounded."""
    return steps.withWatermark("ts", late).groupBy(F.window("ts", window), "state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))


class KeyedState:
    """Keyed rows in buckets below path, merged batch by batch.

    A batch rewrites only the buckets that hold its keys, as files of a new version; then a manifest says which version each bucket
    has, and only a manifest written whole counts, so readers see a batch entirely or not at all. The merge is a union of sets and the
    latest time, so a replayed batch and batches out of order give the same rows. Versions that none of the last `keep`
    manifests names are deleted. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], lists: list[str], buckets: int = 64, keep: int = 2) -> None:
        self.spark, self.path, self.keys, self.lists, self.buckets, self.keep = spark, path, keys, lists, buckets, keep

    def _folder(self, path: str) -> tuple:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _numbers(self, name: str) -> list[int]:
        """The numbers of the folders name-<number> below path, smallest first."""
        system, target = self._folder(self.path)
        names = [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []
        return sorted(int(n[len(name) + 1 :]) for n in names if n.startswith(f"{name}-") and n[len(name) + 1 :].isdigit())

    def _whole(self, path: str) -> bool:
        system, target = self._folder(f"{path}/_SUCCESS")
        return system.exists(target)

    def _manifests(self) -> list[int]:
        return [n for n in self._numbers("manifest") if self._whole(f"{self.path}/manifest-{n}")]

    def places(self, manifest: int) -> dict[int, int]:
        """bucket -> version; a row for each bucket."""
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.path}/manifest-{manifest}").collect()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, places: dict[int, int], schema: StructType) -> DataFrame:
        held = [f"{self.path}/version-{v}/bucket={b}" for b, v in sorted(places.items())]
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    def read(self, schema: StructType) -> DataFrame:
        """All rows of the newest whole manifest, in the columns of schema."""
        found = self._manifests()
        return self._rows(self.places(found[-1]) if found else {}, schema)

    def merge(self, batch: DataFrame) -> list[int]:
        """Merge a batch (keys, lists, last_updated) and return the buckets that were rewritten."""
        columns = [*self.keys, *self.lists, "last_updated"]
        batch = batch.select(*columns)
        touched = sorted(r["b"] for r in batch.select(self._bucket().alias("b")).distinct().collect())
        if not touched:
            return []
        manifests = self._manifests()
        before = self.places(manifests[-1]) if manifests else {}
        number = max([*self._numbers("manifest"), *self._numbers("version"), 0]) + 1
        held = self._rows({b: v for b, v in before.items() if b in touched}, batch.schema)
        merged = merged_memory(held, batch, self.keys, self.lists).withColumn("bucket", self._bucket())
        merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/version-{number}")
        after = {**before, **{b: number for b in touched}}
        self.spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1).write.parquet(f"{self.path}/manifest-{number}")
        self._prune([*manifests, number])
        return touched

    def _prune(self, manifests: list[int]) -> None:
        kept = manifests[-self.keep :]
        named = {v for m in kept for v in self.places(m).values()}
        for name, numbers, needed in (("manifest", self._numbers("manifest"), set(kept)), ("version", self._numbers("version"), named)):
            for n in numbers:
                if n not in needed:
                    system, target = self._folder(f"{self.path}/{name}-{n}")
                    system.delete(target, True)


def memory_sink(path: str, keys: list[str], lists: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each micro-batch into the KeyedState below path."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        KeyedState(batch.sparkSession, path, keys, lists, buckets).merge(batch)

    return merge


STEP = "run string, pos long, state string, ts timestamp, failed boolean, summary string, error string, status string, loop_iterations int"


def failure_step(step: DataFrame, error: Column, summary: str = "Run failed.") -> DataFrame:
    """Steps (run, pos, state, ts) as failures: marked failed, with the error's text."""
    return step.select("run", "pos", "state", "ts", F.lit(True).alias("failed"), F.lit(summary).alias("summary"), error.cast("string").alias("error"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("loop_iterations"))


def final_steps(steps: DataFrame) -> DataFrame:
    """The terminal row of each run: status failed if any step failed, else completed, and the number of its loop steps (state rewrite)."""
    last = steps.groupBy("run").agg((F.max("pos") + 1).alias("pos"), F.max("ts").alias("ts"), F.bool_or(F.coalesce("failed", F.lit(False))).alias("any"), F.count_if(F.col("state") == "rewrite").cast("int").alias("loops"))
    return last.select("run", "pos", F.lit("final").alias("state"), "ts", F.lit(False).alias("failed"), F.lit("Run ended.").alias("summary"), F.lit(None).cast("string").alias("error"), F.when(F.col("any"), "failed").otherwise("completed").alias("status"), F.col("loops").alias("loop_iterations"))


def trace_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends steps (STEP; missing columns read as null) to the log below path.

    A batch is a partition of the log and overwrites itself alone, so a replay adds no row.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        names = {c.split(" ")[0]: c.split(" ")[1] for c in STEP.split(", ")}
        rows = batch.select(*(F.col(n).cast(t).alias(n) if n in batch.columns else F.lit(None).cast(t).alias(n) for n, t in names.items()), F.lit(int(batch_id)).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return append


def trace_log(spark: SparkSession, path: str) -> DataFrame:
    """The steps of the log. A step that came in several batches, by run and pos, counts once: as in the smallest batch."""
    rows = spark.read.schema(f"{STEP}, batch long").parquet(path)
    return first_in(rows, ["run", "pos"], ["batch"])


def run_rows(log: DataFrame) -> DataFrame:
    """run, n_steps, n_failed, status, loop_iterations, micros: a row for each run of the log; open without a terminal row.

    The last terminal row counts; a failure before it makes a run without one failed.
    """
    terminal = F.col("status").isNotNull()
    rolled = log.groupBy("run").agg(
        F.count_if(~terminal).alias("n_steps"), F.count_if(F.coalesce("failed", F.lit(False))).alias("n_failed"),
        F.max(F.when(terminal, F.struct("pos", "status", "loop_iterations"))).alias("end"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("micros"),
    )
    status = F.coalesce(F.col("end.status"), F.when(F.col("n_failed") > 0, "failed"), F.lit("open"))
    return rolled.select("run", "n_steps", "n_failed", status.alias("status"), "end.loop_iterations", "micros")
