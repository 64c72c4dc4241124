"""What the training-data operators share: reading tables, staging to shared storage, let-bindings, ranking."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The word separators of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one machine's session gets a local one, and a cluster's an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage as checkpoint() does, but keeps columns compressed and prunable. The files
    survive the loss of an executor; they go by discard(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, target = _file(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _file(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def discard(*staged: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again."""
    for df in staged:
        system, target = _file(df.sparkSession, df._staged)
        system.delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from every column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times inside one expression."""
    return F.transform(F.array(value), use)[0]


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Inner join in which a key with many rows on one side is dealt over salts; the other side is copied once a salt."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], rows_per_salt: int = 50_000, name: str = "rank0") -> DataFrame:
    """Add a gapless rank from 0 within keys, without gathering a hot key in one task.

    Each key is dealt over salts; rows are numbered within (keys, salt) and shifted by the counts of the
    smaller salts. The order between salts is by hash, so the rank is deterministic but not sorted by order.
    There is a salt for each shuffle partition, and more where a salt of a group of all rows would
    hold over rows_per_salt. order must identify a row, except for rows equal in every column.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(partitions, -(-df.count() // rows_per_salt))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = salted.withColumn("_i", F.row_number().over(within).cast("long") - 1)
    return numbered.join(offsets, [*keys, "_salt"]).withColumn(name, F.col("_i") + F.col("_before")).drop("_i", "_before", "_salt")
