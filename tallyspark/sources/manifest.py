"""Incremental ingestion of filings: what the manifest holds is not fetched or written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A filing's metadata with what was asked for, so that a substitution shows.
FILING = "cik string, accession string, form string, fiscal_year int, filing_date date, requested_form string, requested_year int, is_substitution boolean, document string, html string, batch long"


def filings(spark: SparkSession, path: str) -> DataFrame:
    """The filings ingested below path; none before the first run. Columns that are not read cost nothing, so this is the manifest, too."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(FILING).parquet(path) if there else spark.createDataFrame([], FILING)


def ingest(packages: DataFrame, path: str, batch: int) -> DataFrame:
    """Add the packages (columns of FILING without batch) that the filings below path lack, by cik and accession; return all filings.

    A batch is a partition and overwrites itself alone, so a run that is repeated under its number leaves the same rows, and a run
    without new filings adds none. Of several packages of one filing in a run the one of the smallest requested year counts.
    """
    spark = packages.sparkSession
    known = filings(spark, path).filter(F.col("batch") != batch).select("cik", "accession")
    columns = [c.split(" ")[0] for c in FILING.split(", ")]
    new = packages.join(known, ["cik", "accession"], "left_anti").withColumn("batch", F.lit(batch).cast("long"))
    first = F.min(F.struct("requested_year", *(c for c in columns if c not in ("cik", "accession", "requested_year"))))
    rows = new.groupBy("cik", "accession").agg(first.alias("f")).select("cik", "accession", "f.*").select(*columns)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    return filings(spark, path)


def filing_documents(spark: SparkSession, path: str) -> DataFrame:
    """Filings from metadata files, one JSON object a file; a file of another shape fails the read."""
    return spark.read.schema(FILING).option("multiLine", True).option("mode", "FAILFAST").json(path)
