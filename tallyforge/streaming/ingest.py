"""Statements that arrive in a folder are normalised, categorised and written once; of several versions of a statement the newest stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.operators.rules import categorize
from tallyforge.sources.sinks import output_partition, statement_year, write_import
from tallyforge.sources.statements import csv_rows, numbered_lines, rejects

#: What tells a statement from any other: its account and the days of its range.
STATEMENT = ["account", "year", "stmt"]
VERSIONS = "account string, year string, stmt string, src_file string, modified timestamp, batch bigint"


def import_rows(rows: DataFrame, normalise: Callable[[DataFrame], DataFrame], rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch form: categorised rows with their statement's account, year and stmt, and the rejected rows, of what read_statement() or split_statement() give."""
    good, bad = rejects(normalise(rows))
    ranges = good.groupBy("src_file", "account").agg(F.min("txn_date").alias("start"), F.max("txn_date").alias("end"))
    named = ranges.select("src_file", "account", statement_year(F.col("start"), F.col("end")).alias("year"), output_partition(F.col("account"), F.col("start"), F.col("end")).alias("stmt"))
    return categorize(good, rules).join(named, ["src_file", "account"]), bad


def statement_versions(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(account, year, stmt, src_file, modified): a row for each file that holds a statement, of imported rows and files (src_file, modified)."""
    return rows.select(*STATEMENT, "src_file").distinct().join(files.select("src_file", "modified"), "src_file").select(*STATEMENT, "src_file", "modified")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The version of each statement that was modified last; of equal times the one whose path comes last."""
    newest = Window.partitionBy(*STATEMENT).orderBy(F.desc("modified"), F.desc("src_file"))
    return versions.withColumn("__place", F.row_number().over(newest)).where("__place = 1").drop("__place")


def replaceable(versions: DataFrame, known: DataFrame) -> DataFrame:
    """Of newly come versions those to be written: the latest of each statement, unless a known one was modified later.

    A file that comes again, or another of the same time, replaces what is there; known (account, year, stmt, modified).
    """
    before = known.groupBy(*STATEMENT).agg(F.max("modified").alias("__before"))
    joined = latest_versions(versions).join(before, STATEMENT, "left")
    return joined.where("__before IS NULL OR __before <= modified").drop("__before")


def _known(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(VERSIONS).parquet(path)
    except AnalysisException:  # nothing has been imported yet
        return spark.createDataFrame([], VERSIONS)


def ingest_statements(spark: SparkSession, folder: str, out: str, checkpoint: str, normalise: Callable[[DataFrame], DataFrame], rules: DataFrame, skip_rows: int = 0, header: bool = True, encoding: str = "UTF-8") -> None:
    """Reads the files that have come since the last call, by the same functions as the batch form.

    A statement is an account and a range of days. When it comes again under a new name its partition is replaced, once: of several
    versions in a batch the file modified last is written, and none that is older than what an earlier batch wrote. Which file
    each partition is from is kept in `versions`, a row per statement and batch; a batch that is run again reads only the other
    batches' rows, so it decides as before. `transactions` has the rows, `rejects` what could not be read.
    """
    file = F.col("_metadata")
    stream = spark.readStream.text(folder).select(file["file_path"].alias("src_file"), file["file_block_start"].alias("block"), file["file_modification_time"].alias("modified"), "value")

    def replace(rows: DataFrame, number: int, path: str) -> None:
        rows.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    def each(batch: DataFrame, number: int) -> None:
        # Read and normalised once: ranges, versions, transactions and rejects all go by these rows.
        rows = normalise(csv_rows(numbered_lines(batch.select("src_file", "block", "value"), encoding), skip_rows, header)).checkpoint()
        good, bad = import_rows(rows, lambda r: r, rules)
        known = _known(spark, f"{out}/versions").where(F.col("batch") != number)
        chosen = replaceable(statement_versions(good, batch.select("src_file", "modified").distinct()), known)
        replace(chosen, number, f"{out}/versions")
        mine = _known(spark, f"{out}/versions").where(F.col("batch") == number)
        write_import(good.join(mine.select(*STATEMENT, "src_file"), [*STATEMENT, "src_file"], "left_semi"), f"{out}/transactions")
        replace(bad, number, f"{out}/rejects")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start().awaitTermination()
