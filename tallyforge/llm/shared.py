"""What several operators need: tables in the shared folder and stable row addresses."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A table that is written and read again needs the shuffles behind it no more.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def held(spark: SparkSession, conf: dict[str, str]):
    """Sets what an action inside needs and puts back what was there before."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it is unset, a local master gets a folder of its own; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tallyforge/{tag}-{uuid.uuid4().hex}"


def spill(df: DataFrame, tag: str, rows_per_file: int = 0) -> DataFrame:
    """Writes a table to the shared folder and reads it again: this cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    with held(spark, TIDY):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.spilled_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that spill() wrote and that nothing reads any more."""
    for table in tables:
        where, path = fs.FileSystem.from_uri(table.spilled_to)
        where.delete_dir(path)


def written(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table in a folder, or None if there is no such folder."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def is_scan(docs: DataFrame) -> bool:
    """Whether a table is a plain scan of files, whose rows have lasting addresses."""
    if docs._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"])
            return True
        except AnalysisException:
            pass
    return False


def stable(docs: DataFrame) -> DataFrame:
    """The table itself if it is a plain scan of files; else a copy in the shared folder."""
    return docs if is_scan(docs) else spill(docs, "rows")


def own(name: str):
    """A column by its name alone, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def addressed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns and a row's address at_file, at_row, the same however a stable() table is split into tasks: hash of its file's path, number in the file."""
    docs = stable(docs)
    at = docs.metadataColumn("_metadata")
    return docs.select(*[own(c) for c in columns], F.xxhash64(at["file_path"]).alias("at_file"), at["row_index"].alias("at_row"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(doc, at_file, at_row): each row of a stable() table as a struct, so that no column's name can clash with the address."""
    at = docs.metadataColumn("_metadata")
    return docs.select(F.struct(*[own(c) for c in docs.columns]).alias("doc"), F.xxhash64(at["file_path"]).alias("at_file"), at["row_index"].alias("at_row"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """A stable() table, all its columns kept, without the rows whose addresses are in `gone`."""
    return whole_rows(docs).join(gone.select("at_file", "at_row"), ["at_file", "at_row"], "left_anti").select("doc.*")


def text_of(column: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))
