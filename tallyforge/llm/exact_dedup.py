"""Exact deduplication (operator 7): a stateful stream over digests, then a comparison of full bytes.

Spark only: the stream's keyed state is an aggregation in the RocksDB state store, with no watermark and so no expiry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import SPACE, addressed, held, is_scan, scratch, spill, stable, text_of, without, written
from tallyforge.llm.url_filter import bloom_blocks, bloom_filter, probed

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, SPACE, " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


SEEN = "digest binary, first struct<no_id boolean, doc_id bigint, at_file bigint, at_row bigint>, group_size bigint"


def _first_seen(spark: SparkSession, digests: DataFrame, folder: str, files_per_batch: int | None) -> DataFrame:
    """Streams what is new in the digest table of `folder` through keyed state; (digest, first, group_size) as the state holds them at the end."""
    path, out, checkpoint = f"{folder}/digests", f"{folder}/first-seen", f"{folder}/state"
    reader = spark.readStream.schema(digests.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at_file", "at_row")
    state = reader.parquet(path).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], SEEN).write.mode("overwrite").parquet(f"{out}/batch=-1")  # so that there is a table even where nothing comes
    with held(spark, ROCKSDB):
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    last = spark.read.schema(f"{SEEN}, batch int").parquet(out)
    latest = last.groupBy("digest").agg(F.max_by(F.struct("first", "group_size"), "batch").alias("held")).select("digest", "held.*")
    return spill(latest, "held")  # a plain table, so that a join with it can split a hot digest


def _digests(spark: SparkSession, rows: DataFrame, digest, folder: str, known: DataFrame | None) -> DataFrame:
    """The digest table in `folder` after the rows of files that it doesn't have yet are added."""
    if known is not None:
        rows = rows.join(known.select("at_file").distinct(), "at_file", "left_anti")
    found = rows.select("doc_id", "at_file", "at_row", digest(F.col("norm")).alias("digest"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    found.write.mode("append").option("compression", "zstd").parquet(f"{folder}/digests")
    return spark.read.schema(found.schema).parquet(f"{folder}/digests")


def exact_dedup(docs: DataFrame, digest=sha256_digest, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 and its address at_file, at_row.

    Texts are equal when identical after each run of white space is replaced by one space. Of equal texts the row with the
    smallest doc_id stays; a null id comes last, and rows with the same id are ordered by their address, so that one row of
    each group stays whatever repeats. A null text counts as empty; an empty table gives no rows; columns other than
    doc_id and text are not read. digest may be any function of the normalised text: rows whose digests agree are compared
    by their full bytes, and where these differ the group is dealt again by the bytes themselves.

    `state` is a folder that all executors share and that keeps the stream's state from call to call: `docs` is then a table of files that
    grows by whole files; a call hashes and streams only those that came since the last one, and judges all rows. Without it
    each call starts from nothing.
    """
    spark = docs.sparkSession
    if state and not is_scan(docs):
        raise ValueError("a kept state needs a table of files, whose rows have lasting addresses")
    folder = state or scratch(spark, "exact")
    rows = addressed(docs, "doc_id", "text").withColumn("norm", normalised(text_of()))
    digests = _digests(spark, rows, digest, folder, written(spark, f"{folder}/digests", "at_file bigint") if state else None)
    seen = _first_seen(spark, digests, folder, files_per_batch)

    def judged(found: DataFrame) -> DataFrame:
        return found.select(
            "doc_id",
            F.col("first.doc_id").alias("keep_id"),
            "group_size",
            ((F.col("first.at_file") == F.col("at_file")) & (F.col("first.at_row") == F.col("at_row"))).alias("kept"),
            "text_sha256",
            "at_file",
            "at_row",
        )

    plain = judged(digests.join(seen, "digest"))
    # Only digests that came more than once need their bytes: a Bloom filter of them, of a bounded size, keeps most other texts out of the shuffle.
    # The least and the greatest text of a digest are the same bytes exactly when all are; partial minima keep hot groups small.
    repeated = seen.where("group_size > 1").select("digest")
    blocks = bloom_blocks(repeated.count())
    hits = probed(rows.select("norm", digest(F.col("norm")).alias("digest")), "digest", bloom_filter(repeated, "digest", blocks), blocks).where("hit")
    bytes_of = hits.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    clashing = spill(bytes_of.where("low != high").select("digest"), "clashing")
    if clashing.isEmpty():
        return plain
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at_file", "at_row")
    apart = rows.withColumn("digest", digest(F.col("norm"))).join(clashing, "digest", "left_semi")
    groups = apart.groupBy("digest", "norm").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    again = apart.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)).join(groups, ["digest", "norm"])
    return judged(digests.join(clashing, "digest", "left_anti").join(seen, "digest")).unionByName(judged(again))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents, all their columns kept, without the rows that exact_dedup() drops.

    Columns may have any names; null texts and ids, and repeated rows, are as in exact_dedup(). An empty table gives no rows.
    """
    docs = stable(docs)
    return without(docs, exact_dedup(docs).where("NOT kept"))
