"""Queries of what is written and read back, of rule files, of passes and of names. Outputs go to the shared folder."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import receipts, review
from tallyforge.operators.rules import categorize
from tallyforge.plans import views as V
from tallyforge.plans.queries import register
from tallyforge.plans.receipt_queries import DETECTION_SQL, detections
from tallyforge.sources import rule_files, sinks
from tallyforge.sources import statements as T
from tallyforge.streaming.ingest import ingest_statements


@register("p23_safe_values", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS DECIMAL(18,4)) AS amount, CASE WHEN event_id % 2 > 0 THEN CAST(ts AS DATE) END AS day FROM events")
def p23_safe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third amount has a comma, every second day a time."""
    k, text = F.col("event_id"), F.col("value").cast("string")
    amount = F.when(k % 3 == 0, F.concat(F.lit("1,"), text)).otherwise(F.concat(F.lit(" "), text, F.lit(" ")))
    day = F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return V.events(spark, sf_dir).select("event_id", review.safe_decimal(amount).alias("amount"), review.safe_date(day).alias("day"))


@register(
    "w8_unique_names",
    "SELECT event_id AS id, event_type || CASE WHEN row_number() OVER w > 1 THEN '_' || CAST(row_number() OVER w - 1 AS VARCHAR) ELSE '' END AS name FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id)",
)
def w8_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 within each user's names."""
    own = V.events(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat_ws("\n", F.col("user_id").cast("string"), "event_type").alias("name"))
    return review.unique_names(own).select("id", F.split_part("name", F.lit("\n"), F.lit(2)).alias("name"))


@register(
    "f3_detection_passes",
    f"""WITH {DETECTION_SQL}, q AS (SELECT l_orderkey AS receipt_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS det_id, l_discount AS confidence FROM lineitem),
good AS (SELECT det.* FROM det JOIN q USING (receipt_id, det_id) WHERE confidence >= 0.05),
kept AS (SELECT * FROM good d WHERE NOT is_marker OR NOT EXISTS (SELECT 1 FROM good o WHERE o.receipt_id = d.receipt_id AND NOT o.is_marker AND d.y_min <= o.y_max AND o.y_min <= d.y_max))
SELECT receipt_id, det_id, row_number() OVER (PARTITION BY receipt_id ORDER BY center_y, min_x, det_id) AS place FROM kept""",
)
def f3_detection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the quality floor, then markers, then the reading order, each over what the one before left."""
    floor = partial(receipts.filter_low_quality, confidence=0.05, letters=1)
    found = receipts.normalize_detections(detections(spark, sf_dir), floor, receipts.drop_overlapping_markers, receipts.reading_order)
    return found.select("receipt_id", "det_id", "place")


@register(
    "f4_rule_files",
    """WITH r AS (SELECT n_regionkey AS layer, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ord, n_name, 'Expenses:' || r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT s_suppkey, n_name || ' ' || s_name AS merchant FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey AS id, merchant, arg_min(category, (layer, ord)) AS category FROM s JOIN r ON contains(upper(merchant), upper(n_name)) GROUP BY 1, 2""",
)
def f4_rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a TOML file of each region's nations, written, read back as layers and applied to the suppliers' names."""
    nation, region, folder = V.table(spark, sf_dir, "nation"), V.table(spark, sf_dir, "region"), V.shared_folder(spark, "rules")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rule = F.format_string('[[rules]]\nkeywords = ["%s"]\ncategory = "Expenses:%s"\n', F.lower("n_name"), "r_name")
    texts = named.groupBy(F.col("n_regionkey").alias("layer")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", rule.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    texts.write.partitionBy("layer").text(folder)
    rules = rule_files.merchant_rules(rule_files.read_layers(spark, *[f"{folder}/layer={k}" for k in range(5)], f"{folder}/layer=none"))
    suppliers = V.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", "n_name", "s_name").alias("merchant"))
    return categorize(suppliers, rules)


@register(
    "k4_replaced_imports",
    f"""WITH {V.TXN_SQL}, s AS (SELECT strftime(txn_date, '%Y') AS year, strftime(txn_date, '%m') AS m, txn_date, amount FROM txn),
e AS (SELECT year, m, 'card_' || strftime(min(txn_date), '%m%d') || '_' || strftime(max(txn_date), '%m%d') AS stmt FROM s GROUP BY 1, 2)
SELECT year, stmt, count(*) AS n, CAST(sum(amount + CASE WHEN m <= '06' THEN 0 ELSE 1 END) AS DECIMAL(38,4)) AS total FROM s JOIN e USING (year, m) GROUP BY 1, 2""",
)
def k4_replaced_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 and K4: statements of a month each, one too high in every row; then those of the first half of each year again, corrected. The same days of two years are two statements."""
    path = V.shared_folder(spark, "imports")
    month = F.date_format("txn_date", "yyyyMM").alias("month")
    rows = V.txns(spark, sf_dir).select(F.lit("Card").alias("account"), month, "txn_date", "amount")
    start, end = F.col("start"), F.col("end")
    ranges = rows.groupBy("month").agg(F.min("txn_date").alias("start"), F.max("txn_date").alias("end"))
    named = ranges.select("month", sinks.statement_year(start, end).alias("year"), sinks.output_partition(F.lit("Card"), start, end).alias("stmt"))
    rows = rows.join(named, "month").select("account", "year", "stmt", "month", "amount")
    sinks.write_import(rows.withColumn("amount", (F.col("amount") + 1).cast("decimal(18,4)")), path)
    sinks.write_import(rows.where("right(month, 2) <= '06'"), path)
    read = spark.read.schema("amount decimal(18,4), account string, year string, stmt string").parquet(path)
    return read.groupBy("year", "stmt").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,4)").alias("total"))


@register("k7_appended_stages", "SELECT conv_id AS receipt_id, max(turn) + 1 AS stage_index, count(DISTINCT turn) + 1 AS stages FROM conversations GROUP BY 1")
def k7_appended_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the stages as they are, then a review stage for each receipt; all are there afterwards."""
    path = V.shared_folder(spark, "stages")
    old = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("receipt_id"), F.col("turn").alias("stage_index")).distinct()
    old = old.withColumns({"stage": F.lit("ocr"), "created_by": F.lit("x"), "pass_name": F.lit("first")})
    sinks.write_stage(old.withColumn("status", F.lit("scanned")), path)
    sinks.write_stage(review.next_stage(old, "review", "reviewer", "second").drop("parent_stage").withColumn("status", F.lit("approved")), path)
    return spark.read.parquet(path).groupBy("receipt_id").agg(F.max("stage_index").alias("stage_index"), F.count("*").alias("stages"))


#: Statements of a month each, with what the file in force adds to each amount.
STATEMENT_SQL = f"""{V.TXN_SQL}, s AS (SELECT strftime(txn_date, '%Y') AS year, strftime(txn_date, '%m') AS m, txn_date, abs(amount) AS x FROM txn),
e AS (SELECT year, m, 'assets_card_' || strftime(min(txn_date), '%m%d') || '_' || strftime(max(txn_date), '%m%d') AS stmt FROM s GROUP BY 1, 2)"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.txns(spark, sf_dir).select(F.date_format("txn_date", "yyyyMM").alias("month"), "txn_date", "merchant", F.abs("amount").alias("amount"))


def _deliver(delivery: DataFrame, folder: str) -> None:
    """A file for each month, each in a folder of its own."""
    line = F.concat_ws(",", F.date_format("txn_date", "d MMM yyyy"), F.concat(F.lit('"'), "merchant", F.lit('"')), F.col("amount").cast("decimal(18,2)").cast("string"))
    delivery.select("month", line.alias("line")).repartition("month").write.mode("append").partitionBy("month").text(folder)


def _ingested(spark: SparkSession, base: str) -> DataFrame:
    """Takes what has come and sums what is there, by statement."""
    ingest_statements(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", lambda r: T.normalize_amex(r, "Assets:Card"), V.merchant_rules(spark), header=False)
    read = spark.read.schema("src_file string, amount decimal(18,4), account string, year string, stmt string").parquet(f"{base}/out/transactions")
    return read.groupBy("year", "stmt").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,4)").alias("total"), F.count_distinct("src_file").alias("files"))


def _total(added: str) -> str:
    return f"WITH {STATEMENT_SQL} SELECT year, stmt, count(*) AS n, sum(CAST(CAST(x + {added} AS DECIMAL(18,2)) AS DECIMAL(18,4))) AS total, 1 AS files FROM s JOIN e USING (year, m) GROUP BY 1, 2"


@register("t1_ingested_statements", _total("CASE WHEN m <= '06' THEN 0 ELSE 1 END"))
def t1_ingested_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each month arrives, then corrected ones for the first half of each year; a third call finds nothing new."""
    base, rows = V.shared_folder(spark, "ingest"), _monthly(spark, sf_dir)
    _deliver(rows.withColumn("amount", F.col("amount") + 1), f"{base}/in")
    _ingested(spark, base)
    _deliver(rows.where("right(month, 2) <= '06'"), f"{base}/in")
    _ingested(spark, base)
    return _ingested(spark, base)


@register("t1_versions_in_one_batch", _total("CASE WHEN m IN ('02', '05') THEN 2 ELSE 1 END"))
def t1_versions_in_one_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports of every month wait in the folder when it is read; for two months of each year a third one has come since. Each statement is the last one's rows."""
    base, rows = V.shared_folder(spark, "ingest"), _monthly(spark, sf_dir)
    for added, own in ((3, rows), (1, rows), (2, rows.where("right(month, 2) IN ('02', '05')"))):
        _deliver(own.withColumn("amount", F.col("amount") + added), f"{base}/in")
    return _ingested(spark, base)
