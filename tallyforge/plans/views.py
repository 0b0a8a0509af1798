"""Bookkeeping views of the given tables, as DataFrames and as DuckDB SQL, and small rule tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalars import MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it is unset, a local master gets a folder of its own; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tallyforge/{tag}-{uuid.uuid4().hex}"


MERCHANT_RULES = [
    (0, 0, ["RED", "HOT PLATE"], "Expenses:Red"),
    (0, 1, ["WIDGET", "GIZMO"], "Expenses:Gadgets"),
    (1, 0, ["RING"], "Expenses:Jewellery"),
    (1, 1, ["BLUE", "BOLT"], "Expenses:Hardware"),
]
FAMILIES = [(0, 0, "Red Goods", ["RED WIDGET", "RED RING"]), (0, 1, "Plates", ["HOT PLATE", "OLD PLATE"]), (1, 0, "Rods Inc", ["LARGE ROD"])]
ITEM_RULES = [
    (0, 0, ["RED"], "red", ["colour"], 1, False),
    (0, 1, ["PLATE", "RING"], "table", ["home"], 1, False),
    (0, 2, ["R0D", "BOLT"], "tools", ["metal", "home"], 2, False),
    (0, 3, ["OLD"], None, ["used"], 0, True),
    (1, 0, ["HOT PLATE"], "Expenses:Kitchen", [], 1, True),
]
CATEGORY_ACCOUNTS = [(0, "red", "Expenses:Red"), (1, "table", "Expenses:Home"), (2, "tools", "Expenses:Tools"), (3, "home", "Expenses:Home"), (4, "used", "Expenses:Used")]


def merchant_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MERCHANT_RULES, "layer int, ord int, keywords array<string>, category string")


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAMILIES, "layer int, ord int, canonical string, aliases array<string>")


def item_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITEM_RULES, "layer int, ord int, keywords array<string>, category string, tags array<string>, priority int, exact_only boolean")


def category_accounts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORY_ACCOUNTS, "ord int, key string, account string")


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def keyword_sql(rules: list[tuple]) -> str:
    """rule(place, keyword, category) for DuckDB."""
    rows = [f"({layer * 100 + ord_}, {_text(k)}, {_text(category)})" for layer, ord_, keywords, category in rules for k in keywords]
    return f"rule(place, keyword, category) AS (VALUES {', '.join(rows)})"


#: Card transactions: returned lines are refunds.
TXN_SQL = """
txn AS (SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(o_orderdate AS DATE) AS txn_date,
  CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,4)) AS amount, upper(p_name) AS merchant
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    joined = line.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    amount = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return joined.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("o_orderdate").cast("date").alias("txn_date"), amount.cast(MONEY).alias("amount"), F.upper("p_name").alias("merchant")
    )


#: Receipts: one an order, named after the part of its first line; transactions: the same, with day and amount moved by the key.
RECEIPT_SQL = """
named AS (SELECT l_orderkey, arg_min(upper(p_name), (l_linenumber, l_partkey)) AS merchant FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
receipt AS (SELECT o_orderkey AS receipt_id, o_custkey AS household, CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS receipt_date, merchant,
  CAST(o_totalprice AS DECIMAL(18,4)) AS total FROM orders JOIN named ON o_orderkey = l_orderkey),
ledger AS (SELECT o_orderkey AS txn_id, o_custkey AS household, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 4 AS INTEGER) AS txn_date, CASE WHEN o_orderkey % 4 = 0 THEN merchant || ' INC' WHEN o_orderkey % 4 = 1 THEN 'OTHER SHOP' ELSE merchant END AS payee,
  CAST(CAST(o_totalprice AS DECIMAL(18,4)) + CAST((o_orderkey % 7) * 0.05 AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS amount FROM orders JOIN named ON o_orderkey = l_orderkey)"""


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    named = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.min_by(F.upper("p_name"), F.struct("l_linenumber", "l_partkey")).alias("merchant"))
    joined = orders.join(named, F.col("o_orderkey") == F.col("l_orderkey"))
    known = (F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 5 > 0)
    return joined.select(
        F.col("o_orderkey").alias("receipt_id"), F.col("o_custkey").alias("household"), F.when(known, F.col("o_orderdate").cast("date")).alias("receipt_date"), "merchant", F.col("o_totalprice").cast(MONEY).alias("total"),
        F.lit(None).cast(MONEY).alias("card_amount"), F.lit(0).cast(MONEY).alias("non_card"), F.col("o_orderdate").cast("date").alias("__day"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = receipts(spark, sf_dir)
    key = F.col("receipt_id")
    payee = F.when(key % 4 == 0, F.concat("merchant", F.lit(" INC"))).when(key % 4 == 1, "OTHER SHOP").otherwise(F.col("merchant"))
    moved = F.expr("date_add(__day, cast(receipt_id % 9 - 4 as int))")
    return own.select(key.alias("txn_id"), "household", moved.alias("txn_date"), payee.alias("payee"), (F.col("total") + ((key % 7) * F.lit(0.05)).cast(MONEY)).cast(MONEY).alias("amount"))


#: Days of users: the last running balance of each event, from the day after.
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


EVENT_ACCOUNT = "'Assets:User:' || CAST(user_id AS VARCHAR)"


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close")
    return events(spark, sf_dir).select(F.concat(F.lit("Assets:User:"), F.col("user_id").cast("string")).alias("account"), kind.alias("kind"), F.col("ts").cast("date").alias("event_date")).where("kind IS NOT NULL")


ACCOUNT_EVENT_SQL = f"""
account_event AS (SELECT {EVENT_ACCOUNT} AS account, CASE event_type WHEN 'signup' THEN 'open' ELSE 'close' END AS kind, CAST(ts AS DATE) AS event_date
  FROM events WHERE event_type IN ('signup', 'error')),
last_event AS (SELECT account, max(event_date) FILTER (kind = 'open') AS opened, max(event_date) FILTER (kind = 'close') AS closed FROM account_event GROUP BY 1),
open_account AS (SELECT account FROM last_event WHERE opened <= DATE '2024-01-25' AND (closed IS NULL OR closed > DATE '2024-01-25' OR opened > closed))"""
