"""Queries of statement layouts and routing: statements are written from the orders and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans import views as V
from tallyforge.plans.queries import register
from tallyforge.sources import statements as T
from tallyforge.streaming.ingest import import_rows

def _key() -> Column:
    return F.col("order_id")


def _amount(negative: bool = False) -> Column:
    return (F.when(_key() % 4 == 0, -F.col("amount")).otherwise(F.col("amount")) if negative else F.col("amount")).cast("decimal(18,2)").cast("string")


def _statement(spark: SparkSession, sf_dir: str, line: Column, file: Column | None = None) -> DataFrame:
    """Rows with fields, of one line of CSV per card transaction."""
    rows = V.txns(spark, sf_dir).withColumn("amount", F.abs("amount"))
    rows = rows.select((file if file is not None else F.lit("statement.csv")).alias("src_file"), _key().alias("row_idx"), line.alias("line"))
    return T.with_fields(rows)


def _day(pattern: str) -> Column:
    return F.date_format("txn_date", pattern)


def _quoted() -> Column:
    return F.concat(F.lit('"'), F.col("merchant"), F.lit(', ""X"""'))


def _summary(rows: DataFrame, value: str = "amount", name: str = "merchant") -> DataFrame:
    good, bad = T.rejects(rows, value)
    return good.groupBy("account", F.date_format("txn_date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.max(name).alias("last_name"), F.countDistinct("txn_date").alias("days")
    )


def _sql(account: str = "'A'", total: str = "x", where: str = "true", name: str = """merchant || ', "X"'""") -> str:
    return f"""WITH {V.TXN_SQL}, s AS (SELECT *, CAST(CAST(abs(amount) AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS x, {account} AS account FROM txn)
SELECT account, strftime(txn_date, '%Y-%m') AS month, count(*) AS n, sum({total}) AS total, max({name}) AS last_name, count(DISTINCT txn_date) AS days FROM s WHERE {where} GROUP BY 1, 2"""


@register("s2_amex", _sql())
def s2_amex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(T.normalize_amex(_statement(spark, sf_dir, F.concat_ws(",", _day("d MMM yyyy"), _quoted(), _amount())), "A"))


@register("s3_bmo", _sql("CASE WHEN order_id % 3 = 0 THEN 'B' ELSE 'A' END"))
def s3_bmo(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.when(_key() % 3 == 0, "porter.csv").otherwise("other.csv")
    return _summary(T.normalize_bmo(_statement(spark, sf_dir, F.concat_ws(",", F.lit("1"), F.lit("DEBIT"), _day("yyyyMMdd"), _amount(), _quoted()), file), "A", "B"))


@register("s4_cibc", _sql("CASE WHEN order_id % 3 = 0 THEN 'S' ELSE 'A' END", where="order_id % 5 > 0"))
def s4_cibc(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(_key() % 2 == 0, _day("M/d/yyyy")).otherwise(_day("yyyy-MM-dd"))
    file = F.when(_key() % 3 == 0, "my simplii.csv").otherwise("cibc.csv")
    return _summary(T.normalize_cibc(_statement(spark, sf_dir, F.concat_ws(",", day, _quoted(), F.when(_key() % 5 > 0, _amount()).otherwise("")), file), "A", "S"))


@register("s5_ctfs", _sql(where="order_id % 6 > 0"))
def s5_ctfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(_key() % 6 == 0, "PAYMENT").otherwise("SALE")
    name = F.when(_key() % 6 == 0, F.lit("PMT THANKS")).otherwise(_quoted())
    return _summary(T.normalize_ctfs(_statement(spark, sf_dir, F.concat_ws(",", F.lit("1"), _day("yyyy-MM-dd"), kind, name, _amount())), "A"))


@register("s6_mbna", _sql(total="-x"))
def s6_mbna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(T.normalize_mbna(_statement(spark, sf_dir, F.concat_ws(",", _day("MM/dd/yyyy"), _quoted(), F.lit("addr"), _amount())), "A"))


@register("s7_pcf", _sql(where="order_id % 6 > 0"))
def s7_pcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(_key() % 6 == 0, "PAYMENT").otherwise("PURCHASE")
    return _summary(T.normalize_pcf(_statement(spark, sf_dir, F.concat_ws(",", _quoted(), kind, F.lit("x"), _day("M/d/yyyy"), F.lit("10:00"), F.concat(F.lit("-"), _amount()))), "A"))


@register("s8_rogers", _sql(where="order_id % 4 > 0"))
def s8_rogers(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(_key() % 4 == 0, F.concat(F.lit("-$"), _amount())).otherwise(F.concat(F.lit("$"), _amount()))
    return _summary(T.normalize_rogers(_statement(spark, sf_dir, F.concat_ws(",", _day("yyyy-MM-dd"), amount, _quoted())), "A"))


@register("s9_scotia", _sql(where="order_id % 4 > 0"))
def s9_scotia(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(_key() % 4 == 0, "Credit").otherwise("Debit")
    return _summary(T.normalize_scotia(_statement(spark, sf_dir, F.concat_ws(",", F.lit("f"), _day("yyyy-MM-dd"), _quoted(), F.lit(""), F.lit("posted"), side, _amount())), "A"))


def _chequing(rows: DataFrame) -> DataFrame:
    return _summary(rows, "balance", "description")


def _grouped() -> Column:
    return F.concat(F.lit('"$'), F.format_number(F.col("amount").cast("double"), 2), F.lit('"'))


@register("s10_eqbank", _sql())
def s10_eqbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with dollar signs and thousands commas."""
    return _chequing(T.normalize_eqbank(_statement(spark, sf_dir, F.concat_ws(",", _day("yyyy-MM-dd"), _quoted(), F.lit("$1.00"), _grouped())), "A"))


@register("s11_scotia_chequing", _sql(where="order_id % 9 > 0", name="""CASE WHEN order_id % 2 = 0 THEN merchant || ', "X" - sub' ELSE merchant || ', "X"' END"""))
def s11_scotia_chequing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub, day = F.when(_key() % 2 == 0, "sub").otherwise(""), F.when(_key() % 9 > 0, _day("yyyy-MM-dd")).otherwise("")
    return _chequing(T.normalize_scotia_chequing(_statement(spark, sf_dir, F.concat_ws(",", day, _quoted(), sub, F.lit("1.00"), _grouped())), "A"))


@register(
    "p2_rejected_rows",
    f"""WITH {V.TXN_SQL} SELECT CASE WHEN order_id % 10 = 0 THEN 'date, amount' WHEN order_id % 5 = 0 THEN 'date' ELSE 'amount' END AS reason, count(*) AS n FROM txn WHERE order_id % 5 = 0 OR order_id % 2 = 0 GROUP BY 1""",
)
def p2_rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousands comma or an impossible date turns a row down, with its reason."""
    day = F.when(_key() % 5 == 0, "31 Feb 2024").otherwise(_day("d MMM yyyy"))
    amount = F.when(_key() % 2 == 0, '"1,000.00"').otherwise(_amount())
    bad = T.rejects(T.normalize_amex(_statement(spark, sf_dir, F.concat_ws(",", day, _quoted(), amount)), "A"))[1]
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


NAMES = ("amex_{}.csv", "cc-MBNA-monthly-{}.csv", "Scotia visa {}.CSV", "eqbank-{}.csv", "cc-mbna-{}.csv", "notes-{}.txt")
ROUTES = [
    (0, "amex", False, "cc", "amex", "cc-amex"),
    (1, "cc-MBNA-monthly", True, "cc", "mbna", "cc-mbna-monthly"),
    (2, "mbna", False, "cc", "mbna", "cc-mbna"),
    (3, "scotia.*\\.csv$", False, "cc", "scotia", "cc-scotia"),
    (4, "^Scotia", True, "chequing", "scotia", "chequing-scotia"),
    (5, "eqbank", False, "chequing", "eqbank", "chequing-eqbank"),
]
HEADERS = {"cc-mbna": (["Date", "Payee", "Amount"], True), "chequing-scotia": (["Date", "Sub-description"], False), "cc-scotia": (["Debit"], False)}

ROUTE_SQL = r"""
f AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'amex_' || o_orderkey || '.csv' WHEN 1 THEN 'cc-MBNA-monthly-' || o_orderkey || '.csv' WHEN 2 THEN 'Scotia visa ' || o_orderkey || '.CSV' WHEN 3 THEN 'eqbank-' || o_orderkey || '.csv'
  WHEN 4 THEN 'cc-mbna-' || o_orderkey || '.csv' ELSE 'notes-' || o_orderkey || '.txt' END AS file_name, CASE WHEN o_orderkey % 5 = 0 THEN ['DATE', 'payee ', 'amount'] WHEN o_orderkey % 5 = 1 THEN ['Date', 'Sub-Description', 'X'] ELSE ['1/2/2024', 'SHOP', 'ADDR', CASE WHEN o_orderkey % 5 = 2 THEN '12.5' ELSE 'x' END] END AS h FROM orders),
r(ord, rule, pat, cs) AS (VALUES (0, 'cc-amex', 'amex', false), (1, 'cc-mbna-monthly', 'cc-MBNA-monthly', true), (2, 'cc-mbna', 'mbna', false), (3, 'cc-scotia', 'scotia.*\.csv$', false), (4, 'chequing-scotia', '^Scotia', true), (5, 'chequing-eqbank', 'eqbank', false)),
m AS (SELECT k, file_name, rule, h FROM f JOIN r ON regexp_matches(CASE WHEN cs THEN file_name ELSE lower(file_name) END, pat)),
v AS (SELECT k, file_name, rule, CASE rule WHEN 'cc-mbna' THEN k % 5 IN (0, 2) WHEN 'chequing-scotia' THEN k % 5 = 1 WHEN 'cc-scotia' THEN false END AS valid FROM m),
c AS (SELECT *, count(*) OVER (PARTITION BY file_name) AS n, count(*) FILTER (valid) OVER (PARTITION BY file_name) AS good FROM v)"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.element_at(F.array(*[F.format_string(n.replace("{}", "%d"), key) for n in NAMES]), (key % 6 + 1).cast("int"))
    text = lambda *v: F.array(*map(F.lit, v))
    first = F.array(F.lit("1/2/2024"), F.lit("SHOP"), F.lit("ADDR"), F.when(key % 5 == 2, "12.5").otherwise("x"))
    header = F.when(key % 5 == 0, text("DATE", "payee ", "amount")).when(key % 5 == 1, text("Date", "Sub-Description", "X")).otherwise(first)
    files = V.table(spark, sf_dir, "orders").select(name.alias("file_name"), header.alias("header"), header.alias("first_row"))
    rules = spark.createDataFrame(ROUTES, "ord int, pattern string, case_sensitive boolean, import_type string, importer string, rule string")
    required = spark.createDataFrame([(k, *v) for k, v in HEADERS.items()], "rule string, required array<string>, headerless boolean")
    return T.validate_header(T.route_by_name(files, rules), files, required)


@register("s13_validated_routes", f"WITH {ROUTE_SQL} SELECT file_name, rule, valid FROM c")
def s13_validated_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12 and S13."""
    return routes(spark, sf_dir).select("file_name", "rule", "valid")


@register("s14_resolved_routes", f"WITH {ROUTE_SQL} SELECT file_name, rule, n > 1 AND good = 0 AS asked FROM c WHERE (n = 1 AND valid IS NULL) OR coalesce(valid, false) OR (n > 1 AND good = 0)")
def s14_resolved_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.resolve_routes(routes(spark, sf_dir)).select("file_name", "rule", "asked")


@register("s15_chequing_types", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'eqbank' WHEN 1 THEN 'scotia' END AS kind FROM orders")
def s15_chequing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda *v: F.array(*map(F.lit, v))
    k = F.col("o_orderkey") % 3
    header = F.when(k == 0, text("Balance", "Transfer date", " Description", "Amount")).when(k == 1, text("Date", "Description", "Sub-description", "Amount", "Balance")).otherwise(text("Date", "Amount"))
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.chequing_type(header).alias("kind"))


@register(
    "s1_imported_files",
    f"""WITH {V.TXN_SQL}, s AS (SELECT 'm' || strftime(txn_date, '%Y%m') || '.csv' AS src_file, * FROM txn),
e AS (SELECT src_file, min(txn_date) AS a, max(txn_date) AS b FROM s GROUP BY 1)
SELECT src_file, count(*) AS n, sum(CAST(CAST(abs(amount) AS DECIMAL(18,2)) AS DECIMAL(18,4))) AS total, 'assets_card_' || strftime(min(e.a), '%m%d') || '_' || strftime(max(e.b), '%m%d') AS stmt FROM s JOIN e USING (src_file) GROUP BY 1""",
)
def s1_imported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, K3 and the batch form of T1: files of a month each, with a preamble, a header and a byte-order mark."""
    rows = V.txns(spark, sf_dir).withColumn("amount", F.abs("amount"))
    line = F.concat_ws(",", _day("d MMM yyyy"), _quoted(), _amount())
    files = rows.groupBy(F.concat(F.lit("m"), F.date_format("txn_date", "yyyyMM"), F.lit(".csv")).alias("src_file")).agg(F.concat(F.lit("﻿preamble\r\nDate,Description,Amount\r\n"), F.array_join(F.collect_list(line), "\r\n")).alias("text"))
    good, _ = import_rows(T.split_statement(files, 1), lambda r: T.normalize_amex(r, "Assets:Card"), V.merchant_rules(spark))
    return good.groupBy("src_file", "stmt").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,4)").alias("total"))


@register(
    "s1_large_files",
    f"""WITH {V.TXN_SQL}, s AS (SELECT strftime(txn_date, '%Y') AS year, abs(amount) AS x, merchant FROM txn)
SELECT year, count(*) AS n, sum(CAST(CAST(x AS DECIMAL(18,2)) AS DECIMAL(18,4))) AS total, max(merchant || chr(10) || 'X, "Y"') AS last_name, 4 * count(*) + 2 AS lines, 1::BIGINT AS files FROM s GROUP BY 1""",
)
def s1_large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a year, read in splits; each row goes over two lines and is followed by two empty ones. The last row's number tells how many lines are before it."""
    path = V.shared_folder(spark, "statements")
    rows = V.txns(spark, sf_dir).withColumn("amount", F.abs("amount"))
    line = F.concat(_day("d MMM yyyy"), F.lit(',"'), F.col("merchant"), F.lit('\nX, ""Y""",'), _amount(), F.lit("\n\n"))
    body = rows.select(_day("yyyy").alias("year"), F.lit(1).alias("turn"), line.alias("line"))
    heads = rows.select(_day("yyyy").alias("year")).distinct().select("year", F.lit(0).alias("turn"), F.lit("preamble\nDate,Description,Amount").alias("line"))
    heads.unionByName(body).repartition("year").sortWithinPartitions("year", "turn").drop("turn").write.partitionBy("year").text(path)
    good, _ = T.rejects(T.normalize_amex(T.read_statement(spark, path, skip_rows=1), "A"))
    found = good.withColumn("year", F.regexp_extract("src_file", "year=([0-9]+)", 1)).groupBy("year")
    last = (F.max("row_idx") + 4).alias("lines")
    return found.agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.max("merchant").alias("last_name"), last, F.countDistinct("src_file").alias("files"))
