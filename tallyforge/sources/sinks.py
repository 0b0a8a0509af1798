"""Ledger text and tables: rendering, partitions and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _amount(number: Column) -> Column:
    return number.cast("decimal(18,2)").cast("string")


def render_transactions(txns: DataFrame, account: str = "account", counter: str = "counter_account", payee: str = "payee") -> DataFrame:
    """K1: adds text: a dated header and a line for each side."""
    head = F.concat_ws(" ", F.date_format("txn_date", "yyyy-MM-dd"), F.lit("*"), _quoted(F.col(payee)), F.lit('""'))
    line = lambda a, n: F.concat(F.lit("  "), a, F.lit("  "), _amount(n), F.lit(" "), F.col("currency"))
    return txns.withColumn("text", F.concat_ws("\n", head, line(F.col(account), -F.col("amount")), line(F.col(counter), F.col("amount"))))


def render_balances(balances: DataFrame) -> DataFrame:
    """K2: adds text: DATE balance ACCOUNT  AMOUNT CURRENCY."""
    return balances.withColumn("text", F.concat(F.date_format("assert_date", "yyyy-MM-dd"), F.lit(" balance "), F.col("account"), F.lit("  "), _amount(F.col("balance")), F.lit(" "), F.col("currency")))


def output_partition(account: Column, start: Column, end: Column) -> Column:
    """K3: account_MMdd_MMdd in lower case, colons as underscores."""
    return F.lower(F.concat_ws("_", F.replace(account, F.lit(":"), F.lit("_")), F.date_format(start, "MMdd"), F.date_format(end, "MMdd")))


def statement_year(start: Column, end: Column) -> Column:
    """The year of a statement, both where its range crosses into another: with K3's name it tells any two ranges apart."""
    first, last = F.date_format(start, "yyyy"), F.date_format(end, "yyyy")
    return F.when(first == last, first).otherwise(F.concat_ws("_", first, last))


def write_import(rows: DataFrame, path: str, account: str = "account", year: str = "year", statement: str = "stmt") -> None:
    """K4: a partition for each account, year and statement; importing one again replaces it and leaves the others.

    The same days of another year are another statement. Rows are dealt by partition first, so that each gets few files; the
    rebalance splits a partition that is too large for a task.
    """
    keys = [account, year, statement]
    rows.hint("rebalance", *map(F.col, keys)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_stage(stages: DataFrame, path: str) -> None:
    """K7: stages are added, never changed."""
    stages.write.mode("append").partitionBy("status").parquet(path)


def receipt_postings(receipts: DataFrame, items: DataFrame, tenders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: postings (receipt_id, pos, account, number) and the receipts without a total, which are turned down.

    One negative posting for each tender, or one of the total where there is none, then one for each item, never merged;
    items without an account go to Expenses:FIXME.
    """
    money = "decimal(18,4)"
    good = receipts.where("total IS NOT NULL").select("receipt_id", "total", "payment_account")
    paid = tenders.join(good.select("receipt_id", "payment_account"), "receipt_id")
    paid = paid.select("receipt_id", (F.col("pos") - 1_000_000).alias("pos"), F.coalesce("account", "payment_account").alias("account"), (-F.col("amount")).cast(money).alias("number"))
    whole = good.join(tenders.select("receipt_id"), "receipt_id", "left_anti").select("receipt_id", F.lit(-1_000_000).alias("pos"), F.col("payment_account").alias("account"), (-F.col("total")).cast(money).alias("number"))
    bought = items.join(good.select("receipt_id"), "receipt_id", "left_semi").select("receipt_id", "pos", F.coalesce("account", F.lit("Expenses:FIXME")).alias("account"), F.col("price").cast(money).alias("number"))
    return paid.unionByName(whole).unionByName(bought), receipts.where("total IS NULL").select("receipt_id")


def render_receipts(receipts: DataFrame, postings: DataFrame) -> DataFrame:
    """K5: receipt_id and text: a header with the receipt's id and its postings in order."""
    line = F.concat(F.lit("  "), F.col("account"), F.lit("  "), _amount(F.col("number")), F.lit(" CAD"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    lines = postings.groupBy("receipt_id").agg(F.array_join(F.transform(ordered, lambda p: p["line"]), "\n").alias("lines"))
    head = F.concat(F.coalesce(F.date_format("receipt_date", "yyyy-MM-dd"), F.lit("1970-01-01")), F.lit(" * "), _quoted(F.col("merchant")), F.lit('\n  receipt: "'), F.col("receipt_id").cast("string"), F.lit('"'))
    return receipts.join(lines, "receipt_id").select("receipt_id", F.concat(head, F.lit("\n"), F.col("lines")).alias("text"))


def enriched_postings(matches: DataFrame, receipts: DataFrame, ledger: DataFrame) -> DataFrame:
    """K6: postings of matched transactions: the ledger's own negative ones, then the receipt's items, with the confidence.

    matches (receipt_id, txn_id, confidence), receipts' item postings (receipt_id, pos, account, number), ledger (txn_id, pos, account, number).
    """
    own = matches.join(ledger.where("number < 0"), "txn_id").select("txn_id", F.col("pos").alias("pos"), "account", "number", "confidence")
    bought = matches.join(receipts.where("number >= 0"), "receipt_id").select("txn_id", (F.col("pos") + 1000).alias("pos"), "account", "number", "confidence")
    return own.unionByName(bought)
