"""Transactions and postings: both sides, edits, balances, dates and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.scalars import MONEY, is_installment, is_offer, is_payment


def clean_card(txns: DataFrame, merchant: str = "merchant", amount: str = "amount") -> DataFrame:
    """Without payments, instalment plans and free fares."""
    return txns.where(~(is_payment(F.col(merchant)) | is_installment(F.col(merchant)) | is_offer(F.col(merchant), F.col(amount))))


def to_postings(txns: DataFrame, account: str, counter: str, amount: str, chequing: bool = False) -> DataFrame:
    """Two rows a transaction, pos 0 for the bank's or card's account and pos 1 for the other side; they sum to zero."""
    own = F.col(amount).cast(MONEY) if chequing else (-F.col(amount)).cast(MONEY)
    sides = F.array(F.struct(F.col(account).alias("posting_account"), own.alias("number")), F.struct(F.col(counter).alias("posting_account"), (-own).cast(MONEY).alias("number")))
    return txns.select("*", F.posexplode(sides).alias("pos", "__side")).select(*txns.columns, "pos", "__side.*")


def ledger_transactions(postings: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """One row per transaction with its postings nested in order; null amounts are kept."""
    nested = F.array_sort(F.collect_list(F.struct(F.col(position).alias("pos"), "account", "number", "currency")))
    return postings.groupBy(*keys).agg(F.transform(nested, lambda p: F.struct(p["account"].alias("account"), p["number"].alias("number"), p["currency"].alias("currency"))).alias("postings"))


def ledger_postings(ledger: DataFrame) -> DataFrame:
    """S16 backwards: one row per posting; a transaction without postings keeps a row of nulls."""
    rest = [c for c in ledger.columns if c != "postings"]
    return ledger.select(*rest, F.posexplode_outer("postings").alias("pos", "__p")).select(*rest, "pos", "__p.*")


def apply_edits(txns: DataFrame, edits: DataFrame, keys: tuple[str, str, str] = ("txn_date", "payee", "amount")) -> DataFrame:
    """Re-pointed, re-priced or deleted by (date, payee, amount); the last edit of a key counts, and edits without a row are ignored."""
    day, payee, amount = keys
    last = edits.groupBy("txn_date", "payee", "amount").agg(F.max_by(F.struct("category", "new_amount", "deleted"), "ord").alias("edit"))
    last = last.select(F.col("txn_date").alias("__d"), F.col("payee").alias("__p"), F.col("amount").alias("__a"), "edit")
    joined = txns.join(last, (F.col(day) == F.col("__d")) & F.col(payee).eqNullSafe(F.col("__p")) & (F.col(amount) == F.col("__a")), "left")
    joined = joined.where(~F.coalesce("edit.deleted", F.lit(False)))
    changed = {"category": F.coalesce("edit.category", "category"), amount: F.coalesce("edit.new_amount", amount).cast(MONEY)}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in txns.columns])


def first_balance_per_day(balances: DataFrame) -> DataFrame:
    """A5: for each account and date the balance of the row that comes first in the file."""
    return balances.groupBy("account", "day").agg(F.min_by("balance", "row_idx").alias("balance"))


def quiet_day_balances(balances: DataFrame, *dated: DataFrame) -> DataFrame:
    """Balances of the days on which the account has no transaction in any of the tables of (account, day)."""
    busy = dated[0].select("account", "day")
    for more in dated[1:]:
        busy = busy.unionByName(more.select("account", "day"))
    return balances.join(busy, ["account", "day"], "left_anti")


def statement_as_of(rows: DataFrame, file: str = "src_file", day: str = "txn_date") -> DataFrame:
    """A1: the latest readable date of each file."""
    return rows.groupBy(file).agg(F.max(day).alias("as_of"))


def statement_range(rows: DataFrame, file: str = "src_file", day: str = "txn_date", start: str | None = None, end: str | None = None) -> DataFrame:
    """A2: first and last date of each file, unless both ends are given; one alone is an error."""
    if (start is None) != (end is None):
        raise ValueError("give both ends of the range or none")
    fixed = lambda d, own: F.coalesce(F.lit(d).cast("date"), own)
    return rows.groupBy(file).agg(fixed(start, F.min(day)).alias("range_start"), fixed(end, F.max(day)).alias("range_end"))


def commingle(txns: DataFrame, balances: DataFrame) -> DataFrame:
    """Transactions (kind 0) and balances (kind 1) in one table."""
    return txns.withColumn("kind", F.lit(0)).unionByName(balances.withColumn("kind", F.lit(1)), allowMissingColumns=True)


def place_in(entries: DataFrame, within: list[str], part: list[Column], order: list[Column]) -> DataFrame:
    """Adds place: each entry's rank from 1 among those that are equal in `within`, by `part` and then by `order`.

    A rank is a place among the entries of equal `part` and the number of entries whose `part` comes before. Only the counts of parts, a row each, go
    through an order of all that `within` names, so an account or file of any number of entries is as many tasks' work as it has parts.
    """
    names = [f"__part{k}" for k in range(len(part))]
    parted = entries.withColumns(dict(zip(names, part, strict=True)))
    keys = [*within, *names]
    before = Window.partitionBy(*within).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy(*keys).agg(F.count("*").alias("__n"))
    same = [F.col(k).eqNullSafe(F.col(f"__own_{k}")) for k in keys]
    offsets = counts.select(*[F.col(k).alias(f"__own_{k}") for k in keys], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = parted.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(offsets, reduce(Column.__and__, same)).select(*entries.columns, (F.col("__before") + F.col("__rank")).alias("place"))


def chronological(entries: DataFrame, account: str, day: str) -> DataFrame:
    """Place of each entry within its account: by date, transactions before balances, then the order of the file."""
    return place_in(entries, [account], [F.col(day)], [F.col("kind"), F.col("row_idx")])


def uncategorized_first(entries: DataFrame, file: str = "src_file", category: str = "category", default: str = "Expenses:Uncategorized", span: int = 65_536) -> DataFrame:
    """Place of each entry within its file: uncategorised ones first, the order of the file otherwise kept. Entries are ranked by so many lines at a time."""
    known = (F.col(category) != default).cast("int")
    return place_in(entries, [file], [known, F.floor(F.col("row_idx") / span)], [F.col("row_idx")])


def candidate_categories(open_accounts: DataFrame, entries: DataFrame) -> DataFrame:
    """Open expense accounts and the categories in use."""
    return open_accounts.where(F.col("account").startswith("Expenses:")).select(F.col("account").alias("category")).union(entries.select("category")).where("category IS NOT NULL").distinct()
