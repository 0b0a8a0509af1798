"""Checks of a ledger and of extracted receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.likeness import block_ratio


def unknown_accounts(postings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Postings to accounts that aren't among the open ones."""
    return postings.join(accounts.select("account"), "account", "left_anti")


def inactive_postings(postings: DataFrame, events: DataFrame) -> DataFrame:
    """Postings (account, day, ...) to accounts that are not open on their own day, with reason: unknown, not yet open or closed.

    events (account, kind, event_date) open and close accounts, also more than once. An account is open from the day of
    an open to that of the next close, both included; an open and a close on one day come in this order. Days with postings and
    events are put in one order per account, and each day gets the event before it; only an account's distinct days go through
    the window, so an account with any number of postings is no more work there than its calendar.
    """
    columns = postings.columns
    days = postings.select("account", "day").distinct().select("account", "day", F.lit(1).alias("turn"), F.lit(None).cast("string").alias("kind"))
    marks = events.where("kind IN ('open', 'close')").select("account", F.col("event_date").alias("day"), F.when(F.col("kind") == "open", 0).otherwise(2).alias("turn"), "kind")
    so_far = Window.partitionBy("account").orderBy("day", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.max(F.when(F.col("kind") == "open", True)).over(Window.partitionBy("account"))
    seen = days.unionByName(marks).withColumn("__last", F.last("kind", ignorenulls=True).over(so_far)).withColumn("__known", known)
    reason = F.when(F.col("__known").isNull(), "unknown").when(F.col("__last").isNull(), "not yet open").when(F.col("__last") == "close", "closed")
    bad = seen.where("turn = 1").select("account", "day", reason.alias("reason")).where("reason IS NOT NULL")
    return postings.join(bad, ["account", "day"]).select(*columns, "reason")


def unbalanced(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Transactions and currencies whose postings don't sum to zero."""
    return postings.groupBy(*keys, "currency").agg(F.sum("number").alias("residue")).where("residue != 0")


def failed_assertions(postings: DataFrame, assertions: DataFrame) -> DataFrame:
    """Assertions (account, assert_date, balance) that differ from the sum of the postings before their day.

    Postings and assertions are put in one order per account and summed as they come, so no pair of them is built.
    """
    daily = postings.groupBy("account", F.col("day").alias("at")).agg(F.sum("number").alias("number"))
    rows = daily.select("account", "at", F.lit(1).alias("kind"), "number", F.lit(None).cast("decimal(18,4)").alias("balance"))
    rows = rows.unionByName(assertions.select("account", F.col("assert_date").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("decimal(18,4)").alias("number"), F.col("balance").cast("decimal(18,4)").alias("balance")))
    order = Window.partitionBy("account").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("actual", F.sum("number").over(order))
    return summed.where("balance IS NOT NULL AND balance != actual").select("account", F.col("at").alias("assert_date"), "balance", F.col("actual").cast("decimal(18,4)").alias("actual"))


def _either_holds(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def alike_names(names: DataFrame, least: float = 0.85) -> DataFrame:
    """The distinct pairs of (found, name) of which either holds the other or, where `own` says that it is the name itself, whose likeness (block_ratio) is `least` or more."""
    distinct = names.select("found", "name", "own").where("found != '' AND name != ''").distinct()
    holds = _either_holds(F.col("found"), F.col("name"))
    return distinct.where(holds).unionByName(distinct.where(~holds & F.col("own")).where(block_ratio(F.col("name"), F.col("found")) >= least))


def scorecard(predicted: DataFrame, truth: DataFrame, found: DataFrame, critical: DataFrame) -> DataFrame:
    """Flags per receipt: merchant, date, total, all critical items, header, everything.

    A merchant is right if it and the true name, or one of its alternates (merchant_any_of), hold one another, or if it and the true name are alike by 0.85; only
    letters and digits count, in any case. Likeness is worked out once for each distinct pair of names. A critical item is found if an item of
    the receipt has its price and either's description holds the other's, and, where both tables have a category and the critical item's is not null, either's category too.
    """
    p, t = predicted.alias("p"), truth.alias("t")
    joined = t.join(p, F.col("t.receipt_id") == F.col("p.receipt_id"), "left")
    plain = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    own = F.array(F.struct(F.col("t.merchant").alias("name"), F.lit(True).alias("own")))
    others = F.transform(F.coalesce("t.merchant_any_of", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(False).alias("own")))
    named = joined.select(F.col("t.receipt_id").alias("receipt_id"), plain(F.col("p.merchant")).alias("found"), F.explode(F.concat(own, others)).alias("n"))
    named = named.select("receipt_id", "found", plain(F.col("n.name")).alias("name"), "n.own")
    hits = named.join(alike_names(named), ["found", "name", "own"], "left_semi").select("receipt_id").distinct().withColumn("merchant_ok", F.lit(True))
    rows = joined.select(
        F.col("t.receipt_id").alias("receipt_id"),
        F.coalesce(F.col("p.receipt_date") == F.col("t.receipt_date"), F.col("t.receipt_date").isNull()).alias("date_ok"),
        F.coalesce(F.col("p.total") == F.col("t.total"), F.lit(False)).alias("total_ok"),
    )
    rows = rows.join(hits, "receipt_id", "left").select("receipt_id", F.coalesce("merchant_ok", F.lit(False)).alias("merchant_ok"), "date_ok", "total_ok")
    items = critical.alias("c").join(found.alias("f"), (F.col("c.receipt_id") == F.col("f.receipt_id")) & (F.col("c.price") == F.col("f.price")), "left")
    hit = _either_holds(F.upper("f.description"), F.upper("c.description"))
    if "category" in critical.columns and "category" in found.columns:
        hit = hit & (F.col("c.category").isNull() | _either_holds(F.col("f.category"), F.col("c.category")))
    hit = F.coalesce(hit, F.lit(False))
    each = items.groupBy(F.col("c.receipt_id").alias("receipt_id"), F.col("c.description").alias("description"), F.col("c.price").alias("price")).agg(F.max(hit).alias("hit"))
    items_ok = each.groupBy("receipt_id").agg(F.min("hit").alias("items_ok"))
    rows = rows.join(items_ok, "receipt_id", "left").withColumn("items_ok", F.coalesce("items_ok", F.lit(True)))
    header = F.col("merchant_ok") & F.col("date_ok") & F.col("total_ok")
    return rows.withColumn("header_ok", header).withColumn("all_ok", header & F.col("items_ok"))


def rates(card: DataFrame, *groups: str) -> DataFrame:
    """Shares of the flags by group."""
    flags = [c for c in card.columns if c.endswith("_ok")]
    return card.groupBy(*groups).agg(F.count("*").alias("receipts"), *[F.avg(F.col(c).cast("int")).alias(c.replace("_ok", "_rate")) for c in flags])
