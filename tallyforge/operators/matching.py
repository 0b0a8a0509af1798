"""Record linkage between receipts and ledger transactions by date, amount and merchant.

Receipts: receipt_id, receipt_date (null: unknown), merchant, total, card_amount (null: not split), non_card.
Transactions: txn_id, txn_date, payee, amount (positive).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.scalars import MONEY, alpha_words, amount_tolerance, match_details, merchant_similarity
from tallyforge.operators.components import components
from tallyforge.operators.rules import canonical_merchants


@dataclass(frozen=True)
class MatchConfig:
    """days and amounts within which a pair may match, and the least likeness of its merchants."""

    days: int = 3
    amount: str = "0.10"
    share: str = "0.01"
    similarity: float = 0.30


STRICT = MatchConfig()
RELAXED = MatchConfig(7, "2.00", "0.08", 0.15)
#: Of the manual fallback: shares of amount, date and merchant, and the most that it can reach.
FALLBACK_WEIGHTS, FALLBACK_MOST = (0.45, 0.35, 0.20), 0.75


def split_tender(receipts: DataFrame, tenders: DataFrame) -> DataFrame:
    """card_amount, null if there is none, and non_card of each receipt, from (receipt_id, kind, amount)."""
    sums = tenders.groupBy("receipt_id").agg(
        F.sum(F.when(F.col("kind") == "card", F.col("amount"))).cast(MONEY).alias("__card"), F.coalesce(F.sum(F.when(F.col("kind") != "card", F.col("amount"))), F.lit(0)).cast(MONEY).alias("non_card")
    )
    joined = receipts.join(sums, "receipt_id", "left")
    return joined.select(*receipts.columns, F.when(F.col("__card") > 0, F.col("__card")).alias("card_amount"), F.coalesce("non_card", F.lit(0).cast(MONEY)).alias("non_card"))


def itemized_total(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """Sum of the items' prices and the tax; an item's price is its line's total, whatever its quantity."""
    sums = items.groupBy("receipt_id").agg(F.sum("price").alias("__items"))
    return receipts.join(sums, "receipt_id", "left").select(*receipts.columns, (F.coalesce("__items", F.lit(0)) + F.coalesce("tax", F.lit(0))).cast(MONEY).alias("itemized"))


def over_total(charge: Column, itemized: Column) -> Column:
    """The items exceed the charge by more than a cent, so the match is turned down."""
    return charge - itemized < Decimal("-0.01")


def remaining_tender(total: Column, others: Column) -> Column:
    """What other tenders leave of the total, at least zero."""
    return F.greatest((total - F.coalesce(others, F.lit(0))).cast(MONEY), F.lit(0).cast(MONEY))


def _with_merchants(frame: DataFrame, name: str, families: DataFrame, side: str) -> DataFrame:
    """Canonical name, family and words, worked out once for each distinct name."""
    names = canonical_merchants(frame, name, families).select(
        F.col("name").alias("__name"), F.col("canonical").alias(f"{side}_canonical"), F.col("family").alias(f"{side}_family"), alpha_words(F.col("name")).alias(f"{side}_words")
    )
    return frame.join(names, frame[name] == names["__name"], "left").drop("__name")


def _amount_buckets(amount: Column, absolute: str, share: str) -> tuple[Column, Column]:
    """Numbers of an amount's logarithmic and linear bucket: what lies within the share, or the absolute tolerance, on both sides of an amount spans two at most."""
    ratio = 2 * math.log(1 / (1 - 1.001 * float(share)))
    log, linear = F.floor(F.log(F.greatest(amount.cast("double"), F.lit(1e-4))) / ratio), F.floor(amount.cast("double") / (float(absolute) * 2.001))
    return log.cast("bigint"), linear.cast("bigint")


def _days() -> Column:
    return F.abs(F.datediff("txn_date", "receipt_date"))


def _span(day: Column, days: int, moved: int = 0) -> Column:
    return F.floor((F.unix_date(day) + moved) / (2 * days + 1))


def _looking(receipts: DataFrame, days: int, absolute: str, share: str, amount: str) -> tuple[DataFrame, DataFrame]:
    """A row of each dated receipt for each span and bucket that it looks in, four at most, and one of each undated receipt for each bucket."""
    receipts = receipts.withColumn("tolerance", amount_tolerance(F.col(amount), absolute, share))
    flat, reach = F.col("tolerance") <= F.lit(absolute).cast(MONEY), F.col("tolerance").cast("double") * 1.0001 + 1e-6
    (log_a, lin_a), (log_z, lin_z) = (_amount_buckets(F.col(amount).cast("double") + side * reach, absolute, share) for side in (-1, 1))
    numbers = F.sequence(F.when(flat, lin_a).otherwise(log_a), F.when(flat, lin_z).otherwise(log_z))
    near = F.explode(F.transform(numbers, lambda n: F.struct(flat.alias("flat"), n.alias("n"))))
    day = F.col("receipt_date")
    spans = F.explode(F.sequence(_span(day, days, -days), _span(day, days, days)))
    dated = receipts.where("receipt_date IS NOT NULL").withColumn("__span", spans).withColumn("bucket", near)
    return dated, receipts.where("receipt_date IS NULL").withColumn("bucket", near)


def candidate_pairs(receipts: DataFrame, txns: DataFrame, days: int, absolute: str, share: str, amount: str = "wanted", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within the days and the amount's tolerance, each once, by equi-joins only.

    A receipt looks in linear buckets if its tolerance is the absolute one, else in logarithmic ones, so it meets a transaction
    once. Buckets and spans of days are as wide as what may match, so a receipt looks in those of its least and greatest amount and day only,
    at most two of each; the pairs within the days are kept. One without a date meets the transactions of its buckets. `amount` is the receipt's amount to be matched. `keys` are columns of both sides that must be equal,
    such as the owner of a ledger: with them the pairs grow with the number of ledgers, and not with the square of all receipts.
    """
    dated, undated, columns = *_looking(receipts, days, absolute, share, amount), [*receipts.columns, "tolerance"]
    log_t, lin_t = _amount_buckets(F.col("amount"), absolute, share)
    own = F.array(F.struct(F.lit(False).alias("flat"), log_t.alias("n")), F.struct(F.lit(True).alias("flat"), lin_t.alias("n")))
    keyed = txns.withColumn("bucket", F.explode(own))
    gap = F.abs(F.col("amount") - F.col(amount)).cast(MONEY)
    columns += [c for c in txns.columns if c not in keys]
    by_day = dated.join(keyed.withColumn("__span", _span(F.col("txn_date"), days)), [*keys, "__span", "bucket"]).where(_days() <= days)
    pairs = by_day.select(*columns).unionByName(undated.join(keyed, [*keys, "bucket"]).select(*columns))
    return pairs.withColumn("gap", gap).where("gap <= tolerance")


def _similarity(pairs: DataFrame) -> DataFrame:
    known = F.col("r_family").isNotNull() | F.col("t_family").isNotNull()
    likeness = merchant_similarity(F.coalesce("r_canonical", F.lit("")), F.coalesce("t_canonical", F.lit("")), F.col("r_words"), F.col("t_words"), known)
    family = F.when((F.col("r_canonical") == F.col("t_canonical")) & (F.col("r_canonical") != ""), F.coalesce("r_family", "t_family"))
    return pairs.withColumn("similarity", F.coalesce(likeness, F.lit(0.0))).withColumn("matched_family", family)


def _judged(config: MatchConfig) -> tuple[Column, Column]:
    """Whether a candidate pair lies within a configuration, and its confidence.

    Date and amount count 0.4 each, in proportion to what they leave of their tolerance, and the merchant 0.2; an unknown date counts nothing.
    """
    tolerance, days = amount_tolerance(F.col("wanted"), config.amount, config.share), _days()
    within = (days.isNull() | (days <= config.days)) & (F.col("gap") <= tolerance) & (F.col("similarity") >= config.similarity)
    date_part = F.when(days.isNull(), 0.0).otherwise(0.4 * (1 - days / (config.days + 1)))
    amount_part = F.when(F.col("gap") == 0, 0.4).otherwise(0.4 * (1 - F.col("gap").cast("double") / tolerance.cast("double")))
    return within, date_part + amount_part + 0.2 * F.col("similarity")


def score_pairs(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    """Confidence and details of candidate pairs under one configuration; pairs outside it are left out."""
    within, confidence = _judged(config)
    non_card = F.when(F.col("card_amount").isNotNull(), F.col("non_card"))
    details = match_details(_days(), F.col("gap"), non_card, F.col("matched_family"), F.col("similarity"))
    return pairs.where(within).withColumn("confidence", confidence).withColumn("details", details)


def _prepared(receipts: DataFrame, txns: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    wanted = receipts.withColumn("wanted", F.coalesce("card_amount", "total"))
    return _with_merchants(wanted, "merchant", families, "r"), _with_merchants(txns.where("amount IS NOT NULL"), "payee", families, "t")


MATCHED = ["receipt_id", "txn_id", "confidence", "details"]


def match_receipts(receipts: DataFrame, txns: DataFrame, families: DataFrame, config: MatchConfig = STRICT, keys: tuple[str, ...] = ()) -> DataFrame:
    """receipt_id, txn_id, confidence and details of every pair of one ledger (`keys`) within the configuration."""
    r, t = _prepared(receipts, txns, families)
    return score_pairs(_similarity(candidate_pairs(r, t, config.days, config.amount, config.share, keys=keys)), config).select(*MATCHED)


def rank_candidates(matches: DataFrame, by: str = "receipt_id", k: int = 5) -> DataFrame:
    """The k best of each receipt, or, by txn_id, of each transaction; confidence first, then the other side's id."""
    other = "txn_id" if by == "receipt_id" else "receipt_id"
    order = Window.partitionBy(by).orderBy(F.desc("confidence"), other)
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _fallback() -> Column:
    """Confidence of the manual fallback; an unknown date counts half."""
    amount_part = F.when(F.col("gap") == 0, 1.0).otherwise(1 - F.col("gap").cast("double") / F.col("tolerance").cast("double"))
    date_part = F.when(_days().isNull(), 0.5).otherwise(1 - _days() / RELAXED.days)
    a, d, m = FALLBACK_WEIGHTS
    return F.least(a * amount_part + d * date_part + m * F.col("similarity"), F.lit(FALLBACK_MOST))


def match_tiered(receipts: DataFrame, txns: DataFrame, families: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Within a ledger (`keys`), strict matches; for receipts without any, relaxed ones; else those of the manual fallback, which asks for no merchant.

    One join over the widest window serves all three. The fallback goes by the total, and not by what was paid by card: only
    receipts on which these differ are joined again.
    """
    r, t = _prepared(receipts, txns, families)
    pairs = _similarity(candidate_pairs(r, t, RELAXED.days, RELAXED.amount, RELAXED.share, keys=keys))
    tiers = [F.when(within, F.struct(F.lit(k).alias("tier"), confidence.alias("confidence"))) for k, (within, confidence) in enumerate(map(_judged, (STRICT, RELAXED)))]
    tiers.append(F.when(F.col("wanted") == F.col("total"), F.struct(F.lit(2).alias("tier"), _fallback().alias("confidence"))))
    every = pairs.select("receipt_id", "txn_id", F.explode(F.array_compact(F.array(*tiers))).alias("t")).select("receipt_id", "txn_id", "t.*")
    split = _similarity(candidate_pairs(r.where("wanted != total"), t, RELAXED.days, RELAXED.amount, RELAXED.share, "total", keys))
    every = every.unionByName(split.select("receipt_id", "txn_id", F.lit(2).alias("tier"), _fallback().alias("confidence")))
    best = every.withColumn("least", F.min("tier").over(Window.partitionBy("receipt_id"))).where("tier = least")
    return best.select("receipt_id", "txn_id", "confidence", F.element_at(F.array(F.lit("strict"), F.lit("relaxed"), F.lit("fallback")), F.col("tier") + 1).alias("strength"))


#: Rounds before what is left is taken apart, and the most pairs of a part that one task goes through.
ROUNDS, MOST_PAIRS = 3, 1_000_000
RESERVED = ["receipt_id", "txn_id", "confidence"]


def _in_order(batch: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one part, best first, of which neither side is taken yet."""
    ordered = batch.sort_values(["confidence", "tie", "receipt_id", "txn_id"], ascending=[False, True, True, True])
    receipts, txns, kept = set(), set(), []
    for k, (r, t) in enumerate(zip(ordered["receipt_id"].to_list(), ordered["txn_id"].to_list(), strict=True)):
        if r not in receipts and t not in txns:
            receipts.add(r)
            txns.add(t)
            kept.append(k)
    return ordered.iloc[kept][RESERVED]


def _mutual(left: DataFrame) -> DataFrame:
    """The pairs that are the best of both their sides."""
    ranked = left.withColumn("place", F.struct(-F.col("confidence"), "tie", "receipt_id", "txn_id"))
    first = [ranked.groupBy(side).agg(F.min("place").alias("place")) for side in ("receipt_id", "txn_id")]
    return ranked.join(first[0], ["receipt_id", "place"], "left_semi").join(first[1], ["txn_id", "place"], "left_semi").select(*left.columns)


def reserve_matches(matches: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Each receipt and each transaction at most once, by confidence; equal confidences by a hash of the pair, then receipt_id, then txn_id.

    The result is that of taking the best pair again and again. Rounds keep the pairs that are best for both sides and drop those
    that share a side with them; the hash deals ties at random, so that of any number of equal receipts and transactions a constant share
    settles in a round. What a few rounds leave are chains in which each pair waits for a better one. Pairs that share no side, directly or through others,
    don't wait for each other, so the connected parts of what is left are gone through in order, one by one and many at a time. A part of more than `most_pairs` pairs goes
    back to the rounds, until it has fallen apart. Each round has a best pair, so the rounds end; they are written to the checkpoint folder.
    """
    left = matches.select(*RESERVED, F.md5(F.concat_ws("-", F.col("receipt_id").cast("string"), F.col("txn_id").cast("string"))).alias("tie"))
    schema, found = left.select(*RESERVED).schema, []
    while True:
        for _ in range(ROUNDS):
            left = left.checkpoint()
            if left.isEmpty():
                return reduce(DataFrame.unionByName, found) if found else left.select(*RESERVED)
            best = _mutual(left).checkpoint()
            found.append(best.select(*RESERVED))
            left = left.join(best.select("receipt_id"), "receipt_id", "left_anti").join(best.select("txn_id"), "txn_id", "left_anti").select(*left.columns)
        left = left.checkpoint()
        # The numbers of both sides may be the same.
        receipt, txn = (F.struct(F.lit(k).alias("side"), F.col(c).cast("string").alias("id")) for k, c in enumerate(("receipt_id", "txn_id")))
        roots = components(left.select(receipt.alias("u"), txn.alias("v")))
        parted = left.withColumn("node", receipt).join(roots, "node").drop("node")
        sizes = parted.groupBy("root").agg(F.count("*").alias("pairs"))
        parted = parted.join(sizes, "root").checkpoint()
        found.append(parted.where(F.col("pairs") <= most_pairs).groupBy("root").applyInPandas(_in_order, schema).checkpoint())
        left = parted.where(F.col("pairs") > most_pairs).select(*left.columns)


def apply_matches(ledger: DataFrame, enriched: DataFrame, key: list[str]) -> DataFrame:
    """Matched transactions are replaced by their enriched rows; applying twice changes nothing."""
    return ledger.join(enriched.select(*key), key, "left_anti").unionByName(enriched)


def prefilter_receipts(receipts: DataFrame, queries: DataFrame, days: int = 3, amount: str = "0.10") -> DataFrame:
    """Receipts near the date and amount of any query (day, amount); unknown dates pass by the amount alone."""
    width = float(amount) * 1.0001
    bucket = lambda c: F.floor(c.cast("double") / width)
    keyed = receipts.withColumn("__b", F.explode(F.array(*[bucket(F.col("total")) + d for d in (-1, 0, 1)])))
    wanted = queries.select("day", F.col("amount").alias("__amount"), bucket(F.col("amount")).alias("__b")).distinct()
    near = (F.abs(F.col("total") - F.col("__amount")) <= F.lit(amount).cast(MONEY)) & (F.col("receipt_date").isNull() | (F.abs(F.datediff("day", "receipt_date")) <= days))
    ids = keyed.join(wanted, "__b").where(near).select("receipt_id").distinct()
    return receipts.join(ids, "receipt_id", "left_semi")
