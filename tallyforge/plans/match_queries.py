"""Queries of record linkage between receipts and transactions."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalars import MONEY
from tallyforge.operators import matching as M
from tallyforge.plans import views as V
from tallyforge.plans.queries import register

#: Names in canonical form, with their families: normalised, then the first alias hit.
NAMES_SQL = r"""
alias(place, family, canonical, alias) AS (VALUES (0, 'Red Goods', 'RED', 'RED'), (1, 'Plates', 'PLATES', 'PLATES'), (1, 'Plates', 'PLATES', 'HOT'), (1, 'Plates', 'PLATES', 'OLD'), (100, 'Rods Inc', 'RODS', 'RODS'), (100, 'Rods Inc', 'RODS', 'LARGE')),
raw AS (SELECT DISTINCT merchant AS name FROM receipt UNION SELECT DISTINCT payee FROM ledger),
nrm AS (SELECT name, regexp_replace(regexp_replace(rtrim(regexp_replace(name, '^(.*\S)\s+(?:(?:INC|LLC|LTD|CORP|CO)\.*|#?\d*\.*)$', '\1')), '^(.*[^, ])[, ]+[A-Z]{2,}$', '\1'), '[^A-Z0-9]', '', 'g') AS n FROM raw),
fam AS (SELECT name, min(place) AS place FROM nrm JOIN alias ON contains(n, alias) OR contains(alias, n) GROUP BY 1),
canon AS (SELECT nrm.name, coalesce(a.canonical, n) AS c, a.family AS f FROM nrm LEFT JOIN fam USING (name) LEFT JOIN (SELECT DISTINCT place, family, canonical FROM alias) a USING (place)),
word AS (SELECT name, list_distinct(regexp_extract_all(name, '[A-Z]{3,}')) AS w FROM raw),
alike AS (SELECT a.name AS merchant, b.name AS payee, CASE WHEN a.c = '' OR b.c = '' THEN 0.0 WHEN a.c = b.c AND (a.f IS NOT NULL OR b.f IS NOT NULL) THEN 1.0 WHEN contains(a.c, b.c) OR contains(b.c, a.c) THEN 0.9
    WHEN pre >= 4 THEN 0.5 + 0.4 * (pre / least(length(a.c), length(b.c))) WHEN common > 0 THEN 0.3 + 0.4 * (common / every) ELSE 0.0 END AS similarity,
    CASE WHEN a.c = b.c AND a.c <> '' THEN coalesce(a.f, b.f) END AS family
  FROM canon a, canon b, LATERAL (SELECT len(list_filter(range(1, least(length(a.c), length(b.c)) + 1), lambda k: left(a.c, k) = left(b.c, k))) AS pre,
    len(list_intersect((SELECT w FROM word WHERE name = a.name), (SELECT w FROM word WHERE name = b.name))) AS common,
    len(list_distinct(list_concat((SELECT w FROM word WHERE name = a.name), (SELECT w FROM word WHERE name = b.name)))) AS every))"""

PAIR_SQL = f"""{V.RECEIPT_SQL}, {NAMES_SQL},
r7 AS (SELECT *, unnest(CASE WHEN receipt_date IS NULL THEN NULL ELSE [CAST(receipt_date + CAST(k AS INTEGER) AS DATE) FOR k IN range(-7, 8)] END) AS day FROM receipt WHERE receipt_date IS NOT NULL),
near AS (SELECT receipt_id, txn_id, receipt_date, l.txn_date, merchant, payee, total, amount FROM r7 JOIN ledger l ON l.household = r7.household AND l.txn_date = r7.day AND abs(amount - total) <= greatest(2.0, total * 0.08)
  UNION ALL SELECT receipt_id, txn_id, receipt_date, l.txn_date, merchant, payee, total, amount FROM receipt JOIN ledger l ON l.household = receipt.household AND amount BETWEEN total - greatest(2.0, total * 0.08) AND total + greatest(2.0, total * 0.08) WHERE receipt_date IS NULL),
pair AS (SELECT near.*, similarity, family, abs(amount - total) AS gap, abs(datediff('day', receipt_date, txn_date)) AS days,
  greatest(CAST(0.10 AS DECIMAL(18,4)), CAST(trunc(total * 100) / 10000 AS DECIMAL(18,4))) AS strict_tol, greatest(CAST(2.0 AS DECIMAL(18,4)), CAST(trunc(total * 800) / 10000 AS DECIMAL(18,4))) AS wide_tol FROM near JOIN alike USING (merchant, payee)),
strict AS (SELECT receipt_id, txn_id, 0 AS tier, CASE WHEN days IS NULL THEN 0 ELSE 0.4 * (1 - days / 4) END + CASE WHEN gap = 0 THEN 0.4 ELSE 0.4 * (1 - CAST(gap AS DOUBLE) / CAST(strict_tol AS DOUBLE)) END + 0.2 * similarity AS confidence
  FROM pair WHERE (days IS NULL OR days <= 3) AND gap <= strict_tol AND similarity >= 0.3),
wide AS (SELECT receipt_id, txn_id, 1 AS tier, CASE WHEN days IS NULL THEN 0 ELSE 0.4 * (1 - days / 8) END + CASE WHEN gap = 0 THEN 0.4 ELSE 0.4 * (1 - CAST(gap AS DOUBLE) / CAST(wide_tol AS DOUBLE)) END + 0.2 * similarity AS confidence
  FROM pair WHERE gap <= wide_tol AND similarity >= 0.15),
manual AS (SELECT receipt_id, txn_id, 2 AS tier, least(0.75, 0.45 * CASE WHEN gap = 0 THEN 1 ELSE 1 - CAST(gap AS DOUBLE) / CAST(wide_tol AS DOUBLE) END + 0.35 * CASE WHEN days IS NULL THEN 0.5 ELSE 1 - days / 7 END + 0.2 * similarity) AS confidence
  FROM pair WHERE gap <= wide_tol)"""


#: A receipt is matched within its household's ledger.
OWNER = ("household",)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return V.receipts(spark, sf_dir).drop("__day"), V.ledger(spark, sf_dir), V.families(spark)


@register("j9_receipt_matches", f"WITH {PAIR_SQL} SELECT receipt_id, txn_id, round(confidence, 6) AS confidence FROM strict")
def j9_receipt_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_receipts(*_sides(spark, sf_dir), keys=OWNER).select("receipt_id", "txn_id", F.round("confidence", 6).alias("confidence"))


@register(
    "p15_match_details",
    f"""WITH {PAIR_SQL} SELECT p.receipt_id, p.txn_id, concat_ws(', ', CASE WHEN days IS NULL THEN 'date: unknown' WHEN days = 0 THEN 'date: exact match' ELSE 'date: ' || days || ' day(s) off' END,
  CASE WHEN gap = 0 THEN 'amount: exact match' ELSE 'amount: $' || CAST(CAST(gap AS DECIMAL(18,2)) AS VARCHAR) || ' off' END,
  CASE WHEN family IS NOT NULL THEN 'merchant: family match (' || family || ')' WHEN similarity > 0.8 THEN 'merchant: good match' ELSE 'merchant: partial match (' || CAST(round_even(similarity * 100, 0) AS INTEGER) || '%)' END) AS details
FROM pair p JOIN strict s ON s.receipt_id = p.receipt_id AND s.txn_id = p.txn_id""",
)
def p15_match_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_receipts(*_sides(spark, sf_dir), keys=OWNER).select("receipt_id", "txn_id", "details")


@register(
    "w4_ranked_candidates",
    f"WITH {PAIR_SQL}, q AS (SELECT receipt_id, txn_id, row_number() OVER (PARTITION BY receipt_id ORDER BY round(confidence, 9) DESC, txn_id) AS rank FROM wide) SELECT * FROM q WHERE rank <= 5",
)
def w4_ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.match_receipts(*_sides(spark, sf_dir), config=M.RELAXED, keys=OWNER).withColumn("confidence", F.round("confidence", 9))
    return M.rank_candidates(found).select("receipt_id", "txn_id", "rank")


@register(
    "j10_transaction_matches",
    f"WITH {PAIR_SQL}, q AS (SELECT receipt_id, txn_id, row_number() OVER (PARTITION BY txn_id ORDER BY round(confidence, 9) DESC, receipt_id) AS rank FROM strict) SELECT * FROM q WHERE rank <= 3",
)
def j10_transaction_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.match_receipts(*_sides(spark, sf_dir), keys=OWNER).withColumn("confidence", F.round("confidence", 9))
    return M.rank_candidates(found, "txn_id", 3).select("receipt_id", "txn_id", "rank")


@register(
    "j11_tiered_matches",
    f"""WITH {PAIR_SQL}, e AS (SELECT * FROM strict UNION ALL SELECT * FROM wide UNION ALL SELECT * FROM manual), b AS (SELECT receipt_id, min(tier) AS tier FROM e GROUP BY 1)
SELECT receipt_id, txn_id, round(confidence, 6) AS confidence, CASE tier WHEN 0 THEN 'strict' WHEN 1 THEN 'relaxed' ELSE 'fallback' END AS strength FROM e JOIN b USING (receipt_id, tier)""",
)
def j11_tiered_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_tiered(*_sides(spark, sf_dir), keys=OWNER).withColumn("confidence", F.round("confidence", 6))


@register(
    "j12_reserved_matches",
    f"""WITH RECURSIVE {PAIR_SQL}, o AS (SELECT household, receipt_id, txn_id, round(confidence, 9) AS confidence FROM strict JOIN receipt USING (receipt_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY household ORDER BY confidence DESC, md5(receipt_id || '-' || txn_id), receipt_id, txn_id) AS k FROM o),
g(household, k, receipt_id, txn_id, confidence, receipts, txns, free) AS (SELECT DISTINCT household, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, []::BIGINT[], []::BIGINT[], false FROM r
  UNION ALL SELECT r.household, r.k, r.receipt_id, r.txn_id, r.confidence, CASE WHEN g.free THEN list_append(g.receipts, g.receipt_id) ELSE g.receipts END, CASE WHEN g.free THEN list_append(g.txns, g.txn_id) ELSE g.txns END,
    NOT list_contains(g.receipts, r.receipt_id) AND NOT list_contains(g.txns, r.txn_id) AND NOT (g.free AND (g.receipt_id = r.receipt_id OR g.txn_id = r.txn_id)) FROM g JOIN r ON r.household = g.household AND r.k = g.k + 1)
SELECT receipt_id, txn_id, confidence FROM g WHERE free""",
)
def j12_reserved_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy by a total order."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(V.shared_folder(spark, "reserve"))
    return M.reserve_matches(M.match_receipts(*_sides(spark, sf_dir), keys=OWNER).withColumn("confidence", F.round("confidence", 9)))


@register(
    "j13_applied_matches",
    f"""WITH {V.RECEIPT_SQL}, e AS (SELECT receipt_id AS txn_id, CAST(total AS DECIMAL(18,4)) AS amount FROM receipt WHERE receipt_id % 3 = 0)
SELECT txn_id, payee, amount FROM ledger WHERE txn_id NOT IN (SELECT txn_id FROM e) UNION ALL SELECT txn_id, 'itemised', amount FROM e""",
)
def j13_applied_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, applied twice, which must not matter."""
    enriched = V.receipts(spark, sf_dir).where("receipt_id % 3 = 0").select(F.col("receipt_id").alias("txn_id"), F.lit("itemised").alias("payee"), F.col("total").alias("amount"))
    own = V.ledger(spark, sf_dir).select("txn_id", "payee", "amount")
    return M.apply_matches(M.apply_matches(own, enriched, ["txn_id"]), enriched, ["txn_id"])


@register(
    "j14_prefiltered_receipts",
    f"""WITH {V.RECEIPT_SQL}, q AS (SELECT txn_date AS day, amount FROM ledger WHERE txn_id % 20 = 0)
SELECT receipt_id FROM receipt r WHERE EXISTS (SELECT 1 FROM q WHERE abs(r.total - q.amount) <= 0.10 AND (r.receipt_date IS NULL OR abs(datediff('day', r.receipt_date, q.day)) <= 3))""",
)
def j14_prefiltered_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = V.ledger(spark, sf_dir).where("txn_id % 20 = 0").select(F.col("txn_date").alias("day"), "amount")
    return M.prefilter_receipts(V.receipts(spark, sf_dir), wanted).select("receipt_id")


TENDER_SQL = """
tender AS (SELECT l_orderkey AS receipt_id, CASE l_returnflag WHEN 'N' THEN 'card' WHEN 'A' THEN 'gift_card' ELSE 'cash' END AS kind, CAST(l_extendedprice AS DECIMAL(18,4)) AS amount FROM lineitem)"""


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "card").when(F.col("l_returnflag") == "A", "gift_card").otherwise("cash")
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("receipt_id"), kind.alias("kind"), F.col("l_extendedprice").cast(MONEY).alias("amount"))


@register(
    "a8_split_tenders",
    f"""WITH {TENDER_SQL}, s AS (SELECT receipt_id, sum(amount) FILTER (kind = 'card') AS card, sum(amount) FILTER (kind <> 'card') AS other FROM tender GROUP BY 1)
SELECT o_orderkey AS receipt_id, CAST(CASE WHEN card > 0 THEN card END AS DECIMAL(18,4)) AS card_amount, CAST(coalesce(other, 0) AS DECIMAL(18,4)) AS non_card,
  CAST(greatest(CAST(o_totalprice AS DECIMAL(18,4)) - coalesce(other, 0), 0) AS DECIMAL(18,4)) AS remaining FROM orders LEFT JOIN s ON o_orderkey = receipt_id""",
)
def a8_split_tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 and A9."""
    own = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"), F.col("o_totalprice").cast(MONEY).alias("total"))
    found = M.split_tender(own, tenders(spark, sf_dir))
    return found.select("receipt_id", "card_amount", "non_card", M.remaining_tender(F.col("total"), F.col("non_card")).alias("remaining"))


ITEMIZED_SQL = """
i AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS items FROM lineitem GROUP BY 1),
z AS (SELECT o_orderkey AS receipt_id, CAST(o_totalprice AS DECIMAL(18,4)) AS total, CAST(coalesce(items, 0) + CAST(o_orderkey % 3 AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS itemized FROM orders LEFT JOIN i ON o_orderkey = l_orderkey)"""


def itemized(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"), F.col("o_totalprice").cast(MONEY).alias("total"), (F.col("o_orderkey") % 3).cast(MONEY).alias("tax"))
    items = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("receipt_id"), F.col("l_extendedprice").cast(MONEY).alias("price"))
    return M.itemized_total(items, own)


@register("a6_itemized_totals", f"WITH {ITEMIZED_SQL} SELECT receipt_id, itemized, total - itemized < -0.01 AS over_total FROM z")
def a6_itemized_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 and A7."""
    return itemized(spark, sf_dir).select("receipt_id", "itemized", M.over_total(F.col("total"), F.col("itemized")).alias("over_total"))
