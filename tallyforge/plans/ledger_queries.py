"""Queries of rules, postings, accounts and checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import scalars as S
from tallyforge.operators import accounts, checks, postings, rules
from tallyforge.plans import views as V
from tallyforge.plans.queries import register

CATEGORY_SQL = f"""
{V.TXN_SQL}, {V.keyword_sql(V.MERCHANT_RULES)},
first_rule AS (SELECT merchant, arg_min(category, place) AS category FROM (SELECT DISTINCT merchant FROM txn) m JOIN rule ON contains(m.merchant, rule.keyword) GROUP BY 1),
categorised AS (SELECT t.*, coalesce(f.category, 'Expenses:Uncategorized') AS category FROM txn t LEFT JOIN first_rule f USING (merchant))"""


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.categorize(V.txns(spark, sf_dir), V.merchant_rules(spark))


@register(
    "j1_category_months",
    f"""WITH {CATEGORY_SQL},
small AS (SELECT *, CASE WHEN category = 'Expenses:Uncategorized' AND amount >= 0 AND amount < 2000 THEN 'Expenses:Shopping:NotAssigned' ELSE category END AS account FROM categorised),
side AS (SELECT account AS posting_account, txn_date, amount AS number FROM small UNION ALL SELECT 'Liabilities:Card', txn_date, -amount FROM small)
SELECT posting_account, strftime(txn_date, '%Y-%m') AS month, sum(number) AS total, count(*) AS n FROM side GROUP BY 1, 2""",
)
def j1_category_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorise, bucket small amounts, post both sides, and sum by account and month."""
    rows = categorised(spark, sf_dir).withColumn("category", S.bucket_small(F.col("category"), F.col("amount"), "2000.00")).withColumn("card", F.lit("Liabilities:Card"))
    both = postings.to_postings(rows, "card", "category", "amount")
    return both.groupBy("posting_account", F.date_format("txn_date", "yyyy-MM").alias("month")).agg(F.sum("number").alias("total"), F.count("*").alias("n"))


@register(
    "j2_chequing_categories",
    f"""WITH {V.TXN_SQL}, p(ord, pattern, account) AS (VALUES (0, 'LARGE', 'Expenses:Large'), (1, 'PLATE', 'Expenses:Plates'), (2, 'A', 'Expenses:A')),
f AS (SELECT merchant, arg_min(account, ord) AS category FROM (SELECT DISTINCT merchant FROM txn) m JOIN p ON contains(m.merchant, p.pattern) GROUP BY 1)
SELECT t.merchant, f.category, count(*) AS n FROM txn t LEFT JOIN f USING (merchant) GROUP BY 1, 2""",
)
def j2_chequing_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([(0, "LARGE", "Expenses:Large"), (1, "PLATE", "Expenses:Plates"), (2, "A", "Expenses:A")], "ord int, pattern string, account string")
    return rules.categorize_chequing(V.txns(spark, sf_dir), patterns, "merchant").groupBy("merchant", "category").agg(F.count("*").alias("n"))


@register(
    "f1_rule_callbacks",
    f"""WITH {CATEGORY_SQL} SELECT CASE WHEN amount < 0 THEN 'Income:Refunds' WHEN merchant LIKE '%GEAR%' AND amount > 50000 THEN 'Assets:Machines' ELSE category END AS category, count(*) AS n, sum(amount) AS total
FROM categorised GROUP BY 1""",
)
def f1_rule_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [F.when(F.col("amount") < 0, "Income:Refunds"), F.when(F.col("merchant").contains("GEAR") & (F.col("amount") > 50_000), "Assets:Machines")]
    return rules.categorize(V.txns(spark, sf_dir), V.merchant_rules(spark), callbacks=own).groupBy("category").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@register(
    "u1_known_merchants",
    f"""WITH r AS (SELECT * FROM (VALUES (0, 0, ['RED', 'HOT PLATE']), (0, 1, ['WIDGET', 'GIZMO']), (1, 0, ['RING']), (1, 1, ['BLUE', 'BOLT'])) x(layer, ord, k)),
k AS (SELECT layer, ord, unnest(k) AS keyword, generate_subscripts(k, 1) - 1 AS pos FROM r)
SELECT layer, ord, pos, keyword, (SELECT count(*) FROM part WHERE contains(upper(p_name), keyword)) AS parts FROM k""",
)
def u1_known_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 and U2, with the number of parts that each keyword names."""
    all_ = V.merchant_rules(spark)
    layers = rules.layer_rules(all_.where("layer = 0").drop("layer"), all_.where("layer = 1").drop("layer"))
    keywords = rules.known_merchants(layers)
    hits = V.table(spark, sf_dir, "part").join(F.broadcast(keywords), F.upper("p_name").contains(F.col("keyword")), "right")
    return hits.groupBy("layer", "ord", "pos", "keyword").agg(F.count("p_partkey").alias("parts"))


@register(
    "p4_clean_card",
    f"""WITH {V.TXN_SQL}, m AS (SELECT *, CASE order_id % 7 WHEN 0 THEN 'PAYMENT RECEIVED ' || merchant WHEN 1 THEN 'PAYMENT' WHEN 2 THEN 'INSTALLMENT PLAN FOR ' || merchant WHEN 3 THEN 'PRESTO FARE/' || merchant
  WHEN 4 THEN 'X TRSF FROM/DE ACCT/CPT 1' ELSE merchant END AS name FROM txn)
SELECT name, count(*) AS n, sum(amount) AS total FROM m WHERE NOT (contains(name, 'TRSF FROM/DE ACCT/CPT') OR contains(name, 'PAYMENT RECEIVED') OR name = 'PAYMENT' OR contains(name, 'INSTALLMENT PLAN FOR')
  OR (contains(name, 'PRESTO FARE') AND amount <= 0)) GROUP BY 1""",
)
def p4_clean_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 to P6."""
    k, m = F.col("order_id") % 7, F.col("merchant")
    name = F.when(k == 0, F.concat(F.lit("PAYMENT RECEIVED "), m)).when(k == 1, "PAYMENT").when(k == 2, F.concat(F.lit("INSTALLMENT PLAN FOR "), m)).when(k == 3, F.concat(F.lit("PRESTO FARE/"), m)).when(k == 4, "X TRSF FROM/DE ACCT/CPT 1")
    rows = V.txns(spark, sf_dir).withColumn("name", name.otherwise(m))
    return postings.clean_card(rows, "name").groupBy("name").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@register(
    "p12_normalized_merchants",
    r"""WITH n AS (SELECT c_custkey AS id, upper(trim(concat(CASE c_custkey % 3 WHEN 0 THEN 'Shop ' ELSE '' END, c_mktsegment, CASE c_custkey % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' #' || c_custkey WHEN 2 THEN ', ON' WHEN 3 THEN ' Toronto ON' ELSE ' & Co 12' END))) AS s FROM customer),
a AS (SELECT id, rtrim(regexp_replace(s, '^(.*\S)\s+(?:(?:INC|LLC|LTD|CORP|CO)\.*|#?\d*\.*)$', '\1')) AS s FROM n),
b AS (SELECT id, rtrim(regexp_replace(s, '[, ]+[A-Z]{2}$', '')) AS s FROM a),
c AS (SELECT id, regexp_replace(s, '^(.*[^, ])[, ]+[A-Z]{2,}$', '\1') AS s FROM b)
SELECT id, regexp_replace(s, '[^A-Z0-9]', '', 'g') AS normalized FROM c""",
)
def p12_normalized_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    tail = F.when(k == 0, " Inc.").when(k == 1, F.concat(F.lit(" #"), F.col("c_custkey").cast("string"))).when(k == 2, ", ON").when(k == 3, " Toronto ON").otherwise(" & Co 12")
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "Shop ").otherwise(""), "c_mktsegment", tail)
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.normalize_merchant(name).alias("normalized"))


@register(
    "p16_account_globs",
    """WITH a AS (SELECT c_custkey AS id, c_mktsegment || ':' || n_name || ':' || c_name AS account FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT id, account GLOB 'HOUSEHOLD:*' AS household, account GLOB '*:NATION_?:*' AS short_nation, account GLOB 'MACHINERY:NATION_1[0-5]:Customer#*7' AS some, contains(upper(translate(account, '-_ ', '')), 'NATION1') AS token FROM a""",
)
def p16_account_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16 and P17."""
    joined = V.table(spark, sf_dir, "customer").join(V.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = joined.select(F.col("c_custkey").alias("id"), F.concat_ws(":", "c_mktsegment", "n_name", "c_name").alias("account"))
    glob = lambda p: S.account_glob(F.col("account"), F.lit(p))
    return rows.select("id", glob("HOUSEHOLD:*").alias("household"), glob("*:NATION_?:*").alias("short_nation"), glob("MACHINERY:NATION_1[0-5]:Customer#*7").alias("some"), S.contains_token(F.col("account"), F.lit("nation-1")).alias("token"))


@register(
    "u6_canonical_merchants",
    r"""WITH f(place, family, alias) AS (VALUES (0, 'Red Goods', 'RED'), (0, 'Red Goods', 'RED'), (0, 'Red Goods', 'RED'), (1, 'Plates', 'PLATES'), (1, 'Plates', 'HOT'), (1, 'Plates', 'OLD'), (100, 'Rods Inc', 'RODS'), (100, 'Rods Inc', 'LARGE')),
fam(place, family, canonical) AS (VALUES (0, 'Red Goods', 'RED'), (1, 'Plates', 'PLATES'), (100, 'Rods Inc', 'RODS')),
n AS (SELECT DISTINCT upper(p_name) AS name FROM part),
m AS (SELECT name, regexp_replace(regexp_replace(name, '^(.*[^, ])[, ]+[A-Z]{2,}$', '\1'), '[^A-Z0-9]', '', 'g') AS normalized FROM n),
h AS (SELECT m.name, min(place) AS place FROM m JOIN f ON contains(normalized, alias) OR contains(alias, normalized) GROUP BY 1)
SELECT m.name, normalized, coalesce(canonical, normalized) AS canonical, family FROM m LEFT JOIN h USING (name) LEFT JOIN fam USING (place)""",
)
def u6_canonical_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = V.table(spark, sf_dir, "part").select(F.upper("p_name").alias("p_name"))
    return rules.canonical_merchants(names, "p_name", V.families(spark))


ITEM_SQL = """
k(place, keyword, category, tags, priority, exact_only) AS (VALUES (0, 'RED', 'red', ['colour'], 1, false), (1, 'PLATE', 'table', ['home'], 1, false), (1, 'RING', 'table', ['home'], 1, false),
  (2, 'R0D', 'tools', ['metal', 'home'], 2, false), (2, 'BOLT', 'tools', ['metal', 'home'], 2, false), (3, 'OLD', NULL, ['used'], 0, true), (100, 'HOT PLATE', 'Expenses:Kitchen', [], 1, true)),
n AS (SELECT DISTINCT p_name FROM part),
h AS (SELECT *, contains(' ' || upper(p_name) || ' ', ' ' || keyword || ' ') AS exact FROM n, k
  WHERE contains(' ' || upper(p_name) || ' ', ' ' || keyword || ' ') OR (NOT exact_only AND contains(translate(upper(p_name), '0D', 'OO'), translate(keyword, '0D', 'OO')))),
best AS (SELECT p_name, arg_max(category, (priority, exact, length(keyword), -place)) FILTER (category IS NOT NULL) AS category FROM h GROUP BY 1),
rule_tags AS (SELECT DISTINCT p_name, place, tags FROM h WHERE len(tags) > 0),
tag AS (SELECT p_name, unnest(tags) AS tag, place * 10 + generate_subscripts(tags, 1) AS spot FROM rule_tags),
tag1 AS (SELECT p_name, tag, min(spot) AS spot FROM tag GROUP BY 1, 2),
tagged AS (SELECT p_name, string_agg(tag, ',' ORDER BY spot) AS tags FROM tag1 GROUP BY 1),
item AS (SELECT p_name, category, coalesce(tags, '') AS tags FROM best LEFT JOIN tagged USING (p_name) WHERE category IS NOT NULL OR tags IS NOT NULL)"""


@register("j15_item_categories", f"WITH {ITEM_SQL} SELECT p_name, category, tags FROM item")
def j15_item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 and J16."""
    found = rules.classify_items(V.table(spark, sf_dir, "part"), V.item_rules(spark), "p_name")
    return found.select("p_name", "category", F.array_join("tags", ",").alias("tags"))


@register(
    "j17_item_accounts",
    f"""WITH {ITEM_SQL}, a(key, account) AS (VALUES ('red', 'Expenses:Red'), ('table', 'Expenses:Home'), ('tools', 'Expenses:Tools'), ('home', 'Expenses:Home'), ('used', 'Expenses:Used')),
w AS (SELECT p_name, 0 AS pos, category AS key FROM item UNION ALL SELECT p_name, spot + 1, tag FROM tag1),
r AS (SELECT p_name, arg_min(CASE WHEN starts_with(w.key, 'Expenses:') THEN w.key ELSE account END, pos) AS account FROM w LEFT JOIN a USING (key) WHERE account IS NOT NULL OR starts_with(w.key, 'Expenses:') GROUP BY 1),
i AS (SELECT p_name, coalesce(r.account, 'Expenses:FIXME') AS account FROM item LEFT JOIN r USING (p_name))
SELECT account, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS total FROM lineitem JOIN part ON l_partkey = p_partkey JOIN i USING (p_name) GROUP BY 1""",
)
def j17_item_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17 over the lines of all orders."""
    part = V.table(spark, sf_dir, "part")
    found = rules.category_accounts(rules.classify_items(part, V.item_rules(spark), "p_name"), V.category_accounts(spark))
    lines = V.table(spark, sf_dir, "lineitem").join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(found, "p_name")
    return lines.groupBy("account").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast(S.MONEY)).alias("total"))


@register(
    "j18_account_categories",
    """WITH m AS (SELECT c_mktsegment AS account, c_name AS key, c_custkey AS ord FROM customer) SELECT account, arg_max(key, ord) AS key FROM m GROUP BY 1""",
)
def j18_account_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.account_categories(V.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("account"), F.col("c_name").alias("key"), F.col("c_custkey").alias("ord")))


@register(
    "u4_item_categories",
    """WITH m AS (SELECT c_mktsegment AS key, arg_max(c_name, c_custkey) AS account FROM customer GROUP BY 1) SELECT key, account FROM m UNION SELECT 'Expenses:Kitchen', 'Expenses:Kitchen'""",
)
def u4_item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.list_item_categories(V.item_rules(spark), V.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("account"), F.col("c_custkey").alias("ord")))


EDIT_SQL = f"""{CATEGORY_SQL},
src AS (SELECT txn_date, merchant AS payee, amount, min(category) AS category, count(*) AS n FROM categorised GROUP BY 1, 2, 3),
edit AS (SELECT txn_date, payee, amount, k AS ord, CASE WHEN k = 0 THEN 'Expenses:Edited' END AS category, CASE WHEN k = 1 THEN CAST(amount + 1 AS DECIMAL(18,4)) END AS new_amount, k = 2 AS deleted
  FROM src, (VALUES (0), (1), (2)) x(k) WHERE day(txn_date) % 4 = k OR (day(txn_date) % 8 = 5 AND k < 2)),
last AS (SELECT txn_date, payee, amount, max(ord) AS ord FROM edit GROUP BY 1, 2, 3)"""


@register(
    "j7_applied_edits",
    f"""WITH {EDIT_SQL}, j AS (SELECT s.*, e.category AS c2, e.new_amount, e.deleted FROM src s LEFT JOIN last USING (txn_date, payee, amount) LEFT JOIN edit e USING (txn_date, payee, amount, ord))
SELECT coalesce(c2, category) AS category, count(*) AS n, sum(coalesce(new_amount, amount)) AS total FROM j WHERE NOT coalesce(deleted, false) GROUP BY 1""",
)
def j7_applied_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = categorised(spark, sf_dir).groupBy("txn_date", F.col("merchant").alias("payee"), "amount").agg(F.min("category").alias("category"), F.count("*").alias("n"))
    day = F.dayofmonth("txn_date")
    each = rows.select("txn_date", "payee", "amount", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ord")).where((day % 4 == F.col("ord")) | ((day % 8 == 5) & (F.col("ord") < 2)))
    edits = each.select("*", F.when(F.col("ord") == 0, "Expenses:Edited").alias("category"), F.when(F.col("ord") == 1, (F.col("amount") + 1).cast(S.MONEY)).alias("new_amount"), (F.col("ord") == 2).alias("deleted"))
    return postings.apply_edits(rows, edits).groupBy("category").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


BALANCE_SQL = f"""
run AS (SELECT {V.EVENT_ACCOUNT} AS account, CAST(ts AS DATE) + 1 AS day, event_id AS row_idx, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY event_id) AS DECIMAL(18,4)) AS balance FROM events),
first_bal AS (SELECT account, day, arg_min(balance, row_idx) AS balance FROM run GROUP BY 1, 2)"""


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = V.events(spark, sf_dir).withColumn("balance", F.sum(F.col("value").cast(S.MONEY)).over(order).cast(S.MONEY))
    return rows.select(F.concat(F.lit("Assets:User:"), F.col("user_id").cast("string")).alias("account"), S.next_day(F.col("ts").cast("date")).alias("day"), F.col("event_id").alias("row_idx"), "balance")


@register("a5_first_balances", f"WITH {BALANCE_SQL} SELECT account, day, balance FROM first_bal")
def a5_first_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 and P9."""
    return postings.first_balance_per_day(balances(spark, sf_dir))


@register(
    "j8_quiet_day_balances",
    f"""WITH {BALANCE_SQL}, busy AS (SELECT {V.EVENT_ACCOUNT} AS account, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('purchase', 'view'))
SELECT account, day, balance FROM first_bal f WHERE NOT EXISTS (SELECT 1 FROM busy b WHERE b.account = f.account AND b.day = f.day)""",
)
def j8_quiet_day_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = V.events(spark, sf_dir).select(F.concat(F.lit("Assets:User:"), F.col("user_id").cast("string")).alias("account"), F.col("ts").cast("date").alias("day"), "event_type")
    return postings.quiet_day_balances(postings.first_balance_per_day(balances(spark, sf_dir)), dated.where("event_type = 'purchase'"), dated.where("event_type = 'view'"))


@register("a3_transaction_dates", f"SELECT DISTINCT {V.EVENT_ACCOUNT} AS account, CAST(ts AS DATE) AS day FROM events")
def a3_transaction_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.transaction_dates(V.events(spark, sf_dir).select(F.concat(F.lit("Assets:User:"), F.col("user_id").cast("string")).alias("account"), F.col("ts").cast("date").alias("day")))


@register("a4_open_accounts", f"WITH {V.ACCOUNT_EVENT_SQL} SELECT account FROM open_account")
def a4_open_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.open_accounts(V.account_events(spark, sf_dir), "2024-01-25")


@register(
    "a1_statement_ranges",
    f"WITH {V.TXN_SQL} SELECT merchant, min(txn_date) AS range_start, max(txn_date) AS range_end, max(txn_date) AS as_of FROM txn GROUP BY 1",
)
def a1_statement_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 and A2."""
    rows = V.txns(spark, sf_dir)
    return postings.statement_range(rows, "merchant").join(postings.statement_as_of(rows, "merchant"), "merchant")


RESOLUTION_SQL = f"""{V.ACCOUNT_EVENT_SQL},
d AS (SELECT event_id, CAST(ts AS DATE) AS txn_date, 'pay ' || CASE user_id % 4 WHEN 0 THEN 'Bank One card' WHEN 1 THEN 'store two' WHEN 2 THEN 'bank one store TWO' ELSE 'nobody' END || ' ' || CAST(user_id % 20 AS VARCHAR) AS description, CAST(value AS DECIMAL(18,4)) AS amount FROM events),
rule(ord, pattern, pat) AS (VALUES (0, 'STORE TWO 1', 'Assets:User:?*1'), (1, 'BANK ONE', 'Assets:User:[1-8]*'), (2, 'STORE TWO', 'Assets:User:9'), (2, 'STORE TWO', 'Assets:User:9'), (3, 'NOBODY 3', 'Assets:None*')),
acc AS (SELECT pattern, list(DISTINCT account ORDER BY account) AS accounts FROM rule JOIN open_account ON account GLOB pat GROUP BY 1),
hit AS (SELECT description, arg_min(pattern, ord) AS pattern FROM (SELECT DISTINCT description FROM d) x JOIN rule ON contains(upper(description), pattern) GROUP BY 1),
res AS (SELECT x.description, hit.pattern, coalesce(len(accounts), 0) AS n, accounts FROM (SELECT DISTINCT description FROM d) x LEFT JOIN hit USING (description) LEFT JOIN acc USING (pattern))"""
PAYMENT_RULES = [(0, "STORE TWO 1", ["Assets:User:?*1"]), (1, "BANK ONE", ["Assets:User:[1-8]*"]), (2, "STORE TWO", ["Assets:User:9"]), (3, "NOBODY 3", ["Assets:None*"])]


def payments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("user_id") % 4
    who = F.when(k == 0, "Bank One card").when(k == 1, "store two").when(k == 2, "bank one store TWO").otherwise("nobody")
    rows = V.events(spark, sf_dir).select(
        "event_id", F.col("ts").cast("date").alias("txn_date"), F.concat(F.lit("pay "), who, F.lit(" "), (F.col("user_id") % 20).cast("string")).alias("description"), F.col("value").cast(S.MONEY).alias("amount")
    )
    open_ = accounts.open_accounts(V.account_events(spark, sf_dir), "2024-01-25")
    return rows, accounts.resolve_payment_account(rows, spark.createDataFrame(PAYMENT_RULES, "ord int, pattern string, account_globs array<string>"), open_)


@register(
    "j3_payment_accounts",
    f"""WITH {RESOLUTION_SQL} SELECT description, CASE WHEN n = 0 THEN 'no_match' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS kind, pattern, CASE WHEN n = 1 THEN accounts[1] END AS account,
CASE WHEN n > 1 THEN array_to_string(accounts, ',') ELSE '' END AS candidates FROM res""",
)
def j3_payment_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments(spark, sf_dir)[1].withColumn("candidates", F.array_join("candidates", ","))


TRANSFER_RULES = [(0, "ALPHA", ["Assets:User:2*"]), (1, "BETA", ["Assets:User:31", "Assets:User:1"]), (2, "GAMMA 4", ["Assets:User:4*"])]
TRANSFER_SQL = f"""{V.ACCOUNT_EVENT_SQL},
d AS (SELECT event_id, {V.EVENT_ACCOUNT} AS source, CASE user_id % 6 WHEN 0 THEN 'Transfer to Alpha' WHEN 1 THEN 'BETA transfer from alpha' WHEN 2 THEN 'transfer to beta visa' WHEN 3 THEN 'transfer to gamma 4 beta' WHEN 4 THEN 'transfer to beta' ELSE 'other' END AS description FROM events),
p AS (SELECT DISTINCT description, source FROM d),
rule(ord, label, pat) AS (VALUES (0, 'ALPHA', 'Assets:User:2*'), (1, 'BETA', 'Assets:User:31'), (1, 'BETA', 'Assets:User:1'), (2, 'GAMMA 4', 'Assets:User:4*')),
s AS (SELECT *, upper(description) AS u, CASE WHEN contains(upper(description), 'TRANSFER TO') THEN substr(upper(description), strpos(upper(description), 'TRANSFER TO') + 11) ELSE substr(upper(description), strpos(upper(description), 'TRANSFER FROM') + 13) END AS seg FROM p
  WHERE (contains(upper(description), 'TRANSFER TO') OR contains(upper(description), 'TRANSFER FROM')) AND NOT regexp_matches(upper(description), 'MASTERCARD|VISA|AMEX|CREDIT CARD')),
h AS (SELECT DISTINCT description, source, label, CASE WHEN contains(seg, label) THEN 0 ELSE 100 END + ord AS place FROM s JOIN rule ON contains(u, label)),
a AS (SELECT h.*, (SELECT list(DISTINCT o.account ORDER BY o.account) FROM rule r JOIN open_account o ON o.account GLOB r.pat WHERE r.label = h.label AND o.account <> h.source) AS accounts FROM h),
c AS (SELECT description, source, arg_min(label, place) FILTER (len(accounts) > 0) AS first, arg_max(label, place) AS last FROM a GROUP BY 1, 2),
f AS (SELECT c.description, c.source, coalesce(first, last) AS pattern, a.accounts FROM c LEFT JOIN a ON a.description = c.description AND a.source = c.source AND a.label = c.first),
g AS (SELECT *, list_filter(accounts, lambda x: contains(upper(translate(x, '-_ ', '')), replace(pattern, ' ', ''))) AS own FROM f),
res AS (SELECT p.description, p.source, pattern, CASE WHEN len(accounts) > 1 AND len(own) = 1 THEN own ELSE accounts END AS accounts FROM p LEFT JOIN g USING (description, source))"""


@register(
    "j4_transfer_accounts",
    f"""WITH {TRANSFER_SQL} SELECT description, source, pattern, CASE WHEN coalesce(len(accounts), 0) = 0 THEN 'no_match' WHEN len(accounts) = 1 THEN 'resolved' ELSE 'ambiguous' END AS kind,
CASE WHEN len(accounts) = 1 THEN accounts[1] END AS account, CASE WHEN len(accounts) > 1 THEN array_to_string(accounts, ',') ELSE '' END AS candidates FROM res""",
)
def j4_transfer_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers(spark, sf_dir)[1].withColumn("candidates", F.array_join("candidates", ","))


def transfers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("user_id") % 6
    text = F.when(k == 0, "Transfer to Alpha").when(k == 1, "BETA transfer from alpha").when(k == 2, "transfer to beta visa").when(k == 3, "transfer to gamma 4 beta").when(k == 4, "transfer to beta").otherwise("other")
    rows = V.events(spark, sf_dir).select("event_id", F.col("ts").cast("date").alias("txn_date"), F.concat(F.lit("Assets:User:"), F.col("user_id").cast("string")).alias("source_account"), text.alias("description"), F.col("value").cast(S.MONEY).alias("amount"))
    open_ = accounts.open_accounts(V.account_events(spark, sf_dir), "2024-01-25")
    return rows, accounts.resolve_transfer_account(rows, spark.createDataFrame(TRANSFER_RULES, "ord int, label string, account_globs array<string>"), open_)


def _renamed(sql: str, prefix: str, *names: str) -> str:
    return re.sub(rf"\b({'|'.join(names)})\b", rf"{prefix}\1", sql)


#: Payments, transfers, and descriptions that are worded as both, each third of the events; resolutions as in J3 and J4, over these.
DECIDED_SQL = f"""{V.ACCOUNT_EVENT_SQL},
pd AS (SELECT event_id, description FROM ({RESOLUTION_SQL[RESOLUTION_SQL.index("SELECT event_id, CAST(ts") : RESOLUTION_SQL.index("FROM events),")]} FROM events)),
td AS (SELECT event_id, description FROM ({TRANSFER_SQL[TRANSFER_SQL.index("SELECT event_id, ") : TRANSFER_SQL.index("FROM events),")]} FROM events)),
d AS (SELECT event_id, CAST(ts AS DATE) AS txn_date, {V.EVENT_ACCOUNT} AS source, CASE event_id % 3 WHEN 0 THEN pd.description WHEN 1 THEN td.description ELSE td.description || ' ' || pd.description END AS description, CAST(value AS DECIMAL(18,4)) AS amount
  FROM events JOIN pd USING (event_id) JOIN td USING (event_id)),
{_renamed(RESOLUTION_SQL[RESOLUTION_SQL.index("rule(ord, pattern") :], "p_", "rule", "acc", "hit", "res")},
{_renamed(TRANSFER_SQL[TRANSFER_SQL.index("p AS (SELECT DISTINCT") :], "t_", "p", "rule", "s", "h", "a", "c", "f", "g", "res")},
o AS (SELECT DISTINCT txn_date, description, amount, CASE WHEN event_id % 20 = 0 THEN 'payment' ELSE 'transfer' END AS kind FROM d WHERE event_id % 10 = 0)"""


def decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Transactions, overrides, resolutions of payments and of transfers, not listed, and the lists of both."""
    pay, move = payments(spark, sf_dir)[0], transfers(spark, sf_dir)[0]
    rows = move.withColumnRenamed("description", "moved").join(pay.select("event_id", F.col("description").alias("paid")), "event_id")
    k = F.col("event_id") % 3
    rows = rows.select("event_id", "txn_date", "source_account", "amount", F.when(k == 0, F.col("paid")).when(k == 1, F.col("moved")).otherwise(F.concat_ws(" ", "moved", "paid")).alias("description"))
    open_ = accounts.open_accounts(V.account_events(spark, sf_dir), "2024-01-25")
    payment_rules = spark.createDataFrame(PAYMENT_RULES, "ord int, pattern string, account_globs array<string>")
    transfer_rules = spark.createDataFrame(TRANSFER_RULES, "ord int, label string, account_globs array<string>")
    paid = accounts.resolve_payment_account(rows, payment_rules, open_, listed=False)
    moved = accounts.resolve_transfer_account(rows, transfer_rules, open_, listed=False)
    lists = accounts.candidate_lists("payment", payment_rules, "pattern", open_).unionByName(accounts.candidate_lists("transfer", transfer_rules, "label", open_))
    kind = F.when(F.col("event_id") % 20 == 0, "payment").otherwise("transfer")
    overrides = rows.where("event_id % 10 = 0").select(kind.alias("kind"), "txn_date", "description", "amount", F.concat(F.lit("Override:"), kind).alias("account"))
    return rows, overrides, paid, moved, lists


@register(
    "j5_counter_accounts",
    f"""WITH {DECIDED_SQL}, j AS (SELECT d.*, CASE WHEN op.kind IS NOT NULL THEN 'Override:payment' WHEN p.n = 1 THEN p.accounts[1] WHEN ot.kind IS NOT NULL THEN 'Override:transfer' WHEN len(t.accounts) = 1 THEN t.accounts[1]
    WHEN d.amount > 50 THEN 'Expenses:Large' ELSE 'Expenses:Uncategorized' END AS counter_account
  FROM d LEFT JOIN o op ON op.kind = 'payment' AND op.txn_date = d.txn_date AND op.description = d.description AND op.amount = d.amount LEFT JOIN o ot ON ot.kind = 'transfer' AND ot.txn_date = d.txn_date AND ot.description = d.description AND ot.amount = d.amount
  LEFT JOIN p_res p ON p.description = d.description LEFT JOIN t_res t ON t.description = d.description AND t.source = d.source)
SELECT counter_account, count(*) AS n, sum(amount) AS total FROM j GROUP BY 1""",
)
def j5_counter_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 over payments, transfers and both: all six ways to an account."""
    rows, overrides, paid, moved, _ = decided(spark, sf_dir)
    rows = rows.withColumn("category", F.when(F.col("amount") > 50, "Expenses:Large"))
    return accounts.counter_account(rows, overrides, paid, moved).groupBy("counter_account").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@register(
    "j6_pending_decisions",
    f"""WITH {DECIDED_SQL}, x AS (SELECT 'payment' AS kind, pattern, txn_date, description, amount, array_to_string(accounts, ',') AS candidates FROM d JOIN p_res USING (description) WHERE n > 1
  UNION SELECT 'transfer', pattern, txn_date, description, amount, array_to_string(accounts, ',') FROM d JOIN t_res USING (description, source) WHERE len(accounts) > 1 AND description NOT IN (SELECT description FROM p_res WHERE n > 0))
SELECT kind, pattern, txn_date, description, amount, min(candidates) AS candidates FROM x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.kind = x.kind AND o.txn_date = x.txn_date AND o.description = x.description AND o.amount = x.amount) GROUP BY ALL""",
)
def j6_pending_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 and U5 over payments, transfers and both."""
    return accounts.pending_decisions(*decided(spark, sf_dir)).withColumn("candidates", F.array_join("candidates", ","))


@register(
    "j19_preferred_accounts",
    """WITH c AS (SELECT c_mktsegment AS file, n_name || ':' || c_name AS account FROM customer JOIN nation ON c_nationkey = n_nationkey),
t(file, ord, token) AS (VALUES ('HOUSEHOLD', 0, 'nation 99'), ('HOUSEHOLD', 1, 'nation-7'), ('MACHINERY', 0, 'none'), ('FURNITURE', 0, 'NATION_1')),
h AS (SELECT c.file, ord, account FROM c JOIN t USING (file) WHERE contains(upper(translate(account, '-_ ', '')), upper(translate(token, '-_ ', '')))),
m AS (SELECT file, min(ord) AS ord FROM h GROUP BY 1)
SELECT DISTINCT file, account FROM h JOIN m USING (file, ord) UNION ALL SELECT file, account FROM c WHERE file NOT IN (SELECT file FROM m)""",
)
def j19_preferred_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = V.table(spark, sf_dir, "customer").join(V.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    candidates = joined.select(F.col("c_mktsegment").alias("file"), F.concat_ws(":", "n_name", "c_name").alias("account"))
    tokens = spark.createDataFrame([("HOUSEHOLD", 0, "nation 99"), ("HOUSEHOLD", 1, "nation-7"), ("MACHINERY", 0, "none"), ("FURNITURE", 0, "NATION_1")], "file string, ord int, token string")
    return accounts.prefer_accounts(candidates, tokens)


#: The longest block that two texts share, as (length, minus its place in the first, minus its place in the second): of equal lengths the earliest in the first, then in the second.
LONGEST = """list_max(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({b}) + 1), lambda j:
  {{{{'k': len(list_filter(range(1, least(length({a}) - i, length({b}) - j) + 2), lambda n: substr({a}, i, n) = substr({b}, j, n))), 'i': -i, 'j': -j}}}}))))""".replace("{{{{", "{{").replace("}}}}", "}}")


@register(
    "j20_suggested_accounts",
    f"""WITH RECURSIVE a AS (SELECT c_mktsegment || ':' || n_name || ':' || c_name AS account FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 > 0),
u AS (SELECT c_mktsegment || ':' || n_name || ':' || c_name AS unknown, c_mktsegment || ':' || n_name AS parent, c_mktsegment AS root FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 0),
near AS (SELECT unknown, account, 2 AS class FROM u JOIN a ON starts_with(account, parent || ':')),
pair AS (SELECT * FROM near UNION ALL SELECT unknown, account, 3 FROM u JOIN a ON starts_with(account, root || ':') AND NOT starts_with(account, parent || ':') WHERE unknown NOT IN (SELECT unknown FROM near GROUP BY 1 HAVING count(*) >= 3)),
seg(unknown, account, a, b, best) AS (SELECT unknown, account, unknown, account, {LONGEST.format(a="unknown", b="account")} FROM pair
  UNION ALL SELECT unknown, account, a, b, {LONGEST.format(a="a", b="b")} FROM (SELECT unknown, account, unnest([a[:-best.i - 1], a[best.k - best.i:]]) AS a, unnest([b[:-best.j - 1], b[best.k - best.j:]]) AS b FROM seg WHERE best.k > 0) x),
scored AS (SELECT p.unknown, p.account, any_value(class) AS class, 2 * sum(coalesce(best.k, 0)) / (length(p.unknown) + length(p.account)) AS ratio FROM pair p JOIN seg s ON s.unknown = p.unknown AND s.account = p.account GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY unknown, class ORDER BY ratio DESC, account DESC) AS best FROM scored),
r AS (SELECT unknown, account, row_number() OVER (PARTITION BY unknown ORDER BY class, ratio DESC, account DESC) AS rank FROM g)
SELECT * FROM r WHERE rank <= 3""",
)
def j20_suggested_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = V.table(spark, sf_dir, "customer").join(V.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(":", "c_mktsegment", "n_name", "c_name").alias("account"))
    return accounts.suggest_accounts(joined.where("c_custkey % 50 = 0").select(F.col("account").alias("unknown")), joined.where("c_custkey % 50 > 0"))


LEDGER_SQL = f"""{CATEGORY_SQL},
post AS (SELECT order_id, 'Liabilities:Card' AS account, txn_date AS day, CAST(-amount AS DECIMAL(18,4)) AS number, 'CAD' AS currency FROM categorised
  UNION ALL SELECT order_id, category, txn_date, CAST(amount + CASE WHEN order_id % 100 = 7 THEN 1 ELSE 0 END AS DECIMAL(18,4)), 'CAD' FROM categorised)"""


def posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = categorised(spark, sf_dir).withColumn("card", F.lit("Liabilities:Card"))
    both = postings.to_postings(rows, "card", "category", "amount")
    number = F.when((F.col("pos") == 1) & (F.col("order_id") % 100 == 7), F.col("number") + 1).otherwise(F.col("number")).cast(S.MONEY)
    return both.select("order_id", "line", "pos", F.col("posting_account").alias("account"), F.col("txn_date").alias("day"), number.alias("number"), F.lit("CAD").alias("currency"))


@register("j23_unbalanced", f"WITH {LEDGER_SQL} SELECT order_id, currency, sum(number) AS residue FROM post GROUP BY 1, 2 HAVING sum(number) <> 0")
def j23_unbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unbalanced(posted(spark, sf_dir), ["order_id"])


@register("j23_unknown_accounts", f"WITH {LEDGER_SQL} SELECT account, count(*) AS n FROM post WHERE account NOT IN ('Liabilities:Card', 'Expenses:Red', 'Expenses:Hardware') GROUP BY 1")
def j23_unknown_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("Liabilities:Card",), ("Expenses:Red",), ("Expenses:Hardware",)], "account string")
    return checks.unknown_accounts(posted(spark, sf_dir), known).groupBy("account").agg(F.count("*").alias("n"))


@register(
    "j23_inactive_postings",
    f"""WITH p AS (SELECT event_id, {V.EVENT_ACCOUNT} AS account, CAST(ts AS DATE) AS day FROM events WHERE event_type NOT IN ('signup', 'error')), {V.ACCOUNT_EVENT_SQL},
s AS (SELECT event_id, p.account, p.day, max(event_date) FILTER (kind = 'open' AND event_date <= day) AS opened, max(event_date) FILTER (kind = 'close' AND event_date < day) AS closed, count(*) FILTER (kind = 'open') AS opens
  FROM p LEFT JOIN account_event e ON e.account = p.account GROUP BY 1, 2, 3)
SELECT event_id, account, day, CASE WHEN opens = 0 THEN 'unknown' WHEN closed IS NOT NULL AND (opened IS NULL OR closed >= opened) THEN 'closed' ELSE 'not yet open' END AS reason
FROM s WHERE opens = 0 OR opened IS NULL OR closed >= opened""",
)
def j23_inactive_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are no account's opening or closing are postings of their day."""
    own = V.events(spark, sf_dir).where("event_type NOT IN ('signup', 'error')")
    rows = own.select("event_id", F.concat(F.lit("Assets:User:"), F.col("user_id").cast("string")).alias("account"), F.col("ts").cast("date").alias("day"))
    return checks.inactive_postings(rows, V.account_events(spark, sf_dir))


@register(
    "j23_failed_assertions",
    f"""WITH {LEDGER_SQL}, asserted AS (SELECT account, day AS assert_date, CAST(sum(number) OVER (PARTITION BY account ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS DECIMAL(18,4)) AS actual FROM post),
a AS (SELECT DISTINCT account, assert_date, coalesce(actual, 0) AS actual, CAST(coalesce(actual, 0) + CASE WHEN day(assert_date) = 13 THEN 0.5 ELSE 0 END AS DECIMAL(18,4)) AS balance FROM asserted)
SELECT account, assert_date, balance, actual FROM a WHERE balance <> actual""",
)
def j23_failed_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posted(spark, sf_dir)
    daily = rows.groupBy("account", "day").agg(F.sum("number").alias("number"))
    before = Window.partitionBy("account").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    wrong = F.when(F.dayofmonth("day") == 13, F.lit("0.5")).otherwise(F.lit("0")).cast(S.MONEY)
    asserted = daily.select("account", F.col("day").alias("assert_date"), (F.coalesce(F.sum("number").over(before), F.lit(0)) + wrong).cast(S.MONEY).alias("balance"))
    return checks.failed_assertions(rows, asserted)


@register(
    "s16_ledger_transactions",
    """WITH p AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, CAST(l_extendedprice AS DECIMAL(18,4)) AS number FROM lineitem)
SELECT order_id, count(*) AS n, arg_min(number, (line, part, number)) AS first_number, sum(number) AS total FROM p GROUP BY 1""",
)
def s16_ledger_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16 both ways."""
    line = V.table(spark, sf_dir, "lineitem")
    number = F.col("l_extendedprice").cast(S.MONEY)
    rows = line.select(F.col("l_orderkey").alias("order_id"), F.struct(F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), number.alias("c")).alias("pos"), F.lit("Expenses:X").alias("account"), number.alias("number"), F.lit("CAD").alias("currency"))
    nested = postings.ledger_transactions(rows, ["order_id"])
    first = nested.select("order_id", F.get("postings", F.lit(0))["number"].alias("first_number"))
    return postings.ledger_postings(nested).groupBy("order_id").agg(F.count("*").alias("n"), F.sum("number").alias("total")).join(first, "order_id")


@register(
    "p10_charge_amounts",
    """WITH p AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,4)) AS number FROM lineitem)
SELECT order_id, arg_min(-number, (line, part, number)) FILTER (number < 0) AS charge FROM p GROUP BY 1""",
)
def p10_charge_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = V.table(spark, sf_dir, "lineitem")
    number = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast(S.MONEY)
    rows = line.select(F.col("l_orderkey").alias("order_id"), F.struct(F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), number.alias("c")).alias("pos"), F.lit("x").alias("account"), number.alias("number"), F.lit("CAD").alias("currency"))
    return postings.ledger_transactions(rows, ["order_id"]).select("order_id", S.charge_amount(F.col("postings")).alias("charge"))


@register(
    "w5_review_order",
    f"""WITH {CATEGORY_SQL}, e AS (SELECT merchant, category, order_id * 100000000 + line * 10000000 + CAST(abs(amount) * 100 AS BIGINT) % 10000000 AS row_idx FROM categorised)
SELECT merchant, row_idx, row_number() OVER (PARTITION BY merchant ORDER BY CASE WHEN category <> 'Expenses:Uncategorized' THEN 1 ELSE 0 END, row_idx) AS place FROM e""",
)
def w5_review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("order_id") * 100_000_000 + F.col("line") * 10_000_000 + (F.abs("amount") * 100).cast("bigint") % 10_000_000
    rows = categorised(spark, sf_dir).withColumn("row_idx", key)
    return postings.uncategorized_first(rows, "merchant", span=10**11).select("merchant", "row_idx", "place")


@register(
    "w6_chronological",
    f"""WITH {BALANCE_SQL}, t AS (SELECT {V.EVENT_ACCOUNT} AS account, CAST(ts AS DATE) AS day, event_id AS row_idx, 0 AS kind FROM events UNION ALL SELECT account, day, row_idx, 1 FROM run)
SELECT account, day, kind, row_idx, row_number() OVER (PARTITION BY account ORDER BY day, kind, row_idx) AS place FROM t""",
)
def w6_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 and U7."""
    own = V.events(spark, sf_dir).select(F.concat(F.lit("Assets:User:"), F.col("user_id").cast("string")).alias("account"), F.col("ts").cast("date").alias("day"), F.col("event_id").alias("row_idx"))
    return postings.chronological(postings.commingle(own, balances(spark, sf_dir)), "account", "day").select("account", "day", "kind", "row_idx", "place")


@register(
    "u3_candidate_categories",
    f"""WITH {CATEGORY_SQL} SELECT DISTINCT category FROM categorised UNION SELECT 'Expenses:' || c_mktsegment FROM customer""",
)
def u3_candidate_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("Expenses:"), "c_mktsegment").alias("account"))
    return postings.candidate_categories(open_, categorised(spark, sf_dir))
