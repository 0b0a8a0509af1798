"""Column functions: amounts, dates, merchants, accounts and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
UNCATEGORIZED = "Expenses:Uncategorized"
NOT_ASSIGNED = "Expenses:Shopping:NotAssigned"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_upper(value: Column) -> Column:
    return F.translate(value, _LOWER, _UPPER)


def money(value: Column) -> Column:
    """A decimal of four places, null where the text is no number."""
    return value.try_cast(MONEY)


def clean_amount(value: Column) -> Column:
    """Dollar signs and commas dropped."""
    return money(F.translate(F.trim(value), "$,", ""))


def strict_amount(value: Column) -> Column:
    """A plain decimal numeral only; a thousands comma or a sign of currency gives null, and the row is rejected."""
    plain = F.trim(value)
    return F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), money(plain))


def parse_date(value: Column, *formats: str) -> Column:
    """The first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_date(F.trim(value), f) for f in formats])


def is_payment(merchant: Column) -> Column:
    """A payment to the card and no purchase."""
    name = F.upper(F.coalesce(merchant, F.lit("")))
    return name.contains("TRSF FROM/DE ACCT/CPT") | name.contains("PAYMENT RECEIVED") | (name == "PAYMENT")


def is_installment(merchant: Column) -> Column:
    """P5"""
    return F.upper(F.coalesce(merchant, F.lit(""))).contains("INSTALLMENT PLAN FOR")


def is_offer(merchant: Column, amount: Column) -> Column:
    """A fare that is given back or costs nothing."""
    return F.upper(F.coalesce(merchant, F.lit(""))).contains("PRESTO FARE") & (amount <= 0)


def bucket_small(category: Column, amount: Column, floor: str = "5.00") -> Column:
    """Uncategorised purchases below the floor go to one account; refunds keep their category."""
    known = F.coalesce(category, F.lit(UNCATEGORIZED))
    small = (known == UNCATEGORIZED) & (amount >= 0) & (amount < F.lit(floor).cast(MONEY))
    return F.when(small, F.lit(NOT_ASSIGNED)).otherwise(known)


def next_day(day: Column) -> Column:
    """A balance holds from the day after its row."""
    return F.date_add(day, 1)


def charge_posting(postings: Column) -> Column:
    """P10: the first posting with a negative number, null if none."""
    return F.get(F.filter(postings, lambda p: p["number"] < 0), F.lit(0))


def charge_amount(postings: Column) -> Column:
    return F.abs(charge_posting(postings)["number"]).cast(MONEY)


def truncate4(value: Column) -> Column:
    """Towards zero at four places."""
    scaled = value.cast("decimal(38,8)") * 10000
    whole = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled))
    return (whole.cast("decimal(28,0)") / F.lit(10000).cast("decimal(5,0)")).cast(MONEY)


def amount_tolerance(total: Column, absolute: str, share: str) -> Column:
    """The greater of an absolute amount and a share of the total."""
    return F.greatest(F.lit(absolute).cast(MONEY), truncate4(total * F.lit(share).cast("decimal(8,4)")))


def normalize_merchant(name: Column) -> Column:
    """Without company suffix or trailing number, state code, and last city-like word; letters and digits only."""
    value = F.rtrim(F.regexp_replace(ascii_upper(F.trim(name)), r"^(.*\S)\s+(?:(?:INC|LLC|LTD|CORP|CO)\.*|#?\d*\.*)$", "$1"))
    value = F.rtrim(F.regexp_replace(value, r"[, ]+[A-Z]{2}$", ""))
    value = F.regexp_replace(value, r"^(.*[^, ])[, ]+[A-Z]{2,}$", "$1")
    return F.regexp_replace(value, r"[^A-Z0-9]", "")


def alpha_words(name: Column) -> Column:
    """Distinct words of three letters or more, upper-cased."""
    return F.array_distinct(F.regexp_extract_all(ascii_upper(name), F.lit("[A-Z]{3,}"), F.lit(0)))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that both share: the longest length at which their prefixes agree."""
    shorter = F.least(F.length(a), F.length(b))
    agree = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))
    return F.when(shorter > 0, F.size(agree)).otherwise(0)


def merchant_similarity(a: Column, b: Column, words_a: Column, words_b: Column, family: Column) -> Column:
    """P14, from canonical names a and b, the raw names' words, and whether a family has named either."""
    prefix, shorter = common_prefix(a, b), F.least(F.length(a), F.length(b))
    shared = F.size(F.array_intersect(words_a, words_b))
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0)
        .when((a == b) & family, 1.0)
        .when(a.contains(b) | b.contains(a), 0.9)
        .when(prefix >= 4, 0.5 + 0.4 * (prefix / shorter))
        .when(shared > 0, 0.3 + 0.4 * (shared / F.size(F.array_union(words_a, words_b))))
        .otherwise(0.0)
    )


def match_details(days: Column, amount_gap: Column, non_card: Column, family: Column, similarity: Column) -> Column:
    """Why a pair matches. days is null for an unknown date, non_card null without a split tender, family null without one."""
    date = F.when(days.isNull(), "date: unknown").when(days == 0, "date: exact match").otherwise(F.format_string("date: %d day(s) off", days))
    tender = F.when(non_card > 0, F.concat(F.lit(" (after $"), non_card.cast("decimal(18,2)").cast("string"), F.lit(" non-card tender)"))).otherwise("")
    amount = F.when(amount_gap == 0, F.concat(F.lit("amount: exact match"), tender)).otherwise(
        F.concat(F.lit("amount: $"), amount_gap.cast("decimal(18,2)").cast("string"), F.lit(" off"), tender)
    )
    percent = F.concat(F.lit("merchant: partial match ("), F.bround(similarity * 100, 0).cast("int").cast("string"), F.lit("%)"))
    merchant = F.when(family.isNotNull(), F.concat(F.lit("merchant: family match ("), family, F.lit(")"))).when(similarity > 0.8, "merchant: good match").otherwise(percent)
    return F.concat_ws(", ", date, amount, merchant)


def glob_regex(pattern: Column) -> Column:
    """An anchored regular expression for a shell pattern of *, ? and [...]; a star crosses colons."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    classes = F.regexp_replace(quoted, r"\[!", "[^")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(classes, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def account_glob(account: Column, pattern: Column) -> Column:
    return F.rlike(account, glob_regex(pattern))


def contains_token(account: Column, token: Column) -> Column:
    """Without regard to case, hyphens, underscores and spaces."""
    plain = lambda c: F.upper(F.translate(c, "-_ ", ""))
    return plain(account).contains(plain(token))


def stage_status(stage: Column) -> Column:
    """P18"""
    name = F.lower(stage)
    return F.when(name.contains("matched"), "matched").when(name.contains("review"), "approved").otherwise("scanned")


def receipt_chain_name(day: Column, merchant: Column, total: Column, receipt_id: Column) -> Column:
    """Date, merchant, total and four characters of the id, each with a word for the unknown."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(merchant, F.lit(""))), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, 30), r"_+$", "")
    return F.concat_ws(
        "_",
        F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("unknown-date")),
        F.when(slug == "", "unknown").otherwise(slug),
        F.coalesce(total.cast("decimal(18,2)").cast("string"), F.lit("unknown_total")),
        F.when(F.coalesce(receipt_id, F.lit("")) == "", "unkn").otherwise(F.substring(receipt_id, 1, 4)),
    )


def effective_value(detected: Column, review: Column) -> Column:
    """P20: what a reviewer has entered, else what was detected."""
    return F.coalesce(review, detected)


def bbox(polygon: Column, width: Column, height: Column) -> Column:
    """P25: left, top, right and bottom of a polygon of [x, y] points, as shares of the image, within 0 and 1."""

    def edge(k: int, size: Column, pick) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), pick(F.transform(polygon, lambda p: p[k])) / size))

    return F.struct(
        edge(0, width, F.array_min).alias("left"), edge(1, height, F.array_min).alias("top"), edge(0, width, F.array_max).alias("right"), edge(1, height, F.array_max).alias("bottom")
    )
