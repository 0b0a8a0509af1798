"""Receipt text: reading order, lines, fields and items, as regular expressions and windows per receipt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.scalars import MONEY
from tallyforge.operators.rules import containing

PRICE = r"-?[0-9]+\.[0-9]{2}"
SUBTOTAL = r"(?i)\bSUB[ -]?T[OC]TAL\b|\bSUBT[OC]TAL"
TAX = r"(?i)\b(?:TAX|HST|GST|PST|VAT)\b"
TOTAL = r"(?i)\bTOTAL\b"
NO_TOTAL = r"(?i)SUB[ -]?T[OC]TAL|TOTAL (?:SAVINGS|DISCOUNT|SAVED|ITEMS|NUMBER|POINTS)|DISCOUNT TOTAL|YOU SAVED"
METADATA = r"(?i)\b(?:THANK YOU|CASHIER|STORE|TEL|PHONE|INVOICE|RECEIPT|APPROVED|AUTH|TERMINAL|MEMBER|WWW\.|HTTPS?)\b"
SECTION = r"^\s*(?:[0-9]{2}-)?(?:PRODUCE|GROCERY|MEAT|BAKERY|DAIRY|DELI|SEAFOOD|FROZEN|HOUSEHOLD)\s*$"
SALE = r"(?i)\b(?:ON SALE|YOU SAVE|PROMO|COUPON|DISCOUNT)\b"
QUANTITY = r"(?i)^\s*[0-9]+(?:\.[0-9]+)?\s*(?:kg|lb|g)?\s*@\s*(?:[0-9]+\s*/\s*)?\$?\s*[0-9]+\.[0-9]{2}"
#: In upper case, what every match of these has in it: one of the signs at least.
SUBTOTAL_SIGNS, TAX_SIGNS, TOTAL_SIGNS = ("TAL",), ("TAX", "HST", "GST", "PST", "VAT"), ("TOTAL",)
METADATA_SIGNS = ("THANK YOU", "CASHIER", "STORE", "TEL", "PHONE", "INVOICE", "RECEIPT", "APPROVED", "AUTH", "TERMINAL", "MEMBER", "WWW.", "HTTP")
#: Words of payment labels and the tender's kind, in order. Fixed values.
TENDERS = (("GIFT CARD", "gift_card"), ("STORE CREDIT", "store_credit"), ("CASH", "cash"), ("VISA", "card"), ("MASTERCARD", "card"), ("AMEX", "card"), ("DEBIT", "card"), ("CREDIT", "card"))


def has_sign(value: Column, *signs: str) -> Column:
    """Whether a text has one of the signs. Patterns are tried after it only: looking for a sign costs a fraction of what a pattern does.

    One expression over a list, since a row's code has to stay small enough for the JVM to compile it.
    """
    return F.exists(F.array(*map(F.lit, signs)), lambda s: value.contains(s))


def closed_points(text: Column) -> Column:
    """A line without the space that may stand after a price's point."""
    return F.when(text.contains(". "), F.regexp_replace(text, r"([0-9]\.) ([0-9]{2})(?![0-9])", "$1$2")).otherwise(text)


def line_price(text: Column) -> Column:
    """The last amount of a line; a space after its point is overlooked."""
    return F.try_element_at(line_prices(text), F.lit(-1))


def line_prices(text: Column) -> Column:
    found = F.regexp_extract_all(closed_points(text), F.lit(rf"({PRICE})(?![0-9])"), F.lit(1))
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.transform(F.when(text.contains("."), found).otherwise(none), lambda p: p.try_cast(MONEY))


def classify_line(text: Column) -> list[Column]:
    """What a line is, as flags."""
    return [
        F.upper(text).rlike(SECTION).alias("is_section"),
        (text.rlike(SUBTOTAL) | text.rlike(TAX) | text.rlike(TOTAL)).alias("is_summary"),
        text.rlike(METADATA).alias("is_metadata"),
        text.rlike(SALE).alias("is_sale"),
        text.rlike(QUANTITY).alias("is_quantity"),
        F.trim(F.upper(text)).isin("ITEM", "ITEMS", "QTY", "PRICE", "AMOUNT", "DESCRIPTION").alias("is_label"),
        text.rlike(rf"{PRICE}\s*[A-Z]{{0,3}}\s*$").alias("has_price"),
    ]


def clean_description(text: Column) -> Column:
    """X11: without leading codes, trailing price and tax letters, and signs at either end."""
    value = F.regexp_replace(text, rf"\s*\$?{PRICE}\s*[A-Z]{{0,3}}\s*$", "")
    value = F.regexp_replace(value, r"^\s*(?:[0-9]{4,}\s+|\([0-9]+\)\s*)+", "")
    return F.regexp_replace(value, r"^[\s*#.:-]+|[\s*#.:-]+$", "")


def quantity_modifier(text: Column) -> Column:
    """struct(kind, quantity, unit_price, deal_size) of 2 @ $1.50, 0.75 kg @ $3.99/kg and 2 @ 3/$5.00; null for other lines."""
    number, price = r"([0-9]+(?:\.[0-9]+)?)", r"\$?\s*([0-9]+\.[0-9]{2})"
    deal, weight, count = rf"(?i){number}\s*@\s*([0-9]+)\s*/\s*{price}", rf"(?i){number}\s*(?:kg|lb|g)\s*@\s*{price}", rf"(?i){number}\s*@\s*{price}"

    def made(kind: str, pattern: str, groups: tuple[int, int, int | None]) -> Column:
        q, p, d = groups
        return F.struct(
            F.lit(kind).alias("kind"),
            F.regexp_extract(text, pattern, q).try_cast(MONEY).alias("quantity"),
            F.regexp_extract(text, pattern, p).try_cast(MONEY).alias("unit_price"),
            (F.regexp_extract(text, pattern, d).try_cast("int") if d else F.lit(None).cast("int")).alias("deal_size"),
        )

    return F.when(text.rlike(deal), made("deal", deal, (1, 3, 2))).when(text.rlike(weight), made("weight", weight, (1, 2, None))).when(text.rlike(count), made("count", count, (1, 2, None)))


def validate_quantity(total: Column, modifier: Column, tolerance: str = "0.02") -> Column:
    """Whether a total fits the modifier; a deal's price is for as many as its size."""
    each = F.when(modifier["kind"] == "deal", modifier["unit_price"].cast("double") / modifier["deal_size"]).otherwise(modifier["unit_price"].cast("double"))
    return F.abs(total.cast("double") - each * modifier["quantity"].cast("double")) <= float(tolerance) + 1e-9


def _forward_price(lines: DataFrame, reach: int = 3) -> DataFrame:
    """Adds amounts, the last of them as price, and next_price: the first price within the lines that follow."""
    window = Window.partitionBy("receipt_id").orderBy("line_no").rowsBetween(1, reach)
    priced = lines.withColumn("amounts", line_prices(F.col("text"))).withColumn("price", F.try_element_at("amounts", F.lit(-1)))
    return priced.withColumn("next_price", F.first("price", ignorenulls=True).over(window))


def receipt_fields(lines: DataFrame) -> DataFrame:
    """Total, tax and subtotal of each receipt of lines (receipt_id, line_no, text).

    The last line that names a total counts, and the last that names a tax; if one line names both, the larger amount is the total and the smaller
    the tax. A bare label takes the first amount within the next three lines. Totals of savings, discounts and items don't count.
    """
    text, upper = F.col("text"), F.col("upper")
    rows = lines.withColumn("upper", F.upper(text))
    flags = {
        "is_total": has_sign(upper, *TOTAL_SIGNS) & text.rlike(TOTAL) & ~text.rlike(NO_TOTAL),
        "is_tax": has_sign(upper, *TAX_SIGNS) & text.rlike(TAX),
        "is_subtotal": has_sign(upper, *SUBTOTAL_SIGNS) & text.rlike(SUBTOTAL),
    }
    rows = _forward_price(rows.withColumns(flags).select("receipt_id", "line_no", "text", *flags))
    is_total, is_tax, is_subtotal = map(F.col, flags)
    own = lambda pick: F.when(F.size("amounts") > 1, pick("amounts")).otherwise(F.coalesce("price", "next_price"))
    total = F.when(is_total, F.when(is_tax, own(F.array_max)).otherwise(F.coalesce("price", "next_price")))
    tax = F.when(is_tax, F.when(is_total, own(F.array_min)).otherwise(F.col("price")))
    subtotal = F.when(is_subtotal, F.coalesce("price", "next_price"))
    rows = rows.select("receipt_id", "line_no", total.alias("total"), tax.alias("tax"), subtotal.alias("subtotal"))
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    return rows.groupBy("receipt_id").agg(last("total"), last("tax"), last("subtotal"))


def line_date(text: Column, reference_year: int) -> Column:
    """X5 of a line: yyyy-mm-dd; after a date-time label yy/mm/dd; else mm/dd/yy or dd/mm/yy if there is no such month.

    A year of two digits lies in the reference year at most, else in the century before.
    """
    iso = F.try_to_date(F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    short = r"(?<![0-9/])([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})(?![0-9/])"
    a, b, c = (F.regexp_extract(text, short, k).try_cast("int") for k in (1, 2, 3))

    def full(y: Column) -> Column:
        return F.when(y >= 100, y).when(2000 + y <= reference_year, 2000 + y).otherwise(1900 + y)

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.format_string("%04d-%02d-%02d", full(y), m, d), "yyyy-MM-dd")

    labelled = F.when(text.rlike(r"(?i)DATE\s*/?\s*TIME"), made(a, b, c))
    return F.coalesce(iso, labelled, made(c, a, b), made(c, b, a))


def receipt_dates(lines: DataFrame, reference_year: int) -> DataFrame:
    """The first line's date of each receipt."""
    day = F.when(F.col("text").rlike("[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]"), line_date(F.col("text"), reference_year))
    return lines.select("receipt_id", "line_no", day.alias("day")).groupBy("receipt_id").agg(F.min_by(F.when(F.col("day").isNotNull(), F.col("day")), F.when(F.col("day").isNotNull(), F.col("line_no"))).alias("receipt_date"))


def receipt_merchants(lines: DataFrame, known: DataFrame, confident: float = 0.9) -> DataFrame:
    """The first known keyword found in the receipt, else its first confident line, else its first line with three letters."""
    keywords = known.select(F.upper("keyword").alias("keyword"), F.struct("layer", "ord", "pos").alias("place"))
    texts = lines.select(F.upper("text").alias("upper")).where("upper IS NOT NULL").distinct()
    first = containing(texts, keywords, (F.col("upper"), F.col("keyword"))).groupBy("upper").agg(F.min(F.struct("place", "keyword")).alias("first"))
    hits = lines.withColumn("upper", F.upper("text")).join(first, "upper").groupBy("receipt_id").agg(F.min("first").alias("first")).select("receipt_id", F.col("first.keyword").alias("known"))
    meaningful = F.col("text").rlike(r"\p{L}.*\p{L}.*\p{L}")
    first = lambda flag: F.min_by(F.when(flag, F.trim("text")), F.when(flag, F.col("line_no")))
    own = lines.groupBy("receipt_id").agg(first(meaningful & (F.col("confidence") >= confident)).alias("sure"), first(meaningful).alias("any"))
    return own.join(hits, "receipt_id", "left").select("receipt_id", F.coalesce("known", "sure", "any").alias("merchant"))


def receipt_tenders(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Labelled payments (receipt_id, line_no, kind, amount) of the receipts whose payments add up to the total."""
    kind = F.coalesce(*[F.when(F.upper("text").contains(word), k) for word, k in TENDERS])
    paid = lines.select("receipt_id", "line_no", kind.alias("kind"), line_price(F.col("text")).alias("amount")).where("kind IS NOT NULL AND amount IS NOT NULL")
    return tenders_reconcile(paid, totals)


def tenders_reconcile(tenders: DataFrame, totals: DataFrame) -> DataFrame:
    """A10: tenders of the receipts on which they sum to the total."""
    summed = tenders.groupBy("receipt_id").agg(F.sum("amount").alias("__sum"))
    good = summed.join(totals, "receipt_id").where(F.col("__sum") == F.col("total")).select("receipt_id")
    return tenders.join(good, "receipt_id", "left_semi")


def overrun_warnings(receipts: DataFrame) -> DataFrame:
    """Receipts (receipt_id, itemized, total) whose items and tax exceed the total."""
    over = F.col("itemized") - F.col("total")
    return receipts.where(over > 0).select("receipt_id", over.cast(MONEY).alias("overrun"))


def assemble_lines(words: DataFrame) -> DataFrame:
    """Per receipt and line the words in order, their bounding box and mean confidence."""
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    return words.groupBy("receipt_id", "line_no").agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.avg("confidence").alias("confidence"),
    )


def full_text(lines: DataFrame) -> DataFrame:
    """Per receipt its lines joined by newlines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("receipt_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("full_text"))


def reading_order(detections: DataFrame) -> DataFrame:
    """Place of each detection, from top to bottom and left to right."""
    return detections.withColumn("place", F.row_number().over(Window.partitionBy("receipt_id").orderBy("center_y", "min_x", "det_id")))


def band_lines(detections: DataFrame) -> DataFrame:
    """Line number of each detection: a new line begins where a centre lies below all that came before."""
    order = Window.partitionBy("receipt_id").orderBy("center_y", "min_x", "det_id")
    below = F.col("center_y") > F.max("y_max").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = detections.withColumn("__new", F.coalesce(below, F.lit(False)).cast("int"))
    return marked.withColumn("line_no", F.sum("__new").over(order)).drop("__new")


def filter_low_quality(detections: DataFrame, confidence: float, letters: int) -> DataFrame:
    """P26"""
    return detections.where((F.col("confidence") >= confidence) & (F.length(F.trim("text")) >= letters))


def drop_overlapping_markers(detections: DataFrame) -> DataFrame:
    """Without the markers whose vertical band meets that of another detection of the receipt that is none.

    One pass in the order of upper edges: a marker meets a band from above that reaches down to it, or one that begins within its
    own; the first is the lowest edge so far, the second the next upper edge of a band, so no pairs are built.
    """
    order = Window.partitionBy("receipt_id").orderBy("y_min")
    band = ~F.col("is_marker") & F.col("y_min").isNotNull()
    lowest = F.max(F.when(band, F.col("y_max"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(band & (F.col("y_min") <= F.col("y_max")), F.col("y_min"))).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    marked = detections.withColumn("__lowest", lowest).withColumn("__next", following)
    meets = F.coalesce(F.col("__lowest") >= F.col("y_min"), F.lit(False)) | F.coalesce(F.col("__next") <= F.col("y_max"), F.lit(False))
    return marked.where(~F.col("is_marker") | ~meets).drop("__lowest", "__next")


def normalize_detections(detections: DataFrame, *passes: Callable[[DataFrame], DataFrame], trace: dict[str, Observation] | None = None) -> DataFrame:
    """the passes in sequence, each over the rows that the one before it left; none leaves the rows as they are.

    A trace gets, by place and name of a pass, an observation whose `rows` counts what the pass left, once an action has run.
    """
    for place, step in enumerate(passes):
        detections = detections.transform(step)
        if trace is not None:
            name = f"{place:02d}_{getattr(step, '__name__', type(step).__name__)}"
            trace[name] = Observation(name)
            detections = detections.observe(trace[name], F.count(F.lit(1)).alias("rows"))
    return detections


def nearest_lines(prices: DataFrame, lines: DataFrame, tolerance: float = 0.02, reach: float = 0.08) -> DataFrame:
    """receipt_id, price_id and line_id: from the top of each receipt down, every price takes the nearest line that none before it has taken.

    A line is in a price's reach if it lies within `tolerance` on either side, or at most `reach` above it, or below it where
    the price's optional column `below` says so; of equal distances the smaller line_id counts. Lines whose optional column `valid` is not true are no
    items. A price without a free line has none. Prices meet lines by strips of their height, so that a pair is built only
    of neighbours, and a receipt's prices are then gone through once, in order.
    """
    below = F.coalesce("below", F.lit(False)) if "below" in prices.columns else F.lit(False)
    lines = lines.where("valid") if "valid" in lines.columns else lines
    strip = lambda c: F.floor(c.cast("double") / (max(reach, tolerance) * 1.0001))
    near = F.explode(F.array(*[strip(F.col("price_y")) + d for d in (-1, 0, 1)])).alias("strip")
    own = prices.select("receipt_id", "price_id", "price_y", below.alias("below"), near)
    pairs = own.join(lines.select("receipt_id", "line_id", "line_y", strip(F.col("line_y")).alias("strip")), ["receipt_id", "strip"])
    gap, above = F.abs(F.col("price_y") - F.col("line_y")), F.col("line_y") <= F.col("price_y")
    fits = (gap <= tolerance) | (gap <= reach) & (above != F.col("below"))
    choices = F.array_sort(F.collect_list(F.struct(gap.alias("gap"), F.col("line_id").alias("line_id"))))
    each = pairs.where(fits).groupBy("receipt_id", "price_id", "price_y").agg(F.transform(choices, lambda c: c["line_id"]).alias("choices"))
    line_type = lines.schema["line_id"].dataType.simpleString()
    ordered = each.groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("price_y", "price_id", "choices"))).alias("prices"))
    start = F.array().cast(f"array<{line_type}>")

    def take(taken, price):
        """Adds the line that a price gets, null for none, so that both lists keep one order."""
        return F.concat(taken, F.array(F.get(F.filter(price["choices"], lambda x: ~F.coalesce(F.array_contains(taken, x), F.lit(False))), F.lit(0))))

    found = ordered.select("receipt_id", "prices", F.aggregate("prices", start, take).alias("taken"))
    both = F.explode(F.arrays_zip(F.transform("prices", lambda p: p["price_id"]).alias("price_id"), F.col("taken").alias("line_id"))).alias("m")
    return found.select("receipt_id", both).select("receipt_id", "m.price_id", "m.line_id").where("line_id IS NOT NULL")


def ocr_detections(documents: DataFrame, padding: int = 50) -> DataFrame:
    """One row per detection of (receipt_id, image_width, image_height, detections), with the padding taken off points and sizes."""
    rows = documents.select("receipt_id", (F.col("image_width") - 2 * padding).alias("width"), (F.col("image_height") - 2 * padding).alias("height"), F.posexplode("detections").alias("det_id", "d"))
    poly = F.transform("d.poly", lambda p: F.transform(p, lambda v: v - F.lit(float(padding))))
    return rows.select("receipt_id", "det_id", "width", "height", poly.alias("poly"), F.col("d.text").alias("text"), F.col("d.confidence").alias("confidence"))
