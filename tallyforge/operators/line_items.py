"""Line items of receipts, by a fold over each receipt's lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import MONEY
from tallyforge.operators.receipts import METADATA, METADATA_SIGNS, SUBTOTAL, SUBTOTAL_SIGNS, TAX, TAX_SIGNS, TENDERS, TOTAL, TOTAL_SIGNS, closed_points, has_sign

#: A price at the end of a line, with its tax letters.
END = r"\s*\$?\s*(-?[0-9]+\.[0-9]{2})\s*[A-Z]{0,3}\s*$"
SECTIONS = "PRODUCE|GROCERY|MEAT|BAKERY|DAIRY|DELI|SEAFOOD|FROZEN|HOUSEHOLD"
#: A department's line: by its sign, by a number before its name, or its name alone (the latter only if it has no price).
HEADER, SECTION = rf"(?i)^\s*(?:&&.*|[0-9]{{2}}-(?:{SECTIONS}))\s*$", rf"(?i)^\s*(?:{SECTIONS})\s*$"
PAYMENT = rf"(?i)\b(?:{'|'.join(word for word, _ in TENDERS)})\b"
CARD = r"(?i)^\s*(?:ACCOUNT|CARD TYPE|CARD NUMBER|TRANS\.? TYPE)\b|^\s*PURCHASE\s*$|PRE-SCANNED"
#: A regular price, which is not what was paid, and the sign of a sale.
REGULAR, ON_SALE = r"(?i)(?<![A-Z])R?EG\$?[0-9]+(?:\.[0-9]{2})?", r"(?i)^\W*ON\s?SALE?\b"
SAVED = r"(?i)\b(?:YOU SAVED?|SAVINGS|PROMO|COUPON|DISCOUNT)\b"
#: A quantity at a price; one whose total follows; and an offer that is neither.
QUANTITY, QUANTITY_TOTAL, OFFER = r"^\s*[0-9]+(?:\.[0-9]+)?\s*[0-9A-Za-z]{0,2}\s*@", r"@.*[0-9]\.[0-9]{2}.*\s\$?-?[0-9]+\.[0-9]{2}\s*[A-Z]{0,3}\s*$", r"@.*/\s*\$"
MULTIBUY, SIZE = r"(?i)[0-9]\s*/\s*FOR\b", r"(?i)^\([0-9]+(?:\.[0-9]+)?\s*(?:KG|G|ML|L|LB|OZ|PK)\)$"
SUMMARY = rf"{SUBTOTAL}|{TAX}|{TOTAL}"
#: In upper case, what every match of the patterns has in it: one of the signs at least.
SUMMARY_SIGNS = (*SUBTOTAL_SIGNS, *TAX_SIGNS, *TOTAL_SIGNS)
STOP_SIGNS = (*METADATA_SIGNS, *[word for word, _ in TENDERS], "ACCOUNT", "CARD", "TYPE", "PURCHASE", "SCANNED")
SAVED_SIGNS = ("SAVE", "SAVINGS", "PROMO", "COUPON", "DISCOUNT")
LABELS = ("ITEM", "ITEMS", "QTY", "PRICE", "AMOUNT", "DESCRIPTION")

ITEM = f"struct<line_no: int, description: string, price: {MONEY}>"


def read_lines(lines: DataFrame) -> DataFrame:
    """(receipt_id, line_no, kind, words, price) of lines (receipt_id, line_no, text): what each line is to the fold.

    item has words and a price of its own; words have no price; paid is a price for the words before it (of a quantity, a
    multiple offer, or a broken marker), size the same with a package's size, and bare nothing but a price; ahead is a price beside a
    sale's sign, for the words before or, if these have theirs, after it; head is a department, whose price may be the next words'; saved
    says that the next bare price is what was saved; total and stop end what was open; other lines are skipped.
    Each column is worked out once, from those of the step before.
    Patterns are tried only on lines that have a sign which every match of theirs has.
    """
    text, upper, line, end, rest, words, price, regular = (F.col(c) for c in ("text", "upper", "line", "end", "rest", "words", "price", "regular"))
    rows = lines.select("receipt_id", F.col("line_no").cast("int").alias("line_no"), "text", F.upper("text").alias("upper"), closed_points(F.col("text")).alias("line"))
    rows = rows.withColumn("end", F.when(line.contains("."), F.regexp_extract(line, END, 0))).withColumn("regular", has_sign(upper, "EG") & line.rlike(REGULAR))
    rows = rows.withColumn("price", F.when(end != "", F.regexp_extract(end, END, 1).try_cast(MONEY)))
    cut = F.when(line.endswith(end), F.left(line, F.length(line) - F.length(end))).otherwise(F.regexp_replace(line, END, ""))
    rows = rows.withColumn("rest", F.trim(F.when(price.isNotNull(), cut).otherwise(line)))
    bared = F.when(rest.startswith("("), F.regexp_replace(rest, r"^\([0-9]+\)\s*", "")).otherwise(rest)
    rows = rows.withColumn("bared", bared)
    rows = rows.withColumn("words", F.when(F.col("bared").rlike("^[0-9]{8}"), F.regexp_replace("bared", r"^[0-9]{8,}\s+", "")).otherwise(F.col("bared")))
    rows = rows.withColumn("spelt", F.when(has_sign(words, "("), F.regexp_replace(words, r"\([^)]*\)?", " ")).otherwise(words).rlike(r"\p{L}{2}"))
    beside = F.when(regular, F.regexp_extract(F.regexp_replace(line, REGULAR, ""), END, 1).try_cast(MONEY)).otherwise(price)
    rows = rows.withColumn("beside", beside)
    label = F.upper(rest).isin(*LABELS)
    multibuy = rest.contains("/") & rest.rlike(MULTIBUY)
    priced = F.when(words.startswith("(") & words.rlike(SIZE), "size").when(rest == "", "bare").when(multibuy | ~F.col("spelt"), "paid").when(label, "skip").otherwise("item")
    named = F.when(rest.rlike(SECTION), "head").when(~F.col("spelt") | multibuy | words.startswith("(") | label, "skip").otherwise("words")
    kind = (
        F.when(text.isNull(), "skip")
        .when(has_sign(rest, "&&", "-") & rest.rlike(HEADER), "head")
        .when(regular | upper.contains("ON") & line.rlike(ON_SALE), F.when(F.col("beside").isNull(), "skip").otherwise("ahead"))
        .when(has_sign(upper, *SUMMARY_SIGNS) & text.rlike(SUMMARY), "total")
        .when(has_sign(upper, *STOP_SIGNS) & (text.rlike(METADATA) | text.rlike(PAYMENT) | text.rlike(CARD)), "stop")
        .when(line.contains("@") & line.rlike(QUANTITY), F.when(line.rlike(QUANTITY_TOTAL), "paid").otherwise("skip"))
        .when(line.contains("@") & line.rlike(OFFER), "skip")
        .when(has_sign(upper, *SAVED_SIGNS) & line.rlike(SAVED), F.when(price.isNull(), "saved").otherwise("skip"))
        .when(price.isNotNull(), priced)
        .otherwise(named)
    )
    rows = rows.withColumn("kind", kind)
    return rows.select("receipt_id", "line_no", "kind", "words", F.when(F.col("kind") == "ahead", F.col("beside")).otherwise(price).alias("price"))


def _step(s: Column, x: Column) -> Column:
    """The fold's state after a line. held: words without a price; ahead: a price without words; given: the last item got such a price.

    One branch for each kind, so that a line works out only what its own kind needs.
    """
    kind, held, ahead, price = x["kind"], s["held"], s["ahead"], x["price"]
    null, no = F.lit(None), F.lit(False)

    def state(held: Column = null, ahead: Column = null, given: Column = no, muted: Column = no, totals: Column = s["totals"], amounts: Column = s["amounts"], items: Column = s["items"]) -> Column:
        return F.struct(
            held.cast("string").alias("held"), ahead.cast(MONEY).alias("ahead"), given.alias("given"), muted.alias("muted"), totals.alias("totals"), amounts.alias("amounts"), items.alias("items")
        )

    def with_item(description: Column, price: Column = price) -> Column:
        return F.concat(s["items"], F.array(F.struct(x["line_no"].alias("line_no"), description.alias("description"), price.alias("price")).cast(ITEM)))

    words = F.when(F.coalesce(held.endswith("-"), no), F.concat_ws(" ", held, x["words"])).otherwise(x["words"])
    taken = ahead.isNotNull() & ~words.endswith("-") & ~F.coalesce(x["next"].isin("paid", "bare"), no)
    summed = s["totals"] & F.array_contains(s["amounts"], price)
    at = F.array_position(s["amounts"], price).cast("int")
    used = F.when(summed, F.concat(F.slice(s["amounts"], F.lit(1), at - 1), F.slice(s["amounts"], at + 1, F.size(s["amounts"])))).otherwise(s["amounts"])
    by_size = F.when(held.isNotNull(), F.concat_ws(" ", held, x["words"])).otherwise(x["words"])
    return (
        F.when(kind == "item", state(items=with_item(words)))
        .when(kind == "skip", s)
        .when(kind == "words", F.when(taken, state(given=F.lit(True), items=with_item(words, ahead))).otherwise(state(words, ahead)))
        .when(kind == "bare", F.when(held.isNotNull() & ~s["muted"] & ~summed, state(ahead=ahead, items=with_item(held))).otherwise(state(held, ahead, amounts=used)))
        .when(kind == "paid", state(ahead=ahead, items=F.when(held.isNotNull(), with_item(held)).otherwise(s["items"])))
        .when(kind == "size", state(ahead=ahead, items=F.when(held.isNotNull() | s["given"], with_item(by_size)).otherwise(s["items"])))
        .when(kind == "ahead", F.when(held.isNotNull(), state(ahead=ahead, items=with_item(held))).otherwise(state(ahead=price)))
        .when(kind == "head", state(ahead=price))
        .when(kind == "total", state(totals=F.lit(True)))
        .when(kind == "saved", state(held, ahead, muted=F.lit(True)))
        .otherwise(state())
    )


def extract_items(lines: DataFrame, amounts: DataFrame | None = None) -> DataFrame:
    """receipt_id, line_no, description and price of each item, of lines (receipt_id, line_no, text).

    The lines of a receipt are read in order. A line with words and a price is an item. Words without a price are held until a price comes: a quantity's
    total, a multiple offer's, a broken marker's or a bare price; words that end in a dash are joined with the next. A price beside a sale's sign or a
    department's belongs to the next words, unless these have one. What was saved, regular prices, offers, totals, payments and notes are no items.

    `amounts` (receipt_id, amounts array<decimal>) are a receipt's total, tax and the like: once its totals have begun, a bare price that equals
    one of them is that amount, which is then used up. line_no is that of the price, or of the words that got a price from before them.
    Null lines are skipped; a receipt without items gives no rows.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "kind", "words", "price"))).alias("lines")
    receipts = read_lines(lines).groupBy("receipt_id").agg(ordered)
    none = F.array().cast(f"array<{MONEY}>")
    if amounts is None:
        receipts = receipts.withColumn("amounts", none)
    else:
        own = amounts.select("receipt_id", F.col("amounts").cast(f"array<{MONEY}>").alias("amounts"))
        receipts = receipts.join(own, "receipt_id", "left").withColumn("amounts", F.coalesce("amounts", none))
    after = F.transform("lines", lambda x, i: x.withField("next", F.get(F.col("lines"), i + 1)["kind"]))
    start = F.struct(
        F.lit(None).cast("string").alias("held"), F.lit(None).cast(MONEY).alias("ahead"), F.lit(False).alias("given"), F.lit(False).alias("muted"),
        F.lit(False).alias("totals"), F.col("amounts").alias("amounts"), F.array().cast(f"array<{ITEM}>").alias("items"),
    )
    return receipts.select("receipt_id", F.inline(F.aggregate(after, start, _step, lambda s: s["items"])))
