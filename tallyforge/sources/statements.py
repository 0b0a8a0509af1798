"""Bank and card statements: reading, routing by name and header, and one normaliser per layout."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.scalars import clean_amount, parse_date, strict_amount
from tallyforge.operators.rules import MOST_BROADCAST, small_enough


#: A quoted field of more lines than these is taken for stray quotes.
MOST_LINES = 1_000


def read_statement(spark: SparkSession, path: str, skip_rows: int = 0, header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """src_file (the whole path, since folders may hold files of one name), row_idx, line and fields of each row below the preamble and header.

    row_idx is the number of the line on which the row begins, from 0. A file of any size is read in splits, many tasks' work; see
    numbered_lines() and csv_rows().
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return csv_rows(numbered_lines(lines, encoding), skip_rows, header)


def _of_splits(lines: DataFrame, splits: DataFrame, order: str) -> DataFrame:
    """Lines with what a table of splits says of theirs. They stay in their tasks and in order, unless there are too many splits to broadcast."""
    if small_enough(splits):
        return lines.join(F.broadcast(splits), ["src_file", "block"])
    return lines.join(splits, ["src_file", "block"]).repartition("src_file", "block").sortWithinPartitions("src_file", "block", order)


def _before(splits: DataFrame, *columns: str) -> DataFrame:
    """Splits with the sums of these columns over the splits of the file before each."""
    before = Window.partitionBy("src_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns]).drop(*columns)


def numbered_lines(lines: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """(src_file, block, row_idx, line) of lines (src_file, block, value) as a reader of text gives them: block is where their split begins.

    A line's number is its place in its split and the lines of the file's splits before it. A split is read by one task from first to last, so
    that the place is what its running number has over the split's least one. Only the splits' counts, a row each, are exchanged; no line is.
    """
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    splits = lines.groupBy("src_file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    text = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    row = F.col("n_before") + F.col("at") - F.col("first")
    text = F.when(row == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    return _of_splits(lines, _before(splits, "n"), "at").select("src_file", "block", row.cast("bigint").alias("row_idx"), text.alias("line"))


def split_statement(files: DataFrame, skip_rows: int = 0, header: bool = True) -> DataFrame:
    """S1 over whole files (src_file, text)."""
    lines = files.select("src_file", F.posexplode(F.split(F.regexp_replace("text", "^\ufeff", ""), "\r?\n")).alias("row_idx", "line"))
    return csv_rows(lines.withColumn("row_idx", F.col("row_idx").cast("bigint")), skip_rows, header)


def _odd(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


LINE = pa.schema([("src_file", pa.string()), ("row_idx", pa.int64()), ("line", pa.string()), ("span", pa.int64())])


def _quoted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of lines in order (src_file, block, row_idx, line, odd, odd_before): a row in quotes is joined; its lines have its number as span if part of it is in another split."""
    split, turn, held, begun = None, 0, [], False
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, odd = batch.column("src_file").dictionary_encode(), batch.column("block").to_numpy(), batch.column("odd").to_numpy(zero_copy_only=False).astype(np.int64)
        code = file.indices.to_numpy()
        starts = np.flatnonzero(np.append(True, (np.diff(block) != 0) | (np.diff(code) != 0)))
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            part, name, out = batch.slice(a, z - a), file.dictionary[code[a]].as_py(), []
            if (name, block[a]) != split:
                out += held
                split, turn, held, begun = (name, block[a]), part.column("odd_before")[0].as_py(), [], False
            turns = turn + np.cumsum(odd[a:z]) - odd[a:z]
            turn = int(turns[-1] + odd[z - 1])
            inside = (turns + odd[a:z]) % 2 + odd[a:z] > 0
            plain = part.filter(pc.and_(pa.array(~inside), pc.not_equal(part.column("line"), "")))
            yield pa.RecordBatch.from_arrays([*map(plain.column, LINE.names[:3]), pa.nulls(plain.num_rows, pa.int64())], schema=LINE)
            within = part.filter(pa.array(inside))
            for row, line, number, ends in zip(within.column("row_idx").to_pylist(), within.column("line").to_pylist(), turns[inside].tolist(), (turns + odd[a:z])[inside].tolist(), strict=True):
                begun = begun or number % 2 == 0
                held.append((name, row, line, number // 2))
                if len(held) > most:  # more lines than a row has: they stay rows of their own, and what is left of them too
                    out += [(*x[:3], None) for x in held]
                    held, begun = [], False
                elif ends % 2 == 0:
                    out += [(name, held[0][1], "\n".join([x[2] for x in held]), None)] if begun else held
                    held, begun = [], False
            yield _as_lines(out)
    yield _as_lines(held)


def _as_lines(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(LINE), LINE, strict=True)], schema=LINE)


def csv_rows(lines: DataFrame, skip_rows: int = 0, header: bool = True) -> DataFrame:
    """Rows (src_file, row_idx, line, fields) of lines (src_file, row_idx, line) below the preamble and header, without empty ones.

    The lines of a split (block; without that column of a file) have to be in one task, in order. A field in quotes may go over several lines: of a
    file's lines with an odd number of quotes, every first begins such a row and every second ends it. A split goes on from the number of such lines
    before it, and only rows that are part of two splits are exchanged. Where more than MOST_LINES would be one row, or the last
    quote never ends, the lines with odd quotes stay rows of their own, with null fields.
    """
    lines = lines.where(F.col("row_idx") >= skip_rows + int(header)).withColumn("odd", _odd(F.col("line")))
    if "block" in lines.columns:
        splits = lines.groupBy("src_file", "block").agg(F.count_if("odd").alias("odd"))
        lines = _of_splits(lines, _before(splits, "odd"), "row_idx")
    else:
        lines = lines.withColumn("block", F.lit(0)).withColumn("odd_before", F.lit(0).cast("bigint"))
    lines = lines.select("src_file", "block", "row_idx", "line", "odd", "odd_before")
    read = lines.mapInArrow(partial(_quoted, most=MOST_LINES), "src_file string, row_idx bigint, line string, span bigint")
    parts = F.array_sort(F.collect_list(F.struct("row_idx", "line")))
    spans = read.where("span IS NOT NULL").groupBy("src_file", "span").agg(parts.alias("parts"), F.count_if(_odd(F.col("line"))).alias("odd"))
    first, last = F.get("parts", F.lit(0))["row_idx"], F.element_at("parts", -1)["row_idx"]
    joined = F.array(F.struct(first.alias("row_idx"), F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line")))
    own = spans.select("src_file", F.inline(F.when((F.col("odd") == 2) & (last - first < MOST_LINES), joined).otherwise(F.col("parts"))))
    rows = read.where("span IS NULL").select("src_file", "row_idx", "line").unionByName(own)
    return with_fields(rows.where(F.trim("line") != "").select("src_file", "row_idx", "line"))


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def csv_fields(line: Column) -> Column:
    """Fields of one row of CSV: commas and line ends within quotes don't part, doubled quotes stand for one. Null where quotes don't pair.

    Each field is found from where the one before it ends, so a row is read once.
    """
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    field_ = r'(?s),\s*(?:"[^"]*+(?:""[^"]*+)*+"\s*(?=,|\z)|[^,]*)'
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(field_), F.lit(0))
    unquoted = lambda t: F.replace(F.regexp_replace(t, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    plain = F.transform(F.transform(parts, lambda p: F.trim(F.substr(p, F.lit(2)))), lambda t: F.when(t.contains('"'), unquoted(t)).otherwise(t))
    return F.when(quotes % 2 == 0, plain)


def with_fields(rows: DataFrame) -> DataFrame:
    """Adds the fields of each row's line. They are exploded, so that filters on them aren't moved below: a line would be taken apart again for every field that these look at."""
    return rows.select("*", F.explode(F.array(csv_fields(F.col("line")))).alias("fields"))


@dataclass(frozen=True)
class Layout:
    """Where a statement has its columns: by position, or by header name, which positions() turns into positions."""

    name: str
    date: int
    formats: tuple[str, ...]
    merchant: int
    amount: int
    skip_rows: int = 0
    header: bool = True
    encoding: str = "UTF-8"
    balance: int | None = None
    names: tuple[str, ...] = field(default=())


def _at(fields: str, position: int) -> Column:
    return F.trim(F.get(F.col(fields), F.lit(position)))


#: The layouts' positions; formats are in the order in which they are tried. Fixed values.
AMEX = Layout("amex", 0, ("d MMM yyyy",), 1, 2, names=("Date", "Description", "Amount"))
BMO = Layout("bmo", 2, ("yyyyMMdd",), 4, 3, skip_rows=2, names=("Transaction Date", "Transaction Amount", "Description"))
CIBC = Layout("cibc", 0, ("M/d/yyyy", "yyyy-MM-dd"), 1, 2)
CTFS = Layout("ctfs", 1, ("yyyy-MM-dd",), 3, 4, skip_rows=3, names=("TRANSACTION DATE", "TYPE", "DESCRIPTION", "AMOUNT"))
MBNA = Layout("mbna", 0, ("M/d/yyyy",), 1, 3, encoding="ISO-8859-1")
PCF = Layout("pcf", 3, ("M/d/yyyy",), 0, 5)
ROGERS = Layout("rogers", 0, ("yyyy-MM-dd",), 2, 1, names=("Date", "Amount", "Merchant Name"))
SCOTIA = Layout("scotia", 1, ("yyyy-MM-dd",), 2, 6, skip_rows=1, header=False)
EQBANK = Layout("eqbank", 0, ("yyyy-MM-dd",), 1, 2, balance=3, names=("Transfer date", "Description", "Amount", "Balance"))
SCOTIA_CHEQUING = Layout("scotia_chequing", 0, ("yyyy-MM-dd",), 1, 3, balance=4, names=("Date", "Description", "Sub-description", "Amount", "Balance"))


def positions(header: list[str], names: tuple[str, ...]) -> dict[str, int]:
    """Where a file's header has each name, without regard to case."""
    own = [h.strip().upper() for h in header]
    return {n: own.index(n.upper()) for n in names}


def _card(rows: DataFrame, layout: Layout, amount: Column, account: Column, keep: Column | None = None, day: Column | None = None) -> DataFrame:
    """src_file, row_idx, txn_date, amount, merchant, account, currency and line; unreadable rows keep nulls, for rejects()."""
    rows = rows if keep is None else rows.where(F.coalesce(keep, F.lit(True)))
    day = parse_date(_at("fields", layout.date), *layout.formats) if day is None else day
    return rows.select("src_file", "row_idx", day.alias("txn_date"), amount.alias("amount"), _at("fields", layout.merchant).alias("merchant"), account.alias("account"), F.lit("CAD").alias("currency"), "line")


def normalize_amex(rows: DataFrame, account: str) -> DataFrame:
    """S2"""
    return _card(rows, AMEX, strict_amount(_at("fields", AMEX.amount)), F.lit(account))


def normalize_bmo(rows: DataFrame, account: str, other: str | None = None) -> DataFrame:
    """S3: a file porter.csv is of the other account."""
    own = F.when((file_name(F.col("src_file")) == "porter.csv") & F.lit(other).isNotNull(), F.lit(other)).otherwise(F.lit(account))
    return _card(rows, BMO, strict_amount(_at("fields", BMO.amount)), own)


def normalize_cibc(rows: DataFrame, account: str, simplii: str) -> DataFrame:
    """The date's format depends on a slash; rows without a debit and repeated headers are left out; the file's name picks the account."""
    text, debit = _at("fields", CIBC.date), _at("fields", CIBC.amount)
    day = F.when(text.contains("/"), parse_date(text, "M/d/yyyy")).otherwise(parse_date(text, "yyyy-MM-dd"))
    keep = (F.coalesce(debit, F.lit("")) != "") & (F.upper(text) != "DATE")
    own = F.when(F.upper(file_name(F.col("src_file"))).contains("SIMPLII"), F.lit(simplii)).otherwise(F.lit(account))
    return _card(rows, CIBC, strict_amount(debit), own, keep, day)


def normalize_ctfs(rows: DataFrame, account: str) -> DataFrame:
    """Without payments by type whose description says so."""
    payment = (F.upper(_at("fields", 2)) == "PAYMENT") & F.upper(_at("fields", CTFS.merchant)).rlike("PAYMENT|PMT")
    return _card(rows, CTFS, strict_amount(_at("fields", CTFS.amount)), F.lit(account), ~payment)


def normalize_mbna(rows: DataFrame, account: str) -> DataFrame:
    """Signs are turned."""
    return _card(rows, MBNA, (-strict_amount(_at("fields", MBNA.amount))).cast("decimal(18,4)"), F.lit(account))


def normalize_pcf(rows: DataFrame, account: str) -> DataFrame:
    """Leading minus signs are dropped, and so are payments."""
    return _card(rows, PCF, strict_amount(F.regexp_replace(_at("fields", PCF.amount), "^-+", "")), F.lit(account), F.upper(_at("fields", 1)) != "PAYMENT")


def normalize_rogers(rows: DataFrame, account: str) -> DataFrame:
    """Dollar signs are dropped, and so are rows of a negative amount."""
    amount = F.replace(_at("fields", ROGERS.amount), F.lit("$"), F.lit(""))
    return _card(rows, ROGERS, strict_amount(amount), F.lit(account), ~amount.startswith("-"))


def normalize_scotia(rows: DataFrame, account: str) -> DataFrame:
    """Debits only."""
    return _card(rows, SCOTIA, strict_amount(_at("fields", SCOTIA.amount)), F.lit(account), _at("fields", 5) == "Debit")


def _chequing(rows: DataFrame, layout: Layout, description: Column, account: str) -> DataFrame:
    return rows.select(
        "src_file", "row_idx", parse_date(_at("fields", layout.date), *layout.formats).alias("txn_date"), description.alias("description"),
        clean_amount(_at("fields", layout.amount)).alias("amount"), clean_amount(_at("fields", layout.balance)).alias("balance"), F.lit(account).alias("account"), "line",
    )


def normalize_eqbank(rows: DataFrame, account: str) -> DataFrame:
    """S10"""
    return _chequing(rows, EQBANK, _at("fields", EQBANK.merchant), account)


def normalize_scotia_chequing(rows: DataFrame, account: str) -> DataFrame:
    """The sub-description follows after a dash; rows without a date are left out."""
    description = F.concat_ws(" - ", _at("fields", 1), F.when(_at("fields", 2) != "", _at("fields", 2)))
    return _chequing(rows.where(F.coalesce(_at("fields", 0), F.lit("")) != ""), SCOTIA_CHEQUING, description, account)


def rejects(rows: DataFrame, value: str = "amount") -> tuple[DataFrame, DataFrame]:
    """Rows that are whole, and bad_rows (src_file, row_idx, line, reason) with those that aren't."""
    reason = F.concat_ws(", ", F.when(F.col("txn_date").isNull(), "date"), F.when(F.col(value).isNull(), "amount"))
    marked = rows.withColumn("reason", reason)
    return marked.where("reason = ''").drop("reason", "line"), marked.where("reason != ''").select("src_file", "row_idx", "line", "reason")


def route_by_name(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (file_name, import_type, importer, rule) whose pattern fits; rules (ord, pattern, case_sensitive, import_type, importer, rule)."""
    fits = F.expr("rlike(IF(case_sensitive, file_name, lower(file_name)), pattern)")
    if not small_enough(rules):
        raise ValueError(f"more than {MOST_BROADCAST} routing patterns; every one is tried on every file name")
    return files.join(F.broadcast(rules), fits).select("file_name", "ord", "import_type", "importer", "rule")


def validate_header(routes: DataFrame, files: DataFrame, required: DataFrame) -> DataFrame:
    """Adds valid: whether the file's header has all columns that the rule asks for, in any case; null where it asks for none.

    A rule with `headerless` also accepts a first row of a date and a numeric fourth field.
    """
    joined = routes.join(files, "file_name").join(required, "rule", "left")
    upper = lambda c: F.transform(c, lambda h: F.upper(F.trim(h)))
    named = F.size(F.array_except(upper(F.col("required")), upper(F.col("header")))) == 0
    first = parse_date(F.get("first_row", F.lit(0)), "M/d/yyyy", "yyyy-MM-dd").isNotNull() & F.get("first_row", F.lit(3)).try_cast("decimal(18,4)").isNotNull()
    valid = F.when(F.col("required").isNotNull(), named | (F.coalesce("headerless", F.lit(False)) & F.coalesce(first, F.lit(False))))
    return joined.select(*routes.columns, valid.alias("valid"))


def resolve_routes(routes: DataFrame) -> DataFrame:
    """A file's only rule without a validator is accepted; else the validated ones; a single failed one gives nothing; several that all failed stay to be asked about."""
    own = Window.partitionBy("file_name")
    counted = routes.withColumn("n", F.count("*").over(own)).withColumn("good", F.count_if(F.col("valid")).over(own))
    keep = (F.col("n") == 1) & F.col("valid").isNull() | F.coalesce("valid", F.lit(False)) | (F.col("n") > 1) & (F.col("good") == 0)
    return counted.where(keep).withColumn("asked", (F.col("n") > 1) & (F.col("good") == 0)).drop("n", "good")


def chequing_type(header: Column) -> Column:
    """Eqbank before scotia by the columns in the header, null for neither."""
    names = F.transform(header, lambda h: F.trim(h))
    has = lambda *wanted: F.size(F.array_except(F.array(*map(F.lit, wanted)), names)) == 0
    return F.when(has("Transfer date", "Description", "Amount", "Balance"), "eqbank").when(has("Date", "Description", "Sub-description", "Amount", "Balance"), "scotia")
