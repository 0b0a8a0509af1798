"""Rule matching: merchants, items, families and accounts. Rule tables are ordered; a lower (layer, ord) wins."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import UNCATEGORIZED, normalize_merchant

#: Rules are broadcast only up to this number of keywords; more go through a join on one short piece of each keyword.
MOST_BROADCAST = 20_000
#: Characters of such a piece.
GRAM = 3


def layer_rules(*layers: DataFrame) -> DataFrame:
    """Ordered concatenation; the first table is layer 0."""
    return reduce(DataFrame.unionByName, [rules.withColumn("layer", F.lit(k)) for k, rules in enumerate(layers)])


def known_merchants(rules: DataFrame) -> DataFrame:
    """(layer, ord, pos, keyword), one row per keyword."""
    return rules.select("layer", "ord", F.posexplode("keywords").alias("pos", "keyword"))


def small_enough(rules: DataFrame) -> bool:
    return rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def _pieces(text: Column, size: int) -> Column:
    """Every distinct piece of a text of so many characters."""
    last = F.length(text) - size + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
    return F.array_distinct(F.filter(every, lambda p: F.length(p) == size))


def _side(frame: DataFrame, other: DataFrame, column: Column) -> bool:
    """Whether a column is of the first table."""
    try:
        frame.select(column)
        return True
    except AnalysisException:
        other.select(column)
        return False


def _by_rarest(texts: DataFrame, text: Column, parts: DataFrame, part: Column) -> DataFrame:
    """Pairs of rows of which the text contains the part: they meet at the part's rarest piece among all texts.

    A part of GRAM characters and more has pieces of that size, a shorter one is its own piece. Pieces that no text has leave
    their part out, and of a part's others the one that the fewest texts have is its key; texts that share the key are then tested.
    """
    parts = parts.withColumn("__part", part)
    distinct = parts.select("__part").where("__part IS NOT NULL").distinct()
    # Four sizes at most.
    sizes = [r[0] for r in distinct.select(F.least(F.length("__part"), F.lit(GRAM)).alias("n")).distinct().collect()]
    if not sizes:
        return texts.join(parts, F.lit(False)).drop("__part")
    pieces = F.flatten(F.array(*[_pieces(text, n) if n else F.array(F.lit("")) for n in sizes]))
    index = texts.withColumn("__piece", F.explode(pieces))
    common = index.groupBy("__piece").agg(F.count("*").alias("__n"))
    own = F.when(F.length("__part") < GRAM, F.array("__part")).otherwise(_pieces(F.col("__part"), GRAM))
    each = distinct.withColumn("__piece", F.explode(own)).join(common, "__piece", "left")
    rarest = each.groupBy("__part").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__piece").alias("piece"))).alias("k")).where("k.n > 0")
    keyed = parts.join(rarest.select("__part", F.col("k.piece").alias("__piece")), "__part")
    return index.join(keyed, "__piece").where(text.contains(part)).drop("__piece", "__part")


def containing(names: DataFrame, rules: DataFrame, *tests: tuple[Column, Column]) -> DataFrame:
    """Pairs of a name and a rule of which, in one test (text, part) at least, the text contains the part; each pair once.

    A test's two columns are of one side each, in either order. A table of rules whose counted size allows it is broadcast. Else
    each part meets, by an equi-join, the texts that have its rarest piece of a few characters, and these are then
    checked; rows of both sides need to be distinct for that.
    """
    hit = reduce(Column.__or__, [text.contains(part) for text, part in tests])
    if small_enough(rules):
        return names.join(F.broadcast(rules), hit)
    columns = [*names.columns, *rules.columns]
    found = [_by_rarest(names, text, rules, part) if _side(names, rules, text) else _by_rarest(rules, text, names, part) for text, part in tests]
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in found]).distinct()


def first_match(names: DataFrame, name: str, keywords: DataFrame, keyword: str, value: str, order: list[str]) -> DataFrame:
    """(name, value): for each distinct name the first rule, by `order`, with a keyword that the upper-cased name contains.

    The theta join runs over distinct names, which are far fewer than transactions, and each name's candidates meet
    in a minimum with partial aggregation.
    """
    distinct = names.select(F.col(name).alias("__name")).where(F.col(name).isNotNull()).distinct()
    rules = keywords.select(F.upper(keyword).alias("__keyword"), F.col(value).alias("__value"), F.struct(*order).alias("__order"))
    hits = containing(distinct, rules, (F.upper("__name"), F.col("__keyword")))
    return hits.groupBy("__name").agg(F.min_by("__value", "__order").alias(value))


def categorize(txns: DataFrame, rules: DataFrame, merchant: str = "merchant", callbacks: list[Column] | None = None, default: str = UNCATEGORIZED) -> DataFrame:
    """The caller's expressions first, then the first rule in order, then the default, in a column category."""
    found = first_match(txns, merchant, known_merchants(rules).join(rules.select("layer", "ord", "category"), ["layer", "ord"]), "keyword", "category", ["layer", "ord"])
    joined = txns.join(found, txns[merchant] == found["__name"], "left")
    return joined.select(*[txns[c] for c in txns.columns], F.coalesce(*(callbacks or []), found["category"], F.lit(default)).alias("category"))


def categorize_chequing(txns: DataFrame, rules: DataFrame, description: str = "description") -> DataFrame:
    """The account of the first pattern that the description contains, null if none; no rules at all is an error."""
    if rules.isEmpty():
        raise ValueError("there are no chequing rules")
    found = first_match(txns, description, rules, "pattern", "account", ["ord"])
    return txns.join(found, txns[description] == found["__name"], "left").select(*[txns[c] for c in txns.columns], found["account"].alias("category"))


def canonical_merchants(names: DataFrame, name: str, families: DataFrame) -> DataFrame:
    """(name, normalized, canonical, family) of each distinct name; the first family one of whose aliases equals, contains or is contained in the name."""
    aliases = families.select("layer", "ord", "canonical", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    aliases = aliases.select("layer", "ord", F.col("canonical").alias("family"), normalize_merchant(F.col("canonical")).alias("canonical"), normalize_merchant(F.col("alias")).alias("alias"))
    aliases = aliases.where("alias != '' AND canonical != ''")
    distinct = names.select(F.col(name).alias("name")).where(F.col(name).isNotNull()).distinct().withColumn("normalized", normalize_merchant(F.col("name")))
    either = (F.col("normalized"), F.col("alias")), (F.col("alias"), F.col("normalized"))
    found = containing(distinct.where("normalized != ''"), aliases, *either).groupBy("name").agg(F.min(F.struct("layer", "ord", "canonical", "family")).alias("first"))
    return distinct.join(found, "name", "left").select("name", "normalized", F.coalesce("first.canonical", "normalized").alias("canonical"), F.col("first.family").alias("family"))


def _fold(value: Column) -> Column:
    """What character recognition mixes up: O for 0 and D."""
    return F.translate(F.upper(value), "0D", "OO")


def item_hits(items: DataFrame, rules: DataFrame, description: str = "description") -> DataFrame:
    """(description, rule, exact, ...) of each distinct description and rule that hits it: as a whole word, or, unless the rule is exact only, anywhere after folding."""
    keywords = rules.select("layer", "ord", "category", "tags", "priority", "exact_only", F.explode("keywords").alias("keyword"))
    distinct = items.select(F.col(description).alias("__item")).where(F.col(description).isNotNull()).distinct()
    padded = F.concat(F.lit(" "), F.regexp_replace(F.upper("__item"), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    word = F.concat(F.lit(" "), F.regexp_replace(F.upper("keyword"), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    exact, folded = padded.contains(word), (_fold(F.col("__item")), _fold(F.col("keyword")))
    found = containing(distinct, keywords, (padded, word), folded).withColumn("exact", exact)
    return found.where(F.col("exact") | ~F.coalesce("exact_only", F.lit(False)) & folded[0].contains(folded[1]))


def classify_items(items: DataFrame, rules: DataFrame, description: str = "description") -> DataFrame:
    """Description, category and tags; rows with neither are left out.

    The category is the best of rules with one: by priority, then whole-word hits, then the length of the keyword, then
    the rule's order. Tags are those of all rules that hit, in the order of the rules.
    """
    hits = item_hits(items, rules, description)
    rank = F.struct(F.col("priority"), F.col("exact").cast("int"), F.length("keyword"), (-F.col("layer")), (-F.col("ord")))
    best = F.max_by(F.when(F.col("category").isNotNull(), F.col("category")), F.when(F.col("category").isNotNull(), rank))
    tags = F.array_sort(F.collect_set(F.when(F.size("tags") > 0, F.struct("layer", "ord", "tags"))))
    found = hits.groupBy("__item").agg(best.alias("category"), F.array_distinct(F.flatten(F.transform(tags, lambda t: t["tags"]))).alias("tags"))
    found = found.where(F.col("category").isNotNull() | (F.size("tags") > 0))
    return found.withColumnRenamed("__item", description)


def category_accounts(classified: DataFrame, accounts: DataFrame, default: str = "Expenses:FIXME") -> DataFrame:
    """An account for each row's category, else for its first tag that has one; an Expenses: value stands for itself. Each distinct category with its tags is looked up once."""
    keys = accounts.groupBy("key").agg(F.max_by("account", "ord").alias("account"))
    named = classified.select(F.col("category").alias("__category"), F.coalesce("tags", F.array().cast("array<string>")).alias("__tags")).distinct()
    wanted = F.concat(F.array("__category"), F.col("__tags"))
    each = named.select("__category", "__tags", F.posexplode(wanted).alias("pos", "key")).where("key IS NOT NULL").join(keys, "key", "left")
    direct = F.when(F.col("key").startswith("Expenses:"), F.col("key")).otherwise(F.col("account"))
    found = each.select("__category", "__tags", "pos", direct.alias("account")).where("account IS NOT NULL").groupBy("__category", "__tags").agg(F.min_by("account", "pos").alias("account"))
    same = F.col("category").eqNullSafe(F.col("__category")) & (F.coalesce("tags", F.array().cast("array<string>")) == F.col("__tags"))
    return classified.join(found, same, "left").select(*classified.columns, F.coalesce("account", F.lit(default)).alias("account"))


def account_categories(accounts: DataFrame) -> DataFrame:
    """(account, key), the last mapping of a shared account."""
    return accounts.groupBy("account").agg(F.max_by("key", "ord").alias("key"))


def list_item_categories(rules: DataFrame, accounts: DataFrame) -> DataFrame:
    """U4: distinct (key, account), with the rules that name an account directly."""
    direct = rules.where(F.col("category").startswith("Expenses:")).select(F.col("category").alias("key"), F.col("category").alias("account"))
    return accounts.groupBy("key").agg(F.max_by("account", "ord").alias("account")).unionByName(direct).distinct()
