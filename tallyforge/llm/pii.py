"""Personal data (operator 2): base patterns as seeds, and contextual patterns learnt from them by bootstrapping.

DataFrame operations only. Spans are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import spill, text_of

#: The base kinds in order, each with its pattern. A possessive quantifier or a look-behind stands where the plain form has one way to match
#: only: the matches are the same, and a long run without a match costs linear time.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


SPAN = "struct<start: int, end: int, value: string, gap: string, next_gap: string>"
#: Spans are gathered in arrays of this many, so that no step copies a long array.
BATCH = 128


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, gap, next_gap>> of a pattern's matches, with the texts before and after that no match covers.

    Starts are sums of the lengths of gaps and matches so far. A lambda sees its own arguments only: what it took from outside
    would be evaluated again for every element.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    parts = F.filter(F.arrays_zip(found.alias("value"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(found)).alias("next_gap")), lambda p: p["value"].isNotNull())

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["value"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"), part["gap"].alias("gap"), part["next_gap"].alias("next_gap")))
        full = F.size(acc["batch"]) >= BATCH
        return F.struct(
            end.alias("at"),
            F.when(full, span).otherwise(F.concat(acc["batch"], span)).alias("batch"),
            F.when(full, F.concat(acc["done"], F.array(acc["batch"]))).otherwise(acc["done"]).alias("done"),
        )

    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("batch"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("done"))
    return F.aggregate(parts, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["batch"]))))


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled and its digits added, is a multiple of 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.try_cast("int").alias("d"), (i % 2 == 1).alias("second")))
    values = F.transform(F.filter(each, lambda e: e["d"].isNotNull()), lambda e: F.when(~e["second"], e["d"]).when(e["d"] > 4, e["d"] * 2 - 9).otherwise(e["d"] * 2))
    return F.aggregate(values, F.lit(0), lambda total, v: total + v) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _around(s: Column) -> list[Column]:
    """The two words before a span, the one before it and the one after it, from the texts between matches, lower-cased."""
    word, gap, first = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]", r"(?<![^\x20\x09-\x0D])"
    left = F.regexp_extract(s["gap"], rf"{first}({word}++){gap}*+$", 1)
    left2 = F.regexp_extract(s["gap"], rf"{first}({word}++){gap}++{word}++{gap}*+$", 1)
    right = F.regexp_extract(s["next_gap"], rf"^{gap}*+({word}*+)", 1)
    return [F.lower(left2).alias("before2"), F.lower(left).alias("before"), F.lower(right).alias("after")]


def matched(text: Column) -> Column:
    """array<struct<kind, start, end, value, passes, before2, before, after>> of the base patterns' matches, in the order of the kinds and then of the starts."""
    return F.concat(*[_matches(text, kind) for kind in KINDS])


def _matches(text: Column, kind: str) -> Column:
    needed = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, F.lit(True))
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    spans = F.when(needed, _spans(text, KINDS[kind])).otherwise(empty)
    if kind == "card":  # a run of fewer digits than a card has is a number and no look-alike of one
        spans = F.filter(spans, lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= 16)
    return F.transform(
        spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _passes(kind, s["value"]).alias("passes"), *_around(s))
    )


#: A digest or key in hexadecimal digits, letters among them, is a seed of the kind secret. It has no base pattern, so that only contexts mark it.
DIGEST = r"(?i)^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{32,}$"


def shape(value: Column) -> Column:
    """The coarse form that instances of a pattern have in common: an address, digits alone, or letters with digits."""
    return F.when(value.contains("@"), "@").when(value.rlike(r"\p{L}"), "x").otherwise("0")


def candidates(text: Column) -> Column:
    """array<struct<start, end, value, before2, before, after>>: words of 5 characters or more with a digit or @, and their neighbours.

    start and end leave out punctuation at the word's ends. A neighbour that is a candidate itself counts as none.
    """
    pattern = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*[0-9@])[^\x20\x09-\x0D]++"
    spans = F.when(text.rlike("[0-9@]"), _spans(text, pattern)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))

    def with_context(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], r"^[^\p{L}0-9+(]*+", 0))
        value = F.regexp_extract(s["value"], r"^[^\p{L}0-9+(]*+(.*?)[^\p{L}0-9)]*+$", 1)
        start = s["start"] + lead
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), *_around(s))

    return F.filter(F.transform(spans, with_context), lambda c: F.length(c["value"]) >= 5)


def _pattern_scores(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, kind, confidence): the share of a pattern's instances that are known to be of the kind, weighed by belief and kept low on few instances."""
    joined = edges.join(known, "instance", "left")
    each = lambda kind: F.struct(F.lit(kind).alias("kind"), F.sum(F.when(F.col("kind") == kind, F.col("belief"))).alias("mass"), F.count_if(F.col("kind") == kind).alias("support"))
    total = edges.groupBy("pattern").agg(F.count("*").alias("all"))  # an instance may be a seed of two kinds
    kinds = joined.groupBy("pattern").agg(F.array(*[each(kind) for kind in [*KINDS, "secret", "no"]]).alias("kinds"))
    hits = kinds.select("pattern", F.inline(F.filter("kinds", lambda s: s["support"] > 0)))
    return hits.join(total, "pattern").select("pattern", "kind", "support", (F.col("mass") / (F.col("all") + 2)).alias("confidence"))


def _supported(edges: DataFrame, support: int) -> DataFrame:
    """The edges of patterns with `support` instances or more: the others never have that many believed ones, so no round has a use for them."""
    wide = edges.groupBy("pattern").agg(F.count("*").alias("all")).where(F.col("all") >= support)
    return edges.join(spill(wide.select("pattern"), "supported"), "pattern", "left_semi")


def find(docs: DataFrame, accept: float = 0.7, support: int = 5) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of struct<kind, start, end>; spans also has what the bootstrapping adds.

    A candidate is a word with a digit or @. Its patterns are the word before it, the two words before it, the words
    round it, and the word after it, each with the candidate's shape; an instance is a candidate's text. Base spans, of
    one word or several, are instances too and the seeds of their kinds, with belief 1; so are digests (DIGEST), of the kind secret. What looks like a base kind
    but fails its check (a card number's last digit, say) is a seed of no kind: it counts against its patterns and is never marked.
    Each round scores the patterns over the pattern-instance graph, by the beliefs in their instances, and then believes
    every instance of the kind that its patterns together say most of (noisy or); a seed keeps its own. A pattern is accepted if it has `support` believed
    instances and a confidence of `accept`; the rounds end when the set of accepted patterns is one that was there before. Those patterns mark all
    their candidates that don't touch a base span, and nothing else is added: a digest in no such context is not marked.

    The graph is built from all documents and has one edge for each distinct pair; a hot pattern is one key of an
    aggregation with partial sums. Patterns of fewer than `support` instances are left out before the rounds, which changes no score. Null texts count as empty and have no spans; null and repeated ids give a row each;
    an empty table gives no rows; other columns are not read.
    """
    text = F.col("text")
    rows = docs.select("doc_id", text_of().alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = spill(rows.select("doc_id", "row", matched(text).alias("matched"), candidates(text).alias("candidates")), "spans")
    rows = rows.select("doc_id", "row", "matched", "candidates", F.expr("transform(filter(matched, m -> m.passes), m -> struct(m.kind AS kind, m.start AS start, m.end AS end))").alias("base"))
    form = shape(F.col("value"))
    touches = "exists(matched, m -> {} m.passes AND m.start < c.end AND c.start < m.end)"
    words = rows.select("row", "matched", F.explode("candidates").alias("c")).where("NOT " + touches.format(""))
    seed = F.when(F.expr(touches.format("NOT")), F.lit("no")).when(F.col("c.value").rlike(DIGEST), F.lit("secret"))
    whole = rows.select("row", F.explode("matched").alias("c")).where("c.passes")
    fields = ["row", "c.start", "c.end", "c.value", "c.before2", "c.before", "c.after"]
    found = words.select(*fields, seed.alias("seed")).unionByName(whole.select(*fields, F.col("c.kind").alias("seed")))
    patterns = [("L", "before", "form"), ("LL", "before2", "before", "form"), ("LR", "before", "form", "after"), ("R", "form", "after")]
    patterns = F.array_distinct(F.array(*[F.concat_ws(" ", F.lit(name), *parts) for name, *parts in patterns]))
    found = spill(found.withColumn("form", form).select("row", "start", "end", F.lower("value").alias("instance"), patterns.alias("patterns"), "seed"), "candidates")
    graph = spill(found.select("instance", F.explode("patterns").alias("pattern")).distinct(), "graph")
    edges = spill(_supported(graph, support), "edges")
    seeds = spill(found.where("seed IS NOT NULL").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct(), "seeds")
    known, sets = seeds, set()
    while True:
        scores = spill(_pattern_scores(edges, known).where(F.col("support") >= support), "patterns")
        accepted = scores.where(F.col("confidence") >= accept).agg(F.count("*"), F.bit_xor(F.xxhash64("pattern", "kind"))).first()
        if accepted in sets:
            break
        sets.add(accepted)
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        believed = edges.join(scores, "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("belief"))
        both = seeds.unionByName(believed.select("instance", "kind", "belief"))
        known = spill(both.groupBy("instance").agg(F.max(F.struct("belief", "kind")).alias("best")).select("instance", "best.kind", "best.belief"), "beliefs")
    best = scores.where((F.col("confidence") >= accept) & (F.col("kind") != "no")).groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    marked = found.where("seed IS NULL OR seed = 'secret'").select("row", "start", "end", F.explode("patterns").alias("pattern")).join(best, "pattern")
    marked = marked.groupBy("row", "start", "end").agg(F.max("best")["kind"].alias("kind"))
    added = marked.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    base = F.col("base")
    rank = {k: i for i, k in enumerate([*KINDS, "secret"])}
    order = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    spans = F.concat(base, F.coalesce("added", F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)")))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(added, "row", "left").select("doc_id", "base", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """find()'s rows as counts of the base kinds, the SHA-256 of the base spans, and all spans, both as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
