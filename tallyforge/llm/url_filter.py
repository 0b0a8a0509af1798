"""URL filter (operator 1): a blocked Bloom filter of listed canonical URLs, an exact join for its hits, and host rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import spill

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A block is eight words of 64 bits; a key sets one bit in each.
WORDS = 8
#: Query parameters that name a visit and not a page. Fixed values.
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")


@dataclass(frozen=True)
class Rule:
    """`verdict` (allow or block) for a host, its subdomains, and urls whose path starts with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading www., path without trailing slashes, and the sorted query parameters that don't track; no scheme or fragment."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct(length, rule, verdict), or null. The rules are configuration: a short tuple, not data."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def _bit(key: Column, k: int) -> Column:
    place = F.shiftrightunsigned(F.xxhash64(F.lit("bits"), key), 6 * k).bitwiseAND(63).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bloom_blocks(keys: int, bits_per_key: int = 12, most: int = 1 << 17) -> int:
    """A power of two of blocks that give so many keys these bits each, `most` at the utmost."""
    return min(most, 1 << max(0, -(-keys * bits_per_key // (WORDS * 64)) - 1).bit_length())


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): one row per block that has a key. Every task ORs its keys first, so the shuffle has a row per task and block at most."""
    bits = keys.select(_block(F.col(key), blocks).alias("block"), *[_bit(F.col(key), k).alias(f"w{k}") for k in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def probed(rows: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows with a column `hit`: false where the filter shows that their key is not in it. The filter, of a bounded size, is broadcast."""
    hit = F.lit(True)
    for k in range(WORDS):
        hit = hit & (F.col(f"w{k}").bitwiseAND(_bit(F.col(key), k)) != 0)
    joined = rows.withColumn("block", _block(F.col(key), blocks)).join(F.broadcast(bloom), "block", "left")
    return joined.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("hit"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...], bits_per_key: int = 12, most_blocks: int = 1 << 17) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    The longest fitting rule gives the verdict; where none fits, a page is blocked if its canonical URL is among the
    canonical URLs of `listed` (column url), else allowed. The filter has at most `most_blocks` blocks of 64 bytes, 8 MB,
    which bounds the broadcast for any list; on a list too long for that it lets more pages through to the join, which is exact, so no
    verdict changes. Pages that the filter rejects are never shuffled. Pages of one URL may be any share of all: the list
    is distinct, and adaptive execution splits the hot key's pages. A null url or one without :// has an empty host, path and canonical form;
    empty canonical forms are never listed. Repeated rows are judged each; an empty list or table is allowed; other
    columns are not read.
    """
    list_ = spill(listed.select(canonical(F.col("url")).alias("canonical")).where("canonical != ''").distinct(), "listed")
    blocks = bloom_blocks(list_.count(), bits_per_key, most_blocks)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    passed = probed(rows, "canonical", bloom_filter(list_, "canonical", blocks), blocks)
    exact = passed.where("hit").join(list_.withColumn("listed", F.lit(True)), "canonical", "left")
    columns = ["page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed")]
    judged = exact.select(*columns).unionByName(passed.where("NOT hit").withColumn("listed", F.lit(False)).select(*columns))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.withColumn("fit", rule).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "listed")
