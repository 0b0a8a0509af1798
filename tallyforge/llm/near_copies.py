"""Near copies by the exact Jaccard similarity of distinct five-word shingles.

SimHash fingerprints, linked by covering masks, say which sets are compared first; MinHash bands say which pairs of what they leave apart are compared too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyforge.llm.components import connected_components
from tallyforge.llm.shared import addressed, spill, stable
from tallyforge.llm.simhash_dedup import fingerprint_of, simhash_links

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORDS = 5
#: Fingerprints within so many bits are candidates: the most that covering masks of 64 bits are made for.
RADIUS = 6
#: A pair of similarity J shares no band with probability (1 - J^4)^32: 5e-8 at 0.8, less above.
BANDS, DEEP = 32, 4
CHUNK = 2048

_random = np.random.default_rng(5)
_FLIPS = _random.integers(0, 1 << 64, BANDS * DEEP, np.uint64)
_FACTORS = _random.integers(0, 1 << 64, BANDS * DEEP, np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """XXH64 values of the distinct five-word shingles, in order; a text of fewer words is one shingle, one of none has none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(WORDS, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width] + 1))
    return np.unique(np.fromiter((xxh64_intdigest(flat[s:e], 42) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def alike(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of the sizes a and b with so many shared members have a Jaccard similarity of 0.8 at least, in whole numbers."""
    return 9 * shared >= 4 * (a + b)


def _bands(values: np.ndarray) -> list[int]:
    if not len(values):
        return []
    least = np.full(BANDS * DEEP, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), CHUNK):
        least = np.minimum(least, ((values[at : at + CHUNK, None] ^ _FLIPS) * _FACTORS).min(axis=0))
    return [xxh64_intdigest(least[k * DEEP : (k + 1) * DEEP].tobytes(), k) for k in range(BANDS)]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "at_file", "at_row"]
    for batch in batches:
        sets = [shingles(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
        keys = np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        prints = np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
        bands = [_bands(s) for s in sets]
        offsets = np.cumsum([0, *map(len, bands)], dtype=np.int32)
        flat = np.array([b for own in bands for b in own], np.uint64).view(np.int64)
        arrays = [*(batch.column(c) for c in names), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, "key", "shingles", "fp", "bands"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) whose texts are alike."""
    for batch in batches:
        keep = []
        for mine, other in zip(batch.column("mine").cast(pa.binary()), batch.column("other").cast(pa.binary()), strict=True):
            a, b = shingles(mine.as_py()), shingles(other.as_py())
            keep.append(bool(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _compared(group: pa.Table) -> pa.Table:
    """Edges that connect the rows of one task as all their links and their roots so far do."""
    keys = group.column("key").to_pylist()
    sets = [shingles(t.as_py()) for t in group.column("text").cast(pa.binary())]
    label = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    found: list[tuple[int, int]] = []
    # Two members of different roots are not both of the most common one.
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        mark = np.zeros(len(vocabulary), np.int64)
        mark[ids[starts[i] : starts[i] + sizes[i]]] = 1
        for j in np.flatnonzero(alike(np.add.reduceat(mark[ids], starts), sizes, sizes[i])).tolist():
            if label[j] != label[i]:
                found.append((keys[i], keys[j]))
                label[label == label[j]] = label[i]
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """(u, v): pairs of keys that may be alike by their fingerprints, within RADIUS bits of each other.

    Each key is paired with the least one of its fingerprint, and these least ones as the links of the fingerprints are; so a group of any
    size costs a pair a member. Sets without members are left out.
    """
    prints = distinct.where("shingles > 0").select("key", "fp")
    firsts = spill(prints.groupBy("fp").agg(F.min("key").alias("first")), "fingerprints")
    same = prints.join(firsts, "fp").where("key != first").select(F.col("key").alias("u"), F.col("first").alias("v"))
    # Each becomes a row a mask where it is read, and its file is small: with the number given, adaptive execution leaves that to many tasks.
    spread = firsts.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    links = simhash_links(spread, RADIUS)
    links = links.join(firsts.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(firsts.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    return same.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_links(distinct: DataFrame, docs: DataFrame, block_rows: int = 2048, block_shingles: int = 1 << 18) -> DataFrame:
    """(node, root) over the keys of distinct shingle sets, joined wherever two sets that share a band, or near fingerprints, are alike.

    First the pairs of fingerprints within RADIUS bits are compared, which joins most copies. Fingerprints of sets that are 0.8 alike are 10 bits
    apart on average, so more is done for the rest: every set is compared with the least one of each of its buckets, unless they are joined already,
    which costs a row per set and bucket and joins the large groups. Only in buckets of three or more that are still of several roots is each
    member outside the most common root then compared with all others. These are dealt by hash into blocks of about so many rows and shingles at most, so that no task
    holds more than two blocks, however large the bucket; equal lists of members are compared once. Sets without members have no bands and no
    links; `distinct` has one row of each key. A set that has no link is not in the result, and an empty table gives no rows.
    """
    pairs = spill(fingerprint_pairs(distinct), "pairs")
    rows = distinct.select("key", "shingles", F.explode("bands").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("key").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = spill(rows.join(hubs, "bucket"), "buckets")
    keys = members.select("key").unionByName(pairs.select(F.col("u").alias("key"))).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    wanted = distinct.join(keys, "key").select("key", F.col("first.at_file").alias("at_file"), F.col("first.at_row").alias("at_row"))
    texts = spill(addressed(docs, "text").join(wanted, ["at_file", "at_row"]).select("key", "text"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("key").alias("u"), F.col("text").alias("mine")), "u").join(texts.select(F.col("key").alias("v"), F.col("text").alias("other")), "v")
        return both.mapInArrow(_confirmed, "u bigint, v bigint")

    close = spill(confirmed(pairs), "close")
    joined = connected_components(close)
    stars = members.where("key != hub").select(F.col("key").alias("u"), F.col("hub").alias("v")).distinct()
    for end in ("u", "v"):
        stars = stars.join(joined.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    stars = stars.where("coalesce(u_root, u) != coalesce(v_root, v)").select("u", "v")
    edges = spill(close.unionByName(confirmed(stars)), "stars")
    roots = connected_components(edges)

    rooted = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", "shingles", F.coalesce("root", "key").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("shingles").alias("all"), F.min("root").alias("low"), F.max("root").alias("high")).where("size > 2 AND low != high")
    blocks = F.greatest(F.ceil(F.col("size") / block_rows), F.ceil(F.col("all") / block_shingles))
    mixed = rooted.join(mixed.select("bucket", blocks.alias("blocks")), "bucket")
    mixed = mixed.select("bucket", "key", "root", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("own"), (F.col("blocks") - 1).alias("last"))
    dealt = mixed.select("bucket", "key", "root", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("other"))
    dealt = dealt.groupBy("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).agg(F.sort_array(F.collect_list(F.struct("key", "root"))).alias("members"))
    tasks = dealt.select("members").distinct().select(F.xxhash64("members").alias("task"), F.explode("members").alias("m")).select("task", "m.*").distinct()
    more = tasks.join(texts, "key").groupBy("task").applyInArrow(_compared, "u bigint, v bigint")
    more = spill(more, "blocks")
    return roots if more.isEmpty() else connected_components(edges.unionByName(more))


def near_copies(docs: DataFrame) -> DataFrame:
    """at_file and at_row of the rows that are near copies of one that stays.

    Documents whose sets of distinct five-word shingles (lower-case ASCII, white space folded) have a Jaccard similarity of 0.8 or more are linked.
    In each component the row with the smallest id stays, by address among rows that repeat it, null ids last. Null and empty
    texts are alike; texts of fewer than five words are one shingle. Equal sets are folded before anything is compared.
    """
    docs = stable(docs)  # both reads must give a row one address
    rows = addressed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    prints = spill(rows.mapInArrow(_prints, "doc_id bigint, at_file bigint, at_row bigint, key bigint, shingles bigint, fp bigint, bands array<bigint>"), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at_file", "at_row")
    distinct = spill(prints.groupBy("key").agg(F.min(order).alias("first"), F.first("shingles").alias("shingles"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
    roots = near_links(distinct, docs)
    rooted = distinct.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    least = spill(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")  # a plain table, so that the joins can split a hot root
    known = spill(rooted.join(least, "root").select("key", "least"), "known")
    same = (F.col("least.at_file") == F.col("at_file")) & (F.col("least.at_row") == F.col("at_row"))
    return prints.select("key", "at_file", "at_row").join(known, "key").where(~same).select("at_file", "at_row")
