"""Near-duplicates by SimHash (operator 5), with candidates from covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyforge.llm.components import connected_components
from tallyforge.llm.shared import addressed, spill, stable, without

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS = 64
CHUNK = 1 << 16


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1)-1 masks such that any two 64-bit values within the radius (1 to 6) agree under at least one of them.

    Bit i gets a vector over GF(2) of radius+1 places, the mask of a vector v takes the bits whose vector has an odd
    product with v. At most `radius` differing bits span at most `radius` dimensions, so some v is orthogonal to all of
    their vectors, and its mask leaves all of them out (Pagh, 2016). The masks are the words of a linear code, and every one should have about
    half of the bits: below seven places the vectors go round the non-zero ones; at seven they are those with the first
    place set, which is the Reed-Muller code, whose words have 32 bits at least.
    """
    if not 1 <= radius <= 6:
        raise ValueError("the radius must be 1 to 6")
    last = (1 << (radius + 1)) - 1
    vectors = [BITS | i if radius == 6 else i % last + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, last + 1)]


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """SimHash of the word shingles with their repeats: a bit is set if it is in over half of their XXH64 values."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(words_per_shingle, len(words))
    stops = ends[width - 1 :]
    starts = np.concatenate(([0], ends[: len(words) - width] + 1))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(stops), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), stops[at : at + CHUNK].tolist(), strict=True)
        ones += _bit_counts(np.array([xxh64_intdigest(flat[s:e], 42) for s, e in spans], "<u8"))
    return int(((2 * ones > len(stops)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of hashes: a bit is set if it is in over half of them; zero without any."""
    return int(((2 * _bit_counts(hashes) > len(hashes)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the values have each bit, from counts of each of their bytes."""
    columns = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T
    return np.concatenate([np.bincount(c, minlength=256) @ _BIT_OF_BYTE for c in columns])


_BIT_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8)) & 1


@dataclass(frozen=True)
class Likeness:
    """Which documents are linked: those whose fingerprints of `words`-word shingles differ in `radius` bits at most."""

    radius: int = 4
    words: int = 4


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "at_file", "at_row"]
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py() or b"", words) for t in batch.column("text").cast(pa.binary())), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found)], names=[*names, "fp"])


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect the values as the links between them do: each to its group's least."""
    if len(values) <= 6:
        plain = values.view(np.uint64).tolist()
        return [(int(values[i]), int(values[j])) for i in range(len(plain)) for j in range(i) if (plain[i] ^ plain[j]).bit_count() <= radius]
    near = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= radius
    label = np.arange(len(values))
    while True:
        least = np.where(near, label[None, :], len(values)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    return [(int(values[i]), int(values[k])) for i, k in enumerate(label.tolist()) if i != k]


def _links(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found: list[tuple[int, int]] = []
        for fps in frame["fps"]:
            found += _forest(np.asarray(fps, np.int64), radius)
        yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def simhash_links(fps: DataFrame, radius: int = 4, block: int = 512) -> DataFrame:
    """Edges (u, v) over distinct fingerprints fp that connect them exactly as all their links would.

    Every pair within the radius shares a bucket of some covering mask. A bucket is dealt by hash into blocks of about `block`
    fingerprints; a task compares one block with itself or two with each other, so that no task holds more than two blocks
    however large the bucket, and gives a spanning forest instead of the pairs. A bucket's size is counted with partial sums, and no
    step numbers its rows, so that adaptive execution can split a hot one.
    """
    # The number of the mask and the masked value make the bucket; what two values share it for is checked exactly later.
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    buckets = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)]))
    rows = fps.select("fp", buckets.alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = rows.join(spill(sizes, "sizes"), "bucket").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = rows.select("fp", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("fp", "bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    tasks = pairs.groupBy("bucket", "p", "q").agg(F.collect_list("fp").alias("fps"))
    return tasks.select("fps").mapInPandas(partial(_links, radius=radius), "u bigint, v bigint").distinct()


def simhash_dedup(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept, and its address at_file, at_row.

    Documents are linked as `how` says and component_id is the smallest doc_id that links reach. In each
    component one row is kept: the one with the smallest id, by address among rows that repeat it; null ids come last,
    and a component of null ids only has a null component_id. Null and empty texts have fingerprint zero and are linked
    like any other; texts of fewer words than a shingle are one shingle. Equal fingerprints are folded before anything
    is compared, so that groups of copies of any size cost one row. An empty table gives no rows; other columns are not read.
    """
    rows = addressed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    prints = spill(rows.mapInArrow(partial(_fingerprints, words=how.words), "doc_id bigint, at_file bigint, at_row bigint, fp bigint"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at_file", "at_row")
    distinct = spill(prints.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    roots = connected_components(simhash_links(distinct.select("fp"), how.radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = spill(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")  # a plain table, so that the joins can split a hot root
    known = spill(rooted.join(least, "root").select("fp", "least"), "known")
    return prints.join(known, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        ((F.col("least.at_file") == F.col("at_file")) & (F.col("least.at_row") == F.col("at_row"))).alias("kept"),
        "at_file",
        "at_row",
    )


def drop_near_copies(docs: DataFrame, how: Likeness | None = None) -> DataFrame:
    """The documents, all their columns kept, with one row of each component: of five-word similarity 0.8 or more, or linked as `how` says.

    The row with the least id stays, null ids last, then by address. Columns may have any names. An empty table gives no rows.
    """
    from tallyforge.llm.near_copies import near_copies  # which goes by the links of this module

    docs = stable(docs)
    return without(docs, near_copies(docs) if how is None else simhash_dedup(docs, how).where("NOT kept"))
