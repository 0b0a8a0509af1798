"""Cross-tokenizer alignment (operator 12): groups between common byte ends, links of tokens that overlap, and how often the corpus links their ids."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Iterator
from functools import partial
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.packing import encoder
from tallyforge.llm.shared import spill, text_of
from tallyforge.llm.token_counts import pieces

#: Links of a block of documents; a longer document is a block of its own.
LINKS = 2_000_000
#: Tokens whose bytes are put together at once.
SPELT = 1 << 16
#: A pair of ids as one number: the first one times this, and the second.
PAIR = 1 << 32

_loaded: dict = {}
_lock = threading.Lock()


class Aligned(NamedTuple):
    """Ids by both tokenizers, where each group ends in either list, and the pairs of ids that overlap."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    links: np.ndarray


class Aligner:
    """A byte-level BPE from a file of ranks, and a piece model that sets a space before its text."""

    def __init__(self, ranks: str, pattern: str, model: str):
        self.a, self.b = encoder(ranks, pattern, {}), pieces(model)
        plain, sp = self.a.plain, self.b.model
        self.bytes_a = [plain.decode_single_token_bytes(i) for i in range(plain.n_vocab)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(sp.get_piece_size())))]
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.ids = max(len(self.bytes_a), len(self.bytes_b))
        self.flat_b, self.first_b = np.frombuffer(b"".join(self.bytes_b), np.uint8), np.cumsum(self.len_b) - self.len_b
        #: An id's digits with what follows: a comma, the bar between a group's halves, or the end of the group; filled up with bytes 0, which no entry has.
        self.digits = np.array([b"%d%c" % (i, end) for end in b",|;" for i in range(self.ids)])

    def spells(self, b: np.ndarray, whole: bytes) -> bool:
        """Whether the bytes of these ids are `whole`; worked out for some ids at a time, since each byte takes the room of a few numbers."""
        at = 0
        for k in range(0, len(b), SPELT):
            ids = b[k : k + SPELT]
            n = self.len_b[ids]
            ends = np.cumsum(n)
            found = self.flat_b[np.arange(ends[-1]) + np.repeat(self.first_b[ids] - ends + n, n)].tobytes()
            if whole[at : at + len(found)] != found:
                return False
            at += len(found)
        return at == len(whole)

    def align(self, text: str) -> Aligned | None:
        """None for a text without tokens, or whose bytes either tokenizer changes."""
        if not text:
            return None
        spaced = " " + text
        a, b, whole = self.a.ids(spaced).astype(np.int64), self.b.model.encode(text, return_type="numpy").astype(np.int64), spaced.encode()
        ends_a = np.cumsum(self.len_a[a])
        # A byte-level token is a piece of its text's own bytes, so that all are there if there are as many; the other model may have changed some.
        if ends_a[-1] != len(whole) or not self.spells(b, whole):
            return None
        ends_b = np.cumsum(self.len_b[b])
        index_a, index_b = (dict(zip(e.tolist(), range(1, len(e) + 1), strict=True)) for e in (ends_a, ends_b))
        # Ends grow, and a dictionary keeps its keys in order.
        common = list(filter(index_b.__contains__, index_a))
        cut_a, cut_b = (np.array(itemgetter(*common, common[-1])(index)[:-1], np.int64) for index in (index_a, index_b))
        # In each slice, the bytes between one end, of either list, and the next are shared by one pair, and no other bytes are.
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        ends = both[np.append(np.diff(both) > 0, True)]
        links = a[np.searchsorted(ends_a, ends)] * PAIR + b[np.searchsorted(ends_b, ends)]
        return Aligned(a, b, cut_a, cut_b, links)

    def groups(self, found: Aligned) -> bytes:
        """a1,a2|b1;a3|b2,b3 in order."""
        in_a, in_b = np.diff(found.cut_a, prepend=0), np.diff(found.cut_b, prepend=0)
        kinds_a, kinds_b = np.zeros(len(found.a), np.int64), np.zeros(len(found.b), np.int64)
        kinds_a[found.cut_a - 1], kinds_b[found.cut_b - 1] = 1, 2
        order = np.empty(len(found.a) + len(found.b), np.int64)
        order[np.arange(len(found.a)) + np.repeat(found.cut_b - in_b, in_a)] = found.a + kinds_a * self.ids
        order[np.arange(len(found.b)) + np.repeat(found.cut_a, in_b)] = found.b + kinds_b * self.ids
        return self.digits[order].tobytes().translate(None, b"\0")[:-1]


def aligner(ranks: str, pattern: str, model: str) -> Aligner:
    """One per process."""
    with _lock:
        if (ranks, pattern, model) not in _loaded:
            _loaded[ranks, pattern, model] = Aligner(ranks, pattern, model)
        return _loaded[ranks, pattern, model]


BLOCK = pa.schema(
    [("block", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])))]
    + [("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)
BLOCK_SQL = "block bigint, docs array<struct<doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string>>, links binary, pairs array<bigint>, times array<bigint>"


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed byte by byte."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _block(number: int, docs: list[dict], links: list[np.ndarray]) -> pa.RecordBatch:
    """Links are kept as places among the block's distinct pairs, of which the most frequent come first."""
    place, pairs = pd.factorize(np.concatenate([np.empty(0, np.int64), *links]))
    times = np.bincount(place, minlength=len(pairs))
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    values = [[number], [docs], [_planes(rank[place])], [pairs[order]], [times[order]]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, BLOCK, strict=True)], schema=BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str, model: str, links: int) -> Iterator[pa.RecordBatch]:
    both, number = aligner(ranks, pattern, model), TaskContext.get().partitionId() << 32
    docs, held, n = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            found = both.align(text.as_py())
            if found is None:
                docs.append({"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""})
            else:
                docs.append({"doc_id": doc_id, "n_a": len(found.a), "n_b": len(found.b), "n_groups": len(found.cut_a), "n_links": len(found.links), "groups_sha256": hashlib.sha256(both.groups(found)).hexdigest()})
                held.append(found.links)
                n += len(found.links)
            if n >= links or len(docs) >= links // 100:
                yield _block(number, docs, held)
                number, docs, held, n = number + 1, [], [], 0
    if docs:
        yield _block(number, docs, held)


RESULT = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])


def _looked_up(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block, with what the corpus says of each one's links."""
    docs = blocks.column("docs").combine_chunks().flatten()
    value = np.zeros(counts.num_rows, np.int64)
    value[counts.column("place").to_numpy()] = counts.column("value").to_numpy()
    link = value[_numbers(blocks.column("links")[0].as_py())] if counts.num_rows else np.empty(0, np.int64)
    ends = np.cumsum(docs.field("n_links").to_numpy())
    within = lambda x: np.diff(np.append(0, np.cumsum(x))[ends], prepend=0)
    columns = {"n_best": pa.array(within(link & 1)), "count_sum": pa.array(within(link >> 1))}
    return pa.Table.from_arrays([columns[f.name] if f.name in columns else docs.field(f.name) for f in RESULT], schema=RESULT)


def align_documents(docs: DataFrame, ranks: str, pattern: str, model: str, links: int = LINKS) -> DataFrame:
    """A row per document: doc_id, n_a and n_b tokens by either tokenizer, n_groups, n_links, n_best, count_sum and groups_sha256.

    Dictionaries from the byte ends of a text's tokens to their places in either list meet in the ends that both have; these, sorted,
    cut both lists into groups, and within a group tokens that share a byte are linked. A pair's count is the number of links of its two ids in
    the corpus; n_best are the links whose count is the highest of any pair with their second id, ties included.

    Documents are aligned once. A block of them (`links` links or one long document) keeps its links as places in a list of its distinct pairs,
    and only these lists are added up, joined with their counts and sent back to their block; none of it passes through the driver or grows with the
    corpus in one task. Null and empty texts, and texts that either tokenizer changes, have no tokens: zeros and an empty
    groups_sha256. Repeated rows count as often as they come; null and repeated ids are allowed; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    blocks = spill(rows.mapInArrow(partial(_blocks, ranks=ranks, pattern=pattern, model=model, links=links), BLOCK_SQL), "alignment")
    each = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = each.groupBy("pair").agg(F.sum("times").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair") % PAIR))
    # A count and whether it is the highest of its second id, in one number.
    valued = counts.withColumn("value", F.shiftleft("count", 1) + (F.col("count") == most).cast("bigint")).select("pair", "value")
    back = each.select("block", "place", "pair").join(valued, "pair").select(F.col("block").alias("of"), "place", "value")
    schema = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in RESULT)
    return blocks.select("block", "docs", "links").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_looked_up, schema)
