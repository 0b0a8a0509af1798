"""Packing (operator 3): first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import base64
import re
import threading
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import addressed, text_of

#: A run of white space that the pattern of the encoder would walk back over once too often.
LONG_SPACE = re.compile("(?<![SPACES])[SPACES]{10000,}".replace("SPACES", "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"))

_loaded: dict = {}
_lock = threading.Lock()


class Encoder:
    """A byte-level BPE from a file of ranks. A special token's string in a text is that token.

    A run of white space is one piece: all of it at the end of a text, else all but its last character. Very long runs are
    given to an encoder that takes its whole input as one piece, since the pattern's look-ahead would overflow on them.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += [self._some(text[at : run.start()]), self.whole.encode_to_numpy(text[run.start() : stop], disallowed_special=())]
            at = stop
        return np.concatenate([*out, self._some(text[at:])]).astype(np.uint32)

    def _some(self, text: str) -> np.ndarray:
        return self.plain.encode_to_numpy(text, allowed_special="all")


def encoder(ranks_path: str, pattern: str, special: dict[str, int]) -> Encoder:
    """One per process."""
    key = (ranks_path, pattern, *sorted(special.items()))
    with _lock:
        if key not in _loaded:
            _loaded[key] = Encoder(ranks_path, pattern, special)
        return _loaded[key]


def _tokenised(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, special: dict[str, int], end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(ranks_path, pattern, special).ids
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids = [np.append(encode(t.as_py() or ""), np.uint32(end_id)).astype(np.int32) for t in part.column("text")]
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("at_file"), part.column("at_row"), arrays], names=["doc_id", "at_file", "at_row", "ids"])


class Bins:
    """Open bins in a tournament tree: each inner node holds the greatest room below it, so the first bin with enough room is found in log steps."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, length: int) -> int:
        """Takes `length` of the first bin that has the room, and says which it is."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        room[i] -= length
        found = i - self.leaves
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; equal lengths keep their order."""
    bins, used = Bins(max(1, len(lengths)), capacity), [0] * len(lengths)
    bin_of, offset_of = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        b = bins.put(lengths[i])
        bin_of[i], offset_of[i] = b, used[b]
        used[b] += lengths[i]
    return bin_of, offset_of


def _packed(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of a group: full ones are sequences of their own, the rests are packed together."""
    frame = frame.sort_values(["doc_id", "at_file", "at_row"], kind="stable")
    ids = frame["ids"].to_list()
    rests = [k for k, x in enumerate(ids) if len(x) % capacity]
    bin_of, offset_of = first_fit_decreasing([len(ids[k]) % capacity for k in rests], capacity)
    place = dict(zip(rests, zip(bin_of, offset_of, strict=True), strict=True))
    first = int(frame["pack"].iloc[0]) << 32
    following = first + (max(bin_of) + 1 if bin_of else 0)
    out: list[tuple] = []
    for k, (doc_id, x) in enumerate(zip(frame["doc_id"].to_list(), ids, strict=True)):
        for start in range(0, len(x), capacity):
            piece = x[start : start + capacity]
            if len(piece) == capacity:
                at, following = (following, 0), following + 1
            else:
                at = (first + place[k][0], place[k][1])
            out.append((doc_id, start, len(piece), len(x), *at, piece))
    packed = pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    packed["ids_crc32"] = [crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in packed["ids"]]
    return packed


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], capacity: int = 1024, end_id: int = 0, group: int = 1024, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32 and ids.

    A document is its token ids and then end_id; it is cut at multiples of `capacity`. Full pieces are sequences of their
    own; the rest of each document goes to the first sequence with room, longest first, among about `group` documents
    chosen by a hash. Only a group's last sequences stay short, which leaves little padding however many documents
    there are, and no task needs more than one group. Runs of one character of any length are one document like another; the strings
    in `special` are those tokens. A null text counts as empty and is one piece of end_id alone; null and
    repeated ids are allowed; an empty table gives no rows; other columns are not read.
    """
    groups = max(1, -(-docs.count() // group))
    rows = addressed(docs, "doc_id", "text").withColumn("text", text_of()).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    tokens = rows.mapInArrow(partial(_tokenised, ranks_path=ranks_path, pattern=pattern, special=special, end_id=end_id), "doc_id bigint, at_file bigint, at_row bigint, ids array<int>")
    # Ids are text while pandas has them, which would make numbers with nulls floats.
    grouped = tokens.withColumn("pack", F.pmod(F.xxhash64("doc_id", "at_row"), F.lit(groups))).withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = "doc_id string, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint"
    packed = grouped.groupBy("pack").applyInPandas(partial(_shaped, capacity=capacity, keep_ids=keep_ids), schema + ", ids array<int>" * keep_ids)
    return packed.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _shaped(frame: pd.DataFrame, capacity: int, keep_ids: bool) -> pd.DataFrame:
    packed = _packed(frame, capacity)
    return packed if keep_ids else packed.drop(columns="ids")
