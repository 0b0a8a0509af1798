"""Token counts (operator 13): huge documents are encoded in overlapping chunks, spliced where two chunks agree on a token."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import addressed, spill, text_of

#: Characters of a chunk and of what it shares with the next one, and by how much both grow where an alignment fails.
CHUNK, OVERLAP, WIDER = 32_768, 512, (4, 8)
#: A token's key is its place in the document times this, and its id.
IDS = 1 << 24

_loaded: dict = {}
_lock = threading.Lock()


class Pieces:
    """A piece model, and of each of its ids how many characters it spells; a character that is spelled in bytes counts with its first byte."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chars = np.array([self._chars(i) for i in range(self.model.get_piece_size())], np.int64)

    def _chars(self, i: int) -> int:
        piece = self.model.id_to_piece(i)
        return int(int(piece[3:5], 16) & 0xC0 != 0x80) if self.model.is_byte(i) else len(piece)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def pieces(path: str) -> Pieces:
    """One per process."""
    with _lock:
        if path not in _loaded:
            _loaded[path] = Pieces(path)
        return _loaded[path]


def _counted(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    encode = pieces(model).encode
    for batch in batches:
        n = pa.array([len(encode(t.as_py())) for t in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])


def _window(starts: np.ndarray, ids: np.ndarray, first: int, stop: int, begin: int) -> tuple[int, np.ndarray]:
    """How many tokens begin before `first`, and the keys of those that begin from there to `stop`."""
    a, b = np.searchsorted(starts, [first, stop])
    return int(a), (starts[a:b] + begin) * IDS + ids[a:b]


def _chunked(batches: Iterator[pa.RecordBatch], model: str, size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk its number of tokens and those that begin in what it shares with the chunks before and after it."""
    encoder = pieces(model)
    for batch in batches:
        n, before, head, left, tail = [], [], [], [], []
        for text, chunk in zip(batch.column("text"), batch.column("chunk").to_pylist(), strict=True):
            whole = text.as_py()
            ids = np.array(encoder.encode(whole), np.int64)
            n.append(len(ids))
            # The model sets a space before a text, which is at -1 here; a chunk's first token may have it, and so no part in what is shared.
            starts = np.cumsum(np.append(-1, encoder.chars[ids]))
            known = starts[-1] == len(whole)
            starts = starts[:-1] if known else np.empty(0, np.int64)
            ids = ids if known else np.empty(0, np.int64)
            for (at, keys), places, lists in ((_window(starts, ids, 1, overlap, chunk * size), before, head), (_window(starts, ids, size, size + overlap, chunk * size), left, tail)):
                places.append(at)
                lists.append(keys)
        keep = [batch.column(c) for c in ("doc_id", "n_bytes", "at_file", "at_row", "chunk")]
        numbers = [pa.array(x, pa.int64()) for x in (n, before, left)]
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (head, tail)]
        yield pa.RecordBatch.from_arrays([*keep, *numbers, *lists], names=["doc_id", "n_bytes", "at_file", "at_row", "chunk", "n", "before", "left", "head", "tail"])


def _chunks(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """A row per chunk of `size` characters and the first of the next one's, dealt out so that a document's chunks are many tasks' work."""
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut = rows.withColumn("blocks", blocks).withColumn("blocks", F.transform("blocks", lambda b, i: F.concat(b, F.left(F.coalesce(F.get("blocks", i + 1), F.lit("")), F.lit(overlap)))))
    each = cut.select("doc_id", "n_bytes", "at_file", "at_row", F.posexplode("blocks").alias("chunk", "text"))
    return each.repartition("at_file", "at_row", "chunk")


def _spliced(chunks: DataFrame) -> DataFrame:
    """doc_id, n_bytes, at_file, at_row, n_tokens; n_tokens is null where two neighbours share no token.

    Where both neighbours have the same token, the tokens before it are the first chunk's and the others the second one's.
    """
    at = ["at_file", "at_row", "chunk"]
    second = chunks.select("at_file", "at_row", (F.col("chunk") - 1).alias("chunk"), "before", "head")
    zones = chunks.select(*at, "n", "left", "tail").join(second, at)
    shared = F.array_min(F.array_intersect("tail", "head"))
    place = lambda c: F.array_position(c, F.col("shared")) - 1
    dropped = F.col("n") - F.col("left") - place("tail") + F.col("before") + place("head")
    per_zone = zones.withColumn("shared", shared).select(*at, F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_bytes"), (-dropped).alias("n"), F.col("shared").isNull().alias("apart"))
    rows = chunks.select(*at, "doc_id", "n_bytes", "n", F.lit(False).alias("apart")).unionByName(per_zone)
    summed = rows.groupBy("at_file", "at_row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.max("apart").alias("apart"))
    return summed.select("doc_id", "n_bytes", "at_file", "at_row", F.when(~F.col("apart"), F.col("n")).alias("n_tokens"))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, as the piece model gives for the whole text.

    A document of up to `chunk` characters is encoded at once. A longer one is cut into chunks that also hold the first `overlap`
    characters of the next one, each encoded by itself in a task of its own. The model merges the best pair of neighbours, by score and then from
    the left, until none is left, so a row of tokens is a text's encoding exactly if each two neighbours are that of their own
    characters. Two chunks that have one token in common, at the same place, are therefore spliced there: every pair of neighbours then comes from
    one encoding or the other. Documents with neighbours that share no token (a run of spaces may keep two paces for ever)
    are done again with wider chunks and overlaps, up to the whole document.

    A null text counts as empty: no bytes and no tokens. Null and repeated ids are allowed, each row is counted; an empty table gives no rows;
    other columns are not read. Of a long document, only counts and the tokens in its overlaps leave a task.
    """
    rows = addressed(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), "at_file", "at_row").withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    found = rows.where(F.length("text") <= chunk).select("doc_id", "n_bytes", "text").mapInArrow(partial(_counted, model=model), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    left = rows.where(F.length("text") > chunk)
    schema = "doc_id bigint, n_bytes bigint, at_file bigint, at_row bigint, chunk int, n bigint, before bigint, left bigint, head array<bigint>, tail array<bigint>"
    while True:
        chunks = spill(_chunks(left, chunk, overlap).mapInArrow(partial(_chunked, model=model, size=chunk, overlap=overlap), schema), "token-chunks")
        counted = _spliced(chunks)
        found = found.unionByName(counted.where("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens"))
        apart = counted.where("n_tokens IS NULL").select("at_file", "at_row")
        if apart.isEmpty():
            return found.withColumn("over_limit", F.col("n_tokens") > limit)
        left = left.join(apart, ["at_file", "at_row"], "left_semi")
        chunk, overlap = chunk * WIDER[0], min(overlap * WIDER[1], chunk * WIDER[0] // 2)
