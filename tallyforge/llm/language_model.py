"""Language-model scoring (operator 9): a weighted backoff automaton over smoothed n-grams.

The corpus is cut into chunks of some megabytes of text, which hold their tokens as numbers of their own words. All that is
counted is counted by one step, tally(): every chunk asks for the totals of its distinct keys, the keys of all chunks meet by
ranges of their hash in groups of a bounded number, and the totals go back to the chunks that asked. Words, n-grams of
each order and the mass that each history gives to its n-grams are tallied in turn; nothing of this is gathered on
the driver, and no step holds more than one chunk or one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyforge.llm.shared import addressed, discard, held, spill, text_of

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
END = np.uint64(xxh64_intdigest(b"\n", 1))  # no word holds white space
START = np.uint64(xxh64_intdigest(b"\t", 1))
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}

CHUNK = "chunk bigint, doc_ids array<bigint>, held array<boolean>, lengths binary, tokens binary, words binary, counts binary, n_all bigint, n_train bigint, n_train_docs bigint"
NUMBERED = "chunk bigint, doc_ids array<bigint>, held array<boolean>, lengths binary, known binary, base binary, tokens binary, hashes binary, totals binary"
ASKED = "shard bigint, chunk bigint, keys binary, n binary"
TOLD = "chunk bigint, shard bigint, totals binary, owned bigint"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


@dataclass(frozen=True)
class Model:
    """What all chunks need to know: parameters and three totals of the training documents."""

    order: int
    least: int
    discount: float
    shards: int
    n_tokens: int = 0
    n_distinct: int = 0
    n_docs: int = 0

    def root(self, counts: np.ndarray) -> np.ndarray:
        """log10 of what the root gives to words that occur so often."""
        return np.log10((counts + 1) / (self.n_tokens + self.n_distinct + 1))


def words_of(text: bytes) -> list[bytes]:
    """The words, A-Z lower-cased."""
    return text.translate(LOWER).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(w, 1) for w in words), np.uint64, len(words))


def extended(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of an n-gram from its history's key and its last word's: 64 bits, mixed so that ranges of it are even."""
    key = history * np.uint64(0x9E3779B97F4A7C15) + word
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(29))


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """The bytes of an array, plane by plane, compressed; of sorted keys, the steps between them."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes, kind: type, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    values = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if rising else values


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_LONG, _BLOB = pa.int64(), pa.binary()
_CHUNK = [("chunk", _LONG), ("doc_ids", pa.list_(_LONG)), ("held", pa.list_(pa.bool_())), *((n, _BLOB) for n in ("lengths", "tokens", "words", "counts")), *((n, _LONG) for n in ("n_all", "n_train", "n_train_docs"))]
_NUMBERED = [("chunk", _LONG), ("doc_ids", pa.list_(_LONG)), ("held", pa.list_(pa.bool_())), *((n, _BLOB) for n in ("lengths", "known", "base", "tokens", "hashes", "totals"))]
_ASKED = [("shard", _LONG), ("chunk", _LONG), ("keys", _BLOB), ("n", _BLOB)]
_TOLD = [("chunk", _LONG), ("shard", _LONG), ("totals", _BLOB), ("owned", _LONG)]


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per chunk: its documents' tokens by number, its words in the order of their hashes, and the words' training counts."""

    def row(first: int) -> pa.RecordBatch:
        lengths = np.array(sizes, np.int64)
        found = _spaced([x for x in lines if x]).dictionary_encode()
        words = [w[:-1] for w in found.dictionary.to_pylist()]
        order = np.argsort(hashes_of(words))
        number = np.empty(len(words), np.int32)
        number[order] = np.arange(len(words), dtype=np.int32)
        flat = number[found.indices.to_numpy(zero_copy_only=False)]
        train = np.repeat(~np.array(held_), lengths)
        counts = np.bincount(flat[train], minlength=len(words)).astype(np.int64)
        blobs = [packed(lengths), packed(flat), zstandard.compress(b" ".join([words[k] for k in order]), 1), packed(counts)]
        return _table([(first, ids, held_, *blobs, len(flat), int(train.sum()), held_.count(False))], _CHUNK)

    ids, held_, sizes, lines, size = [], [], [], [], 0
    first = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "held_out", "at_file", "at_row")]
        for doc_id, out, file, at, text in zip(*columns, batch.column("text").cast(_BLOB), strict=True):
            if not ids:
                first = xxh64_intdigest(f"{file}:{at}") - (1 << 63)
            words = words_of(text.as_py())
            ids.append(doc_id)
            held_.append(out)
            sizes.append(len(words))
            lines.append(b" ".join(words))
            size += len(text.as_py())
            if size >= chunk_bytes:
                yield row(first)
                ids, held_, sizes, lines, size = [], [], [], [], 0
    if ids:
        yield row(first)


def _spaced(lines: list[bytes]) -> pa.Array:
    """The words of lines that hold one space between two words, each with the space behind it."""
    flat = np.frombuffer(b" ".join(lines) + b" " if lines else b"", np.uint8)
    ends = np.concatenate(([0], np.flatnonzero(flat == 32) + 1)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat)])


def _asked(chunk: int, keys: np.ndarray, n: np.ndarray, shards: int, words: list[bytes] | None = None) -> list[tuple]:
    """Rows of ASKED: sorted keys cut by ranges of their upper half; words are sent themselves, in the order of their keys."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)])) if len(keys) else [0]
    values = np.asarray(n, np.float64)
    return [(int(shard[a]), chunk, zstandard.compress(b" ".join(words[a:b]), 1) if words is not None else packed(keys[a:b], True), packed(values[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _ask_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, words, counts in zip(*(batch.column(c) for c in ("chunk", "words", "counts")), strict=True):
            own = zstandard.decompress(words.as_py()).split()
            yield _table(_asked(chunk.as_py(), hashes_of(own), unpacked(counts.as_py(), np.int64), shards, own), _ASKED)


def _totals(table: pa.Table, words: bool) -> pa.Table:
    """The sum of n over all rows for each key of each row. In one place for each key the sign is negative: that chunk owns it."""
    parts = table.column("keys").to_pylist()
    each = [unpacked(x, np.float64) for x in table.column("n").to_pylist()]
    n, sizes = np.concatenate(each), np.array([len(x) for x in each])
    if words:
        keys = _spaced(list(map(zstandard.decompress, parts)))
    else:
        keys = pa.array(np.concatenate([unpacked(x, np.uint64, True) for x in parts]))
    place = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    totals = np.bincount(place, weights=n)[place]
    first = place > np.concatenate(([-1], np.maximum.accumulate(place)[:-1]))  # numbers are given by first occurrence
    owned = np.add.reduceat((first & (totals > 0)).astype(np.int64), np.cumsum(sizes) - sizes)
    totals[first] *= -1
    found = [packed(t) for t in np.split(totals, np.cumsum(sizes)[:-1])]
    return pa.table([table.column("chunk"), table.column("shard"), pa.array(found, _BLOB), pa.array(owned, _LONG)], names=[n for n, _ in _TOLD])


def tally(asked: DataFrame, tag: str, words: bool = False) -> DataFrame:
    """TOLD from ASKED. A key comes once from each chunk at most, so however hot it is it adds one entry a chunk to its group."""

    def totals(table: pa.Table) -> pa.Table:
        return _totals(table, words)

    return spill(asked.groupBy("shard").applyInArrow(totals, TOLD), tag)


def _told(table: pa.Table, order: int | None = None) -> np.ndarray:
    """All totals that a chunk was told (of an order), in the order of its keys."""
    rows = zip(table.column("shard").to_pylist(), table.column("totals").to_pylist(), table.column("order").to_pylist() if order is not None else [None] * table.num_rows, strict=True)
    return np.concatenate([np.zeros(0), *(unpacked(t, np.float64) for _, t, _ in sorted((r for r in rows if r[2] == order), key=lambda r: r[0]))])


def _numbered(left: pa.Table, right: pa.Table, m: Model) -> pa.Table:
    """Base scores; tokens as numbers of the words that occur often enough for a state, the frequent ones first, after `least` numbers for the counts of the others."""
    (row,) = left.to_pylist()
    totals = np.abs(_told(right)).astype(np.int64)
    tokens, lengths = unpacked(row["tokens"], np.int32), unpacked(row["lengths"], np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    base = np.bincount(doc, weights=m.root(totals)[tokens], minlength=len(lengths)) + m.root(np.array([m.n_docs]))
    known = np.bincount(doc, weights=totals[tokens] > 0, minlength=len(lengths)).astype(np.int64) + (m.n_docs > 0)
    state = totals >= m.least
    kept = np.flatnonzero(state)
    kept = kept[np.argsort(-totals[kept], kind="stable")]
    number = totals.astype(np.int32)
    number[kept] = m.least + np.arange(len(kept))
    words = zstandard.decompress(row["words"]).split()
    blobs = [row["lengths"], packed(known), packed(base), packed(number[tokens]), packed(hashes_of([words[k] for k in kept])), packed(totals[kept])]
    return pa.Table.from_batches([_table([(row["chunk"], row["doc_ids"], row["held"], *blobs)], _NUMBERED)])


class Chunk:
    """A chunk's documents as one run of words, each led by a start and followed by an end. An n-gram is worked out once, and places say which one ends there."""

    def __init__(self, row: dict, m: Model):
        self.m, self.number = m, row["chunk"]
        self.lengths = unpacked(row["lengths"], np.int64)
        tokens = unpacked(row["tokens"], np.int32)
        hashes, totals = unpacked(row["hashes"], np.uint64), unpacked(row["totals"], np.int64)
        stops = np.cumsum(self.lengths + 2)
        self.starts = stops - self.lengths - 2
        n = int(stops[-1])
        self.is_start = np.zeros(n, bool)
        self.is_start[self.starts] = True
        word = np.ones(n, bool)
        word[self.starts] = word[stops - 1] = False
        self.train = np.repeat(~np.array(row["held"]), self.lengths + 2)
        end = m.least + len(hashes)
        which = np.full(n, end, np.int32)
        which[self.starts] = end + 1
        which[word] = tokens
        counts = np.concatenate((np.arange(m.least), totals, [m.n_docs, m.n_docs])).astype(np.float64)
        kept = counts >= m.least
        kept[end + 1] = True
        #: By order: which distinct n-gram ends at each place; keys of the distinct ones, their counts, and whether they are in the model.
        self.which, self.keys = [which], [np.concatenate((np.zeros(m.least, np.uint64), hashes, np.array([END, START])))]
        self.counts, self.kept = [counts], [kept]
        #: By order from 2: one place of each distinct n-gram, and those that this chunk owns.
        self.places: list[np.ndarray] = []
        self.owned: list[np.ndarray] = []

    def propose(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, distinct keys and inverse of the next order's n-grams; both parts of one must be in the model, which loses none that could be."""
        before = self.which[-1]
        kept = self.kept[-1][before]
        places = 1 + np.flatnonzero(kept[:-1] & kept[1:] & ~self.is_start[1:])
        keys, inverse = np.unique(extended(self.keys[-1][before[places - 1]], self.keys[0][self.which[0][places]]), return_inverse=True)
        return places, keys, inverse

    def learn(self, told: np.ndarray) -> None:
        """Takes in the totals of what propose() gave. One more number stands for no n-gram of the order."""
        places, keys, inverse = self.propose()
        which = np.full(len(self.is_start), len(keys), np.int32)
        which[places] = inverse
        one = np.zeros(len(keys), np.int64)
        one[inverse] = places
        counts = np.abs(told)
        kept = counts >= self.m.least
        self.which.append(which)
        self.keys.append(np.append(keys, np.uint64(0)))
        self.counts.append(np.append(counts, 0.0))
        self.kept.append(np.append(kept, False))
        self.places.append(one)
        self.owned.append(np.flatnonzero(np.signbit(told) & kept))

    def histories(self) -> np.ndarray:
        """The sorted distinct keys of all states of this chunk."""
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *(k[h] for k, h in zip(self.keys[: self.m.order - 1], self.kept[: self.m.order - 1], strict=True))]))

    def masses(self) -> tuple[np.ndarray, np.ndarray]:
        """histories() and what each gives to the n-grams that this chunk owns."""
        states = self.histories()
        mass = np.zeros(len(states))
        for k, (one, owned) in enumerate(zip(self.places, self.owned, strict=True)):
            history = self.which[k][one[owned] - 1]
            mass += np.bincount(np.searchsorted(states, self.keys[k])[history], weights=self.counts[k + 1][owned] - self.m.discount, minlength=len(states))
        return states, mass

    def arcs(self, masses: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """By order: log10 probability of the arc that each n-gram is, log10 weight of the failure arc of the state that each is; and the longest n-gram in the model at each place."""
        states = self.histories()
        logs, falls = [self.m.root(self.counts[0])], []
        lower = 10.0 ** logs[0]
        longest = self.kept[0][self.which[0]].astype(np.int8)
        for k, one in enumerate(self.places):
            counts = self.counts[k]
            rest = np.ones(len(counts))
            at = np.flatnonzero(self.kept[k] & (counts > 0))
            rest[at] = np.clip(1 - masses[np.searchsorted(states, self.keys[k][at])] / counts[at], 1e-12, 1.0)
            falls.append(np.log10(rest))
            own = np.flatnonzero(self.kept[k + 1])
            history, shorter = self.which[k][one[own] - 1], self.which[k][one[own]]
            p = np.ones(len(self.kept[k + 1]))
            p[own] = (self.counts[k + 1][own] - self.m.discount) / counts[history] + rest[history] * lower[shorter]
            logs.append(np.log10(p))
            lower = p
            longest[self.kept[k + 1][self.which[k + 1]]] = k + 2
        return logs, falls, longest

    def traverse(self, masses: np.ndarray) -> np.ndarray:
        """log10 probability of each document by one pass from left to right: take the arc of the next word, or fail to a shorter history, down to the root.

        The state after a word is the longest n-gram there that is a state, since both parts of an n-gram in the model are in it too. So the state that is carried to each place, the
        failure arcs down to the history of the longest n-gram there, and that n-gram's arc are known for all places at once; a word of no state leads from the root back to it.
        """
        logs, falls, longest = self.arcs(masses)
        state = np.minimum(np.append(0, longest[:-1]), len(falls))
        reach = np.maximum(longest, 1)
        weight = np.zeros(len(longest))
        for k, (fall, which) in enumerate(zip(falls, self.which[:-1], strict=True)):
            at = np.flatnonzero((state > k) & (reach <= k + 1) & ~self.is_start)
            weight[at] += fall[which[at - 1]]
        for k, (log, which) in enumerate(zip(logs, self.which, strict=True)):
            at = np.flatnonzero((reach == k + 1) & ~self.is_start)
            weight[at] += log[which[at]]
        return np.bincount(np.repeat(np.arange(len(self.lengths)), self.lengths + 2), weights=weight, minlength=len(self.lengths))


def _ask_grams(row: dict, told: pa.Table | None, m: Model, order: int) -> list[tuple]:
    """Rows of ASKED for the n-grams of an order, or, with order 0, for the masses."""
    chunk = Chunk(row, m)
    for k in range(2, order or m.order + 1):
        chunk.learn(_told(told, k))
    if order == 0:
        return _asked(chunk.number, *chunk.masses(), m.shards)
    places, keys, inverse = chunk.propose()
    return _asked(chunk.number, keys, np.bincount(inverse, weights=chunk.train[places], minlength=len(keys)), m.shards)


def _ask_first(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield _table(_ask_grams(batch.slice(k, 1).to_pylist()[0], None, m, 2), _ASKED)


def _ask_next(left: pa.Table, right: pa.Table, m: Model, order: int) -> pa.Table:
    (row,) = left.to_pylist()
    return pa.Table.from_batches([_table(_ask_grams(row, right, m, order), _ASKED)])


def _scores(left: pa.Table, right: pa.Table, m: Model) -> pa.Table:
    (row,) = left.to_pylist()
    chunk = Chunk(row, m)
    for k in range(2, m.order + 1):
        chunk.learn(_told(right, k))
    found = chunk.traverse(np.abs(_told(right, 0)) if m.order > 1 else np.zeros(0))
    columns = [
        pa.array(row["doc_ids"], _LONG), pa.array(row["held"]), pa.array(chunk.lengths + 1), pa.array(unpacked(row["known"], np.int64)), pa.array(np.full(len(found), m.n_tokens)),
        pa.array(unpacked(row["base"], np.float64)), pa.array(found, pa.float64()),
    ]
    return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2, order: int = 3, least: int = 2, discount: float = 0.75, chunk_bytes: int = 6 << 20, shard_keys: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability).

    Counts come from all documents whose id's crc32 leaves another remainder than `fold` by `folds`; a null id trains. Every
    n-gram of the training documents that occurs `least` times is in the model, whatever the size of the corpus: it is an arc
    of its history's state and, below the highest order, a state. Absolute discounting, interpolated with the shorter
    history; what discounts and rare n-grams leave of a history is the weight of its failure arc, and the root gives every word
    the base probability. An n-gram can only occur `least` times if its parts do, so longer ones are counted over such parts
    alone, exactly. Words are counted by themselves; an n-gram is known by a key of 64 bits, so of 10^11 distinct ones some
    hundred pairs would share counts, which touches no base score.

    A chunk is about `chunk_bytes` of text, one document at least; a group of tally() has about `shard_keys` keys. Neither
    depends on ids, so repeated and null ids do no harm. Texts of no words are one end token. A null text counts as empty;
    repeated rows are scored each; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = addressed(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), out.alias("held_out"), "at_file", "at_row")
    with held(spark, SMALL_BATCHES):
        chunks = spill(rows.mapInArrow(partial(_chunks, chunk_bytes=chunk_bytes), CHUNK), "chunks", 8)
        n_all, n_train, n_docs = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_all", "n_train", "n_train_docs")]).first()
        shards = max(1, math.ceil(n_all / shard_keys))
        told = tally(chunks.select("chunk", "words", "counts").mapInArrow(partial(_ask_words, shards=shards), ASKED), "words", words=True)
        distinct = told.agg(F.coalesce(F.sum("owned"), F.lit(0))).first()[0]
        m = Model(order, least, discount, shards, n_train + n_docs, distinct + (n_docs > 0), n_docs)

        def number(left: pa.Table, right: pa.Table) -> pa.Table:
            return _numbered(left, right, m)

        numbered = spill(chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(number, NUMBERED), "numbered", 8)
        discard(chunks, told)
        known: list[DataFrame] = []

        def joined(of, schema: str, **how) -> DataFrame:
            def step(left: pa.Table, right: pa.Table) -> pa.Table:
                return of(left, right, m, **how)

            all_told = known[0]
            for more in known[1:]:
                all_told = all_told.unionByName(more)
            return numbered.groupBy("chunk").cogroup(all_told.groupBy("chunk")).applyInArrow(step, schema)

        for k in [*range(2, order + 1), 0] if order > 1 else []:
            asked = numbered.mapInArrow(partial(_ask_first, m=m), ASKED) if k == 2 else joined(_ask_next, ASKED, order=k)
            spilled = tally(asked, f"grams-{k}")
            known.append(spilled.select("chunk", "shard", "totals", F.lit(k).alias("order")))
            known[-1].spilled_to = spilled.spilled_to
        if not known:
            known.append(spark.createDataFrame([], "chunk bigint, shard bigint, totals binary, order int"))
        scores = spill(joined(_scores, SCORES), "scores")
        discard(numbered, *(t for t in known if hasattr(t, "spilled_to")))
    return scores
