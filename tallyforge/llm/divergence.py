"""Source divergence audit (operator 11): how the sources of a language differ in their words, counted through minimal acyclic transducers."""

from __future__ import annotations

import io
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.shared import spill

#: Bytes of UTF-8: those of terms as they are, A-Z lower-cased, all others spaces.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
#: Terms of one transducer, bytes of transducers that go with one reading of the texts, occurrences that a task holds, and terms that meet in one group.
TERMS, LOAD, HELD, BLOCK = 50_000, 64 << 20, 12_000_000, 256
SCALE = 1_000_000_000
#: A state and a character as one number.
CHARS = 1 << 21


class Transducer:
    """The minimal acyclic automaton of sorted terms; the numbers on a term's arcs add up to its ordinal among them.

    Arcs are sorted by state and character. All arrays are numpy's, so that many terms walk through it at once.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray, root: int):
        self.keys, self.targets, self.outputs, self.final, self.root = keys, targets, outputs, final, root

    @classmethod
    def of(cls, terms: list[str]) -> Transducer:
        """From distinct terms in order: what lies behind a term's common beginning with the next can't change any more, and is shared with an equal state if there is one."""
        register: dict[tuple, int] = {}
        path, last = [[False, []]], ""

        def settle(depth: int) -> None:
            while len(path) > depth:
                final, arcs = path.pop()
                path[-1][1][-1][1] = register.setdefault((final, tuple(map(tuple, arcs))), len(register))

        for term in terms:
            same = 0
            for x, y in zip(term, last, strict=False):
                if x != y:
                    break
                same += 1
            settle(same + 1)
            for ch in term[same:]:
                path[-1][1].append([ord(ch), None])
                path.append([False, []])
            path[-1][0], last = True, term
        settle(1)
        root = register.setdefault((path[0][0], tuple(map(tuple, path[0][1]))), len(register))
        below: list[int] = []
        keys, targets, outputs, final = [], [], [], np.zeros(len(register), bool)
        for state, (accepts, arcs) in enumerate(register):
            final[state], n = accepts, int(accepts)
            for label, target in arcs:
                keys.append(state * CHARS + label)
                targets.append(target)
                outputs.append(n)
                n += below[target]
            below.append(n)
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32), final, root)

    def ordinals(self, terms: list[str]) -> np.ndarray:
        """Of each term its ordinal, -1 for one that isn't there."""
        lengths = np.fromiter(map(len, terms), np.int64, len(terms))
        chars = np.frombuffer("".join(terms).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        state, number, alive = np.full(len(terms), self.root), np.zeros(len(terms), np.int64), np.arange(len(terms))
        ended = np.full(len(terms), False)
        depth = 0
        while len(alive) and len(self.keys):
            over = lengths[alive] == depth
            ended[alive[over]] = True
            alive = alive[~over]
            wanted = state[alive] * CHARS + chars[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[at] == wanted
            alive, at = alive[there], at[there]
            state[alive] = self.targets[at]
            number[alive] += self.outputs[at]
            depth += 1
        return np.where(ended & self.final[state], number, -1)

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, keys=self.keys, targets=self.targets, outputs=self.outputs, final=self.final, root=self.root)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Transducer:
        with np.load(io.BytesIO(data), allow_pickle=False) as x:
            return cls(x["keys"], x["targets"], x["outputs"], x["final"], int(x["root"]))


SEEN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("ordinal", pa.int64()), ("n", pa.int64())])


class Numbers:
    """Numbers of terms as they are met."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__

    def of(self, text: bytes) -> np.ndarray:
        """A number for each term of a text."""
        found = text.translate(TERM_BYTES).split()
        return np.fromiter(map(self.number.__getitem__, found), np.int32, len(found))

    def terms(self) -> list[str]:
        return [term.decode() for term in self.number]


def _repeated(value: str, n: int) -> pa.Array:
    return pa.array([value], pa.string()).take(pa.array(np.zeros(n, np.int64)))


def _seen(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): how many of some documents have a term."""
    found: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (numbers, parts) in found.items():
            counts = np.bincount(np.concatenate(parts), minlength=len(numbers.number))
            yield pa.RecordBatch.from_arrays([_repeated(lang, len(counts)), pa.array(numbers.terms(), pa.string()), pa.array(counts)], schema=SEEN)

    for batch in batches:
        for text, lang in zip(batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist(), strict=True):
            numbers, parts = found.setdefault(lang, (Numbers(), []))
            parts.append(np.unique(numbers.of(text.as_py())))
            n += len(parts[-1])
            if n >= held:
                yield from flush()
                found, n = {}, 0
    yield from flush()


def _built(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Transducers of at most `most` terms of a language each, from terms in order."""
    lang, terms = None, []

    def made() -> pa.RecordBatch:
        data = Transducer.of(terms).saved()
        return pa.RecordBatch.from_pydict({"lang": [lang], "first": [terms[0]], "n": [len(terms)], "terms": [terms], "transducer": [data]})

    for batch in batches:
        for own, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist(), strict=True):
            if terms and (own != lang or len(terms) == most):
                yield made()
                terms = []
            lang = own
            terms.append(term)
    if terms:
        yield made()


class Shard(NamedTuple):
    first: str
    base: int
    transducer: Transducer


def _recounted(batches: Iterator[pa.RecordBatch], load: Broadcast, held: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, ordinal, n): how often the kept terms of a load occur in some documents.

    Texts are held as numbers of their terms; each distinct term walks through the transducers once, and its ordinal then counts all of its occurrences.
    """
    shards: dict[str, list[Shard]] = {}
    for lang, first, base, data in load.value:
        shards.setdefault(lang, []).append(Shard(first, base, Transducer.loaded(data)))
    found: dict[str, tuple[Numbers, dict[str, list[np.ndarray]]]] = {}
    n = 0

    def ordinals(lang: str, terms: list[str]) -> np.ndarray:
        order = sorted(range(len(terms)), key=terms.__getitem__)
        inside = [terms[k] for k in order]
        cuts = [bisect_left(inside, s.first) for s in shards[lang]] + [len(inside)]
        out = np.full(len(terms), -1, np.int64)
        for shard, a, b in zip(shards[lang], cuts, cuts[1:], strict=False):
            own = shard.transducer.ordinals(inside[a:b])
            out[order[a:b]] = np.where(own >= 0, own + shard.base, -1)
        return out

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (numbers, by_source) in found.items():
            ordinal = ordinals(lang, numbers.terms())
            for source, parts in by_source.items():
                number, times = np.unique(np.concatenate(parts), return_counts=True)
                own = ordinal[number]
                kept = own >= 0
                arrays = [_repeated(lang, int(kept.sum())), _repeated(source, int(kept.sum())), pa.array(own[kept]), pa.array(times[kept])]
                yield pa.RecordBatch.from_arrays(arrays, schema=COUNTED)

    for batch in batches:
        for text, lang, source in zip(batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
            if lang not in shards:
                continue
            numbers, by_source = found.setdefault(lang, (Numbers(), {}))
            part = numbers.of(text.as_py())
            by_source.setdefault(source, []).append(part)
            n += len(part)
            if n >= held:
                yield from flush()
                found, n = {}, 0
    yield from flush()


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), exact for counts of any size."""
    n = n.astype(object) if len(n) and int(n.max()) >= 2**62 // SCALE else n
    return (1 + SCALE * (n + 1) // total).astype(np.int64)


JUDGED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("ordinal", pa.int64()), ("value", pa.int64())])


def _judged(key: tuple, rows: pa.Table) -> pa.Table:
    """Of some terms of a language and all its sources: each pair's sum, and the terms that a source has more of than the language."""
    lang, block = key[0].as_py(), key[1].as_py()
    info = rows.filter(pc.is_null(rows.column("ordinal")))
    seen = rows.filter(pc.is_valid(rows.column("ordinal")))
    order = sorted(range(info.num_rows), key=info.column("source").to_pylist().__getitem__)
    sources, totals = (info.column(c).take(order).to_pylist() for c in ("source", "n"))
    kept, first = info.column("kept")[0].as_py(), block * BLOCK
    n = np.zeros((len(sources), min(BLOCK, kept - first)), np.int64)
    at = pc.index_in(seen.column("source"), value_set=pa.array(sources, pa.string())).to_numpy()
    n[at, seen.column("ordinal").to_numpy() - first] = seen.column("n").to_numpy()
    p = np.stack([shares(x, t + kept) for x, t in zip(n, totals, strict=True)])
    q = shares(n.sum(axis=0), sum(totals) + kept)
    sums = np.stack([((own - p) ** 2 // p).sum(axis=1) for own in p])
    one, other = np.nonzero(~np.eye(len(sources), dtype=bool))
    more, term = np.nonzero((n > 0) & (p > q))
    names = pa.array(sources, pa.string())
    columns = [
        _repeated(lang, len(one) + len(more)), names.take(pa.array(np.concatenate([one, more]))), pa.concat_arrays([names.take(pa.array(other)), pa.nulls(len(more), pa.string())]),
        pa.concat_arrays([pa.nulls(len(one), pa.int64()), pa.array(first + term)]), pa.array(np.concatenate([sums[one, other], ((p - q) ** 2 // q)[more, term]])),
    ]
    return pa.Table.from_arrays(columns, schema=JUDGED)


def vocabulary(docs: DataFrame, least: int, terms: int = TERMS, held: int = HELD) -> DataFrame:
    """(lang, first, n, base, terms, transducer): the terms that at least so many documents of their language have, in order, cut into transducers.

    `base` is the number of the language's terms before a row's own, so that base and a transducer's ordinal number all of its terms in order.
    """
    seen = docs.select("text", "lang").mapInArrow(partial(_seen, held=held), "lang string, term string, n bigint")
    kept = spill(seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"), "terms")
    parts = max(1, -(-kept.count() // terms))
    sorted_ = kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    built = sorted_.mapInArrow(partial(_built, most=terms), "lang string, first string, n bigint, terms array<string>, transducer binary")
    table = spill(built, "transducers")
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return spill(table.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "vocabulary")


def _loads(table: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Transducers in order, as many at a time as `most` bytes allow, one at least."""
    load, size = [], 0
    for row in table.select("lang", "first", "base", "transducer").orderBy("lang", "first").toLocalIterator():
        if load and size + len(row["transducer"]) > most:
            yield load
            load, size = [], 0
        load.append((row["lang"], row["first"], row["base"], bytes(row["transducer"])))
        size += len(row["transducer"])
    if load:
        yield load


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, terms: int = TERMS, load: int = LOAD, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value and rank of every group of documents of a language and source.

    Part pair has each other source of the language, with the sum over all kept terms of floor((p - q)**2 / q), where p and q are
    both sources' shares of a term in billionths; part term has the `top` terms that the group has more of than its language, by the same measure.
    Equal values go by the item, for terms by their ordinals.

    One reading of the texts finds the terms that at least `least` documents of their language have; sorted, they become minimal acyclic
    transducers of a bounded number of terms each. A second reading streams the texts through them and counts anew. At most `load` bytes of
    transducers are broadcast with a reading; a larger vocabulary takes more readings. A task adds up what it has read before
    anything is shuffled, so a hot source is many tasks' work, and terms meet by blocks of ordinals, so that no group holds
    more than a block of each of a language's sources. Work on pairs of sources is their number times the terms, as the result has them all.

    Nulls in text, lang and source count as empty strings; repeated rows count as often as they come; a source without terms has its
    pairs and no terms; a language without kept terms has pairs of value 0; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    table = vocabulary(rows, least, terms, held)
    counts = spark.createDataFrame([], "lang string, source string, ordinal bigint, n bigint")
    for shipped in _loads(table, load):
        counts = counts.unionByName(rows.mapInArrow(partial(_recounted, load=spark.sparkContext.broadcast(shipped), held=held), counts.schema))
    counts = spill(counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recount")
    groups = rows.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    groups = groups.join(table.groupBy("lang").agg(F.sum("n").alias("kept")), "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept"))
    groups = spill(groups, "groups")
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("kept") - 1) / BLOCK))).alias("block")
    info = groups.where("kept > 0").select("lang", "source", blocks, F.lit(None).cast("bigint").alias("ordinal"), "n", "kept")
    seen = counts.select("lang", "source", F.floor(F.col("ordinal") / BLOCK).alias("block"), "ordinal", "n", F.lit(None).cast("bigint").alias("kept"))
    judged = spill(info.unionByName(seen).groupBy("lang", "block").applyInArrow(_judged, "lang string, source string, other string, ordinal bigint, value bigint"), "judged")

    none = groups.where("kept = 0").select("lang", "source")
    pairs = judged.where("other IS NOT NULL").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(none.join(none.withColumnRenamed("source", "other"), "lang").where("source != other").withColumn("value", F.lit(0).cast("bigint")))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumnRenamed("other", "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(own).alias("rank"))
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = judged.where("other IS NULL").withColumn("rank", F.row_number().over(by_ordinal)).where(F.col("rank") <= top)
    named = table.select("lang", "base", F.posexplode("terms").alias("at", "item")).select("lang", (F.col("base") + F.col("at")).alias("ordinal"), "item")
    best = best.join(named, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)
