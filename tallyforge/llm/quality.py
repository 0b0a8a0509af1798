"""Quality classifier (operator 10): Bradley-Terry scores learnt from preference pairs, cut at a score quantile."""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.shared import addressed, spill, stable, text_of

CUT = 0.3
#: Kinds of characters whose shares are features; of the first three the roots too.
KINDS = (b"#$%&*", b"|", b"!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"\n")
#: Words, and pairs of words, fall into so many buckets each by a hash.
BUCKETS = 128
WIDTH = len(KINDS) + 3 + 7 + 2 * BUCKETS

_KIND_OF = np.array([[byte in kind for byte in range(256)] for kind in KINDS], np.float64)


def features(text: bytes) -> np.ndarray:
    """What the score is learnt from; every value comes from the whole text alone and is finite for the empty one.

    Shares of kinds of characters, sizes of words and lines, how many of them differ, and the roots of the shares of the
    text's words and pairs of words in each hash bucket.
    """
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    length = int(counts[:128].sum() + counts[192:].sum())  # code points
    n = max(1, length)
    shares = _KIND_OF @ counts / n
    words, lines = text.split(), text.split(b"\n")
    count = max(1, len(words))
    hash_of = {w: crc32(w) for w in set(words)}
    ids = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
    pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(57)
    out = np.empty(WIDTH)
    k = len(KINDS)
    out[:k], out[k : k + 3] = shares, np.sqrt(shares[:3])
    out[k + 3 : k + 10] = (
        math.log1p(count), n / count / 10, max(1, len(hash_of)) / count, len(set(lines)) / len(lines), math.log1p(count / len(lines)), float(not length), abs(n / count - 6.0) / 10,
    )
    out[k + 10 : k + 10 + BUCKETS] = np.sqrt(np.bincount((ids % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) / count)
    out[k + 10 + BUCKETS :] = np.sqrt(np.bincount(pairs.astype(np.int64), minlength=BUCKETS) / count)
    return out


def feature_vector(text: Column) -> Column:
    @F.arrow_udf("array<float>")
    def found(texts: pa.Array) -> pa.Array:
        flat = np.concatenate([features(t.as_py()) for t in texts.cast(pa.binary())]).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * WIDTH, flat)

    return found(text)


@dataclass(frozen=True)
class Ranker:
    """score = sum of weights times features; probability() is CUT at the threshold and rises with the score."""

    weights: tuple[float, ...]
    threshold: float = 0.0

    def score(self, text: Column) -> Column:
        weights = np.array(self.weights)

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            return pa.array([float(features(t.as_py()).astype(np.float32) @ weights) for t in texts.cast(pa.binary())], pa.float64())

        return scored(text)

    def probability(self, score: Column) -> Column:
        x = score - F.lit(self.threshold) + F.lit(math.log(CUT / (1 - CUT)))
        return F.lit(1.0) / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def _known(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 8192, partners: int = 4) -> Ranker:
    """Learns the ranking from pairs of one label-1 and one label-0 document by logistic loss on feature differences.

    The sample is bounded: of each class the `per_class` labelled ids with the least hash, one document each, the first by
    address where an id is repeated. Each label-1 document is paired with `partners` different label-0 documents, or with more where
    those would not be used up. Repeated labels of an id count as their greatest; null ids and labels are left out. With one
    class only every weight is 0.
    """
    docs = stable(docs)  # both reads must give a row one address
    known, key = _known(labels), [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("label = 1").orderBy(*key).limit(per_class).unionByName(known.where("label = 0").orderBy(*key).limit(per_class))
    rows = addressed(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * per_class rows of two numbers
    first = rows.groupBy("doc_id", "label").agg(F.min(F.struct("at_file", "at_row")).alias("first"))
    first = F.broadcast(spill(first, "first").select("doc_id", "label", "first.*"))  # as many
    rows = addressed(docs, "doc_id", "text").join(first, ["doc_id", "at_file", "at_row"])
    rows = spill(rows.select("doc_id", "label", feature_vector(text_of()).alias("x")), "sample")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Ranker((0.0,) * WIDTH)
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1)
    above, below = numbered.where("label = 1"), numbered.where("label = 0").select(F.col("n").alias("m"), F.col("x").alias("y"))
    turns = min(n[0], max(partners, -(-n[0] // n[1])))
    pairs = above.select("n", "x", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("k")).withColumn("m", ((F.col("n") + F.col("k") * F.lit(n[0] // turns)) % n[0]).cast("int"))
    pairs = pairs.join(below, "m")
    sign = F.when((F.col("n") + F.col("k")) % 2 == 0, 1.0).otherwise(-1.0)
    pairs = pairs.select(((sign + 1) / 2).alias("label"), F.transform(F.zip_with("x", "y", lambda a, b: a - b), lambda d: (d * sign).cast("double")).alias("d"))
    pairs = spill(pairs, "pairs").select("label", array_to_vector("d").alias("features"))
    model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=60, standardization=True).fit(pairs.coalesce(4))
    return Ranker(tuple(float(w) for w in model.coefficients))


def cut_at_quantile(ranker: Ranker, scores: DataFrame, labels: DataFrame, lost: float = 0.005) -> Ranker:
    """The ranker with its threshold, from (doc_id, score) of all documents.

    Below it lies a share `lost` of all label-1 documents; where the classes stand apart it is moved down to the midpoint towards the
    label-0 documents' upper quantile of the same share. Quantiles are to within a rank of 1/100000.
    """
    known = scores.join(_known(labels), "doc_id")
    of = lambda label, share: F.percentile_approx(F.when(F.col("label") == label, F.col("score")), share, 100_000)
    low, high = known.agg(of(1, lost), of(0, 1 - lost)).first()
    if low is None or high is None:
        return ranker
    return Ranker(ranker.weights, (low + high) / 2 if high < low else low)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: those whose id's crc32 leaves another remainder than 0 by 5."""
    return labels.where(~held_out(F.col("doc_id"), 5, 0))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Ranker, DataFrame]:
    """The ranker that the training labels give, and (doc_id, score) of every document."""
    docs, labels = stable(docs), training_labels(labels)
    ranker = learn(docs, labels)
    scores = spill(docs.select("doc_id", ranker.score(text_of()).alias("score")), "scores")
    return cut_at_quantile(ranker, scores, labels), scores


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; null and empty texts are scored as the empty text.

    A null id is never held out; repeated rows are scored each; other columns are not read. An empty table gives no rows;
    without labels of both classes every score is the cut.
    """
    ranker, scores = fit(docs, labels)
    held = F.coalesce(held_out(F.col("doc_id"), 5, 0), F.lit(False)).alias("held_out")
    return scores.select("doc_id", held, ranker.probability(F.col("score")).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all their columns kept, whose score reaches the cut.

    A null text is scored as the empty one, so equal texts share their fate whatever their ids. Columns may have any names. Without labels
    of both classes every row is kept; an empty table gives no rows.
    """
    docs = stable(docs)
    ranker, _ = fit(docs, labels)
    return docs.where(ranker.probability(ranker.score(text_of())) >= CUT)
