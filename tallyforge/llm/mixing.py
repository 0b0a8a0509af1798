"""Mixing sources to target weights (operator 8): pivotal dependent rounding of fractional copies in a reduction tree."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.shared import WORD, addressed, spill, stable, text_of, whole_rows

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh `weights` in turn and share `share` times all sizes. A target stops at `most`
    times its source's size and the excess is shared again by weight until none is above. That is water-filling: with the
    sources in order of (cap / weight), a level is right for the first source whose cap it doesn't reach, so two running
    sums over the sources, one row each, settle all of them at once.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("reach", F.col("cap") / F.col("weight"))
    by_reach = Window.orderBy("reach", F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(by_reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(by_reach.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("turn", F.row_number().over(by_reach)).withColumn("level", (share * F.sum("source_size").over(whole) - F.col("full")) / F.col("rest"))
    fits = F.when(F.col("level") <= F.col("reach"), F.struct("turn", "level"))
    return rows.withColumn("level", F.min(fits).over(whole)["level"]).select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"))


def _pivot(frame: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Rounds the copies of a group's rows; one row at most stays fractional, unless this is the last level.

    Two rows with fractional parts p and q and sizes a and b trade mass so that a*p + b*q stays: either p rises by x and q
    falls by x*a/b, or the other way round, each until one part is integral, with the probabilities that keep both means.
    """
    frame = frame.sort_values(["size", "doc_id", "at_file", "at_row"], ascending=False, kind="stable", na_position="last").reset_index(drop=True)
    part = frame["part"].to_numpy(np.float64).copy()
    copies = frame["copies"].to_numpy(np.int64).copy()
    size = frame["size"].to_numpy(np.float64)
    draw = np.random.default_rng([seed, int(frame["place"].iloc[0]), int(frame["bucket"].iloc[0]) & 0x7FFFFFFF, len(frame)]).random(len(frame) + 1)
    open_ = -1
    for i in range(len(frame)):
        if part[i] <= 0.0:
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        a, b = size[j], size[i]
        up = min(1.0 - part[j], part[i] * b / a)  # what j may gain
        down = min(part[j], (1.0 - part[i]) * b / a)  # what j may lose
        if draw[i] * (up + down) < down:
            part[j] += up
            part[i] -= up * a / b
        else:
            part[j] -= down
            part[i] += down * a / b
        open_ = -1
        for k in (j, i):
            if part[k] < 1e-9 or part[k] > 1 - 1e-9:
                copies[k] += int(part[k] > 0.5)
                part[k] = 0.0
            else:
                open_ = k
    if last and open_ >= 0:
        copies[open_] += int(draw[-1] < part[open_])
        part[open_] = 0.0
    frame["part"], frame["copies"] = part, copies
    return frame


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 11, group: int = 4096) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies and its address at_file, at_row.

    Every document of a source should be taken target / source_size times on average. Whole copies are taken at once; the
    fractional rest is rounded by pivotal sampling with sizes as mass, in groups of about `group` rows of a source, chosen by a
    hash of id, size and place in the file, so that a hot source is many groups, and so are rows that repeat an id. Each group leaves one fractional row at most; these go to groups of the next
    level, until one group a source is left, whose last row is rounded by a draw. A source's words so miss its target by
    less than the size of one document. Null texts have size 0, a null source is a source of its own, null ids are allowed;
    rows are drawn from seeds that depend on the data alone. Documents of no words have copies like any other but no mass.
    An empty table gives no rows; other columns are not read.
    """
    # Ids are text while pandas has them, which would make numbers with nulls floats.
    rows = addressed(docs, "doc_id", "source", "text").withColumn("size", word_count(text_of())).drop("text")
    rows = spill(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"), F.count("*").alias("n"))
    targets = spill(source_targets(sizes, share, most, weights).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    targets = targets.withColumn("place", F.xxhash64("source").bitwiseAND(0x7FFFFFFF))
    per = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    known = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "at_file", "at_row", targets["source"], "place", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "n", per.alias("per")
    )
    whole = F.floor(F.col("per") + 1e-9)
    part = F.when(F.col("size") > 0, F.greatest(F.col("per") - whole, F.lit(0.0))).otherwise(0.0)
    known = known.select(
        F.col("doc_id").cast("string").alias("doc_id"), "at_file", "at_row", "source", "place", "size", "source_size", "target", whole.cast("bigint").alias("copies"), part.alias("part"),
        F.pmod(F.xxhash64("doc_id", "size", "at_row"), F.ceil(F.col("n") / group)).alias("bucket"), F.ceil(F.col("n") / group).alias("buckets"),
    )
    settled = known.where("part <= 0")
    todo, depth, count = known.where("part > 0"), 0, targets.agg(F.max("n")).first()[0] or 0
    done = [settled]
    while True:
        last = count <= group
        level = spill(todo.groupBy("source", "bucket").applyInPandas(partial(_pivot, seed=seed + depth, last=last), todo.schema), "level")
        done.append(level.where("part <= 0"))
        if last:
            break
        count, depth = -(-count // group), depth + 1
        buckets = F.ceil(F.col("buckets") / group)
        todo = level.where("part > 0").withColumn("bucket", F.pmod(F.col("bucket"), buckets)).withColumn("buckets", buckets)
    out = done[0]
    for part_of in done[1:]:
        out = out.unionByName(part_of)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "at_file", "at_row")


def take_mix(docs: DataFrame, **how) -> DataFrame:
    """The documents, all their columns kept, each as often as mix() takes it.

    A repeated row is a document of its own; null texts, ids and sources are as in mix(). Columns may have any names. An empty table gives no rows.
    """
    docs = stable(docs)
    taken = mix(docs, **how).where("copies > 0").select("copies", "at_file", "at_row")
    return whole_rows(docs).join(taken, ["at_file", "at_row"]).select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")
