"""rule layers from TOML files. A path is one layer, in the order given; a path that is not there is an empty layer."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RULES = "rules ARRAY<STRUCT<keywords: ARRAY<STRING>, category: STRING, tags: ARRAY<STRING>, priority: INT, exact_only: BOOLEAN>>, exact_only_keywords ARRAY<STRING>"
FAMILIES = "families ARRAY<STRUCT<canonical: STRING, aliases: ARRAY<STRING>>>"
ACCOUNTS = "accounts MAP<STRING, STRING>"


@F.pandas_udf(StringType())
def _json_of_toml(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: json.dumps(tomllib.loads(text or ""), default=str))


def read_layers(spark: SparkSession, *paths: str) -> DataFrame:
    """(layer, text), one row for each file of a path."""
    layers = spark.createDataFrame([], "layer int, text string")
    for layer, path in enumerate(paths):
        try:
            text = spark.read.text(path, wholetext=True)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        layers = layers.unionByName(text.select(F.lit(layer).alias("layer"), F.col("value").alias("text")))
    return layers


def _entries(layers: DataFrame, schema: str, entries: str) -> DataFrame:
    """layer, the document as d, the place of an entry as ord and the entry as e. A text that is no TOML fails the job: rules are configuration."""
    documents = layers.select("layer", F.from_json(_json_of_toml("text"), schema).alias("d"))
    return documents.select("layer", "d", F.posexplode(F.col(f"d.{entries}")).alias("ord", "e"))


def _listed(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def merchant_rules(layers: DataFrame) -> DataFrame:
    """(layer, ord, keywords, category) of [[rules]]; keywords in upper case, none where a rule lists none."""
    return _entries(layers, RULES, "rules").select("layer", "ord", F.transform(_listed(F.col("e.keywords")), F.upper).alias("keywords"), "e.category")


def families(layers: DataFrame) -> DataFrame:
    """(layer, ord, canonical, aliases) of [[families]]."""
    return _entries(layers, FAMILIES, "families").select("layer", "ord", "e.canonical", _listed(F.col("e.aliases")).alias("aliases"))


def item_rules(layers: DataFrame) -> DataFrame:
    """(layer, ord, keywords, category, tags, priority, exact_only) of [[rules]].

    A rule with some of the file's exact_only_keywords gives two rows of one order, one for those and one for the others.
    """
    rules = _entries(layers, RULES, "rules")
    only = F.transform(_listed(F.col("d.exact_only_keywords")), F.upper)
    exact = lambda word: F.coalesce(F.col("e.exact_only"), F.lit(False)) | F.array_contains(only, F.upper(word))
    words = _listed(F.col("e.keywords"))
    parts = F.array(*[F.struct(F.filter(words, keep).alias("keywords"), F.lit(flag).alias("exact_only")) for keep, flag in ((lambda w: ~exact(w), False), (exact, True))])
    split = rules.select("layer", "ord", "e", F.explode(parts).alias("part")).where("size(part.keywords) > 0")
    return split.select("layer", "ord", "part.keywords", "e.category", _listed(F.col("e.tags")).alias("tags"), F.coalesce("e.priority", F.lit(0)).alias("priority"), "part.exact_only")


def category_accounts(layers: DataFrame) -> DataFrame:
    """(ord, key, account) of [accounts]; a later layer's entries have higher numbers and win."""
    documents = layers.select("layer", F.from_json(_json_of_toml("text"), ACCOUNTS).alias("d"))
    return documents.select("layer", F.posexplode(F.map_entries("d.accounts")).alias("ord", "e")).select((F.col("layer") * 1_000_000 + F.col("ord")).alias("ord"), "e.key", F.col("e.value").alias("account"))
