"""Stage documents and detections as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "removed BOOLEAN, description STRING, price STRING, quantity INT"
STAGE = f"""
meta STRUCT<schema_version: STRING, receipt_id: STRING, stage: STRING, stage_index: INT, created_at: STRING, created_by: STRING, pass_name: STRING>,
receipt STRUCT<merchant: STRING, `date`: STRING, total: STRING, tax: STRING, subtotal: STRING>,
review STRUCT<merchant: STRING, `date`: STRING, total: STRING, tax: STRING, subtotal: STRING>,
items ARRAY<STRUCT<id: STRING, description: STRING, price: STRING, quantity: INT, review: STRUCT<{REVIEW}>>>,
tenders ARRAY<STRUCT<amount: STRING, account: STRING, kind: STRING, raw_label: STRING>>,
warnings ARRAY<STRUCT<message: STRING, after_item_index: INT>>,
raw_text STRING
"""


def read_stage_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file; documents of the first version have no tenders and get none."""
    read = spark.read.schema(STAGE).option("multiLine", True).json(path)
    return read.withColumn("tenders", F.coalesce("tenders", F.array().cast(read.schema["tenders"].dataType)))


def parse_stage(document: Column) -> Column:
    """S17 for documents in a column; null where it is no JSON object."""
    return F.from_json(document, STAGE)
