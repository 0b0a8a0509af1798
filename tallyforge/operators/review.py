"""Review documents: append-only stages per receipt, effective values, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.scalars import MONEY, effective_value, stage_status

TENDER_KINDS = ("card", "gift_card", "cash", "store_credit")


def latest_stage(stages: DataFrame, key: str = "receipt_id", index: str = "stage_index") -> DataFrame:
    """The row with the highest index of each receipt."""
    return stages.groupBy(key).agg(F.max_by(F.struct(*stages.columns), index).alias("last")).select("last.*")


def receipts_by_status(stages: DataFrame, status: str, key: str = "receipt_id", stage: str = "stage") -> DataFrame:
    """Latest stages of a status, in the order of their names."""
    return latest_stage(stages, key).withColumn("status", stage_status(F.col(stage))).where(F.col("status") == status).orderBy(key)


def next_stage(stages: DataFrame, stage: str, actor: str, pass_name: str) -> DataFrame:
    """A further stage for each receipt, cloned from its latest one, with where it came from."""
    last = latest_stage(stages)
    changed = {
        "parent_stage": F.col("stage_index"), "stage_index": F.col("stage_index") + 1, "stage": F.lit(stage), "created_by": F.lit(actor), "pass_name": F.lit(pass_name)
    }
    names = [*last.columns, *([] if "parent_stage" in last.columns else ["parent_stage"])]
    return last.select(*[changed.get(n, F.col(n)).alias(n) for n in names])


def unique_names(names: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """The first row of a name, by key, keeps it; the next ones get _1, _2 and so on. Null names stay null."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(key)) - 1
    return names.withColumn(name, F.when(n > 0, F.concat(F.col(name), F.lit("_"), n.cast("string"))).otherwise(F.col(name)))


def review_text(document: Column, path: str) -> Column:
    return F.get_json_object(document, path)


def has_key(document: Column, key: str) -> Column:
    """Whether a JSON object has the key at all, with null or without."""
    return F.coalesce(F.array_contains(F.json_object_keys(document), key), F.lit(False))


def merge_classification(category: Column, tags: Column, review: Column) -> tuple[Column, Column]:
    """Category and tags after a review, a JSON object: a category that is there replaces even with null, and so do tags; tags are trimmed and lower-cased."""
    reviewed = F.from_json(F.get_json_object(review, "$.tags"), "array<string>")
    clean = lambda a: F.array_distinct(F.transform(a, lambda t: F.lower(F.trim(t))))
    return (
        F.when(has_key(review, "category"), F.get_json_object(review, "$.category")).otherwise(category),
        F.when(has_key(review, "tags"), clean(F.coalesce(reviewed, F.array().cast("array<string>")))).otherwise(clean(tags)),
    )


def drop_removed(items: Column) -> Column:
    """An array of structs with review.removed, without those removed."""
    return F.filter(items, lambda i: ~F.coalesce(i["review"]["removed"], F.lit(False)))


def safe_decimal(text: Column) -> Column:
    """P23"""
    return F.trim(text).try_cast(MONEY)


def safe_date(text: Column) -> Column:
    return F.try_to_date(F.trim(text), "yyyy-MM-dd")


def effective_receipts(detected: DataFrame, review: DataFrame, columns: list[str], key: str = "receipt_id") -> DataFrame:
    """P20: for each column what the review says, else what was detected."""
    joined = detected.alias("d").join(review.alias("r"), key, "left")
    return joined.select(key, *[effective_value(F.col(f"d.{c}"), F.col(f"r.{c}")).alias(c) for c in columns])


def validate_patches(patches: DataFrame) -> DataFrame:
    """Patches (price, day, kind, index as text) with the reasons against them; none of them means it is good. Blank values count as absent."""
    blank = {c: F.when(F.trim(c) != "", F.trim(c)) for c in ("price", "day", "kind", "index")}
    reasons = F.array_compact(
        F.array(
            F.when(blank["price"].isNotNull() & blank["price"].try_cast(MONEY).isNull(), "bad decimal"),
            F.when(blank["day"].isNotNull() & F.try_to_date(blank["day"], "yyyy-MM-dd").isNull(), "bad date"),
            F.when(blank["kind"].isNotNull() & ~F.lower(blank["kind"]).isin(*TENDER_KINDS), "bad kind"),
            F.when(blank["index"].isNotNull() & ~F.coalesce(blank["index"].try_cast("int") >= 0, F.lit(False)), "bad index"),
        )
    )
    return patches.withColumn("reasons", reasons)


def last_patch_wins(patches: DataFrame, key: list[str], order: str = "ord", create: str = "create") -> DataFrame:
    """The last patch of each key; patches that create something are all kept."""
    rest = [c for c in patches.columns if c not in key]
    changes = patches.where(~F.col(create)).groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*key, "last.*")
    return changes.select(*patches.columns).unionByName(patches.where(create))


def apply_patches(items: DataFrame, patches: DataFrame, values: list[str]) -> DataFrame:
    """Items (receipt_id, item_id, pos, values) with the patches' values where they have any, and the created items after them, in order.

    A patch that creates an id that is there already changes it instead; a patch of an unknown id is ignored.
    """
    last = last_patch_wins(patches, ["receipt_id", "item_id"])
    merged = last.groupBy("receipt_id", "item_id").agg(F.max_by(F.struct(*values), "ord").alias("patch"))
    changed = items.join(merged, ["receipt_id", "item_id"], "left").select("receipt_id", "item_id", "pos", *[F.coalesce(f"patch.{v}", v).alias(v) for v in values])
    created = last.where("create").join(items.select("receipt_id", "item_id"), ["receipt_id", "item_id"], "left_anti")
    size = items.groupBy("receipt_id").agg((F.max("pos") + 1).alias("__n"))
    place = F.row_number().over(Window.partitionBy("receipt_id").orderBy("ord")) - 1
    created = created.withColumn("__place", place).join(size, "receipt_id", "left").select("receipt_id", "item_id", (F.coalesce("__n", F.lit(0)) + F.col("__place")).alias("pos"), *values)
    return changed.unionByName(created)


def review_counts(entries: DataFrame) -> DataFrame:
    """Changed, deleted and unresolved entries."""
    return entries.agg(F.count_if("changed").alias("changed"), F.count_if("deleted").alias("deleted"), F.count_if("unresolved").alias("unresolved"))
