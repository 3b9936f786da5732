"""Surveys: group, count and order reports over a corpus's objects, filters, annotations, actions and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DECODED_FILTERS

#: Severities in rising order (fixed values).
SEVERITIES = ("ambiguity", "repaired", "violation")


def filter_census(streams: DataFrame, decoded: tuple[str, ...] = DECODED_FILTERS) -> DataFrame:
    """streams: (name, on_image), a row for each filter that a stream names. Streams, images and whether a decoder exists, by name."""
    counted = streams.groupBy("name").agg(F.count(F.lit(1)).alias("streams"), F.count_if("on_image").alias("on_images"))
    return counted.select("name", "streams", "on_images", F.col("name").isin(*decoded).alias("decoded"))


def newest_records(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest record of each key with ``times``, how often the key was written; ties go to the largest row."""
    best = records.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in records.columns if c not in (*keys, *order)))).alias("newest"), F.count(F.lit(1)).alias("times"))
    return best.select(*keys, "newest.*", "times")


def superseded(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keys that a newer record replaces, with how many records are dead."""
    return newest_records(records, keys, order).where("times > 1").select(*keys, (F.col("times") - 1).alias("dead"))


def object_census(records: DataFrame, by: str = "file_id") -> DataFrame:
    """Highest number and counts by kind of each file; object 0 is the head of the free list and not counted."""
    kinds = ("in_file", "free", "in_stream")
    return records.where("obj_num <> 0").groupBy(by).agg(F.max("obj_num").alias("highest"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def members_of(records: DataFrame, container: str, top: int | None = None) -> DataFrame:
    """Members of each container, largest first, then by container."""
    out = records.groupBy(container).agg(F.count(F.lit(1)).alias("members")).orderBy(F.desc("members"), container)
    return out if top is None else out.limit(top)


def count_by_severity(decisions: DataFrame, by: str = "file_id") -> DataFrame:
    return decisions.groupBy(by).agg(*(F.count_if(F.col("severity") == k).alias(n) for k, n in enumerate(SEVERITIES)))


def at_least(decisions: DataFrame, severity: int) -> DataFrame:
    return decisions.where(F.col("severity") >= severity)


def rejected(decisions: DataFrame, by: str = "file_id") -> DataFrame:
    """Files that a strict reading rejects: those with a violation."""
    return decisions.groupBy(by).agg(F.bool_or(F.col("severity") == 2).alias("bad")).where("bad").select(by)


def conforming(files: DataFrame, decisions: DataFrame, by: str = "file_id") -> DataFrame:
    """Files without any decision."""
    return files.join(decisions.select(by).distinct(), by, "left_anti")


def key_census(annotations: DataFrame, readers: DataFrame) -> DataFrame:
    """annotations: (subtype, keys). How many of a subtype carry each key, and whether it is read: readers is (subtype, key)."""
    keys = annotations.select("subtype", F.explode("keys").alias("key"))
    counted = keys.groupBy("subtype", "key").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(readers.withColumn("read", F.lit(True)), ["subtype", "key"], "left").select("subtype", "key", "n", F.coalesce("read", F.lit(False)).alias("read"))


def subtype_census(annotations: DataFrame) -> DataFrame:
    """Annotations by subtype, and pages that have any of it."""
    return annotations.groupBy("subtype").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages"))


def most_frequent(frame: DataFrame, key: str, top: int) -> DataFrame:
    """The census order: count falling, then key rising. A heap on each task, not a full sort."""
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(top)


def absent_keys(standard: DataFrame, present: DataFrame, key: str = "key") -> DataFrame:
    return standard.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def support_counts(entries: DataFrame) -> DataFrame:
    """entries: (support). One row of four counts."""
    levels = ("Modelled", "Declared", "TypeOnly", "Untyped")
    return entries.agg(*(F.count_if(F.col("support") == s).alias(s.lower()) for s in levels))


def occurrence(entries: DataFrame, standard: DataFrame, key: str = "key", by: str = "file_id") -> DataFrame:
    """Files that hold each standard key; keys that none holds have zero."""
    counted = entries.groupBy(key).agg(F.count_distinct(by).alias("files"))
    return standard.join(counted, key, "left").select(key, F.coalesce("files", F.lit(0)).alias("files"))


def image_survey(images: DataFrame, columns: list[str]) -> DataFrame:
    """Images by every combination of the columns and of fewer of them."""
    return images.cube(*columns).agg(F.count(F.lit(1)).alias("n"))


def length_mismatches(declared: DataFrame, scanned: DataFrame, key: str) -> DataFrame:
    """Streams whose declared length differs from the scanned one."""
    return declared.join(scanned, key).where("declared <> scanned").select(key, "declared", "scanned")


def share_best(fonts: DataFrame, group: list[str], value: str, score: str, tie: str) -> DataFrame:
    """Each font with the best value of its group, for those that have none."""
    best = Window.partitionBy(*group).orderBy(F.col(value).isNull(), F.desc(score), tie)
    return fonts.withColumn("shared", F.first(value).over(best))


def compare_graphs(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ, or that one side lacks; ``digits_only`` if only digits differ."""
    joined = left.select(key, F.col(value).alias("left_value")).join(right.select(key, F.col(value).alias("right_value")), key, "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    bare = lambda c: F.regexp_replace(c, "[0-9]", "")
    return joined.select(key, "left_value", "right_value", F.coalesce(bare(F.col("left_value")) == bare(F.col("right_value")), F.lit(False)).alias("digits_only"))
