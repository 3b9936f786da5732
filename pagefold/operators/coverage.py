"""Coverage: which constructs a corpus presents and which of them are read, by axis.

The frame is long: (file, axis, construct, read). Merging files is a union, so partial aggregation on each task and a final
one over the shuffle give the same result in any order, and once more is no different from once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fraction, percent


def merge_coverage(frame: DataFrame) -> DataFrame:
    """(axis, construct, read) over all files; a construct counts as read if it is read anywhere."""
    return frame.groupBy("axis", "construct").agg(F.bool_or("read").alias("read"))


def coverage_axes(frame: DataFrame) -> DataFrame:
    """Distinct constructs presented and read by axis, and a row with a null axis for all of them."""
    counted = merge_coverage(frame).rollup("axis").agg(F.count(F.lit(1)).alias("presented"), F.count_if("read").alias("read"))
    return counted.select("axis", "presented", "read", fraction(F.col("read"), F.col("presented")).alias("fraction"), percent(F.col("read"), F.col("presented")).alias("percent"))


def coverage_unread(frame: DataFrame) -> DataFrame:
    """Constructs that no file has read."""
    merged = merge_coverage(frame)
    return merged.where(~F.col("read")).select("axis", "construct")


def with_all_axes(counted: DataFrame, axes: DataFrame) -> DataFrame:
    """Counts for every known axis: an axis that no file presents has zeros and no fraction."""
    return axes.join(counted, "axis", "left").select("axis", F.coalesce("presented", F.lit(0)).alias("presented"), F.coalesce("read", F.lit(0)).alias("read"), "percent")
