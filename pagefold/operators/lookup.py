"""Lookups: destinations, page labels, resources, gap filling and rectangles.

Ranges are looked up by a union with the ranges and the last one seen, so the plan is one sort and no inequality join.
Rectangles meet through a grid of cells, so they are an equality join whose fan-out is bounded by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlaps


def resolve_links(links: DataFrame, destinations: DataFrame, keys: list[str], target: str) -> DataFrame:
    """links with ``target`` and ``status``: inline (no key), dangling (no such destination), unreadable (it has no page) or named.

    Names and byte strings are separate key spaces, so the kind belongs to the keys.
    """
    known = destinations.select(*keys, target, F.lit(True).alias("_known"))
    joined = links.join(known, keys, "left")
    status = F.when(F.col(keys[-1]).isNull(), "inline").when(F.col("_known").isNull(), "dangling").when(F.col(target).isNull(), "unreadable").otherwise("named")
    return joined.withColumn("status", status).drop("_known")


def dangling(references: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    return references.join(objects.select(*keys).distinct(), keys, "left_anti")


def fill_gaps(records: DataFrame, scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Records, and scanned ones for keys that have no record: a scan never overrides what was read."""
    return records.unionByName(scanned.join(records.select(*keys).distinct(), keys, "left_anti"))


def _bucket(x: Column, cuts: list[float], low: int, high: int) -> Column:
    """How many of the sorted cuts lie at or before x, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(x < cuts[middle], _bucket(x, cuts, low, middle)).otherwise(_bucket(x, cuts, middle + 1, high))


def last_range(points: DataFrame, ranges: DataFrame, at: str, begin: str, columns: list[str], by: list[str] | None = None, buckets: int = 200) -> DataFrame:
    """Each point with the columns of the last range that begins at or before it (by group); of equal beginnings the largest row counts.

    Without groups, numbers are dealt into so many buckets of about the same number of points, each of which starts with the last range of
    the buckets before it: a row for each bucket.
    """
    marks = ranges.groupBy(*(by or []), begin).agg(F.max(F.struct(*columns)).alias("_range")).withColumnRenamed(begin, at).withColumn("_mark", F.lit(0))
    both = points.withColumn("_mark", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    group = by or ["_bucket"]
    if not by:
        cuts = sorted(set(points.approxQuantile(at, [k / buckets for k in range(1, buckets)], 0.2 / buckets)))
        bucket = lambda x: _bucket(F.col(x), cuts, 0, len(cuts))
        both = both.withColumn("_bucket", bucket(at))
        held = marks.groupBy(bucket(at).alias("_bucket")).agg(F.max_by("_range", at).alias("_own"))
        every = points.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_bucket")).join(F.broadcast(held), "_bucket", "left")
        earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select("_bucket", F.last("_own", ignorenulls=True).over(earlier).alias("_carried"))
        both = both.join(F.broadcast(carried), "_bucket")
    seen = Window.partitionBy(*group).orderBy(at, "_mark").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_range", ignorenulls=True).over(seen)
    found = both.withColumn("_range", last if by else F.coalesce(last, "_carried")).where("_mark = 1")
    return found.select(*points.columns, *(F.col(f"_range.{c}").alias(c) for c in columns))


def innermost(resources: DataFrame, keys: list[str], value: str, depth: str) -> DataFrame:
    """The value of each name in the innermost dictionary that has it."""
    return resources.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, depth).alias(value))


def overlapping(boxes: DataFrame, areas: DataFrame, by: list[str], cell: float = 200.0) -> DataFrame:
    """boxes (by, box_id, x1, y1, x2, y2) that share area with areas (by, area_id, x1, ...): distinct (by, box_id, area_id)."""

    def cells(frame: DataFrame, tag: str) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
        named = frame.select(*by, f"{tag}_id", *(F.col(c).alias(f"{tag}_{c}") for c in ("x1", "y1", "x2", "y2")))
        return named.withColumn("_cx", F.explode(span(f"{tag}_x1", f"{tag}_x2"))).withColumn("_cy", F.explode(span(f"{tag}_y1", f"{tag}_y2")))

    joined = cells(boxes, "box").join(cells(areas, "area"), [*by, "_cx", "_cy"])
    hit = overlaps(*(F.col(f"box_{c}") for c in ("x1", "y1", "x2", "y2")), *(F.col(f"area_{c}") for c in ("x1", "y1", "x2", "y2")))
    return joined.where(hit).select(*by, "box_id", "area_id").distinct()


def nearest(points: DataFrame, targets: DataFrame, radius: float, by: list[str]) -> DataFrame:
    """The nearest target strictly inside the radius of each point; the smallest target id wins ties.

    A grid of cells as wide as the radius: only neighbouring cells meet.
    """
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = points.withColumn("_cx", F.floor(F.col("x") / radius)).withColumn("_cy", F.floor(F.col("y") / radius))
    p = p.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy")).drop("_dx", "_dy")
    t = targets.select(*by, "target_id", F.col("x").alias("tx"), F.col("y").alias("ty")).withColumn("_cx", F.floor(F.col("tx") / radius)).withColumn("_cy", F.floor(F.col("ty") / radius))
    distance = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
    close = p.join(t, [*by, "_cx", "_cy"]).withColumn("distance", distance).where(F.col("distance") < radius)
    return close.groupBy(*by, "point_id").agg(F.min(F.struct("distance", "target_id")).alias("best")).select(*by, "point_id", "best.target_id", "best.distance")


def translated(keys: DataFrame, messages: DataFrame, language: str, fallback: str = "en") -> DataFrame:
    """keys (key) with the message in a language, else the fallback's, else the key itself."""
    own, other = messages.where(F.col("lang") == language), messages.where(F.col("lang") == fallback)
    joined = keys.join(own.select("key", F.col("message").alias("_own")), "key", "left").join(other.select("key", F.col("message").alias("_other")), "key", "left")
    return joined.select("key", F.coalesce("_own", "_other", "key").alias("message"))
