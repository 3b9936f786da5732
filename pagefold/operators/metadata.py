"""Metadata that two places declare: the metadata stream wins, and disagreements are decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import same_date

DATES = ("creation_date", "mod_date")


def settle(info: DataFrame, xmp: DataFrame, fields: list[str], key: str = "file_id") -> DataFrame:
    """One record for each file: the metadata stream's value, else the information dictionary's. Empty text is no value."""
    value = lambda side, f: F.when(F.col(f"{side}.{f}") != "", F.col(f"{side}.{f}"))
    joined = info.alias("i").join(xmp.alias("x"), F.col(f"i.{key}") == F.col(f"x.{key}"), "full")
    return joined.select(F.coalesce(f"x.{key}", f"i.{key}").alias(key), *(F.coalesce(value("x", f), value("i", f)).alias(f) for f in fields))


def disagreements(info: DataFrame, xmp: DataFrame, fields: list[str], key: str = "file_id") -> DataFrame:
    """(key, field, info, xmp) where both places say something and it differs; dates count as equal if their parts are."""
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"i.{f}").alias("info"), F.col(f"x.{f}").alias("xmp"), F.lit(f in DATES).alias("date")) for f in fields))
    long = info.alias("i").join(xmp.alias("x"), F.col(f"i.{key}") == F.col(f"x.{key}")).select(F.col(f"i.{key}").alias(key), F.explode(entries).alias("e")).select(key, "e.*")
    both = long.where("info <> '' and xmp <> ''")
    differ = F.when(F.col("date"), ~same_date(F.col("info"), F.col("xmp"))).otherwise(F.col("info") != F.col("xmp"))
    return both.where(differ).select(key, "field", "info", "xmp")
