"""Written tables: what cuts lineage and survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master (one machine, as in tests) may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        folder = tempfile.mkdtemp(prefix="pagefold-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_ROOT.append(f"file://{folder}")
    return _LOCAL_ROOT[0]


def _remove_at_end(spark: SparkSession, path: str) -> None:
    """The table goes when the application does: results may be read from it as long as that runs."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def write_table(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes a frame as Parquet to the shared folder, in a folder for each value of a column if one is named, and reads it back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _remove_at_end(spark, path)
    schema = df.schema
    if by:
        schema = type(schema)([f for f in schema if f.name != by] + [schema[by]])
    return spark.read.schema(schema).parquet(path)
