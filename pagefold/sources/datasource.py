"""The "pdf" data source: spark.read.format("pdf").option("table", "spans").load(folder), and a writer of one file a row.

A Python source sees paths as its workers do, so this one is for folders mounted on every machine; ``frames.read_pdf`` reads from
any store. Each file is a partition of the scan, and only the wanted frame is made.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .frames import ROWS, SCHEMAS
from .reader import read


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


class PdfFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class PdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str], kind: str, names: list[str]):
        self.options, self.kind, self.names = options, kind, names

    def partitions(self) -> list[PdfFile]:
        path = _local(self.options["path"])
        found = sorted(glob.glob(os.path.join(path, "**", "*.pdf"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        return [PdfFile(p) for p in found]

    def read(self, partition: PdfFile) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            file = read(f.read())
        for row in ROWS[self.kind](file):
            yield (partition.value, *(row[n] for n in self.names))


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class PdfWriter(DataSourceWriter):
    """Rows (name, content) become files; one that a failed job has written is removed."""

    def __init__(self, options: dict[str, str]):
        self.path = _local(options["path"])

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        done = []
        for row in rows:
            path = os.path.join(self.path, f"{row['name']}.pdf")
            with open(f"{path}.part", "wb") as f:
                f.write(bytes(row["content"]))
            os.replace(f"{path}.part", path)
            done.append(path)
        return Written(done)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for path in m.paths if m else []:
                if os.path.exists(path):
                    os.remove(path)


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def kind(self) -> str:
        kind = self.options.get("table", "objects")
        if kind not in SCHEMAS:
            raise ValueError(f"no such table: {kind}; there are {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return f"file_id string, {SCHEMAS[self.kind()]}"

    def reader(self, schema: StructType) -> PdfReader:
        return PdfReader(dict(self.options), self.kind(), schema.names[1:])

    def writer(self, schema: StructType, overwrite: bool) -> PdfWriter:
        return PdfWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)
