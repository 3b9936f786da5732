"""Files to frames: one pass of the parser gives all rows of a file; a frame is a typed view of one kind of them.

Input comes from ``binaryFile``, so any store that Spark reads will do and files are dealt over tasks by size. A kind that a query
doesn't ask for isn't computed, and streams' bytes never leave the parser. Rows leave it as Arrow batches with a struct for each kind.
Where several kinds are wanted they are written once, a folder for each kind, so no file is parsed twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import document as doc
from .objects import Stream, kind_of, plain
from .reader import File, read
from .tables import write_table

#: Parsed rows that a task holds before it sends them on.
ROWS_HELD = 50_000

#: Schemas of the frames, without file_id.
SCHEMAS: dict[str, str] = {
    "files": "version string, base int, n_objects int, n_sections int",
    "revisions": "idx int, offset bigint, entries int, has_trailer boolean, form string",
    "xref": "obj_num int, kind string, a bigint, b bigint, superseded boolean",
    "objects": "obj_num int, gen int, kind string, type string, value string, length int",
    "decisions": "seq int, severity int, clause string, found string, action string",
    "catalog": "key string, value_desc string",
    "filters": "obj_num int, name string, position int, on_image boolean",
    "pages": "page int, obj_num int, media_box array<double>, crop_box array<double>, rotate int",
    "commands": "page int, op_index int, op string, operands int",
    "spans": "page int, op_index int, text string, font_size double, is_bold boolean, x double, y double, width double, error string",
    "annotations": "page int, pos int, subtype string, keys array<string>, rect array<double>, flags bigint, action string, dest_kind string, dest_key string",
    "destinations": "key_kind string, key string, page int, view string",
    "fields": "node int, parent int, pos int, t string, ft string, ff bigint, v string, has_da boolean",
    "outline": "node int, parent int, pos int, title string, count int",
    "struct_nodes": "id int, parent int, pos int, tag string, title string, alt string, lang string, page int, page_lost boolean",
    "page_labels": "from_page int, style string, prefix string, start_at int",
    "metadata": "origin string, " + ", ".join(f"{f} string" for f, _, _ in doc.FIELDS),
    "fonts": "obj_num int, name string, font_type string, is_embedded boolean, is_subset boolean, has_to_unicode boolean",
    "signatures": "obj_num int, sub_filter string, signed_at string, ranges array<bigint>, covered bigint",
    "encryption": "handler string, v int, r int, length int, p bigint, access string",
}


def _objects(file: File) -> Iterator[dict]:
    for num, (gen, x) in sorted(file.objects.items()):
        d = x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else {}
        kind = d.get("Type")
        yield {"obj_num": num, "gen": gen, "kind": kind_of(x), "type": str(kind) if kind else None, "value": json.dumps(plain(x)), "length": len(x.data) if isinstance(x, Stream) else None}


ROWS: dict[str, Callable[[File], Iterator[dict]]] = {
    "files": lambda f: iter([{"version": f.version, "base": f.base, "n_objects": len(f.objects), "n_sections": len(f.revisions)}]),
    "revisions": lambda f: ({"idx": k, "offset": o, "entries": n, "has_trailer": t, "form": form} for k, (o, n, t, form) in enumerate(f.revisions)),
    "xref": lambda f: ({"obj_num": n, "kind": k, "a": a, "b": b, "superseded": n in f.superseded} for n, (k, a, b) in sorted(f.records.items())),
    "objects": _objects, "catalog": doc.catalog_rows, "filters": doc.filter_rows, "pages": doc.page_rows, "commands": doc.command_rows, "spans": doc.span_rows, "annotations": doc.annotation_rows,
    "destinations": doc.destination_rows, "fields": doc.field_rows, "outline": doc.outline_rows, "struct_nodes": doc.struct_rows, "page_labels": doc.label_rows, "metadata": doc.metadata_rows, "fonts": doc.font_rows, "signatures": doc.signature_rows, "encryption": doc.encryption_rows,
    "decisions": lambda f: ({"seq": k, "severity": s, "clause": c, "found": x, "action": a} for k, (s, c, x, a) in enumerate(f.decisions)),
}


def schema_of(kind: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[kind])


def _fitting(x: Any, t: pa.DataType) -> Any:
    """A value of a damaged file as its column's type, or null."""
    if x is None:
        return None
    if pa.types.is_struct(t):
        return {f.name: _fitting(x.get(f.name), f.type) for f in t}
    if pa.types.is_list(t):
        return [_fitting(v, t.value_type) for v in x] if isinstance(x, (list, tuple)) else None
    if pa.types.is_boolean(t):
        return x if isinstance(x, bool) else None
    if pa.types.is_integer(t):
        return x if isinstance(x, int) and -(1 << t.bit_width - 1) <= x < 1 << t.bit_width - 1 else None
    if pa.types.is_floating(t):
        return float(x) if isinstance(x, (int, float)) and abs(x) < 1e308 else None
    return str(x).encode("utf-8", "replace").decode()


def _structs(rows: list[dict], t: pa.DataType) -> pa.Array:
    try:
        return pa.array(rows, type=t)
    except (pa.ArrowInvalid, pa.ArrowTypeError, UnicodeError, OverflowError, TypeError):
        return pa.array([_fitting(r, t) for r in rows], type=t)


def parsed(files: DataFrame, kinds: list[str], id_col: str = "path", content_col: str = "content", password: str = "") -> DataFrame:
    """(file_id, kind, a struct for each kind) in one pass over the files; only the struct of a row's kind is set.

    A null content is an empty file; password opens encrypted files, as their user's or owner's.
    """
    unknown = set(kinds) - set(ROWS)
    if unknown:
        raise ValueError(f"no such frames: {sorted(unknown)}")
    ordered = [k for k in ROWS if k in kinds]  # decisions last: other kinds may add some
    schema = T.StructType([T.StructField("file_id", files.schema[id_col].dataType), T.StructField("kind", T.StringType()), *(T.StructField(k, schema_of(k)) for k in ordered)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)

        def batch(ids: pa.Array, kind: str, at: list[int], rows: list[dict]) -> pa.RecordBatch:
            n = len(rows)
            structs = [_structs(rows, out.field(k).type) if k == kind else pa.nulls(n, out.field(k).type) for k in ordered]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, type=pa.int64())), pa.array([kind] * n, type=pa.string()), *structs], schema=out)

        for part in batches:
            ids, held, size = part.column(0), {k: ([], []) for k in ordered}, 0
            for i, content in enumerate(part.column(1)):
                file = read(content.as_py() or b"", password.encode())
                for k in ordered:
                    new = list(ROWS[k](file))
                    held[k][0].extend([i] * len(new))
                    held[k][1].extend(new)
                    size += len(new)
                if size >= ROWS_HELD:
                    yield from (batch(ids, k, *x) for k, x in held.items() if x[1])
                    held, size = {k: ([], []) for k in ordered}, 0
            yield from (batch(ids, k, *x) for k, x in held.items() if x[1])

    return files.select(F.col(id_col).alias("file_id"), F.col(content_col).alias("content")).mapInArrow(parse, schema)


def frame(rows: DataFrame, kind: str) -> DataFrame:
    """One kind of parsed rows."""
    return rows.where(F.col("kind") == kind).select("file_id", f"{kind}.*")


def frames_of(files: DataFrame, kinds: list[str], id_col: str = "path", content_col: str = "content", password: str = "") -> dict[str, DataFrame]:
    """Frames of (id, content) rows: one kind comes straight from the parser, several come from a table that it wrote."""
    rows = parsed(files, kinds, id_col, content_col, password)
    if len(set(kinds)) > 1:
        rows = write_table(rows, "parsed", "kind")
    return {k: frame(rows, k) for k in kinds}


def read_pdf(spark: SparkSession, path: str, kinds: list[str], password: str = "") -> dict[str, DataFrame]:
    """Frames of the files under a path."""
    return frames_of(spark.read.format("binaryFile").load(path), kinds, password=password)


def is_pdf(content: Column) -> Column:
    """Whether %PDF- begins within the first 1024 bytes."""
    return F.locate("%PDF-", F.decode(F.substring(content, 1, 1029), "ISO-8859-1")) > 0
