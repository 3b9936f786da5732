"""The vocabulary of document edits: one interpreter from an operation's JSON to a transform of a document's frames.

A document is a dictionary of frames (pages, outline, layers, ...). An operation names what it changes and its arguments; the
interpreter gives a new dictionary and leaves the old frames as they are. Everything stays lazy.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from . import pages as p
from .layout import redact
from .trees import walk, without_subtree

Document = dict[str, DataFrame]
OPERATIONS: dict[str, Callable[[Document, dict[str, Any]], Document]] = {}
BY = ["file_id"]
#: Places of a page decoration (fixed values).
POSITIONS = ("TopLeft", "TopCenter", "TopRight", "BottomLeft", "BottomCenter", "BottomRight")


def operation(f: Callable[[Document, dict[str, Any]], Document]):
    OPERATIONS["".join(w.capitalize() for w in f.__name__.split("_"))] = f
    return f


def apply_operation(document: Document, name: str | dict | None = None, arguments: dict[str, Any] | None = None, text: str | None = None) -> Document:
    """Applies one operation, given by name and arguments or as JSON {"op": ..., ...}."""
    if text is not None:
        given = json.loads(text)
        name, arguments = given.pop("op"), given
    if name not in OPERATIONS:
        raise ValueError(f"no such operation: {name}")
    return OPERATIONS[name](document, arguments or {})


def _chosen(selection: Any):
    """A page selection: "all", a number or a list of numbers, from 1."""
    page = F.col("page")
    return F.lit(True) if selection in (None, "all") else page == selection if isinstance(selection, int) else page.isin(*selection)


def _rows(like: DataFrame, file_ids: DataFrame, rows: list[dict[str, Any]]) -> DataFrame:
    """The rows for each file, in the columns of a frame; columns that a row lacks are null."""
    spark = like.sparkSession
    kinds = {f.name: f.dataType for f in like.schema}
    names = [c for c in like.columns if c != "file_id"]
    literal = [F.struct(*(F.lit(r.get(n)).cast(kinds[n]).alias(n) for n in names)) for r in rows]
    if not literal:
        return spark.createDataFrame([], like.schema)
    return file_ids.select("file_id").distinct().select("file_id", F.explode(F.array(*literal)).alias("r")).select(*(F.col(f"r.{c}").alias(c) if c != "file_id" else F.col(c) for c in like.columns))


def _replace(document: Document, frame: str, rows: list[dict[str, Any]]) -> Document:
    return document | {frame: _rows(document[frame], document["pages"], rows)}


def _append(document: Document, frame: str, rows: list[dict[str, Any]]) -> Document:
    return document | {frame: document[frame].unionByName(_rows(document[frame], document["pages"], rows))}


@operation
def rotate(d, a):
    return d | {"pages": p.rotate(d["pages"], _chosen(a.get("pages")), a["degrees"], a.get("relative", True))}


@operation
def reorder(d, a):
    return d | {"pages": p.move(d["pages"], BY, a["from"], a["to"])}


@operation
def remove_pages(d, a):
    """Also takes the page from structure elements that stood on it."""
    gone = d["pages"].where(_chosen(a["pages"])).select("file_id", "page", F.col("obj_num").alias("_gone"))
    out = d | {"pages": p.remove(d["pages"], gone, BY)}
    if "struct_nodes" in d:
        joined = d["struct_nodes"].join(gone.select("file_id", F.col("page"), F.lit(True).alias("_lost")), ["file_id", "page"], "left")
        out["struct_nodes"] = joined.withColumn("page", F.when(F.col("_lost").isNull(), F.col("page"))).select(*d["struct_nodes"].columns)
    return out


@operation
def set_page_labels(d, a):
    return _replace(d, "page_labels", a["labels"])


@operation
def update_struct_elem(d, a):
    node = F.col("id") == a["id"]
    frame = d["struct_nodes"]
    for k in ("tag", "alt"):
        if a.get(k) is not None:
            frame = frame.withColumn(k, F.when(node, F.lit(a[k])).otherwise(F.col(k)))
    return d | {"struct_nodes": frame}


@operation
def delete_struct_elem(d, a):
    return d | {"struct_nodes": without_subtree(d["struct_nodes"], d["struct_nodes"].where(F.col("id") == a["id"]))}


@operation
def update_article_threads(d, a):
    return _replace(d, "threads", [{"thread": k, "bead": n, "page": page} for k, t in enumerate(a["threads"]) for n, page in enumerate(t["pages"])])


@operation
def add_user_properties(d, a):
    return _append(d, "user_properties", [{"id": a["id"], "name": x["name"], "value": str(x["value"])} for x in a["properties"]])


@operation
def create_portfolio(d, a):
    return _append(d, "attachments", [{"name": x["name"], "description": x.get("description"), "kind": "portfolio"} for x in a["files"]])


@operation
def update_outlines(d, a):
    """Replaces the outline; no items removes it."""
    rows: list[dict[str, Any]] = []

    def add(items: list[dict], parent: int | None) -> None:
        for k, item in enumerate(items):
            rows.append({"node": len(rows) + 1, "parent": parent, "pos": k, "title": item["title"], "count": len(item.get("children", []))})
            add(item.get("children", []), rows[-1]["node"])

    add(a["items"], None)
    return _replace(d, "outline", rows)


@operation
def update_layers(d, a):
    """Replaces the layers, with their ids and whether they print."""
    return _replace(d, "layers", [{"id": x.get("id"), "name": x["name"], "visible": x.get("visible", True), "printable": x.get("printable", True)} for x in a["layers"]])


@operation
def attach_associated_file(d, a):
    return _append(d, "attachments", [{"name": a["name"], "description": a.get("description"), "kind": a.get("relationship", "Unspecified")}])


@operation
def set_output_intent(d, a):
    return _replace(d, "output_intents", [a])


@operation
def set_pronunciation_lexicon(d, a):
    return _replace(d, "lexicons", [{"data": a["data"]}])


@operation
def add_page_decoration(d, a):
    if a["position"] not in POSITIONS:
        raise ValueError(f"no such position: {a['position']}")
    own = d["pages"].where(_chosen(a.get("pages"))).select("file_id", "page", F.lit(a["text"]).alias("text"), F.lit(a["position"]).alias("position"))
    return d | {"decorations": d["decorations"].unionByName(own)}


@operation
def apply_bates_numbering(d, a):
    labelled = p.bates(d["pages"].where(_chosen(a.get("pages"))), BY, "page", a["prefix"], a["start"], a["digits"])
    return d | {"decorations": d["decorations"].unionByName(labelled.select("file_id", "page", F.col("label").alias("text"), F.lit(a.get("position", "BottomRight")).alias("position")))}


@operation
def add_annotation(d, a):
    return _append(d, "annotations", [{"page": a["page"], "subtype": a["subtype"], "contents": a.get("contents")}])


@operation
def set_measurement_scale(d, a):
    scale = F.when(_chosen(a["page"]), F.lit(a["scale"])).otherwise(F.col("measure"))
    return d | {"pages": d["pages"].withColumn("measure", scale)}


@operation
def set_form_field_value(d, a):
    """By qualified name."""
    named = walk(d["fields"].withColumnRenamed("node", "id"), 64, {"name": ("n.t", "concat_ws('.', w.name, n.t)")}).select("file_id", F.col("id").alias("node"), F.col("name").alias("_name"))
    joined = d["fields"].join(named, ["file_id", "node"], "left")
    return d | {"fields": joined.withColumn("v", F.when(F.col("_name") == a["name"], F.lit(a["value"])).otherwise(F.col("v"))).select(*d["fields"].columns)}


@operation
def execute_action(d, a):
    """Sets what opening the document does; nothing runs here."""
    return _replace(d, "open_action", [{"action": a["action"], "target": a.get("target")}])


@operation
def set_geospatial_anchor(d, a):
    anchor = F.when(_chosen(a["page"]), F.array(F.lit(float(a["latitude"])), F.lit(float(a["longitude"])))).otherwise(F.col("geo"))
    return d | {"pages": d["pages"].withColumn("geo", anchor)}


@operation
def add_mesh_shading(d, a):
    if a["shading_type"] not in (4, 5, 6, 7):
        raise ValueError("mesh shadings are of types 4 to 7")
    return _append(d, "shadings", [{"page": a["page"], "shading_type": a["shading_type"]}])


@operation
def set_unencrypted_wrapper(d, a):
    return _append(d, "attachments", [{"name": a["name"], "description": a.get("description"), "kind": "EncryptedPayload"}])


@operation
def add_public_key_recipient(d, a):
    return _append(d, "recipients", [{"subject": a["subject"], "certificate": a.get("certificate")}])


def redact_areas(spans: DataFrame, hits: DataFrame) -> DataFrame:
    """Spans under areas give way to the mark."""
    return redact(spans, hits, ["file_id", "page", "op_index"])


