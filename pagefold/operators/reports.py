"""Reports over parsed frames: structure, catalogue, coverage, summary, checks. A file is a row or a few; a corpus is a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DECODED_FILTERS
from .census import SEVERITIES
from .layout import audit_tags
from .trees import walk

#: Catalogue keys whose contents have a reader, those that are only named, and so the standard's 32 (fixed values).
MODELLED = ("Pages", "StructTreeRoot", "MarkInfo", "Metadata", "Version", "AcroForm", "Names", "Outlines", "OpenAction", "AA", "PageMode", "PageLayout", "Dests", "ViewerPreferences", "Lang", "PageLabels", "Threads", "OutputIntents", "OCProperties", "NeedsRendering")
DECLARED = ("Type", "Collection", "AF", "Extensions", "URI", "SpiderInfo", "PieceInfo", "Perms", "Legal", "Requirements", "DSS", "DPartRoot")
#: Annotation keys that are read: of all, of markup, and of single subtypes (fixed values).
ANNOTATION_KEYS = ("Type", "Subtype", "Rect", "Contents", "P", "NM", "M", "F", "AP", "AS", "Border", "C", "StructParent", "OC", "AF", "ca", "CA", "BM", "Lang")
MARKUP_KEYS = ("T", "Popup", "RC", "CreationDate", "IRT", "Subj", "RT", "IT", "ExData")
MARKUP = ("Text", "FreeText", "Line", "Square", "Circle", "Polygon", "PolyLine", "Highlight", "Underline", "Squiggly", "StrikeOut", "Stamp", "Caret", "Ink", "FileAttachment", "Sound", "Movie", "Redact", "Projection")
SUBTYPE_KEYS = {
    "Link": ("A", "Dest", "H", "PA", "QuadPoints", "BS"), "Popup": ("Parent", "Open"), "Square": ("BS", "IC", "BE", "RD"), "Circle": ("BS", "IC", "BE", "RD"), "Movie": ("Movie", "A"), "Stamp": ("Name",),
    "Widget": ("H", "MK", "A", "AA", "BS", "Parent", "FT", "T", "Ff", "V", "DA", "Kids"),
}
#: Axes of coverage and their clauses, in order (fixed values).
AXES = (("catalogue entries", "7.7.2"), ("annotation entries", "12.5"), ("stream filters", "7.4"))


def catalog_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, "Modelled") for k in MODELLED] + [(k, "Declared") for k in DECLARED], "key string, support string")


def annotation_readers(subtype, key):
    """Whether a key of a subtype is read."""
    own = F.lit(False)
    for name, keys in SUBTYPE_KEYS.items():
        own = own | ((subtype == name) & key.isin(*keys))
    return key.isin(*ANNOTATION_KEYS) | (subtype.isin(*MARKUP) & key.isin(*MARKUP_KEYS)) | own


def catalog_report(entries: DataFrame) -> DataFrame:
    """Entries of each catalogue with their support; keys that the standard doesn't have are untyped."""
    known = F.broadcast(catalog_keys(entries.sparkSession))  # 32 rows
    return entries.join(known, "key", "left").withColumn("standard", F.col("support").isNotNull()).withColumn("support", F.coalesce("support", F.lit("Untyped")))


def coverage_constructs(catalog: DataFrame, annotations: DataFrame, filters: DataFrame) -> DataFrame:
    """(file_id, axis, construct, read) of the three axes, as coverage merges them."""
    a = catalog_report(catalog).select("file_id", F.lit(AXES[0][0]).alias("axis"), F.col("key").alias("construct"), (F.col("support") == "Modelled").alias("read"))
    keys = annotations.select("file_id", "subtype", F.explode("keys").alias("key"))
    b = keys.select("file_id", F.lit(AXES[1][0]).alias("axis"), F.concat(F.lit("/"), "subtype", F.lit("  "), "key").alias("construct"), annotation_readers(F.col("subtype"), F.col("key")).alias("read"))
    c = filters.select("file_id", F.lit(AXES[2][0]).alias("axis"), F.col("name").alias("construct"), F.col("name").isin(*DECODED_FILTERS).alias("read"))
    return a.unionByName(b).unionByName(c).distinct()


def file_structure(files: DataFrame, xref: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row a file: version, sections, records by kind, superseded numbers, decisions by severity."""
    kinds = xref.where("obj_num <> 0").groupBy("file_id").agg(F.max("obj_num").alias("highest"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("in_file", "free", "in_stream")), F.count_if("superseded").alias("superseded"))
    counts = decisions.groupBy("file_id").agg(*(F.count_if(F.col("severity") == k).alias(n) for k, n in enumerate(SEVERITIES)))
    joined = files.join(kinds, "file_id", "left").join(counts, "file_id", "left")
    numbers = [c for c in joined.columns if c not in ("file_id", "version")]
    return joined.select("file_id", "version", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers))


def summary(files: DataFrame, pages: DataFrame, metadata: DataFrame, fonts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Version, pages, settled title and author, fonts and decisions of each file."""
    per = lambda frame, name: frame.groupBy("file_id").agg(F.count(F.lit(1)).alias(name))
    best = metadata.groupBy("file_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.when(F.col("origin") == "xmp", 2).otherwise(1))).alias(c) for c in ("title", "author")))
    out = files.select("file_id", "version").join(per(pages, "pages"), "file_id", "left").join(best, "file_id", "left").join(per(fonts.dropDuplicates(["file_id", "obj_num"]), "fonts"), "file_id", "left").join(per(decisions, "decisions"), "file_id", "left")
    return out.select("file_id", "version", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pages", "fonts", "decisions")), "title", "author")


def unreadable_files(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """Files that can't be opened as documents, and why."""
    return decisions.where("clause in ('7.7.2', '7.7.3.2') and severity = 2").groupBy("file_id").agg(F.min_by("found", "seq").alias("error"))


def declared_pages(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Files whose page tree declares another number of pages than it holds."""
    roots = objects.where("type = 'Pages'").select("file_id", F.get_json_object("value", "$.Count").cast("long").alias("declared"), F.get_json_object("value", "$.Parent").alias("parent")).where("parent is null")
    held = pages.groupBy("file_id").agg(F.count(F.lit(1)).alias("held"))
    return roots.join(held, "file_id", "left").select("file_id", "declared", F.coalesce("held", F.lit(0)).alias("held"))


def stream_lengths(objects: DataFrame) -> DataFrame:
    """Streams whose declared length isn't the one that was read; a length held by another object is followed."""
    numbers = objects.where("kind = 'integer'").select("file_id", F.concat(F.col("obj_num").cast("string"), F.lit(" "), F.col("gen").cast("string"), F.lit(" R")).alias("ref"), F.col("value").cast("long").alias("held"))
    streams = objects.where("kind = 'stream'").select("file_id", "obj_num", "length", F.get_json_object("value", "$.Length").alias("ref"))
    joined = streams.join(numbers, ["file_id", "ref"], "left").withColumn("declared", F.coalesce("held", F.col("ref").try_cast("long")))
    return joined.where(~F.col("declared").eqNullSafe(F.col("length").cast("long"))).select("file_id", "obj_num", "declared", "length")


def describe(objects: DataFrame, number: int) -> DataFrame:
    return objects.where(F.col("obj_num") == number).select("file_id", "obj_num", "kind", "value")


def compliance(catalog: DataFrame) -> DataFrame:
    """Whether each file has a structure tree and says that it is marked."""
    return catalog.groupBy("file_id").agg(F.bool_or(F.col("key") == "StructTreeRoot").alias("has_structure"), F.bool_or(F.col("key") == "MarkInfo").alias("has_mark_info"), F.bool_or(F.col("key") == "Lang").alias("has_language"))


def tag_findings(catalog: DataFrame, struct_nodes: DataFrame) -> DataFrame:
    """(file_id, id, checkpoint) of files: 00-001 for one without a structure tree, and what the audit of tags finds in the others."""
    bare = compliance(catalog).where("not has_structure").select("file_id", F.lit(None).cast("int").alias("id"), F.lit("00-001").alias("checkpoint"))
    nodes = struct_nodes.select("file_id", "id", F.col("id").alias("dfs_pos"), "tag", "alt", F.col("page_lost").alias("page_missing"))
    return bare.unionByName(audit_tags(nodes).select("file_id", "id", "checkpoint"))


def references(objects: DataFrame) -> DataFrame:
    """Edges (file_id, src, dst) from objects to those they name."""
    found = F.regexp_extract_all("value", F.lit('"([0-9]+) [0-9]+ R"'), F.lit(1))
    return objects.select("file_id", F.col("obj_num").cast("long").alias("src"), F.explode(found).alias("dst")).select("file_id", "src", F.col("dst").cast("long").alias("dst")).distinct()


def outline_report(items: DataFrame) -> DataFrame:
    """Items of each outline and how many show; a negative count closes an item."""
    nodes = items.select("file_id", F.col("node").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"), "pos", (F.col("count") >= 0).alias("open"))
    walked = walk(nodes, 64, {"open": ("n.open", "n.open"), "shown": ("true", "w.shown AND w.open")})
    return walked.groupBy("file_id").agg(F.count(F.lit(1)).alias("items"), F.count_if("shown").alias("shown"))


def form_report(fields: DataFrame) -> DataFrame:
    """Terminal fields by inherited type."""
    nodes = fields.select("file_id", F.col("node").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"), "pos", "ft")
    walked = walk(nodes, 64, {"ft": ("n.ft", "coalesce(n.ft, w.ft)")})
    ends = walked.join(fields.select("file_id", F.col("parent").cast("long").alias("id")).where("id is not null").distinct(), ["file_id", "id"], "left_anti")
    return ends.groupBy("file_id", "ft").agg(F.count(F.lit(1)).alias("n"))
