"""Queries over files: documents are written as files by the engine's writer and read back by its parser, so plain SQL over the
table they came from says what the frames must hold."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import census, layout, lookup, reports
from ..sources.document import struct_elements
from ..sources.frames import frames_of
from ..sources.reader import read
from ..sources.saving import edited, save_edits
from ..sources.security import protect
from ..sources.tables import write_table
from ..sources.writer import from_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Filter of a document's content streams by its id modulo 5 (none for 0), as SQL says it, too.
FILTERS = (None, "FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode")
FILTER_SQL = "CASE doc_id % 5 WHEN 1 THEN 'FlateDecode' WHEN 2 THEN 'ASCIIHexDecode' WHEN 3 THEN 'ASCII85Decode' WHEN 4 THEN 'RunLengthDecode' END"
LINES = 50
PAGES_SQL = f"CAST(ceil(len(string_split(text, chr(10))) / {LINES}) AS BIGINT)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def written(spark: SparkSession, d: str) -> DataFrame:
    """(path, content) of every document as a file: filters, packing, links and outline follow from the id."""

    @F.pandas_udf("binary")
    def content(ids: pd.Series, texts: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([from_text(t or "", s or "", LINES, FILTERS[i % 5], 4 if i % 2 else 0, [f"item {k}" for k in range(i % 4)], int(i % 3)) for i, t, s in zip(ids, texts, sources, strict=True)], dtype=object)

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    return docs.select(F.col("doc_id").alias("path"), content("doc_id", "text", "source").alias("content"))


def written_as(spark: SparkSession, d: str, options: Callable[[int], dict], text: Column | None = None) -> DataFrame:
    """(path, content) of every document as a file with the writer's options for its id."""

    @F.pandas_udf("binary")
    def content(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([from_text(t or "", packed=4 if i % 2 else 0, **options(i)) for i, t in zip(ids, texts, strict=True)], dtype=object)

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text") if text is None else text.alias("text"))
    return docs.select(F.col("doc_id").alias("path"), content("doc_id", "text").alias("content"))


def whole_texts(spans: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of each file in order."""
    joined = layout.page_text(spans).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return joined.select(F.col("file_id").alias("doc_id"), F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("text"))


#: Ways to encrypt by the id; the last one's key takes many rounds, so one file in a hundred has it.
WAY = lambda i: "AES-256" if i % 100 == 7 else ("RC4-40", "RC4-128", "AES-128", "AES-256-R5")[i % 4]
WAY_SQL = "CASE WHEN doc_id % 100 = 7 THEN 6 WHEN doc_id % 4 = 3 THEN 5 ELSE doc_id % 4 + 2 END"


def frames(spark: SparkSession, d: str, *kinds: str) -> list[DataFrame]:
    found = frames_of(written(spark, d), list(kinds))
    return [found[k] for k in kinds]


@query("SELECT doc_id, text FROM documents")
def roundtrip_text(spark, d):
    (spans,) = frames(spark, d, "spans")
    return whole_texts(spans)


@query("SELECT doc_id, text FROM documents")
def encrypted_text(spark, d):
    """Files that are encrypted in five ways, opened with the user's empty password."""
    return whole_texts(frames_of(written_as(spark, d, lambda i: {"cipher": protect(WAY(i))}), ["spans"])["spans"])


@query("SELECT doc_id, text FROM documents")
def encrypted_text_of_owner(spark, d):
    """Files that only the owner's password opens here."""
    files = written_as(spark, d, lambda i: {"cipher": protect(("RC4-40", "RC4-128", "AES-128", "AES-256-R5")[i % 4], user=b"other", owner=b"own")})
    return whole_texts(frames_of(files, ["spans"], password="own")["spans"])


@query(f"SELECT doc_id AS file_id, 'Standard' AS handler, {WAY_SQL} AS r, 'user' AS access, NULL::VARCHAR AS clause FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'Standard', {WAY_SQL}, NULL, '7.6.4' FROM documents WHERE doc_id % 3 = 0")
def encrypted_files(spark, d):
    """Encryption dictionaries, and what a missing password gives: every third file has one."""
    files = written_as(spark, d, lambda i: {"cipher": protect(WAY(i), user=b"" if i % 3 else b"secret")})
    found = frames_of(files, ["encryption", "decisions"])
    first = found["decisions"].groupBy("file_id").agg(F.min_by("clause", "seq").alias("clause"))
    return found["encryption"].join(first, "file_id", "left").select("file_id", "handler", "r", "access", "clause")


@query("SELECT doc_id, text FROM documents")
def form_text(spark, d):
    """Pages that place a form with their text, in a font that a graphics state sets."""
    return whole_texts(frames_of(written_as(spark, d, lambda i: {"in_form": True, "filter_name": FILTERS[i % 5]}), ["spans"])["spans"])


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c IN (' ', chr(10)) THEN c ELSE chr(unicode(c) + 19968) END), '') AS text FROM documents")
def wide_text(spark, d):
    """Texts moved into the ideographs, in two-byte codes with a character map."""
    moved = F.transform(F.split("text", ""), lambda c: F.when(c.isin(" ", "\n", ""), c).otherwise(F.decode(F.unhex(F.lpad(F.hex((F.ascii(c) + 19968).cast("long")), 8, "0")), "UTF-32")))
    return whole_texts(frames_of(written_as(spark, d, lambda i: {}, F.array_join(moved, "")), ["spans"])["spans"])


@query(f"""SELECT doc_id AS file_id, 1 AS id, NULL::INT AS parent, 0 AS pos, 'Document' AS tag, NULL AS alt, NULL::INT AS page FROM documents
UNION ALL SELECT doc_id, k + 2, 1, k, 'P', 'page ' || (k + 1), k + 1 FROM (SELECT doc_id, unnest(generate_series(0, {PAGES_SQL} - 1)) AS k FROM documents)""")
def struct_tree(spark, d):
    rows = frames_of(written_as(spark, d, lambda i: {"tagged": True}), ["struct_nodes"])["struct_nodes"]
    return rows.select("file_id", "id", "parent", "pos", "tag", "alt", "page")


@query(f"""SELECT doc_id AS file_id, NULL::INT AS id, '00-001' AS checkpoint FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, k + 2, '14-001' FROM (SELECT doc_id, unnest(generate_series(0, {PAGES_SQL} - 1)) AS k FROM documents WHERE doc_id % 3 = 1) WHERE k = 0
UNION ALL SELECT doc_id, k + 2, '13-001' FROM (SELECT doc_id, unnest(generate_series(0, {PAGES_SQL} - 1)) AS k FROM documents WHERE doc_id % 3 = 2)""")
def file_tag_audit(spark, d):
    """Untagged files, files whose headings begin at the second level, and files whose figures have no description."""

    @F.pandas_udf("binary")
    def retagged(ids: pd.Series, contents: pd.Series) -> pd.Series:
        steps = ([], [("H2", "x")], [("Figure", "")])
        kinds = [(bytes(c), steps[i % 3]) for i, c in zip(ids, contents, strict=True)]
        return pd.Series([edited(c, [{"op": "UpdateStructElem", "id": n, "tag": t, "alt": a} for t, a in s for n, _, _, e in struct_elements(read(c)) if n > 1]) for c, s in kinds], dtype=object)

    files = written_as(spark, d, lambda i: {"tagged": i % 3 > 0})
    found = frames_of(files.select("path", retagged("path", "content").alias("content")), ["catalog", "struct_nodes"])
    nodes = found["struct_nodes"].withColumn("alt", F.when(F.col("alt") != "", F.col("alt")))
    return reports.tag_findings(found["catalog"], nodes)


@query(f"""WITH p AS (SELECT doc_id AS file_id, unnest(generate_series(1, {PAGES_SQL})) AS page FROM documents)
SELECT file_id, page, CASE WHEN page < 3 THEN 'r' ELSE 'D' END AS style, CASE WHEN page < 3 THEN '' ELSE 'A-' END AS prefix, CASE WHEN page < 3 THEN page ELSE page - 3 + file_id % 7 + 1 END AS number FROM p""")
def file_page_labels(spark, d):
    """The label range of every page, from the files' own number trees."""
    files = written_as(spark, d, lambda i: {"labels": [(1, "r", "", 1), (3, "D", "A-", int(i % 7) + 1)]})
    found = frames_of(files, ["pages", "page_labels"])
    labelled = lookup.last_range(found["pages"].select("file_id", "page"), found["page_labels"].withColumn("first", F.col("from_page")), "page", "from_page", ["style", "prefix", "start_at", "first"], ["file_id"])
    return labelled.select("file_id", "page", "style", "prefix", (F.col("page") - F.col("first") + F.col("start_at")).alias("number"))


@query(f"WITH f AS (SELECT {FILTER_SQL} AS name, {PAGES_SQL} AS n, doc_id % 2 = 1 AS packed FROM documents), u AS (SELECT name, n AS streams FROM f WHERE name IS NOT NULL) SELECT name, CAST(sum(streams) AS BIGINT) AS streams, 0::BIGINT AS on_images, true AS decoded FROM (SELECT * FROM u UNION ALL SELECT 'FlateDecode', CAST(1 + ceil((4 + {PAGES_SQL} + (doc_id % 4) + CASE WHEN doc_id % 4 > 0 THEN 1 ELSE 0 END) / 4) AS BIGINT) FROM documents WHERE doc_id % 2 = 1) GROUP BY name")
def pdf_filter_census(spark, d):
    (filters,) = frames(spark, d, "filters")
    return census.filter_census(filters)


@query(f"SELECT doc_id AS file_id, {PAGES_SQL} AS pages, 612.0::DOUBLE AS width, 0 AS rotate FROM documents")
def pdf_pages(spark, d):
    (pages,) = frames(spark, d, "pages")
    return pages.groupBy("file_id").agg(F.count(F.lit(1)).alias("pages"), F.max(F.col("media_box")[2] - F.col("media_box")[0]).alias("width"), F.max("rotate").alias("rotate"))


@query("SELECT doc_id AS file_id, source AS title FROM documents")
def pdf_metadata(spark, d):
    (rows,) = frames(spark, d, "metadata")
    return rows.where("origin = 'info'").select("file_id", "title")


@query("WITH i AS (SELECT doc_id AS file_id, unnest(generate_series(0, doc_id % 4 - 1)) AS k FROM documents) SELECT file_id, 'item ' || k AS title, CAST(k AS INT) AS pos FROM i")
def pdf_outline(spark, d):
    (rows,) = frames(spark, d, "outline")
    return rows.select("file_id", "title", "pos")


@query("WITH i AS (SELECT doc_id AS file_id, unnest(generate_series(0, doc_id % 3 - 1)) AS k FROM documents) SELECT file_id, 'd' || k AS key, CASE WHEN k % 2 = 0 THEN 'named' ELSE 'dangling' END AS status FROM i")
def pdf_link_lookup(spark, d):
    annotations, destinations = frames(spark, d, "annotations", "destinations")
    links = annotations.select("file_id", F.col("dest_kind").alias("key_kind"), F.col("dest_key").alias("key"))
    return lookup.resolve_links(links, destinations.drop("view"), ["file_id", "key_kind", "key"], "page").select("file_id", "key", "status")


@query("SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 1 THEN 'stream' ELSE 'table' END AS form, true AS has_trailer FROM documents")
def pdf_revisions(spark, d):
    (rows,) = frames(spark, d, "revisions")
    return rows.select("file_id", "form", "has_trailer")


@query(f"SELECT op, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'BT' AS op, {PAGES_SQL} AS n FROM documents UNION ALL SELECT 'ET', {PAGES_SQL} FROM documents UNION ALL SELECT 'Tf', {PAGES_SQL} FROM documents UNION ALL SELECT 'Tm', len(string_split(text, chr(10))) FROM documents UNION ALL SELECT 'Tj', len(string_split(text, chr(10))) FROM documents) GROUP BY op")
def pdf_operator_census(spark, d):
    (rows,) = frames(spark, d, "commands")
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS file_id, 'Catalog' AS type FROM documents")
def pdf_catalogs(spark, d):
    (rows,) = frames(spark, d, "objects")
    return rows.where("type = 'Catalog'").select("file_id", "type")


@query("""SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '7.5.2' WHEN 2 THEN '7.5.4' ELSE '7.5.8' END AS clause, text FROM documents""")
def pdf_recovery(spark, d):
    """Three of four files are damaged: junk before the header, a lost startxref, a wrong one; the text is still all there, and the damage is a decision."""
    junk = F.encode(F.repeat(F.lit("junk"), 75), "UTF-8")
    lost = F.substring(F.col("content"), F.lit(1), F.octet_length("content") - 30)
    wrong = F.encode(F.regexp_replace(F.decode("content", "ISO-8859-1"), "startxref\n", "startxref\n99"), "ISO-8859-1")
    kind = F.col("path") % 4
    damaged = F.when(kind == 1, F.concat(junk, F.col("content"))).when(kind == 2, lost).when(kind == 3, wrong).otherwise(F.col("content"))
    files = written(spark, d).select("path", damaged.alias("content"))
    found = frames_of(files, ["spans", "decisions"])
    pages = layout.page_text(found["spans"]).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    first = found["decisions"].groupBy("file_id").agg(F.min_by("clause", "seq").alias("clause"))
    return pages.join(first, "file_id", "left").select("file_id", F.coalesce("clause", F.lit("")).alias("clause"), F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("text"))


@query(f"""WITH f AS (SELECT DISTINCT {FILTER_SQL} AS name, doc_id % 2 AS packed FROM documents),
c AS (SELECT 'catalogue entries' AS axis, unnest(['Type', 'Pages', 'Names', 'Outlines']) AS construct UNION ALL
SELECT 'annotation entries', '/Link  ' || unnest(['Type', 'Subtype', 'Rect', 'Dest']) UNION ALL SELECT DISTINCT 'stream filters', name FROM f WHERE name IS NOT NULL UNION SELECT 'stream filters', 'FlateDecode'),
u AS (SELECT DISTINCT axis, construct, construct <> 'Type' AS read FROM c)
SELECT axis, count(*) AS presented, count(*) FILTER (read) AS read, CAST(floor(count(*) FILTER (read) * 100 / count(*)) AS INT) AS percent FROM u GROUP BY ROLLUP (axis)""")
def pdf_coverage(spark, d):
    from ..operators.coverage import coverage_axes

    return coverage_axes(reports.coverage_constructs(*frames(spark, d, "catalog", "annotations", "filters"))).drop("fraction")


@query(f"SELECT doc_id AS file_id, '1.7' AS version, {PAGES_SQL} AS pages, 1::BIGINT AS fonts, 0::BIGINT AS decisions, source AS title, NULL AS author FROM documents")
def pdf_summary(spark, d):
    return reports.summary(*frames(spark, d, "files", "pages", "metadata", "fonts", "decisions"))


@query(f"SELECT doc_id AS file_id, {PAGES_SQL} AS declared, {PAGES_SQL} AS held FROM documents")
def pdf_declared_pages(spark, d):
    return reports.declared_pages(*frames(spark, d, "objects", "pages"))


@query(f"SELECT doc_id AS file_id, {PAGES_SQL} + CASE WHEN doc_id % 2 = 1 THEN CAST(1 + ceil((4 + {PAGES_SQL} + (doc_id % 4) + CASE WHEN doc_id % 4 > 0 THEN 1 ELSE 0 END) / 4) AS BIGINT) ELSE 0 END AS wrong FROM documents")
def pdf_stream_lengths(spark, d):
    """Every file says a wrong length for all its streams, containers and the cross-reference too; the data is found all the same."""
    spoilt = F.encode(F.regexp_replace(F.decode("content", "ISO-8859-1"), "/Length ", "/Length 1"), "ISO-8859-1")
    found = frames_of(written(spark, d).select("path", spoilt.alias("content")), ["objects"])
    return reports.stream_lengths(found["objects"]).groupBy("file_id").agg(F.count(F.lit(1)).alias("wrong"))


@query("SELECT doc_id AS file_id, doc_id % 4 AS items, doc_id % 4 AS shown FROM documents WHERE doc_id % 4 > 0")
def pdf_outline_report(spark, d):
    return reports.outline_report(*frames(spark, d, "outline"))


@query("SELECT doc_id AS file_id, false AS has_structure, false AS has_mark_info, false AS has_language FROM documents")
def pdf_compliance(spark, d):
    return reports.compliance(*frames(spark, d, "catalog"))


@query(f"SELECT doc_id AS file_id, '1.7' AS version, 1 AS n_sections, CASE WHEN doc_id % 2 = 1 THEN CAST(ceil((4 + {PAGES_SQL} + (doc_id % 4) + CASE WHEN doc_id % 4 > 0 THEN 1 ELSE 0 END) / 4) AS BIGINT) ELSE 0 END AS containers, 0::BIGINT AS superseded, 0::BIGINT AS violation FROM documents")
def pdf_file_structure(spark, d):
    files, xref, decisions = frames(spark, d, "files", "xref", "decisions")
    report = reports.file_structure(files, xref, decisions)
    containers = xref.where("kind = 'in_stream'").groupBy("file_id").agg(F.count_distinct("a").alias("containers"))
    return report.join(containers, "file_id", "left").select("file_id", "version", "n_sections", F.coalesce("containers", F.lit(0)).alias("containers"), "superseded", "violation")


@query(f"SELECT doc_id AS file_id, {PAGES_SQL} AS contents FROM documents")
def pdf_reachable_streams(spark, d):
    """Content streams that references lead to from the catalogue."""
    from ..operators.trees import reachable

    (objects,) = frames(spark, d, "objects")
    objects = write_table(objects.select("file_id", "obj_num", "kind", "type", "value"), "objects")
    roots = objects.where("type = 'Catalog'").select("file_id", F.col("obj_num").cast("long").alias("id"))
    found = reachable(reports.references(objects.where("type is null or type <> 'ObjStm'")), roots)
    streams = objects.where("kind = 'stream' and type is null").select("file_id", F.col("obj_num").cast("long").alias("id"))
    return found.join(streams, ["file_id", "id"]).groupBy("file_id").agg(F.count(F.lit(1)).alias("contents"))


PAGED = f"""g AS (SELECT doc_id, {PAGES_SQL} AS n, string_split(text, chr(10)) AS lines FROM documents), h AS (SELECT *, unnest(generate_series(1, n)) AS page FROM g),
t AS (SELECT doc_id AS file_id, n, page, array_to_string(list_slice(lines, (page - 1) * {LINES} + 1, page * {LINES}), chr(10)) AS text FROM h)"""


def saved_pages(files: DataFrame) -> DataFrame:
    """(file_id, page, rotate, text) of files."""
    found = frames_of(files, ["pages", "spans"])
    return found["pages"].select("file_id", "page", "rotate").join(layout.page_text(found["spans"]).select("file_id", "page", "text"), ["file_id", "page"], "left")


@query(f"WITH {PAGED} SELECT file_id, CASE WHEN page = n THEN 1 ELSE page + 1 END AS page, CAST(file_id % 4 * 90 AS INT) AS rotate, text FROM t")
def saved_order(spark, d):
    """Files that are turned and whose last page comes first, as saved and read again."""
    steps = F.to_json(F.array(F.struct(F.lit("Rotate").alias("op"), (F.col("path") % 4 * 90).alias("degrees"))))
    turned = save_edits(written(spark, d).withColumn("steps", steps), "steps").select("path", "content")
    pages = frames_of(turned, ["pages"])["pages"].groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("file_id", "path")
    last = F.to_json(F.array(F.struct(F.lit("Reorder").alias("op"), F.col("n").alias("from"), F.lit(1).alias("to"))))
    return saved_pages(save_edits(turned.join(pages, "path").withColumn("steps", last), "steps"))


@query(f"WITH {PAGED} SELECT file_id, page, 0 AS rotate, text || chr(10) || 'AB-' || lpad(CAST(file_id * 10 + page - 1 AS VARCHAR), 8, '0') AS text FROM t")
def saved_bates(spark, d):
    """Numbers on all pages, as saved and read again."""
    steps = F.to_json(F.array(F.struct(F.lit("ApplyBatesNumbering").alias("op"), F.lit("AB-").alias("prefix"), (F.col("path") * 10).alias("start"), F.lit(8).alias("digits"))))
    return saved_pages(save_edits(written(spark, d).withColumn("steps", steps), "steps"))


@query(f"WITH {PAGED} SELECT file_id, page, 0 AS rotate, array_to_string(list_slice(string_split(text, chr(10)), 2, {LINES}), chr(10)) AS text FROM t WHERE len(string_split(text, chr(10))) > 1 UNION ALL SELECT file_id, page, 0, NULL FROM t WHERE len(string_split(text, chr(10))) = 1")
def saved_redaction(spark, d):
    """The first line of every page is taken out of the file."""
    pages = frames_of(written(spark, d), ["pages"])["pages"].groupBy("file_id").agg(F.array_sort(F.collect_set("page")).alias("pages")).withColumnRenamed("file_id", "path")
    area = lambda p: F.struct(p.alias("page"), F.lit(0).alias("x1"), F.lit(719).alias("y1"), F.lit(100000).alias("x2"), F.lit(725).alias("y2"))
    steps = F.to_json(F.array(F.struct(F.lit("Redact").alias("op"), F.transform("pages", area).alias("areas"))))
    redacted = save_edits(written(spark, d).join(pages, "path").withColumn("steps", steps), "steps")
    found = frames_of(redacted, ["pages", "spans"])
    # what is left of a redacted line is a span without text
    texts = layout.page_text(found["spans"].where("text <> '' or y < 719")).select("file_id", "page", "text")
    return found["pages"].select("file_id", "page", "rotate").join(texts, ["file_id", "page"], "left")


@query("SELECT doc_id AS file_id, 'T ' || doc_id || ' é' AS title, source AS author, 'info' AS origin FROM documents UNION ALL SELECT doc_id, 'T ' || doc_id || ' é', source, 'xmp' FROM documents")
def saved_metadata(spark, d):
    """Fields that are set in both places."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("source").alias("author"))
    steps = F.to_json(F.array(F.struct(F.lit("UpdateMetadata").alias("op"), F.concat(F.lit("T "), F.col("path").cast("string"), F.lit(" é")).alias("title"), "author")))
    rows = frames_of(save_edits(written(spark, d).join(docs, "path").withColumn("steps", steps), "steps"), ["metadata"])["metadata"]
    return rows.select("file_id", "title", "author", "origin")
