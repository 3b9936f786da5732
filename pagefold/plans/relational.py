"""Queries of the engine's operators over relational tables, each with the SQL that must give the same rows.

Adapters rename columns of plain tables into the engine's frames, so the operators that run here are the ones that run on
parsed files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, geometry, numbers, text
from ..operators import census, coverage, layout, lookup, metadata, normalize, pages, trees

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{d}/{name}.parquet")
    return frame.select(*columns) if columns else frame


# coverage: a source is a file, a language an axis, a word a construct; words of the benchmark count as read

COVERAGE = """
WITH c AS (SELECT DISTINCT lang AS axis, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS construct FROM documents),
b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS construct FROM benchmark),
m AS (SELECT c.axis, c.construct, b.construct IS NOT NULL AS read FROM c LEFT JOIN b USING (construct))
"""


def coverage_frame(spark: SparkSession, d: str) -> DataFrame:
    words = lambda frame, *c: frame.select(*c, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("construct")).distinct()
    presented = words(table(spark, d, "documents", "source", "lang", "text"), F.col("source").alias("file"), F.col("lang").alias("axis"))
    read = words(table(spark, d, "benchmark", "text")).withColumn("_read", F.lit(True))
    return presented.join(read, "construct", "left").select("file", "axis", "construct", F.coalesce("_read", F.lit(False)).alias("read"))


@query(COVERAGE + "SELECT axis, count(*) AS presented, count(*) FILTER (read) AS read, count(*) FILTER (read) / count(*) AS fraction, CAST(floor(count(*) FILTER (read) * 100 / count(*)) AS INT) AS percent FROM m GROUP BY ROLLUP (axis)")
def coverage_axes(spark, d):
    return coverage.coverage_axes(coverage_frame(spark, d))


@query(COVERAGE + "SELECT axis, construct FROM m WHERE NOT read")
def coverage_unread(spark, d):
    return coverage.coverage_unread(coverage_frame(spark, d))


@query(COVERAGE + "SELECT a.axis, coalesce(x.presented, 0) AS presented, coalesce(x.read, 0) AS read, x.percent FROM (VALUES ('en'), ('fr'), ('xx')) a(axis) LEFT JOIN (SELECT axis, count(*) AS presented, count(*) FILTER (read) AS read, CAST(floor(count(*) FILTER (read) * 100 / count(*)) AS INT) AS percent FROM m GROUP BY axis) x USING (axis)")
def coverage_known_axes(spark, d):
    axes = spark.createDataFrame([("en",), ("fr",), ("xx",)], "axis string")
    return coverage.with_all_axes(coverage.coverage_axes(coverage_frame(spark, d)).where("axis is not null"), axes)


# censuses


@query("SELECT l_returnflag AS name, count(*) AS streams, count(*) FILTER (l_linestatus = 'O') AS on_images, l_returnflag IN ('A', 'N') AS decoded FROM lineitem GROUP BY l_returnflag")
def filter_census(spark, d):
    streams = table(spark, d, "lineitem", F.col("l_returnflag").alias("name"), (F.col("l_linestatus") == "O").alias("on_image"))
    return census.filter_census(streams, ("A", "N"))


RECORDS = "r AS (SELECT user_id % 50 AS file_id, user_id AS obj_num, event_type, CASE event_type WHEN 'view' THEN 'in_file' WHEN 'click' THEN 'in_stream' ELSE 'free' END AS kind, ts, event_id FROM events)"


def records(spark, d) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "in_file").when(F.col("event_type") == "click", "in_stream").otherwise("free")
    return table(spark, d, "events").select((F.col("user_id") % 50).alias("file_id"), F.col("user_id").alias("obj_num"), "event_type", kind.alias("kind"), "ts", "event_id")


@query(f"WITH {RECORDS} SELECT file_id, max(obj_num) AS highest, count(*) FILTER (kind = 'in_file') AS in_file, count(*) FILTER (kind = 'free') AS free, count(*) FILTER (kind = 'in_stream') AS in_stream FROM r WHERE obj_num <> 0 GROUP BY file_id")
def object_census(spark, d):
    return census.object_census(records(spark, d))


@query(f"WITH {RECORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY file_id, obj_num ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY file_id, obj_num) AS times FROM r) SELECT file_id, obj_num, ts, event_id, event_type, kind, times FROM o WHERE k = 1")
def newest_objects(spark, d):
    return census.newest_records(records(spark, d), ["file_id", "obj_num"], ["ts", "event_id"])


@query(f"WITH {RECORDS} SELECT file_id, obj_num, count(*) - 1 AS dead FROM r GROUP BY file_id, obj_num HAVING count(*) > 1")
def superseded_objects(spark, d):
    return census.superseded(records(spark, d), ["file_id", "obj_num"], ["ts", "event_id"])


@query("SELECT o_custkey AS container, count(*) AS members FROM orders GROUP BY o_custkey ORDER BY members DESC, container LIMIT 20")
def largest_containers(spark, d):
    return census.members_of(table(spark, d, "orders", F.col("o_custkey").alias("container")), "container", 20)


# every order line is a decision about its order, but for open ones: returned is a violation, accepted a repair
DECISIONS = "d AS (SELECT l_orderkey AS file_id, l_partkey AS seq, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS severity FROM lineitem WHERE l_returnflag IN ('R', 'A') OR l_linestatus = 'F')"


def decisions(spark, d) -> DataFrame:
    severity = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus").where(F.col("l_returnflag").isin("R", "A") | (F.col("l_linestatus") == "F"))
    return lines.select(F.col("l_orderkey").alias("file_id"), F.col("l_partkey").alias("seq"), severity.alias("severity"))


@query(f"WITH {DECISIONS} SELECT file_id, count(*) FILTER (severity = 0) AS ambiguity, count(*) FILTER (severity = 1) AS repaired, count(*) FILTER (severity = 2) AS violation FROM d GROUP BY file_id")
def decision_pivot(spark, d):
    return census.count_by_severity(decisions(spark, d))


@query(f"WITH {DECISIONS} SELECT * FROM d WHERE severity >= 1")
def decisions_at_least(spark, d):
    return census.at_least(decisions(spark, d), 1)


@query(f"WITH {DECISIONS} SELECT DISTINCT file_id FROM d WHERE severity = 2")
def strict_reject(spark, d):
    return census.rejected(decisions(spark, d))


@query(f"WITH {DECISIONS} SELECT o_orderkey AS file_id FROM orders WHERE o_orderkey NOT IN (SELECT file_id FROM d)")
def conforming_files(spark, d):
    return census.conforming(table(spark, d, "orders", F.col("o_orderkey").alias("file_id")), decisions(spark, d))


@query("""WITH k AS (SELECT event_type AS subtype, unnest(json_keys(props)) AS key FROM events), c AS (SELECT subtype, key, count(*) AS n FROM k GROUP BY subtype, key)
SELECT subtype, key, n, subtype IN ('view', 'click') AND key = 'k' AS read FROM c""")
def annotation_key_census(spark, d):
    annotations = table(spark, d, "events").select(F.col("event_type").alias("subtype"), F.json_object_keys("props").alias("keys"))
    return census.key_census(annotations, spark.createDataFrame([("view", "k"), ("click", "k")], "subtype string, key string"))


@query("SELECT event_type AS subtype, count(*) AS n, count(DISTINCT user_id) AS pages FROM events GROUP BY event_type")
def annotation_subtypes(spark, d):
    return census.subtype_census(table(spark, d, "events", F.col("event_type").alias("subtype"), F.col("user_id").alias("page")))


@query("SELECT p_type AS action, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, action LIMIT 10")
def action_topk(spark, d):
    return census.most_frequent(table(spark, d, "part", F.col("p_type").alias("action")), "action", 10)


@query("SELECT DISTINCT CAST(n_nationkey AS INT) AS key FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def absent_catalog_keys(spark, d):
    standard, present = table(spark, d, "nation", F.col("n_nationkey").alias("key")), table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("key"))
    return census.absent_keys(standard, present)


@query("SELECT count(*) FILTER (p_size <= 10) AS modelled, count(*) FILTER (p_size BETWEEN 11 AND 20) AS declared, count(*) FILTER (p_size BETWEEN 21 AND 30) AS typeonly, count(*) FILTER (p_size > 30) AS untyped FROM part")
def catalog_support(spark, d):
    size = F.col("p_size")
    support = F.when(size <= 10, "Modelled").when(size <= 20, "Declared").when(size <= 30, "TypeOnly").otherwise("Untyped")
    return census.support_counts(table(spark, d, "part").select(support.alias("support")))


@query("SELECT n.n_nationkey AS key, count(DISTINCT c.c_mktsegment) AS files FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey")
def catalog_survey(spark, d):
    return census.occurrence(table(spark, d, "customer", F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("file_id")), table(spark, d, "nation", F.col("n_nationkey").alias("key")))


@query("SELECT p_brand AS filter, p_size % 3 AS bpc, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size % 3)")
def image_survey(spark, d):
    return census.image_survey(table(spark, d, "part").select(F.col("p_brand").alias("filter"), (F.col("p_size") % 3).alias("bpc")), ["filter", "bpc"])


@query("SELECT doc_id, n_chars AS declared, strlen(text) AS scanned FROM documents WHERE n_chars <> strlen(text)")
def length_crosscheck(spark, d):
    docs = table(spark, d, "documents")
    return census.length_mismatches(docs.select("doc_id", F.col("n_chars").alias("declared")), docs.select("doc_id", F.octet_length("text").cast("long").alias("scanned")), "doc_id")


@query("""SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal > 0 THEN s_name END AS map, first_value(CASE WHEN s_acctbal > 0 THEN s_name END) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal <= 0, s_acctbal DESC, s_suppkey) AS shared FROM supplier""")
def shared_tounicode(spark, d):
    fonts = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("map"))
    return census.share_best(fonts, ["s_nationkey"], "map", "s_acctbal", "s_suppkey").select("s_suppkey", "s_nationkey", "map", "shared")


GRAPHS = "l AS (SELECT p_partkey AS id, p_name || p_size AS v FROM part WHERE p_partkey % 7 <> 0), r AS (SELECT p_partkey AS id, p_name || (CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END) AS v FROM part WHERE p_partkey % 11 <> 0)"


@query(f"""WITH {GRAPHS} SELECT id, l.v AS left_value, r.v AS right_value, coalesce(regexp_replace(l.v, '[0-9]', '', 'g') = regexp_replace(r.v, '[0-9]', '', 'g'), false) AS digits_only
FROM l FULL JOIN r USING (id) WHERE l.v IS DISTINCT FROM r.v""")
def compare_documents(spark, d):
    part = table(spark, d, "part")
    value = lambda size: F.concat("p_name", size.cast("string")).alias("v")
    left = part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), value(F.col("p_size")))
    right = part.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("id"), value(F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int")))
    return census.compare_graphs(left, right, "id", "v")


# lookups


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'inline' WHEN l.doc_id IS NULL THEN 'dangling' WHEN l.toxic = 1 THEN 'unreadable' ELSE 'named' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id % 10 <> 0 AND l.doc_id = d.doc_id""")
def named_dest_lookup(spark, d):
    links = table(spark, d, "documents", "doc_id").select("doc_id", F.lit("name").alias("key_kind"), F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("key"))
    destinations = table(spark, d, "labels").select(F.lit("name").alias("key_kind"), F.col("doc_id").alias("key"), F.when(F.col("toxic") == 0, F.col("quality")).alias("page"))
    return lookup.resolve_links(links, destinations, ["key_kind", "key"], "page").select("doc_id", "status")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dangling_refs(spark, d):
    return lookup.dangling(table(spark, d, "documents", "doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, 'read' AS origin FROM labels UNION ALL SELECT doc_id, 'scan' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def gap_fill(spark, d):
    return lookup.fill_gaps(table(spark, d, "labels").select("doc_id", F.lit("read").alias("origin")), table(spark, d, "documents").select("doc_id", F.lit("scan").alias("origin")), ["doc_id"])


@query("""WITH r AS (SELECT o_custkey % 20 AS file_id, CAST(o_orderkey % 500 AS BIGINT) AS from_page, max(o_orderkey) AS start_at FROM orders GROUP BY 1, 2),
p AS (SELECT user_id % 20 AS file_id, event_id % 700 AS page, event_id FROM events)
SELECT p.file_id, p.page, p.event_id, r.start_at FROM p ASOF LEFT JOIN r ON p.file_id = r.file_id AND p.page >= r.from_page""")
def page_label_asof(spark, d):
    ranges = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("file_id"), (F.col("o_orderkey") % 500).alias("from_page"), F.col("o_orderkey").alias("start_at"))
    points = table(spark, d, "events").select((F.col("user_id") % 20).alias("file_id"), (F.col("event_id") % 700).alias("page"), "event_id")
    return lookup.last_range(points, ranges, "page", "from_page", ["start_at"], ["file_id"])


@query("""WITH n AS (SELECT p_partkey, p_size FROM part)
SELECT p_partkey, 'p-' || p_size AS decimal_label, CASE WHEN p_size = 0 THEN '' ELSE repeat(substr('abcdefghijklmnopqrstuvwxyz', CAST((p_size - 1) % 26 + 1 AS INT), 1), CAST((p_size - 1) // 26 + 1 AS INT)) END AS letter_label,
(['', 'x', 'xx', 'xxx', 'xl', 'l'])[p_size // 10 + 1] || (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'])[p_size % 10 + 1] AS roman_label FROM n""")
def page_labels(spark, d):
    n = F.col("p_size")
    label = lambda style, prefix=None: numbers.page_label(F.lit(style), F.lit(prefix), n)
    return table(spark, d, "part").select("p_partkey", label("D", "p-").alias("decimal_label"), F.when(n == 0, "").otherwise(label("a")).alias("letter_label"), label("r").alias("roman_label"))


@query("SELECT o_custkey AS name, arg_min(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY o_custkey")
def resource_lookup(spark, d):
    return lookup.innermost(table(spark, d, "orders", F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("depth")), ["name"], "value", "depth")


BOXES = """b AS (SELECT l_suppkey AS page, l_orderkey * 8 + l_linenumber AS box_id, l_quantity * 10 AS x1, CAST(l_partkey % 700 AS DOUBLE) AS y1, l_quantity * 10 + 60.0 AS x2, CAST(l_partkey % 700 AS DOUBLE) + 12.0 AS y2 FROM lineitem),
a AS (SELECT s_suppkey AS page, s_suppkey AS area_id, CAST(s_nationkey * 20 AS DOUBLE) AS x1, CAST(s_suppkey % 600 AS DOUBLE) AS y1, s_nationkey * 20 + 80.0 AS x2, s_suppkey % 600 + 50.0 AS y2 FROM supplier)"""


def boxes(spark, d) -> tuple[DataFrame, DataFrame]:
    y, x = (F.col("l_partkey") % 700).cast("double"), F.col("l_quantity") * 10
    b = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box_id"), x.alias("x1"), y.alias("y1"), (x + 60.0).alias("x2"), (y + 12.0).alias("y2"))
    ax, ay = (F.col("s_nationkey") * 20).cast("double"), (F.col("s_suppkey") % 600).cast("double")
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_suppkey").alias("area_id"), ax.alias("x1"), ay.alias("y1"), (ax + 80.0).alias("x2"), (ay + 50.0).alias("y2"))
    return b, a


@query(f"WITH {BOXES} SELECT DISTINCT b.page, box_id, area_id FROM b JOIN a ON b.page = a.page AND b.x1 < a.x2 AND b.x2 > a.x1 AND b.y1 < a.y2 AND b.y2 > a.y1")
def redaction_overlap(spark, d):
    return lookup.overlapping(*boxes(spark, d), ["page"])


@query("""WITH p AS (SELECT s_nationkey AS page, s_suppkey AS point_id, s_acctbal / 10 AS x, CAST(s_suppkey % 100 AS DOUBLE) AS y FROM supplier), t AS (SELECT c_nationkey AS page, c_custkey AS target_id, c_acctbal / 10 AS x, CAST(c_custkey % 100 AS DOUBLE) AS y FROM customer),
j AS (SELECT p.page, point_id, target_id, sqrt(pow(p.x - t.x, 2) + pow(p.y - t.y, 2)) AS distance FROM p JOIN t ON p.page = t.page)
SELECT page, point_id, target_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY page, point_id ORDER BY distance, target_id) AS k FROM j WHERE distance < 25) WHERE k = 1""")
def nearest_snap(spark, d):
    points = table(spark, d, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").alias("point_id"), (F.col("s_acctbal") / 10).alias("x"), (F.col("s_suppkey") % 100).cast("double").alias("y"))
    targets = table(spark, d, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("target_id"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    return lookup.nearest(points, targets, 25.0, ["page"])


@query("""WITH m AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'fr' ELSE 'en' END AS lang, CAST(n_nationkey // 2 AS VARCHAR) AS key, n_name AS message FROM nation), k AS (SELECT CAST(r_regionkey * 4 AS VARCHAR) AS key FROM region)
SELECT k.key, coalesce(a.message, b.message, k.key) AS message FROM k LEFT JOIN m a ON a.key = k.key AND a.lang = 'fr' LEFT JOIN m b ON b.key = k.key AND b.lang = 'en'""")
def locale_lookup(spark, d):
    messages = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, "fr").otherwise("en").alias("lang"), F.floor(F.col("n_nationkey") / 2).cast("string").alias("key"), F.col("n_name").alias("message"))
    return lookup.translated(table(spark, d, "region").select((F.col("r_regionkey") * 4).cast("string").alias("key")), messages, "fr")


# layout: a document is a page, a line a span; sizes and columns come from the line


SPANS = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS op FROM documents),
s AS (SELECT 0 AS file_id, doc_id AS page, op AS op_index, text, 10.0 + length(text) % 5 * 1.7 AS font_size, length(text) % 7 = 0 AS is_bold, length(text) % 4 * 30.0 AS x, 800.0 - op * 12 - CASE WHEN length(text) % 3 = 0 THEN 15 ELSE 0 END AS y FROM l)"""


def spans(spark, d) -> DataFrame:
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("op", "text"))
    n = F.char_length("text")
    y = F.lit(800.0) - F.col("op") * 12 - F.when(n % 3 == 0, 15).otherwise(0)
    return lines.select(F.lit(0).alias("file_id"), F.col("doc_id").alias("page"), F.col("op").alias("op_index"), "text", (F.lit(10.0) + n % 5 * F.lit(1.7)).alias("font_size"), (n % 7 == 0).alias("is_bold"), (n % 4 * F.lit(30.0)).alias("x"), y.alias("y"))


@query(f"""WITH {SPANS}, m AS (SELECT page, op_index, CASE WHEN abs(y - lag(y) OVER (PARTITION BY page ORDER BY op_index)) > 5 THEN chr(10) ELSE '' END || text AS piece FROM s)
SELECT 0 AS file_id, page, string_agg(piece, '' ORDER BY op_index) AS text FROM m GROUP BY page""")
def page_text(spark, d):
    return layout.page_text(spans(spark, d))


@query(f"""WITH {SPANS}, z AS (SELECT *, CAST(trunc(font_size * 10) AS INT) AS size FROM s), c AS (SELECT page, size, count(*) AS n FROM z GROUP BY page, size),
b AS (SELECT page, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, size DESC) AS k FROM c) WHERE k = 1)
SELECT file_id, page, op_index, text, level FROM (SELECT z.*, CASE WHEN size > body + 15 THEN least(dense_rank() OVER (PARTITION BY z.page ORDER BY size DESC), 6) WHEN is_bold AND size >= body - 5 THEN 6 END AS level FROM z JOIN b ON z.page = b.page) WHERE level IS NOT NULL""")
def heading_levels(spark, d):
    return layout.headings(spans(spark, d))


@query(f"""WITH {SPANS}, g AS (SELECT page, CAST(trunc(y * 10) AS INT) AS line, list(CAST(trunc(x * 10) AS INT)) AS cols, count(*) AS n FROM (SELECT file_id, page, op_index, x, 12.0 * (op_index // 3) AS y FROM s) GROUP BY page, line),
p AS (SELECT *, lag(cols) OVER (PARTITION BY page ORDER BY line) AS before FROM g),
r AS (SELECT page, n, len(cols) > 1 AND before IS NOT NULL AND len(list_filter(cols, lambda c: len(list_filter(before, lambda b: abs(b - c) < 50)) > 0)) > 1 AS ok FROM p)
SELECT 0 AS file_id, page, count(*) FILTER (ok) AS rows FROM r GROUP BY page HAVING count(*) FILTER (ok) > 2 AND sum(n) >= 4""")
def table_rows(spark, d):
    return layout.table_rows(spans(spark, d).withColumn("y", F.lit(12.0) * F.floor(F.col("op_index") / 3)))


PARAGRAPHS = f"""WITH {SPANS}, j AS (SELECT page, op_index, CASE WHEN abs(y - lag(y) OVER (PARTITION BY page ORDER BY op_index)) > 20 THEN 1 ELSE 0 END AS jump FROM s),
n AS (SELECT page, sum(jump) OVER (PARTITION BY page ORDER BY op_index) + 1 AS paragraph FROM j), c AS (SELECT 0 AS file_id, page, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS spans FROM n GROUP BY page, paragraph) """


@query(PARAGRAPHS + "SELECT * FROM c")
def paragraph_clusters(spark, d):
    return layout.paragraphs(spans(spark, d))


@query(PARAGRAPHS + "SELECT file_id, page, paragraph, spans FROM (SELECT *, max(paragraph) OVER (PARTITION BY page) AS last FROM c) WHERE paragraph < last")
def paragraph_clusters_without_tail(spark, d):
    return layout.paragraphs(spans(spark, d), keep_tail=False)


@query("""WITH h AS (SELECT o_custkey AS file_id, o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS level FROM orders)
SELECT * FROM (SELECT *, lag(level, 1, 0) OVER (PARTITION BY file_id ORDER BY id) AS previous FROM h) WHERE level > previous + 1""")
def heading_skip_audit(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))
    return layout.skipped_headings(nodes, ["file_id"], ["id"])


@query("""WITH n AS (SELECT user_id AS file_id, event_id AS id, event_id AS dfs_pos, CASE event_type WHEN 'view' THEN 'H1' WHEN 'click' THEN 'H3' WHEN 'purchase' THEN 'Figure' ELSE 'P' END AS tag, CASE WHEN value > 50 THEN 'x' END AS alt, event_type = 'error' AS page_missing FROM events),
h AS (SELECT *, CAST(substr(tag, 2, 1) AS INT) AS level FROM n WHERE tag LIKE 'H_')
SELECT file_id, dfs_pos, id, '14-001' AS checkpoint FROM (SELECT *, lag(level, 1, 0) OVER (PARTITION BY file_id ORDER BY dfs_pos) AS p FROM h) WHERE level > p + 1
UNION ALL SELECT file_id, dfs_pos, id, '13-001' FROM n WHERE tag = 'Figure' AND alt IS NULL UNION ALL SELECT file_id, dfs_pos, id, '01-002' FROM n WHERE page_missing""")
def tag_audit(spark, d):
    tag = F.when(F.col("event_type") == "view", "H1").when(F.col("event_type") == "click", "H3").when(F.col("event_type") == "purchase", "Figure").otherwise("P")
    nodes = table(spark, d, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("id"), F.col("event_id").alias("dfs_pos"), tag.alias("tag"), F.when(F.col("value") > 50, "x").alias("alt"), (F.col("event_type") == "error").alias("page_missing"))
    return layout.audit_tags(nodes)


@query("WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+tion')) AS match FROM documents) SELECT doc_id, match, count(*) AS n FROM m GROUP BY doc_id, match")
def regex_search(spark, d):
    return layout.regex_matches(table(spark, d, "documents", "doc_id", "text"), ["doc_id"], "text", "[A-Z][a-z]+tion")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'reation')")
def simple_search(spark, d):
    return layout.simple_search(table(spark, d, "documents", "doc_id", "lang", "text"), "text", "Reation").select("doc_id", "lang")


@query("SELECT item_id, CASE WHEN length(text) % 2 = 0 THEN '[REDACTED]' ELSE text END AS text FROM benchmark")
def redact_text(spark, d):
    items = table(spark, d, "benchmark", "item_id", "text")
    return layout.redact(items, items.where(F.char_length("text") % 2 == 0), ["item_id"])


@query("SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN w IN ('the', 'of', 'la', 'de', 'and') OR w = '' THEN w ELSE '[REDACTED]' END), ' ') AS text FROM benchmark")
def redact_words(spark, d):
    kept = F.array(*map(F.lit, ("the", "of", "la", "de", "and")))
    return table(spark, d, "benchmark").select("item_id", layout.redact_words(F.col("text"), kept).alias("text"))


@query("""WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM benchmark),
w AS (SELECT item_id, line, unnest(string_split(content, ' ')) AS token, generate_subscripts(string_split(content, ' '), 1) - 1 AS word FROM l)
SELECT item_id, line, word, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY item_id, line ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 5.5::DOUBLE AS x, line * 12.0::DOUBLE AS y, length(token) * 5.5::DOUBLE AS width FROM w""")
def word_boxes(spark, d):
    return layout.word_boxes(table(spark, d, "benchmark"), ["item_id"], "text", 5.5, 12.0)


@query("WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 2 = 0) SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM t GROUP BY conv_id")
def selected_text(spark, d):
    turns = table(spark, d, "conversations", "conv_id", "turn", "text")
    return layout.selected_text(turns, turns.where("turn % 2 = 0"), ["conv_id", "turn"], ["conv_id"], "turn")


# pages: an order is a page of its customer's file


PAGES = "p AS (SELECT o_custkey AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey AS obj_num, CAST(o_orderkey % 4 * 90 AS INT) AS rotate FROM orders)"


def page_frame(spark, d) -> DataFrame:
    frame = table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("obj_num"), (F.col("o_orderkey") % 4 * 90).cast("int").alias("rotate"))
    return pages.renumbered(frame, ["file_id"], ["obj_num"]).select("file_id", "page", "obj_num", "rotate")


@query(f"WITH {PAGES} SELECT file_id, page, obj_num, CASE WHEN page IN (1, 3) THEN (rotate + 270) % 360 ELSE rotate END AS rotate FROM p")
def rotate_pages(spark, d):
    return pages.rotate(page_frame(spark, d), F.col("page").isin(1, 3), -90)


@query(f"WITH {PAGES} SELECT file_id, obj_num, rotate, row_number() OVER (PARTITION BY file_id ORDER BY page) AS page FROM p WHERE page NOT IN (2, 5)")
def remove_pages(spark, d):
    frame = page_frame(spark, d)
    return pages.remove(frame, frame.where("page in (2, 5)"), ["file_id"])


@query(f"WITH {PAGES} SELECT file_id, obj_num, rotate, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN page = 4 THEN 1.5 ELSE page END) AS page FROM p")
def reorder_pages(spark, d):
    return pages.move(page_frame(spark, d), ["file_id"], 4, 2)


@query(f"WITH {PAGES} SELECT file_id, obj_num, rotate, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN page IN (1, 5, 3) THEN 6.5 ELSE page END, page) AS page FROM p")
def reorder_pages_batch(spark, d):
    return pages.move_batch(page_frame(spark, d), ["file_id"], [5, 1, 3], 7)


@query(f"WITH {PAGES} SELECT file_id, obj_num, rotate, CASE page WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE page END AS page FROM p")
def swap_pages(spark, d):
    return pages.swap(page_frame(spark, d), 1, 2)


@query(f"WITH {PAGES}, u AS (SELECT *, CAST(page AS DOUBLE) AS place FROM p UNION ALL SELECT *, 2.5 FROM p WHERE page = 2) SELECT file_id, obj_num, rotate, row_number() OVER (PARTITION BY file_id ORDER BY place) AS page FROM u")
def duplicate_page(spark, d):
    return pages.duplicate(page_frame(spark, d), ["file_id"], 2)


@query(f"WITH {PAGES}, w AS (SELECT * FROM (VALUES (1, 3), (2, 1), (3, 1)) w(page, source_page)) SELECT file_id, obj_num, rotate, w.page, w.source_page FROM p JOIN w ON p.page = w.source_page")
def extract_pages(spark, d):
    return pages.extract(page_frame(spark, d), ["file_id"], [3, 1, 1])


@query(f"""WITH {PAGES}, q AS (SELECT file_id + 1 AS file_id, page, obj_num, rotate FROM p WHERE page <= 2), z AS (SELECT file_id, max(page) AS size FROM p GROUP BY file_id),
u AS (SELECT *, CAST(page AS DOUBLE) AS place, page AS own FROM p UNION ALL SELECT q.*, least(3, size + 1) - 0.5, page FROM q JOIN z USING (file_id))
SELECT file_id, obj_num, rotate, row_number() OVER (PARTITION BY file_id ORDER BY place, own) AS page FROM u""")
def insert_pages(spark, d):
    frame = page_frame(spark, d)
    return pages.insert(frame, frame.where("page <= 2").withColumn("file_id", F.col("file_id") + 1), ["file_id"], 3)


@query(f"""WITH {PAGES}, u AS (SELECT *, 0 AS source FROM p WHERE page <= 3 UNION ALL SELECT *, 1 FROM p WHERE page > 4) SELECT file_id, obj_num, rotate, source, row_number() OVER (PARTITION BY file_id ORDER BY source, page) AS page FROM u""")
def merge_documents(spark, d):
    frame = page_frame(spark, d)
    return pages.merge([frame.where("page <= 3"), frame.where("page > 4")], ["file_id"])


@query(f"WITH {PAGES} SELECT file_id, page, obj_num, rotate, 'AB-' || lpad(CAST(row_number() OVER (PARTITION BY file_id ORDER BY page) + 99 AS VARCHAR), 6, '0') AS label FROM p WHERE page % 2 = 1")
def bates_numbers(spark, d):
    return pages.bates(page_frame(spark, d).where("page % 2 = 1"), ["file_id"], "page", "AB-", 100, 6)


@query(f"""WITH {PAGES} SELECT file_id, page, coalesce(lead(obj_num) OVER w, first_value(obj_num) OVER (PARTITION BY file_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next, coalesce(lag(obj_num) OVER w, last_value(obj_num) OVER (PARTITION BY file_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev FROM p WINDOW w AS (PARTITION BY file_id ORDER BY page)""")
def thread_links(spark, d):
    return pages.ring(page_frame(spark, d), ["file_id"], ["page"], "obj_num").select("file_id", "page", "next", "prev")


@query(f"WITH {PAGES} SELECT file_id, page, lead(obj_num) OVER w AS next, lag(obj_num) OVER w AS prev FROM p WINDOW w AS (PARTITION BY file_id ORDER BY page)")
def outline_links(spark, d):
    return pages.siblings(page_frame(spark, d), ["file_id"], ["page"], "obj_num").select("file_id", "page", "next", "prev")


@query(f"WITH {PAGES} SELECT file_id, CASE WHEN page = 1 THEN 0 ELSE page // 2 END AS spread, min(page) AS first, count(*) AS n FROM p GROUP BY ALL")
def spread_indices(spark, d):
    out = pages.spreads(page_frame(spark, d), ["file_id"])
    return out.select("file_id", F.col("spread").cast("long").alias("spread"), F.col("pages")[0].alias("first"), F.size("pages").cast("long").alias("n"))


@query(f"WITH {PAGES} SELECT file_id, page, coalesce(sum(600.0::DOUBLE + rotate + 16.0::DOUBLE) OVER (PARTITION BY file_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS top FROM p")
def page_layouts(spark, d):
    frame = page_frame(spark, d).withColumn("height", F.lit(600.0) + F.col("rotate"))
    return pages.stacked(frame, ["file_id"], "page", "height", 16.0).select("file_id", "page", "top")


@query(f"WITH {PAGES} SELECT file_id, max(page) - min(page) + 1 = count(DISTINCT page) AS contiguous FROM p WHERE obj_num % 3 <> 0 GROUP BY file_id")
def contiguous_selection(spark, d):
    return pages.is_contiguous(page_frame(spark, d).where("obj_num % 3 <> 0"), ["file_id"])


@query(f"WITH {PAGES} SELECT file_id, page, (row_number() OVER (PARTITION BY file_id ORDER BY page) - 1) // 4 AS node FROM p")
def balanced_page_tree(spark, d):
    return pages.balanced_tree(page_frame(spark, d), ["file_id"], "page", 4).select("file_id", "page", "node")


@query("""WITH r AS (SELECT p_partkey, p_size % 9 + 1 AS n FROM part) SELECT p_partkey, list_sort(list_distinct(list_filter([2, 3, 4, 7, 1], lambda k: k <= n))) AS pages FROM r""")
def page_ranges(spark, d):
    n = (F.col("p_size") % 9 + 1).cast("int")
    return table(spark, d, "part").select("p_partkey", pages.parse_page_range(F.lit("2-4, 7,x,3,1,9-8"), n).alias("pages"))


# trees: regions, nations and customers are one tree


TREE = """t AS (SELECT 0 AS file_id, -1::BIGINT AS id, NULL::BIGINT AS parent, 0::BIGINT AS pos, 'Root' AS name, 612 AS width, 0 AS open UNION ALL
SELECT 0, r_regionkey, -1, r_regionkey, r_name, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey * 100 END, r_regionkey % 2 FROM region UNION ALL
SELECT 0, 100 + n_nationkey, n_regionkey, n_nationkey, n_name, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey END, n_nationkey % 2 FROM nation UNION ALL
SELECT 0, 1000 + s_suppkey, 100 + s_nationkey, s_suppkey, s_name, NULL, 1 FROM supplier)"""


def tree(spark, d) -> DataFrame:
    t = lambda name: table(spark, d, name)
    root = spark.range(1).selectExpr("0 AS file_id", "-1L AS id", "CAST(NULL AS BIGINT) AS parent", "0L AS pos", "'Root' AS name", "612 AS width", "0 AS open")
    region = t("region").selectExpr("0 AS file_id", "CAST(r_regionkey AS BIGINT) AS id", "-1L AS parent", "CAST(r_regionkey AS BIGINT) AS pos", "r_name AS name", "CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey * 100 END AS width", "r_regionkey % 2 AS open")
    nation = t("nation").selectExpr("0 AS file_id", "100L + n_nationkey AS id", "CAST(n_regionkey AS BIGINT) AS parent", "CAST(n_nationkey AS BIGINT) AS pos", "n_name AS name", "CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey END AS width", "n_nationkey % 2 AS open")
    supplier = t("supplier").selectExpr("0 AS file_id", "1000L + s_suppkey AS id", "100L + s_nationkey AS parent", "s_suppkey AS pos", "s_name AS name", "CAST(NULL AS INT) AS width", "1 AS open")
    return root.unionByName(region).unionByName(nation).unionByName(supplier)


RECURSIVE = "w AS (SELECT id, parent, 0 AS depth, lpad(CAST(pos AS VARCHAR), 10, '0') AS path, {0} FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.parent, w.depth + 1, w.path || '/' || lpad(CAST(t.pos AS VARCHAR), 10, '0'), {1} FROM w JOIN t ON t.parent = w.id)"


@query(f"WITH RECURSIVE {TREE}, {RECURSIVE.format('0 AS x', '0')} SELECT 0 AS file_id, id, depth, path FROM w WHERE id >= 1000")
def page_tree_leaves(spark, d):
    nodes = tree(spark, d).withColumn("type", F.when(F.col("id") >= 1000, "Page").otherwise("Pages"))
    return trees.leaves(nodes)


@query(f"WITH RECURSIVE {TREE}, {RECURSIVE.format('0 AS x', '0')} SELECT 0 AS file_id, id, depth, path FROM w WHERE id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)")
def kidless_page_leaves(spark, d):
    return trees.leaves_without_kids(tree(spark, d))


@query(f"WITH RECURSIVE {TREE}, {RECURSIVE.format('width', 'coalesce(t.width, w.width)')} SELECT 0 AS file_id, id, width FROM w")
def inherited_attributes(spark, d):
    return trees.inherited(tree(spark, d), ["width"]).select("file_id", "id", "width")


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT id, name, width AS ff FROM t WHERE parent IS NULL UNION ALL SELECT t.id, w.name || '.' || t.name, coalesce(t.width, w.ff) FROM w JOIN t ON t.parent = w.id)
SELECT id, name, ff, id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) AS terminal FROM w""")
def form_qualified_names(spark, d):
    fields = tree(spark, d).select("file_id", "id", "parent", "pos", F.col("name").alias("t"), F.lit(None).cast("string").alias("ft"), F.col("width").alias("ff"), F.lit(None).cast("string").alias("v"))
    return trees.qualified_names(fields).select("id", "name", "ff", "terminal")


@query(f"WITH RECURSIVE {TREE}, {RECURSIVE.format('true AS shown, open = 1 OR id = -1 AS open', 'w.shown AND w.open, t.open = 1')} SELECT id, shown FROM w")
def outline_visibility(spark, d):
    items = tree(spark, d).withColumn("open", (F.col("open") == 1) | (F.col("id") == -1))
    return trees.visible_outline(items).select("id", "shown")


@query(f"WITH RECURSIVE {TREE}, {RECURSIVE.format('id IN (2, 105) AS cut', 'w.cut OR t.id IN (2, 105)')} SELECT id, name FROM t WHERE id NOT IN (SELECT id FROM w WHERE cut)")
def subtree_delete(spark, d):
    nodes = tree(spark, d)
    return trees.without_subtree(nodes, nodes.where("id in (2, 105)")).select("id", "name")


@query(f"WITH RECURSIVE {TREE}, {RECURSIVE.format('[]::BIGINT[] AS chain', 'list_append(w.chain, w.id)')} SELECT id, array_to_string(chain, '/') AS chain FROM w")
def parent_chains(spark, d):
    return trees.ancestors(tree(spark, d)).select("id", F.array_join("chain", "/").alias("chain"))


@query(f"WITH RECURSIVE {TREE}, w AS (SELECT 3::BIGINT AS id, 0 AS depth UNION ALL SELECT t.id, depth + 1 FROM w JOIN t ON t.parent = w.id) SELECT 0 AS file_id, id, min(depth) AS depth FROM w GROUP BY id")
def reachable_objects(spark, d):
    nodes = tree(spark, d)
    return trees.reachable(nodes.where("parent is not null").select("file_id", F.col("parent").alias("src"), F.col("id").alias("dst")), nodes.where("id = 3").select("file_id", "id"))


# metadata, dates, bits, colours, text


META = """i AS (SELECT c_custkey AS file_id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS subject, 'D:2024010203' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') || '05Z' AS creation_date FROM customer WHERE c_custkey % 4 <> 0),
x AS (SELECT c_custkey AS file_id, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) || 'x' ELSE c_name END AS title, lower(c_mktsegment) AS subject, '2024-01-02T03:' || lpad(CAST((c_custkey + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END) % 60 AS VARCHAR), 2, '0') || ':05+00:00' AS creation_date FROM customer WHERE c_custkey % 7 <> 0)"""


def two_places(spark, d) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    info = c.where("c_custkey % 4 <> 0").selectExpr("c_custkey AS file_id", "c_name AS title", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS subject", "concat('D:2024010203', lpad(CAST(c_custkey % 60 AS STRING), 2, '0'), '05Z') AS creation_date")
    xmp = c.where("c_custkey % 7 <> 0").selectExpr("c_custkey AS file_id", "CASE WHEN c_custkey % 5 = 0 THEN concat(upper(c_name), 'x') ELSE c_name END AS title", "lower(c_mktsegment) AS subject", "concat('2024-01-02T03:', lpad(CAST((c_custkey + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END) % 60 AS STRING), 2, '0'), ':05+00:00') AS creation_date")
    return info, xmp


@query(f"WITH {META} SELECT coalesce(x.file_id, i.file_id) AS file_id, coalesce(nullif(x.title, ''), nullif(i.title, '')) AS title, coalesce(nullif(x.subject, ''), nullif(i.subject, '')) AS subject FROM i FULL JOIN x ON i.file_id = x.file_id")
def metadata_settle(spark, d):
    return metadata.settle(*two_places(spark, d), ["title", "subject"])


@query(f"""WITH {META} SELECT i.file_id, 'title' AS field, i.title AS info, x.title AS xmp FROM i JOIN x USING (file_id) WHERE i.title <> x.title
UNION ALL SELECT i.file_id, 'subject', i.subject, x.subject FROM i JOIN x USING (file_id) WHERE i.subject <> '' AND i.subject <> x.subject
UNION ALL SELECT i.file_id, 'creation_date', i.creation_date, x.creation_date FROM i JOIN x USING (file_id) WHERE substr(i.creation_date, 13, 2) <> substr(x.creation_date, 15, 2)""")
def metadata_disagreements(spark, d):
    return metadata.disagreements(*two_places(spark, d), ["title", "subject", "creation_date"])


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(day(o_orderdate) AS INT) END AS day, CASE WHEN o_orderkey % 3 = 2 THEN -150 END AS zone FROM orders""")
def pdf_date_parse(spark, d):
    shape = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "'D:'yyyyMM")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("o_orderdate", "'D:'yyyyMMddHHmmss"), F.lit("-02'30'")))
    parts = dates.date_parts(shape)
    return table(spark, d, "orders").select("o_orderkey", parts["year"].alias("year"), parts["month"].alias("month"), parts["day"].alias("day"), parts["zone"].alias("zone"))


@query("SELECT o_orderkey, o_orderdate AS instant FROM orders")
def pdf_date_round_trip(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.date_instant(dates.pdf_date(F.col("o_orderdate"))).alias("instant"))


@query("""SELECT l_partkey AS p, bit, (l_partkey >> (bit - 1)) & 1 = 1 AS granted FROM (SELECT DISTINCT l_partkey FROM lineitem), (SELECT unnest([3, 4, 5, 6, 9, 10, 11, 12]) AS bit)""")
def permission_bits(spark, d):
    p = table(spark, d, "lineitem", "l_partkey").distinct()
    return p.select(F.col("l_partkey").alias("p"), F.explode(numbers.permissions(F.col("l_partkey"))).alias("x")).select("p", "x.bit", "x.granted")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN -3904 WHEN 1 THEN -3904 + 4 + 16 ELSE -3904 + 2048 + 256 END AS p FROM part")
def permission_keywords(spark, d):
    k = F.col("p_partkey") % 3
    listed = F.when(k == 0, "").when(k == 1, "print, copy").otherwise("print-high,forms")
    return table(spark, d, "part").select("p_partkey", numbers.permissions_from_keywords(listed).alias("p"))


@query("SELECT p_partkey, (p_partkey & 1) <> 0 AS invisible, (p_partkey & 4) <> 0 AS print, (p_partkey & 512) <> 0 AS locked_contents FROM part")
def annotation_flags(spark, d):
    flags = numbers.annotation_flags(F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", flags["invisible"].alias("invisible"), flags["print"].alias("print"), flags["locked_contents"].alias("locked_contents"))


@query("""WITH e AS (SELECT p_partkey, p_size % 6 AS v, p_partkey % 7 AS r FROM part) SELECT p_partkey, CASE WHEN v IN (1, 2) AND r IN (2, 3) THEN 'RC4' WHEN v = 4 AND r = 4 THEN 'AES-128 or RC4' WHEN v = 5 AND r IN (5, 6) THEN 'AES-256' ELSE 'unsupported' END AS handler,
CASE v WHEN 1 THEN 40 WHEN 5 THEN 256 END AS bits FROM e""")
def encryption_handlers(spark, d):
    v, r = F.col("p_size") % 6, F.col("p_partkey") % 7
    return table(spark, d, "part").select("p_partkey", numbers.handler_support(v, r).alias("handler"), numbers.key_bits(F.lit(None), v).alias("bits"))


@query("SELECT p_partkey, CASE WHEN (p_size * 45) % 90 = 0 THEN (p_size * 45) % 360 END AS turn FROM part")
def quarter_turns(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.quarter(F.col("p_size") * 45).alias("turn"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((1 - l_discount) * (1 - l_tax), 6) AS r, round((1 - l_tax) * (1 - l_tax), 6) AS g FROM lineitem")
def cmyk_to_rgb(spark, d):
    rgb = geometry.cmyk_to_rgb(F.col("l_discount"), F.col("l_tax"), F.lit(0.0), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(rgb[0], 6).alias("r"), F.round(rgb[1], 6).alias("g"))


LAB = """WITH i AS (SELECT p_partkey, (p_size * 2.0 + 16) / 116 AS y, (p_partkey % 100 - 50.0) / 500 + (p_size * 2.0 + 16) / 116 AS x, (p_size * 2.0 + 16) / 116 - (p_partkey % 80 - 40.0) / 200 AS z FROM part),
f AS (SELECT p_partkey, {0} AS x, {1} AS y, {2} AS z FROM i), l AS (SELECT p_partkey, greatest(0.0, least(1.0, 0.950489 * x * 3.2404542 + y * -1.5371385 + 1.088840 * z * -0.4985314)) AS r FROM f)
SELECT p_partkey, round(CASE WHEN r <= 0.0031308 THEN 12.92 * r ELSE 1.055 * pow(r, 1 / 2.4) - 0.055 END, 6) AS r FROM l""".format(*(f"CASE WHEN {v} > 6 / 29 THEN {v} * {v} * {v} ELSE 3 * (6 / 29) * (6 / 29) * ({v} - 4 / 29) END" for v in "xyz")).replace("6 / 29", "(6.0::DOUBLE / 29)").replace("4 / 29", "(4.0::DOUBLE / 29)").replace("1 / 2.4", "1.0::DOUBLE / 2.4").replace(".0 ", ".0::DOUBLE ").replace(".0)", ".0::DOUBLE)")


@query(LAB)
def color_to_rgb(spark, d):
    rgb = geometry.lab_to_rgb(F.col("p_size") * 2.0, F.col("p_partkey") % 100 - 50.0, F.col("p_partkey") % 80 - 40.0)
    return table(spark, d, "part").select("p_partkey", F.round(rgb[0], 6).alias("r"))


@query("SELECT p_partkey, p_size * 2.0::DOUBLE AS a, p_size * 3.0::DOUBLE + p_partkey AS e FROM part")
def matrix_concat(spark, d):
    m = geometry.concat_matrix(F.array(*(F.lit(x).cast("double") for x in (2, 0, 0, 2, 3, 1))), F.array(F.col("p_size").cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("p_partkey").cast("double"), F.lit(0.0)))
    return table(spark, d, "part").select("p_partkey", m[0].alias("a"), m[4].alias("e"))


@query("SELECT l_suppkey AS page, min(l_quantity) AS x1, max(l_quantity) AS x2, max(l_quantity) - min(l_quantity) AS width FROM lineitem GROUP BY l_suppkey")
def rect_union(spark, d):
    box = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("page")).agg(F.min("l_quantity").alias("x1"), F.max("l_quantity").alias("x2"))
    return box.withColumn("width", geometry.rect_width(F.array("x1", F.lit(0.0), "x2", F.lit(0.0))))


@query("""WITH f AS (SELECT p_partkey, (['Courier-Bold', 'ABCDEF+TimesNewRoman', 'MS-Gothic', 'Wingdings', 'Arial-Black', 'Helvetica'])[p_partkey % 6 + 1] AS name, p_size % 4 AS flags FROM part)
SELECT p_partkey, CASE WHEN name = 'MS-Gothic' THEN 'Cjk' WHEN flags & 1 <> 0 OR name = 'Courier-Bold' THEN 'Monospace' WHEN flags & 2 <> 0 OR name = 'ABCDEF+TimesNewRoman' THEN 'Serif' WHEN name = 'Wingdings' THEN 'Symbol' ELSE 'SansSerif' END AS category,
name IN ('Courier-Bold', 'Arial-Black') AS bold, contains(name, '+') AS subset FROM f""")
def font_categories(spark, d):
    names = F.array(*map(F.lit, ("Courier-Bold", "ABCDEF+TimesNewRoman", "MS-Gothic", "Wingdings", "Arial-Black", "Helvetica")))
    name = names[(F.col("p_partkey") % 6).cast("int")]
    return table(spark, d, "part").select("p_partkey", geometry.font_category(name, F.col("p_size") % 4, F.lit(False)).alias("category"), geometry.is_bold(name).alias("bold"), geometry.is_subset(name).alias("subset"))


@query("SELECT p_partkey, CAST(ceil(p_size * 3 * 4 / 8) * 7 AS BIGINT) AS bytes FROM part")
def image_bytes(spark, d):
    return table(spark, d, "part").select("p_partkey", geometry.bytes_needed(F.col("p_size"), F.lit(7), F.lit(3), F.lit(4)).alias("bytes"))


@query("SELECT doc_id, text AS utf16, text AS utf8, text AS pdfdoc, 'declared' AS encoding FROM documents")
def text_decode(spark, d):
    t = F.col("text")
    recovered = lambda e: text.recover_text(text.encode_text(t, e))
    return table(spark, d, "documents").select("doc_id", recovered("utf-16be").alias("utf16"), recovered("utf-8").alias("utf8"), recovered("pdfdoc").alias("pdfdoc"), text.text_encoding(text.encode_text(t, "utf-16be")).alias("encoding"))


@query("SELECT doc_id, hex(encode(text)) AS digits FROM documents")
def ascii_hex_decode(spark, d):
    return table(spark, d, "documents").select("doc_id", F.hex(text.decode_hex(F.concat(F.lower(F.hex(F.encode("text", "UTF-8"))), F.lit(" >")))).alias("digits"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CAST(p_size // 4 AS VARCHAR) ELSE CAST(p_size // 4 AS VARCHAR) || (['.25', '.5', '.75'])[p_size % 4] END AS written FROM part")
def real_format(spark, d):
    return table(spark, d, "part").select("p_partkey", text.format_real(F.col("p_size") / 4).alias("written"))


@query("SELECT doc_id, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '(', chr(92) || '('), ')', chr(92) || ')'), chr(13), chr(92) || 'r') AS literal FROM documents")
def literal_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", text.escape_literal(F.col("text")).alias("literal"))


@query("SELECT doc_id, sha256(substr(text, 1, length(text) // 3) || substr(text, length(text) // 3 + 11)) AS digest, length(text) > 10 AND length(text) // 3 + 10 < length(text) AS gap FROM documents")
def signature_ranges(spark, d):
    n = F.char_length("text")
    third = (n / 3).cast("int")
    signed = F.concat(F.substring(F.col("text"), F.lit(1), third), F.substring(F.col("text"), third + 11, n))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode(signed, "UTF-8"), 256).alias("digest"), ((n > 10) & (third + 10 < n)).alias("gap"))


# normalising


@query("""WITH s AS (SELECT p_partkey AS obj_num, (['DeviceRGB', 'Strange', 'CalRGB', 'ICCBased', 'Indexed', 'Separation'])[p_partkey % 6 + 1] AS family, CASE WHEN p_partkey % 6 < 2 THEN NULL ELSE p_size % 5 END AS length FROM part),
c AS (SELECT *, CASE WHEN length IS NULL AND family = 'Strange' THEN '8.6' WHEN length = 0 THEN '8.6' WHEN family = 'CalRGB' AND length < 2 THEN '8.6.5' WHEN family = 'ICCBased' AND length < 2 THEN '8.6.5.5' WHEN family = 'Indexed' AND length < 4 THEN '8.6.6.3' WHEN family = 'Separation' AND length < 4 THEN '8.6.6.4' END AS clause FROM s)
SELECT 0 AS file_id, obj_num, 1 AS severity, clause, CASE WHEN length = 0 THEN 'read an empty array as DeviceRGB' WHEN length IS NULL THEN 'read the unknown ' || family || ' as DeviceRGB' ELSE 'read the incomplete ' || family || ' as DeviceRGB' END AS action FROM c WHERE clause IS NOT NULL""")
def colour_space_rules(spark, d):
    families = F.array(*map(F.lit, ("DeviceRGB", "Strange", "CalRGB", "ICCBased", "Indexed", "Separation")))
    kind = (F.col("p_partkey") % 6).cast("int")
    spaces = table(spark, d, "part").select(F.lit(0).alias("file_id"), F.col("p_partkey").alias("obj_num"), families[kind].alias("family"), F.when(kind >= 2, F.col("p_size") % 5).alias("length"))
    return normalize.colour_space_decisions(spaces, relaxed=True)


@query("""WITH f AS (SELECT c_custkey AS file_id, CASE WHEN c_custkey % 2 = 0 THEN 'user' ELSE 'owner' END AS access, c_custkey % 4096 AS p, c_nationkey % 3 AS signatures FROM customer),
n AS (SELECT *, list_filter([CASE WHEN p & 8 = 0 THEN 'modification' END, CASE WHEN p & 1024 = 0 THEN 'assembly' END, CASE WHEN p & 32 = 0 THEN 'annotation' END], lambda x: x IS NOT NULL) AS denied FROM f)
SELECT file_id, 2 AS severity, '7.6.4.2' AS clause, 'opened as a user, whom /P ' || p || ' denies ' || array_to_string(denied, ', ') AS found FROM n WHERE access = 'user' AND len(denied) > 0
UNION ALL SELECT file_id, 2, '12.8', 'signatures that a copy does not keep: ' || signatures FROM n WHERE signatures > 0""")
def write_losses(spark, d):
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.when(F.col("c_custkey") % 2 == 0, "user").otherwise("owner").alias("access"), (F.col("c_custkey") % 4096).alias("p"), (F.col("c_nationkey") % 3).alias("signatures"))
    return normalize.write_losses(files)


@query(f"WITH RECURSIVE {TREE}, w AS (SELECT 1::BIGINT AS id UNION ALL SELECT t.id FROM w JOIN t ON t.parent = w.id) SELECT 0 AS file_id, id, row_number() OVER (ORDER BY id) AS number FROM w")
def clone_objects(spark, d):
    nodes = tree(spark, d)
    return normalize.cloned(nodes.where("parent is not null").select("file_id", F.col("parent").alias("src"), F.col("id").alias("dst")), nodes.where("id = 1").select("file_id", "id"))


@query("""WITH c AS (SELECT c_custkey AS code, c_nationkey AS font FROM customer), r AS (SELECT s_nationkey AS font, min(s_suppkey) * 10 AS low, min(s_suppkey) * 10 + 15 AS high FROM supplier GROUP BY s_nationkey)
SELECT c.font, 2 AS width, c.code, CASE WHEN r.low IS NOT NULL THEN 'x' || chr(CAST(CASE c.font % 3 WHEN 0 THEN 65 WHEN 1 THEN 19968 ELSE 128512 END + c.code - r.low AS INT)) END AS text FROM c LEFT JOIN r ON c.font = r.font AND c.code BETWEEN r.low AND r.high""")
def cmap_texts(spark, d):
    codes = table(spark, d, "customer").select(F.col("c_nationkey").alias("font"), F.lit(2).alias("width"), F.col("c_custkey").alias("code"))
    ranges = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("font")).agg((F.min("s_suppkey") * 10).alias("low")).select("font", F.lit(2).alias("width"), "low", (F.col("low") + 15).alias("high"), F.when(F.col("font") % 3 == 0, "xA").when(F.col("font") % 3 == 1, "x一").otherwise("x😀").alias("text"))
    return normalize.code_texts(codes, ranges, ["font"])


@query("SELECT l_suppkey AS cid, arg_max(l_partkey, (l_quantity, -l_partkey)) AS gid FROM lineitem GROUP BY l_suppkey")
def glyph_candidates(spark, d):
    candidates = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cid"), F.col("l_partkey").alias("gid"), F.col("l_quantity").alias("score"))
    return normalize.best_candidates(candidates, ["cid"])


@query("""WITH c AS (SELECT c_custkey, unnest(string_split(c_name, '')) AS ch FROM customer) SELECT c_custkey, CAST(sum(CASE WHEN ch = ' ' THEN 250 WHEN contains('il', ch) THEN 278 WHEN contains('jtfr', ch) THEN 333 WHEN contains('IJ', ch) THEN 361 WHEN contains('!.,:;''|', ch) THEN 250 WHEN contains('mw', ch) THEN 778 WHEN contains('MW', ch) THEN 889
WHEN contains('@%', ch) THEN 850 WHEN ch BETWEEN '0' AND '9' THEN 500 WHEN ch BETWEEN 'A' AND 'Z' THEN 680 ELSE 500 END) AS INT) AS width FROM c WHERE ch <> '' GROUP BY c_custkey""")
def text_widths(spark, d):
    return table(spark, d, "customer").select("c_custkey", normalize.text_width(F.col("c_name"), F.lit("Serif")).alias("width"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE '<dc:title><rdf:Alt><rdf:li xml:lang="x-default">' || n_name || ' &amp; co</rdf:li></rdf:Alt></dc:title>' END || '<dc:creator><rdf:Seq><rdf:li>a&lt;b</rdf:li></rdf:Seq></dc:creator>' AS body FROM nation""")
def xmp_packets(spark, d):
    title = F.when(F.col("n_nationkey") % 3 != 0, F.concat("n_name", F.lit(" & co")))
    packet = normalize.xmp_packet(title, F.lit("a<b"), F.lit(None).cast("string"))
    return table(spark, d, "nation").select("n_nationkey", F.regexp_extract(packet, '1.3/">(.*)</rdf:Description>', 1).alias("body"))
