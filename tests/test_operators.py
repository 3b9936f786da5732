"""Operators on small frames: nulls, ties, empty frames, limits and errors."""

import pytest
from pyspark.sql import functions as F

from pagefold.functions import dates, numbers, text
from pagefold.operators import census, coverage, edits, layout, lookup, normalize, pages, trees


def one(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_text_strings(spark):
    rows = [("pdfdoc", b"a\x90\xae"), ("declared", b"\xfe\xff\x00A\x20\xac"), ("utf16le", b"\xff\xfeA\x00"), ("declared", b"\xef\xbb\xbf\xc3\xa9"), ("naked-be", b"\x00A\x00B"), ("naked-le", b"A\x00B\x00"), (None, None), ("pdfdoc", b"")]
    frame = spark.createDataFrame(rows, "want string, b binary")
    out = frame.select("want", text.text_encoding(F.col("b")).alias("kind"), text.recover_text(F.col("b")).alias("t")).collect()
    assert all(r["want"] == r["kind"] for r in out)
    assert [r["t"] for r in out] == ["a’®", "A€", "A", "é", "AB", "AB", None, ""]


def test_dates(spark):
    rows = ["D:20240102030405+02'30'", "2024-01-02T03:04:05+02:30", "D:2024", "20240102", "2024-01-02", "nonsense", "", None]
    frame = spark.createDataFrame([(r,) for r in rows], "s string").select("s", dates.date_parts(F.col("s")).alias("p"))
    found = {r["s"]: r["p"] for r in frame.collect()}
    assert tuple(found[rows[0]]) == (2024, 1, 2, 3, 4, 5, 150) == tuple(found[rows[1]])
    assert found["D:2024"]["month"] is None and found["20240102"]["day"] == 2 and found["2024-01-02"]["hour"] is None
    assert found["nonsense"] is None and found[""] is None and found[None] is None
    same = spark.createDataFrame([("D:20240102030405Z", "2024-01-02T03:04:05Z"), ("D:20240102030405Z", "2024-01-02T03:04:05+01:00")], "a string, b string")
    assert one(same.select(dates.same_date(F.col("a"), F.col("b")).alias("x")), "x") == [(True,), (False,)]


def test_numbers(spark):
    f = spark.range(1)
    assert one(f.select(numbers.percent(F.lit(2), F.lit(3)).alias("a"), numbers.percent(F.lit(0), F.lit(0)).alias("b"), numbers.quarter(F.lit(-90)).alias("c"), numbers.quarter(F.lit(45)).alias("d"), numbers.roman(F.lit(1994)).alias("e"), numbers.letters(F.lit(28)).alias("f"), numbers.bates_label("x", F.lit(7), 3).alias("g")), "*") == [(66, None, 270, None, "mcmxciv", "bb", "x007")]
    with pytest.raises(Exception, match="not a permission"):
        f.select(numbers.permissions_from_keywords(F.lit("print,fly"))).collect()


def test_coverage_merge_is_idempotent(spark):
    rows = [("a", "x", "k", True), ("a", "x", "l", False), ("b", "x", "l", False), ("b", "y", "m", True)]
    frame = spark.createDataFrame(rows, "file string, axis string, construct string, read boolean")
    once = sorted(one(coverage.coverage_axes(frame), "axis", "presented", "read", "percent"), key=str)
    assert once == sorted(one(coverage.coverage_axes(frame.unionByName(frame)), "axis", "presented", "read", "percent"), key=str)
    assert (None, 3, 2, 66) in once
    assert one(coverage.coverage_unread(frame), "construct") == [("l",)]
    assert coverage.coverage_axes(frame.limit(0)).where("axis is not null").count() == 0


def test_census_edges(spark):
    records = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 5, "b"), (1, 2, 1, None)], "file_id int, obj_num int, at int, v string")
    assert sorted(one(census.newest_records(records, ["file_id", "obj_num"], ["at"]), "obj_num", "v", "times")) == [(0, "b", 2), (2, None, 1)]
    assert one(census.superseded(records, ["obj_num"], ["at"]), "obj_num", "dead") == [(0, 1)]
    assert census.most_frequent(records.limit(0), "v", 3).count() == 0


def test_lookup_edges(spark):
    points = spark.createDataFrame([(1,), (5,), (0,)], "page int")
    ranges = spark.createDataFrame([(1, "a"), (4, "b"), (4, "c")], "begin int, style string")
    assert sorted(one(lookup.last_range(points, ranges, "page", "begin", ["style"]), "page", "style"), key=str) == [(0, None), (1, "a"), (5, "c")]
    # without groups no task sees all points: buckets give what a scan in order gives
    many = spark.createDataFrame([(k * 7 % 1009,) for k in range(1009)], "page int")
    begins = spark.createDataFrame([(k * k, str(k)) for k in range(3, 40)], "begin int, style string")
    for buckets in (2, 10, 200):
        found = dict(one(lookup.last_range(many, begins, "page", "begin", ["style"], buckets=buckets), "page", "style"))
        assert found == {k: str(min(39, int(k**0.5))) if k >= 9 else None for k in range(1009)}
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 10.0, 0.0, 20.0, 10.0), (1, 3, 900.0, -5.0, 901.0, 900.0)], "page int, box_id int, x1 double, y1 double, x2 double, y2 double")
    areas = spark.createDataFrame([(1, 7, 5.0, 5.0, 10.0, 9.0), (1, 8, 899.0, 899.0, 950.0, 950.0)], "page int, area_id int, x1 double, y1 double, x2 double, y2 double")
    assert sorted(one(lookup.overlapping(boxes, areas, ["page"]), "box_id", "area_id")) == [(1, 7), (3, 8)]


def test_code_texts_beyond_latin(spark):
    codes = spark.createDataFrame([(1, 2, c) for c in (5, 0x10, 0x15, 0x30, 0x99)], "font int, width int, code int")
    ranges = spark.createDataFrame([(1, 2, 0, 8, "é"), (1, 2, 0x10, 0x20, "一"), (1, 2, 0x30, 0x40, "f😀")], "font int, width int, low int, high int, text string")
    found = dict(one(normalize.code_texts(codes, ranges, ["font"]), "code", "text"))
    assert found == {5: "î", 0x10: "一", 0x15: "丅", 0x30: "f😀", 0x99: None}


def test_layout_rules(spark):
    rows = [(0, 1, k, t, s, b, 72.0, y, 10.0) for k, (t, s, b, y) in enumerate([("Title", 24.0, False, 700.0), ("bold", 12.0, True, 680.0), ("x", 12.0, False, 676.0), ("y", 12.0, False, 640.0), ("z", 12.0, False, 640.0)])]
    spans = spark.createDataFrame(rows, "file_id int, page int, op_index int, text string, font_size double, is_bold boolean, x double, y double, width double")
    assert one(layout.page_text(spans), "text") == [("Title\nboldx\nyz",)]
    assert sorted(one(layout.headings(spans), "text", "level")) == [("Title", 1), ("bold", 6)]
    assert [r[0] for r in sorted(one(layout.paragraphs(spans), "spans", "paragraph"), key=lambda r: r[1])] == [3, 2]
    assert layout.paragraphs(spans, keep_tail=False).count() == 1
    assert layout.table_rows(spans).count() == 0


def test_pages_edges(spark):
    frame = spark.createDataFrame([(1, k, k * 10, None) for k in range(1, 5)], "file_id int, page int, obj_num int, rotate int")
    objects = lambda f: [r[1] for r in sorted(one(f, "page", "obj_num"))]
    assert objects(pages.move(frame, ["file_id"], 1, 3)) == [20, 30, 10, 40]
    assert objects(pages.move_batch(frame, ["file_id"], [4, 2], 1)) == [20, 40, 10, 30]
    assert objects(pages.extract(frame, ["file_id"], [3, 3, 1])) == [30, 30, 10]
    assert objects(pages.duplicate(frame, ["file_id"], 2)) == [10, 20, 20, 30, 40]
    assert objects(pages.insert(frame, frame.where("page = 1"), ["file_id"], 99)) == [10, 20, 30, 40, 10]
    assert one(pages.rotate(frame, F.col("page") == 2, 90).where("page = 2"), "rotate") == [(90,)]
    assert one(pages.rotate(frame, F.col("page") == 2, 45).where("page = 2"), "rotate") == [(None,)]
    with pytest.raises(ValueError):
        pages.extract(frame, ["file_id"], [])


def test_trees_end_at_cycles_and_limits(spark):
    nodes = spark.createDataFrame([(0, 1, None, 0), (0, 2, 1, 0), (0, 3, 2, 0), (0, 8, 9, 0), (0, 9, 8, 0)], "file_id int, id long, parent long, pos int")
    assert sorted(r[0] for r in one(trees.walk(nodes, 10), "id")) == [1, 2, 3]
    assert sorted(r[0] for r in one(trees.walk(nodes, 1), "id")) == [1, 2]
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 2, 3)], "file_id int, src long, dst long")
    assert sorted(one(trees.reachable(edges, spark.createDataFrame([(0, 1)], "file_id int, id long")), "id", "depth")) == [(1, 0), (2, 1), (3, 2)]
    # many paths to the same nodes, which are counted once
    diamonds = spark.createDataFrame([(0, 3 * k + a, 3 * k + b) for k in range(25) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))], "file_id int, src long, dst long")
    found = dict(one(trees.reachable(diamonds, spark.createDataFrame([(0, 0)], "file_id int, id long"), 60), "id", "depth"))
    assert len(found) == 76 and found[75] == 50
    far = spark.createDataFrame([(0, 1, None, 0), (0, 2, 1, 1_500_000), (0, 3, 1, 999_999)], "file_id int, id long, parent long, pos int")
    assert [r[0] for r in sorted(one(trees.walk(far, 3), "id", "path"), key=lambda r: r[1])] == [1, 3, 2]
    assert {r[0] for r in one(trees.without_subtree(nodes, nodes.where("id = 2")), "id")} == {1, 8, 9}


@pytest.fixture
def document(spark):
    make = spark.createDataFrame
    return {
        "pages": make([(1, k, k * 10, 0, None, None) for k in range(1, 4)], "file_id int, page int, obj_num int, rotate int, measure string, geo array<double>"),
        "struct_nodes": make([(1, 1, None, 0, "Document", None, None), (1, 2, 1, 0, "H1", None, 2), (1, 3, 2, 0, "Span", None, 3)], "file_id int, id long, parent long, pos int, tag string, alt string, page int"),
        "fields": make([(1, 1, None, 0, "a", "Tx", None), (1, 2, 1, 0, "b", None, "old"), (1, 3, None, 1, "b", "Tx", "x")], "file_id int, node long, parent long, pos int, t string, ft string, v string"),
        "outline": make([(1, 1, None, 0, "old", 0)], "file_id int, node int, parent int, pos int, title string, count int"), "page_labels": make([], "file_id int, from_page int, style string, prefix string, start_at int"),
        "threads": make([], "file_id int, thread int, bead int, page int"), "user_properties": make([], "file_id int, id int, name string, value string"), "attachments": make([], "file_id int, name string, description string, kind string"),
        "layers": make([], "file_id int, id string, name string, visible boolean, printable boolean"), "output_intents": make([], "file_id int, identifier string"), "lexicons": make([], "file_id int, data string"),
        "decorations": make([], "file_id int, page int, text string, position string"), "annotations": make([], "file_id int, page int, subtype string, contents string"), "open_action": make([], "file_id int, action string, target string"),
        "shadings": make([], "file_id int, page int, shading_type int"), "recipients": make([], "file_id int, subject string, certificate string"),
    }


CASES = {
    "Rotate": ({"pages": [1], "degrees": 90}, "pages", "page = 1 and rotate = 90", 1), "Reorder": ({"from": 1, "to": 3}, "pages", "page = 3 and obj_num = 10", 1), "RemovePages": ({"pages": 2}, "struct_nodes", "page is null", 2),
    "SetPageLabels": ({"labels": [{"from_page": 1, "style": "r"}]}, "page_labels", "style = 'r'", 1), "UpdateStructElem": ({"id": 2, "alt": "x"}, "struct_nodes", "alt = 'x'", 1), "DeleteStructElem": ({"id": 2}, "struct_nodes", "true", 1),
    "UpdateArticleThreads": ({"threads": [{"pages": [1, 2]}]}, "threads", "bead = 1 and page = 2", 1), "AddUserProperties": ({"id": 1, "properties": [{"name": "n", "value": 3}]}, "user_properties", "value = '3'", 1),
    "CreatePortfolio": ({"files": [{"name": "f"}]}, "attachments", "kind = 'portfolio'", 1), "UpdateOutlines": ({"items": [{"title": "a", "children": [{"title": "b"}]}]}, "outline", "parent = 1 and title = 'b'", 1),
    "UpdateLayers": ({"layers": [{"id": "l", "name": "n", "printable": False}]}, "layers", "not printable", 1), "AttachAssociatedFile": ({"name": "f"}, "attachments", "kind = 'Unspecified'", 1), "SetOutputIntent": ({"identifier": "sRGB"}, "output_intents", "true", 1),
    "SetPronunciationLexicon": ({"data": "<x/>"}, "lexicons", "true", 1), "AddPageDecoration": ({"text": "t", "position": "TopLeft", "pages": [1, 3]}, "decorations", "text = 't'", 2),
    "ApplyBatesNumbering": ({"prefix": "A", "start": 5, "digits": 3}, "decorations", "text = 'A007' and page = 3", 1), "AddAnnotation": ({"page": 1, "subtype": "Link"}, "annotations", "subtype = 'Link'", 1),
    "SetMeasurementScale": ({"page": 1, "scale": "1:2"}, "pages", "measure = '1:2'", 1), "SetFormFieldValue": ({"name": "a.b", "value": "new"}, "fields", "v = 'new' and node = 2", 1), "ExecuteAction": ({"action": "URI"}, "open_action", "true", 1),
    "SetGeospatialAnchor": ({"page": 2, "latitude": 1, "longitude": 2}, "pages", "geo[1] = 2", 1), "AddMeshShading": ({"page": 1, "shading_type": 4}, "shadings", "true", 1),
    "SetUnencryptedWrapper": ({"name": "w"}, "attachments", "kind = 'EncryptedPayload'", 1), "AddPublicKeyRecipient": ({"subject": "s"}, "recipients", "subject = 's'", 1),
}


def test_all_operations_are_covered():
    assert set(CASES) == set(edits.OPERATIONS) and len(CASES) == 24


@pytest.mark.parametrize("name", sorted(CASES))
def test_operation(document, name):
    arguments, frame, condition, n = CASES[name]
    assert edits.apply_operation(document, name, arguments)[frame].where(condition).count() == n


def test_operation_errors(document):
    for name, arguments in (("Nothing", {}), ("AddPageDecoration", {"text": "t", "position": "Middle"}), ("AddMeshShading", {"page": 1, "shading_type": 2})):
        with pytest.raises(ValueError):
            edits.apply_operation(document, name, arguments)
    assert edits.apply_operation(document, text='{"op": "Rotate", "degrees": 180}')["pages"].where("rotate = 180").count() == 3


def test_images(spark):
    from pagefold.functions import images

    assert images.unpack_samples(bytes([0b10100000, 0b01000000]), 3, 2, 1) == bytes([255, 0, 255, 0, 255, 0])
    assert images.unpack_samples(bytes([0x1F]), 2, 1, 4) == bytes([17, 255]) and images.unpack_samples(b"", 2, 1, 4) is None
    assert images.apply_palette(bytes([0, 1, 9]), b"abcdef", 3) == b"abcdefdef" and images.apply_palette(b"x", b"", 3) == b""
    assert images.mean_luminance(bytes([255] * 6 + [0] * 6), 2, 2) == [255.0, 255.0, 0.0, 0.0]
    frame = spark.createDataFrame([(b"\x80", 2, 1, 1), (None, 1, 1, 1)], "d binary, w int, h int, b int")
    assert [None if r[0] is None else bytes(r[0]) for r in frame.select(images.unpacked(F.col("d"), F.col("w"), F.col("h"), F.col("b"))).collect()] == [b"\xff\x00", None]


def test_walks_have_no_row_limit(spark):
    nodes = spark.range(1_100_000).selectExpr("0 AS file_id", "id", "CASE WHEN id > 0 THEN 0L END AS parent", "CAST(id % 1000 AS INT) AS pos")
    assert trees.walk(nodes, 3).count() == 1_100_000
