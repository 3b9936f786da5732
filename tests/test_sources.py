"""The byte layer: syntax, filters, recovery, text and the data source."""

import os
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagefold.sources import content, document, filters, objects, reader, saving, security, writer
from pagefold.sources.frames import SCHEMAS, frame, parsed


def lines(file):
    return "\n".join(r["text"] for r in document.span_rows(file))


TEXT = "Hello (world) \\ é\n\nline two\n" + "\n".join(f"line {k}" for k in range(120))


@pytest.mark.parametrize("packed", [0, 3])
@pytest.mark.parametrize("name", [None, "FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode"])
def test_round_trip(packed, name):
    file = reader.read(writer.from_text(TEXT, "Tïtle", filter_name=name, packed=packed, outline=["a", "b"], links=3))
    assert lines(file) == TEXT and not file.decisions
    assert len(document.pages(file)) == 3
    assert [r["title"] for r in document.outline_rows(file)] == ["a", "b"]
    assert next(document.metadata_rows(file))["title"] == "Tïtle"
    assert [r["dest_key"] for r in document.annotation_rows(file)] == ["d0", "d1", "d2"]
    assert [r["key"] for r in document.destination_rows(file)] == ["d0", "d2"]


@pytest.mark.parametrize(
    ("damage", "clause", "whole"),
    [
        (lambda b: b"junk" * 75 + b, "7.5.2", True), (lambda b: b[:-30], "7.5.4", True), (lambda b: b.replace(b"startxref", b"startxxxx"), "7.5.4", True),
        (lambda b: b.replace(b"%PDF-", b"%XXX-"), "7.5.2", True), (lambda b: b[: int(len(b) * 0.6)], "7.5.4", False), (lambda b: b.replace(b"/Length ", b"/Lenxxx "), "7.3.8.2", True),
    ],
)
def test_damage_is_a_decision(damage, clause, whole):
    file = reader.read(damage(writer.from_text(TEXT)))
    assert clause in {d[1] for d in file.decisions}
    assert (lines(file) == TEXT) == whole


@pytest.mark.parametrize("sections", [True, False])
@pytest.mark.parametrize("held", [b"short", b"%PDF-1.7\n8 0 obj\n<</Length 1>>\nstream\nx\nendstream\nendobj\n9 0 obj\n<</Length 1>>\nstream\ny"])
def test_a_length_that_leads_to_the_end_of_a_later_stream(held, sections):
    """Only a length that reaches into objects which aren't part of the data is wrong; a file in a stream keeps its own."""
    second = b"\nendstream\nendobj\n2 0 obj\n<</Length 6>>\nstream\nsecond"
    first = len(held) + len(second) if held == b"short" else len(held)
    body = b"%%PDF-1.7\n1 0 obj\n<</Length %d>>\nstream\n" % first + held + second + b"\nendstream\nendobj\n3 0 obj\n<</Type /Catalog>>\nendobj\n"
    at = [body.index(b"1 0 obj"), body.index(b"\n2 0 obj") + 1, body.index(b"\n3 0 obj") + 1]
    table = b"xref\n0 4\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % a for a in at) + b"trailer\n<</Root 3 0 R/Size 4>>\nstartxref\n%d\n%%%%EOF\n" % len(body)
    file = reader.read(body + table if sections else body)
    assert file.objects[1][1].data == held and file.objects[2][1].data == b"second"
    assert any(c == "7.3.8.2" for _, c, _, _ in file.decisions) == (held == b"short")


def test_appended_update_wins():
    first = writer.from_text("abc", "old")
    at = reader.read(first).revisions[0][0]
    file = reader.read(writer.update(first, {4: {"Title": b"new"}}, 1, 7, at))
    assert file.superseded == {4} and len(file.revisions) == 2 and next(document.metadata_rows(file))["title"] == "new"


def test_empty_file_is_decisions():
    assert {d[1] for d in reader.read(b"").decisions} >= {"7.5.2", "7.5.4", "7.7.2"}


def test_cyclic_page_tree_ends():
    data = writer.build({1: {"Type": objects.Name("Catalog"), "Pages": objects.Ref(2, 0)}, 2: {"Type": objects.Name("Pages"), "Kids": [objects.Ref(2, 0), objects.Ref(3, 0)]}, 3: {"Type": objects.Name("Page"), "Parent": objects.Ref(2, 0)}}, 1)
    assert [n for n, _, _ in document.pages(reader.read(data))] == [3]


def test_filter_vectors():
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), {}) == b"-----A---B"
    assert filters.ascii_hex(b"48 65 6C6C 6F7>", {}) == b"Hellop"
    assert filters.run_length(bytes([2, 65, 66, 67, 254, 90, 128]), {}) == b"ABCZZZ"
    rows = b"\x02" + bytes([1, 2, 3]) + b"\x02" + bytes([1, 1, 1])
    assert filters.flate(zlib.compress(rows), {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    assert filters.flate(zlib.compress(b"\x01" + bytes([5, 1, 1])), {"Predictor": 11, "Columns": 3}) == bytes([5, 6, 7])
    with pytest.raises(filters.FilterError):
        filters.decode(b"", {"Filter": objects.Name("JPXDecode")})


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_encoders_invert(data):
    for name in ("FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode"):
        assert filters.decode(filters.encode(data, name), {"Filter": objects.Name(name)}) == data


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.binary(max_size=12) | st.builds(objects.Ref, st.integers(1, 99), st.integers(0, 9)) | st.text("abc #/()é", min_size=1, max_size=6).map(objects.Name),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abcXYZ", min_size=1, max_size=4), x, max_size=4),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(VALUES)
def test_syntax_round_trip(x):
    assert objects.Parser(objects.write(x) + b" ").next() == x


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_reading_never_raises(data):
    reader.read(b"%PDF-1.7\n1 0 obj " + data)


def test_content_operators():
    data = b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 1 0 0 1 5 7 Tm (a) Tj 14 TL (b) ' 0 -3 TD [(c) -500 (d)] TJ ET Q BI /W 1 ID xx EI zz"
    listed = content.commands(data)
    assert [op for op, _ in listed] == ["q", "cm", "BT", "Tf", "Tm", "Tj", "TL", "T*", "Tj", "TL", "Td", "TJ", "ET", "Q", "BI", "zz"]
    file = reader.File()
    found = content.spans(file, data, {"Font": {"F1": {"BaseFont": objects.Name("Arial-Bold")}}})
    assert [(t, size, bold, x, y) for _, t, size, bold, x, y, _ in found] == [("a", 20.0, True, 10.0, 14.0), ("b", 20.0, True, 10.0, -14.0), ("cd", 20.0, True, 10.0, -20.0)]
    assert content.commands(content.serialize(listed[:-2])) == listed[:-2]


def test_cmap():
    spaces, texts, cids = content.parse_cmap(b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0061> endbfrange 1 begincidrange <05> <09> 7 endcidrange")
    assert spaces == [(1, 0, 255)] and texts[1, 1] == "A" and texts[1, 4] == "c" and cids == [(1, 5, 9, 7)]


def test_standard_security():
    o = security.owner_entry(b"owner", b"user", 3, 128)
    key = security.file_key(b"user", o, -44, b"id", 3, 128)
    u = security.user_entry(key, b"id", 3)
    assert security.opens(b"user", o, u, -44, b"id", 3, 128) == key and security.opens(b"wrong", o, u, -44, b"id", 3, 128) is None
    assert security.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_aes():
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        assert security.aes_encrypt(bytes(range(size)), bytes(16), block, padded=False).hex() == want
        assert security.aes_decrypt(bytes(range(size)), bytes(16), bytes.fromhex(want), padded=False) == block
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 100):
        key, start, data = rng.randbytes(rng.choice([16, 32])), rng.randbytes(16), rng.randbytes(n)
        assert security.aes_decrypt(key, start, security.aes_encrypt(key, start, data)) == data
    for wrong in (b"x", bytes(16)):
        with pytest.raises(ValueError):
            security.aes_decrypt(bytes(16), bytes(16), wrong)


def test_plain_ciphers_and_those_of_the_c_library(monkeypatch):
    """Both give the same, and a password of revision 6 takes little time where the library is there."""
    if security.native() is None:
        pytest.skip("no C library")
    rng = random.Random(2)
    given = [(rng.randbytes(n), rng.randbytes(16), rng.randbytes(m)) for n in (16, 32) for m in (0, 1, 16, 33, 4000)]

    def results():
        sealed = [security.aes_encrypt(k, s, d) for k, s, d in given]
        return sealed, [security.aes_decrypt(k, s, x) for (k, s, _), x in zip(given, sealed, strict=True)], [security.rc4(k[:5], d) for k, _, d in given], security.password_hash(b"p", b"12345678", b"", 6)

    fast = results()
    begin = time.process_time()
    for _ in range(10):
        security.protect("AES-256")
    assert time.process_time() - begin < 2  # four hashes each: over 10 s in the plain form
    monkeypatch.setattr(security, "native", lambda: None)
    assert results() == fast


@pytest.mark.parametrize("packed", [0, 3])
@pytest.mark.parametrize("way", sorted(security.WAYS))
def test_encrypted_files(way, packed):
    whole = writer.from_text(TEXT, "Tïtle", packed=packed, outline=["a"], cipher=security.protect(way, b"user", b"owner"))
    assert b"Hello" not in whole
    for password, access in ((b"user", "user"), (b"owner", "owner")):
        file = reader.read(whole, password)
        assert lines(file) == TEXT and not file.decisions and file.access == access
        assert next(document.metadata_rows(file))["title"] == "Tïtle" and [r["title"] for r in document.outline_rows(file)] == ["a"]
        assert next(document.encryption_rows(file))["access"] == access
    file = reader.read(whole, b"wrong")
    assert "7.6.4" in {d[1] for d in file.decisions} and file.access is None


def test_what_cannot_be_opened_is_a_decision():
    clauses = lambda entry: {d[1] for d in reader.read(writer.build(first.objects_plain, 1, extra={"Encrypt": entry})).decisions}
    first = reader.read(writer.from_text("abc"))
    first.objects_plain = {n: x for n, (_, x) in first.objects.items()}
    name = objects.Name
    assert clauses({"Filter": name("Adobe.PubSec"), "V": 4}) == {"7.6.5"} and clauses({"Filter": name("Adobe.PubSec"), "Recipients": [b"x"]}) == {"7.6.5"}
    assert clauses({"Filter": name("Standard"), "V": 3, "R": 3}) == {"7.6.2"} and clauses({"Filter": name("Standard"), "V": 5, "R": 6}) == {"7.6.4"}
    cipher = security.protect("AES-256-R5")
    changed = dict(cipher.entry, P=-1)
    cipher.entry = changed
    assert {d[1] for d in reader.read(writer.from_text("abc", cipher=cipher)).decisions} == {"7.6.4.4"}


def test_forms_and_graphics_states():
    file = reader.File()
    name, stream = objects.Name, objects.Stream
    font = {"BaseFont": name("Arial-Bold")}
    inner = stream({"Subtype": name("Form"), "Matrix": [1, 0, 0, 1, 3, 4]}, b"BT (in) Tj ET /X1 Do")
    file.objects[9] = 0, inner
    resources = {"ExtGState": {"G": {"Font": [font, 8]}}, "XObject": {"X1": objects.Ref(9, 0), "I": stream({"Subtype": name("Image")}, b"")}}
    found = content.spans(file, b"q 2 0 0 2 0 0 cm /G gs /X1 Do /I Do BT (out) Tj ET Q BT /F9 7 Tf (x) Tj ET", resources, file.decide)
    assert [(i, t, s, b, x, y) for i, t, s, b, x, y, _ in found] == [(6, "in", 16.0, True, 6.0, 8.0), (11, "out", 16.0, True, 0.0, 0.0), (16, "x", 7.0, False, 0.0, 0.0)]
    assert [d[1] for d in file.decisions] == ["8.10.1", "9.3.1"]


def test_structure_and_labels():
    file = reader.read(writer.from_text(TEXT, tagged=True, labels=[(1, "r", "", 1), (2, "D", "A-", 5)]))
    assert [(r["id"], r["parent"], r["tag"], r["alt"], r["page"]) for r in document.struct_rows(file)] == [(1, None, "Document", None, None), (2, 1, "P", "page 1", 1), (3, 1, "P", "page 2", 2), (4, 1, "P", "page 3", 3)]
    assert [(r["from_page"], r["style"], r["prefix"], r["start_at"]) for r in document.label_rows(file)] == [(1, "r", "", 1), (2, "D", "A-", 5)] and not file.decisions


def test_wide_text():
    text = "漢字 é\n한국 line\n\U00020000"
    assert lines(reader.read(writer.from_text(text))) == text


def test_object_keys_as_columns(spark):
    from pyspark.sql import functions as F

    key = bytes(range(16))
    row = spark.createDataFrame([(7, 0, b"secret text")], "num int, gen int, data binary").select(security.object_key_column(key, F.col("num"), F.col("gen"), True).alias("k"), "data")
    out = row.select("k", security.decrypt_aes(F.aes_encrypt("data", "k", F.lit("CBC"), F.lit("PKCS")), F.col("k")).alias("back")).first()
    assert bytes(out["k"]) == security.object_key(key, 7, 0, True, 4) and bytes(out["back"]) == b"secret text"


def test_frames_of_every_kind(spark):
    files = spark.createDataFrame([("a", writer.from_text(TEXT, links=2, outline=["x"])), ("b", None)], "path string, content binary")
    rows = parsed(files, list(SCHEMAS)).cache()
    counts = {k: frame(rows, k).count() for k in SCHEMAS}
    assert counts["files"] == 2 and counts["pages"] == 3 and counts["spans"] == 123 and counts["outline"] == 1 and counts["annotations"] == 2 and counts["decisions"] == 5
    with pytest.raises(ValueError):
        parsed(files, ["nothing"])


def test_data_source(spark, tmp_path):
    from pagefold.sources.datasource import register

    register(spark)
    files = spark.createDataFrame([(f"f{k}", writer.from_text(f"text {k}")) for k in range(3)], "name string, content binary")
    files.write.format("pdf").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["f0.pdf", "f1.pdf", "f2.pdf"]
    spans = spark.read.format("pdf").option("table", "spans").load(str(tmp_path / "out"))
    assert sorted(r["text"] for r in spans.collect()) == ["text 0", "text 1", "text 2"]
    from pagefold.sources.frames import read_pdf

    assert read_pdf(spark, str(tmp_path / "out"), ["pages"])["pages"].count() == 3


def test_predictors_of_png_rows():
    rng = random.Random(5)
    plain = bytes(rng.randrange(256) for _ in range(24))
    rows = [plain[k : k + 6] for k in range(0, 24, 6)]
    coded, before = b"", bytes(6)
    for k, row in enumerate(rows):
        kind = (0, 2, 3, 4)[k]
        line = []
        for i, x in enumerate(row):
            a, b, c = (row[i - 2] if i >= 2 else 0), before[i], (before[i - 2] if i >= 2 else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - {0: 0, 2: b, 3: (a + b) // 2, 4: near}[kind]) & 255)
        coded += bytes([kind, *line])
        before = row
    assert filters.predicted(coded, {"Predictor": 15, "Columns": 3, "Colors": 2}) == plain


FORM = {"AcroForm": {"Fields": [{"T": b"a", "Kids": [{"T": b"b", "V": b"old"}]}]}}
SAVES = {
    "Rotate": ({"degrees": 90, "pages": [2]}, lambda f: [r["rotate"] for r in document.page_rows(f)] == [0, 90, 0]),
    "Reorder": ({"from": 3, "to": 1}, lambda f: next(document.span_rows(f))["text"] == "line 97"),
    "RemovePages": ({"pages": [1, 9]}, lambda f: len(document.pages(f)) == 2 and [r["page"] for r in document.struct_rows(f)] == [None, None, 1, 2]),
    "SetPageLabels": ({"labels": [{"from_page": 2, "style": "r", "prefix": "x"}]}, lambda f: [(r["from_page"], r["style"], r["prefix"], r["start_at"]) for r in document.label_rows(f)] == [(2, "r", "x", 1)]),
    "UpdateStructElem": ({"id": 2, "alt": "ü", "tag": "H1"}, lambda f: [(r["tag"], r["alt"]) for r in document.struct_rows(f)][1] == ("H1", "ü")),
    "DeleteStructElem": ({"id": 3}, lambda f: [r["alt"] for r in document.struct_rows(f)] == [None, "page 1", "page 3"]),
    "UpdateArticleThreads": ({"threads": [{"pages": [1, 3]}]}, lambda f: f.get(f.get(f.get(f.resolve(document.catalog(f)["Threads"][0]), "F"), "N"), "P") is document.pages(f)[2][1]),
    "AddUserProperties": ({"id": 2, "properties": [{"name": "n", "value": 3}]}, lambda f: list(document.struct_elements(f))[1][3]["A"][0]["P"] == [{"N": b"n", "V": b"3"}]),
    "CreatePortfolio": ({"files": [{"name": "f", "data": "abc"}]}, lambda f: f.data(f.get(f.get(f.resolve(document.catalog(f)["Names"]["EmbeddedFiles"]["Names"][1]), "EF"), "F")) == b"abc"),
    "UpdateOutlines": ({"items": [{"title": "a", "children": [{"title": "b"}, {"title": "c"}]}, {"title": "漢", "page": 2}]}, lambda f: [(r["title"], r["parent"]) for r in document.outline_rows(f)] == [("a", None), ("b", 1), ("c", 1), ("漢", None)]),
    "UpdateLayers": ({"layers": [{"id": "l", "name": "n", "visible": False}]}, lambda f: f.get(f.resolve(document.catalog(f)["OCProperties"]["D"]["OFF"][0]), "Name") == b"n"),
    "AttachAssociatedFile": ({"name": "f", "relationship": "Data"}, lambda f: f.get(document.catalog(f)["AF"][0], "AFRelationship") == "Data"),
    "SetOutputIntent": ({"identifier": "sRGB"}, lambda f: document.catalog(f)["OutputIntents"][0]["OutputConditionIdentifier"] == b"sRGB"),
    "SetPronunciationLexicon": ({"data": "<x/>"}, lambda f: len(f.get(document.catalog(f), "StructTreeRoot")["PronunciationLexicon"]) == 1),
    "AddPageDecoration": ({"text": "stamp", "position": "TopLeft", "pages": 2}, lambda f: [(r["page"], r["x"], r["y"]) for r in document.span_rows(f) if r["text"] == "stamp"] == [(2, 24.0, 758.0)]),
    "ApplyBatesNumbering": ({"prefix": "A", "start": 9, "digits": 3}, lambda f: [r["text"] for r in document.span_rows(f) if r["text"].startswith("A0")] == ["A009", "A010", "A011"]),
    "AddAnnotation": ({"page": 3, "subtype": "Text", "contents": "note"}, lambda f: [(r["page"], r["subtype"]) for r in document.annotation_rows(f)] == [(1, "Link"), (3, "Text")]),
    "SetMeasurementScale": ({"page": 1, "scale": "1:2"}, lambda f: document.pages(f)[0][1]["VP"][0]["Measure"]["R"] == b"1:2"),
    "SetFormFieldValue": ({"name": "a.b", "value": "new"}, lambda f: [r["v"] for r in document.field_rows(f)] == [None, "new"]),
    "ExecuteAction": ({"action": "URI", "target": "x"}, lambda f: document.catalog(f)["OpenAction"] == {"S": "URI", "URI": b"x"}),
    "SetGeospatialAnchor": ({"page": 2, "latitude": 1, "longitude": 2}, lambda f: document.pages(f)[1][1]["VP"][0]["Measure"]["GPTS"] == [1.0, 2.0]),
    "AddMeshShading": ({"page": 1, "shading_type": 4}, lambda f: f.get(document.pages(f)[0][1]["Resources"]["Shading"], "Mesh0").dict["ShadingType"] == 4),
    "SetUnencryptedWrapper": ({"name": "w"}, lambda f: f.get(document.catalog(f)["AF"][0], "AFRelationship") == "EncryptedPayload"),
    "AddPublicKeyRecipient": ({"subject": "s"}, lambda f: document.catalog(f)["Encrypt"]["Recipients"] == [b"s"]),
    "UpdateMetadata": ({"title": "T & ü", "author": ""}, lambda f: [(r["title"], r["author"]) for r in document.metadata_rows(f)] == [("T & ü", None)] * 2),
    "Redact": ({"areas": [{"page": 2, "x1": 0, "y1": 719, "x2": 200, "y2": 725}]}, lambda f: "line 47" not in lines(f) and "line 46" in lines(f) and "line 48" in lines(f)),
}


@pytest.mark.parametrize("packed", [0, 4])
@pytest.mark.parametrize("name", sorted(SAVES))
def test_saved_operation(name, packed):
    file = reader.read(writer.from_text(TEXT, "old", packed=packed, links=1, tagged=True, in_form=False))
    plain = {n: x for n, (_, x) in file.objects.items() if not (isinstance(x, objects.Stream) and x.dict.get("Type") in ("XRef", "ObjStm"))}
    plain[1] |= FORM
    arguments, holds = SAVES[name]
    out = reader.read(saving.edited(writer.build(plain, 1, 4, packed=packed), [{"op": name} | arguments]))
    assert holds(out) and not out.decisions
    if name not in ("Reorder", "RemovePages", "Redact", "AddPageDecoration", "ApplyBatesNumbering"):
        assert lines(out) == TEXT


def test_all_operations_are_saved():
    from pagefold.operators.edits import OPERATIONS

    assert set(saving.SAVED) == set(SAVES) == set(OPERATIONS) | {"UpdateMetadata", "Redact"}
    whole = writer.from_text(TEXT, cipher=security.protect("AES-128", b"user"))
    for operations, password in (([{"op": "Nothing"}], b"user"), ([], b"wrong"), ([{"op": "Rotate", "degrees": 45}], b"user"), ([{"op": "SetFormFieldValue", "name": "x", "value": "y"}], b"user"), ([{"op": "DeleteStructElem", "id": 5}], b"user")):
        with pytest.raises(ValueError):
            saving.edited(whole, operations, password)
    again = reader.read(saving.edited(whole, [], b"owner", version="2.0", cipher=security.protect("AES-256-R5", b"new")), b"new")
    assert lines(again) == TEXT and again.version == "2.0" and not again.decisions


def test_redaction_in_forms():
    out = reader.read(saving.edited(writer.from_text("a\nb", in_form=True), [{"op": "Redact", "areas": [{"page": 1, "x1": 0, "y1": 719, "x2": 200, "y2": 725}]}]))
    assert lines(out) == "" and not out.decisions


def test_saved_files_of_a_frame(spark):
    rows = [(1, writer.from_text("a"), '[{"op": "Rotate", "degrees": 90}]'), (2, writer.from_text("b"), None), (3, b"junk", "[]"), (4, writer.from_text("c"), '[{"op": "X"}]'), (5, None, None)]
    found = {r["path"]: r for r in saving.save_edits(spark.createDataFrame(rows, "path int, content binary, steps string"), "steps").collect()}
    assert [found[k]["error"] is None for k in range(1, 6)] == [True, True, False, False, False]
    assert next(document.page_rows(reader.read(bytes(found[1]["content"]))))["rotate"] == 90 and bytes(found[3]["content"]) == b"junk"
