"""Edits that are saved: the operations of the edit vocabulary applied to a file's own objects, and the file written anew.

Each operation is a function of an ``Editor`` and its arguments, under the same name and with the same arguments as the transform of frames in
``operators.edits``. A file is one row's work, so a corpus is edited in one narrow pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .content import commands, serialize, spans
from .document import FIELDS, catalog, content_of, pages, struct_elements, text_of
from .filters import encode
from .objects import Name, Ref, Stream
from .reader import File, read
from .security import Cipher
from .writer import build

SAVED: dict[str, Callable[[Editor, dict[str, Any]], None]] = {}
#: Helvetica's size for what is put on a page, and the distance from the page's edge.
SIZE, EDGE = 10, 24


def text(x: Any) -> bytes:
    """A text string: Latin letters as they are, anything else in UTF-16 after its mark."""
    x = str(x)
    return x.encode("ascii") if x.isascii() else b"\xfe\xff" + x.encode("utf-16-be")


class Editor:
    """A file's objects while they are edited. Pages hang directly below the root of their tree and hold what they inherited."""

    def __init__(self, file: File):
        self.file = file
        self.objects = {n: x for n, (_, x) in file.objects.items() if not (isinstance(x, Stream) and x.dict.get("Type") in ("XRef", "ObjStm"))}
        own = file.trailer.get("Encrypt")
        if file.access and isinstance(own, Ref):
            self.objects.pop(own.num, None)
        if not catalog(file):
            raise ValueError("the file has no catalogue")
        root = file.trailer["Root"]
        self.root = root.num if isinstance(root, Ref) else self.add(root).num
        self.pages = []
        for num, page, held in pages(file):
            page = held | page
            self.pages.append(Ref(num, 0) if num else self.add(page))
            self.objects[self.pages[-1].num] = page

    @property
    def catalog(self) -> dict:
        return self.objects[self.root]

    def add(self, x: Any) -> Ref:
        number = max(self.objects, default=0) + 1
        self.objects[number] = x
        self.file.objects[number] = 0, x
        return Ref(number, 0)

    def page(self, ref: Ref) -> dict:
        return self.objects[ref.num]

    def chosen(self, selection: Any) -> list[Ref]:
        """Pages of a selection: "all", a number or a list of numbers, from 1; numbers beyond the last page choose nothing."""
        wanted = range(1, len(self.pages) + 1) if selection in (None, "all") else [selection] if isinstance(selection, int) else selection
        return [self.pages[k - 1] for k in wanted if 1 <= k <= len(self.pages)]

    def own(self, holder: dict, key: str, kind: type) -> Any:
        """A container that only this holder refers to, so it may be changed."""
        x = self.file.resolve(holder.get(key))
        holder[key] = kind(x) if isinstance(x, kind) else kind()
        return holder[key]

    def write(self, version: str | None = None, cipher: Cipher | None = None) -> bytes:
        tree = self.add({"Type": Name("Pages"), "Kids": self.pages, "Count": len(self.pages)})
        for ref in self.pages:
            self.page(ref)["Parent"] = tree
        self.catalog["Pages"] = tree
        info = self.file.trailer.get("Info")
        return build(self.objects, self.root, info.num if isinstance(info, Ref) else None, version or self.file.version, cipher=cipher)


def saved(f: Callable[[Editor, dict[str, Any]], None]):
    SAVED["".join(w.capitalize() for w in f.__name__.split("_"))] = f
    return f


def edited(content: bytes, operations: list[dict[str, Any]], password: bytes = b"", version: str | None = None, cipher: Cipher | None = None) -> bytes:
    """The file with the operations ({"op": name, ...}) applied in turn. An encrypted file is opened, and written with the cipher or plain."""
    file = read(content, password)
    if "Encrypt" in file.trailer and not file.access:
        raise ValueError("the file can't be opened")
    editor = Editor(file)
    for given in operations:
        name = given.get("op")
        if name not in SAVED:
            raise ValueError(f"no such operation: {name}")
        SAVED[name](editor, {k: v for k, v in given.items() if k != "op"})
    return editor.write(version, cipher)


def save_edits(files: DataFrame, operations: str, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(id, content, error) of files after the operations that a column gives as JSON: a list, or null for none.

    A file that can't be edited keeps its content, and error says why.
    """

    @F.pandas_udf("content binary, error string")
    def save(contents: pd.Series, listed: pd.Series) -> pd.DataFrame:
        rows = []
        for content, given in zip(contents, listed, strict=True):
            try:
                rows.append((edited(bytes(content or b""), json.loads(given or "[]")), None))
            except (ValueError, KeyError, TypeError) as e:
                rows.append((content, str(e)))
        return pd.DataFrame(rows, columns=["content", "error"])

    return files.select(id_col, save(F.col(content_col), F.col(operations)).alias("x")).select(id_col, "x.content", "x.error")


@saved
def rotate(e, a):
    for ref in e.chosen(a.get("pages")):
        before = e.file.resolve(e.page(ref).get("Rotate")) or 0
        turned = (before if a.get("relative", True) else 0) + a["degrees"]
        if turned % 90:
            raise ValueError("pages turn by quarters")
        e.page(ref)["Rotate"] = turned % 360


@saved
def reorder(e, a):
    if 1 <= a["from"] <= len(e.pages):
        e.pages.insert(a["to"] - 1, e.pages.pop(a["from"] - 1))


@saved
def remove_pages(e, a):
    """Also takes the page from structure elements that stood on it."""
    gone = set(e.chosen(a["pages"]))
    e.pages = [x for x in e.pages if x not in gone]
    for x in e.objects.values():
        if isinstance(x, dict) and x.get("Pg") in gone:
            del x["Pg"]
    for x in gone:
        del e.objects[x.num]


@saved
def set_page_labels(e, a):
    own = [(x["from_page"] - 1, {"S": Name(x["style"])} if x.get("style") else {}, x) for x in sorted(a["labels"], key=lambda x: x["from_page"])]
    e.catalog["PageLabels"] = {"Nums": [y for at, d, x in own for y in (at, d | ({"P": text(x["prefix"])} if x.get("prefix") else {}) | {"St": x.get("start_at", 1)})]}


def _element(e: Editor, number: int) -> dict:
    found = next((d for n, _, _, d in struct_elements(e.file) if n == number), None)
    if found is None:
        raise ValueError(f"no structure element {number}")
    return found


@saved
def update_struct_elem(e, a):
    d = _element(e, a["id"])
    if a.get("tag") is not None:
        d["S"] = Name(a["tag"])
    if a.get("alt") is not None:
        d["Alt"] = text(a["alt"])


@saved
def delete_struct_elem(e, a):
    d = _element(e, a["id"])
    for holder in [e.file.get(e.catalog, "StructTreeRoot"), *(x for _, _, _, x in struct_elements(e.file))]:
        kids = e.file.resolve(holder.get("K"))
        listed = kids if isinstance(kids, list) else [holder.get("K")]
        if any(e.file.resolve(k) is d for k in listed):
            holder["K"] = [k for k in listed if e.file.resolve(k) is not d]


@saved
def update_article_threads(e, a):
    threads = []
    for t in a["threads"]:
        thread = e.add({"Type": Name("Thread"), "I": {"Title": text(t.get("title", ""))}})
        beads = [e.add({"Type": Name("Bead"), "T": thread, "P": page, "R": e.file.resolve(e.page(page).get("MediaBox")) or [0, 0, 612, 792]}) for page in e.chosen(t["pages"])]
        for k, bead in enumerate(beads):
            e.objects[bead.num] |= {"N": beads[(k + 1) % len(beads)], "V": beads[k - 1]}
        if beads:
            e.objects[thread.num]["F"] = beads[0]
        threads.append(thread)
    e.catalog["Threads"] = threads


@saved
def add_user_properties(e, a):
    d = _element(e, a["id"])
    before = e.file.resolve(d.get("A"))
    new = {"O": Name("UserProperties"), "P": [{"N": text(x["name"]), "V": text(x["value"])} for x in a["properties"]]}
    d["A"] = [*(before if isinstance(before, list) else [] if before is None else [before]), new]


def _attach(e: Editor, name: str, description: str | None, relationship: str, data: bytes = b"") -> Ref:
    stored = e.add(Stream({"Type": Name("EmbeddedFile"), "Filter": Name("FlateDecode"), "Params": {"Size": len(data)}}, encode(data, "FlateDecode")))
    spec = e.add({"Type": Name("Filespec"), "F": text(name), "UF": text(name), "EF": {"F": stored}, "AFRelationship": Name(relationship)} | ({"Desc": text(description)} if description else {}))
    tree = e.own(e.own(e.catalog, "Names", dict), "EmbeddedFiles", dict)
    names = e.own(tree, "Names", list)
    names += [text(name), spec]
    pairs = sorted(zip(names[::2], names[1::2], strict=True), key=lambda x: x[0])
    tree["Names"] = [y for x in pairs for y in x]
    return spec


@saved
def create_portfolio(e, a):
    e.catalog["Collection"] = {"Type": Name("Collection"), "View": Name("D")}
    for x in a["files"]:
        _attach(e, x["name"], x.get("description"), "Unspecified", x.get("data", "").encode())


@saved
def update_outlines(e, a):
    """Replaces the outline; no items removes it."""

    def level(items: list[dict], parent: Ref) -> list[Ref]:
        refs = [e.add({"Title": text(x["title"]), "Parent": parent}) for x in items]
        for k, (ref, x) in enumerate(zip(refs, items, strict=True)):
            d = e.objects[ref.num]
            if k:
                d["Prev"] = refs[k - 1]
            if k + 1 < len(refs):
                d["Next"] = refs[k + 1]
            if x.get("page") and e.chosen(x["page"]):
                d["Dest"] = [e.chosen(x["page"])[0], Name("Fit")]
            if own := level(x.get("children", []), ref):
                d |= {"First": own[0], "Last": own[-1], "Count": len(own)}
        return refs

    e.catalog.pop("Outlines", None)
    if a["items"]:
        root = e.add({"Type": Name("Outlines")})
        refs = level(a["items"], root)
        e.objects[root.num] |= {"First": refs[0], "Last": refs[-1], "Count": len(refs)}
        e.catalog["Outlines"] = root


@saved
def update_layers(e, a):
    refs = [(e.add({"Type": Name("OCG"), "Name": text(x["name"]), "Usage": {"Print": {"PrintState": Name("ON" if x.get("printable", True) else "OFF")}}} | ({"ID": text(x["id"])} if x.get("id") else {})), x) for x in a["layers"]]
    e.catalog["OCProperties"] = {"OCGs": [r for r, _ in refs], "D": {"Order": [r for r, _ in refs], "OFF": [r for r, x in refs if not x.get("visible", True)]}}


@saved
def attach_associated_file(e, a):
    e.own(e.catalog, "AF", list).append(_attach(e, a["name"], a.get("description"), a.get("relationship", "Unspecified"), a.get("data", "").encode()))


@saved
def set_output_intent(e, a):
    e.catalog["OutputIntents"] = [{"Type": Name("OutputIntent"), "S": Name(a.get("subtype", "GTS_PDFA1")), "OutputConditionIdentifier": text(a["identifier"])}]


@saved
def set_pronunciation_lexicon(e, a):
    tree = e.file.get(e.catalog, "StructTreeRoot")
    if not isinstance(tree, dict):
        tree = e.objects[e.add({"Type": Name("StructTreeRoot"), "K": []}).num]
        e.catalog["StructTreeRoot"] = tree
    tree["PronunciationLexicon"] = [_attach(e, "lexicon.pls", None, "Supplement", a["data"].encode())]


def _draw(e: Editor, ref: Ref, words: str, position: str) -> None:
    page, box = e.page(ref), [float(e.file.resolve(v)) for v in e.file.resolve(e.page(ref).get("MediaBox")) or [0, 0, 612, 792]]
    resources = e.own(page, "Resources", dict)
    e.own(resources, "Font", dict)["Decoration"] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
    width = SIZE * 0.5 * len(words)
    x = box[0] + EDGE if "Left" in position else box[2] - EDGE - width if "Right" in position else (box[0] + box[2] - width) / 2
    y = box[3] - EDGE - SIZE if position.startswith("Top") else box[1] + EDGE
    drawn = serialize([("q", []), ("BT", []), ("Tf", [Name("Decoration"), SIZE]), ("Tm", [1, 0, 0, 1, x, y]), ("Tj", [words.encode("cp1252", "replace")]), ("ET", []), ("Q", [])])
    before = e.file.resolve(page.get("Contents"))
    listed = before if isinstance(before, list) else [page["Contents"]] if "Contents" in page else []
    # what was there may leave its state changed
    page["Contents"] = [e.add(Stream({}, b"q")), *listed, e.add(Stream({}, b"Q\n" + drawn))]


@saved
def add_page_decoration(e, a):
    for ref in e.chosen(a.get("pages")):
        _draw(e, ref, a["text"], a["position"])


@saved
def apply_bates_numbering(e, a):
    for k, ref in enumerate(e.chosen(a.get("pages"))):
        _draw(e, ref, f"{a['prefix']}{str(a['start'] + k).zfill(a['digits'])}", a.get("position", "BottomRight"))


@saved
def add_annotation(e, a):
    for ref in e.chosen(a["page"]):
        e.own(e.page(ref), "Annots", list).append(e.add({"Type": Name("Annot"), "Subtype": Name(a["subtype"]), "Rect": a.get("rect", [0, 0, 0, 0]), "P": ref} | ({"Contents": text(a["contents"])} if a.get("contents") else {})))


def _viewport(e: Editor, selection: Any, measure: dict) -> None:
    for ref in e.chosen(selection):
        e.own(e.page(ref), "VP", list).append({"Type": Name("Viewport"), "BBox": e.file.resolve(e.page(ref).get("MediaBox")) or [0, 0, 612, 792], "Measure": measure})


@saved
def set_measurement_scale(e, a):
    _viewport(e, a["page"], {"Type": Name("Measure"), "Subtype": Name("RL"), "R": text(a["scale"])})


@saved
def set_geospatial_anchor(e, a):
    _viewport(e, a["page"], {"Type": Name("Measure"), "Subtype": Name("GEO"), "GPTS": [float(a["latitude"]), float(a["longitude"])]})


@saved
def set_form_field_value(e, a):
    """By qualified name."""

    def visit(refs: list, before: str) -> bool:
        for x in refs:
            d = e.file.resolve(x)
            if not isinstance(d, dict):
                continue
            own = text_of(e.file.resolve(d.get("T")))
            name = ".".join(n for n in (before, own) if n)
            if name == a["name"] and own:
                d["V"] = text(a["value"])
                return True
            if visit(e.file.get(d, "Kids") or [], name):
                return True
        return False

    if not visit(e.file.get(e.file.get(e.catalog, "AcroForm"), "Fields") or [], ""):
        raise ValueError(f"no such field: {a['name']}")


@saved
def execute_action(e, a):
    """Sets what opening the document does; nothing runs here."""
    e.catalog["OpenAction"] = {"S": Name(a["action"])} | ({("URI" if a["action"] == "URI" else "N" if a["action"] == "Named" else "D"): text(a["target"])} if a.get("target") else {})


@saved
def add_mesh_shading(e, a):
    if a["shading_type"] not in (4, 5, 6, 7):
        raise ValueError("mesh shadings are of types 4 to 7")
    mesh = {"ShadingType": a["shading_type"], "ColorSpace": Name("DeviceRGB"), "BitsPerCoordinate": 8, "BitsPerComponent": 8, "Decode": [0, 1, 0, 1, 0, 1, 0, 1, 0, 1]}
    for ref in e.chosen(a["page"]):
        held = e.own(e.own(e.page(ref), "Resources", dict), "Shading", dict)
        held[f"Mesh{len(held)}"] = e.add(Stream(mesh | ({"VerticesPerRow": 2} if a["shading_type"] == 5 else {"BitsPerFlag": 8}), bytes.fromhex(a.get("data", ""))))


@saved
def set_unencrypted_wrapper(e, a):
    e.own(e.catalog, "AF", list).append(_attach(e, a["name"], a.get("description"), "EncryptedPayload", a.get("data", "").encode()))
    e.catalog["Collection"] = {"Type": Name("Collection"), "D": text(a["name"]), "View": Name("H")}


@saved
def add_public_key_recipient(e, a):
    """Names a recipient in the catalogue; nothing is encrypted, since no certificate can be used here."""
    entry = e.own(e.catalog, "Encrypt", dict)
    entry |= {"Filter": Name("Adobe.PubSec"), "Recipients": [*(entry.get("Recipients") or []), text(a["subject"])]}


@saved
def update_metadata(e, a):
    """Sets fields of the information dictionary and writes all of them to a metadata stream, too."""
    given = e.file.trailer.get("Info")
    info = dict(e.file.resolve(given) or {}) if given is not None else {}
    for field, key, _ in FIELDS:
        if field in a:
            info.pop(key, None)
            if a[field]:
                info[key] = text(a[field])
    if isinstance(given, Ref):
        e.objects[given.num] = info
    else:
        e.file.trailer["Info"] = e.add(info)
    marked = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    values = "".join(f"<x:{tag}>{marked(v)}</x:{tag}>" for _, key, tag in FIELDS if (v := text_of(e.file.resolve(info.get(key)))))
    packet = f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:x="http://ns.adobe.com/pdf/1.3/">{values}</rdf:Description></rdf:RDF>'
    e.catalog["Metadata"] = e.add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, packet.encode("utf-8", "replace")))


@saved
def redact(e, a):
    """Takes text from the pages' own content where it meets an area (page, x1, y1, x2, y2); a form that shows such text goes whole."""
    for number, ref in enumerate(list(e.pages), 1):
        areas = [x for x in a["areas"] if x["page"] == number]
        if not areas:
            continue
        page = e.page(ref)
        resources, data = e.file.resolve(page.get("Resources")), content_of(e.file, page)
        hit = {}
        for index, _, size, _, x, y, width in spans(e.file, data, resources):
            if any(x < z["x2"] and x + width > z["x1"] and y < z["y2"] and y + size > z["y1"] for z in areas):
                hit[index] = width / size if size else 0
        out, at = [], 1
        for op, operands in commands(data):
            inner = _operators(e.file, op, operands, resources, 0)
            lost = [k for k in range(at, at + inner + 1) if k in hit]
            if lost and op in ("Tj", "TJ"):
                out.append(("TJ", [[-1000 * hit[at]]]))  # what follows on the line stays where it was
            elif not lost:
                out.append((op, operands))
            at += inner + 1
        page["Contents"] = e.add(Stream({}, serialize(out)))


def _operators(file: File, op: str, operands: list, resources: Any, depth: int) -> int:
    """Operators that a form brings in where it is placed."""
    form = file.resolve((file.get(resources, "XObject") or {}).get(str(operands[0]))) if op == "Do" and operands else None
    if not isinstance(form, Stream) or file.resolve(form.dict.get("Subtype")) != "Form" or depth >= 16:
        return 0
    own = file.get(form, "Resources") or resources
    return sum(1 + _operators(file, x, y, own, depth + 1) for x, y in commands(file.data(form)))
