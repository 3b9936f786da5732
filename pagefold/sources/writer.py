"""Writing files: objects, a cross-reference table or stream, object streams, and updates that are appended."""

from __future__ import annotations

from typing import Any

from .filters import encode
from .objects import Name, Ref, Stream, write
from .security import Cipher


def build(objects: dict[int, Any], root: int, info: int | None = None, version: str = "1.7", packed: int = 0, extra: dict | None = None, cipher: Cipher | None = None) -> bytes:
    """A file of the objects. packed: so many objects a container, with a cross-reference stream; 0 writes a classic table. cipher encrypts it."""
    locked = lambda x, n: cipher.apply(x, n, 0, back=False) if cipher else x
    if cipher:
        extra = (extra or {}) | {"Encrypt": cipher.entry, "ID": [cipher.file_id, cipher.file_id]}
    out = bytearray(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % version.encode())
    offsets: dict[int, tuple[str, int, int]] = {}
    plain = sorted(n for n, x in objects.items() if not packed or isinstance(x, Stream))
    for n in plain:
        offsets[n] = ("in_file", len(out), 0)
        out += b"%d 0 obj\n" % n + write(locked(objects[n], n)) + b"\nendobj\n"
    trailer: dict[str, Any] = {"Root": Ref(root, 0)} | ({"Info": Ref(info, 0)} if info else {}) | (extra or {})
    number = max(objects) + 1
    if not packed:
        return bytes(out) + _table(offsets, trailer | {"Size": number}, len(out))
    rest = sorted(set(objects) - set(plain))
    for at in range(0, len(rest), packed):
        part, head, body = rest[at : at + packed], b"", b""
        for k, n in enumerate(part):
            head += b"%d %d " % (n, len(body))
            body += write(objects[n]) + b" "
            offsets[n] = ("in_stream", number, k)
        offsets[number] = ("in_file", len(out), 0)
        container = Stream({"Type": Name("ObjStm"), "N": len(part), "First": len(head), "Filter": Name("FlateDecode")}, encode(head + body, "FlateDecode"))
        out += b"%d 0 obj\n" % number + write(locked(container, number)) + b"\nendobj\n"
        number += 1
    offsets[number] = ("in_file", at := len(out), 0)
    rows = b"".join(bytes([2 if kind == "in_stream" else 1 if kind == "in_file" else 0]) + a.to_bytes(5, "big") + b.to_bytes(2, "big") for kind, a, b in (offsets.get(n, ("free", 0, 0)) for n in range(number + 1)))
    xref = Stream({"Type": Name("XRef"), "Size": number + 1, "W": [1, 5, 2], "Filter": Name("FlateDecode")} | trailer, encode(rows, "FlateDecode"))
    return bytes(out) + b"%d 0 obj\n" % number + write(xref) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at


def _table(offsets: dict[int, tuple[str, int, int]], trailer: dict, at: int) -> bytes:
    out = b"xref\n"
    numbers = sorted({0, *offsets}) if "Prev" not in trailer else sorted(offsets)
    runs: list[list[int]] = []
    for n in numbers:
        if runs and runs[-1][-1] == n - 1:
            runs[-1].append(n)
        else:
            runs.append([n])
    for run in runs:
        out += b"%d %d\n" % (run[0], len(run)) + b"".join(b"%010d 00000 n \n" % offsets[n][1] if n in offsets else b"0000000000 65535 f \n" for n in run)
    return out + b"trailer\n" + write(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at


def update(data: bytes, changed: dict[int, Any], root: int, size: int, previous: int) -> bytes:
    """The file with changed objects appended and a section that names the previous one."""
    out, offsets = bytearray(data), {}
    for n, x in sorted(changed.items()):
        offsets[n] = ("in_file", len(out), 0)
        out += b"%d 0 obj\n" % n + write(x) + b"\nendobj\n"
    return bytes(out) + _table(offsets, {"Root": Ref(root, 0), "Size": size, "Prev": previous}, len(out))


def unicode_map(characters: list[str]) -> bytes:
    """A character map of two-byte codes: 1 for the first character and so on."""
    out = [b"1 begincodespacerange <0000> <FFFF> endcodespacerange"]
    for at in range(0, len(characters), 100):
        part = characters[at : at + 100]
        out += [b"%d beginbfchar" % len(part), *(b"<%04X> <%s>" % (at + k, c.encode("utf-16-be").hex().encode()) for k, c in enumerate(part, 1)), b"endbfchar"]
    return b"\n".join(out)


def from_text(
    text: str, title: str = "", lines: int = 50, filter_name: str | None = "FlateDecode", packed: int = 0, outline: list[str] | None = None, links: int = 0,
    labels: list[tuple[int, str, str, int]] | None = None, tagged: bool = False, in_form: bool = False, cipher: Cipher | None = None,
) -> bytes:
    """A document of lines of text, so many a page, with optional outline items and link annotations to named destinations.

    labels: (page from 1, style, prefix, number of the first). tagged: a structure tree with a paragraph for each page. in_form: a page only
    places a form that shows its text, in a font that a graphics state sets. cipher encrypts the file.
    """
    parts = text.split("\n")
    wide = sorted(set(text)) if max(text, default="") > "\xff" else []
    code = {c: k.to_bytes(2, "big") for k, c in enumerate(wide, 1)}
    coded = (lambda x: b"".join(code[c] for c in x)) if wide else (lambda x: x.encode("latin-1", "replace"))
    objects: dict[int, Any] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}, 4: {"Title": b"\xfe\xff" + title.encode("utf-16-be")}}
    number, kids = 5, []
    if wide:
        objects[3] = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Helvetica"), "Encoding": Name("Identity-H"), "ToUnicode": Ref(5, 0), "DescendantFonts": [{"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Helvetica"), "DW": 1000}]}
        objects[5], number = Stream({}, unicode_map(wide)), 6
    for at in range(0, len(parts), lines):
        body = [b"/G1 gs", b"BT"] if in_form else [b"BT", b"/F1 12 Tf"]
        for k, line in enumerate(parts[at : at + lines]):
            body.append(b"1 0 0 1 72 %d Tm " % (720 - 13 * k) + write(coded(line)) + b" Tj")
        data = b"\n".join([*body, b"ET"])
        objects[number + 1] = Stream({"Filter": Name(filter_name)}, encode(data, filter_name)) if filter_name else Stream({}, data)
        objects[number] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(number + 1, 0)}
        kids.append(Ref(number, 0))
        if in_form:
            form = objects[number + 1]
            form.dict.update({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 612, 792], "Matrix": [1, 0, 0, 1, 0, 0], "Resources": {"ExtGState": {"G1": {"Font": [Ref(3, 0), 12]}}}})
            objects[number + 2] = Stream({}, b"q 1 0 0 1 0 0 cm /X1 Do Q")
            objects[number] |= {"Contents": Ref(number + 2, 0), "Resources": {"XObject": {"X1": Ref(number + 1, 0)}}}
        number += 3 if in_form else 2
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": Ref(3, 0)}}}
    if links:
        objects[kids[0].num]["Annots"] = [{"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [0, 0, 10, 10], "Dest": b"d%d" % k} for k in range(links)]
        objects[1]["Names"] = {"Dests": {"Names": [x for k in range(0, links, 2) for x in (b"d%d" % k, [kids[k % len(kids)], Name("Fit")])]}}
    if labels:
        objects[1]["PageLabels"] = {"Nums": [x for page, style, prefix, start in labels for x in (page - 1, {"S": Name(style), "P": prefix.encode("latin-1"), "St": start})]}
    if tagged:
        objects[1] |= {"StructTreeRoot": Ref(number, 0), "MarkInfo": {"Marked": True}, "Lang": b"en"}
        objects[number] = {"Type": Name("StructTreeRoot"), "K": Ref(number + 1, 0), "RoleMap": {"Absatz": Name("P")}}
        objects[number + 1] = {"Type": Name("StructElem"), "S": Name("Document"), "P": Ref(number, 0), "K": [Ref(number + 2 + k, 0) for k in range(len(kids))]}
        for k, page in enumerate(kids):
            objects[number + 2 + k] = {"Type": Name("StructElem"), "S": Name("Absatz" if k % 2 else "P"), "P": Ref(number + 1, 0), "Pg": page, "K": [0], "Alt": b"page %d" % (k + 1)}
        number += 2 + len(kids)
    if outline:
        first = number + 1
        objects[number] = {"Type": Name("Outlines"), "First": Ref(first, 0), "Last": Ref(first + len(outline) - 1, 0), "Count": len(outline)}
        objects[1]["Outlines"] = Ref(number, 0)
        for k, item in enumerate(outline):
            objects[first + k] = {"Title": b"\xfe\xff" + item.encode("utf-16-be"), "Parent": Ref(number, 0)} | ({"Next": Ref(first + k + 1, 0)} if k + 1 < len(outline) else {})
    return build(objects, 1, 4, packed=packed, cipher=cipher)
