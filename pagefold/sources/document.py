"""The document layer: pages, annotations, fields, outline, names and metadata as rows of one file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

from ..functions.text import PDF_DOC_CHARS, PDF_DOC_CODES
from .content import commands, spans
from .filters import FilterError, filters_of
from .objects import Name, Ref, Stream, kind_of
from .reader import File

INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
DEPTH = {"pages": 32, "form": 64, "outline": 64, "names": 32, "structure": 64}
OUTLINE_ITEMS = 100_000


def text_of(x: Any) -> str | None:
    """A text string's characters."""
    if not isinstance(x, bytes):
        return str(x) if isinstance(x, Name) else None
    if x.startswith(b"\xfe\xff"):
        return x[2:].decode("utf-16-be", "replace")
    if x.startswith(b"\xff\xfe"):
        return x[2:].decode("utf-16-le", "replace")
    if x.startswith(b"\xef\xbb\xbf"):
        return x[3:].decode("utf-8", "replace")
    return x.decode("latin-1").translate(dict(zip(PDF_DOC_CODES, PDF_DOC_CHARS, strict=True)))


def catalog(file: File) -> dict:
    root = file.resolve(file.trailer.get("Root"))
    return root if isinstance(root, dict) else {}


def pages(file: File) -> list[tuple[int, dict, dict]]:
    """(object number, page, inherited attributes) in reading order; a cycle or too deep a tree ends there."""
    if file.pages is not None:
        return file.pages
    out, seen = [], set()

    def walk(x: Any, held: dict, depth: int) -> None:
        num = x.num if isinstance(x, Ref) else 0
        node = file.resolve(x)
        if not isinstance(node, dict) or num in seen:
            return
        if depth > DEPTH["pages"]:
            file.decide(1, "7.7.3.2", f"page tree node {num} lies too deep", "left out what hangs below")
            return
        if num:
            seen.add(num)
        held = held | {k: node[k] for k in INHERITED if k in node}
        kids = file.resolve(node.get("Kids"))
        if isinstance(kids, list):
            for kid in kids:
                walk(kid, held, depth + 1)
        elif node.get("Type") == "Page":
            out.append((num, node, held))

    if "Pages" not in catalog(file):
        file.decide(2, "7.7.3.2", "no /Pages in the catalogue", "gave no pages")
    walk(catalog(file).get("Pages"), {}, 0)
    file.pages = out
    return out


def content_of(file: File, page: dict) -> bytes:
    """A page's content, parts joined by new lines."""
    x = file.resolve(page.get("Contents"))
    return b"\n".join(file.data(part) for part in (x if isinstance(x, list) else [x]))


def page_rows(file: File) -> Iterator[dict]:
    for n, (num, _, held) in enumerate(pages(file), 1):
        box = lambda k, held=held: [float(v) for v in map(file.resolve, file.resolve(held.get(k)) or []) if isinstance(v, (int, float))] or None
        rotate = file.resolve(held.get("Rotate"))
        yield {"page": n, "obj_num": num, "media_box": box("MediaBox"), "crop_box": box("CropBox"), "rotate": rotate if isinstance(rotate, int) else 0}


def span_rows(file: File) -> Iterator[dict]:
    for n, (_, page, held) in enumerate(pages(file), 1):
        try:
            for op, text, size, bold, x, y, width in spans(file, content_of(file, page), file.resolve(held.get("Resources")), file.decide):
                yield {"page": n, "op_index": op, "text": text, "font_size": size, "is_bold": bold, "x": x, "y": y, "width": width, "error": None}
        except (FilterError, RecursionError) as e:  # one page that fails doesn't stop the rest
            yield {"page": n, "op_index": 0, "text": None, "font_size": None, "is_bold": None, "x": None, "y": None, "width": None, "error": str(e)}


def command_rows(file: File) -> Iterator[dict]:
    for n, (_, page, _) in enumerate(pages(file), 1):
        try:
            for k, (op, operands) in enumerate(commands(content_of(file, page), file.decide), 1):
                yield {"page": n, "op_index": k, "op": op, "operands": len(operands)}
        except FilterError:
            continue


def annotation_rows(file: File) -> Iterator[dict]:
    for n, (_, page, _) in enumerate(pages(file), 1):
        for k, x in enumerate(file.resolve(page.get("Annots")) or []):
            a = file.resolve(x)
            if not isinstance(a, dict):
                continue
            action = file.get(a, "A")
            dest = file.resolve(a.get("Dest")) if "Dest" in a else file.get(action, "D")
            kind = "name" if isinstance(dest, Name) else "string" if isinstance(dest, bytes) else "inline" if dest is not None else None
            yield {
                "page": n, "pos": k, "subtype": str(file.get(a, "Subtype") or ""), "keys": sorted(a), "rect": [float(v) for v in file.get(a, "Rect") or [] if isinstance(v, (int, float))],
                "flags": file.get(a, "F"), "action": str(file.get(action, "S") or "") or None, "dest_kind": kind, "dest_key": str(dest) if kind == "name" else dest.decode("latin-1") if kind == "string" else None,
            }


def _name_tree(file: File, node: Any, depth: int = 0) -> Iterator[tuple[bytes, Any]]:
    node = file.resolve(node)
    if not isinstance(node, dict):
        return
    if depth > DEPTH["names"]:
        file.decide(1, "7.9.6", "a name tree nests too deep", "left out what lies deeper")
        return
    names = file.get(node, "Names") or []
    yield from zip(names[::2], names[1::2], strict=False)
    for kid in file.get(node, "Kids") or []:
        yield from _name_tree(file, kid, depth + 1)


def destination_rows(file: File) -> Iterator[dict]:
    """Named destinations of both key spaces: names of /Dests and byte strings of the name tree."""
    numbers = {num: n for n, (num, _, _) in enumerate(pages(file), 1)}

    def row(kind: str, key: str, x: Any) -> dict:
        x = file.resolve(x)
        x = file.get(x, "D") if isinstance(x, dict) else x
        target = x[0] if isinstance(x, list) and x else None
        page = numbers.get(target.num) if isinstance(target, Ref) else target + 1 if isinstance(target, int) else None
        return {"key_kind": kind, "key": key, "page": page, "view": str(x[1]) if isinstance(x, list) and len(x) > 1 and isinstance(x[1], Name) else None}

    for key, x in (file.get(catalog(file), "Dests") or {}).items():
        yield row("name", key, x)
    for key, x in _name_tree(file, file.get(file.get(catalog(file), "Names"), "Dests")):
        if isinstance(key, bytes):
            yield row("string", key.decode("latin-1"), x)


def _tree_rows(file: File, roots: Any, kids_of, depth: int, limit: int) -> Iterator[tuple[int, int | None, int, dict]]:
    """(node, parent, pos, dictionary) of trees, a number for each node in reading order."""
    todo, seen, n = [(x, None, k, 0) for k, x in reversed(list(enumerate(roots)))], set(), 0
    while todo and n < limit:
        x, parent, pos, level = todo.pop()
        d = file.resolve(x)
        if not isinstance(d, dict) or isinstance(x, Ref) and x.num in seen:
            continue
        if level > depth:
            file.decide(1, "7.3.10", f"a tree goes deeper than {depth} levels", "left out what lies deeper")
            continue
        if isinstance(x, Ref):
            seen.add(x.num)
        n += 1
        yield n, parent, pos, d
        todo += [(kid, n, k, level + 1) for k, kid in reversed(list(enumerate(kids_of(d))))]
    if todo:
        file.decide(1, "12.3.3", f"a tree has more than {limit} items", "left out the others")


def field_rows(file: File) -> Iterator[dict]:
    form = file.get(catalog(file), "AcroForm")
    for n, parent, pos, d in _tree_rows(file, file.get(form, "Fields") or [], lambda d: file.get(d, "Kids") or [], DEPTH["form"], 1 << 30):
        ft, ff, v = file.get(d, "FT"), file.get(d, "Ff"), file.get(d, "V")
        yield {"node": n, "parent": parent, "pos": pos, "t": text_of(file.get(d, "T")), "ft": str(ft) if ft else None, "ff": ff if isinstance(ff, int) else None, "v": text_of(v), "has_da": "DA" in d}


def outline_rows(file: File) -> Iterator[dict]:
    def chain(d: dict) -> list:
        out, x, seen = [], d.get("First"), set()
        while isinstance(x, Ref) and x.num not in seen and len(out) < OUTLINE_ITEMS:
            seen.add(x.num)
            out.append(x)
            x = (file.resolve(x) or {}).get("Next") if isinstance(file.resolve(x), dict) else None
        return out

    root = file.get(catalog(file), "Outlines")
    for n, parent, pos, d in _tree_rows(file, chain(root) if isinstance(root, dict) else [], chain, DEPTH["outline"], OUTLINE_ITEMS):
        count = file.get(d, "Count")
        yield {"node": n, "parent": parent, "pos": pos, "title": text_of(file.get(d, "Title")), "count": count if isinstance(count, int) else 0}


def struct_elements(file: File) -> Iterator[tuple[int, int | None, int, dict]]:
    """(number, parent, pos, element) of the structure tree in reading order; marked content is no element."""

    def kids(d: dict) -> list:
        x = d.get("K")
        x = file.resolve(x) if isinstance(file.resolve(x), list) else [x]
        return [k for k in x if isinstance(file.resolve(k), dict) and "S" in file.resolve(k)]

    root = file.get(catalog(file), "StructTreeRoot")
    if isinstance(root, dict):
        yield from _tree_rows(file, kids(root), kids, DEPTH["structure"], 1 << 30)


def struct_rows(file: File) -> Iterator[dict]:
    """Structure elements with their standard roles and the pages they are on."""
    roles = file.get(file.get(catalog(file), "StructTreeRoot"), "RoleMap") or {}
    numbers = {num: n for n, (num, _, _) in enumerate(pages(file), 1)}
    on: dict[int, Any] = {}
    for n, parent, pos, d in struct_elements(file):
        on[n] = numbers.get(d["Pg"].num) if isinstance(d.get("Pg"), Ref) else on.get(parent)
        tag, seen = file.get(d, "S"), set()
        while tag in roles and tag not in seen:
            seen.add(tag)
            tag = file.resolve(roles[tag])
        yield {"id": n, "parent": parent, "pos": pos, "tag": str(tag), "title": text_of(file.get(d, "T")), "alt": text_of(file.get(d, "Alt")), "lang": text_of(file.get(d, "Lang")), "page": on[n], "page_lost": "Pg" in d and on[n] is None}


def _number_tree(file: File, node: Any, depth: int = 0) -> Iterator[tuple[int, Any]]:
    node = file.resolve(node)
    if not isinstance(node, dict):
        return
    if depth > DEPTH["names"]:
        file.decide(1, "7.9.7", "a number tree nests too deep", "left out what lies deeper")
        return
    numbers = file.get(node, "Nums") or []
    for k, x in zip(numbers[::2], numbers[1::2], strict=False):
        if isinstance(k, int):
            yield k, x
    for kid in file.get(node, "Kids") or []:
        yield from _number_tree(file, kid, depth + 1)


def label_rows(file: File) -> Iterator[dict]:
    """Ranges of page labels, from the first page they hold for, counted from 1."""
    for k, x in _number_tree(file, catalog(file).get("PageLabels")):
        style, start = file.get(x, "S"), file.get(x, "St")
        yield {"from_page": k + 1, "style": str(style) if style else None, "prefix": text_of(file.get(x, "P")), "start_at": start if isinstance(start, int) else 1}


def filter_rows(file: File) -> Iterator[dict]:
    """A row for each filter that a stream names."""
    for num, (_, x) in sorted(file.objects.items()):
        if isinstance(x, Stream):
            d = {k: file.resolve(v) for k, v in x.dict.items()}
            for k, (name, _) in enumerate(filters_of(d)):
                yield {"obj_num": num, "name": name, "position": k, "on_image": d.get("Subtype") == "Image"}


def font_rows(file: File) -> Iterator[dict]:
    for num, (_, x) in sorted(file.objects.items()):
        if isinstance(x, dict) and x.get("Type") == "Font":
            name, descriptor = str(file.get(x, "BaseFont") or ""), file.get(x, "FontDescriptor")
            yield {"obj_num": num, "name": name, "font_type": str(file.get(x, "Subtype") or ""), "is_embedded": any(file.get(descriptor, k) is not None for k in ("FontFile", "FontFile2", "FontFile3")), "is_subset": "+" in name, "has_to_unicode": "ToUnicode" in x}


#: Fields of both places: ours, the information dictionary's key, the metadata stream's element (fixed values).
FIELDS = (
    ("title", "Title", "title"), ("author", "Author", "creator"), ("subject", "Subject", "description"), ("keywords", "Keywords", "Keywords"), ("creator", "Creator", "CreatorTool"),
    ("producer", "Producer", "Producer"), ("creation_date", "CreationDate", "CreateDate"), ("mod_date", "ModDate", "ModifyDate"), ("rights", "Rights", "rights"), ("language", "Lang", "language"),
)


def metadata_rows(file: File) -> Iterator[dict]:
    info = file.resolve(file.trailer.get("Info"))
    if isinstance(info, dict):
        yield {"origin": "info"} | {f: text_of(file.resolve(info.get(k))) for f, k, _ in FIELDS}
    stream = file.get(catalog(file), "Metadata")
    if isinstance(stream, Stream):
        try:
            root = ElementTree.fromstring(re.sub(rb"<\?xpacket.*?\?>", b"", file.data(stream), flags=re.S))
        except (ElementTree.ParseError, FilterError):
            return
        found: dict[str, str] = {}
        for e in root.iter():
            for tag, value in [(e.tag, "".join(e.itertext()).strip()), *e.attrib.items()]:
                found.setdefault(tag.rpartition("}")[2], value)
        yield {"origin": "xmp"} | {f: found.get(x) or None for f, _, x in FIELDS}


def catalog_rows(file: File) -> Iterator[dict]:
    for key, x in sorted(catalog(file).items()):
        yield {"key": key, "value_desc": kind_of(file.resolve(x))}


def signature_rows(file: File) -> Iterator[dict]:
    for num, (_, x) in sorted(file.objects.items()):
        if isinstance(x, dict) and (x.get("Type") == "Sig" or "ByteRange" in x):
            ranges = [v for v in file.get(x, "ByteRange") or [] if isinstance(v, int)]
            yield {"obj_num": num, "sub_filter": str(file.get(x, "SubFilter") or "") or None, "signed_at": text_of(file.get(x, "M")), "ranges": ranges, "covered": sum(ranges[1::2])}


def encryption_rows(file: File) -> Iterator[dict]:
    e = file.resolve(file.trailer.get("Encrypt"))
    if isinstance(e, dict):
        number = lambda k: v if isinstance(v := file.get(e, k), int) else None
        yield {"handler": str(file.get(e, "Filter") or ""), "v": number("V"), "r": number("R"), "length": number("Length"), "p": number("P"), "access": file.access}
