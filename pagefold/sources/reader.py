"""A file's objects from its bytes: header, cross-reference sections, object streams, and recovery by scanning.

Reading never fails as a whole: what departs from the standard is a decision (severity, clause, found, action), so a file is
always some rows. Severities: 0 ambiguity, 1 repaired, 2 violation.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from typing import Any

from .filters import FilterError, decode
from .objects import Keyword, Parser, PdfSyntaxError, Ref, Stream
from .security import unlock

HEADER = re.compile(rb"%PDF-([0-9.]{1,8})")
OBJECT = re.compile(rb"(?<![0-9])([0-9]{1,10})[\x00\t\n\x0c\r ]+([0-9]{1,5})[\x00\t\n\x0c\r ]+obj(?![A-Za-z])")
#: Where a stream and its object end and the next object begins.
ENDED = re.compile(rb"endstream[\x00\t\n\x0c\r ]+endobj[\x00\t\n\x0c\r ]+[0-9]{1,10}[\x00\t\n\x0c\r ]+[0-9]{1,5}[\x00\t\n\x0c\r ]+obj(?![A-Za-z])")
RESOLVE = 64
Entry = tuple[str, int, int]  # in_file (offset, generation), free (next, generation) or in_stream (container, index)


@dataclass
class File:
    """What a file holds, as written."""

    version: str = "1.7"
    base: int = 0
    trailer: dict[str, Any] = field(default_factory=dict)
    objects: dict[int, tuple[int, Any]] = field(default_factory=dict)
    records: dict[int, Entry] = field(default_factory=dict)
    revisions: list[tuple[int, int, bool, str]] = field(default_factory=list)  # offset, entries, has trailer, form
    superseded: set[int] = field(default_factory=set)
    decisions: list[tuple[int, str, str, str]] = field(default_factory=list)
    pages: list | None = None  # the page walk, made once
    whole: bool = False  # whether all sections were read, so nothing comes from a scan
    access: str | None = None  # whose password has opened it: user, owner, or None if it isn't encrypted

    def decide(self, severity: int, clause: str, found: str, action: str) -> None:
        self.decisions.append((severity, clause, found, action))

    def resolve(self, x: Any) -> Any:
        """A direct object: references are followed up to a limit, then it is null."""
        for _ in range(RESOLVE):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.num, (0, None))[1]
        return None

    def get(self, d: Any, key: str) -> Any:
        d = self.resolve(d)
        d = d.dict if isinstance(d, Stream) else d
        return self.resolve(d.get(key)) if isinstance(d, dict) else None

    def data(self, x: Any) -> bytes:
        """A stream's decoded data."""
        s = self.resolve(x)
        if not isinstance(s, Stream):
            return b""
        d = {k: self.resolve(v) for k, v in s.dict.items()}
        if isinstance(d.get("Filter"), list):
            d["Filter"] = [self.resolve(v) for v in d["Filter"]]
        return decode(s.data, d)


def crosses(data: bytes, begin: int, end: int, starts: list[int] | None) -> bool:
    """Whether data that holds an endstream goes on into other objects: those that the sections record (starts, sorted), or, where
    only a scan says what is there, whatever looks like the next object, unless the data is a file of its own."""
    if starts is None:
        return HEADER.search(data, begin, end) is None and ENDED.search(data, begin, end) is not None
    return any(OBJECT.match(data, s) for s in starts[bisect_right(starts, begin) : bisect_left(starts, end)])


def indirect_at(data: bytes, at: int, file: File, length_of=None, starts: list[int] | None = None) -> tuple[int, int, Any, int]:
    """(number, generation, object, end) of the object at an offset; a stream's wrong length is repaired, also one that leads to the
    end of a later stream. starts: offsets of all objects, if sections record them."""
    p = Parser(data, at)
    num, gen, word = p.next(), p.next(), p.next()
    if not (isinstance(num, int) and isinstance(gen, int) and word == "obj"):
        raise PdfSyntaxError("no object here")
    x = p.next()
    if isinstance(x, Keyword):
        x = None
    if not isinstance(x, dict):
        return num, gen, x, p.at
    p.skip()
    if data[p.at : p.at + 6] != b"stream":
        return num, gen, x, p.at
    begin = p.at + 6
    begin += 2 if data[begin : begin + 2] == b"\r\n" else 1 if data[begin : begin + 1] in (b"\n", b"\r") else 0
    length = x.get("Length")
    if isinstance(length, Ref):
        length = length_of(length) if length_of else None
    scanned = data.find(b"endstream", begin)
    extent = None
    if scanned >= 0:
        extent = scanned - begin
        extent -= 2 if data[scanned - 2 : scanned] == b"\r\n" else 1 if scanned > begin and data[scanned - 1 : scanned] in (b"\n", b"\r") else 0
    if isinstance(length, int) and 0 <= length <= len(data) - begin:
        after = data[begin + length : begin + length + 20].lstrip(b"\x00\t\n\x0c\r ")
        if after.startswith(b"endstream") and not (extent is not None and scanned < begin + length and crosses(data, begin, begin + length, starts)):
            extent = length
        elif extent is None:
            file.decide(1, "7.3.8.2", "stream data that no endstream follows", "took /Length as it stands")
            extent = length
        else:
            file.decide(1, "7.3.8.2", f"/Length is {length}, but the data ends after {extent} bytes", "read up to endstream")
    elif extent is not None:
        file.decide(1, "7.3.8.2", "a stream without /Length", "read up to endstream")
    else:
        file.decide(2, "7.3.8.2", "a stream with no /Length and no endstream", "read to the end of the file")
        extent = len(data) - begin
    return num, gen, Stream(x, data[begin : begin + extent]), begin + extent


def table_section(data: bytes, at: int) -> tuple[dict[int, Entry], dict[str, Any]]:
    """A classic cross-reference table and its trailer."""
    p = Parser(data, at)
    if p.next() != "xref":
        raise PdfSyntaxError("no table")
    out: dict[int, Entry] = {}
    while True:
        first = p.next()
        if first == "trailer":
            break
        count = p.next()
        if not isinstance(first, int) or not isinstance(count, int):
            raise PdfSyntaxError("malformed subsection")
        for k in range(count):
            offset, gen, kind = p.next(), p.next(), p.next()
            if kind not in ("n", "f") or not isinstance(offset, int):
                raise PdfSyntaxError("malformed entry")
            out.setdefault(first + k, ("in_file" if kind == "n" else "free", offset, gen))
    trailer = p.next()
    if not isinstance(trailer, dict):
        raise PdfSyntaxError("no trailer dictionary")
    return out, trailer


def stream_section(data: bytes, at: int, file: File) -> tuple[dict[int, Entry], dict[str, Any]]:
    """A cross-reference stream: rows of fixed width, big-endian; an absent type is 1, an unknown one free."""
    _, _, x, _ = indirect_at(data, at, file)
    if not isinstance(x, Stream) or x.dict.get("Type") != "XRef":
        raise PdfSyntaxError("no cross-reference stream")
    rows, widths = decode(x.data, x.dict), x.dict.get("W")
    if not isinstance(widths, list) or len(widths) < 3:
        raise PdfSyntaxError("no /W")
    index = x.dict.get("Index") or [0, x.dict.get("Size", 0)]
    size, out, at = sum(widths), {}, 0
    numbers = [first + k for first, n in zip(index[::2], index[1::2], strict=False) for k in range(n)]
    for num in numbers:
        row, fields = rows[at : at + size], []
        if len(row) < size:
            break
        for w in widths:
            fields.append(int.from_bytes(row[:w], "big"))
            row = row[w:]
        kind = fields[0] if widths[0] else 1
        out.setdefault(num, ("in_stream" if kind == 2 else "in_file" if kind == 1 else "free", fields[1], fields[2]))
        at += size
    return out, x.dict


def read_section(data: bytes, at: int, file: File) -> tuple[dict[int, Entry], dict[str, Any], str]:
    if Parser(data, at).next() == "xref":
        return *table_section(data, at), "table"
    return *stream_section(data, at, file), "stream"


def scan(data: bytes) -> dict[int, int]:
    """Offsets of everything that looks like an object; the last one of a number counts."""
    return {int(m[1]): m.start() for m in OBJECT.finditer(data)}


def read(whole: bytes, password: bytes = b"") -> File:
    """password: of the user or the owner of an encrypted file."""
    file = File()
    m = HEADER.search(whole[:1032])
    if m is None:
        file.decide(2, "7.5.2", "no header in the first 1024 bytes", "read as version 1.7")
    else:
        file.version, file.base = m[1].decode(), m.start()
        if file.base:
            file.decide(1, "7.5.2", f"{file.base} bytes before the header", "counted offsets from the header on")
    data = whole[file.base :]
    _locate(data, file)
    _load(data, file, password)
    return file


def _locate(data: bytes, file: File) -> None:
    """Merges the sections from the newest back; scans for what none of them covers."""
    tail = data[-2048:]
    at = tail.rfind(b"startxref")
    todo: list[int] = []
    if at >= 0 and (m := re.match(rb"startxref[\x00\t\n\x0c\r ]+([0-9]+)", tail[at:])):
        todo.append(int(m[1]))
    seen, failed, sections = set(), False, []
    while todo:
        offset = todo.pop(0)
        if offset in seen:
            continue
        seen.add(offset)
        try:
            if not 0 <= offset < len(data):
                raise PdfSyntaxError("beyond the end of the file")
            records, trailer, form = read_section(data, offset, file)
        except (PdfSyntaxError, EOFError, FilterError, TypeError, ValueError) as e:
            file.decide(1, "7.5.8", f"no readable cross-reference section at {offset}: {e or 'end of file'}", "left it out; a scan fills the gaps")
            failed = True
            continue
        sections.append((offset, records, trailer, form))
        for key in ("XRefStm", "Prev"):
            if isinstance(trailer.get(key), int):
                todo.append(trailer[key])
    for offset, records, trailer, form in sections:
        file.revisions.append((offset, len(records), bool(trailer), form))
        for num, entry in records.items():
            if num in file.records:
                if num:
                    file.superseded.add(num)
            else:
                file.records[num] = entry
        for k, v in trailer.items():
            file.trailer.setdefault(k, v)
    file.revisions.reverse()
    file.whole = bool(sections) and not failed
    if not sections:
        found = scan(data)
        file.decide(1, "7.5.4", "no readable cross-reference section", f"a scan gave {len(found)} objects")
        file.records = {num: ("in_file", at, 0) for num, at in found.items()}
        for m in re.finditer(rb"trailer", data):
            try:
                t = Parser(data, m.end()).next()
                file.trailer |= t if isinstance(t, dict) else {}
            except (PdfSyntaxError, EOFError):
                continue
        if not file.trailer:
            file.decide(2, "7.5.5", "no trailer dictionary", "looked for a catalogue among the objects")
    elif failed:
        missing = {num: ("in_file", at, 0) for num, at in scan(data).items() if num not in file.records}
        if missing:
            file.decide(1, "7.5.4", f"{len(missing)} objects that only unreadable sections record", "a scan gave them; records that were read stay")
            file.records |= missing


def _load(data: bytes, file: File, password: bytes) -> None:
    def length_of(ref: Ref) -> Any:
        kind, at, _ = file.records.get(ref.num, ("free", 0, 0))
        if kind != "in_file":
            return None
        try:
            x = indirect_at(data, at, File())[2]
        except (PdfSyntaxError, EOFError):
            return None
        return x if isinstance(x, int) else None

    starts = sorted(at for kind, at, _ in file.records.values() if kind == "in_file") if file.whole else None
    for num, (kind, at, _) in sorted(file.records.items()):
        if kind != "in_file" or not num:
            continue
        try:
            own, gen, x, _ = indirect_at(data, at, file, length_of, starts)
        except (PdfSyntaxError, EOFError, TypeError, ValueError) as e:
            file.decide(2, "7.5.4", f"object {num} at {at} is no valid syntax: {e or 'end of file'}", "read it as null")
            continue
        if own != num:
            file.decide(1, "7.5.4", f"object {own} stands where {num} is recorded", "went by the number that the object bears")
        file.objects[own] = (gen, x)
    if "Encrypt" in file.trailer:
        unlock(file, password)
    containers = {at for kind, at, _ in file.records.values() if kind == "in_stream"}
    if not file.revisions:  # after a scan nothing says what object streams hold
        containers |= {n for n, (_, x) in file.objects.items() if isinstance(x, Stream) and x.dict.get("Type") == "ObjStm"}
    for container in sorted(containers):
        _expand(container, file)
    if not isinstance(file.resolve(file.trailer.get("Root")), dict):
        root = next((n for n, (_, x) in sorted(file.objects.items()) if isinstance(x, dict) and x.get("Type") == "Catalog"), None)
        if root is None:
            file.decide(2, "7.7.2", "no catalogue", "gave the objects, but no pages")
        else:
            file.decide(1, "7.7.2", "no /Root", f"object {root} is a catalogue and stands in")
            file.trailer["Root"] = Ref(root, 0)


def _expand(container: int, file: File) -> None:
    """Objects of an object stream, where the index says they are its own."""
    x = file.objects.get(container, (0, None))[1]
    if not isinstance(x, Stream):
        file.decide(2, "7.5.7", f"container {container} is no stream", "its objects are missing")
        return
    try:
        body, first, n = file.data(x), x.dict.get("First", 0), x.dict.get("N", 0)
        head = Parser(body[:first], references=False)
        numbers = []
        while head.skip() < first:
            numbers.append(head.next())
    except (FilterError, PdfSyntaxError, EOFError, TypeError) as e:
        file.decide(2, "7.5.7", f"container {container} has no readable content: {e}", "its objects are missing")
        return
    pairs = list(zip(numbers[::2], numbers[1::2], strict=False))
    if len(pairs) != n:
        file.decide(1, "7.5.7", f"a container of {n} objects lists {len(pairs)}", "went by the list")
    for num, at in pairs:
        record = file.records.get(num)
        if record is not None and (record[0] != "in_stream" or record[1] != container) or record is None and file.revisions:
            continue
        if first + at >= len(body):
            file.decide(2, "7.5.7", f"object {num} begins beyond its container, at {at}", "left it out")
            continue
        try:
            value = Parser(body, first + at).next()
        except (PdfSyntaxError, EOFError) as e:
            file.decide(2, "7.5.7", f"object {num} in a container is no valid syntax: {e or 'end of file'}", "left it out")
            continue
        file.objects.setdefault(num, (0, None if isinstance(value, Keyword) else value))
