"""PDF objects: a lexer and parser of the byte syntax, and its inverse."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

#: How deep arrays and dictionaries may nest.
NESTING = 128


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream(NamedTuple):
    dict: dict[str, Any]
    data: bytes


class Keyword(str):
    """A word that is no object: an operator or a structural keyword."""

    __slots__ = ()


class PdfSyntaxError(ValueError):
    pass


BLANK = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
NUMBER = re.compile(rb"[+-]*(?:[0-9]+\.?[0-9]*|\.[0-9]+)\Z")
REFERENCE = re.compile(rb"([0-9]{1,10})[\x00\t\n\x0c\r ]+([0-9]{1,5})[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
NAME_ESCAPE = re.compile(r"#([0-9A-Fa-f]{2})")
LITERAL_STOP = re.compile(rb"[()\\\r]")
#: Escapes of literal strings (fixed values).
ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f", ord("("): b"(", ord(")"): b")", ord("\\"): b"\\"}


class Parser:
    """Reads objects at a position; ``references`` says whether "n g R" is one, as it is in files but not in content."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True):
        self.data, self.at, self.references = data, at, references

    def skip(self) -> int:
        self.at = BLANK.match(self.data, self.at).end()
        return self.at

    def next(self, depth: int = 0) -> Any:
        """The next object or keyword; EOFError at the end."""
        data, at = self.data, self.skip()
        if depth > NESTING:
            raise PdfSyntaxError("nests too deep")
        if at >= len(data):
            raise EOFError
        c = data[at]
        if c == 0x2F:
            m = WORD.match(data, at + 1)
            self.at = m.end() if m else at + 1
            raw = m[0].decode("latin-1") if m else ""
            plain = NAME_ESCAPE.sub(lambda e: chr(int(e[1], 16)), raw) if "#" in raw else raw
            return Name(plain.encode("latin-1").decode("utf-8", "replace"))
        if c == 0x28:
            return self._literal()
        if c == 0x3C:
            if data[at : at + 2] == b"<<":
                return self._dictionary(depth)
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 0x5B:
            self.at += 1
            out = []
            while True:
                if self.skip() >= len(data):
                    raise PdfSyntaxError("array is not closed")
                if data[self.at] == 0x5D:
                    self.at += 1
                    return out
                x = self.next(depth + 1)
                if isinstance(x, Keyword):
                    raise PdfSyntaxError(f"{x} in an array")
                out.append(x)
        if c in b")>]{}":
            self.at += 1
            return Keyword(chr(c))
        if self.references and 0x30 <= c <= 0x39 and (m := REFERENCE.match(data, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        m = WORD.match(data, at)
        word = m[0]
        self.at = m.end()
        if NUMBER.match(word):
            plain = word.lstrip(b"+-")
            sign = -1 if word[:1] == b"-" else 1
            return sign * float(plain) if b"." in plain else sign * int(plain)
        if word == b"true":
            return True
        if word == b"false":
            return False
        if word == b"null":
            return None
        return Keyword(word.decode("latin-1"))

    def _dictionary(self, depth: int) -> dict[str, Any]:
        self.at += 2
        out: dict[str, Any] = {}
        while True:
            if self.skip() >= len(self.data):
                raise PdfSyntaxError("dictionary is not closed")
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.next(depth + 1)
            if not isinstance(key, Name):
                raise PdfSyntaxError("a dictionary's key is no name")
            value = self.next(depth + 1)
            if isinstance(value, Keyword):
                raise PdfSyntaxError(f"{value} in a dictionary")
            out[str(key)] = value

    def _literal(self) -> bytes:
        data, at, level, out = self.data, self.at + 1, 1, bytearray()
        while True:
            m = LITERAL_STOP.search(data, at)
            if m is None:
                raise PdfSyntaxError("string is not closed")
            out += data[at : m.start()]
            c, at = data[m.start()], m.end()
            if c == 0x28:
                level += 1
                out += b"("
            elif c == 0x29:
                level -= 1
                if not level:
                    self.at = at
                    return bytes(out)
                out += b")"
            elif c == 0x0D:
                out += b"\n"
                at += data[at : at + 1] == b"\n"
            else:
                c = data[at] if at < len(data) else 0x20
                if c in ESCAPES:
                    out += ESCAPES[c]
                    at += 1
                elif 0x30 <= c <= 0x37:
                    digits = re.compile(rb"[0-7]{1,3}").match(data, at)
                    out.append(int(digits[0], 8) & 255)
                    at = digits.end()
                elif c in b"\r\n":
                    at += 2 if data[at : at + 2] == b"\r\n" else 1
                else:
                    at += 0  # a backslash before anything else is ignored


def write_real(x: float) -> str:
    out = f"{x:.6f}".rstrip("0").rstrip(".")
    return "0" if out in ("-0", "") else out


def write(x: Any) -> bytes:
    """An object's syntax."""
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in x.encode())
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if isinstance(x, int):
        return b"%d" % x
    if isinstance(x, float):
        return write_real(x).encode()
    if isinstance(x, (bytes, bytearray)):
        return b"(" + re.sub(rb"[()\\]", lambda m: b"\\" + m[0], bytes(x)).replace(b"\r", b"\\r") + b")"
    if isinstance(x, (list, tuple)) and not isinstance(x, Stream):
        return b"[" + b" ".join(map(write, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b"".join(write(Name(k)) + b" " + write(v) for k, v in x.items()) + b">>"
    if isinstance(x, Stream):
        return write(x.dict | {"Length": len(x.data)}) + b"\nstream\n" + x.data + b"\nendstream"
    if isinstance(x, Keyword):
        return x.encode("latin-1")
    raise TypeError(type(x).__name__)


def plain(x: Any, depth: int = 0) -> Any:
    """An object as JSON values: names begin with a slash, references are "n g R", strings Latin-1 text in parentheses."""
    if depth > NESTING:
        return None
    if isinstance(x, Name):
        return f"/{x}"
    if isinstance(x, Ref):
        return f"{x.num} {x.gen} R"
    if isinstance(x, bytes):
        return f"({x.decode('latin-1')})"
    if isinstance(x, Stream):
        return {k: plain(v, depth + 1) for k, v in x.dict.items()}
    if isinstance(x, dict):
        return {k: plain(v, depth + 1) for k, v in x.items()}
    if isinstance(x, list):
        return [plain(v, depth + 1) for v in x]
    return x


def kind_of(x: Any) -> str:
    """Type of an object, with its size for containers."""
    if isinstance(x, Stream):
        return "stream"
    if isinstance(x, Name):
        return "name"
    if isinstance(x, Ref):
        return "reference"
    if isinstance(x, dict):
        return f"dictionary[{len(x)}]"
    if isinstance(x, list):
        return f"array[{len(x)}]"
    return {type(None): "null", bool: "boolean", int: "integer", float: "real", bytes: "string"}[type(x)]
