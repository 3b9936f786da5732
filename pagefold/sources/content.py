"""Content streams: operators as rows, and text as positioned spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count
from typing import Any

from .filters import FilterError
from .objects import Keyword, Name, Parser, PdfSyntaxError, Ref, Stream, write
from .reader import File

#: All operators of the standard (fixed values).
OPERATORS = frozenset("q Q cm gs w J j M d i ri m l c v y h re W W* S s f F f* B B* b b* n BT ET Tc Tw Tz TL Tf Tr Ts Td TD Tm T* Tj TJ ' \" g G rg RG k K cs CS sc SC scn SCN sh Do BMC BDC EMC MP DP d0 d1 BX EX BI ID EI".split())
STACK = 64
#: How deep forms may be placed in forms.
FORMS = 16
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
BOLD = re.compile("bold|heavy|black", re.I)
#: Code points of the private use area and circled digits carry no text.
SILENT = re.compile("[-①-⑳]")


def times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def commands(data: bytes, decide=None) -> list[tuple[str, list[Any]]]:
    """Operators and their operands; compound text operators are taken apart into simple ones."""
    p, out, operands = Parser(data, references=False), [], []
    while True:
        try:
            x = p.next()
        except EOFError:
            return out
        except PdfSyntaxError as e:
            if decide:
                decide(2, "7.8.2", f"content is unreadable from byte {p.at} of {len(data)}: {e}", "kept the operators before it")
            return out
        if not isinstance(x, Keyword):
            operands.append(x)
            continue
        op = str(x)
        if op == "BI":
            end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)").search(data, p.at)
            p.at = end.end() if end else len(data)
            out.append(("BI", []))
        elif op == "TD" and len(operands) == 2:
            out += [("TL", [-operands[1]]), ("Td", operands)]
        elif op == "'" and operands:
            out += [("T*", []), ("Tj", operands[-1:])]
        elif op == '"' and len(operands) == 3:
            out += [("Tw", operands[:1]), ("Tc", operands[1:2]), ("T*", []), ("Tj", operands[2:])]
        else:
            if op not in OPERATORS and decide:
                decide(0, "7.8.2", f"operator {op} is not of the standard", "kept it as it is")
            out.append((op, operands))
        operands = []


def serialize(listed: list[tuple[str, list[Any]]]) -> bytes:
    return b"\n".join(b" ".join([*map(write, operands), op.encode("latin-1")]) for op, operands in listed)


# character maps


def _code(x: Any) -> int:
    return int.from_bytes(x, "big")


def parse_cmap(data: bytes) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int], str], list[tuple[int, int, int, int]]]:
    """Codespace ranges (width, low, high), texts by (width, code), and CID ranges (width, low, high, first)."""
    p, held, spaces, texts, cids = Parser(data, references=False), [], [], {}, []
    while True:
        try:
            x = p.next()
        except (EOFError, PdfSyntaxError):
            return spaces, texts, cids
        if not isinstance(x, Keyword):
            held.append(x)
            continue
        if x == "endcodespacerange":
            spaces += [(len(a), _code(a), _code(b)) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
        elif x == "endbfchar":
            texts |= {(len(a), _code(a)): b.decode("utf-16-be", "replace") for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif x == "endbfrange":
            for a, b, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                for k in range(min(_code(b) - _code(a), 65_535) + 1):
                    if isinstance(to, list):
                        text = to[k].decode("utf-16-be", "replace") if k < len(to) and isinstance(to[k], bytes) else None
                    else:
                        text = (int.from_bytes(to, "big") + k).to_bytes(max(2, len(to)), "big").decode("utf-16-be", "replace")
                    if text is not None:
                        texts[len(a), _code(a) + k] = text
        elif x in ("endcidrange", "endcidchar"):
            step = 3 if x == "endcidrange" else 2
            cids += [(len(g[0]), _code(g[0]), _code(g[step - 2]), g[-1]) for g in zip(*(held[k::step] for k in range(step)), strict=False)]
        held = []


class Font:
    """What turns a string's bytes into characters and widths."""

    def __init__(self, file: File, d: Any):
        get = lambda k: file.get(d, k)
        self.name = str(get("BaseFont") or "")
        self.two_bytes = get("Subtype") == "Type0"
        self.first, self.widths = get("FirstChar") or 0, [file.resolve(w) for w in get("Widths") or []]
        self.texts: dict[tuple[int, int], str] = {}
        to = get("ToUnicode")
        if isinstance(to, Stream):
            try:
                self.texts = parse_cmap(file.data(to))[1]
            except FilterError:
                pass
        encoding = get("Encoding")
        base = file.get(encoding, "BaseEncoding") if isinstance(encoding, dict) else encoding
        self.codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        self.known: dict[int, tuple[str, float]] = {}
        self.text_of: dict[int, str] = {}
        self.width_of: dict[int, float] = {}
        self.differences: dict[int, str] = {}
        code = 0
        for x in (file.get(encoding, "Differences") or []) if isinstance(encoding, dict) else []:
            if isinstance(x, Name):
                self.differences[code] = glyph_text(x)
                code += 1
            elif isinstance(x, int):
                code = x

    def _character(self, code: int) -> tuple[str, float]:
        """(text, width in thousandths) of a code; a width of zero falls back to 500, or 1000 for wide scripts."""
        step = 2 if self.two_bytes else 1
        text = self.texts.get((step, code))
        if text is None:
            text = self.differences.get(code) if code in self.differences else bytes([code]).decode(self.codec, "replace") if step == 1 else chr(code) if code < 128 else ""
            if text == "\ufffd":
                text = chr(code)
        k = code - self.first
        width = self.widths[k] if step == 1 and 0 <= k < len(self.widths) and isinstance(self.widths[k], (int, float)) else 0
        return SILENT.sub("", text), width or (1000 if text and max(text) >= "⺀" else 500)

    def show(self, data: bytes) -> tuple[str, float, int, int]:
        """Text, width in thousandths, codes and spaces of a string; each code is worked out once."""
        codes = [high << 8 | low for high, low in zip(data[::2], data[1::2], strict=False)] if self.two_bytes else data
        for code in set(codes).difference(self.known):
            self.known[code] = self._character(code)
            self.text_of[code], self.width_of[code] = self.known[code]
        text = "".join(map(self.text_of.__getitem__, codes))
        return text, sum(map(self.width_of.__getitem__, codes)), len(codes), text.count(" ")


def glyph_text(name: str) -> str:
    """Text of a glyph's name: one letter, a common name, or uniXXXX."""
    common = {"space": " ", "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "parenleft": "(", "parenright": ")", "quotesingle": "'", "fi": "fi", "fl": "fl"}
    if len(name) == 1 or name in common:
        return common.get(name, name)
    m = re.match(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})\Z", name)
    return chr(int(m[1] or m[2], 16)) if m else ""


def spans(file: File, data: bytes, resources: Any, decide=None) -> list[tuple[int, str, float, bool, float, float, float]]:
    """(op_index, text, font_size, is_bold, x, y, width) of each text-showing operator, with the current matrix applied.

    Forms are followed where they are placed, and their operators are counted on there.
    """
    state = {"ctm": IDENTITY, "font": None, "size": 0.0, "tc": 0.0, "tw": 0.0, "tz": 1.0, "tl": 0.0, "rise": 0.0}
    return list(_spans(file, data, resources, state, {}, (), count(1), decide))


def _font(file: File, x: Any, fonts: dict) -> Font:
    key = x.num if isinstance(x, Ref) else id(x)
    if key not in fonts:
        fonts[key] = x, Font(file, file.resolve(x) or {})  # x lives as long as its id is used
    return fonts[key][1]


def _spans(file: File, data: bytes, resources: Any, state: dict, fonts: dict, inside: tuple, number: Iterator[int], decide) -> Iterator[tuple]:
    """inside: the forms around, so that one that places itself ends."""
    state, stack = dict(state), []
    tm = line = IDENTITY
    for op, a in commands(data, decide if inside else None):
        index = next(number)
        try:
            if op == "q" and len(stack) < STACK:
                stack.append(dict(state))
            elif op == "Q" and stack:
                state = stack.pop()
            elif op == "cm":
                state["ctm"] = times(tuple(map(float, a)), state["ctm"])
            elif op == "BT":
                tm = line = IDENTITY
            elif op == "Tf":
                held = file.get(resources, "Font") or {}
                if str(a[0]) not in held and decide:
                    decide(1, "9.3.1", f"font {a[0]} is not among the resources", "measured its text without a font dictionary")
                state |= {"font": _font(file, held.get(str(a[0])), fonts), "size": float(a[1])}
            elif op == "gs":
                font = file.get(file.get(file.get(resources, "ExtGState"), str(a[0])), "Font")
                if isinstance(font, list) and len(font) == 2:
                    state |= {"font": _font(file, font[0], fonts), "size": float(file.resolve(font[1]))}
            elif op == "Do":
                ref = (file.get(resources, "XObject") or {}).get(str(a[0]))
                form = file.resolve(ref)
                if not isinstance(form, Stream) or file.resolve(form.dict.get("Subtype")) != "Form":
                    continue
                if ref in inside or len(inside) >= FORMS:
                    if decide:
                        decide(1, "8.10.1", f"form {a[0]} places itself or lies too deep", "left its content out there")
                    continue
                matrix = [float(file.resolve(v)) for v in file.get(form, "Matrix") or IDENTITY]
                own = file.get(form, "Resources") or resources
                yield from _spans(file, file.data(form), own, state | {"ctm": times(tuple(matrix), state["ctm"])}, fonts, (*inside, ref), number, decide)
            elif op in ("Tc", "Tw", "TL", "Ts", "Tz"):
                key = {"Tc": "tc", "Tw": "tw", "TL": "tl", "Ts": "rise", "Tz": "tz"}[op]
                state[key] = float(a[0]) / (100 if op == "Tz" else 1)
            elif op == "Td":
                tm = line = times((1, 0, 0, 1, float(a[0]), float(a[1])), line)
            elif op == "T*":
                tm = line = times((1, 0, 0, 1, 0, -state["tl"]), line)
            elif op == "Tm":
                tm = line = tuple(map(float, a))
            elif op in ("Tj", "TJ"):
                at, advance, text = times(tm, state["ctm"]), 0.0, []
                for x in a[0] if op == "TJ" else a[:1]:
                    if isinstance(x, (int, float)):
                        advance -= x / 1000 * state["size"] * state["tz"]
                        continue
                    if state["font"]:
                        shown, width, codes, blanks = state["font"].show(x)
                        text.append(shown)
                        advance += (width / 1000 * state["size"] + codes * state["tc"] + blanks * state["tw"]) * state["tz"]
                scale = (at[2] ** 2 + at[3] ** 2) ** 0.5
                yield index, "".join(text), state["size"] * scale, bool(state["font"] and BOLD.search(state["font"].name)), at[4], at[5] + state["rise"] * scale, advance * (at[0] ** 2 + at[1] ** 2) ** 0.5
                tm = times((1, 0, 0, 1, advance, 0), tm)
        except (IndexError, TypeError, ValueError) as e:
            if decide:
                decide(1, "7.8.2", f"operator {op} has no proper operands: {e}", "left it out")
