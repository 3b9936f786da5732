"""Column expressions for PDF text strings, names and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: PDFDocEncoding where it departs from Latin-1 (ISO 32000 annex D, fixed values), in code order.
PDF_DOC_CODES = [*range(0x18, 0x20), *range(0x80, 0xA1)]
PDF_DOC_CHARS = (
    "˘ˇˆ˙˝˛˚˜"
    "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€"
)
#: Filters that are decoded here; image codecs are not.
DECODED_FILTERS = ("ASCIIHexDecode", "ASCII85Decode", "LZWDecode", "FlateDecode", "RunLengthDecode", "ZstandardDecode")


def pdf_doc_text(data: Column) -> Column:
    """Bytes in PDFDocEncoding."""
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, PDF_DOC_CODES)), PDF_DOC_CHARS)


def _nuls(data: Column, lane: int) -> Column:
    """How many two-byte units have a zero byte first (0) or last (1)."""
    bytes_of_lane = F.regexp_replace(F.hex(data), "(..)(..)", f"${lane + 1},")
    return (F.char_length(bytes_of_lane) - F.char_length(F.replace(bytes_of_lane, F.lit("00,"), F.lit("")))) / 3


def text_encoding(data: Column) -> Column:
    """How a text string's encoding is settled: declared, utf16le (repaired), naked-be, naked-le (repaired) or pdfdoc."""
    size = F.octet_length(data)
    pairs = (size / 2).cast("int")
    paired = (size >= 4) & (size % 2 == 0)
    starts = lambda mark: F.hex(F.substring(data, 1, len(mark) // 2)) == mark
    return (
        F.when(data.isNull(), None).when(starts("FEFF"), "declared").when(starts("FFFE"), "utf16le").when(starts("EFBBBF"), "declared")
        .when(paired & (_nuls(data, 0) > (pairs / 2).cast("int")), "naked-be").when(paired & (_nuls(data, 1) > (pairs / 2).cast("int")), "naked-le").otherwise("pdfdoc")
    )


def recover_text(data: Column) -> Column:
    """A text string by its byte order mark, else UTF-16 if half its bytes are zero, else PDFDocEncoding."""
    kind = text_encoding(data)
    rest = lambda n: F.substring(data, n + 1, 2**31 - 1 - n)
    even = lambda d: F.substring(d, F.lit(1), (F.octet_length(d) / 2).cast("int") * 2)
    mark = F.hex(F.substring(data, 1, 2))
    return (
        F.when((kind == "declared") & (mark == "FEFF"), F.decode(even(rest(2)), "UTF-16BE")).when(kind == "utf16le", F.decode(even(rest(2)), "UTF-16LE"))
        .when(kind == "declared", F.make_valid_utf8(rest(3).cast("string"))).when(kind == "naked-be", F.decode(data, "UTF-16BE")).when(kind == "naked-le", F.decode(data, "UTF-16LE"))
        .otherwise(pdf_doc_text(data))
    )


def encode_text(text: Column, encoding: str) -> Column:
    """A text string's bytes: "utf-16be" or "utf-8" with a mark, else PDFDocEncoding."""
    if encoding == "utf-16be":
        return F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))
    if encoding == "utf-8":
        return F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))
    return F.encode(F.translate(text, PDF_DOC_CHARS, "".join(map(chr, PDF_DOC_CODES))), "ISO-8859-1")


def recover_name(data: Column) -> Column:
    """Names are UTF-8; what isn't valid is replaced."""
    return F.make_valid_utf8(data.cast("string"))


def format_real(value: Column) -> Column:
    """A number with six places at most and no closing zeros."""
    whole = F.format_string("%.6f", value)
    cut = F.regexp_replace(F.regexp_replace(whole, "0+$", ""), r"\.$", "")
    return F.when(cut == "-0", "0").otherwise(cut)


def or_dash(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("—"))


def decode_hex(text: Column) -> Column:
    """ASCIIHexDecode: white space ignored, ">" ends, an odd last digit is completed with zero; null if there is another character."""
    digits = F.regexp_replace(F.regexp_replace(text, "(?s)>.*$", ""), r"\s", "")
    even = F.when(F.char_length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(digits.rlike("^[0-9A-Fa-f]*$"), F.unhex(even))


def escape_literal(text: Column) -> Column:
    """A literal string's content: parentheses, backslashes and carriage returns escaped."""
    return F.replace(F.regexp_replace(text, r"([()\\])", r"\\$1"), F.lit("\r"), F.lit("\\r"))
