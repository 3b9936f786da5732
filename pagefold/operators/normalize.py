"""Rules of normalising and writing: colour spaces, what a written copy loses, cloning, metadata packets, character codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import bit
from .trees import reachable

#: Names that are colour spaces by themselves, and the parameters that families need (fixed values).
DEVICE_SPACES = ("DeviceGray", "DeviceRGB", "DeviceCMYK", "Pattern")
CIE, SPECIAL = ("CalGray", "CalRGB", "Lab"), ("Separation", "DeviceN")
#: Permissions that a rewritten copy would need (fixed values).
NEEDED = ((4, "modification"), (11, "assembly"), (6, "annotation"))


def colour_space_decisions(spaces: DataFrame, relaxed: bool) -> DataFrame:
    """spaces: (file_id, obj_num, family, length), length being the entries of an array, or null for a bare name.

    Strict reading says what is wrong (a violation), relaxed reading puts DeviceRGB in its place (repaired).
    """
    family, length = F.col("family"), F.col("length")
    bare = length.isNull()
    clause = (
        F.when(bare & ~family.isin(*DEVICE_SPACES), "8.6").when(length == 0, "8.6").when(family.isin(*CIE) & (length < 2), "8.6.5").when((family == "ICCBased") & (length < 2), "8.6.5.5")
        .when((family == "Indexed") & (length < 4), "8.6.6.3").when(family.isin(*SPECIAL) & (length < 4), "8.6.6.4")
    )
    needs = (
        F.when(F.col("clause") == "8.6", F.when(bare, F.concat(F.lit("no such colour space: "), family)).otherwise("an array without a family"))
        .when(F.col("clause") == "8.6.5", F.concat(family, F.lit(" without its parameters"))).when(F.col("clause") == "8.6.5.5", "ICCBased without a profile")
        .when(F.col("clause") == "8.6.6.3", "Indexed without base, size and table").otherwise(F.concat(family, F.lit(" without names, other space and function")))
    )
    put = F.when(length == 0, "read an empty array as DeviceRGB").when(bare, F.concat(F.lit("read the unknown "), family, F.lit(" as DeviceRGB"))).otherwise(F.concat(F.lit("read the incomplete "), family, F.lit(" as DeviceRGB")))
    out = spaces.withColumn("clause", clause).where("clause is not null")
    return out.select("file_id", "obj_num", F.lit(1 if relaxed else 2).alias("severity"), "clause", (put if relaxed else needs).alias("action"))


def write_losses(files: DataFrame) -> DataFrame:
    """files: (file_id, access, p, signatures). Decisions (severity, clause, found) about what a written copy does not carry."""
    denied = F.filter(F.array(*(F.when(~bit(F.col("p"), b), F.lit(n)) for b, n in NEEDED)), lambda x: x.isNotNull())
    rights = F.when((F.col("access") == "user") & F.col("p").isNotNull() & (F.size(denied) > 0), F.concat(F.lit("opened as a user, whom /P "), F.col("p").cast("string"), F.lit(" denies "), F.array_join(denied, ", ")))
    signed = F.when(F.col("signatures") > 0, F.concat(F.lit("signatures that a copy does not keep: "), F.col("signatures").cast("string")))
    rows = F.array(F.struct(F.lit("7.6.4.2").alias("clause"), rights.alias("found")), F.struct(F.lit("12.8").alias("clause"), signed.alias("found")))
    return files.select("file_id", F.explode(rows).alias("r")).select("file_id", F.lit(2).alias("severity"), "r.*").where("found is not null")


def cloned(edges: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """(file_id, id, number): the reachable part of each graph with new numbers from 1, in the order of the old ones."""
    found = reachable(edges, roots, depth)
    return found.select("file_id", "id", F.row_number().over(Window.partitionBy("file_id").orderBy("id")).alias("number"))


def without_metadata(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects without metadata streams, and how many each file lost."""
    gone = F.col("type") == "Metadata"
    kept = objects.where(~F.coalesce(gone, F.lit(False)))
    return kept, objects.where(gone).groupBy("file_id").agg(F.count(F.lit(1)).alias("removed"))


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xmp_packet(title: Column, author: Column, keywords: Column) -> Column:
    """A metadata stream's text; absent values give no element."""
    element = lambda tag, inner: F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))
    some = lambda x, make: F.when(x.isNotNull() & (x != ""), make(_escaped(x))).otherwise("")
    return F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pdf="http://ns.adobe.com/pdf/1.3/">'),
        some(title, lambda x: element("dc:title", element("rdf:Alt", F.concat(F.lit('<rdf:li xml:lang="x-default">'), x, F.lit("</rdf:li>"))))),
        some(author, lambda x: element("dc:creator", element("rdf:Seq", element("rdf:li", x)))), some(keywords, lambda x: element("pdf:Keywords", x)), F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"),
    )


def code_texts(codes: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """codes (by, width, code) with the text of a character map's ranges (by, width, low, high, text), null where none holds the code.

    The last range that begins at or before a code is the only one that can hold it, so ranges must not overlap.
    """
    marks = ranges.select(*by, "width", F.col("low").alias("code"), F.struct("low", "high", "text").alias("_range"), F.lit(0).alias("_mark"))
    both = codes.withColumn("_mark", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    seen = Window.partitionBy(*by, "width").orderBy("code", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_range", F.last("_range", ignorenulls=True).over(seen)).where("_mark = 1")
    # characters of any plane: chr() of Spark knows Latin-1 only
    point = F.ascii(F.right("_range.text", F.lit(1))) + F.col("code") - F.col("_range.low")
    character = F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")
    text = F.when(F.col("code") <= F.col("_range.high"), F.concat(F.substring("_range.text", F.lit(1), F.char_length("_range.text") - 1), character))
    return found.select(*codes.columns, text.alias("text"))


def best_candidates(candidates: DataFrame, by: list[str], glyph: str = "gid", score: str = "score") -> DataFrame:
    """The candidate of the highest score; of equals the smallest glyph."""
    return candidates.groupBy(*by).agg(F.max_by(glyph, F.struct(F.col(score), -F.col(glyph))).alias(glyph))


#: Estimated widths of characters in thousandths: (characters, sans serif, serif), the first that holds counts (fixed values).
WIDTHS = (
    (" ", 250, 250), ("il", 222, 278), ("jtfr", 278, 333), ("IJ", 278, 361), ("!.,:;'|", 250, 250), ("mw", 833, 778), ("MW", 833, 889), ("@%", 850, 850), ("0123456789", 500, 500),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 667, 680), ("abcdefghijklmnopqrstuvwxyz", 520, 500),
)


def text_width(text: Column, category: Column) -> Column:
    """Estimated width of a text in thousandths of its size, by the font's category."""
    serif = category == "Serif"

    def width(c: Column) -> Column:
        wide = ~c.rlike(r"^[\x00-\x7F]$")
        out = F.when(category.isin("Monospace", "Symbol"), 600).when(category == "Cjk", F.when(wide, 1000).otherwise(500))
        for chars, sans, with_serifs in WIDTHS:
            out = out.when(F.contains(F.lit(chars), c), F.when(serif, with_serifs).otherwise(sans))
        return out.when(wide, 1000).otherwise(500)

    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.lit(0), lambda n, c: n + width(c))
