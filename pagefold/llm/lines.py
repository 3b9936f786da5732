"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines are compared by their letters and digits, without case, punctuation and spaces. Equal lines collapse first, by hash, to the
place of their earliest occurrence. Two different lines within one edit are found from threshold-plus-one segments: of the two halves that the shorter
line splits into, the edit spares one, so the other line has it at its beginning or end. Each line therefore stands in the index
under its own length's halves, and probes the halves of its own length and of one less. Only lines that meet another one
have their text fetched, and each pair is verified by a banded bit-parallel edit distance.

A half that many lines share would pair them all; such groups are split again by the parts of the other half, each
group holding lines that agree everywhere but in one small part, so their pairs stay few and none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, materialize, shared_rows

#: Letters and digits for which one edit may differ: shorter lines are compared for equality only, since one edit is more than a twentieth of them.
LEAST = 20
#: What lines are compared without: ASCII marks and spaces, and the no-break space.
MARKS = "".join(chr(c) for c in (*range(9, 14), *range(32, 127), 160) if not chr(c).isalnum())
#: Lines of a group that are paired directly; larger groups are split by finer parts, so many at a time.
DIRECT = 32
PARTS = 16
#: How often a group may be split: sixteen to this power parts reach single characters of any real line.
DEPTH = 4
#: Documents whose places may be broadcast when texts are fetched (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000
SCALE = 2**32


def normal(line: Column) -> Column:
    """Letters and digits in lower case: everything but MARKS."""
    return F.translate(F.lower(line), MARKS, "")


def characters(text: Column) -> Column:
    """The code points of a string, as an array."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def banded_distance(a: Column, b: Column, threshold: int = 1) -> Column:
    """Edit distance of two arrays of characters if it is within the threshold, else threshold + 1.

    The band of 2 * threshold + 1 diagonals is one machine word that moves down a row for each character of b; vertical and
    horizontal differences are bits of it. a and b should be columns, since each step looks at them.
    """
    width = 2 * threshold + 1
    whole = lambda x: F.lit(x).cast("long")
    invert = lambda x: F.bitwise_not(x).bitwiseAND(whole((1 << width) - 1))
    m, n = F.size(a), F.size(b)
    last = F.least(m, F.lit(threshold))
    start = F.struct(
        whole(((1 << (threshold + 1)) - 1) << threshold).alias("vp"), whole(0).alias("vn"), last.cast("long").alias("d"),
        F.element_at(F.array(*(whole(1 << (width - 2) >> (threshold - k)) for k in range(threshold + 1))), last + 1).alias("h"),
    )

    def step(s: Column, i: Column) -> Column:
        own, match = F.get(b, i), whole(0)
        for k in range(width):
            row = F.get(a, i + (k - threshold))
            match = match.bitwiseOR(F.when(row == own, whole(1 << k)).otherwise(whole(0)))
        return F.transform(F.array(match), lambda x: _zero_diagonals(s, x, width))[0].alias("d0")

    def move(s: Column, i: Column) -> Column:
        return F.transform(F.array(step(s, i)), lambda d0: _advance(s, i, d0, m, threshold, width, invert, whole))[0]

    end = F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), start, move, lambda s: s["d"])
    far = whole(threshold + 1)
    return F.when(F.abs(m - n) > threshold, far).when(n == 0, m.cast("long")).otherwise(F.least(end, far))


def _zero_diagonals(s: Column, match: Column, width: int) -> Column:
    """Bits of the rows whose diagonal neighbour has the same value."""
    carried = (match.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])
    return carried.bitwiseOR(match).bitwiseOR(s["vn"]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _advance(s: Column, i: Column, d0: Column, m: Column, threshold: int, width: int, invert, whole) -> Column:
    hp = s["vn"].bitwiseOR(invert(d0.bitwiseOR(s["vp"])))
    hn = d0.bitwiseAND(s["vp"])
    shifted = F.shiftrightunsigned(d0, 1)
    above = i < m - threshold  # the band's lowest row is not yet the last one
    diagonal = F.when(d0.bitwiseAND(whole(1 << (width - 1))) == 0, whole(1)).otherwise(whole(0))
    across = F.when(hp.bitwiseAND(s["h"]) != 0, whole(1)).otherwise(whole(0)) - F.when(hn.bitwiseAND(s["h"]) != 0, whole(1)).otherwise(whole(0))
    return F.struct(
        hn.bitwiseOR(invert(shifted.bitwiseOR(hp))).alias("vp"), shifted.bitwiseAND(hp).alias("vn"),
        (s["d"] + F.when(above, diagonal).otherwise(across)).alias("d"), F.when(above, s["h"]).otherwise(F.shiftrightunsigned(s["h"], 1)).alias("h"),
    )


def _order(id_col: str) -> Column:
    """Ids as longs; null becomes the largest one, so it comes last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, no, norm) of every line with a letter or digit; null ids come last."""
    split = docs.select(_order(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    return split.select("id", "no", normal(F.col("line")).alias("norm")).where("norm != ''")


def _loc() -> Column:
    return (F.col("id").cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(10,0)") + F.col("no")).cast("decimal(38,0)").alias("loc")


def _identity() -> list[Column]:
    return [F.xxhash64("norm").alias("h"), F.hash("norm").alias("m"), F.char_length("norm").alias("len")]


def _halves(least: int) -> list[Column]:
    """Keys of the line's own halves and of the halves that a line one shorter would have; null for short lines."""
    out = []
    for k, base in enumerate((F.col("len"), F.col("len") - 1)):
        half = (base / 2).cast("int")
        suffix = F.substring(F.col("norm"), F.col("len") - (base - half) + 1, base - half)
        prefix = F.substring(F.col("norm"), F.lit(1), half)
        for i, part in enumerate((suffix, prefix)):
            out.append(F.when(base >= least, F.xxhash64(part, base, F.lit(i))).alias(f"k{2 * k + i}"))
    return out


def _counted(entries: DataFrame, label: str) -> DataFrame:
    """Entries whose key another line has, with the size of the group."""
    return materialize(shared_rows(materialize(entries, label), "key", "h").drop("rep"), "meets")


def _pairs(entries: DataFrame) -> DataFrame:
    """Pairs of a key: of two lines of the base length, or of one of them and a longer one."""
    left = entries.where(~F.col("longer")).select("key", F.col("h").alias("a"))
    right = entries.select("key", F.col("h").alias("b"), "longer")
    return left.join(right, "key").where(F.col("longer") | (F.col("a") < F.col("b"))).where("a != b").select("a", "b")


def _split(entries: DataFrame) -> DataFrame:
    """(key, h, longer, rest) to finer groups: lines that also agree in all of rest but one of its parts."""
    base = F.char_length("rest") - F.col("longer").cast("int")
    parts = F.greatest(F.lit(1), F.least(F.lit(PARTS), F.col("base")))
    out = entries.withColumn("base", base).withColumn("parts", parts).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = out.withColumn("begin", F.floor(F.col("j") * F.col("base") / F.col("parts")).cast("int")).withColumn("end", F.floor((F.col("j") + 1) * F.col("base") / F.col("parts")).cast("int"))
    tail = F.col("base") - F.col("end")
    before, after = F.substring(F.col("rest"), F.lit(1), F.col("begin")), F.when(tail > 0, F.substring(F.col("rest"), F.char_length("rest") - tail + 1, tail)).otherwise("")
    return out.select(
        F.xxhash64("key", "j", before, after).alias("key"), "h", "longer", F.substring(F.col("rest"), F.col("begin") + 1, F.char_length("rest") - tail - F.col("begin")).alias("rest")
    )


def near_lines(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """Distinct lines (loc, h, m, len, n, near): where they occur first, how often, and whether an earlier one is within an edit."""
    lines = _lines(docs, id_col, text_col).select("norm", _loc(), *_identity())
    keyed = lines.select("h", "m", "len", "loc", *_halves(least))
    distinct = keyed.groupBy("h", "m", "len").agg(F.min("loc").alias("loc"), F.count(F.lit(1)).alias("n"), *(F.min(f"k{k}").alias(f"k{k}") for k in range(4)))
    distinct = materialize(distinct, "lines")
    halves = F.array(*(F.struct(F.col(f"k{k}").alias("key"), F.lit(k >= 2).alias("longer"), F.lit(k % 2).alias("side")) for k in range(4)))
    entries = distinct.where("k0 is not null or k2 is not null").select("h", F.explode(halves).alias("e")).select("e.key", "h", "e.longer", "e.side").where("key is not null")
    meets = _counted(entries, "halves")

    # texts of the lines that meet another one, by the place of their first occurrence
    wanted = distinct.join(meets.select("h").distinct(), "h", "left_semi").select("h", "m", "loc")
    places = wanted.select("h", "m", "loc", F.floor(F.col("loc") / SCALE).cast("long").alias("id"))
    places = places.select("h", "m", "loc", "id", (F.col("loc") - F.col("id").cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("int").alias("no"))
    by_doc = materialize(places.groupBy("id").agg(F.collect_list(F.struct("no", "h", "m", "loc")).alias("places")), "places")
    few = by_doc.agg(F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_ROWS
    source = docs.select(_order(id_col).alias("id"), F.split(text_col, "\n").alias("split"))
    fetched = source.join(F.broadcast(by_doc) if few else by_doc, "id").select("split", F.explode("places").alias("p"))
    fetched = fetched.select("p.h", "p.m", "p.loc", normal(F.get("split", F.col("p.no"))).alias("norm")).where((F.xxhash64("norm") == F.col("h")) & (F.hash("norm") == F.col("m")))
    texts = materialize(fetched.dropDuplicates(["loc"]).withColumn("chars", characters(F.col("norm"))), "texts")

    found = _pairs(meets.where(F.col("size") <= DIRECT))
    hot = meets.where(F.col("size") > DIRECT)
    base = F.char_length("norm") - F.col("longer").cast("int")
    half = (base / 2).cast("int")
    rest = F.when(F.col("side") == 0, F.substring(F.col("norm"), F.lit(1), half + F.col("longer").cast("int"))).otherwise(F.substring(F.col("norm"), half + 1, F.char_length("norm") - half))
    hot = hot.join(texts, "h").select("key", "h", "longer", rest.alias("rest"))
    for depth in range(DEPTH):
        if hot.isEmpty():
            break
        finer = _counted(_split(hot), f"finer{depth}")
        direct = finer if depth == DEPTH - 1 else finer.where(F.col("size") <= DIRECT)
        found = found.unionByName(_pairs(direct))
        hot = finer.where(F.col("size") > DIRECT).drop("size")
    a, b = (texts.select(F.col("h").alias(k), F.col("chars").alias(f"chars_{k}"), F.col("loc").alias(f"loc_{k}")) for k in "ab")
    checked = found.distinct().join(a, "a").join(b, "b").where(banded_distance(F.col("chars_a"), F.col("chars_b")) <= 1)
    later = checked.select(F.greatest("loc_a", "loc_b").alias("loc")).distinct().withColumn("near", F.lit(True))
    return distinct.select("loc", "h", "m", "len", "n").join(later, "loc", "left").withColumn("near", F.coalesce("near", F.lit(False)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Every row with its text without repeated lines, and ``n_lines``, ``n_dropped`` and ``dropped`` (their numbers).

    A line goes if an earlier one (by id, then place) has the same letters and digits, whatever their case and what stands between
    them, or, from ``least`` of them on, is within one edit of it so compared. Lines without a letter or digit stay. Null and empty
    texts stay as they are; rows of one id count as one document, so repeated rows keep the same lines; rows without an id are
    one document with the id 2**63 - 1, so they come last; all other columns pass unchanged and columns of those three names are
    replaced; an empty table gives an empty frame. Ids are whole numbers.
    """
    docs = docs.drop("n_lines", "n_dropped", "dropped")
    names = docs.columns
    distinct = near_lines(docs.select(id_col, text_col), id_col, text_col, least)
    drops = materialize(distinct.where("near or n > 1"), "drops")
    places = _lines(docs.select(id_col, text_col), id_col, text_col).select("id", "no", _loc(), *_identity())
    firsts = drops.select("h", "m", "len", F.col("loc").alias("first"), "near", "n")
    few = firsts.count() <= BROADCAST_ROWS
    if few:
        gone = places.join(F.broadcast(firsts.drop("n")), ["h", "m", "len"])
    else:
        gone = keyed_join(materialize(places, "occurrences"), materialize(firsts, "firsts"), ["h", "m", "len"])
    gone = gone.where(F.col("near") | (F.col("loc") != F.col("first")))
    gone = gone.groupBy("id").agg(F.sort_array(F.collect_set("no")).alias("_gone"))
    source = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(names)), _order(id_col).alias("id"))
    text = F.col(f"_{names.index(text_col)}")
    joined = source.join(gone, "id", "left").withColumn("_split", F.split(text, "\n"))
    # rows of one id may have texts of different length: only their own lines count
    every = F.when(text.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("_split") - 1))
    joined = joined.withColumn("_stay", F.when(F.col("_gone").isNotNull(), F.array_except(every, F.col("_gone"))))
    kept = F.when(text.isNull() | F.col("_stay").isNull(), text).otherwise(F.array_join(F.transform("_stay", lambda k: F.get("_split", k)), "\n"))
    lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size("_split"))
    dropped = F.when(F.col("_stay").isNull(), F.array().cast("array<int>")).otherwise(F.array_except(every, F.col("_stay")))
    return joined.select(
        *((kept if c == text_col else F.col(f"_{i}")).alias(c) for i, c in enumerate(names)), lines.cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped")
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "dropped", "text")


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, and documents of which no line is left."""
    out = dedup_lines(docs)
    names = docs.columns
    return out.where((F.col("n_dropped") == 0) | (F.trim("text") != "")).select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in names))
