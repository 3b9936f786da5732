"""Page and document edits as frame transforms: every function takes a frame of ordered rows and returns one.

Order is a column; changing it is arithmetic on the ordinal followed by one row_number within the file, so an edit shuffles by
file and never gathers a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import add_quarters, bates_label, quarter


def renumbered(frame: DataFrame, by: list[str], order: list, name: str = "page") -> DataFrame:
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def parse_page_range(text: Column, pages: Column) -> Column:
    """ "all", or numbers and ranges from 1 such as "1-5,8", as ascending distinct page numbers; out of range and malformed parts are left out."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    one = lambda p: F.when(p.rlike("^[0-9]+$"), F.array(p.cast("int")))
    low, high = lambda p: F.split(p, "-")[0].cast("int"), lambda p: F.split(p, "-")[1].cast("int")
    many = lambda p: F.when(p.rlike("^[0-9]+-[0-9]+$"), F.when(low(p) <= high(p), F.sequence(low(p), high(p))))
    listed = F.flatten(F.transform(parts, lambda p: F.coalesce(one(p), many(p), F.array().cast("array<int>"))))
    chosen = F.array_sort(F.array_distinct(F.filter(listed, lambda k: (k >= 1) & (k <= pages))))
    return F.when(F.lower(F.trim(text)) == "all", F.when(pages > 0, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))).otherwise(chosen)


def selected(frame: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    return frame.join(selection.select(*keys).distinct(), keys, "left_semi")


def rotate(frame: DataFrame, chosen: Column, degrees: int, relative: bool = True) -> DataFrame:
    """Pages that are chosen turn by, or to, a quarter turn; a turn that is none leaves them as they are."""
    by = quarter(F.lit(degrees))
    turned = add_quarters(F.coalesce("rotate", F.lit(0)), by) if relative else by
    return frame.withColumn("rotate", F.when(chosen & by.isNotNull(), turned).otherwise(F.col("rotate")))


def remove(frame: DataFrame, selection: DataFrame, by: list[str], page: str = "page") -> DataFrame:
    return renumbered(frame.join(selection.select(*by, page).distinct(), [*by, page], "left_anti"), by, [page], page)


def move(frame: DataFrame, by: list[str], source: int, target: int, page: str = "page") -> DataFrame:
    """One page to another place; the pages between close up."""
    p = F.col(page)
    at = F.when(p == source, F.lit(target + (0.5 if target > source else -0.5))).otherwise(p.cast("double"))
    return renumbered(frame.withColumn("_at", at), by, ["_at"], page).drop("_at")


def move_batch(frame: DataFrame, by: list[str], sources: list[int], before: int, page: str = "page") -> DataFrame:
    """Several pages before a place; they keep their own order."""
    p = F.col(page)
    chosen = p.isin(*sources)
    return renumbered(frame.withColumn("_at", F.when(chosen, F.lit(before - 0.5)).otherwise(p.cast("double"))).withColumn("_own", p), by, ["_at", "_own"], page).drop("_at", "_own")


def swap(frame: DataFrame, a: int, b: int, page: str = "page") -> DataFrame:
    p = F.col(page)
    return frame.withColumn(page, F.when(p == a, b).when(p == b, a).otherwise(p))


def duplicate(frame: DataFrame, by: list[str], number: int, page: str = "page") -> DataFrame:
    """A copy right after the page."""
    copied = frame.where(F.col(page) == number).withColumn("_at", F.lit(number + 0.5))
    return renumbered(frame.withColumn("_at", F.col(page).cast("double")).unionByName(copied), by, ["_at"], page).drop("_at")


def extract(frame: DataFrame, by: list[str], numbers: list[int], page: str = "page") -> DataFrame:
    """Pages in the given order, repeats kept; an empty list is an error."""
    if not numbers:
        raise ValueError("no pages are given")
    places = F.filter(F.transform(F.array(*map(F.lit, numbers)), lambda n, k: F.struct((k + 1).alias("at"), n.alias("n"))), lambda x: x["n"] == F.col(page))
    wanted = frame.withColumn("_at", F.explode(F.transform(places, lambda x: x["at"])))
    return wanted.withColumn("source_page", F.col(page)).withColumn(page, F.col("_at")).drop("_at")


def insert(frame: DataFrame, other: DataFrame, by: list[str], at: int, page: str = "page") -> DataFrame:
    """Pages of another document before a place; a place beyond the end is the end."""
    size = frame.groupBy(*by).agg(F.max(page).alias("_size"))
    base = frame.withColumn("_at", F.col(page).cast("double")).withColumn("_own", F.col(page))
    added = other.join(size, by).withColumn("_at", F.least(F.lit(at), F.col("_size") + 1) - F.lit(0.5)).withColumn("_own", F.col(page)).drop("_size")
    return renumbered(base.unionByName(added), by, ["_at", "_own"], page).drop("_at", "_own")


def merge(frames: list[DataFrame], by: list[str], page: str = "page") -> DataFrame:
    """Documents one after the other: source says which."""
    out = None
    for k, frame in enumerate(frames):
        frame = frame.withColumn("source", F.lit(k))
        out = frame if out is None else out.unionByName(frame)
    return renumbered(out.withColumn("_own", F.col(page)), by, ["source", "_own"], page).drop("_own")


def bates(frame: DataFrame, by: list[str], page: str, prefix: str, start: int, digits: int) -> DataFrame:
    """Labels that count through the selected pages of each file."""
    ordinal = F.row_number().over(Window.partitionBy(*by).orderBy(page))
    return frame.withColumn("label", bates_label(prefix, ordinal + (start - 1), digits))


def ring(frame: DataFrame, by: list[str], order: list[str], node: str) -> DataFrame:
    """Next and previous of each row in a ring, as article threads link their beads."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return frame.withColumn("next", F.coalesce(F.lead(node).over(w), F.first(node).over(whole))).withColumn("prev", F.coalesce(F.lag(node).over(w), F.last(node).over(whole)))


def siblings(frame: DataFrame, by: list[str], order: list[str], node: str) -> DataFrame:
    """Next and previous of each row among its siblings, null at the ends, as outlines link theirs."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn("next", F.lead(node).over(w)).withColumn("prev", F.lag(node).over(w))


def spreads(frame: DataFrame, by: list[str], page: str = "page", cover: bool = True) -> DataFrame:
    """Pairs of facing pages, the first one alone if it is a cover: (spread, pages)."""
    number = F.col(page)
    spread = F.when(number == 1, 0).otherwise((number / 2).cast("int")) if cover else ((number - 1) / 2).cast("int")
    return frame.groupBy(*by, spread.alias("spread")).agg(F.sort_array(F.collect_list(page)).alias("pages"))


def stacked(frame: DataFrame, by: list[str], page: str, height: str, gap: float) -> DataFrame:
    """Offset of each page when pages stand below one another."""
    before = Window.partitionBy(*by).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumn("top", F.coalesce(F.sum(F.col(height) + F.lit(gap)).over(before), F.lit(0.0)))


def is_contiguous(frame: DataFrame, by: list[str], page: str = "page") -> DataFrame:
    """Whether the selected pages of each file are one run."""
    return frame.groupBy(*by).agg(((F.max(page) - F.min(page) + 1) == F.count_distinct(page)).alias("contiguous"))


def balanced_tree(frame: DataFrame, by: list[str], page: str, kids: int) -> DataFrame:
    """Leaf node of each page in a tree with so many kids a node."""
    return frame.withColumn("node", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(page)) - 1) / kids))
