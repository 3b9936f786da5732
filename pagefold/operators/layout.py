"""Text and layout over positioned spans: page text, headings, tables, paragraphs, search and redaction.

spans: (file_id, page, op_index, text, font_size, is_bold, x, y, width). Everything is ordered and grouped within a page, so a
corpus of any size is spread by page; no window spans a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the layout rules: tenths of a point above the body that make a heading, below it that bold text may have,
#: between columns that align; points between lines and between paragraphs; levels of headings; size of a page without text.
HEADING_STEP, BOLD_STEP, COLUMN_STEP, LINE_GAP, PARAGRAPH_GAP, LEVELS, DEFAULT_SIZE = 15, 5, 50, 5.0, 20.0, 6, 120
PAGE = ("file_id", "page")


def _tenths(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double").__mul__(10).cast("int")


def page_text(spans: DataFrame) -> DataFrame:
    """Text of each page in operator order: a new line where y moves by more than five points, and no space is put in."""
    order = Window.partitionBy(*PAGE).orderBy("op_index")
    moved = F.abs(F.col("y") - F.lag("y", 1).over(order)) > LINE_GAP
    piece = F.concat(F.when(moved, F.lit("\n")).otherwise(""), "text")
    parts = spans.select(*PAGE, "op_index", piece.alias("piece"))
    return parts.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("op_index", "piece"))), lambda x: x["piece"]), "").alias("text"))


def body_size(spans: DataFrame) -> DataFrame:
    """The most frequent size of each page in tenths; of equally frequent ones the largest."""
    sizes = spans.groupBy(*PAGE, _tenths("font_size").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*PAGE).agg(F.max_by("size", F.struct("n", "size")).alias("body"))


def headings(spans: DataFrame) -> DataFrame:
    """Spans that are headings and their level: by rank among the sizes clearly above the body's, six at most; bold text of about the body's size is level six."""
    sized = spans.withColumn("size", _tenths("font_size")).join(body_size(spans), list(PAGE))
    large = F.col("size") > F.col("body") + HEADING_STEP
    rank = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy(F.desc("size")))
    level = F.when(large, F.least(rank, F.lit(LEVELS))).when(F.col("is_bold") & (F.col("size") >= F.col("body") - BOLD_STEP), LEVELS)
    return sized.withColumn("level", level).where("level is not null").select(*PAGE, "op_index", "text", "level")


def table_rows(spans: DataFrame) -> DataFrame:
    """Pages with a table: more than two lines of which two columns or more align with the line before. Lines go by tenths of y, upwards."""
    lines = spans.groupBy(*PAGE, _tenths("y").alias("line")).agg(F.sort_array(F.collect_list(_tenths("x"))).alias("cols"), F.count(F.lit(1)).alias("n"))
    before = F.lag("cols").over(Window.partitionBy(*PAGE).orderBy("line"))
    aligned = F.size(F.filter("cols", lambda c: F.exists(F.col("before"), lambda b: F.abs(b - c) < COLUMN_STEP)))
    counted = lines.withColumn("before", before).withColumn("row", (F.size("cols") > 1) & F.col("before").isNotNull() & (aligned > 1))
    return counted.groupBy(*PAGE).agg(F.count_if("row").alias("rows"), F.sum("n").alias("spans")).where("rows > 2 and spans >= 4").select(*PAGE, "rows")


def paragraphs(spans: DataFrame, keep_tail: bool = True) -> DataFrame:
    """Runs of spans without a jump of more than twenty points: (page, paragraph, spans). Without the tail, the last run of a page is left out."""
    order = Window.partitionBy(*PAGE).orderBy("op_index")
    jump = F.coalesce((F.abs(F.col("y") - F.lag("y").over(order)) > PARAGRAPH_GAP).cast("int"), F.lit(0))
    numbered = spans.select(*PAGE, "op_index", "y").withColumn("jump", jump).withColumn("paragraph", F.sum("jump").over(order) + 1)
    out = numbered.groupBy(*PAGE, "paragraph").agg(F.count(F.lit(1)).alias("spans"))
    if keep_tail:
        return out
    return out.withColumn("last", F.max("paragraph").over(Window.partitionBy(*PAGE))).where("paragraph < last").drop("last")


def skipped_headings(nodes: DataFrame, by: list[str], order: list[str], level: str = "level") -> DataFrame:
    """Headings deeper by more than one than the heading before; before the first is level 0."""
    before = F.lag(level, 1, 0).over(Window.partitionBy(*by).orderBy(*order))
    return nodes.withColumn("previous", before).where(F.col(level) > F.col("previous") + 1)


def audit_tags(nodes: DataFrame) -> DataFrame:
    """Findings of tagged documents: struct_nodes (file_id, id, dfs_pos, tag, alt, page_missing, is_root_missing)."""
    tagged = nodes.withColumn("level", F.when(F.col("tag").rlike("^H[1-9]$"), F.substring("tag", 2, 1).cast("int")))
    skip = skipped_headings(tagged.where("level is not null"), ["file_id"], ["dfs_pos"]).select("file_id", "dfs_pos", "id", F.lit("14-001").alias("checkpoint"))
    figure = nodes.where("tag = 'Figure' and alt is null").select("file_id", "dfs_pos", "id", F.lit("13-001").alias("checkpoint"))
    lost = nodes.where("page_missing").select("file_id", "dfs_pos", "id", F.lit("01-002").alias("checkpoint"))
    return skip.unionByName(figure).unionByName(lost)


def regex_matches(pages: DataFrame, key: list[str], text: str, pattern: str) -> DataFrame:
    """Distinct matches of an expression in each text, with how often they occur. Only what both Java and RE2 know is portable."""
    return pages.select(*key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("match")).groupBy(*key, "match").agg(F.count(F.lit(1)).alias("n"))


def simple_search(spans: DataFrame, text: str, term: str, match_case: bool = False) -> DataFrame:
    found = F.contains(F.col(text), F.lit(term)) if match_case else F.contains(F.lower(text), F.lit(term.lower()))
    return spans.where(found)


def redact(spans: DataFrame, hits: DataFrame, keys: list[str], text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """Text of the spans that were hit gives way to the mark."""
    flagged = spans.join(hits.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    return flagged.withColumn(text, F.when(F.col("_hit"), F.lit(mark)).otherwise(F.col(text))).drop("_hit")


def redact_words(text: Column, kept: Column, mark: str = "[REDACTED]") -> Column:
    """Words of a text that aren't in an array of kept words give way to the mark."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(F.array_contains(kept, w) | (w == ""), w).otherwise(F.lit(mark))), " ")


def word_boxes(pages: DataFrame, key: list[str], text: str, per_char: float, line: float) -> DataFrame:
    """Boxes for words of plain text: lines from the top, words one after the other with a space between."""
    lines = pages.select(*key, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    words = lines.select(*key, "line", F.posexplode(F.split("content", " ")).alias("word", "token"))
    before = Window.partitionBy(*key, "line").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("x", F.coalesce(F.sum(F.char_length("token") + 1).over(before), F.lit(0)) * F.lit(per_char)).withColumn("y", F.col("line") * F.lit(line)).withColumn("width", F.char_length("token") * F.lit(per_char))


def selected_text(spans: DataFrame, hits: DataFrame, keys: list[str], group: list[str], order: str) -> DataFrame:
    """Texts of the selected spans of each group, in order, joined with spaces."""
    own = spans.join(hits.select(*keys).distinct(), keys, "left_semi")
    return own.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"))
