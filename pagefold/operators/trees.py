"""Trees of a document: pages, form fields, outlines and structure elements, walked with recursive queries.

nodes are rows with an id and a parent; a walk carries its depth and path, so limits and cycles end it like any other row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import write_table

#: Depth limits of the walks (fixed values).
PAGES, FORM, OUTLINE, NAMES, RESOLVE = 32, 64, 64, 32, 64
OUTLINE_ITEMS = 100_000


def _view(frame: DataFrame, name: str) -> str:
    frame.createOrReplaceTempView(name)
    return name


def _without_row_limit(frame: DataFrame) -> None:
    """A walk over a corpus gives as many rows as it has nodes, so Spark's limit on rows of recursive queries has to go; depth ends it."""
    frame.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def walk(nodes: DataFrame, depth: int, carried: dict[str, tuple[str, str]] | None = None, view: str = "pagefold_nodes") -> DataFrame:
    """(file_id, id, parent, depth, path, ...) of each node that a root reaches within a depth, in at most that many rounds.

    nodes: (file_id, id, parent, pos, ...); roots have a null parent. path holds the zero-padded positions, so it sorts in reading
    order. carried: for each column, the SQL that gives it at a root and at a child (n is the node, w its parent's row).
    """
    carried = carried or {}
    _without_row_limit(nodes)
    name = _view(nodes, view)
    first = "".join(f", {root} AS {c}" for c, (root, _) in carried.items())
    then = "".join(f", {child} AS {c}" for c, (_, child) in carried.items())
    columns = "".join(f", {c}" for c in carried)
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE w (file_id, id, parent, depth, path, seen{columns}) MAX RECURSION LEVEL {depth + 2} AS (
          SELECT n.file_id, n.id, n.parent, 0, lpad(CAST(n.pos AS STRING), 10, '0'), array(n.id){first} FROM {name} n WHERE n.parent IS NULL
          UNION ALL
          SELECT n.file_id, n.id, n.parent, w.depth + 1, concat(w.path, '/', lpad(CAST(n.pos AS STRING), 10, '0')), array_append(w.seen, n.id){then}
          FROM w JOIN {name} n ON n.file_id = w.file_id AND n.parent = w.id WHERE w.depth < {depth} AND NOT array_contains(w.seen, n.id)
        ) SELECT file_id, id, parent, depth, path{columns} FROM w""")


def leaves(nodes: DataFrame, depth: int = PAGES, kind: str = "Page") -> DataFrame:
    """Page-tree leaves in reading order: nodes of the kind that the root reaches."""
    walked = walk(nodes, depth, {"type": ("n.type", "n.type")})
    return walked.where(F.col("type") == kind).select("file_id", "id", "depth", "path")


def leaves_without_kids(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """The other page walk: any node without kids is a page, whatever its type."""
    walked = walk(nodes, depth)
    return walked.join(nodes.select("file_id", F.col("parent").alias("id")).where("id is not null").distinct(), ["file_id", "id"], "left_anti").select("file_id", "id", "depth", "path")


def inherited(nodes: DataFrame, columns: list[str], depth: int = PAGES) -> DataFrame:
    """Each node with its own value of the columns or the nearest ancestor's."""
    return walk(nodes, depth, {c: (f"n.{c}", f"coalesce(n.{c}, w.{c})") for c in columns})


def qualified_names(fields: DataFrame, depth: int = FORM) -> DataFrame:
    """Form fields with the names of their ancestors before their own, joined by dots, and inherited type, flags and value.

    A node without a name of its own adds none. terminal: no field hangs below.
    """
    named = walk(fields, depth, {"name": ("n.t", "concat_ws('.', w.name, n.t)"), **{c: (f"n.{c}", f"coalesce(n.{c}, w.{c})") for c in ("ft", "ff", "v")}})
    parents = fields.select("file_id", F.col("parent").alias("id")).where("id is not null").distinct().withColumn("_kids", F.lit(True))
    return named.join(parents, ["file_id", "id"], "left").withColumn("terminal", F.col("_kids").isNull()).drop("_kids")


def visible_outline(items: DataFrame, depth: int = OUTLINE) -> DataFrame:
    """Outline items and whether they show: a closed one hides all below it. items: (file_id, id, parent, pos, open)."""
    return walk(items, depth, {"open": ("n.open", "n.open"), "shown": ("true", "w.shown AND w.open")})


def without_subtree(nodes: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """Nodes without those under, and with, the given ones."""
    marked = nodes.join(roots.select("file_id", "id").distinct().withColumn("_root", F.lit(True)), ["file_id", "id"], "left").withColumn("cut", F.coalesce("_root", F.lit(False))).drop("_root")
    walked = walk(marked, depth, {"cut": ("n.cut", "n.cut OR w.cut")})
    return nodes.join(walked.where("cut").select("file_id", "id"), ["file_id", "id"], "left_anti")


def ancestors(nodes: DataFrame, depth: int = PAGES) -> DataFrame:
    """Chain of ancestors of each node, the root first."""
    return walk(nodes, depth, {"chain": ("CAST(array() AS ARRAY<BIGINT>)", "array_append(w.chain, CAST(w.id AS BIGINT))")})


def reachable(edges: DataFrame, roots: DataFrame, depth: int = RESOLVE) -> DataFrame:
    """(file_id, id, depth) of the objects that references lead to from the roots, each once.

    A semi-naive closure: a round joins only the objects that the round before found, and leaves out what is known; every round is a
    written table, and the rounds end when one finds nothing.
    """
    edges = write_table(edges.select("file_id", "src", "dst").distinct(), "edges")
    new = write_table(roots.select("file_id", "id").distinct().withColumn("depth", F.lit(0)), "reached")
    known = new
    for k in range(1, depth + 1):
        ends = new.select("file_id", F.col("id").alias("src")).join(edges, ["file_id", "src"]).select("file_id", F.col("dst").alias("id")).distinct()
        new = write_table(ends.join(known, ["file_id", "id"], "left_anti").withColumn("depth", F.lit(k)), "reached")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known
