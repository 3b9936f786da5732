"""Benchmark decontamination by a prefix-filtered set join.

Every run of ``window`` item words is a set of shingles. Shingles are ordered by how many documents hold them, rarest
first; a document that contains a window must hold the window's rarest shingle, so that one shingle is its necessary prefix
(exact containment leaves a prefix of length one). Documents are probed for prefix shingles only; a hit fixes where the
window would begin, the length and position bounds are applied, and the words are compared exactly.

The item side is a query set: it is taken in blocks whose size is checked, each block a count over the documents, and the
windows of a few blocks, a bounded number of bytes, are what is sent to executors for a pass. A document's hits never leave its
row, so no key can be hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 10
SHINGLE = 5
#: Item characters of one block: what is sent to executors at a time.
BLOCK_CHARS = 8 << 20
#: Blocks that one pass over the documents looks for; the result of a pass is written before the next one.
BLOCKS = 4

#: Bytes of words after lower-casing: digits, small letters and everything beyond ASCII; all others become a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def windows_of(items: list[tuple[str, str | None]], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """Each distinct window and the items that hold it."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            out.setdefault(tuple(words[i : i + size]), set()).add(item)
    return out


def shingles_of(window: tuple[bytes, ...], shingle: int) -> list[tuple[bytes, ...]]:
    size = min(shingle, len(window))
    return [window[i : i + size] for i in range(len(window) - size + 1)]


class Probe:
    """Shingles of several lengths, found by their first word and then whole."""

    def __init__(self, shingles: set[tuple[bytes, ...]]):
        self.sizes = sorted({len(s) for s in shingles})
        self.shingles = shingles
        self.first: dict[bytes, list[int]] = {}
        for s in shingles:
            sizes = self.first.setdefault(s[0], [])
            if len(s) not in sizes:
                sizes.append(len(s))
        # a pair of words is looked up only where the first one can begin a shingle
        self.pairs = {s[:2] for s in shingles if len(s) > 1}
        self.single = {s[0] for s in shingles if len(s) == 1}

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        if not self.shingles or not words:
            return
        at = [i for i, pair in enumerate(zip(words, words[1:], strict=False)) if pair in self.pairs]
        if self.single:
            at = sorted({*at, *(i for i, w in enumerate(words) if w in self.single)})
        for i in at:
            for size in self.first[words[i]]:
                found = tuple(words[i : i + size])
                if found in self.shingles:
                    yield i, found


def shingle_counts(docs: DataFrame, shingles: set[tuple[bytes, ...]]) -> Counter:
    """Documents that hold each item shingle. The frame that reaches the driver has a row per item shingle at most."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(shingles)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe, found = Probe(sent.value), Counter()
        for frame in batches:
            for text in frame["text"]:
                found.update({s for _, s in probe.search(words_of(text))})
        yield pd.DataFrame({"shingle": [b" ".join(s) for s in found], "n": pd.Series(list(found.values()), dtype="int64")})

    rows = docs.mapInPandas(count, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return Counter({tuple(bytes(r["shingle"]).split(b" ")): r["n"] for r in rows})


def prefixes(windows: dict[tuple[bytes, ...], set[str]], counts: Counter, shingle: int) -> dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...]]]]:
    """Rarest shingle of each window, to the windows it stands for and its place in them. Windows of which a shingle is in no document are left out."""
    out: dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...]]]] = {}
    for window in windows:
        ordered = sorted((counts[s], s, k) for k, s in enumerate(shingles_of(window, shingle)))
        rarity, prefix, k = ordered[0]
        if rarity:
            out.setdefault(prefix, []).append((k, window))
    return out


def _item_blocks(items: DataFrame, chars: int) -> Iterator[list[tuple[str, str]]]:
    part: list[tuple[str, str]] = []
    size = 0
    for row in items.toLocalIterator():
        if part and size + len(row["text"] or "") > chars:
            yield part
            part, size = [], 0
        part.append((row["item"], row["text"]))
        size += len(row["text"] or "")
    if part:
        yield part


def _finder(windows: dict[tuple[bytes, ...], set[str]], wanted: dict):
    """A function of texts to the word count, hit ranges and items of one block's windows."""

    @F.pandas_udf("n_words long, hits array<struct<begin:long,end:long>>, items array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows, wanted = sent.value
        probe = Probe(set(wanted))
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                spans, found = set(), set()
                for at, prefix in probe.search(words):
                    for k, whole in wanted[prefix]:
                        begin, end = at - k, at - k + len(whole)
                        if begin >= 0 and end <= len(words) and tuple(words[begin:end]) == whole:
                            spans.add((begin, end))
                            found |= windows[whole]
                rows.append((len(words), _merged(sorted(spans)), sorted(found)))
            yield pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    sent = SparkSession.active().sparkContext.broadcast((windows, wanted))
    return find


def contaminated_spans(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Adds n_words, hits and items to every row of docs, in one pass over it after the shingles are counted.

    hits are merged word ranges [begin, end) that lie in an occurrence of an item's window, items the sorted ids, as
    strings, of the items with an occurring window. Null and empty texts have no words; an item without words has no window;
    equal items count one by one, items without an id not at all; repeated rows each give a row; all other columns pass
    unchanged and columns of those names are replaced; no items or no documents give no hits.
    """
    names = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    listed = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.col("item").isNotNull())
    source = docs.select(*names)
    out, waiting = None, []

    def searched(finders: list) -> DataFrame:
        """What some blocks find, together with what the ones before them did."""
        found = (source if out is None else out).select("*", *(f(F.col(text_col)).alias(f"_found{k}") for k, f in enumerate(finders)))
        blocks = [F.col(f"_found{k}") for k in range(len(finders))]
        if out is None and len(blocks) == 1:
            return found.select(*names, "_found0.n_words", "_found0.hits", "_found0.items")
        hits, found_items = ([x[c] for x in blocks] + ([F.col(c)] if out is not None else []) for c in ("hits", "items"))
        return found.select(*names, "_found0.n_words", merged_ranges(F.sort_array(F.concat(*hits))).alias("hits"), F.array_sort(F.array_distinct(F.concat(*found_items))).alias("items"))

    for block in _item_blocks(listed, block_chars):
        windows = windows_of(block, window)
        if not windows:
            continue
        if len(waiting) == BLOCKS:  # no plan holds the windows of more
            out, waiting = materialize(searched(waiting), "found"), []
        counts = shingle_counts(docs.select(F.col(text_col).alias("text")), {s for w in windows for s in shingles_of(w, shingle)})
        waiting.append(_finder(windows, prefixes(windows, counts, shingle)))
    return searched(waiting or [_finder({}, {})])


def merged_ranges(ordered):
    """Ranges (begin, end) in order, those that touch joined."""
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, x: F.struct(last(a)["begin"].alias("begin"), F.greatest(last(a)["end"], x["end"]).alias("end"))
    return F.aggregate(
        ordered, F.array().cast("array<struct<begin:bigint,end:bigint>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["begin"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(grown(a, x)))).otherwise(F.concat(a, F.array(x))),
    )


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for begin, end in spans:
        if out and begin <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"begin": begin, "end": end})
    return out


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark window go."""
    found = contaminated_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.where(F.size("hits") == 0).select(*docs.columns)
