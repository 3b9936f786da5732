"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` tokens in one narrow pass. Which lengths share a bin depends only
on how many pieces have each length, so the search runs on that histogram, whose size is bounded by the capacity: for one
bin, a bitset subset-sum program over the available lengths (seeded with the longest one) finds the fullest feasible
combination, and the combination is taken out as often as the histogram allows. Pieces then find their place by rank
within their length. Ranks are counted within hash chunks and shifted by chunk offsets, so a length that a third of
all pieces share is never gathered in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, materialize, worker_cache

CAPACITY = 2048
#: Words whose ids a worker remembers; the frequent ones come early, so later new words are encoded each time.
REMEMBERED = 1_000_000
#: A closing mark that doesn't follow a letter or digit of the ASCII or Latin-1 range, so may share a piece with what it follows.
BOUND_MARK = re.compile(rb"(?<![a-z0-9])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,](?=[ \n]|\Z)").search
#: Text that is tokenized at a time.
BLOCK_CHARS = 2 << 20
#: Pieces of one hash chunk, on average: what one ranking task sorts.
CHUNK_ROWS = 200_000


def words_of(text: str) -> list[bytes]:
    """White-space separated words, closing marks on their own where the splitter parts them from the letter before."""
    data = text.encode("utf-8", "surrogatepass").lower()
    if BOUND_MARK(data) is None:
        for mark in (b",", b"."):
            data = data.replace(mark + b" ", b" " + mark + b" ").replace(mark + b"\n", b" " + mark + b"\n")
    return data.split()


class WordTokenizer:
    """Ids of the word-level BPE file, with a bounded memory of the words seen.

    Its splitter never joins across white space and its normaliser works within words, so a text's ids are those of its
    white-space separated words in turn. A text with a special token's string goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.memory: dict[bytes, bytes] = {}
        self.final = np.zeros(self.full.get_vocab_size(), dtype=bool)
        self.final[[i for t, i in self.full.get_vocab().items() if t.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [[] if "<|" in t else words_of(t) for t in texts]
        memory = self.memory
        new = list(set().union(*split).difference(memory))
        found = self._of_words(new)
        if len(memory) < REMEMBERED:
            memory.update(found)
            found = {}
        out = []
        for text, words in zip(texts, split, strict=True):
            if "<|" in text:
                out += self._ids([text])
            else:
                try:
                    out.append(b"".join([memory[w] for w in words]))
                except KeyError:
                    out.append(b"".join([memory[w] if w in memory else found[w] for w in words]))
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word. Words of letters are one piece each, so they share a call and part at the tokens that end a word."""
        decoded = {w: w.decode("utf-8", "replace") for w in words}
        letters = [w for w, t in decoded.items() if t.isalpha()]
        found: dict[bytes, bytes] = {}
        ids = np.array(self.full.encode(" ".join(decoded[w] for w in letters), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) == len(letters):
            data, begin = ids.tobytes(), 0
            for w, end in zip(letters, (4 * ends).tolist(), strict=True):
                found[w] = data[begin:end]
                begin = end
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self._ids([decoded[w] for w in rest]), strict=True))
        return found


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32) of each document's ids followed by ``end_id``; null text is empty."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache()
        coder = cache.get(tokenizer_path) or cache.setdefault(tokenizer_path, WordTokenizer(tokenizer_path))
        end = np.array([end_id], dtype="<u4").tobytes()
        for frame in batches:
            rows = []
            for part in blocks(frame["text"].fillna("").tolist(), BLOCK_CHARS):
                coded = coder.encode([t for _, t in part])
                for (row, _), ids in zip(part, coded, strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((row, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            table = pd.DataFrame(rows, columns=["row", "piece", "start", "length", "ids_crc32"])
            table.insert(0, "id", frame["id"].to_numpy()[table.pop("row").to_numpy(dtype=np.int64)])
            yield table

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(cut, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


def fullest_combination(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest available length plus the subset of the others that leaves the least slack.

    A Python integer is the bitset: bit s is set if some sub-multiset sums to s. Lengths are offered in falling order, and
    the search stops as soon as the full capacity is reachable, so long items are used first.
    """
    seed = lengths[0]
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # length, times, bitset before
    for length in lengths:
        if length > room:
            continue
        left = min(counts[length] - (length == seed), room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            grown = (reach | reach << (length * take)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {seed: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def minimum_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations and how many bins use each; together they use up the histogram."""
    counts = {n: c for n, c in histogram.items() if c}
    lengths = sorted(counts, reverse=True)
    plan = []
    while lengths:
        used = fullest_combination(lengths, counts, capacity)
        times = min(counts[n] // k for n, k in used.items())
        plan.append((used, times))
        for n, k in used.items():
            counts[n] -= k * times
        lengths = [n for n in lengths if counts[n]]
    return plan


def place_table(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first bin, items of that length a bin, offset of the first), by length and rank."""
    rows, used, bins = [], {}, 0
    for combination, times in plan:
        offset = 0
        for n in sorted(combination, reverse=True):
            k = combination[n]
            rows.append((n, used.get(n, 0), bins, k, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        bins += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a materialised frame of pieces (id, piece, ..., length).

    The histogram has at most ``capacity`` rows and the place table at most a few per length and combination, whatever
    the input; only these reach the driver. Rows with equal ids are told apart by rank alone.
    """
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(n > capacity or n < 1 for n in sizes):
        raise ValueError("a piece does not fit a bin")
    places = place_table(minimum_slack(sizes, capacity))
    chunks = max(1, -(-sum(sizes.values()) // CHUNK_ROWS))
    dealt = pieces.withColumn("_chunk", F.pmod(F.xxhash64("id", "piece"), F.lit(chunks)).cast("int"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n")).select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    names = [*pieces.columns, "sequence_id", "offset"]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema} | {"sequence_id": "bigint", "offset": "bigint"}

    def ranked(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "id", "piece"], kind="stable")
        rank = frame.groupby("length").cumcount().to_numpy() + frame["_start"].to_numpy()
        length = frame["length"].to_numpy()
        span = int(places[:, 1].max(initial=0)) + int(rank.max(initial=0)) + 1
        at = np.searchsorted(places[:, 0] * span + places[:, 1], length * span + rank, side="right") - 1
        own = places[at]
        within = rank - own[:, 1]
        frame["sequence_id"] = own[:, 2] + within // own[:, 3]
        frame["offset"] = own[:, 4] + within % own[:, 3] * length
        return frame[names]

    joined = dealt.join(starts, ["length", "_chunk"])
    return joined.groupBy("_chunk").applyInPandas(ranked, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Null and empty texts are one piece that holds the end id; equal rows are placed one by one; ties in length are broken
    by id and piece; other columns are ignored; an empty table gives an empty frame.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' pieces, packed."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
