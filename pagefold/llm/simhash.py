"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made in one narrow pass. Equal fingerprints collapse before any comparison. Distinct ones are put into
tiles by the population counts of their four 16-bit quarters; two tiles are compared only if those counts differ by no more
than the radius in sum, because each differing bit moves a count by one. A tile holds a bounded number of fingerprints (a
crowded key is split into several tiles by hash), a pair of tiles is one row with two packed arrays, and the comparison is
exclusive-or and bit count in numpy. A pair of tiles gives a spanning forest of its links, not all pairs, so a large
group of near copies gives as many rows as it has members. Components are found with written rounds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, keyed_join, materialize, shared_rows
from .components import connected_components
from .passages import PRIME, mixed

#: Fingerprints of one tile at most, on average.
TILE = 4096
#: Words of a shingle unless a contract says otherwise.
SHINGLE = 5
RADIUS = 2
#: Similarity of the shingle sets of two documents of which the pipeline keeps one.
SIMILARITY = 0.8
#: 64-bit words of a wide fingerprint, and the bits in which those of two similar sets may differ: at a similarity of 0.8, 39 of
#: 256 are expected with a deviation of 6, and 128 with 8 between unrelated sets.
WIDE, WIDE_RADIUS = 4, 80
WIDE_COLUMNS = tuple(f"f{k}" for k in range(WIDE))
#: Pairs of documents that may be broadcast (16 bytes each), and pairs of texts that go to Python at a time.
BROADCAST_ROWS, PAIRS = 1_000_000, 200


WIDE_SEEDS = mixed(np.arange(101, 101 + WIDE, dtype=np.uint64) * PRIME)


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; none if it has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    # every shingle is a slice of the words joined by single spaces
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    begins = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[b : e - 1], seed) for b, e in zip(begins, ends[shingle - 1 :], strict=False)], dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of a text's word shingles, repeats included; zero if it has no word."""
    hashes = shingle_hashes(text, shingle, seed)
    return _vote(hashes) if len(hashes) else 0


def _vote(hashes: np.ndarray) -> int:
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint as a signed long. Null texts have no words."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = np.array([fingerprint(t, shingle) if t else 0 for t in frame["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": frame["id"], "fp": found.view(np.int64)})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(of, f"id {id_type}, fp long")


def neighbours(radius: int, parts: int = 4) -> list[tuple[int, ...]]:
    """Differences of population counts within the radius, one of each pair of opposites."""
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return [d for d in steps if d >= (0,) * parts]


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool, rows: int = 1 << 18) -> list[tuple[int, int]]:
    """Links between two tiles' fingerprints within the radius, reduced to a spanning forest: index pairs (of a, of b)."""
    label = np.arange(len(a) + len(b))
    if same:
        label[len(a) :] = label[: len(a)]
    out: list[tuple[int, int]] = []
    step = max(1, rows // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        if same:
            near &= np.arange(at, at + len(near))[:, None] < np.arange(len(b))[None, :]
        for i in np.flatnonzero(near.any(axis=1)):
            own = at + int(i)
            js = np.flatnonzero(near[i])
            labels = label[len(a) + js]
            first = np.unique(labels, return_index=True)
            for other, k in zip(*first, strict=True):
                if other != label[own]:
                    out.append((own, int(js[k])))
                    label[label == other] = label[own]
    return out


def links_within(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect the same distinct fingerprints as all pairs within the radius do.

    prints: (node, fp), with distinct fp; a and b are nodes.
    """
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    keyed = prints.select("node", "fp", *(quarter(k).alias(f"q{k}") for k in range(4)))
    key = ["q0", "q1", "q2", "q3"]
    # 17 ** 4 keys at most: the directory has a fixed bound, and says how many tiles a crowded key needs
    directory = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    dealt = keyed.join(F.broadcast(directory), key).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiles = dealt.groupBy(*key, "tile").agg(F.sort_array(F.collect_list(F.struct("fp", "node"))).alias("own"))
    tiles = materialize(tiles.select(*key, "tile", F.col("own.fp").alias("fps"), F.col("own.node").alias("nodes")), "tiles")
    steps = F.array(*(F.array(*map(F.lit, d)) for d in neighbours(radius)))
    probe = tiles.withColumn("step", F.explode(steps)).select(
        *((F.col(q) + F.col("step")[k]).alias(q) for k, q in enumerate(key)),
        F.col("tile").alias("tile_a"), F.col("fps").alias("fps_a"), F.col("nodes").alias("nodes_a"), F.forall("step", lambda x: x == 0).alias("same"),
    )
    # the larger frame, of tiles times steps, meets only keys that exist
    pairs = probe.join(tiles, key).where(~F.col("same") | (F.col("tile_a") <= F.col("tile"))).select("fps_a", "nodes_a", "fps", "nodes", (F.col("same") & (F.col("tile_a") == F.col("tile"))).alias("same"))
    node_type = prints.schema["node"].dataType.simpleString()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            a, b = [], []
            for fa, na, fb, nb, same in frame.itertuples(index=False):
                for i, j in forest(np.asarray(fa, dtype=np.int64).view(np.uint64), np.asarray(fb, dtype=np.int64).view(np.uint64), radius, same):
                    a.append(na[i])
                    b.append(nb[j])
            yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return pairs.mapInPandas(compare, f"a {node_type}, b {node_type}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) of each row: the smallest id that links within the radius reach.

    Null and empty texts have the fingerprint zero and link to one another like any other equal fingerprints; repeated
    rows each give a row; rows with a null id have a null component unless their fingerprint equals another's; other
    columns are ignored; an empty table gives an empty frame. Ids are whole numbers.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("node"))
    distinct = materialize(distinct.select("fp", F.col("node").cast("long").alias("node")), "distinct")
    found = connected_components(links_within(distinct.where(F.col("node").isNotNull()), radius))
    groups = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(groups, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document (three-word shingles)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs, shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_prints(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, set, n, f0.., prefix) of (doc_id, text) rows: a digest of the set of the text's word shingles, its size, its wide
    fingerprint, and those of its hashes, the smallest ones, of which a set so similar has one among its own."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for i, text in zip(frame["id"], frame["text"], strict=True):
                own = shingle_set(text, shingle)
                bits = np.zeros(64 * WIDE, dtype=np.int64)
                for at in range(0, len(own), 1 << 14):
                    part = own[at : at + (1 << 14)].view(np.uint64)
                    part = np.stack([mixed(part ^ seed) for seed in WIDE_SEEDS], axis=1).astype("<u8")
                    bits += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                fp = np.packbits(bits * 2 > len(own), bitorder="little").view("<i8")
                least = int(np.ceil(similarity * len(own) - 1e-9))
                rows.append((i, xxhash.xxh64_intdigest(own.tobytes()) - 2**63, len(own), *fp.tolist(), own[: len(own) - least + 1] if len(own) else own))
            yield pd.DataFrame(rows, columns=["id", "set", "n", *WIDE_COLUMNS, "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").alias("id"), "text").mapInPandas(of, f"id {kind}, set long, n int, {', '.join(f'{c} long' for c in WIDE_COLUMNS)}, prefix array<long>")


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct word shingles, as signed longs in order; of all its words if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(shingle, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = out * PRIME + own[k : k + len(out)]
    return np.unique(mixed(out).view(np.int64))


def near_pairs(a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: bool, radius: int, similarity: float, rows: int = 1 << 16) -> list[tuple[int, int]]:
    """Pairs of nodes of two tiles whose fingerprints differ in no more bits, whose components differ, and whose sets may be similar enough by
    their sizes and the places of the common hash. Tiles whose population counts differ beyond the radius are skipped."""
    count = lambda x: np.bitwise_count(x["fps"]).sum(axis=1)
    ca, cb = count(a), count(b)
    if max(ca.min() - cb.max(), cb.min() - ca.max()) > radius:
        return []
    out: list[tuple[int, int]] = []
    step = max(1, rows // len(b["node"]))
    for at in range(0, len(a["node"]), step):
        x = {k: v[at : at + step] for k, v in a.items()}
        bits = sum(np.bitwise_count(x["fps"][:, w, None] ^ b["fps"][None, :, w]).astype(np.int64) for w in range(WIDE))
        n, m, i, j = x["n"][:, None], b["n"][None, :], x["at"][:, None], b["at"][None, :]
        common = np.minimum(i, j) + np.minimum(n - i, m - j)
        near = (bits <= radius) & (x["component"][:, None] != b["component"][None, :]) & (common * (1 + similarity) >= similarity * (n + m) - 1e-9)
        if same:
            near &= np.arange(at, at + len(near))[:, None] < np.arange(len(b["node"]))[None, :]
        for p, q in zip(*np.nonzero(near), strict=True):
            out.append((int(x["node"][p]), int(b["node"][q])))
    return out


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS) -> DataFrame:
    """(doc_id, component_id) of each row: the smallest id that links of so similar shingle sets reach.

    Equal sets collapse. Sets so similar have a hash in common among the first of either, and wide fingerprints within the
    radius (all but one in a million: the share of differing bits is the angle between the sets); what is left is verified on the
    whole sets. The documents of a hash are compared with its first one, then tile by tile with those that aren't in their component yet.
    """
    prints = materialize(set_prints(docs, shingle, similarity), "prints")
    distinct = prints.groupBy("set").agg(F.min("id").cast("long").alias("node"), *(F.first(c).alias(c) for c in ("n", *WIDE_COLUMNS, "prefix")))
    distinct = materialize(distinct, "distinct")
    full = distinct.where("node is not null and n > 0")
    prefix = materialize(full.select("node", F.posexplode("prefix").alias("at", "hash")), "prefix")
    rows = shared_rows(prefix, "hash", "node").select("hash", "node", "at", "size")
    rows = materialize(rows.join(full.select("node", "n", *WIDE_COLUMNS), "node"), "rows")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node is not null")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lru_cache(maxsize=64)(lambda text: shingle_set(text, shingle))
        for frame in batches:
            good = []
            for text, rep_text in zip(frame["text"], frame["rep_text"], strict=True):
                own, other = read(text), read(rep_text)
                both = len(np.intersect1d(own, other, assume_unique=True))
                good.append(both >= similarity * (len(own) + len(other) - both) - 1e-9)
            yield frame.loc[np.array(good, dtype=bool), ["a", "b"]]

    def verified(pairs: DataFrame) -> DataFrame:
        few = F.broadcast if pairs.count() <= BROADCAST_ROWS else (lambda frame: frame)
        one = texts.join(few(pairs), F.col("node") == F.col("b")).select("a", "b", "text")
        other = texts.join(few(pairs.select("a").distinct()), F.col("node") == F.col("a"), "left_semi").select(F.col("node").alias("a"), F.col("text").alias("rep_text"))
        with batches_of(docs.sparkSession, PAIRS):
            return materialize(one.join(other, "a").select("a", "b", "text", "rep_text").mapInPandas(verify, "a long, b long").distinct(), "similar")

    first = rows.groupBy("hash").agg(F.min(F.struct("node", "at", "n", *WIDE_COLUMNS)).alias("first"), F.count(F.lit(1)).alias("rows"))
    met = keyed_join(rows, materialize(first, "first"), ["hash"], "rows").where("node <> first.node")
    bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"first.{c}"))) for c in WIDE_COLUMNS), F.lit(0))
    common = F.least("at", "first.at") + F.least(F.col("n") - F.col("at"), F.col("first.n") - F.col("first.at"))
    met = met.where((bits <= radius) & (common * (1 + similarity) >= F.lit(similarity) * (F.col("n") + F.col("first.n")) - 1e-9))
    tried = materialize(met.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    starred = verified(tried)
    known = connected_components(starred)
    left = rows.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("tile", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / TILE)).cast("int"))
    left = materialize(left, "left")
    several = left.groupBy("hash").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("hash")
    names = ["node", "at", "n", "component", *WIDE_COLUMNS]
    tiles = left.groupBy("hash", "tile").agg(F.collect_list(F.struct(*names)).alias("own"))
    tiles = materialize(tiles.join(several, "hash").select("hash", "tile", *(F.col(f"own.{c}").alias(c) for c in names)), "tiles")
    other = tiles.select("hash", *(F.col(c).alias(f"other_{c}") for c in ("tile", *names)))
    both = tiles.join(other, "hash").where("tile <= other_tile").where((F.col("tile") != F.col("other_tile")) | (F.size("node") > 1))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.to_dict("records"):
                a, b = ({c: np.asarray(r[side + c]) for c in names} for side in ("", "other_"))
                for x in (a, b):
                    x["fps"] = np.stack([x[c].view(np.uint64) for c in WIDE_COLUMNS], axis=1)
                out += near_pairs(a, b, r["tile"] == r["other_tile"], radius, similarity)
            pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)}).drop_duplicates()

    pairs = both.mapInPandas(compare, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    found = connected_components(starred.unionByName(verified(materialize(pairs, "pairs"))))
    groups = distinct.join(found, "node", "left").select("set", F.coalesce("component", "node").alias("component_id"))
    return prints.select("id", "set").join(groups, "set", "left").select(F.col("id").alias("doc_id"), "component_id")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of similar ones stays, the one with the smallest id; rows without an id stay."""
    groups = similar_documents(docs.select("doc_id", "text"))
    gone = groups.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
