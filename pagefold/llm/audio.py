"""Chroma audio fingerprints for media columns.

A recording (a WAV file's bytes, or a fault that makes it empty) becomes frames of twelve pitch-class energies. Sixteen filters
compare sums of rectangles of this image, read off its integral image; each comparison is quantised to two bits, so a
frame is one packed 32-bit integer. Recordings are aligned by an offset histogram of equal keys (the outer bits of three frames)
and accepted by the share of differing bits over the overlap at the best offset.

Equal fingerprints collapse first. All recordings that hold a key are compared with one another in tiles, as numpy arrays of the
frames around the key, whatever they were linked with before. Where both stand there whole, the tile decides at this offset, and a
pair leaves it at the first key that votes for the offset only; pairs of longer recordings, and those in which the key stands at
several places, all leave the tile and are aligned whole. So each link between different recordings is found and counted. A pair whose
common keys all vote for one offset is found once only, so of those a tile gives the number for each recording and which are
connected, a few rows for each member of a large group.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialize, shared_rows, worker_cache
from .components import connected_components

#: Frames: samples a second after resampling by whole steps, samples of a frame and from one to the next.
RATE, FRAME, HOP = 4000, 1024, 512
LOWEST, HIGHEST = 110.0, 1760.0
CLASSES = 12
#: Frames that a filter may span.
SPAN = 4
#: Logarithm of the ratio beyond which a comparison is clear.
CLEAR = 0.25
#: Frames between the three that make a key.
STEP = 5
#: Equal keys at one offset that make a candidate, frames of overlap and share of differing bits that make a match.
VOTES, OVERLAP, ERRORS = 2, 20, 0.2
#: Frames on either side of a key that a tile holds.
AROUND = 48
#: Recordings of a tile that is compared together with others; recordings of a tile on average; pairs that are compared at a time.
DIRECT, TILE, PAIRS = 16, 1024, 1 << 13


def decode_wave(data: bytes | None) -> np.ndarray:
    """Mono samples at about RATE; empty for null, broken or unsupported data."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            channels, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
            raw = w.readframes(w.getnframes())
        if width not in (1, 2) or not rate:
            return np.empty(0)
        x = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], dtype="<i2" if width == 2 else np.uint8).astype(np.float64)
        x = (x - (128 if width == 1 else 0)).reshape(-1, channels).mean(axis=1)
        step = max(1, round(rate / RATE))
        return x[: len(x) // step * step].reshape(-1, step).mean(axis=1) if step > 1 else x
    except (wave.Error, EOFError, ValueError):
        return np.empty(0)


def _bands() -> np.ndarray:
    """Shares of spectrum bins in the pitch classes."""
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(hertz), CLASSES))
    for k, f in enumerate(hertz):
        if LOWEST <= f <= HIGHEST:
            out[k, round(12 * np.log2(f / 440.0)) % CLASSES] = 1
    return out


BANDS = _bands()
WINDOW = np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energies of the pitch classes of each frame, relative to the frame's own."""
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    if n <= 0:
        return np.empty((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    power = np.abs(np.fft.rfft(frames * WINDOW, axis=1)) ** 2 @ BANDS
    return power / (power.sum(axis=1, keepdims=True) + 1e-9) + 1e-4


def _filters() -> list[tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]]:
    """Sixteen pairs of rectangle lists (first frame, end frame, first class, end class) that are compared."""
    out = []
    for k in range(16):
        y, height, half = (5 * k) % CLASSES, 2 + k % 3, SPAN // 2
        low, mid, top = y, y + height, y + 2 * height
        if k % 4 == 0:
            pair = [(0, SPAN, low, mid)], [(0, SPAN, mid, top)]
        elif k % 4 == 1:
            pair = [(0, half, low, top)], [(half, SPAN, low, top)]
        elif k % 4 == 2:
            pair = [(0, half, low, mid), (half, SPAN, mid, top)], [(0, half, mid, top), (half, SPAN, low, mid)]
        else:
            pair = [(0, SPAN, low, low + height)], [(0, SPAN, top, top + height)]
        out.append(pair)
    return out


FILTERS = _filters()


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One packed 32-bit integer for each position of the filters."""
    image = chroma(samples)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    wide = np.hstack([image, image, image])  # pitch classes are a circle
    total = np.zeros((len(wide) + 1, wide.shape[1] + 1))
    total[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)
    area = lambda t0, t1, y0, y1: total[t1 : t1 + n, y1] - total[t0 : t0 + n, y1] - total[t1 : t1 + n, y0] + total[t0 : t0 + n, y0]
    out = np.zeros(n, dtype=np.uint32)
    for k, (one, other) in enumerate(FILTERS):
        x = np.log(sum(area(*r) for r in one)) - np.log(sum(area(*r) for r in other))
        outer, inner = (x > 0).astype(np.uint32), (np.abs(x) < CLEAR).astype(np.uint32)
        out |= outer << np.uint32(16 + k) | inner << np.uint32(k)
    return out


def keys_of(prints: np.ndarray) -> np.ndarray:
    """Key of each frame that has two more at the steps after it: the outer bits of the three, as a signed long."""
    n = len(prints) - 2 * STEP
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    outer = (prints >> np.uint32(16)).astype(np.int64)
    return outer[:n] | outer[STEP : STEP + n] << 16 | outer[2 * STEP : 2 * STEP + n] << 32


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(offset, votes, share of differing bits): frame i of a lies at i - offset of b. No common key: no votes and all bits differ."""
    ka, kb = keys_of(a), keys_of(b)
    order = np.argsort(kb, kind="stable")
    lo, hi = np.searchsorted(kb[order], ka, side="left"), np.searchsorted(kb[order], ka, side="right")
    offsets = np.repeat(np.arange(len(ka)), hi - lo) - order[np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)] or [np.empty(0, dtype=np.int64)]).astype(np.int64)]
    if not len(offsets):
        return 0, 0, 1.0
    values, votes = np.unique(offsets, return_counts=True)
    best = None
    for offset, n in zip(values, votes, strict=True):
        x, y = a[max(0, offset) :], b[max(0, -offset) :]
        size = min(len(x), len(y))
        if size:
            found = (int(n) >= VOTES and size >= OVERLAP, -float(np.bitwise_count(x[:size] ^ y[:size]).sum() / (32 * size)), int(n), int(offset))
            best = found if best is None or found > best else best
    return best[3], best[2], -best[1]


def matches(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two fingerprints are of one recording."""
    offset, votes, errors = align(a, b)
    size = min(len(a) - max(0, offset), len(b) - max(0, -offset))
    return votes >= VOTES and size >= min(OVERLAP, len(a), len(b)) and errors <= ERRORS


def audio_fingerprints(media: DataFrame, id_col: str, audio_col: str, load: Callable[[object], bytes | None] | None = None) -> DataFrame:
    """(id, fingerprint array<int>) of each row; empty for null, broken and very short recordings.

    load turns a column's value into a file's bytes where the column holds something else, such as what to render.
    """
    load = load or (lambda x: x)
    id_type = media.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"id": frame["id"], "fingerprint": [fingerprint(decode_wave(load(x))).view(np.int32) for x in frame["audio"]]})

    return media.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio")).mapInPandas(of, f"id {id_type}, fingerprint array<int>").withColumnRenamed("id", id_col)


def around_key(prints: np.ndarray, at: int) -> tuple[int, int, bytes]:
    """Frames before and after a key's first one that are held, at most AROUND each, and the frames, padded so that the key stands in the middle."""
    low, high = min(at, AROUND), min(len(prints) - 1 - at, AROUND)
    out = np.zeros(2 * AROUND + 1, dtype="<u4")
    out[AROUND - low : AROUND + high + 1] = prints[at - low : at + high + 1]
    return low, high, out.tobytes()


def close_pairs(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of a key's recordings may match: exactly those with a match's share of bits and overlap at the key's offset
    if both are held whole, else all. x: frames, low, high (held on either side) and size of each recording."""
    out = np.zeros(len(i), dtype=bool)
    place = np.arange(2 * AROUND + 1)
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        low, high = np.minimum(x["low"][a], x["low"][b]), np.minimum(x["high"][a], x["high"][b])
        held = (place >= AROUND - low[:, None]) & (place <= AROUND + high[:, None])
        bits = (np.bitwise_count(x["frames"][a] ^ x["frames"][b]) * held).sum(axis=1, dtype=np.int64)
        overlap = low + high + 1
        whole = (x["low"] + x["high"] + 1 == x["size"])[a] & (x["low"] + x["high"] + 1 == x["size"])[b]
        enough = overlap >= np.minimum(OVERLAP, np.minimum(x["size"][a], x["size"][b]))
        out[at : at + PAIRS] = ~whole | enough & (bits <= ERRORS * 32 * overlap)
    return out


def votes_at(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs that are held whole: the votes for the key's offset, and whether the key is the first one that votes for it."""
    votes, first = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=bool)
    place = np.arange(2 * AROUND + 1)
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        low, high = np.minimum(x["low"][a], x["low"][b]), np.minimum(x["high"][a], x["high"][b])
        same = ((x["frames"][a] ^ x["frames"][b]) >> np.uint32(16) == 0) & (place >= AROUND - low[:, None]) & (place <= AROUND + high[:, None])
        vote = same[:, : -2 * STEP] & same[:, STEP:-STEP] & same[:, 2 * STEP :]
        votes[at : at + PAIRS], first[at : at + PAIRS] = vote.sum(axis=1), ~vote[:, :AROUND].any(axis=1)
    return votes, first


def common_keys(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many pairs of equal keys, at any offset, pairs of recordings have that are held whole."""
    outer = (x["frames"] >> np.uint32(16)).astype(np.int64)
    keys = outer[:, : -2 * STEP] | outer[:, STEP:-STEP] << 16 | outer[:, 2 * STEP :] << 32
    place = np.arange(keys.shape[1])
    own = (place >= AROUND - x["low"][:, None]) & (place + 2 * STEP <= AROUND + x["high"][:, None])
    out, some = np.zeros(len(i), dtype=np.int64), np.flatnonzero(own.any(axis=0))
    keys, own = keys[:, some], own[:, some]
    for at in range(0, len(i), PAIRS >> 4):
        a, b = i[at : at + (PAIRS >> 4)], j[at : at + (PAIRS >> 4)]
        out[at : at + len(a)] = ((keys[a][:, :, None] == keys[b][:, None, :]) & own[a][:, :, None] & own[b][:, None, :]).sum(axis=(1, 2))
    return out


def least_connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least one that pairs connect it with."""
    out = np.arange(n)
    while len(i):
        before = out.copy()
        np.minimum.at(out, i, out[j])
        np.minimum.at(out, j, out[i])
        out = out[out]
        if (out == before).all():
            break
    return out


def recording_classes(media: DataFrame, id_col: str, audio_col: str, load: Callable[[object], bytes | None] | None = None) -> DataFrame:
    """(id, fingerprint, class_id, n_links) of each row: the smallest id of the recordings that matches connect (null for a
    null id without equals), and the number of different fingerprints that it matches.

    Rows with an empty fingerprint are one class each; equal rows share a class; other columns are ignored; an empty table
    gives an empty frame. Ids are whole numbers.
    """
    prints = materialize(audio_fingerprints(media, id_col, audio_col, load).withColumnRenamed(id_col, "id").withColumn("print", F.xxhash64("fingerprint")), "prints")
    distinct = prints.where(F.size("fingerprint") > 0).groupBy("print").agg(F.min("id").cast("long").alias("node"), F.min("fingerprint").alias("fingerprint")).where("node is not null")
    distinct = materialize(distinct, "recordings")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for node, fp in zip(frame["node"], frame["fingerprint"], strict=True):
                keys = keys_of(np.asarray(fp, dtype=np.int32).view(np.uint32))
                _, fresh, n = np.unique(keys, return_index=True, return_counts=True)  # a key that is held long or repeats is one row
                yield pd.DataFrame({"key": keys[fresh], "at": fresh.astype(np.int32), "again": n > 1, "node": np.int64(node)})

    keys = materialize(distinct.select("node", "fingerprint").mapInPandas(keyed, "key long, at int, again boolean, node long"), "keys")
    shared = materialize(shared_rows(keys, "key", "node").select("key", "at", "again", "node", "size"), "shared")

    @F.pandas_udf("low int, high int, frames binary")
    def held(prints: pd.Series, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([around_key(np.asarray(p, dtype=np.int32).view(np.uint32), k) for p, k in zip(prints, at, strict=True)], columns=["low", "high", "frames"])

    names = ["node", "again", "low", "high", "size", "frames"]

    def tiled(rows: DataFrame) -> DataFrame:
        """(key, tile, arrays) of rows (key, at, again, node, size), where size counts the key's rows."""
        tile = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / TILE)).cast("int")
        full = rows.withColumn("tile", tile).join(distinct.select("node", "fingerprint"), "node")
        full = full.select("key", "tile", "node", "again", F.size("fingerprint").alias("size"), held("fingerprint", "at").alias("held")).select("key", "tile", "node", "again", "size", "held.*")
        tiles = full.groupBy("key", "tile").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("own"))
        return tiles.select("key", "tile", *(F.col(f"own.{c}").alias(c) for c in names))

    def arrays(frame: pd.DataFrame, side: str = "") -> dict[str, np.ndarray]:
        out = {c: np.concatenate([*frame[side + c]]) for c in names[:-1]}
        out["frames"] = np.frombuffer(b"".join(x for own in frame[side + "frames"] for x in own), dtype="<u4").reshape(-1, 2 * AROUND + 1)
        return out

    def found(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        """Pairs (node, rep) that may match, and whether they surely do; of those that no other tile or key gives, only (node, rep) that are
        connected (n is 0) and how many each node has (n, without rep)."""
        some = x["again"][i] | x["again"][j]
        some[~some] = close_pairs(x, i[~some], j[~some])
        i, j = i[some], j[some]
        exact = x["low"] + x["high"] + 1 == x["size"]
        exact = exact[i] & exact[j] & ~x["again"][i] & ~x["again"][j]
        votes, first = votes_at(x, i[exact], j[exact])
        wanted = np.ones(len(i), dtype=bool)
        wanted[exact] = first & (votes >= VOTES)
        sure = exact & (np.minimum(x["size"][i], x["size"][j]) >= OVERLAP)
        i, j, sure, votes = i[wanted], j[wanted], sure[wanted], votes[wanted[exact]]
        once, firm = np.zeros(len(i), dtype=bool), np.flatnonzero(exact[wanted])
        held = np.maximum(x["size"][i[firm]], x["size"][j[firm]]) <= AROUND + 1  # whole around any key
        once[firm] = sure[firm] & held & (votes == common_keys(x, i[firm], j[firm]))
        own, place = np.unique(x["node"], return_inverse=True)  # a frame may hold several keys of a recording
        least = least_connected(len(own), place[i[once]], place[j[once]])
        count = np.bincount(np.concatenate([place[i[once]], place[j[once]]]), minlength=len(own))
        joined, counted = np.flatnonzero(least < np.arange(len(own))), np.flatnonzero(count)
        a, b = x["node"][i[~once]], x["node"][j[~once]]
        parts = [(np.maximum(a, b), np.minimum(a, b), sure[~once], [None]), (own[joined], own[least[joined]], True, [0]), (own[counted], None, True, count[counted])]
        return pd.concat([pd.DataFrame({"node": u, "rep": pd.array(v if v is not None else [None] * len(u), dtype="Int64"), "sure": y, "n": pd.array(n if len(n) == len(u) else list(n) * len(u), dtype="Int64")}) for u, v, y, n in parts])

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            sizes = frame["node"].map(len)
            small = frame[sizes <= DIRECT]
            if len(small):
                n = sizes[sizes <= DIRECT].to_numpy()
                parts = [np.array(np.tril_indices(k, -1)) + at for k, at in zip(n, n.cumsum() - n, strict=True)]
                yield found(arrays(small), *np.hstack(parts))
            for k in np.flatnonzero(sizes > DIRECT):
                yield found(arrays(frame.iloc[k : k + 1]), *np.tril_indices(sizes.iloc[k], -1))

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for k in range(len(frame)):
                a, b = arrays(frame.iloc[k : k + 1]), arrays(frame.iloc[k : k + 1], "other_")
                n, m = len(a["node"]), len(b["node"])
                yield found({c: np.concatenate([a[c], b[c]]) for c in names}, np.repeat(np.arange(n), m), n + np.tile(np.arange(m), n))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            good = [matches(np.asarray(a, dtype=np.int32).view(np.uint32), np.asarray(b, dtype=np.int32).view(np.uint32)) for a, b in zip(frame["fa"], frame["fb"], strict=True)]
            yield frame.loc[np.array(good, dtype=bool), ["node", "rep"]]

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(distinct.select("node", F.col("fingerprint").alias("fa")), "node").join(distinct.select(F.col("node").alias("rep"), F.col("fingerprint").alias("fb")), "rep")
        return materialize(both.select("node", "rep", "fa", "fb").mapInPandas(verify, "node long, rep long"), "matches")

    kind = "node long, rep long, sure boolean, n long"
    with batches_of(media.sparkSession, 64):
        pairs = tiled(shared).mapInPandas(within, kind)
        large = shared.where(F.col("size") > TILE)
        if not large.isEmpty():
            large = materialize(tiled(large), "tiles")
            other = large.select("key", *(F.col(c).alias(f"other_{c}") for c in ("tile", *names)))
            pairs = pairs.unionByName(large.join(other, "key").where("tile < other_tile").mapInPandas(between, kind))
        pairs = materialize(pairs.groupBy("node", "rep", F.col("n").isNull().alias("pair")).agg(F.max("sure").alias("sure"), F.sum("n").alias("n")), "pairs")
    links = materialize(pairs.where("pair and sure").select("node", "rep").unionByName(verified(pairs.where("pair and not sure").select("node", "rep"))), "links")
    found_classes = connected_components(links.unionByName(pairs.where("not pair and rep is not null").select("node", "rep")), "node", "rep")
    degree = links.select(F.explode(F.array("node", "rep")).alias("node"), F.lit(1).cast("long").alias("n")).unionByName(pairs.where("not pair and rep is null").select("node", "n"))
    degree = degree.groupBy("node").agg(F.sum("n").alias("n_links"))
    known = distinct.select("print", "node").join(found_classes, "node", "left").join(degree, "node", "left").select("print", F.coalesce("component", "node").alias("class"), "n_links")
    out = prints.join(known, "print", "left")
    return out.select(F.col("id").alias(id_col), "fingerprint", F.coalesce("class", F.col("id").cast("long")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def tones(steps: int) -> np.ndarray:
    """A sine of each pitch class over so many steps, (class, step, sample); a worker keeps the last ones."""
    cache = worker_cache()
    if cache.get("tones", (0,))[0] != steps:
        hertz = 440.0 * 2 ** ((np.arange(CLASSES) - 9)[:, None] / 12)
        cache["tones"] = steps, np.sin(2 * np.pi * hertz * np.arange(HOP * steps)[None, :] / RATE).reshape(CLASSES, steps, HOP)
    return cache["tones"][1]


def render(vector: list[float] | None) -> bytes | None:
    """A vector as a WAV file: for each of its runs of twelve numbers a step in which each pitch class is as loud as its number says."""
    if vector is None or not len(vector):
        return None
    v = np.nan_to_num(np.asarray(vector, dtype=np.float64), posinf=0, neginf=0)
    scale = np.sqrt((v**2).mean()) or 1.0
    loud = np.exp(0.5 * np.lib.stride_tricks.sliding_window_view(np.pad(v / scale, (0, max(0, CLASSES - len(v)))), CLASSES).clip(-8, 8))
    steps = np.einsum("fc,cfn->fn", loud, tones(len(loud))).ravel()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((steps / np.abs(steps).max() * 30_000).astype("<i2").tobytes())
    return out.getvalue()


def op6_audio_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and classes of the recordings rendered from all embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return recording_classes(vectors, "vec_id", "embedding", load=render)
