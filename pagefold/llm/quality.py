"""Quality classifier by co-training.

Two views of a document see different things: its text (hashed word beginnings, word shapes, repetition) and its page
metadata (language, source, size). For each target a logistic model of each view starts from the labelled rows; in each
round both views name the unlabelled documents they are surest of, and the other view learns from those pseudo-labels.
Each view is then calibrated on labelled rows that it never learnt from, and the calibrated log-odds are combined by a last
small model on the same rows. Fitting uses a bounded, documented sample (``LABELLED`` and ``UNLABELLED`` rows, spread by
hash, of ``CHARS`` characters together at most), so it costs the same at any size, and the driver holds four bytes for each feature of the
sample, which it reads a partition at a time; scoring is one narrow pass over all documents with weights of a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Labelled rows that the models are fitted and calibrated on, and rows that co-training may give pseudo-labels.
LABELLED = 12_000
UNLABELLED = 4_000
#: Characters of either sample's texts: rows beyond it, in the order of the hash, are left out. A text has a few features for each word.
CHARS = 48_000_000
#: A word is seen whole and by its first bytes, so long words and inflected forms of one share features.
BEGINNINGS = (64, 8, 7, 6, 5, 4, 3)
#: Features that are looked at together.
FEATURES = 1 << 20
#: Hashed features of the text view: words, then shapes and repetition; and of the metadata view.
WORDS = 1 << 18
SHAPES = 1 << 8
META = 1 << 8
#: What a word feature that is present counts: a text has about fifty of those that matter.
WORD_VALUE = float(1 / np.sqrt(50))
ROUNDS = 3
#: Pseudo-labels that a view may give for each class in a round, and how sure it has to be.
NAMED = 200
SURE = 0.97
#: Least likelihood-ratio statistic of a feature that is used: one in a thousand by chance.
EVIDENCE = 10.83
#: A document is kept unless it is this likely to be of low quality or toxic.
REJECT = 0.5

SHAPE = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c > 127 else ord("0") if 48 <= c <= 57 else c for c in range(256))
RUN = re.compile(rb"(.)\1+")
EDGE = b".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~^@`"


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the word features that are present, and the shape features: square roots of the shares of shapes, of repeats and of rare-word signs."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    shapes = np.zeros(SHAPES, dtype=np.float32)
    if not words:
        shapes[0] = 1.0
        return np.empty(0, dtype=np.int32), shapes
    distinct = set(words)
    begun, all_begun = {w.strip(EDGE).lower() for w in distinct}, set()
    for n in BEGINNINGS:
        begun = {w[:n] for w in begun}
        all_begun |= begun
    crc = zlib.crc32
    found = np.unique(np.fromiter(map(crc, all_begun), dtype=np.uint32, count=len(all_begun)) & np.uint32(WORDS - 1)).astype(np.int32)
    for shape, n in Counter(text.encode("utf-8", "surrogatepass").translate(SHAPE).split()).items():
        shapes[1 + crc(RUN.sub(rb"\1", shape)) % (SHAPES - 4)] += n / len(words)
    shapes[SHAPES - 3] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    shapes[SHAPES - 2] = 1 - len(distinct) / len(words)
    shapes[SHAPES - 1] = min(1.0, np.log1p(len(words)) / 10)
    return found, np.sqrt(shapes)


def meta_features(values: dict[str, object]) -> np.ndarray:
    """Each column's value as a hashed feature; numbers by their order of magnitude. Nulls are a value of their own."""
    out = [0]
    for name, v in values.items():
        if isinstance(v, (int, float, np.integer, np.floating)) and not (isinstance(v, float) and np.isnan(v)):
            v = f"2^{int(np.log2(1 + abs(float(v))))}"
        out.append(1 + zlib.crc32(f"{name}={v}".encode()) % (META - 1))
    return np.array(out, dtype=np.int32)


class Rows:
    """Rows of features that are present, all of one value, and of dense ones after them; numpy products take so many features at a time."""

    def __init__(self, sparse: list[np.ndarray], width: int, value: float = 1.0, dense: np.ndarray | None = None):
        self.sizes = np.array([len(x) for x in sparse], dtype=np.int64)
        self.index = np.concatenate([*sparse, np.empty(0, dtype=np.int32)])
        self.value, self.n = value, len(sparse)
        self.dense = np.zeros((self.n, 0), dtype=np.float32) if dense is None else dense
        self.sparse_width, self.width = width, width + self.dense.shape[1]

    def parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, sizes, features) of runs of rows."""
        ends = np.cumsum(self.sizes)
        at = 0
        while at < self.n:
            begin = int(ends[at] - self.sizes[at])
            to = max(at + 1, int(np.searchsorted(ends, begin + FEATURES, side="right")))
            yield slice(at, to), self.sizes[at:to], self.index[begin : int(ends[to - 1])]
            at = to

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = self.dense @ weights[self.sparse_width :]
        for rows, sizes, index in self.parts():
            out[rows] += self.value * np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights[index], len(sizes))
        return out

    def transposed(self, x: np.ndarray, value: float | None = None) -> np.ndarray:
        out = np.zeros(self.width)
        out[self.sparse_width :] = x @ self.dense
        for rows, sizes, index in self.parts():
            out[: self.sparse_width] += np.bincount(index, np.repeat(x[rows], sizes), self.sparse_width)
        out[: self.sparse_width] *= self.value if value is None else value
        return out

    def presence(self, x: np.ndarray) -> np.ndarray:
        """Sum of x over the rows that hold each feature."""
        out = self.transposed(x, 1.0)
        out[self.sparse_width :] = x @ (self.dense != 0)
        return out

    def squares(self, by: np.ndarray) -> np.ndarray:
        """Sum of the squared values of each row, each times a factor of its feature."""
        out = (self.dense.astype(np.float64) ** 2) @ by[self.sparse_width :] ** 2
        for rows, sizes, index in self.parts():
            out[rows] += self.value**2 * np.bincount(np.repeat(np.arange(len(sizes)), sizes), by[index] ** 2, len(sizes))
        return out

    def only(self, wanted: np.ndarray, chosen: np.ndarray) -> Rows:
        """The chosen rows, without the sparse features that aren't wanted; what is left out is never copied."""
        out = Rows([], self.sparse_width, self.value, self.dense[chosen])
        index, n = [out.index], [out.sizes]
        for rows, sizes, found in self.parts():
            own = np.repeat(np.arange(len(sizes)), sizes)
            keep = wanted[found] & chosen[rows][own]
            index.append(found[keep])
            n.append(np.bincount(own[keep], minlength=len(sizes))[chosen[rows]])
        out.index, out.sizes, out.n, out.width = np.concatenate(index), np.concatenate(n), int(chosen.sum()), self.width
        return out


def _xlog(x, expected):
    return x * np.log(np.maximum(x, 1e-12) / np.maximum(expected, 1e-12))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, rows: Rows) -> np.ndarray:
        return rows.times(self.weights) + self.bias


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray, penalty: float = 0.01, steps: int = 200, smooth: float = 0.5) -> Linear:
    """Logistic regression on features scaled by their log-count ratios, by accelerated gradient steps; rows without weight are as if they weren't there."""
    used = weight > 0
    positive, negative = weight * y, weight * (1 - y)
    p, q = rows.transposed(positive) + smooth, rows.transposed(negative) + smooth
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # only features whose rows differ in label beyond chance: the likelihood-ratio statistic of presence against label
    a, b = rows.presence(positive), rows.presence(negative)
    share = positive.sum() / max(positive.sum() + negative.sum(), 1e-9)
    evidence = 2 * (_xlog(a, (a + b) * share) + _xlog(b, (a + b) * (1 - share)))
    ratio[(evidence < EVIDENCE) & (rows.presence(used.astype(np.float64)) < used.sum())] = 0
    few, y, weight = rows.only(ratio[: rows.sparse_width] != 0, used), y[used], weight[used]
    w, b, w0, b0 = np.zeros(rows.width), 0.0, np.zeros(rows.width), 0.0
    curve = 0.25 * float((weight * few.squares(ratio)).sum() + weight.sum()) / 4 + penalty
    for k in range(steps):
        v, c = w + k / (k + 3) * (w - w0), b + k / (k + 3) * (b - b0)
        error = weight * (_sigmoid(few.times(v * ratio) + c) - y)
        w0, b0 = w, b
        w = v - (few.transposed(error) * ratio + penalty * v) / curve
        b = c - error.sum() / curve
    return Linear(w * ratio, float(b))


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of the columns of x and a constant, by ridge-penalised Newton steps: Platt scaling for one column."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        ridge = np.eye(len(w)) * 1e-2
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


@dataclass
class Target:
    """Calibrated views of one target and how they combine. ``packed`` is what is sent to executors, which may not have this class."""

    text: Linear
    meta: Linear
    text_scale: np.ndarray
    meta_scale: np.ndarray
    mix: np.ndarray

    def packed(self) -> tuple:
        small = lambda m: (m.weights.astype(np.float32), m.bias)
        return small(self.text), small(self.meta), self.text_scale, self.meta_scale, self.mix

    @staticmethod
    def unpacked(packed: tuple) -> Target:
        return Target(Linear(*packed[0]), Linear(*packed[1]), *packed[2:])

    def probabilities(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale[0] * self.text.score(text) + self.text_scale[1]
        b = self.meta_scale[0] * self.meta.score(meta) + self.meta_scale[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def cotrain(text: Rows, meta: Rows, y: np.ndarray, part: np.ndarray) -> Target:
    """y: 0, 1 or -1 without a label. part: True for the labelled rows kept for calibration."""
    learn, held = np.flatnonzero((y >= 0) & ~part), np.flatnonzero((y >= 0) & part)
    free = np.flatnonzero(y < 0)
    guesses: list[dict[int, int]] = [{}, {}]  # what each view is told by the other
    views = [text, meta]
    models: list[Linear] = [None, None]
    for turn in range(ROUNDS + 1):
        for v in (0, 1):
            # rows are chosen by their weight, so the features aren't copied
            target, weight = np.maximum(y, 0).astype(np.float64), np.zeros(len(y))
            weight[learn] = 1.0
            for i, label in guesses[v].items():
                target[i], weight[i] = label, 0.5
            models[v] = fit(views[v], target, weight)
        if turn == ROUNDS or not len(free) or not len(held):
            break
        for v in (0, 1):
            scored = models[v].score(views[v])
            scale = calibrate(scored[held][:, None], y[held])
            p = _sigmoid(scale[0] * scored[free] + scale[1])
            ranked = np.lexsort((free, p))
            for label, best in ((0, ranked[:NAMED]), (1, ranked[::-1][:NAMED])):
                for k in best:
                    if (p[k] if label else 1 - p[k]) >= SURE:
                        guesses[1 - v][int(free[k])] = label
    if not len(held):
        held = learn
    a, b = models[0].score(text)[held], models[1].score(meta)[held]
    sa, sb = calibrate(a[:, None], y[held]), calibrate(b[:, None], y[held])
    mix = calibrate(np.column_stack([sa[0] * a + sa[1], sb[0] * b + sb[1]]), y[held])
    return Target(models[0], models[1], sa, sb, mix)


def text_rows(features: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
    return Rows([i for i, _ in features], WORDS, WORD_VALUE, np.array([d for _, d in features], dtype=np.float32).reshape(-1, SHAPES))


def fit_targets(sample: DataFrame, targets: tuple[str, ...]) -> dict[str, Target | None]:
    """sample: a written table of columns id, words, shapes, meta (packed numbers), part, and each target (0, 1 or missing); an id that is repeated counts once.

    The driver reads it by id, a partition at a time, and holds its features once, in arrays whose size is known before.
    """
    n, size, meta_size = sample.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in ("words", "meta"))).first()
    text, meta = Rows([], WORDS, WORD_VALUE), Rows([], META)
    text.index, meta.index = np.empty(size // 4, dtype=np.int32), np.empty(meta_size // 4, dtype=np.int32)
    text.sizes, meta.sizes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    text.n = meta.n = n
    text.dense, text.width, meta.dense = np.zeros((n, SHAPES), dtype=np.float32), WORDS + SHAPES, np.zeros((n, 0), dtype=np.float32)
    part, labels = np.zeros(n, dtype=bool), np.full((n, len(targets)), -1, dtype=np.int64)
    k, ends, last = 0, [0, 0], None
    for r in sample.sort("id").toLocalIterator():
        if r["id"] == last:
            continue
        last = r["id"]
        for v, (rows, packed) in enumerate(((text, r["words"]), (meta, r["meta"]))):
            found = np.frombuffer(packed, dtype=np.int32)
            rows.sizes[k] = len(found)
            rows.index[ends[v] : ends[v] + len(found)] = found
            ends[v] += len(found)
        text.dense[k] = np.frombuffer(r["shapes"], dtype=np.float32)
        part[k] = r["part"]
        labels[k] = [-1 if r[t] is None else r[t] for t in targets]
        k += 1
    for rows, end in ((text, ends[0]), (meta, ends[1])):
        rows.index, rows.sizes, rows.dense, rows.n = rows.index[:end], rows.sizes[:k], rows.dense[:k], k
    return {t: cotrain(text, meta, y, part[:k]) if (y >= 0).any() else None for t, y in zip(targets, labels[:k].T, strict=True)}


def _spread(frame: DataFrame, key: str, rows: int, chars: int) -> DataFrame:
    """At most so many (key, size) rows with so many characters together, by the hash of the key, as a frame of keys of a fixed bound.

    A first bound on the hash, from the count of all rows, leaves about twice as many; then each task keeps a heap of that size.
    """
    kind, total = frame.schema[key].dataType, frame.count()
    hashed = F.xxhash64(F.col(key), F.lit("sample"))
    near = frame if total <= 2 * rows else frame.where(hashed < int(-(2**63) + 2**64 * min(1.0, 2 * rows / total)))
    taken = near.orderBy(hashed, key).limit(rows).collect()
    ends = np.cumsum([r["size"] or 0 for r in taken])
    some = [(r[key],) for r, end in zip(taken, ends, strict=True) if end <= chars]
    return frame.sparkSession.createDataFrame(some, T.StructType([T.StructField(key, kind)]))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"),
    targets: tuple[str, ...] = ("quality", "toxic"), labelled: int = LABELLED, unlabelled: int = UNLABELLED, chars: int = CHARS,
) -> DataFrame:
    """Adds p_<target>, text_<target> and meta_<target> (probabilities of label 1) to every row of docs.

    Labels of one id that differ count as their rounded mean; null labels and labels of unknown ids are left out; a target
    without any label gets the probability 0.5. Null and empty texts have a feature of their own; null metadata is a value;
    repeated rows each get the same score; a text of any length is read whole; columns of those names are replaced; an empty
    table gives an empty frame.
    """
    spark = docs.sparkSession
    names = [c for c in meta_cols if c in docs.columns]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*(F.round(F.avg(t)).cast("int").alias(t) for t in targets))
    wanted = docs.select(F.col(id_col), F.col(text_col).alias("_text"), *names)
    sized = materialize(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.char_length(text_col)).alias("size")), "sizes")
    # both samples have a fixed bound, so they may be broadcast
    chosen = F.broadcast(_spread(sized.join(known, id_col, "left_semi"), id_col, labelled, chars))
    others = F.broadcast(_spread(sized, id_col, unlabelled, chars))
    with_labels = wanted.join(chosen, id_col).join(F.broadcast(known.join(chosen, id_col)), id_col)
    without = wanted.join(others, id_col).join(chosen, id_col, "left_anti").select("*", *(F.lit(None).cast("int").alias(t) for t in targets))
    pool = with_labels.unionByName(without).withColumn("part", F.pmod(F.xxhash64(F.col(id_col), F.lit("part")), F.lit(4)) == 0)

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            text = [text_features(t) for t in frame["_text"]]
            meta = [meta_features(dict(zip(names, v, strict=True))) for v in zip(*(frame[c] for c in names), strict=True)] if names else [meta_features({})] * len(frame)
            yield pd.DataFrame({"id": frame[id_col], "words": [i.tobytes() for i, _ in text], "shapes": [d.tobytes() for _, d in text], "meta": [m.tobytes() for m in meta], "part": frame["part"], **{t: frame[t] for t in targets}})

    id_type = docs.schema[id_col].dataType.simpleString()
    sample = pool.mapInPandas(featurize, f"id {id_type}, words binary, shapes binary, meta binary, part boolean, " + ", ".join(f"{t} int" for t in targets))
    models = fit_targets(materialize(sample, "sample"), targets)
    sent = spark.sparkContext.broadcast({t: m and m.packed() for t, m in models.items()})
    fields = [f"{p}_{t}" for t in targets for p in ("p", "text", "meta")]

    @F.pandas_udf("struct<" + ",".join(f"{f}:double" for f in fields) + ">")
    def scores(text: pd.Series, meta: pd.DataFrame) -> pd.DataFrame:
        models = {t: m and Target.unpacked(m) for t, m in sent.value.items()}
        tr = text_rows([text_features(t) for t in text])
        mr = Rows([meta_features(dict(zip(names, v, strict=True))) for v in zip(*(meta[c] for c in names), strict=True)] if names else [meta_features({})] * len(text), META)
        out = {}
        for t in targets:
            a, b, p = models[t].probabilities(tr, mr) if models[t] is not None else (np.full(len(text), 0.5),) * 3
            out |= {f"p_{t}": p, f"text_{t}": a, f"meta_{t}": b}
        return pd.DataFrame(out, columns=fields)

    meta = F.struct(*(F.col(c) for c in names)) if names else F.struct(F.lit(0).alias("none"))
    old = [c for c in docs.columns if c not in fields]
    return docs.withColumn("_scores", scores(F.col(text_col), meta)).select(*old, *(F.col(f"_scores.{f}").alias(f) for f in fields))


def kept():
    """Neither likely to be of low quality nor likely to be toxic."""
    return (F.col("p_quality") > 1 - REJECT) & (F.col("p_toxic") < REJECT)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of every document and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    scored = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "p_quality", "p_toxic", "text_quality", "meta_quality", "text_toxic", "meta_toxic", kept().alias("keep"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are rejected go."""
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where(kept()).select(*docs.columns)
