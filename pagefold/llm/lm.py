"""Log-bilinear language model, trained with noise-contrastive estimation in numpy.

Words are coded once: a narrow pass turns runs of documents into chunks (a row each, with a word list and packed local
numbers), so every later step is array work. Word counts over all training documents come from one shuffle of
(word, chunk) rows, not of tokens, and go back to the chunks that hold the words; no frame of all words is ever sent to
the driver or to one task.

The neural model is class based. Each of the most frequent words is a class of its own; the others fall into classes by
their last letters, and a word's share in its class is its smoothed count. Given the classes of the words before, a
log-bilinear model (position-scaled sums of context vectors times output vectors, plus a bias) scores all classes, and
a full softmax over the classes makes the probability of each token exact, not approximate. Training is
noise-contrastive: noise classes are drawn from the unigram distribution, for all positions of a batch at a time. Every
training token of every chunk is seen once; tasks train on their own chunks from a common start and the parameters are
averaged by tokens, first in a few tasks and then on the driver, which receives at most ``MERGED`` rows of a fixed size.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, materialize

#: Frequent words that are classes of their own; classes of the other words, by their last letters.
FREQUENT = 191
SUFFIXES = 64
#: Words of context, and numbers of a vector.
CONTEXT = 3
WIDTH = 16
#: Tokens of a training step, noise samples of a step, and the first step size (divided by the root of summed squares).
BATCH = 1024
NOISE = 64
RATE = 0.15
#: Tokens that are scored at a time.
SCORED = 8192
CHUNK_CHARS = 8 << 20
MERGED = 32
#: A class beside the suffixes for the end of a text, which is a token; words hold no space.
END = " "
CLASSES = FREQUENT + SUFFIXES + 1
END_CLASS = CLASSES - 1


def suffix_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % SUFFIXES


def code_chunk(rows: list[tuple], held: list[bool]) -> tuple:
    """(words, training counts, ids, held, token counts, tokens) of (id, text) rows. The end of a text is local number 0."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    number[b" "]  # noqa: B018
    coded, sizes = [], []
    for _, text in rows:
        words = text.encode("utf-8", "replace").lower().split()
        coded.append(np.array([number[w] for w in words] + [0], dtype=np.int32))
        sizes.append(len(words) + 1)
    tokens = np.concatenate(coded)
    counts = np.bincount(tokens[np.repeat(~np.array(held, dtype=bool), sizes)], minlength=len(number))
    listed = b"\n".join(number)
    return listed.decode("utf-8", "replace"), counts.astype(np.int32), [i for i, _ in rows], held, sizes, tokens.astype("<i4").tobytes()


def chunks_of(docs: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    """Coded chunks; held_out is a column that says which rows are not learnt from."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            ids, held = frame["id"].tolist(), frame["held"].tolist()
            ids = [None if pd.isna(i) else i for i in ids]
            for part in blocks(frame["text"].fillna("").tolist(), CHUNK_CHARS):
                out = code_chunk([(ids[i], t) for i, t in part], [held[i] for i, _ in part])
                yield pd.DataFrame([(uuid.uuid4().int >> 65, *out)], columns=["chunk", "words", "counts", "ids", "held", "sizes", "tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    return source.mapInPandas(code, f"chunk long, words string, counts array<int>, ids array<{id_type}>, held array<boolean>, sizes array<int>, tokens binary")


def count_words(chunks: DataFrame) -> DataFrame:
    """(chunk, number, n, first, suffix, often): n counts the word in all training texts, first marks one row of each word.

    A word has one row in a chunk, however often it stands there, so no word holds a larger share of the rows than one part in the
    distinct words of a chunk. often is the word itself where it makes up a 20,000th of its chunk's training tokens or more: each word that frequent
    overall has such a row.
    """

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                words, counts = row.words.split("\n"), np.asarray(row.counts, dtype=np.int64)
                suffix = np.array([suffix_class(w) for w in words], dtype=np.int32)
                suffix[0] = SUFFIXES
                common = counts * 20_000 >= max(1, counts.sum())
                for at in range(0, len(words), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    often = np.where(common[part], np.array(words[part], dtype=object), None)
                    yield pd.DataFrame({"chunk": row.chunk, "number": np.arange(at, at + len(often), dtype=np.int32), "word": words[part], "c": counts[part], "suffix": suffix[part], "often": often})

    listed = chunks.select("chunk", "words", "counts").mapInPandas(flat, "chunk long, number int, word string, c long, suffix int, often string")
    whole = Window.partitionBy("word")
    return listed.select("chunk", "number", F.sum("c").over(whole).alias("n"), (F.min("chunk").over(whole) == F.col("chunk")).alias("first"), "suffix", "often")


class Vocabulary:
    """Totals and classes: of a fixed size, whatever the corpus. Its values are what is sent to executors, which may not have this class."""

    def __init__(self, values: dict):
        self.__dict__.update(values)

    @staticmethod
    def of(counted: DataFrame) -> Vocabulary:
        totals = {r["suffix"]: (r["n"], r["v"]) for r in counted.where(F.col("first") & (F.col("n") > 0)).groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
        top = counted.where(F.col("often").isNotNull() & (F.col("often") != END) & (F.col("n") > 0)).groupBy("often").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "often").limit(FREQUENT).collect()
        count, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for s, (n, v) in totals.items():
            count[FREQUENT + s], kinds[FREQUENT + s] = n, v
        for k, r in enumerate(top):
            count[k], kinds[k] = r["n"], 1
            own = FREQUENT + suffix_class(r["often"])
            count[own] -= r["n"]
            kinds[own] -= 1
        return Vocabulary({
            "tokens": sum(n for n, _ in totals.values()), "words": sum(v for _, v in totals.values()), "frequent": {r["often"]: k for k, r in enumerate(top)}, "count": count, "kinds": kinds,
            # the unigram distribution of the classes, smoothed so that none is impossible
            "unigram": (count + 1) / (count.sum() + CLASSES),
        })

    def classes(self, words: list[str]) -> np.ndarray:
        frequent, out = self.frequent, np.empty(len(words), dtype=np.int32)
        for k, w in enumerate(words):
            c = frequent.get(w)
            out[k] = c if c is not None else FREQUENT + zlib.crc32(w[-2:].encode()) % SUFFIXES
        out[0] = END_CLASS
        return out


def contexts(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The classes of the words before each token, nearest first; ``CLASSES`` stands for the beginning of the text."""
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(classes))
    out = np.full((len(classes), CONTEXT), CLASSES, dtype=np.int32)
    for k in range(CONTEXT):
        ok = at - k - 1 >= starts
        out[ok, k] = classes[at[ok] - k - 1]
    return out


class LogBilinear:
    """score(class | context) = sum over positions k of scale[k] * context[class k] . output[class] + bias[class]"""

    NAMES = ("context", "output", "scale", "bias")

    def __init__(self, unigram: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.context = rng.normal(0, 0.1, (CLASSES + 1, WIDTH)).astype(np.float32)
        self.output = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.scale = np.ones((CONTEXT, WIDTH), dtype=np.float32)
        self.bias = np.log(unigram).astype(np.float32)
        self.unigram = unigram

    def pack(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float64)

    def unpack(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def hidden(self, before: np.ndarray) -> np.ndarray:
        return np.einsum("bkd,kd->bd", self.context[before], self.scale)

    def log_probabilities(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all classes."""
        scores = self.hidden(before) @ self.output.T
        scores += self.bias
        top = scores.max(axis=1, keepdims=True)
        own = scores[np.arange(len(target)), target] - top[:, 0]
        scores -= top
        np.exp(scores, out=scores)
        return own.astype(np.float64) - np.log(scores.sum(axis=1, dtype=np.float64))

    def train(self, before: np.ndarray, target: np.ndarray, squares: dict[str, np.ndarray], rng: np.random.Generator) -> None:
        """One pass of noise-contrastive steps, each with NOISE noise classes for all its tokens."""
        noise_log = np.log(NOISE * self.unigram).astype(np.float32)
        cumulated = np.cumsum(self.unigram)
        for at in range(0, len(target), BATCH):
            b, t = before[at : at + BATCH], target[at : at + BATCH]
            vectors = self.context[b]
            h = np.einsum("bkd,kd->bd", vectors, self.scale)
            noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE) * cumulated[-1]), CLASSES - 1)
            out_t, out_n = self.output[t], self.output[noise]
            # the share of the data in each choice between a true and NOISE noise samples
            true = 1 / (1 + np.exp(np.einsum("bd,bd->b", h, out_t) + self.bias[t] - noise_log[t]))
            false = -1 / (1 + np.exp(-(h @ out_n.T + self.bias[noise] - noise_log[noise])))
            size = np.float32(1 / len(t))
            grad_h = true[:, None] * out_t + false @ out_n
            grad_out = np.zeros_like(self.output)
            by_noise, by_true = false.T @ h, true[:, None] * h
            grad_bias = np.bincount(t, true, CLASSES).astype(np.float32)
            np.add.at(grad_out, noise, by_noise)
            np.add.at(grad_bias, noise, false.sum(axis=0))
            grad_context = np.zeros_like(self.context)
            for d in range(WIDTH):
                grad_out[:, d] += np.bincount(t, by_true[:, d], CLASSES)
            for k in range(CONTEXT):
                scaled = grad_h * self.scale[k]
                for d in range(WIDTH):
                    grad_context[:, d] += np.bincount(b[:, k], scaled[:, d], CLASSES + 1)
            grad_scale = np.einsum("bd,bkd->kd", grad_h, vectors)
            for name, grad in (("context", grad_context), ("output", grad_out), ("scale", grad_scale), ("bias", grad_bias)):
                grad = grad * size
                squares[name] += grad * grad
                setattr(self, name, getattr(self, name) + (RATE * grad / np.sqrt(squares[name] + 1e-6)).astype(np.float32))


def _arrays(row, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the chunk's words, its tokens, sizes and held-out marks."""
    return vocabulary.classes(row.words.split("\n")), np.frombuffer(row.tokens, dtype="<i4"), np.asarray(row.sizes, dtype=np.int64), np.asarray(row.held, dtype=bool)


def train_model(chunks: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Parameters, averaged over the tasks by the tokens each has learnt from."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(vars(vocabulary))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(sent.value)
        model, seen = LogBilinear(vocabulary.unigram), 0
        squares = {n: np.full(getattr(model, n).shape, 1e-2) for n in model.NAMES}
        rng = np.random.default_rng(11)
        for frame in batches:
            for row in frame.itertuples(index=False):
                classes, tokens, sizes, held = _arrays(row, vocabulary)
                coded = classes[tokens]
                learnt = np.flatnonzero(np.repeat(~held, sizes))
                rng.shuffle(learnt)
                model.train(contexts(coded, sizes)[learnt], coded[learnt], squares, rng)
                seen += len(learnt)
        if seen:
            yield pd.DataFrame({"seen": [seen], "parameters": [(model.pack() * seen).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = 0, 0.0
        for frame in batches:
            for row in frame.itertuples(index=False):
                seen, total = seen + row.seen, total + np.frombuffer(row.parameters)
        if seen:
            yield pd.DataFrame({"seen": [seen], "parameters": [total.tobytes()]})

    schema = "seen long, parameters binary"
    learnt = chunks.select("words", "tokens", "sizes", "held").mapInPandas(learn, schema)
    rows = learnt.repartition(MERGED).mapInPandas(add, schema).collect()
    if not rows:
        return LogBilinear(vocabulary.unigram).pack()
    return sum(np.frombuffer(r["parameters"]) for r in rows) / sum(r["seen"] for r in rows)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    held_out is a Boolean column of docs (null counts as false); the model learns from all other rows. base_score sums
    log10((c + 1) / (N + V + 1)) of each token's training count c; score is the model's log10 probability of the text. A
    frequent word's class holds it alone; in other classes a word has (c + 1) of N' + V' + 1 shares, the last one for
    all words that were never seen. Null and empty texts are one end token; equal rows count and are scored one by one;
    null ids are kept; other columns are ignored; an empty table gives an empty frame.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    chunks = materialize(chunks_of(docs, id_col, text_col, F.lit(False) if held_out is None else held_out), "coded")
    counted = materialize(count_words(chunks), "counted")
    vocabulary = Vocabulary.of(counted)
    parameters = train_model(chunks, vocabulary)
    sent = spark.sparkContext.broadcast((vars(vocabulary), parameters))

    def score(coded: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        vocabulary, parameters = Vocabulary(sent.value[0]), sent.value[1]
        model = LogBilinear(vocabulary.unigram).unpack(parameters)
        outs = []
        for row in coded.itertuples(index=False):
            classes, tokens, sizes, held = _arrays(row, vocabulary)
            n = np.zeros(len(classes))
            n[counts["number"].to_numpy()] = counts["n"].to_numpy()
            base = np.log10((n + 1) / (vocabulary.tokens + vocabulary.words + 1))
            share = np.where(classes < FREQUENT, 0.0, np.log(n + 1) - np.log((vocabulary.count + vocabulary.kinds + 1)[classes]))
            share[0] = 0.0
            target = classes[tokens]
            before = contexts(target, sizes)
            natural = share[tokens]
            for at in range(0, len(tokens), SCORED):
                natural[at : at + SCORED] += model.log_probabilities(before[at : at + SCORED], target[at : at + SCORED])
            starts = np.cumsum(sizes) - sizes
            total = lambda x, starts=starts: np.add.reduceat(x, starts)
            outs.append(pd.DataFrame({
                "id": row.ids, "held_out": held, "n_tokens": sizes, "n_known": total((n > 0)[tokens].astype(np.int64)), "train_tokens": int(vocabulary.tokens),
                "base_score": total(base[tokens]), "score": total(natural) / np.log(10),
            }))
        return pd.concat(outs)

    joined = chunks.drop("counts").groupBy("chunk").cogroup(counted.select("chunk", "number", "n").groupBy("chunk"))
    out = joined.applyInPandas(score, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; crc32 of the id modulo 7 being 2 holds a document out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, held_out=F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2)
