"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer numpy network.

Every word stands for two tokens, its letters in lower case and its shape (kinds of characters, runs written once), each
hashed to one of BUCKETS.  A bucket has a fixed sparse index vector of a few +1 and -1; its word vector is the sum of
the index vectors that occur around it, over all documents.  A document is the mean of its tokens' vectors, letters
and shapes apart, and the logarithm of its length.  The network is trained on the driver on a bounded sample
(SAMPLE rows) of the labelled documents; a temperature fitted on a part of them that training didn't see calibrates
its probabilities.

Only labelled documents outside the held-out fold (crc32 of the identifier's text mod 5 is 0) are learnt from; label,
language, source and identifier are never inputs of a score.

Defined results: null and empty texts pool to zeros and get the score of such a document; documents whose label is null
teach nothing, repeated labels count once each; without labels of both kinds every score is the share of label 1, or
0.5 without any.  Repeated documents get equal scores.  Texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taplight.llm.common import bytes_of, holds_tables, small_batches, table, text_of
from taplight.llm.words import mixed, split_words

BUCKETS, WIDTH, NONZERO = 1 << 13, 32, 2
SAMPLE, HIDDEN, EPOCHS, BATCH, RATE = 20_000, 32, 30, 128, 0.004
FOLDS, THRESHOLD = 5, 0.3
KEPT_WORDS = 300_000
#: Documents whose words a worker holds as arrays at once.
HELD = 100

_tokens: dict[bytes, int] = {}
_RUN = re.compile(r"(.)\1+", re.DOTALL)


class _Kinds(dict):
    """Character to its kind, filled as characters come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


class _Letters(dict):
    def __missing__(self, code: int) -> str | None:
        self[code] = kept = chr(code) if chr(code).isalpha() else None
        return kept


_kinds, _letters = _Kinds(), _Letters()


def _code(raw: bytes) -> int:
    """Buckets of a word's letters and of its shape, in one number."""
    word = raw.decode("utf-8", "replace")
    letters = zlib.crc32(word.lower().translate(_letters).encode("utf-8", "surrogatepass")) % BUCKETS
    shape = zlib.crc32(b"\0" + _RUN.sub(r"\1", word.translate(_kinds)).encode("utf-8", "surrogatepass")) % BUCKETS
    return letters * BUCKETS + shape


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter and shape buckets of the words of several documents end to end, and each document's number of words."""
    holds_tables("quality", _tokens.clear)
    if len(_tokens) > KEPT_WORDS:
        _tokens.clear()
    known = _tokens
    split = [split_words(t) for t in texts]
    flat = [w for s in split for w in s]
    for w in set(flat).difference(known):
        known[w] = _code(w)
    code = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    return code // BUCKETS, code % BUCKETS, np.array([len(s) for s in split], np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector, from a fixed mixing function."""
    n = np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(1)
    random = mixed(n).reshape(BUCKETS, NONZERO)
    return (random % np.uint64(WIDTH)).astype(np.int64), np.where(random >> np.uint64(63), 1.0, -1.0)


def _around(letters: np.ndarray, shapes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token, token near it) pairs; words are neighbours within a document only."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    for own, near in ((letters, letters), (shapes, shapes), (letters, shapes)):
        yield own[inner], near[inner + 1]
        yield own[inner + 1], near[inner]
    yield shapes, letters


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    sums = np.zeros(BUCKETS * WIDTH)
    for batch in batches:
        for i in range(0, batch.num_rows, 4 * HELD):
            for own, near in _around(*tokens(bytes_of(batch.slice(i, 4 * HELD)))):
                for k in range(NONZERO):
                    sums += np.bincount(own * WIDTH + place[near, k], sign[near, k], BUCKETS * WIDTH)
    rows = sums.reshape(BUCKETS, WIDTH)
    some = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(rows[some, k]) for k in range(WIDTH))], ["bucket", *(f"v{k}" for k in range(WIDTH))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Vectors of unit length of all buckets: sums over all documents, one partial sum per task, BUCKETS rows in all."""
    names = [f"v{k}" for k in range(WIDTH)]
    small_batches(docs.sparkSession)
    partial = docs.select(text_of(docs[text_col]).alias("text")).mapInArrow(_context_sums, "bucket int, " + ", ".join(f"{n} double" for n in names))
    found = partial.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).orderBy("bucket").toPandas()
    out = np.zeros((BUCKETS, WIDTH))
    rows = found[names].to_numpy(float).reshape(len(found), WIDTH)
    out[found["bucket"].to_numpy(int)] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean letter and shape vectors and log length of each document."""
    if len(texts) > HELD:
        return np.concatenate([pooled(texts[i : i + HELD], vectors) for i in range(0, len(texts), HELD)])
    letters, shapes, sizes = tokens(texts)
    out = np.zeros((len(texts), 2 * WIDTH + 1))
    some = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[some]
    if len(some):
        out[some, :WIDTH] = np.add.reduceat(vectors[letters], first, axis=0, dtype=np.float64) / sizes[some, None]
        out[some, WIDTH:-1] = np.add.reduceat(vectors[shapes], first, axis=0, dtype=np.float64) / sizes[some, None]
    out[:, -1] = np.log1p(sizes)
    return out


@dataclass
class Network:
    """Standardised inputs, a layer of tanh units, one logit over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -logits, logits))))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on cross-entropy; a tenth of the rows fits the temperature alone."""
    random = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.5
    width = x.shape[1]
    net = Network(np.zeros(width), np.ones(width), random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if len(y) < 20 or share in (0.0, 1.0):
        return net
    order = random.permutation(len(y))
    held, rows = order[: len(y) // 10], order[len(y) // 10 :]
    net.mean, net.scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-6
    net.w2 = random.normal(0, HIDDEN**-0.5, HIDDEN)
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(EPOCHS):
        random.shuffle(rows)
        for i in range(0, len(rows), BATCH):
            some = rows[i : i + BATCH]
            z = (x[some] - net.mean) / net.scale
            h = np.tanh(z @ values[0] + values[1])
            gap = (1 / (1 + np.exp(-np.clip(h @ values[2] + values[3][0], -40, 40))) - y[some]) / len(some)
            back = np.outer(gap, values[2]) * (1 - h * h)
            grads = [z.T @ back + 1e-4 * values[0], back.sum(axis=0), h.T @ gap + 1e-4 * values[2], np.array([gap.sum()])]
            step += 1
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if len(held):
        logits = net.logits(x[held])
        net.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 161)), key=lambda t: _loss(logits / t, y[held])))
    return net


def _fold(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors over all documents and a network over at most ``sample`` labelled ones outside the held-out fold."""
    vectors = word_vectors(docs, text_col)
    known = labels.select(labels[id_col].cast("long").alias("label__id"), labels[label_col].cast("double").alias("label__y")).where(F.col("label__y").isNotNull() & (_fold(F.col("label__id")) != 0))
    chosen = known.orderBy(F.xxhash64("label__id"), "label__id", "label__y").limit(sample)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs[text_col]).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label__id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(bytes_of(batch), vectors).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label__y"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    rows = texts.select("doc_id", "label__y", "text").mapInArrow(features, "doc_id long, y double, x array<float>").toPandas()
    if not len(rows):
        return vectors, train(np.zeros((0, 2 * WIDTH + 1)), np.zeros(0))
    rows["key"] = [bytes(np.asarray(v, np.float32)) for v in rows["x"]]
    rows = rows.sort_values(["doc_id", "y", "key"])
    return vectors, train(np.array(rows["x"].tolist(), float), (rows["y"].to_numpy() > 0).astype(float))


def score_column(model: tuple[np.ndarray, Network], text: Column) -> Column:
    """The probability of label 1 for a column of texts."""
    vectors, net = model

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(net.probabilities(pooled(texts.tolist(), vectors)))

    return scored(text_of(text).cast("binary"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those scored below THRESHOLD; all columns stay."""
    return docs.where(score_column(fit(docs, labels, id_col, text_col), docs[text_col]) >= THRESHOLD)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(_fold(docs["doc_id"]) == 0, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), score_column(model, docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
