"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

The grams of ORDERS characters of a text, in lower case with every stretch of other characters as one space, are hashed
to BUCKETS.  A gram counts 1 + log(occurrences) times the logarithm of the inverse share of training documents that have
it; a document is scaled to unit length.  Document counts come from all training documents: those with a language,
outside the held-out fold (crc32 of the identifier's text mod 5 is 0).

Weights are learnt by follow-the-regularised-leader, a learning rate for each weight and elastic-net penalties: what a
weight would be is kept in sums, and it is 0 until its sum leaves the first penalty's band, so most weights are 0 and a
model is a short table.  Training is on the driver, on a bounded sample: at most SAMPLE documents, dealt out evenly to the
languages (the least hashes of identifier and text of each), each whole and as one short piece.  Of more than SAMPLE languages the
commonest SAMPLE are learnt.  A tenth of the sample, not learnt from,
fits the temperature that calibrates the probabilities.

Language, source and identifier are never inputs of a prediction.  Texts are read whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any training document every text
is ``und``; with one language every text that has a letter is of that language with score 1.  Equal texts get equal
predictions.  Any non-null value of the language column is a language, the empty text too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taplight.llm.common import small_batches, table, text_of
from taplight.llm.words import mixed

ORDERS, BUCKETS = (1, 2, 3), 1 << 16
SAMPLE, EPOCHS, PIECE = 4000, 3, 60
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005
FOLDS, NONE = 5, "und"
#: Characters that are hashed at once; longer texts are counted part by part.
PART = 1 << 20

_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


def counts(text: str, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a text's grams fall into, ascending, and how many grams each has."""
    plain = f" {_OTHER.sub(' ', text.lower()).strip()} "
    code = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(buckets, np.int64)
    for start in range(0, len(code), PART):
        grams = []
        for order in orders:
            part = code[start : start + PART + order - 1]
            n = len(part) - order + 1
            if n > 0:
                h = np.full(n, order, np.uint64)
                for k in range(order):
                    h = h * np.uint64(0x110001) + part[k : k + n]
                grams.append(h)
        total += np.bincount((mixed(np.concatenate(grams)) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    some = np.flatnonzero(total)
    return some, total[some]


def piece(text: str) -> str:
    """A short piece of a text: up to PIECE characters from a word that its words' number and length choose, whole words only."""
    words = text.split()
    if not words:
        return ""
    at, out = len(text) * 7919 % len(words), words[:0]
    for w in words[at:]:
        out.append(w)
        if sum(map(len, out)) >= 1 + len(text) * 104729 % PIECE:
            break
    return " ".join(out)[: 2 * PIECE]


def document_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of documents that have a letter, and of those that have a gram of each bucket: a partial sum per task, ``buckets`` rows in all."""
    small_batches(docs.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if has_letter(text):
                    found[counts(text, buckets=buckets)[0]] += 1
                    found[buckets] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["bucket", "n"])

    rows = docs.select(text_of(docs[text_col]).alias("text")).mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets + 1, np.int64)
    out[rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(int)
    return int(out[buckets]), out[:buckets]


def inverse(n: int, having: np.ndarray) -> np.ndarray:
    return (np.log((1 + n) / (1 + having)) + 1).astype(np.float32)


def weighted(some: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    x = (1 + np.log(n)) * idf[some]
    return x / np.linalg.norm(x)


class Leader:
    """Follow-the-regularised-leader for one weight per (bucket, class); the last bucket is the bias, without penalties."""

    def __init__(self, buckets: int, classes: int) -> None:
        self.z = np.zeros((buckets + 1, classes))
        self.n = np.zeros((buckets + 1, classes))

    def weights(self, some: np.ndarray) -> np.ndarray:
        z, n = self.z[some], self.n[some]
        free = (some == len(self.z) - 1)[:, None]
        l1, l2 = np.where(free, 0.0, L1), np.where(free, 0.0, L2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    def learn(self, some: np.ndarray, x: np.ndarray, y: int) -> None:
        some, x = np.append(some, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(some)
        gap = softmax(x @ w)
        gap[y] -= 1
        g = x[:, None] * gap
        n = self.n[some]
        self.z[some] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[some] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """Languages, inverse shares, the rows of weights that aren't all 0 (``row``: which row a bucket has, the last is of zeros), bias, temperature."""

    names: list[str]
    idf: np.ndarray
    row: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, some: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[self.row[some]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names or not has_letter(text):
            return NONE, 0.0
        some, n = counts(text, buckets=len(self.idf))
        p = softmax(self.logits(some, weighted(some, n, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(p[best])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], held: list[tuple[np.ndarray, np.ndarray, int]], names: list[str], idf: np.ndarray, seed: int = 7) -> Model:
    """Weights from (buckets, values, class) rows in EPOCHS random orders; the temperature from ``held``."""
    leader, random = Leader(len(idf), len(names)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            leader.learn(*rows[i])
    w = leader.weights(np.arange(len(idf) + 1))
    used = np.flatnonzero(w[:-1].any(axis=1))
    row = np.full(len(idf), len(used), np.int32)
    row[used] = np.arange(len(used))
    model = Model(names, idf, row, np.vstack([w[used], np.zeros((1, len(names)))]).astype(np.float32), w[-1])
    if held and len(names) > 1:
        logits, y = np.array([model.logits(some, x) for some, x, _ in held]), np.array([c for _, _, c in held])
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.exp(np.linspace(-3, 3, 241)), key=loss))
    return model


def _fold(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Document counts over all training documents, weights from at most ``sample`` of them (one of each language at least)."""
    learnt = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"), docs[lang_col].cast("string").alias("lang")).where(F.col("lang").isNotNull() & (_fold(F.col("id")) != 0))
    sizes = {x["lang"]: x["n"] for x in learnt.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.int32), np.zeros((1, 0), np.float32), np.zeros(0))
    n, having = document_counts(learnt)
    idf, quota = inverse(n, having), max(1, sample // len(names))
    # The least hashes of each language: a bound on the hash leaves about four times the quota for the window to order.
    share = F.create_map(*(F.lit(v) for name in names for v in (name, min(1.0, (4 * quota + 40) / sizes[name]))))
    hashed = learnt.withColumn("h", F.xxhash64("id", "text")).where(((F.col("h") / 2.0**64) + 0.5) <= F.element_at(share, F.col("lang")))
    chosen = hashed.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))).where(F.col("place") <= quota)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for text in batch.column("text").to_pylist():
                for t in (text, piece(text)):
                    some, k = counts(t) if has_letter(t) else (np.empty(0, np.int64),) * 2
                    cells += [some.astype(np.uint32).tobytes(), np.minimum(k, 2**32 - 1).astype(np.uint32).tobytes()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), *(pa.array(cells[k::4], pa.binary()) for k in range(4))], ["lang", "place", "a", "an", "b", "bn"])

    found = chosen.select("lang", "place", "text").mapInArrow(features, "lang string, place int, a binary, an binary, b binary, bn binary").toPandas().sort_values(["lang", "place"])
    rows, held = [], []
    for lang, place, *cells in found.itertuples(index=False):
        for some, k in (cells[:2], cells[2:]):
            if some:
                at = np.frombuffer(some, np.uint32).astype(np.int64)
                (held if place % 10 == 0 else rows).append((at, weighted(at, np.frombuffer(k, np.uint32), idf), names.index(lang)))
    return train(rows, held, names, idf)


def prediction(model: Model, text: Column) -> Column:
    """(lang_pred, score) of a column of texts."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predicted(text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    small_batches(docs.sparkSession)
    held_out = F.coalesce(_fold(docs[id_col]) == 0, F.lit(False))
    return docs.select(docs[id_col].alias("doc_id"), held_out.alias("held_out"), prediction(model, docs[text_col]).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op11_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
