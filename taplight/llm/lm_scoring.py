"""Masked pseudo-likelihood: a bidirectional window network predicts every token from the words on both its sides.

A token is a word, hashed to one of BUCKETS; the corpus counts of all buckets, gathered over all documents, rank them.
The network reads the two words before and the two after: the most frequent buckets have rows of their own in a table
per place, the others share SHARED rows in stretches of the frequency order.  A tanh layer feeds three softmax layers
which spell the token: its class (the OWN most frequent are classes of their own), a digit within the class and a digit
within that, all of about equal mass; a bucket's corpus share among those of one spelling completes its probability.
The sum of the conditional log-probabilities of all tokens of a document, each given both sides, is its
pseudo-log-likelihood.

Training is data-parallel: documents are dealt by a hash to shards of about SHARD tokens, in each round a copy of the
network is trained, in numpy, on every position of every document of a shard, in order of identifier; Spark sums the
copies, weighted by their positions (a table's row by how often the copy read it), and the mean starts the next round.
Shards depend on the documents alone, so scores don't change with the number of tasks but by rounding.  What is gathered
-- counts and weights of every shard -- grows with the input; what any worker holds does not.

Defined results: null and empty texts have no tokens, log-likelihood 0 and a null mean; repeated rows have equal scores;
in an empty table nothing is trained and nothing returned.  Texts are read whole; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taplight.llm.common import bytes_of, holds_tables, id_and_text, shared_dir, small_batches, table, written
from taplight.llm.words import split_words

BUCKETS = 1 << 16
OWN, TAIL, DIGITS = 48, 16, 64
CLASSES = OWN + TAIL
#: Rows of a place's table: frequent buckets, stretches of the others, and the edge of a document.
FREQUENT, SHARED = 4064, 32
EDGE = FREQUENT + SHARED
SIDE, HIDDEN = 2, 32
PLACES = tuple(k for k in range(-SIDE, SIDE + 1) if k)
TABLES = len(PLACES) * (EDGE + 1)
#: Rows of HIDDEN weights beyond the tables: the bias, the three outputs, and the classes' biases.
OUT = CLASSES + 2 * DIGITS
ROWS = TABLES + 1 + OUT + CLASSES // HIDDEN
ROUNDS, BATCH, RATE, TABLE_RATE = 1, 1024, 0.003, 0.05
#: Tokens of a shard, about; each shard trains a copy of its own.
SHARD = 4_000_000
#: Positions that are scored at once: their logits stay in a core's cache.
SCORED = 4096
KEPT_WORDS = 400_000
#: The logarithm that stands for a share of nothing.
NEVER = -30.0

_known: dict[bytes, int] = {}


def bucket_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of several documents end to end, and each document's number of words."""
    holds_tables("language model", _known.clear)
    if len(_known) > KEPT_WORDS:
        _known.clear()
    known = _known
    split = [split_words(t) for t in texts]
    flat = [w for s in split for w in s]
    for w in set(flat).difference(known):
        known[w] = zlib.crc32(w) % BUCKETS
    return np.fromiter(map(known.__getitem__, flat), np.uint16, len(flat)), np.array([len(s) for s in split], np.int64)


def _halves(mass: np.ndarray, group: np.ndarray, parts: int) -> np.ndarray:
    """For each of a row of masses the part it falls into, of ``parts`` about equal ones of its group (rising numbers)."""
    total = np.bincount(group, mass)
    before = np.concatenate(([0.0], np.cumsum(total)))[group]
    middle = np.cumsum(mass) - mass / 2 - before
    return np.minimum(middle * parts / total[group], parts - 1).astype(np.int64)


def _log_shares(group: np.ndarray, mass: np.ndarray, groups: int, parts: int) -> np.ndarray:
    """Logarithms of each part's share of its group, from parts numbered across groups."""
    sums = np.bincount(group, mass, groups * parts).reshape(groups, parts)
    shares = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
    return np.where(shares > 0, np.log(np.maximum(shares, 1e-13)), NEVER).astype(np.float32)


class Vocabulary:
    """How every bucket is read (its row of a place's table) and spelt (class, two digits, share)."""

    def __init__(self, counts: np.ndarray) -> None:
        order = np.argsort(-counts, kind="stable")
        mass = counts[order] + 1.0
        self.row = np.empty(BUCKETS, np.int64)
        self.row[order[:FREQUENT]] = np.arange(FREQUENT)
        self.row[order[FREQUENT:]] = FREQUENT + _halves(mass[FREQUENT:], np.zeros(BUCKETS - FREQUENT, np.int64), SHARED)
        rest = mass[OWN:]
        tail = _halves(rest, np.zeros(len(rest), np.int64), TAIL)
        one = _halves(rest, tail, DIGITS)
        first = tail * DIGITS + one
        two = _halves(rest, np.unique(first, return_inverse=True)[1], DIGITS)
        spelling = first * DIGITS + two
        self.of = np.empty(BUCKETS, np.int64)
        self.of[order] = np.concatenate((np.arange(OWN), OWN + tail))
        self.one, self.two, self.first = (np.zeros(BUCKETS, np.int64) for _ in range(3))
        self.one[order[OWN:]], self.two[order[OWN:]], self.first[order[OWN:]] = one, two, first
        self.share = np.zeros(BUCKETS, np.float32)
        self.share[order[OWN:]] = np.log(rest / np.bincount(spelling, rest)[spelling])
        self.log_class = np.log(np.bincount(self.of[order], mass, CLASSES) / mass.sum()).astype(np.float32)
        self.log_one = _log_shares(first, rest, TAIL, DIGITS)
        self.log_two = _log_shares(spelling, rest, TAIL * DIGITS, DIGITS)


def initial(vocabulary: Vocabulary, seed: int = 11) -> np.ndarray:
    """Small random tables and outputs, and the classes' log-frequencies as their bias."""
    out = np.zeros((ROWS, HIDDEN), np.float32)
    out[:TABLES] = np.random.default_rng(seed).normal(0, 0.3, (TABLES, HIDDEN))
    out[TABLES + 1 : TABLES + 1 + OUT] = np.random.default_rng(seed + 1).normal(0, 0.05, (OUT, HIDDEN))
    out[TABLES + 1 + OUT :] = vocabulary.log_class.reshape(-1, HIDDEN)
    return out


def contexts(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each place (a row) and token the row of the tables to read; beyond a document's ends it is the edge's."""
    n = len(rows)
    out = np.empty((len(PLACES), n), np.int64)
    ends = np.cumsum(sizes)
    for i, k in enumerate(PLACES):
        base = i * (EDGE + 1)
        out[i] = base + EDGE
        if k > 0:
            out[i, : max(0, n - k)] = rows[k:] + base
            for back in range(1, k + 1):
                out[i, (ends - back)[sizes >= back]] = base + EDGE
        else:
            out[i, -k:] = rows[:k] + base
            for on in range(-k):
                out[i, (ends - sizes + on)[sizes > on]] = base + EDGE
    return out


def _parts(weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tables, bias, the three outputs, the classes' biases."""
    out = weights[TABLES + 1 : TABLES + 1 + OUT]
    return weights[:TABLES], weights[TABLES], out[:CLASSES], out[CLASSES : CLASSES + DIGITS], out[CLASSES + DIGITS :], weights[TABLES + 1 + OUT :].reshape(-1)


def _hidden(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    hidden = weights.take(rows[0], axis=0)
    for near in rows[1:]:
        hidden += weights.take(near, axis=0)
    hidden += weights[TABLES]
    return np.tanh(hidden, out=hidden)


def _bounded(weights: np.ndarray) -> bool:
    """Whether no logit is so large that its exponent overflows: a tanh unit is in [-1, 1].  Spellings only lower them."""
    _, _, classes, first, second, bias = _parts(weights)
    return max(float((np.abs(classes).sum(axis=1) + np.abs(bias)).max()), float(np.abs(first).sum(axis=1).max()), float(np.abs(second).sum(axis=1).max())) < 60


def log_probabilities(weights: np.ndarray, rows: np.ndarray, vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Log-probability of each bucket of ``ids`` given the rows that stand around it."""
    out = np.empty(len(ids), np.float32)
    _, _, classes, first, second, bias = _parts(weights)
    bounded = _bounded(weights)

    def picked(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not bounded:
            logits -= logits.max(axis=1, keepdims=True)
        chosen = logits[np.arange(len(at)), at]
        np.exp(logits, out=logits)
        return chosen - np.log(logits.sum(axis=1))

    for i in range(0, len(ids), SCORED):
        some = ids[i : i + SCORED]
        hidden = _hidden(weights, rows[:, i : i + SCORED])
        logits = hidden @ classes.T
        logits += bias
        each = picked(logits, vocabulary.of[some])
        tail = np.flatnonzero(vocabulary.of[some] >= OWN)
        if len(tail):
            hidden, words = hidden.take(tail, axis=0), some[tail]
            digit = hidden @ first.T
            digit += vocabulary.log_one.take(vocabulary.of[words] - OWN, axis=0)
            spelt = picked(digit, vocabulary.one[words]) + vocabulary.share[words]
            digit = hidden @ second.T
            digit += vocabulary.log_two.take(vocabulary.first[words], axis=0)
            each[tail] += spelt + picked(digit, vocabulary.two[words])
        out[i : i + SCORED] = each
    return out


class Trainer:
    """Adam on the outputs and biases, Adagrad on the tables, of which a step reads few rows."""

    def __init__(self, weights: np.ndarray, vocabulary: Vocabulary) -> None:
        self.weights, self.vocabulary, self.step = weights.copy(), vocabulary, 0
        self.squares, self.read = np.zeros((TABLES, HIDDEN), np.float32), np.zeros(TABLES, np.int64)
        self.first, self.second = (np.zeros((ROWS - TABLES, HIDDEN), np.float32) for _ in range(2))

    def learn(self, rows: np.ndarray, ids: np.ndarray) -> None:
        """A step on the cross-entropy of what ``ids`` spell."""
        words, n = self.vocabulary, len(ids)
        _, _, classes, first, second, bias = _parts(self.weights)
        hidden = _hidden(self.weights, rows)
        grad = np.zeros((ROWS - TABLES, HIDDEN), np.float32)
        bounded = _bounded(self.weights)

        def wrong(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
            if not bounded:
                logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            logits *= (np.float32(1 / n) / logits.sum(axis=1))[:, None]
            logits[np.arange(len(at)), at] -= np.float32(1 / n)
            return logits

        of = words.of[ids]
        logits = hidden @ classes.T
        logits += bias
        gap = wrong(logits, of)
        back = gap @ classes
        grad[1 : 1 + CLASSES] = gap.T @ hidden
        grad[1 + OUT :] = gap.sum(axis=0).reshape(-1, HIDDEN)
        tail = np.flatnonzero(of >= OWN)
        if len(tail):
            inner, rare = hidden.take(tail, axis=0), ids[tail]
            digit = inner @ first.T
            digit += words.log_one.take(of[tail] - OWN, axis=0)
            gap = wrong(digit, words.one[rare])
            more = gap @ first
            grad[1 + CLASSES : 1 + CLASSES + DIGITS] = gap.T @ inner
            digit = inner @ second.T
            digit += words.log_two.take(words.first[rare], axis=0)
            gap = wrong(digit, words.two[rare])
            more += gap @ second
            grad[1 + CLASSES + DIGITS : 1 + OUT] = gap.T @ inner
            back[tail] += more
        back *= 1 - hidden * hidden
        grad[0] = back.sum(axis=0)
        self._tables(rows, back)
        self.step += 1
        self.first += 0.1 * (grad - self.first)
        self.second += 0.001 * (grad * grad - self.second)
        self.weights[TABLES:] -= RATE * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)

    def _tables(self, rows: np.ndarray, back: np.ndarray) -> None:
        flat = rows.reshape(-1)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        sorted_rows = flat[order]
        starts = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
        at = sorted_rows[starts]
        grad = np.add.reduceat(back.take(order % rows.shape[1], axis=0), starts, axis=0)
        self.read[at] += np.diff(np.append(starts, len(flat)))
        squares = self.squares.take(at, axis=0)
        squares += grad * grad
        self.squares[at] = squares
        self.weights[at] -= TABLE_RATE * grad / (np.sqrt(squares) + 1e-8)


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the buckets of every whole text's words, two bytes each; split and hashed once for all passes."""
    small_batches(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = bucket_ids(bytes_of(batch))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32) * np.int32(2)
            packed = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed], ["doc_id", "ids"])

    rows = id_and_text(docs, id_col, text_col).mapInArrow(split, "doc_id long, ids binary")
    return written(rows, shared_dir(docs.sparkSession, "lm"))


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A batch's buckets end to end, and each document's number of words."""
    packed = batch.column("ids").to_pylist()
    return np.frombuffer(b"".join(packed), "<u2").astype(np.int64), np.array([len(p) // 2 for p in packed], np.int64)


def corpus_counts(rows: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all documents: one partial count per task, BUCKETS numbers in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            sums += np.bincount(_ids(batch)[0], minlength=BUCKETS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())], ["bucket", "n"])

    found = rows.select("ids").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy(int)] = found["n"].to_numpy(int)
    return out


class Model(NamedTuple):
    vocabulary: Vocabulary
    weights: np.ndarray
    #: Tokens of the corpus.
    tokens: int


NAMES = [f"w{k}" for k in range(HIDDEN)]


def _copy(trainer: Trainer, seen: int) -> pa.RecordBatch:
    """A shard's copy of the rows that it trained, times the positions each has seen."""
    some = np.flatnonzero(trainer.read)
    at = np.concatenate((some, np.arange(TABLES, ROWS)))
    n = np.concatenate((trainer.read[some], np.full(ROWS - TABLES, seen)))
    scaled = trainer.weights[at].astype(np.float64) * n[:, None]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64()), *(pa.array(scaled[:, k]) for k in range(HIDDEN))], ["row", "seen", *NAMES])


def train_round(rows: DataFrame, model: Model, shard_tokens: int = SHARD) -> Model:
    """The mean of the copies that all shards train from ``model``, weighted by the positions that each row of weights saw."""
    shards = max(1, -(-model.tokens // shard_tokens))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, _ = shared.value
        current, trainer, held, seen, waiting = None, None, [], 0, 0

        def steps(last: bool) -> None:
            nonlocal held, seen, waiting
            x, y = np.concatenate([a for a, _ in held], axis=1), np.concatenate([b for _, b in held])
            stop = len(y) if last else len(y) // BATCH * BATCH
            for i in range(0, stop, BATCH):
                trainer.learn(x[:, i : min(i + BATCH, stop)], y[i : min(i + BATCH, stop)])
            held, seen, waiting = [(x[:, stop:], y[stop:])], seen + stop, len(y) - stop

        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1]))).tolist() if len(numbers) else []
            for a, b in zip(edges, [*edges[1:], len(numbers)], strict=True):
                if numbers[a] != current:
                    if waiting:
                        steps(True)
                    if seen:
                        yield _copy(trainer, seen)
                    current, trainer, held, seen, waiting = numbers[a], Trainer(weights, vocabulary), [], 0, 0
                ids, sizes = _ids(batch.slice(a, b - a))
                held.append((contexts(vocabulary.row[ids], sizes), ids))
                waiting += len(ids)
                if waiting >= BATCH:
                    steps(False)
        if waiting:
            steps(True)
        if seen:
            yield _copy(trainer, seen)

    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "ids").repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    copies = dealt.select("shard", "ids").mapInArrow(learn, "row int, seen long, " + ", ".join(f"{n} double" for n in NAMES))
    found = copies.groupBy("row").agg(F.sum("seen").alias("seen"), *(F.sum(n).alias(n) for n in NAMES)).toArrow()
    shared.unpersist()
    out = model.weights.copy()
    out[found["row"].to_numpy()] = np.column_stack([found[n].to_numpy() / found["seen"].to_numpy() for n in NAMES])
    return model._replace(weights=out)


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model of ``tokenized`` documents, each round of which trains on every position."""
    small_batches(rows.sparkSession)
    counts = corpus_counts(rows)
    vocabulary = Vocabulary(counts)
    model = Model(vocabulary, initial(vocabulary), int(counts.sum()))
    for _ in range(rounds):
        model = train_round(rows, model)
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every ``tokenized`` document."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, _ = shared.value
        for batch in batches:
            ids, sizes = _ids(batch)
            each = log_probabilities(weights, contexts(vocabulary.row[ids], sizes), vocabulary, ids)
            sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes)).astype(np.float64)
            means = [s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(sums), pa.array(means, pa.float64())], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return rows.select("doc_id", "ids").mapInArrow(scored, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """The masked pseudo-log-likelihood of every document under a network trained on all of them."""
    rows = tokenized(table(spark, sf_dir, "documents"))
    return score(rows, fit(rows))
