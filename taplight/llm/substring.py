"""Removal of repeated passages by winnowed anchors and extension.

A window is LENGTH consecutive words.  Winnowing picks, in every window, the least of its GRAM-word hashes, so equal
windows have the same anchor at the same place.  Each anchor owns the windows that picked it: consecutive ones, whose
words reach from some words before the anchor to some after it.

Seed: anchors that occur once own no repeated window and go.  Extend: occurrences of an anchor are compared over all
the words that they own, to both sides (a class: equal words); if a class has two occurrences, every window in them is
repeated.  Where an anchor has several classes, one representative of each is extended window by window: a window is
repeated if its words occur in two of them or in a class of several.  No pair of documents is ever formed, so a passage
that a third of all documents share costs each of them one row.

Defined results: a null text has no words; repeated rows repeat each other's windows, so a text given twice loses all
that windows cover; texts of fewer than LENGTH words keep all.  Rows are told apart by identifier and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taplight.llm.common import bytes_of, drop, id_and_text, shared_dir, small_batches, table, written
from taplight.llm.words import mixed, split_words, word_hashes, words_of

LENGTH, GRAM = 35, 8
#: Odd multipliers of the two polynomial hashes (any odd numbers do) and the seed of the second.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of any stretch of a word sequence, from running sums of powers."""

    def __init__(self, hashes: np.ndarray, base: int) -> None:
        n = len(hashes)
        inverse = pow(base, -1, 1 << 64)
        powers = np.ones(n + 1, np.uint64)
        back = np.ones(n + 1, np.uint64)
        powers[1:] = np.multiply.accumulate(np.full(n, base, np.uint64))
        back[1:] = np.multiply.accumulate(np.full(n, inverse, np.uint64))
        self.back = back
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(hashes ^ np.uint64(base)) * powers[:n], out=self.sums[1:])

    def of(self, first: np.ndarray, size) -> np.ndarray:
        """Hashes of ``size`` words from each of ``first``."""
        return mixed((self.sums[first + size] - self.sums[first]) * self.back[first] + np.asarray(size, np.uint64))


class Anchors(NamedTuple):
    doc: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    count: np.ndarray
    high: np.ndarray
    low: np.ndarray


def _joined(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several documents end to end, and where each begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return word_hashes([w for t in texts for w in t]), np.concatenate(([0], np.cumsum(sizes)))


def anchors(texts: list[list[bytes]]) -> Anchors:
    """Anchors of several documents: each with the first window that it owns, how many, and a hash of their words."""
    hashes, starts = _joined(texts)
    n = len(hashes)
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return Anchors(none, none, none, none, none, none)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    one, two = (Rolling(hashes, b) for b in _BASES)
    grams = one.of(np.arange(n - GRAM + 1), GRAM)
    # The least gram of each window, the leftmost of equal ones, by doubling.
    value, at, span, width = grams, np.arange(len(grams)), 1, LENGTH - GRAM + 1
    while span < width:
        step = min(span, width - span)
        a, b = value[: len(value) - step], value[step:]
        left = a <= b
        value, at, span = np.where(left, a, b), np.where(left, at[: len(at) - step], at[step:]), span + step
    whole = np.flatnonzero(doc[: n - LENGTH + 1] == doc[LENGTH - 1 :])
    if not len(whole):
        return Anchors(none, none, none, none, none, none)
    owner = at[whole]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(whole) != 1))))
    first, owner = whole[new], owner[new]
    count = np.diff(np.concatenate((new, [len(whole)])))
    place = (owner - first).astype(np.uint64)
    of = doc[first]
    return Anchors(of, grams[owner].view(np.int64), first - starts[of], count, mixed(one.of(first, count + LENGTH - 1) + place).view(np.int64), mixed(two.of(first, count + LENGTH - 1) + place).view(np.int64))


def window_hashes(texts: list[list[bytes]], doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each owned window: which of the given rows it is of, its start, and two hashes of its words."""
    hashes, starts = _joined(texts)
    row = np.repeat(np.arange(len(doc)), count)
    start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = start + starts[doc[row]]
    high, low = (Rolling(hashes, b).of(at, LENGTH).view(np.int64) for b in _BASES)
    return row, start, high, low


ROW = "doc_id long, rid int"
ANCHORS = f"{ROW}, anchor long, high long, low long, first int, count int"
WINDOWS = f"{ROW}, start int, high long, low long, copies long"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identifier, a hash of the text that tells rows of equal identifier apart, and the text."""
    return id_and_text(docs, id_col, text_col).select("doc_id", F.hash("text").alias("rid"), "text")


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a = anchors([split_words(t) for t in bytes_of(batch)])
        doc = pa.array(a.doc)
        cols = [batch.column("doc_id").take(doc), batch.column("rid").take(doc), *(pa.array(x, pa.int64()) for x in (a.anchor, a.high, a.low)), *(pa.array(x, pa.int32()) for x in (a.first, a.count))]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in ANCHORS.split(", ")])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owned = batch.column("owned").to_pylist()
        doc = np.repeat(np.arange(len(owned)), [len(x) for x in owned])
        first, count, copies = (np.array([s[k] for x in owned for s in x], np.int64) for k in ("first", "count", "copies"))
        row, start, high, low = window_hashes([split_words(t) for t in bytes_of(batch)], doc, first, count)
        of = pa.array(doc[row])
        cols = [batch.column("doc_id").take(of), batch.column("rid").take(of), pa.array(start, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(copies[row], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in WINDOWS.split(", ")])


def _same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["rid"] == b["rid"])


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(doc_id, rid, start, count): runs of windows of ``rows`` whose words also start elsewhere; runs may overlap."""
    spark = rows.sparkSession
    result = shared_dir(spark, "substring")
    folder = f"{result}/work"
    found = written(rows.mapInArrow(_anchor_rows, ANCHORS), f"{folder}/anchors")
    again = written(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), f"{folder}/again")
    seeds = written(found.join(again, "anchor", "left_semi"), f"{folder}/seeds")
    # Extension over all owned words: classes of equal words, with one occurrence to stand for each.
    kind = ["anchor", "high", "low"]
    classes = written(seeds.groupBy(*kind).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "rid", "first", "count")).alias("one")), f"{folder}/classes")
    full = seeds.join(classes.where("copies > 1").select(*kind), kind, "left_semi").select("doc_id", "rid", F.col("first").alias("start"), "count")
    # Extension window by window, where an anchor has classes that occur once beside others.
    mixed_anchors = written(classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1").select("anchor"), f"{folder}/mixed")
    stand = classes.join(mixed_anchors, "anchor", "left_semi").select("one.*", "copies")
    owned = stand.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("first", "count", "copies")).alias("owned"))
    texts = rows.join(owned.withColumnsRenamed({"doc_id": "d", "rid": "r"}).hint("shuffle_hash"), rows["doc_id"].eqNullSafe(F.col("d")) & (rows["rid"] == F.col("r")))
    windows = written(texts.select("doc_id", "rid", "text", "owned").mapInArrow(_window_rows, WINDOWS), f"{folder}/windows")
    shared = written(windows.groupBy("high", "low").agg(F.sum("copies").alias("n")).where("n > 1").select("high", "low"), f"{folder}/shared")
    single = windows.where("copies = 1").join(shared, ["high", "low"], "left_semi").select("doc_id", "rid", "start", F.lit(1).alias("count"))
    out = written(full.unionByName(single), f"{result}/repeated")
    drop(spark, folder)
    return out


def _keep(words: list[bytes], runs) -> list[bytes]:
    """Words that none of the runs of windows covers."""
    if runs is None or not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        edge[run["start"]] += 1
        edge[run["start"] + run["count"] - 1 + LENGTH] -= 1
    return [w for w, covered in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not covered]


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document's words without the repeated ones, joined by one space."""
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    runs = repeated_windows(rows).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("start", "count")).alias("runs")).withColumnsRenamed({"doc_id": "d", "rid": "r"})
    joined = rows.join(runs.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(F.col("d")) & (rows["rid"] == F.col("r")), "left").select("doc_id", "text", "runs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_words = [split_words(t) for t in bytes_of(batch)]
            kept = [_keep(w, r) for w, r in zip(all_words, batch.column("runs").to_pylist(), strict=True)]
            cols = [batch.column("doc_id"), pa.array([len(w) for w in all_words], pa.int64()), pa.array([len(w) - len(k) for w, k in zip(all_words, kept, strict=True)], pa.int64()), pa.array([b" ".join(k) for k in kept], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def brute_force(texts: list[str | None]) -> list[tuple[int, int, str]]:
    """What ``cut`` gives, from all windows of all texts at once; for tests."""
    seen: dict[tuple[str, ...], int] = {}
    split = [words_of(t or "") for t in texts]
    for words in split:
        for i in range(len(words) - LENGTH + 1):
            key = tuple(words[i : i + LENGTH])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for words in split:
        gone = {j for i in range(len(words) - LENGTH + 1) if seen[tuple(words[i : i + LENGTH])] > 1 for j in range(i, i + LENGTH)}
        kept = [w for j, w in enumerate(words) if j not in gone]
        out.append((len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that occur more than once."""
    kept = cut(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
