"""Runs: stretches of words that repeat with a period, found by enumerating maximal pairs.

A maximal pair is two places of a text whose following words are equal for ``depth`` words, and neither one word
earlier nor one word later.  Two places at a distance q with depth >= (EXPONENT - 1) * q span a stretch of length
q + depth with period q that no neighbour extends: a run, ready as it is.  Pairs at a multiple of the smallest period
span the same stretch, so the least distance of a stretch is its period.

The pairs come from the LCP-interval tree of a document's suffixes, bottom-up.  A node keeps its places in lists by
left word (the word in front); where children are joined, places of different left words make the pairs, of which only
those near enough for the length constraints are looked up.  Occurrences of one sequence at most half its length apart
are equally spaced (EXPONENT is 3 or more), and all but the first of them have one left word: so a place needs its nearest neighbours and one
list, never all other places, and the work is near-linear in the words also where a text is one word ten thousand times.

No pair of a run is shallower than SEED words, so only places whose next SEED words occur again in their document enter
the tree.  That test is by hashes and lets too many pass at most; all that follows compares the words themselves.

Defined results: a null text has no words; a text's runs depend on that text alone, so repeated rows get equal results;
texts are read whole.  Rows of a null identifier are kept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taplight.llm.common import bytes_of, holds_tables, id_and_text, small_batches, table
from taplight.llm.words import mixed, split_words

LENGTH, EXPONENT = 24, 3
KEPT_WORDS = 300_000

_numbers: dict[bytes, int] = {}


def seed_depth(length: int, exponent: int) -> int:
    """The least depth of any pair that is a run: for a distance q it is at least length - q and (exponent - 1) * q."""
    return max(1, min(max(length - q, (exponent - 1) * q) for q in range(1, length + 1)))


SEED = seed_depth(LENGTH, EXPONENT)
#: An odd multiplier of the hash that picks places, any odd number does.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """The words of several documents end to end, equal words as equal numbers."""
    holds_tables("periodic", _numbers.clear)
    if len(_numbers) > KEPT_WORDS:
        _numbers.clear()
    known = _numbers
    flat = [w for t in texts for w in t]
    for w in set(flat).difference(known):
        known[w] = len(known)
    return np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))


def _repeated_places(words: np.ndarray, doc: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Places whose next ``seed`` words may occur again in their document: all that do, and a few others."""
    n = len(words) - seed + 1
    if n < 2:
        return np.empty(0, np.int64)
    h = mixed(words.astype(np.uint64) + np.uint64(1))
    sums = h[:n].copy()  # Horner's rule: seed is small
    for k in range(1, seed):
        sums = sums * _BASE + h[k : k + n]
    sums = mixed(sums ^ mixed(doc[:n].astype(np.uint64) + np.uint64(1)))
    slot = (sums >> np.uint64(8)).astype(np.int64) & ((1 << max(10, (4 * n - 1).bit_length())) - 1)
    whole = np.arange(n) + seed <= end[doc[:n]]
    counts = np.bincount(slot[whole])
    return np.flatnonzero(whole & (counts[np.minimum(slot, len(counts) - 1)] > 1))


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def suffix_order(words: np.ndarray, doc: np.ndarray, end: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next ``seed`` words occur again in their document, in suffix order; and the group of equal ones of each.

    Ranks double their depth from round to round; only places that aren't told apart yet take part.
    """
    none = np.empty(0, np.int64)
    places = _repeated_places(words, doc, end, seed)
    if not len(places):
        return none, none
    n = len(words)
    edge = np.zeros(n + 2 * seed + 1, np.int64)  # whose words are needed: those of a place, and of the place after it
    np.add.at(edge, places, 1)
    np.add.at(edge, places + 2 * seed, -1)
    pool = np.flatnonzero(np.cumsum(edge)[:n])
    last = end[doc[pool]]
    rank = np.zeros(n + 1, np.int64)
    rank[pool] = _dense(doc[pool] * (int(words.max()) + 1) + words[pool])
    depth = 1
    while depth < seed:
        step = min(depth, seed - depth)
        after = np.where(pool + step < last, rank[np.minimum(pool + step, n)] + 1, 0)
        rank[pool] = _dense(rank[pool] * (len(pool) + 2) + after)
        depth += step
    counts = np.bincount(rank[places])
    places = places[counts[rank[places]] > 1]
    if not len(places):
        return none, none
    # From here a rank is the number of the first place of its group among all that are needed.
    needed = np.unique(np.concatenate((places, places + seed)))
    needed = needed[needed < n]
    needed = needed[np.argsort(rank[needed], kind="stable")]
    first = np.concatenate(([True], np.diff(rank[needed]) != 0))
    rank[needed] = np.flatnonzero(first)[np.cumsum(first) - 1]
    group = rank[places].copy()
    open_ = places
    while len(open_):
        after = open_ + depth
        after = np.where(after < end[doc[open_]], rank[np.minimum(after, n)] + 1, 0)
        order = np.lexsort((after, rank[open_]))
        open_, after, before = open_[order], after[order], rank[open_[order]]
        new_group = np.concatenate(([True], np.diff(before) != 0))
        new = new_group | np.concatenate(([True], np.diff(after) != 0))
        at = np.arange(len(open_))
        start = at[new][np.cumsum(new) - 1]
        rank[open_] = before + start - at[new_group][np.cumsum(new_group) - 1]
        size = np.diff(np.concatenate((at[new], [len(open_)])))
        open_ = open_[np.repeat(size > 1, size)]
        depth *= 2
    order = np.argsort(rank[places])
    return places[order], group[order]


def common_prefixes(words: np.ndarray, end: np.ndarray, order: np.ndarray, group: np.ndarray, seed: int) -> np.ndarray:
    """Words that each place has in common with the one before it in suffix order; 0 where groups change.

    Places are taken as they stand in the text: what a place has in common, the next one has but for one word.
    """
    out = np.zeros(len(order), np.int64)
    by_text = np.argsort(order)
    before = np.concatenate(([-1], order[:-1]))
    before[np.concatenate(([True], np.diff(group) != 0))] = -1
    depth, previous = 0, -2
    word, ends = words.tolist(), end.tolist()
    found = []
    for i, j in zip(order[by_text].tolist(), before[by_text].tolist(), strict=True):
        if j < 0:
            depth = 0
        else:
            depth = max(depth - 1, seed) if previous == i - 1 else seed
            stop = ends[i] - max(i, j)
            while depth < stop and word[i + depth] == word[j + depth]:
                depth += 1
        found.append(depth)
        previous = i
    out[by_text] = found
    return out


def _near_enough(order: np.ndarray, group: np.ndarray, common: np.ndarray, exponent: int) -> np.ndarray:
    """Which rows are of a group that has two places near enough for its deepest pair."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
    size = np.diff(np.concatenate((first, [len(group)])))
    deepest = np.maximum.reduceat(common, first)
    by_place = np.lexsort((order, group))
    gap = np.concatenate(([np.iinfo(np.int64).max], np.diff(order[by_place])))
    gap[first] = np.iinfo(np.int64).max
    return np.repeat(np.minimum.reduceat(gap, first) * (exponent - 1) <= deepest, size)


class Node:
    """Places below a node of the tree: all in text order, and in lists by left word."""

    __slots__ = ("lists", "places")

    def __init__(self, place: int, left: int) -> None:
        self.places = [place]
        self.lists = {left: [place]}


def _merge(into: list[int], more: list[int]) -> None:
    if 8 * len(more) < len(into):
        for p in more:
            insort(into, p)
    else:
        into.extend(more)
        into.sort()


def joined(a: Node, b: Node, depth: int, left: list[int], length: int, exponent: int, found: dict[tuple[int, int], int]) -> Node:
    """One node of two children; maximal pairs between them that are runs go to ``found`` as (start, end) -> period."""
    if len(a.places) < len(b.places):
        a, b = b, a
    reach = depth // (exponent - 1)
    places, n = a.places, len(a.places)

    def note(start: int, period: int) -> None:
        stretch = (start, start + period + depth)
        if depth + period >= length and period < found.get(stretch, 1 << 62):
            found[stretch] = period

    for p in b.places:
        k = bisect_left(places, p - reach)
        if k < n and (r := places[k]) < p and left[r] != left[p]:
            note(r, p - r)
        k = bisect_right(places, p)
        if k < n and (r := places[k]) <= p + reach and left[r] != left[p]:
            same = a.lists[left[r]]
            for r in same[bisect_left(same, r) : bisect_right(same, p + reach)]:
                note(p, r - p)
    _merge(places, b.places)
    for c, own in b.lists.items():
        if c in a.lists:
            _merge(a.lists[c], own)
        else:
            a.lists[c] = own
    return a


def document_runs(order: list[int], common: list[int], left: list[int], seed: int, length: int, exponent: int) -> dict[tuple[int, int], int]:
    """(start, end) -> period of the runs of one document, from its places in suffix order.  ``common`` has one entry
    more, the last 0: what the place has in common with the next one."""
    found: dict[tuple[int, int], int] = {}
    open_: list[tuple[int, Node]] = []
    for place, depth in zip(order, common, strict=True):
        node = Node(place, left[place])
        while open_ and open_[-1][0] > depth:
            deeper, other = open_.pop()
            node = joined(other, node, deeper, left, length, exponent, found)
        if depth < seed:
            continue
        if open_ and open_[-1][0] == depth:
            open_[-1] = (depth, joined(open_[-1][1], node, depth, left, length, exponent, found))
        else:
            open_.append((depth, node))
    return found


def runs_of(texts: list[list[bytes]], length: int = LENGTH, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, by start, then period."""
    seed = seed_depth(length, exponent)
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    words = numbered(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    order, group = suffix_order(words, doc, end, seed)
    if not len(order):
        return out
    common = common_prefixes(words, end[doc], order, group, seed)
    near = _near_enough(order, group, common, exponent)
    order, group, common = order[near], group[near], common[near]
    if not len(order):
        return out
    follows = np.concatenate((np.where(np.diff(group) == 0, common[1:], 0), [0])).tolist()
    left = np.concatenate(([-1], words[:-1]))
    left[(end - sizes)[sizes > 0]] = -1
    left_list = left.tolist()
    edges = np.flatnonzero(np.concatenate(([True], np.diff(doc[order]) != 0, [True])))
    places = order.tolist()
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        d = int(doc[order[a]])
        begin = int(end[d] - sizes[d])
        found = document_runs(places[a:b], follows[a:b], left_list, seed, length, exponent)
        out[d] = sorted((s - begin, e - s, q) for (s, e), q in found.items())
        out[d].sort(key=lambda r: (r[0], r[2]))
    return out


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words but for those that a run has after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edge[start + period] += 1
        edge[start + size] -= 1
    return [w for w, gone in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not gone]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each document's runs of at least ``length`` words and ``exponent`` periods, and its words
    with one period left of each run."""
    if length < 1 or exponent < 3:
        raise ValueError("a run has a word and three periods at least")
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split_words(t) for t in bytes_of(batch)]
            runs = runs_of(words, length, exponent)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32())
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            cells = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
            kept = pa.array([b" ".join(_kept(w, r)) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, cells), kept], ["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def brute_force(text: str, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """The runs of a text by trying all periods at all places; for tests."""
    words = split_words(text.encode())
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(length, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the crc32 h of its identifier, is periodic from word a = h // 10 % n on, with a
    period p = 1 + (n - a) // (3 + h // 10 % 8); the others, and those of a null identifier, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)))
    split = docs.select("doc_id", "text", chosen.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    placed = split.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    period = placed.withColumn("p", F.when(F.col("n") > 0, (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")))
    rest = F.col("n") - F.col("a")
    loop = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    return period.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(loop, F.lit(1), rest)), " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of each document's runs: how many, that of the greatest exact exponent (ties: the first), and hashes of runs and of what is kept."""
    runs = F.col("runs")
    greater = F.aggregate(runs, F.element_at(runs, 1), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    best = F.when(F.size(runs) > 0, greater)
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        *(F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them looped, and hashes of what is left without repeated periods."""
    return digests(collapse(looped(table(spark, sf_dir, "documents"))))
