"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is a stated query set that is put to all documents in blocks of bounded size, each of which fits a worker.
An item's seeds are its word n-grams that are improbable in the corpus: word frequencies are counted over all documents,
and a gram's rarity is the sum of its words' bits, so that a passage leaked into a third of all documents stays rare.
Where few grams of an item are rare, its rarest half are seeds.  Documents are joined with seeds; every hit proposes the
passage where the item would stand, passages that overlap are merged, and local alignment over words (match 2, other
word -1, gap -1) scores each.  The score is a fraction of what a whole copy would score.

Edits may leave no gram of several words whole.  So an item also has seeds of one word, its rarest, and they propose a
passage where enough of them stand together: an alignment of LEAK has a bounded number of the item's words unmatched and a
bounded span, so of R seeds at least R less that number stand within it.  R is chosen for each item so that chance
seldom brings that many together.  No alignment that counts escapes this, whatever the edits.

Counts, seeds and alignment compare words in a normal form (NFKC, case folded, outer punctuation stripped; a word of
punctuation alone stays), while ``start`` and ``stop`` count the document's own words.

Defined results: null texts are empty; empty documents and items match nothing; fewer words than a seed's are no leak, but
where the item itself has no more; rows of equal identifier are one document; of several passages that align with one item the best (the first
of equal ones) counts; null identifiers are kept.  Texts are read whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, pairwise
from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taplight.llm.common import bytes_of, drop, free_name, holds_tables, id_and_text, pieces, shared_dir, small_batches, table, text_of, written
from taplight.llm.words import mixed, split_words, words_of

SEED_WORDS, RARE_BITS = 3, 24.0
#: Share of a whole copy's alignment score from which a passage counts as a leak.
LEAK = 0.5
MATCH, OTHER, GAP = 2, -1, -1
#: Benchmark text that one pass puts to the documents.
BLOCK_BYTES = 16 << 20
#: Codes, as bytes, that are put to the benchmark at once; one text alone may have more.
PIECE_BYTES = 1 << 20
#: Words whose codes a worker keeps.
KEPT_WORDS = 300_000
#: Stretches whose words are counted at once.
STRETCHES = 20_000
#: Logarithm of the chance that words come together, at which an item needs no more seeds: common ones are many to look at.
CHANCE = -9.0
#: Stretches that are aligned together.
TOGETHER = 64


def normal_form(word: str) -> str:
    """The word as it is compared; where NFKC makes a space of a character, several words with a space between."""
    parts = []
    for part in unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", word).casefold()).split():
        a, b = 0, len(part)
        while a < b and unicodedata.category(part[a]) in _OUTER:
            a += 1
        while a < b and unicodedata.category(part[b - 1]) in _OUTER:
            b -= 1
        parts.append(part[a:b] or part)
    return " ".join(parts) or word


_OUTER = frozenset(("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sk"))
_OUTER_ASCII = "".join(c for c in map(chr, range(33, 127)) if unicodedata.category(c) in _OUTER)
_OUTER_BYTES, _UNPRINTABLE = _OUTER_ASCII.encode(), bytes([*range(32), 127])


def normal_forms(word: bytes) -> list[str]:
    """The words that a word in UTF-8 is compared as; one for almost all."""
    text = word.decode("utf-8", "replace")
    if text.isascii() and text.isprintable():
        return [(low := text.lower()).strip(_OUTER_ASCII) or low]
    return normal_form(text).split(" ")


def normal_words(text: str) -> list[str]:
    """Normal words of a text."""
    return [form for word in words_of(text) for form in normal_forms(word.encode("utf-8", "surrogatepass"))]


class Coder:
    """Codes of normal words, from 1; all others are 0.  Codes of own words are kept in a bounded table.

    An own word that is several normal ones has a negative number there, which stands for the list of their codes.
    """

    def __init__(self, codes: dict[str, int]) -> None:
        self.codes = codes
        self.of_ascii = {w.encode(): code for w, code in codes.items() if w.isascii()}
        self.known = _Known(self._learn)
        self.parted: list[list[int]] = [[]]

    def __reduce__(self):
        return Coder, (self.codes,)

    def clear(self) -> None:
        self.known.clear()
        del self.parted[1:]

    def _learn(self, word: bytes) -> int:
        if word.isascii() and word.translate(None, _UNPRINTABLE) == word:
            low = word.lower()
            return self.of_ascii.get(low.strip(_OUTER_BYTES) or low, 0)
        forms = normal_forms(word)
        if len(forms) == 1:
            return self.codes.get(forms[0], 0)
        self.parted.append([self.codes.get(f, 0) for f in forms])
        return 1 - len(self.parted)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Codes of the normal words of several texts end to end, where each text begins, and the place in its own
        text of the word that each code comes from (none if own and normal words are the same)."""
        holds_tables("benchmark", self.clear)
        if len(self.known) > KEPT_WORDS:
            self.clear()
        split = [split_words(t) for t in texts]
        starts = np.concatenate(([0], np.cumsum(list(map(len, split))))).astype(np.int64)
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(starts[-1]))
        if not (codes < 0).any():
            return codes, starts, None
        lists = [self.parted[-c] if c < 0 else [c] for c in codes.tolist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        own = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
        return np.array([c for x in lists for c in x], np.int64), np.concatenate(([0], np.cumsum(sizes)))[starts], np.repeat(own, sizes)


class Seeds(NamedTuple):
    """Items as codes; seed hashes in order, each with its items and places from ``first``."""

    sizes: tuple[int, ...]
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    items: list[np.ndarray]
    words: "WordSeeds"


class WordSeeds(NamedTuple):
    """Items of each code, from ``first``, and how often each has it; how many of its seeds an item needs together, and within which span."""

    first: np.ndarray
    item: np.ndarray
    times: np.ndarray
    need: np.ndarray
    span: np.ndarray


class _Known(dict):
    """Codes of own words, learnt as they come."""

    def __init__(self, learn) -> None:
        self.learn = learn

    def __missing__(self, word: bytes) -> int:
        self[word] = code = self.learn(word)
        return code


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each stretch of ``n`` codes; zero where one of them is zero."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    value, known = np.full(m, n, np.uint64), np.ones(m, bool)
    for k in range(n):
        value = mixed(value * np.uint64(31) + codes[k : k + m].astype(np.uint64))
        known &= codes[k : k + m] > 0
    return np.where(known, value, np.uint64(0))


def make_seeds(items: list[list[int]], counts: np.ndarray, total: int) -> Seeds:
    """Seeds of items, given as codes, from the corpus counts of all codes.

    A gram that many items share proposes them all at each hit, so it counts as less rare by the bits of that number.
    """
    bits = np.log2((total + 1) / (counts + 1.0))
    arrays = [np.array(words, np.int64) for words in items]
    grams = [(min(SEED_WORDS, len(a)), gram_hashes(a, min(SEED_WORDS, len(a)))) if len(a) else (0, np.empty(0, np.uint64)) for a in arrays]
    holders = Counter(h for _, hashes in grams for h in set(hashes.tolist()))
    rows: list[tuple[int, int, int]] = []
    for number, (a, (n, hashes)) in enumerate(zip(arrays, grams, strict=True)):
        if not n:
            continue
        rarity = [float(bits[a[k : k + n]].sum()) - log2(holders[h]) for k, h in enumerate(hashes.tolist())]
        least = min(RARE_BITS, sorted(rarity)[len(rarity) // 2])
        rows += [(h, number, k) for k, (h, r) in enumerate(zip(hashes.tolist(), rarity, strict=True)) if r >= least]
    rows.sort()
    keys, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
    item, place = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
    return Seeds(tuple(sorted({n for n, _ in grams if n})), keys, np.append(first, len(rows)), item, place, arrays, make_word_seeds(arrays, counts, total))


def hits(codes: np.ndarray, starts: np.ndarray, seeds: Seeds) -> tuple[np.ndarray, np.ndarray]:
    """Where in texts that lie end to end seeds stand, and which."""
    at, which = [], []
    for n in seeds.sizes if len(seeds.keys) else ():
        known = np.flatnonzero(codes)
        # Only stretches of known words are hashed.
        known = known[known + n <= len(codes)]
        for k in range(1, n):
            known = known[codes[known + k] > 0]
        value = np.full(len(known), n, np.uint64)
        for k in range(n):
            value = mixed(value * np.uint64(31) + codes[known + k].astype(np.uint64))
        index = np.minimum(np.searchsorted(seeds.keys, value), len(seeds.keys) - 1)
        hit = np.flatnonzero(seeds.keys[index] == value)
        hit = hit[np.searchsorted(starts, known[hit], side="right") == np.searchsorted(starts, known[hit] + n - 1, side="right")]
        at.append(known[hit])
        which.append(index[hit])
    return (np.concatenate(at), np.concatenate(which)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))


def least_points(n: int) -> int:
    """Points from which an alignment with an item of ``n`` words counts: LEAK of a whole copy's, and those of a seed's words."""
    return max(ceil(LEAK * MATCH * n), MATCH * min(SEED_WORDS, n))


def make_word_seeds(arrays: list[np.ndarray], counts: np.ndarray, total: int) -> WordSeeds:
    """For each item the rarest words, as many as make chance bring the needed number together seldom enough, or else least often."""
    share = (counts + 1.0) / (total + 1)
    codes, owners, times, need, span = [], [], [], np.ones(len(arrays), np.int64), np.ones(len(arrays), np.int64)
    for number, a in enumerate(arrays):
        n = len(a)
        span[number] = n + MATCH * n - least_points(n)
        words, places = np.unique(a, return_counts=True)
        order = np.argsort(share[words], kind="stable")
        words, places = words[order], places[order]
        needs = np.cumsum(places) - (n - ceil(least_points(n) / MATCH))
        by_chance = np.cumsum(share[words]) * span[number]
        with np.errstate(divide="ignore", invalid="ignore"):
            chance = np.where(needs > by_chance, needs - by_chance + needs * np.log(by_chance / needs), 0.0)  # Chernoff's bound
        chance = np.where(needs >= 1, chance, np.inf)
        best = int((chance <= max(CHANCE, chance.min())).argmax())
        need[number] = needs[best]
        codes.append(words[: best + 1])
        owners.append(np.full(best + 1, number))
        times.append(places[: best + 1])
    code, item, each = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (codes, owners, times))
    order = np.argsort(code, kind="stable")
    return WordSeeds(np.searchsorted(code[order], np.arange(len(counts) + 1)), item[order], each[order], need, span)


def together(codes: np.ndarray, starts: np.ndarray, seeds: WordSeeds) -> list[tuple[int, int, int]]:
    """(item, first, end) of the stretches, in texts that lie end to end, in which an item has as many word seeds as it needs.

    A stretch reaches as far as an alignment may that holds them.
    """
    copies = seeds.first[codes + 1] - seeds.first[codes]
    at = np.flatnonzero(copies)
    copies = copies[at]
    if not len(at):
        return []
    ends = np.cumsum(copies)
    own = np.repeat(seeds.first[codes[at]] - (ends - copies), copies) + np.arange(ends[-1])
    item = seeds.item[own].astype(np.uint16 if len(seeds.need) <= 1 << 16 else np.int64)
    order = np.argsort(item, kind="stable")
    item, place, own = item[order].astype(np.int64), np.repeat(at, copies)[order], own[order]
    last = np.arange(len(item)) + seeds.need[item] - 1
    inside = np.flatnonzero(last < len(item))
    last = last[inside]
    inside = inside[(item[last] == item[inside]) & (place[last] - place[inside] < seeds.span[item[inside]])]
    last = inside + seeds.need[item[inside]] - 1
    text = np.searchsorted(starts, place[inside], side="right") - 1
    same = place[last] < starts[text + 1]
    inside, last, text = inside[same], last[same], text[same]
    if not len(inside):
        return []
    # A word counts as often as the item has it: of those in a stretch, only its first ones.  Items with no stretch are left out.
    some = np.zeros(len(seeds.need), bool)
    some[item[inside]] = True
    kept = np.flatnonzero(some[item])
    inside, last = np.searchsorted(kept, inside), np.searchsorted(kept, last)
    item, place, own = item[kept], place[kept], own[kept]
    by_word = np.argsort(own.astype(np.uint16) if len(seeds.item) <= 1 << 16 else own, kind="stable")
    before = np.arange(len(own)) - seeds.times[own[by_word]]
    earlier = np.full(len(own), -1)
    earlier[by_word] = np.where((before >= 0) & (own[by_word[before]] == own[by_word]), by_word[before], -1)
    key = item * (int(starts[-1]) + 1) + place
    stop = np.searchsorted(key, item[inside] * (int(starts[-1]) + 1) + np.minimum(place[inside] + seeds.span[item[inside]], starts[text + 1]))
    enough = np.zeros(len(inside), bool)
    for i in range(0, len(inside), STRETCHES):
        a, size = inside[i : i + STRETCHES], stop[i : i + STRETCHES] - inside[i : i + STRETCHES]
        first = np.cumsum(size) - size
        each = np.repeat(a, size)
        counted = earlier[np.arange(len(each)) + np.repeat(a - first, size)] < each
        enough[i : i + STRETCHES] = np.add.reduceat(counted.astype(np.int64), first) >= seeds.need[item[a]]
    inside, last, text = inside[enough], last[enough], text[enough]
    first = np.maximum(place[last] - seeds.span[item[inside]] + 1, starts[text])
    end = np.minimum(place[inside] + seeds.span[item[inside]], starts[text + 1])
    return list(zip(item[inside].tolist(), first.tolist(), end.tolist(), strict=True))


def passages(found: list[tuple[int, int]], size: int, seeds: Seeds, more: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """(item, first, end) of the stretches that a text's (place, seed) hits propose, and ``more``; those of one item that overlap are merged."""
    by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, i in found:
        for k in range(seeds.first[i], seeds.first[i + 1]):
            item = int(seeds.item[k])
            length = len(seeds.items[item])
            start = p - int(seeds.place[k])
            slack = length // 4 + 2
            by_item[item].append((max(0, start - slack), min(size, start + length + slack)))
    for item, a, b in more:
        by_item[item].append((a, b))
    out = []
    for item, spans in by_item.items():
        spans.sort()
        first, end = spans[0]
        for a, b in spans[1:]:
            if a > end:
                out.append((item, first, end))
                first, end = a, b
            end = max(end, b)
        out.append((item, first, end))
    return out


def align_all(stretches: list[np.ndarray], queries: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(score, first, end) of the best local alignment of each stretch with its query, rows of codes; the first of equal ones.

    Codes of queries are above 0, so that 0 in a stretch equals none.  Those of like sizes are aligned together: shorter
    stretches end with 0, shorter queries with a code that nothing has.
    """
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(stretches)
    order = sorted(range(len(stretches)), key=lambda i: (len(stretches[i]), len(queries[i])))
    for at in range(0, len(order), TOGETHER):
        chosen = order[at : at + TOGETHER]
        for i, best in zip(chosen, _aligned([stretches[i] for i in chosen], [queries[i] for i in chosen]), strict=True):
            out[i] = best
    return out


def _padded(rows: list[np.ndarray], other: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), other, np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _aligned(stretches: list[np.ndarray], queries: list[np.ndarray]) -> list[tuple[int, int, int]]:
    codes, query = _padded(stretches, 0).T, _padded(queries, -1)
    n, each = query.shape[1], np.arange(len(query))
    steps, places = (np.arange(n + 1) * GAP).astype(np.int32), np.arange(n + 1, dtype=np.int32)
    row, start = np.zeros((len(query), n + 1), np.int32), np.zeros((len(query), n + 1), np.int32)
    best = np.zeros((len(query), 3), np.int64)
    for p in range(len(codes)):
        diagonal = row[:, :-1] + np.where(query == codes[p][:, None], np.int32(MATCH), np.int32(OTHER))
        up = row[:, 1:] + np.int32(GAP)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.full_like(row, p + 1)
        origin[:, 1:] = np.where(diagonal >= up, np.where(row[:, :-1] > 0, start[:, :-1], np.int32(p)), start[:, 1:])
        # Gaps in the stretch: a running maximum along the query, with the place that it comes from.
        lifted = new - steps
        top = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == top, places, np.int32(0)), axis=1)
        row, start = np.maximum(top + steps, 0), np.take_along_axis(origin, source, axis=1)
        k = row.argmax(axis=1)
        score = row[each, k]
        better = np.flatnonzero(score > best[:, 0])
        if len(better):
            best[better, 0], best[better, 1], best[better, 2] = score[better], start[better, k[better]], p + 1
    return [(a, b, c) for a, b, c in best.tolist()]


def align(passage: np.ndarray, query: np.ndarray) -> tuple[int, int, int]:
    """``align_all`` of one stretch."""
    return align_all([passage], [query])[0]


ENCODED = "doc_id long, codes binary, own binary"


def encoded(docs: DataFrame, coder: Coder, path: str) -> DataFrame:
    """Codes of all documents, a row for each, written to ``path``: what counts and aligns them reads no text again.

    ``own`` has the places of ``Coder.encode``; null where there are none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    kind = code_type(coder.codes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts, own = shared.value.encode(bytes_of(batch))
            cols = [batch.column("doc_id"), _cut(codes.astype(kind), starts), pa.nulls(batch.num_rows, pa.binary()) if own is None else _cut(own.astype("<i8"), starts)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "codes", "own"])

    out = written(docs.mapInArrow(rows, ENCODED), path)
    shared.destroy()
    return out


def code_type(codes: dict[str, int]) -> str:
    """Two bytes for a code where they do."""
    return "<u2" if len(codes) < 1 << 16 else "<i4"


def _cut(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of each text's values, which lie end to end."""
    data = values.tobytes()
    at = (starts * values.itemsize).tolist()
    return pa.array([data[a:b] for a, b in pairwise(at)], pa.binary())


def _joined(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """What ``Coder.encode`` gave for these rows."""
    rows = batch.column("codes").to_pylist()
    codes = np.frombuffer(b"".join(rows), kind).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(list(map(len, rows))))).astype(np.int64) // np.dtype(kind).itemsize
    places = batch.column("own")
    if places.null_count == len(rows):
        return codes, starts, None
    each = [np.arange(b - a) if x is None else np.frombuffer(x, "<i8") for x, (a, b) in zip(places.to_pylist(), pairwise(starts.tolist()), strict=True)]
    return codes, starts, np.concatenate(each)


def word_counts(codes: DataFrame, coder: Coder) -> np.ndarray:
    """Occurrences in all documents, as they were ``encoded``, of each code; at 0, of all other words."""
    width, kind = len(coder.codes) + 1, code_type(coder.codes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width, np.int64)
        for batch in batches:
            sums += np.bincount(np.frombuffer(b"".join(batch.column("codes").to_pylist()), kind), minlength=width)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], ["code", "n"])

    found = codes.select("codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(width, np.int64)
    out[found["code"].to_numpy(int)] = found["n"].to_numpy(int)
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark's items in blocks of about BLOCK_BYTES of text."""
    items = benchmark.select(benchmark[item_col].alias("item_id"), text_of(benchmark[text_col]).alias("item_text"))
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = ceil(size / BLOCK_BYTES)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b).collect()
        yield sorted(((r["item_id"], r["item_text"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


LEAKS = "doc_id long, item_id long, score double, start long, stop long"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start, stop) of every document and item that align; words from ``start`` to ``stop``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    folder = shared_dir(spark, "leaks")
    parts = []
    for number, block in enumerate(_blocks(benchmark, item_col, item_text_col)):
        # Items of equal words are one query.
        owners: dict[tuple[str, ...], list] = defaultdict(list)
        for item_id, text in block:
            if words := tuple(normal_words(text)):
                owners[words].append(item_id)
        coder = Coder({w: i for i, w in enumerate(dict.fromkeys(w for words in owners for w in words), 1)})
        codes = encoded(rows, coder, f"{folder}/codes-{number}")
        counts = word_counts(codes, coder)
        seeds = make_seeds([[coder.codes[w] for w in words] for words in owners], np.concatenate(([0], counts[1:])), int(counts.sum()))
        shared = spark.sparkContext.broadcast((code_type(coder.codes), seeds, list(owners.values())))

        def aligned(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kind, seeds, owners = shared.value
            for batch in pieces(batches, "codes", PIECE_BYTES):
                codes, starts, own = _joined(batch, kind)
                at, which = hits(codes, starts, seeds)
                doc = np.searchsorted(starts, at, side="right") - 1
                by_doc: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
                for n, p, i in zip(doc.tolist(), at.tolist(), which.tolist(), strict=True):
                    by_doc[n][0].append((p - int(starts[n]), i))
                for item, a, b in together(codes, starts, seeds.words):
                    n = int(np.searchsorted(starts, a, side="right")) - 1
                    by_doc[n][1].append((item, a - int(starts[n]), b - int(starts[n])))
                places = [(n, *passage) for n, (grams, words) in by_doc.items() for passage in passages(grams, int(starts[n + 1] - starts[n]), seeds, words)]
                scored = align_all([codes[starts[n] + a : starts[n] + b] for n, _, a, b in places], [seeds.items[item] for _, item, _, _ in places])
                found = []
                for (n, item, a, _), (points, first, end) in zip(places, scored, strict=True):
                    size = len(seeds.items[item])
                    if points >= least_points(size):
                        first, end = a + first, a + end
                        if own is not None:
                            first, end = int(own[starts[n] + first]), int(own[starts[n] + end - 1]) + 1
                        found += [(n, item_id, points / (MATCH * size), first, end) for item_id in owners[item]]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], [pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True))], ["doc_id", "item_id", "score", "start", "stop"])

        scored = codes.mapInArrow(aligned, LEAKS)
        best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("early"), "stop")).alias("top"))
        parts.append(written(best.select("doc_id", "item_id", "top.score", (-F.col("top.early")).alias("start"), "top.stop"), f"{folder}/{number}"))
        shared.destroy()
        drop(spark, f"{folder}/codes-{number}")
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], LEAKS)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows of equal identifier go together, all columns stay."""
    name = free_name(docs, "leaked")
    found = leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(F.col(name)), "left_anti")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, whole or edited."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
