"""Near-duplicate documents by ProbMinHash.

A document is its set of 5-word shingles, each weighted by 1 + ln(times it occurs).  Every shingle sends arrivals of a
Poisson process, at a rate of its weight, to the registers of a sketch; a register keeps its first arrival, and a
shingle stops once its next arrival comes after every register's.  Two sketches agree in a register with the
probability Jaccard similarity of the weighted sets, which for weights that are all equal is the Jaccard similarity.
A document that repeats a shingle has a second sketch with all weights 1, so that it also meets a document that differs
from it in how often a line occurs.

Bands of registers give buckets.  A bucket's members are linked to its hub, never all to all; the hub is the member that
meets most others in all its buckets, so that copies of one text, each edited elsewhere, find that text.  What is still
apart after that, in buckets where several components meet, is compared exactly in pairs of blocks of bounded size; only
links leave a block, never pairs.  Each link is verified: shingle sets
of Jaccard similarity SIMILAR or more (from 32-bit hashes of shingles: a chance collision changes a count by one).
Classes are the components of the verified links, found in Spark by alternating stars.

Exact copies are one text throughout, so a text that a third of all documents share is sketched and linked once.

Defined results: a null text is the empty text; empty texts are copies of each other and near to nothing else; a text
of fewer than five words has one shingle, all of it; rows of equal identifier are one document, whatever their texts;
a null identifier has a null class.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taplight.llm.common import bytes_of, drop, free_name, id_and_text, pieces, shared_dir, small_batches, table, written
from taplight.llm.words import mixed, split_words, word_hashes, words_of

WORDS, SIMILAR = 5, (4, 5)
ROWS, BANDS = 6, 36
REGISTERS = ROWS * BANDS
#: Members of a block; what a bucket's hubs leave apart is compared block by block, at most two blocks in a task's hands.
BLOCK = 256
#: Pairs of a hub that are verified together.
SPLIT = 1000
#: Text whose shingles a worker holds at once; one text alone may be longer.
PIECE_BYTES = 512 << 10

_ROUND = 0x9E3779B97F4A7C15
_PLACE = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle of several documents, in order."""
    split = [split_words(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    hashes = word_hashes([w for s in split for w in s])
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(split)), sizes)
    value = np.zeros(n, np.uint64)
    padded = np.concatenate((hashes, np.zeros(WORDS, np.uint64)))
    ends = np.cumsum(sizes)[doc]
    for k in range(WORDS):
        inside = np.arange(n) + k < ends
        value = mixed(value * np.uint64(31) + np.where(inside, padded[k : k + n], np.uint64(0)) + np.uint64(k))
    first = np.arange(n) - (np.cumsum(sizes) - sizes)[doc]
    whole = (first + WORDS <= sizes[doc]) | (first == 0)
    return doc[whole], value[whole]


def counted(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document and how often each occurs."""
    order = np.argsort(value ^ mixed(doc.astype(np.uint64)))
    doc, value = doc[order], value[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(doc)), bool), (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))))
    return doc[new], value[new], np.diff(np.concatenate((new, [len(doc)])))


def sketches(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, documents: int, registers: int = REGISTERS) -> np.ndarray:
    """For each document and register the element that arrives there first; zero for a document without elements."""
    time = np.full(documents * registers, np.inf)
    winner = np.zeros(documents * registers, np.uint64)
    latest = np.full(documents, np.inf)
    arrival = np.zeros(len(element))
    number = 0
    while len(element):
        number += 1
        random = mixed(element + np.uint64(_ROUND * number & 0xFFFFFFFFFFFFFFFF))
        arrival = arrival - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        live = arrival < latest[doc]
        doc, element, weight, arrival, random = doc[live], element[live], weight[live], arrival[live], random[live]
        place = doc * registers + (mixed(random ^ _PLACE) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, place, arrival)
        first = arrival == time[place]
        winner[place[first]] = element[first]
        some = np.unique(doc)
        latest[some] = time.reshape(documents, registers)[some].max(axis=1)
    return winner.reshape(documents, registers)


def bands(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; different bands never share their keys but by chance."""
    keys = np.tile(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sketch), 1))
    for k in range(ROWS):
        keys = mixed(keys + sketch[:, k::ROWS])
    return keys.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE_BYTES):
        rows = batch.num_rows
        doc, value, count = counted(*shingles(bytes_of(batch)))
        keys = np.zeros((rows, 2, BANDS), np.int64)
        keys[:, 0] = bands(sketches(doc, value, np.ones(len(doc)), rows))
        # Where no shingle occurs twice, all weights are 1 and both sketches the same.
        of = np.zeros((rows, 2), bool)
        of[doc, 0] = True
        of[doc[count > 1], 1] = True
        some = of[doc, 1]
        if some.any():
            again = np.flatnonzero(of[:, 1])
            keys[again, 1] = bands(sketches(np.searchsorted(again, doc[some]), value[some], 1 + np.log(count[some]), len(again)))
        offsets = np.zeros(rows + 1, np.int32)
        np.cumsum(of.sum(axis=1) * BANDS, out=offsets[1:])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[of].ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("blob"), lists], ["doc_id", "blob", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE_BYTES):
        doc, value = shingles(bytes_of(batch))
        sets = [np.unique(v.astype(np.uint32)).view(np.int32) for v in np.split(value, np.searchsorted(doc, np.arange(1, batch.num_rows)))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int32()))], ["node", "shingles"])


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, label): the least node of each node's component, for all nodes of ``links`` (a, b) but the least.

    Large and small stars alternate until every node points to its component's least; each step is written, and what it
    was made from is deleted.
    """
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), f"{folder}/0")
    step = 0
    while True:
        step += 1
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("n")).union(edges.select("m", "v"))
        low = written(both.groupBy("u").agg(F.min("n").alias("low")).select("u", F.least("u", "low").alias("low")), f"{folder}/{step}a")
        large = written(both.where("n > u").join(low, "u").select(F.col("n").alias("v"), F.col("low").alias("m")).where("v <> m").distinct(), f"{folder}/{step}b")
        least = written(large.groupBy("v").agg(F.min("m").alias("low"), F.count("*").alias("n")), f"{folder}/{step}c")
        small = large.join(least, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v <> m").union(least.select("v", "low"))
        edges = written(small.distinct(), f"{folder}/{step}d")
        for done in (f"{step - 1}d" if step > 1 else "0", f"{step}a", f"{step}b", f"{step}c"):
            drop(links.sparkSession, f"{folder}/{done}")
        stars = edges.groupBy("v").count().where("count > 1").limit(1).union(edges.select(F.col("m").alias("v")).distinct().join(edges.select("v").distinct(), "v", "left_semi").withColumn("count", F.lit(1)).limit(1))
        if stars.isEmpty():
            return edges.select(F.col("v").alias("node"), F.col("m").alias("label"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shingle sets are similar enough.

    ``b`` is a hub; one of many pairs is dealt out over parts of SPLIT pairs, to each of which its set is sent once.
    """
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    parts = F.ceil(F.col("pairs") / SPLIT).cast("int")
    hubs = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("pairs"))
    right = hubs.join(sets.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("shingles").alias("y"))
    salted = pairs.select("a", "b").join(hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
    both = salted.join(left, "a").join(right, ["b", "part"]).withColumns({"i": F.size(F.array_intersect("x", "y")), "n": F.size("x") + F.size("y")})
    most, of = SIMILAR
    return both.where(F.least(F.size("x"), F.size("y")) * of >= F.greatest(F.size("x"), F.size("y")) * most).where((F.col("i") * of >= (F.col("n") - F.col("i")) * most) & (F.col("i") > 0)).select("a", "b").distinct()


def _links_within(group: pa.Table) -> pa.Table:
    """Links that join the components of a block or two which hold similar texts, from exact intersections of all sets.

    They are a spanning forest of the components, whatever the number of similar pairs.
    """
    node, label = group.column("node").to_numpy(), group.column("label").to_numpy()
    lists = group.column("shingles").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    values, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(len(node)), sizes)
    common = np.flatnonzero(np.bincount(column, minlength=len(values)) > 1)
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    both = np.zeros((len(node), len(node)), np.float32)
    for first in range(0, len(common), 16384):
        some = (place[column] >= first) & (place[column] < first + 16384)
        here = np.zeros((len(node), min(16384, len(common) - first)), np.float32)
        here[row[some], place[column[some]] - first] = 1
        both += here @ here.T
    most, of = SIMILAR
    similar = (both * of >= (sizes[:, None] + sizes[None, :] - both) * most) & (both > 0) & (label[:, None] < label[None, :])
    i, j = np.nonzero(similar)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    links = []
    for a, b in np.unique(np.column_stack((label[i], label[j])), axis=0).tolist():
        low, high = sorted((find(a), find(b)))
        if low < high:
            root[high] = low
            links.append((high, low))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with ``label``, the node itself where it has none."""
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) whose nodes have different labels."""
    label = labels.select(F.col("node").alias("l_node"), "label")
    one = pairs.join(label, F.col("a") == F.col("l_node"), "left").select("a", "b", F.coalesce("label", "a").alias("la"))
    return one.join(label, F.col("b") == F.col("l_node"), "left").where(F.col("la") != F.coalesce("label", "b")).select("a", "b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) for every row; the class is the least identifier of the documents linked to each other."""
    spark = docs.sparkSession
    small_batches(spark)
    result = shared_dir(spark, "near")
    folder = f"{result}/work"
    rows = id_and_text(docs, id_col, text_col)
    hashed = rows.select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("blob"), "text")
    sketched = written(hashed.mapInArrow(_sketched, "doc_id long, blob string, bands array<long>"), f"{folder}/sketched")
    first = written(sketched.where("doc_id is not null").groupBy("blob").agg(F.min("doc_id").alias("node")), f"{folder}/first")
    copies = written(sketched.join(first, "blob").where("doc_id is not null").select("doc_id", "node", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands")), f"{folder}/copies")
    same_id = copies.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()

    # Buckets of two or more texts, and their hubs.
    keyed = copies.where("size(bands) > 0").select("node", F.explode(F.array_distinct("bands")).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "members"), f"{folder}/shared")
    met = written(keyed.join(shared, "key"), f"{folder}/met")
    weight = written(met.groupBy("node").agg(F.sum("members").alias("weight")), f"{folder}/weight")
    hubs = written(met.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("less"))).alias("top")).select("key", (-F.col("top.less")).alias("hub")), f"{folder}/hubs")
    buckets = written(met.join(hubs, "key"), f"{folder}/buckets")
    stars = written(buckets.where("node <> hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("n")), f"{folder}/stars")
    wanted = written(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct(), f"{folder}/wanted")
    texts = hashed.join(wanted.hint("shuffle_hash"), hashed["doc_id"] == wanted["node"], "left_semi").select("doc_id", "text")
    sets = written(texts.mapInArrow(_shingle_sets, "node long, shingles array<int>"), f"{folder}/sets")

    # First each text with the hub that it meets most often, then with the other hubs that are still apart from it.
    best = stars.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("less"))).alias("top")).select("a", (-F.col("top.less")).alias("b"))
    linked = written(_verified(best, sets), f"{folder}/linked-best")
    labels = components(linked, f"{folder}/components-best")
    others = _apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), labels)
    linked = written(_verified(written(others, f"{folder}/others"), sets).union(labels.select("node", "label")), f"{folder}/linked-hubs")
    labels = components(linked, f"{folder}/components-hubs")

    # Then across the components that meet in a bucket, but for pairs with a hub, which are known by now.
    held = written(_labelled(buckets, labels), f"{folder}/held")
    open_keys = written(held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), f"{folder}/open")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    ends = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(own, other).alias("p"), F.greatest(own, other).alias("q")))
    dealt = held.join(open_keys, "key", "left_semi").where("node <> hub").select("key", "node", "label", F.explode(ends).alias("pair")).select("key", "pair.*", "node", "label")
    blocked = written(dealt, f"{folder}/blocked")
    several = written(blocked.groupBy("key", "p", "q").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "p", "q"), f"{folder}/several")
    compared = blocked.join(several, ["key", "p", "q"], "left_semi").join(sets, "node").select("key", "p", "q", "node", "label", "shingles")
    more = compared.groupBy("key", "p", "q").applyInArrow(_links_within, "a long, b long").distinct()

    final = components(written(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more).union(same_id), f"{folder}/links"), f"{folder}/components")
    by_node = _labelled(copies.select("doc_id", F.col("doc_id").alias("node")), final)
    nameless = sketched.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    out = written(by_node.select("doc_id", F.col("label").alias("class_id")).union(nameless), f"{result}/classes")
    drop(spark, folder)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the least identifier; all columns stay, null identifiers too.

    Of several rows of that identifier the one whose text sorts first stays.
    """
    name, rank = free_name(docs, "kept"), free_name(docs, "rank")
    found = classes(docs, id_col, text_col).where("doc_id = class_id").select(F.col("class_id").alias(name)).distinct()
    kept = docs.join(found, docs[id_col].cast("long") == F.col(name), "left_semi")
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_first())
    one = kept.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*docs.columns)
    return one.unionByName(docs.where(docs[id_col].isNull()))


def brute_force(texts: dict[int, str]) -> dict[int, int]:
    """Classes by comparing all pairs exactly; for tests."""
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = {tuple(w[k : k + WORDS]) for k in range(max(1, len(w) - WORDS + 1))} if w else set()
    label = {i: i for i in texts}

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if texts[i] == texts[j] or (both and both * SIMILAR[1] >= (len(sets[i] | sets[j])) * SIMILAR[0]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in ids}


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return classes(table(spark, sf_dir, "documents"))
