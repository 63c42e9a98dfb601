"""Token ids as sorted-string-table shards.

A shard holds documents in ascending order of identifier: blocks of prefix-compressed entries with restart points, then
a Bloom filter of the keys, a sparse index with each block's first key, and a fixed footer.  A reader finds one
document by the filter, a binary search in the index and another among the block's restart points, or scans in order.

Writing deals documents out by ranges of the identifier, so that shards follow one another; each task writes shards
of bounded size under names of its own to the shared folder, and only those that the committed manifest names count,
so tasks may be lost and run again.

Defined results: a null text is the empty text and has the end id alone; a null identifier sorts first; documents of
equal identifier keep rows of their own, ordered by a hash of the text.  Texts are encoded whole.  Words are encoded by the
tokenizers library once and kept in a bounded table: text falls apart before a space between other characters and
around white space just as the library's own splitting does.  A text that holds one of the tokenizer's added tokens
goes to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taplight.llm.common import filesystem, holds_tables, id_and_text, shared_dir, small_batches, table, written

BLOCK_BYTES, SHARD_BYTES, RESTART_EVERY = 64 << 10, 32 << 20, 16
BITS_PER_KEY, PROBES = 10, 7
MAGIC = b"TLSST1\r\n"
FOOTER = struct.Struct("<QQQQQQBI8s")  # filter, index: offset and length; documents, ids; bytes of an id; crc32 of filter and index
KEPT_WORDS, KEPT_LENGTH = 700_000, 48
#: Text between two of these starts is split alike with or without what stands around it (Unicode's white space).
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Latin letters before an ASCII character that is neither letter nor space end there too, so that a word is kept once whatever its punctuation.
_L = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_CHUNK = re.compile(f" ?[{_L}]++(?![^{_S}!-@\\[-`{{-~])| ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class IdEncoder:
    """The tokenizers library behind a bounded table of words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.kept: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        #: Bytes that each id stands for: a byte-level token has one character for each.
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self.wide = len(self.sizes) > 1 << 16

    def _chunks(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks.  Those of a space and other characters are encoded many at once, for the library parts
        their sequence before each space; the ids are dealt out again by the bytes that they stand for."""
        runs: list[str] = []
        rest: list[str] = []
        for c in new:
            (runs if c[0] == " " and not c[-1].isspace() else rest).append(c)  # a chunk of white space ends with such
        out = {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
        groups = [runs[i : i + 500] for i in range(0, len(runs), 500)]
        for group, e in zip(groups, self.library.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum(list(map(len, map(str.encode, group))))
            at = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
            data, last = ids.tobytes(), 0
            for c, i in zip(group, (at * 4).tolist(), strict=True):
                out[c] = data[last:i]
                last = i
        return out

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Ids of each text and the end id, as little-endian 32-bit numbers."""
        kept = self.kept
        holds_tables("shards", kept.clear)
        if len(kept) > KEPT_WORDS:
            kept.clear()
        whole = {n: np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for n, t in enumerate(texts) if self.added.search(t)}
        split = [[] if n in whole else _CHUNK.findall(t) for n, t in enumerate(texts)]
        found: set[str] = set()
        for chunks in split:
            found.update(chunks)
        fresh = self._chunks(list(found.difference(kept)))
        kept.update(fresh)
        end = struct.pack("<I", end_id)
        out = [(whole[n] if n in whole else b"".join(map(kept.__getitem__, chunks))) + end for n, chunks in enumerate(split)]
        for c in fresh:
            if len(c) > KEPT_LENGTH:
                del kept[c]
        return out


@cache
def encoder(path: str) -> IdEncoder:
    """The encoder of a worker process, made once."""
    return IdEncoder(path)


# -- the format ----------------------------------------------------------------------------------------------------


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    """Bytes that sort as (identifier, repeat) does; null first."""
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")) + repeat.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while data[at] > 127:
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
    return n | data[at] << shift, at + 1


class _Block:
    """Entries as (shared, own, value) lengths, key suffix and value; a restart shares nothing."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.n, self.last = 0, 0, b""
        self.restarts: list[int] = []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART_EVERY:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        part = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.parts.append(part)
        self.size += len(part)
        self.n += 1
        self.last = key

    def bytes(self) -> bytes:
        return b"".join(self.parts) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))


def _entries(block: bytes, at: int, end: int, last: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
    while at < end:
        shared, at = _read_varint(block, at)
        own, at = _read_varint(block, at)
        size, at = _read_varint(block, at)
        last = last[:shared] + block[at : at + own]
        at += own
        yield last, block[at : at + size]
        at += size


def _restarts(block: bytes) -> tuple[tuple[int, ...], int]:
    """Restart points, and where the entries end."""
    (n,) = struct.unpack_from("<I", block, len(block) - 4)
    end = len(block) - 4 - 4 * n
    return struct.unpack_from(f"<{n}I", block, end), end


def _probes(key: bytes, bits: int) -> Iterator[int]:
    h = xxhash.xxh64_intdigest(key[:9])
    step = (h >> 32) | 1
    for i in range(PROBES):
        yield (h + i * step) % bits


class ShardWriter:
    """One shard in memory, of bounded size; entries come in ascending order of key.

    Ids take two bytes each where the vocabulary allows, else four.
    """

    def __init__(self, wide: bool = True) -> None:
        self.wide = wide
        self.blocks: list[bytes] = []
        self.index, self.block, self.first = _Block(), _Block(), b""
        self.keys: list[bytes] = []
        self.size = self.ids = 0

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids`` as little-endian 32-bit numbers."""
        if not self.block.n:
            self.first = key
        self.block.add(key, ids if self.wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        self.keys.append(key)
        self.ids += len(ids) // 4
        if self.block.size >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block.n:
            data = self.block.bytes()
            self.index.add(self.first, struct.pack("<QQ", self.size, len(data)))
            self.blocks.append(data)
            self.size += len(data)
            self.block = _Block()

    def bytes(self) -> bytes:
        self._end_block()
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        tail = struct.pack("<Q", bits) + bytes(bloom)
        index = self.index.bytes()
        foot = FOOTER.pack(self.size, len(tail), self.size + len(tail), len(index), len(self.keys), self.ids, 4 if self.wide else 2, zlib.crc32(index, zlib.crc32(tail)), MAGIC)
        return b"".join([*self.blocks, tail, index, foot])


class ShardReader:
    """A shard behind a seekable file: the footer, filter and index are read first, blocks as they are asked for."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        at, n, index_at, index_n, self.documents, self.ids, self.width, crc, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        tail, index = file.read_at(n, at), file.read_at(index_n, index_at)
        if magic != MAGIC or zlib.crc32(index, zlib.crc32(tail)) != crc:
            raise ValueError("not a whole shard")
        (self.bits,), self.bloom = struct.unpack_from("<Q", tail), tail[8:]
        self.index = [(k, *struct.unpack("<QQ", v)) for k, v in _entries(index, 0, _restarts(index)[1])]
        self.firsts = [k for k, _, _ in self.index]

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        """(identifier, ids) in ascending order."""
        for _, at, n in self.index:
            block = self.file.read_at(n, at)
            for key, value in _entries(block, 0, _restarts(block)[1]):
                yield id_of(key), self._wide(value)

    def _wide(self, value: bytes) -> bytes:
        return value if self.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def get(self, doc_id: int | None) -> list[bytes]:
        """Ids of the documents of this identifier; none where there is none."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        out: list[bytes] = []
        first = max(0, bisect_right(self.firsts, key) - 1)
        for _, at, n in self.index[first:]:
            block = self.file.read_at(n, at)
            restarts, end = _restarts(block)
            start = max(0, bisect_right(restarts, key, key=lambda r: next(_entries(block, r, end))[0]) - 1)
            for k, value in _entries(block, restarts[start], end):
                if k[:9] == key[:9]:
                    out.append(self._wide(value))
                elif k > key:
                    return out
        return out


# -- tables --------------------------------------------------------------------------------------------------------

MANIFEST = "part int, shard int, path string, first_id long, last_id long, n_docs long, n_ids long, n_bytes long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every document and write the shards below ``folder``; returns the manifest, itself written there."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one identifier are dealt on by a hash, so that no identifier is too many for a task.
    rows = rows.withColumn("hash", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), "hash"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        wide = library.wide or end_id >= 1 << 16
        fs, base = filesystem(folder)
        fs.create_dir(base)
        part, made = TaskContext.get().partitionId(), 0
        shard, first, last, repeat = ShardWriter(wide), None, None, 0
        before: tuple = ()

        def close() -> pa.RecordBatch:
            data = shard.bytes()
            path = f"{base}/part-{part:06d}-{made:05d}-{uuid.uuid4().hex}.sst"
            with fs.open_output_stream(path) as f:
                f.write(data)
            cols = [part, made, path, first, last, len(shard.keys), shard.ids, len(data)]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5], strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, value in zip(ids, library.encode(batch.column("text").to_pylist(), end_id), strict=True):
                repeat = repeat + 1 if before == (doc_id,) else 0
                before = (doc_id,)
                if not shard.keys:
                    first = doc_id
                shard.add(key_of(doc_id, repeat), value)
                last = doc_id
                if shard.size + shard.block.size >= SHARD_BYTES:
                    yield close()
                    shard, made = ShardWriter(wide), made + 1
        if shard.keys:
            yield close()

    return written(dealt.mapInArrow(write, MANIFEST), f"{folder}/manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids before each shard: running sums within a part, on top of those of the parts before.

    One row per part meets in one task; the number of parts is set by the writer, not by the rows.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = parts.select("part", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(before, "part").withColumn("start", F.col("part_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).drop("part_start")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the shards, in order within each: (doc_id, start, n_tokens, ids_crc32)."""
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(path) as f:
                    ids, starts, counts, sums = [], [], [], []
                    for doc_id, value in ShardReader(f).scan():
                        ids.append(doc_id)
                        starts.append(start)
                        counts.append(len(value) // 4)
                        sums.append(zlib.crc32(value))
                        start += len(value) // 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = with_starts(manifest).select("path", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids binary): the documents of the wanted identifiers, found by each shard's filter, index and restarts.

    Wanted identifiers meet the parts' ranges, as many as the writer had tasks, and then the shards of their parts;
    each shard that any of them may be in is opened once.
    """
    spark = manifest.sparkSession
    names = wanted.select(wanted[id_col].cast("long").alias("id")).distinct()
    low = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit(1).alias("n"), F.col(c).alias("v"))).otherwise(F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("v")))
    shards = manifest.select("part", "path", low("first_id").alias("a"), low("last_id").alias("b"))
    ranges = F.broadcast(shards.groupBy("part").agg(F.min("a").alias("pa"), F.max("b").alias("pb")))
    key = names.withColumn("k", low("id"))
    near = key.join(ranges, (F.col("k") >= F.col("pa")) & (F.col("k") <= F.col("pb"))).join(shards, "part").where((F.col("k") >= F.col("a")) & (F.col("k") <= F.col("b")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        path, file, reader = None, None, None
        for batch in batches:
            ids, values = [], []
            for shard, doc_id in zip(batch.column("path").to_pylist(), batch.column("id").to_pylist(), strict=True):
                if shard != path:
                    if file:
                        file.close()
                    path, file = shard, fs.open_input_file(shard)
                    reader = ShardReader(file)
                for value in reader.get(doc_id):
                    ids.append(doc_id)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "ids"])
        if file:
            file.close()

    dealt = near.select("path", "id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path")
    return dealt.mapInArrow(read, "doc_id long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_shards(spark, sf_dir: str) -> DataFrame:
    """Every document's ids written to sorted-string-table shards and read back from them."""
    folder = shared_dir(spark, "shards")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), folder, default_tokenizer(), end_id=2), folder)
