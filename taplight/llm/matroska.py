"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

``mux`` stores a byte payload as one track of 8-bit PCM packets in a Matroska file; ``packets`` reads any Matroska
bytes into rows of (track, timestamp, byte range); ``payloads`` puts a track's packets together again.

Defined results: a null text is the empty text, a null media value gives no packets, and bytes that are not
Matroska raise ``ValueError`` naming the offset.  Rows that repeat stay; equal payloads give equal media bytes, for
nothing of the row but its payload is stored; an empty table gives an empty one; other columns are not looked at.  Elements of unknown identifier are skipped; an element of unknown
size ends where its parent ends or where an element of its own or a higher level begins.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taplight.llm.common import id_and_text, shared_dir, small_batches, table, written

#: Samples of a packet; at FREQUENCY samples a second a packet lasts 10 ms.
PACKET = 576
FREQUENCY = 57_600.0
PACKET_MS = 10
#: Packets that share a block (lacing), and packets of a cluster: 5 s, which a block's 16-bit time can span.
LACED = 8
CLUSTER_PACKETS = 496

# Identifiers from the Matroska specification (fixed values).
EBML, DOCTYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES}

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 2, 4, 6


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    start: int
    end: int
    keyframe: bool
    lacing: int
    cluster: int


class Media(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, str]
    clusters: int
    cues: list[tuple[int, int, int]]


# -- writing -------------------------------------------------------------------------------------------------------


def _size(n: int, width: int = 0) -> bytes:
    """A variable-length size of the least width, or of the given one; all ones are kept for 'unknown'."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _id(ident: int) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big")


def element(ident: int, body: bytes) -> bytes:
    return _id(ident) + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace_sizes(frames: list[bytes], lacing: int) -> bytes:
    """The sizes in a laced block's head: all but the last, which follows from the block's size."""
    if lacing == FIXED:
        return b""
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    out = _size(sizes[0])
    for before, n in zip(sizes, sizes[1:-1], strict=False):
        step = n - before
        width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
        out += _size(step + (1 << 7 * width - 1) - 1, width)
    return out


def block(track: int, time: int, frames: list[bytes], lacing: int) -> bytes:
    """A SimpleBlock's body; frames share it by lacing."""
    if len(frames) == 1:
        lacing = NO_LACING
    head = _size(track) + struct.pack(">hB", time, 0x80 | lacing)
    if lacing:
        head += bytes([len(frames) - 1]) + _lace_sizes(frames, lacing)
    return head + b"".join(frames)


def mux(payload: bytes, lacing: int = FIXED, packet: int = PACKET) -> bytes:
    """``payload`` as 8-bit PCM packets of one track, in laced blocks, clusters and with a cue for each cluster."""
    frames = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    head = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(DOCTYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(len(frames) * PACKET_MS))) + element(0x4D80, b"taplight") + element(0x5741, b"taplight"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", FREQUENCY)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(DEFAULT_DURATION, PACKET_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, len(frames), CLUSTER_PACKETS):
        body = [_uint(CLUSTER_TIME, first * PACKET_MS)]
        run = frames[first : first + CLUSTER_PACKETS]
        for i in range(0, len(run), LACED):
            body.append(element(SIMPLE_BLOCK, block(1, i * PACKET_MS, run[i : i + LACED], lacing)))
        parts.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, first * PACKET_MS) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    body = b"".join(parts)
    return head + _id(SEGMENT) + _size(len(body), 8) + body


# -- reading -------------------------------------------------------------------------------------------------------


def _width(first: int, most: int, at: int) -> int:
    width = 9 - first.bit_length()
    if not first or width > most:
        raise ValueError(f"not an EBML number at byte {at}")
    return width


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = _width(data[at], 4, at)
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A size and the byte after it; None is 'unknown'."""
    width = _width(data[at], 8, at)
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, stop: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, first byte, first byte of the body, end) of the elements between ``at`` and ``end``."""
    while at < end:
        ident, body = read_id(data, at)
        if ident in stop:
            return
        n, body = read_size(data, body)
        if n is None:
            inner = frozenset({SEGMENT, EBML} | (TOP_LEVEL if ident in TOP_LEVEL else set()))
            last = body
            for *_, last in elements(data, body, end, inner):
                pass
        else:
            last = body + n
        if last > end:
            raise ValueError(f"element {ident:X} at byte {at} passes the end of its parent")
        yield ident, at, body, last
        at = last


def _laces(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose head ended at ``at``."""
    if lacing == NO_LACING:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError(f"frames of unequal size in a fixed lacing at byte {at}")
        sizes = [(end - at) // n] * n
    elif lacing == XIPH:
        for _ in range(n - 1):
            total = 0
            while data[at] == 255:
                total, at = total + 255, at + 1
            sizes.append(total + data[at])
            at += 1
    else:
        first, at = read_size(data, at) if n > 1 else (0, at)
        sizes = [first or 0] * (n > 1)
        for _ in range(n - 2):
            width = _width(data[at], 8, at)
            step, at = read_size(data, at)
            sizes.append(sizes[-1] + (((1 << 7 * width) - 1) if step is None else step) - ((1 << 7 * width - 1) - 1))
    if lacing != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise ValueError(f"lacing passes the block's end at byte {at}")
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def _block(data: bytes, at: int, end: int, cluster_time: int, scale: int, lasts: dict[int, int], cluster: int, simple: bool) -> Iterator[Packet]:
    track, at = read_size(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    lacing = flags & 6
    for i, (a, b) in enumerate(_laces(data, at + 3, end, lacing)):
        yield Packet(track or 0, (cluster_time + time) * scale + i * lasts.get(track or 0, 0), a, b, simple and bool(flags & 0x80), lacing, cluster)


def demux(data: bytes) -> Media:
    """Packets, tracks, clusters and cues of a Matroska file's bytes."""
    try:
        return _demux(data)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"the file is cut off or lacks an element before byte {len(data)}") from e


def _demux(data: bytes) -> Media:
    packets: list[Packet] = []
    tracks: dict[int, str] = {}
    lasts: dict[int, int] = {}
    cues: list[tuple[int, int, int]] = []
    scale, clusters = 1_000_000, 0
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    for top, _, a, b in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        for kind, first, c, d in elements(data, a, b):
            if kind == INFO:
                for k, _, e, f in elements(data, c, d):
                    if k == TIMESTAMP_SCALE:
                        scale = uint(e, f)
            elif kind == TRACKS:
                for k, _, e, f in elements(data, c, d):
                    if k == TRACK_ENTRY:
                        entry = {i: (g, h) for i, _, g, h in elements(data, e, f)}
                        number = uint(*entry[TRACK_NUMBER])
                        tracks[number] = data[slice(*entry[CODEC])].decode("ascii", "replace")
                        lasts[number] = uint(*entry[DEFAULT_DURATION]) if DEFAULT_DURATION in entry else 0
            elif kind == CLUSTER:
                time = 0
                for k, _, e, f in elements(data, c, d, frozenset(TOP_LEVEL)):
                    if k == CLUSTER_TIME:
                        time = uint(e, f)
                    elif k == SIMPLE_BLOCK:
                        packets += _block(data, e, f, time, scale, lasts, first - a, True)
                    elif k == BLOCK_GROUP:
                        for i, _, g, h in elements(data, e, f):
                            if i == BLOCK:
                                packets += _block(data, g, h, time, scale, lasts, first - a, False)
                clusters += 1
            elif kind == CUES:
                for _, _, e, f in elements(data, c, d):
                    point = {i: (g, h) for i, _, g, h in elements(data, e, f)}
                    where = {i: uint(g, h) for i, _, g, h in elements(data, *point[CUE_POSITIONS])}
                    cues.append((uint(*point[CUE_TIME]) * scale, where[CUE_TRACK], where[CUE_CLUSTER]))
    return Media(packets, tracks, clusters, cues)


# -- columns -------------------------------------------------------------------------------------------------------


def payload_of(text: str) -> bytes:
    """UTF-8 with bytes 255 up to a positive multiple of the packet's size."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % PACKET or PACKET * (not data))


def _muxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        media = [mux(payload_of(t)) for t in texts]
        sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One media value per document: (doc_id, n_bytes, media)."""
    small_batches(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(_muxed, "doc_id long, n_bytes long, media binary")


_PACKETS = "doc_id long, packet int, track int, timestamp_ns long, start long, end long, keyframe boolean, lacing int, cluster long"


def packets(media: DataFrame) -> DataFrame:
    """The packet table of a media column: a row per packet with its track, timestamp and byte range in the media."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PACKETS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()]
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if data is not None and (found := demux(data).packets):
                    cols = [[doc_id] * len(found), range(len(found)), *zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(rows, _PACKETS)


_LISTED = pa.list_(pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def with_packets(media: DataFrame) -> DataFrame:
    """The media column with each file's packet table beside it, and how many clusters and cues it has."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [demux(data) for data in batch.column("media").to_pylist()]
            sizes = np.array([len(m.packets) for m in found], np.int64)
            flat = [p for m in found for p in m.packets]
            fields = [pa.array([p.track for p in flat], pa.int32()), *(pa.array([p[k] for p in flat], pa.int64()) for k in (1, 2, 3))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_LISTED.value_type)))
            more = [pa.array([m.clusters for m in found], pa.int32()), pa.array([len(m.cues) for m in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_bytes", "media")), lists, *more], ["doc_id", "n_bytes", "media", "packets", "clusters", "cues"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows, "doc_id long, n_bytes long, media binary, packets array<struct<track:int,timestamp_ns:long,start:long,end:long>>, clusters int, cues int")


def feature(n: int, clusters: int, cues: int, last_ns: int, payload: bytes) -> str:
    """Container counts and the samples' level, spread, sign changes about 128 and loudest packet."""
    samples = np.frombuffer(payload, np.uint8)
    centred = samples.astype(np.float64) - 128
    changes = int(np.count_nonzero((samples[1:] > 127) != (samples[:-1] > 127)))
    loud = np.sqrt(np.mean(centred.reshape(-1, PACKET) ** 2, axis=1))
    return f"packets={n};clusters={clusters};cues={cues};last_ms={last_ns // 1_000_000};mean={centred.mean():.4f};std={centred.std():.4f};changes={changes};loudest={int(loud.argmax())}:{loud.max():.4f}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        lists = batch.column("packets")
        offsets, (times, starts, ends) = lists.offsets.to_pylist(), (lists.values.field(i).to_pylist() for i in (1, 2, 3))
        for row, (data, clusters, cues) in enumerate(zip(batch.column("media").to_pylist(), batch.column("clusters").to_pylist(), batch.column("cues").to_pylist(), strict=True)):
            a, b = offsets[row], offsets[row + 1]
            payload = b"".join([data[i:j] for i, j in zip(starts[a:b], ends[a:b], strict=True)])
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(b - a, clusters, cues, times[b - 1], payload)))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])


def digests(media: DataFrame) -> DataFrame:
    """Payload and container digests and features of what ``store`` made: its bytes are cut out by their packet tables."""
    return with_packets(media).mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document's text written as a Matroska media value, read back through its packet table."""
    media = written(store(table(spark, sf_dir, "documents")), shared_dir(spark, "media"))
    return digests(media)
