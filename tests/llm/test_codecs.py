"""Encoding, shards, media and archives: exact round trips and library results."""

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from taplight.llm import matroska, piece_codec, sst, warc


def _texts(n, seed=1):
    r = random.Random(seed)
    letters = "ab the  ▁.,é漢字🙂\n\t\x00<s></s>1234567"
    return ["", " ", "a" * 5000, " " * 300 + "x"] + ["".join(r.choice(letters) if k % 2 else chr(r.choice([r.randint(32, 126), r.randint(0, 0x2FFF), 32, 101])) for _ in range(r.randint(0, 50))) for k in range(n)]


def test_pieces_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    codec = piece_codec.codec(piece_codec.default_model())
    for text in _texts(400):
        want = library.encode(text) + [2]
        assert codec.encode(text) == want
        assert codec.decode(want) == library.decode(want)
        assert codec.decode_decimal(" ".join(map(str, want))) == library.decode(want)


def test_piece_query_handles_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the cat", "x"), (1, "the cat", "y"), (None, None, "z"), (3, "", None)], "doc_id long, text string, ids string")
    rows = piece_codec.round_trip(docs, piece_codec.default_model()).collect()
    assert sorted(r["n_tokens"] for r in rows)[:2] == [1, 1] and len(rows) == 4
    ids = piece_codec.encode(docs, piece_codec.default_model())
    assert sorted(r["text"] for r in piece_codec.decode(ids, piece_codec.default_model()).collect()) == ["", "", "the cat", "the cat"]
    assert piece_codec.round_trip(docs.limit(0), piece_codec.default_model()).count() == 0


def test_shard_ids_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(sst.default_tokenizer())
    texts = _texts(400, 2) + ["a \n b", "a  \n", "it's '  s", "\x1c x\x85y"]
    got = sst.IdEncoder(sst.default_tokenizer()).encode(texts, 2)
    for text, ids in zip(texts, got):
        assert list(np.frombuffer(ids, "<u4")) == library.encode(text, add_special_tokens=False).ids + [2]


def test_added_tokens_in_texts_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(sst.default_tokenizer())
    texts = ["x <|endoftext|> y", "<|endoftext|>", " <|endoftext|><|endoftext|>", "a<|endoftext|>b  <|endoftext|>\n", "plain <|endoftext | > text", "x  y"]
    got = sst.IdEncoder(sst.default_tokenizer()).encode(texts, 2)
    for text, ids in zip(texts, got, strict=True):
        assert list(np.frombuffer(ids, "<u4")) == library.encode(text, add_special_tokens=False).ids + [2]
    assert list(np.frombuffer(got[0], "<u4")) == [87, 220, 50256, 331, 2]


@pytest.mark.parametrize("wide", [True, False])
def test_shard_lookup(tmp_path, wide):
    r = random.Random(3)
    rows = {i * 7 - 500: struct.pack("<3I", i, r.randint(0, 65535), 2) * r.randint(1, 400) for i in range(800)}
    writer = sst.ShardWriter(wide)
    for key in sorted(rows):
        writer.add(sst.key_of(key), rows[key])
    (tmp_path / "s").write_bytes(writer.bytes())
    fs, path = pafs.FileSystem.from_uri(str(tmp_path / "s"))
    with fs.open_input_file(path) as f:
        reader = sst.ShardReader(f)
        assert list(reader.scan()) == sorted(rows.items())
        assert len(reader.index) > 3
        for key in rows:
            assert reader.get(key) == [rows[key]]
        assert all(reader.get(key) == [] for key in range(-499, 4000) if key not in rows)


def test_shards_keep_order_nulls_and_repeats(spark):
    texts = [(5, "b"), (2, "the cat sat"), (2, "a"), (None, "n"), (9, None), (2, "a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    folder = sst.shared_dir(spark, "t")
    rows = sst.read_shards(sst.write_shards(docs, folder, sst.default_tokenizer(), 2, parts=3), folder).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 2, 2, 2, 5, 9]
    at = 0
    for row in rows:
        assert row["start"] == at
        at += row["n_tokens"]
    assert rows[-1]["ids_crc32"] == zlib.crc32(struct.pack("<I", 2))
    empty = sst.shared_dir(spark, "t")
    assert sst.read_shards(sst.write_shards(docs.limit(0), empty, sst.default_tokenizer(), 2), empty).count() == 0


@pytest.mark.parametrize("lacing", [matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
@pytest.mark.parametrize("size", [1, 575, 576, 4000, 600_000])
def test_media_round_trip(lacing, size):
    payload = matroska.payload_of("xé"[:1] * size)
    data = matroska.mux(payload, lacing)
    media = matroska.demux(data)
    assert b"".join(data[p.start : p.end] for p in media.packets) == payload
    assert [p.timestamp_ns for p in media.packets] == [i * 10_000_000 for i in range(len(media.packets))]
    assert len(media.cues) == media.clusters and media.tracks == {1: "A_PCM/INT/LIT"}


def test_unequal_laces():
    frames = [b"a" * 300, b"b" * 7, b"c" * 900, b"d" * 10]
    for lacing in (matroska.XIPH, matroska.EBML_LACING):
        body = matroska.block(1, -5, frames, lacing)
        found = list(matroska._block(body, 0, len(body), 100, 1_000_000, {1: 10}, 0, True))
        assert [body[p.start : p.end] for p in found] == frames and found[0].timestamp_ns == 95_000_000


def test_unknown_sizes_and_damage():
    cluster = matroska.element(matroska.CLUSTER_TIME, b"\0") + matroska.element(matroska.SIMPLE_BLOCK, matroska.block(1, 0, [b"xyz"], 0))
    open_cluster = b"\x1f\x43\xb6\x75\xff" + cluster
    data = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + open_cluster + open_cluster
    media = matroska.demux(data)
    assert media.clusters == 2 and [data[p.start : p.end] for p in media.packets] == [b"xyz", b"xyz"]
    with pytest.raises(ValueError):
        matroska.demux(b"\0\0\0")


def test_media_columns(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in matroska.digests(matroska.store(docs)).collect()}
    assert rows[1]["media_sha256"] == rows[2]["media_sha256"] and rows[3]["n_bytes"] == 0 and rows[3]["payload_bytes"] == 576
    assert rows[1]["payload_sha256"] == hashlib.sha256(b"a" + b"\xff" * 575).hexdigest()
    assert matroska.packets(matroska.store(docs)).count() == 3


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives(spark, compression):
    body = "<p>" + "x" * 200
    pages = spark.createDataFrame([(3, "u3", body), (1, "u1", body), (2, "u2", "short"), (4, "u4", "short"), (5, "u5", None), (None, "n", body)], "page_id long, url string, html string")
    path = warc.shared_dir(spark, "t")
    warc.archive(pages, path, compression=compression)
    rows = {r["page_id"]: r for r in warc.page_records(spark, path).collect()}
    assert len(rows) == 6
    assert rows[3]["record_type"] == "revisit" and rows[3]["refers_to"] == 1 and rows[3]["payload_bytes"] == 203
    assert all(rows[i]["record_type"] == "response" for i in (1, 2, 4, 5, None))
    assert rows[5]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    some = warc.read_warc(spark, path).where("target_uri like 'u%' and record_type in ('response')").select("record_id", "payload").collect()
    assert len(some) == 4


def test_headers_alone_are_decoded_where_they_decide():
    data = b"".join(warc.record({"WARC-Type": t, "WARC-Record-ID": str(i)}, bytes(50_000), True) for i, t in enumerate(["request", "response", "request"]))
    class File(io.BytesIO):
        read_bytes = 0

        def size(self):
            return len(data)

        def read_at(self, n, at):
            File.read_bytes += n
            self.seek(at)
            return self.read(n)

    rows = list(warc.records(File(data), lambda h: h["warc-type"] == "response", True))
    assert [r[0] for r in rows] == ["1"] and len(rows[0][-1]) == 50_000


def test_token_words_are_kept_without_their_punctuation():
    """A word before different ASCII characters is one entry of the table (each was one of its own), and ids stay the library's."""
    encoder = sst.IdEncoder(sst.default_tokenizer())
    words, ends = [f"w{a}{b}" for a in "aeiou" for b in "klmnè"], [".", ",", "!!", "$$$", ")", "7", "'s", "_x", ""]
    texts = ["".join(f" {w}{e}" for w in words for e in ends), "it's x² abδ. é́x, a×B abc’s\n\nWord, 'lla (ab) µm."]
    expected = [encoder.library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts[1:] + texts[:1], 2)] == expected[::-1]
    encoder.kept.clear()
    encoder.encode(texts[:1], 2)
    assert len(encoder.kept) == len(words) + len(ends) - 1


def test_piece_words_stay_known(monkeypatch):
    """The table holds the distinct words of a larger corpus (it was cleared at 300 000); long words leave it again."""
    codec = piece_codec.PieceCodec(piece_codec.default_model())
    asked = []
    monkeypatch.setattr(codec, "encode_words", lambda words: asked.append(len(words)) or [[5]] * len(words))
    codec.digest_words([" ".join(f"w{i}" for i in range(400_000)) + " " + "x" * 100])
    assert codec.digest_words([f"w1 w2 {'x' * 100}", ""]) == [(f"5 5 5 {codec.end_id}", 4), (str(codec.end_id), 1)]
    assert asked == [400_001, 1]
