"""Nulls, empty tables, repeats, very long texts, clashing columns and second writes, for every operator and the pipeline."""

import hashlib
import random
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taplight.llm import decontaminate, lm_scoring, matroska, near_dedup, piece_codec, quality, secret_scan, sst, substring, warc

LONG = " ".join(f"w{i % 977}" for i in range(120_000))
CLASH = "doc_id long, text string, blob string, ids string, hash long, label long, spans string, kept string, leaked string, media string, n_bytes long, rank long, words string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 2, 1, 1, *["y"] * 4, 1, 1, "z") for i, t in rows], CLASH)


ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "one two three"), (4, LONG), (5, "\x00    x"), (1, "other text of the same identifier")]


def _naive_secrets(text):
    """The base spans by reading the rules one character at a time."""
    word, value = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "+/_.=-"
    spans, at = [], 0
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    while at < len(text):
        found = None
        for name in names:
            if text[at : at + len(name)].lower() == name and text[at : at + len(name)].isascii():
                for quoted in (True, False):
                    p = at + len(name)
                    if quoted:
                        if p < len(text) and text[p] in "\"'":
                            p += 1
                        else:
                            continue
                    while p < len(text) and text[p] == " ":
                        p += 1
                    if p < len(text) and text[p] in ":=":
                        p += 1
                        while p < len(text) and text[p] == " ":
                            p += 1
                        if p < len(text) and text[p] in "\"'":
                            p += 1
                        start = p
                        while p < len(text) and text[p] in word + value:
                            p += 1
                        if p > start:
                            found = (start, p)
                            break
                if found:
                    break
        if found:
            if found[1] - found[0] >= 12:
                spans.append(("assign", at, found[1]))
            at = found[1]
        else:
            at += 1
    at = 0
    while at < len(text):
        if text[at : at + 4] == "AKIA":
            p = at + 4
            while p < len(text) and text[p] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
                p += 1
            if p > at + 4:
                if p - at >= 18:
                    spans.append(("access", at, p))
                at = p
                continue
        at += 1
    at = 0
    while at < len(text):
        p = at
        while p < len(text) and text[p] in "0123456789abcdef":
            p += 1
        if p - at >= 16:
            spans.append(("hex", at, p))
        at = max(p, at + 1)
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(spans, key=lambda s: (s[1], order[s[0]]))


def test_secrets_equal_a_naive_scan(spark):
    r = random.Random(21)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "apikey", "\"", "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeefdeadbeef00", "x/y+z=.-_", "é", "ſecret", "\n", "K", "Token=", "abcdefghijklmno"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(400)] + [None, "", LONG, "password=" * 50 + "aaaaaaaaaaaaaaaa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x["doc_id"]: x for x in secret_scan.digests(secret_scan.scan(docs)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = _naive_secrets(t or "")
        counts = [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == counts
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [x for x in rows[i]["spans"].split(",") if x]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)


def test_ledger_written_twice_counts_once(spark):
    docs = spark.createDataFrame([(1, "token: abcdefghijklmnop"), (2, "clean")], "doc_id long, text string")
    path = secret_scan.shared_dir(spark, "t")
    secret_scan.update_ledger(docs, path)
    spark.read.parquet(path).write.mode("append").parquet(path + "-copy")
    spark.read.parquet(path + "-copy").write.mode("append").parquet(path)
    assert secret_scan.findings(docs, path).count() == 2
    assert secret_scan.redact(docs, path).count() == 2
    empty = secret_scan.scan(docs.limit(0))
    assert empty.count() == 0


def test_edges_of_every_operator(spark):
    docs = _docs(spark, ROWS)
    empty = docs.limit(0)
    n = len(ROWS)
    key = lambda rows: sorted(-1 if x["doc_id"] is None else x["doc_id"] for x in rows)
    want = key([{"doc_id": i} for i, _ in ROWS])

    assert key(near_dedup.classes(docs).collect()) == want and near_dedup.keep_first(docs).columns == docs.columns
    assert near_dedup.keep_first(empty).count() == 0

    ids = lm_scoring.tokenized(docs)
    scored = lm_scoring.score(ids, lm_scoring.fit(ids)).collect()
    assert key(scored) == want and {x["n_tokens"] for x in scored if x["doc_id"] == 4} == {120_000}
    assert len({x["log_likelihood"] for x in scored if x["doc_id"] == 1}) == 2

    found = secret_scan.digests(secret_scan.scan(docs)).collect()
    assert key(found) == want and secret_scan.redact(docs).columns == docs.columns and secret_scan.redact(docs).count() == n

    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)] + [(1, 1), (2, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scores = docs.select("doc_id", "text", quality.score_column(model, docs["text"]).alias("s")).collect()
    assert key(scores) == want and all(0 <= x["s"] <= 1 for x in scores)
    assert len({x["s"] for x in scores if not x["text"]}) == 1 and len({x["s"] for x in scores if x["text"] == ROWS[0][1]}) == 1
    assert quality.keep_good(docs, labels).columns == docs.columns and quality.keep_good(empty, labels).count() == 0
    assert empty.select(quality.score_column(quality.fit(empty, labels.limit(0)), empty["text"])).count() == 0

    bench = spark.createDataFrame([(7, "two three four five"), (8, ""), (9, None), (7, "two three four five")], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs, bench).collect()} == {(1, 7)}
    assert key(decontaminate.drop_leaked(docs, bench).collect()) == key([{"doc_id": i} for i in (None, 2, 3, 4, 5)])
    assert decontaminate.leaks(empty, bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0

    assert key(matroska.digests(matroska.store(docs)).collect()) == want and matroska.digests(matroska.store(empty)).count() == 0

    folder = sst.shared_dir(spark, "t")
    manifest = sst.write_shards(docs, folder, sst.default_tokenizer(), 2, parts=3)
    assert key(sst.read_shards(manifest, folder).collect()) == want

    codes = piece_codec.round_trip(docs, piece_codec.default_model()).collect()
    assert key(codes) == want and piece_codec.round_trip(empty, piece_codec.default_model()).count() == 0

    cut = substring.cut(docs).collect()
    assert key(cut) == want
    assert sorted((x["n_words"], x["n_removed"]) for x in cut) == sorted((n, gone) for n, gone, _ in substring.brute_force([t for _, t in ROWS]))


def test_unbroken_texts_are_encoded_in_time():
    import time

    import sentencepiece

    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(150_000))
    began = time.perf_counter()
    ids = piece_codec.codec(piece_codec.default_model()).encode(text)
    assert time.perf_counter() - began < 20
    assert ids[:-1] == sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model()).encode(text)


def test_cut_off_media_says_so():
    data = matroska.mux(matroska.payload_of("abc" * 900), matroska.XIPH)
    for n in range(len(data)):
        try:
            matroska.demux(data[:n])
        except ValueError:
            pass
    r = random.Random(1)
    for _ in range(500):
        broken = bytearray(data[:400])
        broken[r.randrange(400)] = r.randrange(256)
        try:
            matroska.demux(bytes(broken))
        except ValueError:
            pass


def test_media_survives_storage_and_has_a_packet_table(spark):
    docs = spark.createDataFrame([(1, "a" * 5000), (2, None)], "doc_id long, text string")
    media = matroska.written(matroska.store(docs), matroska.shared_dir(spark, "t"))
    rows = {x["doc_id"]: x for x in matroska.with_packets(media).collect()}
    data = bytes(rows[1]["media"])
    assert b"".join(data[p["start"] : p["end"]] for p in rows[1]["packets"]) == matroska.payload_of("a" * 5000)
    assert len(rows[2]["packets"]) == 1
    payload = matroska.payload_of("a" * 5000)
    got = {x["doc_id"]: x for x in matroska.digests(media).collect()}[1]
    assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (5000, 5184, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got["media_bytes"] == len(data) and got["media_sha256"] == hashlib.sha256(data).hexdigest()


def test_table_lookup_finds_what_a_scan_finds(spark):
    r = random.Random(5)
    rows = [(r.randrange(-50, 400), f"text {r.randrange(10**6)}") for _ in range(600)] + [(None, "nameless"), (7, "x")] + [(11, f"hot {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = sst.shared_dir(spark, "t")
    manifest = sst.write_shards(docs, folder, sst.default_tokenizer(), 2, parts=5)
    wanted = spark.createDataFrame([(i,) for i in (*range(-60, 420, 3), 7, 11, None, 10**12)], "doc_id long")
    encoder = sst.IdEncoder(sst.default_tokenizer())
    chosen = {x["doc_id"] for x in wanted.collect()}
    want = sorted((str(i), b) for (i, _), b in zip(rows, encoder.encode([t for _, t in rows], 2), strict=True) if i in chosen)
    assert sorted((str(x["doc_id"]), bytes(x["ids"])) for x in sst.lookup(manifest, folder, wanted).collect()) == want


def test_archives_grow_and_are_replaced(spark):
    page = lambda i: spark.createDataFrame([(i, f"u{i}", f"page {i}", "c", 1)], "page_id long, url string, html string, payload_digest string, first_id long")
    path = warc.shared_dir(spark, "t")
    warc.archive(page(1), path)
    warc.archive(page(2), path)
    assert sorted(x["page_id"] for x in warc.page_records(spark, path).collect()) == [1, 2]
    warc.archive(page(3), path, mode="overwrite")
    assert [x["page_id"] for x in warc.page_records(spark, path).collect()] == [3]
    none = warc.shared_dir(spark, "t")
    warc.archive(page(1).limit(0), none)
    assert warc.page_records(spark, none).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_long_heads_are_read_whole_without_payload(spark, tmp_path, packed):
    head = b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * 20_000 + b"\r\nContent-Length: 77\r\n\r\n"
    data = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<a>", "Content-Type": "application/http; msgtype=response"}, head + b"z" * 77, packed)
    (tmp_path / f"a.warc{'.gz' * packed}").write_bytes(data + data)
    rows = warc.read_warc(spark, str(tmp_path), payload=False).collect()
    assert [(x["payload_length"], x["payload"]) for x in rows] == [(77, None)] * 2


def test_pipeline_with_nulls_ties_clashes_and_empty_tables(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet").limit(60).withColumns({"blob": F.lit("b"), "kept": F.lit(1), "leaked": F.lit(2)})
    some = docs.limit(5)
    odd = some.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    for name, table in (("documents", docs.union(some).union(odd)), ("labels", spark.read.parquet(f"{base}/labels.parquet")), ("benchmark", spark.read.parquet(f"{base}/benchmark.parquet"))):
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = docs
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [x["doc_id"] for x in rows if x["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 0 < len(ids) <= 60
    folder = f"{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0 and kept.columns[-1] == "leaked"


def test_near_dedup_worker_memory_is_bounded():
    """A full batch is sketched in pieces; the arrays of all its shingles at once took 96 MB for 4 MB of text."""
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(100_000)) for _ in range(700)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(map(str, range(1000))), pa.array(texts)], ["doc_id", "blob", "text"])
    for step in (near_dedup._sketched, near_dedup._shingle_sets):
        tracemalloc.start()
        out = list(step(iter([batch, batch.slice(0, 0)])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum((b.column(0).to_pylist() for b in out), []) == list(range(1000))
        assert most < 60e6
