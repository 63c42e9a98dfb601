"""Every stage of the pipeline on the smallest tables, held against brute force on that stage's own input."""

import hashlib

import pytest

import corpus_pipeline
from taplight.llm import near_dedup, piece_codec, secret_scan
from taplight.llm.common import shared_dir, table, written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = [table(spark, FOLDER, "documents")]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs.append(written(stage(spark, docs[-1], FOLDER), f"{shared_dir(spark, 'p')}/{n}"))
    return docs


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(kept):
    assert all(d.columns == kept[0].columns for d in kept[:-1])
    assert kept[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_good_documents_stay(spark, kept):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, FOLDER, "labels").collect()}
    left = set(_texts(kept[1]))
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in left for i in good) >= 0.97 * len(good)
    assert sum(i not in left for i in bad) >= 0.5 * len(bad)


def test_one_of_each_class_stays(kept):
    classes = near_dedup.brute_force(_texts(kept[1]))
    assert set(_texts(kept[2])) == set(classes.values())


def test_leaks_go_and_nothing_else(spark, kept):
    items = [r["text"] for r in table(spark, FOLDER, "benchmark").collect()]
    before = _texts(kept[2])
    leaked = {i for i, t in before.items() if any(x in t for x in items)}
    left = set(_texts(kept[3]))
    assert leaked.isdisjoint(left) and len(set(before) - left - leaked) <= 1


def test_secrets_are_covered(kept):
    before, after = _texts(kept[3]), _texts(kept[4])
    assert set(before) == set(after)
    for i, text in before.items():
        spans = secret_scan.find_secrets(text)
        if not spans:
            assert after[i] == text
        else:
            assert secret_scan.REDACTED in after[i] and all(text[a:b] not in after[i] for _, a, b in spans)


def test_pieces_equal_the_library(kept):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    texts = _texts(kept[4])
    rows = kept[5].collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]]) + [2]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
