"""Language identification: TF-IDF and training against plain loops, held-out accuracy, edges."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from taplight.llm import language


def _plain_counts(text, buckets=language.BUCKETS):
    spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower())
    spaced = " " + " ".join(spaced.split()) + " "
    out = Counter()
    for order in language.ORDERS:
        for i in range(len(spaced) - order + 1):
            h = order
            for c in spaced[i : i + order]:
                h = (h * 0x110001 + ord(c)) % 2**64
            out[int(language.mixed(np.array([h], np.uint64))[0]) % buckets] += 1
    return out


def test_counts_equal_a_plain_loop(monkeypatch):
    monkeypatch.setattr(language, "PART", 7)
    for text in ["Straße, 12 o'clock!", "ñandú", "x", "été  été\n\tété", "A" * 50, "12 ---"]:
        some, n = language.counts(text)
        assert dict(zip(some.tolist(), n.tolist(), strict=True)) == dict(_plain_counts(text))


def test_training_equals_plain_loops():
    """Every weight, one at a time, by the rule as it is published."""
    r = random.Random(4)
    rows = [(np.array(sorted(r.sample(range(12), 4))), np.array([r.random() for _ in range(4)]), r.randrange(3)) for _ in range(40)]
    leader = language.Leader(12, 3)
    z, n = [[0.0] * 3 for _ in range(13)], [[0.0] * 3 for _ in range(13)]

    def weight(i, k):
        l1, l2 = (0.0, 0.0) if i == 12 else (language.L1, language.L2)
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - math.copysign(l1, z[i][k])) / ((language.BETA + math.sqrt(n[i][k])) / language.ALPHA + l2)

    for some, x, y in rows:
        leader.learn(some, x, y)
        cells = [*zip(some.tolist(), x.tolist(), strict=True), (12, 1.0)]
        w = {(i, k): weight(i, k) for i, _ in cells for k in range(3)}
        e = [math.exp(sum(w[i, k] * v for i, v in cells)) for k in range(3)]
        for i, v in cells:
            for k in range(3):
                g = v * (e[k] / sum(e) - (k == y))
                z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / language.ALPHA * w[i, k]
                n[i][k] += g * g
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)


def test_penalty_leaves_few_weights(monkeypatch):
    r = random.Random(1)
    rows = [(np.array(sorted(r.sample(range(2, 400), 20) + [y])), np.full(21, 0.2), y) for y in (r.randrange(2) for _ in range(600))]
    sizes = []
    for l1 in (0.0, 0.5):
        monkeypatch.setattr(language, "L1", l1)
        model = language.train(rows[:500], rows[500:], ["a", "b"], np.ones(400, np.float32))
        sizes.append(len(model.weights) - 1)
        assert sum(model.logits(s, x).argmax() == y for s, x, y in rows[500:]) > 90
    assert sizes[0] == 400 and sizes[1] < 200


def test_held_out_accuracy_and_calibration(spark):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang")
    rows = language.op11_language(spark, base).join(docs, "doc_id").where("held_out").collect()
    right = [x["lang"] == x["lang_pred"] for x in rows]
    assert len(rows) > 100 and np.mean(right) > 0.98
    assert abs(np.mean([x["score"] for x in rows]) - np.mean(right)) < 0.02


def test_document_counts_are_of_training_documents_only(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, None), (4, "12")], "doc_id long, text string")
    n, having = language.document_counts(docs)
    both = set(_plain_counts("abc")) & set(_plain_counts("abd"))
    assert n == 2 and having.sum() == len(_plain_counts("abc")) + len(_plain_counts("abd")) and all(having[b] == 2 for b in both)


def test_labels_of_the_held_out_fold_change_nothing(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = docs.withColumn("lang", F.when(fold, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    key = lambda f: sorted(f.collect())
    assert key(language.identify(docs, language.fit(docs))) == key(language.identify(changed, language.fit(changed)))


LONG = "der die das " * 40_000


def _edges(spark, langs):
    rows = [(1, None), (2, ""), (3, "12 -- ½ ²"), (4, LONG), (5, "the of and"), (5, "the of and"), (6, "a"), (None, "und der die"), (7, "퟿日本語")]
    return spark.createDataFrame([(i, t, langs[k % len(langs)], 1, "y") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, score int, h string")


@pytest.mark.parametrize("langs", [["en", "de", None], ["en"], [None], [""]])
def test_edges(spark, langs):
    docs = _edges(spark, langs)
    got = language.identify(docs, language.fit(docs)).collect()
    assert len(got) == docs.count() and all(0 <= x["score"] <= 1 for x in got)
    learnt = {x for x in langs if x is not None}
    for x in got:
        assert x["lang_pred"] in (learnt or {"und"}) or x["lang_pred"] == "und" and x["doc_id"] in (1, 2, 3)
        assert x["doc_id"] not in (1, 2, 3) or (x["lang_pred"], x["score"]) == ("und", 0.0)
    assert len({(x["lang_pred"], x["score"]) for x in got if x["doc_id"] == 5}) == 1
    assert language.identify(docs.limit(0), language.fit(docs.limit(0))).count() == 0
