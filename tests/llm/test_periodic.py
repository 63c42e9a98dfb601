"""Runs against trying all periods at all places."""

import hashlib
import random
import re
import zlib

import pytest

from taplight.llm import periodic


def _text(r):
    out, n, k = [], r.randint(0, 120), r.choice([1, 2, 3, 8])
    while len(out) < n:
        kind = r.random()
        if kind < 0.3:
            out += [f"w{r.randrange(k)}" for _ in range(r.randint(1, 10))]
        elif kind < 0.7:
            unit = [f"w{r.randrange(k + 3)}" for _ in range(r.randint(1, 14))]
            out += (unit * 60)[: r.randint(1, 60)]
        else:
            unit = [f"x{r.randrange(4)}" for _ in range(r.randint(16, 30))]
            for _ in range(r.randint(1, 4)):
                out += unit + [f"y{r.randrange(9)}"] * r.randint(0, 2)
    return " ".join(out)


@pytest.mark.parametrize(("length", "exponent", "seed"), [(24, 3, 1), (24, 3, 2), (1, 3, 3), (10, 4, 4)])
def test_runs_equal_brute_force(length, exponent, seed):
    r = random.Random(seed)
    for _ in range(60):
        texts = [_text(r) for _ in range(r.randint(1, 8))]
        got = periodic.runs_of([periodic.split_words(t.encode()) for t in texts], length, exponent)
        assert got == [periodic.brute_force(t, length, exponent) for t in texts]


def test_long_periodic_texts_take_near_linear_time():
    import time

    fib, after = "a", "a b"
    while len(fib) < 100_000:
        fib, after = after, f"{after} {fib}"
    phrase = " ".join(f"p{i}" for i in range(18))
    texts = ["a " * 100_000, "a b c " * 30_000, " ".join(f"u{i % 5000}" for i in range(100_000)), fib, " ".join(f"{phrase} L{i} M{i * 7 % 1000}" for i in range(5000))]
    began = time.perf_counter()
    got = periodic.runs_of([periodic.split_words(t.encode()) for t in texts])
    assert time.perf_counter() - began < 40
    assert got[:3] == [[(0, 100_000, 1)], [(0, 90_000, 3)], [(0, 100_000, 5000)]] and got[4] == [] and len(got[3]) > 1000


def _want(doc_id, text):
    """What the query returns for one document, word by word."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = periodic.brute_force(" ".join(words))
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = (None, None, None)
    for run in runs:
        if best[0] is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    base = "/root/testdata/sf0.001"
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()}
    got = {x[0]: tuple(x) for x in periodic.op13_runs(spark, base).collect()}
    assert got == {i: _want(i, t) for i, t in docs.items()}


def test_nulls_repeats_clashes_and_empty_tables(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, t) for i, t in enumerate([None, "", " \t\n", "x", "x " * 23, "x " * 24, "  a b " * 40, *(_text(r) for _ in range(60))])] + [(5, "x " * 24), (5, "other"), (None, "y " * 30)]
    docs = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, n long, p long, w string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda x: (str(x[0]), *map(str, x[1:]))
    assert sorted(map(tuple, periodic.op13_runs(spark, str(tmp_path)).collect()), key=key) == sorted((_want(i, t) for i, t in rows), key=key)
    assert periodic.collapse(docs.limit(0)).count() == 0
