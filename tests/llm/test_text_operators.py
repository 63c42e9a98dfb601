"""Operators on texts against brute force, and their edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from taplight.llm import decontaminate, lm_scoring, near_dedup, quality, secret_scan, substring


def _corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(0, 120))] for _ in range(n // 3)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        if i % 3 == 0 and w:
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
        if i % 5 == 0:
            w += r.choice(base)[:60]
        out.append(" ".join(w))
    return out + ["", "", "one", "one", "two words"]


def test_near_duplicates_equal_brute_force(spark):
    texts = dict(enumerate(_corpus(250, 1)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, label string")
    assert dict(near_dedup.classes(docs).collect()) == near_dedup.brute_force(texts)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(near_dedup.brute_force(texts).values())


def test_near_duplicate_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    rows = sorted(((r["doc_id"] or 0, r["class_id"]) for r in near_dedup.classes(docs).collect()))
    assert rows == [(0, None), (1, 1), (2, 1), (4, 4), (4, 4)]
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    a = near_dedup.mixed(np.arange(1, 301, dtype=np.uint64))
    both = np.concatenate((a[:250], a[50:]))
    doc = np.repeat([0, 1], 250)
    s = near_dedup.sketches(doc, both, np.ones(500), 2, 4000)
    assert abs((s[0] == s[1]).mean() - 200 / 300) < 0.03


def test_substrings_equal_brute_force(spark):
    texts = _corpus(150, 2) + [None, "x " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substring.cut(docs).collect()}
    import hashlib

    for i, (n, gone, digest) in enumerate(substring.brute_force(texts)):
        assert (rows[i]["n_words"], rows[i]["n_removed"], hashlib.sha256(rows[i]["kept"].encode()).hexdigest()) == (n, gone, digest)
    assert substring.cut(docs.limit(0)).count() == 0


def test_secret_spans_and_ledger(spark):
    text = "é password = 'abcdefghijkl' AKIAABCDEFGHIJKLMN 0123456789abcdef0"
    assert [s[0] for s in secret_scan.find_secrets(text)] == ["assign", "access", "hex"]
    assert secret_scan.find_secrets("password=short tokens") == []
    path = secret_scan.shared_dir(spark, "t")
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (3, "clean"), (3, "clean")], "doc_id long, text string")
    assert secret_scan.update_ledger(docs, path) == 3
    assert secret_scan.update_ledger(docs, path) == 0
    more = docs.union(spark.createDataFrame([(9, "token: 0123456789abc")], "doc_id long, text string"))
    assert secret_scan.update_ledger(more, path) == 1
    found = secret_scan.digests(secret_scan.findings(more, path)).collect()
    assert len(found) == 6 and sum(r["n_assign"] for r in found) == 3
    kept = [r["text"] for r in secret_scan.redact(docs.withColumn("spans", docs.doc_id)).collect()]
    assert len(kept) == 5 and sum("[SECRET]" in (t or "") for t in kept) == 2 and None in kept


def test_alignment_equals_full_matrix():
    r = random.Random(4)
    for _ in range(300):
        p, q = [r.choice("abcd") for _ in range(r.randint(0, 12))], [r.choice("abc") for _ in range(r.randint(1, 10))]
        h = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        best = 0
        for i in range(1, len(p) + 1):
            for j in range(1, len(q) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if p[i - 1] == q[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        codes = {w: i for i, w in enumerate("abcd", 1)}
        assert decontaminate.align(np.array([codes[w] for w in p], int), np.array([codes[w] for w in q]))[0] == best


def test_leaks_whole_edited_and_clean(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(40)] for _ in range(6)] + [["solo"]]
    filler = [[word() for _ in range(100)] for _ in range(30)]
    edited = list(items[1])
    for k in (5, 12, 19, 26, 33):
        edited[k] = "changed"
    docs = [(i, " ".join(f)) for i, f in enumerate(filler)]
    docs += [(100, " ".join(filler[0][:20] + items[0] + filler[1][:20])), (101, " ".join(filler[2][:50] + edited)), (102, None), (None, " ".join(items[2]))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (50, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(table, bench).collect()}
    assert set(found) == {(100, 0), (101, 1), (None, 2)}
    assert found[100, 0]["score"] == 1 and (found[100, 0]["start"], found[100, 0]["stop"]) == (20, 60)
    kept = decontaminate.drop_leaked(table, bench)
    assert kept.count() == 31 and decontaminate.leaks(table.limit(0), bench).count() == 0


def test_quality_is_learnt_and_held_out(spark):
    from pyspark.sql import functions as F

    base = "/root/testdata/sf0.01"
    rows = quality.op4_quality(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where(F.col("held_out")).toPandas()
    order = rows["score"].rank().to_numpy()
    good = rows["quality"].to_numpy() == 1
    auc = (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert {r[0] for r in docs.select(quality.score_column(model, docs["text"])).collect()} == {0.5}


def test_language_model_learns(spark):
    r = random.Random(6)
    texts = [" ".join(w for _ in range(60) for w in r.choice((["a", "b", "c"], ["d", "e"]))) for _ in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, "")], "doc_id long, text string")
    ids = lm_scoring.tokenized(docs)
    rows = {r["doc_id"]: r for r in lm_scoring.score(ids, lm_scoring.fit(ids, rounds=3)).collect()}
    assert rows[1000]["log_likelihood"] == 0 and rows[1001]["mean_log_likelihood"] is None
    before = {r["doc_id"]: r for r in lm_scoring.score(ids, lm_scoring.fit(ids, rounds=0)).collect()}
    mean = lambda found: np.mean([found[i]["mean_log_likelihood"] for i in range(80)])
    assert mean(rows) > mean(before) + 0.02
    empty = lm_scoring.tokenized(docs.limit(0))
    assert lm_scoring.score(empty, lm_scoring.fit(empty)).count() == 0


def _vocabulary():
    return lm_scoring.Vocabulary((1e6 / (1 + np.arange(lm_scoring.BUCKETS))).astype(int))


def test_network_step_follows_the_gradient():
    # Central differences of the loss over every kind of weight against one plain step of the tables' gradient.
    v = _vocabulary()
    r = np.random.default_rng(2)
    w = lm_scoring.initial(v)
    ids, sizes = r.integers(0, 3000, 40), np.array([25, 0, 15])
    x = lm_scoring.contexts(v.row[ids], sizes)
    loss = lambda weights: -lm_scoring.log_probabilities(weights, x, v, ids).astype(float).sum() / len(ids)
    t = lm_scoring.Trainer(w, v)
    t.learn(x, ids)
    for row in (int(x[0, 3]), int(x[3, 30]), lm_scoring.TABLES, lm_scoring.TABLES + 5, lm_scoring.TABLES + 1 + lm_scoring.CLASSES + 3, lm_scoring.TABLES + 1 + lm_scoring.OUT):
        for k in (0, 7):
            up, down = w.copy(), w.copy()
            up[row, k] += 0.02
            down[row, k] -= 0.02
            slope = (loss(up) - loss(down)) / 0.04
            if abs(slope) > 1e-4:
                assert np.sign(slope) == -np.sign(t.weights[row, k] - w[row, k])
    before = loss(w)
    for _ in range(30):
        t.learn(x, ids)
    assert loss(t.weights) < before - 0.5


def test_contexts_stop_at_the_ends_of_documents():
    sizes = np.array([4, 0, 1, 2])
    rows = np.arange(10, 17)
    docs = np.split(rows, np.cumsum(sizes)[:-1])
    want = [[d[i + k] if 0 <= i + k < len(d) else lm_scoring.EDGE for d in docs for i in range(len(d))] for k in lm_scoring.PLACES]
    got = lm_scoring.contexts(rows, sizes) - np.arange(len(lm_scoring.PLACES))[:, None] * (lm_scoring.EDGE + 1)
    assert got.tolist() == [list(map(int, w)) for w in want]


def test_probabilities_sum_to_one_and_equal_a_plain_sum():
    v = _vocabulary()
    r = np.random.default_rng(1)
    w = lm_scoring.initial(v)
    w[lm_scoring.TABLES :] += r.normal(0, 0.2, w[lm_scoring.TABLES :].shape).astype(np.float32)
    ids = np.arange(lm_scoring.BUCKETS)
    one = lm_scoring.contexts(v.row[[3, 70, 9000, 100, 4]], np.array([5]))[:, 2:3]
    each = lm_scoring.log_probabilities(w, np.repeat(one, len(ids), axis=1), v, ids).astype(float)
    assert abs(np.exp(each).sum() - 1) < 1e-3
    tables, bias, classes, first, second, class_bias = (x.astype(float) for x in lm_scoring._parts(w))
    hidden = np.tanh(tables[one[:, 0]].sum(axis=0) + bias)
    log_softmax = lambda z: z - np.log(np.exp(z).sum())
    for i in (0, 47, 48, 500, 60000):
        want = log_softmax(classes @ hidden + class_bias)[v.of[i]]
        if v.of[i] >= lm_scoring.OWN:
            want += log_softmax(first @ hidden + v.log_one[v.of[i] - lm_scoring.OWN])[v.one[i]] + log_softmax(second @ hidden + v.log_two[v.first[i]])[v.two[i]] + v.share[i]
        assert abs(each[i] - want) < 1e-3


def test_scores_do_not_depend_on_tasks(spark):
    texts = _corpus(120, 9)
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7]), (None, "x y"), (None, None)], "doc_id long, text string")
    found = []
    for parts in (1, 5):
        ids = lm_scoring.tokenized(docs.repartition(parts))
        model = lm_scoring.fit(ids, rounds=0)
        model = lm_scoring.train_round(ids, model, shard_tokens=2000)
        found.append(sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], round(r["log_likelihood"], 2)) for r in lm_scoring.score(ids, model).collect()))
    assert found[0] == found[1] and len(found[0]) == len(texts) + 3


def test_language_model_learns_tail_words_at_every_position(spark):
    # A rare word's neighbours tell which it is; it stands where a stride of 16 with offsets 0 and 7 never looks.
    r = random.Random(7)
    common = [f"c{i}" for i in range(96)]
    texts = []
    for k in range(1500):
        words = [r.choice(common) for _ in range(16)]
        words[2] = words[4] = "left" if k % 2 else "right"
        words[3] = f"{'l' if k % 2 else 'r'}{k % 40 // 2}"
        texts.append(" ".join(words))
    ids = lm_scoring.tokenized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model = lm_scoring.fit(ids, rounds=6)
    probe = [(0, "c1 c2 left l3 left c5"), (1, "c1 c2 right l3 right c5"), (2, "c1 c2 right r3 right c5"), (3, "c1 c2 left r3 left c5")]
    table = lm_scoring.tokenized(spark.createDataFrame(probe, "doc_id long, text string"))
    got = {x["doc_id"]: x["log_likelihood"] for x in lm_scoring.score(table, model).collect()}
    # Both swaps together leave what the frames and the words cost by themselves.
    assert got[0] + got[2] > got[1] + got[3] + 1


def test_leaks_in_other_case_and_punctuation(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(30)]
    before, after = " ".join(word() for _ in range(10)), " ".join(word() for _ in range(10))
    copies = {
        1: " ".join(item).upper(),
        2: " ".join(f'"{w},' if k % 2 else f"({w.title()}\u2026" for k, w in enumerate(item)),
        3: "\u00a0".join(item[:5]) + " " + " ".join(item[5:]),
        4: "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in " ".join(item)),
    }
    docs = [(i, f"{before} {t} {after}") for i, t in copies.items()] + [(9, f"{before} {after}")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item) + ".")], "item_id long, text string")
    found = {x["doc_id"]: (x["score"], x["start"], x["stop"]) for x in decontaminate.leaks(table, bench).collect()}
    assert found == {1: (1.0, 10, 40), 2: (1.0, 10, 40), 3: (1.0, 10, 36), 4: (1.0, 10, 40)}


def test_near_duplicates_that_differ_in_how_often_a_line_occurs(spark):
    r = random.Random(11)
    texts = {}
    for k in range(40):
        body = " ".join(f"b{k}_{r.randrange(10**6)}" for _ in range(60))
        line = " ".join(f"l{k}_{i}" for i in range(40))
        texts[2 * k], texts[2 * k + 1] = f"{body} {line}", " ".join([body, *[line] * r.choice((5, 50, 400))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(near_dedup.classes(docs).collect()) == near_dedup.brute_force(texts)


def test_blocks_give_a_spanning_forest():
    import pyarrow as pa

    sets = [list(range(100))] * 30 + [list(range(200, 300))] * 20 + [list(range(1000 + i * 100, 1100 + i * 100)) for i in range(10)]
    group = pa.table({"node": pa.array(range(60), pa.int64()), "label": pa.array(range(60), pa.int64()), "shingles": pa.array(sets, pa.list_(pa.int32()))})
    links = near_dedup._links_within(group).to_pydict()
    assert len(links["a"]) == 29 + 19 and all(a > b for a, b in zip(links["a"], links["b"], strict=True))


def test_clashing_columns_and_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, 5, 6), (1, text, 5, 6), (2, text, 7, 8), (3, None, None, None), (None, text, 1, 1)], "doc_id long, text string, kept__id long, leaked__id long")
    assert sorted(r["doc_id"] or 0 for r in near_dedup.keep_first(docs).collect()) == [0, 1, 3]
    bench = spark.createDataFrame([(9, text)], "item_id long, text string")
    left = decontaminate.drop_leaked(docs, bench)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [3]
    twice = spark.createDataFrame([(9, text), (10, text.upper())], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.leaks(docs, twice).collect()) == [(0, 9), (0, 10), (1, 9), (1, 10), (2, 9), (2, 10)]


def test_leaks_equal_alignment_of_all_pairs(spark):
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = {i: [r.choice(vocabulary) for _ in range(r.randint(12, 40))] for i in range(25)}
    docs = {}
    for d in range(80):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        if d % 2:
            copy = list(items[r.randrange(25)])
            for _ in range(r.randint(0, len(copy) // 5)):
                edit, k = r.randrange(3), r.randrange(len(copy))
                copy[k : k + (edit < 2)] = [] if edit == 0 else [r.choice(vocabulary)]
            words[len(words) // 2 : len(words) // 2] = copy
        docs[d] = words
    codes = {w: i for i, w in enumerate(vocabulary, 1)}
    want = set()
    for d, words in docs.items():
        for i, item in items.items():
            points = decontaminate.align(np.array([codes[w] for w in words], int), np.array([codes[w] for w in item]))[0] if words else 0
            if points >= decontaminate.LEAK * decontaminate.MATCH * len(item):
                want.add((d, i, points))
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], round(x["score"] * decontaminate.MATCH * len(items[x["item_id"]]))) for x in decontaminate.leaks(table, bench).collect()}
    assert got == want and len(want) >= 40


def test_recall_of_pairs_just_similar_enough(spark):
    # 250 pairs whose similarity lies between 0.80 and 0.84, and as many just below, which must stay apart.
    r = random.Random(31)
    texts, near, apart = {}, [], []
    while len(near) < 250 or len(apart) < 250:
        words = [f"v{r.randrange(10**7)}" for _ in range(r.randint(150, 400))]
        copy = list(words)
        for k in r.sample(range(len(copy)), max(1, round(len(copy) / 48))):
            copy[k] = f"u{r.randrange(10**7)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, copy))
        similar = len(a & b) / len(a | b)
        i = len(texts)
        kind = near if 0.80 <= similar < 0.84 else apart if 0.76 <= similar < 0.80 else None
        if kind is not None and len(kind) < 250:
            kind.append((i, i + 1))
            texts[i], texts[i + 1] = " ".join(words), " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = dict(near_dedup.classes(docs).collect())
    assert sum(found[a] == found[b] for a, b in near) >= 249
    assert not any(found[a] == found[b] for a, b in apart)


def test_no_edit_that_leaves_a_leak_hides_it(spark):
    """Every third word replaced, words put in between, words left out, frequent words all over: all pairs again."""
    r = random.Random(31)
    rare, frequent = [f"w{i}" for i in range(2000)], [f"f{i}" for i in range(12)]
    word = lambda share: r.choice(frequent if r.random() < share else rare)
    items = {i: [word(0.1 * (i % 10)) for _ in range(r.choice([1, 2, 3, 5, 12, 20, 35, 60]))] for i in range(60)}
    docs = {}
    for d in range(240):
        copy = list(items[d % 60])
        if d // 60 == 0:
            copy = [word(0.4) if k % 3 == d % 3 else w for k, w in enumerate(copy)]
        elif d // 60 == 1:
            copy = [x for w in copy for x in ((w, word(0.4)) if r.random() < 0.95 else (w,))]
        elif d // 60 == 2:
            copy = [w for w in copy if r.random() < 0.6]
        else:
            for _ in range(r.randint(0, max(1, len(copy) // 2))):
                edit, k = r.randrange(3), r.randrange(len(copy)) if copy else 0
                copy[k : k + (edit < 2)] = [] if edit == 0 else [word(0.4)]
        words = [word(0.4) for _ in range(r.randint(0, 150))]
        at = r.randint(0, len(words))
        docs[d] = words[:at] + copy + words[at:]
    codes = {w: i for i, w in enumerate(rare + frequent, 1)}
    want = {}
    for d, words in docs.items():
        for i, item in items.items():
            points = decontaminate.align(np.array([codes[w] for w in words], int), np.array([codes[w] for w in item]))[0] if words else 0
            if points >= max(decontaminate.LEAK * decontaminate.MATCH * len(item), 2 * min(3, len(item))):
                want[d, i] = points
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): round(x["score"] * decontaminate.MATCH * len(items[x["item_id"]])) for x in decontaminate.leaks(table, bench).collect()}
    assert got == want and len(want) > 300


def test_stretches_align_together_as_one_by_one():
    r = random.Random(8)
    for _ in range(40):
        some = [np.array([r.randint(0, 6) for _ in range(r.randint(0, 30))], int) for _ in range(r.randint(1, 150))]
        queries = [np.array([r.randint(1, 6) for _ in range(r.randint(1, 12))]) for _ in some]
        assert decontaminate.align_all(some, queries) == [decontaminate.align(s, q) for s, q in zip(some, queries, strict=True)]


def test_decontaminate_reads_each_text_once(spark):
    """Counting and alignment share the codes of one pass; there were two passes over the texts."""
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    leak = "Zebra quartz, violet harbour mingle oddly upon seven copper kettles"
    rows = [(1, f"some words before it {leak} and after it"), (2, "nothing here"), (None, None), (4, f"a b ﷺ {leak.upper()}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.udf(seen, "string")("text"))
    benchmark = spark.createDataFrame([(7, leak)], "item_id long, text string")
    found = decontaminate.leaks(docs, benchmark).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, 7, 1.0, 4, 14), (4, 7, 1.0, 2, 12)]
    assert read.value == len(rows)


def test_codes_of_words_are_those_of_their_normal_forms():
    forms = [w + e for w in ("abc", "x1", "") for e in ("", "\x01", "_", "$", "$_")] + ["\x7f", "a b"]
    coder = decontaminate.Coder({f: i for i, f in enumerate(dict.fromkeys(f for f in forms if f), 1)})
    words = [a + w + e for a in ("", "(", "$", "\x01", "\x7f") for w in ("Abc", "X1", "A\x1cB", "Ａbc") for e in ("", "!", "$", "\x01", "_", "$_")]
    for word in words:
        codes, _, _ = coder.encode([word.encode()])
        assert codes.tolist() == [coder.codes.get(f, 0) for f in decontaminate.normal_forms(word.encode())], repr(word)
