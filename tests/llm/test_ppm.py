import math
import random
import zlib
from collections import Counter

import pytest

from vellum.llm import ppm

ALPHABET = "abcé \n"


def words_of(t):
    return (t or "").encode().lower().split()


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_fixed_trie_equals_brute_force():
    train, ask = texts(1, 30), texts(2, 20) + ["", "zzz Q", None]
    a = ppm.Adaptive(3)
    for t in train:
        data = bytes([ppm.START]) * 3 + t.encode() + bytes([ppm.END])
        for i in range(3, len(data)):
            a.learn(data[i - 3 : i], data[i])
    w, _ = ppm.windows(train, 3)
    keys, counts = zip(*sorted(Counter(w.tolist()).items()))
    import numpy as np

    s = ppm.Scorer(ppm.Trie(np.array(keys, np.uint64), np.array(counts), 3), bits=6)
    for _ in range(2):
        for got, t in zip(s(ask), ask):
            assert got == pytest.approx(a.score(t, learn=False), abs=1e-9)


def test_prices_of_a_context_sum_to_one():
    import numpy as np

    train = texts(3, 30)
    w, _ = ppm.windows(train, 2)
    keys, counts = zip(*Counter(w.tolist()).items())
    trie = ppm.Trie(np.array(keys, np.uint64), np.array(counts), 2)
    for ctx in (b"ab", b"\xfe\xfe", b"zz", b" z"):
        symbols = [x for x in range(256) if x != ppm.START]
        p = trie.price(np.array([int.from_bytes(ctx + bytes([x]), "big") for x in symbols], np.uint64))
        assert sum(10**p) == pytest.approx(1)


def test_score_against_brute_force(spark):
    rows = [(i, t, 7) for i, t in enumerate(texts(5, 60))] + [(60, None, 1), (61, "", 1), (61, "", 1), (None, "a b a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    from pyspark.sql import functions as F

    trained = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(False))
    for max_words in (300_000, 2):
        got = {(r.doc_id, r.n_tokens): r for r in ppm.score(df, trained, order=2, max_words=max_words).collect()}
        train = [t for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
        c = Counter(w for t in train for w in [*words_of(t), None])
        n, v = sum(c.values()), len(c)
        assert len(spark.createDataFrame(rows, "doc_id long, text string, score int").collect()) == len(rows)
        for i, t, _ in rows:
            toks = [*words_of(t), None]
            r = got[(i, len(toks))]
            assert r.n_known == sum(c[w] > 0 for w in toks) and r.train_tokens == n
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks))


def test_empty_tables_and_no_training_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    assert ppm.score(df.limit(0), F.lit(True)).count() == 0
    got = {r.doc_id: r.score for r in ppm.score(df, F.lit(False)).collect()}
    assert got[2] == pytest.approx(-math.log10(255)) and got[1] == pytest.approx(-3 * math.log10(255))


def test_least_count_respects_the_bound(spark):
    df = spark.createDataFrame([(i, 1 + i % 37) for i in range(500)], "w long, n long")
    for most in (0, 10, 100, 499, 500):
        assert df.where(df.n >= ppm.least_count(df, most)).count() <= most


def test_adaptive_learns():
    a = ppm.Adaptive(4)
    first, second = a.score("the cat sat on the mat"), a.score("the cat sat on the mat")
    assert second > first


def reference(train, order):
    import numpy as np

    keys, counts = np.unique(ppm.windows(train, order)[0], return_counts=True)
    return ppm.Scorer(ppm.Trie(keys, counts, order))


def test_windows_beyond_those_sent_are_joined(spark):
    from pyspark.sql import functions as F

    rows = list(enumerate(texts(6, 80) + ["", None, "zzz Q"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for order in (1, 2, 5):
        want = reference([t for i, t in rows if i % 3], order)([t for _, t in rows])
        for most in (0, 60, 2_000_000):
            got = {r.doc_id: r.score for r in ppm.score(df, F.col("doc_id") % 3 != 0, order=order, max_windows=most).collect()}
            assert [got[i] for i, _ in rows] == pytest.approx(list(want))


def test_no_window_is_left_out_of_a_large_model(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    train = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=115_000)) for _ in range(20)]
    rows = [*enumerate(train), (100, train[0][:3000]), (101, train[7][50_000:50_400])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = reference(train, 5)
    assert len(model.trie.keys[5]) > 2_200_000
    got = {x.doc_id: x.score for x in ppm.score(df, F.col("doc_id") < 100).collect()}
    assert [got[100], got[101], got[0]] == pytest.approx(list(model([rows[20][1], rows[21][1], train[0]])))
