"""The registered queries themselves, over a small folder of tables, against SQL or a plain version."""

import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from vellum.llm import decontaminate, licenses, packing, quality, queries, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("llm"))
    r = random.Random(3)
    pool = ["".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(150)]
    prose = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(i, prose(20)) for i in range(6)]
    docs, labels = [], []
    for i in range(160):
        toxic, good = i % 5 == 3, i % 3 != 0
        t = prose(r.randint(20, 80)) + (" vilewort " * 2 if toxic else "") + (" Café, ETC. " if i % 4 else "\n")
        t = t if good else " ".join(w.upper() + "!!" for w in t.split())
        t += "\nthis line is in a great many of the documents here" if i % 6 == 0 else ""
        t += " " + items[i % 6][1] if i % 20 == 7 else ""
        t += r.choice(["", " all rights reserved", " Released under teh MIT license", " cc-by cc by"])
        docs.append((i, t))
        labels.append((i, int(good), int(toxic)))
    docs += [(200, docs[1][1]), (201, docs[1][1] + " x"), (202, None), (203, ""), (204, prose(3000)), (205, "two words"), (205, "two words"), (None, docs[2][1])]
    labels += [(3, 0, 1), (None, 1, 1), (7, None, None)]
    big = "<p>page</p>" * 120
    rows = {
        "documents": ([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": (items, "item_id long, text string"),
        "pages": ([(i, f"http://h/{i}", big if i % 4 == 0 else f"<i>{i}</i>" * i) for i in range(40)] + [(90, None, None)], "page_id long, url string, html string"),
        "embeddings": ([(i, [r.uniform(-1, 1) for _ in range(8)], 0) for i in range(350)] + [(400, None, 0), (500, [float("nan")] * 8, 0)], "vec_id long, embedding array<float>, label int"),
    }
    con = duckdb.connect()
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{d}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return d, con, {k: v[0] for k, v in rows.items()}


def keyed(rows):
    return sorted(rows, key=lambda x: tuple(str(v) for v in x))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, tables, name):
    path, con, _ = tables
    got = queries.QUERIES[name](spark, path)
    want = con.execute(queries.ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    assert keyed(tuple(r) for r in got.select(*names).collect()) == keyed(want.fetchall())


def test_op1(spark, tables):
    path, _, rows = tables
    got = {(x.doc_id, x.item_id) for x in queries.op1_decontaminate(spark, path).collect()}
    want = set()
    for i, t, *_ in rows["documents"]:
        for k, item in rows["benchmark"]:
            p = decontaminate.normal(item).decode()
            if decontaminate.within(p, decontaminate.normal(t).decode(), int(0.2 * len(p))) is not None:
                want.add((i, k))
    assert len(want) >= 8 and got == want


def plain_ftrl(seen, alpha=1.0, beta=1.0, l1=8.0, l2=1.0, epochs=4):
    """One coordinate at a time, in dictionaries."""
    z, n = Counter(), Counter()

    def weight(i):
        lam = 0.0 if i == "bias" else l1
        if abs(z[i]) <= lam:
            return 0.0
        return -(z[i] - math.copysign(lam, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in seen:
            own = [*x, "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in [*z] if weight(i)}


def test_op2(spark, tables):
    path, _, rows = tables
    text = {}
    for i, t, *_ in rows["documents"]:
        text.setdefault(i, []).append(t)
    toxic = {}
    for i, _, y in rows["labels"]:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            toxic[i] = max(y, toxic.get(i, 0))
    seen = sorted((xxhash.xxh64_intdigest(str(i), 7), i, y, t) for i, y in toxic.items() for t in text[i])
    w = plain_ftrl([(toxicity.features(t, 20).tolist(), y) for _, _, y, t in seen])
    got = queries.op2_toxicity(spark, path).collect()
    assert len(got) == len(rows["documents"])
    score = lambda t: 1 / (1 + math.exp(-max(-35, min(35, w.get("bias", 0) + sum(w.get(i, 0) for i in toxicity.features(t, 20).tolist())))))
    want = {}
    for i, t, *_ in rows["documents"]:
        want.setdefault(i, []).append(score(t))
    for x in got:
        assert min(abs(x.score - s) for s in want[x.doc_id]) < 1e-5
        assert x.predicted == int(x.score >= 0.5) and x.held_out == (None if x.doc_id is None else zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    labels = {i: y for i, _, y in rows["labels"][:160]}
    held = [x for x in got if x.held_out and x.doc_id in labels]
    assert sum(x.predicted == labels[x.doc_id] for x in held) / len(held) > 0.9


def test_op6(spark, tables):
    path, _, rows = tables
    got = keyed(tuple(x) for x in queries.op6_licenses(spark, path).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans").collect())
    scanner, want = licenses.Scanner(), []
    for i, t, *_ in rows["documents"]:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
        x = scanner.scan(t)
        want.append((i, len(ws), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({b for _, b in places})), x["labels"], x["score"]))
    assert [g[:8] for g in got] == keyed(want)
    for x in got:
        assert all(s["first_word"] + s["n_words"] <= x[1] and s["label"] in x[6].split(",") for s in json.loads(x[8]))
    assert any(json.loads(x[8]) for x in got)


def test_op7(spark, tables):
    path, _, rows = tables
    docs = [(i, t) for i, t, *_ in rows["documents"]]
    fp = []
    for _, t in docs:
        ws = [w for w in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
        sh = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    part = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3 and part[a] != part[b]:
                old, new = part[a], part[b]
                part = [new if x == old else x for x in part]
    least = {p: min(docs[k][0] for k in range(len(docs)) if part[k] == p and docs[k][0] is not None) for p in set(part)}
    want = [(docs[k][0], f"{fp[k]:016x}", least[part[k]]) for k in range(len(docs))]
    assert keyed(tuple(x) for x in queries.op7_simhash(spark, path).collect()) == keyed(want)


def test_op8(spark, tables):
    path, _, rows = tables
    got = queries.op8_packing(spark, path).collect()
    e, want, total = packing.Encoder(queries.vocabulary()), [], 0
    for (i, *_), ids in zip(rows["documents"], e.whole([x[1] for x in rows["documents"]])):
        x = np.append(np.frombuffer(ids, "<u4"), np.uint32(0))
        total += len(x)
        want += [(i, k // 2048, k, len(x[k : k + 2048]), zlib.crc32(x[k : k + 2048].astype("<u4").tobytes())) for k in range(0, len(x), 2048)]
    assert keyed(tuple(x)[:5] for x in got) == keyed(want)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 2048
    assert len(by) <= -(-total // 2048) + 1


def plain_ordinal(seen, rate=0.1, l2=1e-5, epochs=4):
    """P(grade >= 1) = sigmoid(w . x - t): gradients of -log P of the grade by every weight, by dictionaries."""
    w, g2, t = Counter(), {}, 0.0
    for _ in range(epochs):
        for (i, v), y in seen:
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * x for k, x in zip(i, v)) - t))))
            own = Counter()
            for k, x in zip(i, v):
                own[k] += 1
            step = [((p - y) * x + l2 * w[k]) for k, x in zip(i, v)]
            for k, g in zip(i, step):
                g2[k] = g2.get(k, 1e-2) + g * g
            for k, g in zip(i, step):
                w[k] -= rate * g / math.sqrt(g2[k])
            t -= rate * 0.1 * (y - p)
    return w, t


def test_op9(spark, tables):
    path, _, rows = tables
    text, grade = {}, {}
    for i, t, *_ in rows["documents"]:
        text.setdefault(i, []).append(t)
    for i, y, _ in rows["labels"]:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            grade[i] = max(y, grade.get(i, 0))
    seen = sorted((xxhash.xxh64_intdigest(str(i), 7), i, y, t) for i, y in grade.items() for t in text[i])
    at = lambda t: tuple(x.tolist() for x in quality.features(t, 18))
    w, bound = plain_ordinal([(at(t), y) for _, _, y, t in seen])
    want = {}
    for i, t, *_ in rows["documents"]:
        want.setdefault(i, []).append(1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * x for k, x in zip(*at(t))) - bound)))))
    got = queries.op9_quality(spark, path).collect()
    assert len(got) == len(rows["documents"])
    for x in got:
        assert min(abs(x.tail_probability - s) for s in want[x.doc_id]) < 1e-6 and x.selected == (x.tail_probability >= 0.5)
        assert abs(x.expected_grade - x.tail_probability) < 1e-9
    labels = {i: y for i, y, _ in rows["labels"][:160]}
    held = [x for x in got if x.held_out and x.doc_id in labels]
    assert len(held) > 20 and sum(x.selected == bool(labels[x.doc_id]) for x in held) / len(held) > 0.95


def test_thresholds_follow_the_gradient():
    """The steps of a model of four grades go down the loss, as differences of it say."""
    r = np.random.default_rng(2)
    for y in range(4):
        m = quality.Ordinal(4, 6, rate=1e-4, l2=0.0)
        m.w[:] = r.normal(size=64)
        m.first, m.gaps = -0.3, np.array([0.2, -0.4])
        i, v = np.array([3, 9, 20]), np.array([1.0, 0.5, 2.0])

        def loss():
            t = np.concatenate([[1.0], m.tails(i, v), [0.0]])
            return -math.log(t[y] - t[y + 1])

        grads = []
        for get, put in ((lambda: m.first, lambda x: setattr(m, "first", x)), *((lambda k=k: m.gaps[k], lambda x, k=k: m.gaps.__setitem__(k, x)) for k in range(2))):
            x = get()
            put(x + 1e-6)
            up = loss()
            put(x - 1e-6)
            grads.append((up - loss()) / 2e-6)
            put(x)
        before = [m.first, *m.gaps]
        start = loss()
        m.learn(i, v, y)
        moved = [b - a for a, b in zip(before, [m.first, *m.gaps])]
        assert np.allclose(moved, [-1e-5 * g for g in grads], rtol=1e-3, atol=1e-12) and loss() < start


def test_op10(spark, tables):
    path, _, rows = tables
    docs = [(i, t or "") for i, t, *_ in rows["documents"]]
    words = lambda t: [w for w in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) if w]
    count = Counter()
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*words(t), None])
    total, kinds = sum(count.values()), len(count)
    price = lambda w: math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1)))
    want = keyed((i, len(words(t)) + 1, sum(w in count for w in [*words(t), None]), total, round(sum(map(price, [*words(t), None])), 6)) for i, t in docs)
    got = queries.op10_ppm(spark, path).collect()
    assert keyed((x.doc_id, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    assert all(x.score < 0 and x.held_out == (None if x.doc_id is None else zlib.crc32(str(x.doc_id).encode()) % 5 == 1) for x in got)
    assert sum(x.score for x in got) > sum(x.base_score for x in got)


def test_very_long_texts_count_to_their_end():
    r = random.Random(1)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(150_000))
    assert set(toxicity.features(long + " lastword", 20)) - set(toxicity.features(long, 20))
    assert len(quality.features(long, 18)[0]) > 10_000 and quality.shape("ab" * 50_000 + "1") == "a0"
    got = licenses.Scanner().scan(long + " cc by released under teh mit license")
    assert got["first_word"] == 150_000 and got["spans"][-1]["first_word"] == 150_002
