import base64
import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from vellum.llm import decontaminate, licenses, packing, quality, topk, toxicity, warc
from vellum.llm.queries import vocabulary

WORDS = "alpha beta gamma delta omega sigma kappa theta iota zeta".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


# ---- toxicity -------------------------------------------------------------


def toxic_rows(n=300):
    r = random.Random(4)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, prose(r, 30) + (" " + " ".join(r.choice(["grumwort", "grumwortes", "blaxen"]) for _ in range(3)) if bad else "") + " " + prose(r, 10), int(bad), "x"))
    return rows


def test_toxicity_learns_and_never_uses_held_out_labels(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, s) for i, t, _, s in rows] + [(900, None, "x"), (901, "", "x"), (902, "", "x"), (None, "a", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, "toxic", toxicity.learnable(F.col("doc_id")))
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert len(got) == 304 and all(0 <= x <= 1 for x in got.values()) and got[900] == got[901] == got[902]
    held = [(got[i] >= 0.5) == bool(y) for i, _, y, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(held) / len(held) > 0.9
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped, "toxic", toxicity.learnable(F.col("doc_id")))
    assert (again["index"] == m["index"]).all() and np.allclose(again["weight"], m["weight"])


def test_toxicity_of_one_class_or_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert len(m["index"]) == 0 and toxicity.score(docs, m).first().score == 0.5
    assert toxicity.score(docs.limit(0), m).count() == 0


# ---- quality --------------------------------------------------------------


def test_quality_orders_three_grades(spark):
    r = random.Random(1)
    rows = []
    for i in range(300):
        g = i % 3
        ws = prose(r, 40).split()
        if g < 2:
            ws = [w.upper() + "!!" if r.random() < (0.9 if g == 0 else 0.4) else w for w in ws]
        rows.append((i, " ".join(ws), g))
    docs = spark.createDataFrame([(i, t, 1.5) for i, t, _ in rows] + [(999, None, 0.0), (None, "", 0.0)], "doc_id long, text string, tails double")
    m = quality.fit(docs, spark.createDataFrame([(i, g) for i, _, g in rows if i % 5], "doc_id long, quality int"))
    assert m["grades"] == [0, 1, 2] and m["thresholds"][0] < m["thresholds"][1]
    out = {x.doc_id: x for x in quality.score(docs, m).collect()}
    assert len(out) == 302
    right = [round(out[i].expected_grade) == g for i, _, g in rows if i % 5 == 0]
    assert sum(right) / len(right) > 0.85
    assert all(x.tails[0] >= x.tails[1] for x in out.values())
    assert quality.select(docs, m, 0.5).columns == docs.columns


def test_quality_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    m = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.select(docs, m).count() == 2


# ---- licenses -------------------------------------------------------------


def brute_base(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = []
    for p, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        q = p.split()
        places += [(i, label) for i in range(len(ws)) if ws[i : i + len(q)] == q]
    return len(ws), sorted(places)


def test_license_base_against_brute_force():
    r = random.Random(2)
    s = licenses.Scanner()
    parts = ["CC", "by", "cc-BY", "all", "rights", "Reserved!", "general", "public", "license", "É", "x1", "--", "cc by cc by", "\n"]
    for t in [None, "", "  ", "CC BY", "all rights\treserved"] + [" ".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(300)]:
        n, places = brute_base(t)
        got = s.scan(t)
        assert (got["n_words"], got["n_base"]) == (n, len(places))
        assert (got["first_word"], got["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert got["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= got["score"] <= 1


def test_license_fuzzy_loses_nothing_to_the_seeds():
    r = random.Random(3)
    s = licenses.Scanner()
    for p, label, k in s.notices:
        for _ in range(20):
            t = list(p)
            for _ in range(r.randint(0, k)):
                i = r.randrange(len(t))
                r.choice([lambda: t.pop(i), lambda: t.insert(i, "q"), lambda: t.__setitem__(i, "z")])()
            text = " ".join(("before words " + "".join(t) + " after words").split())
            if regex.search(f"(?:{regex.escape(p, special_only=True)}){{e<={k}}}", " " + text + " "):
                assert label in s.scan(text)["labels"].split(",")
    got = s.scan("xx released under teh mit license yy")
    assert got["labels"] == "mit" and got["spans"][0]["first_word"] == 1 and 0 < got["score"] < 1


def test_license_spans_against_brute_force():
    """Texts of several notices, edited or not, one after the other: each is reported, at its word, with its edits."""
    r = random.Random(8)
    s = licenses.Scanner()
    for _ in range(200):
        words, want = [], []
        for _ in range(r.randint(1, 6)):
            p, label, k = r.choice(s.notices)
            t = list(p)
            for _ in range(r.randint(0, min(k, 2))):
                t[r.choice([i for i, c in enumerate(t) if c != " "])] = "q"
            want.append((len(words), len(p.split()), label, sum(x != y for x, y in zip(t, p))))
            words += "".join(t).split() + ["zzzzzzzzzz"] * r.randint(0, 3)
        got = [(x["first_word"], x["n_words"], x["label"], x["edits"]) for x in s.scan(" ".join(words))["spans"]]
        assert all(w in got for w in want), (words, want, got)
        for a, n, label, e in got:  # and what is reported is there
            part = " ".join(words[a : a + n])
            assert any(x == label and regex.fullmatch(f"(?:{regex.escape(p, special_only=True)}){{e<={e + 2}}}", part) for p, x, _ in s.notices)
    got = s.scan("released under teh mit license released under the mit license")["spans"]
    assert [(x["first_word"], x["edits"]) for x in got] == [(0, 2), (5, 0)]


def test_license_scan_is_linear():
    s = licenses.Scanner()
    for part in ("cc by ", "released under teh mit license "):
        start = time.perf_counter()
        s.scan(part * 2000)
        once = time.perf_counter() - start
        start = time.perf_counter()
        got = s.scan(part * 16000)
        assert time.perf_counter() - start < 30 * once + 0.5
        assert got["n_words"] == 16000 * len(part.split())


def test_license_table(spark):
    df = spark.createDataFrame([(1, "All Rights Reserved", "a"), (1, "All Rights Reserved", "a"), (None, None, "b")], "doc_id long, text string, labels string")
    assert licenses.scan(df).count() == 3 and licenses.scan(df.limit(0)).count() == 0


# ---- top-k ----------------------------------------------------------------


def brute_topk(rows, k):
    use = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in use if i % 100 == 0}):
        v = min((tuple(v) for i, v in use if i == q))
        s = sorted((-int(np.dot(v, c)), i) for i, c in use if i != q)[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return out


def test_topk_with_ties_nulls_and_large_values(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4) / 2]) for i in range(400)]
    rows += [(500, None), (600, []), (700, [1.0, None, 1.0, 1.0]), (800, [float("nan")] * 4), (900, [float("inf")] * 4), (None, [1.0] * 4), (7, [0.5] * 4), (1000, [1e6] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    for block in (4096, 2):
        got = topk.search(df, F.col("vec_id") % 100 == 0, 10, block=block).collect()
        assert sorted(map(tuple, got)) == sorted(brute_topk(rows, 10))
    for how in ({"block": 2, "group": 50, "tile": 7}, {"block": 3, "tile": 1}):  # several blocks and groups
        assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 100 == 0, 10, **how).collect())) == sorted(brute_topk(rows, 10))
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.search(few, F.col("vec_id") % 100 == 0, 10).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.search(few.limit(0), F.lit(True)).count() == 0


def test_topk_reads_the_table_once_for_all_blocks_and_sends_nothing(spark, tmp_path):
    r = np.random.default_rng(3)
    spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(3000)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/v")
    df = spark.read.parquet(f"{tmp_path}/v")
    out = topk.search(df, F.col("vec_id") % 100 == 0, 10, block=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and "Broadcast" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    one = topk.search(df, F.col("vec_id") % 100 == 0, 10)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, one.collect()))


def test_topk_of_huge_components_and_one_id_on_most_rows(spark):
    rows = [(100, [2.0**40, 1.0]), (200, [-(2.0**60), 0.0]), (1, [2.0**30, 3.0]), (2, [1e300, -1e300]), (3, [0.5, 0.25])] + [(100, [float(k), 1.0]) for k in range(300)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 3).collect()
    by = {(x.query_id, x.rank): (x.vec_id, x.score) for x in got}
    assert by[100, 1][0] in (1, 2, 3, 200) and all(abs(x.score) <= 2**62 for x in got)
    assert by[200, 1][1] == 0 or by[200, 1][1] > -(2**62)
    assert len(got) == 6


# ---- WARC -----------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 400
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"<b>{i}</b>" * (i * 7)) for i in range(40)] + [(90, None, None), (91, "u\r\nX: y", ""), (None, "n", big), (33, "again", big), (92, "e", "x" * 999), (93, "e", "x" * 999)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "page_id long, url string, html string, payload string")
    got = warc.round_trip(df).collect()
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        keeper = largest.get(h or "")
        rev = len(b) >= 1000 and sum((x[2] or "") == (h or "") for x in rows) > 1 and i != keeper
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if rev else "response", keeper if rev else None))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    archive = warc.write_archives(warc.decide(df), b"dictionary " * 50, archive_bytes=4000)
    for n, r in enumerate(archive.collect()):
        (tmp_path / f"{n}.warc.zst").write_bytes(bytes(r.content))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert warc.read_archives(files).count() == len(rows) and files.count() > 1
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_refuses_broken_records():
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False)
    assert warc.parse(good)["payload_bytes"] == 3
    for bad in (good.replace(b"WARC/1.1", b"HTTP/1.1"), good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"WARC-Dat"), good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    frames = warc.dictionary_frame(b"d" * 100) + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"d" * 100)).compress(good)
    assert list(warc.records(frames)) == [good]
    squeezed = zstandard.ZstdCompressor().compress(b"d" * 100)
    frames = struct.pack("<II", warc.MAGIC, len(squeezed)) + squeezed + frames[108:]
    assert list(warc.records(frames)) == [good]
    with pytest.raises((warc.WarcError, zstandard.ZstdError)):
        list(warc.records(frames[:-3]))
    assert base64.b32encode(hashlib.sha1(b"abc").digest()) in good


def test_warc_reads_many_records_in_proportion(spark):
    squeeze = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"d" * 100))
    r = random.Random(5)
    one = lambda n: squeeze.compress(warc.record(n, "u", r.randbytes(400), hashlib.sha1(b"").hexdigest(), None, False))
    frames = [one(n) for n in range(20_000)]
    took = []
    for n in (2500, 20_000):
        data = warc.dictionary_frame(b"d" * 100) + b"".join(frames[:n])
        start = time.perf_counter()
        assert sum(1 for _ in warc.records(data)) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 20 * took[0] + 0.5
    long = squeeze.compress(warc.record(1, "u", r.randbytes(3_000_000), "00" * 20, None, False))
    assert [len(x) > 400 for x in warc.records(warc.dictionary_frame(b"d" * 100) + frames[0] + long + frames[1])] == [True] * 3


# ---- packing --------------------------------------------------------------


def test_packing_cuts_places_and_crcs(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    r = random.Random(5)
    rows = [(i, prose(r, r.choice([0, 1, 3, 20, 150]))) for i in range(60)] + [(70, None), (71, ""), (71, ""), (None, "Hello, WORLD. a,b ß"), (72, "x <|endoftext|> Y<|EndOfText|>, z.")]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    size = 64
    got = packing.pack(df, vocabulary(), size).collect()
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [0]
    want = []
    for i, t in rows:
        x = ids(t)
        want += [(i, k // size, k, len(x[k : k + size]), zlib.crc32(np.array(x[k : k + size], "<u4").tobytes())) for k in range(0, len(x), size)]
    assert Counter(tuple(g)[:5] for g in got) == Counter(want)
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for s in by.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= size
    assert packing.pack(df.limit(0), vocabulary(), size).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_whole_text_with_any_tokenizer(name):
    e = packing.Encoder(vocabulary(name))
    assert e.by_word == name.startswith("word")
    texts = [None, "", *packing.probes(600)[400:], "Hello, World. it's  A test<|endoftext|> \n x" * 50]
    assert e(texts) == e.whole(texts)


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_and_is_near_the_bound(seed):
    r = random.Random(seed)
    hist = Counter(r.choice([r.randint(1, 60), r.randint(30, 100), 100]) for _ in range(2000))
    bins = packing.plan(dict(hist), 100)
    got = Counter()
    for c, m in bins:
        assert m > 0 and sum(l * k for l, k in c.items()) <= 100
        for l, k in c.items():
            got[l] += k * m
    assert got == hist
    plain = sum(m for _, m in packing._best_fit({l: k for l, k in hist.items() if l < 100}, [], 100)) + hist[100]
    assert sum(m for _, m in bins) <= plain


def test_price_against_brute_force():
    r = np.random.default_rng(2)
    w = np.concatenate([[0], r.random(12)])
    best = np.zeros(13)
    for c in range(1, 13):
        best[c] = max([best[c - 1], *(best[c - l] + w[l] for l in range(1, c + 1))])
    c = packing.price(w, 12, np.full(13, 99))
    assert sum(w[l] * k for l, k in c.items()) == pytest.approx(best[12]) and sum(l * k for l, k in c.items()) <= 12


# ---- decontamination ------------------------------------------------------


def edited(r, ws, rate):
    out = []
    for w in ws:
        u = r.random()
        if u < rate / 3:
            continue
        out.append("zzz" if u < 2 * rate / 3 else w)
        if u > 1 - rate / 3:
            out.append("qq")
    return out


def test_decontamination_recall_and_precision(spark):
    r = random.Random(6)
    items = [(i, prose(r, r.choice([1, 3, 8, 15, 40, 70]))) for i in range(60)]
    docs, want = [], {}
    for i, t in items:
        for k, rate in enumerate((0, 0.05, 0.1)):
            ws = edited(r, t.split(), rate) if len(t.split()) > 10 else t.upper().split()
            docs.append((i * 10 + k, prose(r, 30) + " " + ",  ".join(ws) + " " + prose(r, 30), "m"))
            want[i * 10 + k] = i
    for k in range(100):
        docs.append((10000 + k, prose(r, 80), "m"))
    docs += [(20000, None, "m"), (20001, "", "m"), (20001, "", "m"), (None, items[5][1], "m")]
    df = spark.createDataFrame(docs, "doc_id long, text string, matches string")
    bench = spark.createDataFrame([*items, items[7], (99, None), (98, "..")], "item_id long, text string")
    for how in ({}, {"block_chars": 1000}):
        rows = decontaminate.find(df, bench, **how).collect()
        assert sorted(str(x.doc_id) for x in rows) == sorted(str(x[0]) for x in docs)
        got = {x.doc_id: {m.item_id for m in x.matches} for x in rows}
        # an item with a fifth or more of its words edited may be beyond a fifth of its characters
        found = [want[d] in got[d] for d in want if decontaminate.within(plain_text(items[want[d]][1]), plain_text(dict((x[0], x[1]) for x in docs)[d]), int(0.2 * len(plain_text(items[want[d]][1])))) is not None]
        assert len(found) > 150 and sum(found) / len(found) >= 0.97
        assert all(want[d] in got[d] for d in want if d % 10 == 0)
        for d, t, _ in docs:  # each match that is reported is one by brute force
            for i in got[d]:
                p = plain_text(items[i][1])
                assert decontaminate.within(p, plain_text(t), int(0.2 * len(p))) is not None
        assert got[20000] == set() and 5 in got[None]
    assert decontaminate.clean(df, bench).columns == df.columns
    assert decontaminate.clean(df, bench.limit(0)).count() == len(docs)


def plain_text(t):
    return decontaminate.normal(t).decode()


@pytest.mark.parametrize("words", [4, 6, 8, 12, 20, 30, 60])
def test_recall_of_edits_spread_over_characters(words):
    """Nine in ten at every share of edited characters, with the production parameters."""
    r, g = random.Random(words), np.random.default_rng(words)
    items = [(i, prose(r, words)) for i in range(60)]
    index = decontaminate.Index(items, 0.2, 0.98, 12)
    for share in (0.05, 0.1, 0.15, 0.2):
        texts = [plain_text(f"{prose(r, 20)} {decontaminate.edited(g, plain_text(t), int(share * len(plain_text(t))))} {prose(r, 20)}") for _, t in items]
        got = index.search([t.encode() for t in texts])
        assert sum(i in {index.items[x[0]][0] for x in f} for (i, _), f in zip(items, got)) >= 54
        for t, f in zip(texts, got):
            for k, _, edits in f:
                assert decontaminate.within(index.items[k][1], f" {t} ", 99) <= edits <= index.items[k][3]


def test_places_of_matches():
    r = random.Random(4)
    items = [(i, prose(r, n)) for i, n in enumerate((2, 5, 30))]
    index = decontaminate.Index(items, 0.2, 0.98, 12)
    for i, t in items:
        before = prose(r, 9)
        where = len(before.split())
        ws = t.split()
        if len(ws) > 10:
            ws[12] = ws[12][:-1] + "zq"
        text = f"{before}, {' '.join(ws)} -- {' '.join(ws)}"
        got = [(w, e) for k, w, e in index.search([decontaminate.normal(text)])[0] if index.items[k][0] == i]
        assert [w for w, _ in got] == [where, where + len(ws)] and len({e for _, e in got}) == 1
    assert index.search([]) == [] and index.search([b"", b"x"]) == [[], []]
    assert decontaminate.Index([], 0.2, 0.98, 12).search([b"some words"]) == [[]]
    short = decontaminate.Index([(1, "cat"), (2, "a")], 0.2, 0.98, 12)
    assert short.search([b"the cat sat", b"concatenated", b"a"]) == [[(0, 1, 0)], [], [(1, 0, 0)]]


def test_a_very_long_text_is_searched_to_its_end():
    r = random.Random(14)
    item = prose(r, 25)
    text = decontaminate.normal(" ".join(prose(r, 50) for _ in range(3000)) + " " + item)
    index = decontaminate.Index([(1, item)], 0.2, 0.98, 12)
    assert (0, len(text.split()) - 25, 0) in index.search([text])[0]


def test_best_place_against_brute_force():
    r = random.Random(9)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (7, 12))
        edits, start, end = decontaminate.best_place(a, b, 99)
        assert edits == decontaminate.within(a, b, 99)
        assert decontaminate._ends(a, b)[end] == edits
        # the part itself is that far from the pattern, from end to end
        anchor = "#" * (len(a) + len(b))
        assert decontaminate.within(anchor + a + anchor, anchor + b[start:end] + anchor, 99) == edits
    assert decontaminate.best_place("abc", "xyz", 1) is None


def test_within_against_brute_force():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [row[0] + 1]
            for j, e in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != e)))
            row = new
        return min(row)

    r = random.Random(8)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (8, 15))
        assert decontaminate.within(a, b, 99) == plain(a, b)


def test_items_without_their_first_words_in_any_place_of_a_batch(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    items = [(k, [word() for _ in range(30)]) for k in range(30)]
    docs = [(k, " ".join(w[1 + k % 3 :])) for k, w in items] + [(100, " ".join(word() for _ in range(40))), (101, None)]
    out = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"))
    got = {x.doc_id: {m.item_id for m in x.matches} for x in out.collect()}
    assert got == {**{k: {k} for k, _ in items}, 100: set(), 101: set()}
