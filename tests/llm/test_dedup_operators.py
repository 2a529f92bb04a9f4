import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import linededup, simhash
from vellum.llm.components import components

SPACE = " \t\n\x0b\x0c\r"


def brute_lines(rows, chars, docs):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(SPACE))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(low(x)) >= chars and i is not None:
                holders[low(x)].add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(low(x)) >= chars and len(holders[low(x)]) >= docs and max(holders[low(x)]) != i)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_against_brute_force(spark, seed):
    r = random.Random(seed)
    pool = ["Éx line number one", "line number two!", "short", "", " \t padded LINE here\r", "padded line here", "Padded Line here", "unicode ééééé ß lines", "x" * 9, "y" * 10]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 8)))) for i in range(r.choice([1, 60]))]
    rows += [(100, None), (101, ""), (101, pool[0]), (101, pool[0]), (None, pool[0] + "\n" + pool[1]), (102, "\n".join(pool * 30)), (-5, pool[1])]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, keeper string").repartition(3)
    key = lambda x: tuple(str(v) for v in x)
    for batches, fanout in ((4, 2), (1, 2), (7, 3)):
        got = linededup.dedup(df, 10, 3, batches, fanout)
        assert got.columns == ["doc_id", "keeper", "text", "n_lines", "n_dropped"]
        assert sorted(((g.doc_id, g.n_lines, g.n_dropped, g.text) for g in got.collect()), key=key) == sorted(brute_lines(rows, 10, 3), key=key)
    assert linededup.dedup(df.limit(0)).count() == 0


def test_line_dedup_of_texts_of_many_lines(spark):
    """Texts of 20,000 lines that share half of them; the time grows with the lines."""
    took = []
    for n in (5000, 20_000):
        rows = [(d, "\n".join(f"a line of its own, number {i} of document {d}" if i % 2 else f"a line that all of the documents share, number {i}" for i in range(n))) for d in range(6)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        start = time.perf_counter()
        got = {x.doc_id: (x.n_lines, x.n_dropped, x.text) for x in linededup.dedup(df, 20, 5).collect()}
        took.append(time.perf_counter() - start)
        assert got[5] == (n, 0, rows[5][1])
        assert all(got[d] == (n, n // 2, "\n".join(rows[d][1].split("\n")[1::2])) for d in range(5))
    assert took[1] < 8 * took[0] + 5


def test_runs_do_not_outlive_a_failure(spark, monkeypatch):
    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(linededup, "repeated", lambda keys, runs, *_: (runs.add(keys.select("h1", "h2", "doc_id").distinct()), fail())[1])
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(RuntimeError):
        linededup.dedup(spark.createDataFrame([(1, "a line that is long enough to count here")], "doc_id long, text string"), 10)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_runs_are_compacted(spark):
    runs = linededup.Runs(spark, fanout=2, buckets=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, k, 100 - b) for k in range(b, b + 4)], "h1 long, h2 long, doc_id long"))
    assert sum(len(x) for x in runs.levels.values()) < 5
    got = {x.h1: (x.docs, x.keeper) for x in runs.merged().collect()}
    for k in range(8):
        own = [100 - b for b in range(5) if b <= k < b + 4]
        assert got[k] == (len(own), max(own))
    runs.drop()


def test_components_against_brute_force(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(-1, 2000), (5, 5)] + [(5000, 5001 + k) for k in range(50)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: find(x) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows, n, radius):
    fp = [int(simhash.majority(simhash.shingle_hashes(t, n))[0]) for _, t in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return [(i, f"{fp[k]:016x}", min(least[find(k)], default=None)) for k, (i, _) in enumerate(rows)]


def test_fingerprint_against_plain_bits():
    import xxhash

    r = random.Random(1)
    for n in (0, 1, 2, 3, 7, 400):
        t = " ".join(r.choice("ABcdé") for _ in range(n))
        ws = t.encode().lower().split()
        s = [b" ".join(ws[i : i + 3]) for i in range(max(1, n - 2))] if n else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert int(simhash.majority(simhash.shingle_hashes(t, 3))[0]) == want


def near(r, words, edits):
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice("abcdefgh") * 3
    return " ".join(w)


def test_links_against_brute_force(spark):
    r = random.Random(2)
    base = [[r.choice("klmnop") + str(r.randint(0, 500)) for _ in range(120)] for _ in range(15)]
    rows = [(i, near(r, base[i % 15], r.choice([0, 1, 2, 3, 6]))) for i in range(150)]
    rows += [(200, None), (201, ""), (199, " \n"), (202, "one two"), (203, "ONE two"), (203, "one two"), (None, rows[0][1]), (None, "quite alone here"), (204, " ".join(base[0] * 40))]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, f0 string").repartition(3)
    key = lambda x: tuple(str(v) for v in x)
    want = sorted(brute_links(rows, 3, 3), key=key)
    assert len({w[2] for w in want}) < 140
    for tile in (4096, 5):
        assert sorted(map(tuple, simhash.links(df, 3, 3, tile).collect()), key=key) == want
    assert simhash.links(df.limit(0)).count() == 0


def test_grid_loses_no_link(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = []
    for x in base:
        fps.append(int(x))
        for d in range(1, 6):
            y = int(x)
            for b in r.permutation(64)[:d]:
                y ^= 1 << int(b)
            fps.append(y)
    fps = list(dict.fromkeys(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.edges_in_cells(simhash.grid_cells(spark.createDataFrame([(f,) for f in signed], "f0 long")), 3).collect()
    got = {frozenset(e) for e in map(tuple, edges)}
    want = {frozenset((signed[a], signed[b])) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3}
    assert got <= want
    par = {s: s for s in signed}

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    other = dict(par)
    for p, es in ((par, got), (other, want)):
        for e in es:
            x, y = (find(p, v) for v in e)
            p[max(x, y)] = min(x, y)
    assert all(find(par, s) == find(other, s) for s in signed)


def test_near_copies_recall_and_clean_texts(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, group = [], {}
    for g in range(40):
        w = [word() for _ in range(300)]
        for k in range(3):
            v = list(w)
            for _ in range(0 if k == 0 else r.randint(1, 5)):
                v[r.randrange(300)] = word()
            rows.append((g * 10 + k, " ".join(v)))
            group[g * 10 + k] = g
    rows += [(1000 + k, " ".join(word() for _ in range(200))) for k in range(100)] + [(5000, ""), (5001, None), (None, "a b c")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int").repartition(4)
    sh = {i: {tuple(x) for x in zip(*((t or "").split()[k:] for k in range(5)))} for i, t in rows}
    got = {x.doc_id: x.component_id for x in simhash.near_copies(df).collect()}
    linked = [(a, b) for a in group for b in group if a < b and group[a] == group[b] and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= 0.8]
    hit = sum(got[a] == got[b] for a, b in linked)
    assert hit / len(linked) >= 0.95
    assert all(got[i] == i for i in range(1000, 1100)) and got[5001] == 5000
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = Counter(x.doc_id for x in kept.collect())
    assert ids[None] == 1 and all(ids[i] == 1 for i in range(1000, 1100)) and ids[5001] == 0
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_near_copies_equal_exact_similarity(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(60):  # far below and just at the similarity, so that a sketch cannot tell
        w = [word() for _ in range(300)]
        for k, edits in enumerate((0, r.randint(3, 16), r.randint(3, 16))):
            v = list(w)
            for _ in range(edits):
                v[r.randrange(300)] = word()
            rows.append((g * 10 + k, " ".join(v)))
    rows += [(900, None), (901, ""), (902, "x y"), (903, "x y"), (None, rows[0][1])]
    sh = [frozenset(zip(*((t or "").split()[k:] for k in range(5)))) or frozenset((t or "").split()) for _, t in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sh[a] == sh[b] or len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b]):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    want = {i: min(j for k, (j, _) in enumerate(rows) if find(k) == find(n) and j is not None) for n, (i, _) in enumerate(rows) if i is not None}
    assert 20 < sum(want[i] != i for i in want) < 110
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), recall=0.9999).collect()}
    assert {i: c for i, c in got.items() if i is not None} == want
    groups = spark.createDataFrame([(0, n, t) for n, (_, t) in enumerate(rows[:180])], "root long, id long, text string")
    edges = {tuple(e) for tile in (512, 7) for e in simhash.similar_edges(groups, 5, 0.8, tile).collect()}
    assert all(len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b]) for a, b in edges)
    assert {(find(a)) for a, b in edges} == {find(n) for n in range(180) if sum(find(m) == find(n) for m in range(180)) > 1}


def test_large_cells_are_cut_by_a_second_grid_without_losing_links(spark):
    r = np.random.default_rng(7)
    fps = {0}
    while len(fps) < 400:  # few segments differ, so that all are in the same cells
        fps.add(sum(1 << int(b) for b in r.choice(64, r.integers(1, 5), replace=False)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "f0 long")
    want = {frozenset((a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    for tile in (4096, 20):
        got = {frozenset(tuple(e)) for e in simhash.grid_edges(df, 3, tile).collect()}
        assert got <= want and joined(signed, got) == joined(signed, want)
    assert simhash.finer_cells(simhash.grid_cells(df), 3).groupBy("key").count().agg(F.max("count")).first()[0] < 200


def joined(nodes, edges):
    par = {n: n for n in nodes}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for e in edges:
        x, y = (find(v) for v in e)
        par[max(x, y)] = min(x, y)
    return [find(n) for n in nodes]


def test_what_goes_is_similar_to_one_that_stays(spark):
    """Chains, stars and large groups, in one task and in rounds; nothing that stays is similar to another that stays."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, n = [], 0
    for g in range(4):
        w = [word() for _ in range(200)]
        for k in range(60):  # each a few words on from the one before, or from the first
            if g % 2:
                w = list(w)
            v = w if g % 2 else list(w)
            for _ in range(3):
                v[r.randrange(200)] = word()
            rows.append((g % 3, n, n + 5, " ".join(v)))
            n += 1
    df = spark.createDataFrame(rows, "root long, id long, least long, text string")
    sh = {i: frozenset(zip(*(t.split()[k:] for k in range(5)))) for _, i, _, t in rows}
    root = {i: g for g, i, _, _ in rows}
    near = lambda a, b: len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])
    for tile in (512, 25, 4):
        gone = {x.id for x in simhash.gone_of(df, 5, 0.8, tile).collect()}
        kept = set(sh) - gone
        assert 20 < len(gone) < n - 4
        assert all(any(near(i, j) and root[i] == root[j] for j in kept) for i in gone)
        assert not any(near(i, j) for i in kept for j in kept if i < j and root[i] == root[j])


def test_pipeline_stages_keep_columns_and_clean_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(20)
    docs, labels = [], []
    for i in range(120):
        t = text(60)
        bad = i % 4 == 0
        docs.append((i, " ".join(w.upper() + "!!" for w in t.split()) if bad else t))
        labels.append((i, int(not bad), 0))
    line = "this line stands in very many documents of the corpus"
    docs[1] = (1, docs[1][1] + "\n" + item)
    docs += [(200 + k, text(50) + "\n" + line) for k in range(6)] + [(300, docs[2][1]), (301, None)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "pack" or now.columns == columns
        seen[name] = now
    ids = lambda n: {x.doc_id for x in seen[n].select("doc_id").collect()}
    assert ids("quality") >= {i for i in range(120) if i % 4} and not ids("quality") & {i for i in range(120) if i % 4 == 0}
    lines = {x.doc_id: x for x in seen["line_dedup"].collect()}
    assert [line in lines[200 + k].text for k in range(6)] == [False] * 5 + [True] and all(x.n_chars == len(x.text) for x in lines.values())
    assert ids("near_dedup") == ids("line_dedup") - {300}
    assert ids("decontaminate") == ids("near_dedup") - {1}
    assert ids("pack") == ids("decontaminate")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["pack"].count()
    assert hashlib.sha256(b"").hexdigest() and F.lit(1) is not None
