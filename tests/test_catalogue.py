"""Every query of the catalogue runs, and equals its SQL, over small tables made here."""

import datetime as dt
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum import model as M
from vellum.functions import scoring as S
from vellum.kernels.edits import distance
from vellum.plans import catalogue as C


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    r = random.Random(1)
    word = lambda: r.choice("the of inea thble onou été año Ein. que, x1 and".split())
    text = lambda n: " ".join(word() for _ in range(n)) + r.choice([".", "!\nnext line", ""])
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(days=r.randint(0, 1500))
    rows = {
        "region": ([(i, f"R{i} & <co>") for i in range(3)], "r_regionkey int, r_name string"),
        "nation": ([(i, f"N A{i}", i % 3) for i in range(9)], "n_nationkey int, n_name string, n_regionkey int"),
        "part": ([(i, f"p{i}", "b", r.choice(["seal big", "table x", "Doc_title y", "zzz"]), r.randint(1, 50), 1.0) for i in range(40)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(i, i % 20, "O", r.randint(100, 90000) + 0.25, day(), "1") for i in range(120)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (list({(k[0], k[2], k[3], k[1]): (*k, float(r.randint(1, 50)), 10.0, r.randint(0, 10) / 100, r.randint(0, 8) / 100, r.choice("ANR"), r.choice("OF"), day()) for k in ((r.randint(0, 60), r.randint(1, 900), r.randint(0, 150), r.randint(1, 7)) for _ in range(600))}.values()), "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "events": ([(i, day(), i % 7, r.choice(["view", "error", "click"]), r.random() * 100, "{}") for i in range(80)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        "documents": ([(i, text(r.randint(0, 60)), "en", f"s{i % 4}", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long"),
        "embeddings": ([(i, [r.uniform(-1, 1) for _ in range(8)], 0) for i in range(50)], "vec_id long, embedding array<float>, label int"),
        "pages": ([(i, f"http://h/{i}.{r.choice(['PNG', 'html', 'jpg'])}", f"<b>{i}</b>") for i in range(30)], "page_id long, url string, html string"),
        "benchmark": ([(i, text(20)) for i in range(5)], "item_id long, text string"),
        "conversations": ([(i // 3, i % 3, ["system", "user", "assistant"][i % 3], text(r.randint(0, 20))) for i in range(45)], "conv_id long, turn long, role string, text string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in rows:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return str(d), con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return [plain(x) for x in v] if hasattr(v, "__iter__") and not isinstance(v, (str, dict)) else v


@pytest.mark.parametrize("name", sorted(C.QUERIES))
def test_query(spark, tables, name):
    path, con = tables
    got = C.QUERIES[name](spark, path)
    columns = sorted(got.columns)
    rows = [[plain(r[c]) for c in columns] for r in got.collect()]
    if name in C.ORACLE:
        ref = con.execute(C.ORACLE[name])
        names = [x[0] for x in ref.description]
        want = [[plain(r[names.index(c)]) for c in columns] for r in ref.fetchall()]
        assert sorted(names) == columns
        key = lambda r: str(r)
        assert sorted(rows, key=key) == sorted(want, key=key)
    else:
        assert rows


def test_overlap_joins_keep_their_page_key(spark, tables):
    for name in ("q13_containment", "q14_iou_matched", "q15_tiled"):
        plan = C.QUERIES[name](spark, tables[0])._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and F is not None


def test_scans_read_only_what_is_used(spark, tables):
    plan = C.QUERIES["q24_body_size"](spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" in plan and "l_extendedprice" not in plan and plan.count("Exchange hashpartitioning") == 1


def pages_of(spark, path):
    """The boxes of every page as plain rows, in the order of their ids."""
    rows = C.boxes(spark.read.parquet(f"{path}/lineitem.parquet")).withColumn("id", C.block_key()).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.id):
        out.setdefault(r.doc_id, []).append((r.id, r.type, (r.bbox.x0, r.bbox.y0, r.bbox.x1, r.bbox.y1), 1 - r.l_discount))
    return out


def test_line_groups_against_a_plain_version(spark, tables):
    want = {}
    for page, rows in pages_of(spark, tables[0]).items():
        groups = []
        for name, _, b, _ in sorted(rows, key=lambda r: r[2][1]):
            for n, g in enumerate(groups):
                last = g[-1]
                gap, tall = b[1] - last[3], max(b[3] - b[1], last[3] - last[1])
                x0, x1 = min(x[0] for x in g), max(x[2] for x in g)
                if -(b[3] - b[1]) / 2 < gap < 0.9 * tall and min(x1, b[2]) - max(x0, b[0]) > 0.3 * min(x1 - x0, b[2] - b[0]):
                    g.append(b)
                    want[page, name] = n
                    break
            else:
                want[page, name] = len(groups)
                groups.append([b])
    assert {(r.doc_id, r.id): r.line_group for r in C.QUERIES["q21c_line_groups"](spark, tables[0]).collect()} == want


def test_reading_order_against_a_plain_version(spark, tables):
    def runs(rows, lo, hi):
        """Rows apart along one axis, each box taken in by a little on both sides."""
        inset = lambda b: (b[lo] + (b[hi] - b[lo]) * 0.08, b[hi] - (b[hi] - b[lo]) * 0.08)
        out, end = [], None
        for r in sorted(rows, key=lambda r: (*inset(r[2]), rows.index(r))):
            a, b = inset(r[2])
            if end is None or a > end:
                out.append([r])
                end = b
            else:
                out[-1].append(r)
                end = max(end, b)
        return out

    def order(rows, rtl):
        if len(rows) < 2:
            return rows
        tall = lambda rs: max(r[2][3] for r in rs) - min(r[2][1] for r in rs)
        columns, bands = runs(rows, 0, 2), runs(rows, 1, 3)
        if len(columns) >= 2 and (len(bands) < 2 or min(map(tall, columns)) > tall(rows) / 2):
            columns.sort(key=(lambda c: (-max(r[2][2] for r in c), -min(r[2][0] for r in c))) if rtl else (lambda c: min(r[2][0] for r in c)))
            return sum((order(c, rtl) for c in columns), [])
        if len(bands) >= 2:
            return sum((order(b, rtl) for b in sorted(bands, key=lambda b: min(r[2][1] for r in b))), [])
        return sorted(rows, key=lambda r: (round(r[2][1] / 20), -r[2][2] if rtl else r[2][0]))

    want = {}
    for page, rows in pages_of(spark, tables[0]).items():
        rtl, mid = page % 2 == 0, lambda r: (r[2][1] + r[2][3]) / 2
        top, foot, free = ([r for r in rows if r[1] in kinds] for kinds in (("header", "logo"), ("footer",), ("stamp", "signature", "figure")))
        body = [r for r in rows if r not in top and r not in foot and r not in free]
        line = order(top, rtl) + order(body, rtl)
        n = len(line)
        line += order(foot, rtl)
        for r in sorted(free, key=mid):
            stop = next((k for k, x in enumerate(line) if x in foot), len(line)) if n < len(line) else len(line)
            at = max((k + 1 for k in range(stop) if line[k][2][1] <= mid(r)), default=0)
            line.insert(at, r)
        want.update({(page, r[0]): k for k, r in enumerate(line)})
    got = {(r.doc_id, r.id): r.order for r in C.QUERIES["q21_reading_order"](spark, tables[0]).collect()}
    assert got == want


def test_dedupe_against_a_plain_version(spark, tables):
    text = {"paragraph", "title", "header", "footer", "list", "doc_number", "date", "handwritten_note"}
    area = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    both = lambda a, b: area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))) if max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3]) else 0.0
    inside = lambda a, b: both(a, b) / max(area(a), 1e-6)
    want = set()
    for page, rows in pages_of(spark, tables[0]).items():
        rank = sorted(rows, key=lambda r: (M.PRIORITY.get(r[1], 0), r[3], area(r[2])), reverse=True)
        alive = {r[0]: True for r in rank}
        for r in rank:
            for k in rank:
                if not alive[r[0]]:
                    break
                if k is r or not alive[k[0]]:
                    continue
                c = inside(r[2], k[2])
                if c < 0.5:
                    continue
                if r[1] in text and k[1] == "table":
                    alive[r[0]] = c <= 0.6
                elif (r[1] in text) != (k[1] in text):
                    pass
                elif r[1] not in text:
                    if c > 0.75:
                        alive[r[0] if M.PRIORITY.get(r[1], 0) <= M.PRIORITY.get(k[1], 0) else k[0]] = False
                else:
                    parts = [x for x in rank if x is not k and x[1] in text and inside(x[2], k[2]) > 0.5]
                    if len(parts) >= 2 and sum(both(x[2], k[2]) for x in parts) > 0.6 * max(area(k[2]), 1):
                        alive[k[0]] = False
                    elif c > 0.75 or area(r[2]) < area(k[2]):
                        alive[r[0]] = False
        want |= {(page, n) for n, a in alive.items() if a}
    assert {(r.doc_id, r.id) for r in C.QUERIES["q21b_deduped_regions"](spark, tables[0]).collect()} == want


def test_finished_documents_hold_every_find(spark, tables):
    """Blocks, dates and numbers of every page, counted from the rows themselves."""
    got = {r.stem: r for r in C.QUERIES["q44_finished_documents"](spark, tables[0]).collect()}
    blocks = C.scored_blocks(lambda t: spark.read.parquet(f"{tables[0]}/{t}.parquet")).collect()
    pages = {}
    for b in blocks:
        pages.setdefault(b.doc_id, []).append(b)
    assert set(got) == set(pages)
    for stem, rows in pages.items():
        lines = sum(len(b.text.split("\n")) if b.type in ("paragraph", "header", "title") else 1 for b in rows)
        # texts that an overlapping block holds too go; no other block does
        assert len(rows) - 1 <= got[stem].n_blocks <= lines or got[stem].n_blocks <= lines
        finds = lambda key: sum(key in b.text for b in rows if b.type not in ("stamp",))
        assert got[stem].n_dates <= finds("Date:") and got[stem].n_numbers <= finds("Ref.")
        if got[stem].n_blocks == lines:
            assert got[stem].n_dates == finds("Date:") and got[stem].n_numbers == finds("Ref.")


def test_edit_distance_against_a_plain_version(spark):
    def rows(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    r = random.Random(5)
    text = lambda n: "".join(r.choice("abéاب ") for _ in range(r.randint(0, n)))
    pairs = [(text(12), text(12)) for _ in range(300)] + [(text(200), text(200)) for _ in range(10)] + [("", ""), ("a", ""), ("", "a"), ("same", "same")]
    assert all(distance(a, b) == rows(a, b) for a, b in pairs)
    assert all(distance(a.split(), b.split()) == rows(a.split(), b.split()) for a, b in pairs)
    df = spark.createDataFrame([*pairs, (None, "a")], "a string, b string")
    got = df.select("a", "b", S.edits(F.col("a"), F.col("b")).alias("e"), S.wer(F.col("a"), F.col("b")).alias("w")).collect()
    assert all(x.e == (None if x.a is None else distance(x.a, x.b)) for x in got)
    assert all(x.w == rows(x.a.split(), x.b.split()) / len(x.a.split()) for x in got if x.a and x.a.split())
    long = " ".join(text(8) for _ in range(20_000))
    start = time.perf_counter()
    assert distance(long, long.replace("é", "")) == long.count("é")
    assert time.perf_counter() - start < 20
