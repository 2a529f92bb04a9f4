import json
import random
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum import config, engines, pipeline, service
from vellum.functions import geometry as G
from vellum.model import DOCUMENT, TRUTH
from vellum.operators import evaluate as E
from vellum.operators import layout as L
from vellum.operators import order as O
from vellum.operators import post as P
from vellum.sources import images as IM
from vellum.streaming import ingest


@pytest.mark.parametrize(
    "boxes,types,direction,order",
    [
        ([(100, 300, 900, 360), (100, 100, 900, 160), (100, 200, 900, 260)], ["paragraph"] * 3, "rtl", [1, 2, 0]),
        ([(100, 100, 300, 150), (650, 100, 900, 200), (100, 300, 900, 400)], ["handwritten_note", "doc_number", "paragraph"], "rtl", [1, 0, 2]),
        ([(100, 100, 300, 150), (650, 100, 900, 200), (100, 300, 900, 400)], ["handwritten_note", "doc_number", "paragraph"], "ltr", [0, 1, 2]),
        ([(100, 50, 900, 100), (100, 150, 480, 400), (100, 420, 480, 700), (520, 150, 900, 300), (520, 330, 900, 700)], ["title"] + ["paragraph"] * 4, "rtl", [0, 3, 4, 1, 2]),
        ([(100, 50, 900, 100), (100, 150, 480, 400), (100, 420, 480, 700), (520, 150, 900, 300), (520, 330, 900, 700)], ["title"] + ["paragraph"] * 4, "ltr", [0, 1, 2, 3, 4]),
    ],
)
def test_reading_order(spark, boxes, types, direction, order):
    assert O.reading_order(boxes, types, direction) == order
    df = spark.createDataFrame([("p", f"{i}", b, t, direction) for i, (b, t) in enumerate(zip([tuple(map(float, b)) for b in boxes], types))], f"doc_id string, id string, bbox struct<x0:double,y0:double,x1:double,y1:double>, type string, page_direction string")
    got = {int(r.id): r.order for r in O.ordered(df).collect()}
    assert sorted(got, key=got.get) == order


def test_letterhead_footer_and_stamp():
    boxes = [(100, 900, 900, 950), (100, 200, 900, 300), (600, 20, 900, 80), (100, 20, 400, 80), (300, 250, 600, 500), (100, 400, 400, 450)]
    got = O.reading_order(boxes, ["footer", "paragraph", "header", "header", "stamp", "signature"], "rtl")
    assert got[:2] == [2, 3] and got[-1] == 0 and got.index(4) > got.index(1)


def test_direction_hint(spark):
    rows = []
    for i in range(10):
        y = 100.0 + 50 * i
        rows += [("r", (100.0 + (37 * i) % 200, y, 900.0, y + 30)), ("l", (100.0, y, 900.0 - (37 * i) % 200, y + 30))]
    df = spark.createDataFrame(rows, "doc_id string, bbox struct<x0:double,y0:double,x1:double,y1:double>").withColumn("page_w", F.lit(1000.0))
    assert {r.doc_id: r.hint for r in O.direction_hint(df).collect()} == {"r": "rtl", "l": "ltr"}


def test_overlaps():
    assert L.surviving([(0, 0, 100, 100), (10, 10, 50, 30)], ["table", "paragraph"], [0.9, 0.9]) == [0]
    assert L.surviving([(0, 0, 100, 100), (10, 10, 50, 30)], ["paragraph", "stamp"], [0.9, 0.9]) == [1, 0]
    assert L.surviving([(0, 0, 100, 100), (0, 0, 100, 40), (0, 50, 100, 95)], ["paragraph"] * 3, [0.9, 0.8, 0.7]) == [1, 2]
    assert L.grouped_lines([(0, 0, 100, 20), (0, 25, 100, 45), (0, 200, 100, 220)]) == [[0, 1], [2]]


def test_points_and_paper(spark):
    df = spark.createDataFrame([([[10.0, 100.0], [100.0, 100.0], [100.0, 0.0], [0.0, 0.0]],)], "p array<array<double>>")
    assert df.select(G.order_points(F.col("p")).alias("o")).first().o == [[0, 0], [100, 0], [100, 100], [10, 100]]
    sizes = spark.createDataFrame([(210.0, 297.0), (215.9, 279.4), (297.0, 210.0), (100.0, 300.0)], "w double, h double")
    assert [r.s.paper for r in sizes.select(G.snap_paper(F.col("w"), F.col("h")).alias("s")).collect()] == ["A4", "Letter", "A4", None]


def test_partial_ratio_and_duplicates(spark):
    assert P.partial_ratio("abcd", "xxabcdxx") == 100.0 and P.partial_ratio("abcd", "zzzz") == 0.0
    assert P.best_part("abcd", "xxabXdxx")[0] == 75.0
    rows = [("p", "a", (0.0, 0.0, 100.0, 100.0), "paragraph", "hello world and more text"), ("p", "b", (0.0, 0.0, 100.0, 50.0), "paragraph", "hello world"), ("p", "c", (500.0, 500.0, 600.0, 600.0), "paragraph", "hello world")]
    df = spark.createDataFrame(rows, "doc_id string, id string, bbox struct<x0:double,y0:double,x1:double,y1:double>, type string, text string")
    assert {r.id for r in P.without_duplicates(df).collect()} == {"a", "c"}


def arb(spark, **k):
    base = {"type": "paragraph", "p_name": "tesseract", "p_engine": "P", "p_text": "abc", "p_conf": 0.9, "s_name": "paddle", "s_engine": "S", "s_text": "abc", "s_conf": 0.8}
    row = {**base, **k}
    df = spark.createDataFrame([tuple(row.values())], "type string, p_name string, p_engine string, p_text string, p_conf double, s_name string, s_engine string, s_text string, s_conf double").withColumn("flags", F.array().cast("array<string>"))
    return P.arbitrated(df).first()


def test_arbitration(spark):
    r = arb(spark)
    assert (r.text, r.source_engine, r.agree) == ("abc", "P", 1.0)
    r = arb(spark, p_text=" ")
    assert (r.text, r.source_engine, r.agree, round(r.engine_conf, 3)) == ("abc", "S", None, 0.68) and "no text" in r.flags[0]
    r = arb(spark, p_name="vlm", s_name="tesseract", p_text="no 123", s_text="no 132")
    assert r.source_engine == "S" and r.engine_conf == 0.8
    r = arb(spark, p_name="vlm", s_name="tesseract", p_text="بِسْمِ", s_text="بسم")
    assert r.source_engine == "P" and round(r.engine_conf, 4) == 0.765 and "tashkeel" in r.flags[0]
    assert arb(spark, type="table").agree is None and arb(spark, s_name="tesseract").agree is None


def test_review_of_an_empty_page(spark):
    df = spark.createDataFrame([("p", "b1", 0, "logo", None, None, False)], "doc_id string, id string, `order` int, type string, text string, confidence double, needs_review boolean")
    r = P.page_review(df).first()
    assert r.page_score == 0.0 and r.needs_review and "no text recognized" in r.reasons


def docs(spark):
    text = lambda n, t, s, **k: {"id": f"b{n}", "type": t, "order": n, "text": s, "bbox": {"x0": 0.0, "y0": n * 10.0, "x1": 50.0, "y1": n * 10.0 + 9}, **k}
    table = "<table><tr><td>a</td><td>b</td></tr></table>"
    pred = {"page": {"width_px": 200, "height_px": 200}, "blocks": [text(0, "title", "The tittle"), text(1, "paragraph", "first words here and more words"), text(2, "table", None, html=table), {**text(3, "logo", None), "bbox": {"x0": 100.0, "y0": 100.0, "x1": 150.0, "y1": 150.0}}], "metadata": {"dates": [{"normalized": "2024-05-01"}], "doc_numbers": [{"value_latin": "1/2", "role": "self"}]}, "review": {"page_score": 0.9, "needs_review": True}, "timings_s": {"total": 2.0}}
    g = lambda t, s, box=(0, 0, 10, 10), **k: {"id": t, "type": t, "lang": "en", "bbox": list(map(float, box)), "text": s, **k}
    truth = {"id": "p", "lang": "en", "width_px": 100, "height_px": 100, "augment": {"level": "mild"}, "blocks": [g("title", "The title"), g("paragraph", "first words here"), g("paragraph", "quite 12345 6789 other"), g("table", None, html=table), g("logo", None, (50, 50, 75, 75)), g("date", "Date: 1/5/2024"), g("doc_number", "No. 1/2")]}
    load = lambda d, schema: spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(d)])).withColumn("stem", F.lit("p"))
    return load(truth, TRUTH), load(pred, DOCUMENT)


def test_evaluation(spark):
    truth, pred = docs(spark)
    got = E.evaluate(truth, pred)
    b = {r.pos: r for r in got["blocks"].collect()}
    assert round(b[0].cer, 4) == round(1 / 9, 4) and b[0].pred_type == "title" and b[1].cer == 0.0 and b[1].hyp == "first words here" and b[1].pred_order == 1
    assert got["tables"].first().teds == 1.0 and got["images"].first().recall == 1.0
    p = got["pages"].first()
    assert (p.dates_found, p.dates_total, p.docno_found, p.docno_total) == (1, 1, 1, 1) and p.needs_review
    r = {(x.grouping, x.key): x for x in got["rates"].collect()}
    assert r["by_type", "title"].type_acc == 1.0 and r["overall", "all"].n == len(b) and ("by_level_lang", "mild/en") in r
    text = E.markdown(got, "Test")
    assert "by type" in text and "worst blocks" in text
    assert E.checked(truth, pred.limit(0)).count() == 1


def test_image_facts_of_pages_whose_blocks_change_places(spark):
    """A page gathered from many files has its blocks in another order whenever it is computed anew."""
    kinds = ("stamp", "logo", "paragraph")
    box = lambda k: [100.0 * k, 0.0, 100.0 * k + 50, 50.0]
    found = lambda page, k: (page + k // 3) % 4 == 0
    block = "array<struct<type:string,bbox:array<double>>>"
    anew = F.udf(lambda blocks: random.SystemRandom().sample(blocks, len(blocks)), block).asNondeterministic()
    truth = spark.createDataFrame([(f"p{n}", 1000, 1000, [(kinds[k % 3], box(k)) for k in range(12)]) for n in range(40)], f"stem string, width_px int, height_px int, blocks {block}")
    pred = spark.createDataFrame([(f"p{n}", (2000, 2000), [(kinds[k % 3], tuple(2 * x for x in box(k))) for k in range(12) if found(n, k)]) for n in range(40)], "stem string, page struct<width_px:int,height_px:int>, blocks array<struct<type:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>")
    got = {(r.stem, r.type): (r.hit, r.n) for r in E.image_facts(truth.withColumn("blocks", anew("blocks")), pred).collect()}
    assert got == {(f"p{n}", kinds[i]): (sum(found(n, k) for k in range(i, 12, 3)), 4) for n in range(40) for i in (0, 1)}


def test_engines(spark, tmp_path):
    with pytest.raises(ValueError):
        engines.make("nope")
    assert engines.make("none") is None
    rows = [{"block": 1, "par": 1, "line": n, "left": 12, "top": 30 * n, "width": 20, "height": 10, "conf": c, "text": t} for n, c, t in ((2, 90.0, "two"), (1, 80.0, "one"), (1, 5.0, "bad"))]
    r = engines.words_to_lines(rows)
    assert r.text == "one [؟]\ntwo" and 0 < r.confidence < 1
    assert engines.cut_line(np.zeros((10, 300), np.uint8), 10) == [(0, 120), (120, 240), (240, 300)]
    crop = IM.png(np.full((20, 60, 3), 255, np.uint8))
    df = spark.createDataFrame([("p", "r0", "paragraph", crop, "rtl", None, 100)], "doc_id string, block_id string, type string, image binary, direction string, line_height_px double, page_w int")
    r = engines.recognized(df, "stub").first()
    assert r.text == "paragraph 60x20" and r.engine == "stub"
    r = engines.recognized(df, "tesseract").first()
    assert r.engine == "none" and "unavailable" in r.flags[0]
    assert engines.cleaned("نص " + "مكرر جدا " * 10, "text")[1] == ["repetition_truncated"]


def page_image():
    p = np.full((800, 566, 3), 245, np.uint8)
    for y in range(80, 700, 60):
        for x in range(60, 480, 26):
            p[y : y + 12, x : x + 20] = 40
    return p


def test_conversion_batch_and_service(spark, tmp_path):
    (tmp_path / "one.png").write_bytes(IM.png(page_image()))
    (tmp_path / "bad.png").write_bytes(b"x")
    cfg = config.load(overrides={"recognition": {"primary": "stub", "secondary": "none"}, "geometry": {"target_long_side_px": 800, "detect_boundary": False}})
    found = pipeline.convert(spark, str(tmp_path), cfg)
    d, pages = found.documents.cache(), found.pages
    r = d.first()
    assert r.stem == "one" and r.blocks and [b.id for b in r.blocks] == [f"b{n:03d}" for n in range(1, len(r.blocks) + 1)] and r.config_digest == cfg.digest()
    assert pipeline.report(d, pages).first().asDict() == {"pages": 2, "ok": 1, "failed": 1, "needs_review": 1}
    assert pipeline.as_docx(d, found.regions).first().content[:2] == b"PK"
    s = service.server(spark, "127.0.0.1", 0, cfg)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}"
    assert json.load(urllib.request.urlopen(at + "/health")) == {"status": "ok"}
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(urllib.request.Request(at + "/convert", b"", method="POST"))
    assert e.value.code == 400
    got = urllib.request.urlopen(urllib.request.Request(at + "/convert?format=json&name=a.png", IM.png(page_image()), method="POST"))
    assert json.load(got)["schema_version"] == "1.0.0" and got.headers["X-Needs-Review"] == "true"
    s.shutdown()


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in ("a.png", "b.png"):
        (src / n).write_bytes(IM.png(page_image()))
    (src / "c.txt").write_text("x")
    seen = []
    q = ingest.each_batch(ingest.image_stream(spark, str(src)), lambda df, n: seen.extend(r.path for r in df.select("path").collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert len(seen) == 1  # equal contents are one page
