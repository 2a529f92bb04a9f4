import io
import json
import struct
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.kernels.image import gray
from vellum.model import DOCUMENT
from vellum.operators import tables as TB
from vellum.sources import documents as D
from vellum.sources import docx
from vellum.sources import images as IM

SPANS = '<table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table>'
COSTS = '<table><tr><th rowspan="2">المشروع</th><th colspan="2">Cost</th><th rowspan="2">Total</th></tr><tr><th>a</th><th>b</th></tr><tr><td>x</td><td>1</td><td>2</td><td>3</td></tr></table>'


def block(n, kind, box, text=None, direction="rtl", **more):
    return {"id": f"b{n:03d}", "type": kind, "bbox": dict(zip(("x0", "y0", "x1", "y1"), map(float, box))), "order": n - 1, "text": text, "direction": direction, "confidence": 0.95, **more}


def letter(direction="rtl"):
    return {
        "page": {"width_px": 1697, "height_px": 2400, "width_mm": 210.0, "height_mm": 297.0, "dpi": 205.3, "direction": direction, "rotation_applied": 0, "paper": "A4"},
        "blocks": [
            block(1, "header", (1200, 100, 1600, 160), "وزارة الثقافة"),
            block(2, "header", (100, 100, 500, 160), "Ministry of Culture", "ltr"),
            block(3, "logo", (780, 80, 920, 220), image_path="logo.png"),
            block(4, "doc_number", (1200, 300, 1600, 350), "الرقم: ٤/٣٢٤١"),
            block(5, "paragraph", (150, 500, 1550, 700), "تم إرسال الملف PDF إلى القسم", confidence=0.5, style={"size_pt": 13.0}),
            block(6, "table", (150, 800, 1550, 1100), html=COSTS),
            block(7, "paragraph", (150, 1200, 1550, 1300), "An English paragraph", "ltr", style={"align": "left"}),
            block(8, "stamp", (300, 1500, 600, 1800), image_path="stamp.png"),
            block(9, "footer", (600, 2300, 1100, 2350), "page 1", "ltr"),
        ],
    }


def parts(doc):
    one = IM.png(np.zeros((4, 4, 3), np.uint8))
    z = zipfile.ZipFile(io.BytesIO(docx.build(doc, {"logo.png": one, "stamp.png": one})))
    return {n: z.read(n).decode() for n in z.namelist() if n.endswith((".xml", ".rels"))}, z.namelist()


def test_docx_structure():
    p, names = parts(letter())
    for xml in p.values():
        ET.fromstring(xml)
    d = p["word/document.xml"]
    assert "<w:bidi/></w:sectPr>" in d and '<w:bidi w:val="0"/>' in d and "<w:rtl/>" in d and 'w:szCs w:val="26"' in d
    assert 'w:highlight w:val="yellow"' in d and "bidiVisual" in d and "gridSpan" in d and d.count("vMerge") >= 2
    assert 'behindDoc="1"' in d and "word/comments.xml" in names and p["word/header1.xml"].count("<wp:inline") == 1
    h = p["word/header1.xml"]
    assert h.index("وزارة") < h.index("Ministry") and "word/media/image1.png" in names
    assert "<w:bidi/></w:sectPr>" not in parts(letter("ltr"))[0]["word/document.xml"]
    assert docx.build(letter()) == docx.build(letter())


def test_docx_sink(spark, tmp_path):
    spark.dataSource.register(docx.DocxSource)
    df = spark.createDataFrame([("one", json.dumps(letter())), ("two", json.dumps(letter("ltr")))], "name string, doc string")
    df.select("name", docx.docx_column(F.col("doc")).alias("content")).write.format("docx").mode("append").save(str(tmp_path))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["one.docx", "two.docx"]


def test_tables():
    cells, n, m = TB.grid(SPANS)
    assert (n, m) == (2, 3) and [(c.row, c.col, c.text) for c in cells] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c"), (1, 2, "d")]
    assert TB.grid(COSTS)[1:] == (3, 4) and TB.to_html(cells) == SPANS and TB.grid("none") == ([], 0, 0)
    assert TB.grid('<table><tr><td rowspan="x">a</td></tr></table>')[0][0].rowspan == 1
    assert TB.sanitized('<table class="q"><tbody><tr><td style="x" colspan="1">a &lt; <b>b</b></td></tr></table> tail') == "<table><tr><td>a &lt; b</td></tr></table>"
    assert TB.plain(COSTS).startswith("المشروع Cost Total") and TB.plain("plain") == ""
    assert TB.teds(COSTS, COSTS) == 1.0 and TB.teds(COSTS, None) == 0.0
    other = COSTS.replace("<td>3</td>", "<td>4</td>")
    assert TB.teds(COSTS, other, True) == 1.0 and 0.8 < TB.teds(COSTS, other) < 1.0
    assert TB.tree_distance(SPANS, SPANS.replace("<td>d</td>", "")) == 1.0


def test_documents_round_trip(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({**letter(), "schema_version": "1.0.0", "review": {"page_score": 0.9, "needs_review": False, "reasons": []}, "timings_s": {"total": 2.0}}), encoding="utf-8")
    docs = D.documents(spark, str(tmp_path))
    r = docs.first()
    assert r.stem == "p1" and len(r.blocks) == 9 and r.blocks[5].html == COSTS and r.timings_s == {"total": 2.0}
    back = D.nested(D.blocks_of(docs)).first()
    assert [b.id for b in back.blocks] == [f"b{n:03d}" for n in range(1, 10)]
    D.write(docs, str(tmp_path / "out"))
    assert spark.read.schema("stem string," + DOCUMENT).json(str(tmp_path / "out")).first().blocks == r.blocks
    assert json.loads(docs.select(D.as_json(docs).alias("j")).first().j)["schema_version"] == "1.0.0"


def jpeg_head(orientation):
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 1) + struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0) + b"\0\0\0\0"
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def test_images(spark, tmp_path):
    x = np.arange(200 * 100 * 3, dtype=np.uint32).reshape(100, 200, 3).astype(np.uint8)
    assert (IM.from_png(IM.png(x)) == x).all()
    assert IM.exif_orientation(jpeg_head(6)) == 6 and IM.exif_orientation(b"\x89PNG") == 1
    assert IM.upright(x, 6).shape == (200, 100, 3) and (IM.upright(x, 3) == x[::-1, ::-1]).all() and (IM.upright(x, 2) == x[:, ::-1]).all()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.PNG").write_bytes(IM.png(x))
    (tmp_path / "bad.jpg").write_bytes(b"not an image")
    (tmp_path / "note.txt").write_text("x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in IM.load(spark, str(tmp_path), max_side=100).collect()}
    assert set(rows) == {"one.PNG", "bad.jpg"} and rows["bad.jpg"].error and rows["one.PNG"].error is None
    r = rows["one.PNG"]
    assert (r.width_px, r.height_px, r.scale) == (200, 100, 0.5) and IM.from_png(bytes(r.data)).shape == (50, 100, 3) and r.warnings
    assert gray(x).shape == (100, 200)


@pytest.mark.parametrize("kind", ["td", "th"])
def test_html_of_cells_in_the_jvm(spark, kind):
    cells = [(0, 0, 2, 1, "a<b", kind == "th"), (0, 1, 1, 1, "c & d", False), (1, 1, 1, 1, None, False)]
    df = spark.createDataFrame([(cells,)], "cells array<struct<row:int,col:int,rowspan:int,colspan:int,text:string,header:boolean>>")
    got = df.select(TB.html_of(F.col("cells")).alias("h")).first().h
    assert got == TB.to_html([TB.Cell(r, c, a, b, t or "", h) for r, c, a, b, t, h in cells])
