"""From drawn letters to regions: what is on the page is found, and pictures are told from text."""

import json
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum import config, engines, pipeline
from vellum.kernels import geometry as KG
from vellum.kernels import image as I
from vellum.kernels import regions as R
from vellum.operators import layout as L
from vellum.operators import tables as TB
from vellum.sources import drawing as D
from vellum.sources import synthetic as S


def covered(box, found, kinds=None):
    """The share of a box that regions cover, at most."""
    mask = np.zeros((int(box[3] - box[1]), int(box[2] - box[0])), bool)
    for r in found:
        if kinds is None or r.type in kinds:
            a, b, c, d = (int(v) for v in (r.box[0] - box[0], r.box[1] - box[1], r.box[2] - box[0], r.box[3] - box[1]))
            mask[max(0, b) : max(0, d), max(0, a) : max(0, c)] = True
    return mask.mean()


@pytest.mark.parametrize("lang", ["en", "ar"])
def test_everything_on_a_drawn_letter_is_found(lang):
    spec = S.page(3, lang, "clean")
    picture = D.letter(spec)
    found, ink = R.analysed(picture, []), picture[..., 0] < 128
    by = {b["type"]: b["bbox"] for b in spec["blocks"]}
    assert covered(by["stamp"], found, ("stamp",)) > 0.7 and covered(by["signature"], found, ("signature", "handwritten_note")) > 0.5
    note = next(b for b in spec["blocks"] if b["type"] == "handwritten_note")
    assert covered(note["bbox"], found, ("handwritten_note", "signature")) > 0.05
    for b in spec["blocks"]:
        if b["type"] == "paragraph":
            x0, y0, x1, y1 = (int(v) for v in b["bbox"])  # lines are shorter than the box, so what counts is their ink
            held = np.zeros(ink.shape, bool)
            for r in found:
                if r.type == "paragraph":
                    held[int(r.box[1]) : int(r.box[3]), int(r.box[0]) : int(r.box[2])] = True
            assert ink[y0:y1, x0:x1].sum() > 1000 and held[y0:y1, x0:x1][ink[y0:y1, x0:x1]].mean() > 0.9
    empty = D.blank(700, 500)
    assert R.analysed(empty, []) == []


def test_a_model_s_boxes_are_kept_and_filled_up():
    spec = S.page(5, "en", "clean")
    page = D.letter(spec)
    first = next(b for b in spec["blocks"] if b["type"] == "paragraph")
    given = [R.Found("paragraph", tuple(first["bbox"]), 0.9, "m:text")]
    found = R.analysed(page, given)
    assert any(r.source == "m:text" and r.box == tuple(first["bbox"]) for r in found)
    assert any(r.type == "stamp" for r in found) and len(found) > 4
    assert [r.source for r in R.analysed(page, given, fill=False)] == ["m:text"]
    plain = R.analysed(page, given, colours=False)
    assert not any(r.type in ("signature", "handwritten_note") and r.source != "m:text" for r in plain)


def test_pictures_and_text_that_a_model_took_for_each_other():
    page = D.blank(1400, 1000)
    end = D.paragraph(page, "lines of black text " * 24, (100, 300, 900, 600), 24)
    D.logo(page, (420, 60, 580, 220))
    D.stamp(page, (100, 900, 320, 1120))
    D.signature(page, (500, 950, 900, 1080))
    sheet = R.Sheet(page)
    kind = lambda t, *box: R.refined(R.Found(t, tuple(map(float, box))), sheet).type
    assert kind("figure", 95, 298, 905, end - 12) == "paragraph"
    assert kind("figure", 410, 50, 590, 230) == "logo" and kind("header", 410, 50, 590, 230) == "logo"
    assert kind("figure", 90, 890, 330, 1130) == "stamp" and kind("figure", 490, 940, 910, 1090) in ("signature", "handwritten_note")
    assert kind("table", 95, 298, 905, end) == "table" and kind("figure", 990, 1390, 990, 1390) == "figure"
    both = R.split(R.Found("figure", (80.0, 880.0, 920.0, 1140.0), 0.8), sheet)
    assert {"stamp", "signature"} <= {r.type for r in both} | ({"signature"} if any(r.type == "handwritten_note" for r in both) else set()) and len(both) == 2


def test_coloured_ink_is_carved_out_of_text():
    page = D.blank(1400, 1000)
    D.paragraph(page, "a name in print and what stands below it in ink", (100, 300, 900, 380), 24)
    D.signature(page, (200, 480, 700, 600))
    sheet = R.Sheet(page)
    parts = R.carved(R.Found("paragraph", (90.0, 290.0, 910.0, 620.0), 0.9, "m"), sheet)
    assert len(parts) == 2 and parts[0].type in ("signature", "handwritten_note") and parts[0].box[1] > 450
    assert parts[1].type == "paragraph" and parts[1].box[3] < 470
    assert R.carved(R.Found("paragraph", (190.0, 470.0, 710.0, 610.0)), sheet)[0].type != "paragraph"
    assert R.carved(R.Found("table", (90.0, 290.0, 910.0, 620.0)), sheet)[0].type == "table"


def test_stamps_are_taken_off_the_text_below():
    page = D.blank(600, 600)
    D.paragraph(page, "black words " * 12, (60, 200, 560, 400), 24)
    before = I.coloured_mask(page).sum()
    D.stamp(page, (150, 150, 400, 400))
    crop = page[150:450, 50:580]
    out = R.without_stamps(crop, 50, 150, [(150, 150, 400, 400)])
    assert before == 0 and I.coloured_mask(crop).sum() > 500 and I.coloured_mask(out).sum() < 0.05 * I.coloured_mask(crop).sum()
    assert I.ink_mask(I.gray(out)).sum() > 1000


def test_drawn_tables_have_their_grid_and_headers():
    for rtl in (False, True):
        markup = S.cost_table(__import__("random").Random(1), rtl)
        page = D.blank(400, 1300)
        D.table(page, markup, (10, 10, 1290, 390), rtl)
        cells = KG.with_header_rows(page, KG.ruled_grid(page, rtl))
        want, n, m = TB.grid(markup)
        assert {(c.row, c.col, c.rowspan, c.colspan) for c in cells} == {(c.row, c.col, c.rowspan, c.colspan) for c in want}
        assert {c.row for c in cells if c.header} == {0, 1}


def test_turning_votes(monkeypatch):
    page = D.letter(S.page(2, "en", "clean"))
    assert KG.turned(page, "none") == (0, "none") and KG.turned(page, "heuristic")[1] == "heuristic"
    monkeypatch.setattr(KG, "TURNERS", {"model": lambda p: (180, 0.9), "osd": lambda p: (180, 3.0)})
    assert KG.turned(page, "paddle") == (180, "model+osd")
    monkeypatch.setattr(KG, "TURNERS", {"model": lambda p: (180, 0.9), "osd": lambda p: 1 / 0})
    monkeypatch.setattr(KG, "READERS", {"ocr": lambda p: float(p[: len(p) // 2].mean() < p[len(p) // 2 :].mean())})
    assert KG.turned(page, "paddle")[1] in ("ocr", "model")
    said = types.SimpleNamespace(returncode=0, stdout=b"Page number: 0\nRotate: 270\nOrientation confidence: 4.5\n")
    assert KG.osd("x", lambda *a, **k: said)(page) == (270, 4.5)
    assert KG.osd("x", lambda *a, **k: types.SimpleNamespace(returncode=1, stdout=b""))(page) is None


def test_profiles_and_device():
    cfg = config.load(profile="dev-vlm")
    assert cfg.recognition.primary_by_type == {"table": "tesseract"} and cfg.recognition.vlm.model.startswith("qwen3")
    assert config.load(profile="gpu-server").runtime.device == "cuda" and config.load(profile="gpu-server").recognition.vlm.max_image_side == 1600
    assert config.resolve_device("auto", lambda _: None) == "cpu" and config.resolve_device("auto", lambda _: "/x") == "cuda" and config.resolve_device("cpu") == "cpu"


def test_local_model_answers_like_the_service():
    class Ids(list):
        shape = (1, 2)

    class Model:
        device = "cpu"

        def generate(self, **how):
            assert how["max_new_tokens"] >= 32
            return types.SimpleNamespace(sequences=[[1, 2, 3, 4]], scores=[0])

        def compute_transition_scores(self, *a, **k):
            return np.array([[-0.1, -0.2]])

        def set_adapter(self, name):
            self.adapter = name

    class Processor:
        def apply_chat_template(self, chat, **k):
            assert chat[0]["content"][0]["type"] == "image"
            return type("Inputs", (dict,), {"to": lambda self, d: self})(input_ids=Ids())

        def decode(self, ids, **k):
            return "read " + json.dumps(ids)

    e = engines.LocalVlm(config.Recognition(), lambda cfg: (Model(), Processor()))
    r = e.recognize(D.blank(60, 200), "paragraph", engines.Hints("ltr", 20.0, None, 1000))
    assert r.text == "read [3, 4]" and abs(r.confidence - np.exp(-0.15)) < 1e-9 and e.engine_id().startswith("local:")
    assert isinstance(engines.build_vlm(config.Recognition()), engines.ChatVlm)


def test_pictures_to_documents(spark, tmp_path):
    """Drawn letters through pages, regions, a stub engine, and a second reading of tables, to documents."""
    t = S.truths(spark, 1, ("clean",))
    for r in D.drawn(t).collect():
        (tmp_path / f"{r.stem}.png").write_bytes(bytes(r.content))
    cfg = config.load(overrides={"recognition": {"primary": "stub", "secondary": "none"}, "geometry": {"detect_boundary": False, "orientation": "none", "target_long_side_px": 1600}})
    found = pipeline.convert(spark, str(tmp_path), cfg)
    regions = found.regions.select("doc_id", "type", "bbox", "page_w").collect()
    assert {r.doc_id for r in regions} == {r.stem for r in t.select("stem").collect()}
    assert all(any(x.type == "stamp" for x in regions if x.doc_id == d) for d in {r.doc_id for r in regions})
    docs = found.documents.select("stem", F.size("blocks").alias("n"), "page.direction").collect()
    assert len(docs) == 3 and all(d.n > 3 for d in docs)
    again = pipeline.read_tables_again(
        spark.createDataFrame([("d", "b1", "table", L.M.TEXT_TYPES[0].encode(), "rtl", 10.0, 100), ("e", "b2", "table", b"", "rtl", 10.0, 100)], "doc_id string, block_id string, type string, image binary, direction string, line_height_px double, page_w int"),
        spark.createDataFrame([("d", "rtl"), ("e", "ltr")], "doc_id string, page_direction string"), "rtl", cfg,
    )
    assert [r.doc_id for r in again.collect()] == ["e"]
