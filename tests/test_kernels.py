import numpy as np
import pytest

from vellum import config
from vellum.kernels import geometry as G
from vellum.kernels import image as I


def sheet(h=1400, w=990, step=45):
    p = np.full((h, w, 3), 245, np.uint8)
    for y in range(60, h - 60, step):
        p[y : y + 14, 80 : w - 80] = 40
    return p


@pytest.mark.parametrize("seed", range(5))
def test_page_outline(seed):
    r = np.random.default_rng(seed)
    H, W = 900, 700
    q = np.array([[100, 100], [W - 100, 100], [W - 100, H - 100], [100, H - 100]], float) + r.uniform(-0.05, 0.05, (4, 2)) * [W, H]
    m = G.perspective(q, np.array([[0, 0], [989, 0], [989, 1399], [0, 1399]], float))
    y, x = np.mgrid[0:H, 0:W]
    z = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    u, v = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / z, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / z
    photo = np.full((H, W, 3), 70, np.uint8)
    inside = (u >= 0) & (v >= 0) & (u <= 989) & (v <= 1399)
    photo[inside] = G.sample(sheet(), u, v)[inside]
    got, cover = G.find_page(photo)
    assert got is not None and 0.3 < cover < 0.8
    assert np.hypot(*(got - q).T).max() < 0.015 * np.hypot(H, W)
    flat = G.warp(photo, got, 1200)
    assert max(flat["page"].shape[:2]) == 1200
    frontal = G.warp(photo, np.array([[100, 100], [520, 100], [520, 694], [100, 694]], float), 1200)
    assert frontal["paper"] == "A4" and abs(frontal["page"].shape[1] / 1200 - 210 / 297) < 0.01


def test_no_outline():
    q, cover = G.find_page(np.full((700, 500, 3), 245, np.uint8))
    assert q is None and cover == 1.0


def test_skew_and_orientation():
    g = I.gray(sheet(700, 500, 30))
    assert abs(G.skew(I.gray(G.rotate(sheet(700, 500, 30), 3))) + 3) <= 0.4
    assert G.orientation(g) == 0 and G.orientation(G.rotate90(g, 90)) == 90
    assert (G.rotate90(g, 90) == np.rot90(g, -1)).all()


def test_points():
    assert G.order_points([[10, 100], [100, 100], [100, 0], [0, 0]]).tolist() == [[0, 0], [100, 0], [100, 100], [10, 100]]


def test_quality():
    r = np.random.default_rng(0)
    p = sheet(800, 600)
    p[(r.random((800, 600)) < 0.05)] = 0
    soft = np.stack([I.box_mean(I.box_mean(p[..., c], 7), 7) for c in range(3)], -1).astype(np.uint8)
    assert I.blur_variance(p) > 5 * I.blur_variance(soft)
    page = np.full((800, 600, 3), 200, np.uint8)
    y, x = np.mgrid[0:800, 0:600]
    page[(x - 300) ** 2 + (y - 400) ** 2 < 120**2] = 255
    assert I.glare_ratio(page) > 0.05 and I.glare_ratio(np.full((80, 60, 3), 250, np.uint8)) == 0.0
    notes = I.assess(np.full((400, 300, 3), 200, np.uint8), config.Qa())["warnings"]
    assert any("blurry" in n for n in notes) and any("low resolution" in n for n in notes)


def test_flattening_and_lines():
    p = sheet(600, 500, 60)
    shade = (p * np.linspace(0.5, 1, 500)[None, :, None]).astype(np.uint8)
    flat = I.flatten(shade)
    assert abs(float(flat[30, 20, 0]) - float(flat[30, 480, 0])) < 20
    lines = I.text_lines(I.ink_mask(I.gray(p)), 500)
    assert len(lines) == len(range(60, 540, 60)) and I.line_height(I.ink_mask(I.gray(p)), 500)[0] == pytest.approx(14, abs=3)


def test_components_against_flood():
    r = np.random.default_rng(1)
    m = r.random((30, 40)) < 0.35
    label, stats = I.components(m)
    seen = np.zeros_like(m)
    n = 0
    for y, x in zip(*np.nonzero(m)):
        if seen[y, x]:
            continue
        n += 1
        stack, own = [(y, x)], set()
        while stack:
            a, b = stack.pop()
            if 0 <= a < 30 and 0 <= b < 40 and m[a, b] and not seen[a, b]:
                seen[a, b] = True
                own.add(label[a, b])
                stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert len(own) == 1
    assert n == len(stats) and stats[:, 4].sum() == m.sum()


@pytest.mark.parametrize("rtl", [True, False])
def test_ruled_grid(rtl):
    p = np.full((300, 400, 3), 250, np.uint8)
    for y in (20, 80, 140, 200, 260):
        p[y : y + 3, 20:383] = 0
    for x in (20, 140, 260, 380):
        p[20:263, x : x + 3] = 0
    p[23:80, 140:143] = 250  # the first two columns are one cell in the first row
    cells = G.ruled_grid(p, rtl)
    assert len(cells) == 11
    wide = [c for c in cells if c.colspan == 2]
    assert len(wide) == 1 and wide[0].row == 0 and wide[0].col == (1 if rtl else 0)
    assert G.ruled_grid(np.full((100, 100, 3), 250, np.uint8), rtl) is None


def test_stamps_and_masks():
    p = np.full((600, 600, 3), 250, np.uint8)
    y, x = np.mgrid[0:600, 0:600]
    d = np.hypot(x - 300, y - 250)
    p[(d < 50) & (d > 44)] = (200, 60, 60)
    c = I.coloured_mask(p)
    found = I.circles(c, 600)
    assert found and np.hypot(found[0][0] - 300, found[0][1] - 250) < 8 and abs(found[0][2] - 47) < 8
    assert len(I.coloured_blobs(c)) == 1 and I.ink_on_transparent(p).shape[2] == 4
    assert G.vote({"model": (90, 0.9), "osd": (90, 2.0)}, None, 0)[0] == 90 and G.vote({}, {0: 0.1, 180: 0.8}, 0) == (180, "ocr") and G.vote({}, None, 90) == (90, "heuristic")
