"""Page geometry in NumPy: the page's outline, perspective, paper, skew, orientation, ruled grids."""

from __future__ import annotations

import math
import shutil
import subprocess

import numpy as np

from vellum.kernels import image as I
from vellum.model import PAPER_MM
from vellum.operators.tables import Cell


def order_points(pts: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    p = np.asarray(pts, float)
    s, d = p.sum(1), p[:, 1] - p[:, 0]
    return p[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]


def _hull(pts: np.ndarray) -> np.ndarray:
    pts = np.unique(pts, axis=0)
    if len(pts) < 3:
        return pts

    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def quad_of(mask: np.ndarray) -> np.ndarray | None:
    """Four corners of a part: the hull with its shortest-cornered points dropped one at a time, else the extremes along the diagonals."""
    ys, xs = np.nonzero(mask)
    if len(ys) < 4:
        return None
    first = np.flatnonzero(np.r_[True, ys[1:] != ys[:-1]])
    last = np.r_[first[1:] - 1, len(ys) - 1]
    hull = _hull(np.concatenate([np.stack([xs[first], ys[first]], 1), np.stack([xs[last], ys[last]], 1)]).astype(float))
    if len(hull) < 4:
        return None
    whole = hull
    while len(hull) > 4:  # the corner whose triangle is smallest says least about the shape
        a, b = np.roll(hull, 1, 0) - hull, np.roll(hull, -1, 0) - hull
        hull = np.delete(hull, np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).argmin(), 0)
    return order_points(hull if _area(hull) > 0.9 * _area(whole) else whole)


def _otsu(x: np.ndarray) -> float:
    n = np.bincount(x.ravel(), minlength=256).astype(float)
    w, m = n.cumsum(), (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        v = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return float(np.nanargmax(np.where(np.isfinite(v), v, -1)))


def find_page(bgr: np.ndarray, least: float = 0.2) -> tuple[np.ndarray | None, float]:
    """Corners of the sheet in a photo and its share of the photo; (None, 1.0) where there is no outline."""
    small, k = I.fitted(bgr, 900)
    s, v = I.hsv(small)
    lum = (v.astype(int) - s.astype(int)).clip(0, 255).astype(np.uint8)
    edges = np.hypot(*np.gradient(I.box_mean(I.gray(small), 5)))
    masks = [lum > _otsu(lum), ~I.closed((edges > max(8.0, np.percentile(edges, 97))).astype(np.uint8), 9, 9).astype(bool)]
    h, w = lum.shape
    best, score = None, 0.0
    for m in masks:
        label, stats = I.components(I.closed(m.astype(np.uint8), 7, 7))
        for i in np.argsort(-stats[:, 4])[:3]:
            q = quad_of(label == i + 1)
            if q is None:
                continue
            ratio = _area(q) / (h * w)
            if not least <= ratio <= 0.985:
                continue
            fill = stats[i, 4] / max(1.0, _area(q))
            edge = ((q[:, 0] < 3) | (q[:, 0] > w - 4) | (q[:, 1] < 3) | (q[:, 1] > h - 4)).sum() >= 3
            value = ratio * min(fill, 1 / max(fill, 1e-9)) * (0.5 if edge else 1.0)
            if value > score:
                best, score = q, value
    return (None, 1.0) if best is None else (best / k, float(_area(best) / (h * w)))


def rectangle_ratio(quad: np.ndarray, w: int, h: int) -> float | None:
    """Width over height of the rectangle seen in perspective (whiteboard method); None where the view is nearly parallel."""
    c = np.array([w / 2, h / 2])
    tl, tr, br, bl = (np.append(p - c, 1.0) for p in np.asarray(quad, float))
    k2 = np.dot(np.cross(tl, br), bl) / (np.dot(np.cross(tr, br), bl) or 1e-12)
    k3 = np.dot(np.cross(tl, br), tr) / (np.dot(np.cross(bl, br), tr) or 1e-12)
    n2, n3 = k2 * tr - tl, k3 * bl - tl
    if abs(n2[2]) < 1e-4 or abs(n3[2]) < 1e-4:
        return None
    f2 = -(n2[0] * n3[0] + n2[1] * n3[1]) / (n2[2] * n3[2])
    if not math.isfinite(f2) or f2 <= 0:
        return None
    a, b = ((n[0] ** 2 + n[1] ** 2) / f2 + n[2] ** 2 for n in (n2, n3))
    r = math.sqrt(a / b) if b > 0 else float("nan")
    return r if math.isfinite(r) and r > 0 else None


def snap_paper(w: float, h: float) -> tuple[str | None, float, float]:
    long, short = max(w, h), max(1e-9, min(w, h))
    ratio, tall = long / short, h >= w
    a, b = PAPER_MM["Letter"]
    if abs(ratio / (b / a) - 1) < 0.015:
        return ("Letter", a, b) if tall else ("Letter", b, a)
    if 1.25 <= ratio <= 1.5:
        return ("A4", 210.0, 297.0) if tall else ("A4", 297.0, 210.0)
    mm = 210.0 if tall else 297.0
    return None, mm, mm * h / w


def perspective(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1).reshape(3, 3)


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear, borders repeated."""
    h, w = img.shape[:2]
    x, y = x.clip(0, w - 1), y.clip(0, h - 1)
    i, j = x.astype(int), y.astype(int)
    a, b = x - i, y - j
    if img.ndim == 3:
        a, b = a[..., None], b[..., None]
    i1, j1 = np.minimum(i + 1, w - 1), np.minimum(j + 1, h - 1)
    im = img.astype(np.float64)
    return np.rint((im[j, i] * (1 - a) + im[j, i1] * a) * (1 - b) + (im[j1, i] * (1 - a) + im[j1, i1] * a) * b).astype(np.uint8)


def warp(bgr: np.ndarray, quad: np.ndarray, long_side: int) -> dict:
    """The sheet, flat, with the longer side given; paper, its size in mm and the photo's resolution on it."""
    q = order_points(quad)
    d = lambda a, b: float(np.hypot(*(q[a] - q[b])))
    w, h = (d(0, 1) + d(3, 2)) / 2, (d(0, 3) + d(1, 2)) / 2
    seen = w / max(h, 1e-9)
    true = rectangle_ratio(q, bgr.shape[1], bgr.shape[0])
    ratio = seen if true is None or not 0.6 < true / seen < 1.7 else (true + seen) / 2 if abs(true / seen - 1) > 0.15 else true
    paper, wmm, hmm = snap_paper(ratio, 1.0)
    if paper:
        ratio = wmm / hmm
    W, H = (round(long_side * ratio), long_side) if ratio <= 1 else (long_side, round(long_side / ratio))
    m = perspective(np.array([[0, 0], [W - 1, 0], [W - 1, H - 1], [0, H - 1]], float), q)
    v, u = np.mgrid[0:H, 0:W]
    z = m[2, 0] * u + m[2, 1] * v + m[2, 2]
    page = sample(bgr, (m[0, 0] * u + m[0, 1] * v + m[0, 2]) / z, (m[1, 0] * u + m[1, 1] * v + m[1, 2]) / z)
    return {"page": page, "paper": paper, "width_mm": wmm, "height_mm": hmm, "dpi": max(w / wmm, h / hmm) * 25.4}


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise about the middle, same size, borders repeated."""
    h, w = img.shape[:2]
    t = math.radians(degrees)
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
    return sample(img, math.cos(t) * dx - math.sin(t) * dy + (w - 1) / 2, math.sin(t) * dx + math.cos(t) * dy + (h - 1) / 2)


def rotate90(img: np.ndarray, clockwise: int) -> np.ndarray:
    return np.ascontiguousarray(np.rot90(img, -(clockwise // 90) % 4))


def skew(g: np.ndarray, most: float = 8.0) -> float:
    """Degrees to turn counter-clockwise so that rows of ink are level: the turn with the most uneven row sums, coarse, then fine."""
    small, _ = I.fitted(g, 1000)
    ys, xs = np.nonzero(I.ink_mask(small, 31, 15))
    if not len(ys):
        return 0.0
    h, w = small.shape
    dx, dy = xs - w / 2, ys - h / 2

    def uneven(a: float) -> float:
        t = math.radians(a)
        row = np.rint(dy * math.cos(t) - dx * math.sin(t) + h / 2).astype(int)
        return float(np.bincount(row.clip(0, h - 1), minlength=h).var())

    best = max(np.arange(-most, most + 0.01, 0.5), key=uneven)
    return float(round(max(np.arange(best - 0.5, best + 0.51, 0.1), key=uneven), 4))


def orientation(g: np.ndarray) -> int:
    """0, or 90 where columns of ink vary more than rows do."""
    ink = I.ink_mask(I.fitted(g, 1000)[0], 31, 15)
    return 90 if ink.mean(0).var() > 1.6 * ink.mean(1).var() else 0


def vote(votes: dict[str, tuple[int, float] | None], by_ocr: dict[int, float] | None, guess: int) -> tuple[int, str]:
    """Two sure detectors that agree decide; else the rotation that reads best; else the surest vote; else the guess from ink."""
    floor = {"model": 0.6, "osd": 1.5}
    sure = {k: v for k, v in votes.items() if v is not None and v[1] >= floor.get(k, 0)}
    if len(sure) > 1 and len({v[0] for v in sure.values()}) == 1:
        return next(iter(sure.values()))[0], "+".join(sorted(sure))
    if by_ocr and max(by_ocr.values()) > 0:
        return max(by_ocr, key=lambda k: by_ocr[k]), "ocr"
    if sure:
        k = max(sure, key=lambda k: sure[k][1] / max(floor.get(k, 1), 1e-9))
        return sure[k][0], k
    return guess, "heuristic"


#: Models that flatten curled sheets, by the name in the settings; each maps a page to a page.
DEWARPERS: dict = {}


#: Detectors of how a page is turned, by name ("model", "osd"); each maps a page to (rotation, confidence), or None where it cannot tell.
#: READERS["ocr"] maps a page to how well it reads.
TURNERS: dict = {}
READERS: dict = {}


def turned(page: np.ndarray, how: str) -> tuple[int, str]:
    """Rotation of a page and who decided it: registered detectors and readings vote, unless `how` leaves it to the ink."""
    guess = orientation(I.gray(page))
    if how in ("heuristic", "none"):
        return (guess if how == "heuristic" else 0), how
    votes = {}
    for name, detector in TURNERS.items():
        try:
            votes[name] = detector(page)
        except Exception:  # noqa: BLE001  a detector that fails has no vote
            votes[name] = None
    sure = {v[0] for v in votes.values() if v is not None}
    read = READERS.get("ocr") if len(votes) < 2 or len(sure) > 1 else None
    by_ocr = {k: read(rotate90(page, k) if k else page) for k in sorted({0, 180, guess, *sure})} if read else None
    return vote(votes, by_ocr, guess)


def osd(cmd: str, run=subprocess.run):
    """The classic engine's own detector of orientation, by its command."""

    def detector(page: np.ndarray):
        from vellum.sources.images import png

        got = run([cmd, "stdin", "stdout", "--psm", "0"], input=png(I.fitted(page, 1600)[0].astype(np.uint8)), capture_output=True, timeout=60)
        fields = dict(x.split(":", 1) for x in got.stdout.decode().splitlines() if ":" in x)
        return (int(fields["Rotate"]) % 360, float(fields["Orientation confidence"])) if got.returncode == 0 and "Rotate" in fields else None

    return detector


if shutil.which("tesseract"):
    TURNERS["osd"] = osd(shutil.which("tesseract"))


def correct(bgr: np.ndarray, cfg, turn: int | None = None) -> dict:
    """Outline, perspective, dewarping where a model is registered, orientation and skew in one pass."""
    quad, cover = find_page(bgr, cfg.min_doc_area_ratio) if cfg.detect_boundary else (None, 1.0)
    if quad is not None:
        out = warp(bgr, quad, cfg.target_long_side_px)
    else:
        h, w = bgr.shape[:2]
        k = cfg.target_long_side_px / max(h, w)
        paper, wmm, hmm = snap_paper(w, h)
        out = {"page": I.resize(bgr, max(1, round(h * k)), max(1, round(w * k))), "paper": paper, "width_mm": wmm, "height_mm": hmm, "dpi": w / wmm * 25.4}
    if cfg.dewarp in DEWARPERS:
        h, w = out["page"].shape[:2]
        out["page"] = I.resize(DEWARPERS[cfg.dewarp](out["page"]), h, w)
    by = "given"
    if turn is None:
        turn, by = turned(out["page"], cfg.orientation)
    if turn:
        out["page"] = rotate90(out["page"], turn)
        if turn % 180:
            out["width_mm"], out["height_mm"] = out["height_mm"], out["width_mm"]
    angle = skew(I.gray(out["page"]), cfg.max_deskew_deg) if cfg.deskew else 0.0
    if abs(angle) >= 0.15:
        out["page"] = rotate(out["page"], angle)
    return {**out, "quad": None if quad is None else quad.ravel().tolist(), "coverage": cover, "found": quad is not None, "rotation": turn, "rotation_by": by, "skew": angle}


# ---- ruled tables ----


def _cluster(values: np.ndarray, tolerance: float) -> list[float]:
    if not len(values):
        return []
    v = np.sort(values)
    return [float(part.mean()) for part in np.split(v, np.flatnonzero(np.diff(v) > tolerance) + 1)]


def ruled_grid(bgr: np.ndarray, rtl: bool) -> list[Cell] | None:
    """Cells between ruling lines, joined where a line between them is missing; None below two by two. Column 0 is first in reading order."""
    ink = I.ink_mask(I.gray(bgr), 31, 12)
    h, w = ink.shape
    across, down = I.opened(ink, 1, max(15, w // 15)), I.opened(ink, max(12, h // 15), 1)
    _, sa = I.components(I.dilate(across, 3, 3))
    _, sd = I.components(I.dilate(down, 3, 3))
    ys = _cluster((sa[:, 1] + sa[:, 3]) / 2, max(6, h / 60))
    xs = _cluster((sd[:, 0] + sd[:, 2]) / 2, max(6, w / 80))
    if len(ys) < 3 or len(xs) < 3:
        return None
    n, m = len(ys) - 1, len(xs) - 1
    wall_a, wall_d = I.dilate(across, 7, 1), I.dilate(down, 1, 7)
    on = lambda wall, a, b, c, d: wall[int(a) : int(b) + 1, int(c) : int(d) + 1]
    parent = {(r, c): (r, c) for r in range(n) for c in range(m)}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    def join(a, b):
        parent[max(find(a), find(b))] = min(find(a), find(b))

    for r in range(n):
        for c in range(m):
            if c + 1 < m and on(wall_d, ys[r] + 4, ys[r + 1] - 4, xs[c + 1] - 3, xs[c + 1] + 3).any(axis=1).mean() < 0.5:
                join((r, c), (r, c + 1))
            if r + 1 < n and on(wall_a, ys[r + 1] - 3, ys[r + 1] + 3, xs[c] + 4, xs[c + 1] - 4).any(axis=0).mean() < 0.5:
                join((r, c), (r + 1, c))
    parts: dict = {}
    for k in parent:
        parts.setdefault(find(k), []).append(k)
    out = []
    for ks in parts.values():
        r0, c0 = min(k[0] for k in ks), min(k[1] for k in ks)
        rs, cs = max(k[0] for k in ks) - r0 + 1, max(k[1] for k in ks) - c0 + 1
        out.append(Cell(r0, m - c0 - cs if rtl else c0, rs, cs))
    return sorted(out, key=lambda c: (c.row, c.col)) if n >= 2 and m >= 2 else None


def shaded_rows(bgr: np.ndarray, bounds: list[tuple[int, int]]) -> int:
    """How many rows at the top are darker than the paper."""
    g = I.gray(bgr)
    paper = float(np.percentile(g, 90))
    k = 0
    for a, b in bounds:
        if paper - float(np.median(np.percentile(g[a:b], 75, axis=0))) <= 8:
            break
        k += 1
    return k


def with_header_rows(bgr: np.ndarray, cells: list[Cell]) -> list[Cell]:
    """Cells of the shaded rows at the top marked as headers; rows are taken as equally tall."""
    n, h = max((c.row + c.rowspan for c in cells), default=0), bgr.shape[0]
    shaded = shaded_rows(bgr, [(r * h // n, (r + 1) * h // n) for r in range(n)])
    for c in cells:
        c.header = c.row < shaded < n
    return cells
