"""Image kernels in NumPy: height x width x 3 arrays of BGR bytes, or height x width of grey ones."""

from __future__ import annotations

import numpy as np


def gray(bgr: np.ndarray) -> np.ndarray:
    x = bgr.astype(np.float64)
    return np.rint(0.114 * x[..., 0] + 0.587 * x[..., 1] + 0.299 * x[..., 2]).astype(np.uint8)


def hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Saturation and value, 0 to 255."""
    v = bgr.max(axis=-1).astype(np.float64)
    low = bgr.min(axis=-1).astype(np.float64)
    s = np.where(v > 0, (v - low) * 255 / np.maximum(v, 1), 0)
    return np.rint(s).astype(np.uint8), v.astype(np.uint8)


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """By the mean of the area where it shrinks, bilinear where it grows."""
    H, W = img.shape[:2]
    x = img.astype(np.float64)
    return np.rint(_along(_along(x, h, 0), w, 1)).clip(0, 255).astype(np.uint8) if (H, W) != (h, w) else img.copy()


def _along(x: np.ndarray, n: int, axis: int) -> np.ndarray:
    N = x.shape[axis]
    x = np.moveaxis(x, axis, 0)
    if n < N:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        edge = np.arange(n + 1) * N / n
        at = np.minimum(edge.astype(int), N - 1)
        part = (edge - at).reshape(-1, *[1] * (x.ndim - 1))
        total = total[at] + part * x[at]
        out = np.diff(total, axis=0) * n / N
    else:
        c = np.clip((np.arange(n) + 0.5) * N / n - 0.5, 0, N - 1)
        lo = c.astype(int)
        f = (c - lo).reshape(-1, *[1] * (x.ndim - 1))
        out = x[lo] * (1 - f) + x[np.minimum(lo + 1, N - 1)] * f
    return np.moveaxis(out, 0, axis)


def fitted(img: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """Shrunk so that the longer side is at most `most`, with the scale."""
    h, w = img.shape[:2]
    k = min(1.0, most / max(h, w))
    return (img, 1.0) if k == 1 else (resize(img, max(1, round(h * k)), max(1, round(w * k))), k)


def box_mean(x: np.ndarray, k: int) -> np.ndarray:
    """Mean over k x k (k odd), borders repeated."""
    r = k // 2
    p = np.pad(x.astype(np.float64), r, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def _slide(x: np.ndarray, k: int, axis: int, f) -> np.ndarray:
    """Running minimum or maximum of k values, by doubling."""
    r = k // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, k - 1 - r)
    y, done = np.pad(x, pad, mode="edge"), 1
    n = x.shape[axis]
    y = np.moveaxis(y, axis, 0)
    while done < k:
        step = min(done, k - done)
        y = f(y[: len(y) - step], y[step:])
        done += step
    return np.moveaxis(y[:n], 0, axis)


def dilate(x: np.ndarray, kh: int, kw: int) -> np.ndarray:
    return _slide(_slide(x, kh, 0, np.maximum), kw, 1, np.maximum)


def erode(x: np.ndarray, kh: int, kw: int) -> np.ndarray:
    return _slide(_slide(x, kh, 0, np.minimum), kw, 1, np.minimum)


def opened(x: np.ndarray, kh: int, kw: int) -> np.ndarray:
    return dilate(erode(x, kh, kw), kh, kw)


def closed(x: np.ndarray, kh: int, kw: int) -> np.ndarray:
    return erode(dilate(x, kh, kw), kh, kw)


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (0: none) of 8-connected parts, and rows of (x0, y0, x1, y1, area): runs of each row joined with those above."""
    m = mask.astype(bool)
    h, w = m.shape
    edge = np.diff(np.pad(m, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    ys, xs = np.nonzero(edge == 1)
    xe = np.nonzero(edge == -1)[1]
    n = len(ys)
    parent = np.arange(n)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ys, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if xs[i] <= xe[j] and xs[j] <= xe[i]:  # touching, also at corners
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if xe[i] < xe[j]:
                i += 1
            else:
                j += 1
    root = np.array([find(i) for i in range(n)], int)
    ids, label = np.unique(root, return_inverse=True)
    out = np.zeros((h, w), np.int32)
    for y, a, b, k in zip(ys, xs, xe, label):
        out[y, a:b] = k + 1
    stats = np.zeros((len(ids), 5), np.int64)
    stats[:, :2] = max(h, w)
    np.minimum.at(stats[:, 0], label, xs)
    np.minimum.at(stats[:, 1], label, ys)
    np.maximum.at(stats[:, 2], label, xe)
    np.maximum.at(stats[:, 3], label, ys + 1)
    np.add.at(stats[:, 4], label, xe - xs)
    return out, stats


# ---- quality of a photo ----


def blur_variance(bgr: np.ndarray, long_side: int = 1600) -> float:
    """Variance of the Laplacian with the longer side brought to 1600."""
    g = gray(bgr)
    h, w = g.shape
    k = long_side / max(h, w)
    g = resize(g, max(1, round(h * k)), max(1, round(w * k))).astype(np.float64)
    p = np.pad(g, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def glare_ratio(bgr: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Share of the page that is clipped: nearly white, without colour, well above the paper, in spots of some size."""
    s, v = hsv(bgr)
    where = np.ones(v.shape, bool) if mask is None else mask.astype(bool)
    if not where.any():
        return 0.0
    spot = (v >= 250) & (s < 40) & (v.astype(float) > np.median(v[where]) + 18) & where
    return float(opened(spot.astype(np.uint8), 5, 5).sum() / where.sum())


def assess(bgr: np.ndarray, cfg) -> dict:
    h, w = bgr.shape[:2]
    blur, glare = blur_variance(bgr), glare_ratio(bgr)
    notes = []
    if blur < cfg.min_blur_var:
        notes.append(f"blurry image (laplacian var {blur:.0f} < {cfg.min_blur_var:.0f})")
    if max(h, w) < cfg.min_long_side_px:
        notes.append(f"low resolution ({w}x{h}); recommended long side >= {cfg.min_long_side_px}px")
    if glare > cfg.max_glare_ratio:
        notes.append(f"glare/highlight clipping on {glare:.1%} of the page")
    return {"width_px": w, "height_px": h, "blur_laplacian_var": blur, "glare_ratio": glare, "warnings": notes}


def with_coverage(report: dict, coverage: float | None, found: bool, dpi: float | None, cfg) -> dict:
    notes = list(report["warnings"])
    if coverage is not None and found and coverage < cfg.min_coverage:
        notes.append(f"document covers only {coverage:.0%} of the photo; move closer")
    if not found:
        notes.append("document boundary not detected; assuming the photo is already cropped")
    if dpi is not None and dpi < 120:
        notes.append(f"effective resolution only {dpi:.0f} dpi")
    return {**report, "document_coverage": coverage, "boundary_found": found, "estimated_dpi": dpi, "warnings": notes}


# ---- illumination ----


def background(channel: np.ndarray, k: int) -> np.ndarray:
    """The paper's brightness: closed, smoothed, at a quarter of the size."""
    h, w = channel.shape
    small = resize(channel, max(1, h // 4), max(1, w // 4))
    k = max(3, k // 4) | 1
    return resize(np.rint(box_mean(box_mean(closed(small, k, k), k), k)).astype(np.uint8), h, w)


def flatten(bgr: np.ndarray, kernel_frac: float = 0.035, level: float = 245.0) -> np.ndarray:
    k = int(max(bgr.shape[:2]) * kernel_frac) | 1
    out = [bgr[..., c].astype(np.float64) / np.maximum(background(bgr[..., c], k), 1) * level for c in range(3)]
    return np.stack(out, axis=-1).clip(0, 255).astype(np.uint8)


def whitened(img: np.ndarray) -> np.ndarray:
    p = max(1.0, float(np.percentile(img, 90)))
    return (img.astype(np.float64) * 255 / p).clip(0, 255).astype(np.uint8)


def ink_on_transparent(img: np.ndarray) -> np.ndarray:
    a = (255 - gray(img).astype(np.float64)) * 1.6
    a = np.where(a < 25, 0, a).clip(0, 255).astype(np.uint8)
    return np.dstack([img, a])


# ---- ink ----


def ink_mask(g: np.ndarray, k: int = 41, c: float = 18) -> np.ndarray:
    """Darker than the mean around by c."""
    return (g.astype(np.float64) < box_mean(g, k) - c).astype(np.uint8)


def coloured_mask(bgr: np.ndarray) -> np.ndarray:
    s, v = hsv(bgr)
    return opened(((s > 42) & (v < np.percentile(v, 90) - 20) & (v > 60)).astype(np.uint8), 2, 2)


def without_rules(ink: np.ndarray) -> np.ndarray:
    """Ink less its long straight lines."""
    h, w = ink.shape
    rules = np.maximum(opened(ink, 1, max(15, w // 12)), opened(ink, max(15, h // 18), 1))
    return (ink.astype(bool) & ~dilate(rules, 3, 3).astype(bool)).astype(np.uint8)


def text_lines(ink: np.ndarray, page_w: int) -> list[tuple[int, int, int, int]]:
    """Boxes of lines: ink smeared along lines, its parts filtered by size and fill."""
    _, stats = components(closed(ink, 3, max(9, page_w // 70)))
    w, h, a = stats[:, 2] - stats[:, 0], stats[:, 3] - stats[:, 1], stats[:, 4]
    good = (h >= 0.006 * page_w) & (h <= 0.08 * page_w) & (w >= 0.012 * page_w) & (a >= 0.06 * w * h)
    return [tuple(int(v) for v in r[:4]) for r in stats[good]]


def line_height(ink: np.ndarray, page_w: int) -> tuple[float | None, int | None]:
    lines = text_lines(ink, page_w)
    return (float(np.median([b[3] - b[1] for b in lines])), len(lines)) if lines else (None, None)


def main_rows(rows: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    """Of runs of set rows, joined over small gaps, the span with most weight."""
    edge = np.flatnonzero(np.diff(np.pad(rows.astype(np.int8), 1)))
    runs = list(zip(edge[::2], edge[1::2]))
    runs = [r for r in runs if r[1] - r[0] >= 6] or runs
    if not runs:
        return 0, 0
    gap, parts = 1.5 * float(np.median([b - a for a, b in runs])), [list(runs[0])]
    for a, b in runs[1:]:
        if a - parts[-1][1] < gap:
            parts[-1][1] = b
        else:
            parts.append([a, b])
    a, b = max(parts, key=lambda p: float(weight[p[0] : p[1]].sum()))
    return int(a), int(b)


def is_graphic(ink: np.ndarray) -> bool:
    """About square with one large part that spans it."""
    h, w = ink.shape
    total = int((ink > 0).sum())
    if not total or not 0.5 <= w / max(1, h) <= 2:
        return False
    _, s = components(ink)
    big = s[s[:, 4].argmax()]
    return bool(big[4] > 0.35 * total and big[2] - big[0] > 0.5 * w and big[3] - big[1] > 0.5 * h)


def is_texty(ink: np.ndarray, coloured: np.ndarray, page_w: int) -> bool:
    """A region taken for a picture that is lines of black text."""
    if (coloured > 0).mean() > 0.02 or is_graphic(ink):
        return False
    lines = text_lines(ink, page_w)
    rows = np.zeros(ink.shape[0], bool)
    for b in lines:
        rows[b[1] : b[3]] = True
    return bool(lines) and rows.mean() > 0.5 and all(b[3] - b[1] < 0.06 * page_w for b in lines)


def blob_stats(mask: np.ndarray) -> tuple[int, int]:
    """How many parts a blob has, and the width of its longest one."""
    _, s = components(mask)
    return len(s), int((s[:, 2] - s[:, 0]).max()) if len(s) else 0


def coloured_blobs(coloured: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Boxes and areas of coloured ink, brought together over small gaps and filtered by size."""
    h, w = coloured.shape
    k = max(3, w // 60)
    _, s = components(closed(coloured, k, k))
    out = []
    for x0, y0, x1, y1, _ in s:
        bw, bh, ink = x1 - x0, y1 - y0, int((coloured[y0:y1, x0:x1] > 0).sum())
        if bw >= 0.03 * w and bh >= 0.008 * h and ink >= 0.0005 * w * h and bw * bh <= 0.2 * w * h and ink / (bw * bh) >= 0.01:
            out.append((int(x0), int(y0), int(x1), int(y1), ink))
    return out


def circles(coloured: np.ndarray, page_w: int, most: int = 3) -> list[tuple[float, float, float]]:
    """Rings of coloured ink (round stamps): votes of edge points for centres along their gradients, and a check that ink is on most of the ring."""
    h, w = coloured.shape
    k = max(1, page_w // 400)
    small = resize(coloured * 255, max(1, h // k), max(1, w // k)).astype(np.float64)
    gy, gx = np.gradient(box_mean(small, 3))
    size = np.hypot(gx, gy)
    ys, xs = np.nonzero(size > 0.5 * size.max()) if size.max() > 0 else (np.zeros(0, int), np.zeros(0, int))
    lo, hi = 0.04 * page_w / k, 0.14 * page_w / k
    found = []
    for r in np.arange(lo, hi + 1, max(1.0, (hi - lo) / 24)):
        votes = np.zeros(small.shape)
        for sign in (1, -1):
            cx = np.rint(xs + sign * r * gx[ys, xs] / size[ys, xs]).astype(int)
            cy = np.rint(ys + sign * r * gy[ys, xs] / size[ys, xs]).astype(int)
            ok = (cx >= 0) & (cy >= 0) & (cx < votes.shape[1]) & (cy < votes.shape[0])
            np.add.at(votes, (cy[ok], cx[ok]), 1)
        votes = box_mean(votes, 3) * 9
        cy, cx = np.unravel_index(votes.argmax(), votes.shape)
        t = np.linspace(0, 2 * np.pi, 120, endpoint=False)
        near = dilate((small > 60).astype(np.uint8), 5, 5)
        px, py = np.rint(cx + r * np.cos(t)).astype(int), np.rint(cy + r * np.sin(t)).astype(int)
        ok = (px >= 0) & (py >= 0) & (px < near.shape[1]) & (py < near.shape[0])
        on = near[py[ok], px[ok]].sum() / len(t)
        if on >= 0.55:
            found.append((votes[cy, cx], float(cx * k), float(cy * k), float(r * k)))
    out: list[tuple[float, float, float]] = []
    for _, x, y, r in sorted(found, reverse=True):
        if all(np.hypot(x - a, y - b) > max(r, c) for a, b, c in out):
            out.append((x, y, r))
    return out[:most]


def overlay(page: np.ndarray, boxes: list[tuple], colour: tuple = (0, 0, 255)) -> np.ndarray:
    """The page with outlines of boxes."""
    out = page.copy()
    for x0, y0, x1, y1 in (tuple(int(round(v)) for v in b[:4]) for b in boxes):
        for s in (np.s_[y0 : y0 + 3, x0:x1], np.s_[y1 - 3 : y1, x0:x1], np.s_[y0:y1, x0 : x0 + 3], np.s_[y0:y1, x1 - 3 : x1]):
            out[s] = colour
    return out
