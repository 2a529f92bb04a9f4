"""Regions of a page from pixels: pictures told from text, coloured ink cut out of text, text that no detector found."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from vellum import model as M
from vellum.kernels import image as I
from vellum.operators.layout import _share, _size, grouped_lines, surviving

PICTURES = ("figure", "logo", "stamp", "signature", "handwritten_note")
PLAIN = ("paragraph", "title", "header", "footer", "list")


@dataclass(frozen=True)
class Found:
    """A region: its type, box, score and who found it."""

    type: str
    box: tuple[float, float, float, float]
    score: float = 0.5
    source: str = "heuristic"


class Sheet:
    """A page with its masks of ink and of coloured ink; the outermost strip, where a photo's border is, holds neither."""

    def __init__(self, page: np.ndarray, colours: bool = True):
        self.h, self.w = page.shape[:2]
        self.page = page
        self.ink = I.ink_mask(I.gray(page)).astype(bool)
        self.colour = I.coloured_mask(page).astype(bool) if colours else np.zeros(page.shape[:2], bool)
        dx, dy = int(0.02 * self.w), int(0.015 * self.h)
        for mask in (self.ink, self.colour):
            mask[:dy], mask[self.h - dy :], mask[:, :dx], mask[:, self.w - dx :] = False, False, False, False

    def at(self, box) -> tuple[slice, slice]:
        x0, y0, x1, y1 = (int(v) for v in box)
        return slice(max(0, y0), max(0, y1)), slice(max(0, x0), max(0, x1))

    def coloured_share(self, box) -> float:
        """How much of the ink in a box is coloured."""
        s = self.at(box)
        return float((self.colour[s] & self.ink[s]).sum() / max(1, self.ink[s].sum()))

    def kind(self, blob: np.ndarray) -> str:
        """Round and large: a stamp; one long stroke of few parts: a signature; else a note."""
        h, w = blob.shape
        parts, longest = I.blob_stats(blob.astype(np.uint8))
        if 0.7 < w / max(1, h) < 1.4 and w > 0.08 * self.w:
            return "stamp"
        return "signature" if longest > 0.55 * w and parts <= 4 and w > 0.1 * self.w else "handwritten_note"


def refined(r: Found, sheet: Sheet) -> Found:
    """A detector's picture that is text becomes text, its text that is one large drawing a picture, and a figure what its ink says."""
    s = sheet.at(r.box)
    x0, y0, x1, y1 = r.box
    w, h = x1 - x0, y1 - y0
    if not sheet.ink[s].size:
        return r
    if r.type in ("header", "title", "paragraph") and min(w, h) > 0.08 * sheet.w and I.is_graphic(sheet.ink[s].astype(np.uint8)):
        r = replace(r, type="logo" if y1 < 0.22 * sheet.h else "figure", source=r.source + "+graphic")
    if r.type != "figure":
        return r
    if I.is_texty(sheet.ink[s].astype(np.uint8), sheet.colour[s].astype(np.uint8), sheet.w):
        return replace(r, type="paragraph", source=r.source + "+text")
    if y1 < 0.2 * sheet.h and abs((x0 + x1) / 2 - sheet.w / 2) < 0.2 * sheet.w:
        return replace(r, type="logo")
    share = sheet.coloured_share(r.box)
    if share > 0.3 and 0.6 < w / max(h, 1) < 1.6 and w > 0.08 * sheet.w:
        return replace(r, type="stamp")
    return replace(r, type=sheet.kind(sheet.colour[s]), source=r.source + "+coloured") if share > 0.5 else r


def split(r: Found, sheet: Sheet) -> list[Found]:
    """A picture that holds several pieces of coloured ink (a stamp and the signature beside it) as one region each: rings first, then what is left."""
    s = sheet.at(r.box)
    rest = sheet.colour[s].copy()
    if r.type not in PICTURES or r.type == "logo" or not rest.size or rest.mean() < 0.003:
        return [r]
    x0, y0 = int(r.box[0]), int(r.box[1])
    out = []
    ys, xs = np.mgrid[: rest.shape[0], : rest.shape[1]]
    for cx, cy, radius in I.circles(rest.astype(np.uint8), sheet.w):
        out.append(replace(r, type="stamp", box=(max(0.0, x0 + cx - radius), max(0.0, y0 + cy - radius), x0 + cx + radius, y0 + cy + radius), source=r.source + "+ring"))
        rest &= np.hypot(xs - cx, ys - cy) > 1.08 * radius
    if out and rest.mean() < 0.002:
        return out
    k = max(3, sheet.w // 90)
    _, parts = I.components(I.closed(rest.astype(np.uint8), k, k))
    blobs = [p[:4] for p in parts if p[2] - p[0] > 0.03 * sheet.w and p[3] - p[1] > 0.008 * sheet.h]
    if not out and len(blobs) < 2:
        if blobs and r.type != "stamp":
            a, b, c, d = blobs[0]
            return [replace(r, type=sheet.kind(rest[b:d, a:c]))]
        return [r]
    return out + [replace(r, type=sheet.kind(rest[b:d, a:c]), box=(float(x0 + a), float(y0 + b), float(x0 + c), float(y0 + d)), source=r.source + "+split") for a, b, c, d in blobs]


def carved(r: Found, sheet: Sheet) -> list[Found]:
    """Text whose ink is mostly coloured is handwriting; coloured ink above or below a text's black lines becomes a region of its own."""
    if r.type not in PLAIN:
        return [r]
    s = sheet.at(r.box)
    colour, ink = sheet.colour[s], sheet.ink[s]
    share = sheet.coloured_share(r.box)
    if share > 0.6:
        return [replace(r, type=sheet.kind(colour), source=r.source + "+coloured")]
    if share < 0.08:
        return [r]
    black = I.opened((ink & ~I.dilate(colour.astype(np.uint8), 7, 7).astype(bool) & (I.hsv(sheet.page[s])[0] < 40)).astype(np.uint8), 3, 3)
    wide = ink.shape[1]
    dark, inked = black.sum(1) > max(6, 0.02 * wide), colour.sum(1) > max(3, 0.01 * wide)
    if not dark.any():
        return [r]
    top, bottom = I.main_rows(dark, black.sum(1))
    x0, y0 = int(r.box[0]), int(r.box[1])
    out = []
    for lo, hi in ((0, top), (bottom, len(inked))):
        rows = np.flatnonzero(inked[lo:hi])
        if len(rows) and len(rows) >= 0.01 * sheet.h:
            part = colour[lo + rows[0] : lo + rows[-1] + 1]
            cols = np.flatnonzero(part.any(0))
            box = (float(x0 + cols[0]), float(y0 + lo + rows[0]), float(x0 + cols[-1] + 1), float(y0 + lo + rows[-1] + 1))
            out.append(Found(sheet.kind(part[:, cols[0] : cols[-1] + 1]), box, 0.5, r.source + "+carved"))
    return [*out, replace(r, box=(r.box[0], float(y0 + top), r.box[2], float(y0 + bottom))) if out else r]


def uncovered(found: list[Found], sheet: Sheet) -> list[Found]:
    """Coloured ink and groups of black lines outside all regions; under stamps and signatures only their own ink counts as covered."""
    mask = I.without_rules(sheet.ink.astype(np.uint8)).astype(bool)
    colour, spread = sheet.colour.copy(), I.dilate(sheet.colour.astype(np.uint8), 5, 5).astype(bool)
    for r in found:
        s = sheet.at((r.box[0] - 4, r.box[1] - 4, r.box[2] + 4, r.box[3] + 4))
        mask[s] &= ~spread[s] if r.type in ("stamp", "signature") else False
        if r.type in PICTURES:
            colour[sheet.at(r.box)] = False
    out = []
    for x0, y0, x1, y1, _ in I.coloured_blobs(colour.astype(np.uint8)):
        box = (float(x0), float(y0), float(x1), float(y1))
        kind = sheet.kind(colour[y0:y1, x0:x1])
        if kind != "stamp" and any(_share(box, r.box) > 0.6 * _size(box) for r in found if r.type not in PICTURES and r.type != "table"):
            continue  # coloured words within a text
        out.append(Found(kind, box, 0.5, f"heuristic:{kind}"))
        mask[y0:y1, x0:x1] &= ~spread[y0:y1, x0:x1] if kind == "stamp" else False
    lines = I.text_lines(mask.astype(np.uint8), sheet.w)
    for at in grouped_lines(lines):
        bs = [lines[i] for i in at]
        x0, y0, x1, y1 = min(b[0] for b in bs), min(b[1] for b in bs), max(b[2] for b in bs), max(b[3] for b in bs)
        if (x1 - x0) * (y1 - y0) >= 0.0008 * sheet.w * sheet.h and mask[y0:y1, x0:x1].mean() >= 0.04:
            out.append(Found("paragraph", (float(x0), float(y0), float(x1), float(y1)), 0.4, "heuristic:lines"))
    return out


def distinct(found: list[Found]) -> list[Found]:
    return [found[i] for i in surviving([r.box for r in found], [r.type for r in found], [r.score for r in found])]


def analysed(page: np.ndarray, detected: list[Found], colours: bool = True, fill: bool = True) -> list[Found]:
    """All regions of a page: a detector's, looked at more closely, and what it missed. colours and fill turn parts of this off."""
    sheet = Sheet(page, colours)
    found = distinct([x for r in detected for x in split(refined(r, sheet), sheet)])
    if colours:
        found = [x for r in found for x in carved(r, sheet)]
    if fill:
        found = distinct(found + uncovered(found, sheet))
    else:
        found = distinct(found)
    cut = [replace(r, box=(max(0.0, r.box[0]), max(0.0, r.box[1]), min(float(sheet.w), r.box[2]), min(float(sheet.h), r.box[3]))) for r in found]
    return [r for r in cut if r.box[2] > r.box[0] and r.box[3] > r.box[1]]


def without_stamps(crop: np.ndarray, x0: int, y0: int, stamps: list[tuple]) -> np.ndarray:
    """The crop of a text at (x0, y0) with the coloured ink of stamps that lie over it turned to paper."""
    out = crop.copy()
    for a, b, c, d in stamps:
        s = np.s_[max(0, int(b) - y0) : max(0, int(d) - y0), max(0, int(a) - x0) : max(0, int(c) - x0)]
        if out[s].size:
            ink = I.dilate(I.coloured_mask(crop)[s], 3, 3).astype(bool)
            out[s][ink] = np.percentile(crop.reshape(-1, 3), 90, axis=0).astype(np.uint8)
    return out


TEXT = tuple(t for t in M.TEXT_TYPES if t != "handwritten_note")
