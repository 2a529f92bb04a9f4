"""Pictures of synthetic letters in NumPy, for tests of everything that looks at pixels.

No font is at hand, so a letter of the alphabet is drawn as two strokes whose places follow from its code point, and a word
as its letters side by side, from the right in right-to-left text: lines, words, sizes and colours are those of a page, and a
reader of letters would find none.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vellum.functions.text import bidi_runs
from vellum.operators import tables as TB
from vellum.sources import images as IM

INK, BLUE, RED = (35, 30, 30), (170, 60, 30), (40, 40, 190)


def blank(h: int, w: int) -> np.ndarray:
    return np.full((h, w, 3), 250, np.uint8)


def word_width(word: str, size: int) -> int:
    return max(1, round(0.5 * size)) * len(word)


def wrapped(text: str, width: int, size: int) -> list[str]:
    """Lines of whole words that fit a width; a word that is wider stands alone."""
    out, space = [], max(2, round(0.35 * size))
    for line in text.split("\n"):
        now, used = [], 0
        for w in line.split():
            n = word_width(w, size)
            if now and used + space + n > width:
                out.append(" ".join(now))
                now, used = [], 0
            used += n + (space if now else 0)
            now.append(w)
        out.append(" ".join(now))
    return out


def line(page: np.ndarray, text: str, x0: int, x1: int, y: int, size: int, colour=INK, align: str = "left") -> None:
    """One line of text with its top at y: words in order of reading, each from the side its own direction begins at."""
    rtl = align == "right"
    pitch, stroke, space = max(1, round(0.5 * size)), max(1, size // 9), max(2, round(0.35 * size))
    words = text.split()
    total = sum(word_width(w, size) for w in words) + space * max(0, len(words) - 1)
    x = x1 if rtl else x0 + max(0, (x1 - x0 - total) // 2) if align == "center" else x0
    for w in words:
        n = word_width(w, size)
        left = x - n if rtl else x
        back = rtl and bidi_runs(w, "rtl")[0][1] == "rtl"
        for k, c in enumerate(w):
            a = left + (len(w) - 1 - k if back else k) * pitch
            code = ord(c)
            tall, at = (0 if code % 3 else size // 4), 1 + code % max(1, pitch - 2 * stroke)
            page[y + tall : y + size, a : a + stroke] = colour
            page[y + size // 2 : y + size // 2 + stroke, a : a + pitch - 1] = colour
            page[y + size // 3 : y + size, a + at : a + at + stroke] = colour
        x = left - space if rtl else left + n + space


def paragraph(page: np.ndarray, text: str, box: tuple, size: int, colour=INK, align: str = "left", leading: float = 1.6) -> int:
    """Wrapped lines from the top of a box; returns where they end."""
    x0, y, x1, _ = (int(v) for v in box)
    for t in wrapped(text, x1 - x0, size):
        line(page, t, x0, x1, y, size, colour, align)
        y += round(leading * size)
    return y


def ring(page: np.ndarray, cx: int, cy: int, radius: int, thick: int, colour) -> None:
    y, x = np.mgrid[: page.shape[0], : page.shape[1]]
    d = np.hypot(x - cx, y - cy)
    page[(d <= radius) & (d >= radius - thick)] = colour


def stamp(page: np.ndarray, box: tuple, colour=BLUE) -> None:
    """Two rings and a word between bars."""
    x0, y0, x1, y1 = (int(v) for v in box)
    cx, cy, r = (x0 + x1) // 2, (y0 + y1) // 2, min(x1 - x0, y1 - y0) // 2
    ring(page, cx, cy, r, max(4, r // 12), colour)
    ring(page, cx, cy, round(0.7 * r), max(2, r // 30), colour)
    line(page, "APPROVED", cx - r // 2, cx + r // 2, cy - r // 10, max(6, r // 5), colour, "center")


def signature(page: np.ndarray, box: tuple, colour=BLUE) -> None:
    """One long stroke of waves that get smaller."""
    x0, y0, x1, y1 = (int(v) for v in box)
    t = np.linspace(0, 1, 4 * (x1 - x0))
    x = x0 + 4 + t * (x1 - x0 - 8)
    y = (y0 + y1) / 2 + np.sin(t * 26) * (1 - 0.7 * t) * (y1 - y0 - 10) / 2
    for dx in range(-2, 3):
        for dy in range(-2, 3):
            page[np.rint(y + dy).astype(int), np.rint(x + dx).astype(int)] = colour


def logo(page: np.ndarray, box: tuple, colour=INK) -> None:
    """A disc in a frame."""
    x0, y0, x1, y1 = (int(v) for v in box)
    page[y0:y1, x0:x1][:4] = colour
    page[y1 - 4 : y1, x0:x1] = colour
    page[y0:y1, x0 : x0 + 4] = colour
    page[y0:y1, x1 - 4 : x1] = colour
    ring(page, (x0 + x1) // 2, (y0 + y1) // 2, round(0.42 * min(x1 - x0, y1 - y0)), 10**6, colour)


def table(page: np.ndarray, markup: str, box: tuple, rtl: bool, size: int = 16) -> None:
    """Ruled cells with their texts; rows of header cells alone are shaded."""
    cells, n, m = TB.grid(markup)
    x0, y0, x1, y1 = (int(v) for v in box)
    xs, ys = np.linspace(x0, x1 - 2, m + 1).round().astype(int), np.linspace(y0, y1 - 2, n + 1).round().astype(int)
    heads = {c.row for c in cells if c.header} - {c.row for c in cells if not c.header}
    for c in cells:
        a, b = (m - c.col - c.colspan, m - c.col) if rtl else (c.col, c.col + c.colspan)
        left, right, top, end = xs[a], xs[b], ys[c.row], ys[c.row + c.rowspan]
        if c.row in heads:
            page[top:end, left:right] = 222
        page[top : top + 2, left : right + 2] = page[end : end + 2, left : right + 2] = INK
        page[top : end + 2, left : left + 2] = page[top : end + 2, right : right + 2] = INK
        line(page, c.text, left + 8, right - 8, (top + end) // 2 - size // 2, size, INK, "right" if rtl else "left")


def letter(truth: dict) -> np.ndarray:
    """The picture of a page of `synthetic.page`."""
    page, rtl = blank(truth["height_px"], truth["width_px"]), truth["direction"] == "rtl"
    for b in truth["blocks"]:
        box, kind = b["bbox"], b["type"]
        if kind == "stamp":
            stamp(page, box)
        elif kind == "signature":
            signature(page, box)
        elif kind == "logo":
            logo(page, box)
        elif kind == "table":
            table(page, b["html"], box, rtl)
        else:
            size = {"title": 28, "handwritten_note": 48}.get(kind, 24)
            align = "center" if kind == "title" else "right" if rtl else "left"
            paragraph(page, b["text"], box, size, RED if kind == "handwritten_note" else INK, align, 2.4 if kind == "paragraph" else 1.6)
    return page


def drawn(truth: DataFrame) -> DataFrame:
    """(stem, content): a PNG for each truth page, degraded as its level says."""
    from vellum.sources.synthetic import degraded

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            out = []
            for r in f.itertuples():
                spec = {"height_px": r.height_px, "width_px": r.width_px, "direction": r.direction, "blocks": [b.asDict() if hasattr(b, "asDict") else dict(b) for b in r.blocks]}
                out.append((r.stem, IM.png(degraded(letter(spec), r.level, len(r.stem))[0])))
            yield pd.DataFrame(out, columns=["stem", "content"], dtype=object)

    return truth.selectExpr("stem", "height_px", "width_px", "direction", "blocks", "augment.level AS level").mapInPandas(run, "stem string, content binary")
