"""Tables in HTML: cells, grids, clean markup, tree-edit similarity. Kernels are plain Python under Arrow UDFs."""

from __future__ import annotations

import html as H
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType


@dataclass
class Cell:
    row: int
    col: int
    rowspan: int = 1
    colspan: int = 1
    text: str = ""
    header: bool = False


@dataclass
class _Raw:
    header: bool
    rowspan: int
    colspan: int
    parts: list = field(default_factory=list)


def _span(v: str | None) -> int:
    return max(1, int(v)) if v and v.strip().isdigit() else 1


class _Reader(HTMLParser):
    """Rows of raw cells of the first table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[_Raw]] = []
        self.depth, self.done, self.cell, self.seen = 0, False, None, False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
            self.seen = True
        elif self.depth and tag == "tr":
            self.cell = None
            self.rows.append([])
        elif self.depth and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            a = dict(attrs)
            self.cell = _Raw(tag == "th", _span(a.get("rowspan")), _span(a.get("colspan")))
            self.rows[-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self.cell is not None and not self.done:
            self.cell.parts.append(data)


def _rows(markup: str | None) -> list[list[_Raw]]:
    r = _Reader()
    r.feed(markup or "")
    r.close()
    return r.rows


def _words(raw: _Raw) -> str:
    return " ".join("".join(raw.parts).split())


def grid(markup: str | None) -> tuple[list[Cell], int, int]:
    """Cells with their places (spans resolved) and the size of the first table."""
    taken: set[tuple[int, int]] = set()
    cells, wide, tall = [], 0, 0
    for r, row in enumerate(_rows(markup)):
        c = 0
        for raw in row:
            while (r, c) in taken:
                c += 1
            cells.append(Cell(r, c, raw.rowspan, raw.colspan, _words(raw), raw.header))
            taken.update((r + i, c + j) for i in range(raw.rowspan) for j in range(raw.colspan))
            c += raw.colspan
            wide = max(wide, c)
        tall = r + 1
    return cells, tall, wide


def to_html(cells: list[Cell]) -> str:
    """Rows in order of place; spans above one and header cells are marked."""
    by: dict[int, list[Cell]] = {}
    for c in sorted(cells, key=lambda c: (c.row, c.col)):
        by.setdefault(c.row, []).append(c)
    out = []
    for r in sorted(by):
        out.append("<tr>")
        for c in by[r]:
            tag = "th" if c.header else "td"
            spans = "".join(f' {k}="{v}"' for k, v in (("rowspan", c.rowspan), ("colspan", c.colspan)) if v > 1)
            out.append(f"<{tag}{spans}>{H.escape(c.text, quote=False)}</{tag}>")
        out.append("</tr>")
    return "<table>" + "".join(out) + "</table>"


def sanitized(markup: str | None) -> str:
    """Only table, tr, th and td, with whole spans above one; text escaped."""
    out = []
    for row in _rows(markup):
        out.append("<tr>")
        for raw in row:
            tag = "th" if raw.header else "td"
            spans = "".join(f' {k}="{v}"' for k, v in (("rowspan", raw.rowspan), ("colspan", raw.colspan)) if v > 1)
            out.append(f"<{tag}{spans}>{H.escape(''.join(raw.parts).strip(), quote=False)}</{tag}>")
        out.append("</tr>")
    return "<table>" + "".join(out) + "</table>"


def plain(markup: str | None) -> str:
    return " ".join(t for t in (_words(raw) for row in _rows(markup) for raw in row) if t)


# ---- similarity of trees ----


def _flat(markup: str) -> tuple[list[str], list[str], list[int]]:
    """Labels, texts and leftmost leaves of a table's tree, in postorder, counted from 1."""
    labels, texts, left = [""], [""], [0]

    def add(label, text, first):
        labels.append(label)
        texts.append(text)
        left.append(first)

    start = 1
    for row in _rows(markup):
        first = len(labels)
        for raw in row:
            add(f"td:{raw.rowspan}:{raw.colspan}", _words(raw), len(labels))
        add("tr", "", first)
    add("table", "", start)
    return labels, texts, left


def _distance(a: str, b: str) -> float:
    if a == b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (c != d))
    return row[-1] / max(len(a), len(b))


def tree_distance(a: str, b: str, structure_only: bool = False) -> float:
    """Ordered tree edit distance by key roots: one for insert, delete and another label; cell texts cost their edit distance."""
    la, ta, fa = _flat(a)
    lb, tb, fb = _flat(b)
    n, m = len(la) - 1, len(lb) - 1

    def roots(first):
        last: dict[int, int] = {}
        for i in range(1, len(first)):
            last[first[i]] = i
        return sorted(last.values())

    def change(i, j):
        if la[i] != lb[j]:
            return 1.0
        return 0.0 if structure_only or not la[i].startswith("td") else _distance(ta[i], tb[j])

    tree = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in roots(fa):
        for j in roots(fb):
            oi, oj = fa[i] - 1, fb[j] - 1
            f = [[0.0] * (j - oj + 1) for _ in range(i - oi + 1)]
            for x in range(1, i - oi + 1):
                f[x][0] = f[x - 1][0] + 1
            for y in range(1, j - oj + 1):
                f[0][y] = f[0][y - 1] + 1
            for x in range(1, i - oi + 1):
                for y in range(1, j - oj + 1):
                    p, q = x + oi, y + oj
                    edit = min(f[x - 1][y], f[x][y - 1]) + 1
                    if fa[p] == fa[i] and fb[q] == fb[j]:
                        f[x][y] = tree[p][q] = min(edit, f[x - 1][y - 1] + change(p, q))
                    else:
                        f[x][y] = min(edit, f[fa[p] - 1 - oi][fb[q] - 1 - oj] + tree[p][q])
    return tree[n][m]


def teds(ref: str | None, hyp: str | None, structure_only: bool = False) -> float:
    if not hyp:
        return 0.0
    size = max(len(_flat(ref or "")[0]), len(_flat(hyp)[0])) - 1
    return 1.0 - tree_distance(ref or "", hyp, structure_only) / max(1, size)


# ---- columns ----

CELL = StructType([StructField(n, t) for n, t in (("row", IntegerType()), ("col", IntegerType()), ("rowspan", IntegerType()), ("colspan", IntegerType()), ("text", StringType()), ("header", BooleanType()))])
GRID = StructType([StructField("cells", ArrayType(CELL)), StructField("n_rows", IntegerType()), StructField("n_cols", IntegerType())])
_CELL = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("rowspan", pa.int32()), ("colspan", pa.int32()), ("text", pa.string()), ("header", pa.bool_())])


@F.arrow_udf(GRID)
def _grid(markup: pa.Array) -> pa.Array:
    rows = []
    for x in markup.to_pylist():
        cells, n, m = grid(x)
        rows.append({"cells": [vars(c) for c in cells], "n_rows": n, "n_cols": m})
    return pa.array(rows, pa.struct([("cells", pa.list_(_CELL)), ("n_rows", pa.int32()), ("n_cols", pa.int32())]))


@F.arrow_udf(StringType())
def _clean(markup: pa.Array) -> pa.Array:
    return pa.array([sanitized(x) for x in markup.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _plain(markup: pa.Array) -> pa.Array:
    return pa.array([plain(x) for x in markup.to_pylist()], pa.string())


@F.arrow_udf(DoubleType())
def _teds(ref: pa.Array, hyp: pa.Array, structure_only: pa.Array) -> pa.Array:
    return pa.array([teds(a, b, bool(s)) for a, b, s in zip(ref.to_pylist(), hyp.to_pylist(), structure_only.to_pylist())], pa.float64())


def grid_column(markup: Column) -> Column:
    return _grid(markup)


def sanitized_column(markup: Column) -> Column:
    return _clean(markup)


def plain_column(markup: Column) -> Column:
    return _plain(markup)


def teds_column(ref: Column, hyp: Column, structure_only: bool = False) -> Column:
    return _teds(ref, hyp, F.lit(structure_only))


def html_of(cells: Column) -> Column:
    """Markup of an array of cells, in the JVM."""
    esc = lambda s: F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    at = F.array_sort(F.transform(cells, lambda c: F.struct(c.row.alias("row"), c.col.alias("col"), c.alias("c"))))
    rows = F.array_sort(F.array_distinct(F.transform(at, lambda x: x.row)))

    def one(x):
        c = x.c
        tag = F.when(c.header, "th").otherwise("td")
        span = lambda n, v: F.when(v > 1, F.concat(F.lit(f' {n}="'), v.cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit("<"), tag, span("rowspan", c.rowspan), span("colspan", c.colspan), F.lit(">"), esc(F.coalesce(c.text, F.lit(""))), F.lit("</"), tag, F.lit(">"))

    body = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.filter(at, lambda x: x.row == r), one), ""), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(body, ""), F.lit("</table>"))


def cells_of(df: DataFrame, key: str, markup: str) -> DataFrame:
    """A row for each cell of each table: key, row, col, rowspan, colspan, text, header."""
    names = ["row", "col", "rowspan", "colspan", "text", "header"]

    def run(batches):
        for b in batches:
            keys, cells = [], []
            for k, x in enumerate(b.column(1).to_pylist()):
                found = grid(x)[0]
                keys += [k] * len(found)
                cells += [vars(c) for c in found]
            flat = pa.array(cells, _CELL)
            yield pa.record_batch([b.column(0).take(pa.array(keys, pa.int32())), *(flat.field(n) for n in names)], [key, *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, markup).mapInArrow(run, f"`{key}` {kind}, row int, col int, rowspan int, colspan int, text string, header boolean")
