"""Layout operators: overlap joins, islands, lines into groups, resolving overlapping detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum import model as M
from vellum.functions import geometry as G
from vellum.operators.paged import boxes, by_page


def typed(label: Column) -> Column:
    """Block type of a detector's label."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in M.LABEL_MAP.items() for x in kv)), label), F.lit("paragraph"))


def overlap_pairs(a: DataFrame, b: DataFrame, page: str = "doc_id", box: str = "bbox") -> DataFrame:
    """Rows of a and b of one page whose boxes share area, as structs a and b: an equi-join on the page with the overlap as its residual."""
    left, right = a.select(F.col(page), F.struct("*").alias("a")), b.select(F.col(page), F.struct("*").alias("b"))
    return left.join(right, page).where(G.overlaps(F.col(f"a.{box}"), F.col(f"b.{box}")))


def contained_pairs(a: DataFrame, b: DataFrame, least: float = 0.5, page: str = "doc_id") -> DataFrame:
    """Overlapping pairs with the share of a inside b, from `least` on."""
    pairs = overlap_pairs(a, b, page).withColumn("share", G.containment(F.col("a.bbox"), F.col("b.bbox")))
    return pairs.where(F.col("share") >= least)


def tiled_by(regions: DataFrame, page: str = "doc_id", key: str = "id") -> DataFrame:
    """For each text region the number of other text regions mostly inside it and the share of it that they cover."""
    text = regions.where(F.col("type").isin(*M.TEXT_TYPES))
    pairs = contained_pairs(text, text, 0.0, page).where((F.col(f"a.{key}") != F.col(f"b.{key}")) & (F.col("share") > 0.5))
    per = pairs.groupBy(page, F.col(f"b.{key}").alias(key)).agg(
        F.count("*").alias("inner"), F.sum(G.intersection(F.col("a.bbox"), F.col("b.bbox"))).alias("covered"), F.max(G.area(F.col("b.bbox"))).alias("area")
    )
    return per.select(page, key, "inner", (F.col("covered") / F.greatest("area", F.lit(1.0))).alias("cover"), ((F.col("inner") >= 2) & (F.col("covered") > 0.6 * F.greatest("area", F.lit(1.0)))).alias("tiled"))


def matched(truth: DataFrame, found: DataFrame, how: str = "left_semi", least: float = 0.25, page: str = "doc_id") -> DataFrame:
    """Rows of truth with (left_semi) or without (left_anti) a row of found of their page and type and an IoU above `least`."""
    t, f = truth.alias("t"), found.alias("f")
    same = (F.col(f"t.{page}") == F.col(f"f.{page}")) & (F.col("t.type") == F.col("f.type"))
    near = G.overlaps(F.col("t.bbox"), F.col("f.bbox")) & (G.iou(F.col("t.bbox"), F.col("f.bbox")) > least)
    return t.join(f, same & near, how)


def suppressed_by_stamps(blocks: DataFrame, page: str = "doc_id") -> DataFrame:
    """Text blocks with the boxes of the stamps that lie over them."""
    stamps = blocks.where("type = 'stamp'")
    text = blocks.where(F.col("type").isin(*M.TEXT_TYPES) & (F.col("type") != "handwritten_note"))
    return overlap_pairs(text, stamps, page).groupBy(page, F.col("a.id").alias("id")).agg(F.array_sort(F.collect_list("b.bbox")).alias("stamps"))


def islands(df: DataFrame, keys: list[str], start: Column, end: Column, tie: list[str], gap: float = 0.0, name: str = "grp") -> DataFrame:
    """Number the groups of intervals of each key: a group ends where the next start is beyond the furthest end by more than gap."""
    order = Window.partitionBy(*keys).orderBy(start, end, *tie)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (start > before + gap), 1).otherwise(0)
    marked = df.withColumn("_fresh", fresh)
    return marked.withColumn(name, F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def clusters(df: DataFrame, keys: list[str], value: Column, tolerance: float, tie: list[str]) -> DataFrame:
    """Mean of each chain of sorted values with steps of at most the tolerance."""
    order = Window.partitionBy(*keys).orderBy("v", *tie)
    step = F.when(F.coalesce(F.col("v") - F.lag("v").over(order) > tolerance, F.lit(True)), 1).otherwise(0)
    numbered = df.withColumn("v", value).withColumn("_step", step).withColumn("cluster", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "cluster").agg(F.avg("v").alias("center"), F.count("*").alias("n"))


def clipped(regions: DataFrame) -> DataFrame:
    """Regions cut to their page, without those that are left empty."""
    return regions.withColumn("bbox", G.clip(F.col("bbox"), F.col("page_w"), F.col("page_h"))).where(G.area(F.col("bbox")) > 0)


# ---- order-dependent steps of one page; a page has tens of boxes, so one call holds one page ----


def _share(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0.0


def _size(b) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def surviving(boxes: list[tuple], types: list[str], scores: list[float]) -> list[int]:
    """Places of the regions that stay, most important first.

    Text in a table goes. Images only compete with images: of two, one mostly inside the other, the
    less important goes. Of nested text regions a large one goes when smaller ones tile it, else the inner one does.
    """
    rank = sorted(range(len(boxes)), key=lambda i: (-M.PRIORITY.get(types[i], 0), -scores[i], -_size(boxes[i]), i))
    text = {i for i in rank if types[i] in M.TEXT_TYPES}
    inside = {(i, k): _share(boxes[i], boxes[k]) / max(_size(boxes[i]), 1e-6) for i in rank for k in rank if i != k}
    tiled = set()
    for k in text:
        inner = [x for x in text if x != k and inside[x, k] > 0.5]
        if len(inner) >= 2 and sum(_share(boxes[x], boxes[k]) for x in inner) > 0.6 * max(_size(boxes[k]), 1):
            tiled.add(k)
    gone: set[int] = set()
    for i in rank:
        for k in rank if i not in gone else ():
            c = inside.get((i, k), 0.0)
            if k == i or k in gone or c < 0.5:
                continue
            if i in text and types[k] == "table":
                if c > 0.6:
                    gone.add(i)
                    break
                continue
            if (i in text) != (k in text):
                continue
            if i not in text:
                if c > 0.75:
                    gone.add(i if M.PRIORITY.get(types[i], 0) <= M.PRIORITY.get(types[k], 0) else k)
            elif k in tiled:
                gone.add(k)
            elif c > 0.75 or _size(boxes[i]) < _size(boxes[k]):
                gone.add(i)
                break
    return [i for i in rank if i not in gone]


def deduped(regions: DataFrame, page: str = "doc_id", tie: str = "id") -> DataFrame:
    """Overlapping detections resolved page by page (the outcome depends on the order of visits); columns type, bbox and score are used."""
    fields = {"bbox": boxes(F.col("bbox")), "type": F.col("type"), "score": F.coalesce("score", F.lit(0.0))}
    return by_page(regions, page, [tie], lambda b, t, s: [(i, 0) for i in surviving(b, t, s)], fields, None)


def grouped_lines(lines: list[tuple]) -> list[list[int]]:
    """Places of line boxes in groups of neighbours, taken from the top down: a line joins the first group whose last line is close above and whose width it shares."""
    groups: list[dict] = []
    for i in sorted(range(len(lines)), key=lambda i: (lines[i][1], i)):
        x0, y0, x1, y1 = lines[i]
        h = y1 - y0
        for g in groups:
            gap, shared = y0 - g["y1"], min(g["x1"], x1) - max(g["x0"], x0)
            if -0.5 * h < gap < 0.9 * max(h, g["h"]) and shared > 0.3 * min(g["x1"] - g["x0"], x1 - x0):
                g["at"].append(i)
                g.update(x0=min(g["x0"], x0), x1=max(g["x1"], x1), y1=y1, h=h)
                break
        else:
            groups.append({"at": [i], "x0": x0, "x1": x1, "y1": y1, "h": h})
    return [g["at"] for g in groups]


def line_groups(lines: DataFrame, page: str = "doc_id", tie: str = "id") -> DataFrame:
    """lines with the number of their group."""
    kernel = lambda b: [(i, g) for g, at in enumerate(grouped_lines(b)) for i in at]
    return by_page(lines, page, [tie], kernel, {"bbox": boxes(F.col("bbox"))}, "line_group")
