"""From recognised regions to finished blocks: arbitration of engines, types, splits, styles, metadata, review."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum import model as M
from vellum.config import Confidence, Docx
from vellum.functions import geometry as G
from vellum.functions import scoring as S
from vellum.functions import text as T
from vellum.operators.paged import boxes, by_page

STRIP = r"(?U)^\s+|\s+$"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def arbitrated(rows: DataFrame, cfg: Confidence = Confidence(), prefer_classic: bool = True, compose: bool = True) -> DataFrame:
    """Decide between the engines' results of a region.

    In: type, p_name, p_engine, p_text, p_conf, s_name, s_engine, s_text, s_conf (null secondary:
    no cross-check) and flags. Out: text, source_engine, engine_conf, agree, flags.
    """
    p, s = _text(F.col("p_text")), _text(F.col("s_text"))
    checked = F.col("s_engine").isNotNull() & (F.col("p_name") != F.col("s_name")) & ~F.col("type").isin("handwritten_note", "table")
    blind = F.col("p_name").isin(*cfg.agreement_ignore_digits_for) | F.col("s_name").isin(*cfg.agreement_ignore_digits_for)
    agree = F.when(checked, S.agreement(p, s, blind, compose))
    rescued = checked & S.is_blank(p) & ~S.is_blank(s) & (F.coalesce("s_conf", F.lit(0.0)) >= 0.6)
    agree = F.when(rescued, None).otherwise(agree)
    vlm = checked & (F.col("p_name") == "vlm") & (s != "")
    digits = F.greatest(T.digit_share(p), T.digit_share(s)) > 0.15
    classic = vlm & F.lit(prefer_classic) & (F.col("s_name") == "tesseract") & digits & (F.coalesce("s_conf", F.lit(0.0)) >= 0.75) & (agree.isNull() | (agree < 0.98))
    marks = lambda t: F.char_length(t) - F.char_length(F.regexp_replace(t, M.TASHKEEL, ""))
    swapped = rescued | classic
    invented = vlm & ~swapped & (marks(p) >= 3) & (marks(s) == 0)
    conf = F.when(classic, F.col("s_conf")).when(rescued, F.col("s_conf") * 0.85).otherwise(F.col("p_conf"))
    notes = F.array(
        F.when(rescued, F.concat(F.lit("primary engine returned no text; using "), F.col("s_engine"))),
        F.when(classic, "digit-heavy text: classic engine preferred over VLM"),
        F.when(invented, F.format_string("%d diacritics only in VLM output (possible hallucinated tashkeel)", marks(p))),
    )
    return (
        rows.withColumn("text", F.when(swapped, F.col("s_text")).otherwise(F.col("p_text")))
        .withColumn("source_engine", F.when(swapped, F.col("s_engine")).otherwise(F.col("p_engine")))
        .withColumn("engine_conf", F.when(invented, F.coalesce(conf, F.lit(0.0)) * 0.85).otherwise(conf))
        .withColumn("agree", agree)
        .withColumn("flags", F.concat(F.coalesce("flags", F.array().cast("array<string>")), F.array_compact(notes)))
    )


def scored(blocks: DataFrame, cfg: Confidence = Confidence()) -> DataFrame:
    """blocks with confidence, needs_review, review_reasons, lang and direction."""
    r = S.score_block(F.col("type"), F.col("text"), F.col("html"), F.col("engine_conf"), F.col("agree"), F.col("flags"), cfg)
    shown = F.coalesce("text", F.lit(""))
    return blocks.withColumn("_r", r).select(*blocks.columns, "_r.confidence", "_r.needs_review", "_r.review_reasons", T.language(shown).alias("lang"), T.direction(shown).alias("direction"))


def split_lines(blocks: DataFrame) -> DataFrame:
    """A block whose lines are numbers and dates, all but one at most, becomes a block for each line."""
    b, text = F.col("bbox"), _text(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: ~S.is_blank(x))
    kinds = F.transform(lines, lambda x: T.line_kind(x))
    known = F.size(F.filter(kinds, lambda k: k.isNotNull()))
    n = F.size(lines)
    apart = F.col("type").isin("paragraph", "header", "title") & (n >= 2) & (known >= 2) & (known >= n - 1)
    parts = F.when(apart, F.transform(lines, lambda x, k: F.struct(k.alias("k"), x.alias("line")))).otherwise(F.array(F.struct(F.lit(None).cast("int").alias("k"), F.col("text").alias("line"))))
    marked = blocks.withColumn("_n", n).withColumn("_part", F.explode(parts))
    k, line = F.col("_part.k"), F.col("_part.line")
    step = G.height(b) / F.col("_n")
    new = {
        "id": F.when(k.isNull(), F.col("id")).otherwise(F.concat(F.col("id"), F.lit("_"), k.cast("string"))),
        "type": F.when(k.isNull(), F.col("type")).otherwise(F.coalesce(T.line_kind(line), F.col("type"))),
        "text": line,
        "bbox": F.when(k.isNull(), b).otherwise(G.box(b.x0, b.y0 + k * step, b.x1, b.y0 + (k + 1) * step)),
    }
    if "alternatives" in blocks.columns:
        new["alternatives"] = F.when(k.isNull(), F.col("alternatives")).otherwise(F.slice("alternatives", 1, 0))
    return marked.select(*(new[c].alias(c) if c in new else F.col(c) for c in blocks.columns))


def positional_types(blocks: DataFrame, page: str = "doc_id") -> DataFrame:
    """Text beside the letterhead is header, at the very bottom footer; short centred lines are titles. page_w and page_h are columns."""
    b, W, H = F.col("bbox"), F.col("page_w"), F.col("page_h")
    top = F.max(F.when(F.col("type").isin("header", "logo") & (b.y1 < 0.22 * H), b.y1)).over(Window.partitionBy(page))
    free = F.col("type").isin("paragraph", "title") & (_text(F.col("text")) != "")
    first = F.when(free & top.isNotNull() & (G.center_y(b) < top) & (b.y1 < 0.22 * H), "header").when(free & (b.y0 > 0.93 * H), "footer").otherwise(F.col("type"))
    out = blocks.withColumn("type", first)
    t = F.regexp_replace(_text(F.col("text")), STRIP, "")
    centred = (F.abs(G.center_x(b) - W / 2) < 0.04 * W) & (G.width(b) < 0.6 * W)
    title = (F.col("type") == "paragraph") & (_text(F.col("text")) != "") & centred & ~t.contains("\n") & (F.char_length(t) <= 60) & ~t.rlike("[.،,:]$")
    return out.withColumn("type", F.when(title, "title").otherwise(F.col("type")))


def visual_align(b: Column, left: Column, right: Column, direction: Column) -> Column:
    w = right - left
    start = F.when(direction == "rtl", "right").otherwise("left")
    c = (G.center_x(b) - left) / w
    by_center = F.when(c < 0.38, "left").when(c > 0.62, "right").otherwise("center")
    return F.when((b.x1 > right - 0.05 * w) & (b.x0 < left + 0.05 * w), start).when(b.x1 > right - 0.06 * w, "right").when(b.x0 < left + 0.06 * w, "left").otherwise(by_center)


def justified(lines: Column) -> Column:
    """Three line boxes or more, and all but the last about equally wide."""
    widths = F.transform(lines, lambda b: b.x1 - b.x0)
    body = F.slice(widths, 1, F.size(lines) - 1)
    return (F.size(lines) >= 3) & (F.array_min(body) > 0.97 * F.array_max(body))


def styled(blocks: DataFrame, cfg: Docx = Docx(), page: str = "doc_id") -> DataFrame:
    """Sizes from line heights, brought to one size for body text; bold titles; alignment by the content's extent.

    In: page_w, width_mm, page_direction, line_height_px, lang, and lines (array of boxes, may be null).
    """
    w, b = Window.partitionBy(page), F.col("bbox")
    body = F.col("type").isin("paragraph", "title", "list", "table", "doc_number", "date")
    left = F.coalesce(F.min(F.when(body, b.x0)).over(w), 0.08 * F.col("page_w"))
    right = F.coalesce(F.max(F.when(body, b.x1)).over(w), 0.92 * F.col("page_w"))
    pt = F.col("line_height_px") / (F.col("page_w") / F.col("width_mm")) * 2.83465
    size = F.bround(pt * F.when(F.col("lang") == "en", cfg.line_height_to_pt_latin).otherwise(cfg.line_height_to_pt_ar) * 2) / 2
    out = blocks.withColumn("_left", left).withColumn("_right", right).withColumn("size_pt", F.when(F.col("line_height_px") > 0, size))
    sizes = F.array_sort(F.collect_list(F.when((F.col("type") == "paragraph") & (F.col("size_pt") > 0), F.col("size_pt"))).over(w))
    out = out.withColumn("_sizes", sizes).withColumn("_med", F.when(F.size("_sizes") > 0, F.get("_sizes", F.floor(F.size("_sizes") / 2).cast("int"))))
    s, med = F.col("size_pt"), F.col("_med")
    plain = F.col("type").isin("paragraph", "list", "doc_number", "date")
    s = F.when(med.isNull() | s.isNull(), s).when(plain & (F.abs(s - med) > 0.25 * med), med).when(F.col("type") == "title", F.least(F.greatest(s, med), med * 1.6)).otherwise(s)
    cw = F.greatest(F.lit(1.0), F.col("_right") - F.col("_left"))
    rel, centred = G.width(b) / cw, F.abs(G.center_x(b) - (F.col("_left") + F.col("_right")) / 2) < 0.04 * cw
    many = _text(F.col("text")).contains("\n")
    side = F.when(F.col("page_direction") == "rtl", "right").otherwise("left")
    align = (
        F.when(~F.col("type").isin(*M.TEXT_TYPES), visual_align(b, F.col("_left"), F.col("_right"), F.col("page_direction")))
        .when(centred & (rel < 0.85), "center")
        .when((rel > 0.9) & many, F.when(F.coalesce(justified(F.col("lines")), F.lit(False)), "justify").otherwise(side) if "lines" in blocks.columns else side)
        .otherwise(visual_align(b, F.col("_left"), F.col("_right"), F.col("page_direction")))
    )
    style = F.struct(align.alias("align"), s.alias("size_pt"), F.when(F.col("type") == "title", True).alias("bold"))
    return out.withColumn("style", style).drop("_left", "_right", "_sizes", "_med", "size_pt")


def page_directions(blocks: DataFrame, page: str = "doc_id", hint: str | None = None) -> DataFrame:
    """Direction of each page by its letters, letterhead and footers counting 0.3; ties are rtl; without letters the hint or rtl."""
    w = F.when(F.col("type").isin("header", "footer"), 0.3).otherwise(1.0)
    t = _text(F.col("text"))
    s = blocks.groupBy(page).agg(F.sum(T.count_rtl(t) * w).alias("r"), F.sum(T.count_latin(t) * w).alias("l"))
    return s.select(page, F.when(F.col("r") + F.col("l") == 0, hint or "rtl").when(F.col("r") >= F.col("l"), "rtl").otherwise("ltr").alias("page_direction"))


def with_page_direction(blocks: DataFrame, page: str = "doc_id", hint: str | None = None) -> DataFrame:
    """blocks with page_direction, as `page_directions` has it, by a window over the page."""
    w = F.when(F.col("type").isin("header", "footer"), 0.3).otherwise(1.0)
    t, over = _text(F.col("text")), Window.partitionBy(page)
    r, l = F.sum(T.count_rtl(t) * w).over(over), F.sum(T.count_latin(t) * w).over(over)
    return blocks.withColumn("_r", r).withColumn("_l", l).withColumn("page_direction", F.when(F.col("_r") + F.col("_l") == 0, hint or "rtl").when(F.col("_r") >= F.col("_l"), "rtl").otherwise("ltr")).drop("_r", "_l")


def _with_finds(blocks: DataFrame) -> DataFrame:
    """blocks with what metadata gathers of each; html_text is the text of a table's cells."""
    t = F.when(F.col("type") == "stamp", None).otherwise(F.coalesce(F.nullif(F.col("html_text"), F.lit("")), F.col("text")) if "html_text" in blocks.columns else F.col("text"))
    return blocks.withColumns({
        "_stamp": F.when((F.col("type") == "stamp") & (_text(F.col("text")) != ""), F.struct("text", F.col("id").alias("block_id"))),
        "_dates": T.dates(t, F.col("id")), "_numbers": T.doc_numbers(t, F.col("id"), F.col("type") == "doc_number"),
    })


def _metadata_aggregates() -> list[Column]:
    both = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order", "id", c))), lambda x: x[c]))
    return [
        both("_numbers").alias("doc_numbers"), both("_dates").alias("dates"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_stamp").isNotNull(), F.struct("order", "id", "_stamp")))), lambda x: x["_stamp"]).alias("stamp_texts"),
        F.array_sort(F.collect_set("lang")).alias("languages"),
    ]


def metadata(blocks: DataFrame, page: str = "doc_id") -> DataFrame:
    """Per page: stamp texts, languages, dates and document numbers, in reading order."""
    return _with_finds(blocks).groupBy(page).agg(*_metadata_aggregates())


def _review_aggregates(columns: list[str]) -> list[Column]:
    shown = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("html"), F.lit("")) if "html" in columns else _text(F.col("text"))
    counts = F.col("type").isin(*M.TEXT_TYPES, "table") & F.col("confidence").isNotNull()
    n = F.when(counts, F.greatest(F.lit(1), F.char_length(shown)))
    flagged = F.array_sort(F.collect_list(F.when(F.col("needs_review"), F.struct("order", F.concat("id", F.lit("("), "type", F.lit(")")).alias("s")))))
    return [F.sum(F.col("confidence") * n).alias("_t"), F.sum(n).alias("_n"), flagged.alias("_f")]


@F.arrow_udf(StringType())
def _two_places(x: pa.Array) -> pa.Array:
    """Two decimals of the exact binary value; the JVM's formats round its shortest decimal instead."""
    return pa.array([None if v is None else f"{v:.2f}" for v in x.to_pylist()], pa.string())


def _reviewed(per: DataFrame, cfg: Confidence) -> DataFrame:
    """page_score, needs_review and reasons from the aggregates and `warnings`."""
    score = F.coalesce(F.col("_t") / F.col("_n"), F.lit(0.0))
    severe = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w.rlike("|".join(M.SEVERE_QA)))
    listed = F.array_join(F.transform(F.slice("_f", 1, 12), lambda x: x.s), ", ")
    reasons = F.concat(
        F.array_compact(F.array(
            F.when(F.size("_f") > 0, F.concat(F.size("_f").cast("string"), F.lit(" block(s) need review: "), listed)),
            F.when(score < cfg.page_review_threshold, F.concat(F.lit("page score "), _two_places(score), F.lit(f" < {cfg.page_review_threshold}"))),
        )),
        F.transform(severe, lambda w: F.concat(F.lit("image quality: "), w)),
        F.array_compact(F.array(F.when(F.col("_n").isNull(), "no text recognized"))),
    )
    return per.withColumns({"page_score": F.bround(score, 4), "reasons": reasons}).withColumn("needs_review", F.size("reasons") > 0).drop("_t", "_n", "_f", "warnings")


def page_review(blocks: DataFrame, page: str = "doc_id", warnings: DataFrame | None = None, cfg: Confidence = Confidence()) -> DataFrame:
    """Per page: score (mean confidence by text length), needs_review and reasons."""
    per = blocks.groupBy(page).agg(*_review_aggregates(blocks.columns))
    per = per.join(warnings.select(page, "warnings"), page, "left") if warnings is not None else per.withColumn("warnings", F.array().cast("array<string>"))
    return _reviewed(per, cfg).select(page, "page_score", "needs_review", "reasons")


def summarised(blocks: DataFrame, pages: DataFrame, fields: list[str], page: str = "doc_id", cfg: Confidence = Confidence()) -> DataFrame:
    """pages with their nested blocks, metadata and review: one aggregate over the blocks. In: pages.qa."""
    nest = F.transform(F.array_sort(F.collect_list(F.struct(F.col("order").alias("_o"), F.col("id").alias("_i"), F.struct(*fields).alias("_b")))), lambda x: x["_b"])
    per = _with_finds(blocks).groupBy(page).agg(nest.alias("blocks"), F.first("page_direction").alias("page_direction"), *_metadata_aggregates(), *_review_aggregates(blocks.columns))
    return _reviewed(pages.join(per, page, "left").withColumn("warnings", F.col("qa.warnings")), cfg)


def partial_ratio(a: str, b: str) -> float:
    """100 times the best Indel similarity of the shorter text with any part of the longer one of its length, or less at the ends."""
    return best_part(a, b)[0] if len(a) <= len(b) else best_part(b, a)[0]


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    s = full = (1 << len(a)) - 1
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def best_part(short: str, long: str) -> tuple[float, int, int]:
    """(score, start, end) of the part of long most like short."""
    n, best = len(short), (0.0, 0, 0)
    if not n:
        return best
    for start in range(1 - n, len(long)):
        s, e = max(0, start), min(len(long), start + n)
        score = 200.0 * _common(short, long[s:e]) / (n + e - s)
        if score > best[0]:
            best = (score, s, e)
            if score == 100.0:
                break
    return best


def distinct_texts(boxes: list, types: list[str], texts: list[str]) -> list[int]:
    """Places of the blocks that stay: one goes when an overlapping block that stays has a longer text with (nearly) all of its own in it."""

    def share(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return w * h / max(1e-6, min((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b))) if w > 0 and h > 0 else 0.0

    gone: set[int] = set()
    for i, t in enumerate(texts):
        others = (j for j in range(len(texts)) if j != i and j not in gone and len(texts[j]) > len(t))
        if t and types[i] in M.TEXT_TYPES and any(share(boxes[i], boxes[j]) > 0.2 and partial_ratio(t, texts[j]) >= 90 for j in others):
            gone.add(i)
    return [i for i in range(len(texts)) if i not in gone]


def without_duplicates(blocks: DataFrame, page: str = "doc_id", tie: str = "id") -> DataFrame:
    """Blocks without those whose text is also in an overlapping block of longer text; page by page, as it depends on what went before."""
    fields = {"bbox": boxes(F.col("bbox")), "type": F.col("type"), "text": T.comparable(F.coalesce("text", F.lit("")))}
    return by_page(blocks, page, [tie], lambda b, t, s: [(i, 0) for i in distinct_texts(b, t, s)], fields, None)


def batch_report(results: DataFrame) -> DataFrame:
    """One row: pages, ok, failed, needs_review and the results by input. In: input, ok, needs_review, page_score, seconds, error."""
    return results.agg(
        F.count("*").alias("pages"), F.count_if(F.col("ok")).alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.coalesce("needs_review", F.lit(False))).alias("needs_review"),
    )
