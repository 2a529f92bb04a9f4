"""Word-processing output: a document as an editable .docx, written with the standard library alone.

`build` makes one file's bytes; `docx_column` is the Arrow UDF over documents as JSON; `DocxSource`
is a Spark data source (`format("docx")`) whose writer puts a file for each row (name, content).
"""

from __future__ import annotations

import io
import json
import os
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType

from vellum.config import Docx
from vellum.functions.text import bidi_runs
from vellum.model import EMU_PER_MM, IMAGE_TYPES, TEXT_TYPES
from vellum.operators.tables import grid

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
NS = (
    f'xmlns:w="{W}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
)
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


class _Part:
    """A part of the package with its own relations."""

    def __init__(self, package: _Package):
        self.package, self.xml, self.rels = package, [], []

    def relate(self, kind: str, target: str) -> str:
        self.rels.append((f"rId{len(self.rels) + 1}", kind, target))
        return self.rels[-1][0]

    def relations(self) -> str:
        return HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"/>' for i, k, t in self.rels) + "</Relationships>"


class _Package:
    def __init__(self, cfg: Docx, images: dict[str, bytes]):
        self.cfg, self.images = cfg, images
        self.media: dict[str, str] = {}
        self.comments: list[str] = []
        self.drawings = 0

    def image(self, part: _Part, path: str) -> str | None:
        data = self.images.get(path)
        if data is None:
            return None
        name = self.media.setdefault(path, f"media/image{len(self.media) + 1}.png")
        return part.relate("image", name)


def size_of(b: dict, cfg: Docx) -> float:
    s = (b.get("style") or {}).get("size_pt") or cfg.default_size_pt
    return min(max(round(s * 2) / 2, cfg.min_size_pt), cfg.max_size_pt)


def _low(b: dict, cfg: Docx) -> bool:
    return b.get("confidence") is not None and b["confidence"] < cfg.low_confidence_threshold


def _run_props(cfg: Docx, pt: float, rtl: bool, bold: bool = False, highlight: bool = False) -> str:
    half = int(round(pt * 2))
    f = f'<w:rFonts w:ascii="{cfg.font_latin}" w:hAnsi="{cfg.font_latin}" w:eastAsia="{cfg.font_latin}" w:cs="{cfg.font_arabic}"/>'
    return f'<w:rPr>{f}{"<w:b/><w:bCs/>" if bold else ""}<w:sz w:val="{half}"/><w:szCs w:val="{half}"/>{"<w:highlight w:val=%s/>" % quoteattr("yellow") if highlight else ""}{"<w:rtl/>" if rtl else ""}<w:lang w:val="en-US" w:bidi="ar-SA"/></w:rPr>'


def runs(text: str, base: str, cfg: Docx, pt: float, bold: bool = False, highlight: bool = False) -> str:
    """Runs of one direction each; lines are parted by breaks."""
    out = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("<w:r><w:br/></w:r>")
        for s, d in bidi_runs(line, base):
            out.append(f'<w:r>{_run_props(cfg, pt, d == "rtl", bold, highlight)}<w:t xml:space="preserve">{escape(s)}</w:t></w:r>')
    return "".join(out)


def _paragraph_props(rtl: bool, align: str | None, before: float = 0, after: float = 4) -> str:
    """Alignment is what the eye sees; in right-to-left paragraphs start and end are swapped in the file."""
    jc = {"left": "right" if rtl else "left", "right": "left" if rtl else "right", "center": "center", "justify": "both"}.get(align or "")
    return f'<w:pPr><w:bidi w:val="{1 if rtl else 0}"/><w:spacing w:before="{int(before * 20)}" w:after="{int(after * 20)}"/>{f"<w:jc w:val=%s/>" % quoteattr(jc) if jc else ""}</w:pPr>'


def paragraph(pk: _Package, b: dict, base: str, before: float = 0, align: str | None = None) -> str:
    cfg = pk.cfg
    rtl = (b.get("direction") or base) == "rtl"
    style = b.get("style") or {}
    align = align or style.get("align")
    text = b.get("text") or ""
    if align != "center":
        text = " ".join(x.strip() for x in text.split("\n") if x.strip())
    low = _low(b, cfg)
    body = runs(text, "rtl" if rtl else "ltr", cfg, size_of(b, cfg), bool(style.get("bold")), low and cfg.highlight_low_confidence)
    if low and cfg.comment_low_confidence:
        n = len(pk.comments)
        why = "; ".join(b.get("review_reasons") or []) or f"confidence {b['confidence']:.2f}"
        pk.comments.append(f'<w:comment w:id="{n}" w:author="review" w:initials="r"><w:p><w:r><w:t xml:space="preserve">{escape(why)}</w:t></w:r></w:p></w:comment>')
        body = f'<w:commentRangeStart w:id="{n}"/>{body}<w:commentRangeEnd w:id="{n}"/><w:r><w:commentReference w:id="{n}"/></w:r>'
    return f"<w:p>{_paragraph_props(rtl, align, before)}{body}</w:p>"


def table(pk: _Package, b: dict, rtl: bool) -> str:
    cells, n, m = grid(b.get("html"))
    at = {(c.row + i, c.col + j): (c, i, j) for c in cells for i in range(c.rowspan) for j in range(c.colspan)}
    edges = "".join(f'<w:{s} w:val="single" w:sz="4" w:space="0" w:color="000000"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
    out = [f'<w:tbl><w:tblPr>{"<w:bidiVisual/>" if rtl else ""}<w:tblW w:w="5000" w:type="pct"/><w:tblBorders>{edges}</w:tblBorders></w:tblPr><w:tblGrid>{"<w:gridCol/>" * m}</w:tblGrid>']
    for r in range(n):
        out.append("<w:tr>")
        c = 0
        while c < m:
            cell, i, _ = at.get((r, c), (None, 0, 0))
            span = cell.colspan if cell else 1
            props = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + (('<w:vMerge w:val="restart"/>' if i == 0 else "<w:vMerge/>") if cell and cell.rowspan > 1 else "")
            shade = '<w:shd w:val="clear" w:color="auto" w:fill="E7E6E6"/>' if cell and cell.header else ""
            text = cell.text if cell and i == 0 else ""
            body = runs(text, "rtl" if rtl else "ltr", pk.cfg, size_of(b, pk.cfg), bool(cell and cell.header))
            out.append(f"<w:tc><w:tcPr>{props}{shade}</w:tcPr><w:p>{_paragraph_props(rtl, None, 0, 0)}{body}</w:p></w:tc>")
            c += span
        out.append("</w:tr>")
    return "".join(out) + "</w:tbl>"


def picture(pk: _Package, part: _Part, b: dict, px_per_mm: float, most_mm: float, floating: bool = False) -> str:
    """A run with a picture, in line or at its place on the page behind the text."""
    rid = pk.image(part, b.get("image_path") or "")
    if rid is None:
        return ""
    box = b["bbox"]
    w, h = (box["x1"] - box["x0"]) / px_per_mm, (box["y1"] - box["y0"]) / px_per_mm
    k = min(max(w, 8.0), most_mm) / max(w, 1e-6)
    cx, cy = int(w * k * EMU_PER_MM), int(h * k * EMU_PER_MM)
    pk.drawings += 1
    name = f'<wp:docPr id="{pk.drawings}" name="picture {pk.drawings}"/>'
    graphic = (
        '<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic><pic:nvPicPr>'
        f'<pic:cNvPr id="{pk.drawings}" name="p"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{rid}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
        f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic>'
    )
    if not floating:
        return f'<w:r><w:drawing><wp:inline distT="0" distB="0" distL="0" distR="0"><wp:extent cx="{cx}" cy="{cy}"/>{name}{graphic}</wp:inline></w:drawing></w:r>'
    x, y = (int(v / px_per_mm * EMU_PER_MM) for v in (box["x0"], box["y0"]))
    place = "".join(f'<wp:position{a} relativeFrom="page"><wp:posOffset>{v}</wp:posOffset></wp:position{a}>' for a, v in (("H", x), ("V", y)))
    return (
        '<w:r><w:drawing><wp:anchor distT="0" distB="0" distL="0" distR="0" simplePos="0" relativeHeight="1" behindDoc="1" locked="0" layoutInCell="1" allowOverlap="1">'
        f'<wp:simplePos x="0" y="0"/>{place}<wp:extent cx="{cx}" cy="{cy}"/><wp:effectExtent l="0" t="0" r="0" b="0"/><wp:wrapNone/>{name}<wp:cNvGraphicFramePr/>{graphic}</wp:anchor></w:drawing></w:r>'
    )


def band(pk: _Package, part: _Part, blocks: list[dict], page: dict, px_per_mm: float, rtl: bool) -> str:
    """Letterhead or footer: a row of three cells; the first cell is the first in reading direction."""
    cols: dict[str, list[dict]] = {"left": [], "center": [], "right": []}
    for b in sorted(blocks, key=lambda b: b["bbox"]["y0"]):
        c = (b["bbox"]["x0"] + b["bbox"]["x1"]) / 2 / page["width_px"]
        cols["left" if c < 0.36 else "right" if c > 0.64 else "center"].append(b)
    out = [f'<w:tbl><w:tblPr>{"<w:bidiVisual/>" if rtl else ""}<w:tblW w:w="5000" w:type="pct"/></w:tblPr><w:tblGrid><w:gridCol/><w:gridCol/><w:gridCol/></w:tblGrid><w:tr>']
    for name in ("right", "center", "left") if rtl else ("left", "center", "right"):
        body = ""
        for b in cols[name]:
            if b["type"] in IMAGE_TYPES:
                body += f"<w:p>{_paragraph_props(rtl, name, 0, 0)}{picture(pk, part, b, px_per_mm, 60.0)}</w:p>"
            else:
                body += paragraph(pk, b, "rtl" if rtl else "ltr", align=name)
        out.append(f"<w:tc><w:tcPr/>{body or '<w:p/>'}</w:tc>")
    return "".join(out) + "</w:tr></w:tbl><w:p/>"


def build(doc: dict, images: dict[str, bytes] | None = None, cfg: Docx = Docx()) -> bytes:
    """A document (as its JSON) as the bytes of a .docx; images by image_path."""
    pk = _Package(cfg, images or {} if cfg.insert_images else {})
    page, rtl = doc["page"], doc["page"].get("direction") != "ltr"
    base = "rtl" if rtl else "ltr"
    k = page["width_px"] / page["width_mm"]
    H = page["height_px"]
    blocks = sorted(doc.get("blocks") or [], key=lambda b: b["order"])
    mid = lambda b: (b["bbox"]["y0"] + b["bbox"]["y1"]) / 2
    tops = [b for b in blocks if b["type"] == "header" or b["type"] == "logo" and mid(b) < 0.2 * H]
    feet = [b for b in blocks if b["type"] == "footer"]
    body = [b for b in blocks if b not in tops and b not in feet]
    main, header, footer = _Part(pk), _Part(pk), _Part(pk)
    wide = [b["bbox"] for b in body if b["type"] in TEXT_TYPES or b["type"] == "table"] or [{"x0": 0.1 * page["width_px"], "x1": 0.9 * page["width_px"]}]
    mm = lambda v: min(30.0, max(12.0, v))
    left, right = mm(min(b["x0"] for b in wide) / k), mm((page["width_px"] - max(b["x1"] for b in wide)) / k)
    room = page["width_mm"] - left - right
    bottom, out = None, []
    for b in body:
        floats = b["type"] == "stamp" and cfg.stamp_floating
        gap = 0.0 if bottom is None or floats else min(30.0, max(0.0, (b["bbox"]["y0"] - bottom) / k * 2.83465 * 0.6))
        if b["type"] == "table":
            out.append(table(pk, b, (b.get("direction") or base) == "rtl") + "<w:p/>")
        elif b["type"] in IMAGE_TYPES:
            run = picture(pk, main, b, k, 0.9 * room, floats)
            out.append(f"<w:p>{_paragraph_props(rtl, (b.get('style') or {}).get('align'), gap, 0 if floats else 4)}{run}</w:p>" if run else "")
        elif b.get("text"):
            out.append(paragraph(pk, b, base, gap))
        if not floats:
            bottom = b["bbox"]["y1"]
    refs = ""
    for part, name, members in ((header, "header", tops), (footer, "footer", feet)):
        if members:
            part.xml = band(pk, part, members, page, k, rtl)
            refs += f'<w:{name}Reference w:type="default" r:id="{main.relate(name, f"{name}1.xml")}"/>'
    main.relate("styles", "styles.xml")
    if pk.comments:
        main.relate("comments", "comments.xml")
    twips = lambda v: int(v * 56.6929)
    section = (
        f'<w:sectPr>{refs}<w:pgSz w:w="{twips(page["width_mm"])}" w:h="{twips(page["height_mm"])}"/>'
        f'<w:pgMar w:top="{twips(15)}" w:right="{twips(right)}" w:bottom="{twips(15)}" w:left="{twips(left)}" w:header="400" w:footer="400" w:gutter="0"/>{"<w:bidi/>" if rtl else ""}</w:sectPr>'
    )
    half = int(cfg.default_size_pt * 2)
    styles = (
        f'<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="{cfg.font_latin}" w:hAnsi="{cfg.font_latin}" w:cs="{cfg.font_arabic}"/><w:sz w:val="{half}"/><w:szCs w:val="{half}"/></w:rPr></w:rPrDefault></w:docDefaults>'
        f'<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/>{"<w:pPr><w:bidi/></w:pPr>" if rtl else ""}</w:style></w:styles>'
    )
    parts = {
        "word/document.xml": f"<w:document {NS}><w:body>{''.join(out)}{section}</w:body></w:document>",
        "word/styles.xml": styles,
        **({"word/header1.xml": f"<w:hdr {NS}>{header.xml}</w:hdr>"} if tops else {}),
        **({"word/footer1.xml": f"<w:ftr {NS}>{footer.xml}</w:ftr>"} if feet else {}),
        **({"word/comments.xml": f"<w:comments {NS}>{''.join(pk.comments)}</w:comments>"} if pk.comments else {}),
    }
    kinds = {"document": "document.main", "styles": "styles", "header1": "header", "footer1": "footer", "comments": "comments"}
    types = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{kinds[p[5:-4]]}+xml"/>' for p in parts)
    types = f'{HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="png" ContentType="image/png"/>{types}</Types>'
    root = f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="word/document.xml"/></Relationships>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda n, d: z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), d)  # noqa: E731  equal input, equal bytes
        put("[Content_Types].xml", types)
        put("_rels/.rels", root)
        for p, xml in parts.items():
            put(p, HEAD + xml)
        for part, p in ((main, "document"), (header, "header1"), (footer, "footer1")):
            if part.rels:
                put(f"word/_rels/{p}.xml.rels", part.relations())
        for path, name in pk.media.items():
            put(f"word/{name}", pk.images[path])
    return buf.getvalue()


@F.arrow_udf(BinaryType())
def _docx(docs: pa.Array, images: pa.Array) -> pa.Array:
    return pa.array([None if d is None else build(json.loads(d), dict(i or ())) for d, i in zip(docs.to_pylist(), images.to_pylist())], pa.binary())


def docx_column(document_json: Column, images: Column | None = None) -> Column:
    """images: map of image_path to PNG bytes."""
    return _docx(document_json, F.lit(None).cast("map<string,binary>") if images is None else images)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def write(self, rows):
        for r in rows:
            parts = [x for x in r["name"].split("/") if x not in ("", ".", "..")]  # stays inside of the folder
            at = os.path.join(self.path, *parts) + self.suffix
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at + ".part", "wb") as f:
                f.write(bytes(r["content"]))
            os.replace(at + ".part", at)  # a task that runs again writes the same file
        return WriterCommitMessage()


class FileSource(DataSource):
    """format("files"): rows of (name, content) as files in a folder that all executors share; names may have folders."""

    suffix = ""

    @classmethod
    def name(cls):
        return "files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.suffix)


class DocxSource(FileSource):
    """format("docx"): the same, with the suffix .docx."""

    suffix = ".docx"

    @classmethod
    def name(cls):
        return "docx"
