"""The document model: nested schema, closed vocabularies and fixed values."""

from __future__ import annotations

import sys
import unicodedata

SCHEMA_VERSION = "1.0.0"

# The model's vocabularies.
BLOCK_TYPES = ("title", "paragraph", "list", "table", "header", "footer", "doc_number", "date", "stamp", "signature", "logo", "figure", "handwritten_note")
TEXT_TYPES = ("title", "paragraph", "list", "header", "footer", "doc_number", "date", "handwritten_note")
IMAGE_TYPES = ("stamp", "signature", "logo", "figure")
DIRECTIONS = ("rtl", "ltr")
LANGS = ("ar", "en", "mixed")

# Characters and character classes.
UNREADABLE = "[؟]"
BIDI_CONTROLS = "[‎‏؜‪-‮⁦-⁩﻿]"
TASHKEEL = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
TATWEEL = "ـ"
DIGIT = "[0-9٠-٩۰-۹]"
OTHER_DIGITS, LATIN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"

# Months by name.
HIJRI_MONTHS = {
    "محرم": 1, "صفر": 2, "ربيع الأول": 3, "ربيع الاول": 3, "ربيع الآخر": 4, "ربيع الثاني": 4,
    "جمادى الأولى": 5, "جمادى الاولى": 5, "جمادى الآخرة": 6, "جمادى الثانية": 6, "رجب": 7, "شعبان": 8,
    "رمضان": 9, "شوال": 10, "ذو القعدة": 11, "ذي القعدة": 11, "ذو الحجة": 12, "ذي الحجة": 12,
}
GREGORIAN_MONTHS = {
    "يناير": 1, "فبراير": 2, "مارس": 3, "أبريل": 4, "ابريل": 4, "مايو": 5, "يونيو": 6, "يوليو": 7,
    "أغسطس": 8, "اغسطس": 8, "سبتمبر": 9, "أكتوبر": 10, "اكتوبر": 10, "نوفمبر": 11, "ديسمبر": 12,
    "كانون الثاني": 1, "شباط": 2, "آذار": 3, "نيسان": 4, "أيار": 5, "حزيران": 6, "تموز": 7, "آب": 8,
    "أيلول": 9, "تشرين الأول": 10, "تشرين الثاني": 11, "كانون الأول": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
}

# Patterns, in the JVM's dialect. Groups: (1 2 3) numbers and (4) suffix; (1) day (2) month (3) year (4) suffix; (1) key (2) value.
HIJRI_SUFFIX = r"(?:\s*(?:هـ|ه\b|ھ|AH\b|A\.H\.?|H\b))"
GREGORIAN_SUFFIX = r"(?:\s*(?:م\b|AD\b|A\.D\.?|CE\b))"
MONTH_NAMES = "|".join(sorted([*HIJRI_MONTHS, *GREGORIAN_MONTHS], key=len, reverse=True))
NUMERIC_DATE = rf"({DIGIT}{{1,4}})\s*[/\-\.]\s*({DIGIT}{{1,2}})\s*[/\-\.]\s*({DIGIT}{{1,4}})({HIJRI_SUFFIX}|{GREGORIAN_SUFFIX})?"
NAMED_DATE = rf"({DIGIT}{{1,2}})\s+(?:من\s+)?({MONTH_NAMES})\s*,?\s+({DIGIT}{{4}})({HIJRI_SUFFIX}|{GREGORIAN_SUFFIX})?"
NUMBER_KEY = r"(?:الرقم\s*الإشاري|الرقم|رقم\s*الكتاب|رقم\s*القيد|رقم|العدد|المرجع|الإشارة|Ref(?:erence)?\.?\s*(?:No\.?)?|Our\s+Ref\.?|No\.)"
DOC_NUMBER = rf"({NUMBER_KEY})\s*[:：\-]?\s*({DIGIT}[{DIGIT[1:-1]}A-Za-zء-ي/\\\-\.]*{DIGIT}|{DIGIT})"
DATE_KEY = r"^\s*(?:التاريخ|الموافق|تاريخ|بتاريخ|Date|Dated)\s*[:：]?"

# Detector label -> block type; anything else is a paragraph.
LABEL_MAP = {
    "text": "paragraph", "paragraph": "paragraph", "content": "paragraph", "abstract": "paragraph",
    "reference": "paragraph", "reference_content": "paragraph", "algorithm": "paragraph",
    "formula": "paragraph", "formula_number": "paragraph", "aside_text": "paragraph",
    "footnote": "footer", "vision_footnote": "footer",
    "doc_title": "title", "paragraph_title": "title", "title": "title",
    "figure_title": "paragraph", "table_title": "paragraph", "chart_title": "paragraph",
    "header": "header", "footer": "footer", "number": "footer",
    "table": "table", "image": "figure", "figure": "figure", "chart": "figure",
    "header_image": "logo", "footer_image": "figure", "seal": "stamp", "list": "list",
}

# Which of two overlapping regions counts for more.
PRIORITY = {"table": 5, "stamp": 4, "logo": 4, "figure": 3, "signature": 3, "header": 2, "footer": 2, "title": 2, "handwritten_note": 2, "paragraph": 1, "list": 1, "doc_number": 1, "date": 1}

# Page-level constants.
SEVERE_QA = ("blurry", "low resolution", "glare", "effective resolution")
PAPER_MM = {"A4": (210.0, 297.0), "Letter": (215.9, 279.4)}
EMU_PER_MM = 36000
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "heic", "heif", "tif", "tiff", "bmp", "webp")
MAX_UPLOAD = 40 * 1024 * 1024

# What is asked of a vision-language engine.
RULES = (
    "Rules: copy the text exactly as written in the image. Do not translate, correct, normalize, "
    "summarize or complete anything. Keep the original language and script (Arabic and/or English). "
    "Keep every digit in its original form: Arabic-Indic digits (٠١٢٣٤٥٦٧٨٩) stay Arabic-Indic, "
    "Latin digits (0123456789) stay Latin. Keep diacritics (tashkeel) only if they are visible. "
    "Keep line breaks. If a word cannot be read, write " + UNREADABLE + " instead of guessing."
)
PROMPTS = {
    "text": "Transcribe the text in this image. " + RULES + " Output only the transcription.",
    "handwritten_note": "This image contains handwritten text. Transcribe it. " + RULES + " Output only the transcription.",
    "table": (
        "Convert this table to HTML. Use only <table>, <tr>, <th>, <td>. Use rowspan and colspan for merged cells. "
        "Within each row list cells in reading order (for Arabic right-to-left tables the rightmost cell comes first). "
        "Use <th> for header cells. " + RULES + " Output only the HTML table."
    ),
    "stamp": "Read the text printed on this stamp/seal. " + RULES + " Output only the text.",
}

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK = (
    f"struct<id:string,type:string,bbox:{BOX},`order`:int,text:string,html:string,image_path:string,lang:string,direction:string,"
    "style:struct<align:string,size_pt:double,bold:boolean>,confidence:double,source_engine:string,layout_source:string,layout_score:double,"
    "alternatives:array<struct<engine:string,text:string,html:string,confidence:double,mean_logprob:double,seconds:double>>,"
    "needs_review:boolean,review_reasons:array<string>,line_height_px:double>"
)
DOCUMENT = (
    "schema_version string, source struct<path:string,sha256:string,width_px:int,height_px:int>,"
    "page struct<width_px:int,height_px:int,width_mm:double,height_mm:double,dpi:double,direction:string,rotation_applied:int,paper:string>,"
    f"blocks array<{BLOCK}>,"
    "metadata struct<doc_numbers:array<struct<raw:string,value:string,value_latin:string,role:string,block_id:string>>,"
    "dates:array<struct<calendar:string,raw:string,normalized:string,block_id:string>>,stamp_texts:array<struct<text:string,block_id:string>>,"
    "languages:array<string>,extra:map<string,string>>,"
    "qa struct<width_px:int,height_px:int,blur_laplacian_var:double,glare_ratio:double,document_coverage:double,estimated_dpi:double,boundary_found:boolean,warnings:array<string>>,"
    "review struct<page_score:double,needs_review:boolean,reasons:array<string>>,timings_s map<string,double>,engines map<string,string>,config_digest string"
)
TRUTH = (
    "id string, direction string, lang string, width_px int, height_px int, dpi int,"
    "blocks array<struct<id:string,type:string,lang:string,bbox:array<double>,text:string,html:string,align:string,size_pt:double,bold:boolean>>,"
    "augment struct<level:string,curve_amp_px:double,corners:array<array<double>>,blur_sigma:double,jpeg_q:int,scale:double>, image string"
)


def _ranges(holds) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if holds(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return [tuple(x) for x in out]


def _char_class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


#: Inside of a character class: letters of right-to-left scripts, by rule from the Unicode tables.
RTL_LETTERS = _char_class(_ranges(lambda c: unicodedata.bidirectional(c) in ("R", "AL") and c.isalpha()))
