"""Text expressions: scripts, language, direction, digits, dates, numbers, cleaning. Columns in, columns out."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from vellum import model as M

SPACE = r"(?U)\s+"
DATES = "array<struct<calendar:string,raw:string,normalized:string,block_id:string>>"


@F.arrow_udf(StringType())
def _nfc(s: pa.Array) -> pa.Array:
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in s.to_pylist()], pa.string())


def nfc(s: Column) -> Column:
    """Canonical composition."""
    return _nfc(s)


def strip_bidi(s: Column) -> Column:
    return F.regexp_replace(s, M.BIDI_CONTROLS, "")


def latin_digits(s: Column) -> Column:
    return F.translate(s, M.OTHER_DIGITS, M.LATIN_DIGITS)


def arabic_digits(s: Column) -> Column:
    return F.translate(s, M.LATIN_DIGITS[:10], M.OTHER_DIGITS[:10])


def strip_diacritics(s: Column) -> Column:
    return F.regexp_replace(s, f"{M.TASHKEEL}|{M.TATWEEL}", "")


def squeeze(s: Column, compose: bool = True) -> Column:
    """Composed, without bidi controls, white space collapsed and trimmed. compose=False stays in the JVM."""
    s = nfc(s) if compose else s
    return F.regexp_replace(F.regexp_replace(strip_bidi(s), SPACE, " "), r"^ | $", "")


def comparable(s: Column, drop_digits: bool | Column = False, compose: bool = True) -> Column:
    """What two engines' texts are compared by: no marks, punctuation or white space; Latin digits only on request."""
    s = strip_diacritics(strip_bidi(nfc(s) if compose else s))
    less = F.regexp_replace(s, "[0-9]", "")
    s = F.when(drop_digits, less).otherwise(s) if isinstance(drop_digits, Column) else less if drop_digits else s
    return F.regexp_replace(s, r"(?U)[\p{P}\s]", "")


def count_rtl(s: Column) -> Column:
    """Letters of right-to-left scripts. All of these are beyond U+058F, so what is below is passed over by one plain range."""
    return F.char_length(F.regexp_replace(s, rf"(?:[\x{{0}}-\x{{58f}}]++|[^{M.RTL_LETTERS}])++", ""))


def count_latin(s: Column) -> Column:
    return F.char_length(F.regexp_replace(s, "[^A-Za-z]++", ""))


def language_of(r: Column, l: Column) -> Column:
    """ar, en or mixed by numbers of letters; null where there are none."""
    n = r + l
    return F.when(n == 0, None).when(l <= 0.05 * n, "ar").when(r <= 0.05 * n, "en").otherwise("mixed")


def direction_of(r: Column, l: Column, default: str | Column = "rtl") -> Column:
    return F.when(r + l == 0, default if isinstance(default, Column) else F.lit(default)).when(r >= l, "rtl").otherwise("ltr")


def language(s: Column) -> Column:
    return language_of(F.coalesce(count_rtl(s), F.lit(0)), F.coalesce(count_latin(s), F.lit(0)))


def direction(s: Column, default: str | Column = "rtl") -> Column:
    return direction_of(F.coalesce(count_rtl(s), F.lit(0)), F.coalesce(count_latin(s), F.lit(0)), default)


def digit_share(s: Column) -> Column:
    """Digits among the characters that are not white space; 0 for none."""
    n = F.char_length(F.regexp_replace(s, r"(?U)\s", ""))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.char_length(F.regexp_replace(s, r"[^\p{Nd}\p{No}]", "")) / n)


def suspicious_latin(s: Column) -> Column:
    """Mostly Arabic text with a stray short Latin token."""
    r, l = count_rtl(s), count_latin(s)
    short = F.exists(F.regexp_extract_all(s, F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.char_length(w) <= 4)
    return F.coalesce((r > 10) & (l > 0) & short & (l < 0.25 * r), F.lit(False))


def calendar(year: Column, suffix: Column, hijri: str = "^(?:ه|ھ|A\\.H|AH|H)") -> Column:
    """From the suffix where there is one, else from the year; null where neither tells."""
    s = F.nullif(F.trim(suffix), F.lit(""))
    by_year = F.when(year.between(1300, 1500), "hijri").when(year.between(1800, 2200), "gregorian")
    return F.when(s.isNotNull(), F.when(s.rlike(hijri), "hijri").otherwise("gregorian")).otherwise(by_year)


def _all(s: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def _normal(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", y, m, d)


def _int(s: Column) -> Column:
    return latin_digits(s).cast("int")


def numeric_dates(s: Column, block_id: Column) -> Column:
    """Dates in figures: year first or last by which has four digits; months and days in range; unknown calendars left out."""
    p = "(?U)" + M.NUMERIC_DATE
    g = [_all(s, p, k) for k in range(5)]

    def one(raw, i):
        a, b, c, suffix = (F.get(x, i) for x in g[1:])
        first = F.char_length(a) == 4
        return F.struct(
            F.trim(raw).alias("raw"), F.when(first | (F.char_length(c) == 4), F.when(first, _int(a)).otherwise(_int(c))).alias("y"),
            _int(b).alias("m"), F.when(first, _int(c)).otherwise(_int(a)).alias("d"), suffix.alias("s"),
        )

    found = F.transform(g[0], one)
    found = F.filter(found, lambda x: x.y.isNotNull() & x.m.between(1, 12) & x.d.between(1, 31) & calendar(x.y, x.s).isNotNull())
    return F.transform(found, lambda x: F.struct(calendar(x.y, x.s).alias("calendar"), x.raw.alias("raw"), _normal(x.y, x.m, x.d).alias("normalized"), block_id.alias("block_id")))


def _months() -> Column:
    return F.create_map(*(F.lit(v) for k, n in {**M.HIJRI_MONTHS, **M.GREGORIAN_MONTHS}.items() for v in (k, n)))


def named_dates(s: Column, block_id: Column) -> Column:
    """Dates with a month's name; the name decides the calendar where it is a Hijri month."""
    p = "(?iuU)" + M.NAMED_DATE
    g = [_all(s, p, k) for k in range(5)]
    hijri = F.array(*(F.lit(k) for k in M.HIJRI_MONTHS))

    def one(raw, i):
        d, name, y, suffix = (F.get(x, i) for x in g[1:])
        key = F.when(name.rlike("^[ -~]*$"), F.lower(name)).otherwise(name)
        cal = F.when(F.array_contains(hijri, key), "hijri").otherwise(F.coalesce(calendar(_int(y), suffix), F.lit("gregorian")))
        return F.struct(cal.alias("calendar"), F.trim(raw).alias("raw"), _normal(_int(y), F.element_at(_months(), key), _int(d)).alias("normalized"), block_id.alias("block_id"))

    return F.transform(g[0], one)


def dates(s: Column, block_id: Column) -> Column:
    """All dates: those in figures, then those with names; repeats stay."""
    s = F.coalesce(s, F.lit(""))
    return F.concat(numeric_dates(s, block_id), named_dates(s, block_id))


def doc_numbers(s: Column, block_id: Column, own: Column) -> Column:
    p = "(?iuU)" + M.DOC_NUMBER
    s = F.coalesce(s, F.lit(""))
    value = _all(s, p, 2)
    return F.transform(
        _all(s, p, 0),
        lambda raw, i: F.struct(
            F.trim(raw).alias("raw"), F.get(value, i).alias("value"), latin_digits(F.get(value, i)).alias("value_latin"),
            F.when(own, "self").otherwise("reference").alias("role"), block_id.alias("block_id"),
        ),
    )


def has_date(s: Column, whole: bool = False) -> Column:
    a, z = ("^(?:", ")$") if whole else ("", "")
    return s.rlike(f"(?U){a}{M.NUMERIC_DATE}{z}") | s.rlike(f"(?iuU){a}{M.NAMED_DATE}{z}")


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def refined_type(kind: Column, text: Column) -> Column:
    """doc_number or date for short one-line blocks that read like one."""
    t = _strip(F.coalesce(text, F.lit("")))
    short = kind.isin("paragraph", "title", "header") & (t != "") & (F.char_length(t) <= 70) & ~t.contains("\n")
    number = t.rlike("(?iuU)^" + M.DOC_NUMBER) | t.rlike(rf"(?iuU)^\s*{M.NUMBER_KEY}\s*[:：]")
    date = (t.rlike("(?iuU)" + M.DATE_KEY) & has_date(t)) | has_date(t, whole=True)
    return F.when(short & number, "doc_number").when(short & date, "date").otherwise(kind)


def line_kind(line: Column) -> Column:
    t = _strip(line)
    short = (t != "") & (F.char_length(t) <= 70)
    number = t.rlike(rf"(?iuU)^\s*{M.NUMBER_KEY}\s*[:：]?") & t.rlike(M.DIGIT)
    return F.when(short & number, "doc_number").when(short & t.rlike("(?iuU)" + M.DATE_KEY) & has_date(t), "date")


LOOP = r"(?s)(.{6,40}?)(?:\s*\1){3,}"


def without_fences(s: Column) -> Column:
    return _strip(F.regexp_replace(_strip(s), r"(?s)^```[A-Za-z]*[ \t]*\n?|\n?```\s*$", ""))


def cleaned_output(raw: Column, region_type: Column) -> Column:
    """struct(text, flags) of a model's raw output: no fences or bidi controls, tables cut out, loops cut after the first copy."""
    s = without_fences(F.coalesce(raw, F.lit("")))
    table = region_type == "table"
    found = F.regexp_extract(s, r"(?is)(<table.*?</table>)", 1)
    body = F.when(table & (found != ""), found).otherwise(s)
    body = _strip(strip_bidi(body))
    cut = F.regexp_replace(body, LOOP + ".*", "$1")
    loops = body.rlike(LOOP) & ~table
    flags = F.array_compact(F.array(F.when(table & (found == ""), "no_html_table"), F.when(loops, "repetition_truncated")))
    return F.struct(F.when(loops, _strip(cut)).otherwise(body).alias("text"), flags.alias("flags"))


def prompt(region_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in M.PROMPTS.items() for x in kv)), region_type), F.lit(M.PROMPTS["text"]))


def adapter(adapters: Column, region_type: Column) -> Column:
    """An adapter for the exact type, else for the kind of writing."""
    return F.coalesce(F.element_at(adapters, region_type), F.element_at(adapters, F.when(region_type == "handwritten_note", "handwritten").otherwise("printed")))


RUNS = ArrayType(StructType([StructField("text", StringType()), StructField("direction", StringType())]))


class _Classes(dict):
    """Code point -> one letter: R (right-to-left letters and Arabic digits), L, E (European digits), M (marks) or N."""

    def __missing__(self, c: int) -> str:
        kind = unicodedata.bidirectional(chr(c))
        self[c] = v = {"R": "R", "AL": "R", "AN": "R", "L": "L", "EN": "E", "NSM": "M"}.get(kind, "N")
        return v


CLASSES = _Classes()
SAME = re.compile(r"(.)\1*")


def bidi_runs(text: str | None, base: str = "rtl") -> list[tuple[str, str]]:
    """Cut a text into runs of one direction: letters decide, European digits follow a left-to-right letter before
    them (else the base), marks follow what they stand on, and what is neutral takes the direction on both sides, else the base."""
    if not text:
        return []
    last, parts = None, []  # (start, direction or None), a part for each run of characters of one class
    for m in SAME.finditer(text.translate(CLASSES)):
        k = m.group(1)
        if k in "RL":
            last = d = "rtl" if k == "R" else "ltr"
        elif k == "E":
            d = "ltr" if last == "ltr" else base
        elif k == "M":
            d = (parts[-1][1] if parts else None) or base
        else:
            d = None
        parts.append((m.start(), d))
    out: list[list] = []
    for i, (start, d) in enumerate(parts):
        if d is None:
            before, after = (parts[i - 1][1] if i else None), (parts[i + 1][1] if i + 1 < len(parts) else None)
            d = before if before and before == after else base
        if not out or out[-1][1] != d:
            out.append([start, d])
    ends = [*(x[0] for x in out[1:]), len(text)]
    return [(text[a:z], d) for (a, d), z in zip(out, ends)]


@F.arrow_udf(RUNS)
def _runs(text: pa.Array, base: pa.Array) -> pa.Array:
    rows = [None if t is None else [{"text": s, "direction": d} for s, d in bidi_runs(t, b or "rtl")] for t, b in zip(text.to_pylist(), base.to_pylist())]
    return pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("direction", pa.string())])))


def bidi_run_array(text: Column, base: Column) -> Column:
    return _runs(text, base)
