"""Scores: agreement of engines, confidence, review reasons, error rates, budgets."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from vellum.config import Confidence, Vlm
from vellum.functions import text as T
from vellum.kernels.edits import distance
from vellum.model import UNREADABLE


@F.arrow_udf(IntegerType())
def edits(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of two texts of any length and script; null where one is null."""
    return pa.array([None if x is None or y is None else distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def agreement(a: Column, b: Column, drop_digits: bool | Column = False, compose: bool = True, edits: Callable = F.levenshtein) -> Column:
    """1 less the edit distance as a share of the longer text; 1 where nothing is left of both; null where one is null.

    edits: how edits are counted; the JVM's way suits blocks, `edits` of this module whole texts.
    """
    x, y = T.comparable(a, drop_digits, compose), T.comparable(b, drop_digits, compose)
    n = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(a.isNull() | b.isNull(), None).when(n == 0, 1.0).otherwise(1 - edits(x, y) / n)


def _clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def raw_block_score(kind: Column, text: Column, confidence: Column, agree: Column, cfg: Confidence = Confidence()) -> Column:
    base = F.coalesce(confidence, F.lit(0.5))
    s = F.when(agree.isNotNull(), cfg.w_engine * base + cfg.w_agreement * agree).otherwise(base)
    s = s - F.when(kind == "handwritten_note", cfg.handwritten_penalty).otherwise(0.0)
    s = s - F.least(F.lit(0.3), 0.05 * unreadable(text))
    s = F.when(is_blank(text), F.least(s, F.lit(0.2))).otherwise(s)
    return _clamp(s)


def unreadable(text: Column) -> Column:
    """How many words are marked as unreadable."""
    t = F.coalesce(text, F.lit(""))
    return (F.char_length(t) - F.char_length(F.replace(t, F.lit(UNREADABLE), F.lit("")))) / len(UNREADABLE)


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")


def score_block(kind: Column, text: Column, html: Column, confidence: Column, agree: Column, flags: Column, cfg: Confidence = Confidence()) -> Column:
    """struct(confidence, needs_review, review_reasons); the threshold is held against the score before rounding."""
    shown = F.coalesce(F.nullif(text, F.lit("")), html, F.lit(""))
    s, n = raw_block_score(kind, shown, confidence, agree, cfg), unreadable(shown).cast("int")
    below = s < cfg.block_review_threshold
    reasons = F.array(
        F.when(agree < 0.6, F.format_string("engines disagree (agreement %.2f)", agree)),
        F.when(kind == "handwritten_note", "handwritten"),
        F.when(n > 0, F.format_string(f"%d unreadable word(s) marked {UNREADABLE}", n)),
        F.when(is_blank(shown), "empty transcription"),
        F.when(below, F.format_string(f"confidence %.2f < {cfg.block_review_threshold}", s)),
    )
    return F.struct(
        F.bround(s, 4).alias("confidence"), (below | (kind == "handwritten_note") | (n > 0)).alias("needs_review"),
        F.concat(F.coalesce(flags, F.array().cast("array<string>")), F.array_compact(reasons)).alias("review_reasons"),
    )


def logprob_confidence(lps: Column) -> Column:
    """exp of the mean, less half the share of unlikely tokens; null for none."""
    n = F.size(lps)
    mean = F.aggregate(lps, F.lit(0.0), lambda a, x: a + x) / n
    weak = F.size(F.filter(lps, lambda x: x < F.log(F.lit(0.5)))) / n
    return F.when(n > 0, _clamp(F.exp(mean) - 0.5 * weak))


def mean_logprob(lps: Column) -> Column:
    return F.when(F.size(lps) > 0, F.aggregate(lps, F.lit(0.0), lambda a, x: a + x) / F.size(lps))


def token_budget(w: Column, h: Column, kind: Column, line_height: Column, cfg: Vlm = Vlm()) -> Column:
    """Tokens that a crop's text can need, by its size in lines and characters."""
    lh = F.coalesce(line_height, F.lit(40.0))
    lines, chars = F.greatest(F.lit(1.0), h / (1.25 * lh)), F.greatest(F.lit(4.0), w / (0.45 * lh))
    n = lines * chars * 0.55 * cfg.tokens_per_line_factor
    n = F.when(kind == "table", n * 3).otherwise(n) + 16
    return F.floor(_clamp(n, cfg.min_tokens, cfg.max_tokens)).cast("int")


def cer(ref: Column, hyp: Column) -> Column:
    """Edits over the length of the reference; may pass 1; an empty reference gives 0 or 1."""
    r, h = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    return F.when(r == "", F.when(h == "", 0.0).otherwise(1.0)).otherwise(edits(r, h) / F.char_length(r))


@F.arrow_udf(IntegerType())
def token_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Edit distance of two arrays of words; null where one is null."""
    return pa.array([None if x is None or y is None else distance(x, y) for x, y in zip(ref.to_pylist(), hyp.to_pylist())], pa.int32())


def wer(ref: Column, hyp: Column) -> Column:
    words = lambda s: F.filter(F.split(F.coalesce(s, F.lit("")), T.SPACE), lambda w: w != "")
    r, h = words(ref), words(hyp)
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(token_distance(r, h) / F.size(r))


def _tau(ranks: list) -> float | None:
    """By merging sorted halves: pairs in order, less pairs out of order, as a share of both."""
    x = [r for r in ranks if r is not None]
    out = 0  # pairs out of order
    width = 1
    while width < len(x):
        for lo in range(0, len(x), 2 * width):
            a, b = x[lo : lo + width], x[lo + width : lo + 2 * width]
            merged, i = [], 0
            for v in b:
                while i < len(a) and a[i] <= v:
                    merged.append(a[i])
                    i += 1
                out += len(a) - i
                merged.append(v)
            x[lo : lo + 2 * width] = merged + a[i:]
        width *= 2
    ties, run = 0, 1
    for i in range(1, len(x) + 1):
        if i < len(x) and x[i] == x[i - 1]:
            run += 1
        else:
            ties, run = ties + run * (run - 1) // 2, 1
    both = len(x) * (len(x) - 1) // 2 - ties
    return (both - 2 * out) / both if both else None


@F.arrow_udf(DoubleType())
def _taus(ranks: pa.Array) -> pa.Array:
    return pa.array([None if r is None else _tau(r) for r in ranks.to_pylist()], pa.float64())


def kendall_tau(ranks: Column) -> Column:
    """(concordant - discordant) / both over pairs of an array in its order; ties and nulls count for nothing; null without pairs."""
    return _taus(ranks.cast("array<double>"))


def clamp_size(size_pt: Column, least: float = 8.0, most: float = 28.0, default: float = 13.0) -> Column:
    return F.least(F.greatest(F.bround(F.coalesce(size_pt, F.lit(default)) * 2) / 2, F.lit(least)), F.lit(most))
