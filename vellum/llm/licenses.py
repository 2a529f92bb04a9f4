"""License scans: fuzzy search for short notices, with exact phrase search beside it.

A text becomes its words (runs of ASCII digits and letters, A-Z lower-cased, and of any non-ASCII
characters) joined by single spaces. A notice of `edits` allowed errors is cut into edits + 1
pieces; whatever matches with at most that many errors holds one piece unchanged (pigeonhole), so
one automaton over all pieces finds every place where a match can be. Around each such place the
regex library's bounded-error matching decides and gives the span and the number of edits. NOTICES
is what is searched for by default; `scan` takes any other list, of any length.

Defined results: a null or empty text has no words, no places and score 0; of matches of a label
that overlap the one with the fewest edits counts, then the first; repeated rows are scanned separately.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vellum.llm._rt import ready

# The exact phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices for the fuzzy search, with their labels: lines of public licences, their headers and short names.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the above copyright notice and this permission notice shall be included in all copies": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license version 2 0": "mpl-2.0",
    "subject to the terms of the mozilla public license": "mpl-2.0",
    "eclipse public license version 2 0": "epl-2.0",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license version 1 0": "bsl-1.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under the sil open font license": "ofl-1.1",
    "creative commons attribution": "cc-by",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero universal public domain dedication": "cc0",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
    "copyright all rights are reserved by the author": "reserved",
    "no part of this publication may be reproduced": "reserved",
    "proprietary and confidential": "proprietary",
}
OTHER = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Scanner:
    """share: allowed edits as a share of a notice's length, at least one."""

    def __init__(self, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE, share: float = 0.1):
        self.notices = [(p, label, max(1, int(len(p) * share))) for p, label in notices.items()]
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(p, special_only=True)}){{e<={k}}}") for p, _, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (p, _, k) in enumerate(self.notices):
            cut = [len(p) * j // (k + 1) for j in range(k + 2)]
            for s, e in zip(cut, cut[1:]):
                found.setdefault(p[s:e], []).append((i, s))
        for piece, at in found.items():
            self.seeds.add_word(piece, (len(piece), at))
        self.seeds.make_automaton()

    def normal(self, text: str | None) -> bytes:
        words = (text or "").encode().lower().translate(OTHER).split()
        return b" " + b" ".join(words) + b" " if words else b""

    def exact(self, data: bytes) -> list[tuple[int, str]]:
        """(word, label) of each place of a base phrase."""
        out = []
        for p, label in self.base:
            at = data.find(p)
            while at >= 0:
                out.append((at, label))
                at = data.find(p, at + 1)
        return sorted(zip(_numbers(data, [at for at, _ in out]), (label for _, label in out))) if out else out

    def matches(self, s: str) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, words, edits, similarity) of each fuzzy match, found over the whole text.

        Every seed gives a window of its own, just large enough for a match around it; of matches of
        a label that overlap, the one with the fewest edits stays, then the first.
        """
        windows = set()
        for end, (n, where) in self.seeds.iter(s):
            for i, at in where:
                p, _, k = self.notices[i]
                lo = end + 1 - n - at - k
                windows.add((i, max(0, lo), min(len(s), lo + len(p) + 2 * k)))
        found: dict[str, set[tuple[int, int, int, int]]] = {}
        for i, lo, hi in windows:
            p, label, k = self.notices[i]
            if hi - lo < len(p) - k or k > 1 and not _letters(p, s[lo:hi], k):
                continue  # with few of the letters of a notice there is no match
            m = self.fuzzy[i].search(s, lo, hi)
            if m:
                text = m.group()
                a, b = m.start() + len(text) - len(text.lstrip()), m.end() - len(text) + len(text.rstrip())
                if b > a:
                    found.setdefault(label, set()).add((sum(m.fuzzy_counts), a, b, i))
        kept = []
        for spans in found.values():
            starts: list[int] = []
            own: list[tuple[int, int]] = []
            for edits, a, b, i in sorted(spans):
                at = bisect.bisect_left(starts, b)  # spans that stay do not overlap, so only the last that begins before b could
                if at and own[at - 1][1] > a:
                    continue
                starts.insert(at, a)
                own.insert(at, (a, b))
                kept.append((i, a, b, edits))
        if not kept:
            return []
        first = _numbers(s, [a for _, a, _, _ in kept])
        return sorted((self.notices[i][1], w, s.count(" ", a, b) + 1, e, 1 - e / len(self.notices[i][0])) for w, (i, a, b, e) in zip(first, kept))

    def scan(self, text: str | None) -> dict:
        data = self.normal(text)
        base = self.exact(data) if data else []
        fuzzy = self.matches(data.decode()) if data else []
        return {
            "n_words": data.count(b" ") - 1 if data else 0,
            "n_base": len(base),
            "first_word": base[0][0] if base else None,
            "last_word": base[-1][0] if base else None,
            "base_labels": ",".join(sorted({x for _, x in base})),
            "labels": ",".join(sorted({x for _, x in base} | {x[0] for x in fuzzy})),
            "score": max([1.0 if base else 0.0, *(x[4] for x in fuzzy)]),
            "spans": [{"label": a, "first_word": b, "n_words": c, "edits": d} for a, b, c, d, _ in fuzzy],
        }


def _numbers(text: str | bytes, places: list[int]) -> list[int]:
    """The number of the word at, or after the space at, each place of a text that begins with a space; in one pass over the text."""
    space, before, out = (b" " if isinstance(text, bytes) else " "), {}, 0
    last = 0
    for at in sorted(set(places)):
        out += text.count(space, last, at + 1)
        before[at], last = out - 1, at + 1
    return [before[at] for at in places]


def _letters(p: str, window: str, k: int) -> bool:
    """A match with at most k edits keeps all but k characters of the notice: those must be in the window, often enough."""
    return sum(max(0, p.count(c) - window.count(c)) for c in set(p)) <= k


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,edits:int>>"
ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])))])


def scan(documents: DataFrame, notices: dict[str, str] = NOTICES, share: float = 0.1) -> DataFrame:
    """One row per document with counts, labels, score and the spans of the fuzzy matches (in words)."""
    ready(documents.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]):
        scanner = Scanner(notices, share=share)
        for b in batches:
            rows = [{"doc_id": d, **scanner.scan(t)} for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
