"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts and items become words (runs of ASCII letters and digits, lower-cased, and of non-ASCII
characters) joined by single spaces. The embedding walks over characters: step j gives out the
character it stands on, and moves on by one or stays, as a random bit of (j, character) says. Edits
become differing outputs, and a walk that was thrown off falls into step again soon. A repetition
samples some of the outputs into one signature.

An item's window is embedded piecewise: a walk starts at every character of the item, so that an
edit only throws off the walks that pass it. (One walk over the whole of an item, sampled as a whole,
needs thousands of repetitions where a fifth of the characters are edited: hardly any sample is then
left unharmed.) A text is walked from every character as well. Shared signatures give an item and
where it would begin in the text. How long the walks are goes by the item's size; how many
repetitions there are is decided when the index is built: items edited at random, up to `share`, are
searched, and repetitions are added until `recall` of them are found.

All walks over a batch of texts run backwards at once: what a walk collects from step j on at
character p is what it gives out at p plus what it collects from step j + 1 on at p or p + 1, one
selection per step.

A place is first held against the 64 characters of the item around the shared signature, by
bit-parallel edit distance over all places of a batch at once; what is within twice the share there
is verified by the edit distance of the whole item to any part of its surroundings in the text.

Items go in blocks of at most `block_chars` characters, each an index of bounded size that is sent to
tasks; a task that has several blocks holds one at a time, and goes through them for each run of texts.

Defined results: items without words never match; null and empty texts have no matches; several
items, places and repeated rows are all reported; an item of any size matches itself; items of fewer
than 16 characters match whole words only; the first places of an item that overlap are one match.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._rt import begin, holds, ready

OTHER = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = 1 << 14
CLASSES = ((64, 28, 13), (40, 24, 10), (24, 16, 8), (12, 10, 6), (6, 6, 5), (3, 3, 3), (1, 1, 1))  # bytes of an item from which on its walks have so many steps, and samples of them
WHOLE_WORDS = 16
WORD = 64  # characters that are compared at once
DRIFT = 8  # characters by which a place may shift within those
# signs of the comparison: letters, digits and the space differ from each other; other bytes share the rest, which can only lower a distance
SIGN = np.array([c - 97 if 97 <= c <= 122 else 26 + c - 48 if 48 <= c <= 57 else 36 if c == 32 else 37 + c % 27 for c in range(256)], np.uint8)


def normal(text: str | None) -> bytes:
    """ASCII letters and digits, lower-cased, and other characters as they are; anything between is one space."""
    return b" ".join((text or "").encode().lower().translate(OTHER).split())


def words(text: str | None) -> list[bytes]:
    return normal(text).split()


class Walk:
    """One repetition: `steps` random moves and the outputs that are sampled."""

    def __init__(self, steps: int, samples: int, seed: int):
        r = np.random.default_rng([steps, seed])
        self.moves = r.integers(0, 2**32, 256, dtype=np.uint32).view(np.int32)  # the bit j places below the sign is the move of step j
        self.values = r.integers(0, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.mix = r.integers(0, 2**31, steps, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.sampled = np.zeros(steps, bool)
        self.sampled[r.permutation(steps)[:samples]] = True
        self.steps = steps

    def signatures(self, x: np.ndarray) -> np.ndarray:
        """The signature of the walk from every byte on."""
        out = np.empty(len(x), np.uint32)
        for lo in range(0, len(x), BLOCK):  # small enough for the processor's cache; a walk from a block ends at most `steps` bytes after it
            part = x[lo : lo + BLOCK + self.steps]
            moves, values = self.moves[part], self.values[part]
            sig, go, new = np.zeros(len(part) + 1, np.uint32), np.empty(len(part), np.int32), np.empty(len(part), np.uint32)
            here, after = sig[:-1], sig[1:]
            for j in range(self.steps - 1, -1, -1):
                np.left_shift(moves, j, out=go)
                np.right_shift(go, 31, out=go)  # all ones where the walk moves on
                np.bitwise_xor(here, after, out=new)
                np.bitwise_and(new, go.view(np.uint32), out=new)
                np.bitwise_xor(here, new, out=here)
                if self.sampled[j]:
                    np.multiply(values, self.mix[j], out=new)
                    np.add(here, new, out=here)
            out[lo : lo + BLOCK] = sig[: min(BLOCK, len(part))]
        return out


class Table:
    """Signatures of one repetition over the windows of some items."""

    def __init__(self, walk: Walk, items: list[tuple[int, bytes]]):
        sig, item, at = [], [], []
        for i, data in items:
            n = max(1, len(data) - walk.steps // 2 + 1)  # a walk moves at every other step or so
            sig.append(walk.signatures(np.frombuffer(data, np.uint8))[:n])
            item.append(np.full(n, i, np.int32))
            at.append(np.arange(n, dtype=np.int32))
        order = np.argsort(np.concatenate(sig), kind="stable")
        self.walk, self.sig, self.item, self.at = walk, np.concatenate(sig)[order], np.concatenate(item)[order], np.concatenate(at)[order]
        bits = max(16, min(28, int(len(order) * 16).bit_length()))
        self.shift = np.uint32(32 - bits)
        self.flag = np.zeros(1 << bits, bool)
        self.flag[self.sig >> self.shift] = True

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(byte of the text, item, byte of the item) for all shared signatures."""
        s = self.walk.signatures(x)
        p = np.flatnonzero(self.flag[s >> self.shift])
        lo, hi = np.searchsorted(self.sig, s[p], "left"), np.searchsorted(self.sig, s[p], "right")
        n = hi - lo
        row = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
        return np.repeat(p, n), self.item[row], self.at[row]


class Index:
    """What is searched for: a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], share: float, recall: float, most: int):
        found = ((key, normal(text)) for key, text in items)
        self.items = []  # (id, pattern, words, edits that are let pass)
        for key, data in found:
            if data:
                text = data.decode()
                self.items.append((key, text if len(text) >= WHOLE_WORDS else f" {text} ", len(data.split()), int(len(text) * share)))
        data = [p.encode() for _, p, _, _ in self.items]
        self.size = np.array([len(d) for d in data], np.int64)
        self.room = np.array([k for *_, k in self.items], np.int64)
        self.share, self.tables = share, []
        self._parts(data)
        for n, (least, steps, samples) in enumerate(CLASSES):
            top = CLASSES[n - 1][0] if n else 1 << 60
            own = [(i, d) for i, d in enumerate(data) if least <= len(d) < top]
            self._fill(own, steps, samples, recall, most)

    def _parts(self, data: list[bytes]) -> None:
        """Runs of at most 64 bytes of every item, from every 32nd byte on, as bits of where each sign stands."""
        self.first, begin, length, of = np.zeros(len(data), np.int64), [], [], []
        for i, d in enumerate(data):
            self.first[i] = len(begin)
            for b in range(0, max(1, len(d) - WORD // 2), WORD // 2):
                b = max(0, min(b, len(d) - WORD))
                begin.append(b)
                length.append(min(WORD, len(d) - b))
                of.append(i)
        self.begin, self.length, self.count = np.array(begin, np.int64), np.array(length, np.int64), np.diff(np.append(self.first, len(begin)))
        self.bits = np.zeros((len(begin), 64), np.uint64)
        for c, (b, n, i) in enumerate(zip(begin, length, of)):
            np.bitwise_or.at(self.bits[c], SIGN[np.frombuffer(data[i], np.uint8, n, b)], np.uint64(1) << np.arange(n, dtype=np.uint64))
        whole = np.array([len(d) <= WORD for d in data], bool)
        wide = np.array([1 + (not d.isascii()) for d in data], np.int64)  # an edit of a character may touch two bytes or more
        of = np.array(of, np.int64)
        self.most = np.where(whole[of], self.room[of] * wide[of], (self.length * min(0.5, 2 * self.share)).astype(np.int64)) if len(of) else of

    def _fill(self, own: list[tuple[int, bytes]], steps: int, samples: int, recall: float, most: int) -> None:
        """Add repetitions until the wanted share of edited items is found."""
        if not own:
            return
        r = np.random.default_rng(steps)
        some = [own[k] for k in r.permutation(len(own))[:100]]
        left = [(i, " ".join(("x", edited(r, self.items[i][1].strip(), self.room[i]), "x"))) for i, _ in some for _ in range(-(-100 // len(some)))]
        miss = (1 - recall) * len(left)
        for n in range(most):
            table = Table(Walk(steps, samples, n), own)
            self.tables.append(table)
            got = self.search([normal(t) for _, t in left], [table])
            left = [x for x, g in zip(left, got) if x[0] not in {i for i, *_ in g}]
            if n and len(left) <= miss:
                break

    def search(self, texts: list[bytes], tables: list[Table] | None = None) -> list[list[tuple[int, int, int]]]:
        """For each normal text its matches: (item, word where it begins, edits)."""
        x = np.frombuffer(b" " + b" \0 ".join(texts) + b" ", np.uint8)
        begin = np.cumsum([1, *(len(t) + 3 for t in texts)])  # texts have a space on either side and are kept apart by a zero
        hits = [t.hits(x) for t in (self.tables if tables is None else tables)]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not hits or not sum(len(h[0]) for h in hits):
            return out
        p, item, at = (np.concatenate(c).astype(np.int64) for c in zip(*hits))
        text = np.clip(np.searchsorted(begin, p, "right") - 1, 0, len(texts) - 1)
        start = p - at
        _, pick = np.unique((text * len(self.items) + item) << 32 | (start - begin[text] + (1 << 20)) // (self.room[item] + 1), return_index=True)
        text, item, at, p = text[pick], item[pick], at[pick], p[pick]  # one place of each item and neighbourhood, in order of text, item and place
        near = self._near(x, item, at, p)
        text, item, start = text[near], item[near], (p - at)[near]
        last: dict[tuple[int, int], int] = {}
        spaces = np.cumsum(x == 32) if len(item) else x
        for d, i, s in zip(text.tolist(), item.tolist(), start.tolist()):
            _, pattern, _, room = self.items[i]
            lo, end = max(int(begin[d]) - 1, s - 2 * room - 1, last.get((d, i), 0)), int(begin[d + 1]) - 2
            window = x[lo : min(end, s + int(self.size[i]) + 2 * room + 1)].tobytes()
            while window and window[0] & 0xC0 == 0x80:  # a character that was cut
                lo, window = lo + 1, window[1:]
            place = best_place(pattern, window.decode(errors="ignore"), room)
            if place is not None:
                edits, a, b = place
                s, e = (lo + len(window.decode(errors="ignore")[:k].encode()) for k in (a, b))
                last[d, i] = e - (pattern[-1] == " ")  # the space after a short item may be the one before the next
                out[d].append((i, max(0, int(spaces[s] - spaces[begin[d]])), edits))
        return out

    def _near(self, x: np.ndarray, item: np.ndarray, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """True where the part of the item around a shared signature is near the text there."""
        part = self.first[item] + np.clip((at - WORD // 4) // (WORD // 2), 0, self.count[item] - 1)
        base = p - at + self.begin[part]  # with DRIFT more signs before the text than there are
        out = np.zeros(len(p), bool)
        order = np.argsort(self.length[part], kind="stable")
        edge = np.full(len(self.size) and int(self.size.max()) + WORD + DRIFT, 63, np.uint8)
        signs = np.concatenate([edge, SIGN[x], edge])
        columns = np.lib.stride_tricks.sliding_window_view(signs, WORD + 2 * DRIFT)
        for lo in range(0, len(p), 2048):
            rows = order[lo : lo + 2048]
            n = self.length[part[rows]]
            seen = columns[base[rows] + len(edge) - DRIFT, : int(n.max()) + 2 * DRIFT]
            out[rows] = _least(self.bits, part[rows], n, np.ascontiguousarray(seen.T)) <= self.most[part[rows]]
        return out


def _least(bits: np.ndarray, part: np.ndarray, length: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The least edit distance of each part to any stretch of its signs, which come as columns; one column of all tables at a time."""
    one, top = np.uint64(1), (length - 1).astype(np.uint64)
    even = top[0] == top[-1]  # lengths are sorted
    flat, row = bits.reshape(-1), part * 64
    up, down = np.full(len(part), 2**64 - 1, np.uint64), np.zeros(len(part), np.uint64)  # bits of vertical steps of +1 and -1
    score = length.copy()
    least = score.copy()
    eq, d, right, left, t = (np.empty(len(part), np.uint64) for _ in range(5))
    for column in columns:
        np.take(flat, row + column, out=eq)
        np.bitwise_and(eq, up, out=d)
        np.add(d, up, out=d)
        np.bitwise_xor(d, up, out=d)
        np.bitwise_or(d, eq, out=d)
        np.bitwise_or(d, down, out=d)
        np.bitwise_or(d, up, out=right)
        np.bitwise_not(right, out=right)
        np.bitwise_or(right, down, out=right)
        np.bitwise_and(d, up, out=left)
        if even and top[0] == WORD - 1:
            np.add(score, np.right_shift(right, top[0], out=t).view(np.int64), out=score)
            np.subtract(score, np.right_shift(left, top[0], out=t).view(np.int64), out=score)
        else:
            score += ((right >> top) & one).view(np.int64) - ((left >> top) & one).view(np.int64)
        np.minimum(least, score, out=least)
        np.left_shift(right, one, out=right)
        np.left_shift(left, one, out=left)
        np.bitwise_or(d, right, out=up)
        np.bitwise_not(up, out=up)
        np.bitwise_or(up, left, out=up)
        np.bitwise_and(right, d, out=down)
    return least


def _ends(pattern: str, text: str) -> list[int]:
    """The least edit distance of the pattern to any part of the text that ends at each place, from 0 on."""
    n = len(pattern)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    out = [n]
    for c in text:
        e = eq.get(c, 0)
        d = (((e & up) + up) ^ up) | e | down
        right, left = down | (full & ~(d | up)), d & up
        score += (right & top > 0) - (left & top > 0)
        right, left = right << 1, left << 1
        up, down = (left | ~(d | right)) & full, right & d & full
        out.append(score)
    return out


def best_place(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of text with the least edit distance to the pattern, if that is at most `most`; the first such end, the longest such part."""
    ends = _ends(pattern, text)
    edits = min(ends)
    if edits > most:
        return None
    end = ends.index(edits)
    back = text[max(0, end - len(pattern) - edits) : end][::-1]
    # from the end back, the part must begin at the end itself: a sign that no text holds anchors it
    tail = _ends("\0" * (edits + 1) + pattern[::-1], "\0" * (edits + 1) + back)
    length = max(k - edits - 1 for k, v in enumerate(tail) if v == edits and k > edits)
    return edits, end - length, end


def edited(r: np.random.Generator, text: str, edits: int) -> str:
    """A text with so many letters replaced, left out or put in, anywhere."""
    s = list(text)
    for _ in range(int(edits)):
        i, how, c = int(r.integers(0, max(1, len(s)))), int(r.integers(0, 3)), chr(97 + int(r.integers(0, 26)))
        if how == 2 or not s:
            s.insert(i, c)
        elif how:
            s[i] = c
        else:
            del s[i]
    return "".join(s)


def within(item: str, window: str, most: int) -> int | None:
    """The least edit distance of item to any part of window, if it is at most `most`; by rows, as plainly as can be."""
    a = np.frombuffer(item.encode("utf-32-le"), np.uint32)
    b = np.frombuffer(window.encode("utf-32-le"), np.uint32)
    step = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for c in a:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (b != c))
        row = np.minimum.accumulate(new - step) + step
        if row.min() > most:
            return None
    d = int(row.min())
    return d if d <= most else None


def find(documents: DataFrame, items: DataFrame, share: float = 0.2, recall: float = 0.98, repetitions: int = 12, block_chars: int = 2_000_000) -> DataFrame:
    """documents with matches: array of (item_id, first_word, n_words, edits) over whole texts.

    A place matches when its characters are within `share` of the item's length in edits. recall is
    what the repetitions are chosen for, of items with as many edits as that at random places;
    `repetitions` bounds them, for items so short that hardly a character is left unharmed.
    """
    spark = ready(documents.sparkSession)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_chars))
    sent = []
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").distinct()
        sent.append(spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").toLocalIterator()], share, recall, repetitions)))
    return _annotate(documents, sent)


MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())]))
BATCH_BYTES, RUN_BYTES = 400_000, 16 << 20
HELD: dict = {}
holds("decontaminate", HELD.clear)


def _held(block, token: str) -> Index:
    """The index of a broadcast; a worker holds one at a time."""
    if HELD.get("token") != token:
        HELD.clear()
        HELD.update(token=token, index=block.value)
        block.__dict__.pop("_value", None)
    return HELD["index"]


def _annotate(documents: DataFrame, sent: list) -> DataFrame:
    names = [c for c in documents.columns if c != "matches"]
    place, token = names.index("text"), uuid.uuid4().hex

    def matches(texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        parts = [normal(t) for t in texts]
        for k, block in enumerate(sent):
            index = _held(block, f"{token}-{k}")
            lo = 0
            while lo < len(parts):
                hi, size = lo, 0
                while hi < len(parts) and (size < BATCH_BYTES):
                    size += len(parts[hi])
                    hi += 1
                for d, found in enumerate(index.search(parts[lo:hi])):
                    for i, word, edits in found:
                        key, _, n, _ = index.items[i]
                        out[lo + d].append({"item_id": key, "first_word": word, "n_words": n, "edits": edits})
                lo = hi
        return out

    def run(batches):
        begin("decontaminate")
        held, size = [], 0

        def flush():
            found = matches([t for b in held for t in b.column(place).to_pylist()])
            at = 0
            for b in held:
                yield pa.record_batch([*b.columns, pa.array(found[at : at + b.num_rows], MATCHES)], [*names, "matches"])
                at += b.num_rows

        for b in batches:
            held.append(b)
            size += b.nbytes
            if len(sent) == 1 or size > RUN_BYTES:
                yield from flush()
                held, size = [], 0
        yield from flush()

    kept = documents.select(*names)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, matches array<struct<item_id:bigint,first_word:bigint,n_words:bigint,edits:bigint>>")


def clean(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """documents in which no item was found."""
    return find(documents, items, **how).where(F.size("matches") == 0).select(*documents.columns)
