"""Edit distance of whole texts or lists of words, by bits of one integer: a step for each symbol of the longer one."""

from __future__ import annotations

from collections.abc import Sequence


def distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and replacements that turn a into b."""
    n = min(len(a), len(b))
    lo = 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)  # bits of steps of +1 and of -1 down a column
    for c in b:
        same = at.get(c, 0)
        flat = ((same & up) + up ^ up) | same | down
        right, left = down | full & ~(flat | up), up & flat
        score += (right & top > 0) - (left & top > 0)
        right = right << 1 | 1
        up, down = (left << 1 | ~(flat | right)) & full, right & flat & full
    return score
