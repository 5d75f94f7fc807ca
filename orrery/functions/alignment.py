"""Alignment of two letter sequences by their longest common subsequence, bits in parallel.

Row i of the usual table grows by 0 or 1 from column to column, so a row is one integer with a bit
per column, and the next row follows from it by an addition. The way back through the table
needs single rows again: every so many are kept and those between made anew, so the memory is
that of the square root of all rows.
"""

from __future__ import annotations

import math


def pairs(a: str, b: str) -> list[int]:
    """For each letter of ``a`` the place of its partner in ``b``, or -1.

    From the ends, equal letters pair; else the table decides: b's letter is skipped if that
    leaves strictly more in common, otherwise a's. Equal sequences pair as they are.
    """
    if a == b:
        return list(range(len(a)))
    n, m = len(a), len(b)
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    every, full = max(1, math.isqrt(n)), (1 << m) - 1

    def rows(start: int, v: int, end: int):
        # bit j is 0 where the row grows at column j + 1
        for i in range(start, end):
            same = v & at.get(a[i], 0)
            v = ((v + same) | (v - same)) & full
            yield v

    kept, v = [full], full
    for i, v in enumerate(rows(0, full, n), 1):
        if i % every == 0:
            kept.append(v)
    to, i, j = [-1] * n, n, m
    block: list[int] = []
    first = n + 1
    while i and j:
        if i - 1 < first:
            # rows from the last one kept at or below i - 1 up to i
            k = (i - 1) // every
            first = k * every
            block = [kept[k], *rows(first, kept[k], min(i, first + every))]
        if a[i - 1] == b[j - 1]:
            to[i - 1] = j - 1
            i, j = i - 1, j - 1
            continue
        # a row grows by a set bit of its complement
        up_to = (1 << j) - 1
        here, above = block[i - first], block[i - 1 - first]
        if (~here & up_to).bit_count() > (~above & up_to).bit_count():
            j -= 1
        else:
            i -= 1
    return to
