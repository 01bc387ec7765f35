"""Repeated windows found from a sparse set of suffixes.

A window is `win` consecutive tokens (bytes or words) of one document. In every
window the token run of the smallest hash within its first `reach` tokens marks
one position, the window's anchor; it depends on the window's content only, so
equal windows have their anchor at the same place. An anchor's record is all the
text that the windows it serves can touch: `left`, the tokens before it, and
`right`, those from it on. Windows that start `o` tokens before their anchors
are equal if and only if the lefts agree on their last o tokens and the rights
on their first win - o. So only one suffix in about reach / 2 has to be sorted,
and no repeated window is lost.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

POS = np.uint64((1 << 24) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def anchors(h: np.ndarray, reach: int, win: int, starts: np.ndarray, lengths: np.ndarray):
    """h: a hash for each token's run; starts and lengths: where each document's
    tokens lie in it. Returns arrays of anchor, first and last window start served."""
    none = np.zeros(0, np.int64)
    n = len(h)
    if n < reach or n >= 1 << 24:
        if n >= 1 << 24:
            raise ValueError("cut the text into smaller pieces")
        return none, none, none
    m = (h & ~POS) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < reach:
        m = np.minimum(m[: len(m) - (reach - width)], m[reach - width :])
    ok = np.zeros(len(m), bool)
    for s, k in zip(starts.tolist(), lengths.tolist()):
        if k >= win:
            ok[s : s + k - win + 1] = True
    p = np.flatnonzero(ok)
    if not len(p):
        return none, none, none
    a = (m[p] & POS).astype(np.int64)
    cut = np.flatnonzero(a[1:] != a[:-1]) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(p)])) - 1
    return a[first], p[first], p[last]


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:24] != b[:24]:
        a, b, n = a[:24], b[:24], min(n, 24)
    x, y = a[:n], b[:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def common_words(a: bytes, b: bytes) -> int:
    """As common(), in whole words; each word ends with a space."""
    return a.count(b" ", 0, common(a, b))


def back_bytes(left: bytes) -> bytes:
    return left[::-1]


def back_words(left: bytes) -> bytes:
    words = left.split(b" ")
    return b" ".join(words[::-1])[1:] + b" " if left else b""


def repeated(group: list, depths: list[int], win: int, least: int, lcp, back, put) -> None:
    """Marks the repeated windows of one group of records.

    group: [right, left, lo, hi, ids, full] in order of right, no two with the same
    right and left; it serves window starts lo to hi tokens before the anchor; ids
    are its places and full says that all its windows are known as repeated.
    depths[i]: tokens that the rights of i and i + 1 share. put(record, o1, o2) gets
    the offsets that are repeated.

    Internal nodes of the suffix tree over the rights are visited from the deepest
    up. Each holds its leaves in the order of their lefts, read backwards; the
    smaller child is inserted into the larger, and only neighbours in that order
    are compared, which share the longest lefts. So a group of n distinct records
    takes about n log n steps, not n * n."""
    n = len(group)
    lefts = [back(x[1]) for x in group]
    order = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r

    def mark(i: int, depth: int, shared: int) -> None:
        x = group[i]
        if not x[5]:
            o1, o2 = max(x[2], win - depth), min(x[3], shared)
            if o1 <= o2:
                put(x, o1, o2)

    def join(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for r in b:
            at = bisect_left(a, r)
            i = order[r]
            for q in (at - 1, at):
                if 0 <= q < len(a):
                    j = order[a[q]]
                    if depth + min(group[i][3], group[j][3]) >= win:
                        shared = lcp(lefts[i], lefts[j])
                        if depth + shared >= win:
                            mark(i, depth, shared)
                            mark(j, depth, shared)
            a.insert(at, r)
        return a

    stack: list[tuple[int, list[int]]] = []
    for i in range(n):
        below = [rank[i]]
        depth = depths[i] if i + 1 < n else -1
        while stack and stack[-1][0] > depth:
            d, leaves = stack.pop()
            below = join(leaves, below, d)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, join(stack[-1][1], below, depth))
        elif depth >= least:
            stack.append((depth, below))


def groups(records, win: int, least: int, lcp, back, put) -> None:
    """records: (depth, right, left, lo, hi, id, full) in order of right and left, depth
    being what it shares with the one before, or None to compare here. Splits them
    where they share fewer than `least` tokens, merges equal records and marks."""
    group: list = []
    depths: list[int] = []

    def close() -> None:
        for x in group:
            if len(x[4]) > 1 and not x[5]:
                x[5] = True
                put(x, x[2], x[3])
        if len(group) > 1:
            repeated(group, depths, win, least, lcp, back, put)

    for depth, right, left, lo, hi, place, full in records:
        if group:
            old = group[-1]
            if depth is None:
                depth = lcp(old[0], right)
            if depth >= least:
                if depth == win - lo == win - old[2] and old[1] == left and old[0] == right:
                    if full or old[5]:  # the full one's places are marked already
                        if not full:
                            put([right, left, lo, hi, [place], False], lo, hi)
                        elif not old[5]:
                            put(old, old[2], old[3])
                        old[5] = True
                    else:
                        old[4].append(place)
                    continue
                depths.append(depth)
            else:
                close()
                group, depths = [], []
        group.append([right, left, lo, hi, [place], full])
    close()


def merged(spans) -> list[tuple[int, int]]:
    """Sorted, with overlapping and touching spans joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out
