"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The scans of induced sorting are done bucket by bucket: all suffixes of a bucket that are known
are read at once and their predecessors appended to their buckets in that order, which is the
order of the one-by-one scan. The reduced string of the leftmost-smaller substrings' names is
sorted by the same function again.
"""

from __future__ import annotations

import numpy as np

SENTINEL, SEPARATOR, SHIFT = 0, 1, 2
CROWDED = 64


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, start of each text): every text is followed by a separator, the last by the sentinel."""
    flat = np.frombuffer(b"\x00".join(texts) + b"\x00\x00", np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(lens + 1) - lens - 1
    t = flat.astype(np.uint8 if not len(flat) or flat.max() <= 253 else np.uint16) + SHIFT
    t[start + lens] = SEPARATOR
    t[-1] = SENTINEL
    return t, start


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), false where larger (L)."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        at = np.where(t[:-1] != t[1:], np.arange(n - 1), n - 2)
        s[:-1] = (t[:-1] < t[1:])[np.minimum.accumulate(at[::-1])[::-1]]
    return s


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix order induced from leftmost-smaller positions that are ordered at least by first symbol."""
    n, k = len(t), int(t.max()) + 1
    if n < CROWDED * k:
        return induce_singly(t, small, lms, k)
    sa = np.full(n, -1, np.int64)
    size = np.bincount(t, minlength=k)
    tail = np.cumsum(size)
    head = tail - size
    first = np.searchsorted(t[lms], np.arange(k + 1))
    present = np.flatnonzero(size)

    def place(batch: np.ndarray, ptr: np.ndarray, kind: bool) -> None:
        j = batch[batch > 0] - 1
        j = j[small[j] == kind]
        if not len(j):
            return
        c = t[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        num = np.bincount(c, minlength=k)
        rank = np.arange(len(j)) - (np.cumsum(num) - num)[c]
        if kind:
            sa[ptr[c] - 1 - rank] = j
            ptr -= num
        else:
            sa[ptr[c] + rank] = j
            ptr += num

    ptr = head.copy()
    for c in present:
        lo = head[c]
        while lo < ptr[c]:
            hi = ptr[c]
            place(sa[lo:hi], ptr, False)
            lo = hi
        place(lms[first[c] : first[c + 1]], ptr, False)
    end_l, ptr = ptr, tail.copy()
    sa[0], ptr[t[n - 1]] = n - 1, tail[t[n - 1]] - 1
    for c in present[::-1]:
        hi = tail[c]
        while hi > ptr[c]:
            lo = ptr[c]
            place(sa[lo:hi][::-1], ptr, True)
            hi = lo
        place(sa[head[c] : end_l[c]][::-1], ptr, True)
    return sa


def induce_singly(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same for many symbols in small buckets, suffix by suffix."""
    n = len(t)
    size = np.bincount(t, minlength=k)
    tails = np.cumsum(size)
    head, tail = (tails - size).tolist(), tails.tolist()
    sym, s_type, sa = t.tolist(), small.tolist(), [0] * n
    for i in lms[::-1].tolist():
        c = sym[i]
        tail[c] -= 1
        sa[tail[c]] = i
    sa[0] = n - 1  # the sentinel
    for x in range(n):
        j = sa[x] - 1
        if j >= 0 and not s_type[j]:
            c = sym[j]
            sa[head[c]] = j
            head[c] += 1
    tail = tails.tolist()
    for x in range(n - 1, -1, -1):
        j = sa[x] - 1
        if j >= 0 and s_type[j]:
            c = sym[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols that end in a unique smallest one."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    small = types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    rough = induce(t, small, lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    # names of leftmost-smaller substrings
    length = np.append(np.diff(lms) + 1, 1)
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    ln = length[index[order]]
    new = np.ones(len(order), bool)
    new[1:] = ln[1:] != ln[:-1]
    todo = np.flatnonzero(~new)
    off = 0
    while len(todo):
        todo = todo[ln[todo] > off]
        differ = t[order[todo] + off] != t[order[todo - 1] + off]
        new[todo[differ]] = True
        todo = todo[~differ]
        off += 1
    name = np.zeros(len(lms), np.int64)
    name[index[order]] = np.cumsum(new) - 1
    return induce(t, small, lms[sort_names(name)])


def sort_names(name: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names, the last of which is its unique smallest, by induced sorting again.

    A name that occurs once settles every comparison that meets it, so only names that occur more
    often, and the one after each of them, are sorted as a string of their own.
    """
    m = len(name)
    size = np.bincount(name)
    first = np.cumsum(size) - size
    out = np.empty(m, np.int64)
    many = size[name] > 1
    out[first[name[~many]]] = np.flatnonzero(~many)
    if not many.any():
        return out
    keep = many.copy()
    keep[1:] |= many[:-1]
    keep[-1] = True
    at = np.flatnonzero(keep)
    order = at[suffix_array(np.unique(name[at], return_inverse=True)[1].astype(np.int64))]
    order = order[many[order]]
    group = name[order]  # ascending
    head = np.append(True, group[1:] != group[:-1])
    place = np.arange(len(order))
    out[first[group] + place - np.maximum.accumulate(np.where(head, place, 0))] = order
    return out


def plcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, permuted common prefixes): phi[i] is the suffix before i in order, -1 for the first.

    Only irreducible values are compared symbol by symbol; others are one less than their left neighbour's.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    red = np.zeros(n, bool)
    red[1:] = (phi[1:] == phi[:-1] + 1) & (phi[:-1] >= 0)
    i = np.flatnonzero(red)
    red[i] = t[i - 1] == t[phi[i - 1]]
    irr = np.flatnonzero(~red)
    out = np.zeros(n, np.int64)
    todo = irr[phi[irr] >= 0]
    wide = None
    if t.dtype == np.uint8:
        pad = np.concatenate([t, np.zeros(8, np.uint8)])
        wide = np.lib.stride_tricks.as_strided(pad[: n + 1].view(np.uint8), (n, 8), (1, 1))
    length = np.zeros(len(todo), np.int64)
    live = np.arange(len(todo))
    while wide is not None and len(live):
        a, b = todo[live] + length[live], phi[todo[live]] + length[live]
        ok = (a + 8 <= n) & (b + 8 <= n)
        live, a, b = live[ok], a[ok], b[ok]
        same = (np.ascontiguousarray(wide[a]).view(np.uint64) == np.ascontiguousarray(wide[b]).view(np.uint64))[:, 0]
        live = live[same]
        length[live] += 8
    live = np.arange(len(todo))
    while len(live):
        a, b = todo[live] + length[live], phi[todo[live]] + length[live]
        ok = (a < n) & (b < n)
        live, a, b = live[ok], a[ok], b[ok]
        live = live[t[a] == t[b]]
        length[live] += 1
    out[todo] = length
    lead = np.maximum.accumulate(np.where(red, 0, np.arange(n)))
    return phi, np.maximum(out[lead] - (np.arange(n) - lead), 0)
