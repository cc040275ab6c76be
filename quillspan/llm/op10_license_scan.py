"""License scans by patience alignment against templates.

Words unique to both template and text anchor the alignment; the longest increasing subsequence
of their positions is kept, and the gaps between anchors are aligned the same way. Coverage is
the share of the template's words that are aligned. Windows of twice the template's length give the
places of a text that holds it close together, once or often; a text of which no window reaches
the coverage is aligned whole, however far its parts lie apart, and there aligned words count in
runs of ``RUN``. What cannot reach the coverage by a count of shared words is left out before.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .textkit import buffers, chunks, words

#: Aligned words of a whole text count in runs of so many at least: single words of long texts agree by chance.
RUN = 3


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once_a, once_b = {}, {}
        for x in range(i, j):
            once_a[a[x]] = -1 if a[x] in once_a else x
        for y in range(k, m):
            once_b[b[y]] = -1 if b[y] in once_b else y
        pairs = [(x, once_b[w]) for w, x in once_a.items() if x >= 0 and once_b.get(w, -1) >= 0]
        if not pairs:
            out += common((a[i:j], i), (b[k:m], k))
            continue
        pairs.sort()
        anchors = [pairs[x] for x in increasing([p[1] for p in pairs])]
        out += anchors
        for (x, y), (x2, y2) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)]):
            if x + 1 < x2 and y + 1 < y2:
                todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


def reach(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Longest common subsequence of s with every prefix of t."""
    row = np.zeros(len(t) + 1, np.int32)
    for x in s:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (t == x)))
    return row


def common(a: tuple[list[int], int], b: tuple[list[int], int]) -> list[tuple[int, int]]:
    """A longest common subsequence of a gap without anchors, halved again and again (linear space)."""
    out, todo = [], [(np.array(a[0]), a[1], np.array(b[0]), b[1])]
    while todo:
        s, i, t, k = todo.pop()
        if not len(s) or not len(t):
            continue
        if len(s) == 1:
            hit = np.flatnonzero(t == s[0])
            out += [(i, k + int(hit[0]))] if len(hit) else []
            continue
        half = len(s) // 2
        cut = int(np.argmax(reach(s[:half], t) + reach(s[half:][::-1], t[::-1])[::-1]))
        todo += [(s[:half], i, t[:cut], k), (s[half:], i + half, t[cut:], k + cut)]
    return out


def runs(pairs: list[tuple[int, int]], at: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that stand in runs of ``RUN`` at least, consecutive in the template and in the text (at: text positions)."""
    if not pairs:
        return []
    x, y = np.array([p[0] for p in pairs]), at[[p[1] for p in pairs]]
    head = np.append(True, (np.diff(x) != 1) | (np.diff(y) != 1))
    size = np.bincount(np.cumsum(head) - 1)
    return [p for p, n in zip(pairs, np.repeat(size, size).tolist()) if n >= RUN]


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        data, offs = buffers(pa.array([templates[n] for n in self.names], pa.string()))
        _, _, _, row, h = words(data, offs, alnum=True)
        self.words = [h[row == i] for i in range(len(self.names))]
        self.sets = [np.unique(w) for w in self.words]
        self.every = np.unique(h)

    def scan(self, data: np.ndarray, offs: np.ndarray, least: float) -> list[tuple[int, int, float, int, int, int]]:
        """(row, template, coverage, first word, end word, places) of the best place of each template in each row."""
        _, _, _, row, h = words(data, offs, alnum=True)
        if not len(h) or not len(self.every):
            return []
        at = np.flatnonzero(np.isin(h, self.every))  # few words are known at all
        hk = h[at]
        found: dict[tuple[int, int], list] = {}
        start = np.searchsorted(row, np.arange(len(offs)))
        for t, (tw, ts) in enumerate(zip(self.words, self.sets)):
            n = len(tw)
            if not n:
                continue
            pos = at[np.isin(hk, ts)]
            need = max(1, int(np.ceil(least * n)))
            if len(pos) < need:
                continue
            # windows of twice the template at steps of half of it, by their first known word's step
            step, wide = max(1, n // 2), 2 * n
            lo = np.unique(np.concatenate([(pos // step) * step, (pos // step - 1) * step, (pos // step - 2) * step, (pos // step - 3) * step]))
            lo = lo[lo >= 0]
            lo = lo[np.searchsorted(pos, lo + wide) - np.searchsorted(pos, lo) >= need]
            for x in lo.tolist():
                # a window never leaves its row
                inside = pos[np.searchsorted(pos, x) : np.searchsorted(pos, x + wide)]
                for r in np.unique(row[inside]).tolist():
                    i, j = max(x, int(start[r])), min(x + wide, int(start[r + 1]))
                    if np.count_nonzero((inside >= i) & (inside < j)) < need:
                        continue
                    text = h[i:j]
                    if np.isin(ts, text).sum() < least * len(ts) - (n - len(ts)):
                        continue
                    pairs = patience(tw.tolist(), text.tolist())
                    cover = len(pairs) / n
                    if cover >= least:
                        found.setdefault((r, t), []).append((cover, -(i + pairs[0][1] - int(start[r])), i + pairs[-1][1] + 1 - int(start[r])))
        for t, (tw, ts) in enumerate(zip(self.words, self.sets)):  # whole texts, of which only known words can be aligned
            pos = at[np.isin(hk, ts)]
            kind, own = np.searchsorted(ts, h[pos]), row[pos]
            has = np.bincount(np.searchsorted(ts, tw), minlength=len(ts))
            key, num = np.unique(own * max(len(ts), 1) + kind, return_counts=True)
            shared = np.bincount(key // max(len(ts), 1), weights=np.minimum(num, has[key % max(len(ts), 1)]), minlength=len(offs) - 1)
            for r in np.flatnonzero(shared >= least * max(len(tw), 1)).tolist():
                if (r, t) not in found and len(tw) >= RUN:
                    mine = pos[own == r]
                    pairs = runs(patience(tw.tolist(), h[mine].tolist()), mine)
                    if len(pairs) >= least * len(tw):
                        lo, hi = int(mine[pairs[0][1]] - start[r]), int(mine[pairs[-1][1]] - start[r])
                        found[r, t] = [(len(pairs) / len(tw), -lo, hi + 1)]
        out = []
        for (r, t), places in sorted(found.items()):
            cover, lo, hi = max(places)
            out.append((r, t, cover, -lo, hi, len({p[1] for p in places})))
        return out


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, coverage, first_word, end_word, places: templates covered to ``least`` by a text.

    Words are runs of letters and digits, A-Z as a-z. The best place is reported (the first of
    equal ones) and the number of distinct places; where the text had to be aligned whole that is
    one, from the first to the last aligned word. Null, empty and wordless texts match nothing;
    null and repeated ids are scanned row by row; other columns are ignored; an empty table
    gives an empty result. Texts are scanned whole.
    """
    kit = Templates(templates)

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(1))
            for i, j in chunks(offs):
                found = kit.scan(data, offs[i : j + 1], least)
                if found:
                    cols = [b.column(0).take(pa.array([i + f[0] for f in found])), pa.array([kit.names[f[1]] for f in found]), pa.array([f[2] for f in found], pa.float64())]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array([f[k] for f in found], pa.int64()) for k in (3, 4, 5))], ["doc_id", "license", "coverage", "first_word", "end_word", "places"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, coverage double, first_word long, end_word long, places long")
