"""Token counts by rank-synchronous merging of ragged symbol arrays.

Every distinct pre-token of a batch is a row of byte symbols in one flat array. A round finds
each row's lowest-ranked adjacent pair with a segmented minimum, merges all its occurrences in
all rows at once, and looks up ranks again only beside the merges. Rows without a ranked pair
leave; what remains of a row is its token count. No shuffle, no collect.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretok
from .textkit import U64, buffers, chunks, ragged

NONE = np.int32(2**31 - 1)
LONG = 2048


class Ranks:
    """Merge table in an open-addressed numpy hash table: pair of symbol ids -> (rank, merged id)."""

    BITS = 18

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte = np.array([vocab[c] for c in pretok.byte_symbols()], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        new = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = (left << 20) | right
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.rank = np.full(1 << self.BITS, NONE, np.int32)
        self.new = np.zeros(1 << self.BITS, np.int32)
        todo, slot = np.arange(len(key)), self.slot(key)
        while len(todo):  # all that find their slot free claim it; the lowest index wins
            free = self.keys[slot] == -1
            claim = np.full(1 << self.BITS, len(key), np.int64)
            np.minimum.at(claim, slot[free], todo[free])
            won = free & (claim[slot] == todo)
            at = slot[won]
            self.keys[at], self.rank[at], self.new[at] = key[todo[won]], todo[won], new[todo[won]]
            slot, todo = (slot[~won] + 1) & ((1 << self.BITS) - 1), todo[~won]
        self.pairs = {int(k): (i, int(n)) for i, (k, n) in enumerate(zip(key, new))}

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NONE, slot) of each pair."""
        key = (a.astype(np.int64) << 20) | b
        slot = self.slot(key)
        out = np.full(len(key), NONE, np.int32)
        got = slot.copy()
        todo = np.arange(len(key))
        while len(todo):
            k = self.keys[slot]
            hit = k == key[todo]
            out[todo[hit]] = self.rank[slot[hit]]
            got[todo[hit]] = slot[hit]
            more = ~hit & (k != -1)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.BITS) - 1)
        return out, got


def merge(table: Ranks, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Number of tokens of each byte span."""
    size = (e - s).astype(np.int64)
    counts = size.copy()
    for i in np.flatnonzero(size > LONG):  # a very long row would hold up the rounds of all others
        counts[i] = heap_merge(table, table.byte[raw[s[i] : e[i]]].tolist())
    live = np.flatnonzero((size > 1) & (size <= LONG))
    sym = table.byte[raw[ragged(s[live], size[live])]]
    seg = np.repeat(np.arange(len(live)), size[live])
    if not len(sym):
        return counts
    same = np.append(seg[1:] == seg[:-1], False)
    rank = np.full(len(sym), NONE, np.int32)
    slot = np.zeros(len(sym), np.int64)
    i = np.flatnonzero(same)
    rank[i], slot[i] = table.find(sym[i], sym[i + 1])
    while True:
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        low = np.minimum.reduceat(rank, first)
        length = np.diff(np.append(first, len(seg)))
        done = low == NONE
        if done.any():
            counts[live[seg[first[done]]]] = length[done]
            if done.all():
                return counts
            keep = np.repeat(~done, length)
            sym, seg, rank, slot = sym[keep], seg[keep], rank[keep], slot[keep]
            low, length = low[~done], length[~done]
        hit = rank == np.repeat(low, length)
        at = np.flatnonzero(hit)
        # in a run of overlapping hits every second one merges, from the left
        head = np.append(True, at[1:] != at[:-1] + 1)
        order = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        at = at[order % 2 == 0]
        sym[at] = table.new[slot[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        sym, seg, rank, slot = sym[keep], seg[keep], rank[keep], slot[keep]
        p = place[at]
        beside = np.zeros(len(sym), bool)
        beside[p] = True
        beside[p[p > 0] - 1] = True
        near = np.flatnonzero(beside)
        end = near + 1 >= len(sym)
        ok = ~end
        ok[ok] = seg[near[ok]] == seg[near[ok] + 1]
        rank[near[~ok]] = NONE
        near = near[ok]
        rank[near], slot[near] = table.find(sym[near], sym[near + 1])


def heap_merge(table: Ranks, sym: list[int]) -> int:
    """The same merges for one very long row, with a heap: n log n."""
    n = len(sym)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(table.pairs[k][0], i, k) for i in range(n - 1) if (k := (sym[i] << 20) | sym[i + 1]) in table.pairs]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, k = heapq.heappop(heap)
        j = nxt[i] if sym[i] >= 0 else n
        if j >= n or ((sym[i] << 20) | sym[j]) != k:
            continue
        sym[i], sym[j] = table.pairs[k][1], -1
        left -= 1
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for x, y in ((prv[i], i), (i, nxt[i])):
            if x >= 0 and y < n and (k := (sym[x] << 20) | sym[y]) in table.pairs:
                heapq.heappush(heap, (table.pairs[k][0], x, k))
    return left


_TABLES: dict[str, tuple[Ranks, pretok.Pieces]] = {}


def counter(path: str | None = None) -> tuple[Ranks, pretok.Pieces]:
    import public_tokenizers

    path = path or public_tokenizers.path(pretok.VOCAB)
    if path not in _TABLES:
        table = Ranks(path)

        def encode(raw, s, e, h):
            k = merge(table, raw, s, e)
            k[h == 0] = 1  # the special string is one token
            return np.ones(len(k), np.int64), k

        _TABLES[path] = table, pretok.Pieces(encode)
    return _TABLES[path]


def count_rows(data: np.ndarray, offs: np.ndarray, path: str | None = None) -> np.ndarray:
    """Tokens of each row of a chunk."""
    _, cache = counter(path)
    raw, s, e, row, h = pretok.split(data, offs)
    if not len(s):
        return np.zeros(len(offs) - 1, np.int64)
    at, starts, _ = cache.rows(raw, s, e, h)
    return np.bincount(row, weights=cache.vals[starts[at]], minlength=len(offs) - 1).astype(np.int64)


def token_counts(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    Null texts count as empty (0 bytes, 0 tokens, not over the limit); null and repeated ids
    pass through, one row for each input row; other columns are ignored; an empty table gives
    an empty result. A text is read whole, whatever its length.
    """

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(1))
            k = np.concatenate([count_rows(data, offs[i : j + 1], path) for i, j in chunks(offs)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(k), pa.array(k > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
