"""Hierarchical multi-length packing.

A document's tokens fill whole windows of the longest context first. What is left is routed to
the tier (context size) that just holds it. Tiers are packed from the longest: a window opens
with a piece of its own tier and its gap is filled with the largest fitting pieces of shorter
tiers; where none fits, the smallest one is cut. Every window is then full, and its size is a
power of two, so nothing is padded. What no window can take at the end is cut along its binary
digits. Windows of one tier form step groups of equal token counts.

Each input partition is packed on its own, in the order of its rows, with a bounded pool: there
is no shuffle, a lost task gives the same windows again, and memory doesn't follow the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretok
from .textkit import buffers, chunks, ragged

END = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def with_end(ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token rows with the end id after each."""
    n = np.diff(offs)
    out_offs = offs + np.arange(len(offs))
    out = np.full(int(out_offs[-1]), END, np.uint32)
    out[ragged(out_offs[:-1], n)] = ids
    return out, out_offs


class Packer:
    """Packs one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, part: int, window: int = 1024, pool: int = 4096, group_tokens: int = 16384):
        self.window, self.pool, self.group_tokens = window, pool, group_tokens
        self.next, self.base = 0, part << 32
        self.buckets: list[list[tuple]] = [[] for _ in range(window + 1)]
        self.mask = self.waiting = 0
        self.made: dict[int, int] = {}
        self.rows: list[tuple] = []

    def put(self, piece: tuple) -> None:
        k = len(piece[2])
        if k:
            self.buckets[k].append(piece)
            self.mask |= 1 << k
            self.waiting += 1

    def take(self, most: int) -> tuple | None:
        """The largest waiting piece of at most ``most`` tokens."""
        k = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        return self.pop(k) if k > 0 else None

    def pop(self, k: int) -> tuple:
        piece = self.buckets[k].pop()
        if not self.buckets[k]:
            self.mask &= ~(1 << k)
        self.waiting -= 1
        return piece

    def emit(self, pieces: list[tuple]) -> None:
        """One sequence."""
        at, size = 0, sum(len(p[2]) for p in pieces)
        tier = 1 << (size - 1).bit_length()
        n = self.made.get(tier, 0)
        self.made[tier] = n + 1
        group = (self.base << 4) + (tier.bit_length() << 32) + n // max(1, self.group_tokens // tier)
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.base + self.next, at, tier, group))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        for s in range(0, total - w + 1, w):
            self.emit([(doc, s, ids[s : s + w], total)])
        s = total - total % w
        if s < total:
            self.put((doc, s, ids[s:].copy(), total))
        if self.waiting >= self.pool:
            self.pack()

    def pack(self) -> None:
        """Pack all that waits, longest tier first."""
        tier = self.window
        while self.mask:
            while tier > 1 and not self.mask >> (tier // 2 + 1):
                tier //= 2
            piece = self.take(tier)
            pieces, gap = [piece], tier - len(piece[2])
            while gap and self.mask:
                piece = self.take(gap)
                if piece is None:  # nothing fits whole: cut the smallest
                    doc, s, ids, total = self.pop((self.mask & -self.mask).bit_length() - 1)
                    piece = (doc, s, ids[:gap], total)
                    self.put((doc, s + gap, ids[gap:], total))
                pieces.append(piece)
                gap -= len(piece[2])
            if gap:
                self.binary(pieces, tier - gap)
            else:
                self.emit(pieces)

    def binary(self, pieces: list[tuple], size: int) -> None:
        """The last, short window: sequences of the powers of two in its size."""
        for bit in reversed(range(size.bit_length())):
            if size >> bit & 1:
                room, own = 1 << bit, []
                while room:
                    doc, s, ids, total = pieces.pop(0)
                    if len(ids) > room:
                        pieces.insert(0, (doc, s + room, ids[room:], total))
                        ids = ids[:room]
                    own.append((doc, s, ids, total))
                    room -= len(ids)
                self.emit(own)

    def flush(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        cols = [pa.array(c, t) for c, t in zip(zip(*self.rows), kinds)]
        self.rows = []
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, window: int = 1024, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their place in the sequences.

    A document is its token ids and then the end id, so a null or empty text is one end id.
    Null and repeated doc_ids are packed row by row; a very long text is cut into as many pieces as
    it needs; documents of equal length go in the order they come; other columns are ignored; an
    empty table gives no pieces. ``window`` is a power of two. Sequences are numbered within partitions
    (partition in the high bits): the numbers are distinct, not consecutive.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches):
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId(), window)
        for b in batches:
            data, offs = buffers(b.column(1))
            doc = b.column(0).to_pylist()
            for i, j in chunks(offs):
                ids, at = with_end(*pretok.token_ids(data, offs[i : j + 1], path))
                for r in range(i, j):
                    packer.add(doc[r], ids[at[r - i] : at[r - i + 1]])
                out = packer.flush()
                if out is not None:
                    yield out
        packer.pack()
        out = packer.flush()
        if out is not None:
            yield out

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
