"""Byte-level pre-tokenisation in numpy, and per-word token ids kept by worker.

The split is that of the byte-level pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
done on whole batches: characters are classed through a table and pieces start where the
class changes. Each distinct piece is tokenised once per batch; a bounded cache keeps pieces
between batches. Only the pieces repeat, so the ids are those of the library itself.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import regex

from .textkit import U64, mix, powers, ragged

VOCAB = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_TABLE: list[np.ndarray] = []
_CP = np.random.Generator(np.random.Philox(20260102)).integers(1, 2**64, 0x3100, dtype=U64)


def class_table() -> np.ndarray:
    """Class of every code point, built from the regex library's own Unicode properties."""
    if not _TABLE:
        t = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
        for cls, pat in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pat, every):
                lo, hi = ord(every[m.start()]), ord(every[m.end() - 1])
                t[lo : hi + 1] = cls
        t[0x1C:0x20] = OTHER  # \s of the pattern is Unicode White_Space
        t[0xD800:0xE000] = OTHER
        _TABLE.append(t)
    return _TABLE[0]


def split(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the rows of a chunk: (chunk bytes, byte starts, byte ends, row, hash); hash 0: the special string."""
    raw = data[offs[0] : offs[-1]]
    rel = (offs - offs[0]).astype(np.int64)
    text = raw.tobytes()
    cps = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    n = len(cps)
    if not n:
        z = np.zeros(0, np.int64)
        return raw, z, z, z, np.zeros(0, U64)
    width = 1 + (cps > 0x7F).astype(np.int8) + (cps > 0x7FF) + (cps > 0xFFFF)
    byte = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=byte[1:])
    # boundaries that no piece crosses: rows, and both ends of special strings
    cut = np.zeros(n + 1, bool)
    cut[np.searchsorted(byte, rel)] = True
    cut[0] = cut[n] = True
    marks = [m.start() for m in re.finditer(re.escape(SPECIAL.encode()), text)]
    mark = np.searchsorted(byte, np.array(marks, np.int64)) if marks else np.zeros(0, np.int64)
    if marks:  # a special string never straddles rows
        at_row = np.searchsorted(rel, marks, "right") - 1
        mark = mark[np.array(marks) + len(SPECIAL) <= rel[at_row + 1]]
        cut[mark] = cut[mark + len(SPECIAL)] = True
    cls = class_table()[cps]
    start = cut.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    run = np.flatnonzero(start)  # run starts, n last
    s, e = run[:-1], run[1:]
    c = cls[s]
    # white space: the last character leaves its run where text follows
    follows = ~cut[e]
    space = c == SPACE
    last = e[space & follows] - 1
    start[last] = True
    # a plain space joins what follows it
    glue = last[cps[last] == 0x20] + 1
    start[glue] = False
    # contractions: an apostrophe run of one character with no space before it, then letters
    lone = s[(c == OTHER) & (e - s == 1)]
    lone = lone[(cps[lone] == 0x27) & start[lone] & ~cut[lone + 1]] if len(lone) else lone
    if len(lone):
        lone = lone[cls[np.minimum(lone + 1, n - 1)] == LETTER]
    if len(lone):
        a, b = cps[lone + 1], np.where(cut[np.minimum(lone + 2, n)], 0, cps[np.minimum(lone + 2, n - 1)])
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = np.zeros(len(lone), bool)
        for x in ("re", "ve", "ll"):
            two |= (a == ord(x[0])) & (b == ord(x[1]))
        hit, size = lone[one | two], np.where(one, 1, 2)[one | two]
        start[hit + 1] = False
        start[hit + 1 + size] = True
    for m in mark:
        start[m + 1 : m + len(SPECIAL)] = False
    start[n] = True
    at = np.flatnonzero(start)
    s, e = at[:-1], at[1:]
    p, q = powers(n + 1)
    val = _CP[np.minimum(cps, 0x30FF)]
    far = np.flatnonzero(cps >= 0x30FF)
    if len(far):
        val[far] = mix(cps[far].astype(U64) + U64(0x100000000))
    acc = np.empty(n + 1, U64)
    acc[0] = 0
    np.cumsum(val * p[:n], out=acc[1:])
    h = mix((acc[e] - acc[s]) * q[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
    h[h == 0] = 1
    if len(mark):
        h[np.isin(s, mark)] = 0
    row = np.searchsorted(rel, byte[s], "right") - 1
    return raw, byte[s], byte[e], row, h


class Pieces:
    """Per-worker cache from piece hash to a ragged row of values, bounded by ``most`` pieces."""

    def __init__(self, encode, most: int = 1 << 20):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, U64), np.zeros(0, np.int64)
        self.lens, self.starts, self.vals = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def rows(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each piece, starts, lens) into ``vals``."""
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > self.most:
            self.clear()
        pos = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        if len(self.keys):
            known = self.keys[np.minimum(pos, len(self.keys) - 1)] == uniq
        new = np.flatnonzero(~known)
        if len(new):
            f = first[new]
            lens, vals = self.encode(raw, s[f], e[f], h[f])
            base = len(self.lens)
            self.starts = np.concatenate([self.starts, len(self.vals) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.vals = np.concatenate([self.vals, vals.astype(np.int32)])
            self.keys = np.insert(self.keys, pos[new], uniq[new])
            self.at = np.insert(self.at, pos[new], base + np.arange(len(new)))
            pos = np.searchsorted(self.keys, uniq)
        return self.at[pos][inv], self.starts, self.lens


_LIB: dict[str, object] = {}


def library(path: str | None = None):
    """The tokenizers library's own object, one for a worker and file."""
    import public_tokenizers

    path = path or public_tokenizers.path(VOCAB)
    if path not in _LIB:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LIB[path] = Tokenizer.from_file(path)
    return _LIB[path]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible Latin-1, else the next from U+0100."""
    seen, out = 0, []
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + seen))
            seen += 1
    return out


def piece_encoder(path: str | None = None):
    """Encode distinct pieces by the vocabulary file's merges; in it an id is also the merge's rank.

    The ids equal the library's (tests compare them); the piece-wise entry point of the byte-pair
    engine costs a quarter of a call of the library for each piece.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCAB), encoding="utf-8") as f:
        j = json.load(f)
    back = {c: b for b, c in enumerate(byte_symbols())}
    special = {t["content"]: t["id"] for t in j["added_tokens"]}
    ranks = {bytes(map(back.__getitem__, k)): v for k, v in j["model"]["vocab"].items() if k not in special}
    one = tiktoken.Encoding("pieces", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode(raw, s, e, h):
        buf = raw.tobytes()
        ids = [one(buf[i:j]) for i, j in zip(s.tolist(), e.tolist())]
        for i in np.flatnonzero(h == 0).tolist():
            ids[i] = [special[SPECIAL]]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return lens, np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))

    return encode


_IDS: dict[str, Pieces] = {}


def token_ids(data: np.ndarray, offs: np.ndarray, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows of a chunk, offsets by row)."""
    key = path or VOCAB
    if key not in _IDS:
        _IDS[key] = Pieces(piece_encoder(path))
    cache = _IDS[key]
    raw, s, e, row, h = split(data, offs)
    n = len(offs) - 1
    if not len(s):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    at, starts, lens = cache.rows(raw, s, e, h)
    k = lens[at]
    ids = cache.vals[ragged(starts[at], k)]
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row, weights=k, minlength=n).astype(np.int64), out=out[1:])
    return ids, out
