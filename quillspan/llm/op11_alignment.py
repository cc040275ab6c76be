"""Alignment of two tokenizers over whole texts, and corpus-wide counts of the id pairs that end together.

Tokenizer A is the byte-level vocabulary on space + text, B the sentence-piece one on the text, to
which it adds the space itself, so that both spell the same bytes. Their token ends are cumulative
sums of byte lengths; the ends they share (``intersect1d``) cut the text into groups, token ends
are labelled by group with ``searchsorted``, and links are expanded with ``repeat``.

No piece of B holds a space after another character and no pre-token of A does unless white space
stands before that space, so neither tokenizer sees across a space that follows anything but white
space. Texts are cut there; each distinct segment is encoded and aligned once per worker and a text
is put together from its segments. Segments are looked up by their bytes, never by a hash.

Of two tokens that end together the shorter one is a suffix of the longer, so distinct pairs are
at most the sum of the byte lengths of both vocabularies (``pair_bound``), whatever the corpus:
their counts are summed in a salted two-stage shuffle and broadcast within that bound.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pretok import VOCAB, byte_symbols
from .store import Scratch
from .textkit import buffers, chunks, ragged

PIECES = "piece_bpe_32k.model"
SALTS = 16
PLAIN = 4096  # characters up to which a segment goes through the rank engine
KEPT = 96 << 20  # bytes of segments and of what is known of them that a worker keeps
_SPACE_BEFORE = np.zeros(256, bool)  # bytes that may end a white-space character
_SPACE_BEFORE[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


class Tokenizers:
    """Both libraries' engines and the bytes of each of their ids."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.a_path = a_path or public_tokenizers.path(VOCAB)
        with open(self.a_path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(back.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path(PIECES))
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.gap = self.b.piece_to_id("▁")

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def encode(self, segments: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments, each of which begins with a space that B adds by itself."""
        texts = [x.decode() for x in segments]
        one = self.a._core_bpe.encode_ordinary
        a = [one(x) if len(x) <= PLAIN else self._long(x) for x in texts]
        b = self.b.encode([x[1:] for x in texts], num_threads=1)
        return a, [x if t != " " else [self.gap] for x, t in zip(b, texts)]

    def _long(self, text: str) -> list[int]:
        """The same ids by the tokenizers library, whose pattern engine has no limit on a run's length."""
        from tokenizers import Tokenizer

        if not hasattr(self, "lib"):
            self.lib = Tokenizer.from_file(self.a_path)
            self.lib.encode_special_tokens = True
        return self.lib.encode(text, add_special_tokens=False).ids

    def pair_bound(self) -> int:
        return int(self.a_len.sum() + self.b_len.sum())


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())), lens


def align(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A and B positions of each link).

    Both sides spell the same bytes; ``a_len`` and ``b_len`` give the bytes of each of their tokens.
    """
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    cuts = np.intersect1d(a_end, b_end, assume_unique=min(a_len.min(initial=1), b_len.min(initial=1)) > 0)
    if not len(cuts):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    a_group, b_group = np.searchsorted(cuts, a_end, "left"), np.searchsorted(cuts, b_end, "left")
    # tokens that end at a cut; several of one side only if some spell no byte
    a_at, b_at = np.flatnonzero(cuts[a_group] == a_end), np.flatnonzero(cuts[b_group] == b_end)
    times = np.bincount(b_group[b_at], minlength=len(cuts))
    first = np.cumsum(times) - times
    of = a_group[a_at]
    return a_group, b_group, np.repeat(a_at, times[of]), b_at[ragged(first[of], times[of])]


class Decimals:
    """Decimal numbers below ``n``, each after one free byte, as one table of bytes."""

    def __init__(self, n: int):
        said = [f",{i}".encode() for i in range(n)]
        self.len = np.array([len(x) for x in said], np.int64)
        self.first = np.cumsum(self.len) - self.len
        self.bytes = np.frombuffer(b"".join(said), np.uint8)


def says(decimals: Decimals, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(``;a1,a2|b1;a3|b2,b3`` of all groups, start of each A token's number in it)."""
    groups = int(a_group[-1]) + 1 if len(a_group) else 0
    n_a, n_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    a_at = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[a_group]
    b_at = np.arange(len(b)) + np.cumsum(n_a)[b_group]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[a_at], ids[b_at] = a, b
    mark[a_at[np.searchsorted(a_group, np.arange(groups))]] = ord(";")
    mark[b_at[np.searchsorted(b_group, np.arange(groups))]] = ord("|")
    size = decimals.len[ids]
    start = np.cumsum(size) - size
    out = decimals.bytes[ragged(decimals.first[ids], size)]
    out[start] = mark
    return out.tobytes(), start[a_at]


class Segments:
    """Ids of the segments that a worker has met, by their bytes."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.decimals = Decimals(max(len(tokenizers.a_len), len(tokenizers.b_len)))
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.size = 0
        self.good = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.first = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.lens = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def find(self, buf: bytes, s: list[int], e: list[int]) -> np.ndarray:
        """Number of each segment; what was kept before is forgotten beyond ``KEPT`` bytes."""
        if self.size > KEPT:
            self.clear()
        keys = [buf[i:j] for i, j in zip(s, e)]
        new = [k for k in dict.fromkeys(keys) if k not in self.at]
        if new:
            both = self.t.encode(new)
            spelled = [[b"".join(map(of.__getitem__, x)) for x in ids] for of, ids in zip((self.t.a_bytes, self.t.b_bytes), both)]
            good = [k == x == y for k, x, y in zip(new, *spelled)]
            self.good = np.concatenate([self.good, good])
            for side in (0, 1):
                ids, lens = flat([x if g else [] for x, g in zip(both[side], good)])
                self.first[side] = np.concatenate([self.first[side], len(self.ids[side]) + np.cumsum(lens) - lens])
                self.lens[side] = np.concatenate([self.lens[side], lens])
                self.ids[side] = np.concatenate([self.ids[side], ids])
                self.size += 4 * len(ids)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.size += sum(map(len, new)) + 200 * len(new)
        return np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))

    def tokens(self, which: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the segments in turn, number of each)."""
        lens = self.lens[side][which]
        return self.ids[side][ragged(self.first[side][which], lens)], lens


def cut_segments(raw: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the segments of rows; each segment begins with a space, empty rows have none."""
    start = np.zeros(len(raw) + 1, bool)
    start[1:-1] = (raw[1:] == 0x20) & ~_SPACE_BEFORE[raw[:-1]]
    start[rel] = True
    at = np.flatnonzero(start)
    return at[:-1], at[1:], np.searchsorted(rel, at[:-1], "right") - 1


def spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a chunk, each that is not empty with a space before it: (bytes, offsets)."""
    n = np.diff(offs)
    full = n > 0
    rel = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n + full, out=rel[1:])
    out = np.full(rel[-1], 0x20, np.uint8)
    text = np.ones(rel[-1], bool)
    text[rel[:-1][full]] = False
    out[text] = data[offs[0] : offs[-1]]
    return out, rel


_KNOWN: dict[tuple, Segments] = {}
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def known(a_path: str | None, b_path: str | None) -> Segments:
    if (a_path, b_path) not in _KNOWN:
        _KNOWN[a_path, b_path] = Segments(Tokenizers(a_path, b_path))
    return _KNOWN[a_path, b_path]


def align_texts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Sums, digest of the groups and distinct pairs (A id * 2^32 + B id) with their counts, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = known(a_path, b_path)
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for lo, hi in chunks(offs):
                yield from rows(seg, batch.column(0).slice(lo, hi - lo), *spaced(data, offs[lo : hi + 1]))

    def rows(seg, ids, raw, rel):
        n = len(ids)
        s, e, row = cut_segments(raw, rel)
        which = seg.find(raw.tobytes(), s.tolist(), e.tolist())
        bad = np.zeros(n, bool)
        bad[row[~seg.good[which]]] = True
        keep = ~bad[row]
        row, which = row[keep], which[keep]
        (a, a_num), (b, b_num) = seg.tokens(which, 0), seg.tokens(which, 1)
        a_row, b_row = np.repeat(row, a_num), np.repeat(row, b_num)
        # every text ends at a cut, so the whole chunk is aligned as one
        a_group, b_group, i, j = align(seg.t.a_len[a], seg.t.b_len[b])
        of = a_row[i]
        head = np.flatnonzero(np.diff(a_group, prepend=-1))
        count = lambda x: np.bincount(x, minlength=n)
        said, start = says(seg.decimals, a, a_group, b, b_group)
        at = np.append(start, len(said))[np.searchsorted(a_row, np.arange(n + 1))].tolist()
        digest = [hashlib.sha256(said[i + 1 : j]).hexdigest() if j > i else "" for i, j in zip(at, at[1:])]
        pair = a[i].astype(np.int64) << 32 | b[j]
        order = np.lexsort((pair, of))
        pair, row = pair[order], of[order]
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (row[1:] != row[:-1]))) if len(pair) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(pair))).astype(np.int32)
        lists = np.searchsorted(row[new], np.arange(n + 1)).astype(np.int32)
        cols = [ids, *map(pa.array, (count(a_row), count(b_row), count(a_row[head]), count(of))), pa.array(digest, pa.string())]
        cols += [pa.ListArray.from_arrays(lists, pa.array(x)) for x in (pair[new], times)]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in ALIGNED.split(", ")])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:  # a table of few splits is dealt out, others stay as they are read
        texts = texts.repartition(cores)
    return texts.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, salts: int = SALTS) -> DataFrame:
    """a_id, b_id, pair, count, best (whether no A id counts more with that B id): tasks sum what they hold, then two grouped stages, the first salted."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % salts
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            more, times = (b.column(k).flatten().to_numpy() for k in (0, 1))
            key, at = np.unique(np.concatenate([key, more]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, times]), minlength=len(key)).astype(np.int64)
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), salt, np.int32)), pa.array(key), pa.array(n)], ["salt", "pair", "n"])

    found = aligned.select("pairs", "times").mapInArrow(partial, "salt int, pair long, n long")
    found = found.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("count"))
    found = found.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "pair", "count")
    return found.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b_id")))


def cross_alignment(spark: SparkSession, docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of an A and a B token whose byte ranges end together; its count is the number
    of links of that id pair in the whole corpus. Null and empty texts, and texts that either
    tokenizer does not spell exactly (such as those with U+2581), have no tokens: zeros and an
    empty digest. Repeated rows count each time; ties for the best count all count; null doc_ids
    stay; whole texts enter however long; other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(spark)
    aligned = scratch.cut(align_texts(docs, a_path, b_path), "aligned")
    counts = scratch.cut(pair_counts(aligned), "pairs")
    bound = Tokenizers(a_path, b_path).pair_bound()
    if counts._rows > bound:
        raise RuntimeError("more id pairs end together than the vocabularies allow")
    t = counts.select("pair", "count", "best").toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast([t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, best = shared.value
        for b in batches:
            lists, times = b.column("pairs"), b.column("times").flatten().to_numpy()
            at = np.searchsorted(key, lists.flatten().to_numpy())
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            total = np.zeros((2, b.num_rows), np.int64)
            np.add.at(total[0], row, times * best[at])
            np.add.at(total[1], row, times * count[at])
            cols = [b.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total[0]), pa.array(total[1]), b.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return aligned.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
