"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Every training passage (overlapping windows of words that cover the whole text) is a query.
Impacts are BM25 weights divided by the item's own score, so one threshold serves all items and
a passage that holds an item scores 1. The traversal skips what the terms' and blocks' maxima
keep below the threshold. All items above the threshold are then verified on word shingles: the
whole item, its question (first half) and its answer (second half) must overlap the document.

The index is broadcast, at most ``SHARD_BYTES`` of item text at a time: a larger benchmark is
searched shard by shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch
from .textkit import U64, buffers, chunks, mix, ragged, words

SHARD_BYTES = 32 << 20
PART, PASSAGE, STRIDE = 64, 128, 64
BLOCK = 8
K1, B = 1.2, 0.75
_C = np.random.Generator(np.random.Philox(20260106)).integers(1, 2**64, 6, dtype=U64) | U64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = np.full(n, U64(k), U64)
    for i in range(k):
        acc += h[i : i + n] * _C[i]
    return mix(acc)


def item_parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its item, its part, item of each part).

    Long items are cut into even parts of at most PART words: of 65 words on end, some passage holds all.
    """
    data, offs = buffers(pa.array(texts, pa.string()))
    _, _, _, row, h = words(data, offs, alnum=True)
    count = np.bincount(row, minlength=len(texts))
    nth = np.arange(len(h)) - (np.cumsum(count) - count)[row]
    parts = np.maximum(-(-count // PART), 1)
    base = np.cumsum(parts) - parts
    return h, row, base[row] + nth * parts[row] // np.maximum(count, 1)[row], np.repeat(np.arange(len(texts)), parts)


def frequencies(h: np.ndarray, part: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term of each posting, part of each posting, occurrences in it), ordered by term, then part."""
    terms, tid = np.unique(h, return_inverse=True)
    key, tf = np.unique(tid * m + part, return_counts=True) if len(h) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return terms, key // max(m, 1), key % max(m, 1), tf


class Index:
    """Inverted index of item parts: postings (part, impact) by term, their best impact, and that of each block of parts.

    ``whole``: (parts, words, parts that hold each term of this index) of all items, where the index
    holds some of them only; scores then are those of one index of all.
    """

    def __init__(self, ids: list[int], texts: list[str], whole: tuple[int, int, dict[int, int]] | None = None):
        self.ids = np.array(ids, np.int64)
        h, row, part, self.item = item_parts(texts)
        m = len(self.item)
        self.terms, term, part, tf = frequencies(h, part, m)
        df = np.bincount(term, minlength=len(self.terms))
        size = np.bincount(part, weights=tf, minlength=m)
        every, total = m, size.sum()
        if whole is not None:
            every, total, known = whole
            df = np.array([known[x] for x in self.terms.view(np.int64).tolist()], np.int64)
        idf = np.log1p((every - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[part] / max(total / max(every, 1), 1e-9)))
        self.own = np.maximum(np.bincount(part, weights=impact, minlength=m), 1e-12)
        impact = impact / self.own[part]
        self.part, self.impact = part, impact  # ordered by term, then part
        self.post = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.post_key = term * m + part
        # blocks: runs of equal (term, part // BLOCK)
        self.nb = m // BLOCK + 1
        head = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (part[1:] // BLOCK != part[:-1] // BLOCK))) if len(term) else np.zeros(0, np.int64)
        self.block, self.block_max = part[head] // BLOCK, np.maximum.reduceat(impact, head) if len(head) else impact
        self.block_term, self.block_lo, self.block_hi = term[head], head, np.append(head[1:], len(term))
        self.blocks = np.searchsorted(term[head], np.arange(len(self.terms) + 1))
        self.best = np.maximum.reduceat(impact, self.post[:-1]) if len(self.terms) else impact
        self.shingles = []
        for i in range(len(ids)):
            w = h[row == i] if len(ids) < 64 else h[int(np.searchsorted(row, i)) : int(np.searchsorted(row, i + 1))]
            k = min(5, len(w))
            g = grams(w, k) if k else np.zeros(0, U64)
            self.shingles.append((k, g))

    def search(self, tid: np.ndarray, passage: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, part, score) of all that score ``least`` or more; tid, passage: the indexed terms of n passages.

        Block-max WAND, with all passages in step. First the blocks that a passage's terms could lift
        to ``least`` by their maxima there are found; each becomes a query of its own, with a cursor for
        each term. A round orders the cursors by part and takes the first part, the pivot, at which the
        maxima of the cursors so far reach ``least``; cursors that lag move up to it, and once none
        does it is scored.
        """
        m, least = len(self.item), least - 1e-9
        key = np.unique(passage * len(self.terms) + tid)
        passage, tid = key // len(self.terms), key % len(self.terms)
        hope = np.bincount(passage, weights=self.best[tid], minlength=n) >= least
        passage, tid = passage[hope[passage]], tid[hope[passage]]
        num = self.blocks[tid + 1] - self.blocks[tid]
        entry, own = ragged(self.blocks[tid], num), np.repeat(passage, num)
        pair, own = np.unique(own * self.nb + self.block[entry], return_inverse=True)
        keep = (np.bincount(own, weights=self.block_max[entry], minlength=len(pair)) >= least)[own]
        entry, own = entry[keep], own[keep]
        pos, end, most, tid = self.block_lo[entry], self.block_hi[entry], self.block_max[entry], self.block_term[entry]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        while len(own):
            order = np.argsort(own * m + self.part[pos], kind="stable")
            own, pos, end, most, tid = own[order], pos[order], end[order], most[order], tid[order]
            cur = self.part[pos]
            head = np.append(True, own[1:] != own[:-1])
            q = np.cumsum(head) - 1
            total = np.cumsum(most)
            reach = total - (total - most)[head][q] >= least
            pivot = np.full(int(q[-1]) + 1, m, np.int64)
            np.minimum.at(pivot, q[reach], cur[reach])
            goal = pivot[q]
            lags = np.zeros(len(pivot), bool)
            lags[q[cur < goal]] = True
            ripe = ~lags & (pivot < m)
            hit = ripe[q] & (cur == goal)
            score = np.bincount(q[hit], weights=self.impact[pos[hit]], minlength=len(pivot))
            done = np.flatnonzero(ripe & (score >= least))
            found.append((pair[own[head][done]] // self.nb, pivot[done], score[done]))
            # past a pivot that was scored, else up to it
            late = np.flatnonzero((cur < goal) & (goal < m))
            pos[hit] += 1
            pos[late] = np.searchsorted(self.post_key, tid[late] * m + goal[late])
            live = (goal < m) & (pos < end)  # a query that cannot reach the threshold any more is done
            own, pos, end, most, tid = own[live], pos[live], end[live], most[live], tid[live]
        return tuple(np.concatenate(x) for x in zip(*found))

    def leaks(self, data: np.ndarray, offs: np.ndarray, least: float, overlap: float) -> list[tuple[int, int, float, float, float, float]]:
        """(row, item, score, whole, question and answer overlap) of the verified items of a chunk's rows."""
        _, _, _, row, h = words(data, offs, alnum=True)
        if not len(h) or not len(self.terms):
            return []
        n = len(offs) - 1
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[at] == h
        count = np.bincount(row, minlength=n)
        first = np.cumsum(count) - count
        nth = np.arange(len(h)) - first[row]
        # passage p of a row covers words p * STRIDE .. p * STRIDE + PASSAGE
        num = np.maximum(-(-(count - PASSAGE + STRIDE) // STRIDE), 1)
        base = np.cumsum(num) - num
        bound = np.concatenate([[0.0], np.cumsum(np.where(known, self.best[at], 0.0))])
        prow = np.repeat(np.arange(n), num)
        lo = first[prow] + (np.arange(int(num.sum())) - base[prow]) * STRIDE
        hi = np.minimum(lo + PASSAGE, (first + count)[prow])
        lo = np.minimum(lo, hi)
        some = np.flatnonzero(bound[hi] - bound[lo] >= least - 1e-6)
        if not len(some):
            return []
        size = hi[some] - lo[some]
        pos, own = ragged(lo[some], size), np.repeat(np.arange(len(some)), size)
        inside = known[pos]
        p, part, score = self.search(at[pos[inside]], own[inside], len(some), least)
        best: dict[tuple[int, int], float] = {}
        for r, i, s in zip(prow[some[p]].tolist(), self.item[part].tolist(), score.tolist()):
            best[r, i] = max(s, best.get((r, i), 0.0))
        out, held, last = [], {}, -1
        for (r, i), s in sorted(best.items()):
            if r != last:
                held, last = {}, r
            k, g = self.shingles[i]
            if k not in held:
                held[k] = np.sort(grams(h[first[r] : first[r] + count[r]], k))
            d = held[k]
            hit = d[np.minimum(np.searchsorted(d, g), len(d) - 1)] == g if len(d) else np.zeros(len(g), bool)
            half = (len(g) + 1) // 2
            whole, q, a = float(hit.mean()), float(hit[:half].mean()), float(hit[half:].mean()) if len(g) > half else float(hit.mean())
            if whole >= overlap and min(q, a) >= 0.5:
                out.append((r, i, s, whole, q, a))
        return out


def statistics(items: DataFrame) -> DataFrame:
    """(term, n): parts of items that hold a term, counted in two stages; under the null term n is the number of parts, words that of their words."""

    def run(batches):
        for b in batches:
            h, _, part, item = item_parts(b.column(0).to_pylist())
            terms, term, _, _ = frequencies(h, part, len(item))
            n = np.append(np.bincount(term, minlength=len(terms)), len(item))
            size = np.append(np.zeros(len(terms), np.int64), len(h))
            yield pa.RecordBatch.from_arrays([pa.array([*terms.view(np.int64).tolist(), None], pa.int64()), pa.array(n.astype(np.int64)), pa.array(size)], ["term", "n", "words"])

    return items.select("text").mapInArrow(run, "term long, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The items, indexed in shards that are small enough to broadcast; how they are dealt never shows in a score."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    n = max(1, -(-2 * size // SHARD_BYTES)) if size > SHARD_BYTES else 1
    stats = Scratch(benchmark.sparkSession).cut(statistics(items), "terms") if n > 1 else None
    for i in range(n):
        rows = sorted((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect())
        ids, texts, whole = [r[0] for r in rows], [r[1] for r in rows], None
        if stats is not None:
            every = stats.where("term is null").first()
            terms = benchmark.sparkSession.createDataFrame(pa.table({"term": np.unique(item_parts(texts)[0]).view(np.int64)}))
            whole = every["n"], every["words"], {r["term"]: r["n"] for r in stats.join(terms, "term").collect()}
        yield Index(ids, texts, whole)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, least: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """One row for each verified pair: doc_id (or the given columns), item_id, score, overlap, question_overlap, answer_overlap.

    Items and texts are compared by words of letters and digits, A-Z as a-z; very long texts are
    searched passage by passage to their end, long items part by part; pairs that tie are all
    returned. Null or empty texts
    and items without words match nothing; items below five words match as one sequence; null
    and repeated ids of documents pass through row by row; of repeated item ids each row is an
    item; other columns are ignored; an empty table on either side gives an empty result.
    """
    columns = columns or ["doc_id"]
    given = docs.select(*columns)
    schema = given.schema.add("item_id", "long").add("score", "double").add("overlap", "double").add("question_overlap", "double").add("answer_overlap", "double")
    wide = docs.select(*columns, F.col("text").alias("_text"))
    out = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for b in batches:
                data, offs = buffers(b.column(b.num_columns - 1))
                for i, j in chunks(offs):
                    found = index.leaks(data, offs[i : j + 1], least, overlap)
                    if found:
                        take = pa.array([i + f[0] for f in found])
                        cols = [c.take(take) for c in b.columns[:-1]] + [pa.array(index.ids[[f[1] for f in found]])] + [pa.array([f[k] for f in found], pa.float64()) for k in range(2, 6)]
                        yield pa.RecordBatch.from_arrays(cols, schema.names)

        part = wide.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """The rows, as they are, that hold no verified item; see ``decontaminate``."""
    schema = docs.schema
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for b in batches:
                data, offs = buffers(b.column(b.schema.get_field_index("text")))
                clean = np.ones(b.num_rows, bool)
                for i, j in chunks(offs):
                    clean[[i + f[0] for f in index.leaks(data, offs[i : j + 1], least, overlap)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
