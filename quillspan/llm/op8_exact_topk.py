"""Exact top-k by inner product, with multi-resolution segment statistics.

Vectors become integers floor(64 x). A vector of d components is cut into segments; with mean m
and deviation norm s of each (length L), the inner product of two vectors is at most
sum(L m m' + s s') over the segments, which bounds their distance from below. Bounds are taken
from coarse to fine; pairs whose bound stays below the query's k-th score so far are dropped,
and the survivors are scored exactly. How many pairs a level leaves depends on the vectors: where
their components differ by direction alone, without runs of like ones, the bounds leave almost all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .op3_training_order import filesystem
from .store import Scratch, partitions

LEVELS = (4, 16)
SUB = 1024


def stats(v: np.ndarray, m: int) -> np.ndarray:
    """[rows, 2m] segment statistics whose products add up to the bound."""
    cols = []
    for seg in np.array_split(v, m, axis=1):
        mean = seg.mean(1)
        cols += [mean * np.sqrt(seg.shape[1]), np.sqrt(((seg - mean[:, None]) ** 2).sum(1))]
    return np.stack(cols, 1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where these are exact, which is faster."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2.0**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if top >= 2.0**63:
        raise ValueError("inner products do not fit in 64 bits")
    return q @ x.T


class Best:
    """The k best candidates so far of each query of a block, ties to the smaller id."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int):
        self.qid, self.q, self.k = qid, q, k
        n, d = q.shape
        self.levels = [m for m in LEVELS if m < d]
        self.stats = [stats(q.astype(float), m) for m in self.levels]
        self.norm = np.linalg.norm(q.astype(float), axis=1)
        self.low = np.full(n, np.iinfo(np.int64).min)
        self.row = self.id = self.score = np.zeros(0, np.int64)
        self.seen, self.left = 0, np.zeros(len(LEVELS) + 1, np.int64)  # pairs, and those that each bound left

    def feed(self, xid: np.ndarray, x: np.ndarray, own: np.ndarray | None = None) -> None:
        """Candidates, ``SUB`` at a time: bounds from coarse to fine, then the exact products of the survivors. ``own``: what tells a query from itself, if not the ids."""
        n, own = len(self.q), xid if own is None else own
        xs = [stats(x.astype(float), m) for m in self.levels]
        slack = 0.5 + 1e-9 * self.norm * float(np.linalg.norm(x.astype(float), axis=1).max(initial=0))
        for lo in range(0, len(x), SUB):
            part, ids, rows = x[lo : lo + SUB], xid[lo : lo + SUB], own[lo : lo + SUB]
            least = (self.low - slack)[:, None]
            alive = np.ones((n, len(part)), bool)
            self.seen += alive.size
            for level, (a, b) in enumerate(zip(self.stats, xs)):
                some, cols = alive.any(1), alive.any(0)  # rows and columns without a survivor drop out of the next level
                alive[np.ix_(some, cols)] &= a[some] @ b[lo : lo + SUB][cols].T >= least[some]
                self.left[level] += np.count_nonzero(alive)
            some, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(some):
                continue
            s = exact(self.q[some], part[cols])
            r, c = np.nonzero(alive[np.ix_(some, cols)] & (s >= self.low[some][:, None]) & (self.qid[some][:, None] != rows[cols]))
            self.left[-1] += len(r)
            r, c, s = some[r], ids[cols[c]], s[r, c]
            touched = np.zeros(n, bool)
            touched[r] = True
            mine = touched[self.row]
            r, c, s = np.concatenate([self.row[mine], r]), np.concatenate([self.id[mine], c]), np.concatenate([self.score[mine], s])
            order = np.lexsort((c, -s, r))
            r, c, s = r[order], c[order], s[order]
            num = np.bincount(r, minlength=n)
            rank = np.arange(len(r)) - (np.cumsum(num) - num)[r]
            last = rank == self.k - 1
            self.low[r[last]] = s[last]
            keep = rank < self.k
            self.row, self.id, self.score = (np.concatenate([old[~mine], new[keep]]) for old, new in ((self.row, r), (self.id, c), (self.score, s)))


def block_topk(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best of each query."""
    best = Best(qid, q, k)
    best.feed(xid, x)
    order = np.lexsort((best.id, -best.score, best.row))
    return best.row[order], best.id[order], best.score[order]


def matrices(b: pa.RecordBatch | pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row marks, ids and vectors by length of the vectors."""
    v = b.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = np.diff(v.offsets.to_numpy())
    flat, at = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
    rid, ids = b.column("rid").to_numpy(), b.column("vec_id").to_numpy()
    out = {}
    for d in np.unique(size):
        some = np.flatnonzero(size == d)
        out[int(d)] = rid[some], ids[some], flat[at[some][:, None] + np.arange(d)].astype(np.int64)
    return out


def exact_topk(spark: SparkSession, vectors: DataFrame, k: int = 20, every: int = 20, block: int = 1024, chunk_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each row whose id is divisible by ``every``.

    Rows with a null id, a null vector, or a null or non-finite component take no part; vectors
    meet only those of their own length, however long; a repeated id is a row of its own each time,
    as query and as candidate; ties go to the smaller id; other columns are ignored; an empty table
    gives an empty result. Components of 2^31 and more are an error. Candidates stay in their
    partitions; queries stay in the shared folder, where tasks read them ``block`` at a time.
    """
    scratch = Scratch(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("e", lambda x: F.floor(x * 64))
    over = F.when(F.exists(whole, lambda x: F.abs(x) >= 2**31), F.raise_error(F.lit("a component does not fit in 32 bits")))
    v = v.where(~bad).select("vec_id", over.otherwise(whole).cast("array<int>").alias("v"))
    if v.rdd.getNumPartitions() < partitions(spark):  # a small table; a large one stays as it was read
        v = v.repartition(partitions(spark))
    v = scratch.cut(v.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    asks = scratch.cut(v.where(F.col("vec_id") % every == 0), "queries")._scratch

    def meet(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        held = matrices(pa.Table.from_batches(some))
        store, where = filesystem(asks)
        for b in ds.dataset(where, filesystem=store, format="parquet").to_batches(batch_size=block):
            for d, (qrid, qid, q) in matrices(b).items() if b.num_rows else ():
                if d in held:
                    xrid, xid, x = held[d]
                    best = Best(qrid, q, k)
                    best.feed(xid, x, xrid)
                    yield pa.RecordBatch.from_arrays([pa.array(qrid[best.row]), pa.array(qid[best.row]), pa.array(best.id), pa.array(best.score)], ["query", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for b in batches:
            some.append(b)
            size += 2 * b.nbytes
            if size >= chunk_bytes:
                yield from meet(some)
                some, size = [], 0
        if some:
            yield from meet(some)

    found = v.mapInArrow(run, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
