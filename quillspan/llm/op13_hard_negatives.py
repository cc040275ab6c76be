"""Hard negatives: rows of another label that score nearly as high as an anchor's own positives.

Vectors become integers floor(256 x). They are also rotated to the principal axes of a bounded
sample: an orthogonal map keeps inner products, and puts most of a vector's length into its leading
components. The product of the leading components plus and minus the product of the residual norms
encloses a score; a slack for rounding is added. Pairs whose enclosure lies outside every window
still open are discarded, from few components to more, and integer products verify what is left.
The axes decide only how many pairs are discarded, never which rows come out.

Anchors stay in the shared folder and tasks read them from there in blocks; candidates stay in the
partitions they were written in. Neither passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .op3_training_order import filesystem
from .op8_exact_topk import exact
from .store import Scratch, partitions

SAMPLE = 4096  # rows that the axes are fitted on
AXES, WIDEST = 4, 1024  # lengths of vectors that get axes, and the longest of them; others keep their own
STEPS = (8, 4, 2)  # one eighth, one quarter, one half of the components
BLOCK, SUB, CHUNK_BYTES = 512, 2048, 64 << 20
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def axes(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Orthogonal matrix by length of the vectors: principal axes about the origin, longest first."""
    of: dict[int, list[np.ndarray]] = {}
    for x in sample:
        of.setdefault(len(x), []).append(x)
    out = {}
    for d in sorted((d for d in of if 1 < d <= WIDEST), key=lambda d: (-len(of[d]), d))[:AXES]:
        x = np.stack(of[d]).astype(float)
        out[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


class Side:
    """Vectors of one length, rotated, with the norms of what follows each step's leading components."""

    def __init__(self, v: np.ndarray, rotation: np.ndarray | None):
        self.v = v
        f = v.astype(float)
        self.r = f if rotation is None else f @ rotation
        d = v.shape[1]
        self.steps = sorted({d // s for s in STEPS} - {0})
        self.rest = [np.linalg.norm(self.r[:, k:], axis=1) for k in self.steps]
        # rotation and products each err by at most d units of rounding relative to the norms, as do the norms; eight times that is allowed
        self.norm = np.linalg.norm(f, axis=1) * np.sqrt(8 * d * (d + 4) * np.finfo(float).eps)


class Windows:
    """The k best candidates of each window [low, high] of scores of each anchor of a block; ties to the smaller id."""

    def __init__(self, side: Side, label: np.ndarray, rid: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.q, self.label, self.rid, self.high, self.k, self.same = side, label, rid, high, k, same
        self.need = low.copy()  # rises to the k-th best score of a window once that is known
        self.at = self.id = self.score = np.zeros(0, np.int64)
        self.left = np.zeros(len(side.steps) + 2, np.int64)  # pairs, those that each bound left, and those that came through

    def feed(self, x: Side, label: np.ndarray, ids: np.ndarray, rid: np.ndarray) -> None:
        lo, size = 0, 64
        while lo < len(x.v):
            some = slice(lo, lo + size)
            self._feed(x, some, label[some], ids[some], rid[some])
            lo, size = lo + size, min(2 * size, SUB)

    def _open(self, under: np.ndarray, over: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether the score enclosed by [under, over] may still enter a window of its anchor."""
        out = np.zeros(over.shape, bool)
        for j in range(self.need.shape[1]):
            out |= (over >= self.need[rows, j, None]) & (under <= self.high[rows, j, None])
        return out

    def _feed(self, x: Side, some: slice, label: np.ndarray, ids: np.ndarray, rid: np.ndarray) -> None:
        rows, cols = np.flatnonzero((self.need <= self.high).any(1)), np.arange(len(ids))
        alive = (self.label[rows, None] == label[None]) == self.same
        alive &= self.rid[rows, None] != rid[None]
        self.left[0] += alive.sum()
        part, done = np.zeros(alive.shape), 0
        for step, k in enumerate(self.q.steps):
            a, b = alive.any(1), alive.any(0)
            if not a.any():
                return
            if not (a.all() and b.all()):
                rows, cols, alive, part = rows[a], cols[b], alive[np.ix_(a, b)], part[np.ix_(a, b)]
            part += self.q.r[rows, done:k] @ x.r[some][cols, done:k].T
            done = k
            off = np.outer(self.q.rest[step][rows], x.rest[step][some][cols]) + np.outer(self.q.norm[rows], x.norm[some][cols])
            alive &= self._open(part - off, part + off, rows)
            self.left[1 + step] += alive.sum()
        a, b = alive.any(1), alive.any(0)
        if not a.any():
            return
        rows, cols, alive = rows[a], cols[b], alive[np.ix_(a, b)]
        s = exact(self.q.v[rows], x.v[some][cols])
        found = []
        for j in range(self.need.shape[1]):
            r, c = np.nonzero(alive & (s >= self.need[rows, j, None]) & (s <= self.high[rows, j, None]))
            found.append((rows[r] * self.need.shape[1] + j, ids[cols[c]], s[r, c]))
        at, vec, score = (np.concatenate(y) for y in zip(*found))
        self.left[-1] += len(at)
        if not len(at):
            return
        touched = np.zeros(self.need.size, bool)
        touched[at] = True
        mine = touched[self.at]
        at, vec, score = np.concatenate([self.at[mine], at]), np.concatenate([self.id[mine], vec]), np.concatenate([self.score[mine], score])
        order = np.lexsort((vec, -score, at))
        at, vec, score = at[order], vec[order], score[order]
        num = np.bincount(at, minlength=self.need.size)
        rank = np.arange(len(at)) - (np.cumsum(num) - num)[at]
        last = rank == self.k - 1
        self.need.reshape(-1)[at[last]] = score[last]
        keep = rank < self.k
        self.at, self.id, self.score = (np.concatenate([old[~mine], new[keep]]) for old, new in ((self.at, at), (self.id, vec), (self.score, score)))


def by_length(b: pa.RecordBatch | pa.Table, rotations: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, Side]]:
    """(row numbers, vectors) of each length."""
    v = b.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = np.diff(v.offsets.to_numpy())
    flat, at = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
    for d in np.unique(size):
        some = np.flatnonzero(size == d)
        yield some, Side(flat[at[some][:, None] + np.arange(d)].astype(np.int64), rotations.get(int(d)))


def search(vectors: DataFrame, asks: str, rotations: dict[int, np.ndarray], k: int, same: bool) -> DataFrame:
    """anchor, goal, vec_id, score: the k best candidates of each partition for each window of the anchors in the table at ``asks``.

    Anchors have rid, label, v and goals: scores of positives, whose windows are theirs from three
    to nine tenths, or none, for the whole range.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(rotations)  # at most AXES square matrices of WIDEST

    def blocks():
        import pyarrow.dataset as ds

        store, where = filesystem(asks)
        for b in ds.dataset(where, filesystem=store, format="parquet").to_batches(batch_size=BLOCK):
            if b.num_rows:
                yield b

    def meet(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(some)
        label, ids, rid = (t.column(c).to_numpy() for c in ("label", "vec_id", "rid"))
        held = {x.v.shape[1]: (at, x) for at, x in by_length(t, shared.value)}
        for b in blocks():
            goals = b.column("goals")
            num, flat = np.diff(goals.offsets.to_numpy()), goals.flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(num) - num
            a_label, a_rid = b.column("label").to_numpy(), b.column("rid").to_numpy()
            for rows, q in by_length(b, shared.value):
                if q.v.shape[1] not in held:
                    continue
                at, x = held[q.v.shape[1]]
                if same:
                    goal, low, high = np.zeros((len(rows), 1), np.int64), np.full((len(rows), 1), LEAST), np.full((len(rows), 1), MOST)
                else:
                    width = int(num[rows].max(initial=0))
                    if not width:
                        continue
                    there = np.arange(width) < num[rows][:, None]
                    goal = np.where(there, flat[np.minimum(first[rows][:, None] + np.arange(width), max(len(flat) - 1, 0))], 0)
                    low, high = np.where(there, -((-30 * goal) // 100), MOST), np.where(there, 90 * goal // 100, LEAST)
                groups = [(np.arange(len(rows)), np.arange(len(at)))]
                if same:  # only rows of one label meet
                    groups = [(np.flatnonzero(a_label[rows] == y), np.flatnonzero(label[at] == y)) for y in np.unique(a_label[rows])]
                for mine, theirs in groups:
                    own = Windows(part(q, mine), a_label[rows][mine], a_rid[rows][mine], low[mine], high[mine], k, same)
                    own.feed(x if len(theirs) == len(at) else part(x, theirs), label[at[theirs]], ids[at[theirs]], rid[at[theirs]])
                    r, j = np.divmod(own.at, low.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(a_rid[rows][mine][r]), pa.array(goal[mine][r, j]), pa.array(own.id), pa.array(own.score)], ["anchor", "goal", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for b in batches:
            some.append(b)
            size += b.nbytes
            if size >= CHUNK_BYTES:
                yield from meet(some)
                some, size = [], 0
        if some:
            yield from meet(some)

    return vectors.mapInArrow(run, "anchor long, goal long, vec_id long, score long")


def part(s: Side, rows: np.ndarray) -> Side:
    """Some rows of a side."""
    out = Side.__new__(Side)
    out.v, out.r, out.steps, out.rest, out.norm = s.v[rows], s.r[rows], s.steps, [x[rows] for x in s.rest], s.norm[rows]
    return out


def hard_negatives(spark: SparkSession, vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``; labels of ids divisible by 7 are moved to
    (label + 1) % 10 first. Rows with a null id or label, a null vector, or a null or non-finite
    component take no part; vectors meet only those of their own length, however long; components
    whose integer needs more than 31 bits are an error. A repeated id is a row of its own each time,
    as anchor, positive and negative. Ties go to the smaller id; other columns are ignored; an empty
    table, a label with one row, and a positive score below 0 (whose window is empty) give no rows.
    """
    scratch = Scratch(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    v = v.where("vec_id is not null and label is not null and e is not null")
    v = v.where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = F.transform("e", lambda x: F.floor(x * 256))
    over = F.exists(whole, lambda x: F.abs(x) >= 2**31)
    v = v.select("vec_id", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), F.when(over, F.raise_error(F.lit("a component does not fit in 31 bits"))).otherwise(whole).cast("array<int>").alias("v"))
    if v.rdd.getNumPartitions() < partitions(spark):  # a small table; a large one stays as it was read
        v = v.repartition(partitions(spark))
    v = scratch.cut(v.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    sample = v.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("v").toArrow().column(0)
    rotations = axes([np.array(x, np.int64) for x in sample.to_pylist()])
    asks = scratch.cut(v.where(F.col("vec_id") % every == 0).withColumn("goals", F.array().cast("array<long>")), "asks")
    best = lambda df, k, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
    own = scratch.cut(best(search(v, asks._scratch, rotations, positives, True), positives, "anchor").select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal")), "positives")
    goals = own.groupBy("anchor").agg(F.collect_set("goal").alias("goals"))  # at most ``positives`` an anchor
    asks2 = scratch.cut(asks.drop("goals").join(goals, asks["rid"] == goals["anchor"]).drop("anchor"), "goals")
    found = best(search(v, asks2._scratch, rotations, negatives, False), negatives, "anchor", "goal")
    names = asks.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = own.join(names, "anchor").join(found, ["anchor", "goal"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("goal").alias("positive_score"), F.col("score").alias("negative_score"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid AS anchor, q.vec_id AS anchor_id, c.rid, c.vec_id, q.label = c.label AS same, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
