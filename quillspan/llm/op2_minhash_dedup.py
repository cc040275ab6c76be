"""Near-duplicate components by a chosen-path set similarity join.

Documents with equal shingle sets are one class, found by fingerprint, so copies never pair up.
Classes enter several independent trees: at the roots and in every node that branches, a class
follows picked minwise coordinates into the children of its tokens. Small nodes are compared
exhaustively by minwise sketches, in numpy; large ones in chunks of a bounded size that share
some members (pivots), and what a large node's chunks leave apart is compared with all of its
chunks if it is little, else the node branches. A first round asks for the pairs of a maximum
spanning forest only, as members of one component need no further comparison; a second one asks
for every pair that is left. Pairs are confirmed on full shingle sets, which move once for each
group of pairs that were found together; a chunk in which most pairs are in question gets the
sets of its members and compares them all at once, without a row for each pair.

Recall at similarity 0.8: two classes share Binomial(12, 0.8) root nodes, none of them with
probability 0.2^12 = 4e-9, fewer than two (then a class may be left out at once) 2e-7; a pair
fails the sketch filter (36 of 64) with probability 4e-6. Nodes that branch keep a pair with
probability above one half by root at any depth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, components, partitions, tidy
from .textkit import SMALL, U64, buffers, chunks, mix, ragged, words

COORDS = 64
ALIKE = 36
TREES, PATHS = 6, 2
CHUNK, PIVOTS, CLOSE = 512, 16, 8
BLOCK_ROWS = 1 << 15
DENSE = 4
MEMBER = ["v", "n", "lab", "side", "root", "sketch"]
_G = np.random.Generator(np.random.Philox(20260103))
_A = _G.integers(1, 2**64, COORDS, dtype=U64) | U64(1)
_B = _G.integers(1, 2**64, COORDS, dtype=U64)
ROOTS = np.concatenate([np.random.Generator(np.random.Philox([20260104, t])).choice(COORDS, PATHS, replace=False) for t in range(TREES)])


def shingles(data: np.ndarray, offs: np.ndarray, k: int = 4) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row of a chunk; fewer words: the whole sequence."""
    _, _, _, row, h = words(data, offs)
    rng = np.random.Generator(np.random.Philox(7 + k))
    c = rng.integers(1, 2**64, k + 1, dtype=U64) | U64(1)
    n = len(offs) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    acc = np.full(max(len(h) - k + 1, 0), c[k], U64)
    for i in range(k if len(acc) else 0):
        acc += h[i : i + len(acc)] * c[i]
    acc = mix(acc)
    out = []
    for f, m in zip(first.tolist(), count.tolist()):
        if m >= k:
            x = np.sort(acc[f : f + m - k + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif m:
            out.append(mix(np.array([np.sum(h[f : f + m] * c[:m]) + U64(m)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[rows, COORDS] minwise values of non-empty sets."""
    flat = np.concatenate(sets)
    lens = np.array([len(s) for s in sets])
    at = np.cumsum(lens) - lens
    out = np.empty((len(sets), COORDS), np.uint32)
    for i in range(COORDS):
        out[:, i] = np.minimum.reduceat((((flat ^ _B[i]) * _A[i]) >> U64(32)).astype(np.uint32), at)
    return out


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def features(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, n_shingles, v (class of equal sets), roots (tokens of the root coordinates), sketch (16 bits of each coordinate) of every row; the last three are null if the set is empty."""

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(1))
            for i, j in chunks(offs, SMALL):
                sets = shingles(data, offs[i : j + 1], k)
                size = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                sig = signatures(full) if full else np.zeros((0, COORDS), np.uint32)
                sketch = iter(sig.astype("<u2"))
                at = np.concatenate([[0], np.cumsum(np.where(size > 0, len(ROOTS), 0))])
                v = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())
                roots = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sig[:, ROOTS].view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size), v, roots, pa.array([next(sketch).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "n_shingles", "v", "roots", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, v long, roots array<int>, sketch binary")


def with_class(docs: DataFrame, name: str, k: int = 4) -> DataFrame:
    """The rows with their class (null if empty), as ``features`` gives it, in a column of that name."""

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(b.num_columns - 1))
            v = [fingerprint(s) if len(s) else None for i, j in chunks(offs, SMALL) for s in shingles(data, offs[i : j + 1], k)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(v, pa.int64())], [*b.schema.names[:-1], name])

    schema = docs.schema
    return docs.select("*", F.col("text").alias(name)).mapInArrow(tidy(run), type(schema)([*schema.fields]).add(name, "long"))


def full_sets(docs: DataFrame, k: int = 4) -> DataFrame:
    """(v, shingle set) of rows whose class is the wanted one (column want; null: any); repeated rows repeat it."""

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(1))
            want = b.column(0).to_pylist()
            for i, j in chunks(offs, SMALL):
                sets = ((fingerprint(s), s, w) for s, w in zip(shingles(data, offs[i : j + 1], k), want[i:j]) if len(s))
                keep = [(v, s) for v, s, w in sets if w is None or v == w]
                if keep:
                    at = np.concatenate([[0], np.cumsum([len(s) for _, s in keep])])
                    yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in keep], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([s for _, s in keep]).view(np.int64)))], ["v", "s"])

    return docs.mapInArrow(tidy(run), "v long, s array<long>")


class Group:
    """Members of consecutive groups: group number, class, set size, label, side, sketch, root (-1: none)."""

    def __init__(self, b: pa.Table):
        self.n = b.num_rows
        col = lambda c: b.column(c).to_numpy()
        self.key = np.stack([col("node"), col("chunk"), col("block")], 1)
        self.gid = np.cumsum(np.append(True, (self.key[1:] != self.key[:-1]).any(1))) - 1 if self.n else np.zeros(0, np.int64)
        self.first = np.flatnonzero(np.append(True, self.gid[1:] != self.gid[:-1])) if self.n else np.zeros(0, np.int64)
        self.num = np.diff(np.append(self.first, self.n))
        self.v, self.size, self.side, self.root = col("v"), col("n"), col("side"), col("root")
        self.labels, self.lab = np.unique(col("lab"), return_inverse=True)
        self.sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), "<u2").reshape(self.n, COORDS)

    def fits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Different labels, and opposite sides where sides are given."""
        return (self.lab[i] != self.lab[j]) & ((self.side[i] != self.side[j]) | (self.side[i] < 0))

    def first_root(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """True where the group's root is the first that both share: a pair counts in one root node only."""
        r = self.root[i]
        same = self.sketch[i][:, ROOTS] == self.sketch[j][:, ROOTS]
        return (r < 0) | (np.where(same.any(1), same.argmax(1), r) == r)

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, agreeing coordinates) of all pairs within groups that may be similar."""
        found = []

        def keep(i, j):
            ok = self.fits(i, j) & (100 * np.minimum(self.size[i], self.size[j]) >= percent * np.maximum(self.size[i], self.size[j]))
            i, j = i[ok], j[ok]
            agree = (self.sketch[i] == self.sketch[j]).sum(1)
            ok = agree >= ALIKE
            i, j, agree = i[ok], j[ok], agree[ok]
            ok = self.first_root(i, j)
            found.append((i[ok], j[ok], agree[ok]))

        # row r of a group against those after it
        after = (self.first + self.num)[self.gid] - np.arange(self.n) - 1
        total = np.cumsum(after)
        lo = 0
        while lo < self.n:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 16), "right")))
            keep(np.repeat(np.arange(lo, hi), after[lo:hi]), ragged(np.arange(lo, hi) + 1, after[lo:hi]))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def forest(self, i: np.ndarray, j: np.ndarray, agree: np.ndarray) -> np.ndarray:
        """Indices of the pairs of a maximum spanning forest of labels."""
        up = list(range(len(self.labels)))

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        out = []
        order = np.argsort(-agree, kind="stable")
        for k, a, b in zip(order.tolist(), self.lab[i[order]].tolist(), self.lab[j[order]].tolist()):
            a, b = top(a), top(b)
            if a != b:
                up[a] = b
                out.append(k)
        return np.array(out, np.int64)


GROUP = ["node", "chunk", "block"]


def by_group(batches, least: int, work):
    """Calls work on tables of whole consecutive groups, of at least so many rows but for the last."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([t.column(c).to_numpy() for c in GROUP], 1)
            last = np.flatnonzero((key != key[-1]).any(1))  # the last group may go on
            if len(last):
                yield work(t.slice(0, last[-1] + 1))
                t = t.slice(last[-1] + 1)
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield work(pa.Table.from_batches(held).combine_chunks())


def candidates(members: DataFrame, percent: int, forest: bool, dense: int = DENSE) -> DataFrame:
    """(node, chunk, block, a, b) of pairs to confirm within the groups; with ``forest`` those that may span them.

    members: node, chunk, block, v, n, lab, side, root, sketch. A group with more than
    ``dense`` pairs for each member is named instead, with a and b null: its sets should come to it.
    """
    n = partitions(members.sparkSession)

    def work(t):
        g = Group(t)
        i, j, agree = g.pairs(percent)
        if forest:
            k = g.forest(i, j, agree)
            i, j = i[k], j[k]
        own = g.gid[i]
        many = np.bincount(own, minlength=len(g.first)) > dense * g.num
        keep = ~many[own]
        i, j, named = i[keep], j[keep], g.first[many]
        at = np.concatenate([i, named])
        none = np.append(np.zeros(len(i), bool), np.ones(len(named), bool))
        ends = [pa.array(np.concatenate([f(g.v[i], g.v[j]), np.zeros(len(named), np.int64)]), mask=none) for f in (np.minimum, np.maximum)]
        return pa.RecordBatch.from_arrays([pa.array(g.key[at, c]) for c in range(3)] + ends, [*GROUP, "a", "b"])

    dealt = members.select(*GROUP, *MEMBER).repartition(n, *GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(tidy(lambda batches: by_group(batches, BLOCK_ROWS, work)), "node long, chunk long, block long, a long, b long")


def links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span what is similar in the groups, compared exhaustively on their sets; members as for ``candidates``, and s."""
    n = partitions(members.sparkSession)

    def work(t):
        g = Group(t)
        sets = t.column("s").combine_chunks()
        flat, at = sets.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        out = []
        for f, m in zip(g.first.tolist(), g.num.tolist()):
            found = similar(flat[at[f] : at[f + m]], at[f : f + m + 1] - at[f], percent)
            i, j = (x + f for x in np.nonzero(np.triu(found, 1)))
            ok = g.fits(i, j) & g.first_root(i, j)
            out.append((i[ok], j[ok]))
        i, j = (np.concatenate(x) for x in zip(*out))
        k = g.forest(i, j, np.zeros(len(i)))
        a, b = g.v[i[k]], g.v[j[k]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = members.select(*GROUP, *MEMBER, "s").repartition(n, *GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(tidy(lambda batches: by_group(batches, 1, work)), "a long, b long")


def similar(flat: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets flat[at[i]:at[i + 1]] reach the similarity with which: their common members counted by products of 0-1 matrices."""
    m = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(m), size)
    _, col, num = np.unique(flat, return_inverse=True, return_counts=True)
    often = num > 1  # what only one set holds is in no intersection
    keep = often[col]
    row, col = row[keep], (np.cumsum(often) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    same = np.zeros((m, m), np.float32)
    for lo in range(0, int(often.sum()), 4096):
        x, y = np.searchsorted(col, [lo, lo + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[row[x:y], col[x:y] - lo] = 1
        same += part @ part.T
    return 100 * same >= percent * (size[:, None] + size - same)


def confirm(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the similarity; rows: tag, v, s of the sets of each tag and then (v, s null) its pairs a, b."""
    n = partitions(rows.sparkSession)

    def run(batches):
        sets, last = {}, None
        for batch in batches:
            tag, v, a, b = (batch.column(c).to_pylist() for c in (0, 1, 3, 4))
            flat, at = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().fill_null(0).to_numpy())]).tolist()
            out = []
            for i, t in enumerate(tag):
                if t != last:
                    sets, last = {}, t
                if v[i] is not None:
                    sets[v[i]] = flat[at[i] : at[i + 1]].view(U64).copy()
                    continue
                x, y = sorted((sets[a[i]], sets[b[i]]), key=len)
                same = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                if 100 * same >= percent * (len(x) + len(y) - same):
                    out.append((a[i], b[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    dealt = rows.select("tag", "v", "s", "a", "b").repartition(n, "tag").sortWithinPartitions("tag", F.col("v").asc_nulls_last())
    return dealt.mapInArrow(tidy(run), "a long, b long")


def near_components(spark: SparkSession, docs: DataFrame, k: int = 4, percent: int = 80, chunk: int = CHUNK, depth: int = 12, dense: int = DENSE, rows: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; with ``rows``, its class v and the root class of its component too.

    Null or blank texts have no shingles and stand alone; very long texts enter whole. Null ids
    pass through (they never name a component unless all of its rows have a null id); repeated
    rows are copies, one result row each; of equal pairs and ties nothing depends on the order;
    other columns are ignored; an empty table gives an empty result. ``kept`` compares ids
    null-safely. Vertices are 64-bit set fingerprints. ``chunk`` bounds the members that are
    compared at once; at ``depth`` nodes branch no more and are compared chunk by chunk; chunks with
    more than ``dense`` pairs for each member are compared on their sets in place.
    """
    scratch = Scratch(spark)
    feats = scratch.cut(features(docs, k), "features")
    classes = feats.where("v is not null").groupBy("v").agg(F.min("doc_id").alias("m"), F.first("n_shingles").alias("n"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch"))
    classes = scratch.cut(scratch.fit(classes, feats._rows, 300), "classes")

    nodes = classes.select("v", F.posexplode("roots").alias("root", "token")).select("v", "root", F.xxhash64(F.lit(0), "root", "token").alias("node"))
    nodes = scratch.cut(scratch.fit(crowded(nodes), classes._rows * len(ROOTS), 16), "nodes")
    # a class with a partner shares most of its root nodes
    live = scratch.fit(nodes.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v"), nodes._rows)
    first = nodes
    nodes = nodes.join(scratch.small(live, rows=nodes._rows // 2), "v").select("node", "v", "root")
    nodes = scratch.cut(scratch.fit(crowded(nodes), first._rows), "nodes")
    scratch.drop(first)
    attrs = classes.join(scratch.small(nodes.select("v").distinct(), rows=nodes._rows), "v").select("v", "m", "n", "sketch")
    attrs = scratch.cut(scratch.fit(attrs, classes._rows, 300), "attrs", unnamed=F.count_if(F.col("m").isNull()))
    reps = scratch.small(attrs, 24, attrs._rows).select(F.col("v").alias("want"), F.col("m").alias("rep")).where("rep is not null")
    named = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep is not null")
    sets = full_sets(named.join(reps, "rep").select("want", "text"), k)
    if attrs._seen["unnamed"]:
        nameless = full_sets(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("want"), "text"), k)
        sets = sets.union(nameless.join(attrs.where("m is null").select("v"), "v", "left_semi"))
    sets = scratch.cut(sets, "sets")
    if sets._rows > attrs._rows:  # rows that repeat an id and its text
        twice, sets = sets, scratch.cut(sets.groupBy("v").agg(F.first("s").alias("s")), "sets")
        scratch.drop(twice)

    tested = spark.createDataFrame([], "a long, b long")
    labels, known = None, 0

    def verify(found: DataFrame, most: int) -> None:
        """Confirm pairs that were not tested before."""
        nonlocal tested, known
        found = found.where("a is not null").withColumn("tag", F.xxhash64(*GROUP))
        pairs = scratch.fit(found.groupBy("a", "b").agg(F.min("tag").alias("tag")), most)
        if known:
            pairs = pairs.join(scratch.small(tested, rows=known), ["a", "b"], "left_anti")
        pairs = scratch.cut(pairs, "pairs")
        if not pairs._rows:
            return
        need = pairs.select("tag", F.explode(F.array("a", "b")).alias("v")).distinct()
        # wanted names go to the sets, which do not move for this as long as the names fit a broadcast
        there = sets.join(scratch.small(need, rows=2 * pairs._rows), "v")
        tested, known = tested.union(pairs.select("a", "b")), known + pairs._rows
        null = lambda t: F.lit(None).cast(t)
        both = there.select("tag", "v", "s", null("long").alias("a"), null("long").alias("b")).union(pairs.select("tag", null("long"), null("array<long>"), "a", "b"))
        connect(scratch.cut(confirm(both, percent), "found"))

    def connect(new: DataFrame) -> None:
        """Renew the labels by new links."""
        nonlocal labels
        if new._rows:
            old, labels = labels, components(spark, scratch, new if labels is None else new.union(labels.select(F.col("v").alias("a"), F.col("root").alias("b"))))
            scratch.drop(new, *([] if old is None else [old]))

    def labelled(nodes: DataFrame) -> DataFrame:
        """Nodes of several components: node, v, root, lab, most (the commonest label), size, rest (members outside it)."""
        lab = nodes.select("node", "v", "root", F.col("v").alias("lab"))
        if labels is not None:
            tops = scratch.small(labels.select("v", F.col("root").alias("top")), rows=labels._rows)
            lab = nodes.join(tops, "v", "left").select("node", "v", "root", F.coalesce("top", "v").alias("lab"))
        kinds = lab.groupBy("node", "lab").agg(F.count("*").alias("c")).groupBy("node")
        kinds = kinds.agg(F.sum("c").alias("size"), F.max(F.struct("c", "lab")).alias("most"), F.count("*").alias("labs")).where("labs > 1")
        kinds = kinds.select("node", "size", F.col("most.lab").alias("most"), (F.col("size") - F.col("most.c")).alias("rest"))
        kinds = scratch.cut(scratch.fit(kinds, nodes._rows), "kinds")
        out = scratch.cut(scratch.fit(lab.join(scratch.small(kinds, 40, kinds._rows), "node"), nodes._rows), "labelled", open=F.count_if(F.col("rest") > CLOSE * chunk), large=F.count_if(F.col("size") > chunk))
        scratch.drop(kinds)
        return out

    def number(count: str) -> F.Column:
        """A power of two of chunks for so many members."""
        return F.expr(f"shiftleft(1L, int(ceil(log2(greatest(1D, {count} / {chunk})))))")

    def members(nodes: DataFrame) -> DataFrame:
        return nodes.join(scratch.small(attrs, 200).select("v", "n", "sketch"), "v")

    level = 0
    while nodes._rows:
        # spanning pairs: chunks of a node share its pivots
        some = labelled(nodes)
        if level == 0:
            scratch.drop(nodes)
        if not some._rows:
            break
        part = some.withColumn("chunks", number("size")).withColumn("chunk", F.pmod(F.xxhash64("v", F.lit(level)), "chunks"))
        if some._seen["large"]:
            pick = part.where("chunks > 1").groupBy("node", "chunks").agg(F.array(*[F.min_by(F.struct("v", "root", "lab"), F.xxhash64("v", F.lit(1000 * level + i))) for i in range(PIVOTS)]).alias("p"))
            pick = pick.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.array_distinct("p").alias("p")).select("node", "chunk", F.explode("p").alias("p"))
            part = part.select("node", "chunk", "v", "root", "lab").union(pick.select("node", "chunk", "p.v", "p.root", "p.lab"))
        one = F.lit(-1)
        verify(candidates(members(part.select("node", "chunk", "v", "root", "lab")).withColumns({"block": F.lit(0).cast("long"), "side": one}), percent, True), some._rows)
        # every pair that is left, of members outside a node's largest component against all
        left = labelled(_rows(some.select("node", "v", "root"), some._rows))
        scratch.drop(some)
        if not left._rows:
            break
        few = left if level == depth else left.where(F.col("rest") <= CLOSE * chunk)
        few = few.withColumns({"chunks": number("size"), "blocks": number("rest")}).withColumns({"chunk": F.pmod(F.xxhash64("v", F.lit(level)), "chunks"), "block": F.pmod(F.xxhash64("v", F.lit(-1 - level)), "blocks")})
        to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        here = few.select("node", "chunk", to("blocks").alias("block"), "v", "root", "lab", F.lit(0).alias("side"))
        there = few.where("lab <> most").select("node", to("chunks").alias("chunk"), "block", "v", "root", "lab", F.lit(1).alias("side"))
        both = members(here.union(there))
        found = scratch.cut(candidates(both, percent, False, dense), "candidates", dense=F.count_if(F.col("a").isNull()))
        verify(found, found._rows)
        if found._seen["dense"]:
            where = found.where("a is null").select(*GROUP).distinct()
            crowd = scratch.cut(both.join(scratch.small(where, 40, found._seen["dense"]), GROUP, "left_semi"), "crowd")
            # only the sets of dense chunks move
            theirs = sets.join(scratch.small(crowd.select("v").distinct(), rows=crowd._rows), "v", "left_semi")
            connect(scratch.cut(links(crowd.join(theirs, "v"), percent), "found"))
            scratch.drop(crowd)
        scratch.drop(found)
        if level == depth or not left._seen["open"]:
            break
        # one coordinate always, a second one for half of the nodes
        c = [F.pmod(F.xxhash64("node", F.lit(i)), F.lit(COORDS)).cast("int") for i in (1, 2)]
        kid = [F.xxhash64("node", x, F.substring("sketch", 2 * x + 1, F.lit(2))) for x in c]
        twice = (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(2)) == 0) & (c[0] != c[1])
        kids = members(left.where(F.col("rest") > CLOSE * chunk).select("node", "v")).select("v", F.lit(-1).alias("root"), F.explode(F.when(twice, F.array(*kid)).otherwise(F.array(kid[0]))).alias("node"))
        nodes = scratch.cut(scratch.fit(crowded(kids), 2 * left._rows), "nodes")
        scratch.drop(left)
        level += 1

    comp = classes.select("v", "m")
    if labels is None:
        comp = comp.select("v", F.col("m").alias("component_id"), F.col("v").alias("root"))
    else:
        comp = comp.join(scratch.small(labels), "v", "left").select("v", "m", F.coalesce("root", "v").alias("root"))
        low = scratch.fit(comp.where("root <> v").groupBy("root").agg(F.min("m").alias("lo")), labels._rows)
        comp = comp.join(scratch.small(low, rows=labels._rows), "root", "left").select("v", F.coalesce(F.least("m", "lo"), "m", "lo").alias("own"), "root", "m", "lo")
        # the root's own id counts too: every member takes the least of its root's and the members'
        top = comp.where("root = v and lo is not null").select("root", F.col("own").alias("top"))
        comp = comp.join(scratch.small(top, rows=labels._rows), "root", "left").select("v", F.coalesce("top", "m").alias("component_id"), "root")
    extra = ["v", "root"] if rows else []
    comp = scratch.cut(scratch.fit(comp.select("v", "component_id", *extra[1:]), classes._rows, 24), "comp")
    scratch.drop(classes, attrs, sets)
    out = feats.select("doc_id", "n_shingles", "v").join(scratch.small(comp), "v", "left")
    own = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), *extra).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _rows(df: DataFrame, rows: int) -> DataFrame:
    df._rows = rows
    return df


def crowded(nodes: DataFrame) -> DataFrame:
    """Rows (node, v, root) of nodes with two members at least."""
    size = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").select("node")
    return nodes.join(size, "node").select("node", "v", "root")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * p.i >= 80 * (a.n + b.n - p.i)
), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""
