"""Token-id output in training order: fixed-stride binary shards under a keyed permutation.

Texts become token ids with an end id, cut into sequences of ``length`` ids within each input
partition. A first pass counts the sequences of each partition; a sequence's index is its
partition's offset plus its place. A keyed Feistel network over the next even power of two,
walked until it falls below the total, permutes indices to global slots, so the order needs no
table and any slot's sequence can be named from the key. Range partitions of slots are sorted
and written as shards: ``rows`` records of a fixed stride, so that slot s is at byte
``(s % rows) * stride`` of shard ``s // rows``; reading is sequential and resumes anywhere.
A shard is written under a temporary name and then renamed: a lost task leaves no half shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretok
from .op9_packing import END, with_end
from .store import Scratch
from .textkit import U64, buffers, chunks, mix

ROUNDS = 6
RANGES, RANGE_SHARDS = 4096, 32  # partitions from which on one holds several shards, and how many at most


def feistel(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Keyed permutation of 0 .. n-1 (its inverse with ``back``), by cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = U64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key & (1 << 64) - 1))
    out = x.astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        a, b = v >> U64(half), v & low
        for k in keys[::-1] if back else keys:
            if back:
                a, b = b ^ (mix(a ^ k) & low), a
            else:
                a, b = b, a ^ (mix(b ^ k) & low)
        out[todo] = v = (a << U64(half)) | b
        todo = todo[v >= U64(n)]
    return out.astype(np.int64)


def sequences(batches, length: int, path: str | None):
    """(ids, doc ids) of each sequence of a partition, in order; the last one may be short."""
    held, docs, size = [], [], 0
    for b in batches:
        data, offs = buffers(b.column(1))
        doc = b.column(0).to_pylist()
        for i, j in chunks(offs):
            ids, at = with_end(*pretok.token_ids(data, offs[i : j + 1], path))
            for r in range(i, j):
                own, k = ids[at[r - i] : at[r - i + 1]], 0
                while k < len(own):
                    take = min(length - size, len(own) - k)
                    held.append(own[k : k + take])
                    if not docs or docs[-1] != doc[r]:
                        docs.append(doc[r])
                    size, k = size + take, k + take
                    if size == length:
                        yield np.concatenate(held), docs
                        held, docs, size = [], [], 0
        held = [np.array(x) for x in held]
    if size:
        yield np.concatenate(held), docs


def two_bytes(ids: np.ndarray) -> bytes:
    if len(ids) and ids.max() > 65535:
        raise ValueError("a token id does not fit in two bytes")
    return ids.astype("<u2").tobytes()


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_order(spark: SparkSession, docs: DataFrame, root: str, length: int = 1024, rows: int = 4096, key: int = 20260107, path: str | None = None) -> tuple[DataFrame, int]:
    """Write the shards under ``root`` and return (manifest: slot, n_tokens, doc_ids; number of sequences).

    The partitions of ``docs`` must come out alike when read again, as those of files do; a
    difference is an error.
    """
    from pyspark import TaskContext

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(batches):
        total = 0
        for b in batches:
            data, offs = buffers(b.column(1))
            total += sum(len(pretok.token_ids(data, offs[i : j + 1], path)[0]) + j - i for i, j in chunks(offs))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([-(-total // length)], pa.int64())], ["part", "n"])

    counts = {r["part"]: r["n"] for r in texts.mapInArrow(count, "part long, n long").collect()}  # one row for a partition
    total, base = 0, {}
    for p in sorted(counts):
        base[p] = total
        total += counts[p]
    shared = spark.sparkContext.broadcast((base, counts, total))

    def cut(batches):
        base, counts, total = shared.value
        part = TaskContext.get().partitionId()
        n, some = 0, []

        def out():
            slot = feistel(base[part] + n - len(some) + np.arange(len(some)), total, key)
            cols = [pa.array(slot), pa.array([len(x) for x, _ in some], pa.int32()), pa.array([two_bytes(x) for x, _ in some], pa.binary()), pa.array([d for _, d in some], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["slot", "n_tokens", "ids", "doc_ids"])

        for x in sequences(batches, length, path):
            some.append(x)
            n += 1
            if len(some) == 512:
                yield out()
                some = []
        if n != counts.get(part, 0):
            raise RuntimeError("the input's partitions changed between the passes")
        if some:
            yield out()

    seqs = texts.mapInArrow(cut, "slot long, n_tokens int, ids binary, doc_ids array<long>")
    stride = 4 + 2 * length
    shards = max(1, -(-total // rows))
    # a partition is a range of whole shards, more of them the more there are: sizes are known, so nothing is sampled
    each = min(RANGE_SHARDS, max(1, shards // RANGES))
    seqs = seqs.withColumn("shard", F.expr(f"slot div {rows}")).repartitionById(-(-shards // each), F.expr(f"cast(shard div {each} as int)")).sortWithinPartitions("slot")

    def write(batches):
        store, where = filesystem(root)
        store.create_dir(where)
        state = {"shard": None, "file": None, "tmp": ""}

        def close():
            if state["file"] is not None:
                state["file"].close()
                store.move(state["tmp"], f"{where}/shard-{state['shard']:08d}.bin")
                state["file"] = None

        for b in batches:
            slots, ns, ids, of = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(4).to_numpy()
            for i in range(b.num_rows):
                if of[i] != state["shard"]:
                    close()
                    state["shard"] = int(of[i])
                    state["tmp"] = f"{where}/.part-{state['shard']:08d}-{TaskContext.get().taskAttemptId()}"
                    state["file"] = store.open_output_stream(state["tmp"])
                raw = ids[i].as_buffer().to_pybytes()
                state["file"].write(int(ns[i]).to_bytes(4, "little") + raw.ljust(stride - 4, b"\0"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3)], ["slot", "n_tokens", "doc_ids"])
        close()

    return seqs.select("slot", "n_tokens", "ids", "doc_ids", "shard").mapInArrow(write, "slot long, n_tokens int, doc_ids array<long>"), total


def read_order(spark: SparkSession, root: str, length: int = 1024, rows: int = 4096, start: int = 0) -> DataFrame:
    """slot, shard, byte_offset, n_tokens, ids_crc32 of every record from slot ``start`` on, read from the shards."""
    stride = 4 + 2 * length
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(root).select("path", "content")
    files = files.where(F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long") >= start // rows)

    def run(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1)):
                shard, raw = int(p.rsplit("-", 1)[1][:-4]), raw.as_buffer()
                rec = np.frombuffer(raw, np.uint8).reshape(-1, stride)
                n = rec[:, :4].copy().view("<u4")[:, 0]
                slot = shard * rows + np.arange(len(rec))
                crc = [zlib.crc32(np.frombuffer(r[4 : 4 + 2 * int(k)].tobytes(), "<u2").astype("<u4").tobytes()) for r, k in zip(rec, n)]
                keep = slot >= start
                cols = [slot, np.full(len(rec), shard), np.arange(len(rec)) * stride, n.astype(np.int64), np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], ["slot", "shard", "byte_offset", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "slot long, shard long, byte_offset long, n_tokens long, ids_crc32 long")


def training_order(spark: SparkSession, docs: DataFrame, length: int = 1024, rows: int = 4096, key: int = 20260107, path: str | None = None) -> DataFrame:
    """Every sequence as read back from the shards, with the documents whose tokens it holds.

    A null or empty text is one end id; null and repeated doc_ids are written row by row, in a
    row's place; a very long text is cut into as many sequences as it fills; no two sequences tie,
    as each has a slot of its own; other columns are ignored; an empty table writes nothing and
    gives no rows. Ids are two bytes: one above 65,535 is an error.
    """
    scratch = Scratch(spark)
    root = scratch.path("shards")
    manifest, total = write_order(spark, docs, root, length, rows, key, path)
    manifest = scratch.cut(manifest, "manifest")
    if not total:
        return spark.createDataFrame([], "slot long, shard long, byte_offset long, n_tokens long, ids_crc32 long, doc_ids array<long>")
    return read_order(spark, root, length, rows).join(manifest.select("slot", "doc_ids"), "slot")
