"""Removal of repeated byte strings, found with sharded suffix arrays.

Sharding that loses no match: every window of ``length`` bytes has a minwise 32-byte gram, and
equal windows have equal ones. Consecutive windows with one minwise gram make a segment, and
the gram's hash is the key of its shard. Segments whose gram occurs once can match nothing and
stop there (one in which it occurs twice may match itself). Equal segments (and, before that, equal texts) are counted instead of carried. The
remaining distinct segments of a key meet in one task, which builds the suffix array by induced
sorting and the permuted common prefixes, and marks windows whose prefix with a neighbour in
suffix order reaches ``length``. Keys with very many distinct segments are dealt out again by
the hash of each whole window. Matches are always judged on the input texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, partitions, tidy
from .suffix import join_texts, plcp, suffix_array
from .textkit import _LUT, SMALL, U64, buffers, chunks, mix, ragged

GRAM = 32
CUT = 512
HOT = 4096
SHARD = 2 << 20
_M = U64(0xD1342543DE82EF95)


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-byte gram, k a power of two."""
    h, m, w = _LUT[b], int(_M), 1
    while w < k:
        h = h[:-w] * U64(m) + h[w:]
        m, w = m * m % 2**64, 2 * w
    return mix(h)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (block prefix and suffix minima)."""
    n = len(h)
    pad = np.concatenate([h, np.full(-n % w, ~U64(0), U64)]).reshape(-1, w)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def segments(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, key, may it repeat within itself) of the segments of a chunk's rows; positions in bytes of the row."""
    b, rel = data[offs[0] : offs[-1]], offs - offs[0]
    z = np.zeros(0, np.int64)
    if len(b) < length:
        return z, z, z, z, z.astype(bool)
    wide = length - GRAM + 1
    g = gram_hashes(b, GRAM)
    m = window_min(g, wide)
    n = len(m)
    size = np.diff(rel)
    edge = np.zeros(len(b) + 1, np.int8)
    ok = size >= length
    edge[rel[:-1][ok]] += 1
    edge[rel[1:][ok] - length + 1] -= 1
    valid = np.cumsum(edge[:n]).astype(bool)
    start = valid.copy()
    start[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
    start[rel[:-1][ok]] = True
    s = np.flatnonzero(start)
    row = np.searchsorted(rel, s, "right") - 1
    end = np.minimum(np.append(s[1:], n), rel[row + 1] - length + 1)
    count = end - s
    parts = -(-count // CUT)
    if len(s) and parts.max() > 1:
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        s, row, end = np.repeat(s, parts) + nth * CUT, np.repeat(row, parts), np.repeat(end, parts)
        count = np.minimum(end - s, CUT)
    # grams that are the minimum of a window around them; a segment with two equal ones may repeat within itself
    top = ~window_min(~np.concatenate([np.zeros(wide - 1, U64), m, np.zeros(wide - 1, U64)]), wide)
    at = np.flatnonzero(g == top)
    lo = np.searchsorted(at, s)
    num = np.searchsorted(at, s + count + wide - 1) - lo
    same = g[at[ragged(lo, num)]] == np.repeat(m[s], num)
    twin = np.bincount(np.repeat(np.arange(len(s)), num), weights=same, minlength=len(s)) > 1
    return row, s - rel[row], count, m[s].view(np.int64), twin


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """One row for each segment: key, seg (128-bit hash of its bytes), text (h, n), first window at, windows, weight, twin."""
    names = ["key", "seg", "h", "n", "at", "windows", "weight", "twin"]

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(0))
            n, w = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for i, j in chunks(offs, SMALL):
                row, at, count, key, twin = segments(data, offs[i : j + 1], length)
                if not len(row):
                    continue
                raw = data[offs[i] : offs[j]].tobytes()
                lo = offs[i + row] - offs[i] + at
                seg = [xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(lo.tolist(), (lo + count + length - 1).tolist())]
                r = row + i
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seg, pa.binary()), b.column(1).take(pa.array(r))] + [pa.array(x) for x in (n[r], at.astype(np.int32), count.astype(np.int32), w[r].astype(np.int32), twin)], names)

    return docs.select("text", "h", "n", "weight").where(F.col("n") >= length).mapInArrow(tidy(run), "key long, seg binary, h binary, n int, at int, windows int, weight int, twin boolean")


def runs_of(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def match(rows: list[tuple], length: int) -> list[tuple]:
    """(key, seg, from, to) of repeated windows among the rows (key, seg, windows, bytes) of a shard."""
    t, start = join_texts([r[3] for r in rows])
    sa = suffix_array(t)
    phi, lcp = plcp(t, sa)
    dup = lcp >= length
    dup[phi[dup]] = True
    out = []
    for (key, seg, windows, _), s in zip(rows, start.tolist()):
        out += [(key, seg, int(a), int(b)) for a, b in zip(*runs_of(dup[s : s + windows]))]
    return out


def shard_matches(segs: DataFrame, length: int) -> DataFrame:
    """Windows that repeat among the distinct segments of a key; segs: key, seg, windows, bytes."""

    def run(batches):
        names = ["key", "seg", "lo", "hi"]
        rows, size, last = [], 0, None

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 4, (pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] != last and size >= SHARD:
                    yield out(match(rows, length))
                    rows, size = [], 0
                rows.append(r)
                size, last = size + len(r[3]), r[0]
        if rows:
            yield out(match(rows, length))

    dealt = segs.select("key", "seg", "windows", "bytes").repartition(partitions(segs.sparkSession), "key").sortWithinPartitions("key", "seg")
    return dealt.mapInArrow(tidy(run), "key long, seg binary, lo long, hi long")


def window_matches(segs: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many segments: each window is dealt out by its own hash."""

    def run(batches):
        for b in batches:
            for key, seg, windows, raw in zip(*(c.to_pylist() for c in b.columns)):
                h = [xxhash.xxh3_128_intdigest(raw[i : i + length]) for i in range(windows)]
                cols = [pa.array([key] * windows), pa.array([seg] * windows, pa.binary()), pa.array(range(windows), pa.int64()), pa.array([(x >> 64) - (1 << 63) for x in h]), pa.array([(x & (1 << 64) - 1) - (1 << 63) for x in h])]
                yield pa.RecordBatch.from_arrays(cols, ["key", "seg", "lo", "w1", "w2"])

    w = segs.select("key", "seg", "windows", "bytes").mapInArrow(tidy(run), "key long, seg binary, lo long, w1 long, w2 long")
    twice = w.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
    return w.join(twice, ["w1", "w2"]).select("key", "seg", "lo", (F.col("lo") + 1).alias("hi"))


def repeats(spark: SparkSession, texts: DataFrame, length: int = 200, broadcast_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """(copied texts (h, n), repeated windows (h, n, spans) of other texts); texts: text, h, n, id."""
    scratch = Scratch(spark)
    small = bounded(broadcast_bytes)
    copied = scratch.cut(texts.where(F.col("n") >= length).groupBy("h", "n").agg(F.count("*").alias("c"), F.min("id").alias("first")).where("c > 1"), "copied")
    # of equal texts one enters the search, with weight 2: it is repeated whatever else matches it
    once = texts.join(small(copied), ["h", "n"], "left").where("c is null or id <=> first").withColumn("weight", F.when(F.col("c").isNull(), 1).otherwise(2))
    occ = scratch.cut(occurrences(once, length), "occurrences")
    # cut, so that the joins that follow can split a key that very many segments share
    again = scratch.cut(occ.groupBy("key").agg(F.sum("weight").alias("k"), F.max("twin").alias("twin")).where("k > 1 or twin").select("key"), "keys")
    near = scratch.cut(occ.join(again, "key"), "again")
    scratch.drop(occ, again)
    segs = near.groupBy("key", "seg").agg(F.sum("weight").alias("c"), F.max("twin").alias("twin"), F.min(F.struct("h", "n", "at", "windows")).alias("at"))
    segs = scratch.cut(segs, "segments")
    wide = scratch.cut(segs.groupBy("key").agg(F.count("*").alias("kinds"), F.max("twin").alias("twin")).where("kinds > 1 or twin").select("key", "kinds"), "kinds")
    want = scratch.cut(segs.join(wide, "key").select("key", "seg", "kinds", "at.*"), "wanted")
    held = want.groupBy("h", "n").agg(F.collect_list(F.struct("key", "seg", "kinds", "at", "windows")).alias("want"))
    bodies = texts.select("text", "h", "n").join(small(scratch.cut(want.select("h", "n").distinct(), "texts")), ["h", "n"], "left_semi").dropDuplicates(["h", "n"])

    def cut(batches):
        for b in batches:
            data, offs = buffers(b.column(0))
            rows = [(w["key"], w["seg"], w["kinds"], w["windows"], data[offs[i] + w["at"] : offs[i] + w["at"] + w["windows"] + length - 1].tobytes()) for i, ws in enumerate(b.column(1).to_pylist()) for w in ws]
            if rows:
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "seg", "kinds", "windows", "bytes"])

    cutout = scratch.cut(bodies.join(held, ["h", "n"]).select("text", "want").mapInArrow(tidy(cut), "key long, seg binary, kinds long, windows long, bytes binary"), "bodies")
    found = shard_matches(cutout.where(F.col("kinds") <= HOT), length).union(window_matches(cutout.where(F.col("kinds") > HOT), length))
    whole = segs.where("c > 1").select("key", "seg", F.lit(0).cast("long").alias("lo"), F.col("at.windows").cast("long").alias("hi"))
    found = found.join(whole.select("key", "seg"), ["key", "seg"], "left_anti").union(whole)
    found = found.groupBy("key", "seg").agg(F.collect_list(F.struct("lo", "hi")).alias("hits"))
    hits = near.join(copied.select("h", "n"), ["h", "n"], "left_anti").join(found, ["key", "seg"])
    spans = hits.select("h", "n", F.explode(F.transform("hits", lambda x: F.struct((F.col("at") + x["lo"]).alias("lo"), (F.col("at") + x["hi"]).alias("hi")))).alias("x"))
    spans = scratch.cut(spans.groupBy("h", "n").agg(F.collect_list("x").alias("spans")), "spans")
    scratch.drop(near, segs, want, cutout)
    keys = copied.select("h", "n")
    keys._rows = copied._rows
    return keys, spans


def bounded(most: int) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts a table of keys that was cut if its rows, of some 80 bytes, fit the bound."""
    return lambda df: F.broadcast(df) if df._rows * 80 <= most else df


def removed(spans: list[dict], n: int, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the spans."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length - 1)
        else:
            out.append([lo, hi + length - 1])
    return [(a, min(b, n)) for a, b in out]


def keyed(docs: DataFrame) -> DataFrame:
    """text (null: empty), h (128 bits of its digest), its bytes n, id, and the row as it was."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("id")).withColumns({"h": F.substring(F.unhex(F.sha2("text", 256)), 1, 16), "n": F.octet_length("text")})


def strip_repeats(spark: SparkSession, docs: DataFrame, length: int = 200, broadcast_bytes: int = 32 << 20, whole: bool = False) -> DataFrame:
    """Each row (struct ``row``) with kept (remaining bytes), n_bytes, n_removed, n_spans.

    With ``whole``, kept lacks what a cut left of a character, too.

    A null text is an empty one; texts below ``length`` bytes lose nothing; rows with equal texts,
    ids repeated or null, each keep their own result and remove one another's whole text: no copy of
    a tie stays as the first; very long texts are searched whole, in segments; extra columns stay inside ``row`` and cannot clash; an empty table gives an empty result.
    """
    texts = keyed(docs)
    copied, spans = repeats(spark, texts.select("text", "h", "n", "id"), length, broadcast_bytes)
    small = bounded(broadcast_bytes)
    copied = small(copied).withColumn("copy", F.lit(True))
    keys = small(spans).select("h", "n").withColumn("hit", F.lit(True))
    texts = texts.join(copied, ["h", "n"], "left").join(keys, ["h", "n"], "left")
    long = lambda x: F.lit(x).cast("long")
    body, size = F.col("text").cast("binary"), F.col("n").cast("long").alias("n_bytes")
    rest = texts.where("copy is null and hit is null").select("row", body.alias("kept"), size, long(0).alias("n_removed"), long(0).alias("n_spans"))
    copies = texts.where("copy is not null").select("row", F.lit(b"").alias("kept"), size, size.alias("n_removed"), long(1).alias("n_spans"))

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            kept, gone, count = [], [], []
            data, offs = buffers(b.column(1))
            for i, ss in enumerate(b.column(2).to_pylist()):
                raw, at, parts = data[offs[i] : offs[i + 1]].tobytes(), 0, []
                cutouts = removed(ss, len(raw), length)
                for x, y in cutouts:
                    parts.append(raw[at:x])
                    at = y
                parts.append(raw[at:])
                gone.append(len(raw) - sum(map(len, parts)))
                if whole:  # piece by piece, for two halves could make a character that was not there
                    parts = [p.decode("utf-8", "ignore").encode() for p in parts]
                kept.append(b"".join(parts))
                count.append(len(cutouts))
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks() if isinstance(t.column(0), pa.ChunkedArray) else t.column(0), pa.array(kept, pa.binary()), pa.array(np.diff(offs)), pa.array(gone, pa.int64()), pa.array(count, pa.int64())], ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    hit = texts.where("hit is not null and copy is null").join(spans, ["h", "n"]).select("row", "text", "spans")
    hit = hit.mapInArrow(tidy(run), rest.schema)
    return rest.unionByName(copies).unionByName(hit)


def suffix_dedup(spark: SparkSession, docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; see ``strip_repeats``."""
    out = strip_repeats(spark, docs.select("doc_id", "text"), length)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    """The definition, for tests: (n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), len(runs_of(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents
), w AS (SELECT doc_id, i, hash(substr(t, CAST(2 * i + 1 AS BIGINT), 400)) AS h FROM (SELECT doc_id, t, unnest(generate_series(0, length(t) // 2 - 200)) AS i FROM d WHERE length(t) >= 400)
), r AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)
), g AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS p FROM r)
), s AS (SELECT doc_id, k, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY ALL
), e AS (SELECT doc_id, k, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s
), x AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(substr(t, CAST(2 * before + 1 AS BIGINT), CAST(2 * (lo - before) AS BIGINT)), '' ORDER BY lo) AS head FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(t) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(t, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
