"""The operators on Spark: brute force, round trips, and rows with nulls, ties, repeats, odd columns or none at all."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import op2_minhash_dedup as near
from quillspan.llm import op3_training_order as order
from quillspan.llm import op5_chat_format as chat
from quillspan.llm import op6_suffix_dedup as suffix6
from quillspan.llm import pretok
from quillspan.llm.op1_toxicity import toxicity
from quillspan.llm.op4_decontamination import decontaminate, drop_contaminated
from quillspan.llm.op7_token_counts import token_counts
from quillspan.llm.op8_exact_topk import exact_topk
from quillspan.llm.op9_packing import pack
from quillspan.llm.op10_license_scan import license_scan
from quillspan.llm.store import Scratch, components

BODY = " ".join(f"word{i}" for i in range(300))
ROWS = [
    (1, BODY), (1, BODY), (2, BODY + " end"), (None, BODY), (3, ""), (4, None), (5, " \n\t "), (6, "one two"), (7, "One  TWO"), (8, "a b c d e f g h i j"),
    (9, "lone text " + " ".join(f"x{i}" for i in range(40))), (10, "long " * 9000), (None, None), (11, "🏠é中 " * 60),
]


def odd(spark, rows=ROWS):
    """Documents with clashing extra columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("v", "h", "n", "score", "key", "row", "slot", "kept", "_score", "_text", "text2", "want", "item_id"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def none(spark):
    return odd(spark).where("false")


def test_components(spark):
    g = np.random.Generator(np.random.Philox(1))
    e = [(int(a), int(b)) for a, b in g.integers(-50, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1080)]
    par = {}

    def root(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in e:
        a, b = root(a), root(b)
        par[max(a, b)] = min(a, b)
    got = components(spark, Scratch(spark), spark.createDataFrame(e, "a long, b long")).collect()
    assert {r.v: r.root for r in got} == {v: root(v) for a, b in e for v in (a, b) if a != b}


def jaccard_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None] if sets[i] else [d]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def test_near_components(spark, monkeypatch):
    g = np.random.Generator(np.random.Philox(9))
    rows = list(ROWS)
    base = [[f"t{x}" for x in g.integers(0, 900, 120)] for _ in range(6)]
    for i in range(150):  # chains of growing edits, dense groups, a shared passage
        w = list(base[i % 6])
        for p in g.integers(0, 120, int(g.integers(0, 9))):
            w[p] = f"e{g.integers(0, 10**6)}"
        rows.append((100 + i, " ".join(w + ["shared passage of words"] * (i % 2))))
    got = near.near_components(spark, odd(spark, rows)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == jaccard_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    monkeypatch.setattr(Scratch, "BROADCAST_BYTES", 0)
    small = near.near_components(spark, odd(spark, rows), chunk=2, depth=2).collect()  # chunks and branches instead of closing
    assert sorted(map(str, small)) == sorted(map(str, got))
    packed = near.near_components(spark, odd(spark, rows), chunk=16, dense=0).collect()  # sets compared in place
    assert sorted(map(str, packed)) == sorted(map(str, got))
    assert near.near_components(spark, none(spark)).count() == 0


def test_suffix_dedup(spark, monkeypatch):
    g = np.random.Generator(np.random.Philox(2))
    word = lambda n: "".join(chr(97 + x) for x in g.integers(0, 26, n))
    a, b, c = word(500), word(199), word(260)
    rows = [*ROWS, (20, a + word(50)), (21, word(30) + a[100:400]), (22, b + word(9)), (23, word(5) + b), (24, c + word(10) + c), (25, word(700)), (26, "ab" * 300), (27, word(200) + "é" + a[:250])]
    want = sorted(zip([str(r[0]) for r in rows], suffix6.brute_force([r[1] for r in rows])), key=str)
    for hot, bound in ((suffix6.HOT, 10**8), (1, 0)):
        monkeypatch.setattr(suffix6, "HOT", hot)
        got = suffix6.strip_repeats(spark, odd(spark, rows), broadcast_bytes=bound)
        got = [(str(r.row.doc_id), (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())) for r in got.collect()]
        assert sorted(got, key=str) == want
    assert suffix6.suffix_dedup(spark, none(spark)).count() == 0
    assert suffix6.suffix_dedup(spark, odd(spark)).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_token_counts_and_packing(spark):
    tok = pretok.library()
    want = sorted((str(d), len((t or "").encode()), len(tok.encode(t or "").ids)) for d, t in ROWS)
    got = token_counts(odd(spark)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 1024) for r in got)
    p = pack(odd(spark)).toPandas()
    assert p.length.sum() == sum(n + 1 for _, _, n in want)
    size = p.groupby("sequence_id").length.sum()
    assert size.max() <= 1024 and all(n & (n - 1) == 0 for n in size) and all((x.sort_values("offset").offset.values == np.cumsum(x.sort_values("offset").length.values) - x.sort_values("offset").length.values).all() for _, x in p.groupby("sequence_id"))
    texts = dict(ROWS)
    for r in p[p.doc_id.notna() & (p.doc_id != 1)].itertuples():
        ids = np.array([*tok.encode(texts[int(r.doc_id)] or "").ids, 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert p.groupby("doc_id").length.sum().drop(1).to_dict() == {d: len(tok.encode(t or "").ids) + 1 for d, t in texts.items() if d not in (None, 1)}
    assert token_counts(none(spark)).count() == 0 == pack(none(spark)).count()
    with pytest.raises(ValueError):
        pack(odd(spark), window=1000)


def test_training_order(spark, tmp_path):
    tok = pretok.library()
    root = f"file://{tmp_path}/shards"
    manifest, total = order.write_order(spark, odd(spark).coalesce(2), root, length=64, rows=8)
    manifest = manifest.collect()
    assert sorted(r.slot for r in manifest) == list(range(total))
    back = order.read_order(spark, root, 64, 8).orderBy("slot").collect()
    assert [r.slot for r in back] == list(range(total)) and sum(r.n_tokens for r in back) == sum(len(tok.encode(t or "").ids) + 1 for _, t in ROWS)
    assert all((tmp_path / "shards" / f"shard-{r.shard:08d}.bin").stat().st_size > r.byte_offset for r in back)
    assert [r.slot for r in order.read_order(spark, root, 64, 8, start=total - 3).orderBy("slot").collect()] == [total - 3, total - 2, total - 1]
    # the permutation undone, the stream of each partition comes back
    place = order.feistel(np.arange(total), total, 20260107)
    raw = {r.shard: (tmp_path / "shards" / f"shard-{r.shard:08d}.bin").read_bytes() for r in back}
    seqs = []
    for s in place.tolist():
        rec = raw[s // 8][(s % 8) * 132 : (s % 8 + 1) * 132]
        seqs.append(np.frombuffer(rec[4:], "<u2")[: int.from_bytes(rec[:4], "little")])
    stream = np.concatenate(seqs).tolist()
    parts = [[r.text for r in p] for p in odd(spark).coalesce(2).rdd.glom().collect()]
    assert stream == [x for p in parts for t in p for x in [*tok.encode(t or "").ids, 0]]
    assert order.training_order(spark, none(spark)).count() == 0
    assert "doc_ids" in order.training_order(spark, odd(spark)).columns


def test_decontamination(spark):
    item = "what is the sum of two and three the answer is certainly five my friend"
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, ""), (1, item)], "item_id long, text string").withColumn("score", F.lit(1))
    rows = [*ROWS, (40, f"pre {item} post"), (41, item.replace("certainly", "of course")), (42, item[:40])]
    got = decontaminate(spark, odd(spark, rows), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(40, 1)} and got.count() == 2  # the repeated item is an item of its own
    kept = drop_contaminated(spark, odd(spark, rows), bench)
    assert kept.columns == odd(spark).columns and kept.count() == len(rows) - 1
    assert decontaminate(spark, none(spark), bench).count() == 0 == decontaminate(spark, odd(spark), bench.where("false")).count()


def test_licenses(spark):
    rows = [*ROWS, (50, "x Released under the MIT License. y"), (None, "Licensed under CC BY-NC 4.0.")]
    got = license_scan(odd(spark, rows)).collect()
    assert {(r.doc_id, r.license) for r in got} == {(50, "MIT"), (None, "CC-BY-NC-4.0")} and license_scan(none(spark)).count() == 0


def test_toxicity(spark):
    vile = [(100 + i, f"common words of a text vermin{i % 7} and more common words {i}") for i in range(60)]
    fine = [(200 + i, f"common words of a text and more common words {i}") for i in range(60)]
    docs = odd(spark, ROWS + vile + fine)
    labels = spark.createDataFrame([(d, 1, int(d < 200)) for d, _ in vile + fine] + [(None, 1, 1), (100, 0, 0), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity(spark, docs, labels).collect()
    assert len(got) == len(ROWS) + 120 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id >= 100]
    assert sum(r.predicted == (r.doc_id < 200) for r in held) >= 0.9 * len(held)
    assert all(r.score == 0 for r in got if r.doc_id in (3, 4, 5))
    assert {r.score for r in toxicity(spark, docs, labels.where("false")).collect()} == {0.0}
    assert toxicity(spark, none(spark), labels).count() == 0


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    g = np.random.Generator(np.random.Philox(3))
    rows = [(i, [float(x) for x in g.standard_normal(8)]) for i in range(-20, 90)]
    rows += [(100, None), (101, [nan] * 8), (102, [inf] * 8), (103, [None] + [0.0] * 7), (None, [1.0] * 8), (120, [1.0, 2.0]), (121, [1.0, 1.0]), (140, []), (141, []), (5, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    rows += [(20, [0.5] * 8), (20, [0.5] * 8), (5, [0.5] * 8)]  # repeated ids are rows of their own
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own")).withColumn("rid", F.lit("own"))
    v = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for n, (q, a) in enumerate(v):
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), c) for m, (c, b) in enumerate(v) if m != n and len(a) == len(b))[:20]
            want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s)]
    for block, chunk in ((1024, 1 << 20), (2, 7)):
        got = exact_topk(spark, df, block=block, chunk_bytes=chunk).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert exact_topk(spark, df.where("false")).count() == 0


EVENTS = "conv_id long, seq int, turn int, kind string, role string, text string"


def test_event_folding(spark):
    e = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 4, 1, "delta", None, "lo"), (1, 3, 1, "delta", None, "hel"),
        (1, 5, 2, "message", "user", "gone"), (1, 6, 1, "regenerate", "assistant", "new"), (1, 7, 1, "delta", None, "!"), (1, 8, 0, "edit", None, "hey"),
        (1, 9, 2, "message", "user", "kept"), (2, 1, 0, None, None, None),
    ]
    got = chat.fold_events(spark.createDataFrame(e, EVENTS)).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "hey"), (1, 1, "assistant", "new!"), (1, 2, "user", "kept"), (2, 0, "", "")]


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<", "[", "</s", "<s>\n[INST]", "", None, "a\\[INST]", "🏠</s>é", "<\\/s>", "[/INST]<", " x "]


def test_chat_round_trip(spark):
    rows = [(i % 3, i, ("user", "assistant", None, "odd</s>role\\")[i % 4], t) for i, t in enumerate(NASTY * 2)] + [(0, 0, "user", NASTY[0]), (None, 1, "assistant", "x"), (5, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("own"))
    got = {r.conv_id: r for r in chat.chat_format(spark, df).collect()}
    by = {}
    for c, t, r, x in [*rows, (-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    f = chat.render(chat.fold_events(chat.as_events(df)))
    assert all(r.formatted[s.lo : s.hi].count("</s>") == 0 for r in f.collect() for s in r.mask)
    assert [r.conv_id for r in chat.chat_format(spark, df.where("false")).collect()] == [-1]


def test_chat_is_native(spark, sf):
    plan = chat.chat_format(spark, spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs.count(), spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < docs.count() <= before
        assert stage(spark, docs.where("false"), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_pipeline_keeps_odd_rows(spark, sf):
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in [*ROWS, (60, "a " * 30 + "� tail"), (60, "another text under the same id, with words of its own")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(map(str, [1, None, 3, 4, 5, 6, 8, 9, 10, None, 11, 60, 60]))
    left = {(r.doc_id, r.text) for r in corpus_pipeline.repeats(spark, docs, sf).collect()}
    assert (8, ROWS[9][1]) in left and (4, None) in left and not any(t and t.startswith("word0") for _, t in left)


def test_pipeline_judges_reused_ids_by_row(spark, sf):
    own = " ".join(f"own{i}" for i in range(60))
    rows = [(1, BODY), (2, BODY + " end"), (2, own), (3, own + " a"), (3, own + " b"), (5, BODY + " x y"), (7, own.upper()), (8, "one two"), (8, "ONE  two"), (9, None), (9, None), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()), key=str)
    assert got == sorted([(1, BODY), (2, own), (8, "ONE  two"), (9, None), (9, "")], key=str)
    two = docs.where("doc_id = 3")  # two near texts under one id: one stays
    assert corpus_pipeline.near_duplicates(spark, two, sf).count() == 1


def test_pipeline_keeps_own_replacement_characters(spark, sf):
    """A U+FFFD that no repeat covers stays; what a cut leaves of a character goes."""
    run = "".join(f"r{i} " for i in range(80))
    # the first bytes of é and ê agree, so the repeat ends inside them
    rows = [(1, "own � text " + run + "é end � one"), (2, "other � begin " + run + "ê last � two")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeats(spark, docs, sf).collect()}
    want = {1: "own � text end � one", 2: "other � begin last � two"}
    assert {k: v[0].replace("  ", " ") for k, v in got.items()} == want and all(n == len(t) for t, n in got.values())


def test_pipeline_keeps_clashing_columns(spark, sf):
    """Reused ids beside columns named like those that the stages make."""
    names = ["_id", "_v", "_class", "_nth", "_text", "_score", "id", "class", "nth", "row", "v", "root", "kept", "gone"]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in [*ROWS, (9, "another text under the same id, of its own words")]], "doc_id long, text string, lang string, source string, n_chars long")
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    want = corpus_pipeline.near_duplicates(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), sf).count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in names)
        assert name != "near_duplicates" or len(rows) == want < docs.count()


def test_scores_do_not_follow_the_shards(spark, monkeypatch):
    """The same pairs and scores from one index as from many, near items and long ones included."""
    from quillspan.llm import op4_decontamination as leak

    g = np.random.Generator(np.random.Philox(8))
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(g.choice(words, int(g.integers(3, 200))))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = [(i, "before it " + " ".join(t.split()[: max(5, int(len(t.split()) * 0.9))]) + " after it") for i, t in items]
    docs = spark.createDataFrame(cut, "doc_id long, text string")
    one = sorted(tuple(r) for r in decontaminate(spark, docs, bench).collect())
    monkeypatch.setattr(leak, "SHARD_BYTES", 6000)
    many = sorted(tuple(r) for r in decontaminate(spark, docs, bench).collect())
    assert len(list(leak.indexes(bench))) > 4 and len(one) > 30
    assert [r[:2] for r in one] == [r[:2] for r in many] and np.allclose([r[2:] for r in one], [r[2:] for r in many], rtol=0, atol=1e-12)
    assert drop_contaminated(spark, docs, bench).count() == 60 - len({r[0] for r in one})


def test_range_of_several_shards(spark, tmp_path, monkeypatch):
    docs = odd(spark).coalesce(2)
    kept = {}
    for name, ranges in (("one", 4096), ("many", 1)):
        monkeypatch.setattr(order, "RANGES", ranges)
        manifest, total = order.write_order(spark, docs, f"file://{tmp_path}/{name}", length=16, rows=4)
        assert sorted(r.slot for r in manifest.collect()) == list(range(total)) and total > 100
        kept[name] = {p.name: p.read_bytes() for p in (tmp_path / name).glob("shard-*")}
    assert kept["one"] == kept["many"] and len(kept["one"]) > 25
