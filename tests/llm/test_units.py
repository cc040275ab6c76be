"""Kernels of the training-data operators against brute force and the libraries."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import op1_toxicity as tox
from quillspan.llm import op2_minhash_dedup as near
from quillspan.llm import op3_training_order as order
from quillspan.llm import op4_decontamination as leak
from quillspan.llm import op6_suffix_dedup as suffix6
from quillspan.llm import op7_token_counts as counts
from quillspan.llm import op8_exact_topk as topk
from quillspan.llm import op9_packing as packing
from quillspan.llm import op10_license_scan as lic
from quillspan.llm import pretok, suffix
from quillspan.llm.textkit import buffers, chunks, words

ODD = ["", " ", "\n\n a", "a" * 5000, "ab" * 3000, "<|endoftext|>", "x<|endoftext|> y  <|endoftext|>", "it's 'sx don't'll", "é 中 🏠 \x1c \x85  12 34.", "  \t\n x", None]
PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "'", "é", "中", "1", "23", "!", "<|endoftext|>", "🏠", "\x1c", "\x85", "it's"]


def kit(texts):
    return buffers(pa.array(texts, pa.string()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=6))
def test_tokens_equal_the_library(texts):
    texts = texts + ODD
    data, offs = kit(texts)
    tok = pretok.library()
    for i, j in chunks(offs, 3000):
        ids, at = pretok.token_ids(data, offs[i : j + 1])
        n = counts.count_rows(data, offs[i : j + 1])
        for r in range(i, j):
            want = tok.encode(texts[r] or "", add_special_tokens=False).ids
            assert ids[at[r - i] : at[r - i + 1]].tolist() == want and n[r - i] == len(want)


def test_heap_merge_equals_rounds():
    table, _ = counts.counter()
    for text in (b"abcabcabc" * 300, bytes(random.Random(1).choices(b"abcde ", k=2500)), b"a" * 2600):
        raw = np.frombuffer(text, np.uint8)
        counts.LONG, keep = 10**9, counts.LONG
        try:
            assert counts.merge(table, raw, np.array([0]), np.array([len(raw)]))[0] == counts.heap_merge(table, table.byte[raw].tolist())
        finally:
            counts.LONG = keep


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=6))
def test_suffix_array(texts):
    t, _ = suffix.join_texts(texts)
    sa, raw = suffix.suffix_array(t), t.tobytes()
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    phi, lcp = suffix.plcp(t, sa)
    for i, j in enumerate(phi.tolist()):
        if j >= 0:
            n = 0
            while max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
                n += 1
            assert lcp[i] == n


def test_segments_cover_every_window():
    g = random.Random(3)
    texts = ["".join(g.choices("ab cd", k=g.choice([0, 199, 200, 201, 900]))) for _ in range(40)] + ["ab" * 700, "x" * 1000]
    data, offs = kit(texts)
    for i, j in chunks(offs, 4000):
        row, at, n, key, _ = suffix6.segments(data, offs[i : j + 1], 200)
        assert n.max() <= suffix6.CUT
        seen = {}
        for r, a, c, k in zip(row.tolist(), at.tolist(), n.tolist(), key.tolist()):
            for x in range(a, a + c):
                assert (r, x) not in seen
                seen[r, x] = k
        assert len(seen) == sum(max(0, len(t) - 199) for t in texts[i:j])


def test_shingles():
    texts = ["A b\tC d e", "a b c", "", None, "a b c d", "a  B c D", "x y", "é É ß a"]
    data, offs = kit(texts)
    s = near.shingles(data, offs)
    assert [len(x) for x in s] == [2, 1, 0, 0, 1, 1, 1, 1] and s[4] == s[5] and s[1] not in s[4]
    assert near.signatures([s[0], s[4]]).shape == (2, near.COORDS)


def test_similar_sets():
    g = random.Random(4)
    sets = [np.unique(np.array(g.sample(range(60), g.randint(1, 50)), np.int64)) for _ in range(40)]
    sets += [sets[0], np.delete(sets[1], 0)] if len(sets[1]) > 1 else [sets[0]]
    at = np.cumsum([0] + [len(s) for s in sets])
    got = near.similar(np.concatenate(sets), at, 80)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            same = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * same >= 80 * (len(a) + len(b) - same))


def test_words():
    texts = ["Ab, c\x0b d\x1fe", "É x"]
    data, offs = kit(texts)
    b, s, e, row, h = words(data, offs)
    low = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for t in texts]
    assert [b[i:j].tobytes().decode() for i, j in zip(s, e)] == low[0] + low[1] and row.tolist() == [0, 0, 0, 1, 1]
    again = words(*kit(["x ab,"]))[4]
    assert again[1] == h[0] and len(set(h.tolist())) == 5


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel(n):
    x = order.feistel(np.arange(n), n, 99)
    assert sorted(x.tolist()) == list(range(n)) and (order.feistel(x, n, 99, back=True) == np.arange(n)).all()
    assert n < 64 or (x != order.feistel(np.arange(n), n, 98)).any()


@pytest.mark.parametrize("sizes", [[], [1], [1024], [1023, 2], [700, 700, 700], [5000, 3, 64, 900], list(range(1, 400, 7))])
def test_packing(sizes):
    p = packing.Packer(0, pool=16)
    docs = {i: np.random.Generator(np.random.Philox(i)).integers(0, 50000, n).astype(np.uint32) for i, n in enumerate(sizes)}
    for i, ids in docs.items():
        p.add(i, ids)
    p.pack()
    got, seqs = {}, {}
    for doc, start, n, crc, total, seq, off, tier, group in p.rows:
        assert crc == zlib.crc32(docs[doc][start : start + n].astype("<u4").tobytes()) and total == len(docs[doc])
        got.setdefault(doc, []).append((start, n))
        seqs.setdefault(seq, []).append((off, n, tier))
    for doc, pieces in got.items():
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at == len(docs[doc])
    assert sum(n for x in got.values() for _, n in x) == sum(sizes)
    for pieces in seqs.values():
        at = 0
        for off, n, _ in sorted(pieces):
            assert off == at
            at += n
        assert at == pieces[0][2] <= 1024  # full: its size is its tier, a power of two


def test_topk_by_brute_force():
    g = np.random.Generator(np.random.Philox(4))
    for d, spread in ((64, 60), (3, 2), (1, 1), (20, 10**6)):
        x = g.integers(-spread, spread + 1, (3000, d))
        x[:500] = x[0]
        ids = g.permutation(3000)
        q = np.arange(0, 3000, 37)
        r, c, s = topk.block_topk(ids[q], x[q], ids, x, 20)
        full = x[q] @ x.T
        for i in range(len(q)):
            want = sorted((-full[i, j], ids[j]) for j in range(3000) if ids[j] != ids[q[i]])[:20]
            assert [(-a, b) for a, b in zip(s[r == i], c[r == i])] == want


def test_bounds_hold():
    g = np.random.Generator(np.random.Philox(5))
    a, b = g.integers(-9, 9, (50, 64)).astype(float), g.integers(-9, 9, (50, 64)).astype(float)
    last = None
    for m in (1, 4, 16, 64):
        ub = topk.stats(a, m) @ topk.stats(b, m).T
        assert (ub >= a @ b.T - 1e-6).all() and (last is None or ub.mean() <= last)
        last = ub.mean()


def test_bm25_search_finds_all_above_threshold():
    g = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    items = [" ".join(g.choices(vocab, k=g.randint(3, 90))) for _ in range(60)]
    index = leak.Index(list(range(60)), items)
    texts = [" ".join(g.choices(vocab, k=30) + (items[i % 60].split() if i % 3 == 0 else items[i % 60].split()[:15]) + g.choices(vocab, k=20)) for i in range(120)]
    data, offs = kit(texts)
    _, _, _, row, h = words(data, offs, alnum=True)
    tid = np.searchsorted(index.terms, h)
    known = (tid < len(index.terms)) & (index.terms[np.minimum(tid, len(index.terms) - 1)] == h)
    p, part, s = index.search(tid[known], row[known], 120, 0.5)
    want = {}
    for i in range(120):
        have = set(tid[(row == i) & known].tolist())
        for t in have:
            for k in range(index.post[t], index.post[t + 1]):
                want[i, index.part[k]] = want.get((i, index.part[k]), 0) + index.impact[k]
    want = {k: v for k, v in want.items() if v >= 0.5}
    assert {(a, b) for a, b in zip(p.tolist(), part.tolist())} == set(want) and all(abs(want[a, b] - c) < 1e-9 for a, b, c in zip(p, part, s))
    found = {(r, i) for r, i, *_ in index.leaks(data, offs, 0.5, 0.8)}
    assert {(i, i % 60) for i in range(0, 120, 3)} <= found


def test_leaks_of_items_longer_than_a_part():
    """An item of 65 to 127 words is found wherever it lies between the passages, though half of it is shared."""
    shared = [f"s{i}" for i in range(64)]
    items = [" ".join([*(f"a{n}x{i}" for i in range(31)), *shared, *(f"b{n}x{i}" for i in range(32))]) for n in range(20)]
    index = leak.Index(list(range(20)), items)
    assert np.bincount(leak.words(*kit(items), alnum=True)[3]).tolist() == [127] * 20
    texts = [" ".join([f"f{i}" for i in range(k)] + [items[3]] + [f"g{i}" for i in range(200)]) for k in range(64)]
    assert [x[:2] for x in index.leaks(*kit(texts), 0.6, 0.8)] == [(k, 3) for k in range(64)]


def test_wand_skips_nothing():
    """All passages against all parts, with ties, repeats and terms of every frequency."""
    g = random.Random(12)
    for size, vocab in ((5, 6), (80, 30), (300, 400)):
        items = [" ".join(g.choices([f"w{i}" for i in range(vocab)], k=g.randint(1, 12))) for _ in range(size)]
        index = leak.Index(list(range(size)), items)
        n = 60
        tid = np.array(g.choices(range(len(index.terms)), k=n * 15))
        own = np.repeat(np.arange(n), 15)
        score = np.zeros((n, len(index.item)))
        for p, t_ in set(zip(own.tolist(), tid.tolist())):
            lo, hi = index.post[t_], index.post[t_ + 1]
            np.add.at(score[p], index.part[lo:hi], index.impact[lo:hi])
        for least in (0.2, 0.6, 1.0):
            p, part, s = index.search(tid, own, n, least)
            want = np.argwhere(score >= least - 1e-9)
            assert sorted(zip(p.tolist(), part.tolist())) == sorted(map(tuple, want.tolist())) and np.allclose(s, score[p, part])


def leaks_by_hand(items, texts, least, overlap):
    """The definition: BM25 of every passage against every part of at most 64 words, then shingles of the whole item."""
    low = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    parts = []
    for i, t in enumerate(items):
        w = low(t)
        k = max(-(-len(w) // leak.PART), 1)
        parts += [(i, [x for n, x in enumerate(w) if n * k // len(w) == j]) for j in range(k)]
    mean, df = sum(len(w) for _, w in parts) / len(parts), {}
    for _, w in parts:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    weight = []
    for _, w in parts:
        own = {x: np.log1p((len(parts) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(w)}
        weight.append({x: v / sum(own.values()) for x, v in own.items()})
    out = set()
    for r, t in enumerate(texts):
        w = low(t)
        grams_ = lambda v, k: [tuple(v[i : i + k]) for i in range(len(v) - k + 1)]
        for lo in range(0, max(len(w) - leak.PASSAGE + leak.STRIDE, 1), leak.STRIDE):
            have = set(w[lo : lo + leak.PASSAGE])
            for (i, _), own in zip(parts, weight):
                if sum(v for x, v in own.items() if x in have) >= least - 1e-9:
                    item = low(items[i])
                    k = min(5, len(item))
                    g, d = grams_(item, k), set(grams_(w, k))
                    hit = [x in d for x in g]
                    half = (len(g) + 1) // 2
                    q, a = hit[:half], hit[half:] or hit
                    if np.mean(hit) >= overlap and min(np.mean(q), np.mean(a)) >= 0.5:
                        out.add((r, i))
    return out


def test_leaks_against_brute_force():
    g = random.Random(21)
    vocab = [f"v{i}" for i in range(250)]
    items = [" ".join(g.choices(vocab, k=n)) for n in (3, 9, 20, 40, 59, 64, 65, 100, 127, 128, 200) for _ in range(3)]
    texts = [""]
    for i in range(90):
        own = items[i % len(items)].split()
        for _ in range(g.choice([0, 0, 1, 3, 12])):  # some words changed, some lost
            j = g.randrange(len(own))
            own[j] = g.choice(vocab) if g.random() < 0.7 else ""
        texts.append(" ".join(g.choices(vocab, k=g.randint(0, 150)) + own + g.choices(vocab, k=g.randint(0, 150))))
    index = leak.Index(list(range(len(items))), items)
    got = [x[:2] for x in index.leaks(*kit(texts), 0.6, 0.8)]
    want = leaks_by_hand(items, texts, 0.6, 0.8)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_leaks_verify_question_and_answer():
    item = "one two three four five six seven eight nine ten eleven twelve"
    index = leak.Index([7], [item])
    texts = [f"xx {item.upper()}! yy", "one two three four five six", "ten nine eight seven six five four three two one eleven twelve", "", None, item.replace(" ", ", ")]
    assert [x[0] for x in index.leaks(*kit(texts), 0.6, 0.8)] == [0, 5]
    assert leak.Index([], []).leaks(*kit(texts), 0.6, 0.8) == [] and leak.Index([1], [""]).leaks(*kit(texts), 0.6, 0.8) == []
    assert [x[0] for x in leak.Index([1], ["six seven"]).leaks(*kit(texts), 0.6, 0.8)] == [0, 5]


def test_patience():
    assert lic.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    g = random.Random(8)
    for _ in range(100):
        a, b = [g.randint(0, 9) for _ in range(g.randint(0, 14))], [g.randint(0, 9) for _ in range(g.randint(0, 14))]
        pairs = lic.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    words_ = list(range(20))
    assert len(lic.patience(words_, words_[:10] + [99, 98] + words_[10:])) == 20


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b):
            diag, row[j + 1] = row[j + 1], diag + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_alignment_against_brute_force():
    g = random.Random(9)
    for _ in range(150):
        a, b = [g.randint(0, 6) for _ in range(g.randint(0, 25))], [g.randint(0, 6) for _ in range(g.randint(0, 25))]
        got = lic.common((a, 0), (b, 0))
        assert len(got) == lcs(a, b) and all(a[i] == b[j] for i, j in got) and sorted(got) == sorted(got, key=lambda p: p[1])
        assert len(lic.patience(a, b)) <= len(got)
        u, v = g.sample(range(40), 20), g.sample(range(40), 25)  # words that occur once: patience is exact
        assert len(lic.patience(u, v)) == lcs(u, v)


@pytest.mark.parametrize("name", ["MIT-text", "ISC", "BSD-3-Clause", "CC-BY-4.0"])
def test_license_parts_far_apart(name):
    """A license in two halves is found whatever lies between, and not by scattered words."""
    own = lic.TEMPLATES[name].split()
    kit_ = lic.Templates(lic.TEMPLATES)
    texts = [" ".join(["x"] * 3 + own[: len(own) // 2] + [f"w{i}" for i in range(gap)] + own[len(own) // 2 :]) for gap in [*range(0, 60, 4), 500, 5000]]
    texts.append(" ".join(w for x in own for w in (x, "z", "y", "z", "y")))
    texts.append(" ".join(own[::-1]))
    data, offs = kit(texts)
    got = {(r, kit_.names[t]): (cover, lo, hi) for r, t, cover, lo, hi, _ in kit_.scan(data, offs, 0.8)}
    assert all((r, name) in got for r in range(len(texts) - 2)) and (len(texts) - 1, name) not in got and (len(texts) - 2, name) not in got
    assert all(got[r, name][1] == 3 for r in range(len(texts) - 2))


def test_license_places():
    mit = "Released under the MIT License."
    texts = [f"a b {mit} c", "released UNDER the mit license", "released under a license", "", None, f"{mit} {mit} {mit}", "x " * 5000 + mit]
    got = lic.Templates(lic.TEMPLATES).scan(*kit(texts), 0.8)
    assert [(r, cover, lo, hi) for r, t, cover, lo, hi, _ in got if lic.Templates(lic.TEMPLATES).names[t] == "MIT"] == [(0, 1.0, 2, 7), (1, 1.0, 0, 5), (5, 1.0, 0, 5), (6, 1.0, 5000, 5005)]


def gru_by_step(m, x, words_):
    """The network as its definition reads, for one window and word by word."""
    s = lambda v: 1 / (1 + np.exp(-v))
    H, p, states = tox.HIDDEN, m.p, []
    for k, seq in (("f", words_), ("b", words_[::-1])):
        h, hs = np.zeros(H), []
        for w in seq:
            gx, gh = x[w] @ p["W" + k] + p["c" + k], h @ p["U" + k]
            z, r = s(gx[:H] + gh[:H]), s(gx[H : 2 * H] + gh[H : 2 * H])
            h = z * h + (1 - z) * np.tanh(gx[2 * H :] + r * gh[2 * H :])
            hs.append(h)
        states.append(hs if k == "f" else hs[::-1])
    hs = np.concatenate([np.array(states[0]), np.array(states[1])], 1)
    e = np.exp(np.tanh(hs @ p["A"]) @ p["a"])
    return (e / e.sum()) @ hs @ p["o"] + p["c"][0]


def test_network_equals_its_definition():
    w = tox.Words(*kit(["alpha beta gamma delta", "epsilon zeta", " ".join(f"w{i}" for i in range(50))]))
    m = tox.Model()
    x = m.inputs(w)
    got = m.forward(x, w.index, w.mask)
    for i in range(len(w.row)):
        assert abs(got[i] - gru_by_step(m, x.astype(float), [k for k, on in zip(w.index[i], w.mask[:, i]) if on])) < 1e-4


def test_gradients():
    g = np.random.Generator(np.random.Philox(1))
    w = tox.Words(*kit(["alpha beta gamma delta", "epsilon zeta", " ".join(f"w{i}" for i in range(50))]))
    m = tox.Model()
    m.p = {k: (v * 2).astype(np.float64) for k, v in m.p.items()}
    x = m.inputs(w).astype(np.float64)
    index, mask = w.index, w.mask.astype(np.float64)
    d = g.standard_normal(len(index))
    out, kept = m.forward(x, index, mask, keep=True)
    grads, dx = m.backward(x, index, mask, kept, d)
    for v, grad in [*((m.p[k], grads[k]) for k in m.p), (x[:-1], dx[:-1])]:
        flat = v.reshape(-1)
        for i in g.choice(flat.size, min(6, flat.size), replace=False):
            flat[i] += 1e-3
            up = (m.forward(x, index, mask) * d).sum()
            flat[i] -= 2e-3
            down = (m.forward(x, index, mask) * d).sum()
            flat[i] += 1e-3
            assert abs((up - down) / 2e-3 - grad.reshape(-1)[i]) < 2e-2 * (1 + abs(grad.reshape(-1)[i]))


def test_every_table_learns():
    texts = [f"common words of a text {'vermin' if i % 2 else 'people'}{i} and more" for i in range(40)]
    fresh, m = tox.Model(), tox.fit(texts, np.array([i % 2 for i in range(40)], "f4"), steps=20, epochs=1)
    assert all((m.tables[k] != fresh.tables[k]).any() for k in m.tables) and all((m.p[k] != fresh.p[k]).any() for k in m.p)


def test_windows_cover_all_words():
    texts = ["", " ".join("abcdefgh"[i % 8] * (i % 5 + 1) for i in range(101)), "x", "y " * 32, "z " * 33]
    w = tox.Words(*kit(texts))
    assert np.bincount(w.row, minlength=5).tolist() == [0, 6, 1, 1, 2] and (w.mask.sum(0) <= 32).all()


def test_fit_learns_and_is_deterministic():
    g = random.Random(2)
    texts = [" ".join(g.choice(["alder", "birch", "cedar", "oak", "elm"]) + str(g.randint(0, 50)) for _ in range(40)) for _ in range(160)]
    y = np.array([i % 2 for i in range(160)], "f4")
    texts = [t + " vermin" + str(i) if i % 2 else t for i, t in enumerate(texts)]
    a, b = tox.fit(texts[:120], y[:120], steps=60), tox.fit(texts[:120], y[:120], steps=60)
    s = a.score(*kit(texts[120:]))
    assert ((s >= 0.5) == (y[120:] == 1)).mean() > 0.9 and (s == b.score(*kit(texts[120:]))).all()
    assert tox.fit([], np.zeros(0, "f4")) is None and tox.fit(["a"], np.ones(1, "f4")) is None
