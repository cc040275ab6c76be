"""Byte-level sequence tagger: binary codec, numpy inference, constrained decoding, Arrow UDFs.

Weights of a published model are not part of this repository; any file of the format loads, and
tests use seeded random weights.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import FIELDS, SPANS, TAGS

E, H, LAYERS, FORBID = 32, 128, 2, np.float32(-10000)
N = len(TAGS)
MAX_TOKENS, MAX_CHARS, MAX_BYTES = 128, 512, 64
MAGIC, VERSION = b"GPA3", 1


def shapes() -> dict[str, tuple[int, ...]]:
    """Tensors in file order."""
    linear = lambda n, i, o: {f"{n}.weight": (o, i), f"{n}.bias": (o,)}
    out = {"embedding.weight": (257, E), "char_conv.weight": (E, E, 3), "char_conv.bias": (E,), **linear("project", 2 * E, H), "local": (5, H), "local_bias": (H,)}
    for k in range(LAYERS):
        for name, i in (("gate", H), ("candidate", H), ("combine", 2 * H)):
            out |= linear(f"layers.{k}.{name}", i, H)
    return out | linear("output", H, N) | {"transitions": (N, N), "start": (N,), "end": (N,)}


def random_weights(seed: int = 0) -> dict[str, np.ndarray]:
    g = np.random.Generator(np.random.Philox(seed))
    w = {k: (g.standard_normal(s) * 0.2).astype(np.float32) for k, s in shapes().items()}
    w["embedding.weight"][0] = 0
    return w


def write_model(weights: dict[str, np.ndarray], gap: bool = False, bits: int | None = None) -> tuple[bytes, dict[str, np.ndarray], float]:
    """(file, weights as a reader restores them, largest error); ``bits``: symmetric codes of 2 to 8 bits for each tensor."""
    want = shapes()
    if {k: v.shape for k, v in weights.items()} != want:
        raise ValueError("tensors differ from the layout")
    if not all(np.isfinite(v).all() for v in weights.values()):
        raise ValueError("non-finite weights")
    if bits is not None and not 2 <= bits <= 8:
        raise ValueError("bits must be 2 to 8")
    head = MAGIC + struct.pack("<4I", VERSION, int(bits is not None), len(want), int(gap))
    if bits is None:
        return head + b"".join(weights[k].astype("<f4").tobytes() for k in want), weights, 0.0
    top = 2 ** (bits - 1) - 1
    scales, codes, back = [], [], {}
    for k in want:
        s = max(float(np.abs(weights[k]).max()) / top, 1e-12)
        codes.append(np.clip(np.rint(weights[k] / np.float32(s)), -top, top).astype(np.int8))
        scales.append(np.float32(s))
        back[k] = codes[-1].astype(np.float32) * scales[-1]
    worst = max(float(np.abs(weights[k] - back[k]).max()) for k in want)
    return head + np.array(scales, "<f4").tobytes() + b"".join(c.tobytes() for c in codes), back, worst


def read_model(data: bytes) -> tuple[dict[str, np.ndarray], bool]:
    """(weights, gap features) of a model file; anything unexpected is an error."""
    if len(data) < 20 or data[:4] != MAGIC:
        raise ValueError("not a model file of this format")
    version, coded, count, gap = struct.unpack("<4I", data[4:20])
    want = shapes()
    if version != VERSION or coded > 1 or gap > 1 or count != len(want):
        raise ValueError("unsupported model header")
    sizes = [int(np.prod(s)) for s in want.values()]
    if len(data) != 20 + (4 * count + sum(sizes) if coded else 4 * sum(sizes)):
        raise ValueError("model file has the wrong length")
    out, at = {}, 20
    scales = np.frombuffer(data, "<f4", count, 20) if coded else None
    at += 4 * count if coded else 0
    for i, (k, s) in enumerate(want.items()):
        if coded:
            out[k] = np.frombuffer(data, np.int8, sizes[i], at).astype(np.float32).reshape(s) * scales[i]
            at += sizes[i]
        else:
            out[k] = np.frombuffer(data, "<f4", sizes[i], at).astype(np.float32).reshape(s)
            at += 4 * sizes[i]
    if not all(np.isfinite(v).all() for v in out.values()):
        raise ValueError("non-finite weights")
    return out, bool(gap)


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties of (transition, start): an I tag only follows the B or I of its field."""
    tag = np.arange(N)
    inside, field = (tag > 0) & (tag % 2 == 0), (tag + 1) // 2
    ok = ~inside[None, :] | ((field[:, None] == field[None, :]) & (tag[:, None] > 0))
    return np.where(ok, np.float32(0), FORBID), np.where(inside, FORBID, np.float32(0))


def scan(gate: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Inclusive recurrence state = gate * state + value along axis 1."""
    out = np.empty_like(value)
    state = np.zeros_like(value[:, 0])
    for t in range(value.shape[1]):
        out[:, t] = state = gate[:, t] * state + value[:, t]
    return out


def forward(w: dict[str, np.ndarray], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[rows, tokens, tags] emissions of padded byte ids [rows, tokens, bytes]."""
    f32 = np.float32
    sig = lambda x: f32(0.5) * (np.tanh(f32(0.5) * x) + 1)
    lin = lambda n, x: x @ w[f"{n}.weight"].T + w[f"{n}.bias"]
    b, t, c = ids.shape
    there = (ids != 0)[..., None]
    x = w["embedding.weight"][ids] * there
    pad = np.pad(x, ((0, 0), (0, 0), (1, 1), (0, 0)))
    conv = sum(pad[:, :, k : k + c] @ w["char_conv.weight"][:, :, k].T for k in range(3)) + w["char_conv.bias"]
    x = (x + np.maximum(conv, 0)) * there
    mean = x.sum(2) / np.maximum(there.sum(2), 1)
    top = np.where(there, x, FORBID).max(2)
    top = np.where(there.any(2), top, 0)
    valid = (np.arange(t) < lengths[:, None])[..., None]
    v = np.tanh(lin("project", np.concatenate([mean, top], -1).astype(f32))) * valid
    pad = np.pad(v, ((0, 0), (2, 2), (0, 0)))
    v = np.tanh(v + sum(pad[:, k : k + t] * w["local"][k] for k in range(5)) + w["local_bias"]) * valid
    for k in range(LAYERS):
        g = sig(lin(f"layers.{k}.gate", v))
        cand = (1 - g) * np.tanh(lin(f"layers.{k}.candidate", v)) * valid
        g = np.where(valid, g, f32(1))
        both = np.concatenate([scan(g, cand), scan(g[:, ::-1], cand[:, ::-1])[:, ::-1]], -1)
        v = np.tanh(v + lin(f"layers.{k}.combine", both)) * valid
    return lin("output", v).astype(f32)


def viterbi(e: np.ndarray, w: dict[str, np.ndarray]) -> list[int]:
    """Best tag path of one row's emissions; ties go to the lowest tag."""
    step, first = allowed()
    trans, score, back = w["transitions"] + step, w["start"] + first + e[0], []
    for row in e[1:]:
        total = score[:, None] + trans
        back.append(total.argmax(0))
        score = total.max(0) + row
    path = [int((score + w["end"]).argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def viterbi_rows(e: np.ndarray, lengths: np.ndarray, w: dict[str, np.ndarray]) -> list[list[int]]:
    """``viterbi`` of each row of padded emissions [rows, tokens, tags], in step: a row that has ended keeps its scores and tags."""
    step, first = allowed()
    trans, score, back = w["transitions"] + step, w["start"] + first + e[:, 0], []
    for t in range(1, e.shape[1]):
        total, on = score[:, :, None] + trans, (t < lengths)[:, None]
        back.append(np.where(on, total.argmax(1), np.arange(N)))
        score = np.where(on, total.max(1) + e[:, t], score)
    path = [(score + w["end"]).argmax(1)]
    for b in back[::-1]:
        path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
    tags = np.stack(path[::-1], 1).tolist()
    return [row[:n] for row, n in zip(tags, lengths.tolist())]


def greedy(e: np.ndarray, w: dict[str, np.ndarray] | None = None) -> list[int]:
    """The best tag of each token by itself; ties go to the lowest tag."""
    return e.argmax(1).tolist()


def greedy_rows(e: np.ndarray, lengths: np.ndarray, w: dict[str, np.ndarray] | None = None) -> list[list[int]]:
    return [greedy(row[:n], w) for row, n in zip(e, lengths)]


DECODERS = {"viterbi": viterbi_rows, "greedy": greedy_rows}


def kbest(e: np.ndarray, w: dict[str, np.ndarray], k: int) -> list[tuple[list[int], float]]:
    """The k best paths with scores, best first."""
    step, first = allowed()
    trans = (w["transitions"] + step).astype(np.float64)
    beams = [[(float(w["start"][j] + first[j] + e[0, j]), j, None)] for j in range(N)]
    for row in e[1:]:
        nxt = []
        for j in range(N):
            some = sorted(((s[0] + trans[i, j], i, r) for i in range(N) for r, s in enumerate(beams[i])), key=lambda x: (-x[0], x[1], x[2]))[:k]
            nxt.append([(v + float(row[j]), j, beams[i][r]) for v, i, r in some])
        beams = nxt
    ends = sorted(((s[0] + float(w["end"][j]), j, r) for j in range(N) for r, s in enumerate(beams[j])), key=lambda x: (-x[0], x[1], x[2]))[:k]
    out = []
    for score, j, r in ends:
        node, path = beams[j][r], []
        while node is not None:
            path.append(node[1])
            node = node[2]
        out.append((path[::-1], score))
    return out


def crf_loss(e: np.ndarray, gold: list[int], w: dict[str, np.ndarray]) -> float:
    """Negative log-likelihood of the gold path, by its length."""
    step, first = allowed()
    trans = (w["transitions"] + step).astype(np.float64)
    alpha = (w["start"] + first + e[0]).astype(np.float64)
    score = alpha[gold[0]]
    lse = lambda x: x.max(0) + np.log(np.exp(x - x.max(0)).sum(0))
    for t in range(1, len(e)):
        score += trans[gold[t - 1], gold[t]] + e[t, gold[t]]
        alpha = lse(alpha[:, None] + trans) + e[t]
    return float((lse(alpha + w["end"]) - score - w["end"][gold[-1]]) / len(e))


def tokenize(text: str) -> list[tuple[int, int]]:
    """Token offsets in code points, as ``functions.spans.token_spans``."""
    import regex

    pat = r"[㐀-鿿豈-﫿]|[[\p{L}\p{N}\p{M}]--[㐀-鿿豈-﫿]]+|[^\s\x1c-\x1f]"
    return [m.span() for m in regex.finditer(pat, text, regex.V1)]


def encode(text: str | None, gap: bool = False) -> tuple[list[list[int]], list[tuple[int, int]]] | None:
    """(byte ids of each token, offsets), or nothing for a text beyond the limits."""
    if text is None or len(text) > MAX_CHARS:
        return None
    at = tokenize(text)
    if not 0 < len(at) <= MAX_TOKENS:
        return None
    rows, end = [], 0
    for lo, hi in at:
        raw = text[lo:hi].encode("utf-8", "surrogatepass")
        if len(raw) > MAX_BYTES or (len(raw) > hi - lo and any(0xD800 <= ord(c) < 0xE000 for c in text[lo:hi])):
            return None
        before = text[end:lo]
        lead = b"" if not gap or not before else b"\n" if "\n" in before or "\r" in before else b" "
        rows.append([x + 1 for x in lead + raw])
        end = hi
    return rows, at


def path_spans(path: list[int], at: list[tuple[int, int]], text: str) -> list[dict]:
    out, before = [], 0
    for tag, (lo, hi) in zip(path, at):
        field = (tag - 1) // 2
        if tag and tag % 2 == 0 and before in (tag, tag - 1):
            out[-1] |= {"end": hi, "raw": text[out[-1]["start"] : hi]}
        elif tag:
            out.append({"label": FIELDS[field], "start": lo, "end": hi, "raw": text[lo:hi]})
        before = tag
    return out


def parse_batch(texts: list[str | None], w: dict[str, np.ndarray], gap: bool, size: int = 64, decoder: str = "viterbi") -> list[dict]:
    """Parses of a batch; rows of like length share a forward pass."""
    items = [encode(t, gap) for t in texts]
    out = [{"status": "unsupported", "components": [], "offset_encoding": "unicode-codepoints"} for _ in texts]
    todo = sorted((i for i, x in enumerate(items) if x), key=lambda i: len(items[i][0]))
    for k in range(0, len(todo), size):
        some = todo[k : k + size]
        lengths = np.array([len(items[i][0]) for i in some])
        ids = np.zeros((len(some), lengths.max(), max(len(r) for i in some for r in items[i][0])), np.int64)
        for r, i in enumerate(some):
            for t, row in enumerate(items[i][0]):
                ids[r, t, : len(row)] = row
        e = forward(w, ids, lengths)
        if not np.isfinite(e).all():
            raise FloatingPointError("non-finite emissions")
        for path, i in zip(DECODERS[decoder](e, lengths, w), some):
            out[i] = {"status": "unassessed", "components": path_spans(path, items[i][1], texts[i]), "offset_encoding": "unicode-codepoints"}
    return out


def parse(df: DataFrame, model: bytes, column: str = "text", decoder: str = "viterbi") -> DataFrame:
    """Adds parse: status, components, offset encoding. The model (150 k weights) is broadcast; nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"status string, components {SPANS}, offset_encoding string")
    def run(texts: pd.Series) -> pd.DataFrame:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        w, gap = read_model(shared.value)
        return pd.DataFrame(parse_batch(texts.tolist(), w, gap, decoder=decoder), columns=["status", "components", "offset_encoding"])

    return df.withColumn("parse", run(F.col(column)))
