"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters with a word channel (an embedding by its hash) and two character channels (the
embeddings of its byte n-grams and of its prefixes, summed and divided by the root of their number). Two gated recurrent passes read each
window of words, attention pools their states, and a document's score is that of its strongest
window. All overlapping windows of the whole text are scored. Embeddings and weights are all
trained together, and labels reach the network in no other way. It is fitted on a bounded sample
of labelled rows (``SAMPLE``: at most that many of each label, of texts up to ``TRAIN_BYTES``);
labels of rows whose crc32(doc_id) is 0 modulo 5 are never read for it.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import tidy
from .textkit import U64, buffers, chunks, mix, ragged, words

SAMPLE = {1: 2000, 0: 4000}
TRAIN_BYTES = 4096
WINDOW, STRIDE = 32, 16
HIDDEN, EMBED = 8, 8
WORD_BITS, CHAR_BITS = 15, 16
GRAM = 5
PREFIXES = range(3, 9)
INPUTS = 3 * EMBED
f32 = np.float32


def sigmoid(x):
    return f32(0.5) * (np.tanh(f32(0.5) * x) + f32(1))


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> U64(64 - bits)).astype(np.int32)


class Bags:
    """For each distinct word its rows of a table (one at least), ragged."""

    def __init__(self, owner: np.ndarray, slots: np.ndarray, n: int):
        order = np.argsort(owner, kind="stable")
        self.slots, self.num = slots[order], np.bincount(owner, minlength=n)
        self.at = np.cumsum(self.num) - self.num

    def rows(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        num = self.num[word]
        return self.slots[ragged(self.at[word], num)], num


class Words:
    """Distinct words of a chunk with their hashed features, and the windows of each row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        b, s, e, row, h = words(data, offs, alnum=True)
        n = len(offs) - 1
        uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
        s, e, self.n = s[at], e[at], len(uniq)
        self.word = slot(uniq, WORD_BITS)
        every = np.arange(self.n)
        rolled = np.zeros(max(len(b) - GRAM + 1, 0), U64)
        for i in range(GRAM):
            rolled = rolled * U64(0x100000001B3) + b[i : i + len(rolled)]
        num = np.maximum(e - s - GRAM + 1, 0)
        short = np.flatnonzero(num == 0)
        self.grams = Bags(np.concatenate([np.repeat(every, num), short]), np.concatenate([slot(rolled[ragged(s, num)] + U64(GRAM), CHAR_BITS), slot(uniq[short] + U64(1), CHAR_BITS)]), self.n)
        owner, slots, head = [], [], np.zeros(self.n, U64)
        for i in range(PREFIXES[-1]):
            live = np.flatnonzero(s + i < e)
            head[live] = head[live] * U64(0x100000001B3) + b[s[live] + i] + U64(1)
            if i + 1 in PREFIXES:
                live = live if i + 1 > PREFIXES[0] else every  # the shortest prefix of a shorter word is the word
                owner.append(live)
                slots.append(slot(head[live] + U64(i + 1 << 56), CHAR_BITS))
        self.heads = Bags(np.concatenate(owner), np.concatenate(slots), self.n)
        # windows
        count = np.bincount(row, minlength=n)
        first = np.cumsum(count) - count
        num = np.where(count == 0, 0, np.maximum(-(-(count - WINDOW) // STRIDE), 0) + 1)
        self.row = np.repeat(np.arange(n), num)
        nth = np.arange(int(num.sum())) - np.repeat(np.cumsum(num) - num, num)
        start = np.minimum(nth * STRIDE, np.maximum(count[self.row] - WINDOW, 0))
        pos = start[:, None] + np.arange(WINDOW)
        mask = pos < count[self.row][:, None]
        inv = np.append(inv, self.n).astype(np.int32)
        self.index = inv[np.where(mask, first[self.row][:, None] + pos, len(inv) - 1)]
        self.mask = mask.T.astype(f32)


class Model:
    def __init__(self, seed: int = 11):
        g = np.random.Generator(np.random.Philox(seed))
        rnd = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(f32)
        self.tables = {k: (g.standard_normal((1 << bits, EMBED)) * 0.01).astype(f32) for k, bits in (("word", WORD_BITS), ("char", CHAR_BITS))}
        self.p = {}
        for k in "fb":
            self.p |= {f"W{k}": rnd(INPUTS, 3 * HIDDEN), f"U{k}": rnd(HIDDEN, 3 * HIDDEN), f"c{k}": np.zeros(3 * HIDDEN, f32)}
        self.p |= {"A": rnd(2 * HIDDEN, HIDDEN), "a": rnd(HIDDEN, 1)[:, 0], "o": rnd(2 * HIDDEN, 1)[:, 0], "c": np.zeros(1, f32)}

    def inputs(self, w: Words, some: np.ndarray | None = None) -> np.ndarray:
        """Input row of each distinct word, or of some, and a zero row last."""
        some = np.arange(w.n) if some is None else some
        x = np.zeros((len(some) + 1, INPUTS), f32)
        if len(some):
            x[:-1, :EMBED] = self.tables["word"][w.word[some]]
            for k, bags in ((1, w.grams), (2, w.heads)):
                rows, num = bags.rows(some)
                x[:-1, k * EMBED : (k + 1) * EMBED] = np.add.reduceat(self.tables["char"][rows], np.cumsum(num) - num, axis=0) / np.sqrt(num, dtype=f32)[:, None]
        return x

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window; x: word rows, index: [windows, WINDOW], mask: [WINDOW, windows]."""
        n, H, p = len(index), HIDDEN, self.p
        hs, tape = np.zeros((WINDOW, n, 2 * H), x.dtype), {}
        for k, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            xw = x @ p["W" + k] + p["c" + k]
            h = np.zeros((n, H), x.dtype)
            for t in order:
                gx, gh = xw[index[:, t]], h @ p["U" + k]
                zr = sigmoid(gx[:, : 2 * H] + gh[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(gx[:, 2 * H :] + r * gh[:, 2 * H :])
                m = mask[t][:, None]
                new = h + m * (1 - z) * (c - h)
                if keep:
                    tape[k, t] = (h, z, r, c, gh[:, 2 * H :])
                h = new
                hs[t, :, (0 if k == "f" else H) : (H if k == "f" else 2 * H)] = h
        u = np.tanh(hs @ p["A"])
        s = u @ p["a"] + (mask - 1) * f32(1e4)
        s = np.exp(s - s.max(0)) * mask
        s /= np.maximum(s.sum(0), f32(1e-9))
        pooled = np.einsum("tn,tnh->nh", s, hs)
        out = pooled @ p["o"] + p["c"][0]
        return (out, (hs, tape, u, s, pooled)) if keep else out

    def backward(self, x, index, mask, kept, dout):
        """Gradients by parameter and of the word rows."""
        (hs, tape, u, s, pooled), p, H = kept, self.p, HIDDEN
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["c"] = pooled.T @ dout, np.array([dout.sum()], x.dtype)
        dpool = dout[:, None] * p["o"]
        dhs = s[:, :, None] * dpool
        ds = np.einsum("nh,tnh->tn", dpool, hs)
        ds = s * (ds - (s * ds).sum(0))
        g["a"] = np.einsum("tnh,tn->h", u, ds)
        du = ds[:, :, None] * p["a"] * (1 - u * u)
        g["A"] = np.einsum("tni,tnj->ij", hs, du)
        dhs = dhs + du @ p["A"].T
        dx = np.zeros_like(x)
        for k, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            lo = 0 if k == "f" else H
            dh = np.zeros((len(index), H), x.dtype)
            dgates = np.empty((WINDOW, len(index), 3 * H), x.dtype)
            for t in order:
                h, z, r, c, ghn = tape[k, t]
                dh = dh + dhs[t, :, lo : lo + H]
                m = mask[t][:, None]
                dc = dh * m * (1 - z) * (1 - c * c)
                dz = -dh * m * (c - h) * z * (1 - z)
                dr = dc * ghn * r * (1 - r)
                dgates[t] = dgx = np.concatenate([dz, dr, dc], 1)
                dgh = np.concatenate([dz, dr, dc * r], 1)
                g["U" + k] += h.T @ dgh
                dh = dh * (1 - m * (1 - z)) + dgh @ p["U" + k].T
            flat = dgates.reshape(-1, 3 * H)
            g["c" + k] += flat.sum(0)
            g["W" + k] += x[index.T.ravel()].T @ flat
            by_word = np.zeros((len(x), 3 * H), x.dtype)
            np.add.at(by_word, index.T.ravel(), flat)
            dx += by_word @ p["W" + k].T
        return g, dx

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of each row of a chunk; a text without words scores 0."""
        w = Words(data, offs)
        out = np.zeros(len(offs) - 1)
        if len(w.row):
            prob = 1 / (1 + np.exp(-self.forward(self.inputs(w), w.index, w.mask).astype(np.float64)))
            np.maximum.at(out, w.row, prob)
        return out


class Trainer:
    """Adam on the weights, plain steps on the tables: what many documents share moves further than what few do.

    Rows that only one word of one document leads to stay as they are: they could only learn that document.
    """

    def __init__(self, model: Model, w: Words, rate: float, table_rate: float):
        self.model, self.rate, self.table_rate, self.step = model, rate, table_rate, 0
        self.mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
        pair = np.unique(np.repeat(w.row, WINDOW) * (w.n + 1) + w.index.ravel())  # distinct (document, word)
        some = np.minimum(np.bincount(pair % (w.n + 1), minlength=w.n + 1)[: w.n], 2)
        self.learns = {"word": np.bincount(w.word, some, len(model.tables["word"])) > 1}
        self.learns["char"] = sum(np.bincount(bags.slots, np.repeat(some, bags.num), len(model.tables["char"])) for bags in (w.grams, w.heads)) > 1

    def weights(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, v in grads.items():
            a, b = self.mom[k]
            a += 0.1 * (v - a)
            b += 0.001 * (v * v - b)
            self.model.p[k] -= f32(self.rate) * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.999**self.step)) + f32(1e-8))

    def rows(self, table: str, rows: np.ndarray, grad: np.ndarray) -> None:
        on = self.learns[table][rows]
        np.subtract.at(self.model.tables[table], rows[on], f32(self.table_rate) * grad[on])

    def inputs(self, w: Words, some: np.ndarray, dx: np.ndarray) -> None:
        self.rows("word", w.word[some], dx[:, :EMBED])
        parts = [(bags.rows(some), dx[:, k * EMBED : (k + 1) * EMBED]) for k, bags in ((1, w.grams), (2, w.heads))]
        self.rows("char", np.concatenate([r for (r, _), _ in parts]), np.concatenate([np.repeat(d / np.sqrt(n, dtype=f32)[:, None], n, 0) for (_, n), d in parts]))


def fit(texts: list[str], label: np.ndarray, steps: int = 260, epochs: int = 4, batch: int = 64, rate: float = 0.02, table_rate: float = 3.0, drop: float = 0.3, top: int = 4, seed: int = 5) -> Model | None:
    """Train on whole texts; a document's loss is that of its ``top`` strongest windows at the time.

    The word channel is left out for a share ``drop`` of a step's words, so that the characters learn too.
    """
    if not len(label) or label.min() == label.max():
        return None
    g = np.random.Generator(np.random.Philox(seed))
    w = Words(*buffers(pa.array(texts, pa.string())))
    at = np.searchsorted(w.row, np.arange(len(label) + 1))
    docs = np.flatnonzero(np.diff(at))
    model = Model()
    trainer = Trainer(model, w, rate, table_rate)
    while len(docs) and trainer.step < max(steps, epochs * len(docs) // batch):
        for some in np.array_split(g.permutation(docs), max(1, len(docs) // batch)):
            size = at[some + 1] - at[some]
            win = ragged(at[some], size)
            own, index = np.unique(w.index[win], return_inverse=True)
            index = index.reshape(-1, WINDOW)
            pad = own[-1] == w.n
            own = own[:-1] if pad else own
            x = model.inputs(w, own)
            keep = (g.random(len(own)) >= drop).astype(f32) / f32(1 - drop)
            x[:-1, :EMBED] *= keep[:, None]
            logit = model.forward(x, index, w.mask[:, win])
            # the strongest windows stand for a document, weighted by their strength: at first alike, in the end the one that scores
            doc = np.repeat(np.arange(len(some)), size)
            rank = np.lexsort((-logit, doc))
            best = rank[np.arange(len(rank)) - np.repeat(np.cumsum(size) - size, size) < top]
            idx, mask, doc = index[best], w.mask[:, win[best]], doc[best]
            out, kept = model.forward(x, idx, mask, keep=True)
            weight = np.exp(out - np.maximum.reduceat(out, np.searchsorted(doc, np.arange(len(some))))[doc])
            weight /= np.bincount(doc, weight)[doc]
            error = sigmoid(np.bincount(doc, weight * out).astype(f32)) - label[some]
            grads, dx = model.backward(x, idx, mask, kept, (weight * error[doc] / len(some)).astype(f32))
            dx[:-1, :EMBED] *= keep[:, None]
            hit = np.unique(idx)
            hit = hit[hit < len(own)]
            trainer.weights(grads)
            trainer.inputs(w, own[hit], dx[hit])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """At most ``sample[y]`` labelled rows of each label y, by a hash of the id, of ids not held out."""
    ok = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    ok = ok.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mark = F.xxhash64("doc_id", F.lit(2026))
    picked = None
    for y, most in sample.items():
        part = ok.where(F.col("toxic") == y).orderBy(mark, "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES))
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")  # the sample's bound is the broadcast's


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The network fitted on the sample, by one task: its rows and bytes are bounded, and a lost executor's task is run again."""

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        rows = list({r[0]: r for r in rows}.values())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows], np.array([r[2] for r in rows], f32)))], pa.binary())], ["model"])

    made = training_rows(docs, labels).repartition(1).mapInArrow(tidy(run), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def score_rows(spark: SparkSession, docs: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """Each row, or the given columns of it (struct ``row``, so that no name can clash), and its ``score``."""
    columns = columns or docs.columns
    shared = spark.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches):
        m = shared.value
        for b in batches:
            data, offs = buffers(b.column(1) if b.num_columns > 1 else b.column(0).field("text"))
            score = np.zeros(b.num_rows)
            if m is not None:
                for i, j in chunks(offs, 1 << 19):
                    score[i:j] = m.score(data, offs[i : j + 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["row", "score"])

    given = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), *([] if "text" in columns else ["text"]))
    return given.mapInArrow(tidy(run), given.select("row").schema.add("score", "double"))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null, empty and wordless texts score 0; very long texts are scored window by window to their
    end; null ids are scored like others and are not held out; repeated rows get equal scores, one
    row each; extra columns are ignored; empty tables give an empty result. Without labels of both
    kinds every score is 0. Of labels that contradict one another the toxic one counts; a tie of
    windows is one score; a score of 0.5 is predicted toxic.
    """
    out = score_rows(spark, docs, train(docs, labels), ["doc_id"]).select("row.doc_id", "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
