"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word comes in as its own vector (words of the sample) and the mean of its character trigrams'
vectors (all words).  Every overlapping window of words is read in both directions, pooled by
attention and scored; a text is as toxic as its most toxic window.

The network is fitted on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomfold.llm.common import as_bytes, free_name, held_out, map_columns, runs_of_bytes


@dataclass(frozen=True)
class ToxicRules:
    """``sample``: labelled documents taken of each class, the bound of what is fitted on.

    ``window``/``stride`` in words: passages of up to ``window - stride + 1`` words lie whole in a
    window wherever they stand.  ``folds``: the share of ids kept from training.
    """
    sample: int = 1500
    window: int = 32
    stride: int = 8
    hidden: int = 8
    word_dims: int = 8
    char_dims: int = 8
    char_buckets: int = 4096
    least_docs: int = 3
    epochs: int = 6
    rate: float = 0.01
    folds: int = 5
    seed: int = 11


_EDGE = b".,;:!?\"'()[]{}*#%&$|<>"


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(_EDGE) or w for w in text.lower().split()]


def trigrams(word: bytes, buckets: int) -> list[int]:
    marked = b"^" + word + b"$"
    return [zlib.crc32(marked[i:i + 3]) % buckets for i in range(max(1, len(marked) - 2))]


#: CRC-32's table of steps by a byte.
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)


def all_trigrams(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``trigrams`` of all words (none empty), one after the other, and how many each has."""
    marked = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), np.uint8)
    lens = np.fromiter(map(len, words), np.int64, len(words))                  # n letters and two marks: n trigrams
    first = np.arange(lens.sum()) + np.repeat(2 * np.arange(len(words)), lens)
    crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
    for i in range(3):
        crc = _CRC[(crc ^ marked[first + i]) & 0xFF] ^ (crc >> np.uint32(8))
    return (~crc % np.uint32(buckets)).astype(np.int64), lens


def windows_of(n: int, rules: ToxicRules) -> np.ndarray:
    """First words of the windows: overlapping, the last one ending with the text."""
    last = max(0, n - rules.window)
    starts = np.arange(0, last + 1, rules.stride)
    return starts if not n or starts[-1] == last else np.append(starts, last)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class Network:
    """Parameters, forward and backward passes.  Arrays run (time, window, feature)."""

    def __init__(self, rules: ToxicRules, n_words: int):
        rng = np.random.default_rng(rules.seed)
        d, h = rules.word_dims + rules.char_dims, rules.hidden
        self.rules = rules
        self.p = {"words": rng.normal(0, 0.1, (n_words + 1, rules.word_dims)), "chars": rng.normal(0, 0.1, (rules.char_buckets, rules.char_dims)),
                  "a": rng.normal(0, 0.3, 2 * h), "w": rng.normal(0, 0.3, 2 * h), "b": np.zeros(1)}
        for side in "fb":
            self.p |= {f"x{side}": rng.normal(0, 1 / np.sqrt(d), (d, 3 * h)), f"h{side}": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)), f"o{side}": np.zeros(3 * h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def read(self, side: str, x: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Hidden states along one direction; ``x`` holds the projected inputs, gates first."""
        h_of, n = self.p[f"h{side}"], self.rules.hidden
        h, out = np.zeros((x.shape[1], n), np.float32), np.empty((*x.shape[:2], n), np.float32)
        for t in (range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)):
            u = h @ h_of
            g = _sigmoid(x[t, :, :2 * n] + u[:, :2 * n])
            z, r = g[:, :n], g[:, n:]
            c = np.tanh(x[t, :, 2 * n:] + r * u[:, 2 * n:])
            new = c + z * (h - c)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if trace is not None:
                trace.append((t, h, z, r, c, u[:, 2 * n:]))
            out[t] = h = new
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray | None):
        e = states @ self.p["a"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[:, :, None] * states).sum(0)
        return alpha, pooled, pooled @ self.p["w"] + self.p["b"][0]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs of both directions for word vectors: forward columns, then backward ones."""
        return np.concatenate([x @ self.p["xf"] + self.p["of"], x @ self.p["xb"] + self.p["ob"]], axis=-1).astype(np.float32)

    def logits(self, table: np.ndarray, at: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Scores of windows of word numbers (time, window) into a table of projections."""
        x, n = table[at], 3 * self.rules.hidden
        states = np.concatenate([self.read("f", x[:, :, :n], mask), self.read("b", x[:, :, n:], mask)], axis=2)
        return self.pool(states, mask)[2]

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted log loss for word vectors ``x``; also those of ``x``."""
        p, n, grad = self.p, self.rules.hidden, {}
        traces = {"f": [], "b": []}
        both = [self.read(s, x @ p[f"x{s}"] + p[f"o{s}"], mask, traces[s]) for s in "fb"]
        states = np.concatenate(both, axis=2)
        alpha, pooled, logit = self.pool(states, mask)
        d = ((_sigmoid(logit) - target) * weight / len(target)).astype(np.float32)
        grad["w"], grad["b"] = pooled.T @ d, np.array([d.sum()])
        d_pooled = d[:, None] * p["w"]
        d_alpha = (states * d_pooled).sum(2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        grad["a"] = (d_e[:, :, None] * states).sum((0, 1))
        d_states = alpha[:, :, None] * d_pooled + d_e[:, :, None] * p["a"]
        d_x = np.zeros_like(x)
        for k, s in enumerate("fb"):
            grad[f"x{s}"], grad[f"h{s}"], grad[f"o{s}"] = np.zeros_like(p[f"x{s}"]), np.zeros_like(p[f"h{s}"]), np.zeros_like(p[f"o{s}"])
            carry = np.zeros((x.shape[1], n), np.float32)
            for t, h, z, r, c, uc in reversed(traces[s]):
                m = mask[t][:, None]
                total = carry + d_states[t, :, k * n:(k + 1) * n]
                d_new = np.where(m, total, 0)
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * uc * r * (1 - r)
                d_pre = np.concatenate([d_z, d_r, d_c], axis=1)
                d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
                grad[f"x{s}"] += x[t].T @ d_pre
                grad[f"o{s}"] += d_pre.sum(0)
                grad[f"h{s}"] += h.T @ d_u
                d_x[t] += d_pre @ p[f"x{s}"].T
                carry = np.where(m, d_new * z, total) + d_u @ p[f"h{s}"].T
        return grad, d_x


class Model:
    """A fitted network with its words and the shift from the sample's odds to the corpus's."""

    def __init__(self, network: Network | None, words: dict[bytes, int], shift: float):
        self.network, self.words, self.shift = network, words, shift

    def vectors(self, words: list[bytes]) -> np.ndarray:
        r, p = self.network.rules, self.network.p
        out = np.empty((len(words), r.word_dims + r.char_dims), np.float32)
        out[:, :r.word_dims] = p["words"][[self.words.get(w, 0) for w in words]]
        if words:
            grams, lens = all_trigrams(words, r.char_buckets)
            out[:, r.word_dims:] = np.add.reduceat(p["chars"][grams], np.cumsum(lens) - lens, axis=0) / lens[:, None]
        return out


def fit_network(texts: list[bytes], labels: np.ndarray, rules: ToxicRules) -> tuple[Network, dict[bytes, int]]:
    """Fits on whole texts: each epoch takes every text's most toxic window so far, and a random one of the clean texts.

    A word's first dimension starts as its log odds over the sample's texts.
    """
    rng = np.random.default_rng(rules.seed)
    one: dict[bytes, bytes] = {}                                               # a word's occurrences share one object
    split = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]
    docs = [Counter(), Counter()]
    for words, y in zip(split, labels):
        docs[y].update(set(words))
    common = sorted(w for w in docs[0].keys() | docs[1].keys() if docs[0][w] + docs[1][w] >= rules.least_docs)
    number = {w: i + 1 for i, w in enumerate(common)}
    net = Network(rules, len(common))
    size = [max(1, int((labels == y).sum())) for y in (0, 1)]
    for w, i in number.items():
        net.p["words"][i, 0] = np.clip(np.log((docs[1][w] + 0.5) / (size[1] + 1)) - np.log((docs[0][w] + 0.5) / (size[0] + 1)), -3, 3)
    every = sorted({w for words in split for w in words})
    own = {w: i + 1 for i, w in enumerate(every)}                              # 0: no word
    word_no = np.array([0] + [number.get(w, 0) for w in every])
    grams, lens = all_trigrams(every, rules.char_buckets)
    flat, lens = np.concatenate([[0], grams]), np.concatenate([[1], lens])
    first = np.cumsum(lens) - lens
    at, doc = [], []
    for k, words in enumerate(split):
        if words:
            ids = np.array([own[w] for w in words] + [0] * (rules.window - len(words)), np.int32)
            starts = windows_of(len(words), rules)
            at.append(ids[starts[:, None] + np.arange(rules.window)])
            doc.append(np.full(len(starts), k))
    if not at:
        return net, number
    at, doc = np.concatenate(at).T, np.concatenate(doc)
    mask = at > 0
    del split, one
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    target = np.asarray(labels, np.float32)[doc]

    def inputs(ids):
        chars = np.add.reduceat(net.p["chars"][flat], first, axis=0) / lens[:, None]
        table = np.concatenate([net.p["words"][word_no], chars], axis=1).astype(np.float32)
        return table if ids is None else table[ids]

    mean, square, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0

    def worst(score):
        order = np.lexsort((-score, doc))
        return order[starts]
    odds = net.p["words"][:, 0][word_no]
    score = np.concatenate([(odds[at[:, a:a + 2048]] * mask[:, a:a + 2048]).max(0) for a in range(0, at.shape[1], 2048)])
    for epoch in range(rules.epochs):
        if epoch:
            table = net.project(inputs(None))
            score = np.concatenate([net.logits(table, at[:, a:a + 2048], mask[:, a:a + 2048]) for a in range(0, at.shape[1], 2048)])
        chosen = worst(score)
        extra = rng.integers(0, at.shape[1], len(chosen))
        chosen = np.concatenate([chosen, extra[target[extra] == 0]])
        rng.shuffle(chosen)
        for a in range(0, len(chosen), 128):
            some = chosen[a:a + 128]
            ids = at[:, some]
            used, where = np.unique(ids, return_inverse=True)
            chars = np.stack([net.p["chars"][flat[first[u]:first[u] + lens[u]]].mean(0) for u in used])
            x = np.concatenate([net.p["words"][word_no[used]], chars], axis=1).astype(np.float32)[where.reshape(ids.shape)]
            grad, d_x = net.gradients(x, mask[:, some], target[some], np.ones(len(some), np.float32))
            per = np.zeros((len(used), x.shape[2]), np.float32)
            np.add.at(per, where.ravel(), d_x.reshape(-1, x.shape[2]))
            grad["words"], grad["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
            np.add.at(grad["words"], word_no[used], per[:, :rules.word_dims])
            grad["words"][0] = 0
            for i, u in enumerate(used):
                np.add.at(grad["chars"], flat[first[u]:first[u] + lens[u]], per[i, rules.word_dims:] / lens[u])
            step += 1
            for k, g in grad.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rules.rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net, number


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicRules = ToxicRules(), text: str = "text") -> Model:
    """Learns from ``labels`` (doc_id, toxic) outside the held-out fold; at most ``sample`` documents of each class, chosen by a hash of their ids."""
    known = (labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), rules.folds)).groupBy("doc_id").agg(F.max("toxic").alias("_toxic")))
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("_toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.sample)
        picked = part if picked is None else picked.unionByName(part)
    rows = (docs.select("doc_id", as_bytes(docs, text).alias("_bytes")).join(F.broadcast(picked), "doc_id")
            .groupBy("doc_id").agg(F.first("_toxic").alias("y"), F.min("_bytes").alias("text")).orderBy("doc_id").collect())
    if len({r["y"] for r in rows}) < 2:
        return Model(None, {}, -20.0 if not counts.get(1) else 20.0 if not counts.get(0) else 0.0)
    y = np.array([r["y"] for r in rows])
    network, words = fit_network([bytes(r["text"]) for r in rows], y, rules)
    shift = np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return Model(network, words, float(shift))


class _Table(dict):
    """Numbers of the words met, with their projected inputs; number 0 is no word."""

    def __init__(self, model: Model, most: int = 200_000):
        super().__init__()
        self.model, self.most = model, most
        self.rows, self.n = np.zeros((4096, 6 * model.network.rules.hidden), np.float32), 1

    def numbers(self, words: list[list[bytes]]) -> list[np.ndarray]:
        new = [w for w in set().union(*words) if w not in self]
        if self.n + len(new) > self.most:
            self.clear()
            self.n, new = 1, list(set().union(*words))
        if new:
            if self.n + len(new) > len(self.rows):
                self.rows = np.resize(self.rows, (2 * (self.n + len(new)), self.rows.shape[1]))
            for a in range(0, len(new), 20_000):
                part = new[a:a + 20_000]
                self.rows[self.n:self.n + len(part)] = self.model.network.project(self.model.vectors(part))
                self.update(zip(part, range(self.n, self.n + len(part))))
                self.n += len(part)
        return [np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in words]


def score_texts(texts: list[bytes], table: _Table, rules: ToxicRules) -> np.ndarray:
    """Logit of each text's most toxic window; minus infinity for a text without words."""
    net, out = table.model.network, np.full(len(texts), -np.inf)
    ids = table.numbers([words_of(t) for t in texts])
    at, doc, lens = [], [], []
    for k, x in enumerate(ids):
        if len(x):
            starts = windows_of(len(x), rules)
            padded = x if len(x) >= rules.window else np.pad(x, (0, rules.window - len(x)))
            at.append(padded[starts[:, None] + np.arange(rules.window)])
            doc.append(np.full(len(starts), k)), lens.append(np.full(len(starts), min(len(x), rules.window)))
    if not at:
        return out
    at, doc, lens = np.concatenate(at).T, np.concatenate(doc), np.concatenate(lens)
    for whole in (True, False):
        some = np.flatnonzero((lens == rules.window) == whole)
        for a in range(0, len(some), 4096):
            part = some[a:a + 4096]
            mask = None if whole else np.arange(rules.window)[:, None] < lens[part]
            np.maximum.at(out, doc[part], net.logits(table.rows, at[:, part], mask))
    return out


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: str = "toxicity", rules: ToxicRules = ToxicRules()) -> DataFrame:
    """The columns in ``keep`` (all by default) and the probability ``out`` that label 1 fits the text.

    Texts null or without words score as the corpus's odds less a clear margin; without labels of
    both classes every text scores alike.  Repeated rows score alike; an empty table gives an empty one.
    """
    wanted = docs.columns if keep is None else keep
    names = {c: f"_c{i}" for i, c in enumerate(wanted)}
    source = docs.select(*[docs[c].alias(n) for c, n in names.items()], as_bytes(docs, text).alias("_bytes"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shared.value
        table = _Table(held) if held.network else None

        def step(batch):
            texts = batch.column("_bytes").to_pylist()
            if table is None:
                logit = np.zeros(len(texts))
            else:
                logit = np.concatenate([score_texts(texts[a:b], table, rules) for a, b in runs_of_bytes(texts, 1 << 20)] or [np.empty(0)])
                logit = np.where(np.isinf(logit), -5.0, logit)
            return {"_score": _sigmoid(np.clip(logit + held.shift, -30, 30))}
        return step

    found = map_columns(source, "_score double", make, list(names.values()))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("_score").alias(out if keep is not None else free_name(docs, out)))
