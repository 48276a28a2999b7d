"""Language-model scores by a log-bilinear model, trained in numpy with noise-contrastive estimation.

The corpus gives every word's count.  The most frequent words are the model's classes, with one
for all others and one for the end of a text; a class is predicted from the two words before it by a
bilinear form.  Tasks train on all tokens of their documents by noise contrast and their
parameters are averaged; scoring divides by the sum over all classes, which matrix products give
for every context, so probabilities are normalised.  A word outside the classes has its class's
probability times its smoothed share of that class.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomfold.lineage import keep
from loomfold.llm.common import as_bytes, held_out, map_any, map_columns


@dataclass(frozen=True)
class LblRules:
    """``classes``: words of their own class, besides the two for other words and the end.

    ``frequent``: words whose counts are sent to all tasks, at most; others find theirs by a join.
    ``noise`` draws a batch; ``batch`` distinct trigrams a step at most; ``passes`` over a task's trigrams.
    """
    classes: int = 1022
    dims: int = 16
    frequent: int = 400_000
    noise: int = 96
    batch: int = 4096
    passes: int = 3
    rounds: int = 1
    rate: float = 0.3
    add: float = 0.1
    folds: int = 10
    seed: int = 5


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over ``_bytes`` of all rows; tasks count first, in parts of bounded size."""
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("_bytes").to_pylist():
                counts.update(text.lower().split())
                if len(counts) > 400_000:
                    yield {"word": list(counts), "c": list(counts.values())}
                    counts.clear()
        yield {"word": list(counts), "c": list(counts.values())}

    return map_any(docs.select("_bytes"), "word binary, c long", run).groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Counts of the most frequent words: all from some count on, at most ``most``, by a histogram of eighths of octaves."""
    step = F.floor(F.log2("c") * 8)
    levels, total = {r["s"]: r["n"] for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}, 0
    least = None
    for s in sorted(levels, reverse=True):
        total += levels[s]
        if total > most:
            break
        least = s
    if least is None:
        return {}
    return {bytes(r["word"]): r["c"] for r in counts.where(step >= int(least)).collect()}


class Lbl:
    """Parameters.  Contexts are class numbers too; number ``other`` stands for other words, ``edge`` for the text's ends."""

    def __init__(self, log_share: np.ndarray, rules: LblRules):
        rng, k = np.random.default_rng(rules.seed), len(log_share)
        self.noise_log = log_share
        self.p = {"context": rng.normal(0, 0.1, (k, rules.dims)), "near": np.ones(rules.dims), "far": np.full(rules.dims, 0.5),
                  "target": rng.normal(0, 0.1, (k, rules.dims)), "bias": log_share.copy()}
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}

    def predicted(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.p["context"][far] * self.p["far"] + self.p["context"][near] * self.p["near"]

    def log_sums(self) -> np.ndarray:
        """Logarithm of the normaliser of every context (far, near), a block of far words at a time."""
        k = len(self.noise_log)
        out = np.empty((k, k), np.float32)
        for far in range(k):
            s = self.predicted(np.full(k, far), np.arange(k)) @ self.p["target"].T + self.p["bias"]
            top = s.max(1)
            out[far] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return out

    def train(self, codes: np.ndarray, weights: np.ndarray, rules: LblRules) -> None:
        """Noise-contrastive steps (AdaGrad) over distinct trigrams, each weighted by how often it came."""
        p, k = self.p, len(self.noise_log)
        # what comes very often is dealt over several steps, so no step is ruled by one trigram
        parts = np.ceil(weights / (2 * weights.mean())).astype(np.int64)
        codes, weights = np.repeat(codes, parts), np.repeat(weights / parts, parts)
        rng = np.random.default_rng(rules.seed + len(codes))
        share = np.exp(self.noise_log.astype(np.float64))
        share /= share.sum()
        log_kn = np.log(rules.noise * share).astype(np.float32)
        total = {n: np.full(v.shape, 1e-2, np.float32) for n, v in p.items()}

        def summed(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
            hot = np.zeros((k, values.shape[1]), np.float32)
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            hot[rows[first]] = np.add.reduceat(values[order], first, axis=0)
            return hot

        for _ in range(rules.passes):
            order, size = rng.permutation(len(codes)), min(rules.batch, max(256, len(codes) // 100))
            for at in range(0, len(order), size):
                some = order[at:at + size]
                code, w = codes[some], weights[some].astype(np.float32)
                w = w / w.mean()
                target, near, far = code % k, code // k % k, code // (k * k)
                h = self.predicted(far, near)
                drawn = rng.choice(k, rules.noise, p=share)
                q = p["target"][target]
                s = (h * q).sum(1) + p["bias"][target] - log_kn[target]
                g = w * (1 - 1 / (1 + np.exp(-s)))                             # pull the data up
                t = h @ p["target"][drawn].T + p["bias"][drawn] - log_kn[drawn]
                gn = -w[:, None] / (1 + np.exp(-t))                            # push the noise down
                n = len(some)
                d_h = (g[:, None] * q + gn @ p["target"][drawn]) / n
                grad = {"target": summed(target, g[:, None] * h / n) + summed(drawn, gn.T @ h / n),
                        "bias": np.bincount(target, g / n, k).astype(np.float32) + np.bincount(drawn, gn.sum(0) / n, k).astype(np.float32),
                        "near": (d_h * p["context"][near]).sum(0), "far": (d_h * p["context"][far]).sum(0),
                        "context": summed(near, d_h * p["near"]) + summed(far, d_h * p["far"])}
                for name, x in grad.items():
                    total[name] += x * x
                    p[name] += rules.rate * x / np.sqrt(total[name])


def _class_ids(words: list[bytes], class_of: dict[bytes, int], other: int) -> np.ndarray:
    return np.fromiter((class_of.get(w, other) for w in words), np.int64, len(words))


def _trigrams(ids: np.ndarray, edge: int, k: int) -> np.ndarray:
    """Codes (far, near, target) of a text's classes and its end."""
    target, padded = np.append(ids, edge), np.concatenate([[edge, edge], ids])
    return (padded[:-1] * k + padded[1:]) * k + target


def train(docs: DataFrame, class_of: dict[bytes, int], log_share: np.ndarray, rules: LblRules) -> Lbl:
    """Every task trains on all trigrams of its documents (``_bytes``); parameters are averaged by token."""
    model, spark = Lbl(log_share, rules), docs.sparkSession
    k = len(log_share)
    names = sorted(model.p)
    shapes = {n: model.p[n].shape for n in names}
    for _ in range(rules.rounds):
        shared = spark.sparkContext.broadcast((model, class_of))

        def run(batches):
            start, classes = shared.value
            mine, codes, seen = Lbl(start.noise_log, rules), [], 0
            mine.p = {n: v.copy() for n, v in start.p.items()}

            def learn():
                every = np.sort(np.concatenate(codes))
                first = np.flatnonzero(np.diff(every, prepend=-1))
                mine.train(every[first], np.diff(np.append(first, len(every))), rules)

            held = 0
            for batch in batches:
                for text in batch.column("_bytes").to_pylist():
                    codes.append(_trigrams(_class_ids(text.lower().split(), classes, k - 2), k - 1, k))
                    held, seen = held + len(codes[-1]), seen + len(codes[-1])
                    if held > 6_000_000:
                        learn()
                        codes, held = [], 0
            if held:
                learn()
            flat = np.concatenate([mine.p[n].ravel() for n in names]).astype(np.float64)
            if seen:
                yield {"i": np.arange(len(flat), dtype=np.int32), "x": flat * seen, "w": np.full(len(flat), seen, np.int64)}

        rows = map_any(docs.select("_bytes"), "i int, x double, w long", run).groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).collect()
        flat = np.concatenate([model.p[n].ravel() for n in names])
        for r in rows:
            flat[r["i"]] = r["x"]
        at = 0
        for n in names:
            size = int(np.prod(shapes[n]))
            model.p[n], at = flat[at:at + size].reshape(shapes[n]).astype(np.float32), at + size
    return model


_PART = ("_tokens long, _known long, _sum double, _other_sum double, _others long, _lbl double, _rare array<struct<word: binary, n: int>>")


def _scorer(shared, k: int, add: float):
    """A text's tokens, what the frequent words add up to, the classes' log10 probability, and its rare words."""
    def make():
        model, log_sums, numbers, logs = shared.value
        other, edge = k - 2, k - 1
        context, target, bias = model.p["context"], model.p["target"], model.p["bias"]
        far_of, near_of = context * model.p["far"], context * model.p["near"]

        def one(text: bytes):
            words = text.lower().split()
            at = np.fromiter((numbers.get(w, -1) for w in words), np.int64, len(words))
            found = at >= 0
            ids = np.where(found & (at < other), at, other)                    # words are numbered by falling count: classes first
            far, near, aim = np.concatenate([[edge, edge], ids])[:-1], np.concatenate([[edge], ids]), np.append(ids, edge)
            s = ((far_of[far] + near_of[near]) * target[aim]).sum(1) + bias[aim] - log_sums[far, near]
            rare = Counter(w for w, f in zip(words, found) if not f) if not found.all() else {}
            mine = logs[at[found]]
            return (len(words) + 1, int(found.sum()), float(mine.sum()), float(mine[at[found] >= other].sum()), int((ids == other).sum()),
                    float(s.sum(dtype=np.float64)) / np.log(10), [{"word": w, "n": n} for w, n in rare.items()])

        names = [x.split()[0] for x in ("_tokens x", "_known x", "_sum x", "_other_sum x", "_others x", "_lbl x", "_rare x")]

        def step(batch):
            rows = [one(t) for t in batch.column("_bytes").to_pylist()]
            return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}
        return step
    return make


def score(docs: DataFrame, rules: LblRules = LblRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows outside the held-out fold.  A null or empty text is its end alone; rows
    with a null id are never trained on.  Repeated rows are counted and scored each.  Without
    training rows all words are unseen.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(docs, text).alias("_bytes")).withColumn("held_out", held_out(F.col("doc_id"), rules.folds))
    training = rows.where(~F.col("held_out"))
    counts = keep(word_counts(training))
    ends = training.count()
    n_words, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).collect()[0]
    tokens, distinct = total + ends, n_words + (ends > 0)
    frequent = frequent_words(counts, rules.frequent)
    order = sorted(frequent, key=lambda w: (-frequent[w], w))
    classes, k = order[:rules.classes], min(rules.classes, len(order)) + 2
    class_of = {w: i for i, w in enumerate(classes)}
    mass = np.array([frequent[w] for w in classes] + [total - sum(frequent[w] for w in classes), ends], np.float64) + rules.add
    model = train(training, class_of, np.log(mass / mass.sum()), rules)
    logs = np.log10(np.array([frequent[w] for w in order], np.float64) + rules.add)
    shared = spark.sparkContext.broadcast((model, model.log_sums(), {w: i for i, w in enumerate(order)}, logs))
    parts = keep(map_columns(rows, _PART, _scorer(shared, k, rules.add), ["doc_id", "held_out"]).withColumn("_row", F.monotonically_increasing_id()))
    rare = parts.select("_row", F.explode("_rare").alias("r")).select("_row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    found = (rare.join(counts, "word", "left").groupBy("_row").agg(F.sum(F.col("n") * F.log10(c + rules.add)).alias("_rare_sum"),
                                                                  F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("_rare_known")))
    full = parts.drop("_rare").join(found, "_row", "left")
    rest = F.coalesce("_rare_sum", F.lit(0.0))
    end = float(np.log10(ends + rules.add))
    per_token = float(np.log10(tokens + rules.add * (distinct + 1)))
    others = float(np.log10(total - sum(frequent[w] for w in classes) + rules.add * (n_words - len(classes) + 1)))
    return full.select(
        "doc_id", "held_out", F.col("_tokens").alias("n_tokens"), (F.col("_known") + F.coalesce("_rare_known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("_sum") + rest + end - F.col("_tokens") * per_token).alias("base_score"),
        (F.col("_lbl") + F.col("_other_sum") + rest - F.col("_others") * others).alias("score"))
