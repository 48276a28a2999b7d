"""Quality rules by tokeniser fertility.

Public vocabularies measure every whole text: characters per token, the share of pieces that
fall back to single bytes, and the entropy of tokens.  Rejection bands are learnt per language
from all documents, as medians and median deviations, and widen for short texts, whose measures
scatter more.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomfold.lineage import keep
from loomfold.llm.common import as_bytes, free_name, map_columns, runs_of_bytes

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "n_tokens long, chars_per_token double, fallback_share double, entropy double")
NAMES = [x.split()[0] for x in MEASURES.split(", ")]


@dataclass(frozen=True)
class FertilityRules:
    """Every threshold of the rules.

    ``width``: median deviations (scaled to a normal's) that a measure may lie off its language's
    median; ``floors``: the least deviation taken for characters per token (relative), fallback
    share and entropy.  ``ranks``/``pieces``: the vocabularies' files.
    """
    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    entropy_window: int = 256
    width: float = 7.0
    floors: tuple[float, float, float] = (0.01, 0.005, 0.005)
    ranks: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pieces: str = public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def _encoders(ranks: str, pieces: str):
    import sentencepiece
    import tiktoken
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    bpe = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
    fallback = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
    return bpe, sp, fallback


class _Words(dict):
    """Numbers of the words met, with their measures; emptied when it grows past its bounds."""

    def __init__(self, rules: FertilityRules, most: int = 220_000, most_bytes: int = 16 << 20):
        super().__init__()
        self.rules, self.most, self.most_bytes = rules, most, most_bytes
        self.reset()

    def reset(self):
        self.clear()
        self.n = self.n_tokens = self.bytes = 0
        self.hash, self.first, self.tokens_of = np.empty(4096, np.uint64), np.empty(4096, np.int64), np.empty(4096, np.int64)
        self.pieces_of, self.fallback_of, self.tokens = np.empty(4096, np.int64), np.empty(4096, np.int64), np.empty(16384, np.int32)

    def full(self, more: int) -> bool:
        return self.n + more > self.most or self.bytes > self.most_bytes

    def learn(self, words: list[bytes]) -> None:
        bpe, sp, fallback = _encoders(self.rules.ranks, self.rules.pieces)
        texts = [w.decode("utf-8", "replace") for w in words]
        tokens = [bpe.encode_ordinary(" " + t) for t in texts]
        pieces = sp.encode(texts, num_threads=1)
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((x for t in tokens for x in t), np.int32, int(lens.sum()))
        k = np.fromiter(map(len, pieces), np.int64, len(pieces))
        fell = np.add.reduceat(np.append(fallback[np.fromiter((x for t in pieces for x in t), np.int64, int(k.sum()))].astype(np.int64), 0),
                               np.minimum(np.cumsum(k) - k, k.sum())) * (k > 0)
        end = self.n + len(words)
        if end > len(self.hash):
            for name in ("hash", "first", "tokens_of", "pieces_of", "fallback_of"):
                setattr(self, name, np.resize(getattr(self, name), 2 * end))
        if self.n_tokens + len(flat) > len(self.tokens):
            self.tokens = np.resize(self.tokens, 2 * (self.n_tokens + len(flat)))
        at = slice(self.n, end)
        self.hash[at] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.tokens_of[at], self.first[at] = lens, self.n_tokens + np.cumsum(lens) - lens
        self.pieces_of[at], self.fallback_of[at] = k, fell
        self.tokens[self.n_tokens:self.n_tokens + len(flat)] = flat
        self.update(zip(words, range(self.n, end)))
        self.n, self.n_tokens, self.bytes = end, self.n_tokens + len(flat), self.bytes + sum(map(len, words))


#: The characters counted as symbols, and bytes that start no character or are white space.
_SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"


def repeated_words(hashes: np.ndarray, width: int) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for i in range(width):
        windows = (windows ^ hashes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        windows ^= windows >> np.uint64(29)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge[:n] += hit
    edge[width:width + n] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _c_log_c(sorted_rows: np.ndarray) -> float:
    """Sum of c * log2(c) over the counts of equal values in every row."""
    rows, width = sorted_rows.shape
    new = np.ones((rows, width), bool)
    new[:, 1:] = sorted_rows[:, 1:] != sorted_rows[:, :-1]
    at = np.flatnonzero(new.ravel())
    counts = np.diff(np.append(at, rows * width))
    return float((counts * np.log2(counts)).sum())


def token_entropy(tokens: np.ndarray, width: int) -> float:
    """Entropy over consecutive windows of tokens, as a share of the most possible (0 to 1)."""
    n = len(tokens)
    if n < 2:
        return 0.0
    full, total = n // width, 0.0
    if full:
        rows = np.sort(tokens[:full * width].reshape(full, width), axis=1)
        total += (full * width * np.log2(width) - _c_log_c(rows)) / np.log2(width)
    rest = n - full * width
    if rest == 1:
        total += 1.0
    elif rest:
        total += (rest * np.log2(rest) - _c_log_c(np.sort(tokens[n - rest:])[None, :])) / np.log2(rest)
    return max(0.0, total / n)


def _measurer(rules: FertilityRules):
    def make():
        known = _Words(rules)

        def one(text: bytes, words: list[bytes]) -> tuple:
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            n = len(words)
            chars = len(text.translate(None, _NOT_CHARS))
            again = repeated_words(known.hash[at], rules.repeat_window)
            lens = known.tokens_of[at]
            total = int(lens.sum())
            tokens = known.tokens[np.repeat(known.first[at] - (np.cumsum(lens) - lens), lens) + np.arange(total)]
            pieces = int(known.pieces_of[at].sum())
            return (n, chars, len(text) - len(text.translate(None, _SYMBOLS)), repeated_lines(text), again,
                    n < rules.min_words or 100 * again > rules.max_repeat_percent * n,
                    total, chars / total if total else 0.0, int(known.fallback_of[at].sum()) / pieces if pieces else 0.0,
                    token_entropy(tokens, rules.entropy_window))

        def step(batch):
            texts = batch.column("_bytes").to_pylist()
            rows = []
            for a, b in runs_of_bytes(texts, 1 << 20):
                split = [t.split() for t in texts[a:b]]
                every = set().union(*split)
                new = [w for w in every if w not in known]
                if new and known.full(len(new)):                        # emptied before a run, never within: a run of very many words may pass the bounds
                    known.reset()
                    new = list(every)
                if new:
                    known.learn(new)
                rows += map(one, texts[a:b], split)
            return dict(zip(NAMES, zip(*rows))) if rows else {c: [] for c in NAMES}
        return step
    return make


def measure(docs: DataFrame, rules: FertilityRules = FertilityRules(), text: str = "text", with_columns: list[str] | None = None) -> DataFrame:
    """One row per row: ``with_columns`` (all by default) and the measures, named as in MEASURES.

    A null text counts as empty: no words, so ``base_failed``.
    """
    wanted = docs.columns if with_columns is None else with_columns
    source = docs.select(*wanted, as_bytes(docs, text).alias("_bytes"))
    return map_columns(source, MEASURES, _measurer(rules), wanted)


def with_verdict(measured: DataFrame, rules: FertilityRules = FertilityRules(), lang: str = "lang") -> DataFrame:
    """Adds ``kept``; ``measured`` must be a stored table, because it is read twice.

    Bands are kept for every two-letter language code and one for all others, 677 rows at most,
    so they may be broadcast.  A text far off its language's medians on any measure is rejected:
    characters per token on either side, fallback share above, entropy below.
    """
    code = F.when(F.lower(lang).rlike("^[a-z]{2}$"), F.lower(lang)).otherwise("other")
    usable = measured.where(~F.col("base_failed")).withColumn("_code", code)
    x = ["chars_per_token", "fallback_share", "entropy"]
    mid = usable.groupBy("_code").agg(*[F.percentile_approx(c, 0.5).alias(f"_mid_{c}") for c in x], F.percentile_approx("n_tokens", 0.5).alias("_mid_n"))
    wide = (usable.join(F.broadcast(mid), "_code").groupBy("_code")
            .agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"_mid_{c}")), 0.5).alias(f"_dev_{c}") for c in x]))
    bands = mid.join(wide, "_code")
    least = [rules.floors[0] * F.col("_mid_chars_per_token"), F.lit(rules.floors[1]), F.lit(rules.floors[2])]
    # evaluated for texts without tokens too, in spite of the ``base_failed`` before it
    short = F.greatest(F.lit(1.0), F.sqrt(F.col("_mid_n") / F.greatest(F.col("n_tokens"), F.lit(1))))
    reach = [rules.width * 1.4826 * F.greatest(F.col(f"_dev_{c}"), low) * short for c, low in zip(x, least)]
    off = [F.col(c) - F.col(f"_mid_{c}") for c in x]
    inside = (F.abs(off[0]) <= reach[0]) & (off[1] <= reach[1]) & (-off[2] <= reach[2])
    return (measured.withColumn("_code", code).join(F.broadcast(bands), "_code", "left")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("_code", *[c for c in bands.columns if c != "_code"]))


def judge(docs: DataFrame, rules: FertilityRules = FertilityRules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Measures and verdict of every document, without the texts.

    Null, empty and short texts fail the base rules.  Repeated rows are judged each.  An empty
    table gives an empty one.  Columns other than the three named are ignored.
    """
    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return with_verdict(keep(measure(table, rules, with_columns=["doc_id", "lang"])), rules)


def accepted(docs: DataFrame, rules: FertilityRules = FertilityRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    named = {c: free_name(docs, f"_doc_{c}") for c in docs.columns}         # the measures' names may be taken
    own = docs.select(*[F.col(c).alias(n) for c, n in named.items()])
    judged = with_verdict(keep(measure(own, rules, text=named[text])), rules, named[lang])
    return judged.where("kept").select(*[F.col(n).alias(c) for c, n in named.items()])
