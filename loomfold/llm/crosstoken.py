"""Alignment of two tokenizers over the same text.

A text's tokens by either tokenizer end at rising byte offsets; where both end, the text is cut
into groups.  Those common ends come from merging both lists of ends.  The merge is cut along the
merge path: a binary search on each of its diagonals finds how many ends of either list lie before
it, so pieces hold equally many ends whatever the documents' lengths and are merged apart.  What
meets at a border of pieces is stitched afterwards.  How often two ids are linked is counted over
the whole corpus, from the distinct pairs of runs of documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomfold.lineage import keep
from loomfold.llm.common import map_any, map_columns, runs_of_bytes


@dataclass(frozen=True)
class AlignRules:
    """``ranks``/``pieces``: files of the byte-level and of the piece vocabulary.  ``run_bytes``: bytes of text whose links are
    listed together (bounds a task's memory, unless one text is longer).  ``piece_ends``: ends in a piece of a merge."""
    ranks: str = public_tokenizers.path("byte_bpe_50k.json")
    pieces: str = public_tokenizers.path("piece_bpe_32k.model")
    run_bytes: int = 2 << 20
    piece_ends: int = 1 << 16


def _byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Blocks whose letters, digits and spaces no later version of Unicode has changed: over them both libraries split alike.
SETTLED = re.compile("[^\u0000-\u024F\u0391-\u03CE\u0410-\u044F\u2010-\u2027\u2030-\u205E\u20AC\u2190-\u21FF\u3000-\u3003\u3041-\u3096\u4E00-\u9FA5\uAC00-\uD7A3\U0001F300-\U0001F5FF]")


@lru_cache(maxsize=4)
def _own_library(ranks: str):
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"                            # a task has one core
    a = Tokenizer.from_file(ranks)
    a.encode_special_tokens = True
    return a


@lru_cache(maxsize=4)
def _tokenizers(ranks: str, pieces: str):
    """An encoder of the byte-level vocabulary, the piece tokenizer, and the bytes of each of their tokens by id."""
    import sentencepiece
    import tiktoken
    with open(ranks, encoding="utf-8") as file:
        model = json.load(file)
    of, special = _byte_of(), {t["content"] for t in model["added_tokens"]}
    vocab = model["model"]["vocab"]
    a_bytes = [b""] * (1 + max(vocab.values()))
    for token, i in vocab.items():
        a_bytes[i] = token.encode() if token in special else bytes(map(of.__getitem__, token))
    plain = {a_bytes[i]: i for token, i in vocab.items() if token not in special}
    a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=pieces)
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    return a, b, a_bytes, b_bytes


def encode_both(texts: list[str], rules: AlignRules) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids by either tokenizer, none for texts that one of them does not give back.

    The same merges run faster in another library than in the vocabulary's own; texts of
    characters that one of them might sort otherwise go through its own.
    """
    a, b, a_bytes, b_bytes = _tokenizers(rules.ranks, rules.pieces)
    some = [t for t in texts if t]
    right = iter(b.encode(some, num_threads=1))
    for text in texts:
        if not text:
            yield np.empty(0, np.int32), np.empty(0, np.int32)
            continue
        spaced, others = " " + text, next(right)
        ids = a.encode_ordinary(spaced) if not SETTLED.search(text) else _own_library(rules.ranks).encode(spaced, add_special_tokens=False).ids
        raw = spaced.encode("utf-8")
        same = b"".join(map(a_bytes.__getitem__, ids)) == raw and b"".join(map(b_bytes.__getitem__, others)) == raw
        yield np.array(ids if same else [], np.int32), np.array(others if same else [], np.int32)


def diagonal_cuts(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` lie before every ``size``-th end of their merge (equal ends: ``a`` first), borders included."""
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, size), total)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        ahead = open_.copy()
        k = np.flatnonzero(open_)
        ahead[k] = a[mid[k]] <= b[diagonal[k] - mid[k] - 1]                   # this end of a comes before: more of a
        low, high = np.where(ahead, mid + 1, low), np.where(open_ & ~ahead, mid, high)
    return low, diagonal - low


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in ``a`` and ``b`` of the ends that both hold."""
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(at < len(b))
    hit = hit[b[at[hit]] == a[hit]]
    return hit, at[hit]


def common_ends(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in ``a`` and ``b`` (strictly rising) of all ends that both hold, piece by piece."""
    x, y = diagonal_cuts(a, b, size)
    found = []
    for i in range(len(x) - 1):
        if 0 < x[i] and y[i] < len(b) and a[x[i] - 1] == b[y[i]]:              # the border parts an end of a from its equal
            found.append((np.array([x[i] - 1]), np.array([y[i]])))
        one, other = merge_piece(a[x[i]:x[i + 1]], b[y[i]:y[i + 1]])
        found.append((one + x[i], other + y[i]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


@dataclass
class Aligned:
    """A run of documents: ids of both sides, where documents start, and the last token of each group."""
    a: np.ndarray
    b: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray


def align_run(texts: list[str], rules: AlignRules) -> Aligned:
    _, _, a_bytes, b_bytes = _tokenizers(rules.ranks, rules.pieces)
    texts, left, right = [t or "" for t in texts], [], []
    for start, end in runs_of_bytes(texts, 1 << 18):                          # lists of ids are large: a few texts at once
        for ids, others in encode_both(texts[start:end], rules):
            left.append(ids)
            right.append(others)
    made = []
    for ids, table in ((left, a_bytes), (right, b_bytes)):
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        made.append((flat, starts, np.cumsum(_sizes(table)[flat])))
    (a, a_starts, a_ends), (b, b_starts, b_ends) = made
    return Aligned(a, b, a_starts, b_starts, *common_ends(a_ends, b_ends, rules.piece_ends))


_SIZES: dict[int, np.ndarray] = {}


def _sizes(table: list[bytes]) -> np.ndarray:
    if id(table) not in _SIZES:
        _SIZES[id(table)] = np.fromiter(map(len, table), np.int64, len(table))
    return _SIZES[id(table)]


def _written(run: Aligned, table: list[str]) -> Iterator[str]:
    """For every document its groups: ids of the first side, a bar, ids of the second, groups parted by semicolons."""
    m, n = len(run.a), len(run.b)
    a_group, b_group = np.zeros(m, np.int64), np.zeros(n, np.int64)
    a_group[run.a_last[:-1] + 1] = 1
    b_group[run.b_last[:-1] + 1] = 1
    a_group, b_group = np.cumsum(a_group), np.cumsum(b_group)
    a_end, b_end = np.zeros(m, bool), np.zeros(n, bool)
    a_end[run.a_last] = b_end[run.b_last] = True
    codes = np.empty(m + n, np.int32)
    width = len(table) // 4
    before_b = np.concatenate([[0], run.b_last + 1])                           # tokens of b in earlier groups
    codes[np.arange(m) + before_b[a_group]] = run.a + np.where(a_end, width, 0)
    codes[np.arange(n) + (run.a_last + 1)[b_group]] = run.b + np.where(b_end, 3 * width, 2 * width)
    cuts = (run.a_starts + run.b_starts).tolist()
    for p, q in zip(cuts, cuts[1:]):
        yield "".join(map(table.__getitem__, codes[p:q].tolist()))[:-1]


@lru_cache(maxsize=2)
def _marks(width: int) -> list[str]:
    return [f"{i}{mark}" for mark in ",|,;" for i in range(width)]


RUNS = ("run string, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, "
        "sizes array<int>, links binary, times binary, pairs array<long>, counts array<long>")


def _list_runs(rules: AlignRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for start, end in runs_of_bytes([t or "" for t in texts], rules.run_bytes):
                yield _one_run(texts[start:end], ids[start:end], rules)
    return run


def _one_run(texts: list[str], ids: list[int], rules: AlignRules) -> dict:
    aligned = align_run(texts, rules)
    _, _, a_bytes, b_bytes = _tokenizers(rules.ranks, rules.pieces)
    written = _written(aligned, _marks(max(len(a_bytes), len(b_bytes)))) if len(aligned.a) else [""] * len(texts)
    keys = aligned.b[aligned.b_last].astype(np.int64) << 32 | aligned.a[aligned.a_last].astype(np.int64)
    pairs, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
    # a document's distinct pairs, and how often it has each
    document = np.searchsorted(aligned.a_starts, aligned.a_last, side="right") - 1
    own, times = np.unique(document << 32 | number.astype(np.int64), return_counts=True)
    sizes = np.bincount(own >> 32, minlength=len(texts)) if len(own) else np.zeros(len(texts), np.int64)
    groups = np.bincount(document, minlength=len(texts)) if len(own) else sizes
    digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
    row = {"run": os.urandom(16).hex(), "doc_ids": ids, "n_a": np.diff(aligned.a_starts), "n_b": np.diff(aligned.b_starts), "n_groups": groups, "digests": digests, "sizes": sizes.astype(np.int32),
           "links": (own & 0xFFFFFFFF).astype(np.int32).tobytes(), "times": times.astype(np.int32).tobytes(), "pairs": pairs, "counts": counts}
    return {c: [v] for c, v in row.items()}


def pair_counts(runs: DataFrame) -> DataFrame:
    """``pair, total, best``: links of each pair of ids in the corpus, and whether no other first id has more with the same second."""
    listed = runs.select(F.inline(F.arrays_zip("pairs", "counts"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total"))
    second = F.shiftright("pair", 32)
    totals = keep(listed.withColumn("_b", second))
    most = totals.groupBy("_b").agg(F.max("total").alias("_most"))
    return totals.join(most, "_b").select("pair", "total", (F.col("total") == F.col("_most")).alias("best"))


def _told(rules: AlignRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                pick = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023,E731
                k, total, best = pick("_k"), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(k):
                    total, best = np.zeros(k.max() + 1, np.int64), np.zeros(k.max() + 1, np.int64)
                    total[k], best[k] = pick("_total"), pick("_best").astype(np.int64)
                links, times = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in ("links", "times"))
                ends = np.concatenate([[0], np.cumsum(pick("sizes"), dtype=np.int64)])
                at = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])  # noqa: B023,E731
                groups = pick("n_groups")
                yield {"doc_id": batch.column("doc_ids")[i].values, "n_a": pick("n_a"), "n_b": pick("n_b"), "n_groups": groups, "n_links": groups,
                       "n_best": at(times * best[links]), "count_sum": at(times * total[links]), "groups_sha256": batch.column("digests")[i].values}
    return run


def align(docs: DataFrame, rules: AlignRules = AlignRules()) -> DataFrame:
    """One row for every row of ``doc_id, text``: sizes, links and digest of its alignment.

    A token has a byte at least, so ends rise strictly and a common end links two tokens: there
    are as many links as groups.  Null and empty texts, and texts that a tokenizer does not give
    back, have no tokens: zeros and an empty digest.  Repeated rows count each.  An empty table
    gives an empty one; other columns are left out.
    """
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    runs = keep(map_any(source, RUNS, _list_runs(rules)))
    held = runs.select("run", F.posexplode("pairs").alias("_k", "pair")).join(pair_counts(runs), "pair")
    held = held.groupBy("run").agg(F.collect_list(F.struct("_k", "total", "best")).alias("_held"))          # a run's own pairs: bounded by its bytes
    rows = runs.drop("pairs", "counts").join(held, "run", "left")
    of = lambda field, kind: F.coalesce(F.transform("_held", lambda h: h[field]), F.array().cast(f"array<{kind}>"))
    rows = rows.select("doc_ids", "n_a", "n_b", "n_groups", "digests", "sizes", "links", "times", of("_k", "int").alias("_k"), of("total", "bigint").alias("_total"), of("best", "boolean").alias("_best"))
    return map_any(rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string", _told(rules))


def groups(docs: DataFrame, rules: AlignRules = AlignRules(), text: str = "text", keep_columns: list[str] = ()) -> DataFrame:
    """The kept columns and ``a_ids``, ``b_ids`` and ``groups``: for each group the numbers of its last tokens (from 0)."""
    source = docs.select(*keep_columns, docs[text].cast("string").alias("_text"))

    def make():
        def step(batch):
            run = align_run(batch.column("_text").to_pylist(), rules)
            cut = lambda x, starts: [x[p:q].tolist() for p, q in zip(starts, starts[1:])]
            of = np.searchsorted(run.a_last, run.a_starts)
            ends = [[{"a": i - s, "b": j - t} for i, j in zip(run.a_last[p:q].tolist(), run.b_last[p:q].tolist())] for p, q, s, t in
                    zip(of, of[1:], run.a_starts.tolist(), run.b_starts.tolist())]
            return {"a_ids": cut(run.a, run.a_starts), "b_ids": cut(run.b, run.b_starts), "groups": ends}
        return step

    return map_columns(source, "a_ids array<int>, b_ids array<int>, groups array<struct<a: long, b: long>>", make, list(keep_columns), rows=256)
