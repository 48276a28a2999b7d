"""Byte-level BPE encoding and decoding.

Each task splits its documents by the pattern, run by run, and lists a run's distinct words with
one character for each byte token, and with the ranks of the merges that could fire in it.  Spark's
higher-order functions fold those merges over the word in order of rank, looking each up in a
literal rank map; the words' tokens are then laid out per document in the same task, so nothing is
shuffled.  Decoding joins the tokens' bytes, again as an expression.

A vocabulary must come from BPE training.  Then a merge never brings forth a pair of lower rank,
so one pass over the merges in order of rank is the whole encoding, and ``replace`` (all
occurrences from the left) is one merge.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from loomfold.llm.common import free_name, runs_of_bytes

#: A token's character is this plus its id: above the surrogates, so any id below a million has one.
FIRST = 0x10000
#: The pattern's white space: the property itself, since libraries differ on what their short form holds.
SPLIT = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


def _class_of(kind: str) -> str:
    """The characters of a property below U+10000, as ranges for a set of the standard library's patterns."""
    import regex
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    return "".join(re.escape(m[0]) + (f"-{re.escape(m[-1])}" if len(m) > 1 else "") for m in regex.findall(kind + "+", every))


@lru_cache(maxsize=1)
def splitter():
    """A function from a text to its pieces.

    Texts without characters beyond U+FFFF take the standard library's faster patterns, with the
    properties written out; both give the same pieces.
    """
    import regex
    letters, digits, spaces = map(_class_of, (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    near = (SPLIT.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]").replace(r"\P{White_Space}", f"[^{spaces}]")
            .replace(r"\p{White_Space}", f"[{spaces}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]"))
    fast, far, every = re.compile(near), re.compile("[\U00010000-\U0010ffff]"), regex.compile(SPLIT)
    return lambda text: (every if far.search(text) else fast).findall(text)


class _Numbers(dict):
    """Numbers what it is asked for, in order."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


@dataclass(frozen=True)
class Ranks:
    """A vocabulary: bytes by id, the ids of the 256 bytes, and the two tokens that each merge joins (none: empty)."""
    tokens: list[bytes]
    byte_ids: np.ndarray
    merges: list[str]


def _parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The last merge that makes ``token``."""
    parts, own = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], own), i))
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    merges = [""] * len(tokens)
    for token, rank in ranks.items():
        tokens[rank] = token
        if len(token) > 1:
            a, b = _parts(token, ranks)
            merges[rank] = chr(FIRST + ranks[a]) + chr(FIRST + ranks[b])
    return Ranks(tokens, np.array([ranks[bytes([i])] for i in range(256)], np.int32), merges)


@lru_cache(maxsize=4)
def _finder(path: str) -> ahocorasick.Automaton:
    """Finds every token of two bytes or more; a byte is a character of the same number."""
    found = ahocorasick.Automaton()
    for rank, token in enumerate(load_ranks(path).tokens):
        if len(token) > 1:
            found.add_word(token.decode("latin-1"), rank)
    found.make_automaton()
    return found


def _literal(values: list[str]) -> Column:
    """A literal array; Spark folds the split once, in the optimiser."""
    return F.split(F.lit(",".join(values)), ",")


def fold_merges(word: Column, merges: Column, ranks: Ranks) -> Column:
    """The word's token characters after its merges (ranks in rising order)."""
    pair, joined = _literal(ranks.merges), _literal([chr(FIRST + i) for i in range(len(ranks.merges))])
    return F.aggregate(merges, word, lambda state, rank: F.replace(state, F.get(pair, rank), F.get(joined, rank)))


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids, joined."""
    pieces = _literal([t.hex() for t in load_ranks(path).tokens])
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def _distinct_words(raw: list[bytes], ranks: Ranks, finder: ahocorasick.Automaton) -> pa.Array:
    """Structs of a word's byte-token characters and the merges that could fire in it, by rank."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ids = ranks.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    chars = (ids + FIRST).astype("<u4").tobytes().decode("utf-32-le")
    ends = np.cumsum(sizes)
    cut = np.concatenate([[0], ends]).tolist()
    words = pa.array([chars[a:b] for a, b in zip(cut, cut[1:])], pa.string())
    hits = np.fromiter((x for hit in finder.iter(b"".join(raw).decode("latin-1")) for x in hit), np.int64)
    where, found = hits[0::2], hits[1::2]
    lens = np.fromiter(map(len, ranks.tokens), np.int64, len(ranks.tokens))[found]
    word = np.searchsorted(ends, where, side="right")
    inside = where - lens + 1 >= (ends - sizes)[word]                         # not across two words
    key = np.sort(word[inside] << 24 | found[inside])
    key = key[np.diff(key, prepend=-1) > 0]
    offsets = np.searchsorted(key, np.arange(len(raw) + 1) << 24).astype(np.int32)
    merges = pa.ListArray.from_arrays(pa.array(offsets), pa.array((key & 0xFFFFFF).astype(np.int32)))
    return pa.StructArray.from_arrays([words, merges], names=["word", "merges"])


def _split_runs(path: str, kept: list[str], budget: int, schema: StructType):
    """A row for each run of documents: their kept columns, how many pieces each has, the pieces' numbers, and the distinct pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, arrow, ranks, finder = splitter(), to_arrow_schema(schema), load_ranks(path), _finder(path)
        for batch in batches:
            texts = batch.column("_bytes").to_pylist()
            for a, b in runs_of_bytes(texts, budget):
                number, parts = _Numbers(), []
                for text in texts[a:b]:
                    found = split(text.decode("utf-8", "replace"))
                    parts.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                at, counts = np.concatenate(parts), list(map(len, parts))
                raw = [p.encode("utf-8") for p in number]
                words = _distinct_words(raw, ranks, finder)
                columns = [_one(batch.column(c).slice(a, b - a), arrow.field(c).type) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, _one(pa.array(counts, pa.int32()), arrow.field("_counts").type), pa.array([at.tobytes()], pa.binary()),
                                                  _one(words, arrow.field("_words").type)], schema=arrow)
    return run


def _one(values: pa.Array, kind: pa.DataType) -> pa.Array:
    """A list array that holds ``values`` as its only row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind)


def _lay_out(kept: list[str], schema: StructType):
    """Back to a row for each document, with its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.asarray(batch.column("_counts")[i].values.to_numpy(zero_copy_only=False), np.int64)
                at = np.frombuffer(batch.column("_at")[i].as_buffer(), np.int32)
                words = batch.column("_tokens")[i].values.to_pylist()
                size = np.fromiter(map(len, words), np.int64, len(words))
                lens, starts = size[at], (np.cumsum(size) - size)[at]
                flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int32) - FIRST
                flat = flat[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]
                of_piece = np.concatenate([[0], np.cumsum(lens)])
                ends = of_piece[np.concatenate([[0], np.cumsum(counts)])]
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                columns = [batch.column(c)[i].values for c in kept]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*columns, ids], arrow)], schema=arrow)
    return run


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, run_bytes: int = 6 << 20, ids: str = "ids") -> DataFrame:
    """The columns in ``keep`` (all by default) and ``ids``, array<int>, for every row.

    ``path``: a rank file (base64 and rank a line).  ``run_bytes``: bytes of text whose distinct
    words are listed together; it bounds a task's memory, unless one text is longer.  Null and
    empty texts have no ids.  Repeated rows are encoded each; an empty table gives an empty one;
    other columns pass through whatever their names.
    """
    ranks = load_ranks(path)
    wanted = docs.columns if keep is None else keep
    names = {c: f"_c{i}" for i, c in enumerate(wanted)}                        # inside, no column's name can clash
    source = docs.select(*[docs[c].alias(n) for c, n in names.items()], F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("_bytes"))
    kept = list(names.values())
    packed = StructType([StructField(n, ArrayType(source.schema[n].dataType)) for n in kept]
                        + StructType.fromDDL("_counts array<int>, _at binary, _words array<struct<word: string, merges: array<int>>>").fields)
    runs = source.mapInArrow(_split_runs(path, kept, run_bytes, packed), packed)
    folded = runs.select(*kept, "_counts", "_at", F.transform("_words", lambda w: fold_merges(w["word"], w["merges"], ranks)).alias("_tokens"))
    out = StructType([source.schema[n] for n in kept] + StructType.fromDDL("_ids array<int>").fields)
    laid = folded.mapInArrow(_lay_out(kept, out), out)
    return laid.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("_ids").alias(ids if keep is not None else free_name(docs, ids)))
