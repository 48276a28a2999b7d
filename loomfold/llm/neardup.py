"""Near-duplicate groups by an LSH forest.

A text's set of word shingles gets one min-hash label per tree.  Sorting a tree by its labels puts
sets with long common prefixes side by side; a region is a prefix of the least depth, or a deeper
one where a region would hold too many.  Neighbours within a region whose sketches agree enough
are candidates; every candidate link is confirmed on the full sets.

Sets that are equal are one node, so exact copies cost nothing.  A region first offers a spanning
forest of its candidates, by falling agreement, which settles families of near copies without
listing their pairs.  Only regions where one of those links fails offer all candidates between
different groups in a second round.

Cuts below the least depth are a quick way to groups, not the last word: sets of regions that were
cut are afterwards compared exactly, in tiles of bounded size, wherever they still lie in
different groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomfold.lineage import broadcast_if_small, keep, salted_lookup
from loomfold.llm.common import as_bytes, free_name, map_any, map_columns
from loomfold.operators.components import connected_components


@dataclass(frozen=True)
class NearRules:
    """``words`` a shingle; linked from ``percent`` of common shingles on.

    ``trees`` orders, cut at one of three ``depths`` so that a region holds at most ``region``
    sets.  ``sketch`` more min-hashes, a byte each, estimate the similarity; a pair is a candidate
    from ``agree`` of them on (four deviations below the threshold).
    """
    words: int = 5
    percent: int = 80
    trees: int = 20
    depths: tuple[int, int, int] = (4, 6, 8)
    region: int = 64
    sketch: int = 64
    agree: float = 0.6
    seed: int = 7


#: Keys are told apart by so many slots; a bit each tells which regions are cut (256 KB).  A region that shares a slot with a full one is cut too.
SLOTS = 1 << 21
#: Slots for the number of parts of regions too full at the last depth.
PARTS = 1 << 16
#: Tables of regions and groups up to this number of rows (some tens of bytes each) are broadcast, their number checked.
FEW = 400_000
#: Sets in a block; a tile of two blocks is compared in one piece.
BLOCK = 128

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


class _Hashes(dict):
    """Hashes of words met, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, words: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than a shingle count as one, no word as none."""
    found = text.lower().split()
    n = min(words, len(found))
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out ^ h[i:len(h) - n + 1 + i])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _signer(rules: NearRules):
    deep = rules.depths[-1]
    k = rules.trees * deep + rules.sketch

    def make():
        rng, known = np.random.default_rng(rules.seed), _Hashes()
        flip, turn = rng.integers(0, 1 << 32, k, dtype=np.uint32), rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

        def least(hashes: np.ndarray) -> np.ndarray:
            x = (hashes >> np.uint64(32)).astype(np.uint32)
            best = np.full(k, 0xFFFFFFFF, np.uint32)
            for at in range(0, len(x), 512):
                np.minimum(best, ((x[at:at + 512, None] ^ flip) * turn).min(0), out=best)
            return best

        def step(batch):
            sizes, digests, minima = [], [], []
            for text in batch.column("_bytes").to_pylist():
                hashes = shingle_set(text, rules.words, known)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                minima.append(least(hashes))
            m = np.stack(minima) if minima else np.empty((0, k), np.uint32)
            labels = m[:, :rules.trees * deep].reshape(len(m), rules.trees, deep).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, rules.trees + 1, dtype=np.uint64), labels.shape[:2])
            keys = []
            for i in range(deep):
                key = _mixed(key ^ labels[:, :, i])
                if i + 1 in rules.depths:
                    keys.append(key)
            shallow = keys[0].tobytes()
            more = [x.astype(np.uint32).tobytes() for x in keys[1:]]
            low = m[:, rules.trees * deep:].astype(np.uint8).tobytes()
            a, b, c = 8 * rules.trees, 4 * rules.trees, rules.sketch
            sigs = [shallow[i * a:(i + 1) * a] + more[0][i * b:(i + 1) * b] + more[1][i * b:(i + 1) * b] + low[i * c:(i + 1) * c] for i in range(len(m))]
            return {"_n": sizes, "_set": digests, "_sig": [s if d else None for s, d in zip(sigs, digests)]}
        return step
    return make


@dataclass(frozen=True)
class _Cuts:
    """Slots of the keys that are cut at the least and the middle depth, and numbers of parts at the last."""
    first: bytes = b""
    second: bytes = b""
    parts: bytes = b""


def _marked(bits: bytes):
    """Whether keys fall in a slot of ``bits``."""
    if not any(bits):
        return lambda keys: np.zeros(keys.shape, bool)
    table = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
    return lambda keys: table[(keys & np.uint64(SLOTS - 1)).astype(np.int64)]


def _slots_of(rows: DataFrame, key: str) -> bytes:
    """A bit for each slot that one of the keys falls in."""
    slot = F.col(key).bitwiseAND(F.lit(SLOTS - 1))
    table = bytearray(SLOTS // 8)
    for at, bits in rows.groupBy((slot / 32768).cast("int").alias("_at")).agg(F.bitmap_construct_agg(slot % 32768).alias("_bits")).collect():
        table[4096 * at:4096 * (at + 1)] = bits
    return bytes(table)


def _keys(batch: pa.RecordBatch, rules: NearRules):
    """Keys of each set in each tree at the three depths, and the sketches."""
    t, n = rules.trees, batch.num_rows
    sig = np.frombuffer(b"".join(batch.column("_sig").to_pylist()), np.uint8).reshape(n, 16 * t + rules.sketch)
    k0 = np.ascontiguousarray(sig[:, :8 * t]).view(np.uint64)
    k1 = _mixed(k0 ^ np.ascontiguousarray(sig[:, 8 * t:12 * t]).view(np.uint32))
    k2 = _mixed(k1 ^ np.ascontiguousarray(sig[:, 12 * t:16 * t]).view(np.uint32))
    return k0, k1, k2, [x.tobytes() for x in np.ascontiguousarray(sig[:, 16 * t:])]


def _keys_at(depth: int, rules: NearRules, within: bytes = b""):
    """Rows of one column, k: every set's keys at one depth, if ``within`` is given those of regions cut a depth before."""
    def run(batches):
        marked = _marked(within)
        for batch in batches:
            k = _keys(batch, rules)
            yield {"k": (k[depth][marked(k[depth - 1])] if depth else k[0].ravel()).view(np.int64)}
    return run


def _planted(rules: NearRules, cuts: _Cuts, only: bytes | None = None):
    """A row for each tree of each set: its region and its sketch.

    A region too full at one depth is cut at the next, one too full at the last is dealt into parts.
    With ``only``, rows of uncut regions in those slots.
    """
    def run(batches):
        first, second, t = _marked(cuts.first), _marked(cuts.second), rules.trees
        parts = np.frombuffer(cuts.parts, np.uint32).astype(np.uint64)
        wanted = None if only is None else _marked(only)
        for batch in batches:
            k0, k1, k2, sketch = _keys(batch, rules)
            cut = first(k0)
            if wanted:
                chosen, region = ~cut & wanted(k0), k0
            else:
                head = np.frombuffer(b"".join(x[:8] for x in batch.column("set").to_pylist()), np.uint64)[:, None]
                many = parts[(k2 & np.uint64(PARTS - 1)).astype(np.int64)] if len(parts) else np.zeros(k2.shape, np.uint64)
                dealt = np.where(many > 1, _mixed(k2 ^ (_mixed(head ^ k2) % np.maximum(many, np.uint64(1)) + np.uint64(1))), k2)
                chosen, region = np.ones(k0.shape, bool), np.where(cut, np.where(second(k1), dealt, k1), k0)
            each = pa.array(np.broadcast_to(np.arange(batch.num_rows)[:, None], (batch.num_rows, t))[chosen])
            yield {"region": region[chosen].view(np.int64), "set": batch.column("set").take(each), "n": batch.column("n").take(each), "sketch": pa.array(sketch, pa.binary()).take(each)}
    return run


def _joined_in_task(rules: NearRules, cuts: _Cuts):
    """Edges (a, b) between sets and the cut regions of the least depth that they lie in: a spanning forest of those a task has read."""
    def run(batches):
        first, root = _marked(cuts.first), {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x
        for batch in batches:
            k0, sets = _keys(batch, rules)[0], batch.column("set").to_pylist()
            for i, j in zip(*np.nonzero(first(k0))):
                x, y = find(sets[i]), find(k0[i, j].tobytes())
                if x != y:
                    root[y] = x
        nodes = list(root)
        for at in range(0, len(nodes), 1 << 14):
            some = nodes[at:at + (1 << 14)]
            yield {"a": some, "b": [find(x) for x in some]}
    return run


_FOREST = "region long, set binary, n long, sketch binary"


def _cuts(nodes: DataFrame, rules: NearRules) -> _Cuts:
    """Where the forest is cut.  Keys are counted by shuffles; the driver gets a bit or a number for each slot."""
    def full(depth: int, within: bytes = b"") -> DataFrame:
        keys = map_any(nodes.select("_sig"), "k long", _keys_at(depth, rules, within))
        return keys.groupBy("k").count().where(F.col("count") > rules.region)

    first = _slots_of(full(0), "k")
    if not any(first):
        return _Cuts()
    second = _slots_of(full(1, first), "k")
    if not any(second):
        return _Cuts(first)
    parts = np.zeros(PARTS, np.uint32)
    for at, n in full(2, second).groupBy(F.col("k").bitwiseAND(F.lit(PARTS - 1))).agg(F.max(F.ceil(F.col("count") / rules.region))).collect():
        parts[at] = n
    return _Cuts(first, second, parts.tobytes())


def _neighbours(rules: NearRules, spanning: bool):
    """Candidate links of each region; rows come sorted by region.

    With ``spanning`` a forest of them, by falling agreement; else all between different groups.
    """
    names = ["region", "set", "n", "sketch"] + ([] if spanning else ["group"])

    def links(rows: dict):
        region, n = rows["region"], rows["n"]
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(n), rules.sketch)
        left, right, score = [], [], []
        for off in range(1, len(n)):
            same = region[off:] == region[:-off]
            if not same.any():
                break
            small, large = np.minimum(n[off:], n[:-off]), np.maximum(n[off:], n[:-off])
            i = np.flatnonzero(same & (100 * small >= rules.percent * large))
            if not spanning and len(i):
                i = i[[rows["group"][x] != rows["group"][x + off] for x in i]]
            for at in range(0, len(i), 1 << 16):
                some = i[at:at + (1 << 16)]
                agree = (sketch[some] == sketch[some + off]).mean(1)
                fine = agree >= rules.agree
                left.append(some[fine]), right.append(some[fine] + off), score.append(agree[fine])
        if not left:
            return np.empty(0, int), np.empty(0, int)
        left, right, score = np.concatenate(left), np.concatenate(right), np.concatenate(score)
        if not spanning or not len(left):
            return left, right
        root = list(range(len(n)))

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x
        order, chosen = np.argsort(-score, kind="stable"), []
        for k, i, j in zip(order.tolist(), left[order].tolist(), right[order].tolist()):
            i, j = find(i), find(j)
            if i != j:
                root[i] = j
                chosen.append(k)
        return left[chosen], right[chosen]

    def answer(rows: dict):
        i, j = links(rows)
        s = rows["set"]
        return {"a": [min(s[x], s[y]) for x, y in zip(i, j)], "b": [max(s[x], s[y]) for x, y in zip(i, j)], "region": rows["region"][i]}

    def run(batches):
        held = None
        for batch in batches:
            rows = {c: (batch.column(c).to_numpy(zero_copy_only=False) if c in ("region", "n") else batch.column(c).to_pylist()) for c in names}
            if held:
                rows = {c: np.concatenate([held[c], rows[c]]) if c in ("region", "n") else held[c] + rows[c] for c in names}
            if not len(rows["n"]):
                continue
            cut = int(np.flatnonzero(rows["region"] != rows["region"][-1])[-1] + 1) if (rows["region"] != rows["region"][-1]).any() else 0
            if cut:
                yield answer({c: rows[c][:cut] for c in names})
            held = {c: rows[c][cut:] for c in names}
        if held:
            yield answer(held)
    return run


_LINKS = "a binary, b binary, region long"


def _confirmed(pairs: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """a, b, linked for distinct pairs of sets: both texts meet and are counted in full."""
    def run(batches):
        known, last, mine = _Hashes(), None, None
        for batch in batches:
            a, ok = batch.column("a").to_pylist(), []
            for x, one, two in zip(a, batch.column("_one").to_pylist(), batch.column("_two").to_pylist()):
                if x != last:
                    last, mine = x, shingle_set(one, rules.words, known)
                other = shingle_set(two, rules.words, known)
                both = np.concatenate([mine, other])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= rules.percent * (len(both) - common))
            yield {"a": batch.column("a"), "b": batch.column("b"), "linked": ok}

    met = (pairs.join(texts.select(F.col("set").alias("b"), F.col("_bytes").alias("_two")), "b")
           .join(texts.select(F.col("set").alias("a"), F.col("_bytes").alias("_one")), "a"))
    return map_any(met.select("a", "b", "_one", "_two"), "a binary, b binary, linked boolean", run)


def _texts_of(sets: DataFrame, nodes: DataFrame, signed: DataFrame) -> DataFrame:
    """set, _bytes of the ``sets``."""
    wanted = sets.select("set").distinct().join(nodes.select("set", "_row").hint("merge"), "set")
    return keep(signed.select("_row", "_bytes").join(wanted.hint("merge"), "_row").select("set", "_bytes"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set")))


def _groups(nodes: DataFrame, signed: DataFrame, rules: NearRules) -> DataFrame:
    """Groups (node, component) of sets that confirmed links join; sets without a link are in none."""
    cuts, few = _cuts(nodes, rules), lambda t: broadcast_if_small(t, FEW)
    planted = nodes.select("set", "n", "_sig")
    placed = map_any(planted, _FOREST, _planted(rules, cuts)).repartition("region").sortWithinPartitions("region", "set")
    offered = keep(map_any(placed, _LINKS, _neighbours(rules, True)))
    pairs = offered.select("a", "b").distinct()
    judged = keep(_confirmed(pairs, _texts_of(_ends(pairs), nodes, signed), rules))
    sure = judged.where("linked").select("a", "b")
    failed = judged.where(~F.col("linked")).select("a", "b")
    open_ = keep(offered.join(few(failed), ["a", "b"]).select("region").distinct())
    groups = keep(connected_components(sure))
    again = (map_any(planted, _FOREST, _planted(rules, cuts, _slots_of(open_, "region"))).join(few(open_), "region", "left_semi").join(few(groups.withColumnRenamed("node", "set")), "set", "left")
             .withColumn("group", F.coalesce("component", "set")).select("region", "set", "n", "sketch", "group"))
    more = map_any(again.repartition("region").sortWithinPartitions("region", "set"), _LINKS, _neighbours(rules, False)).select("a", "b").distinct()
    more = keep(more.join(judged, ["a", "b"], "left_anti"))
    late = keep(_confirmed(more, _texts_of(_ends(more), nodes, signed), rules))
    groups = _merged(groups, late.where("linked").select("a", "b"))
    if any(cuts.first):
        dense = keep(connected_components(map_any(planted.select("set", "_sig"), "a binary, b binary", _joined_in_task(rules, cuts)))
                     .where(F.length("node") == 16).withColumnsRenamed({"node": "set", "component": "cluster"}))
        groups = _merged(groups, _between(dense, groups, nodes, signed, rules))
    return groups


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (node, component) with more ``links`` (a, b): the groups that they join become one; only those are worked on."""
    links = keep(links)
    if links.isEmpty():
        return groups
    ends = keep(_ends(links).distinct().join(groups.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set")))
    at = lambda end, name: ends.select(F.col("set").alias(end), F.col("component").alias(name))
    joined = broadcast_if_small(keep(connected_components(links.join(at("a", "x"), "a").join(at("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))), FEW)
    # ends that were in no group yet come in with a row of their own
    every = groups.select("node", "component").unionByName(ends.select(F.col("set").alias("node"), "component")).distinct()
    return keep(every.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_now")), "component", "left").select("node", F.coalesce("_now", "component").alias("component")))


def _between(dense: DataFrame, groups: DataFrame, nodes: DataFrame, signed: DataFrame, rules: NearRules) -> DataFrame:
    """Links (a, b) between different groups of a cluster, exactly: every pair that may be similar by size meets in a tile.

    ``dense``: set, cluster.  Clusters are cut into blocks of about BLOCK sets of like size, and groups
    that are larger into blocks of their own; two blocks of one group do not meet.
    """
    few = lambda t: broadcast_if_small(t, FEW)
    rows = keep(dense.join(groups.withColumnRenamed("node", "set"), "set", "left").withColumn("group", F.coalesce("component", "set")).drop("component")
                .join(nodes.select("set", "n"), "set"))
    mixed = rows.groupBy("cluster").agg((F.min("group") < F.max("group")).alias("_mixed")).where("_mixed").select("cluster")
    large = rows.groupBy("cluster", "group").count().where(F.col("count") > BLOCK).select("cluster", "group", F.col("group").alias("_own"))
    kin = ["cluster", "_lane", "_band"]
    laid = (rows.join(few(mixed), "cluster", "left_semi").join(few(large), ["cluster", "group"], "left")
            .withColumn("_lane", F.coalesce("_own", F.lit(b""))).withColumn("_band", F.floor(F.log("n") / F.log(F.lit(1.12)))))
    deals = laid.groupBy(*kin).agg(F.ceil(F.count("*") / BLOCK).alias("_deals"))
    placed = keep(laid.join(few(deals), kin).select("set", "group", "n", "cluster", F.xxhash64(*kin, F.pmod(F.xxhash64("set"), "_deals")).alias("block")))
    blocks = keep(placed.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("group").alias("one"), F.max("group").alias("two")))
    end = lambda at: blocks.select("cluster", *[F.col(c).alias(f"{c}_{at}") for c in ("block", "lo", "hi", "one", "two")])
    meet = ((F.col("block_a") <= F.col("block_b")) & (100 * F.col("hi_a") >= rules.percent * F.col("lo_b")) & (100 * F.col("hi_b") >= rules.percent * F.col("lo_a"))
            & (F.least("one_a", "one_b") < F.greatest("two_a", "two_b")))
    tiles = end("a").join(end("b"), "cluster").where(meet).select(F.xxhash64("block_a", "block_b").alias("tile"), F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    dealt = keep(placed.select("set", "group", "block").join(few(tiles), "block").select("tile", "set", "group"))
    met = dealt.join(_texts_of(dealt, nodes, signed), "set").repartition("tile").sortWithinPartitions("tile", "set")
    return keep(map_any(met.select("tile", "set", "group", "_bytes"), "a binary, b binary", _compared(rules)))


def common_counts(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, exactly, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1                                                          # others are in one set alone
    column = np.cumsum(shared) - 1
    on = shared[place]
    owner, column = owner[on], column[place[on]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, n = np.zeros((len(sets), len(sets)), np.int64), int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(width, n))
    for at in range(0, n, width):
        i, j = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[i:j], column[i:j] - at] = 1
        total += (x @ x.T).astype(np.int64)
    return total


def _compared(rules: NearRules):
    """Links that join different groups in each tile, a spanning forest of them; rows come sorted by tile."""
    def answer(known: _Hashes, sets: list[bytes], groups: list[bytes], texts: list[bytes]) -> dict:
        hashes = [shingle_set(x, rules.words, known) for x in texts]
        n, common = np.array([len(x) for x in hashes]), common_counts(hashes)
        linked = np.triu(100 * common >= rules.percent * (n[:, None] + n - common), 1)
        root, left, right = {g: g for g in groups}, [], []

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(linked))):
            x, y = find(groups[i]), find(groups[j])
            if x != y:
                root[x] = y
                left.append(sets[i]), right.append(sets[j])
        return {"a": left, "b": right}

    def run(batches):
        known, tile, held = _Hashes(), None, ([], [], [])
        for batch in batches:
            for at, *row in zip(*[batch.column(c).to_pylist() for c in ("tile", "set", "group", "_bytes")]):
                if at != tile and held[0]:
                    yield answer(known, *held)
                    held = ([], [], [])
                tile = at
                for x, value in zip(held, row):
                    x.append(value)
        if held[0]:
            yield answer(known, *held)
    return run


def grouped(docs: DataFrame, rules: NearRules = NearRules(), doc_id: str = "doc_id", text: str = "text", columns: list[str] = ()) -> DataFrame:
    """A row for every row: doc_id, n_shingles, component_id, first (one row of each group) and ``columns`` as _c0, _c1, ...

    ``component_id`` is the least id of the group.  A null text or one without words has an empty
    set, is linked with nothing and stays.  Repeated rows form a group; rows with a null id take
    part, and come last when a group's first row is chosen.  An empty table gives an empty one.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], as_bytes(docs, text).alias("_bytes"))
    own = ["doc_id", *[f"_c{i}" for i in range(len(columns))]]
    signed = map_columns(source, "_n long, _set binary, _sig binary", _signer(rules), [*own, "_bytes"])
    signed = keep(signed.withColumn("_row", F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_row")
    least = signed.where(F.col("_set").isNotNull()).groupBy("_set").agg(F.min(place).alias("_least"))
    # one row a set brings its signature: the sets' rows meet by row number, which is never hot
    nodes = keep(signed.where(F.col("_set").isNotNull()).select("_row", "_set", "_n", "_sig")
                 .join(least.select(F.col("_least._row").alias("_row"), F.col("_least.doc_id").alias("_id")).hint("merge"), "_row")
                 .select(F.col("_set").alias("set"), F.col("_n").alias("n"), "_sig", "_row", "_id"))
    groups = _groups(nodes, signed, rules)
    placed = keep(nodes.select("set", "_row", "_id").join(groups.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set")))
    head = placed.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_head"), F.count("*").alias("_c"))
    large = head.where(F.col("_c") * 200 > max(1000, placed.count())).select("component")
    heads = keep(salted_lookup(placed, head, "component", large, "_row").select(F.col("set").alias("_set"), F.col("_head.id").alias("component_id"), F.col("_head.row").alias("_first")))
    rows = signed.select(*own, "_n", "_set", "_row")
    # sets with a 200th of all rows: 200 at most
    hot = rows.where(F.col("_set").isNotNull()).groupBy("_set").agg(F.count("*").alias("_c")).where(F.col("_c") * 200 > max(1000, signed.count())).select("_set")
    met = salted_lookup(rows.where(F.col("_set").isNotNull()), heads, "_set", hot, "_row").select(
        *own, F.col("_n").alias("n_shingles"), "component_id", (F.col("_row") == F.col("_first")).alias("first"))
    lone = rows.where(F.col("_set").isNull()).select(*own, F.col("_n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return met.unionByName(lone)


def deduplicated(docs: DataFrame, rules: NearRules = NearRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each group: the one of least id."""
    found = grouped(docs, rules, doc_id, text, docs.columns)
    return found.where("first").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
