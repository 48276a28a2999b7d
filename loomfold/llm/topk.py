"""Exact top-k search by inner product.

Candidates are put in order of falling length and packed into blocks; queries are packed into
blocks of bounded size.  A block of candidates meets a block of queries only if the product of
their greatest lengths can reach a query's threshold.  Within a meeting, partial sums over the first
axes of an SVD rotation, with the Cauchy-Schwarz bound of the rest, prune pairs; those left get
their exact integer product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomfold.lineage import keep
from loomfold.llm.common import map_any


@dataclass(frozen=True)
class TopkRules:
    """``k`` best per query.  ``scale``: components become floor(scale * x).

    ``query_rows``/``block_rows``: vectors in a block of queries and of candidates.  ``warm_rows``:
    the longest candidates, against which every query finds its first threshold.
    ``steps``: shares of the axes after which pairs are pruned.
    """
    k: int = 5
    scale: int = 256
    query_rows: int = 8192
    block_rows: int = 2048
    warm_rows: int = 2048
    steps: tuple[float, ...] = (0.25, 0.5)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double; null for vectors null, empty or holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Rows of one length as a matrix."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(lists), -1) if len(lists) else np.empty((0, 0), np.int64)


def _by_length(batch: pa.RecordBatch):
    """Parts of a batch with vectors of one dimension."""
    dims = np.asarray(batch.column("dim"))
    for d in sorted(set(dims.tolist())):
        yield d, batch.filter(pa.array(dims == d))


def gram(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Sum of v v' by dimension, over all rows: a task sends its sums row by row, d numbers each."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, part in _by_length(batch):
                m = _matrix(part, "v").astype(np.float64)
                sums[d] = sums.get(d, 0) + m.T @ m
        for d, s in sums.items():
            n = len(s)
            yield {"d": [d] * n * n, "i": np.repeat(np.arange(n, dtype=np.int32), n), "j": np.tile(np.arange(n, dtype=np.int32), n), "x": s.ravel()}

    rows = map_any(vectors.select("dim", "v"), "d int, i int, j int, x double", run).groupBy("d", "i", "j").agg(F.sum("x").alias("x")).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.d, np.zeros((r.d, r.d)))[r.i, r.j] = r.x
    return out


def _rotations(grams: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Axes by falling share of the candidates' squared length (the right singular vectors)."""
    return {d: np.linalg.eigh(g)[1][:, ::-1].copy() for d, g in grams.items()}


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products; by floating point where that is exact."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0 ** 52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


NO_ID = np.iinfo(np.int64).max


def _pack(rows: int, ddl_id: str):
    """Blocks of at most ``rows`` vectors of one dimension, in the order they come."""
    def run(batches):
        for batch in batches:
            for d, part in _by_length(batch):
                for at in range(0, part.num_rows, rows):
                    some = part.slice(at, rows)
                    m = _matrix(some, "v")
                    ids = some.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                    long = np.sqrt((m.astype(np.float64) ** 2).sum(1))
                    yield {"dim": [d], "ids": [ids.tobytes()], "vectors": [m.tobytes()], "longest": [float(long.max())]} | ({ddl_id: [int(np.random.default_rng(ids[:1].view(np.uint64)).integers(1 << 62))]} if ddl_id else {})
    return run


def _thresholds(warm: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Query blocks with each query's k-th best product among the longest candidates (its own row aside)."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q, ids = np.frombuffer(row["vectors"], np.int64).reshape(-1, row["dim"]), np.frombuffer(row["ids"], np.int64)
                least = np.full(len(q), np.iinfo(np.int64).min, np.int64)
                if row["dim"] in warm:
                    wid, w = warm[row["dim"]]
                    s = exact_products(q, w)
                    s[ids[:, None] == wid[None, :]] = np.iinfo(np.int64).min
                    if s.shape[1] >= k:
                        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                need = np.where(length > 0, least / np.maximum(length, 1e-300), np.where(least > 0, np.inf, -np.inf))
                yield {"dim": [row["dim"]], "q_block": [row["q_block"]], "q_ids": [row["ids"]], "q_vectors": [row["vectors"]], "least": [least.tobytes()], "need": [float(need.min())]}
    return run


def _meet(rotations: dict[int, np.ndarray], rules: TopkRules):
    """The best of a candidate block for each query of a query block."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dim"]
                q, c = np.frombuffer(row["q_vectors"], np.int64).reshape(-1, d), np.frombuffer(row["vectors"], np.int64).reshape(-1, d)
                qid, cid, least = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["least"], np.int64)
                turned_q, turned_c = q @ rotations[d], c @ rotations[d]
                long_q, long_c = np.sqrt((turned_q ** 2).sum(1)), np.sqrt((turned_c ** 2).sum(1))
                slack = 1e-9 * (long_q[:, None] * long_c.max(initial=0)) + 1e-6
                out_q, out_c, out_s = [], [], []
                for at in range(0, len(q), 512):
                    part = slice(at, at + 512)
                    goal = least[part].astype(np.float64)[:, None] - slack[part]
                    alive = long_q[part][:, None] * long_c[None, :] >= goal
                    done, sums = 0, np.zeros(alive.shape)
                    for share in rules.steps:
                        upto = max(done + 1, int(d * share))
                        if upto >= d or not alive.any():
                            break
                        sums += turned_q[part, done:upto] @ turned_c[:, done:upto].T
                        rest = np.sqrt((turned_q[part, upto:] ** 2).sum(1))[:, None] * np.sqrt((turned_c[:, upto:] ** 2).sum(1))[None, :]
                        alive &= sums + rest >= goal
                        done = upto
                    i, j = np.nonzero(alive)
                    if not len(i):
                        continue
                    if len(i) * 20 > alive.size:
                        s = exact_products(q[part], c)[i, j]
                    else:
                        big = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * d >= 2.0 ** 52
                        kind = np.int64 if big else np.float64
                        s = np.einsum("nd,nd->n", q[part].astype(kind)[i], c.astype(kind)[j]).astype(np.int64)
                    fine = (s >= least[part][i]) & ((qid[part][i] != cid[j]) | (cid[j] == NO_ID))
                    i, j, s = i[fine], j[fine], s[fine]
                    order = np.lexsort((cid[j], -s, i))
                    i, j, s = i[order], j[order], s[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    top = place < rules.k
                    out_q.append(at + i[top]), out_c.append(cid[j[top]]), out_s.append(s[top])
                if out_q:
                    qs = np.concatenate(out_q)
                    ids = np.concatenate(out_c)
                    yield {"q_block": [row["q_block"]] * len(qs), "q_row": qs.astype(np.int32), "query_id": qid[qs],
                           "vec_id": pa.array(ids, mask=ids == NO_ID), "score": np.concatenate(out_s)}
    return run


def search(vectors: DataFrame, is_query: Column, rules: TopkRules = TopkRules(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best among all rows but those of its own id.

    Vectors null, empty or with null or non-finite components take no part.  Only vectors of
    one dimension are compared.  Ties go to the smaller id; a null id comes last and is no query.
    Rows equal in id and vector count once; a query id with several vectors gets an answer for each.  With
    fewer candidates than k all are returned; an empty table gives an empty result.
    """
    table = vectors.select(F.col(vec_id).cast("long").alias("id"), whole(F.col(embedding), rules.scale).alias("v"), is_query.alias("is_query")).where(F.col("v").isNotNull())
    table = keep(table.groupBy("id", "v").agg(F.max("is_query").alias("is_query")).select("id", "v", "is_query", F.size("v").alias("dim"))
                 .withColumn("length", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    spark = vectors.sparkSession
    rotations = _rotations(gram(table))
    warm: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in table.orderBy(F.desc("length"), "id").limit(rules.warm_rows).select("id", "v", "dim").collect():
        warm.setdefault(r.dim, []).append((NO_ID if r.id is None else r.id, r.v))
    warm = {d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64)) for d, x in warm.items()}
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # equal lengths are spread by id: one very common vector fills many ranges
    candidates = map_any(table.repartitionByRange(tasks, F.desc("length"), F.xxhash64("id")).sortWithinPartitions(F.desc("length"), F.xxhash64("id")).select("id", "v", "dim"),
                         "dim int, ids binary, vectors binary, longest double", _pack(rules.block_rows, ""))
    queries = table.where(F.col("is_query") & F.col("id").isNotNull())
    blocks = map_any(queries.repartition(max(1, -(-queries.count() // rules.query_rows)), F.xxhash64("id")).select("id", "v", "dim"),
                     "dim int, ids binary, vectors binary, longest double, q_block long", _pack(rules.query_rows, "q_block"))
    blocks = keep(map_any(blocks, "dim int, q_block long, q_ids binary, q_vectors binary, least binary, need double", _thresholds(warm, rules.k)))
    asked = blocks.select("dim", "q_block", "need")
    # one row for a pair of blocks: thousands of vectors on either side
    pairs = keep(candidates).join(asked, "dim").where(F.col("longest") >= F.col("need") - 1e-6).drop("dim", "need")
    met = pairs.join(blocks.drop("need"), "q_block").repartition(tasks, F.xxhash64("ids", "q_block"))
    found = map_any(met, "q_block long, q_row int, query_id long, vec_id long, score long", _meet(rotations, rules))
    best = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= rules.k).select("query_id", "rank", "vec_id", "score")
