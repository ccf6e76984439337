"""Exact top-k inner products by the threshold algorithm.

Rows are packed into shards of a bounded number of bytes, queries into blocks. Each
block of queries is sent to each shard, so that shards, the larger side, are moved
once. In a shard every dimension has a sorted list. A block's queries go down all lists
together from both ends, so that one product of matrices scores each vector when it is
first seen, and a query stops when no unseen vector can reach its k-th score: the sum
over the lists of its weight times the better of the values at their present depths is
smaller. Queries whose scores need long integers go down alone, from the end that their
signs favour, in each round the lists that lower the bound most. The best k of each
shard are merged by query.

Components become floor(scale * x) in double precision, scores are exact integers; one
that a long does not hold, or a component beyond 2^62, is an error. Vectors that are
null, or hold a null or non-finite component, take no part; nor do empty ones or rows
with a null id. Vectors of different length never meet. Ties go to the
smaller id. A repeated id is a candidate for each row, never for a query of the
same id, and a repeated query has its results for each row. Extra columns are
not read. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD, SHARD_BYTES, BLOCK = 1 << 16, 32 << 20, 256
FIRST_DEPTH, GROWTH, TOGETHER = 32, 1.5, 8  # places that a list goes down at first, how that grows, and of how many lists one goes on
SCORED, TOGETHER_GROWTH = 1 << 13, 2.0  # vectors that a block scores at a time, and how the depth of a block grows
MOST = 2.0**62


def _quantised(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, v): v holds the components as little-endian int64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            for key, vec in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key is None or not vec.is_valid or vec.values.null_count:
                    continue
                x = np.floor(vec.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if len(x) and np.isfinite(x).all():
                    ids.append(key)
                    dims.append(len(x))
                    if np.abs(x).max() > MOST:
                        raise ValueError(f"a component of vector {key} is beyond 2^62 when scaled")
                    out.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "dim", "v"])

    return df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"CAST(`{vec_col}` AS ARRAY<DOUBLE>) AS v").mapInArrow(run, "id long, dim int, v binary")


def _packed(rows: DataFrame, part: str) -> DataFrame:
    """One row (dim, part, ids, vs) for each part of each dimension; components take as few bytes as all of the part's fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        vs = np.frombuffer(b"".join(pdf["v"]), "<i8")
        kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= vs.min() and vs.max() <= np.iinfo(t).max)
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], part: [pdf[part].iloc[0]], "ids": [pdf["id"].to_numpy("<i8").tobytes()], "vs": [vs.astype(kind).tobytes()]})

    return rows.groupBy("dim", part).applyInPandas(run, f"dim int, {part} long, ids binary, vs binary")


class SortedLists:
    """A shard's vectors with a list for each dimension, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.v = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32).T.copy()
        self.largest = int(np.abs(vectors).max(initial=0))
        self.by_type: dict = {}
        self.examined = 0

    def typed(self, query: np.ndarray) -> np.ndarray:
        """The vectors in the fastest type that is exact for this query."""
        most = int(np.abs(query).max(initial=0)) * self.largest * len(query)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        if kind not in self.by_type:
            self.by_type = {kind: self.v.astype(kind)}
        return self.by_type[kind]

    def top(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, by descending score, then id."""
        v = self.typed(query)
        q = query.astype(v.dtype)
        n = len(self.ids)
        dims = np.flatnonzero(query)
        if not len(dims):  # every score is 0: the smallest ids
            at = np.flatnonzero(self.ids != own_id)[:k]
            return self.ids[at], np.zeros(len(at), dtype=np.int64)
        seen = np.zeros(n, dtype=bool)
        down = query[dims] > 0
        weight = q[dims]
        place = lambda depth: self.order[dims, np.where(down, n - 1 - depth, depth)]
        part = lambda depth: v[place(depth), dims] * weight  # noqa: E731  what an unseen vector can have of each dimension
        depth = np.zeros(len(dims), dtype=np.int64)
        now = part(depth)
        kept, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=v.dtype)
        step, some = FIRST_DEPTH, max(1, len(dims) // TOGETHER)
        while True:
            end = np.minimum(depth + step, n - 1)
            then = part(end)
            gain = np.where(depth < n - 1, now - then, -1)
            go = np.flatnonzero(gain >= np.sort(gain)[-some]) if v.dtype == object else np.argpartition(-gain, some - 1)[:some]
            go = go[depth[go] < n - 1]
            fresh = [self.order[dims[d], n - 1 - end[d] : n - depth[d]] if down[d] else self.order[dims[d], depth[d] : end[d] + 1] for d in go]
            new = np.concatenate(fresh) if fresh else np.arange(n)
            new = np.unique(new[~seen[new]])
            seen[new] = True
            depth[go], now[go] = end[go], then[go]
            self.examined += len(new)
            new = new[self.ids[new] != own_id]
            kept, scores = np.concatenate([kept, new]), np.concatenate([scores, v[new] @ q])
            if len(scores) > k:
                least = np.sort(scores)[-k] if v.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
                stay = scores >= least
                kept, scores = kept[stay], scores[stay]
                if sum(map(int, now)) < int(least):
                    break
            if (depth >= n - 1).any():  # a list is at its end: all were seen
                break
            step = min(n, int(step * GROWTH))
        best = np.lexsort((self.ids[kept], -scores))[:k]
        if v.dtype == object and any(abs(int(x)) >= 1 << 63 for x in scores[best]):
            raise OverflowError("a score does not fit a long")
        return self.ids[kept[best]], scores[best].astype(np.int64)


    def tops(self, own_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``top`` of each query of a block, whose queries go down all lists together, from both ends:
        what a round finds is scored by one product of matrices, for the queries that have not stopped."""
        v = self.typed(queries[np.argmax(np.abs(queries).max(axis=1))]) if len(queries) and queries.shape[1] else self.v
        if v.dtype.kind != "f" or not len(self.ids):
            return [self.top(int(key), q, k) for key, q in zip(own_ids, queries, strict=True)]
        n, m = len(self.ids), len(queries)
        q = queries.astype(v.dtype)
        kept: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * m
        scores: list[np.ndarray] = [np.zeros(0, dtype=v.dtype)] * m
        least = np.full(m, -np.inf, dtype=v.dtype)
        live, seen, dims = np.arange(m), np.zeros(n, dtype=bool), np.arange(v.shape[1])
        before, depth = 0, min(FIRST_DEPTH, n)
        while True:
            fresh = np.zeros(n, dtype=bool)
            fresh[self.order[:, before:depth]] = True
            fresh[self.order[:, n - depth : n - before]] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            self.examined += len(new)
            for a in range(0, len(new), SCORED):
                some = new[a : a + SCORED]
                found = q[live] @ v[some].T
                own = np.flatnonzero(np.isin(self.ids[some], own_ids[live]))
                found[:, own] = np.where(own_ids[live][:, None] == self.ids[some[own]][None, :], -np.inf, found[:, own])
                floor = least[live]
                if len(some) > k:
                    unset = np.flatnonzero(np.isneginf(floor))
                    floor[unset] = np.partition(found[unset], len(some) - k, axis=1)[:, len(some) - k]
                row, col = np.nonzero((found >= floor[:, None]) & (found > -np.inf))
                cuts = np.searchsorted(row, np.arange(len(live) + 1))
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    x, at = live[r], col[cuts[r] : cuts[r + 1]]
                    kept[x], scores[x] = np.concatenate([kept[x], some[at]]), np.concatenate([scores[x], found[r, at]])
                    if len(scores[x]) >= k:
                        least[x] = np.partition(scores[x], len(scores[x]) - k)[len(scores[x]) - k]
                        stay = scores[x] >= least[x]
                        kept[x], scores[x] = kept[x][stay], scores[x][stay]
            if 2 * depth >= n or seen.all():
                break
            low, high = v[self.order[:, depth], dims], v[self.order[:, n - 1 - depth], dims]  # between these is what no list has shown
            live = live[np.maximum(q[live] * low, q[live] * high).sum(axis=1) >= least[live]]
            if not len(live):
                break
            before, depth = depth, min(n, int(depth * TOGETHER_GROWTH))
        best = [np.lexsort((self.ids[at], -x))[:k] for at, x in zip(kept, scores, strict=True)]
        return [(self.ids[at[b]], x[b].astype(np.int64)) for at, x, b in zip(kept, scores, best, strict=True)]


def top_k(df: DataFrame, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score); queries are the ids divisible by ``every``."""
    vectors = _quantised(df, scale, id_col, vec_col)
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("dim")).first()
    shard = max(1, min(shard, SHARD_BYTES // (8 * max(1, sizes["dim"] or 1))))
    shards, blocks = max(1, -(-sizes["n"] // shard)), max(1, -(-sizes["n"] // every // block))
    candidates = _packed(vectors.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards))), "shard")
    queries = vectors.filter(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(blocks)))
    queries = _packed(queries, "block").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    sides = candidates.select("dim", "shard", F.lit(-1).cast("long").alias("block"), "ids", "vs").unionByName(queries.select("dim", "shard", "block", "ids", "vs"))
    dealt = sides.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        for batch in batches:
            for i in range(batch.num_rows):
                dim, no_shard, no_block, ids, vs = (batch.column(c)[i].as_py() for c in range(5))
                ids = np.frombuffer(ids, "<i8")
                vs = np.frombuffer(vs, f"<i{len(vs) // (len(ids) * dim)}").astype("<i8").reshape(-1, dim)
                if no_block < 0:  # the shard itself comes first
                    held = ((dim, no_shard), SortedLists(ids, vs))
                    continue
                if not held or held[0] != (dim, no_shard):
                    continue  # no candidate here
                found = held[1].tops(ids, vs, k)
                no = np.repeat(np.arange(len(ids)), [len(f[0]) for f in found])
                cols = [np.full(len(no), dim, dtype=np.int32), np.full(len(no), no_block, dtype=np.int64), no, ids[no], np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["dim", "block", "no", "query_id", "vec_id", "score"])

    found = dealt.select("dim", "shard", "block", "ids", "vs").mapInArrow(run, "dim int, block long, no long, query_id long, vec_id long, score long")
    order = Window.partitionBy("dim", "block", "no", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
