"""Exact top-k inner-product search: branch and bound in a ball tree per shard.

The candidates are dealt to shards of at most about ``SHARD_ROWS`` rows, each a
task of its own. In a shard a ball tree is built once; a node is a centre and a
radius, and q.centre + |q| * radius bounds the inner product of q with any row
below it. For a block of queries the nodes are visited from the largest bound
down, and a query leaves the search as soon as its next bound is below its kth
score. That score is shared: a first pass over a few shards gives a lower bound for
each query, which every shard starts from, and it rises from shard to shard within
a task. The queries go to all shards as a broadcast of at most about QUERY_BYTES;
more queries are answered in several rounds.

Components are floor(1024 x), held as doubles, which is exact. Scores are exact
integers: products that leave the exact range of doubles are made with Python's
integers, and a score beyond 64 bits counts as the nearest value within them.

Cases: rows whose vector is null, empty, or holds a null or non-finite
component (also one for which 1024 x is not finite), and rows with a null id, take
no part; vectors are only compared with others of their length; a query's own row
is no candidate, every other row is, also one of equal id or vector; rows of one id
that are queries get a list each; ties go to the smaller id; fewer than k candidates give fewer rows; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import cut

SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS, PILOT_SHARDS = 4096, 1024, 128, 2
#: Bytes of queries that are broadcast at once, and tasks for the shards at most.
QUERY_BYTES, MAX_TASKS = 32 << 20, 20_000
#: Above this product of squared size and length float64 sums are no longer exact.
EXACT = 2.0**52
NEVER = np.iinfo(np.int64).min + 1  # can be negated


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """row (a number of its own), id, v and dim."""
    v = F.col(vec_col).cast("array<double>")
    good = (F.size(vec_col) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x * scale).alias("v"), F.size(vec_col).alias("dim"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, dim, row, id, v), sorted by part and dim, to one row of bytes per part and dim."""
    key, held = None, []

    def out() -> pa.RecordBatch:
        rows, ids, vecs = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (rows, ids, np.floor(vecs))]], names=["part", "dim", "rows", "ids", "vecs"])

    for b in batches:
        part, dim = b.column(0).to_numpy(), b.column(1).to_numpy()
        edges = np.flatnonzero(np.diff(part) | np.diff(dim)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(part)], strict=True):
            if hi == lo:
                continue
            if key != (now := (int(part[lo]), int(dim[lo]))):
                if key is not None:
                    yield out()
                key, held = now, []
            held.append((b.column(2).to_numpy()[lo:hi], b.column(3).to_numpy()[lo:hi], b.column(4).slice(lo, hi - lo).flatten().to_numpy()))
    if key is not None:
        yield out()


def shards_of(vectors: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """part, dim, rows, ids, vecs. Parts are numbered from 0; their number follows the row count, and each is a task."""
    n = max(1, -(-vectors.count() // rows))
    tasks = min(n, MAX_TASKS)
    part = F.pmod(F.xxhash64("row"), F.lit(n))
    spread = vectors.select(part.alias("part"), "dim", "row", "id", "v").repartitionById(tasks, (F.col("part") % tasks).cast("int"))
    return spread.sortWithinPartitions("part", "dim").mapInArrow(_pack, "part long, dim int, rows binary, ids binary, vecs binary")


class BallTree:
    """Nodes in arrays; rows are reordered so that each node holds a range of them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vecs: np.ndarray):
        self.order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left, right
        centre, radius = [], []
        x, self.exact = vecs, _exact(vecs)

        def build(lo: int, hi: int) -> int:
            own = x[self.order[lo:hi]]
            c = own.mean(0)
            k = len(self.nodes)
            self.nodes.append((lo, hi, -1, -1))
            d = own - c
            centre.append(c)
            radius.append(np.sqrt((d * d).sum(1).max()))
            if hi - lo > LEAF_ROWS and self.exact and radius[k] > 0:
                a = own[np.argmax((d * d).sum(1))]
                b = own[np.argmax(((own - a) ** 2).sum(1))]
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own @ (b - a), mid)]
                self.nodes[k] = (lo, hi, build(lo, lo + mid), build(lo + mid, hi))
            return k

        if self.exact:
            build(0, len(ids))
        else:  # bounds would overflow: every row is tried
            self.nodes, centre, radius = [(0, len(ids), -1, -1)], [np.zeros(vecs.shape[1])], [np.inf]
        self.rows, self.ids, self.vecs = rows[self.order], ids[self.order], vecs[self.order]
        self.centre, self.radius = np.array(centre), np.array(radius)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        if not self.exact:
            return np.full((len(q), 1), np.inf)
        c = q @ self.centre.T
        return (c + np.sqrt((q * q).sum(1))[:, None] * self.radius) * (1 + 1e-12) + np.abs(c) * 1e-9 + 1e-3

    def search(self, own: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (query index, score, id) among which are each query's k best with scores of at least floor, which rises. own: row numbers of the queries."""
        exact = self.exact and _exact(q)
        bound = self.bounds(q) if exact else np.full((len(q), len(self.nodes)), np.inf)
        best_s, best_i = np.full((len(q), k), NEVER), np.full((len(q), k), np.iinfo(np.int64).max)
        heap = [(-float(bound[:, 0].max()), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            alive = np.flatnonzero(bound[:, node] >= floor)
            if not len(alive):
                continue
            lo, hi, left, right = self.nodes[node]
            if left >= 0:
                for x in (left, right):
                    heapq.heappush(heap, (-float(bound[alive, x].max()), x))
                continue
            s = np.rint(q[alive] @ self.vecs[lo:hi].T).astype(np.int64) if exact else _wide(q[alive], self.vecs[lo:hi])
            s[self.rows[lo:hi][None, :] == own[alive][:, None]] = NEVER
            s_all = np.concatenate([best_s[alive], s], 1)
            i_all = np.concatenate([best_i[alive], np.broadcast_to(self.ids[lo:hi], s.shape)], 1)
            top = np.lexsort((i_all, -s_all), axis=1)[:, :k]
            best_s[alive], best_i[alive] = np.take_along_axis(s_all, top, 1), np.take_along_axis(i_all, top, 1)
            kth = best_s[alive][:, -1]
            floor[alive] = np.where(kth > NEVER, np.maximum(floor[alive], kth), floor[alive])
        at, col = np.nonzero(best_s > NEVER)
        return at, best_s[at, col], best_i[at, col]


def _exact(x: np.ndarray) -> bool:
    """Whether products of such vectors are exact in doubles."""
    return float(np.abs(x).max(initial=0)) < np.sqrt(EXACT / max(1, x.shape[1]))


def _wide(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products in Python's integers, held within 64 bits."""
    whole = lambda x: np.array([int(y) for y in x.ravel()], object).reshape(x.shape)
    return np.clip(whole(q) @ whole(v).T, NEVER + 1, np.iinfo(np.int64).max).astype(np.int64)


def _searcher(k: int, queries, floors):
    """For mapInArrow over shards. queries: broadcast, by dim: row numbers, ids, vectors; floors: by dim, a lower bound of each query's kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        risen = {dim: f.copy() for dim, f in floors.value.items()} if floors else {}
        for b in batches:
            for r in b.to_pylist():
                dim = r["dim"]
                if dim not in queries.value:
                    continue
                rows, ids, vecs = queries.value[dim]
                floor = risen.setdefault(dim, np.full(len(rows), -np.inf))
                tree = BallTree(np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vecs"], np.float64).reshape(-1, dim))
                for lo in range(0, len(rows), BLOCK_QUERIES):
                    block = slice(lo, lo + BLOCK_QUERIES)
                    at, s, i = tree.search(rows[block], vecs[block], k, floor[block])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[block][at]), pa.array(ids[block][at]), pa.array(i), pa.array(s)], names=["row", "query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _by_dim(queries: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The queries of one round; their bytes are bounded."""
    t = queries.select("dim", "row", "id", "v").toArrow()
    dims = t.column("dim").to_numpy()
    out = {}
    for dim in np.unique(dims).tolist():
        own = t.filter(pa.array(dims == dim)).combine_chunks()
        out[dim] = (own.column("row").to_numpy(), own.column("id").to_numpy(), np.floor(own.column("v").combine_chunks().flatten().to_numpy()).reshape(-1, dim))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on the column ``id``."""
    v = cut(usable_vectors(vectors, id_col, vec_col))
    shards, queries = cut(shards_of(v)), v.filter(is_query)
    context, schema = v.sparkSession.sparkContext, "row long, query_id long, vec_id long, score long"
    size = queries.agg(F.sum(8 * (F.col("dim") + 2))).first()[0] or 0
    rounds = -(-size // QUERY_BYTES) or 1
    answers = []
    for n in range(rounds):
        own = _by_dim(queries.filter(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(rounds)) == n))
        shared = context.broadcast(own)
        pilot = _best(shards.filter(F.col("part") < PILOT_SHARDS).mapInArrow(_searcher(k, shared, None), schema), k)
        kth = pilot.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k).select("row", "kth").toArrow()
        known = dict(zip(kth.column("row").to_pylist(), kth.column("kth").to_pylist(), strict=True))
        floors = context.broadcast({dim: np.array([known.get(r, -np.inf) for r in rows.tolist()], np.float64) for dim, (rows, _, _) in own.items()})
        ranked = _best(shards.mapInArrow(_searcher(k, shared, floors), schema), k)
        answers.append(cut(ranked) if rounds > 1 else ranked)
    out = answers[0]
    for x in answers[1:]:
        out = out.union(x)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
