"""Exact top-k search by no-random-access aggregation.

Vectors are cut into blocks, and these into tiles. A tile has, for every component, its values as a sorted list,
made once for all queries; for a query, a list is read in sequence, from its high end where the query's component
is positive and from its low end where it is negative. What is read is added to the vectors' scores; a score lies
between what was read plus each unread list's worst, and plus each unread list's frontier. Reading stops when few
outsiders can still reach the k-th best lower bound, or the k-th score of the tiles before; the final scores of
those few are resolved, and a block passes on k vectors a query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import emit, prepare, rows_of, stored

SCALE = 256
CANDIDATES, QUERIES, TILE, BATCH = 16384, 1024, 2048, 256
#: First depth and vectors left at the end, per k. Sums of doubles are exact integers below this.
FIRST, FEW, EXACT = 4, 4, 2.0**52
BLOCK = "part long, dim int, ids binary, uids binary, body binary"
FOUND = "query_id long, quid long, vec_id long, uid long, score long"


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id, uid, embedding -> blocks of at most size vectors of one length; other vectors take no part."""
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def block(dim, rows):
            nonlocal number
            ids, uids, body = zip(*sorted(rows, key=lambda r: r[:2]), strict=True)
            number += 1
            return number, dim, np.array(ids, np.int64).tobytes(), np.array(uids, np.int64).tobytes(), np.array(body, np.float64).tobytes()

        def cut():
            for vec_id, uid, vector in rows_of(batches):
                if vec_id is None or vector is None or not len(vector) or any(x is None for x in vector):
                    continue
                v = np.floor(np.array(vector, np.float64) * SCALE)
                if not np.isfinite(v).all():
                    continue
                rows = held.setdefault(len(v), [])
                rows.append((vec_id, uid, v))
                if len(rows) >= size:
                    yield block(len(v), held.pop(len(v)))
            for dim, rows in held.items():
                yield block(dim, rows)

        yield from emit(cut(), BLOCK, 8)

    return vectors.mapInArrow(run, BLOCK)


class Lists:
    """A tile's vectors as one list per component, in falling order; read from its end for negative components of a query."""

    def __init__(self, x: np.ndarray):
        self.x, self.largest = x, np.abs(x).max(initial=0)
        at = np.argsort(-x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, at, axis=0)
        self.rank = np.empty_like(at)
        np.put_along_axis(self.rank, at, np.arange(len(x))[:, None], axis=0)
        self._read: dict[int, tuple] = {}

    def read(self, begin: int, end: int) -> tuple[np.ndarray, ...]:
        """What ranks begin to end add, from the high ends and from the low ends, and what ranks up to end have shown; made once."""
        if end not in self._read:
            low = len(self.x) - 1 - self.rank
            parts = [np.where((r >= begin) & (r < end), self.x, 0.0) for r in (self.rank, low)]
            self._read[end] = *parts, *((r < end).astype(float) for r in (self.rank, low))
        return self._read[end]


def search(lists: Lists, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query: positions and exact scores of its k best in a tile, and how deep the lists were read.

    own: each query's own position, which takes no part, or -1. Vectors that score below a query's floor may be
    left out: k better ones are known. A vector's score lies between what was read of it plus each unread list's
    worst, and plus each one's frontier. A query for which few outsiders can still be among the k best has their
    final scores resolved; the others read on. One depth of all queries' lists is one matrix product.
    """
    n, d = lists.x.shape
    out = np.zeros((len(q), n), bool)
    out[np.flatnonzero(own >= 0), own[own >= 0]] = True
    if d * np.abs(q).max(initial=0) * lists.largest >= EXACT:
        whole = np.vectorize(int, otypes=[object])
        scores = whole(q) @ whole(lists.x).T
        return [(*_best(np.flatnonzero(~out[i]), scores[i], k), n) for i in range(len(q))]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    score, active, results = np.zeros((len(q), n)), np.arange(len(q)), [None] * len(q)
    begin, end = 0, min(n, max(FIRST * k, n // 8))
    while len(active):
        high, low, seen_high, seen_low = lists.read(begin, end)
        u, v = up[active], down[active]
        now = score[active] + u @ high.T + v @ low.T
        if end == n:
            for j, i in enumerate(active):
                results[i] = *_best(np.flatnonzero(~out[i] & (now[j] >= floor[i])), now[j], k), n
            break

        def unread(of_high: np.ndarray, of_low: np.ndarray) -> np.ndarray:
            return (u @ of_high + v @ of_low)[:, None] - ((u * of_high) @ seen_high.T + (v * of_low) @ seen_low.T)

        gone = out[active]
        lower = np.where(gone, -np.inf, now + unread(lists.values[-1], lists.values[0]))
        kth = np.maximum(floor[active], np.partition(lower, n - k, axis=1)[:, n - k] if n > k else -np.inf)
        gone |= now + unread(lists.values[end - 1], lists.values[n - end]) < kth[:, None]
        out[active], score[active] = gone, now
        done = n - gone.sum(axis=1) <= FEW * k
        for i in active[done]:
            rest = np.flatnonzero(~out[i])
            now = np.zeros(n)
            now[rest] = lists.x[rest] @ q[i]
            results[i] = *_best(rest[now[rest] >= floor[i]], now, k), end
        active, begin, end = active[~done], end, min(n, 2 * end)
    return results


def _best(at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the positions at, the k of the largest scores, ties to the earlier; and the scores, held to 64 bits."""
    mine = scores[at]
    if len(at) > 8 * k and mine.dtype != object:
        kth = np.partition(mine, len(mine) - k)[len(mine) - k]
        at, mine = at[mine >= kth], mine[mine >= kth]
    order = sorted(range(len(at)), key=lambda j: (-mine[j], at[j]))[:k]
    return at[order], np.array([max(-(2**63), min(2**63 - 1, int(mine[j]))) for j in order], np.int64)


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows but itself, ties to the smaller vec_id.

    is_query(column) marks the rows that ask. Rows without id or vector, with an empty vector or with null or
    non-finite components take no part; vectors of different lengths do not meet. Rows that share an id are
    separate candidates, and separate queries. Fewer candidates than k give fewer rows; no row gives none.
    Other columns are ignored. Where products pass 2 to the 52, scores are summed as whole numbers without bounds;
    a score beyond 64 bits is held to the range of a long.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("uid"), F.col(vector_col).alias("embedding"))
    rows = stored(rows)
    blocks = stored(_blocks(rows, CANDIDATES))
    ask = rows.filter(is_query(F.col("vec_id")))
    asked = stored(_blocks(ask.repartition(ask.count() // QUERIES + 1), QUERIES))
    # Each query block meets each candidate block: the query blocks are dealt to the blocks' numbers, by an equi-join.
    heads = blocks.select("part", "dim").join(asked.select("part", "dim").toDF("qpart", "dim"), "dim")
    queries = asked.select(F.col("part").alias("qpart"), F.col("ids").alias("q_ids"), F.col("uids").alias("q_uids"), F.col("body").alias("q_body"))
    pairs = heads.join(queries, "qpart").join(blocks.drop("dim"), "part").repartition(F.col("part"), F.col("qpart"))
    pairs = pairs.select("dim", "q_ids", "q_uids", "q_body", "ids", "uids", "body")

    def run(batches):
        def found():
            for dim, q_ids, q_uids, q_body, ids, uids, body in rows_of(batches):
                q_ids, q_uids, ids, uids = (np.frombuffer(a, np.int64) for a in (q_ids, q_uids, ids, uids))
                q, x = (np.frombuffer(a, np.float64).reshape(-1, dim) for a in (q_body, body))
                yield from best(q_ids, q_uids, q, ids, uids, x)

        yield from emit(found(), FOUND, 20_000)

    def best(q_ids, q_uids, q, ids, uids, x):
        """The k best of a candidate block for each query; each tile's search knows the k-th scores so far."""
        place = dict(zip(uids.tolist(), range(len(uids)), strict=True))
        own = np.array([place.get(u, -1) for u in q_uids.tolist()], np.int64)
        kept: list[list[tuple]] = [[] for _ in range(len(q))]
        floor = np.full(len(q), -np.inf)
        for j in range(0, len(x), TILE):
            lists = Lists(x[j : j + TILE])
            inside = np.where((own >= j) & (own < j + len(lists.x)), own - j, -1)
            for i in range(0, len(q), BATCH):
                for m, (at, scores, _) in enumerate(search(lists, q[i : i + BATCH], inside[i : i + BATCH], k, floor[i : i + BATCH]), i):
                    both = kept[m] + [(-s, int(ids[j + a]), int(uids[j + a])) for a, s in zip(at.tolist(), scores.tolist(), strict=True)]
                    kept[m] = sorted(both)[:k]
                    floor[m] = -kept[m][-1][0] if len(kept[m]) == k else -np.inf
        for m, rows in enumerate(kept):
            for s, vec_id, uid in rows:
                yield int(q_ids[m]), int(q_uids[m]), vec_id, uid, -s

    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = pairs.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
