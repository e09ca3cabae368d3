"""Operator 11: exact top-k search by inner product, pruned by segment statistics.

Every component x becomes floor(scale * x), so scores are integers. A vector is cut
into segments; of each, the mean and the deviation are kept, at several resolutions
(``LEVELS``, coarse to fine). For two segments of n components with means a, b and
deviations s, t the squared distance is at least n ((a - b)^2 + (s - t)^2), so their
inner product is at most n (a b + s t). The sum over the segments bounds a score from
above; a pair whose bound lies under the query's k-th score so far is dropped at the
coarsest resolution that shows it, and survivors of the finest are computed exactly.

Queries and rows are dealt into blocks of bounded size. A cell is a block of queries
with a block of rows; in it, bounds of many pairs are one matrix product. Each cell
gives at most k rows a query, of which the best k stay. Rows are sent once for every
block of queries, queries once for every block of rows; nothing is broadcast.

Bounds are computed with a slack far above rounding errors, so the result is exact.

Defined edge cases: vectors that are null or hold null or non-finite components take no
part; shorter vectors count as filled up with zeros, so an empty one scores 0; a row
without an id is no query but a candidate, after all ids among equals; rows that repeat
an id and vector are one query, rows that repeat an id with another vector one query
each, and none of them is a candidate of its own id; repeated candidates are ranked one
by one; fewer than k candidates give fewer rows; an empty table gives an empty result;
other columns are ignored. A score that does not fit in 64 bits fails the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, cell_key, ids, near_partitions

SCALE, EVERY, K = 64.0, 20, 20
#: Segments a vector is cut into, coarse to fine.
LEVELS = (1, 4, 16)
#: Most queries and rows of a block, fewest rows of one, and the tile in which a cell is worked off.
QUERIES, ROWS, FEW, TILE = 16_384, 65_536, 512, (256, 1024)
_SLACK = 1e-5
_FOUND = "query_id long, mark long, vec_id long, score long"


def segments(x: np.ndarray, parts: int) -> np.ndarray:
    """Coordinates whose inner products bound those of the rows of ``x`` from above."""
    width = x.shape[1]
    edges = np.linspace(0, width, min(parts, width) + 1).astype(int)[:-1]
    n = np.diff(np.append(edges, width))
    total, square = np.add.reduceat(x, edges, axis=1), np.add.reduceat(x * x, edges, axis=1)
    spread = np.sqrt(np.maximum(n * square - total * total, 0))  # whole numbers under the root
    length = np.sqrt(square.sum(axis=1, keepdims=True)) * _SLACK
    return np.hstack([total / np.sqrt(n), spread / np.sqrt(n), length])


def _within(bounds, floor, q, x, i, j):
    """Those of the pairs (i, j) whose bound reaches the floor of the query."""
    rows, cols = np.unique(i), np.unique(j)
    if len(i) * 8 < len(rows) * len(cols):
        got = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
    else:
        got = (q[rows] @ x[cols].T)[np.searchsorted(rows, i), np.searchsorted(cols, j)]
    if not bounds:
        return i, j, got
    ok = got >= floor[i]
    return i[ok], j[ok], got[ok]


def best(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best rows of ``x`` for every row of ``q``; whole numbers, exact in doubles."""
    looks = [(segments(q, p), segments(x, p)) for p in LEVELS] if q.shape[1] else []
    out = []
    for a in range(0, len(q), TILE[0]):
        mine = slice(a, a + TILE[0])
        n = len(q[mine])
        floor = np.full(n, -np.inf)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b in range(0, len(x), TILE[1]):
            some = slice(b, b + TILE[1])
            open_ = x_id[some][None, :] != q_id[mine][:, None]
            if looks:
                open_ &= looks[0][0][mine] @ looks[0][1][some].T >= floor[:, None]
            i, j = np.nonzero(open_)
            for fine_q, fine_x in looks[1:]:
                if len(i):
                    i, j, _ = _within(True, floor, fine_q[mine], fine_x[some], i, j)
            if not len(i):
                continue
            i, j, score = _within(False, floor, q[mine], x[some], i, j)
            ok = score >= floor[i]
            i, d, score = (np.concatenate(y) for y in zip(held, (i[ok], x_id[some][j[ok]], score[ok]), strict=True))
            by = np.lexsort((d, -score, i))
            i, d, score = i[by], d[by], score[by]
            start = np.searchsorted(i, np.arange(n + 1))
            keep = np.arange(len(i)) - start[i] < k
            held = i[keep], d[keep], score[keep]
            full = np.flatnonzero(np.diff(start) >= k)
            floor[full] = score[start[full] + k - 1]
        out.append((held[0] + a, held[1], held[2]))
    return tuple(np.concatenate(y) for y in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _scaled(table: pa.Table, scale: float, width: int) -> np.ndarray:
    col = table.column("vector").combine_chunks()
    flat = np.floor(scale * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _wide(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int):
    """As ``best``, for numbers that doubles do not hold exactly: whole numbers of any size, without bounds."""
    rows = [[int(c) for c in row] for row in x]
    out = []
    for i, row in enumerate(q):
        mine = [int(c) for c in row]
        got = sorted((-sum(a * b for a, b in zip(mine, other, strict=True)), int(d)) for other, d in zip(rows, x_id, strict=True) if d != q_id[i])[:k]
        out += [(i, d, -s) for s, d in got]
    return tuple(np.array([o[c] for o in out], np.int64) for c in range(3))


def _search(scale: float, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max([0, *(y.column("vector").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0) for y in (left, right))])
        q, x = _scaled(left, scale, width), _scaled(right, scale, width)
        q_id, x_id = ids(left, "query_id"), ids(right, "vec_id")
        most = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
        exact = (width * most) ** 2 < 2**53
        i, d, score = (best if exact else _wide)(q, q_id, x, x_id, k)
        null = d == NO_ID
        return pa.table({"query_id": pa.array(q_id[i]), "mark": left.column("mark").take(pa.array(i)), "vec_id": pa.array(d, mask=null), "score": pa.array(score.astype(np.int64))})

    return run


def finite(vector: Column) -> Column:
    """Whether a vector takes part."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def search(queries: DataFrame, rows: DataFrame, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, mark, rank, vec_id and score: the k best ``rows`` (vec_id, vector) of each of ``queries``, none with its own id.

    ``mark`` is a hash of the query's vector and tells queries of one id apart.
    """
    spark = rows.sparkSession
    queries = queries.select(F.col("vec_id").alias("query_id"), "vector").where(finite(F.col("vector"))).distinct().withColumn("mark", F.xxhash64("vector"))
    rows = rows.select("vec_id", "vector").where(finite(F.col("vector")))
    n_queries, n_rows, parts = queries.count(), rows.count(), near_partitions(spark)
    across = max(1, -(-n_queries // QUERIES))
    down = max(1, -(-n_rows // ROWS), min(parts, n_rows // FEW) // across)
    key = cell_key(across * down, parts)
    block = lambda n: (F.monotonically_increasing_id() % n).cast("int")
    left = queries.withColumn("b", F.pmod(F.xxhash64("query_id", "mark"), F.lit(across)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r")).select(key(F.col("r") * across + F.col("b")).alias("cell"), "query_id", "mark", "vector")
    right = rows.withColumn("r", block(down)).select("*", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("b")).select(key(F.col("r") * across + F.col("b")).alias("cell"), "vec_id", "vector")
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_search(scale, k), _FOUND)
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op11(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return search(rows.where(F.col("vec_id") % EVERY == 0), rows).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.e, r.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
