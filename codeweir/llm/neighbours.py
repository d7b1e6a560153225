"""Nearest neighbours as a block matrix join with int8 tiles and error bounds.

Vectors are scaled by a power of two and quantised to int8. What is sent to the tiles are
these bytes, with each vector's scale, length and rounding error. A tile multiplies a
block of queries by a block of rows; the product is off by at most a known bound, so
every row whose upper bound reaches the k-th largest lower bound survives. Survivors of
all tiles are cut once more by the bounds of all, and only what is left is joined to the
original vectors, recomputed in double precision and merged by heaps. The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweir.llm.common import checked_broadcast, removed, table, written

QUERY_BLOCK, ROW_BLOCK = 1024, 8192
#: Queries of a tile whose bounds are held at once.
QUERY_RUN = 64
#: What scaled numbers are kept to, so that a product of two and a sum of their exponents
#: is a double: beyond it, bounds say nothing and the pair survives.
_FAR = 900


def quantised(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 rows; their power of two; and, for rows divided by it (largest component in 0.5 to 1):
    scale, length and the length of what rounding took off."""
    power = np.frexp(np.abs(x).max(1))[1].astype(np.int64)
    x = np.ldexp(np.ldexp(x, (-power // 2)[:, None]), (-power - (-power // 2))[:, None])
    scale = np.abs(x).max(1) / 127.0
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), power, scale, np.sqrt((x * x).sum(1)), np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))


def tile_bounds(queries, rows) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries and rows (as quantised() gives
    them), each in units of two to the power of its query's exponent plus _top(rows).

    For q = q' + a and x = x' + b: |q.x - q'.x'| <= |a||x| + |q'||b|. Doubles add up to what a
    plain loop over the components makes of them, its rounding and underflow included; where
    that loop may overflow, nothing is known.
    """
    q8, qp, qs, ql, qe = queries
    x8, xp, xs, xl, xe = rows
    dim = q8.shape[1]
    # Sums of products of two numbers below 128, in runs that are exact in 24 bits.
    approx = np.zeros((len(q8), len(x8)))
    for d in range(0, dim, 1024):
        approx += q8[:, d : d + 1024].astype(np.float32) @ x8[:, d : d + 1024].astype(np.float32).T
    approx *= qs[:, None]
    approx *= xs[None, :]
    off = qe[:, None] * xl[None, :] + (ql + qe)[:, None] * xe[None, :]
    off = off * (1 + 1e-9) + (ql[:, None] * xl[None, :]) * (dim * 1e-15)
    down = np.maximum(xp - xp.max(), -_FAR)
    exponent = qp[:, None] + xp.max()
    with np.errstate(over="ignore"):
        low = np.ldexp(approx - off, down[None, :])
        high = np.ldexp(approx + off, down[None, :])
        slack = np.where(exponent < -_FAR, np.inf, 1e-270 * dim)
    unknown = (qp[:, None] + xp[None, :] > _FAR) | ~np.isfinite(low) | ~np.isfinite(high)
    return np.where(unknown, -np.inf, low - slack), np.where(unknown, np.inf, high + slack)


def tile_survivors(queries, qids: np.ndarray, rows, ids: np.ndarray, k: int):
    """(query id, row id, lower bound, upper bound, exponent of the bounds) of each query's rows in
    a tile that may be among its k best."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int64)]]
    for a in range(0, len(qids), QUERY_RUN):
        run = slice(a, a + QUERY_RUN)
        part = tuple(x[run] for x in queries)
        low, high = tile_bounds(part, rows)
        own = qids[run, None] == ids[None, :]
        low[own] = -np.inf
        floor = np.partition(low, len(ids) - min(k, len(ids)), axis=1)[:, len(ids) - min(k, len(ids))]
        i, j = np.nonzero((high >= floor[:, None]) & ~own)
        for c, x in zip(out, (qids[run][i], ids[j], low[i, j], high[i, j], part[1][i] + rows[1].max())):
            c.append(x)
    return [np.concatenate(c) for c in out]


def rank_key(score: float) -> tuple[bool, float]:
    """Largest first, as SQL's descending order has it: NaN (of infinities that cancel) before all."""
    return (score != score, 0.0 if score != score else score)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (doubles) of rows with an id and a finite vector that isn't zero."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(good)


def matrix(col) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)


CODES = "id long, dim int, codes binary, power long, scale double, len double, err double"
BOUNDS = "query_id long, id long, low double, high double, exponent long"


def encoded(batches):
    for b in batches:
        sizes, ids = b.column("dim").to_numpy(), b.column("id")
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            x = matrix(b.column("v").take(pa.array(at)))
            q8, power, *rest = quantised(x)
            raw = pa.array([r.tobytes() for r in q8], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(sizes[at]), raw, pa.array(power), *map(pa.array, rest)], names=["id", "dim", "codes", "power", "scale", "len", "err"])


def _codes(t: pa.Table):
    codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.int8).reshape(len(t), -1)
    return (codes, *(t[c].to_numpy() for c in ("power", "scale", "len", "err")))


def few_of_equal(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, v, ...) without those that can't be among any query's k nearest: equal vectors are
    equally near, so of them only k + 1 of the smallest ids count, as one may be the query's
    own, and of the rows of one id k. Vectors of which there are no more stay where they are."""
    many = rows.groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("h")
    many = checked_broadcast(written(many, "ann-repeated"), 500_000)
    own = F.xxhash64("v") == F.col("h")
    hot = rows.join(many, own, "left_semi")
    hot = hot.withColumn("nth", F.row_number().over(Window.partitionBy("v", "id").orderBy("dim"))).where(F.col("nth") <= k)
    hot = hot.withColumn("nth", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1).drop("nth")
    return rows.join(many, own, "left_anti").union(hot)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, id, score: for each row whose id is divisible by every, the k other
    rows of the same dimension with the largest inner product, ties to smaller ids.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without an id, take no part. Rows that repeat an id are one vector's rows: none is
    another's neighbour, each other query lists every one of them (k at most). Of any number
    of equal vectors only the first k + 1 ids are looked at, so work grows with distinct
    vectors. The score is the sum in
    doubles over the components in order, whatever their size: where it overflows it is
    infinite, or NaN, which comes first. An empty table gives an empty result. Extra
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vec_col).withColumn("dim", F.size("v")), "ann-vectors")
    is_query = F.col("id") % every == 0
    n, m = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    row_blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-m // query_block))
    block = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    others = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    codes = written(rows.where(is_query).mapInArrow(encoded, CODES), "ann-codes")
    near_rows = written(few_of_equal(rows, k), "ann-distinct")
    data = near_rows.mapInArrow(encoded, CODES).select("*", block(row_blocks).alias("rb"), others(query_blocks).alias("qb"))
    # Of rows that repeat a query's id, the first by its bytes asks.
    first = Window.partitionBy("id").orderBy("codes", "power", "scale", "err")
    asked = codes.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    asked = asked.select("*", block(query_blocks).alias("qb"), others(row_blocks).alias("rb"))
    by = ("dim", "qb", "rb")

    def tiles(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("query_id", "id", "low", "high", "exponent")
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], t) for c, t in zip(names, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))})
        found = tile_survivors(_codes(left), left["id"].to_numpy(), _codes(right), right["id"].to_numpy(), k)
        return pa.table(dict(zip(names, map(pa.array, found))))

    found = asked.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(tiles, BOUNDS)

    def cut(batches):
        """A query's survivors of all tiles, sorted by query: those that reach its k-th best lower
        bound. Rows that repeat an id count once each."""
        at, held = None, []

        def close():
            q = [np.array(c) for c in zip(*held)]
            top = q[4].max()
            down = np.maximum(q[4] - top, -4000).astype(np.int64)
            low, high = np.ldexp(q[2], down), np.ldexp(q[3], down)
            high = np.where((q[3] > 0) & (high == 0), 5e-324, high)
            floor = np.partition(low, len(low) - min(k, len(low)))[len(low) - min(k, len(low))]
            return np.unique(q[1][high >= floor].astype(np.int64))

        for b in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for r in zip(*(b.column(c).to_pylist() for c in ("query_id", "id", "low", "high", "exponent"))):
                if at is not None and at != r[0]:
                    ids = close()
                    out[0].append(np.full(len(ids), at))
                    out[1].append(ids)
                    held = []
                at = r[0]
                held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "id"])
        if held:
            ids = close()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), at)), pa.array(ids)], names=["query_id", "id"])

    left = written(found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(cut, "query_id long, id long"), "ann-left")
    queries = rows.where(is_query).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("v"))).where("nth = 1")
    queries = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    near = near_rows.select(F.col("id").alias("x_id"), F.col("v").alias("x"), F.col("dim").alias("x_dim")).join(left, F.col("x_id") == F.col("id"))
    near = near.join(queries, "query_id").where(F.col("x_dim") == F.size("q")).select("query_id", "id", "q", "x")

    def merged(batches):
        heaps: dict[int, list] = {}
        for b in batches:
            qs, xs = b.column("q"), b.column("x")
            sizes = np.diff(xs.offsets.to_numpy())
            score = np.zeros(b.num_rows)
            for dim in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == dim))
                q, x = matrix(qs.take(at)), matrix(xs.take(at))
                with np.errstate(over="ignore", invalid="ignore"):
                    total = np.zeros(len(at))
                    for d in range(dim):  # in the order of components, as a plain loop adds them
                        total += q[:, d] * x[:, d]
                score[at.to_numpy()] = total
            for q, x, s in zip(b.column("query_id").to_pylist(), b.column("id").to_pylist(), score.tolist()):
                heap, entry = heaps.setdefault(q, []), (rank_key(s), -x, s)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, entry)
        out = [(q, r, -x, s) for q, heap in heaps.items() for r, (_, x, s) in enumerate(sorted(heap, key=lambda e: e[:2], reverse=True), 1)]
        if out:
            q, r, x, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(x, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "rank", id_col, "score"])

    out = written(near.repartition("query_id").mapInArrow(merged, f"query_id long, rank int, `{id_col}` long, score double"), "ann-rows")
    removed(spark, [rows, codes, near_rows, left])
    return out


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id AND len(q.e) = len(x.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
