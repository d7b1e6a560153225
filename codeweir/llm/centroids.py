"""Centroid clustering with Elkan's bounds, in exact integers.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of the
distance to each of the k. A round moves the bounds by what centroids moved, and computes a
distance only where the bounds and the distances between centroids can't rule it out. Bounds
are doubles rounded to the safe side and compared strictly, so a centroid that may be as
near as the vector's own is always looked at: ties go to the smaller number, as a plain
search decides them. What is computed is exact, in 64-bit integers.

State is a written table; a task gives the sums of its rows by centroid, and these are united
by a tree. The driver has k centroids and no vector beyond the first k.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from codeweir.llm.common import bounded_batches, merged_by_tree, removed, table, written

#: Components beyond it have no exact distance in 64 bits for any dimension up to 64.
FAR = 1 << 27
#: Rows whose distances are computed at a time.
RUN = 4096
#: What a rounded sum or root of doubles may be off by, relative to it: far more than it is.
SLACK = 1e-12


def up(x: np.ndarray) -> np.ndarray:
    """A bound that is certainly not below the exact value."""
    return x * (1 + SLACK) + SLACK


def down(x: np.ndarray) -> np.ndarray:
    """A bound that is certainly not above the exact value, and not below zero."""
    return np.maximum(x * (1 - SLACK) - SLACK, 0.0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to one centroid, or row by row."""
    d = x - c
    return (d * d).sum(1)


def assigned(x: np.ndarray, centroids: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids (ties: the smaller number) of rows x, from bounds that hold for these
    centroids: (centroid, its squared distance or -1 if it wasn't needed, upper, lower,
    distances computed)."""
    k = len(centroids)
    between = np.stack([squared(centroids, c) for c in centroids])
    half = down(np.sqrt(between.astype(np.float64)) / 2)
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    exact, computed = np.full(len(x), -1, np.int64), 0
    others = np.arange(k)[None, :] != own[:, None]
    # A centroid is left out only where it is certainly farther: where a bound is reached, it stays.
    may = others & (upper[:, None] >= lower) & (upper[:, None] >= half[own])
    some = np.flatnonzero(may.any(1))
    if len(some):
        exact[some] = squared(x[some], centroids[own[some]])
        computed += len(some)
        root = np.sqrt(exact[some].astype(np.float64))
        upper[some], lower[some, own[some]] = up(root), down(root)
        may[some] &= (upper[some, None] >= lower[some]) & (upper[some, None] >= half[own[some]])
        for j in range(k):
            # By now a nearer centroid may have been found, so both bounds are asked again.
            at = some[may[some, j]]
            at = at[(upper[at] >= lower[at, j]) & (upper[at] >= half[own[at], j]) & (own[at] != j)]
            if not len(at):
                continue
            d = squared(x[at], centroids[j])
            computed += len(at)
            root = np.sqrt(d.astype(np.float64))
            lower[at, j] = down(root)
            nearer = (d < exact[at]) | ((d == exact[at]) & (j < own[at]))
            to = at[nearer]
            own[to], exact[to], upper[to] = j, d[nearer], up(root[nearer])
    return own, exact, upper, lower, computed


STATE = "id long, x binary, cluster int, upper double, lower binary, computed long"


def _rows(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("x").to_pylist()), "<i4").reshape(b.num_rows, dim).astype(np.int64)


def _sums(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, list[int]]:
    """Members of each centroid, and their componentwise sums."""
    schema = "slot int, node int, n long, sums binary"

    def count(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            x, own = _rows(b, dim), b.column("cluster").to_numpy()
            for j in np.unique(own):
                rows = x[own == j]
                n[j] += len(rows)
                total[j] += rows.sum(0)
        some = np.flatnonzero(n)
        node = np.full(len(some), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(node), pa.array(n[some]), pa.array([total[j].tobytes() for j in some], pa.binary())], names=["slot", "node", "n", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(dim, np.int64)
        for raw in t["sums"]:
            total += np.frombuffer(raw.as_py(), np.int64)
        return pa.table({"slot": t["slot"][:1], "node": t["node"][:1], "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = state.select("x", "cluster")
    n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    for r in merged_by_tree(rows.mapInArrow(count, schema), rows.rdd.getNumPartitions(), add, schema).collect():  # k rows
        n[r["slot"]], total[r["slot"]] = r["n"], np.frombuffer(bytes(r["sums"]), np.int64)
    return n, total


def _round(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """The state after an assignment. moved: by how much each centroid has moved at most since the
    bounds were made (None: there are no bounds yet). last: with the exact distance
    of every row in place of its bounds."""
    k, dim = centroids.shape

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, RUN):
                part = b.slice(a, RUN)
                x, m = _rows(part, dim), min(RUN, b.num_rows - a)
                if moved is None:
                    own, upper, lower = np.zeros(m, np.int64), np.full(m, np.inf), np.zeros((m, k))
                else:
                    own = part.column("cluster").to_numpy().astype(np.int64)
                    upper = up(part.column("upper").to_numpy() + moved[own])
                    lower = np.frombuffer(b"".join(part.column("lower").to_pylist()), "<f8").reshape(m, k)
                    lower = down(lower - moved[None, :])
                own, exact, upper, lower, computed = assigned(x, centroids, own, upper, lower)
                cols = [part.column("id"), part.column("x"), pa.array(own.astype(np.int32))]
                if last:
                    rest = exact < 0
                    exact[rest] = squared(x[rest], centroids[own[rest]])
                    yield pa.RecordBatch.from_arrays([cols[0], cols[2], pa.array(exact)], names=["id", "cluster", "distance"])
                else:
                    counted = np.zeros(m, np.int64)
                    counted[0] = computed
                    cols += [pa.array(upper), pa.array([r.tobytes() for r in lower], pa.binary()), pa.array(counted)]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "x", "cluster", "upper", "lower", "computed"])

    return rows.mapInArrow(run, "id long, cluster int, distance long" if last else STATE)


def integers(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """id and v: floor(scale * component), of vectors with exactly dim components, none null or
    non-finite."""
    v = F.col(vec_col).cast("array<double>")
    good = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & good)
    cell = lambda x: F.when(F.abs(x * scale) <= FAR, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances in 64 bits"))).cast("int")
    return rows.select("id", F.transform("v", cell).alias("v"))


def packed(batches):
    for b in batches:
        raw = [np.asarray(v, "<i4").tobytes() for v in b.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(raw, pa.binary())], names=["id", "x"])


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1:", id_col: str = "vec_id", vec_col: str = "embedding", counters: list | None = None) -> DataFrame:
    """One row for each vector with exactly dim components, none null or non-finite: id, cluster,
    distance (squared, in units of 1 / scale), cluster_inertia, inertia and
    centroid_sha256.

    Components count as floor(scale * x). Centroids start as the k vectors whose sha256 of
    seed and id is smallest; rows that repeat an id come in the order of their components,
    rows without an id last. In each round every vector goes to its nearest centroid (ties:
    the smaller number), then every centroid with members becomes the floor of their mean;
    a last assignment follows. With fewer than k vectors there are as many centroids; equal
    first vectors make equal centroids, of which the first has all members. Vectors of
    other sizes, null ones and those with null or non-finite components take no part; an
    empty table gives an empty result; other columns are ignored. A scaled component beyond
    2**27 raises, as its distances wouldn't be exact. counters: gets the number of
    distances that each round computed, of rows * k.
    """
    if dim > 64:
        raise ValueError("distances of more than 64 components may not be exact")
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = integers(vectors, id_col, vec_col, dim, scale)
    hashed = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.select("id", "v", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)
    done = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], done)
    state, moved, old = written(rows.mapInArrow(packed, "id long, x binary"), "cluster-vectors"), None, []
    for _ in range(rounds):
        old.append(state)
        state = written(_round(state, centroids, moved, False), "cluster-state")
        if counters is not None:
            counters.append(state.agg(F.sum("computed")).first()[0] or 0)
        n, total = _sums(state, len(centroids), dim)
        new = centroids.copy()
        new[n > 0] = total[n > 0] // n[n > 0][:, None]  # floors, also of negative sums
        moved, centroids = up(np.sqrt(squared(new, centroids).astype(np.float64))), new
    out = written(_round(state, centroids, moved, True), "cluster-rows")
    removed(spark, [*old, state])
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    return out.select(
        F.col("id").alias(id_col), "cluster", "distance",
        _looked_up([sums.get(j, 0) for j in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        _looked_up(digests, "string").alias("centroid_sha256"),
    )


def _looked_up(values: list, kind: str) -> Column:
    """The value of a row's cluster, from k literals."""
    return F.element_at(F.array(*(F.lit(x).cast(kind) for x in values)), F.col("cluster") + 1)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Three rounds and a last assignment, written out. Products are taken in 64 bits."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    parts = [
        r"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS c, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, x) <= 16)""",
    ]
    for r in range(4):
        nearest = f"""a{r} AS MATERIALIZED (
  SELECT v.vec_id, v.x, min(({distance}, c.c)) AS best
  FROM (SELECT *, row_number() OVER () AS nth FROM v) v CROSS JOIN c{r} c GROUP BY v.nth, v.vec_id, v.x)"""
        parts.append(nearest)
        if r < 3:
            parts.append(f"""s{r} AS (SELECT best[2] AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))")
    return (
        "WITH "
        + ",\n".join(parts)
        + """
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia,
  sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = best[2]"""
    )


SQL = _sql()
