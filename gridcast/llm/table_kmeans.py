"""Centroid clustering of integer vectors by scalar lookup tables.

A vector takes part if it has exactly ``dims`` components, none null or
non-finite; component x becomes the integer floor(1024 x). In each round a task
tabulates, for every dimension, the squared difference of every integer value
that occurs in its batch to that dimension's component of every centroid; a
vector's distances are then gathers from these tables and sums, with no
arithmetic on vectors. A table holds the values between a dimension's smallest
and largest one in the batch, or only the occurring ones where these lie far
apart, so its size is bounded by the batch. All arithmetic is exact in 64 bits:
components saturate at plus and minus 2^27, so that even 64 squared differences
(under 2^56 each) add up to less than 2^62.

What leaves a task per round is one row per non-empty cluster (count and
component sums); Spark adds them as decimals and the driver gets one row per
cluster. The vectors are written once as integers; every round reads them. No
row is shuffled by its cluster, so a cluster with a third of all rows is no hot
group. A lost executor's tasks read the written table again.

Ties go to the smaller cluster number; an empty cluster keeps its centroid.
Equal vectors are all kept; equal hashes (repeated ids) are ordered by vector,
null ids last. Fewer vectors than clusters: as many clusters as vectors. Empty
table, or none kept: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.session import forget, written

SCALE = 1024
#: components saturate here, see above
LIMIT = 1 << 27
#: a table spans all values between the smallest and the largest up to so many
#: entries a vector of the batch (and a fixed number more)
SPAN = 4


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """vec_id, v: the integer vectors that take part."""
    x = F.col(vector_col)
    whole = (F.size(x) == dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def integer(c: Column) -> Column:
        held = F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
        return F.floor(held).cast("int")

    return (vectors.where(F.coalesce(whole, F.lit(False)))
            .select(F.col(id_col).alias("vec_id"), F.transform(x, integer).alias("v")))


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def as_matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors, centroids) by tables."""
    total = np.zeros((len(x), len(centroids)), np.int64)
    for d in range(x.shape[1]):
        low, high = int(x[:, d].min()), int(x[:, d].max())
        if high - low <= SPAN * len(x) + 4096:
            values, at = np.arange(low, high + 1), x[:, d] - low
        else:
            values, at = np.unique(x[:, d], return_inverse=True)
        squares = (values[:, None] - centroids[None, :, d]) ** 2
        total += squares[at]
    return total


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance); argmin takes the smaller of equal ones."""
    d = distances(x, centroids)
    cluster = d.argmin(axis=1)
    return cluster, d[np.arange(len(x)), cluster]


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(0), dims)
            cluster, _ = assign(x, centroids)
            count += np.bincount(cluster, minlength=k)
            for c in range(k):
                sums[c] += x[cluster == c].sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))],
            ["cluster", "n", "s"])

    parts = kept.select("v").mapInArrow(run, "cluster int, n long, s array<long>")
    wide = F.array(*[F.sum(F.col("s")[d].cast("decimal(38,0)")).cast("decimal(38,0)") for d in range(dims)])
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), wide.alias("s")).collect():  # a row per cluster
        out[r["cluster"]] = [int(s) // r["n"] for s in r["s"]]
    return out


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256,
    cluster_size of every vector that takes part."""
    spark = vectors.sparkSession
    kept, path = written(kept_vectors(vectors, id_col, vector_col, dims), "vectors")
    id_type = kept.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(kept, clusters, seed)
    out_type = f"vec_id {id_type}, cluster int, distance long"
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(kept, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = assign(as_matrix(batch.column(1), dims), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)],
                                                 ["vec_id", "cluster", "distance"])

    placed, _ = written(kept.mapInArrow(run, out_type), "placed")
    forget(spark, path)
    per = {r["cluster"]: r for r in placed.groupBy("cluster").agg(  # a row per cluster
        F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(int(r["s"]) for r in per.values())
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def of(values: dict[int, object], kind: str) -> Column:
        pick = F.lit(None).cast(kind)
        for c, v in values.items():
            pick = F.when(F.col("cluster") == c, F.lit(v).cast(kind)).otherwise(pick)
        return pick

    return placed.select(
        "vec_id", "cluster", "distance", of({c: int(r["s"]) for c, r in per.items()}, "long").alias("cluster_inertia"),
        F.lit(whole).cast("long").alias("inertia"), of({c: digest[c] for c in per}, "string").alias("centroid_sha256"),
        of({c: int(r["n"]) for c, r in per.items()}, "long").alias("cluster_size"))


def oracle(clusters: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64) -> str:
    """DuckDB twin: the rounds one after the other, components as rows."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""dist_{r} AS MATERIALIZED (
  SELECT x.k, c.c, sum((x.v - c.v) * (x.v - c.v)) AS d FROM parts x JOIN cent_{r} c USING (i) GROUP BY ALL),
near_{r} AS MATERIALIZED (
  SELECT k, c, d FROM dist_{r} QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""cent_{r + 1} AS MATERIALIZED (
  SELECT o.c, o.i, coalesce(m.v, o.v) AS v FROM cent_{r} o LEFT JOIN (
    SELECT n.c, x.i, CAST((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
    FROM near_{r} n JOIN parts x USING (k) GROUP BY n.c, x.i) m ON m.c = o.c AND m.i = o.i)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * greatest(least(x::DOUBLE, {LIMIT // SCALE}), -{LIMIT // SCALE})) AS BIGINT)) AS vec
  FROM embeddings WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT k, unnest(range({dims})) AS i, unnest(vec) AS v FROM kept),
seeds AS MATERIALIZED (
  SELECT k, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, vec) - 1 AS c FROM kept
  QUALIFY c < {clusters}),
cent_0 AS MATERIALIZED (SELECT s.c, p.i, p.v FROM seeds s JOIN parts p USING (k)),
{", ".join(steps)},
said AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM cent_{rounds} GROUP BY c)
SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance,
  CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia,
  centroid_sha256, CAST(count(*) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_size
FROM near_{rounds} n JOIN kept USING (k) JOIN said ON said.c = n.c
"""
