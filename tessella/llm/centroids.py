"""Centroid clustering of integer vectors by column expressions alone.

Components become integers, so every distance and mean is exact and runs agree.
The distance to each centroid is zip_with and aggregate over a literal array,
array_min over structs (distance, number) chooses the cluster, and a centroid's
new components are column sums of generated code, divided with rounding down.
What reaches the driver are k rows of sums a round.

Rows: vectors that are null, of another length, or hold null or non-finite
components don't take part; rows that share a vec_id are rows of their own; a
null vec_id hashes like an empty one.  Components beyond 2^20 in magnitude count
as 2^20.  With fewer vectors than k there are fewer centroids, without any the
result is empty.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise, remove, stored
from tessella.llm.vectors import finite, floors

BOUND = 1 << 26
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(rows: DataFrame, length: int, scale: int) -> DataFrame:
    """vec_id, v: the vectors that take part, as integers floor(scale * x)."""
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(finite("embedding") & (F.size("embedding") == length))
    return kept.select("vec_id", floors("embedding", scale, BOUND).alias("v"))


def distance(v: Column | str, centroid: list[int]) -> Column:
    """Squared Euclidean distance of an array of longs to a literal one."""
    of = F.expr(f"array({', '.join(f'{x}L' for x in centroid)})")
    return F.aggregate(F.zip_with(v, of, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda total, x: total + x)


def nearest(v: Column | str, centroids: list[list[int]]) -> Column:
    """Struct (d, i): the smallest distance and the number of its centroid, the smaller one in ties."""
    return F.array_min(F.array(*(F.struct(distance(v, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids))))


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid as the componentwise floor of the mean of its rows; one without rows stays."""
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))]
    found = rows.select(nearest("v", centroids).i.alias("cluster"), "v").groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    means = {r.cluster: [r[f"s{i}"] // r.n for i in range(len(sums))] for r in found}
    return [means.get(i, c) for i, c in enumerate(centroids)]


def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, length: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the digest of the final centroid, a row for each vector.

    Centroids start as the k vectors with the smallest SHA-256 of ``1:<vec_id>``,
    those of one vec_id in order of their components.
    """
    spark = rows.sparkSession
    vectors, path = stored(integers(rows, length, scale), "integers")
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [r.v for r in vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    near = vectors.select("vec_id", nearest("v", centroids).alias("near"))
    assigned = materialise(near.select("vec_id", F.col("near.i").alias("cluster"), F.col("near.d").alias("distance")), "assigned")
    remove(spark, path)
    inertia = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return assigned.select(
        "vec_id", "cluster", "distance", of([inertia.get(i, 0) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digest).alias("centroid_sha256"),
    )


def _oracle(k: int = 16, rounds: int = 3) -> str:
    """The same in SQL: a row for each vector and component, a pair of CTEs for each round."""
    near = """a{r} AS MATERIALIZED (SELECT vec_id, v, min(d * 16 + i) AS s FROM (SELECT k.vec_id, k.v, c.i, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k CROSS JOIN c{r} c) GROUP BY vec_id, v)"""
    mean = """c{n} AS MATERIALIZED (SELECT c.i, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT i, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM (SELECT s % 16 AS i, j, sum(v[j]) AS t, count(*) AS n FROM a{r}, range(1, 65) g(j) GROUP BY 1, 2) GROUP BY i) m ON c.i = m.i)"""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS i, v FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds):
        steps += [near.format(r=r), mean.format(r=r, n=r + 1)]
    steps.append(near.format(r=rounds))
    return f"""WITH {", ".join(steps)}, f AS (SELECT vec_id, (s % 16)::INTEGER AS cluster, (s // 16)::BIGINT AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM f JOIN c{rounds} c ON c.i = f.cluster"""


ORACLE = _oracle()
