"""Vector code compression: codebooks by part, trained by a Lloyd iteration that compares only what changed.

A vector of integers is cut into equal parts, each part position has a codebook.
Beside its code every part keeps its exact squared distance.  Where the entry
that a part was assigned to did not change in the last update, no distance to an
unchanged entry can have become the smallest: only the entries that moved are
compared with the stored distance, and in a tie the lower index wins, as in a
whole scan.  Where it did change the part scans its codebook again.  Distances
are integers, so this gives the codes of a whole scan, at less cost each round.

Spark deals the rows; a task reads them in Arrow batches, and the state of a
round is a table in the shared folder.  The driver holds codebooks (entries x
length numbers) and gets their sums, combined before the shuffle.

Rows: vectors that are null or hold null or non-finite components go.  Of the
others those stay whose length is that of the smallest vec_id (a positive
multiple of the number of parts).  Rows that share a vec_id are rows of their
own; ties and null vec_ids, which come last, are ordered by their components
where codebooks start.  Components beyond 2^14 in magnitude count as 2^14.  With
fewer rows than entries there are fewer entries; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import remove, stored
from tessella.llm.vectors import finite, floors, of_one_length

BOUND = 1 << 26
STATE = "vec_id long, label int, v array<int>, codes array<int>, distances array<long>"
#: Rows that a task compares at a time.
ROWS = 4096


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and squared distance of each row of x: the nearest entry, the lower index in ties."""
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def rescan(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> None:
    """Brings code and distance, exact for the entries before the last update, up to date with it in place."""
    changed = moved[code]
    code[changed], distance[changed] = scan(x[changed], book)
    entries, rows = np.flatnonzero(moved), np.flatnonzero(~changed)
    if len(entries) and len(rows):
        best, d = scan(x[rows], book[entries])
        best = entries[best]
        nearer = (d < distance[rows]) | ((d == distance[rows]) & (best < code[rows]))
        code[rows[nearer]], distance[rows[nearer]] = best[nearer], d[nearer]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def assign(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """rows (vec_id, label, v; with moved also codes and distances) with codes and distances for books (part, entry, position)."""
    parts, _, width = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _matrix(batch["v"], parts * width).astype(np.int64).reshape(-1, parts, width)
                if moved is None:
                    found = [scan(x[:, p], books[p]) for p in range(parts)]
                    codes, distances = (np.stack([f[i] for f in found], axis=1) for i in (0, 1))
                else:
                    codes, distances = _matrix(batch["codes"], parts).astype(np.int64), _matrix(batch["distances"], parts).copy()
                    for p in range(parts):
                        code, distance = codes[:, p].copy(), distances[:, p].copy()
                        rescan(x[:, p], books[p], moved[p], code, distance)
                        codes[:, p], distances[:, p] = code, distance
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["v"], _lists(codes, pa.int32()), _lists(distances, pa.int64())], ["vec_id", "label", "v", "codes", "distances"])

    return rows.mapInArrow(task, STATE)


def sums(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the parts of each entry and their counts: one row an entry from each task, added up before they reach the driver."""
    parts, entries, width = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _matrix(batch["v"], parts * width).astype(np.int64).reshape(-1, width)
            at = (_matrix(batch["codes"], parts) + np.arange(parts) * entries).ravel()
            np.add.at(total, at, x)
            count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        columns = [pa.array(used, pa.int32()), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(width))]
        yield pa.RecordBatch.from_arrays(columns, ["entry", "n", *(f"s{i}" for i in range(width))])

    names = ["n", *(f"s{i}" for i in range(width))]
    found = state.select("v", "codes").mapInArrow(task, "entry int, " + ", ".join(f"{n} long" for n in names))
    total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    for r in found.groupBy("entry").agg(*(F.sum(n).alias(n) for n in names)).collect():
        count[r.entry], total[r.entry] = r.n, [r[n] for n in names[1:]]
    return total.reshape(books.shape), count.reshape(parts, entries)


def trained(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """The rows that take part as (vec_id, label, v, codes, distances), and the codebooks (part, entry, position)."""
    spark = rows.sparkSession
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding").where(finite("embedding"))
    kept, length = of_one_length(kept, "embedding", "vec_id", parts)
    if not length:
        return spark.createDataFrame([], STATE), np.zeros((parts, 0, 0), np.int64)
    state, path = stored(kept.select("vec_id", "label", floors("embedding", scale, BOUND).cast("array<int>").alias("v")), "integers")
    first = np.array([r.v for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()], np.int64)
    books, moved = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2)), None
    for last in [False] * rounds + [True]:
        done = path
        state, path = stored(assign(state, books, moved), "codes")
        remove(spark, done)
        if not last:
            total, count = sums(state, books)
            new = np.where(count[..., None] > 0, total // np.maximum(count, 1)[..., None], books)
            moved, books = (new != books).any(axis=2), new
    return state, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digests(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (over equal labels, null ones together), codebooks_sha256."""
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda total, d: total + d)
    rows = state.select("vec_id", "label", code.alias("code"), error.alias("error"))
    of_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(of_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(rounds: int = 6) -> str:
    """The same in SQL with whole scans: a pair of CTEs for each round."""
    near = """a{r} AS MATERIALIZED (SELECT q.vec_id, q.p, any_value(q.x) AS x, min(list_sum(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 16 + c.e) AS s FROM parts q JOIN c{r} c USING (p) GROUP BY q.vec_id, q.p)"""
    mean = """c{n} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT p, e, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM (SELECT p, s % 16 AS e, j, sum(x[j]) AS t, count(*) AS n FROM a{r}, range(1, 513) g(j) WHERE j <= len(x) GROUP BY 1, 2, 3) GROUP BY p, e) m ON c.p = m.p AND c.e = m.e)"""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding))",
        "parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) g(p))",
        "c0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16))",
    ]
    for r in range(rounds):
        steps += [near.format(r=r), mean.format(r=r, n=r + 1)]
    steps.append(near.format(r=rounds))
    return f"""WITH {", ".join(steps)}, f AS (SELECT vec_id, string_agg(format('{{:02x}}', s % 16), '' ORDER BY p) AS code, sum(s // 16)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT f.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN kept USING (vec_id) CROSS JOIN b"""


ORACLE = _oracle()
