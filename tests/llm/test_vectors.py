"""Operators on vectors against plain Python, on odd rows, ties and an empty table."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import centroids, descent, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, node string, x string, d string, cluster string, u string, codes string, n string, s string"
BAD = [None, [1.0, None] + [0.0] * 62, [float("nan")] * 64, [float("inf")] + [0.0] * 63]


def table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 9) for r in rows], SCHEMA).repartition(3)


def odd_rows(seed=1, n=90):
    """Vectors on a coarse grid, so that distances tie; repeated rows, huge components, nulls everywhere."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-3, 4, 64) / 8).tolist(), None if i % 7 == 0 else i % 4) for i in range(n)]
    rows += [rows[3], rows[3], (5, rows[min(9, n - 1)][1], 2), (None, rows[min(8, n - 1)][1], 1), (n, [1e30] + [0.25] * 63, 0), (n + 1, [0.0] * 64, None)]
    return rows + [(200 + i, v, 3) for i, v in enumerate(BAD)] + [(300, [0.5] * 8, 1), (301, [], 1)]


def usable(rows, length=64):
    return [r for r in rows if r[1] is not None and len(r[1]) == length and all(x is not None and math.isfinite(x) for x in r[1])]


def ints(vector, scale):
    return [math.floor(max(-(1 << 26), min(1 << 26, float(np.float32(x)) * scale))) for x in vector]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_codes(rows):
    kept = [(r[0], r[2], ints(r[1], 4096)) for r in usable(rows)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:16]
    cut = lambda v: [v[p * 8 : p * 8 + 8] for p in range(8)]
    books = [[cut(r[2])[p] for r in first] for p in range(8)]
    for last in [False] * 6 + [True]:
        codes = [[min(range(len(books[p])), key=lambda e: (squared(part, books[p][e]), e)) for p, part in enumerate(cut(r[2]))] for r in kept]
        if not last:
            for p in range(8):
                for e in range(len(books[p])):
                    own = [cut(r[2])[p] for r, c in zip(kept, codes, strict=True) if c[p] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    error = [sum(squared(part, books[p][c[p]]) for p, part in enumerate(cut(r[2]))) for r, c in zip(kept, codes, strict=True)]
    of_label = {}
    for r, e in zip(kept, error, strict=True):
        of_label[r[1]] = of_label.get(r[1], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{x:02x}" for x in c), e, of_label[r[1]], sha) for r, c, e in zip(kept, codes, error, strict=True)), key=str)


@pytest.mark.parametrize("n", [90, 5])
def test_vector_codes(spark, n):
    rows = odd_rows(n=n)
    found = vector_codes.digests(*vector_codes.trained(table(spark, rows)))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_codes(rows)


def test_rescan_gives_what_a_whole_scan_gives():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, book = rng.integers(-2, 3, (40, 3)), rng.integers(-2, 3, (6, 3))
        code, distance = vector_codes.scan(x, book)
        new = np.where(rng.random((6, 1)) < 0.4, rng.integers(-2, 3, (6, 3)), book)
        vector_codes.rescan(x, new, (new != book).any(axis=1), code, distance)
        whole = vector_codes.scan(x, new)
        assert (code == whole[0]).all() and (distance == whole[1]).all()


def plain_clusters(rows):
    kept = [(r[0], ints(r[1], 64)) for r in usable(rows)]
    digest = lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    book = [r[1] for r in sorted(kept, key=lambda r: (digest(r), r[1]))[:16]]
    near = lambda v: min((squared(v, c), i) for i, c in enumerate(book))
    for _ in range(3):
        of = [near(r[1])[1] for r in kept]
        for i in range(len(book)):
            own = [r[1] for r, c in zip(kept, of, strict=True) if c == i]
            if own:
                book[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [near(r[1]) for r in kept]
    inertia = lambda i: sum(d for d, c in last if c == i)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    return sorted(((r[0], c, d, inertia(c), sum(x for x, _ in last), sha[c]) for r, (d, c) in zip(kept, last, strict=True)), key=str)


@pytest.mark.parametrize("n", [90, 5])
def test_clusters(spark, n):
    rows = odd_rows(n=n)
    found = centroids.clusters(table(spark, rows))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_clusters(rows)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


def plain_nearest(rows, asked, count=20):
    kept = sorted({(r[0], tuple(float(np.float32(x)) for x in r[1])) for r in usable(rows, len(rows[0][1])) if r[0] is not None and any(r[1])})
    out = {}
    for q in kept:
        if asked(q[0]):
            scores = [(-sum(a * b for a, b in zip(q[1], r[1], strict=True)), r[0]) for r in kept if r != q]
            out.setdefault(q[0], []).append([(i + 1, v, -s) for i, (s, v) in enumerate(sorted(scores)[:count])])
    return out


def test_nearest_of_odd_rows(spark):
    """Few nodes, so the first blocks meet all: the result is that of brute force, also in ties and repeated rows."""
    rows = odd_rows(n=40)
    found = descent.nearest(table(spark, rows), F.col("vec_id") % 2 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = {}
    for r in sorted(found.collect()):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == {q: lists[0] for q, lists in plain_nearest(rows, lambda i: i % 2 == 0).items()}


def test_nearest_with_few_candidates(spark):
    rows = [(i, [float(i + 1), 1.0], 0) for i in range(4)]
    found = descent.nearest(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(found.collect())] == [(1, 3, 5.0), (2, 2, 4.0), (3, 1, 3.0)]
    assert descent.nearest(table(spark, rows[:1]), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_among_copies(spark):
    """A third of the rows are one vector: each gets the smallest other ids of its copies."""
    rng = np.random.default_rng(5)
    one = (rng.normal(size=16) * 3).tolist()
    rows = [(i, one if i % 3 == 0 else rng.normal(size=16).tolist(), 0) for i in range(900)]
    found = {}
    for r in descent.nearest(table(spark, rows), F.col("vec_id") % 60 == 0).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    copies = [r[0] for r in rows if r[1] is one]
    assert all([found[q][k] for k in sorted(found[q])] == [c for c in copies if c != q][:20] for q in range(0, 900, 60))


@pytest.mark.parametrize("norms", [False, True])
def test_recall(spark, norms):
    """Against brute force, on directions without any structure; with norms of several sizes too, whose largest are hubs."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    if norms:
        x *= rng.lognormal(0, 0.5, (6000, 1)).astype(np.float32)
    found = descent.nearest(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0).collect()
    asked = np.arange(0, 6000, 20)
    score = x[asked].astype(float) @ x.T.astype(float)
    score[np.arange(len(asked)), asked] = -np.inf
    best = {int(q): set(np.argsort(-s)[:20].tolist()) for q, s in zip(asked, score, strict=True)}
    assert len(found) == 20 * len(asked) and all(abs(r.score - float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float))) < 1e-9 for r in found)
    assert sum(r.vec_id in best[r.query_id] for r in found) >= 0.9 * len(found)


def test_empty_vectors(spark):
    for rows in ([], [(i, v, 1) for i, v in enumerate(BAD)]):
        df = table(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
        assert vector_codes.digests(*vector_codes.trained(df)).count() == 0
        assert centroids.clusters(df).count() == 0
        assert descent.nearest(df, F.col("vec_id") % 20 == 0).count() == 0
