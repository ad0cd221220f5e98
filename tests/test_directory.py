"""Directory search against a walk in plain Python, on trees with cycles, of any depth and of over a million nodes."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessella.operators import directory

EDGES = "parent long, child long, ord long"
USERS = "department long, ord long, name string, en_name string"


def plain_walk(edges, root, deepest=None):
    children = {}
    for p, c, o in sorted(edges, key=lambda e: e[2]):
        children.setdefault(p, []).append(c)
    depth, queue = {root: 0}, deque([root])
    while queue:
        at = queue.popleft()
        for c in children.get(at, []) if deepest is None or depth[at] < deepest else []:
            if c not in depth:
                depth[c] = depth[at] + 1
                queue.append(c)
    return depth  # in the order of the walk


def plain_search(edges, users, root, name, enough, deepest=None, page=None):
    found = []
    for node, depth in plain_walk(edges, root, deepest).items():
        shown = sorted((u for u in users if u[0] == node), key=lambda u: u[1])[:page]
        found += [(depth, *u[:2]) for u in shown if name in (u[2] or "") or name in (u[3] or "")]
        if enough and len(found) >= enough:
            break
    return sorted(found)


def graph(seed, n=60):
    """A tree whose siblings are listed in any order, with a second parent for some and edges back to the root's side."""
    r = random.Random(seed)
    edges = [(r.randrange(max(0, c - 6), c), c, r.randrange(100) * 1000 + c) for c in range(1, n)]
    edges += [(r.randrange(n), r.randrange(n), 200_000 + i) for i in range(n // 3)] + [(n - 1, 0, 5), (7, 7, 6)]
    users = [(r.randrange(n), i, r.choice(["Ann", "Bo", None, "Annika"]), r.choice(["Lee", "", None, "Ann"])) for i in range(200)]
    return edges, users


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("enough,deepest,page", [(10, None, None), (None, 3, 2), (1, None, 1), (10_000, None, None), (None, 0, None)])
def test_search(spark, seed, enough, deepest, page):
    edges, users = graph(seed)
    found = directory.search(spark.createDataFrame(edges, EDGES), spark.createDataFrame(users, USERS), 0, directory.named("Ann", "name", "en_name"), enough, deepest, page)
    assert sorted((r.depth, r.department, r.ord) for r in found.collect()) == plain_search(edges, users, 0, "Ann", enough, deepest, page)


def test_deep_chain_with_a_cycle(spark):
    edges = [(i, i + 1, 0) for i in range(25)] + [(25, 0, 0), (12, 3, 1)]
    found = {r.node: r.depth for r in directory.walk(spark.createDataFrame(edges, EDGES), 0).collect()}
    assert found == {i: i for i in range(26)}


def test_unknown_root_and_no_edges(spark):
    edges, users = spark.createDataFrame([], EDGES), spark.createDataFrame([(9, 1, "Ann", None), (1, 2, "Ann", None)], USERS)
    assert [(r.node, r.depth) for r in directory.walk(edges, 9).collect()] == [(9, 0)]
    assert [r.ord for r in directory.search(edges, users, 9, directory.named("Ann", "name")).collect()] == [1]


def test_over_a_million_nodes(spark):
    """A hundred children each; the search ends at the second level and reads no further one."""
    edges = spark.range(1, 1_050_000).select(F.expr("(id - 1) div 100").alias("parent"), F.col("id").alias("child"), F.col("id").alias("ord"))
    depths = {r.depth: r["count"] for r in directory.walk(edges, 0).groupBy("depth").count().collect()}
    assert depths == {0: 1, 1: 100, 2: 10_000, 3: 1_000_000, 4: 1_050_000 - 1_010_101}
    users = spark.range(0, 1_050_000).select(F.col("id").alias("department"), F.col("id").alias("ord"), F.concat(F.lit("u"), "id").alias("name"))
    found = directory.search(edges, users, 0, F.endswith("name", F.lit("7")), enough=10)
    assert sorted(r.department for r in found.collect()) == list(range(7, 107, 10))
