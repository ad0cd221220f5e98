"""Nearest neighbours by largest inner product: a graph by NN-descent, then greedy search in it.

Equal vectors are one node.  NN-descent keeps K neighbours of each node and
improves them round by round: a node's fresh neighbours, forward and reverse,
meet its other neighbours, so that neighbours of neighbours find each other.
Spark joins carry that: links meet the vectors of their ends, are dealt by the
node where they meet, scored there in numpy blocks of at most 4 * SAMPLE members,
and what beats a node's last neighbour goes to that node, which keeps the best.
It begins with neighbours along random projections, in blocks of sorted rows.

A query is a node of the graph and begins at its own neighbours.  Each step opens
the best nodes of its beam that are not open yet, by a join with the neighbour
lists, until all of the beam is open.  Directions of 16 bits and a norm guide
building and search; the best are scored again on the original vectors, in
doubles, and give their members.

The index holds every node.  Sampling (SAMPLE links of a kind into a meeting, a
hub in HUB * SAMPLE meetings) bounds every group, also around hubs, and makes the
search approximate: recall against brute force is measured in the tests.

Rows: vectors that are null or zero or hold null or non-finite components, rows
without vec_id, and vectors of another length than that of the smallest vec_id
take no part.  Rows of equal vec_id and vector are one row; those of one vec_id
with several vectors are rows of their own.  Ties go to the smaller vec_id.  With
fewer candidates than asked for all are returned; an empty table gives an empty
one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialise, parts_of, remove, stored
from tessella.llm.vectors import finite, of_one_length

#: Neighbours of a node, and links of a kind (fresh or known, forward or reverse) that a node sends into a meeting.
K, SAMPLE = 48, 16
#: A node takes part in so many times SAMPLE meetings of each kind.
HUB = 8
#: Candidates that a meeting proposes to each of its members.
PROPOSED = 4
#: Rounds of descent at most; it ends before where fewer than this share of all links is new.
ROUNDS, FEW = 8, 0.03
#: Rows of a block along a projection, and projections.
BLOCK, PROJECTIONS = 96, 2
#: Candidates that a query keeps, those it opens at a time, and steps at most.
BEAM, OPENED, STEPS = 256, 48, 12
RESULT = "query_id long, rank int, vec_id long, score double"
_LINK = "u long, v long, s double, fresh boolean"


def _halves(column: pa.Array) -> np.ndarray:
    """Rows of 16-bit floats of a binary column whose values have one length."""
    if not len(column):
        return np.zeros((0, 0), np.float32)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float16).reshape(len(column), -1).astype(np.float32)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [field.split()[0] for field in schema.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by key, cut so that no key's rows are in two batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = _numbers(batch[key])
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut == 0 and held and held[-1][key][-1].as_py() == keys[0]:
            held.append(batch)
            continue
        yield from _joined([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    yield from _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Position of each row within its group; rows of a group (equal in all keys) stand together."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(start, np.diff(np.append(start, len(new))))


def _shuffled(u: np.ndarray, v: np.ndarray, seed: int) -> np.ndarray:
    """A number for each pair that looks random, the same in every run."""
    x = u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (v.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def best(links: DataFrame, keep: int, opened: int = 0, seed: int = 0) -> DataFrame:
    """The ``keep`` best links of each u, once each, with pick, least and head.

    pick marks fresh links (1) that are used next and then no longer fresh: the
    ``opened`` best, or without it SAMPLE of them at random, as of the known ones
    (2).  least is the score to beat, head marks a row of each u.
    """
    schema = _LINK + ", pick int, least double, head boolean"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "u"):
            u, v, s, fresh = (_numbers(batch[c]) for c in ("u", "v", "s", "fresh"))
            order = np.lexsort((fresh, v, u))
            order = order[_ranks(u[order], v[order]) == 0]
            order = order[np.lexsort((v[order], -s[order], u[order]))]
            rank = _ranks(u[order])
            order, rank = order[rank < keep], rank[rank < keep]
            u, v, s, fresh = u[order], v[order], s[order], fresh[order]
            full = rank == keep - 1
            least = np.full(len(u), -np.inf)
            if full.any():
                at = np.searchsorted(u[full], u)
                known = (at < full.sum()) & (u[full][np.minimum(at, full.sum() - 1)] == u)
                least[known] = s[full][at[known]]
            among = np.lexsort((rank if opened else _shuffled(u, v, seed), ~fresh, u))
            place = np.empty(len(u), int)
            place[among] = _ranks(u[among], fresh[among])
            pick = np.where(fresh & (place < (opened or SAMPLE)), 1, np.where(~fresh & (place < SAMPLE) & (not opened), 2, 0)).astype(np.int32)
            yield _batch(schema, u, v, s, fresh & (pick != 1), pick, least, rank == 0)

    return links.select("u", "v", "s", "fresh").repartition(parts_of(links.sparkSession), "u").sortWithinPartitions("u").mapInArrow(task, schema)


def _projected(nodes: DataFrame, which: int, parts: int) -> DataFrame:
    """Links between rows that are close along a projection: of each block every row's K nearest."""

    def block(ids: np.ndarray, units: np.ndarray, norms: np.ndarray) -> Iterator[pa.RecordBatch]:
        for rows in np.array_split(np.arange(len(ids)), max(1, len(ids) // BLOCK)):
            if len(rows) < 2:
                continue
            score = units[rows] @ units[rows].T * norms[rows]
            np.fill_diagonal(score, -np.inf)
            k = min(K, len(rows) - 1)
            near = np.argpartition(-score, k - 1, axis=1)[:, :k]
            yield _batch(_LINK, np.repeat(ids[rows], k), ids[rows][near].ravel(), np.take_along_axis(score, near, 1).ravel().astype(np.float64), np.ones(near.size, bool))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 20 * BLOCK:
                for b in _joined(held):
                    yield from block(_numbers(b["node"]), _halves(b["unit"]), _numbers(b["norm"]))
                held = []
        for b in _joined(held):
            yield from block(_numbers(b["node"]), _halves(b["unit"]), _numbers(b["norm"]))

    along = F.get("along", F.lit(which))
    return nodes.repartitionByRange(parts, along, "node").sortWithinPartitions(along, "node").select("node", "unit", "norm").mapInArrow(task, _LINK)


def _met(members: DataFrame) -> DataFrame:
    """What members of a meeting propose to each other: to each its PROPOSED best that beat its least, one of the two fresh."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "pivot"):
            pivot, ids, fresh, least, norms = (_numbers(batch[c]) for c in ("pivot", "member", "fresh", "least", "norm"))
            units, rank = _halves(batch["unit"]), _ranks(pivot)
            starts = np.flatnonzero(rank == 0)
            for at in range(0, len(starts), 64):
                some = starts[at : at + 64]
                end = starts[at + 64] if at + 64 < len(starts) else len(pivot)
                group, place = np.cumsum(rank[some[0] : end] == 0) - 1, rank[some[0] : end]
                at_row = np.full((len(some), place.max() + 1), -1)
                at_row[group, place] = np.arange(some[0], end)
                id_ = np.where(at_row < 0, -1, ids[at_row])
                new, there = fresh[at_row], at_row >= 0
                score = np.matmul(units[at_row], units[at_row].transpose(0, 2, 1)) * norms[at_row].astype(np.float32)[:, None, :]
                score[(id_[:, :, None] == id_[:, None, :]) | ~(new[:, :, None] | new[:, None, :]) | ~there[:, None, :]] = -np.inf
                k = min(PROPOSED, score.shape[2])
                near = np.argpartition(-score, k - 1, axis=2)[:, :, :k]
                found = np.take_along_axis(score, near, 2)
                good = there[:, :, None] & (found > least[at_row][:, :, None]) & np.isfinite(found)
                g, i, j = np.nonzero(good)
                yield _batch(_LINK, id_[g, i], id_[g, near[g, i, j]], found[good].astype(np.float64), np.ones(len(g), bool))

    return members.repartition(parts_of(members.sparkSession), "pivot").sortWithinPartitions("pivot").mapInArrow(task, _LINK)


def meetings(links: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """pivot, member, fresh, least, unit, norm: what each node's picked links bring together, forward and reverse."""
    chance = F.xxhash64("u", "v", F.lit(seed))
    order = Window.partitionBy("v", "pick").orderBy(chance)
    picked = links.where("pick > 0").select("u", "v", "pick").withColumn("n", F.row_number().over(order)).where(F.col("n") <= HUB * SAMPLE)
    forward = picked.select(F.col("u").alias("pivot"), F.col("v").alias("member"), "pick")
    reverse = picked.where(F.col("n") <= SAMPLE).select(F.col("v").alias("pivot"), F.col("u").alias("member"), "pick")
    ends = nodes.select("node", "unit", "norm").join(links.where("head").select(F.col("u").alias("node"), "least"), "node")
    return forward.union(reverse).join(ends, F.col("member") == F.col("node")).select("pivot", "member", (F.col("pick") == 1).alias("fresh"), "least", "unit", "norm")


def graph(nodes: DataFrame, count: int) -> tuple[DataFrame, str]:
    """u, v, s: up to K neighbours of each node by NN-descent, and the folder they are in."""
    spark = nodes.sparkSession
    parts = max(1, min(parts_of(spark), count // 1000))
    begun = _projected(nodes, 0, parts)
    for which in range(1, PROJECTIONS):
        begun = begun.union(_projected(nodes, which, parts))
    links, path = stored(best(begun, K), "links")
    for turn in range(ROUNDS):
        if links.where("fresh OR pick = 1").count() < FEW * K * count:
            break
        found = links.union(_met(meetings(links, nodes, turn)).select("*", F.lit(0).alias("pick"), F.lit(0.0).alias("least"), F.lit(False).alias("head")))
        done = path
        links, path = stored(best(found, K, seed=turn + 1), "links")
        remove(spark, done)
    return links.select("u", "v", "s"), path


def _opened(rows: DataFrame) -> DataFrame:
    """Neighbours of opened nodes that beat the query's least: rows have u, least, unit and near, a list of (v, norm, unit)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                near = batch["near"].flatten()
                of = np.repeat(np.arange(batch.num_rows), np.diff(_numbers(batch["near"].offsets)))
                score = np.einsum("ij,ij->i", _halves(near.field("unit")), _halves(batch["unit"])[of]) * _numbers(near.field("norm"))
                good = score > _numbers(batch["least"])[of]
                yield _batch(_LINK, _numbers(batch["u"])[of][good], _numbers(near.field("v"))[good], score[good].astype(np.float64), np.ones(int(good.sum()), bool))

    return rows.mapInArrow(task, _LINK)


def search(links: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """u, v, s, fresh: the BEAM best nodes that a greedy search from each asked node u finds, u among them; fresh ones it did not open."""
    spark, unit = nodes.sparkSession, nodes.select("node", "unit", "norm")
    near = links.join(unit, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.collect_list(F.struct("v", "norm", "unit")).alias("near"))
    lists, lists_path = stored(near, "lists")
    who = asked.join(unit, "node")
    own = who.select(F.col("node").alias("u"), F.col("node").alias("v"), F.col("norm").alias("s"), F.lit(False).alias("fresh"))
    begun = links.join(asked, F.col("u") == F.col("node")).select("u", "v", "s", F.lit(True).alias("fresh"))
    beam, path = stored(best(own.union(begun), BEAM, OPENED), "beam")
    for _ in range(STEPS):
        opened = beam.where("pick = 1")
        if opened.isEmpty():
            break
        query = opened.select("u", "least", F.col("v").alias("node")).join(who.select(F.col("node").alias("u"), "unit"), "u")
        found = _opened(query.join(lists, "node").select("u", "least", "unit", "near"))
        done = path
        beam, path = stored(best(beam.select("u", "v", "s", "fresh").union(found), BEAM, OPENED), "beam")
        remove(spark, done)
    remove(spark, lists_path)
    return beam.select("u", "v", "s", "fresh")


def indexed(rows: DataFrame, members: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, ids: the first vec_ids of its members, unit, norm, along) and the rows that take part (vec_id, x)."""
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0))
    kept, length = of_one_length(kept, "embedding", "vec_id")
    kept = kept.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    first = kept.dropDuplicates(["vec_id", "x"]).withColumn("n", rank).where(F.col("n") <= members)
    classes = first.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    directions = np.random.default_rng(7).normal(size=(length, PROJECTIONS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch["x"].flatten()).reshape(batch.num_rows, length)
            largest = np.abs(x).max(axis=1)
            norm = np.sqrt(((x / largest[:, None]) ** 2).sum(axis=1)) * largest
            unit = x / largest[:, None] / (norm / largest)[:, None]
            along = unit @ directions
            packed = pa.array([row.tobytes() for row in unit.astype(np.float16)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, along.size + 1, PROJECTIONS, dtype=np.int32)), pa.array(along.ravel()))
            yield pa.RecordBatch.from_arrays([batch["x"], batch["ids"], packed, pa.array(norm), lists], ["x", "ids", "unit", "norm", "along"])

    packed = classes.mapInArrow(task, "x array<double>, ids array<long>, unit binary, norm double, along array<double>")
    return materialise(packed.withColumn("node", F.monotonically_increasing_id()), "nodes"), kept


def nearest(rows: DataFrame, asked: Column, count: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``asked`` holds for, the ``count`` rows with the largest inner product that the search finds."""
    nodes, kept = indexed(rows, count + 1)
    of = nodes.agg(F.count("*").alias("n")).first().n
    if not of:
        return rows.sparkSession.createDataFrame([], RESULT)
    who = kept.where(asked).distinct().join(nodes.select("node", "x"), "x").select(F.col("vec_id").alias("query_id"), "node")
    who = materialise(who, "queries")
    links, path = graph(nodes, of)
    beam = search(links, nodes, who.select("node").distinct())
    remove(rows.sparkSession, path)
    # A class gives one place at least, and guiding scores have 11 bits: three times as many are scored again.
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    few = beam.withColumn("n", place).where(F.col("n") <= 3 * count).select("u", "v")
    ends = nodes.select(F.col("node").alias("v"), F.col("x").alias("y"), "ids")
    both = few.join(ends, "v").join(nodes.select(F.col("node").alias("u"), "x"), "u")
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda total, p: total + p)
    each = both.select("u", "v", score.alias("score"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("u").orderBy(F.desc("score"), "vec_id", "v")
    top = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count + 1)
    lists = top.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "v"))).alias("found"))
    mine = lambda r: (r.vec_id == F.col("query_id")) & (r.v == F.col("node"))
    given = who.join(lists, F.col("u") == F.col("node")).select("query_id", F.posexplode(F.slice(F.filter("found", lambda r: ~mine(r)), 1, count)).alias("at", "r"))
    return given.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "r.vec_id", "r.score")
