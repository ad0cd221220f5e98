"""Sharding by vector bin packing: bytes, tokens and rows in balance.

Groups of equal texts are the things to place, each as a vector of its bytes,
tokens and rows.  Largest first (by its greatest part of a shard in any of
them), each goes to the shard where the dot product of its vector with the
shard's residual capacity is highest, among those whose bytes it doesn't push
over their capacity.  What is placed is bounded whatever the
input: a group that holds over LARGE of a shard is placed on its own, all
smaller ones are gathered by hash into a fixed number of cells, which keep equal
texts together.

Law ``bytes``: the shards' sizes are near equal.

Defined results: a null text has no bytes; empty and equal texts are groups
like any other; a group stays in one shard unless it is more than a whole shard
in bytes, tokens or rows, and is then dealt by doc_id to as few pieces as that
takes; repeated rows, rows of one doc_id and rows of null doc_id each get a
slot; slots are gapless from 0 in each shard; texts of any length are counted
whole; other columns, whatever their names, are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, materialise, text_or_empty

SHARDS = 40
#: Cells that gather the smaller groups, for each shard.
CELLS_PER_SHARD = 64
#: A group is placed on its own when it holds over this part of a shard in any dimension.
LARGE = 1 / 1024
OVERHEAD = 16
DIMENSIONS = ("size", "tokens", "rows")
#: Part by which a shard's bytes, on which the law is, may exceed its capacity while another still has room.
ROOM = 0.002


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of vectors (one column per dimension, the law's first)."""
    capacity = np.maximum(vectors.sum(axis=0) / shards, 1e-9)
    need = vectors / capacity
    residual, out = np.ones((shards, vectors.shape[1])), np.zeros(len(vectors), dtype=int)
    for i in np.lexsort((np.arange(len(vectors)), -need.max(axis=1))):
        fits = residual[:, 0] - need[i, 0] >= -ROOM
        # Where it fits in no shard, the one with most room for bytes.
        out[i] = best = int(np.argmax(np.where(fits, residual @ need[i], -np.inf) if fits.any() else residual[:, 0]))
        residual[best] -= need[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, tokens, law, shard, slot, grown_shard: one row per row of docs."""
    text = text_or_empty()
    rows = materialise(
        docs.select(
            "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"), F.xxhash64(text).alias("key"),
        ),
        "rows",
    )
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        total = {"size": 0, "tokens": 0, "rows": 0}
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    part = F.greatest(*(F.col(d) / F.lit(max(total[d], 1) / shards) for d in DIMENSIONS))
    # At most 3 x 1024 x shards groups can be large, so they may be broadcast.
    large = rows.groupBy("key", "text_crc32").agg(*sums).where(part > LARGE).select("key", "text_crc32", F.ceil(part).cast("long").alias("pieces"))
    cells = shards * CELLS_PER_SHARD
    unit = F.when(F.col("pieces").isNull(), F.pmod("key", F.lit(cells)).cast("string")).otherwise(
        F.concat_ws("/", F.lit("large"), "key", "text_crc32", F.pmod(F.xxhash64("doc_id"), "pieces"))
    )
    units = rows.join(F.broadcast(large), ["key", "text_crc32"], "left").withColumn("unit", unit).drop("pieces")
    known = sorted(units.groupBy("unit").agg(*sums).collect(), key=lambda r: r.unit)  # bounded by cells and pieces
    vectors = np.array([[r[d] for d in DIMENSIONS] for r in known], dtype=float).reshape(len(known), 3)
    filled, places = [0] * shards, []
    for r, to in zip(known, place(vectors, shards), strict=True):
        places.append((r.unit, int(to), filled[to]))
        filled[to] += r["rows"]
    places = docs.sparkSession.createDataFrame(places, "unit string, shard int, base long")
    numbered = units.withColumn("_n", F.row_number().over(Window.partitionBy("unit").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(F.broadcast(places), "unit").select(
        "doc_id", "size", "text_crc32", "tokens", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("_n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
