"""Exact deduplication with an extendible-hash index on shared files.

The index maps the 64-bit hash of a normalised text to the chain of texts that
have that hash.  A directory of 2^depth slots, addressed by the leading bits of
the hash, points to buckets; a bucket that holds more than ``capacity`` chains
splits on its next bit, and the directory doubles when the deepest bucket does.
A bucket is a range of the hash and belongs to one owner task: texts go to the
owner of the bucket that the directory names, which compares them byte by byte
(as a grouping key) and numbers the unlike ones of one hash as a chain.
Documents are looked up the same way: directory, bucket, hash, and along the
chain.  Copies of a text that more than one in HOT_PART rows has collapse before
they are sent to the owner.  Only DataFrame functions are used.

Defined results:
* null text is the empty text; texts are equal when they are identical after
  every run of blanks became one space (leading and trailing ones too), whatever
  their length;
* of equal texts the row with the smallest doc_id stays; a null doc_id comes
  after all others; repeated rows of one doc_id and text are one document each,
  of which one stays;
* the directory ends at 2^LEAF_BITS slots, so it can be sent to every task;
  beyond LEAF_BITS doublings buckets hold more than ``capacity``, with the same
  results;
* an empty table gives an empty result; other columns, whatever their names, are
  carried by drop_copies and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import BLANKS, materialise, parts_of, text_or_empty

#: Bits of the hash by which chains are counted before the directory is laid out; it has 2^20 slots of 20 bytes at most.
LEAF_BITS = 20
#: Owner tasks at most; beyond that a task owns several buckets.
OWNERS = 20_000
#: A hash with more than one row in so many is hot, so fewer hashes than that are.
HOT_PART = 1000


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), BLANKS, " ")


def _leading(hash_: Column | str, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit hash; 0 bits give slot 0."""
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(hash_, 64 - bits)


def directory(hashes: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) for every slot, and the global depth.

    ``hashes`` has the column h.  Chains are counted once by their leading
    LEAF_BITS bits; each doubling then looks at those counts only.
    """
    leaves = materialise(hashes.select("h").distinct().groupBy(_leading("h", LEAF_BITS).alias("leaf")).agg(F.count("*").alias("chains")), "leaves")
    depth = 0
    while depth < LEAF_BITS:  # one bounded row comes back per doubling
        load = leaves.groupBy(F.shiftright("leaf", LEAF_BITS - depth)).agg(F.sum("chains").alias("chains"))
        if (load.agg(F.max("chains")).first()[0] or 0) <= capacity:
            break
        depth += 1
    # A slot's bucket has the fewest bits at which it is not overfull.
    slots = hashes.sparkSession.range(1 << depth).withColumnRenamed("id", "slot")
    local = F.lit(depth)
    for bits in range(depth - 1, -1, -1):
        load = leaves.groupBy(F.shiftright("leaf", LEAF_BITS - bits).alias("prefix")).agg(F.sum("chains").alias(f"load{bits}"))
        slots = slots.join(load, F.shiftright("slot", depth - bits) == load.prefix, "left").drop("prefix")
        local = F.when(F.coalesce(F.col(f"load{bits}"), F.lit(0)) <= capacity, bits).otherwise(local)
    found = slots.select("slot", local.alias("local_depth"))
    # A bucket is named after the first of its slots: the bits beyond its depth are zero.
    bucket = F.expr(f"shiftleft(shiftright(slot, {depth} - local_depth), {depth} - local_depth)")
    return found.select("slot", bucket.alias("bucket"), "local_depth"), depth


def _in_bucket(hashed: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """hashed (column h) with the bucket and local_depth that the directory names."""
    return hashed.withColumn("slot", _leading("h", depth)).join(F.broadcast(slots), "slot").drop("slot")


def build_index(docs: DataFrame, capacity: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(keys, index): a row per document, and a row per distinct text.

    keys: bucket, doc_id, h, text_sha256, copies (rows that repeat this doc_id
    and text).  index: bucket, local_depth, h, chain (position among the texts
    of that hash), text_sha256, keep_id, group_size; files hold whole buckets.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", normalised().alias("norm"))
    keys = materialise(
        rows.select("doc_id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256"))
        .groupBy("doc_id", "h", "text_sha256").agg(F.count("*").alias("copies")),
        "keys",
    )
    slots, depth = directory(keys, capacity)
    slots = materialise(slots, "directory")
    limit = (keys.agg(F.sum("copies")).first()[0] or 0) // HOT_PART
    # Fewer than HOT_PART hashes, by pigeonhole: safe to send to every task.
    hot = F.broadcast(keys.groupBy("h").agg(F.sum("copies").alias("n")).where(F.col("n") > max(1, limit)).select("h"))
    hashed = rows.withColumn("h", F.xxhash64("norm"))
    # Copies of a hot text collapse in the map tasks, so its owner gets a few rows.
    collapsed = hashed.join(hot, "h", "left_semi").groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    others = hashed.join(hot, "h", "left_anti").select("h", "norm", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    buckets = slots.agg(F.countDistinct("bucket")).first()[0]
    tasks = max(parts_of(spark), min(buckets, OWNERS))  # about a bucket each, so they don't grow with the table
    owners = _in_bucket(others.unionByName(collapsed), slots, depth).repartition(tasks, "bucket")
    owned = (
        owners.groupBy("bucket", "local_depth", "h", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .select("bucket", "local_depth", "h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("keep_id", "text_sha256")) - 1
    chained = owned.withColumn("chain", chain).select("bucket", "local_depth", "h", "chain", "text_sha256", "keep_id", "group_size")
    return _in_bucket(keys, slots, depth).drop("local_depth"), materialise(chained, "index")


def exact_dedup(docs: DataFrame, capacity: int = 20_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, chain: one row per row of docs."""
    keys, index = build_index(docs, capacity)
    # A hot text has one row in the index, so its many keys are split by AQE's skew join.
    found = keys.join(index, ["bucket", "h", "text_sha256"])
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "bucket", "chain")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    key, no_id, id_ = ["no_id", "id", "sha"], F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    stay = exact_dedup(docs).where("kept").select(no_id.alias("no_id"), id_.alias("id"), F.col("text_sha256").alias("sha"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), no_id.alias("no_id"), id_.alias("id"), F.sha2(normalised(), 256).alias("sha"))
    # The window finds its rows where the join has put them, so texts are shuffled once.
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    return rows.join(stay, key, "left_semi").withColumn("copy", first).where("copy = 1").select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
