"""SimHash near-deduplication over a segment-popcount embedding.

A 64-bit fingerprint maps to the bit counts of its 32 segments of 2 bits.  The
Manhattan distance of two such vectors is at most the number of bits in which
the fingerprints differ, so fingerprints that link at RADIUS = 2 bits lie within
2 of each other on this grid.  The range-join uses that vectors within 2 differ
in at most two segments: of GROUPS groups of segments all but two are equal in
both.  For each choice of two groups to leave out, a cell of the grid is what
the others count; every fingerprint goes to its cell of each choice, 15 in all,
and two within the distance meet in one of them at least.

What meets in a cell is verified exactly, by the bits in which the pair differs.
A cell with more than CROWD fingerprints isn't compared pair by pair: those who
stand in one are verified by the 64-bit values within 1 bit of them.  Two
fingerprints differ in at most 2 bits when, and only when, such a value is
shared, and at most 65 fingerprints are within 1 bit of a value.  All that meet
at a value are linked to the smallest, which joins the same documents as all
their pairs, so dense groups of near copies stay linear.

Defined results: null and empty texts have fingerprint zero; of fewer than
three words the whole sequence is the shingle; a text of any length is hashed
whole; repeated rows are documents of their own; a null doc_id is never the
smallest, and rows that only link to such stay; other columns, whatever their
names, are carried by drop_near_copies and ignored elsewhere; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import IDENTITY, materialise, parts_of, with_identity
from tessella.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Groups of segments; RADIUS of them are left out in each choice, the others make a cell.
GROUPS = 6
#: Fingerprints in a cell above which the neighbourhoods of one bit are used instead of pairs.
CROWD = 64


def simhash(text: bytes) -> int:
    """Signed 64-bit fingerprint of a text in UTF-8."""
    words = text.lower().split()  # on bytes: A-Z, and the six ASCII blanks
    if not words:
        return 0
    shingles = zip(words, words[1:], words[2:]) if len(words) >= SHINGLE_WORDS else [words]
    digest, join = xxhash.xxh64_digest, b" ".join
    hashes = b"".join([digest(join(s), SEED) for s in shingles])
    bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp, and more columns of longs."""

    def run(batches):
        for b in batches:
            fps = [simhash(t or b"") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *map(b.column, more)], names=["doc_id", "fp", *more])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *more).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in more)]))


def embedding_sql(fp: str) -> str:
    """The bit counts (0 to 2) of the 32 segments, 2 bits each in one long."""
    odd = 6148914691236517205  # 0x5555...
    low, high = f"({fp} & {odd}L)", f"(shiftrightunsigned({fp}, 1) & {odd}L)"
    return f"shiftleft({low} & {high}, 1) | ({low} ^ {high})"


def cells(vector: str) -> Column:
    """The cell of a vector for each choice of groups: a hash of the choice and what the other groups count.

    Unlike cells with one hash only meet to be found unlike when verified.
    """
    edges = [32 * g // GROUPS for g in range(GROUPS + 1)]
    mask = [sum(3 << 2 * k for k in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = [signed(sum(mask[g] for g in range(GROUPS) if g not in out)) for out in combinations(range(GROUPS), RADIUS)]
    return F.expr(f"array({', '.join(f'xxhash64({i}, {vector} & {m}L)' for i, m in enumerate(choices))})")


def within_one_bit(fp: str) -> Column:
    return F.expr(f"array({', '.join([fp] + [f'{fp} ^ shiftleft(1L, {k})' for k in range(64)])})")


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links that join all fingerprints (column fp, distinct) at 2 or fewer differing bits.

    Fingerprints are dealt to tasks before they are multiplied, and once more by
    cell; counting, choosing and comparing all use that one shuffle.  Joins ask
    for a sort-merge: Spark's estimate doesn't see what explode makes of a row.
    """
    parts = parts_of(distinct.sparkSession)
    dealt = distinct.select("fp").repartition(parts, "fp")
    placed = dealt.select("fp", F.explode(cells(f"({embedding_sql('fp')})")).alias("cell")).repartition(parts, "cell")
    # fps are distinct, so least <> most tells cells of more than one.
    met = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("cell", "n")
    members = placed.join(met.hint("merge"), "cell")
    few = members.where(f"n <= {CROWD}")
    a, b = few.select("cell", F.col("fp").alias("v")), few.select("cell", F.col("fp").alias("u"))
    pairs = a.join(b.hint("merge"), "cell").where(f"v < u AND bit_count(u ^ v) <= {RADIUS}").select("u", "v").distinct()
    crowded = members.where(f"n > {CROWD}").select("fp").distinct()
    return pairs.unionByName(star_links(materialise(crowded, "crowded")))


def star_links(distinct: DataFrame) -> DataFrame:
    """The same for fingerprints of crowded cells, by the values within one bit of each."""
    parts = parts_of(distinct.sparkSession)
    halfway = distinct.repartition(parts, "fp").select("fp", F.explode(within_one_bit("fp")).alias("value")).repartition(parts, "value")
    met = halfway.groupBy("value").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v <> most").select("value", "v")
    return halfway.join(met.hint("merge"), "value").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def _grouped(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp, root, component_id, and more columns of docs: a row per row of docs; a group has one root."""
    fps = materialise(fingerprints(docs, *more), "fingerprints")
    heads = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    roots = components(links(heads))
    members = roots.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(roots.select("v", "v").distinct())
    known = members.join(heads, "fp")
    first = known.groupBy("root").agg(F.min("head").alias("component_id"))
    found = materialise(known.select("fp", "root").join(first, "root").select("fp", "root", "component_id"), "found")
    each = heads.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "head").alias("component_id"))
    return fps.join(each, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: a row per row of docs."""
    return _grouped(docs).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns.

    A group keeps one row with its smallest doc_id, that with the smallest hash
    where several rows have it, as in a group of null doc_ids.
    """
    rows = with_identity(docs)
    grouped = _grouped(rows.select("row.doc_id", "row.text", "row_hash"), "row_hash")
    heads = grouped.where("doc_id <=> component_id").groupBy("root", "doc_id").agg(F.min("row_hash").alias("row_hash"))
    stay = heads.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row_hash")
    # The window finds its rows where the join has put them, so texts are shuffled once.
    copy = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy(F.lit(0)))
    return rows.join(stay, IDENTITY, "left_semi").withColumn("copy", copy).where("copy = 1").select("row.*")


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
