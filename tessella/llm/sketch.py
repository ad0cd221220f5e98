"""Document fingerprints by a threshold-scaled sketch.

A text's shingles are its runs of SHINGLE bytes of UTF-8; of their hashes the
sketch keeps every one below a fixed fraction of the range, so sketches grow
with their texts, merge by union, and estimate how much of a small text stands
in a much larger one.

A fingerprint is ``<number of shingles, hex>.<hash of the whole text>.<kept
hashes, 7 hex digits each, ascending>``.

Defined results: null is the empty text; a text shorter than a shingle is one
shingle; where a text keeps no hash its likeness is 1 to a fingerprint of an
equal text and else 0; doc_id null comes first in order, equal doc_ids are
ordered by text; the only document is its own next one; repeated rows each give
a row; texts of any length are hashed whole; other columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import text_or_empty

SHINGLE = 16
#: Hashes are of 32 bits; those below 2^28 (one in 16) are kept.
BITS, KEPT_BITS = 32, 28
#: Text in a range of neighbours, and ranges at most (their first ids, 8 bytes each, are sent to every task).
GROUP_BYTES, GROUPS = 8 << 20, 20_000
FIRST = -(2**63)


def kept_hashes(text: bytes) -> tuple[int, np.ndarray]:
    """Number of shingles, and the sorted kept hashes."""
    data = text.ljust(SHINGLE, b"\0")
    n = len(data) - SHINGLE + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # 8 bytes from every place on
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += words[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h >>= np.uint64(64 - BITS)
    return n, np.unique(h[h < np.uint64(1 << KEPT_BITS)])


def fingerprint(text: bytes) -> tuple[str, np.ndarray, int]:
    n, kept = kept_hashes(text)
    whole = xxhash.xxh64_intdigest(text)
    return f"{n:x}.{whole:016x}.{''.join([f'{x:07x}' for x in kept.tolist()])}", kept, whole


def merged(a: str, b: str) -> str:
    """The fingerprint of two texts taken together (its whole-text hash is that of neither)."""
    (n, w, x), (m, v, y) = a.split("."), b.split(".")
    cut = lambda s: {s[i : i + 7] for i in range(0, len(s), 7)}
    return f"{int(n, 16) + int(m, 16):x}.{int(w, 16) ^ int(v, 16):016x}.{''.join(sorted(cut(x) | cut(y)))}"


def likeness(kept: np.ndarray, whole: int, other: np.ndarray, other_whole: int) -> float:
    """Estimated part of the first text's shingles that stand in the other."""
    if whole == other_whole:
        return 1.0
    return len(np.intersect1d(kept, other, assume_unique=True)) / len(kept) if len(kept) else 0.0


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _firsts(spark: SparkSession, docs: DataFrame, group_bytes: int) -> np.ndarray:
    """The first doc_id of each range of neighbours, GROUPS at most."""
    size = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    ids = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("id")).repartitionByRange(min(int(size // group_bytes) + 1, GROUPS), "id")
    return np.array(sorted(r[0] for r in ids.groupBy(F.spark_partition_id()).agg(F.min("id").alias("id")).select("id").collect()), dtype=np.int64)


def neighbours_fingerprinted(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt to ranges of neighbouring ids; the first document of a
    range goes to the range before it too, so the text moves once.  A task reads
    its ranges in order and holds two documents at a time.
    """
    spark = docs.sparkSession
    firsts = spark.sparkContext.broadcast(_firsts(spark, docs, group_bytes))

    @F.pandas_udf("array<int>")
    def groups(id_: pd.Series) -> pd.Series:
        known, ids = firsts.value, id_.to_numpy()
        at = np.searchsorted(known, ids, side="right") - 1
        return pd.Series([[g, (g - 1) % len(known)] if first else [g] for g, first in zip(at.tolist(), (known[at] == ids).tolist(), strict=True)])

    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(FIRST)).alias("id"), text_or_empty().alias("text"))
    dealt = rows.select("doc_id", "id", "text", F.posexplode(groups("id")).alias("carried", "grp"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)))

    def run(batches):
        grp, before, out = None, None, []

        def pair(row, after):
            (id_, text, mine), (_, following, theirs) = row, after
            changed = edited(text, following).encode()
            new = fingerprint(changed)
            return id_, len(text), hashlib.sha256(changed).hexdigest(), mine[0], new[0], likeness(*mine[1:], *new[1:]), likeness(*mine[1:], *theirs[1:])

        for b in batches:
            for own, carried, id_, text in zip(*(b.column(c).to_pylist() for c in ("grp", "carried", "doc_id")), b.column("text"), strict=True):
                text = text.as_py()
                now = None if carried and (own != grp or before is None) else (id_, text, fingerprint(text.encode()))
                if own == grp and before is not None and now is not None:
                    out.append(pair(before, now))
                # Of the carried documents, which come last and may share a doc_id, only the first follows one.
                grp, before = own, None if carried else now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
                out = []

    ranged = dealt.repartition(max(1, len(firsts.value)), "grp").sortWithinPartitions("grp", "carried", "id", "text")
    return ranged.select("grp", "carried", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
