"""Mixing sources to target weights by fixed-length blocks of words.

The words of each source, documents in doc_id order, form one stream that is
cut into blocks of ``block`` words (the last may be shorter).  Every output
shard draws how many of its slots each source fills from a multinomial over
what the sources still have to give.  The slots of a source are numbered
through the shards; slot j takes the block at place j of a pseudorandom
permutation of the source's blocks, and a new permutation begins when all
blocks have been taken once.  Blocks and slots then meet by index.

Defined results: a null or empty text has no words and is never taken; a null
source is a source of its own, last in order; a source takes part with at most
``limit`` times its words, so each block is taken at most ``limit`` times;
repeated rows are documents of their own, also those that share a doc_id; a null
doc_id comes first in its source; texts of any length are counted and cut
whole; other columns, whatever their names, are carried by mixed_documents and
ignored elsewhere; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import IDENTITY, WORD, materialise, parts_of, running_total, text_or_empty, with_identity
from tessella.llm.units import slices

BLOCK = 128
SHARDS = 64
SEED = 20_240_917
#: Slots that one row of the plan is spread over at a time.
RUN = 1 << 16
#: Sources up to which their table (some 60 bytes each) is sent to every task.
BROADCAST_SOURCES = 100_000
#: Small tables made by the driver, as Arrow: rows of Python objects would pass through Python workers of their own.
PLAN = pa.schema([("shard", pa.int32()), ("src", pa.int32()), ("begin", pa.int64()), ("n", pa.int64()), ("blocks", pa.int64())])
KNOWN = pa.schema([("src", pa.int32()), ("source", pa.string()), ("first", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64())])


def targets(sizes: list[int], weights: list[float], share: float, limit: float) -> list[float]:
    """Words to take from each source: by weight, at most limit x size, the excess shared again."""
    left, weight, out = share * sum(sizes), sum(weights), [0.0] * len(sizes)
    # The source that reaches its limit first comes first; from the first that doesn't on, none does.
    for i in sorted(range(len(sizes)), key=lambda i: limit * sizes[i] / weights[i]):
        out[i] = min(left * weights[i] / weight, float(limit * sizes[i]))
        left, weight = left - out[i], weight - weights[i]
    return out


def draw_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: multinomial counts that use up exactly ``slots`` in all."""
    rng, left, out = np.random.default_rng(seed), np.array(slots, dtype=np.int64), []
    for k in range(shards):
        want, got = int(left.sum()) // (shards - k), np.zeros(len(left), dtype=np.int64)
        while want > 0:  # what a source can't give is drawn again from the others
            one = np.minimum(rng.multinomial(want, left / left.sum()), left)
            got, left, want = got + one, left - one, want - int(one.sum())
        out.append(got)
    return np.array(out, dtype=np.int64).reshape(shards, len(slots))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index in a pseudorandom permutation of range(size): a Feistel network with cycle walking."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask, out = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            x, m, h, k = out[todo], mask[todo], half[todo], key[todo].astype(np.uint64)
            left, right = x >> h, x & m
            for r in range(4):
                f = (right + k + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f >> np.uint64(32)) & m)
            out[todo] = (left << h) | right
            todo = out >= size.astype(np.uint64)
    return out.astype(np.int64)


def _streams(docs: DataFrame, *key: str) -> DataFrame:
    """doc_id, source, size, key, and all_before: words before this document, sources in order."""
    sizes = docs.select("doc_id", "source", *key, F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))
    return materialise(running_total(sizes, [F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("size"), *map(F.col, key)], "size", "all_before"), "streams")


def _sources(streams: DataFrame, weights: list[float], share: float, limit: int, block: int) -> list[dict]:
    """One entry per source: its number, first word, size, target, blocks and slots."""
    rows = streams.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row per source
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, limit)
    out, first = [], 0
    for i, (r, target) in enumerate(zip(rows, wanted, strict=True)):
        blocks = -(-r["size"] // block)
        slots = min(limit * blocks, round(target * blocks / r["size"])) if r["size"] else 0
        out.append({"src": i, "source": r.source, "first": first, "source_size": r["size"], "target": target, "blocks": blocks, "slots": slots})
        first += r["size"]
    return out


def slots(spark, sources: list[dict], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """shard, src, block: one row for each slot of the mixture."""
    counts = draw_counts([s["slots"] for s in sources], shards, seed)
    begin = counts.cumsum(axis=0) - counts
    plan = [{"shard": k, "src": s["src"], "begin": int(begin[k, i]), "n": int(counts[k, i]), "blocks": s["blocks"]} for k in range(shards) for i, s in enumerate(sources) if counts[k, i]]
    plan = spark.createDataFrame(pa.Table.from_pylist(plan, PLAN))

    def place(batches):
        for b in batches:
            src, slot, blocks = (b.column(c).to_numpy() for c in ("src", "slot", "blocks"))
            key = (np.uint64(seed) * np.uint64(1_000_003)) ^ (src.astype(np.uint64) << np.uint64(20)) ^ (slot // blocks).astype(np.uint64)
            block = pa.array(permuted(slot % blocks, blocks, key), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("src"), b.column("slot"), block], names=["shard", "src", "slot", "block"])

    runs = plan.withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})"))).repartition(parts_of(spark), "shard", "src", "run")
    each = runs.select("shard", "src", "blocks", F.explode(F.expr(f"sequence(begin + run * {RUN}, begin + least(n, (run + 1) * {RUN}) - 1)")).alias("slot"))
    # Not a UDF: filters on block, which joins infer, would evaluate it once more in a second Python worker of each task.
    return each.mapInArrow(place, "shard int, src int, slot long, block long")


def block_uses(docs: DataFrame, *key: str, weights=(3, 1, 2), share=1.5, limit=2, block=BLOCK, shards=SHARDS, seed=SEED) -> DataFrame:
    """A row per document and block it has words in: doc_id, source, size, source_size, target, all_before, from_word, words, uses.

    from_word: first word of the document in that block (0 is the first of the
    document); uses: how often the mixture takes the block.  The columns of key
    are carried.
    """
    spark, streams = docs.sparkSession, _streams(docs, *key)
    sources = _sources(streams, list(weights), share, limit, block)
    known = spark.createDataFrame(pa.Table.from_pylist([{c: s[c] for c in KNOWN.names} for s in sources], KNOWN))
    taken = slots(spark, sources, shards, seed).groupBy("src", "block").agg(F.count("*").alias("uses"))
    placed = streams.join(F.broadcast(known) if len(sources) <= BROADCAST_SOURCES else known, streams.source.eqNullSafe(known.source)).drop(known.source).withColumn("start", F.col("all_before") - F.col("first"))
    cut = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))))
    lo, hi = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    # Spark's estimate of taken doesn't see the explode in it, so it must be told to shuffle.
    return cut.join(taken.hint("merge"), ["src", "block"], "left").select(
        "doc_id", *key, "source", "size", "source_size", "target", "all_before", (lo - F.col("start")).alias("from_word"), F.coalesce(hi - lo, F.lit(0)).alias("words"), F.coalesce("uses", F.lit(0)).alias("uses")
    )


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    uses = block_uses(docs, **options)
    return (
        uses.groupBy("doc_id", "all_before", "size", "source_size", "target", "source").agg(F.sum(F.col("words") * F.col("uses")).cast("long").alias("taken"), F.count("*").alias("_n"))
        .withColumn("_same", F.when(F.col("size") == 0, F.col("_n")).otherwise(1))
        .withColumn("_row", F.explode(F.expr("sequence(1L, _same)")))
        .select("doc_id", "size", "source_size", "target", "taken", "source")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: what each turn takes of a document, its words joined by one space.

    A document whose blocks are all taken twice gives two rows, one that is not
    taken gives none.  n_chars is counted anew, other columns are carried.
    Parts find their row by doc_id and a hash of the row; of equal rows one
    takes the parts of all.
    """
    rows, names = with_identity(docs), docs.columns
    uses = block_uses(rows.select("row.doc_id", "row.source", "row.text", *IDENTITY), *IDENTITY, **options).where("uses > 0")
    turns = uses.withColumn("turn", F.explode(F.expr("sequence(1L, uses)")))
    parts = turns.groupBy(*IDENTITY, "all_before", "turn").agg(F.sort_array(F.collect_list(F.struct("from_word", "words"))).alias("parts"))
    # The join finds its rows where the window has put them, so texts are shuffled once.
    copy = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy(F.lit(0)))
    joined = rows.withColumn("copy", copy).where("copy = 1").join(parts, IDENTITY).select("row", "parts")

    def cut(batches):
        for whole in batches:
            text = whole.column("row").field("text")
            for lo, hi in slices(pc.fill_null(text.cast(pa.binary()), b"")):
                b = whole.slice(lo, hi - lo)
                texts, row = [], dict(zip(names, b.column("row").flatten(), strict=True))
                for t, spans in zip(row["text"], b.column("parts"), strict=True):
                    words = (t.as_py() or "").encode().split()
                    texts.append(b" ".join([w for s in spans.as_py() for w in words[s["from_word"] : s["from_word"] + s["words"]]]).decode())
                new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else row[c] for c in names], names=names)

    # In Python: an array function over the words of a text would split it anew for each span.
    return joined.mapInArrow(cut, T.StructType([T.StructField(f.name, T.LongType()) if f.name == "n_chars" else f for f in docs.schema]))
