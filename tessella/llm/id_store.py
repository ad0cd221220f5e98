"""Token ids in raw shards with a minimal perfect hash index.

A shard is a file of little-endian unsigned ids, of 16 bits where the
vocabulary has at most 65,536 and else of 32: the ids of its documents one
after another, each followed by the end id, shards and documents in ascending
doc_id order.  The index deals the keys (doc_id and, for repeated
doc_ids, the number of the copy) to buckets by hash.  A bucket is a minimal
perfect hash: cascading bit arrays in which a key that is alone at its place
has a bit, and the rank of the bit is the key's slot.  Slots hold a fingerprint
of the key and the shard, offset and length of its ids, so a key is found or
rejected in constant time.

Defined results: null and empty texts have only the end id; a null doc_id comes
first; repeated doc_ids are copies 0, 1, ... in order of text; texts of any
length are encoded whole; other columns, whatever their names, are ignored; an
empty table gives an index without buckets and no rows.
"""

from __future__ import annotations

import os
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialise, shared_dir, text_or_empty
from tessella.llm.units import Remembering, parts, slices

END = 2
#: Text of a shard: a task remembers what it has encoded, so larger shards encode less anew.
SHARD_BYTES = 64 << 20
#: Shards at most (one row each is sent to every task); beyond that they grow.
SHARDS = 20_000
#: Ids that are read and sent on at a time.
READ_BYTES = 4 << 20
BUCKET_KEYS = 20_000
LEVELS, SPARE = 24, 2


def open_store(uri: str):
    """File system and path of a folder's URI; local, HDFS, S3 and GCS ones are known."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _byte_letters() -> dict[int, int]:
    """Code points that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


def unit_encoder(tokenizer_json: str, pattern: str):
    """Encodes units with the BPE model of the tokenizers library, each distinct pre-token once.

    The pre-tokens are cut here, by the pattern of the tokenizer's byte-level
    pre-tokeniser; the library's own encode() gives the same ids at three times
    the cost (a test holds one against the other).
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tokenize, split, letters = Tokenizer.from_str(tokenizer_json).model.tokenize, regex.compile(pattern).findall, _byte_letters()
    blank = letters[32]

    def piece(p: str) -> bytes:
        return array("I", [t.id for t in tokenize(p)]).tobytes()

    def one(unit: bytes) -> bytes:
        if unit[1:].isalpha() and unit[:1] == b" ":  # ASCII letters after a blank, one pre-token
            return piece(chr(blank) + unit[1:].decode())
        return b"".join([piece(p.encode().decode("latin-1").translate(letters)) for p in split(unit.decode())])

    return lambda units: list(map(one, units))


def text_encoder(tokenizer_json: str, pattern: str, added_tokens: bool):
    """Encodes texts; with added_tokens as the library's encode(text, add_special_tokens=False) does by default.

    The library takes the tokenizer's added tokens out of a text before all else
    and encodes what stands between them on its own.  So does this; where an
    added token asks for more than its characters, texts that hold one go
    through the library.
    """
    encode = Remembering(unit_encoder(tokenizer_json, pattern))
    if not added_tokens:
        return encode
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokenizer_json)
    added = {t.content: (i, t) for i, t in library.get_added_tokens_decoder().items() if t.content}
    if not added:
        return encode
    plain = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for _, t in added.values())
    coded = {c: array("I", [i]).tobytes() for c, (i, _) in added.items()}
    any_of = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))  # the longest first
    cut, held_in = re.compile(f"({any_of})").split, re.compile(any_of.encode()).search

    def one(text: str) -> bytes:
        if not plain:
            return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = cut(text)  # text, token, text, ...
        between = iter(encode(pa.array([p.encode() for p in pieces[::2]], pa.binary())).to_pylist())
        return b"".join(coded[p] if k % 2 else next(between) for k, p in enumerate(pieces))

    def run(texts: pa.Array) -> pa.Array:
        if not held_in(parts(texts)[1]):
            return encode(texts)
        held = [held_in(t) is not None for t in texts.to_pylist()]
        others = iter(encode(pc.if_else(pa.array(held), b"", texts)).to_pylist())
        return pa.array([one(t.decode()) if h else ids for t, h, ids in zip(texts.to_pylist(), held, others, strict=True)], pa.binary())

    return run


def id_width(tokenizer_path: str) -> int:
    """Bytes of an id in the shards."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4


def write_shards(docs: DataFrame, tokenizer_path: str, pattern: str, folder: str, shard_bytes: int = SHARD_BYTES, added_tokens: bool = False) -> DataFrame:
    """Writes the shards; gives doc_id, copy, shard, file, offset, n_tokens of each document.

    added_tokens: the tokenizer's added tokens that stand in a text get their own ids.

    A task that runs again writes a file of another name; the rows of the run
    that Spark commits name the file that counts.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())  # one vocabulary file: bounded
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = id_width(tokenizer_path)
    ordered = rows.repartitionByRange(min(int(size // shard_bytes) + 1, SHARDS), "doc_id").sortWithinPartitions("doc_id", "text")
    kinds = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        encode, kind = text_encoder(tokenizer.value, pattern, added_tokens), f"<u{width}"
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        store, base = open_store(folder)
        before, copy, at, sink = None, 0, 0, None
        for b in batches:
            if sink is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{name}")
            for lo, hi in slices(b.column("text")):
                offsets, coded = parts(encode(b.column("text").slice(lo, hi - lo)))
                sink.write(np.insert(coded.view("<u4"), offsets[1:] // 4, END).astype(kind).tobytes())
                out = []
                for doc_id, n in zip(b.column("doc_id").slice(lo, hi - lo).to_pylist(), (np.diff(offsets) // 4 + 1).tolist(), strict=True):
                    copy = copy + 1 if at and doc_id == before else 0
                    out.append((doc_id, copy, shard, name, at, n))
                    before, at = doc_id, at + n * width
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
        if sink is not None:
            sink.close()

    return materialise(ordered.mapInArrow(run, "doc_id long, copy int, shard int, file string, offset long, n_tokens long"), "catalog")


def _places(keys: np.ndarray, level: int, width: int) -> np.ndarray:
    h = (keys ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((h >> np.uint64(11)) % np.uint64(width)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays by level, and the slot of each key (-1: its hash equals another key's)."""
    slots, left, levels, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), [], 0
    while len(left) and len(levels) < LEVELS:
        width = -(-max(8, SPARE * len(left)) // 8) * 8
        at = _places(keys[left], len(levels), width)
        bits = np.bincount(at, minlength=width) == 1
        alone = bits[at]
        slots[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        levels.append(bits)
        base, left = base + int(bits.sum()), left[~alone]
    return levels, slots


def find_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    slots, left, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        at = _places(keys[left], level, len(bits))
        there = bits[at]
        slots[left[there]] = base + (np.cumsum(bits) - 1)[at[there]]
        base, left = base + int(bits.sum()), left[~there]
    return slots


_INDEX = "bucket int, levels array<binary>, prints binary, shards binary, offsets binary, counts binary, apart array<struct<doc_id long, copy int, shard int, offset long, n_tokens long>>"


def _key(copy: str = "copy"):
    return F.xxhash64("doc_id", F.col(copy).cast("int"))


def build_index(catalog: DataFrame) -> tuple[DataFrame, int]:
    """The index, a row per bucket, and the number of buckets."""
    buckets = int(catalog.count() // BUCKET_KEYS) + 1
    spread = catalog.select("doc_id", "copy", "shard", "offset", "n_tokens", _key().alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(np.uint64)
        levels, slots = perfect_hash(keys)
        order, placed = np.argsort(slots[slots >= 0]), np.flatnonzero(slots >= 0)
        held = [table.column(c).to_numpy()[placed][order] for c in ("shard", "offset", "n_tokens")]
        apart = table.filter(pa.array(slots < 0)).select(["doc_id", "copy", "shard", "offset", "n_tokens"]).to_pylist()
        return pa.Table.from_pydict({
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "levels": pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
            "prints": [fingerprints(keys[placed][order]).astype("<u4").tobytes()], "shards": [held[0].astype("<i4").tobytes()], "offsets": [held[1].astype("<i8").tobytes()],
            "counts": [held[2].astype("<i8").tobytes()],
            "apart": pa.array([apart], pa.list_(pa.struct([("doc_id", pa.int64()), ("copy", pa.int32()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64())]))),
        })

    return materialise(spread.groupBy("bucket").applyInArrow(run, _INDEX), "index"), buckets


def look_up(wanted: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """doc_id, copy, shard, offset, n_tokens of the wanted keys (doc_id, copy) that the index holds."""
    keyed = wanted.select("doc_id", "copy", _key().alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    kinds = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64())])

    def run(keys: pa.Table, held: pa.Table) -> pa.Table:
        if not held.num_rows or not keys.num_rows:
            return kinds.empty_table()
        row = held.to_pylist()[0]
        hashes = keys.column("key").to_numpy().view(np.uint64)
        slots = find_slots([np.unpackbits(np.frombuffer(x, dtype=np.uint8)).astype(bool) for x in row["levels"]], hashes)
        prints = np.frombuffer(row["prints"], dtype="<u4")
        slots[slots >= 0] = np.where(prints[slots[slots >= 0]] == fingerprints(hashes[slots >= 0]), slots[slots >= 0], -1)
        found = slots >= 0
        out = [keys.column("doc_id").filter(pa.array(found)), keys.column("copy").filter(pa.array(found)), *(pa.array(np.frombuffer(row[c], dtype=t)[slots[found]]) for c, t in (("shards", "<i4"), ("offsets", "<i8"), ("counts", "<i8")))]
        table = pa.Table.from_arrays(out, schema=kinds)
        asked = set(zip(keys.column("doc_id").to_pylist(), keys.column("copy").to_pylist(), strict=True)) if row["apart"] else ()
        apart = [x for x in row["apart"] if (x["doc_id"], x["copy"]) in asked]
        return pa.concat_tables([table, pa.Table.from_pylist(apart, schema=kinds)])

    return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(run, "doc_id long, copy int, shard int, offset long, n_tokens long")


def read_ids(found: DataFrame, catalog: DataFrame, folder: str, width: int) -> DataFrame:
    """found with ``ids`` (little-endian unsigned 32-bit) and ``start`` (ids of all documents before), read from the shards, each in order of offset."""
    sizes = catalog.groupBy("shard").agg(F.first("file").alias("file"), F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))  # SHARDS rows at most
    kinds = "doc_id long, copy int, start long, ids binary"
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        store, root = open_store(folder)
        opened, name = None, None
        for b in batches:
            out, size = [], 0
            for r in b.to_pylist():
                if r["file"] != name:
                    name, opened = r["file"], store.open_input_file(f"{root}/{r['file']}")
                ids = np.frombuffer(opened.read_at(r["n_tokens"] * width, r["offset"]), dtype=f"<u{width}").astype("<u4").tobytes()
                out.append((r["doc_id"], r["copy"], r["base"] + r["offset"] // width, ids))
                size += len(ids)
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    placed = found.join(F.broadcast(bases), "shard").repartition("shard").sortWithinPartitions("shard", "offset")
    return placed.select("doc_id", "copy", "base", "file", "offset", "n_tokens").mapInArrow(run, kinds)


def stored(docs: DataFrame, tokenizer_path: str, pattern: str, shard_bytes: int = SHARD_BYTES, added_tokens: bool = False) -> DataFrame:
    """Writes docs to a new store in the shared folder and reads every document back through the index: doc_id, copy, start, ids."""
    folder = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    catalog = write_shards(docs, tokenizer_path, pattern, folder, shard_bytes, added_tokens)
    index, buckets = build_index(catalog)
    copies = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))
    wanted = copies.select("doc_id", F.explode(F.expr("sequence(0, n - 1)")).alias("copy"))
    return read_ids(look_up(wanted, index, buckets), catalog, folder, id_width(tokenizer_path))


def digests(ids: DataFrame) -> DataFrame:
    return ids.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
