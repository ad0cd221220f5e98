"""Substring deduplication by super-k-mers.

A window is WINDOW consecutive words.  Its minimiser is the least hash of the
runs of GRAM words in it, so equal windows have equal minimisers, and
consecutive windows mostly share one: such a stretch (a super-k-mer) travels as
one packed string of its words to the bucket of its minimiser, where sorting
the windows shows in which documents each one starts.

1. Every document lists its minimisers; those that stand in one document only
   can't belong to a repeated window.
2. Documents with shared minimisers send the stretches of those; equal strings
   collapse to the smallest doc_id before and in the bucket.  A minimiser that
   stands in very many documents sends its windows one by one to buckets dealt
   by window, so no bucket gathers it whole.
3. Buckets sort the windows of each minimiser and tell, by string, which ones
   start in a smaller doc_id.  The documents that sent the string remove those
   words.

Texts are compared as bytes in the buckets; hashes only deal them out.

Defined results: null and empty texts have no words; a null doc_id counts as
larger than all others; rows with the same doc_id never remove words from each
other; documents under WINDOW words keep everything; texts of any length are
read whole; other columns, whatever their names, are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise, text_or_empty

WINDOW = 50
GRAM = 12
#: Documents of one minimiser above which its windows are dealt out one by one.
HOT = 2000
#: Strings in a bucket, about.
BUCKET = 4000
#: Bytes of strings that a task holds to collapse equal ones.
COLLAPSED = 16 << 20
LAST = 2**63 - 1

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; base is odd."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    one = np.ones(n, dtype=np.uint64)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = base, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of the words, grams and windows of texts; keeps the powers it needs."""

    def __init__(self):
        self._tables = {}

    def _table(self, n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        if len(self._tables.get(base, ((),))[0]) < n:
            self._tables[base] = _powers(max(n, 1 << 16), base)
        up, down = self._tables[base]
        return up[:n], down[:n]

    def _runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
        """Hash of values[start:end] for each pair, by differences of prefix sums."""
        up, down = self._table(len(values) + 1, base)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:-1], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * down[starts])

    def words(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, dtype=np.uint8)
        edge = np.diff(np.concatenate([[True], _BLANK[data], [True]]).astype(np.int8))
        return self._runs(data.astype(np.uint64) + np.uint64(1), np.flatnonzero(edge == -1), np.flatnonzero(edge == 1), _BASE)

    def grams(self, words: np.ndarray, size: int) -> np.ndarray:
        at = np.arange(len(words) - size + 1)
        return self._runs(words, at, at + size, _WORD)

    def minimisers(self, words: np.ndarray) -> np.ndarray:
        """The minimiser of every window, as signed numbers; empty where there is none."""
        if len(words) < WINDOW:
            return np.zeros(0, dtype=np.int64)
        least, reach, need = self.grams(words, GRAM), 1, WINDOW - GRAM + 1
        while reach * 2 <= need:
            least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
        if need > reach:
            least = np.minimum(least[: len(least) - (need - reach)], least[need - reach :])
        return least.view(np.int64)


def stretches(minimisers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(minimiser, first window, windows) of each run of windows that share one."""
    if len(minimisers):
        first = np.concatenate([[0], np.flatnonzero(np.diff(minimisers)) + 1])
        yield from zip(minimisers[first].tolist(), first.tolist(), np.diff(np.append(first, len(minimisers))).tolist(), strict=True)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, ord, key, text: ord orders documents, ord and key name a row (equal rows share them)."""
    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text_or_empty()).alias("key"), text_or_empty().cast("binary").alias("text")
    )


def _overview(rows: DataFrame) -> DataFrame:
    """A row per row: doc_id, ord, key, n_words, whole_sha256, minimisers (distinct)."""

    def run(batches):
        hasher = Hasher()
        for b in batches:
            n, sha, least = [], [], []
            for text in b.column("text").to_pylist():
                words = text.split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                least.append(np.unique(hasher.minimisers(hasher.words(text))) if len(words) >= WINDOW else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("ord"), b.column("key"), pa.array(n, pa.int64()), pa.array(sha), pa.array(least, pa.list_(pa.int64()))],
                names=["doc_id", "ord", "key", "n_words", "whole_sha256", "minimisers"],
            )

    return rows.mapInArrow(run, "doc_id long, ord long, key long, n_words long, whole_sha256 string, minimisers array<long>")


def _sent(text: bytes, wanted: dict[int, int], hasher: Hasher) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(minimiser, part, first window, windows, packed words) of what a document sends."""
    split, words = text.split(), hasher.words(text)
    windows = None
    for least, first, n in stretches(hasher.minimisers(words)):
        parts = wanted.get(least)
        if parts == 1:
            yield least, 0, first, n, b" ".join(split[first : first + n + WINDOW - 1])
        elif parts:
            windows = hasher.grams(words, WINDOW) if windows is None else windows
            for i in range(first, first + n):
                yield least, int(windows[i] % np.uint64(parts)), i, 1, b" ".join(split[i : i + WINDOW])


def _digest(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def _strings(senders: DataFrame) -> DataFrame:
    """least, part, packed, low, high: strings sent, with the range of ord, collapsed some MB at a time."""

    def batch(held: dict[tuple, list]) -> pa.RecordBatch:
        rows = [(*key, *range_) for key, range_ in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STRING.types, strict=True)], schema=_STRING)

    def run(batches):
        hasher, held, size = Hasher(), {}, 0
        for b in batches:
            for ord_, text, wanted in zip(b.column("ord"), b.column("text"), b.column("wanted"), strict=True):
                ord_ = ord_.as_py()
                for least, part, _, _, packed in _sent(text.as_py(), {w["least"]: w["parts"] for w in wanted.as_py()}, hasher):
                    range_ = held.get((least, part, packed))
                    if range_ is None:
                        held[least, part, packed] = [ord_, ord_]
                        size += len(packed)
                    else:
                        range_[0], range_[1] = min(range_[0], ord_), max(range_[1], ord_)
                if size > COLLAPSED:
                    yield batch(held)
                    held, size = {}, 0
        if held:
            yield batch(held)

    return senders.mapInArrow(run, "least long, part int, packed binary, low long, high long")


_STRING = pa.schema([("least", pa.int64()), ("part", pa.int32()), ("packed", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])
_VERDICT = pa.schema([("digest", pa.binary()), ("low", pa.int64()), ("own", pa.list_(pa.int32()))])


def _judge(table: pa.Table) -> pa.Table:
    """digest, low, own for each string of a bucket that repeats something.

    A document above low repeats the whole string; in the document low itself
    the windows ``own`` start in a smaller one.
    """
    groups: dict[tuple, dict[bytes, list]] = {}
    for least, part, packed, low, high in zip(*(table.column(n).to_pylist() for n in _STRING.names), strict=True):
        range_ = groups.setdefault((least, part), {}).setdefault(packed, [low, high])
        range_[0], range_[1] = min(range_[0], low), max(range_[1], high)
    out = []
    for strings in groups.values():
        own: dict[int, list[int]] = {}
        if len(strings) > 1:
            windows = []
            for s, (packed, (low, _)) in enumerate(strings.items()):
                at = np.concatenate([[0], np.flatnonzero(np.frombuffer(packed, dtype=np.uint8) == 32) + 1, [len(packed) + 1]]).tolist()
                windows += [(packed[at[i] : at[i + WINDOW] - 1], low, s, i) for i in range(len(at) - WINDOW)]
            windows.sort()
            before, first = None, 0
            for window, low, s, i in windows:
                if window != before:
                    before, first = window, low
                elif first < low:
                    own.setdefault(s, []).append(i)
        out += [(_digest(p), low, sorted(own.get(s, []))) for s, (p, (low, high)) in enumerate(strings.items()) if high > low or s in own]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, _VERDICT.types, strict=True)], schema=_VERDICT)


def _places(senders: DataFrame) -> DataFrame:
    """ord, key, first, n, digest: where each string stands."""
    kinds = pa.schema([("ord", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])

    def run(batches):
        hasher = Hasher()
        for b in batches:
            out = [[], [], [], [], []]
            for ord_, key, text, wanted in zip(*(b.column(c).to_pylist() for c in ("ord", "key", "text", "wanted")), strict=True):
                for _, _, first, n, packed in _sent(text, {w["least"]: w["parts"] for w in wanted}, hasher):
                    for column, value in zip(out, (ord_, key, first, n, _digest(packed)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds.types, strict=True)], schema=kinds)

    return senders.mapInArrow(run, "ord long, key long, first int, n int, digest binary").distinct()


def _without(senders: DataFrame) -> DataFrame:
    """ord, key, n_removed, kept: what is left of texts whose windows in ``spans`` repeat."""
    kinds = pa.schema([("ord", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for b in batches:
            n, kept = [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = text.split()
                stay = np.ones(len(words), dtype=bool)
                for s in spans:
                    stay[s["at"] : s["at"] + s["n"] + WINDOW - 1] = False
                kept.append(b" ".join([w for w, k in zip(words, stay.tolist(), strict=True) if k]))
                n.append(len(words) - int(stay.sum()))
            yield pa.RecordBatch.from_arrays([b.column("ord"), b.column("key"), pa.array(n, pa.int64()), pa.array(kept, pa.binary())], schema=kinds)

    return senders.mapInArrow(run, "ord long, key long, n_removed long, kept binary")


def repeats_removed(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(overview, changed): a row per row of docs, and ord, key, n_removed, kept of those that lose words."""
    rows = _keyed(docs)
    overview = materialise(_overview(rows), "overview")
    lists = overview.select("ord", "key", F.explode("minimisers").alias("least")).distinct()
    shared = (
        lists.groupBy("least").agg(F.min("ord").alias("low"), F.max("ord").alias("high"), F.count("*").alias("n"))
        # A document has as many windows of a minimiser as there are places for it in one.
        .where("low < high").select("least", F.when(F.col("n") <= hot, 1).otherwise(F.ceil(F.col("n") * (WINDOW - GRAM + 1) / hot)).cast("int").alias("parts"))
    )
    wanted = lists.join(shared.hint("merge"), "least").groupBy("ord", "key").agg(F.collect_list(F.struct("least", "parts")).alias("wanted"))
    senders = materialise(rows.join(wanted, ["ord", "key"]).select("ord", "key", "text", "wanted").dropDuplicates(["ord", "key"]), "senders")
    # Windows of hot minimisers are strings of their own.
    n = senders.agg(F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda s, w: s + F.when(w.parts > 1, WINDOW - GRAM).otherwise(1)))).first()[0] or 0
    buckets = int(n // BUCKET) + 1
    bucket = F.pmod(F.xxhash64("least", "part"), F.lit(buckets))
    judged = _strings(senders).groupBy(bucket.alias("bucket")).applyInArrow(_judge, "digest binary, low long, own array<int>")
    verdicts = materialise(judged, "verdicts")
    at = F.when(F.col("ord") > F.col("low"), F.array(F.struct(F.col("first").alias("at"), F.col("n").alias("n")))).otherwise(
        F.transform("own", lambda i: F.struct((F.col("first") + i).alias("at"), F.lit(1).alias("n")))
    )
    spans = _places(senders).join(verdicts.hint("merge"), "digest").select("ord", "key", F.explode(at).alias("span")).groupBy("ord", "key").agg(F.collect_list("span").alias("spans"))
    return overview, _without(senders.join(spans.hint("merge"), ["ord", "key"]).select("ord", "key", "text", "spans"))


def summary(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    overview, changed = repeats_removed(docs, hot)
    changed = changed.select("ord", "key", "n_removed", F.sha2("kept", 256).alias("sha"))
    return overview.join(changed, ["ord", "key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "whole_sha256").alias("kept_sha256")
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS j FROM repeats, range(50) r(k)
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.j) AS text FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w) e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY e.doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
