"""Language-model scoring: subword lattice likelihood.

The vocabulary is that of an existing tokenizer, pieces of bytes with scores.
The scores weight all segmentations of a word into pieces: a forward recursion
over its bytes, in log space, sums their products to the word's marginal
probability.  Scores of a unigram vocabulary are logs of probabilities and
weight as they are (scores="log", made to sum to 1); those of a merge
vocabulary only order the pieces, and the order gives the weights
(scores="rank").  Rounds of expectation-maximisation over the training words
may follow; rounds=0 leaves the vocabulary's own weights.  With whole_words,
words of the training texts are pieces of the lattice too: a share of each
count (absolute discounting) goes to the segmented part, so a seen word keeps
its own evidence and an unseen one has the sum over its segmentations.
Without, the lattice of pieces alone gives each word's probability.

Training texts are learned by language, each with probabilities of its own.  A
text's probability is the marginal over segmentations and over the language,
which scoring takes as unknown; a text is its words and its end.  Words are
lower-cased (A-Z) and stand with one blank before them, as pieces do.

How it runs: a task turns some MB of text at a time into a block, a dictionary
of the words in it and each document's counts by dictionary number.  Dictionary
entries meet by word, where counts add up and each distinct word is segmented
once; with their scores they return to their blocks, where documents are scored
by sums over arrays.  Text itself is never shuffled.

Defined results: null and empty texts are an end only; texts of null and rarer
languages are learned as one more language; without training texts the
segmented part has all the weight; repeated rows are documents of their own; a
null doc_id counts as held in; texts and words of any length are read whole (a
word takes 8 bytes of memory for each of its own, 16 where it is learned from);
other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise, text_or_empty

#: Text that makes a block, in bytes.
BLOCK_BYTES = 32 << 20
#: Rounds of expectation-maximisation.
ROUNDS = 3
#: A language with at least one in so many training texts is learned apart.
LANGUAGE_SHARE = 64
#: Cells (words x bytes) that are worked on at a time, and words that are gathered for it.
CELLS, GATHERED = 1 << 18, 1 << 16
#: Bytes of a word up to which a matrix holds words of one length; longer ones of near lengths share one.
SHORT = 24
#: Bytes of a word above which its places are worked through in windows, each of WINDOW places.
LONG, WINDOW = 2048, 1 << 15
#: The end of a text, a token that no word can be.
END = b" "
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SLOT_BITS = 20


def read_pieces(model_path: str) -> dict[bytes, float]:
    """Pieces that can stand in a lower-cased word with a blank before it, with their scores; all single bytes are there."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        if raw == raw.lower() and not any(b in raw[1:] for b in b" \t\n\v\f\r"):
            found[raw] = max(found.get(raw, -math.inf), float(model.get_score(i)))
    low = min(found.values(), default=0.0)
    return found | {bytes([b]): low for b in range(256) if bytes([b]) not in found}


def first_guess(pieces: dict[bytes, float], scores: str = "rank") -> np.ndarray:
    """Natural logs of piece probabilities: the scores themselves ("log"), or by their rank, where they only order the pieces ("rank")."""
    if scores not in ("rank", "log"):
        raise ValueError(f"scores are 'rank' or 'log', not {scores!r}")
    log = np.array(list(pieces.values()))
    if scores == "rank":
        log = -np.log(np.argsort(np.argsort(-log, kind="stable")) + 10.0)
    return log - np.logaddexp.reduce(log)


def _log_sum(row: np.ndarray, ways: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Logs of sums into row: of the exponentials of all ways to its places, by the greatest, so that none leaves a double's range."""
    for at, way in ways:
        row[at] = np.maximum(row[at], way)
    top, total = np.where(np.isneginf(row), 0.0, row), np.zeros(len(row))
    for at, way in ways:
        total[at] += np.exp(way - top[at])
    with np.errstate(divide="ignore"):
        row[:] = top + np.log(total)


class Lattice:
    """The pieces, with natural logs of their probabilities in one or more models (rows of logs).

    Matrices of words are flat, places first: cell ``place * n + word``.  The
    pieces of each length are listed once for all models, as the cells where one
    begins and its number.
    """

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        sizes = np.array(list(map(len, pieces)))
        self.longest, self.sizes = int(sizes.max()), np.unique(sizes).tolist()
        self.logs = np.atleast_2d(np.asarray(logs, dtype=float))
        # Eight bytes from the places 0, 8, ... and from the last that has eight: together the whole piece.
        self._eights: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._slots = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
        for size in self.sizes:
            own = np.flatnonzero(sizes == size)
            data = np.frombuffer(b"".join([pieces[i] for i in own]), dtype=np.uint8).reshape(len(own), size)
            packed = self._packed(data)
            keys = np.stack([self._key(packed, size, at, len(own)) for at in self._parts(size)])
            order = np.full(len(pieces), -1)
            order[own] = np.arange(len(own))
            self._eights[size] = keys, order
            for i, slot in zip(own.tolist(), self._slot(keys, size).tolist(), strict=True):
                while self._slots[slot] >= 0:
                    slot = (slot + 1) % len(self._slots)
                self._slots[slot] = i

    @staticmethod
    def _parts(size: int) -> list[int]:
        return [0] if size <= 8 else [*range(0, size - 8, 8), size - 8]

    @staticmethod
    def _packed(data: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, places first; zeros follow a word."""
        n, width = data.shape
        x = np.zeros((width + 7, n), dtype=np.uint64)
        x[:width] = data.T
        for shift in (1, 2, 4):
            x = (x[:-shift] << np.uint64(8 * shift)) | x[shift:]
        return x

    @staticmethod
    def _key(packed: np.ndarray, size: int, part: int, n: int) -> np.ndarray:
        places = len(packed) - size + 1
        return (packed[part : part + places] >> np.uint64(max(0, 64 - 8 * size))).reshape(-1)

    @staticmethod
    def _slot(keys: np.ndarray, size: int) -> np.ndarray:
        h = keys[0] * _BASE if len(keys) == 1 else (keys[0] * _STEP ^ keys[-1]) * _BASE
        return ((h + np.uint64(size * int(_STEP) % 2**64)) * _BASE >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _arcs(self, data: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, cells, pieces): where pieces of each length stand, cells ascending."""
        n, width = data.shape
        packed, out = self._packed(data), []
        for size in self.sizes:
            if size > width:
                break
            known, order = self._eights[size]
            keys = [self._key(packed, size, part, n) for part in self._parts(size)]
            slot = self._slot(keys, size)
            ask = np.flatnonzero(self._slots[slot] >= 0)
            cells, pieces, at = [], [], slot[ask]
            while len(ask):
                piece = self._slots[at]
                own = order[piece]  # -1: of another length, or an empty slot
                same = (own >= 0) & (piece >= 0)
                for k, key in enumerate(keys):
                    same &= known[k][own] == key[ask]
                cells.append(ask[same])
                pieces.append(piece[same])
                on = ~same & (piece >= 0)
                ask, at = ask[on], (at[on] + 1) % len(self._slots)
            if cells and sum(map(len, cells)):
                cell, piece = np.concatenate(cells), np.concatenate(pieces)
                if len(cells) > 1:
                    way = np.argsort(cell, kind="stable")
                    cell, piece = cell[way], piece[way]
                out.append((size, cell, piece))
        return out

    def _forward(self, arcs: list, model: int, n: int, width: int) -> np.ndarray:
        """Natural logs, places first: of the sum over all segmentations of what stands before each place."""
        alpha = np.full((width + 1) * n, -np.inf)
        alpha[:n] = 0.0
        score = [self.logs[model][piece] for _, _, piece in arcs]
        bounds = [np.searchsorted(cell, np.arange(width + 1) * n).tolist() for _, cell, _ in arcs]
        for end in range(1, width + 1):
            ways = []
            for (size, cell, _), p, bound in zip(arcs, score, bounds, strict=True):
                begin = end - size
                if begin < 0:
                    break
                lo, hi = bound[begin], bound[begin + 1]
                if hi > lo:
                    ways.append((cell[lo:hi] - begin * n, alpha[cell[lo:hi]] + p[lo:hi]))
            _log_sum(alpha[end * n : (end + 1) * n], ways)
        return alpha

    def _backward(self, arcs: list, model: int, n: int, width: int, sizes: np.ndarray) -> np.ndarray:
        """The same of what stands from each place to its word's end."""
        beta = np.full((width + 1) * n, -np.inf)
        score = [self.logs[model][piece] for _, _, piece in arcs]
        bounds = [np.searchsorted(cell, np.arange(width + 1) * n).tolist() for _, cell, _ in arcs]
        for begin in range(width, -1, -1):
            ways = []
            for (size, cell, _), p, bound in zip(arcs, score, bounds, strict=True):
                lo, hi = bound[begin], bound[min(begin + 1, width)]
                if hi > lo:
                    ways.append((cell[lo:hi] - begin * n, beta[cell[lo:hi] + size * n] + p[lo:hi]))
            row = beta[begin * n : (begin + 1) * n]
            _log_sum(row, ways)
            row[sizes == begin] = 0.0
        return beta

    def batches(self, words: list[bytes]):
        """(places in words, matrix of bytes, lengths) for words of up to LONG bytes and near length, zeros after the shorter ones."""
        sizes = np.array(list(map(len, words)), dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= LONG]
        i = 0
        while i < len(order):
            least = int(sizes[order[i]])
            widest = least if least <= SHORT else least + least // 4
            some = order[i : i + max(1, CELLS // widest)]
            some = some[: int(np.searchsorted(sizes[some], widest, side="right"))]
            own, width = sizes[some], int(sizes[some[-1]])
            data = np.zeros((len(some), width), dtype=np.uint8)
            data[np.arange(width) < own[:, None]] = np.frombuffer(b"".join([words[j] for j in some]), dtype=np.uint8)
            yield some, data, own
            i += len(some)

    def _own_arcs(self, data: np.ndarray, sizes: np.ndarray) -> list:
        """The arcs that end within each word."""
        n, width = data.shape
        arcs = self._arcs(data)
        if sizes[0] == width:
            return arcs
        out = []
        for size, cell, piece in arcs:
            own = cell // n + size <= sizes[cell % n]
            out.append((size, cell[own], piece[own]))
        return out

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """models x words: natural log of the sum over all segmentations of each word (with its blank)."""
        out = np.zeros((len(self.logs), len(words)))
        for places, data, sizes in self.batches(words):
            n, width = data.shape
            arcs, last = self._own_arcs(data, sizes), sizes * n + np.arange(n)
            for k in range(len(self.logs)):
                out[k, places] = self._forward(arcs, k, n, width)[last]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[:, i] = [self._long(w, k)[-1] for k in range(len(self.logs))]
        return out

    def expected(self, words: list[bytes], model: int = 0) -> np.ndarray:
        """Expected uses of each piece over the segmentations of the words, each word once."""
        total = np.zeros(self.logs.shape[1])
        for _, data, sizes in self.batches(words):
            n, width = data.shape
            arcs, last = self._own_arcs(data, sizes), sizes * n + np.arange(n)
            alpha, beta = self._forward(arcs, model, n, width), self._backward(arcs, model, n, width, sizes)
            whole = alpha[last]
            for size, cell, piece in arcs:
                use = np.exp(alpha[cell] + self.logs[model][piece] + beta[cell + size * n] - whole[cell % n])
                total += np.bincount(piece, weights=use, minlength=len(total))
        for w in words:
            if len(w) > LONG:
                total += self._long_uses(w, model)
        return total

    def _windows(self, word: bytes) -> list[int]:
        return list(range(0, len(word), WINDOW))

    def _window_arcs(self, word: bytes, first: int) -> tuple[list[int], list[int], list[int]]:
        """Begins, ends and pieces of the arcs that end in (first, first + WINDOW], by end."""
        low, high = max(0, first + 1 - self.longest), min(len(word), first + WINDOW)
        arcs = self._arcs(np.frombuffer(word[low:high], dtype=np.uint8)[None, :])
        begin, size = np.concatenate([c for _, c, _ in arcs]) + low, np.concatenate([np.full(len(c), s) for s, c, _ in arcs])
        piece, end = np.concatenate([p for _, _, p in arcs]), begin + size
        own = np.flatnonzero(end > first)
        own = own[np.argsort(end[own], kind="stable")]
        return begin[own].tolist(), end[own].tolist(), piece[own].tolist()

    def _long(self, word: bytes, model: int) -> array:
        """Logs of alpha at each place of a very long word; the pieces of one window are held at a time."""
        logs, alpha = self.logs[model].tolist(), array("d", [-math.inf]) * (len(word) + 1)
        alpha[0] = 0.0
        for first in self._windows(word):
            for begin, end, piece in zip(*self._window_arcs(word, first), strict=True):
                way, now = alpha[begin] + logs[piece], alpha[end]
                alpha[end] = way if now == -math.inf else max(way, now) + math.log1p(math.exp(-abs(way - now)))
        return alpha

    def _long_uses(self, word: bytes, model: int) -> np.ndarray:
        alpha, logs, total = self._long(word, model), self.logs[model].tolist(), [0.0] * self.logs.shape[1]
        beta = array("d", [-math.inf]) * (len(word) + 1)
        beta[-1] = 0.0
        for first in reversed(self._windows(word)):
            for begin, end, piece in zip(*(reversed(x) for x in self._window_arcs(word, first)), strict=True):
                way, now = beta[end] + logs[piece], beta[begin]
                total[piece] += math.exp(alpha[begin] + way - alpha[-1])
                beta[begin] = way if now == -math.inf else max(way, now) + math.log1p(math.exp(-abs(way - now)))
        return np.array(total)


def trains(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 != 2, F.lit(True))


def _languages(docs: DataFrame) -> tuple[list[str], int]:
    """The languages of one in LANGUAGE_SHARE training texts and more, and the number of models: one more where other texts (or none) are there."""
    counted = docs.where(trains()).rollup("lang").agg(F.count("*").alias("n"), F.grouping_id().alias("all"))
    # The first row counts all texts; so few languages have that share that the limit loses none.
    first = counted.orderBy(F.desc("all"), F.desc("n"), "lang").limit(LANGUAGE_SHARE + 1).collect()
    total = sum(r.n for r in first if r["all"])
    known = [r for r in first if not r["all"] and r.lang is not None and r.n * LANGUAGE_SHARE >= total]
    return [r.lang for r in known], len(known) + (sum(r.n for r in known) < total or not known)


def _block_schema(models: int) -> tuple[pa.Schema, str]:
    """Fields of documents, then of dictionary entries: the word's counts in the training texts of each model."""
    counts = [f"c{k}" for k in range(models)]
    kinds = [("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("numbers", pa.binary()), ("counts", pa.binary()), ("word", pa.binary()), ("number", pa.int32())]
    return pa.schema(kinds + [(c, pa.int64()) for c in counts]), ", ".join(["block long, doc_id long, held_out boolean, numbers binary, counts binary, word binary, number int", *(f"{c} long" for c in counts)])


class _Block:
    """The dictionary and the waiting documents of one block."""

    def __init__(self, schema: pa.Schema, models: int):
        self.id, self.schema, self.models = uuid.uuid4().int >> 65, schema, models
        self.known, self.counts, self.rows, self.size = defaultdict(count().__next__), np.zeros((models, 1 << 16), dtype=np.int64), [], 0

    def add(self, doc_id: int | None, held_out: bool, model: int, text: bytes) -> None:
        own = Counter(text.lower().split())
        own[END] = 1
        numbers, times = np.array(list(map(self.known.__getitem__, own)), dtype="<i4"), np.array(list(own.values()), dtype="<i4")
        while len(self.known) > self.counts.shape[1]:
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)], axis=1)
        if not held_out:
            self.counts[model, numbers] += times  # no number comes twice
        self.rows.append((self.id, doc_id, held_out, numbers.tobytes(), times.tobytes()))
        self.size += len(text)

    def _batch(self, columns: list, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)

    def documents(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return self._batch([*zip(*rows, strict=True), *[None] * (2 + self.models)], len(rows))

    def entries(self):
        words, step = list(self.known), 1 << 16
        for i in range(0, len(words), step):
            some = words[i : i + step]
            yield self._batch([np.full(len(some), self.id), *[None] * 4, some, np.arange(i, i + len(some), dtype=np.int32), *self.counts[:, i : i + len(some)]], len(some))


def blocks(docs: DataFrame, languages: list[str], models: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds: documents (numbers and counts of their words) and dictionary entries."""
    schema, ddl = _block_schema(models)

    def run(batches):
        block = _Block(schema, models)
        for b in batches:
            for doc_id, held_out, model, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held_out", "model")), b.column("text"), strict=True):
                block.add(doc_id, held_out, model, text.as_py())
                if block.size > block_bytes:
                    yield block.documents()
                    yield from block.entries()
                    block = _Block(schema, models)
            if block.rows:
                yield block.documents()
        if block.known:
            yield from block.entries()

    model = F.coalesce(*(F.when(F.col("lang") == name, k) for k, name in enumerate(languages)), F.lit(models - 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~trains()).alias("held_out"), model.alias("model"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, ddl)


def gathered(batches, rows: int = GATHERED):
    """Tables of some ten thousand rows: arrays over words of one length are long enough then."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def fit_pieces(types: DataFrame, pieces: dict[bytes, float], models: int, rounds: int = ROUNDS, scores: str = "rank") -> np.ndarray:
    """models x pieces: natural logs of probabilities after EM over each model's training words, each distinct word once."""
    names, logs = list(pieces), np.tile(first_guess(pieces, scores), (models, 1))
    context = types.sparkSession.sparkContext
    trained = types.where(F.col("word") != F.lit(END)).select("word", *(F.col(f"c{k}") for k in range(models)))
    for _ in range(rounds):
        model = context.broadcast((names, logs))  # the vocabulary of one file: bounded

        def run(batches, model=model):
            lattice = Lattice(*model.value)
            total = np.zeros(lattice.logs.shape)
            for b in gathered(batches):
                words = np.array([b" " + w for w in b.column("word").to_pylist()], dtype=object)
                for k in range(len(total)):
                    own = words[b.column(f"c{k}").to_numpy() > 0].tolist()
                    total[k] += lattice.expected(own, k) if own else 0
            k, used = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(used, pa.int32()), pa.array(total[k, used])], names=["model", "piece", "uses"])

        uses = trained.mapInArrow(run, "model int, piece int, uses double")
        # Decimals make the sum the same in any order; at most a row for each model and piece comes back.
        added = uses.groupBy("model", "piece").agg(F.sum(F.col("uses").cast("decimal(28,6)")).cast("double").alias("uses")).collect()
        weight = np.full(logs.shape, 0.01)
        for row in added:
            weight[row.model, row.piece] += row.uses
        logs = np.log(weight / weight.sum(axis=1, keepdims=True))
    return logs


def word_logs(log_mass: np.ndarray, counts: np.ndarray, own: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """models x words: natural log of each word's probability, in log space throughout, so long words keep theirs.

    log_mass: logs of the segmented part; own: tokens and types (first two columns) of each model's training texts.
    """
    n, types, d = own[:, :1], own[:, 1:2], discount[:, None]
    with np.errstate(divide="ignore"):
        seen, rest = np.log(np.maximum(counts - d, 0)) - np.log(np.maximum(n, 1)), np.log(d * types) - np.log(np.maximum(n, 1))
    return np.where(n > 0, np.logaddexp(seen, rest + log_mass), log_mass)


def score(docs: DataFrame, model_path: str, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS, scores: str = "rank", whole_words: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs (doc_id, lang, text)."""
    context, (languages, models) = docs.sparkSession.sparkContext, _languages(docs)
    each = [f"c{k}" for k in range(models)]
    held = materialise(blocks(docs, languages, models, block_bytes), "blocks")
    entries = held.where("word IS NOT NULL").select(F.col("block").alias("home"), "number", "word", *each)
    types = materialise(entries.groupBy("word").agg(*(F.sum(c).alias(c) for c in each)), "types")
    all_ = sum((F.col(c) for c in each[1:]), F.col(each[0]))
    how_many = lambda test: F.sum(test.cast("long"))
    sums = types.agg(F.sum(all_), how_many(all_ > 0), *(f for c in each for f in (F.sum(c), how_many(F.col(c) > 0), how_many(F.col(c) == 1), how_many(F.col(c) == 2)))).first()
    n, v, *own = (int(x or 0) for x in sums)
    own = np.array(own, dtype=float).reshape(models, 4)
    ends = types.where(F.col("word") == F.lit(END)).select(*each).first() or [0] * models  # texts of each model
    share = (np.array(list(ends), dtype=float) + 1) / (sum(ends) + models)
    ending = (np.array([list(ends)], dtype=float).T + 1) / (own[:, :1] + 2)  # the end's share of a model's tokens
    discount = np.clip(own[:, 2] / np.maximum(own[:, 2] + 2 * own[:, 3], 1), 0.1, 0.95)
    pieces = read_pieces(model_path)
    model = context.broadcast((list(pieces), fit_pieces(types, pieces, models, rounds, scores)))

    def segmented(batches):
        lattice, end = Lattice(*model.value), 1.0 / len(model.value[0])
        for b in gathered(batches):
            words = b.column("word").to_pylist()
            # The lattice gives all words together a mass of 1, so the end's share is taken from them.
            mass, is_end = lattice.log_probabilities([b" " + w for w in words]), [w == END for w in words]
            c = np.array([b.column(x).to_numpy() for x in each], dtype=float)
            if whole_words:
                mass += math.log1p(-end)
                mass[:, is_end] = math.log(end)
                mass = word_logs(mass, c, own, discount)
            else:
                mass += np.log1p(-ending)
                mass[:, is_end] = np.log(ending)
            logs = (mass / math.log(10)).astype("<f4")
            yield from pa.Table.from_arrays([b.column("word"), pa.array(c.sum(axis=0).astype(np.int64)), pa.array([x.tobytes() for x in logs.T], pa.binary())], names=["word", "c", "logs"]).to_batches()

    scored = types.mapInArrow(segmented, "word binary, c long, logs binary")
    dictionary = entries.select("home", "number", "word").join(scored.hint("merge"), "word").select("home", "number", "c", "logs")
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(documents: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words.column("number").to_numpy())
        c = words.column("c").to_numpy()[order]
        base = np.log10((c + 1.0) / (n + v + 1))
        logs = np.frombuffer(b"".join(words.column("logs").to_pylist()), dtype="<f4").reshape(-1, models)[order]
        rows = []
        for doc_id, held_out, numbers, counts in zip(*(documents.column(x).to_pylist() for x in ("doc_id", "held_out", "numbers", "counts")), strict=True):
            at, times = np.frombuffer(numbers, dtype="<i4"), np.frombuffer(counts, dtype="<i4").astype(np.int64)
            by_model = times @ logs[at].astype(float) + np.log10(share)
            top = by_model.max()
            rows.append((doc_id, held_out, int(times.sum()), int(times[c[at] > 0].sum()), float(times @ base[at]), float(top + np.log10((10.0 ** (by_model - top)).sum()))))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, out.types, strict=True)], schema=out)

    documents = held.where("word IS NULL").select("block", "doc_id", "held_out", "numbers", "counts")
    found = documents.groupBy("block").cogroup(dictionary.groupBy("home")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
