"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes some thirty numbers about its characters, words and lines,
and each number a bin.  Boosting goes round the features in turn, each time
adding a small tree of that feature alone to its lookup table; then it goes
round the pairs of features whose joint table explains most of what is left.  A
text's score is the logistic of the intercept and the sum of the entries of its
bins.

The model is fitted on at most ``sample`` labelled rows, taken by hash of
doc_id; everything else runs over all rows.  Labels, lang, source and doc_id are
no inputs.

Defined results: null and empty texts score like a text of nothing; labels that
are null or without a text are left out; several labels of a document each
count; with labels of one value or none the score is their smoothed mean
everywhere; repeated rows are scored alike; a null doc_id counts as held out;
texts of any length are read whole; other columns, whatever their names, are
carried by kept and by classify (which replaces score and predicted) and ignored
elsewhere; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import text_or_empty

#: Labelled rows to fit on at most.
SAMPLE = 20_000
#: A text is kept at this score.
KEEP = 0.3
BINS, ROUNDS, RATE, LEAST = 24, 150, 0.08, 8.0
PAIRS, PAIR_ROUNDS, PAIR_BINS = 8, 60, 8

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "space": [32], "line": [10], "other_blank": [9, 11, 12, 13],
    "stop": b".", "comma": b",", "shout": b"!", "ask": b"?", "bar": b"|", "marks": b"$%&*#", "brackets": b"()[]{}<>", "quotes": b"\"'`", "code": b"=;:_/\\", "dash": b"-~+@^",
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes), _i] = 1
FEATURES = [
    *_CLASSES, "log_bytes", "words", "word_length", "longest_word", "distinct_words", "top_word", "once_words", "short_words", "marked_words", "shouted_words", "long_words",
    "lines", "line_length", "same_lines", "ended_lines", "distinct_trigrams",
]


def features(text: bytes) -> list[float]:
    """The numbers of FEATURES for a text in UTF-8."""
    n = len(text) or 1
    out = (np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _TABLE / n).tolist()
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w, k = len(words) or 1, len(lines) or 1
    counts = Counter(words)
    sizes = list(map(len, words))
    trigrams = len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else 1
    return out + [
        np.log1p(len(text)), np.log1p(len(words)), sum(sizes) / w, float(np.log1p(max(sizes, default=0))), len(counts) / w, max(counts.values(), default=0) / w,
        sum(c == 1 for c in counts.values()) / w, sum(s <= 3 for s in sizes) / w, sum(not x[-1:].isalnum() and x[-1] < 128 for x in words) / w, sum(x.isupper() for x in words) / w, sum(s > 14 for s in sizes) / w,
        np.log1p(len(lines)), float(np.log1p(sum(map(len, lines)) / k)), 1 - len(set(lines)) / k if lines else 0.0, sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, trigrams / max(1, len(words) - 2),
    ]


@dataclass
class Model:
    """Cut points of each feature, its table, and the joint tables of pairs (over coarser cut points)."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    joint: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]) if cuts else np.zeros((0, len(x)), dtype=int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for b, table in zip(self.bins(x, self.cuts), self.tables, strict=True):
            total += table[b]
        coarse = self.bins(x, self.coarse) if self.pairs else None
        for (i, j), table in zip(self.pairs, self.joint, strict=True):
            total += table[coarse[i], coarse[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g**2 / (h + 1.0)


def _line_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Newton steps by bin of the best tree over one feature; g and h are sums by bin."""
    edges, cg, ch = [0, len(g)], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(edges) <= leaves:
        best, at = 1e-9, None
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            left_g, left_h = cg[a + 1 : b] - cg[a], ch[a + 1 : b] - ch[a]
            all_g, all_h = cg[b] - cg[a], ch[b] - ch[a]
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            gains[np.minimum(left_h, all_h - left_h) < LEAST / 8] = -1
            k = int(gains.argmax())
            if gains[k] > best:
                best, at = gains[k], a + 1 + k
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps of the best cut of a joint table into four quarters, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    q = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    parts = list(zip(q(cg), q(ch), strict=True))
    gains = sum(_gain(a, b) for a, b in parts)
    if not gains.size:
        return np.zeros(g.shape), 0.0
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    steps = [float(a[i, j] / (b[i, j] + 1.0)) for a, b in parts]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return out, float(gains[i, j] - _gain(cg[-1, -1], ch[-1, -1]))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows x (one column per feature) and labels y (0 or 1)."""
    mean = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(mean / (1 - mean))))
    if not len(y) or y.min() == y.max():
        return model
    quantiles = lambda j, n: np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1]))
    model.cuts = [quantiles(j, BINS) for j in range(x.shape[1])]
    model.coarse = [quantiles(j, PAIR_BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins, total = model.bins(x, model.cuts), np.full(len(y), model.intercept)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slope()
            step = RATE * _line_tree(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)))
            table += step
            total += step[bins[j]]
    coarse = model.bins(x, model.coarse)
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
    sums = lambda v, i, j: np.bincount(coarse[i] * shape(i, j)[1] + coarse[j], v, shape(i, j)[0] * shape(i, j)[1]).reshape(shape(i, j))
    g, h = slope()
    ranked = sorted(((_cross_tree(sums(g, i, j), sums(h, i, j))[1], i, j) for i in range(len(coarse)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    model.joint = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.joint, strict=True):
            g, h = slope()
            step = RATE * _cross_tree(sums(g, i, j), sums(h, i, j))[0]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _features(rows: DataFrame) -> DataFrame:
    """rows with the column text (binary) replaced by x, its features."""
    names = [c for c in rows.columns if c != "text"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"), "x array<double>"])

    def run(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    return rows.mapInArrow(run, ddl)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the labelled rows that aren't held out, at most ``sample`` of them by hash of doc_id.

    Also where a labelled doc_id stands in many rows no more than ``sample`` rows are fitted.
    """
    known = labels.where(~held_out()).where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("_id"), "_id", "y").limit(sample)
    # No more rows than the sample: safe to send to every task; what they find may be more, and is cut as features.
    texts = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    rows = texts.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select(F.col("_id").cast("long").alias("_id"), "y", "text")
    bounded = _features(rows).orderBy(F.xxhash64("_id"), "_id", "y", "x").limit(sample)
    fitted = sorted(bounded.collect(), key=lambda r: (r["_id"], r.y, r.x))
    return fit(np.array([r.x for r in fitted], dtype=float).reshape(len(fitted), len(FEATURES)), np.array([r.y for r in fitted], dtype=float))


def classify(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """docs with score and predicted (1: keep), which replace columns of these names."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of bins: some kB
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b in batches:
            x = [features((t.as_py() or "").encode()) for t in b.column("text")]
            score = sent.value.score(np.array(x, dtype=float).reshape(len(x), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= keep).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def kept(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of docs that score keep or more, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = [features((t.as_py() or "").encode()) for t in b.column("text")]
            yield b.filter(pa.array(sent.value.score(np.array(x, dtype=float).reshape(len(x), len(FEATURES))) >= keep))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of docs."""
    return classify(docs.select("doc_id", "text"), train(docs, labels, sample)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
