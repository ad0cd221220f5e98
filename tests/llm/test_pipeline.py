"""The pipeline's stages, each on its own input, against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tessella.llm import byte_bpe, mixing, quality
from tests.llm.conftest import ROWS, frame
from tests.llm.test_operators import RANKS, WORDS, brute_components, brute_simhash, ordered


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, small).cache()
        kept[name] = (before, docs.collect())
        assert name == "byte-level BPE" or docs.columns == columns

    before, after = kept["quality classifier"]
    model = quality.train(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    score = model.score(np.array([quality.features((r.text or "").encode()) for r in before]))
    assert ordered(after) == ordered(r for r, s in zip(before, score, strict=True) if s >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    stayed = {r.doc_id for r in after}
    clean = [i for i, q in labels.items() if q == 1]
    assert len(after) < len(before) and sum(i in stayed for i in clean) >= 0.97 * len(clean)

    before, after = kept["exact dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert ordered(after) == ordered(first.values()) and len(after) < len(before)

    before, after = kept["SimHash near-dedup"]
    heads = brute_components([(r.doc_id, brute_simhash(r.text or "")) for r in before])
    assert ordered(after) == ordered(r for r, h in zip(before, heads, strict=True) if r.doc_id == h)

    before, after = kept["mixing sources"]
    words = {r.doc_id: Counter(WORDS(r.text or "")) for r in before}
    for r in after:
        assert not Counter(WORDS(r.text)) - words[r.doc_id] and r.n_chars == len(r.text)
    turns = Counter(r.doc_id for r in after)
    assert max(turns.values()) == 2
    size = sum(sum(c.values()) for c in words.values())
    assert abs(sum(len(WORDS(r.text)) for r in after) - 1.5 * size) < 0.05 * size

    before, after = kept["byte-level BPE"]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(byte_bpe.read_ranks(RANKS))}, special_tokens={})
    ids = [(r.doc_id, np.array(library.encode_ordinary(r.text), dtype="<u4").tobytes(), r.text) for r in before]
    assert ordered((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == ordered((i, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids)


def test_run_gives_what_the_stages_give(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert found.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(found.columns)
    ids = spark.read.parquet(found.first().ids_path)
    assert ordered((r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in ids.collect()) == ordered((r.doc_id, r.ids_sha256) for r in found.collect())


@pytest.fixture
def land(spark, tmp_path):
    """Writes documents (with columns of clashing names) and labels to a folder."""

    def write(rows, labels=()):
        frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return write


def test_stages_on_odd_rows(spark, land):
    """Nulls, empty and very long texts, ties, rows that repeat or share a doc_id, and clashing names, each stage on its own input."""
    twin = [(7, "n0 n1 n2 n3 n4", "en", "a"), (7, "m0 m1 m2", "en", "a"), (None, None, None, None), (None, "no id", "en", "b")]
    folder = land([*ROWS, *twin])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, folder).cache()
        kept[name] = (before, docs.collect())
        assert name == "byte-level BPE" or docs.columns == columns
    text = lambda r: r.text or ""

    before, after = kept["quality classifier"]
    assert ordered(after) == ordered(before)  # no labels

    before, after = kept["exact dedup"]
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", text(r))
    first = {}
    for r in before:
        first.setdefault(norm(r), []).append((r.doc_id is None, r.doc_id or 0))
    assert sorted((norm(r), r.doc_id is None, r.doc_id or 0) for r in after) == sorted((k, *min(v)) for k, v in first.items())

    before, after = kept["SimHash near-dedup"]
    heads = brute_components([(r.doc_id, brute_simhash(text(r))) for r in before])
    groups = {}
    for r, h in zip(before, heads, strict=True):
        groups.setdefault(h, []).append(r)
    for h, own in groups.items():
        stay = [r for r in after if r in own and r.doc_id == h]
        assert len(stay) >= 1 and (h is None or len({brute_simhash(text(r)) for r in stay}) == len(stay))
    assert {r.doc_id for r in after} == set(heads)

    before, after = kept["mixing sources"]
    have, out = Counter(w for r in before for w in WORDS(text(r))), Counter(w for r in after for w in WORDS(r.text))
    assert all(n <= 2 * have[w] for w, n in out.items()) and all(r.n_chars == len(r.text) for r in after)
    own = {}
    for r in before:
        own.setdefault(r.doc_id, set()).update(WORDS(text(r)))
    assert all(set(WORDS(r.text)) <= own[r.doc_id] for r in after)

    before, after = kept["byte-level BPE"]
    assert ordered((r.doc_id, r.decoded_sha256) for r in after) == ordered((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before)


def test_mixing_counts_each_row_once(spark, land):
    """Two rows of each doc_id: as many words come out as the mixture takes."""
    rows = [(i, " ".join(f"{c}{i}_{k}" for k in range(8)), "en", "a") for i in (1, 2) for c in "pq"]
    folder = land(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sum(r.taken for r in mixing.taken_words(docs, block=4).collect()) == 48
    assert sum(len(WORDS(r.text)) for r in mixing.mixed_documents(docs, block=4).collect()) == 48
    taken = sum(r.taken for r in mixing.taken_words(docs).collect())
    assert sum(len(WORDS(r.text)) for r in corpus_pipeline.mixing_stage(spark, docs, folder).collect()) == taken


def test_run_on_an_empty_table(spark, land):
    assert corpus_pipeline.run(spark, land([])).collect() == []
