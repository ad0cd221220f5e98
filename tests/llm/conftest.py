import pytest
from pyspark.sql import functions as F

SENTENCE = "The quick brown fox jumps over the lazy dog near the old river bank while many birds sing"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(12_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))

#: doc_id, text, lang, source: nulls everywhere, empty, blank, very long and one-word texts, ties and repeated rows.
ROWS = [
    (1, SENTENCE, "en", "a"), (2, SENTENCE.replace(" ", "\t", 1), "en", "b"), (3, SENTENCE + " loudly", "en", "a"), (4, None, None, None), (5, "", "en", "a"), (6, " \n\t ", "de", None), (7, LONG, "en", "b"),
    (8, "x" * 30_000, None, "c"), (9, "one", "fr", "c"), (10, "ein zwei drei vier fünf ÄÖÜ ß 漢字 😀", "de", "a"), (10, "ein zwei drei vier fünf ÄÖÜ ß 漢字 😀", "de", "a"), (11, "before " + PASSAGE + " after", "en", "a"),
    (12, PASSAGE + " other end", "en", "a"), (13, "lead " + PASSAGE, "en", "b"), (None, "text without an id", "en", "a"), (14, "<|endoftext|> I'll say \x1c it's  done\r\n", "en", "a"), (15, SENTENCE, "en", "a"), (15, "another text of the same id", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, clashes=True):
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA).repartition(3)
    if clashes:
        for name in ("size", "key", "h", "norm", "kept", "bucket", "slot", "shard", "unit", "start", "ids", "decoded", "fp", "component_id", "score", "predicted", "word", "block", "copy", "x", "ord", "grp", "all_before", "y", "_id", "_parts", "_sha", "_copy", "_null", "_range", "_h", "row", "row_hash", "no_id", "id", "sha", "parts", "turn", "root", "head", "n", "cell", "value", "u", "v", "slot", "piece", "keep_id", "group_size", "carried", "label", "held_out", "src", "uses", "words"):
            df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
