"""Section-wise merge of Markdown, corrections and marked blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import fixed
from tessella.functions import text as X


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, heading, body: the parts of a text that begin at ``## ``; what stands before is ord 0 with heading ''."""
    parts = F.split(F.col(text), r"(?m)(?=^## )")
    each = docs.select(key, F.posexplode(parts).alias("ord", "body")).where("body <> ''")
    return each.withColumn("heading", F.regexp_extract("body", r"^(## [^\n]*)", 1))


def upsert(base: DataFrame, patch: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, text: base with the sections of equal heading replaced by patch's, new ones behind.

    Text before the first heading of a patch is dropped; a patch without
    headings goes behind whole; a key without a patch keeps its text.
    """
    old, new = sections(base, key, text), sections(patch, key, text)
    headed = new.where("heading <> ''").groupBy(key).agg(F.count("*").alias("_headed"))
    new = new.join(headed, key, "left").where("heading <> '' OR _headed IS NULL").select(F.col(key).alias("_k"), F.col("heading").alias("_h"), F.col("body").alias("_new"), F.col("ord").alias("_ord"))
    joined = old.join(new, (F.col(key) == F.col("_k")) & (F.col("heading") == F.col("_h")) & (F.col("heading") != ""), "full_outer")
    merged = joined.select(F.coalesce(key, "_k").alias(key), F.struct(F.col("ord").isNull().alias("late"), F.coalesce("ord", "_ord").alias("ord"), F.trim(F.coalesce("_new", "body"), F.lit("\n")).alias("body")).alias("s"))
    return merged.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s.body), "\n\n").alias(text))


def with_correction(text: Column | str, entry: Column, heading: str = "## Correction log", placeholder: str = "(none yet)") -> Column:
    """Text with a new entry directly under the heading of the log, which is made where it is missing."""
    text = F.replace(X.column(text), F.lit(f"{placeholder}\n"), F.lit(""))
    at = F.instr(text, heading)
    head = F.substring(text, F.lit(1), at + len(heading))
    rest = F.substring(text, at + len(heading) + 1, F.length(text))
    return F.when(at > 0, F.concat(head, entry, F.lit("\n"), rest)).otherwise(F.concat(X.strip(text), F.lit(f"\n\n{heading}\n"), entry, F.lit("\n")))


def corrected(text: Column | str, corrections: Column | str) -> Column:
    """Text with the entries of an array of (scene, wrong, correct), each directly under the log's heading.

    The first known heading of a log that the text holds counts, and what says
    that it is empty goes; without one a log is put behind.  Entries without
    wrong or correct are passed over, one without scene is general.
    """

    def put(t: Column, c: Column) -> Column:
        line = F.concat(F.lit("\n- ["), F.coalesce(c["scene"], F.lit("general")), F.lit("] should not "), c["wrong"], F.lit("; should "), c["correct"])
        out = F.concat(t, F.lit(f"\n\n{fixed.CORRECTION_LOGS[0][0]}\n"), line, F.lit("\n"))
        for heading, empty in reversed(fixed.CORRECTION_LOGS):
            end = F.instr(t, F.lit(heading)) + len(heading)
            rest = F.substring(t, end, F.length(t))
            rest = F.when(F.startswith(rest, F.lit(empty)), F.substring(rest, F.lit(len(empty) + 1), F.length(rest))).otherwise(rest)
            out = F.when(F.contains(t, F.lit(heading)), F.concat(F.substring(t, F.lit(1), end - 1), line, rest)).otherwise(out)
        return out

    whole = F.filter(F.coalesce(X.column(corrections), F.array().cast("array<struct<scene:string,wrong:string,correct:string>>")), lambda c: c["wrong"].isNotNull() & c["correct"].isNotNull())
    return F.aggregate(whole, X.column(text), put)


def updated(base: DataFrame, patches: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """key, text after an update: base merged with its patch; without one (or with an empty one) with its corrections.

    A patch suppresses corrections.  base and patches: key, text; corrections:
    key and corrections, an array of (scene, wrong, correct).
    """
    asked = patches.where(F.col("text") != "")
    alone = base.join(asked.select(key), key, "left_anti").join(corrections.select(key, "corrections"), key, "left")
    merged = upsert(base.join(asked.select(key), key, "left_semi"), asked.join(base.select(key), key, "left_semi"), key)
    return merged.unionByName(alone.select(key, corrected("text", "corrections").alias("text")))


def section_body(text: Column | str, heading: str) -> Column:
    """What stands under a heading up to the next of level 1 or 2, stripped."""
    return X.strip(F.regexp_extract(X.column(text), rf"(?ims)^##\s+{heading}\s*\n(.*?)(?=^##?\s|\z)", 1))


def with_block(text: Column | str, block: Column, begin: str, end: str) -> Column:
    """Text whose block between the markers is replaced, or that gets one behind; unbalanced markers leave it as it is."""
    text = X.column(text)
    n_begin, n_end = F.regexp_count(text, F.lit(begin)), F.regexp_count(text, F.lit(end))
    marked = F.concat(F.lit(f"{begin}\n"), block, F.lit(f"\n{end}"))
    before, after = F.regexp_extract(text, rf"(?s)^(.*?){begin}", 1), F.regexp_extract(text, rf"(?s){end}(.*)$", 1)
    return F.when((n_begin == 1) & (n_end == 1), F.concat(before, marked, after)).when((n_begin == 0) & (n_end == 0), F.concat(text, F.lit("\n"), marked)).otherwise(text)
