"""Research notes: lines with their section, findings, counts and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import fixed
from tessella.functions import text as X
from tessella.functions import urls

TRACKS = [f"{i:02d}" for i in range(1, 7)]
PRIMARY = r"primary source|official statement|original interview"


def note_lines(notes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, line_no, line (stripped), section (lower case, '' before the first), heading, bullet."""
    each = notes.select(key, F.posexplode(X.lines(text)).alias("line_no", "line")).withColumn("line", X.strip("line"))
    heading = F.when(F.rlike("line", F.lit(r"^##\s+.+$")), F.lower(X.strip(F.regexp_extract("line", r"^##\s+(.+)$", 1))))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = each.withColumn("heading", heading)
    return marked.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(before), F.lit(""))).withColumn("bullet", F.col("heading").isNull() & F.startswith("line", F.lit("- ")))


def _begins(section: str, names: list[str]) -> Column:
    test = F.lit(False)
    for n in names:
        test = test | F.startswith(section, F.lit(n))
    return test


def section_metrics(lines: DataFrame, key: str = "path") -> DataFrame:
    """Counts of metadata blocks and of bullets under contradictions, inferences, patterns and gaps."""
    under = lambda test: F.count_if(F.col("bullet") & test)
    return lines.groupBy(key).agg(
        F.count_if(F.col("heading") == "source metadata").alias("metadata_blocks"), under(F.col("section") == "contradictions").alias("contradictions"),
        under(_begins("section", fixed.INFERENCES)).alias("inferences"), under(F.col("section") == "patterns and repeated themes").alias("patterns"), under(_begins("section", fixed.GAPS)).alias("gaps"),
    )


def findings(lines: DataFrame) -> DataFrame:
    """Bullets of the sections that hold findings."""
    return lines.where(F.col("bullet") & F.col("section").isin(*fixed.FINDINGS)).withColumn("finding", X.strip(F.substring("line", 3, 1 << 30)))


def weights(text: Column | str) -> Column:
    """First digits of all source weights of a text that are 1 to 7."""
    found = F.regexp_extract_all(X.column(text), F.lit(f"(?i){fixed.SOURCE_WEIGHT}"), F.lit(1))
    return F.filter(found, lambda w: w.between("1", "7"))


def long_quote(line: Column | str) -> Column:
    """A quoted line, one with a clock time, or one with a quote mark and over 25 words."""
    line = X.column(line)
    words = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    marks = F.rlike(line, F.lit("[\"“”']"))
    return F.startswith(line, F.lit(">")) | F.rlike(line, F.lit(fixed.NOTE_CLOCK)) | (marks & (words > 25))


def tier_ratio(high: Column, total: Column) -> Column:
    return X.percent(high, total)


_DEPTH = {"files_scanned": 6, "unique_urls": 8, "primary_markers": 3, "metadata_blocks": 6, "contradictions": 6, "inferences": 6, "tracks": 6}


def draft_counts(text: Column | str) -> tuple[Column, Column]:
    """Bullets, and distinct grounded addresses, of a draft."""
    found = F.transform(F.regexp_extract_all(X.column(text), F.lit(fixed.DRAFT_URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,]+$", ""))
    return F.regexp_count(X.column(text), F.lit(r"(?m)^\s*[-*]\s+")), F.size(F.array_distinct(F.filter(found, urls.is_grounded)))


def quality_gate(drafts: DataFrame, strict: bool, text: str = "text") -> DataFrame:
    """drafts with ``checks``, a map of thirteen named checks, and ``passed``.

    drafts has the text and the research metrics as columns (long_quotes,
    primary_ratio, high_tier, reviews: five booleans in an array, questions,
    edge_cases and the columns of depth).  The lenient profile passes what only
    the strict one asks for.
    """
    bullets, grounded = draft_counts(text)
    said = lambda p: F.rlike(text, F.lit(f"(?iu){p}"))
    checks = {name: said(p) for name, p in fixed.DRAFT_CHECKS.items()}
    checks["mental_models"] = checks["mental_models"] & (bullets >= 3)
    asked = {name: said(p) for name, p in fixed.STRICT_CHECKS.items()}
    asked["source_hierarchy"] = (F.col("primary_ratio") >= 50) | (F.col("high_tier") >= 3)
    asked["review_chain"] = F.forall("reviews", lambda r: r)
    asked["validation_depth"] = (F.col("questions") >= 2) & (F.col("edge_cases") >= 1)
    deep = F.lit(True)
    for name, least in _DEPTH.items():
        deep = deep & (F.col(name) >= least)
    asked["research_depth"] = deep
    checks |= {name: test if strict else F.lit(True) for name, test in asked.items()}
    checks["source_grounding"] = grounded >= (4 if strict else 2)
    checks["copyright_safety"] = X.copyright_safe(text) & (F.col("long_quotes") == 0)
    made = F.create_map(*(x for name, test in checks.items() for x in (F.lit(name), F.coalesce(test, F.lit(False)))))
    return drafts.withColumn("checks", made).withColumn("passed", F.forall(F.map_values("checks"), lambda c: c))
