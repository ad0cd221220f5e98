"""Metrics, findings and gates over research notes, which the queries write from documents first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import fixed
from tessella.functions import text as X
from tessella.operators import notes as N
from tessella.operators import ranking
from tessella.plans import query
from tessella.session import table
from tessella.sources import notes as S


def _notes(spark, sf_dir):
    """A note of each document: its source is the topic, counts follow from doc_id."""
    k = F.col("doc_id")
    bullets = lambda n, what: F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(f"- {what} "), k, F.lit(" "), i)), "\n")
    some = lambda n, what: F.when(n > 0, F.concat(bullets(F.greatest(n, F.lit(1)), what), F.lit("\n"))).otherwise("")
    text = F.concat(
        F.lit("# Title\n- stray bullet\n## Source Metadata\n- Source weight: "), k % 9, F.lit("\n- Primary source: https://a.example.com/item/"), k % 50, F.lit(" (see https://b.example.org)\n## Evidence\n"), some(k % 4, "fact"),
        F.lit("## Contradictions\n"), some(k % 3, "but"), F.lit("## Inferences (clearly marked)\n"), some(k % 2, "so"), F.lit("##  Patterns and repeated themes \n- theme\n## Gaps in time\n- gap\n"),
        F.when(k % 5 == 0, "> quoted line\n").otherwise(""), F.when(k % 5 == 1, "at 01:02:03 he\n").otherwise(""), F.when(k % 5 == 2, F.concat(F.lit("it's "), F.repeat(F.lit("word "), 25), F.lit("\n"))).otherwise(""),
    )
    path = F.concat(F.when(k % 10 < 8, F.concat(F.lpad((k % 10).cast("string"), 2, "0"), F.lit("-"))).otherwise(""), k, F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic"), path.alias("path"), text.alias("text"))


@query("SELECT doc_id, 1 AS metadata_blocks, doc_id % 3 AS contradictions, doc_id % 2 AS inferences, 1 AS patterns, 1 AS gaps FROM documents")
def g2_section_metrics(spark, sf_dir):
    return N.section_metrics(N.note_lines(_notes(spark, sf_dir), "doc_id"), "doc_id")


@query("SELECT (doc_id % 9)::VARCHAR AS weight, count(*) AS n FROM documents WHERE doc_id % 9 BETWEEN 1 AND 7 GROUP BY ALL")
def g3_weight_hist(spark, sf_dir):
    return _notes(spark, sf_dir).select(F.explode(N.weights("text")).alias("weight")).groupBy("weight").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT source AS topic, doc_id % 9 AS w FROM documents WHERE doc_id % 9 BETWEEN 1 AND 7),
t AS (SELECT topic, count(*) FILTER (w <= 3) AS high, count(*) FILTER (w IN (4, 5)) AS mid, count(*) FILTER (w >= 6) AS low, count(*) AS total FROM w GROUP BY topic)
SELECT *, round_even(100.0 * high / total, 0)::BIGINT AS ratio FROM t""")
def g4_tiers(spark, sf_dir):
    """Sources by tier of weight, and the share of the best in whole percent."""
    w = _notes(spark, sf_dir).select("topic", F.explode(N.weights("text")).alias("w")).select("topic", F.col("w").cast("int"))
    tiers = w.groupBy("topic").agg(F.count_if(F.col("w") <= 3).alias("high"), F.count_if(F.col("w").between(4, 5)).alias("mid"), F.count_if(F.col("w") >= 6).alias("low"), F.count("*").alias("total"))
    return tiers.withColumn("ratio", N.tier_ratio(F.col("high"), F.col("total")))


@query("SELECT source AS topic, 2 * count(*) AS mentions, count(DISTINCT doc_id % 50) + 1 AS distinct_urls FROM documents GROUP BY source")
def g5_urls(spark, sf_dir):
    found = _notes(spark, sf_dir).select("topic", F.explode(F.regexp_extract_all("text", F.lit(fixed.NOTE_URL), F.lit(0))).alias("url"))
    return found.groupBy("topic").agg(F.count("*").alias("mentions"), F.countDistinct("url").alias("distinct_urls"))


@query("SELECT source AS topic, count(*) AS markers, count(*) AS marked_files FROM documents GROUP BY source")
def g6_primary_markers(spark, sf_dir):
    text = F.lower("text")
    return _notes(spark, sf_dir).groupBy("topic").agg(F.sum(F.regexp_count(text, F.lit(rf"(?U)\b(?:{N.PRIMARY})\b"))).alias("markers"), F.count_if(F.rlike(text, F.lit(N.PRIMARY))).alias("marked_files"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN 1 ELSE 0 END AS long_quotes FROM documents")
def g7_long_quotes(spark, sf_dir):
    lines = N.note_lines(_notes(spark, sf_dir), "doc_id")
    return lines.groupBy("doc_id").agg(F.count_if(N.long_quote("line")).alias("long_quotes"))


@query("SELECT source AS topic, count(*) AS files, sum(doc_id % 4 + 1)::BIGINT AS findings FROM documents GROUP BY source")
def g8_totals(spark, sf_dir):
    found = N.findings(N.note_lines(_notes(spark, sf_dir), "doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return _notes(spark, sf_dir).join(found, "doc_id", "left").groupBy("topic").agg(F.count("*").alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("findings"))


@query("""SELECT source AS topic, count(*) AS files, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM documents GROUP BY source""")
def g8_characters(spark, sf_dir):
    """Files of each topic and the characters in them."""
    grouped = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("topic"))
    return grouped.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))


@query("""SELECT source AS topic, count(*) FILTER (doc_id % 10 < 8) AS tracked, count(DISTINCT CASE WHEN doc_id % 10 < 8 THEN doc_id % 10 END) AS tracks,
  coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (VALUES ('01', 1), ('02', 2), ('03', 3), ('04', 4), ('05', 5), ('06', 6)) v(t, k) WHERE k NOT IN (SELECT doc_id % 10 FROM documents e WHERE e.source = d.source)), '') AS missing
FROM documents d GROUP BY source""")
def g9_track_coverage(spark, sf_dir):
    """Tracks of the files of each topic, and which of the six expected ones are missing."""
    tracked = _notes(spark, sf_dir).withColumn("track", S.track("path"))
    missing = F.array_join(F.array_except(F.array(*map(F.lit, N.TRACKS)), F.collect_set("track")), ",")
    return tracked.groupBy("topic").agg(F.count("track").alias("tracked"), F.countDistinct("track").alias("tracks"), missing.alias("missing"))


@query("SELECT doc_id, 2 + doc_id % 3 AS bullets, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS grounded FROM documents")
def g10_draft_counts(spark, sf_dir):
    bullets, grounded = N.draft_counts("text")
    return _drafts(spark, sf_dir).select("doc_id", bullets.alias("bullets"), grounded.alias("grounded"))


@query("SELECT doc_id, doc_id % 4 AS questions, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS edge_cases FROM documents")
def g11_review_depth(spark, sf_dir):
    text = F.concat(F.repeat(F.lit("Question: why\n"), (F.col("doc_id") % 4).cast("int")), F.when(F.col("doc_id") % 2 == 0, "Edge-case one, edge case two").otherwise(""))
    made = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return made.select("doc_id", F.regexp_count("t", F.lit(r"Question:\s*")).alias("questions"), F.regexp_count(F.lower("t"), F.lit("edge-case|edge case")).alias("edge_cases"))


@query("SELECT user_id, bool_and(value >= 1) AS all_passed, count(*) FILTER (value < 1) AS failed FROM events GROUP BY user_id")
def g13_all_checks(spark, sf_dir):
    ok = F.col("value") >= 1
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_and(ok).alias("all_passed"), F.count_if(~ok).alias("failed"))


@query("""SELECT event_type, user_id::VARCHAR AS candidate, min(event_id) AS first_seen FROM events GROUP BY event_type, user_id
UNION ALL SELECT DISTINCT event_type, 'seed', -1 FROM events""")
def g15_candidates(spark, sf_dir):
    """The seed and all distinct users of each type, with the event in which each was first seen (-1: the seed), which orders them."""
    events = table(spark, sf_dir, "events")
    first = events.groupBy("event_type", F.col("user_id").cast("string").alias("candidate")).agg(F.min("event_id").alias("first_seen"))
    return first.union(events.select("event_type", F.lit("seed"), F.lit(-1).cast("long")).distinct())


@query("""WITH f AS (SELECT doc_id, unnest(range(1, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 1 + least(2, doc_id % 4) END)) AS i, source FROM documents UNION ALL
  SELECT doc_id, 9, source FROM documents WHERE doc_id % 4 < 2),
r AS (SELECT source AS topic, doc_id, CASE WHEN i = 9 THEN 'theme' ELSE 'fact ' || doc_id || ' ' || i END AS finding, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS n FROM f)
SELECT topic, doc_id, finding FROM r WHERE n <= 10""")
def l6_key_findings(spark, sf_dir):
    """The first two findings of each note, then the first ten of each topic."""
    found = N.findings(N.note_lines(_notes(spark, sf_dir), "doc_id"))
    two = ranking.first_n(found, ["doc_id"], ["line_no"], 2).join(_notes(spark, sf_dir).select("doc_id", "topic"), "doc_id")
    return ranking.first_n(two, ["topic"], ["doc_id", "line_no"], 10).select("topic", "doc_id", "finding")


@query("""SELECT s.source AS topic, t AS track FROM (SELECT DISTINCT source FROM documents) s, (VALUES ('01', 1), ('02', 2), ('03', 3), ('04', 4), ('05', 5), ('06', 6)) v(t, k)
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = s.source AND d.doc_id % 10 = k)""")
def j7_missing_tracks(spark, sf_dir):
    """Expected tracks without a file, as rows."""
    present = _notes(spark, sf_dir).select("topic", S.track("path").alias("track"))
    expected = present.select("topic").distinct().select("topic", F.explode(F.array(*map(F.lit, N.TRACKS))).alias("track"))
    return expected.join(present, ["topic", "track"], "left_anti")


@query("SELECT doc_id, sum(n)::BIGINT AS findings FROM (SELECT doc_id, doc_id % 4 + 1 AS n FROM documents) GROUP BY doc_id")
def m14_findings(spark, sf_dir):
    return N.findings(N.note_lines(_notes(spark, sf_dir), "doc_id")).groupBy("doc_id").agg(F.count("*").alias("findings"))


def _drafts(spark, sf_dir):
    """A draft of each document with the metrics of its research."""
    k = F.col("doc_id")
    text = F.concat(
        F.lit("Mental models\n- one https://a.example.com/long/path.\n* two\n"), F.repeat(F.lit("- more\n"), (k % 3).cast("int")), F.when(k % 2 == 0, "see <https://b.example.org/watch?vid=9> tension\n").otherwise(""),
        F.lit("Limitations, sentence rhythm, honest boundary. Influenced by x. Research dimensions.\n"), F.when(k % 7 == 0, "> verbatim\n").otherwise(""),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.alias("text"), F.when(k % 11 == 0, 1).otherwise(0).alias("long_quotes"), (k % 100).alias("primary_ratio"), (k % 4).alias("high_tier"), F.array(F.lit(True), k % 3 != 0).alias("reviews"),
        (k % 4).alias("questions"), (k % 2).alias("edge_cases"), *((k % 13).alias(c) for c in N._DEPTH),
    )




@query("""WITH d AS (SELECT doc_id AS k FROM documents)
SELECT k AS doc_id, n AS name, CASE n WHEN 'mental_models' THEN k % 3 >= 1 WHEN 'internal_tension' THEN k % 2 = 0 WHEN 'copyright_safety' THEN k % 7 <> 0 AND k % 11 <> 0 WHEN 'source_grounding' THEN false
  WHEN 'source_hierarchy' THEN k % 100 >= 50 OR k % 4 >= 3 WHEN 'review_chain' THEN k % 3 <> 0 WHEN 'validation_depth' THEN k % 4 >= 2 AND k % 2 >= 1 WHEN 'research_depth' THEN k % 13 >= 8 ELSE true END AS passed
FROM d, (VALUES ('mental_models'), ('limitations'), ('expression_dna'), ('honest_boundaries'), ('internal_tension'), ('intellectual_genealogy'), ('agentic_protocol'), ('source_hierarchy'), ('review_chain'), ('validation_depth'), ('research_depth'), ('source_grounding'), ('copyright_safety')) v(n)""")
def k8_quality_gate(spark, sf_dir):
    """The thirteen checks of the strict profile, a row each."""
    return N.quality_gate(_drafts(spark, sf_dir), strict=True).select("doc_id", F.explode("checks").alias("name", "passed"))


@query("SELECT doc_id, doc_id % 3 >= 1 AND doc_id % 2 = 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS passed FROM documents")
def k8_lenient_gate(spark, sf_dir):
    return N.quality_gate(_drafts(spark, sf_dir), strict=False).select("doc_id", "passed")


def _cues(spark, sf_dir):
    """Subtitle files whose spoken lines are the lines of documents."""
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", "[<>:]", ""), "\n"), X.strip), lambda x: (x != "") & ~F.rlike(x, F.lit(r"^[0-9]+$|-->|\b(align|position|size|line)\b")))
    cue = lambda x, i: F.concat(i + 1, F.lit("\n00:00:01,000 --> 00:00:02,000 align:start\n<i>"), x, F.lit("</i>\n"))
    made = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    return made.select("doc_id", F.concat(F.lit("WEBVTT\nKind: captions\n\nNOTE made\n\n"), F.array_join(F.transform("l", cue), "\n")).alias("subtitles"))


_LINES = r"""WITH raw AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[<>:]', '', 'g'), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(text, '[<>:]', '', 'g'), chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, i, regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS x FROM raw),
f AS (SELECT * FROM s WHERE x <> '' AND NOT regexp_matches(x, '^[0-9]+$|-->|\b(align|position|size|line)\b')),
n AS (SELECT doc_id, x, i, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f),
k AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM n WHERE p IS DISTINCT FROM x)"""


@query(_LINES + "\nSELECT doc_id, count(*) AS cues FROM k GROUP BY doc_id")
def m7_consecutive_dedup(spark, sf_dir):
    """Spoken lines without repeats of the line before."""
    cues = S.spoken_lines(_cues(spark, sf_dir), "doc_id", "subtitles")
    return S.collapsed(cues, "doc_id", "c").select("doc_id", F.size("c").cast("long").alias("cues"))


@query(_LINES.replace("WITH raw", "WITH RECURSIVE raw") + """,
r AS (SELECT doc_id, i, x AS joined, length(x) >= 240 OR regexp_matches(x, '[.!?。！？]$') AS whole FROM k WHERE i = 1
  UNION ALL SELECT k.doc_id, k.i, CASE WHEN r.whole THEN k.x ELSE r.joined || ' ' || k.x END, length(CASE WHEN r.whole THEN k.x ELSE r.joined || ' ' || k.x END) >= 240 OR regexp_matches(k.x, '[.!?。！？]$')
  FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1),
e AS (SELECT *, i = max(i) OVER (PARTITION BY doc_id) AS last FROM r)
SELECT doc_id, count(*) AS paragraphs, max(length(joined)) AS longest FROM e WHERE whole OR last GROUP BY doc_id""")
def m8_paragraph_fold(spark, sf_dir):
    cues = S.spoken_lines(_cues(spark, sf_dir), "doc_id", "subtitles")
    folded = S.collapsed(cues, "doc_id", "c").select("doc_id", S.paragraphs(F.col("c")).alias("p"))
    return folded.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.array_max(F.transform("p", F.length)).alias("longest"))


@query(r"""SELECT doc_id, length(list_aggregate(list_filter(list_transform(string_split(regexp_replace(text, '[<>:]', '', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')),
  lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$|-->|\b(align|position|size|line)\b')), 'string_agg', '')) AS spoken FROM documents WHERE text <> ''""")
def m9_subtitle_clean(spark, sf_dir):
    """Characters of what is spoken."""
    cues = S.spoken_lines(_cues(spark, sf_dir), "doc_id", "subtitles").groupBy("doc_id").agg(F.sum(F.length("_x")).alias("spoken"))
    return _cues(spark, sf_dir).select("doc_id").join(cues, "doc_id", "left").select("doc_id", F.col("spoken").cast("int").alias("spoken"))
