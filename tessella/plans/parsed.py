"""Notes and mails made of the documents' own lines, parsed by the library and, apart from it, in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import fixed
from tessella.functions import text as X
from tessella.operators import notes as N
from tessella.plans import query
from tessella.session import table
from tessella.sources import mail

_HEADINGS = ["Evidence", "Inferences (mine)", "Contradictions", "Gaps", "Patterns and repeated themes", "Source Metadata"]


def _notes(spark, sf_dir):
    """doc_id, topic, text: of seven lines of a document one is a heading, two are bullets, one each a quote, a weight, an address and speech."""
    k = F.col("doc_id")

    def line(x, i):
        turn, names = i % 7, F.array(*map(F.lit, _HEADINGS), x)
        heading = F.concat(F.lit("## "), F.element_at(names, (F.pmod(F.floor(i / 7) + k, F.lit(7)) + 1).cast("int")))
        out = F.when(turn == 0, heading).when(turn.isin(1, 2), F.concat(F.lit("- "), x)).when(turn == 3, F.concat(F.lit("> "), x))
        out = out.when(turn == 4, F.concat(x, F.lit(" Source weight: "), (F.length(x) % 9).cast("string"))).when(turn == 5, F.concat(F.lit("- see https://example.org/"), F.replace(x, F.lit(" "), F.lit("-")), F.lit(" (there)")))
        return out.otherwise(F.concat(F.lit('"'), x, F.lit('"')))

    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


_LINE = f"""CASE (i - 1) % 7 WHEN 0 THEN '## ' || list_append({_HEADINGS}, l)[((i - 1) // 7 + doc_id) % 7 + 1] WHEN 1 THEN '- ' || l WHEN 2 THEN '- ' || l WHEN 3 THEN '> ' || l
  WHEN 4 THEN l || ' Source weight: ' || (length(l) % 9) WHEN 5 THEN '- see https://example.org/' || replace(l, ' ', '-') || ' (there)' ELSE '"' || l || '"' END"""
_SQL = rf"""d AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
notes AS (SELECT doc_id, any_value(source) AS topic, string_agg({_LINE}, chr(10) ORDER BY i) AS text FROM d GROUP BY doc_id),
cut AS (SELECT doc_id, topic, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM notes),
bare AS (SELECT doc_id, topic, line_no, regexp_replace(l, '^\s+|\s+$', '', 'g') AS line FROM cut),
headed AS (SELECT *, CASE WHEN regexp_matches(line, '^##\s+.+$') THEN lower(trim(regexp_extract(line, '^##\s+(.+)$', 1))) END AS heading FROM bare),
lines AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS section, heading IS NULL AND starts_with(line, '- ') AS bullet FROM headed)"""


@query(f"""WITH {_SQL} SELECT doc_id, count(*) FILTER (heading = 'source metadata') AS metadata_blocks, count(*) FILTER (bullet AND section = 'contradictions') AS contradictions, count(*) FILTER (bullet AND starts_with(section, 'inferences')) AS inferences,
  count(*) FILTER (bullet AND section = 'patterns and repeated themes') AS patterns, count(*) FILTER (bullet AND (starts_with(section, 'gaps') OR starts_with(section, 'missing information'))) AS gaps FROM lines GROUP BY doc_id""")
def g2_note_sections(spark, sf_dir):
    return N.section_metrics(N.note_lines(_notes(spark, sf_dir), "doc_id"), "doc_id")


@query(f"""WITH {_SQL} SELECT topic, w AS weight, count(*) AS n FROM (SELECT topic, unnest(regexp_extract_all(text, '(?i)source weight:\\s*(\\d)', 1)) AS w FROM notes) WHERE w BETWEEN '1' AND '7' GROUP BY ALL""")
def g3_note_weights(spark, sf_dir):
    return _notes(spark, sf_dir).select("topic", F.explode(N.weights("text")).alias("weight")).groupBy("topic", "weight").agg(F.count("*").alias("n"))


@query(f"""WITH {_SQL} SELECT topic, count(*) AS mentions, count(DISTINCT u) AS distinct_urls FROM (SELECT topic, unnest(regexp_extract_all(text, 'https?://[^\\s)]+')) AS u FROM notes) GROUP BY topic""")
def g5_note_urls(spark, sf_dir):
    found = _notes(spark, sf_dir).select("topic", F.explode(F.regexp_extract_all("text", F.lit(fixed.NOTE_URL), F.lit(0))).alias("url"))
    return found.groupBy("topic").agg(F.count("*").alias("mentions"), F.countDistinct("url").alias("distinct_urls"))


@query(rf"""WITH {_SQL} SELECT doc_id, count(*) FILTER (starts_with(line, '>') OR regexp_matches(line, '\b\d{{2}}:\d{{2}}:\d{{2}}')
  OR (regexp_matches(line, '["“”'']') AND len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')) > 25)) AS long_quotes FROM bare GROUP BY doc_id""")
def g7_note_quotes(spark, sf_dir):
    return N.note_lines(_notes(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count_if(N.long_quote("line")).alias("long_quotes"))


@query(f"""WITH {_SQL} SELECT doc_id, line_no, md5(trim(substr(line, 3))) AS finding FROM lines WHERE bullet AND section IN ('evidence', 'key findings', 'paraphrased findings', 'patterns and repeated themes')""")
def m14_note_findings(spark, sf_dir):
    return N.findings(N.note_lines(_notes(spark, sf_dir), "doc_id")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("finding").alias("finding"))


@query(rf"""WITH {_SQL} SELECT doc_id, NOT (contains(text, '```') OR regexp_matches(text, '(?m)^\s*>') OR regexp_matches(text, '\b\d{{2}}:\d{{2}}:\d{{2}}')) AS safe FROM notes""")
def f10_note_safe(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", X.copyright_safe("text").alias("safe"))


@query(rf"""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, string_agg(CASE WHEN i % 3 = 0 THEN '> ' || l ELSE l END, chr(10) ORDER BY i) AS text FROM d GROUP BY doc_id),
b AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n>[^\n]*', '', 'g'), '(?s)\n_{{3,}}\n.*', '') AS body FROM m)
SELECT doc_id, 'Über ' || doc_id AS subject, md5(regexp_replace(body, '^\s+|\s+$', '', 'g')) AS body FROM b WHERE regexp_replace(body, '^\s+|\s+$', '', 'g') <> ''""")
def a2_mail_bodies(spark, sf_dir):
    """Mails whose encoded body is a document with every third line quoted, decoded and without the quotes."""
    quoted = F.array_join(F.transform(F.split("text", "\n"), lambda l, i: F.when(i % 3 == 2, F.concat(F.lit("> "), l)).otherwise(l)), "\n")
    subject = F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(F.concat(F.lit("Über "), F.col("doc_id")), "utf-8")), F.lit("?="))
    raw = F.concat(F.lit("From: u@example.com\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\nSubject: "), subject, F.lit("\n\n"), F.base64(F.encode(quoted, "utf-8")), F.lit("\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode(raw, "utf-8").alias("raw"))
    return mail.parsed(rows, "raw", "example").select("doc_id", "subject", F.md5("body").alias("body"))
