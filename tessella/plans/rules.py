"""Rules that can be counted: language, recurrence, gates, merges and precedence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import fixed
from tessella.functions import text as X
from tessella.operators import ranking
from tessella.plans import query
from tessella.session import table

_SPACES = r"[\x20\x09-\x0D]+"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _words(spark, sf_dir, *columns):
    # Blanks go after the explode, in generated code: a lambda over each array would be interpreted.
    return _docs(spark, sf_dir).select(*columns, F.explode(F.split("text", _SPACES)).alias("word")).where("word <> ''")


@query(rf"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split_regex(text, '{_SPACES}')) AS word FROM documents) WHERE word <> '' GROUP BY ALL HAVING count(*) >= 3")
def r1_frequent_words(spark, sf_dir):
    return _words(spark, sf_dir, "lang").groupBy("lang", "word").agg(F.count("*").alias("n")).where("n >= 3")


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]+')) AS s FROM documents), c AS (SELECT doc_id, count(*) AS sentences, sum(length(s)) AS chars FROM s WHERE s <> '' GROUP BY doc_id)
SELECT doc_id, sentences, CASE WHEN chars < 15 * sentences THEN 'short' WHEN chars <= 40 * sentences THEN 'medium' ELSE 'long' END AS class FROM c""")
def r2_sentence_len(spark, sf_dir):
    """Texts by the mean length of their sentences: under 15 short, to 40 medium, else long."""
    sentences = F.filter(F.split("text", "[.!?]+"), lambda s: s != "")
    counted = _docs(spark, sf_dir).select("doc_id", sentences.alias("s")).select("doc_id", F.size("s").cast("long").alias("sentences"), F.length(F.array_join("s", "")).alias("chars")).where("sentences > 0")
    kind = F.when(F.col("chars") < 15 * F.col("sentences"), "short").when(F.col("chars") <= 40 * F.col("sentences"), "medium").otherwise("long")
    return counted.select("doc_id", "sentences", kind.alias("class"))


@query(r"""SELECT lang, sum(length(text) - length(replace(text, '!', '')))::BIGINT AS shouts, sum(len(regexp_extract_all(lower(text), '\bnot\b|\bmais\b|\baber\b|\bpero\b|\bwith\b')))::BIGINT AS contrasts, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang""")
def r3_punctuation(spark, sf_dir):
    """Marks and contrasting words by language, as counts over characters."""
    contrast = F.regexp_count(F.lower("text"), F.lit(r"\bnot\b|\bmais\b|\baber\b|\bpero\b|\bwith\b"))
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit("!"))).alias("shouts"), F.sum(contrast).alias("contrasts"), F.sum(F.length("text")).alias("chars"))


_SHOWN = {"!": "👍🏽", "?": "👨‍👩‍👧", ".": "🇫🇷", ",": "1️⃣"}


@query("""SELECT source, sum(length(text) - length(replace(text, '!', '')))::BIGINT AS shouts, sum(length(text) - length(translate(text, '!?.,', '')))::BIGINT AS emoji,
round_even(1000.0 * sum(length(text) - length(translate(text, '!?.,', ''))) / sum(length(text)), 0)::BIGINT AS per_thousand FROM documents GROUP BY source""")
def r3_emoji_density(spark, sf_dir):
    """Emoji by source, as counts over characters; marks of the texts are turned into emoji of several code points."""
    text = F.col("text")
    for mark, emoji in _SHOWN.items():
        text = F.replace(text, F.lit(mark), F.lit(emoji))
    counted = _docs(spark, sf_dir).select("source", "text", X.emoji_count(text).alias("emoji"))
    summed = counted.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("!"))).alias("shouts"), F.sum("emoji").alias("emoji"), F.sum(F.length("text")).alias("chars"))
    return summed.select("source", "shouts", "emoji", F.bround(1000.0 * F.col("emoji") / F.col("chars"), 0).cast("long").alias("per_thousand"))


@query(rf"""WITH c AS (SELECT word, count(DISTINCT source) AS contexts FROM (SELECT source, unnest(string_split_regex(text, '{_SPACES}')) AS word FROM documents) WHERE word <> '' GROUP BY word)
SELECT CASE WHEN contexts >= 3 THEN 'conflict' WHEN contexts >= 2 THEN 'recurs' ELSE 'once' END AS kind, count(*) AS words, sum(contexts)::BIGINT AS contexts FROM c GROUP BY ALL""")
def r4_context_rules(spark, sf_dir):
    """Words that recur (two sources) and that can stand against another account (three)."""
    contexts = _docs(spark, sf_dir).select("source", F.explode(F.split("text", _SPACES)).alias("word")).where("word <> ''").distinct().groupBy("word").agg(F.count("source").alias("contexts"))
    kind = F.when(F.col("contexts") >= fixed.CONFLICT_SOURCES, "conflict").when(F.col("contexts") >= fixed.RECURRENT_CONTEXTS, "recurs").otherwise("once")
    return contexts.groupBy(kind.alias("kind")).agg(F.count("*").alias("words"), F.sum("contexts").alias("contexts"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS urls, 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) AS ratio, count(DISTINCT o_orderpriority) AS tensions FROM orders GROUP BY o_custkey)
SELECT o_custkey, concat_ws(',', CASE WHEN ratio < 50 THEN 'primary' END, CASE WHEN urls < 8 THEN 'urls' END, CASE WHEN tensions < 3 THEN 'tensions' END) AS reasons FROM c""")
def r8_audit_rules(spark, sf_dir):
    """Why the evidence on a customer fails an audit: under half of it primary, fewer than eight pieces, fewer than three kinds."""
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("urls"), F.count_if(F.col("o_orderstatus") == "F").alias("p"), F.countDistinct("o_orderpriority").alias("tensions"))
    least = fixed.AUDIT_LEAST
    why = F.concat_ws(",", F.when(100.0 * F.col("p") / F.col("urls") < least["primary"], "primary"), F.when(F.col("urls") < least["urls"], "urls"), F.when(F.col("tensions") < least["tensions"], "tensions"))
    return counted.select("o_custkey", why.alias("reasons"))


@query("""WITH k AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'model' WHEN 'click' THEN 'heuristic' WHEN 'error' THEN 'tension' END AS kind, user_id % 4 = 0 AS cold FROM events),
c AS (SELECT user_id, kind, cold, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL)
SELECT user_id, kind, n, CASE kind WHEN 'model' THEN n BETWEEN CASE WHEN cold THEN 2 ELSE 3 END AND CASE WHEN cold THEN 3 ELSE 7 END WHEN 'heuristic' THEN n BETWEEN 5 AND 10 ELSE n >= 2 END AS fits FROM c""")
def r15_cardinality_rules(spark, sf_dir):
    """Counts of models, heuristics and tensions against the bounds of their kind; figures of whom little is known have other ones for models."""
    kind = F.when(F.col("event_type") == "view", "model").when(F.col("event_type") == "click", "heuristic").when(F.col("event_type") == "error", "tension")
    counted = table(spark, sf_dir, "events").select("user_id", kind.alias("kind")).where("kind IS NOT NULL").groupBy("user_id", "kind").agg(F.count("*").alias("n"))
    name = F.when((F.col("kind") == "model") & (F.col("user_id") % 4 == 0), "cold_model").otherwise(F.col("kind"))
    bound = F.element_at(F.create_map(*(x for k, (lo, hi) in fixed.CARDINALITY.items() for x in (F.lit(k), F.array(F.lit(lo), F.lit(hi))))), name)
    return counted.select("user_id", "kind", "n", (F.col("n") >= bound[0]) & F.coalesce(F.col("n") <= bound[1], F.lit(True))).toDF("user_id", "kind", "n", "fits")


@query(rf"SELECT word, count(DISTINCT source) AS contexts FROM (SELECT source, unnest(string_split_regex(text, '{_SPACES}')) AS word FROM documents) WHERE word <> '' GROUP BY word HAVING count(DISTINCT source) >= 15")
def r4_recurrence(spark, sf_dir):
    """Words that stand in fifteen of the sources or more."""
    return _words(spark, sf_dir, "source").distinct().groupBy("word").agg(F.count("*").alias("contexts")).where("contexts >= 15")


@query("""SELECT doc_id, CASE quality + (1 - toxic) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END WHEN 3 THEN 'keep' WHEN 0 THEN 'discard' ELSE 'demote' END AS verdict FROM labels""")
def r5_gate(spark, sf_dir):
    """Three tests: all passed keep, none discard, else demote."""
    passes = F.col("quality") + (1 - F.col("toxic")) + (F.col("doc_id") % 2 == 0).cast("int")
    return table(spark, sf_dir, "labels").select("doc_id", F.when(passes == 3, "keep").when(passes == 0, "discard").otherwise("demote").alias("verdict"))


@query("SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS sources, count(*) < 10 AS cold FROM pages GROUP BY 1")
def r6_cold_figure(spark, sf_dir):
    """Subjects (hosts) with fewer than ten sources."""
    hosts = table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("sources"))
    return hosts.withColumn("cold", F.col("sources") < 10)


@query("""SELECT lang AS dimension, count(*) AS sources, round_even(100.0 * count(*) FILTER (doc_id % 3 = 0) / count(*), 0)::BIGINT AS ratio FROM documents GROUP BY lang
UNION ALL SELECT 'all', count(*), round_even(100.0 * count(*) FILTER (doc_id % 3 = 0) / count(*), 0)::BIGINT FROM documents""")
def r7_checkpoint_matrix(spark, sf_dir):
    """Sources and share of primary ones by dimension, and in all."""
    rolled = _docs(spark, sf_dir).rollup("lang").agg(F.grouping("lang").alias("g"), F.count("*").alias("sources"), X.percent(F.count_if(F.col("doc_id") % 3 == 0), F.count("*")).alias("ratio"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("lang")).alias("dimension"), "sources", "ratio")


@query("""WITH c AS (SELECT source, lang, count(*) AS sources, round_even(100.0 * count(*) FILTER (doc_id % 3 = 0) / count(*), 0)::BIGINT AS ratio FROM documents GROUP BY ALL)
SELECT source, sum(sources)::BIGINT AS sources, coalesce(string_agg(lang, ',' ORDER BY lang) FILTER (ratio < 50), '') AS thin FROM c GROUP BY source""")
def r7_thin_dimensions(spark, sf_dir):
    """Dimensions of each topic under half of whose sources are primary, to be filled up."""
    each = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("sources"), X.percent(F.count_if(F.col("doc_id") % 3 == 0), F.count("*")).alias("ratio"))
    thin = F.array_join(F.sort_array(F.collect_list(F.when(F.col("ratio") < fixed.AUDIT_LEAST["primary"], F.col("lang")))), ",")
    return each.groupBy("source").agg(F.sum("sources").alias("sources"), thin.alias("thin"))


@query("""WITH c AS (SELECT source, count(*) AS n, 100.0 * count(*) FILTER (doc_id % 3 = 0) / count(*) AS ratio, count(DISTINCT lang) AS tensions, bool_or(doc_id % 97 = 0) AS listed FROM documents GROUP BY source)
SELECT source, concat_ws(',', CASE WHEN ratio < 34 THEN 'primary' END, CASE WHEN n < 50 THEN 'urls' END, CASE WHEN tensions < 4 THEN 'tensions' END, CASE WHEN listed THEN 'blacklist' END) AS reasons FROM c""")
def r8_audit(spark, sf_dir):
    """Why an audit of a source fails; empty where it passes."""
    counted = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 3 == 0).alias("p"), F.countDistinct("lang").alias("t"), F.bool_or(F.col("doc_id") % 97 == 0).alias("listed"))
    why = F.concat_ws(",", F.when(100.0 * F.col("p") / F.col("n") < 34, "primary"), F.when(F.col("n") < 50, "urls"), F.when(F.col("t") < 4, "tensions"), F.when(F.col("listed"), "blacklist"))
    return counted.select("source", why.alias("reasons"))


@query("""WITH o AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT CASE WHEN o.v IS NULL THEN 'adds' WHEN o.v = n.v THEN 'confirms' ELSE 'contradicts' END AS kind, count(*) AS n FROM n LEFT JOIN o USING (user_id, event_type) GROUP BY ALL""")
def r9_merge_delta(spark, sf_dir):
    """What new material adds to, confirms or contradicts of the old."""
    events = table(spark, sf_dir, "events")
    fact = lambda rows, name: rows.groupBy("user_id", "event_type").agg(F.max("value").alias(name))
    old, new = fact(events.where("event_id % 2 = 0"), "o"), fact(events.where("event_id % 2 = 1"), "v")
    kind = F.when(F.col("o").isNull(), "adds").when(F.col("o") == F.col("v"), "confirms").otherwise("contradicts")
    return new.join(old, ["user_id", "event_type"], "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type AS fact, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_id % 7 = 0) DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def r10_fact_precedence(spark, sf_dir):
    """Of each fact what an interview says, else the newest."""
    best = F.max_by("event_id", F.struct(F.col("event_id") % 7 == 0, "ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("fact")).agg(best.alias("event_id"))


@query("SELECT lower(regexp_extract(url, '^https?://(?:www\\.|m\\.)?([^/?#]+)', 1)) AS account, min(page_id) AS page_id FROM pages GROUP BY 1")
def r11_same_account(spark, sf_dir):
    account = F.lower(F.regexp_extract("url", r"^https?://(?:www\.|m\.)?([^/?#]+)", 1))
    return table(spark, sf_dir, "pages").groupBy(account.alias("account")).agg(F.min("page_id").alias("page_id"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 50")
def r12_correction_cap(spark, sf_dir):
    return ranking.first_n(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], [F.desc("event_id")], 50)


@query("""SELECT user_id, min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 4 WHEN 'view' THEN 5 ELSE 7 END) AS tier FROM events GROUP BY user_id""")
def r13_weight_tier(spark, sf_dir):
    """The best weight of the sources of each user; the smaller number wins (r17)."""
    weight = F.create_map(*map(F.lit, ["purchase", 1, "signup", 2, "click", 4, "view", 5]))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.coalesce(F.try_element_at(weight, F.col("event_type")), F.lit(7))).alias("tier"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, lang, n, n BETWEEN lo AND hi AS fits FROM c JOIN (VALUES ('en', 10, 40), ('fr', 3, 7), ('de', 5, 10), ('es', 2, 60)) b(lang, lo, hi) USING (lang)""")
def r15_cardinality(spark, sf_dir):
    """Counts by kind against the bounds of each kind."""
    bounds = spark.createDataFrame([("en", 10, 40), ("fr", 3, 7), ("de", 5, 10), ("es", 2, 60)], "lang string, lo int, hi int")
    counted = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(bounds), "lang").select("source", "lang", "n", F.col("n").between(F.col("lo"), F.col("hi")).alias("fits"))


@query("""SELECT user_id, count(DISTINCT event_type) >= 3 AS confirmed FROM events WHERE value > 30 GROUP BY user_id""")
def r16_marker_contexts(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value > 30").groupBy("user_id").agg((F.countDistinct("event_type") >= 3).alias("confirmed"))


@query("""WITH v AS (SELECT user_id, event_type AS name, bool_and(value > 1) FILTER (ts < TIMESTAMP '2024-01-16') AS prev, bool_and(value > 1) FILTER (ts >= TIMESTAMP '2024-01-16') AS cur FROM events GROUP BY ALL) SELECT user_id, name FROM v WHERE prev AND NOT cur""")
def r18_gate_regression(spark, sf_dir):
    """Checks that passed in the first half and no longer do."""
    ok = F.col("value") > 1
    half = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.bool_and(F.when(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00")), ok)).alias("prev"), F.bool_and(F.when(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00")), ok)).alias("cur"))
    return half.where("prev AND NOT cur").select("user_id", "name")


@query("""SELECT l.doc_id, CASE WHEN l.doc_id % 5 = 0 THEN 'manual' ELSE 'analysis' END AS used, l.doc_id % 5 = 0 AND (l.doc_id % 2) <> l.quality AS conflict FROM labels l JOIN documents USING (doc_id)""")
def r19_manual_wins(spark, sf_dir):
    """A manual tag (of every fifth document) beats the analysis; where they differ it is flagged."""
    manual = _docs(spark, sf_dir).where("doc_id % 5 = 0").select("doc_id", (F.col("doc_id") % 2).alias("tag"))
    rows = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id"), "doc_id").join(manual, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("tag").isNotNull(), "manual").otherwise("analysis").alias("used"), F.coalesce(F.col("tag") != F.col("quality"), F.lit(False)).alias("conflict"))


@query("""SELECT o_orderkey, coalesce(rule, 'none') AS rule FROM orders LEFT JOIN (VALUES ('1-URGENT', 'answers at once'), ('2-HIGH', 'asks back'), ('5-LOW', 'waits')) r(p, rule) ON o_orderpriority = p""")
def r20_tag_rules(spark, sf_dir):
    """The rule of behaviour of each tag."""
    rules = spark.createDataFrame([("1-URGENT", "answers at once"), ("2-HIGH", "asks back"), ("5-LOW", "waits")], "p string, rule string")
    return table(spark, sf_dir, "orders").join(F.broadcast(rules), F.col("o_orderpriority") == F.col("p"), "left").select("o_orderkey", F.coalesce("rule", F.lit("none")).alias("rule"))


@query("SELECT word FROM (SELECT word, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '[\\x20\\x09-\\x0D]+')) AS word FROM documents) WHERE word <> '' GROUP BY word) WHERE n < 2")
def r21_thin_layers(spark, sf_dir):
    """Words with fewer than two supporting documents."""
    return _words(spark, sf_dir, "doc_id").groupBy("word").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a = b").select("word")


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'L1' WHEN p_size <= 25 THEN 'L2' ELSE 'L3' END AS level FROM part""")
def r22_level_equivalence(spark, sf_dir):
    """Levels of a company by a table of ranges."""
    levels = spark.createDataFrame([(0, 10, "L1"), (11, 25, "L2"), (26, 1 << 30, "L3")], "lo int, hi int, level string")
    return table(spark, sf_dir, "part").join(F.broadcast(levels), F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "level")


@query("""SELECT source, count(*) >= 40 AND count(DISTINCT lang) >= 4 AND sum(n_chars) >= 100000 AS floors_met FROM documents GROUP BY source""")
def r14_floors(spark, sf_dir):
    """Whether the research of each source reaches its floors."""
    met = (F.count("*") >= 40) & (F.countDistinct("lang") >= 4) & (F.sum("n_chars") >= 100_000)
    return _docs(spark, sf_dir).groupBy("source").agg(met.alias("floors_met"))


@query("""SELECT user_id, arg_min(event_id, (CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 4 WHEN 'view' THEN 5 ELSE 7 END)::BIGINT * 1000000000 + event_id) AS event_id FROM events GROUP BY user_id""")
def r17_weight_conflict(spark, sf_dir):
    """Of conflicting sources that of the smaller weight wins, the earlier of equal ones."""
    weight = F.create_map(*map(F.lit, ["purchase", 1, "signup", 2, "click", 4, "view", 5]))
    order = F.struct(F.coalesce(F.try_element_at(weight, F.col("event_type")), F.lit(7)), "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", order).alias("event_id"))
