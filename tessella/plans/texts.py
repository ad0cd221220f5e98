"""Projections and normalisation of texts, addresses, times and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import urls
from tessella.plans import query
from tessella.session import table
from tessella.sources import chat, mail, posts


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _chat(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN '' ELSE role END AS sender, CASE WHEN turn % 4 = 3 THEN '' ELSE coalesce(text, '') END AS content FROM conversations""")
def p1_falsy_coalesce(spark, sf_dir):
    """First filled of several names of a column: null and empty fall through."""
    raw = _chat(spark, sf_dir).select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).when(F.col("turn") % 3 == 1, "").alias("sender_name"), F.when(F.col("turn") % 3 == 1, F.col("role")).otherwise("").alias("sender"),
        F.lit("").alias("content"), F.when(F.col("turn") % 4 != 3, F.col("text")).alias("message"),
    )
    return raw.select("conv_id", "turn", X.first_filled("sender_name", "sender").alias("sender"), X.first_filled("content", "message").alias("content"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN NULL ELSE user_id + 1 END AS likes FROM events""")
def p2_key_missing(spark, sf_dir):
    """A second key counts only where the first is missing: a null of the first wins."""
    first = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("user_id").alias("like_count"), F.lit(7).alias("likeCount"))))
    made = first.when(F.col("event_id") % 3 == 1, F.lit('{"like_count":null,"likeCount":7}')).otherwise(F.to_json(F.struct((F.col("user_id") + 1).alias("likeCount"))))
    return table(spark, sf_dir, "events").select("event_id", made.alias("raw")).select("event_id", posts.metric(posts.fields("raw"), "like_count", "likeCount").alias("likes"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN role || ' ' || text ELSE text END AS content FROM conversations""")
def p3_nested_content(spark, sf_dir):
    """Content that is a text, an object or a list of objects, as one text."""
    return chat.parse_messages(chat.as_export(_chat(spark, sf_dir))).select("conv_id", "turn", "content")


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN role || ' ' || text ELSE 'plain ' || text END AS content FROM conversations""")
def p4_rich_text(spark, sf_dir):
    """Rich text (lines of tagged segments), {"text": ...} or no JSON at all, as one text."""
    segment = lambda tag, t: F.struct(F.lit(tag).alias("tag"), t.alias("text"))
    rich = F.to_json(F.struct(F.array(F.array(segment("text", F.col("role")), segment("img", F.lit("gone"))), F.array(segment("a", F.col("text")))).alias("content")))
    raw = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct("text"))).when(F.col("turn") % 3 == 1, rich).otherwise(F.concat(F.lit("plain "), F.col("text")))
    return _chat(spark, sf_dir).select("conv_id", "turn", chat.rich_text(raw).alias("content"))


@query("""SELECT conv_id, turn, role AS sender, CASE WHEN turn % 3 = 1 AND turn % 5 = 4 THEN role || ' [图片]' WHEN turn % 3 = 1 THEN role || ' ' || text ELSE text END AS content, (1700000000 + turn)::VARCHAR AS timestamp
FROM conversations WHERE contains(role, 's') AND (turn % 5 <> 4 OR turn % 3 = 1)""")
def a5_chat_json(spark, sf_dir):
    """Exports of three shapes parsed, kept by sender, without placeholders and blanks."""
    return chat.kept(chat.parse_messages(chat.as_export(_chat(spark, sf_dir), spoil=True)), target="s").select("conv_id", "turn", "sender", "content", "timestamp")


@query("""WITH m AS (SELECT conv_id, turn, role, split_part(text, chr(10), 1) AS line FROM conversations)
SELECT conv_id, turn, role AS sender, trim(line) AS content, CASE turn % 2 WHEN 0 THEN '2024-1-5 10:00' ELSE '2024/1/5' END AS ts FROM m WHERE turn % 4 <> 3 AND contains(role, 'user') AND trim(line) <> ''
UNION ALL SELECT conv_id, turn, 'user', 'user said ' || trim(line), '' FROM m WHERE turn % 4 = 3 AND conv_id % 2 = 0""")
def a6_chat_txt(spark, sf_dir):
    """Lines of date, sender and content; other lines that name the target are its own, the rest go."""
    line = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    head = F.when(F.col("turn") % 2 == 0, "2024-1-5 10:00 ").otherwise("2024/1/5 ")
    colon = F.when(F.col("conv_id") % 2 == 0, "：").otherwise(": ")
    odd = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("user said "), line)).otherwise(F.concat(F.lit("nobody "), F.lit("spoke")))
    raw = _chat(spark, sf_dir).select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, odd).otherwise(F.concat(head, F.col("role"), colon, line)).alias("line"))
    return chat.parse_lines(raw, "line", "user").select("conv_id", "turn", "sender", "content", F.col("timestamp").alias("ts"))


@query("""WITH l AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS l FROM conversations), e AS (SELECT conv_id, turn, role, generate_subscripts(l, 1) - 1 AS place, trim(unnest(l)) AS line FROM l)
SELECT conv_id, turn, place, role AS sender, line AS content FROM e WHERE contains(role, 'user') AND line <> '' AND NOT regexp_matches(line, '^[:：]+$')""")
def a6_chat_lines(spark, sf_dir):
    """Every line of every message, as an export of lines with date and sender, parsed."""
    each = _chat(spark, sf_dir).select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("place", "text"))
    line = F.concat(F.lit("2024-1-5 10:00:01 "), F.col("role"), F.lit(": "), F.trim("text"))
    return chat.parse_lines(each.select("conv_id", "turn", "place", line.alias("line")), "line", "user").where("timestamp <> ''").select("conv_id", "turn", F.col("place").cast("long").alias("place"), "sender", "content")


@query("""SELECT event_id // 50 AS box, event_type || '@example.com' AS sender, 'no ' || event_id AS subject, strftime(ts, '%Y-%m-%d') AS date, 'value ' || user_id AS body FROM events""")
def a4_mail_txt(spark, sf_dir):
    """Text logs of fifty mails each, cut at rules that a From: follows."""
    block = F.concat(
        F.lit("From: "), F.col("event_type"), F.lit("@example.com\nTo: x\nSubject: no "), F.col("event_id"), F.lit("\nDate: "), F.date_format("ts", "yyyy-MM-dd"), F.lit("\n\nvalue "), F.col("user_id"),
        F.lit("\nCC: gone"),
    )
    boxes = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 50").alias("box")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("event_id", block.alias("b"))))["b"], "\n=====\n").alias("log"))
    return mail.parse_log(boxes, "log").select("box", F.col("from").alias("sender"), "subject", "date", "body")


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body FROM documents""")
def p7_quote_strip(spark, sf_dir):
    """Bodies with a quoted line, a forward or a rule put behind them, without these."""
    tail = F.when(F.col("doc_id") % 3 == 0, "\n> quoted\n> more").when(F.col("doc_id") % 3 == 1, "\n____\nfooter\nlines").otherwise("\n-----原始邮件-----\n")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.without_quotes(F.concat(F.col("text"), tail)), 256).alias("body"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)</(p|br|div|tr)\s*>|<(p|br|div|tr)(\s[^>]*)?/>', chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
SELECT page_id, sha256(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS body FROM c""")
def p8_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(mail.html_text("html"), 256).alias("body"))


@query("""SELECT event_id, 'a' || event_id || ' | x／y | ' AS row FROM events""")
def p9_record_rows(spark, sf_dir):
    """Records as rows of a Markdown table: lists joined, bars and line ends replaced, missing cells empty."""
    record = F.create_map(F.lit("name"), F.array(F.concat(F.lit("a"), F.col("event_id"))), F.lit("note"), F.array(F.lit("x|y")))
    fields = F.array(F.lit("name"), F.lit("note"), F.lit("none"))
    cell = lambda f: F.regexp_replace(F.translate(F.coalesce(F.array_join(F.try_element_at("rec", f), " "), F.lit("")), "|", "／"), "\n", " ")
    return table(spark, sf_dir, "events").select("event_id", record.alias("rec")).select("event_id", F.array_join(F.transform(fields, cell), " | ").alias("row"))


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 500 THEN regexp_replace(substr(t, 1, 497), '\s+$', '') || '...' ELSE t END AS content, length(t) > 500 AS truncated FROM c""")
def p10_clean_cap(spark, sf_dir):
    cut = X.capped("text", 500)
    return _docs(spark, sf_dir).select("doc_id", cut.alias("content"), (F.length(X.capped("text", 1 << 30)) > 500).alias("truncated"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'https://x.com/u' || user_id || '/status/' || event_id WHEN 1 THEN 'https://x.com/u' || user_id || '/status/' || event_id END AS url FROM events""")
def p11_permalink(spark, sf_dir):
    """Addresses of posts: by author, by their own address, or none (other host, other id, no number)."""
    own = F.concat(F.lit("https://www.twitter.com/u"), F.col("user_id"), F.lit("/status/"), F.col("event_id"))
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 5 == 4, "x1").otherwise(F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("u"), F.col("user_id"))).alias("name"),
        F.when(F.col("event_id") % 5 == 1, own).when(F.col("event_id") % 5 == 2, F.regexp_replace(own, "twitter", "example")).when(F.col("event_id") % 5 == 3, F.concat(own, F.lit("9"))).alias("raw"),
    )
    return raw.select("event_id", urls.permalink(F.col("id"), F.col("name"), F.col("raw")).alias("url"))


@query("""SELECT event_id::VARCHAR AS id, 'post ' || event_type AS content, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS published_at, 'https://x.com/u' || user_id || '/status/' || event_id AS url,
  user_id AS likes, NULL::BIGINT AS replies FROM events WHERE event_id % 4 <> 3""")
def p12_post(spark, sf_dir):
    """Posts of landed pages, normalised; those without text or with a strange id go."""
    return posts.normalised(posts.as_pages(table(spark, sf_dir, "events"))).select("id", "content", "published_at", "url", F.col("metrics")["likes"].alias("likes"), F.col("metrics")["replies"].alias("replies"))


@query("""SELECT event_id::VARCHAR AS id, 'event ' || user_id AS content, CASE event_id % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN event_type END AS language,
CASE event_id % 3 WHEN 0 THEN 'name_' || user_id ELSE 'page_' || user_id END AS username, event_id % 3 = 0 AS verified, 'untrusted_candidate_evidence' AS trust FROM events""")
def p12_post_fields(spark, sf_dir):
    """Language, author and mark of posts: languages that are no tag go, authors without a fitting name have that of the address."""
    k = F.col("event_id")
    address = F.concat(F.lit("https://x.com/page_"), F.col("user_id"), F.lit("/status/"), k)
    author = F.struct(F.when(k % 3 == 0, F.concat(F.lit("name_"), F.col("user_id"))).when(k % 3 == 1, "no name!").alias("username"), F.when(k % 3 == 0, True).alias("verified"))
    language = F.when(k % 4 == 0, "en-US").when(k % 4 == 1, F.col("event_type")).when(k % 4 == 2, "1x")
    post = F.struct(k.cast("string").alias("id"), F.concat(F.lit(" event "), F.col("user_id")).alias("text"), address.alias("url"), author.alias("author"), language.alias("lang"))
    pages = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.array(post).alias("tweets"))).alias("raw"))
    return posts.normalised(pages).select("id", "content", "language", "author.username", "author.verified", "trust")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN 'in ' || event_type END AS at FROM events""")
def p13_timestamp(spark, sf_dir):
    """Seconds become ISO times, other texts stay (cleaned), and blanks are null."""
    raw = F.when(F.col("event_id") % 3 == 0, F.unix_timestamp("ts").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" in "), F.col("event_type"))).otherwise(" ")
    return table(spark, sf_dir, "events").select("event_id", posts.iso_time(raw).alias("at"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS time FROM events""")
def p14_epoch_format(spark, sf_dir):
    """Milliseconds or seconds as text to minutes; what is no number stays."""
    raw = F.when(F.col("event_id") % 3 == 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.unix_timestamp("ts"), F.lit(".0002"))).otherwise("soon")
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.when(F.col("event_id") % 3 == 0, chat.minutes("raw", 1000)).otherwise(chat.minutes("raw", 1)).alias("time"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 THEN 'person-' || substr(sha256('张三' || c_custkey || '号'), 1, 0) || substr(sha256('张三号'), 1, 8) ELSE 'jose-' || lower(replace(c_name, '#', '-')) END AS slug FROM customer""")
def p15_slug(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 10 == 9, F.lit("张三号")).otherwise(F.concat(F.lit(" José / "), F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", X.slug(name).alias("slug"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE concat_ws(' ', CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END, n_name) END || CASE WHEN c_custkey % 3 = 0 THEN ', MBTI INTJ' ELSE '' END AS identity
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def p16_identity(spark, sf_dir):
    """Optional parts joined by spaces, a fallback without any, and a type behind."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    joined = F.concat_ws(" ", F.when(key % 2 == 1, F.col("c_mktsegment")), F.when(key % 4 != 0, F.col("n_name")))
    return people.select("c_custkey", F.concat(F.coalesce(F.nullif(joined, F.lit("")), F.lit("unknown")), F.when(key % 3 == 0, ", MBTI INTJ").otherwise("")).alias("identity"))


@query("""SELECT p_partkey, CASE WHEN lower(p_type) IN ('economy', 'standard') THEN 'colleague' WHEN lower(p_type) = 'promo' THEN 'celebrity' ELSE 'colleague' END AS family FROM part""")
def p17_alias(spark, sf_dir):
    """Names of families by their aliases, unknown ones the default."""
    known = F.create_map(*map(F.lit, ["economy", "colleague", "standard", "colleague", "promo", "celebrity"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(known, F.lower(F.trim("p_type"))), F.lit("colleague")).alias("family"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'old' ELSE event_type || ',c' END AS tags FROM events""")
def p18_tag_flatten(spark, sf_dir):
    """The new list of tags, else the old one, else personality and culture together."""
    k = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, F.array("event_type")).alias("tags"), F.when(k == 1, F.array(F.lit("old"))).alias("legacy"), F.array("event_type").alias("personality"), F.array(F.lit("c"), F.lit("")).alias("culture"))
    flat = F.coalesce("tags", "legacy", F.concat("personality", "culture"))
    return rows.select("event_id", F.array_join(F.filter(flat, lambda t: t != ""), ",").alias("tags"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'wiki' WHEN 1 THEN 'doc' WHEN 2 THEN 'sheet' WHEN 3 THEN 'base' ELSE 'unknown' END AS kind FROM pages""")
def p21_page_kind(spark, sf_dir):
    part = F.element_at(F.array(*map(F.lit, ["/wiki/", "/docx/", "/sheets/", "/base/", "/x/"])), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.page_kind(F.concat(F.regexp_extract("url", "^https?://[^/?#]+", 0), part, F.lit("t0k"))).alias("kind"))


@query("""SELECT doc_id, lpad((n_chars // 3600)::VARCHAR, 2, '0') || ':' || lpad((n_chars % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') AS clock FROM documents""")
def x12_clock(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.clock("n_chars").alias("clock"))


@query("""SELECT c_custkey, lower(replace(c_name, '#', '-')) AS name, 'new-' || c_custkey AS renamed FROM customer""")
def x14_front_matter(spark, sf_dir):
    """The name in a text's front matter, and that after it was rewritten."""
    text = F.concat(F.lit("---\nname: "), F.lower(F.regexp_replace("c_name", "#", "-")), F.lit("\ndescription: d\n---\nname: not this\n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    name = lambda c: F.regexp_extract(c, r"(?s)^---\n.*?name: ([^\n]*)\n", 1)
    new = F.concat(F.regexp_extract("text", r"(?s)^(---\n.*?name: )[^\n]*\n", 1), F.lit("new-"), F.col("c_custkey"), F.lit("\n"), F.regexp_extract("text", r"(?s)^---\n.*?name: [^\n]*\n(.*)", 1))
    return rows.select("c_custkey", name(F.col("text")).alias("name"), name(new).alias("renamed"))
