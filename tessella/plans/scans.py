"""Trees, pages, fallbacks, grids and configuration files, landed as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import fixed, steps
from tessella.operators import directory, ranking
from tessella.plans import query
from tessella.session import table
from tessella.sources import configs, mail, markup


def _tree(spark, sf_dir):
    """parent -> child: regions, nations and customers as departments and people."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    edge = lambda parent, child: F.struct(parent.alias("parent"), child.alias("child"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    top = region.select(edge(F.lit("root"), name("r", "r_regionkey")).alias("e"))
    middle = nation.select(edge(name("r", "n_regionkey"), name("n", "n_nationkey")).alias("e"))
    low = table(spark, sf_dir, "customer").select(edge(name("n", "c_nationkey"), name("c", "c_custkey")).alias("e"))
    return top.union(middle).union(low).select("e.*", F.lit(0).cast("long").alias("ord"))


_TREE = """t AS (SELECT 'root' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""


@query(f"WITH RECURSIVE {_TREE}, w AS (SELECT 'root' AS node, 0 AS depth UNION ALL SELECT t.child, w.depth + 1 FROM w JOIN t ON t.parent = w.node WHERE w.depth < 10) SELECT node, depth FROM w")
def a12_directory_walk(spark, sf_dir):
    """Breadth-first walk of the directory; each level is one join."""
    return directory.walk(_tree(spark, sf_dir), "root").select("node", "depth")


@query(f"WITH RECURSIVE {_TREE}, w AS (SELECT 'root' AS node, 0 AS depth UNION ALL SELECT t.child, w.depth + 1 FROM w JOIN t ON t.parent = w.node WHERE w.depth < 2) SELECT node, depth FROM w")
def a13_bounded_walk(spark, sf_dir):
    return directory.walk(_tree(spark, sf_dir), "root", 2).select("node", "depth")


_BELOW = """e AS (SELECT c_custkey // 2 AS parent, c_custkey AS child FROM customer WHERE c_custkey > 0 UNION ALL SELECT c_custkey, c_custkey // 4 FROM customer WHERE c_custkey % 7 = 0)"""


@query(f"""WITH RECURSIVE {_BELOW}, w(node) AS (SELECT 0::BIGINT UNION SELECT e.child FROM w JOIN e ON e.parent = w.node),
h AS (SELECT o_custkey AS department, o_orderkey AS user_id FROM orders JOIN w ON w.node = o_custkey WHERE contains('c' || o_orderkey, '77') OR contains(o_orderpriority || o_custkey, '77')),
d AS (SELECT department, sum(n) OVER (ORDER BY department) - n AS before FROM (SELECT department, count(*) AS n FROM h GROUP BY department))
SELECT department, CASE WHEN department = 0 THEN 0 ELSE length(bin(department)) END AS depth, user_id FROM h JOIN d USING (department) WHERE before < 10""")
def a12_directory_search(spark, sf_dir):
    """The first ten and more users by either name, department by department, in a directory with cycles that is over ten levels deep."""
    key = F.col("c_custkey").cast("long")
    customers = table(spark, sf_dir, "customer")
    down = customers.where("c_custkey > 0").select(F.expr("c_custkey div 2").alias("parent"), key.alias("child"), key.alias("ord"))
    back = customers.where("c_custkey % 7 = 0").select(key.alias("parent"), F.expr("c_custkey div 4").alias("child"), F.lit(-1).cast("long").alias("ord"))
    users = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("long").alias("department"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("user_id"),
        F.concat(F.lit("c"), "o_orderkey").alias("name"), F.concat("o_orderpriority", "o_custkey").alias("en_name"),
    )
    found = directory.search(down.union(back), users, 0, directory.named("77", "name", "en_name"), enough=10)
    return found.select("department", "depth", "user_id")


@query("""SELECT department, depth, c_custkey AS user_id FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY c_custkey) AS n FROM (
  SELECT 'n' || c_nationkey AS department, 2 AS depth, c_custkey, c_name FROM customer UNION ALL SELECT 'n' || c_nationkey || c_mktsegment, 3, c_custkey, c_name FROM customer))
WHERE n <= 100 AND contains(c_name, '7')""")
def a13_bounded_search(spark, sf_dir):
    """Users by name down to the third level, of each department the first hundred that it lists; the fourth level isn't read."""
    customers = table(spark, sf_dir, "customer")
    nation, segment = F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("n"), "c_nationkey", "c_mktsegment")
    below = customers.select(nation.alias("parent"), segment.alias("child")).union(customers.select(segment, F.concat(F.lit("last"), segment))).distinct()
    edges = _tree(spark, sf_dir).where("child NOT LIKE 'c%'").union(below.withColumn("ord", F.lit(0).cast("long")))
    listed = lambda department: customers.select(department.alias("department"), F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    users = listed(nation).union(listed(segment)).union(listed(F.concat(F.lit("last"), segment)))
    return directory.search(edges, users, "root", directory.named("7", "name"), deepest=3, page=100).select("department", "depth", "user_id")


@query("""SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events) WHERE event_type <> 'error' OR n < 150""")
def a10_cursor_pages(spark, sf_dir):
    """Rows of the landed pages of each channel, fifty a page, up to the first page without a next cursor; one channel's third page has none."""
    numbered = ranking.numbered(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", ["event_id"])
    paged = numbered.select("event_type", "event_id", F.expr("(n - 1) div 50").alias("page"))
    cursor = F.when((F.col("event_type") != "error") | (F.col("page") != 2), "next")
    pages = paged.groupBy("event_type", "page").agg(F.to_json(F.collect_list(F.struct("event_id"))).alias("items")).withColumn("cursor", cursor)
    last = pages.where("cursor IS NULL").groupBy("event_type").agg(F.min("page").alias("last"))
    reached = pages.join(last, "event_type", "left").where("last IS NULL OR page <= last")
    return reached.select("event_type", F.explode(F.from_json("items", "array<struct<event_id:long>>")).alias("i")).select("event_type", "i.event_id")


@query("""SELECT event_id, '| ' || json_extract_string(props, '$.k') || ' |  |' AS line FROM events WHERE event_id % 300 < CASE WHEN event_id // 300 % 2 = 0 THEN 100 ELSE 200 END""")
def a17_sheet_rows(spark, sf_dir):
    """Records of sheets as rows of their fields, also of one that they lack: the first hundred of a sheet of one provider, two hundred of the other's."""
    records = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 300").alias("tab"), F.from_json("props", "map<string,string>").alias("cells"))
    first = ranking.first_n(records, ["tab"], ["event_id"], F.when(F.col("tab") % 2 == 0, 100).otherwise(200), most=200)
    fields = first.select("tab").distinct().select("tab", F.posexplode(F.array(F.lit("k"), F.lit("missing"))).alias("place", "field"))
    cell = F.translate(F.regexp_replace(F.coalesce(F.try_element_at("cells", F.col("field")), F.lit("")), r"\|", "｜"), "\n", " ")
    each = first.join(fields, "tab").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("place", cell.alias("cell")))).alias("row"))
    return each.select("event_id", F.concat(F.lit("| "), F.array_join(F.transform("row", lambda c: c["cell"]), " | "), F.lit(" |")).alias("line"))


@query("""WITH w AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY source LIMIT 5),
n AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents JOIN w USING (source))
SELECT doc_id, source FROM n WHERE n <= 20 AND (doc_id % 4 = 0 OR lang = 'en') ORDER BY source, doc_id DESC LIMIT 60""")
def a14_workspace_fallback(spark, sf_dir):
    """Documents of a creator (or of unknown creator) by a search; as it finds none, among the twenty newest of each of five workspaces, sixty in all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("creator"))
    own = F.coalesce(F.col("creator") == "en", F.lit(True))
    search = docs.where(F.col("source") == "a source that nobody has").where(own)

    def walked():
        # Five rows, so safe to send to every task.
        spaces = docs.where("source IS NOT NULL").select("source").distinct().orderBy("source").limit(5)
        return ranking.first_n(docs.join(F.broadcast(spaces), "source", "left_semi"), ["source"], [F.desc("doc_id")], 20).where(own)

    return ranking.first_filled(search, walked).orderBy("source", F.desc("doc_id")).limit(60).select("doc_id", "source")


@query("""SELECT doc_id, source FROM documents WHERE source = 'src3' AND doc_id % 2 = 0
UNION ALL SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents WHERE source IN ('src4', 'src5')) WHERE n <= 20 AND NOT EXISTS (SELECT 1 FROM documents WHERE source = 'src3' AND doc_id % 2 = 0)""")
def a14_search_or_walk(spark, sf_dir):
    """Documents that a search finds; only where it finds none, the newest twenty of some workspaces."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = docs.where("source = 'src3' AND doc_id % 2 = 0")
    walked = ranking.first_n(docs.where("source IN ('src4', 'src5')"), ["source"], [F.desc("doc_id")], 20)
    any_ = found.agg(F.count("*").alias("n"))
    return found.unionByName(walked.join(F.broadcast(any_), F.col("n") == 0).drop("n"))


@query("""SELECT d.doc_id, coalesce(b.text, d.text) = b.text AS from_wiki, length(coalesce(b.text, d.text)) AS chars FROM documents d LEFT JOIN benchmark b ON d.doc_id % 100 = b.item_id AND d.doc_id % 2 = 0""")
def a16_hydrate(spark, sf_dir):
    """Content of references: some point to an object (a benchmark item) that holds it."""
    docs = table(spark, sf_dir, "documents").withColumn("ref", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 100))
    held = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("held"))
    joined = docs.join(held, F.col("ref") == F.col("item_id"), "left")
    content = F.coalesce("held", "text")
    return joined.select("doc_id", (content == F.col("held")).alias("from_wiki"), F.length(content).alias("chars"))


@query("""SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS cell FROM events WHERE event_id % 300 < 100""")
def a17_sheet_records(spark, sf_dir):
    """Cells of the first hundred records of each table of three hundred."""
    rows = table(spark, sf_dir, "events").withColumn("tab", F.expr("event_id div 300"))
    first = ranking.first_n(rows, ["tab"], ["event_id"], 100)
    return first.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "cell"))


@query("""SELECT page_id, i AS n, item FROM (SELECT page_id, unnest(l) AS item, generate_subscripts(l, 1) AS i, len(l) AS k FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS l FROM pages)) WHERE i > k - 3""")
def a18_last_items(spark, sf_dir):
    """The last three items of the first list of a page."""
    found = F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), F.lit(1))
    items = table(spark, sf_dir, "pages").select("page_id", found.alias("l")).select("page_id", F.size("l").alias("k"), F.posexplode("l").alias("i", "item"))
    return items.where("i >= k - 3").select("page_id", (F.col("i") + 1).cast("long").alias("n"), "item")


@query(r"""WITH l AS (SELECT page_id, list_filter(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 0), lambda x: contains(regexp_extract(x, '>([^<]*)</a>', 1), 'th')) AS l FROM pages),
e AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) - greatest(len(l) - 3, 0) AS n FROM l)
SELECT page_id, n, trim(replace(regexp_extract(x, '>([^<]*)</a>', 1), '&amp;', '&')) AS sender, regexp_extract(x, 'href="([^"]*)"', 1) || chr(10) || trim(replace(regexp_extract(x, '>([^<]*)</a>', 1), '&amp;', '&')) AS content FROM e WHERE n > 0""")
def a18_page_messages(spark, sf_dir):
    """The last three messages of senders that hold a name, from the markup of whole pages; the items of their lists are turned into messages."""
    item = '<li class="x msg-list-item"><span class=name>$2</span><div class="text-content">$1<br>$2</div></li>'
    html = F.regexp_replace("html", '<li><a href="([^"]*)">([^<]*)</a></li>', item)
    found = markup.messages(html, fixed.PAGE_MESSAGES["browser"], "th", last=3)
    each = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("i", "m"))
    return each.select("page_id", (F.col("i") + 1).cast("long").alias("n"), "m.sender", "m.content")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
  count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def a19_grid(spark, sf_dir):
    """Sparse cells as a full rectangle: days by kind of event."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    grid = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", kinds).agg(F.count("event_id"))
    return grid.na.fill(0, kinds)


@query("""SELECT event_id, 'mail-' || user_id AS name, 'global' AS scope FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, 'chat', '/p' || user_id FROM events WHERE event_id % 3 = 0""")
def a21_config_keys(spark, sf_dir):
    """Names of configured sources, in JSON (top and by project) or TOML; broken files give none."""
    name = F.concat(F.lit("mail-"), F.col("user_id"))
    json = F.concat(F.lit('{"mcpServers":{"'), name, F.lit('":{}},"projects":{"/p'), F.col("user_id"), F.lit('":{"mcpServers":{"chat":{}}}}}'))
    toml = F.concat(F.lit("[mcp_servers."), name, F.lit("]\ncommand = 'x'\n[other]\n"))
    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, json).when(F.col("event_id") % 3 == 1, toml).otherwise('{"mcpServers": ').alias("raw"))
    keys = lambda path: F.json_object_keys(F.get_json_object("raw", path))
    top = raw.select("event_id", F.explode(F.coalesce(keys("$.mcpServers"), F.regexp_extract_all("raw", F.lit(r"(?m)^\[mcp_servers\.([A-Za-z0-9_-]+)\]"), F.lit(1)))).alias("name"), F.lit("global").alias("scope"))
    projects = raw.select("event_id", F.explode(F.from_json(F.get_json_object("raw", "$.projects"), "map<string,string>")).alias("scope", "project"))
    nested = projects.select("event_id", F.explode(F.json_object_keys(F.get_json_object("project", "$.mcpServers"))).alias("name"), "scope")
    return top.unionByName(nested)


@query("""SELECT event_id, unnest(CASE event_id % 6 WHEN 0 THEN ['mail-' || user_id, 'chat', event_type] WHEN 1 THEN ['mail-' || user_id, event_type] WHEN 2 THEN ['mail-' || user_id, event_type] WHEN 3 THEN [event_type, 'b-' || user_id, 'again'] ELSE [] END) AS name FROM events""")
def a21_config_files(spark, sf_dir):
    """Names of configured sources in JSON, TOML and YAML of odd layouts, each once; broken files and files without the section give none."""
    files = {
        0: '{"mcpServers":{"mail-U":{},"chat":{"env":{"no":1}}},"projects":{"/p":{"mcpServers":{"T":{},"chat":{}}},"/q":{"mcpServers":[1]},"/r":7}}',
        1: "[other]\n  [ mcp_servers.\"mail-U\" ]\ncommand = 'x'\n[mcp_servers.T]\n[mcp_servers.T.env]\nk = '[mcp_servers.no]'\n",
        2: "other:\n  x: 1\nmcp_servers:\n  mail-U:\n    command: run\n  # note: no\n\n  T:\n    url: x\nlast:\n  no: 1\n",
        3: "mcp_servers :\n\n    T: 1\n  odd: 2\n    b-U: 3\n    - item: no\nmcp_servers:\n    again: 1\nend: 1\nmcp_servers:\n    never: 1\n",
        4: '{"mcpServers": {"mail-U":',
        5: "servers:\n  T: 1\n# mcp_servers:\n  no: 1\n",
    }
    made = F.element_at(F.array(*map(F.lit, files.values())), (F.col("event_id") % 6 + 1).cast("int"))
    filled = F.replace(F.replace(made, F.lit("T"), F.col("event_type")), F.lit("U"), F.col("user_id").cast("string"))
    raw = table(spark, sf_dir, "events").select("event_id", filled.alias("raw"))
    of = lambda keys, kind: raw.where(kind).select("event_id", F.explode(F.array_distinct(keys)).alias("name"))
    json, toml = of(configs.json_keys("raw"), "event_id % 6 IN (0, 4)"), of(configs.toml_keys("raw"), "event_id % 6 = 1")
    return json.union(toml).union(configs.yaml_keys(raw.where("event_id % 6 IN (2, 3, 5)"), "event_id", "raw").select("event_id", "name").distinct())


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'social' WHEN 1 THEN 'docs' WHEN 2 THEN 'ai_memory' WHEN 3 THEN 'mail' WHEN 4 THEN 'social' END AS category FROM part""")
def a22_export_files(spark, sf_dir):
    """Category of export files by the first pattern that fits their name (j5)."""
    names = F.array(*map(F.lit, ["Twitter-", "takeout-", "ChatGPT-data-", "box", "instagram-", "notes"]))
    ends = F.array(*map(F.lit, [".zip", ".tgz", ".json", ".MBOX", ".zip", ".txt"]))
    k = (F.col("p_partkey") % 6 + 1).cast("int")
    name = F.concat(F.element_at(names, k), F.col("p_partkey"), F.element_at(ends, k))
    category = None
    for pattern, found in fixed.EXPORT_PATTERNS:
        test = F.rlike(name, F.lit(f"(?i){pattern}"))
        category = F.when(test, found) if category is None else category.when(test, found)
    return table(spark, sf_dir, "part").select("p_partkey", category.alias("category"))


@query("""SELECT page_id FROM pages WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) NOT IN ('spam-farm.example.org', 'thther.example.org')""")
def j10_blacklist(spark, sf_dir):
    """Pages whose host isn't listed."""
    listed = spark.createDataFrame([("spam-farm.example.org",), ("thther.example.org",)], "host string")
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    return pages.join(F.broadcast(listed), "host", "left_anti").select("page_id")


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS reviewed FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j9_reviews(spark, sf_dir):
    """Documents with the review that belongs to them, if any."""
    reviews = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("r"))
    return table(spark, sf_dir, "documents").join(reviews, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("r", F.lit(False)).alias("reviewed"))


@query("""SELECT CASE WHEN lower(n) LIKE '%.eml' THEN 'eml' WHEN lower(n) LIKE '%.mbox' THEN 'mbox' WHEN lower(n) LIKE '%.json' THEN 'json' ELSE 'text' END AS format, count(*) AS n FROM (SELECT 'f' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.EML' WHEN 1 THEN '.mbox' WHEN 2 THEN '.Json' ELSE '.log' END AS n FROM customer) GROUP BY 1""")
def a1_format_dispatch(spark, sf_dir):
    """The parser of a file by its suffix in any case."""
    suffix = F.element_at(F.array(*map(F.lit, [".EML", ".mbox", ".Json", ".log"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    name = F.lower(F.concat(F.lit("f"), F.col("c_custkey"), suffix))
    kind = F.when(F.endswith(name, F.lit(".eml")), "eml").when(F.endswith(name, F.lit(".mbox")), "mbox").when(F.endswith(name, F.lit(".json")), "json").otherwise("text")
    return table(spark, sf_dir, "customer").groupBy(kind.alias("format")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, 'u' || doc_id || '@example.com' AS sender, 'Grüße ' || lang AS subject, 'Text ' || source AS body FROM documents WHERE doc_id % 3 <> 2""")
def a2_mail_mime(spark, sf_dir):
    """Mails in their raw form parsed: plain ones, HTML before plain, and ones without a body, which go."""
    k = F.col("doc_id")
    head = F.concat(F.lit("From: u"), k, F.lit("@example.com\nSubject: =?utf-8?B?"), F.base64(F.encode(F.concat(F.lit("Grüße "), F.col("lang")), "utf-8")), F.lit("?=\n"))
    plain = F.concat(head, F.lit("Content-Type: text/plain; charset=utf-8\n\nText "), F.col("source"), F.lit("\n> quoted\n"))
    parts = F.concat(head, F.lit('MIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="b"\n\n--b\nContent-Type: text/html\n\n<p>no</p>\n--b\nContent-Type: text/plain\n\nText '), F.col("source"), F.lit("\n--b--\n"))
    raw = F.when(k % 3 == 0, plain).when(k % 3 == 1, parts).otherwise(F.concat(head, F.lit("\n\n")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode(raw, "utf-8").alias("raw"))
    return mail.parsed(rows, "raw", "EXAMPLE").select("doc_id", F.col("from").alias("sender"), "subject", "body")


@query("""SELECT conv_id, turn, role || '@example.com' AS sender, 'turn ' || turn AS subject FROM conversations""")
def a3_mailbox(spark, sf_dir):
    """Mailboxes, one of each conversation with a mail of each turn, cut and parsed."""
    one = F.concat(F.lit("From x\nFrom: "), F.col("role"), F.lit("@example.com\nSubject: turn "), F.col("turn"), F.lit("\n\nsaid something\n\n"))
    boxes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", one.alias("m")))), lambda x: x.m), "").alias("box"))
    raw = boxes.select(F.col("conv_id").cast("string").alias("path"), F.encode("box", "utf-8").alias("content")).mapInPandas(mail.split_mailbox, "path string, seq long, raw binary")
    found = mail.parsed(raw, "raw")
    return found.select(F.col("path").cast("long").alias("conv_id"), F.substring("subject", 6, 9).cast("long").alias("turn"), F.col("from").alias("sender"), "subject")


@query(r"""SELECT conv_id, turn, role || '@example.com' AS sender, md5(CASE WHEN starts_with(body, 'From ') THEN '>' || body ELSE body END) AS body FROM (SELECT *, trim(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' ') AS body FROM conversations) WHERE body <> ''""")
def a3_mailbox_files(spark, sf_dir):
    """Mailboxes of many mails, landed as files that tasks read block by block, cut and parsed."""
    body = F.btrim(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), F.lit(" "))
    body = F.when(F.startswith(body, F.lit("From ")), F.concat(F.lit(">"), body)).otherwise(body)  # as mailboxes quote it
    mail_ = F.concat(F.lit("From x\nFrom: "), F.col("role"), F.lit("@example.com\nSubject: "), F.col("conv_id"), F.lit(" "), F.col("turn"), F.lit("\n\n"), body, F.lit("\n"))
    folder = steps.new_folder(spark, "mailboxes")
    boxes = table(spark, sf_dir, "conversations").select(mail_.alias("value"))
    boxes.write.text(folder)
    found = mail.read_mbox(spark, folder, pattern="*.txt")
    ids = F.split("subject", " ")
    return found.select(ids[0].cast("long").alias("conv_id"), ids[1].cast("long").alias("turn"), F.col("from").alias("sender"), F.md5("body").alias("body"))


@query("""SELECT doc_id, 'creator' AS via FROM documents WHERE source = 'src7' UNION ALL SELECT doc_id, 'keyword' FROM documents WHERE contains(text, 'idiot') AND NOT EXISTS (SELECT 1 FROM documents WHERE source = 'nobody')""")
def a15_creator_or_keyword(spark, sf_dir):
    """Documents of a creator, and by keyword where a search by creator (nobody) fails."""
    docs = table(spark, sf_dir, "documents")
    own = docs.where("source = 'src7'").select("doc_id", F.lit("creator").alias("via"))
    failed = docs.where("source = 'nobody'").agg(F.count("*").alias("n"))
    words = docs.where(F.contains("text", F.lit("idiot"))).select("doc_id", F.lit("keyword").alias("via"))
    return own.unionByName(words.join(F.broadcast(failed), F.col("n") == 0).drop("n"))


@query("""SELECT page_id, min(k) AS category FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages) p JOIN (VALUES (1, 'blog'), (2, 'm'), (3, 'www'), (4, 'example')) c(k, t) ON list_contains(string_split(h, '.'), t) GROUP BY page_id""")
def j4_token_categories(spark, sf_dir):
    """The first category that shares a token with a host, by a join on tokens instead of a comparison of all pairs."""
    dimension = spark.createDataFrame([(1, "blog"), (2, "m"), (3, "www"), (4, "example")], "k int, t string")
    tokens = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(F.regexp_extract("url", "^https?://([^/?#]+)", 1), r"\.")).alias("t"))
    return tokens.join(F.broadcast(dimension), "t").groupBy("page_id").agg(F.min("k").alias("category"))
