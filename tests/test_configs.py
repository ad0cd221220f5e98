"""Keys of configuration files, and rows in the order of files, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import ranking, sections
from tessella.sources import configs


def plain_yaml(text, section="mcp_servers"):
    names, inside, child = [], False, None
    for line in text.splitlines():
        if re.match(rf"{section}\s*:", line):
            inside = True
        elif inside and line.strip() and not line.startswith((" ", "\t")):
            break
        elif inside and (m := re.match(r"(\s+)([A-Za-z0-9_.-]+)\s*:", line)):
            child = child or len(m[1])
            if len(m[1]) == child:
                names.append(m[2])
    return names


def test_yaml_keys(spark):
    """Files of random lines: any order of sections, indents, blanks, comments, lists, tabs and broken lines."""
    r = random.Random(4)
    lines = ["mcp_servers:", "mcp_servers :", "other:", "", "   ", "  a: 1", "    b:", "  c.d-e :", "\tt: x", "  - item: 1", "# note: 1", "  # mcp_servers:", "  {broken", "mcp_servers_not: 1", "  mcp_servers:", "      deep: 1", "- mcp_servers: 1"]
    files = [(i, "\n".join(r.choices(lines, k=r.randrange(14)))) for i in range(400)] + [(400, ""), (401, None), (402, "mcp_servers:"), (403, "mcp_servers:\r\n  a: 1\r\n  b: 2\r\n")]
    found = {}
    for row in configs.yaml_keys(spark.createDataFrame(files, "file long, text string"), "file", "text").orderBy("file", "place").collect():
        found.setdefault(row.file, []).append(row.name)
    assert found == {i: names for i, t in files if (names := plain_yaml(t or ""))}


@pytest.mark.parametrize("text,names", [
    ('{"mcpServers":{"a":{},"b":1},"projects":{"/p":{"mcpServers":{"a":{}}},"/q":{}}}', ["a", "b", "a"]), ('{"mcpServers":["a"]}', []), ('{"mcpServers":{}', []), ("[]", []), ("", []), (None, []), ('{"projects":{"/p":{"mcpServers":{"c":{}}}}}', ["c"]),
    ('{"projects":[1]}', []), ('{"projects":{"/p":null,"/q":{"mcpServers":null}}}', []), ("7", []),
])
def test_json_keys(spark, text, names):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(configs.json_keys("t").alias("x")).first().x == names


def test_toml_keys(spark):
    text = '[mcp_servers.a]\n  [ mcp_servers."b c" ]\n[mcp_servers.d.env]\nx = 1 # [mcp_servers.no]\n[other]\n[mcp_servers.e] # end'
    df = spark.createDataFrame([(text,), (None,), ("[mcp_servers",)], "t string")
    assert [r.x for r in df.select(configs.toml_keys("t").alias("x")).collect()] == [["a", "b c", "e"], [], []]


@pytest.mark.parametrize("size", [200, 5000, 1 << 27])
def test_rows_in_the_order_of_their_files(spark, tmp_path, size):
    for name, n in (("a", 700), ("b", 3)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i} {'x' * (i % 9)}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = ranking.in_file_order(spark.read.text(str(tmp_path)))
        first = ranking.first_n(lines, [F.col("seq.path")], ["seq"], 250)
        found = [r.value.split()[:2] for r in first.orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == [["a", str(i)] for i in range(250)] + [["b", str(i)] for i in range(3)]


@pytest.mark.parametrize("limit,least,private", [(10, 2, 4), (10, 2, 30), (10, 8, 4), (10, 2, 0), (4, 1, 4), (1000, 1, 5)])
def test_priority_budget(spark, limit, least, private):
    rows = [("me", i) for i in range(private)] + [("a", i) for i in range(9)] + [("b", i) for i in range(1)] + [(None, 3)]
    found = ranking.priority_budget(spark.createDataFrame(rows, "chat string, t int"), "chat", F.col("chat") == "me", [F.desc("t")], limit, least).collect()
    left = limit - min(private, limit)
    budget = max(least, left // 2) if left > 0 else 0
    want = [r for r in rows if r[0] == "me"][-limit:] if private else []
    want += [("a", i) for i in range(9)][max(0, 9 - budget) :] + [("b", 0), (None, 3)][: 2 if budget else 0]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_the_second_table_is_not_read_where_the_first_has_rows(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "first"))
    first, second = spark.read.parquet(str(tmp_path / "first")), []

    def otherwise():
        second.append(1)
        return spark.range(100, 101)

    assert sorted(r.id for r in ranking.first_filled(first, otherwise).collect()) == [0, 1, 2] and not second
    assert [r.id for r in ranking.first_filled(first.where("id > 7"), otherwise).collect()] == [100] and second == [1]


@pytest.mark.parametrize("text,n", [("", 0), ("no 1 2 #", 0), ("a👍b", 1), ("👍🏽👍", 2), ("👨‍👩‍👧‍👦 👩🏽‍🚀", 2), ("🇫🇷🇩🇪", 2), ("1️⃣#⃣", 2), ("❤️❤", 2), ("🏴󠁧󠁢󠁥󠁮󠁧󠁿", 1), ("漢字é", 0), ("🏳️‍🌈", 1)])
def test_emoji_count(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(X.emoji_count("t").alias("x")).first().x == n


def test_name_score(spark):
    members = [("Ann Lee", "annie", "al"), ("Lee", None, "ANN"), ("Bo", "Anna", "x"), ("na", "xyz", "nn"), ("n", "b", "A"), (None, None, None)]
    df = spark.createDataFrame(members, "r string, d string, u string")
    assert [r.x for r in df.select(X.name_score("Ann", F.col("r"), F.col("d"), F.col("u")).alias("x")).collect()] == [2, 3, 2, 1, 0, 0]
    assert [r.x for r in df.select(X.name_score("b n", F.col("r"), F.col("d"), F.col("u")).alias("x")).collect()] == [0, 0, 1, 0, 1, 0]


def test_corrections_and_patches(spark):
    base = spark.createDataFrame([(1, "## A\nold"), (2, "## A\nold\n## Correction Log\n\n(No entries yet)\n"), (3, "x"), (4, "## Correction 记录\n- e"), (5, "y")], "id long, text string")
    patches = spark.createDataFrame([(1, "## A\nnew"), (2, ""), (9, "## A\nof nobody")], "id long, text string")
    entry = "struct<scene:string,wrong:string,correct:string>"
    fixes = spark.createDataFrame([(1, [("s", "w", "c")]), (2, [("s", "w", "c"), (None, "v", "d"), ("half", "w", None)]), (3, [("s", "w", "c")]), (4, [("s", "w", "c")])], f"id long, corrections array<{entry}>")
    found = {r.id: r.text for r in sections.updated(base, patches, fixes, "id").collect()}
    assert found == {
        1: "## A\nnew", 2: "## A\nold\n## Correction Log\n- [general] should not v; should d\n- [s] should not w; should c\n", 3: "x\n\n## Correction Log\n\n- [s] should not w; should c\n",
        4: "## Correction 记录\n- [s] should not w; should c\n- e", 5: "y",
    }
