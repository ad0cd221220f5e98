"""Names of the sources that configuration files of three formats hold; files that can't be read give none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import fixed
from tessella.functions import text as X


def json_keys(text: Column | str, section: str = "mcpServers", nested: str = "projects") -> Column:
    """Keys of a section of a JSON object, then those of the same section in each object of ``nested``; with repeats."""
    whole = F.try_parse_json(X.column(text))
    listed = lambda v: F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))
    own = listed(F.try_variant_get(whole, f"$.{section}", "variant"))
    projects = F.map_values(F.coalesce(F.from_json(F.to_json(F.try_variant_get(whole, f"$.{nested}", "variant")), "map<string,string>"), F.create_map().cast("map<string,string>")))
    inner = F.flatten(F.transform(projects, lambda p: F.coalesce(F.json_object_keys(F.get_json_object(p, f"$.{section}")), F.array().cast("array<string>"))))
    return F.concat(own, inner)


def toml_keys(text: Column | str) -> Column:
    """Names of the tables below the fixed one."""
    return F.coalesce(F.regexp_extract_all(X.column(text), F.lit(f"(?m){fixed.TOML_TABLE}"), F.lit(1)), F.array().cast("array<string>"))


def yaml_keys(files: DataFrame, key: str, text: str, section: str = "mcp_servers") -> DataFrame:
    """key, place, name of the direct children of a top-level section, told by indentation alone.

    The section goes from the line that names it to the first other line that
    isn't blank or indented; a line that names it again goes on with it.  The
    first indented key of the section sets the children's indent; deeper keys are
    theirs, and lists, comments and broken lines are passed over.  A fold over
    the lines of a file, as windows.
    """
    each = files.select(key, F.posexplode(X.lines(text)).alias("place", "line"))
    so_far = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    names = F.rlike("line", F.lit(rf"^\Q{section}\E\s*:"))
    marked = each.withColumn("names", names).withColumn("begun", F.max("names").over(so_far))
    outside = ~F.col("names") & F.col("begun") & (X.strip("line") != "") & ~F.rlike("line", F.lit("^[ \t]"))
    open_ = marked.withColumn("ended", F.max(outside).over(so_far)).where("begun AND NOT ended AND NOT names")
    part = lambda k: F.regexp_extract("line", fixed.YAML_KEY, k)
    keys = open_.where(F.rlike("line", F.lit(fixed.YAML_KEY))).select(key, "place", part(2).alias("name"), F.length(part(1)).alias("indent"))
    return keys.withColumn("first", F.first("indent").over(so_far)).where("indent = first").select(key, "place", "name")
