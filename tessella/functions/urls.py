"""URL functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella import fixed


def is_grounded(url: Column | str) -> Column:
    """Whether an http(s) URL names one source: not a generic path, and two path segments, a long slug or an id in the query."""
    url = F.col(url) if isinstance(url, str) else url
    authority = F.regexp_extract(url, "^https?://([^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
    query = F.lower(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    marked = reduce(lambda a, b: a | b, (F.contains(query, F.lit(m)) for m in fixed.QUERY_MARKERS))
    known = (authority != "") & ~F.coalesce(F.nullif(path, F.lit("")), F.lit("/")).isin(*fixed.GENERIC_PATHS)
    return F.coalesce(known & ((F.size(segments) >= 2) | (F.length(F.coalesce(F.get(segments, 0), F.lit(""))) >= 8) | marked), F.lit(False))


def page_kind(url: Column | str) -> Column:
    """wiki, doc, sheet, base or unknown, by the first path segment that is one of them."""
    url = F.col(url) if isinstance(url, str) else url
    kind = F.when(F.rlike(url, F.lit("/wiki/")), "wiki").when(F.rlike(url, F.lit("/(docx|docs|doc)/")), "doc")
    return kind.when(F.rlike(url, F.lit("/(sheets|spreadsheets)/")), "sheet").when(F.rlike(url, F.lit("/(base|bitable)/")), "base").otherwise("unknown")


def permalink(post_id: Column, username: Column, url: Column) -> Column:
    """The canonical address of a post, from its id and author or else from its own address; null if they don't agree."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https://([^/?#:]+)", 1)), r"^(www\.|mobile\.)", "")
    name, seen = F.regexp_extract(url, r"^https://[^/?#]+/([A-Za-z0-9_]{1,15})/status/(\d+)", 1), F.regexp_extract(url, r"^https://[^/?#]+/([A-Za-z0-9_]{1,15})/status/(\d+)", 2)
    valid = F.coalesce(F.rlike(post_id, F.lit(r"^[0-9]+$")), F.lit(False))
    return F.when(valid & F.coalesce(F.rlike(username, F.lit(r"^[A-Za-z0-9_]{1,15}$")), F.lit(False)), F.concat(F.lit("https://x.com/"), username, F.lit("/status/"), post_id)).when(
        valid & host.isin("x.com", "twitter.com") & (seen == post_id), F.concat(F.lit("https://x.com/"), name, F.lit("/status/"), seen)
    )
