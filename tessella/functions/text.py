"""Text functions on columns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import fixed

#: What counts as white space in Unicode.
SPACE = r"[\t-\r\x1c-\x1f \x85\p{Z}]"
#: The same, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: What ends a line, besides \n and \r\n.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85  "


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(column(c), F.lit(SPACES))


def lines(c: Column | str) -> Column:
    """The lines of a text; a line end at its end begins no further line."""
    plain = F.translate(F.replace(column(c), F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS))
    # The last line end goes before the one split: naming the parts again would make them again.
    return F.when(column(c) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(plain, r"\n\z", ""), "\n", -1))


def first_filled(*cs: Column | str) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(column(c), F.lit("")) for c in cs), F.lit(""))


def contains_any(c: Column | str, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(column(c), F.lit(w)) for w in words), F.lit(False))


def length_bucket(c: Column | str, over: int, words: list[str], fold: bool = False) -> Column:
    """long (over so many characters), else decision (has one of words), else daily."""
    text = F.lower(column(c)) if fold else column(c)
    return F.when(F.length(column(c)) > over, "long").when(contains_any(text, words), "decision").otherwise("daily")


def capped(c: Column | str, most: int) -> Column:
    """Without control characters but tab and line ends, stripped, cut to ``most`` characters with an ellipsis."""
    clean = strip(F.regexp_replace(column(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    return F.when(F.length(clean) > most, F.concat(F.regexp_replace(F.substring(clean, 1, most - 3), f"{SPACE}+$", ""), F.lit("..."))).otherwise(clean)


def is_noise(c: Column | str) -> Column:
    """Fewer than two characters are left without <...> and :emoji: codes."""
    return F.length(strip(F.regexp_replace(F.regexp_replace(column(c), "<[^>]+>", ""), ":[a-z0-9_+-]+:", ""))) < 2


def without_quotes(c: Column | str) -> Column:
    """A mail body without quoted lines, forwards and what follows a long rule; a quote in the first line stays."""
    body = F.regexp_replace(column(c), fixed.QUOTED_LINE, "")
    body = F.regexp_replace(body, f"(?s){fixed.QUOTED_FORWARD}", "\n")
    return strip(F.regexp_replace(body, f"(?s){fixed.QUOTED_REST}", ""))


def copyright_safe(c: Column | str) -> Column:
    """No code fence, no quoted line, no clock time."""
    return ~(F.contains(column(c), F.lit("```")) | F.rlike(column(c), F.lit(r"(?m)^\s*>")) | F.rlike(column(c), F.lit(r"\b\d{2}:\d{2}:\d{2}")))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves to even; null of nothing."""
    return F.bround(F.try_divide(part * F.lit(100.0), whole), 0).cast("long")


@F.pandas_udf(T.StringType())
def _ascii(texts: pd.Series) -> pd.Series:
    """What is ASCII of the decomposed text; Spark has no function for that."""
    return texts.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def slug(c: Column | str, most: int = 40) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens; a text without any becomes person- and a hash.

    Letters are decomposed first (NFKD): those with marks lose them, full-width
    ones, ligatures and other compatible forms become plain; others are dropped.
    """
    joined = F.regexp_replace(F.regexp_replace(F.lower(_ascii(column(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(joined, 1, most), "-+$", "")
    return F.when(cut != "", cut).otherwise(F.concat(F.lit("person-"), F.substring(F.sha2(column(c), 256), 1, 8)))


def clock(seconds: Column | str) -> Column:
    """HH:MM:SS of a number of seconds."""
    s = column(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), F.pmod((s / 60).cast("long"), F.lit(60)), F.pmod(s, F.lit(60)))


def name_score(name: str, real: Column, display: Column, user: Column) -> Column:
    """How well a member's names fit one, whatever the case: 3 one is it, 2 one holds it, 1 real and display name together hold its letters, else 0."""
    probe = F.lower(F.lit(name))
    names = [F.coalesce(F.lower(n), F.lit("")) for n in (real, display, user)]
    letters = F.filter(F.split(probe, ""), lambda ch: strip(ch) != "")
    exact, part = (reduce(lambda a, b: a | b, (test(n) for n in names)) for test in (lambda n: n == probe, lambda n: F.contains(n, probe)))
    return F.when(exact, 3).when(part, 2).when(F.forall(letters, lambda ch: F.contains(names[0], ch) | F.contains(names[1], ch)), 1).otherwise(0)


#: An emoji as readers see one: a flag, a keycap, or pictures with their variants, skin tones and tags, joined or not.
_PICTURE = r"[\x{1F300}-\x{1F3FA}\x{1F400}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2300}-\x{23FF}](?:\x{FE0F}|[\x{1F3FB}-\x{1F3FF}])?(?:[\x{E0020}-\x{E007E}]+\x{E007F})?"
EMOJI = rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]\x{{FE0F}}?\x{{20E3}}|{_PICTURE}(?:\x{{200D}}{_PICTURE})*"


def emoji_count(c: Column | str) -> Column:
    """Emoji in a text, a sequence of code points that shows as one counting once."""
    return F.regexp_count(column(c), F.lit(EMOJI))


def safe_segment(c: Column | str) -> Column:
    """Whether a text can name one file or folder anywhere: no way up, no end that is cut off, no reserved name or character."""
    c = column(c)
    plain = (c != "") & ~c.isin(".", "..") & (F.length(c) <= fixed.SEGMENT_MOST) & ~F.rlike(c, F.lit(r"[. ]\z"))
    return F.coalesce(plain & ~F.rlike(c, F.lit(f"(?i){fixed.RESERVED_NAMES}")) & ~F.rlike(c, F.lit(fixed.UNSAFE_CHARACTERS)), F.lit(False))


def contained(base: Column | str, path: Column | str) -> Column:
    """Whether a path, read from base where it isn't absolute, ends below base, once its . and .. are taken."""

    def resolved(p: Column) -> Column:
        step = lambda at, s: F.when(s.isin("", "."), at).when(s == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s)))
        return F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)

    base, path = column(base), column(path)
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(base, F.lit("/"), path))
    above, below = resolved(base), resolved(whole)
    return F.coalesce((F.size(below) > F.size(above)) & (F.slice(below, F.lit(1), F.size(above)) == above), F.lit(False))
