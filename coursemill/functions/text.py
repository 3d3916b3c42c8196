"""Text and scalar functions as columns: times, words, names, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(c: Column) -> Column:
    """Seconds of "MM:SS" or "H:MM:SS", brackets and a fraction allowed; null if malformed.

    Seconds stay under 60, and minutes too if there are hours; alone, minutes may be any number.
    """
    bare = F.regexp_replace(c, r"^\s*\[?|\]?\s*$", "")
    parts = F.split(bare, ":")
    n = F.size(parts)
    seconds, minutes = F.get(parts, n - 1).try_cast("double"), F.get(parts, n - 2).try_cast("double")
    hours = F.when(n == 3, F.get(parts, F.lit(0)).try_cast("double")).otherwise(F.lit(0.0))
    return F.when(bare.rlike(r"^(\d+:)?\d+:\d{1,2}(\.\d+)?$") & (seconds < 60) & ((n == 2) | (minutes < 60)), hours * 3600 + minutes * 60 + seconds)


def format_timestamp(seconds: Column) -> Column:
    """MM:SS under an hour, else H:MM:SS; fractions are dropped."""
    s = F.floor(seconds).cast("long")
    minutes, rest = F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60))
    hours = F.floor(s / 3600).cast("long")
    return F.when(s < 3600, F.format_string("%02d:%02d", minutes, rest)).otherwise(F.format_string("%d:%02d:%02d", hours, F.pmod(minutes, F.lit(60)), rest))


def caption_words(c: Column) -> Column:
    """Words as speech scoring compares them: without speakers and notes, lower case, apostrophes kept inside."""
    t = F.concat(F.lit(" "), c)
    t = F.regexp_replace(t, r"(?<=\s)[A-Z][A-Z .'-]*[A-Z]:", " ")
    t = F.regexp_replace(t, r"\[[^\]]*\]|\([A-Z][A-Z ,.'-]*\)", " ")
    t = F.lower(F.regexp_replace(F.regexp_replace(t, "[‘’]", "'"), "[-‐-―]", " "))
    t = F.regexp_replace(t, r"(?U)[^\w\s']", "")
    return F.filter(F.transform(F.split(t, r"(?U)\s+"), lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: w != "")


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def singular(token: Column) -> Column:
    return F.when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def undouble_backslashes(c: Column) -> Column:
    """Halve every run of backslashes if all are even and a pair starts a command."""
    odd = c.rlike(r"(?<!\\)\\(?:\\\\)*(?!\\)")
    return F.when(~odd & c.rlike(r"\\\\[A-Za-z]{2,}"), F.regexp_replace(c, r"\\\\", r"\\")).otherwise(c)


def unique_formulas(c: Column) -> Column:
    return F.array_distinct(c)


def one_question(rewritten: Column, original: Column) -> Column:
    """The first line of a rewritten question without the model's tags; the original if nothing is left."""
    bare = F.regexp_replace(rewritten, r"</?(?:question|conversation|search|query|answer)>", "")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), original)


def thread_title(c: Column, limit: int = 80) -> Column:
    """One line of at most ``limit`` characters, cut at a space, an ellipsis added."""
    line = F.trim(F.regexp_replace(c, r"\s+", " "))
    head = F.substring(line, 1, limit - 1)
    at_space = F.regexp_extract(head, r"^(.*) ", 1)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.when(at_space == "", head).otherwise(F.rtrim(at_space)), F.lit("…")))


def source_key(id_: Column, filename: Column) -> Column:
    return F.concat(F.lit("raw/"), id_.cast("string"), F.lit("/source"), F.regexp_extract(F.lower(filename), r"(\.[a-z0-9]{1,8})$", 1))


def html_escape(c: Column, quote: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"), ("'", "&#x27;")) if quote else ()):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def text_model(model: Column) -> Column:
    """Model name without its provider."""
    return F.substring_index(model, ":", -1)


def title_from_url(url: Column) -> Column:
    return F.concat(F.lit("Video from "), F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z]+://([^/?#:]*)", 1), r"^www\.", ""))


def filename_from_url(url: Column) -> Column:
    last = F.substring_index(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", ""), "/", -1)
    return F.when(last.contains(".") & (F.length(last) <= 255), last).otherwise(F.lit("video"))
