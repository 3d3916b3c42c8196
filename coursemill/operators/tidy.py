"""Slide readings made tidy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.functions.text import undouble_backslashes, unique_formulas
from coursemill.kernels.latex import plain_latex, upright_names

# fixed values: words a model writes for nothing, and OCR's zero for a big O
NOTHING = ['""', "''", "none", "null", "n/a"]
BIG_O = r"(?<![\p{L}\p{N}_.])0(?=\([^()\n]{0,20}(?:\([^()\n]{0,20}\)[^()\n]{0,10})?\))"


def without_title(text: Column, title: Column) -> Column:
    """Text without a leading copy of the title on one line or several; case and blanks do not matter."""
    lines = F.split(text, "\n")
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    starts = F.sequence(F.lit(1), F.size(lines))
    count = F.array_min(F.filter(starts, lambda n: squeeze(F.array_join(F.slice(lines, F.lit(1), n), " ")) == F.lower(title)))
    rest = F.regexp_replace(F.array_join(F.slice(lines, count + 1, F.size(lines)), "\n"), r"^\n+", "")
    return F.when((title != "") & count.isNotNull(), rest).otherwise(text)


def tidy_readings(slides: DataFrame) -> DataFrame:
    """Readings (title, text, figure_description, code, latex, reader) as they are shown.

    LaTeX in texts becomes readable, formulas are repaired and listed once, words for nothing become empty, the title is
    one line and no longer leads the text, and OCR's 0(n) becomes O(n). Only rows with a backslash or formula reach
    Python.
    """
    plain = F.pandas_udf(plain_latex, "string")
    upright = F.pandas_udf(lambda s: s.map(lambda a: None if a is None else list(upright_names(__import__("pandas").Series(list(a), dtype=object)))), "array<string>")
    touched = F.size("latex") > 0
    for c in ("title", "text", "figure_description"):
        touched = touched | F.coalesce(F.col(c), F.lit("")).contains("\\")
    raw = slides.where(F.coalesce(touched, F.lit(False)))
    raw = raw.withColumns({c: plain(c) for c in ("title", "text", "figure_description")} | {"latex": unique_formulas(upright(F.transform("latex", undouble_backslashes)))})
    rows = slides.where(~F.coalesce(touched, F.lit(False))).unionByName(raw)
    rows = rows.withColumns({c: F.when(F.lower(F.trim(c)).isin(NOTHING), "").otherwise(F.coalesce(c, F.lit(""))) for c in ("title", "text", "figure_description", "code")})
    rows = rows.withColumn("title", F.trim(F.regexp_replace("title", r"\s+", " ")))
    rows = rows.withColumn("text", without_title(F.col("text"), F.col("title")))
    ocr = F.col("reader") == "ocr"
    return rows.withColumns({c: F.when(ocr, F.regexp_replace(c, BIG_O, "O")).otherwise(F.col(c)) for c in ("title", "text")})
