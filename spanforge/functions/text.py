"""Scalar text functions of the pipeline as column expressions (JVM side, except compatibility normalisation)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MARK = "▁"
DELETED = "[\\p{Zl}\\p{Zp}\\p{Cc}\\p{Cf}\\p{Co}\\p{Cn}]"
SYMBOL = f"({MARK}+[^\\p{{L}}\\p{{N}}_\\p{{Z}}]|[^\\p{{L}}\\p{{N}}_\\p{{Z}}{MARK}])"
# texts of these characters alone are their own compatibility form
STABLE = "^[\\x{0}-\\x{9F}\\x{A1}-\\x{A7}\\x{A9}\\x{AB}-\\x{AE}\\x{B0}\\x{B1}\\x{B6}\\x{B7}\\x{BB}\\x{BF}-\\x{131}\\x{134}-\\x{13E}\\x{141}-\\x{148}\\x{14A}-\\x{17E}\\x{400}-\\x{482}\\x{48A}-\\x{52F}\\x{2013}\\x{2014}\\x{2018}-\\x{2023}\\x{2581}]*$"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Compatibility composition; only texts that can change are sent to Python."""
    changed = _nfkc(F.when(~text.rlike(STABLE), text))
    return F.coalesce(changed, text)


def prepare(text: Column, normalise: bool = True) -> Column:
    """Normal form of a line: line ends inside a text are blanks, compatibility form, control and format characters deleted, digits and symbols set apart, blanks collapsed."""
    t = F.regexp_replace(text, "[\\r\\n]+", " ")
    t = nfkc(t) if normalise else t
    t = F.regexp_replace(t, DELETED, "")
    t = F.regexp_replace(t, "([0-9]+)", " $1 ")
    t = F.regexp_replace(t, SYMBOL, " $1 ")
    return F.trim(F.regexp_replace(t, "\\p{Z}+", " "))


def split_tokens(prepared: Column) -> Column:
    return F.filter(F.split(prepared, " "), lambda x: x != "")


def mark_words(prepared: Column) -> Column:
    """Target form: word starts marked, no blanks; the empty line is one mark."""
    return F.concat(F.lit(MARK), F.regexp_replace(prepared, "\\p{Z}+", MARK))


def marked_words(target: Column) -> Column:
    """The marked words of a target string."""
    return F.transform(F.filter(F.split(target, MARK), lambda x: x != ""), lambda x: F.concat(F.lit(MARK), x))


def detokenize(tokens_text: Column) -> Column:
    return F.trim(F.replace(F.replace(tokens_text, F.lit(" "), F.lit("")), F.lit(MARK), F.lit(" ")))


def spans(word: Column, maxlen: int | None = None, minlen: int = 1) -> Column:
    """All (start, end, span) of a word, by start then length; a span never crosses a word start when words are given one by one."""
    n = F.length(word)
    starts = F.when(n >= minlen, F.sequence(F.lit(0), n - minlen))

    def of(i: Column) -> Column:
        longest = F.least(n - i, F.lit(maxlen)) if maxlen else n - i
        return F.transform(F.sequence(F.lit(minlen), longest), lambda k: F.struct(i.cast("int").alias("start"), (i + k).cast("int").alias("end"), F.substring(word, i + 1, k).alias("span")))

    return F.coalesce(F.flatten(F.transform(starts, of)), F.array().cast("array<struct<start:int,end:int,span:string>>"))


def thousands(n: Column) -> Column:
    return F.format_string("%.1fk", n / 1000)
