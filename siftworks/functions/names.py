"""Lookup keys of spellings. Spark has no Unicode normalisation, so this is an Arrow-batched pandas UDF."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: An escaped code unit, which Java writes with one or more u, and a code point, which only JavaScript has.
_UNIT, _POINT = r"\\u+([0-9A-Fa-f]{4})", r"\\u\{0*([0-9A-Fa-f]{1,6})\}"


def _unescaped(language: str, s: str) -> str:
    """s without escapes; as it is if what they stand for is no text."""
    pattern = _UNIT if language == "java" else _UNIT.replace("u+", "u", 1) + "|" + _POINT
    try:
        one = re.sub(pattern, lambda m: chr(int(next(g for g in m.groups() if g), 16)), s)
        return one.encode("utf-16", "surrogatepass").decode("utf-16")  # pairs of units become characters
    except (ValueError, OverflowError):
        return s


@F.pandas_udf(StringType())
def _normal(language: pd.Series, spelling: pd.Series) -> pd.Series:
    def one(lang, s):
        if s is None:
            return None
        if lang == "rust":
            return unicodedata.normalize("NFC", s.removeprefix("r#"))
        if lang in ("java", "javascript"):
            return _unescaped(lang, s)
        return unicodedata.normalize("NFKC", s) if lang == "python" else s

    return pd.Series([one(a, b) for a, b in zip(language, spelling, strict=True)], dtype=object)


def lookup_key(language: Column, spelling: Column) -> Column:
    """The key by which a name is found: NFC without r# in Rust, NFKC in Python, the exact spelling with its escapes
    decoded in Java and JavaScript.

    ASCII names without escapes, nearly all, are answered in the JVM.
    """
    plain = F.when(language == "rust", F.regexp_replace(spelling, "^r#", "")).otherwise(spelling)
    escaped = language.isin("java", "javascript") & spelling.contains("\\u")
    normal = language.isin("rust", "python") & ~spelling.rlike(r"^[\x00-\x7f]*$")
    return F.when(escaped | normal, _normal(language, spelling)).otherwise(plain)
