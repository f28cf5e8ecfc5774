"""String helpers that reproduce Python ``str`` semantics with native functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, used by
# str.strip() and str.split() with no argument.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Regex class equal to PY_WHITESPACE (Java syntax).
PY_WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def py_strip(c: Column) -> Column:
    """``str.strip()``: trims the full Python whitespace set (Spark ``trim`` only trims spaces)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def py_split_join(c: Column) -> Column:
    """``" ".join(s.split())``: collapse whitespace runs to one space and trim."""
    return py_strip(F.regexp_replace(c, PY_WS_CLASS + "+", " "))


def truthy(c: Column, dtype: str = "string") -> Column:
    """Python truthiness of a scalar column: not NULL and not empty / zero."""
    if dtype == "string":
        return c.isNotNull() & (c != F.lit(""))
    if dtype == "array":
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull() & (c != F.lit(0))


def md5_bucket(c: Column, modulus: int = 100) -> Column:
    """``int(md5(s).hexdigest(), 16) % modulus`` without 128-bit integers.

    The digest is folded as four 32-bit chunks, Horner style, reducing modulo
    ``modulus`` after each step (``2**32 mod 100 = 96``). Each step stays far
    below 2**63, and the same expression runs in DuckDB for the oracle.
    """
    h = F.md5(c)
    factor = F.lit((1 << 32) % modulus)
    acc = F.lit(0).cast("long")
    for i in range(4):
        chunk = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        acc = F.pmod(acc * factor + F.pmod(chunk, F.lit(modulus)), F.lit(modulus))
    return acc
