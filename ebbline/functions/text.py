"""String cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's ``str.isspace`` accepts.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


_IN_SQL = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)


def strip(column: str) -> str:
    """SQL that removes Unicode whitespace at both ends; a trim, no regex."""
    return f"trim(both '{_IN_SQL}' from {column})"
