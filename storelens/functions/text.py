"""String column helpers shared by the statement, request and page jobs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes, by its own rule (str.isspace).
# Java's and RE2's \s cover only part of them, so the class is spelled out.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

WS_CLASS = "[" + "".join(f"\\x{{{ord(ch):04x}}}" for ch in PY_WHITESPACE) + "]"
STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Remove leading and trailing whitespace exactly as Python's ``str.strip()``."""
    return F.regexp_replace(col_of(c), STRIP_PATTERN, "")


def sql_literal(s: str) -> str:
    """A string as a SQL literal that Spark SQL and DuckDB read the same way.

    Quotes, backslashes and control characters are written as ``chr(n)``
    (the two dialects escape them differently); other runs stay quoted.
    """
    parts, run = [], ""
    for ch in s:
        if ch in "'\\" or ord(ch) < 32:
            if run:
                parts.append("'" + run + "'")
                run = ""
            parts.append(f"chr({ord(ch)})")
        else:
            run += ch
    if run or not parts:
        parts.append("'" + run + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"
