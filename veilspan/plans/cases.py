"""Thai texts made from columns of the driver's tables, so that every rule has something to find.

The expected answers in SQL come from the same columns by plain arithmetic, never from the rules themselves. Each expression is valid
in Spark SQL and in DuckDB.
"""

from __future__ import annotations

CHECK_DIGIT = "(11 - ({sum}) % 11) % 10"


def digit(value: str, place: int) -> str:
    return f"CAST(substring({value}, {place}, 1) AS INT)"


def thai_id(number: str) -> str:
    """A 13-digit number with a right check digit, from an expression of 12 digits as text."""
    total = " + ".join(f"{digit(number, i)} * {14 - i}" for i in range(1, 13))
    return f"concat({number}, CAST((11 - ({total}) % 11) % 10 AS STRING))"


CUSTOMER_ID = "CAST(100000000000 + c_custkey * 7919 AS STRING)"
