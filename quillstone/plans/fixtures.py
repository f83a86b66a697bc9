"""Values that the queries and their SQL share."""

from __future__ import annotations

GREP_WORDS = ["nostro", "sanction", "ledger"]
#: A capability that searches are narrowed to.
CAPABILITY = "Fee Processing"


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "]::VARCHAR[]"
    return str(value)


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + ")"
