"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six white-space bytes of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACES = "\t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``: inside a lambda an outer expression would be evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spaced(text: Column) -> Column:
    """``text`` (null: empty) with each white-space character turned into a space."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text`` in order."""
    return F.array_remove(F.split(spaced(text), " "), "")


def free_name(columns: list[str], stem: str) -> str:
    """A column name that no column of the input has, whatever its letter case."""
    have, name = {c.lower() for c in columns}, stem
    while name.lower() in have:
        name = f"_{name}"
    return name
