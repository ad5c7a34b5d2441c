"""Path columns: name, stem, suffix, parts (POSIX semantics)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    """Last path component."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Suffix from the last dot of the name; a leading dot is not a suffix."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """Name without its suffix."""
    n = name(path)
    return F.when(F.length(suffix(path)) > 0, F.regexp_extract(n, r"^(.+)\.[^.]+$", 1)) \
        .otherwise(n)


def parts(path: Column) -> Column:
    """Path components; ordering by this column reproduces path-object order."""
    return F.split(path, "/")


def has_part_in(path: Column, names: list[str]) -> Column:
    """Any component of the path is one of ``names``."""
    return F.arrays_overlap(parts(path), F.array(*[F.lit(n) for n in names]))
