"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value" in path columns.
PLACEHOLDERS = ["", "nan", "none", "null", "na", "n/a", "-"]


def canonical_path(path: Column) -> Column:
    """``path`` without the differences that don't tell files apart.

    Letter case, kind and number of slashes, a leading ``./`` or ``/`` and outer blanks.
    """
    bare = F.regexp_replace(F.lower(path), "^[\\s\u00a0]+|[\\s\u00a0]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[\\/]+", "/"), r"^(?:\./|/)+", "")


def real_path(path: Column) -> Column:
    """The canonical path, NULL for NULL and placeholders."""
    clean = canonical_path(path)
    return F.when(~clean.isin(PLACEHOLDERS), clean)


def relative_to(path: Column, base: str) -> Column:
    """What follows the last ``base`` in ``path``; NULL stays NULL, no ``base`` leaves the whole path."""
    return F.element_at(F.split(path, base.replace("\\", "\\\\")), -1)


def under_root(root: str, path: Column) -> Column:
    """``path`` below ``root``; one leading slash of ``path`` is dropped first."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.regexp_replace(path, "^/", ""))


def stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
