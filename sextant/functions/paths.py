"""Paths, fully qualified names and module names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First directories that are not part of a module's name.
ROOT_DIRS = ["src", "lib", "pkg"]


def canonical_path(c: Column) -> Column:
    """Blanks around trimmed, backslashes to slashes, one leading ``./`` dropped. Also for FQNs. Null stays null."""
    return F.regexp_replace(F.translate(F.regexp_replace(c, r"^\s+|\s+$", ""), "\\", "/"), r"^\./", "")


def module_parts(path: Column) -> Column:
    """The parts of the module of a ``.py`` file: path without ``.py`` and without a first directory src, lib or pkg."""
    parts = F.split(F.regexp_replace(path, r"\.py$", ""), "/")
    return F.when(F.element_at(parts, 1).isin(ROOT_DIRS) & (F.size(parts) > 1), F.slice(parts, 2, F.size(parts))).otherwise(parts)


def module_candidates(path: Column) -> Column:
    """Every trailing part of a file's module: ``a.b.c``, ``b.c``, ``c``."""
    parts = module_parts(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def relative_base(target: Column, source_file: Column) -> Column:
    """The file path, without ``.py``, that a target with leading dots means; null if it goes above the root.

    One dot is the directory of ``source_file``, each further dot one up.
    """
    dots = F.length(F.regexp_extract(target, r"^(\.+)", 1))
    rest = F.translate(F.regexp_replace(target, r"^\.+", ""), ".", "/")
    dirs = F.split(source_file, "/")
    keep = F.size(dirs) - dots
    base = F.slice(dirs, 1, F.greatest(keep, F.lit(0)))
    whole = F.array_join(F.concat(base, F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(rest))), "/")
    return F.when((dots > 0) & (keep >= 0), whole)
