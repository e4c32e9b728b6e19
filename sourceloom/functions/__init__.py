"""Column functions of code facts: paths, languages, libraries and change statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = (("python", (".py",)), ("typescript", (".ts", ".tsx")), ("javascript", (".js", ".jsx", ".mjs", ".cjs")))


def path_dirname(path: Column) -> Column:
    """What stands before the last separator; ``(root)`` without one."""
    return F.when(path.rlike(r"[/\\]"), F.regexp_replace(path, r"[/\\][^/\\]*$", "")).otherwise(F.lit("(root)"))


def path_basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def path_segments(path: Column) -> Column:
    """The parts between single separators; a leading separator gives an empty first part."""
    return F.split(path, r"[/\\]")


def common_prefix(low: Column, high: Column) -> Column:
    """The common first elements of two arrays; of many, take the smallest and the largest one."""
    n = F.least(F.size(low), F.size(high))
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
        lambda k, i: F.when((k == i - 1) & (i <= n) & (F.try_element_at(low, i) == F.try_element_at(high, i)), i).otherwise(k),
    )
    return F.when(n > 0, F.slice(low, F.lit(1), same)).otherwise(F.slice(low, F.lit(1), F.lit(0)))


def language_of(path: Column) -> Column:
    """The language of a file by its extension in any case, null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.[^.]*$", 0))
    return F.coalesce(*(F.when(extension.isin(*known), name) for name, known in LANGUAGES))


def library_module(library: Column, function: Column) -> Column:
    """The module of a library name: without its last dotted part where that is the function's name."""
    return F.when(library.endswith(F.concat(F.lit("."), function)), F.substring(library, F.lit(1), F.length(library) - F.length(function) - 1)).otherwise(library)


def documentation_url(language: Column, library: Column) -> Column:
    """Where a library is documented."""
    python = F.concat(F.lit("https://docs.python.org/3/library/"), F.substring_index(library, ".", 1))
    return F.when(language == "python", python).otherwise(F.concat(F.lit("https://www.npmjs.com/package/"), library))


def effective_status(status: Column) -> Column:
    """The unstaged change status, else the staged one."""
    return F.coalesce(status["unstaged"], status["staged"])
