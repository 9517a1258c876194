"""Paths of images in Markdown: relative to where the Markdown is saved.

Paths are strings; no file is looked at, so they are the same on every machine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_IMAGE = r"!\[[^\]]*\]\([^)]+\)"


def _parts(path: Column) -> Column:
    """Names of an absolute path, without . and with .. resolved."""
    names = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.when(F.array_contains(names, ".."), F.aggregate(names, F.array().cast("array<string>"), up)).otherwise(names)


def relative_path(path: Column, folder: Column, base: Column) -> Column:
    """``path`` seen from ``folder``; paths that are not absolute begin at
    ``base``. URLs and empty paths stay, and backslashes become slashes."""
    clean = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    whole = F.when(F.startswith(clean, F.lit("/")), clean).otherwise(F.concat(base, F.lit("/"), clean))
    a, b = _parts(whole), _parts(folder)
    differ = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z, i: F.when(~z["a"].eqNullSafe(z["b"]), i)), lambda i: i.isNotNull())
    same = F.coalesce(F.get(differ, F.lit(0)), F.size(a))
    steps = F.concat(F.array_repeat(F.lit(".."), F.size(b) - F.least(same, F.size(b))), F.slice(a, same + 1, F.size(a)))
    found = F.when(F.size(steps) == 0, ".").otherwise(F.array_join(steps, "/"))
    return F.when((clean == "") | clean.rlike("^(?i)([a-z]+:)?//"), clean).otherwise(found)


def rewritten(markdown: Column, folder: Column, base: Column) -> Column:
    """Markdown whose images are named relative to ``folder``."""
    texts = F.split(markdown, _IMAGE, -1)
    images = F.regexp_extract_all(markdown, F.lit(f"({_IMAGE})"), 1)

    def named(image: Column) -> Column:
        alt, path = F.regexp_extract(image, r"^!\[([^\]]*)\]", 1), F.regexp_extract(image, r"\]\(([^)]+)\)$", 1)
        return F.concat(F.lit("!["), alt, F.lit("]("), relative_path(path, folder, base), F.lit(")"))

    both = F.transform(F.arrays_zip(texts.alias("t"), F.transform(images, named).alias("i")), lambda z: F.concat(F.coalesce(z["t"], F.lit("")), F.coalesce(z["i"], F.lit(""))))
    return F.when(F.coalesce(markdown, F.lit("")) == "", "").otherwise(F.array_join(both, ""))
