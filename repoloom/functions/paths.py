"""Column expressions over repository-relative paths ('/' separated)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Parent folder; '' for a path at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def join_path(parent: Column, child: Column) -> Column:
    return F.when(parent == "", child).otherwise(F.concat(parent, F.lit("/"), child))


def ancestors(path: Column, with_self: bool = True) -> Column:
    """All prefixes of ``path`` ending at a segment boundary, shortest first.

    ``a/b/c`` gives ``[a, a/b, a/b/c]``; the last one is left out when
    ``with_self`` is false. The empty root is not included.
    """
    parts = segments(path)
    last = F.size(parts) if with_self else F.size(parts) - 1
    prefix = lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), prefix)).otherwise(
        F.array().cast("array<string>")
    )


def glob_regex(pattern: str) -> str:
    """Anchored Java regex of a glob: ``**`` spans folders, ``*``, ``?`` and ``[ab]`` do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and (stop := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : stop]
            negated = inner[0] == "!"
            out, i = out + ("[^/" if negated else "[") + re.sub(r"([\\^\[&])", r"\\\1", inner[negated:]) + "]", stop + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def glob_regex_col(pattern: Column) -> Column:
    """As :func:`glob_regex` for a pattern column without ``**``."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+\-^$|])", r"\\$1")
    # a closed bracket is a set of characters again, its ranges and a leading ! included
    sets = F.regexp_replace(quoted, r"\\\[(!?)((?:[^/\]\\]|\\[^\]])+)\\\]", "[$1$2]")
    sets = F.regexp_replace(F.regexp_replace(sets, r"(\[[^\]]*?\w)\\-(?=\w)", "$1-"), r"(?<!\\)\[!", "[^/")
    stars = F.regexp_replace(sets, r"\*+", "[^/]*")
    return F.concat(F.lit("^"), F.regexp_replace(stars, r"\?", "[^/]"), F.lit("$"))
